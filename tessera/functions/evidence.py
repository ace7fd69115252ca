"""Passages, grounding and typed values."""

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.addresses import bound
from tessera.functions.text import fold, folded_text

#: Longest passage, longest window of short blocks, and longest block that a window takes.
PASSAGE, CONTEXT, SHORT = 5500, 600, 200
#: Marks of consent and privacy notices, in folded text. Fixed values.
PRIVACY = (
    "administrator danych",
    "adres e mail",
    "adres e-mail",
    "danych osobowych",
    "inspektor ochrony danych",
    "polityka prywatnosci",
    "przetwarzanie danych",
    "wycofanie zgody",
    "wyrazam zgode",
    "zgode na kierowanie",
)
#: Marks of navigation, in folded text. Fixed values.
NAVIGATION = (
    "automaty vendingowe",
    "menu",
    "newsletter",
    "zaakceptuj cookies",
)
_BREAK = re.compile(r"\n[ \t]*\n+|\f")
#: Characters of a quote that are looked up first, and bits of a slot of their bitmap.
HEAD, SLOT_BITS = 24, 22
_PRIME, _MIX = 0x100000001B3, np.uint64(0x9E3779B97F4A7C15)


def idf(df: Column, n: Column) -> Column:
    """Smoothed inverse document frequency."""
    return 1 + F.log((n + 1) / (df + 1))


def boilerplate_penalty(text: Column, privacy_counts: bool = True) -> Column:
    """Points off for privacy notices, navigation, bare labels and questions; they add up."""
    folded = fold(text)
    privacy = folded.rlike("|".join(PRIVACY)) & F.lit(privacy_counts)
    label = (F.length(text) <= 60) & ~text.rlike(r"\d") & ~text.contains(":")
    parts = ((privacy, 100), (folded.rlike("|".join(NAVIGATION)), 100), (label, 6), (F.rtrim(text).endswith("?"), 100))
    return sum((F.when(hit, points).otherwise(0) for hit, points in parts), F.lit(0))


def grounded(quote: Column, passage: Column, start: Column) -> Column:
    """The quote stands in the passage at exactly this offset (from 0)."""
    return F.substring(passage, start + 1, F.length(quote)) == quote


def locator(text: str, start: int, end: int) -> str:
    """Page by the form feeds before the start where there are any in the text, else the characters' range."""
    return f"page:{text.count(chr(12), 0, start) + 1:04d}" if "\f" in text else f"chars:{start}-{end}"


def value_problem(kind: Column, text: Column, currency: Column) -> Column:
    """Rule code of a typed value; null where it holds."""
    number = F.regexp_replace(text, ",", ".").try_cast("decimal(18,4)")
    return (
        F.when(text.isNull() | (F.btrim(text) == ""), "empty")
        .when(kind.isin("integer", "decimal", "money", "percentage") & number.isNull(), "not_a_number")
        .when((kind == "integer") & (number != F.floor(number)), "not_integral")
        .when((kind == "money") & currency.isNull(), "money_without_currency")
        .when((kind == "percentage") & ~number.between(0, 100), "percentage_out_of_range")
        .when((kind == "boolean") & ~F.lower(text).isin("yes", "no", "true", "false", "tak", "nie"), "not_boolean")
        .when((kind == "date") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNull(), "not_a_date")
        .when((kind == "url") & ~text.rlike("^https?://[^/]+\\.[^/]+"), "not_a_url")
    )


def _bare(text: str, a: int, b: int) -> tuple[int, int]:
    """A range without white space at its ends."""
    piece = text[a:b]
    return a + len(piece) - len(piece.lstrip()), a + len(piece.rstrip())


def _cut(text: str, a: int, b: int, most: int) -> list[tuple[int, int]]:
    """A block in pieces of up to ``most`` characters, broken at a line's or sentence's end in a piece's second half."""
    out = []
    while b - a > most:
        at = max(text.rfind("\n", a, a + most), text.rfind(". ", a, a + most))
        stop = at + (text[at] == ".") if at - a >= most // 2 else a + most
        out.append((a, stop))
        a = stop
    return [*out, (a, b)]


def split_passages(text: str, most: int = PASSAGE, context: int = CONTEXT, short: int = SHORT) -> list[tuple[int, int]]:
    """Ranges of a text: its blocks, parted by blank lines and form feeds, and windows of neighbouring short blocks.

    A window holds blocks of up to ``short`` characters on one page, ``context`` characters in all; notices and
    navigation end it and belong to none. Blocks stay passages of their own beside their window.
    """
    edges = [0, *(x for m in _BREAK.finditer(text) for x in m.span()), len(text)]
    bare = [_bare(text, a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    blocks = [_bare(text, *piece) for a, b in bare if a < b for piece in _cut(text, a, b, most)]
    blocks = [(a, b) for a, b in blocks if a < b]
    windows: list[tuple[int, int]] = []
    open_ = False
    for a, b in blocks:
        plain = b - a <= short and not any(mark in folded_text(text[a:b]) for mark in (*PRIVACY, *NAVIGATION))
        if plain and open_ and b - windows[-1][0] <= context and "\f" not in text[windows[-1][1] : a]:
            windows[-1] = (windows[-1][0], b)
        elif plain:
            windows.append((a, b))
        open_ = plain
    return sorted({*blocks, *windows})


def passage_ranges(batches):
    """``mapInPandas`` over ``doc_id, text``: one row per passage."""
    for batch in batches:
        rows = [(i, p, a, b, t[a:b], locator(t, a, b)) for i, t in zip(batch["doc_id"], batch["text"], strict=True) if isinstance(t, str) for p, (a, b) in enumerate(split_passages(t))]
        yield pd.DataFrame(rows, columns=["doc_id", "pos", "start_char", "end_char", "passage", "locator"])


def window_slots(text: str, length: int) -> np.ndarray:
    """Slot of every window of ``length`` characters of a text, by a rolling hash."""
    n = len(text) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    # Hashes of 1, 2, 4, ... characters, each from the one before; the length's binary digits choose which make it up.
    h, done, size, power, part = np.full(n, length, np.uint64), 0, 1, np.uint64(_PRIME), chars
    with np.errstate(over="ignore"):
        while size <= length:
            if length & size:
                h = h * power + part[done : done + n]
                done += size
            if 2 * size <= length:
                part = part[:-size] * power + part[size:]
            size, power = 2 * size, power * power
    h ^= h >> np.uint64(29)
    return (h * _MIX >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def head_slots(batches):
    """``mapInArrow`` over ``head``: the slot of each."""
    for batch in batches:
        slots = [int(window_slots(h, len(h))[0]) for h in batch.column("head").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32())], names=["slot"])


def head_places(lengths: list[int], slots: list[int]):
    """``mapInArrow`` over ``doc_id, text``: ``doc_id, at, head`` where a window of one of ``lengths`` may be a head.

    Of windows under ``HEAD`` characters, which are whole quotes, only the first of each is given.
    """

    def run(batches):
        marked = np.zeros(1 << SLOT_BITS, bool)
        marked[slots] = True
        for batch in batches:
            ids, places, heads = [], [], []

            def flush():
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(heads, pa.string())], names=["doc_id", "at", "head"])
                for column in (ids, places, heads):
                    column.clear()

            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for length in lengths if text is not None else []:
                    seen = set()
                    for at in np.flatnonzero(marked[window_slots(text, length)]).tolist():
                        head = text[at : at + length]
                        if length < HEAD:
                            if head in seen:
                                continue
                            seen.add(head)
                        ids.append(doc_id)
                        places.append(at)
                        heads.append(head)
                        if len(ids) >= 50_000:
                            yield from flush()
            yield from flush()

    return run


#: Characters that a page needs at least, that part two pages, and pages of the even sample.
LEAST_PAGE, BETWEEN, SAMPLE = 10, 3, 20


def _counts(text: Column, terms: list[str]) -> Column:
    """How many of the terms are words of ``text``; a page is looked through for a term only until it is found."""
    if not terms:
        return F.lit(0)
    # Terms that are no single word are words of no text.
    words = [t for t in dict.fromkeys(terms) if t and all(unicodedata.category(c)[0] in "LN" for c in t)]
    bare = r"[^\p{L}\p{N}]"
    hits = lambda folded: sum(((folded.contains(t) & folded.rlike(rf"(?:^|{bare}){t}(?:{bare}|\z)")).cast("int") for t in words), F.lit(0))
    return bound(fold(text), hits)


def ranked_pages(pages: Column, terms: list[str]) -> Column:
    """Pages that are not blank as ``tier, points, page, size, text``, in the order in which a reader would want them.

    Tier 0 holds pages with wanted terms, those with most of them first; then come the first page, an even
    sample, and the rest, each by number. ``text`` is without white space at the ends, ``size`` its characters.
    """
    full = F.filter(F.transform(pages, lambda p, i: F.struct(i.alias("page"), trimmed(p).alias("text"))), lambda p: p["text"] != "")
    # Inside a lambda an expression is made again for each of its uses, so what is used twice is bound as an argument before.
    full = F.transform(full, lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"), _counts(p["text"], terms).alias("points")))

    def ranked(full: Column) -> Column:
        last, steps = F.size(full) - 1, F.least(F.size(full), F.lit(SAMPLE)) - 1
        # The i-th of the full pages is sampled if some step falls on it, which can only be one of the two next to its share.
        falls = lambda i, step: (step >= 0) & (step <= steps) & (F.bround(step * last / F.greatest(steps, F.lit(1))) == i)

        def place(p: Column, i: Column) -> Column:
            near = F.floor(i * steps / F.greatest(last, F.lit(1)))
            tier = F.when(p["points"] > 0, 0).when(i == 0, 1).when(falls(i, near) | falls(i, near + 1), 2).otherwise(3)
            return F.struct(tier.alias("tier"), (-p["points"]).alias("points"), p["page"].alias("page"), F.length(p["text"]).alias("size"), p["text"].alias("text"))

        return F.array_sort(F.transform(full, place))

    return bound(full, ranked)


#: White space at the ends of a page.
WHITE = " \t\n\x0b\f\r"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def pages_that_fit(pages: Column, terms: list[str], most: int) -> Column:
    """``pages`` (numbers from 1), the ``chars`` they take of ``most``, and whether any page is cut or left out.

    A fold over the ranked pages: each costs its text, a heading with its number, and a separator from the one before. A
    page that does not fit is cut where the room ends; with less room than ``LEAST_PAGE`` it is passed over.
    """
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("cut"))

    def take(state: Column, p: Column) -> Column:
        head = F.length(F.concat(F.lit("[PDF page "), (p["page"] + 1).cast("string"), F.lit("]\n")))
        left = most - state["used"] - head - F.when(F.size(state["kept"]) > 0, BETWEEN).otherwise(0)

        def taken(room: Column) -> Column:
            fits = p["size"] <= room
            chars = F.when(fits, p["size"]).otherwise(F.length(F.rtrim(F.substring(p["text"], F.lit(1), room), F.lit(WHITE))))
            more = F.struct(F.array_append(state["kept"], p["page"] + 1).alias("kept"), (most - room + chars).cast("int").alias("used"), (state["cut"] | ~fits).alias("cut"))
            return F.when((room >= LEAST_PAGE) & (state["used"] < most), more).otherwise(state)

        return bound(left, taken)

    def folded(ranked: Column) -> Column:
        left_out = lambda s: F.struct(F.array_sort(s["kept"]).alias("pages"), s["used"].alias("chars"), (s["cut"] | (F.size(s["kept"]) < F.size(ranked))).alias("truncated"))
        return F.aggregate(ranked, start, take, left_out)

    return bound(ranked_pages(pages, terms), folded)
