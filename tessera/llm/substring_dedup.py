"""Substring dedup by recompression: shared symbols reveal repeated windows, hashes verify them."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices, text_bytes
from tessera.llm.recompression import window_hashes, witnesses

#: Words of a window; documents under one symbol from which on its windows are salted.
WINDOW, HOT = 50, 200
#: Windows of one row on their way to each other; their places are the bits of one number.
RUN = 60
_CACHE = 400_000
_TEXT = 4 << 20


class _Hashes(dict):
    """64-bit hash of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _parsed(batch: pa.RecordBatch, hashes: _Hashes, window: int):
    """Numbers of the rows with a window, their words' hashes and lengths, windows' places and witnesses."""
    known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    texts = [(t or b"").split() for t in text_bytes(batch, "text")]
    rows = np.flatnonzero([k and len(t) >= window for k, t in zip(known, texts, strict=True)])
    lens = np.array([len(texts[i]) for i in rows], np.int64)
    words = np.fromiter((hashes[w] for i in rows for w in texts[i]), np.uint64, lens.sum())
    if not len(rows):
        return rows, words, lens, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return rows, words, lens, *witnesses(words, lens, window)


def _version(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def _texts(batch: pa.RecordBatch, rows: np.ndarray, wanted: np.ndarray) -> list[bytes]:
    """Texts of the rows, empty where not wanted."""
    return [batch.column("text")[int(i)].as_py().encode() if wanted[i] else b"" for i in rows]


def _symbols(window: int):
    """``symbol, doc_id``: the witnesses of each document's windows, once each."""

    def run(batches):
        hashes = _Hashes()
        for batch in slices(batches, "text", _TEXT):
            rows, _, lens, at, found = _parsed(batch, hashes, window)
            doc = np.repeat(np.arange(len(rows)), lens)[at]
            new = np.ones(len(at), bool)
            new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
            doc, found = doc[new], found[new]
            order = np.lexsort((found, doc))
            doc, found = doc[order], found[order]
            new = np.ones(len(doc), bool)
            new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[new].view(np.int64)), pa.array(ids[doc[new]])], names=["symbol", "doc_id"])

    return run


def _windows(window: int):
    """``symbol, salt, doc_id, version, first, hashes``: runs of windows under one shared symbol, each window hashed whole.

    ``version`` tells apart the texts of a doc_id that has several; it is 0 for all others.
    """

    def run(batches):
        hashes = _Hashes()
        some = (batch.filter(batch.column("shared").is_valid()) for batch in batches)
        for batch in slices(some, "text", _TEXT):
            shared = batch.column("shared").flatten()
            if not len(shared):
                continue
            symbol, one = np.unique(shared.field("symbol").to_numpy(zero_copy_only=False), return_index=True)
            salts = shared.field("salts").to_numpy(zero_copy_only=False)[one]
            rows, words, lens, at, found = _parsed(batch, hashes, window)
            if not len(at):
                continue
            found = found.view(np.int64)
            spot = np.minimum(np.searchsorted(symbol, found), len(symbol) - 1)
            hit = symbol[spot] == found
            at, found, salts = at[hit], found[hit], salts[spot[hit]]
            if not len(at):
                continue
            doc = np.repeat(np.arange(len(rows)), lens)[at]
            new = np.ones(len(at), bool)
            new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
            head = np.flatnonzero(new)
            place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
            head = np.flatnonzero(place % RUN == 0)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)[doc[head]]
            several = batch.column("several").fill_null(False).to_numpy(zero_copy_only=False)
            version = np.array([_version(t) if s else 0 for s, t in zip(several[rows].tolist(), _texts(batch, rows, several), strict=True)], np.int64)
            salt = np.where(salts[head] > 0, ids % np.maximum(salts[head], 1), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)), pa.int32()), pa.array(window_hashes(words, at, window).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[head]), pa.array(salt, pa.int64()), pa.array(ids), pa.array(version[doc[head]]), pa.array(at[head] - (np.cumsum(lens) - lens)[doc[head]], pa.int32()), lists],
                names=["symbol", "salt", "doc_id", "version", "first", "hashes"],
            )

    return run


def _kept(window: int):
    def run(batches):
        for batch in slices(batches, "text", _TEXT):
            n_words, n_removed, kept = [], [], []
            places = batch.column("runs")
            for i, text in enumerate(text_bytes(batch, "text")):
                words = (text or b"").split()
                runs = places[i].values if places[i].is_valid else None
                if runs is not None:
                    version = runs.field("version").to_numpy(zero_copy_only=False)
                    if version.any():
                        runs = runs.filter(pa.array(version == _version(text or b"")))
                if runs is not None and len(runs):
                    mask = runs.field("mask").to_numpy(zero_copy_only=False).view(np.uint64)
                    bit = (mask[:, None] >> np.arange(RUN, dtype=np.uint64)) & np.uint64(1)
                    run, place = np.nonzero(bit)
                    starts = np.unique(runs.field("first").to_numpy(zero_copy_only=False)[run] + place)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts[starts <= len(words) - window], 1)
                    np.add.at(edge, starts[starts <= len(words) - window] + window, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, version, first, mask``: windows that also start in a document with a smaller doc_id, at ``first`` + each bit of ``mask``.

    Symbols that only one document has end their windows' search; documents get the shared ones back and
    hash the windows under them. Windows meet by symbol, runs of them in one row, and the smallest
    doc_id of each symbol and hash is found in the same exchange. Symbols of more than ``HOT``
    documents are salted: each salt's smallest then meet once more.
    """
    symbols = cut(docs.mapInArrow(_symbols(window), "symbol bigint, doc_id bigint"))
    shared = symbols.groupBy("symbol").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    salts = F.when(F.col("n") > HOT, F.ceil(F.col("n") / HOT)).otherwise(0).cast("bigint")
    shared = shared.filter("low < high").select("symbol", salts.alias("salts"))
    back = symbols.join(shared, "symbol").groupBy("doc_id").agg(F.collect_list(F.struct("symbol", "salts")).alias("shared"))
    text = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    back = back.join(text.filter("a <> b").select("doc_id", F.lit(True).alias("several")), "doc_id", "left")
    # A left join without a filter above it, so that this and the last join read the same exchange of texts.
    found = docs.join(back, "doc_id", "left")
    met = found.mapInArrow(_windows(window), "symbol bigint, salt bigint, doc_id bigint, version bigint, first int, hashes array<bigint>")
    each = met.repartition("symbol", "salt").select("symbol", "salt", "doc_id", "version", "first", F.posexplode("hashes").alias("place", "hash"))
    # A window, since it is content with the exchange by symbol and salt, where a join would add one of its own.
    each = each.withColumn("low", F.min("doc_id").over(Window.partitionBy("symbol", "salt", "hash")))
    # All that follows reads these rows, one a run, so that everything below is planned alike and its exchange is shared.
    runs = each.groupBy("symbol", "salt", "doc_id", "version", "first").agg(
        F.bit_or(F.when(F.col("low") < F.col("doc_id"), F.expr("shiftleft(1L, place)")).otherwise(0)).alias("mask"),
        F.collect_list(F.when((F.col("low") == F.col("doc_id")) & (F.col("salt") >= 0), F.struct("place", "hash"))).alias("tops"),
    )
    done = runs.filter("mask <> 0").select("doc_id", "version", "first", "mask")
    # Smallest of their salt: of hot symbols only.
    hot = runs.select("symbol", "doc_id", "version", "first", F.explode("tops").alias("top")).select("symbol", "doc_id", "version", "first", "top.place", "top.hash")
    # One row a salt and place, so a window's rows are few even where very many documents hold it; it needs no second reading of them.
    late = hot.withColumn("least", F.min("doc_id").over(Window.partitionBy("symbol", "hash"))).filter("least < doc_id")
    late = late.groupBy("doc_id", "version", "first").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
    return done.unionByName(late)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each row's text without words of repeated windows.

    A word goes if a window of ``window`` words that holds it has a word sequence that also starts in a
    document with a smaller doc_id. Windows are judged on the input. ``kept``: the words left, joined by one space.

    Null, empty and shorter texts: nothing to remove. Null doc_id: neither smaller nor larger than
    another, so nothing is removed for it or from it. Rows of one doc_id do not remove from
    each other; each loses what its own text shares with a smaller doc_id. Empty table: no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    runs = covered(docs, window).groupBy("doc_id").agg(F.collect_list(F.struct("version", "first", "mask")).alias("runs"))
    return docs.join(runs, "doc_id", "left").mapInArrow(_kept(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """n_words, n_removed and kept words by doc_id, by a dictionary of whole windows: for tests."""
    words = {i: (t or "").encode().split() for i, t in rows}
    least: dict[tuple, int] = {}
    for i in sorted(words):
        for a in range(len(words[i]) - window + 1):
            least.setdefault(tuple(words[i][a : a + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for a in range(len(w) - window + 1):
            if least[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out
