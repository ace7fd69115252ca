"""SentencePiece encoding and decoding over a relational lattice of substrings and pieces."""

import heapq
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import BLOCK, BUCKETS, SPREAD, Numbers, bucketed, squeezed, stays, unsqueezed
from tessera.llm.common import slices

#: Where the model file lies; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Longest unit in characters that the lattice takes. Longer ones part only where no piece crosses.
UNIT = 128
#: Documents of a block whose ids are put together at once.
_ASSEMBLED = 256
_MARK = "▁"
_UNK_PENALTY = 10.0
_CONTROLS = "\t\n\x0b\f\r"


@dataclass
class Pieces:
    """Pieces that text can hold (id, text, score), the bytes of every id, and ids of single bytes."""

    rows: list[tuple[int, str, float]]
    decoded: list[bytes]
    byte_ids: list[int]
    unknown: float
    alone: str

    @property
    def longest(self) -> int:
        return max(len(p) for _, p, _ in self.rows)

    @cached_property
    def single(self) -> dict[int, int]:
        """Ids of the pieces of one character, by code point."""
        return {ord(p): i for i, p, _ in self.rows if len(p) == 1}


def load(model: str = MODEL) -> Pieces:
    """Pieces of a model file."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows, decoded, byte_ids = [], [], [sp.unk_id()] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
            decoded.append(bytes([int(piece[3:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            decoded.append(b"")
        else:
            rows.append((i, piece, sp.get_score(i)))
            decoded.append(piece.replace(_MARK, " ").encode())
    inside = {c for _, p, _ in rows if len(p) > 1 for c in p}
    return Pieces(rows, decoded, byte_ids, min(s for *_, s in rows) - _UNK_PENALTY, "".join(c for c in _CONTROLS if c not in inside))


def unit_pattern(pieces: Pieces) -> re.Pattern:
    """Units of escaped text that no piece crosses: marks with the word after them, lone controls."""
    alone = re.escape(pieces.alone)
    return re.compile(f"[{alone}]|{_MARK}*[^{_MARK}{alone}]+|{_MARK}+")


def units(text: str, pattern: re.Pattern) -> list[str]:
    """The units of a text, in order; none for an empty one."""
    return pattern.findall(_MARK + text.replace(" ", _MARK)) if text else []


# ---- units too long for the lattice ----


def neighbours(pieces: Pieces) -> frozenset[str]:
    """Pairs of characters that stand side by side in some piece; between any others no piece crosses."""
    return frozenset(p[i : i + 2] for _, p, _ in pieces.rows for i in range(len(p) - 1))


def parted(unit: str, pairs: frozenset[str]) -> list[str]:
    """A unit of more than ``UNIT`` characters, cut only between characters that are neighbours in no piece.

    Parts are filled up to ``UNIT``; one stays longer where it has no such place.
    """
    out, start, safe = [], 0, 0
    for i in range(1, len(unit)):
        if unit[i - 1 : i + 1] not in pairs:
            if i - start > UNIT and safe > start:
                out.append(unit[start:safe])
                start = safe
            safe = i
    if len(unit) - start > UNIT and safe > start:
        out.append(unit[start:safe])
        start = safe
    return [*out, unit[start:]]


def merged_path(unit: str, table: dict[str, tuple[float, int]]) -> list[int]:
    """What ``merged_paths`` gives for one unit of any length, by a heap of merges (n log n)."""
    n = len(unit)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int]] = []

    def offer(a: int, b: int) -> None:
        if b < n and (found := table.get(unit[a : end[b]])):
            heapq.heappush(heap, (-found[0], a, end[b]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, a, stop = heapq.heappop(heap)
        # Stale unless its two symbols still stand: each start that was merged away has end 0.
        if not end[a] or end[a] >= n or end[end[a]] != stop:
            continue
        middle = end[a]
        end[middle], end[a] = 0, stop
        if stop < n:
            before[stop] = a
        if before[a] >= 0:
            offer(before[a], a)
        offer(a, stop)
    out, at = [], 0
    while at < n:
        out.append(table[unit[at : end[at]]][1] if end[at] > at + 1 else -ord(unit[at]))
        at = end[at]
    return out


def best_path(unit: str, table: dict[str, tuple[float, int]], longest: int, unknown: float) -> list[int]:
    """What ``best_paths`` gives for one unit of any length."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end in range(1, len(unit) + 1):
        top = None
        for start in range(max(0, end - longest), end):
            found = table.get(unit[start:end]) or ((unknown, -ord(unit[start])) if start == end - 1 else None)
            if found and (top is None or best[start][0] + found[0] > top[0]):
                top = (best[start][0] + found[0], start, found[1])
        best.append(top)
    out, at = [], len(unit)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return out[::-1]


def _long_path(pieces: Pieces, kind: str):
    table = {p: (s, i) for i, p, s in pieces.rows}
    if kind == "bpe":
        return lambda unit: merged_path(unit, table)
    longest = pieces.longest
    return lambda unit: best_path(unit, table, longest, pieces.unknown)


# ---- blocks: documents as numbers of their block's distinct units ----


#: ``k`` is a block's number on its documents' row, and -1 - bucket on the rows of its units.
_BLOCK_DDL = "k bigint, block bigint, data binary"


def _blocks(pieces: Pieces, buckets: int, kind: str):
    """Per block of up to ``BLOCK`` bytes: a row of its documents, as numbers, and a row a bucket of its distinct units.

    A bucket's row holds the units of one hash value, sorted, parted by spaces (which no unit has); the
    documents' row says which place in all buckets' rows each number has. A unit of more than ``UNIT``
    characters is solved here, and its ids stay on the documents' row.
    """
    pattern, pairs = unit_pattern(pieces).pattern, neighbours(pieces)

    def run(batches):
        split = re.compile(pattern)
        part, serial, path = TaskContext.get().partitionId(), 0, None
        numbers, docs, ids, held = Numbers(), [], [], 0

        def flush():
            nonlocal path
            block = part * (1 << 20) + serial
            names = list(numbers)
            short = [u.encode() for u in names if len(u) <= UNIT]
            long = [u for u in names if len(u) > UNIT]
            if long:
                path = path or _long_path(pieces, kind)
            solved = [path(u) for u in long]
            is_long = np.fromiter((len(u) > UNIT for u in names), bool, len(names))
            spot, full, rows = bucketed(short, buckets)
            place = np.empty(len(names), np.int32)
            place[is_long] = len(short) + np.arange(len(long))
            place[~is_long] = spot
            own = np.array([i or 0 for i in ids], np.int64).view(np.int32)
            known = np.array([i is not None for i in ids])
            lens = np.array([len(d) for d in docs])
            tokens = np.concatenate(docs)
            far = np.array([i for x in solved for i in x], np.int64), np.array([len(x) for x in solved], np.int64)
            rows.append(squeezed(own, known, lens, tokens, place, *_spelled(*far, pieces)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(-1 - full, block), pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.binary())],
                names=["k", "block", "data"],
            )

        for batch in slices(batches, "text", BLOCK // 4):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = units(text or "", split)
                if any(len(u) > UNIT for u in found):
                    found = [x for u in found for x in (parted(u, pairs) if len(u) > UNIT else [u])]
                docs.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                ids.append(doc_id)
                held += len(text or "") + 1
            if held > BLOCK:
                yield from flush()
                serial += 1
                numbers, docs, ids, held = Numbers(), [], [], 0
        if docs:
            yield from flush()

    return run


# ---- the lattice ----


def lattice(words: DataFrame, pieces: Pieces, shortest: int = 1) -> DataFrame:
    """Edges ``k, unit, start, end, id, score``: all substrings of at least ``shortest`` characters that are pieces.

    Substrings of up to the longest piece's length are exploded and equi-joined to the piece table,
    which has a fixed size (the vocabulary), so it is broadcast and the units stay where they are. A
    character that is no piece itself gets an edge of its own: its negated code point, at the penalty.
    """
    spark = words.sparkSession
    table = spark.createDataFrame(pieces.rows, "id int, piece string, score double")
    n = F.char_length("unit")
    starts = words.select("k", "unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    last = F.least(n - F.col("start"), F.lit(pieces.longest))
    starts = starts.filter(last >= shortest)
    spans = starts.select("k", "unit", "start", F.explode(F.sequence(F.lit(shortest), last)).alias("len"))
    spans = spans.withColumn("piece", F.col("unit").substr(F.col("start") + 1, F.col("len")))
    edges = spans.join(F.broadcast(table), "piece", "left" if shortest == 1 else "inner")
    edges = edges.filter((F.col("len") == 1) | F.col("id").isNotNull())
    return edges.select(
        "k",
        "unit",
        "start",
        (F.col("start") + F.col("len")).alias("end"),
        F.coalesce("id", -F.ascii("piece")).alias("id"),
        F.coalesce("score", F.lit(pieces.unknown)).alias("score"),
    )


def _grouped(edges: DataFrame) -> DataFrame:
    gathered = F.sort_array(F.collect_list(F.struct("end", "start", "id", "score"))).alias("edges")
    return edges.groupBy("k", "unit").agg(gathered)


def best_paths(edges: DataFrame) -> DataFrame:
    """``k, unit, ids``: each unit's best path, by folding Viterbi over its edges in order of their ends.

    For models whose scores are log-probabilities (unigram). The fold's state is the best score and path
    to each position so far; of equal scores the longer last piece stays.
    """
    fold = """
      aggregate(edges, array(named_struct('score', 0D, 'ids', cast(array() AS array<int>))),
        (best, e) -> CASE
          WHEN size(best) <= e.end THEN concat(best, array(named_struct(
               'score', best[e.start].score + e.score, 'ids', array_append(best[e.start].ids, e.id))))
          WHEN best[e.start].score + e.score > best[e.end].score THEN concat(slice(best, 1, e.end), array(named_struct(
               'score', best[e.start].score + e.score, 'ids', array_append(best[e.start].ids, e.id))))
          ELSE best END,
        best -> element_at(best, -1).ids)
    """
    return _grouped(edges).select("k", "unit", F.expr(fold).alias("ids"))


def merged_paths(edges: DataFrame) -> DataFrame:
    """``k, unit, ids``: each unit's path by merges in order of score, folded over the same lattice.

    For models whose scores are ranks of merges (BPE), where sums of scores mean nothing. The fold's
    state is the bounds of the unit's symbols. Edges come by falling score, then by place: one that
    spans two neighbouring symbols merges them. A piece ranks after the pieces that it is merged from,
    so one pass meets every merge after its parts. Single characters need no edge: they come out as
    their negated code points.
    """
    step = """
      aggregate(sort_array(transform(edges, e -> named_struct('rank', -e.score, 'start', e.start, 'end', e.end))),
        sequence(0, char_length(unit)),
        (bounds, e) -> IF(coalesce(get(bounds, cast(array_position(bounds, e.start) AS int) + 1), -1) = e.end
                          AND array_contains(bounds, e.start),
                          filter(bounds, x -> x <= e.start OR x >= e.end), bounds))
    """
    ids = """
      transform(sequence(1, size(bounds) - 1), i -> IF(bounds[i] = bounds[i - 1] + 1, -ascii(substring(unit, bounds[i], 1)),
        element_at(filter(edges, e -> e.start = bounds[i - 1] AND e.end = bounds[i]), 1).id))
    """
    rows = _grouped(edges).select("k", "unit", "edges", F.expr(step).alias("bounds"))
    return rows.select("k", "unit", F.expr(ids).alias("ids"))


#: How a model's scores are read: log-probabilities to sum, or ranks of merges; and the shortest edge that matters.
FOLDS = {"unigram": (best_paths, 1), "bpe": (merged_paths, 2)}


# ---- back to documents ----


def _within(lens: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given lengths."""
    total = int(lens.sum())
    return np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)


def _spelled(ids: np.ndarray, lens: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Paths (one after another, and their lengths) with negated code points as the character's piece or its bytes."""
    ids = ids.copy()
    at = np.flatnonzero(ids < 0)
    known = np.fromiter((pieces.single.get(-c, 0) for c in ids[at].tolist()), np.int64, len(at))
    ids[at[known > 0]] = known[known > 0]
    odd = at[known == 0]
    if not odd.size:
        return ids, lens
    made = [[pieces.byte_ids[x] for x in chr(-c).encode()] for c in ids[odd].tolist()]
    more = np.array([len(m) for m in made])
    size = np.ones(len(ids), np.int64)
    size[odd] = more
    wide = np.repeat(ids, size)
    wide[np.repeat(np.cumsum(size)[odd] - more, more) + _within(more)] = [x for m in made for x in m]
    rows = np.searchsorted(np.cumsum(lens), odd, "right")
    return wide, lens + np.bincount(rows, more - 1, len(lens)).astype(lens.dtype)


def _returned(pieces: Pieces):
    """``k, bucket, data``: for each row of a bucket's units, their ids in the same order, addressed to its block."""

    def run(packs: pa.Table, paths: pa.Table) -> pa.Table:
        at = {u: i for i, u in enumerate(paths.column("unit").to_pylist())}
        lists = paths.column("ids").combine_chunks()
        ids, lens = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        # Units without any edge are single characters, or fall into single characters.
        own = [x.as_py().decode().split(" ") for x in packs.column("data")]
        lone = sorted({u for us in own for u in us if u not in at})
        at.update((u, paths.num_rows + i) for i, u in enumerate(lone))
        ids = np.concatenate([ids, np.array([-ord(c) for u in lone for c in u], np.int32)]).astype(np.int32)
        lens = np.concatenate([lens, np.array([len(u) for u in lone], np.int64)]).astype(np.int64)
        ids, lens = _spelled(ids, lens, pieces)
        begin, out = np.cumsum(lens) - lens, []
        for us in own:
            rows = np.fromiter(map(at.__getitem__, us), np.int64, len(us))
            out.append(squeezed(lens[rows], ids[np.repeat(begin[rows], lens[rows]) + _within(lens[rows])]))
        bucket = pa.compute.subtract(-1, packs.column("k"))
        return pa.table([packs.column("block"), bucket, pa.array(out, pa.binary())], names=["k", "bucket", "data"])

    return run


def _assembled(docs: pa.Table, paths: pa.Table) -> pa.Table:
    """Documents of one block with their ids, from its numbers and its units' paths."""
    own, known, lens, tokens, place, far, far_lens = unsqueezed(docs.column("data")[0].as_py())
    near = paths.sort_by("bucket").column("data").to_pylist()
    parts = [*(unsqueezed(x) for x in near), [far_lens, far]]
    size, flat = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    begin = (np.cumsum(size) - size)[place]
    size = size[place]
    ids, known = own.view(np.int64), known.astype(bool)
    ends = np.concatenate([[0], np.cumsum(lens)])
    out = []
    for a in range(0, len(lens), _ASSEMBLED):
        some = tokens[ends[a] : ends[min(len(lens), a + _ASSEMBLED)]]
        counts = size[some]
        of = np.concatenate([[0], np.cumsum(counts)])
        offsets = of[ends[a : a + _ASSEMBLED + 1] - ends[a]]
        at = np.repeat(begin[some], counts) + _within(counts)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[at], pa.int32()))
        rows = slice(a, a + _ASSEMBLED)
        out.append(pa.record_batch([pa.array(ids[rows], mask=~known[rows]), pa.array(lens[rows].astype(np.int64)), lists], names=["doc_id", "n_units", "ids"]))
    return pa.Table.from_batches(out)


def encode(docs: DataFrame, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """``doc_id, n_units, ids``: each row's whole text as piece ids, a space put before it, spaces as marks.

    Text falls into units that no piece crosses. One pass cuts the documents into blocks: their distinct
    units, in buckets by hash, and the documents themselves as numbers of units. One exchange deals
    buckets and blocks; its branches all read it. Where a bucket's units meet, each distinct one goes
    once through the lattice, whose grouping by unit and fold need no further exchange, and its path
    returns to every block that has it, compressed. A unit that every document holds is one of a block's
    units, so no key is hot.

    ``kind`` is the model file's kind (see ``FOLDS``); ids are those of the model's own library. Units of more than
    ``UNIT`` characters (text without spaces) part where no piece can cross; what has no such place is solved whole,
    outside the lattice, by the same merges from a heap. Characters that are no piece become bytes. Null and empty
    text: no ids. Null doc_id is kept. Repeated rows are each encoded. Empty table: no rows. Other columns are ignored.
    """
    pieces = load(model)
    # Each unit's edges are many times its own size, so its partitions are that much smaller.
    parts = SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    dealt = rows.mapInArrow(_blocks(pieces, BUCKETS * parts, kind), _BLOCK_DDL).repartition(parts, "k")
    # An outer explode has no filter of its own that could sink below the exchange.
    listed = F.explode_outer(F.when(F.col("k") < 0, F.split(F.col("data").cast("string"), " "))).alias("unit")
    words = dealt.select("k", "block", listed).groupBy("k", "unit").agg(F.max("block").alias("b")).filter("b >= 0 AND unit IS NOT NULL")
    fold, shortest = FOLDS[kind]
    paths = fold(lattice(words.select("k", "unit"), pieces, shortest)).withColumnRenamed("k", "of")
    found = (
        dealt.filter(stays(F.col("k") < 0)).groupBy("k").cogroup(paths.groupBy("of"))
        .applyInArrow(_returned(pieces), "k bigint, bucket bigint, data binary")
    )
    # A block's documents lie where the exchange put them; only paths travel once more.
    return dealt.filter(stays(F.col("k") >= 0)).groupBy("k").cogroup(found.groupBy("k")).applyInArrow(_assembled, "doc_id bigint, n_units bigint, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, ids, text`` of ``doc_id, ids``: the pieces' bytes, without the space put before them.

    No ids (or null): the empty text. Ids of control pieces give nothing; bytes that are no UTF-8 are replaced.
    """
    # One constant, which the optimizer folds into an array; pieces as hex, since single bytes are no strings.
    pieces = F.split(F.lit(",".join(x.hex() for x in load(model).decoded)), ",")
    raw = F.unhex(F.array_join(F.transform("ids", lambda i: F.get(pieces, i)), ""))
    text = F.make_valid_utf8(F.coalesce(raw, F.lit(b"")).cast("string"))
    rows = encoded.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>"))
    return rows.select("doc_id", "ids", text.alias("text")).withColumn("text", F.expr("IF(startswith(text, ' '), substring(text, 2), text)"))
