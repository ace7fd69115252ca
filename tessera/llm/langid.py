"""Language ID: scripts narrow the candidates, Viterbi over per-word scores labels spans."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, held_out, slices, text_bytes

#: Bound of the training sample (documents of each language), and parts it is counted in.
PER_LANGUAGE, PARTS = 1500, 16
#: Rows of the sample's ids up to which they are broadcast.
BROADCAST = 100_000
#: Byte n-grams of a word, its ends marked, are counted in this many hash slots.
ORDERS, SLOTS = (1, 2, 3, 4), 1 << 15
#: Log-probability that a span's end costs; share of a language's letters that a script of it needs.
SWITCH, LEAST_SHARE = 8.0, 0.005
_CACHE = 400_000
#: First code points of script ranges, each up to the next. Fixed values of the Unicode block layout.
_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0x20000, "han"),
]
_STARTS = np.array([a for a, _ in _RANGES])
SCRIPTS = sorted({s for _, s in _RANGES})
_CODES = np.array([SCRIPTS.index(s) for _, s in _RANGES])


def script(char: str) -> int:
    """Number of the script whose range holds ``char``."""
    return int(_CODES[np.searchsorted(_STARTS, ord(char), "right") - 1])


def letters(raw: bytes) -> str:
    """The letters of a word, lower-cased."""
    word = raw.decode("utf-8", "replace").lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of all n-grams of the words, in order, and where each word's begin."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.repeat(np.cumsum(lens), lens)
    word = np.repeat(np.arange(len(words)), lens)
    slots, of = [], []
    h = np.zeros(len(data), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(data) - n + 1] * np.uint64(1_000_003) + data[n - 1 :] + np.uint64(n)
        inside = np.arange(len(h)) + n <= ends[: len(h)]
        if n in ORDERS:
            mixed = (h[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
            slots.append(mixed.astype(np.int64))
            of.append(word[: len(h)][inside])
    slots, of = np.concatenate(slots), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return slots[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))[:-1]])


def _counted(batches):
    found: dict[str, list] = {}
    for batch in slices(batches, "text", 4 << 20):
        for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch, "text"), strict=True):
            mine = found.setdefault(lang, [np.zeros(SLOTS, np.int64), np.zeros(len(SCRIPTS), np.int64)])
            words = [w for w in map(letters, (text or b"").split()) if w]
            if words:
                slots, _ = grams([w.encode() for w in words])
                mine[0] += np.bincount(slots, minlength=SLOTS)
                np.add.at(mine[1], [script(w[0]) for w in words], 1)
    rows = [{"lang": k, "slots": a.tobytes(), "scripts": b.tobytes()} for k, (a, b) in found.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("slots", pa.binary()), ("scripts", pa.binary())]))


class Model:
    """Languages, their n-gram log-probabilities (slot, language) and the scripts that they use."""

    def __init__(self, langs: list[str], logp: np.ndarray, uses: np.ndarray) -> None:
        self.langs, self.logp, self.uses = langs, logp, uses

    @classmethod
    def of(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> "Model":
        langs = sorted(counts)
        n = np.array([counts[x][0] for x in langs], np.float64).reshape(-1, SLOTS) + 0.5
        seen = np.array([counts[x][1] for x in langs], np.float64).reshape(-1, len(SCRIPTS))
        logp = np.log(n / n.sum(axis=1, keepdims=True)).T.astype(np.float32)
        return cls(langs, logp, seen >= LEAST_SHARE * np.maximum(seen.sum(axis=1, keepdims=True), 1))

    def words(self, words: list[str]) -> np.ndarray:
        """Score of each word in each language; words without a letter score 0 in all."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        some = [i for i, w in enumerate(words) if w]
        if some:
            slots, starts = grams([words[i].encode() for i in some])
            # n-grams of four orders tell each letter about four times over
            out[some] = np.add.reduceat(self.logp[slots], starts, axis=0) / len(ORDERS)
            allowed = self.uses[:, [script(words[i][0]) for i in some]].T
            out[some] -= np.where(allowed | ~allowed.any(axis=1, keepdims=True), 0, 1e4).astype(np.float32)
        return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Counts over a bounded sample: of each language the first ``per_language`` documents by a hash of doc_id."""
    labelled = docs.select("doc_id", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id")
    some = labelled.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language).drop("n")
    some = cut(some)
    # per_language rows a language; with very many languages the ids meet the texts in a shuffle instead.
    ids = F.broadcast(some) if some.count() <= BROADCAST else some
    sample = docs.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"]).select("lang", "text")
    rows = sample.repartition(PARTS).mapInArrow(_counted, _COUNTS)
    # Counts meet by language, PARTS rows each; one row a language is the model, which every task holds anyway.
    sums = rows.groupBy("lang").applyInArrow(_summed, _COUNTS).toArrow().to_pylist()
    return Model.of({r["lang"]: (np.frombuffer(r["slots"], np.int64), np.frombuffer(r["scripts"], np.int64)) for r in sums})


_COUNTS = "lang string, slots binary, scripts binary"


def _summed(table: pa.Table) -> pa.Table:
    sums = {c: sum(np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()).tobytes() for c in ("slots", "scripts")}
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()], pa.string())} | {c: pa.array([x], pa.binary()) for c, x in sums.items()})


def viterbi(scores: np.ndarray, starts: np.ndarray, lens: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word, all documents side by side: stepping to another label costs ``switch``."""
    n, k = scores.shape
    label = np.zeros(n, np.int16)
    if not n or k < 2:
        return label
    order = np.argsort(-lens, kind="stable")
    first, sizes = starts[order], lens[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    moved, source = np.zeros((n, k), bool), np.zeros(n, np.int16)
    value = np.zeros((len(order), k), np.float32)
    for t, a in enumerate(active):
        at, v = first[:a] + t, value[:a]
        best = v.argmax(axis=1)
        hop = v[np.arange(a), best] - switch
        if t:
            moved[at] = v < hop[:, None]
            source[at] = best
            v = np.maximum(v, hop[:, None])
        v = v + scores[at]
        value[:a] = v - v.max(axis=1, keepdims=True)
    state = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        label[at] = state[:a]
        state[:a] = np.where(moved[at, state[:a]], source[at], state[:a])
    return label


_DDL = "doc_id bigint, lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))


def labelled(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row's whole text.

    ``spans`` are runs of words of one label, from word ``first`` to ``last``; the prediction is the
    label of most letters, its score their share. ``und`` and 0 for texts without a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.uses))

    def run(batches):
        model = Model(*shared.value)
        names = pa.array(model.langs or ["und"])
        at_word: dict[bytes, int] = {}
        table, size = np.zeros((0, max(1, len(model.langs))), np.float32), np.zeros(0, np.int64)
        for batch in slices(batches, "text", 8 << 20):
            if len(at_word) > _CACHE:
                at_word, table, size = {}, table[:0], size[:0]
            texts = [(t or b"").split() for t in text_bytes(batch, "text")]
            new = [w for w in set().union(*texts) if w not in at_word]
            at_word.update((w, len(table) + i) for i, w in enumerate(new))
            bare = [letters(w) for w in new]
            if model.langs:
                table = np.concatenate([table, model.words(bare)])
            else:
                table = np.concatenate([table, np.zeros((len(new), 1), np.float32)])
            size = np.concatenate([size, np.fromiter(map(len, bare), np.int64, len(bare))])
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            starts = np.concatenate([[0], np.cumsum(lens)])
            word = np.fromiter((at_word[w] for t in texts for w in t), np.int64, starts[-1])
            label = viterbi(table[word], starts[:-1], lens, switch)
            doc = np.repeat(np.arange(len(texts)), lens)
            mass = np.bincount(doc * len(names) + label, size[word], len(texts) * len(names)).astype(np.float64).reshape(len(texts), -1)
            total, best = mass.sum(axis=1), mass.argmax(axis=1)
            known = (total > 0) & bool(model.langs)
            pred = np.where(known, np.array(names.to_pylist(), object)[best], "und")
            score = np.where(known, mass.max(axis=1) / np.maximum(total, 1), 0.0)
            new_span = np.ones(len(word), bool)
            new_span[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new_span)
            tail = np.append(head[1:], len(word)) - 1
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[head], minlength=len(texts)))])
            local = starts[:-1][doc[head]]
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(head - local, pa.int32()),
                    pa.array(tail - local, pa.int32()),
                    pa.DictionaryArray.from_arrays(pa.array(label[head], pa.int32()), names).cast(pa.string()),
                ],
                fields=list(_SPANS.value_type),
            )
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), spans],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _DDL)


def language_id(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` of every row of ``docs``, learned from its own labelled fold.

    lang, source and doc_id are no inputs of a prediction. Null text, empty text and text without a
    letter: ``und``, score 0. Rows without lang are predicted like others; without any labelled row all
    texts are ``und``. Repeated rows are each predicted; null doc_id gives a null held_out. Empty table: no rows.
    Other columns are ignored.
    """
    return labelled(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
