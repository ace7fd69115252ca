"""Blocks of documents as numbers of their distinct words, and those words in buckets by hash.

A task cuts its documents into blocks. A block's distinct words go to buckets, where the words of all blocks
meet; what is found out about a word returns to each block that has it, in the order of the bucket's row.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text bytes of a block.
BLOCK = 8 << 20
#: Partitions for each one that the session's shuffles have, and buckets for each partition, so that a hash deals them evenly.
SPREAD, BUCKETS = 4, 4


class Numbers(dict):
    """A number for each key, in order of appearance."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n


def bucketed(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Each word's place in all buckets' rows, the buckets that have words, and their rows: sorted words, parted by spaces."""
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = order[np.argsort(bucket[order], kind="stable")]
    place = np.empty(len(words), np.int32)
    place[order] = np.arange(len(words))
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(edges))
    return place, full, [b" ".join([words[j] for j in order[edges[b] : edges[b + 1]]]) for b in full]


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers, compressed: low bytes first, then the next, as high bytes are mostly alike."""
    sizes = np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()
    raw = sizes + b"".join(np.ascontiguousarray(a, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unsqueezed(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd", 1).decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    many = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 * (1 + many)
    for n in np.frombuffer(raw, np.int64, many, 8).tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view(np.int32).ravel())
        at += 4 * n
    return out


def stays(condition: Column) -> Column:
    """``condition``, tied to a row number so that the optimizer leaves it above the exchange that its branches share."""
    return F.when(F.monotonically_increasing_id() >= 0, condition)
