"""Characters as 64 classes, n-grams of them, and counters that are added up across partitions."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import in_arrow

#: Class 0 is every character that is no letter; a-z are 1 to 26; other letters share 27 to 62 by code point.
CLASSES, OTHERS = 64, 36
_SEG = 1 << 14


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point, capital letters as small ones."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            x = ord(c.lower()[0])
            out[i] = x - 96 if 97 <= x <= 122 else 27 + x % OTHERS
    return out


class Sequences:
    """Class sequences of texts i to j of a string column's bytes, each led by `pad` zeros and closed by one; runs of zeros are one."""

    def __init__(self, data: np.ndarray, at: np.ndarray, i: int, j: int, pad: int):
        lo, n = int(at[i]), j - i
        raw = data[lo : int(at[j])]
        lead = (raw & 0xC0) != 0x80
        char_at = np.concatenate([[0], np.cumsum(lead)])[at[i : j + 1] - lo]
        c = classes()[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")]
        size = np.diff(char_at)
        before = np.ones(len(c), np.uint8)
        before[1:] = c[:-1]
        starts = char_at[:-1][size > 0]
        before[starts] = 0
        keep = (c != 0) | (before != 0)
        kept = np.concatenate([[0], np.cumsum(keep)])[char_at]
        self.letters = np.diff(np.concatenate([[0], np.cumsum(c != 0)])[char_at])
        length = np.diff(kept) + 1  # with the closing zero
        self.begin = np.cumsum(length + pad) - length  # of each text's first character
        self.end = self.begin + length
        self.seq = np.zeros(int(self.end[-1]) if n else 0, np.uint8)
        text = np.repeat(np.arange(n), length - 1)
        self.seq[np.arange(len(text)) + (self.begin - (np.cumsum(length - 1) - (length - 1)))[text]] = c[keep]
        self.pad, self.length = pad, length

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Text number and code of the n-gram that ends at each character."""
        code = self.seq.astype(np.uint32)
        out = code.copy()
        for k in range(1, order):
            out[k:] |= code[:-k] << np.uint32(6 * k)
        valid = np.ones(len(out), bool)
        for k in range(1, self.pad + 1):
            valid[self.begin - k] = False
        return np.repeat(np.arange(len(self.length)), self.length), out[valid]


def packed(counters: np.ndarray) -> pa.RecordBatch | None:
    """Counters as rows (seg, counts) of compressed segments without those that are zero."""
    parts = [(s, counters[s * _SEG : (s + 1) * _SEG]) for s in range(-(-len(counters) // _SEG))]
    parts = [(s, zlib.compress(x.astype(np.int64).tobytes(), 1)) for s, x in parts if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["seg", "counts"]) if parts else None


def _add_up(it):
    """One row for each segment of the rows that a task reads, whichever their order and number."""
    total: dict[int, np.ndarray] = {}
    for batch in it:
        for seg, x in zip(batch.column("seg").to_pylist(), batch.column("counts"), strict=True):
            x = np.frombuffer(zlib.decompress(x.as_buffer()), np.int64)
            if seg in total:
                total[seg] += x
            else:
                total[seg] = x.copy()
    for seg, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names=["seg", "counts"])


def gathered(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all partitions' counters: `size` numbers on the driver, whatever the input.

    Added up in two steps, by segment and a part of the partitions and then by segment, in streams: no task reads a
    segment's rows of all partitions, nor holds more than the sums.
    """
    out = np.zeros(size, np.int64)
    shape, tasks = "seg int, counts binary", max(1, min(64, -(-size // _SEG)))
    parts = in_arrow(rows.withColumn("of", F.spark_partition_id() % 64).repartition("seg", "of").select("seg", "counts"), _add_up, shape)
    for r in in_arrow(parts.repartition(tasks, "seg"), _add_up, shape).toLocalIterator():
        x = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
        out[r["seg"] * _SEG : r["seg"] * _SEG + len(x)] += x
    return out
