"""Words and their hashes, for many texts at once: numpy over the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in runs of about this many bytes, so that the arrays of a run stay within some tens of MB.
RUN_BYTES = 1_000_000

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 256), _STEP, np.uint64)
        more[0] = 1
        _POWERS = np.cumprod(more, dtype=np.uint64)
    return _POWERS


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def runs(at: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text is a range by itself."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def unspaced(raw: np.ndarray) -> np.ndarray:
    """Where a character starts that is of three bytes and of a script without spaces between words: Han, kana, Thai, Lao, Burmese, Khmer."""
    after = np.zeros(len(raw), np.uint8)
    after[:-1] = raw[1:]
    wide = (raw >= 0xE3) & (raw <= 0xE9)
    wide |= (raw == 0xE0) & (after >= 0xB8) & (after <= 0xBB)
    return wide | (raw == 0xE1) & (((after >= 0x80) & (after <= 0x82)) | ((after >= 0x9E) & (after <= 0x9F)))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of texts i to j: hash (A-Z lower-cased), text number from 0, and byte span in the buffer.

    With `apart`, each character of a script without spaces is a word by itself.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, i: int, j: int, apart: bool = False):
        lo, hi = int(at[i]), int(at[j])
        raw = data[lo:hi]
        self.n_texts, self.base = j - i, lo
        word = ~_SPACE[raw]
        fresh = np.zeros(len(raw) + 1, bool)
        fresh[at[i : j + 1] - lo] = True
        if apart and len(alone := np.flatnonzero(unspaced(raw))):
            fresh[alone] = True
            fresh[np.minimum(alone + 3, len(raw))] = True
        before = np.empty(len(raw), bool)
        before[:1] = False
        before[1:] = word[:-1]
        first = word & (~before | fresh[:-1])
        after = np.zeros(len(raw), bool)
        after[:-1] = word[1:]
        last = word & (~after | fresh[1:])
        self.begin = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        size = self.end - self.begin
        if len(size):
            place = np.arange(int(size.sum()), dtype=np.int64)
            start = np.cumsum(size) - size
            place -= np.repeat(start, size)
            value = _BYTE[_LOWER[raw[word]]]
            value *= _powers(int(size.max()))[place]
            self.hash = mix(np.add.reduceat(value, start) + size.astype(np.uint64) * _PLACE[63])
        else:
            self.hash = np.zeros(0, np.uint64)
        self.text = np.searchsorted(at[i : j + 1] - lo, self.begin, "right") - 1
        self.raw = raw

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of each run of k words; a shorter text that has words gives its whole sequence as one."""
        h, n = self.hash, len(self.hash)
        if n >= k:
            total = np.zeros(n - k + 1, np.uint64)
            for p in range(k):
                total += h[p : n - k + 1 + p] * _PLACE[p]
            whole = self.text[: n - k + 1] == self.text[k - 1 :]
            text, value = self.text[: n - k + 1][whole], mix(total[whole])
        else:
            text, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        count = np.bincount(self.text, minlength=self.n_texts)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            start = np.searchsorted(self.text, short)
            rest = [mix((h[s : s + c] * _PLACE[:c]).sum(dtype=np.uint64, keepdims=True) + tail)[0] for s, c, tail in zip(start, count[short], count[short].astype(np.uint64) * _PLACE[62], strict=True)]
            text, value = np.concatenate([text, short]), np.concatenate([value, np.array(rest, np.uint64)])
        return text, value

    def shingle_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of each text, ordered by text and then by hash."""
        text, value = self.shingles(k)
        order = np.lexsort((value, text))
        text, value = text[order], value[order]
        if len(text):
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
            text, value = text[new], value[new]
        return text, value


def set_hash(text: np.ndarray, value: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit hash of each text's set, from rows ordered by text."""
    size = np.bincount(text, minlength=n_texts).astype(np.int64)
    total = np.zeros(n_texts, np.uint64)
    if len(text):
        some = np.flatnonzero(size)
        total[some] = np.add.reduceat(mix(value * _PLACE[61]), np.cumsum(size[some]) - size[some])
    return size, mix(total + size.astype(np.uint64) * _PLACE[60])
