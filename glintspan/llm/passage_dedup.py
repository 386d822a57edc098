"""Substring dedup: paragraphs by MinHash banding, exact verification, removal by components.

Texts are cut into paragraphs where their words say so: a paragraph starts at a word whose hash is the least among
the MIN_WORDS - 1 words to either side, so that the same passage is cut alike wherever it stands and whatever
its stops, lines and neighbours are. Paragraphs have MIN_WORDS words or more, don't overlap (but for the first
and last of a text, which reach into their neighbours where they would be shorter), and hold every word of
a text that has so many. A longer gap than MOST_TIMES * MIN_WORDS words is cut evenly.

Each paragraph has BANDS keys of ROWS MinHash values of its five-word shingles: two of similarity s collide with
probability 1 - (1 - s ** ROWS) ** BANDS, 0.994 at 0.8, 0.86 at 0.57, 0.05 at 0.1. Colliding paragraphs
are compared exactly: with the most frequent one of their bucket, and those that this leaves in different
components with each other, in blocks of bounded size. Paragraphs of the same words have the same hash and are one.

A passage that documents share may hold no whole paragraph. So runs of EXACT_WORDS words are paragraphs too, with the
hash of all their words as their one key: one starts at the least hash of every WINDOW places that a text has, so
every run of EXACT_WORDS + WINDOW - 1 words (51) that documents share holds one of them whole in each. All but
the first document of a component of links lose theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import clusters
from ._spark import Bitmap, bitmap, discard, in_arrow, stage, unused, with_arrow
from ._words import Words, mix, runs, text_bytes

#: Words of the shortest banded paragraph, and how many times that is the longest.
MIN_WORDS, MOST_TIMES = 26, 4
BANDS, ROWS = 5, 2
#: Words of an exact run; of so many places in a row where one can start, one at least starts one.
EXACT_WORDS, WINDOW = 39, 13
_RUN = 500_000
_SEED = np.random.default_rng(77).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_BAND = np.random.default_rng(78).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_WORD = np.random.default_rng(79).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row, by running minima to both sides of every w-th place."""
    n = len(x)
    a = np.concatenate([x, np.full(-n % w, _NONE)]).reshape(-1, w)
    ahead = np.minimum.accumulate(a, 1).ravel()
    behind = np.minimum.accumulate(a[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


class Paragraphs:
    """The paragraphs of a run of texts: text number, first word and word after the last, and hash of the words; the first `banded` have a row of band keys each, the others are exact runs."""

    def __init__(self, words: Words, k: int = 5, *, min_words: int = MIN_WORDS, exact_words: int = EXACT_WORDS, window: int = WINDOW, bands: int = BANDS, rows: int = ROWS, exact: bool = True):
        w, n = words, len(words.hash)
        self.words, self.k, self.bands, self.rows = w, k, bands, rows
        self.shingle = np.zeros(0, np.uint64)
        self.first = self.after = np.zeros(0, np.int64)
        if n >= k:
            total = np.zeros(n - k + 1, np.uint64)
            for p in range(k):
                total += w.hash[p : n - k + 1 + p] * _SEED[p]
            self.shingle = mix(total)
        if n:
            # The order of words: a hash of each word and the next, and among equals the first.
            turn = w.hash * _SEED[10]
            turn[:-1] += w.hash[1:] * _SEED[11]
            low = np.uint64(n.bit_length())
            self.order = (mix(turn) >> low << low) | np.arange(n, dtype=np.uint64)
            self._cut(max(min_words, k))
        self.banded = len(self.first)
        if exact and n >= exact_words:
            at = self._starts(exact_words, window)
            self.first, self.after = np.concatenate([self.first, at]), np.concatenate([self.after, at + exact_words])
        self.text = w.text[self.first]
        self.hash = self._hashes()

    def _cut(self, least: int) -> None:
        """Paragraphs from each word that is first in order among its neighbours to the next such word."""
        text, n, r = self.words.text, len(self.order), least - 1
        fresh = np.ones(n, bool)
        fresh[1:] = text[1:] != text[:-1]
        apart = np.arange(n) + r * np.cumsum(fresh)  # a gap between texts: no word is a neighbour of another text's
        padded = np.full(int(apart[-1]) + r + 1, _NONE)
        padded[apart] = self.order
        starts = np.flatnonzero(fresh | (_least(padded, 2 * r + 1)[apart - r] == self.order))
        length = np.diff(np.append(starts, n))
        pieces = -(-length // (MOST_TIMES * least))
        each = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(starts, pieces) + each * np.repeat(length, pieces) // np.repeat(pieces, pieces)
        after = np.append(first[1:], n)
        begin, end = np.searchsorted(text, text[first]), np.searchsorted(text, text[first], "right")
        short = after - first < least
        after = np.where(short, np.minimum(np.maximum(after, first + least), end), after)
        first = np.where(after - first < least, np.maximum(after - least, begin), first)
        ok = after - first >= least
        self.first, self.after = first[ok], after[ok]

    def _starts(self, size: int, window: int) -> np.ndarray:
        """Where runs of `size` words start: the first in order of every `window` places in a row that a text has."""
        text = self.words.text
        places = len(text) - size + 1
        if places < window:
            return np.zeros(0, np.int64)
        last = np.arange(places - window + 1) + window - 1 + size - 1
        whole = text[: places - window + 1] == text[last]
        low = np.uint64((1 << len(text).bit_length()) - 1)
        return np.unique((_least(self.order[:places], window)[whole] & low).astype(np.int64))

    def _parts(self, at: np.ndarray, size: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of the paragraphs, and for each the rows of words or shingles from `at` on, their places, and where each paragraph starts among them."""
        for lo in range(0, len(at), 10_000):
            part = slice(lo, lo + 10_000)
            c = size[part]
            start = np.cumsum(c) - c
            place = np.arange(int(c.sum())) - np.repeat(start, c)
            yield part, np.repeat(at[part], c) + place, place, start

    def _hashes(self) -> np.ndarray:
        out, size = np.zeros(len(self.first), np.uint64), self.after - self.first
        for part, rows, place, start in self._parts(self.first, size):
            value = mix(self.words.hash[rows] + place.astype(np.uint64) * _SEED[6])
            out[part] = mix(np.add.reduceat(value * _WORD[place % 256], start) + size[part].astype(np.uint64))
        return out

    def keys(self, wanted: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The band keys of the banded paragraphs `wanted`."""
        first, size = self.first[: self.banded][wanted], (self.after - self.first)[: self.banded][wanted] - self.k + 1
        out = np.zeros((len(first), self.bands), np.uint64)
        for part, rows, _, start in self._parts(first, size):
            value = self.shingle[rows]
            for b in range(self.bands):
                key = np.full(len(start), _BAND[63 - b])
                for r in range(self.rows):
                    key = mix(key + np.minimum.reduceat(value * _BAND[b * self.rows + r], start) * _SEED[7])
                out[part, b] = key
        return out

    def sets(self, at: np.ndarray) -> list[bytes]:
        """The distinct shingles of each of the paragraphs `at`, in order."""
        out: list[bytes] = []
        for _, rows, _, start in self._parts(self.first[at], self.after[at] - self.first[at] - self.k + 1):
            owner = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(rows))))
            value = self.shingle[rows]
            value = value[np.lexsort((value, owner))]
            fresh = np.ones(len(owner), bool)
            fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
            value, cut = value[fresh], np.cumsum(np.bincount(owner[fresh], minlength=len(start)))
            out += [value[a:b].tobytes() for a, b in zip(np.append(0, cut[:-1]), cut, strict=True)]
        return out

    def spans(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the paragraphs `at`, in the run."""
        return self.words.begin[self.first[at]], self.words.end[self.after[at] - 1]


def _runs(it: Iterator[pa.RecordBatch], how: dict, exact: bool = True):
    for batch in it:
        data, at = text_bytes(batch.column("text"))
        for i, j in runs(at, _RUN):
            yield batch.column("doc").slice(i, j - i), at[i:j] - int(at[i]), Paragraphs(Words(data, at, i, j, apart=True), exact=exact, **how)


def _keys(how: dict):
    """(key, u, doc): of each paragraph its hash as the key, with the document; of each band its key, with the paragraph."""

    def run(it):
        for doc, _, p in _runs(it, how):
            own = pa.array(p.hash.view(np.int64))
            yield pa.RecordBatch.from_arrays([own, pa.nulls(len(own), pa.int64()), doc.take(pa.array(p.text))], names=["key", "u", "doc"])
            keys, u = p.keys(), p.hash[: p.banded]
            for b in range(p.bands):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, b]).view(np.int64)), pa.array(u.view(np.int64)), pa.nulls(p.banded, pa.int64())], names=["key", "u", "doc"])

    return run


def _candidates(how: dict, varied: Bitmap):
    """(key, u, n distinct shingles) of banded paragraphs under keys in `varied`, and (u, doc, s) of the paragraphs: their shingle sets."""

    def run(it):
        for doc, _, p in _runs(it, how, exact=False):
            keys = p.keys()
            hits = varied.has(np.ascontiguousarray(keys).ravel()).reshape(keys.shape)
            at = np.flatnonzero(hits.any(axis=1))
            sets = p.sets(at)
            kinds = np.zeros(p.banded, np.int32)
            kinds[at] = [len(x) // 8 for x in sets]
            for b in range(p.bands):
                keep = np.flatnonzero(hits[:, b])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[keep, b]).view(np.int64)), pa.array(p.hash[keep].view(np.int64)), pa.array(kinds[keep]), pa.nulls(len(keep), pa.int64()), pa.nulls(len(keep), pa.binary())], names=["key", "u", "n", "doc", "s"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(p.hash[at].view(np.int64)), pa.nulls(len(at), pa.int32()), doc.take(pa.array(p.text[at])), pa.array(sets, pa.binary())], names=["key", "u", "n", "doc", "s"])

    return run


def _occurrences(how: dict, known: Bitmap):
    """Where the paragraphs are whose hash is in `known`."""

    def run(it):
        for doc, base, p in _runs(it, how):
            at = np.flatnonzero(known.has(p.hash))
            text = p.text[at]
            begin, end = p.spans(at)
            yield pa.RecordBatch.from_arrays([pa.array(p.hash[at].view(np.int64)), doc.take(pa.array(text)), pa.array(begin - base[text]), pa.array(end - base[text]), pa.array(p.after[at] - p.first[at])], names=["u", "doc", "begin", "end", "n_words"])

    return run


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (4, 5), min_words: int = MIN_WORDS, exact_words: int = EXACT_WORDS, window: int = WINDOW, bands: int = BANDS, rows_a_band: int = ROWS) -> DataFrame:
    """One row per paragraph that different documents share: id, begin, end, n_words, class_id, first_id, removed.

    begin and end: its bytes in the text's UTF-8. class_id: of its component of links. first_id: the smallest
    id that has a paragraph of the class; `removed` in all others. Paragraphs of one document alone are never
    returned, so a repeat within a document stays. Words are runs of other characters than white space, and each
    character by itself in scripts without spaces. Texts of fewer than min_words words have no paragraphs, and
    runs of fewer than exact_words words are found only where whole paragraphs hold them. Null and empty
    texts have none. Rows with a null id take no part. Rows that repeat an id count as one document, and each
    gives its rows. Other columns aren't read, whatever their names. No rows in, none out.
    """
    num, den = threshold
    how = {"k": k, "min_words": min_words, "exact_words": exact_words, "window": window, "bands": bands, "rows": rows_a_band}
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    by_key = in_arrow(rows, _keys(how), "key long, u long, doc long").groupBy("key").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min("u").alias("u0"), F.max("u").alias("u1"))
    shared = stage(by_key.where("d0 != d1 or u0 != u1").select("key", "d0", (F.col("u0") != F.col("u1")).alias("varied")), "keys", heavy=True)
    varied = stage(shared.where("varied").select("key"), "varied")
    raw = stage(in_arrow(rows, _candidates(how, bitmap(varied, "key")), "key long, u long, n int, doc long, s binary"), "candidates")
    posts = raw.where("key is not null").groupBy("key", "u").agg(F.count("*").alias("times"), F.first("n").alias("n")).join(varied, "key", "left_semi")
    posts = stage(posts.select("key", "u", F.struct("times", "n").alias("w")), "posts", heavy=True)
    sets = stage(raw.where("s is not null").groupBy("u").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.first("s").alias("s")), "sets", heavy=True)
    discard(raw, varied)
    parts = clusters(posts, lambda _: sets, lambda x, y: den * F.least(x["n"], y["n"]) >= num * F.greatest(x["n"], y["n"]), num, den)
    discard(posts)
    # A class is a component of several paragraphs, or one paragraph of several documents.
    tied = sets.select("u", "d0", "d1").join(parts, F.col("u") == F.col("id"), "left").select("u", F.coalesce("component", "u").alias("class_id"), "d0", "d1")
    of = tied.groupBy("class_id").agg(F.min("d0").alias("first_id"), F.max("d1").alias("last")).where("first_id != last").select("class_id", "first_id")
    alone = shared.where("varied is null").join(sets.select(F.col("u").alias("key")), "key", "left_anti")
    classes = stage(tied.join(of, "class_id").select("u", "class_id", "first_id").unionByName(alone.select(F.col("key").alias("u"), F.col("key").alias("class_id"), F.col("d0").alias("first_id"))), "classes", heavy=True)
    discard(shared, sets)
    found = in_arrow(rows, _occurrences(how, bitmap(classes, "u")), "u long, doc long, begin long, end long, n_words long").join(classes, "u")
    return found.select(F.col("doc").alias(id_col), "begin", "end", "n_words", "class_id", "first_id", (F.col("doc") != F.col("first_id")).alias("removed"))


def without_passages(docs: DataFrame, passages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the removed passages cut out of their texts.

    Overlapping passages are cut as one. The white space left at the cut is one line break if a line
    ended there, else one space. A text that is all passages becomes empty. A row without removed passages
    is as it was, null and empty texts and null ids among them; rows that repeat an id are all cut alike, and must
    have the same text. Other columns stay, whatever their names. No rows in, none out.
    """
    doc, spans = unused(docs, "passage_doc"), unused(docs, "passage_spans")
    cuts = passages.where("removed").groupBy(F.col(id_col).cast("long").alias(doc)).agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias(spans))
    joined = docs.join(cuts, docs[id_col].cast("long") == F.col(doc), "left")

    def cut(batch):
        ranges = batch.column("r1")
        at, begin, end = ranges.offsets.to_numpy(), *(ranges.values.field(x).to_numpy() for x in ("begin", "end"))
        lists = ((begin[a:b].tolist(), end[a:b].tolist()) for a, b in zip(at, at[1:]))
        return [pa.array([t if t is None or not x[0] else cut_text(t, list(zip(*x))) for t, x in zip(batch.column("r0").to_pylist(), lists, strict=True)], pa.string())]

    out, fresh = docs.columns, unused(joined, "passage_cut")
    made = with_arrow(joined, cut, [F.col(text_col).cast("string"), F.coalesce(F.col(spans), F.array().cast("array<struct<begin:long,end:long>>"))], f"`{fresh}` string")
    return made.select(*[F.col(fresh).alias(c) if c == text_col else F.col(c) for c in out])


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the byte spans."""
    raw, out, at = text.encode(), [], 0
    merged: list[list[int]] = []
    for b, e in sorted(spans):
        if merged and not raw[merged[-1][1] : b].strip():
            merged[-1][1] = max(merged[-1][1], e)
        elif merged and b <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([b, e])
    for b, e in merged:
        out.append(raw[at:b])
        at = e
    out.append(raw[at:])
    parts = [x.decode("utf-8", "replace") for x in out]
    text = parts[0]
    for p in parts[1:]:
        gap = text[len(text.rstrip()) :] + p[: len(p) - len(p.lstrip())]
        text, p = text.rstrip(), p.lstrip()
        text = text + ("\n" if "\n" in gap else " ") + p if text and p else text + p
    return text
