"""Toxicity with noisy-channel deobfuscation.

Words that look disguised - digits or signs for letters, letters spaced out or drawn out - become lattices of the
characters that they may stand for. Viterbi decoding under a character trigram model of the whole corpus finds the
most likely spelling, and the restored text is scored by a logistic model over its words and word starts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chars import CLASSES, Sequences, classes, gathered, packed
from ._spark import in_arrow, with_arrow
from ._words import mix, runs, text_bytes

#: What signs may stand for. Fixed values of this channel.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "€": "e", "+": "t"}
SEPARATORS = ".-_*/~ "
#: Nats that the channel asks for a sign read as a letter, a separator left out, a repeated letter left out, for a sign or separator kept as it is, a letter drawn out, and a space kept beside a piece of several letters.
SIGN, DROP, SQUEEZE, KEEP, DRAWN, BETWEEN = 0.5, 0.3, 0.6, 4.0, 2.5, 2.0
#: Features that are learned, at most, and how often and how much more often than in other texts they are in toxic ones.
FEATURES, LEAST_TEXTS, LEAST_RATIO = 4_096, 3, 3.0
#: Bytes of the word starts that are features besides the word.
STARTS = (4, 6, 8)
_RUN = 500_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET if ord(c) < 128]] = True
_APART = np.zeros(256, bool)
_APART[[ord(c) for c in SEPARATORS]] = True
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = np.random.default_rng(7).integers(1, 2**63, 257, dtype=np.uint64) | np.uint64(1)
#: Signs that end a sentence or close a quotation: at a word's end they are no letters.
_CLOSER = np.zeros(256, bool)
_CLOSER[[ord(c) for c in ".,;:!?\"')]}"]] = True
#: Longest run of one separator between two letters, and longest piece that joins a run of single letters.
APART, PIECE = 3, 2
_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=4_096)
def _kind(ch: str) -> int:
    return int(classes()[ord(ch)])


class Trigrams:
    """Log probabilities of a class after two others, interpolated over three orders."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        one = (c.sum((0, 1)) + 1) / (c.sum() + CLASSES)
        two = (c.sum(0) + 4 * one) / (c.sum(0).sum(-1, keepdims=True) + 4)
        self.cost = (-np.log((c + 4 * two[None]) / (c.sum(-1, keepdims=True) + 4))).tolist()

    def decode(self, token: str) -> str:
        """The most likely spelling of a disguised token, in time and memory linear in its length."""
        cost, token = self.cost, token.lower()
        # state: last two classes -> (nats, spelling as a chain of its last character and the rest)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        lengths = [n for m in re.finditer(r"(.)\1*", token, re.S) for n in [len(m[0])] * len(m[0])]
        for i, ch in enumerate(token):
            same = i > 0 and token[i - 1] == ch
            drawn = same and i > 1 and token[i - 2] == ch
            squeeze = SQUEEZE if lengths[i] > 2 else KEEP
            ways: list[tuple[str, int, float]] = []  # character, its class, nats; no character: it is left out
            if ch.isalpha():
                ways.append((ch, _kind(ch), DRAWN if drawn else 0.0))
                if same:
                    ways.append(("", 0, squeeze))
            elif ch in LEET:
                ways += [(x, _kind(x), SIGN) for x in LEET[ch]]
                ways.append((" ", 0, KEEP))
                if same:
                    ways.append(("", 0, squeeze))
            else:
                # A space beside a longer piece may well be one between words.
                wide = ch == " " and (token[max(i - 2, 0) : i].isalpha() and i > 1 or token[i + 1 : i + 3].isalpha() and i + 2 < len(token))
                ways += [("", 0, DROP), (" ", 0, BETWEEN if wide else KEEP)]
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (nats, said) in states.items():
                for x, c, extra in ways:
                    key, total = ((a, b), nats + extra) if not x else ((0, 0) if c == 0 else (b, c), nats + extra + cost[a][b][c])
                    if key not in new or total < new[key][0]:
                        new[key] = (total, (x, said) if x else said)
            states = new
        _, said = min(((nats + cost[a][b][0], said) for (a, b), (nats, said) in states.items()), key=lambda x: x[0])
        out = []
        while said is not None:
            out.append(said[0])
            said = said[1]
        return "".join(reversed(out))


class Spelled:
    """Words of texts i to j as letter runs, lower-cased, and the disguised tokens among them."""

    def __init__(self, data: np.ndarray, at: np.ndarray, i: int, j: int):
        lo, self.n = int(at[i]), j - i
        raw = data[lo : int(at[j])]
        self.at, self.raw = at[i : j + 1] - lo, raw
        low = raw.copy()
        low[(raw >= 65) & (raw <= 90)] += 32
        if len(raw) > 1:  # the capitals of Latin-1
            low[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)] += 32
        self.low = low
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.at] = True
        letter = _LETTER[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = letter[:-1], letter[1:]
        self.begin = np.flatnonzero(letter & (~before | edge[:-1]))
        self.end = np.flatnonzero(letter & (~after | edge[1:])) + 1
        self.text = np.searchsorted(self.at, self.begin, "right") - 1
        self.letter, self.edge = letter, edge

    def features(self, keep: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of each word of those to `keep`, and of each longer word's starts."""
        begin, size, owner = self.begin[keep], (self.end - self.begin)[keep], self.text[keep]
        if not len(size):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        start = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(start, size)
        value = mix(self.low[np.repeat(begin, size) + place].astype(np.uint64) * _PLACE[place % 256] + place.astype(np.uint64))
        words = mix(np.add.reduceat(value, start) + size.astype(np.uint64))
        text, found = [owner], [words]
        for n in sorted(STARTS, reverse=True):
            value[place >= n] = 0
            long = size >= n
            text.append(owner[long])
            found.append(mix(np.add.reduceat(value, start)[long] ^ _PLACE[256] + np.uint64(n)))
        return np.concatenate(text), np.concatenate(found)

    def _gaps(self) -> np.ndarray:
        """Whether one to APART equal separators are all that is between a letter run and the next."""
        ok = np.zeros(max(len(self.begin) - 1, 0), bool)
        gap, at = self.begin[1:] - self.end[:-1], self.end[:-1]
        for n in range(1, APART + 1):
            x = np.flatnonzero((gap == n) & (self.text[1:] == self.text[:-1]))
            same = _APART[self.raw[at[x]]]
            for k in range(1, n):
                same &= self.raw[at[x] + k] == self.raw[at[x]]
            ok[x] = same
        return ok

    def disguised(self) -> list[tuple[int, int, int]]:
        """(text number, begin, end) of what may be disguised: signs for letters, letters drawn out, or separated. Spans of a text don't overlap.

        Marked are tokens in which a sign that can be a letter is beside a letter or another such sign (but for the
        stops that end it), a letter comes three times in a row, or separators are between letters; and runs of three or
        more single letters that equal separators keep apart, with a short piece at either end.
        """
        raw, letter, n = self.low, self.letter, len(self.raw)
        if n < 3:
            return []
        space = _SPACES[raw]
        stops = np.flatnonzero(space | ~_CLOSER[raw])
        closer = np.flatnonzero(_CLOSER[raw])
        k = np.searchsorted(stops, closer)
        follows = stops[np.minimum(k, max(len(stops) - 1, 0))] if len(stops) else np.zeros(len(closer), np.int64)
        count = np.cumsum(self.edge)
        tail = np.zeros(n, bool)
        tail[closer] = (k == len(stops)) | (space[follows] if len(stops) else True) | (count[np.minimum(follows, n - 1)] != count[closer])
        sign = _SIGN[raw] & ~tail
        inner = ~self.edge[1:n]  # the two places are of one text
        spelled = letter | sign
        marks = [np.flatnonzero(spelled[:-1] & spelled[1:] & (sign[:-1] | sign[1:]) & inner)]
        marks.append(np.flatnonzero(letter[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] < 128)))
        gaps = self._gaps()
        tight = np.flatnonzero(gaps & ~space[self.end[:-1]]) if len(gaps) else np.zeros(0, np.int64)
        marks.append(self.end[:-1][tight] if len(tight) else tight)
        spans: list[tuple[int, int]] = []
        hits = np.unique(np.concatenate(marks))
        if len(hits):
            bounds = np.flatnonzero(space | self.edge[:-1])
            left, right = np.searchsorted(bounds, hits, "right") - 1, np.searchsorted(bounds, hits + 1)
            begin = np.where(left >= 0, bounds[np.maximum(left, 0)], 0) if len(bounds) else np.zeros(len(hits), np.int64)
            begin = begin + space[begin]
            end = np.where(right < len(bounds), bounds[np.minimum(right, len(bounds) - 1)], n) if len(bounds) else np.full(len(hits), n)
            letters = np.concatenate([[0], np.cumsum(letter)])
            some = letters[end] > letters[begin]
            spans += set(zip(begin[some].tolist(), end[some].tolist(), strict=True))
        size = self.end - self.begin
        single = size == 1
        pair = single[1:] & single[:-1] & gaps if len(gaps) else np.zeros(0, bool)
        if pair.any():
            starts, stops = np.flatnonzero(pair & ~np.append(False, pair[:-1])), np.flatnonzero(pair & ~np.append(pair[1:], False)) + 1
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                if b - a >= 2:
                    a -= bool(a and gaps[a - 1] and size[a - 1] <= PIECE)
                    b += bool(b < len(gaps) and gaps[b] and size[b + 1] <= PIECE)
                    spans.append((int(self.begin[a]), int(self.end[b])))
        out: list[tuple[int, int, int]] = []
        for b, e in sorted(spans, key=lambda x: (x[0], -x[1])):
            if out and b < out[-1][2]:
                out[-1] = (out[-1][0], out[-1][1], max(e, out[-1][2]))
            else:
                out.append((int(np.searchsorted(self.at, b, "right")) - 1, b, e))
        return out

    def token(self, begin: int, end: int) -> str:
        return self.raw[begin:end].tobytes().decode("utf-8", "replace")


def restored(model: Trigrams, token: str, known: dict[str, str]) -> str:
    if (said := known.get(token)) is None:
        if len(known) > 100_000:
            known.clear()
        said = known[token] = model.decode(token)
    return said


def _core(token: str) -> tuple[str, str]:
    """A token without the stops that close it, and those."""
    core = token.rstrip(".,;:!?\"')]}")
    return core, token[len(core) :]


def restore(model: Trigrams, text: str) -> str:
    """The text with its disguised spans respelled, and all else as it is."""
    raw = text.encode("utf-8", "replace")
    spelled = Spelled(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64), 0, 1)
    out, at = [], 0
    for _, b, e in spelled.disguised():
        core, rest = _core(spelled.token(b, e))
        out += [raw[at:b].decode("utf-8", "replace"), model.decode(core), rest]
        at = e
    return "".join([*out, raw[at:].decode("utf-8", "replace")])


def _hashed(model: Trigrams, known: dict[str, str], data, at, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of texts i to j as restored: words outside the disguised spans as they are, those inside as decoded."""
    spelled = Spelled(data, at, i, j)
    spans = spelled.disguised()
    cover = np.zeros(len(spelled.raw) + 1, np.int32)
    np.add.at(cover, [b for _, b, _ in spans], 1)
    np.add.at(cover, [e for _, _, e in spans], -1)
    text, value = spelled.features(np.cumsum(cover)[spelled.begin] == 0)
    found = [(t, w) for t, b, e in spans for w in _LETTERS.findall(restored(model, _core(spelled.token(b, e))[0], known))]
    if found:
        more, ends = text_bytes(pa.array([w for _, w in found], pa.string()))
        t, v = Spelled(more, ends, 0, len(found)).features()
        text, value = np.concatenate([text, np.array([t for t, _ in found], np.int64)[t]]), np.concatenate([value, v])
    return text, value


def _count_trigrams(it):
    counters = np.zeros(CLASSES**3, np.int64)
    for batch in it:
        data, at = text_bytes(batch.column("text"))
        for i, j in runs(at):
            counters += np.bincount(Sequences(data, at, i, j, 2).grams(3)[1], minlength=CLASSES**3)
    if (rows := packed(counters)) is not None:
        yield rows


def trigrams(docs: DataFrame, *, text_col: str = "text") -> Trigrams:
    """The character model of all texts of `docs`: 64**3 counts, whatever the input."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    return Trigrams(gathered(in_arrow(rows, _count_trigrams, "seg int, counts binary"), CLASSES**3))


@dataclass
class Scorer:
    """Sorted feature hashes with their weights, and the bias, in logits."""

    keys: np.ndarray
    weight: np.ndarray
    bias: float

    def hits(self, text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, feature number) of known features."""
        if not len(self.keys) or not len(value):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
        known = self.keys[at] == value
        pair = np.unique(text[known].astype(np.int64) * len(self.keys) + at[known])
        return pair // len(self.keys), pair % len(self.keys)

    def score(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(text, self.weight[feature], n), -40, 40)))


def fit(model: Trigrams, examples: DataFrame) -> Scorer:
    """A scorer from (text, y) rows, which are bounded by whoever drew them.

    Features are the words and word starts of restored texts that are in LEAST_TEXTS toxic ones or more and
    LEAST_RATIO times as often as in others; the FEATURES of most evidence are weighed by logistic
    regression.
    """
    shared = examples.sparkSession.sparkContext.broadcast(model)

    def each(it):
        known: dict[str, str] = {}
        for batch in it:
            y = batch.column("y").to_numpy()
            data, at = text_bytes(batch.column("text"))
            for i, j in runs(at, _RUN):
                text, value = _hashed(shared.value, known, data, at, i, j)
                order = np.lexsort((value, text))
                text, value = text[order], value[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(value[new].view(np.int64)), pa.array(y[i:j][text[new]].astype(np.int64))], names=["key", "y"])

    totals = examples.agg(F.sum("y").alias("bad"), F.count("*").alias("n")).first()
    bad, n = int(totals["bad"] or 0), int(totals["n"])
    rate = min(max(bad / n if n else 0.0, 1e-3), 1 - 1e-3)
    empty = Scorer(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))))
    if bad in (0, n):
        return empty
    counts = in_arrow(examples, each, "key long, y long").groupBy("key").agg(F.sum("y").alias("a"), F.count("*").alias("m")).where((F.col("a") >= LEAST_TEXTS) & (F.col("a") / bad >= LEAST_RATIO * (F.col("m") - F.col("a") + 0.5) / (n - bad)))
    evidence = F.col("a") * F.log((F.col("a") / bad) / ((F.col("m") - F.col("a") + 0.5) / (n - bad)))
    keys = np.sort(counts.orderBy(F.desc(evidence), "key").limit(FEATURES).select("key").toArrow().column("key").to_numpy().view(np.uint64))
    picked = examples.sparkSession.sparkContext.broadcast(Scorer(keys, np.zeros(len(keys)), 0.0))

    def hit(it):
        known: dict[str, str] = {}
        for batch in it:
            data, at = text_bytes(batch.column("text"))
            for i, j in runs(at, _RUN):
                text, feature = picked.value.hits(*_hashed(shared.value, known, data, at, i, j))
                cut = np.searchsorted(text, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(i, j - i), pa.array([feature[cut[t] : cut[t + 1]] for t in range(j - i)], pa.list_(pa.int64()))], names=["y", "f"])

    got = in_arrow(examples, hit, "y int, f array<long>").toArrow()
    rows = sorted(zip((tuple(x) for x in got.column("f").to_pylist()), got.column("y").to_pylist(), strict=True))
    y = np.array([b for _, b in rows], np.float64)
    text, feature = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows]), np.array([x for f, _ in rows for x in f], np.int64)
    return _regress(keys, text, feature, y, empty.bias)


def _regress(keys: np.ndarray, text: np.ndarray, feature: np.ndarray, y: np.ndarray, bias: float) -> Scorer:
    """Logistic regression with a small ridge, by full gradients with momentum and per-weight step sizes."""
    n, w, b = len(y), np.zeros(len(keys)), bias
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for step in range(1, 401):
        z = b + np.bincount(text, w[feature], n)
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        grad = np.append(np.bincount(feature, g[text], len(keys)) + 1e-5 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        delta = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - delta[:-1], b - delta[-1]
    return Scorer(keys, w, float(b))


def score(docs: DataFrame, model: Trigrams, scorer: Scorer, *, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """`docs` with `out_col`: the probability, from 0 to 1, that the restored text is toxic.

    A null text is as an empty one, which has the bias alone. Each row gives one row, repeated rows the same score. Only the
    text is read; a column named `out_col` is replaced, others stay. No rows in, none out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, scorer))

    def of(batch):
        lm, sc = shared.value
        known: dict[str, str] = {}
        data, at = text_bytes(batch.column("r0"))
        out = [sc.score(*sc.hits(*_hashed(lm, known, data, at, i, j)), j - i) for i, j in runs(at, _RUN)]
        return [pa.array(np.concatenate([np.zeros(0), *out]))]

    return with_arrow(docs, of, [F.coalesce(F.col(text_col).cast("string"), F.lit(""))], f"`{out_col}` double")


def restore_column(docs: DataFrame, model: Trigrams, *, text_col: str = "text", out_col: str = "restored") -> DataFrame:
    """`docs` with `out_col`: the text with its disguised spans respelled; null stays null, and empty empty. Each row gives one row; a column named `out_col` is replaced, others stay. No rows in, none out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_arrow(docs, lambda batch: [pa.array([None if t is None else restore(shared.value, t) for t in batch.column("r0").to_pylist()], pa.string())], [F.col(text_col).cast("string")], f"`{out_col}` string")
