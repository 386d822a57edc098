"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import in_arrow, with_arrow

#: Labelled rows that are learned from, at most: those of the least hashes of their ids.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_WEIGHT = 120, 4, 64, 0.1, 1.0, 2.0

FEATURES = ("log_bytes", "log_words", "letters", "upper", "digits", "space", "newline", "stops", "commas", "marks", "high", "word_mean", "word_sd", "word_max", "short_words", "upper_words", "distinct_words", "distinct_pairs", "top_word", "repeats", "line_words", "distinct_lines", "top_line", "byte_entropy", "stops_per_word", "marks_per_word")
_IS = {name: np.array([f(c) for c in range(256)]) for name, f in {"upper": lambda c: 65 <= c <= 90, "lower": lambda c: 97 <= c <= 122, "digit": lambda c: 48 <= c <= 57, "space": lambda c: c == 32, "high": lambda c: c >= 128, "mark": lambda c: 33 <= c <= 126 and not chr(c).isalnum() and chr(c) not in ".,"}.items()}


def statistics(text: str) -> list[float]:
    """FEATURES of a text; all 0 for an empty or blank one but its bytes and white space."""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n = int(raw.sum())
    if not n:
        return [0.0] * len(FEATURES)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    upper, lower, digits, space, high, marks = (float(raw[_IS[k]].sum()) for k in ("upper", "lower", "digit", "space", "high", "mark"))
    p = raw[raw > 0] / n
    stops = float(raw[46] + raw[33] + raw[63])
    head = [np.log1p(n), np.log1p(len(words)), (upper + lower + high) / n, upper / max(1.0, upper + lower), digits / n, space / n, raw[10] / n, stops / n, raw[44] / n, marks / n, high / n]
    if not words:
        return [*head, *[0.0] * 12, float(-(p * np.log(p)).sum()), 0.0, 0.0]
    m, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
    return [
        *head, size.mean(), size.std(), np.log1p(size.max()), (size <= 3).mean(), sum(map(str.isupper, words)) / m, len(set(words)) / m, len(set(zip(words, words[1:]))) / m, Counter(words).most_common(1)[0][1] / m,
        sum(map(eq, words, words[1:])) / m, m / len(lines), len(set(lines)) / len(lines), Counter(lines).most_common(1)[0][1] / len(lines), float(-(p * np.log(p)).sum()), stops / m, marks / m,
    ]


@dataclass
class Forest:
    """Complete trees as arrays (tree, node): the children of node i are 2i + 1 and 2i + 2; `value` of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, all trees at once."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
        z = self.base + self.value[tree, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-z))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost TREES trees on the logistic loss; splits are sought over BINS quantile bins of each feature."""
    n, k = x.shape
    rate = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(k)]
    bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    inner = 2**DEPTH - 1
    feature, cut, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, 2**DEPTH))
    z = np.full(n, base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-6)
            pick = [(0, np.inf, BINS)] * width
            for f in range(k):
                at = node * BINS + bins[:, f]
                gs = np.bincount(at, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(at, h, width * BINS).reshape(width, BINS).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = 0
                gain[:, len(cuts[f]) :] = 0
                b = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(width), b] > best):
                    best[i] = gain[i, b[i]]
                    pick[i] = (f, cuts[f][b[i]], b[i])
            for i, (f, c, _) in enumerate(pick):
                feature[t, first + i], cut[t, first + i] = f, c
            chosen = np.array([f for f, _, _ in pick])[node]
            node = 2 * node + (bins[np.arange(n), chosen] > np.array([b for _, _, b in pick])[node])
        value[t] = -RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + L2)
        z += value[t][node]
    return Forest(feature, cut, value, base)


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([statistics(t.as_py() or "") for t in batch.column("text")], np.float64).reshape(-1, len(FEATURES))


def labelled(docs: DataFrame, labels: DataFrame, label: str, *, usable: Column | None = None, most: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most `most` labelled ids: those of the least hashes among the ids for which `usable` holds.

    An id with several labels has the more frequent one, 1 if they tie. The ids that are sent to all tasks are
    bounded by `most`. Labels or ids that are null are left out.
    """
    rows = labels.where(usable) if usable is not None else labels
    rows = rows.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(rows), "_id").select("text", "y")


def fit(examples: DataFrame) -> Forest:
    """A forest from (text, y) rows, which are bounded by whoever drew them; it is grown on the driver."""

    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(_features(batch)), pa.list_(pa.float64()))], names=["y", "x"])

    got = in_arrow(examples, run, "y int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # the same rows give the same forest, however they came
    return grow(x[order], y[order])


def score(docs: DataFrame, forest: Forest, *, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """`docs` with `out_col`: the probability, from 0 to 1, that a text is of label 1.

    Null is as empty, which has a score as well. Each row gives one row, repeated rows the same score. Only the text is
    read; a column named `out_col` is replaced, others stay. No rows in, none out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def of(batch):
        x = np.array([statistics(t) for t in batch.column("r0").to_pylist()], np.float64).reshape(-1, len(FEATURES))
        return [pa.array(shared.value.score(x))]

    return with_arrow(docs, of, [F.coalesce(F.col(text_col).cast("string"), F.lit(""))], f"`{out_col}` double")
