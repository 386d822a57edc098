"""Language identification by interpolated Kneser-Ney character models, one for each language.

The models are sorted arrays of n-gram hashes over 64 character classes, with the log probabilities of all
languages side by side, so that one binary search a character serves every language. The language of the
lowest cross-entropy a character is chosen; a text whose cross-entropy is far above what its language's
training texts have is rejected.
"""

from __future__ import annotations

import collections
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chars import Sequences
from ._spark import in_arrow, with_arrow
from ._words import runs, text_bytes

ORDER = 4
#: Discount of each order's counts.
DISCOUNT = 0.75
#: Scales of the scores to choose from. Log likelihoods, of LEAST_LOG at least, are added up in whole steps: their sums are the same in any order.
SCALES, LEAST_LOG, LOG_STEPS = np.geomspace(0.5, 64, 43), np.log(1e-12), 1 << 20
#: A language's usual cross-entropy is the least that all but one in UNUSUAL of its texts don't exceed, rounded up to a step (so many a nat); of fewer texts, the largest.
UNUSUAL, STEPS = 1_000, 1_000
#: A text is rejected above its language's usual cross-entropy and this many nats, if it has so many letters.
REJECT_MARGIN, REJECT_LETTERS = 0.7, 24
#: Stands for the usual cross-entropy of a language that has no text of so many letters.
UNCALIBRATED = 4.0
UNKNOWN = "und"


@dataclass
class Models:
    """langs; for each order the sorted hashes of n-grams and contexts, with rows of log probabilities and log weights."""

    langs: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)
    scale: float = 1.0
    limit: np.ndarray | None = None

    def log_probs(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each n-gram's last character after the others: (n, languages)."""
        keys = self.grams[order - 1]
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        out = self.logp[order - 1][at]
        miss = np.flatnonzero(keys[at] != code)
        if len(miss):
            if order == 1:
                out[miss] = -np.log(64.0)
            else:
                short = code[miss]
                lower = self.log_probs(short & np.uint32((1 << 6 * (order - 1)) - 1), order - 1)
                known = self.contexts[order - 1]
                ctx = short >> np.uint32(6)
                pos = np.minimum(np.searchsorted(known, ctx), len(known) - 1)
                hit = known[pos] == ctx
                lower[hit] += self.weight[order - 1][pos[hit]]
                out[miss] = lower
        return out

    def entropies(self, seqs: Sequences) -> np.ndarray:
        """Cross-entropy in nats a character of each text under each language."""
        _, code = seqs.grams(ORDER)
        start = np.cumsum(seqs.length) - seqs.length
        return -np.add.reduceat(self.log_probs(code).astype(np.float64), start, axis=0) / seqs.length[:, None]


def train(langs: Sequence[str], lang: np.ndarray, code: np.ndarray, count: np.ndarray) -> Models:
    """Models from the counts of ORDER-grams: lang (index), code, count. Lower orders count the distinct characters before them."""
    m = Models(list(langs))
    n_lang = len(langs)
    per_order: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(lang, code.astype(np.uint32), count.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):
        up_lang, up_code, _ = per_order[0]
        key, n = np.unique(up_lang.astype(np.uint64) << np.uint64(32) | (up_code & np.uint32((1 << 6 * order) - 1)).astype(np.uint64), return_counts=True)
        per_order.insert(0, ((key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), n.astype(np.float64)))
    for order, (lg, cd, ct) in enumerate(per_order, 1):
        grams, ctx = np.unique(cd), np.unique(cd >> np.uint32(6))
        at, c_at = np.searchsorted(grams, cd), np.searchsorted(ctx, cd >> np.uint32(6))
        raw, total, kinds = np.zeros((len(grams), n_lang)), np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
        np.add.at(raw, (at, lg), ct)
        np.add.at(total, (c_at, lg), ct)
        np.add.at(kinds, (c_at, lg), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, DISCOUNT * kinds / total, 1.0)
        lower = np.full((len(grams), n_lang), 1 / 64) if order == 1 else np.exp(m.log_probs(grams & np.uint32((1 << 6 * (order - 1)) - 1), order - 1).astype(np.float64))
        of = np.searchsorted(ctx, grams >> np.uint32(6))
        p = np.maximum(raw - DISCOUNT, 0) / np.maximum(total[of], 1e-300) + weight[of] * lower
        m.grams.append(grams)
        m.logp.append(np.log(p).astype(np.float32))
        m.contexts.append(ctx)
        m.weight.append(np.log(weight).astype(np.float32))
    return m


def _gram_counts(it):
    """(lang, code, n) for the texts of each batch."""
    for batch in it:
        names, lang = np.unique(batch.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        data, at = text_bytes(batch.column("text"))
        for i, j in runs(at):
            text, code = Sequences(data, at, i, j, ORDER - 1).grams(ORDER)
            key, n = np.unique(lang[i:j][text].astype(np.uint64) << np.uint64(32) | code.astype(np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names[(key >> np.uint64(32)).astype(np.int64)], pa.string()), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])


def fit(examples: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Models | None:
    """Models of all rows of `examples` that have a text and a language; None if there are none.

    N-grams of all texts are counted; each language has at most 64**4 of them, and written languages have
    some hundred thousand, which is what reaches the driver. Scores and rejection are calibrated on all texts.
    """
    rows = examples.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = in_arrow(rows, _gram_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    langs, lang = np.unique(counts.column("lang").to_numpy().astype(str), return_inverse=True)
    models = train(langs.tolist(), lang, counts.column("code").to_numpy(), counts.column("n").to_numpy())
    calibrate(models, rows)
    return models


def calibrate(models: Models, rows: DataFrame) -> None:
    """Fit the scale of the scores by the likelihood of all `rows`, and count each language's usual cross-entropy over them.

    What reaches the driver is a sum for each scale and the counts of each language's steps of cross-entropy.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)
    got = in_arrow(rows, _calibration(shared), "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    k, at, n = (got.column(c).to_numpy() for c in ("k", "at", "n"))
    if len(k):
        likelihood = np.zeros(len(SCALES), np.int64)
        likelihood[at[k < 0]] = n[k < 0]
        models.scale = float(SCALES[likelihood.argmax()])
    models.limit = np.array([_usual(at[k == i], n[k == i]) + REJECT_MARGIN for i in range(len(models.langs))])


def _usual(at: np.ndarray, n: np.ndarray) -> float:
    """The cross-entropy that all but one in UNUSUAL of n texts at each step don't exceed."""
    if not len(at):
        return UNCALIBRATED
    order = np.argsort(at)
    below = np.cumsum(n[order])
    return float(at[order][np.searchsorted(below, below[-1] - below[-1] // UNUSUAL)] / STEPS)


def _calibration(shared):
    """(k, at, n): for k -1 the log likelihood of a task's texts at each scale, for a language k the number of its texts at each step."""

    def run(it):
        likelihood, steps, some = np.zeros(len(SCALES), np.int64), collections.Counter(), False
        for batch in it:
            m = shared.value
            truth = np.searchsorted(m.langs, batch.column("lang").to_numpy(zero_copy_only=False).astype(str))
            data, at = text_bytes(batch.column("text"))
            for i, j in runs(at):
                s = Sequences(data, at, i, j, ORDER - 1)
                ok = np.flatnonzero(s.letters > 0)
                h, lang, letters = m.entropies(s)[ok], truth[i:j][ok], s.letters[ok]
                own = h[np.arange(len(h)), lang]
                some |= len(ok) > 0
                for x, scale in enumerate(SCALES):
                    with np.errstate(over="ignore"):
                        logp = -np.log(np.exp(scale * (own[:, None] - h)).sum(axis=1))
                    likelihood[x] += np.rint(np.maximum(logp, LEAST_LOG) * LOG_STEPS).astype(np.int64).sum()
                long = letters >= REJECT_LETTERS
                key, n = np.unique(lang[long] << 32 | np.ceil(own[long] * STEPS).astype(np.int64), return_counts=True)
                steps.update(dict(zip(key.tolist(), n.tolist(), strict=True)))
        if some:
            key = np.fromiter(steps, np.int64, len(steps))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(SCALES), -1), key >> 32]), pa.int32()), pa.array(np.concatenate([np.arange(len(SCALES)), key & 0xFFFFFFFF])), pa.array(np.concatenate([likelihood, np.fromiter(steps.values(), np.int64, len(steps))]))], names=["k", "at", "n"])

    return run


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, models: Models | None, *, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, lang_score, lang_entropy and lang_rejected.

    lang_pred: the language of the lowest cross-entropy, ties to the first in order; `und` for a text that is
    null or has no letter, or if nothing was learned. lang_score: its share in (0, 1] after calibration; 0 for
    `und`. lang_entropy: nats a character (null for `und`). lang_rejected: `und`, or the cross-entropy is above
    the calibrated limit. Columns of `docs` of these names are replaced; each row gives one row.
    """
    if models is None:
        return docs.drop("lang_pred", "lang_score", "lang_entropy", "lang_rejected").select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(None).cast("double").alias("lang_entropy"), F.lit(True).alias("lang_rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def predict(batch):
        m = shared.value
        data, at = text_bytes(batch.column("r0"))
        out: list[list[np.ndarray]] = [[np.zeros(0, object)], [np.zeros(0)], [np.zeros(0)], [np.zeros(0, bool)]]
        for i, j in runs(at):
            s = Sequences(data, at, i, j, ORDER - 1)
            h = m.entropies(s)
            best = h.argmin(axis=1)
            rows = np.arange(j - i)
            low, some = h[rows, best], s.letters > 0
            rejected = ~some | ((low > m.limit[best]) & (s.letters >= REJECT_LETTERS))
            for x, y in zip(out, (np.where(some, np.array(m.langs, object)[best], UNKNOWN), np.where(some, _softmax(-m.scale * h)[rows, best], 0.0), np.where(some, low, np.nan), rejected), strict=True):
                x.append(y)
        pred, score, entropy, rejected = (np.concatenate(x) for x in out)
        return [pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(rejected, pa.bool_())]

    return with_arrow(docs, predict, [F.col(text_col).cast("string")], "lang_pred string, lang_score double, lang_entropy double, lang_rejected boolean")
