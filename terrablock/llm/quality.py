"""Operator 10: quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled text is every document. Labels of quality 0 are not
used. The class prior is estimated from positives and unlabelled text alone: a first model fitted on one half of the
positives scores the other half and all documents, and the prior is the least ratio of the two shares above a score,
with a margin for their errors. A logistic model on shape features then minimises the non-negative unbiased risk
(prior * R_p+ + max(0, R_u- - prior * R_p-)) by Newton steps, whose sums run over all documents as Spark jobs; only sums
of fixed length reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, arrow_rows, distinct_per_doc, fold_of, materialise, small_side, summed, table, text_blocks

FOLDS, HELD_OUT = 4, 2
CUT = 0.7
MOST_STEPS, RIDGE, SETTLED = 30, 1e-3, 1e-3
#: Prior under which the model that only ranks is fitted, bins of its scores, and the chance that the margins fail.
FIRST_PRIOR, BINS, RISK = 0.5, 2000, 0.1

PUNCT = [b for b in range(33, 127) if not chr(b).isalnum()]
KIND = np.zeros(256, np.int64)  # 0: control; then punctuation one by one, digits, upper, lower, blank, newline, beyond ASCII
KIND[PUNCT] = np.arange(1, len(PUNCT) + 1)
DIGIT, UPPER, LOWERCASE, BLANK, NEWLINE, BEYOND = range(len(PUNCT) + 1, len(PUNCT) + 7)
KIND[48:58], KIND[65:91], KIND[97:123], KIND[[32, 9]], KIND[[10, 13]], KIND[128:] = DIGIT, UPPER, LOWERCASE, BLANK, NEWLINE, BEYOND
KINDS = BEYOND + 1
LINE_END = np.zeros(256, bool)
LINE_END[[10, 13]] = True
N_FEATURES = KINDS + 11
FEATURES = pa.schema([("doc_id", pa.int64()), ("f", pa.binary())])


def shape_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES numbers for each text of the block: shares of byte kinds, word and line shape, repetition."""
    docs = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    kinds = np.bincount(owner * KINDS + KIND[raw], minlength=docs * KINDS).reshape(docs, KINDS) if docs else np.zeros((0, KINDS))
    capital = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) if len(raw) else np.zeros(0, np.int64)
    upper = kinds[:, UPPER] + np.bincount(owner[capital], minlength=docs)
    words, lines = Words(raw, offsets), Words(raw, offsets, LINE_END)
    n = np.diff(words.first)
    some = np.maximum(n, 1)
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    grams, inside = words.grams(3)
    three, three_doc = grams[inside], words.doc[: len(grams)][inside]
    n_three = np.maximum(np.bincount(three_doc, minlength=docs), 1)
    n_lines = np.maximum(np.diff(lines.first), 1)
    length = words.end - words.start
    mean_length = np.bincount(words.doc, length, docs) / some
    last = raw[words.end - 1] if len(length) else np.zeros(0, np.uint8)
    marked = np.bincount(words.doc, (KIND[last] > 0) & (KIND[last] <= len(PUNCT)), docs) / some
    shape = [
        upper / np.maximum(kinds[:, UPPER] + kinds[:, LOWERCASE] + kinds[:, BEYOND] / 2, 1),
        np.log1p(n) / 8,
        np.log1p(size / n_lines) / 8,
        mean_length / 10,
        np.bincount(words.doc, (length > 15), docs) / some,
        distinct_per_doc(words.doc, words.hash, docs) / some,
        np.bincount(words.doc, again, docs) / some,
        1 - distinct_per_doc(lines.doc, lines.hash, docs) / n_lines,
        1 - distinct_per_doc(three_doc, three, docs) / n_three,
        marked,
        (n == 0).astype(float),
    ]
    return np.hstack([np.log1p(200 * kinds / size[:, None]), np.stack(shape, axis=1)]).astype(np.float32)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, f (the features as float32 bytes) for each row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_blocks(batches):
            f = shape_features(raw, offsets)
            yield arrow_rows(FEATURES, batch.column(0), [x.tobytes() for x in f])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, f binary")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(np.float64)


def risk_sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Over all rows: counts of U and P; sums of softplus(z) of both; its gradient of both; its Hessian of U."""
    d = len(w)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 + 3 * d + d * d)
        for batch in batches:
            x = np.ones((batch.num_rows, d))
            x[:, 1:] = (matrix(batch.column(0), d - 1) - mean) / scale
            p = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            z = x @ w
            soft, s = np.logaddexp(0, z), 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            total[:4] += len(x), p.sum(), soft.sum(), soft[p].sum()
            total[4 : 4 + d] += s @ x
            total[4 + d : 4 + 2 * d] += s[p] @ x[p]
            total[4 + 2 * d : 4 + 3 * d] += x[p].sum(axis=0)
            total[4 + 3 * d :] += (x.T @ (x * (s * (1 - s))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    t = summed(rows.select("f", "positive").mapInArrow(part, "v array<double>"))
    if not len(t):
        t = np.zeros(4 + 3 * d + d * d)
    return t[:4], t[4 : 4 + d], t[4 + d : 4 + 2 * d], t[4 + 2 * d : 4 + 3 * d], t[4 + 3 * d :].reshape(d, d)


def fit(rows: DataFrame, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (bias first) of the model with the least non-negative risk. rows: f, positive."""
    d = N_FEATURES + 1
    zero, one = np.zeros(N_FEATURES), np.ones(N_FEATURES)
    n, g, _, _, h = risk_sums(rows, zero, one, np.zeros(d))
    if n[1] == 0:
        return zero, one, np.zeros(d)
    mean = 2 * g[1:] / n[0]  # at w = 0 every sigmoid is 1/2, its slope 1/4
    scale = np.sqrt(np.maximum(4 * np.diag(h)[1:] / n[0] - mean**2, 0))
    scale[scale < 1e-6] = 1
    w, best = np.zeros(d), (np.inf, np.zeros(d))
    ridge = np.full(d, RIDGE)
    ridge[0] = 1e-6
    for _ in range(MOST_STEPS):
        n, gu, gp, xp, h = risk_sums(rows, mean, scale, w)
        negative = n[2] / n[0] - prior * n[3] / n[1]  # R_u- less its positive part
        risk = prior * (n[3] - xp @ w) / n[1] + max(negative, 0.0) + (ridge * w) @ w / 2
        if risk < best[0]:
            best = (risk, w)
        if negative < 0:  # the clipped part is to rise again, as in non-negative PU learning
            w = w + 0.5 * np.linalg.solve(h / n[0] + np.diag(ridge + 1e-3), gu / n[0] - prior * gp / n[1])
            continue
        step = np.linalg.solve(h / n[0] + np.diag(ridge), gu / n[0] - prior * xp / n[1] + ridge * w)
        w = w - step * min(1.0, 4 / np.abs(step).max())
        if np.abs(step).max() < SETTLED:
            break
    return mean, scale, best[1]


def estimated_prior(rows: DataFrame) -> float:
    """The share of positives among all rows, from positives and unlabelled rows alone. rows: doc_id, f, positive.

    Above any score, positives that the ranking model hasn't seen have at least the share of all rows there, less what
    negatives add: prior <= U(t) / P(t). The ratio is taken where it plus the margin of its error is least.
    """
    first = (F.xxhash64("doc_id") % 2 == 0) & F.col("positive")
    model = Model(*fit(rows.select("f", first.alias("positive")), FIRST_PRIOR))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BINS)
        for batch in batches:
            z = np.minimum((model.score(matrix(batch.column(0), N_FEATURES)) * BINS).astype(np.int64), BINS - 1)
            other = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            total[:BINS] += np.bincount(z, minlength=BINS)
            total[BINS:] += np.bincount(z[other], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    t = summed(rows.select("f", (F.col("positive") & ~first).alias("other")).mapInArrow(part, "v array<double>"))
    return least_ratio(t[:BINS], t[BINS:]) if len(t) else 0.0


def least_ratio(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The prior from counts of both by rising score; 1 without positives to tell."""
    n_u, n_p = unlabelled.sum(), positive.sum()
    if not n_p:
        return 1.0
    u, p = np.cumsum(unlabelled[::-1]) / n_u, np.cumsum(positive[::-1]) / n_p
    margin = np.sqrt(np.log(4 / RISK) / (2 * n_u)) + np.sqrt(np.log(4 / RISK) / (2 * n_p))
    some = p > 0
    at = np.argmin((u[some] + margin) / p[some])
    return float(min(u[some][at] / p[some][at], 1.0))


class Model:
    """A fitted scorer of feature rows; one without positives to learn from gives 0.5."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def score(self, f: np.ndarray) -> np.ndarray:
        z = (f - self.mean) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_model(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model learnt from docs and the labels outside the held-out fold, and the table of features (doc_id, f, positive)."""
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where(fold_of(FOLDS) != HELD_OUT)
    positives = truth.where("quality = 1").select(F.col("doc_id").alias("_id"), F.lit(True).alias("positive"))
    rows = materialise(featured(docs).join(small_side(positives), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "f", F.coalesce("positive", F.lit(False)).alias("positive")))
    return Model(*fit(rows, estimated_prior(rows))), rows


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Nulls: a null text is empty, a null doc_id has no label and isn't held out; labels of null id or null quality are
    none, and of several labels of one document the largest holds. Without positives every score is 0.5. Empty texts
    have features of their own and are scored like others; repeated rows are scored each, ties score alike; an empty
    table gives no rows. Extra columns are ignored: only the text, all of it, is scored.
    """
    model, rows = fit_model(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1), N_FEATURES)))], ["doc_id", "score"])

    scored = rows.select("doc_id", "f").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold_of(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns, each on its own. Without positives to learn from, every row stays."""
    model, _ = fit_model(docs, labels)
    cut = CUT if model.weights.any() else 0.0

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_blocks(batches):
            yield batch.filter(pa.array(model.score(shape_features(raw, offsets).astype(np.float64)) >= cut))

    return docs.mapInArrow(accepted, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
