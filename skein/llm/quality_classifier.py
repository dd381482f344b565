"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each text becomes FEATURES: logarithms and square roots of counts and shares. The two classes' means
and covariances come from sums over all labelled training rows. Covariances shrink towards
the pooled one and towards its diagonal. A text's score is the logistic of the difference of the
classes' log densities, each from a Mahalanobis distance by forward substitution with the class's cached
Cholesky factor, plus that of the priors. A worker holds about 2 MB of texts at a time, or one longer text whole
with some 15 bytes for each of its own.

Null and empty texts have zero counts and get a score like any other. Labels other than 0 and 1 are left
out; a label's repeated row counts again. If a class has no rows, all scores are the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import BASE, Scratch, Strings, byte_slices, mix

FEATURES = (
    "words", "word_length", "symbols", "capitals", "digits", "punctuation", "exclamations", "pipes", "line_length",
    "repeated_lines", "repeated_windows", "distinct_words", "ends", "short_words",
)
WINDOW = 8
#: Shares of the pooled covariance and of the pooled diagonal in each class's covariance, and the least variance.
POOLED, DIAGONAL, RIDGE = 0.1, 0.1, 1e-4
THRESHOLD = 0.3

_SYMBOL, _UPPER, _DIGIT, _PUNCT, _BANG, _PIPE, _SPACE = range(7)


def _classes() -> np.ndarray:
    table = np.zeros((7, 256), bool)
    for k, chars in enumerate(("#*$%&|<>@^~_=+\\/{}[]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-?", "!", "|", " \t\n\x0b\x0c\r")):
        table[k, list(chars.encode())] = True
    return table


_CLASSES = _classes()


def _repeats(group: np.ndarray, code: np.ndarray, groups: int) -> np.ndarray:
    """In each group, how many codes equal an earlier one of it."""
    key = mix(code + group.astype(np.uint64) * BASE)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.bincount(group[again], minlength=groups)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of the texts data[offsets[k]:offsets[k + 1]], a row each."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    start, end = offsets[:-1], offsets[1:]
    count = []
    for k in range(7):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_CLASSES[k][data], out=sums[1:])
        count.append((sums[end] - sums[start]).astype(float))
    gap = _CLASSES[_SPACE][data]
    edge = np.ones(len(data) + 1, bool)  # a word starts after a gap or at a text's start
    edge[1:] = np.append(gap[:-1], True) if len(data) else True
    edge[offsets] = True
    first = np.flatnonzero(~gap & edge[:-1])
    stop = np.ones(len(data) + 1, bool)
    stop[:-1] = gap
    stop[offsets] = True
    last = np.flatnonzero(~gap & stop[1:]) + 1
    strings = Strings(data)
    code = strings.of(first, last)
    doc = np.searchsorted(offsets, first, side="right") - 1
    words = np.bincount(doc, minlength=n)
    repeated_words = _repeats(doc, code, n)
    short = np.bincount(doc[last - first <= 3], minlength=n)
    ends = np.bincount(doc[np.isin(data[last - 1], list(b".,;:!?"))], minlength=n) if len(last) else np.zeros(n)
    if len(code) >= WINDOW:
        window = np.zeros(len(code) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            window = mix(window + code[k : len(code) - WINDOW + 1 + k])
        inside = doc[: len(window)] == doc[WINDOW - 1 :]
        repeated_windows = _repeats(doc[: len(window)][inside], window[inside], n)
    else:
        repeated_windows = np.zeros(n)
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    body = line_end - line_start > 1
    lines = np.bincount(line_doc[body], minlength=n)
    trimmed = line_end[body] - (data[line_end[body] - 1] == 10)
    repeated_lines = _repeats(line_doc[body], strings.of(line_start[body], trimmed), n)
    chars, w = np.maximum(size, 1), np.maximum(words, 1)
    share = lambda x, of: np.sqrt(x / np.maximum(of, 1))
    return np.stack([
        np.log1p(words), np.log1p((size - count[_SPACE]) / w), share(count[_SYMBOL], chars), share(count[_UPPER], chars), share(count[_DIGIT], chars),
        share(count[_PUNCT], chars), share(count[_BANG], chars), share(count[_PIPE], chars), np.log1p(size / np.maximum(lines, 1)),
        share(repeated_lines, lines), share(repeated_windows, words), share(words - repeated_words, w), share(ends, w), share(short, w),
    ], axis=1)


def featurize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one double per feature) of each row; whole texts, batch by batch."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for first, end, data, offsets in byte_slices(b.column(1)):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["id", *FEATURES])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join([f"id {df.schema[id_col].dataType.simpleString()}", *(f"{f} double" for f in FEATURES)]))


@dataclass
class Discriminant:
    """Means, Cholesky factors and log terms of the classes 0 and 1, worked out once."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        log = []
        for m, factor, c in zip(self.means, self.factors, self.constants, strict=True):
            z = (x - m).T
            for k in range(len(factor)):  # forward substitution, all rows at once
                z[k] = (z[k] - factor[k, :k] @ z[:k]) / factor[k, k]
            log.append(c - 0.5 * (z**2).sum(0))
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def fit(train: DataFrame, label_col: str = "label") -> Discriminant:
    """From all rows of train (features and a label 0 or 1): two rows of sums come to the driver. Sums of decimals are the same in any order."""
    exact = lambda c: F.sum(c.cast("decimal(18,9)"))
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    sums = train.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int").alias("label")).agg(
        F.count("*").alias("n"), *(exact(F.col(f)).alias(f"s{k}") for k, f in enumerate(FEATURES)), *(exact(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"c{i}_{j}") for i, j in pairs)
    )
    rows = {r["label"]: r for r in sums.collect()}
    total = sum(r["n"] for r in rows.values())
    if len(rows) < 2:
        return Discriminant([], [], [], (rows[1]["n"] if 1 in rows else 0) / total if total else 0.5)
    means, covs, counts = [], [], []
    for label in (0, 1):
        r = rows[label]
        m = np.array([float(r[f"s{k}"]) for k in range(len(FEATURES))]) / r["n"]
        c = np.zeros((len(FEATURES), len(FEATURES)))
        for i, j in pairs:
            c[i, j] = c[j, i] = float(r[f"c{i}_{j}"]) / r["n"] - m[i] * m[j]
        means.append(m)
        covs.append(c)
        counts.append(r["n"])
    pooled = sum(n * c for n, c in zip(counts, covs, strict=True)) / total
    factors, constants = [], []
    for n, c in zip(counts, covs, strict=True):
        shrunk = (1 - POOLED - DIAGONAL) * c + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled)) + RIDGE * np.eye(len(c))
        factor = np.linalg.cholesky(shrunk)
        factors.append(factor)
        constants.append(float(np.log(n / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(means, factors, constants, counts[1] / total)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, held_out, score, predicted) of each row of df. Labels of rows with crc32(id as text) mod 5 = 0 are never learnt from."""
    scratch = scratch or Scratch(df.sparkSession)
    held_out = lambda c: F.crc32(c.cast("string").cast("binary")) % 5 == 0
    features = scratch.save(featurize(df, id_col, text_col), "features")
    learnt = labels.select(F.col(id_col).alias("at"), F.col(label_col).alias("label")).where(~held_out(F.col("at")))
    model = fit(features.join(learnt, F.col("id") == F.col("at")))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.stack([b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))], axis=1) if b.num_rows else np.zeros((0, len(FEATURES)))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    scored = features.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, score double, predicted int")
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", "predicted")
