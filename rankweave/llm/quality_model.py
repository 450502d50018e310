"""A quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The statistics are ratios of the rule ledger's counts (words, letters, capitals, symbols, repeated lines
and windows); no label, language, source or id enters them. Standardised, they go through ``FEATURES``
random cosines, which approximate a Gaussian kernel. The ridge weights solve normal equations that each
partition of the labelled rows sums for itself; scores of rows set aside then give an isotonic step
function to probabilities, linear between its steps.

The fit uses at most about ``MAX_LABELS`` labelled rows, chosen by a hash of the id, so the driver's part is
bounded by that and by FEATURES squared; scores cover every row and whole texts.

Results of the corner cases: null and empty texts have all statistics 0 and a score like any other; without
labels every score is 0.5, with labels of one kind their mean; repeated labels count repeatedly, null labels
not; repeated rows each get their row; columns beyond those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import quality_rules

#: Labelled rows in the fit at most, about; cosines; partitions that sum; ridge; kernel width.
MAX_LABELS, FEATURES, PARTS, RIDGE, GAMMA = 40_000, 256, 16, 1e-3, 0.1
#: A quarter of the labelled rows calibrates.
FOLDS = 4
SEED = 11


def statistics() -> Column:
    """The statistics of a row of the ledger, as an array of doubles."""
    part = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    return F.array(F.log1p("n_words"), part("word_chars", "n_words"), part("n_symbols", "n_words"), part("n_dup_lines", "n_lines"), part("n_repeat_words", "n_words"), F.log1p(part("n_words", "n_lines")), part("n_letters", "word_chars"), part("n_upper", "n_letters"))


class Cosines:
    """Standardises and maps rows to random Fourier features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, gamma: float = GAMMA, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 0, scale, 1.0)
        self.w = rng.normal(size=(len(mean), features)) * np.sqrt(2 * gamma)
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the blocks' mean scores and mean labels, both ascending."""
    blocks: list[list[float]] = []  # sum of scores, sum of labels, rows
    for i in np.lexsort((y, x)):
        blocks.append([x[i], y[i], 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    def __init__(self, cosines: Cosines | None, weights: np.ndarray | None, steps: tuple[np.ndarray, np.ndarray], constant: float):
        self.cosines, self.weights, self.steps, self.constant = cosines, weights, steps, constant

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.cosines is None:
            return np.full(len(x), self.constant)
        raw = self.cosines(x) @ self.weights
        sure = np.interp(raw, *self.steps) if len(self.steps[0]) else raw
        # a hundredth of the raw score keeps apart what one step holds
        return np.clip(0.99 * sure + 0.01 / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), dtype="float64").reshape(len(rows), -1)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> Model:
    """Learns from ``labels(doc_id, quality)`` and the texts of ``docs(doc_id, text)`` with these ids."""
    known = labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("y"))
    count = known.count()
    share = min(1.0, most / max(count, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about ``most`` rows of 16 bytes
    rows = C.stored(quality_rules.evaluated(texts).select("y", statistics().alias("x"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).alias("fold")), "labelled")
    about = rows.select("y", *(F.get("x", F.lit(i)).alias(f"x{i}") for i in range(8)))
    sums = about.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), F.min("y").alias("lo"), F.max("y").alias("hi"), *(f(f"x{i}").alias(f"{n}{i}") for i in range(8) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not sums.n or sums.lo == sums.hi:
        return Model(None, None, (np.zeros(0), np.zeros(0)), 0.5 if not sums.n else float(sums.y))
    cosines = Cosines(np.array([sums[f"m{i}"] for i in range(8)]), np.array([sums[f"s{i}"] for i in range(8)]))

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = FEATURES + 1
        a, b = np.zeros((size, size)), np.zeros(size)
        for f in frames:
            z = cosines(_matrix(f.x))
            a += z.T @ z
            b += z.T @ f.y.to_numpy()
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    def normal(own: DataFrame) -> np.ndarray:
        parts = own.repartition(PARTS, "x").mapInPandas(summed, "a binary, b binary").toPandas()
        a = sum(np.frombuffer(x).reshape(FEATURES + 1, -1) for x in parts.a)
        b = sum(np.frombuffer(x) for x in parts.b)
        return np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1] / 1000) * np.eye(FEATURES + 1), b)

    weights = normal(rows.where("fold > 0"))
    aside = rows.where("fold = 0").toPandas()
    steps = isotonic(cosines(_matrix(aside.x)) @ weights, aside.y.to_numpy()) if len(aside) else (np.zeros(0), np.zeros(0))
    return Model(cosines, weights, steps, float(sums.y))


def score(docs: DataFrame, model: Model, keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``score`` (0 to 1) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(_matrix(x)) if len(x) else [], dtype="float64")

    scored.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return quality_rules.evaluated(docs).select(*keep, F.pandas_udf(scored, "double")(statistics()).alias("score"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs, labels.where(~out))
    return score(docs.select("doc_id", "text"), model, ["doc_id", out.alias("held_out")]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
