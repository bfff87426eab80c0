"""Quality scores from random Fourier features of document statistics.

A document becomes a vector of statistics of its whole text. A fixed random
map to `FEATURES` cosines approximates a Gaussian kernel over the standardised
statistics. Each partition of the training rows sums its share of the normal
equations; the sums are added per matrix row on the executors, and one
FEATURES x FEATURES system, whatever the number of documents, is solved on the
driver. Ridge scores are calibrated by isotonic regression on other rows,
pooled from counts per score bin (at most `BINS`).

Labels are read only for rows whose crc32(doc_id) mod 3 is 0 (the ridge) or 2
(the calibration). Remainder 1 is held out.

Nulls: a null text is empty and is scored as such; a null doc_id counts as an
empty id for the remainder and carries no label; null labels are not used, nor
are ids with contradicting labels. Without training rows every score is 0.5.
Repeated rows are scored each; equal texts have equal scores. Very long texts
are counted whole. An empty table gives an empty result. Other columns of
either table are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, table

FEATURES = 256
#: Width of the kernel in standard deviations of the statistics.
WIDTH = 3.0
RIDGE = 1e-3
BINS = 2000
STATISTICS = ("log_words", "mean_word", "sd_word", "symbols", "upper", "digits", "stops", "distinct", "stutter", "top_word", "duplicate_lines", "log_line_words", "high_bytes", "repeated_windows")


CLASSES = {"symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "stops": b".,;:!?", "high": bytes(range(128, 256))}
WHITE = bytes((9, 10, 11, 12, 13, 32))


def statistics(text: str) -> list[float]:
    """STATISTICS of a text, all finite, the empty one included."""
    data = text.encode("utf-8", "surrogatepass")
    bins = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    solid = len(data) - int(bins[list(WHITE)].sum())
    share = {k: float(bins[list(v)].sum()) / solid for k, v in CLASSES.items()}
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    grams = n // 4
    windows = len(set(zip(words[0::4], words[1::4], words[2::4], words[3::4], strict=False)))
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), share["symbols"], share["upper"], share["digits"], share["stops"],
        len(counts) / n**0.8, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n, 1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))), share["high"], 1 - windows / grams if grams else 0.0,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, fold (crc32 of the id mod 3) and x, the statistics."""
    def compute(batches):
        for batch in batches:
            x = [statistics(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("fold"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "fold", "x"])

    rows = pick(docs, "doc_id", "text").withColumn("fold", F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(3)).cast("int"))
    return rows.mapInArrow(compute, "doc_id long, fold int, x array<double>")


class Kernel:
    """Random Fourier features of standardised statistics."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray):
        rng = np.random.default_rng(20)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.standard_normal((len(mean), FEATURES)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: list[list[float]]) -> np.ndarray:
        z = np.clip((np.array(x, np.float64).reshape(-1, len(self.mean)) - self.mean) / self.sd, -8, 8)
        out = np.ones((len(z), FEATURES + 1))
        out[:, :FEATURES] = np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b)
        return out


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of y with weights w."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        blocks.append([value * weight, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.repeat([b[0] / b[1] for b in blocks], [int(b[2]) for b in blocks])


def fit_ridge(rows: DataFrame) -> tuple[Kernel, np.ndarray] | None:
    """Kernel and weights from rows (x, y); None without rows."""
    k = len(STATISTICS)
    moments = rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).collect()[0]
    if not moments["n"]:
        return None
    kernel = Kernel(np.array([moments[f"m{i}"] for i in range(k)]), np.array([moments[f"s{i}"] for i in range(k)]))

    def normal(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        seen = False
        for pdf in batches:
            z = kernel(pdf["x"].tolist())
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ pdf["y"].to_numpy(np.float64)
            seen = True
        if seen:
            yield pd.DataFrame({"i": np.arange(FEATURES + 1), "v": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1].to_numpy(), "v": [np.sum(pdf["v"].tolist(), axis=0)]})

    summed = rows.mapInPandas(normal, "i long, v array<double>").groupBy("i").applyInPandas(add, "i long, v array<double>").collect()  # FEATURES + 1 rows
    m = np.array([r["v"] for r in sorted(summed, key=lambda r: r["i"])])
    penalty = RIDGE * moments["n"] * np.eye(FEATURES + 1)
    penalty[-1, -1] = 0
    return kernel, np.linalg.solve(m[:, :-1] + penalty, m[:, -1])


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    rows = materialize(with_statistics(docs), "statistics")
    known = pick(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).filter("y = y2").drop("y2")
    train = rows.filter("fold <> 1").join(known, "doc_id")
    fitted = fit_ridge(train.filter("fold = 0").select("x", "y"))

    if fitted is None:
        return rows.select("doc_id", (F.col("fold") == 1).alias("held_out"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    kernel, weights = fitted

    def bin_of(x: list[list[float]]) -> np.ndarray:
        return np.clip(np.floor((kernel(x) @ weights + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int64)

    def binned(batches):
        for pdf in batches:
            yield pd.DataFrame({"bin": bin_of(pdf["x"].tolist()), "y": pdf["y"]})

    counts = train.filter("fold = 2").select("x", "y").mapInPandas(binned, "bin long, y int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).collect()  # BINS rows at most
    counts = sorted(counts, key=lambda r: r["bin"])
    at = np.array([r["bin"] for r in counts], np.float64)
    if len(at):
        n, good = np.array([r["n"] for r in counts], np.float64), np.array([r["good"] for r in counts], np.float64)
        level = isotonic(good / n, n)
    else:
        at, level = np.array([0.0, BINS - 1.0]), np.array([0.0, 1.0])

    def score(batches):
        for batch in batches:
            raw = np.clip((kernel(batch.column("x").to_pylist()) @ weights + 0.5) / 2, 0, 1)
            # a trace of the raw score keeps the order inside a pooled block
            s = np.round(0.999 * np.interp(raw * BINS - 0.5, at, level) + 0.001 * raw, 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(batch.column("fold").to_numpy() == 1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
