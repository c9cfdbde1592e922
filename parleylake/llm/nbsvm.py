"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive-Bayes log-count ratios.

The n-grams are those of a text's bytes (orders 1 to 4), and runs of a repeated word (orders 2 to 4);
they are hashed into ``DIMS`` features, of which a text has or has not each. Class counts of features
are taken by Spark over all labelled training rows. The hinge-loss model is fitted by dual coordinate
descent on a bounded sample of those rows (at most ``SAMPLE`` a class), and its margins are calibrated
on folds that it was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.llm._shared import table

DIMS = 1 << 18
ORDERS = (1, 2, 3, 4)
#: Documented bound of the sample that the hinge-loss model is fitted on: labelled rows a class.
SAMPLE = 2_000
SMOOTHING, COST, EPOCHS, SEED = 1.0, 1.0, 12, 7
THRESHOLD, FOLDS = 0.3, 5
#: Texts of fewer bytes sort their features; longer ones mark them in a table of ``DIMS`` flags, which costs the same for each.
SHORT = 512
#: Up to so many labels are broadcast (some 30 bytes each); beyond, documents and labels are shuffled together.
MAX_BROADCAST_LABELS = 1_000_000


def features(text: str | None, dims: int = DIMS) -> np.ndarray:
    """The sorted distinct feature numbers of a whole text; none for null and empty texts."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code, found = np.zeros(len(data), np.uint32), []
    for order in ORDERS:
        if len(data) < order:
            break
        code = (code[: len(data) - order + 1] << np.uint32(8)) | data[order - 1 :]
        found.append(((code + np.uint32(order)) * np.uint32(2654435761)) >> np.uint32(32 - dims.bit_length() + 1))
    words = (text or "").split()
    if len(words) > 1:
        same = np.fromiter(map(str.__eq__, words, words[1:]), bool, len(words) - 1)
        for run in (1, 2, 3):
            if not same.any():
                break
            found.append(np.array([dims - run], np.uint32))
            same = same[1:] & same[:-1]
    if len(data) < SHORT:
        return np.unique(np.concatenate(found)).astype(np.int64) if found else np.empty(0, np.int64)
    seen = np.zeros(dims, bool)
    for codes in found:
        seen[codes] = True
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class Model:
    """``weight`` is the hinge-loss weight times the ratio, ``square`` the squared ratio, per feature."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        norm = np.sqrt(self.square[found].sum())
        return float(self.weight[found].sum() / norm if norm else 0.0) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text, len(self.weight))) + self.shift, -40, 40))))


def _counts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, dims), np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            seen[label, features(text, dims)] += 1
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[1, at]), pa.array(seen[0, at])], ["feature", "pos", "neg"])


def _rows(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t, dims).astype(np.int32) for t in batch.column("text").to_pylist()]
        place = pa.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63) for x in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("label"), place, pa.array(found, pa.list_(pa.int32()))], ["label", "place", "features"])


def _descend(rows: list[np.ndarray], norms: np.ndarray, signs: np.ndarray, ratio: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """L1-loss dual coordinate descent with a constant bias feature of 1. A row's values are its ratios over its norm, taken when needed: the rows are held once."""
    w, bias, alpha, rng = np.zeros(len(ratio)), 0.0, np.zeros(len(rows)), np.random.default_rng(SEED)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, values = rows[i], ratio[rows[i]] / norms[i]
            q = float(values @ values) + 1
            gradient = signs[i] * (float(w[x] @ values) + bias) - 1
            new = min(max(alpha[i] - gradient / q, 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                w[x] += step * values
                bias += step
                alpha[i] = new
    return w, bias


def _calibrate(margins: np.ndarray, signs: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, by Newton steps on smoothed targets; classes weigh the same."""
    pos, neg = (signs > 0).sum(), (signs < 0).sum()
    target = np.where(signs > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(signs > 0, 0.5 / max(pos, 1), 0.5 / max(neg, 1)) * len(signs)
    design, beta = np.stack([margins, np.ones_like(margins)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (weight * (target - p)) - 1e-3 * beta)
        beta += np.clip(step, -5, 5)
    return float(max(beta[0], 1e-3)), float(beta[1])


def held_out(doc_id: Column) -> Column:
    """Rows whose CRC-32 of the id as text is divisible by five are never learnt from (null ids: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, dims: int = DIMS) -> Model:
    """Fit on the labelled rows that are not held out.

    Rows with null ids or labels are not labelled; of several labels of a document the larger holds;
    with no labelled rows, or one class only, the model scores every text alike.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    marks = marks.groupBy(F.col(id_col).alias("mark_id")).agg(F.max(label_col).cast("int").alias("label")).cache()
    size = marks.groupBy("label").agg(F.count("*").alias("n")).collect()
    if len(size) < 2:
        marks.unpersist()
        return Model(np.zeros(dims), np.zeros(dims), 0.0, 1.0, 0.0 if not size else (20.0 if size[0]["label"] else -20.0))
    texts = docs.select(F.col(id_col).alias("mark_id"), F.col(text_col).alias("text"))

    def learn_from(rows: DataFrame) -> DataFrame:
        held = sum(r["n"] for r in size) <= MAX_BROADCAST_LABELS
        return texts.join(F.broadcast(rows) if held else rows, "mark_id").select("text", "label")

    counts = learn_from(marks).mapInArrow(lambda b: _counts(b, dims), "feature int, pos long, neg long")
    counts = counts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas()  # at most `dims` rows
    pos, neg = np.full(dims, SMOOTHING), np.full(dims, SMOOTHING)
    pos[counts["feature"]] += counts["pos"]
    neg[counts["feature"]] += counts["neg"]
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    ratio[(pos == SMOOTHING) & (neg == SMOOTHING)] = 0

    order = F.struct(F.xxhash64("mark_id"), F.col("mark_id"))
    picked = [marks.where(F.col("label") == k).orderBy(order).limit(sample) for k in (0, 1)]
    picked = learn_from(picked[0].unionByName(picked[1])).mapInArrow(lambda b: _rows(b, dims), "label int, place long, features array<int>").toArrow()
    marks.unpersist()
    found, signs = _views(picked)
    norms = np.array([np.linalg.norm(ratio[x]) or 1.0 for x in found])
    fold, margins = np.arange(len(found)) % 2, np.zeros(len(found))
    for k in (0, 1):
        own = np.flatnonzero(fold != k)
        w, bias = _descend([found[i] for i in own], norms[own], signs[own], ratio, COST, EPOCHS)
        for i in np.flatnonzero(fold == k):
            margins[i] = w[found[i]] @ ratio[found[i]] / norms[i] + bias
    slope, shift = _calibrate(margins, signs)
    w, bias = _descend(found, norms, signs, ratio, COST, EPOCHS)
    del found, picked
    pa.default_memory_pool().release_unused()
    return Model(w * ratio, ratio * ratio, bias, slope, shift)


def _views(picked: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows' features as views of the table's own memory, and their signs, ordered by a hash of the features and the label: rows that tie are the same, so folds and fit don't depend on their arrival."""
    found: list[np.ndarray] = []
    for chunk in picked.column("features").chunks:
        flat, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        found += [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    signs = picked.column("label").to_numpy() * 2.0 - 1
    place = np.lexsort((signs, picked.column("place").to_numpy()))
    return [found[i] for i in place], signs[place]


def score(text: Column, model: Model, spark: SparkSession) -> Column:
    """A column with the model's score of a text column (0 to 1; null texts count as empty)."""
    held = spark.sparkContext.broadcast((model.weight, model.square))  # two vectors of `dims` doubles
    rest = (model.bias, model.slope, model.shift)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = Model(*held.value, *rest)
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    return scored(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Null and empty texts get the score of a text without features, repeated rows each keep a row, further
    columns of either table are ignored, an empty ``docs`` gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col), model, docs.sparkSession).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; columns as they were.

    Each row is judged by its own text, so repeated rows go or stay together; null texts count as empty,
    null ids are never learnt from, ties at the threshold stay, an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    return docs.where(score(F.col(text_col), model, docs.sparkSession) >= threshold)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learnt from ``labels.quality``."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
