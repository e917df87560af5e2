"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, in small letters. Features of a text are the sets of its words, of
their first five bytes (one form for a word with different endings), of pairs of neighbours, and of pairs
with one word between, all hashed into 2**20 coordinates. FTRL-proximal keeps a learning rate per
coordinate and an L1 bound under which a weight is exactly zero, so the model is a short list of
(coordinate, weight); its size is bounded by the coordinates, so it may be broadcast.

Scores are calibrated: training rows are halved by hash, each half is scored by a model of the other half, and
a slope and an intercept fitted to those scores (Platt's method) are applied to the model of all. The three models are
trained in three tasks at once.

Training reads at most MAX_TRAINING labelled rows of at most MAX_WORDS words together (a longer row than what is
left teaches nothing), those first in an order by hash, and makes the passes in that order, so reruns agree, and
no task holds more than the features of so many words. Features in fewer than MIN_ROWS rows are left out. Scores
read all whole texts.

The rate and the L1 bound below were chosen on rows that may teach: trained on those with remainder 0, compared
on those with remainder 2 (see the README). No held-out row chose anything.

Only rows with ``crc32(doc_id as text) mod 3 <> 1`` may teach. No score looks at labels, language, source
or id. Defined cases: null and empty texts score by the intercept alone; very long texts are read whole;
repeated rows score alike; a label that is null, or that names no document, teaches nothing; without
labels of both kinds the score is that of the intercept. Rows that repeat teach once. Other columns are not touched. An empty table
gives an empty table.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.llm import textvec
from stowage.llm.common import Scratch, column, rows_of, table, word_count
from stowage.llm.textvec import FOLD, NOT_ALNUM, U, buffers, mix, runs, slices, word_hashes

for _module in (textvec, sys.modules[__name__]):  # workers then need no copy of the package
    cloudpickle.register_pickle_by_value(_module)

BITS = 20
STEM = 5
MAX_TRAINING = 12_000
MIN_ROWS = 3
MAX_WORDS = 8_000_000
EPOCHS, ALPHA, BETA, L1, L2 = 16, 1.0, 1.0, 16.0, 0.0
THRESHOLD = 0.7


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and coordinates of all features, with repeats."""
    h, counts, first, last = word_hashes(data, offsets, NOT_ALNUM, FOLD)
    row = runs(counts)
    # first bytes: one polynomial over a window of fixed width, cut at the end of the word
    stem = np.zeros(len(h), U)
    for j in range(STEM):
        there = first + j < last
        byte = FOLD[data[np.minimum(first + j, len(data) - 1)]] if len(data) else np.zeros(len(h), np.uint8)
        stem = np.where(there, stem * U(257) + byte.astype(U) + U(1), stem * U(257))
    out_row, out = [row, row], [h, mix(stem ^ U(0x5DEECE66D))]
    for gap, salt in ((1, 0x1234567F), (2, 0x7654321F)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            out_row.append(row[gap:][same])
            out.append(mix((h[:-gap] * U(0x9E3779B97F4A7C15) + h[gap:] + U(salt))[same]))
    return np.concatenate(out_row), (np.concatenate(out) >> U(64 - BITS)).astype(np.int64)


def feature_sets(texts: pa.Array) -> pa.ListArray:
    """The different coordinates of each text."""
    data, offsets = buffers(texts)
    flat, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for a, b in slices(offsets):
        row, x = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        key = np.unique((row.astype(np.int64) << BITS) | x)
        sizes.append(np.bincount(key >> BITS, minlength=b - a))
        flat.append((key & ((1 << BITS) - 1)).astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(flat)))


def _feature_sets(batches):
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], feature_sets(batch.column("text"))], names=[*names, "features"])


def ftrl(sets: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights of all coordinates and the intercept, after passes in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0
    for _ in range(epochs):
        for x, y in zip(sets, labels):
            zx, root = z[x], np.sqrt(n[x])
            w = -np.sign(zx) * np.maximum(np.abs(zx) - L1, 0) / ((BETA + root) / ALPHA + L2)
            w0 = -z0 / ((BETA + n0**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - y
            z[x] += g - (np.sqrt(n[x] + g * g) - root) / ALPHA * w
            n[x] += g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / ALPHA * w0
            n0 += g * g
    w = -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return w.astype(np.float32), float(-z0 / ((BETA + n0**0.5) / ALPHA))


def calibration(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of Platt's method, by Newton steps."""
    one, none = labels.sum(), (1 - labels).sum()
    aim = np.where(labels == 1, (one + 1) / (one + 2), 1 / (none + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, h = p - aim, p * (1 - p) + 1e-9
        slope = np.array([(g * margins).sum() + 1e-3 * (a - 1), g.sum()])
        curve = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-3]])
        da, db = np.clip(np.linalg.solve(curve, slope), -1, 1)
        a, b = a - da, b - db
    return max(a, 1e-3), b


def fit(sets: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, float]:
    """Weights and intercept, without features of fewer than MIN_ROWS rows."""
    rows = np.bincount(np.concatenate([np.zeros(0, np.int64), *sets]), minlength=1 << BITS)
    return ftrl([x[rows[x] >= MIN_ROWS] for x in sets], labels)


def _lists(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(at[:-1], at[1:])]


def _train(rows: pa.Table) -> pa.Table:
    """The model of one group: coordinate (-1: intercept) and weight."""
    rows = rows.sort_by([("turn", "ascending"), ("h", "ascending"), ("label", "ascending")])
    w, w0 = fit(_lists(rows.column("features")), rows.column("label").to_pylist())
    at = np.flatnonzero(w)
    return pa.table({"model": pa.array([rows.column("model")[0].as_py()] * (len(at) + 1), pa.int32()), "coordinate": np.append(at, -1), "weight": np.append(w[at].astype(float), w0)})


def _margins(models):
    """label and margin of every training row, by the model of the other half."""

    def run(batches):
        for batch in batches:
            sets, half = _lists(batch.column("features")), batch.column("half").to_pylist()
            m = [float(models.value[2 - h][0][x].sum() + models.value[2 - h][1]) for x, h in zip(sets, half)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(m, pa.float64())], names=["label", "margin"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_TRAINING, most_words: int = MAX_WORDS) -> tuple[np.ndarray, float]:
    """Calibrated weights and intercept from the labelled rows that may teach."""
    s = Scratch(docs.sparkSession, "toxicity")
    may = labels.select(column(doc_id).alias("id"), column(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen = may.distinct().withColumn("turn", F.xxhash64("id", F.lit("turn"))).orderBy("turn", "id", "label").limit(most)
    texts = docs.select(column(doc_id).alias("id"), column(text).alias("text")).withColumn("words", word_count("text")).filter(F.col("words") <= most_words)
    texts = texts.join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64("text"))  # ``most`` rows at most are broadcast
    # of rows that repeat one; then the first in order, as far as the words go
    keys = texts.groupBy("turn", "h", "label").agg(F.max("words").alias("words")).orderBy("turn", "h", "label").limit(most)
    ahead = F.sum("words").over(Window.orderBy("turn", "h", "label"))  # ``most`` narrow rows at most
    keys = s.keep(keys.withColumn("ahead", ahead).filter(F.col("ahead") <= most_words).select("turn", "h", "label", F.pmod(F.xxhash64("turn", F.lit("half")), F.lit(2)).cast("int").alias("half")), "keys")
    taught = texts.select("text", "turn", "h", "label").join(F.broadcast(keys), ["turn", "h", "label"])
    taught = taught.mapInArrow(_feature_sets, "turn long, h long, label int, half int, features array<int>")
    sets = s.keep(taught.dropDuplicates(["turn", "h", "label"]), "sets")
    one, n = sets.agg(F.sum("label")).first()[0] or 0, rows_of(sets)
    # model 0 learns from all rows, 1 and 2 from a half each
    models = F.array(F.lit(0), F.col("half") + 1) if 0 < one < n else F.array(F.lit(0))
    got = sets.select(F.explode(models).alias("model"), "turn", "h", "label", "features").groupBy("model").applyInArrow(_train, "model int, coordinate long, weight double").toArrow()  # 3 * (2**20 + 1) rows at most
    model, at, weight = (got.column(c).to_numpy() for c in ("model", "coordinate", "weight"))
    found = []
    for k in range(3):
        w, mine = np.zeros(1 << BITS, np.float32), model == k
        w[at[mine & (at >= 0)]] = weight[mine & (at >= 0)]
        found.append((w, float(weight[mine & (at < 0)].sum())))
    (w, w0), a, b = found[0], 1.0, 0.0
    if 0 < one < n:
        held = docs.sparkSession.sparkContext.broadcast(found)
        told = sets.select("label", "half", "features").mapInArrow(_margins(held), "label int, margin double").toArrow()  # ``most`` rows at most
        a, b = calibration(told.column("margin").to_numpy(), told.column("label").to_numpy().astype(float))
        held.unpersist()
    s.close()
    return w * np.float32(a), float(w0 * a + b)


def _scores(model):
    def run(batches):
        (at, value), w0 = model.value
        w = np.zeros(1 << BITS, np.float32)
        w[at] = value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            total = np.zeros(len(batch))
            for a, b in slices(offsets):
                row, x = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                some = w[x] != 0
                key = np.unique((row[some].astype(np.int64) << BITS) | x[some])
                total[a:b] = np.bincount(key >> BITS, w[key & ((1 << BITS) - 1)].astype(float), b - a)
            score = 1 / (1 + np.exp(-np.clip(total + w0, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    w, w0 = model
    at = np.flatnonzero(w)
    held = docs.sparkSession.sparkContext.broadcast(((at, w[at]), w0))
    named = docs.select(column(doc_id).alias("doc_id"), held_out(column(doc_id)).alias("held_out"), column(text).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(_scores(held), f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: one row per row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
