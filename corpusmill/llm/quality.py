"""Quality by importance resampling with hashed n-gram generative models.

Two multinomial models over hashed units and unit pairs (letter runs, digit runs and runs of other characters, case
kept): the target, from documents labelled good, and the raw text, from all documents.  A document's log importance
weight is the sum of log target/raw over its n-grams.  Gumbel noise, a function of the document's id and a seed, is
added, and the k largest perturbed weights are taken, which samples k documents without replacement in proportion to
their importance.  k isn't a cap: it is the number of all documents whose weight reaches the boundary that best parts
the labelled rows, so it grows with the input.  The k-th value is found by counting in ever finer bins of the values'
bits, without sorting or gathering documents.

The target and the boundary come from at most `LABELLED` labelled rows of each class (those of the smallest hashes of
their ids); raw counts cover all documents.

Null or empty texts have no n-grams and weight 0: they are kept exactly if 0 reaches the k-th value with their noise.
Null ids: noise by a hash of the text, label none.  Very long texts: all their n-grams count.  Repeated rows have equal values, and ties at the k-th value are all taken.
Without labelled good rows the target equals the raw text and every document is taken.  An empty table gives an empty
result.  Other columns are ignored by the score; the filter carries them through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel, storage

BUCKETS = 1 << 16
SLICE = 256
LABELLED = 10_000
SEED = 11
SMOOTH = 0.5

#: A unit that follows itself is one and the same pair, whatever the unit.
_AGAIN = np.uint64(0x5851F42D4C957F2D)
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CLASS[kernel.WS] = 0


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the units and of the pairs of neighbours of each text, and where each text's begin."""
    n = len(at) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    kind = _CLASS[data]
    begin = np.empty(len(data), bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin[at[:-1][at[:-1] < len(data)]] = True
    edge = np.flatnonzero(begin)
    solid = kind[edge] != 0
    starts, ends = edge[solid], np.append(edge[1:], len(data))[solid]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    h = kernel.hashes(data, starts, ends, lower=False)
    of = np.searchsorted(starts, at)
    size = np.diff(of)
    out = np.empty(2 * len(h), np.uint64)
    out[0::2] = h
    out[1:-1:2] = np.where(h[1:] == h[:-1], _AGAIN, kernel.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]))
    keep = np.ones(2 * len(h), bool)
    keep[2 * of[1:][size > 0] - 1] = False
    counts = np.where(size > 0, 2 * size - 1, 0)
    return (out[keep] >> np.uint64(64 - 16)).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def _sum_slices(key, table):
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for c in table.column("counts").chunks for x in c)
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, at in kernel.chunks(batch.column("text")):
            total += np.bincount(features(data, at)[0], minlength=BUCKETS)
    parts = total.reshape(-1, SLICE)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slice", "counts"])


def counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts: a vector of fixed length, summed on the executors slice by slice."""
    rows = texts.select("text").mapInArrow(kernel.freed(_count), "slice int, counts binary").groupBy("slice").applyInArrow(kernel.freed(_sum_slices), "slice int, counts binary").collect()
    out = np.zeros(BUCKETS, np.int64).reshape(-1, SLICE)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log target/raw of each bucket; both smoothed towards the raw text."""
    q = (raw + SMOOTH) / (raw.sum() + SMOOTH * len(raw))
    p = (target + SMOOTH * len(raw) * q) / (target.sum() + SMOOTH * len(raw))
    return np.log(p / q)


def _score(ratio: np.ndarray):
    def run(batches):
        for batch in batches:
            weight, n = [], []
            for _, _, data, at in kernel.chunks(batch.column("text")):
                found, of = features(data, at)
                sums = np.concatenate([[0.0], np.cumsum(ratio[found])])
                weight.append(sums[of[1:]] - sums[of[:-1]])
                n.append(np.diff(of))
            if weight:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("draw"), pa.array(np.concatenate(weight)), pa.array(np.concatenate(n), pa.int64())], names=["doc_id", "draw", "log_weight", "n_features"])

    return run


def boundary(weight: np.ndarray, label: np.ndarray) -> float:
    """The value at or above which a row is called good with the fewest errors, each class weighing the same.

    Of cuts that do equally well the middle of the widest gap is taken.
    """
    good, bad = int((label == 1).sum()), int((label == 0).sum())
    if not good or not bad:
        return -np.inf
    order = np.argsort(weight, kind="stable")
    w, y = weight[order], label[order]
    lost = np.concatenate([[0], np.cumsum(y == 1)]) / good
    caught = np.concatenate([[0], np.cumsum(y == 0)]) / bad
    edge = np.concatenate([[True], w[1:] > w[:-1], [True]])
    gain = np.where(edge, caught - lost, -2)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    low = np.concatenate([[w[0] - 1], w])[best]
    high = np.concatenate([w, [w[-1] + 1]])[best]
    k = int((high - low).argmax())
    return float((low[k] + high[k]) / 2)


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column of doubles, by counting in bins of 12 bits of an order-keeping integer."""
    # doubles as fixed point in 2^-20: differences below that are ties
    whole = df.select(F.floor(F.col(column) * (1 << 20)).cast("long").alias("x"))
    ends, shift = (-(1 << 62), 1 << 62), 48
    while True:
        width = 1 << shift
        found = whole.where((F.col("x") >= ends[0]) & (F.col("x") <= ends[1])).groupBy(F.expr(f"(x - {ends[0]}L) div {width}L").alias("bin")).count().collect()
        for r in sorted(found, key=lambda r: -r["bin"]):
            if r["count"] >= k:
                ends = (ends[0] + r["bin"] * width, ends[0] + (r["bin"] + 1) * width - 1)
                break
            k -= r["count"]
        else:
            return -np.inf
        if shift == 0:
            return ends[0] / (1 << 20)
        shift = max(0, shift - 12)


def labelled_ids(labels: DataFrame, column: str, most: int, where: str = "true") -> DataFrame:
    """(doc_id, label) of at most `most` rows of each label 0 and 1, those of the smallest hashes of their ids."""
    rows = labels.where(where).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    parts = [rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def draw(seed: int = SEED) -> Column:
    """What a row's noise is drawn from: its id, or, without one, its text."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))).otherwise(F.xxhash64(F.lit(seed), F.lit("text"), F.col("text").cast("string")))


def weigh(docs: DataFrame, labels: DataFrame, most: int = LABELLED, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, log_weight, perturbed, kept of every document."""
    return _weighed(docs, labels, most, seed).drop("draw")


def _weighed(docs: DataFrame, labels: DataFrame, most: int = LABELLED, seed: int = SEED) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # bounded by `most` rows of each class
    known = F.broadcast(labelled_ids(labels, "quality", most))
    raw = counts(texts)
    target = counts(texts.join(known.where("label = 1"), "doc_id", "left_semi"))
    ratio = log_ratio(target, raw)
    noise = -F.log(-F.log((F.pmod("draw", F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))))
    scored = storage.save(texts.withColumn("draw", draw(seed)).mapInArrow(kernel.freed(_score(ratio)), "doc_id long, draw long, log_weight double, n_features long").withColumn("perturbed", F.col("log_weight") + noise), "weights")
    # a labelled id counts once, with the least weight of its rows
    rows = scored.join(known, "doc_id").groupBy("doc_id", "label").agg(F.min("log_weight").alias("log_weight")).toArrow()
    cut = boundary(rows.column("log_weight").to_numpy(), rows.column("label").to_numpy())
    k = scored.where(F.col("log_weight") >= F.lit(cut)).count()
    kth = kth_largest(scored, "perturbed", k) if k else np.inf
    return scored.select("doc_id", "draw", "n_features", "log_weight", "perturbed", (F.col("perturbed") >= F.lit(float(kth))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the sampler takes.

    Rows of one id and different texts stay if any of them is taken, and so do rows without an id that share a text.
    """
    gone = _weighed(docs, labels).groupBy("doc_id", "draw").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("_id"), F.col("draw").alias("_draw"))
    # the draw of a row with an id is a function of it, so it alone is the join's key
    return docs.withColumn("_own", draw()).join(gone, (F.col("_own") == F.col("_draw")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_anti").select(*docs.columns)
