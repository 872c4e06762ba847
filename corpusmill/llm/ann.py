"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Index: coarse centroids from a bounded sample (at least `SAMPLE` rows, A_LIST for a list, MOST_SAMPLED at most, chosen by
a hash of the id); their number grows with the square root of the table, up to a quarter of the sample.  Every row goes
to the list of its nearest centroid and gets the signs of its randomly rotated residual, packed to bits, and three correction scalars:
the residual's length, the code's inner product with the residual's direction, and the residual's with the centroid.
Search: a query probes the lists whose centroids have the largest inner products with it.  For every row of a probed
list the inner product is estimated from bits and scalars, with an error bound that holds with high probability; rows
whose upper bound reaches the k-th lower bound are reranked on the original vectors in double precision.
How many lists to probe is measured on the sample (recall against brute force there of at least `RECALL`), so it
adapts to data without clusters by probing more.

Lists and their queries meet in tiles: a list much longer than the mean is dealt over several blocks of rows, and of
queries, so no list is gathered in one task; each tile yields at most k rows for a query.

Vectors that are null, zero, of another dimension than most of the sample's, or hold null or non-finite components take
no part.  Null ids take no part.  Rows that repeat an id are one candidate, with the best of their scores; a query id that repeats is
asked once, with its smallest vector.  Ties go to the smaller id.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel

TOP = 20
SAMPLE = 8192
#: Sampled rows for a list, and rows sampled at most.
A_LIST, MOST_SAMPLED = 16, 65_536
RECALL = 0.99
#: Error bounds hold for a row with a probability that rises with this.
EPSILON = 2.5
SEED = 7


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated residuals, and per row: residual length, code's fit, residual . centroid."""
    rest = x - centre
    length = np.sqrt((rest * rest).sum(axis=1))
    unit = rest / np.where(length > 0, length, 1)[:, None]
    turned = unit @ turn
    fit = np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(turned > 0, axis=1), np.stack([length, fit, (rest * centre).sum(axis=1)], axis=1)


def estimate(bits: np.ndarray, scalars: np.ndarray, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x rows) and their error bounds, from bits and scalars only."""
    dim = q.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    apart = q - centre
    dot = ((apart @ turn).astype(np.float32) @ signs.T).astype(np.float64) / np.sqrt(dim)
    length, fit, own = scalars.T
    safe = np.where(fit > 0, fit, 1)
    guess = dot * (length / safe) + own + (q @ centre)[:, None]
    wide = length * np.sqrt(np.maximum(1 - fit**2, 0)) / safe * epsilon / np.sqrt(max(dim - 1, 1))
    return guess, np.sqrt((apart * apart).sum(axis=1))[:, None] * wide + 1e-6


def nearest(ids: np.ndarray, x: np.ndarray, bits: np.ndarray, scalars: np.ndarray, query_ids: np.ndarray, q: np.ndarray, bar: np.ndarray, centre: np.ndarray, turn: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, exact score) of each query's best rows of a tile, by estimates, bounds and reranking.

    bar: for each query a score that its `top` best rows of the whole table reach.  The rows of the best estimates are
    reranked first, which raises it; then all whose upper bound reaches it.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 21) // max(1, len(ids)))
    k = min(top, len(ids))

    def exact(qs, qa, xa):
        score = np.empty(len(qa))
        for at in range(0, len(qa), 1 << 16):
            part = slice(at, at + (1 << 16))
            score[part] = np.einsum("ij,ij->i", qs[qa[part]], x[xa[part]])
        return score

    for lo in range(0, len(q), step):
        qs, qi, least = q[lo : lo + step], query_ids[lo : lo + step], bar[lo : lo + step]
        guess, wide = estimate(bits, scalars, qs, centre, turn)
        guess[qi[:, None] == ids[None, :]] = -np.inf
        upper = guess + wide
        some = (upper >= least[:, None]).any(axis=1)
        if not some.any():
            continue
        guess, upper, qs, qi, least = guess[some], upper[some], qs[some], qi[some], least[some]
        if len(ids) > k:
            first = np.argpartition(guess, len(ids) - k, axis=1)[:, len(ids) - k :]
            score = exact(qs, np.repeat(np.arange(len(qs)), k), first.ravel()).reshape(len(qs), k)
            score[np.isneginf(np.take_along_axis(guess, first, axis=1))] = -np.inf
            least = np.maximum(least, score.min(axis=1))
        qa, xa = np.nonzero((upper >= least[:, None]) & ~np.isneginf(guess))
        score = exact(qs, qa, xa)
        enough = score >= least[qa]
        qa, xa, score = qa[enough], xa[enough], score[enough]
        order = np.lexsort((ids[xa], -score, qa))
        qa, xa, score = qa[order], xa[order], score[order]
        keep = np.arange(len(qa)) - np.searchsorted(qa, qa) < top
        out.append((qi[qa[keep]], ids[xa[keep]], score[keep]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*[(none, none, np.zeros(0)), *out]))


class Index:
    """Centroids, rotation and how many lists to probe, from a sample."""

    def __init__(self, sample: np.ndarray, rows: int, top: int, recall: float = RECALL):
        self.turn = rotation(sample.shape[1])
        n = int(max(1, min(np.sqrt(rows) // 2, len(sample) // (A_LIST if len(sample) < MOST_SAMPLED // 2 else 4))))
        rng = np.random.default_rng(SEED)
        centres = sample[rng.permutation(len(sample))[:n]]
        for _ in range(8):
            home = self._home(sample, centres)
            sums, count = np.zeros_like(centres), np.bincount(home, minlength=n)
            np.add.at(sums, home, sample)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        self.centres = centres
        self.probes = self._calibrate(sample, top, recall)

    @staticmethod
    def _home(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (x @ centres.T * 2 - (centres * centres).sum(axis=1)).argmax(axis=1)

    def home(self, x: np.ndarray) -> np.ndarray:
        return self._home(x, self.centres)

    def probed(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, : self.probes]

    def _calibrate(self, sample: np.ndarray, top: int, recall: float) -> int:
        n = len(self.centres)
        asked = sample[:256]
        score = asked @ sample.T
        score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        k = min(top, max(1, len(sample) - 1))
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(asked @ self.centres.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(np.take_along_axis(place, self.home(sample)[best], axis=1).ravel())
        return int(min(n, needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1))


def matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def sound(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can take part."""
    finite = ~F.exists(vector, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(finite & F.exists(vector, lambda v: v != 0))


def search(table: DataFrame, every: int = 20, top: int = TOP, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of all other rows for each row whose id is divisible by `every`."""
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = sound(table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null"), "v")
    total = rows.count()
    # a share of the rows by a hash of their ids, so that no task gathers more than its share of it
    wanted = int(min(MOST_SAMPLED, max(SAMPLE, A_LIST * np.sqrt(total) // 2)))
    share = min(1.0, wanted / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(share * (1 << 40))).limit(2 * wanted).toArrow()
    if not len(sample):
        sample = rows.limit(1).toArrow()
    if not len(sample):
        return spark.createDataFrame([], schema)
    sample = sample.take(pc.sort_indices(sample, sort_keys=[("vec_id", "ascending")]))
    dim = Counter(len(x) for x in sample.column("v")).most_common(1)[0][0]
    rows = rows.where(F.size("v") == dim)
    sample = sample.filter(pc.equal(pc.list_value_length(sample.column("v")), dim))
    known, known_ids = matrix(sample.column("v")), sample.column("vec_id").to_numpy()
    total = rows.count()
    index = Index(known, total, top)
    count, known_home = len(index.centres), index.home(known)

    def to_lists(batches):
        for batch in batches:
            x = matrix(batch.column("v"))
            home = index.home(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(home.astype(np.int32))], names=["vec_id", "v", "list"])

    def reached(q, ids, probed):
        """For each query a score that twice as many rows of the probed lists as are wanted reach, by the sample.

        Twice, so that a row that its bound loses leaves enough others.
        """
        score = np.full(len(q), -np.inf)
        if len(known) <= 2 * top:
            return score
        for lo in range(0, len(q), 256):
            part = slice(lo, lo + 256)
            dot = q[part] @ known.T
            member = np.zeros((len(dot), count), bool)
            np.put_along_axis(member, probed[part], True, axis=1)
            dot[(ids[part, None] == known_ids[None, :]) | ~member[:, known_home]] = -np.inf
            score[part] = np.partition(dot, len(known) - 2 * top, axis=1)[:, len(known) - 2 * top]
        return score - 1e-9

    def to_probes(batches):
        for batch in batches:
            q, ids = matrix(batch.column("v")), batch.column("vec_id").to_numpy()
            probed = index.probed(q)
            bar = reached(q, ids, probed)
            at = np.repeat(np.arange(len(probed)), probed.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(probed.ravel().astype(np.int32)), pa.array(bar).take(pa.array(at))], names=["vec_id", "v", "list", "bar"])

    shape = "vec_id long, v array<double>, list int"
    base = rows.mapInArrow(kernel.freed(to_lists), shape)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = queries.mapInArrow(kernel.freed(to_probes), shape + ", bar double")
    have, want = ({r["list"]: r["count"] for r in df.groupBy("list").count().collect()} for df in (base, asked))
    base_block = int(min(65536, max(512, 2 * total / count)))
    query_block = int(min(8192, max(512, 2 * sum(want.values()) / count)))
    blocks = F.array(*[F.lit(-(-have.get(k, 0) // base_block)) for k in range(count)])
    waves = F.array(*[F.lit(-(-want.get(k, 0) // query_block)) for k in range(count)])
    salt = F.xxhash64("vec_id", "v")

    def dealt(df: DataFrame, own: str, own_parts, other: str, other_parts) -> DataFrame:
        """A place of its own in one direction of the tiles, all places in the other."""
        df = df.withColumn("n_own", F.get(own_parts, F.col("list"))).withColumn("n_other", F.get(other_parts, F.col("list"))).where("n_own > 0 and n_other > 0")
        return df.withColumn(own, F.pmod(salt, F.col("n_own")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("n_other") - 1))).drop("n_own", "n_other")

    def tile(key, left, right):
        centre = index.centres[key[0].as_py()]
        x, q = matrix(left.column("v")), matrix(right.column("v"))
        none = np.zeros(0, np.int64)
        found = (none, none, np.zeros(0))
        if len(left) and len(right):
            bits, scalars = encode(x, centre, index.turn)
            found = nearest(left.column("vec_id").to_numpy(), x, bits, scalars, right.column("vec_id").to_numpy(), q, right.column("bar").to_numpy(), centre, index.turn, top)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))

    keys = ["list", "block", "wave"]
    left = dealt(base, "block", blocks, "wave", waves).groupBy(*keys)
    right = dealt(asked, "wave", waves, "block", blocks).groupBy(*keys)
    found = left.cogroup(right).applyInArrow(kernel.freed(tile), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
