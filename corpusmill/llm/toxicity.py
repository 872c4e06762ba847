"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are words (runs of letters, lower-cased) and their beginnings of PREFIXES bytes, which catch inflected forms.
The terms whose document frequency differs most between the classes span the vectors, with one coordinate more that
every document has, so that a passing mention and a text full of it point in different directions.  The index holds at
most `EXAMPLES` labelled rows of each class (those of the smallest hashes of their ids), in blocks of similar examples;
for each term and block it keeps the highest weight.  A query visits blocks from the highest bound down and stops when
no block can reach its k-th best cosine, so its K nearest are exact (ties: the smaller doc_id).  Their votes, weighted
by 1 / (distance + SOFT) and by how many labelled rows an example of its class stands for, give a share, which a
logistic curve, fitted to the examples' own leave-one-out shares, turns into the score.

Null or empty texts, and texts without such terms, have only the common coordinate: the score of ordinary texts.  Null
ids are scored alike, with held_out null counted as false.  Repeated rows score alike, and so do very long texts, all of
whose terms count.  Of terms equally far apart at the bound TERMS those of the smaller hashes are taken.  Without labelled rows of both
classes every score is the share of toxic rows (0 without any).  An empty table gives an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, quality

EXAMPLES = 4_000
FOLDS = 5
K = 15
#: Terms at most that the driver takes.
TERMS = 1 << 16
#: A term counts whose frequencies in the two classes lie so many standard errors apart.
APART = 4.0
#: ... and one of which is so many times the other (half a document is added to either).
RATIO = 4.0
PREFIXES = (4, 5, 6)
BLOCK = 64
SOFT = 0.02
#: The common coordinate's weight.
COMMON = 3.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash) of all words and their beginnings."""
    starts, ends, cut = kernel.runs(data, at, _LETTER)
    data = kernel.LOWER[data]
    table = kernel.rolling(data)
    of = np.repeat(np.arange(len(at) - 1), np.diff(cut))
    texts, found = [of], [kernel.span(data, table, starts, ends, 1)]
    for n in PREFIXES:
        long = ends - starts > n
        texts.append(of[long])
        found.append(kernel.span(data, table, starts[long], starts[long] + n, 2))
    return np.concatenate(texts), np.concatenate(found)


def _frequencies(batches):
    """(term, documents of label 0, of label 1) of each batch."""
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for lo, hi, data, at in kernel.chunks(batch.column("text"), kernel.ROLLING_BYTES):
            of, h = terms(data, at)
            order = np.lexsort((of, h))
            of, h = of[order], h[order]
            once = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]
            of, h = of[once], h[once]
            found, inverse = np.unique(h, return_inverse=True)
            bad = np.bincount(inverse, weights=label[lo + of], minlength=len(found)).astype(np.int64)
            every = np.bincount(inverse, minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(every - bad), pa.array(bad)], names=["term", "clean", "toxic"])


class Vectors:
    """TF-IDF over the chosen terms and the common coordinate (0), of unit length."""

    def __init__(self, chosen: np.ndarray, idf: np.ndarray):
        order = np.argsort(chosen)
        self.chosen, self.idf = chosen[order], idf[order]
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(self.chosen >> np.uint64(48)).astype(np.int64)] = True

    def of(self, data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(coordinates, weights) of each text."""
        n = len(at) - 1
        texts, h = terms(data, at)
        some = self.likely[(h >> np.uint64(48)).astype(np.int64)]
        texts, h = texts[some], h[some]
        place = np.searchsorted(self.chosen, h)
        hit = place < len(self.chosen)
        hit[hit] = self.chosen[place[hit]] == h[hit]
        key, count = np.unique(texts[hit] * (len(self.chosen) + 1) + place[hit], return_counts=True)
        texts, place = key // (len(self.chosen) + 1), key % (len(self.chosen) + 1)
        weight = (1 + np.log(count)) * self.idf[place] if len(place) else np.zeros(0)
        cut = np.searchsorted(texts, np.arange(n + 1))
        out = []
        for k in range(n):
            w = np.append(COMMON, weight[cut[k] : cut[k + 1]])
            out.append((np.append(0, place[cut[k] : cut[k + 1]] + 1), w / np.sqrt((w * w).sum())))
        return out


class Index:
    """Inverted lists over blocks of examples, with each block's highest weight of each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], width: int):
        # like examples, those of the same heaviest coordinate and a like share of the common one, share a block
        lead = [int(c[1 + w[1:].argmax()]) if len(c) > 1 else 0 for c, w in vectors]
        order = sorted(range(len(ids)), key=lambda i: (lead[i], round(vectors[i][1][0], 2), ids[i]))
        self.ids, self.labels = ids[order], labels[order]
        self.blocks = -(-len(order) // BLOCK)
        row = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        where = np.concatenate([vectors[i][0] for i in order]).astype(np.int64)
        weight = np.concatenate([vectors[i][1] for i in order])
        self.highest = np.zeros((width, self.blocks))
        np.maximum.at(self.highest, (where, row // BLOCK), weight)
        # a list is in order of blocks
        order = np.lexsort((row, where))
        self.row, self.weight = row[order], weight[order]
        self.cut = np.searchsorted(where[order], np.arange(width + 1))

    def _scores(self, c: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of some blocks (a mask)."""
        total = np.zeros(len(self.ids))
        for x, y in zip(c.tolist(), w.tolist()):
            row, weight = self.row[self.cut[x] : self.cut[x + 1]], self.weight[self.cut[x] : self.cut[x + 1]]
            some = blocks[row // BLOCK]
            total[row[some]] += y * weight[some]
        rows = np.flatnonzero(np.repeat(blocks, BLOCK)[: len(self.ids)])
        return rows, np.round(total[rows], 12)

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, labels, cosines) of the k nearest examples.

        The blocks of the highest bounds come first; after them only those whose bound reaches the k-th best so far.
        """
        c, w = vector
        bound = w @ self.highest[c]
        first = np.zeros(self.blocks, bool)
        first[np.argpartition(-bound, min(3, self.blocks - 1))[:4]] = True
        rows, score = self._scores(c, w, first)
        least = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
        rest = ~first & (bound >= least - 1e-9)
        if rest.any():
            more, other = self._scores(c, w, rest)
            rows, score = np.concatenate([rows, more]), np.concatenate([score, other])
        if len(score) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[keep], score[keep]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], self.labels[rows[best]], score[best]


def share(labels: np.ndarray, cosines: np.ndarray, stands_for: np.ndarray) -> float:
    """Of the votes, weighted by nearness, those for toxic."""
    weight = stands_for[labels] / (np.maximum(0, 1 - cosines) + SOFT)
    return float((weight * labels).sum() / weight.sum()) if len(labels) else 0.0


def curve(shares: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from the log odds of shares to chances, with smoothed targets."""
    x = _odds(shares)
    up, down = weight[labels == 1].sum(), weight[labels == 0].sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + (a - 1) ** 2 / 2)

    a, b = 1.0, 0.0
    for _ in range(50):
        p = _chance(a * x + b)
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        m = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step, size, now = np.linalg.solve(m, [(g * x).sum() + (a - 1), g.sum()]), 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def _chance(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _odds(s):
    s = np.clip(s, 0.005, 0.995)
    return np.log(s / (1 - s))


class Model:
    def __init__(self, vectors: Vectors, index: Index, stands_for: np.ndarray, slope: float, offset: float):
        self.vectors, self.index, self.stands_for, self.slope, self.offset = vectors, index, stands_for, slope, offset
        self.memo: dict[bytes, tuple[float, list[int]]] = {}

    def score(self, vector: tuple[np.ndarray, np.ndarray]) -> tuple[float, list[int]]:
        key = vector[0].tobytes() + vector[1].tobytes()
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            ids, labels, cosines = self.index.nearest(vector)
            p = _chance(self.slope * _odds(share(labels, cosines, self.stands_for)) + self.offset)
            self.memo[key] = float(p), ids[:5].tolist()
        return self.memo[key]


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Model | float:
    """The model, or, without examples of both classes, a constant score."""
    fold = f"crc32(cast(cast(doc_id as string) as binary)) % {FOLDS} <> 0"
    known = quality.labelled_ids(labels, "toxic", most, fold)
    # bounded by `most` rows of each class
    sample = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return float(list(n)[0]) if n else 0.0
    total = {r["label"]: r["count"] for r in labels.where(fold).select(F.col("toxic").cast("int").alias("label"), "doc_id").where("label in (0, 1) and doc_id is not null").groupBy("label").count().collect()}
    n0, n1 = n[0], n[1]
    counted = sample.mapInArrow(kernel.freed(_frequencies), "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic >= 3")
    p = (F.col("clean") / n0 + F.col("toxic") / n1) / 2
    apart = F.abs(F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n0 + 1 / n1))
    ratio = (F.col("toxic") + 0.5) / n1 / ((F.col("clean") + 0.5) / n0)
    chosen = counted.withColumn("apart", apart).where((F.col("apart") >= APART) & (F.greatest(ratio, 1 / ratio) >= RATIO)).orderBy(F.desc("apart"), "term").limit(TERMS).collect()
    term = np.array([r["term"] for r in chosen], np.int64).view(np.uint64)
    # both classes weigh the same: how rare a term is doesn't depend on how the sample was drawn
    idf = np.array([np.log(2 / (r["clean"] / n0 + r["toxic"] / n1 + 1e-3)) + 1 for r in chosen], float)
    vectors = Vectors(term, idf)

    def featured(batches):
        for batch in batches:
            for lo, hi, data, at in kernel.chunks(batch.column("text"), kernel.ROLLING_BYTES):
                c, w = zip(*vectors.of(data, at))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array(list(c), pa.list_(pa.int64())), pa.array(list(w), pa.list_(pa.float64()))], names=["doc_id", "label", "at", "weight"])

    rows = sorted(sample.mapInArrow(kernel.freed(featured), "doc_id long, label int, at array<long>, weight array<double>").collect())
    ids, label = np.array([r["doc_id"] for r in rows]), np.array([r["label"] for r in rows])
    found = [(np.array(r["at"], np.int64), np.array(r["weight"])) for r in rows]
    index = Index(ids, label, found, len(term) + 1)
    stands_for = np.array([total.get(0, n0) / n0, total.get(1, n1) / n1])
    memo: dict[bytes, tuple] = {}
    shares = np.zeros(len(rows))
    for i, v in enumerate(found):
        # one neighbour more than needed, so that the example itself can be left out of what like examples share
        key = v[0].tobytes() + v[1].tobytes()
        if key not in memo:
            memo[key] = index.nearest(v, K + 1)
        near, y, cos = memo[key]
        other = np.flatnonzero(near != ids[i])[:K]
        shares[i] = share(y[other], cos[other], stands_for)
    slope, offset = curve(shares, label, stands_for[label])
    return Model(vectors, index, stands_for, slope, offset)


def score(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(rows, labels, most)
    held = F.coalesce(kernel.crc_of_decimal("doc_id") % FOLDS == 0, F.lit(False))
    if not isinstance(model, Model):
        scored = rows.select("doc_id", F.lit(model).alias("score"), F.expr("cast(array() as array<long>)").alias("evidence"))
    else:

        def run(batches):
            for batch in batches:
                for lo, hi, data, at in kernel.chunks(batch.column("text"), kernel.ROLLING_BYTES):
                    p, near = zip(*(model.score(v) for v in model.vectors.of(data, at)))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(p, pa.float64()), pa.array(near, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

        scored = rows.mapInArrow(kernel.freed(run), "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
