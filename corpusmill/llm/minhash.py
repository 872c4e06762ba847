"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set is its distinct 5-word shingles, as 64-bit hashes; its sketch is the K smallest of them.  Documents
with equal sets are first folded into one class.  Inverted lists of retained values - keyed by runs of RUN values that
are neighbours in a sketch - bring together classes whose sketches overlap: two large sets of a Jaccard similarity of
0.85 share such a run but for a chance below 1e-6, of 0.8 but for one of about 1e-5 (sets of up to K shingles always
do; those of SHORT or fewer are listed by runs of two as well, for a set of five and four of them may share no run of
three), while documents that share only a passage or a few phrases rarely do.  Lists of one class are dropped; the
others join their classes into loose clusters.
Each class of a cluster moves once with its whole set: within a cluster (dealt over tiles of pairs of blocks if it is
large), the union sketch's estimate drops pairs that can't reach the threshold, and exact set sizes confirm the rest.
No pairs are emitted: a tile yields a spanning forest of its links, and components are found by alternating large-star
and small-star steps over those, written to the shared folder at each step.

Null or empty texts (or texts of white space) have an empty set and are linked with nothing.  Null ids: such rows get
no component (null) and aren't kept.  Rows that repeat an id are one document with the union of their links; each row
is returned.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel, storage

K = 32
RUN = 3
#: Shingles of a set that is listed by runs of two too.
SHORT = 5
LINK = (85, 100)
#: Standard errors by which the union sketch's estimate may fall short of the threshold.
SLACK = 5.0
BLOCK = 256
#: Bytes of shingles in a block at most (a longer set is a block of its own).
BLOCK_BYTES = 8 << 20


def sets(column: pa.Array):
    """(row, sorted distinct shingle hashes) of each text."""
    for lo, hi, data, at in kernel.chunks(column):
        starts, ends, of = kernel.words(data, at)
        value, to = kernel.shingles(kernel.hashes(data, starts, ends), of)
        for k in range(hi - lo):
            yield lo + k, np.unique(value[to[k] : to[k + 1]])


def runs(sketch: np.ndarray, run: int = RUN) -> np.ndarray:
    """Keys of the inverted lists: each run of neighbours in the sketch; a smaller sketch is one run."""
    n = max(1, len(sketch) - run + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(run, len(sketch))):
        out = kernel.mix(out * np.uint64(0x9E3779B97F4A7C15) + sketch[j : j + n])
    return out


_SKETCH = "doc_id long, n_shingles long, signature binary, sketch_keys array<long>"


def _sketches(k: int, run: int):
    import hashlib

    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            n, signature, keys, sizes = [], [], [], []
            for _, s in sets(batch.column("text")):
                n.append(len(s))
                signature.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                own = runs(s[:k], run) if len(s) else s
                if 2 < len(s) <= SHORT:
                    own = np.concatenate([own, runs(s, 2)])
                keys.append(own.view(np.int64))
                sizes.append(len(own))
            if n:
                flat = pa.array(np.concatenate(keys), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(signature, pa.binary()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)],
                    names=["doc_id", "n_shingles", "signature", "sketch_keys"],
                )

    return work


def _whole(batches):
    for batch in batches:
        rows = [s.tobytes() for _, s in sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), batch.column("block"), batch.column("blocks"), pa.array(rows, pa.binary())], names=["id", "cluster", "block", "blocks", "shingles"])


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(id, component) of every id on an edge; component is the smallest id reachable.

    Alternating large-star and small-star; each step is a table in the shared folder.  A hub of many edges is never
    gathered: its neighbours' minimum is a partial aggregate, joined back with a join that can split it.
    """
    edges = storage.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), name)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is tied to the smallest
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours, and the id itself, are tied to the smallest
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = storage.save(small, name)
        # done when every id hangs on one id that hangs on none
        one = following.groupBy("u").count().where("count > 1").limit(1).count() == 0
        flat = one and following.join(following.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count() == 0
        storage.drop(edges)
        edges = following
        if flat:
            break
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def forest(size: np.ndarray, shingle: list[np.ndarray], left: int, link: tuple[int, int] = LINK, k: int = K, slack: float = SLACK) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between rows i < left and j >= left, or, if left is 0, between all rows."""
    n = len(size)
    num, den = link
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    floor = num / den - slack * np.sqrt(num / den * (1 - num / den) / k)
    values = np.unique(np.concatenate([s[:k] for s in shingle]))
    # the sketches as rows of a table of places: small integers that keep the hash order
    place = np.full((n, k), len(values) + 1, np.int64)
    for i, s in enumerate(shingle):
        place[i, : min(k, len(s))] = np.searchsorted(values, s[:k])
    found = []
    for i in range(n if not left else left):
        others = np.arange(max(i + 1, left), n)
        if not len(others):
            continue
        low, high = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
        others = others[low * den >= num * high]
        others = others[[root(j) != root(i) for j in others.tolist()]] if len(others) else others
        if not len(others):
            continue
        # union sketch: of the k smallest of both, how many are in both
        both = np.concatenate([place[others], np.broadcast_to(place[i], (len(others), k))], axis=1)
        both.sort(axis=1)
        same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] <= len(values))
        fresh = np.ones(both.shape, bool)
        fresh[:, 1:] = both[:, 1:] != both[:, :-1]
        fresh &= both <= len(values)
        rank = np.cumsum(fresh, axis=1)
        shared = (same & (rank[:, 1:] <= k)).sum(axis=1)
        of = np.minimum(rank[:, -1], k)
        whole = (size[i] <= k) & (size[others] <= k)
        guess = shared / np.maximum(of, 1)
        for j in others[whole | (guess >= floor)].tolist():
            if root(i) == root(j):
                continue
            common = _common(shingle[i], shingle[j])
            if den * common >= num * (size[i] + size[j] - common):
                parent[root(j)] = root(i)
                found.append((i, j))
    return found


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _tile(link: tuple[int, int]):
    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        order = np.argsort(table.column("block").to_numpy(), kind="stable") if i != j else np.arange(len(table))
        ids = table.column("id").to_numpy()[order]
        block = table.column("block").to_numpy()[order]
        raw = table.column("shingles").combine_chunks() if isinstance(table.column("shingles"), pa.ChunkedArray) else table.column("shingles")
        shingle = [np.frombuffer(raw[int(r)].as_buffer(), np.uint64) for r in order]
        size = np.array([len(s) for s in shingle])
        left = 0 if i == j else int((block == i).sum())
        edges = forest(size, shingle, left, link) if i == j or 0 < left < len(ids) else []
        a = np.array([ids[x] for x, _ in edges], np.int64)
        b = np.array([ids[y] for _, y in edges], np.int64)
        return pa.table({"a": a, "b": b})

    return run


def links(docs: DataFrame, k: int = K, run: int = RUN, link: tuple[int, int] = LINK) -> tuple[DataFrame, DataFrame]:
    """Sketches (doc_id, n_shingles, signature) of all documents, and (id, component) of those that are linked."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = storage.save(texts.mapInArrow(kernel.freed(_sketches(k, run)), _SKETCH), "sketches")
    filled = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("signature").agg(F.min("doc_id").alias("id"))
    same = filled.select("doc_id", "signature").join(classes, "signature").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    # inverted lists over the classes' representatives
    reps = filled.join(classes.withColumnRenamed("id", "doc_id"), ["signature", "doc_id"], "left_semi")
    postings = reps.select(F.col("doc_id").alias("id"), F.explode("sketch_keys").alias("key"))
    hubs = postings.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    loose = components(postings.join(hubs, "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), name="loose")
    loose = storage.save(loose.join(reps.select(F.col("doc_id").alias("id"), "n_shingles").dropDuplicates(["id"]), "id").select("id", F.col("component").alias("cluster"), "n_shingles"), "clusters")
    # large clusters are dealt over blocks by a hash of the id
    sizes = loose.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("s") * 8 / BLOCK_BYTES)).cast("int")).select("cluster", "blocks")
    dealt = loose.join(sizes, "cluster").select("id", "cluster", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    # the texts are dealt by id at every size: a join that sends the smaller side to all would be one at small sizes only
    whole = texts.withColumnRenamed("doc_id", "id").join(dealt.hint("merge"), "id").select("id", "cluster", "block", "blocks", "text").mapInArrow(kernel.freed(_whole), "id long, cluster long, block int, blocks int, shingles binary")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    tiles = whole.withColumn("pair", F.explode(pairs)).select("cluster", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "block", "id", "shingles")
    near = tiles.groupBy("cluster", "i", "j").applyInArrow(kernel.freed(_tile(link)), "a long, b long")
    out = components(near.unionByName(same), name="links")
    storage.drop(loose)
    storage.release()
    return sketches, out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    sketches, linked = links(docs, link=LINK)
    found = sketches.select("doc_id", "n_shingles").join(linked.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """The documents without those that a document of a smaller id stands for; of rows with one id, all stay."""
    _, linked = links(docs, link=link)
    gone = linked.where("component <> id").select(F.col("id").alias("doc_id"))
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
