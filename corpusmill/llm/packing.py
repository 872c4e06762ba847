"""Packing by cutting stock: column generation over a histogram of piece lengths.

Each document's ids (its text's, then the end id) are cut into pieces of at most `capacity`.  Piece lengths are rounded
up to `grain` tokens, which leaves a histogram of at most capacity/grain bins, however many documents there are; that is
all the driver sees.  A linear program over packing patterns is solved by column generation (an integer knapsack by
dynamic programming prices the columns), the pattern counts are rounded down, and what is left is packed greedily on
the histogram.  Pieces are ranked within their bin - by a running count in each input partition plus the sum of earlier
partitions, so that no bin is gathered anywhere - and the r-th piece of a bin takes the r-th place the patterns offer it.

Null text: empty, so one piece holding only the end id.  Null doc_id: packed as any other, doc_id stays null.  Repeated
rows are packed each.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel, storage, tokens

CAPACITY = 4096
GRAIN = 16
END_ID = 2

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, part int, nth long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full ones, then the rest."""
    return [(at, min(capacity, n - at)) for at in range(0, n, capacity)]


def _pieces(path: str, capacity: int, grain: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        tokenizer = tokens.tokenizer(path)
        seen: dict[int, int] = {}
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id")
            rows: list[tuple] = []
            for row, found in tokenizer.encode(batch.column("text")):
                n = len(found) + 1
                for start, length in cut(n, capacity):
                    crc = zlib.crc32(found[start : start + length].astype("<u4", copy=False).tobytes())
                    if start + length == n:
                        crc = zlib.crc32(tail, crc)
                    b = -(-length // grain)
                    nth = seen.get(b, 0)
                    seen[b] = nth + 1
                    rows.append((row, start, length, crc, n, b, nth))
            if rows:
                at, start, length, crc, n, b, nth = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)).cast(pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int32()), pa.array([part] * len(at), pa.int32()), pa.array(nth, pa.int64())],
                    names=[x.split()[0] for x in _PIECES.split(", ")],
                )

    return run


def best_pattern(price: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: how many of each size (1..room) to take for the highest total price."""
    value = np.zeros(room + 1)
    take = np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        options = price[1 : c + 1] + value[c - 1 :: -1]
        k = int(options.argmax())
        if options[k] > value[c - 1]:
            value[c], take[c] = options[k], k + 1
        else:
            value[c] = value[c - 1]
    used, c = np.zeros(room + 1, np.int64), room
    while c > 0:
        if take[c]:
            used[take[c]] += 1
            c -= take[c]
        else:
            c -= 1
    return float(value[room]), used


def solve(demand: dict[int, int], room: int, steps: int = 3000) -> list[tuple[np.ndarray, float]]:
    """The linear program: patterns and how often to use each, so that every bin's demand is met exactly.

    A pattern enters only while it is worth more than one sequence; should `steps` patterns not be enough, which is said in
    a warning, the program's last solution costs more padding and loses no piece.  The basis inverse is updated in product form; plan() only ever uses what demand is left, so a rounding error in it
    costs a little padding and no piece.
    """
    sizes = sorted(b for b, n in demand.items() if n > 0)
    if not sizes:
        return []
    m = len(sizes)
    want = np.array([demand[b] for b in sizes], float)
    basis = np.diag([float(room // b) for b in sizes])
    inverse = np.diag([1.0 / (room // b) for b in sizes])
    for _ in range(steps):
        x = inverse @ want
        dual = inverse.sum(axis=0)
        price = np.full(room + 1, -1.0)
        price[sizes] = dual
        worth, used = best_pattern(price, room)
        if worth <= 1 + 1e-7:
            break
        column = used[sizes].astype(float)
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
    else:
        warnings.warn(f"the linear program was left after {steps} patterns, before its optimum", stacklevel=2)
    x = inverse @ want
    patterns = []
    for k in range(m):
        pattern = np.zeros(room + 1, np.int64)
        pattern[sizes] = np.rint(basis[:, k]).astype(np.int64)
        patterns.append((pattern, float(x[k])))
    return patterns


def plan(demand: dict[int, int], room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that take exactly the demand: the program's, rounded down, then the rest first-fit.

    What rounding leaves is less than one use of each pattern, so it is bounded by the number of bins.
    """
    left = np.zeros(room + 1, np.int64)
    for b, n in demand.items():
        left[b] = n
    out = []
    for pattern, x in sorted(solve(demand, room), key=lambda p: -p[1]):
        need = pattern > 0
        n = int(min(np.floor(x + 1e-6), (left[need] // pattern[need]).min())) if need.any() else 0
        if n > 0:
            left -= n * pattern
            out.append((pattern, n))
    while left.any():
        pattern, space = np.zeros(room + 1, np.int64), room
        while space:
            fits = np.flatnonzero(left[: space + 1] > pattern[: space + 1])
            if not len(fits):
                break
            b = int(fits[-1])
            n = min(int(left[b] - pattern[b]), space // b)
            pattern[b] += n
            space -= n * b
        need = pattern > 0
        n = int((left[need] // pattern[need]).min())
        left -= n * pattern
        out.append((pattern, n))
    return out


def places(patterns: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bin: first rank of each pattern that holds it, that pattern's first sequence, pieces in a sequence."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    at: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        for b in np.flatnonzero(pattern):
            b = int(b)
            out.setdefault(b, []).append((at.get(b, 0), sequence, int(pattern[b])))
            at[b] = at.get(b, 0) + n * int(pattern[b])
        sequence += n
    return {b: tuple(np.array(x, np.int64) for x in zip(*rows)) for b, rows in out.items()}


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    path = tokenizer_path or tokens.default_path()
    pieces = storage.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kernel.freed(_pieces(path, capacity, grain, end_id)), _PIECES), "pieces")
    counts = pieces.groupBy("part", "bin").count()
    demand = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("count").alias("n")).collect()}
    spots = places(plan(demand, capacity // grain))

    earlier = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "bin", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))

    def assign(batches):
        for batch in batches:
            bins = batch.column("bin").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence = np.zeros(len(rank), np.int64)
            for b in np.unique(bins):
                first, start, per = spots[int(b)]
                mine = bins == b
                k = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine] = start[k] + (rank[mine] - first[k]) // per[k]
            keep = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"])

    ranked = pieces.join(bases, ["part", "bin"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", (F.col("base") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(kernel.freed(assign), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
