"""Language-model scores of whole documents: a gated recurrent network beside the add-one unigram base.

Counts of all words of all training documents are one table, spread over the cluster.  The network knows the most
frequent `CLASSES * SIZE - 2` words, the end, and one place for all others; a word there is told apart by its add-one
share among them, so the model is a distribution over the same words as the base.  It is trained by parameter averaging
in one pass: every training document, as numbers of words, belongs to one of ROUNDS rounds and to one of its shards, of
SHARD documents on average, so that shards grow with the table; each shard runs truncated backpropagation on its own,
and the averages start the next round.

Scoring keeps a bounded table of at most TABLE most frequent words at hand; rarer words of a document are listed and
joined to the counts.  A text's state is carried through all of its windows.

Null or empty texts are the end alone.  Null ids: scored, not held out, and not learned from.  Repeated rows count and
are scored each.  Very long texts are read whole; they make a task longer, not larger.  Of words equally frequent at
the edge of the known ones, those of the smaller hashes are known.  Without training documents N and V are 0.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru, kernel, storage

FOLDS, HELD = 7, 2
CLASSES, SIZE = 32, 64
TABLE = 1 << 18
SHARD = 2_500
ROUNDS = 3
#: Words that the network scores at once, many texts side by side.
SCORED_WORDS = 4_000_000
#: Sums of parameters that one task adds up at most.
FAN = 32
CHUNK_BYTES = 8 << 20
#: Distinct words held while a partition is counted.
HOLD = 2_000_000

END = np.uint64(0x1B873593CC9E2D51)
_END_ID, _OTHER_ID = 0, 1


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, each text closed by the end, and where each text's begin."""
    s, e, of = kernel.words(data, at)
    h = kernel.hashes(data, s, e)
    n = np.diff(of)
    to = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(to[-1], END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, to


def _count(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        h, c = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h)
        h, c = h[order], c[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return h[first], np.add.reduceat(c, first)

    for batch in batches:
        for _, _, data, at in kernel.chunks(batch.column("text"), CHUNK_BYTES):
            held.append(np.unique(tokens(data, at)[0], return_counts=True))
            size += len(held[-1][0])
            if size > HOLD:
                held = [merged()]
                size = len(held[0][0])
                if size > HOLD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["h", "c"])
                    held, size = [], 0
    if held:
        h, c = merged()
        for lo in range(0, len(h), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + (1 << 17)].view(np.int64)), pa.array(c[lo : lo + (1 << 17)])], names=["h", "c"])


class Words:
    """The frequent words: counts, and the network's number of each."""

    def __init__(self, h: np.ndarray, c: np.ndarray, n: int, v: int):
        """h, c: in order of falling counts; n, v: all tokens and distinct tokens."""
        self.n, self.v = n, v
        end = h == END
        ends = int(c[end].sum())
        known = np.flatnonzero(~end)[: CLASSES * SIZE - 2]
        number = np.full(len(h), _OTHER_ID, np.int64)
        number[known] = np.arange(len(known)) + 2
        number[end] = _END_ID
        self.frequency = np.zeros(CLASSES * SIZE)
        self.frequency[2 : 2 + len(known)] = c[known]
        self.frequency[_END_ID] = ends
        inside = int(c[known].sum()) + ends
        self.frequency[_OTHER_ID] = n - inside
        # add-one mass of all words that share the one place, an unseen word among them
        self.others = (n - inside) + (v - len(known) - int(end.sum())) + 1
        order = np.argsort(h)
        self.h, self.c, self.number = h[order], c[order], number[order]
        self.shift = np.uint64(64 - 18)
        self.start = np.searchsorted(self.h >> self.shift, np.arange((1 << 18) + 1, dtype=np.uint64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the table, or -1."""
        if not len(self.h):
            return np.full(len(h), -1)
        bucket = (h >> self.shift).astype(np.int64)
        at, stop = self.start[bucket], self.start[bucket + 1]
        out = np.full(len(h), -1)
        left = np.flatnonzero(at < stop)
        while len(left):
            here = at[left]
            same = self.h[here] == h[left]
            out[left[same]] = here[same]
            at[left] += 1
            left = left[~same & (at[left] < stop[left])]
        return out

    def numbers(self, place: np.ndarray, h: np.ndarray) -> np.ndarray:
        found = np.where(place >= 0, self.number[place] if len(self.h) else _OTHER_ID, _OTHER_ID)
        found[h == END] = _END_ID
        return found


def _number(words: Words):
    """Each text as numbers of two bytes a word."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in kernel.chunks(batch.column("text"), CHUNK_BYTES):
                h, of = tokens(data, at)
                ids = words.numbers(words.find(h), h).astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column("round").slice(lo, hi - lo), batch.column("shard").slice(lo, hi - lo), pa.array([ids[a:b].tobytes() for a, b in zip(of[:-1], of[1:])], pa.binary())], names=["round", "shard", "ids"])

    return run


def _train(model: gru.Params):
    def run(key, table):
        ids = table.column("ids").combine_chunks()
        data, at = kernel.raw(ids)
        words = data.view("<u2") if data.flags.aligned else np.frombuffer(data.tobytes(), "<u2")
        found = gru.train(model, words, at // 2, _END_ID)
        return pa.table({"weight": pa.array([float(len(words))]), "model": pa.array([gru.pack(found)], pa.binary())})

    return run


def fit(training: DataFrame, words: Words, documents: int) -> tuple[gru.Params, list[int]]:
    """The network after one pass over all training documents, and how many words each round learned from."""
    model, learned = gru.start(words.frequency, SIZE), []
    if not documents:
        return model, learned
    shards = max(1, round(documents / ROUNDS / SHARD))
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "doc_id", "text"), F.lit(n)).alias(salt)
    numbered = storage.save(training.select(draw("round", ROUNDS), draw("shard", shards), "text").mapInArrow(kernel.freed(_number(words)), "round long, shard long, ids binary"), "numbered")
    # parameters are of one size, and are summed where they are
    size = len(gru.pack(model))
    for k in range(ROUNDS):
        # a shard is a task of its own
        dealt = numbered.where(F.col("round") == k).repartition(shards, "shard")
        parts = dealt.groupBy("shard").applyInArrow(kernel.freed(_train(model)), "weight double, model binary").mapInArrow(kernel.freed(_partial_sum(size)), "weight double, model binary")
        left = shards
        while True:
            left = -(-left // FAN)
            parts = parts.repartition(left).mapInArrow(kernel.freed(_partial_sum(size)), "weight double, model binary")
            if left == 1:
                break
        part = parts.collect()[0]
        learned.append(int(part["weight"]))
        if learned[-1]:
            mean = (np.frombuffer(part["model"], "<f8") / part["weight"]).astype("<f4")
            model = gru.unpack(mean.tobytes(), model)
    storage.drop(numbered)
    return model, learned


def _score(words: Words, model: gru.Params):
    ten = np.log(10)

    def scored(held: list[tuple]):
        """Batches of rows, with the network's part of all of them."""
        number = np.concatenate([x for _, x, _ in held])
        of = np.concatenate([[0], np.cumsum(np.concatenate([n for _, _, n in held]))])
        network = gru.score(model, number, of, _END_ID) / ten
        at = 0
        for columns, _, n in held:
            yield pa.RecordBatch.from_arrays([*columns[:5], pa.array(columns[5] + network[at : at + len(n)]), *columns[6:]], names=[x.split()[0] for x in _SCORED.split(", ")])
            at += len(n)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for lo, hi, data, at in kernel.chunks(batch.column("text"), CHUNK_BYTES):
                h, of = tokens(data, at)
                place = words.find(h)
                number = words.numbers(place, h)
                count = np.where(place >= 0, words.c[place] if len(words.c) else 0, 0)
                logs = np.concatenate([[0.0], np.cumsum(np.log10(count + 1.0))])
                other = number == _OTHER_ID
                logs_other = np.concatenate([[0.0], np.cumsum(np.where(other, np.log10(count + 1.0), 0.0))])
                seen = np.concatenate([[0], np.cumsum(count > 0)])
                others = np.concatenate([[0], np.cumsum(other)])
                part = lambda x: x[of[1:]] - x[of[:-1]]
                # words beyond the table: told apart by the counts on the cluster
                rare = np.flatnonzero((place < 0) & (h != END))
                text = np.searchsorted(of, rare, "right") - 1
                order = np.lexsort((h[rare], text))
                rare, text = rare[order], text[order]
                new = np.append(True, (h[rare][1:] != h[rare][:-1]) | (text[1:] != text[:-1])) if len(rare) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                offsets = pa.array(np.searchsorted(text[first], np.arange(hi - lo + 1)), pa.int32())
                columns = [
                    batch.column("doc_id").slice(lo, hi - lo), batch.column("rid").slice(lo, hi - lo), pa.array(np.diff(of)), pa.array(part(seen)), pa.array(part(logs)), part(logs_other) - part(others) * np.log10(words.others),
                    pa.ListArray.from_arrays(offsets, pa.array(h[rare][first].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(np.diff(first, append=len(rare)), pa.int64())),
                ]
                held.append((columns, number.astype("<u2"), np.diff(of)))
                size += len(number)
                if size >= SCORED_WORDS:
                    yield from scored(held)
                    held, size = [], 0
        if held:
            yield from scored(held)

    return run


_SCORED = "doc_id long, rid long, n_tokens long, n_seen long, logs double, network double, rare array<long>, times array<long>"


def frequent(counts: DataFrame, most: int = TABLE, known: int = CLASSES * SIZE) -> pa.Table:
    """(h, c) of at most `most` frequent words, most frequent first: those of the upper bins of a histogram of counts.

    The known words are among them; a bin that alone exceeds the bound is left to the join.
    """
    level = F.floor(F.log2("c") * 16)
    bins = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    floor, held = None, 0
    for x in sorted(bins, reverse=True):
        held += bins[x]
        if held > most:
            break
        floor = x
    top = counts.where(level >= floor) if floor is not None else counts.limit(0)
    found = top.toArrow().combine_chunks()
    if len(found) < min(known, sum(bins.values())):
        found = counts.orderBy(F.desc("c"), "h").limit(known).toArrow().combine_chunks()
    return found.sort_by([("c", "descending"), ("h", "ascending")])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = kernel.crc_of_decimal("doc_id") % FOLDS
    training = rows.where(fold != HELD)
    counts = storage.save(training.select("text").mapInArrow(kernel.freed(_count), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    top = frequent(counts)
    words = Words(top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy(), n, v)

    documents = training.count()
    model, _ = fit(training, words, documents)
    scored = storage.save(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(kernel.freed(_score(words, model)), _SCORED), "scored")
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    joined = rare.join(counts, "h")
    sums = joined.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("more_seen"))
    out = scored.select("doc_id", "rid", "n_tokens", "n_seen", "logs", "network").join(sums, "rid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        F.coalesce(fold == HELD, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_seen") + F.coalesce("more_seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("network") + more).alias("score"),
    )


def _partial_sum(size: int):
    """Sums of weighted parameter vectors (as doubles) of a partition."""

    def run(batches):
        total, weight = np.zeros(size // 4), 0.0
        for batch in batches:
            for w, m in zip(batch.column("weight").to_pylist(), batch.column("model")):
                data = m.as_buffer()
                total += np.frombuffer(data, "<f4") * w if len(data) == size else np.frombuffer(data, "<f8")
                weight += w
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tobytes()], pa.binary())], names=["weight", "model"])

    return run
