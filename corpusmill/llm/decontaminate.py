"""Benchmark decontamination: a BM25 index of the test items, asked by every training passage with block-max pruning.

Items are the indexed documents.  A posting's BM25 impact is divided by the item's own total, so a passage that holds
all of an item's words scores 1 against it, whatever its length.  Items lie in blocks of BLOCK; each term keeps its
highest impact in each block.  A passage is two neighbouring runs of as many words as the longest item has, so every
occurrence of an item lies within one.  For a passage the block maxima of its terms bound the scores of a block's items;
postings so light that together they can't reach SLACK are left out of that bound, as in WAND, and added to it as a
constant.  Only blocks whose bound reaches the threshold are scored in full, so all items above the threshold are found.
Of those, an item counts as leaked if at least OVERLAP of the five-word shingles (words without punctuation) of its question and of its answer (its
last sentence) are in the passage.

The index is built on the driver and sent with the tasks; it holds at most INDEX_BYTES of item text, and a larger
benchmark is searched in several passes, each over other items.

Null or empty texts of documents: not contaminated.  Null or empty items, or items without words, match nothing; an
item without an id counts and is found, but no id stands for it in the evidence.  Repeated items are found each; repeated rows
of documents are judged each.  Very long texts are searched passage by passage, very long items are one item each.  An
empty table gives an empty result.  Other columns are ignored or carried through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, storage

K1, B = 1.2, 0.75
BLOCK = 4
THRESHOLD = 0.6
SLACK = 0.05
OVERLAP = (80, 100)
INDEX_BYTES = 16 << 20

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])\s*(?=\S)")
#: Cells of bounds (passages x blocks) looked at in one step.
CELLS = 1 << 22


def parts(text: str) -> tuple[str, str]:
    """Question and answer: an item's last sentence is its answer, if it isn't all of it."""
    cuts = [m.end() for m in _SENTENCE.finditer(text.rstrip())]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, "")


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _alone(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first bytes of characters that are words of their own, and of those that are marks.

    Scripts without spaces (U+3000 to U+DFFF, where Chinese, Japanese and Korean ones are, and full-width forms) have a
    word in each character; their marks, and the general ones (U+2000 to U+206F), are in no word.
    """
    lead = np.flatnonzero(data >= 0xE2)
    lead = lead[lead + 2 < len(data)]
    first, second, third = data[lead], data[lead + 1], data[lead + 2]
    code = (first.astype(np.int32) & 15) << 12 | (second.astype(np.int32) & 63) << 6 | third.astype(np.int32) & 63
    three = (first < 0xF0) & (second >> 6 == 2) & (third >> 6 == 2)
    mark = three & ((code >> 6 == 0x2000 >> 6) | (code >= 0x2040) & (code < 0x2070) | (code >= 0x3000) & (code < 0x3005) | (code >= 0x3008) & (code < 0x3021) | (code >= 0xFF00) & (code < 0xFF10) | (code >= 0xFF1A) & (code < 0xFF21) | (code >= 0xFF3B) & (code < 0xFF41) | (code >= 0xFF5B) & (code < 0xFF66) | (code == 0x30FB))
    alone = three & ~mark & (code >= 0x3000) & (code < 0xFFF0) & ~((code >= 0xE000) & (code < 0xF900))
    return lead[alone], lead[mark]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, and where each text's begin: runs of letters and digits, lower-cased.

    Marks that a passage was pasted next to belong to no word; in scripts without spaces each character is a word.
    """
    data = kernel.LOWER[data]
    alone, marks = _alone(data) if len(data) and data.max() >= 0xE2 else (np.zeros(0, np.int64),) * 2
    if not len(alone) and not len(marks):
        starts, ends, of = kernel.runs(data, at, _WORD)
    else:
        # bytes of such characters and marks end the runs around them
        other = data.copy()
        for k in range(3):
            other[alone + k] = 32
            other[marks + k] = 32
        starts, ends, _ = kernel.runs(other, at, _WORD)
        starts, ends = np.concatenate([starts, alone]), np.concatenate([ends, alone + 3])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        of = np.searchsorted(starts, at)
    return kernel.span(data, kernel.rolling(data), starts, ends), of


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return words(data, np.array([0, len(data)]))[0]


def _grams(words: np.ndarray, n: int = kernel.SHINGLE) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for t in range(n):
        out += words[t : t + len(out)] * kernel._STEP[t]
    return kernel.mix(out + np.uint64(n))


class Index:
    def __init__(self, ids: list, texts: list[str]):
        kept = [(i, t, w) for i, t in zip(ids, texts) if t and len(w := _words(t))]
        kept.sort(key=lambda x: len(x[2]))
        self.ids = [x[0] for x in kept]
        self.grams: list[tuple[int, np.ndarray, np.ndarray]] = []
        tf, length = [], np.array([len(x[2]) for x in kept], float)
        self.run = int(max(length, default=1))
        for _, text, words in kept:
            n = min(kernel.SHINGLE, len(words))
            grams = _grams(words, n)
            answer = len(_words(parts(text)[1]))
            # shingles that end in the answer are its own; a question of fewer words than a shingle has none
            cut = max(0, len(words) - answer - n + 1) if answer else len(grams)
            self.grams.append((n, np.unique(grams[:cut]), np.unique(grams[cut:])))
            tf.append(np.unique(words, return_counts=True))
        self.items = len(kept)
        self.blocks = -(-self.items // BLOCK)
        self.vocabulary = np.unique(np.concatenate([t for t, _ in tf])) if tf else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(self.items), [len(t) for t, _ in tf])
        term = np.searchsorted(self.vocabulary, np.concatenate([t for t, _ in tf])) if tf else np.zeros(0, np.int64)
        count = np.concatenate([c for _, c in tf]).astype(float) if tf else np.zeros(0)
        df = np.bincount(term, minlength=len(self.vocabulary))
        idf = np.log1p((self.items - df + 0.5) / (df + 0.5))
        impact = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[item] / max(length.mean() if len(length) else 1, 1)))
        impact /= np.bincount(item, weights=impact, minlength=self.items)[item]
        order = np.lexsort((item, term))
        self.term, self.item, self.impact = term[order], item[order], impact[order]
        self.cut = np.searchsorted(self.term, np.arange(len(self.vocabulary) + 1))
        # block maxima; of each block the lightest, up to SLACK in sum, are left to the constant
        pair = self.term * max(self.blocks, 1) + self.item // BLOCK
        pairs, first = np.unique(pair, return_index=True)
        top = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        block = pairs % max(self.blocks, 1)
        order = np.lexsort((top, block))
        total = np.cumsum(top[order])
        begin = np.searchsorted(block[order], np.arange(self.blocks))
        base = np.where(begin > 0, total[np.maximum(begin, 1) - 1], 0.0)
        heavy = np.zeros(len(pairs), bool)
        heavy[order] = total - base[block[order]] > SLACK
        self.bound_term, self.bound_block, self.bound = pairs[heavy] // max(self.blocks, 1), block[heavy], top[heavy]
        self.bound_cut = np.searchsorted(self.bound_term, np.arange(len(self.vocabulary) + 1))
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and terms of the words that any item has."""
        at = np.flatnonzero(self.likely[(h >> np.uint64(44)).astype(np.int64)])
        term = np.searchsorted(self.vocabulary, h[at])
        hit = term < len(self.vocabulary)
        hit[hit] = self.vocabulary[term[hit]] == h[at][hit]
        return at[hit], term[hit]

    def candidates(self, unit: np.ndarray, term: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first unit, block) of the passages and blocks whose bound reaches the threshold.

        unit, term: of the known words; follows: whether a unit and the next one are one passage's halves.
        """
        units, width = len(follows), len(self.vocabulary)
        # a word of a unit also belongs to the passage that begins one unit before
        second = np.flatnonzero((unit > 0) & follows[np.maximum(unit, 1) - 1])
        key = np.unique(np.concatenate([unit * width + term, (unit[second] - 1) * width + term[second]]))
        passage, term = key // width, key % width
        found = []
        # some passages at a time, so that the bounds take no more memory with more items
        step = max(1, CELLS // self.blocks)
        cuts = np.searchsorted(passage, np.arange(0, units + step, step))
        for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if lo == hi:
                continue
            size = self.bound_cut[term[lo:hi] + 1] - self.bound_cut[term[lo:hi]]
            to = np.cumsum(size)
            at = np.arange(to[-1]) - np.repeat(to - size - self.bound_cut[term[lo:hi]], size)
            bound = np.bincount(np.repeat(passage[lo:hi] - k * step, size) * self.blocks + self.bound_block[at], weights=self.bound[at])
            found.append(np.flatnonzero(bound >= THRESHOLD - SLACK - 1e-9) + k * step * self.blocks)
        return np.divmod(np.concatenate(found) if found else np.zeros(0, np.int64), self.blocks)

    def above(self, term: np.ndarray, blocks: np.ndarray) -> list[tuple[int, float]]:
        """Items of some blocks that a passage's distinct terms score at or above the threshold, with their scores."""
        size = self.cut[term + 1] - self.cut[term]
        to = np.cumsum(size)
        at = np.arange(to[-1] if len(to) else 0) - np.repeat(to - size - self.cut[term], size)
        at = at[np.isin(self.item[at] // BLOCK, blocks)]
        items, inverse = np.unique(self.item[at], return_inverse=True)
        score = np.bincount(inverse, weights=self.impact[at], minlength=len(items))
        keep = score >= THRESHOLD - 1e-9
        return list(zip(items[keep].tolist(), score[keep].tolist()))

    def leaked(self, item: int, words: np.ndarray, memo: dict) -> bool:
        n, question, answer = self.grams[item]
        if n not in memo:
            memo[n] = _grams(words, n)
        return all(int(np.isin(own, memo[n]).sum()) * OVERLAP[1] >= OVERLAP[0] * len(own) for own in (question, answer))


def _search(index: Index):
    def run(batches):
        for batch in batches:
            for lo, hi, data, at in kernel.chunks(batch.column("text"), kernel.ROLLING_BYTES):
                h, of = words(data, at)
                n = np.diff(of)
                found: list[dict] = [{} for _ in range(hi - lo)]
                if len(h) and index.items:
                    halves = -(-n // index.run)
                    base = np.cumsum(halves) - halves
                    doc = np.repeat(np.arange(hi - lo), n)
                    unit = base[doc] + (np.arange(len(h)) - of[doc]) // index.run
                    place, term = index.known(h)
                    owner = np.repeat(np.arange(hi - lo), halves)
                    follows = np.append(owner[1:] == owner[:-1], False)
                    first, block = index.candidates(unit[place], term, follows)
                    cuts = np.searchsorted(unit[place], np.arange(len(owner) + 1))
                    for u in np.unique(first).tolist():
                        last = u + 1 + bool(follows[u])
                        d = int(owner[u])
                        begin = of[d] + (u - base[d]) * index.run
                        passage, memo = h[begin : min(of[d + 1], begin + (last - u) * index.run)], {}
                        for item, score in index.above(np.unique(term[cuts[u] : cuts[last]]), block[first == u]):
                            if index.leaked(item, passage, memo):
                                found[d][item] = max(score, found[d].get(item, 0.0))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(lo, hi - lo),
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array([sorted(index.ids[i] for i in f if index.ids[i] is not None) for f in found], pa.list_(pa.int64())),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([max(f.values(), default=0.0) for f in found], pa.float64()),
                    ],
                    names=["key", "doc_id", "item_ids", "n_items", "top_score"],
                )

    return run


_FOUND = "key long, doc_id long, item_ids array<long>, n_items long, top_score double"


def _indexes(benchmark: DataFrame, most: int) -> list[Index]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = int(size // most + 1)
    for p in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        yield Index([r["item_id"] for r in rows], [r["text"] for r in rows])


def find(docs: DataFrame, benchmark: DataFrame, most: int = INDEX_BYTES) -> DataFrame:
    """doc_id, contaminated, item_ids, n_items, top_score of every document."""
    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64("doc_id", text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = [rows.mapInArrow(kernel.freed(_search(index)), _FOUND) for index in _indexes(benchmark, most)]
    if len(found) == 1:
        out = found[0]
    else:
        # each pass has every row, repeated rows alike, so their number is that of one pass
        out = found[0].withColumn("nth", F.lit(0))
        for n, x in enumerate(found[1:], 1):
            out = out.unionByName(x.withColumn("nth", F.lit(n)))
        copies = F.count(F.when(F.col("nth") == 0, 1))
        out = out.groupBy("key", "doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), (F.sum("n_items") / copies).cast("long").alias("n_items"), F.max("top_score").alias("top_score"), copies.alias("copies"))
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "item_ids", "n_items", "top_score")


def clean(docs: DataFrame, benchmark: DataFrame, most: int = INDEX_BYTES) -> DataFrame:
    """The documents that hold no test item, with all their columns; no shuffle."""
    out, begun = docs, False
    for index in _indexes(benchmark, most):
        # one pass at a time: each would keep a Python process in every task
        out = storage.save(out, "cleaned") if begun else out
        begun = True

        def run(batches, search=_search(index)):
            for batch in batches:
                text = batch.column("text")
                column = pa.array([0] * len(text), pa.int64())
                asked = pa.RecordBatch.from_arrays([column, column, text.cast(pa.string())], names=["key", "doc_id", "text"])
                leaks = [x for part in search([asked]) for x in part.column("n_items").to_pylist()]
                yield batch.filter(pa.array([not x for x in leaks], pa.bool_()))

        out = out.mapInArrow(kernel.freed(run), docs.schema)
    return out
