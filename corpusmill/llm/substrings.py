"""Exact removal of repeated byte strings by suffix arrays of routed pieces.

Every `length`-byte string that also starts in a document of a smaller id is removed from a document.

1. Documents are written to the shared folder in chunks (row groups of Parquet files); texts move no more after that.
2. Each string of `length` bytes has a minimizer - the least hash of its GRAM-byte grams - so equal strings have equal
   ones.  Runs of strings with one minimizer are a piece of text.  Equal pieces of a task are folded where they are read:
   all but those of the smallest document are repeats as a whole.  Of each other piece only its minimizer, a hash of its
   bytes and its place go to the minimizer's bucket.  There, pieces whose minimizer is in one document only are left out;
   equal pieces are folded again; pieces that have a minimizer in common with a different piece go on, one document for
   each.
3. Those pieces are fetched from their chunks and dealt to shards by minimizer.  A shard is sorted by external induced
   sorting (see `induced`), whose common prefixes bound the groups of equal strings; strings of a group that are not in
   its smallest document are repeats.
4. Each chunk gets its repeats, marks their bytes, and returns what is left.

Hot minimizers, such as those at the edges of a passage that a third of all documents share amid different neighbours,
would bring all their pieces to one bucket and shard.  They are told by a sample of chunks that grows with the square
root of the table, which settles the plan and no result: their pieces are cut into single strings, which are dealt and
folded by a hash of all their bytes, so that a task sends one of each kind.

Two pieces count as equal if 32 bits of their minimizers beside the bucket and the hashes of their bytes (64 bits, of
another kind) are; longer pieces than the hash can tell apart have a cryptographic one.  All other equalities are by
bytes.

A task holds a bucket of about BUCKET_BYTES; a shard is streamed to the sorter's files and never held as a whole.

Null or empty texts: nothing to remove.  Null ids: such a document is no smaller document, and nothing is removed from
it.  Rows of the same id are no smaller documents to each other; each is returned.  Texts shorter than `length` stay
whole.  An empty table gives an empty result.  Other columns, whatever their names, are ignored or carried through.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import induced, kernel, storage

LENGTH = 50
GRAM = 16
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 50_000
BUCKET_BYTES = 10 << 20
SHARD_BYTES = 3 << 20
TASK_BYTES = 16 << 20
#: Text whose pieces are found in one step.
STEP_BYTES = 1 << 20
#: Chunks whose pieces are folded together.
FOLD = 4
#: Of suffix tuples and names held in memory while a shard is sorted; beyond it they are on disk.
SORT_MEMORY = 48 << 20
#: A minimizer is hot if so many different pieces of the sampled chunks have it.
HOT = 64

_PIECE = np.dtype([("h", "<u8"), ("c", "<u8"), ("a", "<u4"), ("n", "<u2"), ("d", "<u2")])
_PLACE = np.dtype([("h", "<u8"), ("doc", "<i8"), ("a", "<u4"), ("n", "<u2"), ("d", "<u2")])
_SPAN = np.dtype([("a", "<u4"), ("n", "<u2"), ("d", "<u2")])
_RUN = 60_000
_BITS = np.uint64((1 << 48) - 1)


def pieces(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM, hot: np.ndarray | None = None) -> np.ndarray:
    """Pieces (minimizer, hash of bytes, first string, how many strings, text) of texts.

    hot: minimizers (sorted) whose pieces are cut into their strings.
    """
    if len(data) < length:
        return np.zeros(0, _PIECE)
    sums, down = kernel.rolling(data)
    least = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    least ^= least >> np.uint64(29)
    least *= np.uint64(0xBF58476D1CE4E5B9)
    wide, w = 1, length - gram + 1
    while wide * 2 <= w:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < w:
        least = np.minimum(least[: -(w - wide)], least[w - wide :])
    # strings that reach into the next text are none
    n = np.diff(at)
    solid = np.ones(len(least) + 1, np.int8)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, np.maximum(at[1:] - length + 1, at[:-1]), 1)
    np.add.at(edge, at[1:], -1)
    solid[:-1] = np.cumsum(edge)[: len(least)] == 0
    solid[-1] = 0
    fresh = np.empty(len(least), bool)
    fresh[0] = True
    np.not_equal(least[1:], least[:-1], out=fresh[1:])
    fresh[1:] |= solid[:-2] == 0
    first = at[:-1][n >= length]
    fresh[first] = True
    fresh &= solid[:-1] > 0
    begin = np.flatnonzero(fresh)
    stop = np.flatnonzero((solid[:-1] > 0) & (np.append(fresh[1:], True) | (solid[1:] == 0))) + 1
    count = stop - begin
    if len(count) and count.max() > _RUN:
        # long runs, of texts that repeat one gram over and over, are cut
        cuts = -(-count // _RUN)
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        end = np.repeat(stop, cuts)
        begin = np.repeat(begin, cuts) + nth * _RUN
        count = np.minimum(end - begin, _RUN)
    h = kernel.mix(least[begin]) & _BITS
    if hot is not None and len(hot) and len(h):
        place = np.searchsorted(hot, h)
        some = (place < len(hot)) & (hot[np.minimum(place, len(hot) - 1)] == h)
        if some.any():
            size = np.where(some, count, 1)
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            some, h = np.repeat(some, size), np.repeat(h, size)
            begin, count = np.repeat(begin, size) + nth, np.where(some, 1, np.repeat(count, size))
            own = begin[some]
            h[some] = kernel.span(data, (sums, down), own, own + length, 7) & _BITS
    out = np.empty(len(begin), _PIECE)
    out["h"] = h
    out["c"] = kernel.span(data, (sums, down), begin, begin + count + length - 1)
    d = np.searchsorted(at, begin, "right") - 1
    out["a"], out["n"], out["d"] = begin - at[d], count, d
    return out


def _parts(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes."""
    lo = 0
    while lo < len(at) - 1:
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1), len(at) - 1)
        yield lo, hi
        lo = hi


def _opened(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _store(root: str):
    def run(batches):
        import pyarrow.parquet as pq

        system, base = _opened(root)
        system.create_dir(base, recursive=True)
        path, writer, made = f"{base}/{uuid.uuid4().hex}.parquet", None, []
        for batch in batches:
            _, at = kernel.raw(batch.column("text"))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_BYTES, "right")) - 1)
                hi = min(hi, batch.num_rows, lo + CHUNK_ROWS)
                if writer is None:
                    writer = pq.ParquetWriter(path, batch.schema, filesystem=system, compression="zstd")
                writer.write_batch(batch.slice(lo, hi - lo), row_group_size=CHUNK_ROWS)
                made.append((f"{path}#{len(made)}", hi - lo, int(at[hi] - at[lo])))
                lo = hi
        if made:
            writer.close()
            chunk, rows, size = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(rows, pa.int64()), pa.array(size, pa.int64())], names=["chunk", "rows", "bytes"])

    return run


def _chunk(root: str, chunk: str, columns: list[str] | None = None) -> pa.Table:
    import pyarrow.parquet as pq

    path, _, group = chunk.rpartition("#")
    with _opened(root)[0].open_input_file(path) as f:
        return pq.ParquetFile(f).read_row_group(int(group), columns=columns)


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("doc_id").combine_chunks()
    return ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null())


def _shed(x: np.ndarray) -> list[np.ndarray]:
    """Halves of a column of numbers, low and high: the high ones are mostly equal, which compresses."""
    half = {2: "u1", 4: "<u2", 8: "<u4"}[x.itemsize]
    both = np.ascontiguousarray(x).view(half).reshape(len(x), 2)
    return [both[:, 0], both[:, 1]]


def _written(rows: np.ndarray, ids: np.ndarray) -> bytes:
    """Pieces in order of their texts, column by column, with the ids of the texts."""
    fresh = np.append(True, rows["d"][1:] != rows["d"][:-1])
    docs = rows["d"][fresh]
    columns = [rows["h"].astype("<u4"), rows["c"], *_shed(rows["a"]), *_shed(rows["n"]), fresh.astype("u1"), docs, *_shed(ids[docs].astype("<i8"))]
    return np.array([len(rows), len(docs)], "<u4").tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _read(blob) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and the ids of their texts."""
    n, m = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    at = 8

    def column(kind: str, size: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(blob, kind, size, at)
        at += x.nbytes
        return x

    rows = np.empty(n, _PIECE)
    rows["h"] = column("<u4", n)
    rows["c"] = column("<u8", n)
    rows["a"] = column("<u2", n)
    rows["a"] |= column("<u2", n).astype("<u4") << np.uint32(16)
    rows["n"] = column("u1", n)
    rows["n"] |= column("u1", n).astype("<u2") << np.uint16(8)
    own = np.cumsum(column("u1", n)) - 1
    rows["d"] = column("<u2", m)[own]
    low, high = column("<u4", m).astype(np.int64), column("<u4", m).astype(np.int64)
    return rows, (low | high << 32)[own]


def _folded(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which pieces are repeats of equal ones of a smaller document among these."""
    out = np.zeros(len(rows), bool)
    order = np.argsort(rows["c"])
    c = rows["c"][order]
    same = c[1:] == c[:-1]
    order = order[np.append(False, same) | np.append(same, False)] if len(c) else order
    order = order[np.lexsort((rows["h"][order], rows["c"][order]))]
    if len(order):
        c, h = rows["c"][order], rows["h"][order]
        begin = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (h[1:] != h[:-1])))
        least = np.repeat(np.minimum.reduceat(docs[order], begin), np.diff(begin, append=len(order)))
        out[order] = docs[order] > least
    return out


def _cut(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal keys."""
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
    return zip(cuts[:-1], cuts[1:])


def _found_in(root: str, chunk: str, length: int, hot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a chunk's documents (but those without an id), and all ids."""
    table = _chunk(root, chunk, ["doc_id", "text"])
    ids, none = _ids(table)
    data, at = kernel.raw(table.column("text"))
    found = [np.zeros(0, _PIECE)]
    for lo, hi in _parts(at, STEP_BYTES):
        p = pieces(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], length, hot=hot)
        p["d"] += lo
        found.append(p)
    rows = np.concatenate(found)
    return rows[~none[rows["d"]]] if none.any() else rows, ids


def _spans(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), _SPAN)
    for name in ("a", "n", "d"):
        out[name] = rows[name]
    return out


_ROUTED = "bucket int, chunk string, spans binary, pieces binary"


def _route(root: str, buckets: int, length: int, hot: np.ndarray):
    """Pieces by bucket; repeats among the pieces of FOLD chunks go straight to their chunks (bucket -1 and below)."""

    def work(chunks: list[str]):
        found = [_found_in(root, chunk, length, hot) for chunk in chunks]
        rows = np.concatenate([p for p, _ in found])
        gone = _folded(rows, np.concatenate([ids[p["d"]] for p, ids in found]))
        out, at = [], 0
        for k, (chunk, (p, ids)) in enumerate(zip(chunks, found)):
            mine = gone[at : at + len(p)]
            at += len(p)
            if mine.any():
                out.append((-1 - k, chunk, _spans(p[mine]).tobytes(), b""))
            p = p[~mine]
            # what the bucket doesn't tell of a minimizer fits 32 bits; should two agree in them, they are compared
            bucket = (p["h"] % np.uint64(buckets)).astype(np.int32)
            p["h"] //= np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            p, bucket = p[order], bucket[order]
            out += [(int(bucket[lo]), chunk, b"", _written(p[lo:hi], ids)) for lo, hi in _cut(bucket)]
        b, c, s, x = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.string()), pa.array(s, pa.binary()), pa.array(x, pa.binary())], names=["bucket", "chunk", "spans", "pieces"])

    def run(batches):
        for batch in batches:
            chunks = batch.column("chunk").to_pylist()
            for lo in range(0, len(chunks), FOLD):
                yield work(chunks[lo : lo + FOLD])

    return run


def _counted(root: str, length: int):
    """(minimizer, different pieces) of sampled chunks, but of rare minimizers."""

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            for chunk in batch.column("chunk").to_pylist():
                rows = _found_in(root, chunk, length, None)[0]
                held.append(rows["h"][np.unique(rows["c"], return_index=True)[1]])
        h, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], names=["h", "n"])

    return run


#: Hot minimizers at most; the hottest, should there be more.
MOST_HOT = 1 << 20


def _hot(chunks: DataFrame, root: str, length: int) -> np.ndarray:
    """Minimizers with many different pieces, from a sample of chunks that grows with the square root of their number."""
    count = chunks.count()
    some = max(8, int(np.ceil(np.sqrt(count))))
    sample = chunks.orderBy(F.xxhash64("rows", "bytes", "chunk")).limit(some)
    found = sample.repartition(max(1, some // 4)).mapInArrow(kernel.freed(_counted(root, length)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    rows = found.orderBy(F.desc("n"), "h").limit(MOST_HOT).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().view(np.uint64))


def _split(chunks: list[str], row: np.ndarray, kind: int, data: np.ndarray):
    """(chunk, kind, blob) of the data of each row; row is sorted."""
    return [(chunks[row[lo]], kind, hi - lo, data[lo:hi].tobytes()) for lo, hi in _cut(row)]


_FOUND = "chunk string, kind int, n long, spans binary"


def _found(rows: list[tuple]) -> pa.Table:
    c, k, n, s = zip(*rows) if rows else ((), (), (), ())
    return pa.table([pa.array(c, pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.binary())], names=["chunk", "kind", "n", "spans"])


def _compare(key, table):
    """Repeats as a whole (kind 0) and pieces to compare by their bytes (kind 1) of a bucket."""
    chunks = table.column("chunk").to_pylist()
    if key[0].as_py() < 0:
        return _found([(c, 0, len(x.as_buffer()) // _SPAN.itemsize, x.as_py()) for c, x in zip(chunks, table.column("spans").combine_chunks())])
    parts = [_read(x.as_buffer()) for x in table.column("pieces").combine_chunks()]
    row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p, _ in parts])
    p, docs = (np.concatenate(x) for x in zip(*parts))
    p["h"] |= np.uint64(key[0].as_py()) << np.uint64(32)
    del parts
    # minimizers that occur once can't be shared
    order = np.argsort(p["h"])
    h = p["h"][order]
    same = h[1:] == h[:-1]
    order = order[np.append(False, same) | np.append(same, False)]
    p, docs, row = p[order], docs[order], row[order]
    order = np.lexsort((docs, p["c"], p["h"]))
    p, docs, row = p[order], docs[order], row[order]
    if not len(p):
        return _found([])
    new_h = np.append(True, p["h"][1:] != p["h"][:-1])
    new_c = new_h | np.append(True, p["c"][1:] != p["c"][:-1])
    smallest = docs[np.flatnonzero(new_c)]
    whole = docs > smallest[np.cumsum(new_c) - 1]
    group = np.cumsum(new_h) - 1
    mixed = (np.bincount(group, weights=new_c) > 1)[group] & ~whole
    # a minimizer of one document alone has nothing to compare
    begin = np.flatnonzero(new_h)
    apart = (np.minimum.reduceat(docs, begin) < np.maximum.reduceat(docs, begin))[group]
    out = []
    for k, mask in ((0, whole), (1, mixed & apart)):
        at = np.flatnonzero(mask)
        at = at[np.argsort(row[at], kind="stable")]
        spans = np.empty(len(at), _PLACE if k else _SPAN)
        for name in ("a", "n", "d"):
            spans[name] = p[name][at]
        if k:
            spans["h"], spans["doc"] = p["h"][at], docs[at]
        out += _split(chunks, row[at], k, spans)
    return _found(out)


def _fetch(root: str, shards: int, length: int):
    def run(key, table):
        chunk = key[0].as_py()
        places = np.concatenate([np.frombuffer(x.as_buffer(), _PLACE) for x in table.column("spans").combine_chunks()])
        data, at = kernel.raw(_chunk(root, chunk, ["text"]).column("text"))
        shard = (kernel.mix(places["h"]) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        places, shard = places[order], shard[order]
        start, size = at[places["d"]] + places["a"], places["n"].astype(np.int64) + length - 1
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        rows = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            to = np.cumsum(size[lo:hi])
            text = data[np.arange(to[-1]) - np.repeat(to - size[lo:hi] - start[lo:hi], size[lo:hi])]
            rows.append((int(shard[lo]), chunk, places[lo:hi].tobytes(), text.tobytes()))
        s, c, x, t = zip(*rows)
        return pa.table([pa.array(s, pa.int32()), pa.array(c), pa.array(x, pa.binary()), pa.array(t, pa.binary())], names=["shard", "chunk", "places", "bytes"])

    return run


def repeats(text: np.ndarray, stop: np.ndarray, docs: np.ndarray, length: int, scratch: induced.Scratch) -> np.ndarray:
    """Which places of a text have `length` next bytes that also start, within a piece, at one of a smaller document.

    stop, docs: where each piece ends, and its document.
    """
    gone = scratch.array(len(text), bool)

    def settle(where: np.ndarray, fresh: np.ndarray) -> None:
        fresh[:1] = True
        tied = ~(fresh & np.append(fresh[1:], True))
        where, group = where[tied], (np.cumsum(fresh) - 1)[tied]
        piece = np.searchsorted(stop, where, "right")
        inside = where + length <= stop[piece]
        where, group, d = where[inside], group[inside], docs[piece[inside]]
        if len(where):
            begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            gone[where[d > np.repeat(np.minimum.reduceat(d, begin), np.diff(begin, append=len(d)))]] = True

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for where, common in induced.sort(text, scratch.memory, length + 14):
        held.append((where, common < length))
        size += len(where)
        if size >= induced.BLOCK and (cuts := np.flatnonzero(held[-1][1])).size:
            last = int(cuts[-1])
            w, f = (np.concatenate(x) for x in zip(*held[:-1], (where[:last], held[-1][1][:last])))
            settle(w, f)
            held = [(where[last:], held[-1][1][last:])]
            size = len(where) - last
    if held:
        settle(*(np.concatenate(x) for x in zip(*held)))
    return gone


def _suffixes(length: int, memory: int = SORT_MEMORY):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = induced.Scratch(memory)
        try:
            # the text goes to a file as it comes
            chunks, places, path, total = [], [], scratch.path(), 0
            with open(path, "wb") as out:
                for batch in batches:
                    chunks += batch.column("chunk").to_pylist()
                    places += [np.frombuffer(x.as_py(), _PLACE) for x in batch.column("places")]
                    for x in batch.column("bytes"):
                        total += out.write(x.as_buffer())
            row = np.repeat(np.arange(len(places), dtype=np.int32), [len(p) for p in places])
            p = np.concatenate(places)
            del places
            text = np.memmap(path, np.uint8, "r", shape=(total,)) if total * 8 > memory else np.fromfile(path, np.uint8)
            size = p["n"].astype(np.int64) + length - 1
            stop = np.cumsum(size)
            gone = repeats(text, stop, p["doc"], length, scratch)
            # neighbours of one piece make a run
            rows = []
            for lo in range(0, len(p), 1 << 14):
                hi = min(len(p), lo + (1 << 14))
                base = int(stop[lo] - size[lo])
                at = np.flatnonzero(gone[base : int(stop[hi - 1])]) + base
                piece = np.searchsorted(stop, at, "right")
                begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1]))) if len(at) else np.zeros(0, np.int64)
                piece = piece[begin]
                spans = np.empty(len(begin), _SPAN)
                spans["a"] = p["a"][piece] + (at[begin] - (stop[piece] - size[piece]))
                spans["n"], spans["d"] = np.diff(begin, append=len(at)), p["d"][piece]
                rows += _split(chunks, row[piece], 0, spans)
            del text, gone
        finally:
            scratch.close()
            kernel.release()
        yield from _found(rows).to_batches()

    return run


def _marked(at: np.ndarray, spans: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a chunk are removed."""
    n = int(at[-1])
    start = at[spans["d"]] + spans["a"]
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + spans["n"] + length - 1, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(root: str, length: int):
    def run(key, left, right):
        table = _chunk(root, key[0].as_py(), ["doc_id", "text"])
        data, at = kernel.raw(table.column("text"))
        spans = np.concatenate([np.zeros(0, _SPAN), *(np.frombuffer(x.as_buffer(), _SPAN) for x in right.column("spans").combine_chunks())])
        gone = _marked(at, spans, length)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[at[1:]] - total[at[:-1]]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        first = at[:-1][at[:-1] < at[1:]]
        begins[first] = gone[first]
        count = np.concatenate([[0], np.cumsum(begins)])
        sha = []
        for d in range(len(at) - 1):
            own = data[at[d] : at[d + 1]]
            sha.append(hashlib.sha256(own[~gone[at[d] : at[d + 1]]] if removed[d] else own).hexdigest())
        return pa.table([table.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(np.diff(at)), pa.array(removed), pa.array(count[at[1:]] - count[at[:-1]]), pa.array(sha)], names=[x.split()[0] for x in _DIGEST.split(", ")])

    return run


def _rewrite(root: str, length: int, names: list[str]):
    def run(key, left, right):
        table = _chunk(root, key[0].as_py())
        data, at = kernel.raw(table.column("text"))
        spans = np.concatenate([np.zeros(0, _SPAN), *(np.frombuffer(x.as_buffer(), _SPAN) for x in right.column("spans").combine_chunks())])
        gone = _marked(at, spans, length)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[at[1:]] - total[at[:-1]]
        text = table.column("text").to_pylist()
        for d in np.flatnonzero(removed):
            # a character that lost some of its bytes goes with them
            text[d] = data[at[d] : at[d + 1]][~gone[at[d] : at[d + 1]]].tobytes().decode("utf-8", "ignore")
        stay = pa.array((removed == 0) | (removed < np.diff(at)))
        columns = [pa.array(text, pa.string()) if c == "text" else table.column(c).combine_chunks() for c in names]
        lengths = pa.array([None if x is None else len(x) for x in text], pa.int64())
        if "n_chars" in names:
            columns[names.index("n_chars")] = lengths.cast(table.schema.field("n_chars").type)
        return pa.table(columns, names=names).filter(stay)

    return run


def _dedup(docs: DataFrame, length: int, finish, schema) -> DataFrame:
    spark = docs.sparkSession
    root = storage.fresh_path(spark, "chunks")
    chunks = storage.save(docs.mapInArrow(kernel.freed(_store(root)), "chunk string, rows long, bytes long"), "chunklist")
    total = chunks.agg(F.sum("bytes")).first()[0]
    if total is None:
        return spark.createDataFrame([], schema)
    tasks = int(total // TASK_BYTES + 1)
    # about a byte of pieces for a byte of text
    buckets = int(total // BUCKET_BYTES + 1)
    hot = _hot(chunks, root, length)
    routed = chunks.repartition(tasks).mapInArrow(kernel.freed(_route(root, buckets, length, hot)), _ROUTED)
    found = storage.save(routed.groupBy("bucket").applyInArrow(kernel.freed(_compare), _FOUND), "found")
    storage.release()
    count = found.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    shards = int(count * (length + 20) // SHARD_BYTES + 1)
    apart = found.where("kind = 1").groupBy("chunk").applyInArrow(kernel.freed(_fetch(root, shards, length)), "shard int, chunk string, places binary, bytes binary")
    near = storage.save(apart.groupBy("shard").applyInArrow(_suffixes(length), _FOUND), "near")
    spans = found.where("kind = 0").unionByName(near)
    out = storage.save(chunks.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(kernel.freed(finish(root)), schema), "deduped")
    storage.drop(chunks, found, near)
    storage.remove(spark, root)
    storage.release()
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _dedup(rows, length, lambda root: _digest(root, length), _DIGEST)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with what is left of their texts (and n_chars, if they have it); those of which nothing is left go."""
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    return _dedup(rows, length, lambda root: _rewrite(root, length, rows.columns), rows.schema)
