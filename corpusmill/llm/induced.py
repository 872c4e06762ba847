"""External induced sorting of suffixes, with common prefixes.

Suffix tuples (position, bytes shared with the neighbour) move through bucket queues in a priority order: a heap of
symbols, and for each symbol a first-in-first-out queue that goes to disk when the queues together exceed a bound.  As
in SA-IS, the leftmost-S suffixes are sorted first: their substrings are named by an external merge sort, and the string
of names is sorted by the same induction, recursively, until it fits the bound; there, at the recursion's end, it is
sorted in memory by doubling.  L-type suffixes are then induced by an ascending scan and S-type ones by a descending
scan.  The common prefix of two suffixes that are induced into one bucket is one more than the least common prefix
between the suffixes that induce them; it is carried along in each tuple.

Types, positions, names and orders beyond `memory` bytes are mapped files in the folders that Spark gives its own spills
(SPARK_LOCAL_DIRS), removed at the end; a task that is run again starts with none of them.  The recursion holds a queue's
head for each distinct name (a few hundred bytes) besides.  All steps work on blocks of tuples, never on one at a time.

`depth` is how many bytes have to be in order: ties of that length or more stay in any order, side by side.
"""

from __future__ import annotations

import heapq
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

BATCH = 1 << 15
#: Positions looked at in one step.
BLOCK = 1 << 18
#: Common prefixes are kept up to this.
MOST = 255
#: Bytes a name takes while it is sorted in memory.
NAME_BYTES = 40


class Scratch:
    """Arrays and runs of one sort: small arrays in memory, others in files that go when it is closed."""

    def __init__(self, memory: int):
        self.memory, self.folder, self.made = memory, None, 0

    def path(self) -> str:
        if self.folder is None:
            places = [p for p in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(p)]
            self.folder = tempfile.mkdtemp(prefix="induced-", dir=places[os.getpid() % len(places)] if places else None)
        self.made += 1
        return os.path.join(self.folder, str(self.made))

    def array(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize * 8 <= self.memory:
            return np.zeros(n, kind)
        return np.memmap(self.path(), kind, "w+", shape=(n,))

    def write(self, *arrays: np.ndarray) -> str:
        path = self.path()
        with open(path, "wb") as out:
            for x in arrays:
                out.write(np.ascontiguousarray(x).data)
        return path

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = None


class Run:
    """A stretch of tuples of several fields, in memory or in a file, read in blocks from either end."""

    def __init__(self, fields: tuple[np.ndarray, ...]):
        self.n, self.kinds, self.fields, self.file = len(fields[0]), [x.dtype for x in fields], fields, None

    @property
    def nbytes(self) -> int:
        return 0 if self.fields is None else sum(x.nbytes for x in self.fields)

    def spill(self, scratch: Scratch) -> None:
        self.file, self.fields = scratch.write(*self.fields), None

    def part(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        if self.fields is not None:
            return tuple(x[lo:hi] for x in self.fields)
        out, base = [], 0
        with open(self.file, "rb") as f:
            for kind in self.kinds:
                f.seek(base + lo * kind.itemsize)
                out.append(np.frombuffer(f.read((hi - lo) * kind.itemsize), kind))
                base += self.n * kind.itemsize
        return tuple(out)

    def drop(self) -> None:
        self.fields = None
        if self.file:
            os.remove(self.file)


class Queues:
    """First-in-first-out queues of (position, common prefix) by symbol, kept on disk beyond `memory` bytes."""

    def __init__(self, scratch: Scratch, descending: bool = False):
        self.scratch, self.sign = scratch, -1 if descending else 1
        self.heap: list[int] = []
        self.runs: dict[int, list[Run]] = {}
        self.open: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def put(self, symbol: int, where: np.ndarray, shared: np.ndarray) -> None:
        if symbol not in self.open:
            self.open[symbol] = []
            heapq.heappush(self.heap, self.sign * symbol)
        self.open[symbol].append((where, shared))
        self.held += where.nbytes + shared.nbytes
        if self.held > self.scratch.memory:
            self._spill()

    def _spill(self) -> None:
        """The larger half of the queues in memory goes to disk."""
        size = {s: sum(w.nbytes + c.nbytes for w, c in p) for s, p in self.open.items() if p}
        for s in sorted(size, key=size.get, reverse=True):
            if self.held <= self.scratch.memory // 2:
                break
            self._close(s)
            self.runs[s][-1].spill(self.scratch)
            self.held -= size[s]

    def _close(self, symbol: int) -> None:
        """What is open becomes a run."""
        if parts := self.open.get(symbol):
            self.runs.setdefault(symbol, []).append(Run(tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]))
            self.open[symbol] = []

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a queue in order, with those that are put while it is read."""
        while self.runs.get(symbol) or self.open.get(symbol):
            self._close(symbol)
            for run in self.runs.pop(symbol):
                self.held -= run.nbytes
                for lo in range(0, run.n, BATCH):
                    yield run.part(lo, min(run.n, lo + BATCH))
                run.drop()

    def take_back(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a queue from the last to the first; common prefixes are with the one taken before."""
        self._close(symbol)
        after = 0
        for run in reversed(self.runs.pop(symbol, [])):
            self.held -= run.nbytes
            for hi in range(run.n, 0, -BATCH):
                where, shared = run.part(max(0, hi - BATCH), hi)
                yield where[::-1], np.append(np.uint8(after), shared[:0:-1]).astype(np.uint8)
                after = shared[0]
            run.drop()


class Sorter:
    """Tuples in order of their fields, from blocks in any order: sorted runs on disk, merged a block at a time."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.runs, self.held, self.size = scratch, [], [], 0

    def add(self, *fields: np.ndarray) -> None:
        self.held.append(fields)
        self.size += sum(x.nbytes for x in fields)
        if self.size * 3 > self.scratch.memory:
            self.runs.append(Run(self._sorted()))
            self.runs[-1].spill(self.scratch)

    def _sorted(self, parts=None) -> tuple[np.ndarray, ...]:
        fields = tuple(np.concatenate(x) for x in zip(*(self.held if parts is None else parts)))
        if parts is None:
            self.held, self.size = [], 0
        order = np.lexsort(fields[::-1]) if len(fields) > 2 else np.argsort(fields[0], kind="stable")
        return tuple(x[order] for x in fields)

    def __iter__(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks in order; the last field, an index, never has to be: equal keys come in any order."""
        if self.held:
            self.runs.append(Run(self._sorted()))
        if len(self.runs) == 1 and self.runs[0].file is None:
            yield self.runs[0].fields
            return
        step = max(64, self.scratch.memory // (4 * 16 * max(1, len(self.runs))))
        at, heads = [0] * len(self.runs), [None] * len(self.runs)
        while True:
            for k, run in enumerate(self.runs):
                if heads[k] is None and at[k] < run.n:
                    heads[k] = run.part(at[k], min(run.n, at[k] + step))
                    at[k] += len(heads[k][0])
            live = [k for k, h in enumerate(heads) if h is not None]
            if not live:
                break
            # what no later block can come before: up to the least of the last keys of runs that go on
            ends = [tuple(int(x[-1]) for x in heads[k][:-1]) for k in live if at[k] < self.runs[k].n]
            edge, ready = min(ends) if ends else None, []
            for k in live:
                h = heads[k]
                n = len(h[0]) if edge is None else _up_to(h[:-1], edge)
                ready.append(tuple(x[:n] for x in h))
                heads[k] = tuple(x[n:] for x in h) if n < len(h[0]) else None
            yield self._sorted(ready)
        for run in self.runs:
            run.drop()


def _up_to(keys: tuple[np.ndarray, ...], edge: tuple[int, ...]) -> int:
    """How many of the sorted keys are at most `edge`."""
    lo, hi = 0, len(keys[0])
    for x, e in zip(keys, edge):
        part = x[lo:hi]
        lo, hi = lo + int(np.searchsorted(part, x.dtype.type(e), "left")), lo + int(np.searchsorted(part, x.dtype.type(e), "right"))
    return hi


def stypes(text: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is larger than the empty one."""
    n, later = len(text), False
    for hi in range(n, 0, -BLOCK):
        lo = max(0, hi - BLOCK)
        now, following = text[lo : min(hi, n - 1)], text[lo + 1 : hi + 1]
        # each position takes after the next one at which neighbours differ
        place = np.where(now != following, np.arange(len(now), dtype=np.int32), np.int32(len(now)))
        place = np.minimum.accumulate(place[::-1])[::-1]
        out[lo : lo + len(now)] = np.append(now < following, later)[place]
        if hi == n:
            out[n - 1] = False
        later = bool(out[lo])
    return out


def leftmost(small: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Positions of the S-type suffixes that follow an L-type one."""
    n = len(small)
    found = lambda lo: np.flatnonzero(small[lo + 1 : min(n, lo + BLOCK + 1)] & ~small[lo : min(n - 1, lo + BLOCK)])
    out = scratch.array(sum(len(found(lo)) for lo in range(0, n, BLOCK)), _kind(n))
    at = 0
    for lo in range(0, n, BLOCK):
        x = found(lo)
        out[at : at + len(x)] = x + lo + 1
        at += len(x)
    return out


def _kind(n: int):
    return np.int32 if n < 2**31 else np.int64


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one number, the first byte highest; bytes after the end are 0."""
    n = len(text)
    if n < 8:
        text, n = np.append(text, np.zeros(8 - n, np.uint8)), 8
    view = np.ndarray((n - 7,), "<u8", text, strides=(1,))
    start = np.minimum(at, n - 8)
    over = (np.minimum(at - start, 7) * 8).astype(np.uint64)
    word = view[start].byteswap() << over
    word[at >= n] = 0
    return word


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = MOST) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to `most`."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    while len(alive) and out[alive[0]] < most:
        i, j = a[alive] + out[alive], b[alive] + out[alive]
        differ = _words(text, i) ^ _words(text, j)
        # leading bytes that are equal
        run = np.full(len(alive), 8)
        some = differ != 0
        top = differ[some]
        for s in (32, 16, 8, 4, 2, 1):
            top |= top >> np.uint64(s)
        run[some] = (64 - np.bitwise_count(top).astype(np.int64)) // 8
        run = np.minimum(run, n - np.maximum(i, j))
        out[alive] += run
        alive = alive[run == 8]
    return np.minimum(out, most)


class _Carry:
    """Common prefixes of induced neighbours, from those of the tuples that induce them."""

    def __init__(self):
        self.least = np.full(256, MOST, np.uint8)
        self.begun = np.zeros(256, bool)

    def __call__(self, shared: np.ndarray, at: np.ndarray, symbol: np.ndarray, order: np.ndarray) -> np.ndarray:
        """shared: of the batch's tuples with their predecessors; at: which of them induce; order: stable by symbol."""
        m = len(shared)
        table = [shared]
        while (1 << len(table)) <= m:
            t = table[-1]
            h = 1 << (len(table) - 1)
            table.append(np.minimum(t, np.append(t[h:], np.full(h, MOST, np.uint8))))
        levels = np.concatenate(table)
        out = np.zeros(len(at), np.uint8)
        place, kind = at[order], symbol[order]
        first = np.ones(len(order), bool)
        first[1:] = kind[1:] != kind[:-1]
        before = np.empty(len(order), np.int64)
        before[1:] = place[:-1]
        before[first] = -1
        span = place - before
        level = np.frexp(span.astype(np.float32))[1] - 1
        found = np.minimum(levels[level * m + before + 1], levels[level * m + place + 1 - (1 << level)])
        opening = kind[first]
        found[first] = np.minimum(found[first], self.least[opening])
        found = np.where(found < MOST, found + 1, MOST).astype(np.uint8)
        start = found[first]
        start[~self.begun[opening]] = 0
        found[first] = start
        out[order] = found
        # what later batches start from
        tails = np.minimum.accumulate(shared[::-1])[::-1]
        self.least = np.minimum(self.least, tails[0])
        last = np.append(np.flatnonzero(first)[1:], len(order)) - 1
        self.least[kind[last]] = np.append(tails, MOST)[place[last] + 1]
        self.begun[kind[last]] = True
        return out


class _Seeds:
    """The leftmost-S suffixes in order, by symbol, with common prefixes of neighbours."""

    def __init__(self, text: np.ndarray, seeds: np.ndarray, carry: bool):
        self.text, self.seeds, self.carry = text, seeds, carry
        self.at: dict[int, tuple[int, int]] = {}
        lo = 0
        for begin in range(0, len(seeds), BLOCK):
            symbol = text[seeds[begin : begin + BLOCK]]
            for cut in [0, *(np.flatnonzero(symbol[1:] != symbol[:-1]) + 1).tolist()]:
                s = int(symbol[cut])
                if s not in self.at:
                    self.at[s] = (begin + cut, 0)
        starts = sorted(x for x, _ in self.at.values())
        ends = dict(zip(starts, [*starts[1:], len(seeds)]))
        self.at = {s: (lo, ends[lo]) for s, (lo, _) in self.at.items()}

    def symbols(self) -> Iterable[int]:
        return self.at

    def batches(self, s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begin, end = self.at.get(s, (0, 0))
        for lo in range(begin, end, BATCH):
            where = np.array(self.seeds[lo : min(end, lo + BATCH)])
            shared = np.zeros(len(where), np.uint8)
            if self.carry:
                ahead = where[:-1] if lo == begin else np.append(self.seeds[lo - 1], where[:-1])
                shared[len(where) - len(ahead) :] = shared_prefix(self.text, ahead, where[len(where) - len(ahead) :])
            yield where, shared


class _Back:
    """The L-type suffixes of a symbol from the largest down, once its turn comes."""

    def __init__(self, kept: Queues):
        self.kept = kept

    def symbols(self) -> Iterable[int]:
        return list(self.kept.open)

    def batches(self, s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return self.kept.take_back(s)


def _scan(text: np.ndarray, small: np.ndarray, queues: Queues, rest, ascending: bool, carry: _Carry | None) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Scan all symbols in turn; induce into the queues, and yield (symbol, queued, positions, common prefixes).

    rest: what follows a symbol's queue in scan order.
    """
    for s in rest.symbols():
        heapq.heappush(queues.heap, s if ascending else -s)
    done = None
    while queues.heap:
        s = abs(heapq.heappop(queues.heap))
        if s == done:
            continue
        done, last = s, None
        for queued in (True, False):
            for where, shared in queues.take(s) if queued else rest.batches(s):
                if not queued and last is not None:
                    shared = shared.copy()
                    if carry is not None:
                        shared[0] = shared_prefix(text, np.array([last]), where[:1])[0]
                    last = None
                elif queued:
                    last = where[-1]
                yield s, queued, where, shared
                at = np.flatnonzero(where > 0)
                before = where[at] - 1
                keep = small[before] != ascending
                at, before = at[keep], before[keep]
                if not len(at):
                    if carry is not None:
                        carry.least = np.minimum(carry.least, shared.min())
                    continue
                symbol = text[before]
                order = np.argsort(symbol, kind="stable")
                common = carry(shared, at, symbol, order) if carry is not None else np.zeros(len(at), np.uint8)
                symbol, before, common = symbol[order], before[order], common[order]
                cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(symbol)]):
                    queues.put(int(symbol[lo]), before[lo:hi], common[lo:hi])


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, scratch: Scratch, carry: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order with the common prefix of each and the one before it.

    seeds: the leftmost-S suffixes in ascending order.
    """
    n = len(text)
    up, large, down = Queues(scratch), Queues(scratch), Queues(scratch, descending=True)
    prefix = _Carry() if carry else None
    end = int(text[n - 1])
    up.put(end, np.array([n - 1], _kind(n)), np.zeros(1, np.uint8))
    if prefix is not None:
        prefix.begun[end] = True
    for s, queued, where, common in _scan(text, small, up, _Seeds(text, seeds, carry), True, prefix):
        if queued:
            large.put(s, where, common)
    for _, _, where, common in _scan(text, small, down, _Back(large), False, _Carry() if carry else None):
        yield where, common


def _names(text: np.ndarray, small: np.ndarray, left: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, bool]:
    """For each leftmost-S position how many of the substrings, up to the next one, are smaller; whether no two are equal.

    Of two substrings one of which begins the other, the shorter is larger: its last symbol is S-type, and there the
    other's is L-type.  So bytes beyond the end count as 255, which is no byte of UTF-8 (other texts take the types in);
    the last substring ends with the text, which is smaller than all.
    """
    n, m = len(text), len(left)
    plain = text.dtype == np.uint8 and (text.max(initial=0) < 255)
    wide = 8 if plain else 1
    rank = scratch.array(m, _kind(n))

    def word(which: np.ndarray, off: int) -> tuple[np.ndarray, np.ndarray]:
        """(symbols from an offset on, whether the substring goes on after them) of some substrings."""
        at = left[which] + np.int64(off)
        end = np.where(which + 1 < m, left[np.minimum(which + 1, m - 1)], n - 1)
        have = np.maximum(end + 1 - at, 0)
        if plain:
            fill = np.uint64(2**64 - 1)
            found = _words(text, np.minimum(at, n))
            return np.where((have < 8) & (which + 1 < m), found | (fill >> (np.minimum(have, 7) * 8).astype(np.uint64)), found), have > wide
        at = np.minimum(at, n - 1)
        return np.where(have > 0, (text[at].astype(np.uint64) << np.uint64(1)) + small[at] + np.uint64(1), np.uint64(0)), have > wide

    off, distinct, active = 0, True, (np.arange(lo, min(m, lo + BLOCK)) for lo in range(0, m, BLOCK))
    while active:
        order = Sorter(scratch)
        for which in active if off == 0 else (r.part(lo, min(r.n, lo + BLOCK)) for r in active for lo in range(0, r.n, BLOCK)):
            which = which if off == 0 else which[0]
            order.add(rank[which].astype(np.uint64), word(which, off)[0], which)
        active, base, last, seen, held = [], -1, None, 0, []
        first_of = 0

        def again(which: np.ndarray) -> None:
            active.append(Run((which,)))
            if which.nbytes * 8 > scratch.memory:
                active[-1].spill(scratch)

        def settle(parts) -> None:
            """A whole group of equal beginnings: it goes on if any of it does."""
            nonlocal distinct
            which = np.concatenate(parts) if len(parts) > 1 else parts[0]
            if len(which) > 1:
                if word(which, off)[1].any():
                    again(which)
                else:
                    distinct = False

        for old, w, which in order:
            fresh = np.append(True, (old[1:] != old[:-1]) | (w[1:] != w[:-1]))
            if last is not None and (old[0], w[0]) == last:
                fresh[0] = False
            new_old = np.append(True, old[1:] != old[:-1])
            if last is not None and old[0] == last[0]:
                new_old[0] = False
            # a group's place: its old rank and how many of the old group came before
            step = np.arange(seen, seen + len(old))
            start = np.where(new_old, step, -1)
            start[0] = step[0] if new_old[0] else base
            start = np.maximum.accumulate(start)
            first = np.where(fresh, step, -1)
            if not fresh[0]:
                first[0] = first_of
            first = np.maximum.accumulate(first)
            rank[which] = (old.astype(np.int64) + first - start).astype(rank.dtype)
            base, first_of, seen, last = int(start[-1]), int(first[-1]), seen + len(old), (old[-1], w[-1])
            cuts = np.flatnonzero(fresh)
            goes_on = word(which, off)[1]
            if not len(cuts):
                held.append(which)
                continue
            if held or cuts[0]:
                settle([*held, which[: cuts[0]]])
            tail = int(cuts[-1])
            inner = np.diff(cuts)
            crowded = np.repeat(inner > 1, inner)
            lead = which[cuts[0] : tail]
            if len(inner):
                more = np.repeat(np.logical_or.reduceat(goes_on[cuts[0] : tail], cuts[:-1] - cuts[0]), inner)
                if (crowded & ~more).any():
                    distinct = False
                if (crowded & more).any():
                    again(lead[crowded & more])
            held = [which[tail:]]
        if held:
            settle(held)
        off += wide
    return rank, distinct


def _doubling(names: np.ndarray, depth: int | None) -> np.ndarray:
    """Order of the suffixes of a string of names that fits in memory; only tied ones are sorted again."""
    n, k = len(names), 1
    order = np.argsort(names, kind="stable").astype(_kind(n))
    value = names[order]
    fresh = np.append(True, value[1:] != value[:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while depth is None or k < depth:
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(tied):
            break
        which = order[tied]
        first, second = rank[which], rank[np.minimum(which + np.int64(k), n)]
        again = np.lexsort((second, first))
        which, first, second = which[again], first[again], second[again]
        order[tied] = which
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        fresh[tied] = new
        rank[which] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        k *= 2
    return order


def seeds(text: np.ndarray, small: np.ndarray, scratch: Scratch, depth: int | None = None) -> np.ndarray:
    """The leftmost-S suffixes in ascending order."""
    left = leftmost(small, scratch)
    if len(left) < 2:
        return left
    names, distinct = _names(text, small, left, scratch)
    out = scratch.array(len(left), left.dtype)
    if distinct:
        for lo in range(0, len(left), BLOCK):
            out[names[lo : lo + BLOCK]] = left[lo : lo + BLOCK]
        return out
    # a name stands for two symbols at least
    deep = None if depth is None else depth // 2 + 2
    if len(names) * NAME_BYTES <= scratch.memory:
        return left[_doubling(names, deep)]
    at = len(left)
    for where, _ in _suffixes(names, scratch, deep, carry=False):
        out[at - len(where) : at] = left[where][::-1]
        at -= len(where)
    return out


def _suffixes(text: np.ndarray, scratch: Scratch, depth: int | None, carry: bool):
    small = stypes(text, scratch.array(len(text), bool))
    yield from induce(text, small, seeds(text, small, scratch, depth), scratch, carry)


def sort(text: np.ndarray, memory: int = 256 << 20, depth: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of a text of bytes in descending order: batches of (positions, common prefix of each with the one before it)."""
    if not len(text):
        return
    scratch = Scratch(memory)
    try:
        yield from _suffixes(text, scratch, depth, True)
    finally:
        scratch.close()
