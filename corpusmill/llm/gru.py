"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state.

Words 0..V-1 lie in classes of equal size, `size` words each; P(word) = P(class | state) * P(word | class, state).
The input table holds each word's contribution to the three gates.  Texts are dealt over lanes that run side by side,
one text after the other in each; the state at the end of a window of steps starts the next one and is 0 where a text
begins, so a text's likelihood is that of the whole text.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
WINDOW = 32
LANES = 256

Params = dict[str, np.ndarray]


def start(frequency: np.ndarray, size: int, seed: int = 3, hidden: int = HIDDEN) -> Params:
    """Small random weights; biases from word frequencies, so that the untrained model is the unigram model."""
    rng = np.random.default_rng(seed)
    classes = len(frequency) // size
    f = (frequency + 0.5).reshape(classes, size)
    normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "gates": normal(len(frequency), 3 * hidden),
        "bias": np.zeros(3 * hidden, np.float32),
        "state": normal(hidden, 3 * hidden),
        "class": normal(hidden, classes),
        "class_bias": np.log(f.sum(axis=1) / f.sum()).astype(np.float32),
        "word": normal(classes, hidden, size),
        "word_bias": np.log(f / f.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def _gates(p: Params, parts: np.ndarray) -> np.ndarray:
    """Columns of the gates as one matrix for each gate; halved for those that become sigmoids, by way of tanh."""
    n = p["state"].shape[0]
    out = np.ascontiguousarray(parts.reshape(-1, 3, n).transpose(1, 0, 2))
    out[:2] *= out.dtype.type(0.5)
    return out


def _step(weights: np.ndarray, inputs: np.ndarray, h: np.ndarray, zr: np.ndarray, new: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The gates and the next state, written where they belong; weights and inputs are those of _gates(), for each lane."""
    own = h @ weights
    np.add(own[:2], inputs[:2], out=zr)
    np.tanh(zr, out=zr)
    zr *= h.dtype.type(0.5)
    zr += h.dtype.type(0.5)
    np.multiply(zr[1], own[2], out=new)
    new += inputs[2]
    np.tanh(new, out=new)
    np.subtract(h, new, out=following)
    following *= zr[0]
    following += new
    return own[2]


#: Logits within this need no highest one subtracted before their exponentials are taken.
SAFE = 60.0


def _safe(p: Params, states: np.ndarray) -> bool:
    """Whether no logit of these states can go beyond SAFE."""
    most = float(max(states.max(initial=0), -states.min(initial=0)))
    return all(most * float(np.abs(p[k]).sum(axis=-2).max()) + float(np.abs(p[k + "_bias"]).max()) < SAFE for k in ("class", "word"))


def _exponents(states: np.ndarray, weight: np.ndarray, bias: np.ndarray, factor: np.ndarray, at: np.ndarray, safe: bool):
    """The logits at flat places `at`, all exponentials e, and totals, so that chances are e * factor / total.

    The bias is in the factor, and not in the logits, where that is safe.
    """
    x = states @ weight
    if not safe:
        x += bias
        x -= x.max(axis=1, keepdims=True)
    found = x.reshape(-1).take(at)
    np.exp(x, out=x)
    return found, x, x @ factor


def _factors(bias: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Factors of exponentials, and their logarithms."""
    return (np.exp(bias), bias) if safe else (np.ones_like(bias), np.zeros_like(bias))


def _by_class(target: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that brings the words of a class together, and (class, from, to) of each in it."""
    kind = (target // size).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    cuts = np.searchsorted(kind[order], np.arange(int(kind.max(initial=0)) + 2))
    return order, [(c, int(cuts[c]), int(cuts[c + 1])) for c in np.flatnonzero(np.diff(cuts)).tolist()]


#: Rows of logits that are worked on at once, so that they stay in a core's cache.
BLOCK = 2048


def _blocks(classes: list[tuple[int, int, int]], own: np.ndarray, size: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Classes in blocks of rows, and the place of each row's own column in its block."""
    blocks = [(c, at, min(at + BLOCK, hi)) for c, lo, hi in classes for at in range(lo, hi, BLOCK)]
    begin = np.array([lo for _, lo, _ in blocks], np.int64)
    return blocks, (np.arange(len(own)) - np.repeat(begin, np.diff(begin, append=len(own)))) * size + own


def _likelihood(p: Params, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(target | state) of each pair."""
    safe = _safe(p, states)
    order, classes = _by_class(target, p["word"].shape[2])
    states, target = states[order], target[order]
    kind, own = np.divmod(target, p["word"].shape[2])
    found = np.zeros(len(order))
    for weight, bias, groups, goal in ((p["class"][None], p["class_bias"][None], [(0, 0, len(order))], kind), (p["word"], p["word_bias"], classes, own)):
        factor, shift = _factors(bias, safe)
        blocks, place = _blocks(groups, goal, bias.shape[1])
        for c, lo, hi in blocks:
            x, _, total = _exponents(states[lo:hi], weight[c], bias[c], factor[c], place[lo:hi], safe)
            found[lo:hi] += x + shift[c].take(goal[lo:hi]) - np.log(total)
    out = np.empty(len(order))
    out[order] = found
    return out


def _descend(weight: np.ndarray, bias: np.ndarray, classes: list[tuple[int, int, int]], states: np.ndarray, own: np.ndarray, safe: bool, count, back: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of rows that lie by class, and the gradients of its mean for weights and biases; that for states is added to back."""
    factor, shift = _factors(bias, safe)
    blocks, place = _blocks(classes, own, bias.shape[1])
    of_weight, of_bias = np.zeros_like(weight), np.zeros_like(bias)
    turned, less, ones = np.ascontiguousarray((weight * factor[:, None]).transpose(0, 2, 1)), 1 / (factor * count), np.ones(BLOCK, states.dtype)
    loss = 0.0
    for c, lo, hi in blocks:
        rows, at, mine = states[lo:hi], place[lo:hi], own[lo:hi]
        x, d, total = _exponents(rows, weight[c], bias[c], factor[c], at, safe)
        loss += float(np.log(total).sum() - (x + shift[c].take(mine)).sum())
        total *= count
        d /= total[:, None]
        line = d.reshape(-1)
        line[at] = line.take(at) - less[c].take(mine)
        of_weight[c] += rows.T @ d
        of_bias[c] += ones[: hi - lo] @ d
        back[lo:hi] += d @ turned[c]
    of_weight *= factor[:, None]
    of_bias *= factor
    return loss, of_weight, of_bias


def seats(length: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(lane, step at which it begins) of each text: every text goes to the lane that is free first, longest first.

    Lanes are numbered from the one that ends last.
    """
    order = np.argsort(-length, kind="stable")
    free = [(0, k) for k in range(max(1, min(lanes, len(order))))]
    lane, begin, ends = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.zeros(len(free), np.int64)
    for i in order.tolist():
        at, k = free[0]
        lane[i], begin[i] = k, at
        ends[k] = at + length[i]
        heapq.heapreplace(free, (int(ends[k]), k))
    rank = np.empty(len(ends), np.int64)
    rank[np.argsort(-ends, kind="stable")] = np.arange(len(ends))
    return rank[lane], begin


class Loom:
    """Texts dealt over lanes, one after the other in each, read a window of steps at a time."""

    def __init__(self, words: np.ndarray, of: np.ndarray, lanes: int):
        length = np.diff(of)
        self.text = np.flatnonzero(length > 0)
        lane, begin = seats(length[self.text], lanes)
        # texts in order of lane and step
        order = np.lexsort((begin, lane))
        self.text, lane, begin = self.text[order], lane[order], begin[order]
        cut = np.searchsorted(lane, np.arange(int(lane.max(initial=-1)) + 2))
        end = begin + length[self.text]
        self.last = end[cut[1:] - 1] if len(lane) else np.zeros(0, np.int64)
        self.steps = int(self.last.max(initial=0))
        # a word's place less its step, and the texts in order of the steps at which they begin
        self.ahead = of[:-1][self.text] - begin
        coming = np.argsort(begin, kind="stable")
        self.coming, self.coming_lane = begin[coming], lane[coming]
        self.cursor = cut[:-1] - 1

    def window(self, at: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each word, whether a text begins there, text) as steps x live lanes; place -1 after a lane's end.

        Windows are read in turn.
        """
        live = int(np.searchsorted(-self.last, -at, "left"))
        lo, hi = np.searchsorted(self.coming, [at, at + steps])
        first = np.zeros((steps, live), bool)
        first[self.coming[lo:hi] - at, self.coming_lane[lo:hi]] = True
        which = self.cursor[:live] + np.cumsum(first, axis=0)
        self.cursor[:live] = which[-1]
        step = np.arange(at, at + steps)[:, None]
        place = self.ahead[which] + step
        if at + steps > self.last[:live].min(initial=at + steps):
            place[step >= self.last[:live]] = -1
        return place, first, self.text[which]


def score(p: Params, words: np.ndarray, of: np.ndarray, first: int, window: int = WINDOW * 2, lanes: int = 4 * LANES) -> np.ndarray:
    """Natural log-likelihood of each text; text i is words[of[i]:of[i + 1]], and `first` comes before its first word."""
    loom = Loom(words, of, lanes)
    total = np.zeros(len(of) - 1)
    h = np.zeros((len(loom.last), p["state"].shape[0]), p["state"].dtype)
    table, weights = _gates(p, p["gates"] + p["bias"]), _gates(p, p["state"])
    for at in range(0, loom.steps, window):
        steps = min(window, loom.steps - at)
        place, begins, text = loom.window(at, steps)
        h = h[: place.shape[1]]
        before = np.where(begins, first, words[place - 1])
        reset = begins.any(axis=1)
        states, zr, new = np.empty((steps, *h.shape), h.dtype), np.empty((2, *h.shape), h.dtype), np.empty_like(h)
        for t in range(steps):
            if reset[t]:
                h = h.copy()
                h[begins[t]] = 0
            _step(weights, table.take(before[t], axis=1), h, zr, new, states[t])
            h = states[t]
        real = place >= 0
        found = _likelihood(p, states[real], words[place[real]].astype(np.int64))
        total += np.bincount(text[real], weights=found, minlength=len(total))
    return total


def gradient(p: Params, before: np.ndarray, target: np.ndarray, mask: np.ndarray, h: np.ndarray, begins: np.ndarray | None = None) -> tuple[float, Params, np.ndarray]:
    """Mean loss, its gradient through one window (steps x lanes), and the state after it.

    begins: where a text begins, and the state is 0 again.
    """
    steps, lanes = before.shape
    n, size = h.shape[1], p["word"].shape[2]
    weights, inputs = _gates(p, p["state"]), _gates(p, p["gates"] + p["bias"]).take(before, axis=1)
    starts = np.zeros(steps, bool) if begins is None else begins.any(axis=1)
    whole = mask.all(axis=1)
    lasts, states, z, r, new, own = gates = np.empty((6, steps, lanes, n), h.dtype)
    for t in range(steps):
        lasts[t] = h
        if starts[t]:
            lasts[t][begins[t]] = 0
        own[t] = _step(weights, inputs[:, t], lasts[t], gates[2:4, t], new[t], states[t])
        if not whole[t]:
            np.copyto(states[t], lasts[t], where=~mask[t][:, None])
        h = states[t]
    # output layer, class by class
    real = np.flatnonzero(mask.ravel())
    order, classes = _by_class(target.ravel()[real], size)
    real = real[order]
    flat, goal = states.reshape(-1, n)[real], target.ravel()[real]
    kind, mine = np.divmod(goal, size)
    safe = _safe(p, flat)
    count = h.dtype.type(max(1, len(real)))
    g, back = {"gates": np.zeros_like(p["gates"]), "state": np.zeros_like(p["state"])}, np.zeros_like(flat)
    loss, of_class, of_bias = _descend(p["class"][None], p["class_bias"][None], [(0, 0, len(real))], flat, kind, safe, count, back)
    g["class"], g["class_bias"] = of_class[0], of_bias[0]
    of_words, g["word"], g["word_bias"] = _descend(p["word"], p["word_bias"], classes, flat, mine, safe, count, back)
    loss += of_words
    outer = np.zeros((steps * lanes, n), h.dtype)
    outer[real] = back
    outer = outer.reshape(steps, lanes, n)
    # what a state's gradient is multiplied by on its way to the gates; after a lane's end it only passes through
    to_z = lasts - new
    to_z *= z
    to_z *= 1 - z
    new *= new
    to_new = 1 - z
    to_new *= np.subtract(1, new, out=new)
    to_r = own
    to_r *= r
    to_r *= 1 - r
    if not whole.all():
        to_new[~mask], to_z[~mask], z[~mask] = 0, 0, 1
    # through time, to the window's start
    later = np.zeros_like(h)
    given, turned = np.empty((steps, lanes, 3 * n), h.dtype), np.ascontiguousarray(p["state"].T)
    for t in range(steps - 1, -1, -1):
        later += outer[t]
        of_z, of_r, of_new = (given[t, :, k : k + n] for k in (0, n, 2 * n))
        np.multiply(later, to_z[t], out=of_z)
        np.multiply(later, to_new[t], out=of_new)
        np.multiply(of_new, to_r[t], out=of_r)
        pre = given[t].copy()
        pre[:, 2 * n :] *= r[t]
        g["state"] += lasts[t].T @ pre
        later *= z[t]
        later += pre @ turned
        if starts[t]:
            later[begins[t]] = 0
    given = given.reshape(-1, 3 * n)
    g["bias"] = np.ones(len(given), h.dtype) @ given
    # sums by word
    seen = before.ravel()
    order = np.argsort(seen.astype(np.uint16) if len(p["gates"]) <= 1 << 16 else seen, kind="stable")
    seen = seen[order]
    cut = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
    g["gates"][seen[cut]] = np.add.reduceat(given.take(order, axis=0), cut, axis=0)
    return loss / count, g, h


def train(p: Params, words: np.ndarray, of: np.ndarray, first: int, rate: float = 0.01, lanes: int = LANES, window: int = WINDOW) -> Params:
    """Adam over windows of texts side by side, one pass; gradients end where a window begins, states don't."""
    # all parameters lie in one vector
    names, ends = list(p), np.cumsum([v.size for v in p.values()])
    flat = np.concatenate([v.ravel() for v in p.values()])
    p = {k: flat[end - v.size : end].reshape(v.shape) for (k, v), end in zip(p.items(), ends)}
    mean, square, way = (np.zeros_like(flat) for _ in range(3))
    loom = Loom(words, of, lanes)
    h = np.zeros((len(loom.last), p["state"].shape[0]), p["state"].dtype)
    for done, at in enumerate(range(0, loom.steps, window), 1):
        place, begins, _ = loom.window(at, min(window, loom.steps - at))
        real = place >= 0
        before, goal = np.where(begins, first, words[place - 1]).astype(np.int64), np.where(real, words[place], 0).astype(np.int64)
        before[~real] = first
        _, g, h = gradient(p, before, goal, real, h[: place.shape[1]], begins)
        v = np.concatenate([g[k].ravel() for k in names])
        norm = np.sqrt(float(v @ v))
        v *= np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        up, down = np.float32(rate / (1 - 0.9**done)), np.float32(1 / (1 - 0.99**done))
        np.subtract(v, mean, out=way)
        way *= np.float32(0.1)
        mean += way
        v *= v
        v -= square
        v *= np.float32(0.01)
        square += v
        np.multiply(square, down, out=way)
        np.sqrt(way, out=way)
        way += np.float32(1e-8)
        np.divide(mean, way, out=way)
        way *= up
        flat -= way
    return {k: v.copy() for k, v in p.items()}


def pack(p: Params) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def unpack(data: bytes, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size * 4
        out[k] = np.frombuffer(data[at : at + n], "<f4").reshape(like[k].shape).copy()
        at += n
    return out
