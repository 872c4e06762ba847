"""Token ids of whole texts, word by word with a cache, equal to Tokenizer.encode(text, add_special_tokens=False).

The word-level vocabulary drops white space and never merges across it, so a text's ids are those of its words in turn.
Words of plain Latin characters go straight to the model's merges; all others (and special-token strings) are encoded
by the whole tokenizer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import kernel

DEFAULT_FILE = "word_bpe_49k.json"
#: Units kept between batches; beyond it the cache starts anew.
CACHE_UNITS = 500_000

#: Classes of bytes: 0 white space, 1 letter (also 0xC3 and what follows it: Latin letters), 2 digit, 3 other, 4 odd.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = 1
_CLASS[48:58] = 2
_CLASS[[*range(33), 127, 0x27, 0xC0, 0xC1, 0xC2, *range(0xC4, 256)]] = 4
_CLASS[kernel.WS] = 0
_JOIN = 1000


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, whether plain, and where each text's begin, of the pieces that are tokenised on their own.

    A word of plain Latin characters falls into runs of letters, single digits and runs of others, as the vocabulary's
    own splitting has it; a word with an apostrophe, a special-token opener or any other byte stays whole.
    """
    starts, ends, of = kernel.words(data, at)
    if not len(starts):
        return starts, ends, np.zeros(0, bool), of
    kind = _CLASS[data]
    for lead, follow in ((0xC3, (0x97, 0xB7)), (0x3C, (0x7C,))):
        here = np.flatnonzero(data[:-1] == lead)
        kind[here[np.isin(data[here + 1], follow)]] = 4
    odd = np.flatnonzero(kind == 4)
    odd = np.unique(np.searchsorted(starts, odd, "right") - 1) if len(odd) else odd
    begin = np.empty(len(data), bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin |= kind == 2
    begin &= kind != 0
    if len(odd):
        mark = np.zeros(len(data) + 1, np.int8)
        mark[starts[odd]] += 1
        mark[ends[odd]] -= 1
        begin &= np.cumsum(mark[:-1], dtype=np.int8) == 0
    begin[starts] = True
    first = np.flatnonzero(begin)
    word = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(data)), ends[word])
    plain = np.ones(len(first), bool)
    if len(odd):
        plain[np.isin(word, odd)] = False
    return first, last, plain, np.searchsorted(first, at)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def _byte_letters() -> dict[int, str]:
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER = _byte_letters()


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.off = np.zeros(1, np.int64)

    def fresh(self, texts: list[str], plain: np.ndarray) -> list[np.ndarray]:
        """Ids of units not met before: plain ones many at a time, told apart by the ids that end a word."""
        out: list = [None] * len(texts)
        easy = [i for i in range(len(texts)) if plain[i]]
        letters = [texts[i] if texts[i].isascii() else texts[i].lower().encode().decode("latin-1").translate(_LETTER) for i in easy]
        joined = [" ".join(letters[k : k + _JOIN]) for k in range(0, len(letters), _JOIN)]
        found = [x.ids for x in self.merges.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.array([i for x in found for i in x], np.uint32)
        stops = np.flatnonzero(self.closes[ids]) + 1
        if len(stops) != len(easy):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        for i, lo, hi in zip(easy, [0, *stops[:-1]], stops):
            out[i] = ids[lo:hi]
        for i in range(len(texts)):
            if out[i] is None:
                out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def slots(self, distinct: np.ndarray, text_of, plain: np.ndarray) -> np.ndarray:
        """Cache places of distinct unit hashes (sorted); text_of(i) gives a missing unit's text with A-Z lowered."""
        at = np.searchsorted(self.known, distinct)
        found = np.zeros(len(distinct), bool)
        if len(self.known):
            found = self.known[np.minimum(at, len(self.known) - 1)] == distinct
        missing = np.flatnonzero(~found)
        out = np.empty(len(distinct), np.int64)
        out[found] = self.slot[at[found]]
        if len(missing):
            fresh = self.fresh([text_of(i) for i in missing], plain[missing])
            out[missing] = len(self.off) - 1 + np.arange(len(missing))
            self.ids = np.concatenate([self.ids, *fresh])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum([len(x) for x in fresh])])
            self.slot = np.insert(self.slot, at[missing], out[missing])
            self.known = np.insert(self.known, at[missing], distinct[missing])
        return out

    def encode(self, column: pa.Array):
        """Yields (row, ids as uint32) for each text of the column in turn."""
        for lo, hi, data, at in kernel.chunks(column):
            starts, ends, plain, of = units(data, at)
            if not len(starts):
                for row in range(lo, hi):
                    yield row, np.zeros(0, np.uint32)
                continue
            h = kernel.hashes(data, starts, ends)
            distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            if len(self.known) + len(distinct) > CACHE_UNITS:
                self.reset()
            body = kernel.LOWER[data].tobytes()
            begin, stop = starts[first].tolist(), ends[first].tolist()
            slot = self.slots(distinct, lambda i: body[begin[i] : stop[i]].decode("utf-8", "replace"), plain[first])[inverse]
            size = self.off[slot + 1] - self.off[slot]
            to = np.concatenate([[0], np.cumsum(size)])
            ids = self.ids[np.arange(to[-1]) - np.repeat(to[:-1] - self.off[slot], size)]
            cut = to[of].tolist()
            for k in range(hi - lo):
                yield lo + k, ids[cut[k] : cut[k + 1]]


_OPEN: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file, kept while the worker lives."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]
