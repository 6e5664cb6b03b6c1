"""Token ids of texts, for tokenizers whose words end at white space and which drop white space.

Words are looked up by hash in a cache; only unknown ones go to the tokenizer. The cache has two
generations: it is cleaned between slices of text, never inside one, and the words met most often
stay. So it holds at most `CACHED_WORDS` words and one slice's, and hot words are never lost.
"""

from __future__ import annotations

import re

import numpy as np

from tallywright.llm import text as X

CACHED_WORDS = 500_000
SLICE_BYTES = 1 << 18

#: The word pattern of the tokenizers whose words are letters, one digit, or other marks.
_RUNS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that such a pattern parts from a letter or digit before them: not the apostrophe, which
#: takes letters with it, and not what special tokens are written with.
_MARK = X._flags((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x3B), (0x3D, 0x3D), (0x3F, 0x40), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E))
_PLAIN = X._flags((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
#: Second bytes of the letters U+00C0 to U+00FF, whose first byte is C3.
_LATIN = X._flags((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))
#: Is a word one of these letters only?
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_CASED = X.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray):
    """Words without the marks at their end, and those marks as words of their own."""
    if not len(starts):
        return starts, ends, at
    place = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    body = np.maximum.accumulate(np.where(_MARK[data], np.int32(-1), place))[ends - 1].astype(np.int64) + 1
    cut = np.flatnonzero((body > starts) & (body < ends))
    last = data[body[cut] - 1]
    before = data[np.maximum(body[cut] - 2, 0)]
    cut = cut[_PLAIN[last] | (_LATIN[last] & (before == 0xC3) & (body[cut] - 2 >= starts[cut]))]
    many = np.ones(len(starts), np.int64)
    many[cut] = 2
    first = np.cumsum(many) - many
    new_starts, new_ends = np.empty(int(many.sum()), np.int64), np.empty(int(many.sum()), np.int64)
    new_starts[first], new_ends[first] = starts, ends
    new_ends[first[cut]] = body[cut]
    new_starts[first[cut] + 1], new_ends[first[cut] + 1] = body[cut], ends[cut]
    return new_starts, new_ends, np.append(first, len(new_starts))[at]


class Words:
    """Token ids of texts by way of a cache of words."""

    def __init__(self, path: str, cached: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The parts' own states: the whole file has the vocabulary and the merges in it too.
        normal, parts = (x.__getstate__().decode() if x else "" for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        self.values = X.BYTES if '"Lowercase"' in normal else _CASED
        self.parted = _RUNS in parts.replace("\\\\", "\\")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")]] = True
        self.parted &= getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>"
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.int32
        self.cached = CACHED_WORDS if cached is None else cached
        self._lay(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(1, np.uint32), np.zeros(0, self.kind))

    def _lay(self, keys, met, starts, ids):
        """Sorted keys of the older words, whose slots are 0, 1, ...; newer words come after."""
        self.old, self.new, self.new_slots = keys, np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.met, self.starts, self.ids = met, starts, ids

    def _clean(self) -> None:
        """The words met most often, at most half of what is held, in order of their keys."""
        keys = np.concatenate([self.old, self.new])
        slots = np.concatenate([np.arange(len(self.old), dtype=np.int32), self.new_slots])
        if len(keys) > self.cached:
            stays = np.argsort(self.met[slots], kind="stable")[::-1][:self.cached // 2]
            keys, slots = keys[stays], slots[stays]
        order = np.argsort(keys, kind="stable")
        keys, slots = keys[order], slots[order]
        size = np.diff(self.starts)[slots].astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.starts[slots].astype(np.int64) - starts[:-1], size) + np.arange(starts[-1])]
        self._lay(keys, self.met[slots] >> 1, starts.astype(np.uint32), ids)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        slot = np.full(len(hashes), -1, np.int64)
        for keys, slots in ((self.old, None), (self.new, self.new_slots)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                slot = np.where(keys[at] == hashes, at if slots is None else slots[at], slot)
        return slot

    def _add(self, hashes: np.ndarray, words: list[str]) -> None:
        simple = np.array([_LETTERS(w) is not None for w in words], bool) if self.parted else np.zeros(len(words), bool)
        size, got = np.zeros(len(words), np.int64), []
        # Words of letters alone are encoded many at a time: each ends at a token that ends a word.
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        for i in range(0, int(simple.sum()), 512):
            some = order[i:min(i + 512, int(simple.sum()))]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[k] for k in some])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) != len(some):
                raise RuntimeError(f"{len(some)} words were parted into {len(ends)}")
            size[some] = np.diff(ends, prepend=-1)
            got.append(ids.astype(self.kind))
        rest = order[int(simple.sum()):]
        for i in range(0, len(rest), 1024):
            found = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast([words[k] for k in rest[i:i + 1024]], add_special_tokens=False)]
            size[rest[i:i + 1024]] = [len(x) for x in found]
            got += found
        slots = np.empty(len(words), np.int32)
        slots[order] = len(self.starts) - 1 + np.arange(len(words), dtype=np.int32)
        self.starts = np.concatenate([self.starts, (int(self.starts[-1]) + np.cumsum(size[order])).astype(np.uint32)])
        self.ids = np.concatenate([self.ids, *got])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.uint8)])
        keys, slots = np.concatenate([self.new, hashes]), np.concatenate([self.new_slots, slots])
        order = np.argsort(keys, kind="stable")
        self.new, self.new_slots = keys[order], slots[order]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows' texts laid end to end, and the rows' bounds among them."""
        if len(self.old) + len(self.new) > self.cached or len(self.new) > 10_000 + len(self.old) // 8:
            self._clean()
        starts, ends, at = X.words(data, bounds)
        if self.parted:
            starts, ends, at = _units(data, starts, ends, at)
        h = X.span_hash(X.running(self.values[data]), starts, ends)
        if self.values is not _CASED and (odd := data == 0x3C).any():
            # Special tokens are known by their case.
            seen = np.concatenate([[0], np.cumsum(odd)])
            h = np.where(seen[ends] > seen[starts], X.span_hash(X.running(_CASED[data]), starts, ends), h)
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        slot = self._find(unique)
        new = np.flatnonzero(slot < 0)
        if len(new):
            raw = data.tobytes()
            self._add(unique[new], [raw[starts[i]:ends[i]].decode("utf-8", "replace") for i in first[new]])
            slot = self._find(unique)
            if (slot < 0).any():
                raise RuntimeError(f"{int((slot < 0).sum())} of {len(unique)} words have no token ids")
        self.met[slot] = np.minimum(self.met[slot], 254) + 1
        word = slot[back]
        size = (self.starts[word + 1] - self.starts[word]).astype(np.int64)
        out = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.starts[word].astype(np.int64) - out[:-1], size) + np.arange(out[-1])]
        return ids.astype(np.int32), out[at]


def words_of(path: str) -> Words:
    """The worker's cache for this tokenizer; it outlives a task."""
    import sys
    import types

    held = sys.modules.setdefault("_tallywright_tokens", types.ModuleType("_tallywright_tokens"))
    if getattr(held, "path", None) != path:
        held.path, held.words = path, Words(path)
    return held.words
