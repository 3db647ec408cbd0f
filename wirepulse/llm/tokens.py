"""Token ids of many texts with a public tokenizer file.

The tokenizer drops white space and never joins what white space parts, so the ids of a text are the
ids of its words one after another. Each task therefore asks the tokenizers library for the ids of
each different word once and looks the others up by a 64-bit hash of their bytes.

Special tokens in a text are ordinary text, as in the file's description.
"""

from __future__ import annotations

import os

import numpy as np

from wirepulse.llm.common import RangeHash, Words, mix

# A worker's memory of words is emptied when it holds this many (about 40 MB).
MOST_WORDS = 1 << 19
_LEAST_SLOTS = 1 << 16
_SHARED: dict[str, "WordTokenizer"] = {}
_COMMA_DOT = np.zeros(256, bool)
_COMMA_DOT[[ord(","), ord(".")]] = True


def tokenizer(path: str) -> "WordTokenizer":
    """One per worker process and file, so that later tasks find the words of earlier ones."""
    if path not in _SHARED:
        _SHARED[path] = WordTokenizer(path)
    return _SHARED[path]


class WordTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.size = len(self._ends)
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(_LEAST_SLOTS, np.uint64)
        self._word = np.zeros(_LEAST_SLOTS, np.int32)
        self._offsets = np.zeros(1, np.int64)
        self._ids = np.empty(0, np.int32)

    def _make_room(self, more: int) -> None:
        """At least two slots for each word."""
        slots = len(self._keys)
        while slots < 2 * (len(self._offsets) + more):
            slots *= 2
        if slots > len(self._keys):
            used = np.flatnonzero(self._keys)
            keys, word = self._keys[used], self._word[used]
            self._keys, self._word = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
            self._insert(keys, word)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the memory, or -1; linear probing, all words side by side."""
        out = np.full(len(hashes), -1, np.int32)
        slots = (hashes & np.uint64(len(self._keys) - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            keys = self._keys[slots[left]]
            hit = keys == hashes[left]
            out[left[hit]] = self._word[slots[left[hit]]]
            left = left[~hit & (keys != 0)]
            slots[left] = (slots[left] + 1) & (len(self._keys) - 1)
        return out

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        slots = (hashes & np.uint64(len(self._keys) - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = self._keys[slots[left]] == 0
            some = left[free]
            self._keys[slots[some]] = hashes[some]  # of several for one slot the last stays
            won = np.zeros(len(hashes), bool)
            won[some] = self._keys[slots[some]] == hashes[some]
            self._word[slots[won]] = numbers[won]
            left = left[~won[left]]
            slots[left] = (slots[left] + 1) & (len(self._keys) - 1)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        other = [i for i, w in enumerate(words) if not w.isalpha()]
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            # A word of letters ends with exactly one id that ends a word.
            ids = np.array(self._encode([" ".join(words[i] for i in some)])[0], np.int32)
            last = np.flatnonzero(self._ends[ids]) + 1
            if len(last) == len(some) and (not len(ids) or last[-1] == len(ids)):
                parts.append((np.array(some), np.diff(last, prepend=0), ids))
            else:
                other += some
        for at in range(0, len(other), 1000):
            some = other[at : at + 1000]
            encoded = self._encode([words[i] for i in some])
            counts = np.array([len(x) for x in encoded], np.int64)
            ids = np.fromiter((i for x in encoded for i in x), np.int32, int(counts.sum()))
            parts.append((np.array(some), counts, ids))
        counts = np.zeros(len(words), np.int64)
        for some, n, _ in parts:
            counts[some] = n
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(offsets[-1], np.int32)
        for some, n, ids in parts:
            out[_spread(offsets[some], n)] = ids
        return out, counts

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n + 1 offsets) of the texts in a block of bytes."""
        words = Words(data, offsets, lower=False)
        starts, ends, hashes, first = words.starts, words.ends, words.hashes, words.first
        # A comma or full stop behind an ASCII letter is always a token of its own when the word
        # ends there; parting it here leaves fewer different words.
        tail = (ends - starts > 1) & _COMMA_DOT[data[ends - 1]]
        before = data[np.maximum(ends - 2, 0)] | 0x20
        tail &= (before >= 97) & (before <= 122)
        if tail.any():
            at = np.flatnonzero(tail)
            stem_ends = ends[at] - 1
            shift = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(tail)[:-1]])
            n = len(starts) + len(at)
            new_starts, new_ends = np.empty(n, np.int64), np.empty(n, np.int64)
            new_starts[shift], new_ends[shift] = starts, ends
            new_ends[shift[at]] = stem_ends
            new_starts[shift[at] + 1], new_ends[shift[at] + 1] = stem_ends, stem_ends + 1
            new_hashes = np.empty(n, np.uint64)
            new_hashes[shift] = hashes
            exact = RangeHash(data) if words.range_hash is None else words.range_hash
            changed = np.concatenate([shift[at], shift[at] + 1])
            new_hashes[changed] = mix(exact(new_starts[changed], new_ends[changed]))
            first = first + np.concatenate([[0], np.cumsum(tail)])[first]
            starts, ends, hashes = new_starts, new_ends, new_hashes
        hashes = np.where(hashes == 0, np.uint64(1), hashes)
        numbers = self._find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            _, which = np.unique(hashes[missing], return_index=True)
            new = missing[which]
            if len(self._offsets) + len(new) > MOST_WORDS and len(self._offsets) > 1:
                self._clear()
                _, new = np.unique(hashes, return_index=True)
            raw = data.tobytes()
            ids, counts = self._encode_words(
                [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[new], ends[new], strict=True)]
            )
            self._make_room(len(new))
            self._insert(hashes[new], np.arange(len(new), dtype=np.int32) + len(self._offsets) - 1)
            self._ids = np.concatenate([self._ids, ids])
            self._offsets = np.concatenate([self._offsets, self._offsets[-1] + np.cumsum(counts)])
            numbers = self._find(hashes)
        counts = self._offsets[numbers + 1] - self._offsets[numbers]
        ids = self._ids[_spread(self._offsets[numbers], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])[first]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of ranges one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` behind every text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.int32)
    counts = np.diff(offsets)
    out[_spread(offsets[:-1] + np.arange(n), counts)] = ids
    return out, offsets + np.arange(n + 1)
