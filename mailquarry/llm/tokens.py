"""Token ids of many texts with the tokenizers library.

A byte-level BPE tokenizer first cuts a text into words by a fixed pattern and then merges inside each word, so a
word has the same ids wherever it stands. The cutting is done here on arrays of code points; every word not seen
before goes to the library, and its ids are remembered. Texts with code points outside the checked range go to the
library whole. The ids are those of ``encode(text, add_special_tokens=False)``; strings that look like special
tokens are ordinary text.
"""

from __future__ import annotations

from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

from mailquarry.llm.arrays import kept, word_hash

END_ID = 0
SAFE_LIMIT = 0x0530                      # Latin, Greek and Cyrillic
SAFE_BLOCKS = ((0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0))     # punctuation, currency signs
MAX_WORDS = 1 << 19                      # remembered words of one Python worker
RANGE_WORDS = MAX_WORDS >> 2             # words that are looked up at once, so at most 5/8 of the slots are used
LETTER, NUMBER, SPACE, OTHER, TEXT_END, UNSAFE = range(6)
_END = 0x10FFFF
_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point in the pattern of the tokenizer."""
    global _CLASSES
    if _CLASSES is None:
        table = np.full(0x110000, UNSAFE, np.uint8)
        for c in [*range(SAFE_LIMIT), *(c for a, b in SAFE_BLOCKS for c in range(a, b))]:
            s = chr(c)
            table[c] = LETTER if regex.match(r"\p{L}", s) else NUMBER if regex.match(r"\p{N}", s) else SPACE if regex.match(r"\s", s) else OTHER
        table[_END] = TEXT_END
        _CLASSES = table
    return _CLASSES


def word_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Flags of the first code point of every word; texts are separated by one TEXT_END each."""
    start = np.ones(len(points), bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= kind == TEXT_END
    after = np.flatnonzero(start & (kind != SPACE) & (kind != TEXT_END))
    after = after[after > 0]
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True                              # the last blank of a run is cut off
    start[after[points[after - 1] == 32]] = False        # and a plain blank joins what follows
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[kind[quote + 1] == LETTER]
    a, b = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
    size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
    for pair in ("re", "ve", "ll"):
        size[(a == ord(pair[0])) & (b == ord(pair[1]))] = 2
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    rest = quote + 1 + size
    start[rest[kind[rest] == LETTER]] = True
    return start


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """A tokenizer file and the ids of the words seen so far.

    The words are found again by a 64-bit hash in an open table, and every word found is compared with the one that is
    remembered. A word with the hash of another one gets its ids from the library each time.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.letters = byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.flat, self.begin = array("I"), array("q", [0])              # ids of all words
        self.points, self.point_begin = array("H"), array("q", [0])      # and their code points
        self.keys = np.zeros(2 * MAX_WORDS, np.uint64)
        self.slots = np.zeros(2 * MAX_WORDS, np.int32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for new ones."""
        size = np.uint64(len(self.keys))
        slot = (key % size).astype(np.int64)
        number = np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            there = self.keys[slot[open_]]
            same = there == key[open_]
            number[open_[same]] = self.slots[slot[open_[same]]]
            open_ = open_[~same & (there != 0)]
            slot[open_] = (slot[open_] + 1) % len(self.keys)
        return number

    def _append(self, words: list[str]) -> np.ndarray:
        """Numbers of words that are added; their ids come from the BPE model of the library."""
        tokenize, letters, flat, begin = self.model.tokenize, self.letters, self.flat, self.begin
        numbers = np.arange(len(words)) + len(begin) - 1
        for word in words:
            flat.extend([t.id for t in tokenize(word.encode().decode("latin1").translate(letters))])
            begin.append(len(flat))
            self.points.frombytes(word.encode("utf-16-le"))
            self.point_begin.append(len(self.points))
        return numbers

    def _learn(self, keys: np.ndarray, words: list[str]) -> np.ndarray:
        """Numbers of new words, which are found by their hashes from now on."""
        numbers = self._append(words)
        slot, left = (keys % np.uint64(len(self.keys))).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]], self.slots[slot[free]] = keys[free], numbers[free]      # of several for one slot the last stays
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) % len(self.keys)
        return numbers

    def _differs(self, points: np.ndarray, starts: np.ndarray, stops: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether each word isn't the remembered one of that number."""
        begin = np.frombuffer(self.point_begin, np.int64)
        own, size = begin[number], stops - starts
        out = begin[number + 1] - own != size
        same = np.flatnonzero(~out)
        size = size[same]
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        unlike = np.frombuffer(self.points, np.uint16)[np.repeat(own[same], size) + place] != points[np.repeat(starts[same], size) + place]
        if unlike.any():
            out[same] = np.add.reduceat(unlike, first) > 0
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, END_ID after each, and the ``len + 1`` borders. An empty text has the END_ID alone."""
        joined = chr(_END).join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = classes()[points]
        ends = np.flatnonzero(kind == TEXT_END)
        if len(ends) != len(texts) or (kind == UNSAFE).any():
            return self._mixed(texts)
        starts = np.flatnonzero(word_starts(points, kind))
        stops = np.append(starts[1:], len(points))
        is_end = kind[starts] == TEXT_END
        points = points.astype(np.uint16)                    # all are below; but for the ends, which are no words
        key = word_hash(points.view(np.uint8), 2 * starts, 2 * stops) | np.uint64(1)
        parts, borders = [], [np.zeros(1, np.int64)]
        for at in range(0, len(starts), RANGE_WORDS):          # one range but for very long texts
            part = slice(at, at + RANGE_WORDS)
            ids, last = self._range(joined, points, starts[part], stops[part], is_end[part], key[part])
            borders.append(last + sum(map(len, parts)))
            parts.append(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate(borders)

    def _range(self, joined: str, points: np.ndarray, starts: np.ndarray, stops: np.ndarray, is_end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of at most RANGE_WORDS words, and the borders after text ends; the table always has room for them."""
        if len(self.begin) > MAX_WORDS:
            self._clear()
        number = self._find(key)
        cut = lambda at: [joined[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
        if len(new := np.flatnonzero((number < 0) & ~is_end)):
            own, first, inverse = np.unique(key[new], return_index=True, return_inverse=True)
            number[new] = self._learn(own, cut(new[first]))[inverse]
        word = np.flatnonzero(~is_end)
        if len(other := word[self._differs(points, starts[word], stops[word], number[word])]):
            number[other] = self._append(cut(other))
        begin = np.frombuffer(self.begin, np.int64)
        number[is_end] = 0
        size = np.where(is_end, 1, (begin[1:] - begin[:-1])[number]) if len(begin) > 1 else np.ones(len(starts), np.int64)
        total = np.cumsum(size)
        ids = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(1, np.uint32)
        out = ids[np.repeat(begin[number] - total + size, size) + np.arange(total[-1])]
        last = total[is_end]
        out[last - 1] = END_ID
        return out, last

    def _mixed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        table = classes()
        plain = [not (table[np.frombuffer(t.encode("utf-32-le"), np.uint32)] >= TEXT_END).any() for t in texts]
        simple = [t for t, ok in zip(texts, plain, strict=True) if ok]
        ids, borders = self.encode(simple) if simple else (None, None)
        other = iter(self.whole([t for t, ok in zip(texts, plain, strict=True) if not ok]))
        parts, k = [], 0
        for ok in plain:
            parts.append(ids[borders[k]:borders[k + 1]] if ok else np.array([*next(other), END_ID], np.uint32))
            k += ok
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    return kept(path, lambda: Encoder(path))
