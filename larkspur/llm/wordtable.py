"""Token ids of texts by way of a bounded table of the ids of their distinct words."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np

#: Distinct words whose ids a task remembers at once.
REMEMBERED = 400_000
#: Letters of text that are split together, about.
BLOCK = 1 << 19


class WordTable:
    """Splits texts into words, encodes each distinct word once and puts the ids together again.

    A subclass says how a text is split and how new words are encoded.
    """

    def __init__(self, most: int = REMEMBERED):
        self.most = most
        self.clear()

    def words(self, text):
        """The words of a text; their ids in a row are the text's."""
        raise NotImplementedError

    def encode(self, fresh: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and how many each word has."""
        raise NotImplementedError

    def forget(self) -> None:
        """Called when the table is emptied."""

    def clear(self) -> None:
        self.codes: dict = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.held = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep the ids of the words that were given codes last; the arrays double when they are full."""
        first, last = len(self.codes) - len(sizes), len(self.codes)
        while last > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.held + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.held : self.held + len(ids)] = ids
        self.starts[first:last] = self.held + np.cumsum(sizes) - sizes
        self.sizes[first:last] = sizes
        self.held += len(ids)

    def ids(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin (one more at the end)."""
        blocks, lo = [], 0
        while lo < len(texts):  # words are told apart in small tables first: the large one is slow to reach
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BLOCK):
                size += len(texts[hi])
                hi += 1
            words = [self.words(t) for t in texts[lo:hi]]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            flat = list(itertools.chain.from_iterable(words))
            place: defaultdict = defaultdict(itertools.count().__next__)
            local = np.fromiter(map(place.__getitem__, flat), np.int32, len(flat))
            blocks.append((list(place), local, counts))
            lo = hi
        fresh = list(dict.fromkeys(n for names, _, _ in blocks for n in names if n not in self.codes))
        if fresh and len(self.codes) + len(fresh) > self.most and self.codes:
            self.clear()
            self.forget()
            fresh = list(dict.fromkeys(n for names, _, _ in blocks for n in names))
        if fresh:
            self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh)), strict=True))
            self.add(*self.encode(fresh))
        out, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for names, local, counts in blocks:
            codes = np.fromiter(map(self.codes.__getitem__, names), np.int64, len(names))[local]
            sizes = self.sizes[codes]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[: self.held][np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(total)])
            lengths.append(np.diff(np.r_[0, ends][np.cumsum(counts)], prepend=0))
        return np.concatenate(out), np.r_[0, np.cumsum(np.concatenate(lengths))]
