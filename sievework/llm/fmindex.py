"""A compressed full-text index over a shard of keys, searched backward.

The text of a shard is its keys between separators. Kept are the text's
Burrows-Wheeler transform, one byte a symbol, counts of every symbol at each
block's start (two bytes within a superblock, four at its start) and the key
behind each separator; the suffix array is dropped once it has ordered these.
A batch of patterns is extended to the left one symbol at a time until its
interval is empty, which gives each pattern's maximal match that ends where
the pattern ends.
"""

from __future__ import annotations

import numpy as np

#: Bytes that UTF-8 never uses: between keys and at the end.
SEPARATOR, END = 0xFF, 0xFE
BLOCK = 256
#: Blocks of a superblock; its symbols must stay below 2 ** 16.
SUPER = 128
_PLACES = np.arange(BLOCK)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; doubles the compared length and re-sorts only what is still tied."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    first = np.zeros(n, np.uint64)
    for j in range(8):
        first = (first << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(first, kind="stable")
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = first[order[1:]] != first[order[:-1]]
    del first
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    width = 8
    while True:
        single = new & np.append(new[1:], True)
        tied = np.flatnonzero(~single)  # places in the order that are not settled
        if not len(tied):
            return order
        at = order[tied]
        follows = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | follows.astype(np.uint64)
        by = np.argsort(key, kind="stable")
        key, order[tied] = key[by], at[by]
        differs = np.empty(len(tied), bool)
        differs[0] = True
        differs[1:] = key[1:] != key[:-1]
        new[tied] = differs
        rank[order[tied]] = np.maximum.accumulate(np.where(differs, tied, 0))
        width *= 2


class FMIndex:
    """Index of a list of byte strings."""

    def __init__(self, keys: list[bytes]):
        joined = bytes([SEPARATOR]).join([b"", *keys, b""]) + bytes([END])
        text = np.frombuffer(joined, np.uint8)
        if len(text) >= 2**31:
            raise ValueError("a shard must stay under 2 GiB")
        present = np.unique(text)
        self.code = np.full(256, -1, np.int16)
        self.code[present] = np.arange(len(present))
        coded = self.code[text].astype(np.uint8)
        # a shifted copy keeps 0 for what lies behind the end
        order = suffix_array(coded + np.uint8(1))
        self.n = len(text)
        pad = -self.n % BLOCK
        self.rows = np.concatenate([coded[order - 1], np.full(pad + BLOCK, 255, np.uint8)]).reshape(-1, BLOCK)
        counts = np.bincount(coded, minlength=len(present))
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        blocks = len(self.rows)
        self.supers = np.zeros((-(-blocks // SUPER), len(present)), np.uint32)
        self.blocks = np.zeros((blocks, len(present)), np.uint16)
        for c in range(len(present)):
            upto = np.zeros(blocks, np.int64)
            upto[1:] = np.cumsum(np.count_nonzero(self.rows[:-1] == c, axis=1))
            self.supers[:, c] = upto[::SUPER]
            self.blocks[:, c] = upto - np.repeat(upto[::SUPER], SUPER)[:blocks]
        # which key stands behind the separator that a suffix begins with
        marks = np.flatnonzero(text == SEPARATOR)
        mark = self.code[SEPARATOR]
        self.key_behind = np.searchsorted(marks, order[self.before[mark] : self.before[mark + 1]]).astype(np.int32)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.rows, self.blocks, self.supers, self.key_behind))

    def _count(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform ahead of each place."""
        block = upto // BLOCK
        hit = (self.rows[block] == symbol[:, None].astype(np.uint8)) & (_PLACES < (upto - block * BLOCK)[:, None])
        ahead = np.bitwise_count(np.packbits(hit, axis=1).view(np.uint64)).sum(axis=1)
        return self.supers[block // SUPER, symbol].astype(np.int64) + self.blocks[block, symbol] + ahead

    def search(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per pattern the length of its maximal match ending at its end, and how often that occurs."""
        length, low, high = self._intervals(patterns)
        return length, np.where(length > 0, high - low, 0)

    def _intervals(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.fromiter((len(p) for p in patterns), np.int64, len(patterns))
        ends = np.cumsum(size)
        flat = self.code[np.frombuffer(b"".join(patterns), np.uint8)] if len(patterns) else np.zeros(0, np.int16)
        low, high = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64)
        length = np.zeros(len(size), np.int64)
        active = np.flatnonzero(size > 0)
        done = 0
        while len(active):
            symbol = flat[ends[active] - 1 - done].astype(np.int64)
            known = symbol >= 0
            active, symbol = active[known], symbol[known]
            lo = self.before[symbol] + self._count(symbol, low[active])
            hi = self.before[symbol] + self._count(symbol, high[active])
            alive = hi > lo
            active, done = active[alive], done + 1
            low[active], high[active], length[active] = lo[alive], hi[alive], done
            active = active[size[active] > done]
        return length, low, high

    def located(self, keys: list[bytes], batch: int = 20_000) -> np.ndarray:
        """The number of the indexed key that each key is as a whole, or -1; of repeated ones any."""
        mark = bytes([SEPARATOR])
        out = [np.zeros(0, np.int64)]
        for i in range(0, len(keys), batch):
            some = [mark + k + mark for k in keys[i : i + batch]]
            length, low, _ = self._intervals(some)
            full = length == np.fromiter(map(len, some), np.int64, len(some))
            # a match that spans a whole key begins with the separator before it
            at = np.where(full, low - self.before[self.code[SEPARATOR]], 0)
            out.append(np.where(full, self.key_behind[at], -1))
        return np.concatenate(out)
