"""Suffix sorting by external induced sorting.

A suffix is of type S if it is smaller than the one after it, else of type L;
an S suffix after an L suffix is a seed.  Seeds are sorted by recursion on the
names of the substrings between them.  Then two passes induce the rest: a
priority queue gives suffixes in order, and each one popped pushes the suffix
before it, first those of type L in ascending, then those of type S in
descending order.

The queue keeps its tuples (key, position) in blocks of neighbouring keys.  Only
the block in turn is sorted; the others are lists in the order of pushing, and
go to disk when MEMORY_ITEMS tuples are waiting.  A pop takes as many tuples at
once as nothing that they push can come between.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np

#: Tuples waiting in memory before all blocks but the one in turn go to disk.
MEMORY_ITEMS = 250_000
#: Tuples that a block of the queue holds at least; else about so many square roots of all, which balances popping and pushing.
BLOCK_ITEMS, BLOCK_ROOTS = 64, 4
#: Tuples looked at for one pop.
POP_ITEMS = 8192

_NEVER = np.int64(1) << np.int64(62)


class BlockQueue:
    """Tuples (key, position) by key, then by time of pushing; keys pushed are never below the last one popped."""

    def __init__(self, keys: np.ndarray, positions: np.ndarray, bounds: np.ndarray, scratch: str) -> None:
        self.bounds, self.scratch = bounds, scratch
        self.numbers = np.uint16 if len(bounds) < 1 << 16 else np.int64  # short numbers are sorted by their digits
        self.blocks: list[list[np.ndarray]] = [[] for _ in range(len(bounds) + 1)]  # pieces of a row of keys and a row of positions
        self.on_disk: list[list[tuple[str, int, int]]] = [[] for _ in range(len(bounds) + 1)]
        self.waiting, self.files, self.turn = 0, 0, -1
        self.keys = self.positions = np.zeros(0, np.int64)
        self.push(keys, positions)

    def push(self, keys: np.ndarray, positions: np.ndarray) -> None:
        if not len(keys):
            return
        block = self.bounds.searchsorted(keys, side="right").astype(self.numbers)
        order = block.argsort(kind="stable")
        block = block[order]
        both = np.empty((2, len(keys)), np.int64)
        both[0], both[1] = keys[order], positions[order]
        starts = [0, *((block[1:] != block[:-1]).nonzero()[0] + 1).tolist()]
        for at, a, b in zip(block[starts].tolist(), starts, [*starts[1:], len(block)], strict=True):
            if at == self.turn:
                self._sorted(np.concatenate([self.keys, both[0, a:b]]), np.concatenate([self.positions, both[1, a:b]]))
            else:
                self.blocks[at].append(both[:, a:b])
                self.waiting += b - a
        if self.waiting > MEMORY_ITEMS:
            self._spill()

    def _sorted(self, keys: np.ndarray, positions: np.ndarray) -> None:
        order = keys.argsort(kind="stable")
        self.keys, self.positions = keys[order], positions[order]

    def _spill(self) -> None:
        name = f"{self.scratch}/run-{self.files}.bin"
        self.files += 1
        at = 0
        with open(name, "wb") as out:
            for i, waiting in enumerate(self.blocks):
                if waiting:
                    keys, positions = np.concatenate(waiting, axis=1)
                    out.write(keys.tobytes())
                    out.write(positions.tobytes())
                    self.on_disk[i].append((name, at, len(keys)))
                    at += 16 * len(keys)
                    self.blocks[i] = []
        self.waiting = 0

    def _load(self, at: int) -> None:
        parts = []
        for name, offset, n in self.on_disk[at]:
            raw = np.fromfile(name, np.int64, 2 * n, offset=offset)
            parts.append(raw.reshape(2, n))
        self.on_disk[at] = []
        stored = sum(p.shape[1] for p in parts)
        parts += self.blocks[at]
        self.blocks[at] = []
        if parts:
            keys, positions = np.concatenate(parts, axis=1)
            self.waiting -= len(keys) - stored
            self._sorted(keys, positions)

    def pop(self, induced: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        """The next positions and the keys that they push (_NEVER: none)."""
        while not len(self.keys):
            self.turn += 1
            if self.turn == len(self.blocks):
                return None
            self._load(self.turn)
        keys, positions = self.keys[:POP_ITEMS], self.positions[:POP_ITEMS]
        pushed = induced(positions)
        # nothing pushed may belong between the tuples that are taken together
        n = len(keys) if pushed.min() >= keys[-1] else int((np.minimum.accumulate(pushed) < keys).argmax())
        self.keys, self.positions = self.keys[n:], self.positions[n:]
        return positions[:n], pushed[:n]


def _bounds(keys: np.ndarray) -> np.ndarray:
    """Keys at which blocks begin."""
    ordered, size = np.sort(keys), BLOCK_ITEMS + BLOCK_ROOTS * int(len(keys) ** 0.5)
    return np.unique(ordered[size::size])


def _induce(keys: np.ndarray, positions: np.ndarray, all_keys: np.ndarray, induced, scratch: str) -> np.ndarray:
    queue = BlockQueue(keys, positions, _bounds(all_keys), scratch)
    out = []
    while (taken := queue.pop(induced)) is not None:
        found, pushed = taken
        out.append(found)
        go = pushed < _NEVER
        queue.push(pushed[go], found[go] - 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _names(text: np.ndarray, s_type: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, bool]:
    """Rank of the substring from each seed to the next; whether all differ."""
    symbols = 2 * text + s_type
    width = max(1, int(symbols.max()).bit_length())
    each = max(1, 62 // width)
    ends = np.append(seeds[1:] + 1, len(text))
    rank = np.zeros(len(seeds), np.int64)
    open_ = np.arange(len(seeds))
    depth = 0
    while len(open_):
        packed = np.zeros(len(open_), np.int64)
        for j in range(each):
            at = seeds[open_] + depth + j
            inside = at < ends[open_]
            packed = (packed << width) | np.where(inside, symbols[np.minimum(at, len(text) - 1)], 0)
        order = np.lexsort((packed, rank[open_]))
        r, p = rank[open_][order], packed[order]
        new_group = np.append(True, r[1:] != r[:-1])
        changed = new_group | np.append(True, p[1:] != p[:-1])
        # a rank is the number of seeds before its group, so refining leaves other groups alone
        first = np.maximum.accumulate(np.where(changed, np.arange(len(order)), 0))
        group = np.maximum.accumulate(np.where(new_group, np.arange(len(order)), 0))
        rank[open_[order]] = r + first - group
        depth += each
        size = np.diff(np.append(np.flatnonzero(changed), len(order)))
        many = np.repeat(size > 1, size)
        again = open_[order][many]
        open_ = np.sort(again[seeds[again] + depth < ends[again]])
    return rank, len(np.unique(rank)) == len(rank)


def suffix_array(text: np.ndarray, scratch: str | None = None) -> np.ndarray:
    """Start positions of the suffixes of an int64 text in order; the last number must be 0 and the only 0."""
    if scratch is None:
        # a task's own scratch, as for Spark's spills
        with tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as folder:
            return suffix_array(text, folder)
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(np.diff(text))
    nxt = np.arange(n - 1)
    # an equal neighbour takes the type of the next place that differs
    nxt[step == 0] = n
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    s_type = np.append(step[np.minimum(nxt, n - 2)] > 0, True)
    seeds = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    names, unique = _names(text, s_type, seeds)
    if unique:
        ordered = seeds[np.argsort(names, kind="stable")]
    else:
        # the last seed is the final 0, whose name is the least and occurs once
        _, dense = np.unique(names, return_inverse=True)
        ordered = seeds[suffix_array(dense.astype(np.int64), scratch)]

    def pushes(keys: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """The key of the suffix before each position."""
        before = np.append(_NEVER, keys[:-1])
        return lambda at: before[at]

    keys_l = 2 * text[~s_type]
    both = _induce(2 * text[ordered] + 1, ordered, np.concatenate([keys_l, 2 * text[seeds] + 1]), pushes(np.where(s_type, _NEVER, 2 * text)), scratch)
    l_ordered = both[~s_type[both]][::-1]

    down = _induce(-2 * text[l_ordered], l_ordered, -(2 * text + s_type), pushes(np.where(s_type, -(2 * text + 1), _NEVER)), scratch)
    return np.append(n - 1, down[::-1])
