"""External induced sorting of the suffixes of one shard.

Suffixes are typed S or L by whether they are smaller or larger than their successor. Sorted LMS suffixes (S behind an L) induce the order of
all L suffixes, and those the order of all S suffixes: a suffix is taken off a priority queue in order, and its predecessor enters the
queue under its own first letter. LMS substrings are sorted by the same induction, named, and the string of names is sorted by
recursion; the recursion ends where the names fit into memory and are sorted there by prefix doubling.

The queue works in bulk: its keys are letters, entries of one letter leave it together and in the order in which they came. Entries beyond the
memory bound lie in a file, and so do the text and the orders, as memory maps.

Only the first ``depth`` letters decide; suffixes that agree in them stay next to each other in no stated order.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

#: Names that the base case sorts in memory; bytes that queues and maps keep there.
BASE, MEMORY = 1 << 23, 256 << 20


class Disk:
    """Temporary files of one sort; they vanish with it."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.folder = memory, None

    def file(self):
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        return tempfile.TemporaryFile(dir=self.folder.name)

    def array(self, n: int, dtype: type) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        return np.empty(n, dtype) if size <= self.memory or not n else np.memmap(self.file(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


class Queue:
    """A priority queue of (letter, suffix) entries, taken out letter by letter, each letter's entries in the order of arrival."""

    def __init__(self, disk: Disk):
        self.disk, self.held, self.kept, self.back = disk, 0, defaultdict(list), None

    def push(self, letters: np.ndarray, items: np.ndarray) -> None:
        if not len(items):
            return
        order = np.argsort(letters, kind="stable")
        letters, items = letters[order], items[order]
        cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        for at, part in zip([0, *cuts.tolist()], np.split(items, cuts), strict=True):
            self.kept[int(letters[at])].append(part)
        self.held += items.nbytes
        if self.held > self.disk.memory:
            self.spill()

    def spill(self) -> None:
        """Writes what is held to the file; a letter remembers where its parts lie."""
        if self.back is None:
            self.back = self.disk.file()
        self.back.seek(0, 2)
        for parts in self.kept.values():
            for i, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    at = self.back.tell()
                    self.back.write(np.ascontiguousarray(part).tobytes())
                    parts[i] = (at, len(part), part.dtype)
        self.held = 0

    def take(self, letter: int) -> np.ndarray:
        parts = self.kept.pop(letter, [])
        out = []
        for part in parts:
            if isinstance(part, tuple):
                at, n, dtype = part
                self.back.seek(at)
                part = np.frombuffer(self.back.read(n * np.dtype(dtype).itemsize), dtype)
            else:
                self.held -= part.nbytes
            out.append(part)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. The end of the text counts as a smallest letter, so the last suffix is L."""
    n = len(text)
    ends = np.flatnonzero(text[1:] != text[:-1])  # a run's last place
    kind = np.empty(len(ends) + 1, bool)
    kind[:-1] = text[ends] < text[ends + 1]
    kind[-1] = False
    return np.repeat(kind, np.diff(np.concatenate([[-1], ends, [n - 1]])))


def induce(text: np.ndarray, kind: np.ndarray, seeds: np.ndarray, disk: Disk, lms_only: bool) -> np.ndarray:
    """The order of all suffixes, given LMS suffixes in order (or, for their substrings, in any order that sorts by first letters).
    lms_only: of the result only LMS suffixes are wanted."""
    n = len(text)
    letters = np.unique(text)
    lms = np.zeros(n, bool)
    lms[1:] = kind[1:] & ~kind[:-1]
    seeds = seeds[np.argsort(text[seeds], kind="stable")]
    seed_at = np.searchsorted(text[seeds], letters, "left"), np.searchsorted(text[seeds], letters, "right")
    larger: dict[int, list[np.ndarray]] = {}
    queue = Queue(disk)
    queue.push(text[n - 1 :], np.array([n - 1]))

    def before(items: np.ndarray, of_kind: bool) -> np.ndarray:
        prev = items[items > 0] - 1
        return prev[kind[prev] == of_kind]

    for i, c in enumerate(letters.tolist()):
        larger[c], now = [], queue.take(c)
        while len(now):
            larger[c].append(now)
            prev = before(now, False)
            same = text[prev] == c
            queue.push(text[prev[~same]], prev[~same])
            now = prev[same]
        prev = before(seeds[seed_at[0][i] : seed_at[1][i]], False)
        queue.push(text[prev], prev)
    out = disk.array(int(lms.sum()) if lms_only else n, np.int64)
    at, queue = len(out), Queue(disk)

    def emit(items: np.ndarray) -> None:
        """Fills the result from its end."""
        nonlocal at
        if lms_only:
            items = items[lms[items]]
        out[at - len(items) : at] = items[::-1]
        at -= len(items)

    for c in reversed(letters.tolist()):
        now = queue.take(c)
        while len(now):
            emit(now)
            prev = before(now, True)
            same = text[prev] == c
            queue.push(text[prev[~same]], prev[~same])
            now = prev[same]
        whole = larger.pop(c)
        for part in reversed(whole):
            part = part[::-1]
            emit(part)
            prev = before(part, True)
            queue.push(text[prev], prev)
    return out


def same_substrings(text: np.ndarray, kind: np.ndarray, order: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For LMS suffixes in the order of their substrings: whether a substring equals the one before. stop: where each substring ends (the
    next LMS place)."""
    size = stop[order] - order
    equal = np.zeros(len(order), bool)
    alive = np.flatnonzero(size[1:] == size[:-1]) + 1
    step = 0
    while len(alive):
        a, b = order[alive] + step, order[alive - 1] + step
        room = np.minimum(a, b) >= 0
        inside = (a < len(text)) & (b < len(text)) & room
        alive, a, b = alive[inside], a[inside], b[inside]
        hit = (text[a] == text[b]) & (kind[a] == kind[b])
        alive = alive[hit]
        done = size[alive] == step
        equal[alive[done]] = True
        alive = alive[~done]
        step += 1
    return equal


def doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first ``depth`` names, in memory."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    key = names[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    reach = 1
    lone = fresh & np.concatenate([fresh[1:], [True]])
    open_ = np.flatnonzero(~lone)  # places in the order whose group has others
    while len(open_) and reach < depth:
        items = order[open_]
        next_ = np.where(items + reach < n, rank[np.minimum(items + reach, n - 1)], -1)
        own = rank[items]
        sort = np.lexsort((next_, own))
        items, own, next_ = items[sort], own[sort], next_[sort]
        order[open_] = items
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (next_[1:] != next_[:-1])])
        rank[items] = open_[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        lone = fresh & np.concatenate([fresh[1:], [True]])
        open_ = open_[~lone]
        reach *= 2
    return order


def suffix_order(text: np.ndarray, depth: int, disk: Disk, base: int = BASE) -> np.ndarray:
    """Starts of all suffixes of a non-empty string of letters, in the order of their first ``depth`` letters."""
    kind = suffix_types(text)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    if not len(lms):
        return induce(text, kind, lms, disk, False)
    order = induce(text, kind, lms, disk, True)
    place = np.full(len(text) + 1, -1, np.int64) if len(lms) * 8 > len(text) else None
    stop_of = np.append(lms[1:], len(text))
    stop = place if place is not None else disk.array(len(text) + 1, np.int64)
    stop[lms] = stop_of
    fresh = ~same_substrings(text, kind, order, stop)
    name = np.cumsum(fresh) - 1
    stop[order] = name
    names = stop[lms].copy()
    del stop, place
    if name[-1] + 1 == len(lms):
        return induce(text, kind, order, disk, False)
    # A name stands for at least two letters but the last, so half as many names reach as deep, and one more for the rest.
    deep = depth // 2 + 2
    inner = doubling(names, deep) if len(names) <= base else suffix_order(names, deep, disk, base)
    return induce(text, kind, lms[inner], disk, False)


def repeated_windows(text: np.ndarray, valid: np.ndarray, width: int, memory: int = MEMORY, base: int = BASE) -> np.ndarray:
    """Whether the ``width`` letters that start at each place of ``valid`` start at another place of ``valid``, too. Neighbours in
    suffix order whose common prefix has ``width`` letters are repeats."""
    flags = np.zeros(len(text), bool)
    if not len(text) or not valid.any():
        return flags
    disk = Disk(memory)
    try:
        order = suffix_order(text, width, disk, base)
        order = order[valid[order]]
        # Common prefixes of neighbours: rolled hashes rule most out, the letters themselves decide.
        code = window_codes(text, width)
        for low in range(1, len(order), 1 << 22):
            a, b = order[low - 1 : min(low - 1 + (1 << 22), len(order) - 1)], order[low : low + (1 << 22)]
            hit = np.flatnonzero(code[a] == code[b])
            for i in range(0, len(hit), 1 << 15):
                x, y = a[hit[i : i + (1 << 15)]], b[hit[i : i + (1 << 15)]]
                view = np.lib.stride_tricks.sliding_window_view(text, width)
                same = (view[x] == view[y]).all(1)
                flags[x[same]] = flags[y[same]] = True
        return flags
    finally:
        disk.close()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        up, down = np.full(size, MULTIPLIER, np.uint64), np.full(size, pow(int(MULTIPLIER), -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _POWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[0][:n], _POWERS[1][:n]


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def window_codes(text: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of the ``width`` letters from each place on; places without room hash what there is."""
    n = len(text)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    end = np.minimum(np.arange(n) + width, n)
    code = (total[end] - total[:n]) * down
    code ^= code >> np.uint64(31)
    code *= np.uint64(0xD6E8FEB86659FD93)
    code ^= code >> np.uint64(29)
    return code
