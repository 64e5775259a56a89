"""Suffix order and common prefixes of a shard by recursive induced sorting through disk-backed priority queues."""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyarrow import fs

#: Suffix tuples that the queues of one induction hold in memory together, and those of one step.
MEMORY, STEP = 1 << 20, 1 << 18
#: Tuples of a queue's file, which are buffered before they are written.
RUN = 1 << 14
#: S* positions, as a multiple of the queues' memory, up to which their order is worked out in memory; above it the sort recurses.
BASE = 8
_TUPLE = "<u4,<u2"


class Store:
    """A task's own files in the shared folder, of any scheme; without a folder, everything stays in memory."""

    def __init__(self, to: str | None) -> None:
        self.system, self.root, self.n = None, "", 0
        self.written = 0
        if to is not None:
            self.system, root = fs.FileSystem.from_uri(to)
            self.root = f"{root}/sort-{uuid.uuid4().hex}"
            self.system.create_dir(self.root, recursive=True)
        self.mapped = isinstance(self.system, fs.LocalFileSystem)

    def put(self, rows: np.ndarray) -> str:
        self.n += 1
        self.written += len(rows)
        with self.system.open_output_stream(at := f"{self.root}/{self.n}") as out:
            out.write(rows.tobytes())
        return at

    def take(self, at: str) -> np.ndarray:
        with self.system.open_input_stream(at) as s:
            rows = np.frombuffer(s.read(), _TUPLE)
        self.system.delete_file(at)
        return rows

    def array(self, n: int, kind: str) -> np.ndarray:
        """Zeros in a mapped file where the folder is mounted, else in memory."""
        if not self.mapped or not n:
            return np.zeros(n, kind)
        self.n += 1
        return np.memmap(f"{self.root}/{self.n}", kind, "w+", shape=(n,))

    def close(self) -> None:
        if self.mapped:
            shutil.rmtree(Path(self.root), ignore_errors=True)
        elif self.system is not None:
            self.system.delete_dir(self.root)


class Pool:
    """What the queues of one induction may hold in memory together."""

    def __init__(self, store: Store, memory: int) -> None:
        self.store, self.memory, self.held = store, memory, 0


class Queue:
    """Suffix tuples (position, common prefix with the tuple before) of one first character.

    Pushes come in ascending order, so the first in is the least: with a queue a
    character, the least of all queues is the front of the first that is not empty,
    which makes them one monotone priority queue. When the pool is full, tuples go to
    files, which are read back and deleted in turn.
    """

    def __init__(self, pool: Pool) -> None:
        self.pool = pool
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.files: list[str] = []
        self.tail: list[tuple[np.ndarray, np.ndarray]] = []
        self.in_tail = 0

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(pos):
            return
        pos = pos.astype(np.uint32)
        if self.pool.store.system is None or not self.tail and not self.files and self.pool.held + len(pos) <= self.pool.memory:
            self.held.append((pos, lcp))
            self.pool.held += len(pos)
            return
        self.tail.append((pos, lcp))
        self.in_tail += len(pos)
        if self.in_tail >= RUN:
            rows = np.empty(self.in_tail, _TUPLE)
            rows["f0"], rows["f1"] = (np.concatenate([x[k] for x in self.tail]) for k in (0, 1))
            self.files.append(self.pool.store.put(rows))
            self.tail, self.in_tail = [], 0

    def _read(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.pool.store.take(self.files.pop(k))
        return rows["f0"].copy(), rows["f1"].copy()

    def pop(self) -> tuple[np.ndarray, np.ndarray] | None:
        if self.held:
            k, n = 0, 0
            while k < len(self.held) and (not k or n + len(self.held[k][0]) <= STEP):
                n += len(self.held[k][0])
                k += 1
            some, self.held = self.held[:k], self.held[k:]
            self.pool.held -= n
        elif self.files:
            return self._read(0)
        else:
            some, self.tail, self.in_tail = self.tail, [], 0
        if not some:
            return None
        return some[0] if len(some) == 1 else (np.concatenate([x for x, _ in some]), np.concatenate([y for _, y in some]))

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while self.tail or self.files or self.held:
            pos, lcp = self.tail.pop() if self.tail else self._read(-1) if self.files else self.held.pop()
            if not self.tail and not self.files:
                self.pool.held -= len(pos)
            yield pos[::-1], lcp[::-1]


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, little-endian; t ends in eight spare bytes."""
    return np.ndarray((len(t) - 7,), "<u8", t, strides=(1,))


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int | np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at a and b, at most limit; t ends in spare bytes, its last own byte is unique."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    w, last = _words(t), len(t) - 8
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    off = 0
    most = np.broadcast_to(limit, len(a))
    while len(live := live[most[live] > off]):
        x = w[np.minimum(a[live] + off, last)] ^ w[np.minimum(b[live] + off, last)]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, (np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64))
        out[live] += same
        live = live[same == 8]
        off += 8
    return np.minimum(out, limit)


def _stars(t: np.ndarray, n: int, store: Store, block: int = 1 << 20) -> np.ndarray:
    """The S* positions in text order: suffixes less than the next one and after one that is not; the last character is the least. Types are told block by block."""
    found, carry = [], True  # whether the suffix after the block is S
    for b in range(n - 1, 0, -block):
        a = max(0, b - block)
        x = t[a : b + 1]
        change = np.flatnonzero(x[1:] != x[:-1])
        last = change[-1] + 1 if len(change) else 0
        up = np.concatenate([np.repeat(x[change] < x[change + 1], np.diff(change, prepend=-1)), np.full(b - a - last, carry), [carry]])
        found.append((np.flatnonzero(up[1:] & ~up[:-1]) + a + 1).astype(np.uint32))
        carry = up[0]
    out = store.array(sum(map(len, found)) or 1, "<u4")
    out[:] = np.concatenate(found[::-1]) if any(map(len, found)) else n - 1
    return out


def _in_memory(t: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """The suffixes at the S* positions in order, as far as their first `limit` characters tell.

    S*-substrings are sorted as tuples of eight-byte words and named by rank; one
    that goes on where another ends is the lesser, hence the padding with the
    greatest byte. The base of the recursion: the reduced text of names is ordered by
    doubling.
    """
    big = np.ndarray((len(t) - 7,), ">u8", t, strides=(1,))
    size = np.concatenate([starts[1:] - starts[:-1] + 1, [1]])
    rank = np.zeros(len(starts), np.int64)
    open_, off = np.arange(len(starts)), 0
    while len(open_):
        left = np.clip(size[open_] - off, 0, 8)
        word = big[np.minimum(starts[open_] + off, len(big) - 1)].astype(np.uint64)
        pad = np.where(left < 8, np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.minimum(left, 7) * 8).astype(np.uint64), np.uint64(0))
        word = np.where(left == 0, np.uint64(0xFFFFFFFFFFFFFFFF), word | pad)
        order = np.lexsort((word, rank[open_]))
        r, x = rank[open_][order], word[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])])
        base = np.concatenate([[True], r[1:] != r[:-1]])
        first = np.maximum.accumulate(np.where(base, np.arange(len(r)), 0))
        group = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        rank[open_[order]] = r + (group - first)  # ranks leave room: the first place of a group in it
        off += 8
        end = np.concatenate([np.flatnonzero(new)[1:], [len(r)]]) if len(r) else np.empty(0, int)
        many = np.repeat(end - np.flatnonzero(new), end - np.flatnonzero(new)) > 1
        open_ = open_[order][many]
        longer = size[open_] > off
        # a tie of equal words goes on while any of its group is longer
        if len(open_):
            g = rank[open_]
            keep = np.unique(g[longer])
            open_ = open_[np.isin(g, keep)]
    return _doubled(rank, starts, limit)


def _doubled(names: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """The starts in order of the text of names, by doubling; a name is the number of starts with lesser ones."""
    span = 1
    live = np.arange(len(starts))
    while span < limit:
        g, counts = np.unique(names[live], return_counts=True)
        live = live[np.isin(names[live], g[counts > 1])]
        if not len(live):
            break
        nxt = live + span
        key = np.where(nxt < len(names), names[np.minimum(nxt, len(names) - 1)], -1)
        order = np.lexsort((key, names[live]))
        r, x = names[live][order], key[order]
        base = np.concatenate([[True], r[1:] != r[:-1]])
        new = base | np.concatenate([[True], x[1:] != x[:-1]])
        first = np.maximum.accumulate(np.where(base, np.arange(len(r)), 0))
        group = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        fresh = names.copy()
        fresh[live[order]] = r + (group - first)
        names, span = fresh, span * 2
    return starts[np.argsort(names, kind="stable")]


def _recursive(t: np.ndarray, n: int, starts: np.ndarray, limit: int, store: Store, memory: int) -> np.ndarray:
    """As _in_memory(), for more S* positions than memory holds.

    S*-substrings are sorted by an induction from S* positions in any order and named
    by rank. The text of names, each written as so many characters, is sorted by the
    same way one level deeper; of its suffixes those count at which a name begins.
    Where that text would not be shorter by a quarter, as with so many names that each
    takes three characters, the names are ordered by doubling in memory, at some 50
    bytes a name; the queues' bound holds all the same.
    """
    m = len(starts)
    sorted_, k = store.array(m, "<u4"), m
    by_char, at = store.array(m, "<u4"), np.zeros(257, np.int64)
    for a in range(0, m, STEP):
        at[1:] += np.bincount(t[starts[a : a + STEP]], minlength=256)
    bounds = np.cumsum(at)
    fill = bounds[:-1].copy()
    for a in range(0, m, STEP):
        pos = starts[a : a + STEP]
        chars = t[pos]
        order = np.argsort(chars, kind="stable")
        counts = np.bincount(chars, minlength=256)
        to = np.repeat(fill - (np.cumsum(counts) - counts), counts) + np.arange(len(pos))
        by_char[to] = pos[order]
        fill += counts
    seeds = lambda c: ((by_char[a : (e := min(a + STEP, bounds[c + 1]))], np.zeros(e - a, np.uint16)) for a in range(bounds[c], bounds[c + 1], STEP))
    for pos, _, small in _induced(t, n, seeds, limit, store, memory):
        if small:
            pos = pos.astype(np.int64)
            star = pos[(pos > 0) & (t[np.maximum(pos - 1, 0)] > t[pos])]
            sorted_[k - len(star) : k] = star[::-1]
            k -= len(star)
    names, name, last = store.array(m, "<u4"), 0, None
    for a in range(0, m, STEP):
        pos = sorted_[a : a + STEP].astype(np.int64)
        place = np.searchsorted(starts, pos)
        size = starts[np.minimum(place + 1, m - 1)].astype(np.int64) - pos + 1
        size[place == m - 1] = 1
        before, before_size = (np.concatenate([[x[0] if last is None else y], x[:-1]]) for x, y in ((pos, last and last[0]), (size, last and last[1])))
        same = size == before_size
        same[same] = common(t, before[same], pos[same], size[same]) >= size[same]
        if last is None:
            same[0] = True
        rank = name + np.cumsum(~same)
        names[place] = rank
        name, last = int(rank[-1]), (pos[-1], size[-1])
    if name + 1 == m:
        return sorted_
    wide = next(w for w in range(1, 9) if 253**w > name)
    if 4 * m * wide > 3 * n:  # a deeper level would be about as long
        counts = np.bincount(names)
        return _doubled((np.cumsum(counts) - counts)[names], np.asarray(starts, np.int64), limit)
    text = store.array(m * wide + 1 + 8, "u1")
    for a in range(0, m, STEP):
        v = names[a : a + STEP].astype(np.int64)
        text[a * wide : (a + len(v)) * wide] = np.stack([v // 253 ** (wide - 1 - j) % 253 + 2 for j in range(wide)], axis=1).ravel()
    out, k = store.array(m, "<u4"), m
    for pos, _, _ in _sorted(text, m * wide + 1, min(limit * wide, 65535), store, memory):
        own = pos[(pos % wide == 0) & (pos < m * wide)] // wide
        out[k - len(own) : k] = starts[own[::-1]]
        k -= len(own)
    return out


class _Induction:
    """Pushes the suffixes before those that are scanned, with common prefixes from least values between."""

    def __init__(self, t: np.ndarray, top: int, small: bool, limit: int, pool: Pool) -> None:
        self.t, self.small, self.limit = t, small, limit
        self.queues = [Queue(pool) for _ in range(top)]
        self.least = np.full(top, -1, np.int64)  # since a queue's last push; -1 before the first
        self.held = self.least.copy()

    def scan(self, pos: np.ndarray, lcp: np.ndarray, c: int, own: bool = True) -> None:
        """The next suffixes in order, all of first character c, each with its common prefix with the one scanned before it; own: they are of the type that is pushed."""
        pos = pos.astype(np.int64)
        chars = self.t[np.maximum(pos - 1, 0)]
        # a suffix is of its follower's type where their characters are equal
        fits = (chars <= c if own else chars < c) if self.small else chars >= c
        some = np.flatnonzero(fits & (pos > 0))
        chars = chars[some]
        order = np.argsort(chars, kind="stable")
        at, chars = some[order], chars[order]
        seen = self.least >= 0
        self.least[seen] = np.minimum(self.least[seen], lcp.min())
        cuts = [0, *(np.flatnonzero(chars[1:] != chars[:-1]) + 1).tolist(), len(at)] if len(at) else [0]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            k, to = at[s:e], int(chars[s])
            low = np.minimum.reduceat(lcp[: k[-1] + 1], np.concatenate([[0], k[:-1] + 1])).astype(np.int64)
            if seen[to]:
                low[0] = min(low[0], self.held[to])
            value = np.minimum(low + 1, self.limit)
            if not seen[to]:
                value[0] = 0
            rest = lcp[k[-1] + 1 :]
            self.least[to] = rest.min() if len(rest) else self.limit
            self.queues[to].push(pos[k] - 1, value.astype(np.uint16))
        self.held = self.least.copy()


def _induced(t: np.ndarray, n: int, seeds, limit: int, store: Store, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """All suffixes in descending order from S* suffixes; seeds: steps of those of a first character in ascending order, with common prefixes.

    Steps are (positions, common prefixes with the one before, whether they are S).
    First the others (L) are induced in ascending order, then S in descending order.
    """
    top = max(int(t[a : a + STEP].max()) for a in range(0, n, STEP)) + 1
    pool = Pool(store, memory)
    large, done = _Induction(t, top, False, limit, pool), [Queue(pool) for _ in range(top)]
    for c in range(top):
        last = None
        while (b := large.queues[c].pop()) is not None:
            done[c].push(*b)
            last = b[0][-1:]
            large.scan(*b, c)
        for k, (pos, lcp) in enumerate(seeds(c)):
            if not k:
                lcp = lcp.copy()
                lcp[0] = common(t, last, pos[:1], limit)[0] if last is not None else 0
            large.scan(pos, lcp, c)
    small = _Induction(t, top, True, limit, pool)
    for c in reversed(range(top)):
        last = None
        while (b := small.queues[c].pop()) is not None:
            last = b[0][-1:]
            small.scan(*b, c)
            yield *b, True
        carry = None  # of the step before: its last tuple's common prefix with the next
        for pos, lcp in done[c].backwards():
            own = np.empty(len(lcp), np.uint16)
            own[1:] = lcp[:-1]
            own[0] = carry if carry is not None else (common(t, last, pos[:1], limit)[0] if last is not None else 0)
            carry = lcp[-1]
            small.scan(pos, own, c, own=False)
            yield pos, own, False
    yield np.array([n - 1], np.uint32), np.zeros(1, np.uint16), True


def _sorted(t: np.ndarray, n: int, limit: int, store: Store, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    starts = _stars(t, n, store)
    if len(starts) <= BASE * memory or store.system is None:
        stars = _in_memory(t, np.asarray(starts, np.int64), limit)
    else:
        stars = _recursive(t, n, starts, limit, store, memory)
    m = len(stars)
    lcp = store.array(m, "<u2")
    for a in range(1, m, STEP):
        b = min(m, a + STEP)
        lcp[a:b] = common(t, stars[a - 1 : b - 1], stars[a:b], limit)
    # characters ascend along the S* suffixes
    bounds, at = np.zeros(257, np.int64), 0
    for a in range(0, m, STEP):
        bounds[1:] += np.bincount(t[stars[a : a + STEP]], minlength=256)
    bounds = np.cumsum(bounds)
    seeds = lambda c: ((stars[a : (e := min(a + STEP, bounds[c + 1]))], lcp[a:e]) for a in range(bounds[c], bounds[c + 1], STEP))
    yield from _induced(t, n, seeds, limit, store, memory)


def suffixes(text: np.ndarray, limit: int, folder: str | None = None, memory: int = MEMORY, stats: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all suffixes in descending order, in steps, each with its common prefix (at most limit) with the one before.

    text: bytes of which the last is 0 and the only 0, and eight spare ones. The order
    holds as far as the first `limit` characters tell. Beyond the text, what is held
    is bounded by `memory` tuples: queues, S* positions, their order and the texts of
    deeper levels are files of the folder (mapped ones, where it is mounted).
    """
    store = Store(folder)
    try:
        for pos, lcp, _ in _sorted(text, len(text) - 8, limit, store, memory):
            yield pos.astype(np.int64), lcp
    finally:
        if stats is not None:
            stats["written"] = store.written
        store.close()
