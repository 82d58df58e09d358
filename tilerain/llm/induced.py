"""External suffix sorting by recursive induction, with common-prefix values.

The text, its arrays and every list that grows with it live in memory-mapped or sequential scratch files; queues keep a
bounded part in memory. Tuples of (first symbol, position, common prefix with the tuple before) pass through priority
queues on disk: the sorted S* suffixes induce the L suffixes in ascending order, these induce the S suffixes in descending
order. A queue gives equal symbols back in the order of arrival, which is the order of the inducing suffixes. Symbols are
taken in batches: a batch ends where a tuple would induce another within it, so a batch does what popping one by one does.
"""

from collections.abc import Callable, Iterator

import numpy as np

from tilerain.llm.common import spill_file

#: Tuples of one batch, entries a queue keeps in memory, symbols from which an array goes to a file.
BATCH, QUEUE_ENTRIES, MAPPED_FROM = 1 << 15, 200_000, 1 << 22
#: A reduced text of so many symbols at most ends the recursion: it is sorted in memory.
BASE = 1 << 19
#: Ranges of symbols that a queue keeps apart.
RANGES = 1024
ENTRY = np.dtype([("key", "<i8"), ("pos", "<i8"), ("lcp", "<i4")])


def array_of(n: int, dtype) -> np.ndarray:
    """A zeroed array, in a scratch file if it is large."""
    if n < MAPPED_FROM:
        return np.zeros(n, dtype)
    return np.memmap(spill_file(), dtype=dtype, mode="w+", shape=(n,))


class BlockList:
    """A list of (pos, lcp) blocks that grows on disk and is read forwards or backwards."""

    def __init__(self):
        self.held, self.size, self.file, self.cuts = [], 0, None, [0]
        self.length = 0

    def append(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(pos):
            return
        block = np.empty(len(pos), ENTRY)
        block["pos"], block["lcp"] = pos, lcp
        self.held.append(block)
        self.length += len(block)
        self.size += len(block)
        if self.size > QUEUE_ENTRIES:
            self.file = self.file or spill_file()
            self.file.seek(0, 2)
            self._joined().tofile(self.file)
            self.cuts.append(self.cuts[-1] + self.size)
            self.file.flush()
            self.held, self.size = [], 0

    def _stored(self, i: int) -> np.ndarray:
        self.file.seek(self.cuts[i] * ENTRY.itemsize)
        return np.fromfile(self.file, ENTRY, self.cuts[i + 1] - self.cuts[i])

    def forwards(self) -> Iterator[np.ndarray]:
        for i in range(len(self.cuts) - 1):
            yield self._stored(i)
        if self.held:
            yield self._joined()

    def _joined(self) -> np.ndarray:
        self.held = [np.concatenate(self.held)]
        return self.held[0]

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """pos, lcp in reverse; the value of an entry is that with the entry that came after it."""
        after = 0
        for block in (*([self._joined()] if self.held else []), *(self._stored(i) for i in reversed(range(len(self.cuts) - 1)))):
            pos, lcp = block["pos"][::-1], block["lcp"][::-1]
            yield pos, np.concatenate(([after], lcp[:-1])).astype(np.int64)
            after = int(lcp[-1])


class DiskQueue:
    """A priority queue of (key, pos, lcp), smallest key first and equal keys in order of arrival, for keys that never fall
    below those taken. Keys are kept apart in ranges; the ranges that hold most go to files."""

    def __init__(self, keys: int):
        self.width = -(-keys // RANGES)
        n = -(-keys // self.width)
        self.held: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.count = np.zeros(n, np.int64)
        self.files: dict[int, list] = {}  # range: file, entries written, entries read
        self.inside, self.at, self.front = 0, 0, np.empty(0, ENTRY)

    def push(self, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(key):
            return
        block = np.empty(len(key), ENTRY)
        block["key"], block["pos"], block["lcp"] = key, pos, lcp
        part = key // self.width
        order = np.argsort(part, kind="stable")
        block, part = block[order], part[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            r = int(part[a])
            if r == self.at and self.width > 1 and len(self.front):
                merged = np.concatenate((self.front, block[a:b]))
                self.front = merged[np.argsort(merged["key"], kind="stable")]
            else:
                self.held[r].append(block[a:b])
                self.count[r] += b - a
                self.inside += b - a
        if self.inside > QUEUE_ENTRIES:
            for r in np.argsort(-self.count)[:8].tolist():
                self._spill(r)

    def _spill(self, r: int) -> None:
        if not self.held[r]:
            return
        entry = self.files.setdefault(r, [spill_file(), 0, 0])
        entry[0].seek(0, 2)
        for b in self.held[r]:
            b.tofile(entry[0])
            entry[1] += len(b)
        entry[0].flush()
        self.inside -= int(self.count[r])
        self.held[r], self.count[r] = [], 0

    def _read(self, r: int, most: int | None) -> np.ndarray:
        """What comes next in a range: from its file, then from memory."""
        entry = self.files.get(r)
        parts = []
        if entry and entry[2] < entry[1]:
            n = entry[1] - entry[2] if most is None else min(most, entry[1] - entry[2])
            entry[0].seek(entry[2] * ENTRY.itemsize)
            parts.append(np.fromfile(entry[0], ENTRY, n))
            entry[2] += n
        if (most is None or not parts) and self.held[r]:
            parts += self.held[r]
            self.inside -= int(self.count[r])
            self.held[r], self.count[r] = [], 0
        return np.concatenate(parts) if parts else np.empty(0, ENTRY)

    def _left(self, r: int) -> bool:
        entry = self.files.get(r)
        return bool(self.held[r]) or bool(entry and entry[2] < entry[1])

    def peek(self, last: int | None) -> np.ndarray:
        """The next entries of one range, a batch at most; ranges beyond the one of the key `last` stay closed."""
        end = len(self.held) - 1 if last is None else last // self.width
        while not len(self.front):
            if self.width == 1:
                self.front = self._read(self.at, BATCH)
            else:
                self.front = self._read(self.at, None)
                self.front = self.front[np.argsort(self.front["key"], kind="stable")]
            if not len(self.front):
                if self.at >= end:
                    break
                self.files.pop(self.at, None)
                self.at += 1
        return self.front[:BATCH]

    def bound(self) -> int:
        """The first key beyond the open range."""
        return (self.at + 1) * self.width

    def more(self, n: int) -> bool:
        """Whether entries with the last key of a peek may follow behind it."""
        return len(self.front) > n or self._left(self.at)

    def take(self, n: int) -> None:
        self.front = self.front[n:]


class _Seeds:
    """Blocks of sorted seeds, read ahead."""

    def __init__(self, blocks: Iterator, key_of: Callable):
        self.blocks, self.key_of = blocks, key_of
        self.key = self.pos = self.lcp = np.empty(0, np.int64)
        self.done = False

    def peek(self):
        while not len(self.pos) and not self.done:
            block = next(self.blocks, None)
            if block is None:
                self.done = True
            else:
                self.pos, self.lcp = block
                self.key = self.key_of(self.pos)
        return self.key[:BATCH], self.pos[:BATCH], self.lcp[:BATCH]

    def take(self, n: int) -> None:
        self.key, self.pos, self.lcp = self.key[n:], self.pos[n:], self.lcp[n:]


class _Minima:
    """Minimum of the common-prefix values since a place in the scan. Values are small numbers, so few minima matter."""

    def __init__(self):
        self.place, self.value = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, first: int, values: np.ndarray) -> None:
        place = np.concatenate((self.place, np.arange(first, first + len(values))))
        value = np.concatenate((self.value, values))
        least = np.minimum.accumulate(value[::-1])[::-1]
        keep = np.concatenate((least[:-1] < least[1:], [True])) & (value == least)
        self.place, self.value = place[keep], value[keep]

    def since(self, place: np.ndarray, cap: int) -> np.ndarray:
        i = np.searchsorted(self.place, place, side="right")
        return np.where(i < len(self.value), self.value[np.minimum(i, len(self.value) - 1)], cap) if len(self.value) else np.full(len(place), cap)


def _range_minima(values: np.ndarray):
    """A function for the minima of values[a..b], both ends included."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        last, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-half], last[half:]))
    table = np.full((len(levels), len(values)), np.iinfo(np.int64).max)
    for i, level in enumerate(levels):
        table[i, :len(level)] = level

    def query(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        return np.minimum(table[k, a], table[k, b - (1 << k) + 1])
    return query


def _induce(text: np.ndarray, symbols: int, seeds: Iterator, rising: bool, runs: np.ndarray | None, cap: int, out: Callable) -> None:
    """One scan. Rising: seeds are S* suffixes, L suffixes are induced. Falling: seeds are L suffixes, S are induced.

    `out(pos, lcp, induced)` gets the scan in order. Common prefixes are carried if `runs` (length of the run of equal
    symbols from each position) is given.
    """
    def key_of(pos: np.ndarray) -> np.ndarray:
        k = text[pos].astype(np.int64)
        return k if rising else symbols - 1 - k

    queue, feed = DiskQueue(symbols), _Seeds(seeds, key_of)
    last_at = array_of(symbols, np.int64) if runs is not None else None
    if last_at is not None:
        last_at[:] = -1
    minima, scanned, before = _Minima(), 0, None
    while True:
        sk, sp, sl = feed.peek()
        q = queue.peek(int(sk[0]) if len(sk) else None)
        if not len(q) and not len(sp):
            return
        qk = q["key"]
        nq, ns = len(q), int(np.searchsorted(sk, queue.bound(), side="left"))
        if len(sp) and not (feed.done and len(feed.pos) <= len(sp)):
            nq = int(np.searchsorted(qk, sk[-1], side="right"))
        if len(q) and queue.more(len(q)):
            ns = min(ns, int(np.searchsorted(sk, qk[-1], side="left")))
        key = np.concatenate((qk[:nq], sk[:ns]))
        order = np.argsort(key, kind="stable")
        key = key[order]
        pos = np.concatenate((q["pos"][:nq], sp[:ns]))[order]
        made = order < nq
        prior = pos - 1
        prior_key = key_of(np.maximum(prior, 0))
        # a suffix before a seed is induced if its symbol is beyond the seed's; before an induced one also if it is equal
        gives = (pos > 0) & ((prior_key > key) | (made & (prior_key == key)) if not rising else (prior_key >= key))
        least = int(prior_key[gives].min()) if gives.any() else symbols
        n = int(np.count_nonzero((key < least) | (made & (key == least))))
        key, pos, made, prior, prior_key, gives = (x[:n] for x in (key, pos, made, prior, prior_key, gives))
        taken = int(np.count_nonzero(made))
        source = np.flatnonzero(gives)
        target = prior_key[source]
        if runs is None:
            lcp = np.zeros(n, np.int64)
            queue.take(taken)
            feed.take(n - taken)
            queue.push(target, prior[source], np.zeros(len(source), np.int32))
        else:
            lcp = np.concatenate((q["lcp"][:nq].astype(np.int64), sl[:ns].astype(np.int64)))[order][:n]
            # where seeds of a symbol begin after induced ones of it, the shorter run of that symbol is common
            ahead_key = np.concatenate(([before[0] if before else -1], key[:-1]))
            ahead_made = np.concatenate(([before[1] if before else False], made[:-1]))
            ahead_pos = np.concatenate(([before[2] if before else 0], pos[:-1]))
            seam = ~made & ahead_made & (ahead_key == key)
            lcp[seam] = np.minimum(np.minimum(runs[pos[seam]], runs[ahead_pos[seam]]), cap)
            lcp[ahead_key != key] = 0
            before = (int(key[-1]), bool(made[-1]), int(pos[-1]))
            new = np.zeros(len(source), np.int64)
            if len(source):
                by = np.argsort(target, kind="stable")
                t, s = target[by], source[by]
                head = np.concatenate(([True], t[1:] != t[:-1]))
                least_of = _range_minima(lcp)
                value = np.zeros(len(s), np.int64)
                rest = np.flatnonzero(~head)
                value[rest] = least_of(s[rest - 1] + 1, s[rest]) + 1
                heads = np.flatnonzero(head)
                seen = last_at[t[heads]]
                here = least_of(np.zeros(len(heads), np.int64), s[heads])
                value[heads] = np.where(seen < 0, 0, np.minimum(minima.since(seen, cap), here) + 1)
                new[by] = np.minimum(value, cap)
                tails = np.concatenate((heads[1:] - 1, [len(s) - 1]))
                last_at[t[heads]] = scanned + s[tails]
            minima.add(scanned, lcp)
            queue.take(taken)
            feed.take(n - taken)
            queue.push(target, prior[source], new)
        scanned += n
        out(pos, lcp, made)


def _kinds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is of type S, and the run of equal symbols from each position."""
    n = len(text)
    small, runs = array_of(n, np.bool_), array_of(n, np.int32)
    small[n - 1], runs[n - 1] = True, 1
    step, high = 1 << 19, n - 1
    while high > 0:
        low = max(0, high - step)
        here, after = np.asarray(text[low:high]), np.asarray(text[low + 1:high + 1])
        differs = here != after
        at = np.where(differs, np.arange(low, high), high)
        at = np.minimum.accumulate(at[::-1])[::-1]
        inside = at < high
        index = np.minimum(at, high - 1) - low
        small[low:high] = np.where(inside, (here < after)[index], small[high])
        runs[low:high] = np.where(inside, at - np.arange(low, high) + 1, high - np.arange(low, high) + runs[high])
        high = low
    return small, runs


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes a and b from `start` equal symbols on, at most cap."""
    value, live, n = np.minimum(start, cap), np.arange(len(a)), len(text)
    span = 8
    while len(live):
        x = (a[live] + value[live])[:, None] + np.arange(span)
        y = (b[live] + value[live])[:, None] + np.arange(span)
        inside = (x < n) & (y < n)
        same = inside & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
        run = np.where(same.all(axis=1), span, np.argmin(same, axis=1))
        value[live] = np.minimum(value[live] + run, cap)
        live = live[(run == span) & (value[live] < cap)]
        span = min(span * 2, 64)
    return value


def _equal_names(text: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    same = size_a == size_b
    live, k = np.flatnonzero(same), 0
    while len(live):
        differs = text[a[live] + k] != text[b[live] + k]
        same[live[differs]] = False
        k += 1
        live = live[~differs]
        live = live[size_a[live] > k]
    return same


def _falling_in_memory(text: np.ndarray, out: Callable) -> None:
    """The order of a short text by doubling the prefix that ranks tell apart; common prefixes are left at 0."""
    rank, k, n = np.unique(text, return_inverse=True)[1].astype(np.int64), 1, len(text)
    while True:
        after = np.zeros(n, np.int64)
        after[:n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], np.diff(key[order]) > 0)))
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= n:
            out(order[::-1].copy(), np.zeros(n, np.int64))
            return


def falling_suffixes(text: np.ndarray, symbols: int, cap: int, out: Callable) -> None:
    """Calls out(pos, lcp) with blocks of all suffixes of `text` from the largest to the smallest; lcp is the common prefix
    with the suffix listed before, at most cap. The last symbol must be 0 and stand nowhere else."""
    n = len(text)
    if n == 1:
        out(np.array([0]), np.array([0]))
        return
    small, runs = _kinds(text)
    step = 1 << 19
    parts = BlockList()
    for low in range(0, n, step):
        high = min(n, low + step)
        left = np.concatenate(([True if low == 0 else small[low - 1]], small[low:high - 1]))
        at = np.flatnonzero(np.asarray(small[low:high]) & ~left) + low
        parts.append(at, np.zeros(len(at), np.int32))
    m = parts.length
    stars = array_of(m, np.int64)
    i = 0
    for block in parts.forwards():
        stars[i:i + len(block)] = block["pos"]
        i += len(block)
    star_rank = array_of(n // 2 + 1, np.int64)

    # names: S* substrings in order, by induction from S* suffixes that are sorted by their first symbol only
    by_symbol = DiskQueue(symbols)
    for low in range(0, m, step):
        s = np.asarray(stars[low:low + step])
        by_symbol.push(text[s].astype(np.int64), s, np.zeros(len(s), np.int32))

    def loose():
        while len(q := by_symbol.peek(None)):
            pos = q["pos"].copy()
            by_symbol.take(len(q))
            yield pos, np.zeros(len(pos), np.int64)

    large = BlockList()
    _induce(text, symbols, loose(), True, None, cap, lambda pos, lcp, made: large.append(pos[made], lcp[made]))
    names = {"last": None, "n": 0}

    def name(pos: np.ndarray) -> None:
        if not len(pos):
            return
        where = np.searchsorted(stars, pos)
        size = np.where(where + 1 < m, np.asarray(stars[np.minimum(where + 1, m - 1)]) - pos + 1, 1)
        prev, prev_size = names["last"] or (-1, -1)
        a = np.concatenate(([max(prev, 0)], pos[:-1]))
        a_size = np.concatenate(([prev_size], size[:-1]))
        new = ~_equal_names(text, a, pos, a_size, size)
        falling = names["n"] + np.cumsum(new)  # 1 for the largest
        star_rank[pos >> 1] = falling
        names["n"] = int(falling[-1])
        names["last"] = (int(pos[-1]), int(size[-1]))

    def star_only(pos: np.ndarray, lcp: np.ndarray, made: np.ndarray) -> None:
        pos = pos[made]
        name(pos[(pos > 0) & ~small[np.maximum(pos - 1, 0)]])

    _induce(text, symbols, large.backwards(), False, None, cap, star_only)
    name(np.array([n - 1]))
    total = names["n"]
    order = BlockList()  # S* suffixes, falling, with the number of common names
    if total == m:
        star_of = array_of(m, np.int64)
        for low in range(0, m, step):
            s = np.asarray(stars[low:low + step])
            star_of[star_rank[s >> 1] - 1] = np.arange(low, low + len(s))
        for low in range(0, m, step):
            order.append(np.asarray(star_of[low:low + step]), np.zeros(min(step, m - low), np.int32))
    else:
        reduced = array_of(m, np.int64)
        for low in range(0, m, step):
            reduced[low:low + step] = total - star_rank[np.asarray(stars[low:low + step]) >> 1]
        if m <= BASE:
            _falling_in_memory(np.asarray(reduced), order.append)
        else:
            falling_suffixes(reduced, total, cap, order.append)

    def sorted_stars():
        """S* suffixes, rising, with common prefixes: whole common names, then symbols."""
        last = None
        for pos, names_common in order.backwards():
            at = np.asarray(stars[pos])
            prev = np.concatenate(([pos[0] if last is None else last], pos[:-1]))
            common = names_common.copy()
            if last is None:
                common[0] = 0
            prev_at = np.asarray(stars[prev])
            covered = np.asarray(stars[np.minimum(pos + common, m - 1)]) - at
            lcp = _common(text, prev_at, at, np.maximum(covered, 0), cap)
            if last is None:
                lcp[0] = 0
            last = pos[-1]
            yield at, lcp

    large = BlockList()
    _induce(text, symbols, sorted_stars(), True, runs, cap, lambda pos, lcp, made: large.append(pos[made], lcp[made]))
    _induce(text, symbols, large.backwards(), False, runs, cap, lambda pos, lcp, made: out(pos, lcp))
    out(np.array([n - 1]), np.array([0]))
