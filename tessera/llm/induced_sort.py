"""External suffix sorting by induction, with common prefixes carried along.

The text lies in a file. Suffixes smaller than their right neighbour are S, the
others L; an S suffix after an L one is a star. Stars are named by the symbols up
to the next star in an external merge sort; the string of names, written as
digits so that its alphabet stays small, is sorted by the same recursion, which
ends where names differ or are as long as the limit of common prefixes. Sorted
stars then induce all suffixes: scanned in order, each suffix hands the one
before it to a priority queue, for L suffixes upwards, for S suffixes downwards.

What a queue, a spool or a sorted run holds are tuples: first symbol, position,
common prefix with the entry before (up to a limit), and the symbols before, so that
the symbol and type of the next one are known without a look at the text. The
queue's key is the first symbol, then the order of arrival, which is the order
of ranks; so it is appended, and read once in order. A common prefix grows by one
when it is handed on: it is the least since the last hand-on to that symbol.

Each structure keeps a bound of memory and moves the rest to a temporary file of
the task. The text is only looked at in places where the carried symbols run out,
where L and S suffixes of one symbol meet, and where stars differ.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 14
#: Most names that are symbols of the string below; more are written as digits of a base of their own.
NAMES = 4096
_LCP = np.uint64(255)
_EIGHT, _FORTY = np.uint64(8), np.uint64(40)
_PLACE = np.uint64((1 << 32) - 1)


def _tuples(symbol: np.ndarray, pos: np.ndarray, lcp: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """A number of symbol, position and common prefix, and one of the symbols before."""
    out = np.empty((len(pos), 2), np.uint64)
    out[:, 0] = (symbol.astype(np.uint64) << _FORTY) | (pos.astype(np.uint64) << _EIGHT) | lcp.astype(np.uint64)
    out[:, 1] = ahead
    return out


def _pos(rows: np.ndarray) -> np.ndarray:
    return ((rows[:, 0] >> _EIGHT) & _PLACE).astype(np.int64)


class _File:
    """Rows of 64-bit numbers in a temporary file that is deleted when it is closed."""

    def __init__(self, width: int):
        self.width, self.rows, self.file = width, 0, tempfile.TemporaryFile(prefix="tessera-sort-")

    def append(self, rows: np.ndarray) -> int:
        at = self.rows
        self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(rows).data)
        self.rows += len(rows)
        return at

    def read(self, start: int, stop: int) -> np.ndarray:
        self.file.seek(start * self.width * 8)
        return np.frombuffer(self.file.read((stop - start) * self.width * 8), np.uint64).reshape(-1, self.width)


class Spool:
    """Rows in order of arrival, on disk beyond a bound of memory; read from either end."""

    def __init__(self, width: int, memory: int):
        self.width, self.memory, self.n, self.held = width, memory, 0, 0
        self.blocks: list[np.ndarray] = []
        self.disk: _File | None = None

    def add(self, rows: np.ndarray) -> None:
        self.blocks.append(rows)
        self.held += rows.nbytes
        self.n += len(rows)
        if self.held > self.memory:
            self.disk = self.disk or _File(self.width)
            self.disk.append(np.concatenate(self.blocks))
            self.blocks, self.held = [], 0

    def _ranges(self) -> list[tuple[int, int]]:
        n = self.disk.rows if self.disk else 0
        return [(i, min(i + BLOCK, n)) for i in range(0, n, BLOCK)]

    def forwards(self) -> Iterator[np.ndarray]:
        for a, b in self._ranges():
            yield self.disk.read(a, b)
        yield from self.blocks

    def backwards(self) -> Iterator[np.ndarray]:
        """Blocks from the end, each with its last row first."""
        for rows in reversed(self.blocks):
            yield rows[::-1]
        for a, b in reversed(self._ranges()):
            yield self.disk.read(a, b)[::-1]


class _Taker:
    """So many rows at a time from an iterator of blocks."""

    def __init__(self, blocks: Iterable[np.ndarray]):
        self.blocks, self.left = iter(blocks), None

    def take(self, n: int) -> Iterator[np.ndarray]:
        while n:
            if self.left is None or not len(self.left):
                self.left = next(self.blocks)
            out, self.left = self.left[:n], self.left[n:]
            n -= len(out)
            if len(out):
                yield out


class BucketQueue:
    """A monotone priority queue: tuples by symbol, then order of arrival, on disk beyond a bound of memory.

    Symbols go into ranges; the tuples of a range are put in order when its turn comes, later ones by symbol.
    """

    def __init__(self, symbols: int, memory: int):
        self.width = max(1, int(symbols**0.5))
        self.ranges: defaultdict[int, deque] = defaultdict(deque)
        self.waiting: defaultdict[int, deque] = defaultdict(deque)
        self.memory, self.held, self.disk, self.now = memory, 0, None, -1

    def push(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Tuples whose symbols ``keys`` rise."""
        if not len(keys):
            return
        part = keys // self.width
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(keys)]
        for a, b, k in zip(cuts[:-1], cuts[1:], part[cuts[:-1]].tolist()):
            if k == self.now:
                self._deal(keys[a:b], rows[a:b])
            else:
                self.ranges[k].append(rows[a:b])
        self.held += rows.nbytes
        if self.held > self.memory:
            self._spill()

    def _deal(self, keys: np.ndarray, rows: np.ndarray) -> None:
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            self.waiting[int(keys[a])].append(rows[a:b])

    def _spill(self) -> None:
        self.disk = self.disk or _File(2)
        for q in (*self.ranges.values(), *self.waiting.values()):
            loose = [x for x in q if isinstance(x, np.ndarray)]
            for _ in loose:
                q.pop()  # what is on disk came first
            if loose:
                joined = np.concatenate(loose)
                q.append((self.disk.append(joined), len(joined)))
        self.held = 0

    def _enter(self, k: int) -> None:
        """Put a range in order of symbols, in parts of bounded size if it is on disk."""
        self.now = k
        q = self.ranges.pop(k, ())
        loose: list[np.ndarray] = []

        def sort() -> None:
            rows = loose[0] if len(loose) == 1 else np.concatenate(loose)
            keys = (rows[:, 0] >> _FORTY).astype(np.int64)
            first = keys.min()
            order = np.argsort((keys - first).astype(np.uint16) if self.width < 65536 else keys, kind="stable")
            self._deal(keys[order], rows[order])
            loose.clear()

        for head in q:
            if isinstance(head, tuple):
                at, n = head
                most = max(BLOCK, self.memory // 64)
                for i in range(at, at + n, most):
                    loose.append(self.disk.read(i, min(i + most, at + n)))
                    self.held += loose[-1].nbytes
                    sort()
                    if self.held > self.memory:
                        self._spill()
            else:
                loose.append(head)
        if loose:
            sort()

    def pop(self, symbol: int) -> np.ndarray | None:
        """The next tuples of a symbol, about a block of them; none if nothing waits."""
        if symbol // self.width != self.now:
            self._enter(symbol // self.width)
        q, out, n = self.waiting.get(symbol), [], 0
        while q and n < BLOCK:
            head = q.popleft()
            if isinstance(head, tuple):
                at, k = head
                if k > BLOCK:
                    q.appendleft((at + BLOCK, k - BLOCK))
                head = self.disk.read(at, at + min(k, BLOCK))
            else:
                self.held -= head.nbytes
            out.append(head)
            n += len(head)
        return None if not out else out[0] if len(out) == 1 else np.concatenate(out)


def _lexical(rows: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their first columns, and which tie with the one before; later columns are looked at where earlier ones tie."""
    order = np.argsort(np.ascontiguousarray(rows[:, 0]))
    tie = np.concatenate([[False], rows[order[1:], 0] == rows[order[:-1], 0]])
    for c in range(1, keys):
        if not tie.any():
            break
        some = np.flatnonzero(tie | np.append(tie[1:], False))
        group = np.cumsum(~tie)[some]
        x = rows[order[some], c]
        by = np.lexsort((x, group))
        order[some] = order[some][by]
        x = x[by]
        same = np.concatenate([[False], (group[1:] == group[:-1]) & (x[1:] == x[:-1])])
        tie[some] = same
    return order, tie


class Sorter:
    """Rows by their first columns: sorted runs on disk beyond a bound of memory, merged block by block."""

    def __init__(self, keys: int, memory: int):
        self.keys, self.memory, self.held, self.width = keys, memory, 0, 0
        self.rows: list[np.ndarray] = []
        self.runs: list[_File] = []

    def add(self, rows: np.ndarray) -> None:
        self.rows.append(rows)
        self.held += rows.nbytes
        if self.held > self.memory:
            run = _File(rows.shape[1])
            run.append(self._sorted())
            self.runs.append(run)

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.rows)
        self.rows, self.held = [], 0
        return rows[_lexical(rows, self.keys)[0]]

    def blocks(self) -> Iterator[np.ndarray]:
        if not self.runs:
            if self.rows:
                rows = self._sorted()
                for i in range(0, len(rows), BLOCK):
                    yield rows[i : i + BLOCK]
            return
        if self.rows:
            self.runs.append(_File(self.rows[0].shape[1]))
            self.runs[-1].append(self._sorted())
        size = max(256, BLOCK // len(self.runs))
        at = [min(size, r.rows) for r in self.runs]
        heads = [r.read(0, n) for r, n in zip(self.runs, at)]
        while any(map(len, heads)):
            more = [h[-1] for h, r, n in zip(heads, self.runs, at) if n < r.rows]
            bound = min((tuple(x[: self.keys].tolist()) for x in more), default=None)
            taken = []
            for i, h in enumerate(heads):
                k = len(h) if bound is None else self._upto(h, bound)
                taken.append(h[:k])
                heads[i] = h[k:]
                if not len(heads[i]) and at[i] < self.runs[i].rows:
                    end = min(at[i] + size, self.runs[i].rows)
                    heads[i], at[i] = self.runs[i].read(at[i], end), end
            rows = np.concatenate(taken)
            yield rows[_lexical(rows, self.keys)[0]]

    def ranked(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The column after the keys in order, each with the number of different keys up to there, from 0."""
        if not self.runs and self.rows:
            rows = self.rows[0] if len(self.rows) == 1 else np.concatenate(self.rows)
            self.rows, self.held = [], 0
            order, tie = _lexical(rows, self.keys)
            yield rows[order, self.keys], np.cumsum(~tie) - 1
            return
        last, number = None, -1
        for rows in self.blocks():
            keys = rows[:, : self.keys]
            new = np.concatenate([[last is None or bool((keys[0] != last).any())], (keys[1:] != keys[:-1]).any(axis=1)])
            numbers = number + np.cumsum(new)
            last, number = keys[-1], int(numbers[-1])
            yield rows[:, self.keys], numbers

    def _upto(self, rows: np.ndarray, bound: tuple) -> int:
        """How many of some sorted rows are not above a bound."""
        low, high = 0, len(rows)
        for c, b in enumerate(bound):
            part, b = rows[low:high, c], np.uint64(b)  # noqa: PLW2901
            low, high = low + int(np.searchsorted(part, b, "left")), low + int(np.searchsorted(part, b, "right"))
        return high


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of x[a..b] for each pair of bounds, both included."""
    k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    table, step = [x], 1
    for _ in range(int(k.max(initial=0))):
        last = table[-1]
        now = last.copy()
        np.minimum(last[:-step], last[step:], out=now[:-step])
        table.append(now)
        step *= 2
    t = np.stack(table)
    return np.minimum(t[k, a], t[k, b - (1 << k) + 1])


def text_file(blocks: Iterable[np.ndarray], symbols: int) -> np.ndarray:
    """Symbols (1 and up, below ``symbols``; the last is the only 1) as an array over a temporary file."""
    file, n, kind = tempfile.TemporaryFile(prefix="tessera-text-"), 0, "<u2" if symbols <= 1 << 16 else "<u4"
    for b in blocks:
        file.write(np.ascontiguousarray(b, kind).data)
        n += len(b)
    file.flush()
    return np.memmap(file, kind, "r", shape=(n,))


class _Level:
    """One text of the recursion: its symbols are below ``symbols``, of ``bits`` bits.

    Below the first text names have ``limit`` symbols, which stand for as many or more of the first.
    """

    def __init__(self, text: np.ndarray, symbols: int, limit: int, memory: int, below: bool = False):
        self.text, self.n, self.symbols, self.limit, self.memory, self.below = text, len(text), symbols, limit, memory, below
        self.bits = int(symbols).bit_length()
        self.per = 63 // self.bits
        self.mask, self.shift = np.uint64((1 << self.bits) - 1), np.uint64(self.bits)

    # what lies before a suffix

    def ahead(self, pos: np.ndarray) -> np.ndarray:
        """The symbols before positions, the nearest in the lowest bits."""
        out = np.zeros(len(pos), np.uint64)
        for j in range(self.per):
            at = pos - 1 - j
            out |= np.where(at >= 0, self.text[np.maximum(at, 0)], 0).astype(np.uint64) << np.uint64(j * self.bits)
        return out

    def common(self, a: np.ndarray, b: np.ndarray, from_: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes that are known to agree so far, up to the limit."""
        out = np.minimum(from_, self.limit).astype(np.int64)
        alive = np.flatnonzero(out < self.limit)
        while len(alive):
            at = out[alive]
            alive = alive[self.text[a[alive] + at] == self.text[b[alive] + at]]
            out[alive] += 1  # the end differs from all
            alive = alive[out[alive] < self.limit]
        return out

    # stars

    def stars(self) -> None:
        """``places``: star positions from the right with the symbols before; ``firsts``: stars by first symbol."""
        if hasattr(self, "places"):
            return
        self.places, self.firsts, self.longest = Spool(2, self.memory), np.zeros(self.symbols, np.int64), 1
        right, s_right, following = None, True, self.n - 1
        for b in range(self.n, 0, -8 * BLOCK):
            a = max(0, b - 8 * BLOCK)
            t = self.text[a:b]
            after = np.append(t[1:], t[-1] if right is None else right)
            less, differs = t < after, t != after
            if right is None:
                less[-1], differs[-1] = True, True  # the last suffix is S
            k = len(t)
            at = np.minimum.accumulate(np.where(differs, np.arange(k), k)[::-1])[::-1]
            s = np.where(at < k, less[np.minimum(at, k - 1)], s_right)
            both = np.append(s, s_right)
            hit = np.flatnonzero(both[1:] & ~both[:-1]) + 1
            if right is None:
                hit = hit[hit < k]
            pos = (hit + a)[::-1]
            if len(pos):
                self.longest = max(self.longest, int(np.max(np.append(following, pos[:-1]) - pos)) + 1)
                following = pos[-1]
                np.add.at(self.firsts, self.text[pos], 1)
                self.places.add(_tuples(self.text[pos], pos, np.zeros(len(pos)), self.ahead(pos)))
            right, s_right = t[0], s[0]

    def named(self) -> tuple[Sorter, int]:
        """A sorter of (star, name), by star, and how many names there are; if names tie for good, their ranks instead."""
        words, per, inf = -(-(self.limit if self.below else self.longest) // self.per), self.per, int(self.mask)
        by_key, first = Sorter(words, self.memory), 0
        for pos, after in self._in_order():
            n = np.minimum(self.n - pos, self.limit) if self.below else after - pos + 1
            rows = np.zeros((len(pos), words + 1), np.uint64)
            for j in range(words * per):
                symbol = np.where(j < n, self.text[np.minimum(pos + j, self.n - 1)], inf).astype(np.uint64)
                rows[:, j // per] |= symbol << np.uint64((per - 1 - j % per) * self.bits)
            rows[:, words] = np.arange(first, first + len(pos))
            first += len(pos)
            by_key.add(rows)
        by_star, name = Sorter(1, self.memory), -1
        for star, names in by_key.ranked():
            name = int(names[-1])
            by_star.add(np.stack([star, names.astype(np.uint64)], axis=1))
        return by_star, name + 1

    def _in_order(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Star positions from the left, each with that of the next (the last with itself)."""
        held: np.ndarray | None = None
        for rows in self.places.backwards():
            pos = _pos(rows)
            both = pos if held is None else np.concatenate([held, pos])
            if len(both) > 1:
                yield both[:-1], both[1:]
            held = both[-1:]
        yield held, held

    def seeds(self) -> Spool:
        """Stars in order of rank: position, common prefix with the star before, symbols before."""
        self.stars()
        n = self.places.n
        by_star, names = self.named()
        place = np.memmap(tempfile.TemporaryFile(prefix="tessera-stars-"), np.int64, "w+", shape=(n,))
        at = 0
        for rows in self.places.backwards():
            place[at : at + len(rows)] = _pos(rows)
            at += len(rows)
        recursed = names < n and not self.below
        if not recursed:
            ranked = by_star  # a name is a rank; nothing is known of common prefixes yet
        else:
            below, digits = self._below(by_star, names)
            ranked, up, held = Sorter(1, self.memory), n, None
            for star, lcp in _every(digits, n, below.suffixes()):
                k = star if held is None else np.append(held, star[:-1])
                l = lcp[1:] if held is None else lcp  # noqa: E741
                held = star[-1:]
                k = k[: len(l)]
                ranked.add(np.stack([k, ((up - 1 - np.arange(len(k))) << 8) | np.minimum(l // digits, 255)], axis=1).astype(np.uint64))
                up -= len(k)
            ranked.add(np.array([[held[0], 0]], np.uint64))
        by_rank, taker = Sorter(1, self.memory), _Taker(self.places.backwards())
        for rows in ranked.blocks():
            value = rows[:, 1] if recursed else rows[:, 1] << _EIGHT
            tuples = np.concatenate(list(taker.take(len(rows))))
            by_rank.add(np.stack([value >> _EIGHT, tuples[:, 0], tuples[:, 1], rows[:, 0], value & _LCP], axis=1))
        out, before = Spool(2, self.memory), None
        for rows in by_rank.blocks():
            pos, star, shared = _pos(rows[:, 1:]), rows[:, 3].astype(np.int64), rows[:, 4].astype(np.int64)
            left = pos[0] if before is None else before
            # the names that the recursion found equal span so many symbols
            known = np.minimum(place[np.minimum(star + shared, n - 1)] - pos, self.limit)
            lcp = np.zeros(len(pos), np.int64)
            some = slice(1, None) if before is None else slice(None)
            lcp[some] = self.common(np.append(left, pos[:-1])[some], pos[some], known[some])
            before = pos[-1]
            out.add(np.stack([rows[:, 1] | lcp.astype(np.uint64), rows[:, 2]], axis=1))
        return out

    def _below(self, by_star: Sorter, names: int) -> tuple[_Level, int]:
        """The string of names, and how many digits a name has in it."""
        written = Spool(2, self.memory)
        for rows in by_star.blocks():
            written.add(rows)
        digits = 1
        while NAMES**digits < names:
            digits += 1
        while True:
            most = max(self.limit, -(-self.limit // 2) * digits)  # a name and the next begin two symbols apart at least
            base = names if digits == 1 else int(np.ceil(names ** (1 / digits))) + 1
            below = _Level(text_file(self._written(written, digits, base), base + 2), base + 2, most, self.memory, True)
            below.stars()
            if digits == 1 or below.places.n <= 0.9 * written.n:
                return below, digits
            digits = 1  # digits that never fall would come back as the same names

    def _written(self, names: Spool, digits: int, base: int) -> Iterator[np.ndarray]:
        for rows in names.forwards():
            powers = np.array([base**i for i in range(digits - 1, -1, -1)], np.uint64)
            yield (rows[:, 1:2] // powers % np.uint64(base) + np.uint64(2)).reshape(-1)
        yield np.ones(1, np.uint64)

    # induction

    def _hand_on(self, rows: np.ndarray, wanted, queue: BucketQueue, low: np.ndarray) -> None:
        """Give the wanted predecessors of sources, which come in order, to the queue.

        ``low`` is the least common prefix of sources since the last hand-on to each symbol; -1: there was none.
        """
        lcp, pos, ahead = (rows[:, 0] & _LCP).astype(np.int16), _pos(rows), rows[:, 1]
        if len(bare := np.flatnonzero((ahead == 0) & (pos > 0))):
            ahead = ahead.copy()
            ahead[bare] = self.ahead(pos[bare])
        before = (ahead & self.mask).astype(np.uint16 if self.bits <= 16 else np.uint32)
        w = np.flatnonzero(wanted(before) & (before > 0))
        order = np.argsort(before[w], kind="stable")
        w = w[order]
        t = before[w]
        if len(w):
            head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            start = np.concatenate([[0], w[:-1] + 1])
            start[head] = 0
            m = _range_min(lcp, start, w)
            m[head] = np.minimum(m[head], low[t[head]])
            queue.push(t, _tuples(t, pos[w] - 1, np.minimum(m + 1, self.limit), ahead[w] >> self.shift))
        np.minimum(low, lcp.min(), out=low)
        if len(w):
            tail = np.append(head[1:], len(w)) - 1
            rest, end = w[tail] + 1, len(lcp)
            after = np.minimum.accumulate(np.append(lcp, np.int16(255))[::-1])[::-1]
            low[t[tail]] = after[np.minimum(rest, end)]

    def _meet(self, a: np.ndarray, b: np.ndarray) -> int:
        """The common prefix where L and S suffixes of one symbol meet."""
        x, y = (_pos(r[None]) for r in (a, b))
        return int(self.common(x, y, np.zeros(1, np.int64))[0])

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of all suffixes, the largest first, each with the prefix it shares with the one before."""
        seeds = _Taker(self.seeds().forwards())
        queue, low = BucketQueue(self.symbols, self.memory), np.full(self.symbols, -1, np.int16)
        larger, larger_of = Spool(2, self.memory), np.zeros(self.symbols, np.int64)
        for c in range(1, self.symbols):
            last = None
            while (rows := queue.pop(c)) is not None:
                larger.add(rows)
                larger_of[c] += len(rows)
                last = rows[-1]
                self._hand_on(rows, lambda p: p >= c, queue, low)  # noqa: B023
            for rows in seeds.take(int(self.firsts[c])):
                if last is not None:
                    rows = rows.copy()
                    rows[0, 0] = (rows[0, 0] & ~_LCP) | np.uint64(self._meet(last, rows[0]))
                    last = None
                self._hand_on(rows, lambda p: p > c, queue, low)  # noqa: B023
        end = np.array([self.n - 1])
        queue, low = BucketQueue(self.symbols, self.memory), np.full(self.symbols, -1, np.int16)
        queue.push(self.text[end], _tuples(self.text[end], end, np.zeros(1), self.ahead(end)))
        down = _Taker(larger.backwards())
        for c in range(self.symbols - 1, 0, -1):
            last = None
            while (rows := queue.pop(c)) is not None:
                last = rows[-1]
                yield _pos(rows), (rows[:, 0] & _LCP).astype(np.int64)
                self._hand_on(rows, lambda p: p <= c, queue, low)  # noqa: B023
            shared = None
            for rows in down.take(int(larger_of[c])):
                if shared is None:
                    shared = np.uint64(0 if last is None else self._meet(last, rows[0]))
                stored = rows[:, 0] & _LCP
                rows = rows.copy()
                rows[:, 0] = (rows[:, 0] & ~_LCP) | np.append(shared, stored[:-1])
                shared = stored[-1]
                yield _pos(rows), (rows[:, 0] & _LCP).astype(np.int64)
                self._hand_on(rows, lambda p: p < c, queue, low)  # noqa: B023


def _every(step: int, n: int, blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of sorted suffixes of digits those where a name begins, with the least prefix shared on the way from the one before."""
    carry = 255
    for pos, lcp in blocks:
        at = np.flatnonzero((pos % step == 0) & (pos < step * n))
        if not len(at):
            carry = min(carry, int(lcp.min()))
            continue
        least = np.minimum.reduceat(lcp[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
        least[0] = min(least[0], carry)
        carry = int(lcp[at[-1] + 1 :].min(initial=255))
        yield pos[at] // step, least


def sorted_suffixes(text: np.ndarray, symbols: int, limit: int, memory: int = 32 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of a text from the largest on, with the prefix (up to the limit) that each shares with the one before.

    Symbols go from 1 to ``symbols`` - 1; the last is the only 1. ``memory`` bounds each queue, spool and run.
    A star and the next should not be far apart, as all keys are as long as the longest: texts of pieces
    that end in a small symbol are such.
    """
    return _Level(text, symbols, limit, memory).suffixes()
