"""External induced suffix sorting that carries common-prefix values.

A suffix is of type L (greater than the next suffix) or S. From the sorted leftmost S suffixes of all runs of S, one ascending sweep over
symbols places the L suffixes and one descending sweep the S suffixes: a suffix that is placed sends the one before it, if that is of the
wanted type, to a queue at its first symbol. What travels is a tuple of position and prefix value, the length (in bytes, up to
``depth``) of what the suffix has in common with the one sent to the same symbol before it. It is found without looking at text:
the symbol's own length and the least value that the sweep has passed since then. So the sweeps deliver suffixes in order
together with the common prefixes of neighbours.

Leftmost S suffixes are first sorted by their substrings (up to the next such suffix, with its run and one more symbol), some symbols at
a time. These are free of prefixes of one another, so prefix values between different
substrings are final, and substrings are named where the value says that they differ. Where names repeat, the string of names is
sorted in the same way, whatever the size of its alphabet; each symbol of it brings its length in bytes and its prefix value with
the name before it. Names that agree over ``depth`` bytes are one, so recursion ends after few levels.

Queues are bands of neighbouring symbols, popped in order. Beyond ``memory`` bytes the largest bands' tuples go to files in
a shared folder (any URI that pyarrow opens), are read back when popped, and are deleted then. In memory stay the text (a byte a suffix),
of deeper levels the names, and the order of leftmost S suffixes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

MEMORY = 4 << 20
EQUAL = 255  # prefix value of strings known to be equal to their ends
CHUNK = 1 << 16  # suffixes that a sweep places at once
BAND = 1 << 13  # suffixes of a band of several symbols, about
PLAIN = 512  # alphabets up to this size have a band for every symbol
_LOG = np.zeros(CHUNK + 2, np.uint8)
for _i in range(2, len(_LOG)):
    _LOG[_i] = _LOG[_i >> 1] + 1


class Ranges:
    """Least values of any ranges of an array of bytes."""

    def __init__(self, values: np.ndarray, longest: int | None = None):
        rows, w = [values], 1
        while 2 * w <= (longest or len(values)):
            rows.append(np.minimum(rows[-1][: len(values) - 2 * w + 1], rows[-1][w : len(values) - w + 1]))
            w *= 2
        self.flat = np.concatenate(rows)
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over a..b, both included, for a <= b."""
        size = b - a + 1
        level = _LOG[size] if len(size) and size.max() < len(_LOG) else np.frexp(size.astype(np.float64))[1] - 1
        level = level.astype(np.int64)
        return np.minimum(self.flat[self.at[level] + a], self.flat[self.at[level] + b + 1 - (1 << level)])


class Bands:
    """Suffix tuples (symbol, position, prefix value) in bands of neighbouring symbols, in the order pushed; the part beyond ``memory`` is on disk."""

    def __init__(self, of: np.ndarray, kind: np.dtype, memory: int, spill: str | None):
        self.of, self.kind, self.memory, self.spill = of, kind, memory, spill
        self.held: dict[int, list] = {}
        self.files: dict[int, list[tuple[str, int]]] = {}
        self.size: dict[int, int] = {}
        self.new: list[tuple] = []
        self.n_new = self.used = self.spilled = 0
        self.store = None

    def push(self, symbol: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
        if len(symbol):
            self.new.append((self.of[symbol], symbol.astype(self.kind, copy=False), pos.astype(np.int32, copy=False), value))
            self.n_new += len(symbol)
            if self.n_new >= CHUNK:
                self._deal()

    def _joined(self) -> tuple:
        rows = tuple(np.concatenate(c) for c in zip(*self.new)) if len(self.new) > 1 else self.new[0]
        self.new, self.n_new = [], 0
        return rows

    def _deal(self) -> None:
        if not self.n_new:
            return
        band, *rows = self._joined()
        order = np.argsort(band, kind="stable")
        band, rows = band[order], [r[order] for r in rows]
        cut = np.flatnonzero(band[1:] != band[:-1]) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(band)]):
            k = int(band[a])
            self.held.setdefault(k, []).append([r[a:b] for r in rows])
            size = (b - a) * (5 + self.kind.itemsize)
            self.size[k] = self.size.get(k, 0) + size
            self.used += size
        while self.used > self.memory and self.spill and self.size:
            self._write(max(self.size, key=self.size.get))

    def _write(self, band: int) -> None:
        if self.store is None:
            self.store, root = fs.FileSystem.from_uri(self.spill)
            self.root = f"{root}/{uuid.uuid4().hex}"
            self.store.create_dir(self.root, recursive=True)
        rows = [np.concatenate(c) for c in zip(*self.held.pop(band))]
        name = f"{self.root}/{self.spilled}.q"
        self.spilled += 1
        with self.store.open_output_stream(name) as out:
            for r in rows:
                out.write(r.tobytes())
        self.files.setdefault(band, []).append((name, len(rows[0])))
        self.used -= self.size.pop(band)

    def _read(self, name: str, n: int) -> list:
        with self.store.open_input_file(name) as f:
            data = f.read()
        self.store.delete_file(name)
        k = self.kind.itemsize
        return [np.frombuffer(data, self.kind, n), np.frombuffer(data, np.int32, n, k * n), np.frombuffer(data, np.uint8, n, (k + 4) * n)]

    def take(self, band: int, last_first: bool = False) -> Iterator[list]:
        """The band's tuples in pieces, in order (or pieces from the last to the first); it is empty afterwards."""
        rest: list = []
        if self.n_new:
            of, *rows = self._joined()
            mine = of == band
            if mine.any():
                rest = [[r[mine] for r in rows]]
                keep = ~mine
                of, rows = of[keep], [r[keep] for r in rows]
            if len(of):
                self.new, self.n_new = [(of, *rows)], len(of)
        files, held = self.files.pop(band, []), self.held.pop(band, [])
        self.used -= self.size.pop(band, 0)
        if last_first:
            yield from (rest + held[::-1])
            yield from (self._read(*f) for f in files[::-1])
        else:
            yield from (self._read(*f) for f in files)
            yield from held + rest

    def close(self) -> None:
        if self.store is not None:
            self.store.delete_dir(self.root)


class Level:
    """One string of the recursion: symbols, their lengths in bytes, and each one's prefix value with the symbol before it."""

    def __init__(self, x: np.ndarray, size: int, length: np.ndarray, step: np.ndarray, depth: int, memory: int, spill: str | None):
        self.x, self.k, self.length, self.step = x, size, length.astype(np.int64), step
        self.depth, self.memory, self.spill = depth, memory, spill
        self.plain = size <= PLAIN
        count = np.bincount(x, minlength=size)
        if self.plain:
            band = np.arange(size)
        else:
            band = (np.cumsum(count) - count) // BAND
            band = np.unique(band, return_inverse=True)[1]
        self.bands = int(band[-1]) + 1
        self.band = band.astype(np.uint16 if self.bands < 1 << 16 else np.int32)
        self.ranges = Ranges(step) if step.any() else None
        self.spilled = 0
        self._runs()

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Prefix value of suffixes that begin with different symbols a < b; a = -1 is the end of the string."""
        if self.ranges is None:
            return np.zeros(len(a), np.int64)
        out = self.ranges.least(np.minimum(a + 1, b), b).astype(np.int64)
        return np.where(a < 0, 0, out)

    def _runs(self) -> None:
        x, n = self.x, len(self.x)
        start = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
        run = np.diff(np.append(start, n))
        c = x[start].astype(np.int64)
        after = np.append(c[1:], -1)
        low = after < c
        star = ~low & (np.append(-1, c[:-1]) > c)
        self.stars, self.star_runs = start[star], run[star]
        k = self.k + 2

        def longest(which: np.ndarray, key: np.ndarray) -> np.ndarray:
            out = np.full(self.k, -1, np.int64)
            np.maximum.at(out, c[which], run[which] * k + key[which])
            return out

        lows, highs, stars = longest(low, after + 1), longest(~low, self.k - after), longest(star, self.k - after)
        self.low_star, self.low_high = self._seam(lows, stars), self._seam(lows, highs)

    def _seam(self, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """For each symbol, the prefix value of the last L suffix and the first of the given S suffixes: nothing but the symbol's runs, and what follows."""
        out = np.zeros(self.k, np.uint8)
        at = np.flatnonzero((lows >= 0) & (highs >= 0))
        k = self.k + 2
        m, b, r, d = lows[at] // k, lows[at] % k - 1, highs[at] // k, self.k - highs[at] % k
        same = np.minimum(m, r) * self.length[at]
        more = np.where(m == r, self.apart(b, d), np.where(m < r, self.apart(b, at), self.apart(at, d)))
        out[at] = np.minimum(same + more, self.depth)
        return out

    def shelf(self) -> Bands:
        return Bands(self.band, self.x.dtype, self.memory, self.spill)

    def sweeps(self, stars: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From leftmost S suffixes in order to all suffixes from the greatest to the least: pieces of (positions, prefix values with the one before)."""
        seeds, low = self.shelf(), self.shelf()
        for a in range(0, len(stars), CHUNK):
            p = stars[a : a + CHUNK]
            seeds.push(self.x[p], p, value[a : a + CHUNK])
        for sym, pos, val, wait in Sweep(self, seeds, False).run():
            low.push(sym[wait], pos[wait], val[wait])
        seeds.close()
        for _, pos, val, _ in Sweep(self, low, True).run():
            yield pos, val
        self.spilled += seeds.spilled + low.spilled
        low.close()


class Sweep:
    """One sweep over the symbols, ascending for L suffixes or (``down``) descending for S; symbols are counted in the sweep's direction.

    In each symbol those that wait come first, then ``seeds``, the suffixes of the other type.
    """

    def __init__(self, level: Level, seeds: Bands, down: bool):
        self.v, self.seeds, self.down = level, seeds, down
        k = level.k
        turn = (lambda a: a[::-1]) if down else (lambda a: a)
        self.length = turn(level.length)
        self.step = np.concatenate([level.step[:1], level.step[1:][::-1]]) if down else level.step
        self.seam = turn(level.low_high if down else level.low_star)
        self.top = k - 1
        self.wait = level.shelf()
        self.last, self.tail = np.full(k, -1, np.int32), np.zeros(k, np.uint8)
        self.low_at = np.full(257, -1, np.int64)  # latest piece with a value of at most v
        self.low_at[256] = 1 << 62
        self.piece = 0
        self.before = (-1, False)

    def _fixed(self, sym: np.ndarray, val: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """Prefix values where a symbol begins, or its seeds do."""
        was, was_seed = self.before
        new = np.empty(len(sym), bool)
        new[0], new[1:] = sym[0] != was, sym[1:] != sym[:-1]
        seam = np.empty(len(sym), bool)
        seam[0], seam[1:] = seed[0] and not was_seed, seed[1:] & ~seed[:-1]
        seam &= ~new
        val = val.copy()
        at = np.flatnonzero(seam)
        val[at] = self.seam[sym[at]]
        at = np.flatnonzero(new)
        if len(at):
            s = sym[at].astype(np.int64)
            if self.v.ranges is None:
                val[at] = 0
            else:
                val[at] = np.minimum.reduceat(self.step[: s[-1] + 1], np.append(was, s[:-1]) + 1)
                if was < 0:
                    val[at[0]] = 0
        self.before = (int(sym[-1]), bool(seed[-1]))
        return val

    def _children(self, sym: np.ndarray, pos: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of the suffix before each one, and whether it is of the wanted type."""
        c = self.v.x[pos - 1].astype(np.int64)
        if self.down:
            c = self.top - c
        return c, (pos > 0) & ((c > sym) | ((c == sym) & ~seed))

    def _place(self, sym: np.ndarray, pos: np.ndarray, val: np.ndarray, seed: np.ndarray, c: np.ndarray, want: np.ndarray) -> tuple:
        """What the placed suffixes induce: (symbol, position, value) in order."""
        at = np.flatnonzero(want)
        cs = c[at]
        order = np.argsort(cs.astype(np.uint16) if self.v.k <= 1 << 16 else cs, kind="stable")
        at, cs = at[order], cs[order]
        if not len(at):
            self._end(val)
            return cs, pos[:0], val[:0]
        head = np.empty(len(cs), bool)
        head[0], head[1:] = True, cs[1:] != cs[:-1]
        later = np.flatnonzero(~head)
        least = np.empty(len(cs), np.uint8)
        if len(later):
            a, b = at[later - 1] + 1, at[later]
            least[later] = Ranges(val, int((b - a).max()) + 1).least(a, b)
        first = np.flatnonzero(head)
        s = cs[first]
        seen = np.searchsorted(self.low_at[:256], self.last[s].astype(np.int64) + 1)
        upto = np.minimum.accumulate(val)
        got = np.minimum(np.minimum(self.tail[s], np.minimum(seen, 255).astype(np.uint8)), upto[at[first]])
        least[first] = np.where(self.last[s] < 0, 0, got)
        value = np.where(least == EQUAL, EQUAL, np.minimum(least.astype(np.int64) + self.length[cs], self.v.depth)).astype(np.uint8)
        end = np.append(first[1:], len(cs)) - 1
        rest = np.append(np.minimum.accumulate(val[::-1])[::-1], EQUAL)
        self.last[s], self.tail[s] = self.piece, rest[at[end] + 1]
        self._end(val)
        return cs, pos[at] - 1, value

    def _end(self, val: np.ndarray) -> None:
        self.low_at[int(val.min()) : 256] = self.piece
        self.piece += 1

    def _out(self, sym: np.ndarray) -> np.ndarray:
        return self.top - sym if self.down else sym

    def _piece(self, band: int, of: Bands) -> Iterator[list]:
        """Tuples of a band in the sweep's order; seeds of a descending sweep come back to front."""
        if of is self.seeds and self.down:
            carry = 0
            for sym, pos, val in of.take(band, last_first=True):
                order = np.argsort(-sym.astype(np.int64), kind="stable") if not self.v.plain else None
                if order is None:
                    back = np.append(carry, val[::-1][:-1]).astype(np.uint8)
                    carry = int(val[0])
                    yield [self.top - sym[::-1].astype(np.int64), pos[::-1], back]
                else:
                    yield [sym, pos, val]
        else:
            for sym, pos, val in of.take(band):
                sym = sym.astype(np.int64)
                yield [self.top - sym if self.down else sym, pos, val]

    def run(self) -> Iterator[tuple]:
        """Pieces of (symbol, position, prefix value, whether it waited) in the order of the sweep."""
        v = self.v
        if not self.down:  # the last suffix is L and follows the end, which is before everything
            last = len(v.x) - 1
            self.wait.push(v.x[last:], np.array([last]), np.zeros(1, np.uint8))
        for band in range(v.bands - 1, -1, -1) if self.down else range(v.bands):
            yield from self._plain(band) if v.plain else self._mixed(band)
        v.spilled += self.wait.spilled
        self.wait.close()

    def _emit(self, sym: np.ndarray, pos: np.ndarray, val: np.ndarray, seed: np.ndarray) -> tuple:
        val = self._fixed(sym, val, seed)
        c, want = self._children(sym, pos, seed)
        return (self._out(sym), pos, val, ~seed), self._place(sym, pos, val, seed, c, want)

    def _plain(self, band: int) -> Iterator[tuple]:
        """A band of one symbol: those that wait, what they add to it, then its seeds."""
        todo = self._piece(band, self.wait)
        mine = self.top - band if self.down else band
        while True:
            again: list = []
            for sym, pos, val in todo:
                for a in range(0, len(sym), CHUNK):
                    part = slice(a, a + CHUNK)
                    out, (cs, cp, cv) = self._emit(sym[part], pos[part], val[part], np.zeros(len(sym[part]), bool))
                    yield out
                    own = cs == mine
                    if own.any():
                        again.append([cs[own], cp[own], cv[own]])
                        cs, cp, cv = cs[~own], cp[~own], cv[~own]
                    self.wait.push(self._out(cs), cp, cv)
            if not again:
                break
            todo = again
        for sym, pos, val in self._piece(band, self.seeds):
            for a in range(0, len(sym), CHUNK):
                part = slice(a, a + CHUNK)
                out, (cs, cp, cv) = self._emit(sym[part], pos[part], val[part], np.ones(len(sym[part]), bool))
                yield out
                self.wait.push(self._out(cs), cp, cv)

    def _mixed(self, band: int) -> Iterator[tuple]:
        """A band of several symbols."""
        join = lambda rows: [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8)]
        w = join(list(self._piece(band, self.wait)))
        s = join(list(self._piece(band, self.seeds))[:: -1 if self.down else 1])
        if self.down and len(s[0]):  # seeds are in ascending order: turn them round, values with them
            order = np.argsort(s[0], kind="stable")
            s = [a[order][::-1] for a in s]
            s[2] = np.append(0, s[2][:-1]).astype(np.uint8)
            s[0] = self.top - s[0].astype(np.int64)
        key = np.concatenate([2 * w[0], 2 * s[0] + 1])
        pos, val = np.concatenate([w[1], s[1]]), np.concatenate([w[2], s[2]])
        order = np.argsort(key, kind="stable")
        key, pos, val = key[order], pos[order], val[order]
        if not len(key):
            return
        # 1. All that the band's suffixes induce within it, and what those do, with the number of the one that sends it.
        known, parent = len(key), [np.full(len(key), -1, np.int64)]
        keys, places, wanted, symbols = [key], [pos], [], []
        new, base = slice(0, known), 0
        while True:
            sym, seed = keys[-1] >> 1, (keys[-1] & 1).astype(bool)
            c, want = self._children(sym, places[-1], seed)
            inside = np.flatnonzero(want & (self.v.band[self._out(c)] == band))
            want[inside] = False
            wanted.append(want)
            symbols.append(c)
            if not len(inside):
                break
            parent.append(inside + base)
            base += len(sym)
            keys.append(2 * c[inside])
            places.append(places[-1][inside] - 1)
        key, pos, parent, want, c = (np.concatenate(x) for x in (keys, places, parent, wanted, symbols))
        # 2. Their order: by symbol, those that came first, then by the rank of the sender, which settles in as many rounds as senders follow one another.
        n = len(key)
        if n > known:
            late = np.arange(known, n)
            second = np.arange(n)
            rank = np.empty(n, np.int64)
            while True:
                order = np.argsort(key * (2 * n) + second, kind="stable")
                rank[order] = np.arange(n)
                moved = known + rank[parent[late]]
                if (moved == second[late]).all():
                    break
                second[late] = moved
            key, pos, parent, want, c = key[order], pos[order], parent[order], want[order], c[order]
            parent = np.where(parent < 0, -1, rank[parent])
            val = np.append(val, np.full(n - known, EQUAL, np.uint8))[order]
        sym, seed = key >> 1, (key & 1).astype(bool)
        val = self._fixed(sym, val, seed)
        # 3. Prefix values of those sent within the band, from the greatest downwards until none changes.
        if n > known:
            at = np.flatnonzero(parent >= 0)
            at = at[(at > 0) & (sym[at] == sym[at - 1])]
            prev = parent[at - 1]
            s = sym[at]
            old = self.last[s] >= 0
            seen = np.minimum(np.searchsorted(self.low_at[:256], self.last[s].astype(np.int64) + 1), 255).astype(np.uint8)
            bound = np.where(prev >= 0, EQUAL, np.where(old, np.minimum(self.tail[s], seen), EQUAL)).astype(np.uint8)
            first, last = np.where(prev >= 0, prev + 1, 0), parent[at]
            length = self.length[s]
            todo, least = np.arange(len(at)), None
            if len(at):
                least = Ranges(val, int((last - first).max()) + 1).least(first, last)
            while len(todo):
                if least is None:  # few are left: their ranges are read as they are
                    least = np.minimum.reduceat(np.append(val, EQUAL), np.column_stack([first[todo], last[todo] + 1]).ravel())[::2]
                least = np.minimum(least, bound[todo])
                got = np.where(least == EQUAL, EQUAL, np.minimum(least.astype(np.int64) + length[todo], self.v.depth)).astype(np.uint8)
                moved = at[todo[got != val[at[todo]]]]
                val[at[todo]] = got
                # again those whose range holds a value that changed
                reach = np.searchsorted(moved, np.column_stack([first, last + 1]))
                todo, least = np.flatnonzero(reach[:, 1] > reach[:, 0]), None
        yield self._out(sym), pos, val, ~seed
        cs, cp, cv = self._place(sym, pos, val, seed, c, want)
        self.wait.push(self._out(cs), cp, cv)


def _words(x: np.ndarray, at: np.ndarray, left: np.ndarray, bits: int, many: int) -> np.ndarray:
    """``many`` symbols from each place on, of which ``left`` count, as one number in their order; 0 is the end."""
    out = np.zeros(len(at), np.uint64)
    for j in range(many):
        out <<= np.uint64(bits)
        out |= np.where(left > j, x[np.minimum(at + j, len(x) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return out


def _names(v: Level) -> tuple:
    """Leftmost S suffixes in the order of their substrings, their prefix values, names, and of each name length and prefix value.

    Substrings are sorted by as many symbols as fit one number, then those that agree by the next ones, until they end or agree over ``depth`` bytes.
    """
    p, n = v.stars, len(v.x)
    ends = np.append(p[1:], n)
    size = np.minimum(np.append(p[1:] + v.star_runs[1:] + 1, n), n) - p  # with the next one's run and one more symbol
    total = np.append(0, np.cumsum(v.length[v.x], dtype=np.int64))
    bits = v.k.bit_length()
    many = min(8, 64 // bits)
    key = _words(v.x, p, size, bits, many)
    rank = np.argsort(key)
    key = key[rank]
    val = np.full(len(p), EQUAL, np.uint8)
    at, group, off = np.arange(len(p)), np.zeros(len(p), np.int64), 0
    while True:
        inside = group[1:] == group[:-1]
        d = np.flatnonzero(inside & (key[1:] != key[:-1])) + 1
        one, two = key[d - 1], key[d]
        same = np.zeros(len(d), np.int64)
        for j in range(1, many):
            low = np.uint64(bits * (many - j))
            same += (one >> low) == (two >> low)
        low = ((many - 1 - same) * bits).astype(np.uint64)
        symbol = lambda k: (k >> low & np.uint64((1 << bits) - 1)).astype(np.int64) - 1  # noqa: B023, E731
        row = rank[at[d]]
        got = total[p[row] + off + same] - total[p[row]] + v.apart(symbol(one), symbol(two))
        val[at[d]] = np.minimum(got, v.depth)
        # again those that agree so far and go on
        tied = np.append(False, inside & (key[1:] == key[:-1]))
        group = np.cumsum(~tied) - 1
        off += many
        row = rank[at]
        reach = total[np.minimum(p[row] + off, n)] - total[p[row]]
        more = size[row] > off
        val[at[tied & more & (reach >= v.depth)]] = v.depth
        more &= reach < v.depth
        more &= tied | np.append(tied[1:], False)
        more = (np.bincount(group, more) > 0)[group]
        at, group = at[more], group[more]
        if not len(at):
            break
        row = rank[at]
        key = _words(v.x, p[row] + off, size[row] - off, bits, many)
        order = np.lexsort((key, group))
        key, rank[at] = key[order], row[order]
    val[0] = 0
    pos = p[rank]
    new = val < v.depth
    new[0] = True
    head = np.flatnonzero(new)
    name = np.cumsum(new) - 1
    own = np.minimum(total[ends[rank]] - total[pos], v.depth)
    cut = (val == v.depth) & ~new  # agree as far as it counts, though not known to be equal
    length = np.where(np.maximum.reduceat(cut, head), v.depth, np.maximum.reduceat(own, head))
    return pos, val, name, rank, length, val[head]


def suffixes(x: np.ndarray, size: int, depth: int, length: np.ndarray | None = None, step: np.ndarray | None = None, memory: int = MEMORY, spill: str | None = None, stats: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of ``x`` (symbols below ``size``) from the greatest to the least, in pieces: positions, and the bytes (up to ``depth``) that
    each has in common with the one before. The order of suffixes that agree over ``depth`` bytes is left open."""
    if not len(x):
        return
    v = Level(x, size, np.ones(size, np.uint8) if length is None else length, np.zeros(size, np.uint8) if step is None else step, depth, memory, spill)
    stats = {} if stats is None else stats
    stats["levels"] = stats.get("levels", 0) + 1
    if len(v.stars):
        pos, val, name, rank, own, steps = _names(v)
        many = np.bincount(name) > 1
        if (many & (own < depth)).any():
            text = np.empty(len(pos), np.int32)
            text[rank] = name
            parts = list(suffixes(text, len(own), depth, own, steps, memory, spill, stats))
            order = np.concatenate([p for p, _ in parts])[::-1]
            val = np.append(0, np.concatenate([w for _, w in parts])[::-1][:-1]).astype(np.uint8)
            pos = v.stars[order]
        val = np.minimum(val, depth).astype(np.uint8)
    else:
        pos, val = v.stars, np.zeros(0, np.uint8)
    yield from v.sweeps(pos, val)
    stats["spilled"] = stats.get("spilled", 0) + v.spilled
