"""Suffix order and common prefixes of a byte shard by external induced sorting.

Suffixes of type S* (a smaller run begins) are sorted first; from them the
types L and then S are induced: a bucket a first byte, taken in ascending (L)
or descending (S) order, each suffix taken putting its predecessor into the
bucket of that one's first byte. Buckets are the disk-backed priority queue:
their keys are (first byte, order of arrival), so popping the least is reading
the current bucket's file in order. Tuples carry a position and the common
prefix with the tuple before; a pushed tuple's common prefix is one more than
the least of those passed since the last push to that bucket.

The S* suffixes are named by inducing their substrings in the same way, and
the string of names is sorted by prefix doubling down to the depth that
matters (cap bytes); their own common prefixes come from prefix hashes.

Text, types and hashes are memory-mapped and queues spilled once they pass
`memory` bytes; scratch files are unlinked as they are made, so nothing
outlives the task. Orders below cap are exact; suffixes that agree on cap
bytes stand together in any order, which is all that repeats of cap bytes need.
"""

from __future__ import annotations

import tempfile

import numpy as np

from quillstone.llm.common import _BASE, _INV, BYTE_HASH, mix, powers

#: Ends every segment; never occurs in UTF-8.
SEPARATOR = 0xFF
BATCH = 1 << 15


class Scratch:
    """Arrays and queue blocks, in memory up to a bound and in unlinked files beyond it."""

    def __init__(self, folder: str | None = None, memory: int = 256_000_000):
        self.folder, self.memory, self.used, self.files = folder, memory, 0, []

    def _file(self):
        f = tempfile.TemporaryFile(dir=self.folder)
        self.files.append(f)
        return f

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if self.used + size <= self.memory or not n:
            self.used += size
            return np.empty(n, dtype)
        return np.memmap(self._file(), dtype, "w+", shape=(n,))

    def gathered(self, pieces) -> np.ndarray:
        """The bytes of all pieces one after another; in a file once they pass what is left of the bound."""
        held, f, n = bytearray(), None, 0
        for piece in pieces:
            held += piece
            if len(held) > (BATCH if f else self.memory - self.used):
                f = f or self._file()
                f.write(held)
                n += len(held)
                held = bytearray()
        if f is None:
            self.used += len(held)
            return np.frombuffer(held, np.uint8)
        f.write(held)
        f.flush()
        return np.memmap(f, np.uint8, "r+", shape=(n + len(held),))

    def close(self) -> None:
        for f in self.files:
            f.close()


class BucketQueue:
    """Tuples by bucket, first in first out; blocks beyond the memory bound live in files."""

    def __init__(self, scratch: Scratch, buckets: int = 256):
        self.scratch, self.blocks, self.held = scratch, [[] for _ in range(buckets)], 0

    def push(self, bucket: int, pos: np.ndarray, lcp: np.ndarray | None) -> None:
        size = pos.nbytes + (0 if lcp is None else lcp.nbytes)
        if self.held + size > self.scratch.memory:
            self._spill()
        self.blocks[bucket].append((pos, lcp))
        self.held += size

    def _spill(self) -> None:
        """All blocks in memory go to a file, one after another."""
        f, at = self.scratch._file(), 0
        for blocks in self.blocks:
            for i, (pos, lcp) in enumerate(blocks):
                if isinstance(pos, np.ndarray):
                    f.write(pos.tobytes())
                    if lcp is not None:
                        f.write(lcp.tobytes())
                    blocks[i] = ((f, at, len(pos), pos.dtype, None if lcp is None else lcp.dtype), None)
                    at += pos.nbytes + (0 if lcp is None else lcp.nbytes)
        f.flush()
        self.held = 0

    def _load(self, block) -> tuple[np.ndarray, np.ndarray | None]:
        pos, lcp = block
        if isinstance(pos, np.ndarray):
            return block
        f, at, n, kind, lcp_kind = pos
        f.seek(at)
        out = np.frombuffer(f.read(n * kind.itemsize), kind)
        return out, None if lcp_kind is None else np.frombuffer(f.read(n * lcp_kind.itemsize), lcp_kind)

    def _joined(self, blocks):
        """Small blocks put together, so that one pass of numpy takes many tuples."""
        held, size = [], 0
        for pos, lcp in blocks:
            held.append((pos, lcp))
            size += len(pos)
            if size >= BATCH:
                yield self._one(held)
                held, size = [], 0
        if held:
            yield self._one(held)

    @staticmethod
    def _one(held):
        if len(held) == 1:
            return held[0]
        return np.concatenate([h[0] for h in held]), None if held[0][1] is None else np.concatenate([h[1] for h in held])

    def _removed(self, blocks):
        for b in blocks:
            pos, lcp = self._load(b)
            if isinstance(b[0], np.ndarray):
                self.held -= pos.nbytes + (0 if lcp is None else lcp.nbytes)
            yield pos, lcp

    def take(self, bucket: int):
        """The tuples that are there now, removed; later pushes wait for the next call."""
        blocks, self.blocks[bucket] = self.blocks[bucket], []
        yield from self._joined(self._removed(blocks))

    def reversed(self, bucket: int):
        """The blocks backwards, kept."""
        for b in self.blocks[bucket][::-1]:
            yield self._load(b)


def _log2_table() -> np.ndarray:
    t = np.zeros(BATCH + 2, np.int64)
    t[1:] = np.log2(np.arange(1, BATCH + 2)).astype(int)
    return t


_LOG = _log2_table()


class Shard:
    """One text with its types, hashes and S* positions."""

    def __init__(self, text: np.ndarray, cap: int, scratch: Scratch):
        self.x, self.n, self.cap, self.scratch = text, len(text), cap, scratch
        n = self.n
        self.s_type = scratch.array(n, bool)
        after, after_type, step = -1, True, 1 << 20  # the empty suffix is least
        for a in range(((n - 1) // step) * step, -1, -step) if n else ():
            z = min(a + step, n)
            x = text[a:z].astype(np.int16)
            nxt = np.append(x[1:], after)
            index = np.where(x != nxt, np.arange(z - a), z - a)
            index = np.minimum.accumulate(index[::-1])[::-1]
            t = np.append(x < nxt, after_type)[index]
            self.s_type[a:z] = t
            after, after_type = int(x[0]), bool(t[0])
        self.stars = np.flatnonzero(self.s_type[1:] & ~self.s_type[:-1]) + 1 if n else np.zeros(0, np.int64)
        self.sums = scratch.array(n + 1, np.uint64)
        self.sums[0] = 0
        power = powers(_BASE, min(n, step))
        jump, scale = np.uint64(pow(_BASE, step, 1 << 64)), np.uint64(1)
        for a in range(0, n, step):
            z = min(a + step, n)
            self.sums[a + 1 : z + 1] = np.cumsum(BYTE_HASH[text[a:z]] * power[: z - a] * scale) + self.sums[a]
            scale = np.uint64(int(scale) * int(jump) & ((1 << 64) - 1))
        self.back = powers(_INV, n + 1) if n < 1 << 24 else None

    def hashes(self, a: np.ndarray, size) -> np.ndarray:
        """Hash of the size bytes from each a."""
        raw = self.sums[a + size] - self.sums[a]
        if self.back is not None:
            return raw * self.back[a]
        lo, hi = powers(_INV, 1 << 12), powers(pow(_INV, 1 << 12, 1 << 64), (self.n >> 12) + 2)
        return raw * lo[a & 4095] * hi[a >> 12]

    def common(self, a: np.ndarray, b: np.ndarray, floor: int = 0) -> np.ndarray:
        """Common prefix of suffixes a and b, cap at most; those under floor count as 0."""
        limit = np.minimum(self.cap, self.n - np.maximum(a, b))
        out = np.zeros(len(a), np.int64)
        left = np.arange(len(a))
        if floor:
            left = np.flatnonzero(limit >= floor)
            left = left[self.hashes(a[left], floor) == self.hashes(b[left], floor)]
            out[left] = floor
        step = 1 << max(self.cap - floor, 1).bit_length() - 1
        while step and len(left):
            at = left[out[left] + step <= limit[left]]
            o = out[at]
            same = self.hashes(a[at] + o, step) == self.hashes(b[at] + o, step)
            out[at[same]] += step
            step >>= 1
        return out

    # ------------------------------------------------------------ induction
    def induce(self, stars: np.ndarray, lcps: np.ndarray | None, seen) -> None:
        """From S* positions in order (or grouped by byte, for naming) visits all S suffixes, then L ones, of each byte from the largest: seen(positions descending, lcp with the one before)."""
        x, types, cap = self.x, self.s_type, self.cap
        with_lcp = lcps is not None
        kept = BucketQueue(self.scratch)

        def runner(queue: BucketQueue, want_s: bool):
            least = np.full(256, -1, np.int64)  # of the common prefixes passed since a bucket's last push; -1: none yet
            if not want_s:
                least[x[-1]] = cap  # the last byte's suffix is there already

            def one(pos: np.ndarray, lcp: np.ndarray | None) -> None:
                has = np.flatnonzero(pos > 0)
                pred = pos[has] - 1
                ok = types[pred] == want_s
                # a predecessor belongs to this pass by its own type alone
                pred, src = pred[ok], has[ok]
                ch = x[pred]
                order = np.argsort(ch, kind="stable")
                pred, src, ch = pred[order], src[order], ch[order]
                if len(ch):
                    first = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
                    ends = np.append(first[1:], len(ch))
                out = None
                if with_lcp:
                    low = np.minimum.accumulate(lcp)
                    if len(ch):
                        out = np.empty(len(ch), np.int16)
                        inner = np.ones(len(ch), bool)
                        inner[first] = False
                        inner = np.flatnonzero(inner)
                        if len(inner):
                            lo, hi = src[inner - 1] + 1, src[inner]
                            k = _LOG[hi - lo + 1]
                            top = int(k.max())
                            table = np.empty((top + 1, len(lcp)), np.int16)
                            table[0] = lcp
                            for j in range(1, top + 1):
                                half = 1 << (j - 1)
                                m = len(lcp) - 2 * half + 1
                                np.minimum(table[j - 1, :m], table[j - 1, half : half + m], out=table[j, :m])
                            out[inner] = np.minimum(table[k, lo], table[k, hi - (1 << k) + 1])
                        d = ch[first].astype(np.int64)
                        out[first] = np.minimum(least[d], low[src[first]])
                        np.minimum(out + 1, cap, out=out)
                    rest = np.minimum.accumulate(lcp[::-1])[::-1]
                    np.minimum(least, low[-1], out=least, where=least >= 0)
                    if len(ch):
                        last = src[ends - 1]
                        least[d] = np.where(last + 1 < len(lcp), rest[np.minimum(last + 1, len(lcp) - 1)], cap)
                if len(ch):
                    for f, e in zip(first.tolist(), ends.tolist(), strict=True):
                        queue.push(int(ch[f]), pred[f:e], None if out is None else out[f:e])

            def run(pos: np.ndarray, lcp: np.ndarray | None) -> None:
                for a in range(0, len(pos), BATCH):
                    one(pos[a : a + BATCH], None if lcp is None else lcp[a : a + BATCH])

            return run

        # ascending: L suffixes
        queue = BucketQueue(self.scratch)
        go = runner(queue, False)
        zero = np.zeros(1, np.int16) if with_lcp else None
        queue.push(int(x[-1]), np.array([self.n - 1]), zero)
        bounds = np.searchsorted(x[stars], np.arange(257)) if len(stars) else np.zeros(257, int)
        for c in range(256):
            first, last = True, None
            while queue.blocks[c]:
                for pos, lcp in queue.take(c):
                    if with_lcp and first:
                        lcp = lcp.copy()
                        lcp[0] = 0
                    first, last = False, pos[-1]
                    kept.push(c, pos, lcp)
                    go(pos, lcp)
            a, z = bounds[c], bounds[c + 1]
            if a < z:
                lcp = None
                if with_lcp:
                    lcp = lcps[a:z].astype(np.int16)
                    lcp[0] = 0 if last is None else self.common(np.array([last]), stars[a : a + 1])[0]
                go(stars[a:z], lcp)
        # descending: S suffixes, then the kept L ones
        queue = BucketQueue(self.scratch)
        go = runner(queue, True)
        for c in range(255, -1, -1):
            last, first = None, True
            while queue.blocks[c]:
                for pos, lcp in queue.take(c):
                    if with_lcp and first:
                        lcp = lcp.copy()
                        lcp[0] = 0
                    first, last = False, pos[-1]
                    seen(pos, lcp)
                    go(pos, lcp)
            later = None  # of the block above: the lcp of its least with this one's largest
            for pos, lcp in kept.reversed(c):
                back = pos[::-1]
                turned = None
                if with_lcp:
                    turned = np.empty(len(back), np.int16)
                    turned[1:] = lcp[:0:-1]
                    if later is None:
                        turned[0] = 0 if last is None else self.common(np.array([last]), back[:1])[0]
                    else:
                        turned[0] = later
                    later = lcp[0]
                seen(back, turned)
                go(back, turned)

    def sorted_stars(self, exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """S* positions in suffix order (to cap bytes) and their common prefixes; unless exact, prefixes too short to matter count as 0."""
        stars = self.stars
        if len(stars) < 2:
            return stars, np.zeros(len(stars), np.int16)
        number = self.scratch.array(self.n, np.int32)
        number[:] = -1
        number[stars] = np.arange(len(stars))
        found = []

        def seen(pos, _):
            k = number[pos]
            found.append(k[k >= 0])

        self.induce(stars[np.argsort(self.x[stars], kind="stable")], None, seen)
        order = np.concatenate(found)[::-1]  # stars by their substrings
        size = np.append(stars[1:] + 1, self.n) - stars
        h = mix(self.hashes(stars, size) ^ size.astype(np.uint64))[order]
        rank = np.empty(len(stars), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(np.int64)]))
        # prefix doubling on the names: 2 bytes a name at least
        depth = 1
        while depth * 2 <= self.cap + 2 and rank[order[-1]] + 1 < len(stars):
            nxt = np.full(len(stars), -1, np.int64)
            nxt[:-depth] = rank[depth:]
            mine = rank[order]
            tied = np.concatenate([[False], mine[1:] == mine[:-1]])
            tied[:-1] |= tied[1:]
            at = np.flatnonzero(tied)
            part = order[at]
            part = part[np.argsort((rank[part] << 32) + nxt[part] + 1)]
            order[at] = part
            mine, follow = rank[order], nxt[order]
            new = np.concatenate([[True], (mine[1:] != mine[:-1]) | (follow[1:] != follow[:-1])])
            rank[order] = np.cumsum(new) - 1
            depth *= 2
        out = stars[order]
        lcp = np.zeros(len(out), np.int16)
        # an induced suffix stands before its S* one by that one's distance to the last at most, so shorter prefixes can't reach cap
        floor = 0 if exact else max(0, self.cap - 1 - int(np.diff(stars, prepend=0, append=self.n).max()))
        for a in range(1, len(out), 1 << 16):
            z = min(a + (1 << 16), len(out))
            lcp[a:z] = self.common(out[a - 1 : z - 1], out[a:z], floor)
        return out, lcp


def repeats(text: np.ndarray, cap: int, scratch: Scratch | None = None) -> np.ndarray:
    """Whether the cap bytes from each position also start elsewhere in the text."""
    scratch = scratch or Scratch()
    flags = scratch.array(len(text), bool)
    flags[:] = False
    if len(text) < 2:
        return flags
    shard = Shard(text, cap, scratch)
    stars, lcps = shard.sorted_stars(exact=False)
    before = [None]

    def seen(pos, lcp):
        long = lcp >= cap
        flags[pos[long]] = True
        flags[pos[:-1][long[1:]]] = True
        if long[0] and before[0] is not None:
            flags[before[0]] = True
        before[0] = pos[-1]

    shard.induce(stars, lcps, seen)
    return flags


def order_of(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes ascending, common prefix with the one before), to cap bytes: for tests and small texts."""
    shard = Shard(text, cap, Scratch())
    got = []
    shard.induce(*shard.sorted_stars(), lambda p, l: got.append((p, l)))
    pos, lcp = np.concatenate([g[0] for g in got])[::-1], np.concatenate([g[1] for g in got])[::-1]
    return pos, np.append(0, lcp[:-1])
