"""Edit-distance segment join with a relative error budget.

Two texts are neighbours when their edit distance is at most ``num/den`` of the longer one's
length.  The budget ``k`` follows from the longer text, so the longer text of a pair is cut into
``k + 1`` segments: ``k`` edits leave one of them intact, and it must occur in the shorter text
at a position inside the multi-match-aware window.  Candidates pass an exact q-gram count bound
and are verified by Spark's banded ``levenshtein(a, b, k)`` or, where most candidates are
neighbours, by bit-parallel alignment of many pairs at once; no neighbour is lost.

Texts meet in *cells*: a cell is a length class (texts whose lengths can match), split into
blocks whose sizes follow from the counted letters of the class.  A row travels to the few cells
where it can have partners, never to a whole group in one task: the home block is bounded, the
other side streams through it in chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH_MULT = np.uint32(0x9E3779B1)
EXPAND_ROWS = 1 << 21
#: Positions that are hashed and looked up at a time; the arrays stay in the cache.
STEP = 1 << 15
#: Added to the number of a stretch that is counted from the back of its text.
BACK = 1 << 26
#: Boxes of this many letters and more are looked up by as many letters as the shortest of their text has.
LIKE = 6


def _poly(codes: np.ndarray, q: int, made: dict[int, np.ndarray]) -> np.ndarray:
    """Polynomial hash of the q letters from each position on, doubled from that of half as many."""
    if q not in made:
        if q == 1:
            made[1] = codes.astype(np.uint32) + np.uint32(1)
        else:
            low = 1 << ((q - 1).bit_length() - 1)  # the largest power of two below q
            head, tail = _poly(codes, low, made), _poly(codes, q - low, made)
            n = max(0, len(codes) - q + 1)
            made[q] = head[:n] * np.uint32(pow(int(HASH_MULT), q - low, 1 << 32)) + tail[low : low + n]
    return made[q]


def _poly_at(codes: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """The same hash at some positions only."""
    h = np.zeros(len(at), dtype=np.uint32)
    for i in range(q):
        h = h * HASH_MULT + (codes[at + i].astype(np.uint32) + np.uint32(1))
    return h


def _mixed(head: np.ndarray, tail: np.ndarray | int) -> np.ndarray:
    """One number from the hashes of both parts of a seed."""
    h = head + tail
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h


class Pack:
    """A block of texts as one code array; texts are addressed by their index."""

    __slots__ = ("codes", "off", "length", "uid", "txt", "hashes", "kept")

    def __init__(self, uid: np.ndarray, txt: pa.Array, keep_bits: bool = False):
        self.uid, self.txt = uid, txt
        self.kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] | None = {} if keep_bits else None
        joined = "".join(txt.to_pylist())
        if joined.isascii():
            self.codes = np.frombuffer(joined.encode("ascii"), dtype=np.uint8)
        else:
            self.codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        self.length = np.asarray(pc.utf8_length(txt).to_numpy(zero_copy_only=False), dtype=np.int64)
        self.off = np.concatenate([[0], np.cumsum(self.length)])
        self.hashes: dict[int, np.ndarray] = {}

    def qhash(self, q: int) -> np.ndarray:
        """Hash of the q letters from each position on (also across text ends), made once."""
        if q not in self.hashes:
            out = np.empty(max(0, len(self.codes) - q + 1), dtype=np.uint32)
            for s in range(0, len(out), STEP):
                h = _poly(self.codes[s : s + STEP + q - 1], q, {})
                out[s : s + STEP] = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            self.hashes[q] = out
        return self.hashes[q]

    def profile(self, which: np.ndarray, q: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashed q-gram counts of the texts ``which`` and a flag for saturated rows; ``dims``
        is a power of two."""
        out = np.zeros((len(which), dims), dtype=np.uint8)
        full = np.zeros(len(which), dtype=bool)
        h, n = self.qhash(q), np.maximum(self.length[which] - q + 1, 0)
        for s in range(0, len(which), 256):
            rows, at = _ranges(self.off[which[s : s + 256]], n[s : s + 256])
            m = len(n[s : s + 256])
            counts = np.bincount(rows * dims + (h[at] & np.uint32(dims - 1)), minlength=m * dims).reshape(m, dims)
            if len(at) > 255 and counts.max() > 255:
                full[s : s + 256] = counts.max(axis=1) > 255
                counts = np.minimum(counts, 255)
            out[s : s + 256] = counts
        return out, full


    def held(self, which: np.ndarray, q: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """A bit for each hashed q-gram that a text has, in words of 64, and how many q-grams of a
        text repeat one of its bits.  A pack that keeps them makes those of all its texts once."""
        if self.kept is not None:
            if (q, dims) not in self.kept:
                self.kept[q, dims] = self._held(np.arange(len(self.uid)), q, dims)
            bits, spare = self.kept[q, dims]
            return bits[which], spare[which]
        return self._held(which, q, dims)

    def _held(self, which: np.ndarray, q: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
        h, n = self.qhash(q), np.maximum(self.length[which] - q + 1, 0)
        bits = np.zeros((len(which), dims // 64), dtype=np.uint64)
        for s in range(0, len(which), 256):
            rows, at = _ranges(self.off[which[s : s + 256]], n[s : s + 256])
            flags = np.zeros((len(n[s : s + 256]), dims), dtype=bool)
            flags[rows, h[at] & np.uint32(dims - 1)] = True
            bits[s : s + 256] = np.packbits(flags, axis=1).view(np.uint64)
        return bits, n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat (row, start[row] + 0..count[row]-1)."""
    rows = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return rows, np.arange(total) - np.repeat(ends - count, count) + np.repeat(start, count)


def _stretch(number: np.ndarray) -> np.ndarray:
    return number.astype(np.uint32) * np.uint32(0x27D4EB2F)


def _distinct(code: np.ndarray) -> np.ndarray:
    code.sort()
    return code[np.flatnonzero(np.diff(code, prepend=-1))]


class Segments:
    """The boxes of every text of a pack as seeds, in one table for each pattern of letters.

    A text is cut into k + 2 boxes.  If k edits turn it into the other text, take the edits of a
    box less one and add them up from the left: the sum starts at 0, falls by 1 at most and ends at
    -2 or below.  The box at which it falls from 0 to -1 for the last time is intact, it has as many
    edits before it as boxes, and the box after it has one edit at most, or the sum would rise to 0
    again; for the same reason the two boxes after it have two edits at most.  One edit leaves that box's first part intact in its place, or its last part at most one
    letter off.  So a seed is an intact box and one of these parts, and it must occur in the other
    text with its parts as far apart as that allows; the edits before the box bound where.

    Texts too short for boxes of two letters are cut into k + 1 boxes, one of which is intact, and
    a seed is a box alone.  With ``both`` the other text may also be the longer one, and k is
    that of the longest text in reach."""

    def __init__(self, pack: Pack, num: int, den: int, both: bool):
        self.pack, self.num, self.den, self.both = pack, num, den, both
        n = pack.length
        self.k = (n * den // (den - num) if both else n) * num // den
        base = n // (self.k + 2)
        single = base < 2
        m = self.k + np.where(single, 1, 2)
        self.bare = np.flatnonzero(m > n)  # only if half of the letters may differ
        row, j = _ranges(np.zeros(len(n), dtype=np.int64), np.where(m > n, 0, m))
        start, end, after = j * n[row] // m[row], (j + 1) * n[row] // m[row], np.minimum(j + 2, m[row]) * n[row] // m[row]
        size, following = end - start, after - end
        like, alone = base[row] >= LIKE, single[row]
        self.seg_row, self.seg_j = row.astype(np.int32), j.astype(np.int32)
        x = np.where(like, base[row], size)
        first = np.where(alone, 0, np.where(like, base[row], following) // 2)
        last = np.where(like, first, following - first)
        self.seg_start = (end - x).astype(np.int32)
        # where the seed may be in the other text: from its front if it is in the front half, else from its back
        at, left = end - x, self.k[row] - j
        least, half_way = n - self.k, ((n * den // (den - num) if both else n) - 1) // 2
        over = j if both else np.minimum(j, left)  # letters that the other text may be ahead
        spans = []
        for low, high, can in (
            (at - j, at + over, np.ones(len(row), dtype=bool)),
            (n[row] - 1 - at - left, n[row] - 1 - at + (left if both else np.minimum(j, left)), 2 * (at + over) >= least[row]),
        ):
            low, high = np.maximum(low, 0), np.minimum(high, half_way[row])
            spans.append((low, np.where(can & (left >= 0), high, -1)))
        wide = np.concatenate([high - low + 1 for low, high in spans])
        #: Places in a text are told apart by their stretch of 2^wide letters.
        self.wide = max(3, round(math.log2(wide[wide > 0].mean()))) if (wide > 0).any() else 3
        spans = [(low >> self.wide, np.where(high < low, 0, (high >> self.wide) - (low >> self.wide) + 1)) for low, high in spans]
        # the parts of a box that ``_followed`` looks for: its first and last letters, or only the last where they would overlap
        half = np.where(alone, 0, np.where(like, base[row] // 2, (base[row] + 1) // 2))
        self.half, self.part_end, self.two = half.astype(np.int32), end.astype(np.int32), size >= 2 * half
        self.part_start, self.part_codes = start.astype(np.int32), np.zeros((2, len(row)), dtype=np.uint32)
        for e in np.unique(half[~alone]):
            some = np.flatnonzero((half == e) & ~alone)
            self.part_codes[0, some] = _poly_at(pack.codes, pack.off[row[some]] + start[some], int(e))
            self.part_codes[1, some] = _poly_at(pack.codes, pack.off[row[some]] + end[some] - e, int(e))
        pick = np.flatnonzero(~alone & (j <= self.k[row]))
        parts = [(first, end, np.zeros(len(row), dtype=np.int64), 0), (last, after - last, following - last, 1)]  # letters, place, gap and its slack
        seeds: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        gaps: dict[tuple[int, int], set[int]] = {}
        for (letters, place, gap, slack), rows in zip(parts, (np.flatnonzero(j <= self.k[row]), pick), strict=True):
            shape = x[rows] * 1_000_000 + letters[rows]
            for code in np.unique(shape):
                key = (int(code) // 1_000_000, int(code) % 1_000_000)
                some = rows[shape == code]
                seeds.setdefault(key, []).append((some, pack.off[row[some]] + place[some]))
                gaps.setdefault(key, set()).update(int(g) + d for g in np.unique(gap[some]) for d in range(-slack, slack + 1))
        self.tables = {}
        for (width, letters), made in seeds.items():
            codes, ids = [], []
            for some, place in made:
                head = _poly_at(pack.codes, pack.off[row[some]] + self.seg_start[some], width) * HASH_MULT
                tail = _poly_at(pack.codes, place, letters)
                for back, (low, count) in enumerate(spans):
                    copies, stretch = _ranges(low[some], count[some])
                    codes.append(_mixed(head[copies] + _stretch(stretch + back * BACK), tail[copies]))
                    ids.append(some[copies].astype(np.uint32))
            both_parts = np.concatenate(codes).astype(np.uint64) << np.uint64(32) | np.concatenate(ids)
            both_parts.sort()
            h, seg = (both_parts >> np.uint64(32)).astype(np.uint32), both_parts.astype(np.uint32)
            depth = min(22, max(8, len(h).bit_length()))
            fine = min(26, depth + 4)
            byte, bit = h >> np.uint32(35 - fine), np.uint8(1) << (h >> np.uint32(32 - fine) & np.uint32(7)).astype(np.uint8)
            new = np.flatnonzero(np.diff(byte, prepend=~byte[:1]))
            held = np.zeros(1 << fine - 3, dtype=np.uint8)
            held[byte[new]] = np.bitwise_or.reduceat(bit, new)
            ends = np.zeros((1 << depth) + 1, dtype=np.int32)
            np.cumsum(np.bincount(h >> np.uint32(32 - depth), minlength=1 << depth), out=ends[1:])
            self.tables[width, letters] = (h, seg, depth, fine, held, ends, sorted(gaps[width, letters]))

    def matches(self, other: Pack, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index here, index in other), perhaps repeated, of texts whose lengths are near and that
        share a seed at allowed positions.  Without ``both`` the text there is not the longer one; ``same``:
        both sides hold the same table, of equal lengths the smaller uid is here."""
        if not len(self.pack.uid) or not len(other.uid):
            return
        for s in range(0, len(self.bare), step := max(1, EXPAND_ROWS // len(other.uid))):
            mine = np.repeat(self.bare[s : s + step], len(other.uid))
            theirs = np.tile(np.arange(len(other.uid)), len(self.bare[s : s + step]))
            ok, _, _ = self._fitting(mine, other, theirs, same)
            yield mine[ok], theirs[ok]
        owner = np.repeat(np.arange(len(other.uid), dtype=np.int32), other.length)
        inner = np.arange(len(other.codes), dtype=np.int32) - other.off[:-1].astype(np.int32)[owner]
        reach = max((w + e + max(g) for (w, e), (*_, g) in self.tables.items()), default=0)
        wait: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, int]]] = {shape: [] for shape in self.tables}
        waiting = 0
        for s in range(0, len(other.codes), STEP):
            made: dict[int, np.ndarray] = {}
            codes = other.codes[s : s + STEP + reach]
            ahead, behind = inner[s : s + STEP], other.length.astype(np.int32)[owner[s : s + STEP]] - 1 - inner[s : s + STEP]
            place = _stretch(np.where(ahead <= behind, ahead >> self.wide, (behind >> self.wide) + BACK))
            for shape, (_, _, _, fine, bits, _, gaps) in self.tables.items():
                width, letters = shape
                if len(codes) < width + letters:
                    continue
                head = _poly(codes, width, made)[:STEP] * HASH_MULT
                head += place[: len(head)]
                tail = _poly(codes, letters, made) if letters else None
                for gap in gaps:
                    if letters:
                        t = tail[width + gap : width + gap + len(head)]
                        h = _mixed(head[: len(t)], t)
                    else:
                        h = _mixed(head, np.uint32(0))
                    byte = (h >> np.uint32(35 - fine)).astype(np.int64)
                    hit = bits.take(byte, mode="clip")
                    hit >>= (h >> np.uint32(32 - fine)).astype(np.uint8) & np.uint8(7)
                    hit &= np.uint8(1)
                    at = np.flatnonzero(hit.view(bool))
                    wait[shape].append((h[at], at + s, width + gap + letters if letters else width))
                    waiting += len(at)
            if waiting >= EXPAND_ROWS:
                yield from self._expanded(wait, other, owner, inner, same)
                waiting = 0
        yield from self._expanded(wait, other, owner, inner, same)

    def _expanded(self, wait: dict, other: Pack, owner: np.ndarray, inner: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of the positions that wait, with the seeds of their hash; nothing waits then."""
        for shape, (hs, seg_of, depth, _, _, ends, _) in self.tables.items():
            mine, wait[shape] = wait[shape], []
            if not mine:
                continue
            h, at = np.concatenate([w[0] for w in mine]), np.concatenate([w[1] for w in mine])
            span = np.repeat([w[2] for w in mine], [len(w[0]) for w in mine])
            bucket = (h >> np.uint32(32 - depth)).astype(np.int64)
            lo = ends.take(bucket, mode="clip")
            count = ends.take(bucket + 1, mode="clip") - lo
            cum = np.cumsum(count, dtype=np.int64)
            pieces: dict[int, np.ndarray] = {}
            s = 0
            while s < len(at):
                done = cum[s - 1] if s else 0
                e = max(s + 1, int(np.searchsorted(cum, done + EXPAND_ROWS, side="right")))
                rows, place = _ranges(lo[s:e], count[s:e])
                equal = np.flatnonzero(hs.take(place, mode="clip") == h[s:e].take(rows, mode="clip"))
                seg, rows = seg_of[place[equal]], rows[equal] + s
                pos = at[rows]
                shift, j = inner[pos] - self.seg_start[seg], self.seg_j[seg]
                b = owner[pos]
                near = np.flatnonzero((np.abs(shift) <= j) & (b == owner[pos + span[rows] - 1]))
                seg, shift, j = seg[near], shift[near], j[near]
                a, b = self.seg_row[seg].astype(np.int64), b[near].astype(np.int64)
                ok, delta, k = self._fitting(a, other, b, same)
                ok &= np.abs(shift - delta) <= k - j
                ok = np.flatnonzero(ok)
                ok = ok[self._followed(seg[ok], pos[near[ok]] - self.seg_start[seg[ok]], other, pieces)]
                yield a[ok], b[ok]
                s = e

    def _followed(self, seg: np.ndarray, at: np.ndarray, other: Pack, pieces: dict[int, np.ndarray]) -> np.ndarray:
        """Whether the two boxes after a seed's box may have two edits in all (see above: the sum
        stays below 0), so that all of their parts but two are intact; ``at`` is where the
        text here would begin in the other codes."""
        out = np.ones(len(seg), dtype=bool)
        j, k = self.seg_j[seg], self.k[self.seg_row[seg]]
        full = np.flatnonzero((j < k) & (self.half[seg] > 0) & (self.two[np.minimum(seg + 1, len(self.two) - 1)] | self.two[np.minimum(seg + 2, len(self.two) - 1)]))
        for e in np.unique(self.half[seg[full]]):
            pick = full[self.half[seg[full]] == e]
            if int(e) not in pieces:
                pieces[int(e)] = _poly(other.codes, int(e), {})
            codes = pieces[int(e)]
            intact = np.zeros(len(pick), dtype=np.int64)
            needed = np.zeros(len(pick), dtype=np.int64)
            for box, slack in ((seg[pick] + 1, 1), (seg[pick] + 2, 2)):
                two = self.two[box]
                needed += two
                for part, place in ((0, self.part_start[box]), (1, self.part_end[box] - e)):
                    place, code = at[pick] + place, self.part_codes[part][box]
                    found = np.zeros(len(pick), dtype=bool)
                    for d in range(-slack, slack + 1):
                        found |= codes.take(place + d, mode="clip") == code
                    intact += found & two if part == 0 else found
            out[pick] = intact >= needed
        return out

    def _fitting(self, mine: np.ndarray, other: Pack, theirs: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether lengths and sides fit; by how much the other text is longer; the edits allowed."""
        delta = other.length[theirs] - self.pack.length[mine]
        if self.both:
            k = np.maximum(other.length[theirs], self.pack.length[mine]) * self.num // self.den
            return np.abs(delta) <= k, delta, k
        k = self.k[mine]
        ok = (-delta <= k) & (delta <= 0)
        if same:
            ok &= (delta < 0) | (self.pack.uid[mine] < other.uid[theirs])
        return ok, delta, k

    def survivors(self, other: Pack, q: int, dims: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Matches that also share as many q-grams as k edits must leave."""
        found: list[np.ndarray] = []
        wait: list[np.ndarray] = []
        for a, b in self.matches(other, same):
            wait.append(a * len(other.uid) + b)
            if sum(map(len, wait)) >= EXPAND_ROWS:
                found.append(self._bounded(_distinct(np.concatenate(wait)), other, q, dims))
                wait = []
        if wait:
            found.append(self._bounded(_distinct(np.concatenate(wait)), other, q, dims))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        code = _distinct(np.concatenate(found))
        return code // len(other.uid), code % len(other.uid)

    def _bounded(self, code: np.ndarray, other: Pack, q: int, dims: int) -> np.ndarray:
        """The codes of pairs that meet the q-gram bound, first by bits of the q-grams a text has
        (shared bits, and all repeats of one side, are no fewer than the shared q-grams), then by
        their counts."""
        a, b = code // len(other.uid), code % len(other.uid)
        longer = np.maximum(self.pack.length[a], other.length[b])
        need = longer - q + 1 - q * (longer * self.num // self.den)

        def by_bits(pa_: tuple, pb: tuple, xa: np.ndarray, xb: np.ndarray) -> np.ndarray:
            shared = np.bitwise_count(pa_[0][xa] & pb[0][xb]).sum(axis=1, dtype=np.int64)
            return shared + np.minimum(pa_[1][xa], pb[1][xb])

        def by_counts(pa_: tuple, pb: tuple, xa: np.ndarray, xb: np.ndarray) -> np.ndarray:
            shared = np.minimum(pa_[0][xa], pb[0][xb]).sum(axis=1, dtype=np.int64)
            return np.where(pa_[1][xa] | pb[1][xb], np.iinfo(np.int64).max, shared)

        test = np.flatnonzero(need > 0)
        for made, most in ((Pack.held, by_bits), (Pack.profile, by_counts)):
            fit = self._at_least(made, most, a, b, test, need, other, q, dims)
            keep = np.ones(len(code), dtype=bool)
            keep[test[~fit]] = False
            code, a, b, need = code[keep], a[keep], b[keep], need[keep]
            test = np.flatnonzero(need > 0)
        return code

    def _at_least(self, made, most, a: np.ndarray, b: np.ndarray, test: np.ndarray, need: np.ndarray, other: Pack, q: int, dims: int) -> np.ndarray:
        """Whether the pairs ``test`` may share the q-grams they need; both sides' summaries are
        made in bounded blocks."""
        fit = np.zeros(len(test), dtype=bool)
        ub, ib = np.unique(b[test], return_inverse=True)
        for s in range(0, len(ub), 4096):
            part = np.flatnonzero((ib >= s) & (ib < s + 4096))
            pb = made(other, ub[s : s + 4096], q, dims)
            ua, ia = np.unique(a[test[part]], return_inverse=True)
            for t in range(0, len(ua), 4096):
                pick = np.flatnonzero((ia >= t) & (ia < t + 4096))
                pa_ = made(self.pack, ua[t : t + 4096], q, dims)
                for x in range(0, len(pick), 1024):
                    w = pick[x : x + 1024]
                    fit[part[w]] = most(pa_, pb, ia[w] - t, ib[part[w]] - s) >= need[test[part[w]]]
        return fit


#: Pairs that wait to be aligned together, and most bytes of them.
ALIGN_ROWS, ALIGN_BYTES = 65_536, 32_000_000
#: Letters of a pattern that are aligned for many pairs at once; longer ones go one by one.
MANY_LETTERS = 1024


def _align_one(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two code arrays, a column of the alignment matrix in one whole number."""
    if not len(a) or not len(b):
        return len(a) + len(b)
    masks: dict[int, int] = {}
    for c in np.unique(a):
        masks[int(c)] = int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little")
    full, top = (1 << len(a)) - 1, len(a) - 1
    up, down, dist = full, 0, len(a)
    for c in b.tolist():
        eq = masks.get(c, 0)
        level = eq | down
        same = ((((eq & up) + up) ^ up) | eq) & full
        rise, fall = (down | ~(same | up)) & full, up & same
        dist += (rise >> top & 1) - (fall >> top & 1)
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        up, down = (fall | ~(level | rise)) & full, rise & level
    return dist


def _align_many(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, letters: int) -> np.ndarray:
    """Edit distances of the rows of two matrices of letter numbers; all patterns (rows of ``a``,
    ``la`` letters each) fill the same number of 64-bit words."""
    rows, words = np.arange(len(a)), (int(la.max()) + 63) // 64
    one, top, last = np.uint64(1), np.uint64(63), ((la - 1) % 64).astype(np.uint64)
    table = np.zeros((len(a) * letters, words), dtype=np.uint64)
    for i in range(int(la.max())):
        own = rows[la > i] if i >= la.min() else rows
        table[own * letters + a[own, i], i // 64] |= one << np.uint64(i % 64)
    at = np.ascontiguousarray((rows[:, None] * letters + b).T)
    up, down = np.full((len(a), words), ~np.uint64(0)), np.zeros((len(a), words), dtype=np.uint64)
    dist, out, first = la.copy(), la.copy(), int(lb.min(initial=0))
    for i in range(int(lb.max(initial=0))):
        eq = table.take(at[i], axis=0)
        level = eq | down
        total = (eq & up) + up
        over = total < up
        for w in range(1, words):
            carry = over[:, w - 1]
            total[:, w] += carry
            over[:, w] |= carry & (total[:, w] == 0)
        total ^= up
        total |= eq
        fall = up & total
        total |= up
        rise = down | ~total
        dist += ((rise[:, -1] >> last) & one).astype(np.int64)
        dist -= ((fall[:, -1] >> last) & one).astype(np.int64)
        high, low = rise >> top, fall >> top
        rise <<= one
        fall <<= one
        rise[:, 0] |= one
        rise[:, 1:] |= high[:, :-1]
        fall[:, 1:] |= low[:, :-1]
        np.bitwise_and(rise, level, out=down)
        level |= rise
        np.bitwise_or(fall, ~level, out=up)
        if i + 1 >= first:
            np.copyto(out, dist, where=lb == i + 1)
    return out


def distances(a: Pack, ia: np.ndarray, b: Pack, ib: np.ndarray) -> np.ndarray:
    """Edit distances of the texts ``ia`` of one pack and ``ib`` of another."""
    out = np.zeros(len(ia), dtype=np.int64)
    la, lb = a.length[ia], b.length[ib]
    if not len(ia):
        return out
    held = np.zeros(1 + max(int(a.codes.max(initial=0)), int(b.codes.max(initial=0))), dtype=bool)
    held[a.codes] = held[b.codes] = True
    number, letters = (np.cumsum(held) - 1).astype(np.int32), int(held.sum())
    words = (la + 63) // 64
    order = np.lexsort((lb, words))
    order = order[(la[order] > 0) & (la[order] <= MANY_LETTERS)]
    for x in np.flatnonzero((la == 0) | (la > MANY_LETTERS)):
        out[x] = _align_one(a.codes[a.off[ia[x]] : a.off[ia[x] + 1]], b.codes[b.off[ib[x]] : b.off[ib[x] + 1]])
    s = 0
    while s < len(order):
        w = words[order[s]]
        most = max(1, min(8192, (1 << 23) // (letters * int(w))))
        e = min(s + most, int(np.searchsorted(words[order], w, side="right")))
        pick = order[s:e]

        def matrix(codes: np.ndarray, off: np.ndarray, n: np.ndarray) -> np.ndarray:
            at = off[:, None] + np.minimum(np.arange(max(1, int(n.max()))), np.maximum(n - 1, 0)[:, None])
            return number[codes[np.minimum(at, max(0, len(codes) - 1))]] if len(codes) else np.zeros(at.shape, dtype=np.int32)

        out[pick] = _align_many(matrix(a.codes, a.off[ia[pick]], la[pick]), la[pick], matrix(b.codes, b.off[ib[pick]], lb[pick]), lb[pick], letters)
        s = e
    return out


OUT = pa.schema([("kind", pa.int32()), ("uid_a", pa.int64()), ("uid_b", pa.int64()), ("txt_a", pa.string()), ("txt_b", pa.string())])
OUT_DDL = "kind int, uid_a long, uid_b long, txt_a string, txt_b string"
ALIGNED = pa.schema([("kind", pa.int32()), ("uid_a", pa.int64()), ("uid_b", pa.int64()), ("dist", pa.int32())])
ALIGNED_DDL = "kind int, uid_a long, uid_b long, dist int"


def _cell_join(num: int, den: int, q: int, dims: int, same: bool, align: bool, chunk_letters: int, chunk_rows: int):
    """mapInArrow body: rows come ordered by (cell, side); side 0 is the bounded home block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"cell": None}
        pending: list[pa.RecordBatch] = []

        def start(cell: int) -> None:
            state.update(cell=cell, kind=None, home=[], pack=None, seg=None, wait=[], letters=0, rows=0)

        def emit(a: Pack, ia: np.ndarray, b: Pack, ib: np.ndarray) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(ia), 4096):
                x, y = ia[s : s + 4096], ib[s : s + 4096]
                made = pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), state["kind"], dtype=np.int32)), pa.array(a.uid[x]), pa.array(b.uid[y]), a.txt.take(pa.array(x)), b.txt.take(pa.array(y))],
                    schema=OUT,
                )
                if not align:
                    yield made
                    continue
                pending.append(made)
                if sum(p.num_rows for p in pending) >= ALIGN_ROWS or sum(p.nbytes for p in pending) >= ALIGN_BYTES:
                    yield aligned()

        def aligned() -> pa.RecordBatch:
            """The waiting pairs of all cells, aligned together."""
            tab = pa.Table.from_batches(pending, schema=OUT).combine_chunks()
            pending.clear()
            a, b = (Pack(tab[f"uid_{s}"].to_numpy(), pa.chunked_array(tab[f"txt_{s}"].chunks, pa.string()).combine_chunks()) for s in "ab")
            at = np.arange(tab.num_rows)
            dist = distances(a, at, b, at)
            near = dist <= np.maximum(a.length, b.length) * num // den
            return pa.RecordBatch.from_arrays([tab["kind"].combine_chunks().filter(pa.array(near)), pa.array(a.uid[near]), pa.array(b.uid[near]), pa.array(dist[near].astype(np.int32))], schema=ALIGNED)

        def flush() -> Iterator[pa.RecordBatch]:
            if not state["wait"] or not state["home"]:
                state.update(wait=[], letters=0, rows=0)
                return
            if state["pack"] is None:
                tab = pa.Table.from_batches(state["home"]).combine_chunks()
                state["pack"] = Pack(tab["uid"].to_numpy(), tab["txt"].combine_chunks(), keep_bits=True)
                state["seg"] = Segments(state["pack"], num, den, both=not same)
            tab = pa.Table.from_batches(state["wait"]).combine_chunks()
            other = Pack(tab["uid"].to_numpy(), tab["txt"].combine_chunks())
            state.update(wait=[], letters=0, rows=0)
            home = state["pack"]
            a, b = state["seg"].survivors(other, q, dims, same=same)
            yield from emit(home, a, other, b)

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            sides = batch.column("side").to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if s == e:
                    continue
                if state["cell"] != cells[s]:
                    if state["cell"] is not None:
                        yield from flush()
                    start(cells[s])
                if state["kind"] is None:
                    state["kind"] = batch.column("kind")[int(s)].as_py()
                if sides[s] == 0:
                    state["home"].append(batch.slice(s, e - s).select(["uid", "txt"]))
                    continue
                while s < e:
                    room = max(1, chunk_rows - state["rows"])
                    part = batch.slice(s, min(e - s, room)).select(["uid", "txt"])
                    state["wait"].append(part)
                    state["rows"] += part.num_rows
                    state["letters"] += part.column("txt").nbytes
                    s += part.num_rows
                    if state["rows"] >= chunk_rows or state["letters"] >= chunk_letters:
                        yield from flush()
        if state["cell"] is not None:
            yield from flush()
        if pending:
            yield aligned()

    return run


def edit_pairs(
    texts: DataFrame,
    sizes: DataFrame,
    num: int,
    den: int,
    q: int,
    dims: int = 4096,
    same: bool = False,
    align: bool = False,
    home_letters: int = 12_000_000,
    other_letters: tuple[int, int] = (8_000_000, 64_000_000),
    chunk_letters: int = 4_000_000,
    chunk_rows: int = 16_384,
) -> DataFrame:
    """All pairs of neighbouring texts, verified: ``kind, uid_a, uid_b, dist, txt_a, txt_b``; with
    ``align`` they are aligned where they meet and come without the texts.

    texts: ``kind int, uid long, txt string`` (distinct, not empty, uid unique in its kind) and
    booleans ``home`` and ``other``; pairs join a home text (a) with an other text (b).  With
    ``same`` both sides are the whole table: every unordered pair comes once, a being the longer
    (of equal lengths the one with the smaller uid).
    sizes: ``kind, n, home, other`` with rough lengths of the texts or of a superset, none of them
    below the length of the longest text: only the number of blocks of a length class follows.
    A home block has about ``home_letters``, which bounds a task's memory; another block lies
    between the two ``other_letters``, as small as it takes to give every core four cells, since a
    home text is copied to each of them.

    Null texts must be left out by the caller; an empty table gives no pairs.
    """
    spark = texts.sparkSession
    ratio = den / (den - num)
    width = math.log(ratio) * (0.5 if same else 1.0)  # a text has partners in its class and in two more

    def cls(n):
        return F.floor(F.log(n.cast("double")) / F.lit(width)).cast("int")

    n = F.col("n")
    longest = F.floor(n * den / (den - num)).cast("long") + 1
    shortest = n if same else F.ceil(n * (den - num) / den).cast("long")
    stats = (
        sizes.filter(n > 0)
        .withColumn("c", cls(n))
        .groupBy("kind", "c")
        .agg(F.sum(F.when(F.col("home"), n)).alias("h"), F.sum(F.when(F.col("other"), n)).alias("o"))
        .collect()  # one row per length class: two hundred at most
    )
    # the other side of a class also holds the texts of its neighbour classes
    home_blocks: dict[tuple[int, int], int] = {}
    other_blocks: dict[tuple[int, int], int] = {}
    near: dict[tuple[int, int], int] = {}
    by = {(r["kind"], r["c"]): (r["h"] or 0, r["o"] or 0) for r in stats}
    classes = [(kind, c) for kind in sorted({k for k, _ in by}) for c in range(max(x for k, x in by if k == kind) + 1)]
    for kind, c in classes:
        near[kind, c] = sum(by.get((kind, x), (0, 0))[1] for x in (range(c - 2, c + 1) if same else range(c - 1, c + 2)))
        home_blocks[kind, c] = max(1, math.ceil(by.get((kind, c), (0, 0))[0] / home_letters))
    even = sum(m * home_blocks[x] for x, m in near.items()) // (4 * spark.sparkContext.defaultParallelism)
    block = min(max(even, other_letters[0]), other_letters[1])
    for x, m in near.items():
        other_blocks[x] = max(1, math.ceil(m / block))
    # cells are numbered through kinds and classes; both lists are as short as the classes are few
    total, starts, base = 0, [], {}
    for key in classes:
        base.setdefault(key[0], len(starts))
        starts.append(total)
        total += home_blocks[key] * other_blocks[key]
    total = max(total, 1)
    cell0, hb, ob = F.lit(starts or [0]), F.lit([home_blocks[k] for k in classes] or [1]), F.lit([other_blocks[k] for k in classes] or [1])
    top = {k: max(c for kk, c in classes if kk == k) for k in base}

    def at(c):
        """Place of the row's kind and class in the lists; null for classes without homes."""
        out = F.lit(None).cast("int")
        for k in base:
            out = F.when((F.col("kind") == k) & (c <= top[k]), c + base[k]).otherwise(out)
        return out

    h = F.xxhash64("uid")
    none = F.array().cast("array<struct<cell: int, side: int>>")

    def cell(x, i, j, side: int):
        return F.struct((F.get(cell0, x) + i * F.get(ob, x) + j).alias("cell"), F.lit(side).alias("side"))

    def home_cells(x):
        i = F.pmod(h, F.get(hb, x)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.get(ob, x) - 1), lambda j: cell(x, i, j, 0))

    def other_cells(c):
        x = at(c)
        j = F.pmod(h, F.get(ob, x)).cast("int")
        return F.when(x.isNotNull(), F.transform(F.sequence(F.lit(0), F.get(hb, x) - 1), lambda i: cell(x, i, j, 1))).otherwise(none)

    rows = texts.withColumn("n", F.length("txt").cast("long")).filter(n > 0)
    own = F.when(F.col("home") & at(cls(n)).isNotNull(), home_cells(at(cls(n)))).otherwise(none)
    met = F.when(F.col("other"), F.flatten(F.transform(F.sequence(cls(shortest), cls(longest)), other_cells))).otherwise(none)
    # one pass over the texts: each goes to its cells as a home and as an other text
    cells = rows.select("kind", "uid", "txt", F.explode(F.concat(own, met)).alias("x")).select("x.cell", "x.side", "kind", "uid", "txt")
    parts = min(total, max(64, 4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    candidates = (
        cells.repartitionById(parts, F.col("cell") % parts)
        .sortWithinPartitions("cell", "side")
        .mapInArrow(_cell_join(num, den, q, dims, same, align, chunk_letters, chunk_rows), ALIGNED_DDL if align else OUT_DDL)
    )
    if align:
        return candidates
    budget = F.floor(F.greatest(F.length("txt_a"), F.length("txt_b")) * num / den).cast("int")
    return (
        candidates.withColumn("k", budget)
        .withColumn("dist", F.when(F.col("txt_a") == F.col("txt_b"), F.lit(0)).otherwise(F.expr("levenshtein(txt_a, txt_b, k)")))
        .filter("dist >= 0")
        .select("kind", "uid_a", "uid_b", "dist", "txt_a", "txt_b")
    )
