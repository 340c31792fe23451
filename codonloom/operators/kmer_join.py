"""In-memory part of the k-mer Jaccard join: k-mer sets of texts as sorted numbers, and the pairs
of two blocks of texts whose sets have a Jaccard index of at least a given one."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bits of a k-mer's number by which frequencies are counted.
BUCKET_BITS = 14
#: Letters of texts that become sets together, and matches that are counted together.
SET_LETTERS, EXPAND_ROWS = 1 << 20, 1 << 21
#: Letters of a block that meet another block at once.
CHUNK_LETTERS = 4_000_000
#: Ratio of the largest to the smallest set of a class.
CLASS_RATIO = 1.3


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat (row, start[row] + 0..count[row]-1)."""
    rows = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    return rows, np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(start, count)


#: Most letters A-Z whose number fits 32 bits.
NARROW = 6


def numbers(codes: np.ndarray, k: int, narrow: bool = False) -> np.ndarray:
    """A number for the k letters from each position on.  Up to nine ASCII letters keep their own
    number (mixed by a bijection); others are hashed to 63 bits, see ``hashed``.  With ``narrow``,
    for up to six letters A-Z, it has 32 bits."""
    n = max(0, len(codes) - k + 1)
    if narrow:
        key = np.zeros(n, dtype=np.uint32)
        for i in range(k):
            key |= (codes[i : i + n].astype(np.uint32) & np.uint32(31)) << np.uint32(5 * i)
        key ^= key >> np.uint32(16)
        key *= np.uint32(0x85EBCA6B)
        key ^= key >> np.uint32(13)
        key *= np.uint32(0xC2B2AE35)
        key ^= key >> np.uint32(16)
        return key
    key, wide = np.zeros(n, dtype=np.uint64), np.full(n, k > 9)
    for i in range(k):
        c = codes[i : i + n].astype(np.uint64)
        key = key * np.uint64(0x100000001B3) + c if k > 9 else key | (c & np.uint64(127)) << np.uint64(7 * i)
    if k <= 9 and codes.dtype != np.uint8:
        for i in range(k):
            wide |= codes[i : i + n] > 127
        h = np.zeros(int(wide.sum()), dtype=np.uint64)
        at = np.flatnonzero(wide)
        for i in range(k):
            h = (h ^ codes[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        key[at] = h
    if wide.any():
        key[wide] |= np.uint64(1 << 63)
    key ^= key >> np.uint64(30)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(27)
    key *= np.uint64(0x94D049BB133111EB)
    key ^= key >> np.uint64(31)
    return key


def _codes(texts: list[str]) -> np.ndarray:
    joined = "".join(texts)
    return np.frombuffer(joined.encode("ascii"), dtype=np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)


def hashed(text: str, k: int) -> bool:
    return k > 9 or not text.isascii()


def _chunks(length: np.ndarray, letters: int = SET_LETTERS) -> Iterator[tuple[int, int]]:
    ends, s = np.cumsum(length), 0
    while s < len(length):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + letters, side="right")))
        yield s, e
        s = e


def order_of(counts: np.ndarray, narrow: bool) -> np.ndarray:
    """The upper bits that stand for each bucket, so that numbers of rare buckets come first."""
    kind, bits = (np.uint32, 32) if narrow else (np.uint64, 64)
    turn = np.zeros(1 << BUCKET_BITS, dtype=kind)
    turn[np.argsort(counts, kind="stable")] = np.arange(1 << BUCKET_BITS, dtype=kind) << kind(bits - BUCKET_BITS)
    return turn


def counter(k: int, narrow: bool = False):
    """mapInArrow body: how many k-mers of the texts fall to each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            txt = batch.column("txt")
            for s, e in _chunks(pc.utf8_length(txt).to_numpy(zero_copy_only=False)):
                texts = txt.slice(s, e - s).to_pylist()
                length = np.array([len(t) for t in texts], dtype=np.int64)
                at = _ranges(np.cumsum(length) - length, np.maximum(length - k + 1, 0))[1]
                m = numbers(_codes(texts), k, narrow)[at]
                seen += np.bincount((m >> m.dtype.type(m.itemsize * 8 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["bucket", "n"])

    return run


class Sets:
    """Texts with their sets of k-mers, those of rarer buckets first, in classes of like size.

    Sets of sizes n and m with a Jaccard index of ``least`` hold ``o = least / (1 + least) (n + m)``
    common k-mers or more, so the first ``n - o + l`` of one and ``m - o + l`` of the other share
    at least ``l``, for any ``l`` up to ``o``."""

    def __init__(self, uid: pa.Array, part: np.ndarray, txt: pa.Array, k: int, least: float, turn: np.ndarray):
        self.uid, self.part, self.txt, self.k, self.turn = uid, part, txt, k, turn
        self.n, self.start = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
        tokens, done = [], 0
        for s, e in _chunks(pc.utf8_length(txt).to_numpy(zero_copy_only=False)):
            for rows, sets, n in self._sets(np.arange(s, e)):
                self.n[rows], self.start[rows] = n, done + np.cumsum(n) - n
                tokens.append(sets[np.arange(sets.shape[1]) < n[:, None]])
                done += len(tokens[-1])
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, dtype=turn.dtype)
        tokens.clear()
        # of each class: its texts, their first k-mers by number, the texts and places of those
        self.classes: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        mark = (np.arange(1 + int(part.max(initial=0)), dtype=turn.dtype)) * turn.dtype.type(0x9E3779B97F4A7C15 >> (0 if turn.itemsize == 8 else 32))
        kind = np.floor(np.log(np.maximum(self.n, 1)) / math.log(CLASS_RATIO)).astype(np.int64)
        for c in np.unique(kind[self.n > 0]) if least <= 1 else ():
            which = np.flatnonzero((kind == c) & (self.n > 0))
            low = int(self.n[which].min())
            own, rank = _ranges(np.zeros(len(which), dtype=np.int64), self._first(which, 0, low, least))
            head = self.tokens[self.start[which][own] + rank] ^ mark[part[which]][own]
            order = np.argsort(head)
            self.classes.append((low, which, head[order], which[own[order]].astype(np.int32), rank[order].astype(np.int32)))

    def _shared(self, low: int, other: int, least: float) -> int:
        """The k-mers that the beginnings of two sets of at least these sizes are made to share."""
        common = math.ceil((low + other) * least / (1 + least) - 1e-9)
        return max(1, min(common, 2 + min(low, other) // (16 if self.k < 5 else 20)))

    def _first(self, which: np.ndarray, other: int, low: int, least: float) -> np.ndarray:
        """How many first k-mers of the sets count when they meet sets of ``other`` k-mers or more;
        for 0 as many as may ever count."""
        n = self.n[which]
        o = np.ceil((n + np.maximum(other, np.ceil(n * least - 1e-9))) * (least / (1 + least)) - 1e-9).astype(np.int64)
        return np.clip(n - o + (self._shared(low, other, least) if other else self._shared(low, 1 << 40, least)), 0, n)

    def _sets(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, their sets as sorted rows, sizes) in groups of like length; texts without
        k-mers are left out."""
        texts = self.txt.take(pa.array(which)).to_pylist()
        length = np.array([len(t) for t in texts], dtype=np.int64)
        off, count = np.cumsum(length) - length, np.maximum(length - self.k + 1, 0)
        word = self.turn.dtype.type
        m = numbers(_codes(texts), self.k, self.turn.itemsize == 4)
        bits = self.turn.itemsize * 8 - BUCKET_BITS
        m = self.turn[m >> word(bits)] | (m & word((1 << bits) - 1))
        order = np.argsort(count, kind="stable")
        order, s = order[count[order] > 0], 0
        while s < len(order):
            top = count[order[s]] * 5 // 4
            e = min(int(np.searchsorted(count[order], top, side="right")), s + max(1, SET_LETTERS // int(top + 1)))
            pick = order[s:e]
            own, at = _ranges(off[pick], count[pick])
            sets = np.full((len(pick), int(count[pick].max())), ~word(0))
            sets[own, at - off[pick][own]] = m[at]
            sets.sort(axis=1)
            again = np.zeros(sets.shape, dtype=bool)
            again[:, 1:] = sets[:, 1:] == sets[:, :-1]
            again |= np.arange(sets.shape[1]) >= count[pick][:, None]
            if again.any():
                sets[again] = ~word(0)
                sets.sort(axis=1)
            yield which[pick], sets, sets.shape[1] - again.sum(axis=1)
            s = e

    def both(self, a: np.ndarray, other: Sets, b: np.ndarray) -> np.ndarray:
        """Number of common k-mers of the pairs (a here, b there)."""
        out = np.zeros(len(a), dtype=np.int64)
        size = self.n[a] + other.n[b]
        order, s = np.argsort(size, kind="stable"), 0
        while s < len(order):
            top = int(size[order[s]]) * 5 // 4 + 1
            pick = order[s : min(int(np.searchsorted(size[order], top, side="right")), s + max(1, SET_LETTERS // top))]
            s += len(pick)
            # both sets of a pair stand in one row of a matrix: what is common comes twice
            rows = np.full((len(pick), int(size[pick].max())), ~self.turn.dtype.type(0))
            for x, i, at in ((self, a[pick], 0), (other, b[pick], self.n[a[pick]])):
                own, place = _ranges(x.start[i], x.n[i])
                rows[own, place + (at - x.start[i])[own]] = x.tokens[place]
            rows.sort(axis=1)
            real = np.arange(1, rows.shape[1]) < size[pick][:, None]
            out[pick] = ((rows[:, 1:] == rows[:, :-1]) & real).sum(axis=1)
        return out

    def pairs(self, other: Sets, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(a here, b there, common k-mers, sizes of a and b), each pair once."""
        for x, (low, *here) in enumerate(self.classes):
            for y, (far, *there) in enumerate(other.classes):
                wide = CLASS_RATIO * (1 + 1e-9)
                if (other is self and y < x) or low * least > far * wide or far * least > low * wide:
                    continue
                shared = self._shared(low, far, least)
                head, mine = self._counted(here, far, low, least)
                their, theirs = other._counted(there, low, far, least)
                yield from self._met(other, head, mine, their, theirs, shared, other is self and x == y, least)

    def _counted(self, held: list[np.ndarray], other: int, low: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Of a class's first k-mers and their texts those that count against sets of ``other`` or more."""
        which, head, owner, rank = held
        most = np.zeros(len(self.n), dtype=np.int32)
        most[which] = self._first(which, other, low, least)
        keep = np.flatnonzero(rank < most[owner])
        return head[keep], owner[keep]

    def _met(self, other: Sets, head: np.ndarray, mine: np.ndarray, their: np.ndarray, theirs: np.ndarray, shared: int, once: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs that share ``shared`` of the k-mers ``head`` of the texts ``mine`` and ``their``
        of ``theirs``, both in order of number; with ``once`` only a < b."""
        if not len(head) or not len(their):
            return
        # each k-mer once, with the place of its first text
        new = np.concatenate([[True], head[1:] != head[:-1]])
        first = np.append(np.flatnonzero(new), len(head))
        head = head[new]
        place = np.minimum(np.searchsorted(head, their), len(head) - 1)
        order = np.flatnonzero(head[place] == their)
        order = order[np.argsort(theirs[order], kind="stable")]
        owner, place = theirs[order].astype(np.int64), place[order]
        lo = first[place]
        cnt = first[place + 1] - lo
        cum, s = np.cumsum(cnt), 0
        while s < len(order):
            e = int(np.searchsorted(cum, (cum[s - 1] if s else 0) + EXPAND_ROWS, side="right"))
            # all matches of a text there are counted together
            start = int(np.searchsorted(owner, owner[min(e, len(order) - 1)], side="left"))
            e = len(order) if e >= len(order) else start if start > s else int(np.searchsorted(owner, owner[s], side="right"))
            rows, at = _ranges(lo[s:e], cnt[s:e])
            code = owner[s:e][rows] * len(self.n) + mine[at]
            code.sort()
            new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, dtype=np.int64)
            hits = np.diff(np.append(new, len(code)))
            code = code[new[hits >= shared]]
            b, a = code // len(self.n), code % len(self.n)
            ok = (self.part[a] == other.part[b]) & (self.n[a] >= least * other.n[b] - 1e-9) & (other.n[b] >= least * self.n[a] - 1e-9)
            if once:
                ok &= a < b
            a, b = a[ok], b[ok]
            if len(a):
                yield a, b, self.both(a, other, b), self.n[a], other.n[b]
            s = e


def _exact(a: str, b: str, k: int) -> tuple[int, int, int]:
    x, y = ({t[i : i + k] for i in range(len(t) - k + 1)} for t in (a, b))
    return len(x & y), len(x), len(y)


def _near(home: Sets, other: Sets, k: int, least: float, turn: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``uid_a, uid_b, jaccard`` of the pairs of two blocks."""
    for a, b, both, na, nb in home.pairs(other, least):
        # numbers of 32 bits are never hashed
        wide = [] if turn.itemsize == 4 else [i for i, (x, y) in enumerate(zip(home.txt.take(pa.array(a)).to_pylist(), other.txt.take(pa.array(b)).to_pylist(), strict=True)) if hashed(x, k) or hashed(y, k)]
        if wide:
            na, nb = na.copy(), nb.copy()
        for i in wide:
            both[i], na[i], nb[i] = _exact(home.txt[int(a[i])].as_py(), other.txt[int(b[i])].as_py(), k)
        j = both / (na + nb - both)
        near = np.flatnonzero(j >= least - (1e-12 if math.isfinite(least) else 0))
        if len(near):
            yield pa.RecordBatch.from_arrays([home.uid.take(pa.array(a[near])), other.uid.take(pa.array(b[near])), pa.array(j[near])], schema=schema)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: the rows ``block, part, uid, txt`` of a partition, all of one block, as one
    row with their compressed ``part, uid, txt``."""
    block, sink, writer = None, pa.BufferOutputStream(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block")[0].as_py()
        rows = batch.select(["part", "uid", "txt"])
        if writer is None:
            writer = pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        writer.write_batch(rows)
    if writer is not None:
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "texts"])


def pack_join(k: int, least: float, turn: np.ndarray, schema: pa.Schema):
    """mapInArrow body over rows ``block_a, a, block_b, b`` of packed blocks of one part: the pairs
    of each two blocks, the second of which is met in chunks."""

    def unpacked(texts: pa.Scalar) -> pa.Table:
        return pa.ipc.open_stream(texts.as_buffer()).read_all()

    def sets(rows: pa.Table) -> Sets:
        rows = rows.combine_chunks()
        uid, txt = (pa.concat_arrays(rows[c].chunks) for c in ("uid", "txt"))
        return Sets(uid, np.zeros(rows.num_rows, dtype=np.int64), txt, k, least, turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = batch.column("block_a")[i].as_py(), batch.column("block_b")[i].as_py()
                if home is None or at != one:
                    home = None
                    at, home = one, sets(unpacked(batch.column("a")[i]))
                if one == two:
                    yield from _near(home, home, k, least, turn, schema)
                    continue
                rows = unpacked(batch.column("b")[i])
                for s, e in _chunks(pc.utf8_length(rows["txt"]).to_numpy(), CHUNK_LETTERS):
                    yield from _near(home, sets(rows.slice(s, e - s)), k, least, turn, schema)

    return run


def cell_join(k: int, least: float, turn: np.ndarray, schema: pa.Schema, chunk_letters: int = 2_000_000):
    """mapInArrow body over rows ``cell, side, part, uid, txt`` in order of cell and side.

    Side 0 is a block that meets side 1, which streams through in chunks; side 2 is a block that
    meets itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"cell": None}

        def start(cell: int) -> None:
            state.update(cell=cell, side=0, rows={0: [], 1: [], 2: []}, letters=0, home=None, parts={})

        def sets(side: int) -> Sets:
            tab = pa.Table.from_batches(state["rows"][side]).combine_chunks()
            state["rows"][side] = []
            number = np.array([state["parts"].setdefault(p, len(state["parts"])) for p in tab["part"].to_pylist()], dtype=np.int64)
            uid, txt = (pa.concat_arrays(tab[c].chunks) for c in ("uid", "txt"))
            return Sets(uid, number, txt, k, least, turn)

        def flush() -> Iterator[pa.RecordBatch]:
            """The waiting rows of side 1 meet the home block."""
            state["letters"] = 0
            if not state["rows"][1]:
                return
            if state["home"] is None and state["rows"][0]:
                state["home"] = sets(0)
            if state["home"] is None:
                state["rows"][1] = []
                return
            yield from _near(state["home"], sets(1), k, least, turn, schema)

        def end() -> Iterator[pa.RecordBatch]:
            yield from flush()
            if state["rows"][2]:
                own = sets(2)
                yield from _near(own, own, k, least, turn, schema)

        for batch in batches:
            cells, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if s == e:
                    continue
                if state["cell"] != cells[s]:
                    if state["cell"] is not None:
                        yield from end()
                    start(cells[s])
                rows = batch.slice(int(s), int(e - s)).select(["part", "uid", "txt"])
                state["rows"][int(sides[s])].append(rows)
                if sides[s] == 1:
                    state["letters"] += rows.column("txt").nbytes
                    if state["letters"] >= chunk_letters:
                        yield from flush()
        if state["cell"] is not None:
            yield from end()

    return run


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, low = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        x, y = low[a], low[b]
        open_ = x != y
        if not open_.any():
            break
        np.minimum.at(low, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while not np.array_equal(low[low], low):
            low = low[low]
    out = np.flatnonzero(low != np.arange(len(ids)))
    return ids[out], ids[low[out]]


def forest(most: int = 1 << 20):
    """mapInArrow body over edges ``u, v`` of whole numbers: the stars of a task's components, which
    link what the edges link and are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, kept = 0, 0

        def merge() -> None:
            nonlocal held, n, kept
            held = [_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            n = kept = len(held[0][0])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in "uv"))
            n += batch.num_rows
            if n > 2 * kept + most:
                merge()
        if held:
            merge()
            u, v = held[0]
            for s in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(u[s : s + (1 << 16)]), pa.array(v[s : s + (1 << 16)])], names=["u", "v"])

    return run
