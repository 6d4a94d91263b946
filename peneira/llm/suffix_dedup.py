"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if some ``span``-byte string that covers it also starts earlier, in
a document of smaller id or earlier in its own. What is kept equals a scan of
every suffix; only the suffixes that are stored are thinned:

0. *Names.* Where ids are unique (equal rows aside), a row's id is its name. Else the
   distinct pairs of id and 128-bit text hash are sorted and numbered, and the
   number, written with the texts, is the name.
1. *Sampling.* Of the 24-byte strings in a window of ``span`` bytes the one with
   the least hash stands for the window, so equal windows choose equal suffixes,
   whatever surrounds them. Windows that choose the same suffix form a block of
   at most ``span - 23`` windows; two blocks of equal bytes have equal windows.
   Long texts are worked on in pieces; where a piece ends, so does the block.
2. *Index family.* Suffixes are dealt out by their first 24 bytes. A partition is
   sorted into slices of these, each with a family of its own, whose size follows
   from the bytes of the table and not from the partition's. In a slice they come in batches. A batch gets its suffix array (order: first
   8 bytes, then fingerprints of the first 24 bytes and of the block), is
   scanned against each level already there, and enters as a level of size one;
   levels of equal size merge into one of twice the size. Where two blocks match,
   the later one is a repeat and leaves the index. At the end, blocks that share
   a suffix with a different block may match in part. Windows whose suffix lies
   at about the same offset have a long core in common; only the windows of a
   core that both blocks share (by 16 bits of its hash) remain in doubt.
   A suffix with many different blocks in one map task is hot: its blocks are put
   in doubt there, and one row tells the index, where all its other blocks are too.
3. *Doubtful windows* are few (the edges of copied passages). They are
   fingerprinted with 128 bits and the first place of each is found by a partial
   aggregation.
4. *Removal* joins these decisions with the texts, once; only texts with doubtful
   windows are written and joined again.

A copied text of any number of copies sends one suffix per map task and block,
since each map task drops the repeats among its own suffixes first; a suffix sends
at most ``HOT`` different blocks per map task; and no step collects the rows of a key.

Defined results: null texts are empty; texts under ``span`` bytes lose nothing;
a null id counts as the largest; rows of equal id and text are one document and get
equal results; differing rows of one id, or of none, are documents in the order of
their text hashes; columns of any names are passed on as asked; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import discard, materialize, named, release, utf8

SEED = 24  # bytes of a suffix that deal it out and order it
SPAN = 100
LEAST_SPAN, MOST_SPAN = 64, 150
#: Bytes worked on at once; arrays of eight bytes for each of them are held.
CHUNK = 1 << 18
#: Suffixes whose repeats a map task drops at once.
FLUSH = 1 << 18
#: Suffixes of a batch: a slice has tens of them, so that levels meet and merge.
BATCH = 4096
#: Different blocks of one suffix among these from which on it is hot.
HOT = 64
#: Bytes of text whose suffixes go to one partition (more if there would be over
#: MOST_PARTS), and to one slice of it.
PART_BYTES, SLICE_BYTES, MOST_PARTS = 32 << 20, 4 << 20, 20_000
#: loc packs the first window's offset, the count of further windows, and the offset
#: of the suffix in the first window.
RUN_BITS = 7
START_AT = 2 * RUN_BITS
#: In place of a loc: the suffix is hot.
HOT_MARK = -(1 << 63)
#: Ranges of the suffix's offset in its window; each has a core of its own.
ARMS = 4
NULL_ID = (1 << 63) - 1

ENTRY = "p8 long, kh long, bh long, arms long, did long, loc long"
#: arms: bits of the ranges in doubt; 0 for a block that is a repeat.
FLAG = "did long, loc long, arms long"

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _powers() -> dict[int, np.uint64]:
    out, value, n = {}, int(_BASE), 1
    while n <= 16:
        out[n] = _U(value)
        value, n = value * value % (1 << 64), 2 * n
    return out


_POW = _powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _rolled(data: np.ndarray) -> dict[int, np.ndarray]:
    """Polynomial hashes of the 1, 2, 4, 8 and 16 bytes from each position on."""
    h = {1: _BYTES[data]}
    for n in (1, 2, 4, 8):
        a = h[n]
        h[2 * n] = a[: max(len(a) - n, 0)] * _POW[n] + a[n:]
    return h


def _span_hash(h: dict[int, np.ndarray], at: np.ndarray, span: int) -> np.ndarray:
    """Hash of the ``span`` bytes from each of ``at`` on."""
    out, done = np.zeros(len(at), np.uint64), 0
    for n in (16, 8, 4, 2, 1):
        while span - done >= n:
            out = out * _POW[n] + h[n][at + done]
            done += n
    return _mix(out)


class Chunk:
    """Blocks of some whole documents laid end to end."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = SPAN):
        self.starts, self.span = starts, span
        n = len(data)
        empty = np.zeros(0, np.int64)
        self.lo = self.hi = self.seed = self.doc = empty
        self.kh = self.p8 = np.zeros(0, np.uint64)
        if n < span or not len(starts):
            return
        edge = np.zeros(n + 1, np.int8)
        full = ends - starts >= span
        np.add.at(edge, starts[full], 1)
        np.add.at(edge, ends[full] - span + 1, -1)
        valid = np.cumsum(edge[: n - span + 1], dtype=np.int8) > 0
        if not valid.any():
            return
        self.h = h = _rolled(data)
        m = len(h[16]) - 8
        seeds = _mix(h[16][:m] * _POW[8] + h[8][16 : 16 + m])
        low = (seeds & _U(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        width, wide = 1, span - SEED + 1
        while 2 * width <= wide:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if wide > width:
            low = np.minimum(low[: width - wide], low[wide - width :])
        at = (low & _U(0xFFFFFFFF)).astype(np.int64)[: len(valid)]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
        new &= valid
        last = np.ones(len(at), bool)
        last[:-1] = (at[1:] != at[:-1]) | ~valid[1:]
        last &= valid
        self.lo, self.hi = np.flatnonzero(new), np.flatnonzero(last)
        self.seed = at[self.lo]
        self.doc = np.searchsorted(starts, self.lo, "right") - 1
        self.kh = seeds[self.seed]

    def blocks(self) -> np.ndarray:
        """Each block's fingerprint: its first and last window and its shape say it all."""
        shape = ((self.hi - self.lo) << 8 | (self.seed - self.lo)).astype(np.uint64)
        first, last = _span_hash(self.h, self.lo, self.span), _span_hash(self.h, self.hi, self.span)
        return _mix(first * _POW[2] + last * _POW[4] + shape * _POW[1])

    def arms(self) -> np.ndarray:
        """16 bits of the hash of the core of each range of offsets; 0 where the block has no such window."""
        out, wide = np.zeros(len(self.lo), np.uint64), -(-(self.span - SEED + 1) // ARMS)
        for arm in range(ARMS):
            least, most = arm * wide, min((arm + 1) * wide, self.span - SEED + 1) - 1
            has = np.flatnonzero((self.seed - self.lo >= least) & (self.seed - self.hi <= most))
            # every window with an offset in the range covers these bytes
            core = _span_hash(self.h, self.seed[has] - least, self.span - (most - least))
            out[has] |= ((core >> _U(48)) | _U(1)) << _U(16 * arm)
        return out


def _prefix8(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = out << _U(8) | data[at + i].astype(np.uint64)
    return out


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, offset in it, bytes, starts and ends of some whole texts, or of a part of a long one.

    Parts overlap by a window less one byte, so each window is in one of them.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1
        if last > first:
            o = offsets[first : last + 1]
            yield first, 0, data[o[0] : o[-1]], o[:-1] - o[0], o[1:] - o[0]
        else:
            low, last = int(offsets[first]), first + 1
            size = int(offsets[last]) - low
            for at in range(0, size, CHUNK):
                part = data[low + at : low + min(size, at + CHUNK + MOST_SPAN - 1)]
                yield first, at, part, np.zeros(1, np.int64), np.array([len(part)])
        first = last


def _locs(start: np.ndarray, run: np.ndarray, seed: np.ndarray) -> np.ndarray:
    return (start << START_AT) | (run << RUN_BITS) | seed


def _start_run(locs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return locs >> START_AT, locs >> RUN_BITS & ((1 << RUN_BITS) - 1)


def _rows(kind: str, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    fields = [x.split() for x in kind.split(", ")]
    types = {"long": pa.int64(), "boolean": pa.bool_()}
    for i in range(0, len(columns[0]), 1 << 16):
        parts = [c[i : i + (1 << 16)] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, types[t]) for c, (_, t) in zip(parts, fields, strict=True)], names=[f for f, _ in fields])


def _lanes(arms: np.ndarray) -> np.ndarray:
    """Bits of the ranges of which a block has windows."""
    out = np.zeros(len(arms), np.int64)
    for arm in range(ARMS):
        out |= np.where(arms.view(np.uint64) >> _U(16 * arm) & _U(0xFFFF) > 0, 1 << arm, 0)
    return out


class SuffixArray:
    """Suffixes in order, with the place of each block's first known occurrence."""

    def __init__(self, key: np.ndarray, arms: np.ndarray, did: np.ndarray, loc: np.ndarray):
        self.key, self.arms, self.did, self.loc = key, arms, did, loc

    @classmethod
    def of(cls, p8, kh, bh, arms, did, loc) -> tuple[SuffixArray, tuple[np.ndarray, np.ndarray]]:
        """The array of a batch, and the places whose block is earlier in the batch."""
        key = np.ascontiguousarray(np.stack([p8, kh, bh], 1).astype(np.uint64).astype(">u8")).view("S24").ravel()
        order = np.lexsort((loc, did, bh.view(np.uint64), kh.view(np.uint64), p8.view(np.uint64)))
        return cls(key[order], arms[order], did[order], loc[order])._firsts()

    def _firsts(self) -> tuple[SuffixArray, tuple[np.ndarray, np.ndarray]]:
        """Needs the places of equal keys in order."""
        n = len(self.key)
        same = np.zeros(n, bool)
        same[1:] = self.key[1:] == self.key[:-1]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        # a place that is met twice is one occurrence
        late = same & ((self.did != self.did[head]) | (self.loc != self.loc[head]))
        return SuffixArray(self.key[~same], self.arms[~same], self.did[~same], self.loc[~same]), (self.did[late], self.loc[late])

    def scan(self, level: SuffixArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Drops from either side the later one of each pair of equal blocks; gives its place."""
        at = np.searchsorted(level.key, self.key)
        inside = at < len(level.key)
        hit = np.zeros(len(at), bool)
        hit[inside] = level.key[at[inside]] == self.key[inside]
        mine, theirs = np.flatnonzero(hit), at[hit]
        if not len(mine):
            return
        a, b, c, d = self.did[mine], level.did[theirs], self.loc[mine], level.loc[theirs]
        before = (a < b) | ((a == b) & (c < d))
        same = (a == b) & (c == d)
        yield np.where(before, b, a)[~same], np.where(before, d, c)[~same]
        level.did[theirs], level.loc[theirs] = np.where(before, a, b), np.where(before, c, d)
        keep = ~hit
        self.key, self.arms, self.did, self.loc = self.key[keep], self.arms[keep], self.did[keep], self.loc[keep]

    def merge(self, other: SuffixArray) -> SuffixArray:
        at = np.searchsorted(self.key, other.key, "right")
        return SuffixArray(*(np.insert(a, at, b) for a, b in ((self.key, other.key), (self.arms, other.arms), (self.did, other.did), (self.loc, other.loc))))


class IndexFamily:
    """Levels of suffix arrays; a level stands for a power of two of batches."""

    def __init__(self):
        self.levels: list[tuple[int, SuffixArray]] = []

    def add(self, p8, kh, bh, arms, did, loc) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes a batch in; gives the places that repeat an earlier block."""
        new, late = SuffixArray.of(p8, kh, bh, arms, did, loc)
        yield late
        for _, level in self.levels:
            yield from new.scan(level)
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            new, size = level.merge(new), 2 * size
        self.levels.append((size, new))

    def doubtful(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of blocks that may match a different block in part, with the ranges in question; all of the ``hot`` suffixes."""
        whole = None
        for _, level in reversed(self.levels):
            whole = level if whole is None else level.merge(whole)
        none = np.zeros(0, np.int64)
        if whole is None or not len(whole.key):
            return none, none, none
        heads = np.ascontiguousarray(whole.key.view(np.uint8).reshape(-1, 24)[:, :16]).view("S16").ravel()
        same = heads[1:] == heads[:-1]
        run = np.concatenate([[0], np.cumsum(~same)])
        met = np.zeros(len(heads), bool)
        met[1:] |= same
        met[:-1] |= same
        rows = np.flatnonzero(met)
        bits = np.zeros(len(rows), np.int64)
        for arm in range(ARMS):
            core = whole.arms.view(np.uint64)[rows] >> _U(16 * arm) & _U(0xFFFF)
            both = (run[rows].astype(np.uint64) << _U(16)) | core
            order = np.argsort(both, kind="stable")
            equal = both[order][1:] == both[order][:-1]
            shared = np.zeros(len(rows), bool)
            shared[order[1:]] |= equal
            shared[order[:-1]] |= equal
            bits |= np.where(shared & (core > 0), 1 << arm, 0)
        every = np.zeros(len(heads), np.int64)
        every[rows] = bits
        if len(hot):
            suffix = np.ascontiguousarray(whole.key.view(np.uint8).reshape(-1, 24)[:, 8:16]).view(">u8").ravel().astype(np.uint64)
            named = np.isin(suffix, hot)
            every[named] = _lanes(whole.arms[named])
        found = every > 0
        return whole.did[found], whole.loc[found], every[found]


def _sample(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush():
            p8, kh, bh, arms, did, loc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((loc, did, bh, kh))
            p8, kh, bh, arms, did, loc = (x[order] for x in (p8, kh, bh, arms, did, loc))
            new_kh = np.ones(len(kh), bool)
            new_kh[1:] = kh[1:] != kh[:-1]
            same = np.zeros(len(kh), bool)
            same[1:] = ~new_kh[1:] & (bh[1:] == bh[:-1])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(kh))))
            twice = same & (did == did[head]) & (loc == loc[head])
            suffix = np.cumsum(new_kh) - 1
            hot = (np.bincount(suffix[~same]) > HOT)[suffix]
            told = np.flatnonzero(hot & new_kh)
            marks = [p8[told], kh[told], bh[told], arms[told], did[told], np.full(len(told), HOT_MARK, np.int64)]
            # repeats, and blocks in doubt, are known here: they go on by document, as negative places
            known = same | hot
            arms = np.where(same, 0, np.where(hot, _lanes(arms), arms.view(np.int64))).view(np.uint64)
            kh = np.where(known, _mix(did.view(np.uint64)), kh)
            loc = np.where(known, ~loc, loc)
            return [np.concatenate([x[~twice].view(np.int64), m.view(np.int64)]) for x, m in zip((p8, kh, bh, arms, did, loc), marks, strict=True)]

        n = 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), utf8(batch.column(1))
            for row, base, data, starts, ends in _chunks(texts):
                c = Chunk(data, starts, ends, span)
                if base or len(data) > CHUNK:
                    _crop(c, CHUNK)
                if not len(c.lo):
                    continue
                locs = _locs(base + c.lo - starts[c.doc], c.hi - c.lo, c.seed - c.lo)
                held.append([_prefix8(data, c.seed), c.kh, c.blocks(), c.arms(), ids[row + c.doc], locs])
                n += len(c.lo)
                if n > FLUSH:
                    yield from _rows(ENTRY, flush())
                    n = 0
        if held:
            yield from _rows(ENTRY, flush())

    return run


def _crop(c: Chunk, n: int) -> None:
    """Leaves to the next part the windows from ``n`` on."""
    own = c.lo < n
    c.lo, c.hi, c.seed, c.kh, c.doc = c.lo[own], np.minimum(c.hi[own], n - 1), c.seed[own], c.kh[own], c.doc[own]


def _index(bits: int):
    """Takes entries sorted by the first ``bits`` of ``kh``; a family for each value of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held, hot, at, n = IndexFamily(), [], [], -1, 0

        def take():
            batch = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            for d, place in family.add(*batch):
                yield from _rows(FLAG, [d, place, np.zeros(len(d), np.int64)])

        def close():
            if held:
                yield from take()
            yield from _rows(FLAG, list(family.doubtful(np.unique(np.concatenate(hot).view(np.uint64)) if hot else np.zeros(0, np.uint64))))

        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(6)]
            slices = (columns[1].view(np.uint64) >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(batch.num_rows, np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(slices)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if slices[i] != at:
                    yield from close()
                    family, hot, at, n = IndexFamily(), [], slices[i], 0
                _, kh, _, arms, did, loc = part = [x[i:j] for x in columns]
                if (loc < 0).any():
                    mark = loc == HOT_MARK
                    if mark.any():
                        hot.append(kh[mark])
                    known = (loc < 0) & ~mark
                    yield from _rows(FLAG, [did[known], ~loc[known], arms[known]])
                    part = [x[loc >= 0] for x in part]
                for low in range(0, len(part[0]), BATCH):
                    held.append([x[low : low + BATCH] for x in part])
                    n += len(held[-1][0])
                    if n >= BATCH:
                        yield from take()
                        n = 0
        yield from close()

    return run


def _spread(lists: pa.Array, row: int) -> np.ndarray:
    value = lists[row].values
    return np.zeros(0, np.int64) if value is None else value.to_numpy()


def _windows(locs: np.ndarray, arms: np.ndarray, span: int) -> Iterator[np.ndarray]:
    """Offsets of the windows in doubt, in order, those of some blocks at a time."""
    if not len(locs):
        return
    order = np.argsort(locs, kind="stable")
    locs, arms = locs[order], arms[order]
    # a place that is told twice is one block
    heads = np.flatnonzero(np.concatenate([[True], locs[1:] != locs[:-1]]))
    locs, arms = locs[heads], np.bitwise_or.reduceat(arms, heads)
    for i in range(0, len(locs), 4096):
        some, bits = locs[i : i + 4096], arms[i : i + 4096]
        start, run = _start_run(some)
        n = run + 1
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        offset = np.repeat(some & ((1 << RUN_BITS) - 1), n) - within
        arm = offset // -(-(span - SEED + 1) // ARMS)
        yield (np.repeat(start, n) + within)[np.repeat(bits, n) >> arm & 1 > 0]


def _fingerprints(span: int):
    """For each window in doubt: two hashes and its place; for equal ones of some blocks the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            held: list[list[np.ndarray]] = []
            n = 0
            for row in range(batch.num_rows):
                data = np.frombuffer(texts[row].as_buffer(), np.uint8)
                for at in _windows(_spread(batch.column(2), row), _spread(batch.column(3), row), span):
                    cuts = [0, *(np.flatnonzero(np.diff(at) > 4096) + 1).tolist(), len(at)]
                    for some in (at[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)):
                        if not len(some):
                            continue
                        low = int(some[0])
                        h = _rolled(data[low : int(some[-1]) + span])
                        a = _span_hash(h, some - low, span)
                        b = _mix(_span_hash(h, some - low, span - 33) * _POW[8] + _span_hash(h, some - low + span - 33, 33))
                        _, first = np.unique(a, return_index=True)
                        held.append([a[first], b[first], np.full(len(first), ids[row]), some[first]])
                        n += len(first)
                    if n > FLUSH:
                        yield from _rows(WINDOW, [np.concatenate(x) for x in zip(*held, strict=True)])
                        held.clear()
                        n = 0
            if held:
                yield from _rows(WINDOW, [np.concatenate(x) for x in zip(*held, strict=True)])

    return run


WINDOW = "wa long, wb long, did long, at long"


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals, as maximal ones in order."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(low[1:] > reach[:-1]) + 1
    return low[np.concatenate([[0], new])], reach[np.concatenate([new - 1, [len(low) - 1]])]


def removed(repeats: np.ndarray, doubtful: Iterator[np.ndarray], firsts: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes to remove: from, to."""
    start, run = _start_run(repeats)
    parts, firsts = [_merged(start, start + run + span)], np.sort(firsts)
    for at in doubtful:
        if len(firsts):
            at = at[firsts[np.minimum(np.searchsorted(firsts, at), len(firsts) - 1)] != at]
        parts.append(_merged(at, at + span))
    return _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _kept(raw: memoryview, low: np.ndarray, high: np.ndarray) -> Iterator[memoryview]:
    at = 0
    for i, j in zip(low.tolist(), high.tolist(), strict=True):
        yield raw[at:i]
        at = j
    yield raw[at:]


def _digest(raw: memoryview, low: np.ndarray, high: np.ndarray) -> tuple:
    sha = hashlib.sha256()
    for part in _kept(raw, low, high):
        sha.update(part)
    return len(raw), int((high - low).sum()), len(low), sha.hexdigest()


def _rest(raw: memoryview, low: np.ndarray, high: np.ndarray) -> tuple:
    # a character that loses a byte goes whole
    return (b"".join(_kept(raw, low, high)).decode("utf-8", "ignore"),)


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_TYPES = {"long": pa.int64(), "string": pa.string()}


def _settle(finish, kind: str, keep: list[str], span: int, last: bool):
    """Finishes texts; those with windows in doubt only at the ``last`` stage. Passes ``keep`` on."""
    fields = [x.split() for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, wait = [], []
            texts, repeats, doubtful, arms, firsts = (batch.column(x) for x in ("text", "repeats", "doubtful", "arms", "firsts"))
            for row in range(batch.num_rows):
                locs = _spread(doubtful, row)
                wait.append(bool(len(locs)) and not last)
                if wait[-1]:
                    out.append((None,) * len(fields))
                    continue
                raw = memoryview(texts[row].as_buffer())
                out.append(finish(raw, *removed(_spread(repeats, row), _windows(locs, _spread(arms, row), span), _spread(firsts, row), span)))
            done = [pa.array(x, _TYPES[t]) for x, (_, t) in zip(zip(*out, strict=True) if out else [[]] * len(fields), fields, strict=True)]
            kept = [batch.column(c) for c in keep]
            if last:
                yield pa.RecordBatch.from_arrays([*kept, *done], names=[*keep, *(f for f, _ in fields)])
                continue
            hide = pa.array([not x for x in wait], pa.bool_())
            rest = [pa.compute.if_else(hide, pa.scalar(None, c.type), c) for c in (texts, repeats, doubtful, arms)]
            yield pa.RecordBatch.from_arrays([*kept, *done, batch.column("did"), *rest], names=[*keep, *(f for f, _ in fields), "did", "text", "repeats", "doubtful", "arms"])

    return run


def dedup(docs: DataFrame, finish, kind: str, keep: list[str], doc_id: str = "doc_id", text: str = "text", span: int = SPAN, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row for each document: the columns ``keep`` and what ``finish`` makes of its bytes.

    ``finish(bytes, from, to)`` gets the removed runs and returns the columns
    that ``kind`` names. ``span`` may be 64 to 150 bytes.
    """
    if not LEAST_SPAN <= span <= MOST_SPAN:
        raise ValueError(f"span must be {LEAST_SPAN} to {MOST_SPAN}")
    spark = docs.sparkSession
    own = [f"keep{i}" for i in range(len(keep))]
    kept = ", ".join(f"{o} {docs.schema[c].dataType.simpleString()}" for o, c in zip(own, keep, strict=True))
    the_id = F.col(doc_id).cast("long")
    docs = docs.select(the_id.isNull().alias("none"), F.coalesce(the_id, F.lit(NULL_ID)).alias("did"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(c).alias(o) for o, c in zip(own, keep, strict=True)))
    docs, size, done = named(docs)
    part_bytes = max(part_bytes, size // MOST_PARTS)
    bits = math.ceil(math.log2(max(1, part_bytes / SLICE_BYTES)))
    parts = max(spark.sparkContext.defaultParallelism, -(-size // part_bytes))
    entries = docs.select("did", "text").mapInArrow(_sample(span), ENTRY)
    dealt = entries.repartition(parts, "kh").sortWithinPartitions(F.shiftrightunsigned("kh", 64 - bits) if bits else F.lit(0))
    flags = dealt.mapInArrow(_index(bits), FLAG)
    by_doc = flags.groupBy("did").agg(
        F.collect_list(F.when(F.col("arms") == 0, F.col("loc"))).alias("repeats"), F.collect_list(F.when(F.col("arms") > 0, F.struct("loc", "arms"))).alias("open")
    )
    by_doc = materialize(by_doc.select("did", "repeats", F.col("open.loc").alias("doubtful"), F.col("open.arms").alias("arms")), "repeats")
    release(spark)
    none = F.lit(None).cast("array<long>")
    joined = docs.join(by_doc, "did", "left").withColumn("firsts", none)
    later = "did long, text string, repeats array<long>, doubtful array<long>, arms array<long>"
    settled = materialize(joined.mapInArrow(_settle(finish, kind, own, span, False), f"{kept}, {kind}, {later}"), "settled")
    for table in (by_doc, *done):
        discard(table)
    release(spark)
    waiting = settled.where("text is not null").select(*own, "did", "text", "repeats", "doubtful", "arms")
    windows = waiting.select("did", "text", "doubtful", "arms").mapInArrow(_fingerprints(span), WINDOW)
    first = windows.groupBy("wa", "wb").agg(F.min(F.struct("did", "at")).alias("first")).select("first.*")
    firsts = first.groupBy("did").agg(F.collect_list("at").alias("firsts"))
    rest = waiting.join(firsts, "did", "left").mapInArrow(_settle(finish, kind, own, span, True), f"{kept}, {kind}")
    every = settled.where("text is null").select(*rest.columns).unionByName(rest)
    return every.withColumnsRenamed(dict(zip(own, keep, strict=True)))


def digests(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Per document: its bytes, how many go in how many runs, and the SHA-256 of the rest."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dedup(docs, _digest, DIGEST, ["doc_id"], span=span)


def without_repeats(docs: DataFrame, keep: list[str], span: int = SPAN) -> DataFrame:
    """The columns ``keep``, and ``kept_text`` with repeated bytes removed; characters cut in two go whole."""
    return dedup(docs, _rest, "kept_text string", keep, span=span)
