"""Packing token sequences: Martello-Toth dominance reduction, then best fit.

1. Texts are tokenised (pieces between white space are encoded once per worker and
   remembered, within bounds); a document's ids and the end id are cut into pieces of at most
   ``capacity`` ids. A piece is its place, length, checksum and ids,
   with its rank among its task's pieces of that length.
2. Only lengths matter for packing, and there are at most ``capacity`` of them.
   The driver gets the counts by length, never the pieces. On the counts,
   ``reduce_dominated`` fixes sets that provably belong to some optimal packing,
   of up to three pieces: a piece that nothing fits beside; a piece and its exact
   complement; a piece beside which at most two others fit, with the one or two that
   can stand for all others that might. ``best_fit``
   packs what is left, longest first, into the fullest sequences that have room,
   all bins of one filling at a time. The result is a list of patterns with
   multiplicities, whose length depends on ``capacity``, not on the documents.
3. The rank of a piece among all of its length (prefix sums over tasks) says
   which copy of which pattern holds it, at which offset. The ids go along.

Defined results: a null or empty text has the end id alone; equal rows are packed
each; a null id is carried; other columns, whatever their names, take no part; pieces
of equal length trade places freely, so which of them shares a sequence with which may
differ between runs, but not how many sequences there are; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peneira.llm.common import materialize, utf8

CAPACITY = 2048
END_ID = 0
#: Pieces that a worker remembers, twice over: about 80 MB.
REMEMBERED = 200_000
#: Pieces in a batch that has ids: 8 MB at the usual capacity.
PART = 1024

Pattern = tuple[tuple[int, int], ...]


class _Known:
    """A bounded memory in two generations."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.new, self.old = most, {}, {}

    def recall(self, keys: set) -> dict:
        """Those of the keys that the older generation has; they are kept on."""
        old = self.old
        found = {k: old[k] for k in keys if k in old} if old else {}
        self.new.update(found)
        return found

    def age(self) -> None:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}


class _Encoder:
    """The ids of texts, as bytes, put together from those of pieces between white space.

    A mark at the end of a letter run is a piece of the tokenizer's own, so it is cut
    off first; and since the tokenizer lower-cases, so is the text. New letter runs are
    encoded many at a time; ids that end a piece tell them apart. Whatever is not so
    plain is encoded as it stands, and so is a text that may hold a special token.
    """

    _MARKS = '.,;:!?*#$%&|()"-'
    _END = re.compile(rb"[.,!?;:](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))(?=[ \t\n\x0b\x0c\r]|\Z)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        # the same model for lower-case letter runs, which need no other preparation
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words, self.tails = _Known(), {}

    def _encode(self, texts: list[str], bare: bool = False) -> list[list[int]]:
        return [e.ids for e in (self.bare if bare else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, runs: list[str]) -> Iterator[bytes]:
        """The ids of each lower-case letter run."""
        groups = [runs[i : i + 64] for i in range(0, len(runs), 64)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups], bare=True), strict=True):
            flat = np.array(ids, "<u4")
            cuts = (np.flatnonzero(self.ends[flat]) + 1).tolist() if len(flat) else []
            if len(cuts) == len(group):
                raw, i = flat.tobytes(), 0
                for j in cuts:
                    yield raw[4 * i : 4 * j]
                    i = j
            else:
                yield from (np.array(x, "<u4").tobytes() for x in self._encode(group))

    def _learn(self, fresh: set[bytes]) -> dict[bytes, bytes]:
        known = self.words.recall(fresh)
        plain, marked, other, marks = {}, [], [], self._MARKS
        for w in fresh.difference(known) if known else fresh:
            s = w.decode().lower()
            run = s.rstrip(marks)
            if run.isalpha() and (run.isascii() or max(run) <= "\u00ff"):
                if len(run) == len(s):
                    plain[w] = s
                else:
                    marked.append((w, run, s[len(run) :]))
            else:
                # lower-casing in context (a final sigma) is not the tokenizer's
                other.append((w, w.decode()))
        runs = {run for _, run, _ in marked}.difference(plain.values())
        every = [*plain.values(), *runs]
        ids = dict(zip(every, self._letters(every), strict=True))
        met = {w: ids[s] for w, s in plain.items()}
        met.update((run.encode(), ids[run]) for run in runs)
        for w, run, tail in marked:
            if tail not in self.tails:
                self.tails[tail] = np.array(self._encode([tail])[0], "<u4").tobytes()
            met[w] = ids[run] + self.tails[tail]
        for (w, _), x in zip(other, self._encode([s for _, s in other]), strict=True):
            met[w] = np.array(x, "<u4").tobytes()
        if len(self.tails) > REMEMBERED:
            self.tails.clear()
        self.words.new.update(met)
        return known | met if known else met

    def _parts(self, text: bytes) -> list[bytes]:
        return self._END.sub(rb" \g<0>", text.lower()).split()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        self.words.age()
        get, fresh, found = self.words.new.get, set(), []
        for text in texts:
            if b"<|" in text:
                found.append((text, None, None))
                continue
            words = self._parts(text)
            values = list(map(get, words))
            holes = [i for i, v in enumerate(values) if v is None] if None in values else []
            fresh.update([words[i] for i in holes])
            found.append((words, values, holes))
        learned = self._learn(fresh)
        for words, values, holes in found:
            if values is None:
                yield np.array(self.tokenizer.encode(words.decode(), add_special_tokens=False).ids, "<u4").tobytes()
                continue
            for i in holes:
                values[i] = learned[words[i]]
            yield b"".join(values)


_WORKER: dict[str, _Encoder] = {}


def ids_of(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text, without special tokens added.

    The tokenizer drops white space and never joins across it, so pieces between
    ASCII white space are encoded apart.
    """
    encoder = _WORKER.get(path)
    if encoder is None:
        encoder = _WORKER[path] = _Encoder(path)
    for low in range(0, len(texts), 512):
        yield from encoder.encode(texts[low : low + 512])


def _lists(parts: list[bytes], ends: np.ndarray, low: int, high: int) -> pa.Array:
    """The ids of the pieces from ``low`` to ``high`` as lists."""
    flat = np.frombuffer(b"".join(parts[low:high]), "<i4")
    return pa.ListArray.from_arrays(pa.array((ends[low : high + 1] - ends[low]).astype(np.int32), pa.int32()), pa.array(flat, pa.int32()))


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            texts, out, parts = utf8(batch.column(1)), [], []
            raw = [texts[row].as_buffer().to_pybytes() for row in range(batch.num_rows)]
            for row, ids in enumerate(ids_of(raw, path)):
                ids += end
                for piece in range(-(-len(ids) // (4 * capacity))):
                    part = ids[4 * capacity * piece : 4 * capacity * (piece + 1)]
                    n = len(part) // 4
                    out.append((row, piece, piece * capacity, n, zlib.crc32(part), seen[n]))
                    parts.append(part)
                    seen[n] += 1
            row, piece, start, n, crc, rank = (np.array(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 6
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = [_lists(parts, ends, i, min(i + PART, len(row))) for i in range(0, len(row), PART)] or [_lists([], ends, 0, 0)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, n, crc, np.full(len(row), bucket), rank))]
            for i, some in enumerate(ids):
                yield pa.RecordBatch.from_arrays([*(c.slice(i * PART, len(some)) for c in columns), some], names=["doc_id", "piece", "start", "length", "ids_crc32", "bucket", "rank", "ids"])

    return run


def reduce_dominated(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Takes out of ``counts`` (by length) sets that dominate all others with their item; gives them with multiplicities.

    A set dominates if whatever else may share a sequence with item j can trade places
    with the set's other items: k alone if no set that fits beside j is larger than k;
    k and b if no three items fit beside j, k is the largest that does, and b is at least
    the smaller one of any two that do.
    """
    fixed: list[tuple[Pattern, int]] = []

    def fix(*lengths: int) -> None:
        each = [(x, lengths.count(x)) for x in dict.fromkeys(lengths)]
        n = min(counts[x] // m for x, m in each)
        for x, m in each:
            counts[x] -= n * m
        fixed.append((tuple(each), n))

    changed = True
    while changed:
        changed, low = False, 1
        for j in range(capacity, 0, -1):
            while counts[j]:
                while low < capacity and not counts[low]:
                    low += 1
                found = _dominating(counts, j, capacity - j, low)
                if found is None:
                    break
                fix(j, *found)
                changed = True
    return fixed


def _dominating(counts: list[int], j: int, room: int, low: int) -> tuple[int, ...] | None:
    """What to put beside an item of length ``j``; None if nothing is known to be best. No item is under ``low``."""

    def has(x: int, *gone: int) -> bool:
        return counts[x] > (x == j) + gone.count(x)

    least: list[int] = []
    x = low
    while len(least) < 3 and x <= room:
        least += [x] * min(3 - len(least), max(counts[x] - (x == j), 0))
        x += 1
    if not least:
        return ()
    if has(room):
        return (room,)
    if len(least) < 2 or least[0] + least[1] > room:
        return (next(x for x in range(room, 0, -1) if has(x)),)
    if len(least) == 3 and sum(least) <= room:
        return None
    k = next(x for x in range(room, 0, -1) if has(x))
    # the best pair, and the largest smaller one of a pair
    best = smaller = 0
    for t in range(low, room // 2 + 1):
        if has(t):
            s = next((s for s in range(room - t, t - 1, -1) if has(s, t)), None)
            if s is not None:
                best, smaller = max(best, s + t), t
    if k >= best:
        return (k,)
    b = next((b for b in range(min(k, room - k), 0, -1) if has(b, k)), 0)
    return (k, b) if b and b >= smaller else None


def best_fit(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, of the items in ``counts``; bins of one filling are handled together."""
    open_: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        left, room = counts[length], length
        while left:
            while room <= capacity and not open_[room]:
                room += 1
            pattern, bins = open_[room].pop() if room <= capacity else ((), left)
            space = room if room <= capacity else capacity
            each = space // length
            full = min(bins, left // each)
            if full:
                open_[space - each * length].append(((*pattern, (length, each)), full))
                left -= full * each
            rest = bins - full
            if rest and left and left < each:
                open_[space - left * length].append(((*pattern, (length, left)), 1))
                left, rest = 0, rest - 1
            if rest and pattern:
                open_[space].append((pattern, rest))
    return [x for y in open_ for x in y]


def plan(counts: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows ``length, first rank, first sequence, items in a sequence, first offset``, in order."""
    counts = list(counts)
    patterns = reduce_dominated(counts, capacity) + best_fit(counts, capacity)
    used, rows, sequence = [0] * (capacity + 1), [], 0
    for pattern, n in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((length, used[length], sequence, each, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(rows: np.ndarray):
    key = rows[:, 0] << 48 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = rows[np.searchsorted(key, length << 48 | rank, "right") - 1] if len(rank) else rows[:0]
            i = rank - at[:, 1]
            each = np.maximum(at[:, 3], 1)
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(at[:, 2] + i // each, pa.int64()), pa.array(at[:, 4] + i % each * length, pa.int64()), batch.column("ids")], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    return run


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and ids."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(texts.mapInArrow(_pieces(tokenizer, capacity, end_id), f"{PIECE}, bucket long, rank long, ids array<int>"), "pieces")
    counts = materialize(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    by_length = [0] * (capacity + 1)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        by_length[row.length] = row.n
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(first, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids").mapInArrow(_place(plan(by_length, capacity)), f"{PIECE}, sequence_id long, offset long, ids array<int>")
