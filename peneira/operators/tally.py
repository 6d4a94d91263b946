"""How often, in how many ways and where first terms of a table stand in each text, for tables of terms as large as the texts.

``terms.find`` makes a row of each occurrence, and with an index too large to send, a row of each word with
its neighbours. Here a task tells each part of the windows (as many words one after the other as some term
has) which different ones its texts hold and, for each, what texts hold it, how often and where first; the
terms of the same words come to the same part. So a window's words go out once for a task's slice of
texts, in order and compressed, and an occurrence is a few bytes. The parts send back sums by text.

Windows are compared as whole strings. Hashes only choose their part and leave out most windows that are no
term's: a bitmap for each length, of at most ``MOST_BITS``, is made in pieces and sent to all tasks. Beyond some
100 million terms it lets most windows through, so that more is shuffled; results stay the same.

Null and wordless texts hold nothing, null and wordless terms are nowhere; terms of the same words all count.
A text stands whole in a task. Rows of one key count as one text whose windows don't cross rows.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.functions import normalize as N
from peneira.operators.terms import words

#: Words of texts that a task looks at together, and terms.
SLICE, TERMS_SLICE = 1_500_000, 2_000_000
#: Different terms of a length up to which they are sent to all tasks, so that their windows aren't shuffled.
FEW = 1_000_000
#: Bytes of texts for each part of the windows.
PART_BYTES = 16 << 20
#: The logarithm of the bits of a length's map, and of those of a piece of it.
MOST_BITS, PIECE_BITS = 28, 22

_FOLD = str.maketrans(N._ACCENTED + "".join(N._LONG), N._PLAIN + N._SHORT)
_ROW = "part int, chunk long, kind string, a binary, b binary"
_IPC = pa.ipc.IpcWriteOptions(compression="zstd")


def fold(word: str) -> str:
    """``normalize.fold`` of a string."""
    return (word if word.isascii() else word.translate(_FOLD)).upper()


class Letters:
    """What Spark takes for parts of words, in expressions of Python, whose Unicode may be another."""

    def __init__(self, spark: SparkSession) -> None:
        code = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        known = spark.range(0x110000).where("id not between 55296 and 57343").where(F.size(words(code)) > 0)
        theirs, usual = {r.id for r in known.collect()}, re.compile(r"[^\W_]")
        mine = {i for i in range(0x110000) if usual.match(chr(i))}
        self.more, self.less = (_ranges(sorted(x)) for x in (theirs - mine, mine - theirs))
        self.strange = frozenset(map(chr, mine - theirs))

    def expressions(self) -> tuple[re.Pattern, re.Pattern, frozenset[str]]:
        """Words of usual texts, words of any text, and letters that a text isn't usual with."""
        more = f"|[{self.more}]+" if self.more else ""
        return re.compile(rf"(?:[^\W_]+{more})+"), re.compile(rf"(?:[^\W_{self.less}]+{more})+"), self.strange


def _ranges(codes: list[int]) -> str:
    """Code points as the inside of a character class."""
    out = []
    for _, run in itertools.groupby(enumerate(codes), lambda x: x[1] - x[0]):
        run = [c for _, c in run]
        out.append(f"{re.escape(chr(run[0]))}-{re.escape(chr(run[-1]))}")
    return "".join(out)


def _packed(columns: dict) -> bytes:
    batch = pa.record_batch(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_IPC) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _least(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them."""
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values.astype(np.uint8)


class _Slice:
    """Words of texts as numbers of a sorted vocabulary, text after text."""

    def __init__(self, expressions: tuple) -> None:
        self.usual, self.any, self.strange = expressions
        self.texts: list[str] = []
        self.numbers: dict[str, int] = defaultdict(itertools.count().__next__)
        self.raw: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.words = 0

    def _numbered(self, text: str, word: re.Pattern) -> np.ndarray:
        found = word.findall(text) if len(text) < 1 << 22 else (m[0] for m in word.finditer(text))
        return np.fromiter(map(self.numbers.__getitem__, found), np.int32)

    def add(self, text: str) -> None:
        self.texts.append(text)
        self.raw.append(self._numbered(text, self.usual))
        self.lengths.append(len(self.raw[-1]))
        self.words += self.lengths[-1]

    def add_short(self, texts: pa.Array) -> None:
        """The same for many short texts: they are laid end to end, with a mark that is no part of a word between."""
        for word in (self.usual, self.any):
            self.raw, self.lengths, self.numbers = [], [], defaultdict(itertools.count().__next__)
            marked = re.compile(f"{word.pattern}|\\x00")
            for i in range(0, len(texts), 50_000):
                ids = self._numbered("".join(t.replace("\0", " ") + "\0" for t in texts.slice(i, 50_000).to_pylist()), marked)
                ends = ids == self.numbers["\0"]
                self.raw.append(ids[~ends])
                self.lengths += (np.diff(np.flatnonzero(ends), prepend=-1) - 1).tolist()
            if not self._unusual():
                break

    def _unusual(self) -> bool:
        return not self.strange.isdisjoint(set("".join(self.numbers)))

    def close(self) -> None:
        import xxhash

        if self.texts and self._unusual():
            self.numbers = defaultdict(itertools.count().__next__)
            self.raw = [self._numbered(t, self.any) for t in self.texts]
            self.lengths = [len(x) for x in self.raw]
        self.texts = []
        folded = [fold(w) for w in self.numbers]
        vocabulary = sorted(set(folded))
        place = {w: i for i, w in enumerate(vocabulary)}
        self.ids = np.array([place[w] for w in folded], np.int64)[np.concatenate([np.zeros(0, np.int32), *self.raw])]
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)
        self.vocabulary = pa.array(vocabulary, pa.string())
        self.lengths = np.array(self.lengths, np.int64)
        self.raw, self.numbers = [], {}

    def hash(self, starts: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for j in range(n):
            out = (out + self.hashes[self.ids[starts + j]]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def key(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Numbers that are equal where the windows are, in the order of their words while those fit."""
        size = max(1, len(self.vocabulary))
        out, most = self.ids[starts], size
        for j in range(1, n):
            if most * size >= 1 << 62:
                _, out = np.unique(out, return_inverse=True)
                most = len(starts)
            out, most = out * size + self.ids[starts + j], most * size
        return out

    def strings(self, starts: np.ndarray, n: int) -> pa.Array:
        each = [self.vocabulary.take(pa.array(self.ids[starts + j])) for j in range(n)]
        return pc.binary_join_element_wise(*each, " ") if n > 1 else each[0]


def _by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by part that keeps the given one inside, and where each part begins in it."""
    small = part.astype(np.uint16 if parts <= 1 << 16 else np.int64)
    return np.argsort(small, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


def _steps(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Of rising values in runs of these lengths: the first of each run, and steps from there."""
    out, starts = np.diff(values, prepend=0), np.cumsum(runs) - runs
    out[starts] = values[starts]
    return out


def _walked(steps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The values of ``_steps``."""
    total, starts = np.cumsum(steps), np.cumsum(runs) - runs
    return total - np.repeat(total[starts] - steps[starts], runs)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Rows at which some column is another than in the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _terms_out(parts: int, letters: Letters):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch.column(0))
                n += batch.num_rows
            if n >= TERMS_SLICE or (batch is None and n):
                yield from one(pa.chunked_array(held).unique())
                held, n = [], 0

    def one(listed: pa.Array) -> Iterator[pa.RecordBatch]:
        s = _Slice(letters.expressions())
        s.add_short(listed)
        s.close()
        at = np.cumsum(s.lengths) - s.lengths
        for n in np.unique(s.lengths[s.lengths > 0]).tolist():
            mine = np.flatnonzero(s.lengths == n)
            mine = mine[np.argsort(s.key(at[mine], n), kind="stable")]
            hashed = s.hash(at[mine], n)
            order, ends = _by_part((hashed % np.uint64(parts)).astype(np.int64), parts)
            mine, hashed = mine[order], hashed[order]
            norm, term = s.strings(at[mine], n), listed.take(pa.array(mine))
            # a term of the usual form needs no second string; no term is the empty one
            term = pc.if_else(pc.equal(term, pc.utf8_lower(norm)), "", term)
            out = []
            for p in np.flatnonzero(np.diff(ends)).tolist():
                low, high = int(ends[p]), int(ends[p + 1])
                out.append((p, None, n, high - low, _packed({"norm": norm.slice(low, high - low), "term": term.slice(low, high - low)})))
            bits = np.sort((hashed >> np.uint64(64 - MOST_BITS)).astype(np.int64))
            bits = bits[_changes(bits)]
            cuts = np.searchsorted(bits, np.arange((1 << (MOST_BITS - PIECE_BITS)) + 1) << PIECE_BITS)
            for piece in np.flatnonzero(np.diff(cuts)).tolist():
                here = bits[cuts[piece] : cuts[piece + 1]]
                out.append((None, piece, n, 0, _packed({"bits": _least(np.diff(here, prepend=piece << PIECE_BITS))})))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "piece", "n", "terms", "a"])

    return rows


def _texts_out(parts: int, maps: dict[int, tuple[int, dict[int, bytes]]], few: dict[int, list[bytes]], n_key: int, letters: Letters):
    opened: dict[int, np.ndarray] = {}
    listed: dict[int, pa.Table] = {}

    def ways_of(windows: pa.Array, n: int) -> np.ndarray:
        """How many terms have the words of each window, for a length whose terms are here."""
        if n not in listed:
            listed[n] = pa.concat_tables(map(_unpacked, few[n])).combine_chunks()
        found = pc.index_in(windows, value_set=listed[n]["norm"].combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.where(found >= 0, listed[n]["ways"].to_numpy()[found], 0)

    def among(hashed: np.ndarray, n: int) -> np.ndarray:
        """Places of what a map has."""
        fewer, pieces = maps[n]
        if n not in opened:
            size = 1 << (PIECE_BITS - fewer - 3)
            opened[n] = np.zeros(size << (MOST_BITS - PIECE_BITS), np.uint8)
            for i, piece in pieces.items():
                opened[n][i * size : (i + 1) * size] = np.frombuffer(pa.decompress(piece, size, "zstd"), np.uint8)
        bit = hashed >> np.uint64(64 - MOST_BITS + fewer)
        return np.flatnonzero((opened[n][bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        expressions = letters.expressions()
        s, keys, owners, n = _Slice(expressions), [], [], 0
        for batch in batches:
            first = 0
            for i, texts in enumerate(batch.column(n_key).to_pylist()):
                for t in texts or ():
                    if t is not None:
                        s.add(t)
                        owners.append(n)
                n += 1
                if s.words >= SLICE or n == 65_535:
                    keys.append(batch.slice(first, i + 1 - first))
                    yield from one(s, keys, owners, next(number))
                    s, keys, owners, n, first = _Slice(expressions), [], [], 0, i + 1
            keys.append(batch.slice(first))
        if n:
            yield from one(s, keys, owners, next(number))

    def one(s: _Slice, keys: list[pa.RecordBatch], owners: list[int], chunk: int) -> Iterator[pa.RecordBatch]:
        s.close()
        begin = np.cumsum(s.lengths) - s.lengths
        owner = np.repeat(np.array(owners, np.int32), s.lengths)
        pos = np.arange(len(s.ids)) - np.repeat(begin, s.lengths)
        left = np.repeat(s.lengths, s.lengths) - pos
        told, sums = [], []
        for n in sorted(maps):
            starts = np.flatnonzero(left >= n)
            hashed = s.hash(starts, n)
            kept = among(hashed, n)
            starts, hashed = starts[kept], hashed[kept]
            if not len(starts):
                continue
            key = s.key(starts, n)
            order = np.argsort(key, kind="stable")
            key, starts, hashed = key[order], starts[order], hashed[order]
            text, at = owner[starts], pos[starts]
            pair = _changes(key, text)
            first = np.minimum.reduceat(at, pair)
            times = np.diff(pair, append=len(key))
            window = _changes(key[pair])
            each = np.diff(window, append=len(pair))
            shown = pair[window]
            if n in few:
                ways = np.repeat(ways_of(s.strings(starts[shown], n), n), each)
                hit = np.flatnonzero(ways)
                sums.append((text[pair][hit].astype(np.int64), times[hit] * ways[hit], ways[hit], first[hit]))
                continue
            told.append((hashed[shown] % np.uint64(parts), s.strings(starts[shown], n), each, text[pair], times, first))
        out = []
        if told:
            part, each, text, times, first = (np.concatenate([t[i] for t in told]) for i in (0, 2, 3, 4, 5))
            part = part.astype(np.int64)
            norm = pa.concat_arrays([t[1] for t in told])
            order, ends = _by_part(part, parts)
            pairs, pair_ends = _by_part(np.repeat(part, each), parts)
            norm, each, text, times, first = norm.take(pa.array(order)), each[order], text[pairs], times[pairs], first[pairs]
            for p in np.flatnonzero(np.diff(ends)).tolist():
                # a window's texts are in order, so all but the first are told by how far they are from the one before
                a, b = slice(int(ends[p]), int(ends[p + 1])), slice(int(pair_ends[p]), int(pair_ends[p + 1]))
                out.append((p, chunk, "w", _packed({"norm": norm.slice(a.start, a.stop - a.start), "each": _least(each[a])}), _packed({"text": _least(_steps(text[b], each[a])), "times": _least(times[b]), "first": _least(first[b])})))
        if told or sums:
            whole = pa.Table.from_batches(keys).select(range(n_key)).combine_chunks()
            out.append((chunk % parts, chunk, "k", _packed({c: whole[c].combine_chunks() for c in whole.column_names}), _packed_sums(*_sums(*(np.concatenate(c) for c in zip(*sums, strict=True)))) if sums else None))
        for row in out:
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["part", "chunk", "kind", "a", "b"])

    return rows


def _sums(texts: np.ndarray, times: np.ndarray, ways: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """By text: its number, the sums of times and ways, and the least of first."""
    order = np.argsort(texts, kind="stable")
    texts = texts[order]
    at = _changes(texts)
    if not len(at):
        return texts, texts, texts, texts
    return texts[at], np.add.reduceat(times[order], at), np.add.reduceat(ways[order], at), np.minimum.reduceat(first[order], at)


def _packed_sums(text: np.ndarray, times: np.ndarray, ways: np.ndarray, first: np.ndarray) -> bytes:
    return _packed({"text": _least(text), "times": _least(times), "ways": _least(ways), "first": _least(first)})


def _ways(blobs: list[bytes]) -> pa.Table:
    """norm, ways: how many different terms have these words."""
    different = pa.concat_tables([_unpacked(b) for b in blobs]).group_by(["norm", "term"]).aggregate([])
    return different.group_by("norm").aggregate([("term", "count")]).rename_columns(["norm", "ways"]).combine_chunks()


def _listed(group: pa.Table) -> pa.Table:
    ways = _ways(group["a"].to_pylist())
    blob = _packed({c: ways[c].combine_chunks() for c in ("norm", "ways")})
    return pa.table([group["n"].slice(0, 1).combine_chunks(), pa.array([ways.num_rows], pa.int64()), pa.array([blob], pa.binary())], names=["n", "size", "a"])


def _match(group: pa.Table) -> pa.Table:
    """A part: its terms, and the windows of each slice."""
    rows = group.select(["chunk", "kind", "a", "b"]).to_pylist()
    out = [(r["chunk"], r["a"], r["b"]) for r in rows if r["kind"] == "k"]
    listed, said = [r["a"] for r in rows if r["kind"] == "t"], [r for r in rows if r["kind"] == "w"]
    if listed and said:
        ways = _ways(listed)
        names, count = ways["norm"].combine_chunks(), ways["ways"].to_numpy()
        held = [_unpacked(r["a"]) for r in said]
        found = pc.index_in(pa.chunked_array([c for t in held for c in t["norm"].chunks], pa.string()), value_set=names)
        found = found.fill_null(-1).to_numpy()
        at = 0
        for r, t in zip(said, held, strict=True):
            mine = found[at : at + t.num_rows]
            at += t.num_rows
            each = t["each"].to_numpy().astype(np.int64)
            ways_each = np.repeat(np.where(mine >= 0, count[mine], 0), each)
            hit = np.flatnonzero(ways_each)
            if len(hit):
                b = _unpacked(r["b"])
                text = _walked(b["text"].to_numpy().astype(np.int64), each)[hit]
                times, first = (b[c].to_numpy()[hit].astype(np.int64) for c in ("times", "first"))
                out.append((r["chunk"], None, _packed_sums(*_sums(text, times * ways_each[hit], ways_each[hit], first))))
    return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "keys", "sums"])


def _add_up(key: list[str]):
    def rows(group: pa.Table) -> pa.Table:
        keys = _unpacked(next(k for k in group["keys"].to_pylist() if k is not None))
        parts = [_unpacked(b) for b in group["sums"].to_pylist() if b is not None]
        columns = [np.concatenate([np.zeros(0, np.int64), *(p[c].to_numpy().astype(np.int64) for p in parts)]) for c in ("text", "times", "ways", "first")]
        text, times, ways, first = _sums(*columns)
        return pa.table([*(keys[c].take(pa.array(text)) for c in key), pa.array(times), pa.array(ways), pa.array(first)], names=[*key, "ocorrencias", "termos", "primeira"])

    return rows


def _piece(group: pa.Table) -> pa.Table:
    """A piece of a length's map."""
    n, piece, fewer = (group[c][0].as_py() for c in ("n", "piece", "fewer"))
    held = np.zeros(1 << (PIECE_BITS - fewer), bool)
    for blob in group["a"].to_pylist():
        held[np.cumsum(_unpacked(blob)["bits"].to_numpy().astype(np.int64)) >> fewer] = True
    blob = pa.compress(np.packbits(held, bitorder="little").tobytes(), "zstd", asbytes=True)
    return pa.table([pa.array([n], pa.int32()), pa.array([piece], pa.int32()), pa.array([fewer], pa.int32()), pa.array([blob], pa.binary())], names=["n", "piece", "fewer", "a"])


def tally(texts: DataFrame, terms: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text", term: str = "termo") -> DataFrame:
    """For each key with an occurrence: ``ocorrencias``, ``termos`` (different ones), ``primeira`` (the least place of a first word)."""
    key = list(key)
    spark = texts.sparkSession
    held = texts.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes"))
    most, size = held.agg(F.max("n"), F.sum("bytes")).first()
    parts = max(12, (size or 0) // PART_BYTES + 1)

    letters = Letters(spark)

    out = terms.select(F.col(term).alias("termo")).where(F.col(term).isNotNull()).mapInArrow(_terms_out(parts, letters), "part int, piece int, n int, terms long, a binary")
    if spark.conf.get("spark.checkpoint.dir", None):
        out = out.checkpoint()
    listed, bits = out.where("part is not null"), out.where("piece is not null")
    # some 16 bits for a term, if that many there are
    held_terms = {r.n: r.terms for r in listed.groupBy("n").agg(F.sum("terms").alias("terms")).collect()}
    fewer = {n: max(0, min(PIECE_BITS - 3, MOST_BITS - 4 - x.bit_length())) for n, x in held_terms.items()}
    maps: dict[int, tuple[int, dict[int, bytes]]] = {n: (f, {}) for n, f in fewer.items()}
    if fewer:
        smaller = F.create_map(*(F.lit(x) for pair in fewer.items() for x in pair))
        made = bits.select("n", "piece", smaller[F.col("n")].alias("fewer"), "a").groupBy("n", "piece").applyInArrow(_piece, "n int, piece int, fewer int, a binary")
        for r in made.collect():
            maps[r.n][1][r.piece] = r.a

    likely = [n for n, terms_of in held_terms.items() if terms_of <= 4 * FEW]
    short = listed.where(F.col("n").isin(likely)).select("n", "part", "a").groupBy("n", "part").applyInArrow(_listed, "n int, size long, a binary")
    small = [r.n for r in short.groupBy("n").agg(F.sum("size").alias("size")).collect() if r["size"] <= FEW] if likely else []
    few: dict[int, list[bytes]] = {n: [] for n in small}
    for r in short.where(F.col("n").isin(small)).collect() if small else ():
        few[r.n].append(r.a)

    one = texts.select(*key, F.array(text).alias("_texts"))
    if most and most > 1:
        again = F.broadcast(held.where("n > 1").select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(key))))
        same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(key)]
        twice = texts.join(again, same, "left_semi").groupBy(*key).agg(F.collect_list(text).alias("_texts"))
        one = one.join(again, same, "left_anti").unionByName(twice)
    told = one.mapInArrow(_texts_out(parts, maps, few, len(key), letters), _ROW)
    named = listed.where(~F.col("n").isin(small)).select("part", F.lit(None).cast("long").alias("chunk"), F.lit("t").alias("kind"), "a", F.lit(None).cast("binary").alias("b"))
    matched = told.unionByName(named).groupBy("part").applyInArrow(_match, "chunk long, keys binary, sums binary")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*key).schema)
    return matched.groupBy("chunk").applyInArrow(_add_up(key), f"{kinds}, ocorrencias long, termos long, primeira long")
