"""Similarity join on word shingles by MinHash banding.

1. Each document gets the set of its five-word shingles (64-bit hashes), a 128-bit
   fingerprint of that set, and one hash for each band of its MinHash signature.
   Bands and rows follow from the target recall (``bands_for``).
2. Documents with equal sets collapse into one class, whose representative is the
   least name; copies never meet again as rows.
3. The representatives' bands are shuffled on their hashes. Buckets with the same
   members are kept once. A bucket of any size is cut into blocks of bounded
   size, and pairs of blocks are checked apart from each other, so no task holds
   a whole hot bucket, and no pair is ever a row.
4. In a pair of blocks the full shingle sets decide: a pair counts as a link
   where Jaccard reaches the threshold, in the first band that it shares. Out
   come link counts and a spanning forest of the links, a row per member at most.
5. Alternating large-star and small-star steps over the forests give each linked
   group the least name as its class.

Defined results: words are runs of non-space characters, taken as they stand; a
text of one to four words is one shingle; a text without words links to nothing
and is its own class; null texts are empty; rows of equal id and text are one
document, and so get equal rows; rows with null id go by a number from 2**62 on that
their text gives, after all ids. Rows go by names: where no id has two texts, a row's
name is its id; else the distinct pairs of id and text are numbered in the order of
ids and 128-bit text hashes, the numbers are the names, and classes are told by them.
So the result depends on no order of rows. An empty table gives an empty result.
Links of exactly the threshold are missed with the probability that the target
recall leaves; links above it less often.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import discard, materialize, named, utf8, whole_groups

N = 5
THRESHOLD = 0.8
RECALL = 0.9995
MOST_HASHES = 128
#: Members and shingles of a block; a task holds two blocks at a time.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1 << 20
#: Size of the bitmap of members that the tasks get (4 MB): it spares most texts
#: the way through a shuffle; an exact join follows, so with more members than
#: bits it only spares fewer.
FILTER_BITS = 1 << 25

_U = np.uint64


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows for which enough bands fit into ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding of so few hashes reaches the recall")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


class _Words(dict):
    """Hashes of words met so far; emptied before it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, words: dict, n: int = N) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    parts = text.split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = min(n, len(h))
    m = len(h) - n + 1
    x = np.full(m, n, np.uint64)
    for i in range(n):
        x = x * _U(0x9E3779B97F4A7C15) + h[i : i + m]
    return np.unique(_mix(x))


def _hashes(bands: int, rows: int) -> np.ndarray:
    return _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F)) | _U(1)


def band_hashes(values: np.ndarray, factors: np.ndarray, bands: int) -> np.ndarray:
    low = np.full(len(factors), ~_U(0), np.uint64)
    for i in range(0, len(values), 2048):
        np.minimum(low, (factors[:, None] * values[None, i : i + 2048]).min(1), out=low)
    low = low.reshape(bands, -1)
    x = np.arange(1, bands + 1, dtype=np.uint64) * _U(0x165667B19E3779F9)
    for i in range(low.shape[1]):
        x = _mix(x * _U(0x9E3779B97F4A7C15) + low[:, i])
    return x


def _sketch(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, factors = _Words(), _hashes(bands, rows)
        for batch in batches:
            texts = utf8(batch.column(1))
            fa, fb, size, flat, at = [], [], [], [], [0]
            for row in range(batch.num_rows):
                s = shingles(texts[row].as_buffer().to_pybytes(), words, n)
                a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                fa.append(a)
                fb.append(b)
                size.append(len(s))
                if len(s):
                    flat.append(band_hashes(s, factors, bands).view(np.int64))
                at.append(at[-1] + (bands if len(s) else 0))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(size, pa.int64()), lists], names=["did", "doc_id", "mark", "fa", "fb", "size", "bands"])

    return run


def _sets(n: int, filter_):
    """Shingle sets of the documents that may be members: those whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = _Words(), np.frombuffer(filter_.value, np.uint8)
        for batch in batches:
            at = batch.column(1).to_numpy()
            rows = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            texts = utf8(batch.column(2))
            sets = [shingles(texts[int(row)].as_buffer().to_pybytes(), words, n).tobytes() for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return run


def _bit() -> Column:
    return F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(FILTER_BITS))


def _filter(members: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS bits with those of the members set."""
    out = bytearray(FILTER_BITS // 8)
    size = 4096
    rows = members.groupBy(F.bitmap_bucket_number(_bit() + 1).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_bit() + 1)).alias("bits"))
    for row in rows.collect():
        out[(row.n - 1) * size : row.n * size] = row.bits
    return bytes(out)


def _common(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``left`` sets (rows) with the others, or of all with all if ``left`` is 0."""
    rows, cols = (sets[:left], sets[left:]) if left else (sets, sets)
    if len(rows) * len(cols) <= 4:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in cols] for a in rows], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    keep = shared[ids]
    owner, ids, width = owner[keep], place[ids[keep]], int(shared.sum())
    out = np.zeros((len(rows), len(cols)), np.float64)
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    step = max(256, 8_000_000 // len(sets))
    for low in range(0, width, step):
        a, b = np.searchsorted(ids, (low, low + step))
        m = np.zeros((len(sets), min(step, width - low)), np.float32)
        m[owner[a:b], ids[a:b] - low] = 1
        out += m[: len(rows)] @ (m[left:] if left else m).T
    return out.astype(np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """The links that join what was not joined yet."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = top(x), top(y)
        if i != j:
            up[max(i, j)] = min(i, j)
            yield x, y


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "bi", "bj"]):
            rep, block, band = (table.column(c).to_numpy() for c in ("rep", "block", "band"))
            keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "bi", "bj")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            raw, lists = table.column("shingles").combine_chunks(), table.column("bands").combine_chunks()
            if isinstance(raw, pa.ChunkedArray):
                raw, lists = pa.concat_arrays(raw.chunks), pa.concat_arrays(lists.chunks)
            out: list[tuple[int, int, int]] = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rep)], strict=True):
                _, bi, bj = keys[lo]
                order = lo + np.lexsort((rep[lo:hi], block[lo:hi])) if bi != bj else lo + np.argsort(rep[lo:hi], kind="stable")
                left = int((block[order] == bi).sum()) if bi != bj else 0
                if hi - lo < 2 or bi != bj and left in (0, hi - lo):
                    continue
                ids = rep[order]
                sets = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in order]
                sizes = np.array([len(s) for s in sets], np.int64)
                common = _common(sets, left)
                first, second = (np.arange(left), np.arange(left, len(ids))) if left else (np.arange(len(ids)),) * 2
                linked = common >= threshold * (sizes[first][:, None] + sizes[second][None, :] - common) - 1e-9
                if not left:
                    linked = np.triu(linked, 1)
                linked &= ids[first][:, None] != ids[second][None, :]
                sig = np.stack([lists[int(i)].values.to_numpy() for i in order])
                for t in range(int(band[lo])):
                    if not linked.any():
                        break
                    linked &= sig[first, t][:, None] != sig[second, t][None, :]
                x, y = np.nonzero(linked)
                x, y = first[x], second[y]
                links = np.bincount(np.concatenate([x, y]), minlength=len(ids))
                out += [(int(ids[i]), int(ids[i]), int(links[i])) for i in np.flatnonzero(links)]
                out += [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j])), 0) for i, j in _forest(len(ids), x, y)]
            if out:
                u, v, k = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(k, pa.int64())], names=["u", "v", "links"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """Rows ``node, least`` for every node of the edges ``u, v`` with u < v."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("o")).union(e.select(F.col("v").alias("n"), F.col("u").alias("o")))
        side = both if large else both.where("o < n")
        least = side.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"))
        joined = side.where("o > n" if large else "true").join(least, "n").select(F.col("m").alias("u"), F.col("o").alias("v"))
        if not large:
            joined = joined.union(least.select(F.col("m").alias("u"), F.col("n").alias("v")))
        return joined.where("u < v").distinct()

    now, before = edges.select("u", "v").distinct(), None
    while True:
        last, now = now, materialize(star(star(now, True), False), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None:
            discard(last)
        if mark == before:
            break
        before = mark
    return now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("least"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (least name of its linked group), copy_id
    (least name with the same shingles), n_links (other representatives it links to), its name, and
    mark (a hash of its text)."""
    bands, rows = bands_for(threshold, recall)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)))
    docs, _, scratch = named(docs.select(F.lit(False).alias("none"), F.col("doc_id").alias("did"), "doc_id", "text"))
    sketch = docs.select("did", "text", "doc_id", F.xxhash64("text").alias("mark"))
    sketch = materialize(sketch.mapInArrow(_sketch(n, bands, rows), "did long, doc_id long, mark long, fa long, fb long, size long, bands array<long>"), "sketch")
    reps = materialize(sketch.where("size > 0").groupBy("fa", "fb").agg(F.min("did").alias("rep"), F.max("size").alias("size"), F.first("bands").alias("bands")), "reps")
    dealt = reps.select("rep", "size", F.posexplode("bands").alias("band", "bucket"))
    pair = F.xxhash64("rep"), F.xxhash64("rep", F.lit(1))
    buckets = dealt.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("size").alias("weight"), F.min("band").alias("band"), *(F.bit_xor(x).alias(f"x{i}") for i, x in enumerate(pair))).where("m > 1")
    once = buckets.groupBy("m", "weight", "x0", "x1").agg(F.min(F.struct("band", "bucket")).alias("b"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_MEMBERS, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    kept = once.select("b.bucket", blocks.alias("blocks"))
    members = materialize(dealt.select("rep", "band", "bucket").join(kept, "bucket"), "members")
    maybe = docs.sparkSession.sparkContext.broadcast(_filter(members))
    sets = docs.select(F.col("did").alias("rep"), "text").select("rep", _bit().alias("bit"), "text").mapInArrow(_sets(n, maybe), "rep long, shingles binary")
    sets = sets.join(members.select("rep").distinct(), "rep", "left_semi").groupBy("rep").agg(F.first("shingles").alias("shingles"))
    member = materialize(sets.join(reps.groupBy("rep").agg(F.first("bands").alias("bands")), "rep"), "sets")
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int")
    spread = members.withColumn("block", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("bucket", "band", "rep", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    checked = spread.join(member, "rep").repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj").mapInArrow(_verify(threshold), "u long, v long, links long")
    found = materialize(checked, "links")
    for table in (member, members, *scratch):
        discard(table)
    count = found.where("u = v").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("n_links"))
    least = components(found.where("u < v")).withColumnRenamed("node", "rep")
    classes = reps.select("fa", "fb", "rep").join(count, "rep", "left").join(least, "rep", "left")
    per = sketch.select("did", "doc_id", "mark", "fa", "fb").join(classes.select("fa", "fb", F.coalesce("least", "rep").alias("class_id"), F.col("rep").alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), ["fa", "fb"], "left")
    return per.select(
        "doc_id",
        F.coalesce("class_id", "did").alias("class_id"),
        F.coalesce("copy_id", "did").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("did").alias("name"),
        "mark",
    )
