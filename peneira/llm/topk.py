"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights ``floor(scale * x)``; a dimension is a
term. A block of candidates holds a posting list for each term. For a block of
queries, each term's query weights scatter the posting weights into a dense array
of scores, term after term; a partition selection keeps the k best per query, and
selections merge: within a task as blocks go by, then across tasks.

Queries reach the tasks in chunks of at most ``QUERY_CHUNK`` vectors, chosen by a
hash of their id. The driver holds one chunk at a time: each chunk is a pass over the
candidates whose result is written before the next, and exact search has the work of
these passes anyway. A task gives k rows per query, whatever it read.

Scores are summed in 64-bit integers where their size proves that this is exact, and in
whole numbers of any length elsewhere.

Defined results: vectors that are null or hold a null or non-finite component (or one
that scaling makes infinite), and rows without an id, take no part; a score beyond a
long counts as the nearest long; vectors of different lengths are compared as
if padded with zeros; a query row that is repeated counts once, repeated candidates
each take a place; a query's own id is never among its results; ties go to the smaller
id; other columns, whatever their names, take no part; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peneira.llm.common import discard, materialize

SCALE = 1024
#: Query vectors sent to the tasks at once: at 1,000 dimensions 32 MB.
QUERY_CHUNK = 4096
#: Queries and candidates whose scores one dense array holds.
QUERY_BLOCK, BLOCK = 256, 8192
RESULT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, w``: the integer weights of the vectors that take part, as doubles, which hold each of them exactly."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * F.lit(float(scale))) < float("inf")))
    part = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(sound)
    # from 2**52 on a double is whole, and floor would only bring it into a long's range
    weight = lambda c: F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c)
    return part.select("vec_id", F.transform(F.transform("x", lambda c: c * F.lit(float(scale))), weight).alias("w"))


def _dense(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of weights, cut or padded to ``width`` terms."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(lengths), width))
    if len(lengths) and (lengths == width).all():
        out[:] = flat.reshape(-1, width)
    else:
        for row, (end, n) in enumerate(zip(np.cumsum(lengths), lengths, strict=True)):
            m = min(int(n), width)
            out[row, :m] = flat[end - n : end - n + m]
    return out


LONGEST = (1 << 63) - 1


def _exact(weights: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of any length."""
    out = np.empty(weights.shape, object)
    out[...] = [[int(x) for x in row] for row in weights]
    return out


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of whole doubles as longs, accumulated a term at a time over the candidates' posting lists."""
    most = (np.abs(queries).max(initial=0), np.abs(candidates).max(initial=0))
    if float(most[0]) * float(most[1]) * max(1, queries.shape[1]) >= float(1 << 62) or max(most) >= float(1 << 62):
        total = accumulated(_exact(queries), _exact(candidates), object)
        return np.clip(total, -LONGEST - 1, LONGEST).astype(np.int64)
    return accumulated(queries.astype(np.int64), np.asfortranarray(candidates.astype(np.int64)), np.int64)


def accumulated(queries: np.ndarray, candidates: np.ndarray, kind) -> np.ndarray:
    out = np.zeros((len(queries), len(candidates)), kind)
    for term in range(queries.shape[1]):
        asks, column = np.flatnonzero(queries[:, term]), candidates[:, term]
        postings = np.flatnonzero(column)
        if not len(asks) or not len(postings):
            continue
        if len(postings) == len(column) and len(asks) == len(queries):
            out += queries[:, term, None] * column
        else:
            out[np.ix_(asks, postings)] += queries[asks, term, None] * column[postings]
    return out


def _select(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then smaller id; the columns are in the order of ids."""
    n = score.shape[1]
    if n <= k:
        return score, np.broadcast_to(ids, score.shape)
    least = np.partition(score, n - k, axis=1)[:, n - k, None]
    above, equal = score > least, score == least
    # of those at the limit the first by id fill what is left
    keep = above | equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True))
    at = np.nonzero(keep)[1].reshape(-1, k)
    return np.take_along_axis(score, at, 1), ids[at]


def _best(kept: list, k: int) -> list:
    """Merges selections ``(score, id)`` of one query; short ones pass."""
    s, i = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.lexsort((i, ~s))[:k]
    return [(s[order], i[order])]


def _search(query_ids: np.ndarray, queries: np.ndarray, k: int):
    width = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[] for _ in query_ids]
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            for low in range(0, len(ids), BLOCK):
                some = ids[low : low + BLOCK]
                order = np.argsort(some, kind="stable")
                some, block = some[order], _dense(lists.slice(low, BLOCK), width)[order]
                for q in range(0, len(query_ids), QUERY_BLOCK):
                    s, i = _select(scores(queries[q : q + QUERY_BLOCK], block), some, k + 1)
                    for row in range(len(s)):
                        other = i[row] != query_ids[q + row]
                        if other.sum() < min(k, (some != query_ids[q + row]).sum()):
                            # the query's own id filled places: select again without it
                            rest = some != query_ids[q + row]
                            a, b = _select(scores(queries[q + row : q + row + 1], block[rest]), some[rest], k)
                            kept[q + row].append((a[0], b[0]))
                        else:
                            kept[q + row].append((s[row][other], i[row][other]))
                        if len(kept[q + row]) > 16:
                            kept[q + row] = _best(kept[q + row], k)
        for low in range(0, len(query_ids), 1024):
            out = [(query_ids[q], *_best(kept[q], k)[0]) for q in range(low, min(low + 1024, len(query_ids))) if kept[q]]
            if out:
                n = [len(s) for _, s, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in out], n), pa.int64()), pa.array(np.concatenate([i for _, _, i in out]), pa.int64()), pa.array(np.concatenate([s for _, s, _ in out]), pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, chunk: int = QUERY_CHUNK) -> DataFrame:
    """``query_id, rank, vec_id, score`` from two tables ``vec_id, w`` as ``quantised`` gives them."""
    spark, queries = vectors.sparkSession, queries.dropDuplicates(["vec_id", "w"])
    asked = materialize(queries.withColumn("deal", F.xxhash64("vec_id", "w")), "queries")
    count = asked.count()
    chunks = max(1, -(-2 * count // chunk)) if count > chunk else 1
    found: list[DataFrame] = []
    for n in range(chunks if count else 0):
        rows = asked.where(F.pmod("deal", F.lit(chunks)) == n).orderBy("vec_id", "w").collect()
        for i in range(0, len(rows), chunk):
            some = rows[i : i + chunk]
            width = max(len(r.w) for r in some)
            matrix = np.array([r.w + [0.0] * (width - len(r.w)) for r in some], np.float64).reshape(len(some), width)
            part = vectors.select("vec_id", "w").mapInArrow(_search(np.array([r.vec_id for r in some], np.int64), matrix, k), RESULT)
            found.append(part if count <= chunk else materialize(part, "found"))
    discard(asked)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0] if len(found) == 1 else spark.read.schema(found[0].schema).parquet(*(x.written_at for x in found))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB for every 100th vector.
SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as w from embeddings
 where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.w, c.w)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""
