"""Access logs: rate windows, an exact limiter, bots, suspicious addresses, counters."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peneira.functions.normalize import contains_any
from peneira.operators.vocabulary import BOTS

WINDOW_S, LIMIT = 60, 300


def is_bot(user_agent: Column) -> Column:
    return F.coalesce(contains_any(F.lower(user_agent), BOTS), F.lit(False))


def batch_cost(items: Column) -> Column:
    """Tokens that a batch of items takes."""
    return 1 + F.floor(items / 10)


def rate_window(log: DataFrame, seconds: int = WINDOW_S, limit: int = LIMIT) -> DataFrame:
    """Adds the requests of the same address in the ``seconds`` up to each, and the remaining quota.

    Equals the limiter as long as nobody is refused.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = Window.partitionBy("ip").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    counted = log.withColumn("_at", at).withColumn("na_janela", F.count("*").over(span))
    return counted.withColumn("restante", F.greatest(F.lit(0), limit - F.col("na_janela"))).drop("_at")


def _admit(times: deque[int], at: int, cost: int, seconds: int, limit: int) -> bool:
    """Whether a request is taken; ``times`` holds what its address was granted in the window, oldest first."""
    while times and times[0] <= at - seconds * 1_000_000:
        times.popleft()
    fine = len(times) < limit
    # a batch takes what is left before it is refused
    take = min(cost, limit - len(times))
    times.extend([at] * (take if cost > 1 or fine else 0))
    return fine and take == cost


def limited(log: DataFrame, seconds: int = WINDOW_S, limit: int = LIMIT, cost: str | None = None) -> DataFrame:
    """Adds ``aceito``. A refused request is not counted later, so each address is gone through in order.

    Only the accepted times of one window are held; an address's rows stream by.
    """
    rows = log.withColumns({"_at": F.unix_micros(F.col("ts").cast("timestamp")), "_cost": F.lit(1) if cost is None else F.col(cost).cast("int")})
    kept = [c for c in log.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema) + ", aceito boolean"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, times = None, deque()
        for pdf in batches:
            out = []
            for ip, at, n in zip(pdf.ip, pdf._at, pdf._cost, strict=True):
                if ip != who:
                    who, times = ip, deque()
                out.append(_admit(times, at, n, seconds, limit))
            yield pdf[kept].assign(aceito=out)

    return rows.repartition("ip").sortWithinPartitions("ip", "_at", *(["event_id"] if "event_id" in log.columns else [])).mapInPandas(walk, schema)


def limited_stream(log: DataFrame, seconds: int = WINDOW_S, limit: int = LIMIT, late: str = "1 minute", cost: str | None = None) -> DataFrame:
    """``limited`` over a stream with ip, event_id and ts: ip, event_id, ts, aceito of each request once the watermark is past it.

    Requests that come out of order by less than ``late`` are judged in their order; what comes
    later than that is dropped, as the watermark says. An address's state holds its requests since
    the watermark and at most ``limit`` accepted times, and goes when its window is over.
    """
    rows = log.withWatermark("ts", late).select("ip", "ts", F.col("event_id").cast("long").alias("event_id"), F.unix_micros("ts").alias("at"), (F.lit(1) if cost is None else F.col(cost)).cast("long").alias("cost"))
    state = "held array<long>, at array<long>, event_id array<long>, cost array<long>"

    def walk(key: tuple, batches: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        held, *waiting = group.get if group.exists else ([], [], [], [])
        rows = list(zip(*waiting, strict=True))
        if not group.hasTimedOut:
            for pdf in batches:
                rows += zip(pdf["at"].tolist(), pdf.event_id.tolist(), pdf.cost.tolist(), strict=True)
        mark = group.getCurrentWatermarkMs()
        rows.sort()
        ready = [r for r in rows if r[0] // 1000 < mark]
        rows, times = rows[len(ready) :], deque(held)
        out = [(key[0], i, pd.Timestamp(at, unit="us"), _admit(times, at, n, seconds, limit)) for at, i, n in ready]
        if rows or times:
            group.update((list(times), *([list(c) for c in zip(*rows, strict=True)] or [[], [], []])))
            # wake when the first that waits is passed, or when nothing that was granted counts any more
            group.setTimeoutTimestamp(max(mark + 1, rows[0][0] // 1000 if rows else times[-1] // 1000 + seconds * 1000))
        elif group.exists:
            group.remove()
        yield pd.DataFrame(out, columns=["ip", "event_id", "ts", "aceito"])

    ip = log.schema["ip"].dataType.simpleString()
    return rows.groupBy("ip").applyInPandasWithState(walk, f"ip {ip}, event_id long, ts timestamp, aceito boolean", state, "append", "EventTimeTimeout")


def suspicious(log: DataFrame) -> DataFrame:
    """By address: last user agent, requests, first seen, the first five texts."""
    texts = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.substring("text", 1, 100).alias("t")))), lambda x: x["t"]), 1, 5)
    # only the first five rows of an address are gathered
    first = log.withColumn("_n", F.row_number().over(Window.partitionBy("ip").orderBy("ts", "event_id"))).where("_n <= 5").groupBy("ip").agg(texts.alias("textos"))
    agg = log.groupBy("ip").agg(F.max_by("user_agent", F.struct("ts", "event_id")).alias("user_agent"), F.count("*").alias("n"), F.min("ts").alias("desde"))
    return agg.join(first, "ip")


def counters(log: DataFrame, visit: str, request: str) -> DataFrame:
    """Visits and requests of an event log."""
    return log.agg(F.count_if(F.col("event_type") == visit).alias("visitas"), F.count_if(F.col("event_type") == request).alias("requisicoes"), F.max("ts").alias("ultimo"))
