"""Streams against tables: the limiter over micro-batches, and calibration from a log of counts."""

import random

from pyspark.sql import functions as F

from peneira.plans import access, feedback
from peneira.streaming.state import CountLog, KeyedTable, feedback_log, recalibrate_stream


def _batches(spark, path, parts, schema):
    """Writes each part as one file, in order, and reads them as a stream of one file at a time."""
    import os

    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and not f.startswith("done"):
                os.rename(f"{path}/{f}", f"{path}/done{i}.parquet")
                os.utime(f"{path}/done{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    shape = spark.read.parquet(path).schema
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)


def test_limiter_over_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted((rng.uniform(0, 900), rng.choice("abc")) for _ in range(400))
    events = [(ip, i, t, rng.choice([1, 1, 1, 3])) for i, (t, ip) in enumerate(rows)]
    # out of order by up to twenty seconds
    come = sorted(events, key=lambda e: e[2] + rng.uniform(0, 20))
    parts = [come[i : i + 60] for i in range(0, len(come), 60)] + [[("z", 10_000 + i, 5000.0 + i, 1)] for i in range(2)]
    stream = _batches(spark, str(tmp_path / "in"), parts, "ip string, event_id long, t double, n int").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    q = access.limited_stream(stream, 60, 5, "60 seconds", "n").writeStream.format("memory").queryName("limited_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: r.aceito for r in spark.table("limited_out").where("ip <> 'z'").collect()}
    table = spark.createDataFrame(events, "ip string, event_id long, t double, n int").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    want = {r.event_id: r.aceito for r in access.limited(table, 60, 5, "n").collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_calibration_from_a_log(spark, tmp_path):
    rng = random.Random(12)
    schema = "fonte string, tipo string, confianca_modelo double, validacao_humana string"
    row = lambda: (rng.choice(["regex", "spacy"]), rng.choice(["CPF", "NOME", None]), rng.choice([rng.random(), 0.5, None]), rng.choice(["CORRETO", "INCORRETO", "PARCIAL", "?"]))
    parts = [[row() for _ in range(n)] for n in (4, 60, 1, 80)]
    log, seen = feedback_log(spark, str(tmp_path / "log")), {}

    def sink(points, history, number):
        seen[number] = sorted(map(tuple, points.collect())), sorted(tuple(r) for r in history.drop("ts", "por_tipo").collect())

    q = recalibrate_stream(_batches(spark, str(tmp_path / "in"), parts, schema), log, sink, str(tmp_path / "ck"), compact_every=2)
    q.processAllAvailable()
    q.stop()
    for i in range(4):
        points, history = feedback.recalibrate(spark.createDataFrame([r for p in parts[: i + 1] for r in p], schema))
        assert seen[i] == (sorted(map(tuple, points.collect())), sorted(tuple(r) for r in history.drop("ts", "por_tipo").collect())), i
    assert seen[3][0]


def test_log_of_two_writers(spark, tmp_path):
    log = CountLog(spark, str(tmp_path / "log"), ("k",), ("n",), "k string, n long")
    rows = lambda *p: spark.createDataFrame(p, "k string, n long")
    now = lambda: {r.k: r.n for r in log.read().collect()}
    assert now() == {}
    log.append(rows(("a", 1), ("a", 2), (None, 5)), 0, "x")
    log.append(rows(("a", 10)), 0, "y")
    log.append(rows(("a", 10)), 0, "y")  # run again
    assert now() == {"a": 13, None: 5}
    log.compact()
    assert now() == {"a": 13, None: 5} and log.listed(0, "y") and not log.listed(1, "y") and not log.listed(0, "z")
    log.append(rows(("b", 1)), 1, "x")
    # a batch that is not complete does not count, nor does a snapshot without rows
    log.append(rows(("b", 100)), 2, "x")
    (tmp_path / "log" / "batches" / "x-000000000002" / "_SUCCESS").unlink()
    spark.createDataFrame([("x-000000000001",)], "name string").write.parquet(str(tmp_path / "log" / "snaps" / "000000000009" / "names"))
    assert now() == {"a": 13, "b": 1, None: 5}
    log.compact()
    log.compact()
    assert now() == {"a": 13, "b": 1, None: 5} and log.listed(0, "y") and log.listed(1, "x")


def test_upserts_equal_the_latest_rows(spark, tmp_path):
    rng = random.Random(1)
    schema = "fb_id long, valor string, ts long, validacao_humana string"
    table, now = KeyedTable(spark, str(tmp_path / "t"), ("fb_id", "valor"), "ts", schema, 8), {}
    assert table.read().count() == 0
    for turn in range(4):
        rows = [(rng.choice([None, *range(12)]), rng.choice("ab"), rng.choice([None, rng.randint(0, 9)]), rng.choice(["CORRETO", "INCORRETO", None])) for _ in range((30, 1, 0, 30)[turn])]
        touched = table.upsert(spark.createDataFrame(rows, schema))
        place = lambda r: (r[2] is not None, r[2] or 0)
        said = lambda r: (r[3] is not None, r[3] or "")
        best = {}
        for r in rows:
            if r[:2] not in best or (place(r), said(r)) > (place(best[r[:2]]), said(best[r[:2]])):
                best[r[:2]] = r
        for k, r in best.items():
            if k not in now or place(r) >= place(now[k]):
                now[k] = r
        assert sorted(map(tuple, table.read().collect()), key=str) == sorted(now.values(), key=str)
        assert len(touched) <= len(best)
    # an upsert that did not end does not count, and the next takes another number
    spark.createDataFrame([(1, "a", 99, "X", 0)], schema + ", _bucket int").write.partitionBy("_bucket").parquet(str(tmp_path / "t" / "000000000009"))
    (tmp_path / "t" / "000000000009" / "_SUCCESS").unlink()
    assert table.read().where("ts = 99").count() == 0
    table.upsert(spark.createDataFrame([(1, "a", 100, "Y")], schema))
    assert [r.validacao_humana for r in table.read().where("fb_id = 1 and valor = 'a'").collect()] == ["Y"]
