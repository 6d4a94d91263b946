import random

import pytest


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeghilmnoprstuvé") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, junk, and repeated rows."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(1, 300)) for _ in range(60)]
    passage = prose(rng, 60)
    texts = [*base, None, "", " \n\t ", "a", "one two three four", prose(rng, 9000), "a" * 5000, "ab " * 3000, "é" * 400]
    texts += [base[3], base[3], base[5] + " more", base[7][:-3] + "xyz"] + [base[i] + "\n" + passage + "\n" + base[i + 1] for i in range(10, 20)]
    long_one = prose(rng, 200).split()
    for i in range(6):
        w = list(long_one)
        w[i * 30 + 5] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows.append((None, base[9] + " without an id", "en", "s1", 1))
    rows.append(rows[4])
    rows.append(rows[4])
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, under other meanings.
CLASH = {"did": 1, "h": "x", "row": 2, "lines": "y", "rep": 3, "bucket": 4, "bytes": 5, "size": 6, "tag": 7, "key": 8, "mark": 9, "host": "z", "length": 10, "rank": 11, "shard": 12, "taken": 13}


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows, SCHEMA).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
