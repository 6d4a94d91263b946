import random

import duckdb
from pyspark.sql import functions as F

from peneira.llm import quality_rules as Q


def test_equals_sql(edges, edge_rows):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", edge_rows)
    want = sorted(con.sql(Q.SQL).fetchall(), key=str)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted((tuple(r) for r in Q.judge(edges).select(columns).collect()), key=str) == want


def test_repeated_windows(spark):
    text = "a b c d e f a b c d e g"
    r = Q.judge(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert (r.n_words, r.n_repeat_words, r.base_failed) == (12, 10, True)


def test_frequent_lines_and_copies(spark):
    menu = "home about contact imprint press jobs terms privacy help sitemap news"
    own = [f"{menu}\n" + " ".join(f"{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(80)) for i in range(15)]
    only = [menu + "\n" + f"tiny {c}" for c in ("alpha", "beta", "gamma")]
    copies = ["same text in every copy of this long enough document here now\nand its other line too"] * 40
    rows = [(i, t, "h") for i, t in enumerate(own + only + copies)] + [(900, menu, "other host")]
    judged = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(judged[i].kept and len(judged[i].removed_lines) == 1 for i in range(15))
    assert not any(judged[i].kept for i in range(15, 18)) and not any(judged[i].base_failed for i in range(15, 18))
    assert all(judged[i].kept and not judged[i].removed_lines for i in range(18, 58)) and judged[900].kept
    docs = spark.createDataFrame(rows[:1], "doc_id long, text string, source string")
    cut = docs.select(Q.without_lines(F.col("text"), F.array(*(F.lit(x) for x in judged[0].removed_lines)))).first()[0]
    assert cut == own[0].split("\n")[1]


def test_shared_lines_of_different_texts(spark):
    notice = "all rights are reserved here\nby the owner of this page\nand may not be sold on"
    rows = [(i, notice + "\nzz" + "".join(chr(97 + i // 26**k % 26) for k in range(3)), "h") for i in range(100)]
    rows += [(1000 + i, f"page {100 + i} of the report was moved to the archive by the office", "g") for i in range(100)]
    judged = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(len(judged[i].removed_lines) == 3 and not judged[i].base_failed and not judged[i].kept for i in range(100))
    assert all(len(judged[1000 + i].removed_lines) == 1 and judged[1000 + i].n_left == 0 and not judged[1000 + i].kept for i in range(100))


def test_header_and_footer_together(spark):
    """Both stand in 200 different documents of one host, so both go; a line of ten documents stays."""
    rng = random.Random(4)
    words = lambda i: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(40)) + f" {chr(97 + i % 26)}"
    rows = [(i, "Home | About | Contact\n" + words(i) + f" {chr(97 + i % 26)}{chr(97 + i // 26)}\nall rights reserved by the owners of this site", "h") for i in range(200)]
    rows += [(1000 + i, "a line that ten documents of the host share among them\n" + words(300 + i) + " " + chr(97 + i) * 3, "g") for i in range(10)]
    judged = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(len(judged[i].removed_lines) == 2 and judged[i].kept for i in range(200))
    assert not any(judged[1000 + i].removed_lines for i in range(10))


def test_empty(empty):
    assert Q.judge(empty).count() == 0
