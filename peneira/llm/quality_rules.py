"""Quality rules: word statistics of a text, and lines that a host repeats across documents.

A document fails at once with fewer than ``min_words`` words, or if more than
``max_repeat_percent`` of its words stand in five-word windows that the text has
twice. For the others, each line is normalised and counted by the distinct
documents of its host that have it; lines in more than ``max_documents`` of them
are removed, and a document of which less than ``min_left`` of the characters is
left is rejected as depleted.

Copies of one document are one document here, since to drop copies is the
business of the near-duplicate stage: a line's documents are told apart by the
hash of their whole text.

Only built-in column functions and joins are used. The distinct documents of a line
are dealt by host, line and text, and counted there before they are by host and line,
so a line that a third of all documents share, or a host that has a third of them,
sends a row for each task.

Defined results: a null text is empty and fails; rows of null host are one host;
equal rows are copies and count once, each with its own verdict; other columns,
whatever their names, take no part; an empty table gives an empty result. Windows are compared by 64-bit hashes of five 64-bit word
hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import SPACES, WORD, materialize

SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_DOCUMENTS = 10
MIN_LEFT = 0.2
WINDOW = 5


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space as blanks, trimmed."""
    return F.lower(F.trim(F.translate(line, SPACES + DIGITS, " " * len(SPACES) + "0" * len(DIGITS))))


def _covered(windows: Column) -> Column:
    """Words that windows starting at these sorted positions cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end"))
    return F.aggregate(windows, start, step, lambda a: a["n"])


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the statistics and the lines as ``rule_lines``."""
    keep = [c for c in docs.columns if c != text]
    t = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("rule_text"))
    lines = F.filter(F.split("rule_text", "\n"), lambda x: _without(x, SPACES) != "")
    t = t.select(
        *keep,
        F.transform(F.regexp_extract_all("rule_text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("h"),
        F.length(_without(F.col("rule_text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("rule_text") - F.length(_without(F.col("rule_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    new = [*keep, "word_chars", "n_symbols"]
    at = F.sequence(F.lit(0), F.size("h") - WINDOW)
    t = t.select(
        *new,
        F.size("h").cast("long").alias("n_words"),
        F.when(F.size("h") >= WINDOW, F.transform(at, lambda i: F.xxhash64(*(F.get(F.col("h"), i + k) for k in range(WINDOW))))).alias("w"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(normal_line(x).alias("line"), F.length(_without(x, SPACES)).alias("chars"))).alias("lines"),
    )
    new += ["n_words", "n_dup_lines"]
    twice = F.size(F.array_distinct("w")) < F.size("w")
    t = t.select(*new, "lines", F.when(twice, F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    same = lambda e, i: F.coalesce(e["x"] == F.get(F.col("s"), i)["x"], F.lit(False))
    found = F.sort_array(F.transform(F.filter("s", lambda e, i: same(e, i + 1) | ((i > 0) & same(e, i - 1))), lambda e: e["i"]))
    rule_lines = F.transform("lines", lambda x: F.struct(F.xxhash64(x["line"]).alias("line"), x["chars"].alias("chars")))
    return t.select(*new, F.coalesce(_covered(found), F.lit(0)).cast("long").alias("n_repeat_words"), rule_lines.alias("rule_lines"))


def host_key(host: Column) -> Column:
    """The host as a value that is never null."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("-"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_documents: int = MAX_DOCUMENTS, min_left: float = MIN_LEFT) -> DataFrame:
    """Per row: doc_id, the statistics, base_failed, n_left (characters), kept, ``removed_lines`` (hashes), ``mark``, a hash of the text, and ``host``, behind a mark that sets none apart."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), host_key(F.col(host)).alias("host"), F.col(text).alias("text"))
    stats = text_statistics(slim)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    stats = materialize(stats.withColumns({"base_failed": failed, "row": F.monotonically_increasing_id()}), "statistics")
    lines = stats.select("row", "host", "mark", F.explode("rule_lines").alias("l")).select("row", "host", "l.line", "mark", "l.chars")
    counts = lines.select("host", "line", "mark").distinct().groupBy("host", "line").agg(F.count("*").alias("documents"))
    frequent = counts.where(F.col("documents") > max_documents).select("host", "line")
    gone = lines.where(F.col("chars") > 0).join(frequent, ["host", "line"], "left_semi").groupBy("row").agg(F.sum("chars").alias("gone"), F.collect_set("line").alias("removed_lines"))
    judged = stats.join(gone, "row", "left").withColumn("n_left", F.col("word_chars") - F.coalesce("gone", F.lit(0)))
    depleted = F.col("n_left") < min_left * F.col("word_chars")
    kept = ~F.col("base_failed") & ~depleted
    columns = ["doc_id", "mark", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left"]
    return judged.select(*columns, kept.alias("kept"), F.coalesce("removed_lines", F.expr("cast(array() as array<long>)")).alias("removed_lines"))


def without_lines(text: Column, removed_lines: Column) -> Column:
    """The text without the lines whose normal form is among ``removed_lines``."""
    keep = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed_lines, F.xxhash64(normal_line(x))))
    return F.array_join(keep, "\n")


#: The same for ``documents`` in DuckDB: a line's documents are the distinct whole texts that have it.
SQL = r"""
with t as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
w as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, string_split(text, chr(10)) as ls from t),
p as (select r, ws, unnest(range(len(ws) - 4)) as i from w where len(ws) >= 5),
g as (select r, i, count(*) over (partition by r, ws[i+1], ws[i+2], ws[i+3], ws[i+4], ws[i+5]) as k from p),
c as (select r, i, lead(i) over (partition by r order by i) as nx from g where k > 1),
rep as (select r, sum(least(5, coalesce(nx - i, 5))) as n_repeat_words from c group by r),
l as (select r, unnest(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as line from w),
n as (select r, line, lower(trim(translate(line, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||'0123456789', '     0000000000'))) as norm,
      length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars from l),
dup as (select r, count(*) - count(distinct line) as n_dup_lines from n group by r),
m as (select t.source, md5(t.text) as document, n.r, n.norm, n.chars from n join t using (r)),
f as (select source, norm from m group by source, norm having count(distinct document) > 10),
gone as (select m.r, sum(m.chars) as gone from m join f on m.norm = f.norm and m.source is not distinct from f.source group by m.r),
b as (select t.r, t.doc_id, len(ws)::bigint as n_words, length(regexp_replace(t.text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
      length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
      coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(gone, 0) as gone
      from t join w using (r) left join rep using (r) left join dup using (r) left join gone using (r)),
v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not base_failed and not (word_chars - gone < 0.2 * word_chars) as kept from v
"""
