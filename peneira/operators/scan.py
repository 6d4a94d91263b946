"""Finding all matches of many patterns, with half-open spans in code points.

Spark has no find-all with offsets: the pieces between the matches (``split``) and
the matches themselves (``regexp_extract_all``) alternate, so running lengths give
the spans. All patterns are scanned in one projection. In front of each stand the test
of what its matches must hold (``guards``) and the search for a first match, so a text
costs most patterns a literal search, some one pass, and those that match the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.normalize import let
from peneira.operators.guards import folded, may_match, n_digits
from peneira.operators.patterns import ANY_CASE, THIS_CASE, Pattern

GROUPS = 6
_KIND = "array<struct<ord:int,name:string,inicio:int,fim:int,m:string," + ",".join(f"g{i}:string" for i in range(1, GROUPS + 1)) + ">>"


LOW, DIGITS = "_scan_low", "_scan_digits"
#: Characters on either side of a match that go on with it; rules look 150 far at most.
NEAR = 160
#: Characters of the blocks that slices are cut from.
BLOCK = 2048


def hidden(text: Column, ahead: tuple[str, ...]) -> Column:
    """The text with a sign that no pattern takes for each ``@`` that one of the expressions follows in its line."""
    last = f"(?iuUd)^(.*)(?:{'|'.join(ahead)})"
    masked = lambda line, before: F.concat(F.translate(before, "@", "\x01"), F.substring(line, F.length(before) + 1, F.length(line)))
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(F.contains(x, F.lit("@")), let(F.regexp_extract(x, last, 1), lambda b: masked(x, b))).otherwise(x))
    return F.when(text.rlike(f"(?iuUd){'|'.join(ahead)}"), F.array_join(lines, "\n")).otherwise(text)


def find_all(text: Column, pattern: Pattern, ord_: int, guarded: bool = True) -> Column:
    """An array of structs: ord, name, inicio, fim, m (the match), g1 to g6 (null where a group has no part)."""
    if pattern.not_ahead:
        return let(hidden(text, pattern.not_ahead), lambda t: find_all(t, replace(pattern, not_ahead=(), regex=pattern.java.removeprefix(ANY_CASE).removeprefix(THIS_CASE)), ord_, guarded))
    java = F.lit(pattern.java)
    whole = F.regexp_extract_all(text, java, F.lit(0))
    groups = [F.regexp_extract_all(text, java, F.lit(i)) for i in range(1, pattern.groups + 1)]
    pieces = F.transform(F.split(text, pattern.java, -1), lambda x: F.length(x))
    zipped = F.arrays_zip(whole.alias("m"), pieces.alias("gap"), *(g.alias(f"g{i}") for i, g in enumerate(groups, 1)))
    real = F.filter(zipped, lambda z: z["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_KIND})").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        begin = acc["at"] + z["gap"]
        end = begin + F.length(z["m"])
        parts = [F.nullif(z[f"g{i}"], F.lit("")) if i <= pattern.groups else F.lit(None).cast("string") for i in range(1, GROUPS + 1)]
        one = F.struct(F.lit(ord_).alias("ord"), F.lit(pattern.name).alias("name"), begin.alias("inicio"), end.alias("fim"), z["m"].alias("m"), *(p.alias(f"g{i}") for i, p in enumerate(parts, 1)))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one).cast(_KIND)).alias("out"))

    found = F.aggregate(real, start, step, lambda a: a["out"])
    if not guarded:
        return found
    return F.when(may_match(pattern.regex, F.col(LOW), F.col(DIGITS)) & text.rlike(pattern.java), found).otherwise(F.expr(f"cast(array() as {_KIND})"))


_BUILT: dict[tuple, Column] = {}


def arrays(patterns: tuple[Pattern, ...], text: str, first: int) -> list[Column]:
    """Columns of ``find_all``, built once for a session: there are thousands of calls in them."""
    session, body = SparkContext.getOrCreate().applicationId, F.coalesce(F.col(text), F.lit(""))
    for i, p in enumerate(patterns, first):
        if (session, p, i, text) not in _BUILT:
            _BUILT[session, p, i, text] = find_all(body, p, i)
    return [_BUILT[session, p, i, text] for i, p in enumerate(patterns, first)]


def scan(docs: DataFrame, patterns: Iterable[Pattern], text: str = "text", first: int = 0) -> DataFrame:
    """The columns of ``docs`` with a row for each match. Null texts have none."""
    body = F.coalesce(F.col(text), F.lit(""))
    tested = docs.withColumns({LOW: folded(body), DIGITS: n_digits(body)})
    return tested.select(*(F.col(f"`{c}`") for c in docs.columns), F.inline(F.concat(*arrays(tuple(patterns), text, first))))


def once(**columns: Column) -> Column:
    """Columns made in a step of their own, so that what follows doesn't repeat their work."""
    return F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))


def slices(docs: DataFrame, patterns: Iterable[Pattern], text: str = "text", whole: Callable[[Column], dict[str, Column]] = lambda _: {}, each: Callable[[Column], dict[str, Column]] = lambda _: {}, beside: Callable[[Column], Column] | None = None) -> DataFrame:
    """The columns of ``docs`` but for the text, with a row for each match.

    ``near`` is the text from ``NEAR`` characters before the match to ``NEAR`` after it, and
    starts at ``near_at``: a match takes a bounded slice along, however long its text, and
    slices come from blocks of the text, so the work is in proportion to text and matches.
    ``whole`` gives columns of the whole text, made once for texts with a match, and ``each``
    columns of a match (a struct), which may use them. ``beside`` gives an array of structs
    from the text: a row for each stands beside those of the matches, as ``made``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    tested = docs.withColumns({LOW: folded(body), DIGITS: n_digits(body), "_body": body})
    extra = {} if beside is None else {"_made": beside(F.col("_body"))}
    found = tested.select(*rest, "_body", once(_found=F.concat(*arrays(tuple(patterns), text, 0)), **extra))
    some = F.size("_found") > 0
    found = found.where(some if beside is None else some | (F.size("_made") > 0))
    facts = whole(F.col("_body"))
    cut = F.when(some, F.regexp_extract_all("_body", F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)))
    known = found.select(*rest, "_body", "_found", *extra, once(_blocks=cut, **facts))

    def with_slice(z: Column) -> Column:
        low, high = F.greatest(z["inicio"] - NEAR, F.lit(0)), z["fim"] + NEAR
        at = F.floor(low / BLOCK).cast("int")
        piece = F.array_join(F.slice(F.col("_blocks"), at + 1, F.floor((high - 1) / BLOCK).cast("int") - at + 1), "")
        near = F.substring(piece, low - at * BLOCK + 1, high - low)
        own = [z[n].alias(n) for n in ("ord", "name", "inicio", "fim", "m", *(f"g{i}" for i in range(1, GROUPS + 1)))]
        return F.struct(*own, near.alias("near"), low.alias("near_at"), *(c.alias(n) for n, c in each(z).items()))

    rows = F.transform("_found", with_slice)
    if beside is None:
        return known.select(*rest, *facts, F.inline(rows))
    pairs = F.concat(F.transform(rows, lambda z: F.struct(z.alias("match"), F.lit(None).alias("made"))), F.transform("_made", lambda x: F.struct(F.lit(None).alias("match"), x.alias("made"))))
    return known.select(*rest, *facts, F.inline(pairs)).select(*rest, *facts, "match.*", "made")
