"""URL filtering by association rules and by host and path rules.

URLs become sets of tokens (scheme, labels of the host and their parts between hyphens,
segments of the path, parameter names, and names with their values; runs of digits
become ``#``). FP-growth over the labelled URLs
mines token combinations that go with a bad label. Rules are pruned by support, by
confidence, by lift (confidence over the share of bad labels) and by significance (how
many standard deviations of a chance draw their bad labels lie above it), and so are
rules with a part that is as confident. A URL is
blocked if all tokens of a rule are among its own. Matching goes through an
inverted index on each rule's rarest token: URLs meet only rules whose rarest
token they have, and the rest of the rule is checked there. The number of rules
follows from the support limit, not from the number of URLs; it is counted, and up to
``MOST_SENT`` rules are sent to where the URLs are, and tested in the pass that judges
them, so that no token or URL of a third of all rows is dealt out by its value.

Host and path rules come first: the longest that fits decides.

Defined results: a URL that is null or has no ``://`` has an empty host and path
and no tokens, so it is allowed; labels that are null don't count; a page with
several labels counts with each; repeated rows are judged alike; of a rule's equally
rare tokens the first by name is its anchor; without labelled
rows, or labels of one kind only, no rules are mined by lift; other columns, whatever
their names, take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import discard, materialize

ALLOW, BLOCK = "allow", "block"
#: Least share of labelled URLs, and least number of them, that hold a rule with its label.
MIN_SUPPORT, MIN_COUNT = 0.002, 20
MIN_CONFIDENCE = 0.5
#: Limits where bad labels are rare: against their share, whatever it is.
BY_LIFT = {"min_confidence": 0.0, "min_lift": 2.0, "min_deviations": 4.0}
#: Rules that are sent to all executors: a few MB.
MOST_SENT = 50_000
_BAD = "label=bad"

#: Host and path rules of the query.
RULES = (("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK))


def host(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    tag = lambda name: lambda x: F.concat(F.lit(name), F.regexp_replace(x, "[0-9]+", "#"))
    parts = lambda text, at: F.filter(F.split(text, at), lambda x: x != "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    scheme = F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), F.lit(""))
    parameters = parts(query, "&")
    names = F.transform(parameters, lambda x: F.regexp_extract(x, "(?s)^[^=]*", 0))
    labels = parts(host(url), "[.]")
    every = F.concat(
        F.array(F.concat(F.lit("scheme="), scheme)),
        F.transform(labels, tag("host=")),
        F.transform(F.flatten(F.transform(labels, lambda x: parts(x, "-"))), tag("host=")),
        F.transform(parts(path(url), "/"), tag("path=")),
        F.transform(names, tag("query=")),
        F.transform(F.filter(parameters, lambda x: x.contains("=")), tag("query=")),
    )
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), F.array_distinct(every)).otherwise(F.expr("cast(array() as array<string>)"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = 0.0, min_deviations: float = 0.0) -> DataFrame:
    """``rule, tokens, anchor, confidence`` from rows ``url, bad``, written once."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    items = labelled.where("bad is not null").select(tokens(F.col("url")).alias("items"), F.col("bad").cast("boolean").alias("bad")).where("size(items) > 0")
    items = materialize(items.select("bad", F.when(F.col("bad"), F.array_append("items", F.lit(_BAD))).otherwise(F.col("items")).alias("items")), "items")
    n, base = items.agg(F.count("*"), F.avg(F.col("bad").cast("double"))).first()
    none = spark.createDataFrame([], "rule long, tokens array<string>, anchor string, confidence double")
    if not n or min_deviations and base in (0.0, 1.0):
        discard(items)
        return none
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min(1.0, max(min_confidence, min_lift * base))).fit(items)
    sets = materialize(model.freqItemsets, "itemsets")
    singles = sets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("t"), "freq")
    found = model.associationRules.where(F.get("consequent", F.lit(0)) == _BAD)
    if min_deviations:
        held = F.col("support") * n / F.col("confidence")
        found = found.where((F.col("confidence") - base) * F.sqrt(held / (base * (1 - base))) >= min_deviations)
    found = materialize(found.select(F.sort_array("antecedent").alias("tokens"), "confidence"), "rules")
    discard(items)
    # a rule is of no use if one token less is as confident
    less = found.select("tokens", "confidence", F.explode("tokens").alias("out")).where(F.size("tokens") > 1)
    less = less.select("tokens", "confidence", F.array_remove("tokens", F.col("out")).alias("part"))
    shorter = found.select(F.col("tokens").alias("part"), F.col("confidence").alias("c"))
    idle = less.join(shorter, "part").where("c >= confidence").select("tokens")
    kept = found.join(idle, "tokens", "left_anti")
    each = kept.select("tokens", "confidence", F.explode("tokens").alias("t")).join(singles, "t")
    anchors = each.groupBy("tokens", "confidence").agg(F.min(F.struct("freq", "t"))["t"].alias("anchor"))
    rules = materialize(anchors.select(F.xxhash64("tokens").alias("rule"), "tokens", "anchor", "confidence"), "anchored")
    discard(found)
    discard(sets)
    return rules


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``urls`` (with ``own``, the tokens) with ``hit``: whether some rule blocks the row.

    Up to ``MOST_SENT`` rules go to the tasks, whose index by anchors answers in one pass. More of them
    are joined by their anchors with the distinct token sets.
    """
    if rules.limit(MOST_SENT + 1).count() <= MOST_SENT:
        index: dict[str, list[frozenset[str]]] = {}
        for r in rules.select("anchor", "tokens").collect():
            index.setdefault(r.anchor, []).append(frozenset(r.tokens))
        if not index:
            return urls.withColumn("hit", F.lit(False))
        return urls.mapInArrow(_tested(index), urls.withColumn("hit", F.lit(False)).schema)
    sets = urls.select("own").distinct()
    met = sets.select("own", F.explode("own").alias("anchor")).join(rules.select("anchor", "tokens"), "anchor")
    hits = met.where(F.size(F.array_except("tokens", "own")) == 0).select("own").distinct().withColumn("hit", F.lit(True))
    return urls.join(hits, "own", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def _tested(index: dict[str, list[frozenset[str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [any(set(own) >= tokens for t in own if t in index for tokens in index[t]) for own in batch.column("own").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], names=[*batch.schema.names, "hit"])

    return run


def fitting_rule(host_: Column, path_: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest host and path rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, **limits) -> DataFrame:
    """Per row of ``page_id, url``: page_id, host, path, rule and verdict; ``labelled`` has ``url, bad``."""
    mined = mine(labelled, **limits)
    judged = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("own"))
    judged = matched(judged.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)), mined)
    said = F.create_map(*(F.lit(x) for r in rules for x in r))[F.col("rule")] if rules else F.lit(None)
    verdict = F.when(F.col("rule").isNotNull(), said).when(F.col("hit"), BLOCK).otherwise(ALLOW)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
