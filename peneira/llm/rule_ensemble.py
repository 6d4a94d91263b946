"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of every whole text (shares of kinds of characters, words and
   lines) are computed in one pass over its bytes.
2. Small trees are boosted on a bounded sample of labelled rows (``MOST_ROWS``, the
   rows of least id hash), the only place where anything is bounded. The rows are
   counted first, and only those under a bound of the hash that lets about so many
   pass leave their tasks. Every path
   from the root to a node is a rule, a conjunction of comparisons.
3. A logistic regression with an L1 penalty, by accelerated proximal gradient,
   weighs the rules; most weights come out as zero and their rules go.
4. The rules left are compiled into one Spark column, so scoring is a projection.

Labels, language, source and id are never inputs of a score.

Defined results: null texts are empty; an empty text has all statistics at zero
and a score like any other; labels that are null don't count; a row labelled
twice counts twice; with no labels, or labels of one kind only, the score is the
share of label 1 (0.5 without labels); of equally good splits a tree takes the first
statistic and its least threshold; a null id counts as the empty text for
the fold; other columns, whatever their names, take no part; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import materialize, utf8

#: Labelled rows that training takes at most.
MOST_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
PENALTY = 5e-4
STEPS = 400
FOLDS, CUT = 5, 0.3

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>@~^_=+\\/",
    "shout": b"!?",
    "stop": b".",
    "comma": b",;:",
    "bracket": b"()[]{}\"'",
    "space": b" \t\x0b\x0c\r",
    "line": b"\n",
}
STATISTICS = (*(f"{k}_share" for k in _KINDS), "log_bytes", "log_words", "word_length", "short_words", "long_words", "distinct_words", "top_word", "line_words", "distinct_lines", "ended_lines", "bytes_per_char", "marked_words")


def _table() -> np.ndarray:
    out = np.zeros((len(_KINDS), 256), np.int64)
    for i, chars in enumerate(_KINDS.values()):
        out[i, list(chars)] = 1
    return out


_TABLE = _table()
_MARKS = tuple(b"#*$%&|<>!")


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of one text."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(counts.sum() - counts[0x80:0xC0].sum()) or 1
    kinds = (_TABLE @ counts / chars).tolist()
    words = text.split()
    n = len(words) or 1
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    marked = sum(w[-1] in _MARKS for w in words)
    return [
        *kinds,
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        float(lengths.mean()),
        float((lengths <= 3).mean()),
        float((lengths >= 13).mean()),
        len(seen) / n,
        max(seen.values(), default=0) / n,
        float(np.log1p(len(words) / (len(lines) or 1))),
        len(set(lines)) / (len(lines) or 1),
        ended / (len(lines) or 1),
        len(text) / chars,
        marked / n,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch.column(1))
        rows = np.array([statistics(texts[row].as_buffer().to_pybytes()) for row in range(batch.num_rows)], np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.round(rows[:, i], 9)) for i in range(len(STATISTICS)))], names=["doc_id", *STATISTICS])


def measured(docs: DataFrame) -> DataFrame:
    kind = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure, kind)


#: A comparison: (statistic, threshold, whether the value must be above it).
Rule = tuple[tuple[int, float, bool], ...]


def _grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: Rule, depth: int, rules: list[Rule], out: np.ndarray) -> None:
    """A tree on the gradient; collects its paths and writes its values for ``rows``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    out[rows] = -g / (h + 1)
    if path:
        rules.append(path)
    if depth == 0 or len(rows) < 20:
        return
    best, split = 1e-6, None
    for f in range(x.shape[1]):
        gs = np.bincount(binned[rows, f], grad[rows], BINS)
        hs = np.bincount(binned[rows, f], hess[rows], BINS)
        gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(hl < 1) | (h - hl < 1)] = 0
        at = int(np.argmax(gain))
        if gain[at] > best and at < len(cuts[f]):
            best, split = gain[at], (f, at)
    if split is None:
        return
    f, at = split
    above = binned[rows, f] > at
    for side in (False, True):
        _grow(x, cuts, binned, grad, hess, rows[above == side], (*path, (f, float(cuts[f][at]), side)), depth - 1, rules, out)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The distinct paths of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    score = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    rules: list[Rule] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        out = np.zeros(len(y))
        _grow(x, cuts, binned, p - y, p * (1 - p), np.arange(len(y)), (), depth, rules, out)
        score += RATE * out
    return sorted({tuple(sorted(r)) for r in rules})


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, cut, above in rule:
        out &= (x[:, f] > cut) == above
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression on 0/1 columns."""
    mean = r.mean(0)
    spread = np.sqrt(mean * (1 - mean)) + 1e-9
    z = ((r - mean) / spread).astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 4 * len(y) / (float(np.linalg.norm(z @ v) ** 2) * 1.05 + len(y))
    w = ahead = np.zeros(z.shape[1])
    b = ahead_b = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ ahead.astype(np.float32) + ahead_b)))
        new = ahead - rate * (z.T @ (p - y).astype(np.float32) / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = ahead_b - rate * float((p - y).mean())
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return w / spread, b - float((w / spread * mean).sum())


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        """The score as a column over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            tests = [F.col(STATISTICS[f]) > F.lit(cut) if above else F.col(STATISTICS[f]) <= F.lit(cut) for f, cut, above in rule]
            all_ = tests[0]
            for t in tests[1:]:
                all_ = all_ & t
            total = total + F.when(all_, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if not len(y):
        return Ensemble([], [], 0.0)
    share = float(y.mean())
    if share in (0.0, 1.0):
        return Ensemble([], [], 40.0 if share else -40.0)
    rules = tree_rules(x, y)
    if not rules:
        return Ensemble([], [], float(np.log(share / (1 - share))))
    r = np.stack([holds(rule, x) for rule in rules], 1).astype(np.float32)
    weights, intercept = lasso(r, y)
    kept = [i for i in range(len(rules)) if abs(weights[i]) > 1e-6]
    return Ensemble([rules[i] for i in kept], [float(weights[i]) for i in kept], intercept)


def sampled(some: DataFrame, most_rows: int) -> list:
    """The ``most_rows`` rows of least id hash (all, if fewer): ``y`` and the statistics."""
    spread = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    count, bound = some.count(), 1 << 63
    if count > most_rows:
        bound = (1 << 63) * (most_rows + 4 * math.isqrt(most_rows)) // count
    while True:
        near = some.where(spread < F.lit(bound)) if bound < 1 << 63 else some
        rows = near.orderBy(spread, "doc_id", "y", *STATISTICS).limit(most_rows).select("y", *STATISTICS).collect()
        if len(rows) >= min(count, most_rows) or bound >= 1 << 63:
            return rows
        bound *= 2


def score(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. ``labels`` has ``doc_id, quality``."""
    stats = materialize(measured(docs), "statistics")
    fold = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % FOLDS
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y is not null and doc_id is not null")
    some = marks.where(fold(F.col("doc_id")) != 0).join(stats, "doc_id")
    rows = sampled(some, most_rows)
    data = np.array([tuple(r) for r in rows], np.float64).reshape(-1, 1 + len(STATISTICS))
    value = fit(data[:, 1:], data[:, 0]).column()
    judged = stats.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), value.alias("score"))
    return judged.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
