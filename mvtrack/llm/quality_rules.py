"""Quality rules: a decision list learned from labelled statistics.

``text_stats`` measures whole texts.  ``learn`` grows conjunctions of thresholds
one after the other on labelled documents (sequential covering), prunes each on
rows it was not grown on, and stops when the next rule is no longer precise.
The list is emitted as one ``CASE WHEN`` of plain column comparisons, so that
applying it is a projection that Spark compiles, and anyone can read it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"!?"
WINDOW = 8

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
SCHEMA = "struct<" + ",".join(f"{s}:long" for s in STATS) + ">"

#: Names and Spark SQL of what rules may test; {s} stands for the struct of one text's statistics.
FEATURES = {
    "words": "{s}.n_words",
    "mean_word": "{s}.word_chars / greatest({s}.n_words, 1)",
    "symbols": "{s}.n_symbols / greatest({s}.word_chars, 1)",
    "dup_lines": "{s}.n_dup_lines / greatest({s}.n_lines, 1)",
    "repeats": "{s}.n_repeat_words / greatest({s}.n_words, 1)",
    "distinct": "{s}.n_distinct / greatest({s}.n_words, 1)",
    "upper": "{s}.n_upper / greatest({s}.word_chars, 1)",
    "digits": "{s}.n_digits / greatest({s}.word_chars, 1)",
    "marks": "{s}.n_marks / greatest({s}.n_words, 1)",
}


def _repeat_words(words: list[bytes]) -> int:
    """Words within windows of WINDOW words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + (one[k : k + n] ^ (one[k : k + n] >> np.uint64(31)))
    ranked = np.sort(rolled)
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(rolled, again)).tolist()
    seen: dict[tuple[bytes, ...], list[int]] = {}
    for i in at:  # equal hashes are compared word by word
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for starts in seen.values():
        if len(starts) > 1:
            for i in starts:
                edge[i] += 1
                edge[i + WINDOW] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _stats(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = raw.split(b"\n")
    repeated, filled, seen = 0, 0, set()
    for line in lines:
        if line and not line.isspace():
            filled += 1
            if line in seen:
                repeated += 1
            seen.add(line)
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (len(words), len(text) - without(SPACE), without(SYMBOLS), repeated, _repeat_words(words), filled, len(set(words)), without(UPPER), without(DIGITS), without(MARKS))


def text_stats(text: str = "text") -> Column:
    """A struct of STATS of a text column.  Null and empty texts count nothing."""

    @F.pandas_udf(SCHEMA)
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([_stats(t) for t in texts], columns=STATS, dtype="int64")

    return stats.asNondeterministic()(F.col(text))  # so that it runs once a row


def features(stats: str) -> list[Column]:
    """FEATURES as doubles, from a struct column of STATS."""
    return [F.expr(f"cast({sql.format(s=stats)} as double)").alias(name) for name, sql in FEATURES.items()]


@dataclass
class Rule:
    """A conjunction of (feature, above?, threshold); what it covers is rejected."""

    tests: list[tuple[str, bool, float]]
    precision: float = 0.0
    covered: int = 0

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, t in self.tests:
            out &= x[name] > t if above else x[name] <= t
        return out

    def sql(self, stats: str) -> str:
        return " AND ".join(f"{FEATURES[n].format(s=stats)} {'>' if above else '<='} {t!r}D" for n, above, t in self.tests)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def keep(self, stats: str) -> Column:
        """True unless a rule covers the row; rules are tried in order.  ``stats`` names a struct column of STATS."""
        if not self.rules:
            return F.lit(True)
        return F.expr("CASE " + " ".join(f"WHEN {r.sql(stats)} THEN false" for r in self.rules) + " ELSE true END")


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Add the test with the best information gain until no good row is covered."""
    rule, here = Rule([]), np.ones(len(bad), bool)
    while len(rule.tests) < most and (~bad[here]).any():
        p0, n0 = bad[here].sum(), (~bad[here]).sum()
        best = (1e-9, None)
        for name in sorted(x):
            v, y = x[name][here], bad[here]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            ends = np.flatnonzero(v[1:] > v[:-1])
            if not len(ends):
                continue
            p, n = np.cumsum(y)[ends], np.cumsum(~y)[ends]
            for above, ps, ns in ((False, p, n), (True, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - np.log2(p0 / (p0 + n0))), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.tests.append(best[1])
        here = rule.mask(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix of the conjunction that does best on rows it was not grown on."""
    best = (-2.0, rule)
    for k in range(1, len(rule.tests) + 1):
        short = Rule(rule.tests[:k])
        hit = short.mask(x)
        p, n = bad[hit].sum(), (~bad[hit]).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, short)
    return best[1]


def cover(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 5, most_tests: int = 4, most_rules: int = 32) -> DecisionList:
    """Sequential covering.  Every third row is for pruning; the rows come in no telling order."""
    found = DecisionList()
    while len(found.rules) < most_rules and bad.any() and not bad.all():
        third = np.arange(len(bad)) % 3 == 2
        grown = _grow({k: v[~third] for k, v in x.items()}, bad[~third], most_tests)
        if not grown.tests:
            break
        rule = _prune(grown, {k: v[third] for k, v in x.items()}, bad[third])
        hit = rule.mask(x)
        rule.covered, rule.precision = int(hit.sum()), float(bad[hit].mean()) if hit.any() else 0.0
        if rule.covered < least or rule.precision < precision:
            break
        found.rules.append(rule)
        x, bad = {k: v[~hit] for k, v in x.items()}, bad[~hit]
    return found


def learn(docs: DataFrame, labels: DataFrame, bound: int = 20_000, **how) -> DecisionList:
    """Fit the list on at most ``bound`` labelled documents (the bound is a parameter of the fit alone).

    ``labels`` has doc_id and quality (0: reject).  The sample is the ``bound``
    labels of smallest hash, the same for every run and spread over the table; a
    doc_id labelled twice counts with its lower label; null ids and labels don't
    count.  Without labels of both kinds the list is empty and keeps everything.
    """
    docs = small_batches(docs)
    pick = F.xxhash64(F.col("__label_id"), F.lit(11))
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("__label_id")).agg(F.min("quality").alias("__quality")).orderBy(pick).limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__label_id"))
    seen = rows.select("__quality", pick.alias("__pick"), F.xxhash64("text").alias("__h"), text_stats().alias("__stats"))
    data = seen.orderBy("__pick", "__h").limit(bound).select("__quality", *features("__stats")).toPandas()  # a doc_id may have many rows
    bad = data["__quality"].to_numpy(dtype=float) == 0
    return cover({n: data[n].to_numpy(dtype=float) for n in FEATURES}, bad, **how)


def base_failed(stats: str = "__stats", least_words: int = 20, most_repeats: int = 30) -> Column:
    return F.expr(f"{stats}.n_words < {least_words} OR 100 * {stats}.n_repeat_words > {most_repeats} * {stats}.n_words")


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of ``docs`` with a struct ``__stats``, ``__base_failed`` and ``__kept``.

    Null and empty texts have no words and fail the base rules.  Repeated rows
    are judged alike, each by itself; an empty table gives no rows; all other
    columns pass, whatever their names.
    """
    seen = small_batches(docs).withColumn("__stats", text_stats())
    return seen.withColumn("__base_failed", base_failed()).withColumn("__kept", ~F.col("__base_failed") & rules.keep("__stats"))
