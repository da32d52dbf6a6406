"""Operator 12, URL filter: listed rules, then association rules mined from labelled URLs.

A URL is described by at most eight tokens, one for each slot of ``SLOTS``. Spark's FP-growth mines
token combinations from labelled URLs together with their label; combinations that imply a label
often enough (support) and surely enough (confidence) become rules. An inverted index from tokens to
rules finds the rules of a URL whose tokens it holds all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Token slots of a URL. A URL has at most one token of each, so at most 255 combinations.
SLOTS = ("scheme", "tld", "domain", "host", "sub", "dir", "leaf", "query")
#: Share of the labelled URLs that must hold a combination together with its label.
MIN_SUPPORT = 1 / 512
#: URLs, at least, that must hold it.
MIN_COUNT = 5
#: Share of the URLs with the combination that must bear the label.
MIN_CONFIDENCE = 0.9
#: Verdict of URLs that no rule fits.
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class ListRule(NamedTuple):
    """A listed rule: holds for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


class MinedRule(NamedTuple):
    """``tokens`` imply ``verdict``; ``count`` labelled URLs hold both."""

    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    count: int

    def __str__(self) -> str:
        return f"{' '.join(self.tokens)} -> {self.verdict}"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def listed(host: Column, path: Column, rules: Sequence[ListRule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, nulls if none does; of equally long rules
    the first by name decides. ``rules`` is a short hand-written list: it becomes one expression."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path), reverse=True):
        name = r.host + r.path
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The URL's tokens ``slot=value``; empty for a URL without host and path.

    tld and domain: the last label and the last two; sub: the first label of three or more; dir: the
    first segment of the path that another one or a slash follows; leaf: the last segment, digits
    as one ``9``; query: the name of the first parameter.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    leaf = F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), "[0-9]+", "9")
    query = F.regexp_extract(url, r"^[^?#]*\?([^=&#]*)", 1)
    value = {
        "scheme": F.when(F.length(host) > 0, F.substring_index(url, "://", 1)),
        "tld": F.when(F.length(host) > 0, F.element_at(labels, -1)),
        "domain": F.when(n >= 2, F.concat_ws(".", F.slice(labels, -2, 2))),
        "host": F.when(n >= 3, host),
        "sub": F.when(n >= 3, labels[0]),
        "dir": F.regexp_extract(path, r"^/([^/]+)/", 1),
        "leaf": F.when(F.length(path) > 0, F.concat(F.lit("/"), leaf)),
        "query": query,
    }
    tokens = F.array(*[F.when(F.length(value[s]) > 0, F.concat(F.lit(f"{s}="), value[s])) for s in SLOTS])
    known = (F.length(host) > 0) | (F.length(path) > 0)
    return F.when(known, F.array_compact(tokens)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> list[MinedRule]:
    """Rules from ``labelled`` (tokens array<string> without repeats, label string), best first.

    Rows without label are left out; no labelled rows give no rules. Every URL adds at most 255
    combinations, so at most 255 / ``min_support`` of them are frequent, however many URLs there
    are: that bounds what the driver holds. A rule goes if one with fewer of its tokens implies the
    same label as surely (it would never be the best one).
    """
    items = F.array_append("tokens", F.concat(F.lit("label="), F.col("label")))
    baskets = labelled.where(F.col("label").isNotNull()).select(items.alias("items"))
    n = baskets.count()
    if not n:
        return []
    labels = [r[0] for r in labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n")).where(f"n >= {min_count}").select("label").collect()]
    least = max(min_support, (min_count - 0.5) / n)  # what is rarer than min_count need not be mined
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    names = [f"label={x}" for x in labels]
    found = model.associationRules.where(F.col("consequent")[0].isin(names) & ~F.exists("antecedent", lambda x: x.startswith("label=")))
    count = F.round(F.col("support") * n).cast("long")
    rows = found.where(count >= min_count).select("antecedent", F.expr("substr(consequent[0], 7)").alias("verdict"), "confidence", count.alias("count")).collect()
    return prune([MinedRule(tuple(sorted(r.antecedent)), r.verdict, r.confidence, r["count"]) for r in rows])


def rank(rule: MinedRule) -> tuple:
    """Surest first, then best supported, then shortest, then by text."""
    return (-rule.confidence, -rule.count, len(rule.tokens), " ".join(rule.tokens), rule.verdict)


def prune(rules: Iterable[MinedRule]) -> list[MinedRule]:
    """The rules without those that a part of their tokens makes needless, best first."""
    kept = {(r.tokens, r.verdict): r.confidence for r in rules}

    def needless(r: MinedRule) -> bool:
        parts = (c for k in range(1, len(r.tokens)) for c in combinations(r.tokens, k))
        return any(kept.get((c, r.verdict), -1.0) >= r.confidence for c in parts)

    return sorted((r for r in rules if not needless(r)), key=rank)


class RuleIndex:
    """Inverted index: of every token the rules that hold it."""

    def __init__(self, rules: Sequence[MinedRule]) -> None:
        self.rules = list(rules)
        self.size = [len(r.tokens) for r in self.rules]
        self.postings: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(self.rules):
            for t in r.tokens:
                self.postings[t].append(i)
        self._seen: dict[tuple[str, ...], MinedRule | None] = {}

    def best(self, tokens: Sequence[str]) -> MinedRule | None:
        """The best rule whose tokens are all among ``tokens``."""
        key = tuple(sorted(tokens))
        if key not in self._seen:
            hits: dict[int, int] = defaultdict(int)
            for t in key:
                for i in self.postings.get(t, ()):
                    hits[i] += 1
            first = min((i for i, n in hits.items() if n == self.size[i]), default=None)
            if len(self._seen) > 100_000:
                self._seen.clear()
            self._seen[key] = None if first is None else self.rules[first]
        return self._seen[key]


def apply_rules(urls: DataFrame, rules: Sequence[MinedRule], default: str = DEFAULT) -> DataFrame:
    """Adds mined_rule and mined_verdict to rows with a ``__tokens`` column, in one pass."""
    spark = urls.sparkSession
    known = spark.sparkContext.broadcast([tuple(r) for r in rules])  # bounded, see mine()
    fields = urls.schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex([MinedRule(*r) for r in known.value])
        for batch in batches:
            best = [index.best(t or ()) for t in batch.column(fields.index("__tokens")).to_pylist()]
            rule = pa.array([str(r) if r else None for r in best], pa.string())
            verdict = pa.array([r.verdict if r else default for r in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*fields, "mined_rule", "mined_verdict"])

    added = [T.StructField(name, T.StringType()) for name in ("mined_rule", "mined_verdict")]
    return urls.mapInArrow(run, T.StructType([*urls.schema.fields, *added]))


def filter_urls(pages: DataFrame, rules: Sequence[ListRule], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
                default: str = DEFAULT, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict, mined_rule.

    A listed rule decides the pages it fits. The other ones get the verdict of their best mined rule
    or ``default``. ``labels`` (url, label) teaches the mined rules; without it the pages that a listed
    rule decides do, with its verdict as label. Pages of repeated ids are judged each; null, empty
    and malformed URLs have no host and path and get ``default``; an empty table gives no rows and
    teaches nothing. Other columns are ignored.
    """
    url = F.col("__url")
    host, path = host_and_path(url)
    base = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"))
    base = base.select("__id", "__url", host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    tokens = url_tokens(F.col("__url"), F.col("host"), F.col("path"))
    judged = base.select("__id", "host", "path", rule.alias("rule"), verdict.alias("__listed"), tokens.alias("__tokens"))
    if labels is None:
        taught = judged.select(F.col("__tokens").alias("tokens"), F.col("__listed").alias("label"))
    else:
        own = labels.select(F.col("url").cast("string").alias("__url"), F.col("label").cast("string").alias("label"))
        h, p = host_and_path(F.col("__url"))
        own = own.select("__url", "label", h.alias("host"), p.alias("path"))
        taught = own.select(url_tokens(F.col("__url"), F.col("host"), F.col("path")).alias("tokens"), "label")
    mined = mine(taught.where(F.size("tokens") > 0), min_support, min_count, min_confidence)
    out = apply_rules(judged, mined, default)
    by_rule = F.when(F.col("__listed").isNull(), F.col("mined_rule")).alias("mined_rule")
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("__listed", "mined_verdict").alias("verdict"), by_rule)
