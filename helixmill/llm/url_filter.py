"""URL filter: pattern rules indexed by their rarest literal token.

A rule's regular expression runs on `host || path` and carries the literal tokens that any match must contain.
Token frequencies are counted over all distinct URLs; each rule is filed under the rarest of its tokens; a URL's
tokens fetch the rules filed under them, and only those rules run their expression.

Defined cases: a null URL or one without `://` has an empty host and path and no rule; repeated URLs are judged once
and joined back, so repeated rows, null ids and further columns of any name but `judged` pass through; a rule without a token is
tried on every URL; of several fitting rules of one layer the longest wins, then the smallest name. Empty tables give
empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from helixmill.llm.common import fresh

#: Rules up to this many bytes are broadcast; larger lists are shuffle-joined.
BROADCAST_RULE_BYTES = 8 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """layer 0 goes before layer 1; size ranks within a layer."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    layer: int = 0
    size: int = 0


def tokens_of(literal: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", literal.lower())))


def host_rule(action: str, host_path: str) -> Rule:
    """A rule like `example.net/en/`: the host, its subdomains, and paths that start so."""
    host, slash, path = host_path.partition("/")
    return Rule(host_path, action, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(slash + path), tokens_of(host + "/" + path.rpartition("/")[0]), 0, len(host_path))


def pattern_rule(action: str, name: str, pattern: str, tokens: tuple[str, ...]) -> Rule:
    """tokens: alphanumeric runs, bounded on both sides, that every match contains."""
    return Rule(name, action, pattern, tokens, 1, len(name))


BASE_RULES = (host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"))
PATTERN_RULES = (
    pattern_rule("block", "cheap-pills", r"(?:^|[./-])cheap[-_]pills(?:[./-]|$)", ("cheap", "pills")),
    pattern_rule("block", "spam-farm", r"(?:^|[./-])spam[-_]farm(?:[./-]|$)", ("spam", "farm")),
    pattern_rule("block", "casino-bonus", r"(?:^|[./-])casino[-_]bonus(?:[./-]|$)", ("casino", "bonus")),
    pattern_rule("block", "adult-content", r"/(?:adult|xxx)[-_/]content(?:[./-]|$)", ("content",)),
    pattern_rule("block", "click-tracker", r"^(?:[^/]*\.)?(?:click|trk)[0-9]*\.tracker\.", ("tracker",)),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host's A-Z are lower-cased; both are empty without a `://`."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules_frame(spark, rules) -> DataFrame:
    kind = T.StructType([T.StructField("rule", T.StringType()), T.StructField("action", T.StringType()), T.StructField("pattern", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("layer", T.IntegerType()), T.StructField("size", T.IntegerType())])
    return spark.createDataFrame([(r.name, r.action, r.pattern, list(r.tokens), r.layer, r.size) for r in rules], kind)


def judge_urls(pages: DataFrame, rules, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with struct column `judged`: host, path, rule (of the winning rule or null), layer, verdict."""
    spark = pages.sparkSession
    small = sum(len(r.pattern) + sum(map(len, r.tokens)) + 64 for r in rules) <= BROADCAST_RULE_BYTES
    held = F.broadcast if small else (lambda x: x)
    ruled = rules_frame(spark, rules)
    pages = pages.drop("judged") if url != "judged" else pages
    key, won = fresh([*pages.columns, "judged"], "__key", "__won")
    own = pages.withColumn(key, F.coalesce(F.col(f"`{url}`"), F.lit("")))
    host, path = host_and_path(F.col("__url"))
    urls = own.select(F.col(key).alias("__url")).distinct().withColumns({"__host": host, "__path": path}).withColumn("__text", F.concat("__host", "__path"))
    urls = urls.withColumn("__tokens", F.array_distinct(F.split(F.translate("__text", UPPER, LOWER), r"[^a-z0-9]+")))
    literals = ruled.select(F.explode("tokens").alias("__token")).distinct()
    tokens = urls.select("__url", "__text", F.explode("__tokens").alias("__token"))
    often = tokens.select("__token").join(held(literals), "__token").groupBy("__token").agg(F.count("*").alias("__often"))
    # each rule under its rarest token; a token that no URL has fetches nothing, and neither could the rule match
    rarest = (
        ruled.withColumn("__token", F.explode("tokens"))
        .join(often, "__token", "left")
        .groupBy("rule", "action", "pattern", "layer", "size")
        .agg(F.min(F.struct(F.coalesce("__often", F.lit(0)).alias("n"), F.col("__token").alias("token"))).alias("__rarest"))
        .select("rule", "action", "pattern", "layer", "size", F.col("__rarest.token").alias("__token"))
    )
    fetched = tokens.join(held(rarest), "__token").drop("__token")
    if any(not r.tokens for r in rules):
        bare = [r for r in rules if not r.tokens]
        every = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"), F.lit(r.layer).alias("layer"), F.lit(r.size).alias("size")) for r in bare]))
        fetched = fetched.select("__url", "__text", "rule", "action", "pattern", "layer", "size").unionByName(urls.select("__url", "__text", every.alias("x")).select("__url", "__text", "x.*"))
    best = (
        fetched.where(F.expr("regexp(__text, pattern)"))
        .groupBy("__url")
        .agg(F.min(F.struct("layer", (-F.col("size")).alias("size"), "rule", "action")).alias("__best"))
    )
    joined = own.join(best.select(F.col("__url").alias(won), F.col("__best").alias(won + "_best")), own[key] == F.col(won), "left")
    host, path = host_and_path(F.col(key))
    winner = F.col(won + "_best")
    judged = F.struct(host.alias("host"), path.alias("path"), winner["rule"].alias("rule"), winner["layer"].alias("layer"), F.coalesce(winner["action"], F.lit(default)).alias("verdict"))
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns if c != "judged"], judged.alias("judged"))


def url_verdicts(pages: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    rule = F.when(F.col("judged.layer") == 0, F.col("judged.rule")).alias("rule")
    return judge_urls(pages.select("page_id", "url"), BASE_RULES + PATTERN_RULES).select("page_id", "judged.host", "judged.path", rule, "judged.verdict")
