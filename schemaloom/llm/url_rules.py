"""URL filters: listed rules first, then association rules that FP-growth mines from labelled pages.

A page is bad if its label says low quality or toxic. The tokens of labelled urls (host labels, domain, path
segments, query keys) are items, badness is one more, and FP-growth finds the token combinations that imply it. Tokens that
always occur together are one item, and one that every labelled url has is none: neither changes what a rule says.
Rules are pruned by support, confidence and lift. For matching, each rule is filed under its rarest token;
the tokens of each distinct url look up that inverted index, and a rule fires if the url has all its
tokens. DataFrame functions and the JVM's FP-growth only.

Edge cases: a null url or one without ``://`` has an empty host and path and no tokens, so it is allowed
unless a listed rule says else; no labelled pages, no mined rules; repeated urls are matched once and joined
back; repeated or null page ids are rows of their own; several labels of a page count as bad if any is; of rules of equal
confidence the one whose tokens sort last is told; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.shared import Scratch

BAD = "@bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlParams:
    """``listed``: (verdict, host and path prefix). ``min_support``: share of labelled pages, of ``min_count`` at least."""

    listed: tuple[tuple[str, str], ...] = (
        ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
    )
    min_support: float = 0.002
    min_count: int = 10
    min_confidence: float = 0.6
    min_lift: float = 1.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path; both empty if there is none."""
    rest = F.when(F.contains(url, F.lit("://")), url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: its host's labels and domain, path segments (numbers as one), query keys."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    tag = lambda name, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(name), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    domain = F.when(F.size(labels) > 1, F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(tag("h:", labels), domain, tag("p:", segments), tag("q:", keys)))


def listed_rule(host: Column, path: Column, listed: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule whose host is the url's or above it and whose path begins the url's."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(listed, key=lambda x: len(x[1])):
        above, _, below = text.partition("/")
        fits = ((host == above) | F.endswith(host, F.lit(f".{above}"))) & F.startswith(path, F.lit(f"/{below}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def mine(pages: DataFrame, labels: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    """(antecedent, confidence, support, lift, token): the pruned rules, each with its rarest token."""
    spark = pages.sparkSession
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")).filter("bad IS NOT NULL AND doc_id IS NOT NULL")
    page = pages.select("page_id", "url").join(bad, F.col("page_id") == F.col("doc_id")).select("bad", tokens(F.col("url")).alias("items"), F.xxhash64(F.monotonically_increasing_id()).alias("row"))
    with Scratch(spark) as scratch:  # rows are numbered once
        page = scratch.table(page, "labelled")
        n = page.count()
        least = max(p.min_count, math.ceil(p.min_support * n))
        if n < least:
            return spark.createDataFrame([], "antecedent array<string>, confidence double, support double, lift double, token string")
        entries = page.select("row", F.explode("items").alias("token"))
        item = entries.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("row").cast("decimal(38,0)")).alias("rows"))
        often = scratch.table(item.filter((F.col("n") >= least) & (F.col("n") < n)), "items")
        merged = often.groupBy("n", "rows").agg(F.sort_array(F.collect_list("token")).alias("members"))  # of one url at most
        merged = scratch.table(merged.select(F.col("members")[0].alias("item"), "members"), "merged")
        firsts = entries.join(merged.select(F.col("item").alias("token")), "token")
        baskets = page.select("row", "bad").join(firsts.groupBy("row").agg(F.collect_list("token").alias("items")), "row", "left")
        badness = F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
        baskets = baskets.select(F.concat(F.coalesce("items", F.array().cast("array<string>")), badness).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=p.min_confidence).fit(baskets)
        rules = model.associationRules.filter((F.col("consequent")[0] == BAD) & (F.col("lift") >= p.min_lift)).select("antecedent", "confidence", "support", "lift")
        whole = rules.select(F.col("antecedent").alias("a"), "confidence", "support", "lift", F.explode("antecedent").alias("item")).join(merged, "item")
        whole = whole.select("a", "confidence", "support", "lift", F.explode("members").alias("token")).join(often.select("token", "n"), "token")
        found = whole.groupBy("a", "confidence", "support", "lift").agg(F.sort_array(F.collect_list("token")).alias("antecedent"), F.min_by("token", F.struct("n", "token")).alias("token"))
        return scratch.result(found.drop("a"), "rules")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, pattern, confidence) of each distinct url that has all tokens of a rule; the surest rule is told."""
    looked = urls.select("url").filter(F.col("url").isNotNull()).distinct().withColumn("items", tokens(F.col("url"))).withColumn("token", F.explode("items"))
    fired = looked.join(rules, "token").filter(F.size(F.array_except("antecedent", "items")) == 0)
    pattern = F.array_join(F.sort_array("antecedent"), " ")
    best = fired.groupBy("url").agg(F.max(F.struct("confidence", pattern.alias("pattern"))).alias("m"))
    return best.select("url", "m.pattern", "m.confidence")


def judge(pages: DataFrame, labels: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern and confidence of each page."""
    found = match(pages, mine(pages, labels, p))
    rows = pages.select("page_id", "url").join(found, "url", "left")
    host, path = host_and_path(F.col("url"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), p.listed)
    return (
        rows.withColumn("host", host).withColumn("path", path)
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")).alias("verdict"), "pattern", "confidence")
    )


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
