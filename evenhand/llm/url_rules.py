"""URL rules by hashed expressions.

Every URL is expanded into host-suffix and path-prefix expressions, which meet the rules in an
equi-join on a short digest prefix; the full digest and the expression confirm a hit, and the
longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.registry import ascii_lower, query, table

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def hashed_rules(rules: DataFrame) -> DataFrame:
    """One row per distinct expression of `rules` (host, path, verdict).

    Of equal expressions with different verdicts `block` holds. Rules without a host are left out;
    a null path is empty, a null verdict counts as `allow`.
    """
    rule = F.concat("host", F.coalesce("path", F.lit("")))
    return (
        rules.filter(F.length("host") > 0)
        .groupBy(rule.alias("rule"), F.col("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
        .agg(F.max((F.col("verdict") == "block").cast("int")).alias("blocks"))
        .select(
            "rule", _labels(F.col("rule_host")).alias("labels"), F.length("rule_path").alias("path_chars"),
            F.when(F.col("blocks") == 1, "block").otherwise("allow").alias("verdict"),
            F.sha2("rule", 256).alias("rule_digest"),
        )
        .withColumn("digest_prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict; one row for every row of `pages`.

    A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the
    rule's path, at any character. The longest rule by characters wins, of equally long ones the one
    with the longer host. Only the shapes (labels of the host, length of the path) that occur among
    the rules are expanded, so every rule is found and long URLs cost no more than short ones. Equal
    hosts and paths are judged once. Null or malformed URLs have an empty host and path, match no
    rule and get `default`. Columns of `pages` named like a result column are replaced.
    """
    hashed = hashed_rules(rules)
    # Distinct shapes: at most the labels of a host times the lengths of a path, however many rules.
    shapes = [(r["labels"], r["path_chars"]) for r in hashed.select("labels", "path_chars").distinct().collect()]
    pages = pages.drop("rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if not shapes:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    def expression(labels: int, chars: int) -> Column:
        fits = (_labels(F.col("host")) >= labels) & (F.length("path") >= chars)
        return F.when(fits, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)))

    asked = (
        pages.filter(F.length("host") > 0).select("host", "path").distinct()
        .select("host", "path", F.explode(F.array(*[expression(n, c) for n, c in sorted(shapes)])).alias("expression"))
        .filter(F.col("expression").isNotNull())
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("digest_prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    confirmed = (F.col("digest") == F.col("rule_digest")) & (F.col("expression") == F.col("rule"))
    rank = F.struct(F.length("rule"), F.length("rule") - F.col("path_chars"), F.col("rule"))
    best = (
        asked.join(hashed, "digest_prefix").filter(confirmed)
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("won"))
        .select("host", "path", "won.rule", "won.verdict")
    )
    return pages.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


#: Fixed values of the contract: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op7_url_rules", rf"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '{URL_PARTS}', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '{URL_PARTS}', 2) AS path
  FROM pages)
SELECT page_id, host, path,
       CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
       CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'allow'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'block'
            WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'allow'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'block' ELSE 'allow' END AS verdict
FROM parts
""")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")
