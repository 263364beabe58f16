"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evenhand.llm.registry import WORD, query, table, text_of
from evenhand.workspace import settle

BUCKET_DIGITS = 3  # hex digits of the order key: 4,096 buckets in each leaf


def weight_of(name: str, weights: Mapping[str, int]) -> Column:
    """Whole, positive weights by name; 1 where none is declared."""
    if any(not isinstance(w, int) or w < 1 for w in weights.values()):
        raise ValueError("weights must be whole and positive")
    out = F.lit(1)
    for key, weight in weights.items():
        out = F.when(F.col(name) == key, weight).otherwise(out)
    return out.cast("long")


def water_fill(children: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Split the `budget` of each parent over its children by `weight`, none above its `cap`.

    What a full child leaves over goes to its siblings by weight; only what all of them together
    cannot take is left at the parent, whose own cap (the sum of theirs) has told its siblings so.
    Shares are rounded down to whole tokens. Children are counts per node, never documents.
    """
    ratio = F.col("cap").cast("double") / F.col("weight")
    ordered = W.partitionBy(*parents).orderBy(ratio, name)
    all_of = W.partitionBy(*parents)
    before = F.coalesce(F.sum("cap").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(ordered.rowsBetween(W.currentRow, W.unboundedFollowing))
    full = F.col("cap").cast("double") * F.col("onward") <= (F.col("budget") - F.col("before")).cast("double") * F.col("weight")
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_of), F.lit(0))
    share = F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_of)
    part = F.floor(F.col("left").cast("double") * F.col("weight") / F.col("share"))
    return (
        children.withColumns({"before": before, "onward": onward}).withColumn("full", full)
        .withColumns({"left": left, "share": share})
        .withColumn("quota", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long"))
        .drop("before", "onward", "full", "left", "share")
    )


def leaf_quotas(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int
) -> DataFrame:
    """Quota in tokens of every leaf of `leaves` (the level columns and `total`).

    `budget` is an expression over the corpus total, `total`. Budgets go down level by level.
    """
    nodes = leaves.withColumn("cap", F.col("total") * max_epochs)
    given = nodes.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total")).select(budget.cast("long").alias("budget"))
    for depth, level in enumerate(levels):
        path = list(levels[:depth + 1])
        children = nodes.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(level, weights.get(level, {})))
        if depth == 0:  # the root is one row
            children = children.withColumn("budget", F.lit(given.first()["budget"]))
        else:
            children = children.join(allotted, path[:-1])  # noqa: F821  (set by the level above)
        filled = water_fill(children, path[:-1], level)
        allotted = filled.select(*path, F.col("quota").alias("budget"))
    return nodes.join(allotted, list(levels)).select(*levels, "total", F.col("budget").alias("quota"))


def mix(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], tokens: Column,
    key: str = "doc_id", budget: Column | None = None, max_epochs: int = 1, seed: int = 17,
) -> DataFrame:
    """Rows of `docs` that the mixture takes, with `copies`, `quota`, `tokens` and the levels in `mix`.

    `levels` names the tree from the root down. Null names count as the empty name. A leaf's quota
    is taken as whole epochs plus a token prefix of one more: its documents in the order of
    md5(seed:epoch:key), as long as their tokens fit. That order is cut into buckets by the leading
    digits; only the bucket in which the quota ends is sorted, so no leaf meets in one task.
    Documents without tokens are taken as often as whole epochs are, or if the prefix has room at
    their place. Rows with the same key and tokens are interchangeable. An empty table gives no rows.
    """
    names = list(levels)
    marked = docs.withColumn("mix", F.struct(*[F.coalesce(c, F.lit("")).alias(n) for n, c in levels.items()], tokens.cast("long").alias("tokens")))
    flat = marked.select(*[F.col(f"mix.{n}").alias(n) for n in names], F.col("mix.tokens").alias("tokens"))
    leaves = settle(flat.groupBy(*names).agg(F.sum("tokens").alias("total")), "leaf-totals")
    quotas = settle(
        leaf_quotas(leaves, names, weights, F.col("total") if budget is None else budget, max_epochs)
        .withColumn("epochs", F.when(F.col("total") > 0, F.expr("quota div total")).otherwise(0).cast("long"))
        .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("total"))
        .select(F.struct(*names).alias("leaf"), F.struct("quota", "epochs", "rest").alias("plan")),
        "leaf-quotas",
    )

    def ordered(df: DataFrame, by: DataFrame) -> DataFrame:
        order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("plan.epochs").cast("string"), F.col(key).cast("string")).cast("binary"))
        leaf = F.struct(*[F.col(f"mix.{n}").alias(n) for n in names])
        return df.withColumn("leaf", leaf).join(by, "leaf").withColumn("place", order)

    bucket = F.substring("place", 1, BUCKET_DIGITS)
    sums = (
        ordered(marked.select(key, "mix"), quotas).filter("plan.rest > 0")
        .groupBy("leaf", "plan", bucket.alias("bucket")).agg(F.sum("mix.tokens").alias("held"))
        .withColumn("below", F.sum("held").over(W.partitionBy("leaf").orderBy("bucket")) - F.col("held"))
    )
    # The prefix ends in the first bucket that it cannot take whole.
    ends = settle(
        sums.filter("below + held > plan.rest").groupBy("leaf").agg(F.min(F.struct("bucket", "below")).alias("stop")),
        "leaf-ends",
    )
    plans = settle(quotas.join(ends, "leaf", "left"), "leaf-plans")
    taken = ordered(marked, plans)
    prefix = F.col("plan.rest") > 0
    whole = taken.filter(~prefix | (bucket != F.col("stop.bucket"))).withColumn("fits", prefix & (bucket < F.col("stop.bucket")))
    run = F.sum("mix.tokens").over(W.partitionBy("leaf").orderBy("place", "mix.tokens").rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = taken.filter(prefix & (bucket == F.col("stop.bucket"))).withColumn("fits", F.col("stop.below") + run <= F.col("plan.rest"))
    copies = F.col("plan.epochs") + F.when(F.col("fits"), 1).otherwise(0)
    return (
        whole.unionByName(edge).withColumn("copies", copies.cast("long")).filter("copies > 0")
        .withColumn("quota", F.col("plan.quota")).drop("leaf", "plan", "stop", "place", "fits")
    )


#: The mixture of the registered query and of the pipeline.
WEIGHTS = {"domain": {"d0": 4, "d1": 2}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src0": 1, "src1": 3}}
DOMAINS = 4


def domain_of(source: Column) -> Column:
    """Sources are dealt to domains by their name."""
    return F.concat(F.lit("d"), (F.ascii(F.md5(F.coalesce(source, F.lit("")).cast("binary"))) % DOMAINS).cast("string"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def levels() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def _level_sql(name: str, path: str, above: str) -> str:
    """Water filling of one level in SQL; `above` holds the budgets of its parents."""
    weights = " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS[name].items())
    parents = path.removesuffix(f"{name}").rstrip(", ")
    part = f"PARTITION BY {parents} " if parents else ""
    joined = f"JOIN {above} USING ({parents})" if parents else f"CROSS JOIN {above}"
    return f"""
n_{name} AS (SELECT {path}, sum(cap)::BIGINT AS cap, (CASE {name} {weights} ELSE 1 END)::BIGINT AS weight FROM nodes GROUP BY ALL),
o_{name} AS (SELECT n.*, budget,
    coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_it,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS onward
  FROM n_{name} n {joined} WINDOW w AS ({part}ORDER BY cap::DOUBLE / weight, {name})),
f_{name} AS (SELECT *, cap::DOUBLE * onward <= (budget - before_it)::DOUBLE * weight AS is_full FROM o_{name}),
s_{name} AS (SELECT *, budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0)::BIGINT AS unspent,
    sum(CASE WHEN NOT is_full THEN weight END) OVER ({part})::BIGINT AS share FROM f_{name}),
b_{name} AS (SELECT {path}, (CASE WHEN is_full THEN cap ELSE floor(unspent::DOUBLE * weight / share) END)::BIGINT AS budget FROM s_{name})"""


@query("op5_mix", rf"""
WITH docs AS (
  SELECT doc_id, 'd' || (ascii(md5(coalesce(source, ''))) % {DOMAINS})::VARCHAR AS domain, coalesce(lang, '') AS lang,
         coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS tokens FROM documents),
nodes AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS total, 2 * sum(tokens)::BIGINT AS cap FROM docs GROUP BY ALL),
root AS (SELECT (coalesce(sum(total), 0) * 6 // 10)::BIGINT AS budget FROM nodes),
{_level_sql("domain", "domain", "root")},
{_level_sql("lang", "domain, lang", "b_domain")},
{_level_sql("source", "domain, lang, source", "b_lang")},
plans AS (SELECT domain, lang, source, budget AS quota, CASE WHEN total > 0 THEN budget // total ELSE 0 END AS epochs,
    budget - CASE WHEN total > 0 THEN budget // total ELSE 0 END * total AS rest
  FROM nodes JOIN b_source USING (domain, lang, source)),
placed AS (SELECT d.*, quota, epochs, rest, sum(tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5('17:' || epochs || ':' || doc_id), tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM docs d JOIN plans USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, quota, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM placed WHERE epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
""")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", word_count(text_of()).alias("tokens"))
    mixed = mix(settle(docs, "mix-words"), levels(), WEIGHTS, F.col("tokens"), budget=F.expr("total * 6 div 10"), max_epochs=2)
    return mixed.select("doc_id", "mix.domain", "mix.lang", "mix.source", "tokens", "quota", "copies")
