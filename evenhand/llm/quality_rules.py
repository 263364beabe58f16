"""Quality rules: a table of thresholds compiled into one projection of ratios, without user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.registry import query, table, text_of

WHITE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on with as be by this are at from "
    "de la le et les des en un du une que est pour qui dans par au sur pas avec "
    "der die und den von zu das mit sich ist nicht ein eine dem auf im für als auch "
    "el los se del las por no con una su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """`top` divided by `under` (a measure, or 1) must lie within [least, most]; an open end is None."""

    name: str
    top: str
    under: str | None = None
    least: float | None = None
    most: float | None = None


#: The table. Measures are columns of `measures`; a ratio over nothing counts as 0.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=0.3),
    Rule("letter_words", "n_letter_words", "n_words", least=0.6),
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, within the same projection."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def repeat_words(words: Column, width: int = REPEAT_WINDOW) -> Column:
    """How many of `words` lie in a run of `width` words that the text holds twice or more.

    Runs meet by a 64-bit hash first; only where one recurs are runs sorted, and then compared as
    strings, so that the count is exact. Sorting keeps the cost of long texts near linear.
    """
    def recurring(rows: Column, by: str) -> Column:
        same = lambda x, at: F.coalesce(F.get(rows, at)[by] == x[by], F.lit(False))
        return F.filter(rows, lambda x, i: same(x, i - 1) | same(x, i + 1))

    def written_out(places: Column) -> Column:
        run = lambda x: F.struct(F.array_join(F.slice(words, x["at"] + 1, width), " ").alias("run"), x["at"].alias("at"))
        return bind(F.array_sort(F.transform(places, run)), lambda rows: bind(
            F.array_sort(F.transform(recurring(rows, "run"), lambda x: x["at"])), covered))

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda s, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - s, F.lit(width))))
        return F.aggregate(reach, F.lit(0), lambda total, n: total + n)

    def among(hashes: Column) -> Column:
        places = F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            bind(F.array_sort(places), lambda rows: written_out(recurring(rows, "hash"))))

    def hashed(one: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(one) - width)
        return bind(F.transform(starts, lambda i: F.xxhash64(*[F.get(one, i + k) for k in range(width)])), among)

    return F.when(F.size(words) < width, 0).otherwise(bind(F.transform(words, lambda w: F.xxhash64(w)), hashed))


WORD_MEASURES = ("n_words", "word_chars", "n_repeat_words", "n_stop_words", "n_letter_words")
LINE_MEASURES = ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")


def measures(text: Column) -> Column:
    """A struct of all counts that rules refer to (longs), of a text that is not null."""
    def of_words(words: Column) -> dict[str, Column]:
        return {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_repeat_words": repeat_words(words),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
            "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
        }

    def of_lines(lines: Column) -> dict[str, Column]:
        return {
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z"))),
        }

    def pack(columns: dict[str, Column]) -> Column:
        return F.struct(*[c.cast("long").alias(n) for n, c in columns.items()])

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    parts = F.struct(
        bind(words_of(text), lambda w: pack(of_words(w))).alias("words"), bind(lines, lambda x: pack(of_lines(x))).alias("lines"),
        symbols.cast("long").alias("n_symbols"))
    return bind(parts, lambda p: F.struct(
        *[p["words"][n].alias(n) for n in WORD_MEASURES], *[p["lines"][n].alias(n) for n in LINE_MEASURES], p["n_symbols"].alias("n_symbols")))


def failed_rules(counts: Column, rules: Iterable[Rule] = RULES) -> Column:
    """Names of the rules that the struct `counts` breaks, in the order of the table."""
    checks = []
    for rule in rules:
        top = counts[rule.top].cast("double")
        value = F.when(counts[rule.under] == 0, 0.0).otherwise(top / counts[rule.under]) if rule.under else top
        broken = F.lit(False)
        if rule.least is not None:
            broken = broken | (value < float(rule.least))
        if rule.most is not None:
            broken = broken | (value > float(rule.most))
        checks.append(F.when(broken, F.lit(rule.name)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, keep: Iterable[str] = ("doc_id",), text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """The columns `keep` of every row of `docs`, its counts, `base_failed`, `failed_rules` and `kept`.

    Words are runs outside ASCII white space of the whole text. `base_failed`: under 20 words, or over
    30 % of them in repeated runs of eight. `kept` needs that to be false and no broken rule. All of it
    is one projection over the scan: no shuffle, no state, any row on its own. A null text has no words
    and no lines, like an empty one, and fails the base check; repeated rows are judged alike; an empty
    table gives no rows. Columns of `docs` outside `keep` play no part, whatever their names; those in
    `keep` must not be named like a result.
    """
    counts = bind(text_of(text), lambda t: bind(measures(t), lambda m: F.struct(
        m.alias("m"), failed_rules(m, rules).alias("failed"),
        ((m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])).alias("base"))))
    judged = docs.select(*keep, counts.alias("rules__"))
    return judged.select(
        *keep, "rules__.m.*", F.col("rules__.base").alias("base_failed"), F.array_join("rules__.failed", ",").alias("failed_rules"),
        (~F.col("rules__.base") & (F.size("rules__.failed") == 0)).alias("kept"))


def _rules_sql(rules: Iterable[Rule]) -> str:
    parts = []
    for r in rules:
        value = f"CASE WHEN {r.under} = 0 THEN 0 ELSE {r.top}::DOUBLE / {r.under} END" if r.under else f"{r.top}::DOUBLE"
        broken = [f"({value}) {sign} {bound}::DOUBLE" for sign, bound in (("<", r.least), (">", r.most)) if bound is not None]
        parts.append(f"CASE WHEN {' OR '.join(broken)} THEN '{r.name}' END")
    return f"concat_ws(',', {', '.join(parts)})"


_BLANK = r"[\x20\x09-\x0D]"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
runs AS (SELECT r, i, array_to_string(ws[i:i + {REPEAT_WINDOW - 1}], ' ') AS run
         FROM (SELECT r, ws, unnest(range(1, len(ws) - {REPEAT_WINDOW - 2})) AS i FROM w WHERE len(ws) >= {REPEAT_WINDOW})),
again AS (SELECT r, i FROM runs QUALIFY count(*) OVER (PARTITION BY r, run) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM again, range({REPEAT_WINDOW}) AS s(j) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{s}'" for s in STOP_WORDS)}], lower(x)))) AS n_stop_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words, len(ls) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^{_BLANK}*[-*•]'))) AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…){_BLANK}*$'))) AS n_ellipsis_lines
  FROM d JOIN w USING (r) JOIN lines USING (r) LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {_rules_sql(RULES)} AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules, NOT base_failed AND failed_rules = '' AS kept
FROM judged
"""


@query("op11_quality_rules", ORACLE)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    judged = apply_rules(table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept")
