"""Named DuckDB subqueries and a helper that puts the needed ones in front of a query.

These state the expected results independently of the Spark code: plain unions, unnests and
window functions over whole tables.
"""

from __future__ import annotations

import re
from statistics import NormalDist

from checks.fixtures import MIN_CELL_GAMES, MIN_GAMES, RAW_MATCHES, strength

Z = NormalDist().inv_cdf(0.975)
ZB = NormalDist().inv_cdf(0.8)

VALID = """len(r) = 5 AND len(d) = 5
    AND NOT list_contains(list_concat(r, d), 0) AND len(list_distinct(list_concat(r, d))) = 10
    AND coalesce(duration, 0) >= 900 AND avg_rank_tier IS NOT NULL"""


def wilson(wins: str, games: str) -> tuple[str, str]:
    p = f"({wins} / CAST({games} AS DOUBLE))"
    centre = f"(({p} + {Z * Z} / (2 * {games})) / (1 + {Z * Z} / {games}))"
    half = (
        f"({Z} * sqrt({p} * (1 - {p}) / {games} + {Z * Z} / (4 * CAST({games} AS DOUBLE) * {games}))"
        f" / (1 + {Z * Z} / {games}))"
    )
    return f"({centre} - {half})", f"({centre} + {half})"


def binomial(wins: str, games: str) -> str:
    """Exact two-sided p-value against one half as a sum of point probabilities."""
    m = f"least({wins}, {games} - {wins})"
    return (
        f"CASE WHEN 2 * {m} = {games} THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma({games} + 1.0)"
        f" - lgamma(i + 1.0) - lgamma({games} - i + 1.0) - {games} * ln(2.0)))"
        f" FROM unnest(generate_series(0, {m})) AS g(i))) END"
    )


def n_per_group(p1: str, p2: str, za: str = str(Z), zb: str = str(ZB)) -> str:
    bar = f"(({p1} + {p2}) / 2)"
    return (
        f"(pow({za} * sqrt(2 * {bar} * (1 - {bar})) + {zb} * sqrt({p1} * (1 - {p1}) + {p2} * (1 - {p2})), 2)"
        f" / pow({p2} - {p1}, 2))"
    )


_LO, _HI = wilson("wins", "games")

CTES: dict[str, str] = {
    "raw_matches": RAW_MATCHES.format(orders="orders"),
    "listed": """SELECT *, CAST(str_split(radiant_team, ' ') AS INT[]) AS r,
        CAST(str_split(dire_team, ' ') AS INT[]) AS d FROM raw_matches""",
    "trials": f"""SELECT match_id, start_time, duration, avg_rank_tier, CAST(avg_rank_tier // 10 AS BIGINT) AS bracket,
        radiant_win, r, d FROM listed WHERE game_mode = 22 AND {VALID}""",
    "facts": """SELECT match_id, bracket, 'radiant' AS side, unnest(r) AS hero_id, radiant_win AS won FROM trials
        UNION ALL
        SELECT match_id, bracket, 'dire' AS side, unnest(d) AS hero_id, 1 - radiant_win AS won FROM trials""",
    "heroes": """SELECT CAST(p_partkey AS INT) AS hero_id, p_name || ' ' || p_partkey AS name,
        p_type AS primary_attr, p_brand AS attack_type, p_type || '|' || p_brand AS roles
        FROM part WHERE p_partkey % 127 <> 0""",
    "rates": """SELECT f.hero_id, h.name, h.primary_attr, COUNT(*) AS games, CAST(SUM(won) AS BIGINT) AS wins,
        SUM(won) / CAST(COUNT(*) AS DOUBLE) AS win_rate,
        COUNT(*) / CAST((SELECT COUNT(*) FROM trials) AS DOUBLE) AS pick_rate
        FROM facts f JOIN heroes h USING (hero_id) GROUP BY ALL""",
    "stratum_rates": f"""SELECT f.bracket, f.hero_id, h.name, COUNT(*) AS games,
        CAST(SUM(won) AS BIGINT) AS wins, SUM(won) / CAST(COUNT(*) AS DOUBLE) AS win_rate
        FROM facts f JOIN heroes h USING (hero_id) GROUP BY ALL HAVING COUNT(*) >= {MIN_CELL_GAMES}""",
    "usable": "SELECT bracket, COUNT(*) AS entities FROM stratum_rates GROUP BY bracket HAVING COUNT(*) >= 60",
    "pairs": """SELECT a.hero_id, a.name, a.bracket AS low_bracket, b.bracket AS high_bracket,
        a.win_rate AS low, b.win_rate AS high, (b.win_rate - a.win_rate) * 100 AS delta_pp
        FROM stratum_rates a JOIN stratum_rates b USING (hero_id)
        WHERE a.bracket = (SELECT min(bracket) FROM usable) AND b.bracket = (SELECT max(bracket) FROM usable)
          AND a.bracket < b.bracket""",
    "tests": f"""SELECT *, {binomial('wins', 'games')} AS p_value, {_LO} AS ci_low, {_HI} AS ci_high
        FROM rates WHERE games >= {MIN_GAMES}""",
    "corrected": """SELECT *, least(1.0, min(p_value * m / rnk) OVER (ORDER BY p_value DESC
            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q_value
        FROM (SELECT *, count(*) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rnk,
                     count(*) OVER () AS m FROM tests)""",
    "verdicts": """SELECT * EXCLUDE (rnk, m), q_value <= 0.05 AS significant,
        ci_low > 0.52 OR ci_high < 0.48 AS outside_tolerance,
        CASE WHEN ci_low > 0.52 THEN 'nerf candidate' WHEN ci_high < 0.48 THEN 'buff candidate'
             ELSE 'within tolerance' END AS action
        FROM corrected""",
    "ids": "SELECT hero_id, row_number() OVER (ORDER BY hero_id) - 1 AS col FROM (SELECT DISTINCT hero_id FROM facts)",
    "predictions": f"""SELECT match_id, model, CASE model WHEN 'const' THEN 0.53 ELSE 1 / (1 + exp(-(0.11 + CAST(0.24 AS DOUBLE) *
            CASE model WHEN 'full' THEN z_all ELSE z_even END / CAST(63.0 AS DOUBLE)))) END AS p, y
        FROM (SELECT match_id, radiant_win AS y,
                list_sum([{strength('h')} for h in r]) - list_sum([{strength('h')} for h in d]) AS z_all,
                coalesce(list_sum([{strength('h')} for h in r if h % 2 = 0]), 0)
                  - coalesce(list_sum([{strength('h')} for h in d if h % 2 = 0]), 0) AS z_even
              FROM trials), (VALUES ('full'), ('half'), ('const')) AS m(model)""",
}


def sql(select: str) -> str:
    """`WITH` every subquery that `select` needs, directly or through others, then `select`."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                visit(body)
                needed.append(name)

    visit(select)
    if not needed:
        return select
    with_clause = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    own = select.strip()
    return f"WITH {with_clause},\n{own[len('WITH'):]}" if own.startswith("WITH") else f"WITH {with_clause}\n{own}"
