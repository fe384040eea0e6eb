"""DuckDB SQL building blocks that restate the fact-table semantics for the oracle checks.

These strings are test oracles only: the engine itself never parses or runs SQL text.
"""

from __future__ import annotations

from typing import Sequence

AS_OF = "2026-12-01"

# Role columns of the driver's test tables (see FIXTURES.md, explicit overrides applied).
SQL_ROLES = {
    "events": dict(amount="value", ts="ts", user="user_id", category="event_type"),
    "orders": dict(amount="o_totalprice", ts="o_orderdate", user="o_custkey", category="o_orderstatus"),
    "lineitem": dict(amount="l_extendedprice", qty="l_quantity", ts="l_shipdate", category="l_returnflag",
                     product="l_partkey"),
    "customer": dict(amount="c_acctbal", category="c_mktsegment", product="c_name"),
}


def R(expr: str, d: int = 2) -> str:
    """Half-up rounding as the engine does it (non-finite -> 0, null stays null)."""
    s = 10 ** d
    return (f"(CASE WHEN ({expr}) IS NULL THEN NULL WHEN isfinite(CAST({expr} AS DOUBLE)) "
            f"THEN floor(CAST({expr} AS DOUBLE) * {s} + 0.5) / {s} ELSE 0.0 END)")


def part(by: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(by)}" if by else ""


def grp(by: Sequence[str]) -> str:
    return f"GROUP BY {', '.join(by)}" if by else ""


def sel(by: Sequence[str], prefix: str = "") -> str:
    return "".join(f"{prefix}{k}, " for k in by)


def on(by: Sequence[str]) -> str:
    return f"USING ({', '.join(by)})" if by else "ON TRUE"


def facts_cte(table: str, by: Sequence[str] = (), source: str | None = None, roles: dict | None = None) -> str:
    """WITH-chain ending in ``facts`` (and ``typed``) for a table and its roles."""
    r = roles or SQL_ROLES[table]
    src = source or table

    def dbl(c):
        return f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"
    amt = dbl(r["amount"]) if r.get("amount") else "CAST(NULL AS DOUBLE)"
    if r.get("ts"):
        t = f"CAST({r['ts']} AS TIMESTAMP)"
        ts = (f"CASE WHEN year({t}) > 1900 AND year({t}) < 2100 AND {t} <= TIMESTAMP '{AS_OF}' + INTERVAL 365 DAY "
              f"THEN {t} END")
    else:
        ts = "CAST(NULL AS TIMESTAMP)"
    qty = dbl(r["qty"]) if r.get("qty") else "CAST(NULL AS DOUBLE)"
    user = f"NULLIF(CAST({r['user']} AS VARCHAR), '')" if r.get("user") else "CAST(NULL AS VARCHAR)"
    cat = f"CAST({r['category']} AS VARCHAR)" if r.get("category") else "CAST(NULL AS VARCHAR)"
    prod = f"CAST({r['product']} AS VARCHAR)" if r.get("product") else "CAST(NULL AS VARCHAR)"
    keep = " AND ".join(["TRUE"] + (["amount IS NOT NULL"] if r.get("amount") else [])
                        + (["event_ts IS NOT NULL"] if r.get("ts") else []))
    b = sel(by)
    return f"""WITH dsrc AS (SELECT DISTINCT * FROM {src}),
raw_n AS (SELECT {b} COUNT(*) AS rows_before FROM {src} {grp(by)}),
typed AS (SELECT {b} {amt} AS amount, {ts} AS event_ts, {qty} AS qty, {user} AS user_key,
                 {cat} AS category, {prod} AS product FROM dsrc),
facts0 AS (SELECT * FROM typed WHERE {keep}),
iqr_r AS (SELECT {b} amount, row_number() OVER ({part(by)} ORDER BY amount) - 1 AS rn,
                 count(*) OVER ({part(by)}) AS n FROM facts0 WHERE amount IS NOT NULL),
iqr_b AS (SELECT {b} max(n) AS n, max(CASE WHEN rn = floor(n * 0.25) THEN amount END) AS q1,
                 max(CASE WHEN rn = floor(n * 0.75) THEN amount END) AS q3 FROM iqr_r {grp(by)}),
bnd AS (SELECT {b} n AS iqr_n, CASE WHEN n >= 4 THEN q1 END AS q1, CASE WHEN n >= 4 THEN q3 END AS q3,
               CASE WHEN n >= 4 THEN q1 - 1.5 * (q3 - q1) END AS iqr_lower,
               CASE WHEN n >= 4 THEN q3 + 1.5 * (q3 - q1) END AS iqr_upper FROM iqr_b),
facts AS (SELECT f.*, bnd.iqr_lower, bnd.iqr_upper,
                 coalesce(f.amount < bnd.iqr_lower OR f.amount > bnd.iqr_upper, false) AS is_iqr_outlier
          FROM facts0 f LEFT JOIN bnd {on(by)})"""


def describe_sql(source: str, value: str, by: Sequence[str] = ()) -> str:
    """T1 over ``source`` (a CTE or table) column ``value``: CTE text ending in ``described``."""
    b = sel(by)
    pcts = [("median", 0.5)] + [(f"p{p}", p / 100) for p in (5, 10, 25, 75, 90, 95, 99)]
    picks = ",\n".join(
        f"max(CASE WHEN rn = floor({q}::DOUBLE * (n - 1)) THEN x END) AS {nm}__lo, "
        f"max(CASE WHEN rn = ceil({q}::DOUBLE * (n - 1)) THEN x END) AS {nm}__hi, "
        f"max({q}::DOUBLE * (n - 1)) AS {nm}__pos" for nm, q in pcts)
    interp = ",\n".join(
        f"{R(f'{nm}__lo + ({nm}__hi - {nm}__lo) * ({nm}__pos - floor({nm}__pos))')} AS {nm}" for nm, q in pcts)
    return f"""d_x AS (SELECT {b} CAST({value} AS DOUBLE) AS x FROM {source}
               WHERE {value} IS NOT NULL AND isfinite(CAST({value} AS DOUBLE))),
d_r AS (SELECT {b} x, row_number() OVER ({part(by)} ORDER BY x) - 1 AS rn, count(*) OVER ({part(by)}) AS n,
               avg(x) OVER ({part(by)}) AS m FROM d_x),
d_a AS (SELECT {b} max(n) AS n, sum(x) AS s, avg(x) AS mean, stddev_pop(x) AS sd, var_pop(x) AS var,
               min(x) AS mn, max(x) AS mx, avg(power(x - m, 3)) AS m3, {picks}
        FROM d_r {grp(by)}),
described AS (SELECT {b} n, {R('s')} AS sum, {R('mean')} AS mean, {R('sd')} AS std, {R('var')} AS variance,
               {R('mn')} AS min, {R('mx')} AS max,
               {R('CASE WHEN sd > 0 THEN m3 / power(sd, 3) ELSE 0.0 END', 3)} AS skew, {interp}
        FROM d_a WHERE n > 0)"""


def regression_sql(series: str, value: str, order: str, by: Sequence[str] = (), name: str = "fit") -> str:
    """T2 over a series CTE: CTE ``{name}`` with points, slope, intercept, r2, usable."""
    b = sel(by)
    return f"""{name}_i AS (SELECT {b} {value} AS y, CAST(row_number() OVER ({part(by)} ORDER BY {order}) - 1 AS DOUBLE) AS x
                FROM {series}),
{name}_a AS (SELECT {b} count(*) AS points, regr_slope(y, x) AS sl, regr_intercept(y, x) AS ic,
                    regr_r2(y, x) AS r2raw, var_pop(y) AS vy FROM {name}_i {grp(by)}),
{name} AS (SELECT {b} points,
                  CASE WHEN points >= 2 THEN {R('sl')} ELSE 0.0 END AS slope,
                  CASE WHEN points >= 2 THEN {R('ic')} ELSE 0.0 END AS intercept,
                  {R('CASE WHEN points >= 2 AND vy > 0 THEN r2raw ELSE 0.0 END', 4)} AS r2,
                  coalesce(points >= 2 AND vy > 0 AND r2raw >= 0.5, false) AS usable
           FROM {name}_a)"""
