"""Registered queries of the composed battery: judgments, detectors, findings, grades, metrics.

Each runs over a whole table, for the table as one group or for many groups at once.  ``tenants`` is the
events table dirtied row by row (unreadable amounts, a spike day, zeros, refunds, gaps, rising prices with
falling quantities, a dominant category), a tenant for each event type, so that every branch of the
judgments is reached.  The DuckDB SQL restates all columns, sentences included.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Roles
from ..operators import anomalies as A
from ..operators import metrics as M
from ..operators import report as RP
from ..operators.judge import dominance, judgment
from ..session import land
from ..texts import CHECK, DETAIL, FALSIFIABILITY, IMPLICATION, PREAMBLE, QUALITY_WARNING, REASON
from .analyse import analyse
from .oracle import AS_OF, R, describe_sql, facts_cte, grp, on, part, regression_sql, sel
from .queries import ROLES, facts, facts_of, load, register
from .sqltext import inr_sql, numtext_sql

# ---------------------------------------------------------------- the tenants variant: the same text in both engines
_D = "day(ts)"
_FACTOR = f"""CASE event_type WHEN 'click' THEN CASE WHEN {_D} = 7 THEN 60e0 ELSE 1e0 END WHEN 'view' THEN 1e0 + {_D}
 WHEN 'purchase' THEN CASE WHEN user_id % 10 = 0 THEN 0e0 ELSE 1e0 + {_D} / 3e0 END
 WHEN 'signup' THEN CASE WHEN user_id % 3 = 0 THEN 20e0 WHEN user_id % 11 = 1 THEN -1e0 ELSE 1e0 END ELSE 1e0 END"""
_BAD = "(event_type = 'view' AND event_id % 5 = 0) OR (event_type = 'error' AND event_id % 5 < 2)"
_SHIFT = f"CASE WHEN event_type = 'purchase' THEN {_D} * 3 WHEN event_type = 'view' AND {_D} > 20 THEN 40 ELSE 0 END"
_QTY = f"CASE WHEN event_type = 'purchase' THEN 100e0 - 3 * {_D} ELSE 1e0 + user_id % 4 END"
TENANTS_SQL = f"""(SELECT event_id, event_type AS tenant, CASE WHEN NOT ({_BAD}) THEN value * {_FACTOR} END AS paid,
 ts + to_days(CAST({_SHIFT} AS INTEGER)) AS paid_at, {_QTY} AS pieces, user_id, 'c' || (user_id % 3) AS kind FROM events)"""
TENANT_ROLES = Roles(revenue="paid", date="paid_at", user_id="user_id", category="kind", quantity="pieces")
_TENANT_SQL_ROLES = dict(amount="paid", ts="paid_at", user="user_id", category="kind", qty="pieces")


def tenants(spark, sf):
    """Events with a tenant for each type; the amount is text and partly unreadable."""
    return load(spark, sf, "events").selectExpr(
        "event_id", "event_type AS tenant", f"CASE WHEN {_BAD} THEN 'n/a' ELSE concat('₹', CAST(value * {_FACTOR} AS STRING)) END AS paid",
        f"CAST(ts AS TIMESTAMP) + make_dt_interval({_SHIFT}) AS paid_at", f"{_QTY} AS pieces", "user_id", "concat('c', user_id % 3) AS kind")


def _tenant_facts(spark, sf, by=("tenant",)):
    return facts_of(spark, sf, "tenants", tenants, TENANT_ROLES, by)


# events with amounts that rise from day to day
RISING_SQL = f"(SELECT event_id, ts, user_id, event_type, value * (1e0 + {_D}) AS value FROM events)"


def rising(spark, sf):
    return load(spark, sf, "events").selectExpr("event_id", "ts", "user_id", "event_type", f"value * (1e0 + {_D}) AS value")


# line items with twenty days without a shipment and one return flag of several times the price
_LATER = "l_shipdate >= DATE '1998-01-01'"
_PRICE = "l_extendedprice * CASE WHEN l_returnflag = 'N' THEN 4e0 ELSE 1e0 END AS l_extendedprice"
GAPPED_SQL = f"""(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, {_PRICE}, l_returnflag,
 l_shipdate + to_days(CASE WHEN {_LATER} THEN 20 ELSE 0 END) AS l_shipdate FROM lineitem)"""


def gapped(spark, sf):
    return load(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", _PRICE, "l_returnflag",
        f"CAST(l_shipdate AS TIMESTAMP) + make_dt_interval(CASE WHEN {_LATER} THEN 20 ELSE 0 END) AS l_shipdate")


SOURCES = {
    "events": dict(by=[], cte=lambda: facts_cte("events"), facts=lambda s, p: facts(s, p, "events"), roles=ROLES["events"]),
    "orders": dict(by=[], cte=lambda: facts_cte("orders"), facts=lambda s, p: facts(s, p, "orders"), roles=ROLES["orders"]),
    "tenants": dict(by=["tenant"], cte=lambda: facts_cte("events", ["tenant"], TENANTS_SQL, _TENANT_SQL_ROLES),
                    facts=_tenant_facts, roles=TENANT_ROLES),
    "customers": dict(by=["o_custkey"], cte=lambda: facts_cte("orders", ["o_custkey"]),
                      facts=lambda s, p: facts(s, p, "orders", ["o_custkey"]), roles=ROLES["orders"]),
}


# ---------------------------------------------------------------- SQL: sentences
def _say(template: str, *args: str) -> str:
    """A sentence as concatenated SQL text."""
    out, rest = [], template.replace("%%", "\0")
    pieces = rest.replace("%d", "%s").split("%s")
    for i, p in enumerate(pieces):
        if p:
            out.append("'" + p.replace("\0", "%").replace("'", "''") + "'")
        if i < len(args):
            out.append(f"({args[i]})")
    return " || ".join(out)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _txt(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


# ---------------------------------------------------------------- SQL: detectors
def detectors_sql(src: str) -> str:
    """A1-A8 over ``facts`` as CTE ``det`` and the ranked list ``anom``."""
    by, roles = SOURCES[src]["by"], SOURCES[src]["roles"]
    b, P, G, U = sel(by), part(by), grp(by), on(by)

    def det(kind, seq, severity, value, impact, reason, source, where, check=None, type_=None):
        return (f"SELECT {b}{type_ or _lit(kind)} AS type, '{severity}' AS severity, CAST({value} AS DOUBLE) AS value, "
                f"CAST({impact} AS DOUBLE) AS impact, {reason} AS reason, {check or _lit(FALSIFIABILITY[kind])} AS falsifiability, "
                f"{seq} AS seq FROM {source} WHERE {where}")

    zeros = f"CASE WHEN n > 0 THEN zeros / n * 100 END"
    parts = [
        det("NEGATIVE_VALUES", 0, "HIGH", "negs", R("abs(neg_sum)"), _say(REASON["NEGATIVE_VALUES"], _txt("negs")), "d_tot", "negs > 0"),
        det("STATISTICAL_OUTLIER", 1, "MEDIUM", "c", R("s"), _say(REASON["STATISTICAL_OUTLIER"], _txt("c")), "d_far", "c > 0"),
        det("IQR_OUTLIER", 2, "LOW", "outs", R("out_sum"), _say(REASON["IQR_OUTLIER"], _txt("outs")), "d_tot",
            "outs > 0 AND outs < n * 0.05"),
        det("DAILY", 3, "MEDIUM", R("v"), R("dev"), _say(
            REASON["DAILY"], "day", "CASE WHEN v > dm THEN 'spike' ELSE 'drop' END", inr_sql("dev"), inr_sql("dm")), "d_top", "r = 1",
            _say(FALSIFIABILITY["DAILY"], "day"), "CASE WHEN v > dm THEN 'REVENUE_SPIKE' ELSE 'REVENUE_DROP' END"),
        det("SUSPICIOUS_FREQUENCY", 4, "HIGH", "c", "0", _say(REASON["SUSPICIOUS_FREQUENCY"], _txt("c")), "d_rapid", "c > 0"),
        det("ZERO_VALUE_TRANSACTIONS", 5, "LOW", "zeros", "0", _say(
            REASON["ZERO_VALUE_TRANSACTIONS"], _txt("zeros"), numtext_sql(zeros)), "d_tot", "zeros > n * 0.05"),
        det("DUPLICATE_TRANSACTIONS", 6, "MEDIUM", "c", "0", _say(REASON["DUPLICATE_TRANSACTIONS"], _txt("c")), "d_dup", "c > 0"),
        det("DATA_GAP", 7, "LOW", R("mg / 86400000000.0", 1), "0", _say(
            REASON["DATA_GAP"], numtext_sql("mg / 86400000000.0", 1)), "d_gap",
            "n > 10 AND mg > 3 * 86400000000 AND mg > span / n * 10"),
    ]
    assert roles.user
    return f"""d_tot AS (SELECT {b}count(*) AS n, count(amount) AS na, avg(amount) AS mean, stddev_pop(amount) AS sd,
  count(*) FILTER (WHERE amount < 0 OR qty < 0) AS negs, sum(CASE WHEN amount < 0 OR qty < 0 THEN coalesce(amount, 0.0) END) AS neg_sum,
  count(*) FILTER (WHERE is_iqr_outlier) AS outs, sum(CASE WHEN is_iqr_outlier THEN coalesce(amount, 0.0) END) AS out_sum,
  count(*) FILTER (WHERE amount = 0) AS zeros, max(epoch_us(event_ts)) - min(epoch_us(event_ts)) AS span FROM facts {G}),
d_far AS (SELECT {b}count(*) AS c, sum(amount) AS s FROM facts JOIN d_tot {U} WHERE na >= 10 AND sd > 0 AND abs((amount - mean) / sd) > 3.5 {G}),
d_day AS (SELECT {b}strftime(event_ts, '%Y-%m-%d') AS day, sum(amount) AS v FROM facts
          WHERE amount IS NOT NULL AND event_ts IS NOT NULL GROUP BY {b}day),
d_st AS (SELECT {b}count(*) AS days, avg(v) AS dm, stddev_pop(v) AS ds FROM d_day {G}),
d_top AS (SELECT {b}day, v, dm, abs(v - dm) AS dev, row_number() OVER ({P} ORDER BY abs(v - dm) DESC, day) AS r
          FROM d_day JOIN d_st {U} JOIN d_tot {U} WHERE na >= 7 AND days >= 5 AND ds > 0 AND abs((v - dm) / ds) > 2.5),
d_lag AS (SELECT {b}epoch_ms(event_ts) - lag(epoch_ms(event_ts)) OVER (PARTITION BY {b}user_key ORDER BY event_ts) AS gap
          FROM facts WHERE user_key IS NOT NULL AND event_ts IS NOT NULL),
d_rapid AS (SELECT {b}count(*) AS c FROM d_lag WHERE gap < 60000 {G}),
d_dup AS (SELECT {b}count(*) - count(DISTINCT coalesce(user_key, '') || '|' || coalesce(CAST(amount AS VARCHAR), 'null') || '|'
                 || coalesce(strftime(event_ts, '%Y-%m-%d'), 'undefined')) AS c FROM facts {G}),
d_us AS (SELECT {b}epoch_us(event_ts) - lag(epoch_us(event_ts)) OVER ({P} ORDER BY event_ts) AS gap FROM facts WHERE event_ts IS NOT NULL),
d_gap AS (SELECT {b}n, span, mg FROM (SELECT {b}max(gap) AS mg FROM d_us {G}) JOIN d_tot {U}),
det AS ({' UNION ALL '.join(parts)}),
anom AS (SELECT *, row_number() OVER ({P} ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END,
                                      impact DESC, seq) AS rank FROM det)"""


# ---------------------------------------------------------------- SQL: judgments
def judgment_sql(src: str) -> str:
    """The facts and all of J1-J14 as CTE ``judg`` (and the statistics, days and totals it is made of)."""
    s = SOURCES[src]
    by, roles = s["by"], s["roles"]
    b, P, G, U = sel(by), part(by), grp(by), on(by)
    rev, both = "paid" if src == "tenants" else roles.revenue, "TRUE" if roles.quantity else "FALSE"
    excluded = "regexp_replace(CAST(100.0::DOUBLE - clean_rate AS VARCHAR), '[.]0$', '')"
    return s["cte"]() + ",\n" + describe_sql("facts", "amount", by) + f""",
ser AS (SELECT {b}strftime(event_ts, '%Y-%m-%d') AS day, sum(CASE WHEN amount IS NULL OR amount = 0 THEN 1.0 ELSE amount END) AS v
        FROM facts WHERE event_ts IS NOT NULL GROUP BY {b}day),
""" + regression_sql("ser", "v", "day", by) + f""",
st AS (SELECT {b}count(*) AS dp, sum(v) AS ssum, avg(v) AS smean, max(v) AS mx, arg_max(day, v ORDER BY v DESC, day) AS mday,
              datediff('day', min(CAST(day AS DATE)), max(CAST(day AS DATE))) AS dspan FROM ser {G}),
base AS (SELECT {b}count(*) AS rows, count(amount) AS na, count(qty) AS nq, count(*) FILTER (WHERE is_iqr_outlier) AS outlier_count,
                sum(CASE WHEN NOT is_iqr_outlier AND amount IS NOT NULL THEN amount END) AS sum_kept, sum(coalesce(amount, 0.0)) AS total,
                count(amount) FILTER (WHERE NOT is_iqr_outlier) AS n_kept,
                count(DISTINCT CASE WHEN category <> '' THEN category END) AS ncat FROM facts {G}),
wo AS (SELECT {b}avg(amount) AS mean_wo FROM facts JOIN described {U} WHERE amount <= p95 {G}),
cats AS (SELECT {b}category, sum(coalesce(amount, 0.0)) AS v FROM facts WHERE category IS NOT NULL AND category <> '' GROUP BY {b}category),
dom AS (SELECT {b}category AS dcat, v AS dv FROM (SELECT *, row_number() OVER ({P} ORDER BY v DESC, category) AS r FROM cats) WHERE r = 1),
mon AS (SELECT {b}strftime(event_ts, '%Y-%m') AS month, sum(coalesce(amount, 0.0)) AS rev, sum(coalesce(qty, 0.0)) AS q
        FROM facts WHERE event_ts IS NOT NULL GROUP BY {b}month),
""" + regression_sql("mon", "rev", "month", by, "rf") + ",\n" + regression_sql("mon", "q", "month", by, "qf") + f""",
qc AS (SELECT {b}count(*) AS distinct_rows, count(*) FILTER (WHERE amount IS NULL) AS amount_dropped,
              count(*) FILTER (WHERE amount IS NOT NULL AND event_ts IS NULL) AS date_dropped FROM typed {G}),
fd AS (SELECT {b}count(DISTINCT amount) AS distinct_amounts, min(amount) AS any_amount FROM facts {G}),
q0 AS (SELECT {b}rows_before, distinct_rows - amount_dropped - date_dropped AS rows_after, rows_before - distinct_rows AS dups,
              amount_dropped, date_dropped, coalesce(outlier_count, 0) AS outs, na, distinct_amounts, any_amount
       FROM raw_n JOIN qc {U} LEFT JOIN base {U} LEFT JOIN fd {U}),
qual AS (SELECT {b}rows_before, rows_after, CASE WHEN rows_before > 0 THEN {R('rows_after / rows_before * 100')} ELSE 100.0 END AS clean_rate,
  concat_ws('; ', CASE WHEN dups > 0 THEN printf('Removed %d exact duplicate rows', dups) END,
    CASE WHEN amount_dropped > 0 THEN printf('Dropped %d rows with unparseable {rev}', amount_dropped) END,
    CASE WHEN date_dropped > 0 THEN printf('Dropped %d rows with invalid or future dates', date_dropped) END,
    CASE WHEN outs > 0 THEN printf('Flagged %d IQR outliers (retained for analysis)', outs) END,
    CASE WHEN rows_after >= 5 AND distinct_amounts = 1 THEN printf('WARNING: All %d revenue values are identical (%s) — possible template or test data', na, regexp_replace(CAST(any_amount AS VARCHAR), '[.]0$', ''))
         WHEN rows_after >= 5 AND distinct_amounts < na * 0.05 THEN printf('WARNING: Revenue has only %d unique values across %d rows — data may be aggregated or artificial', distinct_amounts, na) END) AS issues FROM q0),
j0 AS (SELECT {b}rows_before, rows_after, clean_rate, issues, coalesce(rows, 0) AS rows, na, nq, coalesce(outlier_count, 0) AS outlier_count,
              sum_kept, n_kept, total, ncat, described.sum AS s_sum, described.mean AS s_mean, described.median AS s_median, skew, mean_wo, dp, ssum,
              {R('smean')} AS mr, mx, mday, dspan, fit.r2 AS fit_r2, fit.usable, dcat, dv,
              rf.points AS months, rf.slope AS revenue_slope, qf.slope AS quantity_slope
       FROM qual LEFT JOIN base {U} LEFT JOIN described {U} LEFT JOIN wo {U} LEFT JOIN st {U} LEFT JOIN fit {U}
            LEFT JOIN dom {U} LEFT JOIN rf {U} LEFT JOIN qf {U}),
j1 AS (SELECT *, s_sum - coalesce(sum_kept, 0.0) AS diff, outlier_count / rows * 100 AS density,
  coalesce(rows >= 10 AND abs(skew) > 2.0, false) AS skew_flag,
  coalesce(rows >= 10 AND CASE WHEN s_sum = 0 THEN s_sum - coalesce(sum_kept, 0.0) <> 0
           ELSE abs(s_sum - coalesce(sum_kept, 0.0)) / abs(s_sum) > 0.2 END, false) AS outlier_distortion,
  coalesce(dp >= 3, false) AS trend_ok, coalesce(dp >= 3 AND mr > 0 AND (mx - mr) / mr > 1.5, false) AS trend_concentrated,
  coalesce(rows >= 10 AND total > 0 AND dv / total * 100 > 40, false) AS dominant,
  coalesce({both} AND rows >= 10 AND na >= 5 AND nq >= 5 AND dp >= 3 AND months >= 4 AND revenue_slope > 0 AND quantity_slope < 0, false) AS contradiction,
  clean_rate < 70 AS blocked FROM j0),
judg AS (SELECT {b}rows_before, rows, clean_rate,
  CASE WHEN rows >= 50 THEN 'FULL' WHEN rows >= 20 THEN 'STANDARD' WHEN rows >= 5 THEN 'DIRECTIONAL' ELSE 'FACTS_ONLY' END AS analysis_tier,
  CASE WHEN clean_rate < 70 THEN 'CRITICAL' WHEN clean_rate < 85 THEN 'DEGRADED' ELSE 'CLEAN' END AS quality_verdict,
  blocked AS quality_blocks_analysis, coalesce(density > 15, false) AS density_flag, {R('CASE WHEN rows > 0 THEN density END')} AS outlier_density,
  outlier_count, skew_flag, skew, CASE WHEN skew_flag THEN s_mean END AS skew_mean, CASE WHEN skew_flag THEN s_median END AS skew_median,
  CASE WHEN skew_flag THEN {R('mean_wo')} END AS mean_without_top5,
  CASE WHEN skew_flag THEN CASE WHEN skew > 0 THEN 'right' ELSE 'left' END END AS skew_direction,
  outlier_distortion, CASE WHEN outlier_distortion THEN {R('s_sum')} END AS with_outliers,
  CASE WHEN outlier_distortion THEN {R('coalesce(sum_kept, 0.0)')} END AS without_outliers,
  CASE WHEN outlier_distortion THEN {R('diff')} END AS outlier_difference,
  CASE WHEN outlier_distortion THEN {R('abs(diff) / abs(s_sum) * 100')} END AS outlier_pct_impact,
  coalesce(dp, 0) AS data_points, trend_ok AS has_sufficient_for_trend,
  CASE WHEN coalesce(dp, 0) < 2 THEN 'unknown' WHEN dspan / (dp - 1) < 1.5 THEN 'daily' WHEN dspan / (dp - 1) < 8 THEN 'weekly' ELSE 'monthly' END AS frequency,
  CASE WHEN trend_ok THEN fit_r2 ELSE 0.0 END AS r2, coalesce(trend_ok AND usable, false) AS is_linear_fit, trend_concentrated,
  CASE WHEN trend_concentrated THEN mday END AS concentrated_period, CASE WHEN trend_concentrated THEN {R('mx')} END AS concentrated_value,
  CASE WHEN trend_concentrated THEN {R('(ssum - mx) / (dp - 1)')} END AS concentrated_baseline,
  CASE WHEN trend_concentrated THEN {R('(mx - mr) / mr * 100')} END AS concentrated_pct_above,
  CASE WHEN dominant THEN dcat END AS dominant_category, CASE WHEN dominant THEN {R('dv / total * 100')} END AS dominant_pct,
  CASE WHEN dominant THEN {R('dv')} END AS dominant_value, contradiction, revenue_slope, quantity_slope,
  rows >= 5 AND NOT blocked AS can_show_patterns, trend_ok AND NOT blocked AS can_show_trends,
  coalesce(dp >= 12, false) AND NOT blocked AS can_show_seasonal, coalesce(dp >= 12 AND usable, false) AND NOT blocked AS can_forecast,
  coalesce(ncat >= 2, false) AND NOT blocked AS can_show_categories, rows >= 20 AND NOT blocked AS can_show_user_analysis,
  rows >= 5 AND NOT blocked AS can_show_statistical, rows >= 5 AND NOT blocked AS can_show_recommendations,
  rows >= 50 AND NOT blocked AS full_analysis,
  concat_ws('\n', CASE WHEN blocked THEN {_say(PREAMBLE['CRITICAL'], numtext_sql('clean_rate'), _txt('rows_after'), _txt('rows_before'), 'issues')}
     WHEN clean_rate < 85 THEN {_say(PREAMBLE['DEGRADED'], _txt('rows_before - rows_after'), _txt('rows_before'), numtext_sql('clean_rate'))} END,
     CASE WHEN density > 15 THEN {_say(PREAMBLE['DENSITY'], numtext_sql('density'), _txt('outlier_count'), _txt('rows'))} END) AS mandatory_preamble,
  CASE WHEN clean_rate >= 70 AND clean_rate < 85 THEN {_say(QUALITY_WARNING, excluded, numtext_sql('clean_rate'))} ELSE '' END AS quality_warnings,
  CASE WHEN skew_flag THEN {_say(DETAIL['SKEW'], inr_sql('s_mean'), "CASE WHEN skew > 0 THEN 'inflated' ELSE 'deflated' END", inr_sql('s_median'), inr_sql(R('mean_wo')))} END AS skew_detail,
  CASE WHEN outlier_distortion THEN {_say(DETAIL['OUTLIER'], inr_sql('s_sum'), inr_sql('coalesce(sum_kept, 0.0)'), numtext_sql('abs(diff) / abs(s_sum) * 100'))} END AS outlier_detail,
  CASE WHEN trend_concentrated THEN {_say(DETAIL['TREND'], 'mday', inr_sql('mx'), numtext_sql('(mx - mr) / mr * 100'), inr_sql(R('(ssum - mx) / (dp - 1)')))} END AS trend_detail,
  CASE WHEN dominant THEN {_say(DETAIL['DOMINANCE'], 'dcat', numtext_sql('dv / total * 100'))} END AS dominance_detail,
  CASE WHEN contradiction THEN {_say(DETAIL['CONTRADICTION'], numtext_sql('revenue_slope', 0), numtext_sql('quantity_slope', 0))} END AS contradiction_detail,
  CASE WHEN contradiction THEN {_lit(IMPLICATION)} END AS contradiction_implication FROM j1)"""


def _judged(spark, sf, src):
    j = judgment(SOURCES[src]["facts"](spark, sf), cut=land)
    return j.withColumns({c: F.array_join(c, "\n") for c in ("mandatory_preamble", "quality_warnings")})


@register("judgment", judgment_sql("events") + "\nSELECT * FROM judg")
def q_judgment(spark, sf):
    return _judged(spark, sf, "events")


@register("judgment_orders", judgment_sql("orders") + "\nSELECT * FROM judg")
def q_judgment_orders(spark, sf):
    return _judged(spark, sf, "orders")


@register("judgment_tenants", judgment_sql("tenants") + "\nSELECT * FROM judg")
def q_judgment_tenants(spark, sf):
    return _judged(spark, sf, "tenants")


# sums of a few amounts over two or four days end on half cents, where the order of addition decides: whole numbers here
_WHOLE = ("concentrated_baseline", "revenue_slope")


@register("judgment_by_customer", judgment_sql("customers") + "\nSELECT * REPLACE ("
          + ", ".join(f"floor({c}) AS {c}" for c in _WHOLE) + ") FROM judg")
def q_judgment_customers(spark, sf):
    return _judged(spark, sf, "customers").withColumns({c: F.expr(f"CAST(floor({c}) AS DOUBLE)") for c in _WHOLE})


# ---------------------------------------------------------------- A9
def _battery(spark, sf, src, output):
    """One output of the composed ``analyse``."""
    return analyse(None, facts=SOURCES[src]["facts"](spark, sf), as_of=AS_OF, outputs=[output])[output]


_ANOM = "rank, type, severity, value, impact, reason, falsifiability FROM anom WHERE rank <= 15"


@register("anomaly_table", SOURCES["events"]["cte"]() + ",\n" + detectors_sql("events") + f"\nSELECT {_ANOM}")
def q_anomaly_table(spark, sf):
    fx = facts(spark, sf, "events")
    return A.anomaly_table(A.all_detectors(fx.df, fx.roles))[0].drop("seq")


@register("anomaly_table_tenants", SOURCES["tenants"]["cte"]() + ",\n" + detectors_sql("tenants") + f"\nSELECT tenant, {_ANOM}")
def q_anomaly_tenants(spark, sf):
    return _battery(spark, sf, "tenants", "anomalies").drop("seq")


@register("anomaly_table_by_customer", SOURCES["customers"]["cte"]() + ",\n" + detectors_sql("customers") + f"\nSELECT o_custkey, {_ANOM}")
def q_anomaly_customers(spark, sf):
    return _battery(spark, sf, "customers", "anomalies").drop("seq")


@register("anomaly_summary", SOURCES["events"]["cte"]() + ",\n" + detectors_sql("events") + f"""
SELECT count(*) AS count, count(*) FILTER (WHERE severity = 'HIGH') AS high_count, {R('sum(impact)')} AS total_impact
FROM det""")
def q_anomaly_summary(spark, sf):
    fx = facts(spark, sf, "events")
    return A.anomaly_table(A.all_detectors(fx.df, fx.roles))[1]


# ---------------------------------------------------------------- F2
def _confidence_sql(src: str) -> str:
    b, U = sel(SOURCES[src]["by"]), on(SOURCES[src]["by"])
    return judgment_sql(src) + ",\n" + detectors_sql(src) + f""",
ac AS (SELECT {b}count(*) AS kinds FROM det {grp(SOURCES[src]['by'])}),
sc AS (SELECT {b}least(100, greatest(0, 100
  - CASE WHEN rows < 10 THEN 50 WHEN rows < 30 THEN 30 WHEN rows < 100 THEN 15 WHEN rows < 500 THEN 5 ELSE 0 END
  - CASE WHEN clean_rate < 70 THEN 40 WHEN clean_rate < 85 THEN 20 WHEN clean_rate < 95 THEN 8 ELSE 0 END
  - CASE WHEN coalesce(kinds, 0) / greatest(rows, 1) > 0.2 THEN 20 WHEN coalesce(kinds, 0) / greatest(rows, 1) > 0.1 THEN 10 ELSE 0 END
  - CASE WHEN skew_flag OR outlier_distortion OR trend_concentrated THEN 15 ELSE 0 END - CASE WHEN contradiction THEN 10 ELSE 0 END
  - CASE WHEN trend_concentrated THEN 10 ELSE 0 END)) AS score FROM judg LEFT JOIN ac {U})
SELECT {b}CAST(score AS BIGINT) AS score, CASE WHEN score >= 75 THEN 'HIGH' WHEN score >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM sc"""


@register("confidence_grade", _confidence_sql("events"))
def q_confidence(spark, sf):
    return _battery(spark, sf, "events", "confidence")


@register("confidence_grade_tenants", _confidence_sql("tenants"))
def q_confidence_tenants(spark, sf):
    return _battery(spark, sf, "tenants", "confidence")


@register("confidence_grade_by_customer", _confidence_sql("customers"))
def q_confidence_customers(spark, sf):
    return _battery(spark, sf, "customers", "confidence")


# ---------------------------------------------------------------- F7 metrics
def metrics_sql(src: str) -> str:
    """The metrics of every group as CTE ``met`` (after the judgment CTEs)."""
    by = SOURCES[src]["by"]
    b, P, G, U = sel(by), part(by), grp(by), on(by)
    two = "sum(CASE WHEN r <= 7 THEN val END) AS l7, sum(CASE WHEN r BETWEEN 8 AND 14 THEN val END) AS p7"
    return f"""m_day AS (SELECT {b}day, {R('v')} AS val, count(*) OVER ({P}) AS days FROM (
  SELECT {b}strftime(event_ts, '%Y-%m-%d') AS day, sum(coalesce(amount, 0.0)) AS v FROM facts WHERE event_ts IS NOT NULL GROUP BY {b}day)
  QUALIFY days >= 3),
m_rn AS (SELECT {b}day, val, row_number() OVER ({P} ORDER BY day DESC) AS r FROM m_day),
m_gr AS (SELECT {b}count(*) AS n, {two}, arg_min(val, day) AS v0, arg_max(val, day) AS v1 FROM m_rn {G}),
m_u AS (SELECT {b}user_key, count(*) AS c, sum(coalesce(amount, 0.0)) AS t FROM facts WHERE user_key IS NOT NULL GROUP BY {b}user_key),
m_us AS (SELECT {b}count(*) AS users, count(*) FILTER (WHERE c > 1) AS repeated, greatest(1, floor(count(*) * 0.2::DOUBLE)) AS k,
                sum(t) AS total FROM m_u {G}),
m_top AS (SELECT {b}sum(t) AS top FROM (SELECT *, row_number() OVER ({P} ORDER BY t DESC) AS rn FROM m_u) JOIN m_us {U} WHERE rn <= k {G}),
met AS (SELECT {b}described.sum AS revenue, base.rows AS orders, CASE WHEN base.rows > 0 THEN {R('described.sum / base.rows')} END AS aov,
  described.median AS median_order, CASE WHEN n_kept > 0 THEN {R('sum_kept')} END AS revenue_excluding_outliers,
  CASE WHEN n_kept > 0 THEN {R(R('sum_kept') + ' / n_kept')} END AS aov_excluding_outliers,
  CASE WHEN m_gr.n >= 14 AND p7 > 0 THEN {R('(l7 - p7) / p7 * 100')} END AS growth,
  CASE WHEN m_gr.n > 30 AND v0 > 0 THEN {R('(power(v1 / v0, 365.0 / m_gr.n) - 1) * 100')} END AS cagr,
  CASE WHEN can_show_user_analysis THEN users END AS unique_users,
  CASE WHEN can_show_user_analysis THEN {R('repeated / users * 100')} END AS repeat_rate,
  CASE WHEN can_show_user_analysis AND m_us.total > 0 THEN {R('top / m_us.total * 100')} END AS pareto_concentration
  FROM base LEFT JOIN described {U} LEFT JOIN m_gr {U} LEFT JOIN m_us {U} LEFT JOIN m_top {U} LEFT JOIN (
    SELECT {b}can_show_user_analysis FROM judg) {on(by) if by else 'ON TRUE'})"""


@register("metrics_events", judgment_sql("events") + ",\n" + metrics_sql("events") + "\nSELECT * FROM met")
def q_metrics_events(spark, sf):
    return _battery(spark, sf, "events", "metrics")


@register("metrics_tenants", judgment_sql("tenants") + ",\n" + metrics_sql("tenants") + "\nSELECT * FROM met")
def q_metrics_tenants(spark, sf):
    return _battery(spark, sf, "tenants", "metrics")


# ---------------------------------------------------------------- F1
def _findings_sql(src: str) -> str:
    by = SOURCES[src]["by"]
    b, P, U = sel(by), part(by), on(by)

    def item(kind, subtype, magnitude, reliability, actionable, detail, where, seq, check=None, implication="NULL"):
        return (f"SELECT {b}'{kind}' AS type, {subtype} AS subtype, CAST({magnitude} AS DOUBLE) AS magnitude, {reliability} AS reliability, "
                f"{actionable} AS actionable, {detail} AS detail, {check or _lit(CHECK[kind])} AS falsifiability, "
                f"CAST({implication} AS VARCHAR) AS implication, {seq} AS seq FROM ctx WHERE {where}")

    rev = "coalesce(revenue, 0.0)"
    note = f"CASE WHEN trend_concentrated THEN {_say(DETAIL['GROWTH_NOTE'], 'concentrated_period')} ELSE '' END"
    once = _txt("unique_users - CAST(floor(unique_users * repeat_rate / 100 + 0.5) AS BIGINT)")
    parts = [
        item("CONTRADICTION", "'REVENUE_UP_VOLUME_DOWN'", rev, "'HIGH'", "true", "contradiction_detail", "contradiction", 101,
             implication="contradiction_implication"),
        item("DISTORTION", "'SKEW_DISTORTION'", f"{rev} * 0.2", "'HIGH'", "false", "skew_detail", "skew_flag", 102),
        item("DISTORTION", "'OUTLIER_TOTAL_DISTORTION'", f"CASE WHEN outlier_difference <> 0 THEN outlier_difference ELSE {rev} * 0.2 END",
             "'HIGH'", "false", "outlier_detail", "outlier_distortion", 103),
        item("DISTORTION", "'TREND_CONCENTRATION'", f"{rev} * 0.2", "'HIGH'", "false", "trend_detail", "trend_concentrated", 104),
        item("CONCENTRATION_RISK", "'CATEGORY_CONCENTRATION'", "coalesce(dominant_value, 0.0) * 0.3", "'HIGH'", "true",
             "dominance_detail", "dominant_category IS NOT NULL", 105),
        item("TREND", "CASE WHEN growth > 0 THEN 'GROWTH' ELSE 'DECLINE' END", f"abs({rev}) * (abs(growth) / 100)",
             "CASE WHEN trend_concentrated THEN 'LOW' ELSE 'MEDIUM' END", "abs(growth) > 15",
             _say(DETAIL["GROWTH"], "CASE WHEN growth > 0 THEN '+' ELSE '' END", numtext_sql("growth"), note),
             "has_sufficient_for_trend AND growth IS NOT NULL AND abs(growth) > 5", 106),
        item("RETENTION", "'LOW_REPEAT_RATE'",
             "CASE WHEN revenue IS NOT NULL AND revenue <> 0 THEN revenue * ((30 - repeat_rate) / 100) ELSE 0.0 END", "'MEDIUM'", "true",
             _say(DETAIL["RETENTION"], numtext_sql("repeat_rate"), once), "repeat_rate < 30", 107),
    ]
    return judgment_sql(src) + ",\n" + detectors_sql(src) + ",\n" + metrics_sql(src) + f""",
ctx AS (SELECT judg.*, met.* EXCLUDE ({', '.join(by + ['orders'])}) FROM judg LEFT JOIN met {U.replace('USING (', 'ON judg.').replace(')', f' = met.{by[0]}') if by else U}),
fnd AS (
  SELECT {b}'ANOMALY' AS type, type AS subtype, CASE WHEN impact <> 0 THEN impact ELSE value * coalesce(aov, 0.0) END AS magnitude,
         severity AS reliability, severity <> 'LOW' AS actionable, reason AS detail, falsifiability, CAST(NULL AS VARCHAR) AS implication, rank AS seq
  FROM anom LEFT JOIN met {U} WHERE rank <= 15 AND (severity = 'HIGH' OR impact > 0)
  UNION ALL {' UNION ALL '.join(parts)}),
sc AS (SELECT *, CASE WHEN type = 'ANOMALY' AND reliability = 'HIGH' THEN 'HIGH' WHEN type = 'CONTRADICTION' THEN 'HIGH'
                      WHEN type IN ('CONCENTRATION_RISK', 'RETENTION') THEN 'MEDIUM'
                      WHEN type = 'TREND' AND subtype = 'DECLINE' THEN 'HIGH' ELSE 'LOW' END AS urgency FROM fnd),
sw AS (SELECT *, coalesce(magnitude, 0.0) * CASE reliability WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.6::DOUBLE ELSE 0.25::DOUBLE END
         * CASE urgency WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS score FROM sc)
SELECT {b}CAST(row_number() OVER ({P} ORDER BY score DESC, seq) AS BIGINT) AS rank, type, subtype, {R('magnitude')} AS magnitude,
       reliability, urgency, {R('score')} AS score, actionable, detail, falsifiability, implication FROM sw QUALIFY rank <= 5"""


def _findings(spark, sf, src):
    out = _battery(spark, sf, src, "findings")
    return out.withColumns({c: F.expr(f"floor({c} * 100 + 0.5) / 100") for c in ("magnitude", "score")})


@register("ranked_findings", _findings_sql("events"))
def q_findings(spark, sf):
    return _findings(spark, sf, "events")


@register("ranked_findings_tenants", _findings_sql("tenants"))
def q_findings_tenants(spark, sf):
    return _findings(spark, sf, "tenants")


@register("ranked_findings_by_customer", _findings_sql("customers"))
def q_findings_customers(spark, sf):
    return _findings(spark, sf, "customers")


# ---------------------------------------------------------------- M8, A3, A6, A8 at 3 days, J12 at 40 % on the derived tables
def _forecast_sql(by=()):
    b = sel(by)
    return facts_cte("events", by, RISING_SQL) + f""",
daily AS (SELECT {b}day, {R('v')} AS val FROM (SELECT {b}strftime(event_ts, '%Y-%m-%d') AS day, sum(coalesce(amount, 0.0)) AS v
          FROM facts WHERE event_ts IS NOT NULL GROUP BY {b}day)),
""" + regression_sql("daily", "val", "day", by) + f"""
SELECT {b}CAST(s.step AS BIGINT) AS step, 'Period +' || s.step AS name,
       {R('greatest(0.0, fit.slope * (fit.points + s.step) + fit.intercept)')} AS val, fit.r2
FROM fit, (VALUES (1), (2), (3)) s(step) WHERE fit.usable AND fit.points >= 12"""


def _forecast(spark, sf, by=()):
    fx = facts_of(spark, sf, "rising", rising, ROLES["events"], by)
    return M.linear_forecast(M.daily_trend(fx.df, by), by)


@register("linear_forecast", _forecast_sql())
def q_forecast(spark, sf):
    return _forecast(spark, sf)


@register("linear_forecast_by_category", _forecast_sql(["event_type"]))
def q_forecast_by(spark, sf):
    return _forecast(spark, sf, ["event_type"])


def _one_detector(kinds: str, columns: str) -> str:
    return SOURCES["tenants"]["cte"]() + ",\n" + detectors_sql("tenants") + f"\nSELECT {columns} FROM det WHERE type = '{kinds}'"


_DET = "tenant, type, severity, value, impact, reason, falsifiability"


@register("iqr_outlier_anomaly", _one_detector("IQR_OUTLIER", _DET))
def q_iqr_anom(spark, sf):
    return A.iqr_outliers(_tenant_facts(spark, sf).df, ["tenant"])


@register("zero_value_share", _one_detector("ZERO_VALUE_TRANSACTIONS", _DET))
def q_zero(spark, sf):
    return A.zero_value_share(_tenant_facts(spark, sf).df, ["tenant"])


@register("data_gap_tenants", _one_detector("DATA_GAP", _DET))
def q_gap_tenants(spark, sf):
    return A.data_gap(_tenant_facts(spark, sf).df, TENANT_ROLES, ["tenant"])


def _gapped_facts(spark, sf):
    return facts_of(spark, sf, "gapped", gapped, ROLES["lineitem"])


@register("data_gap_lineitem", facts_cte("lineitem", source=GAPPED_SQL) + f""",
o AS (SELECT epoch_us(event_ts) - lag(epoch_us(event_ts)) OVER (ORDER BY event_ts) AS gap FROM facts WHERE event_ts IS NOT NULL),
s AS (SELECT count(*) AS n, max(epoch_us(event_ts)) - min(epoch_us(event_ts)) AS span FROM facts),
g AS (SELECT max(gap) AS mg FROM o)
SELECT 'DATA_GAP' AS type, 'LOW' AS severity, {R('mg / 86400000000.0', 1)} AS value, 0.0::DOUBLE AS impact
FROM g, s WHERE s.n > 10 AND mg > 3 * 86400000000 AND mg > s.span / s.n * 10""")
def q_gap_li(spark, sf):
    return A.data_gap(_gapped_facts(spark, sf).df, ROLES["lineitem"]).drop("reason", "falsifiability")


@register("dominance_lineitem", facts_cte("lineitem", source=GAPPED_SQL) + f""",
cats AS (SELECT category, sum(coalesce(amount, 0.0)) AS v FROM facts WHERE category <> '' GROUP BY category)
SELECT category, {R('v / t * 100')} AS pct, {R('v')} AS value FROM (SELECT *, row_number() OVER (ORDER BY v DESC, category) AS r FROM cats),
  (SELECT sum(coalesce(amount, 0.0)) AS t, count(*) AS n FROM facts) WHERE r = 1 AND n >= 10 AND t > 0 AND v / t * 100 > 40""")
def q_dominance_li(spark, sf):
    return dominance(_gapped_facts(spark, sf).df, ROLES["lineitem"])


# ---------------------------------------------------------------- F6
# reports made of the documents: chart tags, whole and broken, verdicts, KPI tags and recommendations by id
_PARTS = [(7, 0, "VERDICT: fine. "), (5, 1, "[CHART:bar|a|[1]][CHART:pie|b|[2]] x [CHART:line|c|[3]][CHART:bar|d|[4]] y [CHART:bar|e|[5]] z"),
          (5, 2, "[CHART:bar|a|[1]] [CHART: [CHART:pie|b|[2]] [CHART:line|c|[3]] [CHART:bar|d"), (6, 3, "[KPI:Revenue|1||neutral]"),
          (3, 1, "You Should act."), (4, 2, "Next step: wait.")]
_REPORT = "coalesce(text, '') || " + " || ".join(f"CASE WHEN doc_id % {m} = {r} THEN '{t}' ELSE '' END" for m, r, t in _PARTS)


def _audit_sql(src: str, key: str) -> str:
    by = SOURCES[src]["by"][0]
    t = f"(SELECT doc_id, {key} AS {by}, {_REPORT} AS t FROM documents)"
    tag, opening, advice = r"\[CHART:[^\]]+\]", r"\[CHART:", r"(recommendation|action|next step|should)[^\n]*"
    kept = (f"array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || "
            f"CASE WHEN i <= 4 AND i <= len(tags) THEN tags[i] ELSE '' END), '')")
    kpi = (f"concat_ws(chr(10), '[KPI:Revenue|' || {inr_sql('revenue')} || '||neutral]', CASE WHEN orders <> 0 THEN "
           f"'[KPI:Transactions|' || orders || '||neutral]' END, CASE WHEN growth IS NOT NULL THEN '[KPI:WoW Growth|' || "
           f"{numtext_sql('growth')} || '%||' || CASE WHEN growth >= 0 THEN 'up' ELSE 'down' END || ']' END)")
    return judgment_sql(src) + ",\n" + metrics_sql(src) + f""",
r0 AS (SELECT r.*, j.analysis_tier, j.quality_blocks_analysis AS blocked, met.revenue, met.orders, met.growth FROM {t} r
       LEFT JOIN judg j USING ({by}) LEFT JOIN met USING ({by})),
r1 AS (SELECT *, CASE WHEN analysis_tier = 'FACTS_ONLY' THEN regexp_replace(t, '{advice}', '', 'gi') ELSE t END AS t1,
       CASE WHEN analysis_tier = 'FACTS_ONLY' THEN len(regexp_extract_all(t, '(?i){advice}')) ELSE 0 END AS suppressed FROM r0),
r2 AS (SELECT *, len(regexp_extract_all(t1, '{opening}')) AS charts, regexp_extract_all(t1, '{tag}') AS tags,
       string_split_regex(t1, '{tag}') AS pieces FROM r1),
r3 AS (SELECT *, CASE WHEN charts > 4 THEN {kept} ELSE t1 END AS t2 FROM r2),
r4 AS (SELECT *, NOT contains(t2, '[KPI:') AND revenue IS NOT NULL AND NOT coalesce(blocked, false) AND t <> '' AS inject FROM r3)
SELECT doc_id, {by}, NOT contains(t, 'VERDICT') AND NOT contains(t, '◆') AND length(t) > 200 AS missing_verdict,
  CAST(suppressed AS BIGINT) AS suppressed, CAST(charts AS BIGINT) AS charts_found,
  CAST(CASE WHEN charts > 4 THEN least(len(tags), 4) ELSE len(tags) END AS BIGINT) AS charts_kept, inject AS kpi_injected,
  CASE WHEN inject THEN {kpi} || chr(10) || chr(10) || t2 ELSE t2 END AS validated_text FROM r4"""


def _audit(spark, sf, src, key):
    by = SOURCES[src]["by"]
    docs = load(spark, sf, "documents").selectExpr("doc_id", f"{key} AS {by[0]}", f"{_REPORT} AS text")
    out = analyse(None, facts=SOURCES[src]["facts"](spark, sf), as_of=AS_OF, outputs=["judgment", "metrics"])
    return RP.audit_reports(docs, out["judgment"], out["metrics"], by).select(
        "doc_id", *by, "missing_verdict", "suppressed", "charts_found", "charts_kept", "kpi_injected", "validated_text")


_TENANT_OF = "CASE doc_id % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'purchase' WHEN 4 THEN 'signup' ELSE 'nobody' END"


@register("audit_narratives", _audit_sql("tenants", _TENANT_OF))
def q_audit(spark, sf):
    return _audit(spark, sf, "tenants", _TENANT_OF)


@register("audit_narratives_by_customer", _audit_sql("customers", "doc_id"))
def q_audit_customers(spark, sf):
    return _audit(spark, sf, "customers", "doc_id")
