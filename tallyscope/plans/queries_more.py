"""More registered queries: string cleaning, profiling, display and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import with_parsed_timestamp
from ..functions.display import inr_display
from ..functions.numbers import with_parsed_amount
from ..functions.text import strip_markup
from ..model import AMOUNT, COLUMN_ALIASES, DOMAIN_KEYWORDS, INTENT_PATTERNS, Roles
from ..operators import metrics as M
from ..operators import report as RP
from ..operators.clean import build_facts, typed_rows
from ..operators.roles import catalogue, classify_questions, infer_domain, infer_roles
from ..operators.stats import describe_measure
from .oracle import AS_OF, R, describe_sql, facts_cte, regression_sql
from .queries import ROLES, facts, load, register
from .sqltext import inr_sql, numtext_sql

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# ---------------------------------------------------------------- SQL restatements of expressions
_WS_RE2 = "\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def amount_sql(s: str) -> str:
    st = f"regexp_replace(CAST({s} AS VARCHAR), '[₹$€£¥,()" + _WS_RE2 + "]', '', 'g')"
    pre = f"regexp_extract({st}, '^([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)', 1)"
    return (f"(CASE WHEN {st} IS NULL OR {st} = '' OR regexp_matches({st}, '^(null|na|n/a|nan|undefined|-)$', 'i') "
            f"THEN NULL WHEN {pre} <> '' AND isfinite(TRY_CAST({pre} AS DOUBLE)) THEN TRY_CAST({pre} AS DOUBLE) END)")


def timestamp_sql(s: str) -> str:
    t = f"regexp_replace(CAST({s} AS VARCHAR), '^[\\s\\x{{00A0}}\\x{{FEFF}}]+|[\\s\\x{{00A0}}\\x{{FEFF}}]+$', '', 'g')"
    days = ["%m/%d/%Y", "%m-%d-%Y", "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y",
            "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%Y/%m/%d", "%Y.%m.%d", "%Y-%m-%d", "%b %Y", "%B %Y"]
    times = ["%m/%d/%Y", "%m-%d-%Y", "%Y/%m/%d", "%Y-%m-%d", "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y"]
    clocks = ["%H:%M", "%H:%M:%S", "%I:%M %p", "%I:%M:%S %p"]
    formats = [f"{d} {c}" for d in times for c in clocks]
    parsed = "coalesce(" + ", ".join(
        [f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({t} AS TIMESTAMP) END"]
        + [f"CASE WHEN NOT contains({t}, ':') THEN try_strptime({t}, '{f}') END" for f in days]
        + [f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}$') THEN try_strptime({t} || '-01', '%Y-%m-%d') END",
           f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}$') THEN try_strptime({t} || '-01-01', '%Y-%m-%d') END"]
        + [f"CASE WHEN contains({t}, ':') THEN try_strptime({t}, '{f}') END" for f in formats]) + ")"
    return (f"(CASE WHEN {t} IS NULL OR regexp_matches({t}, '^(null|na)?$', 'i') THEN NULL "
            f"WHEN year({parsed}) > 1900 AND year({parsed}) < 2100 AND {parsed} <= TIMESTAMP '{AS_OF}' + INTERVAL 365 DAY "
            f"THEN {parsed} END)")


# ---------------------------------------------------------------- C2, C3 on derived dirty strings
def _dirty_amounts(spark, sf):
    li = load(spark, sf, "lineitem")
    p = F.col("l_extendedprice")
    ps = p.cast("string")
    raw = (F.when(F.col("l_linenumber") == 1, F.concat(F.lit("₹"), F.format_number(p, 2)))
           .when(F.col("l_linenumber") == 2, F.concat(F.lit("("), ps, F.lit(")")))
           .when(F.col("l_linenumber") == 3, F.concat(ps, F.lit("abc")))
           .when(F.col("l_linenumber") == 4, F.concat(F.lit("$-"), ps))
           .when(F.col("l_linenumber") == 5, F.lit("N/A"))
           .when(F.col("l_linenumber") == 6, F.concat(F.lit(" "), ps, F.lit(" ")))
           .otherwise(F.lit("1e400")))
    return li.select("l_orderkey", "l_linenumber", raw.alias("raw"))


_DIRTY_AMOUNTS_SQL = """(SELECT l_orderkey, l_linenumber,
  CASE l_linenumber WHEN 1 THEN '₹' || format('{:,.2f}', l_extendedprice)
                    WHEN 2 THEN '(' || CAST(l_extendedprice AS VARCHAR) || ')'
                    WHEN 3 THEN CAST(l_extendedprice AS VARCHAR) || 'abc'
                    WHEN 4 THEN '$-' || CAST(l_extendedprice AS VARCHAR)
                    WHEN 5 THEN 'N/A'
                    WHEN 6 THEN ' ' || CAST(l_extendedprice AS VARCHAR) || ' '
                    ELSE '1e400' END AS raw FROM lineitem)"""


@register("typed_amounts", f"SELECT l_orderkey, l_linenumber, raw, {amount_sql('raw')} AS amount FROM {_DIRTY_AMOUNTS_SQL} d")
def q_typed_amounts(spark, sf):
    return with_parsed_amount(_dirty_amounts(spark, sf), "raw", "amount")


# the formats of lineitem dates by order and line: Spark pattern, or text in both engines
_DATE_TEXTS = [
    ("yyyy-MM-dd", "strftime(d, '%Y-%m-%d')"),
    ("M/d/yyyy", "month(d) || '/' || day(d) || '/' || strftime(d, '%Y')"),
    ("d.M.yyyy", "day(d) || '.' || month(d) || '.' || strftime(d, '%Y')"),
    ("yyyy/MM/dd", "strftime(d, '%Y/%m/%d')"),
    ("MMM d, yyyy", "strftime(d, '%b') || ' ' || day(d) || ', ' || strftime(d, '%Y')"),
    ("'n/a'", "'n/a'"),
    ("d/M/yyyy", "day(d) || '/' || month(d) || '/' || strftime(d, '%Y')"),
    ("yyyy-MM", "strftime(d, '%Y-%m')"),
    ("yyyy", "strftime(d, '%Y')"),
    ("MMMM yyyy", "strftime(d, '%B %Y')"),
    ("MMM yyyy", "strftime(d, '%b %Y')"),
    ("M/d/yyyy '14:05'", "month(d) || '/' || day(d) || '/' || strftime(d, '%Y') || ' 14:05'"),
    ("MM/dd/yyyy '02:05:09 PM'", "strftime(d, '%m/%d/%Y') || ' 02:05:09 PM'"),
    ("yyyy/M/d '7:30:01'", "strftime(d, '%Y') || '/' || month(d) || '/' || day(d) || ' 7:30:01'"),
    ("MMM d, yyyy '11:59 pm'", "strftime(d, '%b') || ' ' || day(d) || ', ' || strftime(d, '%Y') || ' 11:59 pm'"),
    ("d MMMM yyyy '00:00'", "day(d) || ' ' || strftime(d, '%B %Y') || ' 00:00'"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "strftime(d, '%Y-%m-%dT%H:%M:%SZ')"),
    ("d.M.yyyy '10:00'", "day(d) || '.' || month(d) || '.' || strftime(d, '%Y') || ' 10:00'"),
]


def _dirty_dates(spark, sf):
    li = load(spark, sf, "lineitem")
    d, n = F.col("l_shipdate").cast("timestamp"), len(_DATE_TEXTS)
    kind = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(n))
    raw = F.coalesce(*[F.when(kind == i, F.date_format(d, p)) for i, (p, _) in enumerate(_DATE_TEXTS)])
    return li.select("l_orderkey", "l_linenumber", raw.alias("raw"))


_DIRTY_DATES_SQL = "(SELECT l_orderkey, l_linenumber, CASE (l_orderkey * 7 + l_linenumber) % " + str(len(_DATE_TEXTS)) + " " + " ".join(
    f"WHEN {i} THEN {q}" for i, (_, q) in enumerate(_DATE_TEXTS)) + " END AS raw FROM (SELECT *, CAST(l_shipdate AS TIMESTAMP) AS d FROM lineitem))"


@register("typed_timestamps", f"SELECT l_orderkey, l_linenumber, raw, {timestamp_sql('raw')} AS event_ts FROM {_DIRTY_DATES_SQL} d")
def q_typed_ts(spark, sf):
    return with_parsed_timestamp(_dirty_dates(spark, sf), "raw", "event_ts", AS_OF)


# ---------------------------------------------------------------- C1, C8, C9
_QR_SRC = "(SELECT l_returnflag, l_linestatus, l_quantity, l_shipdate FROM lineitem)"
_QR_ROLES = dict(amount="l_quantity", ts="l_shipdate")


@register("quality_report", facts_cte("lineitem", source=_QR_SRC, roles=_QR_ROLES) + f""",
c AS (SELECT (SELECT rows_before FROM raw_n) AS rows_before, count(*) AS rows_distinct,
             count(*) FILTER (WHERE amount IS NULL) AS amount_dropped,
             count(*) FILTER (WHERE amount IS NOT NULL AND event_ts IS NULL) AS date_dropped FROM typed),
f AS (SELECT count(*) FILTER (WHERE is_iqr_outlier) AS iqr_outliers, count(amount) AS nv,
             count(DISTINCT amount) AS distinct_amounts, min(amount) AS any_amount FROM facts),
q AS (SELECT c.*, f.*, rows_before - rows_distinct AS duplicates_removed,
             rows_distinct - amount_dropped - date_dropped AS rows_after FROM c, f)
SELECT rows_before, duplicates_removed, amount_dropped, date_dropped, rows_after,
       CASE WHEN rows_before > 0 THEN {R('rows_after / rows_before * 100')} ELSE 100.0 END AS clean_rate,
       iqr_outliers, distinct_amounts,
       concat_ws('; ',
         CASE WHEN duplicates_removed > 0 THEN printf('Removed %d exact duplicate rows', duplicates_removed) END,
         CASE WHEN amount_dropped > 0 THEN printf('Dropped %d rows with unparseable l_quantity', amount_dropped) END,
         CASE WHEN date_dropped > 0 THEN printf('Dropped %d rows with invalid or future dates', date_dropped) END,
         CASE WHEN iqr_outliers > 0 THEN printf('Flagged %d IQR outliers (retained for analysis)', iqr_outliers) END,
         CASE WHEN rows_after >= 5 AND distinct_amounts = 1 THEN printf('WARNING: All %d revenue values are identical (%s) — possible template or test data', nv, CAST(any_amount AS VARCHAR))
              WHEN rows_after >= 5 AND distinct_amounts < nv * 0.05 THEN printf('WARNING: Revenue has only %d unique values across %d rows — data may be aggregated or artificial', distinct_amounts, nv) END
       ) AS issues
FROM q""")
def q_quality(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")
    fx = build_facts(li, Roles(revenue="l_quantity", date="l_shipdate"), (), AS_OF)
    return fx.quality.withColumn("issues", F.array_join("issues", "; "))


@register("drop_exact_duplicates", """SELECT (SELECT count(*) FROM lineitem_p) AS rows_before,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem_p)) AS rows_after,
  (SELECT count(*) FROM lineitem_p) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem_p)) AS duplicates_removed
FROM (SELECT 1) t, (SELECT 1) u""".replace("lineitem_p", "(SELECT l_returnflag, l_linestatus, l_quantity, l_shipdate FROM lineitem)"))
def q_dedup(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")
    return typed_rows(li, Roles()).agg(F.sum("_mult").alias("rows_before"), F.count("*").alias("rows_after")) \
        .select("rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("duplicates_removed"))


# ---------------------------------------------------------------- C10, R4
_MARKUP_SQL = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, "
               "'(?is)<script[\\s\\S]*?</script>', '', 'g'), '<[^>]*>', '', 'g'), '(?i)javascript:', '', 'g'), "
               "'(?i)on\\w+\\s*=', '', 'g'), '^[" + _WS_RE2 + "]+|[" + _WS_RE2 + "]+$', '', 'g')")


@register("strip_markup", f"SELECT page_id, {_MARKUP_SQL} AS text, length({_MARKUP_SQL}) AS n_chars FROM pages")
def q_markup(spark, sf):
    p = load(spark, sf, "pages")
    t = strip_markup(F.col("html"))
    return p.select("page_id", t.alias("text"), F.length(t).alias("n_chars"))


def _intent_sql(text: str) -> str:
    flags = {k: f"regexp_matches(lower(coalesce({text}, '')), '{v}')" for k, v in INTENT_PATTERNS.items()}
    prim = ("CASE WHEN {focus_anomaly} THEN 'anomaly' WHEN {focus_trend} THEN 'trend' WHEN {focus_user} THEN 'user' "
            "WHEN {focus_category} THEN 'category' WHEN {focus_stats} THEN 'distribution' "
            "WHEN {focus_quality} THEN 'quality' ELSE 'overview' END").format(**flags)
    return ", ".join(f"{v} AS {k}" for k, v in flags.items()) + f", {prim} AS primary_intent"


@register("classify_questions", f"SELECT conv_id, turn, {_intent_sql('text')} FROM conversations")
def q_intent(spark, sf):
    return classify_questions(load(spark, sf, "conversations"), "text").drop("role", "text")


@register("classify_documents", f"SELECT doc_id, {_intent_sql('text')} FROM documents")
def q_intent_docs(spark, sf):
    return classify_questions(load(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


# ---------------------------------------------------------------- R1, R3 over the catalogue of all tables
#: name -> (function, SQL): they describe schemas and read no row, so they are not registered as queries.
METADATA = {}


def _metadata(name, sql):
    def put(fn):
        METADATA[name] = (fn, sql)
        return fn
    return put


def _catalogue(spark, sf):
    return catalogue(spark, {t: load(spark, sf, t) for t in TABLES})


_ALIAS_VALUES = ", ".join(f"({ri}, '{role}', '{a}')" for ri, (role, al) in enumerate(COLUMN_ALIASES.items())
                          for a in al)
_CATALOGUE_SQL = ("(SELECT table_name AS \"table\", CAST(ordinal_position AS INTEGER) AS ordinal, column_name AS name "
                  "FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + "))")
_ROLES_SQL = f"""roles AS (
  SELECT c."table", d.role, arg_min(c.name, c.ordinal) AS "column"
  FROM {_CATALOGUE_SQL} c, (VALUES {_ALIAS_VALUES}) d(role_ord, role, alias)
  WHERE regexp_replace(lower(c.name), '[^a-z0-9_]', '_', 'g') = d.alias
     OR starts_with(regexp_replace(lower(c.name), '[^a-z0-9_]', '_', 'g'), d.alias || '_')
     OR ends_with(regexp_replace(lower(c.name), '[^a-z0-9_]', '_', 'g'), '_' || d.alias)
     OR (length(d.alias) > 4 AND contains(regexp_replace(lower(c.name), '[^a-z0-9_]', '_', 'g'), d.alias))
  GROUP BY c."table", d.role)"""


@_metadata("infer_roles", f"WITH {_ROLES_SQL} SELECT * FROM roles")
def q_roles(spark, sf):
    return infer_roles(_catalogue(spark, sf))


def _domain_case(h: str) -> str:
    parts = []
    for name, words in DOMAIN_KEYWORDS:
        cond = " OR ".join(f"contains({h}, '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(parts) + (" WHEN u AND r AND d THEN 'ecommerce' WHEN r AND d THEN 'transactional' "
                                        "WHEN r THEN 'revenue' ELSE 'generic' END")


@_metadata("infer_domain", f"""WITH {_ROLES_SQL},
h AS (SELECT "table", lower(string_agg(name, ' ' ORDER BY ordinal)) AS headers FROM {_CATALOGUE_SQL} c GROUP BY "table"),
f AS (SELECT "table", bool_or(role = 'user_id') AS u, bool_or(role = 'revenue') AS r, bool_or(role = 'date') AS d
      FROM roles GROUP BY "table"),
j AS (SELECT h."table", h.headers, coalesce(f.u, false) AS u, coalesce(f.r, false) AS r, coalesce(f.d, false) AS d
      FROM h LEFT JOIN f USING ("table"))
SELECT "table", {_domain_case('headers')} AS domain FROM j""")
def q_domain(spark, sf):
    return infer_domain(_catalogue(spark, sf))


# ---------------------------------------------------------------- F5
@register("inr_display", f"SELECT o_orderkey, o_totalprice, {inr_sql('o_totalprice')} AS display FROM orders")
def q_inr(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", "o_totalprice", inr_display(F.col("o_totalprice")).alias("display"))


@register("inr_display_balances", f"SELECT c_custkey, c_acctbal, {inr_sql('c_acctbal')} AS display FROM customer")
def q_inr_c(spark, sf):
    c = load(spark, sf, "customer")
    return c.select("c_custkey", "c_acctbal", inr_display(F.col("c_acctbal")).alias("display"))


# ---------------------------------------------------------------- F4
SQL_CHART_SERIES = facts_cte("orders") + f""",
cats AS (SELECT CASE WHEN category IS NULL OR category = '' THEN 'Unknown' ELSE category END AS name,
                sum(coalesce(amount, 0.0)) AS v FROM facts GROUP BY 1),
ranked AS (SELECT name, {R('v')} AS val, row_number() OVER (ORDER BY v DESC, name) AS seq,
                  count(*) OVER () AS n FROM cats QUALIFY seq <= 12),
mon AS (SELECT strftime(event_ts, '%Y-%m') AS month, {R('sum(coalesce(amount, 0.0))')} AS val FROM facts GROUP BY 1),
line AS (SELECT month, val, row_number() OVER (ORDER BY month) AS seq, count(*) OVER () AS n FROM mon)
SELECT 'bar' AS chart, seq, substr(name, 1, 20) AS name, substr(replace(name, '"', '\\"'), 1, 20) AS tag_name, val FROM ranked WHERE seq <= 8
UNION ALL SELECT 'pie', seq, substr(name, 1, 20), substr(replace(name, '"', '\\"'), 1, 20), val FROM ranked WHERE seq <= 8 AND n >= 3
UNION ALL SELECT 'line', seq, month, replace(month, '"', '\\"'), val FROM line WHERE seq <= 12 AND n >= 2"""


@register("chart_series", SQL_CHART_SERIES)
def q_charts(spark, sf):
    f = facts(spark, sf, "orders").df
    return RP.chart_series(M.category_breakdown(f), M.monthly_trend(f))


def _chart_tags_sql() -> str:
    base = SQL_CHART_SERIES.rsplit("SELECT 'bar' AS chart", 1)
    pt = "'{\"name\":\"' || tag_name || '\",\"val\":' || " + numtext_sql("val") + " || '}'"
    return base[0].rstrip() + ",\ns AS (SELECT 'bar' AS chart" + base[1] + f""")
SELECT chart, '[CHART:' || chart || '|' || CASE chart WHEN 'bar' THEN 'Revenue by Category'
         WHEN 'pie' THEN 'Category Distribution' ELSE 'Revenue Trend' END || '|[' ||
       string_agg({pt}, ',' ORDER BY seq) || ']]' AS tag
FROM s GROUP BY chart"""


@register("chart_tags", _chart_tags_sql())
def q_chart_tags(spark, sf):
    f = facts(spark, sf, "orders").df
    return RP.chart_tags(RP.chart_series(M.category_breakdown(f), M.monthly_trend(f)))


# ---------------------------------------------------------------- F3 (KPI cards), F6
@register("kpi_cards", facts_cte("events") + ",\n" + describe_sql("facts", "amount") + f""",
d0 AS (SELECT strftime(event_ts, '%Y-%m-%d') AS day, {R('sum(coalesce(amount, 0.0))')} AS val FROM facts GROUP BY day),
rn AS (SELECT val, row_number() OVER (ORDER BY day DESC) AS r, count(*) OVER () AS n FROM d0),
g AS (SELECT CASE WHEN max(n) >= 14 AND sum(CASE WHEN r BETWEEN 8 AND 14 THEN val END) > 0 THEN
         {R('(sum(CASE WHEN r <= 7 THEN val END) - sum(CASE WHEN r BETWEEN 8 AND 14 THEN val END)) / sum(CASE WHEN r BETWEEN 8 AND 14 THEN val END) * 100')} END AS growth FROM rn),
m AS (SELECT described.sum AS revenue, (SELECT count(*) FROM facts) AS orders,
             {R('described.sum / (SELECT count(*) FROM facts)')} AS aov, described.median AS median_order, g.growth
      FROM described, g)
SELECT 'kpi' AS section, CAST(1 AS BIGINT) AS seq, 'Total Revenue' AS label, revenue AS value, {inr_sql('revenue')} AS display, 'neutral' AS direction FROM m
UNION ALL SELECT 'kpi', 2, 'Transactions', CAST(orders AS DOUBLE), CAST(orders AS VARCHAR), 'neutral' FROM m
UNION ALL SELECT 'kpi', 3, 'Avg Order Value', aov, {inr_sql('aov')}, 'neutral' FROM m
UNION ALL SELECT 'kpi', 4, 'WoW Growth', growth, {numtext_sql('growth')} || '%', CASE WHEN growth >= 0 THEN 'up' ELSE 'down' END FROM m WHERE growth IS NOT NULL
UNION ALL SELECT 'kpi', 5, 'Median Order', median_order, {inr_sql('median_order')}, 'neutral' FROM m""")
def q_kpi(spark, sf):
    f = facts(spark, sf, "events").df
    metrics = M.headline(f).crossJoin(M.week_over_week(M.daily_trend(f)).select("growth"))
    return RP.kpi_table(metrics).select("section", F.col("seq").cast("int").alias("seq"), "label", "value",
                                         "display", "direction")


_KPI_FULL_SQL = facts_cte("events") + ",\n" + describe_sql("facts", "amount") + f""",
d0 AS (SELECT strftime(event_ts, '%Y-%m-%d') AS day, {R('sum(coalesce(amount, 0.0))')} AS val FROM facts GROUP BY day),
rn AS (SELECT val, row_number() OVER (ORDER BY day DESC) AS r, count(*) OVER () AS n FROM d0),
g AS (SELECT CASE WHEN max(n) >= 14 AND sum(CASE WHEN r BETWEEN 8 AND 14 THEN val END) > 0 THEN
         {R('(sum(CASE WHEN r <= 7 THEN val END) - sum(CASE WHEN r BETWEEN 8 AND 14 THEN val END)) / sum(CASE WHEN r BETWEEN 8 AND 14 THEN val END) * 100')} END AS growth FROM rn),
m AS (SELECT described.sum AS revenue, (SELECT count(*) FROM facts) AS orders,
             {R('described.sum / (SELECT count(*) FROM facts)')} AS aov, described.median AS median_order, g.growth
      FROM described, g),
cg AS (SELECT CASE WHEN category IS NULL OR category = '' THEN 'Unknown' ELSE category END AS name,
              sum(coalesce(amount, 0.0)) AS v, count(*) AS cnt FROM facts GROUP BY 1),
cr AS (SELECT name, {R('v')} AS val, cnt, row_number() OVER (ORDER BY v DESC, name) AS rank FROM cg QUALIFY rank <= 12),
ct AS (SELECT sum(val) AS tot FROM cr),
dist AS (SELECT * FROM (SELECT mean, median, std, min, max, max - min AS rng, p25, p75, p75 - p25 AS iqr, skew FROM described)),
q AS (SELECT CASE WHEN (SELECT rows_before FROM raw_n) > 0 THEN {R('(SELECT count(*) FROM facts) / (SELECT rows_before FROM raw_n) * 100')} ELSE 100.0 END AS cr)
SELECT 'kpi' AS section, CAST(1 AS BIGINT) AS seq, 'Total Revenue' AS label, revenue AS value, {inr_sql('revenue')} AS display, 'neutral' AS direction FROM m
UNION ALL SELECT 'kpi', 2, 'Transactions', CAST(orders AS DOUBLE), CAST(orders AS VARCHAR), 'neutral' FROM m
UNION ALL SELECT 'kpi', 3, 'Avg Order Value', aov, {inr_sql('aov')}, 'neutral' FROM m
UNION ALL SELECT 'kpi', 4, 'WoW Growth', growth, {numtext_sql('growth')} || '%', CASE WHEN growth >= 0 THEN 'up' ELSE 'down' END FROM m WHERE growth IS NOT NULL
UNION ALL SELECT 'kpi', 5, 'Median Order', median_order, {inr_sql('median_order')}, 'neutral' FROM m
UNION ALL SELECT 'distribution', 1, 'Mean', mean, {inr_sql('mean')}, 'neutral' FROM dist
UNION ALL SELECT 'distribution', 2, 'Median', median, {inr_sql('median')}, 'neutral' FROM dist
UNION ALL SELECT 'distribution', 3, 'Std Dev', std, {inr_sql('std')}, 'neutral' FROM dist
UNION ALL SELECT 'distribution', 4, 'Min', min, {inr_sql('min')}, 'neutral' FROM dist
UNION ALL SELECT 'distribution', 5, 'Max', max, {inr_sql('max')}, 'neutral' FROM dist
UNION ALL SELECT 'distribution', 6, 'Range', rng, {inr_sql('rng')}, 'neutral' FROM dist
UNION ALL SELECT 'distribution', 7, 'P25', p25, {inr_sql('p25')}, 'neutral' FROM dist
UNION ALL SELECT 'distribution', 8, 'P75', p75, {inr_sql('p75')}, 'neutral' FROM dist
UNION ALL SELECT 'distribution', 9, 'IQR', iqr, {inr_sql('iqr')}, 'neutral' FROM dist
UNION ALL SELECT 'distribution', 10, 'Skewness', skew,
   regexp_replace(printf('%.3f', {R('skew', 3)}), '[.]?0+$', '') || ' (' ||
   CASE WHEN abs(skew) < 0.5 THEN 'approximately normal' WHEN skew > 0 THEN 'right-skewed — outliers pulling mean up' ELSE 'left-skewed' END || ')',
   'neutral' FROM dist
UNION ALL SELECT 'category', rank, name, val,
   {inr_sql('val')} || ' (' || {numtext_sql('CASE WHEN ct.tot > 0 THEN val / ct.tot * 100 ELSE 0.0 END')} || '% share, ' || CAST(cnt AS VARCHAR) || ' transactions)',
   'neutral' FROM cr, ct WHERE rank <= 10
UNION ALL SELECT 'quality', 1, 'Data quality verdict', cr,
   CASE WHEN cr >= 95 THEN 'CLEAN ✓' WHEN cr >= 85 THEN 'MINOR ISSUES' ELSE 'NEEDS ATTENTION' END, 'neutral' FROM q"""


@register("kpi_table", _KPI_FULL_SQL)
def q_kpi_full(spark, sf):
    fx = facts(spark, sf, "events")
    f = fx.df
    metrics = M.headline(f).crossJoin(M.week_over_week(M.daily_trend(f)).select("growth"))
    out = RP.kpi_table(metrics, describe_measure(f, AMOUNT), M.category_breakdown(f), fx.quality)
    return out.withColumn("seq", F.col("seq").cast("int"))
