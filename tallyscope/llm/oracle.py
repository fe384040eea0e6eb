"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from . import mixing
from .secret_scan import BASE, RULES

#: The blanks, as a DuckDB character class.
BLANK = r"[\x20\x09-\x0D]"


def _esc(s: str) -> str:
    return s.replace("'", "''")


WARC_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT h, max(page_id) AS head FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, d.h AS payload_digest,
       CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM d LEFT JOIN g ON d.h = g.h"""


def line_dedup_cte(source: str) -> str:
    """CTEs ending in ``deduped``: doc_id, text, n_lines, n_removed, new_text of ``source``."""
    trim = "trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
lines AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
          FROM (SELECT DISTINCT doc_id, text FROM {source})),
full_lines AS (SELECT *, {trim} AS body FROM lines WHERE {trim} <> ''),
numbered AS (SELECT *, row_number() OVER w AS k,
                    lead(body, 1) OVER w AS body2, lead(body, 2) OVER w AS body3
             FROM full_lines WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
wins AS (SELECT doc_id, text, k, row_number() OVER (
             PARTITION BY body, body2, body3 ORDER BY doc_id NULLS FIRST, k) AS nth
         FROM numbered WHERE body3 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, text, k + i AS k FROM wins, (VALUES (0), (1), (2)) AS t(i) WHERE nth > 1),
flagged AS (SELECT l.doc_id, l.text, l.pos, l.line, n.k, g.k IS NOT NULL AS removed
            FROM lines l LEFT JOIN numbered n ON l.doc_id IS NOT DISTINCT FROM n.doc_id
                 AND l.text IS NOT DISTINCT FROM n.text AND l.pos = n.pos
            LEFT JOIN gone g ON n.doc_id IS NOT DISTINCT FROM g.doc_id
                 AND n.text IS NOT DISTINCT FROM g.text AND n.k = g.k),
deduped AS (SELECT doc_id, text, count(k) AS n_lines, count(*) FILTER (removed) AS n_removed,
                   CASE WHEN text IS NOT NULL THEN coalesce(
                       string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed), '') END AS new_text
            FROM flagged GROUP BY doc_id, text)"""


LINE_DEDUP_SQL = f"""WITH {line_dedup_cte('documents')}
SELECT d.doc_id, n_lines, n_removed, md5(new_text) AS text_md5
FROM documents d JOIN deduped x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text IS NOT DISTINCT FROM x.text"""


def _secret_spans(kind: str, pattern: str, group: int, least: int, order: int) -> str:
    p = _esc(pattern)
    return f"""
SELECT doc_id, t, {order} AS ord, '{kind}' AS kind, m, part, gap, i,
       list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(
           list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS len
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, t, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS part,
           string_split_regex(t, '{p}') AS gap FROM src WHERE regexp_matches(t, '{p}')))
WHERE length(part[i]) >= {least}"""


SECRET_SCAN_SQL = f"""WITH src AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_secret_spans(r.kind, r.pattern, r.group, r.least, k) for k, r in enumerate(RULES))}),
by_doc AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + len AS BIGINT), ',' ORDER BY s, ord)
        FILTER (ord < {len(BASE)}) AS base,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + len AS BIGINT), ',' ORDER BY s, ord) AS spans
    FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN by_doc USING (doc_id)"""


def _topic_sql(text: str) -> str:
    return f"""CASE WHEN contains({text}, 'icense') THEN 'legal'
 WHEN regexp_matches({text}, '[0-9]{{7}}|@') THEN 'personal' WHEN contains({text}, ' | ') THEN 'tabular'
 WHEN regexp_matches({text}, '[#$%&*]{{3}}') THEN 'markup' ELSE 'prose' END"""


def mixing_cte(source: str, targets: dict = mixing.TARGETS, rounds: int = mixing.ROUNDS,
               rate: float = mixing.RATE) -> str:
    """CTEs ending in ``mixed``: every row of ``source`` with its ratio, probability, selected."""
    w = rf"len(list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}+'), lambda x: x <> ''))"
    out = [f"""feats AS (SELECT *, coalesce(source, '{mixing.NONE}') AS s_, coalesce(lang, '{mixing.NONE}') AS l_,
 {_topic_sql("coalesce(text, '')")} AS t_, {w} AS n_tokens FROM {source}),
c0 AS MATERIALIZED (SELECT s_, l_, t_, CAST(sum(n_tokens) AS DOUBLE) AS base, CAST(sum(n_tokens) AS DOUBLE) AS w
 FROM feats GROUP BY ALL)"""]
    col = {"source": "s_", "lang": "l_", "topic": "t_"}
    for d, target in targets.items():
        c = col[d]
        if isinstance(target, dict):
            named = " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in target.items())
            rest = max(0.0, 1.0 - sum(target.values()))
            inside = ", ".join(f"'{k}'" for k in target)
            share = f"CASE {named} ELSE {rest} * mass / (SELECT sum(mass) FROM m_{d} WHERE {c} NOT IN ({inside})) END"
        else:
            share = f"pow(mass / (SELECT sum(mass) FROM m_{d}), {float(target)})"
        out.append(f"m_{d} AS (SELECT {c}, sum(base) AS mass FROM c0 GROUP BY 1 HAVING sum(base) > 0)")
        out.append(f"h_{d} AS (SELECT {c}, {share} AS share FROM m_{d})")
        out.append(f"g_{d} AS MATERIALIZED (SELECT {c}, share / (SELECT sum(share) FROM h_{d}) * "
                   f"(SELECT sum(mass) FROM m_{d}) AS target FROM h_{d})")
    n = 0
    for _ in range(rounds):
        for d in targets:
            c = col[d]
            out.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.s_, c.l_, c.t_, c.base, least(CASE WHEN now > 0 THEN
 c.w * coalesce(target / now, 0) ELSE 0 END, c.base / {float(rate)}::DOUBLE) AS w FROM c{n} c
 JOIN (SELECT {c}, sum(w) AS now FROM c{n} GROUP BY 1) x ON c.{c} = x.{c} LEFT JOIN g_{d} g ON c.{c} = g.{c})""")
            n += 1
    out.append(f"ratios AS (SELECT s_, l_, t_, CASE WHEN base > 0 THEN w / base ELSE 0 END AS ratio FROM c{n})")
    out.append(f"probs AS (SELECT *, ratio * {float(rate)}::DOUBLE AS probability FROM ratios)")
    out.append(f"""mixed AS (SELECT f.*, ratio, probability, n_tokens > 0 AND CAST(CAST('0x' || substr(md5('{mixing.SEED}:' ||
 coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < probability AS selected
 FROM feats f JOIN probs USING (s_, l_, t_))""")
    return ",\n".join(out)


def mixing_sql() -> str:
    return f"""WITH {mixing_cte('documents')}
SELECT doc_id, s_ AS source, l_ AS lang, t_ AS topic, n_tokens, round(ratio, 6) AS ratio,
       round(probability, 6) AS probability, selected FROM mixed"""


#: ASCII letters lowered, others left as they are.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DIVERGENCE_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs
      FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS terms, sum(total) AS size FROM k GROUP BY lang),
ck AS (SELECT c.lang, c.source, c.term, c.n, k.total FROM c JOIN k USING (lang, term)),
g AS (SELECT x.lang, x.source, coalesce(s.size, 0)::HUGEINT AS size
      FROM (SELECT DISTINCT lang, source FROM d) x
      LEFT JOIN (SELECT lang, source, sum(n) AS size FROM ck GROUP BY ALL) s USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(ck.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(ck.n, 0) + 1) // (g.size + v.terms) AS p,
             1 + 1000000000::HUGEINT * (k.total + 1) // (v.size + v.terms) AS q
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN ck USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
             SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
         ON a.lang = s.lang AND a.source = s.source AND b.source = s.item),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER w::INTEGER AS rank FROM ranked
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 200"""


def _crc_step(c: int) -> int:
    for _ in range(8):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


def crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, one table step a byte."""
    table = ", ".join(str(_crc_step(i)) for i in range(256))
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, octet_length(encode({text}))),
 lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)),
 lambda c, b: xor(c >> 8, ([{table}]::BIGINT[])[(xor(c, b) & 255) + 1])))"""


RESAMPLE_SQL = rf"""WITH words AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents),
each AS (SELECT unnest(ws) AS w FROM words),
aims AS (SELECT unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
hashed AS MATERIALIZED (SELECT w, {crc32_sql('w')} % 10000 AS bucket FROM (SELECT w FROM each UNION SELECT w FROM aims)),
s AS (SELECT bucket, count(*) AS s FROM each JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN hashed USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM each) + 10000.0::DOUBLE)
    / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM aims) + 10000.0::DOUBLE))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
of_word AS (SELECT w, gain FROM hashed JOIN gain USING (bucket)),
numbered AS (SELECT row_number() OVER () AS r, doc_id, ws FROM words),
sums AS (SELECT r, sum(gain) AS total FROM (SELECT r, unnest(ws) AS w FROM numbered) JOIN of_word USING (w) GROUP BY r),
weighed AS (SELECT doc_id, len(ws) AS n_features, CASE WHEN len(ws) = 0 THEN 0
    ELSE floor(total::DOUBLE / len(ws)) END::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM numbered LEFT JOIN sums USING (r)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
       CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM drawn) THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN drawn USING (doc_id)"""
