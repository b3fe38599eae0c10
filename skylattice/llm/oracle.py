"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from . import decontam, quality
from .substring_dedup import WINDOW

GAP = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{GAP}'), lambda x: x <> '')"

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
x AS (SELECT rid, i, array_to_string(w[i + 1 : i + {WINDOW}], ' ') AS k FROM d, unnest(range(greatest(len(w) - {WINDOW - 1}, 0))) u(i)),
r AS (SELECT rid, i FROM x WHERE k IN (SELECT k FROM x GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, i + j AS p FROM r, range({WINDOW}) t(j)),
p AS (SELECT rid, u.i AS p, w[u.i + 1] AS word FROM d, unnest(range(len(w))) u(i)),
k AS (SELECT p.rid, count(*) AS n, string_agg(word, ' ' ORDER BY p.p) AS t FROM p ANTI JOIN gone ON p.rid = gone.rid AND p.p = gone.p GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""


def _op2() -> str:
    each = "\nUNION ALL ".join(
        f"SELECT lang, source, '{name}' AS ratio, CASE WHEN {den} > 0 THEN {num} * {scale} // {den} ELSE 0 END AS v FROM c WHERE NOT base_failed" for name, num, den, scale, _ in quality.RATIOS
    )

    def level(keys: str, k: str) -> str:
        by = f"{keys}, " if keys else ""
        cells = ", ".join(f"max(CASE WHEN ratio = '{name}' THEN {x} END) AS {name}_{x}" for name, *_ in quality.RATIOS for x in ("low", "mid", "high"))
        return f"""{k}m AS (SELECT {by}ratio, bucket, sum(n) AS n FROM b GROUP BY ALL),
{k}r AS (SELECT *, sum(n) OVER (PARTITION BY {by}ratio ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {by}ratio) AS total FROM {k}m),
{k}q AS (SELECT {by}ratio, max(total) AS total, min(CASE WHEN upto * 100 >= total * {quality.LOW} THEN bucket END) AS low, min(CASE WHEN upto * 100 >= total * 50 THEN bucket END) AS mid, min(CASE WHEN upto * 100 >= total * {quality.HIGH} THEN bucket END) AS high FROM {k}r GROUP BY ALL),
{k} AS (SELECT {by}max(total) AS total, {cells} FROM {k}q {"GROUP BY ALL" if keys else ""})"""

    tests = []
    for name, num, den, scale, slack in quality.RATIOS:
        pick = lambda x: f"CASE WHEN s.total >= {quality.LEAST_GROUP} THEN s.{name}_{x} WHEN l.total >= {quality.LEAST_GROUP} THEN l.{name}_{x} ELSE a.{name}_{x} END"  # noqa: E731, B023
        v = f"(CASE WHEN {den} > 0 THEN {num} * {scale} // {den} ELSE 0 END)"
        mid, low, high = (f"({pick(x)})" for x in ("mid", "low", "high"))
        tests.append(f"{v} <= {high} + {quality.SPREAD} * ({high} - {mid}) + {slack}")
        if name == "mean_word_length":
            tests.append(f"{v} >= {low} - {quality.SPREAD} * ({mid} - {low}) - {slack}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
e AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
t AS (SELECT rid, i, w[i + 1 : i + 3] AS k FROM d, unnest(range(greatest(len(w) - 2, 0))) u(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM t) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, range(3) x(j) GROUP BY 1),
c0 AS (SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^{quality.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines FROM e LEFT JOIN cov USING (rid)),
c AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c0),
v AS ({each}),
b AS (SELECT lang, source, ratio, (v >> greatest(length(bin(v)) - 11, 0)) << greatest(length(bin(v)) - 11, 0) AS bucket, count(*) AS n FROM v GROUP BY ALL),
{level("lang, source", "s")},
{level("lang", "l")},
{level("", "a")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, coalesce(NOT base_failed AND {" AND ".join(tests)}, false) AS kept
FROM c LEFT JOIN s ON c.lang IS NOT DISTINCT FROM s.lang AND c.source IS NOT DISTINCT FROM s.source LEFT JOIN l ON c.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a"""


def _op6(rules) -> str:
    listed = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for v, r in rules)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
h AS (SELECT row_number() OVER () AS rid, page_id, r, regexp_extract(r, '^[^/?#]*') AS raw FROM u),
p AS (SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM h),
l(rule, rhost, rpath, verdict) AS (VALUES {listed}),
f AS (SELECT rid, arg_max(l.rule, length(l.rule)) AS rule, arg_max(l.verdict, length(l.rule)) AS verdict FROM p JOIN l ON (p.host = l.rhost OR ends_with(p.host, '.' || l.rhost)) AND starts_with(p.path, l.rpath) GROUP BY 1)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (rid)"""


def _op10() -> str:
    span, around, window, agree = decontam.SPAN, decontam.AROUND, decontam.WINDOW, decontam.AGREE
    tokens = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    seed = lambda mask: "concat_ws(' ', " + ", ".join(f"w[i + {j + 1}]" for j, b in enumerate(mask) if b == "1") + ")"
    seeds = lambda t, key: "\nUNION ALL ".join(f"SELECT {key}, i AS pos, '{k}|' || {seed(m)} AS seed FROM {t}, unnest(range(greatest(len(w) - {span - 1}, 0))) u(i)" for k, m in enumerate(decontam.MASKS))
    return f"""
WITH d AS (SELECT doc_id, {tokens} AS w FROM documents), b AS (SELECT DISTINCT item_id, {tokens} AS w FROM benchmark),
ds AS ({seeds("d", "doc_id")}), bs AS (SELECT DISTINCT * FROM ({seeds("b", "item_id")})),
h AS (SELECT doc_id, item_id, ds.pos - bs.pos AS diag, min(bs.pos) AS a, max(bs.pos) AS z FROM ds JOIN bs USING (seed) GROUP BY ALL),
j AS (SELECT doc_id, item_id, diag, greatest(a - {around}, -diag, 0) AS lo, least(z + {span + around}, len(b.w), len(d.w) - diag) AS hi, least(len(b.w), {window}) AS size, d.w AS dw, b.w AS bw
  FROM h JOIN b USING (item_id) JOIN d USING (doc_id)),
m AS (SELECT doc_id, item_id, diag, lo, hi - lo AS n, size, list_transform(range(hi - lo), lambda i: (dw[lo + diag + i + 1] = bw[lo + i + 1])::INT) AS same FROM j WHERE hi - lo >= size),
g AS (SELECT doc_id, item_id, list_sum(same)::BIGINT AS matches, n::BIGINT AS compared, (lo + diag)::BIGINT AS doc_start, lo::BIGINT AS item_start FROM m
  WHERE len(list_filter(range(n - size + 1), lambda i: list_sum(same[i + 1 : i + size]) * 100 >= size * {agree})) > 0
  UNION ALL SELECT doc_id, item_id, len(b.w), len(b.w), i, 0 FROM d, b, unnest(range(greatest(len(d.w) - len(b.w) + 1, 0))) u(i) WHERE len(b.w) BETWEEN 1 AND {span - 1} AND d.w[i + 1 : i + len(b.w)] = b.w)
SELECT doc_id, item_id, matches, compared, doc_start, item_start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matches DESC, doc_start, item_start, compared DESC) AS k FROM g) WHERE k = 1"""


def sql(rules) -> dict[str, str]:
    return {"op2_quality_rules": _op2(), "op3_substring_dedup": OP3, "op6_url_filters": _op6(rules), "op10_decontamination": _op10()}
