"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from covarium.llm import quality, urls

BLANK = "\\x20\\x09-\\x0D"


def quality_sql() -> str:
    """Counts, certified cutoffs and verdicts of the quality rules."""
    ratios = ", ".join(f"({ratio}) AS {rule}" for rule, (ratio, _) in quality.RULES.items())
    firsts = ", ".join(f"any_value({rule}) AS {rule}" for rule in quality.RULES)
    grid = ", ".join(f"('{rule}', {k}, {c}::DOUBLE)" for rule, (_, g) in quality.RULES.items() for k, c in enumerate(g))
    long = " UNION ALL ".join(f"SELECT stratum, quality, '{rule}' AS rule, {rule} AS value FROM held" for rule in quality.RULES)
    fails = " OR ".join(f"coalesce(f.{rule} > (SELECT cutoff FROM best b WHERE b.stratum = f.stratum AND b.rule = '{rule}'), false)" for rule in quality.RULES)
    tests, p = sum(len(g) for _, g in quality.RULES.values()), quality.RISK / len(quality.RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS stratum FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[{BLANK}]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{BLANK}]')) AS lines FROM d),
t AS (SELECT doc_id, p, words[p] AS a, words[p + 1] AS b, words[p + 2] AS c FROM w, unnest(range(1, len(words) - 1)) AS u(p)),
k AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM k WHERE n > 1) GROUP BY doc_id),
n AS (SELECT doc_id, stratum, md5(text) AS same, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[{BLANK}]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ratios} FROM n),
held AS (SELECT stratum, same, min(quality) AS quality, {firsts} FROM f JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed GROUP BY stratum, same),
long AS ({long}), grid(rule, place, cutoff) AS (VALUES {grid}),
sums AS (SELECT stratum, rule, place, cutoff, count(*) FILTER (quality > 0) AS n_good, count(*) FILTER (quality > 0 AND value > cutoff) AS k_good, count(*) FILTER (quality <= 0 AND value > cutoff) AS k_bad FROM long JOIN grid USING (rule) GROUP BY ALL),
tail AS (SELECT s.stratum, s.rule, s.place, sum(exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({p}) + (n_good - j) * ln(1 - {p}))) AS p_value FROM sums s, unnest(range(k_good + 1)) AS u(j) WHERE n_good > 0 AND k_good < n_good * {p} GROUP BY ALL),
best AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY k_bad - {quality.WEIGHT} * k_good DESC, place DESC) AS rank FROM sums JOIN tail USING (stratum, rule, place)
 WHERE p_value <= {quality.LEVEL} / ({tests} * (SELECT count(DISTINCT stratum) FROM held)) AND k_bad > {quality.WEIGHT} * k_good) WHERE rank = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({fails}) AS kept FROM f"""


def urls_sql() -> str:
    """Rule decisions and alias verdicts; aliases by absolute canonical links (others are held against brute force in the tests)."""
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in urls.RULES)
    host = f"translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{urls.UPPER}', '{urls.LOWER}')"
    path = "regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    best = "SELECT {key}, arg_max(rhost || prefix, length(rhost || prefix)) AS rule, arg_max(action, length(rhost || prefix)) AS action FROM {src} JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, prefix) GROUP BY {key}"
    return f"""WITH RECURSIVE rules(action, rhost, prefix) AS (VALUES {rules}),
pg AS (SELECT page_id, url, {host} AS host, {path} AS path, split_part(url, '#', 1) AS address, regexp_extract(html, '(?i)<link[^>]*rel=.?canonical[^>]*href=.?(https?://[^"''\\s>#]+)', 1) AS target FROM pages),
e AS (SELECT address AS a, target AS b FROM pg WHERE target <> '' UNION SELECT target, address FROM pg WHERE target <> ''),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
vertex AS (SELECT DISTINCT b AS url FROM reach), v AS (SELECT url, {host} AS host, {path} AS path FROM vertex),
vd AS ({best.format(key="url", src="v")}), dec AS ({best.format(key="page_id", src="pg")}),
kin AS (SELECT reach.a AS address, bool_or(action = 'block') AS blocked, bool_or(action = 'allow') AS allowed FROM reach JOIN vd ON reach.b = vd.url GROUP BY reach.a)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN coalesce(blocked, false) AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict FROM pg LEFT JOIN dec USING (page_id) LEFT JOIN kin USING (address)"""
