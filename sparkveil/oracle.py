"""SQL for the same answers as the engine's plans, built from the same patterns and policies.

It follows other ways where there are any: offsets by running sums over list
elements, overlap by islands and ranks, splicing by ordered string aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from .operators.recognizers import CONTEXT_BOOST, CONTEXT_REACH, Pattern


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def luhn(value: str) -> str:
    digits = f"list_transform(string_split(regexp_replace({value}, '[^0-9]', '', 'g'), ''), lambda c: c::INT)"
    n = f"len({digits})"
    return f"(list_sum(list_transform(range(1, {n} + 1), lambda i: CASE WHEN ({n} - i) % 2 = 1 THEN CASE WHEN {digits}[i] * 2 > 9 THEN {digits}[i] * 2 - 9 ELSE {digits}[i] * 2 END ELSE {digits}[i] END)) % 10 = 0)"


def mod97(value: str) -> str:
    plain = f"upper(regexp_replace({value}, '[^0-9A-Za-z]', '', 'g'))"
    codes = f"list_transform(string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)"
    return f"(list_reduce([0] || {codes}, lambda a, c: (CASE WHEN c >= 10 THEN a * 100 ELSE a * 10 END + c) % 97) = 1)"


def matches(p: Pattern, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """(key, start, end, value, label, conf, pattern) of one pattern, after its checksum and context."""
    value = f"regexp_extract(hit, {quote(p.inner)})" if p.inner else "hit"
    conf = f"{p.confidence}::FLOAT"
    near = f"lower(substr(t, greatest(s - {CONTEXT_REACH}, 0) + 1, e + {CONTEXT_REACH} - greatest(s - {CONTEXT_REACH}, 0)))"
    if p.context:
        words = quote(r"\b(?:" + "|".join(map(re.escape, p.context)) + r")\b")
        conf = f"(CASE WHEN regexp_matches({near}, {words}) THEN least(1.0, {p.confidence} + {CONTEXT_BOOST}) ELSE {p.confidence} END)::FLOAT"
    check = {"luhn": f" WHERE {luhn('v')}", "mod97": f" WHERE {mod97('v')}"}.get(p.check, "")
    return f"""(SELECT k AS {key}, s AS start, e AS "end", v AS value, {quote(p.label)} AS label, {conf} AS conf, {quote(p.name)} AS pattern FROM (
  SELECT k, t, p0 + len(hit) - len(v) AS s, p0 + len(hit) AS e, v FROM (
    SELECT k, t, hit, {value} AS v, (list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: len(h))), 0))::BIGINT AS p0 FROM (
      SELECT {key} AS k, {text} AS t, hits, string_split_regex({text}, {quote(p.regex)}) AS gaps, unnest(hits) AS hit, generate_subscripts(hits, 1) AS i
      FROM (SELECT {key}, {text}, regexp_extract_all({text}, {quote(p.regex)}) AS hits FROM {table})))){check})"""


def spans(patterns: Sequence[Pattern], table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return " UNION ALL ".join(f"SELECT * FROM {matches(p, table, key, text)}" for p in patterns)


def winners(patterns: Sequence[Pattern], table: str = "documents", key: str = "doc_id", text: str = "text", baseline: float = 0.35, whole: bool = True) -> str:
    """CTEs ending in w: one span per cluster of overlaps, the strongest, at or over the baseline; over all that the cluster covers, or with its own bounds."""
    bounds = "s0, e0" if whole else 'start, "end"'
    first, last = bounds.split(", ")
    return f"""raw AS ({spans(patterns, table, key, text)}),
m0 AS (SELECT *, max("end") OVER (PARTITION BY {key}, label ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM raw),
m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, label ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m0),
m2 AS (SELECT {key}, label, min(start) AS start, max("end") AS "end", max(conf) AS conf, arg_max(pattern, conf) AS pattern, count(*) AS merged FROM m1 GROUP BY {key}, label, island),
c0 AS (SELECT *, max("end") OVER (PARTITION BY {key} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m2),
c1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM c0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY {key}, island ORDER BY conf DESC, "end" - start DESC, start, label) AS r, count(*) OVER (PARTITION BY {key}, island) - 1 AS beaten, min(start) OVER (PARTITION BY {key}, island) AS s0, max("end") OVER (PARTITION BY {key}, island) AS e0 FROM c1),
w AS (SELECT c2.{key}, c2.{first} AS start, c2.{last} AS "end", substr(d.{text}, c2.{first} + 1, c2.{last} - c2.{first}) AS value, c2.label, c2.conf, c2.pattern, c2.merged, c2.beaten FROM c2 JOIN {table} d ON d.{key} = c2.{key} WHERE r = 1 AND conf >= {baseline}::FLOAT)"""


def redacted(patterns: Sequence[Pattern], replacement: str, keep: str = "true", table: str = "documents", key: str = "doc_id", text: str = "text", extra: str = "") -> str:
    """(key, redacted, n_entities): texts with each winner that ``keep`` holds for replaced by an expression over value, label and pattern."""
    return f"""WITH {winners(patterns, table, key, text)},
x AS (SELECT *, ({replacement}) AS repl FROM w WHERE {keep}),
o AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY {key} ORDER BY start), 0) AS prev FROM x),
j AS (SELECT o.{key}, string_agg(substr(d.{text}, prev + 1, start - prev) || repl, '' ORDER BY start) AS body, max("end") AS last FROM o JOIN {table} d ON d.{key} = o.{key} GROUP BY o.{key}),
n AS (SELECT {key}, count(*) AS n FROM w GROUP BY {key})
SELECT d.{key}{extra}, CASE WHEN j.{key} IS NULL THEN d.{text} ELSE j.body || substr(d.{text}, last + 1) END AS redacted, coalesce(n.n, 0)::BIGINT AS n_entities
FROM {table} d LEFT JOIN j ON j.{key} = d.{key} LEFT JOIN n ON n.{key} = d.{key}"""
