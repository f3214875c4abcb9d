"""Site-relative line dedup.

Boilerplate is what many pages of one site repeat: for each host, the number of
pages that contain a line is divided by the host's number of pages, and lines
over a ratio are dropped from all its pages. Lines are counted by host and a
64-bit hash, so the shuffle carries keys and not text, and partial sums meet
before it. What is found is bounded by ratio: a host has at most (mean distinct lines
per page / ratio) such lines, so they fit one array per host, and documents
meet that array in a join by host that is broadcast only if the array table's
measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage

#: Share of a host's pages that may contain a line before it is boilerplate.
RATIO = 0.05
#: A line on fewer pages is never boilerplate, whatever the host's size: two pages that share a line may be copies.
LEAST_PAGES = 3


def line_key(line: Column) -> Column:
    """64 bits of a line without outer blanks."""
    return F.xxhash64(trimmed(line))


def trimmed(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\x0b\x0c\r", "    "))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, drop: array of line keys) for each host with boilerplate lines; null is a host of its own."""
    rows = docs.select(host.alias("host"), F.array_distinct(F.transform(F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != ""), lambda x: F.xxhash64(x))).alias("keys"))
    pages = rows.groupBy("host").agg(F.count("*").alias("pages"))
    counts = rows.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    often = stage(counts, "line-counts").alias("c").join(stage(pages, "pages").alias("p"), F.col("c.host").eqNullSafe(F.col("p.host"))).where(F.col("n") > F.col("pages") * ratio)
    return stage(often.groupBy("c.host").agg(F.collect_list("key").alias("drop")).select(F.col("host"), "drop"), "boilerplate")


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, and n_lines and n_dropped (bigint).

    A line is what stands between line feeds, compared without outer blanks; a
    line without a word is never counted or dropped. A page counts once for a
    line however often it has it. Null text stays null with no lines; a text of
    which all lines go is empty. A null host is a host. Ties at exactly the
    ratio are kept. No row is dropped. All columns are kept; n_lines and n_dropped
    replace columns of these names. An empty table gives no rows.
    """
    host, drop, rest = fresh(docs, "_host", "_drop", "_kept")
    found = boilerplate(docs, F.col(host_col), F.col(text_col), ratio, least_pages)
    found = found.select(F.col("host").alias(host), F.col("drop").alias(drop))
    both = docs.join(found, F.col(host_col).eqNullSafe(F.col(host)), "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(drop), line_key(x))))
    both = both.withColumn(rest, kept)
    count = lambda x: F.when(F.col(text_col).isNull(), 0).otherwise(F.size(x)).cast("bigint")
    own = [F.array_join(rest, "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return both.select(*own, count(lines).alias("n_lines"), (count(lines) - count(F.col(rest))).alias("n_dropped"))


ORACLE = r"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ') AS t FROM l),
n AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT k.source, k.t FROM k JOIN n ON k.source IS NOT DISTINCT FROM n.source WHERE k.t <> ''
      GROUP BY k.source, k.t, n.pages HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) > n.pages * 0.05::DOUBLE),
m AS (SELECT k.doc_id, k.i, k.line, b.t IS NOT NULL AS gone FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.t = b.t)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped
FROM m GROUP BY doc_id
"""
