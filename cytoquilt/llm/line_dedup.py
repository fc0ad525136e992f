"""Line dedup by site-relative frequency (operator 2), with built-in functions only.

Pages are grouped by host. A line's share is the number of the host's pages that
contain it, divided by the number of the host's pages; a line above the ratio is
boilerplate of that host and goes from all its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquilt.llm.common import fresh, quoted, row_key
from cytoquilt.session import materialize


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def counted(line: Column, min_chars: int) -> Column:
    """Whether a line can be boilerplate at all; a blank line says nothing about a site."""
    return F.length(F.trim(line)) >= min_chars


def line_key(line: Column) -> Column:
    """128 bits of the trimmed line."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(29), bare).alias("b"))


def page_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(page key, host, line key): each line of a page once. ``rows`` has _page, _host and _text."""
    lines = F.array_distinct(F.filter(F.transform(lines_of(F.col("_text")), lambda x: F.trim(x)), lambda x: counted(x, min_chars)))
    each = rows.select("_page", "_host", F.explode(lines).alias("_line"))
    return each.select("_page", "_host", line_key(F.col("_line")).alias("_key"))


def boilerplate(rows: DataFrame, ratio: float, min_pages: int, min_chars: int) -> DataFrame:
    """(_host, _key) of every line above the ratio. Counts and totals take in all pages, summed before they are shuffled."""
    pages = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    seen = page_lines(rows, min_chars).groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("_n"))
    seen = seen.where(F.col("_n") >= min_pages)
    return seen.join(pages, "_host").where(F.col("_n") > F.col("_pages") * F.lit(ratio)).select("_host", "_key")


def drop_boilerplate(
    df: DataFrame, id_col: str, host_col: str, text_col: str, ratio: float = 0.01, min_pages: int = 3, min_chars: int = 1,
    article: int = 500,
) -> DataFrame:
    """``df`` with boilerplate lines taken out of ``text_col``; every row and column stays.

    A line is compared without outer spaces; one with under ``min_chars`` characters,
    by default only a blank one, never counts. It goes where more than ``ratio`` of
    the host's pages, and at least ``min_pages`` of them, contain it. A page of
    boilerplate alone, such as one to sign in, loses all its lines; with ``article``
    characters and more it is an article that was copied often, rather than the
    frame around one, and stays whole. A null host counts as the empty host; a null text stays null; repeated rows are
    pages of their own and come out alike; an empty table comes out empty.
    """
    a, b, gone = fresh(df, "_a", "_b", "_gone")
    own = [quoted(c) for c in df.columns]
    host, text = F.coalesce(quoted(host_col).cast("string"), F.lit("")), quoted(text_col)
    page = row_key(quoted(id_col), host, text)
    rows = df.select(page.alias("_page"), host.alias("_host"), text.alias("_text"))
    found = materialize(boilerplate(rows, ratio, min_pages, min_chars))
    # one row per page key, whether or not the page comes twice; at most a page's own lines in it
    hits = page_lines(rows, min_chars).join(found, ["_host", "_key"]).groupBy("_page").agg(F.collect_set("_key").alias(gone))
    hits = hits.select(F.col("_page.a").alias(a), F.col("_page.b").alias(b), gone)
    joined = df.select(*own, page["a"].alias(a), page["b"].alias(b)).join(hits, [a, b], "left")
    stays = F.filter(lines_of(text), lambda x: ~(counted(x, min_chars) & F.array_contains(quoted(gone), line_key(x))))
    # worked out once for the test and the result
    left = joined.withColumn(b, F.when(quoted(gone).isNotNull(), F.array_join(stays, "\n")))
    article_copy = (F.length(F.trim(F.regexp_replace(quoted(b), r"\s+", " "))) == 0) & (F.length(text) >= article)
    kept = F.when(quoted(b).isNotNull() & ~article_copy, quoted(b)).otherwise(text)
    return left.select(*[(kept.alias(text_col) if c == text_col else quoted(c)) for c in df.columns])


def oracle(table: str = "documents", host: str = "source", ratio: float = 0.01, min_pages: int = 3, min_chars: int = 1, article: int = 500) -> str:
    """The same rows in DuckDB's SQL, for the columns of ``documents``."""
    return f"""
WITH pages AS (SELECT *, coalesce({host}, '') AS h, row_number() OVER () AS rn FROM {table}),
lines AS (SELECT rn, h, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM pages),
seen AS (SELECT h, trim(line, ' ') AS l, count(DISTINCT rn) AS n FROM lines WHERE length(trim(line, ' ')) >= {min_chars} GROUP BY ALL),
totals AS (SELECT h, count(*) AS t FROM pages GROUP BY h),
bad AS (SELECT h, l FROM seen JOIN totals USING (h) WHERE n >= {min_pages} AND n > t * {ratio}::DOUBLE),
kept AS (SELECT rn, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone) AS text, bool_or(NOT gone AND trim(regexp_replace(line, '\\s+', ' ', 'g')) <> '') AS anyleft, bool_or(gone) AS anygone
  FROM (SELECT lines.*, bad.l IS NOT NULL AS gone FROM lines LEFT JOIN bad ON bad.h = lines.h AND bad.l = trim(line, ' ')) GROUP BY rn)
SELECT doc_id, CASE WHEN anyleft THEN kept.text WHEN anygone AND length(pages.text) < {article} THEN coalesce(kept.text, '') ELSE pages.text END AS text, lang, source, n_chars FROM pages LEFT JOIN kept USING (rn)
"""
