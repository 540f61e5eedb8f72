"""Extraction as runnable queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.queries import query
from .extract import extract
from .testbed import view


#: Start tags outside comments, scripts and styles, as regular expressions see them.
HTML_REFERENCES = r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?</(?:script|style)\s*>', '\1', 'g') AS t FROM pages),
tags AS (SELECT page_id, unnest(regexp_extract_all(t, '<[A-Za-z][^<>]*>')) AS tag FROM h),
attrs AS (SELECT lower(regexp_extract(tag, '^<([A-Za-z][A-Za-z0-9]*)', 1)) AS name, unnest(regexp_extract_all(tag, '\s[A-Za-z][\w-]*="[^"]*"')) AS a FROM tags),
kv AS (SELECT name, lower(regexp_extract(a, '^\s([\w-]+)=', 1)) AS k, regexp_extract(a, '="([^"]*)"$', 1) AS v FROM attrs),
refs AS (SELECT 'styles' AS kind, '.' || unnest(list_filter(string_split_regex(v, '\s+'), lambda x: x <> '')) AS name FROM kv WHERE k = 'class'
UNION ALL SELECT 'styles', '#' || v FROM kv WHERE k = 'id' AND v <> '' UNION ALL SELECT 'imports', v FROM kv WHERE (name, k) IN (('script', 'src'), ('link', 'href'), ('img', 'src')) AND v <> '')
SELECT kind, name, count(*) AS n FROM refs GROUP BY kind, name"""


@query(HTML_REFERENCES)
def html_references(spark, sf_dir):
    """References of all web pages to styles and assets, counted by kind and name."""
    pages = view(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html")).alias("file_path"), F.col("html").alias("content"))
    return extract(pages).where("row = 'reference'").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
