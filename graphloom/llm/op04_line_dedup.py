"""Recurring lines across documents, by a log-template tree in DataFrame functions alone.

A line is parsed at fixed depth: the tree branches by its number of tokens, then by its DEPTH leading tokens; tokens with
a digit are variable fields. A leaf keeps the rest of the template. Lines of MIN_SHORT tokens or more also belong to
templates in which one third of the rest is free, so that fields without digits (names, places) are generalised as well.
A template that recurs in MIN_DOCS documents or more, with not all of them equal texts, is dropped from every document
but the one of smallest doc_id.

Keys are 64-bit hashes. Of 10 ** 12 distinct keys with 10 ** 9 recurring ones among them, some 50 that recur nowhere are expected
to share the hash of one that does, and go with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import drop_written, ship, spare_names, written

MIN_DOCS = 5
DEPTH = 2
#: Fewer tokens that are no variable fields make no template with a free third.
MIN_CONSTANT = 2
#: From so many tokens on, a template may leave a third of its rest free.
MIN_FREE = 12
#: From so many tokens on each third has a token; a shorter line frees one if MIN_CONSTANT constant tokens stand outside it.
MIN_SHORT = DEPTH + 3

BLANKS = " \t\x0b\f\r"
FIELD = "<*>"
_NON_FIELD = f"[^{BLANKS}0-9]"
#: Letters of scripts that set no blanks between words: a line in them may be one token, and a digit would make all of it a field.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def template_keys(line: Column) -> Column:
    """The 64-bit keys of the templates of a line: its own, and those with a free third. Empty if it makes none.

    A line with a constant token has a key of its own; a line of fields alone has one only in a script without blanks,
    where only the digits are fields. A blank line has none.
    """
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, f"(?<![^{BLANKS}]){_NON_FIELD}*+[0-9][^{BLANKS}]*", FIELD)).otherwise(line)
    tokens = F.split(F.btrim(masked, F.lit(BLANKS)), f"[{BLANKS}]+")
    none = F.array().cast("array<long>")

    def keys(t: Column) -> Column:
        n = F.size(t)
        rest = n - DEPTH
        a, b = F.floor(rest / 3).cast("int"), F.floor(2 * rest / 3).cast("int")
        lead = F.xxhash64(n, F.slice(t, 1, DEPTH))
        thirds = [F.slice(t, DEPTH + 1, a), F.slice(t, a + (DEPTH + 1), b - a), F.slice(t, b + (DEPTH + 1), rest - b)]
        own = F.xxhash64(n, t)
        free = [F.xxhash64(F.lit(k), lead, *(x for j, x in enumerate(thirds) if j != k)) for k in range(3)]
        constant = F.size(F.array_remove(t, FIELD))
        long = F.when((n >= MIN_FREE) & (constant >= MIN_CONSTANT), F.array(own, *free))
        outside = [constant - F.size(F.array_remove(x, FIELD)) for x in thirds]
        some = F.array(own, *(F.when(c >= MIN_CONSTANT, x).otherwise(own) for c, x in zip(outside, free, strict=True)))
        unspaced = F.when(line.rlike(UNSPACED), F.array(F.xxhash64(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), "[0-9]+", FIELD)))).otherwise(none)
        blank = (n == 1) & (F.get(t, F.lit(0)) == "")
        return long.when(blank, none).when(constant == 0, unspaced).when((n >= MIN_SHORT) & (n < MIN_FREE), some).otherwise(F.array(own))

    # A one-element array binds the tokens once for all that reads them.
    return F.flatten(F.transform(F.array(tokens), keys))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` without the lines of recurring templates, and with n_lines and n_dropped as (last) columns.

    Lines are what stands between line ends; blank lines and lines without a template stay.
    Every row stays, if need be with an empty text. A row without doc_id, or with one that is no number, counts as a document but loses no line. A null text stays null and has no lines; an empty one has one.
    Rows that repeat a doc_id count as documents each and lose the same lines. An empty table gives no rows. Other
    columns pass through; columns named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    lines = F.split(F.col("text"), "\n", -1)
    all_keys = F.array_distinct(F.flatten(F.transform(lines, template_keys)))
    keyed = written(docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), all_keys.alias("keys")))
    exploded = keyed.select("doc_id", "body", F.explode("keys").alias("key"))
    recurring = written(
        exploded.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper"), F.min("body").alias("low"), F.max("body").alias("high"))
        .where((F.col("n") >= min_docs) & (F.col("low") != F.col("high")))
        .select("key", "keeper")
    )
    lost = written(exploded.select("doc_id", "key").join(recurring, "key").where("doc_id <> keeper").select("doc_id", "key"))
    drop_written(keyed)
    drop_written(recurring)
    lost_keys, own_id, rest = spare_names(docs, "__lost", "__id", "__kept")
    per_doc = lost.groupBy("doc_id").agg(F.collect_set("key").alias(lost_keys)).withColumnRenamed("doc_id", own_id)
    joined = docs.join(per_doc, docs["doc_id"].cast("long") == F.col(own_id), "left")
    kept = F.filter(lines, lambda x: ~F.arrays_overlap(template_keys(x), F.col(lost_keys)))
    out = joined.withColumn(rest, F.when(F.col(lost_keys).isNull(), lines).otherwise(kept))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_kept = F.when(F.col("text").isNull(), 0).otherwise(F.size(rest)).cast("long")
    out = out.withColumn("n_lines", n_lines).withColumn("n_dropped", n_lines - n_kept)
    text = F.when(F.col(lost_keys).isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return out.withColumn("text", text).drop(rest, lost_keys, own_id)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


SQL_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
_BLANK = r"[ \t\x0b\f\r]"
#: The same in SQL, on the templates themselves instead of their hashes. LINES and LOST can go before other statements.
SQL_LINES = rf"""
line_rows AS (
  SELECT doc_id, text AS body, line, pos,
         list_transform(string_split_regex(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '{_BLANK}+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)
),
line_thirds AS (
  SELECT *, len(t) AS n, len(t) - {DEPTH} AS rest, t[{DEPTH + 1} : {DEPTH} + (len(t) - {DEPTH}) // 3] AS t0,
         t[{DEPTH + 1} + (len(t) - {DEPTH}) // 3 : {DEPTH} + 2 * (len(t) - {DEPTH}) // 3] AS t1, t[{DEPTH + 1} + 2 * (len(t) - {DEPTH}) // 3 :] AS t2,
         array_to_string(t, ' ') AS own, len(list_filter(t, lambda x: x <> '<*>')) AS constant
  FROM line_rows
),
line_free AS (
  SELECT *, concat_ws(chr(10), '0', n, t[1], t[2], array_to_string(t1, ' '), array_to_string(t2, ' ')) AS f0,
         concat_ws(chr(10), '1', n, t[1], t[2], array_to_string(t0, ' '), array_to_string(t2, ' ')) AS f1,
         concat_ws(chr(10), '2', n, t[1], t[2], array_to_string(t0, ' '), array_to_string(t1, ' ')) AS f2
  FROM line_thirds
),
line_keys AS (
  SELECT doc_id, body, pos, unnest(CASE
      WHEN n >= {MIN_FREE} AND constant >= {MIN_CONSTANT} THEN [own, f0, f1, f2]
      WHEN n = 1 AND own = '' THEN []
      WHEN constant = 0 AND regexp_matches(line, '{SQL_UNSPACED}') THEN ['u' || chr(10) || regexp_replace(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[0-9]+', '<*>', 'g')]
      WHEN constant = 0 THEN []
      WHEN n >= {MIN_SHORT} AND n < {MIN_FREE} THEN [own,
            CASE WHEN constant - len(list_filter(t0, lambda x: x <> '<*>')) >= {MIN_CONSTANT} THEN f0 ELSE own END,
            CASE WHEN constant - len(list_filter(t1, lambda x: x <> '<*>')) >= {MIN_CONSTANT} THEN f1 ELSE own END,
            CASE WHEN constant - len(list_filter(t2, lambda x: x <> '<*>')) >= {MIN_CONSTANT} THEN f2 ELSE own END]
      ELSE [own]
    END) AS key
  FROM line_free
),
recurring AS (
  SELECT key, min(doc_id) AS keeper FROM (SELECT DISTINCT doc_id, md5(body) AS body, key FROM line_keys)
  GROUP BY key HAVING count(*) >= {MIN_DOCS} AND min(body) <> max(body)
),
lost AS (SELECT DISTINCT doc_id, pos FROM line_keys JOIN recurring USING (key) WHERE doc_id <> keeper)
"""
ORACLE_SQL = f"""WITH {SQL_LINES}
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(s.kept, '')) END AS kept_md5
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(*) AS n_lines, count(lost.pos) AS n_dropped, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (lost.pos IS NULL) AS kept
  FROM line_rows l LEFT JOIN lost ON l.doc_id = lost.doc_id AND l.pos = lost.pos GROUP BY l.doc_id
) s ON d.doc_id = s.doc_id
"""
