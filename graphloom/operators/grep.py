"""Lines that match a pattern, each with the symbol it stands in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Graph
from .lineage import cut
from .relations import enclosing

#: Bounds of a pattern, of hits, of a shown line in characters, of a file and of a line in bytes.
MOST_PATTERN, TOP, MOST_TOP, SHOWN, MOST_FILE, MOST_LINE = 512, 100, 1000, 300, 4 << 20, 1 << 20
#: Bytes at the head of a file in which a NUL makes it a binary one.
HEAD = 512


def searchable(content: Column) -> Column:
    """Not too large, and no NUL at the head."""
    return (F.octet_length(content) <= MOST_FILE) & ~F.coalesce(F.contains(F.decode(F.substring(content.cast("binary"), 1, HEAD), "ISO-8859-1"), F.lit("\0")), F.lit(False))


def _lines(content: Column) -> Column:
    """Lines without their ends, up to the first one that is too long; what follows the last line end is a line if it is not empty."""
    lines = F.split(F.regexp_replace(content, r"\n\z", ""), "\n", -1)
    lines = F.when(content == "", F.array().cast("array<string>")).otherwise(F.transform(lines, lambda x: F.regexp_replace(x, r"\r\z", "")))
    long = F.array_position(F.transform(lines, lambda x: F.octet_length(x) > MOST_LINE), True)
    return F.when(long > 0, F.slice(lines, F.lit(1), (long - 1).cast("int"))).otherwise(lines)


def _matches(text: Column, pattern: str, regex: bool, ignore_case: bool) -> Column:
    if regex:
        return text.rlike(("(?i)" if ignore_case else "") + pattern)
    return F.contains(F.lower(text), F.lit(pattern.lower())) if ignore_case else F.contains(text, F.lit(pattern))


def grep(graph: Graph, files: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """Hits (file_path, line, matched_line, symbol, fqn, kind, resolution) of ``files`` (file_path, content), and one row about the search.

    Of all hits, by file and line, the first ``top`` are given, MOST_TOP at most, each with the innermost symbol around its line: 'exact' where
    that starts there, else 'enclosing', or 'none'. A line is shown up to SHOWN characters. Binary and very large files are skipped. The
    row says how many files were scanned and skipped, how many lines match in all, and whether that is more than are given.
    """
    if not pattern or len(pattern.encode()) > MOST_PATTERN:
        raise ValueError(f"a pattern has 1 to {MOST_PATTERN} bytes")
    top = min(top if top > 0 else TOP, MOST_TOP)
    content = F.coalesce("content", F.lit(""))
    fit = files.select("file_path", content.alias("content")).withColumn("fit", searchable(content))
    # A test of the whole text keeps most files from being cut into lines; a pattern with an anchor is left to the lines.
    some = fit.where("fit") if regex else fit.where("fit").where(_matches(F.col("content"), pattern, False, ignore_case))
    lines = some.select("file_path", F.posexplode(_lines(F.col("content"))).alias("pos", "text")).where(_matches(F.col("text"), pattern, regex, ignore_case))
    shown = F.when(F.char_length("text") > SHOWN, F.concat(F.left("text", F.lit(SHOWN)), F.lit("…"))).otherwise(F.col("text"))
    hits = cut(lines.select("file_path", (F.col("pos") + 1).cast("int").alias("line"), shown.alias("matched_line")))
    total = hits.count()
    first = cut(hits.orderBy("file_path", "line").limit(top))
    around = enclosing(graph, first.select("file_path", "line"))
    out = first.join(around, ["file_path", "line"], "left")
    resolution = F.when(F.col("id").isNull(), "none").when(F.col("start_line") == F.col("line"), "exact").otherwise("enclosing")
    counts = fit.agg(F.coalesce(F.sum(F.col("fit").cast("long")), F.lit(0)).alias("files_scanned"), F.coalesce(F.sum((~F.col("fit")).cast("long")), F.lit(0)).alias("files_skipped"))
    report = counts.withColumn("total", F.lit(total).cast("long")).withColumn("truncated", F.lit(total > top))
    return out.select("file_path", "line", "matched_line", "symbol", "fqn", "kind", resolution.alias("resolution")), report
