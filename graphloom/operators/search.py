"""Name, lexical, vector and hybrid search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, paths, scores
from .lineage import cut

#: Field weights, BM25 constants, and channel weights by kind of query.
FIELD_WEIGHTS = {"symbol": 10.0, "fqn": 6.0, "file_path": 3.0, "docstring": 2.0, "signature": 1.0}
K1, B = 1.2, 0.75
CHANNELS = {"identifier": (0.5, 1.5), "natural_language": (1.5, 0.5), "mixed": (1.0, 1.0)}
RRF = 60


def search_names(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Nodes by tiers: 0 all tokens in the symbol or all in the full name, 1 all in the docstring, 2 the raw text as a substring; then exact, prefix, short and named first."""
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("symbol", "fqn", "docstring")}
    raw = query.strip().lower()
    tokens = names.camel_tokens(query)
    has = {field: F.lit(bool(tokens)) for field in low}
    for t in tokens:
        has = {field: has[field] & low[field].contains(t) for field in low}
    whole = low["symbol"].contains(raw) | low["fqn"].contains(raw)
    tier = F.when(has["symbol"] | has["fqn"], 0).when(has["docstring"], 1).when(whole & F.lit(bool(raw)), 2)
    found = nodes.where("kind <> 'file'").withColumn("tier", tier).where("tier is not null")
    found = found.withColumn("exact", (low["symbol"] == raw).cast("int")).withColumn("prefix", low["symbol"].startswith(raw).cast("int"))
    return found.orderBy("tier", F.desc("exact"), F.desc("prefix"), F.length("symbol"), "symbol", "file_path", "start_line", "id").limit(limit)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def term_counts(words: Column, terms: list[str]) -> Column:
    """How many words begin with each (stemmed) term."""

    def count(term: str) -> Column:
        return F.size(F.filter(words, lambda w: w.startswith(term)))

    return F.array(*map(count, terms))


def bm25(docs: DataFrame, key: str, text: Column, query: str, limit: int = 50) -> DataFrame:
    """(key, score, covered): texts with any search term, by BM25 over words that begin with the terms.

    One pass counts the terms of every text; document frequencies and the mean length are one row of sums.
    """
    terms = names.lexical_terms(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("covered")).limit(0)
    counted = docs.select(key, words_of(text).alias("w")).select(key, term_counts(F.col("w"), terms).alias("tf"), F.size("w").alias("dl"))
    sums = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), *(F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(terms)))).first()
    score, covered = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        df = sums[f"df{i}"] or 0
        idf = F.ln(F.lit((sums["n"] - df + 0.5) / (df + 0.5) + 1))
        tf = F.col("tf")[i]
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(sums["mean"] or 1) or 1.0)))
        covered = covered + (tf > 0).cast("int")
    ranked = counted.select(key, scores.round_half_up(score, 6).alias("score"), covered.alias("covered")).where("covered > 0")
    return ranked.orderBy(F.desc("score"), key).limit(limit)


#: Behaviour comes before declarations, and those before data.
KIND_RANK = {"function": 0, "method": 0, "class": 0, "test": 0, "type": 1, "module": 1}
OTHER_KIND = 2
#: What a word that stands in most nodes counts.
LEAST_IDF = 1e-6


def lexical_search(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Nodes with a word that begins with a search term: by terms covered, product code before tests, kind, then BM25 over weighted fields.

    A term counts in a field as often as words begin with it, times the field's weight; document frequencies and the mean length
    (words of all fields, files among them) are one row of sums. An idf that would be negative is next to nothing. The order
    is of all nodes that match, not of the best by BM25 alone.
    """
    terms = names.lexical_terms(query)
    if not terms:
        return nodes.limit(0).select("*", F.lit(0.0).alias("weight"), F.lit(0).alias("covered"), F.lit(0).alias("kind_rank"), F.lit(0).alias("is_test"), F.lit(0.0).alias("score"))
    counted = nodes.select("*", *(words_of(F.col(f)).alias(f"w_{f}") for f in FIELD_WEIGHTS))
    per_term = lambda t: sum((weight * F.size(F.filter(F.col(f"w_{f}"), lambda w: w.startswith(t))) for f, weight in FIELD_WEIGHTS.items()), F.lit(0.0))
    length = sum((F.size(f"w_{f}") for f in FIELD_WEIGHTS), F.lit(0))
    counted = counted.select(*nodes.columns, length.alias("dl"), *(per_term(t).alias(f"tf{i}") for i, t in enumerate(terms)))
    sums = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms)))).first()
    weight, covered, any_term = F.lit(0.0), F.lit(0), F.lit(False)
    for i, t in enumerate(terms):
        df = sums[f"df{i}"] or 0
        idf = max(math.log((sums["n"] - df + 0.5) / (df + 0.5)), LEAST_IDF)
        tf = F.col(f"tf{i}")
        weight = weight + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(sums["mean"] or 1) or 1.0)))
        any_term = any_term | (tf > 0)
        hit = F.lit(False)
        for field in FIELD_WEIGHTS:
            hit = hit | F.lower(F.coalesce(F.col(field), F.lit(""))).contains(t)
        covered = covered + hit.cast("int")
    kind = F.lit(OTHER_KIND)
    for k, rank in KIND_RANK.items():
        kind = F.when(F.col("kind") == k, rank).otherwise(kind)
    test = paths.is_test_node(F.col("kind"), F.col("file_path"))
    found = counted.where((F.col("kind") != "file") & any_term).select(*nodes.columns, scores.round_half_up(weight, 6).alias("weight"), covered.alias("covered"), kind.alias("kind_rank"), test.cast("int").alias("is_test"))
    ordered = found.orderBy(F.desc("covered"), "is_test", "kind_rank", F.desc("weight"), "id").limit(limit)
    return ordered.withColumn("score", scores.round_half_up(F.col("covered") / len(terms), 6))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def vector_search(vectors: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """The nearest vectors (vec_id, embedding) by cosine, exactly; ties by id."""
    wanted = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select("vec_id", scores.round_half_up(cosine(F.col("embedding"), wanted), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(limit)


def fuse(vector_hits: DataFrame, lexical_hits: DataFrame, key: str, kind: str = "mixed", limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two ranked, already cut lists (key, score) with the weights of the query's kind."""
    ranked = []
    for hits, weight, name in zip((vector_hits, lexical_hits), CHANNELS[kind], ("v", "l"), strict=True):
        rank = F.row_number().over(W.orderBy(F.desc("score"), key))  # a cut list: one small partition
        ranked.append(hits.select(key, (F.lit(weight) / (RRF + rank)).alias(name)))
    both = ranked[0].join(ranked[1], key, "full").fillna(0.0, ["v", "l"])
    return both.select(key, scores.round_half_up(F.col("v") + F.col("l"), 8).alias("score")).orderBy(F.desc("score"), key).limit(limit)


#: Ways of finding a node.
MODES = ("name", "semantic", "lexical")


def cascade(nodes: DataFrame, query: str, limit: int = 10, semantic: DataFrame | None = None, lexical: DataFrame | None = None) -> DataFrame:
    """(id, mode, position), at most ``limit``: the nearest by vector (``semantic``: id, score) if there are any; else the name hits,
    topped up with lexical hits, each node once, with the mode that found it.

    ``lexical`` gives the rows of :func:`lexical_search` where they come from a kept index.
    """
    if semantic is not None:
        near = semantic.join(nodes.where("kind <> 'file'").select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(limit)
        near = cut(near.select("id", F.lit("semantic").alias("mode"), F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("position")))
        if not near.isEmpty():
            return near
    lexical = lexical_search(nodes, query, limit) if lexical is None else lexical
    stages = {
        "name": search_names(nodes, query, limit).select("id", F.row_number().over(W.orderBy("tier", F.desc("exact"), F.desc("prefix"), F.length("symbol"), "symbol", "file_path", "start_line", "id")).alias("rn")),
        "lexical": lexical.select("id", F.row_number().over(W.orderBy(F.desc("covered"), "is_test", "kind_rank", F.desc("weight"), "id")).alias("rn")),
    }
    found = None
    for mode, hits in stages.items():
        rows = hits.withColumn("mode", F.lit(MODES.index(mode)))
        found = rows if found is None else found.unionByName(rows)
    best = found.groupBy("id").agg(F.min(F.struct("mode", "rn")).alias("b"))
    return best.select("id", F.element_at(F.array(*map(F.lit, MODES)), F.col("b.mode") + 1).alias("mode"), F.row_number().over(W.orderBy("b")).alias("position")).where(F.col("position") <= limit)


def embedding_text(nodes: DataFrame, cap: int = 0) -> DataFrame:
    """Text to embed: docstring, signature, name and, where nodes have a column ``source``, the source body; each text with its digest.

    A ``cap`` above 0 cuts it at so many whole characters; nothing is cut by itself.
    """
    body = [F.when(F.col("source") != "", F.col("source"))] if "source" in nodes.columns else []
    text = F.concat_ws("\n", F.when(F.col("docstring") != "", F.col("docstring")), "signature", "fqn", *body)
    text = F.left(text, F.lit(cap)) if cap > 0 else text
    return nodes.where("kind <> 'file'").select("id", text.alias("text"), F.sha2(text, 256).alias("digest"))


def embed(texts: DataFrame, function: Callable[[list[str]], list[list[float]]], batch_rows: int = 256) -> DataFrame:
    """(id, embedding) of texts (id, text, digest): ``function`` sees each distinct text once, in batches of ``batch_rows``.

    The function is shipped with the plan; a client it needs should be made within it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                part = batch.iloc[start : start + batch_rows]
                yield pd.DataFrame({"digest": part["digest"], "embedding": function(part["text"].tolist())})

    once = texts.groupBy("digest").agg(F.min("text").alias("text"))
    return texts.select("id", "digest").join(once.mapInPandas(run, "digest string, embedding array<float>"), "digest").select("id", "embedding")


def grep(texts: DataFrame, key: str, text: str, pattern: str, limit: int = 100, ignore_case: bool = False) -> DataFrame:
    """(key, line_number, line): lines that match a regular expression, the first ``limit`` by key and line."""
    # The cheap test of the whole text keeps those without a match from being split.
    rule = ("(?i)" if ignore_case else "") + pattern
    hits = texts.where(F.col(text).rlike("(?m)" + rule)).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.col("line").rlike(rule))
    return hits.select(key, (F.col("pos") + 1).cast("long").alias("line_number"), "line").orderBy(key, "line_number").limit(limit)
