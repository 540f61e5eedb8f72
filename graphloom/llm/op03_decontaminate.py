"""Benchmark decontamination: BM25 over the benchmark's items with block-max WAND, then overlap checks.

The inverted index is of the benchmark, which is bounded per block (BLOCK_BYTES of item text); a larger benchmark is
searched block by block, each block against all documents. Every training text is a query, as a whole, for its overlap with an item is
judged on the whole. An item's threshold is the least score that a text with enough of the item's shingles can have, so retrieval
loses nothing wherever in a text the parts of an item stand. Block-max bounds discard the texts and the item blocks that cannot
reach a threshold; what remains is scored in full. An item above its threshold counts as a leak if the text has enough of the shingles of
its question and of its answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import blocks, ship
from .textops import WORD_BYTES, flat, span_hashes, spans, windows

K1, B = 1.2, 0.75
#: Share of the five-word shingles of question and of answer that a document must have.
OVERLAP = 0.8
SHINGLE = 5
#: Items of one block of the index, for block-max bounds.
ITEMS = 16
#: Share of an item's threshold that its non-essential terms may give.
LIGHT = 0.6
#: Text of one broadcast part of the benchmark.
PART_BYTES = 16 << 20

SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    column = pc.utf8_lower(pc.fill_null(pa.array(texts, pa.string()), ""))
    buf, at = flat(column)
    starts, ends, doc = spans(buf, at, WORD_BYTES)
    return span_hashes(buf, starts, ends), doc


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer, what stands before is its question; one sentence is both."""
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    return np.unique(windows(words, np.zeros(len(words), np.int64), size)[0])


def most_lost(impacts: np.ndarray, size: int, overlap: float, repeats: bool) -> float:
    """The most that words of a part can weigh which a text lacks that has ``overlap`` of the part's distinct shingles of ``size`` words.

    ``impacts`` are of the part's words in order. Each missing shingle can take one word from an end of the part, or one from its middle
    once size - 1 more are missing there. If shingles repeat, missing ones may take words at several places: then the heaviest words count,
    one for each missing shingle and size - 1 more.
    """
    n = len(impacts) - size + 1
    missing = n - int(np.ceil(overlap * n - 1e-9))
    if missing <= 0:
        return 0.0
    heaviest = np.concatenate([[0.0], np.cumsum(np.sort(impacts)[::-1])])
    top = lambda k: float(heaviest[min(max(k, 0), len(impacts))])
    if repeats:
        return top(missing + size - 1)
    head, tail = (np.concatenate([[0.0], np.cumsum(x)]) for x in (impacts, impacts[::-1]))
    return max(float(head[i] + tail[j]) + top(missing - i - j - (size - 1)) for i in range(missing + 1) for j in range(missing + 1 - i))


def build_index(items: list[tuple[int, str]], overlap: float = OVERLAP) -> dict:
    """Postings with BM25 impacts, block maxima, thresholds and the shingles that verify, of items with a word."""
    hashes, doc = _hash_words([t for _, t in items])
    lengths = np.bincount(doc, minlength=len(items))
    terms, term = np.unique(hashes, return_inverse=True)
    pair, tf = np.unique(term * len(items) + doc, return_counts=True)
    p_term, p_item = pair // max(1, len(items)), pair % max(1, len(items))
    df = np.bincount(p_term, minlength=len(terms))
    n = max(1, int((lengths > 0).sum()))
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    average = lengths.sum() / n if len(terms) else 1.0
    impact = idf[p_term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[p_item] / average)) if len(terms) else np.zeros(0)
    own = np.bincount(p_item, impact, minlength=len(items))
    checks, threshold = [], np.full(len(items), np.inf)
    for i, (_, text) in enumerate(items):
        both, lost = [], 0.0
        parts = question_and_answer(text or "")
        for k, part in enumerate(parts):
            words, _ = _hash_words([part])
            size = min(SHINGLE, len(words))
            shingles = _shingles(words, size) if size else np.zeros(0, np.uint64)
            both.append((size, shingles))
            if size and (k == 0 or part != parts[0]):
                weight = impact[np.searchsorted(pair, np.searchsorted(terms, words) * len(items) + i)]
                lost += most_lost(weight, size, overlap, len(shingles) < len(words) - size + 1)
        checks.append(both)
        if all(size for size, _ in both):
            # A little less, for sums in another order; at least some word must be there.
            threshold[i] = max(own[i] - lost, 1e-3 * own[i]) * (1 - 1e-9)
    # Non-essential postings: the least impacts of an item that together stay below LIGHT of its threshold. A text
    # must reach the rest of the threshold, ``need``, with essential postings alone.
    order = np.lexsort((impact, p_item))
    below = np.cumsum(impact[order])
    start = np.concatenate([[0.0], below])[np.searchsorted(p_item[order], np.arange(len(items)))] if len(terms) else np.zeros(len(items))
    essential = np.ones(len(p_item), bool)
    essential[order] = below - start[p_item[order]] > LIGHT * threshold[p_item[order]]
    item_need = threshold - np.bincount(p_item[~essential], impact[~essential], minlength=len(items))
    # Blocks hold items of like needs.
    rank = np.empty(len(items), np.int64)
    rank[np.argsort(item_need, kind="stable")] = np.arange(len(items))
    block_of = rank // ITEMS
    n_blocks = -(-len(items) // ITEMS)
    block_pair, where = np.unique(p_term[essential] * n_blocks + block_of[p_item[essential]], return_inverse=True)
    block_max = np.zeros(len(block_pair))
    np.maximum.at(block_max, where, impact[essential])
    need = np.full(n_blocks, np.inf)
    np.minimum.at(need, block_of, item_need)
    best = np.zeros(len(terms))
    np.maximum.at(best, p_term[essential], impact[essential])
    sieve = np.zeros(1 << 20, bool)
    sieve[(terms >> np.uint64(44)).astype(np.int64)] = True
    at = lambda keys: np.searchsorted(keys, np.arange(len(terms) + 1))
    return {
        "ids": np.array([i for i, _ in items], np.int64), "terms": terms, "sieve": sieve, "block_of": block_of, "best": best, "threshold": threshold, "need": need, "checks": checks,
        "items_at": at(p_term), "items": p_item, "impact": impact, "blocks_at": at(block_pair // max(1, n_blocks)), "blocks": block_pair % max(1, n_blocks), "block_max": block_max,
    }


def _expand(at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at[t] to at[t + 1] for each t of ``of``, and which entry of ``of`` each belongs to."""
    size = at[of + 1] - at[of]
    owner = np.repeat(np.arange(len(of)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[of], size), owner


def retrieve(words: np.ndarray, doc: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, score) of the items whose threshold a document reaches.

    ``words`` are the word hashes of several documents one after another, ``doc`` their documents.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    terms = index["terms"]
    if not len(terms) or not len(words):
        return none
    hit = np.flatnonzero(index["sieve"][(words >> np.uint64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(terms, words[hit]), len(terms) - 1)
    same = terms[place] == words[hit]
    pairs = np.unique(doc[hit[same]] * len(terms) + place[same])
    owner, term = pairs // len(terms), pairs % len(terms)
    # WAND: the sum of the best essential impact of each term must reach the lowest need.
    score = np.bincount(owner, index["best"][term], minlength=int(doc[-1]) + 1)
    ok = score[owner] >= index["need"].min()
    owner, term = owner[ok], term[ok]
    if not len(owner):
        return none
    # Block-max: sums of the terms' maxima within each block of items.
    n_blocks = len(index["need"])
    live, owner = np.unique(owner, return_inverse=True)
    post, of = _expand(index["blocks_at"], term)
    cell = owner[of] * n_blocks + index["blocks"][post]
    cells, back = np.unique(cell, return_inverse=True)  # only cells with a posting
    open_cell = cells[np.bincount(back, index["block_max"][post], minlength=len(cells)) >= index["need"][cells % n_blocks]]
    if not len(open_cell):
        return none
    # Full scores of the items of open blocks.
    post, of = _expand(index["items_at"], term)
    item = index["items"][post]
    cell = owner[of] * n_blocks + index["block_of"][item]
    ok = open_cell[np.minimum(np.searchsorted(open_cell, cell), len(open_cell) - 1)] == cell
    cell, back = np.unique(owner[of][ok] * len(index["ids"]) + item[ok], return_inverse=True)
    score = np.bincount(back, index["impact"][post][ok], minlength=len(cell))
    owner, item = cell // len(index["ids"]), cell % len(index["ids"])
    ok = score >= index["threshold"][item]
    return live[owner[ok]], item[ok], score[ok]


def overlaps(words: np.ndarray, check: list, made: dict) -> list[float]:
    """Shares of an item's question and answer shingles that a document's ``words`` have."""
    out = []
    for size, wanted in check:
        if not size:
            out.append(0.0)
            continue
        if size not in made:
            made[size] = _shingles(words, size)
        out.append(float(np.isin(wanted, made[size], assume_unique=True).mean()))
    return out


def find_leaks(block: pa.RecordBatch, index: dict, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(row, item number, score, question overlap, answer overlap) of the leaks in a block of texts."""
    buf, at = flat(pc.utf8_lower(pc.fill_null(block.column("text"), "")))
    starts, ends, doc = spans(buf, at, WORD_BYTES)
    words = span_hashes(buf, starts, ends)
    rows, made, last = [], {}, -1
    for d, i, score in zip(*retrieve(words, doc, index), strict=True):
        if d != last:
            made, last = {}, d
            own = words[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
        q, a = overlaps(own, index["checks"][i], made)
        if q >= overlap and a >= overlap:
            rows.append((int(d), int(i), float(score), q, a))
    return rows


def indexes(benchmark: DataFrame, part_bytes: int = PART_BYTES, overlap: float = OVERLAP):
    """Broadcast indexes of the parts of ``benchmark``; each holds about ``part_bytes`` of text, so its size is bounded."""
    spark = benchmark.sparkSession
    items = benchmark.selectExpr("cast(item_id as long) item_id", "text", "octet_length(text) size").where("text is not null")
    total = items.agg(F.sum("size")).first()[0] or 0
    n_parts = max(1, -(-int(total) // part_bytes))
    for part in range(n_parts):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_parts)) == part).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(build_index([(r["item_id"], r["text"]) for r in own], overlap))


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of SCHEMA: each document of ``docs`` (doc_id, text) with each item of ``benchmark`` (item_id, text) it leaks.

    Words are lower-cased runs of letters, digits, underscore and characters beyond ASCII. A question or answer
    of fewer than five words is one shingle of all of them. Null and empty texts and items without words leak nothing;
    repeated items are found each, repeated documents each; an empty table on either side gives no rows; other
    columns are ignored. A text is searched whole. No shuffle of documents.
    """
    ship(docs.sparkSession)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("text is not null")
    found = None
    for shared in indexes(benchmark, part_bytes, overlap):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for block in blocks(batches):
                rows = find_leaks(block, index, overlap)
                row, item, *rest = list(zip(*rows, strict=True)) or [()] * 5
                columns = [block.column("doc_id").take(pa.array(row, pa.int64())), pa.array([int(index["ids"][i]) for i in item], pa.int64()), *(pa.array(c, pa.float64()) for c in rest)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        rows = texts.mapInArrow(run, SCHEMA)
        found = rows if found is None else found.union(rows)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns; as in :func:`leaks`, null texts stay. No shuffle."""
    ship(docs.sparkSession)
    for shared in indexes(benchmark, part_bytes, overlap):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for block in blocks(batches):
                keep = np.ones(block.num_rows, bool)
                keep[[r[0] for r in find_leaks(block, index, overlap)]] = False
                yield block.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of each contaminated document: a row per document and item."""
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "question_overlap", "answer_overlap")
