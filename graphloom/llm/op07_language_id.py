"""Language identification of mixed-language text.

Training counts hashed letter trigrams per language over all training rows (a table of BUCKETS per language).
Prediction gives each word a log-likelihood per language, after the word's script has narrowed the candidates
to languages that use it, and a Viterbi pass with a penalty per switch labels spans. The document's language
is the one with most letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import blocks, ship

BUCKETS = 1 << 15
SMOOTHING = 0.5
SWITCH_PENALTY = 14.0
#: Score of a word for a language that does not use its script: no candidate, whatever switches cost.
NO_CANDIDATE = -1e6
#: A language uses a script that has at least this share of its training letters.
SCRIPT_SHARE = 0.001
UNDETERMINED = "und"

#: First code point of ranges of scripts, in order; 0 is any other script.
SCRIPTS = (
    (0x0000, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9),
    (0x0A80, 10), (0x0B00, 11), (0x0B80, 12), (0x0C00, 13), (0x0C80, 14), (0x0D00, 15), (0x0D80, 16), (0x0E00, 17), (0x0E80, 18), (0x0F00, 19),
    (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x13A0, 0), (0x1780, 24), (0x1800, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0),
    (0x3040, 25), (0x30A0, 25), (0x3100, 0), (0x3400, 26), (0xA000, 0), (0xAC00, 22), (0xD7B0, 0), (0xF900, 26), (0xFB00, 0), (0xFF21, 1), (0xFF66, 25), (0x10000, 0), (0x20000, 26), (0x30000, 0),
)
N_SCRIPTS = 27
_SCRIPT_AT, _SCRIPT_OF = (np.array(x) for x in zip(*SCRIPTS, strict=True))
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """2 for letters, 1 for marks, which are parts of words but make none a text with letters, 0 for all else."""
    if not _letters:
        _letters.append(np.fromiter(("ML".find(unicodedata.category(chr(i))[0]) + 1 for i in range(0x110000)), np.uint8, 0x110000))
    return _letters[0]


def _words(column: pa.Array):
    """Letters of the lower-cased texts: trigram bucket and word of each; start, end, document and script of each word.

    Runs of marks alone are words only in a text that has a letter.
    """
    texts = pc.utf8_lower(pc.fill_null(column, "")).to_pylist()
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    kind = _letter_table()[chars]
    lengths = np.diff(at)
    lettered = np.bincount(np.repeat(np.arange(len(texts)), lengths)[kind == 2], minlength=len(texts)) > 0
    letter = (kind > 0) & np.repeat(lettered, lengths)
    border = np.zeros(len(chars) + 1, bool)
    border[at] = True
    first = letter & (border[:-1] | ~np.concatenate([[False], letter])[:-1]) if len(chars) else letter
    last = letter & (border[1:] | ~np.concatenate([letter[1:], [False]])) if len(chars) else letter
    where = np.flatnonzero(letter)
    mid = chars[where].astype(np.uint32)
    left = np.where(first[where], 0, chars[where - 1]).astype(np.uint32)
    right = np.where(last[where], 0, chars[np.minimum(where + 1, max(len(chars) - 1, 0))]).astype(np.uint32) if len(where) else mid
    h = left * np.uint32(0x9E3779B1) ^ mid * np.uint32(0x85EBCA6B) ^ right * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    bucket = ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int64)
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    word_at = np.searchsorted(where, starts)
    doc = np.searchsorted(at, starts, "right") - 1
    script = _SCRIPT_OF[np.searchsorted(_SCRIPT_AT, chars[starts], "right") - 1] if len(starts) else starts
    return bucket, word_at, starts, ends, doc, script, at


def train(docs: DataFrame) -> dict:
    """The model of the rows of ``docs`` (text, lang) whose text and lang are not null.

    Its size depends on the number of languages alone: per language a table of log-probabilities and its scripts.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for block in blocks(batches):
            bucket, word_at, starts, ends, doc, script, _ = _words(block.column("text"))
            langs = block.column("lang").to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            size = ends - starts
            n = BUCKETS + N_SCRIPTS
            found = np.bincount(np.repeat(code[doc], size) * n + bucket, minlength=len(names) * n) if len(bucket) else np.zeros(len(names) * n, np.int64)
            found = found + np.bincount(code[doc] * n + BUCKETS + script, size, minlength=len(names) * n).astype(np.int64)
            for i, name in enumerate(names):
                total[name] = total.get(name, 0) + found[i * n : (i + 1) * n]
        for name, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], ["lang", "cell", "n"])

    rows = docs.select("text", "lang").where("text is not null and lang is not null").mapInArrow(count, "lang string, cell int, n long")
    counts = rows.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()  # languages * (BUCKETS + scripts) rows at most
    langs = sorted(counts["lang"].unique())
    tables, uses = np.zeros((BUCKETS, len(langs)), np.float32), np.zeros((N_SCRIPTS, len(langs)), bool)
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        cells = np.bincount(own["cell"], own["n"], minlength=BUCKETS + N_SCRIPTS)
        grams, scripts = cells[:BUCKETS] + SMOOTHING, cells[BUCKETS:]
        tables[:, i] = np.log(grams / grams.sum())
        uses[:, i] = scripts >= max(1, SCRIPT_SHARE * scripts.sum())
    return {"langs": langs, "tables": tables, "uses": uses}


def word_scores(bucket: np.ndarray, word_at: np.ndarray, script: np.ndarray, model: dict) -> np.ndarray:
    """Log-likelihood [word, language]; a word of a script that no language uses says nothing."""
    scores = np.add.reduceat(model["tables"][bucket], word_at, axis=0).astype(np.float64)
    uses = model["uses"][script]
    known = uses.any(axis=1, keepdims=True)
    return np.where(known, np.where(uses, scores, NO_CANDIDATE), 0.0)


def viterbi(scores: np.ndarray, doc_at: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of each word; words doc_at[i] to doc_at[i + 1] are document i.

    A document in which no stretch of words gains more than its switches cost in any other language keeps
    one label; the others are solved step by step, all of a block at once.
    """
    labels = np.zeros(len(scores), np.int64)
    open_docs = []
    for i in range(len(doc_at) - 1):
        a, b = doc_at[i], doc_at[i + 1]
        if a == b:
            continue
        own = scores[a:b]
        best = int(own.sum(axis=0).argmax())
        labels[a:b] = best
        if own.shape[1] == 1:
            continue
        rival = own.copy()
        rival[:, best] = -np.inf
        gain = np.concatenate([[0.0], np.cumsum(rival.max(axis=1) - own[:, best])])
        low = np.minimum.accumulate(gain)
        if gain.max() > penalty or gain[-1] - low[-1] > penalty or (gain - low).max() > 2 * penalty:
            open_docs.append(i)
    if not open_docs:
        return labels
    open_docs = np.array(open_docs)
    length = doc_at[open_docs + 1] - doc_at[open_docs]
    order = np.argsort(-length, kind="stable")
    begin, length = doc_at[open_docs][order], length[order]
    back = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1])
    value = scores[begin].copy()
    for t in range(1, int(length[0])):
        n = int(np.searchsorted(-length, -t, "left"))  # documents longer than t
        v = value[:n]
        most = v.max(axis=1, keepdims=True) - penalty
        stay = v >= most
        back[begin[:n] + t] = np.where(stay, own, v.argmax(axis=1)[:, None])
        value[:n] = np.where(stay, v, most) + scores[begin[:n] + t]
    state = value.argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        n = int(np.searchsorted(-length, -t, "left"))
        labels[begin[:n] + t] = state[:n]
        state[:n] = back[begin[:n] + t, state[:n]] if t else state[:n]
    return labels


SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"


def label_block(column: pa.Array, model: dict, penalty: float, with_spans: bool) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, score and spans of each text."""
    langs, n = model["langs"], len(column)
    bucket, word_at, starts, ends, doc, script, at = _words(column)
    pred, score, spans = [UNDETERMINED] * n, np.zeros(n), [[] for _ in range(n)]
    if not len(starts) or not langs:
        return pred, score, spans
    scores = word_scores(bucket, word_at, script, model)
    doc_at = np.searchsorted(doc, np.arange(n + 1))
    labels = viterbi(scores, doc_at, penalty)
    letters = np.bincount(doc * len(langs) + labels, ends - starts, minlength=n * len(langs)).reshape(n, -1)
    best = letters.argmax(axis=1)
    some = np.flatnonzero(doc_at[1:] > doc_at[:-1])
    totals = np.add.reduceat(np.where((labels == best[doc])[:, None], scores, 0.0), doc_at[:-1][some], axis=0)
    sure = 1 / np.exp(np.clip(totals - totals[np.arange(len(some)), best[some]][:, None], -700, 700)).sum(axis=1)
    score[some] = np.clip(sure * letters[some, best[some]] / letters[some].sum(axis=1), 0, 1)
    for d in some:
        pred[d] = langs[best[d]]
    if with_spans:
        cut = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])]))
        stop = np.concatenate([cut[1:], [len(labels)]]) - 1
        for a, b in zip(cut, stop, strict=True):
            d = doc[a]
            spans[d].append({"start": int(starts[a] - at[d]), "end": int(ends[b] - at[d]), "lang": langs[labels[a]]})
    return pred, score, spans


def identify(docs: DataFrame, model: dict, with_spans: bool = True, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """lang_pred, score and spans (code points, end exclusive) of each row of ``docs`` (doc_id, text).

    The score is the share of letters in spans of that language, times its posterior over those spans. Null texts and
    texts without letters are ``und`` with score 0 and no spans, as is all if nothing was learned. Ties go to the
    language that sorts first. Repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the learned languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for block in blocks(batches):
            pred, score, spans = label_block(block.column("text"), shared.value, penalty, with_spans)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: dict, min_score: float, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known with at least that score. No shuffle."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            pred, score, _ = label_block(block.column("text"), shared.value, penalty, with_spans=False)
            keep = (score >= min_score) & np.array([p != UNDETERMINED for p in pred], bool)
            yield block.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(f"not coalesce({HELD_OUT}, false)"))
    spans = "array_join(transform(spans, s -> concat_ws(':', s.start, s.end, s.lang)), ',') spans"
    return identify(docs, model).selectExpr("doc_id", f"coalesce({HELD_OUT}, false) held_out", "lang_pred", "score", spans)
