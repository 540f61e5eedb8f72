"""Quality rules as weak supervision.

Each rule reads counted features of a text and votes good (+1), bad (-1) or abstains (0). Several rules see each kind of junk
from different sides, so a rule's bad votes are trusted as far as others confirm them. Expectation maximisation over
the counts of all vote patterns (at most 3 ** rules rows, however large the corpus) estimates how often each rule is
right, and the posterior probability of good quality replaces all-must-pass filtering. Whether a rule abstains is taken to say
nothing of the quality, in both steps: what is estimated is the chance of a bad vote among the votes a rule gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import blocks, ship, written
from .textops import FIELD_BYTES, flat, span_hashes, spans, windows

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_FROM = 0.5
#: EM ends when no prior changes by more than EM_CHANGE, or after EM_ROUNDS.
EM_ROUNDS, EM_CHANGE = 500, 1e-7

FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, n_upper long, n_digits long, n_chars long, n_marks long, n_same long"


def _is(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL = _is(b"#*$%&|<>")
_UPPER, _DIGIT = _is(bytes(range(65, 91))), _is(bytes(range(48, 58)))
_ASCII_LETTER = _is(bytes([*range(65, 91), *range(97, 123)]))
_MARK = _is(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_letters_beyond: list[np.ndarray] = []


def _letters(column: pa.Array, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters of each text, in any script."""
    found = _per_doc(buf, at, _ASCII_LETTER)
    if len(buf) and buf.max() > 127:
        if not _letters_beyond:
            _letters_beyond.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
        # Code points of the characters beyond ASCII: their lead byte, then the low six bits of each byte that follows.
        lead = np.flatnonzero(buf >= 0xC0)
        first = buf[lead].astype(np.uint32)
        size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        code = first & (np.uint32(0xFF) >> (size + 1).astype(np.uint32))
        for k in range(1, 4):
            some = size > k
            code[some] = code[some] << np.uint32(6) | (buf[lead[some] + k] & 0x3F)
        total = np.concatenate([[0], np.cumsum(_letters_beyond[0][code])])
        found = found + total[np.searchsorted(lead, at[1:])] - total[np.searchsorted(lead, at[:-1])]
    return found


_LEAD = ~((np.arange(256) & 0xC0) == 0x80)
_LINE = np.ones(256, bool)
_LINE[10] = False


def _per_doc(buf: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[buf])])
    return total[at[1:]] - total[at[:-1]]


def text_features(column: pa.Array) -> dict[str, np.ndarray]:
    """The features of each text; a null text counts as empty."""
    n = len(column)
    buf, at = flat(column)
    starts, ends, doc = spans(buf, at, FIELD_BYTES)
    lead = np.concatenate([[0], np.cumsum(_LEAD[buf])])
    words = np.bincount(doc, minlength=n)
    word_chars = np.bincount(doc, (lead[ends] - lead[starts]).astype(float), minlength=n).astype(np.int64)

    # Words covered by windows found twice or more in their text.
    hashes = span_hashes(buf, starts, ends)
    again = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]) if len(hashes) else np.zeros(0, bool)
    same_word = np.bincount(doc[1:][again], minlength=n)
    h, first = windows(hashes, doc, WINDOW)
    own = doc[first]
    order = np.lexsort((h, own))
    a, b = h[order], own[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) if len(a) else np.zeros(0, bool)
    twice = np.zeros(len(a), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, first[order][twice], 1)
    np.add.at(change, first[order][twice] + WINDOW, -1)
    repeated = np.bincount(doc, np.cumsum(change)[:-1] > 0, minlength=n).astype(np.int64)

    # Lines with a word that equal an earlier line of their text, byte for byte.
    ls, le, ld = spans(buf, at, _LINE)
    inside = np.concatenate([[0], np.cumsum(FIELD_BYTES[buf])])
    has_word = inside[le] > inside[ls]
    ls, le, ld = ls[has_word], le[has_word], ld[has_word]
    lh = span_hashes(buf, ls, le)
    lines = np.bincount(ld, minlength=n)
    order = np.lexsort((lh, ld))
    a, b = lh[order], ld[order]
    dup = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) if len(a) else np.zeros(0, bool)
    dup_lines = np.bincount(b[1:][dup], minlength=n) if len(a) else np.zeros(n, np.int64)
    return {
        "n_words": words, "word_chars": word_chars, "n_symbols": _per_doc(buf, at, _SYMBOL), "n_dup_lines": dup_lines, "n_repeat_words": repeated,
        "n_lines": lines, "n_letters": _letters(column, buf, at), "n_upper": _per_doc(buf, at, _UPPER), "n_digits": _per_doc(buf, at, _DIGIT), "n_chars": _per_doc(buf, at, _LEAD),
        "n_marks": _per_doc(buf, at, _MARK), "n_same": same_word,
    }


def features(docs: DataFrame) -> DataFrame:
    """FEATURES of each row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = text_features(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(v.astype(np.int64)) for v in found.values())], ["doc_id", *found])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, FEATURES)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(min_words: int = MIN_WORDS) -> dict[str, Column]:
    """Name and vote of each rule. Every rule abstains where the text gives it nothing to judge."""
    c = F.col
    long_enough = c("n_words") >= 5
    return {
        "length": _vote(c("n_words") >= 50, c("n_words") < min_words),
        "word_length": _vote(long_enough & (c("word_chars") >= 3 * c("n_words")) & (c("word_chars") <= 9 * c("n_words")), long_enough & ((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words")))),
        "symbols": _vote(long_enough & (100 * c("n_symbols") <= c("n_words")), long_enough & (10 * c("n_symbols") >= c("n_words"))),
        "line_repeats": _vote((c("n_lines") >= 2) & (c("n_dup_lines") == 0), (c("n_lines") >= 2) & (100 * c("n_dup_lines") > MAX_REPEAT_PERCENT * c("n_lines"))),
        "word_repeats": _vote((c("n_words") >= 16) & (100 * c("n_repeat_words") <= 5 * c("n_words")), (c("n_words") >= 16) & (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))),
        "capitals": _vote((c("n_letters") >= 20) & (10 * c("n_upper") <= c("n_letters")), (c("n_letters") >= 20) & (2 * c("n_upper") >= c("n_letters"))),
        "letters": _vote(long_enough & (100 * c("n_letters") >= 60 * c("n_chars")), long_enough & (100 * c("n_letters") < 40 * c("n_chars"))),
        "marks": _vote(long_enough & (100 * c("n_marks") <= 6 * c("n_chars")), long_enough & (100 * c("n_marks") > 10 * c("n_chars"))),
        "same_words": _vote((c("n_words") >= 16) & (100 * c("n_same") <= 5 * c("n_words")), (c("n_words") >= 16) & (100 * c("n_same") > 20 * c("n_words"))),
        "digits": _vote(F.lit(False), (c("n_chars") >= 20) & (5 * c("n_digits") >= c("n_chars"))),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Priors of the classes, and P(bad vote | class, the rule votes) as [rule, class].

    Class 0 is good text; class 1 + r starts as the kind of bad text that rule r sees, for different kinds of junk fail different
    rules, and becomes what the votes make of it. A class goes whose votes the others explain as well (by the Bayesian information
    criterion): a rule that errs alone makes no kind of junk. So the number of classes is found, two at least.
    """
    prior = np.array([0.8] + [0.2 / n_rules] * n_rules)
    bad = np.full((n_rules, 1 + n_rules), 0.1)
    bad[:, 0] = 0.02
    bad[np.arange(n_rules), 1 + np.arange(n_rules)] = 0.8
    if not patterns:
        return prior, bad
    votes = np.array([p for p, _ in patterns])
    n = np.array([k for _, k in patterns], float)
    worth = (n_rules + 1) / 2 * np.log(n.sum() + 1)
    prior, bad, likely = _fitted(votes, n, prior, bad, rounds)
    while len(prior) > 2:
        for c in 1 + np.argsort(prior[1:], kind="stable"):
            less = _fitted(votes, n, np.delete(prior, c) / (1 - prior[c]), np.delete(bad, c, axis=1), rounds)
            if less[2] >= likely - worth:
                prior, bad, likely = less
                break
        else:
            break
    return prior, bad


def _fitted(votes: np.ndarray, n: np.ndarray, prior: np.ndarray, bad: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Priors and chances after EM from the given ones, and the log-likelihood of the votes."""
    says_bad, says_good = (votes < 0).T.astype(float), (votes > 0).T.astype(float)
    for _ in range(rounds):
        share = class_posteriors(votes, prior, bad) * n[:, None]
        was, prior = prior, (share.sum(axis=0) + 1) / (n.sum() + len(prior))
        failed, passed = says_bad @ share, says_good @ share
        bad = (failed + 1) / (failed + passed + 2)
        if np.abs(prior - was).max() < EM_CHANGE:
            break
    log = _logs(votes, prior, bad)
    most = log.max(axis=1)
    return prior, bad, float(n @ (most + np.log(np.exp(log - most[:, None]).sum(axis=1))))


def _logs(votes: np.ndarray, prior: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.log(prior) + (votes < 0) @ np.log(bad) + (votes > 0) @ np.log1p(-bad)


def class_posteriors(votes: np.ndarray, prior: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """P(class | votes) as [pattern, class]; a rule that abstains gives no evidence."""
    log = _logs(votes, prior, bad)
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def quality_rules(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): features, base_failed, kept, the posterior and the votes.

    Null and empty texts have no words and fail; repeated rows are judged each; an empty table gives no rows;
    other columns are ignored. Texts are read whole. The shuffle is of vote patterns only (summed per task).
    """
    named = rules()
    table = written(features(docs).select("*", *(v.cast("int").alias(f"vote_{k}") for k, v in named.items())))
    votes = [f"vote_{k}" for k in named]
    counts = table.groupBy(*votes).count().collect()  # at most 3 ** len(votes) rows
    patterns = sorted((tuple(r[v] for v in votes), r["count"]) for r in counts)
    prior, bad = estimate(patterns, len(votes))
    seen = np.array([k for k, _ in patterns], int).reshape(-1, len(votes))
    good = class_posteriors(seen, prior, bad)[:, 0]
    spark = docs.sparkSession
    by_pattern = spark.createDataFrame([(*map(int, k), float(g)) for k, g in zip(seen, good, strict=True)], ", ".join(f"{v} int" for v in votes) + ", posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = table.join(F.broadcast(by_pattern), votes).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
