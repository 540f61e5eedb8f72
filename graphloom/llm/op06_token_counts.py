"""Token counts without token ids.

The vocabulary of a piece model has no piece in which a word mark follows another character, nor one with a
line end. So no merge crosses such a border, and a text's count is the sum of the counts of its pre-tokens
(a run of word marks with what follows it). Each task counts pieces once per distinct pre-token, keeps the counts
in the worker within a bound in bytes, and joins them to the pre-token frequencies of each document; no document's
ids are built, only those of a new pre-token, whose number is its count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .memo import Memo, distinct
from .runtime import blocks, ship
from .textops import flat, span_hashes

#: Limit of over_limit, in tokens.
LIMIT = 4096
#: Bytes of the counts a worker remembers (33 a pre-token); beyond it a rare pre-token is counted again.
MEMO_BYTES = 32 << 20

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
MARK = "▁"
#: A pre-token: marks, then all up to the next mark; a line end stands alone (it has no piece, so it becomes a byte).
PRE_TOKEN = re.compile(f"\\n|{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+")

_memos: dict[tuple[str, int], tuple] = {}


def _model(path: str, memo_bytes: int = MEMO_BYTES):
    if (path, memo_bytes) not in _memos:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}|\\n", p) for p in pieces):
            raise ValueError("the vocabulary has pieces across word marks; pre-tokens would not be independent")
        _memos[path, memo_bytes] = (model, Memo(memo_bytes))
    return _memos[path, memo_bytes]


def count_pieces(pre_tokens: list[str], path: str) -> list[int]:
    """Pieces of each pre-token, which is text after escaping and so gets no mark of its own."""
    model, _ = _model(path)
    # The library puts a mark before each text. One more mark as a sentinel line shields it: a line end is one byte piece.
    shield = len(model.encode("\n", num_threads=1))
    return [len(ids) - shield for ids in model.encode(["\n" + t for t in pre_tokens], num_threads=1)]


def count_tokens(texts: list[str], path: str, memo_bytes: int = MEMO_BYTES) -> list[int]:
    """Tokens of each text, each distinct pre-token counted once."""
    _, memo = _model(path, memo_bytes)
    frequencies = []
    for text in texts:
        escaped = (MARK + text.replace(" ", MARK)) if text else ""
        frequencies.append(Counter(PRE_TOKEN.findall(escaped)))
    tokens = list(set().union(*frequencies))
    buf, at = flat(pa.array(tokens, pa.large_string()))
    check = span_hashes(buf, at[:-1], at[1:], other=True)
    key, first, which = distinct(span_hashes(buf, at[:-1], at[1:]), check)
    check = check[first]
    known, _, counts = memo.find(key, check)
    pieces = np.empty(len(key), np.int64)
    pieces[known] = counts
    new = np.flatnonzero(~known)
    if len(new):
        pieces[new] = count_pieces([tokens[i] for i in first[new].tolist()], path)
        memo.add(key[new], check[new], np.ones(len(new), np.int64), pieces[new].astype(np.uint32))
    known_of = dict(zip(tokens, pieces[which].tolist(), strict=True)).__getitem__
    return [sum(n * known_of(t) for t, n in f.items()) for f in frequencies]


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of ``docs`` (doc_id, text).

    A null text counts as empty: 0 bytes, 0 tokens. Each input row gives one row, repeated ones too; an empty
    table gives none; other columns are ignored. No text is cut. There is no shuffle.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = pc.fill_null(block.column("text"), "")
            tokens = count_tokens(texts.to_pylist(), model_path)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(count, SCHEMA)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
