"""Cost-balanced packing of documents into sequences.

The cost of a piece of n tokens is estimated as LINEAR * n + QUADRATIC * n * n (attention within the piece).
Documents of one group (a bounded run of rows of one partition) are taken in descending cost; each goes to the
sequence of lowest cost that has room for all of it, found exactly among all sequences of the group, and is cut only
where none has. A group opens as many full sequences as its tokens fill, and what is left goes to sequences of powers
of two, which need no padding. A group holds at most GROUP_TOKENS tokens and its longest block, and what a worker
remembers of the tokenizer is bounded in bytes, so memory does not grow with the input.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .memo import Memo, distinct, expand
from .runtime import blocks, ship
from .textops import FIELD_BYTES, flat, span_hashes, spans

CAPACITY = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
GROUP_TOKENS = 4_000_000
END_ID = 2
#: Bytes of white-space-delimited chunks, and of words in them, whose ids a worker remembers; others are encoded again.
MEMO_CHUNK_BYTES, MEMO_WORD_BYTES = 32 << 20, 16 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_memos: dict[tuple, tuple] = {}
#: What the tokenizer splits a normalised text into; between two matches there is nothing to encode. Must equal its own pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _tokenizer(path: str, chunk_bytes: int, word_bytes: int):
    key = (path, chunk_bytes, word_bytes)
    if key not in _memos:
        import json
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives the task its core; threads of the library would wait for others
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if (spec.get("pre_tokenizer") or {}).get("type") == "Sequence" else None
        _memos[key] = (Tokenizer.from_file(path), Memo(chunk_bytes), Memo(word_bytes), regex.compile(WORDS) if split == WORDS else None)
    return _memos[key]


def _pack_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


Rows = tuple[np.ndarray, np.ndarray]


def _looked_up(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, memo: Memo, fresh: Callable[[list[str]], Rows]) -> tuple[np.ndarray, Rows]:
    """Which distinct string each span is, and the number of ids and the ids of each distinct one in turn; ``fresh`` gives those of new ones."""
    key, check = span_hashes(buf, starts, ends), span_hashes(buf, starts, ends, other=True)
    key, first, which = distinct(key, check)
    check = check[first]
    known, old_size, old_ids = memo.find(key, check)
    new = np.flatnonzero(~known)
    raw = buf.tobytes()
    new_size, new_ids = fresh([raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
    memo.add(key[new], check[new], new_size, new_ids)
    size = np.zeros(len(key), np.int64)
    size[known], size[new] = old_size, new_size
    begin = np.empty(len(key), np.int64)
    begin[known], begin[new] = np.cumsum(old_size) - old_size, len(old_ids) + np.cumsum(new_size) - new_size
    return which, (size, np.concatenate([old_ids, new_ids])[expand(begin, size)])


def _per_span(which: np.ndarray, rows: Rows) -> Rows:
    size, ids = rows
    begin = np.cumsum(size) - size
    return size[which], ids[expand(begin[which], size[which])]


def encode(texts: list[str], path: str, chunk_bytes: int = MEMO_CHUNK_BYTES, word_bytes: int = MEMO_WORD_BYTES) -> list[bytes]:
    """Little-endian 32-bit ids of each text, without special tokens added.

    No token spans white space, so the texts are cut at ASCII white space, and of the chunks of a call each distinct
    one is looked up once, or encoded from the words in it, which are encoded once too. Texts with a special string (such
    as ``<|endoftext|>``), and all texts if the file's pattern is not the one above, are encoded whole.
    """
    tokenizer, chunk_memo, word_memo, pattern = _tokenizer(path, chunk_bytes, word_bytes)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    whole = [i for i, text in enumerate(texts) if pattern is None or any(s in text for s in special)]
    column = pa.array(texts, pa.large_string())
    if whole:
        column = pc.if_else(pa.array(np.isin(np.arange(len(texts)), whole)), pa.scalar("", pa.large_string()), column)
    normal = tokenizer.normalizer.normalize_str

    def words_of(words: list[str]) -> Rows:
        ids = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return size, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))

    def chunks_of(chunks: list[str]) -> Rows:
        parts = [pattern.findall(c.lower() if c.isascii() else normal(c)) for c in chunks]
        n_parts = np.fromiter(map(len, parts), np.int64, len(parts))
        buf, at = flat(pa.array(list(chain.from_iterable(parts)), pa.large_string()))
        size, ids = _per_span(*_looked_up(buf, at[:-1], at[1:], word_memo, words_of))
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(n_parts)]
        return np.diff(ends, prepend=0), ids

    buf, at = flat(column)
    starts, ends, doc = spans(buf, at, FIELD_BYTES)
    size, ids = _per_span(*_looked_up(buf, starts, ends, chunk_memo, chunks_of))
    cut = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(doc, np.arange(len(texts) + 1))]
    out = [ids[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    for i in whole:
        out[i] = _pack_ids(tokenizer.encode(texts[i], add_special_tokens=False).ids)
    return out


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences count from 0.

    All sequences but at most log2(capacity) ones are exactly full, and those hold a power of two each. Among sequences of
    equal cost the fullest takes a piece, then the first.
    """
    total = sum(lengths)
    sizes = [capacity] * (total // capacity)
    rest = total % capacity
    sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    out: list[tuple[int, int, int, int, int]] = []
    used, costs = [0] * len(sizes), [0.0] * len(sizes)
    whole = 0  # sequences that a long document fills alone, from the front
    rests = []
    for d, left in enumerate(lengths):
        start = 0
        while left >= capacity:
            out.append((d, start, capacity, whole, 0))
            start, left, whole = start + capacity, left - capacity, whole + 1
        if left:
            rests.append((-left, d, start))
    # Heaps by cost of the sequences with the same room, and the least cost of each.
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    least = np.full(capacity + 1, np.inf)

    def offer(s: int) -> None:
        room = sizes[s] - used[s]
        if room:
            heapq.heappush(by_room[room], (costs[s], s))
            least[room] = by_room[room][0][0]

    for s in range(whole, len(sizes)):
        offer(s)
    for minus, d, start in sorted(rests):
        left = -minus
        while left:
            room = left + int(least[left:].argmin())
            if least[room] == np.inf:  # none has room for all: fill the one with most room
                room = int(np.flatnonzero(least < np.inf)[-1])
            _, s = heapq.heappop(by_room[room])
            least[room] = by_room[room][0][0] if by_room[room] else np.inf
            n = min(left, room)
            out.append((d, start, n, s, used[s]))
            used[s] += n
            costs[s] += cost(n)
            start, left = start + n, left - n
            offer(s)
    return out


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all rows of ``docs`` (doc_id, text), as in SCHEMA; a sequence's pieces are gapless from offset 0.

    A null or empty text is a document of the end id alone. Each input row is a document of its own, repeated
    ones too; an empty table gives no rows; other columns are ignored. Texts of any length are cut into pieces.
    sequence_id holds the number of the partition in its high bits. There is no shuffle.
    """
    ship(docs.sparkSession)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        held: list[tuple[int, bytes]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            lengths = [len(b) // 4 for _, b in held]
            pieces = sorted(pack(lengths, capacity))
            cols = np.array(pieces, np.int64).reshape(-1, 5)
            crc = [zlib.crc32(memoryview(held[d][1])[4 * s : 4 * (s + n)]) for d, s, n, _, _ in pieces]
            ids = pa.array([i for i, _ in held], pa.int64())
            out = [ids.take(pa.array(cols[:, 0])), pa.array(cols[:, 1]), pa.array(cols[:, 2]), pa.array(crc, pa.int64()), pa.array(np.array(lengths, np.int64)[cols[:, 0]]), pa.array(cols[:, 3] + sequence), pa.array(cols[:, 4])]
            sequence += int(cols[:, 3].max()) + 1
            return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for block in blocks(batches):
            texts = pc.fill_null(block.column("text"), "").to_pylist()
            for doc_id, ids in zip(block.column("doc_id").to_pylist(), encode(texts, tokenizer_path), strict=True):
                held.append((doc_id, ids + end))
                tokens += len(ids) // 4 + 1
            if tokens >= GROUP_TOKENS:
                yield flush()
                held, tokens = [], 0
        if held:
            yield flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
