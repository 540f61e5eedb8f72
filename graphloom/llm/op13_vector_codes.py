"""Compression of vectors to one byte a part: Lloyd's rounds with Elkan's bounds, in whole numbers.

A vector is scaled and floored to integers and cut into PARTS equal parts; each part position has a codebook of ENTRIES entries.
With each vector stay, for each of its parts, an upper bound of the distance to its entry and a lower bound of the distance to every
entry. When entries move, the bounds are shifted by how far; an entry is not looked at if its lower bound is above the upper one, or
if it is more than twice the upper bound away from the vector's own entry. Both are strict, and what is left is compared by squared
distances in integers, so that codes, ties included, are those of a full search.

Bounds are whole numbers, rounded to the safe side: an upper bound up, a lower one down, held in 16 bits (a distance beyond that is at
least that far). They are written with the vectors round by round, which cuts lineage; codebooks have ENTRIES rows and are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import drop_written, ship, written

#: Fixed values.
PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024

#: Scaled components reach no further, so that no sum of squares of a part of up to 64 leaves 64 bits.
MOST = 1 << 27
_FAR = (1 << 16) - 1
#: Rows that one vectorised step holds.
STEP_ROWS = 1024

_STATE = "vec_id {id}, label {label}, parts binary, code binary, upper binary, lower binary"


def floor_root(x: np.ndarray) -> np.ndarray:
    """The whole part of square roots, exactly."""
    root = np.sqrt(x.astype(np.float64)).astype(np.int64)
    root -= root * root > x
    root += (root + 1) * (root + 1) <= x
    return root


def ceil_root(x: np.ndarray) -> np.ndarray:
    root = floor_root(x)
    return root + (root * root < x)


def all_squares(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, in integers."""
    out = np.empty((len(rows), len(entries)), np.int64)
    for c, entry in enumerate(entries):
        off = rows - entry
        out[:, c] = np.einsum("ij,ij->i", off, off)
    return out


class Search:
    """Nearest entries of one part position: the present codebook and how far its entries have moved since the bounds were held."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        self.between = floor_root(all_squares(entries, entries))
        apart = self.between + np.where(np.eye(len(entries), dtype=bool), np.iinfo(np.int64).max // 4, 0)
        self.nearest = apart.min(axis=1)
        self.moved = None if before is None else ceil_root(((entries - before) ** 2).sum(axis=1))
        self.looked_at = 0

    def first(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code, upper and lower bounds by a full search."""
        squares = all_squares(rows, self.entries)
        self.looked_at += squares.size
        code = squares.argmin(axis=1)  # the first of equal ones
        return code, ceil_root(squares[np.arange(len(rows)), code]), np.minimum(floor_root(squares), _FAR)

    def again(self, rows: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from bounds held for the codebook before."""
        code, upper = code.astype(np.int64), upper + self.moved[code]
        lower = np.maximum(lower.astype(np.int64) - self.moved, 0)
        open_ = np.flatnonzero(self.nearest[code] <= 2 * upper)
        open_ = open_[self._candidates(code[open_], upper[open_], lower[open_]).any(axis=1)]
        if not len(open_):
            return code, upper, lower
        own = code[open_]
        off = rows[open_] - self.entries[own]
        own_square = np.einsum("ij,ij->i", off, off)
        upper[open_], lower[open_, own] = ceil_root(own_square), np.minimum(floor_root(own_square), _FAR)
        i, c = np.nonzero(self._candidates(own, upper[open_], lower[open_]))
        off = rows[open_[i]] - self.entries[c]
        square = np.einsum("ij,ij->i", off, off)
        self.looked_at += len(open_) + len(square)
        lower[open_[i], c] = np.minimum(floor_root(square), _FAR)
        i, c, square = np.concatenate([np.arange(len(open_)), i]), np.concatenate([own, c]), np.concatenate([own_square, square])
        order = np.lexsort((c, square, i))
        best = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        code[open_], upper[open_] = c[best], ceil_root(square[best])
        return code, upper, lower

    def _candidates(self, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        near = (lower <= upper[:, None]) & (self.between[code] <= 2 * upper[:, None])
        near[np.arange(len(code)), code] = False
        return near


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of a binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())


def _scaled(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * SCALE).astype(np.int64).reshape(len(column), -1)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(at, STEP_ROWS)


def _searched(rows: DataFrame, kinds: dict[str, str], books: list[np.ndarray], before: list[np.ndarray] | None) -> DataFrame:
    """Rows with code and bounds for ``books``: by a full search from ``embedding`` if there is no book before, else from the bounds held for it."""
    held = rows.sparkSession.sparkContext.broadcast((books, before))
    width, many = books[0].shape[1], len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = held.value
        search = [Search(now[p], None if old is None else old[p]) for p in range(PARTS)]
        for batch in _steps(batches):
            if old is None:
                parts = _scaled(batch.column("embedding"))
            else:
                parts = _matrix(batch.column("parts"), np.int32, PARTS * width).astype(np.int64)
                code, upper = _matrix(batch.column("code"), np.uint8, PARTS), _matrix(batch.column("upper"), np.int64, PARTS)
                lower = _matrix(batch.column("lower"), np.uint16, PARTS * many)
            found = []
            for p, s in enumerate(search):
                own = parts[:, p * width : (p + 1) * width]
                found.append(s.first(own) if old is None else s.again(own, code[:, p], upper[:, p], lower[:, p * many : (p + 1) * many]))
            columns = [batch.column("vec_id"), batch.column("label"), _binary(parts.astype(np.int32)), _binary(np.stack([f[0] for f in found], axis=1).astype(np.uint8))]
            columns += [_binary(np.stack([f[1] for f in found], axis=1)), _binary(np.concatenate([f[2] for f in found], axis=1).astype(np.uint16))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "parts", "code", "upper", "lower"])

    return rows.mapInArrow(run, _STATE.format(**kinds))


def _means(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Books with each entry at the floor of the mean of its parts; entries without parts stay. Tasks send sums; the driver gets a row per entry."""
    width, many = books[0].shape[1], len(books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((PARTS, many), np.int64), np.zeros((PARTS, many, width), np.int64)
        for batch in _steps(batches):
            parts, code = _matrix(batch.column("parts"), np.int32, PARTS * width).astype(np.int64), _matrix(batch.column("code"), np.uint8, PARTS)
            for p in range(PARTS):
                n[p] += np.bincount(code[:, p], minlength=many)
                np.add.at(total[p], code[:, p], parts[:, p * width : (p + 1) * width])
        p, c = np.nonzero(n)
        columns = [pa.array(p), pa.array(c), pa.array(n[p, c]), *(pa.array(total[p, c, k]) for k in range(width))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{k}" for k in range(width))])

    fields = [f"s{k}" for k in range(width)]
    schema = ", ".join(f"{c} long" for c in ("part", "entry", "n", *fields))
    rows = state.select("parts", "code").mapInArrow(sums, schema).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *fields))).collect()
    out = [b.copy() for b in books]
    for r in rows:
        out[r["part"]][r["entry"]] = [r[f] // r["n"] for f in fields]
    return out


def _coded(state: DataFrame, kinds: dict[str, str], books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code in hex, error) of vectors by their codes."""
    width = books[0].shape[1]
    held = state.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            parts, code = _matrix(batch.column("parts"), np.int32, PARTS * width).astype(np.int64), _matrix(batch.column("code"), np.uint8, PARTS)
            off = parts - np.concatenate([held.value[p][code[:, p]] for p in range(PARTS)], axis=1)
            error = np.einsum("ij,ij->i", off, off)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes().hex() for row in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "parts", "code").mapInArrow(run, f"vec_id {kinds['id']}, label {kinds['label']}, code string, error long")


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and within MOST when scaled."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= MOST / SCALE))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (vec_id, label, code, error, label_error, codebooks_sha256) of usable ``vectors`` (vec_id, embedding, label), and the codebooks.

    Rows with a null vector, a null or non-finite component, or one of MOST / SCALE = 131,072 or more are dropped, and so are those of
    another length than the first kept vector's; that length must be a multiple of PARTS. Codebooks start from the first ENTRIES kept rows
    by vec_id, of equal ids by vector, null ids last, and have fewer entries if there are fewer rows. Rows that repeat an id are rows of their own.
    Null labels are one label. An empty table gives no rows and no codebooks. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    kinds = {"id": vectors.schema["vec_id"].dataType.simpleString(), "label": vectors.schema["label"].dataType.simpleString()}
    kept = vectors.select("vec_id", "embedding", "label").where(usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    by_id = kept.select("vec_id", whole.alias("whole")).orderBy(F.col("vec_id").asc_nulls_last(), "whole")
    first = by_id.limit(1).collect()
    schema = f"vec_id {kinds['id']}, label {kinds['label']}, code string, error long, label_error long, codebooks_sha256 string"
    if not first or not first[0]["whole"]:
        return spark.createDataFrame([], schema), []
    length = len(first[0]["whole"])
    if length % PARTS:
        raise ValueError(f"vectors of {length} components have no {PARTS} equal parts")
    kept = kept.where(F.size("embedding") == length)
    start = np.array([r["whole"] for r in by_id.where(F.size("whole") == length).limit(ENTRIES).collect()], np.int64)
    books, before = np.split(start, PARTS, axis=1), None
    state = written(_searched(kept, kinds, books, None))
    for _ in range(rounds):
        before, books = books, _means(state, books)
        earlier, state = state, written(_searched(state, kinds, books, before))
        drop_written(earlier)
    text = ",".join(str(x) for b in books for x in b.ravel().tolist())
    coded = written(_coded(state, kinds, books))
    drop_written(state)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "its")
    rows = coded.join(totals, F.col("label").eqNullSafe(F.col("its"))).drop("its")
    return rows.select("vec_id", "label", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256")), books


def decoded(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``codes`` with ``approximate``, the entries that the code names, one after another and unscaled."""
    tables = [F.array(*(F.array(*(F.lit(x / SCALE) for x in entry)) for entry in b.tolist())) for b in books]
    parts = [F.get(t, F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")) for p, t in enumerate(tables)]
    return codes.withColumn("approximate", F.concat(*parts))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return rows.drop("label")
