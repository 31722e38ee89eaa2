"""Compression of vectors to codes: every part of a vector is replaced by the number of the nearest entry of the part's codebook.

The vectors are turned once into blocks of integers with a dictionary per dimension: the distinct integers that occur in the block, and each
vector's place among them (two bytes). Blocks are stored in the shared folder. A pass over them tabulates, per block and dimension, the squared
differences of every distinct integer to that dimension of all entries; a part's distances to all entries are then gathered from its dimensions'
tables by the dictionary codes and added up. A dictionary is no longer than its block, so memory is bounded whatever values occur.

Each round of fitting is one pass: tasks add up their vectors per part and entry (a row each), Spark adds the tasks' rows, and only the
codebook - parts x entries x width numbers - reaches the driver and goes out with the next pass.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from plumbline.llm.base import attach_by_size, keep

#: Vectors of a block; places in its dictionaries take two bytes.
BLOCK = 1 << 14
#: Larger integers are refused: distances of whole vectors would no longer be exact in 64 bits.
LARGEST = 1 << 28


@dataclass(frozen=True)
class CodeSettings:
    parts: int = 8
    entries: int = 16  # two hex digits hold 256
    rounds: int = 6
    scale: int = 4096


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    whole = np.floor(vectors.astype(np.float64) * scale)
    if np.abs(whole).max(initial=0) > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    return whole.astype(np.int64)


def dictionary(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct integers of a column in order, and each row's place among them."""
    low = int(column.min())
    span = int(column.max()) - low + 1
    if span > 4 * BLOCK:
        return np.unique(column, return_inverse=True)
    seen = np.zeros(span, bool)
    seen[column - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[column - low]


@dataclass
class Block:
    """Vectors as dictionary codes: per dimension the distinct integers and (dimensions x vectors) places among them."""

    values: list[np.ndarray]
    codes: np.ndarray

    @classmethod
    def of(cls, whole: np.ndarray) -> Block:
        found = [dictionary(column) for column in whole.T]
        return cls([v for v, _ in found], np.array([c for _, c in found], np.uint16).reshape(whole.shape[1], len(whole)))

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per part and vector the nearest entry (ties to the lower one) and its squared distance. ``book``: parts x entries x width."""
        parts, entries, width = book.shape
        n = self.codes.shape[1]
        largest = max((int(np.abs(v).max()) for v in self.values), default=0) + int(np.abs(book).max(initial=0))
        kind = np.int32 if largest * largest * width < 1 << 31 else np.int64
        best, error = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
        for p in range(parts):
            distance = np.zeros((n, entries), kind)
            for i in range(width):
                d = p * width + i
                table = ((self.values[d][:, None] - book[p, :, i]) ** 2).astype(kind)
                distance += table.take(self.codes[d], axis=0)
            best[p] = distance.argmin(axis=1)
            error[p] = np.take_along_axis(distance, best[p][:, None], axis=1)[:, 0]
        return best, error

    def totals(self, best: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Per part and entry the number of vectors, and the sum of each dimension. Sums of a block are exact in doubles."""
        parts = len(best)
        width = len(self.values) // parts
        counts = np.array([np.bincount(b, minlength=entries) for b in best])
        sums = np.zeros((parts, entries, width), np.int64)
        for d, values in enumerate(self.values):
            part = best[d // width]
            sums[d // width, :, d % width] = np.bincount(part, values[self.codes[d]].astype(np.float64), entries)
        return counts, sums


def usable(vector: str) -> Column:
    """Not null, and no component null, NaN or infinite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(F.col(vector).cast("array<double>"), bad)


def blocks(rows: DataFrame, scale: int) -> DataFrame:
    """``rows`` (``id``, ``label``, usable ``vector``) as blocks; vectors of different length are in different blocks."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                lengths = pa.compute.list_value_length(piece.column("vector")).to_numpy()
                for length in np.unique(lengths).tolist():
                    same = piece.filter(pa.array(lengths == length))
                    n = same.num_rows
                    flat = same.column("vector").flatten().to_numpy(zero_copy_only=False)
                    block = Block.of(integers(flat.reshape(n, length), scale))
                    sizes = [len(v) for v in block.values]
                    whole = np.concatenate(block.values) if block.values else np.empty(0, np.int64)
                    one = lambda column: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), same.column(column))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([length], pa.int32()), one("id"), one("label"), pa.array([sizes], pa.list_(pa.int32())), pa.array([whole.astype("<i8").tobytes()]), pa.array([block.codes.astype("<u2").tobytes()])],
                        names=["length", "ids", "labels", "sizes", "whole", "codes"],
                    )

    schema = StructType.fromDDL("length int").add("ids", ArrayType(rows.schema["id"].dataType)).add("labels", ArrayType(rows.schema["label"].dataType))
    for field in StructType.fromDDL("sizes array<int>, whole binary, codes binary"):
        schema = schema.add(field)
    return rows.mapInArrow(run, schema)


def _read(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            sizes = batch.column("sizes")[k].as_py()
            whole = np.frombuffer(batch.column("whole")[k].as_py(), "<i8")
            codes = np.frombuffer(batch.column("codes")[k].as_py(), "<u2")
            n = len(batch.column("ids")[k])
            yield batch, k, Block([whole[end - size : end] for size, end in zip(sizes, np.cumsum(sizes), strict=True)], codes.reshape(len(sizes), n))


def _round(stored: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook after one round: each entry the floor of its parts' mean; entries without parts stay."""
    parts, entries, width = book.shape

    def run(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, _, block in _read(batches):
            best, _ = block.assign(book)
            for total, more in zip((counts, sums), block.totals(best, entries), strict=True):
                total += more
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "number", "sums"],
        )

    added = stored.select("ids", "sizes", "whole", "codes").mapInArrow(run, "part int, entry int, number long, sums array<long>")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    added = added.groupBy("part", "entry").agg(F.sum("number").alias("number"), F.array(*(exact(F.col("sums")[i]) for i in range(width))).alias("sums"))
    new = book.copy()
    for row in added.collect():  # parts x entries rows at most
        new[row.part, row.entry] = [int(s) // row.number for s in row.sums]
    return new


def book_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def fit(stored: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    book = first
    for _ in range(rounds if first.size else 0):
        book = _round(stored, book)
    return book


def code(stored: DataFrame, book: np.ndarray) -> DataFrame:
    """Rows ``id``, ``label``, ``code`` (two hex digits per part), ``error`` of every vector in the blocks."""
    parts = len(book)

    def run(batches):
        for batch, k, block in _read(batches):
            best, error = block.assign(book)
            digits = best.T.astype(np.uint8).tobytes().hex()
            codes = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids").slice(k, 1).flatten(), batch.column("labels").slice(k, 1).flatten(), pa.array(codes, pa.string()), pa.array(error.sum(axis=0), pa.int64())], names=["id", "label", "code", "error"]
            )

    schema = StructType().add("id", stored.schema["ids"].dataType.elementType).add("label", stored.schema["labels"].dataType.elementType).add("code", "string").add("error", "long")
    return stored.mapInArrow(run, schema)


def compress(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", settings: CodeSettings | None = None) -> DataFrame:
    """Rows: the id, ``code``, ``error``, ``label_error`` (sum over the rows of an equal label, nulls together), ``codebooks_sha256``.

    Components become floor(scale x). Codebooks begin with the parts of the vectors of the smallest ids and are fitted by ``rounds`` rounds of
    exact integer means. Rows whose vector is null or holds a null, NaN or infinite component have no code and no row. Vectors of another length than the
    longest count as such too. Repeated rows are coded each; of equal ids among the smallest, those of smaller integers come first, null ids last. With
    fewer vectors than entries the codebooks are shorter. Vectors without components have an error of 0. An empty table gives no rows. Other columns
    are not read, whatever their names. A length that cannot be cut into equal parts, and components beyond ``LARGEST`` after scaling, are refused with an error.
    """
    settings = settings or CodeSettings()
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(usable("vector"))
    stored = keep(blocks(rows, settings.scale))
    length = stored.agg(F.max("length")).first()[0]
    if length is None:
        return _named(stored.select(F.explode("ids").alias("id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), id_column, "")
    if length % settings.parts:
        raise ValueError(f"{length} components cannot be cut into {settings.parts} equal parts")
    stored = stored.where(F.col("length") == length)
    whole = F.transform(F.col("vector").cast("array<double>"), lambda x: F.floor(x * settings.scale).cast("long")).alias("whole")
    smallest = rows.where(F.size("vector") == length).select("id", whole).orderBy(F.col("id").asc_nulls_last(), "whole").limit(settings.entries).collect()
    first = np.array([r.whole for r in smallest], np.int64).reshape(len(smallest), settings.parts, length // settings.parts)
    book = fit(stored, np.ascontiguousarray(first.transpose(1, 0, 2)), settings.rounds)
    coded = keep(code(stored, book).select("id", "code", "error", F.to_json(F.struct("label")).alias("key")))
    labels = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("size"))
    return _named(attach_by_size(coded, labels, ["key"], "size"), id_column, book_digest(book))


def _named(df: DataFrame, id_column: str, digest: str) -> DataFrame:
    return df.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
