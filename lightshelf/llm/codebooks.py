"""Vector code compression: product codebooks over whole numbers, screened in single precision and settled in int64.

1. Components become `floor(256 * x)`; vectors are cut into equal parts, each
   with a codebook that begins as that part of the smallest ids' vectors.
2. Assigning parts to entries: for a part x and entries c the products x.c are
   one matrix product in single precision.  |c|^2 - 2 x.c orders the entries as
   the squared distance does.  With u = 2^-24, a product of d terms whose
   factors were rounded too lies within (d + 2)u / (1 - (d + 2)u) |x||c| of the
   true one whatever the order of its sums, and the last two operations add
   3u of what they yield: every entry's value is known up to an interval.
   Entries whose interval overlaps that of the best are computed again in
   int64, and equal ones go to the lower index.
3. Each round, partitions add up int64 sums and counts of what each entry got;
   `treeReduce` merges them, and entries become floored means.  Codebooks and
   sums are of a fixed size: entries times components.
4. Errors per label are sums, combined before the shuffle; they come back by a
   broadcast if their measured number is small, and by a salted join otherwise.

Defined results: vectors that are null or hold null or non-finite components are
dropped, and so are those of another length than that of the smallest kept id (a length that
cannot be cut evenly is an error).  Rows with a null id are coded as others, but come
last in the order of ids; a row given twice counts twice, and different vectors
under one id begin the codebooks in order of their components.  Fewer vectors
than entries give smaller codebooks; an empty table an empty result.  Null labels are one label.
Components beyond +-2^18 are an error, as int64 might not hold the sums of their squares.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightshelf.llm.common import stored

#: Rows whose values against all entries a task holds at once.
ROWS = 4096
#: Distinct labels up to which their errors are sent to all tasks, and the parts that a label's rows are cut into beyond.
FEW, SALTS = 200_000, 16
#: Largest component.
MOST = 1 << 18


def screened(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry, its squared distance, and how many entries were computed again.

    `x` is (n, d), `entries` (k, d), both int64.
    """
    n, d = x.shape
    square = (entries * entries).sum(1)
    value = x.astype(np.float32) @ entries.astype(np.float32).T
    value *= np.float32(-2)
    value += square.astype(np.float32)[None, :]
    u = 2.0**-24
    gamma = (d + 2) * u / (1 - (d + 2) * u)
    far = math.sqrt(float(square.max()))
    length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    product = length * far  # at least |x||c|, up to rounding in double precision
    width = (2 * gamma * product + 3 * u * (2 * (1 + gamma) * product + far * far)) * (1 + 1e-6)
    best = value.min(1).astype(np.float64)
    near = value <= (best + 2 * width)[:, None]  # a double against a float is compared as doubles
    row, entry = np.nonzero(near)
    gap = x[row] - entries[entry]
    exact = (gap * gap).sum(1)
    first = np.r_[True, row[1:] != row[:-1]]
    starts = np.flatnonzero(first)
    least = np.minimum.reduceat(exact, starts) if n else exact
    hit = np.flatnonzero(exact == np.repeat(least, np.diff(np.r_[starts, len(row)])))
    hit = hit[np.r_[True, row[hit[1:]] != row[hit[:-1]]]] if n else hit  # entries ascend within a row: the first is the lowest
    return entry[hit], least, len(row)


def whole_numbers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a list column: which rows are kept, and their floored components one after the other."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(there, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    values = pc.fill_null(pc.list_flatten(column).cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(size)), size)
    bad = np.bincount(owner[~np.isfinite(values)], minlength=len(size)) > 0
    kept = there & ~bad
    return kept, np.floor(values[kept[owner]] * scale)


def _matrix(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    kept, flat = whole_numbers(column, scale)
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fits = kept & (size == dims)
    if not (fits == kept).all():
        flat = flat[np.repeat(fits[kept], size[kept])]
    if len(flat) and np.abs(flat).max() > MOST * scale:
        raise ValueError(f"components beyond {MOST}")
    return fits, flat.astype(np.int64).reshape(-1, dims)


def first_entries(vectors: DataFrame, entries: int, parts: int, scale: int, id_col: str, vector_col: str) -> np.ndarray:
    """Codebooks (parts, entries, d) of the smallest ids whose vectors are kept, empty if there are none."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(vector_col).isNotNull() & finite)
    order = [F.col(id_col).asc_nulls_last(), F.col(vector_col)]
    smallest = kept.orderBy(*order).select(F.size(vector_col).alias("n")).first()
    if smallest is None:
        return np.zeros((parts, 0, 0), np.int64)
    dims = smallest["n"]
    if not dims or dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    found = kept.where(F.size(vector_col) == dims).orderBy(*order).select(vector_col).limit(entries).collect()  # of a fixed number
    flat = np.floor(np.array([r[0] for r in found], np.float64) * scale).astype(np.int64)
    return np.ascontiguousarray(flat.reshape(len(found), parts, dims // parts).transpose(1, 0, 2))


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances (n, parts) of vectors (n, dims)."""
    parts, _, d = books.shape
    codes, errors = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    for i in range(0, len(x), ROWS):
        for p in range(parts):
            codes[i : i + ROWS, p], errors[i : i + ROWS, p], _ = screened(x[i : i + ROWS, p * d : (p + 1) * d], books[p])
    return codes, errors


def _totals(vectors: DataFrame, books: np.ndarray, scale: int, vector_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts, entries, d) and counts (parts, entries) of the vectors' parts by nearest entry."""
    parts, entries, d = books.shape
    spark = vectors.sparkSession
    held = spark.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, d + 1), np.int64)
        for batch in batches:
            _, x = _matrix(batch.column("v"), parts * d, scale)
            codes, _ = assigned(x, held.value)
            place = (codes + np.arange(parts) * entries).ravel()
            np.add.at(total, place, np.c_[x.reshape(-1, d), np.ones(len(place), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["totals"])

    each = vectors.select(F.col(vector_col).alias("v")).mapInArrow(add, "totals binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    none = spark.sparkContext.parallelize([np.zeros(parts * entries * (d + 1), np.int64)], 1)
    total = each.union(none).treeReduce(np.add).reshape(parts, entries, d + 1)
    return total[:, :, :d], total[:, :, d]


def fit(vectors: DataFrame, entries: int = 64, parts: int = 16, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Codebooks (parts, entries, d) after so many rounds over all vectors."""
    books = first_entries(vectors, entries, parts, scale, id_col, vector_col)
    for _ in range(rounds if books.size else 0):
        sums, counts = _totals(vectors, books, scale, vector_col)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, codes (array<int>) and error of each kept vector; `label` is null or the label as text."""
    parts, entries, d = books.shape
    held = vectors.sparkSession.sparkContext.broadcast(books)
    kind = f"id {dict(vectors.dtypes)[id_col]}, label string, codes array<int>, error bigint"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if entries else ():
            fits, x = _matrix(batch.column("v"), parts * d, scale)
            codes, errors = assigned(x, held.value)
            mask = pa.array(fits)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts, pa.int32()), pa.array(codes.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(mask), batch.column("label").filter(mask), lists, pa.array(errors.sum(1))], ["id", "label", "codes", "error"])

    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")).mapInArrow(code, kind)


def decode(codes: np.ndarray, books: np.ndarray, scale: int = 256) -> np.ndarray:
    """Vectors (n, dims) that codes (n, parts) stand for: the middle of what floors to their entries' components."""
    return ((books[np.arange(books.shape[0]), codes] + 0.5) / scale).reshape(len(codes), -1)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """`label_error` beside each row: the errors of all rows of its label."""
    key: Callable[[], Column] = lambda: F.coalesce(F.concat(F.lit("="), "label"), F.lit("null"))
    keyed = coded.withColumn("key", key())
    sums = stored(keyed.groupBy("key").agg(F.sum("error").alias("label_error")))
    if sums.count() <= FEW:
        return keyed.join(F.broadcast(sums), "key").drop("key")  # of a measured size
    salted = keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"]).drop("key", "salt")


def compress(vectors: DataFrame, entries: int = 64, parts: int = 16, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    books = fit(vectors, entries, parts, rounds, id_col=id_col, vector_col=vector_col)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = stored(encode(vectors, books, id_col=id_col, vector_col=vector_col, label_col=label_col))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return with_label_errors(coded).select(F.col("id").alias(id_col), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
