"""Helpers that several operators share: reading tables, cutting lineage, splitting texts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library, which has no such call
    _LIBC = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where the session names none, a temporary one in local mode (tests), and an error on a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lightshelf-")
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read back: later uses reread it, lost executors cost nothing.

    The files stay under spark.checkpoint.dir until `discard` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes the files of stored tables whose last reader has written its own result."""
    for found in tables:
        where = found.sparkSession._jvm.org.apache.hadoop.fs.Path(found.stored_at)
        where.getFileSystem(found.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def quoted(name: str) -> str:
    """A column's name as Spark reads it whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def schema_of(df: DataFrame, columns: list[str]) -> str:
    """Columns of `df` with their types, as a schema in words, with a comma behind each."""
    kinds = dict(df.dtypes)
    return "".join(f"{quoted(c)} {kinds[c]}, " for c in columns)


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with marks before it until no column in `taken` begins so."""
    while any(c.lower().startswith(name.lower()) for c in taken):
        name = "_" + name
    return name


def give_back() -> None:
    """Hands memory that is no longer used back to the system: idle workers keep it otherwise, beside those at work."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, most_rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about `most_bytes` of `column`, at least a row and at most `most_rows`."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most_bytes + np.arange(n) // most_rows
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], n]):
            yield batch.slice(a, b - a)
            give_back()


def plain_strings(column: pa.Array) -> pa.Array:
    """Strings of one chunk, nulls as empty ones, in memory of their own.

    A slice shares its parent's memory, which some string kernels do not allow for.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(column, "").cast(pa.large_string())
    return filled.take(pa.array(np.arange(len(filled)), pa.int64()))


#: White space for the patterns below: what any of the libraries' \s may match.
_WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A space after white space and before more of it: splitting there would cut a run that is one piece.
RUN_OF_THREE = rf"[{_WS}] (?:[{_WS}]|$)"
RUN_OF_TWO = "  "


def spaced_words(texts: pa.Array, keep_whole: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts as codes into a dictionary of the distinct pieces that begin at spaces.

    A piece is a text's start or a space with what follows up to the next
    space.  Tokenizers that split at white space never join across such a
    place, so that each distinct piece need be encoded only once.  Texts that
    match `keep_whole` stay one piece each.  Returns the codes of all texts,
    one after the other, the offsets of the texts, and the pieces.
    """
    n = len(texts)
    whole = pc.match_substring_regex(texts, keep_whole).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
    offsets = np.asarray(split.offsets, np.int64)
    offsets = offsets - offsets[0]
    words = split.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + 1
    first = offsets[:-1]
    codes[first] -= 1
    names = words.dictionary.to_pylist()
    rows = np.flatnonzero(whole)
    codes[first[rows]] = 2 * (len(names) + np.arange(len(rows)))
    names += texts.take(pa.array(rows)).to_pylist()
    used, codes = _compact(codes, 2 * len(names))
    assert len(offsets) == n + 1
    return codes, offsets, [" " + names[c >> 1] if c & 1 else names[c >> 1] for c in used.tolist()]


def _compact(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(most, bool)
    seen[codes] = True
    used = np.flatnonzero(seen)
    place = np.zeros(most, np.int64)
    place[used] = np.arange(len(used))
    return used, place[codes]


def ragged(values_at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at `values_at` and are `lengths` long, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(values_at - (ends - lengths), lengths)


#: Places of the bit table by which rows outside of a set of ids are left out before a shuffle, as a power of two.
FILTER_BITS = 24


def maybe_among(ids: DataFrame) -> Column:
    """Whether doc_id may be among `ids` (column doc): never false for those that are.

    A bit table of fixed size: at most 512 bitmaps of 4 KB, whatever the number of ids.
    """

    def at(column: str) -> tuple[Column, Column]:
        place = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS)) + 1
        return F.call_function("bitmap_bucket_number", place), F.call_function("bitmap_bit_position", place)

    bucket, position = at("doc")
    bitmaps = stored(ids.select(bucket.alias("bucket"), position.alias("position")).groupBy("bucket").agg(F.call_function("bitmap_construct_agg", F.col("position")).alias("bits")))
    held = bitmaps.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits")))).scalar()
    bucket, position = at("doc_id")
    byte = F.substring(F.try_element_at(held, bucket), (position / 8).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (position % 8).cast("int"))
    return F.col("doc_id").isNotNull() & F.coalesce(bit == 1, F.lit(False))


LETTER = re.compile(r"[^\W\d_]")
