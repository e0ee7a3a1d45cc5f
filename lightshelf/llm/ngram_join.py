"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct shingles of five words.  Two documents link
when 100 * |intersection| >= percent * |union|.  The operator returns what the
links connect, without ever writing all pairs of a group:

1. Sets.  One pass makes each document's set size and fingerprint, and a table of
   shingle frequencies with a fixed number of places.  Documents with equal sets
   form a class; from here on only the smallest id of each class takes part.
2. Prefixes.  Shingles are ordered rare first (by frequency table, then hash).
   Similar sets share a shingle within the first n - ceil(percent n / 100) + 1.
   Prefix shingles are dealt by hash in packed rows; those that no other document
   has in its prefix go.  Shingles whose place is frequent travel as single rows
   instead, so that no packed part holds an unbounded run.
3. Pairs, first round.  In each prefix shingle's list the documents of similar
   size are compared with one of them: that in whose prefix the shingle stands
   first, i.e. with the fewest rarer shingles of its own.  Length and positional
   filters apply; each pair is kept once.
4. Verification.  A suffix filter comes first: the elements of a set in each of
   64 ranges of the hash, 128 bytes a document, bound the intersection of a pair.
   For the pairs that are left, sets are made again from the texts and compared
   exactly.
5. Pairs, second round.  Lists whose documents are not yet one component are
   joined with themselves, for documents of different components, under the same
   filters, without pairs already tried.  After it, every pair that passes the
   filters has been verified or lies within one component, so no connection
   between different texts is lost.
6. Components of all links, handed on to the members of the classes.

Shingles are compared by 64-bit hashes.  Defined results: null or empty texts
and texts without words have an empty set, link with nothing and are their own
component; rows with a null id are returned with their own size and a null
component.  Repeated rows (same id and text) are repeated in the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightshelf.llm.common import maybe_among, plain_strings, slices, stored
from lightshelf.llm.components import components

WIDTH = 5
#: Places of the frequency table (as a power of two) and of its blocks.
TABLE_BITS, BLOCK_BITS = 21, 14
#: Prefix shingles of one packed part.
PART = 400_000
BATCH_BYTES = 3 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles."""
    low = pc.ascii_lower(texts)
    for c in "\t\n\x0b\x0c\r":
        low = pc.replace_substring(low, c, " ")
    split = pc.split_pattern(low, " ")
    offsets = np.asarray(split.offsets, np.int64)
    words = split.flatten().dictionary_encode()
    names = words.dictionary
    codes = words.indices.to_numpy(zero_copy_only=False)
    value = pd.util.hash_array(np.asarray(names.to_pylist() + [""], object)[:-1], categorize=False) if len(names) else np.zeros(0, np.uint64)
    empty = pc.equal(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)
    real = ~empty[codes] if len(codes) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
    h = value[codes[real]] if len(codes) else np.zeros(0, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(len(h), np.uint64)
    for j in range(WIDTH):
        rolled[: max(0, len(h) - j)] = rolled[: max(0, len(h) - j)] * factor + h[j:]
    rolled = _mixed(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(rolled[a : b - WIDTH + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = np.uint64((int(whole) * int(factor) + int(x)) & (1 << 64) - 1)
            out.append(_mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# --- sets and frequencies --------------------------------------------------

SETS = "doc_id bigint, n_shingles bigint, mark binary, ranges binary, block int, task int, counts binary"
#: Ranges of the hash in which the suffix filter counts a set's elements (as a power of two), and the highest count kept.
RANGE_BITS, MOST_IN_RANGE = 6, (1 << 16) - 1


def range_counts(s: np.ndarray) -> bytes:
    """How many elements of a set lie in each range of the hash."""
    counts = np.bincount((s >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS)
    return np.minimum(counts, MOST_IN_RANGE).astype("<u2").tobytes()


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, then the task's frequency table in blocks."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("mark", pa.binary()), ("ranges", pa.binary()), ("block", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())])
    table = np.zeros(1 << TABLE_BITS, np.uint32)
    for batch in slices(batches, "text", BATCH_BYTES):
        sets = shingles(plain_strings(batch.column("text")))
        marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        n = len(sets)
        none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array([range_counts(s) if len(s) else None for s in sets], pa.binary()), *none], schema=schema)
        if n:
            table += np.bincount((np.concatenate(sets) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(table)).astype(np.uint32)
    task = TaskContext.get()
    blocks = [b for b in np.minimum(table, (1 << 16) - 1).astype(np.uint16).reshape(-1, 1 << BLOCK_BITS)]
    there = [i for i, b in enumerate(blocks) if b.any()]
    m = len(there)
    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(there, pa.int32()), pa.array([task.partitionId() if task else 0] * m, pa.int32()), pa.array([blocks[i].tobytes() for i in there], pa.binary())], schema=schema)


def _added(wide: bool):
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        kind = np.uint64 if wide else np.uint16
        total = np.zeros(1 << BLOCK_BITS, np.uint64)
        for c in rows.counts:
            total += np.frombuffer(c, kind)
        return pd.DataFrame({"block": [int(rows.block.iloc[0])], "counts": [total.tobytes()]})

    return add


def frequency_levels(rows: DataFrame) -> tuple[np.ndarray, float]:
    """For each place of the frequency table four times the binary logarithm of its count, and the level that is frequent."""
    blocks = rows.where("block is not null").select("block", (F.col("task") / 64).cast("int").alias("some"), "counts")
    # two steps, so that no task adds the tables of all tasks
    part = blocks.groupBy("block", "some").applyInPandas(_added(False), "block int, counts binary")
    total = np.zeros((1 << TABLE_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.float64)
    for r in part.groupBy("block").applyInPandas(_added(True), "block int, counts binary").toPandas().itertuples():
        total[r.block] = np.frombuffer(r.counts, np.uint64)  # a table of fixed size
    frequent = 8 * total.mean() + 1000
    return np.floor(4 * np.log2(1 + total)).astype(np.uint8).ravel(), 4 * math.log2(1 + frequent)


# --- prefixes --------------------------------------------------------------

POSTING = np.dtype([("h", "<i8"), ("doc", "<i8"), ("n", "<i4"), ("pos", "<i4")])
POSTINGS = "h bigint, doc bigint, n int, pos int"


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def prefix_rows(docs: DataFrame, levels, frequent: float, percent: int, n_parts: int) -> DataFrame:
    """Packed prefix shingles (part, packed), or single rows of frequent ones (part null)."""
    schema = pa.schema([("part", pa.int32()), ("packed", pa.binary()), ("h", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in slices(batches, "text", BATCH_BYTES):
            ids = batch.column("doc_id")
            rows = []
            for doc, s in zip(ids.to_pylist(), shingles(plain_strings(batch.column("text")))):
                p = prefix_length(len(s), percent)
                if doc is None or not p:
                    continue
                first = s[np.argsort(level[s >> np.uint64(64 - TABLE_BITS)], kind="stable")[:p]]
                row = np.empty(p, POSTING)
                row["h"], row["doc"], row["n"], row["pos"] = first.view(np.int64), doc, len(s), np.arange(p)
                rows.append(row)
            if not rows:
                continue
            flat = np.concatenate(rows)
            h = flat["h"].view(np.uint64)
            often = level[h >> np.uint64(64 - TABLE_BITS)] > frequent
            single, flat, h = flat[often], flat[~often], h[~often]
            part = (_mixed(h) % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            flat, cuts = flat[order], np.searchsorted(part[order], np.arange(n_parts + 1))
            there = np.flatnonzero(np.diff(cuts))
            m = len(there)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([flat[cuts[i] : cuts[i + 1]].tobytes() for i in there], pa.binary()), *(pa.nulls(m, t) for t in schema.types[2:])], schema=schema)
            if len(single):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(single), pa.int32()), pa.nulls(len(single), pa.binary()), *(pa.array(np.ascontiguousarray(single[c])) for c in ("h", "doc", "n", "pos"))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"part int, packed binary, {POSTINGS}")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix shingles of a part that stand in more than one document's prefix, and all single rows."""
    held: list[bytes] = []
    for batch in batches:
        packed = batch.column("packed")
        held += [x for x in packed.to_pylist() if x is not None]
        single = batch.filter(packed.is_null())
        if single.num_rows:
            yield single.select(["h", "doc", "n", "pos"])
    if held:
        flat = np.frombuffer(b"".join(held), POSTING)
        held.clear()
        order = np.argsort(flat["h"], kind="stable")
        h = flat["h"][order]
        same = h[1:] == h[:-1]
        keep = order[np.r_[False, same] | np.r_[same, False]]
        for a in range(0, len(keep), 50_000):
            rows = flat[keep[a : a + 50_000]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in ("h", "doc", "n", "pos")], ["h", "doc", "n", "pos"])


# --- candidate pairs -------------------------------------------------------


def _fits(percent: int, x: str = "x", y: str = "y") -> Column:
    """Length and positional filters for a pair that shares this shingle first."""
    nx, ny, px, py = (F.col(f"{a}.{c}") for c in ("n", "pos") for a in (x, y))
    rest = F.least(nx - px, ny - py)
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (rest * (100 + percent) >= (nx + ny) * percent)


def _pair(x: str = "x", y: str = "y") -> list[Column]:
    return [F.least(F.col(f"{x}.doc"), F.col(f"{y}.doc")).alias("a"), F.greatest(F.col(f"{x}.doc"), F.col(f"{y}.doc")).alias("b")]


def first_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Each list's documents of similar size with one of them, and those of neighbouring sizes with each other."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) if percent < 100 else F.col("n")).cast("int")
    banded = postings.withColumn("band", F.coalesce(band, F.lit(0)))
    best = F.min(F.struct((F.col("pos") / F.col("n")).alias("share"), "doc", "n", "pos"))
    pivots = banded.groupBy("h", "band").agg(best.alias("p"), F.count("*").alias("m")).select("h", "band", "m", "p.doc", "p.n", "p.pos").where("m > 0")  # all three uses read the same columns, so that one shuffle serves them
    star = banded.alias("x").join(pivots.where("m > 1").alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.band") == F.col("y.band")))
    star = star.where((F.col("x.doc") != F.col("y.doc")) & _fits(percent)).select(*_pair())
    near = pivots.alias("x").join(pivots.withColumn("up", F.col("band") - 1).alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.band") == F.col("y.up")))
    near = near.where((F.col("x.doc") != F.col("y.doc")) & _fits(percent)).select(*_pair())
    return star.unionByName(near).distinct()


def second_pairs(postings: DataFrame, labels: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within the lists that hold several, without those already tried."""
    named = postings.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component")
    mixed = named.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).where("low < high and m > 2").select("h")
    rows = named.join(mixed, "h")
    pairs = rows.alias("x").join(rows.alias("y"), F.col("x.h") == F.col("y.h")).where((F.col("x.doc") < F.col("y.doc")) & (F.col("x.label") != F.col("y.label")) & _fits(percent)).select(*_pair())
    return pairs.distinct().join(tried, ["a", "b"], "left_anti")


# --- verification ----------------------------------------------------------


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` with an id in `ids`; most others are left out before the shuffle."""
    return docs.where(maybe_among(ids)).join(ids.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` without an id in `ids`; most of them without a shuffle."""
    maybe = maybe_among(ids)
    rest = docs.where(maybe).join(ids.withColumnRenamed("doc", "doc_id"), "doc_id", "left_anti")
    return docs.where(~maybe).unionByName(rest.select(docs.columns))


def candidate_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc and its set (sorted hashes as bytes) for the documents in `ids`, and few others that the join with pairs leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            sets = [s.tobytes() for s in shingles(plain_strings(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc", "items"])

    return docs.select("doc_id", "text").where(maybe_among(ids)).mapInArrow(run, "doc bigint, items binary")


def possible(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Suffix filter on rows of range counts: elements of one range can only meet there."""
    need = -(-percent * (x.sum(axis=1) + y.sum(axis=1)) // (100 + percent))
    unknown = (x == MOST_IN_RANGE).any(axis=1) | (y == MOST_IN_RANGE).any(axis=1)
    return unknown | (np.minimum(x, y).sum(axis=1) >= need)


def plausible(pairs: DataFrame, ranges: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the suffix filter leaves; `ranges` has doc and its range counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, 1 << RANGE_BITS).astype(np.int64) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array(possible(x, y, percent), pa.bool_()))

    one = pairs.join(ranges.select(F.col("doc").alias("a"), F.col("ranges").alias("x")), "a")
    both = one.join(ranges.select(F.col("doc").alias("b"), F.col("ranges").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a bigint, b bigint")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets."""
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    if min(len(x), len(y)) < need:
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1])) >= need


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("doc").alias("a"), F.col("items").alias("x")), "a")
    both = one.join(sets.select(F.col("doc").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a bigint, b bigint")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()


def links_of(pairs: DataFrame, docs: DataFrame, ranges: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs that are similar, by the suffix filter and then exactly."""
    left = stored(plausible(pairs, ranges, percent))
    return stored(verified(left, stored(candidate_sets(docs, _ids(left))), percent))


# --- the operator ----------------------------------------------------------


def link_components(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(docs.mapInArrow(_set_rows, SETS))
    members = rows.where("block is null").select("doc_id", "n_shingles", "mark")
    levels, frequent = frequency_levels(rows)
    held = spark.sparkContext.broadcast(levels)
    classes = stored(members.where("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("doc")).where("doc is not null"))
    size = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size * (100 - percent) / 100 / PART) + 1)
    packed = prefix_rows(docs, held, frequent, percent, n_parts)
    dealt = packed.repartitionById(n_parts, F.coalesce("part", F.pmod(F.xxhash64("h", "doc"), F.lit(n_parts)).cast("int")))
    repeated = dealt.mapInArrow(_repeated, POSTINGS)
    postings = stored(repeated.join(classes.select("doc"), "doc", "left_semi"))
    tried = stored(first_pairs(postings, percent))
    ranges = rows.where("ranges is not null and doc_id is not null").select(F.col("doc_id").alias("doc"), "ranges")
    links = links_of(tried, docs, ranges, percent)
    labels = components(links)
    more = stored(second_pairs(postings, labels, tried, percent))
    if not more.isEmpty():
        found = links_of(more, docs, ranges, percent)
        if not found.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    by_class = classes.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("mark", F.coalesce("component", "doc").alias("component_id"))
    linked = members.where("mark is not null and doc_id is not null").join(by_class, "mark").select("doc_id", "n_shingles", "component_id")
    alone = members.where("mark is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("doc_id", id_col)


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """`docs` without the documents that link, directly or through others, with one of a smaller id.

    Of rows that repeat an id one stays; rows with a null id stay.
    """
    found = stored(link_components(docs, percent))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("doc")).distinct()
    again = stored(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("doc")))
    kept = without(docs, stored(gone))
    if again.isEmpty():
        return kept
    return without(kept, again).unionByName(_only(kept, again).dropDuplicates(["doc_id"]).select(docs.columns))
