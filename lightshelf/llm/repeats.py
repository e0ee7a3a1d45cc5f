"""Repeated passages, whatever their place: anchored contexts in enhanced suffix arrays, read off by stack scans.

A byte is removed if a string of `least` bytes that covers it starts anywhere
else too.  Any such string holds an anchor, the least of its `k`-byte strings
by a hash, at the same place in all of its occurrences; an anchor at `a` thus
answers for the strings that begin from `a - reach` to `a`, with
`reach = least - k`, and its context, the bytes from `a - reach` to `a + least`,
holds all of them.

1. One pass over all texts, block by block, yields the anchors: the hash of the
   anchor's bytes, a hash of its context, the document and the place.
2. Anchors whose bytes occur once anywhere are dropped.  Where all contexts of
   an anchor's bytes are the same, all of it repeats.  Only contexts that differ
   about the same bytes are looked into, one for each distinct context.
3. Groups of contexts of the same anchor bytes are dealt to tasks, many groups
   to one.  A group larger than `group_rows` is cut by longer keys: of the strings
   an anchor answers for, each half shares more bytes; contexts are keyed by
   those for either half, again and again, down to the strings themselves,
   and contexts alone under their key are out.
4. A task sorts the suffixes that begin at anchors, with the lengths of their
   common prefixes (an enhanced suffix array); a stack scan lists the intervals
   of suffixes with a longest common prefix `r`.  An interval's suffixes are
   put in order of what stands before them, read backwards, and scanned in the
   same way: each interval there, of a longest common extension `l` to the left
   before which the members differ, is a maximal repeat of `l + r` bytes with all
   its occurrences, and counts if `l + r >= least`.  What is compared are bytes.
5. What is covered in each context goes back to the documents, is united to
   spans, and cut from the texts.

Shares of the shuffle follow the anchors, about one in 60 bytes at `least` 200.
Contexts are told apart by 64 bits of hash within 64 bits of their anchor's.

Defined results: null and empty texts, and those shorter than `least`, lose
nothing; a row given twice repeats itself, and so loses all if it is long enough.
Ids may be null or repeat: rows are told apart by id and text.  An empty table gives
an empty result.  Texts are bytes: characters may be cut.  Texts of any length are
gone through in blocks.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightshelf.llm.common import discard, give_back, ragged, stored

#: Bytes of a block in which anchors are sought.
BLOCK = 1 << 19
#: Contexts of one group that a task takes at once, and contexts that are sorted together.
GROUP_ROWS, SORTED_ROWS = 1 << 15, 1 << 13
#: Distinct keys up to which a set of them is sent to all tasks.
FEW = 200_000
#: Bytes of contexts for each task.
TASK_BYTES = 32 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 20) - 1)
ANCHORS = "h bigint, c bigint, key bigint, loc bigint"
CONTEXTS = "h bigint, c bigint, n bigint, key bigint, loc bigint, cut int, bytes binary"


def key_length(least: int) -> int:
    """Bytes of an anchor."""
    return max(4, least * 8 // 25)


class Anchors:
    """Places of the anchors of byte strings; the powers of the rolling hash are kept."""

    def __init__(self, least: int) -> None:
        self.least, self.k = least, key_length(least)
        self.w = least - self.k + 1
        n = BLOCK + least
        self.powers = np.cumprod(np.full(n, _BASE))
        self.inverse = np.cumprod(np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64))))

    def _block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k, w = len(data), self.k, self.w
        m = n - k + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.inverse[:m]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        # the least hash of every window of w, the first among equals: prefix and suffix minima of stretches of w
        rows = -(-m // w)
        marked = np.full(rows * w, np.iinfo(np.uint64).max)
        marked[:m] = h & ~_PLACE | np.arange(m, dtype=np.uint64)
        grid = marked.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[: m - w + 1], ahead[w - 1 : m]) & _PLACE).astype(np.int64)
        at = at[np.r_[True, at[1:] != at[:-1]]]
        return at, h[at]

    def of(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and hashes of the anchors of one text, in blocks."""
        last = -1
        for s in range(0, len(data) - self.least + 1, BLOCK):
            at, h = self._block(data[s : s + BLOCK + self.least - 1])
            at = at + s
            new = at > last
            if new.any():
                last = int(at[-1])
                yield at[new], h[new]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, mark and text (bytes, never null) of each row: rows of the same key and mark are the same row again."""
    name, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(name, F.xxhash64(text)).alias("key"), F.hash(text, name.isNull()).alias("mark"), name.alias("id"), text.cast("binary").alias("text"))


def _anchor_table(keyed: DataFrame, least: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, reach = Anchors(least), least - key_length(least)
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for key, mark, text in zip(batch.column("key").to_pylist(), batch.column("mark").to_pylist(), batch.column("text")):
                view = memoryview(text.as_buffer())
                data = np.frombuffer(view, np.uint8)
                for at, h in finder.of(data):
                    c = [xxhash.xxh3_64_intdigest(view[max(0, a - reach) : a + least], min(a, reach)) for a in at.tolist()]
                    held.append((h, np.array(c, np.uint64), np.full(len(at), key), (np.int64(mark) << np.int64(32)) + at))
                    size += len(at)
                if size >= 1 << 16:
                    yield _batch(held, ANCHORS)
                    held, size = [], 0
            give_back()
        if held:
            yield _batch(held, ANCHORS)

    return keyed.select("key", "mark", "text").mapInArrow(find, ANCHORS)


def _batch(held: list[tuple], names: str) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*held)]
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns], [c.split()[0] for c in names.split(",")])


def _packed_texts(keyed: DataFrame, once: bool = False) -> DataFrame:
    """Texts as they go through a shuffle: compressed, and with `once` a row that is given again only once from each partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            if once:
                names = list(zip(batch.column("key").to_pylist(), batch.column("mark").to_pylist()))
                new = [i for i, x in enumerate(names) if not (x in seen or seen.add(x))]
                batch = batch.take(pa.array(new, pa.int64()))
            texts = pa.array([press.compress(t.as_buffer()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("mark"), batch.column("id"), texts], ["key", "mark", "id", "text"])
            give_back()

    return keyed.mapInArrow(pack, "key bigint, mark int, id bigint, text binary")


def _mark(loc: str = "loc") -> Column:
    return F.shiftright(loc, 32).cast("int")


def _place(loc: str = "loc") -> Column:
    return F.col(loc).bitwiseAND((1 << 32) - 1).cast("int")


def _contexts(keyed: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """The bytes of the contexts at `wanted` (h, c, n, key, loc)."""
    asked = wanted.groupBy("key", _mark().alias("mark")).agg(F.collect_list(F.struct("h", "c", "n", "loc")).alias("at"))  # one document's
    # contexts of a row given twice occur twice: that some are cut again changes nothing, as only those that occur once are asked for
    texts = _packed_texts(keyed, once=True).drop("id")
    reach = least - key_length(least)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for key, text, at in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("at")):
                data, rows = press.decompress(text.as_buffer()), at.values.to_pylist()
                for r in rows:
                    p = r["loc"] & 0xFFFFFFFF
                    out.append((r["h"], r["c"], r["n"], key, r["loc"], min(p, reach), data[max(0, p - reach) : p + least]))
                if len(out) >= 1 << 13:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)
            give_back()

    return asked.join(texts, ["key", "mark"]).select("key", "text", "at").mapInArrow(cut, CONTEXTS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [c.split()[0] for c in CONTEXTS.split(",")])


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Intervals (first, last, length) of a sorted list whose members share a longest prefix of at least `least`.

    `common[i]` is what members i and i + 1 share.  Each interval of the common-prefix tree comes once, inner ones first.
    """
    stack: list[tuple[int, int]] = []  # length, first
    for i, length in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > length:
            top, first = stack.pop()
            yield first, i, top
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def _bytes_matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8)
    return flat.reshape(len(strings), width), size


def _shared(matrix: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a[i] and b[i]."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 1 << 15):
        x, y = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
        differ = matrix[x] != matrix[y]
        first = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
        out[i : i + (1 << 15)] = np.minimum(first, np.minimum(size[x], size[y]))
    return out


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int, shortest: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats of contexts, as (bytes before the anchor, bytes from it on, the contexts where it occurs).

    `lefts` are what stands before the anchors, read backwards; repeats begin at
    or before an anchor, hold at least `shortest` bytes from it on, and `least` in all.
    """
    n = len(rights)
    order = np.array(sorted(range(n), key=rights.__getitem__))
    right, right_size = _bytes_matrix(rights, max(map(len, rights)))
    left, left_size = _bytes_matrix(lefts, max(1, *map(len, lefts)))
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=lefts.__getitem__)] = np.arange(n)
    found = np.array(list(intervals(_shared(right, right_size, order[:-1], order[1:]).tolist(), shortest)), np.int64).reshape(-1, 3)
    sizes = found[:, 1] - found[:, 0] + 1
    ends = np.cumsum(sizes)
    i = 0
    while i < len(found):  # so many intervals at once as have some 2^18 members
        upto = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 18), "right")))
        some, many = found[i:upto], sizes[i:upto]
        owner = np.repeat(np.arange(len(some)), many)
        members = order[ragged(some[:, 0], many)]
        members = members[np.lexsort((rank[members], owner))]
        pairs = np.flatnonzero(owner[1:] == owner[:-1])
        shared = np.full(len(members), -1, np.int64)  # with the next in the interval
        shared[pairs] = _shared(left, left_size, members[pairs], members[pairs + 1])
        # only intervals where some extension to the left is long enough
        worth = np.unique(owner[pairs][shared[pairs] + some[owner[pairs], 2] >= least])
        starts = np.cumsum(many) - many
        for j in worth.tolist():
            a, b, r = int(starts[j]), int(starts[j] + many[j]), int(some[j, 2])
            for first, last, length in intervals(shared[a : b - 1].tolist(), max(0, least - r)):
                yield length, r, members[a + first : a + last + 1]
        i = upto


def covered(contexts: list[bytes], cuts: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the bytes before and from its anchor on that repeats cover, 0 and 0 if none."""
    lo, hi = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
    for length, r, members in maximal_repeats([c[:a][::-1] for c, a in zip(contexts, cuts)], [c[a:] for c, a in zip(contexts, cuts)], least, key_length(least)):
        lo[members] = np.maximum(lo[members], length)
        hi[members] = np.maximum(hi[members], r)
    return lo, hi


def _among(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    few = keys.count() <= FEW
    return rows.join(F.broadcast(keys) if few else keys, on, how)  # of a measured size


def _split(rows: DataFrame, least: int) -> DataFrame:
    """Contexts under the longer keys of either half of the strings that they answer for (from `x` to `y` bytes before the anchor)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, sides = [], []
            for i, (x, y, a, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("x", "y", "cut", "bytes")))):
                middle = (x + y) // 2
                for low, high in ((x, middle), (middle + 1, y)):
                    # shared by all strings of this half: from `low` bytes before the anchor to the end of the one that begins `high` before it
                    if a >= low and len(text) >= a - high + least:
                        taken.append(i)
                        sides.append((xxhash.xxh3_64_intdigest(text[a - low : a - high + least], low), low, high))
            out = batch.take(pa.array(taken, pa.int64()))
            g, low, high = zip(*sides) if sides else ((), (), ())
            new = {"g": pa.array(np.array(g, np.uint64).view(np.int64)), "x": pa.array(low, pa.int32()), "y": pa.array(high, pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(c, out.column(c)) for c in out.schema.names], out.schema.names)

    return rows.mapInArrow(cut, rows.schema)


def _grouped(contexts: DataFrame, least: int, group_rows: int) -> list[DataFrame]:
    """Contexts with a group `g` of at most `group_rows`, or of equal strings of `least` bytes (x = y)."""
    level, parts = contexts.withColumns({"g": F.col("h"), "x": F.lit(0), "y": F.lit(least - key_length(least))}), []
    for _ in range(least.bit_length() + 1):
        sizes = stored(level.groupBy("g", "x").agg(F.count("*").alias("m")).where(f"m > {group_rows}"))  # no more than rows / group_rows
        if sizes.isEmpty():
            return [*parts, level]
        parts.append(_among(level, sizes.select("g", "x"), ["g", "x"], "left_anti"))
        large = _among(level, sizes.select("g", "x"), ["g", "x"], "left_semi")
        parts.append(large.where("x = y"))
        halves = stored(_split(large.where("x < y"), least))
        again = halves.groupBy("g", "x").agg(F.count("*").alias("m")).where("m > 1").select("g", "x")
        level = stored(_among(halves, stored(again), ["g", "x"], "left_semi"))
    return [*parts, level]


def _scan(rows: DataFrame, least: int) -> DataFrame:
    """key, loc, lo and hi of the contexts that occur once and are covered in part at least; rows come in groups."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _whole_groups(batches):
            whole = (frame.x == frame.y).to_numpy()
            lo, hi = frame.x.to_numpy(np.int64).copy(), least - frame.x.to_numpy(np.int64)
            lo[~whole], hi[~whole] = 0, 0
            # a context may stand under several keys: among the suffixes it is one
            some = np.flatnonzero(~whole)
            some = some[~frame[["key", "loc"]].iloc[some].duplicated().to_numpy()]
            if len(some):
                lo[some], hi[some] = covered([frame.bytes.iat[i] for i in some], [frame.cut.iat[i] for i in some], least)
            keep = (hi > 0) & (frame.n == 1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(frame.key[keep]), pa.array(frame["loc"][keep]), pa.array(lo[keep], pa.int32()), pa.array(hi[keep], pa.int32())], ["key", "loc", "lo", "hi"])
            give_back()

    return rows.mapInArrow(scan, "key bigint, loc bigint, lo int, hi int")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from rows sorted by group."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        held.append(frame)
        size += len(frame)
        if size >= SORTED_ROWS:
            rows = pd.concat(held, ignore_index=True)
            last = rows.g.iat[-1], rows.x.iat[-1]
            open_ = ((rows.g == last[0]) & (rows.x == last[1])).to_numpy()
            n = int(open_.argmax())
            if n:
                yield rows[:n].reset_index(drop=True)
            held, size = [rows[n:]], len(rows) - n
            # a group of equal strings needs no other: it may be cut anywhere
            if rows.x.iat[-1] == rows.y.iat[-1] and size >= SORTED_ROWS:
                yield rows[n:].reset_index(drop=True)
                held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def covers(keyed: DataFrame, least: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """key, mark, place of an anchor, and the bytes covered before it and from it on, as far as they lie in the text."""
    k = key_length(least)
    spark = keyed.sparkSession
    anchors = stored(_anchor_table(keyed, least))
    known = stored(anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("a"), F.max("c").alias("b")).where("n > 1").select("h", (F.col("a") != F.col("b")).alias("differ")))
    repeated = stored(anchors.join(known, "h"))
    discard(anchors, known)
    differ = repeated.where("differ")
    distinct = stored(differ.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "loc")).alias("first")).select("h", "c", "n", "first.key", "first.loc"))
    contexts = stored(_contexts(keyed, distinct, least))
    size = contexts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    parts = [_scan(p.select("g", "x", "y", "n", "key", "loc", "cut", "bytes").repartition(tasks, "g", "x").sortWithinPartitions("g", "x"), least) for p in _grouped(contexts, least, group_rows)]
    once = parts[0]
    for p in parts[1:]:
        once = once.unionByName(p)
    full = [F.lit(least - k).alias("lo"), F.lit(least).alias("hi")]
    again = distinct.where("n > 1").select("h", "c")
    whole = repeated.where("not differ").select("key", "loc", *full).unionByName(differ.join(again, ["h", "c"]).select("key", "loc", *full))
    found = stored(once.unionByName(whole).groupBy("key", "loc").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")))
    discard(repeated, distinct, contexts)
    return found.select("key", _mark().alias("mark"), _place().alias("place"), "lo", "hi")


def united(place: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that intervals around places cover in a text of n bytes."""
    a, b = np.maximum(place - lo, 0), np.minimum(place + hi, n)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1]]
    return a[new], b[np.r_[new[1:], True]]


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per row of `docs`: id, text (bytes, compressed), and starts and ends of what repeats."""
    keyed = _keyed(docs, id_col, text_col)
    found = covers(keyed, least, group_rows).groupBy("key", "mark").agg(F.collect_list(F.struct("place", "lo", "hi")).alias("at"))  # one document's
    return _packed_texts(keyed).join(found, ["key", "mark"], "left").select("id", "text", "at")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], list[tuple[np.ndarray, np.ndarray]]]]:
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            texts, spans = [], []
            for text, at in zip(some.column("text"), some.column("at")):
                data = press.decompress(text.as_buffer())
                texts.append(data)
                if at.is_valid:
                    v = at.values
                    spans.append(united(*(v.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("place", "lo", "hi")), len(data)))
                else:
                    spans.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            yield some.column("id"), texts, spans
            give_back()


def _kept(data: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    at = 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        yield data[at:a]
        at = b
    yield data[at:]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200, group_rows: int = GROUP_ROWS) -> DataFrame:
    """id, kept (the remaining bytes), and starts and ends of what was removed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, spans in _cut(batches):
            kept = [b"".join(_kept(t, *s)) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.binary()), *(pa.array([s[i] for s in spans], pa.list_(pa.int64())) for i in (0, 1))], ["id", "kept", "starts", "ends"])

    return removed_spans(docs, id_col, text_col, least, group_rows).mapInArrow(cut, "id bigint, kept binary, starts array<bigint>, ends array<bigint>").withColumnRenamed("id", id_col)


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans and the hash of what is kept."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, spans in _cut(batches):
            sums = []
            for t, s in zip(texts, spans):
                h = hashlib.sha256()
                for part in _kept(t, *s):
                    h.update(part)
                sums.append(h.hexdigest())
            numbers = [[len(t) for t in texts], [int((b - a).sum()) for a, b in spans], [len(a) for a, _ in spans]]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in numbers), pa.array(sums, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed_spans(docs, id_col, text_col, least, group_rows).mapInArrow(digest, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("id", id_col)
