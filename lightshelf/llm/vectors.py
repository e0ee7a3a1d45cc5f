"""Embedding near-duplicates: int8 tile products with error bounds, full precision where it may matter.

1. Rows with the same bytes form one class; each class is one vector with a
   weight, the number of its distinct ids.  Vectors that are null, zero or hold null or non-finite parts are set
   aside and link with nothing.
2. Classes are dealt to groups of a bounded size by a hash, and each group
   is packed into one row, in the precision of the input.
3. Groups form strips of up to `SIDE` groups, and each pair of strips meets in
   one task, so that a group is sent once for each strip and not for each group.
   There, pairs of groups are made into unit vectors in double precision, int8
   codes and a bound on each vector's quantisation error, one after the other,
   and gone through in tiles.  For unit vectors x = q + e
   with code vectors q, |x.y - q.y'| <= |e_x| + |e_y| + |e_x||e_y| as |x| = |y| = 1
   (the codes' product differs by q_x.e_y + e_x.q_y + e_x.e_y, and |q| <= 1 + |e|).
   Only pairs whose bound reaches the threshold are computed again in double
   precision.  Products of codes are sums of whole numbers below 2^24, which
   single precision holds exactly; longer vectors are summed in parts.
4. A tile yields the number of links of each of its vectors, weighted by class
   sizes, and for each vector the smallest id of its component within the tile
   pair: at most one edge for each vector and tile pair, never all pairs.
5. Components follow from these edges by label propagation.

The number of tile products grows with the square of the distinct vectors: the
method compares all pairs; nothing is dropped by hashing.  What is shuffled is
the distinct vectors times the number of strips.

Defined results: rows that cannot be compared (null or empty vectors, zero ones,
null or non-finite parts) have no links and are their own component; so do
vectors of another length than their partners.  A row that is given twice
under one id is one vector and no link of its own; different vectors under one
id are different vectors.  Rows with a null id link with nothing: 0 links, a
null component, not kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightshelf.llm.common import stored
from lightshelf.llm.components import components

#: Rows of a tile; of its products, one tile pair holds 4 MB in single precision.
TILE = 1024
#: Numbers in the vectors of a group (16 MB in double precision), and the least number of groups, for parallelism.
GROUP_NUMBERS, LEAST_GROUPS = 1 << 21, 6
#: Groups in a strip at most: a task holds two strips as they came, 8 MB a group in single precision.
SIDE = 8
#: Room for rounding in double precision when the codes' bound is compared.
SLACK = 1e-9


def _units(vectors: np.ndarray) -> np.ndarray:
    # scaled by the largest part first: squares neither overflow nor vanish
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales, and the length of each vector's quantisation error (rounded up)."""
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    rest = units - codes * scale[:, None]
    return codes, scale, np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9) + 1e-12


def _code_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes: whole numbers, in single precision as long as they stay below 2^24."""
    step = (1 << 24) // (127 * 127)
    if a.shape[1] <= step:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((a[:, i : i + step].astype(np.float32) @ b[:, i : i + step].astype(np.float32).T).astype(np.float64) for i in range(0, a.shape[1], step))


def linked_pairs(a: dict, b: dict, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of tile `a` and of tile `b` with cosine at least `threshold`; within one tile each pair once, no row with itself."""
    bound = _code_product(a["codes"], b["codes"]) * a["scale"][:, None].astype(np.float32)
    # single precision from here on: widen by its rounding (a few parts in 2^24 of a value of about 1)
    bound *= b["scale"][None, :].astype(np.float32)
    least = threshold - SLACK - 1e-6
    reach = (least - a["error"]).astype(np.float32)[:, None]
    extra = (b["error"] * (1 + a["error"].max())).astype(np.float32)[None, :]
    i, j = np.nonzero(bound + extra >= reach)
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j
    exact = np.concatenate([(a["units"][i[k : k + 65536]] * b["units"][j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)])
    keep = exact >= threshold
    return i[keep], j[keep]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component under links i-j, by label propagation with pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def _unpacked(row: dict) -> dict:
    vectors = np.frombuffer(row["raw"], np.float64 if row["wide"] else np.float32).reshape(row["n"], row["dims"])
    units = _units(vectors.astype(np.float64))
    codes, scale, error = quantised(units)
    return {"ids": np.frombuffer(row["ids"], np.int64), "weight": np.frombuffer(row["weights"], np.int64), "units": units, "codes": codes, "scale": scale, "error": error}


def _tiles(group: dict) -> list[dict]:
    n = len(group["ids"])
    return [{k: v[i : i + TILE] for k, v in group.items()} for i in range(0, n, TILE)]


PACKED = "grp int, dims int, n int, wide boolean, ids binary, weights binary, raw binary"
EDGES = "id bigint, low bigint, links bigint"
NO_EDGES = pd.DataFrame({"id": [], "low": [], "links": []}).astype(np.int64)


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("class")
    return pd.DataFrame({"grp": [int(rows.grp.iloc[0])], "dims": int(rows.dims.iloc[0]), "n": len(rows), "wide": bool(rows.wide.iloc[0]), "ids": [rows["class"].to_numpy(np.int64).tobytes()], "weights": [rows.weight.to_numpy(np.int64).tobytes()], "raw": [b"".join(rows.raw)]})


def tile_links(a: dict, b: dict | None, threshold: float) -> pd.DataFrame:
    """Links and tile components of the vectors of two groups (or within one), a row for each linked vector and tile pair."""
    out = []
    first = _tiles(a)
    for x, left in enumerate(first):
        for right, same in [(t, t is left) for t in (first[x:] if b is None else _tiles(b))]:
            i, j = linked_pairs(left, right, threshold, same)
            if not len(i):
                continue
            n = len(left["ids"])
            ids = left["ids"] if same else np.r_[left["ids"], right["ids"]]
            weight = left["weight"] if same else np.r_[left["weight"], right["weight"]]
            j = j if same else j + n
            order = np.argsort(ids)  # the smallest row is then the smallest id
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            root = _roots(len(ids), place[i], place[j])
            links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
            hit = np.flatnonzero(links)
            out.append(pd.DataFrame({"id": ids[hit], "low": ids[order][root[place[hit]]], "links": links[hit].astype(np.int64)}))
    if not out:
        return NO_EDGES
    # tile pairs of one task: links add up, edges stay one for each distinct pair
    return pd.concat(out).groupby(["id", "low"], as_index=False).links.sum()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per input row: id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    wide = "double" in dict(vectors.dtypes)[vector_col]
    width = 8 if wide else 4

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            flat = pc.list_flatten(column)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            size = np.where(there, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), 0)
            values = pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            out = []
            for a, b in zip((ends - size).tolist(), ends.tolist()):
                v = values[a:b]
                out.append((v + 0.0).astype(np.float64 if wide else np.float32).tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "raw"])

    rows = stored(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).mapInArrow(raw, "id bigint, raw binary"))
    there = rows.where("raw is not null and id is not null")
    classes = stored(there.groupBy("raw").agg(F.min("id").alias("id"), F.countDistinct("id").alias("weight")))
    # a vector's class is named by its bytes: ids may repeat
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()))
    bytes_ = classes.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0]
    n_groups = max(LEAST_GROUPS, -(-bytes_ // width // GROUP_NUMBERS))
    side = max(1, min(SIDE, n_groups // 3))
    n_strips = -(-n_groups // side)
    grouped = classes.select("class", "id", "weight", "raw", F.lit(wide).alias("wide"), (F.octet_length("raw") / width).cast("int").alias("dims"), F.pmod(F.xxhash64("class"), F.lit(n_groups)).cast("int").alias("grp"))
    packed = stored(grouped.groupBy("dims", "grp").applyInPandas(_packed, PACKED))
    # each group is sent once for every strip
    strip = (F.col("grp") / side).cast("int")
    sent = packed.withColumn("partner", F.explode(F.sequence(F.lit(0), F.lit(n_strips - 1)))).withColumn("low", F.least(strip, "partner")).withColumn("high", F.greatest(strip, "partner"))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = key[1], key[2]
        held = rows.sort_values("grp").to_dict("records")
        out = [NO_EDGES]
        for x, first in enumerate(held):
            if first["grp"] // side != low:
                continue
            a = _unpacked(first)
            for second in held[x:]:
                if second is first and low == high:
                    out.append(tile_links(a, None, threshold))
                elif second is not first and second["grp"] // side == high:
                    out.append(tile_links(a, _unpacked(second), threshold))
        return pd.concat(out).groupby(["id", "low"], as_index=False).links.sum().astype(np.int64)

    n_tasks = min(n_strips * (n_strips + 1) // 2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = stored(sent.repartition(n_tasks, "dims", "low", "high").groupBy("dims", "low", "high").applyInPandas(compare, EDGES))
    linked = edges.groupBy("id").agg(F.sum("links").alias("links"))
    found = components(edges.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    named = classes.join(linked.withColumnRenamed("id", "class"), "class", "left").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = named.groupBy("component").agg(F.min("id").alias("lowest"))
    by_class = named.join(lowest, "component").select("raw", "weight", F.coalesce("links", F.lit(0)).alias("links"), "lowest")
    joined = there.join(by_class, "raw").select("id", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("lowest").alias("component_id"))
    alone = rows.where("raw is null or id is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
