"""Names to places: an n-gram index over the names of a gazetteer, kept as tables.

A place has its name, its plain form and its other names, each in lower case
with single spaces.  An exact name counts before a near one; a near one shares
at least `LEAST` of the grams of both (Dice).  Candidates for near ones come
from a name's rarest grams alone: of `a` grams at least c = ceil(LEAST a / (2 - LEAST))
must be shared, so that one of the a - c + 1 rarest is; no candidate is lost.
Equal names are ranked by kind of place, then by population, then by id.

Boxes: an area (feature class A) has the extent of the places within it, by
its country and area codes; other places a square by population.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightshelf.functions import scalar as S
from lightshelf.operators.lineage import written
from lightshelf.operators.ranking import top_per_group
from lightshelf.plans import parse

#: Signs of a gram, and the least share of common grams.
GRAM, LEAST = 3, 0.6
#: Names that are put in order in one task.
TASK_NAMES = 1 << 17
#: Kinds of place in the order in which they count.
KINDS = ("P", "A")
#: What may stand behind a name that alone is found as a point only.
SUFFIXES = ("region", "county", "area", "national park", "state park", "island", "valley")


def plain(name) -> Column:
    return F.trim(F.regexp_replace(F.lower(S.col(name)), r"\s+", " "))


def grams(name) -> Column:
    """Distinct grams of a name with its ends marked; of a shorter one the whole."""
    marked = F.concat(F.lit("^"), S.col(name), F.lit("$"))
    n = F.length(marked)
    return F.array_distinct(F.when(n <= GRAM, F.array(marked)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (GRAM - 1), F.lit(1))), lambda i: F.substring(marked, i, F.lit(GRAM)))))


def _kind() -> Column:
    """The place of a feature class among the kinds, others last."""
    return F.coalesce(*[F.when(F.col("feature_class") == k, i) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))


def place_names(places: DataFrame) -> DataFrame:
    """name_key, place and its columns, a row for each distinct name of a place (geonameid, which is its alone, name, asciiname, alternatenames, lat, lon, feature_class, population, country, admin1_code)."""
    every = F.array_union(F.array("name", "asciiname"), F.split(F.coalesce("alternatenames", F.lit("")), ","))
    rows = places.where("lat is not null and lon is not null").withColumn("key", F.explode(F.array_distinct(F.transform(every, plain))))
    return rows.where("key <> ''").select("key", "geonameid", "name", "lat", "lon", "feature_class", F.coalesce("population", F.lit(0)).cast("bigint").alias("population"), "country", "admin1_code")


class PlaceIndex:
    """Tables of names and their grams in the shared folder."""

    def __init__(self, places: DataFrame) -> None:
        self.names = written(place_names(places))
        keys = self.names.select("key").distinct().withColumn("grams", grams("key"))
        self.grams = written(keys.select("key", F.size("grams").alias("n"), F.explode("grams").alias("gram")).repartition("gram").sortWithinPartitions("gram"))
        self.frequency = written(self.grams.groupBy("gram").agg(F.count("*").alias("df")))

    def keys_like(self, queries: DataFrame) -> DataFrame:
        """query, key and likeness of the names that are equal or near; queries have a column query."""
        asked = queries.select("query").distinct().withColumn("q", plain("query")).where("q <> ''")
        own = asked.withColumn("grams", grams("q"))
        ranked = own.select("query", "q", F.size("grams").alias("a"), "grams", F.explode("grams").alias("gram")).join(self.frequency, "gram", "left")
        rare = ranked.groupBy("query", "q", "a").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("by_rarity"), F.first("grams").alias("grams"))
        needed = F.ceil(F.col("a") * F.lit(LEAST / (2 - LEAST)) - 1e-9)
        prefix = rare.withColumn("gram", F.explode(F.slice("by_rarity", F.lit(1), (F.col("a") - needed + 1).cast("int")))).select("query", "q", "a", "grams", "gram.gram")
        candidates = prefix.join(self.grams.select("gram", "key", "n"), "gram").select("query", "q", "a", "grams", "key", "n").distinct()
        common = F.size(F.array_intersect("grams", grams("key")))
        return candidates.withColumn("likeness", F.when(F.col("q") == F.col("key"), 2.0).otherwise(2.0 * common / (F.col("a") + F.col("n")))).where(F.col("likeness") >= LEAST).select("query", "key", "likeness")

    def best_of_keys(self, keys: DataFrame, limit: int) -> DataFrame:
        """Names of the first `limit` places of each key, in parts first: who comes after that many of an equal name comes after them in any query."""
        parts = max(1, -(-self.names.count() // TASK_NAMES))
        own = self.names.join(keys, "key", "left_semi")
        order = Window.partitionBy("key").orderBy(_kind(), F.desc("population"), "geonameid")
        dealt = own.repartition(parts, "geonameid") if parts > 1 else own
        return dealt.withColumn("_rn", F.dense_rank().over(order)).where(F.col("_rn") <= limit).drop("_rn")

    def lookup(self, queries: DataFrame, limit: int = 5) -> DataFrame:
        """query, place (1, 2, ...), geonameid, name, country, likeness (2 for equal names), south, north, west and east of the best places of each query."""
        keys = written(self.keys_like(queries))
        found = keys.join(self.best_of_keys(keys.select("key").distinct(), limit), "key")
        best = found.groupBy("query", "geonameid").agg(F.max(F.struct("likeness", "name", "lat", "lon", "feature_class", "population", "country", "admin1_code")).alias("p")).select("query", "geonameid", "p.*")
        top = written(top_per_group(best, ["query"], [F.desc("likeness"), _kind(), F.desc("population"), F.col("geonameid")], limit, "place"))
        return self.boxed(top).select("query", "place", "geonameid", "name", "country", "likeness", "south", "north", "west", "east")

    def boxed(self, rows: DataFrame) -> DataFrame:
        """South, north, west and east of places (feature_class, country, admin1_code, lat, lon, population)."""
        inside = self.names.where("feature_class <> 'A'").join(F.broadcast(rows.where("feature_class = 'A'").select("country", "admin1_code").distinct()), ["country", "admin1_code"])  # of places looked up
        extent = inside.groupBy("country", "admin1_code").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
        half = F.greatest(F.lit(0.01), F.least(F.lit(0.25), 0.01 * F.sqrt(F.col("population") / 10000.0)))
        joined = rows.join(extent, ["country", "admin1_code"], "left")
        area = (F.col("feature_class") == "A") & F.col("s").isNotNull()
        side = lambda own, at, sign: F.when(area, F.col(own)).otherwise(F.col(at) + sign * half)
        return joined.withColumns({"south": side("s", "lat", -1), "north": side("n", "lat", 1), "west": side("w", "lon", -1), "east": side("e", "lon", 1)})

    def region(self, name: str) -> tuple[float, float, float, float] | None:
        """The box (south, north, west, east) of a name, by its variants if it is no area itself; for `filters.in_box`."""
        variants = [name, *(f"{name} {s}" for s in SUFFIXES)]
        asked = self.names.sparkSession.createDataFrame([(v,) for v in variants], "query string")
        found = {r["query"]: r for r in self.lookup(asked, 1).collect()}  # a row for each variant
        boxes = [(v, tuple(found[v][c] for c in ("south", "north", "west", "east"))) for v in variants if v in found]
        return parse.region(boxes)


def likeness(a: str, b: str) -> float:
    """Dice over the grams of two plain names; for tests and single pairs."""
    cut = lambda s: {s[i : i + GRAM] for i in range(max(1, len(s) - GRAM + 1))}
    x, y = cut(f"^{a}$"), cut(f"^{b}$")
    return 2.0 if a == b else 2 * len(x & y) / (len(x) + len(y))
