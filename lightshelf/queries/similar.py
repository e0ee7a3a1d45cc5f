"""Vector search, radius graphs, clusters, merge suggestions and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightshelf.functions import vectors as V
from lightshelf.operators import people, ranking, similar, upkeep
from lightshelf.operators.inspection import inspected, own_distances, reference_dedupe, sub_clusters
from lightshelf.operators.timeline import burst_stacks
from lightshelf.queries import Registry, timeline
from lightshelf.sources.library import library, table, with_library

REGISTRY = Registry()
add = REGISTRY.add
E = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) "
DIMS = 64


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


def first_vector(spark, sf, vec_id=0):
    return list(vectors(spark, sf).where(F.col("vec_id") == vec_id).select("embedding").first()[0])


@add("v01_distances", E + "SELECT a.vec_id, round(list_distance(a.e, b.e), 6) AS l2, round(1 - list_cosine_similarity(a.e, b.e), 6) AS cosine, round(list_dot_product(a.e, b.e), 6) AS dot FROM v a, v b WHERE b.vec_id = 3")
def v01(spark, sf):
    q = F.array(*[F.lit(float(x)) for x in first_vector(spark, sf, 3)])
    return vectors(spark, sf).select("vec_id", F.round(V.l2("embedding", q), 6).alias("l2"), F.round(V.cosine_distance("embedding", q), 6).alias("cosine"), F.round(V.dot("embedding", q), 6).alias("dot"))


@add("v02_nearest", E + "SELECT a.vec_id, round(list_distance(a.e, b.e), 6) AS distance FROM v a, v b WHERE b.vec_id = 0 ORDER BY list_distance(a.e, b.e), a.vec_id LIMIT 25")
def v02(spark, sf):
    return similar.nearest(vectors(spark, sf), first_vector(spark, sf), 25).select("vec_id", F.round("distance", 6).alias("distance"))


REGISTRY.queries["o03_top_k"], REGISTRY.sql["o03_top_k"] = v02, REGISTRY.sql["v02_nearest"]


def references(spark, sf):
    return vectors(spark, sf).where("vec_id % 25 = 0").select(F.col("vec_id").alias("person_id"), F.col("embedding").alias("ref"))


@add("v03_strict_match", E + "SELECT vec_id, person_id, round(d, 6) AS distance FROM (SELECT a.vec_id, b.vec_id AS person_id, list_distance(a.e, b.e) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rn FROM v a JOIN v b ON b.vec_id % 25 = 0 WHERE a.vec_id % 25 <> 0) WHERE rn = 1 AND d <= 1.25")
def v03(spark, sf):
    found = similar.nearest_reference(vectors(spark, sf).where("vec_id % 25 <> 0").select("vec_id", "embedding"), references(spark, sf), 1.25)
    return found.select("vec_id", "person_id", F.round("distance", 6).alias("distance"))


REGISTRY.queries["j12_nearest_reference_join"], REGISTRY.sql["j12_nearest_reference_join"] = v03, REGISTRY.sql["v03_strict_match"]


@add("n01_diagnose_faces", E + "SELECT a.vec_id AS face_id, b.vec_id % 4 AS person_id, round(min(list_distance(a.e, b.e)), 6) AS distance FROM v a JOIN v b ON b.vec_id % 25 = 0 WHERE a.vec_id % 25 <> 0 GROUP BY 1, 2")
def n01(spark, sf):
    f = vectors(spark, sf).where("vec_id % 25 <> 0").select(F.col("vec_id").alias("face_id"), F.col("embedding").alias("encoding"))
    return people.best_reference(f, references(spark, sf).withColumn("person_id", F.col("person_id") % 4)).select("face_id", "person_id", F.round("distance", 6).alias("distance"))


@add("v12_mistag_audit", E + "SELECT vec_id, round(d, 6) AS distance FROM (SELECT a.vec_id, min(list_distance(a.e, b.e)) AS d FROM v a JOIN v b ON a.label = b.label AND b.vec_id % 10 = 0 WHERE a.vec_id % 10 <> 0 GROUP BY 1) WHERE d > 1.3")
def v12(spark, sf):
    own = vectors(spark, sf)
    refs = own.where("vec_id % 10 = 0").select("label", F.col("embedding").alias("ref"))
    d = own_distances(own.where("vec_id % 10 <> 0"), refs, "label", "vec_id", "embedding").groupBy(F.col("id").alias("vec_id")).agg(F.min("distance").alias("distance"))
    return d.where("distance > 1.3D").select("vec_id", F.round("distance", 6).alias("distance"))


@add("v06_radius_graph", E + "SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.e, b.e), 6) AS distance FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_distance(a.e, b.e) <= 1.15")
def v06(spark, sf):
    return similar.radius_pairs(vectors(spark, sf), 1.15).select("a", "b", F.round("distance", 6).alias("distance"))


_EDGES = "e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_distance(a.e, b.e) <= {r})"


@add("g01_components", E.replace("WITH", "WITH RECURSIVE").rstrip() + ", " + _EDGES.format(r=1.10) + ", r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY 1")
def g01(spark, sf):
    return similar.radius_components(vectors(spark, sf), 1.10).select("node", "component")


_V04 = E.replace("WITH", "WITH RECURSIVE").rstrip() + ", " + _EDGES.format(r=1.15) + ", core AS (SELECT a FROM e GROUP BY a HAVING count(*) + 1 >= 5), ce AS (SELECT a, b FROM e WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)), r AS (SELECT a AS node, a AS seen FROM core UNION SELECT r.node, ce.b FROM r JOIN ce ON ce.a = r.seen), cc AS (SELECT node, min(seen) AS cluster FROM r GROUP BY 1), bb AS (SELECT e.a AS node, min(cluster) AS cluster FROM e JOIN cc ON cc.node = e.b WHERE e.a NOT IN (SELECT a FROM core) GROUP BY 1) SELECT v.vec_id AS id, coalesce(cc.cluster, bb.cluster) AS cluster FROM v LEFT JOIN cc ON cc.node = v.vec_id LEFT JOIN bb ON bb.node = v.vec_id"


@add("v04_dbscan", _V04)
def v04(spark, sf):
    p = vectors(spark, sf)
    return similar.density_clusters(p, 1.15, 5).select("id", "cluster")


@add("v05_cluster_split", _V04.replace("<= 1.15", "<= 1.2").replace("+ 1 >= 5", "+ 1 >= 2").replace("FROM embeddings)", "FROM embeddings WHERE label = 3)"))
def v05(spark, sf):
    p = vectors(spark, sf).where("label = 3")
    return similar.density_clusters(p, 1.2, 2).select("id", "cluster")


_EVERY = _V04.replace("<= 1.15", "<= 1.2").replace("+ 1 >= 5", "+ 1 >= 2").replace("ON a.vec_id <> b.vec_id", "ON a.label = b.label AND a.vec_id <> b.vec_id")


@add("v05_split_every_cluster", _EVERY)
def v05_every(spark, sf):
    """All groups split at once."""
    return similar.density_clusters(vectors(spark, sf), 1.2, 2, by="label").select("id", "cluster")


@add("a21_group_centroids", E.rstrip() + ", m AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v), a AS (SELECT label, i, avg(x) AS x FROM m GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM a GROUP BY 1) SELECT label, CAST(i AS INT) AS place, round(x / n, 5) AS x FROM a JOIN n USING (label)")
def a21(spark, sf):
    c = similar.centroids(vectors(spark, sf), "label", DIMS)
    return c.select("label", F.posexplode("centroid").alias("p", "x")).select("label", (F.col("p") + 1).alias("place"), F.round("x", 5).alias("x"))


@add("v07_running_centroids")
def v07(spark, sf):
    rows = vectors(spark, sf).select("label", F.col("vec_id").alias("id"), "embedding")
    return ranking.grouped(rows, ["label"], lambda g: similar.running_centroids(g, 1.2), "id bigint, cluster bigint")


def scoped(spark, sf):
    return vectors(spark, sf).select(F.col("label").alias("scope"), F.col("vec_id").alias("id"), ((F.col("vec_id") * 7) % 100 / 10.0).cast("double").alias("score"), "embedding")


@add("v08_v09_culling")
def v08(spark, sf):
    return similar.select_best(scoped(spark, sf), ["scope"], 0.2)


@add("n31_review_run")
def n31(spark, sf):
    chosen = similar.select_best(scoped(spark, sf), ["scope"], 0.1)
    stacks = library(spark, sf, "photos").where("stack_id is not null").select("id", "stack_id")
    return chosen.join(stacks, "id", "left").select("id", "cluster", "rank_in_cluster", "selected", "stack_id")


@add("v10_merge_suggestions", E.rstrip() + ", c AS (SELECT label, list(x / n ORDER BY i) AS c FROM (SELECT label, i, x, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id * 37 % 101 DESC, vec_id) AS rn FROM v) WHERE rn <= 60)) GROUP BY 1, 2)) GROUP BY label), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id * 37 % 101 DESC, vec_id) AS rn FROM v) WHERE rn <= 60) SELECT x.label AS left_group, y.label AS right_group, round(min(list_distance(a.e, b.e)), 6) AS least, CAST(sum(CASE WHEN list_distance(a.e, b.e) < 1.1 THEN 1 ELSE 0 END) AS BIGINT) AS copies FROM c x JOIN c y ON x.label < y.label AND list_distance(x.c, y.c) <= 1.2 JOIN o a ON a.label = x.label JOIN o b ON b.label = y.label GROUP BY 1, 2 HAVING min(list_distance(a.e, b.e)) <= 1.2")
def v10(spark, sf):
    found = similar.merge_suggestions(vectors(spark, sf).withColumn("area", F.col("vec_id") * 37 % 101), "label", DIMS, 1.2, 1.2, 1.1, area="area")
    return found.select("left_group", "right_group", F.round("least", 6).alias("least"), "copies")


REGISTRY.queries["j13_two_stage_similarity_join"], REGISTRY.sql["j13_two_stage_similarity_join"] = v10, REGISTRY.sql["v10_merge_suggestions"]


@add("v11_distance_to_core", E + "SELECT label, round(quantile_cont(d, 0.5), 6) AS median, round(max(d), 6) AS most FROM (SELECT a.label, a.vec_id, min(list_distance(a.e, b.e)) AS d FROM v a JOIN v b ON a.label = b.label AND b.vec_id % 10 = 0 WHERE a.vec_id % 10 <> 0 GROUP BY 1, 2) GROUP BY 1")
def v11(spark, sf):
    own = vectors(spark, sf)
    refs = own.where("vec_id % 10 = 0").select("label", F.col("embedding").alias("ref"))
    d = own_distances(own.where("vec_id % 10 <> 0"), refs, "label", "vec_id", "embedding").groupBy("label", "id").agg(F.min("distance").alias("d"))
    return d.groupBy("label").agg(F.round(F.expr("percentile(d, 0.5)"), 6).alias("median"), F.round(F.max("d"), 6).alias("most"))


def _inspect_sql(radius: float, min_samples: int, most: int) -> str:
    """Density clusters of each label, its references and the least distance to them, as DuckDB tables v, d, refs, dist."""
    clusters = _V04.replace("<= 1.15", f"<= {radius}").replace("+ 1 >= 5", f"+ 1 >= {min_samples}").replace("ON a.vec_id <> b.vec_id", "ON a.label = b.label AND a.vec_id <> b.vec_id")
    raw = E.removeprefix("WITH v AS (").rstrip().removesuffix(")")
    unit = f"SELECT vec_id, label, e AS raw, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e, label % 2 = 0 AND vec_id % 5 = 0 AS trusted FROM ({raw})"
    clusters = clusters.replace("v AS (" + raw + ")", f"v AS MATERIALIZED ({unit})")
    head, _, tail = clusters.rpartition(" SELECT v.vec_id AS id")
    return f"""{head}, d AS (SELECT v.vec_id AS id{tail}),
s AS (SELECT label, cluster, count(*) AS n, min(id) AS f FROM d JOIN v ON vec_id = id WHERE cluster IS NOT NULL GROUP BY ALL),
big AS (SELECT label, cluster AS core FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, f) AS rn FROM s) WHERE rn = 1),
t AS (SELECT label, count(*) FILTER (trusted) AS trusted_n FROM v GROUP BY 1),
k AS (SELECT v.label, vec_id, e FROM v JOIN d ON id = vec_id JOIN t USING (label) LEFT JOIN big ON big.label = v.label WHERE CASE WHEN trusted_n >= 3 THEN trusted WHEN core IS NOT NULL THEN coalesce(cluster = core, FALSE) ELSE TRUE END),
m AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM k),
refs AS (SELECT * FROM m WHERE n <= {most} OR list_contains(list_transform(range({most}), lambda i: CASE WHEN i = {most - 1} THEN n ELSE CAST(floor(i * ((n - 1) / {most - 1}.0)) AS BIGINT) + 1 END), rn)),
dist AS (SELECT v.vec_id, min(list_distance(v.e, refs.e)) AS d FROM v JOIN refs USING (label) GROUP BY 1),
c AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY label, raw) AS first, count(*) OVER (PARTITION BY label, raw) AS n FROM v)
"""


def inspection(spark, sf):
    faces = vectors(spark, sf).select("label", "vec_id", "embedding", ((F.col("label") % 2 == 0) & (F.col("vec_id") % 5 == 0)).alias("trusted"))
    return inspected(faces, "label", 1.2, 3, "vec_id", most_references=7)


@add("v11_inspected_groups", _inspect_sql(1.2, 3, 7) + "SELECT v.vec_id, cluster AS sub_id, round(dist.d, 5) AS distance, CASE WHEN c.n > 1 THEN c.first END AS copy_of FROM v JOIN d ON id = v.vec_id LEFT JOIN dist ON dist.vec_id = v.vec_id JOIN c ON c.vec_id = v.vec_id")
def v11_faces(spark, sf):
    return inspection(spark, sf).select("vec_id", "sub_id", F.round("distance", 5).alias("distance"), "copy_of")


@add("v11_sub_clusters", _inspect_sql(1.2, 3, 7) + "SELECT label, cluster AS sub_id, count(*) AS size, arg_max(v.vec_id, v.vec_id * 7 % 97 * 100000 - v.vec_id) AS largest_id, round(quantile_cont(dist.d, 0.5), 5) AS median_distance, round(max(dist.d), 5) AS most_distance FROM v JOIN d ON id = v.vec_id LEFT JOIN dist ON dist.vec_id = v.vec_id GROUP BY 1, 2")
def v11_sub(spark, sf):
    areas = vectors(spark, sf).select("vec_id", (F.col("vec_id") * 7 % 97).cast("double").alias("area"))
    found = sub_clusters(inspection(spark, sf), areas, "label", "vec_id")
    return found.select("label", "sub_id", "size", "largest_id", F.round("median_distance", 5).alias("median_distance"), F.round("most_distance", 5).alias("most_distance"))


@add("v13_reference_dedupe", "SELECT l_orderkey AS photo_id, l_suppkey AS person_id, CASE WHEN count(CASE WHEN l_returnflag = 'N' THEN NULL ELSE 1 END) = 1 THEN 'source' WHEN count(CASE WHEN l_returnflag = 'N' THEN NULL ELSE 1 END) = 0 THEN 'gap' ELSE 'manual' END AS rule, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v13(spark, sf):
    f = table(spark, sf, "lineitem")
    trusted = F.count(F.when(F.col("l_returnflag") != "N", 1))
    rule = F.when(trusted == 1, "source").when(trusted == 0, "gap").otherwise("manual")
    return f.groupBy(F.col("l_orderkey").alias("photo_id"), F.col("l_suppkey").alias("person_id")).agg(rule.alias("rule"), F.count("*").alias("n")).where("n > 1")


_TWICE = """, f AS (SELECT vec_id AS face_id, vec_id // 6 AS photo_id, vec_id % 2 AS person_id, vec_id % 5 = 0 AS sure, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
d AS (SELECT f.face_id, f.photo_id, f.person_id, f.sure, min(list_distance(f.e, r.e)) AS d FROM f JOIN f r ON r.person_id = f.person_id AND r.face_id % 25 = 1 - r.person_id GROUP BY ALL),
g AS (SELECT *, row_number() OVER w AS rn, lead(d) OVER w - d AS gap, count(*) OVER (PARTITION BY photo_id, person_id) AS n, sum(sure::INT) OVER (PARTITION BY photo_id, person_id) AS trusted FROM d WINDOW w AS (PARTITION BY photo_id, person_id ORDER BY d, face_id)),
h AS (SELECT *, max(CASE WHEN rn = 1 THEN gap END) OVER (PARTITION BY photo_id, person_id) AS between_ FROM g WHERE n > 1),
k AS (SELECT *, CASE WHEN trusted = 1 THEN 'source' WHEN trusted > 1 THEN 'review' WHEN between_ > 0.1 THEN 'distance' ELSE 'ambiguous' END AS rule FROM h)
SELECT face_id, photo_id, person_id, rule, CASE WHEN rule = 'distance' THEN round(between_, 6) END AS gap, CASE rule WHEN 'source' THEN sure WHEN 'distance' THEN rn = 1 ELSE TRUE END AS keep FROM k"""


@add("v13_reference_rules", E.rstrip() + _TWICE)
def v13_rules(spark, sf):
    """Faces of one person in a photo, six vectors a photo: which stay, by source or by distance to references."""
    rows = vectors(spark, sf).select(F.col("vec_id").alias("face_id"), F.floor(F.col("vec_id") / 6).alias("photo_id"), (F.col("vec_id") % 2).alias("person_id"), F.when(F.col("vec_id") % 5 == 0, "strict").otherwise("temporal").alias("match_source"), "embedding")
    refs = rows.where(F.col("face_id") % 25 == 1 - F.col("person_id")).select("person_id", F.col("embedding").alias("ref"))
    found = reference_dedupe(rows, refs, 0.1)
    return found.select("face_id", "photo_id", "person_id", "rule", F.round("gap", 6).alias("gap"), "keep")


_CELLS = "c AS (SELECT vec_id * 2 AS cell_id, vec_id AS photo_id, CAST(10 + vec_id % 3 * 5 AS DOUBLE) AS w, CAST(8 + vec_id % 5 AS DOUBLE) AS h FROM embeddings WHERE vec_id % 20 = 0)"
_NEAR = "n AS (SELECT a.vec_id AS photo_id, b.vec_id AS id, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_distance(a.e, b.e) <= 1.25)"
_ALIKE = "SELECT 1 FROM n d WHERE d.id = n.id AND d.distance < 1.15 AND d.photo_id <> n.photo_id AND d.photo_id IN (SELECT photo_id FROM c)"


@add("v14_sharper_alternatives", with_library("photos").rstrip() + ", " + E.removeprefix("WITH ").rstrip() + f", {_CELLS}, {_NEAR}, k AS (SELECT cell_id, n.id, distance, least(p.image_width / c.w, p.image_height / c.h) AS ppi FROM n JOIN c USING (photo_id) JOIN photos p ON p.id = n.id LEFT JOIN photos o ON o.id = n.photo_id WHERE n.id NOT IN (SELECT photo_id FROM c) AND (o.taken_ts IS NULL OR abs(epoch_us(p.taken_ts) - epoch_us(o.taken_ts)) <= 3 * CAST(86400000000 AS BIGINT)) AND NOT EXISTS ({_ALIKE})) SELECT cell_id, id, round(distance, 6) AS distance, round(ppi, 3) AS ppi, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY distance, id) AS INT) AS place FROM k WHERE ppi >= 260) WHERE place <= 3")
def v14(spark, sf):
    own = vectors(spark, sf)
    cells = own.where("vec_id % 20 = 0").select((F.col("vec_id") * 2).alias("cell_id"), F.col("vec_id").alias("photo_id"), (10 + F.col("vec_id") % 3 * 5).cast("double").alias("w"), (8 + F.col("vec_id") % 5).cast("double").alias("h"))
    found = similar.sharper_alternatives(cells, library(spark, sf, "photos"), own, 1.25, 260.0, 3.0, 1.15, 3)
    return found.select("cell_id", "id", F.round("distance", 6).alias("distance"), F.round("ppi", 3).alias("ppi"), "place")


_TIMED = f"WITH RECURSIVE d AS ({_V04}), v AS (SELECT event_id AS id, ts AS taken_ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS score, CAST(embedding AS DOUBLE[]) AS e FROM events JOIN embeddings ON vec_id = event_id JOIN d ON d.id = event_id AND d.cluster IS NULL)"


@add("v04_noise_sessions", timeline.stacks_sql(_TIMED, 36000, 1.25, 72000))
def v04_noise(spark, sf):
    """Noise of the density clusters, stacked by sessions."""
    p = vectors(spark, sf)
    noise = similar.density_clusters(p, 1.15, 5).where("cluster is null").select("id")
    timed = library(spark, sf, "photos").select("id", "taken_ts", "score").join(noise, "id").join(p.select(F.col("vec_id").alias("id"), "embedding"), "id")
    return burst_stacks(timed, 36000.0, 1.25, 72000.0, cosine=False)


@add("v15_term_scores", E + "SELECT a.vec_id, b.vec_id AS term, round(list_dot_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON b.vec_id IN (a.label, a.label + 10) WHERE a.vec_id >= 20")
def v15(spark, sf):
    own = vectors(spark, sf)
    terms = own.where("vec_id < 20").select(F.col("vec_id").alias("term"), F.col("embedding").alias("t"))
    asked = own.where("vec_id >= 20").select("vec_id", "embedding", F.explode(F.array(F.col("label").cast("bigint"), (F.col("label") + 10).cast("bigint"))).alias("term"))
    return asked.join(terms, "term").select("vec_id", "term", F.round(V.dot("embedding", "t"), 6).alias("score"))


@add("n34_verification_decision", E.rstrip() + ", s AS (SELECT a.vec_id, a.label, list_dot_product(a.e, b.e) AS score FROM v a JOIN v b ON b.vec_id = a.label), m AS (SELECT label, quantile_cont(score, 0.5) AS med FROM s GROUP BY 1) SELECT vec_id, CASE WHEN vec_id % 3 = 0 AND score < med THEN 'fail' ELSE 'pass' END AS decision FROM s JOIN m USING (label)")
def n34(spark, sf):
    own = vectors(spark, sf)
    terms = own.where("vec_id < 10").select(F.col("vec_id").alias("label"), F.col("embedding").alias("t"))
    s = own.withColumn("label", F.col("label").cast("bigint")).join(terms, "label").select("vec_id", "label", V.dot("embedding", "t").alias("score"))
    m = s.groupBy("label").agg(F.expr("percentile(score, 0.5)").alias("med"))
    return s.join(m, "label").select("vec_id", F.when((F.col("vec_id") % 3 == 0) & (F.col("score") < F.col("med")), "fail").otherwise("pass").alias("decision"))


@add("t09_identity_in_time", E.rstrip() + ", d AS (SELECT a.vec_id AS face_id, b.vec_id % 4 AS person_id, min(list_distance(a.e, b.e)) AS d FROM v a JOIN v b ON b.vec_id % 25 = 0 WHERE a.vec_id % 25 <> 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY d, person_id) AS rn, lead(d) OVER (PARTITION BY face_id ORDER BY d, person_id) AS second FROM d), c AS (SELECT face_id, person_id FROM r WHERE rn = 1 AND d <= 1.3 AND (second IS NULL OR second - d >= 0.02)), p AS (SELECT event_id AS face_id, ts FROM events) SELECT face_id, person_id FROM c LEFT JOIN p USING (face_id) WHERE p.ts IS NULL OR person_id NOT IN (SELECT user_id FROM events) OR EXISTS (SELECT 1 FROM events s WHERE s.user_id = c.person_id AND abs(epoch_us(s.ts) - epoch_us(p.ts)) <= 7200000000)")
def t09(spark, sf):
    own = vectors(spark, sf)
    f = own.where("vec_id % 25 <> 0").select(F.col("vec_id").alias("face_id"), F.col("embedding").alias("encoding"))
    d = people.best_reference(f, references(spark, sf).withColumn("person_id", F.col("person_id") % 4)).select("face_id", "person_id", "distance")
    e = table(spark, sf, "events")
    timed = e.select(F.col("event_id").alias("face_id"), F.col("ts").alias("taken_ts"))
    seen = e.select(F.col("user_id").alias("person_id"), F.col("ts").alias("taken_ts"))
    return people.match_in_time(d, timed, seen, 1.3, 0.02, 120.0).select("face_id", "person_id")


_HASH_EDGES = with_library("texts").replace("WITH", "WITH RECURSIVE").rstrip() + ", e AS (SELECT x.id AS a, y.id AS b FROM texts x JOIN texts y ON x.id <> y.id AND x.file_hash = y.file_hash), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen), c AS (SELECT node AS id, min(seen) AS component FROM r GROUP BY 1) "


@add("g02_duplicate_plan", _HASH_EDGES + "SELECT component, id, rn = 1 AS keep, n FROM (SELECT component, id, row_number() OVER (PARTITION BY component ORDER BY id % 3 DESC, id % 5 DESC, id) AS rn, count(*) OVER (PARTITION BY component) AS n FROM c)")
def g02(spark, sf):
    t = library(spark, sf, "texts").select("id", "file_hash")
    first = t.groupBy("file_hash").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    edges = t.join(first, "file_hash").select(F.col("id").alias("a"), "b")
    c = similar.connected(edges).withColumnRenamed("node", "id")
    return upkeep.duplicate_plan(c.withColumn("named_faces", F.col("id") % 3).withColumn("faces", F.col("id") % 5).withColumn("has_description", F.lit(1)))


@add("g03_canonical_paths", with_library("photos") + "SELECT file_hash, id, rn = 1 AS keep FROM (SELECT file_hash, id, row_number() OVER (PARTITION BY file_hash ORDER BY CASE WHEN regexp_matches(filename, '(\\(\\d+\\)|-\\d{3,})\\.[^.]+$') THEN 1 ELSE 0 END, length(filename), filename, length(filepath), filepath, id) AS rn, count(*) OVER (PARTITION BY file_hash) AS n FROM photos WHERE file_hash IS NOT NULL) WHERE n > 1")
def g03(spark, sf):
    return upkeep.canonical_paths(library(spark, sf, "photos")).select("file_hash", "id", "keep")


@add("o08_similarity_chain")
def o08(spark, sf):
    c = similar.centroids(vectors(spark, sf), "label", DIMS)
    return similar.similarity_chain(c.select(F.lit(0).alias("scope"), F.col("label").alias("id"), "n", "centroid"), ["scope"])
