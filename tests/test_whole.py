"""Queries over all rows against DuckDB without any subset of ids."""

import math

import pytest
from pyspark.sql import functions as F

from palimpsest import model
from palimpsest.plans import registry
from test_entry import duck, norm  # noqa: F401


def rows(df):
    return sorted(tuple(norm(v) for v in r) for r in df.collect())


def told(duck, ctes, sql):  # noqa: F811
    return sorted(tuple(norm(v) for v in r) for r in duck.execute(f"{model.SQL}{', ' + ctes if ctes else ''}\n{sql}").fetchall())


def test_similar_pairs_are_joined_over_all_vectors(spark, duck, sf):  # noqa: F811
    ctes = """types AS (SELECT src, list_distinct(list(rel_type)) AS t FROM edges GROUP BY 1),
    close AS (SELECT x.concept_id AS a, y.concept_id AS b, max(round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6)) AS similarity
              FROM vectors x JOIN vectors y ON x.concept_id <> y.concept_id GROUP BY 1, 2 HAVING similarity > 0.9),
    j AS (SELECT a, b, similarity, coalesce(x.t, []) AS ta, coalesce(y.t, []) AS tb FROM close LEFT JOIN types x ON x.src = a LEFT JOIN types y ON y.src = b),
    k AS (SELECT *, CASE WHEN len(list_distinct(list_concat(ta, tb))) = 0 THEN 1.0 ELSE len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))) END AS jaccard FROM j)"""
    got = rows(registry.QUERIES["similar_pairs_jaccard"](spark, sf).select("a", "b", "similarity", "jaccard"))
    assert got == told(duck, ctes, "SELECT a, b, similarity, round(jaccard, 6) FROM k WHERE jaccard >= 0.3")
    duck.execute(registry.ORACLES["similar_pairs_jaccard"])
    some = {tuple(norm(v) for v in r) for r in duck.fetchall()}
    assert some == set(got)


def test_similar_pairs_in_many_blocks_with_copies(spark):
    import numpy as np

    from palimpsest.operators import search

    e = np.random.default_rng(3).standard_normal((60, 3)).astype(np.float32)
    e[40:50] = e[:10]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "vec_id bigint, embedding array<float>")
    u = e.astype(float) / np.linalg.norm(e.astype(float), axis=1, keepdims=True)
    rep = [min(j for j in range(60) if (e[j] == e[i]).all()) for i in range(60)]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if rep[i] == i and rep[j] == j and round(float(u[i] @ u[j]), 6) > 0.9}
    got = [(r.rep_a, r.rep_b) for r in search.similar_pairs(v, 0.9, block_rows=16).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.vec_id: r.rep for r in search.copies(v).collect()} == dict(enumerate(rep))


def test_links_are_proposed_for_orphans_alone(spark):
    from palimpsest.operators import audit

    none = ("cast(null AS timestamp) AS invalid_at", "cast(null AS timestamp) AS expired_at")
    names = [(1, "a", "n"), (2, "a", "n"), (3, "b", "n"), (4, "c", "n"), (5, "d", "n"), (6, "e", "m"), (7, "f", "m"), (8, "g", "k"), (9, "h", "n")]
    c = spark.createDataFrame(names, "concept_id bigint, name string, namespace string").selectExpr("*", *none)
    c = c.withColumn("invalid_at", F.when(F.col("concept_id") == 9, F.current_timestamp()))
    e = spark.createDataFrame([(i, "R", j) for i, j in ((2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (9, 2))], "src bigint, rel_type string, dst bigint")
    # 1: own name, copies and an ended concept are nearer than what is proposed; 8: nothing in its namespace
    at = [(10, 1, 0), (20, 2, 1), (31, 3, 5), (32, 3, 5), (33, 3, 4), (40, 4, 9), (50, 5, 12), (60, 6, 2), (70, 7, 20), (80, 8, 21), (90, 9, 1)]
    at = [(v, i, [math.cos(math.radians(d)), math.sin(math.radians(d))]) for v, i, d in at]
    v = spark.createDataFrame(at, "vec_id bigint, concept_id bigint, embedding array<float>")
    got = sorted((r.src, r.dst, r.score) for r in audit.enrich(c, e, v, 2, 0.82, "r").collect())
    score = lambda d: round((1 + round(math.cos(math.radians(d)), 6)) / 2, 6)
    assert [(a, b) for a, b, _ in got] == [(1, 3), (1, 4), (8, 7)]
    assert [s for _, _, s in got] == pytest.approx([score(4), score(9), score(1)], abs=2e-6)


def test_every_live_orphan_is_asked_for(spark, sf):
    c, e = model.concepts(spark, sf), model.edges(spark, sf)
    lone = {r.concept_id for r in c.where("invalid_at is null and expired_at is null").join(e.select(F.explode(F.array("src", "dst")).alias("concept_id")), "concept_id", "left_anti").collect()}
    assert {r.src for r in registry.QUERIES["knn_enrich"](spark, sf).collect()} <= lone


def test_links_of_all_concepts(spark, duck, sf):  # noqa: F811
    got = rows(registry.QUERIES["reverse_hop"](spark, sf).select("concept_id", "from_id", "rel_type"))
    assert got == told(duck, "", "SELECT dst, src, rel_type FROM edges")
    got = rows(registry.QUERIES["neighbour_suggestions"](spark, sf).select("concept_id", "suggestion"))
    linked = "SELECT src, dst FROM edges WHERE rel_type IN ('USES', 'PART_OF') UNION SELECT dst, src FROM edges WHERE rel_type IN ('USES', 'PART_OF')"
    assert got == told(duck, "", f"SELECT DISTINCT e.src, b.name FROM ({linked}) e JOIN concepts b ON b.concept_id = e.dst")


def test_duplicates_are_compared_with_all_of_their_name(spark):
    from palimpsest.operators import audit

    at = [(1, 1, "x", 0), (2, 1, "x", 90), (3, 2, "x", 120), (4, 1, "x", 150), (5, 3, "x", 250), (6, 1, "y", 90), (7, 1, None, 0), (8, 4, "z", 0), (9, 5, "z", 10)]
    v = spark.createDataFrame([(i, c, n, [math.cos(math.radians(d)), math.sin(math.radians(d))]) for i, c, n, d in at], "vec_id bigint, concept_id bigint, name string, embedding array<float>")
    tell = lambda *chosen: sorted((r.vec_a, r.vec_b, r.decision, r.links) for r in audit.same_name_pairs(v, 0.7, spark.createDataFrame([(c,) for c in chosen], "concept_id bigint"), 3).collect())
    assert tell() == [(1, 2, "hold", 1), (1, 5, "hold", 0), (2, 3, "merge", 2), (2, 4, "merge", 1), (8, 9, "merge", 1)]
    assert tell(2, 5) == [(3, 1, "hold", 0), (3, 2, "merge", 1), (3, 4, "merge", 1), (3, 5, "hold", 0), (9, 8, "merge", 1)]
