"""Unit vectors of kernels and graph patterns on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalars, temporal
from palimpsest.operators import graph, search, sessions, writes


def ranked(spark, names, space="g"):
    return spark.createDataFrame([(n, space, i + 1) for i, n in enumerate(names)] or [("", "", 0)], "name string, namespace string, rank int").where("rank > 0")


def fused(spark, a, b, query="zzz"):
    return {r.name: round(r.similarity, 6) for r in search.fuse(ranked(spark, a), ranked(spark, b), query).collect()}


def test_rank_fusion_scale(spark):
    got = fused(spark, ["both", "kw"], ["both", "vec"])
    assert got["both"] == 1.0 and max(got.values()) <= 1.0
    assert fused(spark, ["kw"], []) == {"kw": 0.4} and fused(spark, [], ["vec"]) == {"vec": 0.6}
    assert fused(spark, ["x", "Exact Name"], [], " exact name ")["Exact Name"] == 1.0


def test_cosine_and_scale(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [-1.0, -1.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [round(r[0], 6) for r in df.select(scalars.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0]
    assert spark.range(1).select(scalars.index_score(F.lit(0.7))).first()[0] == pytest.approx(0.85)


@pytest.mark.parametrize(("name", "ok"), [("USES", True), ("_a9", True), ("a" * 64, True), ("a" * 65, False), ("", False), ("9a", False), ("A-B", False), ("a b", False), ("a]->(b", False)])
def test_relation_names(spark, name, ok):
    assert spark.createDataFrame([(name,)], "c string").select(scalars.relation_name(F.col("c"))).first()[0] is ok


@pytest.mark.parametrize(("text", "ok"), [("short", False), ("elevenchars", True), ("tenletters", False), ("a b", True), ("a-b", True), ("a_b", True), ("", False)])
def test_semantic_gate(spark, text, ok):
    assert spark.createDataFrame([(text,)], "c string").select(scalars.is_semantic(F.col("c"))).first()[0] is ok


@pytest.mark.parametrize(("k", "want"), [(1, (0.0, 0.5, 0.0)), (2, (1.0, 0.5, 0.5)), (4, (1.0, 0.5, 0.5))])
def test_ranked_metrics(spark, k, want):
    r = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abcd")], "query_id string, item string, rank int")
    e = spark.createDataFrame([("q", "b"), ("q", "d"), ("q", "b")], "query_id string, item string")
    m = search.ranked_metrics(r, e, k).first()
    assert (m.recall, m.reciprocal_rank, m.precision) == want


def test_bm25_weights_fields_and_phrases(spark):
    docs = spark.createDataFrame([(1, "red fox", "runs"), (2, "blue", "a red thing and a fox"), (3, None, ""), (4, "driftwood's log", "red")], "id int, name string, description string")
    got = {r.id: r.score for r in search.bm25(docs, {"name": 3.0, "description": 1.0}, "red fox").collect()}
    assert set(got) == {1, 2, 4} and got[1] > got[2] > 0
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    one = search.bm25(docs, {"name": 1.0}, "driftwood's").first()
    assert one.id == 4 and one.score == pytest.approx(idf / (1 + 1.2 * (0.25 + 0.75 * 2 / (5 / 3))))
    assert search.bm25(docs, {"name": 1.0}, "driftwood").count() == 0 and search.bm25(docs, {"name": 1.0}, " ").count() == 0


def test_bm25_on_an_empty_table(spark):
    assert search.bm25(spark.createDataFrame([], "id int, name string"), {"name": 1.0}, "red fox").count() == 0


def test_walk_returns_to_its_start_and_obeys_denials(spark):
    e = spark.createDataFrame([(1, "R", 2), (2, "R", 1), (2, "R", 3), (3, "SUPERSEDES", 4), (3, "R", 5)], "src int, rel_type string, dst int")
    s = spark.createDataFrame([(1,)], "start int")
    assert {(r.dst, r.hops) for r in graph.walk(e, s, 3).collect()} == {(2, 1), (1, 2), (3, 2), (5, 3)}
    assert {r.dst for r in graph.walk(e, s, 3, keep=F.col("dst") > 2).collect()} == {3, 5}
    assert {(r.node, r.depth) for r in graph.chain(e, spark.createDataFrame([(3,)], "start int"), "SUPERSEDES").collect()} == {(3, 0), (4, 1)}


def test_undirected_loop_once_and_orphans(spark):
    e = spark.createDataFrame([(1, "R", 1), (1, "R", 2)], "src int, rel_type string, dst int")
    n = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert graph.undirected(e).count() == 3
    assert [r.k for r in graph.orphans(n, e, "k").collect()] == [3]
    assert {r.k: (r.out_degree, r.in_degree) for r in graph.degrees(n, e, "k").collect()} == {1: (2, 1), 2: (0, 1), 3: (0, 0)}


def test_upsert_keeps_old_text_for_empty_new_text(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "name string, d string, made int")
    new = spark.createDataFrame([("a", "", 2), ("b", "z", 2), ("c", "w", 2)], "name string, d string, made int")
    got = {tuple(r) for r in graph.upsert(old, new, ["name"], ["d"], ["made"]).collect()}
    assert got == {("a", "x", 1), ("b", "z", 1), ("c", "w", 2)}


def test_validity_is_half_open(spark):
    df = spark.sql("SELECT timestamp'2024-01-01' AS valid_at, timestamp'2024-02-01' AS invalid_at, cast(null AS timestamp) AS expired_at")
    ok = lambda t, **k: df.where(temporal.in_force(temporal.moment(t), **k)).count()
    assert [ok("2023-12-31"), ok("2024-01-01"), ok("2024-01-31T23:59:59Z"), ok("2024-02-01"), ok("2024-03-01", include_expired=True)] == [0, 1, 1, 0, 1]
    assert df.where(temporal.not_ended(temporal.moment("2023-01-01"))).count() == 1 and df.where(temporal.never_ended()).count() == 0


def test_supersede_and_invalidate_only_once(spark):
    c = spark.sql("SELECT * FROM VALUES (1L, cast(null AS timestamp), cast(null AS timestamp), cast(null AS string)), (2L, timestamp'2020-01-01', timestamp'2020-01-01', 'old') AS t(concept_id, expired_at, invalid_at, invalidated_by)")
    at = F.lit("2024-01-01").cast("timestamp")
    got = {r.concept_id: r.expired_at.year for r in writes.supersede(c, spark.createDataFrame([(9, 1), (9, 2)], "new bigint, old bigint"), at).collect()}
    assert got == {1: 2024, 2: 2020}
    got = {r.concept_id: (r.invalid_at.year, r.invalidated_by) for r in writes.invalidate(c, spark.createDataFrame([(1, "x"), (2, "x")], "concept_id bigint, cause string"), at).collect()}
    assert got == {1: (2024, "x"), 2: (2020, "old")}


@pytest.mark.parametrize(("text", "want"), [("One. Two three four five", "One."), ("one\ntwo three four five", "one"), ("x" * 30, "x" * 20), ("short", "short")])
def test_truncation(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(scalars.truncate_sentence(F.col("c"), 20)).first()[0] == want


def test_html_and_urls(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "c string").select(c(F.col("c"))).first()[0]
    assert one(scalars.html_text, "<p>A &amp; B</p><script>x</script>\n <b>c&nbsp;d</b>") == "A & B c d"
    assert one(scalars.url_kind, "https://docs.google.com/document/d/1") == "gdoc" and one(scalars.url_kind, "http://a/b.md") == "raw" and one(scalars.url_kind, "http://a") == "url"
    assert one(scalars.slug, "  Hello, World! ") == "hello-world"


def test_transcript_lines_skip_what_is_broken(spark):
    raw = ['{"type":"user","uuid":"a","message":{"role":"user","content":"hi"}}', "{broken", "", '{"type":"summary"}']
    got = [tuple(r) for r in sessions.transcript_lines(spark.createDataFrame([(x,) for x in raw], "value string")).select("line_type", "uuid", "content").collect()]
    assert got == [("user", "a", "hi"), ("summary", None, None)]
    assert list(sessions.chunks(iter(["aa", "bb", "cccccc", "d"]), 4)) == [["aa", "bb"], ["cccccc"], ["d"]]
