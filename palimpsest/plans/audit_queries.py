"""Queries of reports and audits, of the walk cascade, and of node tables taken together."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import scalars, temporal
from ..operators import audit, graph, search
from ..scratch import Scratch
from . import search_queries, write_queries
from ._register import Registry
from .graph_queries import AT, NOW
from .search_queries import _KNN, _TEXT, ASKED

q = Registry(model.SQL)
_LIVE = "live AS (SELECT * FROM concepts WHERE invalid_at IS NULL AND expired_at IS NULL), ll AS (SELECT src, rel_type, dst FROM edges WHERE src IN (SELECT concept_id FROM live) AND dst IN (SELECT concept_id FROM live))"


def _at(text: str = AT):
    return F.lit(text).cast("timestamp")


# -- node tables together ------------------------------------------------------------------
_NODES = "nodes AS (SELECT 'Concept' AS label, concept_id::VARCHAR AS id, name FROM concepts UNION ALL SELECT 'Patch', patch_id::VARCHAR, name FROM patches UNION ALL SELECT 'Meeting', meeting_id::VARCHAR, title FROM meetings UNION ALL SELECT 'Turn', uuid, line_type FROM turns UNION ALL SELECT 'Session', session_id, NULL FROM (SELECT DISTINCT session_id FROM session_lines))"


def nodes(spark, sf):
    """label, id, name of the nodes of all kinds."""
    one = lambda df, label, key, name: df.select(F.lit(label).alias("label"), F.col(key).cast("string").alias("id"), name.alias("name"))
    parts = [
        one(model.concepts(spark, sf), "Concept", "concept_id", F.col("name")), one(model.patches(spark, sf), "Patch", "patch_id", F.col("name")),
        one(model.table(spark, sf, "meetings"), "Meeting", "meeting_id", F.col("title")), one(model.turns(spark, sf), "Turn", "uuid", F.col("line_type")),
        one(model.table(spark, sf, "session_lines").select("session_id").distinct(), "Session", "session_id", F.lit(None).cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@q("SELECT label, count(*) AS n, count(name) AS named FROM nodes GROUP BY 1", more=_NODES)
def all_nodes(spark, sf):
    return nodes(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.count("name").alias("named"))


@q("SELECT label, id, name FROM nodes WHERE label IN ('Concept', 'Patch') AND contains(lower(name), '7')", more=_NODES)
def label_choice(spark, sf):
    return nodes(spark, sf).where(F.col("label").isin("Concept", "Patch") & F.contains(F.lower("name"), F.lit("7")))


@q("SELECT unnest(['catalog_events', 'catalog_topics']) AS name", plain=True)
def catalog(spark, sf):
    """Tables that a session knows."""
    for t in ("events", "topics"):
        model.table(spark, sf, t).createOrReplaceTempView(f"catalog_{t}")
    return spark.createDataFrame([(t.name,) for t in spark.catalog.listTables() if t.name.startswith("catalog_")], "name string")


@q("SELECT concept_id, name FROM concepts WHERE namespace IS NULL OR namespace IN ('global', 'intake')")
def null_tolerant_namespace(spark, sf):
    return model.concepts(spark, sf).where(temporal.in_namespaces(["global", "intake"], null_is_global=True)).select("concept_id", "name")


@q("SELECT 'all' AS choice, count(*) AS n FROM concepts UNION ALL SELECT 'some', count(*) FROM concepts WHERE namespace IN ('atlas')")
def optional_namespace(spark, sf):
    """The same filter with and without names."""
    c = model.concepts(spark, sf)
    n = lambda names, choice: c.where(temporal.in_namespaces(names)).agg(F.lit(choice).alias("choice"), F.count("*").alias("n"))
    return n([], "all").unionByName(n(["atlas"], "some"))


@q("SELECT concept_id, name FROM concepts WHERE contains(lower(name), 'stale')::INT + contains(lower(name), 'ledger')::INT + contains(lower(name), '1')::INT > 3 // 2")
def term_coverage(spark, sf):
    hits, n = search.covers(F.col("name"), "stale ledger-1")
    return model.concepts(spark, sf).where(hits > n // 2).select("concept_id", "name")


@q("SELECT patch_id, similarity FROM (SELECT p.patch_id, round(max(list_cosine_similarity(v.embedding::DOUBLE[], e)), 6) AS similarity FROM patches p JOIN vectors v ON v.concept_id = p.concept_id, asking GROUP BY 1) WHERE NOT (similarity > 0 AND similarity < 0.3)", more=search_queries._ASK)
def patch_gate(spark, sf):
    """Patches shown: those near the question or not on its side at all."""
    near = _near(spark, sf)
    p = model.patches(spark, sf).join(near, "concept_id").select("patch_id", F.col("similarity"))
    return p.where((F.col("similarity") <= 0) | (F.col("similarity") >= search.HIDDEN))


def _near(spark, sf):
    """concept_id, similarity: the best cosine of a concept's vectors with the question."""
    e = F.array(*[F.lit(float(x)) for x in search_queries._query_vector(spark, sf)])
    v = model.vectors(spark, sf).where("concept_id is not null").select("concept_id", scalars.cosine(F.col("embedding"), e).alias("s"))
    return v.groupBy("concept_id").agg(F.round(F.max("s"), 6).alias("similarity"))


_STATE = "s AS (SELECT session_id, max(ingested_at) AS deep_indexed_at, CASE WHEN count(*) % 3 = 0 THEN NULL WHEN count(*) % 3 = 1 THEN min(ingested_at) ELSE max(ingested_at) END AS enriched_at FROM session_lines WHERE session_id IS NOT NULL GROUP BY 1)"


@q("SELECT session_id FROM s WHERE deep_indexed_at IS NOT NULL AND (enriched_at IS NULL OR enriched_at < deep_indexed_at)", more=_STATE)
def unenriched_sessions(spark, sf):
    t = F.col("ingested_at")
    n = F.count("*")
    s = model.table(spark, sf, "session_lines").groupBy("session_id").agg(F.max(t).alias("deep_indexed_at"), F.when(n % 3 == 0, F.lit(None)).when(n % 3 == 1, F.min(t)).otherwise(F.max(t)).alias("enriched_at"))
    return s.where("deep_indexed_at is not null and (enriched_at is null or enriched_at < deep_indexed_at)").select("session_id")


@q("SELECT patch_id, 'patches/' || patch_id || '.md' AS path FROM patches WHERE patch_id % 2 = 0 AND patch_id % 3 <> 0")
def broken_references(spark, sf):
    p = model.patches(spark, sf).select("patch_id", F.when(F.col("patch_id") % 2 == 0, F.concat(F.lit("patches/"), "patch_id", F.lit(".md"))).otherwise("").alias("path"))
    return audit.broken_references(p, p.where("patch_id % 3 = 0")).select("patch_id", "path")


# -- audits --------------------------------------------------------------------------------------
_WEAK = "weak AS (SELECT src, rel_type, dst FROM edges WHERE rel_type = 'DEPENDS_ON'), wl AS (SELECT src, dst FROM weak WHERE src <> dst AND src IN (SELECT concept_id FROM live) AND dst IN (SELECT concept_id FROM live)), lone AS (SELECT concept_id FROM live WHERE concept_id NOT IN (SELECT src FROM weak) AND concept_id NOT IN (SELECT dst FROM weak)), known AS (SELECT concept_id FROM live WHERE concept_id NOT IN (SELECT src FROM wl UNION SELECT dst FROM wl))"
_PROPOSED = search_queries._ENRICH.replace("edges", "weak").split("lone AS")[1].split(",\nclose", 1)[1]


@q("SELECT k.concept_id, c.name FROM known k JOIN concepts c ON c.concept_id = k.concept_id", more=_LIVE + ", " + _WEAK)
def knowledge_orphans(spark, sf):
    """Live concepts that no dependency links to a live one."""
    c, e, _ = _sparse(spark, sf)
    return audit.knowledge_orphans(c, e).select("concept_id", "name")


@q("SELECT c.namespace, count(*) AS n FROM known k JOIN concepts c ON c.concept_id = k.concept_id GROUP BY 1", more=_LIVE + ", " + _WEAK)
def orphan_namespaces(spark, sf):
    c, e, _ = _sparse(spark, sf)
    return audit.knowledge_orphans(c, e).groupBy("namespace").agg(F.count("*").alias("n"))


@q("SELECT src, dst, round((1 + similarity) / 2, 6) AS score FROM best WHERE same = any_same AND rank <= CASE WHEN same THEN 2 ELSE 1 END", more=_LIVE + ", " + _WEAK.replace("lone AS (SELECT concept_id FROM live", "lone AS (SELECT * FROM live") + ", close" + _PROPOSED)
def enrich_sparse(spark, sf):
    """Proposals where dependencies are the only edges, so that many concepts have none."""
    c, e, v = _sparse(spark, sf)
    return audit.enrich(c, e, v, 2, 0.82, "run-1").select("src", "dst", "score")


def _sparse(spark, sf):
    return model.concepts(spark, sf), model.edges(spark, sf).where("rel_type = 'DEPENDS_ON'"), model.vectors(spark, sf)


@q("SELECT (SELECT count(*) FROM known) AS before, (SELECT count(*) FROM known WHERE concept_id NOT IN (SELECT src FROM best WHERE same = any_same AND rank <= CASE WHEN same THEN 2 ELSE 1 END UNION SELECT dst FROM best WHERE same = any_same AND rank <= CASE WHEN same THEN 2 ELSE 1 END)) AS after", more=_LIVE + ", " + _WEAK.replace("lone AS (SELECT concept_id FROM live", "lone AS (SELECT * FROM live") + ", close" + _PROPOSED)
def enrich_effect(spark, sf):
    c, e, v = _sparse(spark, sf)
    made = Scratch(spark, "proposed").save(audit.enrich(c, e, v, 2, 0.82, "run-1"))
    return audit.enrich_effect(c, e, made)


_ORDERED = search_queries._JACCARD + ", o AS (SELECT *, row_number() OVER (ORDER BY valid_at ASC NULLS LAST, name, namespace NULLS FIRST, concept_id) AS at FROM concepts), od AS (SELECT x.concept_id AS older, y.concept_id AS newer, p.similarity, x.namespace AS na, y.namespace AS nb FROM pairs p JOIN o x ON x.concept_id = p.a JOIN o y ON y.concept_id = p.b WHERE jaccard >= 0.3 AND x.at < y.at)"


@q("SELECT older, newer, similarity FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, older, newer) AS rn FROM od) WHERE rn <= 20", more=_ORDERED)
def supersession_candidates(spark, sf):
    """The most alike pairs, the older concept first."""
    return audit.older_newer(search_queries.similar_pairs_jaccard(spark, sf).where("a < b"), model.concepts(spark, sf))


_REPORT = _ORDERED + f", c2 AS (SELECT * FROM concepts WHERE namespace IN ('global', 'atlas')), aged AS (SELECT c.concept_id, CAST(floor((epoch(TIMESTAMPTZ '{NOW}') - epoch(greatest(updated_at, coalesce(p.patched, updated_at)))) / 86400) AS BIGINT) AS age FROM c2 c LEFT JOIN (SELECT concept_id, max(valid_at) AS patched FROM patches WHERE has_patch GROUP BY 1) p ON p.concept_id = c.concept_id WHERE invalid_at IS NULL AND expired_at IS NULL)"


@q("SELECT 'stale' AS kind, concept_id, CAST(NULL AS BIGINT) AS other_id, age::DOUBLE AS value FROM (SELECT *, row_number() OVER (ORDER BY age DESC, concept_id) AS rn FROM aged WHERE age >= 200) WHERE rn <= 50 UNION ALL SELECT 'orphan', concept_id, NULL, n::DOUBLE FROM (SELECT c.concept_id, (SELECT count(*) FROM edges e WHERE e.src = c.concept_id) AS n, row_number() OVER (ORDER BY name, concept_id) AS rn FROM c2 c WHERE invalid_at IS NULL AND concept_id NOT IN (SELECT dst FROM edges WHERE src <> dst)) WHERE rn <= 50 UNION ALL SELECT 'similar', older, newer, similarity FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, older, newer) AS rn FROM od WHERE na IN ('global', 'atlas') AND nb IN ('global', 'atlas')) WHERE rn <= 20", more=_REPORT)
def staleness_report(spark, sf):
    pairs = search_queries.similar_pairs_jaccard(spark, sf).where("a < b")
    return audit.staleness_report(model.concepts(spark, sf), model.patches(spark, sf), model.edges(spark, sf), pairs, _at(NOW), 200, ["global", "atlas"])


@q("SELECT vec_id, concept_id, similarity FROM (SELECT n.vec_id, l.concept_id, round(list_cosine_similarity(n.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity, row_number() OVER (PARTITION BY n.vec_id ORDER BY round(list_cosine_similarity(n.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, l.concept_id) AS rn FROM vectors n, vectors v JOIN live l ON l.concept_id = v.concept_id WHERE n.concept_id IS NULL AND (1 + round(list_cosine_similarity(n.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)) / 2 >= 0.75) WHERE rn = 1", more=_LIVE)
def duplicate_guard(spark, sf):
    """Vectors without a concept, tested before they are added as one."""
    v = model.vectors(spark, sf)
    return audit.duplicate_guard(v.where("concept_id is null"), v, model.concepts(spark, sf))


@q("SELECT vec_id, url, rank FROM (SELECT k.vec_id, c.url, k.similarity, row_number() OVER (ORDER BY k.similarity DESC, k.vec_id) AS rank FROM knn k JOIN concepts c ON c.concept_id = k.concept_id WHERE c.url IS NOT NULL) WHERE rank <= 10 AND similarity >= 0.1", more=_KNN)
def source_similarity(spark, sf):
    """Sources nearest to the question, above a floor."""
    urls = model.concepts(spark, sf).where("url is not null").select("concept_id", "url")
    held = model.vectors(spark, sf).join(urls, "concept_id")
    return search.nearest(held, search_queries._query_vector(spark, sf), 10).where("similarity >= 0.1").select("vec_id", "url", "rank")


@q("SELECT vec_id, similarity, rank FROM knn WHERE rank <= 4", more=_KNN)
def flat_baseline(spark, sf):
    """The four nearest chunks, without time or links."""
    return search.nearest(model.vectors(spark, sf), search_queries._query_vector(spark, sf), 4).select("vec_id", "similarity", "rank")


@q("SELECT start, spot AS node, min(hops) AS depth, row_number() OVER (PARTITION BY start ORDER BY coalesce(any_value(c.expired_at), TIMESTAMPTZ '9999-12-31') DESC, spot) AS place FROM ch JOIN concepts c ON c.concept_id = ch.spot GROUP BY 1, 2", more="ch AS (SELECT concept_id AS start, concept_id AS spot, 0 AS hops FROM concepts UNION ALL SELECT ch.start, e.dst, ch.hops + 1 FROM ch JOIN edges e ON e.src = ch.spot AND e.rel_type = 'SUPERSEDES' WHERE ch.hops < 10)")
def supersession_ordered(spark, sf):
    """Chains with what is still in force first."""
    c = model.concepts(spark, sf)
    chains = graph.chain(model.edges(spark, sf), c.select(F.col("concept_id").alias("start")), "SUPERSEDES", 10)
    return graph.ordered_chain(chains, c.select(F.col("concept_id").alias("node"), "expired_at"))


@q("SELECT concept_id, session_id FROM (SELECT m.dst AS concept_id, s.session_id, row_number() OVER (PARTITION BY m.dst ORDER BY s.last DESC, s.session_id) AS rn FROM (SELECT DISTINCT x.session_id AS src, c.concept_id AS dst FROM (SELECT session_id, array_to_string(string_split(lower(summary), ' ')[-2:], '-') AS word FROM session_lines WHERE summary <> '') x JOIN concepts c ON regexp_replace(lower(c.name), '-[0-9]+$', '') = x.word) m JOIN (SELECT session_id, max(ingested_at) AS last FROM session_lines GROUP BY 1) s ON s.session_id = m.src) WHERE rn <= 5")
def sessions_for_concept(spark, sf):
    """The five latest sessions that mention a concept."""
    m = write_queries.mentioned(spark, sf).select(F.col("src").alias("session_id"), F.col("dst").alias("concept_id"))
    s = model.table(spark, sf, "session_lines").groupBy("session_id").agg(F.max("ingested_at").alias("last"))
    return graph.top_per(m.join(s, "session_id"), "concept_id", 5, F.desc("last"), F.col("session_id")).select("concept_id", "session_id")


# -- the walk cascade ---------------------------------------------------------------------------------
def _cascade(spark, sf, asked: str, exact: str):
    """Entries and results of a walk for a question, with its own words in the full-text tier."""
    c, e = model.concepts(spark, sf), model.edges(spark, sf)
    scratch = Scratch(spark, "cascade")
    in_force = c.where(temporal.in_force(_at()))
    named = scratch.save(c.where(F.col("name") == exact).select("concept_id", "name"))
    live = c.where(temporal.not_ended(_at())).select("concept_id", "name")
    text = search.search_index(*model.fulltext(spark, sf, "concepts"), asked, {"name": 3.0, "description": 1.0}).withColumnRenamed("key", "concept_id")
    text = text.withColumn("score", F.round("score", 6)).join(live, "concept_id")
    texts = scratch.save(search.top(text, 5, F.desc("score"), F.col("concept_id")))
    near = scratch.save(_near(spark, sf))
    best = search.top(near.join(in_force.select("concept_id", "name"), "concept_id").withColumn("score", (1 + F.col("similarity")) / 2), 20, F.desc("score"), F.col("concept_id"))
    starts = scratch.save(search.entries(asked, named, texts, best))
    reached = graph.walk(e, starts.select(F.col("concept_id").alias("start")), 2).join(in_force.select(F.col("concept_id").alias("dst")), "dst", "left_semi")
    p = model.patches(spark, sf).where("has_patch").where(temporal.in_force(_at())).join(near, "concept_id").select("concept_id", "patch_id", "similarity")
    return starts, search.walk_results(starts, reached, p, near)


_FORCE = f"(valid_at IS NULL OR valid_at <= TIMESTAMPTZ '{AT}') AND (invalid_at IS NULL OR invalid_at > TIMESTAMPTZ '{AT}') AND (expired_at IS NULL OR expired_at > TIMESTAMPTZ '{AT}')"
_ENDED = f"(invalid_at IS NULL OR invalid_at > TIMESTAMPTZ '{AT}') AND (expired_at IS NULL OR expired_at > TIMESTAMPTZ '{AT}')"
_BEST = f"sim AS (SELECT concept_id, max(similarity) AS similarity FROM knn WHERE concept_id IS NOT NULL GROUP BY 1), hybrid AS (SELECT concept_id, name, (1 + similarity) / 2 AS score FROM (SELECT s.concept_id, c.name, s.similarity, row_number() OVER (ORDER BY s.similarity DESC, s.concept_id) AS rank FROM sim s JOIN concepts c ON c.concept_id = s.concept_id WHERE {_FORCE}) WHERE rank <= 3)"
_RESULTS = f"sp AS (SELECT DISTINCT src, dst FROM edges WHERE rel_type NOT IN ('INVALIDATED_BY', 'SUPERSEDES')), r1 AS (SELECT dst FROM sp WHERE src IN (SELECT concept_id FROM starts)), r2 AS (SELECT dst FROM r1 UNION SELECT dst FROM sp WHERE src IN (SELECT dst FROM r1)), shown AS (SELECT 'concept' AS kind, id, similarity FROM (SELECT c.concept_id AS id, coalesce(s.similarity, 0) AS similarity, row_number() OVER (ORDER BY coalesce(s.similarity, 0) DESC, c.concept_id) AS rn FROM r2 JOIN concepts c ON c.concept_id = r2.dst LEFT JOIN sim s ON s.concept_id = c.concept_id WHERE {_FORCE}) WHERE rn <= 200 UNION ALL SELECT DISTINCT 'patch', p.patch_id, s.similarity FROM patches p JOIN sim s ON s.concept_id = p.concept_id WHERE p.has_patch AND p.concept_id IN (SELECT concept_id FROM starts) AND valid_at <= TIMESTAMPTZ '{AT}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMPTZ '{AT}') AND NOT (s.similarity > 0 AND s.similarity < 0.3))"
_FIRST = "starts AS (SELECT 'exact' AS tier, concept_id, name, 1.0::DOUBLE AS score FROM concepts WHERE name = (SELECT min(name) FROM concepts))"
_FULL = f"ft AS (SELECT *, contains(lower(name), 'hidden')::INT + contains(lower(name), 'handler')::INT AS hits FROM (SELECT s.concept_id, c.name, round(s.score, 6) AS score, row_number() OVER (ORDER BY round(s.score, 6) DESC, s.concept_id) AS rank FROM scored s JOIN concepts c ON c.concept_id = s.concept_id WHERE {_ENDED}) WHERE rank <= 5), ft1 AS (SELECT concept_id, name, score FROM (SELECT *, row_number() OVER (ORDER BY rank) AS k FROM ft WHERE hits > 1) WHERE k = 1 AND (hits = 2 OR score >= 50)), starts AS (SELECT 'fulltext' AS tier, * FROM ft1 UNION ALL SELECT 'hybrid', concept_id, name, score FROM hybrid WHERE NOT EXISTS (SELECT 1 FROM ft1))"
_HYBRID = "starts AS (SELECT 'hybrid' AS tier, concept_id, name, score FROM hybrid)"


@q("SELECT s.tier, s.concept_id AS start_id, x.kind, x.id, x.similarity FROM shown x, (SELECT min(tier) AS tier, min(concept_id) AS concept_id FROM starts) s", more=_KNN + ", " + _BEST + ", " + _FIRST + ", " + _RESULTS)
def cascade_exact(spark, sf):
    """The name itself is known."""
    first = model.concepts(spark, sf).agg(F.min("name")).first()[0]
    return _shown(*_cascade(spark, sf, first, first))


@q("SELECT s.tier, s.concept_id AS start_id, x.kind, x.id, x.similarity FROM shown x, (SELECT min(tier) AS tier, min(concept_id) AS concept_id FROM starts) s", more=_TEXT + ", " + _KNN + ", " + _BEST + ", " + _FULL + ", " + _RESULTS)
def cascade_fulltext(spark, sf):
    """The words are known, if a live name holds them."""
    return _shown(*_cascade(spark, sf, ASKED, ASKED))


@q("SELECT s.tier, s.concept_id AS start_id, x.kind, x.id, x.similarity FROM shown x, (SELECT min(tier) AS tier, min(concept_id) AS concept_id FROM starts) s", more=_KNN + ", " + _BEST + ", " + _HYBRID + ", " + _RESULTS)
def cascade_hybrid(spark, sf):
    """Only the vector knows."""
    return _shown(*_cascade(spark, sf, "zzz unheard of", "zzz unheard of"))


@q("SELECT tier, concept_id, name, round(score, 6) AS score FROM starts", more=_TEXT + ", " + _KNN + ", " + _BEST + ", " + _FULL)
def cascade_entries(spark, sf):
    return _cascade(spark, sf, ASKED, ASKED)[0].select("tier", "concept_id", "name", F.round("score", 6).alias("score"))


def _shown(starts, results):
    first = starts.agg(F.min("tier").alias("tier"), F.min("concept_id").alias("start_id")).first()  # of at most a few entries
    return results.select(F.lit(first["tier"]).alias("tier"), F.lit(first["start_id"]).cast("bigint").alias("start_id"), "kind", "id", "similarity")


QUERIES, ORACLES = q.queries, q.oracles
