"""Queries on concepts, edges and patches: filters, expansion, aggregates, lineage, audits, writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import scalars, temporal
from ..operators import audit, graph, history, writes
from ..sources import exports
from ._register import Registry

AT = "2025-06-01T00:00:00Z"
NOW = "2026-06-01T00:00:00Z"
q = Registry(model.SQL)


def _at(text: str = AT):
    return F.lit(text).cast("timestamp")


def _secs(c: str):
    return F.unix_seconds(c).alias(c)


# -- filters ---------------------------------------------------------------------
@q(f"SELECT concept_id, name, namespace FROM concepts WHERE (valid_at IS NULL OR valid_at <= TIMESTAMPTZ '{AT}') AND (invalid_at IS NULL OR invalid_at > TIMESTAMPTZ '{AT}') AND (expired_at IS NULL OR expired_at > TIMESTAMPTZ '{AT}') AND namespace IN ('global', 'atlas', 'intake')")
def asof_concepts(spark, sf):
    c = model.concepts(spark, sf)
    return c.where(temporal.in_force(_at()) & temporal.in_namespaces(["global", "atlas", "intake"])).select("concept_id", "name", "namespace")


@q("SELECT concept_id, name FROM concepts")
def asof_include_expired(spark, sf):
    return model.concepts(spark, sf).where(temporal.in_force(_at(), include_expired=True)).select("concept_id", "name")


@q(f"SELECT concept_id FROM concepts WHERE (invalid_at IS NULL OR invalid_at > TIMESTAMPTZ '{NOW}') AND (expired_at IS NULL OR expired_at > TIMESTAMPTZ '{NOW}')")
def live_search(spark, sf):
    return model.concepts(spark, sf).where(temporal.not_ended(_at(NOW))).select("concept_id")


@q("SELECT concept_id FROM concepts WHERE invalid_at IS NULL AND expired_at IS NULL")
def live_audit(spark, sf):
    return model.concepts(spark, sf).where(temporal.never_ended()).select("concept_id")


@q("SELECT name, namespace, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]{0,63}$') AS proper, strlen(name) > 10 OR regexp_matches(name, '[\\s_-]\\S') AS semantic, coalesce(source, '') AS source FROM concepts")
def name_checks(spark, sf):
    c = model.concepts(spark, sf)
    return c.select("name", "namespace", scalars.relation_name(F.col("name")).alias("proper"), scalars.is_semantic(F.col("name")).alias("semantic"), F.coalesce("source", F.lit("")).alias("source"))


@q("SELECT name, namespace FROM concepts WHERE regexp_full_match(name, '(?i)(linear|stale)[-_:].*')")
def prefix_regex(spark, sf):
    return model.concepts(spark, sf).where(F.col("name").rlike(r"(?i)^(linear|stale)[-_:].*$")).select("name", "namespace")


@q("SELECT c.concept_id, c.name, count(p.patch_id) AS patch_count FROM concepts c LEFT JOIN patches p ON p.concept_id = c.concept_id AND p.has_patch WHERE contains(lower(c.name), 'ledger') GROUP BY 1, 2")
def exact_search(spark, sf):
    hit = model.concepts(spark, sf).where(F.contains(F.lower("name"), F.lit("ledger")))
    p = model.patches(spark, sf).where("has_patch").groupBy("concept_id").agg(F.count("*").alias("n"))
    return hit.join(p, "concept_id", "left").select("concept_id", "name", F.coalesce("n", F.lit(0).cast("bigint")).alias("patch_count"))


@q("SELECT concept_id, name, description IS NULL AS no_description, url IS NULL AS no_url FROM concepts WHERE description IS NULL OR url IS NULL")
def missing_parts(spark, sf):
    c = model.concepts(spark, sf).where("description is null or url is null")
    return c.select("concept_id", "name", F.col("description").isNull().alias("no_description"), F.col("url").isNull().alias("no_url"))


# -- expansion ---------------------------------------------------------------------
@q("SELECT e.src, a.name AS src_name, e.dst, b.name AS dst_name FROM edges e JOIN concepts a ON a.concept_id = e.src JOIN concepts b ON b.concept_id = e.dst WHERE rel_type = 'USES'")
def one_hop(spark, sf):
    c = model.concepts(spark, sf).select("concept_id", "name")
    e = graph.one_hop(model.edges(spark, sf), ["USES"])
    e = e.join(c.select(F.col("concept_id").alias("src"), F.col("name").alias("src_name")), "src")
    return e.join(c.select(F.col("concept_id").alias("dst"), F.col("name").alias("dst_name")), "dst").select("src", "src_name", "dst", "dst_name")


@q("SELECT dst AS concept_id, src AS from_id, rel_type FROM edges")
def reverse_hop(spark, sf):
    return model.edges(spark, sf).select(F.col("dst").alias("concept_id"), F.col("src").alias("from_id"), "rel_type")


@q("SELECT DISTINCT src AS concept_id, dst AS neighbour FROM (SELECT src, rel_type, dst FROM edges UNION SELECT dst, rel_type, src FROM edges) WHERE rel_type IN ('USES', 'DEPENDS_ON', 'PART_OF')")
def undirected_neighbours(spark, sf):
    e = graph.undirected(graph.one_hop(model.edges(spark, sf), ["USES", "DEPENDS_ON", "PART_OF"]))
    return e.select(F.col("src").alias("concept_id"), F.col("dst").alias("neighbour")).distinct()


_WALK = "steps AS (SELECT DISTINCT src, dst FROM edges WHERE rel_type NOT IN ('INVALIDATED_BY', 'SUPERSEDES')), w AS (SELECT concept_id AS start, concept_id AS spot, 0 AS hops FROM concepts UNION SELECT w.start, s.dst, w.hops + 1 FROM w JOIN steps s ON s.src = w.spot WHERE w.hops < {d})"


@q("SELECT start, spot AS dst, min(hops) AS hops FROM w WHERE hops > 0 GROUP BY 1, 2", more=_WALK.format(d=2))
def walk_depth2(spark, sf):
    starts = model.concepts(spark, sf).select(F.col("concept_id").alias("start"))
    return graph.walk(model.edges(spark, sf), starts, 2)


@q(f"SELECT start, spot AS dst, min(hops) AS hops FROM w JOIN concepts c ON c.concept_id = w.spot WHERE hops > 0 AND c.valid_at <= TIMESTAMPTZ '{AT}' AND (c.invalid_at IS NULL OR c.invalid_at > TIMESTAMPTZ '{AT}') AND (c.expired_at IS NULL OR c.expired_at > TIMESTAMPTZ '{AT}') GROUP BY 1, 2", more=_WALK.format(d=3))
def walk_depth3_asof(spark, sf):
    c = model.concepts(spark, sf)
    starts = c.select(F.col("concept_id").alias("start"))
    live = c.where(temporal.in_force(_at())).select(F.col("concept_id").alias("dst"))
    return graph.walk(model.edges(spark, sf), starts, 3).join(live, "dst", "left_semi").select("start", "dst", "hops")


@q("SELECT start, spot AS node, min(hops) AS depth FROM ch GROUP BY 1, 2", more="ch AS (SELECT concept_id AS start, concept_id AS spot, 0 AS hops FROM concepts UNION ALL SELECT ch.start, e.dst, ch.hops + 1 FROM ch JOIN edges e ON e.src = ch.spot AND e.rel_type = 'SUPERSEDES' WHERE ch.hops < 10)")
def supersession_chain(spark, sf):
    starts = model.concepts(spark, sf).select(F.col("concept_id").alias("start"))
    return graph.chain(model.edges(spark, sf), starts, "SUPERSEDES", 10)


@q("SELECT a.concept_id, a.name, a.invalidated_by, b.concept_id AS cause_id, a.reason FROM concepts a LEFT JOIN concepts b ON b.name = a.invalidated_by WHERE a.invalid_at IS NOT NULL")
def invalidation_record(spark, sf):
    c = model.concepts(spark, sf)
    cause = c.select(F.col("name").alias("invalidated_by"), F.col("concept_id").alias("cause_id"))
    return c.where("invalid_at is not null").join(cause, "invalidated_by", "left").select("concept_id", "name", "invalidated_by", "cause_id", "reason")


@q("SELECT c.concept_id, p.patch_id, p.content FROM concepts c LEFT JOIN patches p ON p.concept_id = c.concept_id AND p.has_patch")
def optional_patches(spark, sf):
    p = model.patches(spark, sf).where("has_patch").select("concept_id", "patch_id", "content")
    return model.concepts(spark, sf).select("concept_id").join(p, "concept_id", "left")


@q(f"SELECT concept_id, patch_id, content FROM (SELECT concept_id, patch_id, content, valid_at, invalid_at FROM patches WHERE has_patch UNION SELECT concept_id, patch_id, content, valid_at, invalid_at FROM patches WHERE corrects) WHERE valid_at <= TIMESTAMPTZ '{AT}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMPTZ '{AT}')")
def patch_union_asof(spark, sf):
    p = model.patches(spark, sf)
    both = p.where("has_patch").union(p.where("corrects")).distinct()
    return both.where(temporal.in_force(_at())).select("concept_id", "patch_id", "content")


# -- aggregates and audits -------------------------------------------------------------
@q("SELECT concept_id, (SELECT count(*) FROM edges WHERE src = concept_id) AS out_degree, (SELECT count(*) FROM edges WHERE dst = concept_id) AS in_degree FROM concepts")
def degree_counts(spark, sf):
    return graph.degrees(model.concepts(spark, sf), model.edges(spark, sf), "concept_id")


@q("SELECT concept_id, name FROM concepts WHERE concept_id NOT IN (SELECT src FROM edges) AND concept_id NOT IN (SELECT dst FROM edges)")
def orphans_any(spark, sf):
    return graph.orphans(model.concepts(spark, sf), model.edges(spark, sf), "concept_id").select("concept_id", "name")


@q("SELECT c.concept_id, c.name, (SELECT count(*) FROM edges e WHERE e.src = c.concept_id) AS out_degree FROM concepts c WHERE c.concept_id NOT IN (SELECT dst FROM edges) AND c.invalid_at IS NULL")
def orphans_incoming(spark, sf):
    c, e = model.concepts(spark, sf), model.edges(spark, sf)
    lone = graph.orphans(c.where("invalid_at is null"), e, "concept_id", incoming_only=True).select("concept_id", "name")
    out = e.groupBy(F.col("src").alias("concept_id")).agg(F.count("*").alias("n"))
    return lone.join(out, "concept_id", "left").select("concept_id", "name", F.coalesce("n", F.lit(0).cast("bigint")).alias("out_degree"))


@q("SELECT update_id, count(*) AS n FROM concept_updates GROUP BY 1 HAVING count(*) > 1", plain=True)
def dup_keys(spark, sf):
    return audit.duplicate_keys(model.table(spark, sf, "concept_updates"), ["update_id"])


@q("SELECT namespace, count(*) AS n FROM concepts GROUP BY 1")
def ns_counts(spark, sf):
    return model.concepts(spark, sf).groupBy("namespace").agg(F.count("*").alias("n"))


@q("SELECT namespace, count(*) AS n_rows, CAST(sum(CASE WHEN concept_id NOT IN (SELECT dst FROM edges) THEN 1 ELSE 0 END) AS BIGINT) AS n_orphans, sum(CASE WHEN concept_id NOT IN (SELECT dst FROM edges) THEN 1 ELSE 0 END) * 100.0 / count(*) > 25 AS warn FROM (SELECT c.concept_id, c.namespace FROM concepts c LEFT JOIN patches p ON p.concept_id = c.concept_id AND p.has_patch) GROUP BY 1")
def ns_stats_fanout(spark, sf):
    s = audit.namespace_stats(model.concepts(spark, sf), model.patches(spark, sf), model.edges(spark, sf))
    return s.withColumn("n_rows", F.col("n_rows").cast("bigint")).withColumn("n_orphans", F.col("n_orphans").cast("bigint"))


@q("SELECT a.concept_id, a.name, count(*) FILTER (b.namespace = a.namespace) AS same, count(*) FILTER (b.namespace <> a.namespace) AS other, coalesce(array_to_string(list_sort(list_distinct(list(b.namespace) FILTER (b.namespace <> a.namespace))), ','), '') AS spaces FROM concepts a JOIN u ON u.src = a.concept_id JOIN concepts b ON b.concept_id = u.dst GROUP BY 1, 2 HAVING count(*) FILTER (b.namespace <> a.namespace) > greatest(2, count(*) FILTER (b.namespace = a.namespace))", more="u AS (SELECT src, rel_type, dst FROM edges UNION ALL SELECT dst, rel_type, src FROM edges WHERE src <> dst)")
def cross_ns_majority(spark, sf):
    return audit.foreign_majority(model.concepts(spark, sf), model.edges(spark, sf))


@q("SELECT concept_id, name, namespace, split_part(name, '-', 1) AS prefix FROM concepts WHERE split_part(name, '-', 1) <> namespace AND split_part(name, '-', 1) IN (SELECT split_part(namespace, '-', 1) FROM concepts UNION SELECT 'linear')")
def prefix_mismatch(spark, sf):
    c = model.concepts(spark, sf)
    prefix = F.split_part("name", F.lit("-"), F.lit(1))
    known = c.select(F.split_part("namespace", F.lit("-"), F.lit(1)).alias("prefix")).union(spark.range(1).select(F.lit("linear"))).distinct()
    return c.withColumn("prefix", prefix).where("prefix <> namespace").join(known, "prefix", "left_semi").select("concept_id", "name", "namespace", "prefix")


@q("SELECT concept_id, name, CASE WHEN regexp_matches(name, '^linear[-_]') THEN 'linear' WHEN regexp_matches(name, '^stale[-_]') THEN 'stale' END AS suggested FROM concepts WHERE namespace = 'global' AND regexp_matches(name, '^(linear|stale)[-_]')")
def global_refugees(spark, sf):
    c = model.concepts(spark, sf).where("namespace = 'global'")
    return c.withColumn("suggested", F.coalesce(*[F.when(F.col("name").rlike(f"^{p}[-_]"), p) for p in ("linear", "stale")])).where("suggested is not null").select("concept_id", "name", "suggested")


@q(f"SELECT c.concept_id, c.name, CAST(floor((epoch(TIMESTAMPTZ '{NOW}') - epoch(greatest(updated_at, coalesce(p.patched, updated_at)))) / 86400) AS BIGINT) AS age_days FROM concepts c LEFT JOIN (SELECT concept_id, max(valid_at) AS patched FROM patches WHERE has_patch GROUP BY 1) p ON p.concept_id = c.concept_id WHERE invalid_at IS NULL AND expired_at IS NULL AND floor((epoch(TIMESTAMPTZ '{NOW}') - epoch(greatest(updated_at, coalesce(p.patched, updated_at)))) / 86400) >= 200")
def age_stale(spark, sf):
    return audit.stale(model.concepts(spark, sf), model.patches(spark, sf), _at(NOW), 200)


_SAME = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_CLASSES = f"""own AS (SELECT v.vec_id, v.name, v.embedding, CASE WHEN EXISTS (SELECT 1 FROM concepts c WHERE c.concept_id = v.concept_id AND c.namespace = 'global' AND c.expired_at IS NULL) THEN 0 ELSE 1 END AS late FROM vectors v WHERE name IS NOT NULL),
near AS (SELECT a.vec_id AS x, b.vec_id AS y FROM own a JOIN own b ON a.name = b.name AND a.vec_id <> b.vec_id WHERE {_SAME} >= 0.7),
reach AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON n.x = r.y),
classed AS (SELECT o.vec_id, o.name, (SELECT min(struct_pack(late := k.late, id := k.vec_id)) FROM own k WHERE k.vec_id = o.vec_id OR k.vec_id IN (SELECT y FROM reach WHERE x = o.vec_id)).id AS stands, (SELECT min(struct_pack(late := k.late, id := k.vec_id)) FROM own k WHERE k.name = o.name).id AS leads, (SELECT count(*) FROM near WHERE x = o.vec_id) AS links FROM own o)"""


@q(f"SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, {_SAME} AS similarity, CASE WHEN k.stands <> k.vec_id THEN 'merge' ELSE 'hold' END AS decision, k.links FROM classed k JOIN own b ON b.vec_id = k.vec_id JOIN own a ON a.vec_id = CASE WHEN k.stands <> k.vec_id THEN k.stands ELSE k.leads END WHERE a.vec_id <> b.vec_id", more=_CLASSES)
def dedupe_merge_hold(spark, sf):
    preferred = model.concepts(spark, sf).where("namespace = 'global' and expired_at is null")
    return audit.same_name_pairs(model.vectors(spark, sf), 0.7, preferred)


# -- time ---------------------------------------------------------------------------------
@q("SELECT event_id, user_id, event_type, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS expired_at FROM events", plain=True)
def tenures(spark, sf):
    t = history.successor(model.table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id", "expired_at")
    return t.select("event_id", "user_id", "event_type", "expired_at")


@q("SELECT event_id, user_id, event_type, value FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS expired_at FROM events) WHERE ts <= TIMESTAMP '2024-01-15' AND (expired_at IS NULL OR expired_at > TIMESTAMP '2024-01-15')", plain=True)
def asof_tenures(spark, sf):
    t = history.successor(model.table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id", "expired_at")
    return t.where("ts <= timestamp_ntz'2024-01-15' and (expired_at is null or expired_at > timestamp_ntz'2024-01-15')").select("event_id", "user_id", "event_type", "value")


@q("SELECT concept_id, CAST(epoch(valid_at) AS BIGINT) AS valid_at, CAST(epoch(updated_at) AS BIGINT) AS updated_at, CAST(epoch(updated_at) - epoch(valid_at) AS BIGINT) // 86400 AS days FROM concepts")
def concept_periods(spark, sf):
    days = F.floor((F.unix_seconds("updated_at") - F.unix_seconds("valid_at")) / 86400)
    return model.concepts(spark, sf).select("concept_id", _secs("valid_at"), _secs("updated_at"), days.alias("days"))


# -- writes --------------------------------------------------------------------------------
@q("SELECT coalesce(a.name, b.name) AS name, coalesce(a.namespace, b.namespace) AS namespace, coalesce(nullif(b.description, ''), a.description) AS description, coalesce(nullif(b.source, ''), a.source) AS source, a.concept_id, CAST(epoch(a.invalid_at) AS BIGINT) AS invalid_at, CAST(epoch(a.expired_at) AS BIGINT) AS expired_at FROM concepts a FULL JOIN n b ON a.name = b.name AND a.namespace = b.namespace", more="n AS (SELECT CASE WHEN concept_id % 5 = 0 THEN 'new-' || name ELSE name END AS name, namespace, CASE WHEN concept_id % 2 = 0 THEN '' ELSE 'rewritten' END AS description, CAST(NULL AS VARCHAR) AS source FROM concepts WHERE concept_id % 3 = 0)")
def upsert_concepts(spark, sf):
    c = model.concepts(spark, sf)
    new = c.where("concept_id % 3 = 0").selectExpr("if(concept_id % 5 = 0, concat('new-', name), name) AS name", "namespace", "if(concept_id % 2 = 0, '', 'rewritten') AS description", "cast(null as string) AS source", "valid_at")
    return graph.upsert(c, new, ["name", "namespace"], ["description", "source"], ["valid_at"]).select("name", "namespace", "description", "source", "concept_id", _secs("invalid_at"), _secs("expired_at"))


@q(f"SELECT concept_id, CAST(epoch(CASE WHEN expired_at IS NULL AND concept_id IN (SELECT dst FROM edges WHERE rel_type = 'SUPERSEDES') THEN TIMESTAMPTZ '{AT}' ELSE expired_at END) AS BIGINT) AS expired_at FROM concepts")
def supersede_apply(spark, sf):
    pairs = model.edges(spark, sf).where("rel_type = 'SUPERSEDES'").select(F.col("src").alias("new"), F.col("dst").alias("old"))
    return writes.supersede(model.concepts(spark, sf), pairs, _at()).select("concept_id", _secs("expired_at"))


@q(f"SELECT concept_id, CASE WHEN concept_id % 6 = 0 AND invalid_at IS NULL THEN 'cleanup' ELSE invalidated_by END AS invalidated_by, CAST(epoch(CASE WHEN concept_id % 6 = 0 AND invalid_at IS NULL THEN TIMESTAMPTZ '{AT}' ELSE invalid_at END) AS BIGINT) AS invalid_at FROM concepts")
def invalidate_apply(spark, sf):
    c = model.concepts(spark, sf)
    changes = c.where("concept_id % 6 = 0").select("concept_id", F.lit("cleanup").alias("cause"))
    return writes.invalidate(c, changes, _at()).select("concept_id", "invalidated_by", _secs("invalid_at"))


@q("SELECT src, rel_type, dst FROM edges UNION SELECT concept_id, 'RELATED_TO', concept_id + 1 FROM concepts WHERE concept_id + 1 IN (SELECT concept_id FROM concepts)")
def edge_merge(spark, sf):
    c = model.concepts(spark, sf)
    new = c.select(F.col("concept_id").alias("src"), F.lit("RELATED_TO").alias("rel_type"), (F.col("concept_id") + 1).alias("dst"))
    bad = c.select(F.col("concept_id").alias("src"), F.lit("not a name").alias("rel_type"), F.col("concept_id").alias("dst"))
    return graph.merge_edges(model.edges(spark, sf), new.unionByName(bad), c, "concept_id")


@q("SELECT concept_id, name, CASE WHEN regexp_full_match(name, '(?i)linear[-_:].*') THEN 'lab' ELSE namespace END AS namespace FROM concepts")
def move_prefix(spark, sf):
    return writes.move(model.concepts(spark, sf), "linear", "lab").select("concept_id", "name", "namespace")


@q("SELECT quote_id, meeting_id FROM quotes WHERE meeting_id % 10 <> 0", plain=True)
def delete_cascade(spark, sf):
    m, quotes = model.table(spark, sf, "meetings"), model.table(spark, sf, "quotes")
    return writes.delete_cascade(m, [quotes], "meeting_id", m.where("meeting_id % 10 = 0"))[1].select("quote_id", "meeting_id")


@q(f"SELECT concept_id, CAST(epoch(CASE WHEN concept_id % 9 = 1 AND expired_at IS NULL THEN TIMESTAMPTZ '{AT}' ELSE expired_at END) AS BIGINT) AS expired_at, CASE WHEN concept_id % 9 = 1 AND expired_at IS NULL THEN concept_id - 1 END AS merged_into FROM concepts")
def dedupe_apply(spark, sf):
    c = model.concepts(spark, sf)
    merges = c.where("concept_id % 9 = 1").select(F.col("concept_id").alias("duplicate"), (F.col("concept_id") - 1).alias("canonical"))
    return writes.apply_merges(c, merges, _at(), "run-1").select("concept_id", _secs("expired_at"), "merged_into")


@q("SELECT src, rel_type, dst FROM (SELECT src, rel_type, dst, CASE WHEN rel_type = 'USES' THEN 'run-' || (src % 3) END AS run FROM edges) WHERE run IS DISTINCT FROM 'run-2'")
def enrich_rollback(spark, sf):
    e = model.edges(spark, sf).withColumn("run", F.when(F.col("rel_type") == "USES", F.concat(F.lit("run-"), F.col("src") % 3)))
    return audit.rollback(e).select("src", "rel_type", "dst")


@q("""SELECT '{"labels":["Concept"],"properties":{"concept_id":' || concept_id || ',"name":"' || name || '","namespace":"' || namespace || '"}}' AS json FROM concepts WHERE namespace IN ('atlas', 'global')""")
def export_json(spark, sf):
    return exports.json_nodes(model.concepts(spark, sf), "Concept", ["concept_id", "name", "namespace"], ["atlas"])


@q("SELECT 'CREATE (:Concept {' || concat_ws(', ', 'name: ''' || name || '''', 'source: ''' || source || '''') || '});' AS statement FROM concepts")
def export_script(spark, sf):
    return exports.create_nodes(model.concepts(spark, sf), "Concept", ["name", "source"])


@q("SELECT 'MATCH (a:Concept {name: ''' || a.name || '''}), (b:Concept {name: ''' || b.name || '''}) CREATE (a)-[:' || rel_type || ']->(b);' AS statement FROM edges e JOIN concepts a ON a.concept_id = e.src JOIN concepts b ON b.concept_id = e.dst")
def export_edges(spark, sf):
    return exports.create_edges(model.edges(spark, sf), model.concepts(spark, sf))


@q("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1", plain=True)
def raw_query(spark, sf):
    for t in ("customer", "nation", "region"):
        model.table(spark, sf, t).createOrReplaceTempView(f"raw_{t}")
    return spark.sql("SELECT n_name, count(*) AS n FROM raw_customer JOIN raw_nation ON c_nationkey = n_nationkey JOIN raw_region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")


@q("SELECT concept_id, url, CASE WHEN contains(url, 'docs.google.com/document') THEN 'gdoc' WHEN contains(url, 'docs.google.com/spreadsheets') THEN 'gsheet' WHEN regexp_matches(url, '\\.(md|txt)$') OR contains(url, 'raw.githubusercontent.com') THEN 'raw' ELSE 'url' END AS kind FROM concepts WHERE url IS NOT NULL")
def url_kinds(spark, sf):
    return model.concepts(spark, sf).where("url is not null").select("concept_id", "url", scalars.url_kind(F.col("url")).alias("kind"))


QUERIES, ORACLES = q.queries, q.oracles
