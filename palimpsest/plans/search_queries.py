"""Queries of retrieval: full text, vectors, fusion, triggers, metrics, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import scalars, temporal
from ..operators import audit, search
from ._register import Registry
from .graph_queries import AT

q = Registry(model.SQL)
#: Questions of the queries below.
ASKED, WORDS = "hidden handler", ("hidden", "handler")
TOKEN_SQL = r"[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)*"


def _query_vector(spark, sf) -> list[float]:
    """The usable vector with the smallest id asks the question."""
    return model.vectors(spark, sf).orderBy("vec_id").limit(1).first()["embedding"]


_ASK = "asking AS (SELECT embedding::DOUBLE[] AS e FROM vectors ORDER BY vec_id LIMIT 1)"
_KNN = _ASK + ", knn AS (SELECT v.*, round(list_cosine_similarity(v.embedding::DOUBLE[], e), 6) AS similarity, row_number() OVER (ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], e), 6) DESC, vec_id) AS rank FROM vectors v, asking)"


def _bm25_sql(table: str, key: str, fields: dict[str, float], words: tuple[str, ...], boost: float = 5.0) -> str:
    """Common table expressions down to ``scored`` (key, score) for BM25 over weighted fields."""
    out, sums = [], []
    for f, weight in fields.items():
        parts = [(f"len(list_filter(t, lambda x: x = '{w}'))", weight) for w in words]
        if len(words) > 1:
            same = " AND ".join(f"t[i+{i}] = '{w}'" for i, w in enumerate(words))
            parts.append((f"len([i FOR i IN range(1, len(t) - {len(words) - 2}) IF {same}])", boost))
        cols = ", ".join(f"{e} AS f{i}" for i, (e, _) in enumerate(parts))
        out.append(f"t_{f} AS (SELECT {key}, regexp_extract_all(lower(coalesce({f}, '')), '{TOKEN_SQL}') AS t FROM {table})")
        out.append(f"c_{f} AS (SELECT {key}, len(t) AS n, {cols} FROM t_{f})")
        stats = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(parts)))
        out.append(f"s_{f} AS (SELECT CAST(count(*) FILTER (n > 0) AS DOUBLE) AS total, sum(n) / count(*) FILTER (n > 0) AS average, {stats} FROM c_{f})")
        score = " + ".join(f"CASE WHEN f{i} > 0 THEN {float(w)}::DOUBLE * ln(1 + (total - d{i} + 0.5) / (d{i} + 0.5)) * f{i} / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / average)) ELSE 0 END" for i, (_, w) in enumerate(parts))
        out.append(f"b_{f} AS (SELECT {key}, {score} AS score FROM c_{f}, s_{f})")
        sums.append(f"SELECT * FROM b_{f}")
    return ", ".join(out) + f", scored AS (SELECT {key}, sum(score) AS score FROM ({' UNION ALL '.join(sums)}) GROUP BY 1 HAVING sum(score) > 0)"


def _concept_text(spark, sf):
    return search.bm25(model.concepts(spark, sf), {"name": 3.0, "description": 1.0}, ASKED)


_TEXT = _bm25_sql("concepts", "concept_id", {"name": 3.0, "description": 1.0}, WORDS)


@q(rf"SELECT 'text' AS field, count(*) AS docs, sum(n)::BIGINT AS words FROM (SELECT len(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS n FROM documents) WHERE n > 0", plain=True)
def fulltext_build(spark, sf):
    """The index of all documents, built once in a session; its statistics are shown."""
    return model.fulltext(spark, sf, "documents")[1]


@q("SELECT doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rn FROM scored) WHERE rn <= 20", more=_bm25_sql("documents", "doc_id", {"text": 1.0}, ("gradient",)))
def bm25_topk(spark, sf):
    found = search.search_index(*model.fulltext(spark, sf, "documents"), "gradient", {"text": 1.0})
    d = found.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
    return search.top(d, 20, F.desc("score"), F.col("doc_id")).select("doc_id", "score")


@q("SELECT concept_id, round(score, 6) AS score FROM scored", more=_TEXT)
def bm25_multi_field(spark, sf):
    return _concept_text(spark, sf).select("concept_id", F.round("score", 6).alias("score"))


@q("SELECT concept_id, round(score, 6) AS score FROM scored", more=_TEXT)
def bm25_index(spark, sf):
    """As bm25_multi_field, by the index of concepts."""
    found = search.search_index(*model.fulltext(spark, sf, "concepts"), ASKED, {"name": 3.0, "description": 1.0})
    return found.select(F.col("key").alias("concept_id"), F.round("score", 6).alias("score"))


_FUZZY = rf"w AS (SELECT concept_id, regexp_extract_all(lower(coalesce(name, '')), '{TOKEN_SQL}') AS t FROM concepts), p AS (SELECT concept_id, term, len(any_value(t)) AS n, count(*) AS tf FROM (SELECT concept_id, t, unnest(t) AS term FROM w) GROUP BY 1, 2), s AS (SELECT count(*)::DOUBLE AS docs, avg(len(t)) AS average FROM w WHERE len(t) > 0), near AS (SELECT *, CASE WHEN term = 'handlr' THEN 3.0::DOUBLE ELSE 0.5::DOUBLE END AS weight, count(*) OVER (PARTITION BY term) AS df FROM p WHERE levenshtein(term, 'handlr') <= 2)"


@q("SELECT concept_id, round(sum(weight * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / average))), 6) AS score FROM near, s GROUP BY 1", more=_FUZZY)
def bm25_fuzzy(spark, sf):
    found = search.search_index(*model.fulltext(spark, sf, "concepts"), "handlr", {"name": 3.0}, fuzzy="name")
    return found.select(F.col("key").alias("concept_id"), F.round("score", 6).alias("score"))


@q(f"SELECT concept_id, name, rank FROM (SELECT s.concept_id, c.name, c.namespace, c.invalid_at, c.expired_at, row_number() OVER (ORDER BY round(score, 6) DESC, s.concept_id) AS rank FROM scored s JOIN concepts c ON c.concept_id = s.concept_id) WHERE rank <= 20 AND namespace IN ('global', 'billing-core') AND (invalid_at IS NULL OR invalid_at > TIMESTAMPTZ '{AT}') AND (expired_at IS NULL OR expired_at > TIMESTAMPTZ '{AT}')", more=_TEXT)
def bm25_postfilter(spark, sf):
    at = F.lit(AT).cast("timestamp")
    best = search.top(_concept_text(spark, sf).withColumn("score", F.round("score", 6)), 20, F.desc("score"), F.col("concept_id"))
    return best.where(temporal.in_namespaces(["global", "billing-core"]) & temporal.not_ended(at)).select("concept_id", "name", "rank")


@q("SELECT vec_id, name, similarity, round((1 + similarity) / 2, 6) AS score, rank FROM knn LEFT JOIN (SELECT concept_id AS id, invalid_at, expired_at FROM concepts) c ON c.id = knn.concept_id WHERE rank <= 20 AND namespace IN ('global', 'atlas') AND (1 + similarity) / 2 >= 0.3 AND (invalid_at IS NULL OR invalid_at > TIMESTAMPTZ '" + AT + "') AND (expired_at IS NULL OR expired_at > TIMESTAMPTZ '" + AT + "')", more=_KNN)
def vector_topk_postfilter(spark, sf):
    best = search.nearest(model.vectors(spark, sf), _query_vector(spark, sf), 20)
    best = best.join(model.concepts(spark, sf).select("concept_id", "invalid_at", "expired_at"), "concept_id", "left")
    live = temporal.not_ended(F.lit(AT).cast("timestamp"))
    return best.where(temporal.in_namespaces(["global", "atlas"]) & (F.col("score") >= 0.3) & live).select("vec_id", "name", "similarity", F.round("score", 6).alias("score"), "rank")


@q(f"SELECT k.vec_id, k.similarity, k.rank FROM knn k JOIN concepts c ON c.concept_id = k.concept_id WHERE rank <= 10 AND c.namespace <> 'intake' AND similarity >= 0.1 AND valid_at <= TIMESTAMPTZ '{AT}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMPTZ '{AT}') AND (expired_at IS NULL OR expired_at > TIMESTAMPTZ '{AT}')", more=_KNN)
def vector_topk_temporal(spark, sf):
    best = search.nearest(model.vectors(spark, sf), _query_vector(spark, sf), 10)
    live = model.concepts(spark, sf).where(temporal.in_force(F.lit(AT).cast("timestamp")) & (F.col("namespace") != "intake")).select("concept_id")
    return best.where("similarity >= 0.1").join(live, "concept_id", "left_semi").select("vec_id", "similarity", "rank")


_BLOCK = "near AS (SELECT a.vec_id AS query_id, b.vec_id AS other_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, other_id) AS rank FROM near)"


def _near(spark, sf, k):
    v = model.vectors(spark, sf)
    return search.block_search(v.where("vec_id % 50 = 0"), v, k)


@q("SELECT query_id, other_id, similarity, rank FROM ranked WHERE rank <= 8", more=_BLOCK)
def knn_search(spark, sf):
    return _near(spark, sf, 8)


_ENRICH = """live AS (SELECT concept_id, name, namespace FROM concepts WHERE invalid_at IS NULL AND expired_at IS NULL),
lone AS (SELECT * FROM live WHERE concept_id NOT IN (SELECT src FROM edges) AND concept_id NOT IN (SELECT dst FROM edges)),
close AS (SELECT a.concept_id AS src, a.namespace = b.namespace AS same, b.concept_id AS dst, max(round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6)) AS similarity
  FROM lone a JOIN vectors x ON x.concept_id = a.concept_id JOIN live b ON b.name <> a.name AND a.namespace IS NOT NULL AND b.namespace IS NOT NULL JOIN vectors y ON y.concept_id = b.concept_id GROUP BY 1, 2, 3 HAVING (1 + similarity) / 2 >= 0.82),
best AS (SELECT *, bool_or(same) OVER (PARTITION BY src) AS any_same, row_number() OVER (PARTITION BY src, same ORDER BY similarity DESC, dst) AS rank FROM close)"""


@q("SELECT src, 'RELATED_TO' AS rel_type, dst, round((1 + similarity) / 2, 6) AS score, 'run-1' AS run FROM best WHERE same = any_same AND rank <= CASE WHEN same THEN 2 ELSE 1 END", more=_ENRICH)
def knn_enrich(spark, sf):
    return audit.enrich(model.concepts(spark, sf), model.edges(spark, sf), model.vectors(spark, sf), 2, 0.82, "run-1")


_JACCARD = """types AS (SELECT src, list_distinct(list(rel_type)) AS t FROM edges GROUP BY 1),
close AS (SELECT x.concept_id AS a, y.concept_id AS b, max(round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6)) AS similarity FROM vectors x JOIN vectors y ON x.concept_id <> y.concept_id GROUP BY 1, 2 HAVING similarity > 0.9),
typed AS (SELECT a, b, similarity, coalesce(x.t, []) AS ta, coalesce(y.t, []) AS tb FROM close LEFT JOIN types x ON x.src = a LEFT JOIN types y ON y.src = b),
pairs AS (SELECT *, CASE WHEN len(list_distinct(list_concat(ta, tb))) = 0 THEN 1.0 ELSE len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))) END AS jaccard FROM typed)"""


@q("SELECT a, b, similarity, round(jaccard, 6) AS jaccard FROM pairs WHERE jaccard >= 0.3", more=_JACCARD)
def similar_pairs_jaccard(spark, sf):
    v = model.vectors(spark, sf)
    near = search.similar_pairs(v, 0.9)
    own = search.copies(v).select("rep", "concept_id").where("concept_id is not null").distinct()
    a, b = own.select(F.col("rep").alias("rep_a"), F.col("concept_id").alias("a")), own.select(F.col("rep").alias("rep_b"), F.col("concept_id").alias("b"))
    shared = own.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.lit(1.0).alias("similarity"))
    pairs = near.unionByName(shared).join(a, "rep_a").join(b, "rep_b").where("a <> b")
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))
    pairs = audit.relation_overlap(model.edges(spark, sf), pairs).where("jaccard >= 0.3").withColumn("jaccard", F.round("jaccard", 6))
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.select(both.alias("p"), "similarity", "jaccard").select("p.a", "p.b", "similarity", "jaccard")


@q("SELECT namespace, place, round(avg(v), 6) AS mean FROM (SELECT namespace, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS place FROM vectors) WHERE namespace IS NOT NULL GROUP BY 1, 2", more="")
def centroid(spark, sf):
    from ..operators.sessions import centroid as mean

    return mean(model.vectors(spark, sf).where("namespace is not null"), "namespace").select("namespace", F.col("at").alias("place"), F.round("mean", 6).alias("mean"))


# -- fusion ------------------------------------------------------------------------------
_LISTS = _TEXT + ", " + _KNN + ", kw AS (SELECT c.name, c.namespace, row_number() OVER (ORDER BY round(score, 6) DESC, s.concept_id) AS ra FROM scored s JOIN concepts c ON c.concept_id = s.concept_id QUALIFY ra <= 20), firsts AS (SELECT k.concept_id, min(rank) AS r FROM knn k GROUP BY 1), vc AS (SELECT c.name, c.namespace, row_number() OVER (ORDER BY f.r) AS rb FROM firsts f JOIN concepts c ON c.concept_id = f.concept_id QUALIFY rb <= 20)"


def _lists(spark, sf):
    kw = search.top(_concept_text(spark, sf).withColumn("score", F.round("score", 6)), 20, F.desc("score"), F.col("concept_id")).select("name", "namespace", "rank")
    c = model.concepts(spark, sf).select("concept_id", F.col("name").alias("n"), F.col("namespace").alias("ns"))
    v = model.vectors(spark, sf).where("concept_id is not null")
    e = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf)])
    scored = v.withColumn("similarity", F.round(scalars.cosine(F.col("embedding"), e), 6))
    best = scored.groupBy("concept_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "vec_id")).alias("b")).join(c, "concept_id")
    return kw, search.top(best, 20, F.col("b.s"), F.col("b.vec_id")).select(F.col("n").alias("name"), F.col("ns").alias("namespace"), "rank")


@q("SELECT coalesce(kw.name, vc.name) AS name, coalesce(kw.namespace, vc.namespace) AS namespace, round(least((coalesce(0.4::DOUBLE / (60 + ra), 0) + coalesce(0.6::DOUBLE / (60 + rb), 0)) * 61, 1.0::DOUBLE), 6) AS similarity FROM kw FULL JOIN vc ON kw.name = vc.name AND kw.namespace = vc.namespace", more=_LISTS)
def rrf_fusion(spark, sf):
    return search.fuse(*_lists(spark, sf), ASKED).withColumn("similarity", F.round("similarity", 6))


@q("SELECT name, namespace, round(0.4::DOUBLE / (60 + ra) * 61, 6) AS similarity FROM kw UNION ALL SELECT name, '', round(0.6::DOUBLE / (60 + rb) * 61, 6) FROM vc", more=_LISTS)
def rrf_temporal_compat(spark, sf):
    kw, vec = _lists(spark, sf)
    return search.fuse(kw, vec.withColumn("namespace", F.lit("")), ASKED).withColumn("similarity", F.round("similarity", 6))


_SCORES = _TEXT + ", " + _KNN + ", ft AS (SELECT concept_id, round(score, 6) AS ft FROM scored ORDER BY round(score, 6) DESC, concept_id LIMIT 20), vs AS (SELECT concept_id, max((1 + similarity) / 2) AS vec FROM knn WHERE rank <= 20 AND concept_id IS NOT NULL GROUP BY 1)"


@q("SELECT coalesce(ft.concept_id, vs.concept_id) AS concept_id, round(CASE WHEN ft IS NOT NULL AND vec IS NOT NULL THEN (ft + vec) / 2 ELSE coalesce(ft, vec * 0.8::DOUBLE) END, 6) AS score FROM ft FULL JOIN vs ON ft.concept_id = vs.concept_id", more=_SCORES)
def avg_fusion(spark, sf):
    """The mean of full-text and vector score; a vector hit alone counts 0.8."""
    text = search.top(_concept_text(spark, sf).withColumn("score", F.round("score", 6)), 20, F.desc("score"), F.col("concept_id"))
    near = search.nearest(model.vectors(spark, sf), _query_vector(spark, sf), 20).where("concept_id is not null").groupBy("concept_id").agg(F.max("score").alias("score"))
    return search.average(text.select("concept_id", "score"), near, "concept_id").withColumn("score", F.round("score", 6))


@q("SELECT name, min(tier) AS tier FROM (SELECT name, 0 AS tier FROM concepts WHERE contains(lower(name), 'handler') UNION ALL SELECT name, 1 FROM kw UNION ALL SELECT name, 2 FROM vc) GROUP BY 1", more=_LISTS)
def cascade_union(spark, sf):
    kw, vec = _lists(spark, sf)
    hit = model.concepts(spark, sf).where(F.contains(F.lower("name"), F.lit("handler"))).select("name", F.col("concept_id").alias("rank"))
    tiers = [hit, kw.select("name", F.col("rank").cast("bigint").alias("rank")), vec.select("name", F.col("rank").cast("bigint").alias("rank"))]
    return search.cascade(tiers).select("name", "tier")


@q("SELECT e.dst AS concept_id, round(coalesce(max(list_cosine_similarity(v.embedding::DOUBLE[], a.e)), 0), 6) AS similarity FROM (SELECT DISTINCT dst FROM edges WHERE src % 40 = 0) e CROSS JOIN asking a LEFT JOIN vectors v ON v.concept_id = e.dst GROUP BY 1", more=_ASK)
def rerank_cosine(spark, sf):
    reached = model.edges(spark, sf).where("src % 40 = 0").select(F.col("dst").alias("concept_id")).distinct()
    e = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf)])
    near = model.vectors(spark, sf).select("concept_id", scalars.cosine(F.col("embedding"), e).alias("c")).groupBy("concept_id").agg(F.max("c").alias("c"))
    return reached.join(near, "concept_id", "left").select("concept_id", F.round(F.coalesce("c", F.lit(0.0)), 6).alias("similarity"))


# -- triggers -------------------------------------------------------------------------------
@q("SELECT t.topic_id, arg_min(r.canon_id, r.canon_id) AS canon_id FROM topics t JOIN topic_reference r ON contains(lower(t.name), r.normalized_name) GROUP BY 1", plain=True)
def trigger_first(spark, sf):
    t = model.table(spark, sf, "topics").select(F.col("topic_id").alias("text_id"), F.lower("name").alias("text"))
    r = model.table(spark, sf, "topic_reference").select(F.col("canon_id").cast("bigint").alias("pattern_id"), F.col("normalized_name").alias("pattern"))
    return search.contained(t, r).groupBy(F.col("text_id").alias("topic_id")).agg(F.min("pattern_id").cast("int").alias("canon_id"))


@q("SELECT vec_id, name, similarity FROM knn WHERE rank <= 10 AND (1 + similarity) / 2 >= 0.3 AND (1 + similarity) / 2 >= CASE WHEN vec_id % 2 = 0 THEN 0.6 ELSE 0.75 END", more=_KNN)
def trigger_threshold(spark, sf):
    best = search.nearest(model.vectors(spark, sf), _query_vector(spark, sf), 10)
    own = F.when(F.col("vec_id") % 2 == 0, 0.6)
    return best.where((F.col("score") >= 0.3) & (F.col("score") >= F.coalesce(own, F.lit(0.75)))).select("vec_id", "name", "similarity")


# -- metrics -----------------------------------------------------------------------------------
_METRICS = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), near AS (SELECT a.vec_id AS query_id, b.vec_id AS other, a.label = b.label AS good, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), m AS (SELECT query_id, max(CASE WHEN good AND rank <= 3 THEN 1.0 ELSE 0 END) AS recall, max(CASE WHEN good THEN 1.0::DOUBLE / rank ELSE 0 END) AS reciprocal_rank, count(*) FILTER (good AND rank <= 3) / 3.0::DOUBLE AS precision FROM near WHERE rank <= 10 GROUP BY 1)"


def _label_metrics(spark, sf):
    e = model.table(spark, sf, "embeddings")
    found = search.block_search(e.where("vec_id % 50 = 0"), e, 10)
    labels = e.select("vec_id", "label")
    good = found.join(labels.withColumnRenamed("vec_id", "query_id"), "query_id").join(labels.select(F.col("vec_id").alias("other_id"), F.col("label").alias("l2")), "other_id").where("label = l2")
    return search.ranked_metrics(found.select("query_id", F.col("other_id").alias("item"), "rank"), good.select("query_id", F.col("other_id").alias("item")), 3)


@q("SELECT query_id, CAST(recall AS DOUBLE) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(precision, 6) AS precision FROM m", more=_METRICS)
def recall_mrr_precision(spark, sf):
    m = _label_metrics(spark, sf)
    return m.select("query_id", "recall", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("precision", 6).alias("precision"))


@q("SELECT count(*) AS n, round(avg(recall)::DOUBLE, 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(precision), 6) AS precision FROM m", more=_METRICS)
def mean_metrics(spark, sf):
    m = _label_metrics(spark, sf)
    return m.agg(F.count("*").alias("n"), *[F.round(F.avg(a), 6).alias(b) for a, b in (("recall", "recall"), ("reciprocal_rank", "mrr"), ("precision", "precision"))])


@q("SELECT user_id, event_type, sum((value > 50)::INT) * 2 > count(*) AS yes FROM events GROUP BY 1, 2", plain=True)
def majority_vote(spark, sf):
    return model.table(spark, sf, "events").groupBy("user_id", "event_type").agg((F.count_if(F.col("value") > 50) * 2 > F.count("*")).alias("yes"))


@q("SELECT coalesce(CAST(user_id % 10 AS VARCHAR), 'all') AS category, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY ROLLUP (user_id % 10)", plain=True)
def crosstab(spark, sf):
    e = model.table(spark, sf, "events").withColumn("c", F.col("user_id") % 10)
    kinds = ("click", "view", "purchase")
    g = e.rollup("c").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
    return g.select(F.coalesce(F.col("c").cast("string"), F.lit("all")).alias("category"), *kinds)


# -- text functions ---------------------------------------------------------------------------------
@q("SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '^ +| +$', '', 'g') AS text FROM documents", plain=True)
def html_text(spark, sf):
    return model.table(spark, sf, "documents").select("doc_id", scalars.html_text(F.col("text")).alias("text"))


@q("SELECT meeting_id, regexp_replace(regexp_replace(regexp_replace(lower(title || ' ' || title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:20], '-+$', '') AS slug FROM meetings", plain=True)
def slugs(spark, sf):
    return model.table(spark, sf, "meetings").select("meeting_id", scalars.slug(F.concat_ws(" ", "title", "title"), 20).alias("slug"))


@q("SELECT quote_id, CASE WHEN length(text) <= 60 THEN text ELSE coalesce(nullif(regexp_extract(text[1:60], '(?s)^(.*\\.) ', 1), ''), nullif(regexp_extract(text[1:60], '(?s)^(.*)\\n', 1), ''), text[1:60]) END AS text FROM quotes", plain=True)
def truncated(spark, sf):
    return model.table(spark, sf, "quotes").select("quote_id", scalars.truncate_sentence(F.col("text"), 60).alias("text"))


@q("SELECT concept_id, regexp_replace(coalesce(url, ''), '([+\\-&|!(){}\\[\\]^\"~*?:\\\\/])', '\\\\\\1', 'g') AS escaped FROM concepts")
def query_escape(spark, sf):
    return model.concepts(spark, sf).select("concept_id", search.escape_query(F.coalesce("url", F.lit(""))).alias("escaped"))


@q("SELECT name, concept_id FROM (SELECT name, concept_id, row_number() OVER (PARTITION BY lower(name[1:4]) ORDER BY concept_id) AS rn FROM concepts) WHERE rn = 1")
def first_by_name(spark, sf):
    first = model.concepts(spark, sf).groupBy(F.lower(F.substring("name", 1, 4))).agg(F.min(F.struct("concept_id", "name")).alias("v"))
    return first.select("v.name", "v.concept_id")


QUERIES, ORACLES = q.queries, q.oracles
