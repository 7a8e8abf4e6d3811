"""Retrieval kernels: full text (BM25), vectors (blocked cosine search), fusion and ranking."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, index_score
from ..scratch import Scratch

K1, B = 1.2, 0.75
#: Words keep an apostrophe inside them.
TOKEN = r"([\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)*)"


def tokens(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def escape_query(c: Column) -> Column:
    """A backslash before each character that full-text query syntax reserves."""
    return F.regexp_replace(c, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def query_terms(text: str) -> list[str]:
    """The distinct terms of a query, in order."""
    import regex

    return list(dict.fromkeys(regex.findall(TOKEN[1:-1], text.lower())))


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(term)


def _starts(words: str, terms: list[str]) -> Callable[[Column], Column]:
    """Whether the phrase starts at a place (from 0)."""
    return lambda i: F.slice(F.col(words), i + 1, F.lit(len(terms))) == F.array(*map(F.lit, terms))


def bm25(docs: DataFrame, fields: dict[str, float], query: str, phrase_boost: float = 5.0, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a column score > 0: BM25 over weighted fields, plus the boosted phrase for several terms.

    One pass over the texts counts terms and lengths and writes the counts; statistics and scores come from these.
    For many queries on one table see :func:`build_index`.  ``keep`` names the columns to return.  Null and empty
    fields have no terms; an empty query or table gives no rows.
    """
    keep = list(docs.columns if keep is None else keep)
    terms = query_terms(query)
    if not terms:
        return docs.select(*keep).withColumn("score", F.lit(0.0)).limit(0)
    made = docs
    for f in fields:
        made = made.withColumn(f"_t_{f}", tokens(F.col(f)))
    for f in fields:
        made = made.withColumn(f"_n_{f}", F.size(f"_t_{f}"))
        for i, t in enumerate(terms):
            made = made.withColumn(f"_f_{f}_{i}", F.size(F.filter(f"_t_{f}", _equals(t))))
        if len(terms) > 1:
            n = len(terms)
            at = F.sequence(F.lit(0), F.greatest(F.col(f"_n_{f}") - n, F.lit(0)))
            made = made.withColumn(f"_p_{f}", F.when(F.col(f"_n_{f}") >= n, F.size(F.filter(at, _starts(f"_t_{f}", terms)))).otherwise(0))
    made = Scratch(docs.sparkSession, "bm25").save(made.select(*keep, *[c for c in made.columns if c.startswith(("_n_", "_f_", "_p_"))]))
    stats = [F.count("*").alias("n")]
    for f in fields:
        stats += [F.sum(f"_n_{f}").alias(f"len_{f}"), F.count_if(F.col(f"_n_{f}") > 0).alias(f"has_{f}")]
        stats += [F.count_if(F.col(f"_f_{f}_{i}") > 0).alias(f"df_{f}_{i}") for i in range(len(terms))]
        if len(terms) > 1:
            stats.append(F.count_if(F.col(f"_p_{f}") > 0).alias(f"dp_{f}"))
    s = made.agg(*stats).first()
    score = F.lit(0.0)
    for f, weight in fields.items():
        total = s[f"has_{f}"]
        average = (s[f"len_{f}"] or 0) / total if total else 1.0

        def part(tf: Column, df: int, f: str = f, average: float = average, total: int = total) -> Column:
            idf = math.log(1 + (total - df + 0.5) / (df + 0.5))
            return F.when(tf > 0, idf * tf / (tf + K1 * (1 - B + B * F.col(f"_n_{f}") / average))).otherwise(0.0)

        for i in range(len(terms)):
            score = score + weight * part(F.col(f"_f_{f}_{i}"), s[f"df_{f}_{i}"])
        if len(terms) > 1:
            score = score + phrase_boost * part(F.col(f"_p_{f}"), s[f"dp_{f}"])
    return made.withColumn("score", score).where("score > 0").select(*keep, "score")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows with their rank, from 1. Only ``k`` rows per task are ever sorted together."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` vectors nearest to one query vector, with raw cosine, index score and rank; filters come after this."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("similarity", F.round(cosine(F.col(embedding), q), 6)).withColumn("score", index_score(F.col("similarity")))
    return top(scored, k, F.desc("similarity"), F.col(id_col))


def block_search(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", embedding: str = "embedding", block_rows: int = 20_000) -> DataFrame:
    """query_id, other_id, similarity, rank: the ``k`` nearest other vectors of each query vector.

    A stated query set against all rows, in blocks: every (query block, block) pair is one task that
    multiplies two bounded matrices and keeps ``k`` per query; the blocks' lists are then merged.
    """
    take = lambda df: df.select(F.col(id_col).alias("id"), F.col(embedding).alias("e"))
    queries, vectors = take(queries), take(vectors)
    nq, nv = max(1, math.ceil(queries.count() / block_rows)), max(1, math.ceil(vectors.count() / block_rows))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.select(block(nq).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("y"), F.lit(0).alias("side"), "id", "e")
    right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("x"), block(nv).alias("y"), F.lit(1).alias("side"), "id", "e")

    def multiply(t: pa.Table) -> pa.Table:
        sides = []
        for side in (0, 1):
            part = t.filter(pc.equal(t["side"], side)).combine_chunks()
            ids = part["id"].to_numpy()
            order = np.argsort(ids)
            flat = part["e"].combine_chunks()
            raw = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
            raw = raw[order]
            sides.append((ids[order], raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-300)))
        (qi, q), (vi, v) = sides
        out: list[list] = [[], [], []]
        if len(qi) and len(vi):
            for a in range(0, len(qi), 512):
                s = np.round(q[a : a + 512] @ v.T, 6)
                s[qi[a : a + 512, None] == vi[None, :]] = -9
                keep = min(k, len(vi))
                bar = np.partition(s, len(vi) - keep, axis=1)[:, len(vi) - keep]
                for r in range(len(s)):
                    hit = np.nonzero((s[r] >= bar[r]) & (s[r] > -9))[0]
                    hit = hit[np.argsort(-s[r, hit], kind="stable")][:keep]
                    out[0] += [qi[a + r]] * len(hit)
                    out[1] += vi[hit].tolist()
                    out[2] += s[r, hit].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "other_id": pa.array(out[1], pa.int64()), "similarity": pa.array(out[2], pa.float64())})

    found = left.unionByName(right).groupBy("x", "y").applyInArrow(multiply, "query_id bigint, other_id bigint, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, above: float, id_col: str = "vec_id", embedding: str = "embedding", block_rows: int = 16_384, asking: DataFrame | None = None) -> DataFrame:
    """rep_a, rep_b, similarity: all pairs of distinct vectors with a cosine (to 6 decimals) above ``above``, each once.

    Vectors go by the smallest id of their copies; :func:`copies` tells who these are.  Every pair of
    blocks is one task; the float32 product finds the pairs near the threshold, float64 decides.
    With ``asking``, further rows like ``vectors``, the pairs are those of each asking row (rep_a, its own
    id) with each distinct vector (rep_b).
    """
    rows = vectors.groupBy(F.col(embedding).alias("e")).agg(F.min(id_col).alias("id"))
    alone = asking is None
    n = max(1, math.ceil(vectors.count() / block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    left = rows.select(F.col("block").alias("x"), F.explode(F.sequence(F.col("block"), F.lit(n - 1))).alias("y"), F.lit(0).alias("side"), "id", "e")
    right = rows.where("block > 0").select(F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"), "id", "e")
    if not alone:
        m = max(1, math.ceil(asking.count() / block_rows))
        asked = asking.select(F.col(id_col).alias("id"), F.col(embedding).alias("e"))
        left = asked.select(F.pmod(F.xxhash64("id"), F.lit(m)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("y"), F.lit(0).alias("side"), "id", "e")
        right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"), "id", "e")

    def multiply(t: pa.Table) -> pa.Table:
        sides = []
        for side in (0, 1):
            part = t.filter(pc.equal(t["side"], side)).combine_chunks()
            ids = part["id"].to_numpy()
            raw = part["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
            sides.append((ids, raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-300)))
        same = alone and t["x"][0].as_py() == t["y"][0].as_py()
        (ai, a), (bi, b) = sides[0], sides[0] if same else sides[1]
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(ai) and len(bi):
            bf = b.astype(np.float32).T
            for i in range(0, len(ai), 512):
                x, y = np.nonzero(a[i : i + 512].astype(np.float32) @ bf > above - 1e-5)
                x += i
                if same:
                    x, y = x[x < y], y[x < y]
                s = np.round(np.einsum("ij,ij->i", a[x], b[y]), 6)
                ok = s > above
                out[0].append((np.minimum(ai[x], bi[y]) if alone else ai[x])[ok])
                out[1].append((np.maximum(ai[x], bi[y]) if alone else bi[y])[ok])
                out[2].append(s[ok])
        ids_a, ids_b, sims = map(np.concatenate, out)
        return pa.table({"rep_a": pa.array(ids_a, pa.int64()), "rep_b": pa.array(ids_b, pa.int64()), "similarity": pa.array(sims, pa.float64())})

    return left.unionByName(right).groupBy("x", "y").applyInArrow(multiply, "rep_a bigint, rep_b bigint, similarity double")


def copies(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vectors`` with rep, the smallest id of the rows that hold the same vector."""
    reps = vectors.groupBy(F.col(embedding).alias("e")).agg(F.min(id_col).alias("rep"))
    return vectors.join(reps, F.col(embedding) == F.col("e")).drop("e")


def fuse(keyword: DataFrame, vector: DataFrame, query: str, alpha: float = 0.4, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (name, namespace, rank): name, namespace, similarity.

    Scores are scaled so that rank 1 in both gives 1, and never exceed it; an exact name (blanks and case
    aside) gives 1.
    """
    a = keyword.select("name", "namespace", F.col("rank").alias("ra"))
    b = vector.select("name", "namespace", F.col("rank").alias("rb"))
    part = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    score = F.least((part(alpha, "ra") + part(1 - alpha, "rb")) * (k + 1), F.lit(1.0))
    exact = F.trim(F.lower("name")) == query.strip().lower()
    return a.join(b, ["name", "namespace"], "full_outer").select("name", "namespace", F.when(exact, 1.0).otherwise(score).alias("similarity"))


def average(text: DataFrame, vector: DataFrame, key: str) -> DataFrame:
    """Score-average fusion of (key, score) lists: the mean where both have it; a vector hit alone counts 0.8 if there is any text hit."""
    a, b = text.select(key, F.col("score").alias("ft")), vector.select(key, F.col("score").alias("vec"))
    both = a.join(b, key, "full_outer")
    alone = F.col("vec") * F.lit(1.0 if text.isEmpty() else 0.8)
    return both.select(key, F.when(F.col("ft").isNotNull() & F.col("vec").isNotNull(), (F.col("ft") + F.col("vec")) / 2).otherwise(F.coalesce("ft", alone)).alias("score"))


def cascade(tiers: list[DataFrame]) -> DataFrame:
    """Ordered union of tiers (name, rank): name, tier, rank of the first tier that has a name (case aside).

    :func:`top` over tier, rank and name gives the first places.
    """
    all_ = None
    for i, t in enumerate(tiers):
        t = t.select("name", F.lit(i).alias("tier"), "rank")
        all_ = t if all_ is None else all_.unionByName(t)
    first = all_.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("tier", "rank", "name")).alias("v"))
    return first.select("v.name", "v.tier", "v.rank")


def ranked_metrics(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """query_id, recall, reciprocal_rank, precision of ranked results (query_id, item, rank) against expected (query_id, item)."""
    hits = results.join(expected.select("query_id", "item").distinct().withColumn("good", F.lit(True)), ["query_id", "item"], "left")
    good = F.coalesce("good", F.lit(False))
    return hits.groupBy("query_id").agg(
        F.max(F.when(good & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias("recall"),
        F.coalesce(F.max(F.when(good, 1.0 / F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
        (F.count_if(good & (F.col("rank") <= k)) / F.lit(float(k))).alias("precision"),
    )


# -- full-text index -------------------------------------------------------------------------
BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_index(docs: DataFrame, key: str, fields: list[str], scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (term, field, key, tf, n, places; stored by bucket of the term) and field statistics (field, docs, words), written once.

    A hot term's postings are spread over several files of its bucket; a query reads the buckets of its terms only.
    """
    scratch = scratch or Scratch(docs.sparkSession, "fulltext")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields]))
    words = docs.select(F.col(key).alias("key"), each.alias("f")).select("key", "f.field", "f.t", F.size("f.t").alias("n")).where("n > 0")
    place = words.select("key", "field", "n", F.posexplode("t").alias("place", "term"))
    # all places of a term in a field are in one row of words: grouping by key needs no hot key
    postings = place.groupBy("key", "field", "term", "n").agg(F.array_sort(F.collect_list("place")).alias("places"))
    postings = postings.select(_bucket(F.col("term")).alias("bucket"), "term", "field", "key", F.size("places").alias("tf"), "n", "places")
    postings = postings.repartition(F.col("bucket"), F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("bucket", "term")
    stats = words.groupBy("field").agg(F.count("*").alias("docs"), F.sum("n").alias("words"))
    return scratch.save(postings, "bucket"), scratch.save(stats)


def search_index(postings: DataFrame, stats: DataFrame, query: str, weights: dict[str, float], phrase_boost: float = 5.0, fuzzy: str | None = None) -> DataFrame:
    """key, score > 0: BM25 by an index, with the same scores as :func:`bm25`; an empty query gives no rows.

    ``fuzzy`` names a field in which a query of one term also meets terms within two edits, each at half of its weight in one.
    """
    terms = query_terms(query)
    if not terms:
        return postings.select("key", F.lit(0.0).alias("score")).limit(0)
    spark = postings.sparkSession
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).distinct().collect()]  # one per term of the query
    weight = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, float(w))])[F.col("field")]
    hit = postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms) & F.col("field").isin(list(weights))).select("key", "field", "term", "tf", "n", "places")
    parts = hit.select("key", "field", "term", "tf", "n", weight.alias("weight"))
    if len(terms) > 1:
        places = hit.groupBy("key", "field", "n").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at")).where(F.size("at") == len(terms))
        follows = lambda p: [F.array_contains(F.col("at")[t], p + i) for i, t in enumerate(terms)][1:]
        count = F.size(F.filter(F.col("at")[terms[0]], lambda p: functools.reduce(lambda a, b: a & b, follows(p))))
        phrase = places.select("key", "field", F.lit(query).alias("term"), count.alias("tf"), "n", F.lit(float(phrase_boost)).alias("weight")).where("tf > 0")
        parts = parts.unionByName(phrase)
    elif fuzzy:
        near = postings.where((F.col("field") == fuzzy) & (F.col("term") != terms[0]) & (F.abs(F.length("term") - len(terms[0])) <= 2) & (F.levenshtein("term", F.lit(terms[0]), 2) >= 0))
        parts = parts.unionByName(near.select("key", "field", "term", "tf", "n", F.lit(0.5).alias("weight")))
    df = parts.groupBy("field", "term").agg(F.count("*").alias("df"))
    scored = parts.join(df, ["field", "term"]).join(stats, "field")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = F.col("weight") * idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("n") / (F.col("words") / F.col("docs"))))
    return scored.groupBy("key").agg(F.sum(score).alias("score"))


# -- the walk cascade ----------------------------------------------------------------------------
#: A full-text hit below this score counts only if its name holds all terms; entries of the hybrid tier; patches below this cosine are hidden (fixed values).
COMMIT, FANOUT, HIDDEN = 50.0, 3, 0.30


def covers(name: Column, query: str) -> tuple[Column, int]:
    """How many words of a query (split at blanks and hyphens) a name contains, and how many there are."""
    words = [t for t in re.split(r"[\s-]+", query.lower()) if t]
    return sum((F.contains(F.lower(name), F.lit(t)).cast("int") for t in words), F.lit(0)), len(words)


def entries(query: str, exact: DataFrame, texts: DataFrame, hybrid: DataFrame, semantic: bool = True) -> DataFrame:
    """tier, concept_id, name, score: where a walk starts, from the first tier that knows something.

    ``exact``: (concept_id, name) named exactly so that have patches or links; ``texts``: (concept_id, name, score,
    rank) of the best full-text hits, of which the first counts that holds more than half of the words, and only if it
    holds all or scores ``COMMIT``; ``hybrid``: (concept_id, name, score, rank), whose first ``FANOUT`` count if the
    query is worth an embedding.  Tiers are looked at one after the other; what is asked of each is one row.
    """
    if not exact.isEmpty():
        return exact.select(F.lit("exact").alias("tier"), "concept_id", "name", F.lit(1.0).alias("score"))
    hits, n = covers(F.col("name"), query)
    best = texts.withColumn("hits", hits).where(F.col("hits") > n // 2).orderBy("rank").limit(1)
    best = best.where((F.col("hits") == n) | (F.col("score") >= COMMIT))
    if not best.isEmpty():
        return best.select(F.lit("fulltext").alias("tier"), "concept_id", "name", "score")
    return hybrid.where((F.col("rank") <= FANOUT) & F.lit(semantic)).select(F.lit("hybrid").alias("tier"), "concept_id", "name", "score")


def walk_results(starts: DataFrame, reached: DataFrame, patches: DataFrame, near: DataFrame, limit: int = 200) -> DataFrame:
    """kind (concept, patch), id, similarity: what a walk from ``starts`` (concept_id) shows.

    ``reached`` (start, dst) are the ends of the walks, reranked by ``near`` (concept_id, similarity; missing is 0) and cut
    to ``limit``; of ``patches`` (concept_id, patch_id, similarity) those of the starts, without those whose similarity is
    above 0 and below ``HIDDEN``.
    """
    ends = reached.join(starts.select(F.col("concept_id").alias("start")), "start", "left_semi").select(F.col("dst").alias("concept_id")).distinct()
    ends = ends.join(near, "concept_id", "left").select("concept_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    ends = ends.orderBy(F.desc("similarity"), "concept_id").limit(limit).select(F.lit("concept").alias("kind"), F.col("concept_id").alias("id"), "similarity")
    own = patches.join(starts.select("concept_id"), "concept_id", "left_semi").where((F.col("similarity") <= 0) | (F.col("similarity") >= HIDDEN))
    return ends.unionByName(own.select(F.lit("patch").alias("kind"), F.col("patch_id").alias("id"), "similarity").distinct())


def picked(reply: Column, n: int) -> Column:
    """Places (from 1) that a reply lists as numbers, of those up to ``n``, a repetition of the number before left out; all in order where it lists none."""
    raw = F.filter(F.transform(F.regexp_extract_all(reply, F.lit(r"(\d{1,9})"), F.lit(1)), lambda x: x.cast("int")), lambda x: (x >= 1) & (x <= n))
    once = F.filter(raw, lambda x, i: (i == 0) | (x != F.get(raw, i - 1)))
    return F.when(F.size(once) > 0, once).otherwise(F.sequence(F.lit(1), F.lit(n)))


def verdict(reply: Column, word: str = "CORRECT", against: str = "INCORRECT") -> Column:
    """Whether the last line of a reply says the word and not its opposite."""
    last = F.upper(F.element_at(F.split(F.regexp_replace(reply, r"\s+$", ""), "\n"), -1))
    return F.coalesce(F.contains(last, F.lit(word)) & ~F.contains(last, F.lit(against)), F.lit(False))


def require_recall(metrics: DataFrame, least: float) -> float:
    """Mean recall of ``metrics`` (recall; nulls, skipped queries, left out); an error if it is below ``least``."""
    got = metrics.agg(F.avg("recall")).first()[0] or 0.0
    if got < least:
        raise AssertionError(f"recall {got:.3f} is below {least}")
    return got


def triggered(prompts: DataFrame, patterns: DataFrame, near: DataFrame, broadcast_rows: int = 10_000) -> DataFrame:
    """prompt_id, pattern, concept: the first pattern (by ``at``) that a prompt matches, else its nearest concept.

    ``prompts``: prompt_id, text; ``patterns``: at, pattern, a regular expression searched in the lower-cased
    text, or words where it is none; ``near``: prompt_id, concept.  Patterns are sent to all tasks, so their number is bounded.
    """
    rows = patterns.where("pattern <> ''").select("at", "pattern").distinct().limit(broadcast_rows + 1).collect()
    if len(rows) > broadcast_rows:
        raise ValueError(f"more than {broadcast_rows} patterns")
    sent = prompts.sparkSession.sparkContext.broadcast([r["pattern"] for r in sorted(rows, key=lambda r: (r["at"], r["pattern"]))])

    def run(batches):
        tests = []
        for p in sent.value:
            try:
                tests.append((p, re.compile(p.lower()).search))
            except re.error:
                tests.append((p, lambda t, p=p.lower(): p in t))
        for b in batches:
            said = [(t or "").lower() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([next((p for p, test in tests if test(t)), None) if t else None for t in said], pa.string())], ["prompt_id", "pattern"])

    kind = prompts.schema["prompt_id"].dataType.simpleString()
    hit = prompts.select("prompt_id", "text").mapInArrow(run, f"prompt_id {kind}, pattern string")
    return hit.join(near.select("prompt_id", "concept"), "prompt_id", "left").select("prompt_id", "pattern", F.when(F.col("pattern").isNull(), F.col("concept")).alias("concept"))


#: Patterns that are sent to every task.
MAX_PATTERNS = 100_000


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id: which texts (text_id bigint, text) contain which patterns (pattern_id bigint, pattern), each pair once.

    One pass over the texts with an automaton of all patterns; their number is bounded and checked.  Null texts and
    null or empty patterns take no part.
    """
    rows = patterns.where("pattern <> '' and pattern_id is not null").select("pattern", "pattern_id").distinct().limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    by: dict[str, list[int]] = {}
    for r in rows:
        by.setdefault(r["pattern"], []).append(r["pattern_id"])
    sent = texts.sparkSession.sparkContext.broadcast(by)

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p, ids in sent.value.items():
            automaton.add_word(p, ids)
        if len(automaton):
            automaton.make_automaton()
        for b in batches:
            ids, said = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = [(i, p) for i, t in zip(ids, said) if t and len(automaton) for p in {p for _, found in automaton.iter(t) for p in found}]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["text_id", "pattern_id"])

    return texts.select("text_id", "text").mapInArrow(run, "text_id bigint, pattern_id bigint").distinct()
