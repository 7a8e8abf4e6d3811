"""Queries of the training-data operators on text and vectors, and their DuckDB equivalents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import map_values
from .conversations import conversations
from .leakage import leaks
from .neighbours import neighbours
from .pii import message_texts, with_placeholders
from .splitting import joined, split_documents
from .surrogates import pseudonyms, with_surrogates
from .tokenizer import decode_corpus, encode_corpus


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark, sf):
    near = neighbours(_table(spark, sf, "concept_vectors"), min_cosine=0.85)
    return near.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


def p2_knn(spark, sf):
    near = neighbours(_table(spark, sf, "concept_vectors"), queries=F.col("id") % 50 == 0)
    return near.select(F.col("id").alias("vec_id"), F.col("other").alias("other_id"), "similarity", "rank")


def _messages(spark, sf):
    return message_texts(_table(spark, sf, "session_lines"), _table(spark, sf, "quotes"))


def p4_found(spark, sf):
    found = pseudonyms(_messages(spark, sf), _table(spark, sf, "name_parts"), key="p4")
    return found.select("src", "rec_id", "block_no", "kind", "found").distinct()


def p4_placeholders(spark, sf):
    return with_placeholders(_messages(spark, sf), _table(spark, sf, "name_parts"))


def p4_surrogates(spark, sf):
    return with_surrogates(_messages(spark, sf), _table(spark, sf, "name_parts"), key="p4")


def p5_found(spark, sf):
    return conversations(_table(spark, sf, "session_lines")).select("root_uuid", "seq_no", "uuid")


def p5_roles(spark, sf):
    told = conversations(_table(spark, sf, "session_lines"))
    return told.groupBy("role").agg(F.count("*").alias("n_turns"), F.countDistinct("root_uuid").alias("n_conversations"))


#: What people write around a topic (fixed values).
LEADS = ("re", "fwd", "follow up", "update on", "quick sync about", "q1", "q2", "q3", "q4", "the")
TRAILS = ("discussion", "cont", "notes", "next steps", "status", "question")


def _mapped(spark, sf):
    return map_values(_table(spark, sf, "topics"), _table(spark, sf, "topic_reference"), leads=LEADS, trails=TRAILS)


def p6_found(spark, sf):
    return _mapped(spark, sf).select("topic_id", "canon_id")


def p6_counts(spark, sf):
    return _mapped(spark, sf).where("canon_id >= 0").groupBy("canon_id").agg(F.count("*").alias("n_topics"), F.count_if("ambiguous").alias("n_ambiguous"))


def p6_unmatched(spark, sf):
    topics = _table(spark, sf, "topics")
    none = _mapped(spark, sf).where("canon_id = -1")
    return topics.join(none, "topic_id", "left_semi").groupBy("name", "normalized_name").agg(F.count("*").alias("n_topics"))


def p7_ids(spark, sf):
    return encode_corpus(_table(spark, sf, "documents"))


def p7_round_trip(spark, sf):
    """Digests of the texts that the ids spell."""
    return decode_corpus(p7_ids(spark, sf)).select("doc_id", F.md5("text").alias("digest"))


def p8_found(spark, sf):
    return leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items")).where("run_words >= 13").select("doc_id", "item_id")


def p8_leaks(spark, sf):
    return leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p9_pieces(spark, sf):
    return split_documents(_table(spark, sf, "documents"))


def p9_joined(spark, sf):
    """Digests of all texts, the split ones put together from their pieces, and whether the pieces keep to the limits."""
    docs = _table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5("text").alias("whole"))
    back = joined(p9_pieces(spark, sf)).select("doc_id", F.md5("text").alias("again"), ((F.col("most_tokens") <= 512) & (F.col("most_shared") <= 64)).alias("fits"))
    return docs.join(back, "doc_id", "left").select("doc_id", F.coalesce("again", "whole").alias("digest"), F.coalesce("fits", F.lit(True)).alias("fits"))


QUERIES = {f.__name__: f for f in (p2_found, p2_knn, p4_found, p4_placeholders, p4_surrogates, p5_found, p5_roles, p6_found, p6_counts, p6_unmatched, p7_ids, p7_round_trip, p8_found, p8_leaks, p9_pieces, p9_joined)}

_TURNS = r"""
WITH RECURSIVE lines AS (
  SELECT uuid, nullif(parent_uuid, '') AS parent, coalesce(is_sidechain, false) AS sidechain, row_id, ingested_at,
    CASE WHEN regexp_full_match(trim(ts), '\d+') THEN make_timestamp(CAST(trim(ts) AS BIGINT) * 1000)
         WHEN regexp_matches(trim(ts), '^\d{4}-') THEN CAST(TRY_CAST(CASE WHEN regexp_matches(trim(ts), '(Z|[+-]\d\d:\d\d)$') THEN trim(ts) ELSE trim(ts) || 'Z' END AS TIMESTAMPTZ) AS TIMESTAMP) END AS t,
    CASE WHEN coalesce(message.role, '') = '' THEN line_type ELSE lower(trim(message.role)) END AS role,
    coalesce(regexp_matches(message.content, '[^\s\x0b\x1c-\x1f\x85\p{Z}]'), false)
      OR len(list_filter(coalesce(message.blocks, []), lambda b: coalesce((b.block_type = 'text' AND regexp_matches(b.text, '[^\s\x0b\x1c-\x1f\x85\p{Z}]')) OR b.block_type IN ('tool_use', 'tool_result'), false))) > 0 AS filled
  FROM session_lines WHERE uuid IS NOT NULL AND uuid <> ''),
turns AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY t DESC NULLS LAST, ingested_at DESC NULLS LAST, row_id DESC) AS rn FROM lines)
  WHERE rn = 1 AND NOT sidechain),
followed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY t DESC NULLS LAST, uuid DESC) AS k FROM turns WHERE parent IS NOT NULL) WHERE k = 1),
told AS (
  SELECT uuid AS root, uuid, 1 AS seq_no, role, filled FROM turns WHERE parent IS NULL
  UNION ALL
  SELECT told.root, f.uuid, told.seq_no + 1, f.role, f.filled FROM followed f JOIN told ON f.parent = told.uuid),
kept AS (
  SELECT root FROM told GROUP BY root
  HAVING bool_and(filled AND role = CASE WHEN seq_no % 2 = 1 THEN 'user' ELSE 'assistant' END) AND max(seq_no) % 2 = 0)
"""



def _clean(c: str) -> str:
    flat = f"translate(lower(strip_accents({c})), 'ø', 'o')"
    bare = f"regexp_replace(trim(regexp_replace({flat}, '[^a-z0-9]+', ' ', 'g')), '^((re|fwd|follow up|update on|quick sync about|q[1-4]|the) )+', '')"
    return f"replace(regexp_replace({bare}, '( (discussion|cont|notes|next steps|status|question))+$', ''), ' ', '|')"


def _variants(n: int) -> str:
    """The spellings of entries of n words as a list expression over w (words) and p (plurals)."""
    orders = {2: ("12", "21", "2of1"), 3: ("123", "132", "213", "231", "312", "321", "3of21")}[n]
    forms = []
    for plural in range(n + 1):
        word = {str(i): f"{'p' if i == plural else 'w'}[{i}]" for i in range(1, n + 1)}
        forms += ["concat(" + ", ".join("'of'" if x == "of" else word[x] for x in re.findall("of|.", o)) + ")" for o in orders]
    return "[" + ", ".join(forms) + "]"


_CANONICAL = f"""
WITH named AS (
  SELECT canon_id, normalized_name AS raw FROM topic_reference
  UNION SELECT canon_id, label FROM topic_reference
  UNION SELECT canon_id, unnest(aliases) FROM topic_reference),
split AS (
  SELECT canon_id, exact, w, [CASE WHEN x LIKE '%y' THEN x[:-2] || 'ies' ELSE x || 's' END FOR x IN w] AS p
  FROM (SELECT canon_id, upper(raw) = raw AND regexp_full_match(replace(raw, '.', ''), '[A-Z0-9]{{1,6}}') AS exact, string_split({_clean('raw')}, '|') AS w FROM named) WHERE w <> ['']),
forms AS (
  SELECT form, bool_and(exact) AS exact, min(canon_id) AS canon_id, max(canon_id) AS last_id FROM (
    SELECT canon_id, unnest({_variants(2)}) AS form, false AS exact FROM split WHERE len(w) = 2
    UNION ALL SELECT canon_id, unnest({_variants(3)}), false FROM split WHERE len(w) = 3
    UNION ALL SELECT canon_id, array_to_string(w, ''), exact FROM split
    UNION ALL SELECT canon_id, '#' || array_to_string(list_sort([x FOR x IN w IF x <> 'of']), ' '), true FROM split WHERE len(w) > 3) GROUP BY form),
typed AS (
  SELECT DISTINCT topic_id, replace(v, '|', '') AS s, '#' || array_to_string(list_sort([x FOR x IN string_split(v, '|') IF x <> 'of']), ' ') AS bag
  FROM (SELECT topic_id, unnest([{_clean('name')}, {_clean('normalized_name')}]) AS v FROM topics) WHERE v <> ''),
whole AS (SELECT DISTINCT s, canon_id, last_id FROM typed JOIN forms ON form = s OR form = bag),
near AS (
  SELECT s, form, canon_id, last_id, levenshtein(s, form) AS far FROM (SELECT DISTINCT s FROM typed WHERE s NOT IN (SELECT s FROM whole)) v
  JOIN forms ON NOT exact AND length(form) >= 5 AND abs(length(form) - length(s)) <= 4),
swapped AS (SELECT *, [s[1:i-1] || s[i+1:i+1] || s[i:i] || s[i+2:] FOR i IN range(1, length(s))] AS swaps FROM near WHERE far <= 4),
matches AS (
  SELECT s, canon_id, last_id, 0 AS far FROM whole
  UNION ALL
  SELECT s, canon_id, last_id, far FROM swapped WHERE CASE WHEN length(form) < 10 THEN far <= 1 OR list_contains(swaps, form)
    ELSE far <= 2 OR (far = 3 AND list_bool_or([levenshtein(x, form) <= 1 FOR x IN swaps])) OR list_sort(string_split(s, '')) = list_sort(string_split(form, '')) END),
hit AS (
  SELECT topic_id, arg_min(canon_id, far * 100000 + canon_id) AS canon_id, arg_min(last_id, far * 100000 + 99999 - last_id) AS last_id FROM typed JOIN matches USING (s) GROUP BY topic_id)
"""

_GRAMS = r"""
SELECT DISTINCT {id}, array_to_string(ws[i:i+12], ' ') AS gram
FROM (SELECT {id}, ws, unnest(range(1, len(ws) - 11)) AS i FROM (SELECT {id}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM {table}) WHERE len(ws) >= 13)
"""

_COSINES = """
WITH ok AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM concept_vectors
  WHERE len(embedding) = 64 AND NOT list_bool_or([isnan(x) OR x IS NULL FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
pairs AS (
  SELECT a.vec_id, b.vec_id AS other_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM ok a JOIN ok b ON a.vec_id <> b.vec_id {where}),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, other_id) AS rank FROM pairs)
"""

ORACLES = {
    "p2_found": _COSINES.format(where="") + "SELECT DISTINCT least(vec_id, other_id) AS vec_a, greatest(vec_id, other_id) AS vec_b FROM best WHERE rank <= 5 AND similarity >= 0.85",
    "p2_knn": _COSINES.format(where="WHERE a.vec_id % 50 = 0") + "SELECT vec_id, other_id, similarity, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 5",
    "p6_found": _CANONICAL + "SELECT DISTINCT t.topic_id, CAST(coalesce(hit.canon_id, -1) AS INTEGER) AS canon_id FROM topics t LEFT JOIN hit ON hit.topic_id = t.topic_id",
    "p6_counts": _CANONICAL + "SELECT canon_id, count(*) AS n_topics, count(*) FILTER (canon_id <> last_id) AS n_ambiguous FROM hit GROUP BY canon_id",
    "p7_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p9_joined": "SELECT doc_id, md5(text) AS digest, true AS fits FROM documents WHERE text IS NOT NULL",
    "p6_unmatched": _CANONICAL + "SELECT name, normalized_name, count(*) AS n_topics FROM topics WHERE topic_id NOT IN (SELECT topic_id FROM hit) GROUP BY name, normalized_name",
    "p8_found": f"SELECT DISTINCT d.doc_id, i.item_id FROM ({_GRAMS.format(id='doc_id', table='documents')}) d JOIN ({_GRAMS.format(id='item_id', table='eval_items')}) i ON d.gram = i.gram",
    "p5_found": _TURNS + "SELECT root AS root_uuid, CAST(seq_no AS INTEGER) AS seq_no, uuid FROM told WHERE root IN (SELECT root FROM kept)",
    "p5_roles": _TURNS + "SELECT role, count(*) AS n_turns, count(DISTINCT root) AS n_conversations FROM told WHERE root IN (SELECT root FROM kept) GROUP BY role",
}
