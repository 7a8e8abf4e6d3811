"""Mapping freely typed values to a canonical list, in SQL only.

A partition-based pigeonhole join: every spelling of a reference entry is cut into k + 1 segments;
a typed value within k edits of it holds at least one segment unchanged near its place, so an
equality join on (length, segment number, text) finds all candidates.  The built-in levenshtein
verifies them, and an anti-join reports what has no entry.  Distinct values are matched once,
however often they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..scratch import Scratch

#: Edits of a spelling that are searched; a transposed pair of letters counts as two of these.  Short spellings are those of
#: fewer than LONG letters; of these, SHORT_K edits are searched, and none of spellings of fewer than SHORT letters.
K, LONG = 4, 10
SHORT_K, SHORT = 2, 5

MARKED = "àáâãäåāçčèéêëēìíîïīñòóôõöōøùúûüūýÿšž"
PLAIN = "aaaaaaacceeeeeiiiiinooooooouuuuuyysz"


def clean_sql(c: str, leads: tuple[str, ...] = (), trails: tuple[str, ...] = ()) -> str:
    """Lower case, accents and punctuation dropped, words separated by one blank, lead and trail words cut off."""
    flat = f"translate(lower(regexp_replace({c}, '\\\\pM', '')), '{MARKED}', '{PLAIN}')"
    out = f"trim(regexp_replace({flat}, '[^a-z0-9]+', ' '))"
    if leads:
        out = f"regexp_replace({out}, '^(({'|'.join(leads)}) )+', '')"
    return f"regexp_replace({out}, '( ({'|'.join(trails)}))+$', '')" if trails else out


#: Capitals only, of at most six letters: an abbreviation, which must match exactly.
_ABBREVIATION = "{c} RLIKE '^[A-Z0-9.]+$' AND length(replace({c}, '.', '')) <= 6"

#: A form that starts with # is the sorted words of an entry of four or more.
_SPELLINGS = """
WITH named AS (
  SELECT canon_id, {clean_n} AS words, {short_n} AS exact FROM {ref}
  UNION SELECT canon_id, {clean_l}, {short_l} FROM {ref}
  UNION SELECT canon_id, {clean_a}, {short_a} FROM (SELECT canon_id, explode(aliases) AS alias FROM {ref})),
split AS (SELECT canon_id, exact, w, size(w) AS n, transform(w, x -> if(x LIKE '%y', concat(substr(x, 1, length(x) - 1), 'ies'), concat(x, 's'))) AS p
          FROM (SELECT canon_id, coalesce(exact, false) AS exact, split(words, ' ') AS w FROM named WHERE words <> '')),
two AS (
  SELECT canon_id, v.x, v.y FROM (
    SELECT canon_id, explode(array(struct(w[0] AS x, w[1] AS y), struct(p[0] AS x, w[1] AS y), struct(w[0] AS x, p[1] AS y))) AS v FROM split WHERE n = 2)),
three AS (
  SELECT canon_id, v.x, v.y, v.z FROM (
    SELECT canon_id, explode(array(struct(w[0] AS x, w[1] AS y, w[2] AS z), struct(p[0] AS x, w[1] AS y, w[2] AS z),
      struct(w[0] AS x, p[1] AS y, w[2] AS z), struct(w[0] AS x, w[1] AS y, p[2] AS z))) AS v FROM split WHERE n = 3)),
spelt AS (
  SELECT canon_id, explode(array(concat(x, y), concat(y, x), concat(y, 'of', x))) AS form, false AS exact FROM two
  UNION ALL
  SELECT canon_id, explode(array(concat(x, y, z), concat(x, z, y), concat(y, x, z), concat(y, z, x), concat(z, x, y), concat(z, y, x), concat(z, 'of', y, x))), false FROM three
  UNION ALL
  SELECT canon_id, array_join(w, ''), exact FROM split
  UNION ALL
  SELECT canon_id, concat('#', array_join(array_sort(filter(w, x -> x <> 'of')), ' ')), true FROM split WHERE n > 3)
SELECT form, bool_and(exact) AS exact, min(canon_id) AS canon_id, max(canon_id) AS last_id FROM spelt GROUP BY form
"""

_TYPED = """
SELECT DISTINCT id, value FROM (
  SELECT {id} AS id, explode(array({values})) AS value FROM {typed})
WHERE value <> ''
"""

#: Segment ``i`` of ``k + 1`` of a string of length n starts after (i - 1) * n / (k + 1) characters, rounded down.
_MATCHES = """
WITH value AS (SELECT DISTINCT replace(value, ' ', '') AS s, concat('#', array_join(array_sort(filter(split(value, ' '), x -> x <> 'of')), ' ')) AS words FROM {typed}),
exact AS (
  SELECT s, canon_id, last_id, 0 AS far FROM value JOIN {forms} ON form = s
  UNION ALL
  SELECT s, canon_id, last_id, 0 AS far FROM value JOIN {forms} ON form = words),
rest AS (
  SELECT /*+ REPARTITION({parts}) */ s, length(s) AS n
  FROM (SELECT DISTINCT s FROM value LEFT ANTI JOIN exact USING (s)) WHERE length(s) >= {short} - {short_k}),
long AS (SELECT form, canon_id, last_id, length(form) AS n, if(length(form) < {long}, {short_k}, {k}) AS k FROM {forms} WHERE NOT exact AND length(form) >= {short}),
segment AS (
  SELECT form, canon_id, last_id, n, i, substr(form, from + 1, upto - from) AS part FROM (
    SELECT form, canon_id, last_id, n, i, int(floor((i - 1) * n / (k + 1))) AS from, int(floor(i * n / (k + 1))) AS upto FROM (
      SELECT form, canon_id, last_id, n, k, explode(sequence(1, k + 1)) AS i FROM long))),
probe AS (
  SELECT s, m, i, from, upto, explode(sequence(
           greatest(0, from - (i - 1), from + n - m - (k + 1 - i)),
           least(n - (upto - from), from + (i - 1), from + n - m + (k + 1 - i)))) AS at
  FROM (SELECT s, n, m, k, i, int(floor((i - 1) * m / (k + 1))) AS from, int(floor(i * m / (k + 1))) AS upto
        FROM (SELECT s, n, m, k, explode(sequence(1, k + 1)) AS i
              FROM (SELECT s, n, m, if(m < {long}, {short_k}, {k}) AS k FROM (SELECT s, n, explode(sequence(greatest({short}, n - {k}), n + {k})) AS m FROM rest WHERE n + {k} >= {short}))
              WHERE abs(n - m) <= k))
  WHERE greatest(0, from - (i - 1), from + n - m - (k + 1 - i)) <= least(n - (upto - from), from + (i - 1), from + n - m + (k + 1 - i))),
candidate AS (
  SELECT DISTINCT s, form, canon_id, last_id FROM (SELECT s, m, i, substr(s, at + 1, upto - from) AS part FROM probe) p
  JOIN segment g ON g.n = p.m AND g.i = p.i AND g.part = p.part),
near AS (
  SELECT s, canon_id, last_id, form, levenshtein(s, form, if(length(form) < {long}, {short_k}, {k})) AS far FROM candidate),
meant AS (
  SELECT s, canon_id, last_id, far FROM near WHERE far >= 0 AND if(length(form) < {long},
    far <= 1 OR exists(sequence(1, greatest(1, length(s) - 1)), i -> concat(substr(s, 1, i - 1), substr(s, i + 1, 1), substr(s, i, 1), substr(s, i + 2)) = form),
    far <= 2
    OR (far = 3 AND exists(sequence(1, length(s) - 1), i -> levenshtein(concat(substr(s, 1, i - 1), substr(s, i + 1, 1), substr(s, i, 1), substr(s, i + 2)), form, 1) >= 0))
    OR array_sort(split(s, '')) = array_sort(split(form, ''))))
SELECT s, best.far AS far, best.canon_id AS canon_id, best.canon_id <> -last.other AS ambiguous FROM (
  SELECT s, min(struct(far, canon_id)) AS best, min(struct(far, -last_id AS other)) AS last FROM (SELECT * FROM exact UNION ALL SELECT * FROM meant) GROUP BY s)
"""

_FOUND = """
WITH hit AS (
  SELECT id, best.canon_id AS canon_id, best.ambiguous AS ambiguous FROM (
    SELECT t.id, min(struct(m.far, m.canon_id, m.ambiguous)) AS best FROM {typed} t JOIN {matches} m ON replace(t.value, ' ', '') = m.s GROUP BY t.id))
SELECT id, canon_id, ambiguous FROM hit
UNION ALL
SELECT a.id, -1 AS canon_id, false AS ambiguous FROM (SELECT DISTINCT {id} AS id FROM {rows}) a LEFT ANTI JOIN hit ON a.id = hit.id
"""


def spellings(reference: DataFrame, leads: tuple[str, ...] = (), trails: tuple[str, ...] = ()) -> DataFrame:
    """form, exact, canon_id, last_id: how an entry may be written, joined without blanks: its words in any order, one of them in the plural.

    Entries of four words and more have their sorted words as a form of its own, which must match exactly, as must abbreviations.
    """
    sql = _SPELLINGS
    for mark, c in (("n", "normalized_name"), ("l", "label"), ("a", "alias")):
        sql = sql.replace(f"{{clean_{mark}}}", clean_sql(c, leads, trails)).replace(f"{{short_{mark}}}", _ABBREVIATION.replace("{c}", c))
    return reference.sparkSession.sql(sql, ref=reference.select("canon_id", "normalized_name", "label", "aliases"))


def map_values(
    rows: DataFrame,
    reference: DataFrame,
    id_col: str = "topic_id",
    value_cols: tuple[str, ...] = ("name", "normalized_name"),
    k: int = K,
    leads: tuple[str, ...] = (),
    trails: tuple[str, ...] = (),
) -> DataFrame:
    """``id_col``, canon_id, ambiguous: the entry that each row's values mean, -1 where none is meant.

    A value means an entry if it is within two slips (a letter too many, missing or wrong, or two
    swapped) of a spelling of it, or within one of a spelling of five to nine letters; shorter ones and
    abbreviations (capitals only) must match exactly.  Of several entries the nearest counts, then the smaller
    canon_id, and ambiguous says that others are as near.  ``leads`` and ``trails`` are words that people write
    around a value and that say nothing.  A value that is null, empty or says nothing matches nothing, so that
    the other value decides.  Rows with the same id are taken together; null ids are left out, and empty tables
    give no rows or only -1.
    """
    spark = rows.sparkSession
    rows = rows.select(id_col, *value_cols).where(rows[id_col].isNotNull())
    scratch = Scratch(spark, "canonical")
    values = ", ".join(clean_sql(c, leads, trails) for c in value_cols)
    typed = scratch.save(spark.sql(_TYPED.replace("{id}", id_col).replace("{values}", values), typed=rows))
    numbers = {"k": k, "long": LONG, "short": SHORT, "short_k": SHORT_K, "parts": max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))}
    sql = _MATCHES
    for name, n in numbers.items():
        sql = sql.replace(f"{{{name}}}", str(n))
    matches = scratch.save(spark.sql(sql, typed=typed, forms=scratch.save(spellings(reference, leads, trails))))
    return spark.sql(_FOUND.replace("{id}", id_col), typed=typed, matches=matches, rows=rows).withColumnRenamed("id", id_col)
