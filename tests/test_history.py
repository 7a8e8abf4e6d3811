import random
from datetime import datetime, timedelta

import pytest

from palimpsest.operators.history import as_of, history, versions

SCHEMA = "concept_id bigint, description string, source string, url string, invalid_at timestamp, invalidated_by string, updated_at timestamp, recorded_at timestamp, update_id bigint"
T0 = datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + timedelta(hours=n)


def row(cid, desc, t, rec=0, uid=0, inv=None):
    return (cid, desc, None, None, at(inv), None, at(t), at(rec), uid)


def brute(rows):
    """(concept, from, to) in hours by plain Python."""
    best = {}
    for r in rows:
        if r[0] is None or r[6] is None:
            continue
        low = datetime(1900, 1, 1)
        rank = (r[7] or low, -1 if r[8] is None else r[8])
        if (r[0], r[6]) not in best or rank > best[r[0], r[6]][0]:
            best[r[0], r[6]] = (rank, tuple(x or None for x in r[1:6]))
    out = []
    for c in {k[0] for k in best}:
        line = sorted(((t, best[cc, t][1]) for cc, t in best if cc == c), key=lambda x: x[0])
        starts = [x for i, x in enumerate(line) if i == 0 or line[i - 1][1] != x[1]]
        for i, (t, s) in enumerate(starts):
            ends = [e for e in (starts[i + 1][0] if i + 1 < len(starts) else None, s[3]) if e]
            if not ends or min(ends) > t:
                out.append((c, t, min(ends) if ends else None))
    return sorted(out, key=str)


def hours(df):
    us = lambda v: None if v is None else datetime(1970, 1, 1) + timedelta(microseconds=v)
    return sorted(((r["concept_id"], us(r["valid_from"]), us(r["valid_to"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("bucket_rows", [50_000, 7])
def test_random_updates_match_brute_force(spark, bucket_rows):
    rnd = random.Random(5)
    rows = [row(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice(["a", "b", "", None]), rnd.choice([None, *range(60)]), rnd.randint(0, 3), rnd.randint(0, 5), rnd.choice([None, None, 5, 30])) for _ in range(400)]
    rows += rows[:20]  # repeated rows
    got = hours(history(spark.createDataFrame(rows, SCHEMA), bucket_rows=bucket_rows))
    # equal rank with different states: the larger state holds, which plain Python doesn't model
    ranks = {}
    for r in rows:
        ranks.setdefault((r[0], r[6], r[7], r[8]), set()).add(r[1:6])
    clear = [r for r in rows if len(ranks[r[0], r[6], r[7], r[8]]) == 1]
    assert hours(history(spark.createDataFrame(clear, SCHEMA), bucket_rows=bucket_rows)) == brute(clear)
    assert got


def test_nothing_changes_for_ties_empty_strings_and_empty_tables(spark):
    rows = [row(1, "a", 1), row(1, "a", 2), row(1, "", 3), row(1, None, 4), row(1, "a", 5, inv=5), row(1, "z", 5, uid=-1)]
    got = hours(history(spark.createDataFrame(rows, SCHEMA)))
    assert got == [(1, at(1), at(3)), (1, at(3), at(5))]
    assert history(spark.createDataFrame([], SCHEMA)).count() == 0


def test_absence_closes_a_version_and_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([row(1, "a", 1) + (True, 1), row(1, None, 2) + (False, 1), row(1, "a", 3) + (True, 1)], SCHEMA + ", there boolean, e int")
    assert hours(history(df, present="there")) == [(1, at(1), at(2)), (1, at(3), None)]


@pytest.mark.parametrize("bucket_rows", [50_000, 3])
def test_as_of_takes_the_version_in_force(spark, bucket_rows):
    rows = [row(1, "a", 1), row(1, "b", 10, inv=20), row(2, "c", 5)] + [row(1, "abc"[i % 3], 30 + i) for i in range(12)]
    v = versions(spark.createDataFrame(rows, SCHEMA), bucket_rows=bucket_rows)
    asked = [(1, 1, at(0), False), (2, 1, at(1), False), (3, 1, at(25), False), (4, 1, at(25), True), (5, 2, None, None), (6, 9, at(3), False), (7, None, at(3), False), (8, 1, at(33), False)]
    q = spark.createDataFrame(asked, "query_id int, concept_id bigint, as_of timestamp, include_expired boolean")
    got = {r.query_id: r.description for r in as_of(v, q, now="2024-06-01", bucket_rows=bucket_rows).collect()}
    assert got == {1: None, 2: "a", 3: None, 4: "b", 5: "c", 6: None, 7: None, 8: "a"}


def test_states_that_differ_by_microseconds_are_two_versions(spark):
    end = datetime(2024, 5, 1, 0, 0, 0, 123_456)
    rows = [row(1, "a", 1)[:4] + (end,) + row(1, "a", 1)[5:], row(1, "a", 2)[:4] + (end + timedelta(microseconds=543),) + row(1, "a", 2)[5:]]
    got = hours(history(spark.createDataFrame(rows, SCHEMA)))
    assert got == [(1, at(1), at(2)), (1, at(2), end + timedelta(microseconds=543))]
