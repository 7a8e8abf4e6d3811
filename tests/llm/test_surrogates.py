"""Surrogates: nothing original left, distinct, consistent, in format; rows with null or repeated ids."""

import re

import pytest

from palimpsest.llm import pii, surrogates

TEXTS = "src string, rec_id bigint, block_no int, text string"
NAMES = [("Anna", "given"), ("Bert", "given"), ("Kohl", "family"), ("Lind", "family")]


def run(spark, said, names=NAMES):
    rows = [(*(r[:3] if isinstance(r, tuple) else ("q", i, 0)), r[3] if isinstance(r, tuple) else r) for i, r in enumerate(said)]
    df = spark.createDataFrame(rows, TEXTS)
    known = spark.createDataFrame(names, "word string, word_kind string")
    return rows, surrogates.with_surrogates(df, known, "k"), surrogates.pseudonyms(df, known, "k"), known


def test_null_and_repeated_ids_keep_nothing_and_mix_nothing(spark):
    said = [(None, None, None, "mail ann.k@site.example now"), ("q", 1, 0, "ask Anna Kohl please"), ("q", 1, 0, "mail bob@place.example please"), ("q", 1, 0, "mail bob@place.example please"), ("q", 2, 0, None), ("q", 3, 0, "")]
    rows, out, found, _ = run(spark, said)
    got = [(r.rec_id, r.text) for r in out.collect()]
    assert len(got) == 6 and sum(t is None for _, t in got) == 1 and sum(t == "" for _, t in got) == 1
    texts = [t for _, t in got if t]
    assert all(re.fullmatch(r"mail \S+@\S+\.example (now|please)|ask \S+ \S+ please", t) for t in texts)
    assert not any(x in t for t in texts for x in ("ann.k", "bob", "Anna", "Kohl"))
    assert found.count() == 4 and run(spark, [])[1].count() == 0


def test_short_and_full_forms_stay_together(spark):
    said = ["ask Anna Kohl about it. A. Kohl knows, and Dr. Kohl signed it off.", "assigned to Kohl, Anna; ok", "per ANNA KOHL, who wrote it", "Dr. Kohl signed it off", "ask Bert Kohl", "ask Anna Lind", "reviewed by B. Lind today"]
    _, out, found, _ = run(spark, said)
    got = {r.rec_id: r.text for r in out.collect()}
    first, last = re.match(r"ask (\w+) (\w+) about", got[0]).groups()
    assert f"{first[0]}. {last} knows" in got[0] and f"Dr. {last} signed" in got[0]
    assert got[1] == f"assigned to {last}, {first}; ok" and got[2] == f"per {first.upper()} {last.upper()}, who wrote it" and got[3] == f"Dr. {last} signed it off"
    assert got[4].endswith(last) and first not in got[4] and first in got[5] and last not in got[5] and not re.search(r"\bB\. ", got[6])
    assert not {w.lower() for t in got.values() for w in re.findall(r"\w+", t)} & {"anna", "bert", "kohl", "lind"}


def test_surrogates_are_one_to_one_and_keep_the_format(spark):
    said = [f"call {n} now" for n in ("+49 30 2312 5830", "0049-30-23125830", "(312) 555-0153", "312-555-0153", "312-555-0154", "138-0013-8000")] + ["SSN 947-52-6604", "at 464 Xofur Rd. now", "mail a.b@c.example", "mail a (at) b (dot) test"]
    said += [f"ask {g} {f} about it" for g in ("Anna", "Bert") for f in ("Kohl", "Lind")]
    rows, out, found, _ = run(spark, said)
    got = {r.rec_id: r.text for r in out.collect()}
    shape = lambda t: re.sub(r"\d", "0", t)
    assert [shape(got[i]) for i in range(7)] == [shape(said[i]) for i in range(7)]
    digits = lambda t: re.sub(r"\D", "", t)
    assert digits(got[0]) == digits(got[1])[2:] and got[0].startswith("call +49 ") and digits(got[2]) == digits(got[3]) != digits(got[4])
    assert got[7].endswith(" Rd. now") and "Xofur" not in got[7] and "(at)" in got[9] and "(dot) test" in got[9]
    told = {(r.kind, r.surrogate) for r in found.collect()}
    mentions = {(r.kind, surrogates._plain_entity(r.kind, r.found)) for r in found.collect()}
    assert len({(k, surrogates._plain_entity(k, s)) for k, s in told}) == len(mentions)
    assert all(a.found != a.surrogate for a in found.collect())


def test_gender_and_script(spark):
    said = ["Mrs. Tisa Kohl signed it off", "ask Tisa Kohl", "Mr. Vido Kohl signed it off", "reviewed by Marta Lind because she knows", "Анна Смирнова owns this module", "田中太郎さん, thanks", "ask Zuro Kohl"]
    names = [*NAMES, ("Tisa", "given"), ("Vido", "given"), ("Marta", "given"), ("Zuro", "given"), ("Анна", "given"), ("Смирнова", "family")]
    _, out, _, _ = run(spark, said, names)
    got = {r.rec_id: r.text for r in out.collect()}
    ends = lambda kind: tuple(surrogates._ENDINGS[kind])
    given = {i: re.search(r"(?:Mrs\. |Mr\. |ask |by )(\w+)", got[i])[1] for i in (0, 1, 2, 3, 6)}
    assert given[0] == given[1] and given[0].endswith(ends("f")) and given[3].endswith(ends("f")) and given[2].endswith(ends("m")) and given[6].endswith(ends(""))
    assert re.match(r"[А-я]+ [А-я]+ owns", got[4]) and "Анна" not in got[4]
    assert re.match("[一-鿿]{2,4}さん", got[5]) and "田中" not in got[5] and "太郎" not in got[5]


def test_many_words_of_a_small_space_end_distinct(spark):
    words = spark.createDataFrame([("id_number", f"{n:02d}", "") for n in range(60)] + [("given", f"name{n}", "f") for n in range(2000)], "space string, word string, gender string")
    made = surrogates.surrogates(words, None, "k").collect()
    assert len(made) == 2060 and len({(r.space, r.surrogate) for r in made}) == 2060
    assert not {r.surrogate for r in made} & {f"{n:02d}" for n in range(60)}


@pytest.mark.parametrize("text", ["Mary Johnson wrote it", "Priya Natarajan wrote it", "Keisha Okonkwo wrote it", "王小明, thanks"])
def test_names_that_no_table_lists(text):
    assert [k for _, _, k in pii.Finder({}).find(text)] == ["person_name"]
