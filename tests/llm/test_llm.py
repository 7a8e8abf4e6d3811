"""The text and vector operators against brute force, round trips and library results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import canonical, conversations, leakage, neighbours, pii, splitting, surrogates, tokenizer
from palimpsest.llm.queries import ORACLES, QUERIES
from test_entry import compare, duck  # noqa: F401


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer.DEFAULT)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):  # noqa: F811
    compare(spark, duck, sf, QUERIES, ORACLES, name)


# -- p7 ------------------------------------------------------------------------------------
def odd_texts(n=3000):
    rnd = random.Random(1)
    chars = "aab 's\n\t\r\x1c\x1f\x85\xa0 　é日本0٣²½\U0001f600́_-!l"
    made = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return made + ["a" * 5000, " " * 3000 + "x", "=" * 777, "ab" * 4000, "<|endoftext|>hi", "don't we'll", ""]


def test_encoding_equals_the_library(library):
    texts = odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokenizer.ByteBPE().ids(texts) == want


def test_segment_trees_agree_with_each_other():
    bpe = tokenizer.ByteBPE()
    words = [w.encode() for w in ("indubitably", "xxxxxxxxxxxxxxxx", "aaaaab", "zq", "  ", "naïveté")]
    for w in words:
        assert bpe._trees([w], 1 << max(0, (len(w) - 2).bit_length()))[0] == bpe._tree(w)


def test_corpus_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x"), (None, "hi", "x")], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id or 0, r.ids) for r in tokenizer.encode_corpus(df).collect()))
    assert got == [(0, [5303]), (1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0


# -- p9 ------------------------------------------------------------------------------------
def check_pieces(library, text, rows, limit, overlap):
    rows = sorted(rows, key=lambda r: r.piece_no)
    assert [r.piece_no for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].start_pos == 0 and rows[-1].end_pos == len(text)
    for i, r in enumerate(rows):
        assert r.text == text[r.start_pos : r.end_pos]
        assert len(library.encode(r.text, add_special_tokens=False).ids) == r.n_tokens <= limit
        if i:
            before = rows[i - 1]
            assert before.start_pos < r.start_pos <= before.end_pos < r.end_pos
            assert len(library.encode(text[r.start_pos : before.end_pos], add_special_tokens=False).ids) == r.overlap_tokens <= overlap


def test_pieces_of_odd_texts(spark, library):
    rnd = random.Random(2)
    prose = lambda n: " ".join(rnd.choice(["alpha", "beta,", "gamma.\n", "delta\n\n", "x=1;", "été", "日本語", "\t"]) for _ in range(n))
    texts = [prose(900), "".join(rnd.choice("abcdefgh0123+/") for _ in range(6000)), "a" * 9000, " \n" * 3000, "\n".join(["word"] * 1500), "😀" * 800, prose(40), "", None, "=" * 6000]
    cells = [[(0, len(t or "") // 2), (0, 10**9)] if i % 2 else None for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(zip(texts, cells))], "doc_id bigint, text string, cells array<struct<cell_no int, end_pos int>>")
    rows = splitting.split_documents(df).collect()
    for i, t in enumerate(texts):
        mine = [r for r in rows if r.doc_id == i]
        if t and len(library.encode(t, add_special_tokens=False).ids) > 512:
            check_pieces(library, t, mine, 512, 64)
        else:
            assert not mine
    for i in (1, 2, 5):  # unbroken texts share tokens as well
        cut = {r.piece_no: r.cut for r in rows if r.doc_id == i}
        assert all(40 <= r.overlap_tokens <= 64 for r in rows if r.doc_id == i and cut.get(r.piece_no - 1) == "other") and "other" in cut.values()
    natural = [r for r in rows if r.doc_id in (0, 4)]
    assert all(r.cut != "other" for r in natural) and all(48 <= r.overlap_tokens <= 64 for r in natural if r.piece_no > 1)
    assert splitting.split_documents(df.limit(0)).count() == 0


def test_pieces_end_at_sentences(spark, library):
    rnd = random.Random(8)
    wide = "".join(f"{rnd.choice(['行数', '結果', '次の値'])}は{n}です。" for n in range(400))
    prose = " ".join(" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randint(5, 12))) + "." for _ in range(200))
    df = spark.createDataFrame([(1, wide), (2, prose)], "doc_id bigint, text string")
    rows = splitting.split_documents(df, cells_col=None).collect()
    for i, t in ((1, wide), (2, prose)):
        mine = [r for r in rows if r.doc_id == i]
        check_pieces(library, t, mine, 512, 64)
        assert {r.cut for r in mine} == {"sentence", "end"} and all(r.overlap_tokens >= 40 for r in mine if r.piece_no > 1)
    for overlap in (-1, 512):
        with pytest.raises(ValueError):
            splitting.split_documents(df, cells_col=None, overlap=overlap)


def test_program_is_the_cheapest_over_all_ends():
    bpe = tokenizer.ByteBPE()
    bpe.shape = {}
    rnd = random.Random(9)
    text = "".join(rnd.choice(["aa ", "bb. ", "cc\n", "dd ee ", "ff\n\n"]) for _ in range(300))
    words = bpe.encode([text])[0]
    doc = splitting._Doc(text, words, bpe, np.array([bpe.shape[w] for w in words]), [], splitting._Runs(bpe))
    pos, kind, e, s = doc.natural
    limit, overlap, total = 64, 8, int(doc.sums[-1])
    parts = max(1, -(-(total - overlap) // (limit - overlap)))
    even = (total + overlap * (parts - 1)) / parts
    first = [next((j for j in range(len(s)) if s[j] >= e[i] - overlap), i) for i in range(len(e))]
    begin, ends = [0, *(s[min(f, i)] for i, f in enumerate(first))], [0, *e, total]
    fine = [0, *splitting.PENALTY[kind], 0]
    best = [0.0] + [float("inf")] * (len(ends) - 1)
    least = min(limit // 2, int(0.75 * even))
    for j in range(1, len(ends)):
        for i in range(j):
            size = ends[j] - begin[i]
            if size <= limit and (size >= least or j == len(ends) - 1):
                best[j] = min(best[j], best[i] + splitting.IMBALANCE / limit**2 * 4 * (size - even) ** 2 + fine[j] + splitting.PIECE)
    found = doc.pieces(limit, overlap)
    cost = sum(splitting.IMBALANCE / limit**2 * 4 * (n - even) ** 2 + splitting.PIECE for _, _, n, _, _ in found) + sum(splitting.PENALTY[k] for *_, k in found[:-1])
    assert abs(cost - best[-1]) < 1e-9


# -- p2 ------------------------------------------------------------------------------------
def brute_neighbours(vecs, k, low):
    ids = sorted(vecs)
    m = np.array([np.array(vecs[i], dtype=np.float32).astype(np.float64) for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    out = set()
    for a, i in enumerate(ids):
        best = sorted(((-s[a, b], j) for b, j in enumerate(ids) if j != i))[:k]
        out |= {(i, j, r + 1) for r, (c, j) in enumerate(best) if -c >= low}
    return out


@pytest.mark.parametrize(("low", "block_rows"), [(None, 40), (0.85, 40), (None, 3)])
def test_neighbours_match_brute_force(spark, low, block_rows):
    rnd = np.random.default_rng(4)
    centers = rnd.standard_normal((12, 8))
    vecs = {i: (centers[i % 12] + 0.25 * rnd.standard_normal(8)).round(4).tolist() for i in range(150)}
    vecs |= {i: vecs[7] for i in range(200, 260)} | {i: vecs[8] for i in range(300, 303)}  # copies
    rows = [(i, v, "x") for i, v in vecs.items()] + [(900, None, "x"), (901, [0.0] * 8, "x"), (902, [1.0] * 7, "x"), (903, [float("nan")] + [1.0] * 7, "x"), (None, [1.0] * 8, "x"), (904, [1.0] * 7 + [None], "x")]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id string")
    got = {(r.id, r.other, r.rank) for r in neighbours.neighbours(df, k=5, dim=8, min_cosine=low, block_rows=block_rows).collect()}
    assert got == brute_neighbours(vecs, 5, -2 if low is None else low)
    if low is None:
        asked = {(r.id, r.other, r.rank) for r in neighbours.neighbours(df, k=5, dim=8, queries=F.expr("id % 10 = 0"), block_rows=block_rows).collect()}
        assert asked == {x for x in brute_neighbours(vecs, 5, -2) if x[0] % 10 == 0}
    assert neighbours.neighbours(df.limit(0), dim=8).count() == 0


# -- p4 ------------------------------------------------------------------------------------
FINDER = pii.Finder({"Brandel": "given", "Tosar": "family", "Will": "given", "Stone": "family"})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to a.b+c@mail.example.org, please", [("email", "a.b+c@mail.example.org")]),
        ("x (at) y(dot)test or jo dot do at site dot example.", [("email", "x (at) y(dot)test"), ("email", "jo dot do at site dot example")]),
        ("bumped tiny-queue@5.149.0, @lru_cache(1)", []),
        ("call +1 (496) 555 01 55 or 0049-30-23125830", [("phone", "+1 (496) 555 01 55"), ("phone", "0049-30-23125830")]),
        ("ticket 5488-58-5488, build 2025.47.06-4059, 10.1.0.177:8411, 555,028,110 rows", []),
        ("SSN 947 52 6604 and passport no. K5404807.", [("id_number", "947 52 6604"), ("id_number", "K5404807")]),
        ("Flat 2, 1640 Xaviand Ave last month", [("street_address", "Flat 2, 1640 Xaviand Ave")]),
        ("at 464 Xofur Rd. now; Xitherweg 137, noon; Via Xaviand 292", [("street_address", "464 Xofur Rd."), ("street_address", "Xitherweg 137"), ("street_address", "Via Xaviand 292")]),
        ("21 packages on lane 134 of the street map", []),
        ("Dr. Tosar signed it off. reviewed by P. Tosar today", [("person_name", "Tosar"), ("person_name", "P. Tosar")]),
        ("Mark the field and Will the loop exit? a stone cold cache", []),
        ("from Will Stone, who wrote it; assigned to Tosar, Brandel; ok", [("person_name", "Will Stone"), ("person_name", "Tosar, Brandel")]),
        ("OWNER BRANDEL TOSAR (see header)", [("person_name", "BRANDEL TOSAR")]),
        ("", []),
        (None, []),
    ],
)
def test_pieces_of_personal_data(text, want):
    assert [(k, text[a:b]) for a, b, k in FINDER.find(text)] == want


def test_long_text_is_read_to_its_end():
    text = "filler words go here. " * 20_000 + "mail me@there.example"
    assert [(k, text[a:b]) for a, b, k in FINDER.find(text)] == [("email", "me@there.example")]


def test_surrogates_are_distinct_consistent_and_formatted(spark):
    names = spark.createDataFrame([("Anna", "given"), ("Bert", "given"), ("Kohl", "family"), ("Lind", "family")], "word string, word_kind string")
    said = ["ask Anna Kohl about it", "assigned to Kohl, Anna; ok", "ANNA KOHL owns this module", "ask Bert Lind about it", "ask Anna Lind about it", "ask Bert Kohl about it", "call 312-555-0153 now", "call (312) 555-0153 now", None, ""]
    df = spark.createDataFrame([("q", i, 0, t) for i, t in enumerate(said)], "src string, rec_id bigint, block_no int, text string")
    got = {r.rec_id: r.text for r in surrogates.with_surrogates(df, names, "k").collect()}
    again = {r.rec_id: r.text for r in surrogates.with_surrogates(df, names, "k").collect()}
    assert got == again and got[9] == "" and got[8] is None
    name = got[0][4:-9]
    first, last = name.split(" ")
    assert got[1] == f"assigned to {last}, {first}; ok" and got[2].startswith(name.upper())
    assert len({got[i][4:-9] for i in (0, 3, 4, 5)}) == 4 and name != "Anna Kohl"
    assert [c for c in got[6] if c.isdigit()] == [c for c in got[7] if c.isdigit()] and got[7][5] == "("
    marked = {r.rec_id: r.text for r in pii.with_placeholders(df, names).collect()}
    assert marked[1] == "assigned to [PERSON_NAME]; ok" and marked[6] == "call [PHONE] now" and marked[8] is None


# -- p5 ------------------------------------------------------------------------------------
LINES = "row_id bigint, session_id string, line_type string, uuid string, parent_uuid string, ts string, is_sidechain boolean, message struct<role string, content string, blocks array<struct<block_type string, text string>>>, ingested_at timestamp, node string"


def line(uuid, parent, role="user", ts="2024-01-01T00:00:00Z", content="hi", side=None, blocks=None, kind="user", row=1):
    return (row, "s", kind, uuid, parent, ts, side, (role, content, blocks), None, "x")


def test_conversations(spark):
    rows = [
        line("a1", None), line("a2", "a1", " Assistant "), line("a3", "a2", None), line("a4", "a3", "assistant", content=None, blocks=[("tool_use", None)]),
        line("a4", "a3", "assistant", content=None, blocks=[("tool_use", None)], row=2),  # delivered twice
        line("b1", ""), line("b2", "b1", "assistant", ts="1704067201000"), line("b2x", "b1", "assistant", ts="2024-01-01T00:00:02+00:00"), line("b2y", "b1", "assistant", ts="N/A"),
        line("c1", None), line("c2", "c1", "assistant", content="  \n"),  # empty turn
        line("d1", None), line("d2", "d1", "user"), line("e1", None),  # wrong order, no reply
        line("f1", None, side=True), line("f2", "f1", "assistant"), line("g1", "gone"), line("g2", "g1", "assistant"),
        line("r1", "r2"), line("r2", "r1", "assistant"), line(None, None), line("", None),
    ]
    got = [(r.root_uuid, r.seq_no, r.uuid, r.role) for r in conversations.conversations(spark.createDataFrame(rows, LINES)).collect()]
    assert sorted(got) == [("a1", 1, "a1", "user"), ("a1", 2, "a2", "assistant"), ("a1", 3, "a3", "user"), ("a1", 4, "a4", "assistant"), ("b1", 1, "b1", "user"), ("b1", 2, "b2x", "assistant")]
    assert conversations.conversations(spark.createDataFrame([], LINES)).count() == 0


# -- p6 ------------------------------------------------------------------------------------
def test_mapping(spark):
    ref = spark.createDataFrame([(1, "budget-review", "Budget Review", ["money review", "BUREV"]), (2, "policy-review", "Policy Review", []), (3, "budget-review-europe", "Budget Review Europe", None)], "canon_id int, normalized_name string, label string, aliases array<string>")
    typed = [("Budget Review", 1), ("review of BUDGET (cont.)", 1), ("bugdet reveiw", 1), ("BudgetsReview", 1), ("policies review", 2), ("B.U.R.E.V", 1), ("burex", -1), ("monney-review", 1), ("Büdget  réview?", 1), ("budget review europe", 3), ("budget picnic", -1), ("misc", -1), ("", -1), (None, -1), ("bdgtrvw", -1), ("x" * 5000, -1)]
    rows = [(i, t, None, "x") for i, (t, _) in enumerate(typed)] + [(100, "misc", "policy-review", "x"), (None, "Budget Review", None, "x"), (0, "Budget Review", None, "x")]
    df = spark.createDataFrame(rows, "topic_id bigint, name string, normalized_name string, canon_id string")
    got = {r.topic_id: r.canon_id for r in canonical.map_values(df, ref, trails=("cont",)).collect()}
    assert got == {i: c for i, (_, c) in enumerate(typed)} | {100: 2}
    assert canonical.map_values(df.limit(0), ref).count() == 0 and {r.canon_id for r in canonical.map_values(df, ref.limit(0)).collect()} == {-1}


def test_short_spellings_ambiguity_and_free_word_order(spark):
    ref = spark.createDataFrame([(1, "berlin", "Berlin", ["NYC"]), (2, "siemens", "Siemens", []), (3, "nurse", "Nurse", []), (4, "new-york-city-of-dreams", "New York City of Dreams", None), (5, "Berlin", "berlin", []), (6, "oslo", "Oslo", [])], "canon_id int, normalized_name string, label string, aliases array<string>")
    typed = [("Berlni", 1), ("Simens", 2), ("nurze", 3), ("Siemenss", 2), ("Sie mens", 2), ("Brelni", -1), ("osla", -1), ("OSLO", 6), ("nyx", -1), ("N.Y.C", 1), ("dreams of new york city", 4), ("city of new dreams york", 4), ("new york city", -1), ("nurseryschool", -1)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(typed)], "topic_id int, name string")
    rows = canonical.map_values(df, ref, value_cols=("name",)).collect()
    assert {r.topic_id: r.canon_id for r in rows} == {i: c for i, (_, c) in enumerate(typed)}
    assert {r.topic_id for r in rows if r.ambiguous} == {0}


# -- p8 ------------------------------------------------------------------------------------
def test_leaks(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(40))) for i in range(30)] + [(90, None), (91, ""), (92, "too short"), (5, " ".join(vocab[:20]))]
    noise = [f"z{i}" for i in range(50)]
    docs = []
    for d in range(200):
        ws = [rnd.choice(noise) for _ in range(60)]
        if d % 3 == 0:
            w = rnd.choice(items[:30])[1].split()
            n, a = rnd.choice([12, 13, 14, 30, 40]), rnd.randint(0, 10)
            ws[20:20] = [x.upper() for x in w[a : a + n]]
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(ws), 7))
    docs += [(900, None, 7), (901, "", 7), (902, " ".join(vocab[:20]), 7), (902, " ".join(vocab[:20]), 7)]
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, doc int"), spark.createDataFrame(items, "item_id bigint, text string")).where("run_words >= 13").collect()}
    grams = lambda t: {tuple(w[i : i + 13]) for w in [leakage.words(t)] for i in range(len(w) - 12)}
    want = {(d, i) for d, t, _ in docs for i, u in items if grams(t) & grams(u)}
    assert got == want and (902, 5) in want
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert leakage.leaks(none, spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, doc int"), spark.createDataFrame([(1, None)], "item_id bigint, text string")).count() == 0
