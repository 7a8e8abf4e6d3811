"""Recall of paraphrases at every offset of the passage grid."""

import random

import pytest

from palimpsest.llm import leakage


@pytest.mark.parametrize("every", [7, 9, 12])
def test_paraphrases_are_found_at_every_offset(spark, every):
    rnd = random.Random(every)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(26, 70)))) for i in range(40)]
    docs, want = [], set()
    for d in range(120):
        i, text = items[d % 40]
        ws = [f"q{d}x{n}" if n % every == d % every else w for n, w in enumerate(text.split())]
        before, after = ([f"z{rnd.randint(0, 60)}" for _ in range(n)] for n in (40 + d % 29, 50))
        docs.append((d, " ".join(before + ws + after)))
        want.add((d, i))
        docs.append((1000 + d, " ".join(before + text.split()[:12] + after)))  # too little
    docs.append((2000, " ".join(items[0][1].split()[:-8][k] if k % 9 else "q" for k in range(len(items[0][1].split()) - 8))))  # without the answer
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.run_words == every - 1 and r.shared_words >= 13 for r in got)


def test_short_items_long_runs_and_foreign_words(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(200)]
    long = [rnd.choice(vocab) for _ in range(60)]
    short = "which river runs through the old town of nowhere".split()
    items = [(1, " ".join(long)), (2, " ".join(short)), (3, "count the bricks"), (4, None), (5, "")]
    noise = lambda n: [f"z{rnd.randint(0, 99)}" for _ in range(n)]
    foreign = [w if n % 8 else f"q{n}" for n, w in enumerate(long)]  # one word in eight is in no item
    docs = [
        (1, " ".join(noise(30) + long + noise(9))), (2, " ".join(noise(77) + short + noise(5)).upper()), (3, " ".join(noise(20) + short[:-1] + noise(20))),
        (4, " ".join(noise(40) + foreign + noise(40))), (5, "now count the bricks"), (6, None), (7, ""), (8, " ".join(short)), (9, " ".join(long[5:45])),
    ]
    ins = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.run_words, r.shared_words) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), ins).collect()}
    assert set(got) == {(1, 1), (2, 2), (4, 1), (8, 2), (9, 1)}
    assert got[1, 1] == (60, 0) and got[2, 2] == (9, 0) and got[9, 1] == (40, 0) and got[4, 1][0] == 7 and got[4, 1][1] >= 21
    with pytest.raises(ValueError):
        leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), ins, min_words=40)
