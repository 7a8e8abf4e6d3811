import random

from palimpsest.operators.hierarchy import descendants, hierarchy

SCHEMA = "uuid string, parent_uuid string, id bigint, root string"


def frame(spark, links):
    return spark.createDataFrame([(a, b, 1, "x") for a, b in links], SCHEMA)  # id and root clash with our own names


def brute(links):
    up = {}
    for a, b in links:
        if a:
            up[a] = max(up.get(a) or "", b or "") or None
    out = {}
    for a in up:
        seen, x, d = {a}, a, 0
        while up[x] in up and up[x] is not None:
            x, d = up[x], d + 1
            if x in seen:
                x = None
                break
            seen.add(x)
        out[a] = (x, d) if x else ("", -1)
    return out


def test_random_forests_with_rings(spark):
    rnd = random.Random(3)
    for n, every in ((1, 8), (60, 2), (300, 8), (300, 1000)):
        names = [f"n{i}" for i in range(n)]
        links = [(x, rnd.choice([*names[: max(1, i)], None, "", "gone", rnd.choice(names)])) for i, x in enumerate(names)]
        links += links[: n // 5] + [(None, "n0"), ("", "n0")]
        got = {r.node: (r.root, r.depth) for r in hierarchy(frame(spark, links), splitter_every=every).collect()}
        assert got == brute(links)


def test_long_chain_and_hot_parent(spark):
    links = [(f"c{i:04}", f"c{i - 1:04}" if i else None) for i in range(700)] + [(f"k{i}", "c0000") for i in range(500)]
    got = {r.node: r for r in hierarchy(frame(spark, links)).collect()}
    assert got["c0699"].depth == 699 and got["c0699"].root == "c0000" and got["k7"].depth == 1


def test_paths_and_descendants(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("r", "s"), ("s", "r"), ("t", "r"), ("self", "self")]
    got = {r.node: r for r in hierarchy(frame(spark, links), paths=True).collect()}
    assert got["c"].path == ["a", "b", "c"] and got["a"].n_descendants == 3 and got["b"].n_descendants == 1
    assert all(got[x].in_ring and got[x].path is None and got[x].root == "" for x in ("r", "s", "t", "self"))
    pairs = {(r.ancestor, r.descendant, r.distance) for r in descendants(frame(spark, links)).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}


def test_empty_table(spark):
    assert hierarchy(frame(spark, [])).count() == 0
