import json

from palimpsest.streaming import deadends


def test_loop_routes_each_query_once(spark, tmp_path):
    inbox, out = tmp_path / "inbox", tmp_path / "out"
    inbox.mkdir()
    rows = [("what is a ledger?", 1), ("stale cache", 2), ("stale cache", 3), ("ab", 4)]
    text = "\n".join(json.dumps({"timestamp": f"2024-01-01T00:00:0{i}Z", "query": q, "namespace": "g"}) for q, i in rows)
    (inbox / "1.json").write_text(text + "\n{broken\n")
    deadends.run(spark, str(inbox), str(out), str(tmp_path / "state")).awaitTermination()
    (inbox / "2.json").write_text(json.dumps({"timestamp": "2024-01-01T00:01:00Z", "query": "stale cache"}) + "\n" + json.dumps({"timestamp": "2024-01-01T00:01:01Z", "query": "new thing"}) + "\n")
    deadends.run(spark, str(inbox), str(out), str(tmp_path / "state")).awaitTermination()
    got = {name: sorted(r.query for r in spark.read.json(str(out / name)).collect()) for name in ("pending", "review", "discarded")}
    assert got == {"pending": ["new thing", "stale cache"], "review": ["what is a ledger?"], "discarded": ["ab"]}


def test_grown_queues(spark):
    n = lambda rows: spark.createDataFrame(rows, "queue string, n int")
    assert {tuple(r) for r in deadends.grown(n([("a", 1), ("b", 5)]), n([("a", 2), ("b", 5), ("c", 1)])).collect()} == {("a", 2), ("c", 1)}
