from quarry.operators import candidates as C


def test_nodes_that_say_the_same_are_scored_once(spark, monkeypatch):
    nodes = [(1, "BCM_DTC_Read_1", None, ["dtc read"]), (2, "BCM_DTC_Read_1", None, ["dtc read"]), (3, "BCM_DTC_Read_1", "T", ["dtc read"]), (4, "x", "", [])]
    rows = [(i, t, "", "BCM", None, "table_row", []) for i, t in enumerate(["the dtc read of it", "dtc clear", "other words"])]
    evidence = spark.createDataFrame(rows, "evidence_id int, content string, title string, unit string, module string, role string, fields array<struct<header:string,cell:string>>")
    pairs, score = [], C.relevance
    monkeypatch.setattr(C, "relevance", lambda p: pairs.append(p) or score(p))
    found = C.task_candidates(spark.createDataFrame(nodes, "node int, name string, template string, aliases array<string>"), evidence, 2).collect()
    assert sum(p.count() for p in pairs) == 3 * len(rows)
    of = lambda n: sorted((r["rank"], r["evidence_id"], r["score"]) for r in found if r["node"] == n)
    assert len(of(1)) == 2 and of(1) == of(2) and of(1)[0][1] == 0
    assert {r["node"] for r in found} == {1, 2, 3}  # no score of the last one is above 0
