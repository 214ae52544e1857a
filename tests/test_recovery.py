"""Recovery of JSON from model text against the standard library, on replies that are cut, fenced, nested, doubled or escaped."""

import json

from pyspark.sql import functions as F

from quarry.operators import recovery as R

GOOD = {"node_name": "a", "class_name": "C", "xml": '<ScriptNode Name="x">"{}"</ScriptNode>', "args": [{"name": "DID", "value": "}{"}], "evidence_map": {"DID": ["e1"]}, "confidence": 0.5, "needs_review": True, "missing_or_conflict_reason": "tab\t \\ \"quoted\" é 日本"}


def test_objects(spark):
    one = json.dumps(GOOD)
    texts = [
        one, f"```json\n{one}\n```", f"```\n{one}```", f"Sure: {one} done.", f"{one}\n{one}", json.dumps(GOOD, indent=2, ensure_ascii=False), one[:-5], "no json", "", None, "{broken} " + one, "[1, 2]", "{}", '{"a": "}"}', '{"a": {"b": {"c": "\\\\"}}} tail }',
        '{"long": "' + "x\\n" * 20_000 + '"}',
    ]
    got = [(r["object"], r["found_by"]) for r in R.json_object(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect()]
    assert [by for _, by in got] == ["whole", "whole", "whole", "span", "balanced", "whole", None, None, None, None, None, None, "whole", "whole", "balanced", "whole"]
    assert all(json.loads(got[k][0]) == GOOD for k in range(6)) and got[12][0] == "{}" and json.loads(got[14][0]) == {"a": {"b": {"c": "\\"}}}
    assert json.loads(got[15][0]) == json.loads(texts[15])


def test_fields_of_malformed_replies(spark):
    one = json.dumps(GOOD, ensure_ascii=False)
    replies = [one, one.replace('"confidence"', "confidence"), one[: one.index('"needs_review"')], "```json\n" + one.replace('"xml": "', '"xml": broken "'), "<ScriptNode Name=&quot;y&quot;>\n</ScriptNode> only", "nothing", None]
    df = spark.createDataFrame([(i, t, "default", "class") for i, t in enumerate(replies)], "i int, text string, default_name string, default_class string")
    got = R.recovered(df).orderBy("i").collect()
    assert [r["status"] for r in got] == ["parsed", "recovered", "recovered", "recovered", "recovered", "failed", "failed"]
    assert got[0]["reason"] == GOOD["missing_or_conflict_reason"] == got[1]["reason"] and got[0]["needs_review"] and got[1]["needs_review"] and not got[2]["needs_review"]
    assert [r["confidence"] for r in got] == [0.5, 0.75, 0.5, 0.5, 0.75, 0.75, 0.75] and [r["node_name"] for r in got] == ["a", "a", "a", "a", "default", "default", "default"]
    assert all(r["xml"] == GOOD["xml"] for r in got[:3]) and got[4]["xml"] == '<ScriptNode Name="y">\n</ScriptNode>'
    assert json.loads(got[0]["args"]) == GOOD["args"] and json.loads(got[2]["evidence_map"]) == GOOD["evidence_map"] and got[5]["args"] is None
    assert R.recovered(df.limit(0)).collect() == []


def test_escapes(spark):
    rows = [('{"s": "a\\"b\\\\ \\u00e9"}', 'a"b\\ é'), ('{"s": " spaced "}', "spaced"), ('{"s": "cut', ""), ('{"other": 1}', ""), ('{"s": "bad \\x"}', "")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", R.string_field(F.col("t"), "s").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
