"""Fusion of planned nodes and XML text of node tables, on literal documents and against the standard library's writer."""

from xml.etree import ElementTree

from quarry.operators import fusion as FU
from quarry.operators import xml_nodes as X

BASE = (
    '<PhaseNode Name="ph"><Serials><SerialNode Name="one"><Serials><ScriptNode Name="a" ClassName="A"><Args><Arg ArgName="DID"> </Arg><Arg ArgName="DID">second</Arg><Arg ArgName="Keep">k</Arg></Args></ScriptNode>'
    '<ScriptNode Name="b" ClassName="B" /></Serials></SerialNode></Serials></PhaseNode>'
)
PLAN = "doc int, step int, step_key string, row int, node string, class string, script_type string, dead_ms int, retry_times int, interupt_start string"
ARGS = "doc int, node string, ord int, arg string, value string"


def _plan(spark):
    plan = [(0, 1, "s1", 1, "a", "A2", "NORMAL", 0, 0, "false"), (0, 1, "s1", 2, "b", "", "NORMAL", 0, 0, "false"), (0, 2, "s2", 2, "z", "Z", "END", 5, 1, "true"), (0, 2, "s2", 1, "y", "Y", "NORMAL", 0, 0, "false"), (0, 3, "s3", 1, "w", "W&", "NORMAL", 0, 0, "false"), (9, 1, "s", 1, "a", "A", "NORMAL", 0, 0, "false")]
    args = [(0, "a", 1, "DID", "F190"), (0, "a", 2, "Keep", "other"), (0, "a", 3, "New", "<n>"), (0, "a", 4, "", "x"), (0, "b", 1, "Only", None), (0, "z", 1, "Q", "1")]
    return spark.createDataFrame(plan, PLAN), spark.createDataFrame(args, ARGS)


def _nodes(spark, xml=BASE):
    return X.node_table(spark.createDataFrame([(0, xml)], "doc int, xml string"))


def _indented(xml):
    root = ElementTree.fromstring(xml)
    ElementTree.indent(root, "  ")
    return ElementTree.tostring(root, encoding="unicode")


def test_text_of_node_tables(spark):
    docs = [BASE, "<a/>", "<a>t &amp; u<b x='&quot;1&lt;'>v</b></a>", "<a>  <b/>\n <c> <d>deep</d> </c></a>", "<a" + "".join(f' k{i}="{i}"' for i in range(40)) + "/>"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc int, xml string")
    plain = {r["doc"]: r["xml"] for r in FU.serialize(X.node_table(df), indent=False).collect()}
    assert plain[2] == '<a>t &amp; u<b x="&quot;1&lt;">v</b></a>' and plain[3] == "<a><b /><c><d>deep</d></c></a>"
    lines = {r["doc"]: r["xml"] for r in FU.serialize(X.node_table(df)).collect()}
    assert all(lines[i] == _indented(docs[i]) for i in (0, 1, 3, 4))


def test_fill_missing(spark):
    fused, args, stats = FU.fuse_workflow(_nodes(spark), *_plan(spark))
    (row,) = fused.collect()
    assert row["xml"] == _indented(
        '<PhaseNode Name="ph"><Serials><SerialNode Name="one"><Serials><ScriptNode Name="a" ClassName="A2"><Args><Arg ArgName="DID">F190</Arg><Arg ArgName="DID">second</Arg><Arg ArgName="Keep">k</Arg><Arg ArgName="New">&lt;n&gt;</Arg></Args></ScriptNode>'
        '<ScriptNode Name="b" ClassName="B"><Args><Arg ArgName="Only" /></Args></ScriptNode></Serials></SerialNode>'
        '<ParallelNode Name="s2_parallel" DeadMS="0"><Tasks><ScriptNode Name="y" DeadMS="0" RetryTimes="0" ScriptType="NORMAL" InteruptStart="false" ClassName="Y" /><ScriptNode Name="z" DeadMS="5" RetryTimes="1" ScriptType="END" InteruptStart="true" ClassName="Z"><Args><Arg ArgName="Q">1</Arg></Args></ScriptNode></Tasks></ParallelNode>'
        '<ScriptNode Name="w" DeadMS="0" RetryTimes="0" ScriptType="NORMAL" InteruptStart="false" ClassName="W&amp;" /></Serials></PhaseNode>'
    )
    assert sorted((r["node"], r["arg"], r["action"]) for r in args.collect()) == [("a", "DID", "updated"), ("a", "Keep", "kept"), ("a", "New", "appended"), ("b", "Only", "appended")]
    assert stats.collect()[0].asDict() == {"doc": 0, "root_tag": "PhaseNode", "matched_nodes": 2, "updated_nodes": 5, "inserted_nodes": 3, "missing_nodes": 0, "updated_args": 1, "appended_args": 2}


def test_overwrite_into_a_named_flow(spark):
    fused, args, stats = FU.fuse_workflow(_nodes(spark), *_plan(spark), mode="overwrite", serial="one", append_args=False, update_class=False, indent=False)
    xml = fused.first()["xml"]
    root = ElementTree.fromstring(xml)
    flow = root.find("Serials/SerialNode/Serials")
    assert [e.get("Name") for e in flow] == ["a", "b", "s2_parallel", "w"] and flow[0].get("ClassName") == "A" and [a.text for a in flow[0].iter("Arg")] == ["F190", "second", "other"]
    assert len(flow[1].find("Args")) == 0 and {r["action"] for r in args.collect()} == {"updated", "skipped"} and stats.first()["updated_args"] == 2


def test_missing_nodes_and_other_roots(spark):
    _, _, stats = FU.fuse_workflow(_nodes(spark), *_plan(spark), insert_missing=False)
    assert (stats.first()["missing_nodes"], stats.first()["inserted_nodes"]) == (3, 0)
    fused, _, _ = FU.fuse_workflow(_nodes(spark, '<Other><ScriptNode Name="a" /></Other>'), *_plan(spark), indent=False)
    root = ElementTree.fromstring(fused.first()["xml"])
    assert [e.get("Name") for e in root] == ["a", "b", "s2_parallel", "w"] and root[0].get("ClassName") == "A2"
    assert FU.fuse_workflow(_nodes(spark).limit(0), *_plan(spark))[0].collect() == []
