"""Fusion of planned script nodes into base workflows, and XML text of node tables, as events in order.

Every node of an XML document is two events, its start and its end, whose keys follow from its interval: a start stands at
(pre, 0), an end at (last, 2), deeper ends first. What is inserted into a node goes right before its end. So fusing is a
union of events and writing a sort within the document: no tree is built, and a document's events are its only group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.planning import _attributes, _escape
from quarry.sources.workspace import written

# Elements that hold a flow, and attributes of a script node in order with what the plan may say.
FLOWS = ["PhaseNode", "SerialNode"]
SCRIPT = [("Name", "node"), ("DeadMS", "dead_ms"), ("RetryTimes", "retry_times"), ("ScriptType", "script_type"), ("InteruptStart", "interupt_start"), ("ClassName", "class")]
WHITE = " \t\n\r\x0b\x0c"
KEY = ["k1", "k2", "k3", "k4"]


def _filled(value: Column) -> Column:
    """Text of a node that is not just white space, empty where there is none."""
    return F.when(F.btrim(F.coalesce(value, F.lit("")), F.lit(WHITE)) == "", F.lit("")).otherwise(_escape(value))


def _line(depth: Column, indent: bool) -> Column:
    return F.when(depth > 0, F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))).otherwise(F.lit("")) if indent else F.lit("")


def _ending(depth: Column, indent: bool) -> Column:
    return F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth)) if indent else F.lit("")


def events(nodes: DataFrame, filled: DataFrame | None = None, indent: bool = True) -> DataFrame:
    """doc, k1..k4, xml: start and end of every node; ``filled`` (doc, pre) names nodes that get children from elsewhere."""
    c = F.col
    parents = nodes.filter("parent IS NOT NULL").select("doc", c("parent").alias("pre"))
    if filled is not None:
        parents = parents.unionByName(filled.select("doc", "pre"))
    made = nodes.filter("pre >= 0").join(parents.distinct().withColumn("holds", F.lit(True)), ["doc", "pre"], "left")
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), _escape(F.coalesce(a["value"], F.lit("")), True), F.lit('"'))), "")
    # White space between elements is made anew; that of a leaf is its text.
    text = F.when(c("holds"), _filled(c("text"))).otherwise(_escape(F.coalesce("text", F.lit(""))))
    bare = c("holds").isNull() & (text == "")
    start = F.concat(_line(c("depth"), indent), F.lit("<"), "tag", attrs, F.when(bare, F.lit(" />")).otherwise(F.concat(F.lit(">"), text)))
    end = F.when(bare, F.lit("")).otherwise(F.concat(F.when(c("holds"), _ending(c("depth"), indent)).otherwise(F.lit("")), F.lit("</"), "tag", F.lit(">")))
    one = lambda k1, k2, k3, xml: F.struct(k1.cast("int").alias("k1"), F.lit(k2).alias("k2"), k3.cast("int").alias("k3"), F.lit(0).alias("k4"), xml.alias("xml"))
    return made.select("doc", F.inline(F.array(one(c("pre"), 0, F.lit(0), start), one(c("last"), 2, -2 * c("depth"), F.concat(end, _filled(c("tail")))))))


def inserted(place: str, depth: str) -> list[Column]:
    """Keys k1, k2, k3 right before the end of a node, given its last place and depth."""
    return [F.col(place).cast("int").alias("k1"), F.lit(2).alias("k2"), (-2 * F.col(depth) - 1).cast("int").alias("k3")]


def written_out(rows: DataFrame) -> DataFrame:
    """doc and xml from events."""
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*KEY, "xml"))), lambda x: x["xml"]), "").alias("xml"))


def serialize(nodes: DataFrame, indent: bool = True) -> DataFrame:
    """doc and xml of a node table; white space between elements is made anew."""
    return written_out(events(nodes, None, indent))


def insert_parent(nodes: DataFrame, serial: str | None = None) -> DataFrame:
    """doc, pre, last, depth of the node that takes new script nodes: the serials of the named serial node, of the root, or the root."""
    c = F.col
    flows = nodes.filter(c("tag").isin(FLOWS) & ((c("pre") == 0) | ((c("tag") == "SerialNode") & (c("attrs")["Name"] == (serial or "")))))
    held = nodes.filter("tag = 'Serials'").select("doc", c("parent").alias("flow"), "pre", "last", "depth")
    found = flows.select("doc", c("pre").alias("flow"), ((c("tag") == "SerialNode") & (c("attrs")["Name"] == F.lit(serial))).alias("named")).join(held, ["doc", "flow"])
    root = nodes.filter("pre = 0").select("doc", F.lit(0).alias("flow"), F.lit(False).alias("named"), "pre", "last", "depth")
    # The named flow before the root's serials before the root; in one flow the first.
    rank = F.struct((~F.coalesce("named", F.lit(False))).alias("other"), (c("pre") == 0).alias("bare"), c("flow").alias("f"), c("pre").alias("p"))
    best = found.unionByName(root).groupBy("doc").agg(F.min_by(F.struct("pre", "last", "depth"), rank).alias("x"))
    return best.select("doc", "x.*")


def fuse_workflow(nodes: DataFrame, plan: DataFrame, plan_args: DataFrame, mode: str = "fill_missing", insert_missing: bool = True, append_args: bool = True, update_class: bool = True, serial: str | None = None, indent: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fused, args, stats): XML by document, what became of each planned argument, and counts by document.

    ``nodes`` is the node table of the base workflows. ``plan`` has doc, step (order), step_key, row, node, class,
    script_type, dead_ms, retry_times and interupt_start; ``plan_args`` doc, node, ord, arg (unique by node) and value. A planned
    node is merged into the first script node of its name: ``fill_missing`` fills empty arguments, ``overwrite`` all that
    differ; null values change nothing; unknown arguments are appended. Nodes that the base lacks are appended to the flow
    by step, those of one step as tasks of a parallel node by (row, name). Of planned nodes of one name the first is merged.
    """
    c = F.col
    # Scripts, boxes, arguments, parents and events all read the nodes: written first, no document is parsed twice.
    nodes = written(nodes, "workflow-nodes")
    base = nodes.filter("pre >= 0")
    w = Window.partitionBy("doc", "name").orderBy("pre")
    scripts = base.filter("tag = 'ScriptNode'").withColumn("name", c("attrs")["Name"]).filter("name <> ''").withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    scripts = scripts.select("doc", c("name").alias("node"), c("pre").alias("script"), c("last").alias("script_last"), c("depth").alias("script_depth"), c("attrs")["ClassName"].alias("base_class"))
    boxes = base.filter("tag = 'Args'").groupBy("doc", c("parent").alias("script")).agg(F.min_by(F.struct("pre", "last", "depth"), "pre").alias("box"))
    held = base.filter("tag = 'Arg'").select("doc", c("parent").alias("box_pre"), c("attrs")["ArgName"].alias("arg"), "pre", "text").filter("arg <> ''")
    held = held.groupBy("doc", "box_pre", "arg").agg(F.min_by(F.struct("pre", "text"), "pre").alias("held"))

    first = Window.partitionBy("doc", "node").orderBy("step", "row")
    asked = plan.join(base.filter("pre = 0").select("doc"), "doc", "left_semi").withColumn("nth", F.row_number().over(first)).join(scripts, ["doc", "node"], "left").join(boxes, ["doc", "script"], "left")
    merged, absent = asked.filter("script IS NOT NULL AND nth = 1"), asked.filter("script IS NULL")
    args = plan_args.filter("arg <> ''").join(merged.select("doc", "node", "script", "script_last", "script_depth", "box"), ["doc", "node"]).withColumn("box_pre", c("box.pre")).join(held, ["doc", "box_pre", "arg"], "left")
    current = F.btrim(F.coalesce("held.text", F.lit("")), F.lit(WHITE))
    due = F.lit(True) if mode == "overwrite" else current == ""
    does = F.when(c("held").isNull(), F.lit("appended" if append_args else "skipped")).when(c("value").isNotNull() & due & (current != c("value")), "updated").otherwise("kept")
    args = args.withColumn("action", does)

    counts = args.groupBy("doc", "node").agg(F.count_if(c("action") == "updated").alias("updated_args"), F.count_if(c("action") == "appended").alias("appended_args"), F.lit(True).alias("has_args"))
    reclass = (F.coalesce("class", F.lit("")) != "") & ~c("class").eqNullSafe(c("base_class")) if update_class else F.lit(False)
    new_box = merged.join(plan_args.select("doc", "node").distinct(), ["doc", "node"], "left_semi").filter("box IS NULL")
    boxed = new_box.select("doc", "node", F.lit(True).alias("boxed"))
    each = merged.withColumn("reclass", reclass).join(counts, ["doc", "node"], "left").join(boxed, ["doc", "node"], "left").fillna(0, ["updated_args", "appended_args"])
    changed = c("reclass") | (c("updated_args") + c("appended_args") > 0) | F.coalesce("boxed", F.lit(False))
    of_merged = each.groupBy("doc").agg(F.count("*").alias("matched_nodes"), F.count_if(changed).alias("changed"), F.sum("updated_args").alias("updated_args"), F.sum("appended_args").alias("appended_args"))
    of_absent = absent.groupBy("doc").agg(F.count("*").alias("absent"))
    stats = base.filter("pre = 0").select("doc", c("tag").alias("root_tag")).join(of_merged, "doc", "left").join(of_absent, "doc", "left").fillna(0)
    put = c("absent") if insert_missing else F.lit(0)
    stats = stats.select("doc", "root_tag", "matched_nodes", (c("changed") + put).alias("updated_nodes"), put.cast("long").alias("inserted_nodes"), (c("absent") - put).alias("missing_nodes"), "updated_args", "appended_args")

    # Changed texts and class names are laid over the base's nodes.
    texts = args.filter("action = 'updated'").select("doc", c("held.pre").alias("pre"), c("value").alias("new_text"))
    classes = each.filter("reclass").select("doc", c("script").alias("pre"), c("class").alias("new_class"))
    over = nodes.join(texts, ["doc", "pre"], "left").join(classes, ["doc", "pre"], "left")
    renamed = F.map_concat(F.map_filter("attrs", lambda k, v: (k != "ClassName") | c("new_class").isNull()), F.when(c("new_class").isNotNull(), F.create_map(F.lit("ClassName"), c("new_class"))).otherwise(F.create_map().cast("map<string,string>")))
    over = over.withColumns({"text": F.coalesce("new_text", "text"), "attrs": renamed}).drop("new_text", "new_class")

    def arg_xml(depth: Column) -> Column:
        inner = F.when(F.coalesce("value", F.lit("")) == "", F.lit(" />")).otherwise(F.concat(F.lit(">"), _escape(c("value")), F.lit("</Arg>")))
        return F.concat(_line(depth, indent), F.lit("<Arg"), _attributes(ArgName=c("arg")), inner)

    in_box = args.filter("action = 'appended' AND box IS NOT NULL").withColumns({"at": c("box.last"), "deep": c("box.depth")})
    parts = [in_box.select("doc", *inserted("at", "deep"), c("ord").cast("int").alias("k4"), arg_xml(c("deep") + 1).alias("xml"))]
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "xml"))), lambda x: x["xml"]), "")
    fresh = args.filter("action = 'appended' AND box IS NULL").withColumn("xml", arg_xml(c("script_depth") + 2)).groupBy("doc", "script_last", "script_depth").agg(ordered.alias("inner"))
    bare = new_box.select("doc", "script_last", "script_depth").join(fresh, ["doc", "script_last", "script_depth"], "left")
    box_line, box_end = _line(c("script_depth") + 1, indent), _ending(c("script_depth") + 1, indent)
    parts.append(bare.select("doc", *inserted("script_last", "script_depth"), F.lit(0).alias("k4"), F.when(c("inner").isNull(), F.concat(box_line, F.lit("<Args />"))).otherwise(F.concat(box_line, F.lit("<Args>"), "inner", box_end, F.lit("</Args>"))).alias("xml")))
    filled = in_box.select("doc", c("box.pre").alias("pre")).unionByName(new_box.select("doc", c("script").alias("pre")))
    if insert_missing:
        parent = insert_parent(base, serial)
        n = F.count("*").over(Window.partitionBy("doc", "step"))
        placed = absent.withColumn("n", n).drop("box", "script", "script_last", "script_depth").join(parent.select("doc", c("pre").alias("parent"), c("last").alias("at"), c("depth").alias("deep")), "doc")
        placed = placed.withColumn("depth", c("deep") + F.when(c("n") > 1, 3).otherwise(1))
        own = placed.select("doc", "step", "row", "node", "depth").join(plan_args, ["doc", "node"]).withColumn("xml", arg_xml(c("depth") + 2))
        listed = own.groupBy("doc", "step", "row", "node").agg(ordered.alias("inner"))
        made = placed.join(listed, ["doc", "step", "row", "node"], "left")
        attrs = _attributes(**{k: c(v) for k, v in SCRIPT})
        body = F.when(c("inner").isNull(), F.lit(" />")).otherwise(F.concat(F.lit(">"), _line(c("depth") + 1, indent), F.lit("<Args>"), "inner", _ending(c("depth") + 1, indent), F.lit("</Args>"), _ending(c("depth"), indent), F.lit("</ScriptNode>")))
        made = made.withColumn("xml", F.concat(_line(c("depth"), indent), F.lit("<ScriptNode"), attrs, body))
        tasks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "node", "xml"))), lambda x: x["xml"]), "")
        steps = made.groupBy("doc", "step", "at", "deep").agg(tasks.alias("tasks"), F.count("*").alias("n"), F.min_by("step_key", F.struct("row", "node")).alias("step_key"))
        name = F.concat("step_key", F.lit("_parallel"))
        both = F.concat(_line(c("deep") + 1, indent), F.lit("<ParallelNode"), _attributes(Name=name, DeadMS=F.lit(0)), F.lit(">"), _line(c("deep") + 2, indent), F.lit("<Tasks>"), "tasks", _ending(c("deep") + 2, indent), F.lit("</Tasks>"), _ending(c("deep") + 1, indent), F.lit("</ParallelNode>"))
        parts.append(steps.select("doc", *inserted("at", "deep"), c("step").cast("int").alias("k4"), F.when(c("n") == 1, c("tasks")).otherwise(both).alias("xml")))
        filled = filled.unionByName(placed.select("doc", c("parent").alias("pre")))
    rows = events(over, filled, indent)
    for p in parts:
        rows = rows.unionByName(p)
    return written_out(rows), args.select("doc", "node", "arg", F.when(c("action").isin("updated", "appended"), c("value")).otherwise(c("held.text")).alias("value"), "action"), stats
