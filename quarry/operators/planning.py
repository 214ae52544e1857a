"""Workflow plans: positions, argument merge, template families and XML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Endings of class names that name a template family, and words kept in capitals.
FAMILY = r"(?i)(DTC_Clear_Type\d+|DTC_Read_Type\d+|IO_Control_Type\d+|Routine_Control_Type\d+|Information_Read_Type\d+|Information_Write_Type\d+|Request_Open_HV_Battery|VMM_Change)$"
CAPITALS = ["DTC", "IO", "VMM", "HV"]


def positions(nodes: DataFrame, by: str, order: list[str], boundary: bool = True) -> DataFrame:
    """Adds position, total and script_type: START for the first of a plan, END for the last, NORMAL between or alone."""
    w = Window.partitionBy(by).orderBy(*order)
    out = nodes.withColumn("position", F.row_number().over(w)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(by)))
    ends = F.when(F.col("total") == 1, "NORMAL").when(F.col("position") == 1, "START").when(F.col("position") == F.col("total"), "END").otherwise("NORMAL")
    return out.withColumn("script_type", ends if boundary else F.lit("NORMAL"))


def merge_args(defaults: DataFrame, generated: DataFrame) -> DataFrame:
    """node, arg, value: generated values over defaults, where an absent one keeps the default; unique by (node, arg) on each side."""
    d, g = defaults.select("node", "arg", F.col("value").alias("d")), generated.select("node", "arg", F.col("value").alias("g"))
    return d.join(g, ["node", "arg"], "full").select("node", "arg", F.coalesce("g", "d").alias("value"))


def family_id(class_name: Column) -> Column:
    """Family that a class name ends in, in canonical case; other names stay, with separators as one underscore."""
    name = F.regexp_replace(F.regexp_replace(F.coalesce(class_name, F.lit("")), "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")

    def cased(p: Column) -> Column:
        kind = F.when(p.rlike(r"(?i)^type\d+$"), F.concat(F.lit("Type"), F.regexp_replace(p, "[^0-9]", "")))
        return kind.when(F.upper(p).isin(CAPITALS), F.upper(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))

    found = F.regexp_extract(name, FAMILY, 1)
    return F.when(found != "", F.array_join(F.transform(F.split(found, "_"), cased), "_")).when(name != "", name).otherwise("unknown_template_family")


def families(templates: DataFrame) -> DataFrame:
    """family, number of templates and of classes, of (template, class)."""
    return templates.groupBy(family_id(F.col("class")).alias("family")).agg(F.countDistinct("template").alias("n_templates"), F.countDistinct("class").alias("n_classes"))


def _escape(value: Column, quoted: bool = False) -> Column:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"),) if quoted else ()):
        value = F.replace(value, F.lit(raw), F.lit(ref))
    return value


def _attributes(**values: Column) -> Column:
    return F.concat(*[F.concat(F.lit(f' {k}="'), _escape(F.coalesce(v.cast("string"), F.lit("")), True), F.lit('"')) for k, v in values.items()])


def _in_order(by: Column, text: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by.alias("o"), text.alias("t")))), lambda x: x["t"]), "")


def render(nodes: DataFrame, args: DataFrame) -> DataFrame:
    """plan and xml: serial node of the plan; nodes that share a step are tasks of a parallel node.

    ``nodes`` has plan, step, row, node, class and script_type; ``args`` has plan, node, position, arg and value.
    A node, a step and a plan are documents of their own, so each collected group is one document's content.
    """
    value = F.when(F.col("value").isNull(), " />").otherwise(F.concat(F.lit(">"), _escape(F.col("value")), F.lit("</Arg>")))
    arg = F.concat(F.lit("<Arg"), _attributes(ArgName=F.col("arg")), value)
    inner = args.groupBy("plan", "node").agg(_in_order(F.col("position"), arg).alias("args"))
    attrs = _attributes(Name=F.col("node"), DeadMS=F.lit(0), RetryTimes=F.lit(0), ScriptType=F.col("script_type"), ClassName=F.col("class"))
    tail = F.when(F.col("args").isNull(), " />").otherwise(F.concat(F.lit("><Args>"), F.col("args"), F.lit("</Args></ScriptNode>")))
    scripts = nodes.join(inner, ["plan", "node"], "left").withColumn("script", F.concat(F.lit("<ScriptNode"), attrs, tail))
    steps = scripts.groupBy("plan", "step").agg(_in_order(F.struct("row", "node"), F.col("script")).alias("tasks"), F.count("*").alias("n"))
    name = F.concat(F.lit("step_"), F.col("step").cast("string"), F.lit("_parallel"))
    body = F.when(F.col("n") == 1, F.col("tasks")).otherwise(F.concat(F.lit("<ParallelNode"), _attributes(Name=name, DeadMS=F.lit(0)), F.lit("><Tasks>"), F.col("tasks"), F.lit("</Tasks></ParallelNode>")))
    whole = steps.groupBy("plan").agg(_in_order(F.col("step"), body).alias("body"))
    return whole.select("plan", F.concat(F.lit("<SerialNode"), _attributes(Name=F.col("plan"), DeadMS=F.lit(0)), F.lit("><Serials>"), F.col("body"), F.lit("</Serials></SerialNode>")).alias("xml"))
