"""Plan arguments from evidence: which argument a table header fills, its normal value, and the best source for each.

Sources are one row per (node, evidence) with score, role, unit name and fields; every choice is an aggregate per node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import cleaned

# Known unit prefixes, header synonyms of the arguments, their order, weights and hexadecimal widths.
UNITS = ["ADCU", "ASDM", "BCM", "CMD", "CMP", "ECM", "FAH", "HCML", "HCMR", "TCAM", "WPC", "ZCUD"]
HEADERS = {
    "DID": ["DID"], "RID": ["RID"], "DTC": ["DTC"], "ServiceID": ["SERVICE", "SERVICE_ID", "SERVICEID"], "RequestParameter": ["REQUEST_PARAMETER", "PARAMETER"], "Source": ["SOURCE"], "Target": ["TARGET"],
    "ReadDID": ["READ_DID"], "ResultCheckDID": ["DID_FOR_IO_CONTROL_RESULT_CHECK"], "ExpectedValue": ["EXPECTED_VALUE"], "DataType": ["DATA_TYPE", "DATATYPE", "DATA_INFO"], "DataLength": ["DATA_LENGTH", "DATA_TYPE_AND_LENGTH", "LEN"],
    "Description": ["DESCRIPTION"], "Timeout": ["TIMEOUT", "TIME_OUT"], "AllowedNRC": ["ALLOWED_NRC"], "WrittenFlag": ["WRITTENFLAG", "WRITTEN_FLAG"], "CheckMethod": ["CHECK_METHOD", "CHECEK_METHOD", "CHEC_K_METHOD"],
    "Comment": ["COMMENT"], "Remark": ["REMARK"], "FlowchartTitle": ["FLOWCHART_TITLE"],
}
ORDER = ["DID", "RID", "ServiceID", "RequestParameter", "Source", "Target", "ReadDID", "ResultCheckDID", "ExpectedValue", "FlowchartTitle", "Description", "DataType", "DataLength", "Timeout", "DTC", "CheckMethod", "WrittenFlag", "AllowedNRC", "Comment", "Remark"]
WEIGHTS = {"DID": 6.0, "RID": 6.0, "ServiceID": 6.0, "RequestParameter": 5.0, "Source": 4.0, "Target": 4.0, "FlowchartTitle": 3.0, "ExpectedValue": 2.0, "ReadDID": 2.0, "ResultCheckDID": 2.0}
WIDTHS = {"DID": 4, "RID": 4, "ReadDID": 4, "ResultCheckDID": 4, "DTC": 6, "RequestParameter": 2, "ServiceID": 2}
IDENTIFIERS = ["DID", "RID", "ReadDID", "ResultCheckDID", "DTC", "ServiceID"]
UNIT_BONUS, UNIT_PRIOR, DEFAULT_SCORE = 8.0, 12.0, 10.0
CLEAR_SERVICE, READ_DID_TYPE1 = "0x19", "0x3101"


def key_of(value: Column) -> Column:
    """Letters and digits with single underscores between, upper-cased."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))


def _lookup(value: Column, table: dict, otherwise: Column) -> Column:
    return reduce(lambda c, kv: c.when(value == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), otherwise)).otherwise(otherwise)


def argument_of(header: Column) -> Column:
    """The argument that a header stands for, else an empty string."""
    return _lookup(key_of(header), {h: a for a, hs in HEADERS.items() for h in hs}, F.lit(""))


def hex_of(value: Column, width: Column) -> Column:
    """Hexadecimal digits as ``0x`` and at least ``width`` of them; other values only trimmed and upper-cased; no width leaves all."""
    bare = F.regexp_replace(F.upper(F.trim(value)), "^0X", "")
    full = F.when(F.length(bare) >= width, bare).otherwise(F.lpad(bare, width, F.lit("0")))
    return F.when(width.isNull(), value).when(bare.rlike("^[0-9A-F]+$"), F.concat(F.lit("0x"), full)).otherwise(bare)


def is_unit(value: Column) -> Column:
    upper = F.upper(value)
    return ~F.startswith(upper, F.lit("GEEA")) & reduce(lambda a, b: a | b, [F.startswith(upper, F.lit(u)) for u in UNITS])


def unit_of(name: Column, template: Column) -> Column:
    """The unit that a node's name, else its template's, begins with; else an empty string."""
    first = lambda c: F.substring_index(F.coalesce(c, F.lit("")), "_", 1)
    return F.when(is_unit(first(name)), F.upper(first(name))).when(is_unit(first(template)), F.upper(first(template))).otherwise(F.lit(""))


def _parts(value: Column) -> Column:
    return F.transform(F.split(F.upper(value), "[^0-9A-Z]+"), lambda p: p)


def unit_fits(value: Column, node_unit: Column) -> Column:
    """A source's unit fits the node's: it begins with it, or holds it as a word."""
    return F.startswith(F.upper(value), F.upper(node_unit)) | F.array_contains(_parts(value), key_of(node_unit))


def request_parameter(value: Column, node: Column, template: Column) -> Column:
    """One code of a request parameter: ``NA``, a bare code, or of ``code: label`` options the wanted one, else the first."""
    two = F.lit(2)
    options = F.transform(F.regexp_extract_all(value, F.lit(r"0x[0-9A-Fa-f]{2,8}\s*:(?:(?!0x[0-9A-Fa-f]{2,8}\s*:).)*"), F.lit(0)), lambda o: F.struct(F.regexp_extract(o, "^0x[0-9A-Fa-f]+", 0).alias("code"), F.regexp_replace(o, r"^[^:]*:", "").alias("label")))
    task = F.regexp_replace(F.lower(F.concat_ws(" ", node, template)), "_", " ")
    word = F.when(F.contains(task, F.lit("usage mode change")), F.lit("active")).when(F.contains(task, F.lit("car mode change")), F.lit("normal"))
    wanted = F.filter(options, lambda o: F.coalesce(F.regexp_like(F.lower(o["label"]), F.concat(F.lit(r"\b"), word, F.lit(r"\b"))), F.lit(False)))
    code = F.coalesce(F.get(wanted, F.lit(0))["code"], F.get(options, F.lit(0))["code"])
    return F.when(F.upper(value) == "NA", F.lit("NA")).when(F.trim(value).rlike("^(?:0x)?[0-9A-Fa-f]{2,8}$"), hex_of(value, two)).when(F.size(options) == 0, value).otherwise(hex_of(code, two))


def argument_value(argument: Column, raw: Column, node: Column, template: Column) -> Column:
    """Normal value: request parameters chosen, a single identifier taken out of its text, everything else cleaned."""
    value = cleaned(raw)
    found = F.regexp_extract_all(value, F.lit(r"\b(?:0x)?[0-9A-Fa-f]{4,8}\b"), F.lit(0))
    one = F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(value)
    return F.when(value == "", value).when(argument == "RequestParameter", request_parameter(value, node, template)).when(argument.isin(IDENTIFIERS), one).otherwise(value)


def priority(argument: Column, role: Column) -> Column:
    """Weight of an argument's field, and of the role of the block that it stands in."""
    return _lookup(argument, WEIGHTS, F.lit(1.0)) + F.when(role == "table_row", 2.0).when(role == "section_text", 1.0).otherwise(0.0)


def chosen_sources(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """A node's candidates as its sources, or its matches where it has no candidate."""
    rest = matches.join(candidates.select("node").distinct(), "node", "left_anti")
    return candidates.withColumn("legacy", F.lit(False)).unionByName(rest.withColumn("legacy", F.lit(True)))


def unit_argument(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, value, score, note): the fitting source's unit with the best (score, value), else the node's own as a prior."""
    known = nodes.select("node", "template", unit_of(F.col("node"), F.col("template")).alias("own"))
    met = sources.join(known, "node").withColumn("unit", F.trim("unit")).filter("unit <> ''").filter((F.col("own") == "") | unit_fits(F.col("unit"), F.col("own")))
    value = F.when((F.col("own") != "") & F.array_contains(_parts(F.col("unit")), key_of(F.col("own"))), F.upper("own")).otherwise(F.col("unit"))
    scored = met.select("node", F.struct((F.col("score") + F.when(F.col("own") != "", UNIT_BONUS).otherwise(0.0)).alias("score"), value.alias("value"), F.concat(F.lit("ecu_from_"), "role").alias("note")).alias("s"))
    best = scored.groupBy("node").agg(F.max("s").alias("s"))
    prior = F.when(F.col("own") != "", F.struct(F.lit(UNIT_PRIOR).alias("score"), F.col("own").alias("value"), F.lit("node_ecu_fallback").alias("note")))
    return known.join(best, "node", "left").select("node", F.coalesce("s", prior).alias("s")).select("node", "s.value", F.round("s.score", 6).alias("score"), "s.note").filter("value is not null")


def semantic_defaults(nodes: DataFrame) -> DataFrame:
    """(node, argument, value, overrides) that a template class implies without evidence."""
    key = key_of(F.col("template"))
    row = lambda a, v, o=False: F.struct(F.lit(a).alias("argument"), F.lit(v).alias("value"), F.lit(o).alias("overrides"))
    rules = [(key == "DTC_READ_TYPE1", row("DID", READ_DID_TYPE1, True)), (F.startswith(key, F.lit("DTC_READ_TYPE")) | F.startswith(key, F.lit("DTC_CLEAR_TYPE")), row("Position", "")), (F.startswith(key, F.lit("DTC_CLEAR")), row("ServiceID", CLEAR_SERVICE))]
    return nodes.select("node", F.inline(F.array_compact(F.array(*[F.when(c, r) for c, r in rules]))))


def plan_arguments(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, argument, value, score, position): for each argument the value with the best (score, value), and template defaults.

    ``sources`` has node, evidence_id, score, role, unit and fields (array<struct<header, cell>>). Sources of another unit
    do not count, and templates of trouble codes take nothing but the flowchart title from fields.
    """
    known = nodes.select("node", "template", unit_of(F.col("node"), F.col("template")).alias("own"))
    met = sources.join(known, "node").filter((F.col("own") == "") | (F.trim(F.coalesce("unit", F.lit(""))) == "") | unit_fits(F.trim("unit"), F.col("own")))
    each = met.select("node", "template", "score", "role", F.inline("fields")).withColumn("argument", argument_of(F.col("header"))).filter("argument <> ''")
    codes = key_of(F.col("template")).rlike("DTC_(READ|CLEAR)_TYPE")
    each = each.filter(~codes | (F.col("argument") == "FlowchartTitle")).withColumn("value", argument_value(F.col("argument"), F.col("cell"), F.col("node"), F.col("template"))).filter("value <> ''")
    best = each.groupBy("node", "argument").agg(F.max(F.struct((F.col("score") + priority(F.col("argument"), F.col("role"))).alias("score"), "value")).alias("s")).select("node", "argument", "s.score", "s.value")
    implied = semantic_defaults(nodes).select("node", "argument", F.col("value").alias("implied"), "overrides")
    both = best.join(implied, ["node", "argument"], "full")
    use = F.col("implied").isNotNull() & (F.col("value").isNull() | F.col("overrides"))
    merged = both.select("node", "argument", F.when(use, F.col("implied")).otherwise(F.col("value")).alias("raw"), F.round(F.when(use, F.lit(DEFAULT_SCORE)).otherwise(F.col("score")), 6).alias("score"))
    width = _lookup(F.col("argument"), WIDTHS, F.lit(None).cast("int"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ORDER)), F.col("argument")), F.lit(0)), F.lit(len(ORDER) + 1))
    w = Window.partitionBy("node").orderBy(place, "argument")
    return merged.select("node", "argument", hex_of(F.col("raw"), width).alias("value"), "score").withColumn("position", F.row_number().over(w))


def numeric_scores(scores: Column) -> Column:
    """A map of texts as a map of numbers to six decimals; what is no number goes."""
    return F.map_filter(F.transform_values(scores, lambda k, v: F.round(v.try_cast("double"), 6)), lambda k, v: v.isNotNull())
