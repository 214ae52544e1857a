"""Evidence candidates for flow nodes: aliases, relevance score, typed queries, references and fields.

The nodes of flow plans are a stated set of tasks that is scored against all evidence rows, each distinct task once: they are
broadcast in blocks of counted size. What depends on an evidence row or on a node alone is computed once for it, texts are reduced to the tokens
that some node of the block asks for, and the best rows of each node are cut before a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import cleaned, tokens
from quarry.operators.arguments import is_unit, key_of, unit_of
from quarry.sources.workspace import written

# Noise titles and phrases, reference signals, core headers, flowchart families, role ranks and score weights.
NOISE_TITLES = ["document", "contents"]
NOISE_PARTS = ["revision history", "requirements change log", "abbreviation list"]
NOISE_TEXT = ["revision date description author", "requirements change log", "new requirements in this issue"]
SIGNALS = ["eol", "process", "flow", "control", "routine", "dtc", "did", "write", "read", "security", "type", "ecu", "treg", "parameter", "list"]
CORE = ["DID", "RID", "DTC", "REQUEST PARAMETER", "PARAMETER", "SOURCE", "TARGET", "READ DID", "DID FOR IO CONTROL RESULT CHECK", "EXPECTED VALUE"]
FAMILIES = {"DTC_READ_TYPE1": ("dtc read", "type1"), "DTC_READ_TYPE2": ("dtc read", "type2"), "DTC_CLEAR_TYPE2": ("dtc clear", "type2"), "DTC_CLEAR_TYPE7": ("dtc clear", "type7"), "INFORMATION_WRITE_TYPE3": ("information write", "type3")}
ROLE_RANK = {"table_row": 0, "section_text": 1, "flowchart_title": 2, "flowchart_image": 3}
TITLE = r"(?i)\b(?:(?:IO|Routine)\s+Control\s+Type\s*\d+\s*\([^)]*\)|DTC\s+(?:Clear|Read)\s+Type\s*\d+\s*\([^)]*\)|Information\s+(?:Write|Check(?:\s+And\s+Record)?)\s+(?:flow\s+)?Type\s*\d+\s*\([^)]*\)|Security\s+Access\s+Type\s*\d+\s*\([^)]*\))"
REFERENCE = r"(?i)\b(?:refer|refers|reference)\s+to\s+(?:the\s+)?(.{3,180}?)(?:[.;]|\n|$)"
NEAR, MIN_OVERLAP = 0.58, 14.0
#: Words in a node's names, and the further names that evidence then uses; {template} stands for the template's name.
SYNONYMS = [
    (["vmm"], ["Change VMM", "VMM Change", "Change VMM Type1"]),
    (["dtc clear"], ["DTC Clear", "{template}"]),
    (["dtc read"], ["DTC Read", "{template}", "Read Snapshot", "No Snapshot"]),
    (["immobilizer", "secret key"], ["IMMO Secret Key Write", "Secret Key for Immobilizer Target Write", "Secret Key for Immobilizer", "Immobilizer Secret Key", "TCAM IMMO Secret Key Write Check and Upload", "Remote Vehicle Immobilization Secret Key"]),
    (["request open hv battery"], ["Request Open HV Battery", "Open HV Battery", "Request BECM to Open HV Battery"]),
]
#: Identifiers that a plain text names, by the header that a table would give them.
TEXT_FIELDS = {"DID": r"(?i)\bDID\b[:\s]*((?:0x)?[0-9A-Fa-f]{4,6})", "RID": r"(?i)\bRID\b[:\s]*((?:0x)?[0-9A-Fa-f]{4,8})", "REQUEST PARAMETER": r"(?i)\bREQUEST\s+PARAMETER\b[:\s]*((?:0x)?[0-9A-Fa-f]{2,8}|NA)\b", "PARAMETER": r"(?i)\bPARAMETER\b[:\s]*((?:0x)?[0-9A-Fa-f]{2,8}|NA)\b", "DTC": r"(?i)\bDTC\b[:\s]*((?:0x)?[0-9A-Fa-f]{4,8})\b"}
#: Bytes of nodes that are sent to every task at once.
NODE_BLOCK = 8 << 20


def graph_tokens(text: Column) -> Column:
    """Tokens with ``immo`` as ``immobilizer``."""
    return F.transform(tokens(text), lambda t: F.when(t == "immo", F.lit("immobilizer")).otherwise(t))


def plain(text: Column) -> Column:
    return F.array_join(graph_tokens(text), " ")


def overlap(left: Column, right: Column) -> Column:
    """Share of the left's distinct tokens that the right holds; 0 where it has none."""
    own = F.array_distinct(left)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, right)) / F.size(own))


def spaced(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(value, "_", " "), r"\s+", " "))


def template_alias(template: Column) -> Column:
    """A template's name without the platform mark."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(template, "_", " "), r"(?i)\bGEEA\s*30\b", ""), r"\s+", " "))


def action(name: Column) -> Column:
    """A node's name without its number and its unit."""
    bare = F.regexp_replace(name, r"_\d+$", "")
    return F.regexp_replace(F.when(F.contains(bare, F.lit("_")) & is_unit(F.substring_index(bare, "_", 1)), F.regexp_replace(bare, "^[^_]*_", "")).otherwise(bare), "_", " ")


def aliases(name: Column, template: Column, raw: Column) -> Column:
    """Ways in which evidence may name a node: its names, action and template in both orders, and known synonyms."""
    short, does = template_alias(template), action(name)
    base = F.array(name, template, raw, does, short, F.concat_ws(" ", short, does), F.concat_ws(" ", does, short))
    words = plain(F.array_join(base, " "))
    named = lambda n: F.regexp_replace(template, "_", " ") if n == "{template}" else F.lit(n)
    more = [F.when(reduce(lambda a, b: a | b, [F.contains(words, F.lit(h)) for h in hits]), F.array(*map(named, names))).otherwise(F.array().cast("array<string>")) for hits, names in SYNONYMS]
    full = F.concat(base, *more)
    return F.array_distinct(F.filter(F.transform(full, spaced), lambda a: a != ""))


def noise(title: Column, content: Column) -> Column:
    """Contents pages, revision tables and release sheets."""
    head, text = F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lower(cleaned(content))
    has = lambda c, s: F.contains(c, F.lit(s))
    either = lambda c, ss: reduce(lambda a, b: a | b, [has(c, s) for s in ss])
    return head.isin(NOISE_TITLES) | either(head, NOISE_PARTS) | either(text, NOISE_TEXT) | (has(text, "document release status") & (has(text, "document no") | has(text, "page no")))


def flowchart_title(text: Column) -> Column:
    """The first flowchart title in a text, white space and the gap before its type number closed."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(cleaned(text), TITLE, 0), r"\s+", " ")), r"(?i)\bLevel\s+(\d+)", "Level$1"), r"(?i)Type\s+(\d+)", "Type$1")


def useful_reference(value: Column) -> Column:
    return (F.length(plain(value)) >= 3) & F.arrays_overlap(graph_tokens(value), F.array(*map(F.lit, SIGNALS)))


def references(text: Column) -> Column:
    """What a text refers to, cleaned, useful ones only, distinct, in order."""
    found = F.regexp_extract_all(cleaned(text), F.lit(REFERENCE), F.lit(1))
    tidy = F.transform(found, lambda v: F.trim(F.substring(F.regexp_replace(F.btrim(F.regexp_replace(v, r"\s+", " "), F.lit(" :：,，-")), r"(?i)^(?:file|chapter)\s+", ""), 1, 160)))
    return F.array_distinct(F.filter(tidy, useful_reference))


def fallback_fields(text: Column) -> Column:
    """Identifiers that a plain text names, as (header, value)."""
    flat = cleaned(text)
    each = [F.struct(F.lit(k).alias("header"), F.regexp_extract(flat, p, 1).alias("cell")) for k, p in TEXT_FIELDS.items()]
    return F.filter(F.array(*each), lambda f: f["cell"] != "")


def family_fit(key: Column, title: Column) -> Column:
    """Whether a flowchart's title (its plain words) fits the family in a template's key: its own parts, or any title where it has none."""
    has = lambda *parts: reduce(lambda a, b: a & b, [F.contains(title, F.lit(p)) for p in parts])
    rule = reduce(lambda c, kv: c.when(F.contains(key, F.lit(kv[0])), has(*kv[1])), FAMILIES.items(), F.when((key == "") | (title == ""), F.lit(False)))
    return rule.when(F.contains(key, F.lit("GEEA30_VMM_CHANGE")), has("io control", "type21")).otherwise(F.lit(True))


def needs_family(key: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(key, F.lit(k)) for k in (*FAMILIES, "GEEA30_VMM_CHANGE")])


def evidence_features(evidence: DataFrame) -> DataFrame:
    """What the score takes from an evidence row (evidence_id, content, title, unit, module, role, fields) alone; noise rows go, their score is 0."""
    c = F.col
    unit, title = F.trim(F.coalesce("unit", F.lit(""))), F.coalesce("title", F.lit(""))
    fields_text = F.array_join(F.transform("fields", lambda f: F.concat_ws(" ", f["header"], f["cell"])), " ")
    made = evidence.filter(~noise(c("title"), c("content"))).select(
        "evidence_id", "role", "fields", unit.alias("unit"), F.coalesce(c("module") == "ecu_parameter", F.lit(False)).alias("parameter"), flowchart_title(c("content")).alias("flow"),
        graph_tokens(F.concat_ws(" ", "content", title, unit, F.coalesce("module", F.lit("")), fields_text)).alias("words"), F.array_distinct(graph_tokens(title)).alias("title_words"),
    )
    core = F.exists("fields", lambda f: F.upper(F.trim(F.regexp_replace(f["header"], r"\s+", " "))).isin(CORE))
    by_role = F.when(c("role") == "table_row", 3.0).when(c("role") == "section_text", 2.0).when(c("role") == "flowchart_title", 1.0).otherwise(0.0)
    by_fields = F.when(c("parameter"), 2.0).otherwise(0.0) + F.when(F.size("fields") > 0, 2.0).otherwise(0.0) + F.when(core, 25.0).when(c("role").isin("section_text", "table_row") & (c("flow") == ""), -12.0).otherwise(0.0)
    return made.select("evidence_id", "role", "unit", "parameter", F.array_join("words", " ").alias("text"), F.array_distinct("words").alias("words"), "title_words", plain(c("flow")).alias("shown"), (c("flow") != "").alias("flows"), tokens(c("unit")).alias("unit_words"), (by_role + by_fields).alias("base"))


def node_features(nodes: DataFrame) -> DataFrame:
    """What the score takes from a node (node, name, template, aliases) alone."""
    c = F.col
    own, key = unit_of(c("name"), c("template")), key_of(c("template"))
    named = F.transform("aliases", lambda a: F.struct(F.array_distinct(graph_tokens(a)).alias("words"), plain(a).alias("phrase")))
    made = nodes.select("node", "name", own.alias("own"), F.lower(own).alias("own_word"), named.alias("named"), F.array_distinct(graph_tokens(template_alias(c("template")))).alias("template_words"), key.alias("key"), needs_family(key).alias("needs"), (c("template") == "GEEA30_VMM_Change").alias("vmm"))
    return made.withColumn("asks", F.array_distinct(F.concat(F.flatten(F.transform("named", lambda a: a["words"])), "template_words", F.array("own_word"))))


def relevance(pairs: DataFrame) -> DataFrame:
    """Adds score to pairs of ``node_features`` and ``evidence_features`` (words reduced to those that nodes ask for).

    The three best aliases count (14 for the phrase, else by the overlap from 0.58 on), then unit, section title, role,
    module, fields and flowchart family.
    """
    c = F.col

    def of_alias(a: Column) -> Column:
        n = F.size(a["words"])
        met = F.size(F.array_intersect(a["words"], c("words")))
        return F.when(n == 0, 0.0).when(F.contains(c("text"), a["phrase"]), MIN_OVERLAP).when(met / n >= NEAR, 4 + 6 * (met / n) + met).otherwise(0.0)

    best = F.aggregate(F.slice(F.sort_array(F.transform("named", of_alias), asc=False), 1, 3), F.lit(0.0), lambda a, x: a + x)
    fits = (c("unit") != "") & (F.startswith(F.upper("unit"), c("own")) | F.array_contains(c("unit_words"), c("own_word")))
    by_unit = F.when((c("own") != "") & (c("unit") != ""), F.when(fits, 16.0).when(c("parameter"), -35.0).otherwise(0.0)).when((c("own") != "") & F.array_contains(c("words"), c("own_word")), 8.0).otherwise(0.0)
    by_title = F.when((F.size("title_words") > 0) & F.exists("named", lambda a: overlap(a["words"], c("title_words")) >= NEAR), 5.0).otherwise(0.0)
    by_flow = F.when(~c("flows"), 0.0).when(family_fit(c("key"), c("shown")), 8.0).when(c("needs"), -35.0).otherwise(1.0)
    vmm = F.when(c("vmm"), F.when(F.contains("shown", F.lit("type21")), 6.0).otherwise(0.0) - F.when(F.contains("shown", F.lit("type22")) | F.contains("text", F.lit("ignore nrc")), 6.0).otherwise(0.0)).otherwise(0.0)
    by_template = F.when(overlap(c("template_words"), c("words")) >= NEAR, 3.0).otherwise(0.0)
    return pairs.withColumn("score", F.round(best + by_unit + by_title + c("base") + by_flow + vmm + by_template, 6))


def best_candidates(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each node: score, then the rank of the role, then the id."""
    rank = reduce(lambda c, kv: c.when(F.col("role") == kv[0], kv[1]), ROLE_RANK.items(), F.when(F.lit(False), 0)).otherwise(9)
    w = Window.partitionBy("node").orderBy(F.desc("score"), rank, "evidence_id")
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def task_candidates(nodes: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """node, name, evidence_id, role, score, rank: the k best evidence rows of each node (node, name, template, aliases).

    A score depends on what a node says, not on the node: nodes that say the same are one task, which is scored once and whose
    rows they share. The evidence rows' features are written once; tasks come in blocks of at most ``NODE_BLOCK`` bytes, counted first.
    """
    says = ["name", "template", "aliases"]
    named = nodes.select("node", F.struct(*says).alias("says"))
    tasks = named.select("says").distinct().select(F.col("says").alias("node"), "says.*")
    rows, asked = written(evidence_features(evidence), "evidence-features"), node_features(tasks)
    size = tasks.agg(F.coalesce(F.sum(F.length(F.concat_ws(" ", "name", "template", "aliases")) * 6 + 512), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // NODE_BLOCK))
    found = None
    for i in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64("node"), F.lit(n_blocks)) == i) if n_blocks > 1 else asked
        wanted = F.broadcast(block.select(F.explode("asks").alias("w")).agg(F.collect_set("w").alias("wanted")))
        slim = rows.join(wanted, F.lit(True)).withColumn("words", F.array_intersect("words", "wanted")).drop("wanted")
        best = best_candidates(relevance(slim.join(F.broadcast(block), F.lit(True))), k).select("node", "name", "evidence_id", "role", "score", "rank")
        found = best if found is None else found.unionByName(best)
    return named.join(found.withColumnRenamed("node", "says"), "says").select("node", "name", "evidence_id", "role", "score", "rank")


def query_plan(nodes: DataFrame) -> DataFrame:
    """node, ord, query_type, query: up to six typed queries per node, each text once."""
    c = F.col
    both = F.concat_ws(" ", "name", "template", "raw")
    unit = F.coalesce(F.get(F.filter(F.transform(F.regexp_extract_all(both, F.lit("0x[0-9a-fA-F]+|[A-Za-z]+[A-Za-z0-9-]*|[0-9a-fA-F]{2,8}"), F.lit(0)), F.upper), is_unit), F.lit(0)), F.lit(""))
    number = F.regexp_extract(both, r"(?i)\bType\s*_?\s*(\d+)\b", 1)
    made = nodes.withColumns({"unit": unit, "hint": F.when(number != "", F.concat(F.lit("Type"), number)).otherwise(F.lit(""))})
    parts = F.filter(F.split(F.regexp_replace(F.concat_ws(" ", "name", "template"), r"\([^)]*\)", " "), r"[_\s-]+"), lambda p: p != "")
    kept = F.filter(parts, lambda p: ~(p.rlike("^[0-9]+$") | F.startswith(F.upper(p), F.lit("GEEA")) | is_unit(p) | p.rlike(r"(?i)^Type\d+$") | (F.upper(p) == F.upper(c("hint")))))
    # Of parts that differ in case only the first stays.
    first = F.filter(kept, lambda p, i: F.array_position(F.transform(kept, F.upper), F.upper(p)) == i + 1)
    phrase = F.array_join(F.slice(first, 1, 6), " ")
    made = made.withColumn("phrase", F.when(phrase == "", F.regexp_replace("name", "_", " ")).otherwise(phrase)).withColumn("notes", F.array_join(F.array_distinct(F.regexp_extract_all(both, F.lit(r"\(([^)]{3,120})\)"), F.lit(1))), " "))
    say = lambda kind, *parts_: F.struct(F.lit(kind).alias("query_type"), spaced(F.array_join(F.filter(F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts_]), lambda x: x != ""), " ")).alias("query"))
    asks = F.array(
        say("anchor", c("name"), c("template"), c("raw"), F.regexp_replace("name", "_", " "), F.regexp_replace("template", "_", " ")), say("ecu_doc", c("unit"), "TREG Parameter", c("phrase"), c("hint")), say("ecu_doc", c("unit"), c("phrase"), c("hint")),
        say("public_process", "EOL process", c("phrase"), c("hint"), c("notes")), say("public_process", c("phrase"), c("hint"), "flow"), say("template", c("template"), "XML ScriptNode Args"),
    )
    each = made.select("name", F.posexplode(asks).alias("ord", "q")).select("name", "ord", "q.*").filter("query <> ''")
    w = Window.partitionBy("name", "query").orderBy("ord")
    return each.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
