"""Registered queries that build replay datasets from orders (operations) and line items (decisions); importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import replay as R
from quarry.plans.catalogue import _t, query

# An operation per order, a workload per priority; a decision per line item of the first two lines.
_OP = {
    "workload": "o_orderpriority", "ord": "o_orderkey", "node": "concat('Node ', o_orderkey, '!')", "template": "CASE WHEN o_orderkey % 3 > 0 THEN concat('T', o_orderkey % 5) END", "n": "o_orderkey % 4", "m": "o_orderkey % 3", "k": "o_custkey",
}
_DE = {
    "workload": "o_orderpriority", "ord": "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey", "node": "concat('Node ', CASE WHEN l_partkey % 5 = 0 THEN l_orderkey + 1000000000 ELSE l_orderkey END, '!')", "arg": "CASE l_linenumber WHEN 1 THEN 'DID' ELSE '' END",
    "class": "CASE WHEN l_suppkey % 2 = 0 THEN concat('C', l_suppkey) END", "plan_value": "concat('0x', l_partkey)", "base_value": "CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'b' END", "fused_value": "l_returnflag", "action": "'needs_review'", "reason": "CASE WHEN l_suppkey % 3 > 0 THEN concat('reason ', l_suppkey) END",
    "evidence": "l_suppkey % 3", "requires_review": "l_partkey % 3 = 0",
}
_ON = "lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2"


def _sources(spark, d):
    ops = _t(spark, d, "orders").selectExpr(*[f"{v} AS {k}" for k, v in _OP.items()])
    many = lambda n, x: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(1), F.col(n).cast("int")), x))
    text = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    k = F.col("k").cast("string")
    match = many("n", lambda i: F.struct(text("e", i.cast("string")).alias("evidence_id"), i.cast("string").alias("score"), F.when(i % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("terms"), text(" excerpt ", k).alias("excerpt")))
    none = F.array().cast("array<string>")
    ops = ops.select(
        "workload", "ord", "node", "template", F.coalesce(many("m", lambda i: text("s", i.cast("string"))), none).alias("selected"), F.coalesce(match, F.array().cast("array<struct<evidence_id:string,score:string,terms:array<string>,excerpt:string>>")).alias("matches"),
        F.coalesce(many("m", lambda i: text("note ", i.cast("string"))), none).alias("notes"), F.coalesce(many("n", lambda i: text("path ", i.cast("string"))), none).alias("paths"),
        F.coalesce(many("m", lambda i: F.struct(text("arg", i.cast("string")).alias("name"), k.alias("value"), F.lit("0.5").alias("score"))), F.array().cast("array<struct<name:string,value:string,score:string>>")).alias("args"), F.when(F.col("m") == 1, F.array(F.lit("DID"))).otherwise(none).alias("missing"),
    )
    lines = _t(spark, d, "lineitem").filter("l_linenumber <= 2").join(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.expr("l_orderkey = o_orderkey")).selectExpr(*[f"{v} AS {k}" for k, v in _DE.items()])
    return ops, lines.withColumn("evidence", F.coalesce(many("evidence", lambda i: text("ev", i.cast("string"))), none))


_NL = "chr(10)"
_LIST = lambda n, x, sep: f"coalesce(nullif(array_to_string(list_transform(generate_series(1, {n}), lambda i: {x}), {sep}), ''), 'None')"
_MATCH = "'- evidence_id=e' || i || '; score=' || i || '; matched_terms=' || CASE WHEN i % 2 = 0 THEN 'a,b' ELSE 'None' END || '; excerpt=excerpt ' || k"
_F = {
    "args": _LIST("m", "'arg' || i || '=' || k || ' (score=0.5)'", "'; '"), "notes": _LIST("m", "'note ' || i", "'; '"), "paths": _LIST("n", "'- path ' || i", _NL), "matches": _LIST("n", _MATCH, _NL), "selected": _LIST("m", "'s' || i", "', '"), "missing": "CASE WHEN m = 1 THEN 'DID' ELSE 'None' END", "evidence": _LIST("evidence", "'ev' || i", "', '"),
}
_SLUG = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"


def _sql(profile: str, source: str, fields: list[tuple[str, str]], parts: list[str], where: str = "TRUE") -> str:
    intro, most, least, cache, tags = R.PROFILES[profile]
    said = " || chr(10) || ".join([*[f"'{x}'" for x in intro], "''", *[f"'{n}: ' || {v}" if n[-1] != ":" else f"'{n}' || chr(10) || {v}" for n, v in fields]])
    named = "array_to_string(list_transform(list_filter([" + ", ".join(parts) + f"], lambda p: p <> ''), lambda p: {_SLUG.format(x='p')}), '-')"
    return f"""SELECT workload, '{profile}:' || lpad(CAST(row_number() OVER (PARTITION BY workload ORDER BY ord) - 1 AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (PARTITION BY workload ORDER BY ord) - 1 AS VARCHAR))) AS INTEGER), '0') || ':' || {named} AS item_id, '{profile}' AS profile, trim({said}) AS prompt, {most} AS max_tokens, {least} AS min_tokens, '{cache}' AS cache_mode, '{tags}' AS tags FROM {source} WHERE {where}"""


_E = lambda c: f"coalesce({c}, '')"
_CONFLICT = [("Node", "node"), ("Template", _E("class")), ("Arg", "arg"), ("PlanValue", "plan_value"), ("BaseValue", "base_value"), ("FusedValue", "fused_value")]
_WHERE = [("Operation", "node"), ("Template", _E("template"))]
_ITEMS = f"""op AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _OP.items())} FROM orders), de AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _DE.items())} FROM {_ON}),
dd AS (SELECT de.*, coalesce(n, 0) AS n, coalesce(m, 0) AS m, k FROM de LEFT JOIN op USING (workload, node) WHERE requires_review),
raw AS ({_sql('short_audit', 'dd', [*_CONFLICT, ('Reason', _E('reason')), ('EvidenceIds', _F['evidence']), ('SelectedArgs', _F['args']), ('OperationNotes', _F['notes'])], ['node', 'arg'])}
 UNION ALL {_sql('rerank', 'op', [*_WHERE, ('SelectedEvidenceIds', _F['selected']), ('Candidates:', _F['matches'])], ['node'], 'n > 0')}
 UNION ALL {_sql('long_context', 'op', [*_WHERE, ('SelectedArgs', _F['args']), ('MissingFields', _F['missing']), ('OperationNotes', _F['notes']), ('GraphPaths:', _F['paths']), ('RetrievalEvidence:', _F['matches'])], ['node'])}
 UNION ALL {_sql('repair', 'dd', [*_CONFLICT, ('CurrentAction', 'action'), ('Reason', _E('reason')), ('GraphPaths:', _F['paths']), ('Evidence:', _F['matches'])], ['node', 'arg'])}),
items AS (SELECT *, greatest(1, length(prompt) // 4) AS tokens FROM raw)"""


@query(f"WITH {_ITEMS} SELECT workload, item_id, profile, sha256(prompt) AS prompt_sha256, tokens, max_tokens, min_tokens, cache_mode, tags FROM items")
def replay_items(spark, d):
    return R.trace_items(*_sources(spark, d)).withColumn("prompt_sha256", F.sha2("prompt", 256)).drop("prompt")


@query(f"WITH {_ITEMS} SELECT workload, item_id, profile, prompt, tokens FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY md5('seed' || chr(0) || workload || chr(0) || item_id), workload, item_id) AS r FROM items) WHERE r <= 20")
def replay_sample(spark, d):
    """Twenty items of each profile, whatever the number of rows (a sampling operator)."""
    return R.sample(R.trace_items(*_sources(spark, d)), 20, "seed").select("workload", "item_id", "profile", "prompt", "tokens")


@query(f"WITH {_ITEMS} SELECT workload, profile, count(*) AS items, round(avg(length(prompt)), 2) AS avg_prompt_chars, max(length(prompt)) AS max_prompt_chars FROM items GROUP BY ALL")
def replay_summary(spark, d):
    return R.summary(R.trace_items(*_sources(spark, d), ids=False))
