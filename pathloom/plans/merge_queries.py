"""Queries of merging, deduplication and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import merge as M
from pathloom.plans.registry import query

C = F.col
_SIDES = "(SELECT pathway_id, process, list(entity ORDER BY pos, entity) FILTER (role = 'reactant') AS i, list(entity ORDER BY pos, entity) FILTER (role = 'product') AS o FROM {participants} p GROUP BY 1, 2)"

query("D01_merge_entities", """SELECT pathway_id, norm, arg_min(name, pos) AS name, min(pos) AS pos, arg_max(evidence, length(evidence) * 1000000 - pos) AS evidence, count(*) AS merged, arg_min(type, pos) AS type, string_agg(DISTINCT brand, '|' ORDER BY brand) AS brands
    FROM (SELECT *, regexp_replace(lower(trim(name)), '[^a-z0-9 ]+', '', 'g') AS norm FROM {compounds} c) GROUP BY 1, 2""")(
    lambda t: M.merge_entities(t.compounds.withColumn("brands", F.array("brand")), ["pathway_id"], lists=("brands",), blanks=("type",)).withColumn("brands", F.array_join(F.array_sort("brands"), "|"))
)
query("D05_location_dedupe", "SELECT pathway_id, entity, state, arg_min(pos, concat(lpad(CAST(100 - length(evidence) AS VARCHAR), 3, '0'), lpad(CAST(pos AS VARCHAR), 9, '0'))) AS pos FROM (SELECT pathway_id, name AS entity, brand AS state, pos, evidence FROM {compounds} c) GROUP BY 1, 2, 3")(
    lambda t: M.dedupe_locations(t.compounds.select("pathway_id", C("name").alias("entity"), C("brand").alias("state"), "pos", "evidence")).drop("evidence")
)


def procs(t):
    return M.sides(t.participants.select("pathway_id", "process", "pos", "entity", "role").unionByName(t.participants.select("pathway_id", "process", "pos", C("modifier").alias("entity"), F.lit("modifier").alias("role")))).join(t.processes, ["pathway_id", "process"])


query("D02_dedupe_processes", """SELECT o_custkey AS pathway_id, arg_max(o_orderkey, row(o_totalprice, -o_orderkey)) AS process, count(*) AS copies FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority""")(
    lambda t: M.dedupe_processes(t.processes, [C("status"), C("priority")], [C("price")]).select("pathway_id", "process", "copies")
)
query("D03_drop_noop_reactions", f"SELECT pathway_id, process FROM (SELECT s.pathway_id, s.process, list_transform(i, lambda x: substr(x, length(x))) AS i, list_transform(o, lambda x: substr(x, length(x))) AS o, status FROM {_SIDES} s JOIN {{processes}} x USING (pathway_id, process)) WHERE status = 'P' OR coalesce(len(i), 0) = 0 OR coalesce(len(o), 0) = 0 OR len(list_filter(o, lambda y: NOT list_contains(i, y))) > 0")(
    lambda t: M.drop_noops(procs(t).select("pathway_id", "process", *[F.transform(c, lambda x: F.right(x, F.lit(1))).alias(c) for c in ("inputs", "outputs")], (C("status") == "P").alias("essential"))).select("pathway_id", "process")
)
query("B16_noop_objects", f"SELECT pathway_id, process, coalesce(list_sort(list_transform(i, lambda x: substr(x, length(x)))) = list_sort(list_transform(o, lambda x: substr(x, length(x)))), false) AS noop FROM {_SIDES} s")(
    lambda t: procs(t).select("pathway_id", "process", M.noop_object(F.transform("inputs", lambda x: F.right(x, F.lit(1))), F.transform("outputs", lambda x: F.right(x, F.lit(1)))).alias("noop"))
)


@query("D04_merge_additions", """WITH r AS (SELECT o_custkey AS pathway_id, o_orderkey AS pos, o_orderpriority AS i, o_orderstatus AS o, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE concat('s', o_orderkey % 5) END AS state, o_orderkey % 3 AS actor, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS late FROM orders)
    SELECT pathway_id, min(late) AS late, min(pos) FILTER (late = l) AS pos, i AS inputs, arg_min(state, late * 100000000 + pos) FILTER (state IS NOT NULL) AS state, string_agg(DISTINCT actor, '|' ORDER BY actor) AS actors FROM (SELECT *, min(late) OVER (PARTITION BY pathway_id, i, o) AS l FROM r) GROUP BY pathway_id, i, o""")
def _additions(t):
    r = t.orders.select(C("o_custkey").alias("pathway_id"), C("o_orderkey").alias("pos"), F.array("o_orderpriority").alias("inputs"), F.array("o_orderstatus").alias("outputs"), F.when(C("o_orderkey") % 2 == 0, " ").otherwise(F.concat(F.lit("s"), C("o_orderkey") % 5)).alias("state"), F.lit("").alias("evidence"), F.array((C("o_orderkey") % 3).cast("string")).alias("actors"))
    got = M.merge_additions(r.where("pos % 4 <> 0"), r.where("pos % 4 = 0"))
    return got.select("pathway_id", "late", "pos", C("inputs")[0].alias("inputs"), "state", F.array_join(F.array_sort("actors"), "|").alias("actors"))


query("G02_union_distinct", "SELECT user_id, event_type, props, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3")(lambda t: M.union_distinct(t.events.select("user_id", "event_id", "event_type", "props"), ["user_id"], "event_id"))
query("G02_first_filled", "SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'click') AS kind, arg_min(props, event_id) AS props FROM events GROUP BY 1")(
    lambda t: M.first_filled(t.events.withColumn("kind", F.when(C("event_type") == "click", " ").otherwise(C("event_type"))), ["user_id"], ["kind", "props"], "event_id")
)
query("G03_collapse_outputs", """WITH x AS (SELECT pathway_id, process, entity, CASE WHEN pos % 4 = 0 THEN concat(entity, ':z') END AS cx FROM {participants} p WHERE role = 'product'),
    a AS (SELECT pathway_id, process, entity FROM x UNION ALL SELECT pathway_id, process, cx FROM x WHERE cx IS NOT NULL) SELECT pathway_id, process, entity FROM a WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.pathway_id = a.pathway_id AND x.process = a.process AND x.cx IS NOT NULL AND x.entity = a.entity)""")(
    lambda t: (lambda p: M.collapse_parts(p.select("pathway_id", "process", "entity").union(p.where("pos % 4 = 0").select("pathway_id", "process", F.concat("entity", F.lit(":z"))))))(t.participants.where("role = 'product'"))
)
query("D11_merge_id_maps", "SELECT pathway_id, concat('{\"brand\":\"', b, '\"', CASE WHEN t IS NULL THEN '' ELSE concat(',\"type\":\"', t, '\"') END, '}') AS ids FROM (SELECT p_size AS pathway_id, arg_min(p_brand, p_partkey) AS b, arg_min(p_type, p_partkey) FILTER (p_partkey % 2 = 0) AS t FROM part GROUP BY 1)")(
    lambda t: M.merge_ids(t.part.select(C("p_size").alias("pathway_id"), C("p_partkey").alias("pos"), F.create_map(F.lit("brand"), "p_brand", F.lit("type"), F.when(C("p_partkey") % 2 == 0, C("p_type")).otherwise(" ")).alias("mapped_ids")), ["pathway_id"]).select("pathway_id", F.to_json("mapped_ids").alias("ids"))
)
query("D12_best_candidates", """SELECT user_id, k, confidence, CASE WHEN db THEN 'db' ELSE 'other' END AS origin, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, CASE WHEN db THEN 'db' ELSE 'other' END, k) AS rn
    FROM (SELECT user_id, concat('[{"key":"k","value":"', event_id % 5, '"}]') AS k, max(greatest(0.1, least(0.9, value / 100))) AS confidence, bool_or(event_type = 'click') AS db FROM events GROUP BY 1, 2)""")(
    lambda t: M.best_candidates(t.events.select("user_id", F.create_map(F.lit("k"), (C("event_id") % 5).cast("string")).alias("ids"), (C("value") / 100).alias("confidence"), F.when(C("event_type") == "click", "db").otherwise("api").alias("origin")), ["user_id"], 0.1, 0.9).withColumnRenamed("ids_key", "k")
)
query("D13_organism", """SELECT pathway_id, CASE WHEN n = 1 THEN one WHEN m = 1 THEN other ELSE '' END AS organism FROM (SELECT c_custkey // 2 AS pathway_id, count(*) FILTER (c_custkey % 4 < 3) AS n, max(c_name) FILTER (c_custkey % 4 < 3) AS one, count(DISTINCT c_mktsegment) AS m, max(c_mktsegment) AS other FROM customer GROUP BY 1)""")(
    lambda t: (lambda c: M.organism(c.where("c_custkey % 4 < 3").select("pathway_id", C("c_name").alias("name")), c.select("pathway_id", C("c_mktsegment").alias("species"))))(t.customer.withColumn("pathway_id", F.expr("c_custkey div 2")))
)


@query("D10_merge_catalogues", """WITH b AS (SELECT p_size AS id, list_extract(['kegg', 'hmdb', 'pubchem', 'chebi'], CAST(p_partkey % 4 AS INT) + 1) AS source, p_partkey % 5 > 0 AS ok, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE p_retailprice END AS mass, p_name, list_position(['chebi', 'pubchem', 'hmdb', 'kegg'], list_extract(['kegg', 'hmdb', 'pubchem', 'chebi'], CAST(p_partkey % 4 AS INT) + 1)) AS r FROM part)
    SELECT id, arg_min(mass, r * 1000000 + mass) FILTER (ok AND mass > 0) AS mass, count(DISTINCT p_name) FILTER (ok) AS synonyms, CASE WHEN count(*) FILTER (ok) = 0 THEN 'error' WHEN count(*) FILTER (ok) < count(*) THEN 'ok_with_warnings' ELSE 'ok' END AS status FROM b GROUP BY 1""")
def _catalogues(t):
    b = t.part.select(C("p_size").alias("id"), F.element_at(F.array(*map(F.lit, ["kegg", "hmdb", "pubchem", "chebi"])), (C("p_partkey") % 4 + 1).cast("int")).alias("source"), (C("p_partkey") % 5 > 0).alias("ok"), F.when(C("p_partkey") % 3 == 0, 0.0).otherwise(C("p_retailprice")).alias("mass"), F.array("p_name", F.upper("p_name")).alias("synonyms"))
    return M.merge_sources(b, ["id"], ["mass"]).withColumn("synonyms", F.size("synonyms").cast("long"))


query("D18_best_repair", "SELECT user_id, arg_min(event_id, row(CAST(floor(value) AS INT) % 3, CAST(floor(value) AS INT) % 4, 0, event_id % 2, -(event_id % 5), event_id % 7, event_id)) AS candidate FROM events GROUP BY 1")(
    lambda t: M.best_repair(t.events.select("user_id", C("event_id").alias("candidate"), (F.floor("value").cast("int") % 3).alias("errors"), (F.floor("value").cast("int") % 4).alias("warnings"), F.lit(0).alias("source_errors"), (C("event_id") % 2).alias("rejected"), (C("event_id") % 5).alias("accepted"), (C("event_id") % 7).alias("patches")), ["user_id"]).select("user_id", "candidate")
)
query("D22_merge_issues", """SELECT pathway_id, severity, source, count(*) AS n, count(*) FILTER (reason LIKE '[no path]%') AS vague FROM (SELECT user_id % 20 AS pathway_id, CASE WHEN event_id % 2 = 0 AND event_type IN ('error', 'click') AND event_id % 3 <> 0 THEN 'warning' WHEN event_type IN ('error', 'click') THEN 'error' ELSE 'warning' END AS severity,
    CASE WHEN event_id % 2 = 0 AND event_type IN ('error', 'click') AND event_id % 3 <> 0 THEN '[no path] x' ELSE 'x' END AS reason, CASE WHEN event_id % 2 = 0 THEN 'model' ELSE 'deterministic' END AS source FROM events) GROUP BY 1, 2, 3""")(
    lambda t: (lambda e: M.merge_issues(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0")))(t.events.select("event_id", (C("user_id") % 20).alias("pathway_id"), F.when(C("event_type").isin("error", "click"), "error").otherwise("warning").alias("severity"), F.when(C("event_id") % 3 == 0, "/a").otherwise("a").alias("path"), C("props").alias("reason"), F.lit(None).cast("string").alias("source"))).groupBy("pathway_id", "severity", "source").agg(F.count("*").alias("n"), F.count_if(C("reason").startswith("[no path]")).alias("vague"))
)
query("D19_attempt_summary", """SELECT conv_id, count(*) AS failed, arg_max(text, turn) AS raw, arg_max(CASE WHEN turn % 4 = 1 THEN 'Expecting value' ELSE 'bad' END, turn) AS error FROM conversations WHERE turn % 2 = 1 GROUP BY 1""".replace("arg_max(text, turn) AS raw", "CAST(arg_max(length(text), turn) AS INT) AS raw_length, arg_max(substr(text, 1, 40), turn) AS head, arg_max(right(text, 40), turn) AS tail, arg_max(turn % 4 = 1, turn) AS truncated"))(
    lambda t: M.attempts_summary(t.conversations.select("conv_id", C("turn").alias("attempt"), C("text").alias("raw"), F.when(C("turn") % 4 == 1, "Expecting value").when(C("turn") % 2 == 1, "bad").alias("error")), ["conv_id"])
)
query("D15_token_costs", "SELECT conv_id % 50 AS run_id, count(*) AS calls, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, round(sum((length(text) // 4) * CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 3 ELSE 0 END / 1000000), 6) AS cost FROM conversations GROUP BY 1")(
    lambda t: M.token_costs(t.conversations.select((C("conv_id") % 50).alias("run_id"), C("role").alias("kind"), F.expr("length(text) div 4").alias("tokens")), t.rows("kind string, per_million double", ("user", 1.0), ("assistant", 3.0)), ["run_id"])
)
query("D08_stage_counts", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, round(100.0 * count(*) FILTER (event_type = 'click') / count(*), 2) AS percent FROM events GROUP BY 1")(
    lambda t: M.stage_counts(t.events, ["user_id"], "event_type", ("click", "error"))
)


@query("G05_stop_rule", """WITH r AS (SELECT user_id AS pathway_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS round, event_type AS hash, CAST(round(value) AS INT) % 7 AS issues FROM events),
    s AS (SELECT *, lag(issues) OVER (PARTITION BY pathway_id ORDER BY round) AS before, EXISTS (SELECT 1 FROM r q WHERE q.pathway_id = r.pathway_id AND q.round < r.round AND q.hash = r.hash) AS seen FROM r),
    w AS (SELECT pathway_id, round, CASE WHEN issues = 0 THEN 'clean' WHEN seen THEN 'repeated_payload' WHEN before <= issues THEN 'stalled' WHEN round >= 4 THEN 'max_rounds' END AS reason FROM s) SELECT pathway_id, min(round) AS round, arg_min(reason, round) AS reason FROM w WHERE reason IS NOT NULL GROUP BY 1""")
def _stop(t):
    from pathloom.operators.tables import numbered

    r = numbered(t.events, ["user_id"], "event_id", name="round").select(C("user_id").alias("pathway_id"), "round", C("event_type").alias("hash"), (F.round("value").cast("int") % 7).alias("issues"))
    return M.stop_reasons(r, 4)


query("G05_payload_groups", "SELECT min(pathway_id) AS pathway_id, count(*) AS same FROM (SELECT p_size AS pathway_id, list_sort(list(DISTINCT p_name)) AS l FROM part GROUP BY 1) GROUP BY l")(
    lambda t: M.payload_hashes(t.part.select("p_size", "p_name").distinct(), ["p_size"], "p_name").groupBy("hash").agg(F.min("p_size").alias("pathway_id"), F.count("*").alias("same")).drop("hash")
)
