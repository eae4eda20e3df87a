"""Queries of payload reading, shredding and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import cleaning as L
from pathloom.operators.tables import ordered
from pathloom.plans.durable import durable
from pathloom.plans.registry import query
from pathloom.sources import payload as P

C = F.col


def payloads(t):
    """Documents of a pathway per customer, written as JSON and parsed again; every tenth text is no object."""
    rx = t.participants.groupBy("pathway_id", "process").agg(*[F.array_compact(ordered(F.when(C("role") == r, C("entity")), "pos")).alias(k) for r, k in (("reactant", "inputs"), ("product", "outputs"))], ordered(F.struct(C("modifier").alias("protein")), "pos").alias("enzymes"))
    ents = t.compounds.select((C("pathway_id") * 7).alias("pathway_id"), F.lit("compound").alias("kind"), "pos", "name")
    docs = rx.groupBy("pathway_id").agg(ordered(F.struct("inputs", "outputs", "enzymes"), "process").alias("reactions"))
    comp = ents.groupBy("pathway_id").agg(ordered(F.struct("name"), "pos").alias("compounds"))
    both = docs.join(comp, "pathway_id", "left")
    text = F.to_json(F.struct(C("pathway_id").cast("string").alias("pathway_id"), F.struct("compounds").alias("entities"), F.struct("reactions").alias("processes")))
    return both.select(C("pathway_id").alias("id"), F.when(C("pathway_id") % 10 == 9, F.concat(F.lit("["), text, F.lit("]"))).when(C("pathway_id") % 10 == 8, F.substring(text, 1, 40)).otherwise(text).alias("json"))


def shredded(t):
    """Documents are made and parsed once, whatever lists are then read from them."""
    return durable(P.parse(payloads(t)).where("is_object").select(C("id").alias("pathway_id"), "payload.entities", "payload.processes", "payload.element_locations", "payload.biological_states"))


query("A01_read_payloads", "SELECT pathway_id AS id, pathway_id % 10 < 8 AS is_object, CASE WHEN pathway_id % 10 < 8 THEN count(DISTINCT process) END AS reactions FROM {participants} p GROUP BY 1")(
    lambda t: P.parse(payloads(t)).select("id", "is_object", F.when(C("is_object"), F.size("payload.processes.reactions").cast("long")).alias("reactions"))
)
query("A02_shred_participants", """SELECT pathway_id, 'reaction' AS process_kind, dense_rank() OVER (PARTITION BY pathway_id ORDER BY process) - 1 AS process, role, k - 1 AS pos, entity FROM (
    SELECT pathway_id, process, role, entity, row_number() OVER (PARTITION BY pathway_id, process, role ORDER BY pos, entity) AS k FROM {participants} p UNION ALL
    SELECT pathway_id, process, 'enzyme', modifier, row_number() OVER (PARTITION BY pathway_id, process ORDER BY pos, modifier) FROM {participants} p) WHERE pathway_id % 10 < 8""")(lambda t: P.participants(shredded(t)))
query("A02_shred_entities", "SELECT pathway_id * 7 AS pathway_id, 'compound' AS kind, row_number() OVER (PARTITION BY pathway_id ORDER BY pos) - 1 AS pos, concat('/entities/compounds/', row_number() OVER (PARTITION BY pathway_id ORDER BY pos) - 1) AS pointer, name FROM {compounds} c WHERE pathway_id * 7 % 10 < 8 AND pathway_id * 7 IN (SELECT pathway_id FROM {participants} p)")(
    lambda t: P.entities(shredded(t)).select("pathway_id", "kind", "pos", "pointer", "name")
)
query("A09_assemble_payloads", """SELECT pathway_id, count(DISTINCT process) AS reactions, count(*) FILTER (role = 'reactant') AS inputs, count(*) FILTER (role = 'product') AS outputs FROM {participants} p WHERE pathway_id % 10 < 8 GROUP BY 1""")(
    lambda t: (lambda s: P.parse(P.assemble(P.entities(s), P.reactions(s).select("pathway_id", "process", "inputs", "outputs"))).select("pathway_id", F.size("payload.processes.reactions").cast("long").alias("reactions"), *[F.expr(f"aggregate(payload.processes.reactions, cast(0 as bigint), (a, r) -> a + size(r.{k}))").alias(k) for k in ("inputs", "outputs")]))(shredded(t))
)
query("B01_strip_empty", "SELECT pos, name, CASE WHEN pos % 3 > 0 THEN brand END AS brand, CASE WHEN pos % 2 = 0 THEN type ELSE concat(type, '|', name) END AS tags FROM {compounds} c")(
    lambda t: L.strip_empty(t.compounds.select("pos", "name", "evidence", F.when(C("pos") % 3 == 0, "  ").otherwise(C("brand")).alias("brand"), F.array(C("type"), F.when(C("pos") % 2 == 0, " ").otherwise(C("name"))).alias("tags")), ("pos",)).withColumn("tags", F.array_join("tags", "|"))
)
query("B02_clean_entities", "SELECT pathway_id, min(pos) AS pos, name FROM {compounds} c WHERE pos % 9 > 0 GROUP BY pathway_id, name")(
    lambda t: L.clean_entities(t.compounds.select("pathway_id", F.lit("compound").alias("kind"), "pos", F.when(C("pos") % 9 == 0, " ").otherwise(F.concat(F.lit(" "), "name")).alias("name"))).drop("kind")
)
query("B03_clean_states", "SELECT id, name FROM {states} s WHERE id % 3 > 0")(
    lambda t: L.clean_states(t.states.select("id", *[F.when(C("id") % 3 == 0, " ").otherwise(C("name") if k == "name" else F.lit("")).alias(k) for k in ("name", "species", "cell_type", "tissue", "subcellular_location")])).select("id", "name")
)
query("B04_clean_locations", "SELECT id, entity, CASE WHEN id % 2 = 0 THEN state END AS state FROM {located} l WHERE id % 5 > 0")(
    lambda t: L.clean_locations(t.located.select("id", F.when(C("id") % 5 == 0, "").otherwise(F.concat("entity", F.lit(" "))).alias("entity"), F.when(C("id") % 2 == 0, C("state")).otherwise(" ").alias("state")))
)
query("B05_clean_participants", """SELECT pathway_id, process, role, min(k) AS k, entity FROM (SELECT pathway_id, process, role, pos * 10 AS k, entity FROM {participants} p UNION ALL SELECT pathway_id, process, role, pos * 10 + 1, concat('x', pos % 2) FROM {participants} p WHERE pos % 3 = 0) GROUP BY pathway_id, process, role, entity""")(
    lambda t: L.clean_participants(t.participants.withColumn("entity", F.when(C("pos") % 3 == 0, F.concat("entity", F.lit(" + x"), C("pos") % 2)).otherwise(C("entity")))).select("pathway_id", "process", "role", (C("pos") * 10 + C("sub")).alias("k"), "entity")
)
query("B05_complete_processes", "SELECT x.pathway_id, x.process FROM {processes} x WHERE EXISTS (SELECT 1 FROM {participants} p WHERE p.process = x.process AND role = 'reactant') AND EXISTS (SELECT 1 FROM {participants} p WHERE p.process = x.process AND role = 'product')")(
    lambda t: L.complete_processes(t.processes.withColumn("kind", F.lit("reaction")), t.participants).select("pathway_id", "process")
)
query("B06_scope_filter", "SELECT pathway_id, process, pos FROM {processes} x WHERE status <> 'P'")(lambda t: L.in_scope(scoped(t)).select("pathway_id", "process", "pos"))
query("B06_removed_by_scope", "SELECT pathway_id, count(*) AS removed, string_agg(priority, '|' ORDER BY pos) AS names FROM {processes} x WHERE status = 'P' GROUP BY 1")(lambda t: L.removed_by_scope(scoped(t)))


def scoped(t):
    return t.processes.withColumn("scope", F.when(C("status") == "P", "out_of_scope").when(C("status") == "F", "core")).withColumn("name", C("priority"))


query("B07_relevant_chunks", "SELECT event_id FROM events WHERE event_id % 4 = 0 OR value / 20 >= 0.3")(lambda t: L.relevant(t.events.select("event_id", F.when(C("event_id") % 4 > 0, C("value") / 20).alias("relevance"))).select("event_id"))
query("B09_protein_like", "SELECT s_suppkey AS id, s_suppkey % 4 = 0 OR s_suppkey % 7 = 0 AS is_protein FROM supplier")(
    lambda t: L.protein_like(t.proteins.withColumn("name", F.when(C("id") % 7 == 0, F.concat("name", F.lit(" Receptor"))).otherwise(C("name"))), t.proteins.where("id % 4 = 0").withColumn("name", F.when(C("id") % 7 == 0, F.concat("name", F.lit("  receptor"))).otherwise(F.upper("name")))).select("id", "is_protein")
)
query("B10_scaffolds", "SELECT DISTINCT pathway_id, split_part(name, ' ', 1) AS norm FROM {compounds} c UNION SELECT DISTINCT pathway_id, 'thyroglobulin' FROM {compounds} c")(lambda t: L.scaffolds(t.compounds.select("pathway_id", F.replace("name", F.lit(" "), F.lit(" : ")).alias("name"))))
query("B18_normal_additions", "SELECT event_id, props AS entities, CASE WHEN event_id % 3 = 2 THEN NULL ELSE '[1]' END AS processes FROM events".replace("props AS entities", "CASE WHEN event_id % 3 = 1 THEN '{\"processes\":[1]}' ELSE concat('{\"k\":\"', event_type, '\"}') END AS entities"))(
    lambda t: L.normal_additions(t.events.withColumn("e", F.concat(F.lit('{"k":"'), "event_type", F.lit('"}'))).select("event_id", F.when(C("event_id") % 3 == 0, F.concat(F.lit('{"additions":{"entities":'), "e", F.lit(',"processes":[1]}}'))).when(C("event_id") % 3 == 1, F.lit('{"entities":{"processes":[1]}}')).otherwise(F.concat(F.lit('{"entities":'), "e", F.lit("}"))).alias("json"))).drop("json")
)
query("B19_fold_modifiers", """SELECT pathway_id, process, arg_min(pos, CASE WHEN pos % 2 = 0 THEN 0 ELSE 1000 END + pos) AS pos, modifier AS entity, 'enzyme' AS role FROM {participants} p GROUP BY pathway_id, process, modifier""")(
    lambda t: L.fold_modifiers(t.participants.select("pathway_id", "process", "pos", C("modifier").alias("entity"), F.when(C("pos") % 2 == 0, "enzyme").otherwise("modifier").alias("role")))
)
