"""Queries of references, places, actors, gates and rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import vocab
from pathloom.operators import graph as G
from pathloom.operators import integrity as I
from pathloom.operators import rewrite as R
from pathloom.plans.durable import durable
from pathloom.plans.registry import query

C = F.col
NAMED = "(SELECT p.pathway_id, process, pos, role, p_name AS entity, concat('c', p_partkey) AS code, modifier, p_size FROM {participants} p JOIN part ON concat('c', p_partkey) = entity)"


def named(t):
    return t.participants.join(t.part, F.expr("concat('c', p_partkey) = entity")).select("pathway_id", "process", "pos", "role", C("p_name").alias("entity"), C("entity").alias("code"), "modifier", "p_size")


def registry(t):
    """Names that a pathway registers: those of its odd sizes."""
    return named(t).where("p_size % 2 = 1").select("pathway_id", F.when(C("p_size") % 3 == 0, "protein").otherwise("compound").alias("kind"), F.upper("entity").alias("name"), "pos").distinct()


KNOWN = f"(SELECT DISTINCT pathway_id, entity FROM {NAMED} n WHERE p_size % 2 = 1)"
query("C02_unknown_references", f"SELECT pathway_id, process, pos, role, entity, code FROM {NAMED} n WHERE NOT EXISTS (SELECT 1 FROM {KNOWN} k WHERE k.pathway_id = n.pathway_id AND k.entity = n.entity)")(lambda t: I.unknown_references(named(t), registry(t)).drop("modifier", "p_size"))
query("C03_missing_entities", f"SELECT DISTINCT pathway_id, entity AS name FROM {NAMED} n WHERE NOT EXISTS (SELECT 1 FROM {KNOWN} k WHERE k.pathway_id = n.pathway_id AND k.entity = n.entity)")(lambda t: I.missing_entities(named(t), registry(t)))
query("C03_resolve_kinds", f"SELECT n.pathway_id, process, pos, entity, code, CASE WHEN k.n > 0 THEN 'protein' WHEN k.n = 0 THEN 'compound' END AS kind FROM {NAMED} n LEFT JOIN (SELECT pathway_id, entity, count(*) FILTER (p_size % 3 = 0) AS n FROM {NAMED} m WHERE p_size % 2 = 1 GROUP BY 1, 2) k USING (pathway_id, entity)")(
    lambda t: I.resolve_kinds(named(t), registry(t)).drop("role", "modifier", "p_size")
)
query("C03_promote_proteins", "SELECT pathway_id, CASE WHEN bool_or(pos % 5 = 0) OVER (PARTITION BY pathway_id, name) THEN 'protein' ELSE 'compound' END AS kind, name, pos FROM {compounds} c")(
    lambda t: I.promote_to_proteins(t.compounds.select("pathway_id", F.lit("compound").alias("kind"), "name", "pos"), t.compounds.where("pos % 5 = 0"))
)


def placed(t):
    """Locations: parts are in states by line, states in places by nation and region."""
    loc = t.participants.where("pos % 3 > 0").select("pathway_id", "entity", (C("process") * 10 + C("pos")).alias("pos"), F.concat(F.lit("s"), C("process") % 5, F.lit("_"), C("pos") % 3).alias("state"))
    st = loc.select("pathway_id", C("state").alias("name"), F.substring("state", 2, 1).alias("place"), F.substring("state", 4, 1).cast("int").alias("pos")).distinct()
    return loc, st


LOC = "(SELECT pathway_id, entity, process * 10 + pos AS pos, CAST(process % 5 AS VARCHAR) AS place, concat('s', process % 5, '_', pos % 3) AS state, pos % 3 AS k FROM {participants} p WHERE pos % 3 > 0)"
query("C18_primary_place", f"SELECT DISTINCT p.pathway_id, p.entity, coalesce(l.place, 'cell') AS place FROM {{participants}} p LEFT JOIN (SELECT pathway_id, entity, arg_min(place, (pos, place)) AS place FROM {LOC} x GROUP BY 1, 2) l USING (pathway_id, entity)")(lambda t: I.primary_places(*placed(t), t.participants))
query("C26_places_of_entities", f"SELECT pathway_id, entity, string_agg(DISTINCT place, '|' ORDER BY place) AS places FROM {LOC} x GROUP BY 1, 2")(lambda t: I.places_of(*placed(t)).withColumn("places", F.array_join("places", "|")))
query("C17_backfill_states", f"""WITH e AS (SELECT pathway_id, entity, arg_max(place, pos) AS place FROM (SELECT pathway_id, entity, max(pos) AS pos, max(place) AS place FROM {LOC} x GROUP BY pathway_id, entity, pos) GROUP BY 1, 2),
    s AS (SELECT pathway_id, process, min(place) AS place FROM {{participants}} p JOIN e USING (pathway_id, entity) GROUP BY 1, 2 HAVING min(place) = max(place)) SELECT s.pathway_id, process, concat('s', place, '_', k) AS state FROM s JOIN (SELECT pathway_id, place, min(k) AS k FROM {LOC} x GROUP BY 1, 2) f USING (pathway_id, place)""")(
    lambda t: I.backfill_states(t.participants, *placed(t))
)
query("K05_auto_states", "SELECT pathway_id, process, CASE WHEN process % 4 = 0 THEN '__auto_state__' ELSE state END AS state FROM {processes} x")(lambda t: I.auto_states(*blank(t))[0].select("pathway_id", "process", "state"))
query("K05_states_added", "SELECT DISTINCT pathway_id, state AS name, 'p' AS place FROM {processes} x WHERE process % 4 > 0 UNION ALL SELECT DISTINCT pathway_id, '__auto_state__', 'cell' FROM {processes} x WHERE process % 4 = 0")(lambda t: I.auto_states(*blank(t))[1])


def blank(t):
    p = t.processes.withColumn("state", F.when(C("process") % 4 == 0, " ").otherwise(C("state")))
    return p, p.where("state <> ' '").select("pathway_id", C("state").alias("name"), F.lit("p").alias("place")).distinct()


def told(t):
    """Processes whose text names a supplier; actors are the suppliers of the pathway."""
    sup = durable(t.participants.join(t.supplier, F.expr("concat('p', s_suppkey) = modifier")).select("pathway_id", "process", "pos", C("s_name").alias("actor")))
    procs = durable(t.processes.select("pathway_id", "process").join(sup.where("pos = 1").groupBy("process").agg(F.min("actor").alias("a")), "process", "left")).withColumn("text", F.concat(F.lit("done by "), F.lower("a")))
    return procs, sup.select("pathway_id", "actor").distinct().withColumns({"rank": F.lit(1), "pos": F.lit(0)}), sup.where("pos = 2").select("pathway_id", "process", "actor")


TOLD = "(SELECT x.pathway_id, x.process, a FROM {processes} x JOIN (SELECT process, min(s_name) AS a FROM {participants} p JOIN supplier ON concat('p', s_suppkey) = modifier WHERE pos = 1 GROUP BY 1) s USING (process))"
HAS = "(SELECT process, s_name FROM {participants} p JOIN supplier ON concat('p', s_suppkey) = modifier WHERE pos = 2)"
query("C12_inject_actors", f"SELECT pathway_id, process, a AS actor, 1 AS rank, 0.9::DOUBLE AS confidence FROM {TOLD} t WHERE NOT EXISTS (SELECT 1 FROM {HAS} h WHERE h.process = t.process AND h.s_name = t.a)")(lambda t: (lambda p, a, e: I.inject_actors(p, a, e, C("text")))(*told(t)))
query("C13_single_enzyme", f"SELECT pathway_id, process, a AS actor FROM {TOLD} t WHERE NOT EXISTS (SELECT 1 FROM {HAS} h WHERE h.process = t.process)")(lambda t: (lambda p, a, e: I.single_enzyme(p, a, e, C("text")))(*told(t)))


@query("C11_attach_transporters", f"SELECT pathway_id, process, a AS actor, CASE WHEN process % 2 = 0 THEN 0 ELSE 1 END AS how FROM {TOLD} t WHERE NOT EXISTS (SELECT 1 FROM {HAS} h WHERE h.process = t.process)")
def _transporters(t):
    p, a, e = told(t)
    moves = p.where("a is not null").select("pathway_id", "process", F.when(C("process") % 2 == 0, F.concat(F.lit("moved VIA the "), "a", F.lit("."))).otherwise("moved").alias("evidence"), F.concat(F.lit("f"), "process").alias("from_state"), F.lit("out").alias("to_state"), F.concat(F.lit("cargo"), "process", F.lit(";")).alias("cargo"))
    placed_ = p.where("a is not null and process % 2 = 1").select("pathway_id", C("a").alias("actor"), F.concat(F.lit("f"), "process").alias("state"), F.concat(F.lit("carries Cargo"), "process", F.lit("; out")).alias("evidence"))
    return I.attach_transporters(moves, a, e, placed_)


def inter(t):
    p, a, _ = told(t)
    procs = t.processes.withColumn("name", F.concat(F.lit("step "), "process", F.lit(" end")))
    i = p.where("a is not null").select("pathway_id", C("process").alias("pos"), C("a").alias("entity_1"), F.when(C("process") % 2 == 0, "inhibits").otherwise("carries").alias("relationship"), F.when(C("process") % 3 == 0, F.concat(F.lit("Step "), "process", F.lit(" end"))).when(C("process") % 3 == 1, F.concat(F.lit("before step "), "process", F.lit(" end and after"))).otherwise("elsewhere").alias("entity_2"))
    return i, procs, a


query("C14_promote_interactions", f"SELECT pathway_id, process, process AS pos, a AS actor, CASE WHEN process % 2 = 0 THEN 'inhibitor' ELSE 'transporter' END AS role FROM {TOLD} t WHERE process % 3 < 2")(lambda t: I.promote_interactions(*inter(t))[0])
query("C14_interactions_left", f"SELECT pathway_id, process AS pos FROM {TOLD} t WHERE process % 3 = 2")(lambda t: I.promote_interactions(*inter(t))[1].select("pathway_id", "pos"))


@query("C15_promote_catalysts", """WITH p AS (SELECT pathway_id, process, pos, CASE WHEN role = 'product' AND pos % 4 = 0 THEN concat('c1', CAST(process % 10 AS VARCHAR), ':', entity) ELSE entity END AS entity, role FROM {participants} p),
    o AS (SELECT pathway_id, process, CASE WHEN role = 'reactant' AND entity LIKE '%3' AND entity NOT LIKE 'c1_' AND NOT EXISTS (SELECT 1 FROM {participants} q WHERE q.process = p.process AND q.role = 'product' AND q.pos % 4 = 0 AND q.entity = p.entity) THEN 'modifier' ELSE role END AS role, pos, entity FROM p),
    s AS (SELECT DISTINCT pathway_id, process, concat('c1', CAST(process % 10 AS VARCHAR)) AS part FROM p WHERE role = 'product' AND pos % 4 = 0 UNION SELECT pathway_id, process, entity FROM {participants} q WHERE role = 'product' AND pos % 4 = 0 AND entity LIKE 'c1_')
    SELECT pathway_id, process, role, CAST(pos AS BIGINT) AS pos, entity FROM o UNION ALL SELECT pathway_id, process, 'reactant', 0, part FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.process = s.process AND role = 'reactant' AND entity = part)""")
def _catalysts(t):
    p = t.participants.withColumn("entity", F.when((C("role") == "product") & (C("pos") % 4 == 0), F.concat(F.lit("c1"), C("process") % 10, F.lit(":"), "entity")).otherwise(C("entity")))
    proteins = t.participants.where("entity like '%3'").select("pathway_id", C("entity").alias("name"))
    sc = t.participants.select("pathway_id").distinct().select("pathway_id", F.explode(F.array(*[F.lit(f"c1{i}") for i in range(10)])).alias("norm"))
    return I.promote_catalysts(p.select("pathway_id", "process", "role", "pos", "entity"), proteins, sc).withColumn("pos", C("pos").cast("long"))


query("C16_normalise_actors", "SELECT s_suppkey AS process, concat(CASE s_suppkey % 3 WHEN 0 THEN lower(s_name) WHEN 1 THEN concat(replace(s_name, ' ', '_'), ' complex') ELSE concat('x', s_name) END) AS actor, s_nationkey AS pathway_id, s_name AS entity, 'protein' AS entity_type FROM supplier WHERE s_suppkey % 3 < 2")(
    lambda t: I.normalise_actors(t.proteins.select("pathway_id", C("id").alias("process"), F.when(C("id") % 3 == 0, F.lower("name")).when(C("id") % 3 == 1, F.concat(F.replace("name", F.lit(" "), F.lit("_")), F.lit(" complex"))).otherwise(F.concat(F.lit("x"), "name")).alias("actor")), t.proteins.select("pathway_id", F.lit("protein").alias("kind"), "name", "pos"))
)
query("C22_both_kinds", "SELECT DISTINCT pathway_id, name AS norm FROM {compounds} c WHERE pos % 2 = 0 INTERSECT SELECT pathway_id, name FROM {compounds} c WHERE pos % 3 = 0")(lambda t: I.both_kinds(t.compounds.where("pos % 2 = 0"), t.compounds.where("pos % 3 = 0")))
query("K06_composite_gate", "SELECT pathway_id, 'error' AS severity, 'composite_token' AS rule, concat(entity, ' + x') AS subject FROM {participants} p WHERE pos = 5")(lambda t: I.composite_issues(t.participants.withColumn("entity", F.when(C("pos") == 5, F.concat("entity", F.lit(" + x"))).when(C("pos") == 4, F.concat("entity", F.lit("2+"))).otherwise(C("entity")))))
query("K07_scaffold_modifier_gate", "SELECT pathway_id, 'error' AS severity, 'scaffold_as_modifier' AS rule, modifier AS subject FROM {participants} p WHERE modifier = 'p7'")(lambda t: I.scaffold_modifier_issues(t.participants.withColumnRenamed("modifier", "actor"), t.participants.select("pathway_id", F.lit("p7").alias("norm")).distinct()))


def gates(t):
    p = durable(t.participants.select("pathway_id", "process", "pos", "entity", "modifier"))  # eight tables stand on it
    reg = p.where("pos < 6").select("pathway_id", F.when(C("pos") % 2 == 0, "protein").otherwise("compound").alias("kind"), C("entity").alias("name")).union(p.where("pos < 7").select("pathway_id", F.lit("protein"), "modifier")).distinct()
    return I.strict_gates(p, p.withColumnRenamed("modifier", "actor").select("pathway_id", "process", "actor"), reg, p.select("pathway_id", F.lit("p7").alias("norm")).distinct(), G.ends(p))


query("K08_strict_gates", """WITH p AS (SELECT * FROM {participants} q), reg AS (SELECT DISTINCT pathway_id, CASE WHEN pos % 2 = 0 THEN 'protein' ELSE 'compound' END AS kind, entity AS name FROM p WHERE pos < 6 UNION SELECT pathway_id, 'protein', modifier FROM p WHERE pos < 7),
    i AS (SELECT pathway_id, 'unknown_participant' AS rule FROM p WHERE (pathway_id, entity) NOT IN (SELECT pathway_id, name FROM reg) UNION ALL SELECT pathway_id, 'unknown_actor' FROM p WHERE (pathway_id, modifier) NOT IN (SELECT pathway_id, name FROM reg)
    UNION ALL SELECT pathway_id, 'scaffold_as_modifier' FROM p WHERE modifier = 'p7' UNION ALL SELECT pathway_id, 'isolated_protein' FROM reg WHERE kind = 'protein' AND (pathway_id, name) NOT IN (SELECT pathway_id, entity FROM p)) SELECT pathway_id, rule, count(*) AS n FROM i GROUP BY 1, 2""")(
    lambda t: gates(t).groupBy("pathway_id", "rule").agg(F.count("*").alias("n"))
)
query("K08_quarantine", "SELECT o_custkey AS pathway_id, CAST(count(*) AS BIGINT) AS errors FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")(lambda t: I.quarantine(t.processes.select("pathway_id").distinct(), t.processes.select("pathway_id", F.when(C("status") == "P", "error").otherwise("warning").alias("severity")))[1])


query("K10_gap_issues", """SELECT pathway_id, pos, name, kind, gap FROM (SELECT *, row_number() OVER (PARTITION BY pathway_id ORDER BY pos, kind, name, k) AS rn FROM (SELECT pathway_id, pos, name, CASE WHEN pos % 2 = 0 THEN 'protein' ELSE 'compound' END AS kind, unnest([0, 1, 2]) AS k, unnest([CASE WHEN pos % 3 = 0 THEN 'needs_id' END, CASE WHEN pos % 5 > 0 THEN 'needs_location' END, CASE WHEN pos % 2 = 0 AND pos % 7 = 0 THEN 'needs_organism' END]) AS gap FROM {proteins} x) WHERE gap IS NOT NULL) WHERE rn <= 5""")(
    lambda t: I.gap_issues(t.proteins.select("pathway_id", "pos", "name", F.when(C("pos") % 2 == 0, "protein").otherwise("compound").alias("kind"), F.create_map(F.lit("db"), F.when(C("pos") % 3 == 0, "").otherwise("x")).alias("mapped_ids"), F.when(C("pos") % 7 == 0, "").otherwise("human").alias("organism")), t.proteins.where("pos % 5 = 0").select("pathway_id", C("name").alias("entity")), t.proteins.limit(0).select("pathway_id", "pos", "name", F.lit("").alias("place")), 5)
)
query("C27_place_alias_hints", "SELECT s_nationkey AS pathway_id, 'cytoplasm' AS alias, 'cytosol' AS target FROM supplier GROUP BY 1 HAVING count(*) FILTER (s_suppkey % 3 = 0) > 0 AND count(*) FILTER (s_suppkey % 3 = 1) > 0")(
    lambda t: I.alias_hints(t.proteins.select("pathway_id", F.when(C("id") % 3 == 0, "Cytoplasm").when(C("id") % 3 == 1, "cytosol").otherwise("x").alias("name")), vocab.COMPARTMENT_ALIASES)
)


def composites(t):
    """Every fifth name is a composite: of a protein, of a protein with evidence, or of none."""
    p = t.participants.withColumn("evidence", F.when(C("process") % 2 == 0, F.concat(F.lit("so p"), "pos", F.lit(" bound to "), "entity")).otherwise(""))
    p = p.withColumn("entity", F.when(C("pos") == 3, F.concat(F.lit("p"), "pos", F.lit(" + "), "entity")).when(C("pos") == 4, F.concat(F.lit("p"), "pos", F.lit(" + "), "entity")).when(C("pos") == 5, F.concat(F.lit("x + "), "entity")).otherwise(C("entity")))
    return p.select("pathway_id", "process", "role", "pos", "entity", "evidence"), p.select("pathway_id", F.explode(F.array(F.lit("p3"), F.lit("p4"))).alias("name")).distinct()


FATE = "(SELECT *, CASE WHEN pos = 5 THEN 'error' WHEN pos = 4 AND process % 2 = 1 THEN 'split' WHEN pos IN (3, 4) THEN 'complex' END AS fate FROM {participants} p)"
query("K01_composite_rewrite", f"SELECT pathway_id, process, role, pos, sub, e AS entity FROM (SELECT pathway_id, process, role, pos, 0 AS sub, CASE WHEN fate = 'complex' THEN concat('p', pos, ':', entity) WHEN fate = 'split' THEN concat('p', pos) ELSE entity END AS e FROM {FATE} f WHERE fate IS DISTINCT FROM 'error' UNION ALL SELECT pathway_id, process, role, pos, 1, entity FROM {FATE} f WHERE fate = 'split')")(
    lambda t: (lambda p, k: R.apply_composites(p, R.decide_composites(p, k))[0].drop("evidence"))(*composites(t))
)
query("K01_composite_errors", f"SELECT pathway_id, 'error' AS severity, 'composite_without_protein' AS rule, concat('x + ', entity) AS subject FROM {FATE} f WHERE fate = 'error'")(lambda t: (lambda p, k: R.apply_composites(p, R.decide_composites(p, k))[2])(*composites(t)))
query("K02_complexes", f"SELECT DISTINCT pathway_id, concat('p', pos, ':', entity) AS name, concat('p', pos, '|', entity) AS components FROM {FATE} f WHERE fate = 'complex'")(lambda t: (lambda p, k: R.apply_composites(p, R.decide_composites(p, k))[1].withColumn("components", F.array_join("components", "|")))(*composites(t)))
query("K03_bind_scaffolds", """WITH pr AS (SELECT pathway_id, process, concat(entity, 'x') AS e, min(pos) AS pos FROM {participants} p WHERE role = 'product' GROUP BY 1, 2, 3),
    o AS (SELECT pathway_id, process, list(e ORDER BY pos, e) AS es, list(pos ORDER BY pos, e) AS ps FROM pr GROUP BY 1, 2),
    b AS (SELECT pathway_id, process, ps[1] AS pos, -2 AS s_pos, 'tg' AS scaffold, es[1] AS entity, CASE WHEN process % 4 = 0 THEN 2 ELSE 1 END AS score FROM o WHERE process % 4 < 2
    UNION ALL SELECT pathway_id, process, ps[2], -1, 'sc', es[2], 1 FROM o WHERE process % 4 = 0 AND len(es) > 1 UNION ALL SELECT pathway_id, process, 100, -1, 'sc', 'water', 2 FROM o WHERE process % 4 = 2)
    SELECT *, concat(scaffold, ':', entity) AS complex FROM b""")(lambda t: scaffold_outputs(t))


def scaffold_outputs(t):
    """Two scaffolds and a by-product come out of each reaction beside its products. The text has both bind the first product,
    or the second scaffold the by-product, in words or as a composite."""
    out = t.participants.where("role = 'product'").groupBy("pathway_id", "process", F.concat("entity", F.lit("x")).alias("entity")).agg(F.min("pos").alias("pos"))
    two = F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity"))), lambda s: s["entity"])
    first, second = F.get("e", F.lit(0)), F.coalesce(F.get("e", F.lit(1)), F.lit("?"))
    evidence = F.when(C("process") % 4 == 0, F.concat(F.lit("tg + "), first, F.lit("; sc bound to "), first, F.lit("; sc - "), second, F.lit(" complex"))).when(C("process") % 4 == 1, F.concat(F.lit("TG bound to "), first, F.lit(", sc + "), first, F.lit("; sc bound to water"))).when(C("process") % 4 == 2, F.lit("tg bound to water and sc + water")).otherwise("")
    told = out.groupBy("pathway_id", "process").agg(two.alias("e")).select("pathway_id", "process", evidence.alias("evidence"))
    own = told.select("pathway_id", "process", F.inline(F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(e).alias("entity")) for p, e in ((-2, "tg"), (-1, "sc"), (100, "water"))])), "evidence")
    rows = out.join(told, ["pathway_id", "process"]).select("pathway_id", "process", "pos", "entity", "evidence").unionByName(own)
    return R.bind_scaffolds(rows, told.select("pathway_id", F.explode(F.array(F.lit("tg"), F.lit("sc"))).alias("norm")).distinct())


query("K04_remove_complexes", "SELECT pathway_id, process, role, pos, CASE WHEN role = 'product' THEN entity ELSE e END AS entity FROM (SELECT *, unnest(CASE WHEN role = 'product' THEN [entity] ELSE ['z', entity] END) AS e FROM {participants} p WHERE pos < 4) UNION ALL SELECT pathway_id, process, role, pos, concat('y:', entity) FROM {participants} p WHERE pos >= 4")(
    lambda t: (lambda p: R.remove_complexes(p, p.where("pos < 4").select("pathway_id", C("entity").alias("name"))))(t.participants.select("pathway_id", "process", "role", "pos", F.concat(F.when(C("pos") < 4, "z:").otherwise("y:"), "entity").alias("entity")))
)
query("K04_byproduct_complexes", "SELECT s_nationkey AS pathway_id, concat(s_name, ':water') AS name FROM supplier WHERE s_suppkey % 3 = 0")(
    lambda t: R.byproduct_complexes(t.proteins.select("pathway_id", F.concat("name", F.when(C("id") % 3 < 2, ":water").otherwise(":x")).alias("name")), t.proteins.where("id % 3 = 1").select("pathway_id", F.concat("name", F.lit(" + water")).alias("evidence")).union(t.proteins.select("pathway_id", F.lit("none"))))
)
