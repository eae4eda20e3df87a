"""Queries of the graph operators over the participants stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import graph as G
from pathloom.plans.durable import drop, durable
from pathloom.plans.registry import query

C = F.col

ADJ = """(SELECT DISTINCT pathway_id, a, b FROM (SELECT pathway_id, concat('entity:', entity) AS a, concat('process:', process) AS b FROM {participants} p
    UNION ALL SELECT pathway_id, concat('actor:', modifier), concat('process:', process) FROM {participants} p
    UNION ALL SELECT pathway_id, concat('process:', process), concat('entity:', entity) FROM {participants} p
    UNION ALL SELECT pathway_id, concat('process:', process), concat('actor:', modifier) FROM {participants} p))"""
ONE = """(SELECT DISTINCT pathway_id, a, b FROM (SELECT pathway_id, concat('entity:', entity) AS a, concat('process:', process) AS b FROM {participants} p
    UNION ALL SELECT pathway_id, concat('process:', process), concat('entity:', entity) FROM {participants} p))"""


def reach(adj):
    return f"WITH RECURSIVE adj AS MATERIALIZED (SELECT * FROM {adj}), r(pathway_id, node, o) AS (SELECT DISTINCT pathway_id, a, a FROM adj UNION SELECT r.pathway_id, r.node, adj.b FROM r JOIN adj ON r.pathway_id = adj.pathway_id AND r.o = adj.a), m AS (SELECT pathway_id, node, min(o) AS component FROM r GROUP BY 1, 2)"


def adj(t, actors=True):
    return G.adjacency(t.participants, t.participants.select("pathway_id", "process", C("modifier").alias("actor")) if actors else None)


query("H01_qa_graph", f"""SELECT * FROM {ADJ} UNION ALL (SELECT pathway_id, a, b FROM (SELECT DISTINCT pathway_id, concat('state:', state) AS a, concat('process:', process) AS b FROM {{processes}} x)
    UNION ALL SELECT pathway_id, b, a FROM (SELECT DISTINCT pathway_id, concat('state:', state) AS a, concat('process:', process) AS b FROM {{processes}} x))""")(
    lambda t: G.adjacency(t.participants, t.participants.select("pathway_id", "process", C("modifier").alias("actor")), t.processes)
)
query("H02_connected_components", reach(ONE) + " SELECT pathway_id, node, component FROM m")(lambda t: G.components(adj(t, False)))
query("H03_degrees", f"SELECT pathway_id, a AS node, count(DISTINCT b) AS degree FROM {ADJ} GROUP BY 1, 2")(lambda t: G.degrees(adj(t)))
query("H04_qa_components", reach(ONE) + ", s AS (SELECT pathway_id, component, count(*) AS n FROM m GROUP BY 1, 2) SELECT pathway_id, count(*) AS components, CAST(sum(n) AS BIGINT) AS nodes, max(n) AS main_size, CAST(sum(n) - max(n) AS BIGINT) AS orphans FROM s GROUP BY 1")(
    lambda t: G.component_report(G.components(adj(t, False)))
)


@query("H05_graph_summary", reach(ONE) + """, s AS (SELECT pathway_id, component, count(*) AS n FROM m GROUP BY 1, 2), x AS (SELECT pathway_id, count(*) AS components, sum(n) AS nodes, max(n) AS big FROM s GROUP BY 1),
    e AS (SELECT pathway_id, count(*) AS edges FROM adj WHERE a < b GROUP BY 1),
    p AS (SELECT q.pathway_id, count(*) AS proteins, count(l.a) AS attached FROM (SELECT DISTINCT pathway_id, concat('entity:c', CASE WHEN pos % 2 = 0 THEN substr(modifier, 2) ELSE substr(entity, 2) END) AS node FROM {participants} y) q LEFT JOIN (SELECT DISTINCT pathway_id, a FROM adj) l ON l.pathway_id = q.pathway_id AND l.a = q.node GROUP BY 1)
    SELECT pathway_id, CAST(nodes AS BIGINT) AS nodes, edges, components, round(100 * big / nodes, 2) AS largest_percent, proteins - attached AS loose_proteins, round(100 * attached / proteins, 2) AS attached_percent FROM x JOIN e USING (pathway_id) JOIN p USING (pathway_id)""")
def _summary(t):
    a = adj(t, False)
    node = F.concat(F.lit("entity:c"), F.when(C("pos") % 2 == 0, F.substring("modifier", 2, 20)).otherwise(F.substring("entity", 2, 20)))
    return G.summary(a, G.components(a), t.participants.select("pathway_id", node.alias("node")))


query("F02_dangling_nodes", f"SELECT pathway_id, node, degree, rn FROM (SELECT *, row_number() OVER (PARTITION BY pathway_id ORDER BY degree, node) AS rn FROM (SELECT pathway_id, a AS node, count(DISTINCT b) AS degree FROM {ADJ} GROUP BY 1, 2) WHERE degree <= 1) WHERE rn <= 12")(lambda t: G.dangling(G.degrees(adj(t)), 12))


def draft(t):
    return drafted(t)[:2]


def drafted(t):
    """Entities by name, reactions named by priority, so that both repeat; and the table that both stand on."""
    both = t.participants.join(t.part, F.expr("concat('c', p_partkey) = entity"), "left").join(t.supplier, F.expr("concat('p', s_suppkey) = modifier"), "left")
    both = durable(both.select("pathway_id", "process", "pos", "role", "p_name", "s_name", C("p_partkey").isNotNull().alias("is_part"), C("s_suppkey").isNotNull().alias("is_supplier")))  # five tables stand on it
    parts, suppliers = both.where("is_part"), both.where("is_supplier")
    ents = parts.select("pathway_id", F.lit("compound").alias("kind"), (C("process") * 10 + C("pos")).alias("pos"), C("p_name").alias("name"))
    sup = suppliers.select("pathway_id", F.lit("protein").alias("kind"), (C("process") * 10 + C("pos")).alias("pos"), C("s_name").alias("name"))
    procs = t.processes.select("pathway_id", F.lit("reaction").alias("kind"), "pos", C("priority").alias("name"))
    part = parts.select("pathway_id", C("process").alias("process_pos"), "role", C("p_name").alias("entity"))
    mod = suppliers.where("pos % 3 = 0").select("pathway_id", C("process").alias("process_pos"), F.lit("catalyst").alias("role"), C("s_name").alias("entity"))
    loc = ents.where("pos % 3 = 0").select("pathway_id", "pos", C("name").alias("entity"), F.concat(F.lit("s"), C("pos") % 5).alias("state"))
    return *G.draft_graph(ents.unionByName(sup), procs, part.unionByName(mod), loc), both


_DRAFT = """ents AS (SELECT pathway_id, 'compound' AS kind, process * 10 + pos AS pos, p_name AS name FROM {participants} p JOIN part ON concat('c', p_partkey) = entity),
sup AS (SELECT pathway_id, 'protein' AS kind, process * 10 + pos AS pos, s_name AS name FROM {participants} p JOIN supplier ON concat('p', s_suppkey) = modifier),
loc AS (SELECT pathway_id, lower(name) AS id, arg_min(concat('s', pos % 5), pos) AS compartment FROM ents WHERE pos % 3 = 0 GROUP BY 1, 2),
things AS (SELECT e.pathway_id, e.id, label, kind, compartment FROM (SELECT pathway_id, lower(name) AS id, arg_min(name, pos) AS label, arg_min(kind, pos) AS kind FROM (SELECT * FROM ents UNION ALL SELECT * FROM sup) GROUP BY 1, 2) e LEFT JOIN loc USING (pathway_id, id)),
steps AS (SELECT pathway_id, concat(lower(priority), CASE WHEN rn > 1 THEN concat('_', rn) ELSE '' END) AS id, priority AS label, 'reaction' AS kind, NULL AS compartment, pos FROM (SELECT *, row_number() OVER (PARTITION BY pathway_id, lower(priority) ORDER BY pos) AS rn FROM {processes} x)),
nodes AS (SELECT * FROM things UNION ALL SELECT pathway_id, id, label, kind, compartment FROM steps),
ends AS (SELECT pathway_id, process, role, lower(p_name) AS entity FROM {participants} p JOIN part ON concat('c', p_partkey) = entity UNION ALL SELECT pathway_id, process, 'catalyst', lower(s_name) FROM {participants} p JOIN supplier ON concat('p', s_suppkey) = modifier WHERE pos % 3 = 0),
edges AS (SELECT DISTINCT ends.pathway_id, CASE WHEN role = 'product' THEN id ELSE entity END AS source, CASE WHEN role = 'product' THEN entity ELSE id END AS target, role FROM ends JOIN steps ON ends.pathway_id = steps.pathway_id AND process = pos)"""
#: A draft graph in which every flag occurs: some parts are proteins and some suppliers compounds, names tell of cofactors,
#: complexes, catalysis and transport.
_ODD = """, things_ AS (SELECT pathway_id, id, CASE WHEN kind = 'compound' AND length(id) % 11 = 0 THEN 'ATP' WHEN length(id) % 13 = 0 THEN concat(label, ' complex') ELSE label END AS label,
    CASE WHEN kind = 'compound' AND length(id) % 7 = 0 THEN 'protein' WHEN kind = 'protein' AND id LIKE '%3' THEN 'compound' ELSE kind END AS kind, compartment FROM things),
steps_ AS (SELECT pathway_id, id, concat(label, CASE length(id) % 3 WHEN 0 THEN ' Phosphorylation' WHEN 1 THEN ' transport' ELSE '' END) AS label, kind, compartment FROM steps), nodes_ AS (SELECT * FROM things_ UNION ALL SELECT * FROM steps_)"""
_FLAGS = """, ends_ AS MATERIALIZED (SELECT DISTINCT pathway_id, id FROM (SELECT pathway_id, source AS id FROM edges UNION ALL SELECT pathway_id, target FROM edges)),
fed AS MATERIALIZED (SELECT pathway_id, source AS entity, target AS id FROM edges WHERE role = 'reactant'), gives AS MATERIALIZED (SELECT pathway_id, target AS entity, source AS id FROM edges WHERE role = 'product'),
acted AS MATERIALIZED (SELECT DISTINCT pathway_id, target AS id FROM edges WHERE role IN ('catalyst', 'modifier')), both_ AS MATERIALIZED (SELECT DISTINCT pathway_id, id FROM fed SEMI JOIN gives USING (pathway_id, entity, id)),
cof AS MATERIALIZED (SELECT DISTINCT f.pathway_id, f.id FROM fed f JOIN nodes_ n ON n.pathway_id = f.pathway_id AND n.id = f.entity WHERE lower(n.label) IN ('atp', 'water')),
st AS MATERIALIZED (SELECT s.*, a.id IS NOT NULL AS act, b.id IS NOT NULL AS b, c.id IS NOT NULL AS c, regexp_matches(label, '(?i)\\bphosphorylation\\b') AS says, regexp_matches(label, '(?i)\\btransport\\b') AS moves
    FROM steps_ s LEFT JOIN acted a ON a.pathway_id = s.pathway_id AND a.id = s.id LEFT JOIN both_ b ON b.pathway_id = s.pathway_id AND b.id = s.id LEFT JOIN cof c ON c.pathway_id = s.pathway_id AND c.id = s.id),
kinds AS MATERIALIZED (SELECT e.pathway_id, e.role, a.label AS s_label, a.kind AS s_kind, b.label AS t_label, b.kind AS t_kind FROM edges e LEFT JOIN nodes_ a ON a.pathway_id = e.pathway_id AND a.id = e.source LEFT JOIN nodes_ b ON b.pathway_id = e.pathway_id AND b.id = e.target),
flags AS (SELECT pathway_id, 'missing_compartments' AS flag, label AS subject, 'no subcellular location recorded' AS reason FROM things_ WHERE compartment IS NULL
UNION ALL SELECT pathway_id, 'possible_complexes', label, 'name suggests a complex or subunit' FROM things_ WHERE regexp_matches(lower(label), '\\b(complex|subunit|hetero|homo)\\b|:')
UNION ALL SELECT pathway_id, 'missing_modifiers', label, concat_ws('; ', CASE WHEN says THEN 'reaction name implies enzymatic catalysis' END, CASE WHEN c THEN 'reactant list includes known cofactors' END) FROM st WHERE NOT act AND (says OR c)
UNION ALL SELECT pathway_id, 'transport_like_reactions', label, concat_ws('; ', CASE WHEN b THEN 'same species appear as both input and output' END, CASE WHEN moves THEN 'reaction name implies transport' END) FROM st WHERE b OR moves
UNION ALL SELECT n.pathway_id, 'orphan_nodes', label, 'degree 0' FROM nodes_ n ANTI JOIN ends_ e ON e.pathway_id = n.pathway_id AND e.id = n.id
UNION ALL SELECT DISTINCT pathway_id, 'inconsistent_class', CASE WHEN role = 'product' THEN t_label ELSE s_label END, CASE role WHEN 'catalyst' THEN 'compound used as catalyst' WHEN 'reactant' THEN concat('protein listed as reactant in ', t_label) ELSE concat('protein listed as product in ', s_label) END
    FROM kinds WHERE (role = 'catalyst' AND s_kind = 'compound') OR (role = 'reactant' AND s_kind = 'protein') OR (role = 'product' AND t_kind = 'protein')
UNION ALL SELECT pathway_id, 'missing_ids', label, kind FROM things_ WHERE length(id) % 5 = 0 UNION ALL SELECT pathway_id, 'empty_reactions', label, 'a side is empty' FROM steps_ WHERE length(id) % 4 = 0)"""


def odd(t):
    n, e, both = drafted(t)
    size = F.length("id")
    thing = C("kind") != "reaction"
    label = F.when((C("kind") == "compound") & (size % 11 == 0), "ATP").when(thing & (size % 13 == 0), F.concat("label", F.lit(" complex"))).when(thing, C("label")).otherwise(F.concat("label", F.when(size % 3 == 0, " Phosphorylation").when(size % 3 == 1, " transport").otherwise("")))
    kind = F.when((C("kind") == "compound") & (size % 7 == 0), "protein").when((C("kind") == "protein") & C("id").endswith("3"), "compound").otherwise(C("kind"))
    n, e = durable(n.select("pathway_id", "id", label.alias("label"), kind.alias("kind"), "compartment")), durable(e)
    drop(both)
    return n, e


def flagged(n, e):
    lost = n.where((C("kind") != "reaction") & (F.length("id") % 5 == 0)).select("pathway_id", C("label").alias("name"), "kind")
    return G.qa_flags(n, e, lost, n.where((C("kind") == "reaction") & (F.length("id") % 4 == 0)).select("pathway_id", C("label").alias("name")))


query("H06_draft_nodes", f"WITH {_DRAFT} SELECT * FROM nodes")(lambda t: draft(t)[0])
query("H06_draft_edges", f"WITH {_DRAFT} SELECT * FROM edges")(lambda t: draft(t)[1])
query("H07_orphan_nodes", f"WITH {_DRAFT}, ends_ AS MATERIALIZED (SELECT pathway_id, source AS id FROM edges UNION ALL SELECT pathway_id, target FROM edges) SELECT n.* FROM nodes n ANTI JOIN ends_ e ON e.pathway_id = n.pathway_id AND e.id = n.id")(lambda t: G.orphan_nodes(*draft(t)))
query("H08_qa_flags", f"WITH {_DRAFT}{_ODD}{_FLAGS} SELECT * FROM flags")(lambda t: flagged(*odd(t)))
query("D09_completeness", f"WITH {_DRAFT}{_ODD}{_FLAGS}" + """, i AS (SELECT pathway_id, count(*) AS issues FROM flags WHERE flag NOT IN ('possible_complexes', 'transport_like_reactions') GROUP BY 1)
    SELECT pathway_id, count(*) FILTER (kind <> 'reaction') AS species, count(*) FILTER (kind = 'reaction') AS reactions, coalesce(any_value(issues), 0) AS issues, round(greatest(0.0, 1 - coalesce(any_value(issues), 0) / greatest(1, count(*))), 3) AS score FROM nodes_ LEFT JOIN i USING (pathway_id) GROUP BY 1""")(
    lambda t: (lambda n, e: G.completeness(n, flagged(n, e)))(*odd(t))
)


@query("C19_duplicate_species", """WITH l AS (SELECT DISTINCT p_size AS pathway_id, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END AS label, p_brand AS ext FROM part),
    a AS (SELECT x.pathway_id, x.label AS a, y.label AS b, 0 AS r, 'normalized label collision' AS reason FROM l x JOIN l y ON x.pathway_id = y.pathway_id AND x.label < y.label AND regexp_replace(x.label, '[^a-z0-9]', '', 'g') = regexp_replace(y.label, '[^a-z0-9]', '', 'g')
    UNION SELECT x.pathway_id, x.label, y.label, 1, concat('shared external ID: brand:', x.ext) FROM l x JOIN l y ON x.pathway_id = y.pathway_id AND x.label < y.label AND x.ext = y.ext)
    SELECT pathway_id, a, b, arg_min(reason, concat(r, reason)) AS reason FROM a GROUP BY 1, 2, 3""")
def _dups(t):
    label = F.when(C("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(C("p_name"))
    n = t.part.select(C("p_size").alias("pathway_id"), label.alias("label"))
    return G.duplicate_species(n, t.part.select(C("p_size").alias("pathway_id"), label.alias("name"), F.lit("brand").alias("db"), C("p_brand").alias("ext")))


query("C20_producer_consumer", "SELECT DISTINCT m.pathway_id, m.process AS producer, u.process AS consumer FROM {participants} m JOIN {participants} u ON m.pathway_id = u.pathway_id AND m.entity = u.entity AND m.process <> u.process WHERE m.role = 'product' AND u.role = 'reactant' AND m.entity NOT LIKE '%7'")(
    lambda t: G.producer_consumer(t.participants, t.participants.where("entity like '%7'").select("entity").distinct())
)


def chain(t):
    """Orders of a customer feed the next one but two and three; every eleventh pair closes a cycle."""
    n = t.orders.select(C("o_custkey").alias("pathway_id"), C("o_orderkey").alias("node"))
    e = t.orders.alias("x").join(t.orders.alias("y"), F.expr("x.o_custkey = y.o_custkey and x.o_orderkey < y.o_orderkey and (x.o_orderkey + y.o_orderkey) % 3 = 0")).select(C("x.o_custkey").alias("pathway_id"), C("x.o_orderkey").alias("source"), C("y.o_orderkey").alias("target"))
    back = e.where("(source + target) % 33 = 0").select("pathway_id", C("target").alias("source"), C("source").alias("target"))
    return n, e, back


_CHAIN = "e AS MATERIALIZED (SELECT x.o_custkey AS pathway_id, x.o_orderkey AS s, y.o_orderkey AS t FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND (x.o_orderkey + y.o_orderkey) % 3 = 0)"
_PATHS = f"WITH RECURSIVE {_CHAIN}, n AS (SELECT o_custkey AS pathway_id, o_orderkey AS node FROM orders), p(pathway_id, node, d) AS (SELECT pathway_id, node, 0 FROM n UNION SELECT p.pathway_id, e.t, d + 1 FROM p JOIN e ON e.pathway_id = p.pathway_id AND e.s = p.node), k AS (SELECT pathway_id, node, max(d) AS rank FROM p GROUP BY 1, 2)"


@query("H11_topological_ranks", _PATHS + " SELECT pathway_id, node, rank, false AS in_cycle FROM k")
def _ranks(t):
    n, e, _ = chain(t)
    return G.topological_ranks(n, e)


@query("H11_cycles", f"""WITH RECURSIVE {_CHAIN}, a AS MATERIALIZED (SELECT * FROM e UNION SELECT pathway_id, t, s FROM e WHERE (s + t) % 33 = 0), r(pathway_id, x, y) AS (SELECT pathway_id, s, t FROM a UNION SELECT r.pathway_id, r.x, a.t FROM r JOIN a ON a.pathway_id = r.pathway_id AND a.s = r.y),
    c AS (SELECT DISTINCT pathway_id, x FROM r WHERE x = y), bad AS (SELECT pathway_id, x AS node FROM c UNION SELECT r.pathway_id, r.y FROM r JOIN c ON c.pathway_id = r.pathway_id AND c.x = r.x)
    SELECT o_custkey AS pathway_id, o_orderkey AS node, EXISTS (SELECT 1 FROM bad WHERE bad.pathway_id = o_custkey AND bad.node = o_orderkey) AS in_cycle FROM orders""")
def _cycles(t):
    n, e, back = chain(t)
    return G.topological_ranks(n, e.union(back)).drop("rank")


query("E04_lanes", _PATHS + " SELECT pathway_id, node, rank, row_number() OVER (PARTITION BY pathway_id, rank ORDER BY node) - 1 AS lane FROM k")(lambda t: G.lanes(G.topological_ranks(*chain(t)[:2])).drop("in_cycle"))
query("H12_prune_loose_proteins", f"SELECT x.pathway_id, kind, node FROM (SELECT DISTINCT pathway_id, CASE WHEN pos % 2 = 0 THEN 'protein' ELSE 'compound' END AS kind, concat('actor:p', substr(entity, 2)) AS node FROM {{participants}} p) x WHERE kind <> 'protein' OR EXISTS (SELECT 1 FROM {ADJ} a WHERE a.pathway_id = x.pathway_id AND a.a = x.node)")(
    lambda t: G.prune_loose(t.participants.select("pathway_id", F.when(C("pos") % 2 == 0, "protein").otherwise("compound").alias("kind"), F.concat(F.lit("actor:p"), F.substring("entity", 2, 20)).alias("node")).distinct(), adj(t))
)


@query("H10_same_as_groups", """SELECT p_size AS pathway_id, concat('c', p_partkey) AS name, first_value(concat('c', p_partkey)) OVER (PARTITION BY p_size, p_name, p_brand ORDER BY CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END, p_retailprice % 7 DESC, concat('c', p_partkey)) AS chosen
    FROM part QUALIFY count(*) OVER (PARTITION BY p_size, p_name, p_brand) > 1""")
def _same(t):
    from pyspark.sql import Window

    w = Window.partitionBy("p_size", "p_name", "p_brand").orderBy("p_partkey")
    e = t.part.withColumn("nxt", F.lead("p_partkey").over(w)).where("nxt is not null").select(C("p_size").alias("pathway_id"), F.concat(F.lit("c"), "p_partkey").alias("a"), F.concat(F.lit("c"), "nxt").alias("b"))
    uses = t.part.select(C("p_size").alias("pathway_id"), F.concat(F.lit("c"), "p_partkey").alias("name"), F.when(C("p_partkey") % 3 == 0, 0).otherwise(2).alias("rank"), (C("p_retailprice") % 7).alias("times"))
    return G.equivalence(e, uses)


@query("H09_normalised_draft", f"""WITH {_DRAFT}, lab AS (SELECT pathway_id, label, min(id) AS id, max(kind) AS kind, max(compartment) AS compartment, count(*) AS n FROM nodes WHERE kind <> 'reaction' GROUP BY 1, 2),
    r AS (SELECT pathway_id, id, label, kind, compartment FROM lab UNION ALL SELECT pathway_id, id, label, kind, compartment FROM steps) SELECT * FROM r""")
def _normal(t):
    n, e = draft(t)
    return G.normalise_draft(n, e, n.where("false").select("pathway_id", C("id").alias("a"), C("id").alias("b")))[0].select("pathway_id", "id", "label", "kind", "compartment")


@query("H13_reaction_summary", """WITH s AS (SELECT pathway_id, process, string_agg(entity, ' + ' ORDER BY pos, entity) FILTER (role = 'reactant') AS i, string_agg(entity, ' + ' ORDER BY pos, entity) FILTER (role = 'product') AS o, string_agg(modifier, ' + ' ORDER BY pos, modifier) FILTER (pos = 1) AS m FROM {participants} p GROUP BY 1, 2)
    SELECT pathway_id, string_agg(concat(process, ': ', coalesce(i, 'MISSING'), ' -> ', coalesce(o, 'MISSING'), ' by ', coalesce(m, 'MISSING'), ' in ', state), chr(10) ORDER BY pos) AS summary FROM {processes} x LEFT JOIN s USING (pathway_id, process) GROUP BY 1""")
def _text(t):
    actors = t.participants.where("pos = 1").select("pathway_id", "process", "pos", C("modifier").alias("entity"), F.lit("modifier").alias("role"))
    return G.reaction_texts(t.processes, t.participants.select("pathway_id", "process", "pos", "entity", "role").unionByName(actors))


