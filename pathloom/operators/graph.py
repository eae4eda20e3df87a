"""Graphs of pathways as edge tables, every key within a pathway."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.functions import vocab
from pathloom.operators.components import connected_components
from pathloom.operators.tables import first_per, numbered, ordered
from pathloom.plans.durable import durable, kept, tidy

SEPARATOR = "\x1f"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _edges(participants: DataFrame, actors: DataFrame | None, states: DataFrame | None, moves: DataFrame | None, interactions: DataFrame | None) -> list[DataFrame]:
    """Edges ``pathway_id, a, b`` of :func:`adjacency` by kind, one direction, with repeats. Kinds of nodes tell the kinds of edges
    apart: no edge is in two of the tables."""
    pair = lambda df, a, b: df.select("pathway_id", F.concat_ws(":", *a).alias("a"), F.concat_ws(":", *b).alias("b")).where("a <> b")
    process = [F.lit("process"), F.col("process")]
    kinds = [pair(participants, [F.lit("entity"), F.col("entity")], process)]
    if actors is not None:
        kinds.append(pair(actors, [F.lit("actor"), F.col("actor")], process))
    if states is not None:
        kinds.append(pair(states, [F.lit("state"), F.col("state")], process))
    if moves is not None:
        kinds.append(union_all([pair(moves.where(F.col(side).isNotNull()), [F.lit("at"), F.col("cargo"), F.col(side)], process) for side in ("from_state", "to_state")]))
    if interactions is not None:
        kinds.append(pair(interactions, [F.lit("entity"), F.col("entity_1")], [F.lit("entity"), F.col("entity_2")]))
    return kinds


def adjacency(participants: DataFrame, actors: DataFrame | None = None, states: DataFrame | None = None, moves: DataFrame | None = None, interactions: DataFrame | None = None) -> DataFrame:
    """``pathway_id, a, b``, both directions, distinct: entity–process, actor–process, state–process, cargo at its
    states for transports (``cargo, from_state, to_state``), and the two ends of interactions.

    Edges are made distinct by kind and in one direction, and turned round after that: a task then holds one kind's share of them."""
    one = lambda df: df.select("pathway_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return union_all([one(df) for df in _edges(participants, actors, states, moves, interactions)]).select("pathway_id", F.inline(both))


def ends(participants: DataFrame, actors: DataFrame | None = None, states: DataFrame | None = None, moves: DataFrame | None = None, interactions: DataFrame | None = None) -> DataFrame:
    """``pathway_id, a``: the nodes that :func:`adjacency` links, with repeats; edges aren't turned round nor made distinct."""
    return union_all(_edges(participants, actors, states, moves, interactions)).select("pathway_id", F.explode(F.array("a", "b")).alias("a"))


#: A pathway of more edges than this is united by rounds over the cluster, others within tasks.
MAX_EDGES_IN_TASK = 2_000_000


def components(adj: DataFrame, most: int = MAX_EDGES_IN_TASK) -> DataFrame:
    """``pathway_id, node, component``: the smallest node of each component.

    Pathways are dealt by their id and united in tasks, many at once, each task holding one batch and one pathway;
    those of more than ``most`` edges go by :func:`connected_components`."""
    edges = adj.select("pathway_id", "a", "b").where("a is not null and b is not null")
    large = durable(edges.groupBy("pathway_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("pathway_id"))
    kind = adj.schema["pathway_id"].dataType
    ddl = f"pathway_id {kind.simpleString()}, node string, component string"
    if large.isEmpty():
        return _dealt(edges).mapInPandas(lambda it: _by_pathway(it, _labels), ddl)
    small = _dealt(edges.join(large, "pathway_id", "left_anti")).mapInPandas(lambda it: _by_pathway(it, _labels), ddl)
    key = lambda c: F.concat_ws(SEPARATOR, F.col("pathway_id").cast("string"), c)
    got = connected_components(edges.join(large, "pathway_id", "left_semi").select(key("a").alias("a"), key("b").alias("b")))
    part = lambda c: F.substring_index(c, SEPARATOR, -1)
    return small.unionByName(got.select(F.substring_index("node", SEPARATOR, 1).cast(kind).alias("pathway_id"), part("node").alias("node"), part("component").alias("component")))


def _dealt(edges: DataFrame) -> DataFrame:
    n = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return edges.repartition(n, "pathway_id").sortWithinPartitions("pathway_id")


def _by_pathway(frames: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Works on whole pathways of a partition, sorted by id; the last pathway of a batch waits for the next one."""
    kept: pd.DataFrame | None = None
    for f in frames:
        f = f if kept is None else pd.concat([kept, f], ignore_index=True)
        last = f["pathway_id"] == f["pathway_id"].iloc[-1] if len(f) else []
        kept = f[last] if len(f) else None
        if len(f) and not last.all():
            yield work(f[~last])
    if kept is not None and len(kept):
        yield work(kept)


def _labels(f: pd.DataFrame) -> pd.DataFrame:
    ends = pd.DataFrame({"pathway_id": pd.concat([f["pathway_id"]] * 2, ignore_index=True), "node": pd.concat([f["a"], f["b"]], ignore_index=True)})
    code = ends.groupby(["pathway_id", "node"], sort=True).ngroup().to_numpy()
    a, b = code[: len(f)], code[len(f) :]
    label = np.arange(code.max() + 1)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, x, y)
        np.minimum.at(label, y, x)
        while (label[label] != label).any():
            label = label[label]
    first = np.zeros(len(label), dtype=np.int64)
    first[code] = np.arange(len(code))
    names = ends["node"].to_numpy()[first]
    return pd.DataFrame({"pathway_id": ends["pathway_id"].to_numpy()[first], "node": names, "component": names[label]})


def degrees(adj: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``pathway_id, node, degree``; nodes without an edge, if nodes are given, have none."""
    got = adj.groupBy("pathway_id", F.col("a").alias("node")).agg(F.count_distinct("b").alias("degree"))
    return got if nodes is None else nodes.select("pathway_id", "node").distinct().join(got, ["pathway_id", "node"], "left").fillna(0, ["degree"])


def component_report(members: DataFrame) -> DataFrame:
    """Per pathway: components, nodes, the main one's size (ties to the least), nodes outside it."""
    sizes = members.groupBy("pathway_id", "component").agg(F.count("*").alias("size"))
    got = sizes.groupBy("pathway_id").agg(F.count("*").alias("components"), F.sum("size").alias("nodes"), F.max("size").alias("main_size"))
    return got.withColumn("orphans", F.col("nodes") - F.col("main_size"))


def dangling(degree: DataFrame, most: int = 200, limit: int = 1) -> DataFrame:
    """Per pathway, the nodes of least degree (``limit`` at most), by degree and name, the first ``most``."""
    return numbered(degree.where(F.col("degree") <= limit), ["pathway_id"], "degree", "node").where(F.col("rn") <= most)


def summary(adj: DataFrame, members: DataFrame, proteins: DataFrame) -> DataFrame:
    """Per pathway: nodes, edges, share of the largest component, proteins (``pathway_id, node``) and those attached."""
    report = component_report(members)
    edges = adj.where("a < b").groupBy("pathway_id").agg(F.count("*").alias("edges"))
    linked = adj.select("pathway_id", F.col("a").alias("node")).distinct().withColumn("linked", F.lit(1))
    actors = proteins.select("pathway_id", "node").distinct().join(linked, ["pathway_id", "node"], "left").groupBy("pathway_id").agg(F.count("*").alias("proteins"), F.count("linked").alias("attached"))
    got = report.join(edges, "pathway_id", "left").join(actors, "pathway_id", "full").fillna(0, ["nodes", "edges", "components", "main_size", "proteins", "attached"])
    share = lambda a, b: F.when(F.col(b) > 0, F.round(100 * F.col(a) / F.col(b), 2)).otherwise(0.0)
    return got.select("pathway_id", "nodes", "edges", "components", share("main_size", "nodes").alias("largest_percent"), (F.col("proteins") - F.col("attached")).alias("loose_proteins"), share("attached", "proteins").alias("attached_percent"))


def draft_graph(entities: DataFrame, processes: DataFrame, participants: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed nodes (first of each id, with its first place) and directed role edges.

    ``entities(pathway_id, kind, pos, name)``, ``processes(pathway_id, kind, pos, name)``,
    ``participants(pathway_id, process_pos, role, entity)``, ``locations(pathway_id, pos, entity, state)``.
    Repeated process names get the suffixes ``_2``, ``_3`` ….
    """
    place = first_per(locations.select("pathway_id", N.graph_id(F.col("entity")).alias("id"), "pos", "state"), ["pathway_id", "id"], "pos").select("pathway_id", "id", F.col("state").alias("compartment"))
    own = first_per(entities.select("pathway_id", N.graph_id(F.col("name")).alias("id"), "pos", F.col("name").alias("label"), "kind").where("id <> ''"), ["pathway_id", "id"], "pos")
    things = own.join(place, ["pathway_id", "id"], "left").select("pathway_id", "id", "label", "kind", "compartment")
    done = numbered(processes.withColumn("base", N.graph_id(F.col("name"))), ["pathway_id", "base"], "pos")
    steps = done.select("pathway_id", F.concat("base", F.when(F.col("rn") > 1, F.concat(F.lit("_"), F.col("rn").cast("string"))).otherwise("")).alias("id"), F.col("name").alias("label"), "kind", F.lit(None).cast("string").alias("compartment"), F.col("pos").alias("process_pos"))
    ends = participants.select("pathway_id", "process_pos", "role", N.graph_id(F.col("entity")).alias("entity")).join(steps.select("pathway_id", "process_pos", "id"), ["pathway_id", "process_pos"])
    edges = ends.select("pathway_id", F.when(F.col("role") == "product", F.col("id")).otherwise(F.col("entity")).alias("source"), F.when(F.col("role") == "product", F.col("entity")).otherwise(F.col("id")).alias("target"), "role").distinct()
    return things.unionByName(steps.drop("process_pos")), edges


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("pathway_id", F.explode(F.array("source", "target")).alias("id")).distinct()  # edges are made once
    return nodes.join(ends, ["pathway_id", "id"], "left_anti")


ENTITY_KINDS = ("compound", "protein", "protein_complex", "nucleic_acid", "element_collection")


def qa_flags(nodes: DataFrame, edges: DataFrame, unmapped: DataFrame | None = None, empty: DataFrame | None = None) -> DataFrame:
    """``pathway_id, flag, subject, reason`` of a draft graph; ``unmapped(pathway_id, name, kind)`` are registry rows
    without an external id, ``empty(pathway_id, name)`` reactions that lack a side."""
    nodes, edges = kept(nodes), kept(edges)
    flag = lambda df, name, subject, reason: df.select("pathway_id", F.lit(name).alias("flag"), F.col(subject).alias("subject"), reason.alias("reason"))
    label = nodes.select("pathway_id", F.col("id").alias("entity"), "label", "kind")
    # what each node's edges say, in one pass: whether it has any; for processes, whether one acts, takes a cofactor, gives what it takes
    named = durable(edges.join(label.select("pathway_id", F.col("entity").alias("source"), F.col("label").alias("s_label"), F.col("kind").alias("s_kind")), ["pathway_id", "source"], "left"))
    tidy(edges.sparkSession)  # shuffle files go between the jobs, else the disk holds those of all
    acts, takes = F.col("role").isin("catalyst", "modifier"), F.col("role") == "reactant"
    said = named.select("pathway_id", F.inline(F.array(
        F.struct(F.col("source").alias("id"), F.when(F.col("role") == "product", F.col("target")).alias("gives"), F.lit(None).cast("string").alias("takes"), F.lit(False).alias("act"), F.lit(False).alias("cof")),
        F.struct(F.col("target").alias("id"), F.lit(None).cast("string").alias("gives"), F.when(takes, F.col("source")).alias("takes"), acts.alias("act"), (takes & F.coalesce(F.lower("s_label").isin(*vocab.COFACTORS), F.lit(False))).alias("cof")),
    )))
    facts = said.groupBy("pathway_id", "id").agg(F.max("act").alias("act"), F.max("cof").alias("cof"), F.arrays_overlap(F.collect_set("gives"), F.collect_set("takes")).alias("both"), F.lit(True).alias("linked"))
    node = nodes.join(facts, ["pathway_id", "id"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("act", "cof", "both", "linked")})
    thing, step = F.col("kind").isin(*ENTITY_KINDS), F.col("kind") == "reaction"
    says, moves = F.col("label").rlike(vocab.MODIFIER_TRIGGERS), F.col("label").rlike(vocab.TRANSPORT_NAMES)
    found = lambda cond, name, reason: F.when(cond, F.struct(F.lit(name).alias("flag"), F.col("label").alias("subject"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason")))
    flags = F.array_compact(F.array(
        found(thing & (F.coalesce("compartment", F.lit("")) == ""), "missing_compartments", "no subcellular location recorded"),
        found(step & ~F.col("act") & (says | F.col("cof")), "missing_modifiers", F.concat_ws("; ", F.when(says, "reaction name implies enzymatic catalysis"), F.when(F.col("cof"), "reactant list includes known cofactors"))),
        found(thing & F.col("label").rlike(vocab.COMPLEX_NAMES), "possible_complexes", "name suggests a complex or subunit"),
        found(step & (moves | F.col("both")), "transport_like_reactions", F.concat_ws("; ", F.when(F.col("both"), "same species appear as both input and output"), F.when(moves, "reaction name implies transport"))),
        found(~F.col("linked"), "orphan_nodes", "degree 0"),
    ))
    parts = [node.select("pathway_id", F.inline(flags))]
    odd = (F.col("role").isin("catalyst", "modifier") & (F.col("s_kind") == "compound")) | ((F.col("role") == "reactant") & (F.col("s_kind") == "protein")) | (F.col("role") == "product")
    kinds = named.where(odd).join(label.select("pathway_id", F.col("entity").alias("target"), F.col("label").alias("t_label"), F.col("kind").alias("t_kind")), ["pathway_id", "target"], "left")
    wrong = F.when(F.col("role").isin("catalyst", "modifier") & (F.col("s_kind") == "compound"), F.struct(F.col("s_label").alias("subject"), F.concat(F.lit("compound used as "), "role").alias("reason"))).when((F.col("role") == "reactant") & (F.col("s_kind") == "protein"), F.struct(F.col("s_label").alias("subject"), F.concat(F.lit("protein listed as reactant in "), "t_label").alias("reason"))).when((F.col("role") == "product") & (F.col("t_kind") == "protein"), F.struct(F.col("t_label").alias("subject"), F.concat(F.lit("protein listed as product in "), "s_label").alias("reason")))
    bad = durable(kinds.select("pathway_id", wrong.alias("w")).where("w is not null").select("pathway_id", "w.subject", "w.reason").distinct())
    tidy(edges.sparkSession)
    parts.append(bad.select("pathway_id", F.lit("inconsistent_class").alias("flag"), "subject", "reason"))
    if unmapped is not None:
        parts.append(flag(unmapped, "missing_ids", "name", F.col("kind")))
    if empty is not None:
        parts.append(flag(empty, "empty_reactions", "name", F.lit("a side is empty")))
    return union_all(parts)


WEIGHTED = ("missing_compartments", "missing_modifiers", "orphan_nodes", "missing_ids", "empty_reactions", "inconsistent_class")


def completeness(nodes: DataFrame, flags: DataFrame) -> DataFrame:
    """Per pathway: species, reactions, and 1 less the flags per node, three places, 0 at least."""
    size = nodes.groupBy("pathway_id").agg(F.count_if(F.col("kind").isin(*ENTITY_KINDS)).alias("species"), F.count_if(F.col("kind") == "reaction").alias("reactions"))
    bad = flags.where(F.col("flag").isin(*WEIGHTED)).groupBy("pathway_id").agg(F.count("*").alias("issues"))
    got = size.join(bad, "pathway_id", "left").fillna(0, ["issues"])
    return got.select("pathway_id", "species", "reactions", "issues", F.round(F.greatest(F.lit(0.0), 1 - F.col("issues") / F.greatest(F.lit(1), F.col("species") + F.col("reactions"))), 3).alias("score"))


def duplicate_species(nodes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``pathway_id, a, b, reason`` once per unordered pair of labels: those alike in letters and digits, then those
    that share an external id (``ids(pathway_id, name, db, ext)``).

    Equal labels are one, so a pair stands between different spellings; the pairs are as many as the answer."""
    label = nodes.select("pathway_id", N.squeezed(F.col("label")).alias("k"), "label").where("k <> ''").distinct()
    pair = lambda df: df.alias("x").join(df.alias("y"), ["pathway_id", "k"]).where("x.label < y.label").select("pathway_id", F.col("x.label").alias("a"), F.col("y.label").alias("b"), "k")
    got = pair(label).select("pathway_id", "a", "b", F.lit(0).alias("rank"), F.lit("normalized label collision").alias("reason"))
    if ids is not None:
        shared = ids.select("pathway_id", F.concat_ws(":", "db", F.trim("ext")).alias("k"), F.col("name").alias("label")).where("trim(ext) <> ''").distinct()
        got = got.union(pair(shared).select("pathway_id", "a", "b", F.lit(1).alias("rank"), F.concat(F.lit("shared external ID: "), "k").alias("reason")))
    return first_per(got, ["pathway_id", "a", "b"], "rank", "reason").drop("rank")


def producer_consumer(participants: DataFrame, cofactors: DataFrame | None = None) -> DataFrame:
    """``pathway_id, producer, consumer``: processes linked by a metabolite that one makes and another takes;
    ``cofactors(entity)`` link nothing."""
    p = participants if cofactors is None else participants.join(cofactors, "entity", "left_anti")
    made = p.where("role = 'product'").select("pathway_id", "entity", F.col("process").alias("producer")).distinct()
    took = p.where("role = 'reactant'").select("pathway_id", "entity", F.col("process").alias("consumer")).distinct()
    return made.join(took, ["pathway_id", "entity"]).where("producer <> consumer").select("pathway_id", "producer", "consumer").distinct()


def topological_ranks(nodes: DataFrame, edges: DataFrame, most: int = MAX_EDGES_IN_TASK) -> DataFrame:
    """``pathway_id, node, rank, in_cycle``: a node's rank is one more than that of the last of its sources. What is
    in or behind a cycle gets the rank after the last, and the flag. ``edges(pathway_id, source, target)``; those with an
    end that is no node are left out.

    Pathways are ranked in tasks, many at once; those of more than ``most`` edges by rounds over the cluster."""
    nodes = durable(nodes.select("pathway_id", "node").distinct())
    end = lambda c: nodes.select("pathway_id", F.col("node").alias(c))
    known = edges.where("source <> target").select("pathway_id", "source", "target").distinct()
    known = durable(known.join(end("source"), ["pathway_id", "source"], "left_semi").join(end("target"), ["pathway_id", "target"], "left_semi"))
    large = durable(known.groupBy("pathway_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("pathway_id"))
    kinds = [nodes.schema[c].dataType.simpleString() for c in ("pathway_id", "node")]
    rows = nodes.select("pathway_id", "node", F.col("node").alias("target"), F.lit(False).alias("edge")).unionByName(known.select("pathway_id", F.col("source").alias("node"), "target", F.lit(True).alias("edge")))
    ddl = f"pathway_id {kinds[0]}, node {kinds[1]}, rank int, in_cycle boolean"
    if large.isEmpty():
        return _dealt(rows).mapInPandas(lambda it: _by_pathway(it, _ranks), ddl)
    small = _dealt(rows.join(large, "pathway_id", "left_anti")).mapInPandas(lambda it: _by_pathway(it, _ranks), ddl)
    return small.unionByName(_peeled(nodes.join(large, "pathway_id", "left_semi"), known.join(large, "pathway_id", "left_semi")))


def _ranks(f: pd.DataFrame) -> pd.DataFrame:
    """Ranks of some whole pathways: level by level, each edge looked at once."""
    ends = pd.DataFrame({"pathway_id": pd.concat([f["pathway_id"]] * 2, ignore_index=True), "node": pd.concat([f["node"], f["target"]], ignore_index=True)})
    code = ends.groupby(["pathway_id", "node"], sort=True).ngroup().to_numpy()
    edge = f["edge"].to_numpy()
    s, t = code[: len(f)][edge], code[len(f) :][edge]
    n = int(code.max()) + 1
    order = np.argsort(s, kind="stable")
    t = t[order]
    first = np.searchsorted(s[order], np.arange(n + 1))
    waits = np.bincount(t, minlength=n)
    rank = np.full(n, -1, dtype=np.int32)
    now, level = np.flatnonzero(waits == 0), 0
    while len(now):
        rank[now] = level
        sizes = first[now + 1] - first[now]
        at = np.repeat(first[now] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        hit, times = np.unique(t[at], return_counts=True)
        waits[hit] -= times
        now, level = hit[waits[hit] == 0], level + 1
    place = np.zeros(n, dtype=np.int64)
    place[code] = np.arange(len(code))
    pathway = ends["pathway_id"].to_numpy()[place]
    out = pd.DataFrame({"pathway_id": pathway, "node": ends["node"].to_numpy()[place], "rank": rank, "in_cycle": rank < 0})
    last = out.groupby("pathway_id")["rank"].transform("max").to_numpy()
    out["rank"] = np.where(rank < 0, last + 1, rank).astype(np.int32)
    return out


def _peeled(open_: DataFrame, left: DataFrame) -> DataFrame:
    """The same by rounds: each takes the nodes without open sources and is written to the shared folder, until none is found."""
    done: list[DataFrame] = []
    while True:
        waiting = left.select("pathway_id", F.col("target").alias("node")).distinct()
        ready = durable(open_.join(waiting, ["pathway_id", "node"], "left_anti").withColumn("rank", F.lit(len(done))))
        if ready.isEmpty():
            break
        done.append(ready)
        open_ = durable(open_.join(ready, ["pathway_id", "node"], "left_anti"))
        left = durable(left.join(ready.select("pathway_id", F.col("node").alias("source")), ["pathway_id", "source"], "left_anti"))
    if not done:
        return open_.select("pathway_id", "node", F.lit(0).alias("rank"), F.lit(True).alias("in_cycle"))
    ranked = union_all([d.withColumn("in_cycle", F.lit(False)) for d in done])
    last = ranked.groupBy("pathway_id").agg(F.max("rank").alias("m"))
    rest = open_.join(last, "pathway_id", "left").select("pathway_id", "node", (F.coalesce("m", F.lit(-1)) + 1).alias("rank"), F.lit(True).alias("in_cycle"))
    return ranked.unionByName(rest)


def lanes(ranks: DataFrame) -> DataFrame:
    """Place within its rank, by name."""
    return numbered(ranks, ["pathway_id", "rank"], "node", name="lane").withColumn("lane", F.col("lane") - 1)


def prune_loose(entities: DataFrame, adj: DataFrame, kind: str = "protein") -> DataFrame:
    """Entities (``pathway_id, kind, node``) without those of a kind that nothing links."""
    linked = adj.select("pathway_id", F.col("a").alias("node")).distinct().withColumn("linked", F.lit(1))
    return entities.join(linked, ["pathway_id", "node"], "left").where((F.col("kind") != kind) | F.col("linked").isNotNull()).drop("linked")


def equivalence(edges: DataFrame, uses: DataFrame) -> DataFrame:
    """``pathway_id, name, chosen``: names that SAME_AS edges (``pathway_id, a, b``) join, and the one that stands for
    them: the least rank, then the most used, then by name. ``uses(pathway_id, name, rank, times)``."""
    members = components(edges).select("pathway_id", F.col("node").alias("name"), "component")
    scored = members.join(uses, ["pathway_id", "name"], "left").fillna({"rank": 9, "times": 0})
    best = first_per(scored.select("pathway_id", "component", "rank", (-F.col("times")).alias("less"), "name"), ["pathway_id", "component"], "rank", "less", "name")
    return members.join(best.select("pathway_id", "component", F.col("name").alias("chosen")), ["pathway_id", "component"]).select("pathway_id", "name", "chosen")


def rewrite(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``df`` with the names of a column replaced as ``mapping(pathway_id, name, chosen)`` says."""
    m = mapping.select("pathway_id", F.col("name").alias(column), "chosen")
    return df.join(m, ["pathway_id", column], "left").withColumn(column, F.coalesce("chosen", column)).select(*df.columns)


def normalise_draft(nodes: DataFrame, edges: DataFrame, same_as: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges entity nodes that share a label or that SAME_AS edges (``pathway_id, a, b``) join, under the least id
    and the longest label; moves edges along; lists conflicts (``pathway_id, node, issue``): an entity that is both
    modifier and reactant of a process, and processes without a side."""
    nodes, edges = durable(nodes), durable(edges)
    thing = nodes.where(F.col("kind").isin(*ENTITY_KINDS))
    alike = thing.groupBy("pathway_id", N.graph_id(F.col("label")).alias("k")).agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    by_label = thing.withColumn("k", N.graph_id(F.col("label"))).join(alike, ["pathway_id", "k"]).select("pathway_id", F.col("id").alias("a"), "b")
    chosen = components(by_label.unionByName(same_as.select("pathway_id", "a", "b")).where("a <> b"))
    move = chosen.select("pathway_id", F.col("node").alias("name"), F.col("component").alias("chosen"))
    moved = rewrite(nodes, "id", move)
    merged = moved.groupBy("pathway_id", "id").agg(F.max_by("label", F.struct(F.length("label"), "label")).alias("label"), F.min("kind").alias("kind"), F.max("compartment").alias("compartment"))
    links = rewrite(rewrite(edges, "source", move), "target", move).distinct()
    roles = links.withColumn("process", F.when(F.col("role") == "product", F.col("source")).otherwise(F.col("target"))).withColumn("node", F.when(F.col("role") == "product", F.col("target")).otherwise(F.col("source")))
    conflict = roles.groupBy("pathway_id", "process", "node").agg(F.max(F.col("role").isin("catalyst", "modifier")).alias("m"), F.max(F.col("role") == "reactant").alias("r")).where("m and r").select("pathway_id", "node", F.lit("modifier and reactant").alias("issue"))
    sides = roles.groupBy("pathway_id", "process").agg(F.max(F.col("role") == "reactant").alias("i"), F.max(F.col("role") == "product").alias("o"))
    empty = merged.where(~F.col("kind").isin(*ENTITY_KINDS)).join(sides, (merged["pathway_id"] == sides["pathway_id"]) & (merged["id"] == sides["process"]), "left").where("not coalesce(i, false) or not coalesce(o, false)").select(merged["pathway_id"], F.col("id").alias("node"), F.lit("empty process").alias("issue"))
    return merged, links, conflict.unionByName(empty).distinct()


def reaction_texts(processes: DataFrame, participants: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """One text per pathway: a line per process with its sides, actors, state (``MISSING`` where there is none) and flags."""
    side = lambda r: ordered(F.when(F.col("role") == r, F.col("entity")), "pos")
    sides = participants.groupBy("pathway_id", "process").agg(*[F.array_compact(side(r)).alias(r) for r in ("reactant", "product", "modifier")])
    got = processes.join(sides, ["pathway_id", "process"], "left")
    if flags is not None:
        got = got.join(flags.groupBy("pathway_id", "process").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("marks")), ["pathway_id", "process"], "left")
    else:
        got = got.withColumn("marks", F.lit(None).cast("string"))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, " + ")).otherwise("MISSING")
    line = F.concat(F.col("process").cast("string"), F.lit(": "), text("reactant"), F.lit(" -> "), text("product"), F.lit(" by "), text("modifier"), F.lit(" in "), F.coalesce("state", F.lit("MISSING")), F.coalesce(F.concat(F.lit(" ["), "marks", F.lit("]")), F.lit("")))
    return got.withColumn("line", line).groupBy("pathway_id").agg(F.array_join(ordered("line", "pos"), "\n").alias("summary"))
