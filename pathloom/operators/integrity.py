"""References between processes and registries, places of entities, actors found in texts, and the gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.operators.linking import containing
from pathloom.operators.tables import first_per, numbered
from pathloom.plans.durable import durable

AUTO_STATE, AUTO_PLACE = "__auto_state__", "cell"


def unknown_references(used: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of ``used(pathway_id, entity, …)`` whose name no row of ``registry(pathway_id, name)`` has."""
    return _unknown(used, registry).drop("_n")


def _unknown(used: DataFrame, registry: DataFrame) -> DataFrame:
    """As :func:`unknown_references`, with the normal form ``_n``."""
    known = _by_norm(registry.select("pathway_id", "name"), "name").select("pathway_id", "_n").where("_n <> ''")
    return _by_norm(used, "entity").where("_n <> ''").join(known, ["pathway_id", "_n"], "left_anti")


def resolve_kinds(used: DataFrame, registry: DataFrame) -> DataFrame:
    """``used`` with the kind of its name: complex, else protein, else compound, else any other registered."""
    rank = F.when(F.col("kind") == "protein_complex", 0).when(F.col("kind") == "protein", 1).when(F.col("kind") == "compound", 2).otherwise(3)
    known = first_per(registry.select("pathway_id", N.norm(F.col("name")).alias("_n"), "kind", rank.alias("_rank")), ["pathway_id", "_n"], "_rank", "kind").drop("_rank")
    return used.withColumn("_n", N.norm(F.col("entity"))).join(known, ["pathway_id", "_n"], "left").drop("_n")


def missing_entities(used: DataFrame, registry: DataFrame, order: tuple[str, ...] = ("process", "pos")) -> DataFrame:
    """Registry rows to be added for names without one: the first spelling of each."""
    lost = _unknown(used, registry)
    return first_per(lost.select("pathway_id", "_n", *order, "entity"), ["pathway_id", "_n"], *order, "entity").select("pathway_id", F.col("entity").alias("name"))


def promote_to_proteins(registry: DataFrame, names: DataFrame) -> DataFrame:
    """``registry`` where compounds named in ``names`` are proteins, all else about them kept."""
    n = names.select("pathway_id", N.norm(F.col("name")).alias("_n")).distinct().withColumn("_p", F.lit(True))
    got = registry.withColumn("_n", N.norm(F.col("name"))).join(n, ["pathway_id", "_n"], "left")
    return got.withColumn("kind", F.when((F.col("kind") == "compound") & F.col("_p"), "protein").otherwise(F.col("kind"))).select(*registry.columns)


def primary_places(locations: DataFrame, states: DataFrame, entities: DataFrame | None = None, default: str = AUTO_PLACE) -> DataFrame:
    """Per entity the place of its first located state; entities without one get the default."""
    placed = locations.join(states.select("pathway_id", F.col("name").alias("state"), "place"), ["pathway_id", "state"])
    got = first_per(placed.select("pathway_id", "entity", "pos", "place"), ["pathway_id", "entity"], "pos", "place").drop("pos")
    return got if entities is None else entities.select("pathway_id", "entity").distinct().join(got, ["pathway_id", "entity"], "left").fillna(default, ["place"])


def places_of(locations: DataFrame, states: DataFrame) -> DataFrame:
    """Per entity all places of its states, each once, by name."""
    placed = locations.join(states.select("pathway_id", F.col("name").alias("state"), "place"), ["pathway_id", "state"], "left")
    return placed.groupBy("pathway_id", "entity").agg(F.array_sort(F.collect_set("place")).alias("places"))


def backfill_states(participants: DataFrame, locations: DataFrame, states: DataFrame) -> DataFrame:
    """``pathway_id, process, state``: where all located participants share one place, that place's first state.
    An entity is where its last location says."""
    last = locations.groupBy("pathway_id", "entity").agg(F.max_by("state", "pos").alias("state"))
    at = last.join(states.select("pathway_id", F.col("name").alias("state"), "place"), ["pathway_id", "state"]).select("pathway_id", "entity", "place")
    shared = participants.join(at, ["pathway_id", "entity"]).groupBy("pathway_id", "process").agg(F.min("place").alias("place"), F.max("place").alias("other")).where("place = other")
    first = states.groupBy("pathway_id", "place").agg(F.min_by("name", "pos").alias("state"))
    return shared.join(first, ["pathway_id", "place"]).select("pathway_id", "process", "state")


def auto_states(processes: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blank states of processes become the automatic one, which is added where it is needed; and how many per pathway."""
    blank = F.coalesce(F.trim("state"), F.lit("")) == ""
    need = processes.where(blank).groupBy("pathway_id").agg(F.count("*").alias("filled"))
    new = need.select("pathway_id", F.lit(AUTO_STATE).alias("name"), F.lit(AUTO_PLACE).alias("place")).join(states.where(F.col("name") == AUTO_STATE), ["pathway_id"], "left_anti")
    return processes.withColumn("state", F.when(blank, AUTO_STATE).otherwise(F.col("state"))), states.select("pathway_id", "name", "place").unionByName(new), need


def mentioned(processes: DataFrame, actors: DataFrame, text: Column, pattern: Column | None = None) -> DataFrame:
    """Actors (``pathway_id, actor, rank, pos``) whose name a process's text mentions; within a pathway only. Names are
    looked up by their rarest grams, so a large pathway's processes and actors aren't all compared."""
    named = actors.where("trim(actor) <> ''")
    told = processes.withColumn("_text", F.lower(text))
    found = containing(named.select("pathway_id", F.col("actor").alias("term")), told.select("pathway_id", F.col("process").alias("id"), F.col("_text").alias("text")), ("pathway_id",), 1)
    pairs = found.withColumnsRenamed({"id": "process", "term": "_term"}).join(named.withColumn("_term", F.lower("actor")), ["pathway_id", "_term"])
    both = told.join(pairs, ["pathway_id", "process"])
    return (both if pattern is None else both.where(F.regexp_like("_text", pattern))).drop("_text", "_term")


def inject_actors(processes: DataFrame, actors: DataFrame, existing: DataFrame, text: Column, confidence: float = 0.9) -> DataFrame:
    """Actors to be added because a process names them: complexes (rank 0) and proteins (1) that it doesn't have yet."""
    found = mentioned(processes.drop("pos", "rank"), actors, text).select("pathway_id", "process", "actor", "rank", "pos")
    have = existing.select("pathway_id", "process", N.norm(F.col("actor")).alias("_n"))
    new = found.withColumn("_n", N.norm(F.col("actor"))).join(have, ["pathway_id", "process", "_n"], "left_anti")
    return first_per(new, ["pathway_id", "process", "_n"], "rank", "pos").select("pathway_id", "process", "actor", "rank", F.lit(confidence).alias("confidence"))


def single_enzyme(processes: DataFrame, proteins: DataFrame, existing: DataFrame, text: Column) -> DataFrame:
    """The enzyme of a process that has none and whose text names exactly one protein."""
    free = processes.join(existing.select("pathway_id", "process"), ["pathway_id", "process"], "left_anti")
    found = mentioned(free, proteins, text).select("pathway_id", "process", "actor").distinct()
    return found.groupBy("pathway_id", "process").agg(F.count("*").alias("n"), F.min("actor").alias("actor")).where("n = 1").drop("n")


def attach_transporters(transports: DataFrame, proteins: DataFrame, existing: DataFrame, placed: DataFrame) -> DataFrame:
    """A transporter for each transport without one: named after ``using``, ``via``, ``through`` or ``transported by``,
    the longest name first; else a protein placed (``pathway_id, actor, state, evidence``) in its from or to state
    with evidence that names the cargo."""
    free = transports.join(existing.select("pathway_id", "process"), ["pathway_id", "process"], "left_anti")
    cue = F.concat(F.lit(r"(?i)\b(using|via|through|transported\s+by)\s+(the\s+)?\Q"), "actor", F.lit(r"\E"))
    by_cue = mentioned(free, proteins.withColumn("rank", F.lit(0)), F.col("evidence"), cue).select("pathway_id", "process", "actor", F.lit(0).alias("how"), F.length("actor").alias("len"))
    moved = free.where(F.coalesce(F.trim("cargo"), F.lit("")) != "").select("pathway_id", "process", "cargo", F.explode(F.array_distinct(F.array("from_state", "to_state"))).alias("state"))
    near = moved.join(placed.withColumnRenamed("evidence", "place_evidence"), ["pathway_id", "state"]).where(F.contains(F.lower("place_evidence"), F.lower("cargo"))).select("pathway_id", "process", "actor", F.lit(1).alias("how"), F.length("actor").alias("len"))
    return first_per(by_cue.unionByName(near).withColumn("less", -F.col("len")), ["pathway_id", "process"], "how", "less", "actor").select("pathway_id", "process", "actor", "how")


def promote_interactions(interactions: DataFrame, processes: DataFrame, proteins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interactions (``pathway_id, pos, entity_1, relationship, entity_2``) of a protein with a process become modifiers:
    the process of that name, else one whose name contains or is contained; the first. The others stay."""
    protein = _by_norm(proteins.select("pathway_id", "actor"), "actor").select("pathway_id", F.col("_n").alias("_a")).distinct()
    own = _by_norm(interactions, "entity_1").withColumnRenamed("_n", "_a").join(protein, ["pathway_id", "_a"], "left_semi")
    # read several times each, so they are made once
    own = durable(_by_norm(own.select("pathway_id", "pos", "entity_2"), "entity_2").select("pathway_id", "pos", F.col("_n").alias("_b")).where("_b <> ''"))
    steps = durable(_by_norm(processes.select("pathway_id", "process", "name"), "name").select("pathway_id", "process", F.col("_n").alias("_p")).where("_p <> ''"))
    exact = durable(own.join(steps, (own["pathway_id"] == steps["pathway_id"]) & (own["_b"] == steps["_p"])).select(own["pathway_id"], "pos", "process", F.lit(0).alias("how")))
    # the rest: names within names, either way
    aims = durable(own.join(exact.select("pathway_id", "pos"), ["pathway_id", "pos"], "left_anti"))
    inner = containing(aims.select("pathway_id", F.col("_b").alias("term")), steps.select("pathway_id", F.col("process").alias("id"), F.col("_p").alias("text")), ("pathway_id",), 1)
    outer = containing(steps.select("pathway_id", F.col("_p").alias("term")), aims.select("pathway_id", F.col("pos").alias("id"), F.col("_b").alias("text")), ("pathway_id",), 1)
    one = inner.join(aims.withColumnRenamed("_b", "term"), ["pathway_id", "term"]).select("pathway_id", "pos", F.col("id").alias("process"))
    two = outer.join(steps.withColumnRenamed("_p", "term"), ["pathway_id", "term"]).select("pathway_id", F.col("id").alias("pos"), "process")
    part = one.unionByName(two).distinct().withColumn("how", F.lit(1))
    chosen = durable(first_per(exact.unionByName(part), ["pathway_id", "pos"], "process")).join(interactions.select("pathway_id", "pos", "entity_1", "relationship"), ["pathway_id", "pos"])
    made = chosen.select("pathway_id", "process", "pos", F.col("entity_1").alias("actor"), N.modifier_role(F.col("relationship")).alias("role"))
    return made, interactions.join(chosen.select("pathway_id", "pos"), ["pathway_id", "pos"], "left_anti")


def promote_catalysts(participants: DataFrame, proteins: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """``participants`` where protein inputs are modifiers, unless they are scaffolds or part of a complex that comes out;
    scaffolds that only come out as part of a complex are added as inputs."""
    p = participants.withColumn("_n", N.norm(F.col("entity")))
    protein = _by_norm(proteins.select("pathway_id", "name"), "name").select("pathway_id", "_n").distinct().withColumn("_protein", F.lit(True))
    scaffold = scaffolds.select("pathway_id", F.col("norm").alias("_n")).distinct().withColumn("_scaffold", F.lit(True))
    parts = p.where((F.col("role") == "product") & F.contains("entity", F.lit(":"))).select("pathway_id", "process", F.explode(N.complex_parts(F.col("entity"))).alias("part")).withColumn("_n", N.norm(F.col("part")))
    bound = parts.select("pathway_id", "process", "_n").distinct().withColumn("_bound", F.lit(True))
    flagged = p.join(protein, ["pathway_id", "_n"], "left").join(scaffold, ["pathway_id", "_n"], "left").join(bound, ["pathway_id", "process", "_n"], "left")
    moves = (F.col("role") == "reactant") & F.coalesce("_protein", F.lit(False)) & ~F.coalesce("_scaffold", F.lit(False)) & ~F.coalesce("_bound", F.lit(False))
    out = flagged.withColumn("role", F.when(moves, "modifier").otherwise(F.col("role"))).select("pathway_id", "process", "role", "pos", "entity")
    there = out.where("role = 'reactant'").select("pathway_id", "process", N.norm(F.col("entity")).alias("_n"))
    lost = parts.join(scaffold, ["pathway_id", "_n"], "left_semi").join(there, ["pathway_id", "process", "_n"], "left_anti")
    return out.unionByName(first_per(lost, ["pathway_id", "process", "_n"], "part").select("pathway_id", "process", F.lit("reactant").alias("role"), F.lit(0).cast(out.schema["pos"].dataType).alias("pos"), F.col("part").alias("entity")))


def normalise_actors(actors: DataFrame, registry: DataFrame) -> DataFrame:
    """Actors by the registry's spelling and kind, looked up as they are, without `` complex``, and as a complex's standard
    name; unknown ones drop out. ``registry(pathway_id, kind, name, pos)`` of proteins and complexes."""
    forms = F.array(F.col("actor"), N.modifier_name(F.col("actor")), N.complex_name(F.col("actor")))
    tried = actors.select("*", F.posexplode(forms).alias("_try", "_form")).withColumn("_n", N.norm_with_colon(F.col("_form"))).where("_n <> ''")
    known = first_per(registry.select("pathway_id", N.norm_with_colon(F.col("name")).alias("_n"), F.when(F.col("kind") == "protein_complex", 0).otherwise(1).alias("_rank"), "pos", F.col("name").alias("entity"), F.col("kind").alias("entity_type")), ["pathway_id", "_n"], "_rank", "pos").drop("_rank", "pos")
    got = tried.join(known, ["pathway_id", "_n"])
    keys = [c for c in actors.columns if c != "role"]
    return first_per(got, keys, "_try").select(*actors.columns, "entity", "entity_type")


def both_kinds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names registered in both tables."""
    n = lambda df: df.select("pathway_id", N.norm(F.col("name")).alias("norm")).where("norm <> ''")
    return n(a).intersect(n(b))


def issue(df: DataFrame, rule: str, subject: str | Column, severity: str = "error") -> DataFrame:
    return df.select("pathway_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"))


def composite_issues(used: DataFrame) -> DataFrame:
    """Names in processes that still are composites."""
    return issue(used.where(N.has_plus(F.col("entity"))), "composite_token", "entity")


def scaffold_modifier_issues(actors: DataFrame, scaffolds: DataFrame) -> DataFrame:
    s = scaffolds.select("pathway_id", F.col("norm").alias("_n"))
    return issue(actors.withColumn("_n", N.norm(F.col("actor"))).join(s, ["pathway_id", "_n"], "left_semi"), "scaffold_as_modifier", "actor")


def _by_norm(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the normal form of a name as ``_n``. Through an array, else a condition on it works it out again."""
    return df.withColumn("_n", F.explode(F.array(N.norm(F.col(name)))))


def strict_gates(used: DataFrame, actors: DataFrame, registry: DataFrame, scaffolds: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Issues of all gates: composites, unknown participants and actors, scaffolds as modifiers, proteins that nothing links.
    ``links(pathway_id, a)`` are the ends of edges, or an adjacency.

    A pathway that has one is to be set aside; none is raised. What is known of a name is gathered once, whatever asks for it."""
    of = lambda df, name, what: _by_norm(df.select("pathway_id", F.col(name).alias("subject"), F.lit(what).alias("what")), "subject")
    known = lambda df, *flags: df.select("pathway_id", "_n", *[F.lit(f in flags).alias(f) for f in ("registered", "scaffold", "linked")])
    asked = of(used, "entity", "entity").unionByName(of(actors, "actor", "actor"))
    told = known(_by_norm(registry.select("pathway_id", "name"), "name"), "registered").unionByName(known(scaffolds.withColumnRenamed("norm", "_n"), "scaffold"))
    if links is not None:
        asked = asked.unionByName(of(registry.where("kind = 'protein'"), "name", "protein"))
        told = told.unionByName(known(_by_norm(links.select("pathway_id", F.substring_index("a", ":", -1).alias("name")), "name"), "linked"))
    flags = told.groupBy("pathway_id", "_n").agg(*[F.max(f).alias(f) for f in ("registered", "scaffold", "linked")])
    got = asked.join(flags, ["pathway_id", "_n"], "left")
    is_, no = lambda what: F.col("what") == what, lambda flag: ~F.coalesce(flag, F.lit(False))
    unknown = no("registered") & (F.col("_n") != "")
    rules = F.array_compact(F.array(
        F.when(is_("entity") & unknown, "unknown_participant"), F.when(is_("actor") & unknown, "unknown_actor"),
        F.when(is_("actor") & F.col("scaffold"), "scaffold_as_modifier"), F.when(is_("protein") & no("linked"), "isolated_protein"),
    ))
    return composite_issues(used).unionByName(got.select("pathway_id", F.lit("error").alias("severity"), F.explode(rules).alias("rule"), F.col("subject").cast("string").alias("subject")))


def quarantine(pathways: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pathways without an error, and those with one and how many."""
    bad = issues.where("severity = 'error'").groupBy("pathway_id").agg(F.count("*").alias("errors"))
    return pathways.join(bad, "pathway_id", "left_anti"), pathways.join(bad, "pathway_id")


def gap_issues(entities: DataFrame, locations: DataFrame, states: DataFrame, limit: int = 200) -> DataFrame:
    """``pathway_id, pos, name, kind, gap``: entities without an external id, a location, or an organism (proteins), in order of
    the registry, the first ``limit`` of each pathway."""
    located = locations.select("pathway_id", N.norm(F.col("entity")).alias("_n")).distinct().withColumn("_at", F.lit(True))
    got = entities.withColumn("_n", N.norm(F.col("name"))).join(located, ["pathway_id", "_n"], "left")
    ids = F.coalesce(F.size(F.filter(F.map_values("mapped_ids"), lambda v: F.coalesce(F.trim(v), F.lit("")) != "")), F.lit(0))
    gaps = F.array_compact(F.array(F.when(F.coalesce(ids, F.lit(0)) <= 0, "needs_id"), F.when(F.col("_at").isNull(), "needs_location"), F.when((F.col("kind") == "protein") & (F.coalesce("organism", F.lit("")) == ""), "needs_organism")))
    rows = got.select("pathway_id", "pos", "name", "kind", F.posexplode(gaps).alias("_k", "gap"))
    blank = states.where("coalesce(place, '') = ''").select("pathway_id", F.col("pos"), "name", F.lit("state").alias("kind"), F.lit(9).alias("_k"), F.lit("needs_place").alias("gap"))
    return numbered(rows.unionByName(blank), ["pathway_id"], "pos", "kind", "name", "_k").where(F.col("rn") <= limit).drop("rn", "_k")


def alias_hints(places: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Places (``pathway_id, name``) for which a pathway names both an alias and what it stands for."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    p = places.select("pathway_id", F.lower(F.trim("name")).alias("alias")).distinct()
    meant = p.withColumn("target", F.try_element_at(table, F.col("alias"))).where("target is not null")
    return meant.join(p.select("pathway_id", F.col("alias").alias("target")), ["pathway_id", "target"]).select("pathway_id", "alias", "target")
