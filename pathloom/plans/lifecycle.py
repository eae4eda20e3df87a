"""The default course of a corpus: rewrite, place, attach, merge, check. Each step is from tables to tables, long
lineages are cut in the shared folder; pathways that fail a gate are set aside with their issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.functions import vocab
from pathloom.operators import cleaning, graph, integrity, merge, rewrite
from pathloom.operators.tables import first_per, numbered
from pathloom.plans.durable import drop, durable


def standard_names(entities: DataFrame, participants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known synonyms by their standard names, in the registry and on both sides of reactions."""
    return entities.withColumn("name", N.alias(F.col("name"))), participants.withColumn("entity", N.alias(F.col("entity")))


def _empty(df: DataFrame, ddl: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], f"pathway_id {df.schema['pathway_id'].dataType.simpleString()}, " + ddl)


def normalise(
    entities: DataFrame,
    processes: DataFrame,
    participants: DataFrame,
    states: DataFrame,
    same_as: DataFrame | None = None,
    prune: bool = False,
    locations: DataFrame | None = None,
    transports: DataFrame | None = None,
    interactions: DataFrame | None = None,
    single_enzymes: bool = False,
    connected: bool = True,
) -> dict[str, DataFrame]:
    """``entities(pathway_id, kind, pos, name)``, ``processes(pathway_id, process, pos, name, state, evidence)`` (reactions),
    ``participants(pathway_id, process, role, pos, entity)`` of reactions (reactant, product, modifier) and transports
    (cargo, transporter), ``states(pathway_id, name, place)``, ``locations(pathway_id, pos, entity, state, evidence)``,
    ``transports(pathway_id, process, pos, from_state, to_state, evidence)`` with process numbers of their own,
    ``interactions(pathway_id, pos, entity_1, relationship, entity_2)`` → those tables rewritten, with ``issues``, ``passed``
    and ``set_aside`` pathways.

    In order: standard names, composites, scaffolds bound, by-product complexes removed, automatic states (of locations and
    transports), states filled from locations, transporters, interactions as modifiers (and lone enzymes that texts name, if
    ``single_enzymes``), catalysts, SAME_AS, actors by their registered names, repeats and no-ops, and the gates, that
    against proteins that nothing links only if ``connected``."""
    locations = _empty(entities, "pos long, entity string, state string, evidence string") if locations is None else locations
    transports = _empty(processes, "process long, pos long, from_state string, to_state string, evidence string") if transports is None else transports
    entities, participants = map(durable, standard_names(entities, participants))
    locations = locations.withColumn("entity", N.alias(F.col("entity")))
    proteins = entities.where("kind = 'protein'").select("pathway_id", "name")
    texts = processes.select("pathway_id", "process", "evidence").unionByName(transports.select("pathway_id", "process", "evidence"))
    told = participants.join(texts, ["pathway_id", "process"], "left")
    decided = durable(rewrite.decide_composites(told, proteins))
    used, made, errors = rewrite.apply_composites(told, decided)
    errors = durable(errors)
    used = used.select("pathway_id", "process", "role", (F.col("pos") * 10 + F.col("sub")).alias("pos"), "entity", "evidence")
    # composites of the registry go; the complexes that they named come
    zero = F.lit(0).cast(entities.schema["pos"].dataType).alias("pos")
    as_complex = lambda df: df.select("pathway_id", F.lit("protein_complex").alias("kind"), zero, "name")
    registry = entities.where(~N.has_plus(F.col("name"))).select("pathway_id", "kind", "pos", "name").unionByName(as_complex(made))
    always = entities.select("pathway_id").distinct().select("pathway_id", F.explode(F.array(*map(F.lit, vocab.SCAFFOLDS))).alias("norm"))
    bases = lambda r: cleaning.scaffolds(r.where("kind = 'protein_complex'")).union(always).distinct()
    used, registry = durable(used), durable(registry)
    drop(participants, decided)
    before = used, registry
    bound = durable(rewrite.bind_scaffolds(used.where("role = 'product'").select("pathway_id", "process", "pos", "entity", "evidence"), bases(registry), proteins))
    used, made = rewrite.apply_scaffolds(used.drop("evidence"), bound)
    registry = registry.unionByName(as_complex(made))
    unwanted = durable(rewrite.byproduct_complexes(registry.where("kind = 'protein_complex'"), texts.select("pathway_id", "evidence").where("evidence is not null")))
    used = rewrite.remove_complexes(used, unwanted)
    registry = registry.join(unwanted.withColumn("kind", F.lit("protein_complex")), ["pathway_id", "kind", "name"], "left_anti")
    used, registry = durable(used), durable(registry)
    drop(*before, bound, unwanted)
    scaffolds = durable(bases(registry))
    # places: locations and transports that have none are in the automatic state, reactions where their participants are
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    filled = lambda df, c: df.withColumn(c, F.when(blank(c), integrity.AUTO_STATE).otherwise(F.col(c)))
    lacking = locations.where(blank("state")).select("pathway_id").union(transports.where(blank("from_state") | blank("to_state")).select("pathway_id")).distinct()
    new = lacking.join(states.where(F.col("name") == integrity.AUTO_STATE), "pathway_id", "left_anti").select("pathway_id", F.lit(integrity.AUTO_STATE).alias("name"), F.lit(integrity.AUTO_PLACE).alias("place"))
    states = states.select("pathway_id", "name", "place").unionByName(new)
    locations, transports = filled(locations, "state"), filled(filled(transports, "from_state"), "to_state")
    numbered_states = numbered(states, ["pathway_id"], "name", name="pos")
    back = integrity.backfill_states(used, locations.select("pathway_id", "entity", "pos", "state"), numbered_states).withColumnRenamed("state", "_s")
    steps = durable(processes.join(back, ["pathway_id", "process"], "left").withColumn("state", F.when(blank("state"), F.col("_s")).otherwise(F.col("state"))).drop("_s"))
    # actors
    named = registry.where("kind = 'protein'").select("pathway_id", F.col("name").alias("actor")).distinct()
    cargo = used.where("role = 'cargo'").groupBy("pathway_id", "process").agg(F.min("entity").alias("cargo"))
    moves = transports.join(cargo, ["pathway_id", "process"], "left")
    extra = lambda df, role: df.select("pathway_id", "process", F.lit(role).alias("role"), F.lit(0).cast(used.schema["pos"].dataType).alias("pos"), F.col("actor").alias("entity"))
    placed = locations.join(named.select("pathway_id", F.col("actor").alias("entity")), ["pathway_id", "entity"], "left_semi").select("pathway_id", F.col("entity").alias("actor"), "state", "evidence")
    carried = integrity.attach_transporters(moves, named.withColumn("pos", F.lit(0)), used.where("role = 'transporter'").select("pathway_id", "process", F.col("entity").alias("actor")), placed)
    added = [extra(carried, "transporter")]
    if interactions is not None:
        acting = registry.where("kind in ('protein', 'protein_complex')").select("pathway_id", F.col("name").alias("actor")).distinct()
        acts, interactions = integrity.promote_interactions(interactions, processes, acting)
        interactions = durable(interactions)
        added.append(extra(acts, "modifier"))
    if single_enzymes:
        have = used.where("role = 'modifier'").select("pathway_id", "process", F.col("entity").alias("actor"))
        added.append(extra(integrity.single_enzyme(processes.drop("pos"), named.withColumns({"rank": F.lit(0), "pos": F.lit(0)}), have, F.concat_ws(" ", "name", "evidence")), "modifier"))
    # catalysts read what is used several times, so what was added is found once before
    added = durable(graph.union_all(added))
    before = used, registry, added
    used = durable(integrity.promote_catalysts(used.unionByName(added), proteins, scaffolds))
    drop(entities)
    bare = used
    if same_as is not None:
        times = used.groupBy("pathway_id", F.col("entity").alias("name")).agg(F.min(F.when(F.col("role").isin("modifier", "transporter"), 0).otherwise(1)).alias("rank"), F.count("*").alias("times"))
        chosen = graph.equivalence(same_as, times)
        used, registry = graph.rewrite(used, "entity", chosen), graph.rewrite(registry, "name", chosen)
    registry = durable(first_per(registry.withColumn("_n", N.norm_with_colon(F.col("name"))), ["pathway_id", "kind", "_n"], "pos", "name").drop("_n"))
    is_actor = F.col("role").isin("modifier", "transporter")
    actors = integrity.normalise_actors(used.where(is_actor).select("pathway_id", "process", "role", "pos", F.col("entity").alias("actor")), registry.where("kind in ('protein', 'protein_complex')"))
    used = used.where(~is_actor).unionByName(actors.select("pathway_id", "process", "role", "pos", "entity"))
    used = durable(first_per(used.withColumn("_n", N.norm_with_colon(F.col("entity"))), ["pathway_id", "process", "role", "_n"], "pos", "entity").drop("_n"))
    drop(*before, bare)
    before = used, steps, registry
    # repeats and no-ops
    sided = merge.sides(used).join(steps, ["pathway_id", "process"])
    key = [F.array_sort(F.transform(c, N.norm_with_colon)) for c in ("inputs", "outputs", "modifiers")]
    kept = merge.dedupe_processes(sided, [*key, F.col("state")], [F.size("modifiers"), F.length(F.coalesce("evidence", F.lit("")))])
    kept = durable(merge.drop_noops(kept.withColumn("essential", F.lit(False))))
    carriers = used.where("role = 'transporter'").groupBy("pathway_id", "process").agg(F.array_sort(F.collect_set("entity")).alias("transporters"))
    moved = transports.join(used.where("role = 'cargo'").select("pathway_id", "process", F.col("entity").alias("cargo")), ["pathway_id", "process"], "left").join(carriers, ["pathway_id", "process"], "left").withColumn("transporters", F.coalesce("transporters", F.array().cast("array<string>")))
    kept_moves = durable(merge.dedupe_processes(moved, [N.norm_with_colon(F.coalesce("cargo", F.lit(""))), F.col("from_state"), F.col("to_state")], [F.size("transporters"), F.length(F.coalesce("evidence", F.lit("")))]).drop("copies"))
    there = kept.select("pathway_id", "process").union(kept_moves.select("pathway_id", "process"))
    used = durable(used.join(there, ["pathway_id", "process"], "left_semi"))
    lost = integrity.missing_entities(used, registry, ("process", "pos"))
    registry = registry.unionByName(lost.select("pathway_id", F.lit("compound").alias("kind"), F.lit(1_000_000).cast(registry.schema["pos"].dataType).alias("pos"), "name"))
    linking = {"moves": kept_moves.where("cargo is not null"), "interactions": interactions}
    adj, ends = graph.adjacency(used, **linking), graph.ends(used, **linking)
    if prune:
        linked = ends.select("pathway_id", N.norm_with_colon(F.substring_index("a", "entity:", -1)).alias("_n")).distinct()
        loose = registry.where("kind = 'protein'").withColumn("_n", N.norm_with_colon(F.col("name"))).join(linked, ["pathway_id", "_n"], "left_anti").select("pathway_id", "kind", "name")
        registry = registry.join(loose, ["pathway_id", "kind", "name"], "left_anti")
    registry = durable(registry)
    drop(*before)
    actors = used.where(is_actor).select("pathway_id", "process", F.col("entity").alias("actor"))
    issues = durable(errors.unionByName(integrity.strict_gates(used, actors, registry, scaffolds, ends if connected else None)))
    drop(scaffolds, errors)
    pathways = processes.select("pathway_id").union(transports.select("pathway_id")).distinct()
    passed, aside = integrity.quarantine(pathways, issues)
    return {"entities": registry, "processes": kept.drop("copies", "essential"), "transports": kept_moves, "interactions": interactions, "participants": used, "states": states, "locations": locations, "issues": issues, "passed": passed, "set_aside": aside, "adjacency": adj}
