"""Cleaning of shredded payloads: what is named, located and complete stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.functions import vocab
from pathloom.operators.tables import first_per, ordered


def filled(c: str | Column) -> Column:
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def strip_empty(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Blank texts as null, arrays without blanks, no evidence."""
    out = df.drop("evidence")
    for f in out.schema:
        kind = f.dataType.simpleString()
        if f.name not in keys and kind == "string":
            out = out.withColumn(f.name, filled(f.name))
        elif kind == "array<string>":
            out = out.withColumn(f.name, F.filter(f.name, lambda x: filled(x).isNotNull()))
    return out


def clean_entities(ents: DataFrame) -> DataFrame:
    """Those with a name, the first of each pathway, kind and normal name, trimmed."""
    named = ents.withColumn("name", filled("name")).withColumn("_n", N.norm(F.col("name"))).where("name is not null")
    return first_per(named, ["pathway_id", "kind", "_n"], "pos").drop("_n")


def clean_states(states: DataFrame, fields: tuple[str, ...] = ("name", "species", "cell_type", "tissue", "subcellular_location")) -> DataFrame:
    trimmed = states.withColumns({f: filled(f) for f in fields})
    return trimmed.where(F.coalesce(*fields).isNotNull())


def clean_locations(locations: DataFrame) -> DataFrame:
    return locations.withColumns({"entity": filled("entity"), "state": filled("state")}).where("entity is not null")


def clean_participants(participants: DataFrame) -> DataFrame:
    """Composites split to their parts, each name once per process and role, in order."""
    part = participants.select("pathway_id", "process", "role", "pos", F.posexplode(N.composite_parts(F.col("entity"))).alias("sub", "entity"))
    return first_per(part.withColumn("_n", N.norm(F.col("entity"))), ["pathway_id", "process", "role", "_n"], "pos", "sub").drop("_n")


def complete_processes(processes: DataFrame, participants: DataFrame) -> DataFrame:
    """Reactions with both sides, transports with cargo, transporter or element, interactions with both ends."""
    have = participants.groupBy("pathway_id", "process").agg(F.collect_set("role").alias("roles"))
    got = processes.join(have, ["pathway_id", "process"], "left")
    has = lambda *r: [F.coalesce(F.array_contains("roles", x), F.lit(False)) for x in r]
    i, o = has("reactant", "product")
    c, t, e = has("cargo", "transporter", "element")
    a, b = has("entity_1", "entity_2")
    keep = F.when(F.col("kind") == "reaction", i & o).when(F.col("kind") == "transport", c | t | e).when(F.col("kind") == "interaction", a & b).otherwise(True)
    return got.where(keep).drop("roles")


def in_scope(processes: DataFrame) -> DataFrame:
    return processes.where(F.coalesce("scope", F.lit("core")) != "out_of_scope")


def removed_by_scope(processes: DataFrame) -> DataFrame:
    """Per pathway the names of the reactions out of scope."""
    return processes.where("scope = 'out_of_scope'").groupBy("pathway_id").agg(F.count("*").alias("removed"), F.array_join(ordered("name", "pos"), "|").alias("names"))


def relevant(chunks: DataFrame, least: float = vocab.MIN_RELEVANCE) -> DataFrame:
    return chunks.where(F.coalesce("relevance", F.lit(1.0)) >= least)


def normal_additions(documents: DataFrame, columns: tuple[str, ...] = ("entities", "processes")) -> DataFrame:
    """Documents as JSON texts: the block of a wrapped or a bare addition, processes misplaced under entities included."""
    block = lambda c: F.coalesce(F.get_json_object("json", f"$.additions.{c}"), F.get_json_object("json", f"$.{c}"))
    got = documents.withColumns({c: block(c) for c in columns})
    return got.withColumn("processes", F.coalesce("processes", F.get_json_object("entities", "$.processes"))) if "processes" in columns else got


def fold_modifiers(actors: DataFrame) -> DataFrame:
    """Modifiers as enzymes, each name once per process; enzymes come first."""
    late = F.when(F.col("role") == "enzyme", 0).otherwise(1)
    named = actors.where(F.col("role").isin("enzyme", "modifier")).withColumn("_late", late).withColumn("_n", N.norm(F.col("entity")))
    return first_per(named, ["pathway_id", "process", "_n"], "_late", "pos").withColumn("role", F.lit("enzyme")).drop("_n", "_late")


def protein_like(names: DataFrame, known: DataFrame) -> DataFrame:
    """``names(pathway_id, name)`` with ``is_protein``: registered (``known``), or of such a name."""
    k = known.select("pathway_id", N.norm(F.col("name")).alias("_n")).distinct().withColumn("_k", F.lit(True))
    got = names.withColumn("_n", N.norm(F.col("name"))).join(k, ["pathway_id", "_n"], "left")
    return got.withColumn("is_protein", F.coalesce("_k", F.lit(False)) | N.looks_like_protein(F.col("name"))).drop("_n", "_k")


def scaffolds(complexes: DataFrame) -> DataFrame:
    """Per pathway the normal names of scaffolds: the first part of each complex, and the standard ones."""
    first = complexes.where(F.size(N.complex_parts(F.col("name"))) >= 2).select("pathway_id", N.norm(F.get(N.complex_parts(F.col("name")), F.lit(0))).alias("norm"))
    fixed = complexes.select("pathway_id").distinct().select("pathway_id", F.explode(F.array(*map(F.lit, vocab.SCAFFOLDS))).alias("norm"))
    return first.union(fixed).distinct()
