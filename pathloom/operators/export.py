"""Model tables: identifiers, cross references, deduplication, metrics and typed edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import vocab
from pathloom.plans.durable import durable


def cross_references(df: DataFrame, *keys: str) -> DataFrame:
    """``keys, db, urn``: a URN for each external id of a known database (``mapped_ids``)."""
    prefix = F.create_map(*[F.lit(x) for kv in vocab.XREF_PREFIXES.items() for x in kv])
    ids = df.select(*keys, F.explode("mapped_ids").alias("db", "ext")).where(F.trim("ext") != "")
    known = ids.withColumn("p", F.try_element_at(prefix, F.lower(F.trim("db")))).where("p is not null")
    return known.select(*keys, F.lower(F.trim("db")).alias("db"), F.concat("p", F.trim("ext")).alias("urn"))


def allocated(df: DataFrame, keys: list[str], given: str, order: list[str], base: int = 1) -> DataFrame:
    """``id``: the given id, else the next number of the key's counter, in order."""
    free = F.col(given).isNull()
    from pyspark.sql import Window

    n = F.sum(free.cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("id", F.coalesce(given, base + n - 1))


def unique_ids(df: DataFrame, keys: list[str], raw: str, order: list[str]) -> DataFrame:
    """``sid``: a model identifier of each name, later ones of equal identifier with ``_2``, ``_3`` …"""
    from pathloom.functions import names as N
    from pathloom.operators.tables import numbered

    got = numbered(df.withColumn("_base", N.model_id(F.col(raw))), [*keys, "_base"], *order, name="_k")
    return got.withColumn("sid", F.concat("_base", F.when(F.col("_k") > 1, F.concat(F.lit("_"), F.col("_k").cast("string"))).otherwise(""))).drop("_base", "_k")


def grid(df: DataFrame, keys: list[str], order: list[str], columns: int = 5, dx: int = 160, dy: int = 120) -> DataFrame:
    """Coordinates in rows of ``columns``."""
    from pathloom.operators.tables import numbered

    i = F.col("_k") - 1
    return numbered(df, keys, *order, name="_k").withColumns({"x": (i % columns) * dx, "y": F.floor(i / columns).cast("int") * dy}).drop("_k")


def model_tables(entities: DataFrame, participants: DataFrame, places: DataFrame, default: str = "cell") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``compartments(pathway_id, id, name)``, ``species(pathway_id, id, name, compartment)`` and
    ``references(pathway_id, process, role, species)`` of an export: one species per name and place, names that no
    registry has included, the default compartment where no place is known."""
    from pathloom.functions import names as N
    from pathloom.operators.tables import first_per, numbered

    named = entities.select("pathway_id", F.lit(0).alias("late"), F.col("pos").cast("long").alias("pos"), "name").unionByName(participants.select("pathway_id", F.lit(1).alias("late"), F.col("process").cast("long").alias("pos"), F.col("entity").alias("name")))
    one = first_per(named.withColumn("n", N.norm(F.col("name"))).where("n <> ''"), ["pathway_id", "n"], "late", "pos", "name")
    at = first_per(places.select("pathway_id", N.norm(F.col("entity")).alias("n"), "place"), ["pathway_id", "n"], "place")
    # the three tables stand on it, two on the species
    full = durable(one.join(at, ["pathway_id", "n"], "left").withColumn("place", F.coalesce("place", F.lit(default))))
    comps = numbered(full.select("pathway_id", F.col("place").alias("name")).distinct(), ["pathway_id"], "name").select("pathway_id", F.concat(F.lit("c"), "rn").alias("id"), "name")
    spec = durable(numbered(full, ["pathway_id"], "late", "pos", "n").join(comps.select("pathway_id", F.col("id").alias("compartment"), F.col("name").alias("place")), ["pathway_id", "place"]).select("pathway_id", F.concat(F.lit("s"), "rn").alias("id"), "name", "compartment", "n"))
    refs = participants.withColumn("n", N.norm(F.col("entity"))).join(spec.select("pathway_id", "n", F.col("id").alias("species")), ["pathway_id", "n"]).select("pathway_id", "process", "role", "species")
    return comps, spec.drop("n"), refs


def resolved_elements(participants: DataFrame, ids: DataFrame, states: DataFrame) -> DataFrame:
    """Left and right elements of the second target format: names without an id drop out, a process without a known
    state takes the pathway's first. ``ids(pathway_id, name, ref_id)``, ``states(pathway_id, pos, name)``."""
    from pathloom.functions import names as N

    known = ids.select("pathway_id", N.norm(F.col("name")).alias("n"), "ref_id")
    first = states.groupBy("pathway_id").agg(F.min_by("name", "pos").alias("first_state"))
    own = states.select("pathway_id", F.col("name").alias("state"), F.lit(True).alias("_is"))
    got = participants.withColumn("n", N.norm(F.col("entity"))).join(known, ["pathway_id", "n"]).join(own, ["pathway_id", "state"], "left").join(first, "pathway_id", "left")
    return got.select("pathway_id", "process", F.when(F.col("role") == "product", "right").otherwise("left").alias("side"), "ref_id", F.when(F.col("_is"), F.col("state")).otherwise(F.col("first_state")).alias("state"))


def reaction_signatures(refs: DataFrame, reactions: DataFrame, key: str = "pathway_id") -> DataFrame:
    """``reactions`` (``key, pos, id, compartment, reversible``) with a signature of place, sides with stoichiometry, modifiers and direction."""
    from pathloom.functions import names as N

    part = F.concat_ws("*", "species", N.stoichiometry_key(F.col("stoichiometry")))
    side = lambda r: F.array_join(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("role") == r, part if r != "modifier" else F.col("species"))))), "+")
    sides = refs.groupBy(key, F.col("reaction").alias("id")).agg(*[side(r).alias(f"_{r}") for r in ("reactant", "product", "modifier")])
    got = reactions.join(sides, [key, "id"], "left").fillna("", ["_reactant", "_product", "_modifier"])
    return got.withColumn("signature", F.concat_ws("|", F.coalesce("compartment", F.lit("")), "_reactant", "_product", "_modifier", F.col("reversible").cast("string"))).drop("_reactant", "_product", "_modifier")


def duplicate_reactions(signed: DataFrame, key: str = "pathway_id") -> DataFrame:
    """``key, keep, drop``: reactions of one signature merge into the first."""
    first = signed.groupBy(key, "signature").agg(F.min_by("id", F.struct("pos", "id")).alias("keep"), F.count("*").alias("n")).where("n > 1")
    return signed.join(first, [key, "signature"]).where("id <> keep").select(key, "keep", F.col("id").alias("drop"))


def element_keys(refs: DataFrame, key: str = "pathway_id") -> DataFrame:
    """``key, reaction, elements``: ids of the sides, each sorted as text, as ``a,b→c``."""
    ids = lambda r: F.array_join(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("role") == r, F.col("species").cast("string"))))), ",")
    return refs.groupBy(key, "reaction").agg(F.concat(ids("reactant"), F.lit("→"), ids("product")).alias("elements"))


def complexes_by_accession(members: DataFrame, proteins: DataFrame) -> DataFrame:
    """``accession, complexes``: complexes (``complex, protein``) by the accession of their members."""
    return members.join(proteins, "protein").groupBy("accession").agg(F.array_sort(F.collect_set("complex")).alias("complexes"))


def model_metrics(spec: DataFrame, reactions: DataFrame, comps: DataFrame, refs: DataFrame, duplicates: DataFrame, key: str = "pathway_id") -> DataFrame:
    """Per model: species, reactions, compartments, species in no reaction, duplicate reactions."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    alone = spec.join(refs.select(key, F.col("species").alias("id")), [key, "id"], "left_anti")
    out = count(spec, "species")
    for df, name in ((reactions, "reactions"), (comps, "compartments"), (alone, "isolated"), (duplicates, "duplicates")):
        out = out.join(count(df, name), key, "full")
    return out.fillna(0)


def compartment_usage(comps: DataFrame, spec: DataFrame, reactions: DataFrame, key: str = "pathway_id") -> DataFrame:
    used = spec.select(key, F.col("compartment").alias("id")).union(reactions.select(key, F.col("compartment").alias("id"))).groupBy(key, "id").agg(F.count("*").alias("uses"))
    return comps.join(used, [key, "id"], "left").fillna(0, ["uses"])


def merge_compartments(usage: DataFrame, spec: DataFrame, same: Column, key: str = "pathway_id") -> tuple[DataFrame, DataFrame]:
    """Compartments of one meaning (``same``, null for those apart) merge into the most used one; species move along; what is
    then unused goes. Returns compartments and species."""
    grouped = usage.withColumn("_g", same)
    best = grouped.where("_g is not null").groupBy(key, "_g").agg(F.min_by("id", F.struct(-F.col("uses"), "id")).alias("to"), F.count("*").alias("n")).where("n > 1")
    move = grouped.join(best, [key, "_g"]).where("id <> to").select(key, F.col("id").alias("compartment"), "to")
    return usage.join(move.select(key, F.col("compartment").alias("id")), [key, "id"], "left_anti"), spec.join(move, [key, "compartment"], "left").withColumn("compartment", F.coalesce("to", "compartment")).drop("to")


def strip_unmapped(comps: DataFrame, spec: DataFrame, reactions: DataFrame, refs: DataFrame, key: str = "pathway_id") -> DataFrame:
    """``key, what, id, reason`` of what goes: compartments without a reference id (``ref_id``), species without one or in
    such a compartment, reactions without one or with such a species."""
    bad_c = comps.where("ref_id is null").select(key, F.lit("compartment").alias("what"), "id", F.lit("no_id").alias("reason"))
    s = spec.join(bad_c.select(key, F.col("id").alias("compartment"), F.lit(True).alias("_c")), [key, "compartment"], "left")
    bad_s = s.where("ref_id is null or _c").select(key, F.lit("species").alias("what"), "id", F.concat_ws("+", F.when(F.col("ref_id").isNull(), "no_id"), F.when(F.col("_c"), "compartment_removed")).alias("reason"))
    hit = refs.join(bad_s.select(key, F.col("id").alias("species")), [key, "species"], "left_semi").select(key, F.col("reaction").alias("id")).distinct().withColumn("_s", F.lit(True))
    r = reactions.join(hit, [key, "id"], "left")
    bad_r = r.where("ref_id is null or _s").select(key, F.lit("reaction").alias("what"), "id", F.concat_ws("+", F.when(F.col("ref_id").isNull(), "no_id"), F.when(F.col("_s"), "references_removed_species")).alias("reason"))
    return bad_c.unionByName(bad_s).unionByName(bad_r)


def structure_profile(items: DataFrame, shown: int = 3) -> DataFrame:
    """From the first items of each sample's sections (``sample, section, item, field, place, value``): per section and field in
    how many sampled items it stands, its usual place, and the type of all its values."""
    from pathloom.operators.tables import numbered

    few = numbered(items.select("sample", "section", "item").distinct(), ["sample", "section"], "item").where(F.col("rn") <= shown)
    some = items.join(few, ["sample", "section", "item"])
    total = few.groupBy("section").agg(F.count("*").alias("items"))
    v = F.coalesce(F.trim("value"), F.lit(""))
    kind = F.when(F.bool_and(v == ""), "nil").when(F.bool_and(v.rlike(r"^-?\d+$") | (v == "")), "integer").when(F.bool_and(v.isin("true", "false", "")), "boolean").otherwise("text")
    got = some.groupBy("section", "field").agg(F.count_distinct("sample", "item").alias("seen"), F.min("place").alias("place"), kind.alias("type"))
    return got.join(total, "section").withColumn("required", F.col("seen") == F.col("items")).drop("items")


def structure_issues(profile: DataFrame, items: DataFrame) -> DataFrame:
    """``section, item, field, problem``: required fields that an item lacks, values of another type, sections that are missing."""
    have = items.select("section", "item").distinct()
    need = profile.where("required").select("section", "field")
    lacking = have.join(need, "section").join(items.select("section", "item", "field"), ["section", "item", "field"], "left_anti").withColumn("problem", F.lit("missing_field"))
    v = F.coalesce(F.trim("value"), F.lit(""))
    wrong = items.join(profile.select("section", "field", "type"), ["section", "field"]).where((v != "") & (((F.col("type") == "integer") & ~v.rlike(r"^-?\d+$")) | ((F.col("type") == "boolean") & ~v.isin("true", "false")))).select("section", "item", "field", F.lit("wrong_type").alias("problem"))
    gone = profile.select("section").distinct().join(have, "section", "left_anti").select("section", F.lit(None).cast(have.schema["item"].dataType).alias("item"), F.lit(None).cast("string").alias("field"), F.lit("missing_section").alias("problem"))
    return lacking.select("section", "item", "field", "problem").unionByName(wrong).unionByName(gone)


def geometry_counts(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Visible elements by type (``kind, hidden``)."""
    return elements.where("not coalesce(hidden, false)").groupBy(*keys).pivot("kind", ["compound", "protein", "edge", "membrane"]).count().fillna(0)


def model_scan(spec: DataFrame, sides: DataFrame, messages: DataFrame, key: str = "pathway_id", most: float = 0.45) -> DataFrame:
    """``key, severity, code``: too many species without a reference id, reactions with equal sides, severe messages."""
    from pathloom.operators.merge import noop_object

    share = spec.groupBy(key).agg(F.avg(F.when(F.col("ref_id").isNull(), 1.0).otherwise(0.0)).alias("s")).where(F.col("s") > most).select(key, F.lit("warning").alias("severity"), F.lit("unmapped_share").alias("code"))
    same = sides.where(noop_object(F.col("inputs"), F.col("outputs"))).select(key, F.lit("warning").alias("severity"), F.lit("identical_sides").alias("code"))
    severe = messages.where("severity >= 2").select(key, F.lit("error").alias("severity"), "code")
    return share.unionByName(same).unionByName(severe)


def apply_edits(spec: DataFrame, comps: DataFrame, refs: DataFrame, edits: DataFrame, key: str = "pathway_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Species and compartments after typed edits (``key, seq, op, target, value``), and the edits refused with a reason.

    A species that a reaction refers to isn't deleted, nor a compartment that holds one; a species moves only to a compartment
    that there is; what is to be changed must exist. The last edit of a thing wins."""
    s = spec.select(key, F.col("id").alias("target"), F.lit(True).alias("_species"))
    c = comps.select(key, F.col("id").alias("target"), F.lit(True).alias("_comp"))
    dest = comps.select(key, F.col("id").alias("value"), F.lit(True).alias("_dest"))
    busy_s = refs.select(key, F.col("species").alias("target")).distinct().withColumn("_busy_s", F.lit(True))
    busy_c = spec.select(key, F.col("compartment").alias("target")).distinct().withColumn("_busy_c", F.lit(True))
    e = edits.join(s, [key, "target"], "left").join(c, [key, "target"], "left").join(dest, [key, "value"], "left").join(busy_s, [key, "target"], "left").join(busy_c, [key, "target"], "left")
    op, yes = F.col("op"), lambda x: F.coalesce(F.col(x), F.lit(False))
    why = (
        F.when(op.isin("delete_species", "rename_species", "move_species_compartment") & ~yes("_species"), "no_such_species")
        .when(op.isin("delete_compartment", "rename_compartment") & ~yes("_comp"), "no_such_compartment")
        .when((op == "delete_species") & yes("_busy_s"), "species_in_use").when((op == "delete_compartment") & yes("_busy_c"), "compartment_in_use")
        .when((op == "move_species_compartment") & ~yes("_dest"), "no_such_compartment").when(~op.isin("delete_species", "rename_species", "move_species_compartment", "delete_compartment", "rename_compartment"), "unsupported")
    )
    judged = e.withColumn("why", why).select(*edits.columns, "why")
    ok = judged.where("why is null")
    last = lambda name, as_: ok.where(op == name).groupBy(key, F.col("target").alias("id")).agg(F.max_by("value", "seq").alias(as_))
    species = spec.join(last("rename_species", "_name"), [key, "id"], "left").join(last("move_species_compartment", "_at"), [key, "id"], "left").join(ok.where("op = 'delete_species'").select(key, F.col("target").alias("id")), [key, "id"], "left_anti")
    species = species.withColumn("name", F.coalesce("_name", "name")).withColumn("compartment", F.coalesce("_at", "compartment")).select(*spec.columns)
    compartments = comps.join(last("rename_compartment", "_name"), [key, "id"], "left").join(ok.where("op = 'delete_compartment'").select(key, F.col("target").alias("id")), [key, "id"], "left_anti").withColumn("name", F.coalesce("_name", "name")).select(*comps.columns)
    return species, compartments, judged.where("why is not null")


def clean_model(spec: DataFrame, comps: DataFrame, reactions: DataFrame, refs: DataFrame, key: str = "pathway_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Species that a reaction refers to, compartments that one of them is in, reactions without duplicates."""
    drop = duplicate_reactions(reaction_signatures(refs, reactions, key), key).select(key, F.col("drop").alias("id"))
    kept = reactions.join(drop, [key, "id"], "left_anti")
    used = refs.join(kept.select(key, F.col("id").alias("reaction")), [key, "reaction"], "left_semi").select(key, F.col("species").alias("id"))
    species = spec.join(used, [key, "id"], "left_semi")
    return species, comps.join(species.select(key, F.col("compartment").alias("id")), [key, "id"], "left_semi"), kept
