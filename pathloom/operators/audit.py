"""Rule-based audit of pathways, one function a rule; each issue may bring its own patch. And patches: which are
accepted, and what they do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.operators.integrity import unknown_references
from pathloom.operators.merge import noop_object
from pathloom.operators.tables import first_per

PATCH = ("op", "path", "value", "confidence")


def issues(df: DataFrame, severity: str, rule: str, path: Column, reason: str, op: str | None = None, value: Column | None = None, confidence: float | None = None, to: Column | None = None) -> DataFrame:
    text = lambda x: F.lit(x).cast("string") if not isinstance(x, Column) else x.cast("string")
    return df.select("pathway_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), path.alias("path"), F.lit(reason).alias("reason"), text(op).alias("op"), (to if to is not None else path).alias("patch_path"), text(value).alias("value"), F.lit(confidence).cast("double").alias("confidence"))


def reaction_path(field: str | None = None) -> Column:
    return N.pointer(F.lit("processes"), F.lit("reactions"), F.col("pos"), *([F.lit(field)] if field else []))


def unnamed(entities: DataFrame) -> DataFrame:
    at = N.pointer(F.lit("entities"), F.col("kind"), F.col("pos"))
    return issues(entities.where("trim(coalesce(name, '')) = ''"), "error", "unnamed_entity", at, "an entity without a name", "remove", None, 0.96)


def composite_entities(entities: DataFrame) -> DataFrame:
    return issues(entities.where(N.has_plus(F.col("name"))), "warning", "composite_entity", N.pointer(F.lit("entities"), F.col("kind"), F.col("pos"), F.lit("name")), "a registered name is a composite")


def conflicting_duplicates(entities: DataFrame) -> DataFrame:
    """Later rows of one name, which are to be removed: errors where they differ in class."""
    n = N.norm(F.col("name"))
    first = entities.groupBy("pathway_id", "kind", n.alias("_n")).agg(F.min("pos").alias("first"), F.count_distinct("class").alias("classes")).where("_n <> ''")
    later = entities.withColumn("_n", n).join(first, ["pathway_id", "kind", "_n"]).where("pos > first")
    at = N.pointer(F.lit("entities"), F.col("kind"), F.col("pos"))
    return issues(later.where("classes > 1"), "error", "conflicting_duplicate", at, "two rows of one name differ").unionByName(issues(later.where("classes <= 1"), "warning", "duplicate_entity", at, "a row repeats an earlier one", "remove", None, 0.96))


def equation_mismatch(reactions: DataFrame) -> DataFrame:
    """Reactions whose name is an equation with other sides than they have."""
    l, r = N.equation_side(F.col("name"), True), N.equation_side(F.col("name"), False)
    got = reactions.withColumns({"_l": l, "_r": r}).where((F.size("_l") > 0) & (F.size("_r") > 0))
    side = lambda have, want, field: issues(got.where(~N.same_names(F.col(have), F.col(want))), "warning", "equation_mismatch", reaction_path(field), "the name's equation has another side", "replace", F.to_json(want), 0.9)
    return side("inputs", "_l", "inputs").unionByName(side("outputs", "_r", "outputs"))


def identical_sides(reactions: DataFrame) -> DataFrame:
    return issues(reactions.where(noop_object(F.col("inputs"), F.col("outputs"))), "error", "identical_sides", reaction_path(), "inputs and outputs are the same", "remove", None, 0.97)


def missing_sides(reactions: DataFrame) -> DataFrame:
    return issues(reactions.where((F.size("inputs") == 0) | (F.size("outputs") == 0)), "error", "missing_side", reaction_path(), "a side is empty")


def composite_sides(reactions: DataFrame) -> DataFrame:
    return issues(reactions.where(F.exists("inputs", N.has_plus) | F.exists("outputs", N.has_plus)), "warning", "composite_side", reaction_path(), "a side names a composite")


def missing_blocks(payloads: DataFrame, blocks: tuple[str, ...]) -> DataFrame:
    return reduce(DataFrame.unionByName, [issues(payloads.where(F.col(b).isNull()), "error", "missing_block", F.lit(f"/{b}"), "a block is missing", "add", F.lit("{}"), 0.99) for b in blocks])


def unknown_names(used: DataFrame, registry: DataFrame) -> DataFrame:
    """Names in processes that no registry has; the first of each is to be added."""
    lost = unknown_references(used, registry)
    at = N.pointer(F.lit("processes"), F.col("process"), F.col("role"), F.col("pos"))
    first = first_per(lost.withColumn("_n", N.norm(F.col("entity"))), ["pathway_id", "_n"], "process", "pos", "entity").select("pathway_id", "_n", "process", "role", "pos", F.lit(True).alias("_first"))
    got = lost.withColumn("_n", N.norm(F.col("entity"))).join(first, ["pathway_id", "_n", "process", "role", "pos"], "left")
    return issues(got.where("_first"), "error", "unknown_reference", at, "no registry has this name", "add", F.to_json(F.struct(F.col("entity").alias("name"))), 0.9, F.lit("/entities/compounds/-")).unionByName(issues(got.where("_first is null"), "error", "unknown_reference", at, "no registry has this name"))


def cargo_rules(transports: DataFrame) -> DataFrame:
    at = N.pointer(F.lit("processes"), F.lit("transports"), F.col("pos"))
    none = issues(transports.where("trim(coalesce(cargo, '')) = ''"), "error", "missing_cargo", at, "a transport without cargo")
    mixed = issues(transports.where(N.has_plus(F.col("cargo"))), "warning", "composite_cargo", at, "a transport of a composite")
    still = issues(transports.where("from_state = to_state and trim(cargo) <> ''"), "error", "unmoved_cargo", at, "from and to are the same", "remove", None, 0.97)
    return none.unionByName(mixed).unionByName(still)


def name_states(transports: DataFrame) -> DataFrame:
    """Transports whose name gives other places than their states."""
    src, dst = (N.norm(F.regexp_extract("name", r"(?i)\bfrom\s+(.+?)\s+to\s+(.+)$", i)) for i in (1, 2))
    off = (src != "") & (dst != "") & ((src != N.norm(F.col("from_state"))) | (dst != N.norm(F.col("to_state"))))
    return issues(transports.where(off), "warning", "name_state_mismatch", N.pointer(F.lit("processes"), F.lit("transports"), F.col("pos"), F.lit("name")), "the name's places are not its states", "replace", N.moved_name(F.col("name"), F.col("from_state"), F.col("to_state")), 0.93)


def unused(entities: DataFrame, used: DataFrame) -> DataFrame:
    u = used.select("pathway_id", N.norm(F.col("entity")).alias("_n"))
    rows = entities.where("kind = 'compound'").withColumn("_n", N.norm(F.col("name"))).where("_n <> ''").join(u, ["pathway_id", "_n"], "left_anti")
    return issues(rows, "warning", "unused_compound", N.pointer(F.lit("entities"), F.col("kind"), F.col("pos")), "in no process")


def unknown_states(processes: DataFrame, states: DataFrame) -> DataFrame:
    blank = F.trim(F.coalesce("state", F.lit(""))) == ""
    known = states.select("pathway_id", F.col("name").alias("state"))
    return issues(processes.where(~blank).join(known, ["pathway_id", "state"], "left_anti"), "error", "unknown_state", reaction_path("biological_state"), "no such state").unionByName(issues(processes.where(blank), "warning", "missing_state", reaction_path("biological_state"), "no state is given"))


def unlocated(entities: DataFrame, locations: DataFrame) -> DataFrame:
    at = locations.select("pathway_id", N.norm(F.col("entity")).alias("_n"))
    rows = entities.where("kind = 'protein'").withColumn("_n", N.norm(F.col("name"))).join(at, ["pathway_id", "_n"], "left_anti")
    return issues(rows, "warning", "unlocated_protein", N.pointer(F.lit("entities"), F.col("kind"), F.col("pos")), "a protein is nowhere")


def organism_spread(entities: DataFrame) -> DataFrame:
    """Proteins without an organism in pathways whose others have one and the same."""
    org = F.nullif(F.trim("organism"), F.lit(""))
    one = entities.where("kind = 'protein'").groupBy("pathway_id").agg(F.count_distinct(org).alias("n"), F.max(org).alias("one")).where("n = 1")
    rows = entities.where("kind = 'protein'").where(org.isNull()).join(one, "pathway_id")
    return issues(rows, "warning", "organism_spread", N.pointer(F.lit("entities"), F.col("kind"), F.col("pos"), F.lit("organism")), "the pathway's other proteins agree", "add", F.col("one"), 0.8)


def accepted(patches: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``patches`` with ``accepted`` and a reason. ``targets(pathway_id, path, is_noop)`` are processes as they were, which
    tell whether a removal is of one that does nothing."""
    op, path, conf = F.lower("op"), F.col("path"), F.coalesce("confidence", F.lit(0.0))
    told = F.coalesce(F.trim("evidence"), F.lit("")) != ""
    place = F.contains(path, F.lit("subcellular_location")) | F.contains(path, F.lit("compartment"))
    least = F.when((op == "add") & place, 0.70).when(op == "add", 0.75).when(op == "replace", 0.88).when(op == "remove", 0.95).otherwise(1.0)
    linking = path.rlike("/processes/reactions/.*/(inputs|outputs)(/|$)")
    core = path.rlike("/processes/(reactions|transports|reaction_coupled_transports)/")
    whole = path.rlike(r"^/processes/(reactions|transports)/\d+$")
    got = patches if targets is None else patches.join(targets.select("pathway_id", "path", "is_noop"), ["pathway_id", "path"], "left")
    noop = F.lit(False) if targets is None else F.coalesce("is_noop", F.lit(False))
    why = (
        F.when(~op.isin("add", "replace", "remove"), "unsupported_op").when(~F.coalesce(path.startswith("/"), F.lit(False)), "not_a_pointer").when(conf < least, "low_confidence")
        .when(linking & (conf < 0.98), "connectivity_confidence").when(linking & ~told, "connectivity_evidence")
        .when((op == "remove") & core & ~(whole & noop & (conf >= 0.97) & told), "core_removal").otherwise("accepted")
    )
    return got.withColumn("reason", why).withColumn("accepted", F.col("reason") == "accepted").select(*patches.columns, "accepted", "reason")


def normal_patches(raw: DataFrame, key: str = "pathway_id", order: str = "seq") -> DataFrame:
    """Patches as JSON texts under any of their names, the first of each operation and path."""
    get = lambda *ks: F.coalesce(*[F.get_json_object("json", f"$.{k}") for k in ks])
    p = raw.select(key, order, F.lower(get("op", "action")).alias("op"), get("path").alias("path"), get("value", "new_value").alias("value"), F.coalesce(get("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), get("evidence", "reason").alias("evidence"))
    return first_per(p.where("op is not null and path is not null"), [key, "op", "path"], order)
