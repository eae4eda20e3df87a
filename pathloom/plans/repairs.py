"""Accepted patches applied to all lists of shredded payloads, each list in its order and known by its own rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators import patches
from pathloom.operators.tables import numbered
from pathloom.plans.durable import durable
from pathloom.sources import payload

#: Processes that patches bring are numbered from here on, a block a round; those of a payload stand below.
BROUGHT, BLOCK = 1 << 29, 1 << 20
_LIST = r"^(/biological_states|/(?:entities|element_locations|processes)/[^/]+)(?:/|$)"
#: Each table's payload fields and the columns that hold them, and its list-valued fields.
FIELDS = {
    "entities": ({"name": "name"}, []),
    "states": ({"name": "name", "subcellular_location": "place"}, []),
    "locations": ({"entity": "entity", "biological_state": "state", "evidence": "evidence"}, []),
    "reactions": ({"name": "name", "biological_state": "state", "evidence": "evidence"}, ["inputs", "outputs"]),
    "transports": ({"name": "name", "cargo": "cargo", "from_biological_state": "from_state", "to_biological_state": "to_state", "evidence": "evidence"}, []),
    "interactions": ({"entity_1": "entity_1", "relationship": "relationship", "entity_2": "entity_2"}, []),
}
_LISTS = {
    "entities": {f"/entities/{k}": v for k, v in payload.KINDS.items()},
    "states": {"/biological_states": None},
    "locations": {f"/element_locations/{k}": v for k, v in payload.LOCATIONS.items()},
    **{k: {f"/processes/{k}": None} for k in ("reactions", "transports", "interactions")},
}
_HOME = {path: table for table, lists in _LISTS.items() for path in lists}
_KEYED = tuple(payload.LOCATIONS.values())


def _given(pairs: dict[str, str | None], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def _one(rows: DataFrame, table: str, given: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """A table's rows after its patches, whose key is the pathway and the list, and how each patch went."""
    names, lists = FIELDS[table]
    kinds = {v: k for k, v in _LISTS[table].items()}
    at = _given(kinds, F.col("kind")) if "kind" in rows.columns else F.lit(next(iter(_LISTS[table])))
    own = "process" in rows.columns
    row = F.col("process").cast("string") if own else F.lit("old")
    key = F.struct("pathway_id", at.alias("list")).alias("pathway_id")
    placed = numbered(rows, ["pathway_id", *(["kind"] if "kind" in rows.columns else [])], "pos", *(["name"] if table == "entities" else []))
    base = placed.select(key, (F.col("rn") - 1).alias("pos"), row.alias("_row"), *[F.col(c).alias(f) for f, c in names.items()], *lists)
    new, report = patches.apply_in_order(base, given, [*names, "_row"], lists)
    new = new.select("pathway_id.pathway_id", F.col("pathway_id.list").alias("_list"), F.col("pos").cast("long").alias("pos"), "_row", *[F.col(f).alias(c) for f, c in names.items()], *[F.coalesce(x, F.array().cast("array<string>")).alias(x) for x in lists])
    if "kind" in rows.columns:
        new = new.withColumn("kind", _given(_LISTS[table], F.col("_list")))
    if own:
        fresh = numbered(new.where("_row is null"), ["pathway_id"], "pos").withColumn("process", F.lit(block) + F.col("rn")).drop("rn")
        new = new.where("_row is not null").withColumn("process", F.col("_row").cast("int")).unionByName(fresh)
    types = {c: rows.schema[c].dataType for c in rows.columns}
    return durable(new.select(*[F.col(c).cast(types[c]).alias(c) for c in rows.columns])), report


def repair(t: dict[str, DataFrame], accepted: DataFrame, turn: int = 0) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables after ``accepted(pathway_id, seq, op, path, value)``, and ``pathway_id, seq, applied, reason`` of each.

    Lists are those of entities, states, locations, reactions, transports and interactions; a patch to a list as a whole,
    to another one, or to a field that the tables don't hold is refused with its reason. Reactants, products and cargo follow
    their processes' lists; actors stay with their process and go with it. An index is read as the list is when its patch's turn comes."""
    located = accepted.withColumn("_list", F.regexp_extract("path", _LIST, 1)).withColumn("_table", _given(_HOME, F.col("_list"))).withColumn("_in", F.expr("substring(path, length(_list) + 1)"))
    # a location's entity stands under the name of its kind
    entity = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in _KEYED])
    placed = F.to_json(F.struct(entity.alias("entity"), *[F.get_json_object("value", f"$.{k}").alias(k) for k in ("biological_state", "evidence")]))
    whole_row = F.col("_in").rlike("^/[^/]*$")
    located = located.withColumns({
        "_in": F.when(F.col("_table") == "locations", F.regexp_replace("_in", f"^(/[^/]+)/({'|'.join(_KEYED)})$", "$1/entity")).otherwise(F.col("_in")),
        "value": F.when((F.col("_table") == "locations") & whole_row & F.col("value").isNotNull(), placed).otherwise(F.col("value")),
        "_why": F.when(F.col("_table").isNull(), "no_such_list").when(F.col("_in") == "", "whole_list").when(F.col("_in").endswith("/_row") | F.contains(F.coalesce("value", F.lit("")), F.lit('"_row"')), "unknown_field"),
    })
    located = durable(located)
    report = [located.where("_why is not null").select("pathway_id", "seq", F.lit(False).alias("applied"), F.col("_why").alias("reason"))]
    touched = [r[0] for r in located.where("_why is null").select("_table").distinct().collect()]  # of the six tables
    out = dict(t)
    for table in sorted(touched):
        mine = located.where((F.col("_table") == table) & F.col("_why").isNull()).select(F.struct("pathway_id", F.col("_list").alias("list")).alias("pathway_id"), "seq", "op", F.col("_in").alias("path"), "value")
        base = BROUGHT + BLOCK * turn + ((1 << 30) if table == "transports" else 0)
        out[table], went = _one(t[table], table, mine, base)
        report.append(went.select("pathway_id.pathway_id", "seq", "applied", "reason"))
    if {"reactions", "transports"} & set(touched):
        out["participants"] = _participants(out)
    return out, reduce(DataFrame.unionByName, report)


def _participants(t: dict[str, DataFrame]) -> DataFrame:
    old = t["participants"]
    there = t["reactions"].select("pathway_id", "process").unionByName(t["transports"].select("pathway_id", "process"))
    side = lambda name, role: t["reactions"].select("pathway_id", "process", F.lit(role).alias("role"), F.posexplode(name).alias("pos", "entity"))
    cargo = t["transports"].select("pathway_id", "process", F.lit("cargo").alias("role"), F.lit(0).alias("pos"), F.col("cargo").alias("entity"))
    made = side("inputs", "reactant").unionByName(side("outputs", "product")).unionByName(cargo).where("trim(coalesce(entity, '')) <> ''")
    return durable(old.where("role not in ('reactant', 'product', 'cargo')").join(there, ["pathway_id", "process"], "left_semi").unionByName(made.select(*old.columns)))
