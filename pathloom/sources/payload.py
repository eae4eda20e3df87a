"""Pathway payloads: nested JSON documents read with an explicit schema, shredded to tables and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.tables import ordered

ACTOR = "struct<entity:string,entity_type:string,role:string,protein:string,protein_complex:string,name:string,evidence:string,confidence:double>"
ENTITY = "array<struct<name:string,class:string,organism:string,confidence:double,evidence:string,components:array<string>,mapped_ids:map<string,string>>>"
KINDS = {"compounds": "compound", "proteins": "protein", "protein_complexes": "protein_complex", "nucleic_acids": "nucleic_acid", "element_collections": "element_collection", "species": "species", "cell_types": "cell_type", "tissues": "tissue", "subcellular_locations": "subcellular_location"}
LOCATIONS = {"compound_locations": "compound", "protein_locations": "protein", "nucleic_acid_locations": "nucleic_acid", "element_collection_locations": "element_collection"}
SCHEMA = (
    "pathway_id string, entities struct<" + ",".join(f"{k}:{ENTITY}" for k in KINDS) + ">, "
    "biological_states array<struct<name:string,species:string,cell_type:string,tissue:string,subcellular_location:string,evidence:string>>, "
    "element_locations struct<" + ",".join(f"{k}:array<struct<{v}:string,biological_state:string,evidence:string>>" for k, v in LOCATIONS.items()) + ">, "
    f"processes struct<reactions:array<struct<name:string,inputs:array<string>,outputs:array<string>,biological_state:string,evidence:string,enzymes:array<{ACTOR}>,modifiers:array<{ACTOR}>,scope_membership:string,essential:boolean,observed:boolean>>,"
    f"transports:array<struct<name:string,cargo:string,from_biological_state:string,to_biological_state:string,evidence:string,transporters:array<{ACTOR}>>>,"
    f"reaction_coupled_transports:array<struct<name:string,reaction:string,transport:string,enzymes:array<{ACTOR}>>>,"
    "interactions:array<struct<name:string,entity_1:string,relationship:string,entity_2:string,evidence:string,confidence:double>>>"
)


def read(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Payload documents of JSON files; those that are no object are told by ``_bad``."""
    return spark.read.schema(SCHEMA + ", _bad string").option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_bad").json(path)


def parse(texts: DataFrame, column: str = "json") -> DataFrame:
    """``texts`` with a ``payload`` and ``is_object``: whether the text is one JSON object. Wrong-typed fields are null."""
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json(column)).startswith("OBJECT"), F.lit(False))
    return texts.withColumn("is_object", ok).withColumn("payload", F.when(ok, F.from_json(column, SCHEMA, {"mode": "PERMISSIVE"})))


def actor_name(a: Column) -> Column:
    """An actor's name under any of its keys."""
    filled = [F.nullif(F.trim(a[k]), F.lit("")) for k in ("entity", "protein_complex", "protein", "name")]
    return F.coalesce(*filled)


def entities(p: DataFrame) -> DataFrame:
    """``pathway_id, kind, pos, pointer`` and the fields of each registry row."""
    out = None
    for key, kind in KINDS.items():
        one = p.select("pathway_id", F.posexplode(f"entities.{key}").alias("pos", "e")).select("pathway_id", F.lit(kind).alias("kind"), "pos", F.concat(F.lit(f"/entities/{key}/"), "pos").alias("pointer"), "e.*")
        out = one if out is None else out.unionByName(one)
    return out


def states(p: DataFrame) -> DataFrame:
    return p.select("pathway_id", F.posexplode("biological_states").alias("pos", "s")).select("pathway_id", "pos", "s.*")


def locations(p: DataFrame) -> DataFrame:
    out = None
    for key, kind in LOCATIONS.items():
        one = p.select("pathway_id", F.posexplode(f"element_locations.{key}").alias("pos", "l")).select("pathway_id", F.lit(kind).alias("kind"), "pos", F.col(f"l.{kind}").alias("entity"), F.col("l.biological_state").alias("state"), F.col("l.evidence").alias("evidence"))
        out = one if out is None else out.unionByName(one)
    return out


def reactions(p: DataFrame) -> DataFrame:
    return p.select("pathway_id", F.posexplode("processes.reactions").alias("process", "r")).select("pathway_id", "process", "r.*")


def participants(p: DataFrame) -> DataFrame:
    """``pathway_id, process_kind, process, role, pos, entity`` of all kinds of processes."""
    # each payload's rows as one array, so that it is read and parsed once
    row = lambda kind, n, role, pos, name: F.struct(F.lit(kind).alias("process_kind"), n.alias("process"), F.lit(role).alias("role"), pos.alias("pos"), name.alias("entity"))

    def side(kind: str, field: str, role: str, name=lambda x: x):
        return lambda r, n: F.transform(r[field], lambda x, i: row(kind, n, role, i, name(x)))

    def one(kind: str, field: str, role: str, pos: int):
        return lambda r, n: F.array(row(kind, n, role, F.lit(pos), r[field]))

    wanted = {
        "reactions": [side("reaction", "inputs", "reactant"), side("reaction", "outputs", "product"), side("reaction", "enzymes", "enzyme", actor_name), side("reaction", "modifiers", "modifier", actor_name)],
        "transports": [one("transport", "cargo", "cargo", 0), side("transport", "transporters", "transporter", actor_name)],
        "interactions": [one("interaction", "entity_1", "entity_1", 0), one("interaction", "entity_2", "entity_2", 1)],
    }
    none = F.array().cast("array<struct<process_kind:string,process:int,role:string,pos:int,entity:string>>")
    rows = [F.coalesce(F.flatten(F.transform(f"processes.{key}", lambda r, n: F.coalesce(f(r, n), none))), none) for key, parts in wanted.items() for f in parts]
    return p.select("pathway_id", F.inline(F.concat(*rows)))


def assemble(ents: DataFrame, rxns: DataFrame) -> DataFrame:
    """Payload documents from registry rows (``pathway_id, kind, pos, name``) and reactions (``pathway_id, process,
    inputs, outputs``), as JSON texts in their old order."""
    lists = ents.groupBy("pathway_id").agg(*[F.array_compact(ordered(F.when(F.col("kind") == kind, F.struct("name")), "pos")).alias(key) for key, kind in KINDS.items()])
    procs = rxns.groupBy("pathway_id").agg(ordered(F.struct("inputs", "outputs"), "process").alias("reactions"))
    both = lists.join(procs, "pathway_id", "full")
    filled = [F.when(F.size(k) > 0, F.col(k)).alias(k) for k in KINDS]
    return both.select("pathway_id", F.to_json(F.struct(F.col("pathway_id").cast("string").alias("pathway_id"), F.struct(*filled).alias("entities"), F.struct("reactions").alias("processes"))).alias("json"))
