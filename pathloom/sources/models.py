"""Model documents in XML: compartments, species and reactions of SBML core, and harvested reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.operators.tables import first_per, ordered
from pathloom.plans.durable import durable, tidy

_REF = "array<struct<_species:string,_stoichiometry:double>>"
SBML = (
    "struct<model:struct<_id:string,_name:string,listOfCompartments:struct<compartment:array<struct<_id:string,_name:string>>>,"
    "listOfSpecies:struct<species:array<struct<_id:string,_name:string,_compartment:string>>>,"
    f"listOfReactions:struct<reaction:array<struct<_id:string,_name:string,_compartment:string,_reversible:boolean,listOfReactants:struct<speciesReference:{_REF}>,listOfProducts:struct<speciesReference:{_REF}>,listOfModifiers:struct<modifierSpeciesReference:array<struct<_species:string>>>>>>>>"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``source, xml``: a file a row, from a folder and those in it."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("source"), F.col("value").alias("xml"))


def parse(texts: DataFrame, key: str = "source", xml: str = "xml") -> DataFrame:
    """``key, model``, null where the text is no model. Texts are made and parsed once, whatever is then read from the table."""
    got = texts.select(key, F.from_xml(F.coalesce(xml, F.lit("<x/>")), SBML, {"mode": "PERMISSIVE"}).alias("d"))
    made = durable(got.select(key, F.when(F.coalesce(F.col("d.model._id"), F.col("d.model._name")).isNotNull() | F.col("d.model.listOfSpecies").isNotNull(), F.col("d.model")).alias("model")))
    tidy(texts.sparkSession)  # what making the texts left on the disk
    return made


def failures(parsed: DataFrame, key: str = "source") -> DataFrame:
    return parsed.where("model is null").select(key)


def compartments(parsed: DataFrame, key: str = "source") -> DataFrame:
    return parsed.select(key, F.posexplode("model.listOfCompartments.compartment").alias("pos", "c")).select(key, "pos", F.col("c._id").alias("id"), F.coalesce("c._name", "c._id").alias("name"))


def species(parsed: DataFrame, key: str = "source") -> DataFrame:
    return parsed.select(key, F.posexplode("model.listOfSpecies.species").alias("pos", "s")).select(key, "pos", F.col("s._id").alias("id"), F.coalesce("s._name", "s._id").alias("name"), F.col("s._compartment").alias("compartment"))


def reactions(parsed: DataFrame, key: str = "source") -> DataFrame:
    return parsed.select(key, F.posexplode("model.listOfReactions.reaction").alias("pos", "r")).select(key, "pos", F.col("r._id").alias("id"), F.coalesce("r._name", "r._id").alias("name"), F.col("r._compartment").alias("compartment"), F.coalesce("r._reversible", F.lit(False)).alias("reversible"))


def references(parsed: DataFrame, key: str = "source", named: bool = True) -> DataFrame:
    """``key, reaction, role, pos, species, stoichiometry``, with the species' names if ``named``."""
    r = parsed.select(key, F.explode("model.listOfReactions.reaction").alias("r"))
    parts = []
    for role, field, item in (("reactant", "listOfReactants", "speciesReference"), ("product", "listOfProducts", "speciesReference"), ("modifier", "listOfModifiers", "modifierSpeciesReference")):
        one = r.select(key, F.col("r._id").alias("reaction"), F.lit(role).alias("role"), F.posexplode(f"r.{field}.{item}").alias("pos", "x"))
        parts.append(one.select(key, "reaction", "role", "pos", F.col("x._species").alias("species"), (F.lit(1.0) if role == "modifier" else F.coalesce("x._stoichiometry", F.lit(1.0))).alias("stoichiometry")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if not named:
        return out
    names = species(parsed, key).select(key, F.col("id").alias("species"), F.col("name").alias("species_name"))
    return out.join(names, [key, "species"], "left")


def classified(rxns: DataFrame, refs: DataFrame, spec: DataFrame, key: str = "source") -> DataFrame:
    """``key, reaction, kind``: one species to one of the same name elsewhere is a transport."""
    at = spec.select(key, F.col("id").alias("species"), N.norm(F.col("name")).alias("n"), "compartment")
    side = refs.where("role <> 'modifier'").select(key, "reaction", "role", "species").join(at, [key, "species"], "left")
    ends = side.groupBy(key, "reaction").agg(*[f(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("reactant", "product") for c, f in (("n", F.max), ("compartment", F.max))], *[F.count_if(F.col("role") == r).alias(f"{r}s") for r in ("reactant", "product")])
    moved = (F.col("reactants") == 1) & (F.col("products") == 1) & (F.col("reactant_n") == F.col("product_n")) & (F.col("reactant_compartment") != F.col("product_compartment"))
    return rxns.select(key, F.col("id").alias("reaction")).join(ends, [key, "reaction"], "left").select(key, "reaction", F.when(F.coalesce(moved, F.lit(False)), "transport").otherwise("reaction").alias("kind"))


def protein_modifiers(refs: DataFrame, key: str = "source") -> DataFrame:
    return refs.where("role = 'modifier'").where(N.model_species_is_protein(F.col("species"), F.coalesce("species_name", F.lit("")))).select(key, "reaction", "species")


def escaped(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def documents(comps: DataFrame, spec: DataFrame, rxns: DataFrame, refs: DataFrame, key: str = "pathway_id") -> DataFrame:
    """One SBML text per model, from its tables; everything in order of ``pos``."""
    a = lambda name, c: F.concat(F.lit(f' {name}="'), escaped(F.col(c).cast("string")), F.lit('"'))
    every = lambda df, text, tag: df.withColumn("t", text).groupBy(key).agg(F.concat(F.lit(f"<{tag}>"), F.array_join(ordered("t", "pos"), ""), F.lit(f"</{tag}>")).alias(tag))
    c = every(comps, F.concat(F.lit("<compartment"), a("id", "id"), a("name", "name"), F.lit("/>")), "listOfCompartments")
    s = every(spec, F.concat(F.lit("<species"), a("id", "id"), a("name", "name"), a("compartment", "compartment"), F.lit("/>")), "listOfSpecies")
    ref = refs.withColumn("t", F.when(F.col("role") == "modifier", F.concat(F.lit("<modifierSpeciesReference"), a("species", "species"), F.lit("/>"))).otherwise(F.concat(F.lit("<speciesReference"), a("species", "species"), a("stoichiometry", "stoichiometry"), F.lit("/>"))))
    sides = ref.groupBy(key, "reaction").agg(*[F.array_join(F.array_compact(ordered(F.when(F.col("role") == r, F.col("t")), "pos")), "").alias(r) for r in ("reactant", "product", "modifier")])
    block = lambda tag, r: F.when(F.coalesce(r, F.lit("")) != "", F.concat(F.lit(f"<{tag}>"), r, F.lit(f"</{tag}>"))).otherwise("")
    full = rxns.join(sides.withColumnRenamed("reaction", "id"), [key, "id"], "left")
    r = every(full, F.concat(F.lit("<reaction"), a("id", "id"), a("name", "name"), F.lit(">"), block("listOfReactants", F.col("reactant")), block("listOfProducts", F.col("product")), block("listOfModifiers", F.col("modifier")), F.lit("</reaction>")), "listOfReactions")
    both = s.join(c, key, "full").join(r, key, "full")
    body = F.concat(*[F.coalesce(t, F.lit("")) for t in ("listOfCompartments", "listOfSpecies", "listOfReactions")])
    return both.select(key, F.concat(F.lit('<sbml level="3" version="1"><model id="m'), F.col(key).cast("string"), F.lit('">'), body, F.lit("</model></sbml>")).alias("xml"))


PATHWAY = "struct<compound:array<struct<id:long,name:string,option_hmdb:string,option_kegg:string,option_chebi:string>>>"


def harvest(texts: DataFrame, key: str = "source", xml: str = "xml") -> DataFrame:
    """Reference compounds of pathway documents whose ``option:`` prefix is bound nowhere, the first of each id."""
    mended = F.regexp_replace(xml, r"(</?)option:", "$1option_")
    rows = texts.select(key, F.from_xml(mended, PATHWAY, {"mode": "PERMISSIVE"}).alias("d")).select(key, F.inline("d.compound"))
    return first_per(rows.where("id is not null"), ["id"], key)


def inverted_index(ref: DataFrame, kind: str, columns: dict[str, str]) -> DataFrame:
    """``kind, db, ext_id, ref_id`` of a reference table's id columns."""
    stacked = ref.select("id", F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c) for c in columns.values()]))).alias("db", "ext_id"))
    return stacked.where("trim(coalesce(ext_id, '')) <> ''").select(F.lit(kind).alias("kind"), "db", F.trim("ext_id").alias("ext_id"), F.col("id").alias("ref_id"))
