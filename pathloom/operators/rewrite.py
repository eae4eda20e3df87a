"""Rewrites of composite and misplaced names. A composite ``left + right`` with a protein on the left is a complex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.operators.linking import containing
from pathloom.operators.tables import first_per, numbered


def decide_composites(used: DataFrame, proteins: DataFrame) -> DataFrame:
    """Each composite (``pathway_id, process, role, pos, entity, evidence``) with its parts and what becomes of it:
    ``complex``, ``split`` (an output without evidence, or with a by-product that the text doesn't spell out as a
    composite), or ``error`` (no protein on the left)."""
    c = used.where(N.has_plus(F.col("entity"))).withColumn("parts", N.composite_parts(F.col("entity"), False)).where(F.size("parts") >= 2)
    known = proteins.select("pathway_id", N.norm(F.col("name")).alias("_n")).distinct().withColumn("_k", F.lit(True))
    got = c.withColumn("left", F.get("parts", F.lit(0))).withColumn("right", F.array_join(F.slice("parts", 2, F.size("parts")), ":")).withColumn("_n", N.norm(F.col("left"))).join(known, ["pathway_id", "_n"], "left")
    told = got.withColumn("_b", N.bound_evidence(F.col("left"), F.get("parts", F.lit(1)), F.coalesce("evidence", F.lit(""))))
    protein = F.coalesce("_k", F.lit(False)) | N.looks_like_protein(F.col("left"))
    supported = F.col("_b.exact") | (F.col("_b.phrase") & ~N.is_byproduct(F.get("parts", F.lit(1))))
    fate = F.when(~protein, "error").when((F.col("role") == "product") & ~supported, "split").otherwise("complex")
    return told.withColumn("fate", fate).withColumn("complex", F.concat_ws(":", "left", "right")).drop("_n", "_k", "_b")


def apply_composites(used: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``used`` without composites, the complexes made (``pathway_id, name, components``), and the issues."""
    plain = used.join(decided.select("pathway_id", "process", "role", "pos", "entity"), ["pathway_id", "process", "role", "pos", "entity"], "left_anti").withColumn("sub", F.lit(0))
    new = decided.where("fate <> 'error'").select("pathway_id", "process", "role", "pos", "evidence", F.posexplode(F.when(F.col("fate") == "complex", F.array("complex")).otherwise(F.col("parts"))).alias("sub", "entity"))
    out = plain.unionByName(new.select(*plain.columns))
    made = complexes(decided.where("fate = 'complex'").select("pathway_id", F.col("complex").alias("name")))
    errors = decided.where("fate = 'error'").select("pathway_id", F.lit("error").alias("severity"), F.lit("composite_without_protein").alias("rule"), F.col("entity").alias("subject"))
    return out, made, errors


def complexes(names: DataFrame) -> DataFrame:
    """A registry row for each complex named: its components, the first of them a protein."""
    one = first_per(names.select("pathway_id", N.norm_with_colon(F.col("name")).alias("_n"), "name"), ["pathway_id", "_n"], "name")
    return one.select("pathway_id", "name", N.complex_parts(F.col("name")).alias("components"))


def bind_scaffolds(outputs: DataFrame, scaffolds: DataFrame, proteins: DataFrame | None = None) -> DataFrame:
    """For each scaffold among a reaction's outputs (``pathway_id, process, pos, entity, evidence``) the other output that the
    text binds to it best: as a composite (2) or in words (1), which isn't enough for a by-product. Scaffolds choose in
    order, each among the products that those before have left. Complexes and proteins are no products."""
    o = outputs.where(~F.contains("entity", F.lit(":"))).withColumn("_n", N.norm(F.col("entity")))
    sc = scaffolds.select("pathway_id", F.col("norm").alias("_n")).distinct()
    s = o.join(sc, ["pathway_id", "_n"], "left_semi").select("pathway_id", "process", F.col("pos").alias("s_pos"), F.col("entity").alias("scaffold"), "evidence")
    free = o.join(sc, ["pathway_id", "_n"], "left_anti").where(~N.looks_like_protein(F.col("entity")))
    if proteins is not None:
        free = free.join(proteins.select("pathway_id", N.norm(F.col("name")).alias("_n")), ["pathway_id", "_n"], "left_anti")
    b = s.join(free.select("pathway_id", "process", "pos", "entity", "_n"), ["pathway_id", "process"])
    told = b.withColumn("_b", N.bound_evidence(F.col("scaffold"), F.col("entity"), F.coalesce("evidence", F.lit(""))))
    scored = told.withColumn("score", F.when(F.col("_b.exact"), 2).when(F.col("_b.phrase") & ~N.is_byproduct(F.col("entity")), 1)).where("score is not null")
    wish = F.struct("s_pos", (-F.col("score")).alias("less"), "pos", "scaffold", "entity", "_n")
    wishes = scored.groupBy("pathway_id", "process").agg(F.array_sort(F.collect_list(wish)).alias("w"))
    # one reaction's wishes in order: a scaffold takes its first that is still there
    got = wishes.select("pathway_id", "process", F.inline(F.aggregate("w", F.slice("w", 1, 0), lambda done, x: F.when(F.exists(done, lambda y: (y["s_pos"] == x["s_pos"]) | (y["_n"] == x["_n"])), done).otherwise(F.concat(done, F.array(x))))))
    return got.select("pathway_id", "process", "pos", "s_pos", "scaffold", "entity", (-F.col("less")).alias("score"), F.concat_ws(":", "scaffold", "entity").alias("complex"))


def apply_scaffolds(used: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``used`` with the complexes of :func:`bind_scaffolds` in place of their scaffolds and products, and the complexes made."""
    gone = bound.select("pathway_id", "process", F.explode(F.array("scaffold", "entity")).alias("e")).select("pathway_id", "process", F.lit("product").alias("role"), N.norm(F.col("e")).alias("_n")).distinct()
    kept = used.withColumn("_n", N.norm(F.col("entity"))).join(gone, ["pathway_id", "process", "role", "_n"], "left_anti").select(*used.columns)
    pos = F.col("s_pos").cast(used.schema["pos"].dataType).alias("pos")
    told = bound.select("pathway_id", "process", F.lit("product").alias("role"), pos, F.col("complex").alias("entity"))
    rest = [c for c in used.columns if c not in told.columns]
    for c in rest:
        told = told.withColumn(c, F.lit(None).cast(used.schema[c].dataType))
    return kept.unionByName(told), complexes(bound.select("pathway_id", F.col("complex").alias("name")))


def remove_complexes(used: DataFrame, unwanted: DataFrame) -> DataFrame:
    """``used`` without the complexes (``pathway_id, name``): outputs and cargo keep what is bound, inputs all parts."""
    u = unwanted.select("pathway_id", N.norm_with_colon(F.col("name")).alias("_n")).distinct().withColumn("_u", F.lit(True))
    got = used.withColumn("_n", N.norm_with_colon(F.col("entity"))).join(u, ["pathway_id", "_n"], "left")
    parts = N.complex_parts(F.col("entity"))
    to = F.when(F.col("_u").isNull() | (F.size(parts) < 2), F.array("entity")).when(F.col("role").isin("product", "cargo"), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    return got.withColumn("entity", F.explode(to)).drop("_n", "_u")


def byproduct_complexes(complexes_: DataFrame, evidence: DataFrame) -> DataFrame:
    """Complexes whose bound part is a by-product and that no text (``pathway_id, evidence``) spells out as a composite. Composites
    are looked up in the texts without blanks around ``+``, as no other text can spell them out; what is found is checked."""
    c = complexes_.withColumn("parts", N.complex_parts(F.col("name"))).where((F.size("parts") >= 2) & N.is_byproduct(F.get("parts", F.lit(1))))
    tight = lambda x: F.translate(F.regexp_replace(N.canonical(x), r"\s*\+\s*", "+"), "Σ", "σ")
    wanted = c.select("pathway_id", "name", "parts", F.lower(tight(F.concat_ws("+", F.get("parts", F.lit(0)), F.get("parts", F.lit(1))))).alias("term")).distinct()
    texts = evidence.select("pathway_id", F.col("evidence").alias("id"), tight(F.col("evidence")).alias("text")).distinct()
    found = containing(wanted.select("pathway_id", "term"), texts, ("pathway_id",)).join(wanted, ["pathway_id", "term"])
    told = found.where(N.bound_evidence(F.get("parts", F.lit(0)), F.get("parts", F.lit(1)), F.col("id"))["exact"]).select("pathway_id", "name").distinct()
    return c.select("pathway_id", "name").join(told, ["pathway_id", "name"], "left_anti")
