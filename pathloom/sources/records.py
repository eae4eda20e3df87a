"""Catalogue records: flat files, pages and nested JSON as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.operators.tables import ordered


def snapshot(spark: SparkSession, path: str | None = None, **jdbc: str) -> DataFrame:
    """A table of the relational reference database: a Parquet snapshot, or over JDBC, where filters are pushed down."""
    return spark.read.parquet(path) if path else spark.read.format("jdbc").options(**jdbc).load()


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, partitions: int = 64, **options: str) -> DataFrame:
    """A table of the reference database read by ``partitions`` connections, each an equal share of the rows by a numeric ``key``.

    Identifiers of such databases have gaps, so equal widths would give unequal shares: the database tells the least and the
    greatest key, one pass over the keys alone finds their quantiles, and these bound the shares. Null keys go with the first.
    Filters and columns chosen later are pushed to every connection."""
    base = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    keys = base.load().select(key)
    ends = keys.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    if ends["a"] is None or ends["a"] == ends["b"]:
        return base.load()
    spread = base.options(partitionColumn=key, lowerBound=int(ends["a"]), upperBound=int(ends["b"]) + 1, numPartitions=partitions).load().select(F.col(key).cast("double").alias("k"))
    at = sorted({int(x) if float(x).is_integer() else x for x in spread.approxQuantile("k", [i / partitions for i in range(1, partitions)], 1 / (4 * partitions))} - {ends["a"]})
    if not at:
        return base.load()
    name = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    shares = [f"{name} < {at[0]} OR {name} IS NULL", *[f"{name} >= {a} AND {name} < {b}" for a, b in zip(at, at[1:])], f"{name} >= {at[-1]}"]
    return spark.read.jdbc(url, table, predicates=shares, properties=options)


def flat_file(entries: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, line_no, tag, value``: the first twelve characters of a line are its tag, blank ones continue the last."""
    lines = entries.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    own = F.nullif(F.trim(F.substring("line", 1, 12)), F.lit(""))
    w = Window.partitionBy(key).orderBy("line_no")
    tagged = lines.select(key, "line_no", F.last(own, ignorenulls=True).over(w).alias("tag"), N.canonical(F.substring("line", 13, 1 << 20)).alias("value"))
    return tagged.where("tag is not null")


def flat_entries(lines: DataFrame, key: str = "id") -> DataFrame:
    """One row per entry: names, formula, mass, pathways, classes, links to other catalogues."""
    tag = lambda t: F.array_compact(ordered(F.when(F.col("tag") == t, F.col("value")), "line_no"))
    got = lines.groupBy(key).agg(*[tag(t).alias(t) for t in ("NAME", "FORMULA", "EXACT_MASS", "PATHWAY", "CLASS", "BRITE", "DBLINKS")])
    names = N.distinct_by(F.flatten(F.transform("NAME", lambda x: F.transform(F.split(x, ";"), N.canonical))), lambda x: N.fold(N.canonical(x)))
    link = lambda db: F.get(F.filter(F.transform("DBLINKS", lambda x: F.when(F.contains(F.lower(F.substring_index(x, ":", 1)), F.lit(db)), F.substring_index(N.canonical(F.substring(x, F.instr(x, ":") + 1, F.length(x))), " ", 1))), lambda x: x.isNotNull()), F.lit(0))
    return got.select(key, F.get(names, F.lit(0)).alias("primary_name"), names.alias("synonyms"), F.get("FORMULA", F.lit(0)).alias("formula"), F.coalesce(F.get("EXACT_MASS", F.lit(0)).try_cast("double"), F.lit(0.0)).alias("mass"), F.transform("PATHWAY", lambda x: F.when(F.contains(x, F.lit(" ")), F.regexp_replace(x, r"^\S+\s+", "")).otherwise(x)).alias("pathways"), F.array_distinct(F.concat("CLASS", "BRITE")).alias("classes"), *[link(d).alias(d) for d in ("drugbank", "pubchem", "chebi", "hmdb")])


def labelled_cell(html, label: str):
    """The text of the table cell after the header of a label, without tags."""
    cell = F.regexp_extract(html, rf"(?is)<th[^>]*>\s*{label}\s*</th>\s*<td[^>]*>(.*?)</td>", 1)
    return N.canonical(F.regexp_replace(cell, "<[^>]+>", " "))


def element_text(html, tag: str):
    """The text of a page's first element of a kind, without tags."""
    return N.canonical(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", " "))


PROTEIN = (
    "primaryAccession string, proteinDescription struct<recommendedName:struct<fullName:struct<value:string>,ecNumbers:array<struct<value:string>>>,alternativeNames:array<struct<fullName:struct<value:string>>>>, "
    "genes array<struct<geneName:struct<value:string>,synonyms:array<struct<value:string>>>>, organism struct<scientificName:string,taxonId:long>, "
    "comments array<struct<commentType:string,texts:array<struct<value:string>>,reaction:struct<name:string,ecNumber:string>,subcellularLocations:array<struct<location:struct<value:string>>>>>, "
    "features array<struct<type:string,location:struct<start:struct<value:long>,`end`:struct<value:long>>>>, "
    "uniProtKBCrossReferences array<struct<database:string,id:string,properties:array<struct<key:string,value:string>>>>, keywords array<struct<name:string>>, sequence struct<length:long>"
)


def protein_records(texts: DataFrame, json: str = "json", most: int = 2000) -> DataFrame:
    """Protein records as flat rows: names, genes, organism, comments by type, features, ontology ids by aspect, enzyme numbers."""
    p = texts.select(F.from_json(json, PROTEIN).alias("p")).select("p.*")
    some = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    clean = lambda a: F.array_distinct(F.filter(F.transform(some(a), N.canonical), lambda x: x != ""))
    of = lambda kind: F.filter("comments", lambda c: F.upper(c["commentType"]) == kind)
    texts_of = lambda kind: clean(F.flatten(F.transform(of(kind), lambda c: F.coalesce(F.transform(c["texts"], lambda t: t["value"]), F.array().cast("array<string>")))))
    go = F.filter("uniProtKBCrossReferences", lambda x: (F.upper(x["database"]) == "GO") & (F.trim(x["id"]) != ""))
    term = lambda x: F.coalesce(F.get(F.filter(x["properties"], lambda q: F.upper(q["key"]).isin("GO TERM", "TERM", "GOTERM")), F.lit(0))["value"], F.lit(""))
    aspect = lambda letters: clean(F.transform(F.filter(go, lambda x: F.when(F.substring(term(x), 1, 2).isin("F:", "C:"), F.substring(term(x), 1, 1)).otherwise("P") == letters), lambda x: x["id"]))
    ec = F.concat(some(F.transform("proteinDescription.recommendedName.ecNumbers", lambda x: x["value"])), some(F.transform("comments", lambda c: F.coalesce(c["reaction"]["ecNumber"], F.lit("")))))
    numbers = F.array_distinct(F.flatten(F.transform(ec, lambda x: F.regexp_extract_all(x, F.lit(r"\d+\.\d+\.\d+\.[\d-]+"), F.lit(0)))))
    signal = F.get(F.filter("features", lambda f: F.lower(f["type"]) == "signal peptide"), F.lit(0))
    return p.select(
        F.col("primaryAccession").alias("accession"), N.canonical(F.col("proteinDescription.recommendedName.fullName.value")).alias("name"),
        clean(F.transform("proteinDescription.alternativeNames", lambda x: x["fullName"]["value"])).alias("alternative_names"),
        clean(F.flatten(F.transform("genes", lambda g: F.concat(F.array(F.coalesce(g["geneName"]["value"], F.lit(""))), some(F.transform(g["synonyms"], lambda s: s["value"])))))).alias("genes"),
        F.col("organism.scientificName").alias("organism"), F.col("organism.taxonId").alias("taxonomy_id"),
        F.substring(F.array_join(texts_of("FUNCTION"), " "), 1, most).alias("function"), texts_of("PATHWAY").alias("pathways"),
        clean(F.flatten(F.transform(of("SUBCELLULAR LOCATION"), lambda c: F.coalesce(F.transform(c["subcellularLocations"], lambda s: s["location"]["value"]), F.array().cast("array<string>"))))).alias("locations"),
        F.size(F.filter(F.coalesce("features", F.array().cast(p.schema["features"].dataType)), lambda f: F.contains(F.lower(f["type"]), F.lit("transmembrane")))).alias("transmembrane"),
        F.when(signal.isNotNull(), F.concat_ws("-", signal["location"]["start"]["value"].cast("string"), signal["location"]["end"]["value"].cast("string"))).otherwise("").alias("signal_peptide"),
        aspect("F").alias("go_function"), aspect("P").alias("go_process"), aspect("C").alias("go_component"), numbers.alias("ec_numbers"), F.col("sequence.length").alias("length"),
    )


METABOLITE = "accession string, name string, chemical_formula string, formula string, average_molecular_weight string, monisotopic_molecular_weight string, synonyms array<string>, synonyms_text string, pathways array<struct<name:string>>, biological_properties struct<cellular_locations:array<string>>, taxonomy struct<kingdom:string,class:string>, links array<string>"


def metabolite_records(texts: DataFrame, json: str = "json") -> DataFrame:
    """Metabolite records as flat rows, fields under any of their names, links by catalogue."""
    m = texts.select(F.from_json(json, METABOLITE).alias("m")).select("m.*")
    link = lambda part: F.regexp_extract(F.coalesce(F.get(F.filter("links", lambda x: F.contains(F.lower(x), F.lit(part))), F.lit(0)), F.lit("")), r"([^/=:]+)$", 1)
    both = F.coalesce(F.array_join("synonyms", ";"), F.col("synonyms_text"), F.lit(""))
    return m.select(N.hmdb_id(F.col("accession")).alias("id"), N.canonical(F.col("name")).alias("name"), F.coalesce("chemical_formula", "formula").alias("formula"), F.coalesce("monisotopic_molecular_weight", "average_molecular_weight").try_cast("double").alias("mass"), N.synonyms(both, True).alias("synonyms"), F.transform("pathways", lambda x: x["name"]).alias("pathways"), F.col("biological_properties.cellular_locations").alias("locations"), F.col("taxonomy.kingdom").alias("kingdom"), *[link(k).alias(k) for k in ("kegg", "chebi", "pubchem")])


CATALOGUE = "chebiId string, chebiAsciiName string, mass string, Synonyms array<struct<data:string>>, OntologyParents array<struct<chebiName:string,type:string>>, DatabaseLinks array<struct<data:string,type:string>>"


def catalogue_xml(texts: DataFrame, xml: str = "xml") -> DataFrame:
    """Catalogue entries in XML: the first value of each tag, synonyms, roles and other parents, the first link of each catalogue."""
    c = texts.select(F.from_xml(xml, CATALOGUE).alias("c")).select("c.*")
    parents = lambda role: F.transform(F.filter(F.coalesce("OntologyParents", F.array().cast(c.schema["OntologyParents"].dataType)), lambda p: F.contains(F.lower(p["type"]), F.lit("role")) == F.lit(role)), lambda p: p["chebiName"])
    link = lambda k: F.get(F.transform(F.filter("DatabaseLinks", lambda d: F.contains(F.lower(d["type"]), F.lit(k))), lambda d: d["data"]), F.lit(0))
    return c.select(N.chebi_id(F.col("chebiId")).alias("id"), F.col("chebiAsciiName").alias("name"), F.col("mass").try_cast("double").alias("mass"), N.distinct_by(F.transform("Synonyms", lambda s: s["data"]), lambda x: N.fold(N.canonical(x))).alias("synonyms"), parents(True).alias("roles"), parents(False).alias("parents"), *[link(k).alias(k) for k in ("kegg", "hmdb", "drugbank")])
