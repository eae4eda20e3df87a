"""Queries of XML models, catalogue records, exports and model edits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pathloom.operators import export as X
from pathloom.operators.tables import first_per
from pathloom.plans.durable import drop, durable, shared_folder, tidy
from pathloom.plans.registry import query
from pathloom.sources import model_files
from pathloom.sources import models as M
from pathloom.sources import records as R

C = F.col


def tables(t):
    """A model per customer: its orders are reactions, the parts of their lines species, places by part."""
    p = t.participants
    spec = first_per(p.select("pathway_id", C("entity").alias("id"), "process"), ["pathway_id", "id"], "process").select("pathway_id", C("process").alias("pos"), "id", F.concat(F.lit("N<"), F.substring("id", 2, 2), F.lit(">")).alias("name"), F.concat(F.lit("k"), F.right("id", F.lit(1))).alias("compartment"))
    comps = spec.select("pathway_id", C("compartment").alias("id")).distinct().withColumn("name", F.upper("id")).withColumn("pos", C("id"))
    rxns = t.processes.join(p.select("process"), "process", "left_semi").select("pathway_id", "pos", F.concat(F.lit("r"), "process").alias("id"), C("priority").alias("name"), F.lit("k1").alias("compartment"), F.lit(False).alias("reversible"))
    refs = p.select("pathway_id", F.concat(F.lit("r"), "process").alias("reaction"), "role", "pos", C("entity").alias("species"), "stoichiometry")
    mods = p.where("pos = 1").select("pathway_id", F.concat(F.lit("r"), "process").alias("reaction"), F.lit("modifier").alias("role"), "pos", C("entity").alias("species"), F.lit(1.0).alias("stoichiometry"))
    return comps, spec, rxns, refs.unionByName(mods)


def parsed(t):
    return M.parse(M.documents(*tables(t)), "pathway_id")


P4 = "(SELECT * FROM {participants} p)"
SP = f"(SELECT DISTINCT pathway_id, entity AS id, concat('N<', substr(entity, 2, 2), '>') AS name, concat('k', right(entity, 1)) AS compartment FROM {P4} q)"
query("A03_model_species", f"SELECT * FROM {SP} s")(lambda t: M.species(parsed(t), "pathway_id").drop("pos"))


def reread(t):
    """The models written as files, one each, and read back; a file's name is its model's key."""
    folder = f"{shared_folder(t.spark)}/models-{uuid.uuid4().hex}"
    texts = durable(M.documents(*tables(t)))
    tidy(t.spark)  # what making the texts left on the disk goes before the files come
    model_files.write(texts, folder)
    drop(texts)
    files = model_files.read(t.spark, folder)
    return M.parse(files.select(F.regexp_extract("source", r"([^/]+)\.xml$", 1).cast("long").alias("pathway_id"), "xml"), "pathway_id")


query("A09_model_files", f"SELECT * FROM {SP} s")(lambda t: M.species(reread(t), "pathway_id").drop("pos"))
query("A03_model_references", f"SELECT pathway_id, concat('r', process) AS reaction, role, entity AS species, stoichiometry, concat('N<', substr(entity, 2, 2), '>') AS species_name FROM {P4} q UNION ALL SELECT pathway_id, concat('r', process), 'modifier', entity, 1.0, concat('N<', substr(entity, 2, 2), '>') FROM {P4} q WHERE pos = 1")(lambda t: M.references(parsed(t), "pathway_id").drop("pos"))
query("A03_model_failures", "SELECT o_custkey AS pathway_id FROM orders WHERE o_custkey % 40 = 4 AND o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")(lambda t: M.failures(M.parse(M.documents(*tables(t)).withColumn("xml", F.when(C("pathway_id") % 40 == 4, F.substring("xml", 1, 60)).otherwise(C("xml"))), "pathway_id"), "pathway_id"))
query("C21_classified_reactions", f"""SELECT pathway_id, concat('r', process) AS reaction, CASE WHEN count(*) FILTER (role = 'reactant') = 1 AND count(*) FILTER (role = 'product') = 1 AND max(substr(entity, 2, 2)) FILTER (role = 'reactant') = max(substr(entity, 2, 2)) FILTER (role = 'product') AND max(right(entity, 1)) FILTER (role = 'reactant') <> max(right(entity, 1)) FILTER (role = 'product') THEN 'transport' ELSE 'reaction' END AS kind FROM {P4} q GROUP BY 1, 2""")(
    lambda t: (lambda m: M.classified(M.reactions(m, "pathway_id"), M.references(m, "pathway_id", named=False), M.species(m, "pathway_id"), "pathway_id"))(parsed(t))
)
query("C21_protein_modifiers", "SELECT s_nationkey AS pathway_id, s_suppkey AS reaction, concat('P_', s_suppkey) AS species FROM supplier WHERE s_suppkey % 2 = 0")(lambda t: M.protein_modifiers(t.proteins.select("pathway_id", C("id").alias("reaction"), F.lit("modifier").alias("role"), F.concat(F.when(C("id") % 2 == 0, "P_").otherwise("x"), "id").alias("species"), C("name").alias("species_name")), "pathway_id"))


def pathways(t):
    return t.part.groupBy(C("p_size").alias("source")).agg(F.concat(F.lit("<pathway>"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<compound><id>"), (C("p_partkey") / 2).cast("long"), F.lit("</id><name>"), "p_name", F.lit("</name><option:hmdb>H"), "p_partkey", F.lit("</option:hmdb><option:kegg>"), F.when(C("p_partkey") % 3 == 0, "").otherwise(C("p_brand")), F.lit("</option:kegg></compound>")))), ""), F.lit("</pathway>")).alias("xml"))


query("A04_harvest", "SELECT p_partkey // 2 AS id, min(p_size) AS source FROM part GROUP BY 1")(lambda t: M.harvest(pathways(t)).select("id", "source"))
query("A04_inverted_index", "SELECT 'compound' AS kind, db, ext AS ext_id, p_partkey AS ref_id FROM (SELECT p_partkey, unnest(['hmdb', 'kegg']) AS db, unnest([concat('H', p_partkey), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END]) AS ext FROM part) WHERE ext <> ''")(
    lambda t: M.inverted_index(t.part.select(C("p_partkey").alias("id"), F.concat(F.lit("H"), "p_partkey").alias("h"), F.when(C("p_partkey") % 3 == 0, " ").otherwise(C("p_brand")).alias("k")), "compound", {"hmdb": "h", "kegg": "k"})
)
query("A05_reference_snapshot", "SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) = 'red widget'")(lambda t: R.snapshot(t.spark, f"{t.sf_dir}/part.parquet").where("lower(p_name) = 'red widget'").select(C("p_partkey").alias("id"), C("p_name").alias("name")))


def flat(t):
    line = lambda tag, v: F.concat(F.rpad(F.lit(tag), 12, " "), v)
    return t.part.select(C("p_partkey").alias("id"), F.concat_ws("\n", line("ENTRY", F.lit("C1")), line("NAME", F.concat("p_name", F.lit(";"))), line("", F.concat(F.lit(" "), "p_brand")), line("FORMULA", F.lit("C6H12")), F.when(C("p_partkey") % 2 == 0, line("EXACT_MASS", C("p_retailprice").cast("string"))), line("PATHWAY", F.concat(F.lit("map0001  "), "p_type")), line("DBLINKS", F.lit("PubChem: 12 x")), line("", F.concat(F.lit("ChEBI: "), "p_partkey"))).alias("text"))


query("A06_flat_file_entries", "SELECT p_partkey AS id, p_name AS primary_name, concat(p_name, '|', p_brand) AS synonyms, 'C6H12' AS formula, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE 0 END AS mass, p_type AS pathways, '12' AS pubchem, CAST(p_partkey AS VARCHAR) AS chebi FROM part")(
    lambda t: R.flat_entries(R.flat_file(flat(t))).select("id", "primary_name", F.array_join("synonyms", "|").alias("synonyms"), "formula", "mass", F.array_join("pathways", "|").alias("pathways"), "pubchem", "chebi")
)
query("A07_labelled_cells", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS title, concat('v ', page_id) AS cell FROM pages")(
    lambda t: t.pages.select("page_id", R.element_text(C("html"), "title").alias("title"), R.labelled_cell(F.concat("html", F.lit("<table><tr><th class='a'> Mass </th>\n<td><b>v</b>"), "page_id", F.lit("</td></tr></table>")), "Mass").alias("cell"))
)


def proteins_json(t):
    s = F.col("s_name")
    return t.supplier.select(F.format_string('{"primaryAccession":"P%05d","proteinDescription":{"recommendedName":{"fullName":{"value":"%s"},"ecNumbers":[{"value":"EC 1.2.3.%d"}]},"alternativeNames":[{"fullName":{"value":"alt"}},{"fullName":{"value":"alt"}}]},"genes":[{"geneName":{"value":"G%d"},"synonyms":[{"value":"GS"}]}],"organism":{"scientificName":"Homo sapiens","taxonId":9606},"comments":[{"commentType":"FUNCTION","texts":[{"value":"does %d"}]},{"commentType":"SUBCELLULAR LOCATION","subcellularLocations":[{"location":{"value":"Nucleus"}}]}],"features":[{"type":"Transmembrane"},{"type":"Signal peptide","location":{"start":{"value":1},"end":{"value":%d}}}],"uniProtKBCrossReferences":[{"database":"GO","id":"GO:%d","properties":[{"key":"GoTerm","value":"%s:x"}]},{"database":"PDB","id":"1"}],"sequence":{"length":%d}}', C("s_suppkey"), s, C("s_suppkey"), C("s_suppkey"), C("s_suppkey"), C("s_suppkey"), C("s_suppkey"), F.when(C("s_suppkey") % 3 == 0, "F").when(C("s_suppkey") % 3 == 1, "P").otherwise("C"), C("s_suppkey")).alias("json"))


query("A14_protein_records", "SELECT concat('P', lpad(CAST(s_suppkey AS VARCHAR), 5, '0')) AS accession, s_name AS name, 'alt' AS alternative_names, concat('G', s_suppkey, '|GS') AS genes, concat('does ', s_suppkey) AS function, 'Nucleus' AS locations, 1 AS transmembrane, concat('1-', s_suppkey) AS signal_peptide, s_suppkey AS length FROM supplier")(
    lambda t: R.protein_records(proteins_json(t)).select("accession", "name", F.array_join("alternative_names", "|").alias("alternative_names"), F.array_join("genes", "|").alias("genes"), "function", F.array_join("locations", "|").alias("locations"), "transmembrane", "signal_peptide", "length")
)
query("S22_ontology_and_enzyme_ids", "SELECT concat('P', lpad(CAST(s_suppkey AS VARCHAR), 5, '0')) AS accession, CASE WHEN s_suppkey % 3 = 0 THEN concat('GO:', s_suppkey) ELSE '' END AS go_function, CASE WHEN s_suppkey % 3 = 1 THEN concat('GO:', s_suppkey) ELSE '' END AS go_process, CASE WHEN s_suppkey % 3 = 2 THEN concat('GO:', s_suppkey) ELSE '' END AS go_component, concat('1.2.3.', s_suppkey) AS ec_numbers FROM supplier")(
    lambda t: R.protein_records(proteins_json(t)).select("accession", *[F.array_join(c, "|").alias(c) for c in ("go_function", "go_process", "go_component", "ec_numbers")])
)
query("A15_metabolite_records", "SELECT concat('HMDB', lpad(CAST(p_partkey AS VARCHAR), 7, '0')) AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'CH4' ELSE 'CO2' END AS formula, p_retailprice AS mass, concat(p_brand, '|', p_type) AS synonyms, concat('C', p_partkey) AS kegg FROM part")(
    lambda t: R.metabolite_records(t.part.select(F.concat(F.lit('{"accession":"'), "p_partkey", F.lit('","name":" '), "p_name", F.when(C("p_partkey") % 2 == 0, '","formula":"CH4"').otherwise('","chemical_formula":"CO2"'), F.lit(',"average_molecular_weight":"'), "p_retailprice", F.lit('","synonyms_text":"'), "p_brand", F.lit(", "), "p_type", F.lit('","links":["http://x/kegg/entry/C'), "p_partkey", F.lit('"]}')).alias("json"))).select("id", "name", "formula", "mass", F.array_join("synonyms", "|").alias("synonyms"), "kegg")
)
query("A16_catalogue_xml", "SELECT concat('CHEBI:', p_partkey) AS id, p_name AS name, p_retailprice AS mass, concat(p_brand, '|', p_type) AS synonyms, 'acid' AS roles, 'sugar' AS parents, concat('C', p_partkey) AS kegg FROM part")(
    lambda t: R.catalogue_xml(t.part.select(F.concat(F.lit("<return><chebiId>CHEBI:"), "p_partkey", F.lit("</chebiId><chebiAsciiName>"), "p_name", F.lit("</chebiAsciiName><mass>"), "p_retailprice", F.lit("</mass><Synonyms><data>"), "p_brand", F.lit("</data></Synonyms><Synonyms><data>"), "p_type", F.lit("</data></Synonyms><OntologyParents><chebiName>acid</chebiName><type>has role</type></OntologyParents><OntologyParents><chebiName>sugar</chebiName><type>is a</type></OntologyParents><DatabaseLinks><data>C"), "p_partkey", F.lit("</data><type>KEGG COMPOUND accession</type></DatabaseLinks></return>")).alias("xml"))).select("id", "name", "mass", F.array_join("synonyms", "|").alias("synonyms"), F.array_join("roles", "|").alias("roles"), F.array_join("parents", "|").alias("parents"), "kegg")
)


def export(t):
    ents = t.compounds.where("pos % 2 = 0").select("pathway_id", "pos", "name")
    part = t.compounds.select("pathway_id", C("pos").alias("process"), F.when(C("pos") % 3 == 0, "product").otherwise("reactant").alias("role"), F.upper("name").alias("entity"))
    return X.model_tables(ents, part, t.compounds.where("pos % 5 = 0").select("pathway_id", C("name").alias("entity"), C("brand").alias("place")))


_PL = "(SELECT n.pathway_id, n.name, coalesce(min(brand) FILTER (c.pos % 5 = 0), 'cell') AS place FROM (SELECT DISTINCT pathway_id, name FROM {compounds} c) n JOIN {compounds} c USING (pathway_id, name) GROUP BY 1, 2)"
query("A10_export_compartments", f"SELECT pathway_id, concat('c', row_number() OVER (PARTITION BY pathway_id ORDER BY place)) AS id, place AS name FROM (SELECT DISTINCT pathway_id, place FROM {_PL} p)")(lambda t: export(t)[0])
query("A10_export_species", f"SELECT p.pathway_id, lower(name) AS name, place FROM {_PL} p")(lambda t: (lambda c, s, r: s.join(c.select("pathway_id", C("id").alias("compartment"), C("name").alias("place")), ["pathway_id", "compartment"]).select("pathway_id", F.lower("name").alias("name"), "place"))(*export(t)))
query("A10_export_references", "SELECT pathway_id, pos AS process, CASE WHEN pos % 3 = 0 THEN 'product' ELSE 'reactant' END AS role, name FROM {compounds} c")(lambda t: (lambda c, s, r: r.join(s.select("pathway_id", C("id").alias("species"), "name"), ["pathway_id", "species"]).select("pathway_id", "process", "role", F.lower("name").alias("name")))(*export(t)))
query("A11_resolved_elements", "SELECT pathway_id, process, CASE WHEN role = 'product' THEN 'right' ELSE 'left' END AS side, CAST(substr(entity, 2) AS BIGINT) AS ref_id, CASE WHEN process % 3 = 0 THEN 'known' ELSE 'first' END AS state FROM {participants} p WHERE CAST(substr(entity, 2) AS BIGINT) % 2 = 0")(
    lambda t: (lambda p: X.resolved_elements(p.withColumn("state", F.when(C("process") % 3 == 0, "known").otherwise("lost")), p.where("cast(substr(entity, 2) as bigint) % 2 = 0").select("pathway_id", C("entity").alias("name"), F.substring("entity", 2, 20).cast("long").alias("ref_id")).distinct(), p.select("pathway_id").distinct().select("pathway_id", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("first").alias("name")), F.struct(F.lit(1).alias("pos"), F.lit("known").alias("name")))).alias("x")).select("pathway_id", "x.*")))(t.participants)
)
query("E02_allocated_ids", "SELECT o_custkey AS pathway_id, o_orderkey AS process, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE 100 + count(*) FILTER (o_orderkey % 3 > 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 END AS id FROM orders")(
    lambda t: X.allocated(t.processes.select("pathway_id", "process", F.when(C("process") % 3 == 0, C("process")).alias("given")), ["pathway_id"], "given", ["process"], 100).drop("given")
)
query("E02_unique_ids", "SELECT o_custkey AS pathway_id, o_orderkey AS process, concat('_', regexp_replace(o_orderpriority, '[^A-Za-z0-9_]', '_', 'g'), CASE WHEN r > 1 THEN concat('_', r) ELSE '' END) AS sid FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders)")(
    lambda t: X.unique_ids(t.processes, ["pathway_id"], "priority", ["process"]).select("pathway_id", "process", "sid")
)
query("E05_grid", "SELECT p_size AS pathway_id, p_partkey AS pos, (r % 5) * 160 AS x, (r // 5) * 120 AS y FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS r FROM part)")(lambda t: X.grid(t.compounds.select("pathway_id", "pos"), ["pathway_id"], ["pos"]))


def small_refs(t):
    """Reactions over few species, so that many are alike."""
    p = t.participants.select("pathway_id", C("process").alias("reaction"), "role", "pos", F.right("entity", F.lit(1)).alias("species"), F.lit(1.0).alias("stoichiometry"))
    r = t.processes.select("pathway_id", "pos", C("process").alias("id"), C("status").alias("compartment"), F.lit(False).alias("reversible"))
    return p, r


_SIG = "(SELECT x.pathway_id, x.process AS id, status, coalesce(a, '') AS a, coalesce(b, '') AS b FROM {processes} x LEFT JOIN (SELECT process, string_agg(right(entity, 1), ',' ORDER BY right(entity, 1)) FILTER (role = 'reactant') AS a, string_agg(right(entity, 1), ',' ORDER BY right(entity, 1)) FILTER (role = 'product') AS b FROM {participants} p GROUP BY 1) s ON s.process = x.process)"
query("D06_duplicate_reactions", f"SELECT pathway_id, keep, id AS \"drop\" FROM (SELECT *, min(id) OVER (PARTITION BY pathway_id, status, a, b) AS keep FROM {_SIG} s) WHERE id <> keep")(lambda t: (lambda p, r: X.duplicate_reactions(X.reaction_signatures(p, r)))(*small_refs(t)))
query("C24_element_keys", "SELECT pathway_id, process AS reaction, concat(coalesce(string_agg(e, ',' ORDER BY e) FILTER (role = 'reactant'), ''), '→', coalesce(string_agg(e, ',' ORDER BY e) FILTER (role = 'product'), '')) AS elements FROM (SELECT *, substr(entity, 2) AS e FROM {participants} p) GROUP BY 1, 2")(lambda t: X.element_keys(t.participants.select("pathway_id", C("process").alias("reaction"), "role", F.substring("entity", 2, 20).cast("long").alias("species"))))
query("C25_complexes_by_accession", "SELECT concat('P', l_suppkey) AS accession, string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), '|' ORDER BY CAST(l_orderkey AS VARCHAR)) AS complexes FROM lineitem GROUP BY 1")(
    lambda t: X.complexes_by_accession(t.lineitem.select(C("l_orderkey").cast("string").alias("complex"), C("l_suppkey").alias("protein")), t.supplier.select(C("s_suppkey").alias("protein"), F.concat(F.lit("P"), "s_suppkey").alias("accession"))).withColumn("complexes", F.array_join("complexes", "|"))
)


def metrics(t):
    comps, spec, rxns, refs = tables(t)
    few = refs.where("pos > 1")
    return X.model_metrics(spec, rxns, comps, few, X.duplicate_reactions(X.reaction_signatures(*small_refs(t))))


query("D07_model_metrics", f"""WITH d AS (SELECT pathway_id, count(*) AS duplicates FROM (SELECT *, min(id) OVER (PARTITION BY pathway_id, status, a, b) AS keep FROM {_SIG} s) WHERE id <> keep GROUP BY 1), s AS (SELECT * FROM {SP} s),
    i AS (SELECT pathway_id, count(*) AS isolated FROM s WHERE (pathway_id, id) NOT IN (SELECT pathway_id, entity FROM {P4} q WHERE pos > 1) GROUP BY 1)
    SELECT s.pathway_id, count(*) AS species, (SELECT count(DISTINCT process) FROM {P4} q WHERE q.pathway_id = s.pathway_id) AS reactions, count(DISTINCT compartment) AS compartments, coalesce(any_value(isolated), 0) AS isolated, coalesce(any_value(duplicates), 0) AS duplicates FROM s LEFT JOIN i USING (pathway_id) LEFT JOIN d USING (pathway_id) GROUP BY 1""")(metrics)


def used_places(t):
    comps, spec, rxns, _ = tables(t)
    return X.compartment_usage(comps.drop("pos"), spec, rxns.limit(0)), spec


query("D14_compartment_usage", f"SELECT pathway_id, compartment AS id, upper(compartment) AS name, count(*) AS uses FROM {SP} s GROUP BY 1, 2")(lambda t: used_places(t)[0])
query("D14_merged_compartments", f"""WITH u AS (SELECT pathway_id, compartment AS id, count(*) AS uses FROM {SP} s GROUP BY 1, 2), b AS (SELECT pathway_id, arg_min(id, (-uses, id)) AS k FROM u WHERE id IN ('k1', 'k2', 'k3') GROUP BY 1) SELECT u.pathway_id, u.id FROM u LEFT JOIN b USING (pathway_id) WHERE u.id NOT IN ('k1', 'k2', 'k3') OR u.id = k""")(
    lambda t: X.merge_compartments(*used_places(t), F.when(C("id").isin("k1", "k2", "k3"), "blood"))[0].select("pathway_id", "id")
)
query("C23_strip_unmapped", f"""WITH s AS (SELECT pathway_id, id, compartment = 'k3' AS c, id LIKE '%1_' AS n FROM {SP} s), bs AS (SELECT * FROM s WHERE c OR n), r AS (SELECT DISTINCT q.pathway_id, q.process FROM {P4} q JOIN bs ON bs.pathway_id = q.pathway_id AND bs.id = q.entity)
    SELECT DISTINCT pathway_id, 'compartment' AS what, compartment AS id, 'no_id' AS reason FROM {SP} z WHERE compartment = 'k3' UNION ALL SELECT pathway_id, 'species', id, CASE WHEN c AND n THEN 'no_id+compartment_removed' WHEN c THEN 'compartment_removed' ELSE 'no_id' END FROM bs
    UNION ALL SELECT DISTINCT q.pathway_id, 'reaction', concat('r', q.process), CASE WHEN q.process % 5 = 0 AND r.process IS NOT NULL THEN 'no_id+references_removed_species' WHEN r.process IS NOT NULL THEN 'references_removed_species' ELSE 'no_id' END FROM {P4} q LEFT JOIN r ON r.process = q.process WHERE q.process % 5 = 0 OR r.process IS NOT NULL""")(
    lambda t: (lambda c, s, r, f: X.strip_unmapped(c.withColumn("ref_id", F.when(C("id") != "k3", 1)), s.withColumn("ref_id", F.when(~C("id").like("%1_"), 1)), r.withColumn("ref_id", F.when(C("pos") % 5 > 0, 1)), f))(*tables(t))
)


def items(t):
    base = t.part.select(F.concat(F.lit("m"), C("p_partkey") % 3).alias("sample"), C("p_type").alias("section"), C("p_partkey").alias("item"), F.explode(F.map_from_arrays(F.array(F.lit("id"), F.lit("name"), F.lit("size")), F.array(C("p_partkey").cast("string"), "p_name", F.when(C("p_partkey") % 4 > 0, C("p_size").cast("string")))))).withColumnRenamed("key", "field")
    return base.where("value is not null").withColumn("place", F.when(C("field") == "id", 0).when(C("field") == "name", 1).otherwise(2))


_IT = "(SELECT concat('m', p_partkey % 3) AS sample, p_type AS section, p_partkey AS item, field, value FROM (SELECT *, unnest(['id', 'name', 'size']) AS field, unnest([CAST(p_partkey AS VARCHAR), p_name, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS VARCHAR) END]) AS value FROM part) WHERE value IS NOT NULL)"
query("D16_structure_profile", f"""WITH i AS (SELECT * FROM {_IT} z), f AS (SELECT *, row_number() OVER (PARTITION BY sample, section ORDER BY item) AS rn FROM (SELECT DISTINCT sample, section, item FROM i)), s AS (SELECT i.* FROM i JOIN f USING (sample, section, item) WHERE rn <= 3)
    SELECT section, field, count(*) AS seen, CASE field WHEN 'id' THEN 0 WHEN 'name' THEN 1 ELSE 2 END AS place, CASE WHEN field = 'name' THEN 'text' ELSE 'integer' END AS type, count(*) = (SELECT count(*) FROM f WHERE f.section = s.section AND rn <= 3) AS required FROM s GROUP BY section, field""")(lambda t: X.structure_profile(items(t)))
query("D16_structure_issues", f"SELECT section, item, 'name' AS field, 'missing_field' AS problem FROM (SELECT DISTINCT section, item FROM {_IT} z) WHERE item % 10 = 0 UNION ALL SELECT section, item, 'id', 'wrong_type' FROM (SELECT DISTINCT section, item FROM {_IT} z) WHERE item % 10 = 5")(
    lambda t: X.structure_issues(X.structure_profile(items(t).where("field <> 'size'")), items(t).where("not (item % 10 = 0 and field = 'name')").withColumn("value", F.when((C("item") % 10 == 5) & (C("field") == "id"), "x").otherwise(C("value"))).where("field <> 'size'"))
)
query("D17_geometry_counts", "SELECT user_id, count(*) FILTER (k = 0) AS compound, count(*) FILTER (k = 1) AS protein, count(*) FILTER (k = 2) AS edge, count(*) FILTER (k = 3) AS membrane FROM (SELECT user_id, event_id % 4 AS k FROM events WHERE event_id % 7 > 0) GROUP BY 1")(
    lambda t: X.geometry_counts(t.events.select("user_id", F.element_at(F.array(*map(F.lit, ["compound", "protein", "edge", "membrane"])), (C("event_id") % 4 + 1).cast("int")).alias("kind"), (C("event_id") % 7 == 0).alias("hidden")), ["user_id"])
)
query("D20_model_scan", "SELECT p_size AS pathway_id, 'warning' AS severity, 'unmapped_share' AS code FROM part GROUP BY 1 HAVING avg(CASE WHEN p_brand < 'Brand#2' THEN 1.0 ELSE 0 END) > 0.45 UNION ALL SELECT s_suppkey, 'warning', 'identical_sides' FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'error', 'bad' FROM supplier WHERE s_suppkey % 4 >= 2")(
    lambda t: X.model_scan(t.part.select(C("p_size").alias("pathway_id"), F.when(C("p_brand") >= "Brand#2", 1).alias("ref_id")), t.supplier.select(C("s_suppkey").alias("pathway_id"), F.array(F.lit("a")).alias("inputs"), F.array(F.when(C("s_suppkey") % 2 == 0, "A").otherwise("b")).alias("outputs")), t.supplier.select(C("s_suppkey").alias("pathway_id"), (C("s_suppkey") % 4).alias("severity"), F.lit("bad").alias("code")))
)


def edits(t):
    comps, spec, _, refs = tables(t)
    e = spec.select("pathway_id", C("pos").alias("seq"), F.when(C("pos") % 4 == 0, "delete_species").when(C("pos") % 4 == 1, "rename_species").when(C("pos") % 4 == 2, "move_species_compartment").otherwise("explode").alias("op"), C("id").alias("target"), F.when(C("pos") % 4 == 1, "new").when(C("pos") % 4 == 2, "k99").alias("value"))
    return X.apply_edits(spec.drop("pos"), comps.drop("pos"), refs.where("pos > 1"), e)


_ED = f"(SELECT s.*, (SELECT min(process) FROM {P4} q WHERE q.pathway_id = s.pathway_id AND q.entity = s.id) AS f, (s.pathway_id, s.id) IN (SELECT pathway_id, entity FROM {P4} q WHERE pos > 1) AS busy FROM {SP} s)"
query("P04_edited_species", f"SELECT pathway_id, id, CASE WHEN f % 4 = 1 THEN 'new' ELSE name END AS name, compartment FROM {_ED} e WHERE f % 4 > 0 OR busy")(lambda t: edits(t)[0])
query("P04_refused_edits", f"SELECT pathway_id, id AS target, CASE f % 4 WHEN 0 THEN 'species_in_use' WHEN 2 THEN 'no_such_compartment' ELSE 'unsupported' END AS why FROM {_ED} e WHERE f % 4 IN (2, 3) OR (f % 4 = 0 AND busy)")(lambda t: edits(t)[2].select("pathway_id", "target", "why"))
query("P05_clean_model", f"SELECT pathway_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY pathway_id, status, a, b ORDER BY id) AS r FROM {_SIG} s) WHERE r = 1 GROUP BY 1")(
    lambda t: (lambda p, r: X.clean_model(p.select("pathway_id", C("species").alias("id"), F.lit("k").alias("compartment")).distinct(), p.select("pathway_id", F.lit("k").alias("id")).distinct(), r, p)[2].groupBy("pathway_id").agg(F.count("*").alias("n")))(*small_refs(t))
)
