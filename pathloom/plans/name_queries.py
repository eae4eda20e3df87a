"""Queries of the name functions and predicates, over names made from parts and texts of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.functions import vocab
from pathloom.plans.registry import query

C = F.col


def can(x):
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def nrm(x):
    return f"regexp_replace(lower({can(x)}), '[^a-z0-9 ]+', '', 'g')"


def sql_list(xs):
    return "(" + ", ".join("'" + x + "'" for x in xs) + ")"


def scalar(key, expr, sql, source="names", ident="id"):
    query(key, f"SELECT {ident}, {sql} AS value FROM {{{source}}} t")(lambda t: getattr(t, source).select(ident, expr().alias("value")))


def joined(a):
    return F.array_join(a, "|")


name = "name"
scalar("S01_canonical", lambda: N.canonical(name), can("name"))
scalar("S02_norm_with_colon", lambda: N.norm_with_colon(F.concat(name, F.lit(":"), C("p_type"))), f"regexp_replace(lower({can('concat(name, chr(58), p_type)')}), '[^a-z0-9: ]+', '', 'g')")
scalar("S03_norm", lambda: N.norm(name), nrm("name"))
scalar("S04_graph_id", lambda: N.graph_id(name), f"lower({can('name')})")
scalar("S05_squeezed_label", lambda: N.squeezed(name), "regexp_replace(lower(name), '[^a-z0-9]', '', 'g')")
scalar("S06_plain_dashes", lambda: N.plain(F.concat(name, F.lit(" – "), C("p_type"))), can("concat(name, ' - ', p_type)"))

_tok = lambda x: f"list_distinct(list_filter(string_split({nrm(x)}, ' '), lambda y: y <> ''))"


def _jac(a, b):
    return f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


query("S07_similarity", f"""SELECT id, round({_jac(_tok('name'), _tok('p_name'))}, 3) AS jaccard,
    round(CASE WHEN {nrm('name')} = {nrm('p_name')} THEN 0.95 ELSE 0.35 + 0.6 * {_jac(_tok('name'), _tok('p_name'))} END, 3) AS score,
    round({_jac("list_distinct(list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda y: y <> ''))", "list_distinct(string_split(p_name, ' '))")}, 3) AS punctuated FROM {{names}} t""")(
    lambda t: t.names.select("id", F.round(N.jaccard(N.tokens(name), N.tokens(C("p_name"))), 3).alias("jaccard"), F.round(N.name_score(name, C("p_name")), 3).alias("score"), F.round(N.jaccard(N.punctuated_tokens(name), N.punctuated_tokens(C("p_name"))), 3).alias("punctuated"))
)


def _forms(exprs, limit, least=1):
    rows = ", ".join(f"{{'k': {i}, 'v': {can(e)}}}" for i, e in enumerate(exprs))
    return f"""(SELECT coalesce(array_to_string(list(v ORDER BY k)[:{limit}], '|'), '') FROM (SELECT k, v, row_number() OVER (PARTITION BY {nrm('v')} ORDER BY k) AS r
        FROM (SELECT unnest([{rows}], recursive := true)) WHERE length(v) >= {least} AND {nrm('v')} <> '') WHERE r = 1)"""


_VAR = ["name", r"regexp_replace(name, '\([^)]*\)', ' ', 'g')", "regexp_replace(name, '[/,;:_-]', ' ', 'g')", r"regexp_replace(name, '\b(protein|enzyme)\b', ' ', 'gi')"]
scalar("S08_name_variants", lambda: joined(N.variants(name)), _forms([can(v.replace("name", can("name"))) for v in _VAR], 4))
_TERMS = ["name", "regexp_replace(name, '[+/]', ' ', 'g')", "regexp_replace(name, '[-_]', ' ', 'g')", "regexp_replace(name, '[^A-Za-z0-9 ]+', ' ', 'g')", nrm("name"), f"replace({nrm('name')}, ' ', '')"]
scalar("S09_search_terms", lambda: joined(N.search_terms(name)), _forms([v.replace("name", can("name")) for v in _TERMS], 6, 2))
scalar("S10_composite_parts", lambda: joined(N.composite_parts(F.concat(name, F.lit(" AND "), C("p_brand")))), "array_to_string(list_filter(list_transform(regexp_split_to_array(concat(name, ' AND ', p_brand), '(?i)\\s*\\+\\s*|\\s+and\\s+'), lambda x: " + can("x") + "), lambda x: x <> ''), '|')")
query("S11_complex_names", f"""SELECT id, array_to_string(list_filter(list_transform(string_split(c, ':'), lambda x: {can('x')}), lambda x: x <> ''), ':') AS complex_name,
    {can("regexp_replace(" + can("replace(m, '_', ' ')") + ", ' complex$', '', 'i')")} AS modifier FROM (SELECT id, replace(name, ' ', ' : ') AS c, concat(replace(p_name, ' ', '_'), CASE WHEN id % 2 = 0 THEN ' Complex' ELSE '' END) AS m FROM {{names}} t)""")(
    lambda t: t.names.select("id", N.complex_name(F.replace(name, F.lit(" "), F.lit(" : "))).alias("complex_name"), N.modifier_name(F.concat(F.replace(C("p_name"), F.lit(" "), F.lit("_")), F.when(C("id") % 2 == 0, " Complex").otherwise(""))).alias("modifier"))
)
query("S12_equation_sides", """SELECT id, concat(p_brand, CASE WHEN id % 3 = 0 THEN concat('|', p_name, '|', p_name) ELSE concat('|', p_name) END) AS lhs, concat(p_type, '|', p_type, '|', p_type) AS rhs FROM {names} t""")(
    lambda t: t.names.withColumn("eq", F.concat(F.lit("R1: "), C("p_brand"), F.when(C("id") % 3 == 0, " + 2 ").otherwise(" + "), C("p_name"), F.lit(" -> 3 "), C("p_type"))).select("id", joined(N.equation_side(C("eq"), True)).alias("lhs"), joined(N.equation_side(C("eq"), False)).alias("rhs"))
)
scalar("S13_transport_name", lambda: N.moved_name(F.concat(C("p_name"), F.lit(" From a to b")), C("p_brand"), C("p_type")), "concat(p_name, ' from ', p_brand, ' to ', p_type)")
query("S14_binding_evidence", """SELECT id, regexp_matches(lower(e), concat(lower(split_part(p_name, ' ', 1)), '\\s*\\+\\s*', lower(p_type))) AS exact, regexp_matches(lower(e), concat(lower(split_part(p_name, ' ', 1)), '\\s+bound\\s+to\\s+', lower(p_type))) AS phrase
    FROM (SELECT *, CASE id % 3 WHEN 0 THEN concat('x ', split_part(p_name, ' ', 1), ' +  ', p_type) WHEN 1 THEN concat(split_part(p_name, ' ', 1), ' BOUND to ', p_type) ELSE p_name END AS e FROM {names} t)""")(
    lambda t: t.names.withColumns({"l": F.split_part("p_name", F.lit(" "), F.lit(1))}).withColumn("e", F.when(C("id") % 3 == 0, F.concat(F.lit("x "), C("l"), F.lit(" +  "), C("p_type"))).when(C("id") % 3 == 1, F.concat(C("l"), F.lit(" BOUND to "), C("p_type"))).otherwise(C("p_name"))).withColumn("b", N.bound_evidence(C("l"), C("p_type"), C("e"))).select("id", "b.exact", "b.phrase")
)
query("S15_identifier_forms", """SELECT id, CASE WHEN id % 3 = 2 THEN concat('CHEBI:', id) ELSE concat('CHEBI:', id) END AS chebi, concat('C', id) AS kegg, concat('HMDB', lpad(CAST(id AS VARCHAR), CAST(greatest(7, length(CAST(id AS VARCHAR))) AS INT), '0')) AS hmdb FROM {names} t""")(
    lambda t: t.names.select("id", N.chebi_id(F.when(C("id") % 3 == 0, C("id").cast("string")).when(C("id") % 3 == 1, F.concat(F.lit(" chebi "), "id")).otherwise(F.concat(F.lit("CHEBI:"), "id"))).alias("chebi"), N.kegg_id(F.concat(F.lit("cpd:c"), "id")).alias("kegg"), N.hmdb_id(F.concat(F.lit("hmdb"), "id")).alias("hmdb"))
)


@query("S16_cross_reference_urns", "SELECT id, string_agg(urn, '|' ORDER BY k) AS value FROM (SELECT id, unnest(['chebi', 'hmdb', 'kegg']) AS k, unnest([concat('urn:miriam:chebi:', id), concat('urn:miriam:hmdb:', p_brand), concat('urn:miriam:kegg.compound:', p_size)]) AS urn FROM {names} t) GROUP BY id")
def _xrefs(t):
    from pathloom.operators.export import cross_references

    ids = F.create_map(F.lit("kegg"), C("p_size").cast("string"), F.lit("chebi"), C("id").cast("string"), F.lit("HMDB"), C("p_brand"), F.lit("other"), F.lit("x"), F.lit("pubchem"), F.lit(" "))
    return cross_references(t.names.select("id", ids.alias("mapped_ids")), "id").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("db", "urn"))), lambda s: s["urn"]), "|").alias("value"))


query("S17_doi", "SELECT doc_id, concat('10.1234/ab.', doc_id) AS value FROM documents")(lambda t: t.documents.select("doc_id", N.doi(F.concat(F.lit("See doi:10.1234/ab."), C("doc_id"), F.lit("). "), C("text"))).alias("value")))
query("S18_search_tokens", f"SELECT item_id, array_to_string(list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+'), lambda x: x NOT IN {sql_list(vocab.STOP_WORDS)}), '|') AS value FROM benchmark")(lambda t: t.benchmark.select("item_id", joined(N.search_tokens(C("text"))).alias("value")))
scalar("S19_synonym_list", lambda: joined(N.synonyms(F.concat_ws(";", C("p_name"), F.upper("p_name"), C("p_brand"), C("p_type")))), "concat(p_name, '|', p_brand, '|', p_type)")
query("S20_signature_parts", """SELECT p_partkey AS id, CASE WHEN p_retailprice = round(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS stoich, regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g') AS sid,
    substr(sha1(p_name), 1, 8) AS hash, concat(p_name, ' + ', p_type, ' → ', p_brand) AS label FROM part""")(
    lambda t: t.part.select(C("p_partkey").alias("id"), N.stoichiometry_key(C("p_retailprice")).alias("stoich"), N.model_id(C("p_brand")).alias("sid"), N.short_hash(C("p_name")).alias("hash"), N.reaction_label(F.array("p_name", "p_type"), F.array("p_brand")).alias("label"))
)
query("S21_json_pointer", "SELECT id, concat('/entities/', id, '/a~1b~0', p_brand) AS ptr, concat('entities|', id, '|a/b~', p_brand) AS parts FROM {names} t")(
    lambda t: t.names.withColumn("ptr", N.pointer(F.lit("entities"), C("id"), F.concat(F.lit("a/b~"), C("p_brand")))).select("id", "ptr", joined(N.pointer_parts(C("ptr"))).alias("parts"))
)
_PLACES = ["Cytoplasm", "mitochondrial matrix", "the plasma_membrane side", "ER", "outer nucleus envelope", "nowhere", "Golgi body"]
_WANT = ["cytosol", "mitochondrial_matrix", "plasma_membrane", "endoplasmic_reticulum", "nucleus", "", "golgi"]
query("S23_canonical_compartment", f"SELECT s_suppkey AS id, list_extract({_WANT!r}, CAST(s_suppkey % 7 AS INT) + 1) AS value FROM supplier")(
    lambda t: t.supplier.select(C("s_suppkey").alias("id"), N.compartment(F.element_at(F.array(*map(F.lit, _PLACES)), (C("s_suppkey") % 7 + 1).cast("int"))).alias("value"))
)
_AL = list(vocab.ALIASES)[:12]
query("S24_alias_rewrite", f"SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 12 THEN p_name ELSE list_extract({[vocab.ALIASES[a] for a in _AL]!r}, CAST(p_partkey % 13 AS INT) + 1) END AS value FROM part")(
    lambda t: t.part.select(C("p_partkey").alias("id"), N.alias(F.when(C("p_partkey") % 13 == 12, C("p_name")).otherwise(F.upper(F.element_at(F.array(*map(F.lit, [*_AL, ""])), (C("p_partkey") % 13 + 1).cast("int"))))).alias("value"))
)

scalar("B08_binomial", lambda: ~N.is_binomial(F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 99))), "NOT regexp_matches(concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)), '^[A-Z][a-z]+(\\.|)\\s+[a-z][a-z-]+$')")
scalar("B11_byproduct", lambda: N.is_byproduct(F.when(C("id") % 3 == 0, F.concat("p_brand", F.lit(" acid"))).when(C("id") % 3 == 1, F.lit("Carbon  dioxide")).otherwise(C("p_name"))), "id % 3 < 2")
scalar("B12_plus_token", lambda: N.has_plus(F.when(C("id") % 4 == 0, F.concat("p_brand", F.lit("+"))).when(C("id") % 4 == 1, F.lit("Ca2+")).when(C("id") % 4 == 2, F.concat("p_brand", F.lit("+"), "p_type")).otherwise(C("p_name"))), "id % 4 = 2")
query("B13_route", """SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'complex' WHEN 1 THEN 'protein' WHEN 2 THEN 'protein' WHEN 3 THEN 'protein' ELSE 'compound' END AS route,
    CASE s_suppkey % 5 WHEN 0 THEN 'complex_entity' WHEN 1 THEN 'type_hint' WHEN 2 THEN 'known_protein_like' WHEN 3 THEN 'name_pattern' ELSE 'default_compound_route' END AS reason FROM supplier""")(
    lambda t: t.supplier.select(C("s_suppkey").alias("id"), N.route(F.when(C("s_suppkey") % 5 == 0, F.concat("s_name", F.lit(":x"))).when(C("s_suppkey") % 5 == 3, F.concat("s_name", F.lit(" Kinase"))).otherwise(C("s_name")), F.when(C("s_suppkey") % 5 == 1, "Enzyme").otherwise(""), C("s_suppkey") % 5 == 2).alias("r")).select("id", "r.route", "r.reason")
)
query("B14_modifier_role", """SELECT event_id, CASE WHEN regexp_matches(r, 'inhibit|block|suppress|downregulat|repress') THEN 'inhibitor' WHEN regexp_matches(r, 'transport|carry|carri|shuttle|translocat') THEN 'transporter'
    WHEN regexp_matches(r, 'activat|promotes') AND NOT regexp_matches(r, 'catalyz|enzyme') THEN 'activator' ELSE 'catalyst' END AS role
    FROM (SELECT event_id, list_extract(['inhibits', 'shuttles x', 'activates', 'catalyzes and activates', 'enzyme of', 'binds', 'promotes'], CAST(event_id % 7 AS INT) + 1) AS r FROM events)""")(
    lambda t: t.events.select("event_id", N.modifier_role(F.element_at(F.array(*map(F.lit, ["Inhibits", "shuttles x", "activates", "catalyzes and activates", "enzyme of", "binds", "promotes"])), (C("event_id") % 7 + 1).cast("int"))).alias("role"))
)
scalar("B15_generic_class", lambda: N.is_generic_class(F.when(C("id") % 2 == 0, F.concat("p_name", F.lit(" Triacylglycerol"))).otherwise(C("p_name"))), "id % 2 = 0")
query("B17_model_protein_species", "SELECT s_suppkey AS id, s_suppkey % 3 < 2 AS value FROM supplier")(
    lambda t: t.supplier.select(C("s_suppkey").alias("id"), N.model_species_is_protein(F.when(C("s_suppkey") % 3 == 0, F.concat(F.lit("P_"), "s_suppkey")).otherwise(F.lit("c")), F.when(C("s_suppkey") % 3 == 1, "H+ ATPase").otherwise(C("s_name"))).alias("value"))
)
query("G01_distinct_names", "SELECT pathway_id, string_agg(v, '|' ORDER BY pos) AS value FROM (SELECT p_size AS pathway_id, p_name AS v, p_partkey AS pos, row_number() OVER (PARTITION BY p_size, p_name ORDER BY p_partkey) AS r FROM part) WHERE r = 1 GROUP BY 1")(
    lambda t: t.part.groupBy(C("p_size").alias("pathway_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"]).alias("a")).select("pathway_id", joined(N.distinct_by(C("a"))).alias("value"))
)
query("G04_same_multiset", "SELECT id, id % 2 = 0 AS value FROM {names} t")(
    lambda t: t.names.select("id", N.same_names(F.array("p_name", "p_brand", "p_name"), F.array(F.upper("p_brand"), "p_name", F.when(C("id") % 2 == 0, C("p_name")).otherwise(C("p_brand")))).alias("value"))
)
