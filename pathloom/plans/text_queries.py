"""Queries of texts, retrieval, audit rules and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import vocab
from pathloom.operators import audit as A
from pathloom.operators import text as T
from pathloom.operators.tables import ordered
from pathloom.plans.registry import query

C = F.col
_SEC = "(SELECT doc_id, unnest([0, 1, 2]) AS section_no, unnest(['preamble', list_extract(['results', 'methods', 'references', 'materials and methods'], CAST(doc_id % 4 AS INT) + 1), 'acknowledgments']) AS label, unnest(['Opening words', regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 'thanks']) AS body FROM documents)"
query("E01_sections", f"SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, label, md5(body) AS body FROM {_SEC} s WHERE body <> ''")(lambda t: T.sections(t.papers).withColumn("body", F.md5("body")))
_REL = "CASE label WHEN 'results' THEN 0.9 WHEN 'methods' THEN 0.7 WHEN 'references' THEN 0.1 WHEN 'materials and methods' THEN 0.7 WHEN 'preamble' THEN 0.5 ELSE 0.05 END"
#: Sentences per section with running word counts; a chunk follows from where the one before ends.
_CHUNKS = rf"""WITH RECURSIVE sent AS MATERIALIZED (SELECT *, list_transform(s, lambda x: len(regexp_extract_all(x, '\S+'))) AS w FROM (SELECT doc_id, section_no, label,
    list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\s+([A-Z"(\[])', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM {_SEC} q WHERE body <> '')),
sums AS MATERIALIZED (SELECT doc_id, section_no, len(w) AS n, list_transform(range(0, len(w) + 1), lambda i: coalesce(list_sum(list_slice(w, 1, i)), 0)) AS t FROM sent WHERE len(w) > 0),
r(doc_id, section_no, i, a, b) AS (SELECT doc_id, section_no, 0, 0, greatest(1, len(list_filter(t, lambda x: x <= 120)) - 1) FROM sums UNION ALL
    SELECT doc_id, section_no, i + 1, na, greatest(na + 1, len(list_filter(t, lambda x: x <= t[na + 1] + 120)) - 1) FROM (SELECT r.*, t, greatest(a + 1, len(list_filter(t, lambda x: x < t[b + 1] - 30))) AS na FROM r JOIN sums USING (doc_id, section_no) WHERE b < n)),
c AS (SELECT doc_id, section_no, i AS chunk_no, label, label AS section, array_to_string(list_slice(s, a + 1, b), ' ') AS text, CAST(list_sum(list_slice(w, a + 1, b)) AS BIGINT) AS word_count, a AS first_sentence, b AS end_sentence FROM r JOIN sent USING (doc_id, section_no)),
chunks AS (SELECT *, sum(word_count) OVER (PARTITION BY doc_id, section_no ORDER BY chunk_no) AS end_word FROM c)"""
query("E06_sentence_chunks", f"{_CHUNKS} SELECT doc_id, section_no, chunk_no, section, text, word_count, CAST(end_word - word_count AS BIGINT) AS start_word, CAST(end_word AS BIGINT) AS end_word, first_sentence, end_sentence FROM chunks")(lambda t: T.chunks(T.sections(t.papers), limit=120, overlap=30))
query("E07_ordered_chunks", f"""{_CHUNKS}, size AS (SELECT doc_id, section_no, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM (SELECT doc_id, section_no, sum(word_count) AS n FROM chunks GROUP BY 1, 2))
    SELECT doc_id, section_no, chunk_no, section, word_count, CAST(end_word - word_count AS BIGINT) AS start_word, CAST(end_word AS BIGINT) AS end_word, first_sentence, end_sentence, CAST({_REL} AS DOUBLE) AS relevance, CAST("offset" AS BIGINT) AS "offset",
    row_number() OVER (PARTITION BY doc_id ORDER BY {_REL} DESC, section_no, chunk_no) AS chunk_id FROM chunks JOIN size USING (doc_id, section_no)""")(lambda t: T.ordered_chunks(T.chunks(T.sections(t.papers), limit=120, overlap=30)).drop("text"))
query("E07_section_relevance", f"SELECT doc_id, label, CAST({_REL} AS DOUBLE) AS relevance FROM {_SEC} s WHERE body <> '' AND {_REL} >= 0.3")(
    lambda t: (lambda s: s.select("doc_id", "label", __import__("pathloom.functions.names", fromlist=["x"]).section_relevance(C("label")).alias("relevance")).where(C("relevance") >= vocab.MIN_RELEVANCE))(T.sections(t.papers))
)


def book(t):
    """Lines of documents as pages of customers' books, with headings on some."""
    return t.documents.select((C("doc_id") % 40).alias("doc_id"), C("doc_id").alias("page"), F.concat(F.when(C("doc_id") % 7 == 3, "Results\n").when(C("doc_id") % 7 == 6, "References\n").otherwise(""), C("text")).alias("text"))


_BOOK = "(SELECT doc_id % 40 AS doc_id, doc_id AS page, coalesce(last_value(CASE WHEN doc_id % 7 = 3 THEN 'results' WHEN doc_id % 7 = 6 THEN 'references' END IGNORE NULLS) OVER (PARTITION BY doc_id % 40 ORDER BY doc_id), 'preamble') AS section, concat(CASE WHEN doc_id % 7 = 3 THEN 'Results\n' WHEN doc_id % 7 = 6 THEN 'References\n' ELSE '' END, text) AS text FROM documents)"
query("A08_page_sections", f"SELECT doc_id, page, section FROM {_BOOK} b")(lambda t: T.page_sections(book(t)).select("doc_id", "page", "section"))
query("A08_joined_pages", f"SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY page)) AS text, count(*) AS pages FROM {_BOOK} b WHERE section <> 'references' GROUP BY 1")(lambda t: T.joined_pages(T.page_sections(book(t))).withColumn("text", F.md5("text")))
query("A08_mostly_empty", "SELECT doc_id % 40 AS doc_id, avg(CASE WHEN n_chars < 300 THEN 1.0 ELSE 0.0 END) > 0.3 AS mostly_empty FROM documents GROUP BY 1")(lambda t: T.mostly_empty(t.documents.withColumn("doc_id", C("doc_id") % 40), least=300, share=0.3))


def outputs(t):
    """Objects as they are, in fences, and cut off before their closing brackets."""
    obj = F.to_json(F.struct("text", "turn"))
    cut = F.concat(F.lit('{"items": [{"a": 1}, {"a": 2, '), F.expr("substring(to_json(struct(text)), 2, length(to_json(struct(text))) - 2)"))
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.when(C("conv_id") % 3 == 0, obj).when(C("conv_id") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), obj, F.lit("\n```"))).otherwise(cut).alias("raw"))


query("S25_recovered_outputs", "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'parsed' ELSE 'salvaged' END AS outcome, conv_id % 3 = 2 AS items, CASE WHEN conv_id % 3 < 2 THEN md5(text) END AS said FROM conversations WHERE role = 'assistant'")(
    lambda t: T.recovered(outputs(t), ["conv_id", "turn"]).select("conv_id", "turn", "outcome", F.get_json_object("json", "$.items").isNotNull().alias("items"), F.md5(F.coalesce(F.get_json_object("json", "$.items[1].text"), F.get_json_object("json", "$.text"))).alias("said"))
)


def entries(t):
    """All lines of a text: the first and every other one a reaction, those between species."""
    d = t.documents.withColumn("l", F.split("text", "\n"))
    odd = lambda k: F.filter("l", lambda x, i: i % 2 == k)
    return d.select(C("doc_id").alias("model"), odd(0).alias("reaction"), odd(1).alias("species"), F.array("source").alias("compartment"))


_ODD = "list_transform(range(1, len({0}) + 1, 2), lambda i: {0}[i])"
_EVEN = "list_transform(range(2, len({0}) + 1, 2), lambda i: {0}[i])"
_STOP = "(" + ", ".join(f"'{x}'" for x in vocab.STOP_WORDS) + ")"
_TOKS = "list_filter(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-z0-9]+'), lambda x: x NOT IN " + _STOP + ")"
_INDEX = f"ix AS (SELECT DISTINCT model, unnest([f, 'all']) AS field, token FROM (SELECT model, f, unnest({_TOKS.format('s')}) AS token FROM (SELECT doc_id AS model, unnest(['reaction', 'species', 'compartment']) AS f, unnest([array_to_string({_ODD.format('l')}, ' '), array_to_string({_EVEN.format('l')}, ' '), source]) AS s FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)) WHERE s IS NOT NULL))"
query("S26_motif_tokens", f"WITH {_INDEX} SELECT * FROM ix")(lambda t: T.motif_tokens(entries(t)))
_TOP = f"WITH {_INDEX}, q AS (SELECT item_id AS query, list_distinct({_TOKS.format('text')}) AS t FROM benchmark), w AS (SELECT query, len(t) AS n, unnest(t) AS token FROM q), s AS (SELECT query, model, round(sum(CASE field WHEN 'reaction' THEN 2.6 WHEN 'species' THEN 1.8 WHEN 'compartment' THEN 1.0 ELSE 0.6 END / n), 6) AS score FROM w JOIN ix USING (token) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, model) AS rn FROM s)"
query("F01_top_examples", _TOP + " SELECT query, model, rn FROM r WHERE rn <= 3")(lambda t: T.top_examples(t.benchmark.select(C("item_id").alias("query"), "text"), T.motif_words(entries(t))).select("query", "model", "rn"))
query("F04_retrieval_context", _TOP + ", e AS (SELECT doc_id AS model, string_split(text, chr(10)) AS l, source FROM documents) SELECT query, substr(string_agg(concat('# ', model, chr(10), 'compartments: ', source, chr(10), 'species: ', array_to_string(list_slice(" + _EVEN.format("l") + ", 1, 10), ', '), chr(10), 'reactions: ', array_to_string(list_slice(" + _ODD.format("l") + ", 1, 6), ', ')), concat(chr(10), chr(10)) ORDER BY rn), 1, 900) AS context FROM r JOIN e USING (model) WHERE rn <= 3 GROUP BY 1")(
    lambda t: T.context_texts(T.top_examples(t.benchmark.select(C("item_id").alias("query"), "text"), T.motif_words(entries(t))), entries(t), most=900)
)
query("S27_query_texts", "SELECT pathway_id, string_agg(name, chr(10) ORDER BY part, pos) AS text FROM (SELECT *, row_number() OVER (PARTITION BY pathway_id, name ORDER BY part, pos) AS r FROM (SELECT pathway_id, 0 AS part, pos, name FROM {compounds} c UNION ALL SELECT pathway_id, 1, pos, lower(brand) FROM {compounds} c)) WHERE r = 1 GROUP BY 1")(
    lambda t: T.query_texts(t.compounds, t.compounds.select("pathway_id", "pos", F.lower("brand").alias("name")))
)


def rx(t):
    """Reactions of a pathway whose names are equations, some of them wrong."""
    s = t.participants.groupBy("pathway_id", "process").agg(*[F.array_compact(ordered(F.when(C("role") == r, C("entity")), "pos")).alias(k) for r, k in (("reactant", "inputs"), ("product", "outputs"))])
    return s.withColumn("pos", C("process")).withColumn("name", F.concat(F.array_join("inputs", " + "), F.lit(" -> "), F.when(C("process") % 5 == 0, "other").otherwise(F.array_join("outputs", " + ")))).withColumn("state", F.when(C("process") % 6 == 0, " ").otherwise(F.concat(F.lit("s"), C("process") % 4)))


def flat(df):
    return df.select("pathway_id", "severity", "rule", "path", "op", "confidence")


_S = "(SELECT pathway_id, process, count(*) FILTER (role = 'reactant') AS i, count(*) FILTER (role = 'product') AS o FROM {participants} p GROUP BY 1, 2)"
query("K09_equation_mismatch", f"SELECT pathway_id, 'warning' AS severity, 'equation_mismatch' AS rule, concat('/processes/reactions/', process, '/outputs') AS path, 'replace' AS op, 0.9 AS confidence FROM {_S} s WHERE i > 0 AND process % 5 = 0")(lambda t: flat(A.equation_mismatch(rx(t))))
query("K09_missing_sides", f"SELECT pathway_id, 'error' AS severity, 'missing_side' AS rule, concat('/processes/reactions/', process) AS path FROM {_S} s WHERE i = 0 OR o = 0")(lambda t: A.missing_sides(rx(t)).select("pathway_id", "severity", "rule", "path"))
query("K09_identical_sides", "SELECT pathway_id, concat('/processes/reactions/', process) AS path, 'remove' AS op FROM {processes} x WHERE process % 4 = 0")(lambda t: A.identical_sides(t.processes.select("pathway_id", "pos", F.array("status", "priority").alias("inputs"), F.when(C("process") % 4 == 0, F.array("priority", "status")).otherwise(F.array("priority")).alias("outputs"))).select("pathway_id", "path", "op"))
query("K09_composite_sides", "SELECT pathway_id, concat('/processes/reactions/', process) AS path FROM {processes} x WHERE process % 4 = 0")(lambda t: A.composite_sides(t.processes.select("pathway_id", "pos", F.array(F.when(C("process") % 4 == 0, F.concat("status", F.lit(" + x"))).otherwise("NAD+")).alias("inputs"), F.array("priority").alias("outputs"))).select("pathway_id", "path"))
query("K09_entity_rules", """SELECT p_size AS pathway_id, 'duplicate_entity' AS rule, concat('/entities/compound/', p_partkey) AS path FROM (SELECT *, row_number() OVER (PARTITION BY p_size, p_name ORDER BY p_partkey) AS r, count(DISTINCT p_type) OVER (PARTITION BY p_size, p_name) AS n FROM part WHERE p_partkey % 10 < 8) WHERE r > 1 AND n = 1
    UNION ALL SELECT p_size, 'conflicting_duplicate', concat('/entities/compound/', p_partkey) FROM (SELECT *, row_number() OVER (PARTITION BY p_size, p_name ORDER BY p_partkey) AS r, count(DISTINCT p_type) OVER (PARTITION BY p_size, p_name) AS n FROM part WHERE p_partkey % 10 < 8) WHERE r > 1 AND n > 1
    UNION ALL SELECT p_size, 'unnamed_entity', concat('/entities/compound/', p_partkey) FROM part WHERE p_partkey % 10 = 8 UNION ALL SELECT p_size, 'composite_entity', concat('/entities/compound/', p_partkey, '/name') FROM part WHERE p_partkey % 10 = 9""")(
    lambda t: (lambda e: A.unnamed(e).unionByName(A.composite_entities(e)).unionByName(A.conflicting_duplicates(e)))(t.part.select(C("p_size").alias("pathway_id"), F.lit("compound").alias("kind"), C("p_partkey").alias("pos"), F.when(C("p_partkey") % 10 == 8, " ").when(C("p_partkey") % 10 == 9, F.concat("p_name", F.lit("+"), "p_partkey")).otherwise(C("p_name")).alias("name"), C("p_type").alias("class"))).select("pathway_id", "rule", "path")
)
query("K09_missing_blocks", "SELECT s_suppkey AS pathway_id, '/processes' AS path FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, '/entities' FROM supplier WHERE s_suppkey % 4 = 0")(lambda t: A.missing_blocks(t.supplier.select(C("s_suppkey").alias("pathway_id"), F.when(C("s_suppkey") % 4 > 0, "{}").alias("entities"), F.when(C("s_suppkey") % 3 > 0, "{}").alias("processes")), ("entities", "processes")).select("pathway_id", "path"))
query("K09_unknown_names", "SELECT pathway_id, 'unknown_reference' AS rule, count(*) AS n, count(DISTINCT entity) AS added FROM {participants} p WHERE entity LIKE '%5' GROUP BY 1")(
    lambda t: A.unknown_names(t.participants, t.participants.where("entity not like '%5'").select("pathway_id", C("entity").alias("name")).distinct()).groupBy("pathway_id", "rule").agg(F.count("*").alias("n"), F.count_distinct("value").alias("added"))
)


def moves(t):
    return t.processes.select("pathway_id", "pos", F.when(C("process") % 5 == 0, " ").when(C("process") % 5 == 1, "a + b").otherwise("c").alias("cargo"), F.concat(F.lit("s"), C("process") % 3).alias("from_state"), F.concat(F.lit("s"), C("process") % 2).alias("to_state"), F.when(C("process") % 7 == 0, F.concat(F.lit("moves from s"), C("process") % 3, F.lit(" to S"), C("process") % 2)).when(C("process") % 7 == 1, "moves from here to there").otherwise("moves").alias("name"))


query("K09_cargo_rules", """SELECT pathway_id, 'missing_cargo' AS rule, pos FROM {processes} x WHERE process % 5 = 0 UNION ALL SELECT pathway_id, 'composite_cargo', pos FROM {processes} x WHERE process % 5 = 1 UNION ALL SELECT pathway_id, 'unmoved_cargo', pos FROM {processes} x WHERE process % 3 = process % 2 AND process % 5 > 0""")(lambda t: A.cargo_rules(moves(t)).select("pathway_id", "rule", F.substring_index("path", "/", -1).cast("long").alias("pos")))
query("K09_name_state_mismatch", "SELECT pathway_id, concat('moves from s', process % 3, ' to s', process % 2) AS value FROM {processes} x WHERE process % 7 = 1")(lambda t: A.name_states(moves(t)).select("pathway_id", "value"))
query("K09_unused_compounds", "SELECT s_nationkey AS pathway_id, concat('/entities/compound/', s_suppkey) AS path FROM supplier WHERE s_suppkey % 3 > 0")(lambda t: A.unused(t.proteins.withColumn("kind", F.lit("compound")), t.proteins.where("pos % 3 = 0").select("pathway_id", F.upper("name").alias("entity"))).select("pathway_id", "path"))
query("K09_states", "SELECT pathway_id, CASE WHEN process % 6 = 0 THEN 'missing_state' ELSE 'unknown_state' END AS rule, count(*) AS n FROM (SELECT DISTINCT pathway_id, process FROM {participants} p) WHERE process % 6 = 0 OR process % 4 = 3 GROUP BY 1, 2")(
    lambda t: A.unknown_states(rx(t), t.processes.select("pathway_id", F.explode(F.array(*[F.lit(f"s{i}") for i in range(3)])).alias("name")).distinct()).groupBy("pathway_id", "rule").agg(F.count("*").alias("n"))
)
query("K09_unlocated_proteins", "SELECT s_nationkey AS pathway_id, concat('/entities/protein/', s_suppkey) AS path FROM supplier WHERE s_suppkey % 3 > 0")(lambda t: A.unlocated(t.proteins.withColumn("kind", F.lit("protein")), t.proteins.where("pos % 3 = 0").select("pathway_id", F.upper("name").alias("entity"))).select("pathway_id", "path"))
query("K09_organism_spread", "SELECT s_nationkey AS pathway_id, concat('/entities/protein/', s_suppkey, '/organism') AS path, 'o' AS value FROM supplier WHERE s_suppkey % 3 > 0 AND s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")(lambda t: A.organism_spread(t.proteins.withColumn("kind", F.lit("protein")).withColumn("organism", F.when(C("id") % 3 == 0, "o").otherwise(" "))).select("pathway_id", "path", "value"))

_ACCEPT = """CASE WHEN op = 'add' AND confidence < 0.75 THEN 'low_confidence' WHEN op = 'replace' AND confidence < 0.88 THEN 'low_confidence' WHEN op = 'remove' AND confidence < 0.95 THEN 'low_confidence'
    WHEN op = 'remove' AND contains(path, '/processes/reactions/') AND NOT (seq % 8 < 4 AND confidence >= 0.97 AND evidence <> '') THEN 'core_removal' ELSE 'accepted' END"""
query("P01_patch_acceptance", f"SELECT seq, reason = 'accepted' AS accepted, reason FROM (SELECT seq, {_ACCEPT} AS reason FROM (SELECT * REPLACE (least(1.0, confidence * 8) AS confidence) FROM {{patches}} p))")(
    lambda t: (lambda p: A.accepted(p, p.select("pathway_id", "path", (C("seq") % 8 < 4).alias("is_noop"), "seq").where("path like '/processes%'").dropDuplicates(["seq"]).drop("pathway_id").withColumn("pathway_id", C("seq")).drop("seq")))(t.patches.withColumn("confidence", F.least(F.lit(1.0), C("confidence") * 8)).withColumn("pathway_id", C("seq"))).select("seq", "accepted", "reason")
)
query("P03_normal_patches", "SELECT user_id AS pathway_id, CASE WHEN event_id % 2 = 0 THEN 'add' ELSE 'replace' END AS op, concat('/p/', event_id % 5) AS path, min(event_id) AS seq, arg_min(event_type, event_id) AS value FROM events GROUP BY 1, 2, 3")(
    lambda t: A.normal_patches(t.events.select(C("user_id").alias("pathway_id"), C("event_id").alias("seq"), F.when(C("event_id") % 2 == 0, F.format_string('{"action":"ADD","path":"/p/%d","new_value":"%s"}', C("event_id") % 5, C("event_type"))).otherwise(F.format_string('{"op":"replace","path":"/p/%d","value":"%s","confidence":"x"}', C("event_id") % 5, C("event_type"))).alias("json"))).select("pathway_id", "op", "path", "seq", "value")
)
