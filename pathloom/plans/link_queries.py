"""Queries of grounding, candidates and mapping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.operators import linking as K
from pathloom.operators.tables import first_per
from pathloom.plans.durable import shared_folder
from pathloom.plans.registry import query
from pathloom.sources import cache

C = F.col
WHO = "(SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN upper(p_name) ELSE concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) END AS name FROM part)"
CAT = "(SELECT min(p_partkey) AS id, p_name AS c_name, arg_min(p_type, p_partkey) AS short_name, concat(arg_min(p_brand, p_partkey), ';', arg_min(lower(p_type), p_partkey), ' ', split_part(p_name, ' ', 1)) AS synonyms FROM part GROUP BY p_name)"


def who(t):
    return t.part.select(F.when(C("p_partkey") % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).when(C("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("name")).distinct()


def catalogue(t):
    c = first_per(t.part.select("p_name", "p_partkey", "p_type", "p_brand"), ["p_name"], "p_partkey")
    return c.select(C("p_partkey").alias("id"), C("p_name").alias("name"), C("p_type").alias("short_name"), F.concat("p_brand", F.lit(";"), F.lower("p_type"), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("synonyms"))


def _tok(x):
    return f"list_distinct(string_split(lower({x}), ' '))"


def _jac(a, b):
    return f"(len(list_intersect({_tok(a)}, {_tok(b)}))::DOUBLE / len(list_distinct(list_concat({_tok(a)}, {_tok(b)}))))"


def _scored(syn, jac, more="0"):
    s = "split_part(synonyms, ';', 1)", "split_part(synonyms, ';', 2)"
    alike = ", ".join(_jac("name", x) for x in ("c_name", "short_name")) + ", " + ", ".join(_jac("name", f"regexp_replace({x}, '[^A-Za-z0-9 ]', '', 'g')") for x in s)
    return f"""(SELECT name, id, round(least(1.0, greatest(0.0, CASE WHEN lower(name) IN (lower(c_name), lower(short_name)) THEN 0.9 ELSE 0 END + CASE WHEN lower(name) IN (lower(regexp_replace({s[0]}, '#', '')), lower({s[1]})) THEN {syn} ELSE 0 END
        + CASE WHEN contains(lower(c_name), lower(name)) OR contains(lower(short_name), lower(name)) THEN 0.08 ELSE 0 END + 0.35 + {jac} * greatest({alike}) + {more})), 4) AS score FROM {WHO} w JOIN {CAT} c ON contains(lower(c_name), lower(name)) OR contains(lower(short_name), lower(name)) OR contains(lower(synonyms), lower(name)))"""


query("C04_compound_candidates", f"SELECT name, id, round(score, 3) AS score FROM {_scored(0.84, 0.55)} s")(lambda t: K.candidates(who(t), catalogue(t), K.COMPOUND).withColumn("score", F.round("score", 3)))
query("C05_protein_candidates", f"SELECT name, id, round(score, 3) AS score FROM {_scored(0.83, 0.52, 'CASE WHEN id % 2 = 0 THEN 0.08 ELSE 0 END + CASE WHEN id % 5 = 1 THEN 0.14 ELSE -0.02 END')} s")(
    lambda t: K.candidates(who(t), catalogue(t).withColumn("accession", F.when(C("id") % 2 == 0, F.concat(F.lit("P"), "id"))).withColumn("species_id", C("id") % 5), K.PROTEIN, species=who(t).withColumn("species_id", F.lit(1).cast("long"))).withColumn("score", F.round("score", 3))
)
query("E03_accept_best", f"""SELECT name, id, round(score, 3) AS score, round(second, 3) AS second, CASE WHEN score >= 0.9 OR (score >= 0.74 AND round(score - second, 6) >= 0.03) THEN 'mapped' ELSE 'ambiguous' END AS status FROM (SELECT *, row_number() OVER w AS r, coalesce(lead(score) OVER w, 0) AS second FROM {_scored(0.84, 0.55)} s WINDOW w AS (PARTITION BY name ORDER BY score DESC, id)) WHERE r = 1""")(
    lambda t: K.choose(K.candidates(who(t), catalogue(t), K.COMPOUND), ["name"], 0.9, 0.74, 0.03).select("name", "id", F.round("score", 3).alias("score"), F.round("second", 3).alias("second"), "status")
)
query("E03_top_candidates", f"SELECT name, id, round(score, 3) AS score, rn FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS rn FROM {_scored(0.84, 0.55)} s) WHERE rn <= 10")(lambda t: K.top_candidates(K.candidates(who(t), catalogue(t), K.COMPOUND), ["name"]).withColumn("score", F.round("score", 3)))


@query("C01_ground", """SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE b END AS brand, p_type AS type, b IS NOT NULL AS matched, CASE WHEN p_partkey % 2 = 1 AND b IS NOT NULL THEN 1 ELSE 0 END AS added
    FROM part LEFT JOIN (SELECT p_name, min(p_brand) AS b FROM part WHERE p_size < 3 GROUP BY 1) d USING (p_name)""")
def _ground(t):
    e = t.part.select(C("p_partkey").alias("id"), F.lit("compounds").alias("section"), C("p_name").alias("name"), F.when(C("p_partkey") % 2 == 0, C("p_brand")).otherwise(" ").alias("brand"), C("p_type").alias("type"))
    d = t.part.where("p_size < 3").select(F.lit("compounds").alias("section"), F.upper("p_name").alias("name"), C("p_brand").alias("brand"), F.lit("t").alias("type"))
    got = K.ground(e, d, ["brand", "type"]).drop("section")
    return got.withColumn("brand", F.when(C("matched") | (C("id") % 2 == 0), C("brand")))


query("C06_species", "SELECT s_name AS organism, s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 1.0 WHEN s_suppkey % 3 = 1 THEN 0.95 ELSE 0.98 END::DOUBLE AS score FROM supplier")(
    lambda t: K.species_of(t.supplier.select(F.when(C("s_suppkey") % 3 == 0, F.upper("s_name")).when(C("s_suppkey") % 3 == 1, F.concat(F.lit("the common "), "s_name")).otherwise((C("s_suppkey") + 777000).cast("string")).alias("organism")), t.supplier.select(C("s_suppkey").alias("id"), C("s_name").alias("name"), F.concat(F.lit("the common "), "s_name").alias("common_name"), (C("s_suppkey") + 777000).cast("string").alias("taxonomy_id"))).join(t.supplier, C("id") == C("s_suppkey")).select(C("s_name").alias("organism"), "id", "score")
)


def hits(t):
    return t.events.select(C("user_id").cast("string").alias("name"), (C("event_id") % 4).cast("int").alias("v"), C("event_type").alias("db"), (C("event_id") % 6).cast("string").alias("ext"), F.least(F.lit(1.0), F.floor(C("value")) / 50).alias("score"))


_HITS = "h AS (SELECT CAST(user_id AS VARCHAR) AS name, event_id % 4 AS v, event_type AS db, CAST(event_id % 6 AS VARCHAR) AS ext, round(least(1.0, floor(value) / 50) * greatest(0.8, 1 - 0.08 * (event_id % 4)), 6) AS score FROM events), sf AS (SELECT s.name, s.v, db, ext, max(score) AS score FROM (SELECT DISTINCT name, v FROM h) s JOIN h w ON s.name = w.name AND w.v <= s.v GROUP BY 1, 2, 3, 4), tw AS (SELECT name, v, max(score) AS best, coalesce(max(score) FILTER (rn = 2), 0) AS second FROM (SELECT *, row_number() OVER (PARTITION BY name, v ORDER BY score DESC, db, ext) AS rn FROM sf) WHERE rn <= 2 GROUP BY 1, 2), st AS (SELECT name, min(v) AS stop FROM tw WHERE best >= 0.92 AND round(best - second, 6) >= 0.12 GROUP BY 1), g AS (SELECT name, db, ext, max(score) AS score FROM h LEFT JOIN st USING (name) WHERE stop IS NULL OR v <= stop GROUP BY 1, 2, 3)"
query("C07_catalogue_candidates", f"WITH {_HITS} SELECT * FROM g")(lambda t: K.from_catalogues(hits(t)))
query("C07_accept_catalogues", f"""WITH {_HITS}, r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(score) OVER w, 0) AS second FROM g WINDOW w AS (PARTITION BY name ORDER BY score DESC, concat(db, ':', ext))), o AS (SELECT name, db, max(ext) FILTER (score = top) AS x FROM (SELECT *, max(score) OVER (PARTITION BY name, db) AS top FROM g WHERE score >= 0.9) GROUP BY 1, 2)
    SELECT r.name, r.db, r.ext, r.score, CASE WHEN score >= 0.78 AND round(score - second, 6) >= 0.08 THEN 'mapped' ELSE 'ambiguous' END AS status, CASE WHEN score >= 0.78 AND round(score - second, 6) >= 0.08 THEN coalesce((SELECT string_agg(concat(o.db, ':', x), '|' ORDER BY o.db) FROM o WHERE o.name = r.name AND o.db <> r.db), '') ELSE '' END AS others FROM r WHERE rn = 1""")(lambda t: K.accept_catalogues(K.from_catalogues(hits(t))))


def accessions(t):
    n = t.supplier.select(F.upper("s_name").alias("name"), F.when(C("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("org "), C("s_suppkey") % 4)).alias("org"))
    c = t.supplier.select(C("s_suppkey").alias("id"), C("s_name").alias("full_name"), F.concat(F.lit("Org "), C("s_suppkey") % 2).alias("organism"), (C("s_suppkey") % 5 == 0).alias("reviewed"))
    return K.accession_candidates(n, c, C("org"))


_ACC = "(SELECT s_suppkey AS id, s_name, round(0.55 + CASE WHEN s_suppkey % 3 = 0 THEN -0.04 WHEN s_suppkey % 4 = s_suppkey % 2 THEN 0.25 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 0.05 ELSE 0 END, 4) AS score, s_suppkey % 5 = 0 AS reviewed FROM supplier)"
query("C08_accession_candidates", f"SELECT upper(s_name) AS name, id, score, reviewed FROM {_ACC} a")(accessions)
query("C08_accept_accession", f"SELECT upper(s_name) AS name, id, CASE WHEN score >= 0.78 OR (reviewed AND score >= 0.74) THEN 'mapped' ELSE 'ambiguous' END AS status FROM {_ACC} a")(lambda t: K.accept_accession(accessions(t)).select("name", "id", "status"))
query("C09_location_candidates", "SELECT entity, place, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, place) AS rn FROM (SELECT p_name AS entity, r_name AS place, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)) WHERE rn <= 4")(
    lambda t: K.location_candidates(t.part.select(C("p_partkey").alias("ref_id"), C("p_name").alias("entity")), t.lineitem.join(t.supplier, F.expr("l_suppkey = s_suppkey")).select(C("l_partkey").alias("ref_id"), C("s_nationkey").alias("state_id")), t.nation.select(C("n_nationkey").alias("state_id"), C("n_regionkey").alias("place_id")), t.region.select(C("r_regionkey").alias("place_id"), C("r_name").alias("place")), 4)
)


def strategy(t, how):
    n = t.supplier.select(C("s_name").alias("name"))
    db = t.supplier.where("s_suppkey % 2 = 0").select(C("s_name").alias("name"), F.lit("d").alias("ids"), F.when(C("s_suppkey") % 4 == 0, "mapped").otherwise("ambiguous").alias("status"))
    api = t.supplier.where("s_suppkey % 3 = 0").select(C("s_name").alias("name"), F.lit("a").alias("ids"), F.lit("mapped").alias("status"))
    return K.by_strategy(n, db, api, how)


query("C10_strategy", "SELECT s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'd' WHEN s_suppkey % 3 = 0 THEN 'a' WHEN s_suppkey % 2 = 0 THEN 'd' END AS ids, CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 3 = 0 THEN 'mapped' WHEN s_suppkey % 2 = 0 THEN 'ambiguous' ELSE 'unmapped' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN 'db' WHEN s_suppkey % 3 = 0 THEN 'api' ELSE 'db' END AS source FROM supplier")(lambda t: strategy(t, "db_then_api"))
query("C28_mapping_log", "SELECT s_suppkey AS pos, CASE s_suppkey % 4 WHEN 0 THEN 'complex' WHEN 1 THEN 'protein' WHEN 2 THEN 'protein' ELSE 'compound' END AS route, CASE WHEN s_suppkey % 4 = 0 THEN 'skipped' WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 < 3 THEN 'mapped' ELSE 'unmapped' END AS status FROM supplier")(
    lambda t: K.mapping_log(t.proteins.select("pathway_id", "pos", F.when(C("pos") % 4 == 0, F.concat("name", F.lit(":x"))).when(C("pos") % 4 == 2, F.concat("name", F.lit(" kinase"))).otherwise(C("name")).alias("name"), F.lit("").alias("kind")), t.proteins.where("pos % 3 = 0").select(F.when(C("pos") % 4 == 2, F.concat("name", F.lit(" kinase"))).otherwise(C("name")).alias("name"), F.lit("protein").alias("route"), F.lit("x").alias("ids"), F.lit("mapped").alias("status")), t.proteins.where("pos % 4 = 1")).select("pos", "route", "status")
)
query("C29_flag_context", "SELECT user_id AS pathway_id, event_type AS subject, 'missing_ids' AS flag, (SELECT string_agg(concat(id, ' (', printf('%.2f', score), ')'), '; ' ORDER BY rn) FROM (SELECT CAST(event_id AS VARCHAR) AS id, value / 100 AS score, row_number() OVER (ORDER BY value / 100 DESC, CAST(event_id AS VARCHAR)) AS rn FROM events e WHERE e.event_type = x.event_type) WHERE rn <= 3) AS context FROM (SELECT DISTINCT user_id, event_type FROM events) x")(
    lambda t: K.flag_context(t.events.select(C("user_id").alias("pathway_id"), C("event_type").alias("subject"), F.lit("missing_ids").alias("flag")).distinct(), t.events.select(C("event_type").alias("subject"), C("event_id").cast("string").alias("id"), (C("value") / 100).alias("score")))
)
query("A12_lookup_cache", "SELECT concat('api::', lower(p_name), '::') AS key, CASE WHEN p_name < 'm' THEN 'old' ELSE 'new' END AS result, CASE WHEN p_name < 'm' THEN 'cache' ELSE 'call' END AS origin FROM part GROUP BY p_name")(
    lambda t: K.with_cache(t.part.select(K.cache_key("api", F.upper("p_name"), F.lit(None).cast("string")).alias("key")), t.part.where("p_name < 'm'").select(K.cache_key("api", C("p_name"), F.lit("")).alias("key"), F.lit("old").alias("result")).distinct(), lambda rest: rest.withColumn("result", F.lit("new")))[0]
)
query("A12_cache_counts", "SELECT count(DISTINCT p_name) FILTER (p_name < 'm') AS cache_hits, count(DISTINCT p_name) FILTER (p_name >= 'm') AS calls FROM part")(
    lambda t: K.with_cache(t.part.select(C("p_name").alias("key")), t.part.where("p_name < 'm'").select(C("p_name").alias("key"), F.lit("old").alias("result")).distinct(), lambda rest: rest.withColumn("result", F.lit("new")))[1]
)


@query("A12_keyed_cache", """SELECT DISTINCT concat('api::', lower(p_name), '::') AS key, CASE WHEN p_name >= 'f' AND p_name < 'm' THEN 'second' WHEN p_name < 'm' THEN 'first' ELSE 'third' END AS result FROM part WHERE p_size % 3 > 0""")
def _keyed(t):
    """Three runs over one cache, the second of which replaces what the first gave to some names; then the names that are asked for."""
    path = f"{shared_folder(t.spark)}/pathloom-cache-{uuid.uuid4().hex}"
    names = lambda df: df.select(K.cache_key("api", C("p_name"), F.lit("")).alias("key")).distinct()
    for version, (which, result) in enumerate((("p_name < 'm'", "first"), ("p_name >= 'f' and p_name < 'm'", "second"), ("p_name >= 'm'", "third"))):
        cache.upsert(names(t.part.where(which)).withColumn("result", F.lit(result)), path, version, buckets=64)
    cache.compact(t.spark, path, files=1)
    return cache.read(t.spark, path, names(t.part.where("p_size % 3 > 0")), buckets=64)


query("A13_enrichment_dump", "SELECT concat('compound:', p_name, '|', CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_type ELSE 'unmapped' END) AS key, arg_max(p_retailprice, p_partkey) AS summary, max(p_partkey) AS pos FROM part GROUP BY 1")(
    lambda t: K.enrichment_dump(t.part.select(F.lit("compound").alias("kind"), C("p_name").alias("name"), C("p_partkey").alias("pos"), C("p_retailprice").alias("summary"), F.create_map(F.lit("hmdb"), F.when(C("p_partkey") % 3 == 0, C("p_brand")).otherwise(" "), F.lit("kegg"), F.when(C("p_partkey") % 3 < 2, C("p_type")).otherwise("")).alias("mapped_ids")))
)
query("D21_enrich_mapped", "SELECT 'chebi' AS source, p_partkey % 2 = 0 AS ok, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'kegg', true, count(*) FROM part WHERE p_partkey % 3 = 0")(
    lambda t: K.enrich(t.part.select(C("p_partkey").alias("id"), F.create_map(F.lit("chebi"), C("p_partkey").cast("string"), F.lit("kegg"), F.when(C("p_partkey") % 3 == 0, F.concat(F.lit("cpd:c"), "p_partkey")).otherwise("")).alias("mapped_ids")), {"chebi": t.part.where("p_partkey % 2 = 0").select(F.concat(F.lit("CHEBI:"), "p_partkey").alias("ext"), C("p_retailprice").alias("mass")), "kegg": t.part.select(F.concat(F.lit("C"), "p_partkey").alias("ext"), C("p_retailprice").alias("mass"))}, {"chebi": N.chebi_id, "kegg": N.kegg_id}).groupBy("source", "ok").agg(F.count("*").alias("n"))
)
query("K11_fill_gaps", """SELECT s_nationkey AS pathway_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'own' WHEN s_suppkey % 3 = 0 THEN 'b' END AS ext, CASE WHEN s_suppkey % 4 = 0 THEN 'st' WHEN s_suppkey % 5 = 0 THEN 'AutoState_golgi' ELSE 'AutoState_cell' END AS state, CASE WHEN s_suppkey % 7 = 0 THEN 'own' WHEN s_nationkey % 2 = 0 THEN 'human' END AS organism FROM supplier""")(
    lambda t: K.fill_gaps(t.proteins.select("pathway_id", "name", F.when(C("id") % 2 == 0, "own").otherwise("").alias("ext"), F.when(C("id") % 4 == 0, "st").alias("state"), F.when(C("id") % 7 == 0, "own").otherwise(" ").alias("organism")), t.proteins.where("id % 3 = 0").select("name", F.explode(F.array(F.struct(F.lit("c").alias("id"), F.lit(0.5).alias("score")), F.struct(F.lit("b").alias("id"), F.lit(0.9).alias("score")))).alias("x")).select("name", "x.*"), t.proteins.where("id % 5 = 0").select("name", F.lit("golgi").alias("place"), F.lit(3).alias("n")), t.proteins.where("pathway_id % 2 = 0").select("pathway_id", F.lit("human").alias("organism")).distinct())
)
