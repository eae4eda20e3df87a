"""What round 3's findings were about, in the small."""

import os
import time

import duckdb
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.operators import export, graph, integrity, linking, patches, rewrite
from pathloom.plans import graph_queries, model_queries
from pathloom.plans.queries import ORACLES, QUERIES
from pathloom.plans.registry import Tables
from pathloom.sources import model_files, models


def test_distinct_names_of_a_long_list(spark):
    """the keys of 8,000 names were made anew for each of them."""
    values = [f"Name {i % 4000}{'!' * (i // 4000)}" for i in range(8000)] + ["?", None]
    df = spark.createDataFrame([(values,)], "a array<string>")
    start = time.monotonic()
    assert df.select(N.distinct_by(F.col("a"))).first()[0] == values[:4000]
    assert time.monotonic() - start < 30
    assert df.select(N.distinct_by(F.array(F.lit("b "), F.lit("A"), F.lit("B"), F.lit("a"), F.lit("c")), limit=2)).first()[0] == ["b ", "A"]


def test_search_terms_make_a_form_once(spark):
    """each form was written out anew wherever it is named, some hundred times in all."""
    df = spark.createDataFrame([("Alpha-beta  + x",), ("?",), (" ",), (None,)], "n string")
    plan = df.select(N.search_terms(F.col("n")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") < 40
    assert [r[0] for r in df.select(N.search_terms(F.col("n"))).collect()] == [["Alpha-beta + x", "Alpha-beta x", "Alpha beta + x", "Alpha beta x", "alphabetax"], ["?"], [], []]


def test_the_dearest_order_stays_in_the_twin_too(spark, tmp_path):
    """the twin's single number let keys of a million outweigh a price."""
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT * FROM (VALUES (1, 7, 'F', 10.00, 'x'), (2000001, 7, 'F', 10.01, 'x'), (3000001, 7, 'F', 10.01, 'x'), (5, 8, 'F', 3.0, 'x')) t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority)")
    con.execute(f"COPY (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority FROM orders) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    want = [(7, 2000001, 3), (8, 5, 1)]
    assert sorted(map(tuple, QUERIES["D02_dedupe_processes"](spark, str(tmp_path)).collect())) == want
    assert sorted(con.execute(ORACLES["D02_dedupe_processes"]).fetchall()) == want


def test_models_are_parsed_once_and_files_read_by_folder(spark, tmp_path):
    """Each table of a parsed model parsed all texts anew; a file was a split's worth of bytes to the reader."""
    texts = spark.createDataFrame([(i, f'<sbml><model id="m{i}"><listOfSpecies><species id="s" name="n" compartment="c"/></listOfSpecies></model></sbml>') for i in range(200)] + [(-1, "<x/>")], "pathway_id long, xml string").repartition(2)
    model_files.write(texts, str(tmp_path / "out"))
    files = model_files.read(spark, str(tmp_path / "out"))
    assert files.rdd.getNumPartitions() == 2
    assert sorted((r.source.rsplit("/", 1)[1], r.xml) for r in files.collect()) == sorted((f"{r.pathway_id}.xml".lstrip("._"), r.xml) for r in texts.collect())
    parsed = models.parse(texts, "pathway_id")
    species = models.species(parsed, "pathway_id")
    assert species.count() == 200 and models.failures(parsed, "pathway_id").count() == 1
    assert "from_xml" not in species._jdf.queryExecution().optimizedPlan().toString()


def test_course_counts_what_its_gates_stop(spark):
    """species and references of pathways that a gate stops were left out of the course's counts."""
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    all_names = con.execute("""WITH p AS (SELECT o_custkey AS k, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 < 8)
        SELECT count(*) FROM (SELECT k, concat('c', l_partkey) AS n FROM p UNION SELECT k, concat('p', l_suppkey) FROM p UNION SELECT p_size * 7, p_name FROM part WHERE p_size * 7 % 10 < 8 AND p_size * 7 IN (SELECT k FROM p))""").fetchone()[0]
    assert dict(con.execute(ORACLES["plan_model_course"]).fetchall())["species"] == all_names


def test_byproducts_are_looked_up_in_texts(spark):
    """every complex was compared with every text of its pathway."""
    names = [f"P{i}:water" for i in range(4000)] + ["Q + r:Water", "Lone:water", "P1:glucose"]
    complexes = spark.createDataFrame([(1, n) for n in names] + [(2, "P1:water")], "pathway_id int, name string")
    texts = [f"here p{i}  +WATER." for i in range(0, 4000, 2)] + ["so q + R+water", "lone bound to water", "plain", "plain"]
    evidence = spark.createDataFrame([(1, x) for x in texts] + [(2, "none")], "pathway_id int, evidence string")
    start = time.monotonic()
    got = {tuple(r) for r in rewrite.byproduct_complexes(complexes, evidence).collect()}
    assert got == {(1, f"P{i}:water") for i in range(1, 4000, 2) if i < 10000} - spelled(texts, names) | {(1, "Lone:water"), (2, "P1:water")}
    assert time.monotonic() - start < 60


def spelled(texts, names):
    """By brute force: the complexes that a text spells out."""
    import re

    tight = [re.sub(r"\s*\+\s*", "+", x).lower() for x in texts]
    return {(1, n) for n in names if n.startswith("P") and any(f"{n.split(':')[0].lower()}+{n.split(':')[1].lower()}" in x for x in tight)}


def test_a_term_picks_its_gram_once(spark):
    """Terms were unfolded to their grams under each key that they stand under, and given to sixteen salts."""
    terms = spark.createDataFrame([(k, t) for k in range(50) for t in ("abcdef", "bcd", "ab")], "k int, term string")
    texts = spark.createDataFrame([(k, k * 10 + i, x) for k in range(50) for i, x in enumerate(("xABCDEFx", "bcd", "a b"))], "k int, id int, text string")
    want = {(k, t, k * 10 + i) for k in range(50) for t, i in (("abcdef", 0), ("bcd", 0), ("ab", 0), ("bcd", 1))}
    assert {tuple(r) for r in linking.containing(terms, texts, ("k",)).collect()} == want
    given, linking.GIVEN_TERMS = linking.GIVEN_TERMS, 10
    try:
        got = linking.containing(terms, texts, ("k",))
        assert {tuple(r) for r in got.collect()} == want and "_salt" not in got._jdf.queryExecution().analyzed().toString()
    finally:
        linking.GIVEN_TERMS = given


def test_hits_of_a_variant_are_aggregated_before_they_meet(spark):
    """all hits of a name met each other in one task."""
    hits = spark.createDataFrame([("n", i % 2, "d", str(i % 3), 0.5 + (i % 5) / 10) for i in range(3000)], "name string, v int, db string, ext string, score double")
    got = linking.from_catalogues(hits)
    assert sorted(map(tuple, got.collect())) == [("n", "d", str(i), 0.9) for i in range(3)]
    plan = got._jdf.queryExecution().analyzed().toString()
    join = plan.index("Join Inner")
    assert plan[join:].count("Aggregate [name") >= 2


def test_draft_joins_its_tables_once(spark):
    """the draft joined lines, orders, parts and suppliers anew for each of its five tables."""
    nodes, edges = graph_queries.draft(Tables(spark, "/root/testdata/sf0.001"))
    for df in (nodes, edges):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "l_partkey" not in plan and "s_suppkey" not in plan


def test_orphans_read_the_edges_once(spark):
    """the ends of edges were found by making the edges twice."""
    nodes = spark.createDataFrame([(1, x) for x in "abc"], "pathway_id int, id string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "pathway_id int, source string, target string").distinct()
    lost = graph.orphan_nodes(nodes, edges)
    assert [r.id for r in lost.collect()] == ["c"]
    assert lost._jdf.queryExecution().analyzed().toString().count("target#") > 0 and "Union" not in lost._jdf.queryExecution().analyzed().toString()


def test_payloads_are_shredded_once(spark):
    """each list of a payload made and parsed all documents anew."""
    plan = model_queries.shredded(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "parse_json" not in plan and "l_orderkey" not in plan


def test_normalise_keeps_its_results_alone(spark):
    """all tables between the steps stayed on the disk, and the shuffle files behind them."""
    from urllib.parse import urlparse

    from pathloom.plans.durable import shared_folder
    from pathloom.plans.lifecycle_queries import course

    folder = urlparse(shared_folder(spark)).path
    before = set(os.listdir(folder))
    out = course(Tables(spark, "/root/testdata/sf0.001"))
    tables = [x for x in set(os.listdir(folder)) - before if x.startswith("pathloom-")]
    assert len(tables) <= 16
    for k in ("entities", "processes", "transports", "participants", "states", "locations", "issues", "passed", "set_aside", "adjacency"):
        out[k].count()  # none reads a table that went


def test_species_are_made_once(spark):
    """species and references carried the whole course behind their names' places, each several times over."""
    entities = spark.createDataFrame([(1, 0, "A"), (1, 1, "b")], "pathway_id int, pos long, name string")
    used = spark.createDataFrame([(1, 7, "reactant", "a"), (1, 7, "product", "C")], "pathway_id int, process int, role string, entity string")
    places = spark.createDataFrame([(1, "a", "nucleus")], "pathway_id int, entity string, place string")
    comps, spec, refs = export.model_tables(entities, used, places)
    assert sorted(map(tuple, comps.collect())) == [(1, "c1", "cell"), (1, "c2", "nucleus")]
    assert sorted(map(tuple, spec.collect())) == [(1, "s1", "A", "c2"), (1, "s2", "b", "c1"), (1, "s3", "C", "c1")]
    assert sorted(map(tuple, refs.collect())) == [(1, 7, "product", "s3"), (1, 7, "reactant", "s1")]
    for df in (comps, spec, refs):
        plan = df._jdf.queryExecution().analyzed().toString()
        assert "min_by" not in plan and plan.count("Join") <= 1


def test_gates_look_names_up_once(spark):
    """each gate made its names' normal forms and joined them anew, and edges were turned round for their ends."""
    used = spark.createDataFrame([(1, 1, "A-b"), (1, 1, "?"), (1, 1, None), (1, 2, "x + y"), (1, 2, "Gone"), (1, 2, "gone"), (2, 3, "A b")], "pathway_id int, process int, entity string")
    actors = spark.createDataFrame([(1, 1, "TG"), (1, 1, "none"), (2, 3, "P")], "pathway_id int, process int, actor string")
    registry = spark.createDataFrame([(1, "compound", "ab"), (1, "protein", "P"), (1, "protein", "tg"), (1, "protein", None), (1, "compound", "x y"), (2, "protein", "p"), (2, "protein", "a b")], "pathway_id int, kind string, name string")
    scaffolds = spark.createDataFrame([(1, "tg")], "pathway_id int, norm string")
    adj = graph.adjacency(used, actors)
    want = {(1, "composite_token", "x + y"), (1, "unknown_participant", "Gone"), (1, "unknown_participant", "gone"), (1, "unknown_participant", "x + y"), (1, "unknown_actor", "none"), (1, "scaffold_as_modifier", "TG"), (1, "isolated_protein", "P"), (1, "isolated_protein", None)}
    for links in (adj, graph.ends(used, actors)):
        got = integrity.strict_gates(used, actors, registry, scaffolds, links)
        rows = [(r.pathway_id, r.rule, r.subject) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        assert got._jdf.queryExecution().analyzed().toString().count("Join") == 1


def test_runs_are_given_once_for_a_list(spark):
    """each list's state, with its whole log, was given 32 times to its rows, and patches were joined with their own outcomes."""
    rows = spark.createDataFrame([(1, i, f"n{i}") for i in range(7)] + [(2, 0, "only")], "pathway_id int, pos long, name string")
    todo = spark.createDataFrame([(1, 1, "remove", "/0", None), (1, 2, "replace", "/5/name", "new"), (1, 3, "add", "/1", '{"name": "x"}'), (1, 4, "remove", "/9", None), (3, 1, "add", "/-", '{"name": "first"}')], "pathway_id int, seq long, op string, path string, value string")
    size, patches.ROWS_A_TASK = patches.ROWS_A_TASK, 2
    try:
        out, report = patches.apply_in_order(rows, todo, ["name"])
        names = ["n1", "x", "n2", "n3", "n4", "n5", "new"]
        assert sorted(map(tuple, out.collect())) == [(1, i, n) for i, n in enumerate(names)] + [(2, 0, "only"), (3, 0, "first")]
        assert sorted((r.pathway_id, r.seq, r.reason) for r in report.collect()) == [(1, 1, "applied"), (1, 2, "applied"), (1, 3, "applied"), (1, 4, "out_of_range"), (3, 1, "applied")]
    finally:
        patches.ROWS_A_TASK = size
    assert "_salt" not in out._jdf.queryExecution().analyzed().toString()


def test_edges_are_made_distinct_before_they_are_turned(spark):
    """one task's distinct held its share of all kinds of edges in both directions."""
    used = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "b")], "pathway_id int, process int, entity string")
    moves = spark.createDataFrame([(1, 3, "a", "in", "in"), (1, 4, "a", None, "out")], "pathway_id int, process int, cargo string, from_state string, to_state string")
    acts = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "c", "c")], "pathway_id int, entity_1 string, entity_2 string")
    got = graph.adjacency(used, used.withColumnRenamed("entity", "actor"), None, moves, acts)
    one = {("entity:a", "process:1"), ("entity:b", "process:2"), ("actor:a", "process:1"), ("actor:b", "process:2"), ("at:a:in", "process:3"), ("at:a:out", "process:4"), ("entity:a", "entity:b")}
    rows = [(r.a, r.b) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == one | {(b, a) for a, b in one}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")
