"""What round 4's findings were about, in the small."""

import os

import pytest
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.operators import graph, integrity, linking
from pathloom.plans import export_queries, graph_queries
from pathloom.plans.durable import durable, kept, shared_folder
from pathloom.plans.registry import Tables
from pathloom.plans.skew import salted_join
from pathloom.sources import model_files, models


@pytest.fixture
def threshold(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_salted_rows_are_not_broadcast_by_the_size_of_the_unsalted(spark, threshold):
    """2,000 rows of 16 bytes were under the threshold, and the 64,000 that they are with salts went through the driver."""
    large = durable(spark.range(40_000).select((F.col("id") % 2000).alias("c"), F.col("id").alias("fp"), F.hash("id").alias("x")))
    small = durable(large.groupBy("c").agg(F.min("fp").alias("least")))
    got = salted_join(large, small, ["c"])
    assert {(r.c, r.least) for r in got.collect()} == {(i, i) for i in range(2000)} and got.count() == 40_000
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    for salts in (1, 5, 8, 20):
        assert sorted(salted_join(large.where("fp < 100"), small, ["c"], salts=salts).select("fp", "least").collect()) == [(i, i) for i in range(100)]


def test_few_terms_of_a_key_meet_its_texts_without_grams(spark, monkeypatch):
    """each text was taken apart into grams, also where its pathway has a handful of terms."""
    terms = [("few", "Ab"), ("few", "ab"), ("few", "ß c"), ("few", None), ("none", "x"), (None, "ab")] + [("many", f"t{i} ") for i in range(80)]
    texts = [("few", 1, "xAB"), ("few", 1, "xAB"), ("few", 2, "ß c"), ("few", 3, None), ("few", 4, ""), (None, 5, "ab"), ("many", 6, "t7 and T70 "), ("many", 7, "ab")]
    t, x = spark.createDataFrame(terms, "k string, term string"), spark.createDataFrame(texts, "k string, id long, text string")
    want = [("few", "ab", 1), ("few", "ß c", 2)]
    for given in (linking.GIVEN_FEW, 0):
        monkeypatch.setattr(linking, "GIVEN_FEW", given)
        assert sorted(map(tuple, linking.containing(t, x, ("k",)).collect())) == sorted([*want, ("many", "t7 ", 6), ("many", "t70 ", 6)])
    got = linking.containing(t.where("k = 'few'"), x, ("k",))
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want


def test_promoted_interactions_read_names_that_were_made_once(spark):
    """names of steps were worked out again by each of the jobs that read them."""
    acts = spark.createDataFrame([(1, 1, "P-1", "inhibits", "Step  one"), (1, 2, "p1", "carries", "before step one!"), (1, 3, "p1", "x", "?"), (1, 4, "q", "x", "step one"), (2, 1, "p1", "x", "step one"), (1, 5, "p1", "x", "elsewhere"), (1, 6, "p1", "x", None)], "pathway_id long, pos long, entity_1 string, relationship string, entity_2 string")
    steps = spark.createDataFrame([(1, 10, "step one"), (1, 11, "Step one"), (1, 12, " ")], "pathway_id long, process long, name string")
    made, left = integrity.promote_interactions(acts, steps, spark.createDataFrame([(1, "P1"), (2, "other")], "pathway_id long, actor string"))
    assert sorted((r.process, r.pos, r.actor, r.role) for r in made.collect()) == [(10, 1, "P-1", "inhibitor"), (10, 2, "p1", "transporter")]
    assert sorted((r.pathway_id, r.pos) for r in left.collect()) == [(1, 3), (1, 4), (1, 5), (1, 6), (2, 1)]
    assert "regexp_replace" not in left._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def few_orders(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("few"))
    spark.createDataFrame([(i, f"name {i % 3}", "B", "T", i % 4) for i in range(6)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(i, f"Supplier {i}") for i in range(4)], "s_suppkey long, s_name string").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(i, i % 3, "F", 1.0, "low" if i % 2 else "high") for i in range(8)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(i % 8, i % 6, i % 4, 1 + i // 8, 2.0) for i in range(24)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return Tables(spark, d)


def folders(spark):
    return {x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith("pathloom-")}


def test_flags_keep_one_copy_of_the_draft(spark, few_orders):
    """nodes and edges were written twice, and the table that they stand on stayed."""
    before = folders(spark)
    nodes, edges = graph_queries.odd(few_orders)
    assert len(folders(spark) - before) == 2
    assert kept(nodes) is nodes and kept(edges) is edges and kept(nodes.where("true")) is not nodes
    before = folders(spark)
    flags = graph.qa_flags(nodes, edges)
    assert len(folders(spark) - before) == 2  # edges with their sources' names, and what is of the wrong class
    assert {r.flag for r in flags.collect()} >= {"missing_compartments", "transport_like_reactions"}


def test_classes_of_reactions_need_no_names_of_references(spark):
    """all references were joined with their species' names, and again with their places."""
    xml = '<sbml><model id="m"><listOfSpecies><species id="a" name="X" compartment="k1"/><species id="b" name="x" compartment="k2"/><species id="d" name="X" compartment="k1"/><species id="d" name="X" compartment="k3"/></listOfSpecies><listOfReactions>{}</listOfReactions></model></sbml>'
    one = '<reaction id="{}"><listOfReactants><speciesReference species="{}"/></listOfReactants><listOfProducts><speciesReference species="{}"/></listOfProducts></reaction>'
    m = models.parse(spark.createDataFrame([("s", xml.format("".join(one.format(*x) for x in (("r1", "a", "b"), ("r2", "a", "a"), ("r3", "d", "b"), ("r4", "a", "none")))))], "source string, xml string"))
    tables = [models.classified(models.reactions(m), models.references(m, named=named), models.species(m)) for named in (True, False)]
    assert [sorted((r.reaction, r.kind) for r in x.collect()) for x in tables] == [[("r1", "transport"), ("r2", "reaction"), ("r3", "reaction"), ("r4", "reaction")]] * 2
    joins = [x._jdf.queryExecution().optimizedPlan().toString().count("Join ") for x in tables]
    assert joins[1] < joins[0]


def test_model_files_are_written_from_a_table(few_orders, monkeypatch):
    """F8: the files came while all that made their texts still lay on the disk."""
    plans, write = [], model_files.write
    monkeypatch.setattr(model_files, "write", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, *a)))
    got = export_queries.reread(few_orders)
    assert got.count() == 3 and got.where("model is null").count() == 0
    assert len(plans) == 1 and "Join" not in plans[0] and "Aggregate" not in plans[0]


def test_normal_forms_are_made_once_for_a_join(spark):
    """conditions that Spark infers on a join's key worked the normal form out again, up to three times a row."""
    used = spark.createDataFrame([(1, "a b"), (1, "A  b"), (1, "a:b"), (1, " x"), (1, ""), (1, None), (1, "ß\n"), (1, "c1 ")], "pathway_id long, entity string")
    registry = spark.createDataFrame([(1, "A b"), (1, "?"), (2, "x")], "pathway_id long, name string")
    got = integrity.unknown_references(used, registry)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 4
    assert sorted(r.entity for r in got.collect()) == [" x", "a:b", "c1 ", "ß\n"]
    forms = used.select(N.norm(F.col("entity")).alias("n"), N.norm_with_colon(F.col("entity")).alias("c")).collect()
    assert [tuple(r) for r in forms] == [("a b", "a b"), ("a b", "a b"), ("ab", "a:b"), ("x", "x"), ("", ""), (None, None), ("ss", "ss"), ("c1", "c1")]
