import json

from pyspark.sql import functions as F

from pathloom.sources import cache as keyed
from pathloom.streaming import ingest


def write(folder, name, docs):
    (folder / name).write_text("\n".join(json.dumps(d) for d in docs))


def test_names_are_looked_up_once(spark, tmp_path):
    source, cache = tmp_path / "in", str(tmp_path / "cache")
    source.mkdir()
    doc = lambda p, *names: {"pathway_id": p, "entities": {"compounds": [{"name": n} for n in names]}, "processes": {"reactions": [{"inputs": list(names), "outputs": []}]}}
    asked = []

    def compute(df):
        asked.extend(sorted(r.key for r in df.collect()))
        return df.withColumn("result", F.upper("key"))

    run = lambda: ingest.lookup_new_names(ingest.documents(spark, str(source)), cache, str(tmp_path / "check"), compute).awaitTermination(120)
    write(source, "a.json", [doc("p", "ATP", "atp ", "water")])
    assert run()
    write(source, "b.json", [doc("q", "Water", "glucose", " ")])
    assert run()
    assert asked == ["catalogue::atp::", "catalogue::water::", "catalogue::glucose::"]
    assert {r.key: r.result for r in keyed.read(spark, cache).collect()} == {k: k.upper() for k in asked}


def test_stream_of_participants(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a.json", [{"pathway_id": "p", "processes": {"reactions": [{"inputs": ["a"], "outputs": ["b", "c"]}]}}])
    q = ingest.participants(ingest.documents(spark, str(source))).writeStream.format("memory").queryName("parts").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r.role, r.entity) for r in spark.table("parts").where("entity is not null").collect()} == {("reactant", "a"), ("product", "b"), ("product", "c")}
