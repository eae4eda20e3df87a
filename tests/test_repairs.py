"""Patches to every list of a payload, and the course with patches given and a catalogue of proteins."""

import json

from pyspark.sql import functions as F

from pathloom.operators import audit
from pathloom.plans import course
from pathloom.plans.durable import scratch
from pathloom.plans.repairs import BROUGHT, repair

DOC = {
    "entities": {"compounds": [{"name": "glucose"}, {"name": " "}, {"name": "g6p"}, {"name": None}], "proteins": [{"name": "hexokinase"}]},
    "biological_states": [{"name": "s1", "subcellular_location": "cytosol"}, {"name": "s2"}],
    "element_locations": {"compound_locations": [{"compound": "glucose", "biological_state": "s1"}], "protein_locations": [{"protein": "hexokinase", "biological_state": "s1"}]},
    "processes": {
        "reactions": [{"name": "r1", "inputs": ["glucose"], "outputs": ["g6p"], "biological_state": "s1", "enzymes": [{"protein": "hexokinase"}]}, {"name": "still", "inputs": ["g6p"], "outputs": ["g6p"]}, {"name": "r3", "inputs": ["g6p"], "outputs": ["glucose"], "enzymes": [{"protein": "phosphatase"}]}],
        "transports": [{"name": "t", "cargo": "glucose", "from_biological_state": "s1", "to_biological_state": "s1", "transporters": [{"protein": "GLUT4"}]}],
        "interactions": [{"entity_1": "hexokinase", "relationship": "binds", "entity_2": "g6p"}],
    },
}


def patches(spark, rows):
    return spark.createDataFrame([("p", i, *r) for i, r in enumerate(rows)], "pathway_id string, seq long, op string, path string, value string")


def test_each_list_takes_its_patches(spark):
    with scratch():
        raw = course.shredded(spark.createDataFrame([("p", json.dumps(DOC)), ("q", json.dumps(DOC)), ("r", "{}")], "id string, json string"))
        got, report = repair(raw, patches(spark, [
            ("add", "/entities/proteins/0", '{"name": "phosphatase"}'), ("replace", "/entities/proteins/1/name", "Hexokinase"), ("remove", "/entities/compounds/1", None), ("add", "/entities/tissues/-", '{"name": "muscle"}'),
            ("add", "/biological_states/1/subcellular_location", "membrane"), ("replace", "/biological_states/0/species", "x"), ("add", "/element_locations/protein_locations/-", '{"protein": "GLUT4", "biological_state": "s2", "evidence": "e"}'), ("replace", "/element_locations/compound_locations/0/compound", "g6p"),
            ("add", "/processes/reactions/0", '{"name": "first", "inputs": ["a"], "outputs": ["b", " "], "process": "7"}'), ("add", "/processes/reactions/3/inputs/-", "water"), ("remove", "/processes/reactions/2", None), ("replace", "/processes/transports/0/to_biological_state", "s2"), ("replace", "/processes/transports/0/cargo", "lactate"),
            ("replace", "/processes/interactions/0/entity_2", "glucose"), ("add", "/processes/other/-", "{}"), ("replace", "/entities/compounds", "[]"), ("replace", "/processes/reactions/9/name", "x"), ("replace", "/processes/transports/0/_row", "5"),
        ]), turn=1)
        went = {r.seq: r.reason for r in report.collect()}
        assert len(went) == 18 and {k: v for k, v in went.items() if v != "applied"} == {5: "unknown_field", 14: "no_such_list", 15: "whole_list", 16: "out_of_range", 17: "unknown_field"}
        of = lambda name, p="p": got[name].where(F.col("pathway_id") == p)
        assert {(r.kind, r.pos, r.name) for r in of("entities").collect()} == {("compound", 0, "glucose"), ("compound", 1, "g6p"), ("compound", 2, None), ("protein", 0, "phosphatase"), ("protein", 1, "Hexokinase"), ("tissue", 0, "muscle")}
        assert {(r.name, r.place) for r in of("states").collect()} == {("s1", "cytosol"), ("s2", "membrane")}
        assert {(r.kind, r.entity, r.state) for r in of("locations").collect()} == {("compound", "g6p", "s1"), ("protein", "hexokinase", "s1"), ("protein", "GLUT4", "s2")}
        new = BROUGHT + (1 << 20) + 1
        assert {(r.pos, r.process, r.name, tuple(r.inputs)) for r in of("reactions").collect()} == {(0, new, "first", ("a",)), (1, 0, "r1", ("glucose",)), (2, 2, "r3", ("g6p", "water"))}
        assert {(r.process, r.role, r.entity) for r in of("participants").where(F.col("process") < 1 << 30).collect()} == {(new, "reactant", "a"), (new, "product", "b"), (0, "reactant", "glucose"), (0, "product", "g6p"), (0, "modifier", "hexokinase"), (2, "reactant", "g6p"), (2, "reactant", "water"), (2, "product", "glucose"), (2, "modifier", "phosphatase")}
        assert {(r.role, r.entity) for r in of("participants").where(F.col("process") >= 1 << 30).collect()} == {("cargo", "lactate"), ("transporter", "GLUT4")}
        assert [(r.to_state, r.cargo) for r in of("transports").collect()] == [("s2", "lactate")] and [r.entity_2 for r in of("interactions").collect()] == ["glucose"]
        # a pathway without patches stays as it is
        for name in ("entities", "states", "locations", "reactions", "transports", "interactions", "participants"):
            assert sorted(map(str, of(name, "q").collect())) == sorted(map(str, raw[name].where("pathway_id = 'q'").collect())), name
        same, none = repair(raw, patches(spark, [("add", "/x", "{}")]).limit(0))
        assert none.count() == 0 and all(same[k] is raw[k] for k in raw)


def test_course_with_given_patches_and_proteins(spark):
    offered = [{"action": "replace", "path": "/processes/transports/0/to_biological_state", "new_value": "s2", "confidence": 0.9}, {"op": "add", "path": "/entities/proteins/-", "value": {"name": "phosphatase"}, "confidence": 0.8}, {"op": "replace", "path": "/processes/reactions/7/name", "value": "x", "confidence": 0.9}, {"op": "remove", "path": "/processes/reactions/0", "confidence": 0.99, "reason": "e"}]
    given = audit.normal_patches(spark.createDataFrame([(p, i, json.dumps(x)) for p in ("p", "elsewhere") for i, x in enumerate(offered)], "pathway_id string, seq int, json string"))
    texts = spark.createDataFrame([("p", json.dumps(DOC))], "id string, json string")
    compounds = spark.createDataFrame([(1, "glucose", "", "")], "id long, name string, short_name string, synonyms string")
    proteins = spark.createDataFrame([("P1", "Hexokinase", "HK1", "", "P19367"), ("P2", "glut4", "", "", None)], "id string, name string, short_name string, synonyms string, accession string")
    with scratch():
        got = course.model(texts, compounds, proteins=proteins, given=given)
        first = {r.path: r.reason for r in got["patches"].where("round = -1").collect()}
        assert first == {offered[0]["path"]: "applied", offered[1]["path"]: "applied", offered[2]["path"]: "out_of_range", offered[3]["path"]: "core_removal"}
        later = {(r.op, r.path, r.reason) for r in got["patches"].where("round = 0").collect()}
        # the reaction that does nothing, and two entities without a name, the last first
        assert later == {("remove", "/processes/reactions/1", "applied"), ("remove", "/entities/compounds/1", "applied"), ("remove", "/entities/compounds/3", "applied")}
        assert [(r.reason, r.round) for r in got["stops"].collect()] == [("clean", 1)]
        assert {(r.kind, r.name, r.id) for r in got["mapped"].where("status = 'mapped'").collect()} == {("compound", "glucose", "1"), ("protein", "hexokinase", "P1"), ("protein", "GLUT4", "P2")}
        assert {(r.name, r.ref_id) for r in got["species"].where("ref_id is not null").collect()} == {("glucose", "1"), ("hexokinase", "P1"), ("GLUT4", "P2")}
