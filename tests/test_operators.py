"""Small fixtures with results worked out by hand."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import audit, graph, linking, merge, rewrite, text
from pathloom.operators.components import connected_components
from pathloom.plans import course
from pathloom.plans.durable import durable, scratch, shared_folder
from pathloom.plans.lifecycle import normalise
from pathloom.sources import models, payload, sinks


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == got[102] == 100 and got[200] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    star = [("hub", f"n{i:03}") for i in range(300)]
    assert {r.component for r in connected_components(spark.createDataFrame(star, "a string, b string")).collect()} == {"hub"}


def test_components_of_pathways_by_either_way(spark):
    rows = [(p, f"n{i}", f"n{i + 1}") for p in range(30) for i in range(p) if i % 7 != 3] + [(99, "x", "x")]
    adj = spark.createDataFrame(rows, "pathway_id long, a string, b string")
    a = {(r.pathway_id, r.node): r.component for r in graph.components(adj).collect()}
    b = {(r.pathway_id, r.node): r.component for r in graph.components(adj, most=9).collect()}
    assert a == b and a[99, "x"] == "x" and a[29, "n12"] == min(f"n{i}" for i in range(11, 18) if i > 10)
    assert graph.components(adj.limit(0)).count() == 0


SCAFFOLD = {
    "entities": [("compound", 0, "iodide"), ("compound", 1, "tyrosine"), ("compound", 2, "thyroglobulin + iodotyrosine"), ("protein", 0, "Thyroglobulin"), ("protein", 1, "Thyroid Peroxidase"), ("compound", 3, "nad")],
    "processes": [(1, "iodination", None, "thyroglobulin + iodotyrosine is made"), (2, "iodination again", None, "thyroglobulin + iodotyrosine is made"), (3, "stay", "s", ""), (4, "odd", "s", "")],
    "participants": [
        (1, "reactant", 0, "thyroglobulin"), (1, "reactant", 1, "iodide"), (1, "reactant", 2, "Thyroid peroxidase"), (1, "product", 0, "Thyroglobulin + iodotyrosine"),
        (2, "reactant", 0, "iodide"), (2, "reactant", 1, "thyroglobulin"), (2, "modifier", 0, "Thyroid peroxidase"), (2, "product", 0, "Thyroglobulin + iodotyrosine"),
        (3, "reactant", 0, "NAD"), (3, "product", 0, "nad+"), (4, "reactant", 0, "nad"), (4, "product", 0, "sugar + salt"),
    ],
}


def test_default_course(spark):
    p = lambda rows, ddl: spark.createDataFrame([("p", *r) for r in rows], "pathway_id string, " + ddl)
    steps = [(k, k, n, s, e) for k, n, s, e in SCAFFOLD["processes"]]
    got = normalise(p(SCAFFOLD["entities"], "kind string, pos long, name string"), p(steps, "process long, pos long, name string, state string, evidence string"), p(SCAFFOLD["participants"], "process long, role string, pos int, entity string"), p([("s", "cell")], "name string, place string"))
    kept = got["processes"].collect()
    # the second iodination repeats the first; one reaction does nothing; the composite without a protein has lost its side
    assert {r.process: bool(r.outputs) for r in kept} == {1: True, 4: False}
    used = got["participants"].where("process = 1").collect()
    assert {(r.role, r.entity) for r in used} == {("reactant", "thyroglobulin"), ("reactant", "iodide"), ("modifier", "Thyroid Peroxidase"), ("product", "Thyroglobulin:iodotyrosine")}
    assert not [r for r in got["participants"].collect() if " + " in r.entity]
    names = {(r.kind, r.name) for r in got["entities"].collect()}
    assert ("protein_complex", "Thyroglobulin:iodotyrosine") in names and ("compound", "NAD+") in names
    assert [r.rule for r in got["issues"].collect()] == ["composite_without_protein"]
    assert got["passed"].count() == 0 and got["set_aside"].first().errors == 1
    assert next(r.state for r in kept if r.process == 1) is None  # nothing says where it is


def test_scaffolds_take_what_is_left(spark):
    """Two scaffolds that the text binds to both products take one each; a by-product needs an exact composite."""
    ev = "sa + x; sa + y; sb bound to x; sb + y; sc bound to water; sd + water; se bound to x"
    rows = [(1, 0, "sa"), (1, 1, "sb"), (1, 2, "sc"), (1, 3, "sd"), (1, 4, "se"), (1, 5, "x"), (1, 6, "y"), (1, 7, "water"), (1, 8, "sa:z"), (2, 0, "sb"), (2, 1, "x")]
    out = spark.createDataFrame([("p", *r, ev) for r in rows], "pathway_id string, process int, pos int, entity string, evidence string")
    sc = spark.createDataFrame([("p", f"s{c}") for c in "abcde"], "pathway_id string, norm string")
    got = rewrite.bind_scaffolds(out, sc)
    assert {(r.process, r.complex, r.score) for r in got.collect()} == {(1, "sa:x", 2), (1, "sb:y", 2), (1, "sd:water", 2), (2, "sb:x", 1)}
    used, made = rewrite.apply_scaffolds(out.withColumn("role", F.lit("product")).drop("evidence"), got)
    assert sorted(r.entity for r in used.where("process = 1").collect()) == ["sa:x", "sa:z", "sb:y", "sc", "sd:water", "se"]
    assert {r.name for r in made.collect()} == {"sa:x", "sb:y", "sd:water", "sb:x"}
    one = spark.createDataFrame([("p", "sb", "x")], "pathway_id string, a string, name string").select("pathway_id", "name")
    assert {r.complex for r in rewrite.bind_scaffolds(out, sc, one).where("process = 1").collect()} == {"sa:y", "sd:water"}


def test_hormone_course(spark):
    """Iodination of a scaffold, worked out by hand: composites, a split output, repeated rows, actors of old spelling, transports."""
    p = lambda rows, ddl: spark.createDataFrame([("h", *r) for r in rows], "pathway_id string, " + ddl)
    tg, tpo = "thyroglobulin", "thyroid peroxidase"
    ents = [("compound", i, n) for i, n in enumerate([f"{tg} + iodotyrosine", tg, "iodide", "hydrogen peroxide", "2-aminoacrylic acid", "liothyronine", "thyroxine"])] + [("protein", 0, tpo), ("protein", 1, "pendrin")]
    steps = [(0, "R0", "observed"), (1, "R0", "short"), (2, "R1", "observed"), (3, "R2", ""), (4, "R3", f"{tg} + liothyronine is catalyzed by {tpo} to produce {tg} + thyroxine")]
    ins = {0: [tg, "iodide", "hydrogen peroxide", tpo], 1: [tg, "iodide", "hydrogen peroxide", tpo], 2: [f"{tg} + iodotyrosine", "iodide", "hydrogen peroxide", tpo], 3: [f"{tg} + 3,5-diiodo-L-tyrosine", "hydrogen peroxide", tpo], 4: [f"{tg} + liothyronine", tpo]}
    outs = {0: [f"{tg} + iodotyrosine"], 1: [f"{tg} + iodotyrosine"], 2: [f"{tg} + 3,5-diiodo-L-tyrosine"], 3: [f"{tg}+liothyronine", "2-aminoacrylic acid", tg, "liothyronine"], 4: [f"{tg} + thyroxine"]}
    used = [(k, "reactant", i, e) for k, x in ins.items() for i, e in enumerate(x)] + [(k, "product", i, e) for k, x in outs.items() for i, e in enumerate(x)] + [(2, "modifier", 0, "thyroid_peroxidase_complex")]
    used += [(10, "cargo", 0, "iodide"), (10, "transporter", 0, "pendrin_complex"), (11, "cargo", 0, f"{tg} + liothyronine"), (12, "cargo", 0, f"{tg}+liothyronine")]
    moves = [(10, "blood", "luminal", f"{tg} is joined by iodide that has been transported from the blood using pendrin"), (11, "luminal", "luminal", f"{tg} + liothyronine complex transport"), (12, "luminal", "luminal", f"{tg} + liothyronine complex transport")]
    got = normalise(
        p(ents, "kind string, pos long, name string"), p([(k, k, n, None, e) for k, n, e in steps], "process long, pos long, name string, state string, evidence string"), p(used, "process long, role string, pos int, entity string"),
        p([("luminal", "follicular lumen"), ("blood", "bloodstream")], "name string, place string"),
        locations=p([(0, "iodide", "luminal", ""), (1, tpo, "luminal", ""), (2, "pendrin", "luminal", "iodide is transported through pendrin"), (3, "thyroxine", None, "")], "pos long, entity string, state string, evidence string"),
        transports=p([(k, k, *x) for k, *x in moves], "process long, pos long, from_state string, to_state string, evidence string"),
    )
    names = {(r.kind, r.name) for r in got["entities"].collect()}
    assert {n for k, n in names if k == "protein_complex"} >= {f"{tg}:iodotyrosine", f"{tg}:3,5-diiodo-L-tyrosine", f"{tg}:liothyronine", f"{tg}:thyroxine"}
    assert (("protein_complex", f"{tg}:2-aminoacrylic acid")) not in names and not [n for _, n in names if "+" in n]
    kept = {r.process: r for r in got["processes"].collect()}
    assert set(kept) == {0, 2, 3, 4}
    assert all(tpo not in r.inputs and r.modifiers == [tpo] for r in kept.values())
    assert kept[0].state == "luminal" and not [x for r in kept.values() for x in (*r.inputs, *r.outputs) if "+" in x]
    moved = {r.process: (r.cargo, r.transporters) for r in got["transports"].collect()}
    assert len(moved) == 2 and moved[10] == ("iodide", ["pendrin"]) and moved[11][0] == f"{tg}:liothyronine"
    assert {r.name for r in got["states"].collect()} == {"luminal", "blood", "__auto_state__"}
    assert [r.rule for r in got["issues"].collect()] == [] and [r.pathway_id for r in got["passed"].collect()] == ["h"]


def test_ranks(spark):
    n = spark.createDataFrame([("p", x) for x in "abcdef"] + [("q", "x"), ("q", "y"), ("r", "z")], "pathway_id string, node string")
    e = spark.createDataFrame([("p", *x) for x in ("ab", "bc", "ac", "de", "ed", "ef", "aa", "?b", "c?")] + [("q", "x", "y"), ("q", "y", "x")], "pathway_id string, source string, target string")
    want = {("p", "a"): (0, False), ("p", "b"): (1, False), ("p", "c"): (2, False), ("p", "d"): (3, True), ("p", "e"): (3, True), ("p", "f"): (3, True), ("q", "x"): (0, True), ("q", "y"): (0, True), ("r", "z"): (0, False)}
    for most in (10**6, 1):
        assert {(r.pathway_id, r.node): (r.rank, r.in_cycle) for r in graph.topological_ranks(n, e, most).collect()} == want
    long = spark.range(5000).selectExpr("'p' AS pathway_id", "id AS node")
    step = spark.range(4999).selectExpr("'p' AS pathway_id", "id AS source", "id + 1 AS target")
    got = graph.topological_ranks(long, step).agg({"rank": "max", "in_cycle": "max"}).first()
    assert tuple(got) in ((4999, False), (False, 4999))


def test_same_as_prefers_actors(spark):
    e = spark.createDataFrame([("p", "enzyme x", "EX"), ("p", "EX", "ex protein")], "pathway_id string, a string, b string")
    u = spark.createDataFrame([("p", "EX", 0, 1), ("p", "enzyme x", 1, 5)], "pathway_id string, name string, rank int, times long")
    assert {r.chosen for r in graph.equivalence(e, u).collect()} == {"EX"}


def test_containing_is_exact(spark):
    texts = ["abcdef", "xabx", "ab", "", "ABC", "zzzzz", "a"]
    terms = ["ab", "abc", "bcd", "zzz", "zzzzzz", "q", "AB", "xabx"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.term, r.id) for r in linking.containing(spark.createDataFrame([(x,) for x in terms], "term string"), t).collect()}
    assert got == {(q.lower(), i) for q in terms for i, x in enumerate(texts) if len(q) >= 2 and q.lower() in x.lower()}


def test_composite_fates(spark):
    rows = [(1, "reactant", 0, "Carrier protein + ligand x", ""), (1, "product", 0, "carrier protein + ligand x", ""), (2, "product", 0, "carrier protein + ligand x", "the carrier protein bound to ligand x"), (3, "product", 0, "carrier protein + citric acid", "carrier protein bound to citric acid"), (4, "product", 1, "a + b", "a + b"), (5, "product", 0, "NAD+", "")]
    used = spark.createDataFrame([("p", *r) for r in rows], "pathway_id string, process int, role string, pos int, entity string, evidence string")
    none = spark.createDataFrame([], "pathway_id string, name string")
    fate = {(r.process, r.role): r.fate for r in rewrite.decide_composites(used, none).collect()}
    assert fate == {(1, "reactant"): "complex", (1, "product"): "split", (2, "product"): "complex", (3, "product"): "split", (4, "product"): "error"}


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"a": 1}', {"a": 1}), ('text {"a": [1, 2,], "b": {"c": 3,}} more', {"a": [1, 2], "b": {"c": 3}}), ('```json\n{"a": "x}"}\n```', {"a": "x}"}), ('{"a": [1, {"b": "cut', {"a": [1, {"b": "cut"}]}),
        ('{"a": 1, "b": tru', {"a": 1}), ("none", None), ("", None), ("[1]", None), ('{"a": "\\"q', {"a": '"q'}),
    ],
)
def test_salvage(raw, want):
    got = text.salvage(raw)
    assert (json.loads(got) if got else None) == want


def test_packing_of_sentences():
    assert text.pack_sentences([5, 5, 5, 5], 10, 0) == [(0, 2), (2, 4)]
    assert text.pack_sentences([5, 5, 5, 5], 10, 5) == [(0, 2), (1, 3), (2, 4)]
    assert text.pack_sentences([50, 1], 10, 5) == [(0, 1), (1, 2)]
    assert text.pack_sentences([], 10, 5) == []


def test_patches(spark):
    rows = [("p", 1, "add", "/entities/subcellular_locations/0", 0.72, ""), ("p", 2, "add", "/entities/x/0", 0.72, ""), ("p", 3, "replace", "/processes/reactions/0/inputs/1", 0.97, "e"), ("p", 4, "replace", "/processes/reactions/0/inputs/1", 0.99, ""), ("p", 5, "replace", "/processes/reactions/0/inputs/1", 0.99, "e"), ("p", 6, "remove", "/processes/reactions/3", 0.99, "e"), ("p", 7, "remove", "/processes/reactions/4", 0.99, "e"), ("p", 8, "move", "/x", 1.0, "e"), ("p", 9, "add", "x", 1.0, "e")]
    p = spark.createDataFrame(rows, "pathway_id string, seq int, op string, path string, confidence double, evidence string")
    noop = spark.createDataFrame([("p", "/processes/reactions/3", True), ("p", "/processes/reactions/4", False)], "pathway_id string, path string, is_noop boolean")
    got = {r.seq: r.reason for r in audit.accepted(p, noop).collect()}
    assert got == {1: "accepted", 2: "low_confidence", 3: "connectivity_confidence", 4: "connectivity_evidence", 5: "accepted", 6: "accepted", 7: "core_removal", 8: "unsupported_op", 9: "not_a_pointer"}


def test_payload_round_trip(spark, tmp_path):
    doc = {"pathway_id": "p", "entities": {"compounds": [{"name": "a", "mapped_ids": {"kegg": "C1"}}, {"name": "b"}], "proteins": [{"name": "e"}]}, "processes": {"reactions": [{"name": "r", "inputs": ["a"], "outputs": ["b"], "enzymes": [{"protein": "e"}, {"protein_complex": "c", "entity": ""}]}], "interactions": [{"entity_1": "a", "entity_2": "b"}]}}
    (tmp_path / "a.json").write_text(json.dumps(doc) + "\n[1, 2]\n{broken\n")
    got = payload.read(spark, str(tmp_path)).cache()
    assert got.where("_bad is null and pathway_id is not null").count() == 1
    p = got.where("pathway_id = 'p'")
    assert {(r.process_kind, r.role, r.pos, r.entity) for r in payload.participants(p).collect()} >= {("reaction", "reactant", 0, "a"), ("reaction", "enzyme", 0, "e"), ("reaction", "enzyme", 1, "c"), ("interaction", "entity_2", 1, "b")}
    assert [(r.kind, r.pos, r.pointer) for r in payload.entities(p).where("name = 'b'").collect()] == [("compound", 1, "/entities/compounds/1")]


def test_union_distinct_keeps_the_first(spark):
    df = spark.createDataFrame([("p", 2, "x", None), ("p", 1, "x", None), ("p", 3, "y", "z")], "k string, o int, a string, b string")
    assert sorted((r.o, r.a) for r in merge.union_distinct(df, ["k"], "o").collect()) == [(1, "x"), (3, "y")]


def test_from_payload_to_written_model(spark, tmp_path):
    docs = [("a", {"entities": {"compounds": [{"name": "Glucose"}], "proteins": [{"name": "hexokinase"}]}, "processes": {"reactions": [
        {"name": "r1", "inputs": ["glucose", "atp"], "outputs": ["g6p"], "enzymes": [{"protein": "hexokinase"}]}, {"name": "r2", "inputs": ["g6p"], "outputs": ["g6p"]}, {"name": "r3", "inputs": ["atp", "glucose"], "outputs": ["G6P"], "enzymes": [{"name": "Hexokinase"}]}]}}), ("b", [1])]
    texts = spark.createDataFrame([(k, json.dumps(d)) for k, d in docs], "id string, json string")
    catalogue = spark.createDataFrame([(1, "Glucose", "glc", ""), (2, "sucrose", "", "")], "id long, name string, short_name string, synonyms string")
    with scratch():
        got = course.model(texts, catalogue)
        names = sinks.write_tables({k: got[k] for k in ("species", "references", "compartments", "metrics", "stops", "mapped")}, str(tmp_path / "model"))
        assert {r.stage: r.n for r in got["stages"].collect()} == {"payloads": 1, "reactions_read": 3, "entities_read": 2, "entities_repaired": 4, "reactions_normalised": 1, "species": 4, "references": 4}
    read = {n: spark.read.parquet(str(tmp_path / "model" / n)).collect() for n in names}
    assert {(r.name, r.ref_id) for r in read["species"]} == {("Glucose", 1), ("hexokinase", None), ("ATP", None), ("g6p", None)}
    assert [(r.reason, r.round) for r in read["stops"]] == [("clean", 1)]
    assert (read["metrics"][0].species, read["metrics"][0].reactions, read["metrics"][0].isolated) == (4, 1, 0)
    sinks.write_payloads(texts, str(tmp_path / "json"))
    assert payload.read(spark, str(tmp_path / "json")).where("entities is not null").count() == 1


def test_transports_and_gates_reach_the_model_files(spark, tmp_path):
    moving = {"entities": {"compounds": [{"name": "glucose"}], "proteins": [{"name": "GLUT4"}, {"name": "hexokinase"}]}, "biological_states": [{"name": "s1", "subcellular_location": "cytosol"}, {"name": "s2", "subcellular_location": "membrane"}], "processes": {
        "reactions": [{"name": "r1", "inputs": ["glucose"], "outputs": ["g6p"], "biological_state": "s1"}], "transports": [{"name": "t", "cargo": "glucose", "from_biological_state": "s1", "to_biological_state": "s2", "transporters": [{"protein": "GLUT4"}]}, {"name": "lost", "cargo": "lactate", "from_biological_state": "s1", "to_biological_state": "s2"}],
        "interactions": [{"entity_1": "hexokinase", "relationship": "catalyses", "entity_2": "r1"}], "reaction_coupled_transports": [{"name": "both", "reaction": "r1", "transport": "t"}]}}
    lonely = {"entities": {"compounds": [{"name": "a"}], "proteins": [{"name": "unused"}]}, "processes": {"reactions": [{"name": "r", "inputs": ["a"], "outputs": ["b"]}]}}
    texts = spark.createDataFrame([("p", json.dumps(moving)), ("q", json.dumps(lonely))], "id string, json string")
    catalogue = spark.createDataFrame([(1, "glucose", "glc", "")], "id long, name string, short_name string, synonyms string")
    with scratch():
        got = course.model(texts, catalogue)
        used = {(r.role, r.entity) for r in got["participants"].where("pathway_id = 'p'").collect()}
        assert {("cargo", "glucose"), ("cargo", "lactate"), ("transporter", "GLUT4"), ("modifier", "hexokinase")} <= used
        assert got["transports"].where("pathway_id = 'p'").count() == 2 and got["coupled"].count() == 1
        stopped = {r.pathway_id for r in got["issues"].collect()} - {r.pathway_id for r in got["passed"].collect()}
        sinks.write_models(course.documents(got), str(tmp_path / "xml"))
    parsed = models.parse(models.read_texts(spark, str(tmp_path / "xml"))).cache()
    keys = {r.source.rsplit("/", 1)[1] for r in parsed.select("source").collect()}
    assert "p.xml" in keys and keys == {f"{k}.xml" for k in {"p", "q"} - stopped}
    names = {(r.role, r.species_name) for r in models.references(parsed).where("source like '%/p.xml'").collect()}
    assert {("reactant", "glucose"), ("product", "glucose"), ("product", "lactate"), ("modifier", "GLUT4"), ("modifier", "hexokinase")} <= names

def test_scratch_removes_its_tables(spark):
    folder = shared_folder(spark)
    with scratch():
        kept = durable(spark.range(3), result=True)
        gone = durable(spark.range(4))
        assert gone.count() == 4
        inside = set(os.listdir(folder))
    assert kept.count() == 3 and len(inside - set(os.listdir(folder))) == 1


def test_postings_weigh_each_word_once(spark):
    entries = spark.createDataFrame([(1, ["glucose to glucose", "atp"], ["Glucose"], None), (2, None, None, ["cytosol"]), (3, [], [], [])], "model int, reaction array<string>, species array<string>, compartment array<string>")
    got = {(r.model, r.token): round(r.w, 6) for r in text.postings(text.motif_words(entries)).collect()}
    assert got == {(1, "glucose"): 5.0, (1, "atp"): 3.2, (2, "cytosol"): 1.6}


def test_top_examples_skip_frequent_words(spark, monkeypatch):
    r = random.Random(3)
    models = [(m, field, t) for m in range(200) for t in {*r.choices(["common", "often", "usual"], k=3), *r.choices([f"rare{i}" for i in range(60)], k=4)} for field in ("all", r.choice(["reaction", "species"]))]
    models = [x for x in models if x[1] != "all"]
    index = spark.createDataFrame(models, "model long, field string, token string")
    queries = spark.createDataFrame([(i, " ".join(["common often usual", *r.choices([f"rare{j}" for j in range(70)], k=6)])) for i in range(20)] + [(99, "nowhere"), (98, "common")], "query long, text string")
    want = {}
    for q, words in ((x.query, set(x.text.split())) for x in queries.collect()):
        score = {}
        for m, field, t in models:
            if t in words:
                score[m] = score.get(m, 0) + (text.WEIGHTS[field] + text.WEIGHTS["all"]) / len(words)
        want[q] = [m for m, _ in sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:3]]
    for rows in (1, 40, 10**6):
        monkeypatch.setattr(text, "SEED_ROWS", rows)
        got = {}
        for x in text.top_examples(queries, index).orderBy("query", "rn").collect():
            got.setdefault(x.query, []).append(x.model)
        assert got == {q: m for q, m in want.items() if m}
