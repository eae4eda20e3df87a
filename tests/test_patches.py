"""Ordered patches against a replay on Python lists."""

import copy
import json
import random

from pathloom.operators import patches


def replay(rows, todo):
    """Lists of objects after patches in order; null keys are absent."""
    docs = copy.deepcopy(rows)
    went = {}
    for k, seq, op, path, value in sorted(todo, key=lambda t: (t[0], t[1])):
        doc = docs.setdefault(k, [])
        went[k, seq] = _apply(doc, op, path[1:].split("/"), value)
    return docs, went


def _index(token, size, op):
    i = size if token == "-" and op == "add" else int(token) if token.isdigit() else None
    return i if i is not None and i < size + (op == "add") else None


def _apply(doc, op, tokens, value):
    i = _index(tokens[0], len(doc), op if len(tokens) == 1 else "touch")
    if i is None:
        return False
    if len(tokens) == 1:
        _edit(doc, i, op, json.loads(value) if value else None)
        return True
    row, field = doc[i], tokens[1]
    if len(tokens) == 2:
        if op != "add" and row.get(field) is None:
            return False
        if op == "remove":
            row[field] = None
        else:
            row[field] = json.loads(value) if field == "inputs" else value
        return True
    if row.get(field) is None:
        return False
    j = _index(tokens[2], len(row[field]), op)
    if j is None:
        return False
    _edit(row[field], j, op, value)
    return True


def _edit(items, i, op, value):
    if op == "add":
        items.insert(i, value)
    elif op == "replace":
        items[i] = value
    else:
        items.pop(i)


def run(spark, rows, todo):
    table = spark.createDataFrame([(k, i, r.get("name"), r.get("state"), r.get("inputs")) for k, v in rows.items() for i, r in enumerate(v)], "pathway_id string, pos int, name string, state string, inputs array<string>")
    p = spark.createDataFrame(todo, "pathway_id string, seq int, op string, path string, value string")
    got, report = patches.apply_in_order(table.repartition(3), p.repartition(3), ["name", "state"], ["inputs"])
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.pathway_id, r.pos)):
        assert r.pos == len(out.setdefault(r.pathway_id, []))  # no gaps
        out[r.pathway_id].append((r.name, r.state, r.inputs))
    return out, {(r.pathway_id, r.seq): r.applied for r in report.collect()}


def same(spark, rows, todo):
    docs, went = replay(rows, todo)
    got, applied = run(spark, rows, todo)
    assert {k: [(r.get("name"), r.get("state"), r.get("inputs")) for r in v] for k, v in docs.items() if v} == got
    assert went == applied


def test_insert_remove_and_replace_in_one_list(spark):
    rows = {"p": [{"name": "a"}, {"name": "b"}, {"name": "c"}], "untouched": [{"name": "x", "state": "s"}]}
    todo = [
        ("p", 1, "add", "/1", '{"name": "new", "inputs": ["u", "v"]}'), ("p", 2, "remove", "/0", None), ("p", 3, "replace", "/0/name", "newer"), ("p", 4, "add", "/0/inputs/1", "between"), ("p", 5, "replace", "/2", '{"name": "C"}'),
        ("p", 6, "add", "/-", '{"name": "last"}'), ("p", 7, "remove", "/9", None), ("p", 8, "remove", "/0/state", None), ("p", 9, "add", "/x/name", "no"), ("p", 10, "add", "/4", '{"name": "end"}'), ("p", 11, "add", "/6", "{}"), ("q", 1, "add", "/0", '{"name": "first"}'),
    ]
    same(spark, rows, todo)
    got, applied = run(spark, rows, todo)
    assert got["p"] == [("newer", None, ["u", "between", "v"]), ("b", None, None), ("C", None, None), ("last", None, None), ("end", None, None)]
    assert [s for (k, s), ok in sorted(applied.items()) if k == "p" and not ok] == [7, 8, 9, 11]


def test_random_patches(spark):
    r = random.Random(12)
    rows = {f"k{k}": [{"name": r.choice([None, f"n{i}"]), "state": f"s{i}", "inputs": r.choice([None, [], ["a", "b", "c"]])} for i in range(r.randint(0, 6))] for k in range(30)}
    todo = []
    for k in [*rows, "none"]:
        for seq in range(r.randint(0, 25)):
            op, i, j = r.choice(["add", "remove", "replace"]), r.choice(["-", "x", *map(str, range(7))]), r.choice(["-", *map(str, range(4))])
            path = r.choice([f"/{i}", f"/{i}/name", f"/{i}/state", f"/{i}/inputs", f"/{i}/inputs/{j}"])
            value = json.dumps({"name": f"v{seq}", "inputs": ["p", "q"]}) if path.count("/") == 1 else json.dumps(["x", f"y{seq}"]) if path.endswith("inputs") else f"w{seq}"
            todo.append((k, seq, op, path, value))
    same(spark, rows, todo)


def test_awkward_patches(spark):
    rows = {"p": [{"name": "a"}]}
    got, applied = run(spark, rows, [("p", 1, "move", "/0", "x"), ("p", 2, "add", "/0/other", "x"), ("p", 3, "add", None, "x"), ("p", 4, None, "/0", "x"), ("p", 5, "add", "0", "x"), (None, 6, "add", "/0", "{}"), ("p", 7, "add", "/0/inputs", "no list"), ("p", 8, "ADD", "/0/name", None)])
    assert applied[("p", 1)] is False and applied[("p", 2)] is False and ("p", 3) not in applied and applied[("p", 8)]
    assert got["p"] == [(None, None, None)]
    assert run(spark, {"p": []}, [])[0] == {}
