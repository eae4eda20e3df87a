"""Names inside texts: whether the terms go to the texts or both are shuffled, all pairs and no others."""

import random

import pytest

from pathloom.operators import linking


@pytest.mark.parametrize("given", [0, linking.GIVEN_TERMS])
@pytest.mark.parametrize(("keys", "shortest"), [((), 2), (("k",), 1)])
def test_containing(spark, monkeypatch, given, keys, shortest):
    monkeypatch.setattr(linking, "GIVEN_TERMS", given)
    monkeypatch.setattr(linking, "DRAW", 3)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcD é") for _ in range(n))
    texts = [(r.choice("xy"), i, word(r.randint(0, 25))) for i in range(120)] + [("x", 500, None), ("x", 501, ""), (None, 502, "abc"), ("x", 3, "ab"), ("x", 3, "ab"), ("x", 503, "abc" * 2000)]
    terms = [(r.choice("xy"), word(r.randint(0, 5))) for _ in range(60)] + [("x", None), ("x", ""), ("y", "ABC"), (None, "abc"), ("x", "ab"), ("x", "ab")]
    got = linking.containing(spark.createDataFrame(terms, "k string, term string"), spark.createDataFrame(texts, "k string, id long, text string").repartition(3), keys, shortest)
    pairs = {(k, t.lower(), i) for k, t in terms if t and len(t) >= shortest for q, i, x in texts if x and t.lower() in x.lower() and (not keys or k is not None and k == q)}
    want = {p if keys else p[1:] for p in pairs}
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
