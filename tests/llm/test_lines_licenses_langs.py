import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import langid, licenses, line_dedup
from tests.llm.data import SCHEMA, documents, empty, rows


def brute_lines(table, n=3, words=50):
    """Every window against the first of its kind; ids come in order."""
    first, out = {}, {}
    for i, text, *_ in table:
        if text is None:
            out[i] = (None, 0, 0)
            continue
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for a in range(len(full)):
            for size in range(1, n + 1):
                part = tuple(lines[k] for k in full[a : a + size])
                enough = size == n or (words and sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in part) >= words)
                if len(part) == size and enough and first.setdefault(part, (i, a)) != (i, a):
                    gone |= set(full[a : a + size])
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(full), len(gone))
    return out


def test_lines(spark):
    table = rows()
    block = "\n".join(["one", "two", "", "three", "two", "two", "two", "two"])
    table += [(500 + i, t, None, None, None, None, None) for i, t in enumerate(["x\n" + block, block + "\ny", "two\nthree", "one\n \ntwo\nthree", "a\n" * 9])]
    df = spark.createDataFrame(table, SCHEMA).repartition(4)
    for words in (None, 50, 4):
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in line_dedup.dedup(df, words=words).collect()}
        assert got == brute_lines(table, words=words)
    assert line_dedup.dedup(empty(spark)).count() == 0
    twice = df.where("doc_id = 500")
    assert [r.n_removed_lines for r in line_dedup.dedup(twice.union(twice)).collect()] == [3, 3]
    assert line_dedup.dedup(df).columns[:7] == df.columns


def test_lines_of_few_kinds(spark):
    r = random.Random(11)
    table = [(i, "\n".join(r.choice(["a", "b", "c", "d e f", "", " "]) for _ in range(r.randint(0, 14)))) for i in range(120)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    for run, words in ((3, None), (3, 4), (2, 3), (4, None), (1, None)):
        got = {x.doc_id: (x.text, x.n_lines, x.n_removed_lines) for x in line_dedup.dedup(df, run=run, words=words).collect()}
        assert got == brute_lines(table, run, words), (run, words)


def test_lines_join_by_position_and_extend(spark):
    """A passage that repeats whole is found from its fingerprints' earliest places alone; contexts that differ take the second join."""
    passage = [f"line {i}" for i in range(30)]
    df = spark.createDataFrame([(1, "\n".join(["x", *passage])), (2, "\n".join([*passage, "y"]))], "doc_id long, text string")
    marks = line_dedup.fingerprints(df, "doc_id", "text", 3, None)
    n = marks.where("did = 2").count()
    assert n < 20  # a fingerprint stands for several windows
    assert [(c.a, c.b) for r in line_dedup.repeated_runs(df, words=None).collect() for c in r.cuts] == [(1, 31)]


def test_lines_of_awkward_tables(spark):
    table = [("b2", "k\nl\nm"), ("a1", "k\nl\nm"), (None, "k\nl\nm\nn"), ("b2", "k\nl\nm")]
    df = spark.createDataFrame(table, "doc_id string, text string")
    for c in ("n_lines", "cuts", "_cuts", "_d", "did", "th", "row", "lines", "at", "spans", "a"):
        df = df.withColumn(c, F.lit(7))
    out = line_dedup.dedup(df)
    assert set(out.columns) == set(df.columns) | {"n_removed_lines"}
    assert sorted((x.doc_id or "", x.text, x.n_removed_lines, x.did) for x in out.collect()) == [("", "k\nl\nm\nn", 0, 7), ("a1", "", 3, 7), ("b2", "", 3, 7), ("b2", "", 3, 7)]
    long = "\n".join(f"z{i % 50000}" for i in range(100_000))
    got = line_dedup.dedup(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert (got.n_lines, got.n_removed_lines, len(got.text.split("\n"))) == (100_000, 50_000, 50_000)


def test_long_lines(spark):
    long = lambda k, n=50: " ".join(f"{k}w{i}" for i in range(n))
    table = [(1, long("a")), (2, long("a")), (3, "x\n" + long("a") + "\ny"), (4, long("b", 30) + "\n\n" + long("c", 20)), (5, long("b", 30) + "\n" + long("c", 20)),
             (6, long("b", 30)), (7, "p\n" + long("b", 30) + "\n" + long("c", 20) + "\nq"), (8, long("d", 49)), (9, long("d", 49)), (10, long("e") + "\n" + long("e")), (11, "one\ntwo\nthree"), (12, "one\ntwo\nthree\nfour"), (13, None), (14, "")]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in line_dedup.dedup(df, words=50).collect()}
    gone = {2: ("", 1), 3: ("x\ny", 1), 5: ("", 2), 7: ("p\nq", 2), 10: (long("e"), 1), 12: ("four", 3)}
    assert got == {i: gone.get(i, (t, 0)) for i, t in table}


def test_pipeline_cuts_long_lines(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, "a\n" + long, None, None, 0), (2, long, None, None, 0), (3, "b\n" + long + "\nc", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_winnowing(spark, df, "").collect()} == {1: "a\n" + long, 3: "b\nc"}


def test_licenses(spark):
    texts = ["Released under the MIT License.", "foo Licensed under the Apache License, Version 2.0. bar MIT license", "GNU General Public License", "MIT\nlicense mit LICENSE", None, "", "é MIT-License",
             "this work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "public license", "general public licenses", "Permission is hereby granted, free of charge, to any human obtaining a copy of this software and associated documentation files"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert licenses.scan(df).count() == len(texts) + 2
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in licenses.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert got[0].labels == "mit,mit-notice" and got[0].score == 1
    assert got[8].labels == "cc-by-nc-4.0" and got[7].labels == "gpl,gpl-3.0-notice"
    assert got[11].labels == "mit" and 0.8 <= got[11].score < 1
    assert got[9].labels == "" and got[9].score == 0
    assert licenses.scan(empty(spark)).count() == 0


def test_files_of_many_licenses(spark):
    bundle = "\n\n".join(text for _, text, _ in licenses.TEMPLATES)
    four = "\n".join(text for label, text, _ in licenses.TEMPLATES if label in ("mit-notice", "apache-2.0-notice", "gpl-3.0-notice", "cc-by-4.0"))
    df = spark.createDataFrame([(1, bundle), (2, four)] + [(10 + i, t) for i, (_, t, _) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    got = {r.doc_id: (set(r.labels.split(",")), r.score) for r in licenses.scan(df).collect()}
    base = {"mit", "apache", "gpl"}
    assert got[1] == ({label for label, _, _ in licenses.TEMPLATES} | base, 1)
    assert got[2] == ({"mit-notice", "apache-2.0-notice", "gpl-3.0-notice", "cc-by-4.0"} | base, 1)


def test_language(spark):
    vocab = {"xx": "kalo mira tun sedi pok".split(), "yy": "strenge wurchtig gelb schnopf undt".split()}
    table = []
    for i in range(200):
        lang = "xx" if i % 2 else "yy"
        table.append((i, " ".join(vocab[lang][(i * k + k * k) % 5] for k in range(3 + i % 20)), lang if i % 9 else None))
    table += [(900, None, "xx"), (901, "12 | 34", "yy"), (902, "", None), (903, "k", None), (None, "kalo mira", "xx"), (0, table[0][1], None)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert len(got) == len(table)
    for r in got:
        want = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert r.held_out == want and 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 200:
            assert r.lang_pred == ("xx" if r.doc_id % 2 else "yy")
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred in ("xx", "yy")
    assert langid.identify(empty(spark)).count() == 0
    none = langid.identify(df.withColumn("lang", df["lang"].substr(9, 1)).where("doc_id = 3").selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert [r.lang_pred for r in none.collect()] == ["und"]


def test_prediction_reads_only_text(spark):
    df = documents(spark)
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, langid.fit(df)).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df.selectExpr("doc_id", "text", "'zz' as lang"), langid.fit(df)).collect()}
    assert a == b


def brute_vector(text):
    """Damped counts of byte pairs and triples that begin words' letters, by place in a table of 2048."""
    out = np.zeros(2048)
    letter = lambda b: b >= 128 or 97 <= b <= 122
    padded = [32, *(b if letter(b) else 32 for b in text.lower().encode()), 32]
    for i, b in enumerate(padded):
        if b != 32:
            two = b << 8 | padded[i + 1]
            for g in (two + (1 << 30), padded[i - 1] << 16 | two):
                out[(g * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 53] += 1
    return np.log1p(out)


def brute_centroids(v, k):
    """Spherical k-means from the text nearest to the middle and then those farthest from all picked."""
    picked = [max(range(len(v)), key=lambda i: (v[i] @ v.mean(axis=0), -i))]
    while len(picked) < k:
        picked.append(min(range(len(v)), key=lambda i: (max(v[i] @ v[p] for p in picked), i)))
    c = [v[p] for p in picked]
    for _ in range(langid.ROUNDS):
        own = [max(range(k), key=lambda j: (x @ c[j], -j)) for x in v]
        c = [np.mean([x for x, o in zip(v, own) if o == j], axis=0) if j in own else c[j] for j in range(k)]
        c = [x / np.linalg.norm(x) for x in c]
    own = [max(range(k), key=lambda j: (x @ c[j], -j)) for x in v]
    return c, [np.quantile([1 - x @ c[j] for x, o in zip(v, own) if o == j], 0.995) + 0.1 if j in own else 0.1 for j in range(k)]


def test_language_against_brute_force(spark):
    r = random.Random(6)
    words = {lang: ["".join(r.choice(letters) for _ in range(r.randint(3, 7))) for _ in range(60)] for lang, letters in (("xx", "aeioklm"), ("yy", "bdgrstu"), ("zz", "éñaopqr"))}
    table = [(i, " ".join(r.choices(words["xyz"[i % 3] * 2], k=r.randint(3, 40))), "xyz"[i % 3] * 2) for i in range(150)]
    table += [(200 + i, "".join(r.choices("wvjhyf ", k=60)), None) for i in range(5)]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(3)).collect()}
    learn = [(t, lang) for i, t, lang in table if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    raw = {t: brute_vector(t) for _, t, _ in table}
    idf = np.log((1 + len(learn)) / (1 + sum(raw[t] > 0 for t, _ in learn))) + 1
    unit = {t: raw[t] * idf / np.linalg.norm(raw[t] * idf) for t in raw}
    order = {x.text: x.h for x in spark.createDataFrame([(t,) for t in raw], "text string").select("text", F.xxhash64("text", F.lit(17)).alias("h")).collect()}
    model = []
    for lang in ("xx", "yy", "zz"):
        c, limit = brute_centroids(np.stack([unit[t] for t in sorted({t for t, x in learn if x == lang}, key=order.get)]), 4)
        model += [(lang, a, b) for a, b in zip(c, limit)]
    for i, t, _ in table:
        cosine = [unit[t] @ c for _, c, _ in model]
        k = int(np.argmax(cosine))
        assert got[i].lang_pred == model[k][0] and abs(got[i].score - cosine[k]) < 5e-3
        if abs(1 - cosine[k] - model[k][2]) > 5e-3:
            assert got[i].rejected == (1 - cosine[k] > model[k][2])
    assert all(got[200 + i].rejected for i in range(5)) and sum(got[i].rejected for i in range(150)) < 8


def test_many_languages_and_a_text_given_often(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda i: letters[i // 26] * 3 + letters[i % 26] * 3
    table = [(4 * i + 1, f"{name(i)} {name(i)}q", name(i)) for i in range(450)] + [(100_000 + i, "often often", "aaaaaa") for i in range(2000)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    idf, model = langid.fit(df)
    assert model.select("lang").distinct().count() == 450
    assert model.where("lang = 'aaaaaa'").count() == 2  # two different texts
    whole = {x.doc_id: (x.lang_pred, x.rejected) for x in langid.predict(df, (idf, model)).collect()}
    assert {x.doc_id: (x.lang_pred, x.rejected) for x in langid.predict(df, (idf, model), block=100).collect()} == whole
    assert sum(whole[i][0] == lang for i, _, lang in table[:450]) > 440
