import hashlib
import random
import re
import time

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from pathloom.llm import decontaminate, quality, simhash
from pathloom.operators import components
from tests.llm.data import documents, empty, rows

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_fingerprints_and_components(spark):
    want = {}
    for i, text, *_ in rows():
        w = BLANK.findall(low(text))
        sh = [" ".join(w[a : a + 4]) for a in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    label = {i: i for i in want}
    changed = True
    while changed:
        changed = False
        for i in want:
            for j in want:
                if (want[i] ^ want[j]).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(documents(spark)).collect()}
    assert got == {i: (f"{want[i]:016x}", label[i]) for i in want}
    kept = {r.doc_id for r in simhash.keep_one(documents(spark)).collect()}
    assert kept == set(label.values())
    assert simhash.components(empty(spark)).count() == 0


def test_dense_posting_and_null_ids(spark):
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)] + [base ^ (0xFFFFF << 40)]
    df = spark.createDataFrame([(x,) for x in set(fps)], "fp long")
    edges = simhash.links(df)
    from pathloom.operators.components import connected_components

    label = {r.node: r.component for r in connected_components(edges).collect()}
    assert len(set(label.values())) == 1
    assert base ^ (0xFFFFF << 40) not in label
    d = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, None), (3, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id) for r in simhash.components(d).collect() if r.component_id) == [(False, 3), (False, 3), (True, 3)]
    assert simhash.keep_one(d).count() == 4


def test_tally_prunes_and_loses_nothing(spark):
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 24, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([(rng.integers(0, 1 << 40, 40, dtype=np.uint64) << np.uint64(24)) | x for x in shared]))
    near = fp[:200] ^ (np.uint64(1) << rng.integers(24, 64, 200).astype(np.uint64))
    fp = np.unique(np.concatenate((fp, near))).reshape(-1, 1)
    close = simhash.Tally(4, 4)
    got = simhash._few(fp, np.zeros(1, dtype=np.int64), np.array([len(fp)]), close, len(fp))
    pairs = {(int(fp[a, 0]), int(fp[b, 0])) for i, j, _ in got for a, b in zip(i, j, strict=True)}
    want = {(int(a), int(b)) for n, a in enumerate(fp[:, 0]) for b in fp[n + 1 :, 0] if (int(a) ^ int(b)).bit_count() <= 4}
    assert pairs == want and len(want) >= 150
    # most pairs that meet by three bytes never come to the test of bits
    assert close.verified < close.counted / 20


def labels(edges, nodes):
    at = {n: n for n in nodes}

    def top(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        at[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_long_lists_give_the_same_components():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fp = np.array([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for c in centres for k in range(6) for _ in range(60)], dtype=np.uint64)
    fp = np.unique(np.concatenate((fp, centres)))
    want = labels([(a, b) for n, a in enumerate(fp.tolist()) for b in fp[n + 1 :].tolist() if (a ^ b).bit_count() <= 4], fp.tolist())
    wide = fp.reshape(-1, 1)
    for got in (simhash._stars(wide, simhash.Tally(0, 4), False), simhash._stars(wide, simhash.Tally(0, 4), True), simhash._table(wide, simhash.Tally(0, 4))):
        assert labels([(int(fp[a]), int(fp[b])) for i, j, _ in got for a, b in zip(i, j, strict=True)], fp.tolist()) == want


def test_two_hundred_thousand_in_one_posting():
    rng = np.random.default_rng(9)
    fp = np.unique((rng.integers(0, 1 << 40, 200_000, dtype=np.uint64) << np.uint64(24)) | np.uint64(0xABCDEF)).reshape(-1, 1)
    fp[1000:2000] = fp[:1000] ^ (np.uint64(1) << np.uint64(40))
    free = [(3, 4, 5, 6, 7)]
    began = time.time()
    none = np.zeros(len(fp), dtype=np.int64)
    got = simhash._list_pairs(fp, none, none - 1, free, simhash.Tally(4, 4), False)
    assert time.time() - began < 30
    found = {(min(a, b), max(a, b)) for i, j, _ in got for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert {(n, n + 1000) for n in range(1000)} <= found


def test_dense_postings_are_dealt_by_a_further_byte(spark, monkeypatch):
    rng = np.random.default_rng(4)
    fp = np.unique((rng.integers(0, 1 << 12, 3000, dtype=np.uint64) << np.uint64(40)) | np.uint64(0x0123456789))
    df = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    want = labels([(a, b) for n, a in enumerate(fp.tolist()) for b in fp[n + 1 :].tolist() if (a ^ b).bit_count() <= 4], fp.tolist())
    monkeypatch.setattr(simhash, "DENSE", 5)
    assert len(simhash._dense_postings(df, simhash.posting_sets(4)))
    assert labels([(r.a, r.b) for r in simhash.links(df).collect()], fp.tolist()) == want


def shingle_set(text, n=5):
    w = BLANK.findall(low(text))
    return {" ".join(w[a : a + n]) for a in range(max(1, len(w) - n + 1))} if w else set()


def similar_labels(table):
    sets = {i: shingle_set(t) for i, t in table}
    like = lambda x, y: x == y or (x and y and 5 * len(x & y) >= 4 * len(x | y))
    ids = sorted(sets)
    return labels([(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if like(sets[a], sets[b])], ids)


def near_copies(seed=2, n=40, words=200):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    table = []
    for i in range(n):
        base = r.choices(vocab, k=words)
        table.append((len(table), " ".join(base)))
        for edits in (1, 2, 3, 12, 40):
            w = list(base)
            for at in r.sample(range(words), edits):
                w[at] = r.choice(vocab)
            table.append((len(table), " ".join(w)))
    return table


def test_similar_texts(spark):
    table = near_copies() + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "a b c d e"), (907, "a b c d e")]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("th", F.lit("x")).repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()}
    want = similar_labels(table)
    gone = {i for i in want if want[i] != i}
    found = {i for i in got if got[i] != i}
    assert found <= gone  # nothing else goes
    assert len(found) >= 0.9 * len(gone) and len(gone) > 100
    assert {i: got[i] for i in range(900, 908)} == {i: want[i] for i in range(900, 908)}
    kept = simhash.keep_one_similar(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i] == i}
    assert simhash.similar_components(empty(spark)).count() == 0
    d = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, None), (3, "a b c")], "doc_id long, text string")
    assert simhash.keep_one_similar(d).count() == 4


def test_similar_texts_of_one_large_group(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    table = [(1000, " ".join(base))]
    for i in range(300):
        w = list(base)
        for at in r.sample(range(150), 1 + i % 3):
            w[at] = f"x{i}y{at}"
        table.append((i, " ".join(w)))
    df = spark.createDataFrame(table, "doc_id long, text string")
    want = similar_labels(table)
    # more than a list takes: hubs, and a second look at those unlike their hub, in several blocks
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 1 << 16)
    got = {x.doc_id: x.component_id for x in simhash.similar_components(df).collect()}
    assert {i for i in got if got[i] != i} <= {i for i in want if want[i] != i}
    assert sum(got[i] != i for i in got) >= 0.95 * sum(want[i] != i for i in want)


def test_blocks_find_all_links():
    r = random.Random(2)
    base = list(range(100))
    sets = {}
    for i in range(60):
        x = set(base)
        for at in r.sample(base, r.randint(0, 25)):
            x.discard(at)
            x.add(1000 * (i + 1) + at)
        sets[i] = x
    frame = [(k, i, np.array(sorted(sets[i]), dtype=np.uint64).tobytes()) for k, part in ((True, range(0, 40)), (False, range(0, 60))) for i in part]
    rows = pd.DataFrame({"asks": [k for k, _, _ in frame], "th": [bytes([i]) for _, i, _ in frame], "shingles": [x for _, _, x in frame]})
    got = simhash._block_links(rows, 0.8, columns=37)
    want = labels([(a, b) for a in range(40) for b in range(60) if a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])], range(60))
    assert labels([(a[0], b[0]) for a, b in zip(got["a"], got["b"])], range(60)) == want and len(set(want.values())) > 3


def brute_counts(text):
    w = BLANK.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    rep = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 2000 else None
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, None if rep is None else len(rep)


def test_quality_counts_and_outliers(spark):
    got = {r.doc_id: r for r in quality.judge(documents(spark)).collect()}
    for i, text, *_ in rows():
        want = brute_counts(text)
        have = (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words)
        assert have[:4] == want[:4], i
        if want[4] is not None:
            assert have[4] == want[4], i
            assert got[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i].base_failed and got[i].kept)
    assert quality.judge(empty(spark)).count() == 0
    kept = {i for i, r in got.items() if r.kept}
    assert {r.doc_id for r in quality.filter_documents(documents(spark)).collect()} == kept


def test_robust_estimate_rejects_planted_outliers(spark):
    clean = [(i, " ".join(f"w{(i * 7 + k * k) % 997}x{k}" for k in range(80 + i % 40)), "en", "a") for i in range(200)]
    junk = [(1000 + i, " ".join(f"a{i}{k}###$$$" for k in range(100)), "en", "a") for i in range(12)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.judge(df).where("kept").collect()}
    assert kept == set(range(200))


def lower(values, share):
    """The least value that a share of all doesn't exceed."""
    v = sorted(values)
    return v[max(0, int(np.ceil(share * len(v))) - 1)]


def brute_estimate(x, steps=3):
    """Concentration steps: the three quarters nearest to the centre give the next centre and scatter."""
    floors = np.array(quality.FLOORS)
    centre = np.array([lower(c, 0.5) for c in x.T])
    sd = np.maximum(1.4826 * np.array([lower(np.abs(c - m), 0.5) for c, m in zip(x.T, centre)]), floors)
    inverse = np.diag(1 / sd**2)
    for _ in range(steps):
        d = np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)
        near = x[d <= lower(d, 0.75)]
        centre, scatter = near.mean(axis=0), np.cov(near.T, bias=True) * 1.6
        inverse = brute_inverse(scatter)
    return centre, scatter


def brute_inverse(scatter):
    spread = np.sqrt(np.maximum(np.diag(scatter), np.square(quality.FLOORS)))
    w, v = np.linalg.eigh(scatter / np.outer(spread, spread))
    return v @ np.diag(1 / np.maximum(w, 0.25)) @ v.T / np.outer(spread, spread)


def test_quality_distance_against_brute_force(spark):
    r = random.Random(12)
    table = []
    for i in range(400):
        words = ["".join(r.choice("abcdef") for _ in range(r.randint(1, 9))) + r.choice(["", "", "", "#"]) for _ in range(int(10 + r.expovariate(1 / 60)))]
        text = " ".join(words) + ("\n" + " ".join(words[:6])) * (i % 5 == 0)
        table.append((i, text, [None, "a", "b"][i % 3], [None, "s", "t", "t", "t", "t"][i % 6] if i % 50 else f"rare{i}"))
    table += [(500 + i, "same words here always the same ten words here now", "c", "constant") for i in range(30)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string").repartition(3)
    got = {x.doc_id: x for x in quality.judge(df).collect()}
    x = []
    for i, t, *_ in table:
        n, chars, symbols, dup, rep = brute_counts(t)
        lines = sum(bool(BLANK.search(y)) for y in t.split("\n"))
        x.append([np.log1p(n), np.log((chars + 1) / n), np.log1p(100 * symbols / n), np.sqrt(dup / lines), np.sqrt(rep / n)])
    x = np.array(x)
    where = lambda f: np.array([f(row) for row in table])
    whole = brute_estimate(x)
    blend = lambda own, n, wide: [n / (n + 60) * a + 60 / (n + 60) * b for a, b in zip(own, wide)]
    for lang, source in {row[2:] for row in table}:
        of_lang, mine = where(lambda row: row[2] == lang), where(lambda row: row[2:] == (lang, source))
        wide = blend(brute_estimate(x[of_lang]), of_lang.sum(), whole)
        centre, scatter = blend(brute_estimate(x[mine]), mine.sum(), wide)
        inverse = brute_inverse(scatter)
        for k in np.flatnonzero(mine):
            d = (x[k] - centre) @ inverse @ (x[k] - centre)
            row = got[table[k][0]]
            assert abs(row.distance2 - d) < 1e-4 * max(1, d)
            if abs(d - quality.CUTOFF) > 1e-3:
                assert row.kept == (not row.base_failed and d <= quality.CUTOFF)


def brute_hits(text, items, n=13):
    w = ALNUM.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        iw = ALNUM.findall(low(t))
        k = min(n, len(iw))
        wins = {tuple(iw[a : a + k]) for a in range(len(iw) - k + 1)} if k else set()
        for a in range(len(w) - k + 1 if k else 0):
            if tuple(w[a : a + k]) in wins:
                hit |= set(range(a, a + k))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def benchmark(spark):
    t = [x[1] for x in rows()]
    items = [(1, " ".join(t[0].split()[:20])), (2, "word"), (10, t[3].upper()), (11, t[3]), (5, None), (6, " . "), (7, "changed")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(spark):
    items, b = benchmark(spark)
    want = {i: brute_hits(t, [x for x in items if x[1]]) for i, t, *_ in rows()}
    for limit in (10**6, 7):  # one set, or several
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.scan(documents(spark), b, limit=limit).collect()}
        assert got == want
        kept = {r.doc_id: r.text for r in decontaminate.clean(documents(spark), b, limit=limit).collect()}
        assert set(kept) == {i for i, w in want.items() if not w[4]}
    assert decontaminate.scan(empty(spark), b).count() == 0
    assert decontaminate.scan(documents(spark), b.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0


def test_cut_spans(spark):
    b = spark.createDataFrame([(1, "Alpha beta gamma")], "item_id long, text string")
    text = "é (one), alpha-BETA; gamma! " + "rest " * 80
    d = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.clean(d, b).collect()}
    assert got == {1: "é (one), ! " + "rest " * 80, 2: None}


def test_cut_in_several_sets(spark):
    items, b = benchmark(spark)
    whole = {r.doc_id: r.text for r in decontaminate.clean(documents(spark), b).collect()}
    assert {r.doc_id: r.text for r in decontaminate.clean(documents(spark), b, limit=7).collect()} == whole
    # passages whose windows fall into different sets: 30 words of 1000 are cut whole, 4 times 13 of 1000 are a twentieth
    passages = [" ".join(f"p{k}x{i}" for i in range(n)) for k, n in enumerate([30, 13, 13, 13, 13])]
    rest = [f"w{i}" for i in range(970)]
    one = " ".join([*rest[:500], passages[0], *rest[500:]])
    spread = " ".join(x for k, p in enumerate(passages[1:]) for x in (p, *rest[k * 237 : k * 237 + 237]))
    few = spark.createDataFrame([(k, p) for k, p in enumerate(passages)], "item_id long, text string")
    d = spark.createDataFrame([(1, one, b"m"), (2, spread, None), (3, None, None)], "doc_id long, text string, _hit binary")
    for limit in (10**6, 7, 2, 1):
        flagged = {r.doc_id: r.contaminated for r in decontaminate.scan(d, few, limit=limit).collect()}
        assert flagged == {1: False, 2: True, 3: False}
        got = decontaminate.clean(d, few, limit=limit)
        assert got.columns == d.columns
        kept = {r.doc_id: (r.text, r._hit) for r in got.collect()}
        assert kept == {1: (" ".join([*rest[:500], "", *rest[500:]]), b"m"), 3: (None, None)}


def one_group(n, words=150):
    r = random.Random(8)
    table = [(1000, " ".join(f"w{i}" for i in range(words)))]
    for i in range(n):
        w = [f"w{i}" for i in range(words)]
        for at in r.sample(range(words), 1 + i % 3):
            w[at] = f"x{i}y{at}"
        table.append((i, " ".join(w)))
    return table


def test_pairs_of_blocks_are_dealt_apart(spark, monkeypatch):
    """All blocks of a group came to the task of its component, were made again for each reading, and had no bound on their texts."""
    table = one_group(300)
    df = spark.createDataFrame(table, "doc_id long, text string")
    written = []
    kept = simhash.durable
    monkeypatch.setattr(simhash, "durable", lambda t, *a, **k: written.append(t) or kept(t, *a, **k))
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 40)
    got = {x.doc_id: x.component_id for x in simhash.similar_components(df).collect()}
    want = similar_labels(table)
    assert {i for i in got if got[i] != i} <= {i for i in want if want[i] != i}
    assert sum(got[i] != i for i in got) >= 0.95 * sum(want[i] != i for i in want)
    links = [t for t in written if t.columns == ["a", "b"] and "FlatMapGroupsInPandas" in t._jdf.queryExecution().executedPlan().toString()]
    assert len(links) == 1
    plan = links[0]._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapGroupsInPandas") :]
    assert re.search(r"Exchange hashpartitioning\(component#\d+, i#\d+, j#\d+", below)


def test_rounds_of_components_fill_their_files(spark, monkeypatch):
    """Each round of a small table was written in as many files as there are shuffle partitions."""
    written = []
    kept = components.durable
    monkeypatch.setattr(components, "durable", lambda t, *a, **k: written.append(kept(t, *a, **k)) or written[-1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(50)], "a long, b long").repartition(8)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.node: r.component for r in components.connected_components(edges).collect()}
        files = [len(t.inputFiles()) for t in written]
        monkeypatch.setattr(components, "FILE_EDGES", 100)
        again = {r.node: r.component for r in components.connected_components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == again == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)} | {1000: 1000}
    assert len(files) > 3 and set(files[1:]) == {1}
    assert max(len(t.inputFiles()) for t in written[len(files) + 1 :]) == 4
