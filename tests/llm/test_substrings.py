import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from pathloom.llm import substring_fm, suffix_dedup
from pathloom.llm import _routing
from pathloom.llm.fm_index import Bounds, FMIndex, WaveletMatrix, matching_statistics
from pathloom.llm.suffix_sort import sort_suffixes
from tests.llm.data import SCHEMA, documents, empty, rows


def brute_words(table, n=20):
    first, out = {}, {}
    for i, text, *_ in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for a in range(len(w) - n + 1):
            if first.setdefault(tuple(w[a : a + n]), (i, a)) != (i, a):
                gone |= set(range(a, a + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_bytes(table, n=200):
    seen, out = defaultdict(int), {}
    texts = {i: (t or "").encode() for i, t, *_ in table}
    for t in texts.values():
        for a in range(len(t) - n + 1):
            seen[t[a : a + n]] += 1
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, dtype=bool)
        for a in range(len(t) - n + 1):
            if seen[t[a : a + n]] > 1:
                gone[a : a + n] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_words(spark):
    for window in (20, 3):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_fm.dedup(documents(spark), window=window, anchor_words=2).collect()}
        assert got == brute_words(rows(), window)
    assert substring_fm.dedup(empty(spark)).count() == 0


def test_bytes(spark):
    for window in (200, 21):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(documents(spark), window=window, anchor_bytes=12).collect()}
        assert got == brute_bytes(rows(), window)
    assert suffix_dedup.dedup(empty(spark)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_removed) for r in substring_fm.dedup(df).collect())
    assert got == [(0, 0), (1, 50), (1, 50), (2, 0)]
    alone = spark.createDataFrame([(1, "x" * 100 + text), (1, "x" * 100 + text)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.dedup(alone).collect()] == [0, 0]
    assert SCHEMA


def test_wavelet_rank_and_backward_search():
    r = np.random.default_rng(3)
    text = r.integers(0, 9, 500)
    wm = WaveletMatrix(text, 9)
    for i in (0, 1, 63, 64, 65, 499, 500):
        got = wm.rank(np.arange(9), np.full(9, i))
        assert got.tolist() == [int((text[:i] == s).sum()) for s in range(9)]
    pieces = [r.integers(1, 4, r.integers(5, 30)) for _ in range(30)]
    text = np.concatenate([np.append(p, 0) for p in pieces])
    lengths = np.array([len(p) for p in pieces])
    starts = np.cumsum(lengths + 1) - lengths - 1
    for depth in (2, 3, 4, 5):
        index = FMIndex(text, 4, depth)
        got, width = matching_statistics(index, text, starts, lengths)
        by = defaultdict(list)
        for s, n in zip(starts, lengths):
            for a in range(s, s + n - depth + 1):
                by[tuple(text[a : a + depth])].append((int(got[a]), int(width[a])))
        # one interval for equal matches, as wide as there are suffixes that match
        assert all(set(x) == {(x[0][0], len(x))} for x in by.values())
        assert len({x[0][0] for x in by.values()}) == len(by)


def test_nearest_bounds():
    r = np.random.default_rng(1)
    bits = r.random(1000) < 0.01
    bits[[0, -1]] = True
    b, at = Bounds(bits), np.arange(1000)
    assert b.at_or_before(at).tolist() == [int(np.flatnonzero(bits[: i + 1])[-1]) for i in at]
    assert b.at_or_after(at).tolist() == [int(i + np.flatnonzero(bits[i:])[0]) for i in at]


def test_index_is_compressed_and_decides(monkeypatch):
    r = np.random.default_rng(5)
    codes = r.integers(0, 1000, 20_000)
    codes[15_000:15_100] = codes[100:200]
    shard = _routing.Shard(np.array([1, 2]), np.array([0, 0]), np.array([0, 0], dtype=np.int32), np.array([9_981, 9_981], dtype=np.int32), np.array([1, 1]), codes)
    cut = substring_fm.earlier_windows(shard, 20)
    assert np.flatnonzero(cut).tolist() == list(range(9_981 + 5_000, 9_981 + 5_081))
    index = FMIndex(codes + 1, 1001, 20)
    assert index.nbytes < 4 * len(codes)  # ten levels of bits and their counts, not arrays of places
    assert not any(isinstance(x, np.ndarray) and len(x) >= len(codes) for x in vars(index).values())
    monkeypatch.setattr(WaveletMatrix, "rank", lambda self, symbol, i: i * 0)
    assert np.flatnonzero(substring_fm.earlier_windows(shard, 20)).tolist() != np.flatnonzero(cut).tolist()


def test_text_ids_and_long_texts(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([("b2", text), ("a1", text), (None, None), ("c", "x")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_removed) for r in substring_fm.dedup(df).collect()) == [("", 0), ("a1", 0), ("b2", 50), ("c", 0)]
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(df, window=100).collect()} == {"a1": len(text), "b2": len(text), None: 0, "c": 0}
    monkeypatch.setattr(_routing, "PIECE", 300)
    monkeypatch.setattr(_routing, "GATHERED", 40)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_fm.dedup(documents(spark), window=20, anchor_words=2).collect()} == brute_words(rows())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(documents(spark), window=40, anchor_bytes=12).collect()} == brute_bytes(rows(), 40)


def test_deep_shallow_order():
    rnd = random.Random(1)
    base = bytes(rnd.choice(b"ab") for _ in range(300))
    text = np.frombuffer(base + base[:250] + bytes(100) + base[50:], dtype=np.uint8)
    depth = 60
    places = np.arange(len(text) - depth)
    order, group = sort_suffixes(text, places, depth)
    key = lambda i: text[i : i + depth].tobytes()
    keys = [key(i) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(places)
    assert all((group[i] == group[i - 1]) == (keys[i] == keys[i - 1]) for i in range(1, len(keys)))


def test_common_passages_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(_routing, "SAMPLE", 1)
    monkeypatch.setattr(_routing, "SHARE", 0.05)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 5)))
    passage = " ".join(word() for _ in range(60))
    table = [(i, " ".join(word() for _ in range(r.randint(0, 30))) + " " + passage + " " + " ".join(word() for _ in range(r.randint(0, 30)))) for i in range(120)]
    table += [(1000 + i, table[i % 7][1]) for i in range(60)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(9)
    from pathloom.llm._routing import Windows, common_grams, keyed

    assert len(common_grams(keyed(df, "doc_id", "text").select("did", "th", "text"), Windows(True, 20, 5))) >= 50
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_fm.dedup(df).collect()}
    assert got == brute_words(sorted(table))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.dedup(df).collect()}
    assert got == brute_bytes(table)
