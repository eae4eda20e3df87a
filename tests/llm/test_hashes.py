"""Strings that cancel in a polynomial modulo a power of two are told apart."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pathloom.llm import packing, quality, substring_fm, suffix_dedup
from pathloom.llm._text import SpanHash, byte_values


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


A, B = thue_morse(1024), thue_morse(1024, "b", "a")


def test_spans_of_all_lengths():
    for n in (16, 31, 32, 64, 1024):
        raw = np.frombuffer((thue_morse(n) + thue_morse(n, "b", "a") + thue_morse(n)).encode(), dtype=np.uint8)
        h = SpanHash(byte_values(raw))(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert h[0] != h[1] and h[0] == h[2]


def test_windows_of_different_words_stay(spark):
    words = [f"w{i}" for i in range(20)]
    df = spark.createDataFrame([(1, " ".join([A, *words])), (2, " ".join([B, *words])), (3, " ".join([B, *words]))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_fm.dedup(df).collect()}
    assert got == {1: 0, 2: 20, 3: 21}
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup(spark.createDataFrame([(1, A[:300]), (2, B[:300])], "doc_id long, text string")).collect()}
    naive = {}
    for i, t in ((1, A[:300]), (2, B[:300])):
        for p in range(101):
            naive.setdefault(t[p : p + 200], []).append((i, p))
    gone = {1: set(), 2: set()}
    for at in naive.values():
        if len(at) > 1:
            for i, p in at:
                gone[i] |= set(range(p, p + 200))
    assert got == {i: len(x) for i, x in gone.items()}


def test_lines_and_tokens_of_different_words(spark):
    df = spark.createDataFrame([(1, f"{A}\n{B}\n{A}"), (2, A), (3, B)], "doc_id long, text string").selectExpr("*", "'x' lang", "'y' source")
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.judge(df).collect()} == {1: 1, 2: 0, 3: 0}
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for text in (A, B, f"{A} {B}"):
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        row = packing.pack(spark.createDataFrame([(0, A), (1, text)], "doc_id long, text string"), path).where("doc_id = 1").collect()
        assert sum(r["length"] for r in row) == len(want)
        if len(row) == 1:
            assert row[0]["ids_crc32"] == zlib.crc32(np.array(want, dtype="<u4").tobytes())
