import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from pathloom.llm import packing
from pathloom.llm.queries import tokenizer_path
from tests.llm.data import documents, empty, rows


def test_memo_equals_tokenizer():
    whole = Tokenizer.from_file(tokenizer_path())
    memo = packing.WordMemo(tokenizer_path())
    odd = ["It's we'll O'Reilly 'tis", "éx", "İstanbul ΣΑΣ", "a b", "a\x1cb 12 3!!??x", "<|endoftext|> hi", "x×y÷z ª º ² ½ 中文 😀", "", " ", "don''t '''s", "$%&a|b|c ---", "naïve façade ÀÉ", "ŉ ĸ ſ"]
    r = random.Random(5)
    odd += ["".join(chr(r.randrange(0x250)) for _ in range(12)) for _ in range(500)]
    for t in odd:
        assert memo.encode([t.encode()])[0].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_hilbert_is_a_walk():
    for dims, bits in ((2, 3), (3, 2)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        key = packing.hilbert_keys(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_round_trip(spark):
    whole = Tokenizer.from_file(tokenizer_path())
    df = documents(spark)
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows()}
    for context in (4096, 64):
        pieces = packing.pack(df, tokenizer_path(), context=context, with_ids=True).collect()
        got, seq = defaultdict(list), defaultdict(list)
        for p in sorted(pieces, key=lambda p: p.start):
            ids = np.frombuffer(bytes(p.ids), dtype="<u4")
            assert len(ids) == p.length > 0 and zlib.crc32(bytes(p.ids)) == p.ids_crc32
            assert len(got[p.doc_id]) == p.start and len(want[p.doc_id]) == p.doc_tokens
            got[p.doc_id] += ids.tolist()
            seq[p.sequence_id].append((p.offset, p.length))
        assert got == want
        ends = []
        for s in sorted(seq):
            at = 0
            for offset, length in sorted(seq[s]):
                assert offset == at
                at += length
            ends.append(at)
        assert ends[:-1] == [context] * (len(ends) - 1) and ends[-1] <= context
        assert sorted(seq) == list(range(len(ends)))
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0
    short = packing.padding(packing.pack(df, tokenizer_path())).agg({"padding": "max"}).first()[0]
    assert short < 4096


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, None), (1, "b b"), (1, "b b")], "doc_id long, text string")
    assert sorted(p.length for p in packing.pack(df, tokenizer_path()).collect()) == [1, 2, 3, 3]
