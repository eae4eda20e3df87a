"""Counts against the tokenizer over whole texts."""

import random

import public_tokenizers
import pytest
import sentencepiece

from pathloom.llm import token_counts
from tests.llm import data

PATH = public_tokenizers.path("piece_bpe_32k.model")


def check(got, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in texts)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == want


ODD = [" ", "  ", "\n", " \n", "\n \n\n", "a▁b ▁", "<s>hi</s> <unk> <0x0A>", "ﬁ Å é́ 　x y", "\x00a\x00", "\t\ta \r\n b", "漢字" * 200, "ab " + " " * 90 + "c", "😀" * 50, "x" * 5000, "a" * 70 + "\n" * 80, "=" * 200 + "é" * 90, "word " * 6000]


@pytest.mark.parametrize("most", [0, 40, token_counts.COMMON])
def test_counts_of_awkward_rows(spark, most):
    rows = [(i, t) for i, t, *_ in data.rows()] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, token string, pieces long").repartition(3)
    check(token_counts.count(df, PATH, most=most), rows)


def test_random_strings(spark):
    r = random.Random(3)
    alphabet = "ab  \n▁eé漢😀\t<s>.,1ing the"
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.choice((3, 30, 300))))) for i in range(400)]
    check(token_counts.count(spark.createDataFrame(rows, "doc_id long, text string"), PATH, most=100), rows)


def test_text_ids_and_empty_table(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    assert {(r["doc_id"], r["n_tokens"]) for r in token_counts.count(df, PATH).collect()} == {("a", 2), ("b", 0)}
    assert token_counts.count(data.empty(spark), PATH).count() == 0


def test_cuts():
    model = token_counts.Pieces(PATH)
    assert "\n" not in "".join(model.pairs)
    assert model.cut("a b\n\nb b") == {" a": 1, " b": 2, "\n\n": 1, "b": 1}
