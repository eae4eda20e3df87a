"""Sequence packing along a space-filling curve.

Each document becomes ids of a public tokenizer and an end id. The bag of its ids, hashed to signs, is
projected to ``DIMS`` numbers; their Hilbert key orders the documents, ties and equal texts by a hash of the
id. The corpus is cut into ranges of that order at quantiles of drawn keys; each range is sorted and its tokens
follow those of the ranges before, so sequences of ``CONTEXT`` tokens are filled without gaps and only the
last one of all is short. Documents are cut where sequences end.

Defined results: a null or empty text is its end id alone; equal rows each have their own pieces; a null id
stays null; an empty table packs to nothing. The last sequence is as long as what is left.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._text import Chunk, SpanHash, U, batch_of, binary, byte_values, chunks, ragged
from pathloom.plans.durable import durable

CONTEXT = 4096
END_ID = 2
DIMS = 3
CURVE_BITS = 12
#: Words whose ids a worker remembers; beyond that it starts anew.
MEMO_WORDS = 600_000
#: Tokens that count once when the order is cut into ranges.
WEIGHT = 1024
#: Most ranges of the order, whatever the input: their sums go through the driver.
MAX_RANGES = 20_000
#: Keys drawn for each range to find its ends.
DRAWN = 200


class WordMemo:
    """Ids of whole texts by way of the tokenizer's own words, each of which the tokenizer sees once.

    Texts of letters up to U+024F, digits and punctuation are split to the tokenizer's words here, by the
    kinds of their bytes; all other texts (and those with marks, contractions, or special tokens) go to the
    tokenizer whole.
    """

    _WHOLE = re.compile("[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-įı-ɏ]|'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|<\\|")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = np.full(256, 3, dtype=np.uint8)  # others
        kind[[32, *range(9, 14)]] = 0
        kind[ord("0") : ord("9") + 1] = 2
        kind[ord("a") : ord("z") + 1] = 1
        kind[128:] = 1
        self.kind = kind
        self.clear()
        self.alphabet = _byte_letters()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.first = np.zeros(1 << 16, dtype=np.int64)
        self.length = np.zeros(1 << 16, dtype=np.int64)
        self.pool = np.zeros(1 << 18, dtype=np.uint16)
        self.used = 0

    def _add(self, word: bytes) -> None:
        ids = [t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.alphabet))]
        k = len(self.at)
        if k == len(self.first):
            self.first, self.length = np.resize(self.first, 2 * k), np.resize(self.length, 2 * k)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool) + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[k], self.length[k] = self.used, len(ids)
        self.used += len(ids)
        self.at[word] = k

    def _by_words(self, lowered: list[bytes]) -> list[np.ndarray]:
        """Ids of some lower-cased texts."""
        c = Chunk(list(range(len(lowered))), lowered)
        raw = c.buffer()
        kind = self.kind[raw]
        new = np.ones(len(raw), dtype=bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(raw))
        full = kind[s] > 0
        s, e = s[full], e[full]
        _, place, which = np.unique(SpanHash(byte_values(raw))(s, e), return_index=True, return_inverse=True)
        if not _alike(raw, s, e, place[which]):  # two words of one hash
            return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, dtype=np.uint16) for t in lowered]
        if len(self.at) + len(place) > MEMO_WORDS:
            self.clear()
        known = np.empty(len(place), dtype=np.int64)
        for i, (a, b) in enumerate(zip(s[place].tolist(), e[place].tolist(), strict=True)):
            word = raw[a:b].tobytes()
            k = self.at.get(word)
            if k is None:
                k = len(self.at)
                self._add(word)
            known[i] = k
        k = known[which]
        sizes = self.length[k]
        ids = self.pool[ragged(self.first[k], sizes)]
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(s, np.append(c.starts, len(raw)))]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, as 16-bit numbers."""
        out: list[np.ndarray] = [None] * len(texts)
        easy, lowered = [], []
        for i, t in enumerate(texts):
            text = t.decode()
            if self._WHOLE.search(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint16)
            else:
                easy.append(i)
                lowered.append(text.lower().encode())
        if easy:
            for i, ids in zip(easy, self._by_words(lowered), strict=True):
                out[i] = ids
        return out


def _alike(raw: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> bool:
    """Whether each word has the bytes of the word ``first`` says is the same, eight at a time."""
    words = np.ndarray(len(raw) + 1, dtype="<u8", buffer=np.append(raw, np.zeros(8, dtype=np.uint8)), strides=(1,))
    size = e - s
    if (size != size[first]).any():
        return False
    other = np.flatnonzero(first != np.arange(len(s)))
    at = 0
    while len(other):
        left = np.minimum(size[other] - at, 8).astype(np.uint64)
        keep = ~U(0) >> (U(64) - U(8) * left)
        if (((words[s[other] + at] ^ words[s[first[other]] + at]) & keep) != 0).any():
            return False
        at += 8
        other = other[size[other] > at]
    return True


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    return {b: chr(b) if b in own else chr(256 + sum(x not in own for x in range(b))) for b in range(256)}


@lru_cache(maxsize=2)
def _memo(path: str) -> WordMemo:
    return WordMemo(path)


@lru_cache(maxsize=2)
def _directions(dims: int) -> np.ndarray:
    """A direction for each id; their sums project the hashed vector of a document."""
    return np.random.default_rng(11).standard_normal((1 << 16, dims)).astype(np.float32)


def hilbert_keys(points: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (n x dims), after Skilling (2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(docs: list[np.ndarray], dims: int = DIMS, bits: int = CURVE_BITS) -> np.ndarray:
    """Hilbert keys of documents given as ids."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    flat = np.concatenate(docs) if len(docs) else np.zeros(0, dtype=np.uint16)
    sums = np.zeros((len(docs), dims))
    full = np.flatnonzero(sizes)
    if len(full):
        first = (np.cumsum(sizes) - sizes)[full]
        for i in range(dims):
            sums[full, i] = np.add.reduceat(_directions(dims)[:, i][flat], first, dtype=np.float64)
    mean = sums / np.maximum(sizes, 1)[:, None]  # so that long documents don't gather in the corners
    place = 1 / (1 + np.exp(-np.clip(8 * mean, -30, 30)))  # to (0, 1)
    return hilbert_keys(np.minimum((place * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


_IDS = [("key", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())]


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = pa.schema([batch.schema.field(0), *_IDS])
        tie = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFF
        for c in chunks(binary(batch.column(2))):
            docs = [np.append(x, np.uint16(end_id)) for x in _memo(path).encode(c.texts)]
            rows = np.array(c.rows)
            key = (curve_keys(docs) << 24) | tie[rows]
            yield batch_of(schema, [batch.column(0).take(pa.array(rows)), key, [len(d) for d in docs], [d.tobytes() for d in docs]])


_PIECES = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]


def _pieces(batches: Iterator[pa.RecordBatch], base: dict[int, int], context: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Ranges come one after another, each in order; ``base`` has the tokens before each range."""
    now, at = None, 0
    for batch in batches:
        rows = ([], [], [], [], [], [], [], [])
        for i, (part, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if part != now:
                now, at = part, base[part]
            wide = np.frombuffer(ids, dtype=np.uint16).astype("<u4")
            a = 0
            while a < len(wide):
                n = min(len(wide) - a, context - at % context)
                piece = wide[a : a + n].tobytes()
                for x, v in zip(rows, (i, a, n, zlib.crc32(piece), len(wide), at // context, at % context, piece if with_ids else None), strict=True):
                    x.append(v)
                a += n
                at += n
        yield batch_of(pa.schema([batch.schema.field(0), *_PIECES]), [batch.column(0).take(pa.array(rows[0], type=pa.int64())), *rows[1:]])


def pack(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Per piece: the id of its document, ``start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``)."""
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col).cast("string"), F.lit(5)).alias("_tie"), F.col(text_col).alias("_text"))
    held = durable(docs.mapInArrow(lambda it: _tokenise(it, tokenizer_path, end_id), f"_id {kind}, key long, n int, ids binary"), "zstd")
    n = min(MAX_RANGES, 2 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bounds = _bounds(held, n)
    ranged = held.withColumn("part", _range_of(F.col("key"), spark.sparkContext.broadcast(np.array(bounds, dtype=np.int64))))
    sums = {r["part"]: r["s"] for r in ranged.groupBy("part").agg(F.sum(F.col("n").cast("long")).alias("s")).collect()}
    base, total = {}, 0
    for p in sorted(sums):
        base[p], total = total, total + sums[p]
    ordered = ranged.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "_id", "n", "ids").select("_id", "part", "ids")
    got = ordered.mapInArrow(lambda it: _pieces(it, base, context, with_ids), f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return got.withColumnRenamed("_id", id_col) if with_ids else got.drop("ids").withColumnRenamed("_id", id_col)


def _bounds(held: DataFrame, n: int) -> list[int]:
    """Where the order is cut to ``n`` ranges of about equal tokens. They decide on the dealing alone, so keys drawn by a
    hash, in proportion to their tokens, tell them: ``DRAWN`` for each range or so, or all where there are fewer."""
    blocks = held.agg(F.sum(F.ceil(F.col("n") / WEIGHT))).first()[0] or 0
    share = min(1.0, DRAWN * n / max(1, blocks))
    drawn = held.select("key", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / WEIGHT).cast("int"))).alias("i"))
    drawn = drawn.where(F.pmod(F.xxhash64("key", "i"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("key")
    keys = np.sort(drawn.toPandas()["key"].to_numpy(dtype=np.int64))
    return sorted(set(keys[[len(keys) * i // n for i in range(1, n)]].tolist())) if len(keys) else []


def _range_of(key, bounds):
    """The number of bounds below the key."""

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, keys.to_numpy(), side="left").astype(np.int32))

    return number(key)


def padding(pieces: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Per sequence: its tokens and the padding it needs (none at a power of two)."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return used.select("sequence_id", "tokens", F.when(power, 0).otherwise(context - F.col("tokens")).alias("padding"))


