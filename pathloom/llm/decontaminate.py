"""Benchmark decontamination: benchmark n-grams in a broadcast hash set, scanned over document token windows.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters. A window is ``n``
consecutive words of one benchmark item; an item with fewer words, but not none, is one window. A document
word inside any occurrence of a window is *hit*; hash hits are verified against the window's words.

Defined results: a null text has no words; a null item is no item; rows repeat as they come (a document
given twice is scanned twice); equal item texts each count under their own id; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pathloom.llm._text import ALNUM_WORDS, U, Words, batch_of, binary, chunks, columns, covered, word_span_hash
from pathloom.plans.durable import durable

#: Most windows in one broadcast set; a larger benchmark is scanned in several passes, each with its own set.
MAX_BROADCAST_WINDOWS = 2_000_000
N_GRAM = 13
_BITS = 24


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N_GRAM) -> DataFrame:
    """One row per distinct window: its words joined by spaces, their number, and the ids of its items."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    return (
        benchmark.select(F.col(id_col).cast("string").alias("item"), words.alias("w"))
        .where("item is not null and size(w) > 0")
        .select("item", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {n}, 0)), i -> slice(w, i + 1, {n}))")).alias("win"))
        .groupBy(F.array_join("win", " ").alias("window"), F.size("win").alias("len"))
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


class _Index:
    """The broadcast set: for each window length, sorted hashes with the windows' words and items."""

    def __init__(self, rows: list):
        self.by_len: dict[int, tuple[np.ndarray, list, list, np.ndarray]] = {}
        for length in sorted({r["len"] for r in rows}):
            mine = [r for r in rows if r["len"] == length]
            texts = [r["window"].encode() for r in mine]
            h = _hash_windows(texts, length)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[(h >> U(64 - _BITS)).astype(np.int64)] = True
            self.by_len[length] = (h[order], [texts[i] for i in order], [list(mine[i]["items"]) for i in order], bits)


def _hash_windows(texts: list[bytes], length: int) -> np.ndarray:
    out = [np.zeros(0, dtype=np.uint64)]
    for c in chunks(texts):
        w = Words(c, ALNUM_WORDS)
        out.append(word_span_hash(w.hashes())(w.first[:-1], w.first[:-1] + length))
    return np.concatenate(out)


def _scan(texts: list[bytes], index: _Index) -> Iterator[tuple[int, int, np.ndarray, set, Words, int]]:
    """For each text: its row, number of words, hit mask, items, and where its words are."""
    for c in chunks(texts):
        w = Words(c, ALNUM_WORDS, lower=True)
        n, doc = len(w), w.doc_of()
        starts, ends, items = [], [], [set() for _ in c.texts]
        if n and index.by_len:
            spans = word_span_hash(w.hashes())
            last = w.first[1:][doc]
            for length, (known, windows, owners, bits) in index.by_len.items():
                at = np.flatnonzero(np.arange(n) + length <= last)
                if not len(at):
                    continue
                h = spans(at, at + length)
                may = np.flatnonzero(bits[(h >> U(64 - _BITS)).astype(np.int64)])
                k = np.searchsorted(known, h[may])
                ok = k < len(known)
                may, k = may[ok], k[ok]
                ok = known[k] == h[may]
                for i, j in zip(at[may[ok]].tolist(), k[ok].tolist(), strict=True):
                    words = b" ".join(w.raw[w.starts[x] : w.ends[x]].tobytes() for x in range(i, i + length))
                    while j < len(known) and windows[j] != words and j + 1 < len(known) and known[j + 1] == known[j]:
                        j += 1
                    if windows[j] == words:
                        starts.append(i)
                        ends.append(i + length)
                        items[doc[i]].update(owners[j])
        hit = covered(n, np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64))
        for d, row in enumerate(c.rows):
            a, b = int(w.first[d]), int(w.first[d + 1])
            yield row, b - a, hit[a:b], items[d], w, a


def _passes(windows: DataFrame, limit: int) -> list[DataFrame]:
    """The windows in blocks of about ``limit`` at most, so that no broadcast grows with the benchmark."""
    table = durable(windows)
    blocks = max(1, -(-table.count() // limit))
    return [table.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b) for b in range(blocks)]


def _held(spark: SparkSession, block: DataFrame) -> Broadcast:
    return spark.sparkContext.broadcast(_Index(block.collect()))


def scan(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_GRAM, item_col: str = "item_id", item_text_col: str = "text", limit: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Per document: ``n_words, n_hit, n_items, items_sha256, contaminated``."""
    spark = documents.sparkSession
    windows = benchmark_windows(benchmark, item_col, item_text_col, n)
    docs = documents.select(id_col, F.col(text_col).alias("text"))
    kind = documents.schema[id_col].dataType.simpleString()
    verdict = ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    results = "n_words long, n_hit long, n_items long, items_sha256 string"
    passes = _passes(windows, limit)
    if len(passes) == 1:
        held = _held(spark, passes[0])
        return docs.mapInArrow(lambda it: _summaries(it, held.value), f"`{id_col}` {kind}, {results}").select("*", verdict)
    # several sets, one at a time: the words that each of them hits, united by document
    parts = []
    for block in passes:
        held = _held(spark, block)
        parts.append(durable(docs.select(id_col, "text", F.xxhash64("text").alias("_t")).mapInArrow(lambda it, held=held: _masks(it, held.value), f"`{id_col}` {kind}, _t long, n_words long, hit binary, items array<string>")))
        held.destroy()
    every, sets = parts[0], len(parts)
    for x in parts[1:]:
        every = every.unionByName(x)

    def unite(frame):
        import pandas as pd

        hit = int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in frame["hit"]])).sum())
        names = sorted({y for x in frame["items"] for y in x})
        same = len(frame) // sets  # rows given more than once
        return pd.DataFrame({id_col: frame[id_col].iloc[:same], "n_words": int(frame["n_words"].iloc[0]), "n_hit": hit, "n_items": len(names), "items_sha256": _digest(names)})

    return every.groupBy(id_col, "_t").applyInPandas(unite, f"`{id_col}` {kind}, {results}").select("*", verdict)


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def _summaries(batches: Iterator[pa.RecordBatch], index: _Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(w, int(hit.sum()), len(items), _digest(sorted(items))) for _, w, hit, items, _w, _a in _scan(binary(batch.column(1)), index)]
        schema = pa.schema([batch.schema.field(0), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())])
        yield batch_of(schema, [batch.column(0), *columns(out, 4)])


def _masks(batches: Iterator[pa.RecordBatch], index: _Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(w, np.packbits(hit).tobytes(), sorted(items)) for _, w, hit, items, _w, _a in _scan(binary(batch.column(1)), index)]
        schema = pa.schema([batch.schema.field(0), ("_t", pa.int64()), ("n_words", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(pa.string()))])
        yield batch_of(schema, [batch.column(0), batch.column(2), *columns(out, 3)])


def clean(documents: DataFrame, benchmark: DataFrame, drop: Column | None = None, text_col: str = "text", n: int = N_GRAM, item_col: str = "item_id", item_text_col: str = "text", limit: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """``documents`` without those that are contaminated (hit words are a twentieth of the words at least);
    from the others the hit spans are cut. All columns of ``documents`` stay; a null text stays null."""
    spark = documents.sparkSession
    windows = benchmark_windows(benchmark, item_col, item_text_col, n)
    at, width = documents.columns.index(text_col), len(documents.columns)
    mask = "_hit"
    while mask in documents.columns:
        mask += "_"
    # every set scans the text as given; the words hit so far go along as a column, the last set judges and cuts
    *others, last = _passes(windows, limit)
    out = documents
    for block in others:
        held = _held(spark, block)
        schema = StructType([*documents.schema.fields, StructField(mask, BinaryType())])
        out = durable(out.mapInArrow(lambda it, held=held: _marked(it, at, width, mask, held.value), schema))
        held.destroy()
    last = _held(spark, last)
    return out.mapInArrow(lambda it: _cleaned(it, at, width, last.value), documents.schema)


def _hits(batch: pa.RecordBatch, at: int, width: int, index: _Index) -> Iterator[tuple[int, int, np.ndarray, Words, int]]:
    """For each text: its row, number of words, the words hit by ``index`` or by the sets before, and where its words are."""
    before = batch.column(width) if batch.num_columns > width else None
    for row, words, hit, _, w, a in _scan(binary(batch.column(at)), index):
        if before is not None:
            hit = hit | np.unpackbits(np.frombuffer(before[row].as_py(), dtype=np.uint8), count=words).astype(bool)
        yield row, words, hit, w, a


def _marked(batches: Iterator[pa.RecordBatch], at: int, width: int, mask: str, index: _Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [np.packbits(hit).tobytes() for _, _, hit, _, _ in _hits(batch, at, width, index)]
        schema = pa.schema([*[batch.schema.field(i) for i in range(width)], (mask, pa.binary())])
        yield batch_of(schema, [*batch.columns[:width], pa.array(hits, type=pa.binary())])


def _cleaned(batches: Iterator[pa.RecordBatch], at: int, width: int, index: _Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(at)
        texts = binary(column)
        keep, new = [], []
        for row, words, hit, w, a in _hits(batch, at, width, index):
            if hit.any() and 20 * int(hit.sum()) >= words:
                continue
            keep.append(row)
            new.append(cut(texts[row], hit, w, a) if column[row].is_valid else None)
        got = batch.select(range(width)).take(pa.array(keep, type=pa.int64()))
        yield got.set_column(at, batch.schema.field(at), pa.array(new, type=pa.binary()).cast(batch.schema.field(at).type))


def cut(text: bytes, hit: np.ndarray, w: Words, a: int) -> bytes:
    """The text without the bytes from the first to the last word of each run of hit words."""
    if not hit.any():
        return text
    step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    base = int(w.starts[a]) - _lead(text, w, a)
    out, at = [], 0
    for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
        out.append(text[at : int(w.starts[a + s]) - base])
        at = int(w.ends[a + e - 1]) - base
    return b"".join([*out, text[at:]])


def _lead(text: bytes, w: Words, a: int) -> int:
    """Bytes before the text's first word."""
    low = np.frombuffer(text.lower(), dtype=np.uint8)
    return int(np.flatnonzero(ALNUM_WORDS[low])[0])
