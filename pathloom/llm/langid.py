"""Language identification by nearest centroid.

A text becomes counts of byte 2- and 3-grams of its lower-cased words, hashed to ``FEATURES`` numbers, damped,
weighted by inverse document frequency and normalised. Each language learns ``CENTROIDS`` centroids by
spherical k-means; a text gets the language of the centroid of greatest cosine. A text further from that
centroid than nearly all that it was learned from is *rejected*, which is a column of its own.

Document frequencies come from all rows that may be learned from. Centroids are fitted on a bounded sample:
``TRAIN_ROWS`` different texts of a language at most, chosen by a hash of the text. Every language that occurs is
learned; centroids of many languages go to the tasks block by block, ``BLOCK`` of them at a time.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text where nothing
could be learned. Rows with a null id are learned from unless the hash of the empty string says otherwise.
Ties go to the language first in order. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm._text import Chunk, U, batch_of, binary, chunks
from pathloom.plans.durable import durable

FEATURES = 2048
CENTROIDS = 4
TRAIN_ROWS = 1500
#: Centroids in one broadcast: 33 MB.
BLOCK = 4096
ROUNDS = 12
#: Share of a centroid's own texts that its limit of distance takes in, and what is added to that limit.
INSIDE, SLACK = 0.995, 0.1
UNKNOWN = "und"

_BITS = FEATURES.bit_length() - 1


def vectors(c: Chunk) -> np.ndarray:
    """Damped counts of the hashed n-grams of each text of a chunk."""
    lowered = Chunk(c.rows, [t.decode().lower().encode() for t in c.texts])
    raw = lowered.buffer()
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    x = np.where(letter, raw, 32).astype(np.uint64)
    x = np.concatenate((np.array([32], dtype=np.uint64), x, np.array([32], dtype=np.uint64)))  # x[i + 1] is byte i
    doc = np.repeat(np.arange(len(c.texts)), lowered.lengths + 1)
    at = np.flatnonzero(letter)
    two = (x[at + 1] << U(8)) | x[at + 2]
    three = (x[at] << U(16)) | two
    cell = np.concatenate([doc[at] * FEATURES + ((g * U(0x9E3779B97F4A7C15)) >> U(64 - _BITS)).astype(np.int64) for g in (two + U(1 << 30), three)])
    counts = np.bincount(cell, minlength=len(c.texts) * FEATURES).reshape(len(c.texts), FEATURES)
    return np.log1p(counts).astype(np.float32)


def normalised(v: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = v * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def held_out(id_col: Column, parts: int = 4, part: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(parts)) == part


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's document frequencies; feature -1 has the number of documents."""
    total, n = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        for c in chunks(binary(batch.column(0))):
            total += (vectors(c) > 0).sum(axis=0)
            n += len(c.texts)
    yield batch_of(pa.schema([("feature", pa.int32()), ("n", pa.int64())]), [np.arange(-1, FEATURES, dtype=np.int32), np.append(n, total)])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("v", pa.binary())])
    for batch in batches:
        for c in chunks(binary(batch.column(2))):
            rows = pa.array(c.rows)
            yield batch_of(schema, [batch.column(0).take(rows), batch.column(1).take(rows), [v.astype(np.float16).tobytes() for v in vectors(c)]])


def centroids(v: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from a farthest-first start; the centroids and each one's limit of distance."""
    middle = v.mean(axis=0)
    picked = [int(np.argmax(v @ middle))]
    near = v @ v[picked[0]]
    while len(picked) < min(k, len(v)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[picked[-1]])
    c = v[picked]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    cosine = v @ c.T
    own = np.argmax(cosine, axis=1)
    far = 1 - cosine[np.arange(len(v)), own]
    limit = np.array([np.quantile(far[own == i], INSIDE) if (own == i).any() else 0.0 for i in range(len(c))])
    return c, limit + SLACK


def fit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, DataFrame]:
    """A model from rows that have a language: inverse document frequencies, and a table ``lang, k, c, limit`` of centroids."""
    known = documents.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text", F.lit(17)))
    df = {r["feature"]: r["s"] for r in known.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("s")).collect()}
    idf = (np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(FEATURES)], dtype=np.float64))) + 1).astype(np.float32)
    sizes = durable(known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("texts")))
    picked = known.join(sizes, "lang").where(F.pmod("h", F.lit(1_000_000)) < 1_200_000 * train_rows / F.col("texts"))
    # copies of a text are one, or a text given very often would fill its language's sample
    sample = picked.groupBy("lang", "h").agg(F.first("text").alias("text")).mapInArrow(_sampled, "lang string, h long, v binary")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "v"]).head(train_rows)
        v = normalised(np.stack([np.frombuffer(x, dtype=np.float16) for x in frame["v"]]).astype(np.float32), idf)
        c, limit = centroids(v)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "k": np.arange(len(c)), "c": [x.astype(np.float32).tobytes() for x in c], "limit": limit})

    return idf, durable(sample.groupBy("lang").applyInPandas(learn, "lang string, k int, c binary, limit double"))


def _blocks(idf: np.ndarray, table: DataFrame, size: int) -> Iterator[dict]:
    """The model in parts of ``size`` centroids or so, languages in order within each."""
    parts = max(1, -(-table.count() // size))
    for part in range(parts):
        rows = table.where(F.pmod(F.xxhash64("lang"), F.lit(parts)) == part).orderBy("lang", "k").collect()
        if rows or not part:
            vectors = np.stack([np.frombuffer(r["c"], dtype=np.float32) for r in rows]) if rows else np.zeros((0, FEATURES), dtype=np.float32)
            yield {"idf": idf, "langs": [r["lang"] for r in rows], "centroids": vectors, "limits": np.array([r["limit"] for r in rows])}


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


_FIELDS = [("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]


def _predict(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """``id, text, lang_pred, score, rejected``; where the input has predictions by other blocks, the best of both."""
    for batch in batches:
        if batch.num_columns > 2:
            lang, score, out = batch.column(2).to_pylist(), batch.column(3).to_numpy().copy(), batch.column(4).to_numpy(zero_copy_only=False).copy()
        else:
            lang, score, out = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, dtype=bool)
        if model["langs"]:
            for c in chunks(binary(batch.column(1))):
                cosine = normalised(vectors(c), model["idf"]) @ model["centroids"].T
                best = np.argmax(cosine, axis=1)
                for i, row in enumerate(c.rows):
                    if _has_letter(c.texts[i]):
                        k = best[i]
                        new = (min(1.0, max(0.0, float(cosine[i, k]))), model["langs"][k])
                        if lang[row] == UNKNOWN or new[0] > score[row] or (new[0] == score[row] and new[1] < lang[row]):
                            score[row], lang[row] = new
                            out[row] = 1 - cosine[i, k] > model["limits"][k]
        yield batch_of(pa.schema([batch.schema.field(0), batch.schema.field(1), *_FIELDS]), [batch.column(0), batch.column(1), lang, score, out])


def predict(documents: DataFrame, model: tuple[np.ndarray, DataFrame], id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: its id, ``lang_pred``, ``score`` (the cosine), ``rejected``; from the text alone."""
    kind = documents.schema[id_col].dataType.simpleString()
    out = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    for part in _blocks(*model, block):
        held = documents.sparkSession.sparkContext.broadcast(part)
        out = out.mapInArrow(lambda it, held=held: _predict(it, held.value), f"_id {kind}, _text string, lang_pred string, score double, rejected boolean")
    return out.select(F.col("_id").alias(id_col), "lang_pred", "score", "rejected")


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts all: id, ``held_out, lang_pred, score, rejected``."""
    model = fit(documents.where(~held_out(F.col(id_col))), text_col, lang_col)
    got = predict(documents, model, id_col, text_col)
    return got.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score", "rejected")
