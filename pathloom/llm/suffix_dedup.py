"""Substring dedup over bytes by suffix sorting.

Texts are UTF-8 bytes. Each byte in a ``WINDOW``-byte string that also starts anywhere else, in its own
document or another, is removed, all strings judged on the input. Windows meet in shards by their anchors
(:mod:`_routing`); a shard orders the suffixes that begin its windows by deep-shallow sorting
(:mod:`suffix_sort`) and finds the neighbours that agree in a window's length.

Defined results: a null text is empty; repeated rows of one id and text are one document and get the same
result; what is left of a text may end within a character, so it is kept as bytes; ids are of any kind; a text of any
length is cut to overlapping pieces where arrays would get too large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._routing import Shard, Windows, keyed, spans_to_cut
from pathloom.llm._text import batch_of, binary, columns, covered, ragged
from pathloom.llm.suffix_sort import sort_suffixes

WINDOW = 200
ANCHOR_BYTES = 32


def repeated_windows(shard: Shard, width: int) -> np.ndarray:
    """Which windows of the shard's contents occur twice or more, the contents' own copies counted."""
    sizes = shard.count.astype(np.int64)
    lengths = sizes + width - 1
    starts = np.cumsum(lengths) - lengths
    windows = ragged(starts, sizes)
    order, group = sort_suffixes(shard.codes, windows, width)
    number = np.empty(len(shard.codes), dtype=np.int64)  # of the window that starts at a place
    number[windows] = np.arange(len(windows))
    which = number[order]
    times = np.bincount(group, weights=np.repeat(shard.copies.astype(np.int64), sizes)[which], minlength=len(windows))
    out = np.zeros(len(windows), dtype=bool)
    out[which] = times[group] >= 2
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(binary(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            kept, gone, runs = text, 0, 0
            if spans:
                at = np.array([(s["start"], s["end"]) for s in spans], dtype=np.int64)
                cut = covered(len(text), np.minimum(at[:, 0], len(text)), np.minimum(at[:, 1], len(text)))
                gone = int(cut.sum())
                runs = int((np.diff(cut.astype(np.int8), prepend=0) == 1).sum())
                kept = np.frombuffer(text, dtype=np.uint8)[~cut].tobytes()
            out.append((len(text), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
        schema = pa.schema([batch.schema.field(0), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_bytes", pa.binary())])
        yield batch_of(schema, [batch.column(0), *columns(out, 5)])


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """Per row: its id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` and ``kept_bytes``."""
    docs = keyed(documents, id_col, text_col)
    cuts = spans_to_cut(docs.select("did", "th", "text"), Windows(False, window, min(anchor_bytes, window)), repeated_windows)
    kind = documents.schema[id_col].dataType.simpleString()
    done = docs.join(cuts, ["did", "th"], "left").select("_id", "text", "cuts").mapInArrow(_apply, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return done.select(F.col("_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")
