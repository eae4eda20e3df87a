"""Substring dedup over words by FM-index shards.

Words are runs of anything but ASCII white space, unchanged. A window is ``WINDOW`` consecutive words of a
document. Each word in a window whose word sequence also starts earlier (smaller id, or same document and
earlier start) is removed, all windows judged on the input. Windows meet in shards by their anchors
(:mod:`_routing`); a shard builds a compressed FM-index of its contents and streams them through backward
search, which gives for each place the interval of suffixes that match a window's words. Intervals of more than one
suffix are reported; the earliest place that is in an interval stays, the others are cut.

Defined results: a null or blank text has no words; repeated rows of one id and text are one document and
get the same result; rows of one id with other texts are parts of one document, of which equal places tie; ids that aren't whole
numbers are in their own order; a text of any length is cut to overlapping pieces where arrays would get too large.
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
from pathloom.llm.fm_index import FMIndex, matching_statistics

WINDOW = 20
ANCHOR_WORDS = 5


def earlier_windows(shard: Shard, width: int) -> np.ndarray:
    """Which windows of the shard's contents match a window that starts earlier."""
    sizes = shard.count.astype(np.int64)
    lengths = sizes + width - 1
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
    text[ragged(starts, lengths)] = shard.codes + 1
    index = FMIndex(text, int(shard.codes.max()) + 2, width)
    interval, matches = matching_statistics(index, text, starts, lengths)
    windows = ragged(starts, sizes)
    out = np.zeros(len(windows), dtype=bool)
    some = np.flatnonzero(matches[windows] > 1)  # intervals above the threshold: the window stands more than once
    if len(some):
        _, doc = np.unique(shard.did, return_inverse=True)
        when = ((np.repeat(doc.astype(np.int64), sizes) << 32) + ragged(shard.start.astype(np.int64), sizes))[some]
        which = np.unique(interval[windows[some]], return_inverse=True)[1]
        earliest = np.full(int(which.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(earliest, which, when)
        out[some] = earliest[which] < when
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cuts = batch.column(2)
        out = []
        for text, spans in zip(binary(batch.column(1)), cuts.to_pylist(), strict=True):
            words = text.split()
            kept, gone = words, 0
            if spans:
                at = np.array([(s["start"], s["end"]) for s in spans], dtype=np.int64)
                cut = covered(len(words), np.minimum(at[:, 0], len(words)), np.minimum(at[:, 1], len(words)))
                gone = int(cut.sum())
                kept = [words[i] for i in np.flatnonzero(~cut)]
            joined = b" ".join(kept)
            out.append((len(words), gone, hashlib.sha256(joined).hexdigest(), joined))
        schema = pa.schema([batch.schema.field(0), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.binary())])
        n, gone, sha, kept = columns(out, 4)
        yield batch_of(schema, [batch.column(0), n, gone, sha, kept])


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """Per row: its id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text`` (kept words joined by one space)."""
    docs = keyed(documents, id_col, text_col)
    cuts = spans_to_cut(docs.select("did", "th", "text"), Windows(True, window, min(anchor_words, window)), earlier_windows)
    kind = documents.schema[id_col].dataType.simpleString()
    done = docs.join(cuts, ["did", "th"], "left").select("_id", "text", "cuts").mapInArrow(_apply, f"_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text binary")
    return done.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept_sha256", F.col("kept_text").cast("string").alias("kept_text"))
