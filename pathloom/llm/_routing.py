"""Brings equal windows of a corpus together, window by window, without comparing all documents with all.

Every window of ``width`` units (words or bytes) has one *anchor*: the k-gram in it of least hash, the
leftmost of equals, which depends on the window's content alone. Consecutive windows with one anchor form a
*stretch*. Equal windows have equal anchors, so

1. stretches are dealt by anchor as hashes, equal ones of a batch as one (its later copies go anywhere, as
   they are repeats whatever else there is); stretches whose anchor occurs once in the corpus end here, and
   equal stretches are counted once, under their earliest occurrence;
2. for the rest, the contents are cut from the texts and dealt to shards by anchor. A shard's index finds
   the equal windows among its contents;
3. what it finds is gathered by document.

k-grams that stand in many documents are anchors only of windows that hold no other: a window that reaches
over the end of a common passage goes where its rarer words say, so that a common passage's anchors get equal
stretches alone, which are counted before they are dealt. Which k-grams these are is told by a sample of the
documents; it decides on the dealing alone, never on the result.

Rows with one id and one text are one document. A null id comes before all others, a null text is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from pathloom.llm._text import BLANK_WORDS, CHUNK_BYTES, Chunk, SpanHash, U, Words, batch_of, binary, byte_values, chunks, ragged, window_minima
from pathloom.plans.durable import durable

_PLACE_BITS = 27  # places in a piece are numbered in so many bits
#: Units of a piece that is hashed at once; a longer text is cut to pieces that overlap by a window less one unit.
PIECE = 1 << 23
#: Stretches that a task gathers before it deals them, equal ones as one.
GATHERED = 1 << 21
BINS_PER_PARTITION = 8


@dataclass(frozen=True)
class Windows:
    """``width`` consecutive units; anchors are of ``gram`` units. Units are words, or bytes."""

    words: bool
    width: int
    gram: int
    piece: int = field(default_factory=lambda: PIECE)
    gathered: int = field(default_factory=lambda: GATHERED)

    @property
    def small(self) -> np.dtype:
        """Of a stretch's number of windows."""
        return np.min_scalar_type(self.width)

    def units(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunk's units, words as hashes; where each document's begin and end."""
        if self.words:
            w = Words(c, BLANK_WORDS)
            return w.hashes(), w.first[:-1], w.first[1:]
        return c.buffer(), c.starts, c.ends

    def pieces(self, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Where a piece begins in its document, its units' values, and where each document's begin and end in it. Every
        window is in one piece. A chunk is one piece, but for the text of a document that is longer."""
        values = (lambda x: x) if self.words else byte_values
        if len(units) <= self.piece:
            yield 0, values(units), starts, ends
            return
        for d in range(len(starts)):
            for a in range(int(starts[d]), max(int(starts[d]) + 1, int(ends[d]) - self.width + 1), self.piece):
                part = units[a : min(a + self.piece + self.width - 1, int(ends[d]))]
                at = np.zeros(len(starts), dtype=np.int64)
                upto = np.where(np.arange(len(starts)) == d, len(part), 0)
                at[d + 1 :] = upto[d + 1 :] = len(part)
                yield a - int(starts[d]), values(part), at, upto


class Common:
    """A sorted set of frequent k-grams' hashes."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.grams >> U(44)).astype(np.int64)] = True

    def among(self, grams: np.ndarray) -> np.ndarray:
        """Places of those of the grams that are frequent."""
        if not len(self.grams):
            return np.zeros(0, dtype=np.int64)
        may = np.flatnonzero(self.bits[(grams >> U(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.grams, grams[may]), len(self.grams) - 1)
        return may[self.grams[k] == grams[may]]


def stretches(w: Windows, units: np.ndarray, starts: np.ndarray, ends: np.ndarray, common: Common) -> tuple[np.ndarray, ...]:
    """Of a chunk: each stretch's anchor hash, content hash, document, start within it and number of windows."""
    got = []
    for offset, values, a, b in w.pieces(units, starts, ends):
        anchor, content, doc, start, count = _stretches(w, values, a, b, common)
        got.append((anchor, content, doc, start + np.int32(offset), count))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def _stretches(w: Windows, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, common: Common) -> tuple[np.ndarray, ...]:
    n = len(values) - w.width + 1
    if n <= 0 or not (ends - starts >= w.width).any():
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int32, np.int32))
    spans = SpanHash(values)
    at = np.arange(len(values) - w.gram + 1)
    grams = spans(at, at + w.gram, telling=False)
    low = U((1 << _PLACE_BITS) - 1)
    rank = grams >> U(1)
    rank[common.among(grams)] |= U(1 << 63)
    place = (window_minima((rank & ~low) | at.astype(np.uint64), w.width - w.gram + 1) & low).astype(np.int64)
    full = ends - starts >= w.width
    edge = np.zeros(n + 1, dtype=np.int8)
    edge[starts[full]] += 1
    np.subtract.at(edge, ends[full] - w.width + 1, 1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    change = np.ones(n + 1, dtype=bool)
    change[1:-1] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    cuts = np.flatnonzero(change)
    a, b = cuts[:-1], cuts[1:]
    a, b = a[valid[a]], b[valid[a]]
    doc = np.searchsorted(starts, a, side="right") - 1
    return grams[place[a]], spans(a, b - 1 + w.width), doc, (a - starts[doc]).astype(np.int32), (b - a).astype(np.int32)


#: One of so many documents tells which k-grams are frequent: those in this share of it, the most frequent first.
SAMPLE, SHARE, MAX_COMMON = 64, 0.01, 200_000


def _often(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    """k-grams that stand in three documents of a task's sample at least and in half the share of it, with their counts."""
    parts, docs = [], 0
    for batch in batches:
        for c in chunks(binary(batch.column(0))):
            docs += len(c.texts)
            for _, values, starts, ends in w.pieces(*w.units(c)):
                n = len(values) - w.gram + 1
                if n <= 0:
                    continue
                at = np.arange(n)
                doc = np.searchsorted(starts, at, side="right") - 1
                inside = at + w.gram <= ends[doc]
                grams = SpanHash(values)(at[inside], at[inside] + w.gram, telling=False)
                order = np.lexsort((doc[inside], grams))
                g, d = grams[order], doc[inside][order]
                once = np.ones(len(g), dtype=bool)
                once[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
                parts.append(np.unique(g[once], return_counts=True))
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
    if parts:
        g, which = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([y for _, y in parts])).astype(np.int64)
        some = n >= max(3, SHARE / 2 * docs)
        yield batch_of(schema, [g[some].view(np.int64), n[some]])


def common_grams(keyed_docs: DataFrame, w: Windows) -> np.ndarray:
    """Hashes of the frequent k-grams; ``MAX_COMMON`` at most."""
    sample = keyed_docs.where(F.pmod(F.xxhash64("did"), F.lit(SAMPLE)) == 0).select("text")
    least = SHARE * max(1, sample.count())
    rows = sample.mapInArrow(lambda it: _often(it, w), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(MAX_COMMON).select("gram").toPandas()
    return rows["gram"].to_numpy(dtype=np.int64).view(np.uint64)


def _parted(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


_NAMES = ("did", "th", "anchor", "content", "doc", "start", "count", "times")
_DEALT = pa.schema([("bin", pa.int32()), *((n, pa.binary()) for n in _NAMES)])
_DEALT_DDL = "bin int, " + ", ".join(f"{n} binary" for n in _NAMES)
_MOST = 1 << 16  # stretches in a row, so that 16 bits number its documents


def _gathered(batches: Iterator[pa.RecordBatch], w: Windows, common: Common) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches of many documents: ``did, th`` of each, anchor, content, start and count."""
    got, size = [], 0
    for batch in batches:
        did, th = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        for c in chunks(binary(batch.column(2))):
            anchor, content, doc, start, count = stretches(w, *w.units(c), common)
            row = np.array(c.rows)[doc]
            got.append((did[row], th[row], anchor, content, start, count))
            size += len(anchor)
            if size >= w.gathered:
                yield tuple(np.concatenate(x) for x in zip(*got, strict=True))
                got, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*got, strict=True))


def _deal(batches: Iterator[pa.RecordBatch], w: Windows, bins: int, common: Common) -> Iterator[pa.RecordBatch]:
    """Stretches by anchor, to bins below ``bins``: the earliest of equal ones with how often they occur. The others go to
    the bins from there on, by document. Within a bin 32 bits tell anchors apart well enough: contents decide."""
    for did, th, anchor, content, start, count in _gathered(batches, w, common):
        order = np.lexsort((start, th, did, content, anchor))
        did, th, anchor, content, start, count = (x[order] for x in (did, th, anchor, content, start, count))
        once = _parted(anchor, content, did, th, start)  # a document given twice is one
        did, th, anchor, content, start, count = (x[once] for x in (did, th, anchor, content, start, count))
        first = _parted(anchor, content)
        at = np.flatnonzero(first)
        times = np.zeros(len(anchor), dtype=np.int32)
        times[at] = np.diff(np.append(at, len(anchor)))
        to = np.where(first, anchor % U(bins), U(bins) + th.view(np.uint64) % U(bins)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        to, did, th, anchor, content, start, count, times = (x[order] for x in (to, did, th, anchor // U(bins), content, start, count, times))
        cuts = np.append(np.flatnonzero(_parted(to)), len(to))
        cuts = np.concatenate([np.arange(a, b, _MOST) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] + [cuts[-1:]])
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            _, own, local = np.unique(did[a:b] ^ th[a:b], return_index=True, return_inverse=True)
            if (did[a:b][own][local] != did[a:b]).any() or (th[a:b][own][local] != th[a:b]).any():
                own, local = np.arange(b - a), np.arange(b - a)
            rows.append((int(to[a]), did[a:b][own].tobytes(), th[a:b][own].tobytes(), anchor[a:b].astype(np.uint32).tobytes(), content[a:b].tobytes(), local.astype(np.uint16).tobytes(), start[a:b].tobytes(), count[a:b].astype(w.small).tobytes(), times[a:b].tobytes()))
        for a in range(0, len(rows), 512):
            yield batch_of(_DEALT, list(zip(*rows[a : a + 512], strict=True)))


_FOUND_DDL = "did long, th long, start int, count int, bin int, copies int"


def _meet(frame: pd.DataFrame, w: Windows) -> pd.DataFrame:
    """One bin: the stretches whose anchor occurs twice or more. ``copies`` is the number of occurrences of
    an equal stretch at its earliest, and 0 at the others."""
    base, did, th = 0, [], []
    doc = []
    for row in frame.itertuples():
        own = np.frombuffer(row.did, dtype=np.int64)
        did.append(own)
        th.append(np.frombuffer(row.th, dtype=np.int64))
        doc.append(np.frombuffer(row.doc, dtype=np.uint16).astype(np.int64) + base)
        base += len(own)
    join = lambda name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in frame[name]])
    doc = np.concatenate(doc)
    did, th = np.concatenate(did)[doc], np.concatenate(th)[doc]
    anchor, content, start, count, times = join("anchor", np.uint32), join("content", np.uint64), join("start", np.int32), join("count", w.small).astype(np.int32), join("times", np.int32)
    # later copies of one batch need no more than this
    copies = times.copy()
    sure = times == 0
    # most anchors occur once
    order = np.flatnonzero(~sure)
    order = order[np.argsort(anchor[order], kind="stable")]
    same = ~_parted(anchor[order])[1:] if len(order) else np.zeros(0, dtype=bool)
    keep = times[order] > 1
    keep[1:] |= same
    keep[:-1] |= same
    order = order[keep]
    order = order[np.lexsort((start[order], th[order], did[order], content[order], anchor[order]))]
    if len(order):
        one = _parted(anchor[order], content[order])
        again = ~_parted(anchor[order], content[order], did[order], th[order], start[order])  # of a document given twice
        at = np.flatnonzero(one)
        total = np.add.reduceat(times[order] - again, at)
        copies[order] = 0
        copies[order[at]] = total
        place = np.flatnonzero(~again)
        group = np.cumsum(_parted(anchor[order])) - 1
        several = np.bincount(group[place], weights=times[order][place]) > 1
        order = order[~again & several[group]]
    order = np.concatenate((np.flatnonzero(sure), order))
    return pd.DataFrame({"did": did[order], "th": th[order], "start": start[order], "count": count[order], "bin": np.int32(frame["bin"].iloc[0]), "copies": copies[order]})


_SHARD = pa.schema([("bin", pa.int32()), *((n, pa.binary()) for n in ("did", "th", "start", "count", "copies", "values", "codes"))])
_SHARD_DDL = "bin int, did binary, th binary, start binary, count binary, copies binary, values binary, codes binary"


def _extract(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    """Contents of the wanted stretches, dealt by anchor. Words travel as numbers into a list of their hashes."""
    for batch in batches:
        did, th = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        wanted = batch.column(3)
        bounds = wanted.offsets.to_numpy().astype(np.int64)
        flat = wanted.values
        start, count, bin_of, copies = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("start", "count", "bin", "copies"))
        got = []
        for c in chunks(binary(batch.column(2)), CHUNK_BYTES):
            values, starts, _ = w.units(c)
            rows = np.array(c.rows)
            sizes = bounds[rows + 1] - bounds[rows]
            own = ragged(bounds[rows], sizes)
            place = np.repeat(starts, sizes) + start[own]
            got.append((np.repeat(rows, sizes), own, values, place))
        out = []
        for rows, own, values, place in got:
            to = bin_of[own]
            order = np.argsort(to, kind="stable")
            to, rows, own, place = to[order], rows[order], own[order], place[order]
            cuts = np.append(np.flatnonzero(_parted(to)), len(to))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                mine = own[a:b]
                units = values[ragged(place[a:b], count[mine].astype(np.int64) + w.width - 1)]
                names, codes = np.unique(units, return_inverse=True) if w.words else (np.zeros(0, dtype=np.uint64), units)
                codes = codes.astype(np.uint8 if not w.words else np.int32)
                out.append((int(to[a]), did[rows[a:b]].tobytes(), th[rows[a:b]].tobytes(), start[mine].tobytes(), count[mine].tobytes(), copies[mine].tobytes(), names.tobytes(), codes.tobytes()))
        for a in range(0, len(out), 512):
            yield batch_of(_SHARD, list(zip(*out[a : a + 512], strict=True)))


@dataclass
class Shard:
    """The contents that one shard indexes: content i has ``count[i]`` windows and one unit more for each but
    the last of a window; its units are ``codes``, one content after another."""

    did: np.ndarray
    th: np.ndarray
    start: np.ndarray
    count: np.ndarray
    copies: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, frame: pd.DataFrame, words: bool) -> Shard:
        join = lambda name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in frame[name]])
        if words:
            names = join("values", np.uint64)
            parts = [np.frombuffer(x, dtype=np.int32) for x in frame["codes"]]
            sizes = np.array([len(x) // 8 for x in frame["values"]])
            base = np.repeat(np.cumsum(sizes) - sizes, [len(x) for x in parts])
            codes = np.unique(names, return_inverse=True)[1][np.concatenate(parts) + base]
        else:
            codes = join("codes", np.uint8)
        return cls(join("did", np.int64), join("th", np.int64), join("start", np.int32), join("count", np.int32), join("copies", np.int32), codes)


#: A shard's search: which of its windows, content after content, are to be cut.
Search = Callable[[Shard, int], np.ndarray]


def _runs(shard: Shard, flags: np.ndarray, width: int) -> pd.DataFrame:
    """Spans of units that the flagged windows cover, per content."""
    sizes = shard.count.astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(flags)
    if not len(at):
        return pd.DataFrame({"did": [], "th": [], "start": [], "end": []}).astype({"did": "int64", "th": "int64", "start": "int32", "end": "int32"})
    new = np.concatenate(([True], (np.diff(at) > width) | (owner[at[1:]] != owner[at[:-1]])))
    a = at[new]
    b = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    own = owner[a]
    shift = shard.start[own] - (ends - sizes)[own]
    return pd.DataFrame({"did": shard.did[own], "th": shard.th[own], "start": (a + shift).astype(np.int32), "end": (b + shift + width).astype(np.int32)})


def keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, did, th, text`` of each row: the id as it is, and as a number without null; a hash of the text; the text.
    Ids that aren't whole numbers are numbered in their order."""
    docs = documents.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    if isinstance(documents.schema[id_col].dataType, IntegralType):
        return docs.withColumn("did", F.coalesce(F.col("_id").cast("long"), F.lit(-(1 << 63)))).select("_id", "did", "th", "text")
    # sorted by ranges, numbers that grow along a partition and from one to the next are in the ids' order
    numbers = durable(docs.select("_id").distinct().orderBy(F.asc_nulls_first("_id")).select(F.col("_id").alias("_k"), F.monotonically_increasing_id().alias("did")))
    return docs.join(numbers, F.col("_id").eqNullSafe(F.col("_k"))).select("_id", "did", "th", "text")


def spans_to_cut(keyed_docs: DataFrame, w: Windows, search: Search) -> DataFrame:
    """``did, th, cuts``: the spans of units, per document, that are to be removed (an array of start, end)."""
    bins = BINS_PER_PARTITION * max(4, int(keyed_docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    common = keyed_docs.sparkSession.sparkContext.broadcast(Common(common_grams(keyed_docs, w)))
    found = durable(keyed_docs.select("did", "th", "text").mapInArrow(lambda it: _deal(it, w, bins, common.value), _DEALT_DDL).groupBy("bin").applyInPandas(lambda frame: _meet(frame, w), _FOUND_DDL))
    wanted = found.where("copies > 0").groupBy("did", "th").agg(F.collect_list(F.struct("start", "count", "bin", "copies")).alias("wanted"))
    held = keyed_docs.join(wanted, ["did", "th"]).select("did", "th", "text", "wanted")

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.of(frame, w.words)
        return _runs(shard, search(shard, w.width), w.width)

    seen = held.mapInArrow(lambda it: _extract(it, w), _SHARD_DDL).groupBy("bin").applyInPandas(look, "did long, th long, start int, end int")
    later = found.where("copies = 0").select("did", "th", "start", (F.col("start") + F.col("count") + (w.width - 1)).alias("end"))
    return later.unionByName(seen).groupBy("did", "th").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))


