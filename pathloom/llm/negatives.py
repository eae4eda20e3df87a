"""Mining of hard negatives over Hilbert-ordered blocks with zone maps.

Entries become whole numbers ``floor(256 x)``; a score is an exact inner product. Rows are ordered by label and by the Hilbert
key of a projection, and written as blocks of ``BLOCK`` vectors, each with its labels' range and every dimension's least and
greatest value. An anchor's score with any row of a block lies between

    sum over dimensions of min(a * least, a * greatest)   and   sum of max(a * least, a * greatest),

so a block is read for an anchor only where that interval meets what the anchor looks for:

* its positives, the best rows of its label: blocks of that label that may reach its fifth score in its own block;
* its negatives: blocks of other labels that may hold a score of one of its windows, a window for each positive.

Anchors go in groups of ``GROUP``, in the same order. Each group meets the zone maps in chunks, then the blocks chosen for it:
queries in blocks against all rows in blocks, joined by number, and nothing of the data's size passes the driver or one task.
From a group and a block leave an anchor's best few rows; the ends of the ranking are Spark windows. The result is exact: ties
go to the smaller id, whatever the blocks are.

Defined results: rows without id, label or vector, and those whose vector is empty, of another length than the commonest, or has
null or non-finite entries, take no part; numbers beyond 2**26 stay there. Equal rows each are candidates (and anchors), save
that a row of the anchor's own id is never its partner. An anchor without positives, or whose windows are empty, gives no rows.
Ids and labels are whole numbers. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm._text import batch_of
from pathloom.llm._vectors import narrow, products, usable, whole, width
from pathloom.llm.packing import hilbert_keys
from pathloom.plans.durable import durable

SCALE, MOST = 256, 1 << 26
BLOCK, GROUP = 1024, 256
#: Zone maps in a chunk.
ZONES = 1024
DIMS, BITS = 3, 12
POSITIVES, NEGATIVES = 5, 3
#: A window of scores, as hundredths of the positive's.
LOW, HIGH = 50, 95

_NONE = np.iinfo(np.int64).min


def _keyed(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Rows as whole numbers, with the Hilbert key of their direction in ``DIMS`` dimensions."""
    turned = np.random.default_rng(19).standard_normal((d, DIMS))
    for batch in batches:
        y = whole(batch.column(3), d, SCALE, MOST)
        size = np.maximum(np.linalg.norm(y.astype(np.float64), axis=1, keepdims=True), 1.0)
        place = 1 / (1 + np.exp(-2 * (y / size) @ turned))
        key = hilbert_keys(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)
        yield batch_of(pa.schema([*[batch.schema.field(i) for i in range(3)], ("key", pa.int64()), ("y", pa.binary())]), [*batch.columns[:3], key, [r.tobytes() for r in y.astype("<i4")]])


_BLOCK = "ids binary, labels binary, anchors binary, y binary, bytes int, first_label long, last_label long, least binary, greatest binary"
_FIELDS = [("ids", pa.binary()), ("labels", pa.binary()), ("anchors", pa.binary()), ("y", pa.binary()), ("bytes", pa.int32()), ("first_label", pa.int64()), ("last_label", pa.int64()), ("least", pa.binary()), ("greatest", pa.binary())]


def _ends(labels: np.ndarray, size: int) -> list[int]:
    """Where blocks end: after ``size`` rows, or at a label's end once an eighth of that is full."""
    out, start = [], 0
    for change in [*(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]:
        while change - start >= size:
            start += size
            out.append(start)
        if change - start >= size // 8:
            start = change
            out.append(start)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], d: int, size: int) -> Iterator[pa.RecordBatch]:
    """A task's rows, in order, as blocks."""
    ids, labels, marks, y = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros((0, d), dtype=np.int64))

    def block(a: int, b: int) -> list:
        few = narrow(y[a:b])
        return [ids[a:b].tobytes(), labels[a:b].tobytes(), marks[a:b].tobytes(), few.tobytes(), few.itemsize, int(labels[a]), int(labels[b - 1]), y[a:b].min(axis=0).tobytes(), y[a:b].max(axis=0).tobytes()]

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        ids, labels, marks = np.append(ids, new[0]), np.append(labels, new[1]), np.append(marks, new[2].astype(bool))
        y = np.concatenate((y, np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<i4").reshape(-1, d)))
        ends = [e for e in _ends(labels, size) if e < len(labels)]
        rows = [block(a, b) for a, b in zip([0, *ends], ends, strict=False)]
        if rows:
            yield batch_of(pa.schema(_FIELDS), zip(*rows, strict=True))
            ids, labels, marks, y = ids[ends[-1] :], labels[ends[-1] :], marks[ends[-1] :], y[ends[-1] :]
    ends = _ends(labels, size)
    ends = ends if not len(labels) or ends and ends[-1] == len(labels) else [*ends, len(labels)]
    rows = [block(a, b) for a, b in zip([0, *ends], ends, strict=False)]
    if rows:
        yield batch_of(pa.schema(_FIELDS), zip(*rows, strict=True))


def _longs(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.int64)


def _matrix(x: bytes, size: int, d: int) -> np.ndarray:
    return np.frombuffer(x, dtype=f"i{size}").reshape(-1, d)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` greatest scores (``_NONE``: none), ties by id, best first."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero((scores >= least[:, None]) & (scores != _NONE))
    else:
        row, col = np.nonzero(scores != _NONE)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def _grouped(batches: Iterator[pa.RecordBatch], d: int, size: int, k: int) -> Iterator[pa.RecordBatch]:
    """The anchors of a task's blocks, in groups, each with its ``k``-th positive score within its own block, or none."""
    schema = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("seeds", pa.binary()), ("y", pa.binary())])
    held: list[list] = []

    def group(rows: list[list]) -> pa.RecordBatch:
        ids, labels, seeds, y = zip(*rows, strict=True)
        return batch_of(schema, [[np.array(x, dtype=np.int64).tobytes()] for x in (ids, labels, seeds)] + [[np.stack(y).astype(np.int64).tobytes()]])

    for batch in batches:
        for ids, labels, marks, y, itemsize in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            ids, labels, at, y = _longs(ids), _longs(labels), np.flatnonzero(np.frombuffer(marks, dtype=bool)), _matrix(y, itemsize, d)
            own = np.where((labels[at][:, None] == labels) & (ids[at][:, None] != ids), products(y[at], y), _NONE)
            row, col = _best(own, ids, k)
            seeds = np.full(len(at), _NONE)
            last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
            seeds[row[last]] = own[row[last], col[last]]
            held += [[ids[i], labels[i], seeds[j], y[i]] for j, i in enumerate(at)]
            while len(held) >= size:
                yield group(held[:size])
                held = held[size:]
    if held:
        yield group(held)


_GROUP = ["group", "ids", "labels", "seeds", "y"]


class _Anchors:
    """A group's row: what its anchors are and what they look for."""

    def __init__(self, d: int, ids: bytes, labels: bytes, seeds: bytes, y: bytes, windows: list | None):
        self.ids, self.labels, self.seeds, self.y = _longs(ids), _longs(labels), _longs(seeds), _longs(y).reshape(-1, d)
        self.windows = None
        if windows is not None:  # lo and hi of each anchor and positive; empty ones are the wrong way round
            self.windows = np.tile(np.array([1, 0], dtype=np.int64), (len(self.ids), max((w["positive"] for w in windows), default=0), 1))
            for w in windows:
                self.windows[w["anchor"], w["positive"] - 1] = w["lo"], w["hi"]

    def reads(self, first: np.ndarray, last: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
        """Which anchors must read which blocks, by interval arithmetic on the zone maps."""
        above, below = np.maximum(self.y, 0), np.minimum(self.y, 0)
        top = products(above, greatest) + products(below, least)
        if self.windows is None:
            return (first <= self.labels[:, None]) & (self.labels[:, None] <= last) & (top >= self.seeds[:, None])
        bottom = products(above, least) + products(below, greatest)
        out = np.zeros(top.shape, dtype=bool)
        for i in range(self.windows.shape[1]):
            lo, hi = self.windows[:, i, 0][:, None], self.windows[:, i, 1][:, None]
            out |= (lo <= hi) & (top >= lo) & (bottom <= hi)
        return out & ~((first == last) & (first == self.labels[:, None]))

    def found(self, which: np.ndarray, ids: np.ndarray, labels: np.ndarray, y: np.ndarray, k: int) -> Iterator[tuple]:
        """The best of a block's rows for some anchors: anchor, positive, id, score."""
        scores = products(self.y[which], y)
        same = self.labels[which][:, None] == labels
        if self.windows is None:
            looked = [(0, np.where(same & (self.ids[which][:, None] != ids), scores, _NONE))]
        else:
            bounds = self.windows[which]
            looked = [(i + 1, np.where(~same & (scores >= bounds[:, i, 0][:, None]) & (scores <= bounds[:, i, 1][:, None]), scores, _NONE)) for i in range(bounds.shape[1])]
        for i, part in looked:
            row, col = _best(part, ids, k)
            yield which[row], np.full(len(row), i), ids[col], part[row, col]


def _chosen(batches: Iterator[pa.RecordBatch], d: int, has_windows: bool) -> Iterator[pa.RecordBatch]:
    """For a group and a chunk of zone maps: the blocks to read, and by which anchors."""
    schema = pa.schema([("group", pa.int64()), ("block", pa.int64()), ("who", pa.binary())])
    for batch in batches:
        for row in range(batch.num_rows):
            g, ids, labels, seeds, y, zones, *windows = (c[row].as_py() for c in batch.columns)
            anchors = _Anchors(d, ids, labels, seeds, y, windows[0] if has_windows else None)
            first, last = (np.array([z[f] for z in zones], dtype=np.int64) for f in ("first_label", "last_label"))
            least, greatest = (_longs(b"".join(z[f] for z in zones)).reshape(-1, d) for f in ("least", "greatest"))
            reads = anchors.reads(first, last, least, greatest)
            at = np.flatnonzero(reads.any(axis=0)).tolist()
            yield batch_of(schema, [[g] * len(at), [zones[i]["block"] for i in at], [np.packbits(reads[:, i]).tobytes() for i in at]])


def _scored(batches: Iterator[pa.RecordBatch], d: int, has_windows: bool, k: int) -> Iterator[pa.RecordBatch]:
    """For a group and a block that it reads: each anchor's best rows."""
    schema = pa.schema([("group", pa.int64()), ("anchor", pa.int32()), ("anchor_id", pa.int64()), ("positive", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
    for batch in batches:
        for row in range(batch.num_rows):
            g, ids, labels, seeds, y, who, b_ids, b_labels, b_y, size, *windows = (c[row].as_py() for c in batch.columns)
            anchors = _Anchors(d, ids, labels, seeds, y, windows[0] if has_windows else None)
            which = np.flatnonzero(np.unpackbits(np.frombuffer(who, dtype=np.uint8))[: len(anchors.ids)])
            for anchor, positive, found, score in anchors.found(which, _longs(b_ids), _longs(b_labels), _matrix(b_y, size, d), k):
                yield batch_of(schema, [np.full(len(anchor), g), anchor.astype(np.int32), anchors.ids[anchor], positive.astype(np.int32), found, score])


class Blocks:
    """Candidates in blocks, with their zone maps in numbered chunks and their anchors in groups."""

    def __init__(self, rows: DataFrame, anchors: Column, id_col: str, vec_col: str, label_col: str, block: int = BLOCK, group: int = GROUP, positives: int = POSITIVES):
        held = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"), F.coalesce(anchors, F.lit(False)).alias("_anchor"), F.col(vec_col).cast("array<double>").alias("_v"))
        held = held.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & usable(F.col("_v")))
        self.d = d = width(held, "_v")
        keyed = held.where(F.size("_v") == d).mapInArrow(lambda it: _keyed(it, d), "_id long, _label long, _anchor boolean, key long, y binary")
        ordered = keyed.repartitionByRange("_label", "key", "_id").sortWithinPartitions("_label", "key", "_id", "y")
        self.blocks = durable(ordered.mapInArrow(lambda it: _blocks(it, d, block), _BLOCK).withColumn("block", F.monotonically_increasing_id()))
        grouped = self.blocks.select("ids", "labels", "anchors", "y", "bytes").mapInArrow(lambda it: _grouped(it, d, group, positives), "ids binary, labels binary, seeds binary, y binary")
        self.groups = durable(grouped.withColumn("group", F.monotonically_increasing_id()).select(*_GROUP))
        self.chunks = max(1, -(-self.blocks.count() // ZONES))
        zones = self.blocks.select("block", "first_label", "last_label", "least", "greatest").withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(self.chunks)).cast("int"))
        self.zones = zones.groupBy("chunk").agg(F.collect_list(F.struct("block", "first_label", "last_label", "least", "greatest")).alias("zones"))

    def reads(self, windows: DataFrame | None = None) -> DataFrame:
        """``group, block, who``: the blocks that anchors of a group must read, and a bit for each anchor that must."""
        groups, d, more = (self.groups, self.d, []) if windows is None else (self.groups.join(windows, "group"), self.d, ["windows"])
        met = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1)))).join(self.zones, "chunk")
        return met.select(*_GROUP, "zones", *more).mapInArrow(lambda it: _chosen(it, d, bool(more)), "group long, block long, who binary")

    def best(self, reads: DataFrame, k: int, windows: DataFrame | None = None) -> DataFrame:
        """Each anchor's first ``k`` rows, for each of its windows: ``group, anchor, anchor_id, positive, id, score, rank``."""
        groups, d, more = (self.groups, self.d, []) if windows is None else (self.groups.join(windows, "group"), self.d, ["windows"])
        blocks = self.blocks.select("block", F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("y").alias("b_y"), "bytes")
        met = reads.join(groups, "group").join(blocks, "block").select(*_GROUP, "who", "b_ids", "b_labels", "b_y", "bytes", *more)
        found = met.mapInArrow(lambda it: _scored(it, d, bool(more), k), "group long, anchor int, anchor_id long, positive int, id long, score long")
        order = Window.partitionBy("group", "anchor", "positive").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Per anchor, positive and rank: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    held = Blocks(rows, anchors, id_col, vec_col, label_col, block, group)
    share = lambda part, up: F.expr(f"score div 100 * {part} + (score % 100 * {part} + {up}) div 100")  # noqa: E731  whole numbers, of scores from zero up
    positives = durable(held.best(held.reads(), POSITIVES).select("group", "anchor", "anchor_id", F.col("rank").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), share(LOW, 99).alias("lo"), share(HIGH, 0).alias("hi")))
    windows = durable(positives.where("positive_score >= 0 and lo <= hi").groupBy("group").agg(F.collect_list(F.struct("anchor", "positive", "lo", "hi")).alias("windows")))
    negatives = held.best(held.reads(windows), NEGATIVES, windows).select("group", "anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["group", "anchor", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
