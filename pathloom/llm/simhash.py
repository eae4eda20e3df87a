"""SimHash near-dedup through a byte-position inverted index with count filtering.

A document's fingerprint has a bit where over half of its shingles' hashes have it. Fingerprints are posted under
sets of three positional bytes. Within a posting, shared positional bytes are tallied: a list with many members is
split by each further position's byte, so that only those meet which reach the minimum; pairs that reach it are
verified. A list's links leave it as stars, so that a dense list's output is linear; stars are united to components.

:func:`components` links 64-bit fingerprints that differ in ``bits`` at most. Such a pair shares ``8 - bits`` of its 8
positional bytes at least, and the 20 sets are chosen so that four shared bytes hold one of them: no link is lost.

:func:`similar_components` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. The
candidates come from wide fingerprints (128 bits over pairs of words) posted under ``PATTERNS``' 64 sets of three of
their 16 bytes; a pair's true similarity decides. Bytes can all differ by chance, so a share of the pairs near 0.8 is
missed (the README gives the measured one).

Defined results: null and wordless texts have fingerprint zero and link like any other; equal rows share
a component; a null id keeps its row and has component null unless a group holds an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._text import BLANK_WORDS, U, Words, batch_of, binary, chunks, mix, word_span_hash
from pathloom.operators.components import connected_components
from pathloom.plans.durable import durable
from pathloom.plans.skew import salted_join, spread_join

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
#: The rule of :func:`similar_components`: the similarity of sets of so many words' shingles.
SIMILARITY = 0.8
SIMILAR_WORDS = 5
#: Its candidates: bits that wide fingerprints of words' pairs may differ in, and steps to a set's other two bytes.
WIDE_WORDS, WIDE_LANES, WIDE_BITS = 2, 2, 32
PATTERNS = ((1, 3), (2, 7), (4, 10), (1, 5))
#: One of so many fingerprints tells which postings are dense: those with so many of it, the densest first.
SAMPLE, DENSE, MAX_DENSE = 64, 1000, 10_000

_LIST = 3  # members of a list whose pairs are all wanted, where pairs are
_SPLIT = 64  # members of a list that is not yet split by a further byte
_TABLE = 2048  # the same, where only links are wanted
_PER_SALT = 256


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned."""
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = len(w) - words + 1
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    h = np.fromiter((digest(view[a:b], seed) for a, b in zip(starts[:n].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)), dtype=np.uint64, count=n)
    return int(_majority(h.reshape(-1, 1))[0])


def _majority(h: np.ndarray) -> np.ndarray:
    """The bits, lane by lane, that over half of the rows have."""
    ones = np.zeros(64 * h.shape[1], dtype=np.int64)
    for a in range(0, len(h), 4096):
        ones += np.unpackbits(np.ascontiguousarray(h[a : a + 4096]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(id, fp)``: fp holds the 64 bits as a signed long."""
    kind = documents.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words, seed) for t in binary(batch.column(1))], dtype=np.uint64)
            yield batch_of(pa.schema([batch.schema.field(0), ("fp", pa.int64())]), [batch.column(0), fp.view(np.int64)])

    return documents.select(id_col, text_col).mapInArrow(task, f"`{id_col}` {kind}, fp long")


def posting_sets(shared: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any ``shared`` of the 8 positions contain one of them.

    Positions are split into groups; three of ``shared = 4`` positions lie in the union of two groups in
    cyclic order, so sets of three from there suffice. Other values take all sets of ``shared`` positions.
    """
    if shared != 4:
        return list(combinations(range(8), min(3, max(1, shared))))
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    return [s for s in combinations(range(8), 3) if len({group[x] for x in s}) == 1 or sorted(map(group.__getitem__, s)) in ([0, 0, 1], [1, 1, 2], [0, 2, 2])]


def wide_sets(patterns: tuple[tuple[int, int], ...] = PATTERNS, size: int = 8 * WIDE_LANES) -> list[tuple[int, ...]]:
    """For each position, the sets of it and the two positions that a pattern's steps lead to, in a ring."""
    return [(i, (i + a) % size, (i + b) % size) for a, b in patterns for i in range(size)]


def _lanes(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of 64-bit numbers."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, 1)
    held = b"".join(column.to_pylist())
    return np.frombuffer(held, dtype="<u8").reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype=np.uint64)


def _column(fp: np.ndarray, kind: pa.DataType) -> pa.Array:
    if pa.types.is_integer(kind):
        return pa.array(np.ascontiguousarray(fp[:, 0]).view(np.int64))
    return pa.array([x.tobytes() for x in fp], type=pa.binary())


def _keys(fp: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """Per fingerprint and set: the set's number and its bytes."""
    b = np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1).astype(np.int64)
    out = np.empty((len(fp), len(sets)), dtype=np.int64)
    for n, s in enumerate(sets):
        out[:, n] = n
        for p in s:
            out[:, n] = out[:, n] << 8 | b[:, p]
    return out


def _post(batches: Iterator[pa.RecordBatch], sets: list[tuple[int, ...]], dense: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(key, sub, fp)``. A dense posting is dealt by each further position's byte, which is ``sub``; else that is -1."""
    for batch in batches:
        every = _lanes(batch.column(0))
        for a in range(0, len(every), 1024):
            fp = every[a : a + 1024]
            key = _keys(fp, sets).ravel()
            of = np.repeat(np.arange(len(fp)), len(sets))
            sub = np.full(len(key), -1, dtype=np.int32)
            if len(dense):
                hot = np.flatnonzero(np.isin(key, dense))
                b = np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1)
                parts = [(key[i], p << 8 | int(b[of[i], p]), of[i]) for i in hot for p in range(b.shape[1]) if p not in sets[i % len(sets)]]
                cold = np.setdiff1d(np.arange(len(key)), hot)
                k, s, o = (np.array(x, dtype=np.int64) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64),) * 3
                key, sub, of = np.concatenate((key[cold], k)), np.concatenate((sub[cold], s.astype(np.int32))), np.concatenate((of[cold], o))
            schema = pa.schema([("key", pa.int64()), ("sub", pa.int32()), ("fp", batch.schema.field(0).type)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sub), _column(fp, schema.field(2).type).take(pa.array(of))], schema=schema)


def _ones(d: np.ndarray) -> np.ndarray:
    n = np.bitwise_count(d)
    return n[..., 0] if n.shape[-1] == 1 else n.sum(axis=-1)


class Tally:
    """Pairs that share ``shared`` positional bytes at least and differ in ``bits`` at most; ``counted`` and ``verified``
    tell how many pairs came to each test."""

    def __init__(self, shared: int, bits: int):
        self.shared, self.bits = shared, bits
        self.counted = self.verified = 0

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = np.bitwise_xor(x, y)
        if not self.shared:  # reached by the list's members as they are
            return _ones(d) <= self.bits
        tally = (np.ascontiguousarray(d).view(np.uint8) == 0).sum(axis=-1)
        ok = tally >= self.shared
        self.counted += ok.size
        at = np.nonzero(ok)
        self.verified += len(at[0])
        ok[at] = _ones(d[at]) <= self.bits
        return ok


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _ones(np.bitwise_xor(x, y))


_Pairs = list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # first, second, salt: below zero where all pairs of a list were looked at


def _few(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, close: Tally, most: int) -> _Pairs:
    """Pairs of all lists of ``most`` members or fewer, by their distance within the list."""
    out = []
    until = np.repeat(np.where(sizes <= most, starts + sizes, 0), sizes)
    at = np.arange(len(fp))
    for d in range(1, most):
        at = at[at + d < until[at]]
        if not len(at):
            break
        for a in range(0, len(at), 1 << 18):
            i = at[a : a + (1 << 18)]
            i = i[close(fp[i], fp[i + d])]
            out.append((i, i + d, np.full(len(i), -1)))
    return out


def _table(fp: np.ndarray, close: Tally) -> _Pairs:
    """Stars of the links of a list of moderate size: each member with the least that it reaches within the list."""
    label = np.arange(len(fp))
    i, j = np.nonzero(np.concatenate([close(fp[a : a + 512, None], fp[None]) for a in range(0, len(fp), 512)]))
    i, j = i[i > j], j[i > j]
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            i = np.flatnonzero(label != np.arange(len(fp)))
            return [(label[i], i, np.full(len(i), -1))]


def _stars(fp: np.ndarray, close: Tally, whole: bool) -> _Pairs:
    """Pairs of a long list. Those near a *hub* are paired with it alone; what is farther is paired with each that it is
    close to, or with one of them unless ``whole``. Then the rest has its own hub. Two members that are in no pair are
    not close, or are near one hub."""
    out, todo, dense = [], np.arange(len(fp)), True
    while len(todo) > 1:
        mine = fp[todo]
        hub = int(np.argmin(_distance(mine, _majority(mine)[None]))) if dense else 0
        far = _distance(mine, mine[hub])
        ball = close(mine, mine[hub : hub + 1])
        ball[hub] = True
        inside, rest = todo[ball], todo[~ball]
        dense = len(inside) > 32
        own = inside[inside != todo[hub]]
        out.append((np.full(len(own), todo[hub]), own, np.arange(len(own)) // _PER_SALT))
        # by the triangle inequality, what is farther from the hub than twice the bits is close to none inside
        reach = todo[~ball & (far <= 2 * close.bits)]
        for a in range(0, len(reach), 64):
            z = reach[a : a + 64]
            near = np.concatenate([close(fp[z, None], fp[None, inside[b : b + 8192]]) for b in range(0, len(inside), 8192)], axis=1)
            if whole:
                i, j = np.nonzero(near)
            else:
                i = np.flatnonzero(near.any(axis=1))
                j = near[i].argmax(axis=1)
            out.append((inside[j], z[i], np.full(len(i), -1)))
        todo = rest
    return out


def _list_pairs(fp: np.ndarray, key: np.ndarray, sub: np.ndarray, free: list[tuple[int, ...]], close: Tally, whole: bool) -> _Pairs:
    """The pairs needed of all lists, which are in order of ``key, sub``. ``free`` gives for a list's set the other positions."""
    if not len(fp):
        return []
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]))))
    sizes = np.diff(np.append(starts, len(fp)))
    few = _LIST if whole else 8
    out = _few(fp, starts, sizes, close, few)
    for s, n in zip(starts[sizes > few], sizes[sizes > few], strict=True):
        mine = fp[s : s + n]
        if n > _SPLIT and free and sub[s] < 0:
            # close pairs share a further byte: lists by position and byte, in which that minimum is reached
            b, reached = np.ascontiguousarray(mine).view(np.uint8).reshape(n, -1), Tally(0 if close.shared == 4 else close.shared, close.bits)
            got = []
            for p in free[int(key[s] >> 24)]:
                order = np.argsort(b[:, p], kind="stable")
                cuts = np.append(np.flatnonzero(np.concatenate(([True], np.diff(b[order, p]) != 0))), n)
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    got += [(order[x:y][i], order[x:y][j], t) for i, j, t in _list_links(mine[order[x:y]], reached, whole)]
        else:
            got = _list_links(mine, close, whole)
        out += [(i + s, j + s, t) for i, j, t in got]
    return out


def _list_links(fp: np.ndarray, close: Tally, whole: bool) -> _Pairs:
    if len(fp) < 2:
        return []
    return _table(fp, close) if not whole and len(fp) <= _TABLE else _stars(fp, close, whole)


def _met(batches: Iterator[pa.RecordBatch], sets: list[tuple[int, ...]], size: int, shared: int, bits: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Pairs ``(a, b, salt)`` of one partition's postings, which come in order; a posting is held until its end."""
    close = Tally(shared, bits)
    free = [tuple(p for p in range(size) if p not in s) for s in sets] if shared > len(sets[0]) else []
    held: list[pa.RecordBatch] = []
    kind = None

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        key, sub = (rows.column(i).to_numpy() for i in (0, 1))
        fp = _lanes(rows.column(2).combine_chunks())
        got = _list_pairs(fp, key, sub, free, close, whole)
        i, j, t = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, dtype=np.int64),) * 3
        some = (fp[i] != fp[j]).any(axis=1)
        i, j, t = i[some], j[some], t[some]
        schema = pa.schema([("a", kind), ("b", kind), ("salt", pa.int32())])
        return pa.RecordBatch.from_arrays([_column(fp[i], kind), _column(fp[j], kind), pa.array(t, type=pa.int32())], schema=schema)

    for batch in batches:
        kind = batch.schema.field(2).type
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        sub = batch.column(1).to_numpy()
        last = int(np.flatnonzero((key == key[-1]) & (sub == sub[-1]))[0])  # where the posting that may go on begins
        if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) == (int(key[-1]), int(sub[-1])):
            held.append(batch)
            continue
        yield pairs(pa.Table.from_batches([*held, batch.slice(0, last)]))
        held = [batch.slice(last)]
    if held:
        yield pairs(pa.Table.from_batches(held))


def _pairs(distinct: DataFrame, sets: list[tuple[int, ...]], size: int, shared: int, bits: int, whole: bool) -> DataFrame:
    """Pairs ``(a, b, salt)`` of the fingerprints ``(fp)``."""
    kind = distinct.schema["fp"].dataType.simpleString()
    n = max(8, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dense = _dense_postings(distinct, sets) if shared > len(sets[0]) else np.zeros(0, dtype=np.int64)
    posted = distinct.select("fp").mapInArrow(lambda it: _post(it, sets, dense), f"key long, sub int, fp {kind}")
    return posted.repartition(n, "key", "sub").sortWithinPartitions("key", "sub").mapInArrow(lambda it: _met(it, sets, size, shared, bits, whole), f"a {kind}, b {kind}, salt int")


def _dense_postings(distinct: DataFrame, sets: list[tuple[int, ...]]) -> np.ndarray:
    """Keys that very many fingerprints share, as a sample tells; they decide on the dealing alone. ``MAX_DENSE`` at most."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_keys(_lanes(batch.column(0)), sets).ravel())], names=["key"])

    sample = distinct.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(SAMPLE)) == 0).select("fp")
    rows = sample.mapInArrow(keys, "key long").groupBy("key").count().where(F.col("count") >= DENSE).orderBy(F.desc("count"), "key").limit(MAX_DENSE).collect()
    return np.array(sorted(r["key"] for r in rows), dtype=np.int64)


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``(fp)`` that connect all those linked by at most ``bits`` differing bits."""
    shared = 8 - bits
    if shared < 1:
        raise ValueError("the index needs at least one byte that both sides share")
    return _pairs(distinct, posting_sets(shared), 8, shared, bits, False).select("a", "b")


def components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS, words: int = SHINGLE_WORDS) -> DataFrame:
    """Per document: ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable)."""
    marked = durable(fingerprints(documents, id_col, text_col, words).withColumnRenamed(id_col, "_id"))
    distinct = durable(marked.groupBy("fp").agg(F.min("_id").alias("least")))
    edges = durable(links(distinct.select("fp"), bits).distinct())
    label = connected_components(edges)
    own = distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    least = own.groupBy("c").agg(F.min("least").alias("component_id"))
    grouped = salted_join(own, least, ["c"]).select("fp", "component_id")
    return salted_join(marked, grouped, ["fp"], salts=8).select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wide fingerprints: each pair of words (a lone word for itself) gives two hashes of 64 bits."""
    for batch in batches:
        rows, out = [], []
        for c in chunks(binary(batch.column(2))):
            w = Words(c, BLANK_WORDS, lower=True)
            h = word_span_hash(w.hashes())
            for i, row in enumerate(c.rows):
                a, b = int(w.first[i]), int(w.first[i + 1])
                at = np.arange(a, max(a, b - WIDE_WORDS + 1) or a)
                if b - a == 1:
                    at = np.array([a])
                one = h(at, np.minimum(at + WIDE_WORDS, b))
                lanes = np.stack([one if k == 0 else mix(one ^ U(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) for k in range(WIDE_LANES)], axis=1)
                rows.append(row)
                out.append(_majority(lanes).tobytes())
        schema = pa.schema([batch.schema.field(0), batch.schema.field(1), ("fp", pa.binary())])
        at = pa.array(rows, type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, type=pa.binary())], schema=schema)


def _shingle_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """``(th, shingles)``: the sorted distinct hashes of a text's shingles."""
    for batch in batches:
        rows, out = [], []
        for c in chunks(binary(batch.column(1))):
            w = Words(c, BLANK_WORDS, lower=True)
            h = word_span_hash(w.hashes())
            for i, row in enumerate(c.rows):
                a, b = int(w.first[i]), int(w.first[i + 1])
                at = np.arange(a, max(a + 1, b - words + 1)) if b > a else np.zeros(0, dtype=np.int64)
                rows.append(row)
                out.append(np.unique(h(at, np.minimum(at + words, b))).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, type=pa.int64())), pa.array(out, type=pa.binary())], names=["th", "shingles"])


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    k = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[k] == y).sum())
    return both / (len(x) + len(y) - both)


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (batch.column(i).to_pylist() for i in (3, 4))
        j = [jaccard(np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([v >= similarity - 1e-12 for v in j], type=pa.bool_())], names=["a", "b", "star", "similar"])


def _tested(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, star, similar)`` of pairs of texts ``(a, b, star, salt)``. A hub's set is given once for each of its salts."""
    a = sets.select(F.col("th").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("th").alias("b"), F.col("shingles").alias("y"))
    hubs = pairs.select("a", "salt").distinct().join(a, "a")
    return pairs.join(b, "b").join(hubs, ["a", "salt"]).select("a", "b", "star", "x", "y").mapInArrow(lambda it: _similar(it, similarity), "a binary, b binary, star boolean, similar boolean")


#: Bytes of shingle sets and texts in a block; a larger group of candidates is compared block with block. Each pair of blocks is
#: dealt by itself. Short texts' sets have few bytes, so without the second bound the numbers of pairs would be without one.
BLOCK_BYTES, BLOCK_TEXTS = 2 << 20, 1024


def _looked_over(pairs: DataFrame, lone: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of the texts ``lone(th)`` with any text of their group of candidates: enough of them to connect
    all that are so similar."""
    groups = durable(connected_components(pairs.select("a", "b")))
    mine = lone.withColumn("lone", F.lit(True))
    marked = groups.join(mine, groups["node"] == mine["th"], "left").select("node", "component", F.coalesce("lone", F.lit(False)).alias("lone"))
    held = durable(marked.join(marked.where("lone").select("component").distinct(), "component", "left_semi").join(sets, F.col("node") == F.col("th")).select("component", "th", "shingles", "lone"))
    parts = lambda some: F.ceil(F.greatest(F.lit(1), F.sum(F.when(some, F.length("shingles"))) / BLOCK_BYTES, F.count_if(some) / BLOCK_TEXTS)).cast("int")
    blocks = held.groupBy("component").agg(parts(F.col("lone")).alias("asking"), parts(F.lit(True)).alias("telling"))
    dealt = spread_join(held, blocks, ["component"])
    at = lambda n: F.pmod(F.xxhash64("th"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = dealt.where("lone").select("component", at(F.col("asking")).alias("i"), every("telling").alias("j"), "th", "shingles", F.lit(True).alias("asks"))
    told = dealt.select("component", every("asking").alias("i"), at(F.col("telling")).alias("j"), "th", "shingles", F.lit(False).alias("asks"))
    # dealt by all three: grouping alone would do with rows that lie together by component
    met = asked.unionByName(told).repartition("component", "i", "j")
    return durable(met.groupBy("component", "i", "j").applyInPandas(lambda f: _block_links(f, similarity), "a binary, b binary"))


def _block_links(frame: pd.DataFrame, similarity: float, columns: int = 4096) -> pd.DataFrame:
    """Stars of the links between those that ask and all others of two blocks, by the number of shingles that they share."""
    frame = frame.sort_values(["asks", "th"], ascending=[False, True])
    asks = frame["asks"].to_numpy()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in frame["shingles"]]
    sizes = np.array([len(x) for x in sets])
    code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(len(sets)), sizes)
    several = times[code] > 1
    row, code = row[several], np.unique(code[several], return_inverse=True)[1]
    n = int(asks.sum())
    both = np.zeros((n, len(sets) - n), dtype=np.float32)
    for a in range(0, int(code.max()) + 1 if len(code) else 0, columns):
        some = (code >= a) & (code < a + columns)
        held = np.zeros((len(sets), columns), dtype=np.float32)
        held[row[some], code[some] - a] = 1
        both += held[:n] @ held[n:].T
    every = sizes[:n, None] + sizes[None, n:] - both
    i, j = np.nonzero((every == 0) | (both >= similarity * every - 1e-6))
    # one node for a text that stands on both sides
    names, node = np.unique(np.array([bytes(x) for x in frame["th"]], dtype=object), return_inverse=True)
    label, x, y = np.arange(len(names)), node[i], node[n + j]
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            break
    own = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"a": names[label[own]], "b": names[own]})


def similar_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = SIMILAR_WORDS) -> DataFrame:
    """Per document: ``component_id``, the smallest id that is reachable by links of texts whose shingles are so similar."""
    kind = documents.schema[id_col].dataType.simpleString()
    th = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    texts = documents.select(F.col(id_col).alias("_id"), th.alias("th"), F.col(text_col).alias("_text"))
    marked = durable(texts.mapInArrow(_wide, f"_id {kind}, th binary, fp binary"))
    distinct = durable(marked.groupBy("th", "fp").agg(F.min("_id").alias("least"), F.count("*").alias("n")))
    # one text stands for a fingerprint; others of the same are held against it
    shown = durable(distinct.groupBy("fp").agg(F.min("th").alias("th"), F.count("*").alias("texts")))
    met = _pairs(shown, wide_sets(), 8 * WIDE_LANES, 3, WIDE_BITS, True)
    met = met.groupBy("a", "b").agg(F.max(F.col("salt") >= 0).alias("star"), F.min(F.greatest("salt", F.lit(0))).alias("salt"))
    x, y = (shown.select(F.col("fp").alias(k), F.col("th").alias(f"t{k}")) for k in ("a", "b"))
    met = met.join(y, "b").join(x, "a").select(F.col("ta").alias("a"), F.col("tb").alias("b"), "star", "salt")
    same = distinct.select("th", "fp").join(shown.where("texts > 1").select("fp", F.col("th").alias("a")), "fp").where("a <> th").select("a", F.col("th").alias("b"), F.lit(True).alias("star"), F.pmod(F.xxhash64("th"), F.lit(64)).cast("int").alias("salt"))
    pairs = durable(met.unionByName(same))
    ends = pairs.select(F.col("a").alias("th")).union(pairs.select(F.col("b").alias("th"))).distinct()
    # rows are found by their id, which deals them evenly; one row gives a text's set
    one = distinct.join(ends, "th").select(F.col("th").alias("_th"), "least")
    held = texts.join(one, texts["_id"].eqNullSafe(one["least"])).where("th = _th").select("th", "_text")
    sets = durable(held.mapInArrow(lambda it: _shingle_sets(it, words), "th binary, shingles binary").groupBy("th").agg(F.first("shingles").alias("shingles")))
    got = durable(_tested(pairs, sets, similarity))
    edges = got.where("similar").select("a", "b")
    # who was paired with a hub alone and is not like it is held against all that it could be like
    lone = durable(got.where("star and not similar").select(F.col("b").alias("th")).distinct())
    if not lone.isEmpty():
        edges = edges.unionByName(_looked_over(pairs, lone, sets, similarity))
    label = durable(connected_components(edges))
    named = durable(distinct.join(label, distinct["th"] == label["node"], "left").select("th", "least", F.coalesce("component", "th").alias("c")))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    # nearly as many groups as texts
    grouped = spread_join(named, least, ["c"]).select("th", "component_id")
    return salted_join(marked, grouped, ["th"], salts=8).select(F.col("_id").alias(id_col), "component_id")


def _firsts(documents: DataFrame, label: DataFrame, id_col: str) -> DataFrame:
    firsts = label.where(f"`{id_col}` = component_id").select(F.col(id_col).alias("_kept")).distinct()
    nothing = firsts.sparkSession.range(1).select(F.lit(None).cast(firsts.schema[0].dataType).alias("_kept"))
    kept = firsts.union(nothing)
    return documents.join(kept, documents[id_col].eqNullSafe(kept["_kept"]), "left_semi")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS, words: int = SHINGLE_WORDS) -> DataFrame:
    """``documents`` with one document of each group of :func:`components`: that of the smallest id. Rows without an id all stay."""
    return _firsts(documents, components(documents, id_col, text_col, bits, words), id_col)


def keep_one_similar(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = SIMILAR_WORDS) -> DataFrame:
    """``documents`` with one document of each group of :func:`similar_components`: that of the smallest id. Rows without an id all stay."""
    return _firsts(documents, similar_components(documents, id_col, text_col, similarity, words), id_col)
