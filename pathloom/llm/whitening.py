"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become the whole numbers ``y = floor(64 c)`` (a constant added to them changes nothing below); sums, squares and deviations are exact. The covariance is never
formed: a pass multiplies the centred vectors with a block Q, ``Xᵀ(XQ) / n``, within tasks, and Spark adds the tasks'
products cell by cell. A round runs the block through a Chebyshev polynomial, one pass a degree, that damps the interval of
the unwanted spectrum and so lifts the wanted part; then QR and Rayleigh-Ritz. Beside the block each pass carries a probe,
a random vector outside the wanted subspace, whose Lanczos steps give the interval's ends. Rounds end when the result is
certified: residuals of the wanted pairs within ``TOLERANCE`` of the largest eigenvalue, and no probe found a larger
eigenvalue outside; a final pass over all vectors measures the whitened covariance.

For the passes the vectors are written once as packed blocks of small integers. Through the driver go only sums of d
numbers, and blocks of d times ``COMPONENTS + GUARD``.

Defined results: rows whose vector is null, empty, or has null or non-finite entries go, and so do those of another length than
the commonest; numbers beyond 2**31 stay there; equal rows have equal results and null ids stay null. Directions without
spread have no whitened value: there are as many components as eigenvalues above ``FLAT`` of the trace, none for one vector
or none. A deviation beyond 64 bits is null. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._text import batch_of
from pathloom.llm._vectors import narrow, usable, whole, width
from pathloom.plans.durable import durable

SCALE, MOST = 64, 1 << 31
COMPONENTS = 32
#: Columns of the block beside the wanted ones; the polynomial's degree; most rounds; what certifies; what counts as flat.
GUARD, DEGREE, ROUNDS = 24, 10, 60
TOLERANCE, FLAT = 2e-14, 1e-13
#: Vectors in a packed block.
BLOCK = 8192


def _packed(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole-number vectors with their exact sums; squares leave as decimal text, as they may be long."""
    schema = pa.schema([("n", pa.int64()), ("bytes", pa.int32()), ("y", pa.binary()), ("sums", pa.list_(pa.int64())), ("squares", pa.string())])
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            y = whole(batch.column(0).slice(a, BLOCK), d, SCALE, MOST)
            few = narrow(y)
            squares = int((y * y).sum()) if few.itemsize <= 2 else sum(int(v) ** 2 for v in y.ravel().tolist())
            yield batch_of(schema, [[len(y)], [few.itemsize], [few.tobytes()], [y.sum(axis=0).tolist()], [str(squares)]])


def _unpacked(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    for size, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        yield np.frombuffer(y, dtype=f"i{size}").reshape(-1, d).astype(np.int64)


def _product(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, q: Broadcast) -> Iterator[pa.RecordBatch]:
    """A task's part of Xᵀ X Q / n, as cells."""
    block = q.value
    total = np.zeros(block.shape)
    for batch in batches:
        for y in _unpacked(batch, len(sums)):
            x = (n * y - sums).astype(np.float64) / n
            total += x.T @ (x @ block)
    if total.any():
        yield batch_of(pa.schema([("cell", pa.int32()), ("v", pa.float64())]), [np.arange(total.size, dtype=np.int32), total.ravel() / n])


class Spread:
    """The covariance of a table of vectors, as an operator."""

    def __init__(self, vectors: DataFrame, vec_col: str):
        self.spark = vectors.sparkSession
        self.d = d = width(vectors, vec_col)
        blocks = vectors.where(F.size(vec_col) == d).select(F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(lambda it: _packed(it, d), "n long, bytes int, y binary, sums array<long>, squares string")
        self.blocks = durable(blocks)
        head = self.blocks.agg(F.sum("n").alias("n"), F.sum(F.col("squares").cast("decimal(38,0)")).alias("s")).first()
        self.n, squares = head["n"] or 0, int(head["s"] or 0)
        cells = self.blocks.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
        self.sums = [int(r["s"]) for r in sorted(cells, key=lambda r: r["i"])] if self.n else []
        #: exact, then rounded once
        self.trace = (self.n * squares - sum(s * s for s in self.sums)) / (self.n * self.n) if self.n else 0.0
        self.passes = 0

    def apply(self, q: np.ndarray) -> np.ndarray:
        """The covariance times a block, by one pass over all vectors."""
        self.passes += 1
        n, sums, given = self.n, np.array(self.sums, dtype=np.int64), self.spark.sparkContext.broadcast(q)
        cells = self.blocks.select("bytes", "y").mapInArrow(lambda it: _product(it, n, sums, given), "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(q.size)
        out[cells["cell"].to_numpy()] = cells["v"].to_numpy()
        given.destroy()
        return out.reshape(q.shape)


class Probe:
    """Lanczos steps of a random vector outside a subspace; each pass of the block takes one along."""

    def __init__(self, wanted: np.ndarray, random: np.random.Generator):
        self.wanted, self.basis, self.alpha, self.beta = wanted, [], [], []
        self.basis.append(self._outside(random.standard_normal(len(wanted))))

    def _outside(self, v: np.ndarray) -> np.ndarray:
        for _ in range(2):  # twice is enough
            v = v - self.wanted @ (self.wanted.T @ v)
            for b in self.basis:
                v = v - b * (b @ v)
        size = np.linalg.norm(v)
        return v / size if size > 1e-12 else np.zeros_like(v)

    def vector(self) -> np.ndarray:
        return self.basis[-1]

    def take(self, image: np.ndarray) -> None:
        v = self.vector()
        self.alpha.append(float(v @ image))
        step = image - self.wanted @ (self.wanted.T @ image)
        for b in self.basis:
            step = step - b * (b @ step)
        self.beta.append(float(np.linalg.norm(step)))
        self.basis.append(self._outside(step))

    def ends(self) -> tuple[float, float, float]:
        """Least and greatest Ritz value, and how far the ends of the spectrum may lie outside them."""
        k = next((i + 1 for i, b in enumerate(self.beta) if b <= 1e-12 * max(map(abs, self.alpha))), len(self.alpha))
        t = np.diag(self.alpha[:k]) + np.diag(self.beta[: k - 1], 1) + np.diag(self.beta[: k - 1], -1)
        theta, s = np.linalg.eigh(t)
        return theta[0], theta[-1], self.beta[k - 1] * float(max(abs(s[-1, 0]), abs(s[-1, -1])))


def filtered(spread: Spread, q: np.ndarray, low: float, high: float, probe: Probe, degree: int = DEGREE) -> np.ndarray:
    """The Chebyshev polynomial of ``[low, high]``, of a block: the three-term recurrence, a pass a step."""
    middle, half = (high + low) / 2, max((high - low) / 2, 1e-300)

    def step(block: np.ndarray) -> np.ndarray:
        image = spread.apply(np.column_stack([block, probe.vector()]))
        probe.take(image[:, -1])
        return (image[:, :-1] - middle * block) / half

    before, now = q, step(q)
    for _ in range(1, degree):
        size = np.abs(now).max()
        before, now = before / size, now / size  # the recurrence is linear; this keeps it in range
        before, now = now, 2 * step(now) - before
    return now


def _ritz(spread: Spread, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values of an orthonormal block, falling, their vectors and the vectors' images."""
    image = spread.apply(q)
    h = q.T @ image
    theta, s = np.linalg.eigh((h + h.T) / 2)
    s = s[:, ::-1]
    return theta[::-1], q @ s, image @ s


def _degree(theta: np.ndarray, k: int, low: float, high: float, most: int) -> int:
    """As high as the first wanted vector does not drown the last one in its rounding."""
    middle, half = (high + low) / 2, (high - low) / 2
    growth = [float(np.arccosh(max(1.0, (t - middle) / half))) for t in (theta[0], theta[k - 1])]
    return max(2, min(most, int(32 / max(1e-9, growth[0] - growth[1]))))


def components(spread: Spread, k: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` eigenvalues, falling, and their vectors as columns; fewer where fewer directions have any spread."""
    d, p = spread.d, min(spread.d, k + guard)
    if spread.n < 2 or spread.trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    random = np.random.default_rng(5)
    theta, q, image = _ritz(spread, np.linalg.qr(random.standard_normal((d, p)))[0])
    low, last = 0.0, np.inf
    for _ in range(rounds if p < d else 0):
        wanted = min(k, int((theta > FLAT * spread.trace).sum()))
        rest = float(np.linalg.norm(image - q * theta, axis=0)[:wanted].max(initial=0.0)) / theta[0]
        settled = rest <= TOLERANCE or rest <= 100 * TOLERANCE and rest > last / 2  # or rounding lets it fall no further
        last = rest
        high = max(float(theta[-1]), 1e-9 * theta[0])
        low = min(low, 0.9 * high)
        probe = Probe(q[:, :wanted], random)
        lifted = filtered(spread, q, low, high, probe, _degree(theta, wanted, low, high, degree))
        theta, q, image = _ritz(spread, np.linalg.qr(lifted / np.linalg.norm(lifted, axis=0))[0])
        least, most, slack = probe.ends()
        if settled and most <= theta[wanted - 1] * (1 + 1e-9) + FLAT * spread.trace:
            break
        low = max(0.0, least - slack)
    else:
        if p < d:
            raise ArithmeticError(f"not certified in {rounds} rounds: residual {last:.2g}")
    wanted = min(k, int((theta > FLAT * spread.trace).sum()))
    return theta[:wanted], q[:, :wanted]


def identity_error(spread: Spread, values: np.ndarray, vectors: np.ndarray) -> float:
    """How far the covariance of the whitened vectors, measured over all of them, is from the identity."""
    if not len(values):
        return 0.0
    w = vectors / np.sqrt(values)
    return float(np.abs(w.T @ spread.apply(w) - np.eye(len(values))).max())


_OUT = [("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]


def _whitened(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, model: Broadcast) -> Iterator[pa.RecordBatch]:
    w, explained, error = model.value
    d, k = w.shape
    for whole_batch in batches:
        for a in range(0, whole_batch.num_rows, 2048):
            batch = whole_batch.slice(a, 2048)
            x = n * whole(batch.column(1), d, SCALE, MOST) - sums
            top = int(np.abs(x).max(initial=0))
            squares = (x * x).sum(axis=1).tolist() if top * top * d < 1 << 63 else [sum(int(v) ** 2 for v in r) for r in x.tolist()]
            m = len(x)
            rows = np.repeat(np.arange(m), k)
            kept = pa.array([v if v < 1 << 63 else None for v in squares], type=pa.int64())
            yield batch_of(pa.schema([batch.schema.field(0), *_OUT]), [
                batch.column(0).take(pa.array(rows)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), kept.take(pa.array(rows)),
                ((x.astype(np.float64) / n) @ w).ravel(), np.tile(explained, m), np.full(m * k, error),
            ])


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: the id, ``component, n, deviation, whitened, explained, identity_error``."""
    held = embeddings.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v")).where(usable(F.col("_v")))
    spread = Spread(held, "_v")
    values, vectors = components(spread, k)
    model = embeddings.sparkSession.sparkContext.broadcast((vectors / np.sqrt(values), values / spread.trace if len(values) else values, identity_error(spread, values, vectors)))
    d, n, sums = spread.d, spread.n, np.array(spread.sums, dtype=np.int64)
    kind = held.schema["_id"].dataType.simpleString()
    got = held.where((F.size("_v") == d) & F.lit(len(values) > 0)).mapInArrow(lambda it: _whitened(it, n, sums, model), f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return got.withColumnRenamed("_id", id_col)
