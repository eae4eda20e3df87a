"""Quality rules: counts over whole texts, a base rule, and robust multivariate outliers.

Words are runs of anything but ASCII white space. Counts per document: ``n_words``; ``word_chars`` (code
points in words); ``n_symbols`` (characters of ``#*$%&|<>``); ``n_dup_lines`` (lines with a word that equal
an earlier line); ``n_repeat_words`` (words in 5-word windows found twice or more in the text).

The counts become a vector of five transformed statistics. For each language and source the minimum
covariance determinant estimate of its centre and scatter is found by concentration steps from a
coordinatewise median start, each step an aggregation over all documents; a document goes if its robust
Mahalanobis distance exceeds ``CUTOFF``. A group of n documents says little about itself where n is small, so its
estimate counts n, and that of its language ``PRIOR``, for the one that is used; likewise a language's and that of all
documents. Nothing changes at once with a group's size.

Defined results: a null text has no words and fails the base rule; null language and source are groups of
their own; repeated rows count as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm._text import BLANK_WORDS, SpanHash, U, Words, batch_of, binary, byte_values, chunks, covered, word_span_hash
from pathloom.plans.durable import durable
from pathloom.plans.skew import salted_join

SYMBOLS = b"#*$%&|<>"
REPEAT_WORDS = 5
FEATURES = ("f_words", "f_word_len", "f_symbols", "f_dup_lines", "f_repeats")
#: Least standard deviation of each statistic: a group in which nearly all documents agree isn't strict about the rest.
FLOORS = (1.0, 0.15, 0.8, 0.3, 0.3)
PRIOR = 60
KEEP_SHARE = 0.75
STEPS = 3
#: Squared distance beyond which a document is rejected: far above the 1 - 1e-6 quantile of chi-square with 5 degrees (36).
CUTOFF = 80.0
#: Consistency of the scatter of the nearest three quarters, for 5 normal dimensions.
CONSISTENCY = 1.6

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _per_document(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated_words(words: np.ndarray, first: np.ndarray, n: int = REPEAT_WORDS) -> np.ndarray:
    """Which words lie in an n-word window that its own document holds twice or more."""
    total = len(words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(np.arange(total) + n <= first[1:][doc]) if total else np.zeros(0, dtype=np.int64)
    if not len(at):
        return np.zeros(total, dtype=bool)
    h = word_span_hash(words)(at, at + n) ^ (doc[at].astype(np.uint64) * U(0xD6E8FEB86659FD93))
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return covered(total, at[twice], at[twice] + n)


def _duplicate_lines(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word that equal an earlier one; all lines with a word."""
    brk = np.unique(np.concatenate((np.flatnonzero(raw == 10), ends)))
    s = np.concatenate(([0], brk[:-1] + 1))
    full = np.searchsorted(words.starts, brk) > np.searchsorted(words.starts, s)
    s, e = s[full], brk[full]
    doc = np.searchsorted(ends, s)
    h = SpanHash(byte_values(raw))(s, e)
    order = np.lexsort((h, doc))
    dup = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    n = len(starts)
    return np.bincount(doc[order][1:][dup], minlength=n), np.bincount(doc, minlength=n)


def _counts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    for batch in batches:
        out = np.zeros((len(_COUNTS), batch.num_rows), dtype=np.int64)
        for c in chunks(binary(batch.column(0))):
            w = Words(c, BLANK_WORDS)
            raw = w.raw
            bounds = np.append(c.starts, len(raw))
            rows = np.array(c.rows)
            out[0, rows] = np.diff(w.first)
            out[1, rows] = _per_document(BLANK_WORDS[raw] & ((raw & 0xC0) != 0x80), bounds)
            out[2, rows] = _per_document(symbol[raw], bounds)
            out[3, rows], out[5, rows] = _duplicate_lines(raw, c.starts, c.ends, w)
            out[4, rows] = _per_document(repeated_words(w.hashes(), w.first), w.first)
        yield batch_of(schema, [*batch.columns[1:], *out])


def counts(documents: DataFrame, text_col: str = "text", others: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``others`` and the counts of each row's text."""
    docs = documents.select(F.col(text_col).alias("_text"), *others)
    kinds = [f.dataType.simpleString() for f in docs.schema][1:]
    ddl = ", ".join([f"`{n}` {k}" for n, k in zip(others, kinds, strict=True)] + [f"{n} long" for n in _COUNTS])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(i) for i in range(1, batch.num_columns)), *((n, pa.int64()) for n in _COUNTS)])
            yield from _counts(iter([batch]), schema)

    return docs.mapInArrow(task, ddl)


def with_features(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({
        "f_words": F.log1p("n_words"),
        "f_word_len": F.log((F.col("word_chars") + 1) / n),
        "f_symbols": F.log1p(100 * F.col("n_symbols") / n),
        "f_dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "f_repeats": F.sqrt(F.col("n_repeat_words") / n),
    })


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _distance():
    """Squared Mahalanobis distance of a row joined with its model (``c0..`` and ``p_i_j``)."""
    d = [F.col(f) - F.col(f"c{i}") for i, f in enumerate(FEATURES)]
    total = None
    for i, j in _PAIRS:
        term = (1 if i == j else 2) * F.col(f"p{i}_{j}") * d[i] * d[j]
        total = term if total is None else total + term
    return total


def _start(rows: DataFrame) -> DataFrame:
    mid = rows.groupBy("key").agg(*[F.percentile_approx(f, 0.5).alias(f"c{i}") for i, f in enumerate(FEATURES)])
    off = salted_join(rows, mid, ["key"]).groupBy("key").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(FEATURES))], *[F.percentile_approx(F.abs(F.col(f) - F.col(f"c{i}")), 0.5).alias(f"m{i}") for i, f in enumerate(FEATURES)])
    sd = [F.greatest(1.4826 * F.col(f"m{i}"), F.lit(FLOORS[i])) for i in range(len(FEATURES))]
    return off.select("key", *[f"c{i}" for i in range(len(FEATURES))], *[((1 / (sd[i] * sd[i])) if i == j else F.lit(0.0)).alias(f"p{i}_{j}") for i, j in _PAIRS])


def _inverted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From centres and scatter to centres and inverted scatter, one row per group."""
    d = len(FEATURES)
    for f in frames:
        scatter = np.zeros((len(f), d, d))
        for i, j in _PAIRS:
            scatter[:, i, j] = scatter[:, j, i] = f[f"s{i}_{j}"].to_numpy()
        inverse = inverted(scatter)
        yield pd.DataFrame({"key": f["key"], **{f"c{i}": f[f"c{i}"] for i in range(d)}, **{f"p{i}_{j}": inverse[:, i, j] for i, j in _PAIRS}})


def inverted(scatter: np.ndarray) -> np.ndarray:
    """With a floor to the variances of the statistics, and so to those of all their mixtures."""
    d = scatter.shape[1]
    spread = np.sqrt(np.maximum(scatter[:, range(d), range(d)], np.square(FLOORS)))
    unit = scatter / spread[:, :, None] / spread[:, None, :]
    values, vectors = np.linalg.eigh(unit) if len(scatter) else (np.zeros((0, d)), np.zeros((0, d, d)))
    return np.einsum("nij,nj,nkj->nik", vectors, 1 / np.maximum(values, 0.25), vectors) / spread[:, :, None] / spread[:, None, :]


_C = [f"c{i}" for i in range(len(FEATURES))]
_S = [f"s{i}_{j}" for i, j in _PAIRS]
_MODEL = ", ".join(["key string", *[f"{c} double" for c in _C], *[f"p{i}_{j} double" for i, j in _PAIRS]])


def _step(rows: DataFrame, model: DataFrame, share: float) -> DataFrame:
    """One concentration step: ``key``, centre and scatter of the ``share`` of each group's rows that are nearest to the last one."""
    near = salted_join(rows, model, ["key"]).select("key", *FEATURES, _distance().alias("d2"))
    cut = near.groupBy("key").agg(F.percentile_approx("d2", share, 1000).alias("cut"))
    inside = salted_join(near, cut, ["key"]).where("d2 <= cut")
    sums = inside.groupBy("key").agg(*[F.avg(f).alias(f"c{i}") for i, f in enumerate(FEATURES)], *[F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i, j in _PAIRS])
    return durable(sums.select("key", *_C, *[((F.col(f"s{i}_{j}") - F.col(f"c{i}") * F.col(f"c{j}")) * CONSISTENCY).alias(f"s{i}_{j}") for i, j in _PAIRS]))


def estimates(stats: DataFrame, steps: int = STEPS, share: float = KEEP_SHARE) -> DataFrame:
    """Robust centre and scatter (``c0.., s0_0..``) for each key of ``stats(key, features)``."""
    model = durable(_start(stats))
    for n in range(steps):
        found = _step(stats, model, share)
        model = found.mapInPandas(_inverted, _MODEL)
    return found


def _blended(own: DataFrame, wider: DataFrame) -> DataFrame:
    """``own(key, above, n, centre, scatter)`` with a part of the estimate of the wider group named by ``above``."""
    w = wider.select(F.col("key").alias("above"), *[F.col(x).alias(f"w_{x}") for x in (*_C, *_S)])
    share = F.col("n") / (F.col("n") + PRIOR)
    return own.join(w, "above").select("key", "n", *[(share * F.col(x) + (1 - share) * F.col(f"w_{x}")).alias(x) for x in (*_C, *_S)])


def models(stats: DataFrame) -> DataFrame:
    """Centre and inverted scatter for each ``own`` of ``stats(own, lk, features)``, blended with those of its language and of all."""
    rows = stats.select(F.explode(F.array(F.concat(F.lit("s:"), "own"), F.concat(F.lit("l:"), "lk"), F.lit("all"))).alias("key"), *FEATURES)
    found = estimates(rows)
    sized = durable(stats.groupBy("own", "lk").count())
    langs = sized.groupBy(F.concat(F.lit("l:"), "lk").alias("key")).agg(F.sum("count").alias("n")).withColumn("above", F.lit("all"))
    by_lang = _blended(langs.join(found, "key"), found)
    groups = sized.select(F.concat(F.lit("s:"), "own").alias("key"), F.concat(F.lit("l:"), "lk").alias("above"), F.col("count").alias("n"))
    return durable(_blended(groups.join(found, "key"), by_lang.drop("n")).drop("n").mapInPandas(_inverted, _MODEL))


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """Per row of ``documents``: its counts, ``base_failed``, the squared robust ``distance2`` and ``kept``."""
    got = counts(documents.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_l"), F.col(source_col).alias("_s"), F.col(text_col).alias("_t")), "_t", ("_id", "_l", "_s"))
    named = got.withColumns({"own": F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), "_l"), F.lit("")), F.coalesce(F.concat(F.lit("="), "_s"), F.lit(""))), "lk": F.coalesce(F.concat(F.lit("="), "_l"), F.lit(""))})
    stats = durable(with_features(named))
    judged = salted_join(stats.withColumn("key", F.concat(F.lit("s:"), "own")), models(stats), ["key"]).withColumn("distance2", _distance())
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(F.col("_id").alias(id_col), *_COUNTS[:-1], failed.alias("base_failed"), F.round("distance2", 6).alias("distance2"), (~failed & (F.col("distance2") <= cutoff)).alias("kept"))


def filter_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``documents`` without the rows that :func:`judge` rejects. Rows with one id stay or go together: they stay if one of them is kept."""
    kept = judge(documents, id_col, text_col, lang_col, source_col).where("kept").select(F.col(id_col).alias("_kept")).distinct()
    return documents.join(kept, documents[id_col].eqNullSafe(kept["_kept"]), "left_semi")
