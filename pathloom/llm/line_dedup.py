"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A document's lines are its ``\\n``-split pieces; only lines with something but ASCII white space count. Every
``RUN`` consecutive lines are a window, and so are fewer lines that have ``LONG_WORDS`` words together (unless
``words`` is None). A window's fingerprint is the line of least hash in it, the first of equals, so any window that
two places share has its fingerprint at the same relative position. Selected fingerprints join by position:

1. each with the earliest place of its line hash; from there the match is extended both ways, line by line, as far as
   windows of this fingerprint reach (beyond, the next fingerprint goes on). A match of a window or more is a run.
2. windows that no run covers (their fingerprint is a line that stands in several contexts) join their own earliest place.

Runs that overlap or touch are united, and their lines are deleted: those of all windows that occur earlier (smaller
id, or same document and earlier line), all judged on the input.

Defined results: a null text stays null; equal documents lose their windows but at the smallest id; documents without a
window lose nothing; lines without content stay; repeated rows of one id and text are one document and get the same
result; a null id comes before others; ids that aren't whole numbers are in the order of their texts; columns named
like those added are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from pathloom.plans.durable import durable
from pathloom.plans.skew import salted_join

RUN = 3
#: Words that make a window of fewer lines.
LONG_WORDS = 50

_BLANKS = " \t\n\x0b\f\r"
_WORD = r"[^\x20\x09-\x0D]+"


def _counts(line: Column) -> Column:
    """Whether a line counts: trimming stops at the first character that isn't blank and decodes nothing."""
    return F.btrim(line, F.lit(_BLANKS)) != ""


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _places(text: Column) -> Column:
    """Places, among all lines, of the lines that count."""
    return F.filter(F.transform(_lines(text), lambda x, i: F.when(_counts(x), i)), lambda i: i.isNotNull())


def _hashes(text: Column) -> Column:
    return F.transform(F.filter(_lines(text), _counts), lambda x: F.xxhash64(x))


def _word_counts(text: Column) -> Column:
    """The number of words of each line that counts."""
    return F.filter(F.transform(_lines(text), lambda x: F.regexp_count(x, F.lit(_WORD))), lambda n: n > 0)


def _keys(documents: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """What orders the documents, null first, and a hash of the text."""
    if isinstance(documents.schema[id_col].dataType, IntegralType):
        did = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    else:
        did = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    return did, F.xxhash64(text_col)


def _h(d: int) -> str:
    """The column of the line hash ``d`` lines on from a fingerprint."""
    return f"h{d}" if d >= 0 else f"h_{-d}"


def _sizes(run: int, words: int | None) -> list[tuple[int, int]]:
    """Windows that hold a fingerprint: how many lines they have, and how many of them stand before it."""
    return [(size, before) for size in range(1 if words else run, run + 1) for before in range(size)]


def fingerprints(documents: DataFrame, id_col: str, text_col: str, run: int = RUN, words: int | None = LONG_WORDS) -> DataFrame:
    """Selected fingerprints ``did, th, place`` with the hashes of the lines around (``h0`` their own), and which windows have
    chosen them (``w_size_before``). Lines are numbered from 1 among those that count."""
    did, th = _keys(documents, id_col, text_col)
    docs = documents.select(did.alias("did"), th.alias("th"), _hashes(F.col(text_col)).alias("h"), *([_word_counts(F.col(text_col)).alias("n")] if words else []))
    docs = docs.where(F.size("h") >= (1 if words else run))
    near = range(1 - run, run)

    def around(p: Column) -> Column:
        counts = [F.get("n", p - 1 + d).alias("n" + _h(d)) for d in near] if words else []
        return F.struct(p.alias("place"), *[F.get("h", p - 1 + d).alias(_h(d)) for d in near], *counts)

    rows = docs.select("did", "th", F.inline(F.transform(F.sequence(F.lit(1), F.size("h")), around)))
    chosen = {}
    for size, before in _sizes(run, words):
        # the least of the window's lines, the first of equals; a line that isn't there makes it null
        cond = F.lit(True)
        for d in range(-before, size - before):
            if d:
                cond = cond & ((F.col("h0") < F.col(_h(d))) if d < 0 else (F.col("h0") <= F.col(_h(d))))
        if size < run:
            total = F.col("nh0")
            for d in range(-before, size - before):
                if d:
                    total = total + F.col("n" + _h(d))
            cond = cond & (total >= words)
        chosen[f"w_{size}_{before}"] = F.coalesce(cond, F.lit(False))
    marked = rows.select("did", "th", "place", *map(_h, near), *[c.alias(n) for n, c in chosen.items()])
    return marked.where(reduce(Column.__or__, map(F.col, chosen)))


def _reach(step: int, run: int) -> Column:
    """For how many lines the surroundings agree with those of the fingerprint's earliest place."""
    agree, total = F.lit(True), F.lit(0)
    for d in range(1, run):
        agree = agree & F.coalesce(F.col(_h(step * d)) == F.col(f"first.{_h(step * d)}"), F.lit(False))
        total = total + agree.cast("int")
    return total


def repeated_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int | None = LONG_WORDS) -> DataFrame:
    """``did, th, cuts``: per document its runs of lines ``(a, b)`` (the first, the one after the last, among those that count)
    that are windows which also occur earlier; runs are apart and in order."""
    marks = durable(fingerprints(documents, id_col, text_col, run, words))
    often = marks.groupBy("h0").agg(F.count("*").alias("n")).where("n > 1").select("h0")
    met = durable(salted_join(marks, often, ["h0"], salts=8))
    around = [_h(d) for d in range(1 - run, run) if d]
    first = met.groupBy("h0").agg(F.min(F.struct("did", "place", *around)).alias("first"))
    later = F.struct("did", "place") > F.struct("first.did", "first.place")
    met = salted_join(met, first, ["h0"]).withColumns({"back": F.when(later, _reach(-1, run)), "on": F.when(later, _reach(1, run))})
    inside = lambda size, before: (F.col("back") >= before) & (F.col("on") >= size - 1 - before)
    short = [F.col(f"w_{s}_{b}") & inside(s, b) for s, b in _sizes(run, words) if s < run]
    enough = reduce(Column.__or__, short, F.col("back") + F.col("on") + 1 >= run)
    met = durable(met.withColumn("is_run", F.coalesce(enough, F.lit(False))).drop("first"))
    runs = met.where("is_run").select("did", "th", (F.col("place") - F.col("back")).alias("a"), (F.col("place") + F.col("on") + 1).alias("b"))
    # what no run covers
    left = [F.when(F.col(f"w_{s}_{b}") & ~(F.col("is_run") & F.coalesce(inside(s, b), F.lit(False))), F.struct((F.col("place") - b).alias("at"), F.array(*[F.col(_h(d)) for d in range(-b, s - b)]).alias("lines"))) for s, b in _sizes(run, words)]
    rest = durable(met.select("did", "th", F.inline(F.array_compact(F.array(*left)))))
    once = rest.groupBy("lines").agg(F.min(F.struct("did", "at")).alias("source"), F.count("*").alias("n")).where("n > 1").select("lines", "source")
    again = salted_join(rest, once, ["lines"]).where(F.struct("did", "at") > F.col("source")).select("did", "th", F.col("at").alias("a"), (F.col("at") + F.size("lines")).alias("b"))
    return _united(runs.unionByName(again))


def _united(runs: DataFrame) -> DataFrame:
    """Runs of a document that overlap or touch become one."""
    before = Window.partitionBy("did", "th").orderBy("a", "b")
    reached = F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1))
    parts = runs.distinct().withColumn("new", F.coalesce(F.col("a") > reached, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(before))
    whole = parts.groupBy("did", "th", "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return whole.groupBy("did", "th").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cuts"))


ADDED = ("n_lines", "n_removed_lines")


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int | None = LONG_WORDS) -> DataFrame:
    """``documents`` with the repeated lines cut from the text, and ``n_lines`` (those that count), ``n_removed_lines``."""
    cuts = repeated_runs(documents, id_col, text_col, run, words).select(F.col("did").alias("d"), F.col("th").alias("h"), "cuts")
    did, th = _keys(documents, id_col, text_col)
    docs = documents.select(F.struct("*").alias("row"), did.alias("did"), th.alias("th"))
    text = F.col("row").getField(text_col)
    held = docs.join(cuts, (F.col("did") == F.col("d")) & (F.col("th") == F.col("h")), "left").withColumn("lines", _lines(text)).withColumn("at", F.when(F.col("cuts").isNotNull(), _places(text)))
    # each run from the place of its first line to that of its last, among all lines
    spans = F.transform("cuts", lambda c: F.struct(F.get("at", c["a"] - 1).alias("s"), F.get("at", c["b"] - 2).alias("e")))
    held = held.withColumn("spans", spans)
    since = lambda i: F.coalesce(F.when(i > 0, F.get("spans", i - 1)["e"]), F.lit(-1)) + 1
    blank = lambda x: ~_counts(x)
    pieces = F.transform("spans", lambda s, i: F.concat(F.slice("lines", since(i) + 1, s["s"] - since(i)), F.filter(F.slice("lines", s["s"] + 1, s["e"] - s["s"] + 1), blank)))
    end = since(F.size("spans"))
    kept = F.array_join(F.concat(F.flatten(pieces), F.slice("lines", end + 1, F.size("lines") - end)), "\n")
    new = F.when(F.col("cuts").isNull(), text).otherwise(kept)
    counted = F.when(text.isNull(), 0).otherwise(F.size(F.filter("lines", _counts))).cast("long")
    gone = F.coalesce(F.aggregate("cuts", F.lit(0), lambda n, c: n + c["b"] - c["a"]), F.lit(0)).cast("long")
    others = [(new if c == text_col else F.col("row").getField(c)).alias(c) for c in documents.columns if c not in ADDED]
    return held.select(*others, counted.alias("n_lines"), gone.alias("n_removed_lines"))
