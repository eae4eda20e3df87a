"""Paper texts: sections, chunks, pages, and objects recovered from model outputs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.functions import vocab
from pathloom.operators.tables import numbered, ordered
from pathloom.plans.durable import durable
from pathloom.plans.skew import salted_join

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"(\[])")


def sections(papers: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, section_no, label, body``: a header line begins a section; what stands before the first is the preamble.
    Sections without a body are none; a text without any is one of label ``unknown``."""
    lines = papers.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
    head = F.col("line").rlike(vocab.SECTION_HEADER)
    w = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("head", head).withColumn("section_no", F.sum(F.col("head").cast("int")).over(w))
    label = N.canonical(F.lower(F.regexp_extract("line", vocab.SECTION_HEADER, 1)))
    got = marked.groupBy(key, "section_no").agg(F.max(F.when(F.col("head"), label)).alias("label"), F.array_join(F.array_compact(ordered(F.when(~F.col("head"), F.col("line")), "line_no")), "\n").alias("body"))
    full = got.withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", "")).withColumn("label", F.coalesce("label", F.lit("preamble")))
    some = full.where("body <> ''")
    none = papers.select(key).distinct().join(some.select(key), key, "left_anti").select(key, F.lit(0).cast("long").alias("section_no"), F.lit("unknown").alias("label"), F.lit("").alias("body"))
    return some.unionByName(none)


def pack_sentences(words: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of sentences, given by their word counts: as many as fit the limit, one at least; the next range goes
    back over at most ``overlap`` words, but always on."""
    total = np.concatenate(([0], np.cumsum(words)))
    out, s, n = [], 0, len(words)
    while s < n:
        e = max(s + 1, int(np.searchsorted(total, total[s] + limit, side="right")) - 1)
        out.append((s, e))
        if e >= n:
            break
        s = max(s + 1, int(np.searchsorted(total, total[e] - overlap, side="left")))
    return out


def _chunks(frames: Iterator[pd.DataFrame], key: str, limit: int, overlap: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for k, no, label, body in zip(f[key], f["section_no"], f["label"], f["body"], strict=True):
            sentences = [x for x in (p.strip() for p in _SENTENCE_END.split(body)) if x]
            at = 0
            for i, (a, b) in enumerate(pack_sentences(np.array([len(x.split()) for x in sentences]), limit, overlap)):
                text = " ".join(sentences[a:b])
                n = len(text.split())
                rows.append((k, no, i, label, text, n, at, at + n, a, b))
                at += n
        yield pd.DataFrame(rows, columns=[key, "section_no", "chunk_no", "section", "text", "word_count", "start_word", "end_word", "first_sentence", "end_sentence"])


def chunks(parts: DataFrame, key: str = "doc_id", limit: int = 8000, overlap: int = 1200) -> DataFrame:
    """Chunks of whole sentences of each section, at most ``limit`` words (or one sentence). Row by row, without a shuffle."""
    kind = parts.schema[key].dataType.simpleString()
    return parts.select(key, "section_no", "label", "body").mapInPandas(lambda it: _chunks(it, key, limit, overlap), f"`{key}` {kind}, section_no long, chunk_no int, section string, text string, word_count int, start_word int, end_word int, first_sentence int, end_sentence int")


def ordered_chunks(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks numbered from 1 by relevance of their section, then as they come; ``relevance``; ``offset`` of their section's words."""
    scored = found.withColumn("relevance", N.section_relevance(F.col("section")))
    size = scored.groupBy(key, "section_no").agg(F.sum("word_count").alias("n"))
    w = Window.partitionBy(key).orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    at = size.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    return numbered(scored.join(at, [key, "section_no"]), [key], F.desc("relevance"), "section_no", "chunk_no", name="chunk_id")


SKIPPED = ("references", "bibliography", "acknowledgements", "acknowledgments")


def page_sections(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """The section each page ends in: that of its own last header, else of the page before."""
    lines = pages.select(key, page, F.posexplode(F.split(text, "\n")).alias("i", "line")).where(F.col("line").rlike(vocab.SECTION_HEADER))
    last = lines.groupBy(key, page).agg(F.max_by(N.canonical(F.lower(F.regexp_extract("line", vocab.SECTION_HEADER, 1))), "i").alias("own"))
    w = Window.partitionBy(key).orderBy(page)
    return pages.join(last, [key, page], "left").withColumn("section", F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit("preamble"))).drop("own")


def joined_pages(marked: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Texts of the pages that aren't in a skipped section, in order."""
    return marked.where(~F.col("section").isin(*SKIPPED)).groupBy(key).agg(F.array_join(ordered(text, page), "\n").alias("text"), F.count("*").alias("pages"))


def mostly_empty(pages: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50, share: float = 0.5) -> DataFrame:
    """Whether most pages of a document have hardly any text."""
    return pages.groupBy(key).agg((F.avg(F.when(F.length(F.trim(text)) < least, 1.0).otherwise(0.0)) > share).alias("mostly_empty"))


_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")
_TRAILING = re.compile(r",(\s*[}\]])")


def _state(text: str) -> tuple[list[str], bool, list[int]]:
    """Brackets still open at the end of a JSON text, whether it ends within a string, and the places of commas outside strings."""
    stack, quoted, skip, commas = [], False, False, []
    for i, ch in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
        elif ch == ",":
            commas.append(i)
    return stack, quoted, commas


def salvage(raw: str, tries: int = 25) -> str | None:
    """The object in a text: as it is, without fences and words around it, without trailing commas; a text cut short is
    closed, after its last pieces are dropped one after another if need be."""
    text = _FENCE.sub("", raw)
    begin = text.find("{")
    if begin < 0:
        return None
    text = text[begin:]
    try:
        return json.dumps(json.JSONDecoder().raw_decode(text)[0], ensure_ascii=False)
    except ValueError:
        pass
    end = text.rfind("}")
    shorter = [text[: end + 1]] if end > 0 else []
    _, _, commas = _state(text)
    for piece in [*shorter, text, *(text[:c] for c in commas[: -tries - 1 : -1])]:
        stack, quoted, _ = _state(piece)
        closed = _TRAILING.sub(r"\1", piece.rstrip().rstrip(",") + '"' * quoted + "".join(reversed(stack)))
        try:
            got = json.loads(closed)
        except ValueError:
            continue
        if isinstance(got, dict):
            return json.dumps(got, ensure_ascii=False)
    return None


def _salvaged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        f = f.copy()
        f["json"] = [salvage(x) if isinstance(x, str) else None for x in f["raw"]]
        yield f.drop(columns="raw")


def recovered(outputs: DataFrame, key: list[str], raw: str = "raw") -> DataFrame:
    """``key, json, outcome``: objects parsed by Spark itself, salvaged by the slow path, or failed. Only what doesn't
    parse goes through Python."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))
    marked = outputs.select(*key, F.col(raw).alias("raw"), is_object.alias("ok"))
    good = marked.where("ok").select(*key, F.col("raw").alias("json"), F.lit("parsed").alias("outcome"))
    ddl = ", ".join(f"`{k}` {outputs.schema[k].dataType.simpleString()}" for k in key)
    rest = marked.where("not ok").select(*key, "raw").mapInPandas(_salvaged, ddl + ", json string")
    return good.unionByName(rest.select(*key, "json", F.when(F.col("json").isNull(), "failed").otherwise("salvaged").alias("outcome")))


def motif_tokens(entries: DataFrame, fields: tuple[str, ...] = ("reaction", "species", "compartment")) -> DataFrame:
    """``model, field, token`` of each field's texts, and of all of them as ``all``."""
    out = None
    for f in fields:
        one = entries.select("model", F.explode(N.search_tokens(F.array_join(f, " "))).alias("token"))
        both = one.select("model", F.lit(f).alias("field"), "token").union(one.select("model", F.lit("all"), "token"))
        out = both if out is None else out.union(both)
    return out.distinct()


WEIGHTS = {"reaction": 2.6, "species": 1.8, "compartment": 1.0, "all": 0.6}


def motif_words(entries: DataFrame, fields: tuple[str, ...] = ("reaction", "species", "compartment")) -> DataFrame:
    """``model, field, token``: every word of each field's texts as it stands, for :func:`postings`."""

    def bag(f: str) -> Column:
        return F.transform(F.coalesce(N.search_tokens(F.array_join(f, " ")), F.array().cast("array<string>")), lambda t: F.struct(F.lit(f).alias("field"), t.alias("token")))

    return entries.select("model", F.inline(F.concat(*map(bag, fields))))


def postings(words: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``model, token, w``: each word of a model once, with the weights of the fields that have it; only words that are asked
    for take part in the shuffle. ``asked(token)`` is broadcast if the caller has found it small."""
    some = words if asked is None else words.join(asked, "token", "left_semi")
    has = lambda f: F.max(F.when(F.col("field") == f, WEIGHTS[f]).otherwise(0.0))
    return some.groupBy("model", "token").agg((F.lit(WEIGHTS["all"]) + sum((has(f) for f in WEIGHTS if f != "all"), F.lit(0.0))).alias("w"))


#: Postings that a query's rarest words may have together for the first look; words of queries that may be broadcast.
SEED_ROWS, GIVEN_WORDS = 2000, 500_000


def top_examples(queries: DataFrame, index: DataFrame, k: int = 3) -> DataFrame:
    """``query, model, score, rn``: the ``k`` models of greatest weighted overlap with a query's words, from an ``index`` of models' words
    (``model, field, token``).

    Postings of words that no query has are left where they are. The rarest words give ``k`` models and so a score that must
    be beaten. Each word has the greatest weight it has in any model; frequent words that can't reach that score all together
    find no models. They are looked up only for models that the others have found and that can still reach it with them."""
    words = durable(queries.select("query", F.array_distinct(N.search_tokens(F.col("text"))).alias("t")).select("query", F.size("t").alias("n"), F.explode("t").alias("token")))
    asked = words.select("token").distinct()
    lists = durable(postings(index, F.broadcast(asked) if words.count() <= GIVEN_WORDS else asked))
    held = lists.groupBy("token").agg(F.count("*").alias("models"), F.max("w").alias("top"))
    rarest = Window.partitionBy("query").orderBy("models", "token")
    onward = F.sum("top").over(rarest.rowsBetween(0, Window.unboundedFollowing)) / F.col("n")
    ranked = durable(words.join(held, "token").withColumns({"at": F.row_number().over(rarest), "rows": F.sum("models").over(rarest), "most": onward}))
    scored = lambda some: salted_join(lists, some, ["token"], salts=8).groupBy("query", "model").agg(F.sum(F.col("w") / F.col("n")).alias("score"))
    first = scored(ranked.where((F.col("at") == 1) | (F.col("rows") <= SEED_ROWS)).select("query", "n", "token"))
    beat = durable(numbered(first, ["query"], F.desc("score"), "model").where(F.col("rn") == k).select("query", (F.col("score") - 1e-6).alias("beat")))
    split = durable(ranked.join(beat, "query", "left").withColumn("finds", F.coalesce(F.col("most") >= F.col("beat"), F.lit(True))).select("query", "n", "token", "finds", "beat", "most"))
    late = split.where("not finds").groupBy("query").agg(F.max("most").alias("late"), F.first("beat").alias("beat"))
    found = scored(split.where("finds").select("query", "n", "token")).join(late, "query", "left")
    own = durable(found.where("beat is null or score + late >= beat").select("query", "model", "score"))
    rest = own.select("query", "model").join(split.where("not finds").select("query", "n", "token"), "query").join(lists, ["model", "token"]).groupBy("query", "model").agg(F.sum(F.col("w") / F.col("n")).alias("more"))
    total = own.join(rest, ["query", "model"], "left").select("query", "model", F.round(F.col("score") + F.coalesce("more", F.lit(0.0)), 6).alias("score"))
    return numbered(total, ["query"], F.desc("score"), "model").where(F.col("rn") <= k)


def context_texts(examples: DataFrame, entries: DataFrame, places: int = 8, species: int = 10, patterns: int = 6, most: int = 6000) -> DataFrame:
    """One text per query of its examples in order, each with a few compartments, species and reactions, cut at ``most`` characters."""
    e = examples.join(entries, "model")
    some = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    block = F.concat(F.lit("# "), "model", F.lit("\ncompartments: "), some("compartment", places), F.lit("\nspecies: "), some("species", species), F.lit("\nreactions: "), some("reaction", patterns))
    return e.withColumn("block", block).groupBy("query").agg(F.substring(F.array_join(ordered("block", "rn"), "\n\n"), 1, most).alias("context"))


def query_texts(entities: DataFrame, processes: DataFrame) -> DataFrame:
    """Per pathway its entities' and processes' names, each once, one a line."""
    both = entities.select("pathway_id", F.lit(0).alias("part"), "pos", "name").unionByName(processes.select("pathway_id", F.lit(1).alias("part"), "pos", "name"))
    first = both.withColumn("n", N.norm(F.col("name"))).where("n <> ''").groupBy("pathway_id", "n").agg(F.min(F.struct("part", "pos", "name")).alias("s"))
    return first.groupBy("pathway_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["name"]), "\n").alias("text"))
