"""Merging and deduplication: which row of several stays, and what the others give it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.operators.tables import first_per, ordered


def merge_ids(rows: DataFrame, keys: list[str], ids: str = "mapped_ids", rank: str = "pos") -> DataFrame:
    """``keys, mapped_ids``: for each database the first id that isn't blank, by rank."""
    flat = rows.select(*keys, rank, F.explode(ids).alias("db", "ext")).where(F.trim("ext") != "")
    best = flat.groupBy(*keys, "db").agg(F.min_by(F.trim("ext"), F.struct(rank, "ext")).alias("ext"))
    return best.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("db", "ext")))).alias(ids))


def merge_entities(rows: DataFrame, keys: list[str], name: str = "name", evidence: str = "evidence", lists: tuple[str, ...] = (), blanks: tuple[str, ...] = (), ids: str | None = None) -> DataFrame:
    """Rows of equal keys and equal normal name as one: the first's name and place, the longest evidence, first
    values that aren't blank, lists united, ids by first."""
    keyed = rows.withColumn("norm", N.norm(F.col(name))).where("norm <> ''")
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    aggs = [F.min_by(name, "pos").alias(name), F.min("pos").alias("pos"), F.max_by(evidence, F.struct(F.length(evidence), -F.col("pos"))).alias(evidence), F.count("*").alias("merged")]
    aggs += [F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col("pos"))).alias(c) for c in blanks]
    got = keyed.groupBy(*keys, "norm").agg(*aggs)
    for c in lists:
        flat = keyed.select(*keys, "norm", "pos", F.posexplode(c).alias("i", "x")).groupBy(*keys, "norm", "x").agg(F.min(F.struct("pos", "i")).alias("at"))
        got = got.join(flat.groupBy(*keys, "norm").agg(ordered("x", "at").alias(c)), [*keys, "norm"], "left")
    if ids:
        got = got.join(merge_ids(keyed, [*keys, "norm"], ids), [*keys, "norm"], "left")
    return got


def dedupe_locations(rows: DataFrame) -> DataFrame:
    """One row per entity and state: that of the longest evidence, the first of equals."""
    return first_per(rows.withColumn("_len", -F.length(F.coalesce("evidence", F.lit("")))), ["pathway_id", "entity", "state"], "_len", "pos").drop("_len")


def sides(participants: DataFrame) -> DataFrame:
    """One row per process: its inputs, outputs and modifiers in order."""
    side = lambda r: F.array_compact(ordered(F.when(F.col("role") == r, F.col("entity")), "pos"))
    return participants.groupBy("pathway_id", "process").agg(side("reactant").alias("inputs"), side("product").alias("outputs"), side("modifier").alias("modifiers"))


def signature(*parts: Column) -> Column:
    """A text for sorted sides: equal only for equal multisets."""
    return F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]))


def dedupe_processes(processes: DataFrame, keys: list[Column], better: list[Column]) -> DataFrame:
    """Of the processes of a pathway with one signature the best: by ``better``, all descending, then the first."""
    scored = processes.withColumn("_sig", signature(*keys)).withColumn("_best", F.struct(*[b.alias(f"b{i}") for i, b in enumerate(better)], (-F.col("pos")).alias("first")))
    rest = [c for c in processes.columns if c != "pathway_id"]
    got = scored.groupBy("pathway_id", "_sig").agg(F.max_by(F.struct(*rest), "_best").alias("r"), F.count("*").alias("copies"))
    return got.select("pathway_id", *[F.col(f"r.{c}").alias(c) for c in rest], "copies")


def is_noop(inputs: Column, outputs: Column) -> Column:
    """Whether a reaction makes nothing that it doesn't take, names compared in normal form."""
    a, b = F.transform(inputs, N.norm), F.transform(outputs, N.norm)
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_except(b, a)) == 0)


def noop_object(inputs: Column, outputs: Column) -> Column:
    """Whether both sides of a reaction hold the same names, as often."""
    return (F.size(inputs) > 0) & N.same_names(inputs, outputs)


def drop_noops(processes: DataFrame) -> DataFrame:
    """Without reactions that make nothing, unless they are ``essential``."""
    return processes.where(F.coalesce("essential", F.lit(False)) | ~is_noop(F.col("inputs"), F.col("outputs")))


def merge_additions(existing: DataFrame, additions: DataFrame) -> DataFrame:
    """Reactions ``(pathway_id, pos, inputs, outputs, state, evidence, actors)``: an addition with the sides of an
    existing one fills its blanks and joins its actors; others are appended after it."""
    io = signature(F.array_sort(F.transform("inputs", N.norm)), F.array_sort(F.transform("outputs", N.norm))).alias("io")
    both = existing.select("*", io, F.lit(0).alias("late")).unionByName(additions.select("*", io, F.lit(1).alias("late")))
    at = F.struct("late", "pos")
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    got = both.groupBy("pathway_id", "io").agg(
        F.min_by("inputs", at).alias("inputs"), F.min_by("outputs", at).alias("outputs"), F.min(at).alias("at"),
        *[F.min_by(filled(c), F.when(filled(c).isNotNull(), at)).alias(c) for c in ("state", "evidence")],
        F.array_distinct(F.flatten(ordered("actors", "late", "pos"))).alias("actors"),
    )
    return got.select("pathway_id", F.col("at.late").alias("late"), F.col("at.pos").alias("pos"), "inputs", "outputs", "state", "evidence", "actors")


def union_distinct(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows that are equal but for the order columns, once; the first stays."""
    body = [c for c in rows.columns if c not in (*keys, *order)]
    return first_per(rows.withColumn("_sig", F.to_json(F.struct(*body))), [*keys, "_sig"], *order).drop("_sig")


def first_filled(rows: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """For each column its first value that isn't blank, by an order."""
    filled = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return rows.groupBy(*keys).agg(*[F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def collapse_parts(outputs: DataFrame) -> DataFrame:
    """Outputs (``pathway_id, process, entity``) without those that are parts of a complex among them."""
    parts = outputs.where(F.contains("entity", F.lit(":"))).select("pathway_id", "process", F.explode(N.complex_parts(F.col("entity"))).alias("part"))
    named = outputs.withColumn("_n", N.norm(F.col("entity")))
    gone = parts.select("pathway_id", "process", N.norm(F.col("part")).alias("_n")).distinct()
    return named.join(gone, ["pathway_id", "process", "_n"], "left_anti").drop("_n")


def best_candidates(candidates: DataFrame, keys: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Candidates (``keys, ids MAP, confidence, origin``) of equal id sets as one of the greatest confidence, clamped;
    ``rn`` orders them by confidence, those of origin ``db`` first."""
    from pathloom.operators.tables import numbered

    clamped = candidates.withColumn("confidence", F.least(F.greatest("confidence", F.lit(low)), F.lit(high)))
    same = clamped.withColumn("ids_key", F.to_json(F.array_sort(F.map_entries("ids"))))
    best = same.groupBy(*keys, "ids_key").agg(F.max("confidence").alias("confidence"), F.min(F.when(F.col("origin") == "db", "db").otherwise("other")).alias("origin"))
    return numbered(best, keys, F.desc("confidence"), "origin", "ids_key")


def organism(species: DataFrame, states: DataFrame) -> DataFrame:
    """Per pathway: the only species named, else the only one among the states, else ''."""
    a = species.groupBy("pathway_id").agg(F.count("name").alias("n"), F.max("name").alias("one"))
    b = states.where("coalesce(species, '') <> ''").groupBy("pathway_id").agg(F.count_distinct("species").alias("m"), F.max("species").alias("other"))
    return a.join(b, "pathway_id", "full").select("pathway_id", F.when(F.col("n") == 1, F.col("one")).when(F.col("m") == 1, F.col("other")).otherwise("").alias("organism"))


def merge_sources(blocks: DataFrame, keys: list[str], scalars: list[str], order: tuple[str, ...] = ("chebi", "pubchem", "hmdb", "kegg")) -> DataFrame:
    """Catalogue blocks (``keys, source, ok, synonyms, scalars``) as one: each scalar from the first source in order that
    is ok and has one (zero is none); synonyms united; a status."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    ranked = blocks.withColumn("_r", F.when(rank > 0, rank).otherwise(len(order) + 1))
    value = lambda c: F.when(F.col("ok") & (F.trim(F.col(c).cast("string")) != "") & (F.col(c).cast("string").rlike("^0+(\\.0*)?$") == F.lit(False)), F.col(c))
    got = ranked.groupBy(*keys).agg(*[F.min_by(value(c), F.when(value(c).isNotNull(), F.struct("_r", F.col(c).cast("string")))).alias(c) for c in scalars], F.count_if("ok").alias("good"), F.count("*").alias("n"))
    names = ranked.where("ok").select(*keys, "_r", F.posexplode("synonyms").alias("i", "s")).withColumn("k", N.fold(N.canonical(F.col("s")))).where("k <> ''")
    one = names.groupBy(*keys, "k").agg(F.min_by("s", F.struct("_r", "i")).alias("s"), F.min(F.struct("_r", "i")).alias("at"))
    syn = one.groupBy(*keys).agg(ordered("s", "at", "k").alias("synonyms"))
    status = F.when(F.col("good") == 0, "error").when(F.col("good") < F.col("n"), "ok_with_warnings").otherwise("ok")
    return got.join(syn, keys, "left").select(*keys, *scalars, F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), status.alias("status"))


def best_repair(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate of fewest errors, warnings, source errors, rejected patches, most accepted ones, fewest patches."""
    return first_per(candidates.withColumn("_acc", -F.col("accepted")), keys, "errors", "warnings", "source_errors", "rejected", "_acc", "patches", "candidate").drop("_acc")


def merge_issues(own: DataFrame, other: DataFrame) -> DataFrame:
    """Issues of two origins; an error of the other without a path becomes a warning that says so."""
    a = own.select("pathway_id", "severity", "path", "reason", F.coalesce("source", F.lit("deterministic")).alias("source"))
    vague = (F.col("severity") == "error") & ~F.coalesce(F.col("path").startswith("/"), F.lit(False))
    b = other.select("pathway_id", F.when(vague, "warning").otherwise(F.col("severity")).alias("severity"), "path", F.when(vague, F.concat(F.lit("[no path] "), "reason")).otherwise(F.col("reason")).alias("reason"), F.coalesce("source", F.lit("model")).alias("source"))
    return a.unionByName(b)


def attempts_summary(attempts: DataFrame, keys: list[str], shown: int = 40) -> DataFrame:
    """Of the attempts with an error: how many, the last one's error, length, beginning and end, and whether it looks cut off."""
    bad = attempts.where("error is not null")
    last = bad.groupBy(*keys).agg(F.count("*").alias("failed"), F.max_by(F.struct("raw", "error"), F.struct("attempt", "error")).alias("r"))
    raw = F.col("r.raw")
    return last.select(*keys, "failed", F.col("r.error").alias("error"), F.length(raw).alias("raw_length"), F.substring(raw, 1, shown).alias("head"), F.right(raw, F.lit(shown)).alias("tail"), F.col("r.error").rlike("(?i)unterminated|expecting|delimiter|end of").alias("truncated"))


def token_costs(attempts: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens in and out, and their cost by ``prices(kind, per_million)``."""
    both = attempts.join(prices, "kind", "left")
    return both.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") * F.coalesce("per_million", F.lit(0.0)) / 1_000_000), 6).alias("cost"))


def stage_counts(rows: DataFrame, keys: list[str], status: str, statuses: tuple[str, ...]) -> DataFrame:
    """Rows, rows of each status, and the share of the first in percent (0 of none)."""
    hits = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    got = rows.groupBy(*keys).agg(F.count("*").alias("total"), *hits)
    return got.withColumn("percent", F.when(F.col("total") > 0, F.round(100 * F.col(statuses[0]) / F.col("total"), 2)).otherwise(0.0))


def payload_hashes(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """A hash of each key's rows, whatever their order; equal rows count as often as they come."""
    return rows.groupBy(*keys).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))), 256).alias("hash"))


def stop_reasons(rounds: DataFrame, max_rounds: int) -> DataFrame:
    """Per pathway the first round (``round, hash, issues``) at which repair stops, and why: clean, a payload seen
    before, no fewer issues than the round before, or the last round."""
    from pyspark.sql import Window

    w = Window.partitionBy("pathway_id").orderBy("round")
    seen = F.array_contains(F.collect_list("hash").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("hash"))
    why = F.when(F.col("issues") == 0, "clean").when(seen, "repeated_payload").when(F.lag("issues").over(w) <= F.col("issues"), "stalled").when(F.col("round") >= max_rounds, "max_rounds")
    return first_per(rounds.withColumn("reason", why).where("reason is not null").select("pathway_id", "round", "reason"), ["pathway_id"], "round")
