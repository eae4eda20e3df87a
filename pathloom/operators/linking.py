"""Linking names to reference catalogues: blocked candidate joins, scores, and the choice among candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.operators.tables import first_per, numbered
from pathloom.plans.durable import durable
from pathloom.plans.skew import salted_join

COMPOUND = {"synonym": 0.84, "jaccard": 0.55}
PROTEIN = {"synonym": 0.83, "jaccard": 0.52, "species": 0.14, "accession": 0.08, "relaxed": 0.02}


def ground(entities: DataFrame, dictionary: DataFrame, fields: list[str]) -> DataFrame:
    """``entities(section, name, fields…)`` with blanks filled from ``dictionary``; ``matched``, and ``added`` fields."""
    d = first_per(dictionary.select("section", N.norm(F.col("name")).alias("_n"), *[F.col(f).alias(f"_{f}") for f in fields]), ["section", "_n"], *[f"_{f}" for f in fields]).withColumn("_m", F.lit(True))
    got = entities.withColumn("_n", N.norm(F.col("name"))).join(d, ["section", "_n"], "left")
    blank = lambda f: F.nullif(F.trim(F.col(f)), F.lit("")).isNull()
    adds = [(blank(f) & ~F.coalesce(F.trim(f"_{f}") == "", F.lit(True))).cast("int") for f in fields]
    total = adds[0]
    for a in adds[1:]:
        total = total + a
    return got.withColumn("added", total).withColumns({f: F.when(blank(f), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).withColumn("matched", F.col("_m").isNotNull()).drop("_n", "_m", *[f"_{f}" for f in fields])


def _grams(c: Column, shortest: int = 2) -> Column:
    n = F.length(c)
    gram = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[gram(k) for k in range(3, shortest - 1, -1)]))


#: One of so many texts tells which grams are rare; rows and letters of terms, and grams, that may be broadcast; bits of the filter.
DRAW, GIVEN_TERMS, GIVEN_LETTERS, GIVEN_GRAMS, FILTER_BITS = 64, 1_000_000, 16_000_000, 1_000_000, 1 << 26
#: Terms of a key that are held against each of its texts as they are; that is less work than a text's grams. And terms of all such keys that may be broadcast.
FEW, GIVEN_FEW = 64, 100_000


def containing(terms: DataFrame, texts: DataFrame, keys: tuple[str, ...] = (), shortest: int = 2) -> DataFrame:
    """``keys, term, id`` wherever a text (``keys, id, text``) contains a term of the same keys, of ``shortest`` characters or
    more, both lower-cased.

    A text that contains a term holds all its 3-grams (shorter ones, if it is shorter), so it is enough to look the term up
    by any one of them; a draw of texts tells which of them is rare, and decides on nothing else. Terms of ``GIVEN_TERMS`` rows
    and ``GIVEN_LETTERS`` letters at most go to the texts, which then never move. Beyond that, grams that are no term's are kept
    from the shuffle by a Bloom filter of ``FILTER_BITS`` bits, whatever the number of terms; the texts of the candidates alone
    are fetched, and a common gram is dealt to several tasks. Under keys with ``FEW`` terms at most, texts meet the terms themselves."""
    k = list(keys)
    low = texts.select(*k, "id", F.lower("text").alias("text")).where("text <> ''")
    asked = terms.select(*k, F.lower("term").alias("term")).where(F.length("term") >= shortest)
    if not k:
        return _by_grams(asked, low, k, shortest)
    asked = durable(asked.distinct())
    sizes = durable(asked.groupBy(*k).agg(F.count("*").alias("n")))
    n = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") <= FEW, F.col("n"))), F.lit(0)).alias("few"), F.count_if(F.col("n") > FEW).alias("long")).first()
    of = lambda which: sizes.where(which).select(*k)
    few = asked.join(of(F.col("n") <= FEW), k, "left_semi") if n["long"] else asked
    few = F.broadcast(few) if n["few"] <= GIVEN_FEW else few.hint("merge")  # compressed tables are sized too low
    met = low.join(few, k).where(F.contains("text", F.col("term"))).select(*k, "term", "id").distinct()
    if not n["long"]:
        return met
    many = of(F.col("n") > FEW)
    return met.unionByName(_by_grams(asked.join(many, k, "left_semi"), low.join(many, k, "left_semi"), k, shortest))


def _by_grams(terms: DataFrame, low: DataFrame, k: list[str], shortest: int) -> DataFrame:
    probe = durable(_by_rare_gram(terms, low, k, shortest))
    size = probe.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("letters")).first()
    grams = low.select(*k, "id", "text", F.explode(_grams(F.col("text"), shortest)).alias("gram"))
    if size["n"] <= GIVEN_TERMS and size["letters"] <= GIVEN_LETTERS:
        met = grams.join(F.broadcast(probe), [*k, "gram"])
        return met.where(F.contains("text", F.col("term"))).select(*k, "term", "id").distinct()
    low = low.distinct().withColumn("th", F.xxhash64("text"))
    index = low.select(*k, "id", "th", F.explode(_grams(F.col("text"), shortest)).alias("gram")).where(_among(probe, F.xxhash64(*k, "gram"))).hint("merge")  # exploded rows are sized as few as the texts
    # within keys a gram is held by few; to give millions of terms sixteen times would be most of the shuffle
    met = (index.join(probe, [*k, "gram"]) if k else salted_join(index, probe, ["gram"], salts=16)).select(*k, "term", "id", "th")
    return met.join(low, [*k, "id", "th"]).where(F.contains("text", F.col("term"))).select(*k, "term", "id").distinct()


def _by_rare_gram(terms: DataFrame, low: DataFrame, k: list[str], shortest: int) -> DataFrame:
    """Each term with the one of its grams that fewest drawn texts hold."""
    drawn = low.where(F.pmod(F.xxhash64("text"), F.lit(DRAW)) == 0)
    held = durable(drawn.select(F.explode(_grams(F.col("text"), shortest)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")))
    if held.count() <= GIVEN_GRAMS:
        held = F.broadcast(held)
    # the gram is chosen once for a term, whatever keys it stands under
    own = terms.select("term").distinct().select("term", F.explode(F.filter(_grams(F.col("term"), shortest), lambda g: F.length(g) == F.least(F.length("term"), F.lit(3)))).alias("gram"))
    rare = first_per(own.join(held, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))), ["term"], "n", "gram").select("term", "gram")
    return (terms.select(*k, "term").distinct().join(rare, "term") if k else rare).select(*k, "term", "gram")


def _among(probe: DataFrame, h: Column) -> Column:
    """Whether a hash may be one of the probes' keys and grams: a Bloom filter of two bits a gram, as a bitmap of fixed size."""
    keys = [c for c in probe.columns if c != "term"]
    places = lambda x: F.array(F.pmod(x, F.lit(FILTER_BITS)), F.pmod(F.shiftright(x, 27), F.lit(FILTER_BITS)))
    bits = probe.select(F.explode(places(F.xxhash64(*keys))).alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    table[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    given = probe.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may(one: pd.Series, two: pd.Series) -> pd.Series:
        a, b = one.to_numpy(), two.to_numpy()
        return pd.Series((given.value[a >> 6] >> (a & 63)) & (given.value[b >> 6] >> (b & 63)) & 1 == 1)

    return may(places(h)[0], places(h)[1])


def lookups(names: DataFrame) -> DataFrame:
    """``name, term, penalty``: the search terms of a name's variants; each term at its least penalty."""
    v = names.select("name").distinct().select("name", F.posexplode(N.variants(F.col("name"))).alias("v", "variant"))
    t = v.select("name", "v", F.posexplode(N.search_terms(F.col("variant"), 5)).alias("t", "term"))
    return t.groupBy("name", F.lower("term").alias("term")).agg(F.min(0.06 * F.col("v") + 0.03 * F.col("t")).alias("penalty"))


def candidates(names: DataFrame, catalogue: DataFrame, weights: dict, other: str = "short_name", species: DataFrame | None = None) -> DataFrame:
    """``name, id, score`` of the catalogue's entries (``id, name, <other>, synonyms``) that a search term of a name
    finds in their names or synonyms. ``species(name, species_id)`` raises entries of a name's species."""
    texts = catalogue.select("id", F.explode(F.array("name", F.coalesce(other, F.lit("")), F.coalesce("synonyms", F.lit("")))).alias("text"))
    terms = lookups(names)
    found = terms.join(containing(terms, texts), "term").groupBy("name", "id").agg(F.min("penalty").alias("penalty"))
    both = found.join(catalogue.withColumnRenamed("name", "c_name"), "id")
    n, a, b = F.col("name"), F.col("c_name"), F.coalesce(F.col(other), F.lit(""))
    syn = N.synonyms(F.coalesce(F.col("synonyms"), F.lit("")), limit=60)
    norm = N.norm(n)
    exact = (norm == N.norm(a)) | (norm == N.norm(b))
    alike = F.greatest(N.jaccard(N.tokens(n), N.tokens(a)), N.jaccard(N.tokens(n), N.tokens(b)), N.jaccard(N.punctuated_tokens(n), N.punctuated_tokens(a)), N.jaccard(N.punctuated_tokens(n), N.punctuated_tokens(b)), F.coalesce(F.array_max(F.transform(syn, lambda s: N.jaccard(N.tokens(n), N.tokens(s)))), F.lit(0.0)))
    bonus = lambda cond, w: F.when(cond, w).otherwise(0.0)
    score = bonus(exact, 0.9) + bonus(F.exists(syn, lambda s: N.norm(s) == norm), weights["synonym"]) + bonus((norm != "") & (F.contains(N.norm(a), norm) | F.contains(N.norm(b), norm)), 0.08) + 0.35 + weights["jaccard"] * alike
    if "accession" in weights:
        score = score + bonus(F.coalesce(F.trim("accession"), F.lit("")) != "", weights["accession"])
    if species is not None:
        s = species.select("name", "species_id").distinct().withColumn("_s", F.lit(True))
        both = both.join(s, ["name", "species_id"], "left").join(s.select("name").distinct().withColumn("_any", F.lit(True)), "name", "left")
        # without the filter an entry of another species is found by the relaxed pass alone
        score = score + bonus(F.col("_s"), weights["species"]) - bonus(F.col("_any") & F.col("_s").isNull(), weights["relaxed"])
    return both.select("name", "id", F.round(F.least(F.greatest(score - F.col("penalty"), F.lit(0.0)), F.lit(1.0)), 4).alias("score"))


def choose(scored: DataFrame, keys: list[str], top: float, least: float, margin: float, usable: Column | None = None, alone: float | None = None) -> DataFrame:
    """The best candidate (by score, then id) of each key, ``second`` score, and the status: ``mapped`` if it is at least
    ``top``, or at least ``least`` and ahead by ``margin`` (or the only one and at least ``alone``)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("score", 1, 0.0).over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("rn = 1").drop("rn")
    ok = (F.col("score") >= top) | ((F.col("score") >= least) & (F.round(F.col("score") - F.col("second"), 6) >= margin))
    if alone is not None:
        ok = ok | ((F.col("n") == 1) & (F.col("score") >= alone))
    has = F.lit(True) if usable is None else usable
    return ranked.withColumn("status", F.when(has & ok, "mapped").when(has, "ambiguous").otherwise("no_external_ids"))


def top_candidates(scored: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    return numbered(scored, keys, F.desc("score"), "id").where(F.col("rn") <= n)


def species_of(organisms: DataFrame, species: DataFrame, most: int = 6) -> DataFrame:
    """``organism, id``: species (``id, name, common_name, taxonomy_id``) that an organism's text names, the best six at most."""
    texts = species.select("id", F.explode(F.array("name", F.coalesce("common_name", F.lit("")), F.coalesce("taxonomy_id", F.lit("")))).alias("text"))
    plain = organisms.select("organism", N.plain(F.col("organism")).alias("term")).where("term <> ''").distinct()
    found = plain.withColumn("low", F.lower("term")).join(containing(plain, texts).withColumnRenamed("term", "low"), "low").join(species, "id")
    t, n, c = F.col("term"), F.col("name"), F.coalesce("common_name", F.lit(""))
    tax = t == F.coalesce("taxonomy_id", F.lit(""))
    meant = F.contains(F.lower(n), F.col("low")) | F.contains(F.lower(c), F.col("low")) | tax
    score = F.greatest(F.when(N.norm(t) == N.norm(n), 1.0).otherwise(0.0), F.when(N.norm(t) == N.norm(c), 0.95).otherwise(0.0), F.when(tax, 0.98).otherwise(0.0), 0.45 + 0.5 * N.jaccard(N.tokens(t), N.tokens(n)), 0.42 + 0.5 * N.jaccard(N.tokens(t), N.tokens(c)))
    scored = found.where(meant).select("organism", "id", F.round(score, 4).alias("score"))
    best = scored.join(scored.groupBy("organism").agg(F.max("score").alias("top")), "organism").where(F.col("score") >= F.greatest(F.lit(0.7), F.round(F.col("top") - 0.08, 6)))
    return numbered(best, ["organism"], F.desc("score"), "id").where(F.col("rn") <= most).select("organism", "id", "score")


def from_catalogues(hits: DataFrame, enough: float = 0.92, ahead: float = 0.12) -> DataFrame:
    """Hits of several catalogues (``name, v, db, ext, score``; v numbers the name's variants) as ``name, db, ext, score``: each
    weighted by its variant, the most of each id. Variants after one whose best is ``enough`` and ``ahead`` aren't asked."""
    weighted = hits.select("name", "v", "db", "ext", F.round(F.col("score") * F.greatest(F.lit(0.8), 1 - 0.08 * F.col("v")), 6).alias("score"))
    # an id counts once a variant, however often it was hit
    weighted = weighted.groupBy("name", "v", "db", "ext").agg(F.max("score").alias("score"))
    # the best two ids after each variant: every id at the most it has had so far
    steps = weighted.select("name", "v").distinct()
    sofar = steps.alias("s").join(weighted.alias("w"), F.expr("s.name = w.name and w.v <= s.v")).groupBy(F.col("s.name").alias("name"), F.col("s.v").alias("v"), "db", "ext").agg(F.max("score").alias("score"))
    two = numbered(sofar, ["name", "v"], F.desc("score"), "db", "ext").where("rn <= 2").groupBy("name", "v").agg(F.max("score").alias("best"), F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    stop = two.where((F.col("best") >= enough) & (F.round(F.col("best") - F.col("second"), 6) >= ahead)).groupBy("name").agg(F.min("v").alias("stop"))
    return weighted.join(stop, "name", "left").where(F.col("stop").isNull() | (F.col("v") <= F.col("stop"))).groupBy("name", "db", "ext").agg(F.max("score").alias("score"))


def accept_catalogues(scored: DataFrame) -> DataFrame:
    """The accepted id of each name (0.78 at least, 0.08 ahead), and ids of other catalogues that score 0.9 or more."""
    best = choose(scored.withColumn("id", F.concat_ws(":", "db", "ext")), ["name"], 2.0, 0.78, 0.08)
    others = scored.where("score >= 0.9").groupBy("name", "db").agg(F.max_by("ext", F.struct("score", "ext")).alias("x"))
    rest = best.where("status = 'mapped'").select("name", F.col("db").alias("own")).join(others, "name").where("db <> own").groupBy("name").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "db", "x"))), "|").alias("others"))
    return best.join(rest, "name", "left").select("name", "db", "ext", "score", "status", F.coalesce("others", F.lit("")).alias("others"))


def accession_candidates(names: DataFrame, catalogue: DataFrame, organism: Column) -> DataFrame:
    """``name, id, score, reviewed`` of an accession catalogue (``id, full_name, organism, reviewed``): by name, organism,
    and whether the entry is reviewed."""
    found = lookups(names).join(containing(lookups(names), catalogue.select("id", F.col("full_name").alias("text"))), "term").select("name", "id").distinct()
    both = found.join(catalogue, "id").join(names.select("name", organism.alias("wanted")).distinct(), "name")
    exact = N.norm(F.col("name")) == N.norm(F.col("full_name"))
    score = F.when(exact, 0.55).otherwise(0.35 * N.jaccard(N.tokens(F.col("name")), N.tokens(F.col("full_name"))))
    w, o = N.norm(F.col("wanted")), N.norm(F.coalesce("organism", F.lit("")))
    score = score + F.when(F.coalesce(w, F.lit("")) == "", -0.04).when(w == o, 0.25).when(F.contains(o, w) | ((o != "") & F.contains(w, o)), 0.15).otherwise(0.0) + F.when(F.col("reviewed"), 0.05).otherwise(0.0)
    return both.select("name", "id", F.round(score, 4).alias("score"), "reviewed")


def accept_accession(scored: DataFrame) -> DataFrame:
    got = choose(scored, ["name"], 2.0, 0.78, 0.08)
    return got.withColumn("status", F.when((F.col("status") != "mapped") & F.col("reviewed") & (F.col("score") >= 0.74) & (F.round(F.col("score") - F.col("second"), 6) >= 0.06), "mapped").otherwise(F.col("status")))


def location_candidates(entities: DataFrame, locations: DataFrame, states: DataFrame, places: DataFrame, most: int = 6) -> DataFrame:
    """``entity, place, n``: where a reference places an entity (by id), the most frequent places first."""
    got = entities.join(locations, "ref_id").join(states, "state_id").join(places, "place_id").groupBy("entity", "place").agg(F.count("*").alias("n"))
    return numbered(got, ["entity"], F.desc("n"), "place").where(F.col("rn") <= most)


def by_strategy(names: DataFrame, db: DataFrame, api: DataFrame, strategy: str = "db_then_api") -> DataFrame:
    """``names`` with the result (``name, ids, status``) of the first source in the strategy that maps it, else of its first source."""
    order = {"db_then_api": ["db", "api"], "api_then_db": ["api", "db"], "db_only": ["db"], "api_only": ["api"], "skip": []}[strategy]
    got = names
    for s in order:
        got = got.join({"db": db, "api": api}[s].select("name", F.col("ids").alias(f"{s}_ids"), F.col("status").alias(f"{s}_status")), "name", "left")
    if not order:
        return got.select("*", F.lit(None).cast("string").alias("ids"), F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("source"))
    source = F.lit(order[0])
    for s in reversed(order):
        source = F.when(F.col(f"{s}_status") == "mapped", s).otherwise(source)
    pick = lambda what: F.coalesce(*[F.when(source == s, F.col(f"{s}_{what}")) for s in order])
    return got.select(*names.columns, pick("ids").alias("ids"), F.coalesce(pick("status"), F.lit("unmapped")).alias("status"), source.alias("source"))


def mapping_log(entities: DataFrame, mapped: DataFrame, protein_like: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """One row per registry entry: its route, status and reason, ids, places. Complexes are skipped.
    ``mapped(name, route, ids, status)``, ``protein_like(pathway_id, name)``."""
    known = protein_like.select("pathway_id", N.norm(F.col("name")).alias("_n")).distinct().withColumn("_k", F.lit(True))
    routed = entities.withColumn("_n", N.norm(F.col("name"))).join(known, ["pathway_id", "_n"], "left").withColumn("_r", N.route(F.col("name"), F.col("kind"), F.col("_k"))).withColumn("route", F.col("_r.route")).withColumn("route_reason", F.col("_r.reason")).drop("_n", "_k", "_r")
    got = routed.join(mapped, ["name", "route"], "left")
    if places is not None:
        got = got.join(places.withColumnRenamed("entity", "name"), ["pathway_id", "name"], "left")
    return got.withColumn("status", F.when(F.col("route") == "complex", "skipped").otherwise(F.coalesce("status", F.lit("unmapped"))))


def flag_context(flags: DataFrame, candidates_: DataFrame, n: int = 3) -> DataFrame:
    """Flags (``pathway_id, flag, subject``) with their subject's first ``n`` candidates (``subject, id, score``) as a text."""
    best = top_candidates(candidates_, ["subject"], n)
    text = best.groupBy("subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat("id", F.lit(" ("), F.format_string("%.2f", "score"), F.lit(")")).alias("t")))), lambda s: s["t"]), "; ").alias("context"))
    return flags.join(text, "subject", "left").fillna("none", ["context"])


def with_cache(names: DataFrame, cache: DataFrame, compute) -> tuple[DataFrame, DataFrame]:
    """Results (``key, result``) of keys in the cache, and of the rest by ``compute``; and the counts of both."""
    wanted = names.select("key").distinct()
    hits = wanted.join(cache, "key")
    rest = compute(wanted.join(cache, "key", "left_anti"))
    done = hits.select("key", "result", F.lit("cache").alias("origin")).unionByName(rest.select("key", "result", F.lit("call").alias("origin")))
    return done, done.agg(F.count_if(F.col("origin") == "cache").alias("cache_hits"), F.count_if(F.col("origin") == "call").alias("calls"))


def cache_key(source: str, name: Column, organism: Column) -> Column:
    return F.concat_ws("::", F.lit(source), N.norm(name), N.norm(F.coalesce(organism, F.lit(""))))


def best_identifier(ids: Column) -> Column:
    """The first of a compound's ids that there is, by database."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(ids, F.lit(k))), F.lit("")) for k in ("hmdb", "chebi", "kegg", "pubchem", "drugbank")], F.lit("unmapped"))


def enrichment_dump(entities: DataFrame) -> DataFrame:
    """``key`` (kind, name, best id) and the last row of each key."""
    keyed = entities.withColumn("key", F.concat(F.col("kind"), F.lit(":"), "name", F.lit("|"), best_identifier(F.col("mapped_ids"))))
    return keyed.groupBy("key").agg(F.max_by("summary", "pos").alias("summary"), F.max("pos").alias("pos"))


def enrich(entities: DataFrame, catalogues: dict[str, DataFrame], normal: dict[str, object]) -> DataFrame:
    """``entities(id, mapped_ids)`` unpivoted by catalogue, joined by normalised id: ``id, source, ext, ok, synonyms, mass``."""
    out = None
    for source, cat in catalogues.items():
        ext = normal[source](F.try_element_at("mapped_ids", F.lit(source)))
        one = entities.select("id", F.lit(source).alias("source"), ext.alias("ext")).where("coalesce(ext, '') <> ''").join(cat.withColumn("ok", F.lit(True)), "ext", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        out = one if out is None else out.unionByName(one)
    return out


def fill_gaps(entities: DataFrame, id_candidates: DataFrame, place_candidates: DataFrame, organisms: DataFrame, default_place: str = "cell") -> DataFrame:
    """``entities(pathway_id, name, ext, state, organism)`` with blanks filled: the best id candidate, a state for the best
    place (named after it) or the default one, the pathway's organism."""
    ids = first_per(id_candidates.withColumn("less", -F.col("score")), ["name"], "less", "id").select("name", F.col("id").alias("_ext"))
    place = first_per(place_candidates.withColumn("less", -F.col("n")), ["name"], "less", "place").select("name", F.col("place").alias("_place"))
    got = entities.join(ids, "name", "left").join(place, "name", "left").join(organisms.withColumnRenamed("organism", "_org"), "pathway_id", "left")
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return got.select("pathway_id", "name", F.coalesce(blank("ext"), "_ext").alias("ext"), F.coalesce(blank("state"), F.concat(F.lit("AutoState_"), F.coalesce("_place", F.lit(default_place)))).alias("state"), F.coalesce(blank("organism"), "_org").alias("organism"))
