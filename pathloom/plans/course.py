"""From payload documents to model tables: audit and repair in rounds, the normalisation, lookup of names, export, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import names as N
from pathloom.operators import audit, export, integrity, linking, merge
from pathloom.operators.tables import numbered
from pathloom.plans.durable import durable, tidy
from pathloom.plans.lifecycle import normalise
from pathloom.plans.repairs import repair
from pathloom.sources import models, payload

MAX_ROUNDS = 4
#: Transports are numbered from here on, reactions below.
TRANSPORTS = 1 << 30


def shredded(texts: DataFrame) -> dict[str, DataFrame]:
    """Tables of the documents ``(id, json)`` that are objects."""
    p = durable(payload.parse(texts).where("is_object").select(F.col("id").alias("pathway_id"), "payload.entities", "payload.processes", "payload.element_locations", "payload.biological_states"))
    parts = payload.participants(p).withColumn("role", F.when(F.col("role") == "enzyme", "modifier").otherwise(F.col("role")))
    rx = p.select("pathway_id", F.posexplode("processes.reactions").alias("process", "r")).select("pathway_id", "process", F.col("process").alias("pos"), "r.name", "r.inputs", "r.outputs", F.col("r.biological_state").alias("state"), "r.evidence")
    empty = F.array().cast("array<string>")
    number = F.col("process") + F.when(F.col("process_kind") == "transport", TRANSPORTS).otherwise(0)
    moves = p.select("pathway_id", F.posexplode("processes.transports").alias("pos", "t"))
    acts = p.select("pathway_id", F.posexplode("processes.interactions").alias("pos", "i"))
    return {
        "payloads": p.select("pathway_id"),
        "entities": durable(payload.entities(p).select("pathway_id", "kind", F.col("pos").cast("long").alias("pos"), "name")),
        "participants": durable(parts.where("process_kind in ('reaction', 'transport') and trim(coalesce(entity, '')) <> ''").select("pathway_id", number.alias("process"), "role", "pos", "entity")),
        "reactions": durable(rx.withColumns({"inputs": F.coalesce("inputs", empty), "outputs": F.coalesce("outputs", empty)})),
        "transports": durable(moves.select("pathway_id", (F.col("pos") + TRANSPORTS).alias("process"), "pos", "t.name", "t.cargo", F.col("t.from_biological_state").alias("from_state"), F.col("t.to_biological_state").alias("to_state"), "t.evidence")),
        "interactions": durable(acts.select("pathway_id", "pos", "i.entity_1", "i.relationship", "i.entity_2")),
        "coupled": p.select("pathway_id", F.posexplode("processes.reaction_coupled_transports").alias("pos", "c")).select("pathway_id", "pos", "c.name", "c.reaction", "c.transport"),
        "states": payload.states(p).select("pathway_id", F.col("pos").cast("long").alias("pos"), "name", F.col("subcellular_location").alias("place")),
        "locations": payload.locations(p).select("pathway_id", "kind", F.col("pos").cast("long").alias("pos"), "entity", "state", "evidence"),
    }


def _judged(t: dict[str, DataFrame], offered: DataFrame) -> DataFrame:
    noop = t["reactions"].select("pathway_id", N.pointer(F.lit("processes"), F.lit("reactions"), F.col("pos")).alias("path"), merge.noop_object(F.col("inputs"), F.col("outputs")).alias("is_noop"))
    return durable(audit.accepted(offered, noop))


def repaired(t: dict[str, DataFrame], max_rounds: int = MAX_ROUNDS, given: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame, DataFrame | None]:
    """The tables after patches ``given`` (as :func:`audit.normal_patches` makes them) and rounds of audit and accepted patches,
    until a round has none to apply; the rounds ``(pathway_id, round, hash, issues)``; and what became of each patch
    ``(pathway_id, round, seq, op, path, applied, reason)``, in round -1 those given. A patch that can't be applied is a rejected one."""
    log, rounds = None, None

    def patched(t, judged, n):
        nonlocal log
        t, went = repair(t, judged.where("accepted"), n + 1)
        told = judged.select("pathway_id", F.lit(n).alias("round"), "seq", "op", "path", F.col("reason").alias("_why")).join(went, ["pathway_id", "seq"], "left")
        told = durable(told.select("pathway_id", "round", "seq", "op", "path", F.coalesce("applied", F.lit(False)).alias("applied"), F.coalesce("reason", "_why").alias("reason")))
        log = told if log is None else log.unionByName(told)
        return t

    if given is not None:
        known = given.join(t["payloads"], "pathway_id", "left_semi").select("pathway_id", F.col("seq").cast("long").alias("seq"), "op", "path", "value", "confidence", "evidence")
        t = patched(t, _judged(t, known), -1)
    # actors that no registry has are proteins; what else is missing, the audit's patches add
    lost = integrity.missing_entities(t["participants"].where("role in ('modifier', 'transporter')"), t["entities"])
    ents = t["entities"].unionByName(lost.select("pathway_id", F.lit("protein").alias("kind"), F.lit(1_000_000).cast("long").alias("pos"), "name"))
    t = {**t, "entities": durable(numbered(ents, ["pathway_id", "kind"], "pos", "name").select("pathway_id", "kind", (F.col("rn") - 1).cast("long").alias("pos"), "name"))}
    plural = F.create_map(*[F.lit(x) for key, kind in payload.KINDS.items() for x in (kind, key)])
    for n in range(max_rounds):
        ents, used, rx = t["entities"], t["participants"], t["reactions"]
        found = durable(audit.unknown_names(used, ents).unionByName(audit.identical_sides(rx)).unionByName(audit.missing_sides(rx)).unionByName(audit.unnamed(ents.withColumn("kind", plural[F.col("kind")]))))
        now = merge.payload_hashes(ents, ["pathway_id"], "kind", "name").join(found.groupBy("pathway_id").agg(F.count("*").alias("issues")), "pathway_id", "left").select("pathway_id", F.lit(n).alias("round"), "hash", F.coalesce("issues", F.lit(0)).alias("issues"))
        rounds = durable(now if rounds is None else rounds.unionByName(now))
        # an audit's indices are those of the lists that it saw, so removals come last, from a list's end on
        removal = F.col("op") == "remove"
        offered = numbered(found.where("op is not null"), ["pathway_id"], removal, F.when(removal, -F.regexp_extract("patch_path", r"(\d+)$", 1).try_cast("long")), "path", "rule", name="seq").select("pathway_id", F.col("seq").cast("long").alias("seq"), "op", F.col("patch_path").alias("path"), "value", "confidence", F.col("reason").alias("evidence"))
        judged = _judged(t, offered)
        if judged.where("accepted").isEmpty():
            break
        t = patched(t, judged, n)
        tidy(judged.sparkSession)
    return t, rounds, log


def _mapped(entities: DataFrame, kind: str, catalogue: DataFrame) -> DataFrame:
    names = entities.where(F.col("kind") == kind).select("name").distinct()
    weights, limits = {"compound": (linking.COMPOUND, (0.9, 0.74, 0.03)), "protein": (linking.PROTEIN, (0.88, 0.72, 0.03, None, 0.68))}[kind]
    return durable(linking.choose(linking.candidates(names, catalogue, weights), ["name"], *limits).select(F.lit(kind).alias("kind"), "name", "id", "score", "second", "status"))


def model(texts: DataFrame, catalogue: DataFrame, max_rounds: int = MAX_ROUNDS, proteins: DataFrame | None = None, given: DataFrame | None = None) -> dict[str, DataFrame]:
    """Payload texts ``(id, json)``, a catalogue ``(id, name, short_name, synonyms)`` of compounds and one of ``proteins`` (with
    ``accession``), patches ``given`` → ``rounds`` and why each pathway's ended (``stops``), what became of ``patches``, the normalised
    tables, ``mapped`` names by kind, ``compartments``, ``species``, ``references``, ``metrics``, ``stages`` (``stage, n``: rows that came out of each)."""
    raw = shredded(texts)
    tidy(texts.sparkSession)
    fixed, rounds, log = repaired(raw, max_rounds, given)
    done = normalise(fixed["entities"], fixed["reactions"].drop("inputs", "outputs"), fixed["participants"], fixed["states"].drop("pos"), locations=fixed["locations"].drop("kind"), transports=fixed["transports"].drop("name", "cargo"), interactions=fixed["interactions"])
    mapped = _mapped(done["entities"], "compound", catalogue)
    if proteins is not None:
        others = _mapped(done["entities"], "protein", proteins)
        if mapped.schema["id"].dataType != others.schema["id"].dataType:
            mapped, others = (x.withColumn("id", F.col("id").cast("string")) for x in (mapped, others))
        mapped = mapped.unionByName(others)
    tidy(texts.sparkSession)
    places = integrity.primary_places(done["locations"].select("pathway_id", "entity", "pos", "state"), done["states"])
    comps, spec, refs = export.model_tables(done["entities"], done["participants"], places)
    comps, refs = durable(comps), durable(refs)
    # a name that is both goes by its kind of first rank
    kinds = integrity.resolve_kinds(spec.select("pathway_id", "id", F.col("name").alias("entity")), done["entities"]).select("pathway_id", "id", "kind")
    spec = durable(spec.join(kinds, ["pathway_id", "id"]).join(mapped.where("status = 'mapped'").select("kind", "name", F.col("id").alias("ref_id")), ["kind", "name"], "left").drop("kind"))
    tidy(texts.sparkSession)
    rx = done["processes"].select("pathway_id", F.col("process").alias("id"))
    metrics = durable(export.model_metrics(spec, rx, comps, refs, rx.limit(0)))
    sizes = {"payloads": raw["payloads"], "reactions_read": raw["reactions"], "entities_read": raw["entities"], "entities_repaired": fixed["entities"], "reactions_normalised": done["processes"], "species": spec, "references": refs}
    stages = None
    for stage, df in sizes.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "n")
        stages = one if stages is None else stages.unionByName(one)
    return {**done, "coupled": raw["coupled"], "rounds": rounds, "patches": log, "stops": merge.stop_reasons(rounds, max_rounds), "mapped": mapped, "compartments": comps, "species": spec, "references": refs, "metrics": metrics, "stages": stages}


def documents(made: dict[str, DataFrame]) -> DataFrame:
    """An XML text for each pathway that the gates let through; a transport is a reaction of its cargo with the transporters as modifiers."""
    # what a gate stops is in the tables and told in the issues, but isn't exported
    good = made["passed"].select("pathway_id").distinct()
    let = lambda k: made[k].join(good, "pathway_id", "left_semi")
    at = lambda df: df.withColumn("pos", F.substring("id", 2, 20).cast("long"))
    sides = F.when(F.col("role") == "cargo", F.array(F.lit("reactant"), F.lit("product"))).when(F.col("role") == "transporter", F.array(F.lit("modifier"))).otherwise(F.array("role"))
    refs = let("references").withColumn("reaction", F.concat(F.lit("r"), "process"))
    rxns = refs.groupBy("pathway_id", F.col("reaction").alias("id")).agg(F.min("process").alias("pos")).withColumn("name", F.col("id"))
    refs = refs.select("pathway_id", "reaction", F.explode(sides).alias("role"), F.substring("species", 2, 20).cast("long").alias("pos"), "species", F.lit(1.0).alias("stoichiometry"))
    return models.documents(at(let("compartments")), at(let("species")), rxns, refs)
