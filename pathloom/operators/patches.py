"""Patches applied in their order to the lists of payloads, held as tables.

The algebra: a list is kept as *runs*, stretches of its original elements or of those that a patch brought, each with the place
where it stands now. A patch cuts the run it hits and moves the places behind; its index is thus read as the list is at
that moment. A list's state is of the size of its patches, not of its elements, and folds in one expression. Rows take part
only at the end, when each looks up the run it ended in.

A patch fails, and changes nothing, if its index is none or out of range, if it replaces or removes what is not there, or if it
names a field or list that the table lacks. In tables what is null is not there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.plans.durable import durable

#: A list's runs are given once for so many of its rows, so that a long list's rows are dealt to several tasks.
ROWS_A_TASK = 100_000
_RUN = "struct<at:bigint,len:bigint,first:bigint,added:bigint>"
_STATE = f"struct<runs:array<{_RUN}>,n:bigint,there:boolean,log:array<struct<seq:bigint,first:bigint,added:bigint,why:string>>>"
#: ``added`` of an original element; those that a patch brought have its ``seq``.
ORIGINAL = -1


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _run(at: Column, size: Column, first: Column, added: Column) -> Column:
    return F.struct(at.alias("at"), size.alias("len"), first.alias("first"), added.alias("added")).cast(_RUN)


def _cut(runs: Column, i: Column, take: Column, shift: Column) -> Column:
    """Runs without the ``take`` elements from place ``i`` on, those behind moved by ``shift``."""

    def parts(r: Column) -> Column:
        within = lambda x: F.least(F.greatest(x - r["at"], _long(0)), r["len"])
        left, rest = within(i), within(i + take)
        return F.filter(F.array(_run(r["at"], left, r["first"], r["added"]), _run(r["at"] + rest + shift, r["len"] - rest, r["first"] + rest, r["added"])), lambda x: x["len"] > 0)

    return F.flatten(F.transform(runs, parts))


def folded(n: Column, there: Column, patches: Column) -> Column:
    """The state of a list of ``n`` elements after patches ``(seq, op, at, size)`` in order. Operations: ``add``, ``replace`` and
    ``remove`` of an element, ``touch`` of what is inside one, ``set`` (to ``size`` elements), ``reset`` (where there is a list) and ``unset``."""
    runs = F.filter(F.array(_run(_long(0), n, _long(0), _long(ORIGINAL))), lambda r: r["len"] > 0)
    start = F.struct(runs.alias("runs"), n.cast("long").alias("n"), there.alias("there"), F.array().cast("array<struct<seq:bigint,first:bigint,added:bigint,why:string>>").alias("log")).cast(_STATE)

    def step(s: Column, p: Column) -> Column:
        op = p["op"]
        whole = op.isin("set", "reset", "unset")
        brings = op.isin("add", "replace")
        i = F.when(op.isin("add") & (p["at"] == "-"), s["n"]).when(p["at"].rlike("^[0-9]{1,18}$"), p["at"].try_cast("long"))
        why = (
            F.when(op.isin("set", "reset") & p["size"].isNull(), "not_a_list").when(op == "set", F.lit(None).cast("string")).when(~s["there"], "no_such_list").when(whole, F.lit(None).cast("string"))
            .when(i.isNull(), "not_an_index").when(i >= s["n"] + (op == "add").cast("long"), "out_of_range")
        )
        hit = F.get(F.filter(s["runs"], lambda r: (r["at"] <= i) & (i < r["at"] + r["len"])), 0)
        seq = p["seq"].cast("long")
        took = F.when(op == "add", _long(0)).when(op == "touch", _long(0)).otherwise(_long(1))
        moved = F.when(op == "add", _long(1)).when(op == "remove", _long(-1)).otherwise(_long(0))
        new = F.when(brings, F.array(_run(i, _long(1), _long(0), seq))).otherwise(F.array().cast(f"array<{_RUN}>"))
        all_new = F.filter(F.array(_run(_long(0), F.coalesce(p["size"].cast("long"), _long(0)), _long(0), seq)), lambda r: (r["len"] > 0) & (op != "unset"))
        # what comes behind all others cuts and moves nothing
        after = F.when(whole, all_new).when(op == "touch", s["runs"]).when((op == "add") & (i >= s["n"]), F.concat(s["runs"], new)).otherwise(F.concat(_cut(s["runs"], i, took, moved), new))
        size = F.when(op == "unset", _long(0)).when(whole, F.coalesce(p["size"].cast("long"), _long(0))).otherwise(s["n"] + moved)
        entry = F.struct(seq.alias("seq"), F.when(brings, _long(0)).otherwise(hit["first"] + i - hit["at"]).alias("first"), F.when(brings, seq).otherwise(hit["added"]).alias("added"), why.alias("why"))
        ok = why.isNull()
        return F.struct(F.when(ok, after).otherwise(s["runs"]).alias("runs"), F.when(ok, size).otherwise(s["n"]).alias("n"), F.when(ok & whole, op != "unset").otherwise(s["there"]).alias("there"), F.concat(s["log"], F.array(entry)).alias("log")).cast(_STATE)

    return F.aggregate(patches, start, step)


def _in_order(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("seq", *fields)))


def _fields_of(json: str, fields: list[str], lists: list[str]) -> list[Column]:
    """A row from a JSON object."""
    return [F.get_json_object(json, f"$.{f}").alias(f) for f in fields] + [F.from_json(F.get_json_object(json, f"$.{f}"), "array<string>").alias(f) for f in lists]


def _cells(slots: DataFrame, base: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fields of rows after their patches in order, one column of ``(v)`` each, and how each patch went."""
    key = ["pathway_id", "first", "added"]
    first_value = F.coalesce(*[F.when(F.col("field") == f, F.col(f)) for f in fields])
    grouped = slots.groupBy(*key, "field").agg(_in_order("op", "value").alias("patches")).join(base.select(*key, *fields), key).withColumn("_v", first_value)

    def step(s: Column, p: Column) -> Column:
        ok = (p["op"] == "add") | s["v"].isNotNull()
        value = F.when(~ok, s["v"]).when(p["op"] == "remove", F.lit(None).cast("string")).otherwise(p["value"])
        why = F.when(~ok, "not_there")
        return F.struct(value.alias("v"), F.concat(s["log"], F.array(F.struct(p["seq"].cast("long").alias("seq"), why.alias("why")))).alias("log")).cast("struct<v:string,log:array<struct<seq:bigint,why:string>>>")

    start = F.struct(F.col("_v").cast("string").alias("v"), F.array().cast("array<struct<seq:bigint,why:string>>").alias("log"))
    done = grouped.withColumn("_state", F.aggregate("patches", start, step))
    done = durable(done.select(*key, "field", "_state"))
    wide = done.groupBy(*key).agg(*[F.max(F.when(F.col("field") == f, F.struct(F.col("_state.v").alias("v")))).alias(f"_{f}") for f in fields])
    return wide, done.select("pathway_id", F.inline("_state.log"))


def _inner(slots: DataFrame, base: DataFrame, lists: list[str]) -> tuple[DataFrame, DataFrame]:
    """As :func:`_cells`, of list-valued fields: patches to their elements or to the whole of them."""
    key = ["pathway_id", "first", "added"]
    given = F.when(F.col("inner").isNull(), F.from_json("value", "array<string>")).when(F.col("op") != "remove", F.array("value"))
    whole = F.when(F.col("op") == "add", "set").when(F.col("op") == "replace", "reset").otherwise("unset")
    p = slots.withColumns({"given": given, "kind": F.when(F.col("inner").isNull(), whole).otherwise(F.col("op"))}).withColumn("size", F.size("given"))
    patches = p.groupBy(*key, "field").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("kind").alias("op"), F.col("inner").alias("at"), "size", "given"))).alias("patches"))
    grouped = patches.join(base.select(*key, *lists), key).withColumn("_v", F.coalesce(*[F.when(F.col("field") == f, F.col(f)) for f in lists]))
    done = grouped.withColumn("_state", folded(F.coalesce(F.size("_v"), F.lit(0)).cast("long"), F.col("_v").isNotNull(), F.col("patches")))
    source = lambda r: F.when(r["added"] == ORIGINAL, F.col("_v")).otherwise(F.get(F.filter("patches", lambda q: q["seq"] == r["added"]), 0)["given"])
    elements = F.flatten(F.transform(F.array_sort("_state.runs"), lambda r: F.slice(source(r), (r["first"] + 1).cast("int"), r["len"].cast("int"))))
    done = durable(done.select(*key, "field", "_state", F.when(F.col("_state.there"), elements).alias("v")))
    wide = done.groupBy(*key).agg(*[F.max(F.when(F.col("field") == f, F.struct("v"))).alias(f"_{f}") for f in lists])
    return wide, done.select("pathway_id", F.inline("_state.log")).select("pathway_id", "seq", "why")


def apply_in_order(rows: DataFrame, patches: DataFrame, fields: list[str], lists: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """One list's rows ``(pathway_id, pos, fields, lists)`` after its accepted patches ``(pathway_id, seq, op, path, value)``, and
    each patch's ``(pathway_id, seq, applied, reason)``.

    ``pos`` are the rows' places from 0; paths are within the list: ``/3`` or ``/-`` is a row (a value is a JSON object),
    ``/3/name`` a field, ``/3/inputs`` a list-valued one, ``/3/inputs/0`` its element. ``seq`` is a pathway's order and is unique in it.
    A patch with a null path, operation or order is not one."""
    lists = list(lists)
    parts = F.split(F.expr("substring(path, 2)"), "/")
    p = patches.where("seq is not null and path like '/%' and op is not null").select("pathway_id", F.col("seq").cast("long").alias("seq"), F.lower("op").alias("op"), parts[0].alias("at"), F.slice(parts, 2, 1000).alias("_rest"), "value")
    p = p.withColumn("_rest", F.transform("_rest", lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))))
    name, top = F.array_join("_rest", "."), F.get("_rest", F.lit(0))
    known = F.when(F.size("_rest") == 0, "row").when(name.isin(*fields), "field").when(top.isin(*lists) & (F.size("_rest") <= 2), "list").otherwise("unknown")
    p = p.withColumns({"place": known, "field": F.when(top.isin(*lists), top).otherwise(name), "inner": F.get("_rest", F.lit(1))}).drop("_rest")
    fits = F.col("op").isin("add", "replace", "remove") & (F.col("place") != "unknown")
    unknown = p.where(~fits).select("pathway_id", "seq", F.when(F.col("place") == "unknown", "unknown_field").otherwise("unsupported_op").alias("why"))
    good = p.where(fits)
    sizes = rows.join(good.select("pathway_id").distinct(), "pathway_id", "left_semi").groupBy("pathway_id").agg(F.count("*").alias("n"), F.max("pos").cast("long").alias("last"))
    # a list's patches are gathered with all that is in them, so none is looked up again by its order
    ops = F.struct("seq", F.when(F.col("place") == "row", F.col("op")).otherwise("touch").alias("op"), "at", F.lit(1).alias("size"), F.col("op").alias("does"), "place", "field", "inner", "value")
    states = good.groupBy("pathway_id").agg(F.array_sort(F.collect_list(ops)).alias("patches")).join(sizes, "pathway_id", "left")
    states = durable(states.select("pathway_id", "last", "patches", folded(F.coalesce("n", _long(0)), F.lit(True), F.col("patches")).alias("_state")))
    went = lambda q, log: F.struct(q["seq"].alias("seq"), q["does"].alias("op"), q["place"].alias("place"), q["field"].alias("field"), q["inner"].alias("inner"), q["value"].alias("value"), log["first"].alias("first"), log["added"].alias("added"), log["why"].alias("why"))
    reached = states.select("pathway_id", F.inline(F.zip_with("patches", "_state.log", went)))
    # rows as they stand at the end, known by what they were
    here = lambda pos: lambda r: (r["added"] == ORIGINAL) & (r["first"] <= pos) & (pos < r["first"] + r["len"])
    block = lambda pos: F.coalesce(F.greatest(F.floor(pos / ROWS_A_TASK), _long(0)), _long(0))
    given = states.select("pathway_id", F.col("_state.runs").alias("_runs"), F.explode(F.sequence(_long(0), block(F.col("last")))).alias("_block"))
    old = rows.select("pathway_id", F.col("pos").cast("long").alias("first"), *fields, *lists).withColumn("_block", block(F.col("first"))).join(given, ["pathway_id", "_block"], "left")
    run = F.get(F.filter("_runs", here(F.col("first"))), 0)
    old = old.withColumn("_run", run).select("pathway_id", "first", _long(ORIGINAL).alias("added"), F.when(F.col("_runs").isNull(), F.col("first")).otherwise(F.col("_run.at") + F.col("first") - F.col("_run.first")).alias("pos"), *fields, *lists)
    brought = reached.where("place = 'row' and op <> 'remove'").select("pathway_id", _long(0).alias("first"), F.col("seq").alias("added"), *_fields_of("value", list(fields), lists))
    placed = states.select("pathway_id", F.inline("_state.runs")).where(F.col("added") != ORIGINAL).select("pathway_id", "added", F.col("at").alias("pos"))
    new = brought.join(placed, ["pathway_id", "added"], "left").select("pathway_id", "first", "added", "pos", *fields, *lists)
    every = old.unionByName(new)  # without a place: gone by now
    out, log = every, [unknown, reached.where("place = 'row' or why is not null").select("pathway_id", "seq", "why")]
    for place, names, work in (("field", list(fields), _cells), ("list", lists, _inner)):
        if names:
            wide, went = work(reached.where((F.col("place") == place) & F.col("why").isNull()).drop("why"), every, names)
            out = out.join(wide, ["pathway_id", "first", "added"], "left").withColumns({f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}")["v"]).otherwise(F.col(f)) for f in names}).drop(*[f"_{f}" for f in names])
            log.append(went)
    report = reduce(DataFrame.unionByName, log).select("pathway_id", "seq", F.col("why").isNull().alias("applied"), F.coalesce("why", F.lit("applied")).alias("reason"))
    return out.where("pos is not null").select("pathway_id", "pos", *fields, *lists), report
