"""Tool calls linked to their results, ordered, checked and written as canonical JSON.

Calls ``(call_id, conv_id, position, tool, arguments)`` and results ``(call_id,
position, content)`` are joined by hash on the identifier. Arguments name the
calls whose results they use as ``{"$ref": "<call_id>"}``; a call's level is one
more than the highest level among those. Arguments are checked against a table of
schemas ``(tool, field, type, required)`` and written with sorted keys.

Everything is a DataFrame expression. Defined cases: a call without a result
is ``unanswered``, a result without a call ``orphan``; of several results of a call the
earliest counts (ties: the smaller content), of several calls of one
identifier the earliest is kept (``link_all`` lists the others too); references to
calls that do not exist count for no level; calls on a cycle,
or behind one, have no level and status ``cyclic``; arguments that are
null or no JSON object are ``malformed``, a tool without schema is ``unknown``; whole numbers of up to 38 digits are
``integer``, longer ones ``number``; texts of any length are written whole; columns beside those named are not
carried; no calls and no results give no rows; a null identifier links with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.session import bounded, settle, settle_measured

REFERENCE = r'"\$ref"\s*:\s*"((?:[^"\\]++|\\.)++)"'


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no blanks; null if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def references(arguments: Column) -> Column:
    """The identifiers referred to, escapes resolved."""

    def plain(raw: Column) -> Column:
        resolved = F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>")[0]
        return F.when(raw.contains("\\"), resolved).otherwise(raw)

    found = F.transform(F.regexp_extract_all(arguments, F.lit(REFERENCE), F.lit(1)), plain)
    return F.array_distinct(F.filter(found, lambda name: name.isNotNull()))


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key as ``first``: aggregated before the shuffle, no group is gathered."""
    fields = F.struct(*order, *[c for c in rows.columns if c not in (key, *order)])
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(fields).alias("first")).select(key, "first.*")


def _chains(single: DataFrame, count: int) -> DataFrame:
    """``call_id, anchor, distance``: where the chain of single references of each call ends.

    Every round doubles the distance looked ahead, so the rounds follow the logarithm
    of the longest chain. Who still moves after all of them is on or behind a cycle and is left out.
    """
    ahead, _ = settle_measured(single.select("call_id", F.col("needs").alias("anchor"), F.lit(1).alias("distance")), "chains", n=F.count(F.lit(1)))
    for _ in range(count.bit_length() + 1):
        step = ahead.select(F.col("call_id").alias("anchor"), F.col("anchor").alias("further"), F.col("distance").alias("more"))
        jumped = ahead.join(step, "anchor", "left").select(
            "call_id",
            F.coalesce("further", "anchor").alias("anchor"),
            (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance"),
            F.col("further").isNotNull().alias("moved"),
        )
        jumped, measured = settle_measured(jumped, "chains", moved=F.sum(F.col("moved").cast("bigint")))
        ahead = jumped.select("call_id", "anchor", "distance")
        if not measured["moved"]:
            return ahead
    return jumped.filter("not moved").select("call_id", "anchor", "distance")


def levels(calls: DataFrame) -> DataFrame:
    """``call_id, level`` of distinct calls; null on or behind a cycle.

    Chains of calls with one reference each are followed by doubling. The calls with
    several references are then peeled, a round for each level among them.
    """
    edges = calls.select("call_id", F.explode(references(F.col("arguments"))).alias("needs"))
    known = calls.select(F.col("call_id").alias("needs"))
    edges = settle(edges.join(known, "needs", "left_semi"), "references")
    degrees = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("degree"), F.min("needs").alias("needs"))
    degrees, measured = settle_measured(
        degrees, "degrees", single=F.sum((F.col("degree") == 1).cast("bigint")), many=F.sum((F.col("degree") > 1).cast("bigint"))
    )
    done = calls.select("call_id").join(degrees, "call_id", "left_anti").withColumn("level", F.lit(0))
    chains = settle(_chains(degrees.filter("degree = 1"), measured["single"] or 0), "chains")
    total, closed = measured["many"] or 0, 0
    if total:
        # The references of the others, each led to the end of its chain.
        left = edges.join(degrees.filter("degree > 1").select("call_id"), "call_id")
        ends = chains.select(F.col("call_id").alias("needs"), "anchor", "distance")
        lone = degrees.filter("degree = 1").select(F.col("call_id").alias("needs"), F.lit(True).alias("lone"))
        led = left.join(lone, "needs", "left").join(ends, "needs", "left")
        anchor = F.when(F.col("lone").isNull(), F.col("needs")).otherwise(F.col("anchor"))
        led = settle(led.select("call_id", anchor.alias("anchor"), F.coalesce("distance", F.lit(0)).alias("distance")), "led")
        roots, ready = settle(done, "levels"), None
        while closed < total:
            settled = roots if ready is None else roots.union(ready)
            marked = led.join(settled.withColumnRenamed("call_id", "anchor"), "anchor", "left")
            above = F.col("level") + F.col("distance")
            open_ = marked.groupBy("call_id").agg(F.max(above).alias("top"), F.count(F.lit(1)).alias("all"), F.count("level").alias("known"))
            fresh = open_.filter(F.col("all") == F.col("known")).select("call_id", (F.col("top") + 1).cast("int").alias("level"))
            ready, state = settle_measured(fresh, "levels", n=F.count(F.lit(1)))
            if state["n"] == closed:
                break
            closed = state["n"]
        done = roots.union(ready)
    done = settle(done, "levels")
    behind = chains.join(done.withColumnRenamed("call_id", "anchor"), "anchor")
    everything = done.union(behind.select("call_id", (F.col("level") + F.col("distance")).cast("int").alias("level")))
    return calls.select("call_id").join(everything, "call_id", "left")


def kind_of(value: Column) -> Column:
    """The JSON type of a variant."""
    shape = F.schema_of_variant(value)
    return (
        F.when(shape == "STRING", F.lit("string"))
        .when((shape == "BIGINT") | shape.rlike(r"^DECIMAL\(\d+,0\)$"), F.lit("integer"))  # decimals: beyond 64 bits
        .when(shape == "BOOLEAN", F.lit("boolean"))
        .when(shape == "VOID", F.lit("null"))
        .when(shape.startswith("ARRAY"), F.lit("array"))
        .when(shape.startswith("OBJECT"), F.lit("object"))
        .otherwise(F.lit("number"))
    )


def problems(arguments: Column, fields: Column) -> Column:
    """What the arguments break: ``fields`` is an array of ``field, type, required``, null for an unknown tool."""
    values = F.from_json(arguments, "map<string,variant>")

    def of(field: Column) -> Column:
        found = kind_of(F.element_at(values, field["field"]))
        fits = (found == field["type"]) | ((field["type"] == "number") & (found == "integer"))
        absent = ~F.map_contains_key(values, field["field"])
        return (
            F.when(absent & field["required"], F.concat(F.lit("missing:"), field["field"]))
            .when(~absent & ~fits, F.concat(field["type"], F.lit(" expected:"), field["field"]))
        )

    broken = F.filter(F.transform(fields, of), lambda x: x.isNotNull())
    extra = F.array_except(F.map_keys(values), F.transform(fields, lambda f: f["field"]))
    unexpected = F.transform(extra, lambda name: F.concat(F.lit("unexpected:"), name))
    return (
        F.when(F.try_parse_json(arguments).isNull() | values.isNull(), F.array(F.lit("malformed")))
        .when(fields.isNull(), F.array(F.lit("unknown")))
        .otherwise(F.array_sort(F.concat(broken, unexpected)))
    )


def with_problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``problems``; the schemas are broadcast if they are small."""
    tools = schemas.filter("tool is not null and field is not null").groupBy("tool")
    tools = tools.agg(F.sort_array(F.collect_set(F.struct("field", "type", "required"))).alias("fields"))
    tools = bounded(tools, "schemas", F.lit(64) + F.size("fields") * 64, 16 * 1024 * 1024)
    joined = calls.join(tools, "tool", "left")
    return joined.select(*calls.columns, problems(F.col("arguments"), F.col("fields")).alias("problems"))


def _further_levels(further: DataFrame, ordered: DataFrame) -> DataFrame:
    """``_row, level`` of calls that nothing can refer to: one more than what they refer to, null behind a cycle."""
    needs = further.select("_row", F.explode(references(F.col("arguments"))).alias("call_id")).join(ordered, "call_id")
    above = needs.groupBy("_row").agg(F.max("level").alias("top"), F.count(F.lit(1)).alias("all"), F.count("level").alias("known"))
    level = F.when(F.col("all").isNull(), 0).when(F.col("all") == F.col("known"), F.col("top") + 1).cast("int")
    return further.select("_row").join(above, "_row", "left").select("_row", level.alias("level"))


def link_all(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and one per result that is not a call's answer; nothing is left out.

    As ``link``, and besides: calls without an identifier are ``unanswered`` (or ``cyclic``), further calls of one
    identifier ``duplicate``; results without an identifier and all further results of an identifier without
    call are ``orphan``, further results of a call ``surplus``.
    """
    return _linked(calls, results, schemas).drop("_first")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per identifier: of the call that counts, or of the first orphan result; see ``link_all`` for all rows.

    ``conv_id, call_id, tool, position, result_position, level, status, problems, json``: in every
    conversation ``level, position`` is an order in which each call comes after those it refers to.
    """
    return _linked(calls, results, schemas).filter("_first").drop("_first")


def _linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    numbered = F.monotonically_increasing_id().alias("_row")
    rows = settle(calls.select("call_id", "conv_id", "position", "tool", "arguments", numbered), "calls")
    kept = settle(first_of(rows, "call_id", "position", "conv_id", "tool", "arguments", "_row"), "calls")
    given = settle(results.select("call_id", "position", "content", numbered), "results")
    answers = settle(first_of(given, "call_id", "position", "content", "_row"), "answers")
    ordered = settle(levels(kept), "levels")
    # Rows that link with nothing: without an identifier, or not the first of theirs.
    further = settle(rows.join(kept.select("_row"), "_row", "left_anti"), "further")
    surplus = given.join(answers.select("_row"), "_row", "left_anti")
    owned = kept.select("call_id", F.lit(True).alias("owned"))
    answers = answers.select("call_id", F.col("position").alias("result_position"), "content", F.lit(True).alias("answered"))
    first = kept.join(ordered, "call_id").drop("_row").withColumn("is_call", F.lit(True)).join(answers, "call_id", "full_outer")
    is_call = F.col("is_call").isNotNull()
    status = (
        F.when(~is_call, F.lit("orphan"))
        .when(F.col("level").isNull(), F.lit("cyclic"))
        .when(F.col("answered").isNull(), F.lit("unanswered"))
        .otherwise(F.lit("linked"))
    )
    names = ("conv_id", "call_id", "tool", "position", "arguments", "result_position", "content", "level", "is_call", "status", "_first")
    first = first.withColumns({"status": status, "_first": F.lit(True)}).select(*names)
    lone = F.when(F.col("call_id").isNotNull(), F.lit("duplicate")).when(F.col("level").isNull(), F.lit("cyclic")).otherwise(F.lit("unanswered"))
    more = further.join(_further_levels(further, ordered), "_row")
    more = more.withColumns({"is_call": F.lit(True), "status": lone, "_first": F.lit(False)})
    left = surplus.join(owned, "call_id", "left").withColumnRenamed("position", "result_position")
    left = left.withColumns({"status": F.when(F.col("owned"), F.lit("surplus")).otherwise(F.lit("orphan")), "_first": F.lit(False)})
    every = first.unionByName(more.drop("_row"), True).unionByName(left.drop("_row", "owned"), True)
    checked = with_problems(every, schemas)
    written = F.to_json(
        F.struct(
            F.to_json(F.try_parse_json("arguments")).alias("arguments"),
            F.col("call_id").alias("id"),
            F.col("content").alias("result"),
            F.col("tool").alias("tool"),
        )
    )
    return checked.select(
        "conv_id", "call_id", "tool", "position", "result_position", "level", "status",
        F.when(is_call, F.col("problems")).alias("problems"), written.alias("json"), "_first",
    )


def duplicates(calls: DataFrame) -> DataFrame:
    """``call_id, copies`` of identifiers that several calls carry; ``link`` keeps the earliest."""
    counted = calls.filter("call_id is not null").groupBy("call_id").agg(F.count(F.lit(1)).alias("copies"))
    return counted.filter("copies > 1")
