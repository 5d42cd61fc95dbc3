"""Tool-call linking in chats; DataFrame functions only.

Calls and results are joined by identifier within their conversation, calls are put in
topological order (after all calls whose results they refer to), arguments are checked
against the tools' schemas, and each linked call is written as canonical JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlore.llm.store import keep, new_folder


def canonical_json(text: str | Column) -> Column:
    """One spelling for equal JSON values: keys sorted, no blanks, numbers without trailing
    zeros; null for null, broken JSON and objects that repeat a key."""
    return F.to_json(F.try_parse_json(text))


def argument_errors(arguments: Column, fields: Column) -> Column:
    """Sorted messages on what an arguments object lacks, has wrongly or has too much.

    ``fields``: array of (field, type, required) with the types string, integer, number,
    boolean, array, object. A null value counts as missing.
    """
    parsed = F.from_json(arguments, "map<string,variant>")
    whole = F.try_parse_json(arguments)
    kind = F.schema_of_variant
    fits = {
        "string": lambda k: k == "STRING", "integer": lambda k: k.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"),
        "number": lambda k: k.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "boolean": lambda k: k == "BOOLEAN",
        "array": lambda k: k.startswith("ARRAY"), "object": lambda k: k.startswith("OBJECT")}

    def check(f):
        value = parsed[f["field"]]
        k = kind(value)
        missing = value.isNull() | (k == "VOID")
        right = F.lit(False)
        for name, test in fits.items():
            right = right | ((f["type"] == name) & test(k))
        return F.when(missing, F.when(f["required"], F.concat(F.lit("missing "), f["field"]))).when(
            ~right, F.concat(F.lit("not "), f["type"], F.lit(" "), f["field"]))

    known = F.transform(fields, lambda f: f["field"])
    extra = F.transform(F.array_except(F.map_keys(parsed), known), lambda k: F.concat(F.lit("unknown "), k))
    found = F.array_sort(F.concat(F.array_compact(F.transform(fields, check)), extra))
    no_object = whole.isNull() | ~kind(whole).startswith("OBJECT")
    return F.when(fields.isNull(), F.array(F.lit("unknown tool"))).when(
        F.coalesce(no_object, F.lit(True)), F.array(F.lit("arguments are no object"))).otherwise(found)


def levels(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level): 1 for calls that wait for none, else one more than the highest level
    among the calls they wait for; null in or behind a circle.

    ``calls`` is read several times. It has the keys (conversation, id, rank among the calls
    of that id), without repeats, ``position`` and ``after``, an array of ids; ids that are no
    call of the same conversation are ignored. A repeated id stands for its last call at an
    earlier position, or for its first if there is none.

    Calls that wait for a single one are chains: each points upward and doubles its pointer
    until it stands at a call that waits for none or for several, in as many rounds as the
    logarithm of the longest chain. Only calls that wait for several are then settled in
    rounds, one per such call on the longest path. Every round reads written tables of the
    same shape, so no plan grows.
    """
    scope, name, nth = keys
    nodes = keep(calls.select(*keys, F.monotonically_increasing_id().alias("node")), "nodes")
    edges = calls.select(F.col(scope).alias("s"), F.col(name).alias("to"), F.col(nth).alias("to_nth"), "position",
                         F.explode("after").alias("of")).where("of is not null").distinct()
    if calls.where(F.col(nth) > 1).limit(1).count():
        there = calls.select(F.col(scope).alias("s"), F.col(name).alias("of"), "position", F.col(nth).alias("seen"))
        before = Window.partitionBy("s", "of").orderBy("position", F.col("seen").asc_nulls_first()).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        edges = edges.unionByName(there, allowMissingColumns=True).withColumn(
            "of_nth", F.coalesce(F.last("seen", ignorenulls=True).over(before), F.lit(1))).where("seen is null")
    else:
        edges = edges.withColumn("of_nth", F.lit(1))

    def numbered(df, side):
        known = nodes.select(F.col(scope).alias("ns"), F.col(name).alias("nn"), F.col(nth).alias("nk"), F.col("node").alias(f"{side}_node"))
        return df.join(known, F.col("s").eqNullSafe(F.col("ns")) & (F.col(side) == F.col("nn")) & (F.col(f"{side}_nth") == F.col("nk"))).drop("ns", "nn", "nk")

    edges = numbered(numbered(edges, "of"), "to").select(F.col("to_node").alias("to"), F.col("of_node").alias("of")).distinct()
    edges = keep(edges, "waits")
    waits = keep(edges.groupBy("to").agg(F.count("*").alias("n"), F.min("of").alias("of")), "degrees")
    up = _upward(waits.where("n = 1").select(F.col("to").alias("node"), F.col("of").alias("up"), F.lit(1).alias("dist")))
    roots = nodes.join(waits, F.col("node") == F.col("to"), "left_anti").select("node", F.lit(1).alias("level"))
    settled = _settled(edges, waits, up, roots)
    ends = roots if settled is None else roots.unionByName(settled)
    below = up.join(ends.withColumnRenamed("node", "end"), F.col("up") == F.col("end")).select("node", (F.col("level") + F.col("dist")).alias("level"))
    known = ends.unionByName(below).select(F.col("node").alias("known"), "level")
    return nodes.join(known, F.col("node") == F.col("known"), "left").select(*keys, "level")


def _upward(pointers: DataFrame) -> DataFrame:
    """(node, up, dist): the first call above each that is no pointer itself; calls in or behind
    a circle of pointers drop out."""
    pointers = keep(pointers, "up")
    longest, round_ = pointers.count(), 1
    while longest:
        above = pointers.select(F.col("node").alias("a"), F.col("up").alias("next"), F.col("dist").alias("more"))
        joined = pointers.join(above, F.col("up") == F.col("a"), "left")
        jumped = keep(joined.select("node", F.coalesce("next", "up").alias("up"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"),
                                    F.col("next").isNotNull().alias("open")), "up")
        pointers = jumped.drop("open")
        if not jumped.where("open").limit(1).count():
            break
        if 1 << round_ - 1 > longest:  # every chain stood at its end before this round
            return keep(jumped.where("not open").drop("open"), "up")
        round_ += 1
    return pointers


def _settled(edges: DataFrame, waits: DataFrame, up: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(node, level) of the calls that wait for several, round by round."""
    many = waits.where("n > 1").select(F.col("to").alias("m"))
    if not many.limit(1).count():
        return None
    spark = edges.sparkSession
    ends = up.select(F.col("node").alias("p"), "up", "dist")
    paths = edges.join(many, F.col("to") == F.col("m")).join(ends, F.col("of") == F.col("p"), "left").select(
        "to", F.coalesce("up", "of").alias("of"), F.coalesce("dist", F.lit(0)).alias("dist"))
    paths = keep(paths.groupBy("to", "of").agg(F.max("dist").alias("dist")), "paths")
    open_ = paths.groupBy("to").agg(F.count("*").alias("open"), F.lit(0).alias("top"))
    fresh, folder, round_ = roots, new_folder(spark, "levels"), 0
    while True:
        come = paths.join(fresh.withColumnRenamed("node", "f"), F.col("of") == F.col("f")).groupBy(F.col("to").alias("t")).agg(
            F.count("*").alias("c"), F.max(F.col("level") + F.col("dist")).alias("high"))
        open_ = keep(open_.join(come, F.col("to") == F.col("t"), "left").select(
            "to", (F.col("open") - F.coalesce("c", F.lit(0))).alias("open"), F.greatest("top", F.coalesce("high", F.lit(0))).alias("top")), "open")
        fresh = keep(open_.where("open = 0").select(F.col("to").alias("node"), (F.col("top") + 1).alias("level")), "level", f"{folder}/round={round_}")
        if not fresh.limit(1).count():
            break  # all are settled, or only circles and what waits for them are left
        open_, round_ = open_.where("open > 0"), round_ + 1
    return spark.read.schema("node bigint, level int").parquet(folder).select("node", "level")


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id, position, level, tool, arguments, errors, result, answered, linked.

    ``calls``: conv_id, call_id, position, tool, arguments (JSON text), after (ids of the
    calls whose results the arguments use). ``results``: conv_id, call_id, position,
    content. ``schemas``: tool, field, type, required.

    Every call gives a row and every result without a call one with null tool. Rows in the
    order of (conv_id, level, position) are a topological order. The calls of one id are
    ranked by position, then arguments, its results by position, then content, and the n-th
    result is linked to the n-th call; from the second on, calls and results left over carry
    the error 'repeated id'. Null ids never link. ``arguments`` is canonical JSON (null if
    broken), ``linked`` the whole record as canonical JSON. Other columns are not read;
    empty tables are fine. Joins are on (conv_id, call_id, rank), so a hot conversation
    spreads; one task ranks all calls of one id.
    """
    def ranked(df, *order):
        each = Window.partitionBy("conv_id", "call_id").orderBy(*order)
        named = df.where("call_id is not null").withColumn("nth", F.row_number().over(each))
        return named, df.where("call_id is null").withColumn("nth", F.lit(1))

    plain = calls.select("conv_id", "call_id", "position", "tool", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    named, lost = ranked(plain, "position", "arguments", "tool", "after")
    named = keep(named, "calls")
    told = results.select("conv_id", "call_id", "position", "content")
    back = DataFrame.unionByName(*ranked(told, "position", "content")).select(
        F.col("conv_id").alias("rs"), F.col("call_id").alias("rn"), F.col("nth").alias("rk"), F.col("content").alias("result"),
        F.lit(True).alias("answered"))
    fields = schemas.groupBy(F.col("tool").alias("of")).agg(F.array_sort(F.collect_set(F.struct("field", "type", "required"))).alias("fields"))
    order = levels(named, ["conv_id", "call_id", "nth"]).withColumnsRenamed({"conv_id": "ls", "call_id": "ln", "nth": "lk"})
    joined = named.join(order, F.col("conv_id").eqNullSafe(F.col("ls")) & (F.col("call_id") == F.col("ln")) & (F.col("nth") == F.col("lk")))
    joined = joined.drop("ls", "ln", "lk").unionByName(lost.withColumn("level", F.lit(1)))
    joined = keep(joined.join(back, F.col("conv_id").eqNullSafe(F.col("rs")) & (F.col("call_id") == F.col("rn")) & (
        F.col("nth") == F.col("rk")), "full"), "linked")

    def records(df, errors):
        again = F.when(F.coalesce("nth", "rk") > 1, F.array(F.lit("repeated id"))).otherwise(F.array().cast("array<string>"))
        out = df.select(
            F.coalesce("conv_id", "rs").alias("conv_id"), F.coalesce("call_id", "rn").alias("call_id"), "position", "level",
            "tool", canonical_json("arguments").alias("arguments"), F.concat(errors, again).alias("errors"), "result",
            F.coalesce("answered", F.lit(False)).alias("answered"))
        record = F.to_json(F.struct(
            F.col("call_id").alias("id"), F.col("tool").alias("name"), F.try_parse_json("arguments").alias("arguments"),
            F.col("result").alias("result"), F.col("errors").alias("errors")), {"ignoreNullFields": "false"})
        return out.withColumn("linked", canonical_json(record))

    asked = joined.where("nth is not null").join(fields, F.col("tool") == F.col("of"), "left")
    return records(joined.where("nth is null"), F.array(F.lit("no call"))).unionByName(
        records(asked, argument_errors(F.col("arguments"), F.col("fields"))))
