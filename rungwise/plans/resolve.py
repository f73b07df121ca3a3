"""What names lead to: instances inside types, fields inside records, elements of a chart.

Each is a fixed point over relations. A round is a few joins or windows on keys of one
source, written to the checkpoint folder, and works only on what the round before found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.plans import views
from rungwise.plans.roundtrip import dealt
from rungwise.session import checkpointed


def instance_tree(nodes: DataFrame) -> DataFrame:
    """source_id, path, depth, type_name, type_node_id, cycle: every instance, and every one inside its type, and inside theirs.

    path leads from the root picture; inside a type it goes on with the names in its body. A type is the first of its
    folded name in the source; type_node_id is null where there is none. An instance of a type that it stands inside of,
    at any depth, is one row with cycle true and isn't opened. Each round opens one more level, so there are at most as many as types.
    """
    types = views.of_kind(nodes, "ModuleTypeDef").groupBy("source_id", F.col("name_key").alias("type_key")).agg(F.min("node_id").alias("type_node_id"))
    held = nodes.filter("kind = 'ModuleTypeInstance'").select("source_id", "name", views.props("type string, type_key string, path array<string>, within int"))
    held = held.select("source_id", "p.within", "p.path", F.col("p.type").alias("type_name"), F.col("p.type_key").alias("type_key")).join(types, ["source_id", "type_key"], "left").drop("type_key")
    held = checkpointed(held)
    inner = held.filter("within IS NOT NULL").select("source_id", F.col("within").alias("type_node_id"), F.expr("slice(path, 2, size(path))").alias("below"), F.col("type_name").alias("inner_type"), F.col("type_node_id").alias("inner_id"))
    none = F.array().cast("array<int>")
    level = held.filter("within IS NULL").select("source_id", "path", F.lit(0).alias("depth"), "type_name", "type_node_id", none.alias("around"), F.lit(False).alias("cycle"))
    out = level = checkpointed(level)
    while level.filter("type_node_id IS NOT NULL AND NOT cycle").take(1):
        around = F.concat("around", F.array("type_node_id"))
        opened = level.filter("type_node_id IS NOT NULL AND NOT cycle").join(inner, ["source_id", "type_node_id"]).select(
            "source_id", F.concat("path", "below").alias("path"), (F.col("depth") + 1).alias("depth"), F.col("inner_type").alias("type_name"), F.col("inner_id").alias("type_node_id"), around.alias("around")
        )
        level = checkpointed(opened.withColumn("cycle", F.coalesce(F.array_contains("around", F.col("type_node_id")), F.lit(False))))
        out = out.unionByName(level)
    return out.drop("around")


def dotted_paths(nodes: DataFrame) -> DataFrame:
    """source_id, node_id, name, levels, found, datatype, missing for every variable that code or a mapping names.

    The first part is looked up among the source's variables, of several the first declared, each further one among the
    fields of the record that the part before it is of; all by folded names. `found` parts lead somewhere, `missing` is
    the first that doesn't, null if all do; datatype is that of the last one found.
    """
    declared = nodes.filter("kind = 'Variable'").select("source_id", "node_id", "parent_id", "role", "name_key", views.props("type string, type_key string"))
    declared = declared.select("source_id", "node_id", "parent_id", "role", "name_key", F.col("p.type").alias("datatype"), F.col("p.type_key").alias("type_key"))
    first = F.min_by(F.struct("datatype", "type_key"), "node_id").alias("held")
    variables = declared.filter("role <> 'field'").groupBy("source_id", F.col("name_key").alias("part")).agg(first)
    records = views.of_kind(nodes, "DataType").groupBy("source_id", F.col("name_key").alias("record")).agg(F.min("node_id").alias("parent_id"))
    fields = declared.filter("role = 'field'").join(records, ["source_id", "parent_id"]).groupBy("source_id", "record", F.col("name_key").alias("part")).agg(first)
    fields = checkpointed(fields)
    refs = nodes.filter("kind = 'VarRef' AND role <> 'target' OR kind = 'VarRef' AND depth > 0").select("source_id", "node_id", "name", F.split("name_key", r"\.").alias("parts"))
    at = refs.withColumn("part", F.col("parts")[0]).join(variables, ["source_id", "part"], "left")

    def walked(found: Column) -> list[Column]:
        return [F.col(c) for c in ("source_id", "node_id", "name", "parts")] + [found.alias("found"), F.col("held.datatype").alias("datatype"), F.col("held.type_key").alias("record")]

    state = checkpointed(at.select(*walked(F.when(F.col("held").isNotNull(), 1).otherwise(0))))
    most = state.agg(F.max(F.size("parts"))).first()[0] or 0
    out = None
    for k in range(1, most):
        going = (F.col("found") == k) & (F.size("parts") > k)
        done = state.filter(~going)
        out = done if out is None else out.unionByName(done)
        step = state.filter(going).withColumn("part", F.col("parts")[k]).withColumnRenamed("datatype", "before").join(fields, ["source_id", "record", "part"], "left")
        state = checkpointed(step.select("source_id", "node_id", "name", "parts", (F.col("found") + F.col("held").isNotNull().cast("int")).alias("found"), F.coalesce("held.datatype", "before").alias("datatype"), F.col("held.type_key").alias("record")))
    out = state if out is None else out.unionByName(state)
    return out.select("source_id", "node_id", "name", F.size("parts").alias("levels"), "found", "datatype", F.when(F.col("found") < F.size("parts"), F.get("parts", "found")).alias("missing"))


CONTAINERS = ("Alternative", "Parallel", "Subsequence", "TransitionSub")
#: Rounds after which the charts that are done are gathered in one table, so that no plan grows with the rounds.
GATHER = 24


def reached(nodes: DataFrame) -> DataFrame:
    """source_id, node_id, parent_id, kind, name, reached, passes for every element of every chart.

    Flow enters a sequence at its first element and runs through a body until something stops it: a fork, which
    goes on at its targets in the same module, a break, or a container that flow doesn't leave. An alternative is left by any of
    its branches, a parallel only by all, a subsequence by its body's end; an empty body is walked through. Rounds go on until none adds an
    element: as many as flow meets containers and forks one after the other, however many plain elements stand between them.

    A round deals rows by source and is windows within a source, all in the same tasks; a module that it adds nothing to is done and takes no part
    in the next, so a round moves only what the one before went on with. Beside an element stand, so that windows can tell one row of another, a
    row in the bodies of each container and sequence ("body") and one under the name of each of a fork's targets ("target"); `seat` is what these have in common.
    """
    holds, container, element = F.col("kind").isin("Sequence", *CONTAINERS), F.col("kind").isin(*CONTAINERS), F.col("what") == "element"

    def standing(what: str, at: Column, role: Column, key: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), at.cast("int").alias("at"), role.cast("string").alias("role"), key.cast("string").alias("name_key"))

    none = F.lit(None)
    given = views.of_kind(nodes, "Sequence", *views.CHART).select("source_id", "node_id", "parent_id", "ordinal", "role", "kind", "name", "name_key", views.props("target_keys array<string>, module int, branches int"))
    itself = F.when(F.col("kind") != "Sequence", F.array(standing("element", F.col("parent_id"), F.col("role"), F.col("name_key"))))
    bodies = F.when(holds, F.array(standing("body", F.col("node_id"), none, none)))
    targets = F.when(F.col("kind") == "Fork", F.transform("p.target_keys", lambda key: standing("target", none, none, key)))
    nothing = F.array().cast("array<struct<what: string, at: int, role: string, name_key: string>>")
    stands = F.concat(*[F.coalesce(x, nothing) for x in (itself, bodies, targets)])
    rows = dealt(given, "source_id").select("source_id", "node_id", "parent_id", "ordinal", "kind", "name", F.col("p.module").alias("module"), F.coalesce("p.branches", F.lit(1)).alias("branches"), F.when(holds | (F.col("kind") == "Fork"), F.col("node_id")).alias("seat"), F.inline(stands))

    body = Window.partitionBy("source_id", "at", "role").orderBy("ordinal")
    up_to, before = body.rowsBetween(Window.unboundedPreceding, 0), body.rowsBetween(Window.unboundedPreceding, -1)
    house, seat, called, own = (Window.partitionBy("source_id", *keys) for keys in (["at"], ["seat"], ["module", "name_key"], ["module"]))
    rows = rows.withColumns({"first": element & F.lag("node_id").over(body).isNull(), "last": element & F.lead("node_id").over(body).isNull()})
    rows = rows.withColumns({"outer": F.max(~element & (F.col("kind") == "Sequence")).over(house), "filled": F.count_if("first").over(house)})
    rows = rows.filter(element | (F.col("kind") != "Sequence"))
    state = rows.withColumns({"entered": F.col("first") & F.col("outer"), "passes": ~F.col("kind").isin("Fork", "Break", *CONTAINERS)})
    kept = state.columns

    out: list[DataFrame] = []
    while True:
        entry = F.max(F.when(F.col("entered"), F.col("ordinal"))).over(up_to)
        stop = F.max(F.when(~F.col("passes"), F.col("ordinal"))).over(before)
        left = F.max(F.when(container & F.col("passes"), F.col("ordinal"))).over(before)
        now = state.withColumn("reached", element & F.coalesce(F.greatest(entry, left) > F.coalesce(stop, F.lit(-1)), F.lit(False)))
        now = now.withColumn("reached", F.when(F.col("seat").isNull(), F.col("reached")).otherwise(F.max("reached").over(seat)))
        leaves = element & ~F.col("outer") & F.col("last") & F.col("passes") & (F.col("reached") | container)
        now = now.withColumns({"opened": F.max((F.col("what") == "body") & F.col("reached")).over(house), "ways": F.count_if(leaves).over(house)})
        ways = F.col("ways") + F.when(F.col("reached"), F.col("branches") - F.col("filled")).otherwise(0)  # a body may be jumped into, an empty one may not
        through = (F.col("what") == "body") & container & F.when(F.col("kind") == "Parallel", ways == F.col("branches")).otherwise(ways > 0)
        now = now.withColumn("through", container & F.max(through).over(seat))
        now = now.withColumn("jumped", F.max((F.col("what") == "target") & F.col("reached") & F.col("module").isNotNull()).over(called))
        enters = element & (F.col("first") & F.col("opened") | F.col("jumped") & F.col("kind").isin("Step", "InitStep"))
        more = element & (enters & ~F.col("entered") | F.col("through") & ~F.col("passes"))
        now = now.withColumns({"grown": F.max(more).over(own), "entered": F.col("entered") | enters, "passes": F.col("passes") | element & F.col("through")})
        now = checkpointed(now.select(*kept, "reached", "grown"))
        out.append(now.filter(element & ~F.col("grown")).select("source_id", "node_id", "parent_id", "kind", "name", "reached", "passes"))
        state = dealt(now.filter("grown").select(*kept), "source_id")
        if not now.filter("grown").take(1):
            return reduce(DataFrame.unionByName, out)
        if len(out) == GATHER:
            out = [checkpointed(reduce(DataFrame.unionByName, out))]
