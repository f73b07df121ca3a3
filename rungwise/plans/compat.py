"""What a strict reader of the language keeps, beside what the engine keeps.

Other tools throw some of a program away. `compat` says, for every node, whether such
a tool's tree has it, and what it has of its fields and span, in columns
of their own beside the full ones. What goes is stated in tables by kind; they become column
expressions over the node relation, and one window over each source hides what stands below a hidden node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungwise.plans.views import CHART, MODULES

#: Fields that go with each kind. Of the program only its name stays, of a shape no points, and of a text what a variable is bound to.
LOST = {
    "Program": ("header", "format", "repairs", "repair_kinds"),
    "BasePicture": ("datecode", "is_frame"),
    "ModuleTypeDef": ("private",),
    "Sequence": ("layer",),
    "Equation": ("layer",),
    "GraphObject": ("points", "types", "texts", "alignment", "connection", "width", "fraction", "format"),
    "BinOp": ("own_end",),
    "Variable": ("owner", "type_key"),
    "ParameterMapping": ("owner", "source_name"),
} | {k: ("path", "within", "type_key", "head_end") for k in MODULES if k != "BasePicture"}
LOST["BasePicture"] += ("path", "type_key", "head_end")
LOST |= {k: ("module", "target_keys") for k in CHART}
#: Fields of ours that only help views; their loss is none of the program's.
HELPERS = ("path", "within", "type_key", "head_end", "module", "target_keys", "owner", "source_name", "format", "repairs", "repair_kinds")
#: Flags of a module's head that stay.
FLAGS = ("IgnoreMaxModule", "LayerModule")
#: Kinds whose nodes have no span of their own.
SPANLESS = (*CHART, "Program", "Sequence", "Equation", "ModuleCode", "ModuleDef", "GraphObject", "InteractObject", "Colour", "Property", "Procedure", "Binding")
#: What a module of each kind doesn't hold, by the role of what it would hold.
UNHELD = {"BasePicture": ("parameter", "mapping"), "FrameModule": ("parameter", "local", "mapping"), "ModuleTypeDef": ("mapping",)}
COMMENTS = ("discarded", "change")


def by_kind(table: dict[str, tuple[str, ...]], key: Column) -> Column:
    """The names a table holds for a key; none for others."""
    held = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(held, key), F.array().cast("array<string>"))


def hidden() -> Column:
    """Whether a node goes by itself: comments in lists and options, and what its module doesn't hold."""
    comment = (F.col("kind") == "Comment") & F.col("role").isin(*COMMENTS)
    held = F.col("kind").isin("Variable", "ParameterMapping") & F.array_contains(by_kind(UNHELD, F.coalesce(F.col("props")["owner"], F.lit(""))), F.col("role"))
    return comment | held


def kept_fields() -> Column:
    """The fields that stay, as they stay: `Default` as no initial value, a direction if it is out, the flags that count."""
    lost = by_kind(LOST, F.col("kind"))
    staying = F.map_filter("props", lambda k, v: ~F.array_contains(lost, k) & ~((k == "direction") & (v == "in")))

    def value(k: Column, v: Column) -> Column:
        flags = F.to_json(F.filter(F.from_json(v, "array<string>"), lambda x: x.isin(*FLAGS)))
        return F.when((k == "init") & (v == "default"), F.lit("absent")).when((k == "flags") & F.col("kind").isin(*MODULES), flags).otherwise(v)

    return F.transform_values(staying, value)


def compat(nodes: DataFrame) -> DataFrame:
    """The node relation with `fields` and a span of every node, and beside them `kept`, `compat_fields` and a compat span, null where there is none.

    `lost` names the fields that differ, `span` where the spans do, and `node` where the node goes whole.
    Partitions are those of one source; a null or failed source has its one error row.
    """
    n = nodes.withColumn("props", F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>")))
    before = Window.partitionBy("source_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    under = F.coalesce(F.max(F.when(hidden(), F.col("subtree_end"))).over(before) >= F.col("node_id"), F.lit(False))
    n = n.withColumn("kept", ~under)
    own_end = F.coalesce(F.col("props")["own_end"].cast("int"), F.col("end"))
    spanned = F.col("kept") & ~F.col("kind").isin(*SPANLESS)
    n = n.select(
        "source_id", "node_id", "parent_id", "role", "kind", "name", "literal", "kept", "start", own_end.alias("end"), F.map_filter("props", lambda k, _: k != "own_end").alias("fields"),
        F.when(spanned, F.col("start")).alias("compat_start"), F.when(spanned, F.col("end")).alias("compat_end"), F.when(F.col("kept"), kept_fields()).alias("compat_fields"),
    )
    changed = F.filter(F.map_keys("fields"), lambda k: ~k.isin(*HELPERS) & ~F.try_element_at("compat_fields", k).eqNullSafe(F.try_element_at("fields", k)))
    span = F.when(F.col("compat_end").eqNullSafe(F.col("end")), F.array().cast("array<string>")).otherwise(F.array(F.lit("span")))
    return n.withColumn("lost", F.when(F.col("kept"), F.concat(F.array_sort(changed), span)).otherwise(F.array(F.lit("node"))))


def losses(found: DataFrame) -> DataFrame:
    """A row for each field that differs: its full value and the one that stays."""
    each = found.select("source_id", "node_id", "role", "kind", F.coalesce("name", "literal").alias("name"), F.explode("lost").alias("field"), "fields", "compat_fields", "start", "end", "compat_start", "compat_end")
    return each.select("source_id", "node_id", "role", "kind", "name", "field", F.try_element_at("fields", "field").alias("own"), F.try_element_at("compat_fields", "field").alias("compat"), "start", "end", "compat_start", "compat_end")
