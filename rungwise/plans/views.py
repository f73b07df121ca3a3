"""Typed views over the node relation. All plain DataFrame plans: only the kinds and columns a query needs are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULES = ("BasePicture", "SingleModule", "FrameModule", "ModuleTypeInstance")
CHART = ("InitStep", "Step", "Transition", "TransitionSub", "Subsequence", "Alternative", "Parallel", "Fork", "Break")
STATEMENTS = ("Assignment", "FuncCallStmt", "IfStmt")
EXPRESSIONS = ("VarRef", "Literal", "BoolOp", "NotOp", "Compare", "BinOp", "UnaryOp", "FuncCall", "TernaryOp")


def span() -> Column:
    return F.struct("start", "end", "line", "col").alias("span")


def of_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*kinds))


def props(schema: str) -> Column:
    return F.from_json("props", schema).alias("p")


def _typed(nodes: DataFrame, kinds: tuple[str, ...], schema: str) -> DataFrame:
    return of_kind(nodes, *kinds).select("*", props(schema))


def held(nodes: DataFrame, *columns: str | Column) -> list[str | Column]:
    """Of a view's columns those that can be had: `nodes` may lack columns that nobody asks for."""
    names = {*nodes.columns}
    spanned = {"start", "end", "line", "col"} <= names
    return [c for c in columns if not isinstance(c, str) or c in names] + ([span()] if spanned else [])


def programs(nodes: DataFrame) -> DataFrame:
    """A row per parsed source: program_name, root_name, invoke_coord, the three header lines, wire format and repairs."""
    p = _typed(nodes, ("Program",), "header array<string>, format string, repairs array<string>, repair_kinds array<string>")
    root = _typed(nodes, ("BasePicture",), "coords array<double>, datecode long").select("source_id", F.col("name").alias("root_name"), F.col("p.coords").alias("invoke_coord"), F.col("p.datecode").alias("datecode"))
    return p.join(root, "source_id").select("source_id", F.col("name").alias("program_name"), "root_name", "invoke_coord", "datecode", F.col("p.header").alias("header"), F.col("p.format").alias("format"), F.col("p.repairs").alias("repairs"), F.col("p.repair_kinds").alias("repair_kinds"))


def variables(nodes: DataFrame) -> DataFrame:
    v = _typed(nodes, ("Variable",), "description string, `global` boolean, type string, const boolean, state boolean, opsave boolean, secure boolean, init string, duration boolean")
    return v.select(
        "source_id", F.col("parent_id").alias("owner_node_id"), "node_id", F.col("role").alias("scope"), "name", "name_key", F.col("p.type").alias("datatype"),
        *[F.col(f"p.{c}").alias(f"is_{c}") for c in ("global", "const", "state", "opsave", "secure")],
        F.col("p.init").alias("init_kind"), F.col("literal").alias("init_text"), F.col("p.duration").alias("init_is_duration"), F.col("p.description").alias("description"), span(),
    )


def modules(nodes: DataFrame) -> DataFrame:
    m = _typed(nodes, MODULES, "type string, type_key string, coords array<double>, enable boolean, layer int, zoomable boolean, zoom_limits array<double>, flags array<string>, datecode long, scan_group_global boolean")
    return m.select(
        "source_id", "node_id", "subtree_end", "parent_id", "kind", "name", "name_key", F.col("p.type").alias("type_name"), F.col("p.type_key").alias("type_key"),
        F.col("p.coords").alias("invoke_coord"), *[F.col(f"p.{c}").alias(c) for c in ("enable", "layer", "zoomable", "zoom_limits", "flags", "datecode")], span(),
    )


def module_types(nodes: DataFrame) -> DataFrame:
    return _typed(nodes, ("ModuleTypeDef",), "private boolean, datecode long").select("source_id", "node_id", "subtree_end", "name", "name_key", F.col("p.private").alias("is_private"), F.col("p.datecode").alias("datecode"), span())


def data_types(nodes: DataFrame) -> DataFrame:
    return _typed(nodes, ("DataType",), "description string, datecode long").select("source_id", "node_id", "name", "name_key", F.col("p.description").alias("description"), F.col("p.datecode").alias("datecode"), span())


def parameter_mappings(nodes: DataFrame) -> DataFrame:
    m = _typed(nodes, ("ParameterMapping",), "source string, source_name string, `global` boolean, duration boolean")
    return m.select(
        "source_id", F.col("parent_id").alias("instance_node_id"), "node_id", F.col("name").alias("target"), F.col("p.source").alias("source_kind"), F.col("p.source_name").alias("source_name"),
        F.col("literal").alias("source_literal"), F.col("p.global").alias("is_global"), F.col("p.duration").alias("is_duration"), span(),
    )


def module_defs(nodes: DataFrame) -> DataFrame:
    m = _typed(nodes, ("ModuleDef",), "clipping_bounds array<array<double>>, zoom_limits array<double>, layer_limit double, grid double, zoomable boolean")
    return m.select("source_id", "node_id", "parent_id", *[F.col(f"p.{c}").alias(c) for c in ("clipping_bounds", "zoom_limits", "layer_limit", "grid", "zoomable")], span())


def graph_objects(nodes: DataFrame) -> DataFrame:
    """Shapes; the properties that only some have stay in a VARIANT."""
    return of_kind(nodes, "GraphObject").select("source_id", "node_id", F.col("parent_id").alias("moduledef_id"), F.col("name").alias("type"), F.get_json_object("props", "$.layer").cast("int").alias("layer"), F.from_json("props", "coords array<array<double>>")["coords"].alias("coords"), F.parse_json("props").alias("props"), span())


def interact_objects(nodes: DataFrame) -> DataFrame:
    return of_kind(nodes, "InteractObject").select("source_id", "node_id", F.col("parent_id").alias("moduledef_id"), F.col("name").alias("type"), F.from_json("props", "flags array<string>")["flags"].alias("flags"), F.parse_json("props").alias("props"), span())


def bindings(nodes: DataFrame) -> DataFrame:
    return _typed(nodes, ("Binding",), "direction string, litstring boolean").select("source_id", "node_id", "parent_id", "role", F.col("p.direction").alias("direction"), "name", "literal", span())


def sequences(nodes: DataFrame) -> DataFrame:
    s = _typed(nodes, ("Sequence",), "type string, position array<double>, size array<double>, control boolean, timer boolean, layer int")
    return s.select("source_id", "node_id", "subtree_end", "parent_id", "name", *[F.col(f"p.{c}").alias(c) for c in ("type", "position", "size", "control", "timer", "layer")], "rendered", span())


def equations(nodes: DataFrame) -> DataFrame:
    e = _typed(nodes, ("Equation",), "position array<double>, size array<double>, layer int")
    return e.select("source_id", "node_id", "subtree_end", "parent_id", "name", *[F.col(f"p.{c}").alias(c) for c in ("position", "size", "layer")], span())


def chart_nodes(nodes: DataFrame) -> DataFrame:
    c = _typed(nodes, CHART, "targets array<string>, target_keys array<string>, module int")
    return c.select("source_id", "node_id", "subtree_end", "parent_id", "ordinal", "role", "kind", "name", "name_key", *[F.col(f"p.{c}").alias(c) for c in ("targets", "target_keys", "module")], span())


def chart_edges(nodes: DataFrame) -> DataFrame:
    """source_id, from_node, to_node, to_name, kind of a chart's flow.

    next: to the element after it in the same body; branch: from an alternative
    or parallel to the head of each of its branches; join: from each branch's tail back to it; fork: to a step
    of that name in the same module's code, to_node null where none has it.
    """
    n = chart_nodes(nodes)
    body = Window.partitionBy("source_id", "parent_id", "role").orderBy("ordinal")
    follow = n.select("source_id", F.col("node_id").alias("from_node"), F.lead("node_id").over(body).alias("to_node"), F.lead("name").over(body).alias("to_name"), F.lit("next").alias("kind")).filter("to_node is not null")
    forked = n.select("source_id", F.col("parent_id").alias("from_node"), "node_id", "name", "role", F.row_number().over(body).alias("k"), F.lead("node_id").over(body).alias("after")).filter(F.col("role").startswith("branch:"))
    heads = forked.filter("k = 1").select("source_id", "from_node", F.col("node_id").alias("to_node"), F.col("name").alias("to_name"), F.lit("branch").alias("kind"))
    tails = forked.filter("after is null").select("source_id", F.col("node_id").alias("from_node"), F.col("from_node").alias("to_node"), F.lit(None).cast("string").alias("to_name"), F.lit("join").alias("kind"))
    forks = n.filter("kind = 'Fork'").select("source_id", "module", F.col("node_id").alias("from_node"), F.explode(F.arrays_zip(F.col("targets").alias("to_name"), F.col("target_keys").alias("key"))).alias("to")).select("source_id", "module", "from_node", "to.*")
    steps = n.filter("name is not null").groupBy("source_id", "module", F.col("name_key").alias("key")).agg(F.min("node_id").alias("to_node"))
    jumps = forks.join(steps, ["source_id", "module", "key"], "left").select("source_id", "from_node", "to_node", "to_name", F.lit("fork").alias("kind"))
    return follow.unionByName(heads).unionByName(tails).unionByName(jumps)


def statements(nodes: DataFrame) -> DataFrame:
    return of_kind(nodes, *STATEMENTS).select(*held(nodes, "source_id", "node_id", "subtree_end", "parent_id", "ordinal", "role", "kind", "name", "rendered"))


def expressions(nodes: DataFrame) -> DataFrame:
    # only two kinds have a property of their own here, and most rows need no look at theirs
    of = lambda kind, name: F.when(F.col("kind") == kind, F.get_json_object("props", f"$.{name}"))
    return of_kind(nodes, *EXPRESSIONS).select(*held(nodes, "source_id", "node_id", "subtree_end", "parent_id", "ordinal", "role", "kind", "name", F.split("name", r"\.").alias("path"), of("VarRef", "state").alias("state"), of("Literal", "type").alias("literal_type"), "literal"))


def comments(nodes: DataFrame) -> DataFrame:
    """content is the text without the outermost marks, trimmed."""
    inner = F.regexp_replace("literal", r"(?s)^\(\*\s*|\s*\*\)$", "")
    return of_kind(nodes, "Comment").select("source_id", "node_id", "parent_id", "role", F.col("literal").alias("text"), inner.alias("content"), span())


def parse_errors(nodes: DataFrame, *more: str) -> DataFrame:
    e = _typed(nodes, ("ParseError",), "stage string, error_class string, message string, expected array<string>, context string, caret int")
    return e.select("source_id", *[F.col(f"p.{c}").alias(c) for c in ("stage", "error_class", "message", "expected", "context", "caret")], "line", "col", F.col("start").alias("offset"), *more)


def parse_runs(nodes: DataFrame) -> DataFrame:
    """A row per source: whether it parsed, else the error's class."""
    top = nodes.filter((F.col("node_id") == 0) & F.col("kind").isin("Program", "ParseError"))
    return top.select("source_id", (F.col("kind") == "Program").alias("success"), F.get_json_object("props", "$.error_class").alias("error_class"))


def descendants(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Each ancestor (source_id, node_id, subtree_end) with all nodes below it: a range within one source, no recursion."""
    a = ancestors.select("source_id", F.col("node_id").alias("ancestor_id"), F.col("subtree_end").alias("ancestor_end"))
    return nodes.join(a, "source_id").filter("node_id > ancestor_id and node_id <= ancestor_end").drop("ancestor_end")


def module_paths(nodes: DataFrame) -> DataFrame:
    """Each module with its path of names from the root and its depth."""
    return _typed(nodes, MODULES, "path array<string>").select("source_id", "node_id", "kind", "name", F.col("p.path").alias("path"), (F.size("p.path") - 1).alias("depth"))


def resolved_instances(nodes: DataFrame) -> DataFrame:
    """Each instance with the module type of its name in the same source; type_node_id null where there is none."""
    types = module_types(nodes).groupBy("source_id", F.col("name_key").alias("type_key")).agg(F.min("node_id").alias("type_node_id"))
    return modules(nodes).filter("kind = 'ModuleTypeInstance'").select("source_id", "node_id", "name", "type_name", "type_key").join(types, ["source_id", "type_key"], "left").drop("type_key")


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """Names declared more than once in one place."""
    return variables(nodes).groupBy("source_id", "owner_node_id", "scope", "name_key").agg(F.count("*").alias("declared")).filter("declared > 1")


def constant_writes(nodes: DataFrame) -> DataFrame:
    """Assignments to a variable that the same source declares Const."""
    const = variables(nodes).filter("is_const").select("source_id", F.col("name_key").alias("key")).distinct()
    targets = nodes.filter((F.col("kind") == "VarRef") & (F.col("role") == "target")).select("source_id", F.col("parent_id").alias("statement_id"), "name", F.split("name_key", r"\.")[0].alias("key"))
    assigned = of_kind(nodes, "Assignment").select("source_id", F.col("node_id").alias("statement_id"))
    return targets.join(assigned, ["source_id", "statement_id"]).join(const, ["source_id", "key"], "left_semi").drop("key")


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.rollup("source_id", "kind").agg(F.count("*").alias("n"))
