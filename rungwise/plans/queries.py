"""The engine's queries over the driver's tables and the same answers in SQL.

The rt_ queries turn tables into program text and read it back through the whole engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.operators import checks
from rungwise.operators.stage import parse_sources
from rungwise.plans import forms, huge, names, positions, views
from rungwise.plans import roundtrip as rt
from rungwise.plans.compiled import column
from rungwise.plans.tables import table
from rungwise.session import checkpointed


def number(name: str = "name", prefix: str = "V"):
    return F.substring(name, len(prefix) + 1, 20).cast("long")


def once(sources: DataFrame, *kinds: str, rendered: bool = False) -> DataFrame:
    """Nodes of these kinds, parsed once however many views a query joins: written to the checkpoint folder, so no executor holds on to them."""
    return checkpointed(parse_sources(sources, kinds=kinds, rendered=rendered))


def only(sources: DataFrame, *kinds: str, rendered: bool = False, columns: tuple[str, ...] | None = None) -> DataFrame:
    return parse_sources(sources, kinds=kinds, rendered=rendered, columns=columns)


# variables


def customer_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("V"), F.col("c_custkey").cast("string"), F.lit(" "), rt.quoted(F.col("c_name")), F.lit(": real := "), rt.real(F.col("c_acctbal")), F.lit(";"))
    rows = table(spark, sf_dir, "customer").withColumn("part", rt.block(F.col("c_custkey")))
    return rt.sources(rows, ["c_nationkey", "part"], "c_custkey", line, ("LOCALVARIABLES\n", "\n"))


def with_format(nodes: DataFrame) -> DataFrame:
    return customer_variables(nodes, "source_id").join(views.programs(nodes).select("source_id", "format"), "source_id").drop("source_id")


def customer_variables(nodes: DataFrame, *more: str) -> DataFrame:
    v = views.variables(nodes)
    return v.select(*more, number().alias("c_custkey"), F.split("source_id", "-")[0].cast("int").alias("c_nationkey"), "datatype", F.col("init_text").cast("double").alias("acctbal"), "description")


def rt_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_variables(only(customer_programs(spark, sf_dir), "Variable"))


CUSTOMERS = "SELECT c_custkey, c_nationkey, 'real' AS datatype, c_acctbal AS acctbal, c_name AS description FROM customer"


def rt_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_format(once(rt.as_markers(customer_programs(spark, sf_dir)), "Program", "BasePicture", "Variable"))


def rt_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_format(once(rt.as_coded(customer_programs(spark, sf_dir)), "Program", "BasePicture", "Variable"))


def datatype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.variables(only(customer_programs(spark, sf_dir), "Variable")).groupBy("datatype").agg(F.count("*").alias("n"))


def rt_var_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    words = F.when(segment == "BUILDING", " Const").when(segment == "AUTOMOBILE", " State").when(segment == "MACHINERY", " OpSave").when(segment == "HOUSEHOLD", " Secure").otherwise(" OpSave Secure")
    line = F.concat(F.lit("V"), F.col("c_custkey").cast("string"), F.when(F.col("c_nationkey") % 2 == 0, ": GLOBAL integer").otherwise(": integer"), words, F.when(F.col("c_custkey") % 3 == 0, " := Default;").when(F.col("c_custkey") % 3 == 1, ";").otherwise(" := -7;"))
    rows = table(spark, sf_dir, "customer").withColumn("part", rt.block(F.col("c_custkey")))
    v = views.variables(only(rt.sources(rows, ["c_nationkey", "part"], "c_custkey", line, ("MODULEPARAMETERS\n", "\n")), "Variable"))
    return v.select(number().alias("c_custkey"), "scope", "is_global", "is_const", "is_state", "is_opsave", "is_secure", "init_kind", F.col("init_text").cast("int").alias("init"))


def rt_time_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd-HH:mm:ss.SSS")
    line = F.concat(F.lit("V"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(": time := Time_Value "), rt.quoted(stamp))).otherwise(F.concat(F.lit(": duration := Duration_Value "), rt.quoted(F.concat((F.col("o_orderkey") % 60).cast("string"), F.lit("s"))))), F.lit(";"))
    rows = table(spark, sf_dir, "orders").withColumn("part", rt.block(F.col("o_orderkey")))
    v = views.variables(only(rt.sources(rows, ["part"], "o_orderkey", line, ("LOCALVARIABLES\n", "\n")), "Variable"))
    return v.select(number().alias("o_orderkey"), "datatype", "init_kind", "init_text", "init_is_duration")


def rt_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('say "'), F.col("p_name"), F.lit('" (* '), F.col("p_type"))
    line = F.concat(F.lit("V"), F.col("p_partkey").cast("string"), F.lit(" "), rt.quoted(text), F.lit(": string := "), rt.quoted(F.concat(F.col("p_brand"), F.lit('""x'))), F.lit(";"))
    rows = table(spark, sf_dir, "part").withColumn("part", rt.block(F.col("p_partkey")))
    v = views.variables(only(rt.sources(rows, ["part"], "p_partkey", line, ("LOCALVARIABLES\n", "\n")), "Variable"))
    return v.select(number().alias("p_partkey"), "description", "init_text", "init_kind")


# records and modules


def rt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit(" "), rt.quoted(F.col("p_name")), F.lit(" = RECORD DateCode_ "), F.col("p_size").cast("string"), F.lit("\nPrice, Cost: real := "), rt.real(F.col("p_retailprice")), F.lit(";\nBrand: string := "), rt.quoted(F.col("p_brand")), F.lit(";\nENDDEF;"))
    rows = table(spark, sf_dir, "part").withColumn("part", rt.block(F.col("p_partkey")))
    nodes = once(rt.sources(rows, ["part"], "p_partkey", line, ("TYPEDEFINITIONS\n", "\n")), "DataType", "Variable")
    types = views.data_types(nodes).select("source_id", F.col("node_id").alias("owner_node_id"), number("name", "P").alias("p_partkey"), F.col("description").alias("p_name"), F.col("datecode").alias("p_size"))
    return views.variables(nodes).select("source_id", "owner_node_id", F.col("name").alias("field"), "datatype", "init_text").join(types, ["source_id", "owner_node_id"]).select("p_partkey", "p_name", "p_size", "field", "datatype", F.when(F.col("datatype") == "real", F.col("init_text").cast("double")).alias("price"))


def rt_module_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every module closes itself: what follows an unclosed one would still be its own
    close = "ENDDEF (*m*);\n"
    leaf = "MODULEDEFINITION DateCode_ 1\n" + rt.LAYOUT + "ENDDEF;\n" + close
    s = table(spark, sf_dir, "supplier").withColumn("part", rt.block(F.col("s_suppkey")))
    suppliers = s.groupBy(F.col("s_nationkey").alias("n_nationkey"), "part").agg(rt.joined("s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(rt.INVOKE + leaf)), "").alias("inner"))
    n = table(spark, sf_dir, "nation").join(suppliers, "n_nationkey")
    nations = n.groupBy(F.col("n_regionkey").alias("r_regionkey"), "part").agg(rt.joined("n_nationkey", F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit(rt.INVOKE + "MODULEDEFINITION DateCode_ 1 ( Frame_Module )\nSUBMODULES\n"), F.col("inner"), F.lit(close)), "").alias("inner"))
    r = table(spark, sf_dir, "region").join(nations, "r_regionkey")
    lines = F.concat(F.lit("SUBMODULES\nR"), F.col("r_regionkey").cast("string"), F.lit(rt.INVOKE + "MODULEDEFINITION DateCode_ 1\nSUBMODULES\n"), F.col("inner"), F.lit(close))
    made = r.select(F.concat_ws("-", "r_regionkey", "part").alias("source_id"), lines.alias("lines")).select("source_id", rt.program(F.col("source_id"), F.col("lines")).alias("content"))
    p = views.module_paths(only(made, *views.MODULES)).filter("depth = 3")
    return p.select(number("name", "S").alias("s_suppkey"), F.array_join(F.slice("path", 2, 3), "/").alias("path"), "depth", "kind")


def rt_param_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(
        F.lit("O"), F.col("o_orderkey").cast("string"), F.lit(rt.INVOKE + "OrderType ( Customer => C"), F.col("o_custkey").cast("string"), F.lit(", Status => "), rt.quoted(F.col("o_orderstatus")),
        F.lit(", Total => "), F.when(F.col("o_orderkey") % 2 == 0, F.lit("GLOBAL Limit")).otherwise(rt.real(F.col("o_totalprice"))), F.lit(");"),
    )
    rows = table(spark, sf_dir, "orders").withColumn("part", rt.block(F.col("o_orderkey")))
    nodes = once(rt.sources(rows, ["part"], "o_orderkey", line, ("SUBMODULES\n", "\n")), "ModuleTypeInstance", "ParameterMapping")
    owner = views.modules(nodes).filter("kind = 'ModuleTypeInstance'").select("source_id", F.col("node_id").alias("instance_node_id"), number("name", "O").alias("o_orderkey"), "type_name")
    m = views.parameter_mappings(nodes).join(owner, ["source_id", "instance_node_id"])
    return m.select("o_orderkey", "type_name", "target", "source_kind", "source_name", "is_global", F.when(F.col("target") == "Status", F.col("source_literal")).alias("status"), F.when(F.col("target") == "Total", F.col("source_literal").cast("double")).alias("total"))


def resolved_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").withColumn("part", F.col("n_regionkey"))
    types = rows.groupBy("part").agg(rt.joined("n_nationkey", F.concat(F.lit("Type"), F.col("n_nationkey").cast("string"), F.lit(" = MODULEDEFINITION DateCode_ 1\n" + rt.LAYOUT + "ENDDEF;")), "\n").alias("types"))
    uses = table(spark, sf_dir, "supplier").join(rows.select(F.col("n_nationkey").alias("s_nationkey"), "part"), "s_nationkey").withColumn("blk", rt.block(F.col("s_suppkey")))
    # every third instance names a type that no source defines
    name = F.when(F.col("s_suppkey") % 3 == 0, F.lit("Nowhere")).otherwise(F.concat(F.lit("TYPE"), F.col("s_nationkey").cast("string")))
    insts = uses.groupBy("part", "blk").agg(rt.joined("s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(rt.INVOKE), name, F.lit(";")), "\n").alias("insts"))
    made = insts.join(types, "part").select(F.concat_ws("-", "part", "blk").alias("source_id"), F.concat(F.lit("TYPEDEFINITIONS\n"), "types", F.lit("\nSUBMODULES\n"), "insts", F.lit("\n")).alias("lines"))
    nodes = once(made.select("source_id", rt.program(F.col("source_id"), F.col("lines")).alias("content")), "ModuleTypeInstance", "ModuleTypeDef")
    return views.resolved_instances(nodes).select(number("name", "S").alias("s_suppkey"), "type_name", F.col("type_node_id").isNotNull().alias("resolved"))


# code


def lineitem_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(
        F.lit("L"), F.concat_ws("_", "l_orderkey", "l_linenumber"), F.lit(" = "), rt.real(F.col("l_extendedprice")), F.lit(" * (1 - "), rt.real(F.col("l_discount")), F.lit(");\n"),
    )
    rows = table(spark, sf_dir, "lineitem").withColumn("part", rt.block(F.col("l_orderkey") * 7 + F.col("l_linenumber"))).withColumn("o", F.struct("l_orderkey", "l_linenumber"))
    return rt.sources(rows, ["part"], "o", line, ("ModuleCode\nEQUATIONBLOCK Main" + rt.PLACE + ":\n", ""), in_layout=True)


def rt_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.statements(only(lineitem_programs(spark, sf_dir), "Assignment", rendered=True, columns=("kind", "name", "rendered")))
    keys = F.split(F.substring("name", 2, 30), "_")
    parts = F.split(F.regexp_extract("rendered", r"= (.*)$", 1), r" [*-] ")
    return s.select(
        keys[0].cast("long").alias("l_orderkey"), keys[1].cast("int").alias("l_linenumber"), "kind",
        F.regexp_replace(parts[0], r"[()]", "").cast("double").alias("price"), F.regexp_replace(parts[2], r"[()]", "").cast("double").alias("discount"),
    )


def expression_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node counts by kind and operator below the assignments of lineitem."""
    e = views.expressions(only(lineitem_programs(spark, sf_dir), *views.EXPRESSIONS, columns=("role", "kind", "name", "props")))
    return e.groupBy("kind", "role", "literal_type", F.when(F.col("kind") == "BinOp", F.col("name")).alias("operator")).agg(F.count("*").alias("n"))


def rt_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IF with two branches and an ELSE for each order; which branch holds which assignment."""
    k = F.col("o_orderkey").cast("string")
    line = F.concat(F.lit("IF T"), k, F.lit(" > 100.5 AND NOT (S"), k, F.lit(" <> 1) THEN A"), k, F.lit(" = 1; ELSIF Check(S"), k, F.lit(", -2) THEN B"), k, F.lit(" = 2; (* note *) ELSE C"), k, F.lit(":New = 3; ENDIF;"))
    line = F.replace(line, F.lit(":New ="), F.lit(" ="))
    rows = table(spark, sf_dir, "orders").withColumn("part", rt.block(F.col("o_orderkey")))
    s = views.statements(only(rt.sources(rows, ["part"], "o_orderkey", line, ("ModuleCode\nEQUATIONBLOCK Main" + rt.PLACE + ":\n", "\n"), in_layout=True), "Assignment", rendered=True))
    return s.filter("kind = 'Assignment'").select(number("name", "A").alias("o_orderkey"), F.substring("name", 1, 1).alias("target"), "role", F.substring_index("rendered", "= ", -1).cast("int").alias("value"))


def rt_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), r"[(*)]", "")
    line = F.concat(F.lit("(*"), F.concat_ws("_", "conv_id", "turn"), F.lit("|"), body, F.lit(" (* inner *)*)"))
    rows = table(spark, sf_dir, "conversations").withColumn("part", rt.block(F.col("conv_id") * 16)).withColumn("more", rt.block(F.col("turn"))).withColumn("o", F.struct("conv_id", "turn"))
    c = views.comments(only(rt.sources(rows, ["part", "more"], "o", line, ("ModuleCode\n", "\n"), in_layout=True), "Comment")).filter("role = 'code'")
    key = F.split(F.substring_index("content", "|", 1), "_")
    return c.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def event_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence per user and block of events: a step and a transition for each event, in time order."""
    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id")).withColumn("part", rt.block(F.col("event_id") / 50))
    k = F.col("event_id").cast("string")
    line = F.concat(F.lit("SEQSTEP E"), k, F.lit("\nENTERCODE\nKind = "), rt.quoted(F.col("event_type")), F.lit(";\nSEQTRANSITION T"), k, F.lit(" WAIT_FOR Value >= "), rt.real(F.col("value")))
    users = e.groupBy("user_id", "part").agg(rt.joined("o", line).alias("lines"))
    name = F.concat_ws("-", "user_id", "part")
    body = F.concat(F.lit("ModuleCode\nSEQUENCE Main (SeqControl)" + rt.PLACE + "\n"), "lines", F.lit("\nENDSEQUENCE\n"))
    return users.select(name.alias("source_id"), rt.program(name, F.lit(""), body).alias("content"))


def rt_chart_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = once(event_programs(spark, sf_dir), *views.CHART)
    steps = views.chart_nodes(nodes)
    edges = views.chart_edges(nodes).filter("kind = 'next'").join(steps.select("source_id", F.col("node_id").alias("from_node"), F.col("kind").alias("from_kind"), F.col("name").alias("from_name")), ["source_id", "from_node"])
    return edges.select(F.split("source_id", "-")[0].cast("long").alias("user_id"), "from_kind", "from_name", "to_name")


def rt_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation an alternative with a branch for every supplier block; counts of each kind of edge."""
    s = table(spark, sf_dir, "supplier").withColumn("part", F.floor(F.col("s_suppkey") / 20).cast("long"))
    branch = F.concat(F.lit("SEQTRANSITION T"), F.col("s_suppkey").cast("string"), F.lit(" WAIT_FOR True\nSEQSTEP S"), F.col("s_suppkey").cast("string"), F.lit("\nSEQFORK Start, Lost"))
    made = s.groupBy("s_nationkey", "part").agg(rt.joined("s_suppkey", branch, "\nALTERNATIVEBRANCH\n").alias("b"))
    body = F.concat(F.lit("ModuleCode\nSEQUENCE Main" + rt.PLACE + "\nSEQINITSTEP Start\nALTERNATIVESEQ\nSEQTRANSITION First WAIT_FOR False\nALTERNATIVEBRANCH\n"), "b", F.lit("\nENDALTERNATIVE\nENDSEQUENCE\n"))
    nodes = once(made.select(F.concat_ws("-", "s_nationkey", "part").alias("source_id"), body.alias("b")).select("source_id", rt.program(F.col("source_id"), F.lit(""), F.col("b")).alias("content")), *views.CHART)
    e = views.chart_edges(nodes).withColumn("s_nationkey", F.split("source_id", "-")[0].cast("int"))
    return e.groupBy("s_nationkey", F.col("kind").alias("edge")).agg(F.count("*").alias("n"), F.count("to_node").alias("n_resolved"))


# layout


def rt_graphics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.concat(
        F.when(k % 2 == 0, F.lit("RectangleObject")).otherwise(F.lit("OvalObject")), F.lit(" ( "), rt.real(k.cast("double")), F.lit(" , 0.0 ) ( 1.0 , "), rt.real(F.col("p_size").cast("double")), F.lit(" )"),
        F.when(k % 3 == 0, F.concat(F.lit(" Layer_ = "), F.col("p_size").cast("string"))).otherwise(F.lit("")),
        F.lit(' Enable_ = True : InVar_ "'), F.col("p_brand"), F.lit('" OutlineColour : Colour0 = '), (k % 7).cast("string"),
    )
    rows = table(spark, sf_dir, "part").withColumn("part", rt.block(k))
    nodes = once(rt.sources(rows, ["part"], "p_partkey", line, ("GraphObjects : Layer_ = 99\n", "\n"), in_layout=True), "GraphObject", "Binding", "Colour")
    g = views.graph_objects(nodes)
    bound = views.bindings(nodes).filter("role = 'enable'").select("source_id", F.col("parent_id").alias("node_id"), "literal")
    colour = nodes.filter("kind = 'Colour'").select("source_id", F.col("parent_id").alias("node_id"), F.get_json_object("props", "$.colour0").cast("int").alias("colour"))
    return g.join(bound, ["source_id", "node_id"]).join(colour, ["source_id", "node_id"]).select(F.col("coords")[0][0].cast("long").alias("p_partkey"), "type", "layer", F.col("coords")[1][1].alias("height"), F.col("literal").alias("brand"), "colour")


def rt_interact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    line = F.concat(F.lit("ComBut_ ( 0.0 , 0.0 ) ( 1.0 , 1.0 )\nBool_Value\nVariable = False : OutVar_ "), rt.quoted(F.concat(F.lit("S"), k)), F.lit(" ToggleAction Abs_"))
    rows = table(spark, sf_dir, "supplier").withColumn("part", rt.block(F.col("s_suppkey")))
    nodes = once(rt.sources(rows, ["part"], "s_suppkey", line, ("InteractObjects :\n", "\n"), in_layout=True), "InteractObject", "Property", "Binding")
    b = views.bindings(nodes).filter("role = 'tail'").select("source_id", F.col("parent_id").alias("property_id"), "direction", "literal")
    owned = nodes.filter("kind = 'Property'").select("source_id", F.col("node_id").alias("property_id"), F.col("parent_id").alias("node_id"), F.col("name").alias("property"))
    i = views.interact_objects(nodes).select("source_id", "node_id", "type", F.array_join("flags", " ").alias("flags"))
    return i.join(owned, ["source_id", "node_id"]).join(b, ["source_id", "property_id"]).select(number("literal", "S").alias("s_suppkey"), "type", "flags", "property", "direction")


# diagnostics and structure


def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth order's program lacks the semicolon after its only assignment: where the engine says so."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit("ModuleCode\nEQUATIONBLOCK Main" + rt.PLACE + ":\nX = "), k.cast("string"), F.when(k % 5 == 0, F.lit("\n")).otherwise(F.lit(";\n")))
    made = rt.dealt(table(spark, sf_dir, "orders"), "o_orderkey").select(k.cast("string").alias("source_id"), rt.program(k.cast("string"), F.lit(""), body).alias("content"))
    e = views.parse_errors(only(made, "ParseError"))
    return e.select(F.col("source_id").cast("long").alias("o_orderkey"), "stage", "error_class", "line", "col", F.array_contains("expected", ";").alias("wants_semicolon"))


def parse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    made = rt.dealt(table(spark, sf_dir, "customer"), "c_custkey").select(k.cast("string").alias("source_id"), F.when(k % 4 == 0, F.lit("no program")).otherwise(rt.program(k.cast("string"), F.lit(""))).alias("content"))
    return views.parse_runs(only(made, "Program")).groupBy("success", "error_class").agg(F.count("*").alias("n"))


def program_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rt.dealt(table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").cast("string").alias("source_id"), rt.program(F.col("c_name"), F.lit("")).alias("content"))
    return views.programs(once(made, "Program", "BasePicture")).select(F.col("source_id").cast("long").alias("c_custkey"), "program_name", "root_name", "format")


def kind_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.kind_counts(parse_sources(customer_programs(spark, sf_dir), rendered=False))
    return n.groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.col("source_id").isNull().cast("int")).alias("totals"))


def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("Seg")).otherwise(F.lit("SEG")), F.substring("c_mktsegment", 1, 4), F.lit(": integer;"))
    rows = table(spark, sf_dir, "customer").withColumn("part", rt.block(F.col("c_custkey")))
    d = views.duplicate_names(parse_sources(rt.sources(rows, ["c_nationkey", "part"], "c_custkey", line, ("LOCALVARIABLES\n", "\n"))))
    return d.groupBy("name_key").agg(F.count("*").alias("programs"), F.sum("declared").alias("declared"))


def constant_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").withColumn("part", rt.block(F.col("o_orderkey")))
    grouped = rows.groupBy("part").agg(
        rt.joined("o_orderkey", F.concat(F.lit("V"), k, F.when(F.col("o_orderstatus") == "F", F.lit(": integer Const;")).otherwise(F.lit(": integer;")))).alias("v"),
        rt.joined("o_orderkey", F.concat(F.lit("v"), k, F.lit(" = 1;"))).alias("s"),
    )
    text = F.concat(F.lit(rt.HEAD), F.col("part").cast("string"), F.lit(rt.ROOT + "LOCALVARIABLES\n"), "v", F.lit("\n" + rt.LAYOUT + "ModuleCode\nEQUATIONBLOCK Main" + rt.PLACE + ":\n"), "s", F.lit("\n" + rt.END))
    nodes = once(grouped.select(F.col("part").cast("string").alias("source_id"), text.alias("content")), "Variable", "VarRef", "Assignment")
    return views.constant_writes(nodes).select(number("name", "v").alias("o_orderkey"))


# positions and text


def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.lines(table(spark, sf_dir, "documents"), "doc_id")


def line_col_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = docs.select("doc_id", F.explode(F.array(F.lit(0), F.floor(F.length("text") / 3).cast("int"), F.length("text"))).alias("at")).distinct()
    return positions.line_of(at, docs, "doc_id")


def huge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents, each text in chunks of 2,000 characters that any task may have."""
    return huge.lines(huge.chunks_of(table(spark, sf_dir, "documents"), "doc_id", size=2000), "doc_id")


def huge_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings and comments of every document, quoted and then commented out, found in chunks of 500 characters: how many of each kind, and how long."""
    plain = F.translate(F.coalesce("text", F.lit("")), '"*()', "'x[]")
    text = F.concat(F.lit('(* "a" (* b *) *) '), rt.quoted(plain), F.lit(' "x""y" (* '), plain, F.lit(' *) "open (* '), plain)
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    found = huge.opaque(huge.chunks_of(docs, "doc_id", size=500), "doc_id")
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))


def anchor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), F.when(F.col("event_type") != "click", F.col("event_id") * 2).alias("real"))
    return positions.anchors(e, "user_id")


def marker_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 60
    # strings and comments, which nest, are no place for markers; every hundredth event has a string of 100,000 characters
    long = F.when(F.col("event_id") % 100 == 0, F.lit(100_000)).otherwise(F.lit(0))
    text = F.concat(F.repeat(F.lit("#6> word "), n.cast("int")), F.lit('"#71 in a string" (* #72 (* #73 *) #74 in a comment *) "'), F.repeat(F.lit("z"), long), F.lit('" '), F.repeat(F.lit("plain text "), (F.col("event_id") % 200).cast("int")), F.when(F.col("event_id") % 3 == 0, F.lit("MODULEDEFINITION")).otherwise(F.lit("")))
    made = rt.dealt(table(spark, sf_dir, "events"), "event_id").select(F.col("event_id").cast("string").alias("source_id"), text.alias("content"))
    return checks.marker_facts(made).select(F.col("source_id").cast("long").alias("event_id"), "n_markers", "compressed")


def identifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("[A-Za-z_][A-Za-z0-9_]*")).cast("long").alias("n_identifiers"))


def string_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit('"[^\\n"]*"')).cast("long").alias("n_strings"))


def key_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's printable ASCII under the coded format's keys: the sum of the stored bytes, and of the bytes read back."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "")
    codes = F.transform(F.split(plain, ""), lambda c: F.ascii(c))
    coded = F.transform(codes, lambda b, n: b.bitwiseXOR((7 * n + 8) % 128))
    back = F.transform("coded", lambda b, n: b.bitwiseXOR((7 * n + 8) % 128))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length(plain).alias("n"), F.when(F.length(plain) > 0, coded).otherwise(F.array().cast("array<int>")).alias("coded"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("doc_id", "n", total(F.col("coded")).alias("stored"), total(back).alias("plain"))


def compiled_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'IF l_returnflag == "R" THEN -l_quantity ELSIF l_discount >= 0.05 AND NOT (l_tax > 0.02 OR l_linenumber == 1) THEN l_extendedprice * (1 - l_discount) ELSE l_quantity + l_linenumber * 2 ENDIF'
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", column(text).alias("value"))


# marker text that needs repairs


#: Name and kind of each repair, a text that needs it, the text it gives, and how many characters of that are made up; {k} stands for a key. The last three need none, or several in order.
REPAIRED = [
    ("enddef_trailing_semi", "syntax", "A{k} ENDDEF ;", "A{k} ENDDEF", 0),
    ("semi_before_assign", "syntax", "A{k} ; := 2", "A{k}  := 2", 0),
    ("endif_semi_comma", "syntax", "F{k} ENDIF; , 2", "F{k} ENDIF, 2", 0),
    ("endif_semi_paren", "syntax", "F{k} ENDIF; )", "F{k} ENDIF)", 0),
    ("empty_assign_default", "semantic", "A{k} := ;", "A{k} := Default;", 7),
    ("graphobjects_interact_prefix", "syntax", "GraphObjects : InteractObjects : B{k}", "InteractObjects : B{k}", 0),
    ("duration_str_value", "semantic", 'duration OpSave := "{k}s";', 'duration OpSave := Duration_Value "{k}s";', 15),
    ("time_str_value", "semantic", 'TIME := "{k}"', 'TIME := Time_Value "{k}"', 11),
    ("date_timestamp_value", "semantic", 'p{k} => "2025-10-11-12:13:14.150"', 'p{k} => Time_Value "2025-10-11-12:13:14.150"', 11),
    ("execute_local_enddef", "syntax", "ExecuteLocalOld = ExecuteLocal:Old ENDDEF {k}", "ExecuteLocalOld = ExecuteLocal:Old; ENDDEF {k}", 1),
    ("execute_state_if", "syntax", "ExecuteState:Old IF A{k}", "ExecuteState:Old; IF A{k}", 1),
    ("endif_no_terminator", "syntax", "ENDIF A{k}", "ENDIF; A{k}", 1),
    ("graphobjects_enddef_empty", "syntax", "GraphObjects : ENDDEF A{k}", "ENDDEF A{k}", 0),
    ("type_enddef_terminator", "syntax", "A{k}: real ENDDEF", "A{k}: real ; ENDDEF", 2),
    ("enable_outvar_invar", "compat", "Enable_ = T{k} : OutVar_ x", "Enable_ = T{k} : InVar_ x", 2),
    ("truevar_prefix", "compat", "b{k} := TrueVar", "b{k} := TTrueVar", 1),
    ("equationblock_modulecode", "semantic", "EQUATIONBLOCK E{k}", "ModuleCode EQUATIONBLOCK E{k}", 11),
    ("empty_trailing_arg", "semantic", "Max(b{k}, )", "Max(b{k}, 0)", 1),
    ("", "", "#01Last{k} * (* #71 *)", "(Last{k} * (* #71 *)", 1),
    ("", "", 'p{k} => "2025"', 'p{k} => "2025"', 0),
    ("semi_before_assign empty_assign_default", "syntax semantic", "A{k}; := ;", "A{k} := Default;", 7),
]


def rt_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in turn as texts that need each of the repairs: the text they give, the repairs' names and kinds, and the characters that no original has."""
    key = F.col("p_partkey").cast("string")
    raw = F.element_at(F.array(*[F.replace(F.lit(x[2]), F.lit("{k}"), key) for x in REPAIRED]), (F.col("p_partkey") % len(REPAIRED) + 1).cast("int"))
    made = rt.dealt(table(spark, sf_dir, "part"), "p_partkey").select(key.alias("source_id"), raw.alias("content"))
    d = checks.documents(made, always=True)
    return d.select(
        F.col("source_id").cast("long").alias("p_partkey"), "normalized", F.array_join("repairs", " ").alias("repairs"), F.array_join("repair_kinds", " ").alias("kinds"),
        F.coalesce(F.size(F.filter("char_map", lambda x: x < 0)), F.lit(0)).alias("n_made_up"),
    )


def rt_marker_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the marker text where the engine says that names stand, and whether line and column are those of the place."""
    k = F.col("o_orderkey").cast("string")
    line = F.concat(F.lit("IF T"), k, F.lit(" AND S"), k, F.lit(" THEN A"), k, F.lit(" = NOT B"), k, F.lit("; ENDIF;"))
    rows = table(spark, sf_dir, "orders").withColumn("part", rt.block(F.col("o_orderkey")))
    made = rt.as_markers(rt.sources(rows, ["part"], "o_orderkey", line, ("ModuleCode\nEQUATIONBLOCK Main" + rt.PLACE + ":\n", "\n"), in_layout=True))
    # a program's lines are one row, and every join is on the source alone: names are moved once, and never with their program's text
    lines = positions.lines(made, "source_id", "content").groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("line", F.struct("start", "length")))).alias("lines"))
    refs = only(made, "VarRef").select("source_id", "name", "start", "end", "line", "col")
    refs = refs.join(made.join(lines, "source_id"), "source_id").withColumn("begun", F.try_element_at("lines", "line")).filter("begun IS NOT NULL")
    return refs.select(
        number("name", "A").alias("o_orderkey"), "name", F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"),
        F.col("start").between(F.col("begun.start"), F.col("begun.start") + F.col("begun.length")).alias("line_fits"), (F.col("start") - F.col("begun.start") + 1 == F.col("col")).alias("col_fits"),
    )


def rt_marker_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth order's program, in marker text, lacks the semicolon after its only assignment: where in the marker text the engine says so, which is at the last real character before the made-up word."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit("ModuleCode\nEQUATIONBLOCK Main" + rt.PLACE + ":\nX = "), k.cast("string"), F.when(k % 5 == 0, F.lit("\n")).otherwise(F.lit(";\n")))
    made = rt.as_markers(rt.dealt(table(spark, sf_dir, "orders"), "o_orderkey").select(k.cast("string").alias("source_id"), rt.program(k.cast("string"), F.lit(""), body).alias("content")))
    e = views.parse_errors(parse_sources(made, kinds=("ParseError",), rendered=False, keep=("content",)), "content")
    return e.select(F.col("source_id").cast("long").alias("o_orderkey"), "stage", "line", "col", F.substring("content", F.col("offset") + 1, F.lit(3)).alias("found"), F.substring("context", F.col("caret") + 1, F.lit(3)).alias("shown"))


def rt_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs in Latin-1 and UTF-8 by turns, lines ended by CR LF."""
    line = F.concat(F.lit("Åk"), F.col("c_custkey").cast("string"), F.lit(" "), rt.quoted(F.concat(F.lit("é ü "), F.col("c_name"))), F.lit(": integer;"))
    rows = table(spark, sf_dir, "customer").withColumn("part", rt.block(F.col("c_custkey")))
    made = rt.sources(rows, ["part"], "c_custkey", line, ("LOCALVARIABLES\n", "\n"))
    ended = F.replace(F.col("content"), F.lit("\n"), F.lit("\r\n"))
    content = F.when(F.col("source_id").cast("long") % 2 == 0, F.encode(ended, "ISO-8859-1")).otherwise(F.encode(ended, "UTF-8"))
    v = views.variables(only(made.select("source_id", content.alias("content")), "Variable"))
    return v.select(number("name", "Åk").alias("c_custkey"), "name", "description")


# layout with all its options


def rt_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for every supplier, whose layout has the options that its key calls for."""
    k = F.col("s_suppkey")
    line = F.concat(
        F.lit("S"), k.cast("string"), F.lit(rt.INVOKE + "MODULEDEFINITION DateCode_ 1\nModuleDef\nClippingBounds = ( -1.0 , -1.0 ) ( "), rt.real(k.cast("double")), F.lit(" , 1.0 )\n"),
        F.when(k % 2 == 0, F.concat(F.lit("Two_Layers_ LayerLimit_ = "), rt.real(k % 10 / 4.0), F.lit("\n"))).otherwise(F.lit("")),
        F.when(k % 3 == 0, F.lit("Zoomable\n")).otherwise(F.lit("")), F.when(k % 5 == 0, F.lit("Grid = 0.25\n")).otherwise(F.lit("")),
        F.when(k % 7 == 0, F.lit("ZoomLimits = 0.5 2.0\n")).otherwise(F.lit("")), F.lit("ENDDEF;\nENDDEF (*m*);"),
    )
    rows = table(spark, sf_dir, "supplier").withColumn("part", rt.block(k))
    d = views.module_defs(only(rt.sources(rows, ["part"], "s_suppkey", line, ("SUBMODULES\n", "\n")), "ModuleDef").filter("depth > 2"))
    return d.select(F.col("clipping_bounds")[1][0].cast("long").alias("s_suppkey"), "layer_limit", "zoomable", (F.col("grid") == 0.25).alias("fine"), F.col("zoom_limits")[1].alias("zoom"))


def rt_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven shapes in turn; the layer is the part's key."""
    k = F.col("p_partkey")
    box = "( 0.0 , 0.0 ) ( 1.0 , 1.0 )"
    heads = [F.concat(F.lit(f"TextObject {box} "), rt.quoted(F.col("p_name")), F.lit(" VarName Width_ = 8 RightAligned")), *(F.lit(f"{x} {box}") for x in ("RectangleObject", "LineObject", "OvalObject")), F.lit(f"SegmentObject {box} ( 2.0 , 2.0 )"), F.lit(f"PolygonObject Polyline Connection {box} ( 3.0 , 3.0 )"), F.lit("CompositeObject")]
    line = F.concat(
        F.element_at(F.array(*heads), (k % 7 + 1).cast("int")), F.lit(" Layer_ = "), k.cast("string"), F.lit(" OutlineColour : Width_ = "), F.col("p_size").cast("string"),
        F.lit(" Colour0 = 1 FillColour : Colour1 = "), (k % 9).cast("string"), F.lit(" ColourStyle = True"),
    )
    rows = table(spark, sf_dir, "part").withColumn("part", rt.block(k))
    nodes = once(rt.sources(rows, ["part"], "p_partkey", line, ("GraphObjects :\n", "\n"), in_layout=True), "GraphObject", "Colour")
    facts = F.from_json("props", "width int, colour1 int, style string, texts array<string>, points array<array<double>>, types array<string>").alias("p")
    colours = views.of_kind(nodes, "Colour").select("source_id", F.col("parent_id").alias("node_id"), "name", facts).groupBy("source_id", "node_id").agg(F.max("p.width").alias("width"), F.max("p.colour1").alias("fill"), F.max("p.style").alias("style"), F.count("*").cast("int").alias("n_colours"))
    shapes = views.of_kind(nodes, "GraphObject").select("source_id", "node_id", F.col("name").alias("type"), F.get_json_object("props", "$.layer").cast("long").alias("p_partkey"), facts)
    return shapes.join(colours, ["source_id", "node_id"]).select("p_partkey", "type", F.greatest(F.size("p.points"), F.lit(0)).alias("n_points"), F.array_join("p.types", " ").alias("types"), F.col("p.texts")[0].alias("text"), "width", "fill", "style", "n_colours")


def rt_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedure buttons: the procedure called and its arguments, literal or bound."""
    k = F.col("s_suppkey").cast("string")
    line = F.concat(F.lit("ComButProc_ ( 0.0 , 0.0 ) ( 1.0 , 1.0 )\nCall"), k, F.lit(" "), rt.quoted(F.col("s_name")), F.lit(' : InVar_ LitString "p" False '), k, F.lit(" : OutVar_ Out"), k)
    rows = table(spark, sf_dir, "supplier").withColumn("part", rt.block(F.col("s_suppkey")))
    nodes = once(rt.sources(rows, ["part"], "s_suppkey", line, ("InteractObjects :\n", "\n"), in_layout=True), "InteractObject", "Procedure", "Literal", "Binding")
    calls = views.of_kind(nodes, "Procedure").select("source_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("button"), "name")
    buttons = views.interact_objects(nodes).select("source_id", F.col("node_id").alias("button"), "type")
    arguments = nodes.filter("role = 'argument'").groupBy("source_id", "parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("literal", "name").alias("x")))), lambda a: a["x"]), "|").alias("arguments"))
    return calls.join(arguments, ["source_id", "parent_id"]).join(buttons, ["source_id", "button"]).select(number("name", "Call").alias("s_suppkey"), "type", "arguments")


def rt_charts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence with every kind of element for each supplier: what is found, by kind and place."""
    k = F.col("s_suppkey").cast("string")
    elements = (
        "SEQINITSTEP Init ENTERCODE A = 1; ACTIVECODE B = 2; EXITCODE C = 3;\nSEQTRANSITION Go WAIT_FOR A > 0\nPARALLELSEQ SEQSTEP P1 PARALLELBRANCH SEQSTEP P2 PARALLELBRANCH SEQSTEP P3 ENDPARALLEL\n"
        "SUBSEQUENCE Sub SEQSTEP Inner ENDSUBSEQUENCE\nSUBSEQTRANSITION SubT SEQSTEP Inner2 ENDSUBSEQTRANSITION\nALTERNATIVESEQ SEQTRANSITION T1 WAIT_FOR B SEQBREAK ALTERNATIVEBRANCH SEQTRANSITION T2 WAIT_FOR C SEQFORK Init ENDALTERNATIVE\n"
    )
    body = F.concat(F.lit("ModuleCode\nOPENSEQUENCE S"), k, F.lit(" (SeqControl, SeqTimer)" + rt.PLACE + "\n" + elements + "ENDOPENSEQUENCE\n"))
    made = rt.dealt(table(spark, sf_dir, "supplier"), "s_suppkey").select(k.alias("source_id"), rt.program(k, F.lit(""), body).alias("content"))
    nodes = once(made, "Sequence", "Assignment", *views.CHART)
    s = views.sequences(nodes).select("source_id", "type", "control", "timer")
    n = nodes.filter("kind <> 'Sequence'").groupBy("source_id", "kind", "role").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("name")), " ").alias("names"))
    return n.join(s, "source_id").select(F.col("source_id").cast("long").alias("s_suppkey"), "kind", "role", "n", "names", "type", "control", "timer")


def rendered_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program with two variables and an instance for every supplier, as text for people."""
    k = F.col("s_suppkey").cast("string")
    sections = F.concat(F.lit("LOCALVARIABLES\nA"), k, F.lit(": integer := 7;\nLonger "), rt.quoted(F.col("s_name")), F.lit(": real;\nSUBMODULES\nI"), k, F.lit(rt.INVOKE + "Type ( P => V"), k, F.lit(", Q => GLOBAL g );\n"))
    made = rt.dealt(table(spark, sf_dir, "supplier"), "s_suppkey").select(k.alias("source_id"), rt.program(k, sections).alias("content"))
    return checks.summaries(made).select(F.col("source_id").cast("long").alias("s_suppkey"), "summary")


def deep_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression inside as many brackets as the nation's key times 100: its operators."""
    depth = (F.col("n_nationkey") * 100).cast("int")
    body = F.concat(F.lit("ModuleCode\nEQUATIONBLOCK Main" + rt.PLACE + ":\nX = "), F.repeat(F.lit("(1 + "), depth), F.lit("2"), F.repeat(F.lit(")"), depth), F.lit(";\n"))
    made = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("source_id"), rt.program(F.col("n_name"), F.lit(""), body).alias("content"))
    e = parse_sources(made, kinds=("BinOp", "Assignment"), rendered=False)
    return e.groupBy("source_id").agg(F.count(F.when(F.col("kind") == "BinOp", 1)).alias("n_operators"), F.count(F.when(F.col("kind") == "ParseError", 1)).alias("n_errors")).select(F.col("source_id").cast("int").alias("n_nationkey"), "n_operators", "n_errors")


def soup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random text for every customer, its key the seed: none crashes the engine, none takes ten seconds."""
    found = checks.runs(checks.soups(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed"))))
    crashed = ~F.col("success") & ~F.col("error_class").isin(*checks.EXPECTED)
    return found.agg(F.count("*").alias("n"), F.count_if(crashed).alias("n_crashes"), F.count_if(F.col("duration_ms") > 10_000).alias("n_slow"))


NAMES = """rt_variables rt_compressed rt_coded datatype_counts rt_var_modifiers rt_time_values rt_strings rt_records rt_module_tree rt_param_mappings resolved_types rt_statements expression_shape
rt_conditions rt_comments rt_chart_edges rt_alternatives rt_graphics rt_interact parse_failures parse_runs program_names kind_rollup duplicate_names constant_writes line_index line_col_lookup
anchor_lookup marker_ratio identifier_counts string_literals key_stream compiled_expression huge_lines huge_regions rt_repairs rt_marker_positions rt_marker_errors rt_encodings rt_layout rt_shapes rt_procedures rt_charts_all rendered_summaries deep_nesting soup_runs""".split()


#: Modules that hold further queries.
MORE = (forms, names)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES} | {k: f for m in MORE for k, f in m.QUERIES.items()}


def _repaired(at: int) -> str:
    """One column of REPAIRED by a part's turn; {k} becomes its key."""
    cell = lambda x: str(x) if at == 4 else "'" + x.replace("'", "''").replace("{k}", "' || p_partkey || '") + "'"
    return f"CASE p_partkey % {len(REPAIRED)} " + " ".join(f"WHEN {n} THEN {cell(x[at])}" for n, x in enumerate(REPAIRED)) + " END"


SEGMENT = "left(c_mktsegment, 4)"
SQL = {
    "rt_variables": CUSTOMERS,
    "rt_compressed": f"SELECT *, 'compressed' AS format FROM ({CUSTOMERS})",
    "rt_coded": f"SELECT *, 'coded' AS format FROM ({CUSTOMERS})",
    "datatype_counts": "SELECT 'real' AS datatype, count(*) AS n FROM customer",
    "rt_var_modifiers": """
        SELECT c_custkey, 'parameter' AS scope, c_nationkey % 2 = 0 AS is_global, c_mktsegment = 'BUILDING' AS is_const, c_mktsegment = 'AUTOMOBILE' AS is_state,
               c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'HOUSEHOLD') AS is_opsave, c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') AS is_secure,
               CASE c_custkey % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'absent' ELSE 'integer' END AS init_kind, CASE WHEN c_custkey % 3 = 2 THEN -7 END AS init
        FROM customer""",
    "rt_time_values": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'time' ELSE 'duration' END AS datatype, CASE WHEN o_orderkey % 2 = 0 THEN 'time' ELSE 'string' END AS init_kind,
               CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d-%H:%M:%S.%g') ELSE (o_orderkey % 60) || 's' END AS init_text, o_orderkey % 2 = 1 AS init_is_duration
        FROM orders""",
    "rt_strings": """SELECT p_partkey, 'say "' || p_name || '" (* ' || p_type AS description, p_brand || '""x' AS init_text, 'string' AS init_kind FROM part""",
    "rt_records": """
        SELECT p_partkey, p_name, p_size::BIGINT AS p_size, f.field, CASE WHEN f.field = 'Brand' THEN 'string' ELSE 'real' END AS datatype, CASE WHEN f.field <> 'Brand' THEN p_retailprice END AS price
        FROM part, (VALUES ('Price'), ('Cost'), ('Brand')) f(field)""",
    "rt_module_tree": """
        SELECT s_suppkey, 'R' || r_regionkey || '/N' || n_nationkey || '/S' || s_suppkey AS path, 3 AS depth, 'SingleModule' AS kind
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "rt_param_mappings": """
        SELECT o_orderkey, 'OrderType' AS type_name, target, CASE WHEN target = 'Customer' OR target = 'Total' AND o_orderkey % 2 = 0 THEN 'variable' ELSE 'value' END AS source_kind,
               CASE WHEN target = 'Customer' THEN 'C' || o_custkey WHEN target = 'Total' AND o_orderkey % 2 = 0 THEN 'Limit' END AS source_name, target = 'Total' AND o_orderkey % 2 = 0 AS is_global,
               CASE WHEN target = 'Status' THEN o_orderstatus END AS status, CASE WHEN target = 'Total' AND o_orderkey % 2 = 1 THEN o_totalprice END AS total
        FROM orders, (VALUES ('Customer'), ('Status'), ('Total')) t(target)""",
    "resolved_types": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Nowhere' ELSE 'TYPE' || s_nationkey END AS type_name, s_suppkey % 3 <> 0 AS resolved FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "rt_statements": "SELECT l_orderkey, l_linenumber, 'Assignment' AS kind, l_extendedprice AS price, l_discount AS discount FROM lineitem",
    "expression_shape": """
        SELECT kind, role, literal_type, operator, (SELECT count(*) FROM lineitem) AS n
        FROM (VALUES ('VarRef', 'target', NULL, NULL), ('BinOp', 'value', NULL, '*'), ('Literal', 'left', 'real', NULL), ('BinOp', 'right', NULL, '-'), ('Literal', 'left', 'integer', NULL), ('Literal', 'right', 'real', NULL)) t(kind, role, literal_type, operator)""",
    "rt_conditions": "SELECT o_orderkey, target, role, value FROM orders, (VALUES ('A', 'then:0', 1), ('B', 'then:1', 2), ('C', 'else', 3)) t(target, role, value)",
    "rt_comments": r"""
        SELECT conv_id, turn, length(body) AS n_chars, md5(body) AS digest
        FROM (SELECT conv_id, turn, '(*' || conv_id || '_' || turn || '|' || regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[(*)]', '', 'g') || ' (* inner *)*)' AS body FROM conversations)""",
    "rt_chart_edges": """
        SELECT user_id, 'Step' AS from_kind, 'E' || event_id AS from_name, 'T' || event_id AS to_name FROM events
        UNION ALL SELECT user_id, 'Transition', 'T' || event_id, 'E' || follower
        FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id, event_id // 10000 ORDER BY ts, event_id) AS follower FROM events) WHERE follower IS NOT NULL""",
    "rt_alternatives": """
        WITH p AS (SELECT s_nationkey, s_suppkey // 20 AS part, count(*) AS k FROM supplier GROUP BY ALL)
        SELECT s_nationkey, edge, sum(CASE edge WHEN 'next' THEN 1 + 2 * k WHEN 'fork' THEN 2 * k ELSE k + 1 END)::BIGINT AS n, sum(CASE edge WHEN 'next' THEN 1 + 2 * k WHEN 'fork' THEN k ELSE k + 1 END)::BIGINT AS n_resolved
        FROM p, (VALUES ('next'), ('branch'), ('join'), ('fork')) e(edge) GROUP BY ALL""",
    "rt_graphics": """
        SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'RectangleObject' ELSE 'OvalObject' END AS type, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 99 END AS layer, p_size::DOUBLE AS height, p_brand AS brand, (p_partkey % 7)::INT AS colour
        FROM part""",
    "rt_interact": "SELECT s_suppkey, 'ComBut_' AS type, 'Bool_Value ToggleAction Abs_' AS flags, 'Variable' AS property, 'out' AS direction FROM supplier",
    "parse_failures": "SELECT o_orderkey, 'parse' AS stage, 'SyntaxFault' AS error_class, 10 AS line, 1 AS col, true AS wants_semicolon FROM orders WHERE o_orderkey % 5 = 0",
    "parse_runs": "SELECT c_custkey % 4 <> 0 AS success, CASE WHEN c_custkey % 4 = 0 THEN 'SyntaxFault' END AS error_class, count(*) AS n FROM customer GROUP BY ALL",
    "program_names": "SELECT c_custkey, c_name AS program_name, 'BasePicture' AS root_name, 'plain' AS format FROM customer",
    "kind_rollup": """
        WITH p AS (SELECT count(DISTINCT (c_nationkey, c_custkey // 200)) AS n FROM customer),
             k AS (SELECT unnest(['Program', 'BasePicture', 'ModuleDef', 'Comment']) AS kind, n FROM p UNION ALL SELECT 'Variable', count(*) FROM customer)
        SELECT kind, n::BIGINT AS n, 0::BIGINT AS totals FROM k UNION ALL SELECT NULL, (2 * sum(n))::BIGINT, 1::BIGINT FROM k""",
    "duplicate_names": f"""
        WITH g AS (SELECT lower('Seg' || {SEGMENT}) AS name_key, c_nationkey, c_custkey // 200 AS part, count(*) AS declared FROM customer GROUP BY ALL HAVING count(*) > 1)
        SELECT name_key, count(*) AS programs, sum(declared)::BIGINT AS declared FROM g GROUP BY name_key""",
    "constant_writes": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "line_index": r"""
        WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
             e AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS line FROM l)
        SELECT doc_id, line::INT AS line, coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, length(part)::INT AS length FROM e""",
    "line_col_lookup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             o AS (SELECT DISTINCT doc_id, text, unnest([0, length(text) // 3, length(text)])::INT AS pos FROM d),
             b AS (SELECT doc_id, pos, substr(text, 1, pos) AS head FROM o)
        SELECT doc_id, pos AS "at", (1 + length(head) - length(replace(head, chr(10), '')))::INT AS line, (1 + length(string_split(head, chr(10))[-1]))::INT AS col FROM b""",
    "anchor_lookup": """
        SELECT user_id, event_id AS "at", CASE WHEN event_type <> 'click' THEN event_id * 2 END AS real,
               coalesce(last_value(CASE WHEN event_type <> 'click' THEN event_id * 2 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS anchor
        FROM events""",
    "marker_ratio": """
        WITH e AS (SELECT event_id, event_id % 60 AS n, 7 * (event_id % 60) + 14 + 25 + 2 + CASE WHEN event_id % 100 = 0 THEN 100000 ELSE 0 END + 9 * (event_id % 200) + CASE WHEN event_id % 3 = 0 THEN 16 ELSE 0 END AS visible FROM events)
        SELECT event_id, n::INT AS n_markers, n > 0 AND (n >= 50 OR 3.0 * n / visible >= 0.02 OR n >= 10 AND event_id % 3 <> 0) AS compressed FROM e""",
    "identifier_counts": "SELECT page_id, len(regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*'))::BIGINT AS n_identifiers FROM pages",
    "string_literals": """SELECT page_id, len(regexp_extract_all(html, '"[^\\n"]*"'))::BIGINT AS n_strings FROM pages""",
    "key_stream": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g') AS t FROM documents),
             c AS (SELECT doc_id, length(t) AS n, list_transform(string_split(t, ''), lambda x: ascii(x)) AS codes FROM d),
             k AS (SELECT doc_id, n, CASE WHEN n > 0 THEN list_transform(codes, lambda b, i: xor(b::INT, ((7 * (i - 1) + 8) % 128)::INT)) ELSE [] END AS coded, codes FROM c)
        SELECT doc_id, n::INT AS n, coalesce(list_sum(coded), 0)::BIGINT AS stored, CASE WHEN n > 0 THEN coalesce(list_sum(codes), 0) ELSE 0 END::BIGINT AS plain FROM k""",
    "compiled_expression": """
        SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -l_quantity WHEN l_discount >= 0.05 AND NOT (l_tax > 0.02 OR l_linenumber = 1) THEN l_extendedprice * (1 - l_discount) ELSE l_quantity + l_linenumber * 2 END AS value
        FROM lineitem""",
    "rt_repairs": f"SELECT p_partkey, {_repaired(3)} AS normalized, {_repaired(0)} AS repairs, {_repaired(1)} AS kinds, {_repaired(4)} AS n_made_up FROM part",
    "rt_marker_positions": "SELECT o_orderkey, x || o_orderkey AS name, x || o_orderkey AS text, true AS line_fits, true AS col_fits FROM orders, (VALUES ('T'), ('S'), ('A'), ('B')) v(x)",
    "rt_marker_errors": "SELECT o_orderkey, 'parse' AS stage, 9 AS line, (5 + length(o_orderkey::VARCHAR))::INT AS col, chr(10) || '#8' AS found, '' AS shown FROM orders WHERE o_orderkey % 5 = 0",
    "rt_encodings": "SELECT c_custkey, 'Åk' || c_custkey AS name, 'é ü ' || c_name AS description FROM customer",
    "rt_layout": """
        SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 10) / 4.0::DOUBLE END AS layer_limit, s_suppkey % 3 = 0 AS zoomable, s_suppkey % 5 = 0 AS fine, CASE WHEN s_suppkey % 7 = 0 THEN 2.0::DOUBLE END AS zoom
        FROM supplier""",
    "rt_shapes": """
        SELECT p_partkey, ['TextObject', 'RectangleObject', 'LineObject', 'OvalObject', 'SegmentObject', 'PolygonObject', 'CompositeObject'][p_partkey % 7 + 1] AS type,
               CASE p_partkey % 7 WHEN 4 THEN 1 WHEN 5 THEN 3 ELSE 0 END AS n_points, CASE WHEN p_partkey % 7 = 5 THEN 'Polyline Connection' END AS types,
               CASE WHEN p_partkey % 7 = 0 THEN p_name END AS text, p_size::INT AS width, (p_partkey % 9)::INT AS fill, 'True' AS style, 2 AS n_colours
        FROM part""",
    "rt_procedures": "SELECT s_suppkey, 'ComButProc_' AS type, s_name || '|p|False|' || s_suppkey || '|Out' || s_suppkey AS arguments FROM supplier",
    "rt_charts_all": """
        SELECT s_suppkey, kind, role, n::BIGINT AS n, names, 'OPENSEQUENCE' AS type, true AS control, true AS timer
        FROM supplier, (VALUES ('InitStep', 'element', 1, 'Init'), ('Transition', 'element', 1, 'Go'), ('Parallel', 'element', 1, ''), ('Step', 'branch:0', 1, 'P1'), ('Step', 'branch:1', 1, 'P2'), ('Step', 'branch:2', 1, 'P3'),
             ('Subsequence', 'element', 1, 'Sub'), ('TransitionSub', 'element', 1, 'SubT'), ('Step', 'element', 2, 'Inner Inner2'), ('Alternative', 'element', 1, ''), ('Transition', 'branch:0', 1, 'T1'), ('Break', 'branch:0', 1, ''),
             ('Transition', 'branch:1', 1, 'T2'), ('Fork', 'branch:1', 1, ''), ('Assignment', 'enter', 1, 'A'), ('Assignment', 'active', 1, 'B'), ('Assignment', 'exit', 1, 'C')) t(kind, role, n, names)""",
    "rendered_summaries": r"""
        SELECT s_suppkey, 'BasePicture{' || chr(10) || array_to_string(list_transform(string_split(
            'Name: ''BasePicture''' || chr(10) || 'Position: (0.0, 0.0, 0.0, 1.0, 1.0)' || chr(10) || chr(10) || 'TYPEDEFINITIONS (Records): []' || chr(10) || chr(10) || 'TYPEDEFINITIONS (Modules): []' || chr(10)
            || 'Localvariables: [' || chr(10)
            || '    Name: ' || rpad('''A' || s_suppkey || '''', w, ' ') || ' , Datatype: <Simple_DataType.INTEGER: ''integer''>, Global: False, Const: False, State: False, Init_value : 7   , Description: ' || rpad('None', w2, ' ') || chr(10)
            || '    Name: ' || rpad('''Longer''', w, ' ') || ' , Datatype: <Simple_DataType.REAL: ''real''>      , Global: False, Const: False, State: False, Init_value : None, Description: ' || rpad('''' || s_name || '''', w2, ' ') || ']' || chr(10) || chr(10)
            || 'Submodules: [' || chr(10) || '    ModuleTypeInstance{' || chr(10)
            || '        Name             : ''I' || s_suppkey || '''' || chr(10) || '        Enable           : True' || chr(10) || '        Enable_tail      : None' || chr(10) || '        Invoke_coord     : (0.0, 0.0, 0.0, 1.0, 1.0)' || chr(10)
            || '        ModuleTypeName   : ''Type''' || chr(10) || '        ParameterMappings: [' || chr(10) || '            P => V' || s_suppkey || chr(10) || '            Q => GLOBAL]}]' || chr(10) || chr(10)
            || 'ModuleCode: None' || chr(10) || chr(10) || 'ModuleDefBlocks: 1' || chr(10) || chr(10), chr(10)), lambda x: CASE WHEN x = '' THEN x ELSE '    ' || x END), chr(10)) || '}' AS summary
        FROM (SELECT s_suppkey, s_name, greatest(8, 3 + length(s_suppkey::VARCHAR))::INT AS w, (length(s_name) + 2)::INT AS w2 FROM supplier)""",
    "deep_nesting": "SELECT n_nationkey::INT AS n_nationkey, 100 * n_nationkey::BIGINT AS n_operators, 0::BIGINT AS n_errors FROM nation",
    "soup_runs": "SELECT count(*) AS n, 0::BIGINT AS n_crashes, 0::BIGINT AS n_slow FROM customer",
    "huge_lines": r"""
        SELECT doc_id, k AS line, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(x) AS length
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)""",
    "huge_regions": """
        SELECT doc_id, kind, n, CASE kind WHEN 'C' THEN 23 + coalesce(length(text), 0) ELSE 17 + 2 * coalesce(length(text), 0) END::BIGINT AS n_chars
        FROM documents, (VALUES ('C', 2::BIGINT), ('S', 3::BIGINT)) t(kind, n)""",
}


def oracle_sql() -> dict[str, str]:
    return SQL | {k: v for m in MORE for k, v in m.SQL.items()}
