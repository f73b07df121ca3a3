"""Queries on what names lead to, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.operators.stage import parse_sources
from rungwise.plans import resolve
from rungwise.plans import roundtrip as rt
from rungwise.plans.tables import table


def type_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every supplier types that hold two instances of the next one, key % 5 of them; the last holds one of the first, of none, or nothing, by turns."""
    k = F.col("s_suppkey")
    types = F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda n: F.concat(
        F.lit("Type"), n.cast("string"), F.lit(" = MODULEDEFINITION DateCode_ 1\n"),
        F.when(n < k % 5, F.concat(F.lit("SUBMODULES\nL"), n.cast("string"), F.lit(rt.INVOKE + "TYPE"), (n + 1).cast("string"), F.lit(";\nR"), n.cast("string"), F.lit(rt.INVOKE + "type"), (n + 1).cast("string"), F.lit(";\n")))
        .when(k % 3 == 0, F.lit("SUBMODULES\nBack" + rt.INVOKE + "Type0;\n")).when(k % 3 == 1, F.lit("SUBMODULES\nOff" + rt.INVOKE + "Nowhere;\n")).otherwise(F.lit("")),
        F.lit(rt.LAYOUT + "ENDDEF;\n"),
    ))
    sections = F.concat(F.lit("TYPEDEFINITIONS\n"), F.array_join(types, ""), F.lit("SUBMODULES\nTop"), k.cast("string"), F.lit(rt.INVOKE + "Type0;\n"))
    made = rt.dealt(table(spark, sf_dir, "supplier"), "s_suppkey").select(k.cast("string").alias("source_id"), rt.program(k.cast("string"), sections).alias("content"))
    found = resolve.instance_tree(parse_sources(made, kinds=("ModuleTypeDef", "ModuleTypeInstance"), rendered=False))
    return found.select(F.col("source_id").cast("long").alias("s_suppkey"), F.array_join("path", "/").alias("path"), "depth", "type_name", F.col("type_node_id").isNotNull().alias("resolved"), "cycle")


def record_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of three parts for every part: whole ones, and ones whose second or third part no record has, in other spelling by turns."""
    k = F.col("p_partkey").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("Deep.Value", "DEEP.value", "Deep.Gone", "Lost.Value", "Deep"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    line = F.concat(F.lit("X"), k, F.lit(" = P"), k, F.lit("."), kind, F.lit(";"))
    rows = table(spark, sf_dir, "part").withColumn("part", rt.block(F.col("p_partkey")))
    types = "TYPEDEFINITIONS\nInner = RECORD DateCode_ 1\nValue: real;\nENDDEF;\nOuter = RECORD DateCode_ 1\nDeep: INNER;\nFlat: integer;\nENDDEF;\nLOCALVARIABLES\n"
    lists = rows.groupBy("part").agg(rt.joined("p_partkey", F.concat(F.lit("P"), k, F.lit(": Outer;"))).alias("vars"), rt.joined("p_partkey", line).alias("code"))
    name = F.col("part").cast("string")
    made = lists.select(name.alias("source_id"), rt.program(name, F.concat(F.lit(types), "vars", F.lit("\n")), F.concat(F.lit("ModuleCode\nEQUATIONBLOCK Main" + rt.PLACE + ":\n"), "code", F.lit("\n"))).alias("content"))
    found = resolve.dotted_paths(parse_sources(made, kinds=("DataType", "Variable", "VarRef"), rendered=False)).filter("levels > 1")
    return found.select(F.regexp_extract("name", r"^P(\d+)", 1).cast("long").alias("p_partkey"), "name", "levels", "found", "datatype", F.coalesce("missing", F.lit("-")).alias("missing"))


def chart_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each user and block of events: a step for every event, or, for each fifth, a fork to the step of a later or an earlier one; the events that flow reaches. A program holds a block, each user's sequence in a module of its own, which its forks don't leave."""
    e = table(spark, sf_dir, "events").withColumn("part", F.floor(F.col("event_id") / 500).cast("long"))
    fork = F.col("event_id") % 5 == 0
    target = F.greatest(F.col("event_id") - 4 + F.col("event_id") % 7 * 5, F.lit(0)).cast("string")
    line = F.concat(F.when(fork, F.concat(F.lit("ALTERNATIVESEQ SEQTRANSITION WAIT_FOR A SEQSTEP E"), F.col("event_id").cast("string"), F.lit(" SEQFORK E"), target, F.lit(" ALTERNATIVEBRANCH SEQBREAK ENDALTERNATIVE"))).otherwise(F.concat(F.lit("SEQSTEP E"), F.col("event_id").cast("string"))))
    charts = rt.dealt(e, "part").groupBy("part", "user_id").agg(rt.joined("event_id", line).alias("lines"))
    module = F.concat(F.lit("Of" + rt.INVOKE + "MODULEDEFINITION DateCode_ 1\n" + rt.LAYOUT + "ModuleCode\nSEQUENCE Main" + rt.PLACE + "\n"), "lines", F.lit("\nENDSEQUENCE\nENDDEF;\n"))
    made = rt.sources(charts, ["part"], "user_id", module, ("SUBMODULES\n", ""))
    found = resolve.reached(parse_sources(made, kinds=("Sequence", "InitStep", "Step", "Transition", "Alternative", "Fork", "Break"), rendered=False)).filter("kind = 'Step'")
    return found.select(F.substring("name", 2, 20).cast("long").alias("event_id"), "reached")


def chart_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every supplier a chart with each kind of container; which elements flow reaches."""
    k = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("ModuleCode\nSEQUENCE S" + rt.PLACE + "\n" + GATES), F.lit("SEQSTEP After"), k, F.lit("\nENDSEQUENCE\n"))
    made = rt.dealt(table(spark, sf_dir, "supplier"), "s_suppkey").select(k.alias("source_id"), rt.program(k, F.lit(""), body).alias("content"))
    found = resolve.reached(parse_sources(made, kinds=("Sequence", "InitStep", "Step", "Transition", "Alternative", "Parallel", "Subsequence", "TransitionSub", "Fork", "Break"), rendered=False)).filter("name IS NOT NULL")
    return found.select(F.col("source_id").cast("long").alias("s_suppkey"), "name", "kind", "reached", "passes")


GATES = (
    "SEQINITSTEP Init\nPARALLELSEQ SEQSTEP P1 PARALLELBRANCH PARALLELBRANCH SEQSTEP P3 ENDPARALLEL\nSEQSTEP Joined\nSUBSEQUENCE Sub SEQSTEP In ENDSUBSEQUENCE\n"
    "ALTERNATIVESEQ SEQTRANSITION T1 WAIT_FOR A SEQFORK Far ALTERNATIVEBRANCH SEQTRANSITION T2 WAIT_FOR B ENDALTERNATIVE\nSEQSTEP Merged\n"
    "PARALLELSEQ SEQSTEP Q1 SEQFORK init PARALLELBRANCH SEQSTEP Q2 ENDPARALLEL\nSEQSTEP Never\n"
    "SUBSEQUENCE Dead SEQSTEP Shut ENDSUBSEQUENCE\nSUBSEQTRANSITION Jumped SEQSTEP NotYet SEQSTEP Far SEQSTEP Farther ENDSUBSEQTRANSITION\nSEQSTEP Out\nSEQBREAK\nSEQSTEP Past\n"
)
#: Name, kind, whether flow reaches it and goes on from it, of the elements of GATES.
GATED = [
    ("Init", "InitStep", True, True), ("P1", "Step", True, True), ("P3", "Step", True, True), ("Joined", "Step", True, True), ("Sub", "Subsequence", True, True), ("In", "Step", True, True),
    ("T1", "Transition", True, True), ("T2", "Transition", True, True), ("Merged", "Step", True, True), ("Q1", "Step", True, True), ("Q2", "Step", True, True), ("Never", "Step", False, True),
    ("Dead", "Subsequence", False, False), ("Shut", "Step", False, True), ("Jumped", "TransitionSub", False, True), ("NotYet", "Step", False, True), ("Far", "Step", True, True), ("Farther", "Step", True, True),
    ("Out", "Step", True, True), ("Past", "Step", False, True),
]

SQL = {
    "type_tree": """
        WITH RECURSIVE t AS (
            SELECT s_suppkey, 'BasePicture/Top' || s_suppkey AS path, 0 AS depth, 'Type0' AS type_name, true AS resolved, false AS cycle FROM supplier
            UNION ALL
            SELECT t.s_suppkey, path || '/' || side || CASE WHEN side IN ('L', 'R') THEN depth::VARCHAR ELSE '' END, depth + 1,
                   CASE side WHEN 'L' THEN 'TYPE' || (depth + 1) WHEN 'R' THEN 'type' || (depth + 1) WHEN 'Back' THEN 'Type0' ELSE 'Nowhere' END, side <> 'Off', side = 'Back'
            FROM t, (VALUES ('L'), ('R'), ('Back'), ('Off')) v(side)
            WHERE resolved AND NOT cycle AND CASE WHEN depth < s_suppkey % 5 THEN side IN ('L', 'R') WHEN s_suppkey % 3 = 0 THEN side = 'Back' ELSE s_suppkey % 3 = 1 AND side = 'Off' END)
        SELECT * FROM t""",
    "record_paths": """
        SELECT p_partkey, 'P' || p_partkey || '.' || CASE p_partkey % 5 WHEN 0 THEN 'Deep.Value' WHEN 1 THEN 'DEEP.value' WHEN 2 THEN 'Deep.Gone' WHEN 3 THEN 'Lost.Value' ELSE 'Deep' END AS name,
               CASE p_partkey % 5 WHEN 4 THEN 2 ELSE 3 END AS levels, CASE p_partkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 3 THEN 1 ELSE 2 END AS found,
               CASE p_partkey % 5 WHEN 0 THEN 'real' WHEN 1 THEN 'real' WHEN 3 THEN 'Outer' ELSE 'INNER' END AS datatype, CASE p_partkey % 5 WHEN 2 THEN 'gone' WHEN 3 THEN 'lost' ELSE '-' END AS missing
        FROM part""",
    "chart_reach": """
        WITH RECURSIVE e AS (SELECT *, event_id // 500 AS part, greatest(event_id - 4 + event_id % 7 * 5, 0) AS target FROM events),
             s AS (SELECT user_id, part, event_id, event_id % 5 = 0 AS fork, target, row_number() OVER w AS k, lead(event_id) OVER w AS after FROM e WINDOW w AS (PARTITION BY user_id, part ORDER BY event_id)),
             r AS (SELECT user_id, part, event_id FROM s WHERE k = 1
                   UNION
                   SELECT s.user_id, s.part, t.event_id FROM r JOIN s USING (user_id, part, event_id)
                   JOIN s t ON t.user_id = s.user_id AND t.part = s.part AND t.event_id = CASE WHEN s.fork THEN s.target ELSE s.after END)
        SELECT s.event_id, r.event_id IS NOT NULL AS reached FROM s LEFT JOIN r USING (user_id, part, event_id)""",
    "chart_gates": "SELECT s_suppkey, name, kind, reached, passes FROM supplier, (VALUES "
    + ", ".join(map(str, GATED))
    + ") t(name, kind, reached, passes) UNION ALL SELECT s_suppkey, 'After' || s_suppkey, 'Step', false, true FROM supplier",
}

QUERIES = {"type_tree": type_tree, "record_paths": record_paths, "chart_reach": chart_reach, "chart_gates": chart_gates}
