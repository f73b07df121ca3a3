"""The relations the engine publishes."""

from __future__ import annotations

from pyspark.sql import types as T

#: One row per node in pre-order: all descendants of a node are those of the same source with node_id in (node_id, subtree_end].
NODES = T.StructType(
    [
        T.StructField("source_id", T.StringType(), False),
        T.StructField("node_id", T.IntegerType(), False),
        T.StructField("subtree_end", T.IntegerType(), False),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("name_key", T.StringType()),
        T.StructField("literal", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("props", T.StringType()),
        T.StructField("rendered", T.StringType()),
    ]
)
