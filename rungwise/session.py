"""Makes the package importable on the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package once per application, so that workers depend on no shared path."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for folder, _, names in os.walk(root):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
        path = os.path.join(tempfile.mkdtemp(), "rungwise_source.zip")
        with open(path, "wb") as f:
            f.write(data.getvalue())
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share: the one the cluster names in spark.checkpoint.dir; one of our own only in local mode, as in tests."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()
