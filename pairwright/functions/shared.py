"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


#: Folders of local sessions that have no spark.checkpoint.dir, by application.
_own_dirs: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write *df* below spark.checkpoint.dir and read it back: short plans, and a lost executor costs a read."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_dirs.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="pairwright-")
        _own_dirs[context.applicationId] = base
    path = f"{base.rstrip('/')}/pairwright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
