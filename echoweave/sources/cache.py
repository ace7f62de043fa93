"""Tables of features kept in buckets of scenes: pairs, neighbours and splits meet within a scene, so they read it without a shuffle."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..schemas import SCENE


def _name(path: str) -> str:
    return f"features_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def write(df: DataFrame, path: str, buckets: int, by: Sequence[str] = SCENE) -> DataFrame:
    """The rows written below ``path`` in ``buckets`` files, dealt and sorted by ``by``, and read again.

    Rows are dealt once, here, by the hash that later joins and windows on ``by``, or on more columns, ask for. One task
    writes and one reads a bucket, so their number should follow the size of the table (some 256 MB a bucket). Null is a
    value of ``by`` like others. A scene with a large share of all rows fills one bucket, which a join cannot split:
    such a table is better kept by :func:`.raw.write_cache`. ``df`` may not read from ``path``. What described the
    table before is taken away first and written anew last, so a write that was cut short is not found.
    """
    spark, name = df.sparkSession, _name(path)
    manifest = {"buckets": buckets, "by": list(by), "schema": json.loads(df.schema.json())}
    spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    spark.sql(f"drop table if exists {name}")
    df.repartition(buckets, *by).write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", f"{path}/table").saveAsTable(name)
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return spark.table(name)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table written at ``path``; a session that does not know it yet learns of its buckets from the manifest."""
    try:
        found = spark.read.text(f"{path}/manifest", wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    if not found or not found[0].strip():
        raise FileNotFoundError(f"no finished table at {path}")
    manifest, name = json.loads(found[0]), _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f['name']}` {_type(f['type'])}" for f in manifest["schema"]["fields"])
        by = ", ".join(f"`{c}`" for c in manifest["by"])
        spark.sql(f"create table {name} ({columns}) using parquet clustered by ({by}) sorted by ({by}) into {manifest['buckets']} buckets location '{path}/table'")
    return spark.table(name)


def _type(of: str | dict) -> str:
    """A column's type as SQL; features are plain numbers and texts."""
    if not isinstance(of, str):
        raise TypeError(f"columns of plain types only, not {of['type']}")
    return {"long": "bigint", "integer": "int"}.get(of, of)
