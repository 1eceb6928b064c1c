"""What the operators share: the written tables that cut lineage, and normalised input columns."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tallyhand-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where none is named it is the warehouse; a folder of this machine is used only if all tasks
    run on it too, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.master.split("[")[0] != "local":
        return spark.conf.get("spark.sql.warehouse.dir")
    return named or _own_folder()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe when executors are lost.

    The folder is new for each call; clearing it is left to whoever owns ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
