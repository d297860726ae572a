"""What the training-data operators share: reading tables, cutting lineage, word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract of this subpackage, as a character class.
SPACE = r"[\x20\x09-\x0D]"
#: A word: a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as plain characters, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def whole(text: str = "text") -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(F.col(text), F.lit(""))


#: Temporary folders of local sessions without one of their own, as in tests.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session gets a temporary folder; on a cluster that would be out of the executors' sight
    and raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or _own.get(app := spark.sparkContext.applicationId, "")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return found.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """A name for a temporary column that no column of df has."""
    taken = {c.lower() for c in df.columns}
    k = 0
    while (found := f"_{name}_{k}") in taken:
        k += 1
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
