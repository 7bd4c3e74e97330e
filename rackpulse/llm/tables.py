"""Small helpers all operators of this folder share."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; a missing one counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space, in order."""
    return F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"))


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the frame has (whatever the case of its letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Where a session in one process keeps its files if it names no folder.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    A session whose executors are threads of the driver may name none; its own files then go when it ends.
    A cluster session must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"{LOCAL_FOLDER}/llm-{spark.sparkContext.applicationId}"
    if own not in _own_folders:
        _own_folders.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return LOCAL_FOLDER


_own_folders: set[str] = set()


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame, written once below the shared folder and read back. ``options`` are those of the Parquet writer.

    Cuts the lineage: what is read later comes from files that outlive any executor. The folder lies below
    ``llm-<application id>`` and is the operator's to expire, as checkpoint files are.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
