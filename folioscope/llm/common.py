"""Helpers that the operators of this subpackage share.

Text rules used by every operator
---------------------------------
* a null text counts as the empty text;
* words are maximal runs of characters other than space and U+0009..U+000D;
* lower-casing touches A-Z only, so results do not depend on a locale.
"""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space besides the plain space: tab, line feed, vertical tab, form feed, carriage return.
OTHER_SPACE = "\t\n\x0b\x0c\r"

#: bytes.translate table: A-Z lowered, white space made a plain space.
WORD_BYTES = bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that has none gets a temporary folder of this process, which is
    set for ``checkpoint()`` too, with a warning; on a cluster this is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_folioscope_shared", None)
        if not found:
            warnings.warn("spark.checkpoint.dir is not set; a temporary local folder is used", stacklevel=2)
            found = spark._folioscope_shared = tempfile.mkdtemp(prefix="folioscope-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_written: list[str] = []


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``sweep`` removes it unless it is to be kept.

    This cuts the lineage, so that a lost executor costs a reread of replicated
    or shared files instead of a recomputation, and so that a frame which is
    used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioscope-llm/{name}-{uuid.uuid4().hex}"
    if not keep:
        _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Remove what ``materialise`` has written in this process; call it when no result that rests on it is still to be read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def quoted(column: str) -> str:
    """A column's name for ``F.col``, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of words; a literal split after one translate, with no regular expression."""
    return F.array_remove(F.split(F.translate(text, OTHER_SPACE, " " * len(OTHER_SPACE)), " "), "")


def lower_words_of(text: Column) -> Column:
    """``words_of`` the lowered text, with one translate for both."""
    plain = F.translate(text, UPPER + OTHER_SPACE, LOWER + " " * len(OTHER_SPACE))
    return F.array_remove(F.split(plain, " "), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
