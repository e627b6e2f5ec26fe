"""What the corpus operators share: the shared folder, column handling, null-safe input."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the corpus contracts: the six ASCII characters 0x20 and 0x09 to 0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a folder of our own is set on a local master, whose
    executors are the driver's process; on a cluster they couldn't see it, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidegate-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder. A written table cuts lineage, and a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Remove tables whose readers have all finished."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.at(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """The driver's heap is collected: plans, broadcasts and shuffle files of actions that have ended go, and the JVM gives memory back. For loops
    whose number of actions grows with the input; a call takes some tenths of a second."""
    gc.collect()
    spark._jvm.System.gc()


def need(df: DataFrame, columns: Iterable[str], op: str) -> None:
    """A missing input column is an error of the caller, told at once."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{op}: no column {missing} in {df.columns}")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """All columns but these: an input column that has the name of an output column gives way to it."""
    names = {n.lower() for n in names}
    return [quoted(c) for c in df.columns if c.lower() not in names]


#: Rows of a table that join_small broadcasts at most, and salts with which it deals a longer one.
FEW, SALTS = 100_000, 16


def join_small(rows: DataFrame, small: DataFrame, key: str, of: str, n: int) -> DataFrame:
    """rows with the columns of `small`, n rows with one for each value of `of` (null is a value), or null where it has none; `of` goes.

    One key may hold a large share of the rows: a table of few rows is broadcast, a longer one is repeated for each salt, so that the key's rows spread."""
    same = quoted(key).eqNullSafe(F.col(of))
    if n <= FEW:
        return rows.join(F.broadcast(small), same, "left").drop(of)
    salted = small.withColumn("__of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = rows.withColumn("__salt", F.monotonically_increasing_id() % SALTS)
    return dealt.join(salted, same & (F.col("__salt") == F.col("__of")), "left").drop("__salt", "__of", of)


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null: 0. Every word ends before white space or the end, so runs of white space count."""
    body = F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")
    gaps = F.length(F.regexp_replace(body, f"{SPACE_CLASS}+", " ")) - F.length(F.regexp_replace(body, f"{SPACE_CLASS}+", ""))
    return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.lit(0)).otherwise(gaps + 1).cast("long")


def schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(k, _type(v)) for k, v in columns.items()])


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "longs": T.ArrayType(T.LongType()), "ints": T.ArrayType(T.IntegerType()), "strings": T.ArrayType(T.StringType())}


def _type(name: str) -> T.DataType:
    return _TYPES[name]
