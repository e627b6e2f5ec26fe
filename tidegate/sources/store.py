"""The price store: Parquet partitioned by (symbol, interval), and a small table of names and units.

Replacing a series overwrites its partitions only. Reads by symbol and interval prune to their folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = "ts timestamp_ntz, value double, fetched_at timestamp_ntz, symbol string, interval string"
META = "name string, unit string, symbol string, interval string"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def prepare(self) -> list[str]:
        """Make the store's tables where they are missing, and bring older ones to the schema of today; what was done, nothing the second time.

        An older table has columns of other types, such as days instead of timestamps. It is written anew beside the old one,
        which goes away only when the new one is whole; a run that was ended in between is finished by the next."""
        done = []
        for name, ddl in (("prices", PRICES), ("meta", META)):
            want, at = T.StructType.fromDDL(ddl), f"{self.path}/{name}"
            if not self._exists(at) and self._exists(f"{at}.new/_SUCCESS"):
                self._rename(f"{at}.new", at)
                done.append(f"{name}: finished")
            if not self._exists(at):
                self.spark.createDataFrame([], want).write.mode("overwrite").parquet(at)
                done.append(f"{name}: made")
                continue
            rows = self.spark.read.option("basePath", at).parquet(at)
            have = dict(rows.dtypes)
            if all(have.get(f.name) == f.dataType.simpleString() for f in want if f.name not in ("symbol", "interval")):
                continue
            missing = [f.name for f in want if f.name not in have]
            if missing:
                raise ValueError(f"{at} has no column {missing}")
            cast = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])
            cast.repartition("symbol", "interval").write.mode("overwrite").partitionBy("symbol", "interval").parquet(f"{at}.new")
            self._files(at).delete(self._at(at), True)
            self._rename(f"{at}.new", at)
            done.append(f"{name}: {', '.join(f.name for f in want if have[f.name] != f.dataType.simpleString())} changed")
        return done

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._at(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._files(path).exists(self._at(path))

    def _rename(self, path: str, to: str) -> None:
        if not self._files(path).rename(self._at(path), self._at(to)):
            raise OSError(f"{path} can't be renamed to {to}")

    def _table(self, name: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], ddl)

    @property
    def prices(self) -> DataFrame:
        return self._table("prices", PRICES)

    @property
    def meta(self) -> DataFrame:
        return self._table("meta", META)

    def replace(self, rows: DataFrame, fetched_at: str) -> None:
        """Store decoded rows (symbol, interval, name, unit, ts, value) in place of what their series had; one row a timestamp stays."""
        one = Window.partitionBy("symbol", "interval", "ts").orderBy("value")
        prices = rows.withColumn("__n", F.row_number().over(one)).where("__n = 1").select("ts", "value", F.lit(fetched_at).cast("timestamp_ntz").alias("fetched_at"), "symbol", "interval")
        meta = rows.groupBy("symbol", "interval").agg(F.first("name").alias("name"), F.first("unit").alias("unit")).select("name", "unit", "symbol", "interval")
        for name, df in (("prices", prices.repartition("symbol", "interval")), ("meta", meta)):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "interval").parquet(f"{self.path}/{name}")

    def load(self, symbol: str, interval: str) -> DataFrame:
        return load(self.prices, self.meta, symbol, interval)

    def status(self) -> DataFrame:
        return status(self.prices, self.meta)

    def present(self) -> DataFrame:
        return self.meta.select("symbol", "interval")

    def ingest(self, series: list[tuple[str, str]], fetch: Callable[[str, str], DataFrame], fetched_at: str, force: bool = False) -> dict[tuple[str, str], str]:
        """What became of each series: stored, cached (there already, and not forced) or the error. One that fails doesn't stop the others."""
        have = {(r["symbol"], r["interval"]) for r in self.present().collect()}
        out = {}
        for key in series:
            if key in have and not force:
                out[key] = "cached"
                continue
            try:
                self.replace(fetch(*key), fetched_at)
                out[key] = "stored"
            except Exception as e:  # noqa: BLE001  the vendor, its answer or the write: told in the result
                out[key] = f"failed: {str(e).splitlines()[0][:200]}"
        return out


def load(prices: DataFrame, meta: DataFrame, symbol: str, interval: str) -> DataFrame:
    """(ts, value) of a series, newest first; empty without its meta row."""
    mine = (F.col("symbol") == symbol) & (F.col("interval") == interval)
    return prices.where(mine).join(meta.where(mine).select("symbol", "interval"), ["symbol", "interval"], "left_semi").select("ts", "value").orderBy(F.desc("ts"))


def last_fetched(prices: DataFrame, symbol: str, interval: str) -> DataFrame:
    """The latest fetched_at of a series, one row; null if there is none."""
    return prices.where((F.col("symbol") == symbol) & (F.col("interval") == interval)).agg(F.max("fetched_at").alias("fetched_at"))


def status(prices: DataFrame, meta: DataFrame) -> DataFrame:
    """One row a series: name, unit, count, first and last timestamp, last fetch."""
    sums = prices.groupBy("symbol", "interval").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("fetched_at").alias("fetched_at"))
    return sums.join(meta.select("symbol", "interval", "name", "unit"), ["symbol", "interval"], "left").select("symbol", "interval", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("unit", F.lit("")).alias("unit"), "n", "first_ts", "last_ts", "fetched_at")


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Series (symbol, interval) that still have to be fetched."""
    return wanted.join(present, ["symbol", "interval"], "left_anti")


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """The store's rows after new series came in: old rows of other series, and the new ones."""
    return old.join(new.select("symbol", "interval").distinct(), ["symbol", "interval"], "left_anti").unionByName(new)


def newest(prices: DataFrame, symbol: str, interval: str, n: int = 10) -> DataFrame:
    return prices.where((F.col("symbol") == symbol) & (F.col("interval") == interval)).select("ts", "value").orderBy(F.desc("ts")).limit(n)
