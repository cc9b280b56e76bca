"""What the operators share: shipping this package to executors and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.session import shared_folder, ship

__all__ = ["Scratch", "bitmap", "fresh", "in_bitmap", "is_in", "ship"]

SLOTS = 25  # log2 of a bitmap's bits: 4 MB, whatever the input


class Scratch:
    """Parquet tables in the shared folder. They cut lineage and outlive lost executors; drop() removes
    one as soon as nothing reads it any more, the rest go when the driver's Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/veilwright/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None = None) -> None:
        path = self.root if df is None else df._scratch_path
        try:
            jvm, jsc = self.spark._jvm, self.spark._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder is then left to its owner
            pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def bitmap(hashes: DataFrame, bits: int = SLOTS) -> Broadcast:
    """A bitmap of 2^bits for the numbers x of hashes, sent to the executors. Its size is fixed; the fuller it is, the
    more other numbers is_in() lets pass."""
    slot = F.col("x").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts:
        part = np.frombuffer(r["m"], np.uint8)[: len(out)]
        at = (r["b"] - 1) * len(r["m"])
        out[at : at + len(part)] = part
    return hashes.sparkSession.sparkContext.broadcast(out)


def is_in(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of x (64-bit numbers) may be in a bitmap; False is certain."""
    at = x.view(np.int64) & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def in_bitmap(bits: Broadcast, x: Column) -> Column:
    """is_in() of a column without nulls. Only the numbers go to Python."""

    @F.pandas_udf("boolean")
    def test(v: pd.Series) -> pd.Series:
        return pd.Series(is_in(bits.value, v.to_numpy(dtype=np.int64)))

    return test(x)
