"""The scratch store: documents and their iterations as Parquet tables.

documents is written anew as a version of its own at each upsert, so readers of the version before are not
disturbed and a lost job leaves it whole; iterations is append-only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.operators.leakage import INFERENCES
from veilwright.sources.readers import exists

DOCUMENTS = (
    f"document_id string, original_text string, evidence_spans array<string>, insight_profile string, privacy_inferences {INFERENCES}, "
    "final_text string, final_privacy_score double, status string"
)
ITERATIONS = (
    "id string, document_id string, iteration_num int, template_text string, mask_map array<struct<key:string,original:string>>, variations array<string>, best_variation_idx int, "
    "attacker_report string, keeper_report string, modulator_output string, masker_rules array<string>, refiller_rules array<string>, blacklist_snapshot array<string>"
)


def upserted(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """old with the rows of new: a null in new leaves the old value, an unknown key adds a row."""
    given = set(new.columns)
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key])
    j = old.join(n, key, "full_outer")
    return j.select(*[F.col(c) if c == key or c not in given else F.coalesce(f"_new_{c}", c).alias(c) for c in old.columns])


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def reset(self) -> None:
        fs, p = self._fs(self.root)
        fs.delete(p, True)

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/documents")
        return sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(p)) if fs.exists(p) else []

    def documents(self, status: str | None = None) -> DataFrame:
        v = self._versions()
        df = self.spark.read.schema(DOCUMENTS).parquet(f"{self.root}/documents/v{v[-1]}") if v else self.spark.createDataFrame([], DOCUMENTS)
        return df if status is None else df.where(F.col("status") == status)

    def document(self, document_id: str) -> DataFrame:
        df = self.documents().where(F.col("document_id") == document_id)
        return df.withColumn("evidence_spans", F.coalesce("evidence_spans", F.array().cast("array<string>")))

    def upsert(self, new: DataFrame) -> None:
        v = self._versions()
        upserted(self.documents(), new).write.parquet(f"{self.root}/documents/v{(v[-1] if v else 0) + 1}")
        fs, p = self._fs(f"{self.root}/documents")
        for old in v[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/documents/v{old}"), True)

    def append_iterations(self, new: DataFrame) -> None:
        names = [f.split()[0] for f in ITERATIONS.replace("array<struct<key:string,original:string>>", "x").split(", ")]
        kinds = self.spark.createDataFrame([], ITERATIONS).schema
        filled = new.withColumn("id", F.concat(F.lit(f"{uuid.uuid4().hex}-"), F.monotonically_increasing_id().cast("string")))
        filled.select(*[(F.col(c) if c in filled.columns else F.lit(None)).cast(kinds[c].dataType).alias(c) for c in names]).write.mode("append").parquet(f"{self.root}/iterations")

    def iterations(self, document_id: str | None = None) -> DataFrame:
        path = f"{self.root}/iterations"
        df = self.spark.read.schema(ITERATIONS).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], ITERATIONS)
        return df if document_id is None else df.where(F.col("document_id") == document_id).orderBy("iteration_num")

    def status_counts(self) -> DataFrame:
        return self.documents().groupBy("status").count()
