"""The log of a run of lookups: answers are appended batch by batch, so what is written grows with the answers alone."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.operators.cache import numbered
from plotwright.storage import exists, file_system, publish


class Answers:
    """Below one folder: ``plan``, the addresses to be asked for with the numbers of their batches, and ``answers/batch=n``.

    A batch is there whole or not at all, so a run that is killed goes on from the batches kept; the plan is made once,
    so they are the same batches.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def plan(self, asked: DataFrame, batch_size: int) -> int:
        """Keeps ``asked`` (address_id, full_address) in batches of ids, unless there is a plan; returns the number of batches."""
        path = f"{self.folder}/plan"
        if not exists(self.spark, path):
            ranked = numbered(asked, ["address_id"], "rank", 0)
            # Sorted by batch, so that reading one reads its part of one file.
            publish(ranked.withColumn("batch", F.floor((F.col("rank") - 1) / batch_size)).drop("rank").repartitionByRange("batch").sortWithinPartitions("batch", "address_id"), path)
        last = self.spark.read.parquet(path).agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def part(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/plan").where(F.col("batch") == batch).drop("batch")

    def done(self) -> set[int]:
        fs, make = file_system(self.spark, self.folder)
        top = make(f"{self.folder}/answers")
        names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
        return {int(n[6:]) for n in names if re.fullmatch(r"batch=\d+", n)}

    def add(self, batch: int, answers: DataFrame) -> DataFrame:
        """Keeps the answers of a batch; returns them as kept."""
        fs, make = file_system(self.spark, self.folder)
        fs.mkdirs(make(f"{self.folder}/answers"))
        path = f"{self.folder}/answers/batch={batch}"
        publish(answers.coalesce(1), path)
        return self.spark.read.parquet(path)

    def read(self, schema: str) -> DataFrame:
        """All answers kept, with their batch."""
        if not self.done():
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.folder}/answers")

    def drop(self) -> None:
        fs, make = file_system(self.spark, self.folder)
        fs.delete(make(self.folder), True)
