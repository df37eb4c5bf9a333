"""A keyed table on shared storage that is updated in place.

Rows lie in buckets by a hash of their key, and each bucket in a folder for the batch that last
wrote it: data/bucket=7/batch=b42. A batch rewrites the buckets that its keys fall into and no
others. It counts from the moment its marker stands in commits/; what was written before is
what readers see until then, and a batch whose marker stands is not applied again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class CommitConflict(RuntimeError):
    """Another batch was committed meanwhile; the batch is to be applied anew."""


@dataclass(frozen=True)
class StoredTable:
    """`schema` has a column named by `key`; `bucket` and `batch` are names that rows may not use."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str = "key"
    buckets: int = BUCKETS

    # ------------------------------------------------------------ files

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))

    @property
    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, bucket: int, batch: str) -> str:
        return f"data/bucket={bucket}/batch={batch}"

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------ commits

    def commits(self) -> DataFrame:
        """A row for each committed batch: commit (from 1), batch, buckets it wrote, and those of them that hold rows."""
        kind = "commit long, batch string, buckets array<int>, filled array<int>"
        if not self._fs.exists(self._at("commits")):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).json(f"{self.path.rstrip('/')}/commits/*.json")

    def last_commit(self) -> int:
        return self.commits().agg(F.coalesce(F.max("commit"), F.lit(0)).alias("n")).first()["n"]

    def state(self, commit: int | None = None) -> dict[int, str]:
        """The batch that wrote each bucket that holds rows, as of a commit; at most one entry a bucket."""
        seen = self.commits() if commit is None else self.commits().where(F.col("commit") <= commit)
        each = seen.select("commit", "batch", F.explode("buckets").alias("bucket"), "filled")
        last = each.groupBy("bucket").agg(F.max_by(F.struct("batch", F.array_contains("filled", F.col("bucket")).alias("full")), "commit").alias("l"))
        return {r["bucket"]: r["batch"] for r in last.where("l.full").select("bucket", "l.batch").collect()}

    def _commit(self, number: int, batch: str, touched: list[int], filled: list[int]) -> None:
        """Puts the marker in place by a rename that fails where one stands."""
        jvm, draft = self.spark._jvm, self._at("drafts", uuid.uuid4().hex)
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps({"commit": number, "batch": batch, "buckets": touched, "filled": filled}).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._at("commits"))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(draft, self._at("commits", f"{number:012d}.json"), none)
        except Exception as e:
            raise CommitConflict(f"commit {number} of {self.path} is taken") from e

    # ------------------------------------------------------------ rows

    def read(self, commit: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows as of a commit (the last, unless one is given); `only` reads some buckets and no file of another."""
        state = self.state(commit)
        root = self.path.rstrip("/")
        paths = [f"{root}/{self._folder(b, batch)}" for b, batch in sorted(state.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def apply(self, batch: str, writes: DataFrame, deletes: DataFrame, order: str = "seq") -> bool:
        """Deletes keys, then writes rows, the last by `order` of those with one key (of equals the one with the larger digest).

        False, and nothing happens, where the batch was applied before. A write that ends
        half-way leaves files that no reader looks at; the next try replaces them. Rows with
        a null key are an error. Each touched bucket is read, merged by one aggregation and
        written once; rows meet those of their own key alone."""
        if self.commits().where(F.col("batch") == batch).limit(1).count():
            return False
        number = self.last_commit() + 1
        names = self.schema.fieldNames()
        bucket = self.bucket_of(F.col(self.key))
        checked = F.when(F.col(self.key).isNull(), F.raise_error(F.lit("a row of a stored table has no key"))).otherwise(bucket)
        new = writes.select(*names, F.col(order).cast("long").alias("__at")).withColumn("bucket", checked)
        gone = deletes.select(F.col(self.key)).where(F.col(self.key).isNotNull()).distinct()
        touched = sorted(r["bucket"] for r in new.select("bucket").union(gone.select(bucket)).distinct().collect())  # a number a bucket
        base = self.read(only=touched).join(gone, self.key, "left_anti").select(*names, F.lit(None).cast("long").alias("__at"), bucket.alias("bucket"))
        rows = base.unionByName(new)
        newer = F.struct(F.col("__at").isNotNull(), "__at", F.xxhash64(F.to_json(F.struct(*names))))
        rest = [n for n in names if n != self.key]
        kept = rows.groupBy("bucket", self.key).agg(F.max_by(F.struct(F.lit(0), *rest), newer).alias("r")).select(*[F.col(n) if n == self.key else F.col(f"r.{n}") for n in names], "bucket", F.lit(batch).alias("batch"))
        if touched:
            kept.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path.rstrip('/')}/data")
        filled = [b for b in touched if self._fs.exists(self._at(self._folder(b, batch)))]
        self._commit(number, batch, touched, filled)
        return True

    def expire(self, keep: int = 1) -> int:
        """Deletes folders that none of the last `keep` commits sees, left-overs of broken writes among them; not while a batch is being applied."""
        last = self.last_commit()
        seen = {self._folder(b, batch) for n in range(max(1, last - keep + 1), last + 1) for b, batch in self.state(n).items()}
        gone = 0
        for found in self._fs.globStatus(self._at("data", "bucket=*", "batch=*")) or []:
            where = found.getPath()
            if f"data/{where.getParent().getName()}/{where.getName()}" not in seen:
                gone += bool(self._fs.delete(where, True))
        return gone
