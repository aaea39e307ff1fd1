"""Token counts as delta-maintained rollups.

A store has three parts in one folder: ``ledger`` (the last count of each document and tokenizer version, as
additive rows signed by batch), ``totals`` (sums by source, language and tokenizer version, one additive partial
per batch) and ``commits`` (one marker per batch). A batch of signed rows, inserts (+1), deletes (-1) and
revised counts (a delete of the old and an insert of the new count), becomes partial sums under its batch id.
The marker is written last and readers only see batches that have one, so that a batch that died half-way leaves
no trace, a repeated one rewrites its own partials only before its marker stands, and afterwards is a no-op.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_tokens long, sign int"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """``doc_id, source, lang, tokenizer, n_tokens`` for every row; null texts have 0 tokens, null sources and
    languages count under null. ``tokenizer`` is the path of a word-level BPE file, ``version`` its name."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import word_bpe

        count_ids = word_bpe(tokenizer).counts
        for batch in batches:
            sizes = count_ids(batch.column(3))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([version] * len(sizes), pa.string()), pa.array(sizes, pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


class TokenRollup:
    """A store of token totals under ``path`` (a folder that all executors share)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def batches(self) -> list[str]:
        """Committed batch ids."""
        if not self._exists(f"{self.path}/commits"):
            return []
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
        return sorted(f.getPath().getName() for f in files)

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Apply signed rows (``doc_id``, KEYS, ``n_tokens``, ``sign``) as one batch; False if it stands already."""
        if batch in self.batches():
            return False
        rows = rows.select("doc_id", *KEYS, F.col("n_tokens").cast("long").alias("n_tokens"), F.col("sign").cast("int").alias("sign"))
        rows.write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")
        mine = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/batch={batch}")
        sums = mine.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        p = fs.Path(f"{self.path}/commits/{batch}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()
        return True

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{part}/batch={b}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """Counts that stand: ``doc_id``, KEYS, ``n_tokens`` and ``copies`` (how often, for repeated rows)."""
        return self._read("ledger", LEDGER).groupBy("doc_id", *KEYS, "n_tokens").agg(F.sum("sign").cast("long").alias("copies")).where("copies <> 0")

    def insert(self, batch: str, counts: DataFrame) -> bool:
        return self.commit(batch, counts.withColumn("sign", F.lit(1)))

    def delete(self, batch: str, doc_ids: DataFrame) -> bool:
        """Take away every standing count of the documents in ``doc_ids`` (column ``doc_id``)."""
        gone = self.ledger().join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return self.commit(batch, gone.withColumn("sign", F.lit(-1)).select("doc_id", *KEYS, "n_tokens", "sign", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("i")))

    def revise(self, batch: str, counts: DataFrame) -> bool:
        """Replace the standing counts of the documents and tokenizer versions in ``counts`` by these."""
        mine = counts.select("doc_id", *KEYS, "n_tokens")
        old = self.ledger().join(mine.select("doc_id", "tokenizer").distinct(), ["doc_id", "tokenizer"], "left_semi")
        minus = old.select("doc_id", *KEYS, "n_tokens", F.lit(-1).alias("sign"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("i")).drop("i")
        return self.commit(batch, minus.unionByName(mine.withColumn("sign", F.lit(1))))

    def totals(self) -> DataFrame:
        """KEYS, ``n_docs``, ``n_tokens``; groups whose documents have all gone are left out."""
        return self._read("totals", TOTALS).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")

    def cube(self) -> DataFrame:
        """Totals over every subset of KEYS, with ``grouping`` (a bit for each key that is summed over)."""
        return self.totals().cube(*KEYS).agg(F.grouping_id().cast("long").alias("grouping"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
