"""Classification of a stream in which every text is classified once ever.

Results are kept by fingerprint.  A blocked Bloom filter stands before them: a
fingerprint has a few bits in one bitmap of 4 KB, so that a batch reads the filter, whose
size is fixed, and then only the buckets of fingerprints that may be known.  What the
filter lets through by mistake costs a read and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlight.functions import text as tx
from wardlight.operators import joins
from wardlight.plans.classify import BROADCAST_BYTES, classify_reports
from wardlight.sources.buckets import BUCKETS, BucketStore, bucket_of
from wardlight.workspace import Workspace

#: Bitmaps of the filter; with ten bits per fingerprint, 4,096 of them serve 13 million.
BLOCKS = 4096
_BITS = 32_768  # of one bitmap
_PROBES = 4

_CLASS = (
    "struct<category: string, severity: int, summary: string, tags: array<string>, translatedText: string, "
    "detectedLanguage: string, classifiedBy: string, confidence: double>"
)
TABLES = {"results": f"bucket int, print string, classification {_CLASS}", "seen": "bucket int, block int, bits binary"}


def _block(name: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), name), F.lit(blocks)).cast("int")


def _bit(name: str, probe: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(probe), name), F.lit(_BITS))


def _all_set(name: str, bits: str) -> Column:
    """True if the bitmap has every bit of the fingerprint."""
    held = F.lit(True)
    for probe in range(_PROBES):
        at = _bit(name, probe)
        byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        held = held & (F.call_function("getbit", byte, (at % 8).cast("int")) == 1)
    return held


class ClassStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, blocks: int = BLOCKS):
        self.spark, self.store, self.buckets, self.blocks = spark, BucketStore(spark, path, TABLES), buckets, blocks

    def add(
        self, rows: DataFrame, version: int, text: str = "text", hint: str = "language", user_category: str = "userCategory",
        workspace: Workspace | None = None,
    ) -> tuple[DataFrame, int]:
        """(rows with ``classification``, texts that had to be classified) for a batch.

        All rows of a fingerprint get the result of the first batch that had it, there of
        the smallest of its texts.  A batch that is taken up again replaces itself.
        """
        ws = workspace or Workspace(self.spark)
        change = self.store.change(version)
        mark = tx.text_fingerprint(F.col(text), F.col(hint), F.nullif(F.col(user_category), F.lit("")))
        marked = ws.write(rows.withColumn("_print", mark), "prints")
        inputs = [text, hint, user_category, *(["enrichment"] if "enrichment" in rows.columns else [])]
        prints = ws.write(
            marked.groupBy("_print").agg(F.min(F.struct(*inputs)).alias("s"))
            .withColumns({"_block": _block("_print", self.blocks), "_bucket": bucket_of("_print", buckets=self.buckets)}),
            "distinct",
        )
        seen = change.read("seen").select(F.col("block").alias("_block"), "bits")
        maybe = prints.join(seen, "_block").filter(_all_set("_print", "bits")).select("_print", "_bucket")
        maybe = ws.write(maybe, "maybe")
        buckets = [r.b for r in maybe.select(F.col("_bucket").alias("b")).distinct().collect()]
        stored = change.read("results", buckets).withColumnRenamed("print", "_print")
        known = ws.write(stored.join(maybe.select("_print"), "_print", "left_semi").select("_print", "classification"), "known")
        new = prints.join(known.select("_print"), "_print", "left_anti").select("_print", "s.*")
        fresh = ws.write(classify_reports(new, text, hint, user_category).select("_print", "classification"), "fresh")

        results = fresh.select(bucket_of("_print", buckets=self.buckets).alias("bucket"), F.col("_print").alias("print"), "classification")
        change.append("results", results)
        self._mark_seen(change, fresh)
        change.commit()
        found = known.unionByName(fresh)
        size = found.agg(F.sum(F.octet_length(F.to_json("classification")))).first()[0] or 0
        few = joins.BROADCAST_ROWS if size <= BROADCAST_BYTES else 0
        return joins.lookup(marked, found, "_print", broadcast_rows=few).drop("_print"), fresh.count()

    def _mark_seen(self, change, fresh: DataFrame) -> None:
        bits = fresh.select(
            _block("_print", self.blocks).alias("block"), F.explode(F.array(*[_bit("_print", p) for p in range(_PROBES)])).alias("bit")
        )
        new = bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
        bucket = F.pmod("block", F.lit(self.buckets)).cast("int")
        touched = [r.b for r in new.select(bucket.alias("b")).distinct().collect()]
        both = change.read("seen", touched).select("block", "bits").union(new).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
        change.replace("seen", both.withColumn("bucket", bucket), touched)


def stream_classify(
    rows: DataFrame, store_path: str, out_path: str, checkpoint: str, every: str | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Classify arriving rows; each batch's results go to ``out_path/batch=<id>``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        ws = Workspace(batch.sparkSession)
        kept = ClassStore(batch.sparkSession, store_path, buckets)
        done, _ = kept.add(batch, batch_id, workspace=ws)
        done.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        kept.store.vacuum()
        ws.close()

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
