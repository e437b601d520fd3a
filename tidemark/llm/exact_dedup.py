"""Exact deduplication as a stream with keyed state that lives on disk and never expires.

One stream turns the rows of new files into keys, so that texts are hashed once; a second stream over these keys feeds
a streaming aggregation over RocksDB state. The key of the state is the SHA-256 digest and the length of the normalised
text; its value holds the stable identifier of the row that stays, the locator of its content (file and row within the
file) and the number of rows seen. Later batches only update the keys they touch. Within the batch that changes a key,
every row that is new to a group of several is fetched by its locator and compared, byte for byte, with the row that
stays; a difference under one digest fails the stream. Rows compared once are noted and not read for that again.

Defined results: a null text counts as empty; empty and white-space-only texts are equal to each other. Of equal texts
one row stays: the one with the most code points of the original text, then with the smallest doc_id (null last), then
with the first locator, so that also of rows that share a doc_id, or have none, exactly one is kept. Texts are compared
by joins on locators, so neither repeated nor null ids make pairs; a very long text is one value of one row. An empty
table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WS_CHARS, materialize, shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bounds the memory of all RocksDB instances of an executor together.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else each instance, however small, sets aside 4 MB of disk.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
GROUP = ["digest", "norm_chars"]
LOCATOR = ["file", "row"]
#: Bits of the filter of the rows whose texts are sent to be compared (false positives only send more).
CELLS = 1 << 25
_CHECKED = "file string, row long"


def normalized(text: Column) -> Column:
    """The text without white space."""
    return F.translate(F.coalesce(text, F.lit("")), WS_CHARS, "")


def _located(docs: DataFrame) -> DataFrame:
    """doc_id, text and the locator of each row of a file source."""
    return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, chars, digest, norm_chars and the locator of each row of a file source."""
    norm = normalized(F.col("text"))
    digest = F.unhex(F.sha2(F.encode(norm, "UTF-8"), 256))
    return _located(docs).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), digest.alias("digest"), F.length(norm).alias("norm_chars"), *LOCATOR)


def exactly(path: str) -> str:
    """A glob that only path itself meets: a stream reads a single file by a glob alone, a folder as well."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _near(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """At least the rows of texts whose locators are in wanted: a broadcast filter of bounded size keeps back most others.

    Without it a join sends all texts through a shuffle, once wanted is too large to be broadcast.
    """
    cell = F.pmod(F.xxhash64(*LOCATOR), F.lit(CELLS))
    word, bit = F.shiftright(cell, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(cell, F.lit(64)).cast("int")).alias("bit")
    words = wanted.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return texts.select("*", word, bit).join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select(*texts.columns)


def _unequal(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of texts (locator, group, norm) that differ from the row that stays in their group."""
    held = texts.join(groups.select(F.col("keep_file").alias("file"), F.col("keep_row").alias("row")), LOCATOR).select(*GROUP, F.col("norm").alias("held"))
    return texts.join(held, GROUP).where("norm <> held")


def _check(spark: SparkSession, path: str, base: str, changed: DataFrame, batch: int) -> None:
    """Compares the rows that are new in the changed groups of several rows with the row that stays."""
    groups = changed.where("n > 1").select(*GROUP, F.col("best.file").alias("keep_file"), F.col("best.row").alias("keep_row"))
    members = spark.read.schema(_key_schema(spark, path)).parquet(f"{base}/keys").select(*GROUP, *LOCATOR).join(groups.select(*GROUP), GROUP)
    new = members
    if batch:
        done = spark.read.schema(f"{_CHECKED}, batch long").parquet(f"{base}/checked").where(F.col("batch") < batch)
        new = members.join(done, LOCATOR, "left_anti")
    holders = members.join(groups.select(F.col("keep_file").alias("file"), F.col("keep_row").alias("row")), LOCATOR, "left_semi")
    wanted = materialize(new.unionByName(holders).distinct())
    # Written out before they are compared: in one plan, the optimizer would hash all texts again, as further keys of the join.
    near = _near(_located(spark.read.parquet(path)), wanted)
    texts = materialize(near.join(wanted, LOCATOR).select(*LOCATOR, *GROUP, normalized(F.col("text")).alias("norm")))
    if not _unequal(texts, groups).isEmpty():
        raise ValueError("two texts share a SHA-256 digest")
    wanted.select(*LOCATOR).write.mode("overwrite").parquet(f"{base}/checked/batch={batch}")


def _key_schema(spark: SparkSession, path: str):
    return keyed(spark.read.parquet(path)).schema


def _save(changed: DataFrame, batch: int, path: str, base: str) -> None:
    """A batch of the state: its changed groups are written, then compared. A repeated batch does the same again."""
    spark = changed.sparkSession
    changed.write.mode("overwrite").parquet(f"{base}/groups/batch={batch}")
    _check(spark, path, base, spark.read.schema(changed.schema).parquet(f"{base}/groups/batch={batch}"), batch)


def run_streams(spark: SparkSession, path: str, base: str) -> None:
    """Takes in the rows that are new since the last call with the same base: keys go to base/keys, changed state to base/groups.

    path: a folder of Parquet files, or a single file, with doc_id and text; siblings of a like name are not read.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    old = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        keys = keyed(spark.readStream.schema(schema).parquet(exactly(path)))
        sink = keys.writeStream.format("parquet").option("path", f"{base}/keys").option("checkpointLocation", f"{base}/keys-log")
        sink.trigger(availableNow=True).start().awaitTermination()
        best = F.min(F.struct((-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", *LOCATOR))
        state = spark.readStream.schema(keys.schema).parquet(f"{base}/keys").groupBy(*GROUP).agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
        sink = state.writeStream.outputMode("update").option("checkpointLocation", f"{base}/groups-log").foreachBatch(partial(_save, path=path, base=base))
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def groups(spark: SparkSession, base: str) -> DataFrame:
    """The last row of every key: digest, norm_chars, keep_id, locator, n. Written out, so that joins with it can split hot keys."""
    last = spark.read.parquet(f"{base}/groups").groupBy(*GROUP).agg(F.max_by(F.struct("best", "n"), "batch").alias("s"))
    return materialize(last.select(*GROUP, F.col("s.best.doc_id").alias("keep_id"), F.col("s.best.file").alias("keep_file"), F.col("s.best.row").alias("keep_row"), F.col("s.n").alias("n")))


def decide(keys: DataFrame, kept_rows: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. No text is read: the streams have compared them."""
    stays = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return keys.join(kept_rows, GROUP).select("doc_id", "keep_id", F.col("n").alias("group_size"), stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup_path(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """The decision for every row of the table at path. base: a folder of earlier calls, to take in only what is new."""
    if spark.read.parquet(path).isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    base = base or shared_dir(spark)
    run_streams(spark, path, base)
    return decide(spark.read.schema(_key_schema(spark, path)).parquet(f"{base}/keys"), groups(spark, base))


#: For unique doc_ids.
SQL = r"""
with keyed as (
  select doc_id, coalesce(length(text), 0) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
ranked as (
  select *, first_value(doc_id) over (partition by norm order by chars desc, doc_id) as keep_id,
         count(*) over (partition by norm) as group_size from keyed)
select doc_id, keep_id, group_size::bigint as group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from ranked
"""
