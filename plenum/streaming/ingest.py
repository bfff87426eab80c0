"""Streams of arriving votes: idempotent ingest, live tallies, time buckets, incremental agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions.rules import OPTIONS, outcome
from plenum.operators.agreement import agreement


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_arrivals(stream: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """Each key once, as long as its repeats come within the delay; state is dropped after it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def append_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str):
    """Append rows whose key the target table (Parquet folder) does not hold yet; the same batch twice adds nothing."""
    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(keys)
        if exists(batch.sparkSession, target):
            fresh = fresh.join(batch.sparkSession.read.schema(batch.schema).parquet(target).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_tally(stream: DataFrame) -> DataFrame:
    """(vote_event_id, requirement, options, result) so far; output mode update or complete."""
    n = stream.groupBy("vote_event_id", "requirement").agg(*[F.sum((F.col("option") == o).cast("long")).alias(o) for o in OPTIONS])
    return n.withColumn("result", outcome(F.col("a_favor"), F.col("en_contra"), F.col("abstencion"), F.col("requirement")))


def buckets(stream: DataFrame, at: str, key: str, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts per key in tumbling or sliding buckets; rows later than the delay are dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, delay).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


VOTE = "vote_event_id long, voter_id long, option string"
EDGE = "a long, b long, n_shared long, n_agree long"


def _none(spark: SparkSession, schema: str) -> DataFrame:
    """No rows; they come from no Python task."""
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))])


def _earlier(spark: SparkSession, path: str, schema: str, number: int | None) -> DataFrame:
    """What batches before the number have left in a folder; all of them for None."""
    if not exists(spark, path):
        return _none(spark, schema)
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    return (rows if number is None else rows.filter(F.col("batch") < number)).drop("batch")


def merge_agreement(batch: DataFrame, number: int, folder: str) -> None:
    """Add a batch of votes (vote_event_id, voter_id, option) to the votes and agreement edges in the folder.

    A batch writes two folders of its own number and reads those of smaller
    numbers, so that a batch given again, also after a failure between the two,
    leaves what it would have left. Votes that came before, and absences, add
    nothing; of two for one event and voter in a batch the smaller option
    counts. Only events of the batch are read again, and only pairs with a new
    vote are formed.
    """
    spark = batch.sparkSession
    votes = f"{folder}/votes"
    before = _earlier(spark, votes, VOTE, number)
    fresh = batch.filter("option <> 'ausente'").groupBy("vote_event_id", "voter_id").agg(F.min("option").alias("option"))
    fresh.join(before.select("vote_event_id", "voter_id"), ["vote_event_id", "voter_id"], "left_anti").select("vote_event_id", "voter_id", "option").write.mode("overwrite").parquet(f"{votes}/batch={number}")
    new = spark.read.schema(VOTE).parquet(f"{votes}/batch={number}")
    old = before.join(new.select("vote_event_id").distinct(), "vote_event_id", "left_semi")
    both = new.withColumn("fresh", F.lit(True)).unionByName(old.withColumn("fresh", F.lit(False)))
    agreement(both, fresh="fresh").write.mode("overwrite").parquet(f"{folder}/edges/batch={number}")


def agreement_stream(stream: DataFrame, folder: str, checkpoint: str):
    """Keep the agreement edges of arriving votes in the folder; `agreement_so_far` reads them."""
    return stream.writeStream.foreachBatch(lambda batch, number: merge_agreement(batch, number, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def agreement_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """(a, b, n_shared, n_agree) over all batches."""
    return add_counts(_earlier(spark, f"{folder}/edges", EDGE, None), _none(spark, EDGE), ["a", "b"], ["n_shared", "n_agree"])


def add_counts(old: DataFrame, new: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Two tables of additive counts as one: how agreement edges grow batch by batch."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
