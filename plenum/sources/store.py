"""Reading and writing: the model's tables, idempotent loads, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a given schema; empty texts are null."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="")


def select_events(events: DataFrame, legislature=None, chamber=None, result=None) -> DataFrame:
    """Events that meet all the given conditions; each goes down to the scan."""
    for column, value in (("leg", legislature), ("chamber", chamber), ("result", result)):
        if value is not None:
            events = events.filter(F.col(column) == value)
    return events


def select_window(votes: DataFrame, kind: str, value) -> DataFrame:
    """Votes of a legislature, of an inclusive range of dates, or of the events in a table of ids."""
    if kind == "legislatura":
        return votes.filter(F.col("leg") == value)
    if kind == "dates":
        return votes.filter(F.col("start_date").between(*value))
    if kind == "events":
        return votes.join(value.select("vote_event_id").distinct(), "vote_event_id", "left_semi")
    raise ValueError(f"unknown kind of window: {kind}")


def select_where(rows: DataFrame, *conditions) -> DataFrame:
    """Rows that meet all conditions; None stands for no condition."""
    for condition in conditions:
        if condition is not None:
            rows = rows.filter(condition)
    return rows


def select_votes(votes: DataFrame, events: DataFrame | None, *conditions) -> DataFrame:
    """Votes that meet all conditions, with the columns of their events if given."""
    got = select_where(votes, *conditions)
    return got if events is None else got.join(events, "vote_event_id")


def new_events(rows: DataFrame, loaded: DataFrame, people: DataFrame) -> DataFrame:
    """Votes (source_id, vote_event_id, voter_id, ..) of events whose source_id is not loaded yet, by people who are known, each voter once."""
    return rows.join(loaded.select("source_id").distinct(), "source_id", "left_anti").join(people.select("voter_id").distinct(), "voter_id", "left_semi").dropDuplicates(["vote_event_id", "voter_id"])


def unpivot_counts(wide: DataFrame, group: str, options: tuple[str, ...] = ("a_favor", "en_contra", "abstencion", "ausente")) -> DataFrame:
    """(vote_event_id, group, option, value) from one column per option: counts above 0, and totals with a null group."""
    parties = wide.unpivot(["vote_event_id", group], list(options), "option", "value").filter("value > 0")
    totals = parties.groupBy("vote_event_id", "option").agg(F.sum("value").alias("value")).withColumn(group, F.lit(None).cast(wide.schema[group].dataType))
    return parties.unionByName(totals)


def explode_bundle(bundles: DataFrame) -> dict[str, DataFrame]:
    """Events, votes and counts from nested rows (event, votes[], counts[]); counts of 0 are left out, totals have a null group."""
    event = bundles.select("event.*")
    votes = bundles.select(F.col("event.id").alias("vote_event_id"), F.explode("votes").alias("v")).select("vote_event_id", "v.*")
    counts = bundles.select(F.col("event.id").alias("vote_event_id"), F.explode("counts").alias("c")).select("vote_event_id", "c.*").filter("value > 0")
    totals = counts.groupBy("vote_event_id", "option").agg(F.sum("value").alias("value")).withColumn("group_id", F.lit(None).cast("string"))
    return {"vote_event": event, "vote": votes, "count": counts.unionByName(totals, allowMissingColumns=True)}


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key does not exist yet, each key once: loading them again adds nothing."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def export_json(df: DataFrame, path: str, digits: int = 6) -> None:
    """Rows as JSON lines, doubles rounded."""
    df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; lists are joined by a bar."""
    df.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").csv(path, header=True)


def export_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices and edges as tables; missing texts are empty."""
    vertices.na.fill("").write.mode("overwrite").parquet(f"{path}/vertices")
    edges.na.fill("").write.mode("overwrite").parquet(f"{path}/edges")
