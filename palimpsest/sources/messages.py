"""Reading and appending the message log, and its high-water marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.hashing import message_hash
from palimpsest.operators.ordered import first_per_key


def read_messages_jdbc(spark: SparkSession, url: str, *, lower: int, upper: int, table: str = "messages", key: str = "id", parts: int = 64, **options) -> DataFrame:
    """A live database table, read in parallel id ranges between the least and the greatest id, which the caller states.

    Rows outside the bounds are read too, by the first and the last task.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return reader.options(**options).load()


def scan_messages(msgs: DataFrame, after_id: int = 0, limit: int | None = None) -> DataFrame:
    """User and assistant rows after an id; ``limit`` makes it a page."""
    rows = msgs.where(F.col("role").isin("user", "assistant") & ~F.col("is_summary") & (F.col("id") > after_id))
    return rows.orderBy("id").limit(limit) if limit else rows


def scan_messages_since(msgs: DataFrame, since=None, after_id: int | None = None, inclusive: bool = False, limit: int | None = None) -> DataFrame:
    """User and assistant rows after a mark. The mark is (ts, id): rows at the same time with a later id count."""
    rows = msgs.where(F.col("role").isin("user", "assistant"))
    if since is not None:
        mark = F.lit(since).cast("timestamp")
        if inclusive:
            rows = rows.where(F.col("ts") >= mark)
        elif after_id is None:
            rows = rows.where(F.col("ts") > mark)
        else:
            rows = rows.where((F.col("ts") > mark) | ((F.col("ts") == mark) & (F.col("id") > after_id)))
    return rows.orderBy("ts", "id").limit(limit) if limit else rows


def with_hash(msgs: DataFrame) -> DataFrame:
    return msgs.withColumn("content_hash", message_hash("content", "tool_calls_json", "tool_call_id"))


_KEYS = {"exact": ["session_id", "role", "ts", "content_hash"], "content": ["session_id", "role", "content_hash"]}


def new_messages(batch: DataFrame, target: DataFrame, dedupe_on: str = "exact") -> DataFrame:
    """Rows of the batch to append: not in the target, and the first of their key inside the batch."""
    keys = _KEYS[dedupe_on]
    fresh = with_hash(batch).join(with_hash(target).select(*keys).distinct(), keys, "left_anti")
    return first_per_key(fresh, keys, ["id"])


def sink_messages(batch: DataFrame, target: DataFrame, path: str, dedupe_on: str = "exact") -> None:
    new_messages(batch, target, dedupe_on).write.mode("append").parquet(path)


def message_id_lookup(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Id under which each batch row is stored: the newest row with its session and hash."""
    ids = with_hash(stored).groupBy("session_id", "content_hash").agg(F.max("id").alias("stored_id"))
    return with_hash(batch).join(ids, ["session_id", "content_hash"], "left")


def hwm_read(marks: DataFrame) -> DataFrame:
    """The furthest mark."""
    return marks.agg(F.max("last_message_ts").alias("last_message_ts"), F.max("last_id").alias("last_id"))


def hwm_write(marks: DataFrame, processed: DataFrame, processed_at) -> DataFrame:
    """Marks with one row added for a processed batch; an empty batch adds none."""
    new = processed.agg(F.max("ts").alias("last_message_ts"), F.max("id").alias("last_id")).where("last_id IS NOT NULL")
    return marks.unionByName(new.withColumn("processed_at", F.lit(processed_at).cast("timestamp")))
