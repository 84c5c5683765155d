"""Structured Streaming jobs over hits and source runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tallyloom.operators import merge
from tallyloom.session import discard, stored
from tallyloom.streaming.processors import GROUPS, HEALTH, PROMOTED, STORE, STORE_CONF, EvidenceGate, LateRouter, SourceHealth


def hits(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files in the folder at path, or of the one file there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 4)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return reader.parquet(path)


def deduplicated(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first hit of each key within the watermark's reach."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, at: str, size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Hits and failures of each source in tumbling or sliding windows."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, delay).groupBy(w.alias("w"), "source_id").agg(F.count(F.lit(1)).alias("hits"), F.count_if("failed").alias("failures"))


def session_counts(stream: DataFrame, at: str, gap: str, delay: str = "1 day") -> DataFrame:
    """Hits of each source in sessions that end after a gap."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), "source_id").agg(F.count(F.lit(1)).alias("hits"))


def split_late(stream: DataFrame, at: str, baseline: Column) -> tuple[DataFrame, DataFrame]:
    """Rows from the baseline on, and older ones, which are a backfill branch and not lost to a watermark."""
    return stream.where(F.col(at) >= baseline), stream.where(F.col(at) < baseline)


def _with_timers(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """A processor with timers on the watermark. Such state needs a store that finds keys by their time, which is set for the session."""
    stream.sparkSession.conf.set(STORE_CONF, STORE)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, mode, "eventTime")


def source_health(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The state of each source after each batch (kind "state"), and an alarm (kind "alarm") once failures have lasted for more than twice its interval.

    stream: source_id, ts, seq, failed, hours. An alarm comes from a timer where the source falls silent, or with the first row after the due time.
    """
    rows = stream.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts")).withColumn("group", F.pmod(F.xxhash64("source_id"), F.lit(GROUPS)))
    out = _with_timers(rows, "group", SourceHealth(), HEALTH, "update")
    return out.select("source_id", "kind", "by_timer", "runs", "consecutive_failures", *[F.timestamp_micros(c).alias(n) for c, n in (("first_at", "first_failure_at"), ("success_at", "last_success"), ("alarm_at", "alarm_at"))])


def packed(rows: DataFrame, key: str) -> DataFrame:
    """rows with those of one key that a task reads together as one row of lists: PySpark hands rows to a keyed processor one by one, at many times the cost of the fold."""
    others = [f for f in rows.schema.fields if f.name != key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.Table.from_batches([batch]).group_by(key, use_threads=False).aggregate([(f.name, "list") for f in others])
            named = lists.select([key, *[f"{f.name}_list" for f in others]]).rename_columns([key, *[f.name for f in others]])
            yield from named.to_batches()

    schema = ", ".join([f"`{key}` {rows.schema[key].dataType.simpleString()}", *[f"`{f.name}` array<{f.dataType.simpleString()}>" for f in others]])
    return rows.mapInArrow(run, schema)


def gate(stream: DataFrame, span: str, delay: str = "1 hour") -> DataFrame:
    """Candidates whose fingerprint's evidence reaches the gate, each once, with the one that opened it.

    stream: fingerprint, ts, seq, candidate_id, tier, owner, in_scope. State lasts for `span` after a fingerprint's last row (a number and a unit).
    """
    owned = F.col("owner").isNotNull()
    strength = F.when((F.col("tier") == "authoritative") & F.col("in_scope"), EvidenceGate.HIGH).when((F.col("tier") == "trusted") & owned, EvidenceGate.TRUSTED).otherwise(0)
    rows = stream.withWatermark("ts", delay).select("fingerprint", F.unix_micros("ts").alias("at"), "seq", "candidate_id", F.coalesce("owner", F.lit(0)).alias("owner"), owned.alias("known"), strength.alias("strength"))
    return _with_timers(packed(rows, "fingerprint"), "fingerprint", EvidenceGate(pd.Timedelta(span) // pd.Timedelta("1ms")), PROMOTED, "append")


ROUTED = "source_id bigint, seq bigint, ts timestamp, at bigint, late boolean"


def with_late_branch(open_stream: Callable[[], DataFrame], delay: str) -> tuple[DataFrame, DataFrame]:
    """(on time, late) of a stream of (source_id, ts, seq): rows at or behind the watermark as their batch begins are late. No row is lost.

    On-time rows keep the watermark, so windows over them end in append mode and their state goes; both branches belong in one query (a union),
    which has one watermark. Each branch opens the stream for itself: a union of two branches of one stream loses rows of the second.
    """

    def marked() -> DataFrame:
        stream = open_stream()
        stream.sparkSession.conf.set(STORE_CONF, STORE)
        rows = stream.withWatermark("ts", delay).select("source_id", "seq", F.unix_micros("ts").alias("at"))
        return packed(rows, "source_id").groupBy("source_id").transformWithStateInPandas(LateRouter(), ROUTED, "append", "eventTime", eventTimeColumnName="ts")

    return marked().where("not late").drop("at"), marked().where("late").select("source_id", "seq", F.timestamp_micros("at").alias("ts"), "late")


def windows_with_late(open_stream: Callable[[], DataFrame], delay: str, window: Callable[[str], Column]) -> DataFrame:
    """source_id, begins, hits, late in append mode: windows (sliding, tumbling or sessions) of on-time rows as they end, and each late row by itself."""
    now, late = with_late_branch(open_stream, delay)
    ended = now.groupBy(window("ts").alias("w"), "source_id").agg(F.count(F.lit(1)).alias("hits")).select("source_id", F.col("w.start").alias("begins"), "hits", F.lit(False).alias("late"))
    return ended.unionByName(late.select("source_id", F.col("ts").alias("begins"), F.lit(1).cast("bigint").alias("hits"), "late"))


def run_to_end(stream: DataFrame, mode: str, folder: str, write: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over what is there, each batch written under its number (a batch that is run again replaces itself)."""

    def each(batch: DataFrame, number: int) -> None:
        if write:
            write(batch, number)
        else:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(each).start()
    q.awaitTermination()


EDGES = ("event_id", "event_ord", "fingerprint", "facts", "evidence_id", "url", "legacy_id", "owner", "tier", "in_scope")


def ledger_sink(root: str, baseline: str) -> Callable[[DataFrame, int], None]:
    """A write function for run_to_end: each batch of candidates is merged into the ledger under root and committed as a whole.

    A batch meets the ledger's events and the candidates that still wait. It commits the ledger's evidence, the waiting candidates
    and one row of its history under its own number, so a batch that is run again finds the ledger as it was before it and replaces
    what it wrote; a batch that breaks off before its manifest row changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run, last = f"{number:010d}", merge.last_run(spark, root, before=f"{number:010d}")
        rows = batch.select(*merge.READ)
        known = spark.createDataFrame([], merge.SEED) if last is None else merge.current(spark, root, "evidence", last).select(*EDGES)
        if last is not None:
            rows = rows.unionByName(merge.current(spark, root, "waiting", last).select(*merge.READ))
        rows = stored(rows, "candidates")
        out = stored(merge.merge_ledger(rows, known, baseline), "merged")
        done = out.where("row_kind = 'candidate'").select("candidate_id", "component", "event_id", "outcome", "by_seq", "by_candidate", "place")
        events = out.where("row_kind = 'event'").select("event_id", F.col("facts").alias("now"))
        judged = stored(rows.join(done, "candidate_id"), "judged")
        new = judged.where("event_id is not null")
        begun = new.where(F.col("outcome").isin("first", "backfill")).select("event_id", "fingerprint")
        names = known.groupBy("event_id").agg(F.min("fingerprint").alias("fingerprint")).unionByName(begun)
        # the order in which evidence came decides who owns a key: by batch, then by place in its component (components share no key)
        order = F.row_number().over(Window.partitionBy("component").orderBy("by_seq", "by_candidate", "place"))
        new = new.drop("fingerprint", "facts").withColumn("event_ord", F.lit(number + 1).cast("bigint") * (1 << 32) + order)
        edges = known.drop("fingerprint", "facts").unionByName(new.select(*[c for c in EDGES if c not in ("fingerprint", "facts")]))
        evidence = edges.join(names, "event_id").join(events.withColumnRenamed("now", "facts"), "event_id").select(*EDGES)
        waiting = judged.where("outcome = 'pending'").select(*merge.READ)
        history = out.where("row_kind = 'candidate'").groupBy("outcome").count().withColumn("batch", F.lit(number))
        merge.commit({"evidence": evidence, "waiting": waiting, "history": history}, root, run)
        discard(rows, out, judged)

    return write


def latest(df: DataFrame, *key: str) -> DataFrame:
    """The row of the last batch for each key."""
    others = [c for c in df.columns if c not in key and c not in ("batch", "n")]
    best = df.groupBy(*key).agg(F.max(F.struct("batch", *others)).alias("m"))
    return best.select(*key, *[F.col(f"m.{c}").alias(c) for c in others])


def advance_cursor(cursors: DataFrame, runs: DataFrame) -> DataFrame:
    """source_id, cursor_at after runs(source_id, ts, failed): the mark moves on success only, and never back."""
    new = runs.where("not failed").groupBy("source_id").agg(F.max("ts").alias("seen"))
    return cursors.join(new, "source_id", "full").select("source_id", F.greatest("cursor_at", "seen").alias("cursor_at"))
