"""The crawler's channel-shaped flow as Structured Streaming jobs.

Sources are file streams over stored tables (``readStream.parquet``); sinks are append-mode Parquet folders under the
shared checkpoint folder (``spark.checkpoint.dir``), with their checkpoint next to them, so a restarted job resumes
where it stopped. A bounded run (the crawler's idle stop) is ``trigger(availableNow=True)``. Only native operators are
used: stateless projections, ``dropDuplicates`` and aggregates; no foreachBatch, no Python state.

State that grows with the crawl (visited URLs, parameter counts) lives in RocksDB on the executors' disks, with
changelog checkpoints: the heap doesn't grow with it, and a micro-batch writes what it changed, not the whole state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import fetches as H
from ..operators import links as L
from ..operators import params as P
from ..operators import report as R
from ..session import scratch_path


def stream_table(spark: SparkSession, folder: str, pattern: str = "*.parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over the Parquet files of ``folder`` matching ``pattern`` (schema taken from the files)."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


def stream_stored(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over one stored table, a Parquet file or a folder of them. A stream takes a folder or a glob path
    but no plain file, so the path's last letter is given as a class of one: that finds either."""
    path = path.rstrip("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def stream_seeds(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """IO2: one seed per line of each text file dropped into ``folder``; a target already seen on an earlier line is
    not admitted again (the visited state is global, kept in the state store across micro-batches)."""
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(folder).select(F.col("value").alias("seed")).dropDuplicates(["seed"])


STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """The session's settings for queries that start inside: state in RocksDB."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(stream: DataFrame, sink: str, checkpoint: str, output_mode: str, **options: str) -> None:
    with _state_on_disk(stream.sparkSession):
        writer = stream.writeStream.format(sink).options(**options).option("checkpointLocation", checkpoint)
        q = writer.outputMode(output_mode).trigger(availableNow=True).start()
    q.awaitTermination()


def run_available(stream: DataFrame, name: str, output_mode: str = "append", out: str | None = None) -> DataFrame:
    """Run a stream over everything available now into a Parquet sink and return the sink as a batch table. ``out``: the
    folder of an earlier run, which goes on where it stopped (a new one in the shared folder if not given)."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, f"stream-{name}")
    _run(stream, "parquet", out + "/checkpoint", output_mode, path=out + "/data")
    return spark.read.parquet(out + "/data")


def run_counts(counts: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Run a streaming count per group (its last column) in update mode over everything available now and return the
    groups as a batch table, read from the state in its checkpoint (state data source): a micro-batch writes changed
    groups only, and no sink holds outdated rows. ``out`` as in :func:`run_available`."""
    spark = counts.sparkSession
    out = out or scratch_path(spark, f"stream-{name}")
    _run(counts, "noop", out + "/checkpoint", "update")
    with _state_on_disk(spark):
        state = spark.read.format("statestore").load(out + "/checkpoint")
    return state.select("key.*", F.col("value.count").alias(counts.columns[-1]))


def stream_dedupe_urls(urls: DataFrame, url: str = "url", event_time: str | None = None,
                       delay: str = "1 hour") -> DataFrame:
    """Admit each canonical URL once.

    Without an event time the state keeps every seen key (the crawler's visited set), in RocksDB on disk. With
    ``event_time`` the state is bounded: duplicates are dropped within the watermark ``delay`` and older keys are
    evicted (``dropDuplicatesWithinWatermark``).
    """
    cols = [url] + ([event_time] if event_time else [])
    c = U.with_canonical(urls.select(*cols), url, "canonical_url").where(F.col("canonical_url").isNotNull())
    if event_time:
        return (
            c.select("canonical_url", event_time).withWatermark(event_time, delay)
            .dropDuplicatesWithinWatermark(["canonical_url"])
        )
    return c.select("canonical_url").dropDuplicates(["canonical_url"])


def stream_links(pages: DataFrame) -> DataFrame:
    """``(src_page_id, src_url, dst_url, pos)`` of each response as it arrives. Stateless: a target that a page gives
    twice (two spellings of one URL) is appended twice; a batch reader of the sink takes the distinct edges."""
    return L.link_targets(pages)


def stream_params(pages: DataFrame) -> DataFrame:
    """S3: parameters of each response appended to the running bag (first claim is per row, no state)."""
    return P.mine_params(pages).select("page_id", "name", "type", "source", "certainty", "url")


def stream_report(fetches: DataFrame, exts: list[str] | None = None, hide_media_urls: bool = True) -> DataFrame:
    """Results consumed while crawling: first-hop results, R1/R2 filters, one line per request URL."""
    r = H.first_hop(fetches)
    if hide_media_urls:
        r = R.hide_media(r)
    if exts:
        r = R.filter_extension(r, exts)
    r = r.dropDuplicates(["request_url"])
    return R.label_results(r, verbosity=2).select("request_url", "status_code", "line")


def stream_param_counts(pages: DataFrame) -> DataFrame:
    """The running summary of the bag: count per (certainty, name) over all responses so far (a streaming aggregate;
    :func:`run_counts` runs it and reads its result)."""
    return param_counts(stream_params(pages))


def param_counts(bag: DataFrame) -> DataFrame:
    """S5 over a bag of parameters, stored or streamed: count per (certainty, name)."""
    return bag.groupBy("certainty", "name").agg(F.count(F.lit(1)).alias("n"))
