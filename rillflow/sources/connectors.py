"""Readers of systems whose connectors are jars of their own: what options they are opened with. Each gives (format, options), so that what would be asked of a connector can be seen without it; ``opened`` asks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

Options = tuple[str, dict[str, str]]


def kafka(servers: str, topics: list[str], eof: bool = True) -> Options:
    """Topics given as topic:partition:offset:length; a length of -1 reads to the end."""
    starts: dict[str, dict[str, int]] = {}
    ends: dict[str, dict[str, int]] = {}
    for spec in topics:
        topic, partition, offset, length = (spec.split(":") + ["0", "0", "-1"][spec.count(":") :])[:4]
        starts.setdefault(topic, {})[partition] = int(offset)
        ends.setdefault(topic, {})[partition] = int(offset) + int(length) if int(length) >= 0 else -1
    options = {"kafka.bootstrap.servers": servers, "assign": json.dumps({t: [int(p) for p in ps] for t, ps in starts.items()}), "startingOffsets": json.dumps(starts)}
    return "kafka", options | ({"endingOffsets": json.dumps(ends)} if eof else {})


def kinesis(stream: str, region: str, shard: str | None = None, read_indefinitely: bool = True, interval_ms: int = 100_000) -> Options:
    """A stream, or one shard of it, from its beginning; polled every ``interval_ms``. Not ``read_indefinitely``: use a trigger of what is available now."""
    options = {"streamName": stream, "region": region, "startingposition": "TRIM_HORIZON", "kinesis.executor.idleTimeBetweenReadsInMs": str(interval_ms), "failondataloss": str(read_indefinitely).lower()}
    return "kinesis", options | ({"shardId": shard} if shard else {})


def warehouse(kind: str, project: str, dataset: str, table: str, columns: list[str], timestamp_millis: int | None = None, partitions: int | None = None) -> Options:
    """Columns of a warehouse table as it was at a time, in about so many partitions; ``kind``: the name that its connector goes by."""
    options = {"table": f"{project}.{dataset}.{table}", "readDataFormat": "ARROW", "parentProject": project, "selectedFields": ",".join(columns)}
    if timestamp_millis is not None:
        options["snapshotTimeMillis"] = str(timestamp_millis)
    return kind, options | ({"maxParallelism": str(partitions)} if partitions else {})


def object_store(endpoint: str, key: str, secret: str) -> dict[str, str]:
    """Settings by which Hadoop's file system for object stores, and so every reader here, reaches one; for spark.conf or spark-submit."""
    top = "spark.hadoop.fs.s3a"
    return {f"{top}.endpoint": endpoint, f"{top}.access.key": key, f"{top}.secret.key": secret, f"{top}.path.style.access": "true", f"{top}.experimental.input.fadvise": "random"}


def opened(spark: SparkSession, source: Options, stream: bool = False) -> DataFrame:
    kind, options = source
    return (spark.readStream if stream else spark.read).format(kind).options(**options).load()
