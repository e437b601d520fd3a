"""A streaming data source over a paged change feed of several partitions, with offsets that survive a restart.

Options: heads, the address of the newest offsets ({"partitions": {"0": 17, ...}}: the next offset of each partition); url of
a page of one partition, with {partition}, {offset} and {size}, which answers {"items": [{"offset", "key", "value"}, ...]} in
the order of offsets; topic, the name that rows carry; size of a page; rows, the most offsets of an input partition;
acknowledge, an address that gets the offsets of a batch by POST once its results are safe (left out if not given).

A batch is a range of offsets for each partition, cut into tasks by their number, so that a partition with a long backlog
is read by many tasks. Spark's checkpoint holds the offsets: a query that is started again reads the batch that wasn't
committed again, and then goes on behind it. A partition that appears later is read from its start. A feed that no longer
has what a batch covers fails the query; offsets may have gaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.sources.calls import address, call, fetch, invalid

MESSAGES = "key string, value string, topic string, partition int, offset long"


@dataclass
class _Range(InputPartition):
    """The offsets start to stop, stop excluded, of a partition of the feed."""

    partition: str
    start: int
    stop: int


class _Feed(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.heads, self.url, self.topic = options["heads"], options["url"], options.get("topic", "candidate-changes")
        self.acknowledge, self.size, self.rows = options.get("acknowledge"), int(options.get("size", 500)), int(options.get("rows", 100_000))
        if self.size < 1 or self.rows < 1:
            raise ValueError("size and rows must be 1 or more")

    def initialOffset(self) -> dict:
        return {p: 0 for p in self._heads()}

    def latestOffset(self) -> dict:
        return self._heads()

    def _heads(self) -> dict[str, int]:
        heads = fetch("feed heads read", self.heads).get("partitions")
        if not isinstance(heads, dict):
            raise invalid("feed heads read")
        return {str(p): int(n) for p, n in heads.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        cut = [(p, range(start.get(p, 0), stop, self.rows), stop) for p, stop in sorted(end.items())]
        return [_Range(p, at, min(at + self.rows, stop)) for p, starts, stop in cut for at in starts]

    def read(self, partition: _Range) -> Iterator[tuple]:
        at = partition.start
        while at < partition.stop:
            items = fetch("feed read", address(self.url, partition=partition.partition, offset=at, size=self.size)).get("items") or []
            if not items:
                raise invalid("feed read", "offsets are gone")
            for item in items:
                if at <= item["offset"] < partition.stop:
                    yield item.get("key"), item.get("value"), self.topic, int(partition.partition), item["offset"]
            at = max(at, items[-1]["offset"]) + 1

    def commit(self, end: dict) -> None:
        if self.acknowledge:
            call("feed acknowledgement", self.acknowledge, method="POST", body={"partitions": end})


class ChangeFeed(DataSource):
    """spark.dataSource.register(ChangeFeed); see feed_messages()."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return MESSAGES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Feed(self.options)


def feed_messages(spark: SparkSession, heads: str, url: str, **options: object) -> DataFrame:
    """A stream of key, value, topic, partition and offset for streaming.inbox."""
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("change_feed").options(heads=heads, url=url, **options).load()
