"""A custom connector: the integers of a range with their squares, in partitions, batch and stream."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class SeriesDataSource(DataSource):
    """Options: n (rows), parts (partitions; batch), step (rows of a micro-batch; stream)."""

    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> str:
        return "id bigint, square bigint"

    def reader(self, schema):
        return SeriesReader(int(self.options.get("n", 10)), int(self.options.get("parts", 2)))

    def simpleStreamReader(self, schema):
        return SeriesStream(int(self.options.get("n", 10)), int(self.options.get("step", 5)))


class SeriesReader(DataSourceReader):
    def __init__(self, n: int, parts: int):
        self.n, self.parts = n, parts

    def partitions(self):
        edges = [self.n * i // self.parts for i in range(self.parts + 1)]
        return [InputPartition((a, b)) for a, b in zip(edges, edges[1:])]

    def read(self, partition):
        for i in range(*partition.value):
            yield i, i * i


class SeriesStream(SimpleDataSourceStreamReader):
    def __init__(self, n: int, step: int):
        self.n, self.step = n, step

    def initialOffset(self):
        return {"at": 0}

    def read(self, start):
        end = min(self.n, start["at"] + self.step)
        return iter([(i, i * i) for i in range(start["at"], end)]), {"at": end}

    def readBetweenOffsets(self, start, end):
        return iter([(i, i * i) for i in range(start["at"], end["at"])])

    def commit(self, end):
        return None
