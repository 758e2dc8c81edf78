"""A Spark data source for grids: spark.read.format("grid") gives r, c and one column for each band.

Options: height, width, bands, seed, block. Values come from a seeded generator with fault lines (a synthetic stack);
each partition makes one block of rows, so a grid of any size is read in parallel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RowBlock(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class GridReader(DataSourceReader):
    def __init__(self, options):
        self.height, self.width = int(options.get("height", 100)), int(options.get("width", 100))
        self.bands, self.seed, self.block = int(options.get("bands", 3)), int(options.get("seed", 42)), int(options.get("block", 64))

    def partitions(self):
        return [RowBlock(a, min(self.height, a + self.block)) for a in range(0, self.height, self.block)]

    def read(self, partition: RowBlock):
        import pyarrow as pa

        for r in range(partition.start, partition.stop):
            draw = np.random.default_rng([self.seed, r])
            values = draw.normal(size=(self.bands, self.width)).astype(np.float32)
            line = (r * 3 // 2 + self.seed) % self.width
            values[0, line] += 8
            columns = [pa.array([r] * self.width, pa.int32()), pa.array(np.arange(self.width), pa.int32()), *(pa.array(v) for v in values), pa.array((np.arange(self.width) == line).astype(np.int8))]
            yield pa.RecordBatch.from_arrays(columns, names=["r", "c", *(f"b{i + 1:02d}" for i in range(self.bands)), "label"])


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        bands = ", ".join(f"b{i + 1:02d} float" for i in range(int(self.options.get("bands", 3))))
        return f"r int, c int, {bands}, label byte"

    def reader(self, schema):
        return GridReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(GridSource)
