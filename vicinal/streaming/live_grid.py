"""A grid that grows with a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.grid import GridIndex


class LiveGrid:
    """`index` is the grid of the records so far; handles taken before stay as they were.

    Each micro-batch touches only the cells that its records fall into. A batch that is repeated
    within the driver's life is added once; the grid itself lives as long as the driver.
    """

    def __init__(self, index: GridIndex) -> None:
        self.index = index
        self._added = -1

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Adds the records of a stream that has the grid's columns, single ones or many."""

        def batch(rows: DataFrame, number: int) -> None:
            if number > self._added and not rows.isEmpty():
                self.index = self.index.add(rows)
                self._added = number

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
