"""Recognition slice by slice as a table function, for SQL.

    SELECT * FROM recognise_chunks(TABLE(slices) PARTITION BY page_id ORDER BY offset)

`slices` has (page_id, width, height, offset, size), as `windows.sliced` and
`layout.chunked` make them.  The function that recognises is given when the table function
is registered; it takes one slice at a time, so a page of any height needs the memory of one
slice, and pages are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

RESULT = "page_id bigint, offset bigint, line_idx bigint, text string, x double, y double, width double, height double, orientation double, confidence double"
#: A line of a slice: text, x, y, width, height in shares of the slice, orientation, confidence.
Line = tuple[str, float, float, float, float, float, float]


def register(spark: SparkSession, recognise: Callable[[int, int, int, int, int], list[Line]], name: str = "recognise_chunks") -> None:
    """Make `recognise` (page_id, width, height, offset, size) the table function `name`."""

    class Chunks:
        def eval(self, row) -> Iterator[tuple]:
            for n, line in enumerate(recognise(row["page_id"], row["width"], row["height"], row["offset"], row["size"])):
                yield (row["page_id"], row["offset"], n, *line)

    spark.udtf.register(name, udtf(Chunks, returnType=RESULT))


def recogniser(name: str = "recognise_chunks") -> Callable[[DataFrame], DataFrame]:
    """The registered table function as `layout.chunked` takes it."""

    def run(slices: DataFrame) -> DataFrame:
        return slices.sparkSession.sql(f"SELECT * FROM {name}(TABLE(SELECT page_id, width, height, offset, size FROM {{slices}}) PARTITION BY page_id ORDER BY offset)", slices=slices)

    return run
