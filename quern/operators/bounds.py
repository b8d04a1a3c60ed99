"""The cursor from which the newest n records start, found by histograms and a small top-n."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A top-n of at most so many cursors goes through one task.
SMALL = 100_000
_CELLS = 1024


def newest_bound(df: DataFrame, n: int) -> int | None:
    """The smallest cursor among the n newest records; None if there are no more than n. Cursors are distinct."""
    cursors = df.select("cursor")
    total, low, high = cursors.agg(F.count(F.lit(1)), F.min("cursor"), F.max("cursor")).first()
    if total <= n:
        return None
    left = n  # still to be found between low and high
    while True:
        inside = cursors.filter(F.col("cursor").between(low, high))
        if left <= SMALL:
            return inside.orderBy(F.desc("cursor")).limit(left).agg(F.min("cursor")).first()[0]
        width = max(1, -(-(high - low + 1) // _CELLS))
        cells = {r["cell"]: r["n"] for r in inside.groupBy(F.expr(f"(cursor - {low}) div {width}").alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for cell in sorted(cells, reverse=True):
            if cells[cell] >= left:
                break
            left -= cells[cell]
        low, high = low + cell * width, min(high, low + (cell + 1) * width - 1)
        if width == 1:
            return low
