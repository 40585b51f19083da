"""Places of rows in a total order without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.shared import materialised

#: monotonically_increasing_id() keeps the row number inside a partition in its low bits.
_ROW = (1 << 33) - 1


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """df with each row's place (from 0) in the ascending order of the given columns.

    Rows are dealt in ranges and sorted there; a range's first place is the number of rows in those before it (one
    count a partition). Rows that agree in all given columns are placed next to each other in no fixed order.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = materialised(rows).withColumn("__part", F.shiftright("__id", 33)).withColumn("__row", F.col("__id").bitwiseAND(F.lit(_ROW)))
    sizes = rows.groupBy("__part").count()
    before = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__row")).drop("__id", "__part", "__row", "__before")
