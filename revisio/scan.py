"""Running counts and sums along keys of any size: a segmented prefix scan.

Rows are dealt out by range of (key, order), so a hot key lies on many neighbouring partitions.
Each partition numbers its own rows of a key; what the partitions before it hold of the same key
is added as an offset. Only the first key of a partition has one, so there are no more offsets
than partitions, and they are broadcast.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

from revisio.shared import written


class Segments:
    """Rows dealt out by range of (key, order), with what runs along a key.

    `order` are sort expressions that leave no ties but between rows that may change places. Null keys are one key."""

    def __init__(self, df, key, order):
        self.key, self.order = list(key), [*order, "__tie"]
        self.rows = written(df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*self.key, *self.order).withColumn("__part", F.spark_partition_id()))

    def _window(self):
        return Window.partitionBy(*self.key, "__part").orderBy(*self.order)

    def _met(self, rows, here, columns):
        """rows with columns of each key's partitions."""
        here = here.select(F.struct(*self.key).alias("__key"), F.col("__part").alias("__at"), *columns)
        return rows.join(F.broadcast(here), F.struct(*self.key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at")), "left")

    def total(self, rows, **totals):
        """rows with running totals {name: column} up to and with the row, zero for no values."""
        local = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        here = rows.groupBy(*self.key, "__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in totals.items()])
        before = Window.partitionBy(*self.key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = here.select(*self.key, "__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in totals], (F.row_number().over(Window.partitionBy(*self.key).orderBy("__part")) > 1).alias("__later")).where("__later")
        out = self._met(rows.withColumns({n: F.sum(c).over(local) for n, c in totals.items()}), offsets, [f"__{n}" for n in totals])
        out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"__{n}"), F.lit(0)) for n in totals})
        return out.drop("__key", "__at", *[f"__{n}" for n in totals])

    def previous(self, rows, **columns):
        """rows with values of the row before, null for a key's first."""
        last = rows.groupBy(*self.key, "__part").agg(*[F.max_by(F.struct(c), F.struct(*self._keys())).alias(f"__{n}") for n, c in columns.items()])
        by = Window.partitionBy(*self.key).orderBy("__part")
        offsets = last.select(*self.key, "__part", *[F.lag(f"__{n}").over(by).alias(f"__{n}") for n in columns], (F.row_number().over(by) > 1).alias("__later")).where("__later")
        out = self._met(rows.withColumns({"__nth": F.row_number().over(self._window()), **{n: F.lag(c).over(self._window()) for n, c in columns.items()}}), offsets, [f"__{n}" for n in columns])
        for n, c in columns.items():
            out = out.withColumn(n, F.when(F.col("__nth") > 1, F.col(n)).otherwise(F.col(f"__{n}").getItem(c)))
        return out.drop("__key", "__at", "__nth", *[f"__{n}" for n in columns])

    def _keys(self):
        if not all(isinstance(o, str) for o in self.order):
            raise ValueError("previous() takes an order of plain columns, ascending, nulls first")
        return self.order


def numbered(df, key, order, nth="nth", **totals):
    """df with `nth`, its rows' numbers from 1 within `key` by `order`, and running totals {name: column}."""
    s = Segments(df, key, order)
    return s.total(s.rows, **{nth: F.lit(1).cast("long"), **totals}).drop("__tie", "__part")
