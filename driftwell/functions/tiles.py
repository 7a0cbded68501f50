"""Operations along series of any length, each dealt to tiles (ranges of its order) that are worked on in parallel.

Frames of bounded rows see copies of the rows beside a tile (its halo).  Unbounded ones are scans: each tile is summed up
by a map that composes (``x -> a * x + b`` for exponential means, a count of changes for runs), the maps are scanned over
the tiles of a series, one row for each, and carried back into them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .order import RANGE_ROWS, dealt, placed
from .series import ewma_memory


@dataclass
class Tiles:
    """``rows`` with ``__range`` (the tile) and ``__own`` (false for a copy of another tile's row)."""

    rows: DataFrame
    by: list[str]
    order: str
    #: Whether one tile holds all rows, so that nothing is carried.
    single: bool = False

    @property
    def window(self) -> WindowSpec:
        """Rows of a series within a tile and its halo, in order."""
        return Window.partitionBy(*self.by, "__range").orderBy(self.order)

    def own(self, df: DataFrame) -> DataFrame:
        return df.where("__own").drop("__own", "__range")


def _halo(cells: DataFrame, by: list[str], before: int, after: int) -> DataFrame:
    """``by, __cell, __others``: the tiles of a series, besides their own, that need the rows of a cell.

    ``cells`` counts rows by series and cell.  The rows between a cell and the start of a later tile are fewer than
    ``before`` where the tile starts within ``before`` rows of the next cell's start; likewise behind.
    """
    order = Window.partitionBy(*by).orderBy("__cell")
    upto = cells.withColumn("__stop", F.sum("n").over(order)).withColumn("__start", F.col("__stop") - F.col("n"))
    upto = upto.withColumns({
        "__opens": F.when(F.coalesce(F.lag("__range").over(order) != F.col("__range"), F.lit(False)), F.col("__range")),
        "__closes": F.when(F.coalesce(F.lead("__range").over(order) != F.col("__range"), F.lit(False)), F.col("__range")),
    })
    none = F.array().cast("array<int>")
    later = earlier = none
    if before:
        near = Window.partitionBy(*by).orderBy("__start").rangeBetween(0, before - 1)
        upto = upto.withColumn("__later", F.collect_list("__opens").over(near))
        later = F.coalesce(F.lead("__later").over(order), none)
    if after:
        near = Window.partitionBy(*by).orderBy("__stop").rangeBetween(-(after - 1), 0)
        upto = upto.withColumn("__earlier", F.collect_list("__closes").over(near))
        earlier = F.coalesce(F.lag("__earlier").over(order), none)
    others = F.array_distinct(F.concat(later, earlier))
    return upto.select(*by, "__cell", F.array_remove(others, F.col("__range")).alias("__others")).where(F.size("__others") > 0)


def tiled(df: DataFrame, by: list[str], order: str = "t", before: int = 0, after: int = 0, rows: int = RANGE_ROWS) -> Tiles:
    """Deals series to tiles of about ``rows`` rows, with at least ``before`` and ``after`` rows around each (fewer where
    the series ends).

    A tile is a range of (series, order), so short series share one and a long one has many.  Gaps and uneven steps of the
    order do not matter; rows of a series must differ in it, and series must not be null.
    """
    dealt_rows, single = placed(df, *map(F.col, by), F.col(order), rows=rows)
    dealt_rows = dealt_rows.drop("__key").withColumn("__own", F.lit(True))
    if single or not (before or after):
        return Tiles(dealt_rows.drop("__cell"), by, order, single)
    cells = dealt_rows.groupBy(*by, "__range", "__cell").agg(F.count("*").alias("n"))
    halo = _halo(cells, by, before, after)
    copies = dealt_rows.join(halo, [*by, "__cell"]).withColumn("__range", F.explode("__others")).withColumn("__own", F.lit(False))
    names = [*df.columns, "__range", "__own"]
    return Tiles(dealt_rows.select(*names).unionByName(copies.select(*names)), by, order)


def with_totals(df: DataFrame, by: list[str], **totals: Column) -> DataFrame:
    """Adds aggregates of each series to its rows: one row for each series is joined, no series is gathered."""
    sums = df.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(sums, by)


def islands(df: DataFrame, flag: Column, name: str, by: list[str], order: str = "t", gaps: bool = False, rows: int = RANGE_ROWS) -> DataFrame:
    """Adds a number that is the same for neighbouring rows of equal ``flag`` (null equals null) and grows along a series;
    with ``gaps`` rows are neighbours only where the order goes on by 1."""
    tiles = tiled(df.withColumn("__flag", flag), by, order, before=1, rows=rows)
    w = tiles.window
    same = F.lag("__flag").over(w).eqNullSafe(F.col("__flag")) & (F.row_number().over(w) > 1)
    if gaps:
        same = same & (F.lag(order).over(w) + 1 == F.col(order))
    marked = tiles.rows.withColumn("__turn", F.when(same, 0).otherwise(1)).where("__own").drop("__own", "__flag")
    # A tile's first own row is counted in its turns; without rows before it, it opens the series.
    if tiles.single:
        return marked.withColumn(name, F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).select(*df.columns, name)
    turns = marked.groupBy(*by, "__range").agg(F.sum("__turn").alias("__turns"))
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = turns.select(*by, "__range", F.coalesce(F.sum("__turns").over(ahead), F.lit(0)).alias("__carried"))
    here = F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("__here", here).join(dealt(carried, by), [*by, "__range"])
    return out.select(*df.columns, (F.col("__carried") + F.col("__here")).alias(name))


def last_known(df: DataFrame, columns: dict[str, Column], by: list[str], order: list[Column], rows: int = RANGE_ROWS) -> DataFrame:
    """Adds for each name the last value of a column that is not null, in the order of a series, up to the row itself.

    What is open at the end of a tile is carried over to the next ones, so a value may hold for any number of tiles.
    """
    dealt_rows, single = placed(df.withColumns({f"__c_{n}": c for n, c in columns.items()}), *map(F.col, by), *order, rows=rows)
    here = Window.partitionBy(*by, "__range").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    if single:
        return dealt_rows.withColumns({n: F.last(f"__c_{n}", True).over(here) for n in columns}).select(*df.columns, *columns)
    ends = dealt_rows.groupBy(*by, "__range").agg(*[F.max_by(f"__c_{n}", F.when(F.col(f"__c_{n}").isNotNull(), F.col("__key"))).alias(f"__p_{n}") for n in columns])
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "__range", *[F.last(f"__p_{n}", True).over(ahead).alias(f"__p_{n}") for n in columns])
    out = dealt_rows.withColumns({f"__c_{n}": F.last(f"__c_{n}", True).over(here) for n in columns}).join(dealt(carried, by), [*by, "__range"])
    return out.select(*df.columns, *[F.coalesce(f"__c_{n}", f"__p_{n}").alias(n) for n in columns])


def _doublings(n: int) -> list[int]:
    return [1 << i for i in range(max(0, math.ceil(math.log2(max(1, n)))))]


def ewma_forecasts(df: DataFrame, columns: dict[str, Column], alpha: float, by: list[str], order: str = "t", rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the exponentially weighted forecast of each row from those before it; the first row forecasts itself.

    A row takes a forecast p to ``(1 - alpha) * p + alpha * x``.  Such maps compose to others of their kind, so a tile
    builds those of 2, 4, 8, ... rows one from another until older rows no longer weigh anything in double precision, the
    maps of whole tiles are composed along the series in the same way, and each tile starts from what reaches it.
    """
    keep, names = 1.0 - alpha, list(columns)
    tiles = tiled(df.withColumns({f"__x_{c}": x.cast("double") for c, x in columns.items()}), by, order, rows=rows)
    w, out = tiles.window, tiles.rows.drop("__own")
    out = out.withColumns({"__k": F.row_number().over(w), **{f"__b_{c}": F.col(f"__x_{c}") * alpha for c in names}})
    for d in _doublings(ewma_memory(alpha)):
        out = out.withColumns({f"__b_{c}": F.col(f"__b_{c}") + F.coalesce(F.lag(f"__b_{c}", d).over(w), F.lit(0.0)) * keep**d for c in names})
    power = F.pow(F.lit(keep), F.col("__k") - 1)
    if tiles.single:
        start = {f"__p_{c}": F.first(f"__x_{c}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in names}
        out = out.withColumns({**start, **{f"__b_{c}": F.coalesce(F.lag(f"__b_{c}").over(w), F.lit(0.0)) for c in names}})
        return out.select(*df.columns, *[(power * F.col(f"__p_{c}") + F.col(f"__b_{c}")).alias(c) for c in names])
    ends = out.groupBy(*by, "__range").agg(
        F.count("*").alias("__n"), *[F.max_by(f"__b_{c}", order).alias(f"__b_{c}") for c in names], *[F.min_by(f"__x_{c}", order).alias(f"__f_{c}") for c in names]
    )
    along = Window.partitionBy(*by).orderBy("__range")
    ends = ends.withColumns({"__a": F.pow(F.lit(keep), F.col("__n")), **{f"__f_{c}": F.first(f"__f_{c}").over(along.rowsBetween(Window.unboundedPreceding, 0)) for c in names}})
    count = ends.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for d in _doublings(count):
        back = lambda c, otherwise: F.coalesce(F.lag(c, d).over(along), F.lit(otherwise))  # noqa: B023, E731
        ends = ends.withColumns({**{f"__b_{c}": F.col(f"__b_{c}") + F.col("__a") * back(f"__b_{c}", 0.0) for c in names}, "__a": F.col("__a") * back("__a", 1.0)})
    reach = {f"__p_{c}": F.coalesce(F.lag("__a").over(along) * F.col(f"__f_{c}") + F.lag(f"__b_{c}").over(along), F.col(f"__f_{c}")) for c in names}
    out = out.withColumns({f"__b_{c}": F.coalesce(F.lag(f"__b_{c}").over(w), F.lit(0.0)) for c in names})
    out = out.join(dealt(ends.select(*by, "__range", *[v.alias(k) for k, v in reach.items()]), by), [*by, "__range"])
    return out.select(*df.columns, *[(power * F.col(f"__p_{c}") + F.col(f"__b_{c}")).alias(c) for c in names])
