"""Text and date functions of the social queries and the dataset loaders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site(url: Column) -> Column:
    """Host of a URL: the scheme taken away, up to the first slash."""
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.substring_index(bare, "/", 1)


def like_any(column: Column, term: str) -> Column:
    """Substring match without regard to case; ``%`` and ``_`` in the term keep their meaning as wildcards."""
    return column.ilike(f"%{term}%")


def tag_list(text: Column, longest: int = 20) -> Column:
    """Tags of a comma-separated text: empty ones and those longer than ``longest`` go; blanks within stay."""
    return F.filter(F.split(text, ","), lambda t: (t != "") & (F.length(t) <= longest))


def name_list(names: Column) -> Column:
    """``a, b and c`` of an array of names."""
    n = F.size(names)
    return F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).otherwise(
        F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.get(names, n - 1))
    )


def percent(x: Column) -> Column:
    """A share as whole percent, halves to even."""
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))


def time_features(ts: Column) -> dict[str, Column]:
    """Second, minute, hour, weekday (Monday 0), day and month, each scaled to about -0.5 to 0.5."""
    return {
        "second_f": F.second(ts) / F.lit(59.0) - 0.5,
        "minute_f": F.minute(ts) / F.lit(59.0) - 0.5,
        "hour_f": F.hour(ts) / F.lit(23.0) - 0.5,
        "weekday_f": F.weekday(ts) / F.lit(6.0) - 0.5,
        "day_f": F.dayofmonth(ts) / F.lit(30.0) - 0.5,
        "month_f": F.month(ts) / F.lit(365.0) - 0.5,
    }


def natural_key(name: Column) -> Column:
    """A sort key in which numbers within names compare as numbers."""
    padded = F.regexp_replace(name, r"(\d+)", "0000000000$1")
    return F.regexp_replace(padded, r"0*(\d{10})(?!\d)", "$1")
