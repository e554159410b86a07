"""Column expressions of the edit log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that an affiliation holds and the colours of edits, first match first, and the colour of all others.
COLOURS = (("\\Aauto\\z", "grey"), ("Cambridge", "#A3E1CD"), ("Wei|Dacks", "#A41034"))
OTHER_COLOUR = "black"


def affiliation_colour(affiliation: Column, rules=COLOURS, other: str = OTHER_COLOUR) -> Column:
    """The colour of the first rule (pattern, colour) that the affiliation meets; a null one meets none."""
    return F.coalesce(*[F.when(affiliation.rlike(pattern), colour) for pattern, colour in rules], F.lit(other))


def centroid(text: Column) -> Column:
    """struct<x, y, z> of the mean point of "x1,..,xn,y1,..,yn,z1,..,zn". Null, "NA" and texts without three equal parts give null members."""
    numbers = F.transform(F.split(F.nullif(F.trim(text), F.lit("NA")), ","), lambda v: F.trim(v).try_cast("double"))
    n = F.floor(F.size(numbers) / 3).cast("int")
    ok = (F.size(numbers) > 0) & (F.size(numbers) % 3 == 0)

    def mean(k: int) -> Column:
        part = F.slice(numbers, n * k + 1, n)
        return F.when(ok, F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / n)

    return F.struct(mean(0).alias("x"), mean(1).alias("y"), mean(2).alias("z"))


def frame_of(ts: Column, first: Column, last: Column, frames: int) -> Column:
    """Number (from 1) of the equal-width bin [b, b + w) that holds ts; the last bin is closed. All in whole microseconds."""
    t, a, b = (F.unix_micros(c.cast("timestamp")) for c in (ts, first, last))
    width = b - a
    return F.when(width == 0, F.lit(1)).otherwise(F.least(F.lit(frames), F.floor((t - a) * frames / width) + 1)).cast("int")
