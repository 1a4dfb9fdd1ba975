"""Centred moving averages and Savitzky-Golay smoothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.ranges import in_range
from ..plans.series import RN, SeriesFrame


def interpolated(s: SeriesFrame, c: str, to: str) -> SeriesFrame:
    """Missing values on the line between their neighbours, by position; leading ones stay, trailing ones take the
    last value."""
    s = s.positions()
    pair = F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("v"), F.col(RN).alias("n")))
    s = s.previous(__p=(pair, True)).following(__f=(pair, True))
    p, f = F.col("__p"), F.col("__f")
    line = p["v"] + (f["v"] - p["v"]) * (F.col(RN) - p["n"]) / (f["n"] - p["n"])
    value = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(p.isNotNull() & f.isNotNull(), line).otherwise(p["v"])
    return s.add(**{to: value}).drop("__p", "__f")


#: Rows up to which each frame is summed anew.
SLIDING = 32


def moving_average(s: SeriesFrame, c: str, window: int, to: str | None = None, arange=None, interpolate: bool = True) -> SeriesFrame:
    """The mean of `window` rows around each row of the whole series; null where the frame isn't full. Missing values
    are interpolated first, or else leave frames unfilled. With arange only its rows come out, at least a window. Long
    frames are put together from running sums of their halves, so that they cost no more than short ones."""
    to = to or c
    s = interpolated(s, c, "__v") if interpolate else s.add(__v=F.col(c).cast("double"))
    before, after = window // 2, (window - 1) // 2
    if window <= SLIDING:
        full = lambda frame: F.when(F.count("__v").over(frame) == window, F.avg("__v").over(frame))
        s = s.framed(before, after, **{to: full})
    else:
        s = s.frame_moments("__m", F.col("__v"), before, after)
        s = s.add(**{to: F.when(F.col("__m.n") == window, F.col("__m.m")[0] / window)}).drop("__m")
    s = s.drop("__v").done()
    return s if arange is None else s.where(in_range(s, arange))


def coefficients(window: int, polyorder: int) -> np.ndarray:
    """What the moments of a window's values (of places from -1 to 1) count for in its least-squares polynomial's
    coefficients."""
    if window % 2 == 0 or polyorder >= window:
        raise ValueError("the window is odd and longer than the polynomial's order")
    half = window // 2
    v = np.vander(np.arange(-half, half + 1) / max(half, 1), polyorder + 1, increasing=True)
    return np.linalg.inv(v.T @ v)


def savgol(s: SeriesFrame, c: str, window: int = 55, polyorder: int = 2, to: str | None = None) -> SeriesFrame:
    """Savitzky-Golay smoothing. The first and last half windows take the polynomial of the first and last window.
    A missing value in a window gives none; so does a series shorter than the window.

    A window's polynomial depends on the moments of its values alone, which frame_moments() has for each row at a cost
    that doesn't grow with the window. Rows near the ends need those of one more row, the centre of the end's window."""
    half, inverse, to = window // 2, coefficients(window, polyorder), to or c
    s = s.frame_moments("__m", F.col(c), half, half, polyorder)
    s = s.add(__m=F.when(F.col("__m.n") == window, F.col("__m.m")))
    rn, key = F.col(RN), s.key
    if s.chunk_rows:
        s = s.cut()
        n = s.df.groupBy(F.col(key).alias("__k")).agg(F.max(RN).alias("__n"))
        ends = s.df.join(n, F.col(key).eqNullSafe(F.col("__k"))).where((rn == half + 1) | (rn == F.col("__n") - half))
        ends = ends.groupBy("__k", "__n").agg(F.max_by("__m", -rn).alias("__head"), F.max_by("__m", rn).alias("__tail"))
        df = s.df.join(ends, F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")
    else:
        whole = Window.partitionBy(key)
        df = s.df.withColumn("__n", F.count("*").over(whole))
        df = df.withColumns({"__head": F.max(F.when(rn == half + 1, F.col("__m"))).over(whole), "__tail": F.max(F.when(rn == F.col("__n") - half, F.col("__m"))).over(whole)})

    def polynomial(moments: Column, x: Column) -> Column:
        terms = [sum((moments[j] * float(inverse[k][j]) for j in range(polyorder + 1)), F.lit(0.0)) for k in range(polyorder + 1)]
        out = terms[-1]
        for t in reversed(terms[:-1]):
            out = out * x + t
        return out

    place = lambda centre: (rn - centre) / float(max(half, 1))
    inner = polynomial(F.col("__m"), F.lit(0.0))
    head = F.when(rn <= half, polynomial(F.col("__head"), place(F.lit(half + 1))))
    tail = F.when(rn > F.col("__n") - half, polynomial(F.col("__tail"), place(F.col("__n") - half)))
    smooth = F.when(F.col("__n") >= window, F.when(rn <= half, head).when(rn > F.col("__n") - half, tail).otherwise(inner))
    return s.with_df(df.withColumn(to, smooth).drop("__m", "__n", "__head", "__tail")).done()
