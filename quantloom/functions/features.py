"""What a feature is made of, and how many features become one plan.

A feature has columns by level (window expressions can't nest, so level 1 may look back on what level 0 made), folds
(recursions over a whole series) and outputs over all of these.  ``apply`` cuts the series into segments, runs all folds
as one scan over these, gives each segment the rows before it that windows look back on, and merges the levels of all
features into one projection each, over windows by series and segment.  So hundreds of features shuffle bars once for
the segments and once for the windows, and no task holds a whole series.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.segments import SEGMENT, segmented
from .scans import HALO, PLACE, Scan, scanned


@dataclass
class Fold:
    """names: the columns that run(scan) returns, in order."""

    names: list[str]
    run: Callable[[Scan], list[np.ndarray]]


@dataclass
class Feature:
    """look: how many rows back a window of any level looks at most."""

    outputs: dict[str, Column]
    levels: list[dict[str, Column]] = field(default_factory=list)
    folds: list[Fold] = field(default_factory=list)
    look: int = 0

    @property
    def back(self) -> int:
        """Rows before a row that its outputs may depend on through windows."""
        return self.look * (len(self.levels) + 1)


REGISTRY: dict[str, Callable[..., Feature]] = {}
_looks: list[int] = []


def feature(make: Callable[..., Feature]) -> Callable[..., Feature]:
    """Registers make; what it returns knows how far its windows look back."""

    @functools.wraps(make)
    def made(*args, **params) -> Feature:
        before, _looks[:] = list(_looks), []
        out = make(*args, **params)
        look = max([0, *_looks])
        _looks[:] = [*before, look]
        return replace(out, look=look)

    REGISTRY[make.__name__] = made
    return made


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def series():
    return Window.partitionBy("symbol", SEGMENT).orderBy(PLACE)


def rows_back(first: int, last: int = 0):
    """The rows from first to last before this one."""
    _looks.append(first)
    return series().rowsBetween(-first, -last)


def frame(n: int):
    return rows_back(n - 1)


def full(n: int, value: Column) -> Column:
    """value once n rows of the series exist."""
    return F.when(F.col(PLACE) >= n, value)


def whole(name: str, n: int, value: Column) -> Column:
    """value where the last n rows of a column are all there."""
    return F.when(F.count(col(name)).over(frame(n)) == n, value)


def lag_of(value: Column, n: int = 1) -> Column:
    _looks.append(n)
    return F.lag(value, n).over(series())


def lag(name: str, n: int = 1) -> Column:
    return lag_of(col(name), n)


def mean(name: str, n: int) -> Column:
    return F.avg(col(name)).over(frame(n))


def total(name: str, n: int) -> Column:
    return F.sum(col(name)).over(frame(n))


def highest(name: str, n: int) -> Column:
    return F.max(col(name)).over(frame(n))


def lowest(name: str, n: int) -> Column:
    return F.min(col(name)).over(frame(n))


def apply(bars: DataFrame, features: list[Feature], segments: int | None = None) -> DataFrame:
    """bars with the outputs of all features; names that features share are made once.

    segments: into how many segments bars are cut, by default as many as they fill."""
    folds = list({tuple(f.names): f for x in features for f in x.folds}.values())
    names = [n for f in folds for n in f.names]
    given = bars.columns
    back = max([0, *(x.back for x in features)])
    if folds or back or any(x.levels for x in features):
        cut = segmented(bars, ["symbol"], ["ts"], segments)
        bars = scanned(cut, names, lambda s: [a for f in folds for a in f.run(s)], back)
    depth = max((len(x.levels) for x in features), default=0)
    for level in range(depth):
        new = {n: c for x in features if len(x.levels) > level for n, c in x.levels[level].items() if n not in bars.columns}
        bars = bars.select("*", *[c.alias(n) for n, c in new.items()])
    bars = bars.select("*", *[c.alias(n) for n, c in {n: c for x in features for n, c in x.outputs.items()}.items() if n not in bars.columns])
    return bars.where(~F.col(HALO)).drop(HALO, PLACE, SEGMENT) if HALO in bars.columns and HALO not in given else bars
