"""Recursions over long series that are cut into segments: a parallel scan.

A program computes arrays from a series' bars, with numpy and with the operations of ``Scan`` that remember something from
row to row.  Each operation has a state.  At the start of a series the state is empty; where a series goes on in another
segment, its state there comes out of passes over all segments:

* an operation whose state at a segment's start isn't known sums the segment up instead - an affine map, a sum, the last
  rows, or, for what is no such map, the end that follows from a start guessed by a warm-up - and gives ``PENDING``,
* what is computed from something pending is pending too, so operations on it wait for the next pass,
* between passes the driver carries states from segment to segment through the summaries, a few numbers for each.

When all states are known, one last pass gives the values; a segment of any length streams through its task.  A guess
that turns out wrong costs another pass over that segment, from the right state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.segments import SEGMENT, undealt

BARS = ("open", "high", "low", "close", "volume")
#: Rows that a guess of a state starts from.
WARM_UP = 1024


class Pending(np.lib.mixins.NDArrayOperatorsMixin):
    """Not known in this pass, and so is all that is computed from it."""

    def __array_ufunc__(self, *_, **__):
        return self

    def __array_function__(self, *_):
        return self


PENDING = Pending()


# Operations: advance(state, x, at) gives values and the next state; absorb(summary, x, at) sums up, from None; carry(state, summary)
# gives the state behind a segment, or None if the summary doesn't tell.  at: the first row's place in the series.


@dataclass(frozen=True)
class Recursion:
    """v = keep * v + take * x, seeded by the mean or sum of n values: the first n ones, or those up to the place at."""

    keep: float
    take: float
    n: int
    mean: bool = True
    at: int | None = None

    def start(self) -> tuple:
        return -1, 0.0, np.nan  # the first value's place, the seed so far, v

    def advance(self, state: tuple, x: np.ndarray, at: int) -> tuple[np.ndarray, tuple]:
        first, total, v = state
        out = np.full(len(x), np.nan)
        if first < 0:
            values = np.flatnonzero(~np.isnan(x)) if self.at is None else np.arange(max(0, self.at - self.n + 1 - at), len(x))
            if not len(values):
                return out, state
            first = at + int(values[0])
        seeded = first + self.n - 1  # its place
        a, b = max(0, first - at), min(len(x), seeded + 1 - at)
        if a < b:
            total += float(x[a:b].sum())
        if at <= seeded < at + len(x):
            v = out[seeded - at] = total / self.n if self.mean else total
        elif not self.n and at <= first < at + len(x):
            v = 0.0
        begin = max(0, seeded + 1 - at)
        keep, take = self.keep, self.take
        for i, new in enumerate(x[begin:].tolist(), begin):
            v = keep * v + take * new
            out[i] = v
        return out, (first, total, v)

    def absorb(self, summary: list | None, x: np.ndarray, at: int) -> list:
        """[rows, offset of the affine map, first n values, rows and offset behind these, state if nothing came before]."""
        m, offset, head, m_tail, tail, fresh = summary or [0, 0.0, np.zeros(0), 0, 0.0, self.start()]
        more = x[: max(0, self.n - len(head))]
        rest = x[len(more) :]
        fold = lambda v, part: v * self.keep ** len(part) + self.take * float(part @ (self.keep ** np.arange(len(part) - 1, -1, -1.0))) if len(part) else v
        return [m + len(x), fold(offset, x), np.append(head, more), m_tail + len(rest), fold(tail, rest), self.advance(fresh, x, at)[1]]

    def carry(self, state: tuple, summary: list, at: int) -> tuple:
        m, offset, head, m_tail, tail, fresh = summary
        first, total, v = state
        if first < 0:
            return fresh
        if first + self.n - 1 < at:
            return first, total, self.keep**m * v + offset
        _, (first, total, v) = self.advance(state, head, at)
        return first, total, self.keep**m_tail * v + tail if m_tail else v


@dataclass(frozen=True)
class Total:
    """The sum so far; rows without a value count nothing, or, strictly, leave no sum behind them."""

    strict: bool = False

    def start(self) -> tuple:
        return False, 0.0  # any value so far, their sum

    def advance(self, state: tuple, x: np.ndarray, at: int) -> tuple[np.ndarray, tuple]:
        some, total = state
        have = ~np.isnan(x)
        out = total + np.cumsum(x if self.strict else np.where(have, x, 0.0))
        seen = some | (np.cumsum(have) > 0)
        end = (bool(seen[-1]), float(out[-1])) if len(x) else state
        return np.where(seen, out, np.nan), end

    def absorb(self, summary: tuple | None, x: np.ndarray, at: int) -> tuple:
        return self.advance(summary or self.start(), x, at)[1]

    def carry(self, state: tuple, summary: tuple, at: int) -> tuple:
        return state[0] or summary[0], state[1] + summary[1]


@dataclass(frozen=True)
class Last:
    """The n rows before a segment, or what there is of them, followed by its own."""

    n: int

    def start(self) -> np.ndarray:
        return np.zeros(0)

    def advance(self, state: np.ndarray, x: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        both = np.append(state, x)
        return both, both[max(0, len(both) - self.n) :]

    def absorb(self, summary: np.ndarray | None, x: np.ndarray, at: int) -> np.ndarray:
        return self.advance(self.start() if summary is None else summary, x, at)[1]

    def carry(self, state: np.ndarray, summary: np.ndarray, at: int) -> np.ndarray:
        return self.advance(state, summary, at)[1]


def same(a, b) -> bool:
    """Equal states, to the last bit."""
    if isinstance(a, tuple | list):
        return len(a) == len(b) and all(map(same, a, b))
    return np.array_equal(a, b, equal_nan=True) if isinstance(a, np.ndarray) else a == b or (a != a and b != b)


UNKNOWN = object()


@dataclass
class Scan:
    """One series within one segment, chunk by chunk.  states: by operation, in the order in which the program uses them."""

    fresh: bool
    states: dict[int, object]
    at: int = 0
    sums: dict[int, object] = field(default_factory=dict)
    guesses: dict[int, tuple] = field(default_factory=dict)
    bars: dict[str, np.ndarray] = field(default_factory=dict)
    _turn: int = 0

    def chunk(self, bars: dict[str, np.ndarray], program: Callable[[Scan], list]) -> list:
        """The program's arrays for the next rows of the series."""
        self.bars, self._turn = bars, 0
        out = program(self)
        self.at += len(bars["close"])
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        return self.bars[name]

    @property
    def places(self) -> np.ndarray:
        """Numbers of the rows in their series, from 0."""
        return self.at + np.arange(len(self.bars["close"]))

    def _state(self, make: Callable) -> tuple[int, object]:
        k, self._turn = self._turn, self._turn + 1
        if self.fresh and k not in self.states:
            self.states[k] = make()
        return k, self.states.get(k, UNKNOWN)

    def _run(self, op, x):
        k, state = self._state(op.start)
        if x is PENDING:
            return PENDING
        if state is UNKNOWN:
            self.sums[k] = op.absorb(self.sums.get(k), x, self.at)
            return PENDING
        out, self.states[k] = op.advance(state, x, self.at)
        return out

    def recursion(self, x, keep: float, take: float, n: int, mean: bool = True, at: int | None = None):
        return self._run(Recursion(keep, take, n, mean, at), x)

    def total(self, x, strict: bool = False):
        return self._run(Total(strict), x)

    def before(self, x, n: int):
        """x with the n rows before it, filled up by nothing (NaN) at the start of a series."""
        both = self._run(Last(n), x)
        return both if both is PENDING else np.append(np.full(n + len(x) - len(both), np.nan), both)

    def lag(self, x, n: int = 1):
        both = self.before(x, n)
        return both if both is PENDING else both[: len(x)]

    def rolling(self, x, n: int, what: Callable):
        """what of the last n rows; nothing while there are fewer, or one of them has no value."""
        both = self.before(x, n - 1)
        if both is PENDING or len(both) < n:
            return both if both is PENDING else both[:0]
        return what(np.lib.stride_tricks.sliding_window_view(both, n), axis=1)

    def machine(self, step: Callable, start: Callable, *columns: np.ndarray, agree: Callable = same):
        """step(state, columns, at) for a state that no summary carries: guessed by a warm-up where it isn't known.

        agree: whether two states can't lead to different rows."""
        warm = [self._run(Last(WARM_UP), x) for x in columns]
        k, state = self._state(start)
        if state is not UNKNOWN:
            out, self.states[k] = step(state, columns, self.at)
            return out
        if any(w is PENDING for w in warm):
            return PENDING
        if k not in self.guesses:
            earlier = [w[: len(w) - len(x)] for w, x in zip(warm, columns, strict=True)]
            _, guess = step(start(), earlier, self.at - len(earlier[0]))
            self.guesses[k] = (guess, guess)
        guess, now = self.guesses[k]
        self.guesses[k] = (guess, step(now, columns, self.at)[1])
        return PENDING

    def report(self) -> dict:
        return {"states": dict(self.states), "sums": self.sums, "guesses": self.guesses}


def alone(program: Callable[[Scan], list], **bars: np.ndarray) -> list:
    """The program over one whole series."""
    n = len(next(iter(bars.values())))
    return Scan(True, {}).chunk({c: np.full(n, np.nan) for c in BARS} | bars, program)


# Segments


@dataclass(frozen=True)
class Cut:
    """Where a segment goes on with a series: its first row's place, the series, and the last segment before with rows of it."""

    at: int
    series: object
    before: int


def cuts(rows: DataFrame) -> dict[int, Cut]:
    """By segment; at most one for each."""
    if undealt(rows):
        return {}
    counted = rows.groupBy("symbol", SEGMENT).agg(F.count("*").alias("n"))
    order = Window.partitionBy("symbol").orderBy(SEGMENT)
    found = counted.select("symbol", SEGMENT, F.lag(SEGMENT).over(order).alias("before"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("at")).where("before IS NOT NULL")
    return {r[SEGMENT]: Cut(r["at"], r["symbol"], r["before"]) for r in found.collect()}


def _values(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    get = lambda c: pc.fill_null(batch.column(c).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    return {c: get(c) for c in BARS}


def _runs(batch: pa.RecordBatch) -> list[tuple[object, int, int]]:
    """(series, first row, end) of a batch in order."""
    number = batch.column("symbol").dictionary_encode()
    codes = pc.fill_null(number.indices, -1).to_numpy(zero_copy_only=False)
    edge = np.flatnonzero(np.diff(codes, prepend=-2)).tolist() + [len(codes)]
    names = number.dictionary
    return [(names[codes[a]].as_py() if codes[a] >= 0 else None, a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def states(rows: DataFrame, found: dict[int, Cut], program: Callable[[Scan], list]) -> tuple[dict[int, dict[int, object]], int]:
    """The states of the program's operations where segments go on with a series, and how many guesses were wrong.

    rows: what segmented() made of bars (symbol, ts, prices).  Reports are a few numbers for each operation and segment."""
    known: dict[int, dict[int, object]] = {q: {} for q in found}
    after = {c.before: q for q, c in found.items()}
    ends: dict[int, dict[int, object]] = {p: {} for p in after}
    wrong, listed = set(), operations(program)
    n = len(listed)
    while any(len(s) < n for s in known.values()):
        have = {p: (found[q].series, known.get(p) if p in found and found[p].series == found[q].series else None, found[p].at if p in found else 0) for p, q in after.items() if len(ends[p]) < n}
        shared = rows.sparkSession.sparkContext.broadcast(have)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scan = None
            for batch in batches:
                p = batch.column(SEGMENT)[0].as_py() if batch.num_rows else None
                if p not in shared.value:
                    continue
                series, before, at = shared.value[p]
                for name, a, b in _runs(batch):
                    if name == series:
                        if scan is None:
                            scan = Scan(True, {}) if before is None else Scan(False, dict(before), at)
                        scan.chunk(_values(batch.slice(a, b - a)), program)
            if scan is not None:
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pickle.dumps(scan.report())], pa.binary())], [SEGMENT, "report"])

        reports = {r[SEGMENT]: pickle.loads(r["report"]) for r in rows.select("symbol", *BARS, SEGMENT).mapInArrow(run, f"{SEGMENT} int, report binary").collect()}
        for q in sorted(found):
            p = found[q].before
            for k in range(n):
                if k in known[q]:
                    continue
                if p in reports and k in reports[p]["states"]:
                    ends[p][k] = reports[p]["states"][k]
                elif p in reports and k in known.get(p, {}):
                    if k in reports[p]["sums"]:
                        ends[p][k] = listed[k].carry(known[p][k], reports[p]["sums"][k], found[p].at)
                    elif k in reports[p]["guesses"]:
                        guess, end = reports[p]["guesses"][k]
                        if listed[k](guess, known[p][k]):
                            ends[p][k] = end
                        else:
                            wrong.add(p)
                if k in ends[p]:
                    known[q][k] = ends[p][k]
    return known, len(wrong)


def operations(program: Callable[[Scan], list]) -> list:
    """The operations that a program uses, in order; of a machine, when its states agree."""
    met = []

    class Listing(Scan):
        def _run(self, op, x):
            met.append(op)
            return super()._run(op, x)

        def machine(self, step, start, *columns, agree=same):
            out = super().machine(step, start, *columns)
            met.append(agree)
            return out

    Listing(True, {}).chunk({c: np.zeros(0) for c in BARS}, program)
    return met


HALO = "_halo"
PLACE = "_place"


def scanned(rows: DataFrame, names: list[str], program: Callable[[Scan], list], back: int) -> DataFrame:
    """rows, which segmented() made, with the program's columns, their place in the series from 1 on, and a halo.

    The halo of a segment: copies, marked so, of the back rows before it of the series that it goes on with."""
    found = cuts(rows)
    known, _ = states(rows, found, program) if names else ({}, 0)
    wanted: dict[int, list[tuple[int, object, int]]] = {}
    for q, cut in found.items() if back else ():
        p, least = cut.before, cut.at - back
        while True:
            wanted.setdefault(p, []).append((q, cut.series, least))
            if p not in found or found[p].series != cut.series or found[p].at <= least:
                break
            p = found[p].before
    shared = rows.sparkSession.sparkContext.broadcast((found, known, wanted))
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known, wanted = shared.value
        scan, at_hand, p = None, UNKNOWN, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if p is None:
                p = batch.column(SEGMENT)[0].as_py()
            made, places = [], []
            for name, a, b in _runs(batch):
                if scan is None or name != at_hand:
                    goes_on = scan is None and p in found and found[p].series == name
                    scan = Scan(False, dict(known.get(p, {})), found[p].at) if goes_on else Scan(True, {})
                    at_hand = name
                places.append(scan.at + 1 + np.arange(b - a))
                made.append(scan.chunk(_values(batch.slice(a, b - a)) if names else {"close": np.zeros(b - a)}, program))
            place = np.concatenate(places)
            more = [pa.array(np.concatenate(x), pa.float64(), from_pandas=True) for x in zip(*made, strict=True)]
            own = pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array(place, pa.int64()), pa.array(np.zeros(batch.num_rows, bool))], [*columns, *names, PLACE, HALO])
            yield own
            for q, series, least in wanted.get(p, ()):
                of_series = own.column("symbol").is_null() if series is None else pc.fill_null(pc.equal(own.column("symbol"), series), False)
                copy = own.filter(pc.and_(of_series, pa.array(place > least)))
                if copy.num_rows:
                    n = copy.num_rows
                    parts = [pa.array(np.full(n, q), pa.int32()) if c == SEGMENT else pa.array(np.ones(n, bool)) if c == HALO else copy.column(c) for c in own.schema.names]
                    yield pa.RecordBatch.from_arrays(parts, own.schema.names)

    more = [*((n, T.DoubleType()) for n in names), (PLACE, T.LongType()), (HALO, T.BooleanType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in more)]))
