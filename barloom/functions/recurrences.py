"""Running recurrences over each symbol's bars, as scans over blocks.

Smoothed means are x -> d x + (1 - d) v.  A block of values is one matrix product; the carry from block to block is the same recurrence on the
blocks' ends, and so a scan again.  Over a slice of a symbol the whole recurrence is a map of the state that comes in, known from a few
numbers; these are folded along the slices, one row each, and every slice is then solved by itself.  So a
symbol is as many tasks as it has slices.  Without slices a task streams over its symbols, with one Arrow batch and one state in memory.

Only Supertrend, whose bands jump, walks its bars; over slices it starts from guesses, and is repeated where a guess came out wrong.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.state import cut
from .common import by_symbol
from .slices import Slicing, split, whole

_BLOCK = 64
WAITING, WARMING, BROKEN, RUNNING = range(4)


def smooth(v: np.ndarray, d: float, x: float) -> np.ndarray:
    """x = d x + (1 - d) v for each v in turn, from x."""
    n = len(v)
    if not n:
        return np.zeros(0)
    powers = d ** np.arange(_BLOCK + 1)
    lag = np.subtract.outer(np.arange(_BLOCK), np.arange(_BLOCK))
    kernel = np.where(lag >= 0, (1 - d) * powers[np.maximum(lag, 0)], 0.0)
    blocks = np.zeros((-(-n // _BLOCK), _BLOCK))
    blocks.ravel()[:n] = v
    own = blocks @ kernel.T
    ahead = np.full(len(own), x)
    if len(own) > 1:
        far = powers[_BLOCK]
        ahead[1:] = smooth(own[:-1, -1] / (1 - far), far, x)
    return (own + np.outer(ahead, powers[1:])).ravel()[:n]


class Mean(NamedTuple):
    """A smoothed mean over n values of a series that may have gaps.

    Exponential (`wilder` false): d = 1 - 2 / (n + 1), from the first value on, shown from the n-th.  Wilder: d = 1 - 1 / n, from the mean of the first n values, which stand
    together: a gap inside them ends it for good.  Later gaps keep the mean.  A state is (kind, values so far, sum or mean).
    """

    n: int
    wilder: bool = False

    @property
    def d(self) -> float:
        return 1 - 1 / self.n if self.wilder else 1 - 2 / (self.n + 1)

    start = (WAITING, 0.0, 0.0)

    def apply(self, v: np.ndarray, state: tuple) -> tuple[np.ndarray, tuple]:
        """The mean after each value (NaN where there is none) and the state after all."""
        out = np.full(len(v), np.nan)
        kind, seen, x = state
        known = ~np.isnan(v)
        at = 0  # where the running mean takes over
        if self.wilder and kind in (WAITING, WARMING):
            if kind == WAITING and known.any():
                at, kind = int(known.argmax()), WARMING
            if kind == WARMING:
                need = self.n - int(seen)
                lead = v[at : at + need]
                gap = np.isnan(lead)
                if gap.any():
                    kind = BROKEN
                else:
                    seen, x, at = seen + len(lead), x + float(lead.sum()), at + len(lead)
                    if len(lead) == need:
                        kind, x = RUNNING, x / self.n
                        out[at - 1] = x
        if kind in (WAITING, WARMING) and self.wilder or kind == BROKEN:
            return out, (kind, seen, x)
        rest = v[at:][known[at:]]
        if not self.wilder:
            if len(rest) and kind == WAITING:
                kind, x = RUNNING, float(rest[0])
            seen += len(rest)
        if kind == RUNNING:
            steps = np.concatenate([[x], smooth(rest, self.d, x)])
            after = steps[np.cumsum(known[at:])]
            if not self.wilder:
                after[np.cumsum(known[at:]) < self.n - (seen - len(rest))] = np.nan
            out[at:] = after
            x = float(steps[-1])
        return out, (kind, seen, x)

    def summary(self, v: np.ndarray) -> list[float]:
        """What fold() needs to take any state over these values: their number, how many are known, the running mean from 0, the last state from none, the first known value, and the values ahead of the first gap, n at most."""
        known = ~np.isnan(v)
        rest = v[known]
        from_none = self.apply(v, self.start)[1]
        lead = v[: self.n]
        lead = lead[: int(np.isnan(lead).argmax())] if np.isnan(lead).any() else lead
        mean = smooth(rest, self.d, 0.0)
        return [len(v), len(rest), mean[-1] if len(rest) else 0.0, *from_none, rest[0] if len(rest) else 0.0, *lead]

    def fold(self, state: tuple, summary: list[float]) -> tuple:
        n, m, mean, *none, first = summary[:7]
        lead, (kind, seen, x) = summary[7:], state
        if kind == WAITING:
            return tuple(none)
        if kind == WARMING:
            need = self.n - int(seen)
            if len(lead) < min(need, n):
                return BROKEN, seen, x
            taken = lead[:need]
            seen, x = seen + len(taken), x + sum(taken)
            if len(taken) < need:
                return WARMING, seen, x
            x /= self.n
            # the running mean without the values that went into the first one
            mean -= sum((1 - self.d) * self.d ** (m - 1 - i) * v for i, v in enumerate(taken))
            return RUNNING, seen, self.d ** (m - len(taken)) * x + mean
        if kind == RUNNING:
            return RUNNING, seen if self.wilder else seen + m, self.d**m * x + mean
        return state


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, a / b)


def supertrend(high, low, close, atr, mult: float, state: tuple) -> tuple[np.ndarray, tuple]:
    """Direction +1 or -1 of price against carried bands; starts as +1, and the first bar of all has none.  A state is (upper, lower, close, way, bars so far)."""
    upper, lower, before, way, seen = state
    mid = (high + low) / 2
    out = np.full(len(close), np.nan)
    for i, (up, down, c, a) in enumerate(zip((mid + mult * atr).tolist(), (mid - mult * atr).tolist(), close.tolist(), atr.tolist(), strict=True)):
        if a == a:
            if upper == upper:
                up = up if up < upper or before > upper else upper
                down = down if down > lower or before < lower else lower
            upper, lower = up, down
            if seen:
                way = (-1.0 if c < down else 1.0) if way == 1 else (1.0 if c > up else -1.0)
                out[i] = way
        before, seen = c, 1.0
    return out, (upper, lower, before, way, seen)


_FRESH = (np.nan, np.nan, np.nan, 1.0, 0.0)
#: Series of a bar, as columns over its symbol's bars; the first bar has its own range and no change
_INPUTS = ("high", "low", "close", "_tr", "_gain", "_loss", "_up", "_down")


def _inputs() -> dict[str, Column]:
    h, lo, c = (F.col(x) for x in ("high", "low", "close"))
    pc, ph, pl = (F.lag(x).over(by_symbol()) for x in (c, h, lo))
    rise, fall = h - ph, pl - lo
    return {
        "_tr": F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc)), "_gain": F.greatest(c - pc, F.lit(0.0) * (c - pc)), "_loss": F.greatest(pc - c, F.lit(0.0) * (c - pc)),
        "_up": F.when((rise > fall) & (rise > 0), rise).otherwise(0.0), "_down": F.when((fall > rise) & (fall > 0), fall).otherwise(0.0),
    }


class _Solver:
    """The values of wanted features over a stretch of one symbol's bars, given the states before it.

    Means of the bars' own series come first, then means of what is made of them, then Supertrend.
    """

    def __init__(self, wanted: dict[str, tuple[str, dict]]):
        self.wanted = wanted
        self.first: dict[tuple, Mean] = {}
        self.second: dict[tuple, Mean] = {}
        self.trends: dict[tuple, float] = {}
        for kind, p in wanted.values():
            if kind in ("ema", "dist_ema", "keltner_pos"):
                self.first["close", p["n"], False] = Mean(p["n"])
            if kind in ("atr", "atr_pct", "adx", "di_diff", "supertrend_dir", "keltner_pos"):
                n = 10 if kind == "keltner_pos" else p["n"]
                self.first["_tr", n, True] = Mean(n, True)
            if kind in ("adx", "di_diff"):
                self.first |= {(c, p["n"], True): Mean(p["n"], True) for c in ("_up", "_down")}
            if kind == "adx":
                self.second["dx", p["n"]] = Mean(p["n"], True)
            if kind == "rsi":
                self.first |= {(c, p["n"], True): Mean(p["n"], True) for c in ("_gain", "_loss")}
            if kind == "macd_hist":
                self.first |= {("close", p[c], False): Mean(p[c]) for c in ("fast", "slow")}
                self.second["line", p["fast"], p["slow"], p["signal"]] = Mean(p["signal"])
            if kind == "supertrend_dir":
                self.trends[p["n"], p["mult"]] = p["mult"]

    def ones(self, bars: dict[str, np.ndarray], states: list | None) -> tuple[dict, list]:
        found, after = {}, []
        for (key, mean), state in zip(self.first.items(), states or [Mean.start] * len(self.first), strict=True):
            found[key], end = mean.apply(bars[key[0]], tuple(state))
            after.append(end)
        return found, after

    def directional(self, x: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        """+DI - -DI, and the index of their distance."""
        plus, minus = (_over(100 * x[c, n, True], x["_tr", n, True]) for c in ("_up", "_down"))
        return plus - minus, _over(100 * np.abs(plus - minus), plus + minus)

    def seconds(self, x: dict) -> dict[tuple, np.ndarray]:
        """The series that the second means are of."""
        return {k: self.directional(x, k[1])[1] if k[0] == "dx" else x["close", k[1], False] - x["close", k[2], False] for k in self.second}

    def solve(self, bars: dict[str, np.ndarray], states: tuple | None = None) -> tuple[dict[str, np.ndarray], tuple]:
        """The wanted values, and the states after the stretch: of first means, of second means, of trends."""
        one, two, three = states or (None, None, None)
        x, one = self.ones(bars, one)
        made, ends = self.seconds(x), []
        for (key, mean), state in zip(self.second.items(), two or [Mean.start] * len(self.second), strict=True):
            x[key], end = mean.apply(made[key], tuple(state))
            ends.append(end)
        ways = []
        for (key, mult), state in zip(self.trends.items(), three or [_FRESH] * len(self.trends), strict=True):
            x["way", *key], end = supertrend(bars["high"], bars["low"], bars["close"], x["_tr", key[0], True], mult, tuple(state))
            ways.append(end)
        close = bars["close"]
        return {name: self.value(kind, p, x, made, close) for name, (kind, p) in self.wanted.items()}, (one, ends, ways)

    def value(self, kind: str, p: dict, x: dict, made: dict, close: np.ndarray) -> np.ndarray:
        n = p.get("n")
        if kind in ("ema", "dist_ema"):
            mean = x["close", n, False]
            return mean if kind == "ema" else _over(close - mean, mean)
        if kind in ("atr", "atr_pct"):
            return x["_tr", n, True] if kind == "atr" else _over(x["_tr", n, True], close)
        if kind == "rsi":
            up, down = x["_gain", n, True], x["_loss", n, True]
            return np.where(np.isnan(up), np.nan, np.where(down == 0, 100.0, 100.0 - 100.0 / (1.0 + _over(up, down))))
        if kind == "macd_hist":
            key = "line", p["fast"], p["slow"], p["signal"]
            return _over(made[key] - x[key], close)
        if kind == "keltner_pos":
            return _over(close - x["close", n, False], p["mult"] * x["_tr", 10, True])
        if kind == "di_diff":
            return self.directional(x, n)[0]
        return x["dx", n] if kind == "adx" else x["way", n, p["mult"]]


#: What add_recurrences knows, with the parameters of each
RECURRENCES = {
    "ema": ("n",), "dist_ema": ("n",), "rsi": ("n",), "macd_hist": ("fast", "slow", "signal"), "adx": ("n",), "di_diff": ("n",), "supertrend_dir": ("n", "mult"), "atr": ("n",), "atr_pct": ("n",), "keltner_pos": ("n", "mult"),
}


def _numbers(batch: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
    return {c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy(), float) for c in _INPUTS}


def _streamed(wanted: dict, own: list[str]):
    """Rows sorted by symbol and time, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, last, states = _Solver(wanted), None, None
        for batch in batches:
            bars, n = _numbers(batch), batch.num_rows
            names = batch.column("symbol").dictionary_encode() if n else None
            codes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False) if n else np.zeros(0, int)
            turns = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), n] if n else [0]
            made = {name: np.zeros(n) for name in wanted}
            for lo, hi in zip(turns, turns[1:]):
                symbol = batch.column("symbol")[lo].as_py()
                if last is None or symbol != last[0]:
                    last, states = (symbol,), None
                found, states = solver.solve({c: x[lo:hi] for c, x in bars.items()}, states)
                for name, x in found.items():
                    made[name][lo:hi] = x
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *[pa.array(x, pa.float64(), from_pandas=True) for x in made.values()]], [*own, *made])

    return run


_LISTS = "array<array<double>>"


def _lists(x: list) -> list[list[float]]:
    return [[float(v) for v in own] for own in x]


def _read(table: pa.Table, column: str) -> list | None:
    return table.column(column)[0].as_py() if table.num_rows else None


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table.column("ts")))


def _folded(means: list[Mean]):
    """The state that comes into each slice, from summaries of all slices of a symbol."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["pair", "summary"]).to_pylist(), key=lambda r: r["pair"]["slice"])
        states, out = [Mean.start] * len(means), []
        for r in rows:
            out.append(_lists(states))
            states = [m.fold(s, x) for m, s, x in zip(means, states, r["summary"], strict=True)]
        return pa.table({"symbol": pa.array([r["pair"] for r in rows], table.schema.field("pair").type), "states": pa.array(out, pa.list_(pa.list_(pa.float64())))})

    return run


def _scanned(rows: DataFrame, solver: _Solver, wanted: dict) -> DataFrame:
    """Solve slices: rows are their own rows alone, symbol being the pair."""
    pair = rows.schema["symbol"].dataType.simpleString()
    lead = rows.select("symbol", "ts", *_INPUTS)

    def fold(summaries: DataFrame, means: list[Mean]) -> DataFrame:
        asked = summaries.select(F.col("symbol.symbol").alias("name"), F.col("symbol").alias("pair"), "summary")
        return cut(asked.groupBy("name").applyInArrow(_folded(means), f"symbol {pair}, states {_LISTS}"))

    def told(table: pa.Table, summaries: list[list[float]]) -> pa.Table:
        return pa.table({"symbol": table.column("symbol")[:1], "summary": pa.array([_lists(summaries)], pa.list_(pa.list_(pa.float64())))})

    def of_first(table: pa.Table) -> pa.Table:
        bars = _numbers(_sorted(table))
        return told(table, [m.summary(bars[key[0]]) for key, m in solver.first.items()])

    def of_second(table: pa.Table, given: pa.Table) -> pa.Table:
        made = solver.seconds(solver.ones(_numbers(_sorted(table)), _read(given, "one"))[0])
        return told(table, [m.summary(made[key]) for key, m in solver.second.items()])

    summary = f"symbol {pair}, summary {_LISTS}"
    states = one = fold(lead.groupBy("symbol").applyInArrow(of_first, summary), list(solver.first.values())).withColumnRenamed("states", "one")
    if solver.second:
        two = fold(lead.groupBy("symbol").cogroup(one.groupBy("symbol")).applyInArrow(of_second, summary), list(solver.second.values()))
        states = states.join(two.withColumnRenamed("states", "two"), "symbol")
    else:
        states = states.withColumn("two", F.array().cast(_LISTS))
    states = states.withColumn("three", F.lit(None).cast(_LISTS))
    if solver.trends:
        states = _settled(lead, states, solver, pair)

    def final(table: pa.Table, given: pa.Table) -> pa.Table:
        table = _sorted(table)
        found, _ = solver.solve(_numbers(table), tuple(_read(given, c) for c in ("one", "two", "three")))
        own = [c for c in table.column_names if c not in _INPUTS or c in ("high", "low", "close")]
        return pa.table([*[table.column(c) for c in own], *[pa.array(found[c], pa.float64(), from_pandas=True) for c in wanted]], names=[*own, *wanted])

    kept = [f for f in rows.schema.fields if f.name not in _INPUTS or f.name in ("high", "low", "close")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{c}` double" for c in wanted])
    return rows.groupBy("symbol").cogroup(states.groupBy("symbol")).applyInArrow(final, schema)


#: Turns in which slices are guessed before the symbols that are left are walked
TURNS = 3


def _settled(lead: DataFrame, states: DataFrame, solver: _Solver, pair: str) -> DataFrame:
    """states with `three`, what each slice's trends come in with.

    All slices start from a guess at once; those whose guess is not what the slice before them ends with run again.  A band that is crossed
    forgets what it came with, so long slices are right in a turn or two; symbols with slices that still are not are walked from the start, each by one task.
    """

    def run(table: pa.Table, given: pa.Table) -> pa.Table:
        table = _sorted(table)
        _, (_, _, ends) = solver.solve(_numbers(table), tuple(_read(given, c) for c in ("one", "two", "three")))
        return pa.table({"symbol": table.column("symbol")[:1], "ends": pa.array([_lists(ends)], pa.list_(pa.list_(pa.float64())))})

    known = cut(states.withColumn("three", F.array(*[F.array(*map(F.lit, _FRESH)) for _ in solver.trends])).withColumn("ends", F.lit(None).cast(_LISTS)))
    todo = known
    before = F.lag("ends").over(Window.partitionBy("symbol.symbol").orderBy("symbol.slice"))
    for _ in range(TURNS):
        asked = todo.select("symbol", "one", "two", "three")
        ended = _of(lead, asked).groupBy("symbol").cogroup(asked.groupBy("symbol")).applyInArrow(run, f"symbol {pair}, ends {_LISTS}")
        met = known.join(ended.withColumnRenamed("ends", "_ends"), "symbol", "left").withColumn("ends", F.coalesce("_ends", "ends")).drop("_ends")
        checked = met.withColumn("_next", before).withColumn("again", F.col("_next").isNotNull() & ~F.col("_next").eqNullSafe(F.col("three")))
        known = cut(checked.withColumn("three", F.coalesce("_next", "three")).drop("_next"))
        todo, known = known.where("again").drop("again"), known.drop("again")
        if not todo.limit(1).count():
            return known.drop("ends")
    left = todo.select(F.col("symbol.symbol").alias("_name")).distinct()
    rows = lead.join(left, F.col("symbol.symbol").eqNullSafe(F.col("_name")), "left_semi").repartition("symbol.symbol").sortWithinPartitions("symbol.symbol", "symbol.slice", "ts")
    walked = rows.mapInArrow(_walked(solver.wanted), f"symbol {pair}, three {_LISTS}").withColumnRenamed("three", "_three")
    return known.join(walked, "symbol", "left").withColumn("three", F.coalesce("_three", "three")).drop("_three", "ends")


def _of(lead: DataFrame, slices: DataFrame) -> DataFrame:
    return lead.join(slices.select(F.col("symbol").alias("_pair")), F.col("symbol") == F.col("_pair"), "left_semi")


def _walked(wanted: dict):
    """What each slice's trends come in with, of whole symbols in order of slice and time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, last, states = _Solver({k: v for k, v in wanted.items() if v[0] == "supertrend_dir"}), None, None
        for batch in batches:
            bars, pairs, made = _numbers(batch), batch.column("symbol").to_pylist(), []
            turns = [k for k in range(len(pairs)) if not k or pairs[k] != pairs[k - 1]]
            for lo, hi in zip(turns, [*turns[1:], len(pairs)]):
                if last is None or pairs[lo]["symbol"] != last["symbol"]:
                    states = None
                if pairs[lo] != last:
                    last = pairs[lo]
                    made.append((last, _lists(states[2]) if states else [list(_FRESH) for _ in solver.trends]))
                _, states = solver.solve({c: x[lo:hi] for c, x in bars.items()}, states)
            kind = batch.schema.field("symbol").type
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], kind), pa.array([x for _, x in made], pa.list_(pa.list_(pa.float64())))], ["symbol", "three"])

    return run


def add_recurrences(bars: DataFrame, wanted: dict[str, tuple[str, dict]], slicing: Slicing | None = None) -> DataFrame:
    """Add columns: name -> (recurrence, parameters).  bars keeps its other columns.

    Needs prices without NULL (validate() sees to that).  Without slicing a symbol is one task, and its rows stay in
    order by ts; with it, a slice is.  Results are the same to rounding.
    """
    solver = _Solver(wanted)
    if slicing is None:
        dealt = bars.repartition("symbol").sortWithinPartitions("symbol", "ts")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields) + "".join(f", `{name}` double" for name in wanted)
        return dealt.withColumns(_inputs()).mapInArrow(_streamed(wanted, bars.columns), schema)
    sliced = split(bars, slicing, before=1).withColumns(_inputs()).where("_kept")
    return whole(_scanned(cut(sliced), solver, wanted))
