"""A paper broker as a stateful stream: orders and bars in, fills and refusals out, one state per account.

The same step function serves a batch (replay) and a stream (match_stream), so both give the same fills.
An account is walked in order, since its cash ties its orders; a batch is one pass, which holds an Arrow batch and the account's open orders.
It simulates only; no order leaves the process.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.simulate import Fees, Market

#: account, at and seq order the rows; an order row has order_id.., a bar row open..
INPUT = "account string, at timestamp, seq long, kind string, symbol string, order_id string, side string, order_type string, qty double, limit_price double, stop_price double, open double, high double, low double, close double, volume double"
OUTPUT = "account string, at timestamp, order_id string, symbol string, status string, qty double, price double, commission double, cash double, position double, reason string"


def fresh(cash: float, once: bool = False) -> dict:
    """An account without orders; once: no order comes twice, so that closed ones need not be remembered."""
    return {"cash": cash, "held": {}, "average": {}, "orders": {}, "done": None if once else {}}


def _remember(state: dict, order_id: str) -> None:
    if state["done"] is not None:
        state["done"][order_id] = 1


def _problem(state: dict, row) -> str | None:
    """Why an order can't be taken."""
    if not row.qty or row.qty <= 0:
        return "qty below minimum"
    if row.side == "SELL" and state["held"].get(row.symbol, 0.0) - row.qty < -1e-12:
        return "short selling not available for instrument"
    if row.order_type == "LIMIT" and (row.limit_price is None or math.isnan(row.limit_price)):
        return "limit order without limit price"
    if row.order_type == "STOP" and (row.stop_price is None or math.isnan(row.stop_price)):
        return "stop order without stop price"
    return None


def _reference(order: dict, bar) -> float | None:
    """The price at which a bar meets an order, before costs; None if it does not."""
    buy, kind = order["side"] == "BUY", order["type"]
    if kind == "MARKET":
        return bar.open
    level = order["stop"] if kind == "STOP" else order["limit"]
    rising = buy == (kind == "STOP")  # reached from below: a buy stop or a sell limit
    if (bar.high >= level) if rising else (bar.low <= level):
        return max(bar.open, level) if rising else min(bar.open, level)
    return None


def step(state: dict, row, fees: Fees, market: Market) -> list[tuple]:
    """Take one row into an account's state; returns output rows without the account.

    Of an order that is no longer open only its id is kept, so that sending it again changes nothing; not even that, where none comes twice.
    """

    def close(order_id: str) -> None:
        del state["orders"][order_id]
        _remember(state, order_id)

    if row.kind == "order":
        if row.order_id in state["orders"] or row.order_id in (state["done"] or ()):
            return []  # sent again: nothing changes
        problem = _problem(state, row)
        if problem:
            _remember(state, row.order_id)
        else:
            state["orders"][row.order_id] = {"symbol": row.symbol, "side": row.side, "type": row.order_type, "left": row.qty, "limit": row.limit_price, "stop": row.stop_price}
        return [(row.at, row.order_id, row.symbol, "REJECTED" if problem else "NEW", 0.0, None, 0.0, state["cash"], state["held"].get(row.symbol, 0.0), problem)]
    out, most = [], market.available(row.volume)
    for order_id, order in list(state["orders"].items()):  # open ones only
        if order["symbol"] != row.symbol or (ref := _reference(order, row)) is None:
            continue
        qty, sign = min(order["left"], most), 1 if order["side"] == "BUY" else -1
        if qty <= 0:
            continue
        price = ref if order["type"] == "LIMIT" else market.price(ref, sign)
        fee, had = fees.of(qty, price), state["held"].get(row.symbol, 0.0)
        if sign > 0 and had >= 0 and qty * price + fee > state["cash"] + 1e-9:
            close(order_id)
            out.append((row.at, order_id, row.symbol, "REJECTED", 0.0, None, 0.0, state["cash"], had, "insufficient cash"))
            continue
        now = had + sign * qty
        if had == 0 or had * sign > 0:
            state["average"][row.symbol] = (state["average"].get(row.symbol, 0.0) * abs(had) + price * qty) / abs(now)
        elif now * had < 0:
            state["average"][row.symbol] = price
        state["cash"] -= sign * qty * price + fee
        state["held"][row.symbol] = now
        order["left"] -= qty
        part = order["left"] > 1e-12
        if not part:
            close(order_id)
        out.append((row.at, order_id, row.symbol, "PARTIALLY_FILLED" if part else "FILLED", qty, price, fee, state["cash"], now, None))
    return out


_NAMES = [f.split()[0] for f in OUTPUT.split(", ")]


def _run(account: str, state: dict, pdf: pd.DataFrame, fees: Fees, market: Market) -> pd.DataFrame:
    rows = [(account, *x) for row in pdf.sort_values(["at", "seq"]).itertuples(index=False) for x in step(state, row, fees, market)]
    return pd.DataFrame(rows, columns=_NAMES)


#: Output rows that are handed on at once
_PIECE = 10_000


def _walked(cash: float, fees: Fees, market: Market):
    """Rows of whole accounts, each in order and without orders sent again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, out = None, None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if last is None or row.account != last[0]:
                    last, state = (row.account,), fresh(cash, once=True)
                out += [(row.account, *x) for x in step(state, row, fees, market)]
                if len(out) >= _PIECE:
                    yield pd.DataFrame(out, columns=_NAMES)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=_NAMES)
                out = []

    return run


def _first_sent(rows: DataFrame) -> DataFrame:
    """rows without the orders whose id their account has sent before."""
    order = F.coalesce(F.col("kind") == "order", F.lit(False))
    sent = Window.partitionBy("account", "order_id").orderBy(F.col("at").asc_nulls_last(), F.col("seq").asc_nulls_last())
    first = rows.where(order).withColumn("_sent", F.row_number().over(sent)).where("_sent = 1").drop("_sent")
    return first.unionByName(rows.where(~order))


def replay(rows: DataFrame, cash: float, fees: Fees = Fees(), market: Market = Market()) -> DataFrame:
    """All fills and refusals of INPUT rows, account by account, each a stream of sorted rows through one task."""
    dealt = _first_sent(rows).repartition("account").sortWithinPartitions("account", F.col("at").asc_nulls_last(), F.col("seq").asc_nulls_last())
    return dealt.mapInPandas(_walked(cash, fees, market), OUTPUT)


def match_stream(rows: DataFrame, cash: float, fees: Fees = Fees(), market: Market = Market()) -> DataFrame:
    """The same over a stream of INPUT rows that come in order; an account's state is kept as JSON."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else fresh(cash)
        pdf = pd.concat(list(batches))
        out = _run(key[0], own, pdf, fees, market)
        state.update((json.dumps(own),))
        yield out

    return rows.groupBy("account").applyInPandasWithState(update, OUTPUT, "body string", "append", GroupStateTimeout.NoTimeout)


def reconcile(ours: DataFrame, theirs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """symbol, ours, theirs where positions (symbol, qty) differ; one side's absence counts as 0."""
    from pyspark.sql import functions as F

    both = ours.select("symbol", F.col("qty").alias("ours")).join(theirs.select("symbol", F.col("qty").alias("theirs")), "symbol", "full")
    both = both.select("symbol", F.coalesce("ours", F.lit(0.0)).alias("ours"), F.coalesce("theirs", F.lit(0.0)).alias("theirs"))
    return both.where(F.abs(F.col("ours") - F.col("theirs")) > tolerance)
