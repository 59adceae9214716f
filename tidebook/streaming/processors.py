"""Stateful processors: the batch folds, kept per key between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

from tidebook.operators.book import Book, Continuity
from tidebook.operators.orders import TERMINAL, OrderState
from tidebook.operators.positions import AverageCost


def in_order(rows: Iterator[Row], *by: str) -> list[Row]:
    """Rows of one key and micro-batch in event order."""
    return sorted(rows, key=lambda r: tuple(r[c] for c in by))


def _rows(output: str, values: list[tuple]) -> Iterator[Row]:
    """Output rows, made one at a time as they are taken."""
    make = Row(*[column.split()[0] for column in output.split(", ")])
    return (make(*v) for v in values)


def _columns(frames: Iterator[pd.DataFrame], by: list[str], *names: str) -> list[list]:
    """Columns of one key and micro-batch as lists, in the order ``by``."""
    whole = pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable")
    return [whole[n].tolist() for n in names]


def _frame(output: str, columns: list) -> pd.DataFrame:
    """Output rows, given as columns."""
    return pd.DataFrame(dict(zip([c.split()[0] for c in output.split(", ")], columns)))


def _keep(state, items: list) -> None:
    """Replace a list state; the store does not take empty lists."""
    if items:
        state.put(items)
    else:
        state.clear()


class ExponentialFilter(StatefulProcessor):
    """Exponential average per symbol; may start warm from lake history."""

    output = "symbol string, ts bigint, seq bigint, price double, ema double"

    def __init__(self, period: int):
        self.period = period

    def init(self, handle) -> None:
        self.state = handle.getValueState("ema", "n bigint, y double")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((int(initialState["n"]), float(initialState["y"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, y = self.state.get() or (0, 0.0)
        alpha = 2.0 / (self.period + 1.0)
        out = []
        for r in in_order(rows, "ts", "seq"):
            y = r["price"] if n == 0 else y + alpha * (r["price"] - y)
            n += 1
            shown = y if n >= self.period else None
            out.append((key[0], r["ts"], r["seq"], r["price"], shown))
        self.state.update((n, y))
        return _rows(self.output, out)


class Positions(StatefulProcessor):
    """Average-cost position per symbol after every fill, in whole units; takes frames.

    A group holds one symbol or several that share its state and its calls.
    """

    output = (
        "symbol bigint, ts bigint, seq bigint, net_raw bigint, avg_raw bigint, realized_raw bigint"
    )

    def init(self, handle) -> None:
        self.state = handle.getValueState(
            "pos",
            "symbol array<bigint>, net array<bigint>, avg array<bigint>, realized array<bigint>",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {}
        for symbol, net, avg, realized in zip(*(self.state.get() or ())):
            held[symbol] = [book := AverageCost(), realized]
            book.net, book.avg = net, avg
        names = ("symbol", "ts", "seq", "side", "qty_raw", "px_raw", "fee_raw")
        symbols, ts, seq, *fills = _columns(rows, ["symbol", "ts", "seq"], *names)
        if key[0] is None:
            symbols = [None] * len(ts)
        out = []
        for symbol, side, qty, px, fee in zip(symbols, *fills):
            if symbol not in held:
                held[symbol] = [AverageCost(), 0]
            own = held[symbol]
            book = own[0]
            gain = book.fill(side * qty, px, lambda e, x, q: (x - e) * q if e else 0)
            own[1] += gain - fee
            out.append((book.net, book.avg, own[1]))
        packed = ((s, book.net, book.avg, realized) for s, (book, realized) in held.items())
        self.state.update(tuple(map(list, zip(*packed))))
        yield _frame(self.output, [symbols, ts, seq, *zip(*out)])


class Orders(StatefulProcessor):
    """Life cycle of the orders of one group; a finished order can be forgotten after ``keep_ms``.

    A call to the state costs more than the events of an order, so neighbouring
    orders share a group, its state and its calls.  Takes frames; these can't
    tell a null from a NaN, so ``NULLS`` says where a null is.
    """

    output = (
        "client_order_id bigint, seq bigint, event string, accepted boolean, status string, "
        "filled_qty double, leaves_qty double"
    )
    VALUES = ("order_qty", "last_qty", "last_px")
    NULLS = tuple(f"no_{v}" for v in VALUES)

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "orders",
            "id array<bigint>, status array<string>, filled array<double>, "
            "notional array<double>, qty array<double>, ignored array<bigint>, "
            "done_ms array<bigint>",
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {}
        for ident, *packed, done in zip(*(self.state.get() or ())):
            order = OrderState()
            order.status, order.filled, order.notional, order.qty, order.ignored = packed
            held[ident] = (order, done)
        names = ("client_order_id", "seq", "event", *self.VALUES, *self.NULLS)
        ids, seq, events, *values = _columns(rows, ["client_order_id", "seq"], *names)
        if key[0] is None:
            ids = [None] * len(ids)
        out = []
        for ident, event, *v in zip(ids, events, *values):
            if ident not in held:
                held[ident] = (OrderState(), None)
            order = held[ident][0]
            ok = order.apply(event, *[None if no else x for x, no in zip(v, v[3:])])
            status, filled, leaves, _, _ = order.view()
            out.append((ok, status, filled, leaves))
        if self.keep_ms is not None:
            self._time(held, timerValues.getCurrentProcessingTimeInMs())
        packed = (
            (i, o.status, o.filled, o.notional, o.qty, o.ignored, done)
            for i, (o, done) in held.items()
        )
        self.state.update(tuple(map(list, zip(*packed))))
        yield _frame(self.output, [ids, seq, events, *zip(*out)])

    def _time(self, held: dict, now: int) -> None:
        """Remember when orders were first seen finished, and wake up to forget them."""
        new = [i for i, (o, done) in held.items() if done is None and o.status in TERMINAL]
        for ident in new:
            held[ident] = (held[ident][0], now)
        if new:
            self.handle.registerTimer(now + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = expiredTimerInfo.getExpiryTimeInMs() - self.keep_ms
        held = zip(*(self.state.get() or ()))
        kept = [o for o in held if o[-1] is None or o[-1] > before]
        if kept:
            self.state.update(tuple(map(list, zip(*kept))))
        else:
            self.state.clear()
        return iter(())


class Books(StatefulProcessor):
    """Top of book after every delta; levels live in a map state per book."""

    output = (
        "symbol string, seq bigint, applied boolean, bid double, bid_size double, "
        "ask double, ask_size double, levels bigint"
    )

    def init(self, handle) -> None:
        self.levels = handle.getMapState("levels", "side int, price double", "size double")
        self.last = handle.getValueState("last", "sequence bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        book = Book()
        before = {}
        for (side, price), (size,) in self.levels.iterator():
            before[(side, price)] = size
            book.sides[side][price] = size
        held = self.last.get()
        book.last = held[0] if held else None
        out = []
        for r in in_order(rows, "ts", "seq"):
            price = float(r["price"])
            ok = book.apply(r["action"], r["side"], price, r["size"], r["sequence"])
            bid, bid_size, ask, ask_size, levels = book.top()
            out.append((key[0], r["seq"], ok, bid, bid_size, ask, ask_size, levels))
        after = {(s, p): q for s, side in book.sides.items() for p, q in side.items()}
        for level in before.keys() - after.keys():
            self.levels.removeKey(level)
        for level, size in after.items():
            if before.get(level) != size:
                self.levels.updateValue(level, (size,))
        self.last.update((book.last,))
        return _rows(self.output, out)


class DepthResync(StatefulProcessor):
    """Continuity of depth diffs per symbol, with a buffer while a snapshot is awaited.

    Input rows are snapshots and diffs in arrival order; the output tells what
    to apply and when to fetch a snapshot.
    """

    output = "symbol string, arrival bigint, outcome string, last_id bigint"

    def init(self, handle) -> None:
        self.state = handle.getValueState("book", "last bigint, synced boolean, awaiting boolean")
        self.buffer = handle.getListState(
            "buffer", "arrival bigint, first bigint, last bigint, prev bigint"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        book = Continuity()
        book.last, book.synced, awaiting = self.state.get() or (0, False, False)
        waiting = list(self.buffer.get())
        out = []

        def emit(arrival, outcome):
            out.append(
                Row(symbol=key[0], arrival=arrival, outcome=outcome, last_id=book.last)
            )

        for r in in_order(rows, "arrival"):
            if r["kind"] == "snapshot":
                book.snapshot(r["last_id"])
                awaiting = False
                emit(r["arrival"], "snapshot")
                held, waiting = waiting, []
                for arrival, first, last, prev in held:
                    if last <= r["last_id"]:
                        emit(arrival, "skipped")
                        continue
                    outcome = book.diff(first, last, prev)
                    emit(arrival, outcome)
                    if outcome == "resync":
                        awaiting = True
                        break
                continue
            diff = (r["arrival"], r["first_id"], r["last_id"], r["prev_id"])
            if awaiting or (not book.synced and book.last == 0):
                awaiting = True
                waiting.append(diff)
                emit(r["arrival"], "buffered")
                continue
            outcome = book.diff(*diff[1:])
            emit(r["arrival"], outcome)
            if outcome == "resync":
                awaiting, waiting = True, [diff]
        self.state.update((book.last, book.synced, awaiting))
        _keep(self.buffer, waiting)
        return iter(out)


class AccountMonitor(StatefulProcessor):
    """Account limits over sparse telemetry; one control event per account."""

    output = "account bigint, ts bigint, seq bigint, limits string"
    FIELDS = ("equity", "gross_exposure", "net_exposure")

    def __init__(self, max_drawdown_pct: float, max_gross: float, max_net: float, max_loss: float):
        self.limits = (max_drawdown_pct, max_gross, max_net, max_loss)

    def init(self, handle) -> None:
        self.state = handle.getValueState(
            "account",
            "equity double, gross_exposure double, net_exposure double, peak double, "
            "day_start double, tripped boolean",
        )

    def _broken(self, s: dict) -> list[str]:
        dd, gross, net, loss = self.limits
        found = []
        if s["peak"] > 0 and (s["peak"] - s["equity"]) / s["peak"] >= dd:
            found.append("max_drawdown")
        if s["gross_exposure"] > gross:
            found.append("gross_exposure")
        if abs(s["net_exposure"]) > net:
            found.append("net_exposure")
        if max(s["day_start"] - s["equity"], 0.0) > loss:
            found.append("loss_of_day")
        return found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = (*self.FIELDS, "peak", "day_start", "tripped")
        s = dict(zip(names, self.state.get() or (0.0, 0.0, 0.0, 0.0, 0.0, False)))
        out = []
        for r in in_order(rows, "ts", "seq"):
            for f in self.FIELDS:
                if r[f] is not None:
                    s[f] = r[f]
            if r["equity"] is not None:
                s["peak"] = max(s["peak"], r["equity"])
                s["day_start"] = s["day_start"] or r["equity"]
            if s["tripped"]:
                continue
            broken = self._broken(s)
            if broken:
                s["tripped"] = True
                out.append(
                    Row(account=key[0], ts=r["ts"], seq=r["seq"], limits=",".join(broken))
                )
        self.state.update(tuple(s[n] for n in names))
        return iter(out)
