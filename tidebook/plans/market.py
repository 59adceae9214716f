"""Market-shaped views over the benchmark tables.

``events`` becomes ticks, quotes, book deltas and orders; ``lineitem`` becomes
fills; ``orders`` becomes order events; ``part`` becomes instruments.  The
same definitions in SQL are in ``oracle_views``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators.bars import time_bars
from tidebook.operators.series import Cuts, Series, measure_cuts
from tidebook.session import configure

HOUR = 3_600_000_000_000
DAY = 24 * HOUR

_CUTS: dict[tuple, Cuts] = {}


def nanos(ts: str) -> Column:
    """Nanoseconds since the epoch of a timestamp column."""
    return F.unix_micros(F.col(ts).cast("timestamp")) * 1000


def r(col: Column | str, places: int = 6) -> Column:
    """Rounded double for comparisons."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), places)


class Market:
    """Lazy views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, rows_per_block: int | None = None):
        self.spark = configure(spark)
        self.dir = sf_dir
        self.rows_per_block = rows_per_block

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _cuts(
        self, name: str, df: DataFrame, keys: tuple[str, ...], at: str, tie: str | None = None
    ) -> Cuts:
        """Cuts are measured once per table from its key and order columns."""
        slot = (self.dir, name, self.rows_per_block, id(self.spark))
        if slot not in _CUTS:
            kw = {"rows_per_block": self.rows_per_block} if self.rows_per_block else {}
            _CUTS[slot] = measure_cuts(df, keys, at, tie=tie, **kw)
        return _CUTS[slot]

    # -- events ---------------------------------------------------------

    @cached_property
    def ticks(self) -> DataFrame:
        ts = nanos("ts")
        return self.table("events").select(
            F.col("event_type").alias("symbol"),
            ts.alias("ts"),
            F.col("event_id").alias("seq"),
            F.col("value").alias("price"),
            F.get_json_object("props", "$.k").cast("double").alias("size"),
            F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).cast("long").alias("aggressor"),
            (ts + (F.col("event_id") % 1000) * 1000).alias("ts_init"),
            "user_id",
        )

    @cached_property
    def tick_cuts(self) -> Cuts:
        rows = self.table("events").select(
            F.col("event_type").alias("symbol"),
            nanos("ts").alias("ts"),
            F.col("event_id").alias("seq"),
        )
        return self._cuts("ticks", rows, ("symbol",), "ts", tie="seq")

    @property
    def tick_series(self) -> Series:
        return Series.of("symbol", ("ts", "seq"), self.tick_cuts)

    @cached_property
    def bars(self) -> DataFrame:
        return time_bars(self.ticks, HOUR)

    @property
    def bar_series(self) -> Series:
        # Hourly bars are few, but they share the ticks' time axis and cuts.
        return Series.of("symbol", "ts_event", self.tick_cuts)

    @cached_property
    def wide_ticks(self) -> DataFrame:
        return self.ticks.withColumn("symbol", F.concat(F.lit("U"), F.col("user_id").cast("string")))

    @cached_property
    def wide_cuts(self) -> Cuts:
        rows = self.table("events").select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
            nanos("ts").alias("ts"),
        )
        return self._cuts("wide", rows, ("symbol",), "ts")

    @cached_property
    def wide_bars(self) -> DataFrame:
        return time_bars(self.wide_ticks, HOUR)

    @property
    def wide_series(self) -> Series:
        return Series.of("symbol", "ts_event", self.wide_cuts)

    @cached_property
    def quotes(self) -> DataFrame:
        p = F.col("price")
        return self.ticks.select(
            "symbol",
            "ts",
            "seq",
            (p * (1 - 1e-4)).alias("bid"),
            (p * (1 + 1e-4)).alias("ask"),
            (F.col("size") / 2).alias("bid_size"),
            (F.col("size") / 2).alias("ask_size"),
        )

    @cached_property
    def deltas(self) -> DataFrame:
        late = F.when(F.col("seq") % 97 == 0, 1000).otherwise(0)
        return self.ticks.select(
            "symbol",
            "ts",
            "seq",
            F.col("aggressor").alias("side"),
            F.floor("price").cast("long").alias("price"),
            F.when(F.col("size") % 5 == 0, 0.0).otherwise(F.col("size")).alias("size"),
            (F.col("seq") - late).alias("sequence"),
            F.when(F.col("seq") % 500 == 0, "Clear").otherwise("Update").alias("action"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        """One order per tick; it lives for two days."""
        kind = F.when(F.col("seq") % 3 == 0, "market").when(F.col("seq") % 3 == 1, "limit")
        side = F.when(F.col("seq") % 4 < 2, 1).otherwise(-1).cast("long")
        p, buy = F.col("price"), F.col("seq") % 4 < 2
        # Every fifth limit is marketable; limits are on the tick grid, so bars can just touch them.
        through = F.col("seq") % 5 == 0
        buys = F.when(through, F.ceil(p * 101)).otherwise(F.floor(p * 98)).cast("double")
        sells = F.when(through, F.floor(p * 99)).otherwise(F.ceil(p * 102)).cast("double")
        is_limit, is_stop = F.col("seq") % 3 == 1, F.col("seq") % 3 == 2
        return self.ticks.select(
            F.col("seq").alias("order_id"),
            "symbol",
            F.col("ts").alias("ts_decision"),
            (F.col("ts") + 2 * DAY).alias("valid_to"),
            side.alias("side"),
            kind.when(is_stop, "stop").alias("type"),
            (1 + F.col("size").cast("long") % 20).alias("qty"),
            F.when(is_limit, F.when(buy, buys).otherwise(sells) / 100.0).alias("limit"),
            F.when(is_stop, F.when(buy, p * 1.02).otherwise(p * 0.98)).alias("trigger"),
            p.alias("ref"),
        )

    @cached_property
    def telemetry(self) -> DataFrame:
        fields = {
            "equity": "view",
            "gross_exposure": "click",
            "net_exposure": "purchase",
            "realized_pnl": "signup",
            "unrealized_pnl": "error",
        }
        return self.table("events").select(
            F.col("user_id").alias("account"),
            nanos("ts").alias("ts"),
            F.col("event_id").alias("seq"),
            *[
                F.when(F.col("event_type") == kind, F.col("value") * 1000.0).alias(name)
                for name, kind in fields.items()
            ],
        )

    @property
    def telemetry_series(self) -> Series:
        cuts = self._cuts("telemetry", self.telemetry, ("account",), "ts")
        return Series.of("account", ("ts", "seq"), cuts)

    @cached_property
    def raw_frames(self) -> DataFrame:
        """Venue messages as text: trade, quote and depth frames, some broken."""
        t = self.ticks
        px, qty = F.format_string("%.2f", "price"), F.format_string("%.2f", "size")
        ms = F.call_function("div", F.col("ts"), F.lit(1_000_000)).cast("string")
        stop = F.col("seq").cast("string")
        trade = F.concat(
            F.lit('{"e":"trade","E":'), ms, F.lit(',"s":"'), F.col("symbol"), F.lit('","t":'),
            stop, F.lit(',"p":"'), px, F.lit('","q":"'), qty, F.lit('","T":'), ms,
            F.lit(',"m":'), F.when(F.col("aggressor") < 0, "true").otherwise("false"), F.lit("}"),
        )
        quote = F.concat(
            F.lit('{"u":'), stop, F.lit(',"s":"'), F.col("symbol"), F.lit('","b":"'), px,
            F.lit('","B":"'), qty, F.lit('","a":"'), px, F.lit('","A":"'), qty, F.lit('"}'),
        )
        depth = F.concat(
            F.lit('{"e":"depthUpdate","E":'), ms, F.lit(',"s":"'), F.col("symbol"),
            F.lit('","U":'), stop, F.lit(',"u":'), stop, F.lit(',"b":[["'), px, F.lit('","'),
            qty, F.lit('"],["'), px, F.lit('","0.00"]],"a":[["'), px, F.lit('","'), qty,
            F.lit('"]]}'),
        )
        kind = F.col("seq") % 4
        name = F.when(kind < 2, "@trade").when(kind == 2, "@bookTicker").otherwise("@depth")
        body = F.when(kind < 2, trade).when(kind == 2, quote).otherwise(depth)
        frame = F.concat(
            F.lit('{"stream":"'), F.col("symbol"), name, F.lit('","data":'), body, F.lit("}")
        )
        return t.select(
            "seq",
            F.when(F.col("seq") % 100 == 0, F.lit("{broken")).otherwise(frame).alias("text"),
            "ts_init",
        )

    # -- lineitem -------------------------------------------------------

    @cached_property
    def raw_fills(self) -> DataFrame:
        """Fills in a total order given by all of the ordering columns."""
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("symbol"),
            nanos("l_shipdate").alias("ts"),
            F.col("l_orderkey").alias("k1"),
            F.col("l_linenumber").cast("long").alias("k2"),
            F.col("l_quantity").alias("k3"),
            F.col("l_extendedprice").alias("k4"),
            F.col("l_partkey").alias("k5"),
            F.when(F.col("l_linestatus") == "F", 1).otherwise(-1).cast("long").alias("side"),
            F.col("l_quantity").cast("bigint").cast("double").alias("qty"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_partkey").alias("part"),
            F.col("l_discount").alias("discount"),
        )

    @cached_property
    def fill_cuts(self) -> Cuts:
        rows = self.table("lineitem").select(
            F.col("l_suppkey").alias("symbol"),
            nanos("l_shipdate").alias("ts"),
            F.col("l_orderkey").alias("k1"),
        )
        return self._cuts("fills", rows, ("symbol",), "ts", tie="k1")

    @property
    def fill_order(self) -> Series:
        return Series.of("symbol", ("ts", "k1", "k2", "k3", "k4", "k5", "side"), self.fill_cuts)

    @cached_property
    def fills(self) -> DataFrame:
        numbered = self.fill_order.number(self.raw_fills, "seq")
        return numbered.select(
            "symbol", "ts", "seq", "side", "qty", "px", "flag", "part", "discount",
            F.col("k1").alias("order_id"),
        )

    @property
    def fill_series(self) -> Series:
        return Series.of("symbol", ("ts", "seq"), self.fill_cuts)

    @cached_property
    def fill_bars(self) -> DataFrame:
        """Monthly closes per supplier: the last fill price of each 30 days."""
        width = 30 * DAY
        end = (F.call_function("div", F.col("ts"), F.lit(width)) + 1) * width
        order = F.struct(*self.fill_order.by)
        return self.raw_fills.groupBy("symbol", end.alias("ts_event")).agg(
            F.max_by("px", order).alias("close")
        )

    @property
    def fill_bar_series(self) -> Series:
        return Series.of("symbol", "ts_event", self.fill_cuts)

    # -- orders and part -----------------------------------------------

    @cached_property
    def order_events(self) -> DataFrame:
        """Status path of each order; every 40th gets an illegal second Accepted."""
        status = F.col("o_orderstatus")
        start = ["Initialized", "Submitted", "Accepted"]
        lits = lambda names: F.array(*[F.lit(n) for n in names])
        path = (
            F.when(status == "O", lits(start))
            .when(status == "P", lits([*start, "PartiallyFilled"]))
            .otherwise(lits([*start, "PartiallyFilled", "Filled"]))
        )
        path = F.when(
            F.col("o_orderkey") % 40 == 0, F.concat(path, lits(["Accepted"]))
        ).otherwise(path)
        fill = F.col("event").isin("PartiallyFilled", "Filled")
        return (
            self.table("orders")
            .select(
                F.col("o_orderkey").alias("client_order_id"),
                F.col("o_orderpriority").alias("strategy_id"),
                nanos("o_orderdate").alias("ts"),
                F.col("o_totalprice").alias("px"),
                F.posexplode(path).alias("seq", "event"),
            )
            .select(
                "client_order_id",
                "strategy_id",
                (F.col("ts") + F.col("seq") * 1_000_000).alias("ts"),
                F.col("seq").cast("long").alias("seq"),
                "event",
                F.lit(10.0).alias("order_qty"),
                F.when(fill, F.lit(5.0)).alias("last_qty"),
                F.when(fill, F.col("px") / 100.0 + F.col("seq")).alias("last_px"),
            )
        )

    @cached_property
    def instruments(self) -> DataFrame:
        symbols = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
        base = 1_704_844_800_000_000_000  # 2024-01-10
        return self.table("part").select(
            F.col("p_partkey").alias("instrument"),
            (1 + F.col("p_size") % 10).cast("double").alias("multiplier"),
            (F.col("p_size") % 7 == 0).alias("is_inverse"),
            F.col("p_retailprice").alias("strike"),
            F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("right"),
            (F.lit(base) + F.col("p_size").cast("long") * DAY).alias("expiry_ns"),
            F.get(symbols, (F.col("p_partkey") % 5).cast("int")).alias("underlying"),
            F.col("p_size").cast("long").alias("p_size"),
        )
