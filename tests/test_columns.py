from decimal import Context
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tapeline.functions import columns as c
from tapeline.functions import rules

P = "decimal(18,8)"


def one(spark, ddl, row, *cols):
    r = spark.createDataFrame([row], ddl).select(*[x.alias(f"c{i}") for i, x in enumerate(cols)]).first()
    return list(r)


def test_quotes(spark):
    ddl = f"bid_price {P}, ask_price {P}, bid_size decimal(28,8), ask_size decimal(28,8)"
    assert one(spark, ddl, (D("100.00"), D("100.02"), D(900), D(100)), c.spread(), c.mid(), c.microprice(), c.is_locked(), c.is_crossed()) == [D("0.02"), D("100.01"), D("100.018"), False, False]
    assert one(spark, ddl, (D("100.05"), D("100.00"), D(0), D(0)), c.microprice(), c.is_crossed()) == [D("100.025"), True]
    assert one(spark, ddl, (D(5), D(5), D(1), D(1)), c.is_locked(), c.microprice()) == [True, D(5)]


def test_bars(spark):
    ddl = f"ts_event long, ts_init long, interval string, open {P}, high {P}, low {P}, close {P}"
    row = (60_000_000_000, 59_999_999_999, "1m", D(100), D(102), D(99), D(101))
    assert one(spark, ddl, row, c.ts_open(), c.bar_range(), c.is_up(), c.latency_ns()) == [0, 3, True, -1]
    with pytest.raises(Exception, match="unknown interval"):
        one(spark, ddl, (*row[:2], "2m", *row[3:]), c.ts_open())


@pytest.mark.parametrize("side,price,reference,slip", [("BUY", "100.05", "100.00", "0.05"), ("SELL", "99.95", "100.00", "0.05"), ("BUY", "99.98", "100.00", "-0.02"), ("BUY", "100.05", None, None)])
def test_costs(spark, side, price, reference, slip):
    ddl = f"side string, price {P}, reference_price {P}, quantity decimal(28,8), commission_amount decimal(38,8)"
    got = one(spark, ddl, (side, D(price), reference and D(reference), D(100), D(1)), c.slippage_per_share(), c.slippage_cost(), c.total_cost())
    assert got == ([None] * 3 if slip is None else [D(slip), D(slip) * 100, D(slip) * 100 + 1])


@pytest.mark.parametrize("side,stop,entry,risk,target", [("BUY", 99, "100", "1", "102"), ("SELL", 101, "100", "1", "98"), ("BUY", 99, "100.50", "1.5", "103.5")])
def test_intents(spark, side, stop, entry, risk, target):
    ddl = f"side string, invalidation {P}, target_r {P}, e {P}, ts_event long, horizon_ns long"
    assert one(spark, ddl, (side, D(stop), D(2), D(entry), 5, 7), c.risk_per_share("e"), c.target_price("e"), c.expires_at(), c.reward_to_risk()) == [D(risk), D(target), 12, 2]
    with pytest.raises(Exception, match="no defined risk"):
        one(spark, ddl, (side, D(entry), D(2), D(entry), 5, 7), c.risk_per_share("e"))


def test_exact_products_and_prices(spark):
    assert one(spark, f"a {P}, b decimal(28,8)", (D("1234567.12345678"), D("1234567.00000001")), c.product("a", "b")) == [Context(prec=60).multiply(D("1234567.12345678"), D("1234567.00000001"))]
    assert one(spark, "a string", ("1.12345678",), c.exact_price("a"), c.try_price("a")) == [D("1.12345678")] * 2
    assert one(spark, "a string", ("1.123456789",), c.try_price("a")) == [None] and one(spark, "a string", ("x",), c.try_price("a")) == [None]
    with pytest.raises(Exception, match="eight decimals"):
        one(spark, "a string", ("1.123456789",), c.exact_price("a"))
    with pytest.raises(Exception, match="two currencies"):
        one(spark, "a string, b string, v decimal(38,8)", ("USD", "CAD", D(1)), c.same_currency("a", "b", F.col("v")))
    with pytest.raises(Exception, match="below zero"):
        one(spark, "a decimal(28,8), b decimal(28,8)", (D(3), D(4)), c.quantity_difference("a", "b"))


def test_time(spark):
    for ns in (999, 1999, 123_456_789, -1, -1500, 9_007_199_254_740_993_999, 0):
        assert one(spark, "n long", (ns,), c.to_micros("n")) == [ns // 1000]
    t = spark.sql("select timestamp_ntz'1969-07-20 20:17:40' t").select(c.to_nanos("t")).first()[0]
    assert t == -14_182_940 * 10**9


def test_names_versions_maps(spark):
    assert one(spark, "n string, v string", ("atr", None), c.qualified_name("n", "v")) == ["atr"] and one(spark, "n string, v string", ("atr", "1.0.0"), c.qualified_name("n", "v")) == ["atr@1.0.0"]
    assert one(spark, "a string", ("1.10.0",), c.version_parts("a") > F.struct(F.lit(1).alias("major"), F.lit(9).alias("minor"), F.lit(0).alias("patch"))) == [True]
    for bad in ("7", "3.4.", "2..5", " 1.2.3", "1.2.3.4", "x.2.3", "1.2.3\n"):
        assert one(spark, "a string", (bad,), c.is_version("a")) == [False]
    m = "m map<string,double>"
    assert one(spark, m, ({"x": None, "y": 1.0},), c.value_of("m", "x"), c.value_of("m", "y"), c.requires()) == [None, 1.0, True]
    with pytest.raises(Exception, match="isn't declared"):
        one(spark, m, ({"x": 1.0},), c.value_of("m", "z"))
    assert one(spark, "s string, v string, q string", ("SELL", "TSXV", "CLOSED"), c.sign("s"), c.opposite("s"), c.currency("v"), c.is_tradable("q")) == [-1, "BUY", "CAD", False]


BAR = f"ticker string, venue string, ts_event long, ts_init long, seq int, interval string, open {P}, high {P}, low {P}, close {P}, volume decimal(28,8), vwap {P}, trade_count long"


def bar(**over):
    row = dict(ticker="AAPL", venue="NASDAQ", ts_event=1, ts_init=2, seq=0, interval="1m", open=D(100), high=D(102), low=D(99), close=D(101), volume=D(0), vwap=None, trade_count=None) | over
    return tuple(row.values())


@pytest.mark.parametrize("over,rule", [
    ({}, None), ({"high": D(98)}, "V7_high_below_low"), ({"open": D(500)}, "V8_open"), ({"close": D(500)}, "V9_close"), ({"vwap": D(500)}, "V10_vwap"), ({"trade_count": -1}, "V11_trade_count"), ({"seq": -1}, "V1_seq"),
    ({"ticker": ""}, "V5_ticker_empty"), ({"ticker": " AAPL"}, "V5_ticker_space"), ({"ticker": "AAPL "}, "V5_ticker_space"), ({"ticker": "Aapl"}, "V5_ticker_case"), ({"venue": "SMART"}, "V6_venue_is_route"), ({"venue": "XX"}, "V42_venue"), ({"interval": "2m"}, "V42_interval"), ({"close": None}, "null_close"),
])
def test_bar_rules(spark, over, rule):
    good, bad = rules.quarantine(spark.createDataFrame([bar(**over)], BAR), rules.bar())
    assert good.count() == (rule is None) and (rule is None or rule in bad.first().violations)
    if rule:
        with pytest.raises(Exception, match=rule):
            rules.strict(spark.createDataFrame([bar(**over)], BAR), rules.bar()).count()


def test_other_rules(spark):
    def broken(ddl, row, rs):
        return set(spark.createDataFrame([row], ddl).select(rules.violations(rs)).first()[0])

    event = "ticker string, venue string, ts_event long, ts_init long, seq int, "
    e = ("AAPL", "NASDAQ", 1, 1, 0)
    tick = event + "price double, size double, aggressor string"
    assert broken(tick, (*e, 1.0, 0.0, None), rules.tick()) == {"V12_size"} and "V2_price" in broken(tick, (*e, float("nan"), 1.0, None), rules.tick())
    order = event + f"id string, intent_id string, side string, quantity decimal(28,8), order_type string, time_in_force string, limit_price {P}, stop_price {P}"
    for kind, limit, stop, want in (("MARKET", 1, None, {"V14_limit_price"}), ("LIMIT", None, None, {"V14_limit_price"}), ("LIMIT", 1, 1, {"V15_stop_price"}), ("STOP", None, None, {"V15_stop_price"}), ("STOP_LIMIT", 1, 1, set())):
        assert broken(order, (*e, "i", "j", "BUY", D(1), kind, "DAY", limit and D(limit), stop and D(stop)), rules.order()) == want
    fill = event + f"id string, order_id string, side string, price {P}, quantity decimal(28,8), commission_amount decimal(38,8), commission_ccy string, liquidity string, reference_price {P}"
    assert broken(fill, ("SHOP", "TSX", 1, 1, 0, "i", "j", "BUY", D(1), D(0), D(1), "USD", "TAKER", None), rules.fill()) == {"V16_quantity", "V17_currency"}
    intent = event + f"side string, entry string, entry_price {P}, invalidation {P}, target_r {P}, horizon_ns long, strategy string, strategy_version string, rationale string"
    good = dict(side="BUY", entry="LIMIT", entry_price=D(100), invalidation=D(99), target_r=D(2), horizon_ns=1, strategy="s", strategy_version="1.0.0", rationale="because")
    for over, want in (({}, set()), ({"entry": "MARKET"}, {"V18_entry_price"}), ({"target_r": D(0)}, {"V19_target_r"}), ({"horizon_ns": 0}, {"V20_horizon"}), ({"rationale": " \t"}, {"V21_rationale"}), ({"strategy": ""}, {"V22_strategy"}), ({"invalidation": D(100)}, {"V23_stop_side"}), ({"entry": "MARKET", "entry_price": None, "invalidation": D(101)}, set())):
        assert broken(intent, (*e, *(good | over).values()), rules.intent()) == want
    assert broken("a string", ("int_tooshort",), rules.identifier("a", "int")) == {"V28_a"} and broken("a string", ("int_0123456789abcdef",), rules.identifier("a", "int")) == set()


def test_products_of_large_quantities(spark):
    got = one(spark, "p decimal(18,8), q decimal(28,8)", (D("3.00000001"), D("1000000000000.00000001")), c.product("p", "q"))
    assert got == [D("3000000010000.0000000300000001")]
    assert one(spark, "p decimal(18,8), q decimal(28,8)", (D("-2.5"), D("-0.00000001")), c.product("p", "q")) == [D("0.000000025")]
    ddl = "m decimal(18,8), average_price decimal(30,12), side string, quantity decimal(28,8)"
    third = D("0.333333333333")
    assert one(spark, ddl, (D(1), third, "BUY", D(3_000_000)), c.unrealised_pnl("m")) == [D("2000000.000001")]
    assert one(spark, ddl, (D(1), third, "SELL", D(10**12)), c.unrealised_pnl("m")) == [(third - 1) * 10**12]
    assert one(spark, "a decimal(28,8), b decimal(28,8)", (D(1), D(2)), c.quantity_sum("a", "b"), c.is_zero("a")) == [D(3), False]
