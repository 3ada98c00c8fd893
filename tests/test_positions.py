from decimal import Decimal as D

import pytest

from tapeline.functions import columns as c
from tapeline.operators import positions, valuation
from tapeline.operators.positions import State

DDL = "id string, ticker string, venue string, ts_event long, ts_init long, seq long, side string, price decimal(18,8), quantity decimal(28,8), commission_amount decimal(38,8), liquidity string, reference_price decimal(18,8)"


def fold(text):
    """'B100@100 S40@104' or with a commission, 'B100@100/1.25'."""
    s = State()
    for f in text.split():
        rest, _, fee = f[1:].partition("/")
        q, p = rest.split("@")
        s.apply("BUY" if f[0] == "B" else "SELL", D(p), D(q), D(fee or 0))
    return s


@pytest.mark.parametrize("text,side,quantity,average,realised", [
    ("B100@100", "BUY", 100, 100, 0), ("S100@100", "SELL", 100, 100, 0), ("B100@100 B100@102", "BUY", 200, 101, 0), ("B300@100 B100@108", "BUY", 400, 102, 0),
    ("B100@100 S100@102", None, 0, None, 200), ("B100@100 S100@99", None, 0, None, -100), ("S100@100 B100@98", None, 0, None, 200), ("S100@100 B100@101", None, 0, None, -100),
    ("B100@100 S40@104", "BUY", 60, 100, 160), ("B300@100 S100@101 S100@102 S100@103", None, 0, None, 600), ("B100@100 S150@102", "SELL", 50, 102, 200), ("S100@100 B250@98", "BUY", 150, 98, 200),
    ("B300@100 B100@108 S500@110", "SELL", 100, 110, 3200),
])
def test_vectors(text, side, quantity, average, realised):
    s = fold(text)
    assert (s.side, s.quantity, s.average, s.realised) == (side, quantity, average, realised)


def test_fees_stay_apart():
    s = fold("B100@100/6 S100@100.05/6")
    assert (s.realised, s.fees, s.realised - s.fees, s.fills) == (5, 12, -7, 2)
    assert fold("B1@1/1.00 B1@1/1.25").fees == D("2.25")


def table(spark, seed=0, n=400, symbols=5):
    import random

    r = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((f"f{i}", f"T{r.randrange(symbols)}", "NYSE", i // 3, i // 3, i, r.choice(["BUY", "SELL"]), D(r.randrange(9000, 11000)) / 100, D(r.choice([10, 20, 30])), D(r.randrange(200)) / 100, "TAKER", None))
    return rows, spark.createDataFrame(rows, DDL)


def test_pieces_fold_as_the_whole(spark):
    rows, df = table(spark)
    want = {}
    for ticker in {r[1] for r in rows}:
        s = State()
        for r in sorted((r for r in rows if r[1] == ticker), key=lambda r: (r[3], r[5])):
            s.apply(r[6], r[7], r[8], r[9])
            want[str(r[5])] = (s.side, s.quantity, None if s.average is None else round(s.average, 9), round(s.realised, 9), s.fees, s.fills)
    got = {r.seq: (r.side, r.quantity, None if r.average_price is None else round(r.average_price, 9), round(r.realised_pnl, 9), r.fees, r.fill_count) for r in positions.running(df.repartition(7)).collect()}
    assert got == want
    last = {}
    for r in sorted(rows, key=lambda r: (r[3], r[5])):
        last[r[1]] = want[str(r[5])]
    assert {r.ticker: (r.side, r.quantity, None if r.average_price is None else round(r.average_price, 9), round(r.realised_pnl, 9), r.fees, r.fill_count) for r in positions.final(df).collect()} == last


def test_prefix_is_the_running_state_and_repeats_are_dropped(spark):
    _, df = table(spark, 1)
    part = {r.ticker: r for r in positions.as_of(df, 60).collect()}
    steps = positions.running(df).filter("ts_event <= 60").toPandas().sort_values("fill_count").groupby("ticker").last()
    assert all(part[t].quantity == r.quantity and part[t].fees == r.fees for t, r in steps.iterrows())
    once = positions.dedup_fills(df.unionByName(df))
    assert sorted(map(str, positions.final(once).collect())) == sorted(map(str, positions.final(df).collect()))


def test_valuation(spark):
    rows = [("a", "A", "NYSE", 1, 1, 1, "BUY", D(100), D(200), D(2), "TAKER", None), ("b", "A", "NYSE", 2, 2, 2, "SELL", D(102), D(100), D(1), "TAKER", D("102.05")), ("c", "Z", "TSX", 1, 1, 1, "SELL", D(100), D(100), D(0), "MAKER", D(100)), ("d", "F", "NYSE", 1, 1, 1, "BUY", D(5), D(1), D(0), "MAKER", D(5)), ("e", "F", "NYSE", 2, 2, 2, "SELL", D(5), D(1), D(0), "MAKER", D(5))]
    final = positions.final(spark.createDataFrame(rows, DDL))
    marks = spark.createDataFrame([("A", "NYSE", D(103)), ("Z", "TSX", D(98))], "ticker string, venue string, mark decimal(18,8)")
    v = {r.ticker: r for r in valuation.value(final, marks).collect()}
    assert (v["A"].realised_pnl, v["A"].fees, v["A"].unrealised_pnl, v["A"].total_pnl) == (200, 3, 300, 497)
    assert (v["Z"].unrealised_pnl, v["Z"].market_value, v["Z"].currency) == (200, -9800, "CAD")
    assert v["F"].unrealised_pnl == 0 and v["F"].side is None
    e = {r.currency: (r.net, r.gross) for r in valuation.exposure(valuation.value(final, marks)).collect()}
    assert e["USD"] == (10300, 10300) and e["CAD"] == (-9800, 9800)
    r = final.filter("ticker = 'A'").select(c.realised_r("quantity", "quantity").alias("r"), c.is_long().alias("l"), c.signed_quantity().alias("s")).first()
    assert r.r == pytest.approx(197 / 10000) and r.l and r.s == 100
