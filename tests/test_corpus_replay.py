from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tapeline.operators import asof, bars, replay
from tapeline.sources import corpus, schema

NOW, DAY = 1_773_495_000_000_000_000, 86_400_000_000_000
DDL = "ticker string, venue string, ts_event long, ts_init long, seq int, interval string, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), volume decimal(28,8), vwap decimal(18,8), trade_count long"


def bar(i=0, ticker="AAPL", venue="NASDAQ", close="100.5", step=60_000_000_000, **over):
    row = dict(ticker=ticker, venue=venue, ts_event=NOW + i * step + 123, ts_init=NOW + i * step + 456, seq=i, interval="1m", open=D("100.12345678"), high=D("101.87654321"), low=D("99.00000001"), close=D(close), volume=D("1234567.89"), vwap=None, trade_count=None) | over
    return tuple(row.values())


def table(spark, rows):
    return spark.createDataFrame(rows, DDL)


def test_round_trip_is_lossless(spark, tmp_path):
    rows = [bar(i) for i in range(50)] + [bar(0, "SHOP", "TSX", vwap=D("100.4"), trade_count=812), bar(0, "123", "NYSE", volume=D(0))]
    corpus.write_bars(corpus.bar_rows(table(spark, rows), "synthetic", 7), str(tmp_path))
    back = corpus.bars_of(corpus._scan(spark, str(tmp_path)))
    assert sorted(map(tuple, back.select(*table(spark, rows).columns).collect()), key=str) == sorted(rows, key=str)
    assert (tmp_path / "venue=NYSE/ticker=123/session_date=2026-03-14").is_dir()
    assert corpus.partition_path("r/", "TSX", "SHOP", "2026-03-14") == "r/venue=TSX/ticker=SHOP/session_date=2026-03-14"


def test_writing_again_changes_nothing(spark, tmp_path):
    rows = corpus.bar_rows(table(spark, [bar(i) for i in range(5)]), "yfinance", 1)
    for _ in range(2):
        corpus.write_bars(rows, str(tmp_path))
    corpus.write_bars(corpus.bar_rows(table(spark, [bar(4, close="101"), bar(5)]), "ibkr", 2), str(tmp_path))
    back = corpus._scan(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.seq for r in back] == list(range(6)) and back[4].close == D("100.5")


def test_sources_have_an_order(spark):
    both = corpus.bar_rows(table(spark, [bar(0, close="100.1")]), "yfinance", 1).union(corpus.bar_rows(table(spark, [bar(0, close="100.2")]), "ibkr", 9))
    assert corpus.first_written(both).first().close == D("100.2")


def test_range_is_half_open_and_pruned(spark, tmp_path):
    corpus.write_bars(corpus.bar_rows(table(spark, [bar(i, step=DAY) for i in range(10)]), "synthetic", 1), str(tmp_path))
    got = corpus.read_bars(spark, str(tmp_path), "AAPL", "NASDAQ", "1m", NOW + 123 + 2 * DAY, NOW + 123 + 4 * DAY)
    assert [r.seq for r in corpus.iterate(got)] == [2, 3]
    plan = got._jdf.queryExecution().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "venue" in filters and "ticker" in filters and "session_date" in filters and "GreaterThanOrEqual(ts_event" in plan


def test_stores_fit_their_ports(spark, tmp_path):
    from tapeline.sources import ports

    store = corpus.BarStore(spark, str(tmp_path))
    assert isinstance(store, ports.Storage) and isinstance(corpus.EventLog(spark, str(tmp_path)), ports.EventStore) and not isinstance(store, ports.Broker)
    store.write_bars(corpus.bar_rows(table(spark, [bar(0), bar(1)]), "ibkr", 1))
    assert [r.seq for r in store.read_bars("AAPL", "NASDAQ", "1m", NOW, NOW + 60_000_000_000).collect()] == [0]


def test_bad_tables_are_refused(spark):
    good = table(spark, [bar()])
    with pytest.raises(TypeError):
        corpus.bar_rows(good.withColumn("close", F.col("close").cast("double")), "ibkr", 1)
    with pytest.raises(TypeError):
        corpus.bar_rows(good.withColumn("ts_event", F.col("ts_event").cast("string")), "ibkr", 1)
    with pytest.raises(ValueError):
        corpus.bar_rows(good, "elsewhere", 1)
    with pytest.raises(Exception, match="V7_high_below_low"):
        corpus.bars_of(corpus.bar_rows(table(spark, [bar(high=D(1))]), "ibkr", 1)).count()
    assert schema.BAR.fields[0].metadata == {"schema_version": "1"} and len(schema.BAR) == 16 and corpus.bar_rows(good, "ibkr", 1).first().session_date == date(2026, 3, 14)


def test_event_log_and_replay(spark, tmp_path):
    log = corpus.EventLog(spark, str(tmp_path))
    a = spark.createDataFrame([(5, 5, 1, "A"), (3, 3, 0, "B")], "ts_event long, ts_init long, seq int, ticker string")
    log.append(a, "tick")
    log.append(a.withColumn("ts_event", F.col("ts_event") + 1).drop("ticker"), "session")
    assert [(r.ts_event, r.kind) for r in log.stream(3, 6).collect()] == [(3, "tick"), (4, "session"), (5, "tick")]
    tables = {"tick": a, "session": a.withColumn("extra", F.lit(1))}
    one = replay.replay(tables, 0, 10)
    assert [(r.ts_event, r.kind) for r in one.collect()] == [(3, "session"), (3, "tick"), (5, "session"), (5, "tick")]
    assert replay.digest(one) == replay.digest(one.repartition(7).orderBy(F.rand())) != replay.digest(one.filter("kind = 'tick'"))


def test_roll_up(spark):
    t = spark.createDataFrame([("A", "N", 0, 0, 1, D(5), D(1)), ("A", "N", 0, 0, 2, D(7), D(1)), ("A", "N", 60_000_000_000 - 1, 0, 3, D(4), D(2)), ("A", "N", 60_000_000_000, 0, 4, D(9), D(1))], "ticker string, venue string, ts_event long, ts_init long, seq int, price decimal(18,8), size decimal(28,8)")
    minute = bars.from_ticks(t, "1m").orderBy("ts_event").collect()
    assert [(r.ts_event // 60_000_000_000, int(r.open), int(r.high), int(r.low), int(r.close), int(r.volume), r.trade_count) for r in minute] == [(1, 5, 7, 4, 4, 4, 3), (2, 9, 9, 9, 9, 1, 1)]
    five = bars.roll_up(bars.from_ticks(t, "1m"), "5m").first()
    assert (five.ts_event, int(five.open), int(five.close), int(five.high), five.trade_count) == (300_000_000_000, 5, 9, 9, 4)


def test_asof_over_buckets(spark):
    import random

    r = random.Random(2)
    left = [(f"k{r.randrange(3)}", r.randrange(-500, 500), i) for i in range(200)]
    right = [(f"k{r.randrange(3)}", r.randrange(-500, 500), i, f"v{i}") for i in range(60)]
    out = asof.asof(spark.createDataFrame(left, "k string, ts_event long, i int"), spark.createDataFrame(right, "k string, ts_event long, seq int, v string"), ["k"], ["v"], order=["seq"], bucket_ns=50)
    want = {i: max(((t2, s, v) for k2, t2, s, v in right if k2 == k and t2 <= t), default=(0, 0, None))[2] for k, t, i in left}
    assert {x.i: x.v for x in out.collect()} == want and out.columns == ["k", "ts_event", "i", "v"]


def test_halts_and_barriers(spark):
    halts = spark.createDataFrame([("A", "N", 100), ("A", "N", 500), ("B", "N", 100)], "ticker string, venue string, ts_event long")
    resumes = spark.createDataFrame([("A", "N", 200)], "ticker string, venue string, ts_event long")
    gaps = {(r.ticker, r.halted_at): r.resumed_at for r in asof.halt_gaps(halts, resumes).collect()}
    assert gaps == {("A", 100): 200, ("A", 500): None, ("B", 100): None}
    b = spark.createDataFrame([("A", "N", t) for t in (99, 100, 199, 200, 501)], "ticker string, venue string, ts_event long")
    assert sorted(r.ts_event for r in asof.in_gap(b, asof.halt_gaps(halts, resumes)).collect()) == [100, 199, 501]
    i = spark.createDataFrame([(1, "A", "N", "BUY", D(9), 0, 100), (2, "A", "N", "SELL", D(11), 0, 100), (3, "A", "N", "BUY", D(1), 0, 20)], "id int, ticker string, venue string, side string, invalidation decimal(18,8), ts_event long, horizon_ns long")
    path = spark.createDataFrame([("A", "N", D(10), D(10), 0), ("A", "N", D("10.5"), D("9.5"), 10), ("A", "N", D(12), D(10), 50)], "ticker string, venue string, high decimal(18,8), low decimal(18,8), ts_event long")
    got = {r.id: (r.barrier, r.barrier_ts) for r in asof.triple_barrier(i, path, F.when(F.col("side") == "BUY", 12).otherwise(8), "id", bucket_ns=30).collect()}
    assert got == {1: ("target", 50), 2: ("stop", 50), 3: ("time", 20)}
