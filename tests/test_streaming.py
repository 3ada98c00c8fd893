from decimal import Decimal as D

import pytest

from tapeline.operators import bars, positions
from tapeline.streaming import events

MIN = 60_000_000_000
BASE = 28_000_000 * MIN


def test_bars_repeats_and_append(spark, tmp_path):
    ddl = "id string, ticker string, venue string, ts_event long, ts_init long, seq int, price decimal(18,8), size decimal(28,8)"
    rows = [(f"t{i}", "A", "N", BASE + i * MIN // 4, 0, i, D(100 + i % 7), D(1)) for i in range(40)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([*rows[:5], ("end", "A", "N", BASE + 60 * MIN, 0, 999, D(1), D(1))], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events.append(events.bars(events.without_repeats(read(), "id", "10 minutes"), "1m", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {(r.ts_event, int(r.open), int(r.close), int(r.volume)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.ts_event, int(r.open), int(r.close), int(r.volume)) for r in bars.from_ticks(spark.createDataFrame(rows, ddl), "1m").collect()}
    assert got == want


def test_streamed_positions(spark, tmp_path):
    """seq is a number without leading zeros, and all fills have one time, so 10 comes after 9; one fill comes late."""
    pytest.importorskip("google.protobuf")  # what the state server needs
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", events.ROCKSDB)
    ddl = "ticker string, venue string, ts_event long, seq long, side string, price decimal(18,8), quantity decimal(28,8), commission_amount decimal(38,8)"
    rows = [("A", "N", 7, i, "BUY" if i % 3 else "SELL", D(100 + i % 5), D(10 + 5 * (i % 2)), D(1)) for i in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], ddl).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    spark.createDataFrame([("A", "N", 7, 3, "BUY", D(1), D(1), D(0))], ddl).coalesce(1).write.parquet(str(tmp_path / "in/3"))
    for k in range(4):  # one part after the other, on one state
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in" / f"[0-{k}]"))
        events.append(events.positions(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    on_time, late = events.split_late(spark.read.parquet(str(tmp_path / "out")))
    assert [(r.ts_event, r.seq) for r in late.collect()] == [(7, "3")]
    want = positions.running(spark.createDataFrame(rows, ddl)).toPandas().set_index("seq")
    got = on_time.toPandas()
    assert sorted(map(int, got.seq)) == list(range(30))
    for r in got.itertuples():
        assert D(r.quantity) == want.quantity[r.seq] and abs(D(r.realised_pnl) - want.realised_pnl[r.seq]) < D("1e-9") and r.fill_count == want.fill_count[r.seq]
