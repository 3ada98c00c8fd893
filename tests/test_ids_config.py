import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tapeline import cli, clock, config, logs
from tapeline.functions import ids

REPO = Path(__file__).resolve().parents[1]


def test_golden_ids(spark):
    assert ids.derive("int", "orb", "1.0.0", "AAPL.NASDAQ", 1773495000000000000, 0) == "int_4a2256397fa1b828"
    assert ids.run_id("cfg_abc", 1000) == "run_70cb2f8ca1524537"
    df = spark.createDataFrame([("orb", "1.0.0", "AAPL.NASDAQ", 1773495000000000000, 0), ("orb", "1.0.0", None, 1, 0)], "s string, v string, y string, t long, q int")
    got = [r[0] for r in df.select(ids.intent_id(*map(F.col, "svytq"))).collect()]
    assert got == ["int_4a2256397fa1b828", None]
    one = spark.createDataFrame([("int_x", 5, "e1")], "i string, t long, e string")
    r = one.select(ids.order_id(F.col("i"), F.col("t")).alias("o"), ids.fill_id(F.col("i"), F.col("e")).alias("f")).first()
    assert r.o == ids.derive("ord", "int_x", 5, 0) and r.f == ids.derive("fil", "int_x", "e1")
    with pytest.raises(Exception, match="empty execution id"):
        one.select(ids.fill_id(F.col("i"), F.lit(""))).collect()


def test_hash_is_the_same_in_any_process():
    code = "from tapeline import config; print(config.config_hash(config.load('paper', environ={})))"
    seen = {subprocess.run([sys.executable, "-c", code], cwd=REPO, env={"PYTHONHASHSEED": s, "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.strip() for s in ("0", "1", "77")}
    assert seen == {"cfg_d842e94e473f9869"}


def test_hashes_and_layers(tmp_path):
    assert config.config_hash(config.load("live", environ={})) == "cfg_0355e7b4b9bef4d8"
    assert config.config_hash(config.load(environ={})) == "cfg_471008b03c2c45ab"
    s = config.load("paper", environ={"TAPELINE_STORAGE__DATA_ROOT": "/x", "TAPELINE_LOG_LEVEL": "ERROR", "OTHER": "1"})
    assert (s.storage.raw_dir, s.storage.derived_dir, s.log_level) == ("/x/raw", "/x/derived", "ERROR") and config.config_hash(s) == "cfg_d842e94e473f9869"
    assert config.load(environ={"TAPELINE_PROFILE": "paper"}).profile == "paper"
    with pytest.raises(FileNotFoundError):
        config.load("live", tmp_path, {})
    for bad in ({"TAPELINE_NONSENSE": "1"}, {"TAPELINE_ALLOW_LIVE_ORDERS": "true"}, {"TAPELINE_LOG_LEVEL": "LOUD"}):
        with pytest.raises(ValueError):
            config.load("paper", environ=bad)
    with pytest.raises(ValueError):
        config.load("nowhere", environ={})
    (tmp_path / "list.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        config.read_yaml(tmp_path / "list.yaml")
    assert config.read_yaml(tmp_path / "none.yaml") == {}
    assert config.merge({"disk": {"root": "/d", "keep": 5}, "n": 1}, {"disk": {"keep": 9, "zip": True}, "n": {"m": 2}}) == {"disk": {"root": "/d", "keep": 9, "zip": True}, "n": {"m": 2}}
    assert config.canonical({"b": {2, 1}, "a": (Path("/p"),)}) == {"a": ["/p"], "b": [1, 2]}


def test_cli_answers_on_stdout(capsys, monkeypatch):
    monkeypatch.delenv("TAPELINE_PROFILE", raising=False)
    assert cli.main(["--profile", "live", "config", "hash"]) == 0
    assert capsys.readouterr().out == "cfg_0355e7b4b9bef4d8\n"
    cli.main(["config", "show"])
    out = capsys.readouterr().out.splitlines()
    assert out[0].split() == ["profile", "research"] and out[-1].startswith("run_id") and out[-2].split()[1] == "cfg_471008b03c2c45ab"
    cli.main(["version"])
    assert capsys.readouterr().out.strip() == "0.1.0"
    with pytest.raises(SystemExit):
        cli.main(["--profile", "moon", "version"])


def test_logs_carry_the_run(capsys):
    run = logs.configure(config.load("paper", environ={}), clock.SimClock(5))
    logs.bind(symbol="AAPL")
    logs.get_logger("x").info("hello")
    line = json.loads(capsys.readouterr().err)
    assert line["run_id"] == run and line["profile"] == "paper" and line["symbol"] == "AAPL" and line["event"] == "hello"
    logs.clear_context()
    logs.get_logger().warning("again")
    assert "run_id" not in json.loads(capsys.readouterr().err)


def test_clocks():
    from datetime import UTC, datetime

    assert [clock.to_datetime(n).microsecond for n in (999, 1999, 123_456_789)] == [0, 1, 123456]
    moment = datetime(1969, 7, 20, 20, 17, 40, tzinfo=UTC)
    assert clock.to_datetime(clock.to_nanos(moment)) == moment and clock.to_nanos(moment) < 0
    with pytest.raises(ValueError):
        clock.to_nanos(datetime(2026, 1, 1))
    s = clock.SimClock(10)
    s.advance_to(10), s.advance(5)
    assert s.now_ns() == 15 and clock.LiveClock().now_ns() > 0
    for bad in (lambda: s.advance_to(14), lambda: s.advance(-1)):
        with pytest.raises(ValueError):
            bad()
