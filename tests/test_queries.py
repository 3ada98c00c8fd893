import ast
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tapeline.plans import catalogue

from .conftest import SF001

REPO = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF001)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(catalogue.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(rel.columns) == len(cols) and ours == theirs


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    ids = catalogue.QUERIES["derived_ids"](spark, SF001).limit(5).collect()
    assert all(r.intent_id.startswith("int_") and len(r.order_id) == 20 for r in ids)


def test_plans_push_down_and_prune(spark):
    plan = catalogue.QUERIES["bar_rollup_1h"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "GreaterThan(value" in scan and "props" not in scan.split("ReadSchema")[1] and plan.count("Exchange") <= 2


#: Names whose results differ from run to run.
BANNED = {"current_timestamp", "now", "rand", "randn", "uuid", "shuffle", "localCheckpoint"}


def test_no_wall_clock_and_no_chance():
    for path in (REPO / "tapeline").rglob("*.py"):
        tree = ast.parse(path.read_text())
        for node in ast.walk(tree):
            if isinstance(node, ast.Attribute) and node.attr in BANNED:
                assert path.name == "clock.py", f"{path}: {node.attr}"
            if isinstance(node, (ast.Import, ast.ImportFrom)) and path.name not in ("clock.py",):
                names = [a.name for a in node.names] + [getattr(node, "module", None) or ""]
                assert not {"time", "random"} & set(names), path


def test_nothing_else_imports_llm():
    for path in (REPO / "tapeline").rglob("*.py"):
        if "llm" not in path.parts:
            imported = [n for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, (ast.Import, ast.ImportFrom))]
            assert not any("llm" in (getattr(n, "module", None) or "").split(".") + [a.name for a in n.names] for n in imported), path
