"""Identifiers derived from content, so that the same decision has the same id on every run. Survey ids: X3 to X7, V28, V29."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates parts, and how many hex digits of the digest an id keeps.
SEPARATOR, DIGITS = "\x1f", 16


def derive(prefix: str, *parts: object) -> str:
    """prefix_ and the first digits of the BLAKE2b-256 digest of the parts."""
    return prefix + "_" + hashlib.blake2b(SEPARATOR.join(map(str, parts)).encode(), digest_size=32).hexdigest()[:DIGITS]


def run_id(config_hash: str, started_ns: int) -> str:
    """X7"""
    return derive("run", config_hash, started_ns)


def _digest(joined: pd.Series) -> pd.Series:
    """Spark has no BLAKE2b. NULL stays NULL; equal parts of one batch are digested once."""
    known: dict[str, str] = {}
    for x in joined:
        if isinstance(x, str) and x not in known:
            known[x] = hashlib.blake2b(x.encode(), digest_size=32).hexdigest()[:DIGITS]
    return pd.Series([known.get(x) if isinstance(x, str) else None for x in joined], dtype=object)


def column(prefix: str, *parts: Column) -> Column:
    """The id of each row; NULL if a part is NULL."""
    texts = [p.cast("string") for p in parts]
    whole = texts[0]
    for t in texts[1:]:
        whole = F.concat(whole, F.lit(SEPARATOR), t)
    return F.concat(F.lit(prefix + "_"), F.pandas_udf(_digest, "string")(whole))


def intent_id(strategy: Column, version: Column, symbol: Column, ts_event: Column, seq: Column) -> Column:
    """X4"""
    return column("int", strategy, version, symbol, ts_event, seq)


def order_id(intent: Column, ts_event: Column, attempt: Column | None = None) -> Column:
    """A resubmission counts attempts up from 0."""
    return column("ord", intent, ts_event, F.lit(0) if attempt is None else attempt)


def fill_id(order: Column, broker_exec_id: Column) -> Column:
    """An empty execution id identifies nothing and is an error."""
    sure = F.when(broker_exec_id == "", F.raise_error(F.lit("empty execution id")).cast("string")).otherwise(broker_exec_id)
    return column("fil", order, sure)
