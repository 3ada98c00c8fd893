from decimal import Decimal

from tapeline.plans import catalogue
from tapeline.sources import adapters

from .conftest import SF001


def test_every_trade_has_the_barrier_of_a_plain_search(spark):
    """Day by day over all trades, with the cut of the query's SQL nowhere."""
    trades = adapters.ticks(spark, SF001).collect()
    bars: dict = {}
    for t in trades:
        bars.setdefault((t.ticker, t.venue), {}).setdefault(t.ts_event // catalogue.DAY + 1, []).append(t.price)
    want = {}
    for t in trades:
        up = 1 if t.seq % 2 == 0 else -1
        stop, target = (t.price * (100 + up * p) / Decimal(100) for p in (-10, 20))
        want[t.seq] = "time"
        for day, prices in sorted(bars[t.ticker, t.venue].items()):
            if t.ts_event < day * catalogue.DAY <= t.ts_event + 3 * catalogue.DAY:
                worst, best = (min(prices), max(prices)) if up == 1 else (max(prices), min(prices))
                met = "stop" if up * (worst - stop) <= 0 else "target" if up * (best - target) >= 0 else None
                if met:
                    want[t.seq] = met
                    break
    got = catalogue.triple_barrier(spark, SF001).collect()
    assert len(got) == len(trades) and {r.seq: r.barrier for r in got} == want
    assert set(want.values()) == {"stop", "target", "time"}
