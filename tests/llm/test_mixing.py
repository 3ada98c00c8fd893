from fractions import Fraction

import numpy as np

from tapeline.llm import mixing

DDL = "doc_id long, source string, size long, extra int, taken string"


def rows(spark, data):
    return spark.createDataFrame(data, DDL)


def water_fill(sizes, weights, most):
    """Brute force with exact fractions: one source capped at a time, the one furthest above."""
    capped = {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        unit = Fraction(sum(sizes) - sum(capped.values()), sum(weights[i] for i in rest)) if rest else 0
        above = [i for i in rest if unit * weights[i] > most * sizes[i]]
        if not above:
            return [float(capped[i] if i in capped else unit * weights[i]) for i in range(len(sizes))]
        worst = max(above, key=lambda i: unit * weights[i] - most * sizes[i])
        capped[worst] = most * sizes[worst]


def test_targets_are_capped_and_reshared():
    for sizes in ([10, 1000, 50], [5, 5, 5, 5000], [0, 7], [1], [3, 3, 3]):
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        got = mixing.targets(sizes, weights, 3)
        assert np.allclose(got, water_fill(sizes, weights, 3))
        assert np.isclose(sum(got), sum(sizes))


def test_tree_keeps_quotas_and_totals():
    quotas = np.array([1000, 3, 0, 57, 400])
    tree = mixing.split_quotas(quotas, 7, np.random.default_rng(1))
    assert (tree.sum(axis=0) == quotas).all() and (tree >= 0).all()
    assert tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 1
    large = mixing.draw(np.array([mixing.MAX_BLOCKS // 2, 5, mixing.MAX_BLOCKS // 2 - 5]), mixing.MAX_BLOCKS // 3, np.random.default_rng(1))
    assert large.sum() == mixing.MAX_BLOCKS // 3 and (large >= 0).all() and large[1] <= 5


def test_draws_have_the_hypergeometric_mean_and_spread():
    rng, have, n = np.random.default_rng(2), np.array([60, 30, 10]), 40
    got = np.array([mixing.draw(have, n, rng) for _ in range(4000)])
    share = have / have.sum()
    assert np.allclose(got.mean(axis=0), n * share, atol=0.15)
    assert np.allclose(got.var(axis=0), n * share * (1 - share) * (100 - n) / 99, rtol=0.1)


def test_a_huge_mix_has_longer_blocks(spark):
    data = [(i, f"s{i % 2}", 1 << 40, 0, "") for i in range(400)]
    out = mixing.mix_plan(rows(spark, data), "size", block_words=16).toPandas()
    assert abs(out.taken.sum() / (400 * 2**40) - 1) < 0.02 and all(set(s) <= set(range(16)) for s in out.shards)


def test_mix_meets_targets_and_agrees_with_itself(spark):
    rng = np.random.default_rng(0)
    data = [(i, "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None, int(rng.integers(0, 300)), i, "x") for i in range(3000)]
    first = mixing.mix_plan(rows(spark, data), "size").toPandas()
    again = mixing.mix_plan(rows(spark, data[::-1]).repartition(5), "size").toPandas()
    both = first.merge(again, on="doc_id")
    assert (both.taken_x == both.taken_y).all() and both.shards_x.map(list).equals(both.shards_y.map(list))
    assert len(first) == 3000 and (first.taken <= 3 * first["size"]).all() and (first.taken == first["size"] * first.copies).all()
    assert first.extra.notna().all()
    for _, g in first.groupby("source", dropna=False):
        assert g.source_size.iloc[0] == g["size"].sum()
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.01 * g.target.iloc[0] + 2
    assert set(s for x in first.shards for s in x) <= set(range(16))
    assert all(len(s) == c for s, c in zip(first.shards, first.copies))


def test_copies_have_a_shard_and_a_local_place(spark):
    data = [(i, f"s{i % 2}", 5, 0, "") for i in range(40)]
    out = mixing.mix(rows(spark, data), "size", n_shards=4, block_words=7).toPandas()
    assert len(out) == out.drop_duplicates(["doc_id", "copy"]).shape[0]
    assert out.groupby("source")["size"].sum().to_dict() == {"s0": 145, "s1": 55} or abs(out["size"].sum() - 200) <= 5
    assert out["shard"].between(0, 3).all() and out.shuffle_key.notna().all()


def test_odd_rows(spark):
    assert mixing.mix_plan(rows(spark, []), "size").count() == 0
    data = [(None, None, None, None, None), (1, "a", 0, 1, ""), (1, "a", 0, 1, ""), (2, "b", 10, 1, ""), (2, "b", 10, 1, "")]
    out = mixing.mix_plan(rows(spark, data), "size").toPandas()
    assert len(out) == 5 and (out.taken <= 30).all()
