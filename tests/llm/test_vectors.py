"""Neighbours on tables stored in an order, and queries whose parts hold few rows."""

import numpy as np

from pulsegrid.llm import ann


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x)], "vec_id long, embedding array<double>")


def test_sample_and_recall_on_a_table_sorted_by_cluster(spark):
    rng = np.random.default_rng(3)
    n, of = 16_000, np.repeat(np.arange(64), 250)
    x = (rng.normal(size=(64, 16)) * 4)[of] + rng.normal(size=(n, 16))
    d = table(spark, x).coalesce(4)
    _, router = ann.fit(ann.usable(d), 10, n)
    home = router.home(x)
    spread = [len(set(home[of >= 32])), len(set(home[of < 32]))]
    assert min(spread) > 0.3 * router.n_parts
    got = {}
    for r in ann.nearest(d, d.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    late = hits = 0
    for q in range(0, n, 100):
        s = x @ x[q]
        s[q] = -np.inf
        found = len(got[q] & set(np.argsort(-s)[:10].tolist()))
        hits += found
        late += found if q >= n // 2 else 0
    assert hits >= 0.9 * 10 * (n // 100) and late >= 0.9 * 10 * (n // 200)


def test_parts_with_few_rows_of_other_ids(spark, monkeypatch):
    """Every query gets k rows, also where its nearest parts hold only rows of its own id."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2_000, 8))
    x[:300] = x[0] * 3 + rng.normal(size=(300, 8)) * 1e-3
    fit = ann.fit

    def one_probe(*a):
        dims, router = fit(*a)
        router.probes = 1
        return dims, router

    monkeypatch.setattr(ann, "fit", one_probe)
    ids = [7] * 300 + list(range(1000, 2700))
    d = table(spark, x, ids)
    got = ann.nearest(d, d.where("vec_id = 7 or vec_id % 10 = 0"), 200).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} == {200} and 7 in {r["query_id"] for r in got}
