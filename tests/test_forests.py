"""Forests as routing tables: SQL restatement of a small forest, brute-force splits, independence of partitioning."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import forests, models

SCHEMA = "run int, seed int, beat_id long, y int, weight double, features array<float>"


def rows_of(n, width, runs=1, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for r in range(runs):
        y = rng.choice(5, n, p=[0.5, 0.2, 0.15, 0.1, 0.05])
        x = (rng.normal(size=(5, width))[y] + rng.normal(size=(n, width))).astype(np.float32)
        x[:, 1] = np.round(x[:, 1])  # ties
        x[:, 2] = 1.5  # never varies
        out += [(r, 7 + r, i, int(c), [1.0, 3.0, 1.5, 12.0, 1.0][c], v.tolist()) for i, (c, v) in enumerate(zip(y, x))]
    return out


def table_of(df, **kw):
    return sorted((tuple(r) for r in forests.nodes(forests.grow(df, ["run"], weight="weight", **kw), ["run"]).collect()), key=lambda r: r[:3])



def forest_sql(trees, width, k, min_leaf, depth):
    """All nodes of all trees, level by level, with the draws restated."""
    macro = """create or replace macro m1(h) as (xor(h, h >> 16) * 2246822507::ubigint) & 4294967295::ubigint;
create or replace macro m2(h) as (xor(h, h >> 13) * 3266489909::ubigint) & 4294967295::ubigint;
create or replace macro m3(h) as xor(h, h >> 16);
create or replace macro mix(h) as m3(m2(m1((h)::ubigint & 4294967295::ubigint)));
create or replace macro draw(h, k) as mix((h)::ubigint + ((k)::ubigint + 1) * 2654435769::ubigint);
create or replace macro gini(a) as (a[1] * a[1] + a[2] * a[2] + a[3] * a[3] + a[4] * a[4] + a[5] * a[5])
  / case when a[1] + a[2] + a[3] + a[4] + a[5] > 0 then a[1] + a[2] + a[3] + a[4] + a[5] else 1 end"""
    steps = [f"""l0 as materialized (select run, tree, 1::bigint as path, draw(mix(seed), tree) as h, beat_id, y, weight, x
  from rows, range({trees}) t(tree))"""]
    for i in range(depth + 1):
        steps.append(f"""s{i} as materialized (select run, tree, path, any_value(h) as h, count(*) as n, count(distinct y) as classes,
  list_transform(range(5), lambda c: count(*) filter (where y = c)) as dummy, {', '.join(f'sum(weight) filter (where y = {c}) as w{c}' for c in range(5))}
  from l{i} group by all)""".replace("  list_transform(range(5), lambda c: count(*) filter (where y = c)) as dummy, ", "  "))
        if i == depth:
            break
        steps.append(f"""f{i} as materialized (select l.run, l.tree, l.path, f, min(x[f + 1])::double as lo, max(x[f + 1])::double as hi, any_value(l.h) as h
  from l{i} l join s{i} s using (run, tree, path), range({width}) r(f) where s.n >= {max(2, 2 * min_leaf)} and s.classes > 1 group by l.run, l.tree, l.path, f),
p{i} as materialized (select * from (select *, row_number() over (partition by run, tree, path order by draw(h, 2 * f), f) as nth from f{i} where hi > lo) where nth <= {k}),
c{i} as materialized (select run, tree, path, f, lo, case when lo + draw(h, 2 * f + 1) / 4294967296.0::double * (hi - lo) >= hi then lo else
  lo + draw(h, 2 * f + 1) / 4294967296.0::double * (hi - lo) end as cut from p{i}),
g{i} as (select c.run, c.tree, c.path, c.f, c.cut, count(*) filter (where x[f + 1]::double <= cut) as nl, count(*) filter (where x[f + 1]::double > cut) as nr,
  [{', '.join(f'coalesce(sum(weight) filter (where y = {c} and x[f + 1]::double <= cut), 0)' for c in range(5))}] as a,
  [{', '.join(f'coalesce(sum(weight) filter (where y = {c} and x[f + 1]::double > cut), 0)' for c in range(5))}] as b
  from c{i} c join l{i} l using (run, tree, path) group by all),
b{i} as materialized (select run, tree, path, f, cut from (select *, row_number() over (partition by run, tree, path order by gini(a) + gini(b) desc, f) as nth from g{i}
  where nl >= {min_leaf} and nr >= {min_leaf}) where nth = 1),
l{i + 1} as materialized (select l.run, l.tree, 2 * l.path + side as path, mix(2 * l.h + side + 1) as h, beat_id, y, weight, x from (
  select l.*, f, case when x[f + 1]::double > cut then 1 else 0 end as side from l{i} l join b{i} using (run, tree, path)) l)""")
    every = " union all ".join(f"select run, tree, path, n, b.f, b.cut, w0, w1, w2, w3, w4 from s{i} left join b{i} b using (run, tree, path)" if i < depth
                               else f"select run, tree, path, n, null, null, w0, w1, w2, w3, w4 from s{i}" for i in range(depth + 1))
    return macro, "with " + ",\n".join(steps) + f"\nselect * from ({every})"


def test_small_forest_equals_its_sql(spark):
    data = rows_of(120, 6, runs=2)
    got = table_of(spark.createDataFrame(data, SCHEMA).repartition(5), trees=5, subset="0.5", min_leaf=2, depth=4)
    con = duckdb.connect()
    con.execute("create table rows (run int, seed ubigint, beat_id bigint, y int, weight double, x float[])")
    con.executemany("insert into rows values (?, ?, ?, ?, ?, ?)", data)
    macro, sql = forest_sql(5, 6, 3, 2, 4)
    con.execute(macro)
    want = {r[:3]: r[3:] for r in con.execute(sql).fetchall()}
    by_node, paths, seen = {r[:3]: r for r in got}, {}, 0
    for run, tree, node, feature, cut, left, right, n, p in got:
        path = paths.setdefault((run, tree, node), 1) if node == 0 else paths[run, tree, node]
        if feature >= 0:
            paths[run, tree, left], paths[run, tree, right] = 2 * path, 2 * path + 1
        rows, f, c, *w = want[run, tree, path]
        w = [v or 0.0 for v in w]
        assert rows == n and (f is None) == (feature < 0) and (f is None or (f, c) == (feature, cut))
        assert p == pytest.approx([v / sum(w) for v in w])
        seen += 1
    assert seen == len(want) == len(by_node) > 60


def test_trees_do_not_depend_on_partitions_or_blocks(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(300, 8), SCHEMA)
    for splits in ("random", "best"):
        first = table_of(df.repartition(7), trees=6, splits=splits)
        monkeypatch.setattr(forests, "TREES_A_BLOCK", 4)
        assert table_of(df.coalesce(1).orderBy(F.desc("beat_id")), trees=6, splits=splits) == first
        monkeypatch.undo()


def test_best_split_against_all_cuts():
    rng = np.random.default_rng(4)
    w = np.array([1.0, 3.0, 1.5, 12.0, 1.0])
    for _ in range(20):
        n, d = 40, 4
        x, y = np.round(rng.normal(size=(n, d)), 1).astype(np.float32), np.sort(rng.integers(0, 5, n))
        times = rng.integers(1, 4, n).astype(float)
        found, f, cut = forests._best_split(x, y, np.array([0]), np.zeros(n, int), np.array([9], np.uint64), w, d, 3, times)
        best = max(_gain(x, y, times, w, j, v, 3) for j in range(d) for v in x[:, j])
        assert found[0] and _gain(x, y, times, w, f[0], cut[0], 3) == pytest.approx(best)


def _gain(x, y, times, w, f, cut, least):
    total = 0.0
    for side in (x[:, f] <= cut, x[:, f] > cut):
        if times[side].sum() < least:
            return -np.inf
        share = np.bincount(y[side], times[side], 5) * w
        total += (share ** 2).sum() / share.sum()
    return total


def test_pure_small_and_constant_nodes_are_leaves(spark):
    rows = [(0, 1, i, 0, 1.0, [float(i), 1.0]) for i in range(9)] + [(1, 1, i, i % 2, 1.0, [1.0, 1.0]) for i in range(9)] + [(2, 1, i, i % 2, 1.0, [float(i), 0.0]) for i in range(3)]
    got = table_of(spark.createDataFrame(rows, SCHEMA), trees=3, min_leaf=2)
    assert len(got) == 9 and all(r[3] == -1 for r in got)


def test_scores_are_mean_shares_and_rows_are_kept(spark):
    df = spark.createDataFrame(rows_of(200, 6, runs=2), SCHEMA)
    extra = spark.createDataFrame([(0, 7, 900, 1, 1.0, None), (5, 7, 901, 1, 1.0, [0.0] * 6), (0, 7, 902, None, 1.0, [0.0] * 6)], SCHEMA)
    rows = df.unionByName(extra)
    grown = forests.grow(rows.where("run < 5"), ["run"], weight="weight", trees=40, min_leaf=1, depth=None).cache()
    got = {(r["run"], r["beat_id"]): r for r in forests.score(grown, rows, ["run"], "beat_id").collect()}
    assert len(got) == 403 and got[0, 900]["p"] is None and got[5, 901]["p"] is None
    trees = {}
    for r in grown.collect():
        trees.setdefault(r["run"], []).append(r)
    for key in ((0, 3), (1, 77), (0, 902)):
        x, want = np.array(got[key]["features"], np.float64)[None], np.zeros(5)
        for t in trees[key[0]]:
            leaf = forests._route(x, *(np.array(t[c]) for c in ("feature", "threshold", "left", "right")))[0]
            want += np.array(t["p"][5 * leaf:5 * leaf + 5]) / 40
        assert got[key]["p"] == pytest.approx(want.tolist())
    assert np.mean([np.argmax(r["p"]) == r["y"] for k, r in got.items() if k[1] < 900]) > 0.99


def test_rows_beyond_the_bound_are_drawn_by_block(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(400, 4), SCHEMA)
    monkeypatch.setattr(forests, "FIT_ROWS", 100)
    monkeypatch.setattr(forests, "TREES_A_BLOCK", 1)
    sizes = [r["rows"][0] for r in forests.grow(df, ["run"], trees=12).select("rows").collect()]
    assert len(set(sizes)) > 3 and all(60 < n < 145 for n in sizes)


@pytest.mark.parametrize("k", [1, 3, 7, 8])
def test_drawn_features_give_the_split_of_all_features(k):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[:, 2], x[:, 5] = 1.0, np.round(x[:, 5])  # a constant one, and one that often does not vary in a node
    rows, y = rng.permutation(400)[:300], rng.integers(0, 5, 400)
    at = np.sort(rng.integers(0, 40, 300))
    at = np.unique(at, return_inverse=True)[1]
    rows = rows[np.lexsort((y[rows], at))]
    starts, weight = np.searchsorted(at, np.arange(at.max() + 1)), np.array([1, 3, 2, 5, 1.5])
    hashes = forests.root_hash(3, np.arange(len(starts)))
    mine = forests._random_split(x, rows, y[rows], starts, at, hashes, weight, k, 2)
    want = forests._any_split(x[rows], y[rows], starts, at, hashes, weight, k, 2)
    assert (mine[0] == want[0]).all() and mine[0].any()
    for a, b in zip(mine[1:], want[1:]):
        assert (a[mine[0]] == b[mine[0]]).all()


def test_bits_keep_the_order_of_values():
    v = np.array([-np.inf, -3.5, -1e-40, -0.0, 0.0, 1e-40, 2.0, 2.0, np.inf], np.float32)
    bits = forests._bits(v)
    assert (np.diff(bits) >= 0).all() and ((np.diff(bits) == 0) == (v[1:] == v[:-1])).all() and bits.min() >= 0 and bits.max() < 1 << 32


def test_rows_arrive_where_a_walk_ends():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(500, 6)).astype(np.float32), rng.integers(0, 5, 500)
    (tree,) = forests.grow_trees(x, y, np.ones(5), forests.root_hash(1, np.arange(1)), 3, 2)
    feature, threshold, left, right = tree[:4]
    asked = np.vstack([x, np.full((1, 6), np.nan)]).astype(np.float64)
    leaves = forests._arrive(asked, *forests._linked(feature, left, right), threshold)
    for row, leaf in zip(asked, leaves):
        at = 0
        while feature[at] >= 0:
            at = left[at] if row[feature[at]] <= threshold[at] else right[at]
        assert at == leaf


def test_every_block_has_a_task_of_its_own(spark):
    df = spark.createDataFrame(rows_of(40, 4, runs=3), SCHEMA)
    grown = forests.grow(df, ["run"], trees=16 * 8).withColumn("task", F.spark_partition_id())
    at = {(r["run"], r["block"], r["task"]) for r in grown.select("run", "block", "task").distinct().collect()}
    assert len(at) == 24 and len({t for *_, t in at}) == 24


def test_best_splits_read_only_the_drawn_features(monkeypatch):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(300, 12)).astype(np.float32), rng.integers(0, 5, 300)
    x[:, 3], x[150:] = 1.0, x[:150]
    x[5, 4], x[9, 7] = np.nan, -0.0
    roots = forests.root_hash(5, np.arange(4))
    times = rng.integers(0, 3, (4, 300))
    weight = np.array([1.0, 3.0, 1.5, 12.0, 1.0])
    seen, slow = [], forests._best_split
    monkeypatch.setattr(forests, "_best_split", lambda x, *rest: seen.append(len(x)) or slow(x, *rest))
    mine = forests.grow_trees(x, y, weight, roots, 3, 1, times=times)
    assert sum(seen) < 0.8 * sum(int(n[4][n[0] >= 0].sum()) for n in mine)
    monkeypatch.setattr(forests, "_drawn_best_split", lambda ranks, x, rows, y, starts, at, hashes, w, k, least, times: slow(x[rows], y, starts, at, hashes, w, k, least, times))
    for a, b in zip(mine, forests.grow_trees(x, y, weight, roots, 3, 1, times=times)):
        assert all(np.array_equal(u, v) for u, v in zip(a, b))


def scores_of(df, **kw):
    scored = forests.grow(df, ["run"], weight="weight", target=df.select("run", "beat_id", "features"), **kw)
    return {(r["run"], r["beat_id"]): r["p"] for r in scored.collect()}


@pytest.mark.parametrize("splits", ["random", "best"])
def test_forests_that_score_see_every_row(spark, monkeypatch, splits):
    df = spark.createDataFrame(rows_of(400, 6, runs=2), SCHEMA).repartition(3)
    kw = {"trees": 36, "splits": splits, "min_leaf": 1}
    table = forests.grow(df, ["run"], weight="weight", **kw)
    want = {(r["run"], r["beat_id"]): r["p"] for r in forests.score(table, df.select("run", "beat_id", "features"), ["run"], "beat_id").collect()}
    monkeypatch.setattr(forests, "FIT_ROWS", 100)
    got = scores_of(df, **kw)
    monkeypatch.setattr(forests, "TASKS_A_CORE", 1000)
    split = scores_of(df, **kw)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12) and split[k] == pytest.approx(want[k], abs=1e-12)
    name = {"random": "extra_trees", "best": "random_forest"}[splits]
    part = df.where("run = 0")
    few = {r.beat_id: r.p for r in models.fit_predict(name, part, part, ["run", "seed"], size=0.04).collect()}
    monkeypatch.undo()
    all_ = {r.beat_id: r.p for r in models.fit_predict(name, part, part, ["run", "seed"], size=0.04).collect()}
    assert all(few[k] == pytest.approx(all_[k]) for k in all_)


def test_rows_are_written_once_for_runs_that_are_alike(spark, monkeypatch):
    one = spark.createDataFrame(rows_of(150, 6), SCHEMA)
    both = one.withColumn("mode", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("weight", F.when(F.col("mode") == "b", 1.0).otherwise(F.col("weight")))
    seen, pinned = [], forests.pin
    monkeypatch.setattr(forests, "pin", lambda df: seen.append(df.count()) or pinned(df))
    got = {}
    for alike in (None, ["run"]):
        scored = forests.grow(both, ["run", "mode"], weight="weight", trees=20, target=both.select("run", "mode", "beat_id", "features"), alike=alike)
        got[str(alike)] = {(r["mode"], r["beat_id"]): r["p"] for r in scored.collect()}
    assert seen == [600, 300] and got["None"]["a", 3] != got["None"]["b", 3]
    assert all(p == pytest.approx(got["['run']"][k]) for k, p in got["None"].items())


@pytest.mark.parametrize("times", [False, True])
def test_trees_of_many_rows_equal_those_in_one_piece(monkeypatch, times):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(500, 12)).astype(np.float32), rng.integers(0, 5, 500)
    x[:, 3], x[:, 6], x[250:] = 1.0, np.round(x[:, 6]), x[:250]
    counts = rng.integers(0, 3, (3, 500)) if times else None
    args = (x, y, np.array([1.0, 3.0, 1.5, 12.0, 1.0]), forests.root_hash(5, np.arange(3)), 4, 1, None, counts)
    want = forests.grow_trees(*args)
    monkeypatch.setattr(forests, "CELLS", 64)
    monkeypatch.setattr(forests, "PLACE_BITS", 6)
    monkeypatch.setattr(forests, "IN_MEMORY", 10)
    for a, b in zip(forests.grow_trees(*args), want):
        assert all(np.array_equal(u, v) for u, v in zip(a, b))


def test_draws_of_rows_with_several_ids_differ(spark):
    """A bootstrap by the first id alone counts all rows of a dataset alike."""
    df = spark.createDataFrame(rows_of(200, 4), SCHEMA).withColumn("dataset", F.lit("A"))
    trees = forests.grow(df, ["run"], ["dataset", "beat_id", "absent"], trees=8, splits="best", min_leaf=1)
    assert all(100 < r["rows"][0] < 300 and r["rows"][0] % 200 for r in trees.select("rows").collect())
