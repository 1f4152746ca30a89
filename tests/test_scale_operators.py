"""Prefix sums, quantiles, kNN and target statistics against plain computations, on skewed and larger inputs."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quietab.operators import knn, quantiles
from quietab.operators.quantiles import exact_quantiles, grouped_quantiles
from quietab.operators.rank import running_totals
from quietab.operators.target_stats import ordered_statistics


@pytest.mark.parametrize("parts", [1, 3, 13])
def test_running_totals_of_skewed_groups(spark, parts):
    df = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then null when id % 3 = 1 then 'hot' else cast(id % 40 as string) end as g",
                                      "id % 50 as o", "case when id % 11 = 0 then null else id end as v", "cast(id as double) / 7 as d",
                                      "case when id % 2 = 0 then double('NaN') else -0.0 end as f")
    got = running_totals(df, ["o", "id"], {"cum": F.col("v"), "dcum": F.col("d")}, by=["g", "f"], buckets=parts)
    w = Window.partitionBy("g", "f").orderBy("o", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"cum": F.sum(F.coalesce("v", F.lit(0))).over(upto), "dcum": F.sum("d").over(upto),
                           "rank": F.row_number().over(w).cast("long")})
    a = {r["id"]: r for r in got.collect()}
    for r in want.collect():
        assert (a[r["id"]]["cum"], a[r["id"]]["rank"], a[r["id"]]["v"]) == (r["cum"], r["rank"], r["v"])
        assert a[r["id"]]["dcum"] == pytest.approx(r["dcum"], rel=1e-12)
    before = running_totals(df, ["o", "id"], {"cum": F.col("v")}, by=["g"], buckets=parts, inclusive=False, rank_col=None)
    assert before.columns == [*df.columns, "cum"]
    first = before.where("g = 'hot'").orderBy("o", "id").first()
    assert first["cum"] == 0
    assert running_totals(df.limit(0), ["o"], {"cum": F.col("v")}, by=["g"]).count() == 0


def test_running_totals_of_ten_million_rows_with_a_hot_value(spark):
    n = 10_000_000
    df = spark.range(n).selectExpr("id", "case when id % 3 = 0 then 0 else id % 1000003 end as o")
    got = running_totals(df, ["o", "id"], {"cum": F.lit(1).cast("long")}, rank_col="rk")
    r = got.agg(F.sum(F.col("rk").cast("decimal(38,0)")), F.max("rk"), F.count(F.lit(1)), F.sum((F.col("rk") != F.col("cum")).cast("int"))).first()
    assert int(r[0]) == n * (n + 1) // 2 and r[1] == n and r[2] == n and r[3] == 0
    spread = got.where("o = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread >= 2  # the hot value is not one task's


def test_quantiles_refine_until_they_fit(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.normal(size=6000), np.full(4000, 0.25), [np.inf, -np.inf, -0.0, 0.0]])
    b = np.concatenate([rng.integers(0, 40, 10_000).astype(float), rng.exponential(size=4)])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(5)
    df = df.unionByName(spark.createDataFrame([(None, float("nan")), (float("nan"), None)], "a double, b double"))
    probs = np.linspace(0, 1, 61).tolist()[1:-1]
    want = {c: np.quantile(x, probs) for c, x in (("a", a[np.isfinite(a)] if False else a), ("b", b))}
    for fetch, accuracies in ((1_000_000, (10_000, 100_000)), (400, (50, 100)), (15, (20, 20))):
        monkeypatch.setattr(quantiles, "FETCH_ROWS", fetch)
        monkeypatch.setattr(quantiles, "ACCURACIES", accuracies)
        monkeypatch.setattr(quantiles, "GRID", 8)
        got = exact_quantiles(df, {"a": probs, "b": probs}, {"a": len(a), "b": len(b)})
        for c in "ab":
            assert np.allclose(got[c], want[c], rtol=0, atol=1e-12), (fetch, c)


def test_quantiles_shuffle_no_value_outside_a_bracket(spark, monkeypatch):
    seen = []
    plain = quantiles._scan

    def counted(df, edges, wanted):
        out = plain(df, edges, wanted)
        seen.append(sum(len(v[1]) for v in out.values()))
        return out

    monkeypatch.setattr(quantiles, "_scan", counted)
    df = spark.range(200_000).selectExpr("cast(hash(id) as double) as v")
    got = exact_quantiles(df, {"v": [0.25, 0.5, 0.75]}, {"v": 200_000})["v"]
    want = np.quantile([r["v"] for r in df.collect()], [0.25, 0.5, 0.75])
    assert np.allclose(got, want) and len(seen) == 1 and seen[0] < 2000


def test_grouped_quantiles_with_null_groups_and_extras(spark):
    rng = np.random.default_rng(9)
    rows = [(None if i % 4 == 0 else int(i % 3), float(v) if i % 17 else None) for i, v in enumerate(rng.normal(size=9000))]
    df = spark.createDataFrame([*rows, (77, None), (78, 5.0)], "g int, v double")
    out = {r["g"]: r for r in grouped_quantiles(df, "v", ["g"], [0.1, 0.5], ["lo", "mid"], {"n": F.count("v"), "top": F.max("v")},
                                                accuracy=200).collect()}
    for g in (None, 0, 1, 2, 78):
        vals = [v for k, v in [*rows, (78, 5.0)] if k == g and v is not None]
        assert out[g]["n"] == len(vals) and out[g]["top"] == max(vals)
        assert out[g]["lo"] == pytest.approx(np.quantile(vals, 0.1), abs=1e-12)
        assert out[g]["mid"] == pytest.approx(np.quantile(vals, 0.5), abs=1e-12)
    assert out[77]["mid"] is None and out[77]["n"] == 0


def _clusters(n, dim, seed, centres=12, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("exclude", [False, True])
def test_pruned_knn_equals_all_pairs(spark, monkeypatch, exclude):
    vectors = np.round(_clusters(900, 6, 3), 3)
    vectors[700:760] = vectors[0]  # copies: ties by key
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, features array<double>")
    query = df if exclude else df.where("id % 3 = 0").withColumn("id", F.col("id") + 10_000)
    blocks = knn.knn_join(query, df, 4, exclude_self=exclude, block_rows=40, method="blocks")
    want = sorted((r["q_key"], r["rank"], r["r_key"], r["dist"]) for r in blocks.collect())
    got = knn.knn_join(query, df, 4, exclude_self=exclude, block_rows=40, method="cells")
    assert sorted((r["q_key"], r["rank"], r["r_key"], r["dist"]) for r in got.collect()) == want


def test_pruning_shuffles_few_rows(spark, monkeypatch):
    vectors = _clusters(6000, 8, 1, centres=60, spread=0.02)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, features array<double>")
    asked = []
    plain = knn._visit_counts
    monkeypatch.setattr(knn, "_visit_counts", lambda q, shared: asked.append(plain(q, shared)) or asked[-1])
    r = knn.knn_join(df, df, 5, exclude_self=True, block_rows=100)
    assert r.count() == 30_000
    visits = int(asked[0].sum())
    assert visits < 0.2 * 6000 * 60  # query rows sent on, against |Q| Br


def test_unstructured_vectors_fall_back_to_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 40)))], "id long, features array<double>")
    taken = []
    plain = knn._by_blocks
    monkeypatch.setattr(knn, "_by_blocks", lambda *a: taken.append(1) or plain(*a))
    assert knn.knn_join(df, df, 3, exclude_self=True, block_rows=60).count() == 1800
    assert taken


def test_ordered_statistics_of_a_wide_and_a_hot_column(spark):
    n = 12_000
    df = spark.range(n).selectExpr("id", "concat('v', cast(id % 5000 as string)) as wide",
                                   "case when id % 3 = 0 then 'hot' when id % 3 = 1 then null else cast(id % 9 as string) end as c",
                                   "cast(id * 7 % 5 < 2 as int) as y")
    rows, stats = ordered_statistics(df, ["wide", "c"], "y", "id", seed=5, weight=2.0)
    from quietab.functions.rand import u
    order = df.withColumn("u", u(5, F.col("id"), "order")).orderBy("u", "id").collect()
    prior = sum(r["y"] for r in order) / n
    got = {r["id"]: r for r in rows.collect()}
    for c in ("wide", "c"):
        sums: dict = {}
        for r in order:
            s, k = sums.get(r[c], (0, 0))
            assert got[r["id"]][f"{c}__ts1"] == pytest.approx((s + 2 * prior) / (k + 2))
            sums[r[c]] = (s + r["y"], k + 1)
        other = spark.createDataFrame([(1, "v3", "hot"), (2, "new", None), (3, None, "new")], "id long, wide string, c string")
        for r in stats.apply(other).collect():
            s, k = sums.get(r[c], (0, 0))
            assert r[f"{c}__ts1"] == pytest.approx((s + 2 * prior) / (k + 2))


def test_trees_fit_a_column_of_many_values(spark):
    from quietab.operators.label import LabelModel
    from quietab.plans.evaluate import evaluate_raw
    from quietab.spec import TableSpec
    df = spark.range(30_000).selectExpr("id", "concat('user', cast(id % 10000 as string)) as who", "cast(id % 11 as double) as v",
                                        "case when id % 10000 < 4000 then 'yes' else 'no' end as y")
    spec = TableSpec(("v",), ("who",), "y", ("id",))
    lab = LabelModel.fit(df, "y", "binclass")
    m = evaluate_raw(df.where("id < 20000"), df.where("id >= 20000 and id % 2 = 0"), df.where("id >= 20000 and id % 2 = 1"), spec, lab, ("tree",), key="id")
    auc = {r["split"]: r["value"] for r in m.where("metric = 'roc_auc'").collect()}
    assert auc["test"] > 0.95  # the column tells the label of a value seen before


def test_cells_without_structure_send_no_copies(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 40))
    v[600:] = v[5]  # one large group of copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, features array<double>")

    def sent(*_):
        raise AssertionError("a copy of each query row is sent to every cell")

    monkeypatch.setattr(knn, "_visiting", sent)
    got = knn.knn_join(df, df, 3, exclude_self=True, block_rows=50, method="cells")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1, int(j)) for i in range(700) for r, j in enumerate(np.lexsort((np.arange(700), d[i]))[:3])}
    assert {(r["q_key"], r["rank"], r["r_key"]) for r in got.collect()} == want


def test_cells_are_found_by_descent_and_hold_every_near_row():
    rng = np.random.default_rng(4)
    ref, query = rng.integers(0, 30, (4000, 3)).astype(float), rng.uniform(-3, 33, (200, 3))
    cells = knn.Cells(ref[:1000], 64)
    own = cells.find(ref)
    low, high = (np.array([f(ref[own == c], 0) for c in range(len(cells.counts))]) for f in (np.min, np.max))
    cells.measure(np.bincount(own, minlength=len(cells.counts)), low, high)
    bound = rng.uniform(0, 6, 200)
    at = cells.find(query)
    i, c = cells.visits(query, at, bound)
    seen = set(zip(i.tolist(), c.tolist())) | set(enumerate(at.tolist()))
    near = np.sqrt(((query[:, None] - ref[None]) ** 2).sum(2)) <= bound[:, None]
    assert all((a, own[b]) in seen for a, b in zip(*np.nonzero(near)))
    assert len(i) < 0.5 * 200 * 64
