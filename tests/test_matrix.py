import numpy as np
import pytest
from pyspark.sql import functions as F

from lacunar.functions import stats
from lacunar.operators import groups, kernels, windows
from lacunar.operators import pca as pca_module
from lacunar.operators.knn import knn_impute
from lacunar.operators.mean import mean_impute
from lacunar.operators.partitioned import group_impute, slide_impute, slide_windows
from lacunar.operators.pca import pca_impute
from lacunar.operators.result import InfeasibleError, show_table
from lacunar.operators.simulate import simulate
from lacunar.operators.tune import compute_metrics, per_column, sample_na_loc, tune
from lacunar.plans import catalogue
from lacunar.plans.params import EigenControl
from lacunar.sources.matrix import from_cells, from_numpy
from lacunar.streaming.batches import impute_stream

NA = np.nan
SF = "/root/testdata/sf0.001"


def filled(m, result):
    return m.with_vectors(result.df).to_numpy()


def small():
    return np.array([[1, 1, 9], [2, 2, 9], [3, 4, 9], [NA, 5, 9]], float)


def test_missing_counts(spark):
    m = from_numpy(spark, np.array([[1, 3, NA], [NA, NA, 6]]), ["a", "b", "c"])
    assert {r["feature"]: r["n_missing"] for r in stats.missing_by_column(m).collect()} == {"a": 1, "b": 1, "c": 1}
    assert {r["sample"]: r["n_missing"] for r in stats.missing_by_row(m).collect()} == {"sample1": 1, "sample2": 2}


@pytest.mark.parametrize("options,want", [({"k": 1}, 5), ({"k": 2}, 7), ({"k": 2, "dist_pow": 1.0}, 754 / 150), ({"k": 2, "dist_pow": 1.0, "method": "manhattan"}, 114 / 22)])
def test_knn_by_hand(spark, options, want):
    m = from_numpy(spark, small(), ["A", "B", "C"])
    assert filled(m, knn_impute(m, **options))[3, 0] == pytest.approx(want)
    assert kernels.knn(small(), **options)[3, 0] == pytest.approx(want)


def test_knn_matches_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 30))
    x[rng.random(x.shape) < 0.2] = NA
    m = from_numpy(spark, x)
    assert np.allclose(filled(m, knn_impute(m, 4, dist_pow=2.0)), kernels.knn(x, 4, dist_pow=2.0))


def test_infinite_and_empty_columns(spark):
    x = small()
    x[0, 1] = np.inf
    with pytest.raises(ValueError):
        knn_impute(from_numpy(spark, x), 1)
    x = small()
    x[:, 0] = NA
    with pytest.raises(ValueError):
        knn_impute(from_numpy(spark, x), 1)
    assert np.isnan(filled(from_numpy(spark, x), mean_impute(from_numpy(spark, x)))[:, 0]).all()


def test_pca_recovers_low_rank():
    rng = np.random.default_rng(2)
    full = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 30)) + 0.01 * rng.normal(size=(40, 30))
    x = full.copy()
    gone = rng.random(x.shape) < 0.15
    x[gone] = NA
    for options in ({}, {"method": "EM"}, {"scale": False}, {"row_w": "n_miss"}, {"nb_init": 2, "seed": 3}):
        out, report = kernels.pca(x, 3, **options)
        assert np.sqrt(((out - full)[gone] ** 2).mean()) < 0.15 * full.std() and report["converged"]
        assert (out[~gone] == x[~gone]).all()
    exact, _ = kernels.pca(x, 3, solver="exact")
    fast, report = kernels.pca(x, 3, solver="lobpcg")
    assert np.abs(exact - fast).max() < 1e-4 and report["n_iterative"] > 0
    assert kernels.pca(x, 3, clamp=(-1, 1))[0][gone].max() <= 1


def test_infeasible():
    x = small()
    x[:3, 0] = [1, NA, NA]
    with pytest.raises(InfeasibleError):
        kernels.knn(x, 2, colmax=0.5)
    with pytest.raises(InfeasibleError):
        kernels.pca(x, 2)


def test_windows():
    line = lambda n: [float(i) for i in range(1, n + 1)]
    assert windows.greedy(line(280), 100, 10) == [(1, 100), (91, 190), (181, 280)]
    assert windows.greedy(line(50), 20, 5) == [(1, 20), (16, 35), (31, 50)]
    found = windows.greedy(line(2000), 50, 5)
    assert len(found) == 45 and found[-1] == (1981, 2000)


def test_flanks(spark):
    m = from_numpy(spark, np.zeros((2, 100)), location=list(range(1, 101)))
    targets = m.vectors.where("col_idx in (5, 20, 95)").select("col_idx")
    got = windows.flanking(m.vectors.select("col_idx", "location"), targets, 5).orderBy("target").collect()
    assert [(r["start"], r["end"], r["subset_local"]) for r in got] == [(1, 10, 5), (15, 25, 6), (90, 100, 6)]


def test_groups_and_policies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 6))
    x[0, :3] = NA
    x[1:, 4] = NA
    m = from_numpy(spark, x, list("abcdef"))
    table = groups.table_of(spark, {"g1": {"feature": list("abc")}, "g2": {"feature": list("def")}})
    demoted = {r["grp"]: (r["feature"], r["aux"]) for r in groups.prepare(m.vectors, table, list("abde")).collect()}
    assert demoted == {"g1": (["a", "b"], ["c"]), "g2": (["d", "e"], ["f"])}
    with pytest.raises(Exception, match="g2"):
        group_impute(m, table, k=1, on_infeasible="error").df.collect()
    out = group_impute(m, table, k=1, on_infeasible="mean")
    got = filled(m, out)
    assert np.allclose(got[:, :3], kernels.knn(x[:, :3], 1)) and np.allclose(got[1:, 4], x[0, 4])
    assert out.fallback() == ["g2"]
    with pytest.raises(ValueError):
        groups.prepare(m.vectors, groups.table_of(spark, {"g1": {"feature": list("abc")}}))


def test_slide_is_the_mean_of_its_windows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(10, 12))
    x[rng.random(x.shape) < 0.2] = NA
    m = from_numpy(spark, x, location=list(range(1, 13)))
    total, count = np.zeros_like(x), np.zeros(12)
    for a, b in windows.greedy([float(i) for i in range(1, 13)], 6, 2):
        total[:, a - 1 : b] += kernels.knn(x[:, a - 1 : b], 2)
        count[a - 1 : b] += 1
    assert np.allclose(filled(m, slide_impute(m, 6, 2, k=2)), total / count)


def test_metrics(spark):
    pairs = spark.createDataFrame([(1, 1, t, e) for t, e in zip((1.0, 2.0, 3.0, 4.0), (1.0, 2.0, 4.0, None))], "param_set int, rep_id int, truth double, estimate double")
    got = {r["metric"]: r["estimate"] for r in compute_metrics(pairs, ("mae", "rmse", "bias", "mape", "rsq", "rsq_trad")).collect()}
    want = {"mae": 1 / 3, "rmse": 0.577350, "bias": 1 / 3, "mape": 11.111111, "rsq": 0.964286, "rsq_trad": 0.5}
    assert got == pytest.approx(want, abs=1e-5)


def test_sampling_and_tuning(spark):
    assert per_column(12, 3) == [3, 3, 3, 3] and per_column(13, 3) == [3, 3, 3, 4] and per_column(11, 3) == [3, 4, 4] and per_column(5, 3) == [5]
    sim = simulate(spark, 20, 15, perc_total_na=0.05)
    x = sim.matrix.to_numpy()
    assert np.isnan(x).sum() == 15 and sim.summary(2).startswith("20 samples, 15 features, 5.0% missing\n2 groups of features, 1 of samples\nfeature1: [")
    cells = sample_na_loc(sim.matrix, num_na=12, n_rows=3, n_reps=2)
    rows = cells.collect()
    assert len(rows) == 24 and not any(np.isnan(x[r["row_idx"] - 1, r["col_idx"] - 1]) for r in rows)
    got = tune(sim.matrix, [{"k": 2}, {"k": 50}], "knn_imp", cells).collect()
    assert [(r["param_set"], len(r["result"])) for r in got if r["rep_id"] == 1] == [(1, 12), (2, 0)]


def test_repeated_cells_and_labels(spark):
    rows = [(2, "b", 1.0), (2, "b", 4.0), (1, "a", NA), (1, "a", 3.0), (3, "a", None), (None, "a", 9.0), (1, None, 9.0)]
    m = from_cells(spark.createDataFrame(rows, "sample long, feature string, value double"))
    assert m.samples == [1, 2, 3]
    assert np.array_equal(m.to_numpy(), [[3, NA], [NA, 4], [NA, NA]], equal_nan=True)
    assert {(r["sample"], r["feature"]): r["value"] for r in m.cells().collect() if r["value"] is not None} == {(1, "a"): 3, (2, "b"): 4}
    assert from_cells(spark.createDataFrame([], "sample long, feature string, value double")).vectors.count() == 0


def plain_pca(x, ncp, method="regularized", scale=True, w=None, threshold=1e-6):
    """Iterated PCA by full singular value decompositions, with nothing in common with the kernels."""
    n, p = x.shape
    w = np.ones(n) / n if w is None else np.asarray(w) / np.sum(w)
    gone = np.isnan(x)
    full, old, fit = x.copy(), np.inf, None
    for j in range(p):
        full[gone[:, j], j] = np.average(x[~gone[:, j], j], weights=w[~gone[:, j]])
    mu = np.array([np.average(x[~gone[:, j], j], weights=w[~gone[:, j]]) for j in range(p)])
    sd = np.array([np.sqrt(np.average((x[~gone[:, j], j] - mu[j]) ** 2, weights=w[~gone[:, j]])) for j in range(p)]) if scale else np.ones(p)
    for it in range(1, 1001):
        if fit is not None:
            full = np.where(gone, fit * sd + mu, full)
            mu = w @ full
            sd = np.sqrt(w @ (full - mu) ** 2) if scale else np.ones(p)
        z = (full - mu) / sd
        u, s, v = np.linalg.svd(np.sqrt(w)[:, None] * z, full_matrices=False)
        rest = (s[ncp:] ** 2).sum()
        noise = 0
        if method == "regularized":
            noise = min(n * p / min(p, n - 1) * rest / ((p - ncp) * (n - 1 - ncp)), s[ncp] ** 2)
        fit = (u[:, :ncp] * (s[:ncp] - noise / s[:ncp])) @ v[:ncp] / np.sqrt(w)[:, None]
        goal = (w[:, None] * (z - fit) ** 2)[~gone].sum()
        if it >= 5 and abs(1 - goal / old) < threshold:
            break
        old = goal
    return full


PCA_QUERIES = {"pca_regularized": {}, "pca_em": {"method": "EM"}, "pca_noscale": {"scale": False}, "pca_clamp": {}, "pca_rowweights": {"weighted": True}}


@pytest.mark.parametrize("name", PCA_QUERIES)
def test_pca_queries(spark, name):
    options = dict(PCA_QUERIES[name])
    m = catalogue.user_days(spark, SF)
    x = m.to_numpy()
    names = [r["feature"] for r in m.vectors.orderBy("col_idx").select("feature").collect()]
    w = 1 - np.isnan(x).mean(1) if options.pop("weighted", False) else None
    want = plain_pca(x, 2, w=w, **options)
    if name == "pca_clamp":
        want = np.where(np.isnan(x), np.clip(want, 0, 40), x)
    got = {(r["sample"], r["feature"]): r["value"] for r in catalogue.queries()[name](spark, SF).collect()}
    assert len(got) == x.size
    assert np.allclose([[got[s, f] for f in names] for s in m.samples], want, atol=1e-4)


def test_pca_of_windows(spark):
    m = catalogue.user_days(spark, SF)
    x = m.to_numpy()
    names = [r["feature"] for r in m.vectors.orderBy("col_idx").select("feature").collect()]
    total, count = np.zeros_like(x), np.zeros(x.shape[1])
    for a, b in windows.greedy([float(f[1:]) for f in names], 10, 4):
        total[:, a - 1 : b] += plain_pca(x[:, a - 1 : b], 2)
        count[a - 1 : b] += 1
    got = {(r["sample"], r["feature"]): r["value"] for r in catalogue.queries()["slide_pca"](spark, SF).collect()}
    assert np.allclose([[got[s, f] for f in names] for s in m.samples], total / count, atol=1e-4)


def test_pca_of_groups(spark):
    d = SF.replace("0.001", "0.01")
    m = catalogue.user_types(spark, d)
    x = m.to_numpy()
    names = [r["feature"] for r in m.vectors.orderBy("col_idx").select("feature").collect()]
    got = {(r["sample"], r["feature"]): r["value"] for r in catalogue.queries()["group_pca"](spark, d).collect()}
    kind = np.array([f.split("_")[0] for f in names])
    for k in set(kind):
        part = x[:, kind == k]
        assert np.isnan(part).mean(0).max() <= 0.9
        mine = [[got[s, f] for f in np.array(names)[kind == k]] for s in m.samples]
        assert np.allclose(mine, plain_pca(part, 2), atol=2e-3)


@pytest.mark.parametrize("options", [{}, {"method": "EM", "scale": False}, {"row_w": "n_miss", "clamp": (-1, 1), "colmax": 0.5}])
def test_pca_by_feature(spark, monkeypatch, options):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8, 3)) @ rng.normal(size=(3, 40)) + 0.1 * rng.normal(size=(8, 40))
    x[rng.random(x.shape) < 0.15] = NA
    x[:6, 7] = NA
    x[:, 9] = 1.5
    m = from_numpy(spark, x)
    one = filled(m, pca_impute(m, 2, **options))
    monkeypatch.setattr(pca_module, "ONE_TASK", 1)
    wide = pca_impute(m, 2, **options)
    assert np.allclose(filled(m, wide), one, atol=1e-6) and wide.report["converged"]


def test_solver_options_reach_the_task(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 24))
    x[rng.random(x.shape) < 0.1] = NA
    m = from_numpy(spark, x, location=list(range(24)))
    plain = filled(m, pca_impute(m, 2))
    for eigen in (EigenControl(), EigenControl(2, 1e-10, 30)):
        assert np.allclose(filled(m, pca_impute(m, 2, eigen=eigen, solver="lobpcg")), plain, atol=1e-4)
    assert np.allclose(filled(m, pca_impute(m, 2, row_w=np.ones(30))), plain)
    table = groups.table_of(spark, {"g1": {"feature": [f"feature{i}" for i in range(1, 25)]}})
    assert np.allclose(filled(m, group_impute(m, table, ncp=2, eigen=EigenControl())), plain)
    assert not np.isnan(filled(m, slide_impute(m, 12, ncp=2, eigen=EigenControl(), row_w=np.ones(30)))).any()
    with pytest.raises(ValueError):
        EigenControl(tol=0)
    with pytest.raises(ValueError):
        pca_impute(m, 2, eigen=EigenControl(maxiter=0), solver="lobpcg")
    with pytest.raises(ValueError):
        pca_impute(m, 2, seed=1 << 30, nb_init=4)
    with pytest.warns(UserWarning, match="convergence"):
        assert not pca_impute(m, 2, maxiter=5, miniter=5, threshold=0.0).report["converged"]


def test_automatic_solver(monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 30)) + 0.05 * rng.normal(size=(40, 30))
    x[rng.random(x.shape) < 0.15] = NA
    exact, report = kernels.pca(x, 2, solver="exact")
    monkeypatch.setattr(kernels, "LEAST_GRAM", 10)
    auto, chosen = kernels.pca(x, 2)
    assert np.allclose(auto, exact, atol=1e-4) and chosen["n_iterative"] > 0
    monkeypatch.setattr(kernels, "FASTER", 0.0)
    auto, chosen = kernels.pca(x, 2, nb_init=2, seed=1)
    assert np.allclose(auto, exact, atol=1e-3) and chosen["solver"] == "exact"


def test_argument_checks(spark):
    m = from_numpy(spark, small(), ["A", "B", "C"])
    with pytest.raises(ValueError) as e:
        knn_impute(m, 3)
    assert not isinstance(e.value, InfeasibleError)
    with pytest.raises(ValueError):
        mean_impute(m, [1, 9])
    with pytest.warns(UserWarning):
        assert filled(m, mean_impute(m, ["A", "Z"]))[3, 0] == 2
    full = from_numpy(spark, np.arange(12.0).reshape(4, 3))
    assert knn_impute(full, 1).method == "none"


def test_group_tables(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(10, 12))
    x[0, :6] = NA
    names = [f"f{i:02d}" for i in range(12)]
    m = from_numpy(spark, x, names)
    long = spark.createDataFrame([("a", n) for n in names[:3]] + [("b", n) for n in names[3:6]] + [("b", "unknown"), ("c", "gone")], "grp string, feature string")
    with pytest.raises(ValueError):
        groups.prepare(m.vectors, long)
    table = groups.prepare(m.vectors, long, allow_unmapped=True, min_group_size=6, seed=3)
    got = {r["grp"]: r for r in table.collect()}
    assert set(got) == {"a", "b"} and got["b"]["feature"] == names[3:6]
    for g, own in (("a", names[:3]), ("b", names[3:6])):
        assert got[g]["feature"] == own and len(set(got[g]["aux"])) == 3 and not set(got[g]["aux"]) & set(own) and set(got[g]["aux"]) <= set(names)
    assert sorted(map(str, table.collect())) == sorted(map(str, groups.prepare(m.vectors, long, allow_unmapped=True, min_group_size=6, seed=3).collect()))
    with pytest.raises(ValueError):
        groups.prepare(m.vectors, long, allow_unmapped=True, min_group_size=13)
    with pytest.raises(ValueError):
        groups.prepare(m.vectors, groups.table_of(spark, {"a": {"feature": names}, "b": {"feature": names[:1]}}))
    groups.register("platform", long)
    assert groups.resolve("platform").count() == 8
    with pytest.raises(ValueError):
        groups.resolve("nothing")
    with pytest.warns(UserWarning):
        groups.nested(spark.createDataFrame([(1.5, "f00")], "grp double, feature string"))
    own = groups.table_of(spark, {"a": {"feature": names[:3], "aux": names[6:8] + names[:1], "parameters": {"k": 1}}, "b": {"feature": names[3:6], "aux": names[8:]}})
    out = filled(m, group_impute(m, own, allow_unmapped=True, k=4))
    a, b = [0, 1, 2, 6, 7], [3, 4, 5, 8, 9, 10, 11]
    assert np.allclose(out[:, :3], kernels.knn(x[:, a], 1, np.arange(3))[:, :3]) and np.allclose(out[:, 3:6], kernels.knn(x[:, b], 4, np.arange(3))[:, :3])
    with pytest.warns(UserWarning, match="lowered"):
        group_impute(m, own, allow_unmapped=True, k=40).df.count()
    with pytest.raises(ValueError):
        group_impute(m, groups.table_of(spark, {"a": {"feature": names[:6], "parameters": {"k": 2}}, "b": {"feature": names[6:], "parameters": {"ncp": 2}}}))


def test_window_policies(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(12, 30))
    x[rng.random(x.shape) < 0.1] = NA
    x[:, :8] = NA
    x[0, :8] = 1.0
    m = from_numpy(spark, x, location=list(range(1, 31)))
    skipped = slide_impute(m, 10, 4, k=2, min_window_n=4)
    out = filled(m, skipped)
    assert np.isnan(out[1:, :6]).all() and skipped.has_remaining_na() and skipped.fallback() == ["1"]
    # columns 7 and 8 are in a window that works, which counts alone
    assert np.allclose(out[:, 8:10], np.mean([kernels.knn(x[:, 6:16], 2)[:, 2:4]], 0))
    mean = slide_impute(m, 10, 4, k=2, on_infeasible="mean")
    assert np.allclose(filled(m, mean)[:, :6], 1.0) and mean.fallback() == ["1"] and "Fallback" in mean.summary()
    with pytest.raises(Exception, match="1"):
        slide_impute(m, 10, 4, k=2, on_infeasible="error").df.collect()
    with pytest.raises(ValueError):
        slide_impute(m, 10, 4, k=4, min_window_n=4)
    with pytest.raises(ValueError):
        slide_impute(m, 10, 4, k=2, flank=True)
    with pytest.raises(ValueError):
        slide_windows(m, 10, min_window_n=40)
    assert [r["window_n"] for r in slide_windows(m, 8, min_window_n=7).collect()] == [8, 8, 8]
    w = slide_windows(m, 10, 4)
    assert [(r["start"], r["end"]) for r in windows.overlap_regions(w).orderBy("start").collect()] == [(7, 10), (13, 16), (19, 22), (25, 28)]
    raw = slide_impute(m, 10, 4, k=2, post_imp=False)
    kept = filled(m, raw)
    for a, b in windows.greedy([float(i) for i in range(1, 31)], 10, 4)[1:]:
        own = kernels.knn(x[:, a - 1 : b], 2, post_imp=False)
        assert (np.isnan(kept[:, a - 1 : b]) | ~np.isnan(own)).all()  # one missing contribution leaves the cell missing


def test_tuning_with_lists_and_functions(spark):
    sim = simulate(spark, 12, 8, perc_total_na=0.05)

    def weighted(m, weights, shift=0.0):
        return m.with_vectors(m.vectors.withColumn("vals", F.transform("vals", lambda v: F.coalesce(v, F.lit(float(sum(weights)) + shift)))))

    cells = sample_na_loc(sim.matrix, num_na=6, n_rows=2, n_reps=2)
    got = tune(sim.matrix, [{"weights": [0.25, 0.5]}, {"weights": [1.0], "shift": 2}, {"weights": [0.25, 0.5]}], weighted, cells)
    rows = {(r["param_set"], r["rep_id"]): r for r in got.collect()}
    assert set(rows) == {(1, 1), (1, 2), (2, 1), (2, 2)} and rows[1, 1]["weights"] == [0.25, 0.5] and rows[2, 2]["shift"] == 2 and rows[1, 2]["shift"] is None
    assert {p["estimate"] for p in rows[1, 1]["result"]} == {0.75} and {p["estimate"] for p in rows[2, 1]["result"]} == {3.0}
    for bad in (lambda m: m, lambda m, weights: m.vectors, lambda m, weights: m.with_vectors(m.vectors.limit(3)), lambda m, weights: weighted(m, [float("inf")])):
        with pytest.raises(ValueError):
            tune(sim.matrix, [{"weights": [1.0]}], bad, cells)
    for method, p in (("knn_imp", {}), ("slide_imp", {"k": 2}), ("knn_imp", {"k": 2, "subset": ["a"]}), ("pca_imp", {"ncp": 1, "k": 2})):
        with pytest.raises(ValueError):
            tune(sim.matrix, [p], method, cells)
    with pytest.raises(ValueError):
        tune(sim.matrix, [{"k": 2}], "knn_imp", cells.withColumn("row_idx", F.col("row_idx") + 100))
    with pytest.raises(ValueError):
        tune(sim.matrix, [{"k": 2}], "knn_imp", cells.where("rep_id = 1 or ord > 1"))
    by_position = tune(sim.matrix, [{"k": 2}], "knn_imp", [[1, 2, 14], [3, 15, 16]])
    assert by_position.count() == 2 and show_table(by_position, 1).endswith("<3>  None\n...")


def test_sampled_cells_leave_room(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(10, 40))
    x[rng.random(x.shape) < 0.2] = NA
    cells = sample_na_loc(from_numpy(spark, x), num_na=60, n_rows=3, n_reps=3, rowmax=0.6, colmax=0.6).collect()
    for rep in (1, 2, 3):
        mine = [(r["row_idx"] - 1, r["col_idx"] - 1) for r in cells if r["rep_id"] == rep]
        hid = x.copy()
        for i, j in mine:
            assert not np.isnan(x[i, j])
            hid[i, j] = NA
        assert len(set(mine)) == 60 and np.isnan(hid).mean(0).max() <= 0.6 and np.isnan(hid).mean(1).max() <= 0.6
        assert all(len(set(c[~np.isnan(c)])) > 1 for c in hid.T)
    with pytest.raises(ValueError):
        sample_na_loc(from_numpy(spark, x), num_na=399, n_rows=9)


def test_stream_of_cells(spark, tmp_path):
    source = tmp_path / "in"
    cells = [("s1", "a", 1.0), ("s2", "a", 3.0), ("s1", "b", 5.0), ("s2", "b", None)]
    spark.createDataFrame(cells, "sample string, feature string, value double").write.parquet(str(source))
    for more in ([], [("s2", "b", 7.0)]):
        if more:
            spark.createDataFrame(more, "sample string, feature string, value double").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("sample string, feature string, value double").parquet(str(source))
        impute_stream(stream, str(tmp_path / "table"), str(tmp_path / "out"), mean_impute, str(tmp_path / "state")).awaitTermination()
        got = {r["feature"]: r["vals"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == {"a": [1.0, 3.0], "b": [5.0, 7.0 if more else 5.0]}


def test_cells_of_many_samples_are_tuned(spark, tmp_path):
    """More samples than an int holds hundred thousands of."""
    n = 22_000
    days = ", ".join(f"timestamp'2024-01-{d:02d}'" for d in (1, 2, 3, 4))
    events = spark.range(n).select(F.col("id").alias("user_id"), F.explode(F.expr(f"array({days})")).alias("ts")).withColumn("value", (F.col("user_id") * 7 + F.dayofmonth("ts") * 3) % 101 + F.lit(0.5))
    events.write.parquet(f"{tmp_path}/events.parquet")
    hidden = lambda i, j: pow(h := (i * 7385 + j * 1934 + 1) % 10007, 3) + 17 * h
    errors = [10.0 - ((i * 7 + (j + 1) * 3) % 101 + 0.5) for i in range(n) for j in range(4) if hidden(i, j) % 997 < 100]
    got = {r["metric"]: (r["n"], r["n_miss"], r["estimate"]) for r in catalogue.tune_custom(spark, str(tmp_path)).collect()}
    assert got == {"mae": (len(errors), 0, pytest.approx(np.abs(errors).mean(), abs=1e-6)), "rmse": (len(errors), 0, pytest.approx(np.sqrt(np.square(errors).mean()), abs=1e-6))}
    m = catalogue.user_days(spark, str(tmp_path))
    pairs = tune(m, [{"k": 1}], "knn_imp", catalogue.deterministic_cells(m, 1)).first()
    assert pairs["error"] is None and len(pairs["result"]) == len(errors) and all(p["estimate"] is not None for p in pairs["result"])
