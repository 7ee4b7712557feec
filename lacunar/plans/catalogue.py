"""The registered queries over the driver's tables, and the same in SQL.

U: users by day of events' mean value. G: users by event type and day, grouped by type. E: embeddings with
cells masked by a fixed rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.functions import stats
from lacunar.operators import groups, windows
from lacunar.operators.knn import knn_impute, neighbours
from lacunar.operators.mean import mean_impute
from lacunar.operators.partitioned import group_impute, slide_impute, slide_windows
from lacunar.operators.pca import pca_impute
from lacunar.operators.simulate import simulate
from lacunar.operators.tune import compute_metrics, masked, sample_na_loc, tune
from lacunar.sources.matrix import Matrix, from_cells

Query = Callable[[SparkSession, str], DataFrame]
HALF = [f"d{i:02d}" for i in range(1, 16)]


def user_days(spark: SparkSession, sf_dir: str) -> Matrix:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.dayofmonth("ts")
    cells = e.groupBy(F.col("user_id").alias("sample"), day.alias("location")).agg(F.avg("value").alias("value"))
    return from_cells(cells.withColumn("feature", F.format_string("d%02d", F.col("location"))), location="location")


def user_types(spark: SparkSession, sf_dir: str) -> Matrix:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.format_string("%s_%02d", F.col("event_type"), F.dayofmonth("ts"))
    return from_cells(e.groupBy(F.col("user_id").alias("sample"), name.alias("feature")).agg(F.avg("value").alias("value")))


def holed_days(spark: SparkSession, sf_dir: str) -> Matrix:
    """User days of which the first twelve have few users left."""
    m = user_days(spark, sf_dir)
    vals = F.transform("vals", lambda v, i: F.when((F.col("location") > 12) | (i % 20 == 0), v))
    return m.with_vectors(m.vectors.withColumn("vals", vals))


def holed_types(spark: SparkSession, sf_dir: str) -> Matrix:
    """User types of which one has few users left."""
    m = user_types(spark, sf_dir)
    vals = F.transform("vals", lambda v, i: F.when(~F.col("feature").startswith("purchase_") | (i % 5 == 0), v))
    return m.with_vectors(m.vectors.withColumn("vals", vals))


def masked_embeddings(spark: SparkSession, sf_dir: str) -> Matrix:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("dim", "v"))
    h = (F.col("vec_id") * 7385 + F.col("dim") * 1934 + 1) % 10007
    value = F.when(~((h * h * h + 17 * h) % 997 < 100), F.col("v").cast("double"))
    return from_cells(e.select(F.col("vec_id").alias("sample"), F.format_string("e%02d", F.col("dim")).alias("feature"), value.alias("value"), F.col("dim").alias("location")), location="location")


def cells_of(m: Matrix) -> DataFrame:
    return m.cells().select("sample", "feature", F.round("value", 6).alias("value"))


def completed(make: Callable[[SparkSession, str], Matrix], call: Callable) -> Query:
    return lambda spark, d: cells_of((m := make(spark, d)).with_vectors(call(m).df))


def type_groups(m: Matrix) -> DataFrame:
    return m.vectors.select(F.substring_index("feature", "_", 1).alias("grp"), "feature")


def aux_groups(m: Matrix) -> DataFrame:
    """Two groups that lend each other features, one with parameters of its own."""
    names = lambda kind, last: [f"{kind}_{i:02d}" for i in range(1, last + 1)]
    return groups.table_of(m.vectors.sparkSession, {"a": {"feature": names("click", 12), "aux": names("view", 6), "parameters": {"k": 2}}, "b": {"feature": names("view", 8), "aux": names("click", 4)}})


def deterministic_cells(m: Matrix, reps: int) -> DataFrame:
    out = None
    for rep in range(reps):
        h = ((F.col("row_idx") - 1).cast("long") * 7385 + (F.col("col_idx") - 1) * 1934 + rep * 834 + 1) % 10007
        part = m.cells().where(F.col("value").isNotNull() & ((h * h * h + 17 * h) % 997 < 100)).select(F.lit(rep + 1).alias("rep_id"), (F.col("row_idx").cast("long") * 100_000 + F.col("col_idx")).alias("ord"), "row_idx", "col_idx")
        out = part if out is None else out.unionByName(part)
    return out


def metric_pairs(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select((F.col("o_custkey") % 3).cast("int").alias("param_set"), (F.col("o_orderkey") % 2).cast("int").alias("rep_id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice").cast("double")).alias("truth"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice").cast("double") * 0.9 + 100).alias("estimate"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return compute_metrics(metric_pairs(spark, d), ("mae", "rmse", "bias", "mape", "rsq", "rsq_trad")).select("param_set", "rep_id", "n", "n_miss", "metric", F.round("estimate", 4).alias("estimate"))


def tune_grid(spark: SparkSession, d: str) -> DataFrame:
    m = user_days(spark, d)
    got = tune(m, [{"k": 3}, {"k": 8}], "knn_imp", deterministic_cells(m, 1))
    return compute_metrics(got).select("param_set", "rep_id", "n", "n_miss", "metric", F.round("estimate", 6).alias("estimate"))


def custom_fill(m: Matrix, value: float = 0.0) -> Matrix:
    return m.with_vectors(m.vectors.withColumn("vals", F.transform("vals", lambda v: F.coalesce(v, F.lit(value)))))


def tune_custom(spark: SparkSession, d: str) -> DataFrame:
    m = user_days(spark, d)
    got = tune(m, [{"value": 10.0}], custom_fill, deterministic_cells(m, 1))
    return compute_metrics(got).select("param_set", "rep_id", "n", "n_miss", "metric", F.round("estimate", 6).alias("estimate"))


def neighbour_table(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(user_days(spark, d), 5).select("target", "col_idx", "rank", F.round("dist", 6).alias("dist"))


def group_table(subset: list[str] | None = None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        m = user_types(spark, d)
        t = groups.prepare(m.vectors, type_groups(m), subset)
        return t.select("grp", F.explode("feature").alias("feature"), F.lit("feature").alias("role")).unionByName(t.select("grp", F.explode("aux").alias("feature"), F.lit("aux").alias("role")))

    return run


def window_table(**options) -> Query:
    return lambda spark, d: slide_windows(user_days(spark, d), **options)


def covered(spark: SparkSession, d: str) -> DataFrame:
    return windows.coverage(slide_windows(user_days(spark, d), 10, 4)).select("col_idx", "n_windows")


def overlapping(spark: SparkSession, d: str) -> DataFrame:
    return windows.overlap_regions(slide_windows(user_days(spark, d), 10, 4))


def variances(spark: SparkSession, d: str) -> DataFrame:
    return stats.column_variances(user_days(spark, d)).select("feature", F.round("variance", 6).alias("variance"))


def ranges(spark: SparkSession, d: str) -> DataFrame:
    return stats.column_ranges(user_days(spark, d)).select("feature", F.round("min_value", 6).alias("min_value"), F.round("max_value", 6).alias("max_value"))


def simulated(spark: SparkSession, d: str) -> DataFrame:
    return cells_of(simulate(spark, 50, 40).matrix)


def sampled(spark: SparkSession, d: str) -> DataFrame:
    return sample_na_loc(user_days(spark, d), num_na=60, n_rows=2, n_reps=3)


def queries() -> dict[str, Query]:
    u, g, e = user_days, user_types, masked_embeddings
    return {
        "col_missing": lambda s, d: stats.missing_by_column(u(s, d)).select("feature", "n_missing"),
        "col_missing_prop": lambda s, d: stats.missing_by_column(u(s, d), True).select("feature", F.round("prop_missing", 6).alias("prop_missing")),
        "row_missing": lambda s, d: stats.missing_by_row(u(s, d)),
        "row_missing_prop": lambda s, d: stats.missing_by_row(u(s, d), True).select("sample", F.round("prop_missing", 6).alias("prop_missing")),
        "col_variance": variances,
        "col_min_max": ranges,
        "mean_impute": completed(u, mean_impute),
        "mean_impute_subset": completed(u, lambda m: mean_impute(m, HALF)),
        "knn_euclid_k5": completed(u, lambda m: knn_impute(m, 5)),
        "knn_manhattan_k5": completed(u, lambda m: knn_impute(m, 5, method="manhattan")),
        "knn_distpow1": completed(u, lambda m: knn_impute(m, 5, dist_pow=1.0)),
        "knn_distpow2": completed(u, lambda m: knn_impute(m, 5, dist_pow=2.0)),
        "knn_subset": completed(u, lambda m: knn_impute(m, 5, subset=HALF)),
        "knn_colmax_excluded": completed(g, lambda m: knn_impute(m, 3, colmax=0.65)),
        "knn_no_post": completed(g, lambda m: knn_impute(m, 3, post_imp=False)),
        "knn_neighbors": neighbour_table,
        "knn_embeddings_masked": completed(e, lambda m: knn_impute(m, 10, dist_pow=1.0)),
        "windows_greedy": window_table(window_size=7),
        "windows_overlap": window_table(window_size=10, overlap_size=4),
        "windows_flank": window_table(window_size=5, flank=True, subset=["d03", "d15", "d28"]),
        "windows_subset_pruned": window_table(window_size=10, overlap_size=4, subset=["d20"]),
        "windows_coverage": covered,
        "slide_knn": completed(u, lambda m: slide_impute(m, 10, k=3)),
        "slide_knn_overlap": completed(u, lambda m: slide_impute(m, 10, 4, k=3, dist_pow=1.0)),
        "slide_knn_subset": completed(u, lambda m: slide_impute(m, 10, 4, k=3, subset=HALF)),
        "slide_knn_flank": completed(u, lambda m: slide_impute(m, 5, flank=True, k=3, subset=["d03", "d15", "d28"])),
        "slide_knn_no_post": completed(u, lambda m: slide_impute(m, 10, 4, k=3, post_imp=False)),
        "slide_knn_min_window": completed(u, lambda m: slide_impute(m, 7, k=3, min_window_n=5)),
        "slide_knn_skip": completed(holed_days, lambda m: slide_impute(m, 8, 3, k=3)),
        "slide_knn_mean": completed(holed_days, lambda m: slide_impute(m, 8, 3, k=3, on_infeasible="mean")),
        "windows_overlap_regions": overlapping,
        "group_knn_skip": completed(holed_types, lambda m: group_impute(m, type_groups(m), k=4, on_infeasible="skip")),
        "group_knn_mean": completed(holed_types, lambda m: group_impute(m, type_groups(m), k=4, on_infeasible="mean")),
        "group_knn_aux": completed(g, lambda m: group_impute(m, aux_groups(m), allow_unmapped=True, k=4)),
        "groups_long_to_nested": group_table(),
        "groups_subset_demote": group_table(["click_01", "click_02", "view_05"]),
        "group_knn": completed(g, lambda m: group_impute(m, type_groups(m), k=4)),
        "metrics_all": metrics,
        "tune_knn_grid": tune_grid,
        "tune_custom_fill": tune_custom,
        "pca_regularized": completed(u, lambda m: pca_impute(m, 2)),
        "pca_em": completed(u, lambda m: pca_impute(m, 2, method="EM")),
        "pca_noscale": completed(u, lambda m: pca_impute(m, 2, scale=False)),
        "pca_clamp": completed(u, lambda m: pca_impute(m, 2, clamp=[0.0, 40.0])),
        "pca_rowweights": completed(u, lambda m: pca_impute(m, 2, row_w="n_miss")),
        "group_pca": completed(g, lambda m: group_impute(m, type_groups(m), ncp=2)),
        "slide_pca": completed(u, lambda m: slide_impute(m, 10, 4, ncp=2)),
        "sample_na_loc": sampled,
        "simulate": simulated,
    }


U = """o as (select user_id as sample, day(ts) as location, avg(value) as value from events group by 1, 2),
f as (select location, 'd' || lpad(location::varchar, 2, '0') as feature, row_number() over (order by location) as col_idx
  from (select distinct location from o) x),
s as (select distinct sample from o),
x as (select s.sample, f.feature, f.col_idx, f.location, o.value from s cross join f
  left join o on o.sample = s.sample and o.location = f.location)"""
G = """o as (select user_id as sample, event_type || '_' || lpad(day(ts)::varchar, 2, '0') as feature, avg(value) as value from events group by 1, 2),
f as (select feature, row_number() over (order by feature) as col_idx from (select distinct feature from o) x),
s as (select distinct sample from o),
x as (select s.sample, f.feature, f.col_idx, o.value from s cross join f
  left join o on o.sample = s.sample and o.feature = f.feature)"""
E = """r as (select vec_id as sample, unnest(embedding)::double as v, unnest(range(len(embedding))) as dim from embeddings),
h as (select *, (sample * 7385 + dim * 1934 + 1) % 10007 as h from r),
x as (select sample, 'e' || lpad(dim::varchar, 2, '0') as feature, dim + 1 as col_idx,
  case when (h * h * h + 17 * h) % 997 < 100 then null else v end as value from h)"""
IN_HALF = "feature in (" + ", ".join(f"'{f}'" for f in HALF) + ")"


def _knn(k: int, method: str = "euclidean", power: float = 0.0, colmax: float = 0.9, post: bool = True) -> str:
    """CTEs from cells (part, sample, feature, col_idx, wanted, value) to done, with done_value."""
    each = "abs(a.value - b.value)" if method == "manhattan" else "(a.value - b.value) * (a.value - b.value)"
    small = "mp * sqrt(2.220446049250313e-16)"
    weight = "1.0" if power == 0 else f"case when mp is null then 1.0 when z then pow({small} / greatest(d, {small}), {power}) when d = 'Infinity'::double then 0.0 else pow(mp / d, {power}) end"
    value = "case when wanted then coalesce(kv, avg(kv) over (partition by part, col_idx)) else kv end" if post else "kv"
    return f"""st as (select part, col_idx, count(*) as n, count(value) as n_obs, bool_or(wanted) as wanted from cells group by 1, 2),
el as (select *, case when n_obs = n then 0 when wanted then 1 else 2 end as role from st where (n - n_obs)::double / n < {colmax}),
pr as (select t.part, t.col_idx as t, c.col_idx as c, c.role from el t join el c on t.part = c.part and t.col_idx <> c.col_idx where t.role = 1),
df as (select a.part, a.col_idx as t, b.col_idx as c, sum({each}) / count(*) as d from cells a join cells b on a.part = b.part and a.sample = b.sample
  where a.col_idx <> b.col_idx and a.value is not null and b.value is not null group by 1, 2, 3),
rk as (select pr.part, pr.t, pr.c, coalesce(df.d, 'Infinity'::double) as d,
  row_number() over (partition by pr.part, pr.t order by coalesce(df.d, 'Infinity'::double), pr.role, pr.c) as rnk
  from pr left join df on pr.part = df.part and pr.t = df.t and pr.c = df.c),
nb as (select *, min(case when d > 0 and d < 'Infinity'::double then d end) over (partition by part, t) as mp, bool_or(d <= 0) over (partition by part, t) as z from rk where rnk <= {k}),
wt as (select part, t, c, {weight} as w from nb),
im as (select m.part, m.sample, m.col_idx, sum(wt.w * v.value) / nullif(sum(wt.w), 0) as value
  from cells m join wt on m.part = wt.part and m.col_idx = wt.t join cells v on v.part = m.part and v.col_idx = wt.c and v.sample = m.sample
  where m.value is null and v.value is not null group by 1, 2, 3),
kn as (select c.*, coalesce(c.value, im.value) as kv from cells c left join im on im.part = c.part and im.sample = c.sample and im.col_idx = c.col_idx),
done as (select *, {value} as done_value from kn)"""


def _single(base: str, wanted: str = "true", **options) -> str:
    return f"with {base}, cells as (select 0 as part, sample, feature, col_idx, {wanted} as wanted, value from x), {_knn(**options)} select sample, feature, round(done_value, 6) as value from done"


def _renamed(text: str, i: int) -> str:
    """The CTEs of _knn with names of their own."""
    return re.sub(r"\b(st|el|pr|df|rk|nb|wt|im|kn|done|cells)\b", lambda m: f"{m[1]}{i}", text)


def _windows(size: float, overlap: float) -> str:
    return f"""j as (select a.col_idx as i, max(b.col_idx) as e,
  coalesce(min(case when b.col_idx > a.col_idx and b.location >= a.location + {size} - {overlap} then b.col_idx end), max(b.col_idx) + 1) as nx
  from f a join f b on b.col_idx >= a.col_idx and b.location < a.location + {size} group by 1),
ws as (select 1::bigint as s union all select j.nx from ws join j on j.i = ws.s where j.e < (select max(col_idx) from f)),
w as (select row_number() over (order by s)::int as window_id, s::int as "start", j.e::int as "end", (j.e - s + 1)::int as window_n from ws join j on j.i = ws.s)"""


def _feasible(k: int) -> str:
    return f"ok as (select part from el group by 1 having count(*) > {k} and bool_or(role = 1))"


def _slide(size: float, overlap: float, wanted: str = "true", least: int = 1, base: str = U, policy: str | None = None, **options) -> str:
    value = {"mean": "case when part in (select part from ok) then done_value else coalesce(value, avg(value) over (partition by part, col_idx)) end"}.get(policy, "done_value")
    kept = f", {_feasible(options['k'])}, done2 as (select sample, feature, part, wanted, {value} as done_value from done{' where part in (select part from ok)' if policy == 'skip' else ''})" if policy else ""
    return f"""with recursive {base}, {_windows(size, overlap)},
hit as (select distinct w.window_id, w."start", w."end" from w join f on f.col_idx between w."start" and w."end" where w.window_n >= {least} and {wanted}),
cells as (select h.window_id as part, x.sample, x.feature, x.col_idx, {wanted} as wanted, x.value from hit h join x on x.col_idx between h."start" and h."end"),
{_knn(**options)}{kept},
mean as (select sample, feature, case when count(*) = count(done_value) then avg(done_value) end as v, count(*) as n from done{'2' if policy else ''} where wanted group by 1, 2)
select x.sample, x.feature, round(case when mean.n is null then x.value else coalesce(mean.v, x.value) end, 6) as value from x left join mean on mean.sample = x.sample and mean.feature = x.feature"""


def _metric_sql(pairs: str) -> str:
    return f"""with recursive {pairs},
b as (select *, truth is not null and estimate is not null as ok from p),
m as (select param_set, rep_id, count(*) as n, sum((not ok)::int)::bigint as n_miss, avg(abs(truth - estimate)) as mae,
  sqrt(avg((truth - estimate) * (truth - estimate))) as rmse, avg(estimate - truth) as bias,
  100 * avg(case when truth <> 0 then abs((truth - estimate) / truth) end) as mape,
  pow(corr(truth, estimate), 2) as rsq,
  1 - sum((truth - estimate) * (truth - estimate)) / nullif(var_pop(case when ok then truth end) * count(case when ok then 1 end), 0) as rsq_trad
  from b group by 1, 2)"""


def _unpivot(names: tuple[str, ...], digits: int) -> str:
    return " union all ".join(f"select param_set, rep_id, n, n_miss, '{k}' as metric, round({k}, {digits}) as estimate from m" for k in names)


def _group(base: str, policy: str) -> str:
    value = "done_value" if policy == "error" else f"case when part in (select part from ok) then done_value else {'coalesce(value, avg(value) over (partition by part, col_idx))' if policy == 'mean' else 'value'} end"
    return f"with {base}, cells as (select split_part(feature, '_', 1) as part, sample, feature, col_idx, true as wanted, value from x), {_knn(4)}, {_feasible(4)} select sample, feature, round({value}, 6) as value from done"


HOLED_U = U.replace("x as (", "xx as (") + """,
sx as (select sample, row_number() over (order by sample) - 1 as row from s),
x as (select xx.sample, feature, col_idx, location, case when location > 12 or row % 20 = 0 then value end as value from xx join sx on sx.sample = xx.sample)"""
HOLED_G = G.replace("x as (", "xx as (") + """,
sx as (select sample, row_number() over (order by sample) - 1 as row from s),
x as (select xx.sample, feature, col_idx, case when feature not like 'purchase_%' or row % 5 = 0 then value end as value from xx join sx on sx.sample = xx.sample)"""
MASK = "(h * h * h + 17 * h) % 997 < 100"


def oracle_sql() -> dict[str, str]:
    flank_targets = "feature in ('d03', 'd15', 'd28')"
    hidden = f"""{U}, sx as (select sample, row_number() over (order by sample) as row_idx from s),
hx as (select x.*, ((sx.row_idx - 1) * 7385 + (x.col_idx - 1) * 1934 + 1) % 10007 as h from x join sx on sx.sample = x.sample),
y as (select *, value is not null and {MASK} as hid from hx),
yc as (select col_idx from y group by 1 having bool_or(hid))"""

    def grid_run(i: int, k: int) -> str:
        return _renamed(f"cells as (select 0 as part, sample, feature, col_idx, col_idx in (select col_idx from yc) as wanted, case when hid then null else value end as value from y), {_knn(k)}", i)

    grid = f"{hidden}, {grid_run(1, 3)}, {grid_run(2, 8)}, p as (" + " union all ".join(f"select {i} as param_set, 1 as rep_id, y.value as truth, d.done_value as estimate from y join done{i} d on d.sample = y.sample and d.col_idx = y.col_idx where y.hid" for i in (1, 2)) + ")"
    custom = f"{hidden}, p as (select 1 as param_set, 1 as rep_id, value as truth, 10.0::double as estimate from y where hid)"
    pairs = """p as (select (o_custkey % 3)::int as param_set, (o_orderkey % 2)::int as rep_id,
  case when o_orderkey % 11 <> 0 then o_totalprice::double end as truth, case when o_custkey % 7 <> 0 then o_totalprice::double * 0.9 + 100 end as estimate from orders)"""
    asked = "('click_01', 'click_02', 'view_05')"
    flank = f"""fw as (select row_number() over (order by t.col_idx)::int as window_id, min(b.col_idx)::int as "start", max(b.col_idx)::int as "end", t.col_idx as target
  from f t join f b on b.location between t.location - 5 and t.location + 5 where t.{flank_targets} group by t.col_idx)"""
    return {
        "col_missing": f"with {U} select feature, count(*) - count(value) as n_missing from x group by 1",
        "col_missing_prop": f"with {U} select feature, round((count(*) - count(value))::double / count(*), 6) as prop_missing from x group by 1",
        "row_missing": f"with {U} select sample, count(*) - count(value) as n_missing from x group by 1",
        "row_missing_prop": f"with {U} select sample, round((count(*) - count(value))::double / count(*), 6) as prop_missing from x group by 1",
        "col_variance": f"with {U} select feature, round(var_samp(value), 6) as variance from x group by 1",
        "col_min_max": f"with {U} select feature, round(min(value), 6) as min_value, round(max(value), 6) as max_value from x group by 1",
        "mean_impute": f"with {U} select sample, feature, round(coalesce(value, avg(value) over (partition by feature)), 6) as value from x",
        "mean_impute_subset": f"with {U} select sample, feature, round(case when {IN_HALF} then coalesce(value, avg(value) over (partition by feature)) else value end, 6) as value from x",
        "knn_euclid_k5": _single(U, k=5),
        "knn_manhattan_k5": _single(U, k=5, method="manhattan"),
        "knn_distpow1": _single(U, k=5, power=1.0),
        "knn_distpow2": _single(U, k=5, power=2.0),
        "knn_subset": _single(U, IN_HALF, k=5),
        "knn_colmax_excluded": _single(G, k=3, colmax=0.65),
        "knn_no_post": _single(G, k=3, post=False),
        "knn_neighbors": f"with {U}, cells as (select 0 as part, sample, feature, col_idx, true as wanted, value from x), {_knn(5)} select t::int as target, c::int as col_idx, rnk::int as rank, round(d, 6) as dist from rk where rnk <= 5",
        "knn_embeddings_masked": _single(E, k=10, power=1.0),
        "windows_greedy": f"with recursive {U}, {_windows(7, 0)} select * from w",
        "windows_overlap": f"with recursive {U}, {_windows(10, 4)} select * from w",
        "windows_flank": f'with {U}, {flank} select window_id, "start", "end", ("end" - "start" + 1)::int as window_n, target::int as target, (target - "start" + 1)::int as subset_local from fw',
        "windows_subset_pruned": f"with recursive {U}, {_windows(10, 4)} select w.* from w where exists (select 1 from f where f.feature = 'd20' and f.col_idx between w.\"start\" and w.\"end\")",
        "windows_coverage": f'with recursive {U}, {_windows(10, 4)} select f.col_idx::int as col_idx, count(*) as n_windows from f join w on f.col_idx between w."start" and w."end" group by 1',
        "slide_knn": _slide(10, 0, k=3),
        "slide_knn_overlap": _slide(10, 4, k=3, power=1.0),
        "slide_knn_subset": _slide(10, 4, IN_HALF, k=3),
        "slide_knn_flank": f"""with {U}, {flank},
cells as (select fw.window_id as part, x.sample, x.feature, x.col_idx, x.col_idx = fw.target as wanted, x.value from fw join x on x.col_idx between fw."start" and fw."end"),
{_knn(3)} select x.sample, x.feature, round(coalesce(d.done_value, x.value), 6) as value from x left join (select * from done where wanted) d on d.sample = x.sample and d.feature = x.feature""",
        "groups_long_to_nested": f"with {G} select split_part(feature, '_', 1) as grp, feature, 'feature' as role from f",
        "groups_subset_demote": f"with {G} select split_part(feature, '_', 1) as grp, feature, case when feature in {asked} then 'feature' else 'aux' end as role from f where split_part(feature, '_', 1) in ('click', 'view')",
        "group_knn": _group(G, "error"),
        "group_knn_skip": _group(HOLED_G, "skip"),
        "group_knn_mean": _group(HOLED_G, "mean"),
        "group_knn_aux": f"""with {G}, m as (select *, split_part(feature, '_', 1) as kind, split_part(feature, '_', 2)::int as day from x),
{_renamed(f"cells as (select 'a' as part, sample, feature, case when kind = 'click' then day else 100 + day end as col_idx, kind = 'click' as wanted, value from m where kind = 'click' and day <= 12 or kind = 'view' and day <= 6), {_knn(2)}", 1)},
{_renamed(f"cells as (select 'b' as part, sample, feature, case when kind = 'view' then day else 100 + day end as col_idx, kind = 'view' as wanted, value from m where kind = 'view' and day <= 8 or kind = 'click' and day <= 4), {_knn(4)}", 2)},
n as (select sample, feature, done_value from done1 where wanted union all select sample, feature, done_value from done2 where wanted)
select x.sample, x.feature, round(coalesce(n.done_value, x.value), 6) as value from x left join n on n.sample = x.sample and n.feature = x.feature""",
        "slide_knn_no_post": _slide(10, 4, k=3, post=False),
        "slide_knn_min_window": _slide(7, 0, k=3, least=5),
        "slide_knn_skip": _slide(8, 3, base=HOLED_U, policy="skip", k=3),
        "slide_knn_mean": _slide(8, 3, base=HOLED_U, policy="mean", k=3),
        "windows_overlap_regions": f"""with recursive {U}, {_windows(10, 4)},
c as (select f.col_idx from f join w on f.col_idx between w."start" and w."end" group by 1 having count(*) > 1),
r as (select col_idx, col_idx - row_number() over (order by col_idx) as run from c)
select min(col_idx)::int as "start", max(col_idx)::int as "end" from r group by run""",
        "metrics_all": _metric_sql(pairs) + _unpivot(("mae", "rmse", "bias", "mape", "rsq", "rsq_trad"), 4),
        "tune_knn_grid": _metric_sql(grid) + _unpivot(("mae", "rmse"), 6),
        "tune_custom_fill": _metric_sql(custom) + _unpivot(("mae", "rmse"), 6),
    }
