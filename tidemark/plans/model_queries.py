"""Queries over quality control, screening, bounds, linear models and gates, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import rounded
from tidemark.operators import gates, linear, normalization, ranks, screening
from tidemark.operators import metrics as mt
from tidemark.operators import splits as sp
from tidemark.operators.f0 import F0
from tidemark.plans.study_queries import BASE, SPLIT_SQL, _rank_sql, metrics_sql, samples

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# candle features, a flat-prone feature and a sparse one, rounded so that equal values are equal in both engines
SCREENED = [c for c in F0 if c not in ("rolling_volatility_6h",)]


def feature_wide(spark, sf_dir) -> DataFrame:
    """Training rows with a positive sigma; y is the normalised target."""
    d = sp.frozen_split(samples(spark, sf_dir)).filter("split = 'train' and not purged and sigma > 0").withColumn("y", F.col("y") / F.col("sigma"))
    return sp.blocks(d.select("symbol", "decision_time", F.round("y", 9).alias("y"), *(F.round(c, 9).alias(c) for c in SCREENED)))


def feature_rows(spark, sf_dir) -> DataFrame:
    return screening.long_table(feature_wide(spark, sf_dir), ["symbol", "decision_time", "block", "y"], SCREENED)


LONG = f"{BASE}, {SPLIT_SQL}, tn as (select * replace (round(y / sigma, 9) as y) from spl where split = 'train' and not purged and sigma > 0), bk as (select *, ntile(6) over (partition by symbol order by decision_time)::integer as block from tn), lg as (" + " union all ".join(f"select symbol, decision_time, block, y, '{c}' as feature, round({c}, 9) as value from bk" for c in SCREENED) + ")"


@query(f"""with {LONG}, u as (select feature, max(n) as dominant, count(*) as unique_values from (select feature, value, count(*) as n from lg where value is not null group by all) group by feature),
d as (select feature, count(*) as row_count, count(value) as present, avg(value) as mean, stddev_pop(value) as std, min(value) as min_value, max(value) as max_value, avg((value = 0)::int) as zero_ratio, quantile_cont(value, 0.001) as q001, quantile_cont(value, 0.01) as q01, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.99) as q99, quantile_cont(value, 0.999) as q999 from lg group by feature)
select feature, row_count, present, round(mean, 9) as mean, round(std, 9) as std, round(min_value, 9) as min_value, round(max_value, 9) as max_value, round(zero_ratio, 9) as zero_ratio, round(q001, 9) as q001, round(q01, 9) as q01, round(median, 9) as median, round(q99, 9) as q99, round(q999, 9) as q999, unique_values, row_count - present as missing, round(dominant / present, 9) as dominant_ratio,
  unique_values <= 1 as constant, dominant / present >= 0.99 as near_constant, unique_values <= 2 or zero_ratio >= 0.95 as sparse, coalesce(greatest(abs(min_value), abs(max_value)) > 100 * greatest(abs(q01), abs(q99)), false) and greatest(abs(q01), abs(q99)) > 0 as extreme_tail from d left join u using (feature)""")
def feature_qc(spark, sf_dir):
    return screening.numeric_profile(feature_rows(spark, sf_dir))


PAIRS = f"pa as (select a.feature as left_feature, b.feature as right_feature, a.value as x, b.value as y from lg a join lg b on a.symbol = b.symbol and a.decision_time = b.decision_time and a.feature < b.feature where a.value is not null and b.value is not null), pr as (select *, {_rank_sql('x', 'left_feature, right_feature')} as rx, {_rank_sql('y', 'left_feature, right_feature')} as ry from pa), pp as (select left_feature, right_feature, count(*) as pairs, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) as rho, min((x = y)::int)::integer as identical from pr group by all)"


@query(f"with {LONG}, {PAIRS} select left_feature, right_feature, pairs, round(rho, 9) as rho, identical from pp")
def feature_spearman_pairs(spark, sf_dir):
    return ranks.spearman_matrix(feature_wide(spark, sf_dir), ["symbol", "decision_time"], SCREENED)


CORR = f"""lv as (select feature, block, value, y from lg where value is not null and y is not null), lw as (select * from lv union all select feature, null as block, value, y from lv),
lr as (select *, {_rank_sql('value', 'feature, block')} as rx, {_rank_sql('y', 'feature, block')} as ry from lw),
co as (select feature, block, count(*) as samples, covar_pop(value, y) / nullif(stddev_pop(value) * stddev_pop(y), 0) as pearson, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) as spearman from lr group by all),
cl as (select b.feature, any_value(f.samples) as samples, any_value(f.spearman) as full_spearman, count(*) filter (where b.spearman > 0) as positive_blocks, count(*) filter (where b.spearman < 0) as negative_blocks, quantile_cont(b.spearman, 0.5) as median_spearman, quantile_cont(abs(b.spearman), 0.5) as median_abs_spearman, min(abs(b.spearman)) as min_abs_spearman, max(abs(b.spearman)) as max_abs_spearman, stddev_pop(b.spearman) as spearman_std from co b join co f on f.feature = b.feature and f.block is null where b.block is not null group by b.feature),
cn as (select *, case when positive_blocks > negative_blocks then 'POSITIVE' when negative_blocks > positive_blocks then 'NEGATIVE' else 'NONE' end as dominant_sign, greatest(positive_blocks, negative_blocks) as same_sign_blocks from cl),
cg as (select *, case when coalesce(same_sign_blocks >= 5 and (case dominant_sign when 'POSITIVE' then full_spearman > 0 when 'NEGATIVE' then full_spearman < 0 else false end) and median_abs_spearman >= 0.02 and abs(full_spearman) >= 0.02, false) then 'STABLE' else 'WEAK' end as category from cn)"""
_CLASS = "feature, samples, positive_blocks, negative_blocks, dominant_sign, same_sign_blocks, " + ", ".join(f"round({c}, 9) as {c}" for c in ("full_spearman", "median_spearman", "median_abs_spearman", "min_abs_spearman", "max_abs_spearman", "spearman_std"))
#: ``cg`` with the share of missing values, and each redundant pair's alternate and preferred feature.
REDUNDANT = """cm as (select cg.*, 1 - m.present as missing_ratio from cg join (select feature, count(value) / count(*) as present from lq group by feature) m using (feature)),
rdn as (select a.feature as l, b.feature as r, struct_pack(s := (a.category = 'STABLE')::int, m := coalesce(a.median_abs_spearman, -1), f := coalesce(abs(a.full_spearman), -1), n := -a.missing_ratio) as lk, struct_pack(s := (b.category = 'STABLE')::int, m := coalesce(b.median_abs_spearman, -1), f := coalesce(abs(b.full_spearman), -1), n := -b.missing_ratio) as rk from pp join cm a on a.feature = left_feature join cm b on b.feature = right_feature where abs(rho) >= 0.98),
rw as (select case when rk > lk then l else r end as feature, case when rk > lk then r else l end as preferred, case when rk > lk then rk else lk end as key from rdn),
rc as (select feature, preferred, row_number() over (partition by feature order by key desc, preferred) as k, count(*) over (partition by feature) as conflicts from rw),
cf as (select cm.* exclude (category), case when rc.preferred is not null then 'ALTERNATE' else category end as category, rc.preferred, coalesce(rc.conflicts, 0) as conflicts from cm left join rc on rc.feature = cm.feature and k = 1)"""


@query(f"with {LONG}, {CORR} select feature, block, samples, round(pearson, 9) as pearson, round(spearman, 9) as spearman from co")
def feature_block_correlations(spark, sf_dir):
    return screening.block_correlations(feature_rows(spark, sf_dir))


@query(f"with {LONG}, {CORR} select {_CLASS}, category from cg")
def feature_screening(spark, sf_dir):
    return screening.classified(screening.block_correlations(feature_rows(spark, sf_dir)))


@query(f"with {LONG}, lq as (select * from lg), {CORR}, {PAIRS}, {REDUNDANT} select {_CLASS}, round(missing_ratio, 9) as missing_ratio, category, preferred, conflicts from cf")
def feature_representatives(spark, sf_dir):
    wide = feature_wide(spark, sf_dir)
    rows = screening.long_table(wide, ["symbol", "decision_time", "block", "y"], SCREENED)
    return screening.representatives(screening.with_missing(screening.classified(screening.block_correlations(rows)), rows), ranks.spearman_matrix(wide, ["symbol", "decision_time"], SCREENED))


@query(f"with {LONG}, e as (select feature, block, count(*) filter (where value <> 0) as n from lg group by all) select feature, sum(n)::bigint as events, min(n) as least_block_events, case when min(n) = 0 then 'TEMPORALLY_SPARSE' else 'COVERED' end as status from e group by feature")
def sparse_events(spark, sf_dir):
    return screening.sparse_events(feature_rows(spark, sf_dir))


# --- bounds -----------------------------------------------------------------------------------

MODES = {"log_return_1h": "signed", "high_low_range_pct": "positive", "close_position_in_range": "positive", "relative_volume_24h": "sparse_positive", "log_volume_change_1h": "sparse_signed", "candle_log_return": "ternary"}


def moded_rows(spark, sf_dir) -> DataFrame:
    d = sp.frozen_split(samples(spark, sf_dir)).withColumn("trains", F.expr("split = 'train' and not purged")).select("symbol", "decision_time", "trains", *(F.round(c, 9).alias(c) for c in MODES)).withColumn("candle_log_return", F.signum("candle_log_return"))
    long = screening.long_table(d, ["symbol", "decision_time", "trains"], list(MODES))
    mode = F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv))
    return long.withColumn("mode", mode[F.col("feature")])


BOUNDS = f"{BASE}, {SPLIT_SQL}, ml as (" + " union all ".join(f"select symbol, decision_time, split = 'train' and not purged as trains, '{c}' as feature, '{m}' as mode, " + (f"sign(round({c}, 9))::double" if m == "ternary" else f"round({c}, 9)") + " as value from spl" for c, m in MODES.items()) + """),
bd as (select symbol, feature, mode, case mode when 'sparse_positive' then coalesce(quantile_cont(nullif(value, 0), 0.5), 0) when 'sparse_signed' then 0.0 when 'binary' then 0.0 when 'ternary' then -1.0 else coalesce(quantile_cont(value, 0.2), 0) end as abs_min,
  case mode when 'sparse_positive' then coalesce(quantile_cont(nullif(value, 0), 0.95), 0) when 'sparse_signed' then coalesce(quantile_cont(abs(nullif(value, 0)), 0.95), 0) when 'binary' then 1.0 when 'ternary' then 1.0 else coalesce(quantile_cont(value, 0.8), 0) end as abs_max from ml where trains group by symbol, feature, mode)"""


@query(f"with {BOUNDS} select symbol, feature, mode, round(abs_min, 9) as abs_min, round(abs_max, 9) as abs_max from bd")
def bounds_table(spark, sf_dir):
    return normalization.bounds_table(moded_rows(spark, sf_dir).filter("trains"))


@query(f"""with {BOUNDS}, x as (select ml.*, abs_min as a, abs_max as b from ml join bd using (symbol, feature))
select symbol, decision_time, feature, mode, round(case when value is null then null when mode in ('binary', 'ternary') then value when mode = 'positive' then case when b - a <= 1e-12 then 0 else least(greatest((value - a) / (b - a), 0), 1) end
  when mode = 'signed' then case when b - a <= 1e-12 then 0 else least(greatest(-1 + 2 * (value - a) / (b - a), -1), 1) end when mode = 'sparse_signed' then case when b <= 1e-12 then 0 else least(greatest(value / b, -1), 1) end
  else case when value = 0 then 0 when b - a <= 1e-12 then 1 else least(greatest((ln(1 + greatest(value, 0)) - ln(1 + a)) / (ln(1 + b) - ln(1 + a)), 0), 1) end end, 9) + 0.0 as normalized, value + 0.0 as value from x""")
def normalized_features(spark, sf_dir):
    rows = moded_rows(spark, sf_dir)
    return normalization.apply_bounds(rows.drop("trains"), normalization.bounds_table(rows.filter("trains")))


# --- linear models ----------------------------------------------------------------------------

TRAINED = list(F0)


def split_rows(spark, sf_dir) -> DataFrame:
    return sp.frozen_split(samples(spark, sf_dir)).filter("not purged and split <> 'test'")


@query(f"with {BASE}, {SPLIT_SQL}, t as (select * from spl where split = 'train' and not purged), u as (" + " union all ".join(f"select symbol, '{c}' as feature, {c} as value from t" for c in TRAINED) + ") select symbol, feature, round(quantile_cont(value, 0.5), 9) as center, round(case when quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 0 then quantile_cont(value, 0.75) - quantile_cont(value, 0.25) else 1.0 end, 9) as scale from u where value is not null group by all")
def robust_scaler_stats(spark, sf_dir):
    return linear.scaler_statistics(split_rows(spark, sf_dir).filter("split = 'train'"), ["symbol"], TRAINED)


def _ridge(spark, sf_dir, normalize: bool) -> DataFrame:
    d = split_rows(spark, sf_dir).dropna(subset=TRAINED).filter("sigma > 0")
    d = d.withColumn("raw", F.col("y")).withColumn("y", F.col("y") / F.col("sigma") if normalize else F.col("y"))
    model = linear.fit_ridge(d.filter("split = 'train'"), TRAINED)
    d = model.predicted(d)
    d = d.withColumns({"p": F.col("p") * F.col("sigma") if normalize else F.col("p"), "y": F.col("raw")})
    return mt.regression_metrics(d.select("split", "y", "p"), ["split"])


@query()
def ridge_metrics(spark, sf_dir):
    return _ridge(spark, sf_dir, False)


@query()
def vn_ridge_metrics(spark, sf_dir):
    return _ridge(spark, sf_dir, True)


# --- gates ------------------------------------------------------------------------------------
# Event types are the units; the zero and the previous-return predictor are candidate and control.

METRICS = ("mae", "rmse", "ic", "directional_accuracy", "mse_skill")


def unit_metrics(spark, sf_dir, p) -> DataFrame:
    d = mt.regression_metrics(sp.blocks(samples(spark, sf_dir).select("symbol", "decision_time", "y", p.alias("p")), 4), ["symbol", "block"])
    return d.unpivot([F.col("symbol"), F.col("block")], [F.col(m) for m in METRICS], "metric", "value")


MB = f"{BASE}, z as (select symbol, y, p, ntile(4) over (partition by symbol order by decision_time)::integer as block from smp), mw as ({metrics_sql('z', 'symbol, block')}), um as (" + " union all ".join(f"select symbol, block, '{m}' as metric, {m} as value from mw" for m in METRICS) + ")"
MZ = f"zz as (select symbol, y, 0.0::double as p, block from z), mz as ({metrics_sql('zz', 'symbol, block')}), uz as (" + " union all ".join(f"select symbol, block, '{m}' as metric, {m} as value from mz" for m in METRICS) + ")"


def previous(spark, sf_dir):
    return rounded(unit_metrics(spark, sf_dir, F.col("p")))


@query(f"with {MB} select symbol, metric, count(value) as units, round(avg(value), 7) as mean, round(quantile_cont(value, 0.5), 7) as median, round(stddev_pop(value), 7) as std, round(min(value), 7) as min_value, round(max(value), 7) as max_value from um group by all")
def seed_aggregate(spark, sf_dir):
    return rounded(gates.aggregated(previous(spark, sf_dir), ["symbol"]), 7)


@query(f"with {MB}, c as (select symbol, metric, count(*) filter (where value > case metric when 'ic' then 0.0 else 0.5 end) as good, avg(value) > any_value(case metric when 'ic' then 0.0 else 0.5 end) as mg from um where metric in ('ic', 'directional_accuracy') group by all) select symbol, min(good) as least_good_units, bool_and(mg) as means_good, bool_and(mg) and min(good) >= 3 and count(*) = 2 as passed from c group by symbol")
def stability_gate(spark, sf_dir):
    return gates.gate(previous(spark, sf_dir), ["symbol"], {"ic": 0.0, "directional_accuracy": 0.5}, 3)


@query(f"with {MB}, {MZ} select symbol, block, metric, round(um.value, 9) as control, round(uz.value, 9) as candidate, round(uz.value - um.value, 9) as delta from um join uz using (symbol, block, metric)")
def paired_deltas(spark, sf_dir):
    return gates.paired_deltas(previous(spark, sf_dir), rounded(unit_metrics(spark, sf_dir, F.lit(0.0))), ["symbol", "block"])


@query(f"with {MB}, c as (select symbol, count(*) filter (where metric = 'ic' and value > 0) as positive_blocks, round(avg(value) filter (where metric = 'ic'), 7) as mean_ic, round(min(value) filter (where metric = 'ic'), 7) as worst_ic from um group by symbol) select *, rank() over (order by positive_blocks desc, mean_ic desc nulls last, worst_ic desc nulls last)::integer as place, count(*) over (partition by positive_blocks, mean_ic, worst_ic) > 1 as tied from c")
def winner_selection(spark, sf_dir):
    ic = F.when(F.col("metric") == "ic", F.col("value"))
    d = previous(spark, sf_dir).groupBy("symbol").agg(F.count_if(ic > 0).alias("positive_blocks"), F.round(F.avg(ic), 7).alias("mean_ic"), F.round(F.min(ic), 7).alias("worst_ic"))
    return gates.ranked(d, ["positive_blocks", "mean_ic", "worst_ic"])
