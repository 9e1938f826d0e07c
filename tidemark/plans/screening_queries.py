"""Quality control and screening of all 52 long-window features on the training period, and their redundancy with the baseline features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR, from_micros, micros, rounded
from tidemark.operators import diagnostics as dg
from tidemark.operators import linear, ranks, redundancy, screening, targets
from tidemark.operators import splits as sp
from tidemark.operators.f0 import F0, eligible, f0_features
from tidemark.operators.recurrent_features import RECURRENT, recurrent_features
from tidemark.operators.windowed_features import WINDOWED, windowed_features
from tidemark.plans.feature_queries import EWM_LAYERS, EWM_SQL, FEATURE_SQL, LAGS_SQL, PIVOT_SQL, _RSI_WALK, _select
from tidemark.plans.market_queries import BARS, ELIGIBLE_SQL, F0_SQL, TARGET_SQL, segments_sql
from tidemark.plans.model_queries import CORR, PAIRS, REDUNDANT, _CLASS
from tidemark.plans.study_queries import SPLIT_SQL
from tidemark.sources.bars import hourly
from tidemark.staging import staged

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
ALL52 = [*WINDOWED, *RECURRENT]
KEYS = ["symbol", "decision_time"]


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def whole(names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).isNotNull()
    return out


def feature_table(spark, sf_dir) -> DataFrame:
    """All 52 features (rounded) beside target, sigma, split and the ten baseline features of the same decision, staged.

    ``reason``: why a decision is screened or not (its 24 hours unbroken, all features there in each, a positive sigma).
    """
    bars = hourly(spark, sf_dir)
    features = dg.one_to_one(windowed_features(bars), recurrent_features(bars).drop("segment", "row"), ["symbol", "open_time"])
    features = features.select("symbol", from_micros(micros("open_time") + HOUR).alias("decision_time"), *(F.round(c, 7).alias(c) for c in ALL52))
    y = sp.frozen_split(targets.one_hour(bars).select(*KEYS, "target_time", F.col("future_log_return_1h").alias("y")))
    base = f0_features(bars).select(*KEYS, F.col("rolling_volatility_24h").alias("sigma"), *(F.round(c, 7).alias(c) for c in F0))
    d = dg.one_to_one(dg.one_to_one(y, base, KEYS), features, KEYS)
    w, us = sp.by_decision(), micros("decision_time")
    d = d.withColumns({"_whole": F.sum(whole(ALL52).cast("int")).over(w.rowsBetween(-23, 0)), "_unbroken": F.coalesce(us - F.lag(us, 23).over(w) == 23 * HOUR, F.lit(False))})
    reason = F.when(~F.col("_unbroken"), "incomplete_window").when(F.col("_whole") < 24, "missing_values").when(~F.coalesce(F.col("sigma") > 0, F.lit(False)), "no_sigma").otherwise("usable")
    return staged(d.withColumns({"reason": reason, "trains": (F.col("split") == "train") & ~F.col("purged")}).drop("_whole", "_unbroken"), "feature-table")


def screened_rows(table: DataFrame) -> DataFrame:
    """(keys, block, y, features) of the usable training decisions; y is the normalised target."""
    d = table.filter("trains and reason = 'usable'").withColumn("y", F.round(F.col("y") / F.col("sigma"), 9))
    return sp.blocks(d.select(*KEYS, "y", *ALL52))


def long_of(rows: DataFrame) -> DataFrame:
    return screening.long_table(rows, [*KEYS, "block", "y"], ALL52)


_EWM = {k: first for k, (first, g) in RECURRENT.items() if g == "ewm"}
W52 = f"""with recursive {BARS}, {segments_sql()}, {F0_SQL}, {TARGET_SQL}, smp as (select symbol, decision_time, target_time, future_log_return_1h as y from tgt), {SPLIT_SQL}, {LAGS_SQL}, {EWM_LAYERS}, {_RSI_WALK}, {PIVOT_SQL},
wa as ({_select({k: first for k, (first, _) in WINDOWED.items()}, FEATURE_SQL, 'l4', 7)}), we as ({_select(_EWM, EWM_SQL, 'e4', 7)}),
wr as (select symbol, open_time, round(case when row >= 15 then rsi / 100 - 0.5 end, 7) as rsi_centered_14, round(case when row >= 30 and count(k) over w = 3 then least(greatest(avg(k) over w, 0.0), 1.0) end, 7) as mom_stoch_rsi_14_14_3 from sk window w as (partition by symbol, segment order by open_time rows between 2 preceding and current row)),
wf as (select wa.symbol, wa.open_time + interval 1 hour as decision_time, wa.* exclude (symbol, segment, open_time), we.* exclude (symbol, segment, open_time), rsi_centered_14, mom_stoch_rsi_14_14_3, flag as rsi_hidden_div_flag, run as rsi_div_persistence, pv.break as mom_tl_break_bull_30
  from wa join we using (symbol, open_time) join wr using (symbol, open_time) join pv using (symbol, open_time)),
wt0 as (select spl.symbol, spl.decision_time, y, split, purged, f0.rolling_volatility_24h as sigma, {', '.join(f'round(f0.{c}, 7) as {c}' for c in F0)}, wf.* exclude (symbol, decision_time) from spl join f0 on f0.symbol = spl.symbol and f0.decision_time = spl.decision_time join wf on wf.symbol = spl.symbol and wf.decision_time = spl.decision_time),
wt1 as (select *, ({' + '.join(f'({c} is not null)::int' for c in ALL52)}) = {len(ALL52)} as all_there from wt0),
wt2 as (select *, sum(all_there::int) over (partition by symbol order by decision_time rows between 23 preceding and current row) as w24, decision_time - lag(decision_time, 23) over (partition by symbol order by decision_time) = interval 23 hours as unbroken from wt1),
wt as (select *, split = 'train' and not purged as trains, case when not coalesce(unbroken, false) then 'incomplete_window' when w24 < 24 then 'missing_values' when not coalesce(sigma > 0, false) then 'no_sigma' else 'usable' end as reason from wt2),
bk as (select * replace (round(y / sigma, 9) as y), ntile(6) over (partition by symbol order by decision_time)::integer as block from wt where trains and reason = 'usable'),
lg as ({' union all '.join(f"select symbol, decision_time, block, y, '{c}' as feature, {c} as value from bk" for c in ALL52)}),
lq as ({' union all '.join(f"select symbol, decision_time, '{c}' as feature, {c} as value from wt where trains" for c in ALL52)})"""
#: Pairs of quality control: all training rows, each pair over the rows that have both.
_QC_PAIRS = PAIRS.replace("lg a join lg b", "lq a join lq b")


@query(f"{W52} select count(*) as joined, count(*) filter (where sigma > 0) as with_sigma, count(*) filter (where all_there) as whole from wt")
def long_window_join(spark, sf_dir):
    return feature_table(spark, sf_dir).agg(F.count("*").alias("joined"), F.count_if(F.col("sigma") > 0).alias("with_sigma"), F.count_if(whole(ALL52)).alias("whole"))


@query(f"{W52} select reason, count(*) as samples from wt where trains group by all")
def screening_samples(spark, sf_dir):
    """Why a training decision is or is not screened."""
    return feature_table(spark, sf_dir).filter("trains").groupBy("reason").agg(F.count("*").alias("samples"))


@query(f"{W52}, {_QC_PAIRS} select left_feature, right_feature, pairs, round(rho, 9) as rho, identical from pp")
def long_window_pairs(spark, sf_dir):
    """Rank correlation of all 1326 pairs on training rows."""
    return ranks.spearman_matrix(feature_table(spark, sf_dir).filter("trains"), KEYS, ALL52)


@query(f"{W52}, {_QC_PAIRS}, o as (select *, row_number() over (partition by left_feature order by identical desc, round(abs(rho), 9) desc nulls last, right_feature) as k from pp) select left_feature, right_feature, pairs, round(rho, 9) as rho, identical from o where k = 1")
def best_redundant_matches(spark, sf_dir):
    return dg.best_matches(ranks.spearman_matrix(feature_table(spark, sf_dir).filter("trains"), KEYS, ALL52))


@query(f"{W52}, {CORR} select feature, block, samples, round(pearson, 9) as pearson, round(spearman, 9) as spearman from co")
def long_window_correlations(spark, sf_dir):
    """Of each feature with y / sigma on the screened rows, by block and together."""
    return screening.block_correlations(long_of(screened_rows(feature_table(spark, sf_dir))))


@query(f"{W52}, e as (select feature, block, count(*) filter (where value <> 0) as n from lg group by all) select feature, sum(n)::bigint as events, min(n) as least_block_events, case when min(n) = 0 then 'TEMPORALLY_SPARSE' else 'COVERED' end as status from e group by feature")
def long_window_sparse_events(spark, sf_dir):
    return screening.sparse_events(long_of(screened_rows(feature_table(spark, sf_dir))))


def classes_of(table: DataFrame) -> DataFrame:
    """Class, alternate and preferred feature of every screened feature."""
    classes = screening.classified(screening.block_correlations(long_of(screened_rows(table))))
    train = table.filter("trains")
    missing = screening.long_table(train, KEYS, ALL52)
    return screening.representatives(screening.with_missing(classes, missing), ranks.spearman_matrix(train, KEYS, ALL52))


@query(f"{W52}, {CORR}, {_QC_PAIRS}, {REDUNDANT} select {_CLASS}, round(missing_ratio, 9) as missing_ratio, category, preferred, conflicts from cf")
def screening_52(spark, sf_dir):
    """All 52 features: stability over six blocks, class, and the preferred feature of each alternate."""
    return classes_of(feature_table(spark, sf_dir))


@query(f"{W52}, {CORR}, {_QC_PAIRS}, {REDUNDANT} select coalesce(category, 'UNSCREENED') as category, count(*) as features from (select distinct feature from lq) a left join cf using (feature) group by all")
def screening_cover(spark, sf_dir):
    """How many features each class has; every feature is in exactly one (UNSCREENED: no usable row), else this raises."""
    table = feature_table(spark, sf_dir)
    classes = classes_of(table)
    expected = screening.long_table(table.filter("trains"), KEYS, ALL52).select("feature").distinct()
    lists = dg.checked(expected.join(classes.groupBy("feature").agg(F.count("*").alias("lists"), F.first("category").alias("category")), "feature", "left"), F.coalesce("lists", F.lit(1)) == 1, "a feature in several classes")
    return lists.groupBy(F.coalesce("category", F.lit("UNSCREENED")).alias("category")).agg(F.count("*").alias("features"))


# --- redundancy with the baseline features ---------------------------------------------------------

_CROSS = f"""{W52}, f0l as ({' union all '.join(f"select symbol, decision_time, '{c}' as f0_feature, {c} as x from wt where trains" for c in F0)}),
xp as (select lq.feature, f0_feature, x, value as y from lq join f0l using (symbol, decision_time) where x is not null and value is not null),
xm as (select feature, f0_feature, count(*) as pairs, regr_slope(y, x) as slope, avg(y) as my, avg(x) as mx, min(x) = max(x) as flat, greatest(max(y) - min(y), max(abs(y)), 1.0) as scale from xp group by all having count(*) >= 2),
xr as (select *, rank() over (partition by feature, f0_feature order by x) + (count(*) over (partition by feature, f0_feature, x) - 1) / 2.0 as rx, rank() over (partition by feature, f0_feature order by y) + (count(*) over (partition by feature, f0_feature, y) - 1) / 2.0 as ry from xp),
xe as (select feature, f0_feature, any_value(pairs) as pairs, bool_and(abs(x - y) <= 1e-12 + 1e-12 * abs(y)) as exact, case when any_value(flat) then max(y) - min(y) <= 1e-12 + 1e-12 * max(abs(y)) else max(abs(y - (my + slope * (x - mx)))) <= 1e-10 * any_value(scale) end as affine, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) as rho from xr join xm using (feature, f0_feature) group by all),
xo as (select *, row_number() over (partition by feature order by exact desc, affine desc, round(abs(rho), 9) desc nulls last, f0_feature) as k from xe)"""


@query(f"{_CROSS} select feature, f0_feature, pairs, exact, affine, round(rho, 9) as rho from xe")
def cross_redundancy(spark, sf_dir):
    """Every long-window feature against every baseline feature on training rows: equal, affine, rank correlation."""
    return redundancy.cross_equivalence(feature_table(spark, sf_dir).filter("trains"), KEYS, ALL52, list(F0))


@query(f"{_CROSS} select feature, f0_feature, pairs, exact, affine, round(rho, 9) as rho from xo where k = 1 and (exact or affine or coalesce(abs(rho) >= 0.98, false))")
def cross_redundant_matches(spark, sf_dir):
    """Of each redundant feature the best baseline match: equal first, then affine, then the strongest correlation, then by name."""
    return redundancy.best_cross_matches(redundancy.cross_equivalence(feature_table(spark, sf_dir).filter("trains"), KEYS, ALL52, list(F0)))


# --- paired windows --------------------------------------------------------------------------------

ADDED = ("body_to_tr", "close_location_value", "efficiency_ratio_20")
_PAIR_COLUMNS = [*F0, *ADDED]


@query(f"""{W52}, {ELIGIBLE_SQL}, pq as (select wt.symbol, wt.decision_time, wt.trains, y, sigma, elig.reason as base_reason, {', '.join('wt.' + c for c in _PAIR_COLUMNS)} from wt join elig on elig.symbol = wt.symbol and elig.decision_time = wt.decision_time),
pr2 as (select *, list([{', '.join(F0)}]) over w as control, list([{', '.join(_PAIR_COLUMNS)}]) over w as candidate, count(*) over w as steps, ({' + '.join(f'count({c}) over w' for c in ADDED)}) as added, decision_time - lag(decision_time, 23) over (partition by symbol order by decision_time) = interval 23 hours as unbroken from pq window w as (partition by symbol order by decision_time rows between 23 preceding and current row))
select symbol, decision_time, len(control)::bigint as steps, len(control[1])::bigint as control_width, len(candidate[1])::bigint as candidate_width, round(list_sum(flatten(control)), 4) as control_sum, round(list_sum(flatten(candidate)), 4) as candidate_sum, round(list_sum(list_transform(flatten(candidate), lambda v, i: v * i)), 1) as candidate_moment, round(y / sigma, 9) as z from pr2 where trains and base_reason = 'usable' and coalesce(unbroken, false) and added = {24 * len(ADDED)}""")
def paired_windows(spark, sf_dir):
    """Control (24 x 10) and candidate (24 x 13) windows of the same training decisions: only decisions where both are whole, so they pair one to one."""
    d = redundancy.paired_windows(feature_table(spark, sf_dir), eligible(f0_features(hourly(spark, sf_dir))).select(*KEYS, "eligible"), list(F0), list(ADDED))
    total = lambda c: F.aggregate(F.flatten(c), F.lit(0.0), lambda a, x: a + x)
    flat = F.flatten("candidate")
    moment = F.aggregate(F.zip_with(flat, F.sequence(F.lit(1), F.size(flat)), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return d.select(*KEYS, F.size("control").cast("long").alias("steps"), F.size(F.get("control", F.lit(0))).cast("long").alias("control_width"), F.size(F.get("candidate", F.lit(0))).cast("long").alias("candidate_width"), F.round(total("control"), 4).alias("control_sum"), F.round(total("candidate"), 4).alias("candidate_sum"), F.round(moment, 1).alias("candidate_moment"), F.round("z", 9).alias("z"))


@query(f"""{W52}, {ELIGIBLE_SQL}, sq as (select wt.symbol, wt.decision_time, wt.trains, elig.reason as base_reason, {', '.join('wt.' + c for c in F0)} from wt join elig on elig.symbol = wt.symbol and elig.decision_time = wt.decision_time),
sw as (select symbol, decision_time, trains, base_reason, list([{', '.join(F0)}]) over w as win from sq window w as (partition by symbol order by decision_time rows between 23 preceding and current row)),
se as (select symbol, unnest(win) as step from sw where trains and base_reason = 'usable' and len(win) = 24), sl as ({' union all '.join(f"select symbol, '{c}' as feature, step[{i + 1}] as value from se" for i, c in enumerate(F0))})
select symbol, feature, round(quantile_cont(value, 0.5), 9) as center, round(case when quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 0 then quantile_cont(value, 0.75) - quantile_cont(value, 0.25) else 1.0 end, 9) as scale from sl group by all""")
def sequence_scaler_stats(spark, sf_dir):
    """Median and quartile width of each feature over all 24 steps of all training windows."""
    d = redundancy.paired_windows(feature_table(spark, sf_dir), eligible(f0_features(hourly(spark, sf_dir))).select(*KEYS, "eligible"), list(F0), [])
    return linear.sequence_scaler(d, ["symbol"], list(F0), "control")
