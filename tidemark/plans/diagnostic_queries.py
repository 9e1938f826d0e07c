"""Queries over diagnostics, checks, full gates and the screening of the windowed features, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR, from_micros, micros, rounded
from tidemark.operators import diagnostics as dg
from tidemark.operators import labels as lab
from tidemark.operators import evaluation, gates, linear, screening, targets
from tidemark.operators import metrics as mt
from tidemark.operators import splits as sp
from tidemark.operators.f0 import F0, eligible, f0_features
from tidemark.plans.market_queries import ELIGIBLE_SQL, F0_SQL, HORIZON_SQL, TARGET_SQL, TYPED, segments_sql
from tidemark.plans.study_queries import BASE, COMMON, HB, HYST, LB, LITTLE_ENDIAN, RUNS, SPLIT_SQL, _rank_sql, _walk_sql, common, labelled, metrics_sql, predictions, relative_horizon_scale, samples, training_rows
from tidemark.sources.bars import hourly
from tidemark.staging import staged

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _corr_sql(x: str, y: str) -> str:
    return f"round(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 9)"


# --- predictions: the previous return stands for a model's ---------------------------------------


@query(f"with {BASE} select symbol, count(*) as samples, round(avg(y - p), 9) as residual_mean, round(stddev_pop(y - p), 9) as residual_std, round(avg(y), 9) as target_mean, round(stddev_pop(y), 9) as target_std, round(avg(p), 9) as prediction_mean, round(stddev_pop(p), 9) as prediction_std, round(stddev_pop(p) / nullif(stddev_pop(y), 0), 9) as std_ratio, round(avg(abs(p)) / nullif(avg(abs(y)), 0), 9) as mean_abs_ratio, round(avg((p > 0)::int), 9) as prediction_positive_ratio, round(avg((y > 0)::int), 9) as target_positive_ratio from smp where y is not null and p is not null group by symbol")
def prediction_diagnostics(spark, sf_dir):
    return dg.prediction_diagnostics(samples(spark, sf_dir), ["symbol"])


ZS = "zs as (select *, y / sigma as z, p / sigma as zp from smp where sigma > 0)"


def normalized(spark, sf_dir) -> DataFrame:
    d = dg.sigma_selected(samples(spark, sf_dir)).filter("usable")
    return d.withColumns({"z": F.col("y") / F.col("sigma"), "zp": F.col("p") / F.col("sigma")})


@query(f"with {BASE}, {ZS} select symbol, count(*) as samples, round(avg((z - zp) * (z - zp)), 9) as mse, round(avg(abs(z - zp)), 9) as mae, round(1 - avg((z - zp) * (z - zp)) / nullif(avg(z * z), 0), 9) as mse_skill, round(stddev_pop(zp) / nullif(stddev_pop(z), 0), 9) as std_ratio from zs where z is not null and zp is not null group by symbol")
def normalized_target_metrics(spark, sf_dir):
    return dg.normalized_metrics(normalized(spark, sf_dir), ["symbol"])


@query(f"with {BASE}, {ZS}, x as (select symbol, y, zp * sigma as p from zs where zp is not null and y is not null) select symbol, count(*) as samples, round(avg(abs(y - p)), 9) as mae, round(sqrt(avg((y - p) * (y - p))), 9) as rmse, {_corr_sql('y', 'p')} as ic, round(avg(case when abs(y) > 1e-12 then (sign(y) = sign(p))::int end), 9) as directional_accuracy from x group by symbol")
def raw_return_metrics(spark, sf_dir):
    return dg.raw_metrics(normalized(spark, sf_dir), ["symbol"])


@query(f"with {BASE} select symbol, count(*) filter (where coalesce(sigma > 0, false)) as usable, count(*) filter (where sigma = 0) as zero_sigma, count(*) filter (where sigma is null) as missing_sigma from smp group by symbol")
def sigma_selection(spark, sf_dir):
    d = dg.sigma_selected(samples(spark, sf_dir))
    return d.groupBy("symbol").agg(F.count_if("usable").alias("usable"), F.count_if(F.col("sigma") == 0).alias("zero_sigma"), F.count_if(F.col("sigma").isNull()).alias("missing_sigma"))


@query(f"with {BASE}, {SPLIT_SQL}, v as (select *, ntile(4) over (partition by symbol order by decision_time)::integer as block, coalesce(sigma > 0, false) as usable from spl where split = 'validation' and not purged) select symbol, block, min(decision_time) as first_decision, max(decision_time) as last_decision, count(*) as block_rows, count(*) filter (where not usable) as excluded, count(*) filter (where usable) as samples, round(stddev_pop(y) filter (where usable), 9) as raw_std, round(avg(sigma) filter (where usable), 9) as sigma_mean, round(stddev_pop(y / nullif(sigma, 0)) filter (where usable), 9) as normalized_std, round(avg(abs(y / nullif(sigma, 0))) filter (where usable), 9) as normalized_mean_abs from v group by all")
def validation_normalization_blocks(spark, sf_dir):
    d = sp.frozen_split(samples(spark, sf_dir)).filter("split = 'validation' and not purged")
    return dg.normalization_blocks(sp.blocks(d, 4), ["symbol", "block"])


@query(f"with {BASE}, {SPLIT_SQL}, v as (select *, ntile(6) over (partition by symbol order by decision_time)::integer as block from spl where split = 'train' and not purged) select symbol, block, count(*) as samples, min(decision_time) as first_decision, max(decision_time) as last_decision, round(stddev_pop(y), 9) as std, round(avg(abs(y)), 9) as mean_abs, round(avg((y > 0)::int), 9) as positive_ratio from v group by all")
def train_temporal_blocks(spark, sf_dir):
    y = F.col("y")
    return sp.blocks(training_rows(samples(spark, sf_dir)), 6).groupBy("symbol", "block").agg(F.count("*").alias("samples"), F.min("decision_time").alias("first_decision"), F.max("decision_time").alias("last_decision"), F.stddev_pop(y).alias("std"), F.avg(F.abs(y)).alias("mean_abs"), F.avg((y > 0).cast("double")).alias("positive_ratio"))


@query(f"with {BASE}, x as (select symbol, sigma as a, abs(y) as b from smp where sigma > 0), r as (select *, {_rank_sql('a', 'symbol')} as ra, {_rank_sql('b', 'symbol')} as rb from x) select symbol, count(*) as samples, {_corr_sql('a', 'b')} as pearson, {_corr_sql('ra', 'rb')} as spearman from r group by symbol")
def volatility_target_relationship(spark, sf_dir):
    d = dg.sigma_selected(samples(spark, sf_dir)).filter("usable").withColumn("magnitude", F.abs("y"))
    return dg.correlations(d, ["symbol"], "sigma", "magnitude")


def _stability_sql(target: str) -> str:
    union = " union all ".join(f"select '{c}' as feature, split, round({c}, 9) as value, {target} as t from spl where split <> 'test' and not purged and sigma > 0" for c in F0)
    return f"""with {BASE}, {SPLIT_SQL}, lg as ({union}), lv as (select * from lg where value is not null and t is not null), lr as (select *, {_rank_sql('value', 'feature, split')} as rv, {_rank_sql('t', 'feature, split')} as rt from lv),
c as (select feature, split, {_corr_sql('value', 't')} as pearson, {_corr_sql('rv', 'rt')} as spearman from lr group by all),
w as (select feature, max(pearson) filter (where split = 'train') as train_pearson, max(spearman) filter (where split = 'train') as train_spearman, max(pearson) filter (where split = 'validation') as validation_pearson, max(spearman) filter (where split = 'validation') as validation_spearman from c group by feature)
select *, coalesce(sign(train_pearson) = sign(validation_pearson) and train_pearson <> 0, false) as pearson_sign_stable, coalesce(sign(train_spearman) = sign(validation_spearman) and train_spearman <> 0, false) as spearman_sign_stable from w"""


def split_features(spark, sf_dir) -> DataFrame:
    d = sp.frozen_split(samples(spark, sf_dir)).filter("split <> 'test' and not purged and sigma > 0")
    wide = d.select("symbol", "decision_time", "split", "y", (F.col("y") / F.col("sigma")).alias("z"), *(F.round(c, 9).alias(c) for c in F0))
    return screening.long_table(wide, ["symbol", "decision_time", "split", "y", "z"], list(F0))


@query(_stability_sql("y"))
def feature_target_stability(spark, sf_dir):
    return dg.sign_stability(split_features(spark, sf_dir), "y")


@query(_stability_sql("y / sigma"))
def normalized_feature_stability(spark, sf_dir):
    return dg.sign_stability(split_features(spark, sf_dir), "z")


# --- reconciliation, lookups that must hit, sets ---------------------------------------------------


@query(f"with {TYPED}, {segments_sql()}, {TARGET_SQL}, {HORIZON_SQL}, a as (select symbol, decision_time, future_log_return_1h as x from tgt), b as (select symbol, decision_time, value as y from hx where outcome = 'ok' and horizon = 1), j as (select x, y from a full join b on a.symbol = b.symbol and a.decision_time = b.decision_time) select count(*) filter (where y is null) as only_left, count(*) filter (where x is null) as only_right, count(*) filter (where abs(x - y) <= 1e-15 + 1e-12 * abs(y)) as equal, count(*) filter (where abs(x - y) > 1e-15 + 1e-12 * abs(y)) as different from j")
def horizon_reconciliation(spark, sf_dir):
    """One-hour targets by rows against the targets of horizon 1 by time."""
    bars = hourly(spark, sf_dir, by_type=True)
    a = targets.one_hour(bars).select("symbol", "decision_time", F.col("future_log_return_1h").alias("value"))
    b = targets.horizon_targets(bars).filter("horizon = 1").select("symbol", "decision_time", "value")
    return dg.reconciliation(a, b, ["symbol", "decision_time"])


@query(f"with {BASE}, {ELIGIBLE_SQL}, a as (select symbol, decision_time from smp), b as (select symbol, decision_time from elig where reason = 'usable') (select * from a except select * from b) union all (select * from b except select * from a)")
def anchor_symmetric_difference(spark, sf_dir):
    """Decisions with a target but no whole feature window, or the other way about."""
    own = eligible(f0_features(hourly(spark, sf_dir, by_type=True))).filter("eligible").select("symbol", "decision_time")
    return dg.symmetric_difference(samples(spark, sf_dir).select("symbol", "decision_time"), own)


@query(f"with {HB} select c.symbol, c.decision_time, h.horizon, round(h.value, 9) as value, round(c.sigma, 9) as sigma from cmn c join hx h on h.symbol = c.symbol and h.decision_time = c.decision_time")
def horizon_targets_on_anchors(spark, sf_dir):
    """All horizons' targets of the common anchors; an anchor without one raises."""
    anchors = common(spark, sf_dir).withColumn("horizon", F.explode(F.lit(list(targets.HORIZONS))))
    values = targets.horizon_targets(hourly(spark, sf_dir, by_type=True)).select("symbol", "decision_time", "horizon", "value")
    return dg.must_hit(anchors, values, ["symbol", "decision_time", "horizon"], "value").select("symbol", "decision_time", "horizon", "value", "sigma")


@query(f"with {HB}, x as (select symbol, decision_time, row_number() over (partition by symbol order by decision_time) - 1 as position, count(*) over (partition by symbol) as n from cmn) select symbol, decision_time, position from x where n >= 9 and (position < 3 or abs(position - n // 2) <= 1 or position >= n - 3)")
def alignment_sample(spark, sf_dir):
    return dg.alignment_sample(common(spark, sf_dir).select("symbol", "decision_time"))


@query(f"with {BASE}, x as (select *, row_number() over (partition by symbol order by decision_time) as r from smp) select symbol, count(*) as samples, min(decision_time) as first_decision, max(decision_time) as last_decision, round(sum(y), 9) as y_sum from x where r <= 512 group by symbol")
def first_512(spark, sf_dir):
    """The first 512 samples of each symbol, as for a fit that must overfit."""
    d = samples(spark, sf_dir).withColumn("r", F.row_number().over(sp.by_decision())).filter("r <= 512")
    return d.groupBy("symbol").agg(F.count("*").alias("samples"), F.min("decision_time").alias("first_decision"), F.max("decision_time").alias("last_decision"), F.sum("y").alias("y_sum"))


@query(f"with {TYPED}, {segments_sql()}, g as (select symbol, lag(open_time) over (partition by symbol order by open_time) + interval 1 hour as gap_start, date_diff('hour', lag(open_time) over (partition by symbol order by open_time), open_time) - 1 as missing from seg) select symbol, arg_max(gap_start, missing * 100000000 - epoch(gap_start) / 3600) as gap_start, max(missing) as missing from g where missing > 0 group by symbol")
def longest_gaps(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("open_time")
    us = micros("open_time")
    d = hourly(spark, sf_dir, by_type=True).select("symbol", from_micros(F.lag(us).over(w) + HOUR).alias("gap_start"), ((us - F.lag(us).over(w)) / HOUR - 1).cast("long").alias("missing")).filter("missing > 0")
    return dg.longest_gap(d, ["symbol"], "gap_start", "missing")


# --- labels: calibration, degradation, regimes -----------------------------------------------------


@query(f"with {BASE}, b as (select symbol, decision_time, ntile(6) over (partition by symbol order by decision_time) as block from smp), f as (select b.*, fold::integer as fold, min(case when block = fold + 2 then decision_time end) over (partition by symbol, fold) as first_ev from b, range(1, 5) t(fold) where block <= fold + 2) select symbol, fold, count(*) filter (where decision_time + interval 1 hour < first_ev) as safe, count(*) filter (where not decision_time + interval 1 hour < first_ev) as purged from f where block < fold + 2 group by all")
def calibration_positions(spark, sf_dir):
    return dg.calibration_rows(samples(spark, sf_dir))


_AGREE = "avg(case when {0} <> 0 then (sign(y) = {0})::int end)"
HYST_ADAPTIVE = HYST.replace("label_fixed as c", "label_adaptive as c").replace("from lbl),", "from lbl where label_adaptive is not null),")


@query(f"{LB}, {HYST_ADAPTIVE}, bk as (select symbol, decision_time, y, label_adaptive, ntile(6) over (partition by symbol order by decision_time)::integer as block from lbl where label_adaptive is not null), ag as (select bk.symbol, block, {_AGREE.format('label_adaptive')} as a, {_AGREE.format('state')} as b from bk join hy on hy.symbol = bk.symbol and hy.decision_time = bk.decision_time where block > 2 group by all) select symbol, round(avg(a), 9) as mean_before, round(avg(b), 9) as mean_after, round(100 * (avg(b) - avg(a)), 9) as percentage_points, coalesce(avg(b) < avg(a) - 0.05, false) as degraded from ag group by symbol")
def semantic_degradation(spark, sf_dir):
    """Agreement of signs of the adaptive labels, before and after hysteresis, over the evaluation blocks."""
    d = labelled(spark, sf_dir).filter("label_adaptive is not null")
    smooth = lab.hysteresis_labels(d, "label_adaptive").select("symbol", "decision_time", F.col("label").alias("smooth"))
    d = sp.blocks(dg.one_to_one(d, smooth, ["symbol", "decision_time"]), 6).filter("block > 2")
    agreement = d.groupBy("symbol", "block").agg(dg.sign_agreement(F.col("label_adaptive"), F.col("y")).alias("a"), dg.sign_agreement(F.col("smooth"), F.col("y")).alias("b"))
    return dg.semantic_degradation(agreement, ["symbol"], "a", "b")


_REGIME_RUNS = RUNS.replace("partition by symbol order by", "partition by symbol, regime order by").replace("select symbol, run, count", "select symbol, regime, run, count").replace("from lbl window", "from lbl where regime is not null window")


@query(f"{LB}, {_REGIME_RUNS} select symbol, regime, count(*) as runs, sum(tr)::bigint as transitions, round(1000 * sum(tr) / sum(length), 9) as transitions_per_1000, round(avg(length), 9) as mean_duration, round(quantile_cont(length, 0.5), 9) as median_duration, round(quantile_cont(length, 0.9), 9) as p90_duration, max(length) as max_duration from r2 group by all")
def regime_runs(spark, sf_dir):
    return lab.temporal_behaviour(labelled(spark, sf_dir).filter("regime is not null"), ["symbol", "regime"], "label_fixed")


@query(f"{LB} select symbol, regime, label_fixed as label, count(*) as samples, round(avg(y), 9) as mean_return, round(quantile_cont(y, 0.5), 9) as median_return, round(avg((y > 0)::int), 9) as positive_share, round(avg(case when label_fixed <> 0 then (sign(y) = label_fixed)::int end), 9) as sign_agreement from lbl where regime is not null group by all")
def regime_semantics(spark, sf_dir):
    return lab.semantics(labelled(spark, sf_dir).filter("regime is not null"), ["symbol", "regime"], "label_fixed")


@query(f"{LB} select symbol, count(*) as labels, count(*) filter (where label_fixed = 0) as neutral from lbl group by symbol")
def label_domain(spark, sf_dir):
    """Counts of labels that were checked to be -1, 0 or 1, with finite returns."""
    d = dg.finite_values(dg.label_domain(labelled(spark, sf_dir), "label_fixed"), "y").filter("y is not null")
    return d.groupBy("symbol").agg(F.count("label_fixed").alias("labels"), F.count_if(F.col("label_fixed") == 0).alias("neutral"))


# --- gates and winners -----------------------------------------------------------------------------

FIVE = f"{BASE}, z as (select symbol, y, p, ntile(5) over (partition by symbol order by decision_time)::integer as block from smp), mv as ({metrics_sql('z', 'symbol, block')}), mw as (select *, round(1 - sqrt(1 - mse_skill), 9) as rmse_skill from mv)"


def five_units(spark, sf_dir) -> DataFrame:
    return rounded(rounded(mt.regression_metrics(sp.blocks(samples(spark, sf_dir).select("symbol", "decision_time", "y", "p"), 5), ["symbol", "block"])).withColumn("rmse_skill", dg.rmse_skill()))


_GOOD = {m: f"coalesce({m} > {b}, false)" for m, b in dg.REGRESSION_GATE.items()}


_MEANS = ", ".join(f"avg({m}) as mean_{m}" for m in dg.POSITIVE_MEANS)
_MEANS_OUT = ", ".join(f"round(mean_{m}, 9) as mean_{m}" for m in dg.POSITIVE_MEANS)
_MEANS_GOOD = "coalesce(least(" + ", ".join(f"mean_{m}" for m in dg.POSITIVE_MEANS) + ") > 0, false)"
_TEMPORAL = f"c as (select symbol, count(*) filter (where {' and '.join(_GOOD.values())}) as positive_folds, {_MEANS} from mw group by symbol), tg as (select *, positive_folds >= 3 and {_MEANS_GOOD} as stable from c)"


@query(f"with {FIVE}, c as (select symbol, count(*) as units, " + ", ".join(f"count(*) filter (where {g}) as good_{m}" for m, g in _GOOD.items()) + f", {_MEANS} from mw group by symbol) select * exclude ({', '.join('mean_' + m for m in dg.POSITIVE_MEANS)}), {_MEANS_OUT}, least({', '.join('good_' + m for m in _GOOD)}) >= 4 and {_MEANS_GOOD} as stable from c")
def seed_stability_gate(spark, sf_dir):
    """Six conditions, each in at least four of five units, and positive means."""
    return dg.seed_gate(five_units(spark, sf_dir), ["symbol"], 4)


@query(f"with {FIVE}, {_TEMPORAL} select symbol, positive_folds, {_MEANS_OUT}, stable from tg")
def temporal_stability_gate(spark, sf_dir):
    return dg.temporal_gate(five_units(spark, sf_dir), ["symbol"])


@query(f"with {FIVE} select symbol, count(*) filter (where coalesce(directional_accuracy > 0.5, false)) as folds_directional_accuracy, count(*) filter (where coalesce(ic > 0, false)) as folds_ic, count(*) filter (where coalesce(rank_ic > 0, false)) as folds_rank_ic, round(avg(directional_accuracy), 9) as mean_directional_accuracy, round(avg(ic), 9) as mean_ic, round(avg(rank_ic), 9) as mean_rank_ic from mw group by symbol")
def direction_rank_diagnostics(spark, sf_dir):
    return dg.direction_diagnostics(five_units(spark, sf_dir), ["symbol"])


_ORDER = ["positive_folds", "mean_rmse_skill", "mean_mae_skill", "mean_r2"]


@query(f"with {FIVE}, {_TEMPORAL} select symbol, positive_folds, {_MEANS_OUT}, stable from tg where stable order by {', '.join(c + ' desc' for c in _ORDER)} limit 1")
def frozen_winner(spark, sf_dir):
    """The best of the symbols that pass the gate, by four keys; none passes: no row. A tie on all four raises."""
    return evaluation.selected(dg.temporal_gate(five_units(spark, sf_dir), ["symbol"]), "stable", _ORDER, "symbol")


@query(f"with {FIVE}, {_TEMPORAL} select symbol, positive_folds, {_MEANS_OUT}, stable, rank() over (order by stable desc, {', '.join(c + ' desc nulls last' for c in _ORDER)})::integer as place from tg")
def gate_ranking(spark, sf_dir):
    """All candidates: those that pass first, by the winner's keys."""
    return gates.ranked(dg.temporal_gate(five_units(spark, sf_dir), ["symbol"]), ["stable", *_ORDER]).drop("tied")


@query(f"with {FIVE} select symbol, arg_min(block, rmse * 1e12 + block) as block, min(rmse) as rmse from mw group by symbol")
def lowest_loss_block(spark, sf_dir):
    return dg.lowest_loss(five_units(spark, sf_dir), ["symbol"], "block", "rmse")


_CE = f"""{LB}, ce as (select lbl.symbol, decision_time, label_fixed as actual, case when p > tau then 1 when p < -tau then -1 else 0 end as predicted from lbl join cal using (symbol) where p is not null),
eb as (select *, ntile(6) over (partition by symbol order by decision_time) as block from ce),
ef as (select eb.*, fold::integer as fold, block = fold + 2 as ev from eb, range(1, 5) t(fold) where block <= fold + 2),
eg as (select *, min(case when ev then decision_time end) over (partition by symbol, fold) as first_ev from ef),
pn as (select symbol, fold, actual as c, count(*) as n from eg where not ev and decision_time + interval 1 hour < first_ev group by all),
pri as (select symbol, fold, arg_max(c, n * 10 - c) as majority, {', '.join(f"coalesce(sum(n) filter (where c = {c}), 0) / sum(n) as prior_{i}" for i, c in enumerate((-1, 0, 1)))} from pn group by all),
ev as (select eg.symbol, fold, decision_time, actual, predicted, majority, prior_0, prior_1, prior_2 from eg join pri using (symbol, fold) where ev)"""


def _hard_sql(name: str, predicted: str) -> str:
    """CTEs: the class table and the hard metrics of a prediction over ``ev``."""
    return f"""{name}0 as (select symbol, fold, k as class, count(*) filter (where actual = k) as t, count(*) filter (where actual = k and {predicted} = k) as hit, count(*) filter (where {predicted} = k) as g from ev, (select unnest([-1, 0, 1]) as k) group by all),
{name}1 as (select *, coalesce(hit / nullif(g, 0), 0) as precision, coalesce(hit / nullif(t, 0), 0) as recall from {name}0),
{name}2 as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from {name}1),
{name} as (select symbol, fold, sum(t)::bigint as samples, sum(hit) / sum(t) as accuracy, avg(case when t > 0 then recall end) as balanced_accuracy, avg(precision) as macro_precision, avg(recall) as macro_recall, avg(f1) as macro_f1,
  coalesce((sum(hit) * sum(t) - sum(t * g)) / nullif(sqrt((sum(t) * sum(t) - sum(g * g))::double) * sqrt((sum(t) * sum(t) - sum(t * t))::double), 0), 0) as mcc from {name}2 group by all)"""


def _scores_sql(name: str, p: list[str]) -> str:
    brier = " + ".join(f"pow({x} - (actual = {c})::int, 2)" for x, c in zip(p, (-1, 0, 1)))
    return f"{name} as (select symbol, fold, avg({brier}) as brier, avg(-ln(greatest(case actual when -1 then {p[0]} when 0 then {p[1]} else {p[2]} end, 1e-15))) as log_loss from ev group by all)"


_EVALUATION = f"""{_CE}, {_hard_sql('hm', 'predicted')}, {_hard_sql('tm', 'majority')}, {_hard_sql('an', '0')}, {_scores_sql('sc', [f"(predicted = {c})::int" for c in (-1, 0, 1)])}, {_scores_sql('sp_', ['prior_0', 'prior_1', 'prior_2'])},
mv as (select *, lag(predicted) over w as before, decision_time - lag(decision_time) over w = interval 1 hour as near from ev window w as (partition by symbol, fold order by decision_time)),
ac as (select symbol, fold, any_value(majority) as train_majority_class, avg((predicted = -1)::int) as down_share, avg((predicted = 0)::int) as neutral_share, avg((predicted = 1)::int) as up_share, count(*) filter (where coalesce(near, false) and predicted <> before) as transitions, count(*) filter (where coalesce(near, false) and predicted <> before) * 1000.0 / count(*) as transitions_per_1000 from mv group by all),
ce_all as (select hm.*, tm.accuracy as train_majority_accuracy, tm.balanced_accuracy as train_majority_balanced_accuracy, tm.macro_f1 as train_majority_macro_f1, an.accuracy as always_neutral_accuracy, an.balanced_accuracy as always_neutral_balanced_accuracy, an.macro_f1 as always_neutral_macro_f1,
  sc.brier, sc.log_loss, sp_.brier as train_prior_brier, sp_.log_loss as train_prior_log_loss, ac.* exclude (symbol, fold), (hm.mcc > 0)::int::double as mcc_above_zero from hm join tm using (symbol, fold) join an using (symbol, fold) join sc using (symbol, fold) join sp_ using (symbol, fold) join ac using (symbol, fold))"""
_WHOLE = ("samples", "train_majority_class", "transitions")
_EVALUATED = ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "mcc", "train_majority_accuracy", "train_majority_balanced_accuracy", "train_majority_macro_f1", "always_neutral_accuracy", "always_neutral_balanced_accuracy", "always_neutral_macro_f1", "brier", "log_loss", "train_prior_brier", "train_prior_log_loss", "down_share", "neutral_share", "up_share", "transitions_per_1000", "mcc_above_zero")


@query(f"{_EVALUATION} select symbol, fold, {', '.join(_WHOLE)}, {', '.join(f'round({c}, 9) as {c}' for c in _EVALUATED)} from ce_all")
def classification_folds(spark, sf_dir):
    """Every fold's evaluation: hard metrics, scores, baselines of its training labels, activity."""
    return evaluation.class_evaluation(predictions(spark, sf_dir))


@query(f"{_CE}, {_hard_sql('hm', 'predicted')} select symbol, fold, class, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, t as support from hm2")
def classification_per_class(spark, sf_dir):
    return evaluation.per_class(evaluation.with_roles(predictions(spark, sf_dir)).filter("not trains"))


@query(f"{_EVALUATION}, u as (" + " union all ".join(f"select symbol, '{m}' as metric, {m}::double as value from ce_all" for m in evaluation.PRIMARY) + ") select symbol, metric, round(avg(value), 9) as mean, round(median(value), 9) as median, round(stddev_pop(value), 9) as std, round(min(value), 9) as min_value, round(max(value), 9) as max_value from u group by all")
def classification_aggregate(spark, sf_dir):
    """18 metrics over the folds of a symbol."""
    return evaluation.aggregated(evaluation.class_evaluation(predictions(spark, sf_dir)))


_CLASS_GATE = f"""{_EVALUATION}, cg as (select symbol, count(*) filter (where balanced_accuracy > 1.0 / 3 and mcc > 0 and macro_f1 > train_majority_macro_f1) as positive_folds, avg(balanced_accuracy) as mean_balanced_accuracy, avg(mcc) as mean_mcc, avg(macro_f1) as mean_macro_f1, avg(train_majority_macro_f1) as mean_majority_macro_f1 from ce_all group by symbol),
cs as (select *, positive_folds >= 3 and mean_balanced_accuracy > 1.0 / 3 and mean_mcc > 0 and mean_macro_f1 > mean_majority_macro_f1 as stable from cg)"""
_CLASS_OUT = "symbol, positive_folds, " + ", ".join(f"round({c}, 9) as {c}" for c in ("mean_balanced_accuracy", "mean_mcc", "mean_macro_f1", "mean_majority_macro_f1")) + ", stable"


def _class_gate(spark, sf_dir) -> DataFrame:
    return dg.classification_gate(evaluation.class_evaluation(predictions(spark, sf_dir)).withColumnRenamed("train_majority_macro_f1", "majority_macro_f1"), ["symbol"])


@query(f"{_CLASS_GATE} select {_CLASS_OUT} from cs")
def classification_stability_gate(spark, sf_dir):
    """The previous return's labels on four walk-forward folds; baseline: always the training rows' most frequent label."""
    return _class_gate(spark, sf_dir)


@query(f"{_CLASS_GATE} select {_CLASS_OUT} from cs where stable order by positive_folds desc, cs.mean_balanced_accuracy desc, cs.mean_macro_f1 desc, cs.mean_mcc desc limit 1")
def label_winner(spark, sf_dir):
    """The best of the candidates whose classification is stable; none: no row."""
    return evaluation.selected(_class_gate(spark, sf_dir), "stable", ["positive_folds", "mean_balanced_accuracy", "mean_macro_f1", "mean_mcc"], "symbol")


_SCALES = f"""{BASE}, {ELIGIBLE_SQL}, {HORIZON_SQL}, {COMMON}, {SPLIT_SQL}, hs0 as (select c.symbol, h.horizon, sqrt(avg((h.value / c.sigma) * (h.value / c.sigma))) as rms from cmn c join hx h on h.symbol = c.symbol and h.decision_time = c.decision_time join spl t on t.symbol = c.symbol and t.decision_time = c.decision_time where t.split = 'train' and not t.purged group by all), hs as (select s.symbol, s.horizon, s.rms / b.rms as scale from hs0 s join hs0 b on b.symbol = s.symbol and b.horizon = 1)"""


@query(f"with {_SCALES}, pv as (select symbol, decision_time, log_return_1h as p from f0), x as (select c.symbol, c.decision_time, h.horizon, h.value as y, c.sigma, pv.p / c.sigma as zp, hs.scale from cmn c join hx h on h.symbol = c.symbol and h.decision_time = c.decision_time join pv on pv.symbol = c.symbol and pv.decision_time = c.decision_time join hs on hs.symbol = c.symbol and hs.horizon = h.horizon join spl t on t.symbol = c.symbol and t.decision_time = c.decision_time where c.sigma > 0 and t.split = 'validation' and not t.purged), w as (select symbol, horizon, y, zp * scale * sigma as p from x where zp is not null) select symbol, horizon, count(*) as samples, round(avg(abs(y - p)), 9) as mae, round(sqrt(avg((y - p) * (y - p))), 9) as rmse, {_corr_sql('y', 'p')} as ic, round(avg(case when abs(y) > 1e-12 then (sign(y) = sign(p))::int end), 9) as directional_accuracy from w group by all")
def horizon_evaluation(spark, sf_dir):
    """Validation rows: predictions in units of sigma, scaled by what each horizon's targets spread on training rows, brought back to returns."""
    bars = hourly(spark, sf_dir, by_type=True)
    split = sp.frozen_split(samples(spark, sf_dir).select("symbol", "decision_time", "target_time")).filter("split = 'validation' and not purged")
    anchors = common(spark, sf_dir).filter("sigma > 0").join(split.select("symbol", "decision_time"), ["symbol", "decision_time"], "left_semi")
    y = targets.horizon_targets(bars).select("symbol", "decision_time", "horizon", F.col("value").alias("y"))
    p = f0_features(bars).select("symbol", "decision_time", F.col("log_return_1h").alias("p"))
    d = anchors.join(y, ["symbol", "decision_time"]).join(p, ["symbol", "decision_time"])
    d = d.join(relative_horizon_scale(spark, sf_dir).select("symbol", "horizon", "scale"), ["symbol", "horizon"])
    return dg.raw_metrics(d.withColumn("zp", F.col("p") / F.col("sigma") * F.col("scale")), ["symbol", "horizon"])


@query(f"with fw as ({_walk_sql(1)}), {BASE}, t as (select smp.*, fold from smp join fw on fw.symbol = smp.symbol and fw.decision_time = smp.decision_time where role = 'inner_train'), u as (" + " union all ".join(f"select symbol, fold, '{c}' as feature, {c} as value from t" for c in F0) + ") select symbol, fold, feature, round(quantile_cont(value, 0.5), 9) as center, round(case when quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 0 then quantile_cont(value, 0.75) - quantile_cont(value, 0.25) else 1.0 end, 9) as scale from u where value is not null group by all")
def fold_scaler_stats(spark, sf_dir):
    """Median and quartile width of each feature on each fold's inner training rows alone."""
    d = staged(samples(spark, sf_dir), "samples")
    inner = sp.walk_forward(d, 1).filter("role = 'inner_train'").select("symbol", "fold", "decision_time")
    return linear.scaler_statistics(d.join(inner, ["symbol", "decision_time"]), ["symbol", "fold"], list(F0))


_UNITS = {"eligible": "sigma > 0", "scored": "p is not null", "whole": "y is not null"}


@query(f"with {BASE}, u as (" + " union all ".join(f"select '{k}' as unit, symbol, decision_time from smp where {c}" for k, c in _UNITS.items()) + f"), i as (select symbol, unit, sha256(unhex(string_agg({LITTLE_ENDIAN}, '' order by decision_time))) as identity from u group by all) select symbol as scope, count(*) as units, count(distinct identity) = 1 as identical from i group by symbol")
def seed_identity(spark, sf_dir):
    """Whether three ways to choose a symbol's samples end at the same ones, by their identities."""
    d = samples(spark, sf_dir)
    own = None
    for unit, condition in _UNITS.items():
        one = sp.sample_identity(d.filter(condition)).select(F.col("symbol").alias("scope"), F.lit(unit).alias("unit"), "identity")
        own = one if own is None else own.unionByName(one)
    return gates.identical_samples(own)


# --- windows ---------------------------------------------------------------------------------------


@query(f"with {TYPED}, {segments_sql()}, {F0_SQL}, {ELIGIBLE_SQL}, q as (select symbol, decision_time, reason, list([{', '.join(f'round({c}, 9)' for c in F0)}]) over w as win, list(round(log_return_1h, 9)) over w as ret from elig window w as (partition by symbol, segment order by open_time rows between 23 preceding and current row)) select symbol, decision_time, len(win)::bigint as steps, len(win[1])::bigint as width, win[24][1] as last_first, win[1][10] as first_last, len(ret)::bigint as return_steps, round(list_sum(ret), 9) as return_sum from q where reason = 'usable'")
def lookback_window_views(spark, sf_dir):
    """24 x 10 windows as arrays of rows, and their projection on returns (24 x 1)."""
    w = Window.partitionBy("symbol", "segment").orderBy("open_time").rowsBetween(-23, 0)
    d = eligible(f0_features(hourly(spark, sf_dir, by_type=True)))
    d = d.withColumn("win", F.collect_list(F.array(*(F.round(c, 9) for c in F0))).over(w)).filter("eligible")
    d = d.withColumn("ret", F.transform("win", lambda r: F.get(r, F.lit(F0.index("log_return_1h") if isinstance(F0, list | tuple) else list(F0).index("log_return_1h")))))
    return d.select("symbol", "decision_time", F.size("win").cast("long").alias("steps"), F.size(F.get("win", F.lit(0))).cast("long").alias("width"), F.get(F.get("win", F.lit(23)), F.lit(0)).alias("last_first"), F.get(F.get("win", F.lit(0)), F.lit(9)).alias("first_last"), F.size("ret").cast("long").alias("return_steps"), F.aggregate("ret", F.lit(0.0), lambda a, x: a + x).alias("return_sum"))


LAGGED = [(lag, c) for lag in range(23, -1, -1) for c in F0]


def window_rows(bars: DataFrame) -> DataFrame:
    """Samples whose 24 hours of features are whole, as 240 columns, with y, sigma and the split."""
    w = Window.partitionBy("symbol", "segment").orderBy("open_time")
    own = eligible(f0_features(bars))
    wide = own.select("symbol", "decision_time", "eligible", F.col("rolling_volatility_24h").alias("sigma"), *(F.lag(c, lag).over(w).alias(f"{c}_{lag}") for lag, c in LAGGED)).filter("eligible").drop("eligible")
    y = sp.frozen_split(targets.one_hour(bars).select("symbol", "decision_time", "target_time", F.col("future_log_return_1h").alias("y")))
    return dg.one_to_one(y, wide, ["symbol", "decision_time"])


def window_ridge(bars: DataFrame, normalized: bool) -> DataFrame:
    """Ridge on flattened windows, fitted on train; metrics of train and validation beside those of the zero prediction."""
    d = dg.sigma_selected(window_rows(bars)).filter("split <> 'test' and not purged" + (" and usable" if normalized else ""))
    d = d.withColumn("fitted", F.col("y") / F.col("sigma") if normalized else F.col("y"))
    names = [f"{c}_{lag}" for lag, c in LAGGED]
    d = staged(d, "window-rows")
    model = linear.fit_ridge(d.filter("split = 'train'"), names, "fitted")
    d = model.predicted(d)
    d = d.withColumn("p", F.col("p") * F.col("sigma")) if normalized else d
    own = mt.regression_metrics(d.select("symbol", "split", "y", "p"), ["symbol", "split"])
    zero = mt.regression_metrics(d.select("symbol", "split", "y", F.lit(0.0).alias("p")), ["symbol", "split"]).select("symbol", "split", F.col("mae").alias("zero_mae"), F.col("rmse").alias("zero_rmse"))
    return own.join(zero, ["symbol", "split"]).withColumns({"zero_mae_skill": 1 - F.try_divide("mae", "zero_mae"), "zero_rmse_skill": 1 - F.try_divide("rmse", "zero_rmse")})


@query()
def ridge_24x10(spark, sf_dir):
    return window_ridge(hourly(spark, sf_dir), False)


@query()
def vn_ridge_24x10(spark, sf_dir):
    return window_ridge(hourly(spark, sf_dir), True)
