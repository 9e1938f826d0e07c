"""Queries over splits, folds, metrics, distributions and labels, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR, from_micros, micros, rounded, safe_corr
from tidemark.operators import labels as lab
from tidemark.operators import metrics as mt
from tidemark.operators import splits as sp
from tidemark.operators import targets
from tidemark.operators.f0 import F0, eligible, f0_features
from tidemark.operators.recurrent_features import label_atr
from tidemark.plans.market_queries import ELIGIBLE_SQL, F0_SQL, HORIZON_SQL, TARGET_SQL, TYPED, segments_sql
from tidemark.sources.bars import hourly

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def samples(spark, sf_dir) -> DataFrame:
    """Hourly rows of every event type with a one-hour target y, volatility sigma and previous return p."""
    bars = hourly(spark, sf_dir, by_type=True)
    features = f0_features(bars).select("symbol", "segment", "decision_time", *F0)
    y = targets.one_hour(bars).select("symbol", "decision_time", "target_time", F.col("future_log_return_1h").alias("y"))
    return y.join(features, ["symbol", "decision_time"]).withColumns({"sigma": F.col("rolling_volatility_24h"), "p": F.col("log_return_1h")})


def with_atr(spark, sf_dir) -> DataFrame:
    bars = hourly(spark, sf_dir, by_type=True)
    atr = label_atr(bars).select("symbol", from_micros(micros("open_time") + HOUR).alias("decision_time"), "atr_pct")
    return samples(spark, sf_dir).join(atr, ["symbol", "decision_time"])


BASE = f"{TYPED}, {segments_sql()}, {F0_SQL}, {TARGET_SQL}, smp as (select t.symbol, f.segment, t.decision_time, t.target_time, t.future_log_return_1h as y, f.rolling_volatility_24h as sigma, f.log_return_1h as p, {', '.join('f.' + c for c in F0)} from tgt t join f0 f on f.symbol = t.symbol and f.decision_time = t.decision_time)"

# --- splits -----------------------------------------------------------------------------------

SPLIT_SQL = """sp0 as (select *, row_number() over (partition by symbol order by decision_time) - 1 as pos, count(*) over (partition by symbol) as n from smp),
sp1 as (select *, n * 70 // 100 as nt, n * 15 // 100 as nv from sp0),
sp2 as (select *, max(case when pos = nt then decision_time end) over (partition by symbol) as vs, max(case when pos = nt + nv then decision_time end) over (partition by symbol) as ts from sp1),
spl as (select *, case when pos < nt then 'train' when pos < nt + nv then 'validation' else 'test' end as split, case when pos < nt then coalesce(target_time >= vs, false) when pos < nt + nv then coalesce(target_time >= ts, false) else false end as purged from sp2)"""


@query(f"with {BASE}, {SPLIT_SQL} select symbol, decision_time, target_time, split, purged from spl")
def frozen_split(spark, sf_dir):
    return sp.frozen_split(samples(spark, sf_dir).select("symbol", "decision_time", "target_time"))


@query(f"with {BASE}, {SPLIT_SQL} select symbol, split, count(*) filter (where not purged) as rows_kept, count(*) filter (where purged) as rows_purged, min(decision_time) as first_decision, max(decision_time) as last_decision, max(target_time) filter (where not purged) as last_kept_target from spl group by all")
def frozen_split_summary(spark, sf_dir):
    return sp.split_summary(sp.frozen_split(samples(spark, sf_dir).select("symbol", "decision_time", "target_time")))


@query(f"with {BASE}, x as (select symbol, decision_time, target_time, row_number() over (partition by symbol order by target_time) as r, count(*) over (partition by symbol) as n from smp) select symbol, decision_time, target_time, case when r <= n * 70 // 100 then 'train' when r <= n * 70 // 100 + n * 15 // 100 then 'validation' else 'test' end as split from x")
def split_helper(spark, sf_dir):
    return sp.split_by_target(samples(spark, sf_dir).select("symbol", "decision_time", "target_time"))


@query(f"with {BASE} select symbol, decision_time, ntile(6) over (partition by symbol order by decision_time)::integer as block from smp")
def chronological_blocks(spark, sf_dir):
    return sp.blocks(samples(spark, sf_dir).select("symbol", "decision_time"))


def _walk_sql(hours: int) -> str:
    return f"""with {BASE}, b as (select symbol, decision_time, ntile(6) over (partition by symbol order by decision_time) as block from smp),
f as (select b.*, fold::integer as fold, block = fold + 2 as ev from b, range(1, 5) t(fold) where block <= fold + 2),
g as (select *, min(case when ev then decision_time end) over (partition by symbol, fold) as first_ev from f),
h as (select *, not ev and decision_time + interval {hours} hours < first_ev as pool from g),
i as (select *, sum(pool::int) over (partition by symbol, fold order by decision_time) as in_pool, sum(pool::int) over (partition by symbol, fold) as size from h),
j as (select *, pool and in_pool > size - greatest(1, size * 15 // 100) as inn from i),
k as (select *, min(case when inn then decision_time end) over (partition by symbol, fold) as first_in from j)
select symbol, fold, decision_time, case when ev then 'evaluation' when not pool then 'purged' when inn then 'inner_validation' when decision_time + interval {hours} hours < first_in then 'inner_train' else 'inner_purged' end as role from k"""


@query(_walk_sql(1))
def walkforward_design_1h(spark, sf_dir):
    return sp.walk_forward(samples(spark, sf_dir), 1)


@query(_walk_sql(12))
def walkforward_design_12h(spark, sf_dir):
    return sp.walk_forward(samples(spark, sf_dir), 12)


LITTLE_ENDIAN = " || ".join(f"substr(printf('%016X', epoch_us(decision_time)), {k}, 2)" for k in range(15, 0, -2))


@query(f"with {BASE} select symbol, count(*) as samples, sha256(unhex(string_agg({LITTLE_ENDIAN}, '' order by decision_time))) as identity from smp group by symbol")
def sample_identity(spark, sf_dir):
    return sp.sample_identity(samples(spark, sf_dir))


# --- windows and anchors ----------------------------------------------------------------------


@query(f"with {TYPED}, {segments_sql()}, {F0_SQL}, {ELIGIBLE_SQL}, q as (select symbol, decision_time, reason, list({'[' + ', '.join(f'round({c}, 9)' for c in F0) + ']'}) over w as win from elig window w as (partition by symbol, segment order by open_time rows between 23 preceding and current row)) select symbol, decision_time, len(flatten(win)) as width, flatten(win)[1] as first_value, flatten(win)[240] as last_value, round(list_sum(flatten(win)), 6) as window_sum from q where reason = 'usable'")
def lookback_window_flat(spark, sf_dir):
    w = Window.partitionBy("symbol", "segment").orderBy("open_time").rowsBetween(-23, 0)
    d = eligible(f0_features(hourly(spark, sf_dir, by_type=True)))
    d = d.withColumn("win", F.collect_list(F.array(*(F.round(c, 9) for c in F0))).over(w)).filter("eligible").withColumn("flat", F.flatten("win"))
    return d.select("symbol", "decision_time", F.size("flat").cast("long").alias("width"), F.get("flat", F.lit(0)).alias("first_value"), F.get("flat", F.lit(239)).alias("last_value"), F.round(F.aggregate("flat", F.lit(0.0), lambda a, x: a + x), 6).alias("window_sum"))


COMMON = "cmn as (select e.symbol, e.decision_time, e.rolling_volatility_24h as sigma from elig e join (select symbol, decision_time from hx where outcome = 'ok' group by all having count(*) = 4) h on h.symbol = e.symbol and h.decision_time = e.decision_time where e.reason = 'usable')"
HB = f"{TYPED}, {segments_sql()}, {F0_SQL}, {ELIGIBLE_SQL}, {HORIZON_SQL}, {COMMON}"


def common(spark, sf_dir) -> DataFrame:
    """Anchors that are eligible and have all four horizon targets."""
    bars = hourly(spark, sf_dir, by_type=True)
    whole = targets.horizon_targets(bars).groupBy("symbol", "decision_time").agg(F.count("*").alias("n")).filter(F.col("n") == len(targets.HORIZONS))
    own = eligible(f0_features(bars)).filter("eligible").select("symbol", "decision_time", F.col("rolling_volatility_24h").alias("sigma"))
    return own.join(whole.select("symbol", "decision_time"), ["symbol", "decision_time"], "left_semi")


@query(f"with {HB} select symbol, decision_time from cmn")
def common_anchors(spark, sf_dir):
    return common(spark, sf_dir).select("symbol", "decision_time")


@query(f"with {BASE}, {ELIGIBLE_SQL}, {HORIZON_SQL}, {COMMON}, {SPLIT_SQL}, x as (select c.symbol, c.decision_time, h.horizon, h.value / c.sigma as z from cmn c join hx h on h.symbol = c.symbol and h.decision_time = c.decision_time join spl t on t.symbol = c.symbol and t.decision_time = c.decision_time where t.split = 'train' and not t.purged), s as (select symbol, horizon, sqrt(avg(z * z)) as rms from x group by all) select s.symbol, s.horizon, round(s.rms, 9) as rms, round(s.rms / b.rms, 9) as scale from s join s b on b.symbol = s.symbol and b.horizon = 1")
def relative_horizon_scale(spark, sf_dir):
    """Root mean square of y / sigma per horizon on training rows, relative to one hour."""
    train = sp.frozen_split(samples(spark, sf_dir).select("symbol", "decision_time", "target_time")).filter("split = 'train' and not purged")
    z = common(spark, sf_dir).join(train.select("symbol", "decision_time"), ["symbol", "decision_time"], "left_semi").join(targets.horizon_targets(hourly(spark, sf_dir, by_type=True)), ["symbol", "decision_time"]).withColumn("z", F.col("value") / F.col("sigma"))
    rms = z.groupBy("symbol", "horizon").agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("rms"))
    base = F.max(F.when(F.col("horizon") == 1, F.col("rms"))).over(Window.partitionBy("symbol"))
    return rms.withColumn("scale", F.try_divide("rms", base))


@query(f"with {BASE}, x as (select a.symbol, l.lag, a.y as a, b.y as b from smp a cross join (select unnest([1, 3, 6, 12, 24]) as lag) l join smp b on b.symbol = a.symbol and b.decision_time = a.decision_time - l.lag * interval 1 hour) select symbol, lag, count(*) as pairs, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 9) as autocorrelation from x group by all")
def autocorrelation_lags(spark, sf_dir):
    """Correlation of targets that stand exactly 1, 3, 6, 12 and 24 hours apart."""
    d = samples(spark, sf_dir).select("symbol", micros("decision_time").alias("us"), F.col("y").alias("a"))
    lags = d.withColumn("lag", F.explode(F.lit([1, 3, 6, 12, 24]))).withColumn("then", F.col("us") - F.col("lag").cast("long") * HOUR)
    return lags.join(d.select("symbol", F.col("us").alias("then"), F.col("a").alias("b")), ["symbol", "then"]).groupBy("symbol", "lag").agg(F.count("*").alias("pairs"), safe_corr(F.col("a"), F.col("b")).alias("autocorrelation"))


# --- metrics ----------------------------------------------------------------------------------


def _rank_sql(x: str, keys: str) -> str:
    return f"rank() over (partition by {keys} order by {x}) + (count(*) over (partition by {keys}, {x}) - 1) / 2.0"


def metrics_sql(source: str, keys: str) -> str:
    return f"""select {keys}, count(*) as samples, round(avg(abs(y - p)), 9) as mae, round(sqrt(avg((y - p) * (y - p))), 9) as rmse,
  round(case when var_pop(y) > 0 then 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) when sum((y - p) * (y - p)) = 0 then 1.0 else 0.0 end, 9) as r2,
  round(covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0), 9) as ic, round(covar_pop(yr, pr) / nullif(stddev_pop(yr) * stddev_pop(pr), 0), 9) as rank_ic,
  round(avg(case when abs(y) > 1e-12 then (sign(y) = sign(p))::int end), 9) as directional_accuracy, round(1 - avg((y - p) * (y - p)) / nullif(avg(y * y), 0), 9) as mse_skill, round(1 - avg(abs(y - p)) / nullif(avg(abs(y)), 0), 9) as mae_skill
  from (select *, {_rank_sql('y', keys)} as yr, {_rank_sql('p', keys)} as pr from {source} where y is not null and p is not null) group by {keys}"""


@query(f"with {BASE}, z as (select symbol, y, 0.0::double as p from smp) " + metrics_sql("z", "symbol"))
def zero_baseline_metrics(spark, sf_dir):
    return mt.regression_metrics(samples(spark, sf_dir).select("symbol", "y").withColumn("p", F.lit(0.0)), ["symbol"])


@query(f"with {BASE} " + metrics_sql("(select symbol, y, p from smp)", "symbol"))
def previous_return_metrics(spark, sf_dir):
    return mt.regression_metrics(samples(spark, sf_dir).select("symbol", "y", "p"), ["symbol"])


@query(f"with {BASE}, z as (select symbol, y, p, ntile(4) over (partition by symbol order by decision_time)::integer as block from smp) " + metrics_sql("z", "symbol, block"))
def metrics_by_block(spark, sf_dir):
    return mt.regression_metrics(sp.blocks(samples(spark, sf_dir).select("symbol", "decision_time", "y", "p"), 4), ["symbol", "block"])


def distribution_sql(source: str, keys: str, x: str) -> str:
    return f"select {keys}, count(*) as samples, round(avg({x}), 9) as mean, round(stddev_pop({x}), 9) as std, round(sqrt(avg({x} * {x})), 9) as rms, round(min({x}), 9) as min_value, round(max({x}), 9) as max_value, round(avg(abs({x})), 9) as mean_abs, round(quantile_cont(abs({x}), 0.5), 9) as median_abs, round(avg(({x} > 0)::int), 9) as positive_ratio, round(avg(({x} = 0)::int), 9) as zero_ratio, " + ", ".join(f"round(quantile_cont({x}, {q}), 9) as {k}" for k, q in mt.QUANTILES.items()) + f" from {source} where {x} is not null group by {keys}"


@query(f"with {TYPED}, {HORIZON_SQL}, v as (select symbol, horizon, value from hx where outcome = 'ok') " + distribution_sql("v", "symbol, horizon", "value"))
def raw_distribution(spark, sf_dir):
    return mt.distribution(targets.horizon_targets(hourly(spark, sf_dir, by_type=True)), ["symbol", "horizon"], "value")


@query(f"with {BASE}, v as (select symbol, y / sigma as z from smp where sigma > 0) " + distribution_sql("v", "symbol", "z"))
def normalized_distribution(spark, sf_dir):
    return mt.distribution(samples(spark, sf_dir).filter("sigma > 0").withColumn("z", F.col("y") / F.col("sigma")), ["symbol"], "z")


@query(f"with {BASE}, {SPLIT_SQL}, v as (select * from spl where not purged and split <> 'test') select symbol, round(stddev_pop(y) filter (where split = 'train'), 9) as train_std, round(stddev_pop(y) filter (where split = 'validation'), 9) as validation_std, round(stddev_pop(y) filter (where split = 'validation') / nullif(stddev_pop(y) filter (where split = 'train'), 0), 9) as std_ratio, round(avg(abs(y)) filter (where split = 'validation') / nullif(avg(abs(y)) filter (where split = 'train'), 0), 9) as mean_abs_ratio from v group by symbol")
def regime_ratio(spark, sf_dir):
    d = sp.frozen_split(samples(spark, sf_dir).select("symbol", "decision_time", "target_time", "y")).filter("not purged and split <> 'test'")
    of = lambda s: F.when(F.col("split") == s, F.col("y"))
    train, validation = F.stddev_pop(of("train")), F.stddev_pop(of("validation"))
    return d.groupBy("symbol").agg(train.alias("train_std"), validation.alias("validation_std"), F.try_divide(validation, train).alias("std_ratio"), F.try_divide(F.avg(F.abs(of("validation"))), F.avg(F.abs(of("train")))).alias("mean_abs_ratio"))


@query(f"with {HB}, v as (select c.symbol, c.decision_time, h.horizon, h.value from cmn c join hx h on h.symbol = c.symbol and h.decision_time = c.decision_time), r as (select *, {_rank_sql('value', 'symbol, horizon')} as rk from v) select a.symbol, a.horizon as left_horizon, b.horizon as right_horizon, count(*) as pairs, round(covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0), 9) as pearson, round(covar_pop(a.rk, b.rk) / nullif(stddev_pop(a.rk) * stddev_pop(b.rk), 0), 9) as spearman from r a join r b on a.symbol = b.symbol and a.decision_time = b.decision_time and a.horizon < b.horizon group by all")
def horizon_correlation_matrix(spark, sf_dir):
    v = common(spark, sf_dir).join(targets.horizon_targets(hourly(spark, sf_dir, by_type=True)), ["symbol", "decision_time"]).select("symbol", "decision_time", "horizon", "value")
    r = v.withColumn("rk", mt.average_rank(F.col("value"), ["symbol", "horizon"]))
    a, b = (r.select("symbol", "decision_time", *(F.col(c).alias(f"{s}_{c}") for c in ("horizon", "value", "rk"))) for s in ("left", "right"))
    return a.join(b, ["symbol", "decision_time"]).filter("left_horizon < right_horizon").groupBy("symbol", "left_horizon", "right_horizon").agg(F.count("*").alias("pairs"), safe_corr(F.col("left_value"), F.col("right_value")).alias("pearson"), safe_corr(F.col("left_rk"), F.col("right_rk")).alias("spearman"))


# --- labels -----------------------------------------------------------------------------------

ATR_SQL = """a0 as (select *, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as true_range from seg window w as (partition by symbol, segment order by open_time)),
aseed as (select symbol, segment, avg(true_range) as atr from a0 where row < 14 group by all having count(*) = 14),
awalk as (select s.symbol, s.segment, 13::bigint as row, s.atr from aseed s union all select a.symbol, a.segment, a.row, (13 * k.atr + a.true_range) / 14 from awalk k join a0 a on a.symbol = k.symbol and a.segment = k.segment and a.row = k.row + 1),
atr as (select a.symbol, a.open_time + interval 1 hour as decision_time, k.atr / a.close as atr_pct from a0 a left join awalk k on k.symbol = a.symbol and k.segment = a.segment and k.row = a.row)"""
LABEL_SQL = f"""{ATR_SQL}, sa as (select s.*, atr.atr_pct from smp s join atr using (symbol, decision_time)),
cal as (select symbol, quantile_cont(abs(y), 1.0 / 3) as tau, quantile_cont(abs(y / atr_pct), 1.0 / 3) as k, quantile_cont(sigma, 0.33) as low_cut, quantile_cont(sigma, 0.67) as high_cut from sa semi join (select symbol, decision_time from spl where split = 'train' and not purged) tr using (symbol, decision_time) group by symbol),
lbl as (select sa.*, case when y > tau then 1 when y < -tau then -1 else 0 end as label_fixed, case when y > k * atr_pct then 1 when y < -k * atr_pct then -1 when atr_pct is not null then 0 end as label_adaptive, case when sigma <= low_cut then 'LOW' when sigma <= high_cut then 'MID' when sigma is not null then 'HIGH' end as regime from sa join cal using (symbol))"""
LB = f"with recursive {BASE}, {SPLIT_SQL}, {LABEL_SQL}"


def training_rows(d: DataFrame) -> DataFrame:
    """The rows of ``d`` (one a decision) that calibrations may see: of the training period, not purged."""
    return sp.frozen_split(d).filter("split = 'train' and not purged")


def calibration(d: DataFrame) -> DataFrame:
    return lab.calibrated(training_rows(d))


def labelled(spark, sf_dir) -> DataFrame:
    d = with_atr(spark, sf_dir)
    return lab.labelled(d, calibration(d))


@query(f"{LB} select symbol, round(tau, 9) as tau, round(k, 9) as k, round(low_cut, 9) as low_cut, round(high_cut, 9) as high_cut from cal")
def label_calibration(spark, sf_dir):
    return calibration(with_atr(spark, sf_dir))


@query(f"{LB} select symbol, decision_time, label_fixed as label from lbl")
def label_fixed(spark, sf_dir):
    return labelled(spark, sf_dir).select("symbol", "decision_time", F.col("label_fixed").alias("label"))


@query(f"{LB} select symbol, decision_time, label_adaptive as label from lbl")
def label_adaptive(spark, sf_dir):
    return labelled(spark, sf_dir).select("symbol", "decision_time", F.col("label_adaptive").alias("label"))


@query(f"{LB} select symbol, regime, count(*) as samples, round(avg(abs(y)), 9) as mean_abs_return from lbl where regime is not null group by all")
def regimes(spark, sf_dir):
    return labelled(spark, sf_dir).filter("regime is not null").groupBy("symbol", "regime").agg(F.count("*").alias("samples"), F.avg(F.abs("y")).alias("mean_abs_return"))


HYST = """h0 as (select symbol, decision_time, label_fixed as c, row_number() over (partition by symbol order by decision_time) as r, coalesce(decision_time - lag(decision_time) over (partition by symbol order by decision_time) <> interval 1 hour, true) as gap from lbl),
hy as (select symbol, r, decision_time, c, 0 as state, case when c = 0 then null else c end as pend, case when c = 0 then 0 else 1 end as streak from h0 where r = 1
  union all select n.symbol, n.r, n.decision_time, n.c,
    case when n.c = s.st then s.st when (case when n.c = s.pe then s.sk + 1 else 1 end) = 3 then n.c else s.st end,
    case when n.c = s.st then null when (case when n.c = s.pe then s.sk + 1 else 1 end) = 3 then null else n.c end,
    case when n.c = s.st then 0 when (case when n.c = s.pe then s.sk + 1 else 1 end) = 3 then 0 else case when n.c = s.pe then s.sk + 1 else 1 end end
  from (select h.symbol as sy, h.r + 1 as nr, case when n0.gap then 0 else h.state end as st, case when n0.gap then null else h.pend end as pe, case when n0.gap then 0 else h.streak end as sk from hy h join h0 n0 on n0.symbol = h.symbol and n0.r = h.r + 1) s join h0 n on n.symbol = s.sy and n.r = s.nr)"""


@query(f"{LB}, {HYST} select symbol, decision_time, c::bigint as candidate, state::bigint as label from hy")
def label_hysteresis(spark, sf_dir):
    return lab.hysteresis_labels(labelled(spark, sf_dir), "label_fixed")


def structure_sql(source: str, keys: str, label: str) -> str:
    share = lambda c: f"count(*) filter (where {label} = {c}) / nullif(count({label}), 0)"
    return f"st as (select {keys}, count({label}) as samples, {share(-1)} as down_share, {share(0)} as neutral_share, {share(1)} as up_share from {source} group by {keys}), sx as (select *, greatest(down_share, neutral_share, up_share) as majority_share, (case when down_share > 0 then -down_share * ln(down_share) else 0 end + case when neutral_share > 0 then -neutral_share * ln(neutral_share) else 0 end + case when up_share > 0 then -up_share * ln(up_share) else 0 end) / ln(3.0) as entropy from st)"


_SHARES = "round(down_share, 9) as down_share, round(neutral_share, 9) as neutral_share, round(up_share, 9) as up_share, round(majority_share, 9) as majority_share, round(entropy, 9) as entropy"


@query(f"{LB}, {structure_sql('lbl', 'symbol, regime', 'label_fixed')} select symbol, regime, samples, {_SHARES} from sx")
def class_structure(spark, sf_dir):
    return lab.class_structure(labelled(spark, sf_dir), ["symbol", "regime"], "label_fixed")


RUNS = """r0 as (select *, coalesce(decision_time - lag(decision_time) over w <> interval 1 hour, true) as gap, coalesce(label_fixed <> lag(label_fixed) over w, true) as chg from lbl window w as (partition by symbol order by decision_time)),
r1 as (select *, sum((gap or chg)::int) over (partition by symbol order by decision_time) as run from r0),
r2 as (select symbol, run, count(*) as length, max((not gap and chg)::int) as tr from r1 group by all)"""


@query(f"{LB}, {RUNS} select symbol, count(*) as runs, sum(tr)::bigint as transitions, round(1000 * sum(tr) / sum(length), 9) as transitions_per_1000, round(avg(length), 9) as mean_duration, round(quantile_cont(length, 0.5), 9) as median_duration, round(quantile_cont(length, 0.9), 9) as p90_duration, max(length) as max_duration from r2 group by symbol")
def label_runs(spark, sf_dir):
    return lab.temporal_behaviour(labelled(spark, sf_dir), ["symbol"], "label_fixed")


@query(f"{LB} select symbol, label_fixed as label, count(*) as samples, round(avg(y), 9) as mean_return, round(quantile_cont(y, 0.5), 9) as median_return, round(avg((y > 0)::int), 9) as positive_share, round(avg(case when label_fixed <> 0 then (sign(y) = label_fixed)::int end), 9) as sign_agreement from lbl group by all")
def label_semantics(spark, sf_dir):
    return lab.semantics(labelled(spark, sf_dir), ["symbol"], "label_fixed")


@query(f"{LB}, {RUNS}, x as (select *, label_fixed = 1 as up, not gap and coalesce(lag(label_fixed) over (partition by symbol order by decision_time) = 1, false) as was from r0) select symbol, count(*) filter (where up and not was) as entries, count(*) filter (where not up and was) as exits, round(avg(up::int), 9) as active_share from x group by symbol")
def signal_activity(spark, sf_dir):
    return lab.signal_activity(labelled(spark, sf_dir), ["symbol"], "label_fixed")


@query(f"{LB}, bk as (select *, ntile(6) over (partition by symbol order by decision_time)::integer as block from lbl), {structure_sql('bk', 'symbol, block', 'label_fixed')} select symbol, count(*) as folds, count(*) filter (where least(down_share, neutral_share, up_share) < 0.10 or majority_share > 0.80) as bad_folds, case when count(*) filter (where least(down_share, neutral_share, up_share) < 0.10 or majority_share > 0.80) >= 2 then 'PATHOLOGICAL' else 'FEASIBLE' end as decision from sx where block > 2 group by symbol")
def label_feasibility(spark, sf_dir):
    d = sp.blocks(labelled(spark, sf_dir)).filter("block > 2")
    return lab.feasibility(lab.class_structure(d, ["symbol", "block"], "label_fixed"), ["symbol"])


# --- classification ---------------------------------------------------------------------------
# The previous return, labelled by the same threshold, predicts the label.

PRED = "cp as (select lbl.symbol, label_fixed as actual, case when p > tau then 1 when p < -tau then -1 else 0 end as predicted from lbl join cal using (symbol) where p is not null)"
CM = f"{PRED}, cm as (select s.symbol, a.c as actual, b.c as predicted, (select count(*) from cp where cp.symbol = s.symbol and cp.actual = a.c and cp.predicted = b.c) as n from (select distinct symbol from cp) s, (select unnest([-1, 0, 1]) as c) a, (select unnest([-1, 0, 1]) as c) b)"


def predictions(spark, sf_dir) -> DataFrame:
    d = with_atr(spark, sf_dir)
    c = calibration(d)
    return lab.labelled(d, c).filter("p is not null").join(c.select("symbol", "tau"), "symbol").select("symbol", "decision_time", F.col("label_fixed").alias("actual"), lab.three_classes(F.col("p"), F.col("tau")).alias("predicted"))


@query(f"{LB}, {CM} select symbol, actual, predicted, n from cm")
def confusion_matrix(spark, sf_dir):
    return mt.confusion(predictions(spark, sf_dir), ["symbol"])


@query(f"""{LB}, {CM}, ca as (select symbol, actual as c, sum(n) as t, sum(n) filter (where actual = predicted) as hit from cm group by all), cg as (select symbol, predicted as c, sum(n) as g from cm group by all),
cc as (select ca.*, g, coalesce(hit / nullif(g, 0), 0) as pr, coalesce(hit / nullif(t, 0), 0) as rc from ca join cg using (symbol, c)), cf as (select *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) as f1 from cc)
select symbol, sum(t)::bigint as samples, round(sum(hit) / sum(t), 9) as accuracy, round(avg(case when t > 0 then rc end), 9) as balanced_accuracy, round(avg(pr), 9) as macro_precision, round(avg(rc), 9) as macro_recall, round(avg(f1), 9) as macro_f1,
  round(coalesce((sum(hit) * sum(t) - sum(t * g)) / nullif(sqrt((sum(t) * sum(t) - sum(g * g))::double) * sqrt((sum(t) * sum(t) - sum(t * t))::double), 0), 0), 9) as mcc from cf group by symbol""")
def classification_metrics(spark, sf_dir):
    return mt.classification_metrics(predictions(spark, sf_dir), ["symbol"])


@query(f"{LB}, x as (select symbol, label_fixed as c, count(*) as n from lbl group by all) select symbol, arg_max(c, n * 10 - c) as majority_label, round(max(n) / sum(n), 9) as majority_accuracy, round(coalesce(sum(n) filter (where c = 0), 0) / sum(n), 9) as neutral_accuracy, round(sum(n * n) / (sum(n) * sum(n)), 9) as prior_accuracy from x group by symbol")
def class_baselines(spark, sf_dir):
    """Majority (lowest label on a tie), always neutral, and the prior as a random guess."""
    n = labelled(spark, sf_dir).groupBy("symbol", F.col("label_fixed").alias("c")).agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n")
    return n.groupBy("symbol").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("majority_label"), (F.max("n") / total).alias("majority_accuracy"), (F.coalesce(F.sum(F.when(F.col("c") == 0, F.col("n"))), F.lit(0.0)) / total).alias("neutral_accuracy"), (F.sum(F.col("n") * F.col("n")) / (total * total)).alias("prior_accuracy"))


@query(f"{LB}, pr as (select symbol, avg((label_fixed = -1)::int) as p0, avg((label_fixed = 0)::int) as p1, avg((label_fixed = 1)::int) as p2 from lbl group by symbol) select symbol, count(*) as samples, round(avg(pow(p0 - (label_fixed = -1)::int, 2) + pow(p1 - (label_fixed = 0)::int, 2) + pow(p2 - (label_fixed = 1)::int, 2)), 9) as brier, round(avg(-ln(greatest(case label_fixed when -1 then p0 when 0 then p1 else p2 end, 1e-15))), 9) as log_loss from lbl join pr using (symbol) group by symbol")
def brier_logloss(spark, sf_dir):
    """Scores of the class prior as the predicted probabilities."""
    d = labelled(spark, sf_dir).withColumn("actual", F.col("label_fixed"))
    share = lambda c: F.avg((F.col("actual") == c).cast("double"))
    prior = d.groupBy("symbol").agg(share(-1).alias("p_0"), share(0).alias("p_1"), share(1).alias("p_2"))
    return mt.probability_metrics(d.join(prior, "symbol"), ["symbol"])
