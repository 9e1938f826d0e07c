"""Queries over bars, gaps, rollups, targets and baseline features, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR, rounded
from tidemark.operators import f0, gaps, rollup, targets
from tidemark.operators import validation as v
from tidemark.sources.bars import events, five_minutes, hourly

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- parts of the SQL -------------------------------------------------------------------------


def bars_sql(name: str = "bars", minutes: int = 60, symbol: str = "'ALL'") -> str:
    bucket = f"time_bucket(interval '{minutes} minutes', ts)"
    return f"{name} as (select {symbol} as symbol, {bucket} as open_time, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, count(*)::double as volume from events where value > 0 group by all)"


BARS, TYPED, FIVE = bars_sql(), bars_sql(symbol="event_type"), bars_sql("five", 5)


def segments_sql(source: str = "bars", name: str = "seg") -> str:
    return f"""{name} as (select *, row_number() over (partition by symbol, segment order by open_time) - 1 as row from (
  select *, (sum(brk) over (partition by symbol order by open_time) - 1)::bigint as segment from (
    select *, case when open_time - lag(open_time) over (partition by symbol order by open_time) = interval 1 hour then 0 else 1 end as brk from {source})))"""


def r9(*names: str) -> str:
    return ", ".join(f"round({n}, 9) as {n}" for n in names)


F0_SQL = """f0a as (select *, ln(close) - lag(ln(close)) over w as log_return_1h, ln(close) - lag(ln(close), 3) over w as log_return_3h, ln(close) - lag(ln(close), 6) over w as log_return_6h
  from seg window w as (partition by symbol, segment order by open_time)),
f0 as (select symbol, segment, open_time, open_time + interval 1 hour as decision_time, close, log_return_1h, log_return_3h, log_return_6h, ln(close / open) as candle_log_return, (high - low) / close as high_low_range_pct,
  case when high = low then 0.5 else (close - low) / (high - low) end as close_position_in_range,
  case when count(log_return_1h) over w6 = 6 then stddev_pop(log_return_1h) over w6 end as rolling_volatility_6h,
  case when count(log_return_1h) over w24 = 24 then stddev_pop(log_return_1h) over w24 end as rolling_volatility_24h,
  ln(1 + volume) - lag(ln(1 + volume)) over w as log_volume_change_1h,
  case when count(volume) over p24 = 24 and avg(volume) over p24 <> 0 then volume / avg(volume) over p24 end as relative_volume_24h
  from f0a window w as (partition by symbol, segment order by open_time), w6 as (partition by symbol, segment order by open_time rows between 5 preceding and current row), w24 as (partition by symbol, segment order by open_time rows between 23 preceding and current row), p24 as (partition by symbol, segment order by open_time rows between 24 preceding and 1 preceding))"""
F0_OUT = "symbol, segment, open_time, decision_time, " + r9(*f0.F0)
ELIGIBLE_SQL = (
    "elig as (select *, case when count(*) over w < 24 then 'incomplete_window' when sum(case when "
    + " and ".join(f"{c} is not null" for c in f0.F0)
    + " then 1 else 0 end) over w < 24 then 'nonfinite_feature' when not coalesce(rolling_volatility_24h > 0, false) then 'nonpositive_sigma' else 'usable' end as reason from f0 window w as (partition by symbol, segment order by open_time rows between 23 preceding and current row))"
)


# --- bars -------------------------------------------------------------------------------------

BAR_OUT = "symbol, open_time, " + r9("open", "high", "low", "close", "volume")


@query(f"with {BARS} select {BAR_OUT} from bars")
def bars_1h(spark, sf_dir):
    return hourly(spark, sf_dir)


@query(f"with {FIVE} select {BAR_OUT} from five")
def bars_5m(spark, sf_dir):
    return five_minutes(spark, sf_dir)


@query(f"with {TYPED} select {BAR_OUT} from bars")
def bars_1h_by_type(spark, sf_dir):
    return hourly(spark, sf_dir, by_type=True)


_ROLL = "symbol, date_trunc('hour', open_time) as h, arg_min(open, open_time) as open, max(high) as high, min(low) as low, arg_max(close, open_time) as close, sum(volume) as volume, count(*) as n"


@query(f"with {FIVE}, x as (select {_ROLL} from five group by all) select symbol, h as open_time, {r9('open', 'high', 'low', 'close', 'volume')} from x where n = 12")
def bars_1h_exact(spark, sf_dir):
    return rollup.exact_hours(five_minutes(spark, sf_dir))


@query(f"with {FIVE}, x as (select {_ROLL} from five group by all) select symbol, h as open_time, {r9('open', 'high', 'low', 'close', 'volume')}, n as source_bar_count from x")
def bars_1h_counted(spark, sf_dir):
    return rollup.counted_hours(five_minutes(spark, sf_dir), complete_only=False)


@query(f"""with {FIVE}, spine as (select unnest(generate_series(date_trunc('hour', min(open_time)), date_trunc('hour', max(open_time)), interval 1 hour)) as hour from five),
slots as (select hour, hour + k * interval 5 minutes as slot from spine, range(12) t(k)),
x as (select s.hour, s.slot, f.open_time is not null as there from slots s left join five f on f.open_time = s.slot)
select 'ALL' as symbol, hour, count(*) filter (where there) as source_candle_count, count(*) filter (where not there) as missing_candle_count,
  string_agg(strftime(slot, '%Y-%m-%dT%H:%M:%SZ'), ';' order by slot) filter (where not there) as missing_timestamps from x group by hour having count(*) filter (where not there) > 0""")
def incomplete_hours(spark, sf_dir):
    return rollup.incomplete_hours(five_minutes(spark, sf_dir))


@query(f"with {FIVE}, spine as (select unnest(generate_series(min(open_time), max(open_time), interval 5 minutes)) as slot from five) select 'ALL' as symbol, slot from spine where slot not in (select open_time from five)")
def missing_slots(spark, sf_dir):
    return gaps.missing_slots(five_minutes(spark, sf_dir), rollup.SLOT)


def _verification_sql(source: str, step: str, minutes: int) -> str:
    return f"""with {source} select symbol, count(*) as row_count, min(open_time) as first_time, max(open_time) as last_time, count(distinct open_time) as distinct_times, 0::bigint as grid_violations,
  count(*) filter (where high < greatest(open, close, low) or low > least(open, close, high)) as order_violations, count(*) - count(distinct open_time) as duplicates,
  date_diff('minute', min(open_time), max(open_time)) // {minutes} + 1 as expected_rows, date_diff('minute', min(open_time), max(open_time)) // {minutes} + 1 - count(distinct open_time) as missing_rows from {step} group by symbol"""


@query(_verification_sql(FIVE, "five", 5))
def dataset_verification_5m(spark, sf_dir):
    return rollup.verification(five_minutes(spark, sf_dir), rollup.SLOT)


@query(_verification_sql(TYPED, "bars", 60))
def dataset_verification_1h(spark, sf_dir):
    return rollup.verification(hourly(spark, sf_dir, by_type=True), HOUR)


# --- gaps -------------------------------------------------------------------------------------


def _gaps_sql(source: str, table: str, minutes: int) -> str:
    return f"""with {source}, x as (select symbol, open_time, lag(open_time) over (partition by symbol order by open_time) as before from {table})
select symbol, before + interval {minutes} minutes as gap_start, open_time - interval {minutes} minutes as gap_end, date_diff('minute', before, open_time) // {minutes} - 1 as missing,
  'PT' || (date_diff('minute', before, open_time) - {minutes})::varchar || 'M' as duration from x where open_time - before > interval {minutes} minutes"""


@query(_gaps_sql(FIVE, "five", 5))
def grid_gaps_5m(spark, sf_dir):
    return gaps.grid_gaps(five_minutes(spark, sf_dir), rollup.SLOT)


@query(_gaps_sql(TYPED, "bars", 60))
def grid_gaps_1h_by_type(spark, sf_dir):
    return gaps.grid_gaps(hourly(spark, sf_dir, by_type=True), HOUR)


@query(f"""with {TYPED}, x as (select symbol, open_time, date_diff('minute', lag(open_time) over (partition by symbol order by open_time), open_time) as step from bars),
c as (select symbol, step, count(*) as n from x where step > 0 group by all), u as (select symbol, arg_max(step, n * 1000000 - step) as expected from c group by symbol)
select symbol, open_time, step as step_minutes, expected as expected_minutes, step // expected - 1 as missing from x join u using (symbol) where step > expected""")
def time_gaps(spark, sf_dir):
    return gaps.time_gaps(hourly(spark, sf_dir, by_type=True))


@query("""with e as (select event_type as symbol, epoch_us(ts) as us from events where value > 0), edge as (select symbol, min(us) as a, max(us) as b from e group by symbol),
x as (select *, us % 300000000 as rest from e), g as (select distinct symbol, us as target from x where rest = 0),
o as (select symbol, us, rest, case when rest * 2 <= 300000000 then us - rest else us - rest + 300000000 end as target from x where rest <> 0)
select o.symbol, make_timestamp(us) as t, make_timestamp(o.target) as nearest, us - o.target as offset_us,
  case when rest * 2 = 300000000 then 'TIE' when o.target < a or o.target > b then 'OUTSIDE_EXPECTED_GRID' when g.target is not null then 'COLLIDES_WITH_EXISTING_GRID' when count(*) over (partition by o.symbol, o.target) > 1 then 'AMBIGUOUS_SHARED_TARGET' else 'UNIQUE_MISSING_GRID' end as status
from o join edge using (symbol) left join g on g.symbol = o.symbol and g.target = o.target""")
def nearest_grid(spark, sf_dir):
    return gaps.nearest_grid(events(spark, sf_dir).select(F.col("event_type").alias("symbol"), F.col("ts").alias("t")), rollup.SLOT)


@query(f"with {TYPED}, {segments_sql()} select symbol, open_time, segment, row from seg")
def segments(spark, sf_dir):
    return gaps.segments(hourly(spark, sf_dir, by_type=True)).select("symbol", "open_time", "segment", "row")


@query(f"with {TYPED}, {segments_sql()} select symbol, segment, min(open_time) as first_time, max(open_time) as last_time, count(*) as bars from seg group by symbol, segment")
def segment_lengths(spark, sf_dir):
    return gaps.segment_lengths(hourly(spark, sf_dir, by_type=True))


# --- validation -------------------------------------------------------------------------------


@query(f"""with {TYPED}, x as (select *, date_diff('minute', lag(open_time) over (partition by symbol order by open_time), open_time) as step from bars)
select symbol, count(*) as row_count, 0::bigint as missing_values, 0::bigint as duplicate_timestamps, 0::bigint as unordered_timestamps, 0::bigint as nonpositive_prices,
  count(*) filter (where high < greatest(open, close, low)) as high_violations, count(*) filter (where low > least(open, close, high)) as low_violations, 0::bigint as negative_volume,
  coalesce(sum(case when step > 60 then step // 60 - 1 else 0 end), 0)::bigint as missing_intervals from x group by symbol""")
def ohlcv_report(spark, sf_dir):
    return v.ohlcv_report(hourly(spark, sf_dir, by_type=True), HOUR)


@query("select event_id, sha256(event_id::varchar || chr(31) || user_id::varchar || chr(31) || event_type) as digest from events")
def row_fingerprint(spark, sf_dir):
    return v.row_fingerprint(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type"), ["event_id", "user_id", "event_type"]).select("event_id", "digest")


@query("select event_type as value, count(*) as frequency, count(*)::double / sum(count(*)) over () as share from events group by event_type".replace("count(*)::double / sum(count(*)) over ()", "round(count(*)::double / sum(count(*)) over (), 9)"))
def value_frequency(spark, sf_dir):
    return v.value_frequency(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type")


# --- targets ----------------------------------------------------------------------------------

TARGET_SQL = "tgt as (select symbol, open_time as bar_open_time, open_time + interval 1 hour as decision_time, open_time + interval 2 hours as target_time, ln(nc / close) as future_log_return_1h from (select *, lead(open_time) over w as nt, lead(close) over w as nc from bars window w as (partition by symbol order by open_time)) where nt - open_time = interval 1 hour)"


@query(f"with {TYPED} select symbol, open_time, lead(open_time, 3) over w as target_row_time, round(ln(lead(close, 3) over w / close), 9) as future_log_return from bars window w as (partition by symbol order by open_time)")
def future_return_rowbased(spark, sf_dir):
    return targets.row_based(hourly(spark, sf_dir, by_type=True), 3)


@query(f"with {TYPED}, {TARGET_SQL} select symbol, bar_open_time, decision_time, target_time, {r9('future_log_return_1h')} from tgt")
def target_1h(spark, sf_dir):
    return targets.one_hour(hourly(spark, sf_dir, by_type=True))


HORIZON_SQL = """hz as (select b.symbol, h.horizon, b.open_time, b.open_time + interval 1 hour as decision_time, b.open_time + (h.horizon + 1) * interval 1 hour as target_time, b.close, e.close as end_close,
  (select count(*) from bars p where p.symbol = b.symbol and p.open_time > b.open_time and p.open_time <= b.open_time + h.horizon * interval 1 hour) as path, l.last + interval 2 hours as scope_end
  from bars b cross join (select unnest([1, 3, 6, 12]) as horizon) h join (select symbol, max(open_time) as last from bars group by symbol) l using (symbol)
  left join bars e on e.symbol = b.symbol and e.open_time = b.open_time + h.horizon * interval 1 hour),
hx as (select *, case when target_time >= scope_end then 'boundary' when end_close is null then 'missing_endpoint' when path <> horizon then 'broken_path' else 'ok' end as outcome, case when target_time < scope_end and path = horizon then ln(end_close / close) end as value from hz)"""


@query(f"with {TYPED}, {HORIZON_SQL} select symbol, horizon, open_time, decision_time, target_time, round(value, 9) as value from hx where outcome = 'ok'")
def target_horizons(spark, sf_dir):
    return targets.horizon_targets(hourly(spark, sf_dir, by_type=True))


@query(f"with {TYPED}, {HORIZON_SQL} select symbol, horizon, outcome, count(*) as anchors from hx group by all")
def horizon_exclusions(spark, sf_dir):
    return targets.horizon_counts(hourly(spark, sf_dir, by_type=True))


@query(f"""with {TYPED}, {TARGET_SQL} select symbol, count(*) as target_rows, round(min(future_log_return_1h), 9) as min_value, round(avg(future_log_return_1h), 9) as mean_value, round(median(future_log_return_1h), 9) as median_value,
  round(max(future_log_return_1h), 9) as max_value, count(*) filter (where future_log_return_1h is null) as missing_values from tgt group by symbol""")
def target_verification(spark, sf_dir):
    y = F.col("future_log_return_1h")
    return targets.one_hour(hourly(spark, sf_dir, by_type=True)).groupBy("symbol").agg(F.count("*").alias("target_rows"), F.min(y).alias("min_value"), F.avg(y).alias("mean_value"), F.median(y).alias("median_value"), F.max(y).alias("max_value"), F.count_if(y.isNull()).alias("missing_values"))


# --- baseline features ------------------------------------------------------------------------


@query(f"with {BARS}, {segments_sql()}, {F0_SQL} select {F0_OUT} from f0")
def f0_features(spark, sf_dir):
    return f0.f0_features(hourly(spark, sf_dir))


@query(f"with {TYPED}, {segments_sql()}, {F0_SQL} select {F0_OUT} from f0")
def f0_features_by_type(spark, sf_dir):
    return f0.f0_features(hourly(spark, sf_dir, by_type=True))


@query(f"with {TYPED}, {segments_sql()}, {F0_SQL}, {ELIGIBLE_SQL} select symbol, decision_time, reason = 'usable' as eligible, reason from elig")
def lookback_eligibility(spark, sf_dir):
    return f0.eligible(f0.f0_features(hourly(spark, sf_dir, by_type=True))).select("symbol", "decision_time", "eligible", "reason")


@query(f"with {TYPED}, {segments_sql()}, {F0_SQL}, {ELIGIBLE_SQL} select symbol, reason, count(*) as anchors from elig group by all")
def lookback_exclusion_reasons(spark, sf_dir):
    return f0.eligible(f0.f0_features(hourly(spark, sf_dir, by_type=True))).groupBy("symbol", "reason").agg(F.count("*").alias("anchors"))


