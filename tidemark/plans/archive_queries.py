"""Queries that read archives: five-minute bars of the events are written as monthly ZIP archives and read back through the data source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import HOUR, micros, rounded
from tidemark.operators import raw_summary as rs
from tidemark.operators import rollup
from tidemark.operators import validation as v
from tidemark.plans.market_queries import FIVE
from tidemark.plans.study_queries import BASE, SPLIT_SQL, samples
from tidemark.sources import acquisition, archives, scopes
from tidemark.sources.archive_source import register, write_archives
from tidemark.sources.bars import five_minutes
from tidemark.staging import new_folder, staged

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Defects by the number k of a slot: close time late by one unit, no volume, a remark in the last field, an hour of slots left out.
LATE, EMPTY, REMARK, LEFT_OUT = 101, 211, 307, 997


def raw_rows(spark, sf_dir, defects: bool) -> DataFrame:
    """The five-minute bars as raw string rows; with ``defects`` some rows are damaged by their slot's number."""
    us = micros("open_time")
    d = five_minutes(spark, sf_dir).withColumns({"us": us, "k": (us / rollup.SLOT).cast("long")})
    if defects:
        d = d.filter(F.pmod(F.col("k"), F.lit(LEFT_OUT)) >= 12)
    hit = lambda n: F.pmod(F.col("k"), F.lit(n)) == 0 if defects else F.lit(False)
    ms = F.date_format("open_time", "yyyy-MM") < "2025-01"
    unit = lambda t: F.when(ms, (t - F.pmod(t, F.lit(1000))) / 1000).otherwise(t).cast("long").cast("string")
    number = lambda c: c.cast("decimal(38,8)").cast("string")
    volume = F.when(hit(EMPTY), 0.0).otherwise(F.col("volume"))
    return d.select(
        F.date_format("open_time", "yyyy-MM").alias("period"),
        F.row_number().over(Window.partitionBy(F.date_format("open_time", "yyyy-MM")).orderBy("us")).alias("line"),  # a month of slots
        unit(F.col("us")).alias("open_time"),
        *(number(F.col(c)).alias(c) for c in ("open", "high", "low", "close")),
        number(volume).alias("volume"),
        unit(F.col("us") + rollup.SLOT - 1 + F.when(hit(LATE), 1000).otherwise(0)).alias("close_time"),
        number(volume * 2).alias("quote_asset_volume"),
        F.col("volume").cast("long").cast("string").alias("number_of_trades"),
        number(volume / 2).alias("taker_buy_base_volume"),
        number(volume).alias("taker_buy_quote_volume"),
        F.when(hit(REMARK), "1").otherwise("0").alias("ignore"),
    )


def scanned(spark, sf_dir, defects: bool = False) -> tuple[DataFrame, DataFrame, str]:
    """The rows read from freshly written archives, the writer's manifest, and the folder."""
    folder = new_folder(spark, "archives")
    manifest = staged(write_archives(raw_rows(spark, sf_dir, defects), folder, "EVENTS"), "archive-manifest")
    register(spark)
    return spark.read.format("market_archives").load(folder), manifest, folder


@query(f"with {FIVE} select open_time, open::decimal(38, 8)::double as open, high::decimal(38, 8)::double as high, low::decimal(38, 8)::double as low, close::decimal(38, 8)::double as close, volume, strftime(open_time, '%Y-%m') as period from five")
def archive_rows(spark, sf_dir):
    """Canonical rows of archives: written, read by the data source, parsed by each archive's unit."""
    rows, _, _ = scanned(spark, sf_dir)
    d = archives.canonical_rows(rows)
    return d.select("open_time", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")), F.date_format("open_time", "yyyy-MM").alias("period"))


@query(f"with {FIVE} select 'EVENTS' as symbol, date_trunc('hour', open_time) as open_time, arg_min(open, open_time)::decimal(38, 8)::double as open, max(high)::decimal(38, 8)::double as high, min(low)::decimal(38, 8)::double as low, arg_max(close, open_time)::decimal(38, 8)::double as close, sum(volume) as volume from five group by date_trunc('hour', open_time) having count(*) = 12")
def archive_hours(spark, sf_dir):
    """Exact hours of the canonical rows."""
    rows, _, _ = scanned(spark, sf_dir)
    d = archives.canonical_rows(rows).withColumn("symbol", F.lit("EVENTS"))
    h = rollup.exact_hours(d)
    return h.select("symbol", "open_time", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")))


@query(f"with {FIVE}, p as (select strftime(open_time, '%Y-%m') as period from five) select period, count(*) as row_count from p where period = (select max(period) from p) group by period")
def archive_last_period(spark, sf_dir):
    """Only the last archive is opened: the filter is pushed into the source."""
    rows, manifest, _ = scanned(spark, sf_dir)
    last = manifest.agg(F.max("period")).first()[0]
    return rows.filter(F.col("period") == (last or "")).groupBy("period").agg(F.count("*").alias("row_count"))


@query(f"with {FIVE} select 'EVENTS-5m-' || strftime(open_time, '%Y-%m') || '.zip' as archive, strftime(open_time, '%Y-%m') as period, 'VERIFIED' as status from five group by all")
def archive_verification(spark, sf_dir):
    """Every archive's digest against its checksum file, and its CRC."""
    _, _, folder = scanned(spark, sf_dir)
    found = archives.verified_archives(archives.archive_files(spark, f"{folder}/*.zip"), archives.checksums(spark, f"{folder}/*.CHECKSUM"))
    return found.select("archive", "period", "status")


_DAMAGED = f"""{FIVE}, k as (select *, epoch_us(open_time) as us, epoch_us(open_time) // 300000000 as k, strftime(open_time, '%Y-%m') as period from five),
raw as (select *, k % {LATE} = 0 as late, k % {EMPTY} = 0 as no_volume, k % {REMARK} = 0 as remark from k where k % {LEFT_OUT} >= 12)"""


@query(f"with {_DAMAGED} select period, count(*) as total_row_count, count(*) filter (where late) as close_time_violation_count, count(*) filter (where no_volume) as zero_volume_row_count, min(us) as first_us, max(us) as last_us, count(*) filter (where late) = 0 as valid from raw group by period")
def archive_counters(spark, sf_dir):
    rows, _, _ = scanned(spark, sf_dir, defects=True)
    return rs.archive_counters(v.checked_raw(rows)).select("period", "total_row_count", "close_time_violation_count", "zero_volume_row_count", "first_us", "last_us", "valid")


def _cutoff(rows: DataFrame) -> int:
    """The hour after the last hour with a row."""
    last = rows.agg(F.max(micros("open_time"))).first()[0] or 0
    return last - last % HOUR + 2 * HOUR


_ZERO = [c for c in rs.FLAGS if c not in ("close_time_violation_count", "zero_volume_row_count")] + ["malformed_row_count", "timestamp_parse_failure_count", "numeric_parse_failure_count", "nan_count", "infinity_count", "invalid_numeric_row_count", "negative_trade_count_row_count", "timestamp_unit_mismatch_archive_count", "parse_invalid_archive_count", "duplicate_timestamp_count", "cross_month_duplicate_timestamp_count", "cross_month_overlap_count", "close_time_overlap_off_grid_count"]


@query(f"""with {_DAMAGED}, cut as (select (epoch_us(max(open_time)) // 3600000000 + 2) * 3600000000 as cutoff from five),
st as (select us, lag(us) over (order by us) as before from (select us from raw union all select cutoff from cut where exists (select * from raw))),
gp as (select before + 300000000 as gap_start, (us - before + 299999999) // 300000000 - 1 as missing from st where before is not null and (us - before + 299999999) // 300000000 > 1),
mo as (select period, min(us) as first_us, max(us) as last_us, count(*) filter (where late) as late from raw group by period), ms as (select *, first_us - lag(last_us) over (order by period) as step from mo),
g as (select count(*) as gap_episode_count, coalesce(sum(missing), 0)::bigint as missing_candle_count, coalesce(max(missing), 0) as longest_gap_candles, min(gap_start) as first_gap_us, max(gap_start) as last_gap_us, arg_max(gap_start, missing * 100000000000000000::hugeint - gap_start) as longest_gap_us from gp),
m as (select count(*) as archives_scanned, count(*) filter (where late = 0) as valid_archive_count, count(*) filter (where late > 0) as invalid_archive_count, count(*) as parse_valid_archive_count, count(*) filter (where period < '2025-01') as millisecond_archive_count, count(*) filter (where period >= '2025-01') as microsecond_archive_count, count(*) filter (where step > 300000000) as cross_month_gap_count, coalesce(sum(step // 300000000 - 1) filter (where step > 300000000), 0)::bigint as cross_month_gap_missing_candle_count from ms),
r as (select count(*) as total_row_count, min(us) as first_us, max(us) as last_us, count(*) filter (where late) as close_time_violation_count, count(*) filter (where no_volume) as zero_volume_row_count, count(*) as observed_unique_timestamp_count, count(distinct remark) as ignore_unique_value_count, count(*) filter (where not remark) as ignore_zero_count, count(*) filter (where remark) as ignore_nonzero_count, count(*) filter (where late) as timestamp_anomaly_row_count, count(*) filter (where late) as close_time_only_violation_count, count(*) filter (where late and no_volume) as timestamp_anomaly_zero_volume_count, count(*) filter (where late and remark) as timestamp_anomaly_nonzero_ignore_count from raw)
select m.*, r.*, g.*, (cutoff - first_us + 299999999) // 300000000 as expected_candle_count, (cutoff - first_us + 299999999) // 300000000 - missing_candle_count as observed_unique_candle_count, round(100.0 * missing_candle_count / ((cutoff - first_us + 299999999) // 300000000), 9) as missing_percentage, 'PT' || (longest_gap_candles * 5)::varchar || 'M' as longest_gap_duration, true as global_ordering_monotonic, 'COMPLETE' as execution_status,
  case when invalid_archive_count > 0 or missing_candle_count > 0 then 'REVIEW_REQUIRED' else 'CLEAN' end as dataset_quality_decision, {', '.join(f'0::bigint as {c}' for c in _ZERO)} from m, r, g, cut""")
def raw_dataset_summary(spark, sf_dir):
    """About sixty counters of damaged archives, and the decision."""
    rows, _, _ = scanned(spark, sf_dir, defects=True)
    return rs.raw_summary(v.checked_raw(rows), _cutoff(five_minutes(spark, sf_dir)))


# --- stored splits ---------------------------------------------------------------------------------


def stored_samples(spark, sf_dir) -> tuple[str, str]:
    """Paths of the stored samples and of their split bounds."""
    d = staged(samples(spark, sf_dir).select("symbol", "decision_time", "target_time", "y", "sigma", "p"), "samples")
    at, bounds = new_folder(spark, "stored-samples"), new_folder(spark, "split-bounds")
    scopes.write_samples(d, at)
    scopes.split_bounds(d).write.parquet(bounds)
    return at, bounds


@query(f"with {BASE}, {SPLIT_SQL} select symbol, decision_time, round(y, 9) as y, split from spl where split = 'train' and not purged")
def train_scope(spark, sf_dir):
    """Training rows, read by the stored bounds with pushed predicates."""
    return scopes.load_scope(spark, *stored_samples(spark, sf_dir), "train", ["y"]).select("symbol", "decision_time", "y", "split")


@query(f"with {BASE}, {SPLIT_SQL} select symbol, split, count(*) as samples, min(decision_time) as first_decision, max(target_time) as last_target, round(avg(y), 9) as mean_y from spl where split <> 'test' and not purged group by all")
def development_scope(spark, sf_dir):
    """Training and validation rows; the test period is not read."""
    d = scopes.load_scope(spark, *stored_samples(spark, sf_dir), "development", ["y"])
    return d.groupBy("symbol", "split").agg(F.count("*").alias("samples"), F.min("decision_time").alias("first_decision"), F.max("target_time").alias("last_target"), F.avg("y").alias("mean_y"))


@query(f"with {BASE}, {SPLIT_SQL} select symbol, split, count(*) filter (where not purged) as rows_kept, min(decision_time) as start from spl group by all")
def stored_split_bounds(spark, sf_dir):
    _, bounds = stored_samples(spark, sf_dir)
    return spark.read.parquet(bounds).select("symbol", "split", "rows_kept", "start")


# --- acquisition -----------------------------------------------------------------------------------


@query(f"with {FIVE}, m as (select distinct date_trunc('month', open_time) as m from five), a as (select m, 'VERIFIED' as status from m union all select max(m) + interval 1 month, 'MISSING_REMOTE' from m having count(*) > 0) select 'EVENTS-5m-' || strftime(m, '%Y-%m') || '.zip' as archive, strftime(m, '%Y-%m') as period, status from a")
def acquisition_states(spark, sf_dir):
    """Archives fetched from a mounted mirror by tasks, verified and put in place; the month after the last one is not there."""
    _, manifest, folder = scanned(spark, sf_dir)
    month = F.to_date(F.concat("period", F.lit("-01")))
    after = manifest.agg(F.max(month).alias("m")).filter("m is not null").select(F.date_format(F.add_months("m", 1), "yyyy-MM").alias("period"))
    planned = archives.with_names(manifest.select("period").unionByName(after), "EVENTS", "5m", "http://mirror")
    local = lambda path: path.removeprefix("file://").removeprefix("file:")  # noqa: E731 (a folder that all executors mount)
    run = acquisition.acquisition_run(planned, local(new_folder(spark, "acquired")), acquisition.MirrorClient(local(folder)))
    return run.select("archive", "period", "status")
