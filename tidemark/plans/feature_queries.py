"""Queries over the windowed and recurrent features, with their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.functions.expressions import rounded
from tidemark.operators.recurrent_features import RECURRENT, label_atr, recurrent_features
from tidemark.operators.windowed_features import WINDOWED, windowed_features
from tidemark.plans.market_queries import BARS, TYPED, r9, segments_sql
from tidemark.sources.bars import hourly

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

_PART = "partition by symbol, segment order by open_time"


def _w(n: int, end: int = 0) -> str:
    return f"w{n}" if not end else f"p{n}"


_WINDOWS = "window w as (" + _PART + "), " + ", ".join(f"w{n} as ({_PART} rows between {n - 1} preceding and current row)" for n in (3, 5, 14, 20, 30, 50, 60, 63, 100)) + f", b20 as ({_PART} rows between 21 preceding and 2 preceding), p60 as ({_PART} rows between 60 preceding and 1 preceding), p120 as ({_PART} rows between 120 preceding and 1 preceding), u as ({_PART} rows between unbounded preceding and current row)"


def _roll(f: str, x: str, n: int) -> str:
    return f"(case when count({x}) over w{n} = {n} then {f}({x}) over w{n} end)"


LAGS_SQL = f"""l0 as (select *, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as bar_range from seg {_WINDOWS}),
l1 as (select *, lag(close) over w as c1, lag(close, 2) over w as c2, lag(open) over w as o1, lag(open, 2) over w as o2, lag(high) over w as h1, lag(high, 2) over w as h2, lag(low) over w as l1, lag(low, 2) over w as l2,
  lag(volume) over w as v1, lag(bar_range) over w as tr, case when row >= 14 then avg(bar_range) over w14 end as ba14, case when row >= 63 then avg(bar_range) over w63 end as ba63, ln(close + 1e-12) as lc0 from l0 {_WINDOWS}),
l2 as (select *, ln(c1 / c2) as r1, lag(ba14) over w as atr, lag(ba63) over w as atr63, lag(lc0) over w as lc, lag(lc0) over w - lag(lc0, 2) over w as lr, lag(ln((high + 1e-12) / (low + 1e-12))) over w as hl from l1 {_WINDOWS}),
l3 as (select *, lag(r1) over w as r2, {_roll('avg', 'c1', 20)} as mid, {_roll('stddev_pop', 'c1', 20)} as dev, {_roll('max', 'h1', 20)} as max20, {_roll('min', 'l1', 20)} as min20, {_roll('stddev_samp', 'lr', 20)} as rv20,
  abs(c1 - c2) as step, abs(r1) as a1, least(r1, case when r1 is not null then 0.0 end) as dn, greatest(r1, case when r1 is not null then 0.0 end) as upr, c1 * v1 as notional, case when c1 > c2 then 1.0 else 0.0 end as up, tr / (atr + 1e-12) as tra from l2 {_WINDOWS}),
l4 as (select *, case when abs(4 * dev) > 1e-12 then (c1 - (mid - 2 * dev)) / (4 * dev) when dev is not null then 0.5 end as pb, case when sign(r1) * sign(r2) < 0 then 1.0 else 0.0 end as flip, a1 / (case when notional > 1e-12 then notional end) as illiq from l3 {_WINDOWS})"""


def _clip(x: str, low: str | None = None, high: str | None = None) -> str:
    y = f"greatest({x}, {low})" if low else x
    y = f"least({y}, {high})" if high else y
    return f"(case when ({x}) is not null then {y} end)"


def _corr(x: str, y: str) -> str:
    return f"coalesce(covar_pop({x}, {y}) over w30 / nullif(stddev_pop({x}) over w30 * stddev_pop({y}) over w30, 0), 0.0)"


_BEAR = "(case when c2 > o2 and c1 < o1 and o1 >= c2 and c1 <= o2 then 1.0 else 0.0 end)"
_BULL = "(case when c2 < o2 and c1 > o1 and o1 <= c2 and c1 >= o2 then 1.0 else 0.0 end)"
FEATURE_SQL = {
    "amihud_illiquidity_20": _roll("avg", "illiq", 20),
    "atr_pct_14": "atr / (c1 + 1e-12)",
    "atr_ratio_14_63": "atr / (atr63 + 1e-12)",
    "band_bb_percB_20_2": "pb",
    "bb_excursion_20_2": "case when pb is not null then least(pb, 0.0) + greatest(pb - 1, 0.0) end",
    "bb_width_rel_20": "4 * dev / (case when abs(mid) > 1e-12 then mid end)",
    "bearish_engulf_score": f"{_BEAR} * abs(c1 - o1) / (atr + 1e-12)",
    "body_signed_to_tr": _clip("(c1 - o1) / (tr + 1e-12)", "-1.0", "1.0"),
    "body_to_tr": "abs(c1 - o1) / (tr + 1e-12)",
    "breakdown_strength_20": _clip("(case when count(low) over b20 = 20 then min(low) over b20 end) - c1", "0.0") + " / (atr + 1e-12)",
    "breakout_strength_20": _clip("c1 - (case when count(high) over b20 = 20 then max(high) over b20 end)", "0.0") + " / (atr + 1e-12)",
    "bullish_engulf_score": f"{_BULL} * abs(c1 - o1) / (atr + 1e-12)",
    "cand_up_down_vol_ratio_20": "sum(case when c1 > c2 then v1 else 0.0 end) over w20 / (sum(case when c1 < c2 then v1 else 0.0 end) over w20 + 1e-12)",
    "channel_pos_20": _clip("(c1 - min20) / (max20 - min20 + 1e-12)", "0.0", "1.0"),
    "close_location_value": "case when h1 - l1 > 1e-12 then least(greatest(((c1 - l1) - (h1 - c1)) / (h1 - l1), -1.0), 1.0) when h1 is not null then 0.0 end",
    "downside_semivol_20": f"sqrt({_roll('avg', 'dn * dn', 20)})",
    "drawdown_from_peak_60": _clip(f"({_roll('max', 'c1', 60)} - c1) / ({_roll('max', 'c1', 60)} + 1e-12)", "0.0"),
    "efficiency_ratio_20": _clip(f"abs(c1 - lag(c1, 20) over w) / ({_roll('sum', 'step', 20)} + 1e-12)", "0.0", "1.0"),
    "inside_bar_compression": "case when h1 <= h2 and l1 >= l2 and h2 - l2 > 1e-12 then least(greatest(1 - (h1 - l1) / (h2 - l2), 0.0), 1.0) else 0.0 end",
    "log_range_over_vol_100": f"({_roll('max', 'lc', 100)} - {_roll('min', 'lc', 100)}) / ({_roll('stddev_samp', 'lr', 100)} + 1e-12)",
    "lower_wick_to_tr": "(least(o1, c1) - l1) / (tr + 1e-12)",
    "open_gap_atr_14": "(open - c1) / (atr + 1e-12)",
    "outside_bar_expansion": "(case when h1 >= h2 and l1 <= l2 then 1.0 else 0.0 end) * (h1 - l1) / (atr + 1e-12)",
    "parkinson_vol_20": f"sqrt({_roll('avg', 'hl * hl', 20)} / (4 * ln(2)))",
    "range_compression_20_100": _clip(f"(max20 - min20) / ({_roll('max', 'h1', 100)} - {_roll('min', 'l1', 100)} + 1e-12)", "0.0", "1.0"),
    "realized_vol_20": _roll("stddev_pop", "r1", 20),
    "ret_autocorr_1_30": f"case when count(r1) over w30 = 30 and count(r2) over w30 = 30 then case when stddev_pop(r1) over w30 <= 1e-12 or stddev_pop(r2) over w30 <= 1e-12 then 0.0 else {_corr('r1', 'r2')} end end",
    "ret_vol_corr_30": f"case when count(r1) over w30 = 30 then case when stddev_pop(a1) over w30 <= 1e-12 or stddev_pop(v1) over w30 <= 1e-12 then 0.0 else {_corr('a1', 'v1')} end end",
    "return_skew_30": "case when count(r1) over w30 = 30 then case when stddev_pop(r1) over w30 <= 1e-12 then 0.0 else coalesce(skewness(r1) over w30, 0.0) end end",
    "roc_10": "c1 / lag(c1, 10) over w - 1",
    "sign_flip_rate_20": _roll("avg", "flip", 20),
    "tr_to_atr_14": "tr / (atr + 1e-12)",
    "up_close_ratio_5": _roll("avg", "up", 5),
    "upper_wick_to_tr": "(h1 - greatest(o1, c1)) / (tr + 1e-12)",
    "upside_semivol_20": f"sqrt({_roll('avg', 'upr * upr', 20)})",
    "vol_over_median20": "v1 / ((case when count(v1) over w20 = 20 then quantile_cont(v1, 0.5) over w20 end) + 1e-12)",
    "vol_regime_pct_120": "case when rv20 is not null and count(rv20) over p120 = 120 then len(list_filter(list(rv20) over p120, lambda x: x <= rv20)) / 120.0 end",
    "volume_percentile_60": "case when v1 is not null and count(v1) over p60 = 60 then len(list_filter(list(v1) over p60, lambda x: x <= v1)) / 60.0 end",
}


def _ewm(x: str, alpha: str, least: int) -> str:
    return f"(case when count({x}) over u >= {least} then list_reduce(list({x}) filter (where {x} is not null) over u, lambda a, b: (1 - {alpha}) * a + {alpha} * b) end)"


def _span(x: str, n: int) -> str:
    return _ewm(x, f"(2.0 / {n + 1})", n)


EWM_LAYERS = f"""e1 as (select *, {_span('c1', 20)} as ema20, {_span('c1', 12)} as ema12, {_span('c1', 26)} as ema26, {_span('v1', 20)} as vema20, {_span('v1', 100)} as vema100, {_span('a1', 20)} as aema20, {_span('a1', 100)} as aema100,
  {_span('notional', 20)} as nema20, {_span('tra', 20)} as traema, high - lag(high) over w as um, lag(low) over w - low as dm from l4 {_WINDOWS}),
e2 as (select *, lag(um) over w as um1, lag(dm) over w as dm1, ema12 - ema26 as macd from e1 {_WINDOWS}),
e3 as (select *, {_span('macd', 9)} as sig, case when um1 > dm1 and um1 > 0 then um1 else 0.0 end as pdm, case when dm1 > um1 and dm1 > 0 then dm1 else 0.0 end as mdm from e2 {_WINDOWS}),
e4 as (select *, 100 * {_ewm('pdm', '(1.0 / 14)', 14)} / (atr + 1e-12) as pdi, 100 * {_ewm('mdm', '(1.0 / 14)', 14)} / (atr + 1e-12) as mdi from e3 {_WINDOWS})"""
EWM_SQL = {
    "absret_ema_ratio_20_100": "aema20 / (aema100 + 1e-12)",
    "dmi_balance_14": _clip("(pdi - mdi) / (pdi + mdi + 1e-12)", "-1.0", "1.0"),
    "dollar_vol_rel_20": "notional / (nema20 + 1e-12)",
    "ema_gap_atr_20": "(c1 - ema20) / (atr + 1e-12)",
    "ema_slope_atr_20_5": "(ema20 - lag(ema20, 5) over w) / (5 * atr + 1e-12)",
    "macd_hist_atr": "(macd - sig) / (atr + 1e-12)",
    "vol_of_vol_ratio_20": f"{_roll('stddev_pop', 'tra', 20)} / (traema + 1e-12)",
    "vol_over_ema20": "v1 / (vema20 + 1e-12)",
    "vol_ratio_20_100": "vema20 / (vema100 + 1e-12)",
}


def _select(features: dict[str, int], sql: dict[str, str], layer: str, places: int = 9) -> str:
    return "select symbol, segment, open_time, " + ", ".join(f"round(case when row >= {first} then {sql[k]} end, {places}) + 0.0 as {k}" for k, first in features.items()) + f" from {layer} {_WINDOWS}"


for _group in ("price", "candle", "volume", "volatility", "correlation"):
    _own = {k: first for k, (first, g) in WINDOWED.items() if g == _group}

    def _windowed(spark, sf_dir, own=tuple(_own)):
        return rounded(windowed_features(hourly(spark, sf_dir)).select("symbol", "segment", "open_time", *own))

    QUERIES[f"eng52_a_{_group}"] = _windowed
    ORACLE_SQL[f"eng52_a_{_group}"] = f"with {BARS}, {segments_sql()}, {LAGS_SQL} " + _select(_own, FEATURE_SQL, "l4")


def eng52_a_by_type(spark, sf_dir):
    """All windowed features of every event type: segments with gaps."""
    return rounded(windowed_features(hourly(spark, sf_dir, by_type=True)).drop("row"))


def eng52_c_ewm(spark, sf_dir):
    own = [k for k, (_, g) in RECURRENT.items() if g == "ewm"]
    return rounded(recurrent_features(hourly(spark, sf_dir)).select("symbol", "segment", "open_time", *own))


def eng52_c_rsi(spark, sf_dir):
    return rounded(recurrent_features(hourly(spark, sf_dir)).select("symbol", "segment", "open_time", "rsi_centered_14", "mom_stoch_rsi_14_14_3"))


def rsi_hidden_divergence(spark, sf_dir):
    return rounded(recurrent_features(hourly(spark, sf_dir)).select("symbol", "open_time", "rsi_hidden_div_flag"))


def divergence_persistence(spark, sf_dir):
    return rounded(recurrent_features(hourly(spark, sf_dir)).select("symbol", "open_time", "rsi_div_persistence"))


def trendline_breakout(spark, sf_dir):
    return rounded(recurrent_features(hourly(spark, sf_dir)).select("symbol", "open_time", "mom_tl_break_bull_30"))


def wilder_atr14(spark, sf_dir):
    return rounded(label_atr(hourly(spark, sf_dir, by_type=True)))


for _f in (eng52_a_by_type, eng52_c_ewm, eng52_c_rsi, rsi_hidden_divergence, divergence_persistence, trendline_breakout, wilder_atr14):
    QUERIES[_f.__name__] = _f
ORACLE_SQL["eng52_a_by_type"] = f"with {TYPED}, {segments_sql()}, {LAGS_SQL} " + _select({k: first for k, (first, _) in WINDOWED.items()}, FEATURE_SQL, "l4")
ORACLE_SQL["eng52_c_ewm"] = f"with {BARS}, {segments_sql()}, {LAGS_SQL}, {EWM_LAYERS} " + _select({k: first for k, (first, g) in RECURRENT.items() if g == "ewm"}, EWM_SQL, "e4")

#: Wilder's recurrences as recursive walks over the row number of a segment.
_ATR_WALK = """a0 as (select *, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as true_range from seg window w as (partition by symbol, segment order by open_time)),
seed as (select symbol, segment, avg(true_range) as atr from a0 where row < 14 group by all having count(*) = 14),
walk as (select s.symbol, s.segment, 13::bigint as row, s.atr from seed s union all select a.symbol, a.segment, a.row, (13 * k.atr + a.true_range) / 14 from walk k join a0 a on a.symbol = k.symbol and a.segment = k.segment and a.row = k.row + 1)"""
ORACLE_SQL["wilder_atr14"] = f"with recursive {TYPED}, {segments_sql()}, {_ATR_WALK} select a.symbol, a.segment, a.open_time, {r9('true_range')}, round(k.atr, 9) as atr, round(k.atr / a.close, 9) as atr_pct from a0 a left join walk k on k.symbol = a.symbol and k.segment = a.segment and k.row = a.row"
_RSI_WALK = """r0 as (select symbol, segment, row, open_time, lag(close) over w as x from seg window w as (partition by symbol, segment order by open_time)),
rd as (select *, x - lag(x) over (partition by symbol, segment order by open_time) as d from r0),
rseed as (select symbol, segment, avg(greatest(d, 0)) as g, avg(greatest(-d, 0)) as l from rd where row between 2 and 15 group by all having count(d) = 14),
rwalk as (select symbol, segment, 15::bigint as row, g, l from rseed union all select d.symbol, d.segment, d.row, (13 * k.g + greatest(d.d, 0)) / 14, (13 * k.l + greatest(-d.d, 0)) / 14 from rwalk k join rd d on d.symbol = k.symbol and d.segment = k.segment and d.row = k.row + 1),
rsi as (select r.symbol, r.segment, r.row, r.open_time, case when k.l > 1e-12 then 100 - 100 / (1 + k.g / k.l) when k.g > 1e-12 then 100.0 when k.g is not null then 50.0 end as rsi from r0 r left join rwalk k on k.symbol = r.symbol and k.segment = r.segment and k.row = r.row),
st as (select *, min(rsi) over w as lo, max(rsi) over w as hi, count(rsi) over w as n from rsi window w as (partition by symbol, segment order by open_time rows between 13 preceding and current row)),
sk as (select *, case when n = 14 then case when hi - lo > 1e-12 then (rsi - lo) / (hi - lo) else 0.5 end end as k from st)"""
ORACLE_SQL["eng52_c_rsi"] = f"with recursive {BARS}, {segments_sql()}, {_RSI_WALK} select symbol, segment, open_time, round(case when row >= 15 then rsi / 100 - 0.5 end, 9) as rsi_centered_14, round(case when row >= 30 and count(k) over w = 3 then least(greatest(avg(k) over w, 0.0), 1.0) end, 9) as mom_stoch_rsi_14_14_3 from sk window w as (partition by symbol, segment order by open_time rows between 2 preceding and current row)"

#: Pivots: candidates by windows, the greedy choice among them as a walk along pointers, the last two as lists of rows near a row.
_KEY = "symbol, segment"


def _kept_sql(name: str, candidates: str) -> str:
    return f"""{name}n as (select a.symbol, a.segment, a.row, min(b.row) as next from {candidates} a join {candidates} b on b.symbol = a.symbol and b.segment = a.segment and b.row >= a.row + 5 group by all),
{name} as (select {_KEY}, min(row) as row from {candidates} group by all union all select k.symbol, k.segment, n.next from {name} k join {name}n n on n.symbol = k.symbol and n.segment = k.segment and n.row = k.row),
{name}l as (select p.symbol, p.segment, p.row, list(k.row order by k.row) as near from pw p join {name} k on k.symbol = p.symbol and k.segment = p.segment and k.row between p.row - 60 and p.row - 3 group by all having count(*) >= 2)"""


PIVOT_SQL = f"""pw as (select {_KEY}, row, open_time, high, close, c1, h1, l1.l1 as low1, count(h1) over w7 as ch, max(h1) over w7 as mh, count(l1.l1) over w7 as cl, min(l1.l1) over w7 as ml, case when count(c1) over w50 = 50 then avg(c1) over w50 end as trend
  from l1 window w7 as (partition by symbol, segment order by row rows between 3 preceding and 3 following), w50 as (partition by symbol, segment order by row rows between 49 preceding and current row)),
tc as (select {_KEY}, row from pw where ch = 7 and h1 = mh), bc as (select {_KEY}, row from pw where cl = 7 and low1 = ml), {_kept_sql('tk', 'tc')}, {_kept_sql('bk_', 'bc')},
pvr as (select w.symbol, w.segment, w.row, w.h1, w.low1, r.rsi from pw w join rsi r on r.symbol = w.symbol and r.segment = w.segment and r.row = w.row),
bl as (select p.*, a.low1 as x0, b.low1 as x1, a.rsi as r0, b.rsi as r1, near[-1] as at from bk_l p join pvr a on a.symbol = p.symbol and a.segment = p.segment and a.row = near[-2] join pvr b on b.symbol = p.symbol and b.segment = p.segment and b.row = near[-1]),
tl as (select p.*, a.h1 as x0, b.h1 as x1, a.rsi as r0, b.rsi as r1, near[-1] as at from tkl p join pvr a on a.symbol = p.symbol and a.segment = p.segment and a.row = near[-2] join pvr b on b.symbol = p.symbol and b.segment = p.segment and b.row = near[-1]),
dv as (select w.*, coalesce(bl.x1 > bl.x0 and bl.r1 < bl.r0 and c1 > trend, false) as bull, coalesce(tl.x1 < tl.x0 and tl.r1 > tl.r0 and c1 < trend, false) as bear, bl.at as bat, tl.at as tat from pw w left join bl on bl.symbol = w.symbol and bl.segment = w.segment and bl.row = w.row left join tl on tl.symbol = w.symbol and tl.segment = w.segment and tl.row = w.row),
fl as (select {_KEY}, row, open_time, (case when bull and bear then sign(bat - tat) when bull then 1 when bear then -1 else 0 end)::double as flag from dv),
fi as (select *, row - row_number() over (partition by symbol, segment, flag order by row) as island from fl),
ps as (select {_KEY}, row, open_time, flag, flag * row_number() over (partition by symbol, segment, flag, island order by row) as run from fi),
th as (select {_KEY}, row, high, close, lag(close) over w as before, max(high) over (partition by symbol, segment order by row rows between 3 preceding and 1 preceding) as earlier, count(high) over (partition by symbol, segment order by row rows between 3 preceding and 1 following) as around, lead(high) over w as later from pw window w as (partition by symbol, segment order by row)),
tp as (select {_KEY}, row, high from th where around = 5 and high > greatest(earlier, later)),
tn as (select t.symbol, t.segment, t.row, t.close, t.before, list(p.row order by p.row) as rows, list(p.high order by p.row) as highs from th t join tp p on p.symbol = t.symbol and p.segment = t.segment and p.row between t.row - 30 and t.row - 1 group by all having count(*) >= 2),
ts_ as (select *, (highs[-1] - highs[-2]) / (rows[-1] - rows[-2]) as slope from tn where rows[-1] - rows[-2] >= 3 and highs[-1] < highs[-2]),
tb as (select {_KEY}, row + 1 as row from ts_ where before <= highs[-2] + slope * (row - 1 - rows[-2]) and close > highs[-2] + slope * (row - rows[-2])),
pv as (select ps.*, (tb.row is not null)::int::double as break from ps left join tb on tb.symbol = ps.symbol and tb.segment = ps.segment and tb.row = ps.row)"""
_PIVOTS = f"with recursive {BARS}, {segments_sql()}, {LAGS_SQL}, {_RSI_WALK}, {PIVOT_SQL}"
ORACLE_SQL["rsi_hidden_divergence"] = f"{_PIVOTS} select symbol, open_time, flag as rsi_hidden_div_flag from pv"
ORACLE_SQL["divergence_persistence"] = f"{_PIVOTS} select symbol, open_time, run as rsi_div_persistence from pv"
ORACLE_SQL["trendline_breakout"] = f"{_PIVOTS} select symbol, open_time, break as mom_tl_break_bull_30 from pv"
