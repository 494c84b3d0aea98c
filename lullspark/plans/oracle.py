"""The queries as plain SQL, for comparison.

Measures are whole hundredths here, means are integer quotients rounded half up,
and only the last step divides into DOUBLE. Interval statistics are written as
correlated subqueries, runs as one window per series.
"""

from __future__ import annotations

from lullspark.functions import labels
from lullspark.operators.weather import OCTANTS
from lullspark.registry import (
    DEFAULT_LABEL_CLASS,
    DERIVED_SERIES,
    LABEL_CLASSES,
    RAW_SERIES,
    REGIONS,
    RESOLUTIONS,
    THRESHOLDS,
)

HOUR, DAY, WEEK = 3_600_000, 86_400_000, 604_800_000
JAN = 1_704_067_200_000
TENTH, TWENTIETH = JAN + 9 * DAY, JAN + 19 * DAY
SEARCH = [0.3, 0.35, 0.4]
FEED = ["view", "click", "signup", "purchase", "error"]
WS = "share_of_photovoltaic_wind_onshore_offshore_computed"
RE = "share_of_renewable_energies_computed"


def up(num: str, den: str) -> str:
    """Quotient of non-negative integers, halves up."""
    return f"CAST((2 * ({num}) + ({den})) // (2 * ({den})) AS BIGINT)"


def away(num: str, den: str) -> str:
    """Quotient with a positive divisor, halves away from zero."""
    return f"CAST(sign({num}) * ((2 * abs({num}) + ({den})) // (2 * ({den}))) AS BIGINT)"


def dec(n: str, scale: int = 100) -> str:
    return f"CAST({n} AS DOUBLE) / {scale}"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c) + "\n"


EV = "ev AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def grid(name: str = "g", resolution: str = "hour") -> str:
    step = {"hour": HOUR, "quarterhour": 900_000}[resolution]
    kinds = {"pv": "view", "wind": "click", "hydro": "signup", "bio": "purchase", "lignite": "error"}
    per = ", ".join(
        f"CAST(coalesce(sum(cents) FILTER (event_type = '{k}'), 0) AS BIGINT) AS {n}" for n, k in kinds.items()
    )
    return f"""{name} AS (SELECT ms // {step} * {step} AS ts, 'DE' AS region, '{resolution}' AS resolution,
    CAST(sum(cents) AS BIGINT) AS total,
    CAST(coalesce(sum(cents) FILTER (event_type NOT IN ('view', 'click')), 0) AS BIGINT) AS residual,
    {per}, {up('sum(cents)', 'count(*)')} AS price
    FROM ev GROUP BY 1)"""


def sparse(name: str = "sp", src: str = "g") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (price), CASE WHEN residual * 3 <= total * 2 THEN price END AS price FROM {src})"""


DAYS = f"""days AS (SELECT epoch_us(o_orderdate) // 1000 AS ts, r_name AS region, 'day' AS resolution,
    sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS total,
    coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')), 0)::BIGINT AS urgent,
    {up('sum(CAST(round(o_totalprice * 100) AS BIGINT))', 'count(*) * 1000')} AS price
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""

PAIR_SHARE = "1.0::DOUBLE - residual::DOUBLE / 100 / (total::DOUBLE / 100)"
DAY_SHARE = "urgent::DOUBLE / total::DOUBLE"
WS_Q = up("residual * 100000", "total")
WS_SHARE = f"(100000 - {WS_Q})::DOUBLE / 100000"
RE_Q = away("(residual - hydro - bio) * 100000", "total")
RE_SHARE = f"(100000 - {RE_Q})::DOUBLE / 100000"


def search(src: str, share: str, thresholds: list[float], min_ms: int, where: str = "TRUE", out: str = "found") -> str:
    cuts = ", ".join(f"{t}::DOUBLE" for t in thresholds)
    by = "PARTITION BY region, resolution, threshold ORDER BY ts"
    return f"""{out}_c AS (SELECT ts, region, resolution, threshold,
        CASE WHEN {share} <= threshold THEN 'LOW' ELSE 'HIGH' END AS state
        FROM {src}, (SELECT unnest([{cuts}]) AS threshold) WHERE {where}),
    {out}_e AS (SELECT *, lag(state, 1, 'HIGH') OVER ({by}) AS before FROM {out}_c),
    {out}_t AS (SELECT ts, region, resolution, threshold,
        CASE WHEN before = 'HIGH' THEN 'START' ELSE 'END' END AS event_bucket FROM {out}_e WHERE before <> state),
    {out}_s AS (SELECT *, coalesce(lead(ts) OVER ({by}), max(ts) OVER (PARTITION BY region, resolution, threshold)) AS end_time
        FROM {out}_t),
    {out} AS (SELECT ts AS start_time, region, resolution, end_time, threshold FROM {out}_s
        WHERE event_bucket = 'START' AND end_time - ts >= {min_ms})"""


Q: dict[str, str] = {}

Q["find_events_hourly"] = with_(EV, grid(), search("g", PAIR_SHARE, [0.35], HOUR)) + "SELECT * FROM found"
Q["find_events_quarterhour"] = (
    with_(EV, grid("g", "quarterhour"), search("g", PAIR_SHARE, [0.35], HOUR)) + "SELECT * FROM found"
)
Q["find_events_daily_by_region"] = with_(DAYS, search("days", DAY_SHARE, [0.35], DAY)) + "SELECT * FROM found"
Q["events_multi_threshold"] = with_(EV, grid(), search("g", PAIR_SHARE, THRESHOLDS, HOUR)) + "SELECT * FROM found"
Q["search_events"] = (
    with_(EV, grid(), search("g", WS_SHARE, [0.35], 2 * HOUR, f"ts BETWEEN {JAN} AND {TWENTIETH}"))
    + "SELECT start_time, region, resolution, end_time FROM found"
)
Q["search_stored_events"] = Q["search_events"]
Q["events_level_sets"] = Q["events_multi_threshold"]
Q["state_transitions"] = (
    with_(DAYS, search("days", DAY_SHARE, SEARCH, 0))
    + "SELECT ts AS unix_timestamp_ms, region, resolution, threshold, event_bucket FROM found_t"
)
Q["classify_share"] = (
    with_(EV, grid())
    + f"SELECT ts AS unix_timestamp_ms, region, resolution, CASE WHEN {PAIR_SHARE} <= 0.35 THEN 'LOW' ELSE 'HIGH' END AS current_share FROM g"
)
Q["time_of_interest"] = (
    with_(EV, grid(), search("g", PAIR_SHARE, [0.35], HOUR, f"ts > {TENTH}")) + "SELECT * FROM found"
)


def trend(window_days: int, keys: str) -> str:
    return f"""SELECT {keys}, d.ts AS unix_timestamp_ms, count(f.start_time) AS occurrences_in_last_rolling_year,
        (sum(f.end_time - f.start_time)::BIGINT // 1000 // 60 // 60 // 24)::BIGINT AS total_days_in_last_rolling_year
        FROM days d JOIN found f ON d.region = f.region AND d.ts - {window_days * DAY} < f.end_time AND d.ts >= f.start_time
        GROUP BY ALL"""


Q["events_in_trailing_window"] = with_(DAYS, search("days", DAY_SHARE, SEARCH, DAY)) + trend(30, "d.region, f.threshold")
Q["trailing_event_trend"] = (
    with_(DAYS, search("days", DAY_SHARE, [0.35], DAY))
    + f"SELECT * FROM ({trend(365, 'd.region')}) QUALIFY row_number() OVER (PARTITION BY region ORDER BY unix_timestamp_ms) > 365"
)
Q["trailing_event_trend_filled"] = (
    with_(DAYS, search("days", DAY_SHARE, [0.2], 2 * DAY), f"tr AS ({trend(365, 'd.region')})")
    + """SELECT days.region, days.ts AS unix_timestamp_ms,
        coalesce(occurrences_in_last_rolling_year, 0) AS occurrences_in_last_rolling_year,
        coalesce(total_days_in_last_rolling_year, 0) AS total_days_in_last_rolling_year
        FROM days LEFT JOIN tr ON tr.region = days.region AND tr.unix_timestamp_ms = days.ts
        QUALIFY row_number() OVER (PARTITION BY days.region ORDER BY days.ts) > 365"""
)

# --- event statistics ---
EVENT = "threshold, region, resolution, start_time, end_time"


def stats(found: str, src: str) -> str:
    """Every event with the sums over its ranges, as correlated subqueries."""

    def sub(expr: str, lo: str, hi: str, half_open: bool = False) -> str:
        less = "<" if half_open else "<="
        return f"(SELECT {expr} FROM {src} p WHERE p.ts >= {lo} AND p.ts {less} {hi})"

    s, e = "f.start_time", "f.end_time"
    spans = {"during": (s, e), "before": (f"{s} - {WEEK}", s), "after": (e, f"{e} + {WEEK}")}
    cols = [f"{sub('sum(p.residual)', s, e, True)} AS r_half"]
    for role, (lo, hi) in spans.items():
        for name, expr in {
            "r": "sum(p.residual)", "c": "sum(p.total)", "cp": "sum(p.total * p.price)", "p": "sum(p.price)",
            "n": "count(p.price)", "peak": "max(p.residual)", "rp": "sum(p.residual * p.price)",
        }.items():
            cols.append(f"{sub(expr, lo, hi)} AS {name}_{role}")
    return f"""sums AS (SELECT f.*, f.end_time - f.start_time AS duration, {', '.join(cols)} FROM {found} f),
    st AS (SELECT *, {up('r_before + r_after', '336')} AS base, {up('cp_during', 'c_during')} AS wd,
        cp_before::DOUBLE / c_before::DOUBLE / 100 AS wb, cp_after::DOUBLE / c_after::DOUBLE / 100 AS wa,
        {up('p_during', 'n_during')} AS pd, {up('p_before', 'n_before')} AS pb, {up('p_after', 'n_after')} AS pa FROM sums),
    dl AS (SELECT *, 2 * pd - pb - pa AS inc2,
        {away('(2 * pd - pb - pa) * 100', '(pb + pa)')} AS rel,
        round(wd / 100.0::DOUBLE - (wb + wa) / 2, 2) AS winc,
        round((wd / 100.0::DOUBLE / ((wb + wa) / 2) - 1) * 100) AS wrel,
        wd / 100.0::DOUBLE > least(wb, wa) AND wd / 100.0::DOUBLE < greatest(wb, wa) AS in_range FROM st)"""


QUARTER = with_(EV, grid("g", "quarterhour"), search("g", WS_SHARE, SEARCH, HOUR), stats("found", "g"))
LOAD_COLS = f"""duration, {dec(up('r_half', f'(duration // {HOUR})'))} AS avg_res_load_power_during,
    {dec('r_before')} AS res_load_week_before, {dec('r_after')} AS res_load_week_after,
    {dec('peak_during * 4')} AS peak_res_load_power_during, {dec('c_during')} AS energy_consumption_during,
    {dec('base')} AS avg_res_load_power_before_after"""
PRICE_COLS = f"""{dec('wd')} AS avg_weighted_price_during, round(wb, 6) AS avg_weighted_price_week_before,
    round(wa, 6) AS avg_weighted_price_week_after, {dec('pd')} AS avg_price_during,
    {dec('pb')} AS avg_price_week_before, {dec('pa')} AS avg_price_week_after"""
EXTENT_COLS = f"""{dec(away('4 * r_during - n_during * base', '4'))} AS extent,
    {dec(away('4 * rp_during - base * p_during', '400'))} AS storage_made_electricity_value"""
DELTA_COLS = f"""{dec('inc2', 200)} AS price_increase_during, rel::DOUBLE AS relative_price_increase_during,
    winc AS price_increase_during_weighted, wrel::DOUBLE AS relative_price_increase_during_weighted,
    in_range AS in_before_after_range"""
COST_COLS = f"""{dec(away('c_during * inc2', '200'))} AS event_cost,
    {dec(away('c_during * CAST(round(winc * 100) AS BIGINT)', '100'))} AS event_cost_weighted"""
MIDDLE = "timezone('Europe/Berlin', to_timestamp((start_time + end_time) // 2 // 1000))"
CALENDAR_COLS = f"""CAST(isodow({MIDDLE}) AS INTEGER) AS day_of_week, CAST(day({MIDDLE}) AS INTEGER) AS day_of_month,
    CAST(month({MIDDLE}) AS INTEGER) AS month, CAST(year({MIDDLE}) AS INTEGER) AS year,
    end_time - start_time AS duration_ms, {dec(up('(end_time - start_time) * 100', str(DAY)))} AS duration_days"""

Q["event_load_stats"] = QUARTER + f"SELECT {EVENT}, {LOAD_COLS} FROM dl"
Q["event_price_stats"] = QUARTER + f"SELECT {EVENT}, {PRICE_COLS} FROM dl"
Q["event_extent"] = QUARTER + f"SELECT {EVENT}, {EXTENT_COLS} FROM dl"
Q["event_price_delta"] = QUARTER + f"SELECT {EVENT}, {DELTA_COLS} FROM dl"
Q["event_cost"] = QUARTER + f"SELECT {EVENT}, {COST_COLS} FROM dl"
Q["event_calendar"] = with_(DAYS, search("days", DAY_SHARE, SEARCH, DAY)) + f"SELECT {EVENT}, {CALENDAR_COLS} FROM found"
Q["event_feature_matrix"] = (
    QUARTER
    + f"""SELECT * FROM (SELECT start_time, {dec(up('duration * 100', str(DAY)))} AS x,
    coalesce({dec(away('4 * r_during - n_during * base', '4'))}, 0) AS y, coalesce(CAST(in_range AS INTEGER), 0)::DOUBLE AS z,
    0.0::DOUBLE AS color, {dec(up('duration * 100', str(DAY)))} AS duration_days FROM dl WHERE threshold = 0.35)
    WHERE duration_days >= 0.05"""
)
Q["event_feature_matrix_thresholds"] = (
    QUARTER
    + f"""SELECT * FROM (SELECT threshold, start_time, {dec(up('duration * 100', str(DAY)))} AS x,
    coalesce({dec(away('4 * r_during - n_during * base', '4'))}, 0) AS y, coalesce(CAST(in_range AS INTEGER), 0)::DOUBLE AS z,
    0.0::DOUBLE AS color, {dec(up('duration * 100', str(DAY)))} AS duration_days FROM dl)
    WHERE duration_days >= 0.05"""
)

# --- weather ---
SHIPPED = "epoch_us(l_shipdate) // 1000 + (l_linenumber - 1) * 10800000"
IN_JANUARY = f"{JAN} + l_orderkey % 720 * 3600000"
POINT_SUMS = """sum(CAST(l_quantity AS BIGINT))::BIGINT AS q, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS p,
    sum(CAST(round(l_discount * 100) AS BIGINT))::BIGINT AS d, sum(CAST(round(l_tax * 100) AS BIGINT))::BIGINT AS t,
    min(l_partkey) AS part, count(*) AS n"""
LAT = "[48.0, 50.0, 51.5, 54.0][s_nationkey % 4 + 1]::DOUBLE"
LNG = "[7.0, 10.0, 13.0][s_nationkey // 4 % 3 + 1]::DOUBLE"


def points(instant: str = SHIPPED) -> str:
    return f"""wsum AS (SELECT {instant} AS date_ms, s_nationkey, {POINT_SUMS}
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    wp AS (SELECT date_ms, s_nationkey, {LAT} AS lat, {LNG} AS lng, {up('q * 100', '4 * n')} AS w100, {up('q * 100', '6 * n')} AS w10,
        (part * 37 % 361)::DOUBLE AS dir, {up('p', '200 * n')} AS direct, {up('d * 1000', 'n')} AS diffuse, {up('t * 100', 'n')} AS temp
        FROM wsum)"""


BERLIN_DAY = (
    "epoch_ms(timezone('Europe/Berlin', date_trunc('day', timezone('Europe/Berlin', to_timestamp(date_ms / 1000)))))"
)


def octants(north_and: bool = False) -> str:
    out = []
    for i, name in enumerate(OCTANTS):
        lo, hi = 45.0 * i - 22.5, 45.0 * i + 22.5
        link = "AND" if north_and else "OR"
        cond = f"dir > {lo + 360} {link} dir <= {hi}" if i == 0 else f"dir > {lo} AND dir <= {hi}"
        out.append(f"count(*) FILTER ({cond}) AS n_{name}")
    return ", ".join(out)


TOP = "greatest(" + ", ".join(f"n_{n}" for n in OCTANTS) + ")"
DIRECTION = "CASE " + " ".join(f"WHEN {TOP} = n_{n} THEN '{n}'" for n in OCTANTS) + " END"


def score(expr: str) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(8,4)), 2) AS DOUBLE)"


def scores(wmax: str, w: str, d: str, f: str, null_wind: bool = False) -> dict[str, str]:
    cap = f"least({w}, 11.0::DOUBLE)"
    if null_wind:
        cap = f"CASE WHEN {w} IS NOT NULL THEN {cap} END"
    return {
        "repi_30mix": score(f"{wmax} + {d} / 30 + {f} / 30"),
        "repi_power1avg": score(f"pow({cap}, 3) + {d} + {f}"),
        "repi_power1avg2": score(f"pow({cap}, 3) + {d} * 2 + {f} * 2"),
        "repi_power_exp": score(f"1550 * (1 - exp(-0.001::DOUBLE * pow({w}, 3))) + {d} * 1.4::DOUBLE + {f} * 1.4::DOUBLE"),
        "repi_square1avg": score(f"pow({cap}, 2) + {d} + {f}"),
    }


def weather(freq: str, north_and: bool = False, out: str = "wa") -> str:
    key = "date_ms" if freq == "hour" else BERLIN_DAY
    slots = 12 if freq == "hour" else 288
    aggs = []
    for col, name, band in [
        ("direct", "direct_radiation", "lat < 52"), ("diffuse", "diffuse_radiation", "lat < 52"), ("temp", "temp2m", "lat < 52"),
        ("w10", "wind_speed_10", "lat > 51"), ("w100", "wind_speed_100", "lat > 51"),
    ]:
        aggs.append(f"min({col}) FILTER ({band}) / 100.0::DOUBLE AS {name}_min")
        aggs.append(
            f"{up(f'sum({col}) FILTER ({band}) * 10', f'count(*) FILTER ({band})')} / 1000.0::DOUBLE AS {name}_avg"
        )
        aggs.append(f"max({col}) FILTER ({band}) / 100.0::DOUBLE AS {name}_max")
    formulas = scores("wind_speed_100_max", "wind_speed_100_avg", "direct_radiation_avg", "diffuse_radiation_avg")
    return f"""{out}_c AS (SELECT {key} AS date_ms, {', '.join(aggs)}, {octants(north_and)}
        FROM wp GROUP BY 1 HAVING count(*) FILTER (lat < 52) > 0 AND count(*) FILTER (lat > 51) > 0),
    {out} AS (SELECT * EXCLUDE ({', '.join('n_' + n for n in OCTANTS)}), {DIRECTION} AS wind_direction,
        {dec(up(f'{TOP} * 100', str(slots)))} AS wind_dir_uniformity, '{freq}' AS resolution,
        {', '.join(f'{v} AS {k}' for k, v in formulas.items())} FROM {out}_c)"""


JAN_WEATHER = points(IN_JANUARY) + ",\n" + weather("hour")

Q["weather_hourly"] = with_(points(), weather("hour")) + "SELECT * FROM wa"
Q["weather_daily"] = with_(points(), weather("day")) + "SELECT * FROM wa"
Q["weather_daily_compat"] = (
    with_(points(), weather("day", True)) + "SELECT date_ms, wind_direction, wind_dir_uniformity FROM wa"
)
_SHORT = "date_ms, resolution, wind_speed_100_avg, direct_radiation_avg, repi_power1avg2"
Q["weather_history"] = (
    with_(points(IN_JANUARY), weather("hour"), weather("day", out="wd"))
    + f"SELECT {_SHORT} FROM wa UNION ALL SELECT {_SHORT} FROM wd"
)
Q["wind_octants"] = with_(points()) + f"SELECT date_ms, {octants()} FROM wp GROUP BY 1"
Q["dominant_direction"] = (
    with_(points(IN_JANUARY), f"oc AS (SELECT date_ms, {octants()} FROM wp GROUP BY 1)")
    + f"SELECT date_ms, {DIRECTION} AS wind_direction, {dec(up(f'{TOP} * 100', '12'))} AS wind_dir_uniformity FROM oc"
)
_W = "CASE WHEN lat > 51 THEN w100 / 100.0::DOUBLE END"
for _name, _null in [("repi_all", False), ("repi_null_wind", True)]:
    Q[_name] = (
        with_(points())
        + "SELECT date_ms, s_nationkey, "
        + ", ".join(
            f"{v} AS {k}" for k, v in scores(_W, _W, "direct / 100.0::DOUBLE", "diffuse / 100.0::DOUBLE", _null).items()
        )
        + " FROM wp"
    )

_WEATHER_MEANS = {
    "repi_power1avg": "repi_power1avg", "repi_power1avg2": "repi_power1avg2", "repi_power_exp_avg": "repi_power_exp",
    "wind_speed_100_avg": "wind_speed_100_avg", "diffuse_radiation_avg": "diffuse_radiation_avg",
    "direct_radiation_avg": "direct_radiation_avg",
}


def weather_cols() -> str:
    inside = "FROM wa w WHERE w.date_ms > f.start_time AND w.date_ms < f.end_time"
    cols = []
    for out, col in _WEATHER_MEANS.items():
        mils = f"sum(CAST(round(w.{col} * 1000) AS BIGINT))"
        cols.append(f"(SELECT {dec(up(mils, '10 * count(*)'))} {inside}) AS {out}")
    cols.append(f"(SELECT max(w.repi_power_exp) {inside}) AS repi_power_exp_max")
    cols.append(f"(SELECT min(w.repi_power_exp) {inside}) AS repi_power_exp_min")
    return ", ".join(cols)


Q["event_weather_stats"] = (
    with_(EV, grid("g", "quarterhour"), search("g", WS_SHARE, SEARCH, HOUR), JAN_WEATHER)
    + f"SELECT {EVENT}, {weather_cols()} FROM found f"
)
Q["enriched_events"] = (
    with_(
        EV, grid("g", "quarterhour"), search("g", WS_SHARE, THRESHOLDS, HOUR, f"ts > {JAN}"), stats("found", "g"), JAN_WEATHER
    )
    + f"""SELECT {EVENT}, {LOAD_COLS}, {PRICE_COLS}, {EXTENT_COLS}, {DELTA_COLS}, {COST_COLS}, {CALENDAR_COLS},
    {weather_cols()}, CAST(round(threshold * 100) AS INTEGER) AS threshold_percent FROM dl f"""
)

# --- forecasts ---
FIELDS = {
    "wind_speed_80m": "w80", "wind_speed_120m": "w120", "wind_speed_180m": "w180",
    "direct_radiation": "direct", "diffuse_radiation": "diffuse", "temperature_2m": "temp",
}
LEADS = ["", "_previous_day1", "_previous_day2", "_previous_day3"]


def forecasts(seconds: str = f"({SHIPPED}) // 86400000 * 86400") -> str:
    leads = ", ".join(
        f"{up(f'{src} * (100 + {k})', '100')} AS {name}{lead}"
        for name, src in FIELDS.items()
        for k, lead in enumerate(LEADS)
    )
    return f"""fsum AS (SELECT {seconds} AS timestamp_s, s_nationkey, l_returnflag AS model, {POINT_SUMS}
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
    f1 AS (SELECT *, {up('q * 100', '5 * n')} + 100 AS w80, {up('t', 'n')} AS tax FROM fsum),
    f2 AS (SELECT *, {up('w80 * (105 + tax)', '100')} AS w120, {up('w80 * (110 + tax)', '100')} AS w180,
        {up('p', '200 * n')} AS direct, {up('d * 1000', 'n')} AS diffuse, {up('t * 100', 'n')} AS temp FROM f1),
    fp AS (SELECT timestamp_s, s_nationkey, model, 'hour' AS temporal_resolution, {LAT} AS lat, {LNG} AS lng, {leads} FROM f2)"""


def hub(low: str, high: str) -> str:
    return f"({low}) * pow(1.25::DOUBLE, ln(({high}) / ({low})) / ln(1.5::DOUBLE))"


def forecast_agg() -> str:
    aggs = []
    for name, short in [("direct_radiation", "direct_radiation"), ("diffuse_radiation", "diffuse_radiation"), ("temperature_2m", "temp2m")]:
        aggs += [f"min({name}) FILTER (lat < 52) / 100.0::DOUBLE AS {short}_min", f"max({name}) FILTER (lat < 52) / 100.0::DOUBLE AS {short}_max"]
        for lead in LEADS:
            out = f"{name}_avg{lead}" if lead else f"{short}_avg"
            aggs.append(f"{up(f'sum({name}{lead}) FILTER (lat < 52) * 10', 'count(*) FILTER (lat < 52)')} / 1000.0::DOUBLE AS {out}")
    for h in (80, 120, 180):
        for lead in LEADS:
            col = f"wind_speed_{h}m{lead}"
            aggs.append(f"sum({col}) FILTER (lat > 51)::DOUBLE / count(*) FILTER (lat > 51) / 100 AS a{h}{lead}")
            if lead:
                aggs.append(f"{up(f'sum({col}) FILTER (lat > 51) * 10', 'count(*) FILTER (lat > 51)')} / 1000.0::DOUBLE AS wind_speed_{h}m_avg{lead}")
            else:
                aggs.append(f"round(sum({col}) FILTER (lat > 51)::DOUBLE / count(*) FILTER (lat > 51) / 100, 6) AS wind_speed_{h}m_avg")
    hubs = ", ".join(f"CAST(CAST({hub(f'a80{lead}', f'a120{lead}')} AS DECIMAL(6,3)) AS DOUBLE) AS wind_100m_log{lead}" for lead in LEADS)
    idx = []
    for lead in LEADS:
        s = scores("0", f"wind_100m_log{lead}", f"direct_radiation_avg{lead}", f"diffuse_radiation_avg{lead}")
        idx += [f"{s['repi_power1avg2']} AS repi_power1avg2{lead}", f"{s['repi_power_exp']} AS repi_power_exp{lead}"]
    hidden = ", ".join(f"a{h}{lead}" for h in (80, 120, 180) for lead in LEADS)
    return f"""fa AS (SELECT timestamp_s, model, temporal_resolution, {', '.join(aggs)} FROM fp
        GROUP BY 1, 2, 3 HAVING count(*) FILTER (lat < 52) > 0 AND count(*) FILTER (lat > 51) > 0),
    fh AS (SELECT *, {hubs} FROM fa),
    fo AS (SELECT * EXCLUDE ({hidden}), {', '.join(idx)} FROM fh)"""


Q["forecast_agg"] = with_(forecasts(), forecast_agg()) + "SELECT * FROM fo"


def alpha(w80: str, w120: str, w180: str) -> str:
    return (
        f"(ln({w120} / {w80}) / ln(120.0::DOUBLE / 80.0) + ln({w180} / {w120}) / ln(180.0::DOUBLE / 120.0)"
        f" + ln({w180} / {w80}) / ln(180.0::DOUBLE / 80.0)) / 3.0"
    )


_H = [f"wind_speed_{h}m / 100.0::DOUBLE" for h in (80, 120, 180)]
_HP = [f"({h})" for h in _H]
Q["wind_at_height"] = (
    with_(forecasts())
    + f"""SELECT timestamp_s, s_nationkey, model, round({hub(_H[0], _H[1])}, 6) AS wind_100m, round({alpha(*_HP)}, 6) AS alpha_avg,
    round({_HP[0]} * pow(1.25::DOUBLE, {alpha(*_HP)}), 6) AS wind_100m_mean FROM fp"""
)
Q["wind_model_comparison"] = (
    with_(
        forecasts(),
        "m AS (SELECT model, lat, lng, "
        + ", ".join(f"sum(wind_speed_{h}m)::DOUBLE / count(*) / 100 AS a{h}" for h in (80, 120, 180))
        + " FROM fp GROUP BY 1, 2, 3)",
    )
    + f"""SELECT model, lat, lng, CAST(round(CAST({hub('a80', 'a120')} AS DECIMAL(6,3)), 2) AS DOUBLE) AS wind_speed_80_120_log,
    CAST(round(CAST(a80 * pow(1.25::DOUBLE, {alpha('a80', 'a120', 'a180')}) AS DECIMAL(6,3)), 2) AS DOUBLE) AS wind_speed_80_120_180_log_avg
    FROM m"""
)


def micro_mean(col: str) -> str:
    """Mean of hundredths over the southern points, six digits kept, as DOUBLE."""
    return f"{up(f'sum({col}) FILTER (lat < 52) * 10000', 'count(*) FILTER (lat < 52)')}::DOUBLE / 1000000"


def half_even(x: str) -> str:
    """Two digits, halves to even, judged on the shortest decimal notation."""
    v = f"(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30,18)) * 100)"
    q, r = f"CAST(floor({v}) AS BIGINT)", f"({v} - floor({v}))"
    return f"CAST({q} + CASE WHEN {r} > 0.5 OR ({r} = 0.5 AND {q} % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100"


_LIVE = f"""pow(CASE WHEN count(*) FILTER (lat > 51) > 0 THEN least(avg({hub(_H[0], _H[1])}) FILTER (lat > 51), 11.0::DOUBLE) END, 3)
    + {micro_mean('direct_radiation')} * 2 + {micro_mean('diffuse_radiation')} * 2"""
Q["live_index"] = (
    with_(forecasts())
    + f"SELECT timestamp_s, model, {half_even('x')} AS repi FROM (SELECT timestamp_s, model, {_LIVE} AS x FROM fp GROUP BY 1, 2)"
)
Q["live_documents"] = (
    with_(forecasts())
    + f"SELECT timestamp_s, {half_even('x')} AS repi FROM (SELECT timestamp_s, {_LIVE} AS x FROM fp GROUP BY 1)"
)

Q["live_stream"] = Q["live_documents"]

# --- derived series ---
KEYS = "ts AS unix_timestamp_ms, region, resolution"
PRODUCED = "(pv + wind + hydro + bio + lignite)"
SHARES = f"""sh AS (SELECT ts, region, resolution, {dec('pv + wind')} AS sum_of_photovoltaic_wind_onshore_offshore_computed,
    {WS_SHARE} AS {WS}, {RE_SHARE} AS {RE}, {dec(f'total - {PRODUCED}')} AS import_to_validate FROM g WHERE total <> 0)"""
Q["shares"] = with_(EV, grid(), SHARES) + "SELECT ts AS unix_timestamp_ms, * EXCLUDE (ts) FROM sh"
Q["published_table"] = Q["shares"]
Q["net_import"] = (
    with_(EV, grid("g", "quarterhour"))
    + f"SELECT {KEYS}, {dec(PRODUCED)} AS total_production, {dec(f'total - {PRODUCED}')} AS net_import FROM g"
)
Q["share_from_pair"] = with_(EV, grid()) + f"SELECT {KEYS}, round({PAIR_SHARE}, 9) AS share FROM g"


def change(src: str, step: int) -> str:
    by = "PARTITION BY region, resolution ORDER BY ts"
    return f"""lg AS (SELECT ts, region, resolution, price, lag(price) OVER ({by}) AS last_price, lag(ts) OVER ({by}) AS last_time FROM {src}),
    pc AS (SELECT ts, region, resolution, {dec('price')} AS current_price, last_time, {dec('last_price')} AS last_price,
        {dec('price - last_price')} AS gerlux_price_change_abs_computed,
        {dec(away('(price - last_price) * 1000', 'last_price'), 1000)} AS gerlux_price_change_rel_computed
        FROM lg WHERE price IS NOT NULL AND last_price IS NOT NULL AND last_price <> 0 AND ts - last_time = {step})"""


ALL_PC = "SELECT ts AS unix_timestamp_ms, * EXCLUDE (ts) FROM pc"
Q["price_change"] = with_(EV, grid("g", "quarterhour"), change("g", 900_000)) + ALL_PC
Q["price_change_daily"] = with_(DAYS, change("days", DAY)) + ALL_PC
Q["energy_to_power"] = (
    with_(EV, grid("g"), grid("q", "quarterhour"))
    + f"""SELECT {KEYS}, {dec('residual')} AS res_load_power FROM g
    UNION ALL SELECT {KEYS}, {dec('residual * 4')} AS res_load_power FROM q"""
)
Q["duration_columns"] = (
    with_(EV, grid(), search("g", PAIR_SHARE, [0.35], HOUR))
    + f"""SELECT start_time, (end_time - start_time) // {HOUR} * {HOUR} AS ms, round((end_time - start_time) / {HOUR}.0::DOUBLE, 6) AS hours,
    round((end_time - start_time) / {DAY}.0::DOUBLE, 6) AS days, round((end_time - start_time) / {WEEK}.0::DOUBLE, 6) AS weeks FROM found"""
)

# --- wide tables ---
def feed(step: int = HOUR) -> str:
    return f"""feed AS (SELECT event_type AS series, ms // {step} * {step} AS ts, 'DE' AS region, 'hour' AS resolution,
    CASE WHEN event_id % 50 = 0 THEN -10000000000 WHEN event_id % 7 <> 0 THEN cents END AS v, event_id % 50 = 0 AS is_bucket, event_id AS seq FROM ev)"""


LONG = feed()


def wide(out: str = "wide", where: str = "TRUE") -> str:
    cols = ", ".join(f"arg_max(v, seq) FILTER (series = '{n}' AND v IS NOT NULL) AS v_{n}" for n in FEED)
    return f"""{out} AS (SELECT ts, region, resolution, arg_min(is_bucket, seq) AS is_bucket, {cols} FROM feed WHERE {where} GROUP BY 1, 2, 3)"""


def doubles(fmt: str = "v_{n}") -> str:
    return ", ".join(f"{dec(fmt.format(n=n))} AS {n}" for n in FEED)


CLEARED = "nullif(v_{n}, -10000000000)"
Q["widen_series"] = with_(EV, LONG, wide()) + f"SELECT {KEYS}, is_bucket AS is_bucket_timestamp, {doubles()} FROM wide"
Q["union_feeds"] = with_(EV, LONG) + "SELECT series, is_bucket AS is_bucket_timestamp, count(*) AS n FROM feed GROUP BY 1, 2"
Q["union_feeds_rows"] = (
    with_(EV, LONG)
    + f"SELECT series, {KEYS}, {dec('v')} AS value, is_bucket AS is_bucket_timestamp, seq FROM feed"
)
_MERGED = ", ".join(
    [f"coalesce(d.v_{n}, b.v_{n}) AS v_{n}" for n in FEED[:3]] + [f"b.v_{n} AS v_{n}" for n in FEED[3:]]
)
Q["upsert_sparse"] = (
    with_(
        EV, LONG, wide("b", f"ts < {TWENTIETH}"), wide("d", f"ts >= {TENTH}"),
        f"""m AS (SELECT coalesce(b.ts, d.ts) AS ts, coalesce(b.region, d.region) AS region, coalesce(b.resolution, d.resolution) AS resolution,
        CASE WHEN b.ts IS NOT NULL THEN b.is_bucket ELSE d.is_bucket END AS is_bucket, {_MERGED}
        FROM b FULL JOIN d ON b.ts = d.ts AND b.region = d.region AND b.resolution = d.resolution)""",
    )
    + f"SELECT {KEYS}, is_bucket AS is_bucket_timestamp, {doubles()} FROM m"
)
Q["upsert_sparse_whole"] = (
    with_(
        EV, LONG, wide("b", f"ts < {TWENTIETH}"), wide("d", f"ts >= {TENTH}"),
        f"""m AS (SELECT coalesce(b.ts, d.ts) AS ts, coalesce(b.region, d.region) AS region, coalesce(b.resolution, d.resolution) AS resolution,
        CASE WHEN b.ts IS NOT NULL THEN b.is_bucket ELSE d.is_bucket END AS is_bucket,
        {", ".join(f"coalesce(d.v_{n}, b.v_{n}) AS v_{n}" for n in FEED)}
        FROM b FULL JOIN d ON b.ts = d.ts AND b.region = d.region AND b.resolution = d.resolution)""",
    )
    + f"SELECT {KEYS}, is_bucket AS is_bucket_timestamp, {doubles()} FROM m"
)
Q["bucket_starts"] = with_(EV, feed(1), wide()) + f"SELECT {KEYS} FROM wide WHERE v_view = -10000000000 AND is_bucket"
Q["clear_sentinel"] = with_(EV, LONG, wide()) + f"SELECT {KEYS}, {doubles(CLEARED)} FROM wide"
Q["drop_empty_rows"] = (
    with_(EV, LONG, wide())
    + f"""SELECT {KEYS}, {dec(CLEARED.format(n='view'))} AS view, {dec(CLEARED.format(n='click'))} AS click FROM wide
    WHERE {CLEARED.format(n='view')} IS NOT NULL OR {CLEARED.format(n='click')} IS NOT NULL"""
)
Q["dashboard_series"] = (
    with_(EV, LONG, wide())
    + f"SELECT ts AS unix_timestamp_ms, {doubles(CLEARED)} FROM wide WHERE "
    + " OR ".join(f"{CLEARED.format(n=n)} IS NOT NULL" for n in FEED)
)
_LO, _HI = 852_076_800, 883_612_800
Q["replace_range"] = (
    with_(forecasts())
    + f"""SELECT timestamp_s, s_nationkey, model,
    {dec(f"wind_speed_80m + CASE WHEN timestamp_s >= {_LO} AND timestamp_s < {_HI} AND model = 'A' THEN 100 ELSE 0 END")} AS wind_speed_80m FROM fp"""
)
_IN_YEAR = f"timestamp_s >= {_LO} AND timestamp_s < {_HI} AND model = 'A'"
Q["replace_range_stored"] = (
    with_(forecasts())
    + f"""SELECT timestamp_s, s_nationkey, model, {dec(f"wind_speed_80m + CASE WHEN {_IN_YEAR} THEN 100 ELSE 0 END")} AS wind_speed_80m
    FROM fp WHERE NOT ({_IN_YEAR} AND timestamp_s >= 867801600)"""
)
Q["replace_range_spans"] = Q["replace_range_stored"]
Q["outside_range"] = (
    with_(DAYS) + f"SELECT {KEYS}, {dec('price')} AS price FROM days WHERE NOT (ts >= {_LO}000 AND ts < {_HI}000)"
)
Q["assert_unique"] = with_(EV, LONG) + f"SELECT {KEYS}, count(*) AS n FROM feed GROUP BY ts, region, resolution HAVING count(*) > 1"
Q["duplicate_instants"] = with_(EV, LONG) + "SELECT ts AS unix_timestamp_ms, count(*) AS n FROM feed GROUP BY 1 HAVING count(*) > 1"
Q["value_profile"] = (
    with_(EV, LONG)
    + f"""SELECT series, {dec('max(v)')} AS max_value,
    CAST(max(CASE WHEN v % 100 = 0 THEN 0 WHEN v % 10 = 0 THEN 1 WHEN v IS NOT NULL THEN 2 END) AS INTEGER) AS max_fraction_digits FROM feed GROUP BY 1"""
)

# --- reads ---
Q["slice_series"] = (
    with_(EV, grid())
    + f"""SELECT {KEYS}, {dec('residual')} AS power_consumption_residual_load, {dec('total')} AS power_consumption_total
    FROM g WHERE ts BETWEEN {TENTH} AND {TWENTIETH}"""
)
Q["stored_series"] = Q["slice_series"]
Q["combine_derived"] = (
    with_(EV, grid(), SHARES, sparse(), change("sp", HOUR))
    + f"""SELECT ts AS unix_timestamp_ms, region, resolution, gerlux_price_change_abs_computed, gerlux_price_change_rel_computed, {RE}
    FROM pc NATURAL FULL JOIN sh"""
)
_WALL = "epoch_ms(timezone('Europe/Berlin', to_timestamp(sh.ts / 1000)))"
for _name, _at in [("attach_weather", "sh.ts"), ("attach_weather_wall", _WALL)]:
    Q[_name] = (
        with_(EV, grid(), SHARES, JAN_WEATHER)
        + f"""SELECT sh.ts AS unix_timestamp_ms, sh.region, sh.resolution, sh.{WS}, wind_speed_100_avg, repi_power_exp
        FROM sh LEFT JOIN wa ON wa.date_ms = {_at}"""
    )
Q["merge_series"] = (
    with_(EV, grid(), sparse(), change("sp", HOUR), f"raw AS (SELECT ts, region, resolution, total FROM sp WHERE ts > {TENTH})")
    + f"""SELECT coalesce(raw.ts, pc.ts) AS unix_timestamp_ms, coalesce(raw.region, pc.region) AS region,
    coalesce(raw.resolution, pc.resolution) AS resolution, {dec('total')} AS power_consumption_total, last_time, current_price
    FROM raw FULL JOIN pc ON raw.ts = pc.ts AND raw.region = pc.region AND raw.resolution = pc.resolution"""
)
Q["merge_series_whole"] = (
    with_(EV, grid(), sparse(), change("sp", HOUR))
    + f"""SELECT coalesce(sp.ts, pc.ts) AS unix_timestamp_ms, coalesce(sp.region, pc.region) AS region,
    coalesce(sp.resolution, pc.resolution) AS resolution, {dec('total')} AS power_consumption_total, last_time, current_price
    FROM sp FULL JOIN pc ON sp.ts = pc.ts AND sp.region = pc.region AND sp.resolution = pc.resolution"""
)
_LOCAL = "timezone('Europe/Berlin', to_timestamp(ts / 1000))"
Q["wall_clock"] = (
    with_(DAYS) + f"SELECT {KEYS}, epoch_ms({_LOCAL}) AS wall_ms, strftime({_LOCAL}, '%Y/%m/%d %H:%M') AS label FROM days"
)
Q["read_series"] = (
    with_(EV, grid(), SHARES, sparse(), change("sp", HOUR), JAN_WEATHER)
    + f"""SELECT epoch_ms(timezone('Europe/Berlin', to_timestamp(sp.ts / 1000))) AS unix_timestamp_ms, sp.region, sp.resolution,
    {dec('sp.total')} AS power_consumption_total, {dec('sp.price')} AS market_price_ger_lux,
    sh.{RE}, pc.gerlux_price_change_abs_computed, wa.wind_speed_100_avg, wa.repi_power_exp
    FROM sp LEFT JOIN sh ON sp.ts = sh.ts LEFT JOIN pc ON sp.ts = pc.ts LEFT JOIN wa ON wa.date_ms = sp.ts
    WHERE sp.ts BETWEEN {JAN} AND {TWENTIETH}"""
)
Q["read_default_series"] = (
    with_(EV, grid())
    + f"""SELECT epoch_ms({_LOCAL}) AS unix_timestamp_ms, region, resolution, {dec('residual')} AS power_consumption_residual_load,
    {dec('total')} AS power_consumption_total FROM g WHERE ts BETWEEN {JAN} AND {TWENTIETH}"""
)


def smooth(value: str, tail: str) -> str:
    return (
        with_(
            EV, grid(), sparse(),
            f"""ma AS (SELECT region, resolution, ts, count(*) OVER w AS n, {up('sum(ts) OVER w', 'count(*) OVER w')} AS mean_time,
            avg({value}) OVER w AS mean_value, row_number() OVER (PARTITION BY region, resolution ORDER BY ts DESC) AS from_end
            FROM sp WINDOW w AS (PARTITION BY region, resolution ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING))""",
        )
        + f"SELECT region, resolution, mean_time, round(mean_value, 6) AS mean_value FROM ma WHERE n = 24 {tail}"
    )


Q["moving_average"] = smooth("price / 100.0::DOUBLE", "")
Q["moving_average_compat"] = smooth("coalesce(price, 0) / 100.0::DOUBLE", "AND from_end > 25")

# --- analyses ---
YEAR = "CAST(year(make_timestamp(ts * 1000)) AS INTEGER)"
_CURVE = f"""cv AS (SELECT ts, region, resolution, price, {YEAR} AS year,
    CAST(row_number() OVER (PARTITION BY region, {YEAR} ORDER BY price DESC, ts) AS INTEGER) AS rank FROM days)"""
Q["price_duration_curve"] = (
    with_(DAYS, _CURVE) + f"SELECT {KEYS}, {dec('price')} AS market_price_ger_lux, year, rank FROM cv"
)
_YEARS = [1996, 1997, 1998, 1999, 2000, 2001]
Q["align_by_rank"] = (
    with_(DAYS, _CURVE)
    + f"SELECT y{_YEARS[0]}.region, y{_YEARS[0]}.resolution, y{_YEARS[0]}.rank, "
    + ", ".join(f"{dec(f'y{y}.price')} AS price{y}" for y in _YEARS)
    + " FROM "
    + ", ".join(f"(SELECT * FROM cv WHERE year = {y}) y{y}" for y in _YEARS)
    + " WHERE "
    + " AND ".join(
        f"y{a}.rank = y{b}.rank AND y{a}.region = y{b}.region" for a, b in zip(_YEARS, _YEARS[1:])
    )
)
Q["surplus_ranking"] = (
    with_(DAYS)
    + f"""SELECT {KEYS}, {dec('price')} AS market_price_ger_lux, strftime({_LOCAL}, '%m/%d %H:%M') AS date,
    CAST(row_number() OVER (PARTITION BY region, {YEAR} ORDER BY price DESC, ts) AS INTEGER) AS hour, {YEAR} AS year, round({DAY_SHARE}, 9) AS size
    FROM days WHERE {DAY_SHARE} >= 0.5"""
)
Q["share_with_price"] = (
    with_(EV, grid(), SHARES)
    + f"SELECT ts AS unix_timestamp_ms, region, resolution, {RE}, {dec('price')} AS market_price_ger_lux FROM sh JOIN g USING (ts, region, resolution)"
)
Q["yearly_extremes"] = (
    with_(
        DAYS,
        f"""x AS (SELECT *, {YEAR} AS year, max(total) OVER (PARTITION BY region, {YEAR}) AS hi,
        min(total) OVER (PARTITION BY region, {YEAR}) AS lo FROM days)""",
    )
    + f"""SELECT {KEYS}, {dec('total')} AS power_consumption_total, year, strftime({_LOCAL}, '%Y/%m/%d %H:%M') AS date,
    {dec('price')} AS market_price_ger_lux FROM x WHERE total = hi OR total = lo"""
)
Q["yearly_peak"] = with_(DAYS) + f"SELECT region, resolution, {YEAR} AS year, {dec('max(total)')} AS peak FROM days GROUP BY 1, 2, 3"
Q["yearly_energy"] = (
    with_(DAYS)
    + f"""SELECT region, resolution, {YEAR} AS year, {dec('sum(total)', 100_000_000)} AS energy FROM days
    WHERE {YEAR} IN (1995, 1996, 1997, 1998, 1999, 2000) GROUP BY 1, 2, 3"""
)


def _coverage(name: str, where: str) -> str:
    def at(agg: str) -> str:
        return f"strftime(timezone('Europe/Berlin', to_timestamp({agg}(ts) / 1000)), '%Y/%m/%d %H:%M')"

    return f"SELECT region, resolution, '{name}' AS rows, count(*) AS n, {at('min')} AS first, {at('max')} AS last FROM sp WHERE {where} GROUP BY 1, 2"


Q["series_coverage"] = (
    with_(EV, grid(), sparse()) + _coverage("all", "TRUE") + " UNION ALL " + _coverage("priced", "price IS NOT NULL")
)
Q["previous_value"] = (
    with_(EV)
    + """SELECT event_type, event_id, lag(event_id) OVER w AS last_id, lag(ms) OVER w AS last_ms
    FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY event_id)"""
)
Q["earliest_k"] = (
    with_(EV)
    + f"""SELECT event_type, event_id, ms, {dec('cents')} AS value FROM ev
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 3"""
)


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


REGISTRY = "reg AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_text(label)}, {_text(column)})" for i, label, column in DERIVED_SERIES + RAW_SERIES
) + ") t(series_id, label, column_name))"
KIND = """CASE event_type WHEN 'view' THEN 'electricity_production_photovoltaics' WHEN 'click' THEN 'electricity_production_wind_onshore'
    WHEN 'signup' THEN 'electricity_production_hydropower' WHEN 'purchase' THEN 'electricity_production_biomass'
    WHEN 'error' THEN 'electricity_production_lignite' END"""
Q["availability_matrix"] = (
    with_(EV, REGISTRY, f"cnt AS (SELECT {KIND} AS column_name, 'DE' AS region, 'hour' AS resolution, count(*) AS n FROM ev GROUP BY 1)")
    + f"""SELECT column_name, region, resolution, n IS NOT NULL AS available, coalesce(n, 0) AS n_points
    FROM (SELECT column_name, region, resolution FROM reg, (SELECT unnest({REGIONS!r}) AS region), (SELECT unnest({RESOLUTIONS!r}) AS resolution))
    LEFT JOIN cnt USING (column_name, region, resolution)"""
)
_CLASS = "CASE " + " ".join(f"WHEN contains(label, '{a}') THEN '{b}'" for a, b in LABEL_CLASSES) + f" ELSE '{DEFAULT_LABEL_CLASS}' END"
_AXIS = (
    "CASE "
    + " ".join(
        f"WHEN contains({'lower(column_name)' if low else 'column_name'}, '{a}') THEN '{b}'" for low, a, b in labels.AXIS_RULES
    )
    + f" ELSE '{labels.DEFAULT_AXIS}' END"
)
Q["series_class"] = (
    with_(EV, REGISTRY, f"cnt AS (SELECT {KIND} AS column_name, count(*) AS n FROM ev GROUP BY 1)")
    + f"""SELECT series_id, {_CLASS} AS unit_class, {_AXIS} AS axis,
    array_to_string(list_transform(string_split(column_name, '_'), lambda w: CASE WHEN w IN ('of', 'to') THEN w ELSE upper(w[1]) || w[2:] END), ' ') AS title,
    coalesce(n, 0) AS n FROM reg LEFT JOIN cnt USING (column_name)"""
)


# --- several regions ---
REGION_ROWS = f"""rg0 AS (SELECT ms // {HOUR} * {HOUR} AS ts, event_id % 4 AS place,
    {", ".join(f"coalesce(sum(cents) FILTER (event_id // 4 % 12 = {k}), 0)::BIGINT AS g{k}" for k in range(12))},
    sum(cents)::BIGINT AS total0, coalesce(sum(cents) FILTER (event_id // 4 % 12 NOT IN (2, 7, 8)), 0)::BIGINT AS residual0,
    coalesce(sum(cents) FILTER (event_id % 5 = 0) // 10, 0)::BIGINT AS pumped, {up('sum(cents)', 'count(*)')} AS price0
    FROM ev GROUP BY 1, 2),
    rg AS (SELECT *, ['DE', 'AT', 'LU', 'DE-LU'][place + 1] AS region, 'hour' AS resolution,
    CASE WHEN r = 3 THEN -10000000000 ELSE g8 END AS solar, CASE WHEN r <> 11 THEN g2 END AS sea,
    CASE WHEN r <> 5 THEN residual0 END AS residual, CASE WHEN r = 7 THEN 0 ELSE total0 END AS total,
    CASE WHEN r = 13 THEN NULL WHEN r = 17 THEN 0 ELSE price0 END AS price
    FROM (SELECT *, (ts // {HOUR} + place) % 23 AS r FROM rg0))"""
_LEFT = "residual - g3 - g5 - g6 - g10 + pumped"
_MADE = "g0 + g1 + sea + g3 + g4 + g5 + g6 + g7 + solar + g9 + g10 + g11 - pumped"
REGION_SHARES = f"""rs AS (SELECT ts, region, resolution, {dec('solar + g7 + sea')} AS sum_of_photovoltaic_wind_onshore_offshore_computed,
    (100000 - {away('residual * 100000', 'total')})::DOUBLE / 100000 AS {WS},
    (100000 - {away(f'({_LEFT}) * 100000', 'total')})::DOUBLE / 100000 AS {RE},
    {dec(f'total - ({_MADE})')} AS import_to_validate
    FROM rg WHERE residual IS NOT NULL AND total <> 0 AND solar <> -10000000000 AND sea IS NOT NULL)"""
Q["shares_regions"] = with_(EV, REGION_ROWS, REGION_SHARES) + "SELECT ts AS unix_timestamp_ms, * EXCLUDE (ts) FROM rs"
Q["events_regions"] = with_(EV, REGION_ROWS, REGION_SHARES, search("rs", RE, SEARCH, HOUR)) + "SELECT * FROM found"
Q["price_change_regions"] = with_(EV, REGION_ROWS, change("rg", HOUR)) + ALL_PC
Q["previous_value_chunks"] = Q["previous_value"]
# Columns, axes and titles written out.
_AXES = [(f"g{k}", "energy", t) for k, t in enumerate([
    "Lignite", "Nuclear Energy", "", "Hydropower", "Other Conventional", "Other Renewables", "Biomass", "Wind Onshore", "",
    "Hard Coal", "Pumped Storage", "Natural Gas",
]) if t] + [("sea", "energy", "Wind Offshore"), ("solar", "energy", "Photovoltaics")]
Q["series_axes"] = with_(EV, REGION_ROWS, REGION_SHARES) + " UNION ALL ".join(
    [f"SELECT '{a}' AS axis, 'Electricity Production {t}' AS title, count({c}) AS n FROM rg" for c, a, t in _AXES]
    + ["SELECT 'price', 'Market Price Ger Lux', count(price) FROM rg"]
    + [f"SELECT 'share', 'Share Of Renewable Energies Computed', count({RE}) FROM rs"]
)

# --- correlation ---
_CORR = ["power_consumption_total", "power_consumption_residual_load", "market_price_ger_lux", "wind_speed_100_avg"]
CORR_ROWS = with_(
    EV, grid(), sparse(), JAN_WEATHER,
    f"""cr AS (SELECT {dec('total')} AS {_CORR[0]}, {dec('residual')} AS {_CORR[1]}, {dec('price')} AS {_CORR[2]}, {_CORR[3]}
    FROM sp LEFT JOIN wa ON wa.date_ms = sp.ts)""",
    "pr AS ("
    + " UNION ALL ".join(
        f"SELECT '{x}' AS column_x, '{y}' AS column_y, {x} AS x, {y} AS y FROM cr WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
        for x in _CORR
        for y in _CORR
    )
    + ")",
)
Q["corr_pearson"] = CORR_ROWS + "SELECT column_x, column_y, round(corr(x, y), 6) AS correlation FROM pr GROUP BY 1, 2"
_RANK = "rank() OVER (PARTITION BY column_x, column_y ORDER BY {v}) + (count(*) OVER (PARTITION BY column_x, column_y, {v}) - 1) / 2.0::DOUBLE"
Q["corr_spearman"] = (
    CORR_ROWS
    + f"""SELECT column_x, column_y, round(corr(rx, ry), 6) AS correlation FROM
    (SELECT column_x, column_y, {_RANK.format(v='x')} AS rx, {_RANK.format(v='y')} AS ry FROM pr) GROUP BY 1, 2"""
)
_SPARSE = {
    "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax",
    "part": "l_partkey", "supplier": "l_suppkey", "line": "l_linenumber", "part_digit": "l_partkey % 10",
    "supplier_week": "l_suppkey % 7", "order_kind": "l_orderkey % 13", "quantity_left": "50 - l_quantity + l_linenumber",
    "part_and_line": "l_partkey + 100 * l_linenumber",
}
_LACKS = "(l_orderkey * 31 + l_linenumber * 7 + l_partkey + {k} * {k}) % 11 < {n}"
Q["corr_spearman_sparse"] = f"""WITH li AS (SELECT row_number() OVER () AS i, * FROM lineitem), long AS ({" UNION ALL ".join(
    f"SELECT i, '{n}' AS name, CAST({e} AS DOUBLE) AS v FROM li WHERE NOT ({_LACKS.format(k=k, n=k % 4)})" for k, (n, e) in enumerate(_SPARSE.items())
)}), pr AS (SELECT a.name AS column_x, b.name AS column_y, a.v AS x, b.v AS y FROM long a JOIN long b ON a.i = b.i AND a.name <= b.name),
    half AS (SELECT column_x, column_y, round(corr(rx, ry), 6) AS correlation FROM
    (SELECT column_x, column_y, {_RANK.format(v='x')} AS rx, {_RANK.format(v='y')} AS ry FROM pr) GROUP BY 1, 2)
    SELECT * FROM half UNION ALL SELECT column_y, column_x, correlation FROM half WHERE column_x <> column_y"""
Q["corr_kendall"] = (
    CORR_ROWS.rstrip()
    + """, nr AS (SELECT *, row_number() OVER (PARTITION BY column_x, column_y) AS i FROM pr)
    SELECT a.column_x, a.column_y, round(sum(sign(a.x - b.x) * sign(a.y - b.y))
    / (sqrt(count(*) FILTER (a.x <> b.x)::DOUBLE) * sqrt(count(*) FILTER (a.y <> b.y)::DOUBLE)), 6) AS correlation
    FROM nr a JOIN nr b ON a.column_x = b.column_x AND a.column_y = b.column_y AND a.i < b.i GROUP BY 1, 2"""
)
Q["correlation_input_history"] = (
    with_(EV, grid(), SHARES, JAN_WEATHER)
    + f"""SELECT g.ts AS unix_timestamp_ms, g.region, g.resolution, {dec('total')} AS power_consumption_total, {dec('price')} AS market_price_ger_lux,
    wind_speed_100_avg, repi_30mix, {RE} FROM g JOIN sh ON g.ts = sh.ts JOIN wa ON wa.date_ms = g.ts"""
)
Q["correlation_input_forecast"] = (
    with_(EV, grid(), SHARES, forecasts(f"({IN_JANUARY}) // 1000"), forecast_agg())
    + f"""SELECT g.ts AS unix_timestamp_ms, g.region, g.resolution, {dec('total')} AS power_consumption_total, {RE}, timestamp_s, model,
    wind_100m_log, repi_power1avg2, repi_power_exp_previous_day3 FROM g JOIN sh ON g.ts = sh.ts JOIN fo ON fo.timestamp_s * 1000 = g.ts"""
)
Q["numeric_matrix"] = (
    with_(EV, grid(), SHARES)
    + f"""SELECT g.ts AS unix_timestamp_ms, {dec('total')} AS power_consumption_total, {dec('price')} AS market_price_ger_lux, {RE}
    FROM g JOIN sh ON g.ts = sh.ts"""
)

# --- landed documents ---
IDS = "CASE event_type WHEN 'view' THEN 4068 WHEN 'click' THEN 4067 WHEN 'signup' THEN 1226 WHEN 'purchase' THEN 4066 WHEN 'error' THEN 1223 END"
HOURLY = f"hp AS (SELECT {IDS} AS series_id, ms // {HOUR} * {HOUR} AS ts, sum(cents)::BIGINT AS cents FROM ev GROUP BY 1, 2)"
Q["market_documents"] = (
    with_(EV, HOURLY)
    + f"""SELECT series_id, 'DE' AS region, 'hour' AS resolution, ts AS unix_timestamp_ms,
    CASE WHEN cents % 7 <> 0 THEN {dec('cents')} END AS value, FALSE AS is_bucket_timestamp FROM hp"""
)
Q["market_index"] = (
    with_(EV, HOURLY)
    + f"""SELECT DISTINCT series_id, 'DE' AS region, 'hour' AS resolution, ts // {WEEK} * {WEEK} AS unix_timestamp_ms,
    -1e8::DOUBLE AS value, TRUE AS is_bucket_timestamp FROM hp"""
)
Q["weather_documents"] = (
    with_(points(IN_JANUARY))
    + f"""SELECT date_ms, lat, CAST(s_nationkey AS INTEGER) AS elevation, {dec('temp')} AS temperature_2m, {dec('w10')} AS wind_speed_10m,
    {dec('w100')} AS wind_speed_100m, dir AS wind_direction_10m, dir AS wind_direction_100m, {dec('direct')} AS direct_radiation,
    {dec('diffuse')} AS diffuse_radiation FROM wp"""
)

Q["forecast_documents"] = (
    with_(forecasts())
    + f"""SELECT timestamp_s, model, CAST(s_nationkey AS INTEGER) AS elevation, temporal_resolution, {dec('wind_speed_80m')} AS wind_speed_80m,
    {dec('wind_speed_180m_previous_day3')} AS wind_speed_180m_previous_day3,
    {dec('direct_radiation_previous_day1')} AS direct_radiation_previous_day1, CAST(NULL AS DOUBLE) AS wind_direction_80m FROM fp"""
)

Q["ingested_price_changes"] = Q["price_change"]
Q["publish_keeps_last"] = (
    with_(DAYS) + f"SELECT {KEYS}, {dec('price')} AS price FROM days"
)

ORACLE = Q
