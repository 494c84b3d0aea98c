"""The driver's tables seen through the domain schemas.

Values are derived in integer arithmetic (hundredths, halves rounded up), so the
same projection written in SQL gives the same digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lullspark.registry import MEASURES

HOUR_MS = 3_600_000
DAY_MS = 86_400_000
JAN_2024_MS = 1_704_067_200_000

PRODUCTION_OF = {
    "view": "electricity_production_photovoltaics",
    "click": "electricity_production_wind_onshore",
    "signup": "electricity_production_hydropower",
    "purchase": "electricity_production_biomass",
    "error": "electricity_production_lignite",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its timestamps carry no zone and are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str) -> Column:
    return F.expr(f"unix_micros(cast({ts} as timestamp)) div 1000")


def half_up(num: str, den: str) -> Column:
    """Integer quotient of non-negative numbers, halves rounded up."""
    return F.expr(f"(2 * ({num}) + ({den})) div (2 * ({den}))")


def hundredths(n: Column | str, kind: str = "decimal(11,2)") -> Column:
    c = F.col(n) if isinstance(n, str) else n
    return (c.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(kind)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        epoch_ms("ts").alias("ms"),
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def market_grid(spark: SparkSession, sf_dir: str, resolution: str = "hour") -> DataFrame:
    """``events`` as a wide market table of one region."""
    step = {"quarterhour": 900_000, "hour": HOUR_MS, "day": DAY_MS}[resolution]
    per_type = {
        column: f"coalesce(sum(cents) FILTER (WHERE event_type = '{kind}'), 0)" for kind, column in PRODUCTION_OF.items()
    }
    sums = {
        "power_consumption_total": "sum(cents)",
        "power_consumption_residual_load": "coalesce(sum(cents) FILTER (WHERE event_type NOT IN ('view', 'click')), 0)",
        "market_price_ger_lux": "(2 * sum(cents) + count(1)) div (2 * count(1))",
    } | per_type
    grouped = (
        event_rows(spark, sf_dir)
        .groupBy(F.expr(f"ms div {step} * {step}L").alias("unix_timestamp_ms"))
        .agg(*[F.expr(f"{v} AS {k}") for k, v in sums.items()])
    )

    def measure(name: str) -> str:
        if name in sums:
            return f"cast(cast({name} AS decimal(18,0)) * 0.01BD AS decimal(11,2)) AS {name}"
        zero = name.startswith("electricity_")
        return f"cast({0 if zero else 'NULL'} AS decimal(11,2)) AS {name}"

    return grouped.selectExpr(
        "unix_timestamp_ms",
        "false AS is_bucket_timestamp",
        "'DE' AS region",
        f"'{resolution}' AS resolution",
        *[measure(c) for c in MEASURES],
    )


def daily_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as one daily market series per region; price in thousands."""
    orders = table(spark, sf_dir, "orders")
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(epoch_ms("o_orderdate").alias("unix_timestamp_ms"), F.col("r_name").alias("region"))
        .agg(
            F.sum(cents).alias("total"),
            F.coalesce(F.sum(F.when(urgent, cents)), F.lit(0)).alias("urgent"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "unix_timestamp_ms",
            "region",
            F.lit("day").alias("resolution"),
            (F.col("urgent").cast("double") / F.col("total").cast("double")).alias("share"),
            hundredths(half_up("total", "n * 1000")).alias("price"),
            hundredths("total", "decimal(18,2)").alias("load"),
        )
    )


def _grid_sums(rows: DataFrame, keys: list[Column]) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return rows.groupBy(*keys).agg(
        F.sum(q).alias("q"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("p"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("t"),
        F.min("l_partkey").alias("part"),
        F.count(F.lit(1)).alias("n"),
    )


def _place() -> list[Column]:
    nation = F.col("s_nationkey")
    return [
        F.get(F.array(F.lit(48.0), F.lit(50.0), F.lit(51.5), F.lit(54.0)), nation % 4).alias("lat"),
        F.get(F.array(F.lit(7.0), F.lit(10.0), F.lit(13.0)), F.expr("s_nationkey div 4 % 3").cast("int")).alias("lng"),
    ]


def _supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return lineitem.join(supplier, lineitem.l_suppkey == supplier.s_suppkey)


# Instant of a line item: its ship date and three hours per line, or an hour of
# January 2024 so that it meets the events.
SHIPPED = "unix_micros(cast(l_shipdate as timestamp)) div 1000 + (l_linenumber - 1) * 10800000L"
IN_JANUARY = f"{JAN_2024_MS}L + l_orderkey % 720 * 3600000L"


def sensor(n: Column) -> Column:
    """Readings fit eight digits, which keeps their sums in machine integers."""
    return hundredths(n, "decimal(8,2)")


def weather_points(spark: SparkSession, sf_dir: str, instant: str = SHIPPED) -> DataFrame:
    """``lineitem`` as weather of one grid point per supplier nation."""
    rows = _supplied(spark, sf_dir)
    return _grid_sums(rows, [F.expr(instant).alias("date_ms"), F.col("s_nationkey")]).select(
        "date_ms",
        "s_nationkey",
        *_place(),
        sensor(half_up("q * 100", "4 * n")).alias("wind_speed_100m"),
        sensor(half_up("q * 100", "6 * n")).alias("wind_speed_10m"),
        F.expr("part * 37 % 361").cast("double").alias("wind_direction_100m"),
        sensor(half_up("p", "200 * n")).alias("direct_radiation"),
        sensor(half_up("d * 1000", "n")).alias("diffuse_radiation"),
        sensor(half_up("t * 100", "n")).alias("temperature_2m"),
    )


def forecast_points(spark: SparkSession, sf_dir: str, seconds: str = f"({SHIPPED}) div 86400000 * 86400") -> DataFrame:
    """``lineitem`` as forecasts: the return flag is the model, leads grow by 1 %."""
    rows = _supplied(spark, sf_dir)
    sums = _grid_sums(rows, [F.expr(seconds).alias("timestamp_s"), F.col("s_nationkey"), F.col("l_returnflag")])
    base = sums.withColumns({"w80": half_up("q * 100", "5 * n") + 100, "tax": half_up("t", "n")}).withColumns(
        {
            "w120": half_up("w80 * (105 + tax)", "100"),
            "w180": half_up("w80 * (110 + tax)", "100"),
            "direct": half_up("p", "200 * n"),
            "diffuse": half_up("d * 1000", "n"),
            "temp": half_up("t * 100", "n"),
        }
    )
    names = {
        "wind_speed_80m": "w80", "wind_speed_120m": "w120", "wind_speed_180m": "w180",
        "direct_radiation": "direct", "diffuse_radiation": "diffuse", "temperature_2m": "temp",
    }
    leads = [
        sensor(half_up(f"{src} * (100 + {k})", "100")).alias(f"{name}_previous_day{k}" if k else name)
        for name, src in names.items()
        for k in range(4)
    ]
    return base.select(
        "timestamp_s",
        "s_nationkey",
        F.col("l_returnflag").alias("model"),
        F.lit("hour").alias("temporal_resolution"),
        *_place(),
        *leads,
    )


def long_feed(spark: SparkSession, sf_dir: str, step_ms: int = HOUR_MS) -> DataFrame:
    """``events`` as a feed: every 50th row opens a bucket, every 7th has no value."""
    rows = event_rows(spark, sf_dir)
    bucket = F.col("event_id") % 50 == 0
    return rows.select(
        F.col("event_type").alias("series"),
        F.expr(f"ms div {step_ms} * {step_ms}L").alias("unix_timestamp_ms"),
        F.lit("DE").alias("region"),
        F.lit("hour").alias("resolution"),
        F.when(bucket, F.lit(-1e8).cast("decimal(11,2)"))
        .when(F.col("event_id") % 7 != 0, hundredths("cents"))
        .alias("value"),
        bucket.alias("is_bucket_timestamp"),
        F.col("event_id").alias("seq"),
    )


# Twelve numeric columns, each of which lacks every fifth or so of its values.
SPARSE_COLUMNS = {
    "quantity": "l_quantity",
    "price": "l_extendedprice",
    "discount": "l_discount",
    "tax": "l_tax",
    "part": "cast(l_partkey AS double)",
    "supplier": "cast(l_suppkey AS double)",
    "line": "cast(l_linenumber AS double)",
    "part_digit": "cast(l_partkey % 10 AS double)",
    "supplier_week": "cast(l_suppkey % 7 AS double)",
    "order_kind": "cast(l_orderkey % 13 AS double)",
    "quantity_left": "50 - l_quantity + l_linenumber",
    "part_and_line": "cast(l_partkey + 100 * l_linenumber AS double)",
}


def sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a wide table with scattered nulls; the pattern differs by row."""
    lacks = "(l_orderkey * 31 + l_linenumber * 7 + l_partkey + {k} * {k}) % 11 < {n}"
    return table(spark, sf_dir, "lineitem").selectExpr(
        *[f"IF({lacks.format(k=k, n=k % 4)}, NULL, {e}) AS {n}" for k, (n, e) in enumerate(SPARSE_COLUMNS.items())]
    )


# Generation columns of ``market_regions``: the k-th sums the events of kind k.
GENERATED = [
    f"electricity_production_{name}"
    for name in (
        "lignite", "nuclear_energy", "wind_offshore", "hydropower", "other_conventional", "other_renewables",
        "biomass", "wind_onshore", "photovoltaics", "hard_coal", "pumped_storage", "natural_gas",
    )
]


def market_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as hours of four regions with every generation column.

    Of 23 hours one each has a sentinel for photovoltaics, no residual load, a load of
    zero, no offshore value, no price and a price of zero; many hours are missing.
    """
    grouped = (
        event_rows(spark, sf_dir)
        .groupBy(F.expr(f"ms div {HOUR_MS} * {HOUR_MS}L").alias("unix_timestamp_ms"), F.expr("event_id % 4").alias("place"))
        .agg(
            *[F.expr(f"coalesce(sum(cents) FILTER (WHERE event_id div 4 % 12 = {k}), 0) AS g{k}") for k in range(12)],
            F.expr("sum(cents) AS total"),
            F.expr("coalesce(sum(cents) FILTER (WHERE event_id div 4 % 12 NOT IN (2, 7, 8)), 0) AS residual"),
            F.expr("coalesce(sum(cents) FILTER (WHERE event_id % 5 = 0) div 10, 0) AS pumped"),
            F.expr("(2 * sum(cents) + count(1)) div (2 * count(1)) AS price"),
        )
        .withColumn("r", F.expr(f"(unix_timestamp_ms div {HOUR_MS} + place) % 23"))
    )
    values = {GENERATED[k]: f"g{k}" for k in range(12)} | {
        GENERATED[8]: "IF(r = 3, -10000000000L, g8)",
        GENERATED[2]: "IF(r = 11, NULL, g2)",
        "power_consumption_residual_load": "IF(r = 5, NULL, residual)",
        "power_consumption_total": "IF(r = 7, 0L, total)",
        "electricity_consumption_pumped_storage": "pumped",
        "market_price_ger_lux": "IF(r = 13, NULL, IF(r = 17, 0L, price))",
    }
    return grouped.selectExpr(
        "unix_timestamp_ms",
        "element_at(array('DE', 'AT', 'LU', 'DE-LU'), cast(place + 1 AS int)) AS region",
        "'hour' AS resolution",
        *[f"cast(cast({values.get(m, 'NULL')} AS decimal(18,0)) * 0.01BD AS decimal(11,2)) AS {m}" for m in MEASURES],
    )
