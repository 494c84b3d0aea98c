"""Series, region and resolution registry plus argument checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values ----------------------------------------------------------
KEYS = ["unix_timestamp_ms", "region", "resolution"]

REGIONS = [
    "DE", "AT", "LU", "DE-LU", "DE-AT-LU", "50Hertz",
    "Amprion", "TenneT", "TransnetBW", "APG", "Creos",
]

RESOLUTIONS = ["quarterhour", "hour", "day", "week", "month", "year"]

# Step of every resolution that has one fixed length, in milliseconds.
STEP_MS = {
    "quarterhour": 900_000,
    "hour": 3_600_000,
    "day": 86_400_000,
    "week": 604_800_000,
}

SENTINEL = -1e8

THRESHOLDS = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55]

# (id, source label, column)
DERIVED_SERIES = [
    (7, "Summe von Photovoltaik-, Onshore- und Offshore-Wind (Computed)", "sum_of_photovoltaic_wind_onshore_offshore_computed"),
    (6, "Anteil Photovoltaik-, Onshore- und Offshore-Wind (Computed)", "share_of_photovoltaic_wind_onshore_offshore_computed"),
    (1, "Anteil erneuerbarer Energien (Computed)", "share_of_renewable_energies_computed"),
    (2, "Importierter Strom (Computed) -don't use", "import_to_validate"),
    (4, "DE-LUX Anstieg Strom Absolut (Computed)", "gerlux_price_change_abs_computed"),
    (5, "DE-LUX Anstieg Strom Relativ (Computed)", "gerlux_price_change_rel_computed"),
    (10, "Wind Geschwindigkeit auf 100m Höhe (Weather)", "wind_speed_100_avg"),
    (11, "Direkte Sonneneinstrahlung (Weather)", "direct_radiation_avg"),
    (12, "Diffuse Sonneneinstrahlung (Weather)", "diffuse_radiation_avg"),
    (13, "REPI min(speed, 11)^3 & radiation*2", "repi_power1avg2"),
    (17, "REPI smooth wind limit", "repi_power_exp"),
    (14, "REPI 30mix", "repi_30mix"),
    (15, "REPI power1avg", "repi_power1avg"),
    (16, "REPI sqare1avg", "repi_square1avg"),
]

RAW_SERIES = [
    (1223, "Stromerzeugung: Braunkohle", "electricity_production_lignite"),
    (1224, "Stromerzeugung: Kernenergie", "electricity_production_nuclear_energy"),
    (1225, "Stromerzeugung: Wind Offshore", "electricity_production_wind_offshore"),
    (1226, "Stromerzeugung: Wasserkraft", "electricity_production_hydropower"),
    (1227, "Stromerzeugung: Sonstige Konventionelle", "electricity_production_other_conventional"),
    (1228, "Stromerzeugung: Sonstige Erneuerbare", "electricity_production_other_renewables"),
    (4066, "Stromerzeugung: Biomasse", "electricity_production_biomass"),
    (4067, "Stromerzeugung: Wind Onshore", "electricity_production_wind_onshore"),
    (4068, "Stromerzeugung: Photovoltaik", "electricity_production_photovoltaics"),
    (4069, "Stromerzeugung: Steinkohle", "electricity_production_hard_coal"),
    (4070, "Stromerzeugung: Pumpspeicher", "electricity_production_pumped_storage"),
    (4071, "Stromerzeugung: Erdgas", "electricity_production_natural_gas"),
    (410, "Stromverbrauch: Gesamt (Netzlast)", "power_consumption_total"),
    (4359, "Stromverbrauch: Residuallast", "power_consumption_residual_load"),
    (4387, "Stromverbrauch: Pumpspeicher", "electricity_consumption_pumped_storage"),
    (4169, "Marktpreis: Deutschland/Luxemburg", "market_price_ger_lux"),
    (5078, "Marktpreis: Anrainer DE/LU", "market_price_adjacent_to_de_lu"),
    (4996, "Marktpreis: Belgien", "market_price_belgium"),
    (4997, "Marktpreis: Norwegen 2", "market_price_norway_2"),
    (4170, "Marktpreis: Österreich", "market_price_austria"),
    (252, "Marktpreis: Dänemark 1", "market_price_denmark_1"),
    (253, "Marktpreis: Dänemark 2", "market_price_denmark_2"),
    (254, "Marktpreis: Frankreich", "market_price_france"),
    (255, "Marktpreis: Italien (Nord)", "market_price_italy_north"),
    (256, "Marktpreis: Niederlande", "market_price_netherlands"),
    (257, "Marktpreis: Polen DON'T USE", "market_price_poland_no_use"),
    (258, "Marktpreis: Polen DON'T USE 2", "market_price_poland_no_use_2"),
    (259, "Marktpreis: Schweiz", "market_price_swiss"),
    (260, "Marktpreis: Slowenien", "market_price_slovenia"),
    (261, "Marktpreis: Tschechien", "market_price_czech_republic"),
    (262, "Marktpreis: Ungarn", "market_price_hungary"),
    (3791, "Prognostizierte Erzeugung: Offshore", "production_forecast_offshore"),
    (123, "Prognostizierte Erzeugung: Onshore", "production_forecast_onshore"),
    (125, "Prognostizierte Erzeugung: Photovoltaik", "production_forecast_photovoltaics"),
    (715, "Prognostizierte Erzeugung: Sonstige", "production_forecast_other"),
    (5097, "Prognostizierte Erzeugung: Wind und Photovoltaik", "production_forecast_wind_and_pv"),
    (122, "Prognostizierte Erzeugung: Gesamt", "production_forecast_total"),
]

DEFAULT_SERIES_IDS = [4359, 410]

# First matching label fragment decides the unit class of a series.
LABEL_CLASSES = [
    ("Marktpreis", "price_EUR_MWh"),
    ("Computed", "computed"),
    ("Weather", "weather_data"),
    ("REPI", "repi_tests"),
]
DEFAULT_LABEL_CLASS = "elec_MWh"
# --- end of fixed values ---------------------------------------------------

MEASURES = [column for _, _, column in RAW_SERIES]
PRODUCTION = [c for c in MEASURES if c.startswith("electricity_production_")]
COLUMN_BY_ID = {i: column for i, _, column in DERIVED_SERIES + RAW_SERIES}
DERIVED_COLUMNS = {column for _, _, column in DERIVED_SERIES}
MEASURE_TYPE = T.DecimalType(11, 2)

MARKET_SCHEMA = T.StructType(
    [
        T.StructField("unix_timestamp_ms", T.LongType()),
        T.StructField("is_bucket_timestamp", T.BooleanType()),
        T.StructField("region", T.StringType()),
        T.StructField("resolution", T.StringType()),
    ]
    + [T.StructField(c, MEASURE_TYPE) for c in MEASURES]
)


def check_region(region: str) -> str:
    if region not in REGIONS:
        raise ValueError(f"unknown region: {region!r}")
    return region


def check_resolution(resolution: str) -> str:
    if resolution not in RESOLUTIONS:
        raise ValueError(f"unknown resolution: {resolution!r}")
    return resolution


def check_range(start_ms: int, end_ms: int) -> None:
    if start_ms < 0 or end_ms <= 0 or start_ms > end_ms:
        raise ValueError(f"bad time range: {start_ms}..{end_ms}")


def step_ms(resolution: str) -> int:
    """Length of one step; month and year have no fixed length."""
    if resolution not in STEP_MS:
        raise ValueError(f"resolution without a fixed step: {resolution!r}")
    return STEP_MS[resolution]


def series_columns(ids: list[int] | None = None) -> tuple[list[str], list[str]]:
    """Registry ids to column names, split into (raw, derived)."""
    wanted = list(ids) if ids else DEFAULT_SERIES_IDS
    unknown = [i for i in wanted if i not in COLUMN_BY_ID]
    if unknown:
        raise ValueError(f"unknown series ids: {unknown}")
    columns = [COLUMN_BY_ID[i] for i in wanted]
    return (
        [c for c in columns if c not in DERIVED_COLUMNS],
        [c for c in columns if c in DERIVED_COLUMNS],
    )


def registry_frame(spark: SparkSession) -> DataFrame:
    """The registry as a 51-row dimension table."""
    rows = [(i, label, column, True) for i, label, column in DERIVED_SERIES]
    rows += [(i, label, column, False) for i, label, column in RAW_SERIES]
    return spark.createDataFrame(
        rows, "series_id int, label string, column_name string, is_derived boolean"
    )
