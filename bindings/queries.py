"""One query per operator over the driver's tables.

``events`` serve as readings (key = event type or user, half-hour slots), as weather
readings (hourly, with a temperature made from the date) and as text points;
``customer`` gives the ids of synthetic series and ``documents`` the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterloom import operators as op
from meterloom import plans, schemas, sinks, sources, streaming
from meterloom.functions.blocks import epoch_us
from meterloom.operators import thermal
from meterloom.session import configure, shared_dir, stage, write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Constant coefficients where a query needs models that SQL can repeat exactly.
BETA = (1.0, 0.1, 0.2, 0.3, 0.5, 0.25, -0.125)
SYNTH_START, SYNTH_DAYS, PEAKY = "2013-01-01", 3, 1.5
NOISE_SEED = 7
WRAP_DAYS = 40  # longer than the temperature seed
CURVE = {"x1": 12, "x2": 18, "y0": 0.05372193}
MA_COEFFICIENTS = {1: 0.4, 3: -0.2}
AR_COEFFICIENTS = {1: 0.3, 2: 0.1}
SEASONAL = op.Order(1, 0, 1, 0, 1, 1, 24)
DAILY = op.Order(1, 0, 0, 0, 1, 0, 24)
GRID = op.order_grid()
GRID_SINCE = max(max([0, *o.ar, *o.ma]) for o in GRID)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def out(df: DataFrame, *plain: str, **rounded: int) -> DataFrame:
    """Plain columns as they are and doubles rounded (never -0.0); times without zone."""
    times = {f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"}
    return df.select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if c in times else F.col(c) for c in plain],
        *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c, digits in rounded.items()],
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """Raw events as (key, ts, value), several per slot."""
    return table(spark, sf_dir, "events").select(
        F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )


def readings(
    spark: SparkSession, sf_dir: str, key: str = "event_type", period: str = "30 minutes"
) -> DataFrame:
    return sources.gap_fill(points(spark, sf_dir, key), period)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir, period="1 hour")


def index(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    return op.raw_index(readings(spark, sf_dir, key))


def profile(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    return op.periodic_index(index(spark, sf_dir, key))


def with_cells(filled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings and their own profile."""
    return filled, op.periodic_index(op.raw_index(filled))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key with itself and with its neighbour in the ring."""
    own = points(spark, sf_dir).select("key", F.col("key").alias("profile_key")).distinct()
    return own.unionByName(ring(spark, sf_dir))


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key with the next one in alphabetical order, the last with the first.

    The keys are event types, one row each, so their order is one small window.
    """
    keys = points(spark, sf_dir).select("key").distinct()
    ordered = Window.partitionBy(F.lit(0)).orderBy("key")
    following = F.coalesce(F.lead("key").over(ordered), F.first("key").over(ordered))
    return keys.select("key", following.alias("profile_key"))


def adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.adjusted_series(*with_cells(readings(spark, sf_dir)), pairs(spark, sf_dir))


def staged_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted series as a written table: the forecast passes over them several times."""
    return stage(adjusted(spark, sf_dir), "adjusted")


def temperature(ts: str = "ts") -> Column:
    return ((F.dayofmonth(ts) * 7 + F.hour(ts) * 5) % 31 - 3).cast("double")


def weather(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    return readings(spark, sf_dir, key, "1 hour").select(
        F.col("key").alias("meter_id"),
        F.to_date("ts").alias("date"),
        F.hour("ts").alias("hour"),
        F.col("value").alias("reading"),
        temperature().alias("temperature"),
    )


def constant_models(weather_readings: DataFrame) -> DataFrame:
    beta = F.array(*[F.lit(b) for b in BETA])
    return weather_readings.select("meter_id", "hour").distinct().withColumn("beta", beta)


def user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity arrays per user, from constant coefficients."""
    by_user = weather(spark, sf_dir, "user_id").withColumn(
        "meter_id", F.col("meter_id").cast("int")
    )
    residual = op.activity_residual(by_user, constant_models(by_user))
    return op.activity_profile(residual, as_arrays=True)


def seed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a written table: assigning profiles reads them several times."""
    return stage(user_activity(spark, sf_dir), "activity")


def temperature_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly temperatures of the events' time span, numbered from 0."""
    bounds = points(spark, sf_dir).agg(
        F.date_trunc("hour", F.min("ts")).alias("lo"), F.date_trunc("hour", F.max("ts")).alias("hi")
    )
    first = F.col("lo")
    grid = sources.time_grid(bounds.withColumn("start", first), "1 hour")
    hours = ((epoch_us("ts") - epoch_us("start")) / 3_600_000_000).cast("int")
    return grid.select(hours.alias("i"), temperature().alias("temp"))


def customer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Sources ------------------------------------------------------------------------------


def dayslot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.hour("ts") * 60 + F.minute("ts")
    return points(spark, sf_dir).select(
        F.col("key").alias("meter"),
        F.dayofyear("ts").alias("day"),
        (F.floor(minutes / 30) + 1).alias("slot"),
        F.format_string("%.2f", "value").alias("value"),
    )


def mixed_dayslot(spark: SparkSession, sf_dir: str) -> str:
    """Folder of day-slot files: every third event's code is spoilt, which ones the id says."""
    minutes = F.hour("ts") * 60 + F.minute("ts")
    code = F.format_string("%03d%02d", F.dayofyear("ts"), F.floor(minutes / 30) + 1)
    path = fresh(spark, "dayslot-mixed")
    table(spark, sf_dir, "events").select(
        F.col("event_type").alias("meter"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), code)).otherwise(code).alias("code"),
        F.format_string("%.2f", "value").alias("value"),
    ).write.csv(path)
    return path


def both_parts(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Day-slot readings, and below them the rejects with their code."""
    kept = good.select("key", "ts", F.lit(None).cast("string").alias("code"), "value")
    spoilt = bad.select(
        F.col("meter").alias("key"),
        F.lit(None).cast("timestamp").alias("ts"),
        "code",
        F.col("value").cast("double").alias("value"),
    )
    return out(kept.unionByName(spoilt), "key", "ts", "code", value=2)


@query
def read_dayslot(spark, sf_dir):
    text = dayslot_text(spark, sf_dir)
    path = fresh(spark, "dayslot")
    code = F.format_string("%03d%02d", F.col("day"), F.col("slot"))
    text.select("meter", code.alias("code"), "value").write.csv(path)
    return out(sources.read_dayslot(spark, path), "key", "ts", value=2)


@query
def read_dayslot_split(spark, sf_dir):
    path = fresh(spark, "dayslot-split")
    dayslot_text(spark, sf_dir).write.csv(path, header=True)
    got = sources.read_dayslot(
        spark, path, split=True, header=True, day_base=0, slot_label="pair"
    )
    return out(got, "key", "ts", value=2)


@query
def read_dayslot_rejects(spark, sf_dir):
    """Documents hold no day-slot codes: their names and sizes all come back as rejects."""
    raw = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("meter"),
        F.col("source").alias("code"),
        F.col("n_chars").cast("string").alias("value"),
    )
    return sources.parse_dayslot(raw)[1]


@query
def read_dayslot_mixed(spark, sf_dir):
    """Readings and rejects of files in which every third event's code is spoilt."""
    good, bad = sources.read_dayslot(spark, mixed_dayslot(spark, sf_dir), rejects=True)
    return both_parts(good, bad)


@query
def read_weather(spark, sf_dir):
    path = fresh(spark, "weather")
    by_user = weather(spark, sf_dir, "user_id")
    by_user.withColumn("reading", F.round("reading", 2)).write.csv(path)
    return out(
        sources.read_weather(spark, path), "meter_id", "date", "hour", reading=2, temperature=2
    )


@query
def read_activity(spark, sf_dir):
    path = fresh(spark, "activity")
    sinks.write_activity(user_activity(spark, sf_dir), path)
    cells = sources.read_activity(spark, path).select(
        "meter_id", F.posexplode(F.arrays_zip("mean", "std")).alias("hour", "c")
    )
    return out(cells.select("meter_id", "hour", "c.mean", "c.std"), "meter_id", "hour", mean=4, std=4)


@query
def read_weather_mixed(spark, sf_dir):
    """Weather readings and rejects of files in which the days of every seventh hour are spoilt."""
    path = fresh(spark, "weather-mixed")
    spoilt = (F.dayofmonth("date") + F.col("hour")) % 7 == 0
    day = F.col("date").cast("string")
    rows = weather(spark, sf_dir, "user_id").withColumn("reading", F.round("reading", 2))
    rows.withColumn("date", F.when(spoilt, F.concat(F.lit("x"), day)).otherwise(day)).write.csv(path)
    good, bad = sources.read_weather(spark, path, rejects=True)
    both = [
        part.select(
            F.col("meter_id").cast("int").alias("meter_id"),
            F.col("date").cast("string").alias("date"),
            F.col("hour").cast("int").alias("hour"),
            F.col("reading").cast("double").alias("reading"),
            F.col("temperature").cast("double").alias("temperature"),
            F.lit(rejected).alias("rejected"),
        )
        for part, rejected in ((good, False), (bad, True))
    ]
    return out(both[0].unionByName(both[1]), "meter_id", "date", "hour", "rejected", reading=2, temperature=2)


@query
def read_activity_mixed(spark, sf_dir):
    """Profiles, and below them the meters of the lines whose first separator is spoilt."""
    whole, path = fresh(spark, "activity"), fresh(spark, "activity-mixed")
    sinks.write_activity(user_activity(spark, sf_dir), whole)
    spoilt = F.split_part("value", F.lit("|"), F.lit(1)).cast("int") % 3 == 0
    lines = spark.read.text(whole)
    lines.select(
        F.when(spoilt, F.regexp_replace("value", r"^(\d+)\|", "$1!")).otherwise(F.col("value")).alias("value")
    ).write.text(path)
    good, bad = sources.read_activity(spark, path, rejects=True)
    cells = good.select("meter_id", F.posexplode(F.arrays_zip("mean", "std")).alias("hour", "c"))
    meters = bad.select(F.split_part("value", F.lit("!"), F.lit(1)).cast("int").alias("meter_id"))
    both = cells.select("meter_id", "hour", "c.mean", "c.std").unionByName(meters, allowMissingColumns=True)
    return out(both, "meter_id", "hour", mean=4, std=4)


@query
def read_temperature_seed(spark, sf_dir):
    line = temperature_seed(spark, sf_dir).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("i", "temp"))),
                lambda s: s["temp"].cast("string"),
            ),
            "|",
        ).alias("value")
    )
    path = fresh(spark, "seed")
    second = line.select(F.lit("99|98|97").alias("value"))
    line.unionByName(second).coalesce(1).write.text(path)  # two lines
    return sources.read_temperature_seed(spark, path)


@query
def time_grid(spark, sf_dir):
    spans = points(spark, sf_dir, "user_id").groupBy("key").agg(
        F.date_trunc("hour", F.min("ts")).alias("lo"), F.max("ts").alias("hi")
    )
    return out(sources.time_grid(spans, "6 hours"), "key", "ts")


@query
def gap_fill(spark, sf_dir):
    return out(readings(spark, sf_dir), "key", "ts", value=4)


@query
def gap_fill_series(spark, sf_dir):
    filled = sources.gap_fill(points(spark, sf_dir, "user_id"), "1 hour", scope="series")
    return out(filled, "key", "ts", value=4)


# Rows ---------------------------------------------------------------------------------


@query
def assign_key(spark, sf_dir):
    keyed = op.assign_key(points(spark, sf_dir), "all", F.col("value") * 2)
    return out(keyed, "key", "ts", value=4)


@query
def calendar_expand(spark, sf_dir):
    expanded = op.calendar_expand(points(spark, sf_dir))
    return out(
        expanded, "key", "ts", "year", "month", "day", "dow", "hour", "minute", value=4
    )


@query
def filter_day(spark, sf_dir):
    return out(op.filter_day(readings(spark, sf_dir), 1), "key", "ts", value=4)


@query
def filter_key(spark, sf_dir):
    return out(op.filter_key(readings(spark, sf_dir), "view"), "key", "ts", value=4)


@query
def select_days(spark, sf_dir):
    chosen = op.select_days(readings(spark, sf_dir), 2, 7, weeks=4, origin="2024-01-01")
    return out(chosen, "key", "ts", "week", value=4)


@query
def select_days_last(spark, sf_dir):
    chosen = op.select_days(
        readings(spark, sf_dir), 2, 7, weeks=3, last_only=True, origin="2024-01-01"
    )
    return out(chosen, "key", "ts", "week", value=4)


@query
def union_series(spark, sf_dir):
    events = points(spark, sf_dir)
    return out(
        op.union_series(*[op.filter_day(events, day) for day in range(1, 8)]),
        "key",
        "ts",
        value=4,
    )


@query
def dedupe(spark, sf_dir):
    by_hour = points(spark, sf_dir, "user_id").withColumn("ts", F.date_trunc("hour", "ts"))
    return out(op.dedupe(by_hour), "key", "ts", value=4)


# Smoothing and profiles ---------------------------------------------------------------


@query
def moving_average(spark, sf_dir):
    return out(op.moving_average(readings(spark, sf_dir)), "key", "ts", ma=6)


@query
def moving_average_users(spark, sf_dir):
    return out(op.moving_average(readings(spark, sf_dir, "user_id")), "key", "ts", ma=6)


@query
def raw_index(spark, sf_dir):
    return out(index(spark, sf_dir), "key", "ts", ri=6)


@query
def raw_index_aligned(spark, sf_dir):
    aligned = op.raw_index(readings(spark, sf_dir), align_minutes=120)
    return out(aligned, "key", "ts", ri=6)


@query
def centered_ma(spark, sf_dir):
    return out(op.centered_ma(hourly(spark, sf_dir)), "key", "ts", cma=6)


@query
def raw_index_centered(spark, sf_dir):
    centered = op.raw_index(hourly(spark, sf_dir), method="centered")
    return out(centered, "key", "ts", ri=5)


@query
def periodic_index(spark, sf_dir):
    return out(profile(spark, sf_dir), "key", "dow", "hour", pi=6)


@query
def periodic_index_users(spark, sf_dir):
    return out(profile(spark, sf_dir, "user_id"), "key", "dow", "hour", pi=6)


@query
def last_cycle_index(spark, sf_dir):
    cycle = op.periodic_index(
        op.raw_index(hourly(spark, sf_dir), method="centered"), mode="last_cycle"
    )
    return out(cycle, "key", "dow", "hour", pi=5)


@query
def normalize_index(spark, sf_dir):
    return out(op.normalize_index(profile(spark, sf_dir)), "key", "dow", "hour", pi=6)


@query
def normalize_index_as_written(spark, sf_dir):
    scaled = op.normalize_index(profile(spark, sf_dir), as_written=True)
    return out(scaled, "key", "dow", "hour", pi=6)


@query
def pack_profile(spark, sf_dir):
    packed = op.pack_profile(profile(spark, sf_dir))
    cells = packed.select("profile_key", "dow", F.posexplode("pis").alias("hour", "pi"))
    return out(cells.where("pi IS NOT NULL"), "profile_key", "dow", "hour", pi=6)


@query
def peaks(spark, sf_dir):
    tops = op.peaks(*with_cells(readings(spark, sf_dir)))
    return out(tops, "key", "profile_key", "ts", "dow", peak=4)


@query
def peaks_paired(spark, sf_dir):
    tops = op.peaks(*with_cells(readings(spark, sf_dir)), pairs(spark, sf_dir))
    return out(tops, "key", "profile_key", "ts", "dow", peak=4)


@query
def peaks_users(spark, sf_dir):
    tops = op.peaks(*with_cells(stage(readings(spark, sf_dir, "user_id"), "readings")))
    return out(tops, "key", "profile_key", "ts", "dow", peak=4)


@query
def adjusted_series(spark, sf_dir):
    own = op.adjusted_series(*with_cells(readings(spark, sf_dir)))
    return out(own, "key", "profile_key", "ts", "dow", adjusted=4)


@query
def adjusted_series_paired(spark, sf_dir):
    return out(adjusted(spark, sf_dir), "key", "profile_key", "ts", "dow", adjusted=4)


@query
def adjusted_series_normalized(spark, sf_dir):
    """Hourly sums over the normalised profile of the centred index."""
    filled = hourly(spark, sf_dir)
    raw = op.raw_index(filled, method="centered")
    scaled = op.normalize_index(op.periodic_index(raw))
    own = op.adjusted_series(filled, scaled)
    return out(own, "key", "profile_key", "ts", "dow", adjusted=3)


# Series algebra -----------------------------------------------------------------------


@query
def hourly_sum(spark, sf_dir):
    return out(op.hourly_sum(readings(spark, sf_dir)), "key", "date", "dow", "hour", value=4)


@query
def hourly_sum_end(spark, sf_dir):
    summed = op.hourly_sum(readings(spark, sf_dir), slot_label="end")
    return out(summed, "key", "date", "dow", "hour", value=4)


@query
def difference(spark, sf_dir):
    return out(op.difference(readings(spark, sf_dir)), "key", "ts", "i", diff=4)


@query
def difference_seasonal(spark, sf_dir):
    differenced = op.difference(hourly(spark, sf_dir), lag=24, times=2)
    return out(differenced, "key", "ts", "i", diff=4)


@query
def integrate(spark, sf_dir):
    """From a table that holds the first cycle's values and differences only."""
    differenced = op.difference(hourly(spark, sf_dir), lag=24)
    first = F.when(F.col("i") < 24, F.col("value"))
    differenced = stage(differenced.withColumn("value", first), "differences")
    return out(op.integrate(differenced, lag=24), "key", "ts", integrated=4)


@query
def integrate_twice(spark, sf_dir):
    """Second differences at a lag, undone from the first values of each chain."""
    differenced = op.difference(hourly(spark, sf_dir), lag=5, times=2)
    first = F.when(F.col("i") < 10, F.col("value"))
    differenced = stage(differenced.withColumn("value", first), "differences")
    return out(op.integrate(differenced, lag=5, times=2), "key", "ts", integrated=4)


def with_gaps(spark, sf_dir):
    """Hourly readings, every seventh without a value."""
    hour = F.hour("ts") + 24 * F.dayofyear("ts")
    return hourly(spark, sf_dir).withColumn("value", F.when(hour % 7 != 3, F.col("value")))


@query
def integrate_nulls(spark, sf_dir):
    differenced = stage(op.difference(with_gaps(spark, sf_dir), lag=24), "differences")
    first = F.when(F.col("i") < 24, F.coalesce("value", F.lit(0.0)))
    return out(op.integrate(differenced.withColumn("value", first), lag=24), "key", "ts", integrated=4)


@query
def forecast_nulls(spark, sf_dir):
    forecast = op.forecast_arima(with_gaps(spark, sf_dir), keys=["key"], value="value")
    return out(forecast, "key", "step", "ts", "status", yhat=3, lo=3, hi=3, rmse=3)


@query
def difference_far(spark, sf_dir):
    """A lag of 12 days in readings of every minute."""
    differences = op.difference(readings(spark, sf_dir, period="1 minute"), lag=17_520)
    return out(differences.where(F.col("diff").isNotNull()), "key", "ts", "i", diff=4)


@query
def center(spark, sf_dir):
    return out(op.center(readings(spark, sf_dir)), "key", "ts", centered=5)


@query
def autocovariance(spark, sf_dir):
    covariances = op.autocovariance(readings(spark, sf_dir), 5)
    long = covariances.select("key", "n", F.posexplode("acov").alias("lag", "acov"))
    return out(long, "key", "n", "lag", acov=3)


@query
def series_stats(spark, sf_dir):
    stats = op.series_stats(readings(spark, sf_dir))
    return out(stats, "key", "n", min=4, mean=5, std=4, variance=3)


@query
def rmse(spark, sf_dir):
    filled = readings(spark, sf_dir)
    errors = op.rmse(filled, op.moving_average(filled), right_value="ma")
    return out(errors, "key", "n", rmse=4)


@query
def lag_features(spark, sf_dir):
    features = op.lag_features(weather(spark, sf_dir))
    return out(
        features,
        "meter_id",
        "hour",
        "date",
        **dict.fromkeys(["reading", "temperature", *thermal.PREDICTORS], 4),
    )


@query
def gram(spark, sf_dir):
    features = op.lag_features(weather(spark, sf_dir))
    products = op.gram(features, ["meter_id", "hour"], ["reading", "lag1", "over"])
    names = [c for c in products.columns if c.startswith("g_")]
    return out(products, "meter_id", "hour", **dict.fromkeys(names, 5))


# Models -------------------------------------------------------------------------------


@query
def fit_thermal_ar(spark, sf_dir):
    models = op.fit_thermal_ar(op.lag_features(weather(spark, sf_dir)))
    betas = models.select("*", *[F.get("beta", F.lit(k)).alias(f"b{k}") for k in range(7)])
    return out(
        betas, "meter_id", "hour", "n", "status", **dict.fromkeys([f"b{k}" for k in range(7)], 3)
    )


@query
def thermal_normal_equations(spark, sf_dir):
    """Products of predictors and residuals, zero at the least-squares solution."""
    features = op.lag_features(weather(spark, sf_dir))
    models = op.fit_thermal_ar(features).select("meter_id", "hour", "beta")
    fitted = F.get("beta", F.lit(0))
    for k, name in enumerate(thermal.PREDICTORS, start=1):
        fitted = fitted + F.get("beta", F.lit(k)) * F.col(name)
    rows = features.join(models, ["meter_id", "hour"]).withColumn("e", F.col("reading") - fitted)
    sums = rows.groupBy("meter_id", "hour").agg(
        *[F.abs(F.sum(F.col(c) * F.col("e"))).alias(c) for c in thermal.PREDICTORS]
    )
    return out(sums, "meter_id", "hour", **dict.fromkeys(thermal.PREDICTORS, 3))


@query
def activity_residual(spark, sf_dir):
    hours = weather(spark, sf_dir)
    residual = op.activity_residual(hours, constant_models(hours))
    return out(residual, "meter_id", "date", "hour", activity=4)


@query
def activity_profile(spark, sf_dir):
    hours = weather(spark, sf_dir)
    models = op.fit_thermal_ar(op.lag_features(hours))
    long = op.activity_profile(op.activity_residual(hours, models))
    return out(long, "meter_id", "hour", mean=3, std=3)


@query
def activity_arrays(spark, sf_dir):
    arrays = user_activity(spark, sf_dir)
    cells = arrays.select(
        "meter_id", F.posexplode(F.arrays_zip("mean", "std")).alias("hour", "c")
    ).select("meter_id", "hour", "c.mean", "c.std")
    return out(cells, "meter_id", "hour", mean=4, std=4)


@query
def train_activity(spark, sf_dir):
    arrays = plans.train_activity(weather(spark, sf_dir))
    cells = arrays.select(
        "meter_id", F.posexplode(F.arrays_zip("mean", "std")).alias("hour", "c")
    ).select("meter_id", "hour", "c.mean", "c.std")
    return out(cells, "meter_id", "hour", mean=3, std=3)


@query
def forecast_arima(spark, sf_dir):
    forecast = op.forecast_arima(staged_adjusted(spark, sf_dir))
    return out(
        forecast, "key", "profile_key", "dow", "step", "ts", "status",
        yhat=3, lo=3, hi=3, rmse=3,
    )


@query
def forecast_future(spark, sf_dir):
    forecast = op.forecast_arima(
        readings(spark, sf_dir), keys=["key"], value="value", align="future", steps=8, psi_shift=1
    )
    return out(forecast, "key", "step", "ts", "status", yhat=3, lo=3, hi=3, rmse=3)


@query
def forecast_log(spark, sf_dir):
    """The fit record of every series as JSON text."""
    forecast = op.forecast_arima(staged_adjusted(spark, sf_dir))
    return forecast.select("key", "profile_key", "dow", "log").distinct()


@query
def forecast_models(spark, sf_dir):
    models = op.forecast_models(staged_adjusted(spark, sf_dir))
    return out(
        models, "key", "profile_key", "dow", "n", "n_test",
        mu=3, theta=4, error=3, rmse=3, variance=2, max_normalized_variance=3,
    )


@query
def backtest(spark, sf_dir):
    scores = op.backtest(staged_adjusted(spark, sf_dir))
    return out(scores, "key", "profile_key", "dow", "n", "n_test", "status", rmse=3)


@query
def backtest_users(spark, sf_dir):
    """One series per user: many short groups at once."""
    filled = stage(readings(spark, sf_dir, "user_id"), "readings")
    scores = op.backtest(filled, keys=["key"], value="value")
    return out(scores, "key", "n", "n_test", "status", rmse=3)


@query
def arma_residuals(spark, sf_dir):
    residuals = op.arma_residuals(
        hourly(spark, sf_dir), AR_COEFFICIENTS, MA_COEFFICIENTS, block="5 days"
    )
    return out(residuals, "key", "ts", "i", residual=4)


@query
def fit_ar(spark, sf_dir):
    fitted = op.fit_ar(readings(spark, sf_dir), 2)
    cells = fitted.select("key", "n", F.posexplode("phi").alias("lag", "phi"))
    return out(cells.withColumn("lag", F.col("lag") + 1), "key", "n", "lag", phi=4)


@query
def forecast_seasonal(spark, sf_dir):
    """A seasonal order with differencing, as sums over blocks."""
    forecast = op.forecast_arima(
        hourly(spark, sf_dir), SEASONAL, ["key"], value="value", align="future", steps=24,
        period="1 hour",
    )
    return out(forecast, "key", "step", "ts", "status", yhat=3, lo=3, hi=3, rmse=3)


@query
def arma_coefficients(spark, sf_dir):
    models = op.fit_orders(hourly(spark, sf_dir), [SEASONAL])
    cells = models.select("key", "held", F.posexplode("coefficients").alias("number", "c"))
    cells = cells.select("key", "held", (F.col("number") + 1).alias("number"), "c.*")
    return out(cells, "key", "held", "number", "lag", coefficient=4)


@query
def backtest_seasonal(spark, sf_dir):
    """An order with differencing for every user at once."""
    scores = op.backtest(readings(spark, sf_dir, "user_id", "1 hour"), DAILY, ["key"], value="value")
    return out(scores, "key", "n", "n_test", "status", rmse=3)


@query
def auto_arima(spark, sf_dir):
    best = op.auto_arima(hourly(spark, sf_dir), GRID)
    return out(
        best, "key", "p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q", "m", "step", "ts",
        "status", yhat=3, lo95=3, hi95=3,
    )


def combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four peak sets per forecast: own, by the neighbour, the neighbour's, and its by own."""
    neighbours = ring(spark, sf_dir).toDF("a", "b")
    a, b = F.col("a"), F.col("b")
    kinds = [(a, a), (a, b), (b, b), (b, a)]
    options = F.array(
        *[
            F.struct(
                F.lit(name).alias("measurement"), p.alias("p_key"), q.alias("p_profile")
            )
            for name, (p, q) in zip(op.MEASUREMENTS, kinds)
        ]
    )
    return neighbours.select(
        a.alias("f_key"), a.alias("f_profile"), F.explode(options).alias("o")
    ).select("f_key", "f_profile", "o.*")


def cross_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own profile, the neighbour's, and of each neighbour the reverse."""
    back = ring(spark, sf_dir).toDF("profile_key", "key").select("key", "profile_key")
    return pairs(spark, sf_dir).unionByName(back)


@query
def add_peaks(spark, sf_dir):
    filled = stage(readings(spark, sf_dir), "readings")
    cells = stage(op.periodic_index(op.raw_index(filled)), "profile")
    forecast = op.forecast_arima(stage(op.adjusted_series(filled, cells), "adjusted"))
    both = op.add_peaks(forecast, op.peaks(filled, cells))
    return out(both, "key", "profile_key", "ts", "dow", value=3)


@query
def add_peaks_combos(spark, sf_dir):
    filled = stage(readings(spark, sf_dir), "readings")
    cells = stage(op.periodic_index(op.raw_index(filled)), "profile")
    forecast = op.forecast_arima(stage(op.adjusted_series(filled, cells), "adjusted"))
    tops = op.peaks(filled, cells, cross_pairs(spark, sf_dir))
    both = op.add_peaks(forecast, tops, combos(spark, sf_dir))
    return out(
        both, "measurement", "f_key", "f_profile", "key", "profile_key", "ts", "dow", value=3
    )


@query
def decompose(spark, sf_dir):
    """The whole job with its stages written to the shared folder."""
    result = plans.decompose(points(spark, sf_dir))
    return out(result.combined, "key", "profile_key", "ts", "dow", value=3)


# Synthetic series ---------------------------------------------------------------------


@query
def synth_assign(spark, sf_dir):
    assigned = op.synth_assign(
        customer_ids(spark, sf_dir), seed_profiles(spark, sf_dir), mode="cyclic"
    )
    return assigned.select("id", "meter_id")


@query
def synth_ids(spark, sf_dir):
    """As many ids as there are customers."""
    return op.synth_ids(spark, table(spark, sf_dir, "customer").count())


def synth_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = op.synth_grid(customer_ids(spark, sf_dir), SYNTH_START, SYNTH_DAYS)
    return op.synth_temperature(grid, temperature_seed(spark, sf_dir), sigma=0)


@query
def synth_grid(spark, sf_dir):
    return op.synth_grid(customer_ids(spark, sf_dir), SYNTH_START, SYNTH_DAYS)


@query
def synth_temperature(spark, sf_dir):
    return out(synth_hours(spark, sf_dir), "id", "date", "hour", temp=4)


@query
def synth_temperature_wrapped(spark, sf_dir):
    """A horizon longer than the seed, which then starts again."""
    ids = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    grid = op.synth_grid(ids, SYNTH_START, WRAP_DAYS)
    hours = op.synth_temperature(grid, temperature_seed(spark, sf_dir), sigma=0)
    return out(hours, "id", "date", "hour", temp=4)


@query
def thermal_load(spark, sf_dir):
    loads = op.thermal_load(synth_hours(spark, sf_dir), **CURVE)
    return out(loads, "id", "date", "hour", thermal=4)


@query
def thermal_load_weather(spark, sf_dir):
    """Load curve over the whole weather series of every user."""
    by_user = weather(spark, sf_dir, "user_id")
    loads = op.thermal_load(by_user, id="meter_id", temp="temperature", **CURVE)
    return out(loads, "meter_id", "date", "hour", thermal=4)


@query
def synth_activity(spark, sf_dir):
    assigned = op.synth_assign(
        customer_ids(spark, sf_dir), seed_profiles(spark, sf_dir), mode="cyclic"
    )
    grid = op.synth_grid(assigned, SYNTH_START, SYNTH_DAYS)
    return out(op.synth_activity(grid, sigma=0), "id", "date", "hour", activity=4)


@query
def peak_amplify(spark, sf_dir):
    daily = readings(spark, sf_dir).withColumn("date", F.to_date("ts"))
    raised = op.peak_amplify(daily, PEAKY, ("key", "date"), "value", "load")
    return out(raised, "key", "ts", load=7)


def deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.synth_readings(
        customer_ids(spark, sf_dir),
        seed_profiles(spark, sf_dir),
        temperature_seed(spark, sf_dir),
        SYNTH_START,
        SYNTH_DAYS,
        PEAKY,
        assign="cyclic",
        temperature_sigma=0,
        activity_sigma=0,
        **CURVE,
    )


@query
def synth_readings(spark, sf_dir):
    return out(deterministic(spark, sf_dir), "id", "date", "hour", load=4, temp=4)


@query
def synth_assign_random(spark, sf_dir):
    assigned = op.synth_assign(customer_ids(spark, sf_dir), seed_profiles(spark, sf_dir), NOISE_SEED)
    return assigned.select("id", "meter_id")


@query
def synth_temperature_noisy(spark, sf_dir):
    """Noise on a horizon longer than the seed, for every customer."""
    grid = op.synth_grid(customer_ids(spark, sf_dir), SYNTH_START, WRAP_DAYS)
    hours = op.synth_temperature(grid, temperature_seed(spark, sf_dir), seed=NOISE_SEED)
    daily = hours.groupBy("id", "date").agg(F.avg("temp").alias("mean"), F.max("temp").alias("highest"))
    return out(daily, "id", "date", mean=6, highest=6)


@query
def synth_readings_random(spark, sf_dir):
    """Seeded noise, drawn profiles, breakpoints and base loads."""
    made = op.synth_readings(
        customer_ids(spark, sf_dir), seed_profiles(spark, sf_dir), temperature_seed(spark, sf_dir),
        SYNTH_START, SYNTH_DAYS, PEAKY, seed=NOISE_SEED,
    )
    return out(made, "id", "date", "hour", load=6, temp=6)


@query
def synth_generate(spark, sf_dir):
    """Seeded noise, trained profiles: the generator as it is meant to be used."""
    by_user = weather(spark, sf_dir, "user_id").withColumn(
        "meter_id", F.col("meter_id").cast("int")
    )
    made = plans.generate(
        customer_ids(spark, sf_dir),
        by_user,
        temperature_seed(spark, sf_dir),
        SYNTH_START,
        SYNTH_DAYS,
        PEAKY,
        seed=NOISE_SEED,
    )
    return out(made, "id", "date", "hour", load=6, temp=6)


# Text and sinks -----------------------------------------------------------------------


@query
def wordcount(spark, sf_dir):
    return op.wordcount(table(spark, sf_dir, "documents"))


@query
def tokens(spark, sf_dir):
    """The pairs of each word with 1, before any grouping."""
    return op.tokens(table(spark, sf_dir, "conversations"))


@query
def to_line_protocol(spark, sf_dir):
    return sinks.to_line_protocol(readings(spark, sf_dir), "energy", value_format="%.2f")


@query
def point_to_csv(spark, sf_dir):
    return sinks.point_to_csv(readings(spark, sf_dir), value_format="%.2f")


@query
def write_points(spark, sf_dir):
    path = fresh(spark, "points")
    sinks.write_points(readings(spark, sf_dir), path, F.concat(F.lit("m_"), F.col("key")))
    got = spark.read.schema(schemas.POINTS).parquet(path)
    return out(got, "measurement", "key", "ts_ms", value=4)


@query
def write_line_batches(spark, sf_dir):
    """Line text of all readings, read back, and whether no file holds too many."""
    path = fresh(spark, "lines")
    sinks.write_line_batches(readings(spark, sf_dir), path, "energy", value_format="%.2f")
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    within = sizes.agg(F.max("n") <= sinks.BATCH_POINTS).first()[0]
    return lines.select("value", F.lit(bool(within)).alias("within"))


@query
def write_synthetic(spark, sf_dir):
    path = fresh(spark, "synthetic")
    exact = deterministic(spark, sf_dir).withColumns(
        {"load": F.round("load", 4), "temp": F.round("temp", 4)}
    )
    sinks.write_synthetic(exact, path)
    return spark.read.text(path)


# Streams ------------------------------------------------------------------------------


STREAM_PARTS = 4


def in_parts(spark: SparkSession, batch: DataFrame, name: str) -> tuple[str, str, str]:
    """Write a table in time order, as files of ``STREAM_PARTS`` equal spans of whole days.

    Returns the folder, how many files make one micro-batch, and a delay of one span and
    a day, as files of one span may be read in any order.
    """
    path = fresh(spark, name)
    first, last = batch.agg(F.min("ts"), F.max("ts")).first()
    span = timedelta(days=1 if first is None else max(1, ceil((last - first) / timedelta(days=STREAM_PARTS))))
    for k in range(STREAM_PARTS):
        part = batch
        if first is not None and k:
            part = part.where(F.col("ts") >= F.lit(first + k * span))
        if first is not None and k < STREAM_PARTS - 1:
            part = part.where(F.col("ts") < F.lit(first + (k + 1) * span))
        part.write.mode("append").parquet(path)
    files = len(spark.read.schema(batch.schema).parquet(path).inputFiles())
    return path, str(max(1, files // STREAM_PARTS)), f"{span.days + 1} days"


def staged_stream(
    spark: SparkSession, sf_dir: str, batch: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Readings as a batch table, and as a stream of several micro-batches."""
    batch = batch or stage(readings(spark, sf_dir), "readings")
    path, files, delay = in_parts(spark, batch, "stream-input")
    stream = streaming.stream_readings(
        spark, path, batch.schema, delay=delay, maxFilesPerTrigger=files
    )
    return batch, stream


def finished(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream over everything there is, and read its output."""
    path = fresh(spark, name)
    streaming.write_stream(stream, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query
def stream_moving_average(spark, sf_dir):
    _, stream = staged_stream(spark, sf_dir)
    done = finished(spark, streaming.stream_moving_average(stream), "stream-ma")
    return out(done, "key", "ts", ma=6)


@query
def stream_raw_index(spark, sf_dir):
    _, stream = staged_stream(spark, sf_dir)
    done = finished(spark, streaming.stream_raw_index(stream), "stream-ri")
    return out(done, "key", "ts", ri=6)


@query
def stream_count_trigger(spark, sf_dir):
    _, stream = staged_stream(spark, sf_dir)
    done = finished(spark, streaming.stream_count_trigger(stream), "stream-count")
    return out(done, "key", "ts", ma=6)


@query
def stream_periodic_index(spark, sf_dir):
    indices = index(spark, sf_dir)
    _, stream = staged_stream(spark, sf_dir, stage(indices, "index"))
    target = fresh(spark, "stream-profile")
    streaming.write_stream_batches(
        streaming.stream_periodic_index(stream), target, f"{target}-checkpoint", "complete"
    ).awaitTermination()
    batches = spark.read.parquet(target)
    newest = batches.agg(F.max("batch")).scalar()
    return out(batches.where(F.col("batch") == newest), "key", "dow", "hour", pi=6)


@query
def stream_peaks(spark, sf_dir):
    batch, stream = staged_stream(spark, sf_dir)
    cells = op.periodic_index(op.raw_index(batch))
    done = finished(spark, streaming.stream_peaks(stream, cells), "stream-peaks")
    return out(done, "key", "ts", "dow", peak=4)


@query
def stream_adjusted(spark, sf_dir):
    batch, stream = staged_stream(spark, sf_dir)
    cells = op.periodic_index(op.raw_index(batch))
    done = finished(spark, streaming.stream_adjusted(stream, cells), "stream-adjusted")
    return out(done, "key", "ts", "dow", adjusted=4)


def stored_forecast(filled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profile and forecast of readings, as written tables."""
    cells = stage(op.periodic_index(op.raw_index(filled)), "profile")
    own = stage(op.adjusted_series(filled, cells), "adjusted")
    return cells, stage(op.forecast_arima(own), "forecast")


@query
def stream_raw_index_aligned(spark, sf_dir):
    _, stream = staged_stream(spark, sf_dir)
    done = finished(spark, streaming.stream_raw_index(stream, align_minutes=120), "stream-ri")
    return out(done, "key", "ts", ri=6)


@query
def stream_peaks_paired(spark, sf_dir):
    batch, stream = staged_stream(spark, sf_dir)
    cells = op.periodic_index(op.raw_index(batch))
    tops = streaming.stream_peaks(stream, cells, pairs(spark, sf_dir))
    return out(finished(spark, tops, "stream-peaks"), "key", "profile_key", "ts", "dow", peak=4)


@query
def stream_adjusted_paired(spark, sf_dir):
    batch, stream = staged_stream(spark, sf_dir)
    cells = op.periodic_index(op.raw_index(batch))
    own = streaming.stream_adjusted(stream, cells, pairs(spark, sf_dir))
    return out(finished(spark, own, "stream-adjusted"), "key", "profile_key", "ts", "dow", adjusted=4)


@query
def stream_add_peaks(spark, sf_dir):
    batch, stream = staged_stream(spark, sf_dir)
    cells, forecast = stored_forecast(batch)
    tops = streaming.stream_peaks(stream, cells)
    done = finished(spark, streaming.stream_add_peaks(tops, forecast), "stream-add")
    return out(done, "key", "profile_key", "ts", "dow", value=3)


@query
def stream_join_forecast(spark, sf_dir):
    """Forecasts and peaks as streams; a third of the peaks never arrives."""
    batch, arriving = staged_stream(spark, sf_dir)
    cells, forecast = stored_forecast(batch)
    _, steps = staged_stream(spark, sf_dir, forecast)
    tops = streaming.stream_peaks(arriving, cells).where(F.hour("ts") % 3 != 1)
    done = finished(spark, streaming.stream_join_forecast(steps, tops), "stream-join")
    return out(done, "key", "profile_key", "ts", "dow", value=3)


@query
def stream_profile_versions(spark, sf_dir):
    """The newest of the profiles that four micro-batches have written."""
    _, stream = staged_stream(spark, sf_dir, stage(index(spark, sf_dir), "index"))
    target = fresh(spark, "profile-versions")
    streaming.write_stream_profile(stream, target, f"{target}-checkpoint").awaitTermination()
    return out(streaming.read_profile(spark, target), "key", "dow", "hour", pi=6)


@query
def stream_decompose(spark, sf_dir):
    """The whole streaming job, its points read back from the folders of all stages."""
    batch, stream = staged_stream(spark, sf_dir)
    cells, forecast = stored_forecast(batch)
    target = fresh(spark, "stream-decompose")
    started = plans.stream_decompose(
        stream, cells, forecast, target, f"{target}-checkpoint",
        cross_pairs(spark, sf_dir), combos(spark, sf_dir), align_minutes=120,
    )
    for running in started:
        running.awaitTermination()
    folders = ("average", "index", "peaks", "adjusted", "combined")
    got = [spark.read.schema(schemas.POINTS).parquet(f"{target}/{name}") for name in folders]
    return out(op.union_series(*got), "measurement", "key", "ts_ms", value=5)


@query
def stream_dayslot(spark, sf_dir):
    """Readings and rejects of one folder, each through a sink of its own."""
    good, bad = streaming.stream_dayslot(
        spark, mixed_dayslot(spark, sf_dir), rejects=True, maxFilesPerTrigger="4"
    )
    return both_parts(
        finished(spark, good, "stream-dayslot"), finished(spark, bad, "stream-rejects")
    )


@query
def stream_lines(spark, sf_dir):
    path = fresh(spark, "stream-text")
    table(spark, sf_dir, "documents").select(
        F.regexp_replace("text", r"[\r\n]+", " ").alias("value")
    ).write.text(path)
    lines = streaming.stream_lines(spark, path, maxFilesPerTrigger="4")
    return op.wordcount(finished(spark, lines, "stream-lines"))


@query
def stream_wordcount(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # A pattern, as the file stream takes the base folder of a plain path, which a single file has not.
    lines = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/[d]ocuments.parquet")
    target = fresh(spark, "stream-words")
    streaming.write_stream_batches(
        streaming.stream_wordcount(lines), target, f"{target}-checkpoint"
    ).awaitTermination()
    return spark.read.parquet(target).groupBy("word").agg(F.max("count").alias("count"))


@query
def stream_points(spark, sf_dir):
    _, stream = staged_stream(spark, sf_dir)
    target = fresh(spark, "stream-points")
    streaming.write_stream_points(
        stream, target, f"{target}-checkpoint", "energy"
    ).awaitTermination()
    got = spark.read.schema(schemas.POINTS).parquet(target)
    return out(got, "measurement", "key", "ts_ms", value=4)
