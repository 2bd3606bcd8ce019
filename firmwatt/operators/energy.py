"""Hourly plant energy, the calendar, firm energy and the surplus above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmwatt.functions.numeric import capped


def hourly_energy_solar(inverter_hours: DataFrame) -> DataFrame:
    """Plant kWh per hour from inverter output ``p_ac`` in W."""
    total = F.bround(F.sum("p_ac") / 1000, 2).alias("kwh")
    return inverter_hours.groupBy("plant_id", "ts").agg(total)


def cap_interconnection(hourly: DataFrame, plants: DataFrame) -> DataFrame:
    """Hourly energy limited to what the grid connection (``ppi``, W) takes."""
    limits = plants.select("plant_id", (F.col("ppi") / 1000).alias("_limit"))
    return (
        hourly.join(limits, "plant_id")
        .withColumn("kwh", capped(F.col("kwh"), F.col("_limit")))
        .drop("_limit")
    )


def hourly_energy_wind(turbine_hours: DataFrame, plants: DataFrame) -> DataFrame:
    """Plant kWh per hour from turbine output ``power`` in kW, limited."""
    total = turbine_hours.groupBy("plant_id", "ts").agg(F.sum("power").alias("kwh"))
    return cap_interconnection(total, plants)


def month_of(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def monthly_energy(hourly: DataFrame) -> DataFrame:
    """Calendar-month sums; months without rows inside the span are 0.

    The sums are partially aggregated before the shuffle, so a plant with most
    of the rows costs no more than any other. Gaps are then filled on the small
    monthly table: each month is expanded up to the one before the next.
    """
    sums = hourly.groupBy("plant_id", month_of(F.col("ts")).alias("month")).agg(
        F.bround(F.sum("kwh"), 2).alias("monthly")
    )
    following = F.lead("month").over(Window.partitionBy("plant_id").orderBy("month"))
    sums = sums.withColumn("_next", following)
    last = F.coalesce(F.add_months("_next", -1), F.col("month"))
    span = F.sequence(F.col("month"), last, F.expr("interval 1 month"))
    return sums.select("plant_id", "monthly", F.posexplode(span).alias("_step", "month")).select(
        "plant_id",
        "month",
        F.when(F.col("_step") == 0, F.col("monthly")).otherwise(F.lit(0.0)).alias("monthly"),
    )


def daily_equivalent(monthly: DataFrame) -> DataFrame:
    days = F.dayofmonth(F.last_day("month"))
    return monthly.withColumn("daily", F.bround(F.col("monthly") / days, 2))


def lowest_month(daily: DataFrame) -> DataFrame:
    """Month and value of the lowest daily equivalent; the earliest wins ties."""
    return daily.groupBy("plant_id").agg(
        F.min("daily").alias("lowest"),
        F.min_by("month", F.struct("daily", "month")).alias("month"),
    )


def firm_energy_solar(daily: DataFrame, plants: DataFrame) -> DataFrame:
    """Firm energy of solar plants; an unmeasured plant gets 0.8 of its minimum."""
    p = plants.select("plant_id", "cen", "ihf", "measured")
    limit = 12 * F.col("cen") * (1 - F.col("ihf") / 100) * 1000
    value = F.when(F.col("measured"), capped(F.col("lowest"), limit)).otherwise(
        F.col("lowest") * 0.8
    )
    return lowest_month(daily).join(p, "plant_id").select(
        "plant_id", "month", "measured", value.alias("firm")
    )


def firm_energy_wind(daily: DataFrame, plants: DataFrame) -> DataFrame:
    """Firm energy of wind plants; 0.6 of the limited minimum if unmeasured."""
    p = plants.select("plant_id", "cen", "ihf", "measured")
    limited = capped(F.col("lowest"), 24 * F.col("cen") * (1 - F.col("ihf") / 100) * 1000)
    value = F.when(F.col("measured"), limited).otherwise(limited * 0.6)
    return lowest_month(daily).join(p, "plant_id").select(
        "plant_id", "month", "measured", value.alias("firm")
    )


def year_window(firm_month: Column) -> Column:
    """The 12 months December..November that hold the firm month."""
    year = F.year(firm_month) - F.when(F.month(firm_month) == 12, 0).otherwise(1)
    start = F.make_date(year, F.lit(12), F.lit(1))
    return F.sequence(start, F.add_months(start, 11), F.expr("interval 1 month"))


def month_list(firm: DataFrame) -> DataFrame:
    """December of the year before the firm year up to November, value 0."""
    start = F.make_date(F.year("month") - 1, F.lit(12), F.lit(1))
    months = F.sequence(start, F.add_months(start, 11), F.expr("interval 1 month"))
    return firm.select("plant_id", F.explode(months).alias("month")).withColumn(
        "value", F.lit(0.0)
    )


def daily_surplus(daily: DataFrame, firm: DataFrame) -> DataFrame:
    """Daily equivalent above the unrounded firm energy, 12 months per plant."""
    spine = firm.select(
        "plant_id", "measured", "firm", F.explode(year_window(F.col("month"))).alias("month")
    )
    above = F.bround(F.col("daily") - F.col("firm"), 2)
    value = F.when(F.col("measured"), above).otherwise(F.lit(0.0))
    return spine.join(daily.select("plant_id", "month", "daily"), ["plant_id", "month"], "left").select(
        "plant_id", "month", value.alias("surplus")
    )


def _year_month() -> list[Column]:
    return [F.year("month").alias("year"), F.month("month").alias("month")]


def out_hourly(hourly: DataFrame) -> DataFrame:
    return hourly.select(
        "plant_id",
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
        F.dayofmonth("ts").alias("day"),
        F.hour("ts").alias("hour"),
        F.col("kwh").alias("energy_kwh"),
    )


def out_monthly(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        "plant_id", *_year_month(), F.col("monthly").alias("energy_kwh_month")
    )


def out_daily(daily: DataFrame) -> DataFrame:
    return daily.select("plant_id", *_year_month(), F.col("daily").alias("energy_kwh_day"))


def out_firm(firm: DataFrame) -> DataFrame:
    """Firm energy as reported: rounded to whole kWh per day."""
    return firm.select(
        "plant_id", *_year_month(), F.bround("firm", 0).cast("bigint").alias("firm_kwh_day")
    )


def out_surplus(surplus: DataFrame) -> DataFrame:
    """Surplus as reported: text with two decimals, ``N/A`` where missing."""
    text = F.coalesce(F.col("surplus").cast("decimal(18,2)").cast("string"), F.lit("N/A"))
    return surplus.select("plant_id", *_year_month(), text.alias("surplus_kwh_day"))
