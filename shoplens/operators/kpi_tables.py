"""Tables behind the KPI figures: delays by month, the top sellers, postcode positions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.dates import floor_days, period_label
from shoplens.functions.frames import require_columns, small_table


def delay_category(days: Column) -> Column:
    """Six delay classes; an unknown delay falls in the last one."""
    return (F.when(days < 3, "No Delay").when(days <= 4, "3-4 days").when(days <= 5, "4-5 days")
            .when(days <= 7, "5-7 days").when(days <= 10, "7-10 days").otherwise("10+ days"))


def late_delivery_by_month(deliveries: DataFrame) -> DataFrame:
    """Number of deliveries per purchase month and delay class."""
    days = floor_days(F.col("order_estimated_delivery_date"), F.col("order_delivered_customer_date"))
    return (
        deliveries.select(
            period_label(F.col("order_purchase_timestamp"), "month").alias("purchase_month"),
            delay_category(days).alias("delay_category"))
        .groupBy("purchase_month", "delay_category").agg(F.count("*").alias("count"))
        .orderBy("purchase_month", "delay_category")
    )


def top_sellers(sellers: DataFrame, n_sellers: int = 30, id_column: str = "seller_id",
                value_column: str = "total_revenue") -> DataFrame:
    """The ``n_sellers`` sellers of highest value with a short form of their id."""
    require_columns(sellers, [id_column, value_column])
    short = F.concat(F.substring(F.col(id_column).cast("string"), 1, 8), F.lit("..."))
    # The few rows of the result come to the driver, so that one job both finds them and shows that there are any.
    found = (sellers.orderBy(F.desc(value_column), id_column).limit(n_sellers)
             .withColumn(f"{id_column}_short", short).toArrow())
    if not found.num_rows:
        raise ValueError("the seller table has no rows")
    return sellers.sparkSession.createDataFrame(found)


# Latitude and longitude by the first two digits of a postcode.
AREA_COORDINATES = {
    "01": (-23.55, -46.63), "02": (-23.51, -46.62), "03": (-23.54, -46.57), "04": (-23.62, -46.63),
    "05": (-23.53, -46.69), "06": (-23.53, -46.78), "07": (-23.46, -46.54), "08": (-23.50, -46.41),
    "09": (-23.67, -46.56), "11": (-23.96, -46.33), "12": (-23.18, -45.88), "13": (-22.90, -47.06),
    "14": (-21.18, -47.81), "15": (-20.81, -49.38), "16": (-21.22, -50.42), "17": (-22.33, -49.07),
    "18": (-22.12, -51.38), "19": (-22.73, -47.33), "20": (-22.90, -43.20), "21": (-22.86, -43.24),
    "22": (-22.97, -43.22), "23": (-22.88, -43.31), "24": (-22.88, -43.10), "25": (-22.66, -43.70),
    "26": (-22.76, -43.44), "27": (-22.51, -44.12), "28": (-21.76, -41.33), "30": (-19.92, -43.94),
    "31": (-19.88, -43.92), "32": (-19.93, -43.98), "35": (-19.16, -42.91), "36": (-21.76, -43.35),
    "37": (-20.73, -46.61), "38": (-18.91, -46.80), "39": (-17.86, -41.50), "40": (-12.97, -38.50),
    "41": (-12.94, -38.41), "42": (-12.41, -38.91), "49": (-10.91, -37.07), "50": (-8.05, -34.92),
    "51": (-8.04, -34.93), "52": (-8.03, -34.91), "53": (-8.28, -35.97), "58": (-7.12, -34.86),
    "59": (-5.79, -35.21), "60": (-3.73, -38.52), "64": (-5.09, -42.80), "65": (-2.53, -44.30),
    "66": (-1.46, -48.49), "69": (-3.10, -60.02), "70": (-15.78, -47.93), "71": (-15.77, -47.76),
    "72": (-15.87, -48.01), "73": (-15.64, -47.80), "74": (-16.68, -49.26), "75": (-16.33, -48.95),
    "76": (-15.92, -50.13), "77": (-10.16, -48.33), "78": (-15.60, -56.10), "79": (-20.44, -54.65),
    "80": (-25.42, -49.27), "81": (-25.50, -49.29), "82": (-25.43, -49.27), "83": (-25.44, -49.27),
    "84": (-25.09, -50.16), "85": (-24.95, -53.46), "86": (-23.31, -51.16), "87": (-23.42, -51.94),
    "88": (-27.59, -48.55), "89": (-26.92, -49.07), "90": (-30.03, -51.22), "91": (-30.02, -51.15),
    "92": (-29.92, -51.18), "93": (-29.76, -51.14), "95": (-29.16, -51.18),
}

# Latitude and longitude by the first digit, for areas not listed above.
REGION_COORDINATES = {
    "0": (-15.77, -47.92), "1": (-23.55, -46.63), "2": (-22.90, -43.20), "3": (-19.92, -43.94),
    "4": (-25.42, -49.27), "5": (-30.03, -51.22), "6": (-16.68, -49.26), "7": (-12.97, -38.50),
    "8": (-8.05, -34.92), "9": (-3.10, -60.02),
}

# Fixed value: the position used when neither table has the postcode.
COUNTRY_COORDINATES = (-15.77, -47.92)


def with_coordinates(df: DataFrame, zip_column: str = "customer_zip_code_prefix") -> DataFrame:
    """Add base ``latitude`` and ``longitude`` of a five-digit postcode.

    Postcodes that lost their leading zero are padded first. Both lookups are tables of at most a
    hundred rows whose size Spark knows, so they are broadcast without a hint.
    """
    spark = df.sparkSession
    schema = pa.schema([("prefix", pa.string()), ("lat", pa.float64()), ("lon", pa.float64())])

    def lookup(table, name):
        rows = [{"prefix": p, "lat": lat, "lon": lon} for p, (lat, lon) in table.items()]
        return small_table(spark, rows, schema).toDF(f"{name}_prefix", f"{name}_lat", f"{name}_lon")

    text = F.col(zip_column).cast("string")
    code = F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)
    keyed = df.withColumn("area_prefix", F.substring(code, 1, 2)).withColumn("region_prefix", F.substring(code, 1, 1))
    return (
        keyed.join(lookup(AREA_COORDINATES, "area"), "area_prefix", "left")
        .join(lookup(REGION_COORDINATES, "region"), "region_prefix", "left")
        .select(
            *df.columns,
            F.coalesce("area_lat", "region_lat", F.lit(COUNTRY_COORDINATES[0])).alias("latitude"),
            F.coalesce("area_lon", "region_lon", F.lit(COUNTRY_COORDINATES[1])).alias("longitude"))
    )
