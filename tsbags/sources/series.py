"""Series from text files and from tables; padding, relabelling, statistics, and the result sink.

Tables: points (series_id, pos, value), series (series_id, label, len, values array<double>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsbags.functions.ranks import exact_ranks
from tsbags.session import table


def read_text_series(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw_label, len, values): one series per line, label first, comma or blanks between the numbers.

    NaN tokens are dropped wherever they stand, so values after an inner gap move left. Lines are numbered by their
    place in the file; files in one folder are told apart by their path.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.trim("value").alias("value"),
    ).filter("value <> ''")
    numbers = F.transform(
        F.filter(F.split("value", r"[,\s]\s*"), lambda x: ~F.lower(x).isin("nan", "")), lambda x: x.cast("double")
    )
    order = Window.partitionBy("file").orderBy("block", "at")
    return lines.select("file", F.row_number().over(order).alias("line"), numbers.alias("n")).select(
        "file", "line", F.get("n", F.lit(0)).alias("raw_label"), (F.size("n") - 1).alias("len"),
        F.slice("n", F.lit(2), F.greatest(F.size("n") - 1, F.lit(0))).alias("values"),
    )


def points_of_events(df: DataFrame, series: str, order: list[str], value: Column) -> DataFrame:
    """Long form from any event table: the place in the given total order is the time axis."""
    at = Window.partitionBy(series).orderBy(*order)
    return df.select(F.col(series).alias("series_id"), (F.row_number().over(at) - 1).alias("pos"), value.alias("value"))


def points_of_long_events(df: DataFrame, series: str, order: list[str], value: Column) -> DataFrame:
    """The same where a series may have more events than a task can sort: its places come from exact ranks by ranges.
    Events without a series are left out."""
    rows = df.filter(F.col(series).isNotNull()).select(F.col(series).alias("series_id"), *[c for c in order if c != series], value.alias("value"))
    return exact_ranks(rows, ["series_id"], order).select("series_id", (F.col("rn") - 1).cast("int").alias("pos"), "value")


def points_of_arrays(df: DataFrame, series: str, values: str | Column) -> DataFrame:
    return df.select(F.col(series).alias("series_id"), F.posexplode(values).alias("pos", "value"))


def wide(points: DataFrame) -> DataFrame:
    """(series_id, len, values) with the values in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return points.groupBy("series_id").agg(ordered.alias("p")).select(
        "series_id", F.size("p").alias("len"), F.transform("p", lambda x: x["value"]).alias("values")
    )


def spread(series: DataFrame) -> DataFrame:
    """The same, dealt to as many tasks as there are cores or shuffle partitions: for tables of few files, whose windows are
    far more work than this exchange of the series."""
    spark = series.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return series.repartition(tasks, "series_id")


def zero_pad(series: DataFrame) -> DataFrame:
    """Every series padded with zeros to the longest; `len` stays the true length."""
    longest = series.agg(F.max("len").alias("_longest"))
    zero = F.lit(0).cast(series.schema["values"].dataType.elementType)
    return series.join(F.broadcast(longest)).select(  # one row
        *[c for c in series.columns if c != "values"],
        F.concat("values", F.array_repeat(zero, (F.col("_longest") - F.col("len")).cast("int"))).alias("values"),
    )


def label_map(train: DataFrame, raw: str = "raw_label", order: str = "series_id") -> DataFrame:
    """(raw_label, label): 0, 1, ... by first appearance in the training rows."""
    first = train.groupBy(F.col(raw).alias("raw_label")).agg(F.min(order).alias("_first"))
    return first.select("raw_label", (F.row_number().over(Window.orderBy("_first")) - 1).alias("label"))


def relabel(df: DataFrame, mapping: DataFrame, raw: str = "raw_label") -> DataFrame:
    """Adds `label`; a raw label that the mapping lacks is an error when the row is used."""
    joined = df.join(mapping.withColumnRenamed("raw_label", "_raw"), F.col(raw).eqNullSafe(F.col("_raw")), "left")
    missing = F.raise_error(F.concat(F.lit("label not seen in training: "), F.col(raw).cast("string"))).cast("int")
    return joined.withColumn("label", F.coalesce("label", missing)).drop("_raw")


def class_sizes(labels: DataFrame) -> DataFrame:
    """(label, n) of (series_id, label)."""
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def stats(series: DataFrame) -> DataFrame:
    """One row: n_series, min_len, max_len, n_classes of (series_id, len, label)."""
    return series.agg(
        F.count("*").alias("n_series"), F.min("len").alias("min_len"), F.max("len").alias("max_len"),
        F.count_distinct("label").alias("n_classes"),
    )


def write_results(results: DataFrame, path: str) -> None:
    """Appends (dataset, run_id, variant, accuracy, train_s, test_s_per_series), a folder per dataset."""
    results.write.mode("append").partitionBy("dataset").parquet(path)


# Tables of this project as series.

def events_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: each user's event values in hundredths, in order of time."""
    events = table(spark, sf_dir, "events")
    return points_of_events(events, "user_id", ["ts", "event_id"], F.round(F.col("value") * 100).cast("long"))


def events_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id")).distinct()
    return users.withColumn("label", (F.col("series_id") % 3).cast("int"))


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, label, len, values): embeddings in millionths, as doubles."""
    values = F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("series_id"), "label", F.size("embedding").alias("len"), values.alias("values")
    )


def orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: each customer's order totals in hundredths; many shorter than a window."""
    orders = table(spark, sf_dir, "orders")
    return points_of_events(
        orders, "o_custkey", ["o_orderdate", "o_orderkey"], F.round(F.col("o_totalprice") * 100).cast("long")
    )
