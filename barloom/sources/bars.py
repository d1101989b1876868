"""Bar sources and sinks: CSV and Parquet scans, event -> bar building, upsert, feature store."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("dates", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)
PRICES = ("open", "high", "low", "close")


def clean_bars(df: DataFrame) -> DataFrame:
    """Known columns only; rows missing a date or a price go; an unreadable date counts as missing."""
    ts = F.col("dates").try_cast("timestamp_ntz")
    keep = [c for c in ("symbol", "ts", *PRICES, "volume") if c in df.columns or c == "ts"]
    return (
        df.withColumn("ts", ts)
        .select(*keep)
        .dropna(subset=["ts", *PRICES])
        .withColumn("year", F.year("ts"))
    )


def csv_by_header(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.csv") -> list[DataFrame]:
    """CSV files below the given folders, one frame of strings per distinct header line, with the path in `__path`.

    Files may lack columns, have more of them, or have them in another order. Only the first line of every file is read
    to group them; files without any line are left out.
    """
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(paths).select("path")
    )
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in found.orderBy("path").collect():
        place = jvm.org.apache.hadoop.fs.Path(row.path)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(place.getFileSystem(conf).open(place), "UTF-8"))
        line = reader.readLine()
        reader.close()
        if line:
            names = tuple(n.strip().strip('"').lower() for n in line.lstrip("\ufeff").split(","))
            groups.setdefault(names, []).append(row.path)
    out = []
    for names, files in groups.items():
        # A header may leave a name out (an index column) or say it twice; neither is a column that is asked for.
        unique = [n if n and n not in names[:i] else f"__{i}" for i, n in enumerate(names)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in unique])
        frame = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(files)
        out.append(frame.withColumn("__path", F.col("_metadata.file_path")))
    return out


def read_bar_csv(spark: SparkSession, paths: str | Sequence[str], years: Iterable[int] | None = None) -> DataFrame:
    """Scan bar CSV files (one or many, folders searched), whatever the order and number of their columns.

    Without a `symbol` column the symbol is the file's name up to the first dot or underscore; a missing `volume`
    column is missing in every row. Values that are not numbers are missing.
    """
    parts = []
    for frame in csv_by_header(spark, paths):
        have = set(frame.columns)
        stem = F.regexp_extract("__path", r"([^/]+)$", 1)
        symbol = F.col("symbol") if "symbol" in have else F.split(stem, "[._]")[0]
        columns = [symbol.alias("symbol"), (F.col("dates") if "dates" in have else F.lit(None).cast("string")).alias("dates")]
        for field in BAR_SCHEMA.fields[2:]:
            value = F.col(field.name).try_cast("double") if field.name in have else F.lit(None).cast("double")
            columns.append(value.alias(field.name))
        parts.append(frame.select(*columns))
    raw = parts[0] if parts else spark.createDataFrame([], BAR_SCHEMA)
    for part in parts[1:]:
        raw = raw.unionByName(part)
    out = clean_bars(raw)
    return out if years is None else out.filter(F.col("year").isin(list(years)))


def read_importances(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.csv") -> DataFrame:
    """(run, feature, importance) from importance tables of many runs; the run is the folder a file lies in.

    The importance is `mean_abs_shap`, or else the row's first number.
    """
    parts = []
    for frame in csv_by_header(spark, paths, glob):
        names = [n for n in frame.columns if n not in ("feature", "__path")]
        if "feature" not in frame.columns or not names:
            continue
        value = F.col("mean_abs_shap").try_cast("double") if "mean_abs_shap" in names else F.coalesce(*[F.col(n).try_cast("double") for n in names])
        run = F.regexp_extract("__path", r"([^/]+)/[^/]+$", 1)
        parts.append(frame.select(run.alias("run"), "feature", value.alias("importance")))
    out = parts[0] if parts else spark.createDataFrame([], "run string, feature string, importance double")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("feature").isNotNull() & F.col("importance").isNotNull())


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("year",), mode: str = "overwrite") -> None:
    """Parquet, zstd, one folder per year; read back with a year filter this prunes to the folders asked for.

    The rebalance hint lets AQE split a large year over several tasks and files.
    """
    df.hint("rebalance", *by).write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def read_years(spark: SparkSession, path: str, years: Iterable[int], columns: Sequence[str]) -> DataFrame:
    """Column- and partition-pruned scan of a table written by `write_partitioned`."""
    return spark.read.parquet(path).filter(F.col("year").isin(list(years))).select(*columns)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file, without reading its content."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            F.element_at(F.split("path", "/"), -1).alias("file"),
            F.col("length").alias("bytes"),
            (F.col("length") > 0).cast("int").alias("has_data"),
        )
    )


def bucket_floor(ts: Column, seconds: int) -> Column:
    """Start of the left-closed bucket, in epoch seconds."""
    epoch = F.unix_seconds(ts.cast("timestamp"))
    return epoch - F.pmod(epoch, F.lit(seconds))


def bucket_ceil(ts: Column, seconds: int) -> Column:
    """End of the right-closed bucket, in epoch seconds: a row on a boundary belongs to the bucket it ends."""
    micros = F.unix_micros(ts.cast("timestamp"))
    end = micros + F.pmod(-micros, F.lit(seconds * 1_000_000))
    return (end / F.lit(1_000_000)).cast("bigint")


def epoch_to_ts(c: Column) -> Column:
    return F.timestamp_seconds(c).cast("timestamp_ntz")


def bars_from_events(
    events: DataFrame,
    width: int = 3600,
    symbol: str = "event_type",
    value: str = "value",
    tie: str = "event_id",
) -> DataFrame:
    """Events to OHLCV bars. Every aggregate combines map-side, so a hot symbol ships few rows per task."""
    at = F.struct("ts", tie)
    return (
        events.filter(F.col(value).isNotNull() & F.col("ts").isNotNull())
        .groupBy(F.col(symbol).alias("symbol"), bucket_floor(F.col("ts"), width).alias("bucket"))
        .agg(
            F.min_by(value, at).alias("open"),
            F.max(value).alias("high"),
            F.min(value).alias("low"),
            F.max_by(value, at).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .withColumn("ts", epoch_to_ts(F.col("bucket")))
        .withColumn("year", F.year("ts"))
        .select("symbol", "year", "ts", *PRICES, "volume")
    )


def one_per_key(df: DataFrame, keys: Sequence[str], prefer: Sequence[str] = ()) -> DataFrame:
    """One row per key: the smallest by the `prefer` columns, then by value. An aggregate, so a hot key combines map-side."""
    values = [c for c in df.columns if c not in (*keys, *prefer)]
    first = F.min(F.struct(*prefer, *values)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in values])


def upsert_bars(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Append `new` to `old`; where both hold a key the row of `old` stays."""
    both = old.withColumn("__prio", F.lit(0)).unionByName(new.withColumn("__prio", F.lit(1)))
    return one_per_key(both, keys, ["__prio"])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Ordered de-duplication."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def save_feature_store(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Materialise if absent; an existing store is left alone unless `overwrite`."""
    df.write.mode("overwrite" if overwrite else "ignore").option("compression", "zstd").parquet(path)


def feature_store_meta(df: DataFrame, name: str, features: Sequence[str], splits: dict[str, Sequence[int]]) -> DataFrame:
    """One row describing a feature table."""
    def years(key: str) -> Column:
        return F.concat_ws(",", F.lit([str(y) for y in splits[key]]))

    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("feature_set"),
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.concat_ws(",", F.lit(list(features))).alias("feature_columns"),
        years("train").alias("train_years"),
        years("valid").alias("valid_years"),
        years("test").alias("test_years"),
        F.lit("parquet").alias("format"),
    )
