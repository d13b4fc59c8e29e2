"""Sources and sinks of bars: typed scans, normalisation, multi-source ingest, keyed upserts."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Which source wins for one ticker and date: lower first.
PRIORITY = {"R": 0, "A": 1, "N": 2}
COLUMNS = ["date", "ticker", "open", "high", "low", "close", "volume", "source"]


def scan_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_features(df: DataFrame, path: str, by: str = "year") -> None:
    df.withColumn(by, F.year("date")).write.partitionBy(by).mode("overwrite").parquet(path)


def write_tables(tables: dict[str, DataFrame], run_dir: str, kind: str = "csv") -> list[str]:
    """Named result tables into a fresh folder; an existing one is an error."""
    paths = []
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        paths.append(f"{run_dir.rstrip('/')}/{name}")
        writer.csv(paths[-1], header=True) if kind == "csv" else writer.parquet(paths[-1])
    return paths


def tidy(raw: DataFrame, source: str | None = None) -> DataFrame:
    """One source in the fixed schema: bad dates and numbers become null; rows without date or positive close go."""
    number = lambda c: F.expr(f"try_cast({c} as double)").alias(c)
    rows = raw.select(F.expr("try_cast(date as date)").alias("date"), "ticker", *map(number, ("open", "high", "low", "close", "volume")), F.lit(source).alias("source") if source else F.col("source"))
    return rows.filter(F.col("date").isNotNull() & (F.col("close") > 0))


def clip(df: DataFrame, start, end) -> DataFrame:
    """Rows of [start, end)."""
    return df.filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))


def back_adjust(df: DataFrame, adjusted: str = "adj_close") -> DataFrame:
    """Prices times adjusted over raw close; a missing or infinite ratio counts as 1."""
    ratio = F.coalesce(F.when(F.col("close") != 0, F.col(adjusted) / F.col("close")), F.lit(1.0))
    return df.withColumn("_k", ratio).withColumns({c: F.col(c) * F.col("_k") for c in ("open", "high", "low", "close")}).drop("_k")


def ingest(sources: list[DataFrame], wanted: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """(bars, report): for each wanted ticker the rows of the first source that alone has min_rows of them.

    Rows of a source that is too short are not kept, nor added to another's. report: ticker, n_rows (those kept), collected,
    and a reason where no source is long enough: no_rows if none has any.
    """
    asked = wanted.select("ticker").distinct()
    every = None
    for k, source in enumerate(sources):
        part = source.join(asked, "ticker", "left_semi").select(*COLUMNS, F.lit(k).alias("_s"))
        every = part if every is None else every.unionByName(part)
    counts = every.groupBy("ticker", "_s").agg(F.count("*").alias("n"))
    best = counts.groupBy("ticker").agg(F.min(F.when(F.col("n") >= min_rows, F.struct("_s", "n"))).alias("x")).select("ticker", F.col("x._s").alias("_s"), F.col("x.n").alias("n_rows"))
    got = every.join(best, ["ticker", "_s"], "left_semi").drop("_s")
    report = asked.join(best.withColumn("_any", F.lit(True)), "ticker", "left").select("ticker", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "_any")
    report = report.withColumn("collected", F.col("n_rows") > 0)
    return got, report.withColumn("reason", F.when(F.col("collected"), F.lit(None)).when(F.col("_any").isNull(), "no_rows").otherwise("too_few_rows")).drop("_any")


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str, known_bad: DataFrame | None = None) -> DataFrame:
    """The last loaded row of each key; keys known as bad are left out."""
    rows = old.unionByName(new)
    if known_bad is not None:
        rows = rows.join(known_bad, keys, "left_anti")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def benchmark(raw: DataFrame, order: str) -> DataFrame:
    """Positive closes, the last row of each date."""
    rows = raw.filter(F.col("date").isNotNull() & (F.expr("try_cast(close as double)") > 0))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(order)))).filter("_r = 1").select("date", F.col("close").cast("double").alias("close"))
