"""Sources and sinks: case feeds, chart pages, episode tables, monitoring outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEED = T.StructType([
    T.StructField("Date_reported", T.DateType()), T.StructField("Country_code", T.StringType()), T.StructField("Country", T.StringType()),
    T.StructField("New_cases", T.DoubleType()), T.StructField("New_deaths", T.DoubleType()),
])


def case_feed(rows: DataFrame, codes: list[str], start: str, end: str) -> DataFrame:
    """Feed rows of the given codes and dates (both ends in) as series, date, cases, deaths; NULL counts are zero."""
    kept = rows.where(F.col("Country_code").isin(codes) & F.col("Date_reported").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return kept.select(F.col("Country_code").alias("series"), F.col("Date_reported").alias("date"), zero("New_cases").alias("cases"), zero("New_deaths").alias("deaths"))


def _feed_schema(spark: SparkSession, path: str) -> T.StructType:
    """The fields of the files at path by their header: those of a feed with their types, others as text."""
    header = spark.read.option("header", True).csv(path).columns
    kinds = {f.name: f for f in FEED}
    missing = {*kinds} - {*header}
    if missing:
        raise ValueError(f"the feed lacks {sorted(missing)}")
    return T.StructType([kinds.get(c, T.StructField(c, T.StringType())) for c in header])


def read_case_feed(spark: SparkSession, path: str, codes: list[str], start: str, end: str) -> DataFrame:
    """CSV feed with a header, found by its columns' names; other columns are not parsed."""
    return case_feed(spark.read.schema(_feed_schema(spark, path)).csv(path, header=True).select(FEED.names), codes, start, end)


def stream_case_feed(spark: SparkSession, path: str, codes: list[str], start: str, end: str, files: int | None = None) -> DataFrame:
    """The same rows as a stream of the files that come to a folder, `files` of them a batch at most; the folder has one already."""
    stream = spark.readStream.schema(_feed_schema(spark, path)).option("header", True)
    if files:
        stream = stream.option("maxFilesPerTrigger", files)
    return case_feed(stream.csv(path).select(FEED.names), codes, start, end)


def _charts(pages: DataFrame, chart_id: str, names: dict[str, str], html: str, mode: str) -> DataFrame:
    """Pages that have the chart, with an array per series and whether they break its rules."""
    body = F.regexp_extract(html, rf"(?s)Highcharts\.chart\('{chart_id}'(.*?)\}}\);", 1)
    rows = pages.withColumn("_body", body).where("_body <> ''")
    for out, name in names.items():
        data = F.regexp_extract("_body", rf"(?s)name:\s*'{_quoted(name)}'.*?data:\s*(\[[^\]]*\])", 1)
        rows = rows.withColumn(f"_{out}", F.from_json(data, "array<int>", {"mode": mode}))
    sizes = [F.coalesce(F.size(f"_{out}"), F.lit(-1)) for out in names]
    bad = sizes[0] < 0
    for out, size in zip(names, sizes, strict=True):
        bad = bad | (size != sizes[0]) | F.coalesce(F.exists(f"_{out}", lambda x: x.isNull() | (x < 0)), F.lit(True))
    return rows.withColumn("_bad", F.coalesce(bad, F.lit(True)))


def read_chart_series(pages: DataFrame, chart_id: str, names: dict[str, str], anchor: str, html: str = "html", keys: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Weekly counts of a chart in a page's script: one column per named series, without the two partial end bins.

    names: output column -> series name in the chart. Data must be whole numbers of 0 or more, in lists of one length;
    a page with the chart that breaks this is an error, or, if not strict, has no rows (`malformed_charts` has it); a page
    without the chart has no rows. Weeks are labelled W01 on.
    """
    keys = keys or []
    rows = _charts(pages, chart_id, names, html, "FAILFAST" if strict else "PERMISSIVE")
    zipped = F.arrays_zip(*(f"_{o}" for o in names))
    if strict:
        zipped = F.when(F.col("_bad"), F.raise_error(F.lit("a chart's series do not agree")).cast("array<struct<" + ",".join(f"_{o}:int" for o in names) + ">>")).otherwise(zipped)
    else:
        rows = rows.where(~F.col("_bad"))
    week = rows.select(*keys, F.size(f"_{next(iter(names))}").alias("_n"), F.posexplode(zipped).alias("_i", "_x")).where("_i > 0 and _i < _n - 1")
    return week.select(
        *keys, F.concat(F.lit("W"), F.lpad(F.col("_i").cast("string"), 2, "0")).alias("reporting_week"), F.date_add(F.lit(anchor).cast("date"), 7 * (F.col("_i") - 1)).alias("date"),
        *(F.col(f"_x._{out}").alias(out) for out in names),
    )


def malformed_charts(pages: DataFrame, chart_id: str, names: dict[str, str], html: str = "html", keys: list[str] | None = None) -> DataFrame:
    """(keys, name, values): the series of pages whose chart breaks the rules, with how many values could be read of each."""
    rows = _charts(pages, chart_id, names, html, "PERMISSIVE").where("_bad")
    parts = [F.struct(F.lit(name).alias("name"), F.coalesce(F.size(F.filter(f"_{out}", lambda x: x >= 0)), F.lit(0)).alias("values")) for out, name in names.items()]
    return rows.select(*(keys or []), F.inline(F.array(*parts)))


def _quoted(name: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in name)


def read_episodes(spark: SparkSession, path: str, schema: str | T.StructType, columns: list[str], kind: str = "parquet") -> DataFrame:
    """Only the named columns of a wide result table, by an explicit schema; seeds come as text."""
    table = spark.read.schema(schema).parquet(path) if kind == "parquet" else spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)
    seeds = [c for c in columns if c.endswith("seed")]
    return table.select(*(F.col(c).cast("string").alias(c) if c in seeds else F.col(c) for c in columns))


def write_episodes(df: DataFrame, path: str, order: tuple[str, ...] = ("scenario", "replicate", "method"), kind: str = "parquet", slices: int | None = None) -> None:
    """Rows ranged and sorted by scenario, replicate and method, columns in name order; the committer makes it whole or absent."""
    table = df.select(*sorted(df.columns))
    table = table.repartitionByRange(slices, *order) if slices else table.repartitionByRange(*order)
    table = table.sortWithinPartitions(*order)
    if kind == "parquet":
        table.write.mode("overwrite").parquet(path)
    else:
        table.write.mode("overwrite").csv(path, header=True, escape='"')


def write_monitoring(summary: DataFrame, trace: DataFrame, benchmark: DataFrame, path: str) -> None:
    """The three tables of a monitoring run, the trace partitioned by series."""
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    trace.write.mode("overwrite").partitionBy("series").parquet(f"{path}/trace")
    benchmark.write.mode("overwrite").parquet(f"{path}/benchmark")


def union_banks(banks: list[DataFrame], labels: list[str], stage: str, digest: str) -> DataFrame:
    """Independent result banks as one table that says where each row is from."""
    out = None
    for bank, label in zip(banks, labels, strict=True):
        part = bank.withColumn("evidence_source", F.lit(label)).withColumn("evidence_stage", F.lit(stage)).withColumn("producer_scientific_digest", F.lit(digest))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
