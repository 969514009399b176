"""Sinks: partitioned and sharded Parquet, accepted and rejected rows, keyed caches, resumed jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(df: DataFrame, path: str, rows: int, by: list[str] | None = None) -> None:
    """Parquet files of at most ``rows`` rows, in folders by the columns ``by``."""
    writer = df.write.mode("error").option("maxRecordsPerFile", rows).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_verdicts(df: DataFrame, path: str, reason: str = "reason", ok: str = "ok") -> None:
    """Rows in the folders accepted and rejected; one pass, as a partitioned write."""
    df.withColumn("verdict", F.when(F.col(reason) == ok, "accepted").otherwise("rejected")).write.mode("error").partitionBy("verdict").parquet(path)


def cache_key(*parts: Column) -> Column:
    """Twelve hexadecimal digits for what a table was made from."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def append_pending(df: DataFrame, path: str, key: str, process: Callable[[DataFrame], DataFrame] = lambda x: x) -> int:
    """Processes and appends the rows of ``df`` whose key the table at ``path`` doesn't have; how many it has then. May be run again after any failure."""
    spark: SparkSession = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    process(df).write.mode("append").parquet(path)
    return spark.read.parquet(path).count()


def to_latex(df: DataFrame, caption: str) -> str:
    """A report table; ``df`` must be an aggregate, since its rows come to the driver."""
    rows = df.collect()
    body = " \\\\\n".join(" & ".join("" if v is None else str(v).replace("_", r"\_").replace("%", r"\%") for v in r) for r in rows)
    return f"\\begin{{table}}\n\\caption{{{caption}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{' & '.join(c.replace('_', chr(92) + '_') for c in df.columns)} \\\\\n\\hline\n{body} \\\\\n\\end{{tabular}}\n\\end{{table}}"


def append_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, in files beside those that are there."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def merge_files(spark: SparkSession, path: str, out: str, files: int) -> int:
    """The rows of a folder's Parquet files in ``files`` ones, without a shuffle and row group by row group; how many rows."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    rows.coalesce(files).write.mode("error").option("compression", "zstd").parquet(out)
    return spark.read.parquet(out).count()


def upload_chunks(df: DataFrame, folder: str, send: Callable[[str], None], rows: int = 500, tries: int = 3) -> int:
    """Writes Parquet files of at most ``rows`` rows under ``folder`` and sends each by name, up to ``tries`` times; how many went."""
    write_shards(df, folder, rows)
    sent = 0
    for name in sorted(df.sparkSession.read.parquet(folder).inputFiles()):
        for left in reversed(range(tries)):
            try:
                send(name)
                break
            except OSError:
                if not left:
                    raise
        sent += 1
    return sent


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """An aggregate as one CSV file with a header, or one of JSON lines."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def write_parts(df: DataFrame, path: str, key: str, every: int) -> int:
    """Writes ``df`` in folders of ``every`` values of an integer key, those left out that have been written whole; how many were written.

    A folder is whole if it has the mark that Spark writes last and as many rows as ``df`` has for it, so a run that broke off is taken up again.
    """
    spark: SparkSession = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = df.withColumn("_part", F.floor(F.col(key) / every)).groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    written = 0
    for r in parts:
        folder = f"{path}/part={r['_part']}"
        mark = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if mark.getFileSystem(conf).exists(mark) and spark.read.parquet(folder).count() == r["n"]:
            continue
        df.where(F.floor(F.col(key) / every) == r["_part"]).write.mode("overwrite").parquet(folder)
        written += 1
    return written
