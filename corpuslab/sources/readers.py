"""Sources with explicit schemas, and what the reference's loaders do with columns and boundaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Column names that hold a text, in the order in which they are tried.
TEXT_COLUMNS = ("text", "content", "sentence", "transcription")


def resolve_text_column(df: DataFrame, candidates: Sequence[str] = TEXT_COLUMNS) -> str:
    """The first candidate that the schema has, else its first text column; an error without one."""
    for name in candidates:
        if name in df.columns:
            return name
    for name, kind in df.dtypes:
        if kind == "string":
            return name
    raise ValueError("no column holds text")


def joined_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """The texts of several columns on a line each, empty ones left out; arrays are joined by spaces, structs and maps give ``kk`` or ``kaz``."""
    parts = []
    for name in columns:
        kind = df.schema[name].dataType.typeName()
        c = F.col(name)
        if kind == "array":
            c = F.array_join(c, " ")
        elif kind in ("struct", "map"):
            names = df.schema[name].dataType.names if kind == "struct" else ("kk", "kaz")
            c = F.coalesce(*(c[k] for k in ("kk", "kaz") if k in names))
        parts.append(F.nullif(c.cast("string"), F.lit("")))
    return F.concat_ws("\n", *parts)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """CSV with quoted line ends; rows that don't fit the schema have nulls, and texts of null are empty."""
    df = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", **options).csv(path)
    return df.fillna("", [n for n, k in df.dtypes if k == "string"])


def read_tsv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Lines of at least as many fields as ``names``; further fields are dropped."""
    fields = F.split("value", "\t")
    lines = spark.read.text(path).where(F.size(fields) >= len(names))
    return lines.select(*(fields[i].alias(n) for i, n in enumerate(names)))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object a line; blank lines are none."""
    return spark.read.schema(schema).json(path)


def read_parquet_sources(spark: SparkSession, path: str, skip: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Text and file stem (as ``source``) of the Parquet files of a folder; corrupt files and skipped stems are left out."""
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1)
    out = df.select(F.col(text).alias("text"), stem.alias("source"))
    return out.where(~F.col("source").isin(list(skip))) if skip else out


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Documents of plain (or compressed) text files, blank lines between them: file, position, text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\n\s*\n")).alias("pos", "text"))
    return files.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")


def read_parallel(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Lines of two text files that stand side by side."""

    def lines(path: str, name: str) -> DataFrame:
        return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", name))

    return lines(left, "a").join(lines(right, "b"), "line").where("a <> '' AND b <> ''")


def ordered_union(frames: Sequence[DataFrame], rank: str = "source_rank") -> DataFrame:
    """All rows of frames whose columns may differ, with the position of each row's frame: the order that decides which copy stays."""
    out = None
    for i, df in enumerate(frames):
        df = df.withColumn(rank, F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frame")
    return out


@dataclass(frozen=True)
class Source:
    """One entry of a source registry: where its files are, their format, and which columns hold the text."""

    name: str
    path: str
    format: str = "parquet"
    text_columns: tuple[str, ...] = ()
    schema: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        """text and source; without named columns the first that resolves."""
        reader = spark.read.options(**self.options)
        df = (reader.schema(self.schema) if self.schema else reader).format(self.format).load(self.path)
        names = self.text_columns or (resolve_text_column(df),)
        text = joined_text(df, names) if len(names) > 1 else F.col(names[0]).cast("string")
        return df.select(text.alias("text"), F.lit(self.name).alias("source"))


def read_sources(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """The texts of all sources in the registry's order, with each one's rank."""
    return ordered_union([s.read(spark) for s in sources])


def read_csv_domains(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV files with the stem of each row's file as ``domain``."""
    df = spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(path)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.csv", 1).alias("domain"))


def read_chunks(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines of a folder's files with ``chunk``, the file's name, by which rows are to be ordered."""
    return spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("chunk"))


def read_page_archives(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """domain (the folder in the archive), name and html of the pages in tar.gz archives; pages of fewer characters are left out. One task reads one archive, page by page."""
    import pyarrow as pa

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import tarfile

        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple[str, str, str]] = []
                with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r:*") as archive:
                    for member in archive:
                        if member.isfile() and member.name.lower().endswith((".html", ".htm")):
                            html = archive.extractfile(member).read().decode("utf-8", "replace")
                            if len(html) >= least:
                                rows.append((member.name.strip("./").split("/")[0], member.name, html))
                        if len(rows) >= 200:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["domain", "name", "html"])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["domain", "name", "html"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(pages, "domain string, name string, html string")


def sitemap_urls(start: str, fetch: Callable[[str], str | None], most: int = 10_000) -> list[str]:
    """The page URLs of a sitemap and the sitemaps that it names, each once, in the order met; ``fetch`` gives a URL's XML or null."""
    import re

    pages, seen, todo = [], {start}, [start]
    while todo and len(seen) <= most:
        xml = fetch(todo.pop(0)) or ""
        found = [u.strip() for u in re.findall(r"(?is)<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>", xml)]
        for url in found:
            if url not in seen:
                seen.add(url)
                (todo if "<sitemapindex" in xml or url.lower().endswith(".xml") else pages).append(url)
    return pages
