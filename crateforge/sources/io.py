"""Sources and sinks: delimited text with a sniffed separator, JSON, lines, lists, tables; nothing is ever unpickled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crateforge.functions.text import split_list
from crateforge.operators.ranges import numbered

SEPARATORS = (",", "\t", ";", "|")


def sniff(spark: SparkSession, path: str) -> str:
    """The separator that the first line has most often."""
    line = spark.read.text(path).limit(1).collect()
    head = line[0][0] if line else ""
    return max(SEPARATORS, key=head.count)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str | None = None, index_column: bool = False) -> DataFrame:
    """Delimited files with a header, by a declared schema; NaN becomes null. A path may be a glob. An index column, if there is one, is dropped."""
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([T.StructField("_c0", T.StringType()), *declared.fields]) if index_column else declared
    df = spark.read.csv(path, schema=whole, sep=sep or sniff(spark, path), header=True, enforceSchema=True, multiLine=True, escape='"')
    cleaned = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in declared.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(cleaned).select(*[f.name for f in declared.fields])


def read_glob(spark: SparkSession, pattern: str, schema: str, sep: str = ",") -> DataFrame:
    """Several files as one, with the file each row came from."""
    return read_csv(spark, pattern, schema, sep).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Files that are one array of objects or one object each, or with ``lines`` an object in every line."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without comments (#) and blanks."""
    return useful_lines(spark.read.text(path))


def useful_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    text = F.trim(F.col(column))
    return lines.select(text.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))


def from_list(spark: SparkSession, text: str) -> DataFrame:
    """A comma list as rows."""
    return spark.range(1).select(F.explode(split_list(F.lit(text))).alias("value"))


def write_csv(df: DataFrame, path: str, sep: str = ",", digits: int | None = None, mode: str = "error") -> None:
    """With a header, without an index column; floating columns to a fixed number of digits if asked."""
    if digits is not None:
        df = df.withColumns({f.name: F.format_string(f"%.{digits}f", f.name) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
    df.write.csv(path, sep=sep, header=True, mode=mode, escape='"')


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.json(path, mode=mode)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_unfinished(todo: DataFrame, path: str, key: str, work) -> int:
    """Resumable batch: rows whose key the result lacks are worked on and appended. Returns how many there were."""
    spark = todo.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
        left = todo.join(done, key, "left_anti")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        left = todo
    n = left.count()
    if n:
        work(left).write.mode("append").parquet(path)
    return n


#: Rows of one JSON document; larger results are asked for by pages.
MOST_ROWS = 100_000


def _document(order: list[str], columns: list[str]):
    listed = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("r"))))
    return F.to_json(F.struct(F.transform(listed, lambda x: x.getField("r")).alias("results")))


def json_response(df: DataFrame, order: list[str], most: int = MOST_ROWS) -> DataFrame:
    """One row: the rows of a result of at most ``most`` rows as a JSON document {"results": [...]}; more are an error."""
    refused = F.raise_error(F.lit(f"more than {most} rows: ask for pages")).cast("string")
    return df.limit(most + 1).agg(F.when(F.count("*") > most, refused).otherwise(_document(order, df.columns)).alias("body"))


def write_pretty_json(df: DataFrame, path: str, order: list[str], most: int = MOST_ROWS) -> None:
    """A small result as one indented JSON array in a text file, characters beyond ASCII as they are; more than ``most`` rows are an error."""
    listed = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*df.columns).alias("r"))))
    body = F.to_json(F.transform(listed, lambda x: x.getField("r")), {"pretty": "true"})
    refused = F.raise_error(F.lit(f"more than {most} rows")).cast("string")
    df.limit(most + 1).agg(F.when(F.count("*") > most, refused).otherwise(body).alias("value")).write.text(path)


def json_pages(df: DataFrame, order: list[str], page_rows: int = 1000) -> DataFrame:
    """(page, body): a result of any size as documents of ``page_rows`` rows each, from page 0 on; ``order`` must be total. No rows, no pages."""
    rows = numbered(df, order, "_place").withColumn("page", F.floor(F.col("_place") / F.lit(page_rows)).cast("long"))
    return rows.groupBy("page").agg(_document(order, df.columns).alias("body"))


def answer(spark: SparkSession, known: dict, name: str, order: list[str]) -> DataFrame:
    """(status, body) of a request by a query's name: 200 and its rows, or 404 and an error that names what is unknown."""
    if name not in known:
        error = F.to_json(F.struct(F.lit(f"unknown query: {name}").alias("error")))
        return spark.range(1).select(F.lit(404).alias("status"), error.alias("body"))
    return json_response(known[name](), order).select(F.lit(200).alias("status"), "body")


def table_summary(spark: SparkSession, names: list[str]) -> DataFrame:
    """(name, rows) of registered views."""
    parts = [spark.table(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
