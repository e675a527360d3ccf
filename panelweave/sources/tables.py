"""Table scans: typed reads, coercion, key hygiene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip, zfill

LINEAGE = ["stock_code", "corp_code", "rcept_no", "fiscal_year", "esg_year"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a task reads of a table at most; a file's row groups aren't split further.
ROW_GROUP = 128 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """rows of files that hold fewer row groups than there are cores, dealt over all of them before costly work by row.

    Such a table has less than a row group for each core, so this moves little; larger ones stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.repartition(cores) if max(len(rows.inputFiles()), size / ROW_GROUP) < cores else rows


def dealt_by(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key before each of them becomes many, which then need not move to be counted by key; null like any key."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def read_strings(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with all columns as strings, so leading zeros stay; a byte order mark before the header goes."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def read_first(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet at path, or else the CSV beside it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.parquet(path)
    return read_strings(spark, path.removesuffix(".parquet") + ".csv", columns)


def number(c: Column, kind: str = "int") -> Column:
    """Coerced; null where it isn't a number."""
    return c.try_cast("double").try_cast(kind) if kind != "double" else F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def read_ratings(raw: DataFrame, grades: dict[str, int], key_width: int = 6) -> DataFrame:
    """stock_code zero-filled, fiscal_year an int, the grade as its number; null where the grade isn't known."""
    known = F.create_map(*(F.lit(x) for pair in grades.items() for x in pair))
    return raw.select(zfill(strip(F.col("stock_code")), key_width).alias("stock_code"), number(F.col("fiscal_year")).alias("fiscal_year"), "kcgs_grade", F.try_element_at(known, strip(F.col("kcgs_grade"))).alias("grade"))


def read_stop_words(spark: SparkSession, path: str, protect: Sequence[str]) -> DataFrame:
    """One term a line, without blank lines and protected terms."""
    terms = spark.read.text(path).select(strip(F.col("value")).alias("term")).where(F.length("term") > 0).distinct()
    return terms.where(~F.col("term").isin([*protect])) if protect else terms


def listed_companies(raw: DataFrame) -> DataFrame:
    """corp_code, stock_code, corp_name of companies that have a stock code."""
    code = strip(F.col("stock_code"))
    listed = raw.where(code.isNotNull() & ~code.isin("", "nan", "None"))
    return listed.select(zfill(strip(F.col("corp_code")), 8).alias("corp_code"), zfill(code, 6).alias("stock_code"), strip(F.col("corp_name")).alias("corp_name"))


def latest_per_key(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in this order; give a total order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def original_filing(index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The earliest original of each key: originals before corrections before attachments, then by date."""
    name = F.col("report_nm")
    kind = F.when(name.contains("기재정정"), 1).when(name.contains("첨부정정"), 2).otherwise(0)
    usable = index.where(name.contains("사업보고서") & ~name.rlike("반기|분기|연장|신고서"))
    return latest_per_key(usable, keys, kind.asc(), F.col("rcept_dt").asc(), F.col("rcept_no").asc())


def pending(todo: DataFrame, done: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None, batch: int | None = None) -> DataFrame:
    """Rows whose key isn't done yet; the first `batch` of them in key order."""
    left = todo.join(done.select(*keys).distinct(), [*keys], "left_anti")
    return left if batch is None else left.orderBy(*(order or keys)).limit(batch)


def key_lookup(rows: DataFrame, key: str, names: DataFrame, name_key: str, value: str, *order: Column) -> DataFrame:
    """rows with the value of the first match of their key; null where there is none."""
    first = latest_per_key(names.where(F.col(name_key).isNotNull()), [name_key], *order).select(F.col(name_key).alias("__key"), value)
    return rows.join(first, F.col(key) == F.col("__key"), "left").drop("__key")


def id_map_check(mapped: DataFrame, value: str) -> DataFrame:
    """One row: how many rows a mapping leaves without a value; PASS if none."""
    missing = F.count(F.when(F.col(value).isNull(), 1))
    return mapped.agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("n_missing"), F.when(missing == 0, "PASS").otherwise("FAIL").alias("status"))


def filed_in_window(index: DataFrame, filed: str, fiscal_year: str, last: tuple[int, int] = (6, 30)) -> DataFrame:
    """Filings made from the first day of the year after the fiscal year up to `last` (month, day) of it."""
    year = F.col(fiscal_year).cast("int") + 1
    day = F.to_date(filed)
    return index.where((day >= F.make_date(year, F.lit(1), F.lit(1))) & (day <= F.make_date(year, F.lit(last[0]), F.lit(last[1]))))


def corrected_filing(index: DataFrame, keys: Sequence[str], fiscal_year: str) -> DataFrame:
    """Of each key the filing on its fiscal year: corrections before originals before attachments, then by date."""
    name = F.col("report_nm")
    kind = F.when(name.contains("기재정정"), 0).when(name.contains("첨부정정"), 2).otherwise(1)
    usable = index.where(name.contains("사업보고서") & F.contains(name, F.concat(F.lit("("), F.col(fiscal_year).cast("string"), F.lit(".12)"))))
    return latest_per_key(usable, keys, kind.asc(), F.col("rcept_dt").asc(), F.col("rcept_no").asc())


def tokenized_rows(raw: DataFrame, key_width: int = 6) -> DataFrame:
    """Stored token texts: stock_code zero-filled, fiscal_year an int, joined_text never null."""
    return raw.withColumns({"stock_code": zfill(strip(F.col("stock_code")), key_width), "fiscal_year": number(F.col("fiscal_year")), "joined_text": F.coalesce("joined_text", F.lit(""))})


def company_names(companies: DataFrame) -> DataFrame:
    """corp_name of all companies that have one, each once."""
    return companies.select(strip(F.col("corp_name")).alias("corp_name")).where(F.length("corp_name") > 0).distinct()


def seed_dictionary(raw: DataFrame) -> DataFrame:
    """dimension, seed, pattern (literals apart by |) of a seed dictionary; a pattern left out is the seed itself."""
    seed = strip(F.col("seed"))
    return raw.select(F.upper(strip(F.col("dimension"))).alias("dimension"), seed.alias("seed"), F.coalesce(F.nullif(strip(F.col("pattern")), F.lit("")), seed).alias("pattern")).where(F.length("seed") > 0)
