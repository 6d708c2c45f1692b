"""Employee import files: CSV rows with the faults of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The header, in order, and the most rows of a file.
COLUMNS = ("full_name", "email", "job_title", "department", "national_id", "contact_info", "date_hired", "salary")
MOST_ROWS, MOST_CHARS = 100, 250_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files with quotes; _bad holds a line that does not fit."""
    schema = ", ".join(f"{c} string" for c in COLUMNS) + ", _bad string"
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)


def write(rows: DataFrame, path: str) -> None:
    """CSV files that `read` takes, with the header in order; other columns are left out."""
    rows.select(*COLUMNS).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def file_faults(spark: SparkSession, path: str) -> DataFrame:
    """For each file of a path: file, fault: header, too_many_rows, too_large, or null where it may be read.

    The header must be exactly COLUMNS, in order; a byte order mark before it is ignored. Lines are counted as they stand,
    so a quoted field over several lines counts as several.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("line")).where(F.trim("line") != "")
    header = F.count_if(F.col("line") == ",".join(COLUMNS))
    out = lines.groupBy("file").agg(header.alias("headers"), F.count(F.lit(1)).alias("lines"), F.sum(F.length("line") + 1).alias("chars"))
    fault = F.when(F.col("headers") != 1, "header").when(F.col("lines") - 1 > MOST_ROWS, "too_many_rows").when(F.col("chars") > MOST_CHARS, "too_large")
    return out.select("file", fault.alias("fault"))


def faults(rows: DataFrame, roles: DataFrame, departments: DataFrame) -> DataFrame:
    """Adds faults, an array of names, empty for a good row. Addresses are the same without regard to case and white space
    at the ends; rows without one are alike too. Addresses are counted before rows meet the counts above one, so one that
    very many rows share is a skewed join, not a task's window."""
    known = roles.join(departments, "department_id").groupBy(F.lower("title").alias("_t"), F.lower("department").alias("_d")).agg(F.count(F.lit(1)).alias("_roles"))
    out = rows.join(known, (F.lower(F.trim("job_title")) == F.col("_t")) & (F.lower(F.trim("department")) == F.col("_d")), "left")
    shared = rows.groupBy(F.lower(F.trim("email")).alias("_e")).agg(F.count(F.lit(1)).alias("_same")).where("_same > 1")
    out = out.join(shared, F.lower(F.trim("email")).eqNullSafe(F.col("_e")), "left")
    checks = {
        "name": F.coalesce(F.length(F.trim("full_name")), F.lit(0)).between(1, 200),
        "email": F.coalesce(F.trim("email").rlike("^[^@ ]+@[^@ ]+[.][^@ ]+$"), F.lit(False)),
        "repeated_email": F.col("_same").isNull(),
        "role": F.coalesce(F.col("_roles") == 1, F.lit(False)),
        "date": F.coalesce(F.col("date_hired").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.expr("try_cast(date_hired as date)").isNotNull(), F.lit(False)),
        "salary": F.coalesce(F.col("salary").rlike("^[0-9]{1,10}([.][0-9]{1,2})?$"), F.lit(False)),
    }
    return out.withColumn("faults", F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in checks.items()]))).drop("_t", "_d", "_roles", "_e", "_same")
