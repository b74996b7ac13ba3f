"""CSV and table I/O (S1, S3-S5; S7 with inferred types is in ``infer``).

PostgreSQL ``COPY ... CSV`` reads an unquoted empty field as NULL and a quoted
empty field as ``''``. Spark's CSV reader does the same when ``nullValue`` is
a token that cannot occur in the data, so every raw column is read as a
string with that setting and cleaned afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tillroll.sources import store

# A control character never present in the exported text files.
_NEVER = "\u0001"
# Rows of a compressed part file, which is read by one task as a whole.
FILE_ROWS = 1_000_000


def read_csv(spark: SparkSession, path: str, schema: StructType | None,
             multi_line: bool = False) -> DataFrame:
    """Header CSV with comma delimiter and a declared all-string schema (None:
    strings named by the header).

    Quotes inside a quoted field are doubled, a backslash is an ordinary
    character and blanks are kept, as ``COPY ... CSV`` has it. ``multi_line``
    allows quoted line breaks; without it files stay splittable and a quoted
    line break makes its record malformed, which fails the job.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return (reader.option("header", True).option("sep", ",")
            .option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("nullValue", _NEVER).option("emptyValue", "")
            .option("multiLine", multi_line)
            .option("mode", "FAILFAST")
            .csv(path))


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Header CSV export (a directory of part files), replacing earlier output.

    NULL is an unquoted empty field, the empty text a quoted one; quotes are
    doubled and blanks kept. With ``compression`` (``gzip``) the part files are
    compressed and hold ``FILE_ROWS`` rows at most; ``read_csv`` reads both.
    """
    w = (df.write.mode("overwrite").option("header", True)
         .option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("nullValue", "").option("emptyValue", '""'))
    if compression:
        w = w.option("compression", compression).option("maxRecordsPerFile", FILE_ROWS)
    w.csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Create-table-as-select: the table at ``path`` is replaced whole, as parquet
    (S4, S5); see ``store.replace_table``. Read it with ``read_table``."""
    store.replace_table(df, path, partition_by)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Re-read a written table; parquet keeps the column types."""
    return spark.read.parquet(store.current_version(spark, path))
