"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.columns import NA_TOKENS, NUMBER_TEXT, text_or_null


@dataclass(frozen=True)
class Source:
    """Where a table is and how to read it. `columns` names the columns of a headerless text file."""

    path: str
    format: str = "csv"
    columns: Sequence[str] = ()
    header: bool = False
    renames: Mapping[str, str] = field(default_factory=dict)
    binarise: str | None = None


def read_text_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = (),
    header: bool = False,
    renames: Mapping[str, str] | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
) -> DataFrame:
    """CSV with every value as trimmed text and missing tokens as NULL.

    Text is kept so that malformed numbers can be counted; `as_numbers` types them. A header is
    lower-cased and trimmed before `renames`.
    """
    if header:
        df = spark.read.option("header", True).csv(path)
        names = [c.strip().lower() for c in df.columns]
        for old, new in (renames or {}).items():
            if old in names and new in names:
                raise ValueError(f"{path} has both {old} and {new}")
            names = [new if n == old else n for n in names]
        df = df.toDF(*names)
    else:
        if not columns:
            raise ValueError("name the columns of a table without a header")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        df = spark.read.schema(schema).csv(path)
    return df.select(*[text_or_null(F.col(c), na_tokens).alias(c) for c in df.columns])


@dataclass
class CheckedTable:
    """Rows of a text table, and the lines that are none: (line, fields, reason), reason 'surplus' or 'short'."""

    rows: DataFrame
    rejected: DataFrame

    def counts(self) -> DataFrame:
        """(reason, lines) of what was rejected."""
        return self.rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def read_checked_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = (),
    header: bool = False,
    renames: Mapping[str, str] | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
    reject_short: bool = False,
) -> CheckedTable:
    """A text table whose ragged lines are told apart, none lost unseen.

    A line with more fields than columns is rejected as a whole. One with fewer has NULL in the columns that it lacks, or is
    rejected with `reject_short`. The parser must see every field to tell, so that pruning is off: keep `rows` if read often.
    """
    raw = spark.read.option("header", header)
    if header:
        names = list(raw.csv(path).columns)
    elif columns:
        names = list(columns)
    else:
        raise ValueError("name the columns of a table without a header")
    line = "_line"
    while line in names:
        line += "_"
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(line, T.StringType())])
    got = raw.schema(schema).option("columnNameOfCorruptRecord", line).option("columnPruning", False).option("enforceSchema", True).csv(path)
    # Commas between quotes separate nothing.
    fields = F.regexp_count(F.regexp_replace(line, '"[^"]*"', ""), F.lit(",")) + 1
    # Spark reads a bad line only beside another column; the lesser of the two is always the first.
    fields = F.least(fields, fields + F.length(F.coalesce("c0", F.lit(""))))
    told = got.withColumn("_fields", F.when(F.col(line).isNotNull(), fields))
    surplus, short = F.col("_fields") > len(names), F.col("_fields") < len(names)
    bad = F.coalesce(surplus | short if reject_short else surplus, F.lit(False))
    shown = [c.strip().lower() for c in names] if header else names
    for old, new in (renames or {}).items():
        if old in shown and new in shown:
            raise ValueError(f"{path} has both {old} and {new}")
        shown = [new if n == old else n for n in shown]
    return CheckedTable(
        told.where(~bad).select(*[text_or_null(F.col(f"c{i}"), na_tokens).alias(c) for i, c in enumerate(shown)]),
        told.where(bad).select(F.col(line).alias("line"), F.col("_fields").alias("fields"), F.when(surplus, "surplus").otherwise("short").alias("reason")),
    )


def as_numbers(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Text columns as double; malformed text becomes NULL."""
    cols = cols or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(F.col(c).rlike(NUMBER_TEXT), F.col(c).try_cast("double")) for c in cols})


def malformed_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: values per text column that are present but no number."""
    cols = cols or df.columns
    return df.agg(*[F.count_if(F.col(c).isNotNull() & ~F.col(c).rlike(NUMBER_TEXT)).alias(c) for c in cols])


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = (),
    na_tokens: Sequence[str] = NA_TOKENS,
    header: bool = False,
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """A text table with numeric columns: missing tokens and malformed text are NULL."""
    return as_numbers(read_text_table(spark, path, columns, header, renames, na_tokens))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    from riskloom.operators.clean import binarise

    if source.format == "csv":
        df = read_table(spark, source.path, source.columns, header=source.header, renames=source.renames)
    else:
        df = spark.read.format(source.format).load(source.path).withColumnsRenamed(dict(source.renames))
    return binarise(df, source.binarise) if source.binarise else df


def read_first_available(spark: SparkSession, sources: Sequence[Source]) -> tuple[DataFrame, Source]:
    """The first source, in order, that exists and can be read; and which one it was."""
    problems = []
    for s in sources:
        try:
            if exists(spark, s.path):
                return read_source(spark, s), s
            problems.append(f"{s.path}: absent")
        except Exception as e:
            problems.append(f"{s.path}: {e}")
    raise RuntimeError("no source could be read: " + "; ".join(problems))


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)
