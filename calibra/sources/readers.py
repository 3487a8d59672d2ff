"""Readers (S1-S5) with explicit schemas.

No reader infers a schema; every one takes a StructType from
``calibra.schemas``.  Paths may be local or on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.functions import parsing


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_results_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV result/bank files; quoted fields may span lines.

    Flag columns of v1 files are text and go through the truthy rule (P1);
    confidence is coerced leniently (P2).
    """
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    fixes = {}
    for c in ("parse_ok", "is_correct"):
        if c in df.columns and dict(df.dtypes)[c] == "string":
            fixes[c] = parsing.truthy(c)
    if "confidence" in df.columns and dict(df.dtypes)["confidence"] == "string":
        fixes["confidence"] = parsing.numeric("confidence")
    return df.withColumns(fixes) if fixes else df


def _exists(spark: SparkSession, path: str) -> bool:
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp)


def read_jsonl_dir(spark: SparkSession, raw_dir: str, stamp: str, models: list[str],
                   schema: T.StructType, malformed: str = "fail") -> DataFrame:
    """One JSONL file per model and stamp, unioned in one scan.

    A line that is not JSON stops an analysis (``malformed="fail"``); a
    resumed collection passes ``"skip"`` and asks for that cell again.
    Numbers may be written as strings; what is no number becomes NULL.
    """
    modes = {"fail": "FAILFAST", "skip": "DROPMALFORMED"}
    paths = [f"{raw_dir.rstrip('/')}/{m}_{stamp}.jsonl" for m in models]
    absent = [p for p in paths if not _exists(spark, p)]
    if absent:
        raise FileNotFoundError(f"no response file at {', '.join(absent)}")
    df = spark.read.schema(_wire(schema)).option("mode", modes[malformed]).json(paths)
    df = _restore_types(df, schema)
    return df.withColumn("_file_model",
                         F.regexp_extract(F.input_file_name(), r"([^/]+)_[^_/]+\.jsonl$", 1))


_NUMBERS = (T.IntegerType, T.LongType, T.DoubleType)


def _wire(schema: T.StructType) -> T.StructType:
    """Number fields are read as text, so that 85, 85.0 and "85" are all good records."""
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, _NUMBERS) else f.dataType, f.nullable)
                         for f in schema.fields])


def _restore_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    fixes = {f.name: F.trim(f.name).try_cast("double").try_cast(f.dataType) for f in schema.fields
             if isinstance(f.dataType, _NUMBERS)}
    return df.withColumns(fixes) if fixes else df


def read_bank_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: a JSON array of bank items; an empty bank is an error."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    if df.isEmpty():
        raise RuntimeError(f"the bank at {path} has no items")
    return df


def read_corpus(spark: SparkSession, all_path: str | None, subject_paths: dict[str, str],
                schema: T.StructType) -> DataFrame:
    """One table of all subjects, else its per-subject parts in one scan.

    Which parts exist is asked of the file system; a part that exists but
    can't be read stops the job.  Columns are those of ``schema``; a null
    subject is the name its part was given.
    """
    if all_path and _exists(spark, all_path):
        return spark.read.schema(schema).parquet(all_path)
    parts = {subject: p for subject, p in subject_paths.items() if _exists(spark, p)}
    if not parts:
        raise FileNotFoundError("the corpus has neither a common table nor a subject part: "
                                + ", ".join([all_path or "-", *subject_paths.values()]))
    df = spark.read.schema(schema).parquet(*parts.values())
    if "subject" not in df.columns:
        df = df.withColumn("subject", F.lit(None).cast("string"))
    # a file belongs to the part whose folder or file its own path continues
    named = F.lit(None).cast("string")
    at = F.col("_metadata.file_path")
    for subject, p in parts.items():
        whole = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath()
        named = F.when(F.url_decode(at).contains(whole + "/") | F.url_decode(at).endswith(whole), F.lit(subject)).otherwise(named)
    return df.withColumn("subject", F.coalesce("subject", named))
