"""Relational tables: schemas, readers, and writers that never touch what they read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

PAPERS = (
    "canonical_key string, identity_type string, identity_value string, confidence string, document_kind string, doi string, "
    "pmcid string, pmid string, title string, normalized_title string, publication_year int, first_seen_at timestamp, "
    "last_seen_at timestamp"
)
FILE_ALIASES = (
    "file_hash string, canonical_key string, filename string, file_size_bytes bigint, first_seen_at timestamp, "
    "last_seen_at timestamp"
)
ANALYSIS_CACHE = (
    "canonical_key string, depth string, stage string, analysis_version string, result_json string, provider string, "
    "model string, usage_json string, hit_count bigint, created_at timestamp, updated_at timestamp"
)
CONCEPTS = (
    "id string, canonical_name string, normalized_name string, definition_ko string, definition_en string, "
    "mechanism_ko string, mechanism_en string, why_it_matters_ko string, why_it_matters_en string, "
    "prerequisites array<string>, difficulty string, quality_status string, source_model string, hit_count bigint"
)
CONCEPT_ALIASES = "concept_id string, alias_display string, alias_normalized string"
METHOD_ENTRIES = (
    "normalized_name string, canonical_name string, summary_ko string, summary_en string, principle_ko string, "
    "principle_en string, best_for_ko string, best_for_en string, limitations_ko string, limitations_en string, "
    "facets map<string, array<string>>, taxonomy_version int, quality_status string, source_model string, hit_count bigint"
)

# Text tables: work per row is heavy, and a table of few row groups would keep most cores idle.
TEXT_TABLES = ("documents", "pages", "conversations")
FEW_FILES = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def row_groups(df: DataFrame) -> int | None:
    """Number of row groups, from the footers of a Parquet table of at most ``FEW_FILES`` files; None where there are more."""
    files = df.inputFiles()
    if len(files) > FEW_FILES:
        return None
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    total = 0
    for name in files:
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        total += reader.getRowGroups().size()
        reader.close()
    return total


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a Parquet table that has few files and fewer row groups than there are cores.  A row group is read by one task, however many
    splits its file has; so this moves at most some ``FEW_FILES`` files, once, and leaves every other table where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    groups = row_groups(df)
    return df if groups is None or groups >= cores else df.repartition(cores)


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Table at ``path`` with an explicit schema; a missing path is an empty table."""
    try:
        return spark.read.schema(schema).options(**options).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_state(state: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Store a new table state in a new folder.  An existing folder is an error: states are never written over their input."""
    writer = state.write.mode("errorifexists").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
