"""Readers: function JSONL, page tables, source trees, prompt templates."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refracta.constants import EXTENSIONS, FILE_BYTES, SKIPPED_DIRS, SKIPPED_NAME_PARTS
from refracta.functions.domains import language_from_path
from refracta.schemas import FUNCTION_JSONL

log = logging.getLogger(__name__)


def read_function_jsonl(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One JSON object per line; a line that does not parse is an error."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(FUNCTION_JSONL).option("mode", "FAILFAST").json(paths)


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders that match a path or pattern, in whatever store it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().toString() for status in fs.globStatus(hadoop_path) or []]


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(matching_paths(spark, path))


def read_function_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several JSONL inputs as one table; a missing one is skipped, none at all is an error."""
    present = [p for p in paths if exists(spark, p)]
    for path in set(paths) - set(present):
        log.warning("no function file at %s", path)
    if not present:
        raise FileNotFoundError(f"none of the function files exists: {list(paths)}")
    return read_function_jsonl(spark, present)


def combine_corpora(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of corpora that may carry different origin columns."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def source_file_filter(files: DataFrame) -> DataFrame:
    """Keep real source files by path and size; neither needs the content."""
    name = _file_name(F.col("path"))
    parts = F.transform(F.split("path", "/"), F.lower)
    wanted = F.col("length").between(*FILE_BYTES) & (name != "__init__.py")
    wanted &= language_from_path(F.col("path")).isNotNull()
    for part in SKIPPED_NAME_PARTS:
        wanted &= ~F.contains(name, F.lit(part))
    wanted &= ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in SKIPPED_DIRS]))
    return files.filter(wanted)


def read_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative_path, language, code) of the source files below ``root``.

    The ending is matched while listing, sizes are filtered before a file is opened.
    """
    endings = ",".join(e.lstrip(".") for e in EXTENSIONS.values())
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{{{endings}}}")
        .load(root)
    )
    kept = source_file_filter(files)
    base = root.split(":", 1)[-1].rstrip("/") + "/"
    return kept.select(
        "path",
        F.substring_index("path", base, -1).alias("relative_path"),
        language_from_path(F.col("path")).alias("language"),
        # Undecodable bytes are dropped, not replaced.
        F.replace(
            F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")
        ).alias("code"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page cache as a table keyed by URL."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt templates of a folder; the file name is the template's name."""
    text = spark.read.text(folder, wholetext=True)
    return text.select(
        F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("name"),
        F.col("value").alias("template"),
    )


def task_templates(templates: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Split ``{task}_{strategy}`` names."""
    pattern = rf"^({'|'.join(tasks)})_(.+)$"
    return templates.filter(F.col("name").rlike(pattern)).select(
        F.regexp_extract("name", pattern, 1).alias("task"),
        F.regexp_extract("name", pattern, 2).alias("strategy"),
        "template",
    )


def suite_templates(templates: DataFrame) -> DataFrame:
    """Split ``test_gen_{language}`` names."""
    pattern = r"^test_gen_(.+)$"
    return templates.filter(F.col("name").rlike(pattern)).select(
        F.regexp_extract("name", pattern, 1).alias("language"), "template"
    )


def require_templates(cells: DataFrame, templates: DataFrame) -> None:
    """Raise when a (task, strategy) of the plan has no template."""
    gap = (
        cells.select("task", "strategy")
        .distinct()
        .join(templates, ["task", "strategy"], "left_anti")
        .limit(1)
        .collect()
    )
    if gap:
        raise FileNotFoundError(f"no prompt template for {gap[0]['task']}_{gap[0]['strategy']}")
