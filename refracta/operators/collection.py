"""From pages and source files to function rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refracta.constants import SOURCE_PAGES, SOURCE_TREES
from refracta.functions.domains import (
    domain_from_path,
    domain_from_task,
    plausible_code,
    task_name_from_url,
)
from refracta.functions.extraction import HEADERS, HEADLINE, language_blocks, language_functions
from refracta.functions.metrics import keyword_complexity, with_metrics
from refracta.functions.text import by_language
from refracta.operators.astnodes import (
    COMPLEXITY_FIELDS, FUNCTION_FIELDS, python_function_array, tree_complexity, with_tree,
)


def page_blocks(pages: DataFrame, heading: str = HEADLINE, tags=("pre", "code")) -> DataFrame:
    """One row per page and language listing."""
    return pages.select(
        "page_id", "url", F.inline(language_blocks(F.col("html"), heading, tags))
    ).withColumn("task_name", task_name_from_url(F.col("url")))


def file_functions(files: DataFrame) -> DataFrame:
    """Functions of source files: (path, relative_path, language, seq, name, code).

    One pass: each row takes the branch of its language, only Python rows are parsed.
    """
    code, language = F.col("code"), F.col("language")
    branches = {name: language_functions(code, name) for name in HEADERS}
    branches["python"] = python_function_array(code, F.col("__tree"))
    found = by_language(language, branches, F.lit(None))
    return (
        with_tree(files.select("path", "relative_path", "language", "code"), "code", "__tree", language == "python", FUNCTION_FIELDS)
        .select("path", "relative_path", "language", F.posexplode(found).alias("seq", "f"))
        .select("path", "relative_path", "language", "seq", "f.name", "f.code")
    )


def _measured(df: DataFrame, compiles: bool = False) -> DataFrame:
    """Metrics, with tree complexity and, if wanted, the compile flag for Python."""
    fields = (*COMPLEXITY_FIELDS, "compile_ok") if compiles else COMPLEXITY_FIELDS
    parsed = with_tree(df, "code", "__tree", F.col("language") == "python", fields).select(
        *df.columns,
        tree_complexity(F.col("__tree")).alias("__tree_cc"),
        *([F.col("__tree.compile_ok").alias("__compiles")] if compiles else []),
    )
    # Keywords are counted only where there is no tree, and not again in filters on the result.
    cc = F.coalesce("__tree_cc", keyword_complexity(F.col("code")))
    return with_metrics(parsed, cc=cc).drop("__tree_cc", "complexity_tier")


def from_pages(blocks: DataFrame) -> DataFrame:
    """Function candidates from page listings, with ``plausible`` per row."""
    return (
        _measured(blocks, compiles=True)
        .withColumn("plausible", plausible_code(F.col("code"), F.col("language"), F.col("__compiles")))
        .withColumns(
            {"domain": domain_from_task(F.col("task_name")), "source": F.lit(SOURCE_PAGES)}
        )
        .drop("__compiles")
    )


def from_files(functions: DataFrame) -> DataFrame:
    """Function candidates from source files."""
    return (
        _measured(functions)
        .withColumnRenamed("name", "task_name")
        .withColumns(
            {
                "domain": domain_from_path(F.col("relative_path")),
                "source": F.lit(SOURCE_TREES),
                "file_path": F.col("path"),
            }
        )
        .drop("path")
    )
