"""Labels derived from names, paths and file endings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refracta.constants import (
    DOMAIN_BY_PATH,
    DOMAIN_BY_TASK,
    EXTENSIONS,
    LANGUAGE_ALIASES,
    PLAUSIBLE_MARKERS,
)
from refracta.functions.text import any_of, by_language


def _first_hit(text: Column, rules) -> Column:
    expr = F
    for label, words in rules:
        expr = expr.when(any_of(text, words), label)
    return expr.otherwise("other")


def domain_from_task(task_name: Column) -> Column:
    return _first_hit(F.lower(task_name), DOMAIN_BY_TASK)


def domain_from_path(relative_path: Column) -> Column:
    """Domain from a path relative to the tree's root; the root itself must not vote."""
    return _first_hit(F.lower(relative_path), DOMAIN_BY_PATH)


def language_from_alias(alias: Column) -> Column:
    """Language of a page heading, NULL when it is none of ours."""
    return by_language(alias, {k: F.lit(v) for k, v in LANGUAGE_ALIASES.items()}, F.lit(None))


def language_from_path(path: Column) -> Column:
    expr = F
    for language, ending in EXTENSIONS.items():
        expr = expr.when(F.endswith(path, F.lit(ending)), language)
    return expr.otherwise(None)


def extension(language: Column) -> Column:
    return by_language(language, {k: F.lit(v) for k, v in EXTENSIONS.items()}, F.lit(".txt"))


def suite_file_name(function_id: Column, language: Column) -> Column:
    return F.concat(function_id, F.lit("_test"), extension(language))


def plausible_code(code: Column, language: Column, compiles: Column) -> Column:
    """Cheap sanity check per language; Python relies on the compile flag passed in."""
    branches = {"python": F.coalesce(compiles, F.lit(False))}
    branches |= {lang: any_of(code, marks) for lang, marks in PLAUSIBLE_MARKERS.items()}
    return by_language(language, branches, F.lit(True))


def task_name_from_url(url: Column) -> Column:
    return F.replace(F.element_at(F.split(url, "/"), -1), F.lit("_"), F.lit(" "))
