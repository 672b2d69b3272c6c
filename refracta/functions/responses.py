"""Prompts, model replies and API errors as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from refracta.constants import (
    CODE_INDICATORS,
    LANGUAGES,
    LEAD_IN_PATTERN,
    RATE_WHEN_UNKNOWN,
    RATE_WHEN_UNPRICED,
    TEST_INDICATORS,
    TEST_STARTS,
    TEST_TRIGGERS,
)
from refracta.functions.text import WS, any_of, by_language, longest, strip


def render_prompt(template: Column, code: Column, language: Column | None = None) -> Column:
    """Fill ``{code}`` first and ``{language}`` second; the order is part of the contract."""
    filled = F.replace(template, F.lit("{code}"), code)
    return filled if language is None else F.replace(filled, F.lit("{language}"), language)


def _block(reply: Column, opening: str) -> Column:
    matches = F.regexp_extract_all(reply, F.lit(rf"(?s)```{opening}(.*?)```"), F.lit(1))
    return F.nullif(strip(longest(matches)), F.lit(""))


def fenced_code(reply: Column, language: Column) -> Column:
    """Longest fenced block of the first fence style that yields a non-blank one."""

    def styles(tag: str) -> Column:
        return F.coalesce(
            _block(reply, rf"(?:{tag})?{WS}*\n"),
            _block(reply, rf"{WS}*\n"),
            _block(reply, rf"(?:{tag})?{WS}+"),
            _block(reply, rf"{WS}+"),
        )

    # Most of the work is skipped for replies that hold no fence at all.
    return F.when(
        F.contains(reply, F.lit("```")),
        by_language(language, {lang: styles(lang) for lang in LANGUAGES}, F.lit(None)),
    )


def without_lead_in(reply: Column) -> Column:
    """The reply without an opening such as ``Here is the code:``; NULL if nothing is left."""
    cleaned = F.regexp_replace(strip(reply), rf"(?i)\A{LEAD_IN_PATTERN}[^\n]*?:{WS}*", "")
    return F.nullif(cleaned, F.lit(""))


def when_marked(reply: Column, language: Column, markers: dict, value: Column) -> Column:
    """``value`` for replies that hold a marker of their language, else NULL."""
    hit = by_language(language, {k: any_of(reply, v) for k, v in markers.items()}, F.lit(False))
    return F.when(hit, value)


def extract_code(reply: Column, language: Column) -> Column:
    """Code of a transformation reply: fenced block, else the whole text if it looks like code."""
    return F.coalesce(
        fenced_code(reply, language),
        when_marked(reply, language, CODE_INDICATORS, without_lead_in(reply)),
    )


def _from_first_code_line(reply: Column, tokens) -> Column:
    """Text from the first line holding one of the tokens to the end."""
    alternatives = "|".join(re.escape(t) for t in tokens)
    tail = F.regexp_extract(reply, rf"(?s)(?:\A|\n)([^\n]*?(?:{alternatives}).*)\z", 1)
    return F.nullif(strip(tail), F.lit(""))


def extract_test_code(reply: Column, language: Column) -> Column:
    """Code of a test-suite reply: fenced block, code tail, or the text itself."""
    tails = by_language(
        language, {k: _from_first_code_line(reply, v) for k, v in TEST_STARTS.items()}, F.lit(None)
    )
    return F.coalesce(
        fenced_code(reply, language),
        when_marked(reply, language, TEST_TRIGGERS, tails),
        when_marked(reply, language, TEST_INDICATORS, without_lead_in(reply)),
    )


def estimated_cost(tokens_in: Column, tokens_out: Column, rate: Column, known: Column) -> Column:
    """Token cost; separate default rates for unpriced and for unknown models."""
    usd_per_1k = F.when(known, F.coalesce(rate, F.lit(RATE_WHEN_UNPRICED))).otherwise(
        F.lit(RATE_WHEN_UNKNOWN)
    )
    return (tokens_in + tokens_out) / F.lit(1000.0) * usd_per_1k


def http_status(error: Column) -> Column:
    """Status in an error text such as ``API error 429: ...``, NULL when there is none."""
    return F.nullif(F.regexp_extract(error, r"API error (\d{3})", 1), F.lit("")).cast("int")


def error_type(error: Column, code: Column) -> Column:
    """Class of a failed attempt, NULL for a usable one.

    A reply without an error and without code is a parse error.
    """
    status = http_status(error)
    return (
        F.when(error.isNull() & code.isNotNull(), F.lit(None))
        .when(error.isNull(), "parse_error")
        .when(status == 402, "insufficient_funds")
        .when(status == 401, "invalid_api_key")
        .when(status.isin(400, 403), "fatal_api_error")
        .when(status == 429, "rate_limit")
        .when(status.isNotNull(), "server_error")
        .when(F.contains(F.lower(error), F.lit("timeout")), "timeout")
        .otherwise("request_error")
    )


def is_fatal(error: Column) -> Column:
    """Errors that stop a run instead of being retried."""
    return F.coalesce(http_status(error).isin(400, 401, 402, 403), F.lit(False))
