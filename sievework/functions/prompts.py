"""Training-line format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.config import PromptFormat
from sievework.functions.text import SPACE_CHARS


def _strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARS))


def format_prompt(context: Column, fmt: PromptFormat = PromptFormat()) -> Column:
    """Context marker, context, body marker and a trailing blank."""
    return F.concat(
        F.lit(f"{fmt.context_token} "),
        F.lower(_strip(context)),
        F.lit(f" {fmt.body_token} "),
    )


def format_example(context: Column, body: Column, fmt: PromptFormat = PromptFormat()) -> Column:
    """A whole training line: prompt, body, end marker."""
    return F.concat(format_prompt(context, fmt), _strip(body), F.lit(fmt.end_token))


def score_to_int(score: Column) -> Column:
    return F.when(~F.isnan(score.cast("double")), score.cast("long"))
