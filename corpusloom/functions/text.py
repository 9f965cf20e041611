"""Text cleaning, label strings, prompt fragments and answer parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import templates


def na_to_null(col: Column, na: Sequence[str] = templates.NA_STRINGS) -> Column:
    """Null for every spelling of a missing value, else the value itself."""
    return F.when(~col.isin(list(na)), col)


def norm_quotes(col: Column) -> Column:
    return F.translate(col, '"', "'")


def flatten_newlines(col: Column) -> Column:
    return F.translate(col, "\n", " ")


def meta_field(col: Column, key: str) -> Column:
    """One string field of a JSON object; single-quoted dict literals parse too."""
    parsed = F.from_json(col, f"`{key}` string", {"allowSingleQuotes": "true"})
    return parsed.getField(key)


def select_single_label(
    labels: Column, allowed: Sequence[str], other: str = templates.NOT_RELEVANT
) -> Column:
    """The label string when it is exactly one allowed label, else ``other``."""
    return F.when(labels.isin(list(allowed)), labels).otherwise(F.lit(other))


def category_sentence(names: Sequence[str]) -> str:
    """``a, b or c``."""
    names = list(names)
    return f"{', '.join(names[:-1])} or {names[-1]}"


def instruction(names: Sequence[str], task: str = templates.TASK) -> str:
    """Instruction prefix for the given category names; empty for an empty task."""
    if not task:
        return ""
    return templates.INSTRUCTION.format(task=task.format(categories=category_sentence(names)))


def strip_wordpiece(tokens: Column, length: Column | int | None = None) -> Column:
    """Drop the continuation mark of each token, cut to ``length`` tokens."""
    mark = templates.WORDPIECE_MARK
    clean = F.transform(
        tokens,
        lambda t: F.when(t.startswith(mark), F.substr(t, F.lit(len(mark) + 1))).otherwise(t),
    )
    return clean if length is None else F.slice(clean, 1, length)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def scientific(col: Column) -> Column:
    """Two-digit scientific notation, as used in run names."""
    return F.format_string("%.2e", col)


# -- answers -----------------------------------------------------------------

def parse_suffix(prompt: Column, generated: Column) -> Column:
    """What follows the prompt."""
    return F.substr(generated, F.char_length(prompt) + 1)


def has_category(generated: Column, pattern: str = templates.CATEGORY_PATTERN) -> Column:
    return generated.rlike(pattern)


def parse_category(generated: Column, pattern: str = templates.CATEGORY_PATTERN) -> Column:
    """First text between the category mark and the next newline; null if none."""
    return F.when(has_category(generated, pattern), F.regexp_extract(generated, pattern, 1))


def parse_last_message(messages: Column) -> Column:
    """Content of the last ``struct<role, content>``."""
    return F.try_element_at(messages, F.lit(-1)).getField("content")


def invalid_label(text: Column) -> Column:
    return F.concat(F.lit(templates.INVALID_LABEL), text)


def invalid_match(text: Column) -> Column:
    return F.concat(F.lit(templates.INVALID_MATCH), text)
