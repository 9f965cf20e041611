"""Prompts: one Column per prompt style, built from the query text and its examples.

``examples`` is the ordered ``array<struct<.., example, label_text>>`` of a query, or
null when no examples are given.  Example texts are flattened to one line; the query
text is kept as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import templates as t
from corpusloom.functions.text import flatten_newlines

PromptBuilder = Callable[[Column, Sequence[str], Column], Column]


def _label_list(labels: Sequence[str]) -> str:
    return "\n".join(labels)


def _joined(examples: Column, line: Callable[[Column, Column, Column], Column]) -> Column:
    """All examples as one string; ``line`` gets text, label and position."""
    lines = F.transform(
        examples, lambda e, i: line(flatten_newlines(e["example"]), e["label_text"], i)
    )
    return F.array_join(lines, "")


def _has(examples: Column) -> Column:
    return examples.isNotNull() & (F.size(examples) > 0)


def prompt_inst(query: Column, labels: Sequence[str], examples: Column) -> Column:
    """``[INST]`` style: the first example continues the open block of the header."""
    header = "<s>[INST]" + t.ROLE_INST + t.TASK_CATEGORIES + _label_list(labels) + t.RULES
    shots = _joined(
        examples,
        lambda text, label, i: F.concat(
            F.when(i == 0, "").otherwise("[INST]"),
            F.lit("\n" + t.CATEGORIZE), text, F.lit("\n[/INST]"), label, F.lit("</s>"),
        ),
    )
    return F.concat(
        F.lit(header),
        F.when(_has(examples), shots).otherwise("[/INST]"),
        F.lit("[INST]\n" + t.CATEGORIZE), query, F.lit("\n[/INST]"),
    )


def prompt_im(query: Column, labels: Sequence[str], examples: Column) -> Column:
    """``<|im_start|>`` style with question and answer turns."""
    header = "<|im_start|> system\n" + t.ROLE + t.TASK_CATEGORIES + _label_list(labels) + t.RULES + "<|im_end|>"
    question = "\n<|im_start|> question\n" + t.CATEGORIZE
    answer = "\n<|im_end|>\n<|im_start|> answer\n"
    shots = _joined(
        examples,
        lambda text, label, i: F.concat(F.lit(question), text, F.lit(answer), label, F.lit("<|im_end|>")),
    )
    return F.concat(
        F.lit(header), F.when(_has(examples), shots).otherwise(""), F.lit(question), query, F.lit(answer)
    )


def prompt_inquiry(query: Column, labels: Sequence[str], examples: Column, lang: str = "en") -> Column:
    """Inquiry and category lines, the query inside ``<<< >>>``; English or Danish."""
    if lang == "da":
        header, rules, opening = t.ROLE_DA, t.RULES_DA, t.EXAMPLES_DA
        inquiry, category = "Forespørgsel: ", "\nKategori: "
    else:
        header, rules, opening = t.ROLE + t.TASK_INQUIRY, t.RULES, t.EXAMPLES
        inquiry, category = "Inquiry: ", "\nCategory: "
    shots = _joined(
        examples,
        lambda text, label, i: F.concat(F.lit(inquiry), text, F.lit(category), label, F.lit("\n")),
    )
    block = F.concat(F.lit(opening), shots, F.lit("###\n\n"))
    return F.concat(
        F.lit(header + _label_list(labels) + rules),
        F.when(_has(examples), block).otherwise(""),
        F.lit("<<<\n" + inquiry), query, F.lit("\n>>>"),
    )


def prompt_inquiry_da(query: Column, labels: Sequence[str], examples: Column) -> Column:
    return prompt_inquiry(query, labels, examples, "da")


def prompt_messages(query: Column, labels: Sequence[str], examples: Column) -> Column:
    """Chat messages: system, then user and assistant per example, then the query."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    system = message("system", F.lit(t.ROLE + t.TASK_CATEGORIES + _label_list(labels) + t.RULES))
    turns = F.flatten(
        F.transform(
            examples,
            lambda e: F.array(
                message("user", F.concat(F.lit(t.CATEGORIZE), flatten_newlines(e["example"]))),
                message("assistant", e["label_text"]),
            ),
        )
    )
    none = F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(
        F.array(system),
        F.coalesce(turns, none),
        F.array(message("user", F.concat(F.lit(t.CATEGORIZE), query))),
    )


def render_messages(messages: Column) -> Column:
    """Messages as one string, for scorers that take plain prompts."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"
    )
