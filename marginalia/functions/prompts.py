"""Prompts as column expressions: an instruction, labelled blocks, blank lines between.

Blocks that are null or blank are left out, so an absent memory or profile leaves a prompt
as it was. Instructions are parameters: their wording belongs to the model in use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import numbered_sources

INSTRUCTIONS = {
    "guard": "Decide whether the question may be answered, and if not, why.",
    "planner": "Split the question into at most three questions that sources can answer.",
    "synthesis": "Answer the question from the numbered sources only, and cite each claim.",
    "reformulate": "The question found no sources. Say it in other words.",
    "critic": "Name every claim that the sources do not support.",
    "summary": "Summarise the conversation for its next turn.",
    "judge": "Credit a rubric point only if the answer states it.",
}


def labelled(label: str, body: Column) -> Column:
    """``LABEL:`` and the body below it; null without a body."""
    return F.when(F.length(F.trim(F.coalesce(body, F.lit("")))) > 0, F.concat(F.lit(f"{label}:\n"), body))


def prompt(kind: str, *blocks: Column, instruction: str | None = None) -> Column:
    """A prompt of its blocks (9.24)."""
    return F.concat_ws("\n\n", F.lit(instruction or INSTRUCTIONS[kind]), *blocks)


def synthesis_prompt(question: Column, sources: Column, definitions: Column | None = None, memory: Column | None = None, profile: Column | None = None) -> Column:
    """Sources, then what else is known, then the question (9.23, 9.24): ``sources`` of (path_key, text), ``definitions`` of (term, text)."""
    terms = F.array_join(F.transform(definitions, lambda d: F.concat(F.lit("- "), d["term"], F.lit(": "), d["text"])), "\n") if definitions is not None else F.lit(None)
    blocks = [labelled("SOURCES", numbered_sources(sources)), labelled("DEFINITIONS", terms), memory if memory is not None else F.lit(None), profile if profile is not None else F.lit(None), labelled("QUESTION", question)]
    return prompt("synthesis", *blocks)


def session_context(summary: Column) -> Column:
    """The session's summary as a block, empty without one (9.28)."""
    return F.coalesce(labelled("CONVERSATION SO FAR", summary), F.lit(""))


def profile_context(facts: Column) -> Column:
    """Known facts of (label, value) as a block, empty without any (9.28)."""
    known = F.filter(facts, lambda f: F.length(F.coalesce(f["value"], F.lit(""))) > 0)
    lines = F.array_join(F.transform(known, lambda f: F.concat(F.lit("- "), f["label"], F.lit(": "), f["value"])), "\n")
    return F.coalesce(labelled("OWNER PROFILE", lines), F.lit(""))


def judge_prompt(points: Column, question: Column, answer: Column, instruction: str | None = None) -> Column:
    """Rubric points of (id, text), the question, the answer (9.26)."""
    rubric = F.array_join(F.transform(points, lambda p: F.concat(F.lit("- ["), p["id"], F.lit("] "), p["text"])), "\n")
    return prompt("judge", labelled("RUBRIC POINTS", rubric), labelled("QUESTION", question), labelled("ANSWER", answer), instruction=instruction)


def reference_of(points: Column) -> Column:
    """The reference answer: the points' texts, one a line (9.26)."""
    return F.array_join(F.transform(points, lambda p: p["text"]), "\n")


def send_suffix(whole: Column, prefix: Column) -> Column:
    """What is left to send of a prompt whose beginning is cached (9.25); another beginning is an error."""
    drifted = F.raise_error(F.lit("the prompt does not begin with the cached prefix")).cast("string")
    return F.when(F.startswith(whole, prefix), F.substring(whole, F.length(prefix) + 1, F.length(whole))).otherwise(drifted)
