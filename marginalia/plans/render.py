"""Reports as text: small result tables, collected with a checked bound."""

from __future__ import annotations

from pyspark.sql import DataFrame

MAX_ROWS = 200


def cell(value: object) -> str:
    """Null is an en dash, rates have three places."""
    if value is None:
        return "–"
    if isinstance(value, bool):
        return "yes" if value else "no"
    return f"{value:.3f}" if isinstance(value, float) else str(value)


def markdown_table(rows: DataFrame, order: list[str], title: str = "") -> str:
    """A Markdown table, ordered by ``order``; more than ``MAX_ROWS`` rows is an error."""
    found = rows.orderBy(*order).limit(MAX_ROWS + 1).collect()
    if len(found) > MAX_ROWS:
        raise ValueError(f"a report has at most {MAX_ROWS} rows")
    lines = [f"### {title}", ""] if title else []
    lines += ["| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---" for _ in rows.columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in found)])


def splice(text: str, marker: str, block: str) -> str:
    """``text`` with what stands between a begin and an end mark replaced."""
    begin, end = f"<!-- {marker}:begin -->", f"<!-- {marker}:end -->"
    if begin not in text or end not in text:
        raise ValueError(f"no {marker} marks")
    head, rest = text.split(begin, 1)
    return f"{head}{begin}\n{block}\n{end}{rest.split(end, 1)[1]}"
