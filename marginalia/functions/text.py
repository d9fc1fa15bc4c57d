"""Text functions as column expressions: all JVM-side but the last three.

``decode_entities`` and ``slugify`` need one pass over matches and Unicode
decomposition, which no built-in offers: those are Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Named entities that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "ndash": "–", "mdash": "—", "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’", "hellip": "…"}
_ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);")
SPACES = "(?U)[\\s\\uFEFF]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 (9.1)."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def trigrams(text: Column) -> Column:
    """Character trigrams of the tokens joined by spaces; a shorter string is its own (9.2).

    Overlapping grams are matches of a look-ahead, one scan of the string; substrings by
    position would scan it for each gram.
    """
    joined = F.array_join(tokens(text), " ")
    grams = F.regexp_extract_all(joined, F.lit("(?=(...))"), F.lit(1))
    return F.when(F.length(joined) == 0, F.array().cast("array<string>")).when(F.length(joined) < 3, F.array(joined)).otherwise(grams)


def collapse_spaces(text: Column) -> Column:
    """Runs of Unicode white space to one space, ends trimmed (9.5)."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def strip_tags(html: Column) -> Column:
    """Line breaks to spaces, other tags away."""
    return F.regexp_replace(F.regexp_replace(html, "(?i)<br\\s*/?>", " "), "<[^>]*>", "")


def _entity(match: re.Match) -> str:
    body = match[1]
    if body[0] != "#":
        return ENTITIES.get(body, match[0])
    try:
        return chr(int(body[2:], 16) if body[1] in "xX" else int(body[1:]))
    except (ValueError, OverflowError):
        return match[0]


def decode_entities_text(text: str) -> str:
    """Decode decimal, hexadecimal and known named entities, once; others stay (9.4)."""
    return _ENTITY.sub(_entity, text)


def html_text_of(fragment: str) -> str:
    """Text of an HTML fragment, for use inside table functions (9.3)."""
    bare = re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", fragment, flags=re.I))
    return re.sub("[\\s\ufeff]+", " ", decode_entities_text(bare)).strip(" ")


def slug_of(text: str) -> str:
    """Lower-case ASCII letters and digits with hyphens between (9.6)."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not "\u0300" <= c <= "\u036f")
    return re.sub("[^a-z0-9]+", "-", plain).strip("-") or "section"


@F.pandas_udf(StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else decode_entities_text(t))


@F.pandas_udf(StringType())
def slugify(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else slug_of(t))


def html_text(html: Column) -> Column:
    """Text of an HTML fragment (9.3)."""
    return collapse_spaces(decode_entities(strip_tags(html)))


def content_region(html: Column) -> Column:
    """Inside of the first main, article or body element, else everything (2.4)."""
    out = html
    for tag in ("body", "article", "main"):
        pattern = f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>"
        out = F.when(F.regexp_like(html, F.lit(pattern)), F.regexp_extract(html, pattern, 1)).otherwise(out)
    return out


# Elements and class words of page furniture.
CHROME_TAGS = ["script", "style", "nav", "header", "footer", "aside", "form", "svg", "button"]
CHROME_CLASSES = ["footnotes", "toc"]
CHROME_PATTERNS = [p for tag in CHROME_TAGS for p in (f"<{tag}\\b[^>]*>[\\s\\S]*?</{tag}>", f"<{tag}\\b[^>]*/?>")] + [
    f"<{tag}\\b[^>]*\\bclass\\s*=\\s*[\"'][^\"']*\\b{word}\\b[^\"']*[\"'][^>]*>[\\s\\S]*?</{tag}>" for word in CHROME_CLASSES for tag in ("ul", "ol", "section", "div")
]


def strip_chrome(html: Column) -> Column:
    """Page furniture to single spaces (2.5)."""
    for pattern in CHROME_PATTERNS:
        html = F.regexp_replace(html, f"(?i){pattern}", " ")
    return html


def table_cells(html: Column) -> Column:
    """Rows of cells of a table, entities left as they are (2.6)."""
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr\\b[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: collapse_spaces(strip_tags(c))))


def is_layout_table(html: Column) -> Column:
    """Whether a table only lays out a list of contents (2.7)."""
    return html.rlike("(?i)\\bclass\\s*=\\s*[\"']TOC(?:id|partCenter)")


def base_class(name: Column) -> Column:
    """A class without its dialect suffix (9.7)."""
    return F.regexp_replace(name, "-e$", "")


# Patterns of the markers at the head of a provision.
MARKERS = {
    "section": "^\\s*(\\d+(?:\\.\\d+)*)\\.?\\s+",
    "subsection": "^\\(\\s*(\\d+(?:\\.\\d+)*)\\s*\\)\\s*",
    "letter_clause": "(?i)^\\(\\s*([a-z]+(?:\\.\\d+)?)\\s*\\)\\s*",
    "number_clause": "^(\\d+(?:\\.\\d+)*)\\.\\s+",
    "subparagraph": "(?i)^\\(?\\s*([ivxlcdm]+)\\s*[).]\\s*",
    "schedule": "^[Ss]chedule(?:\\s+(\\d+(?:\\.\\d+)?|[A-Z]))?(?=\\s|$)",
    "table": "^[Tt]able\\b(?:\\s+(\\d+(?:\\.\\d+)?|[A-Z])(?=\\s|$))?",
    "definition": "^“([^”]+)”",
    "part": "(?i)^part\\s+([ivxlcdm]+(?:\\.\\d+)?)\\b",
}


def head_marker(text: Column, kind: str) -> Column:
    """(label, rest) of the marker at the head, null without one (9.8-9.11)."""
    pattern = MARKERS[kind]
    found = F.struct(F.regexp_extract(text, pattern, 1).alias("label"), F.trim(F.regexp_replace(text, pattern, "")).alias("rest"))
    return F.when(F.regexp_like(text, F.lit(pattern)), found)


def clause_marker(text: Column) -> Column:
    """A lettered clause, else a numbered one (9.10)."""
    return F.coalesce(head_marker(text, "letter_clause"), head_marker(text, "number_clause"))


def definition_term(text: Column) -> Column:
    """The quoted term that opens a definition (9.12)."""
    return F.nullif(F.trim(F.regexp_extract(F.trim(text), MARKERS["definition"], 1)), F.lit(""))


def coordinate_label(text: Column, kind: str) -> Column:
    """``Schedule 1``, ``Table A`` or the bare word (9.13, 9.14)."""
    found = F.upper(F.regexp_extract(F.trim(text), MARKERS[kind], 1))
    word = kind.capitalize()
    return F.when(F.regexp_like(F.trim(text), F.lit(MARKERS[kind])), F.when(found == "", F.lit(word)).otherwise(F.concat(F.lit(word + " "), found)))


def coordinate_rest(text: Column, kind: str) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), MARKERS[kind], ""))


def part_number(text: Column) -> Column:
    """``part v.1`` -> ``V.1`` (9.15)."""
    return F.nullif(F.upper(F.regexp_extract(F.trim(text), MARKERS["part"], 1)), F.lit(""))


def section_number(text: Column) -> Column:
    """Trimmed, without one trailing dot (9.16)."""
    return F.regexp_replace(F.trim(text), "\\.$", "")


def strip_code_fence(text: Column) -> Column:
    """Inside of a fenced block, else the trimmed text (9.22)."""
    pattern = "(?s)^```(?:json)?\\s*(.*?)\\s*```$"
    return F.when(F.regexp_like(F.trim(text), F.lit(pattern)), F.regexp_extract(F.trim(text), pattern, 1)).otherwise(F.trim(text))


def cap_summary(text: Column, limit: int = 2000) -> Column:
    """At most ``limit`` characters, cut at the last space if that lies past the half (9.27)."""
    cut = F.substring(text, 1, limit)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    at_space = (F.instr(cut, " ") > 0) & (last > limit * 0.5)
    return F.when(F.length(text) <= limit, text).when(at_space, F.substring(cut, F.lit(1), last.cast("int"))).otherwise(cut)


def embeddable_text(text: Column, context: Column, on: bool) -> Column:
    """Context, a blank line and the text, if the flag is on and the context not blank (9.21)."""
    return F.when(F.lit(on) & (F.length(F.trim(F.coalesce(context, F.lit("")))) > 0), F.concat(context, F.lit("\n\n"), text)).otherwise(text)


def redact(text: Column, secrets: list[str], limit: int = 200) -> Column:
    """Known secrets out, then at most ``limit`` characters (9.30)."""
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit("[redacted]"))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def traceparent(trace_id: Column, span_id: Column) -> Column:
    return F.format_string("00-%s-%s-01", trace_id, span_id)


def traceparent_ids(header: Column) -> Column:
    """(trace_id, span_id) of a header, null if malformed (9.29)."""
    pattern = "^[0-9a-f]{2}-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}$"
    return F.when(F.regexp_like(header, F.lit(pattern)), F.struct(F.regexp_extract(header, pattern, 1).alias("trace_id"), F.regexp_extract(header, pattern, 2).alias("span_id")))


def numbered_sources(sources: Column) -> Column:
    """Prompt block of an array of (path_key, text): numbered, blank lines between (9.23)."""
    lines = F.transform(sources, lambda s, i: F.format_string("[%d] %s\n%s", i + 1, s["path_key"], s["text"]))
    return F.when(F.size(sources) == 0, F.lit("(no sources retrieved)")).otherwise(F.array_join(lines, "\n\n"))


def sse_frame(kind: Column, body: Column) -> Column:
    """One server-sent event (1.33)."""
    return F.format_string("event: %s\ndata: %s\n\n", kind, body)
