"""HTML to rows of document nodes: one table function call a document.

A document is a flat table of nodes in document order: (document_id, pos, depth, kind,
label, path_key, parent_key, text). Parsers need the order and offsets of matches and
carry a cursor from block to block, so they run as Arrow-batched Python, parallel across
documents; everything around them is DataFrame code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import CHROME_PATTERNS, MARKERS, html_text_of, slug_of

NODE_SCHEMA = "document_id string, pos int, depth int, kind string, label string, path_key string, parent_key string, text string"
_CHROME = [re.compile(p, re.I) for p in CHROME_PATTERNS]
_HEAD = re.compile(r"<h([1-6])\b([^>]*)>([\s\S]*?)</h\1>", re.I)
_RUN = re.compile(r"<(p|li)\b[^>]*>([\s\S]*?)</\1>", re.I)
_PARAGRAPH = re.compile(r"<p\b([^>]*)>([\s\S]*?)</p>", re.I)
_TABLE = re.compile(r"<table\b[^>]*>[\s\S]*?</table>", re.I)
_ROW = re.compile(r"<tr\b[^>]*>([\s\S]*?)</tr>", re.I)
_CELL = re.compile(r"<t[dh]\b[^>]*>([\s\S]*?)</t[dh]>", re.I)
_LAYOUT = re.compile(r"\bclass\s*=\s*[\"']TOC(?:id|partCenter)", re.I)
_MARK = {k: re.compile(p) for k, p in MARKERS.items()}
DATA_TABLE = "datatable"


def _attribute(name: str, attributes: str) -> str | None:
    found = re.search(rf"\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", attributes, re.I)
    return None if not found else found[1] if found[1] is not None else found[2]


class _Tree:
    """Nodes under construction; parents are node numbers, -1 is the document."""

    def __init__(self, document_id: str):
        self.document_id = document_id
        self.kind, self.label, self.parent, self.text = [], [], [], []
        self.children: dict[int, list[int]] = {-1: []}

    def add(self, parent: int, kind: str, label: str, text: str = "") -> int:
        n = len(self.kind)
        self.kind.append(kind)
        self.label.append(label)
        self.parent.append(parent)
        self.text.append(text)
        self.children[n] = []
        self.children[parent].append(n)
        return n

    def free_label(self, parent: int, wanted: str) -> str:
        """``wanted``, or with the first free number from 2."""
        taken = {self.label[c] for c in self.children[parent]}
        n, label = 2, wanted
        while label in taken:
            label, n = f"{wanted}-{n}", n + 1
        return label

    def rows(self, title: str) -> list[tuple]:
        """The document, then its nodes from the top, each before its children."""
        out = [(self.document_id, 0, 0, "document", title, self.document_id, None, None)]
        todo = [(c, 1, self.document_id) for c in reversed(self.children[-1])]
        while todo:
            n, depth, above = todo.pop()
            key = f"{above}|{self.kind[n]}:{self.label[n]}"
            out.append((self.document_id, len(out), depth, self.kind[n], self.label[n], key, above, self.text[n] or None))
            todo += [(c, depth + 1, key) for c in reversed(self.children[n])]
        return out


def prose_blocks_of(html: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) of classless headings and text runs of the content, in order (2.3)."""
    region = html
    for tag in ("main", "article", "body"):
        found = re.search(rf"<{tag}\b[^>]*>([\s\S]*?)</{tag}>", html, re.I)
        if found:
            region = found[1]
            break
    for pattern in _CHROME:
        region = pattern.sub(" ", region)
    found = [(m.start(), "heading", int(m[1]), html_text_of(m[3])) for m in _HEAD.finditer(region) if not re.search(r"\bclass\s*=", m[2], re.I)]
    found += [(m.start(), "text", 0, html_text_of(m[2])) for m in _RUN.finditer(region)]
    return [(kind, level, text) for _, kind, level, text in sorted(found, key=lambda b: b[0]) if text]


def parse_prose_of(document_id: str, title: str, html: str) -> list[tuple]:
    """Sections at the shallowest heading level from 2, deeper headings subsections, text clauses (2.11)."""
    blocks = prose_blocks_of(html)
    top = min((level for kind, level, _ in blocks if kind == "heading" and level >= 2), default=2)
    tree, section, subsection = _Tree(document_id), None, None
    for kind, level, text in blocks:
        if kind == "heading" and level < 2:
            continue
        if kind == "heading" and level <= top:
            section, subsection = tree.add(-1, "section", tree.free_label(-1, slug_of(text)), text), None
            continue
        if section is None:  # text before any heading
            section = tree.add(-1, "section", tree.free_label(-1, "preamble"))
        if kind == "heading":
            subsection = tree.add(section, "subsection", tree.free_label(section, slug_of(text)), text)
        else:
            host = section if subsection is None else subsection
            tree.add(host, "clause", tree.free_label(host, f"p-{len(tree.children[host]) + 1}"), text)
    return tree.rows(title)


def blocks_of(html: str) -> list[tuple[str, str, str, str | None]]:
    """(class, inner html, text, anchor) of classed paragraphs and data tables, in order (2.1, 2.2)."""
    tables = [(m.start(), m.end(), m[0]) for m in _TABLE.finditer(html) if not _LAYOUT.search(m[0])]
    found = [(start, DATA_TABLE, whole, "", None) for start, _, whole in tables]
    for m in _PARAGRAPH.finditer(html):
        name = _attribute("class", m[1])
        if name is None or any(start <= m.start() < end for start, end, _ in tables):
            continue
        anchor = re.search(r"<a\b[^>]*\bname\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", m[2], re.I)
        found.append((m.start(), name, m[2], html_text_of(m[2]), (anchor[1] if anchor[1] is not None else anchor[2]) if anchor else None))
    return [b[1:] for b in sorted(found, key=lambda b: b[0])]


def table_rows_of(html: str) -> list[list[str]]:
    """Texts of a table's cells (2.6)."""
    return [[html_text_of(c[1]) for c in _CELL.finditer(r[1])] for r in _ROW.finditer(html)]


def _split(kind: str, text: str) -> tuple[str, str] | None:
    found = _MARK[kind].match(text)
    return (found[1], text[found.end() :].strip()) if found else None


def _coordinate(kind: str, text: str) -> tuple[str, str] | None:
    """(``Schedule 1`` or the bare word, rest)."""
    found = _MARK[kind].match(text.strip())
    if not found:
        return None
    number = found[1].upper() if kind == "table" and found[1] else found[1]
    return kind.capitalize() + (f" {number}" if number else ""), text.strip()[found.end() :].strip()


# Classes of provisions.
ROLES = {
    "clause": ["paragraph", "clause", "Yparagraph", "Yclause", "defparagraph", "defclause", "defsubclause"],
    "subparagraph": ["subpara", "subclause", "subsubpara", "subsubclause", "subsubsubpara", "Ysubpara"],
    "subsection": ["subsection", "Ysubsection"],
    "definition": ["definition", "firstdef", "Sdefinition"],
}
_ROLE_OF = {name: role for role, names in ROLES.items() for name in names} | {n: n for n in ("section", "partnum", "schedule", "headingx", DATA_TABLE)}


class _StatuteReader:
    """Builds the tree of a statute block by block; ``open`` holds the innermost open node of each role."""

    def __init__(self, document_id: str):
        self.tree = _Tree(document_id)
        self.open: dict[str, int] = {}
        self.definitions = self.rows = 0

    def _close(self, *roles: str) -> None:
        for role in roles:
            self.open.pop(role, None)
        if "definition" in roles and "table" in roles:
            self.definitions = self.rows = 0

    def _host(self, *roles: str) -> int | None:
        return next((self.open[r] for r in roles if r in self.open), None)

    def partnum(self, text: str, **_) -> None:
        found = _MARK["part"].match(text.strip())
        if found:
            self._close("section", "subsection", "clause", "definition", "table")
            self.open["part"] = self.tree.add(-1, "part", found[1].upper())

    def schedule(self, text: str, **_) -> None:
        found = _coordinate("schedule", text)
        if found:
            self._close("part", "subsection", "clause", "definition", "table")
            self.open["section"] = self.tree.add(-1, "section", *found)

    def headingx(self, text: str, **_) -> None:
        found = _coordinate("table", text)
        if found and "section" in self.open:
            self._close("clause", "definition")
            self.rows = 0
            self.open["table"] = self.open["subsection"] = self.tree.add(self.open["section"], "subsection", *found)

    def datatable(self, html: str, **_) -> None:
        if "table" not in self.open:
            if "section" not in self.open:
                return
            self.rows = 0
            self.open["table"] = self.open["subsection"] = self.tree.add(self.open["section"], "subsection", "Table")
        host = self.open["table"]
        lines = [[c for c in row] for row in table_rows_of(html) if any(row)]
        for i, row in enumerate(lines):
            whole = " ".join(c for c in row if c)
            if i == 0:
                self.tree.text[host] = f"{self.tree.text[host]} {whole}".strip()
                continue
            self.rows += 1
            found = re.fullmatch(r"([0-9]+(?:\.\d+)*|[ivxlcdm]+)\.?", row[0].strip(), re.I)
            self.tree.add(host, "clause", found[1] if found else f"row-{self.rows}", whole)

    def section(self, text: str, anchor: str | None, **_) -> None:
        found = _split("section", text) if anchor is not None else None
        if not found:
            return
        self._close("subsection", "clause", "definition", "table")
        inline = _split("subsection", found[1])
        self.open["section"] = self.tree.add(self.open.get("part", -1), "section", found[0], "" if inline else found[1])
        if inline:
            self.open["subsection"] = self.tree.add(self.open["section"], "subsection", *inline)

    def subsection(self, text: str, **_) -> None:
        found = _split("subsection", text)
        if found and "section" in self.open:
            self._close("clause", "definition", "table")
            self.open["subsection"] = self.tree.add(self.open["section"], "subsection", *found)

    def clause(self, text: str, **_) -> None:
        found, host = _split("letter_clause", text) or _split("number_clause", text), self._host("definition", "subsection", "section")
        if found and host is not None:
            self.open["clause"] = self.tree.add(host, "clause", *found)

    def subparagraph(self, text: str, **_) -> None:
        found, host = _split("subparagraph", text), self._host("clause", "subsection", "section")
        if found and host is not None:
            self.tree.add(host, "clause", *found)

    def definition(self, text: str, **_) -> None:
        host = self._host("subsection", "section")
        if host is not None:
            self.definitions += 1
            term = _MARK["definition"].match(text.strip())
            self.open["definition"] = self.open["clause"] = self.tree.add(host, "clause", term[1].strip() if term else f"def-{self.definitions}", text)


def parse_statute_of(document_id: str, title: str, html: str) -> list[tuple]:
    """Parts, schedules, sections, subsections, clauses, definitions and table rows (2.9, 2.10)."""
    reader = _StatuteReader(document_id)
    for name, inner, text, anchor in blocks_of(html):
        role = _ROLE_OF.get(re.sub("-e$", "", name))
        if role:
            getattr(reader, role)(text=text, html=inner, anchor=anchor)
    return reader.tree.rows(title)


PARSERS = {"prose": parse_prose_of, "elaws": parse_statute_of}


def parse_documents(sources: DataFrame) -> DataFrame:
    """``sources(document_id, title, family, html)`` -> nodes (2.13); an unknown family is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for r in frame.itertuples(index=False):
                if r.family not in PARSERS:
                    raise ValueError(f"no parser for family {r.family!r}")
                rows += PARSERS[r.family](r.document_id, r.title or "", r.html or "")
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    return sources.select("document_id", "title", "family", "html").mapInPandas(run, NODE_SCHEMA)


def blocks(sources: DataFrame) -> DataFrame:
    """(document_id, pos, class, html, text, anchor) of each document (2.1)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.document_id, i, *b) for r in frame.itertuples(index=False) for i, b in enumerate(blocks_of(r.html or ""))]
            yield pd.DataFrame(rows, columns=["document_id", "pos", "class", "html", "text", "anchor"])

    return sources.select("document_id", "html").mapInPandas(run, "document_id string, pos int, class string, html string, text string, anchor string")


def toc(block_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts (number, name) and sections (number, heading, anchor, part) of lists of contents (2.8, 6.6, 6.7)."""
    w = Window.partitionBy("document_id").orderBy("pos")
    base = block_rows.withColumn("class", F.regexp_replace("class", "-e$", ""))
    title = F.regexp_extract("html", "(?i)\\btitle\\s*=\\s*[\"']([^\"']*)[\"']", 1)
    number = F.when(F.col("class") == "TOCpartCenter", F.nullif(F.trim(F.regexp_extract(F.trim(title), "(?i)^PART\\s+(.+)$", 1)), F.lit("")))
    base = base.withColumn("part_number", number).withColumn("part", F.coalesce(F.last("part_number", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    base = base.withColumn("next_class", F.lead("class").over(w)).withColumn("next_text", F.lead("text").over(w))
    parts = base.where("part_number is not null").select("document_id", "pos", F.col("part_number").alias("number"), F.trim(F.regexp_extract("html", "</span>\\s*([^<]+?)\\s*$", 1)).alias("name"))
    anchor = F.regexp_extract("html", "(?i)\\bhref\\s*=\\s*[\"']#([^\"']*)[\"']", 1)
    sections = base.where("class = 'TOCid'").select(
        "document_id", "pos", F.regexp_replace(F.trim("text"), "\\.$", "").alias("number"), F.when(F.col("next_class") == "table", F.col("next_text")).otherwise("").alias("heading"), anchor.alias("anchor"), "part"
    )
    return parts, sections.where("anchor <> '' and number <> ''")


def chunks(nodes: DataFrame, chunker: str = "citable-unit") -> DataFrame:
    """One chunk for each node with text (11.1-11.3); ``hierarchy`` puts the path in front."""
    texts = nodes.where("length(text) > 0")
    if chunker == "citable-unit":
        body = F.col("text")
    elif chunker == "hierarchy":
        from marginalia.functions.paths import breadcrumb_text, parse_key

        parsed = parse_key(F.col("path_key"))
        body = breadcrumb_text(parsed["document_id"], parsed["segments"], F.col("text"))
    else:
        raise ValueError(f"unknown chunker {chunker!r}")
    return texts.select(F.concat(F.lit(f"{chunker}:"), "path_key").alias("id"), F.col("path_key").alias("citable_path_key"), body.alias("text"), "document_id", F.lit(chunker).alias("chunker"), "pos")


def markdown(nodes: DataFrame) -> DataFrame:
    """A tree as Markdown, one line a node (2.16)."""
    mark = F.when(F.col("kind") == "document", F.lit("#")).when(F.col("kind").isin("part", "section"), F.lit("##")).when(F.col("kind") == "subsection", F.lit("###")).otherwise(F.lit("-"))
    line = F.concat_ws(" ", mark, F.col("label"), F.col("text"))
    return nodes.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda s: s["line"]), "\n").alias("markdown"))
