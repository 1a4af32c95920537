"""HTML as Markdown-shaped text: headings, lists, definition lists and tables keep their form."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements of HTML whose content is dropped, that are boilerplate, and that start a line.
_DROP = frozenset("script style noscript template".split())
_BOILERPLATE = frozenset("nav footer".split())
_LINES = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p "
                   "pre section table tbody tfoot thead title tr ul".split())


class _Reader(HTMLParser):
    """Collects lines; a table is written when it ends."""

    def __init__(self, strip_boilerplate: bool):
        super().__init__(convert_charrefs=True)
        self.dropped = _DROP | (_BOILERPLATE if strip_boilerplate else frozenset())
        self.lines: list[str] = []
        self.now: list[str] = []
        self.prefix = ""
        self.skip: list[str] = []
        self.in_title = False
        self.title: str | None = None
        self.h1: str | None = None
        self.heading: int | None = None
        self.table: list[list[tuple[str, str]]] | None = None
        self.cell: list[str] | None = None
        self.term: str | None = None
        self.structured = False

    def flush(self) -> None:
        text = " ".join("".join(self.now).split())
        self.now.clear()
        if text and self.in_title:
            self.title = self.title or text
        elif text:
            if self.heading == 1 and self.h1 is None:
                self.h1 = text
            self.lines.append(self.prefix + text)
        self.prefix = ""

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.skip or tag in self.dropped:
            if tag in self.dropped:
                self.skip.append(tag)
            return
        if self.table is not None and tag in ("tr", "td", "th"):
            if tag == "tr":
                self.table.append([])
            else:
                self.cell = []
                if not self.table:
                    self.table.append([])
                self.table[-1].append((tag, ""))
            return
        if self.cell is not None:
            if tag in _LINES:
                self.cell.append(" ")
            return
        if tag in _LINES:
            self.flush()
        if tag == "title":
            self.in_title = True
        elif tag == "table":
            self.table, self.structured = [], True
        elif tag == "li":
            self.prefix = "- "
        elif tag in ("dt", "dd"):
            self.structured = True
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.heading = int(tag[1])
            self.prefix = "#" * self.heading + " "

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if self.table is not None:
            if tag in ("td", "th") and self.cell is not None and self.table and self.table[-1]:
                self.table[-1][-1] = (self.table[-1][-1][0], " ".join("".join(self.cell).split()))
                self.cell = None
            elif tag == "table":
                self.write_table()
            return
        if tag in _LINES:
            if tag == "dt":
                self.term, _ = " ".join("".join(self.now).split()), self.now.clear()
                return
            if tag == "dd" and self.term:
                self.prefix, self.term = f"{self.term}: ", None
            self.flush()
            self.heading = None
            self.in_title = False if tag == "title" else self.in_title

    def write_table(self) -> None:
        rows = [r for r in self.table or [] if r]
        self.table = self.cell = None
        if rows and all(len(r) == 2 and r[0][0] == "th" and r[1][0] == "td" for r in rows):
            self.lines.extend(f"{r[0][1]}: {r[1][1]}" for r in rows)
        elif rows:
            width = max(map(len, rows))
            body = ["| " + " | ".join([c.replace("|", "\\|") for _, c in r] + [""] * (width - len(r))) + " |" for r in rows]
            self.lines.extend([body[0], "|" + " --- |" * width, *body[1:]])

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.cell if self.cell is not None else self.now).append(data)


def html_text(page: str | None, strip_boilerplate: bool = False) -> tuple[str, str | None, str]:
    """Text, title (or the first h1) and modality: semi_structured if there is a table or definition list."""
    r = _Reader(strip_boilerplate)
    r.feed(page or "")
    r.close()
    r.flush()
    if r.table is not None:
        r.write_table()
    return "\n".join(r.lines), r.title or r.h1, "semi_structured" if r.structured else "unstructured"


def html_documents(pages: DataFrame, strip_boilerplate: bool = False) -> DataFrame:
    """pages (doc_id, uri, html) -> doc_id, uri, text, title, modality."""

    def run(batches):
        for b in batches:
            got = [html_text(h, strip_boilerplate) for h in b["html"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "uri": b["uri"], "text": [g[0] for g in got], "title": [g[1] for g in got],
                "modality": [g[2] for g in got]})

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "uri", "html").mapInPandas(run, f"doc_id {kind}, uri string, text string, title string, modality string")
