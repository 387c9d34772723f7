"""Rows out of HTML tables and lists: a small selector matcher on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_STEP = re.compile(r"""([\w-]+|\*)|\.([\w-]+)|\#([\w-]+)|:nth-child\((\d+)\)|\[([\w-]+)([$*^]?=)?['"]?([^'"\]]*)['"]?\]""")
# Opening one of these ends an open element of the listed kinds.
_ENDS = {
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "li": {"li"}, "p": {"p"},
    "tbody": {"thead", "tr", "td", "th"}, "option": {"option"},
}
_SCOPES = {"table", "ul", "ol", "article", "div", "body"}


class Node:
    """Element with its parent, position among siblings, attributes and content."""

    __slots__ = ("tag", "attrs", "parent", "children", "nth", "elements")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.elements = 0
        self.nth = 1
        if parent is not None:
            parent.elements += 1
            self.nth = parent.elements
            parent.children.append(self)

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            elif item.tag not in ("script", "style"):
                stack.extend(reversed(item.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("#", {}, None)

    def handle_starttag(self, tag, attrs):
        ends = _ENDS.get(tag, ())
        while self.top.tag in ends and self.top.tag not in _SCOPES:
            self.top = self.top.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.top)
        if tag not in _VOID:
            self.top = node

    def handle_startendtag(self, tag, attrs):
        Node(tag, {k: v or "" for k, v in attrs}, self.top)

    def handle_endtag(self, tag):
        node = self.top
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.top = node.parent

    def handle_data(self, data):
        self.top.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _matches(node: Node, simple: str) -> bool:
    for tag, css, ident, nth, attr, op, value in _STEP.findall(simple):
        have = node.attrs.get(attr, None) if attr else None
        if (
            (tag and tag not in ("*", node.tag))
            or (css and css not in node.attrs.get("class", "").split())
            or (ident and node.attrs.get("id") != ident)
            or (nth and node.nth != int(nth))
            or (attr and have is None)
            or (op == "=" and have != value)
            or (op == "$=" and not have.endswith(value))
            or (op == "*=" and value not in have)
            or (op == "^=" and not have.startswith(value))
        ):
            return False
    return True


def select(root: Node, selector: str) -> Iterator[Node]:
    """Descendants matching a comma list of descendant chains, in document order."""
    chains = [part.split() for part in selector.split(",")]
    for node in root.walk():
        if any(_chain(node, chain, root) for chain in chains):
            yield node


def _chain(node: Node, chain: list[str], root: Node) -> bool:
    if not _matches(node, chain[-1]):
        return False
    above, steps = node.parent, list(chain[:-1])
    while steps and above is not None and above is not root:
        if _matches(above, steps[-1]):
            steps.pop()
        above = above.parent
    return not steps


def rows_of(html: str | None, schema: dict) -> list[dict[str, str]]:
    """One dict per base element; fields without a match are left out."""
    if not html:
        return []
    out = []
    for base in select(parse(html), schema["base"]):
        row = {}
        for name, (selector, attribute) in schema["fields"].items():
            node = next(select(base, selector), None)
            value = None if node is None else (node.text().strip() if attribute is None else node.attrs.get(attribute))
            if value is not None:
                row[name] = value
        if row:
            out.append(row)
    return out


def scan_rows(pages: DataFrame, schema: dict, html: str = "html") -> DataFrame:
    """One row per base element with a string column per field, page columns kept.

    ``row_no`` counts the rows of a page from 0.
    """

    @F.pandas_udf("array<map<string,string>>")
    def extract(column: pd.Series) -> pd.Series:
        return column.map(lambda page: rows_of(page, schema))

    keep = [name for name in pages.columns if name != html]
    rows = pages.select(*keep, F.posexplode(extract(F.col(html))).alias("row_no", "__row"))
    return rows.select(*keep, "row_no", *(F.col("__row")[f].alias(f) for f in schema["fields"]))


def _cells(*names: str) -> dict[str, tuple[str, str | None]]:
    return {n: (f"td:nth-child({i})", None) for i, n in enumerate(names, 1) if n}


# Where each site's listing keeps its fields.
_TITLE = "h2 a, h2.entry-title a, .entry-title a"
SCHEMAS = {
    "SC": {
        "base": "article.post, article.type-post, .post",
        "fields": {
            "title": (_TITLE, None),
            "post_url": (_TITLE, "href"),
            "date": ("time, .entry-date, .posted-on time", None),
            "date_attr": ("time, .entry-date time", "datetime"),
            "summary": (".entry-content, .entry-summary, .excerpt", None),
            "pdf_url": (".entry-content a[href$='.pdf'], .entry-summary a[href$='.pdf']", "href"),
        },
    },
    "LHC": {
        "base": "table tbody tr",
        "fields": {
            **_cells("serial", "case_number", "case_title", "judge_name", "lhc_citation", "other_citation",
                     "category", "decision_date"),
            "pdf_url": ("td:nth-child(9) a", "href"),
        },
    },
    "SHC": {
        "base": ".hasDataTable tbody tr",
        "fields": {
            **_cells("serial", "citation", "case_number", "case_type", "case_year", "parties", "order_date",
                     "afr", "head_notes", "bench", "apex_court", "apex_status"),
            "pdf_url": ("td:nth-child(3) a", "href"),
        },
    },
    "SHC_JUDGES": {
        "base": "table tbody tr",
        "fields": {
            **_cells("serial", "judge_name", "total", "afr"),
            "total_url": ("td:nth-child(3) a", "href"),
            "afr_url": ("td:nth-child(4) a", "href"),
        },
    },
    "PHC": {
        "base": "#employee_list tbody tr",
        "fields": {
            **_cells("serial", "case", "remarks", "other_citation", "neutral_citation", "decision_date",
                     "sc_status", "category"),
            "pdf_url": ("td:nth-child(9) a", "href"),
            "sc_pdf_url": ("td:nth-child(10) a", "href"),
        },
    },
    "FSC_LEADING": {
        "base": "table tbody tr",
        "fields": {**_cells("serial", "title"), "pdf_url": ("td:nth-child(3) a, td:nth-child(2) a", "href")},
    },
    "FSC_SEARCH": {
        "base": "table tbody tr",
        "fields": {
            **_cells("serial", "case_number", "title", "decision_date"),
            "pdf_url": ("td a[href*='.pdf'], td a[href*='Judgment']", "href"),
        },
    },
    "COMMONLII": {"base": "li.make-database", "fields": {"url": ("a", "href"), "title": ("a", None)}},
}
