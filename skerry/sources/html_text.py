"""Text of web pages: a chain of extractors, of which the first that passes the gate wins."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.gate import junk_reason
from skerry.plans.shipping import ship

_SKIPPED = {"script", "style", "noscript", "template", "svg"}
_CHROME = {"nav", "header", "footer", "aside", "form", "button"}
_BLOCKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "blockquote", "pre"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Text(HTMLParser):
    def __init__(self, skipped: set[str], only: set[str] | None):
        super().__init__(convert_charrefs=True)
        self.skipped, self.only = skipped, only
        self.out: list[str] = []
        self.hidden: list[str] = []
        self.inside = 0

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self.out.append("\n")
        if tag in _VOID:
            return
        if tag in self.skipped or self.hidden:
            self.hidden.append(tag)
        if self.only and tag in self.only:
            self.inside += 1

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        if self.only and tag in self.only and self.inside:
            self.inside -= 1
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden and (self.only is None or self.inside):
            self.out.append(data)

    def text(self) -> str:
        lines = (" ".join(line.split()) for line in "".join(self.out).split("\n"))
        return "\n".join(line for line in lines if line)


def extract(html: str | None, skipped: set[str], only: set[str] | None) -> str:
    parser = _Text(skipped, only)
    parser.feed(html or "")
    parser.close()
    return parser.text()


#: Extractors in their order: the article element, the page without its chrome, all text.
EXTRACTORS = {
    "article": (_SKIPPED | _CHROME, {"article", "main"}),
    "page": (_SKIPPED | _CHROME, None),
    "all": (_SKIPPED, None),
}


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``body``, ``method`` and ``error``: the reasons of those that failed (SRC11, SRC13)."""
    ship(pages.sparkSession)

    def extractor(name: str):
        settings = EXTRACTORS[name]

        @F.pandas_udf("string")
        def run(pages: pd.Series) -> pd.Series:
            return pages.map(lambda h: extract(h, *settings))

        return run

    texts = pages.withColumns({f"_{name}": extractor(name)(F.col(html)) for name in EXTRACTORS})
    reasons = texts.withColumns({f"_{name}_why": junk_reason(F.col(f"_{name}")) for name in EXTRACTORS})
    body = F.coalesce(*(F.when(F.col(f"_{n}_why").isNull(), F.col(f"_{n}")) for n in EXTRACTORS))
    method = F.coalesce(*(F.when(F.col(f"_{n}_why").isNull(), F.lit(n)) for n in EXTRACTORS))
    error = F.when(body.isNull(), F.concat_ws("; ", *(F.concat(F.lit(f"{n}: "), F.col(f"_{n}_why")) for n in EXTRACTORS)))
    done = reasons.withColumns({"body": body, "method": method, "error": error})
    return done.drop(*(c for c in done.columns if c.startswith("_")))
