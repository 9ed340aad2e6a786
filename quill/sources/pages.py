"""Page extraction as one Spark job.

Each page is parsed once inside a ``mapInPandas`` task (Arrow batches); every
requested field is read from that one tree. The output schema is fixed, so the
rest of the plan stays declarative.
"""
from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html as H


@dataclass(frozen=True)
class Field:
    """What to read from a page.

    kind: ``text`` (P1/P2: stripped text of the first match),
          ``attr`` (P3: attribute of the first match, optionally cut),
          ``paragraphs`` (P4: stripped texts of all matches joined; no
          container → ``""``), ``meta`` (P5: ``content`` of the first match),
          ``meta_all`` (P6: all ``content`` values joined; none → ``""``).

    A selector of several steps looks inside the first match of each step; with
    ``css`` it is a CSS descendant selector, any match of the earlier steps.
    """
    kind: str
    selector: str
    attr: str | None = None
    max_len: int | None = None
    sep: str = "\n"
    css: bool = False

    def __post_init__(self):
        if self.kind not in ("text", "attr", "paragraphs", "meta", "meta_all"):
            raise ValueError(f"unknown kind {self.kind!r}")
        H.chain(self.selector)


def _value(root, f: Field, steps):
    if f.kind in ("paragraphs", "meta_all"):
        nodes = H.select(root, steps) if f.css else H.find_all(root, steps)
        if f.kind == "paragraphs":
            return f.sep.join(n.text().strip() for n in nodes)
        return f.sep.join(n.attrs.get(f.attr or "content", "") for n in nodes)
    n = next(iter(H.select(root, steps)), None) if f.css else H.find(root, steps)
    if n is None:
        return None
    if f.kind == "text":
        return n.text().strip()
    if f.kind == "meta":
        return n.attrs.get(f.attr or "content")
    v = n.attrs.get(f.attr)
    return v[:f.max_len] if v is not None and f.max_len else v


def extract(pages: DataFrame, fields: dict[str, Field], key: str = "page_id",
            html_col: str = "html") -> DataFrame:
    """P7 generalised: ``(key, field…)`` with one parse per page. Selectors are
    compiled here, so a bad one raises before any page is read. A page with
    NULL html (a failed fetch) or one the parser gives up on has NULL in every
    field."""
    names = list(fields)
    specs = [(fields[n], H.chain(fields[n].selector)) for n in names]
    key_type = dict(pages.dtypes)[key]
    schema = ", ".join([f"`{key}` {key_type}"] + [f"`{n}` string" for n in names])

    def run(batches):
        for b in batches:
            out = {key: b[key].tolist()}
            cols = [[] for _ in names]
            for h in b[html_col].tolist():
                try:
                    root = None if h is None else H.parse(h)
                except AssertionError:  # what html.parser raises on markup it cannot follow
                    root = None
                for c, (f, steps) in zip(cols, specs):
                    c.append(None if root is None else _value(root, f, steps))
            for n, c in zip(names, cols):
                out[n] = c
            yield pd.DataFrame(out)

    return pages.select(key, html_col).mapInPandas(run, schema)


# The reference's article selectors.
ARTICLE_FIELDS = {
    "Title": Field("text", "h1.article-main__title"),
    "Subtitle": Field("text", "h2.article-main__description"),
    "Author": Field("text", "div.article-author__name a"),
    "Date": Field("attr", "div.article-dates__detail time", attr="datetime", max_len=10),
    "Content": Field("paragraphs", "div#intext.article-main__content p"),
}
# Second-pass selectors used to back-fill missing values.
BACKFILL_FIELDS = {
    "Title": Field("meta", "meta[name=title]"),
    "Subtitle": Field("text", ".article__summary"),
    "Author": Field("text", ".article-author__name span", css=True),
    "Tags": Field("meta_all", "meta[property=article:tag]", sep=","),
}


def extract_articles(pages: DataFrame, key: str = "page_id", fields=None) -> DataFrame:
    """(title, subtitle, author, date, content) per page in one parse;
    the date is a ``DATE``; a page without the content container gives ``""``."""
    out = extract(pages, fields or ARTICLE_FIELDS, key=key)
    if "Date" in out.columns:
        out = out.withColumn("Date", F.try_to_date(F.col("Date")))
    return out


def extract_text(pages: DataFrame, selector: str, out: str = "text", key: str = "page_id") -> DataFrame:
    """P1/P2."""
    return extract(pages, {out: Field("text", selector)}, key=key)


def extract_attr(pages: DataFrame, selector: str, attr: str, out: str = "value", max_len=None,
                 key: str = "page_id") -> DataFrame:
    """P3."""
    return extract(pages, {out: Field("attr", selector, attr=attr, max_len=max_len)}, key=key)


def extract_paragraphs(pages: DataFrame, selector: str, out: str = "content", key: str = "page_id"):
    """P4."""
    return extract(pages, {out: Field("paragraphs", selector)}, key=key)


def extract_meta(pages: DataFrame, selector: str, out: str = "value", key: str = "page_id"):
    """P5."""
    return extract(pages, {out: Field("meta", selector)}, key=key)


def extract_meta_all(pages: DataFrame, selector: str, out: str = "value", sep: str = ",",
                     key: str = "page_id"):
    """P6."""
    return extract(pages, {out: Field("meta_all", selector, sep=sep)}, key=key)
