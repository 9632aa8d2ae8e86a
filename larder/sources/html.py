"""Records of item pages: links, headings, structured data and labelled values, by the standard parser in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

_SKIPPED, _HEADINGS = {"script", "style", "noscript"}, {"h1", "h2", "h3", "h4"}


class Page(HTMLParser):
    """What an item page holds: headings, anchors, text pieces, meta values and linked data."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.headings: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.texts: list[str] = []
        self.under: list[tuple[str, str]] = []
        self.meta: dict[str, str] = {}
        self.linked: list[dict] = []
        self._open: list[str] = []
        self._link: list | None = None
        self._data = ""
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "a" and a.get("href"):
            self._link = [a["href"], ""]
        elif tag == "meta":
            key = (a.get("property") or a.get("name") or "").lower()
            if key and a.get("content"):
                self.meta.setdefault(key, a["content"].strip())
        elif tag == "img" and self._link is not None and not self._link[1]:
            self._link[1] = a.get("alt", "")
        if tag in _SKIPPED or tag in _HEADINGS:
            self._open.append("ld" if tag == "script" and a.get("type", "").lower() == "application/ld+json" else tag)
            self._data = ""

    def handle_endtag(self, tag):
        if tag == "a" and self._link is not None:
            self.links.append((self._link[0], " ".join(self._link[1].split())))
            self._link = None
        if self._open and (self._open[-1] == tag or (tag == "script" and self._open[-1] == "ld")):
            kind, text = self._open.pop(), " ".join(self._data.split())
            if kind in _HEADINGS and text:
                self.headings.append(text)
            elif kind == "ld":
                self._collect(self._data)

    def handle_data(self, data):
        if self._open:
            self._data += data
        if not (self._open and self._open[-1] in (*_SKIPPED, "ld")) and data.strip():
            self.texts.append(" ".join(data.split()))
            if not (self._open and self._open[-1] in _HEADINGS):
                self.under.append((self.headings[-1] if self.headings else "", self.texts[-1]))
            if self._link is not None:
                self._link[1] += " " + data

    def _collect(self, text: str) -> None:
        try:
            values = [json.loads(text)]
        except ValueError:
            return
        while values:
            v = values.pop(0)
            if isinstance(v, list):
                values = v + values
            elif isinstance(v, dict):
                self.linked.append(v)
                values = (v["@graph"] if isinstance(v.get("@graph"), list) else []) + values

    def product(self) -> dict:
        """The first linked-data node of type Product."""
        for v in self.linked:
            kinds = v.get("@type")
            if "Product" in (kinds if isinstance(kinds, list) else [kinds]):
                return v
        return {}

    def section(self, heading: str, most: int = 1500) -> str | None:
        """The text between a heading and the next one, up to ``most`` letters."""
        wanted = " ".join(heading.lower().replace("ё", "е").split())
        found = " ".join(t for h, t in self.under if h.lower().replace("ё", "е") == wanted and t != h)
        return found[:most] or None

    def labelled(self, *labels: str) -> str | None:
        """The text after a label, in the same piece or the next."""
        wanted = [x.lower() for x in labels]
        for text, following in zip(self.texts, [*self.texts[1:], ""], strict=False):
            for label in wanted:
                low = text.lower()
                if low.rstrip(": ") == label and following:
                    return following[:160]
                if low.startswith(label + ":"):
                    return text[len(label) + 1 :].strip()[:160] or None
        return None


def _text(value) -> str | None:
    if isinstance(value, dict):
        value = value.get("name") or value.get("url") or value.get("@value")
    if isinstance(value, list):
        value = next((x for x in map(_text, value) if x), None)
    return str(value).strip() or None if value is not None else None


def read_page(html: str | None, url: str | None) -> dict:
    """The record of a page: name, brand, code, category, image and description, each from linked data, meta or labels."""
    p = Page(html or "")
    node = p.product()
    image = _text(node.get("image")) or p.meta.get("og:image") or p.meta.get("twitter:image")
    code = next((c for c in (_text(node.get(k)) for k in ("gtin13", "gtin12", "gtin14", "gtin8", "gtin")) if c), None) or p.labelled("штрихкод", "barcode", "ean", "gtin")
    return {
        "name": _text(node.get("name")) or (p.headings[0] if p.headings else None) or p.meta.get("og:title"), "brand": _text(node.get("brand")) or p.labelled("бренд", "торговая марка", "марка", "brand"), "barcode": code,
        "category": _text(node.get("category")) or p.labelled("категория", "тип товара", "тип", "category"), "image_url": urljoin(url or "", image) if image else None, "description": _text(node.get("description")) or p.section("описание") or p.meta.get("description"),
        "links": [{"url": urljoin(url or "", h), "text": t} for h, t in p.links],
    }


def extract_pages(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """One record per page; broken or null markup gives a record of nulls and no links."""
    kind = dict(pages.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            records = [read_page(h, u) for h, u in zip(f["_html"], f["_url"], strict=True)]
            out = pd.DataFrame(records, columns=["name", "brand", "barcode", "category", "image_url", "description", "links"])
            out.insert(0, key, f[key].to_numpy())
            yield out

    schema = f"`{key}` {kind}, name string, brand string, barcode string, category string, image_url string, description string, links array<struct<url:string,text:string>>"
    return pages.selectExpr(f"`{key}`", f"`{url}` as _url", f"`{html}` as _html").mapInPandas(run, schema)
