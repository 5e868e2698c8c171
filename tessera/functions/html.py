"""Places out of web pages: one page gives many records. Extractors are tried in turn; the first that finds any wins."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("name", "address", "city", "postal", "country", "phone", "lat", "lon")
Record = dict[str, Any]
_ALIASES = {
    "name": ("name", "storeName", "title", "store_name"), "address": ("address", "address1", "street", "streetAddress", "line1"), "city": ("city", "town", "addressLocality"),
    "postal": ("postalCode", "zip", "postcode", "postal_code"), "country": ("country", "countryCode", "addressCountry"), "phone": ("phone", "telephone", "phoneNumber"),
    "lat": ("latitude", "lat"), "lon": ("longitude", "lng", "lon", "long"),
}


def plain(text: str) -> str:
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", text))).strip()


def place(data: Record) -> Record:
    """Known fields of a record, by their usual names; GeoJSON coordinates are longitude first."""
    low = {str(k).lower(): v for k, v in data.items()}
    out = {f: next((low[a.lower()] for a in names if low.get(a.lower()) not in (None, "")), None) for f, names in _ALIASES.items()}
    points = low.get("coordinates")
    if out["lat"] is None and isinstance(points, list) and len(points) == 2:
        out["lon"], out["lat"] = points
    return {k: None if v is None else plain(str(v)) for k, v in out.items()}


def looks_like_place(data: Any) -> bool:
    if not isinstance(data, dict):
        return False
    found = place(data)
    return bool(found["name"]) and bool(found["lat"] or found["address"] or found["city"])


def place_arrays(data: Any, depth: int = 5) -> Iterator[list[Record]]:
    """Lists of records that look like places, anywhere up to a depth."""
    if isinstance(data, list):
        mine = [x for x in data if looks_like_place(x)]
        if mine:
            yield mine
    if depth:
        for x in data.values() if isinstance(data, dict) else data if isinstance(data, list) else ():
            yield from place_arrays(x, depth - 1)


def _largest(found: list[list[Record]]) -> list[Record]:
    return [place(x) for x in max(found, key=len, default=[])]


def _loads(text: str) -> Any:
    try:
        return json.loads(html.unescape(text))
    except ValueError:
        return None


class _Cards(HTMLParser):
    """Headings with the paragraphs and map links that follow, and elements with coordinates."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cards: list[Record] = []
        self.pins: list[Record] = []
        self.attributes: list[str] = []
        self.blocks: list[Record] = []
        self._label: str | None = None
        self._said = ""
        self._open: str | None = None
        self._text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if "data-locations" in a:
            self.attributes.append(a["data-locations"])
        classes = a.get("class", "").split()
        if "data-latlng" in a and "sm-block" in classes:
            self.blocks.append({"point": a["data-latlng"], "id": a.get("id", "")})
        if self.blocks and tag == "label":
            self._label, self._said = "", ""
        if tag == "a" and self._label is not None and a.get("href", "").startswith("mailto:"):
            self.blocks[-1].setdefault("email", a["href"][7:])
        if "data-lat" in a and ("data-lng" in a or "data-lon" in a):
            self.pins.append({"name": a.get("data-name") or a.get("title"), "lat": a["data-lat"], "lon": a.get("data-lng") or a.get("data-lon"), "address": a.get("data-address")})
        link = re.search(r"[@?&=](-?\d{1,2}\.\d+),(-?\d{1,3}\.\d+)", a.get("href", "")) if tag == "a" else None
        if link and self.cards:
            self.cards[-1]["lat"], self.cards[-1]["lon"] = link.groups()
        if tag == "a" and a.get("href", "").startswith("tel:") and self.cards:
            self.cards[-1]["phone"] = a["href"][4:]
        if tag in ("h2", "h3", "h4", "p"):
            self._open, self._text = tag, []

    def handle_data(self, data: str) -> None:
        if self._label is not None:
            self._said += data
        if self._open:
            self._text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "label" and self._label is not None:
            kind, _, rest = self._said.strip().partition(" ")
            if kind.lower().rstrip(".:") == "tel":
                self.blocks[-1].setdefault("phone", rest.strip())
            self._label = None
        if tag == self._open:
            if self.blocks and self._text:
                self.blocks[-1].setdefault("address" if tag == "p" else "name", re.sub(r"\s+", " ", "".join(self._text)).strip())
            text = re.sub(r"\s+", " ", "".join(self._text)).strip()
            if tag != "p" and text:
                self.cards.append({"name": text, "lines": []})
            elif text and self.cards:
                self.cards[-1]["lines"].append(text)
            self._open = None


@lru_cache(maxsize=1)
def _parsed(page: str) -> _Cards:
    """A page is parsed once for all extractors."""
    p = _Cards()
    p.feed(page)
    return p


def block_pins(page: str) -> list[Record]:
    """Blocks of class ``sm-block`` with a ``data-latlng``: heading, first paragraph and labelled telephone within."""
    out = []
    for b in _parsed(page).blocks:
        m = re.fullmatch(r"\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*", b["point"])
        if m and b.get("name"):
            out.append({**dict.fromkeys(FIELDS), "name": b["name"], "address": b.get("address"), "phone": b.get("phone"), "lat": m[1], "lon": m[2]})
    return out


def json_attributes(page: str) -> list[Record]:
    """Pins in a ``data-locations`` attribute; of equal handles the last counts."""
    found = [x for text in _parsed(page).attributes for xs in place_arrays(_loads(text)) for x in xs]
    return [place(x) for x in {str(x.get("handle", n)): x for n, x in enumerate(found)}.values()]


def json_scripts(page: str) -> list[Record]:
    """The largest list of places in JSON scripts, assigned variables and inline objects."""
    texts = re.findall(r"(?is)<script[^>]*application/(?:ld\+)?json[^>]*>(.*?)</script>", page)
    texts += re.findall(r"(?s)\b(?:var|let|const)\s+\w+\s*=\s*(\{.*?\}|\[.*?\])\s*;\s*(?:\n|</script>)", page)
    return _largest([xs for t in texts for xs in place_arrays(_loads(t))])


def inline_pairs(page: str) -> list[Record]:
    """``"name": ... "latitude": ...`` within a page's scripts; other fields are looked for nearby."""
    out = []
    for m in re.finditer(r'"name"\s*:\s*"([^"]+)"[^{}]{0,400}?"lat(?:itude)?"\s*:\s*"?(-?\d+\.\d+)"?[^{}]{0,100}?"(?:lng|lon|longitude)"\s*:\s*"?(-?\d+\.\d+)', page):
        near = page[max(0, m.start() - 500) : m.end() + 500]
        extra = {k: v for k, v in re.findall(r'"(city|address|phone|country|postalCode)"\s*:\s*"([^"]*)"', near)}
        out.append(place({**extra, "name": m[1], "lat": m[2], "lng": m[3]}))
    return out


def coordinate_elements(page: str) -> list[Record]:
    """Elements with ``data-lat`` and ``data-lng``; cards of the same name add their lines."""
    p = _parsed(page)
    cards = {c["name"].lower(): c for c in p.cards}
    out = []
    for pin in p.pins:
        card = cards.get((pin["name"] or "").lower(), {})
        out.append({**dict.fromkeys(FIELDS), **pin, "address": pin["address"] or ", ".join(card.get("lines", [])) or None, "phone": card.get("phone")})
    return [r for r in out if r["name"]]


def cards(page: str) -> list[Record]:
    """Headings followed by address lines; a page needs two of them."""
    seen: dict[tuple, Record] = {}
    for c in _parsed(page).cards:
        if c["lines"] and (c.get("lat") or any(re.search(r"\d", line) for line in c["lines"])):
            r = {**dict.fromkeys(FIELDS), "name": c["name"], "address": ", ".join(c["lines"]), "lat": c.get("lat"), "lon": c.get("lon"), "phone": c.get("phone")}
            seen.setdefault((r["name"], r["address"]), r)
    return list(seen.values()) if len(seen) > 1 else []


EXTRACTORS: dict[str, Callable[[str], list[Record]]] = {"json_attributes": json_attributes, "block_pins": block_pins, "inline_pairs": inline_pairs, "json_scripts": json_scripts, "coordinate_elements": coordinate_elements, "cards": cards}


def completeness(rows: list[Record]) -> float:
    return sum(bool(r.get(f)) for r in rows for f in FIELDS) / max(1, len(FIELDS) * len(rows))


def extracted(page: str, best: bool = False) -> tuple[str | None, list[Record]]:
    """The first extractor that finds records, or the one with the most complete ones."""
    found = ((name, f(page)) for name, f in EXTRACTORS.items())
    if best:
        return max(((n, r) for n, r in found if r), key=lambda x: (completeness(x[1]), len(x[1])), default=(None, []))
    return next(((n, r) for n, r in found if r), (None, []))


def page_records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", best: bool = False) -> DataFrame:
    """(id, technique, place fields) of all records of all pages."""
    schema = f"{id_col} {dict(pages.dtypes)[id_col]}, technique string, " + ", ".join(f"{f} string" for f in FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, found = extracted(page or "", best)
                rows += [(key, name, *[None if r.get(f) is None else str(r[f]) for f in FIELDS]) for r in found]
            if rows:
                kinds = [batch.schema.field(0).type] + [pa.string()] * (1 + len(FIELDS))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [id_col, "technique", *FIELDS])

    return pages.select(id_col, html_col).mapInArrow(run, schema)


def contacts(page: Column) -> list[Column]:
    """Phone, e-mail and street of a detail page, from links and JSON keys."""
    first = lambda pattern: F.nullif(F.regexp_extract(page, pattern, 1), F.lit(""))
    return [
        F.coalesce(first(r'"(?:telephone|phone)"\s*:\s*"([^"]+)"'), first(r'href="tel:([^"]+)"')).alias("phone"),
        F.coalesce(first(r'"email"\s*:\s*"([^"]+)"'), first(r'href="mailto:([^"?]+)')).alias("email"),
        first(r'"(?:streetAddress|street)"\s*:\s*"([^"]+)"').alias("street"),
    ]
