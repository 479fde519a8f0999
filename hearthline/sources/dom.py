"""Listing fields out of stored pages by their element tree.

Pages are parsed with the standard library inside an Arrow function. A field is a
list of selectors in order of preference; the first that finds an element with a
usable value decides. Selectors know tags, classes, parts of the class attribute
and descendants, which is all that listing pages need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cache, cached_property
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline import vocab

# Selectors of listing pages, in order of preference.
TITLE = ["h1.property-title", "h1.listing-title", ".title h1", "h1"]
DESCRIPTION = [".property-description", ".description-content", ".listing-description", ".description"]
PRICE = [".fullPicturesPrice", ".price", ".cost", "[class*=price]", "span[class*=price]", "div[class*=price]"]
DETAILS = [".adDetails"]
LOCATION = [".property-location", ".listing-location", ".address", ".location"]
IMAGES = [".property-gallery img", ".listing-images img", ".image-gallery img", ".photos img"]
IMAGE_SOURCES = ["src", "data-src", "data-original"]
AGENT = [".agent-name", ".agency-name", ".contact-name", ".seller-name"]
AGENT_BLOCKS = ["agent", "agency", "contact", "seller"]
AMENITY_BLOCKS = ["amenities", "features", "facilities"]
AMENITY_ITEMS = ["li", "span", "div"]
NO_PLACE = ["Home", "Buy", "Morocco"]
TITLE_CITIES = {"casablanca": "Casablanca", "rabat": "Rabat", "marrakech": "Marrakech", "tanger": "Tangier", "fes": "Fes", "agadir": "Agadir"}
FALLBACK_CITY = "Casablanca"
# Patterns of listing texts.
PRICE_TEXTS = [r"(\d[\d\s ,\.]*)\s*(?:DH|MAD)", r"Prix\s*:?\s*(\d[\d\s ,\.]*)"]
SURFACE_TEXTS = [r"(\d+(?:[,\.]\d+)?)\s*m[²2]", r"surface[:\s]*(\d+(?:[,\.]\d+)?)\s*m", r"superficie[:\s]*(\d+(?:[,\.]\d+)?)\s*m"]
ROOM_TEXTS = [r"(\d+)\s*(?:chambre|bedroom|room)", r"(\d+)\s*pi[èe]ces?"]
LOOSE_ROOM_TEXTS = [r"(\d+)\s*chambre", r"(\d+)\s*pi[èe]ces?", r"(\d+)\s*bedroom"]
BATH_TEXTS = [r"(\d+)\s*(?:salle.*bain|bathroom|sdb)"]
PHONE_TEXT = r"(?:\+212|0)[0-9\s\-]{8,}"
SCRIPT_COORDINATES = [
    r'lat["\s]*[:=]\s*([-]?\d+\.?\d*)[,\s].*?lng["\s]*[:=]\s*([-]?\d+\.?\d*)',
    r'latitude["\s]*[:=]\s*([-]?\d+\.?\d*)[,\s].*?longitude["\s]*[:=]\s*([-]?\d+\.?\d*)',
    r'center["\s]*[:=]\s*\{\s*lat[:\s]*([-]?\d+\.?\d*)[,\s]*lng[:\s]*([-]?\d+\.?\d*)',
]
URL_COORDINATES = [r"(?:lat|latitude)[=:]?([-]?\d+\.?\d*)[,&]?.*?(?:lng|lon|longitude)[=:]?([-]?\d+\.?\d*)"]

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))


#: Rows of an Arrow batch of pages, and of the parts in which its pages are parsed.
BATCH_ROWS, PART_ROWS = 200, 32
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    parent: Element | None = None
    children: list[Element | str] = field(default_factory=list)

    #: Of a page, all elements in document order, so that it is walked without a stack.
    order: list[Element] | None = None

    @cached_property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def walk(self) -> Iterator[Element]:
        """The elements below this one in document order."""
        if self.order is not None:
            yield from self.order
            return
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]

    def text(self) -> str:
        """The text below, scripts and styles left out."""
        out, stack = [], list(reversed(self.children))
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            elif e.tag not in HIDDEN:
                stack += reversed(e.children)
        return "".join(out)

    def select(self, selector: str) -> Iterator[Element]:
        """Elements that match a selector of tags, ``.class``, ``[class*=part]`` and descendants."""
        *above, last = _steps(selector)
        for e in self.walk():
            if last.fits(e) and _under(e.parent, above):
                yield e

    def first(self, selectors: list[str]) -> Element | None:
        """The first element of the first selector that finds any."""
        return next((e for s in selectors for e in self.select(s)), None)

    def with_class(self, tag: str, parts: list[str]) -> Element | None:
        """The first element of a tag one of whose classes holds one of ``parts``."""
        return next((e for e in self.walk() if e.tag == tag and any(p in c for c in e.classes for p in parts)), None)


@dataclass(frozen=True)
class _Step:
    tag: str
    name: str
    part: str

    @classmethod
    def of(cls, text: str) -> _Step:
        m = re.fullmatch(r"([a-z0-9]*)(?:\.([\w-]+))?(?:\[class\*=([\w-]+)\])?", text)
        if m is None:
            raise ValueError(f"unknown selector: {text}")
        return cls(m[1], m[2] or "", m[3] or "")

    def fits(self, e: Element) -> bool:
        return (not self.tag or e.tag == self.tag) and (not self.name or self.name in e.classes) and (not self.part or self.part in e.attributes.get("class", ""))


@cache
def _steps(selector: str) -> tuple[_Step, ...]:
    return tuple(_Step.of(s) for s in selector.split())


def _under(e: Element | None, above: list[_Step]) -> bool:
    """Whether the steps fit ancestors of an element in order, innermost last."""
    for step in reversed(above):
        while e is not None and not step.fits(e):
            e = e.parent
        if e is None:
            return False
        e = e.parent
    return True


class _Builder(HTMLParser):
    """Builds the tree; unknown closing tags are ignored, open elements end with the one around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("")
        self.root.order = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = Element(tag, {}, self.at)
        for k, v in attrs:
            e.attributes.setdefault(k, v or "")
        self.at.children.append(e)
        self.root.order.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        e: Element | None = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


@contextmanager
def parsed(html: str) -> Iterator[Element]:
    """A page whose tree goes when it is done with; parents would else hold it until the collector comes by."""
    page = parse(html)
    try:
        yield page
    finally:
        for e in page.order:
            e.parent = None
        page.order = None


def _small(pages: DataFrame) -> DataFrame:
    """Pages for an Arrow function; the session's batches are lowered to BATCH_ROWS rows, as pages may be long."""
    conf = pages.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return pages


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few pages, whose memory is given back when a task ends."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                yield batch.slice(at, PART_ROWS)
    finally:
        pa.default_memory_pool().release_unused()


def clean(text: str | None) -> str:
    return re.sub(r"\s+", " ", (text or "").strip())


def _digits(text: str) -> int | None:
    digits = re.sub(r"[^0-9]", "", text)
    return int(digits) if digits else None


def _match(patterns: list[str], text: str) -> re.Match | None:
    return next((m for p in patterns if (m := re.search(p, text, re.IGNORECASE))), None)


def _price(page: Element, text: str) -> float | None:
    blocks = (e.text() for s in PRICE if (e := next(page.select(s), None)) is not None)
    loose = (m[1] for p in PRICE_TEXTS if (m := re.search(p, text, re.IGNORECASE)))
    found = next((p for source in (blocks, loose) for t in source if (p := _digits(t))), None)
    return None if found is None else float(found)


def _details(page: Element, text: str) -> dict[str, float | int]:
    """Surface, rooms and bathrooms of the details block; without any there, surface and rooms of the whole text."""
    block = page.first(DETAILS)
    plans = [(text, SURFACE_TEXTS, LOOSE_ROOM_TEXTS, [])]
    if block is not None:
        plans.insert(0, (block.text(), SURFACE_TEXTS[:1], ROOM_TEXTS, BATH_TEXTS))
    for source, surface, rooms, baths in plans:
        found: dict[str, float | int] = {}
        if m := _match(surface, source):
            found["surface_m2"] = float(m[1].replace(",", "."))
        for name, patterns in (("rooms", rooms), ("bathrooms", baths)):
            if (m := _match(patterns, source)) and len(m[1]) < 10:
                found[name] = int(m[1])
        if found:
            return found
    return {}


def _location(page: Element) -> tuple[str | None, str]:
    """Neighborhood and city: location block, breadcrumb, city named in the title, the fallback."""
    block = page.first(LOCATION)
    parts = [p.strip() for p in block.text().split(",")] if block is not None and block.text() else []
    neighborhood = parts[0] if len(parts) > 1 else None
    city = parts[-1] if parts else ""
    trail = page.with_class("nav", ["breadcrumb"])
    for link in (e for e in trail.walk() if e.tag == "a") if trail is not None and not city else ():
        name = link.text().strip()
        if name and name not in NO_PLACE:
            city = name
            break
    if not city and (title := page.first(["h1"])) is not None:
        text = title.text().lower()
        city = next((name for word, name in TITLE_CITIES.items() if word in text), "")
    return neighborhood, city or FALLBACK_CITY


def _coordinates(page: Element, url: str) -> tuple[float | None, float | None]:
    if (m := _match(URL_COORDINATES, url)) and float(m[1]) and float(m[2]):
        return float(m[1]), float(m[2])
    for e in page.walk():
        if e.tag == "script" and (m := _match(SCRIPT_COORDINATES, "".join(c for c in e.children if isinstance(c, str)))):
            return float(m[1]), float(m[2])
    return None, None


def _images(page: Element, base: str) -> list[str]:
    found = []
    for e in (e for s in IMAGES for e in page.select(s)):
        source = next((v for k in IMAGE_SOURCES if (v := e.attributes.get(k))), "")
        source = f"https:{source}" if source.startswith("//") else urljoin(base, source) if source.startswith("/") else source
        if source.startswith("http"):
            found.append(source)
    return list(dict.fromkeys(found))


def _agent(page: Element) -> tuple[str | None, str | None]:
    section = page.with_class("div", AGENT_BLOCKS) or page
    name, phone = section.first(AGENT), re.search(PHONE_TEXT, section.text())
    return (clean(name.text()) if name is not None else None), (phone[0].strip() if phone else None)


def _amenities(page: Element, text: str) -> list[str]:
    block = page.with_class("div", AMENITY_BLOCKS)
    items = [e.text().strip().lower() for e in block.walk() if e.tag in AMENITY_ITEMS] if block is not None else []
    return [t for t in items if t] or [w for w in vocab.AMENITY_WORDS if w in text.lower()]


def source_id(url: str) -> str:
    m = next((m for p in (r"/a/(\d+)", r"/pa/(\d+)", r"/(\d+)(?:$|/)") if (m := re.search(p, url))), None)
    return m[1] if m else url.rstrip("/").split("/")[-1]


def listing(html: str, url: str, base: str = "") -> dict | None:
    """The fields of one listing page; None without a title."""
    with parsed(html) as page:
        return _listing(page, url, base)


def _listing(page: Element, url: str, base: str) -> dict | None:
    title = page.first(TITLE)
    if title is None or not clean(title.text()):
        return None
    text, description = page.text(), page.first(DESCRIPTION)
    neighborhood, city = _location(page)
    latitude, longitude = _coordinates(page, url)
    agent, phone = _agent(page)
    return _details(page, text) | {
        "source_url": url,
        "source_id": source_id(url),
        "title": clean(title.text()),
        "description": clean(description.text()) if description is not None else None,
        "price_mad": _price(page, text),
        "neighborhood": neighborhood,
        "city": city,
        "latitude": latitude,
        "longitude": longitude,
        "image_urls": _images(page, base),
        "agent_name": agent,
        "agent_phone": phone,
        "amenities": _amenities(page, text),
    }


_FIELDS = pa.schema([
    ("source_url", pa.string()), ("source_id", pa.string()), ("title", pa.string()), ("description", pa.string()), ("price_mad", pa.float64()),
    ("surface_m2", pa.float64()), ("rooms", pa.int32()), ("bathrooms", pa.int32()), ("neighborhood", pa.string()), ("city", pa.string()),
    ("latitude", pa.float64()), ("longitude", pa.float64()), ("image_urls", pa.list_(pa.string())), ("agent_name", pa.string()), ("agent_phone", pa.string()), ("amenities", pa.list_(pa.string())),
])
FIELDS = "source_url string, source_id string, title string, description string, price_mad double, surface_m2 double, rooms int, bathrooms int, neighborhood string, city string, latitude double, longitude double, image_urls array<string>, agent_name string, agent_phone string, amenities array<string>"


def listings(pages: DataFrame, base: str = "", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page with a title; pages without HTML or url give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            rows = [listing(h, u, base) for u, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in _FIELDS.names} for r in rows if r], schema=_FIELDS)

    known = pages.where(F.col(url_col).isNotNull() & F.col(html_col).isNotNull())
    return _small(known).select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, FIELDS)


def profile(html: str) -> dict:
    """What a page consists of: elements, classes, attributes and meta data, and what hints at listings."""
    with parsed(html) as page:
        return _profile(page)


def _profile(page: Element) -> dict:
    tags: dict[str, int] = {}
    classes: dict[str, int] = {}
    data: dict[str, int] = {}
    meta: dict[str, str] = {}
    linked: list[str] = []
    for e in page.walk():
        tags[e.tag] = tags.get(e.tag, 0) + 1
        for c in e.classes:
            classes[c] = classes.get(c, 0) + 1
        for k in e.attributes:
            if k.startswith("data-"):
                data[k] = data.get(k, 0) + 1
        name = e.attributes.get("name") or e.attributes.get("property")
        if e.tag == "meta" and name:
            meta.setdefault(name, e.attributes.get("content", ""))
        if e.tag == "script" and e.attributes.get("type") == "application/ld+json":
            linked.append("".join(c for c in e.children if isinstance(c, str)).strip())
    text = page.text()
    links = [e.attributes["href"] for e in page.walk() if e.tag == "a" and "href" in e.attributes]
    return {
        "tags": tags,
        "classes": classes,
        "data_attributes": data,
        "meta": meta,
        "linked_data": linked,
        "headings": [clean(e.text()) for e in page.walk() if e.tag in ("h1", "h2", "h3")],
        "listing_links": [u for u in dict.fromkeys(links) if re.search(r"/p?a/\d+", u)],
        "prices": [m.strip() for m in re.findall(r"\d[\d\s,.]*(?:DH|MAD|€)", text)],
        "surfaces": re.findall(r"\d+(?:[,.]\d+)?\s*m[²2]", text),
        "rooms": re.findall(r"\d+\s*(?:chambre|pi[èe]ce|bedroom|room)", text, re.IGNORECASE),
    }


def profiles(pages: DataFrame) -> DataFrame:
    """``url`` and the profile of every page; NULL HTML counts as an empty page."""
    kinds = {"map<string,long>": pa.map_(pa.string(), pa.int64()), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}
    columns = {"tags": "map<string,long>", "classes": "map<string,long>", "data_attributes": "map<string,long>", "meta": "map<string,string>"}
    columns |= dict.fromkeys(("linked_data", "headings", "listing_links", "prices", "surfaces", "rooms"), "array<string>")
    fields = pa.schema([("url", pa.string()), *[(n, kinds[t]) for n, t in columns.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            rows = [{"url": u} | {k: list(v.items()) if isinstance(v, dict) else v for k, v in profile(h or "").items()} for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return _small(pages).select("url", "html").mapInArrow(run, ", ".join(["url string", *[f"{n} {t}" for n, t in columns.items()]]))
