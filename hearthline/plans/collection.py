"""Collection of listings: index pages, listing pages, merge into the stored table, and the run log.

Page access goes through a connector (``sources.readers``); nothing here opens a
connection itself. Each platform's index pages are followed on the driver, as one
page tells whether there is another; listing pages are fetched and parsed by tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators.upsert import latest, upsert_listings
from hearthline.plans.config import Settings
from hearthline.plans.tables import cut
from hearthline.schema import INGEST_LOG, LISTING, conform
from hearthline.sources import dom
from hearthline.sources.readers import connector, fetch_pages

# Names of cities in urls, and the form of index pages and listing links.
CITY_SLUGS = {"tangier": "tanger"}
INDEX_PATH, LATER_PAGES = "/fr/ct/{city}/immobilier-a-vendre", ":p:{page}"
LISTING_LINK = r"/(?:fr/)?p?a/[0-9]+"


def index_url(base: str, city: str, page: int) -> str:
    name = CITY_SLUGS.get(city.lower(), city.lower())
    return base + INDEX_PATH.format(city=name) + (LATER_PAGES.format(page=page) if page > 1 else "")


def crawl(fetch: Callable[[str], str | None], base: str, city: str, max_pages: int | None = None) -> list[str]:
    """Distinct listing urls of a city in order of appearance.

    Stops after ``max_pages``, at a page that fails or is missing, and at the first
    page without a link that is new.
    """
    import re

    found: dict[str, None] = {}
    page = 1
    while max_pages is None or page <= max_pages:
        try:
            html = fetch(index_url(base, city, page))
        except Exception:  # noqa: BLE001  a page that fails ends the city
            break
        links = [e.attributes["href"] for e in dom.parse(html or "").walk() if e.tag == "a" and re.search(LISTING_LINK, e.attributes.get("href", ""))]
        fresh = [u for u in dict.fromkeys(urljoin(base, u) for u in links) if u not in found]
        if not fresh:
            break
        found |= dict.fromkeys(fresh)
        page += 1
    return list(found)


@dataclass
class Run:
    """Stored listings after the run, its log, and what was merged."""

    listings: DataFrame
    log: DataFrame
    session_id: str
    errors: list[dict] = field(default_factory=list)

    def totals(self) -> DataFrame:
        """One row: counters over all platforms and cities."""
        counters = ["listings_found", "listings_new", "listings_updated", "errors_count"]
        return self.log.where("status <> 'running'").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def collect(spark: SparkSession, stored: DataFrame | None, settings: Settings, bases: dict[str, str], session_id: str | None = None, now: datetime | None = None) -> Run:
    """Run all platforms and cities of ``settings``; a city or platform that fails is logged and the others go on.

    ``bases`` has the base url of each platform. The log has a ``running`` entry for each
    platform and an entry for each of its cities, ``completed`` or ``failed``.
    """
    session_id, now = session_id or str(uuid.uuid4()), now or datetime.now(UTC).replace(tzinfo=None)
    stored = conform(stored if stored is not None else spark.createDataFrame([], LISTING), keep_extra=False)
    log: list[tuple] = []
    errors: list[dict] = []
    for platform in settings.platforms:
        log.append((session_id, platform, None, 0, 0, 0, 0, now, "running", None))
        for city in settings.cities:
            try:
                fetch = connector(platform)
                urls = crawl(fetch, bases[platform], city, settings.connector(platform).get("max_pages"))
                pages = cut(fetch_pages(spark.createDataFrame([(u,) for u in urls], "url string"), platform))
                parsed = dom.listings(pages, bases[platform]).withColumns({"source_platform": F.lit(platform), "scraped_at": F.lit(now).cast("timestamp"), "is_active": F.lit(True)})
                new = cut(latest(conform(parsed, keep_extra=False), ["source_platform", "source_id"], "scraped_at"))
                merged = cut(upsert_listings(stored, new))
                counts = {r["merge_action"]: r["n"] for r in merged.groupBy("merge_action").agg(F.count(F.lit(1)).alias("n")).collect()}
                failed = pages.where("error is not null or html is null").count()
                stored = conform(merged, keep_extra=False)
                log.append((session_id, platform, city, new.count(), counts.get("new", 0), counts.get("updated", 0), failed, now, "completed", None))
            except Exception as e:  # noqa: BLE001  logged, as the other cities go on
                errors.append({"platform": platform, "city": city, "error": str(e)})
                log.append((session_id, platform, city, 0, 0, 0, 1, now, "failed", str(e)[:500]))
    return Run(stored, spark.createDataFrame(log, INGEST_LOG), session_id, errors)
