"""Settings of collection and processing: defaults, then environment variables, then a YAML file."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from hearthline import vocab


@dataclass
class Collection:
    max_pages_per_city: int = 10
    max_workers: int = 4
    delay_between_platforms: int = 5
    enable_headless: bool = True
    request_timeout: int = 30
    retry_attempts: int = 3


@dataclass
class Geospatial:
    enable_enrichment: bool = True
    osm_cache_duration: int = 3600
    max_poi_radius: int = 1000


@dataclass
class Images:
    enable_download: bool = True
    enable_cloud_storage: bool = False
    cloud_provider: str = "aws"
    local_storage_path: str = "data/images"
    max_image_size: int = 5 << 20
    quality_threshold: float = 0.3
    supported_formats: list[str] = field(default_factory=lambda: ["JPEG", "PNG", "WEBP"])


@dataclass
class Monitoring:
    enable_monitoring: bool = False
    max_error_rate: float = 0.1
    failures_in_a_row: int = 5


@dataclass
class Settings:
    collection: Collection = field(default_factory=Collection)
    geospatial: Geospatial = field(default_factory=Geospatial)
    images: Images = field(default_factory=Images)
    monitoring: Monitoring = field(default_factory=Monitoring)
    debug: bool = False
    environment: str = "development"
    cities: list[str] = field(default_factory=lambda: list(vocab.CITIES))
    platforms: list[str] = field(default_factory=lambda: ["mubawab"])
    connectors: dict[str, dict[str, Any]] = field(default_factory=dict)

    def connector(self, platform: str) -> dict[str, Any]:
        """The options of a platform's connector: its own, or the general ones."""
        general = {"max_pages": self.collection.max_pages_per_city, "delay": 1.0, "timeout": self.collection.request_timeout, "retries": self.collection.retry_attempts}
        return self.connectors.get(platform, general)


# Environment variables by part and setting.
VARIABLES = {
    "DEBUG": ("", "debug"),
    "ENVIRONMENT": ("", "environment"),
    "SCRAPING_MAX_PAGES_PER_CITY": ("collection", "max_pages_per_city"),
    "SCRAPING_MAX_WORKERS": ("collection", "max_workers"),
    "SCRAPING_DELAY_BETWEEN_PLATFORMS": ("collection", "delay_between_platforms"),
    "SCRAPING_ENABLE_HEADLESS": ("collection", "enable_headless"),
    "SCRAPING_REQUEST_TIMEOUT": ("collection", "request_timeout"),
    "SCRAPING_RETRY_ATTEMPTS": ("collection", "retry_attempts"),
    "ENABLE_GEOSPATIAL_ENRICHMENT": ("geospatial", "enable_enrichment"),
    "OSM_CACHE_DURATION": ("geospatial", "osm_cache_duration"),
    "MAX_POI_RADIUS": ("geospatial", "max_poi_radius"),
    "ENABLE_IMAGE_DOWNLOAD": ("images", "enable_download"),
    "ENABLE_CLOUD_STORAGE": ("images", "enable_cloud_storage"),
    "CLOUD_PROVIDER": ("images", "cloud_provider"),
    "LOCAL_STORAGE_PATH": ("images", "local_storage_path"),
    "MAX_IMAGE_SIZE": ("images", "max_image_size"),
    "IMAGE_QUALITY_THRESHOLD": ("images", "quality_threshold"),
    "ENABLE_MONITORING": ("monitoring", "enable_monitoring"),
}


def _as(kind: type, text: str) -> Any:
    """A variable's text in the type of the default; texts that don't fit raise ValueError."""
    if kind is bool:
        word = text.strip().lower()
        if word in ("1", "true", "yes", "on", "y", "t"):
            return True
        if word in ("0", "false", "no", "off", "n", "f", ""):
            return False
        raise ValueError(f"not a boolean: {text}")
    return kind(text)


def load(folder: str | Path | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """Settings from variables, and from ``config.yaml`` in ``folder`` if it is there (``cities``, ``platforms``, ``scrapers``)."""
    settings, variables = Settings(), os.environ if environment is None else environment
    for name, (part, key) in VARIABLES.items():
        if name in variables:
            target = getattr(settings, part) if part else settings
            setattr(target, key, _as(type(getattr(target, key)), variables[name]))
    path = Path(folder) / "config.yaml" if folder is not None else None
    if path is not None and path.exists():
        try:
            import yaml
        except ImportError as e:  # an optional reader
            raise RuntimeError("reading config.yaml needs a YAML reader") from e
        given = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        settings = dataclasses.replace(
            settings,
            cities=given.get("cities", settings.cities),
            platforms=given.get("platforms", settings.platforms),
            connectors=given.get("scrapers", settings.connectors),
        )
    return settings


def write_template(path: str | Path) -> None:
    """A file with the values that ``load`` reads."""
    import yaml

    defaults = Settings()
    given = {"cities": defaults.cities, "platforms": defaults.platforms, "scrapers": {p: {"max_pages": 10, "delay": 1.0, "timeout": 25} for p in defaults.platforms}}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(given, sort_keys=False, allow_unicode=True), encoding="utf-8")
