"""What pages and urls show by pattern alone, as Column expressions; ``sources.dom`` reads the element tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.functions.text import collapse


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def plain(html: Column) -> Column:
    """Text without tags."""
    return collapse(F.regexp_replace(html, r"(?s)<[^>]*>", " "))


def title(html: Column) -> Column:
    return F.nullif(plain(_first(html, r"(?is)<h1[^>]*>(.*?)</h1>")), F.lit(""))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""href="([^"]+)\""""), F.lit(1))


def source_id(url: Column) -> Column:
    """The listing number of a url, else any numeric segment, else the last segment."""
    return F.coalesce(_first(url, r"/a/([0-9]+)"), _first(url, r"/pa/([0-9]+)"), _first(url, r"/([0-9]+)(?:$|/)"), F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1))


# Coordinates in urls and scripts.
_COORDINATES = r"(?i)(?:lat|latitude)[=:]?(-?[0-9]+\.?[0-9]*)[,&]?.*?(?:lng|lon|longitude)[=:]?(-?[0-9]+\.?[0-9]*)"


def coordinates_from_url(url: Column) -> Column:
    return F.struct(_first(url, _COORDINATES, 1).try_cast("double").alias("latitude"), _first(url, _COORDINATES, 2).try_cast("double").alias("longitude"))


SCRIPT_FORMS = [r"""(?is)lat["\s]*[:=]\s*(-?[0-9]+\.?[0-9]*)[,\s].*?lng["\s]*[:=]\s*(-?[0-9]+\.?[0-9]*)""", r"""(?is)latitude["\s]*[:=]\s*(-?[0-9]+\.?[0-9]*)[,\s].*?longitude["\s]*[:=]\s*(-?[0-9]+\.?[0-9]*)"""]


def coordinates_from_script(html: Column) -> Column:
    both = [[_first(html, f, g).try_cast("double") for f in SCRIPT_FORMS] for g in (1, 2)]
    return F.struct(F.coalesce(*both[0]).alias("latitude"), F.coalesce(*both[1]).alias("longitude"))


def profile(html: Column) -> list[Column]:
    """Counts that describe a page."""
    count = lambda p: F.regexp_count(html, F.lit(p)).cast("long")
    return [count(r"<a ").alias("n_links"), count(r"<p[ >]").alias("n_paragraphs"), count(r"<script").alias("n_scripts"), count(r"<meta").alias("n_meta"), count(r"<img").alias("n_images"), count(r"class=").alias("n_classes")]
