"""Listings against the leaders of their city, many pairs at a time.

A pair is decided as ``dedup.matches`` decides it, by the same parts in the same order;
only distances may differ in their last bit. Bounds over whole blocks of pairs leave few
to be compared in full, and once a listing has found its first leader no later one is
looked at. There is no shuffle and no code to be generated, and a block of pairs is all
that is in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions import similarity as M
from hearthline.functions.geo import EARTH_KM
from hearthline.functions.text import match_title

RADIUS_M = 50.0
#: A little more than ``RADIUS_M``, in degrees of latitude.
PLACE_DEGREES = 0.00046
PLACE_RATIO, TITLE_RATIO, TITLE_LOCATION = 0.8, 0.7, 0.7
#: What two listings beyond a kilometre lose of the location's part at least.
FAR_LOSS = 0.25 / 3
#: Listings and leaders of a block of pairs.
ROWS, LEADERS = 1024, 128
#: Listings that are settled together in ``settle``.
CHUNK = 256
NUMBERS = ["latitude", "longitude", "price_mad", "surface_m2", "rooms"]
NAMES = ["neighborhood", "property_type", "source_id", "source_platform", "title"]


def columns(df: DataFrame) -> DataFrame:
    """What a comparison needs of conformed listings: numbers, names and the two forms of long titles."""
    long = F.length("title") >= 10
    forms = {"plain": F.when(long, match_title(F.col("title"))), "low": F.when(long, F.lower("title"))}
    return df.select("id", "city", *[F.col(c).cast("double").alias(c) for c in NUMBERS], *NAMES, *[v.alias(k) for k, v in forms.items()])


class Listings:
    """The columns of some listings of one city as arrays; with ``like``, names have its numbers and others -1. NULL is -2 or -3."""

    def __init__(self, rows: pd.DataFrame, like: Listings | None = None):
        self.id = rows["id"].to_numpy(np.int64)
        self.lat, self.lon, price, area, self.rooms = (rows[c].to_numpy(float) for c in NUMBERS)
        with np.errstate(invalid="ignore"):
            self.price, self.area = (np.where(x > 0, x, 0.0) for x in (price, area))
            self.has_place = ~np.isnan(self.lat) & ~np.isnan(self.lon)
            self.cell = np.where((np.abs(self.lat) < 60) & (np.abs(self.lon) < 179.9), self.lat, np.nan)
        self.plain, self.low = (rows[c].to_numpy(object) for c in ("plain", "low"))
        self.long = rows["low"].notna().to_numpy()
        self.index = {} if like is None else like.index
        null = -2 if like is None else -3
        for c in ("property_type", "source_id", "source_platform"):
            x = rows[c].where(rows[c] != "") if c == "source_id" else rows[c]
            if like is None:
                self.index[c] = pd.Index(x.dropna().unique(), dtype=object)
            setattr(self, c, np.where(x.isna(), null, self.index[c].get_indexer(x.to_numpy(object))))
        hood, self.hoods = pd.factorize(rows["neighborhood"].fillna("").to_numpy(object))
        self.hood, self.title = hood, pd.factorize(rows["low"].to_numpy(object))[0]
        self.no_type, self.no_rooms = rows["property_type"].isna().to_numpy(), np.isnan(self.rooms)


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smaller over larger; 0 where one is 0."""
    return np.minimum(x, y) / np.maximum(np.maximum(x, y), 5e-324)


def _possible(a: Listings, i: np.ndarray, b: Listings, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``i`` and ``j`` that some matcher may accept, as positions in ``j`` and in ``i``, in this order. NaN counts as large."""
    row, col = (lambda x: x[j][:, None]), (lambda x: x[i][None, :])
    price, area = _ratio(row(b.price), col(a.price)), _ratio(row(b.area), col(a.area))
    apart = np.abs(row(b.cell) - col(a.cell))
    beyond = apart > M.FAR_DEGREES
    may = ~beyond & (~(price <= TITLE_RATIO) | ~(area <= TITLE_RATIO)) & ((row(b.long) & col(a.long)) | ~(apart > PLACE_DEGREES))
    score = 0.3 * price + 0.25 * area
    score += 0.25 - FAR_LOSS * beyond
    score += 0.1 * ((row(b.rooms) == col(a.rooms)) | row(b.no_rooms) | col(a.no_rooms))
    score += 0.1 * ((row(b.property_type) == col(a.property_type)) | row(b.no_type) | col(a.no_type))
    may |= ~(score < least - 1e-9)
    known = np.flatnonzero(b.source_id[j] >= 0)
    if len(known):
        may[known] |= b.source_id[j][known][:, None] == col(a.source_id)
    return np.nonzero(may)


def _by_pair(score, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``score(position)`` once for each pair of numbers, at the first position that has it."""
    _, first, at = np.unique(left.astype(np.int64) * (int(right.max(initial=0)) + 2) + right, return_index=True, return_inverse=True)
    return np.array([score(k) for k in first], float)[at.reshape(-1)]


def _same(x: np.ndarray, y: np.ndarray, no_x: np.ndarray, no_y: np.ndarray) -> np.ndarray:
    return np.where(no_x & no_y, 1.0, np.where(no_x | no_y, 0.5, (x == y).astype(float)))


def _links(a: Listings, i: np.ndarray, b: Listings, j: np.ndarray, least: float, first: bool) -> np.ndarray:
    """Which of the pairs ``i, j`` are linked. With ``first``, only the first of each run of equal ``j`` is sure to be found."""
    price, area = _ratio(a.price[i], b.price[j]), _ratio(a.area[i], b.area[j])
    lat, other, lon = a.lat[i], b.lat[j], b.lon[j] - a.lon[i]
    placed = a.has_place[i] & b.has_place[j]
    far = placed & (np.abs(lat) <= 90) & (np.abs(other) <= 90) & (np.abs(lat - other) > M.FAR_DEGREES)
    metres = np.full(len(i), np.nan)
    k = np.flatnonzero(placed & ~far)
    x, y = np.radians(lat[k]), np.radians(other[k])
    h = np.sin((y - x) / 2) ** 2 + np.cos(x) * np.cos(y) * np.sin(np.radians(lon[k]) / 2) ** 2
    metres[k] = 2 * EARTH_KM * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) * 1000
    close = np.select([metres <= 100, metres <= 500, metres <= 1000], [1.0, 0.8, 0.6], 0.0)
    p, q = a.hoods[a.hood[i]], b.hoods[b.hood[j]]
    hood = np.where((p == "") | (q == ""), 0.5, 1.0)
    k = np.flatnonzero((hood == 1.0) & (p != q))
    hood[k] = _by_pair(lambda n: M._name_score(p[k[n]], q[k[n]]), a.hood[i][k], b.hood[j][k])
    place = np.where(placed, (1 + hood + close) / 3, (1 + hood) / 2)
    features = 0.3 * price + 0.25 * area + 0.25 * place + 0.1 * _same(a.rooms[i], b.rooms[j], a.no_rooms[i], b.no_rooms[j]) + 0.1 * _same(a.property_type[i], b.property_type[j], a.no_type[i], b.no_type[j])
    at_place = (metres <= RADIUS_M) & (~(price <= PLACE_RATIO) | ~(area <= PLACE_RATIO))
    shared = (a.source_id[i] >= 0) & (a.source_id[i] == b.source_id[j]) & (a.source_platform[i] > -2) & (b.source_platform[j] > -2) & (a.source_platform[i] != b.source_platform[j])
    titled = a.long[i] & b.long[j] & (~(price <= TITLE_RATIO) | ~(area <= TITLE_RATIO)) & (place > TITLE_LOCATION) & ~at_place
    score = np.where(at_place, 1.0, np.where(features < least, 0.0, features))
    found = at_place | shared | ~(features < least)
    score = np.where(shared & ~(score > 0.95), 0.95, score)
    linked = found & ~(score < least)
    k = np.flatnonzero(titled)
    if first and len(k):
        # Titles that come after a sure link need no comparison.
        sure = np.flatnonzero(linked & ~titled)
        at = np.full(int(j.max()) + 1, len(j))
        np.minimum.at(at, j[sure], sure)
        linked[k[k > at[j[k]]]] = False
        k = k[k < at[j[k]]]
    if len(k):
        of = a.title[i][k], b.title[j][k]
        alike = _by_pair(lambda n: M.title_score(a.plain[i[k[n]]], b.plain[j[k[n]]], least), *of) >= least
        k, of = k[alike], tuple(x[alike] for x in of)
        if len(k):
            # A match by title has the score of the titles as they are, whatever else agrees.
            raw = _by_pair(lambda n: M.title_score(a.low[i[k[n]]], b.low[j[k[n]]]), *of)
            linked[k] = np.where(shared[k], np.maximum(raw, 0.95), raw) >= least
    return linked


def first_leaders(a: Listings, leaders: np.ndarray, b: Listings, rows: np.ndarray, least: float) -> np.ndarray:
    """For each of ``rows`` of ``b`` the first of ``leaders``, rows of ``a``, that links with it; -1 if none does."""
    out = np.full(len(rows), -1)
    with np.errstate(invalid="ignore"):
        for start in range(0, len(rows), ROWS):
            live = np.arange(start, min(start + ROWS, len(rows)))
            for k in range(0, len(leaders), LEADERS):
                i = leaders[k : k + LEADERS]
                at, lead = _possible(a, i, b, rows[live], least)
                linked = _links(a, i[lead], b, rows[live][at], least, True)
                got, where = np.unique(at[linked], return_index=True)
                out[live[got]] = i[lead[linked][where]]
                live = np.delete(live, got)
                if not len(live):
                    break
    return out


def settle(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """``id, group_id``: greedy groups of listings of one city in id order, each with the first leader that links with it."""
    rows = rows.sort_values("id", ignore_index=True)
    x, n = Listings(rows), len(rows)
    leader, leaders = np.arange(n), np.zeros(0, np.int64)
    for start in range(0, n, CHUNK):
        chunk = np.arange(start, min(start + CHUNK, n))
        got = first_leaders(x, leaders, x, chunk, least)
        leader[chunk[got >= 0]] = got[got >= 0]
        open_ = chunk[got < 0]
        with np.errstate(invalid="ignore"):
            later, earlier = _possible(x, open_, x, open_, least)
            later, earlier = later[earlier < later], earlier[earlier < later]
            linked = _links(x, open_[earlier], x, open_[later], least, False)
        lead = np.ones(len(open_), bool)
        for i, j in zip(earlier[linked], later[linked], strict=True):
            # Sorted by the later listing, so the earlier one is settled.
            if lead[j] and lead[i]:
                lead[j], leader[open_[j]] = False, open_[i]
        leaders = np.concatenate([leaders, open_[lead]])
    return pd.DataFrame({"id": x.id, "group_id": x.id[leader]})


def taken(leads: dict[str, pd.DataFrame], least: float):
    """A function of batches of later listings: ``id, group_id`` of those that some leader of their city takes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {city: Listings(rows.sort_values("id", ignore_index=True)) for city, rows in leads.items()}
        for batch in batches:
            for city, rows in batch.groupby("city", sort=False):
                if city in known:
                    a, b = known[city], Listings(rows, known[city])
                    got = first_leaders(a, np.arange(len(a.id)), b, np.arange(len(b.id)), least)
                    yield pd.DataFrame({"id": b.id[got >= 0], "group_id": a.id[got[got >= 0]]})

    return run
