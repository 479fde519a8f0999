"""Pages, collection runs, settings, images, run logs."""

import math
import struct
import zlib
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import coordinates, dedup, encoding, enrich, images, monitoring
from hearthline.plans import collection, config, workflow
from hearthline.schema import LISTING, conform, from_json_columns, to_json_columns
from hearthline.sources import datasource, dom, readers

PAGE = """<html><body><nav class="breadcrumb"><a>Home</a><a>Rabat</a></nav><div class="title"><h1>Bel
 appartement<br> {n}</h1></div><span class="old price-tag"></span><div class="cost">x</div><div class="main-price"><b>1&nbsp;200</b> 000 DH</div>
<div class="adDetails"><div>90,5 m²</div><div>4 pièces</div> 1 sdb</div><p class="description">Vue<p>mer</p></p><script>lat: 34.01, lng: -6.83</script></body></html>"""


def test_fields_of_a_page():
    got = dom.listing(PAGE.format(n=1), "https://x.example.com/fr/a/77/bel")
    assert got["title"] == "Bel appartement 1" and got["city"] == "Rabat" and got["neighborhood"] is None
    assert (got["price_mad"], got["surface_m2"], got["rooms"], got["bathrooms"]) == (1_200_000.0, 90.5, 4, 1)
    assert got["description"] == "Vuemer" and (got["latitude"], got["longitude"]) == (34.01, -6.83) and got["source_id"] == "77"
    assert got["image_urls"] == [] and got["amenities"] == [] and got["agent_name"] is None
    loose = dom.listing("<h1>Villa a Tanger</h1><p>Prix: 900 000, superficie 120 m, 3 chambres, parking</p>", "https://x.example.com/b/")
    assert (loose["city"], loose["price_mad"], loose["surface_m2"], loose["rooms"], loose["amenities"], loose["source_id"]) == ("Tangier", 900_000.0, 120.0, 3, ["parking"], "b")
    assert dom.listing("<p>no title</p>", "u") is None and dom.listing("", "u") is None


@pytest.mark.parametrize("selector, want", [("div", ["a", "b", "c"]), (".x", ["a", "c"]), ("div.x p", ["p1", "p2"]), ("[class*=yz]", ["b"]), (".x .w p", ["p2"])])
def test_selectors(selector, want):
    page = dom.parse('<div id=a class="x q"><p id=p1>1</p></div><div id=b class=xyz></div><div id=c class=x><span class=w><p id=p2>2</span></div>')
    assert [e.attributes["id"] for e in page.select(selector)] == want


def site(pages: int, per_page: int = 3):
    """A platform of one city with index pages that repeat their last listing; one listing page fails, one has no title."""
    base = "https://x.example.com"

    def fetch(url: str) -> str:
        if "/ct/rabat/" in url:
            page = int(url.split(":p:")[1]) if ":p:" in url else 1
            ids = range((page - 1) * per_page, page * per_page + 1) if page <= pages else [pages * per_page]
            return "".join(f'<a href="/fr/a/{i}/x">l</a><a href="/other">o</a>' for i in ids)
        if "/ct/" in url:
            raise OSError("not there")
        i = int(url.split("/")[-2])
        if i == 1:
            raise OSError("gone")
        return PAGE.format(n=i) if i != 2 else "<p>empty</p>"

    return base, fetch


def test_crawl_stops():
    base, fetch = site(3)
    assert len(collection.crawl(fetch, base, "Rabat")) == 10
    assert len(collection.crawl(fetch, base, "rabat", max_pages=1)) == 4
    assert collection.crawl(fetch, base, "fes") == [] and collection.index_url(base, "Tangier", 2).endswith("/ct/tanger/immobilier-a-vendre:p:2")


def test_collection_run(spark):
    base, fetch = site(2)
    readers.register_connector("site", fetch)
    settings = config.Settings(cities=["rabat", "fes"], platforms=["site", "unknown"])
    first = collection.collect(spark, None, settings, {"site": base}, "s1", datetime(2024, 1, 1))
    # Listings 0 to 6 less the one that fails and the one without a title.
    assert sorted(r["source_id"] for r in first.listings.collect()) == ["0", "3", "4", "5", "6"]
    assert first.totals().first().asDict() == {"listings_found": 5, "listings_new": 5, "listings_updated": 0, "errors_count": 3}
    again = collection.collect(spark, first.listings, settings, {"site": base}, "s2", datetime(2024, 1, 2))
    assert again.totals().first()["listings_updated"] == 5 and again.listings.count() == 5
    states = {(r["platform"], r["city"]): r["status"] for r in again.log.where("city is not null").collect()}
    assert states == {("site", "rabat"): "completed", ("site", "fes"): "completed", ("unknown", "rabat"): "failed", ("unknown", "fes"): "failed"}


def test_settings(tmp_path):
    (tmp_path / "config.yaml").write_text("cities: [rabat]\nscrapers: {mubawab: {max_pages: 3}}\n")
    got = config.load(tmp_path, {"DEBUG": "true", "SCRAPING_MAX_WORKERS": "9", "IMAGE_QUALITY_THRESHOLD": "0.5"})
    assert (got.cities, got.debug, got.collection.max_workers, got.images.quality_threshold, got.platforms) == (["rabat"], True, 9, 0.5, ["mubawab"])
    assert got.connector("mubawab") == {"max_pages": 3} and got.connector("x")["retries"] == 3
    with pytest.raises(ValueError):
        config.load(None, {"DEBUG": "perhaps"})
    config.write_template(tmp_path / "new" / "config.yaml")
    assert config.load(tmp_path / "new", {}).connectors["mubawab"]["timeout"] == 25


def png(pixels: np.ndarray, kinds) -> bytes:
    """A PNG whose rows are filtered in the given ways."""
    x, out = pixels.astype(int), b""
    h, w, c = x.shape
    for y in range(h):
        up = x[y - 1] if y else np.zeros((w, c), int)
        left = np.vstack([np.zeros((1, c), int), x[y, :-1]])
        corner = np.vstack([np.zeros((1, c), int), up[:-1]])
        p = left + up - corner
        d = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
        paeth = np.choose(d.argmin(0), [left, up, corner])
        kind = kinds[y % len(kinds)]
        out += bytes([kind]) + ((x[y] - [0 * up, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_decoded_images(channels):
    x = np.random.default_rng(1).integers(0, 256, (11, 7, channels)).astype(np.uint8)
    got = images.decode(png(x, range(5)))
    assert (got == (x[:, :, :3] if channels >= 3 else np.repeat(x, 3, 2))).all()
    assert images.decode(b"junk") is None and images.decode(None) is None and images.decode(png(x, [0])[:40]) is None


def test_color_histogram():
    red = np.zeros((4, 4, 3), np.uint8)
    red[:, :, 0] = 255
    got = np.array(images.color_histogram(red)).reshape(3, 50)
    assert len(got.ravel()) == 150 and got[0, 0] == got[1, 49] == got[2, 49] == 1.0 and got.sum() == 3.0
    half = red.copy()
    half[:2] = (0, 0, 128)  # hue 120 of 180, value 128 of 256
    got = np.array(images.color_histogram(half)).reshape(3, 50)
    assert got[0, 0] == got[0, 33] == pytest.approx(2**-0.5) and got[2, 25] == pytest.approx(2**-0.5)


def test_images_from_urls_to_features(spark):
    x = np.random.default_rng(2).integers(0, 256, (5, 6, 3)).astype(np.uint8)
    files = {"https://i.example.com/1.png": png(x, [1]), "https://i.example.com/2.png": b"broken"}

    def fetch(url):
        return files[url]

    def put(name, content):
        if content == b"broken":
            raise OSError("full")
        return f"store/{name}"

    listed = spark.createDataFrame([(7, ["https://i.example.com/1.png", "https://i.example.com/2.png", "https://i.example.com/3.png"]), (8, None)], "id long, image_urls array<string>")
    fetched = readers.fetch_images(readers.listing_images(listed), fetch)
    stored = {r["original_url"][-5]: r for r in readers.store_images(fetched, put).collect()}
    assert stored["1"]["storage_path"].startswith("store/7_00_") and stored["1"]["download_error"] is None
    assert stored["2"]["download_error"].startswith("Upload failed") and stored["3"]["download_error"].startswith("Failed to download")
    decoded = images.decode_images(fetched)
    sizes = {r["original_url"][-5]: (r["width"], r["height"]) for r in decoded.collect()}
    assert sizes == {"1": (6, 5), "2": (None, None), "3": (None, None)}
    vectors = images.feature_vectors(decoded.withColumnRenamed("original_url", "url")).where("features is not null").collect()
    assert [r["url"][-5] for r in vectors] == ["1"] and vectors[0]["features"] == pytest.approx(images.color_histogram(x))
    assert images.measure_images(decoded.withColumnRenamed("original_url", "url")).where("gradient is not null").count() == 1


def test_alerts_and_exposition(spark):
    rows = [("s", "p", "c", 10, 1, 1, 0, datetime(2024, 1, 1, k), "completed" if k == 0 else "failed", None) for k in range(6)] + [("s", "q", "c", 10, 0, 0, 3, datetime(2024, 1, 1), "completed", None)]
    log = spark.createDataFrame(rows, "session_id string, platform string, city string, listings_found int, listings_new int, listings_updated int, errors_count int, at timestamp, status string, error_message string")
    found = {(r["alert"], r["platform"]): r["message"] for r in monitoring.alerts(log).collect()}
    assert found == {("SCRAPING_FAILURES", "p"): "Consecutive failures for p in c: 5", ("HIGH_ERROR_RATE", "q"): "High error rate for q: 30.0% (3/10)"}
    lines = {r["line"] for r in monitoring.exposition(monitoring.metrics(log)).collect()}
    assert 'hearthline_runs_total{platform="p",city="c",status="failed"} 5' in lines


def test_nested_columns_as_json(spark):
    df = conform(spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id long, amenities array<string>"), defaults={"is_active": True})
    text = to_json_columns(df)
    assert text.where("id = 1").first()["amenities"] == '["a","b"]' and text.first()["is_active"] is True
    assert from_json_columns(text, LISTING).orderBy("id").select("amenities").collect() == df.orderBy("id").select("amenities").collect()


def test_relations_and_nearest(spark):
    listings = spark.createDataFrame([(1, 34.0, -6.8), (2, 34.5, -6.8), (3, None, None)], "id long, latitude double, longitude double")
    pois = spark.createDataFrame([(9, "schools", 34.001, -6.8), (8, "parks", 34.0, -6.8)], "poi_id long, category string, latitude double, longitude double")
    got = {r["id"]: r["nearest_poi"] for r in enrich.nearest(listings, pois, 200.0, most=100_000.0).collect()}
    assert got == {1: 8, 2: 9, 3: None} and {r["id"]: r["nearest_poi"] for r in enrich.nearest(listings, pois, 200.0).collect()} == {1: 8, 2: None, 3: None}
    facts = spark.createDataFrame([(1, 5.0)], "listing_id long, walkability_score double")
    photos = spark.createDataFrame([(1, "b"), (1, "a")], "listing_id long, original_url string")
    rows = {r["id"]: r for r in enrich.with_relations(listings, facts, photos).collect()}
    assert rows[1]["enrichment"]["walkability_score"] == 5.0 and [i["original_url"] for i in rows[1]["images"]] == ["a", "b"] and rows[2]["enrichment"] is None and rows[2]["images"] == []


def test_text_columns_and_reports(spark):
    texts = ["the sea view flat", "sea view house", "old house garden", "sea house", "", None, "flat sea view"] * 3
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, title_cleaned string, description_cleaned string")
    wide = encoding.text_columns(df, least=3, features=4, least_length=5)
    names = [t for t, _ in encoding.tfidf_terms(df, "title_cleaned", 4, 3)]
    assert names == ["house", "sea", "sea view", "view"] and [c for c in wide.columns if "tfidf" in c] == [f"title_cleaned_tfidf_{i}" for i in range(4)]
    long = {(r["id"], r["term"]): r["weight"] for r in encoding.tfidf(df, "id", "title_cleaned", 4, 3).collect()}
    for r in wide.collect():
        row = [r[f"title_cleaned_tfidf_{i}"] for i in range(4)]
        assert row == [long.get((r["id"], t), 0.0) for t in names]
        assert not any(row) or sum(x * x for x in row) == pytest.approx(1.0)
    encoder = encoding.fit(spark.createDataFrame([(k, c) for k, c in enumerate("aabbcc")], "id long, kind string"), {"kind": "onehot"})
    found = encoding.report(encoder)
    assert [tuple(r) for r in found.collect()] == [("kind", "onehot", 3, 3, ["kind_a", "kind_b", "kind_c"])]
    assert [tuple(r) for r in encoding.report_totals(found).collect()] == [("onehot", 1, 3)]


def test_terms_are_counted_among_frequent_words_first(spark, monkeypatch):
    among, plain = [], encoding._top_terms
    monkeypatch.setattr(encoding, "_top_terms", lambda rows, words, *rest: among.append(words) or plain(rows, words, *rest))
    monkeypatch.setattr(encoding, "LEAST_WORDS", 6)

    def check(texts: list[str | None], features: int) -> None:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
        n, found = Counter(), Counter()
        for t in texts:
            words = [w for w in (t or "").lower().split() if w not in encoding.STOP_WORDS]
            own = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
            n.update(own)
            found.update(set(own))
        top = sorted((t for t in n if 2 <= found[t] <= 0.9 * len(texts)), key=lambda t: (-n[t], t))[:features]
        assert encoding.tfidf_terms(df, "text", features, 2, 0.9) == sorted((t, math.log((1 + len(texts)) / (1 + found[t])) + 1) for t in top)

    # Word k is in every k-th text: only the most frequent words and pairs of them are counted.
    check([" ".join(f"w{k}" for k in range(1, 41) if i % k == 0) + " the w1 w1" for i in range(80)] + ["", None], 1)
    assert [len(w) for w in among] == [8]
    # So are all words if there are no more.
    among.clear()
    check([f"a{i % 20} b{i % 20}" for i in range(80)], 5)
    assert [len(w) for w in among] == [40]
    # Words left out are as frequent, so all terms are counted.
    among.clear()
    check([f"a{i % 30} the b{i % 30} a{i % 30}" for i in range(90)], 2)
    assert among[-1] is None and len(among) == 2


def test_long_chains_are_grouped_greedily(spark):
    links = [(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 0.9), (100, 102, 0.9), (101, 103, 0.9), (200, 201, 0.1)]
    found = spark.createDataFrame(links, "a long, b long, similarity double")
    got = {r["id"]: r["group_id"] for r in dedup.groups(None, found).collect()}
    # Every second listing of the chain leads its successor; the last one is alone. 101 is a member, so 103 leads and is alone.
    assert got == {i: i - i % 2 for i in range(40)} | {100: 100, 101: 100, 102: 100}


def test_page_profile():
    page = '<head><meta name="a" content="b"><meta property="og:x" content="y"><script type="application/ld+json"> {"k": 1} </script></head><h2>T</h2><div data-id="3" class="x y"><a href="/fr/a/12/z">l</a> 3 chambres, 80 m², 90 000 DH</div>'
    got = dom.profile(page)
    assert got["meta"] == {"a": "b", "og:x": "y"} and got["linked_data"] == ['{"k": 1}'] and got["data_attributes"] == {"data-id": 1}
    assert got["headings"] == ["T"] and got["listing_links"] == ["/fr/a/12/z"] and got["classes"] == {"x": 1, "y": 1}
    assert (got["rooms"], got["surfaces"], got["prices"]) == (["3 chambre"], ["80 m²"], ["90 000 DH"])


def test_pages_as_a_data_source(spark):
    base, fetch = site(2)
    readers.register_connector("source", fetch)
    name = datasource.register_pages(spark, "source")
    urls = [f"{base}/fr/a/{i}/x" for i in range(5)]
    pages = spark.read.format(name).option("urls", "\n".join(urls)).option("size", "2").load()
    got = {r["url"]: (r["html"] is not None, r["error"]) for r in pages.collect()}
    assert got == {u: (i != 1, "gone" if i == 1 else None) for i, u in enumerate(urls)}
    assert dom.listings(pages, base).count() == 3 and spark.read.format(name).load().count() == 0


def test_one_address_and_workflow_report(spark):
    cache = spark.createDataFrame([("12 rue A, rabat, Morocco", 34.0, -6.8)], "address string, lat double, lon double")
    assert [tuple(r) for r in coordinates.geocode_address(cache, "12 rue A", "rabat").collect()] == [(34.0, -6.8)]
    df = spark.createDataFrame([(i, "rabat", 900_000.0 + i, 80.0, 3, "apartment") for i in range(30)], "id long, city string, price_mad double, surface_m2 double, rooms int, property_type string")
    result = workflow.Workflow(workflow.Options(steps=("outliers", "prices"))).run(df)
    rows = {(r["section"], r["name"]): r["value"] for r in result.report().collect()}
    assert rows["run", "steps"] == rows["run", "completed"] == 2 and rows["data", "rows"] == 30 and 0 < rows["quality", "overall_score"] <= 1
    assert result.step("prices")["status"] == "completed" and result.step("text") is None
