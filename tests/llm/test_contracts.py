"""Registered queries and pipeline stages: columns, plain versions, and awkward or empty tables."""

import bisect
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hearthline.llm import common, exact_dedup, minhash_dedup, mixing, pii, queries, secret_scan, sharding, toxicity, url_filter
from hearthline.llm import sentencepiece_codec as codec
from hearthline.llm.embed_dedup import near_duplicate_vectors
from tests.llm.test_operators import SF, WORDS, awkward, brute_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

CONTRACT = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string, bucket int, depth int",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string, score double",
    "op5_sentencepiece": "doc_id bigint, ids array<int>, n_tokens int, exact boolean",
    "op6_pii": "doc_id bigint, text string, n_entities int, kinds map<string,int>",
    "op7_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op9_minhash_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "pipeline": "doc_id bigint, lang string, source string, ids array<int>, n_tokens bigint",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_of_the_query(spark, name):
    got = queries.queries()[name](spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in got.schema.fields) == CONTRACT[name]
    rows = {"op4_url_filter": "pages", "op8_embedding_dedup": "embeddings"}.get(name, "documents")
    assert name == "pipeline" or got.count() == spark.read.parquet(f"{SF}/{rows}.parquet").count()


def test_exact_dedup_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {r[0]: r for r in c.sql(queries.oracle_sql()["op2_exact_dedup"]).fetchall()}
    got = {r[0]: tuple(r) for r in queries.op2_exact_dedup(spark, SF).collect()}
    assert got == want


def test_split_buckets_are_looked_up(spark):
    """With buckets of a few keys, the directory doubles and rows find their chains through it."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {r[0]: r for r in c.sql(queries.OP2_SQL.replace("<= 4096", "<= 5")).fetchall()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r[0]: tuple(r) for r in exact_dedup.exact_duplicates(docs, capacity=5).collect()}
    assert got == want and len({r[5] for r in got.values()}) > 20 and max(r[6] for r in got.values()) > 4


def test_full_bitmaps_lose_nothing(spark, monkeypatch):
    """With bitmaps so small that nearly every key may be shared, results are the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    exact, near = plain(exact_dedup.exact_duplicates(docs)), plain(minhash_dedup.near_duplicates(docs))
    left = [sorted(r["doc_id"] for r in f(docs).collect()) for f in (exact_dedup.drop_exact_duplicates, minhash_dedup.drop_near_duplicates)]
    monkeypatch.setattr(common, "MIN_BITS", 6)
    monkeypatch.setattr(common, "MAX_BITS", 6)
    assert plain(exact_dedup.exact_duplicates(docs)) == exact and plain(minhash_dedup.near_duplicates(docs)) == near
    assert [sorted(r["doc_id"] for r in f(docs).collect()) for f in (exact_dedup.drop_exact_duplicates, minhash_dedup.drop_near_duplicates)] == left


def test_shards_equal_prefix_sums(spark):
    df = awkward(spark).select("doc_id", "text")
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect()))
    total, before, want = sum(s for _, s, _ in rows), 0, Counter()
    slots = Counter()
    for i, s, c in rows:
        shard = min(3, (2 * before + s) * 4 // (2 * total))
        want[i, s, c, shard, slots[shard]] += 1
        slots[shard] += 1
        before += s
    got = Counter((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard_by_bytes(df, 4).collect())
    assert got == want


def test_toxicity_finds_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op3_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["predicted"] == (r["score"] >= 0.3) and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    hits = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1]
    wrong = [r["predicted"] for r in rows if labels[r["doc_id"]] == 0]
    assert len(hits) > 50 and np.mean(hits) > 0.9 and np.mean(wrong) < 0.01


def test_toxicity_of_empty_and_clashing_tables(spark):
    df = awkward(spark).withColumns({"_toxicity": F.lit(5), "text_": F.lit(1)})
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    left = toxicity.drop_toxic(df, labels)
    assert left.columns == df.columns and left.count() <= df.count()
    assert toxicity.drop_toxic(df, labels.where("false")).count() == df.count()
    assert toxicity.drop_toxic(df, labels.where("toxic = 1").withColumn("doc_id", F.explode(F.array(*[F.lit(k) for k in range(1, 12)])))).count() in (0, df.count())
    assert toxicity.drop_toxic(df.where("false"), labels).count() == 0
    one = toxicity.Model({}, np.zeros(1, np.float32), toxicity.Trees(cuts=[np.zeros(0)] * toxicity.N_FEATURES), (np.array([-1.0, 1.0]), np.array([1.0, 1.0])))
    assert {r["score"] for r in toxicity.score(awkward(spark), one).collect()} == {1.0}


def test_vectors_equal_plain_counts():
    codes = toxicity.Codes({"idiot": 0, "lose-": 1})
    weights = np.array([2.0, 1.5], np.float32)
    texts = ["", "You are an IDIOT!! loser, id!ot $tupid yes?", " \n", "a", "!?", "clean text... here", "idiot " * 50 + "you", "é!" * 9]
    got = toxicity.features(texts, codes, weights)
    assert all((toxicity.features([t], codes, weights)[0] == got[k]).all() for k, t in enumerate(texts))
    n = 8
    # Two whole or partial entries and a veiled one; one second-person word, near the first entries only.
    assert got[1, :6] == pytest.approx([3 / n, 5.5 / n, 2.0, 2, 1 / n, 2.0], rel=1e-6)
    assert got[1, 7:12] == pytest.approx([1, 1 / n, 1 / 3, 3 / np.sqrt(n), 1 / n], rel=1e-6)
    assert got[1, 16:20] == pytest.approx([3 / n, 1 / n, 1 / n, np.log1p(n)], rel=1e-6)
    assert not got[0].any() and not got[2].any() and got[5, 18] == pytest.approx(1 / 3) and got[6, 9] == pytest.approx(3 / 50)


def plain_bayes(urls):
    """The two fits of the url classifier with dictionaries, and the odds of every url."""
    seg = url_filter.Segmenter(url_filter.load_words())
    pages = [seg.tokens(h, p) for h, p in urls]

    def fit(weights, masked):
        count, total = (Counter(), Counter()), [0.0, 0.0]
        for tokens, w in zip(pages, weights, strict=True):
            for c, x in ((0, 1 - w), (1, w)):
                total[c] += x
                for t in tokens:
                    if x and not (masked and t[2:] in url_filter.SEEDS):
                        count[c][t] += x
        whole = count[0] + count[1]
        every, a = sum(whole.values()), url_filter.PRIOR_TOKENS
        part = lambda c, t: (count[c][t] + a * whole[t] / every) / (sum(count[c].values()) + a)
        like = {t: math.log(part(1, t)) - math.log(part(0, t)) for t in whole}
        prior = math.log((total[1] + 0.5) / (total[0] + 0.5))
        return lambda tokens: prior + sum(like.get(t, 0.0) for t in tokens)

    first = fit([float(any(t[2:] in url_filter.SEEDS for t in p)) for p in pages], True)
    chance = [1 / (1 + math.exp(-first([t for t in p if t[2:] not in url_filter.SEEDS]))) for p in pages]
    second = fit([round(1000 * x) / 1000 for x in chance], False)
    return [second(p) for p in pages]


def made_urls():
    rng = random.Random(2)
    bad, good = ["cheap", "win", "bonus", "free", "deal"], ["garden", "music", "school", "river", "news", "city"]
    seeds = ["casino", "pills", "poker"]
    urls = []
    for k in range(400):
        if k % 8 == 0:
            urls.append(f"http://www.{rng.choice(bad)}{rng.choice(seeds)}{rng.choice(bad)}.example.org/{rng.choice(bad)}/{k}")
        else:
            urls.append(f"http://{rng.choice(good)}{rng.choice(good)}.example.com/{rng.choice(good)}/{k}")
    # One harmless host holds a seed word; hosts without any seed keep the company of blocked ones.
    urls += [f"http://gardenriverpoker.example.com/music/school/{k}" for k in range(3)]
    return urls, ["http://freebonusdeal.example.org/win/1", "http://cheapwin.example.org/bonus/2"], ["http://musicschool.example.com/garden/3"]


def test_url_verdicts_come_from_evidence_without_seeds(spark):
    urls, hidden, clean = made_urls()
    every = urls + hidden + clean
    df = spark.createDataFrame(list(enumerate(every)), "page_id long, url string").repartition(3)
    got = {r["page_id"]: r for r in url_filter.judge(df, rules=()).collect()}
    odds = plain_bayes([(got[k]["host"], got[k]["path"]) for k in range(len(every))])
    assert [got[k]["score"] for k in range(len(every))] == pytest.approx(odds, rel=1e-6)
    verdict = [got[k]["verdict"] for k in range(len(every))]
    assert [verdict[k] for k in range(0, 400, 8)] == ["block"] * 50 and verdict[400:403] == ["allow"] * 3
    assert verdict[403:] == ["block", "block", "allow"]


def test_urls_of_empty_and_awkward_tables(spark):
    schema = "page_id long, url string"
    rows = [(1, "http://" + "a" * 60_000 + ".com/" + "ü" * 60_000), (None, None), (2, "://"), (2, "://"), (3, "http://xn--é.com/%E6%97%A5%ZZ"), (4, "http://localhost/naïve/日本")]
    df = spark.createDataFrame(rows, schema).withColumns({"host": F.lit(1), "id": F.lit(2), "rule": F.lit("x"), "score": F.lit(9.0)})
    got = url_filter.judge(df)
    assert got.count() == 6 and {r["verdict"] for r in got.collect()} == {"allow"}
    assert url_filter.judge(df.where("false")).count() == 0


def plain_replacement(texts):
    """Surrogates by a plain loop over the values of all texts, and the texts with them."""
    names = {(p[0][3], p[1][3]) for t in texts if t for _, p in pii.titled(t) if len(p) == 2}
    values, gender = set(), Counter()
    pairs = [frozenset(pii.capitalised_pairs(t or "") & names) for t in texts]
    for t, known in zip(texts, pairs, strict=True):
        values |= {(k, v) for *_, parts in pii.find(t or "", known) for *_, k, v in parts}
        for g, parts in pii.titled(t or ""):
            gender.update({v: g for *_, k, v in parts if k == "given"})
    sign = lambda v: (gender[v] > 0) - (gender[v] < 0)
    attempt = dict.fromkeys(values, 0)
    while True:
        to = {(k, v): pii.surrogate(k, v, n, sign(v) if k == "given" else 0, pii.DEFAULT_KEY) for (k, v), n in attempt.items()}
        claims = {}
        for (k, v), s in to.items():
            claims.setdefault((k, s), []).append(v)
        again = [(k, v) for (k, s), vs in claims.items() for v in vs if (k, s) in values or v != min(vs)]
        if not again:
            break
        for x in again:
            attempt[x] += 1
    out = []
    for t, known in zip(texts, pairs, strict=True):
        for a, b, k, v in sorted((p for *_, parts in pii.find(t or "", known) for p in parts), reverse=True):
            t = t[:a] + pii.dress(k, t[a:b], to[k, v]) + t[b:]
        out.append(t)
    return out


NAMES = [
    "Mr. John Smith met Ms Anna Keller. Later Mr Smith and SMITH spoke with Anna.",
    "Mr John Smith; Anna Keller wrote to john@example.com, Dr. Smith read it.",
    "Anna Keller, Anna Kellerman and Keller Anna. The Smith shop is not named here.",
    "Доктор Иван Петров и Госпожа Анна Петров, Иван пришёл. Κύριος Νίκος Παππάς",
    "Herr Müller-Lüdenscheidt, Frau Maria Garcia; Señor Garcia. Mr lower case, Mrs. X",
    None, "", "Smith", "Herr " + "Adler " * 3000,
]


def test_names_stay_coreferent(spark):
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(spark.createDataFrame(list(enumerate(NAMES)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(NAMES))] == plain_replacement(NAMES)
    first, second = got[0].split(), got[1].split()
    given, surname = first[1], first[2]
    assert second[:3] == ["Mr", given, surname + ";"] and f"Mr {surname} and {surname.upper()}" in got[0]
    anna, keller = first[5], first[6].rstrip(".")
    assert f"{anna} {keller} wrote" in got[1] and got[2].startswith(f"{anna} {keller}, {anna} Kellerman and {keller} {anna}. The Smith shop")
    assert anna in pii.FEMALE and given in pii.MALE and "Петров" not in got[3] and "Παππάς" not in got[3] and "Иван" not in got[3]
    assert got[7] == "Smith" and "Garcia" not in got[4]


def test_replacement_equals_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r["text"] for r in docs] + NAMES
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(df).collect()}
    assert [got[k] for k in range(len(texts))] == plain_replacement(texts)


def test_replacement_of_empty_and_clashing_tables(spark):
    df = awkward(spark).withColumns({c: F.lit("x") for c in ("map", "kind", "value", "kinds", "n_entities")})
    got = pii.replace_pii(df)
    assert Counter(r["text"] for r in got.collect()) == Counter(r["text"] for r in df.collect()) and got.count() == 13
    assert pii.replace_pii(df.where("false")).count() == 0
    long = spark.createDataFrame([(1, "a" * 2_000_000 + " x@example.com " + "1" * 500_000), (1, None)], "doc_id long, text string")
    assert sorted(r["n_entities"] for r in pii.replace_pii(long).collect()) == [0, 1]


def test_secrets_and_pieces_of_empty_and_clashing_tables(spark):
    df = awkward(spark).withColumns({c: F.lit("x") for c in ("spans", "n_tokens", "exact", "base")})
    found = secret_scan.digest(secret_scan.find_secrets(df))
    assert found.count() == 13 and secret_scan.find_secrets(df.where("false")).count() == 0
    long = spark.createDataFrame([(1, "é" * 3_000_000 + " token=12345678"), (1, "é" * 3_000_000 + " token=12345678"), (None, None)], "doc_id long, text string")
    assert Counter(r["spans"] for r in secret_scan.digest(secret_scan.find_secrets(long)).collect()) == Counter({"assign:3000001:3000015": 2, "": 1})
    encoded = codec.encode(df, verify=True)
    assert encoded.count() == 13 and codec.encode(df.where("false")).count() == 0 and codec.decode(encoded.where("false")).count() == 0
    # Each text alone gives the same pieces as the query.
    c = codec.load_codec()
    for r in codec.encode(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert r["ids"] == c.encode(r["text"])


def test_links_of_missing_and_repeated_vector_ids(spark):
    schema = "vec_id long, embedding array<double>"
    near = lambda *rows: sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in near_duplicate_vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], schema)).collect())
    assert near((1, [1.0, 0, 0, 0.1]), (None, [1.0, 0.02, 0, 0.1])) == [("1", 1, "1"), ("None", 1, "1")]
    assert near((None, [1.0, 0, 0]), (None, [2.0, 0, 0]), (None, [0, 1.0, 0])) == [("None", 0, "None"), ("None", 1, "None"), ("None", 1, "None")]
    # Rows of id 5 count their own links and share a component.
    assert near((5, [1.0, 0, 0]), (5, [0, 0, 1.0]), (3, [0.01, 0, 1.0]), (9, [0, 1.0, 0])) == [("3", 1, "3"), ("5", 0, "3"), ("5", 1, "3"), ("9", 0, "9")]


def test_planted_vectors_are_all_linked(spark):
    """Pairs at cosine 0.95 to 0.96 in 64 dimensions, where candidates are hardest to find."""
    rng = np.random.default_rng(12)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.96, (3000, 1))
    both = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * b])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    rows = near_duplicate_vectors(df).collect()
    found = sum(r["n_links"] for r in rows)
    assert found >= 0.999 * 6000 and all(r["component_id"] == r["vec_id"] % 3000 for r in rows if r["n_links"])


def plain_mix(rows, max_repeats=3, weights=(1, 2, 3)):
    """Repeats by row ``id, source, size, hash``: targets by bisection, thresholds by sorted hashes."""
    sizes = Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, lo, hi = sum(sizes.values()), 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(max_repeats * sizes[s], mid * weight[s]) for s in sizes) < total else (lo, mid)
    out = {}
    for s in sizes:
        target = min(max_repeats * sizes[s], lo * weight[s])
        passes = math.floor(round(target / sizes[s], 9)) if sizes[s] else 0
        cells = Counter()
        for _, t, n, h in rows:
            if t == s:
                cells[h] += n
        rest, low = target - passes * sizes[s], 0
        for h in sorted(cells):
            if cells[h] > rest:
                low = h + (2 * rest >= cells[h])
                break
            rest -= cells[h]
            low = h + 1
        for i, t, _, h in rows:
            if t == s:
                out[i] = passes + (h < low and passes < max_repeats)
    return out


def hashed(docs, seed=17):
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), 64 - mixing.BITS * mixing.LEVELS)
    return [(r["doc_id"], r["source"], len((r["text"] or "").encode().split()), r["h"]) for r in docs.withColumn("h", h).collect()]


def test_mix_equals_sorted_hashes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")))
    got = {r["doc_id"]: r["repeats"] for r in mixing.mix_sources(docs).collect()}
    assert got == plain_mix(hashed(docs))


def test_pipeline_equals_plain_stages(spark):
    """All stages of ``run`` on a whole small table against plain versions of each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = {r["doc_id"]: r for r in docs.collect()}
    codes = toxicity.Codes(model.entries)
    scores = model.score(np.concatenate([toxicity.features([r["text"] or ""], codes, model.weights) for r in rows.values()]))
    left = [i for i, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD]
    groups = {}
    for i in left:
        groups.setdefault("".join((rows[i]["text"] or "").translate(dict.fromkeys(range(9, 14), None) | {32: None})), []).append(i)
    left = [min(g, key=lambda i: (-len(rows[i]["text"] or ""), i)) for g in groups.values()]
    label = brute_components({i: minhash_dedup.shingle_set((rows[i]["text"] or "").encode()) for i in left})
    left = [i for i in left if label[i] == i]
    kept = docs.where(F.col("doc_id").isin(left))
    repeats = plain_mix(hashed(kept))
    c = codec.load_codec()
    want = Counter({(i, tuple(c.encode(rows[i]["text"]))): n for i, n in repeats.items() if n})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["source"] == rows[r["doc_id"]]["source"] and r["lang"] == rows[r["doc_id"]]["lang"] and r["n_tokens"] == len(r["ids"]) for r in got)
    assert len(left) < len(rows)


def test_stages_of_awkward_and_empty_tables(spark):
    names = [f.split(" ")[0] for f in DOCS.split(", ")]
    whole = awkward(spark)
    for docs in (whole.select(*names), whole.select(*names).where("false"), whole):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                docs = corpus_pipeline.materialise(out)
        assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens"]
        out.count()
