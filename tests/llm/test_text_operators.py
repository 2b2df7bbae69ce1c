"""The operators on small tables: nulls, empty and long texts, repeated rows,
clashing columns, empty tables; and the queries against SQL or plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from graphmill.llm import bpe, html_extract, license_scan, media, quality, secret_scan, simhash, source_mix, toxicity, warc
from graphmill.llm.queries import ORACLES, QUERIES
from tests.llm.test_text_functions import plain_base, plain_fingerprint, plain_kneser_ney, roots
from tests.oracle import connect, same

LONG = " ".join(f"word{i % 997}" for i in range(60_000))
TEXTS = [
    (1, "one two three four five six seven\npassword = 'abcdef123456'", "en", "a", 10), (2, "one two three four five six seven\npassword = 'abcdef123456'", "en", "a", 10),
    (2, "one two three four five six seven\npassword = 'abcdef123456'", "en", "a", 10), (3, "", "de", "b", 0), (4, None, None, None, None), (None, "Released under the MIT License.", "en", None, 31),
    (None, None, "en", "b", None), (5, LONG, "en", "c", len(LONG)), (6, " \t\n", "en", "b", 3), (7, "é日本 \x1c idiot", "en", "c", 12), (8, LONG, "fr", "a", len(LONG)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["row", "mix", "spans", "words", "fp", "key", "size", "license", "dice", "ratio", "kept", "lines", "toxicity", "id", "order", "copies", "hot"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(1, 9)] + [(None, 1, None), (9, None, True)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))


def text_rows():
    return [(i, t or "") for i, t, *_ in TEXTS]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf):
    same(QUERIES[name](spark, sf), connect(sf), ORACLES[name])


def test_secret_scan(spark, wide):
    found = secret_scan.with_spans(wide)
    assert found.count() == len(TEXTS) and found.where("row <> 'own row'").isEmpty()
    for r in found.collect():
        assert [(s.start, secret_scan.KINDS.index(s.kind), s.end) for s in r.spans if s.kind != "literal"] == plain_base(r.text or "")
    cut = secret_scan.redact(wide)
    assert cut.columns == wide.columns and cut.where("text LIKE '%abcdef123456%'").isEmpty()
    assert cut.where("doc_id = 1 AND n_chars = length(text)").count() == 1 and cut.where("text IS NULL AND n_chars IS NULL").count() == 2
    assert secret_scan.with_spans(wide.limit(0)).isEmpty() and secret_scan.redact(wide.limit(0)).isEmpty()


def test_secret_query_counts(spark, sf):
    for r in QUERIES["op1_secret_scan"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        base = plain_base(r.text or "")
        joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert not joined or set(joined.split(",")) <= set(r.spans.split(","))


def test_source_mix(spark, wide):
    planned = source_mix.plan_mix(wide)
    assert planned.count() == len(TEXTS) and planned.where("row <> 'own row'").isEmpty()
    by = {r.source: r for r in planned.groupBy("source").agg(F.max("mix.source_size").alias("size"), F.max("mix.target").alias("target")).collect()}
    total = sum(r["size"] for r in by.values())
    assert abs(sum(r.target for r in by.values()) - total) < 1e-6 * total
    assert all(r.target <= 3 * r["size"] + 1e-9 for r in by.values()) and by["b"]["size"] == 0 == by["b"].target
    mixed = source_mix.mix_sources(wide)
    assert mixed.columns == wide.columns and mixed.where("mix <> 'own mix'").isEmpty()
    assert sorted(map(str, mixed.collect())) == sorted(map(str, source_mix.mix_sources(wide.repartition(7)).collect()))
    assert source_mix.mix_sources(wide.limit(0)).isEmpty()


def test_mix_salted_join_agrees(spark, docs, monkeypatch):
    want = sorted(map(str, source_mix.plan_mix(docs).collect()))
    monkeypatch.setattr(source_mix, "BROADCAST_ROWS", 0)
    assert sorted(map(str, source_mix.plan_mix(docs).collect())) == want


def test_mix_comes_near_targets(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.expr("array_join(array_repeat('w', cast(1 + id % 40 as int)), ' ')").alias("text"), F.concat(F.lit("s"), F.least(F.lit(4), F.col("id") % 12)).alias("source"))
    out = source_mix.plan_mix(rows).groupBy("source").agg(F.sum(F.col("mix.copies") * F.col("mix.size")).alias("taken"), F.max("mix.target").alias("target"))
    assert all(abs(r.taken - r.target) < 0.05 * r.target for r in out.collect())


def test_toxicity_on_odd_tables(spark, wide, labels):
    none = toxicity.fit(wide, labels.where("toxic = 0"))
    assert {r.toxicity for r in toxicity.score(wide, none).collect()} == {0.0}
    model = toxicity.fit(wide, labels)
    scored = toxicity.score(wide, model, out_col="t")
    assert scored.count() == len(TEXTS) and scored.where("t IS NULL OR t < 0 OR t > 1").isEmpty()
    assert toxicity.score(wide.limit(0), toxicity.fit(wide.limit(0), labels.limit(0))).isEmpty()


def test_toxicity_learns_and_spares_held_out_labels(spark):
    rng, words = np.random.default_rng(0), [f"w{a}{b}n" for a in "aeiou" for b in "bdfgk"]
    rows = []
    for i in range(900):
        text = list(rng.choice(words, 40))
        if i % 3 == 0:
            text[5] = "grobian" + str(rng.choice(["", "en", "isch"]))
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df)
    scored = toxicity.score(df, model).where(toxicity.fold(F.col("doc_id")) == 2)
    right = scored.where((F.col("toxicity") >= 0.3) == (F.col("toxic") == 1)).count()
    assert right > 0.97 * scored.count()
    held = df.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(df, held) == model
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == r.f for r in df.select("doc_id", toxicity.fold(F.col("doc_id")).alias("f")).collect())


def test_toxicity_counts_every_ngram(spark):
    rng = np.random.default_rng(4)
    letters = rng.choice(list("abcdefghijklmnopqrstuvwxyzéß"), (90_000, 10))
    words = ["".join(w) for w in letters]
    rows = [(i, " ".join(words[300 * i : 300 * i + 300]), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grams = set()
    for i, t, _ in rows:
        if zlib.crc32(str(i).encode()) % 4 in (0, 3):
            for w in t.split():
                padded = f"^{w}$"
                grams |= {padded[max(0, e - toxicity.ORDER) : e] for e in range(2, len(padded) + 1)}
    model = toxicity.fit(df, df)
    assert len(grams) > 250_000 and len(model.seen) == len(grams) and model.seen.find(toxicity.hashes_of(list(grams)))[1].all()


def test_toxicity_against_plain_kneser_ney(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdé"), int(rng.integers(1, 9)))) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(words, 12)), [0, 1, None][i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fit = {c: [w for i, t, k in rows if k == c and zlib.crc32(str(i).encode()) % 4 in (0, 3) for w in t.split()] for c in (0, 1)}
    plain = plain_kneser_ney([w for _, t, _ in rows for w in t.split()], fit[0], fit[1])
    ratios = toxicity.WordRatios(toxicity.fit(df, df))
    asked = [*words, "xyz", "abx", "a", "", "dcbaabcd"]
    ratios.learn(asked)
    assert all(math.isclose(ratios[w], plain(w), rel_tol=1e-5, abs_tol=1e-5) for w in asked)


def plain_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    codes = sorted({p for _, p in prints})
    root = roots(codes, [(a, b) for k, a in enumerate(codes) for b in codes[k + 1 :] if (a ^ b).bit_count() <= 4])
    low = {}
    for i, p in prints:
        if i is not None:
            low[root[p]] = min(low.get(root[p], i), i)
    return sorted(((i, f"{p:016x}", low.get(root[p])) for i, p in prints), key=repr)


def found_components(df, **options):
    out = simhash.near_duplicates(df, **options)
    return sorted((tuple(r) for r in out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()), key=repr)


def test_near_duplicates(spark, wide, monkeypatch):
    want = plain_components(text_rows())
    assert found_components(wide) == want
    assert simhash.near_duplicates(wide.limit(0)).isEmpty()
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(["a", "b", "c", "d"], 60)) for _ in range(6)]
    texts = [(i, base[i % 6] + " x" * int(rng.integers(0, 12))) for i in range(240)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert found_components(df) == plain_components(texts)
    monkeypatch.setattr(simhash, "BUCKET", 3)  # nearly all buckets are dealt out again, more than once
    monkeypatch.setattr(simhash, "GROUP", 40)
    assert found_components(df) == plain_components(texts)


def test_the_query_goes_through_the_index(spark, sf):
    """Every group of the query's own fingerprints is searched from its root, and nodes are dropped."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = simhash.with_fingerprint(docs).select("fp").distinct()
    rows = simhash.grouped(prints, simhash.DISTANCE).toPandas()
    assert set(rows["used"]) == set(simhash.cuts_of(0, simhash.DISTANCE)) and len(rows) == 5 * prints.count()
    for (used, _), group in rows.groupby(["used", "group"]):
        codes = np.unique(group["fp"].to_numpy().view(np.uint64))
        links, dropped = simhash.index_links(codes, simhash.DISTANCE, simhash.unsigned(int(used)))
        assert sum(dropped) > len(codes) > len(links)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    assert {tuple(r) for r in simhash.components(chain).collect()} == {(i, 0) for i in range(301)} | {(1000, 1000), (1001, 1000)}


def plain_near(rows, similarity=0.8):
    """The smallest id of each group of near copies: (id, text) rows with distinct ids."""
    texts = {}
    for i, t in rows:
        texts.setdefault(tuple(simhash.words_of(t.encode())), []).append(i)
    words = list(texts)
    prints = [simhash.simhash_of(list(set(w))) if w else 0 for w in words]
    grams = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    every = range(len(words))
    near = roots(every, [(a, b) for a in every for b in range(a + 1, len(words)) if (prints[a] ^ prints[b]).bit_count() <= simhash.NEAR_DISTANCE])
    links = []
    for a in every:
        for b in range(a + 1, len(words)):
            if near[a] == near[b] and grams[a] and len(grams[a] & grams[b]) >= similarity * len(grams[a] | grams[b]):
                links.append((a, b))
    root = roots(every, links)
    return sorted(min(i for b in every if root[b] == a for i in texts[words[b]]) for a in set(root.values()))


def test_one_of_each(spark, wide):
    kept = simhash.keep_first(wide)
    assert kept.columns == wide.columns and kept.where("row <> 'own row'").isEmpty()
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and 4 not in ids and ids.count(5) == 1 and ids.count(None) == 1
    assert simhash.keep_first(wide.limit(0)).isEmpty()


@pytest.mark.parametrize(("pivots", "split"), [(32, 1000), (1, 3)])
def test_near_copies_against_all_pairs(spark, monkeypatch, pivots, split):
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    monkeypatch.setattr(simhash, "MORE", 2)
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng, vocabulary, rows = np.random.default_rng(2), [f"w{i}" for i in range(3000)], []
    for family in range(8):
        base = list(rng.choice(vocabulary, 120))
        for copy in range(1 + 3 * family):
            text = list(base)
            for _ in range(int(rng.integers(0, 5))):
                text[int(rng.integers(0, 120))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "one two"), (len(rows) + 3, "One  two"), (len(rows) + 4, "two one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_near([(i, t or "") for i, t in rows])
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == want
    assert 12 < len(want) < len(rows) - 30


def test_kept_texts_are_no_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").dropna(subset=["text"]).select("doc_id", "text")
    kept = simhash.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == plain_near([tuple(r) for r in docs.collect()])


PAGES = [
    (1, "http://h/a", "<article><p>own &lt;text&gt;</p></article><footer>f</footer>"), (2, "http://h/b", None), (2, "http://h/b", None), (3, None, ""), (None, "http://h/c", "<p>loose"),
    (4, "http://x/1", "<div>Home News Sport Weather Travel Culture Money About Us</div><p>first page only</p>"),
    (5, "http://X:80/2", "<div>Home News Sport Weather Travel Culture Money About Us</div><p>second page only</p>"),
    (5, "http://X:80/2", "<div>Home News Sport Weather Travel Culture Money About Us</div><p>second page only</p>"),
    (6, "http://y/2", "<div>Home News Sport Weather Travel Culture Money About Us</div><p>other host</p>"),
    (7, "http://h/d", "<main>" + "<p>long text here</p>" * 20_000),
    (8, "http://z/1", "<article><p>shared by both of the articles, so it is content</p><p>Subscribe to our letter and never miss a story</p></article><footer>Subscribe to our letter and never miss a story</footer>"),
    (9, "http://z/2", "<article><p>shared by both of the articles, so it is content</p><p>two</p></article><footer>Subscribe to our letter and never miss a story</footer>"),
]


@pytest.mark.parametrize("shard", [1, 2000])
def test_main_texts(spark, shard):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    found = sorted(((r.page_id, r.text) for r in html_extract.main_texts(pages, shard=shard).collect()), key=repr)
    menu = "Home News Sport Weather Travel Culture Money About Us"
    want = [(1, "own <text>"), (2, ""), (2, ""), (3, ""), (None, "loose"), (4, "first page only"), (5, "second page only"), (5, "second page only"), (6, f"{menu}\nother host"), (7, "\n".join(["long text here"] * 20_000))]
    want += [(8, "shared by both of the articles, so it is content\nSubscribe to our letter and never miss a story"), (9, "shared by both of the articles, so it is content\ntwo")]
    assert found == sorted(want, key=repr)
    assert html_extract.main_texts(pages.limit(0)).isEmpty()


def test_articles_stay_whole(spark):
    """An advert or a menu that says what a paragraph says takes nothing from it; a notice in the
    articles of nearly all of a host's pages goes; copies of a page count once."""
    notice, quote = "All rights to this article are reserved by its publisher", "This one sentence of an article is quoted by many adverts"
    page = lambda i, own, more="": f"<nav>{quote}</nav><article><p>{own}</p>{more}<p>Text {i} of the article</p></article><div class=ad>{quote}</div>"
    rows = [(i, "http://a/x", page(i, quote if i == 3 else f"first {i}", f"<p>{notice}</p>" if i != 5 else "")) for i in range(20)]
    rows += [(100 + i, "http://b/x", page(1, notice, f"<p>{notice}</p>")) for i in range(30)]  # copies of one page
    rows += [(200 + i, "http://c/x", page(i, f"first {i}", f"<p>{notice}</p>" if i < 8 else "")) for i in range(20)]  # in some articles only
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.main_texts(pages).collect()}
    assert all(found[i] == f"{quote if i == 3 else f'first {i}'}\nText {i} of the article" for i in range(20))
    assert all(found[100 + i] == f"{notice}\n{notice}\nText 1 of the article" for i in range(30))
    assert all((notice in found[200 + i]) == (i < 8) for i in range(20))


@pytest.mark.parametrize("shard", [1, 300, 100_000])
def test_suffix_arrays_decide_in_articles(spark, shard):
    """Notices that stand in one block here and in two there are found as substrings; a
    block that says more than these stays whole. Nor do other hosts or copies count."""
    one, two = "All rights to this article are reserved by its publisher", "Write to the editors if you find any error in it"
    notice = lambda i: f"<p>{one} {two}</p>" if i % 2 else f"<p>{one}</p><p>{two}</p>"
    page = lambda i, end: f"<article><p>Own words {i} of this one article that nobody else has {i}</p>{end}</article>"
    rows = [(i, "http://a/x", page(i, notice(i) if i else f"<p>{one} but not this time</p>")) for i in range(20)]
    rows += [(100 + i, "http://b/x", page(i, notice(i) if i < 9 else "")) for i in range(20)]
    rows += [(200 + i, "http://b/x", page(1, notice(1))) for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r.text for r in html_extract.main_texts(pages, shard=shard).collect()}
    own = lambda i: f"Own words {i} of this one article that nobody else has {i}"
    assert found[0] == f"{own(0)}\n{one} but not this time"
    assert all(found[i] == own(i) for i in range(1, 20))
    assert all((two in found[100 + i]) == (i < 9) for i in range(20)) and all(found[200 + i] == f"{own(1)}\n{one} {two}" for i in range(100))


def test_query_keeps_every_article_block(spark, sf):
    """Against the parser alone: of the pages' declared articles nothing goes."""
    from graphmill.llm.queries import op5_html_text

    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = op5_html_text(spark, sf).collect()
    assert len(found) == len(html) and all(r.text == html_extract.main_text(html_extract.blocks_of(html[r.page_id] or "")) for r in found)


def test_repeated_runs_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    runs = [" ".join(rng.choice(list("abcdefgh"), 12)) for _ in range(3)]
    texts = [" ".join([*rng.choice(list("uvwxyz"), 6), *runs[rng.integers(0, 3)].split(), *rng.choice(list("stuvw"), 6)]) for _ in range(30)]
    pages = spark.createDataFrame([(i, "http://h/", f"<p>{t}</p>") for i, t in enumerate(texts)], "page_id long, url string, html string")
    grams = [{tuple(t.split()[k : k + html_extract.RUN]) for k in range(len(t.split()) - html_extract.RUN + 1)} for t in texts]
    count = Counter(g for gs in grams for g in gs)
    want = {}
    for i, t in enumerate(texts):
        words, gone = t.split(), set()
        for k in range(len(words) - html_extract.RUN + 1):
            if count[tuple(words[k : k + html_extract.RUN])] > 1:
                gone |= set(range(k, k + html_extract.RUN))
        want[i] = " ".join(w for k, w in enumerate(words) if k not in gone)
    for shard in (100, 100_000):
        assert {r.page_id: r.text for r in html_extract.main_texts(pages, shard=shard).collect()} == want


def test_media(spark, wide):
    found = sorted((tuple(r) for r in media.round_trip(wide).collect()), key=repr)
    want = []
    for i, t in text_rows():
        data = t.encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        image = media.to_png(payload)
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), media.features(payload)))
    assert found == sorted(want, key=repr)
    assert media.round_trip(wide.limit(0)).isEmpty()


def test_media_ranges_hold_each_member_once(spark, docs, tmp_path, monkeypatch):
    manifest = media.write_archives(docs.repartition(3), str(tmp_path), max_archive_bytes=1000, range_bytes=300)
    (tmp_path / "orphan.zip").write_bytes(b"cut short")
    found = media.read_archives(spark, manifest)
    assert found.count() == len(TEXTS) and found.select("archive", "offset").distinct().count() == len(TEXTS)
    assert found.rdd.getNumPartitions() == spark.read.parquet(manifest).count() > 3
    images = {(r.doc_id, bytes(r.media)) for r in found.collect()}
    assert images == {(i, media.to_png(media.padded(t.encode()))) for i, t in text_rows()}


def test_bpe(spark, wide):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokenizer = bpe.Tokenizer(spark, path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parsed_ranks(open(path, "rb").read()), special_tokens={})
    both = wide.select("text", tokenizer.round_trip("text").alias("b"), tokenizer.encode("text").alias("ids"))
    for r in both.select("*", tokenizer.decode("ids").alias("decoded")).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert r.b.ids == r.ids and r.decoded == r.b.decoded == (r.text or "")
    assert wide.limit(0).select(tokenizer.encode("text")).isEmpty()


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, wide, labels):
    weights = quality.ratios(wide, labels)
    judged = quality.judge(wide, weights)
    assert len(weights) == quality.BUCKETS and judged.where("row <> 'own row'").isEmpty() and judged.columns.count("kept") == 1
    for r in judged.collect():
        counts = plain_counts(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0]) and r.kept in (True, False)
    assert set(quality.ratios(wide, labels.limit(0))) == {0.0}
    assert quality.judge(wide.limit(0), quality.ratios(wide.limit(0), labels)).isEmpty()


def plain_buckets(text):
    """Of the lower-cased words and of the pairs of neighbours."""
    hashes = [xxhash.xxh64_intdigest(w.lower().encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(hashes, hashes[1:])]
    return [x % quality.BUCKETS for x in hashes + pairs]


def plain_ratios(docs, good):
    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(plain_buckets(t))
        if i in good:
            target.update(plain_buckets(t))
    n = [sum(c.values()) + quality.SMOOTH * quality.BUCKETS for c in (raw, target)]
    value = {b: math.log((target[b] + 1) / n[1]) - math.log((raw[b] + 1) / n[0]) for b in raw}
    return {i: sum(map(value.get, plain_buckets(t))) / max(1, len(plain_buckets(t))) for i, t in docs}


def test_quality_ratio_against_plain_counts(spark, sf):
    con = connect(sf)
    docs = con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    good = {r[0] for r in con.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    want = plain_ratios(docs, good)
    found = QUERIES["op8_quality"](spark, sf).collect()
    assert len(found) == len(docs) and all(math.isclose(r.ratio, want[r.doc_id], abs_tol=1e-9) for r in found)
    assert all(r.kept == (not r.base_failed and r.ratio >= quality.THRESHOLD) for r in found)


def test_quality_ratio_of_lower_cased_words_and_pairs(spark):
    eight = "one two three four five six seven eight"
    texts = {1: "The red fox sees the dog", 2: "the dog sees THE red Fox", 3: "ÉTÉ", 4: "", 5: f"{eight} {eight.upper()}", 6: f"{eight} {eight}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    want = plain_ratios(list(texts.items()), {1})
    found = {r.doc_id: r for r in quality.judge(docs, quality.ratios(docs, labels)).collect()}
    assert all(math.isclose(found[i].ratio, want[i], abs_tol=1e-9) for i in texts)
    assert found[1].ratio > found[2].ratio + 1e-6  # the same words, other pairs
    assert (found[5].n_repeat_words, found[6].n_repeat_words) == (0, 16)


def test_license(spark, wide, tmp_path):
    found = license_scan.with_license(wide)
    assert found.where("row <> 'own row'").isEmpty() and found.count() == len(TEXTS)
    assert [r.license for r in found.where("license IS NOT NULL").collect()] == ["MIT"]
    prose = "Some text before it.\n\nAnd more of it, in two paragraphs."
    files = [(name, f"{prose}\n\n{t}\n\nMore text follows here.") for name, t in license_scan.TEMPLATES]
    files += [(name, f"{name}\n\nCopyright (c) 2024, Some One\nAll rights reserved.\n\n" + t.replace("\n\n", "\n \n")) for name, t in license_scan.TEMPLATES if "\n\n" in t]
    extra = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(files)], "doc_id long, text string")
    names = {r.doc_id: r.license for r in license_scan.with_license(extra).collect()}
    assert [names[i] for i in range(len(files))] == [name for name, _ in files]
    con = duckdb.connect()
    for name, df in (("odd", wide), ("extra", extra)):
        df.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    same(found.select("doc_id", "license", "dice", "n_licenses"), con, license_scan.oracle("odd"))
    same(license_scan.with_license(extra).select("doc_id", "license", "dice", "n_licenses"), con, license_scan.oracle("extra"))
    assert license_scan.with_license(wide.limit(0)).isEmpty()


def test_warc(spark, monkeypatch):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (None, "u", "same"), (None, "u", "alone"), (5, "ü \n", "é" * 100_000)] + [(i, "u", "hot") for i in range(10, 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("digest", F.lit("x"))
    for hot in (1000, 1):
        monkeypatch.setattr(warc, "HOT", hot)
        found = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
        assert found[1, 4] == ("response", None) and found[2, 4] == ("revisit", 1) and found[None, 4] == ("revisit", 1)
        assert found[3, 0] == ("response", None) and found[4, 0] == ("revisit", 3) and found[None, 5] == ("response", None)
        assert found[10, 3] == ("response", None) and found[2999, 3] == ("revisit", 10) and found[5, 200_000][0] == "response"
    assert warc.round_trip(pages.limit(0)).isEmpty()
    kinds = {r.record_type for r in warc.round_trip(pages, min_bytes=5).where("page_id < 5").collect()}
    assert kinds == {"response"}
    monkeypatch.setattr(warc, "MAX_BITS", 1)
    full = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert full == found


def test_warc_repeat_bit(spark):
    keyed = spark.range(40_000).select("id", F.unhex(F.sha1(F.col("id").cast("string").cast("binary"))).alias("digest"))
    marked = warc.with_repeat_bit(keyed, keyed.where("id % 10 = 0"))
    found = {(r.of_repeats, r.repeats): r["count"] for r in marked.groupBy((F.col("id") % 10 == 0).alias("of_repeats"), "repeats").count().collect()}
    assert found[True, True] == 4_000 and (True, False) not in found
    assert found[False, False] > 36_000 * 0.9
    assert not warc.with_repeat_bit(keyed, keyed.limit(0)).where("repeats").count()


def test_pipeline(spark, sf, wide, labels, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scans", "source_mix", "byte_bpe"]
    wide.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
        assert stage(spark, docs.limit(0), d).isEmpty(), name
    assert corpus_pipeline.run(spark, d).columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
    # On whole tables: every stage against a plain version on its own input.
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.not_toxic(spark, docs, sf)
    scores = {r.doc_id: r.predicted for r in QUERIES["op3_toxicity"](spark, sf).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if not p}
    first = corpus_pipeline.one_of_each(spark, kept, sf)
    assert sorted(r.doc_id for r in first.collect()) == plain_near([(r.doc_id, r.text or "") for r in kept.collect()])
    clean = corpus_pipeline.without_secrets(spark, first, sf).collect()
    before = {r.doc_id: r for r in first.collect()}
    assert all(r.text == secret_scan.redacted_text(before[r.doc_id].text) for r in clean) and len(clean) == len(before)
    assert all(r == before[r.doc_id] for r in clean if not secret_scan.spans_of(before[r.doc_id].text))
