"""Cases that the first tests left out: brute-force versions of whole results, null and repeated ids, clashing columns, empty tables."""

import collections
import html.parser
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.llm import bpe, common, decontaminate, hilbert, langid, mainblocks, minhash, pii, urllists, vectors, warc

from test_llm_operators import DOCS, STORY, TRAIN, WORDS, brute_components, brute_vectors, docs_of, near_copies, sentences, tokenizer  # noqa: F401

SF = "/root/testdata/sf0.001"


def rows_of(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], DOCS)


# joins with hot keys


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 300 + [2] * 50 + list(range(3, 200)) + [None] * 40)], "k long, i long")
    right = spark.createDataFrame([(k, k * 10) for k in range(1, 100)], "k long, v long")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)
        assert sorted(map(tuple, common.join_hot(left, right, ["k"], 16, how).collect()), key=repr) == want


# 1


def test_langid_letters_are_unicode_letters():
    model = langid.fit([(t, lang) for k, lang in enumerate(WORDS) for t in sentences(lang, 20, k)])
    langs, scores = langid.predict(model, ["½", "²²", "123 ① _", "ß", "漢", "١٢"])
    assert langs[:3] == ["und"] * 3 and scores[:3] == [0.0] * 3 and langs[5] == "und" and "und" not in langs[3:5]
    assert langid.rejected(model, ["½", None, "漢字" * 200, "это русский текст " * 30, WORDS["de"][1] + " " + " ".join(WORDS["de"])]) == [True, True, True, True, False]


def test_langid_rejects_alike_at_every_length():
    model = langid.fit([(t, lang) for k, lang in enumerate(WORDS) for t in sentences(lang, 30, k)])
    mixed = " ".join(" ".join(words) for words in WORDS.values())
    noise = "".join(random.Random(5).choices("abcdefghijklmnop ", k=70))
    for text in (mixed, noise, "漢字", "это русский текст "):
        assert len(set(langid.rejected(model, [(text + " ") * n for n in (1, 3, 10, 100)]))) == 1
    assert langid.rejected(model, [mixed, mixed * 20]) == [False, False]


def test_langid_equals_a_plain_loop():
    model = langid.fit([(t, lang) for k, lang in enumerate(WORDS) for t in sentences(lang, 30, k)])
    texts = [t for k, lang in enumerate(WORDS) for t in sentences(lang, 10, 90 + k)] + ["a", "la", "12 de", "the das la"]
    langs, scores = langid.predict(model, texts)
    for text, lang, score in zip(texts, langs, scores):
        x = langid.features(text)
        sure = {}
        for k, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + math.exp(-2 * float(x @ model.weights[:, k].astype(float) + model.bias[k])))
            sure[a, b], sure[b, a] = p, 1 - p
        vote = lambda names: {a: sum(sure[a, b] for b in names if b != a) / (len(names) - 1) if len(names) > 1 else 1.0 for a in names}
        families = vote(model.families)
        family = max(families, key=families.get)
        within = vote(model.langs[family])
        best = max(within, key=within.get)
        assert lang == best and abs(score - families[family] * within[best]) < 1e-4


def test_langid_trains_on_whole_texts(spark):
    change = "zzz qqq " * 5000 + " ".join(sentences("de", 300, 1))
    docs = docs_of(spark, [change] * 30 + sentences("fr", 30, 2), ["de"] * 30 + ["fr"] * 30)
    assert langid.predict(langid.train(docs), sentences("de", 3, 5))[0] == ["de"] * 3


# 2


def test_shards_equal_a_plain_sort_and_keep_equal_texts_together(spark):
    texts = ["same text", "another one", None, "", "x" * 700_000] * 30 + [f"text {i}" for i in range(70)]
    rows = [(i, t, ["en", "de", None, ""][i % 4], [f"s{i % 11}", None, ""][i % 3 if i % 5 == 0 else 0]) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "same text", "fr", "s3")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, shard string")
    got = hilbert.shard(docs).collect()
    assert len(got) == len(rows)
    curve = {}
    for r in got:
        curve.setdefault((r.text_crc32, r["size"]), set()).add(r.curve)
    assert all(len(c) == 1 for c in curve.values())
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    starts = [-(-k * len(got) // 8) for k in range(9)]
    for p, r in enumerate(order):
        shard = p * 8 // len(got)
        assert (r.shard, r.slot) == (shard, p - starts[shard])
    keys = [(r.curve, r.text_crc32, r["size"]) for r in order]
    assert keys == sorted(keys)
    homes = collections.defaultdict(set)
    for r in got:
        homes[r.text_crc32, r["size"]].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 7
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows}


def test_shards_prune_by_source_and_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = hilbert.shard(docs).join(docs.select("doc_id", "lang", "source"), "doc_id")
    boxes = rows.groupBy("shard").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("lang", "source") for f in (F.min, F.max))).collect()
    read = {c: [sum(b[f"min_{c}"] <= v <= b[f"max_{c}"] for b in boxes) for (v,) in docs.select(c).distinct().collect()] for c in ("lang", "source")}
    pairs = [sum(b.min_lang <= v <= b.max_lang and b.min_source <= w <= b.max_source for b in boxes) for v, w in docs.select("lang", "source").distinct().collect()]
    assert np.mean(pairs) < 5 and np.mean(read["lang"]) < 8 and np.mean(read["source"]) < 8


# 3


def test_minhash_with_repeated_and_null_ids(spark):
    a, b = near_copies(1, 60, 0, 1)[0], near_copies(1, 60, 0, 2)[0]
    rows = [(5, a), (5, b), (8, b + " more"), (None, a + " tail"), (None, None), (None, ""), (None, "lonely words of some other text"), (None, "Lonely words of some other  text"), (9, ""), (9, None), (3, a)]
    got = sorted(map(tuple, minhash.near_duplicates(rows_of(spark, rows)).collect()), key=repr)
    n_a, n_b = 56, 56
    want = [(5, n_a, 3, False), (5, n_b, 5, True), (8, n_b + 1, 5, False), (None, n_a + 1, 3, False), (None, 0, None, True), (None, 0, None, True), (None, 2, None, True), (None, 2, None, False), (9, 0, 9, True), (9, 0, 9, True), (3, n_a, 3, True)]
    assert got == sorted(want, key=repr)
    kept = minhash.keep_one(rows_of(spark, rows))
    assert kept.columns == rows_of(spark, rows).columns
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert [r for r in left if r[0] in (3, 5, 8)] == [(3, a), (5, b)]
    assert sum(r[0] == 9 for r in left) == 1 and sum(r[0] is None for r in left) == 3 and len(left) == 6


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_at_both_thresholds(spark, percent):
    texts = near_copies(80, 60, 3, 7) + near_copies(40, 30, 2, 8)
    want = brute_components(texts, percent)
    rows = minhash.near_duplicates(docs_of(spark, texts), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == dict(enumerate(want))
    kept = {r.doc_id for r in minhash.keep_one(docs_of(spark, texts), percent).collect()}
    assert kept == {i for i, (_, c) in enumerate(want) if i == c}


def test_minhash_says_when_it_would_lose_links(spark):
    with pytest.raises(ValueError, match="bands"):
        minhash.near_duplicates(docs_of(spark, ["a b c d e f"]), 50)


def test_minhash_bands_miss_little():
    for percent in (80, 85):
        assert (1 - (percent / 100) ** minhash.ROWS) ** minhash.bands_for(percent / 100) <= 1e-6


# 4


def test_url_lists_with_clashing_columns_and_large_lists(spark, monkeypatch):
    entries = spark.createDataFrame([("com", "tld", 3, True), *((f"h{i}.com", "spam", 0, True) for i in range(0, 40, 2))], "pattern string, category string, day int, listed boolean")
    rows = [(i, f"http://h{i % 60}.com/" + "x" * (100_000 if i == 1 else 1), i % 6, "clash", "clash", "clash") for i in range(300)] + [(1000, None, 1, "c", "c", "c")] * 30
    captures = spark.createDataFrame(rows, "page_id long, url string, fetch_day int, host string, category string, matched_pattern string")

    def plain(url, day):
        if url is None:
            return None
        n = int(re.match(r"http://h(\d+)", url)[1])
        return "spam" if n < 40 and n % 2 == 0 else "tld" if day >= 3 else None

    want = sorted(((r[0], plain(r[1], r[2])) for r in rows), key=repr)
    for limit in (1 << 25, 0):
        monkeypatch.setattr(urllists, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(common, "HOT_ROWS", 10)
        got = urllists.judged(captures, entries)
        assert sorted(got.columns) == sorted([*captures.columns, "blocked"])
        assert sorted(((r.page_id, r.category) for r in got.collect()), key=repr) == want
    assert urllists.judged(captures.limit(0), entries).count() == 0


# 5


def test_bpe_streams_like_it_encodes(spark, tokenizer, monkeypatch):  # noqa: F811
    path, library, vocabulary = tokenizer
    r = random.Random(3)
    texts = ["".join(r.choice([*"abc t'\n\té漢😀.", "'ll", "<|endoftext|>", "   "]) for _ in range(r.randint(0, 4000))) for _ in range(30)]
    monkeypatch.setattr(bpe, "PIECE", 100)
    encoder, decoder = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert [i for part in encoder.parts(text) for i in part.tolist()] == ids
        assert bpe.digests_of(encoder, decoder, encoder.parts(text)) == bpe.digests_of(encoder, decoder, [np.array(ids, np.uint32)])
    docs = rows_of(spark, [(1, "a b"), (1, "a b"), (None, "ab" * 300_000), (2, None)])
    got = bpe.tokenised(docs, path).collect()
    assert sorted((r.n_tokens, len(r.ids)) for r in got) == sorted([(n, n) for n in (2, 2, 0, len(library.encode("ab" * 300_000, add_special_tokens=False).ids))])
    assert {(r.ids_sha256, r.decoded_sha256) for r in got} == {(r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, path).collect()}
    assert bpe.tokenised(docs.limit(0), path).count() == 0


# 6


class Article(html.parser.HTMLParser):
    """Blocks of text inside article elements, read another way."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.out, self.now = 0, 0, [], []

    def flush(self):
        text = " ".join("".join(self.now).split())
        self.out += [text] if text else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style")
        if tag in ("p", "h1", "h2", "h3", "li", "ul", "div", "article", "blockquote"):
            self.flush()
        elif tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "h3", "li", "ul", "div", "article", "blockquote"):
            self.flush()
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.now.append(data)


def test_main_text_equals_another_reading_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in mainblocks.extract(pages.withColumn("text", F.lit("clash"))).collect()}
    for r in pages.collect():
        reader = Article()
        reader.feed(r.html)
        reader.close()
        reader.flush()
        assert got[r.page_id] == "\n".join(reader.out)


RUSSIAN = "Город стоял у реки много лет, и люди жили в нём спокойно, пока не пришла большая вода и не унесла старый мост. " * 2
POLISH = "Miasto stało nad rzeką przez wiele lat i ludzie żyli w nim spokojnie, dopóki nie przyszła wielka woda, która zabrała stary most. " * 2
CHINESE = "这座城市在河边已经很多年了，人们在那里平静地生活着，直到大水来了，把旧桥冲走了。" * 6


@pytest.mark.parametrize("story", [RUSSIAN, POLISH, CHINESE, STORY])
def test_main_text_in_any_language(story):
    story = story.strip()
    page = f"<nav><a href=x>a</a></nav><div><a href=1>one link here</a> <a href=2>two</a></div><h1>Head</h1><p>{story}</p><p>Short one.</p><p>{story}</p><footer>{story}</footer>"
    assert mainblocks.main_text(page).replace("Head\n", "") == f"{story}\nShort one.\n{story}"
    assert mainblocks.main_text(f"<article><p>{story}</p></article>") == story


@pytest.mark.parametrize("name", ["legal-history", "market-share", "search-engines", "noticeable", "related_work intro", "tags2vec-paper"])
def test_class_words_that_say_nothing(name):
    assert mainblocks.main_text(f"<article><p>{STORY}</p><section class='{name}'><p>{STORY}</p></section></article>") == f"{STORY.strip()}\n{STORY.strip()}"


@pytest.mark.parametrize("name", ["comments", "comment-list", "post share-buttons", "ad_box2", "cookie-notice", "relatedPosts", "site-footer", "sidebar"])
def test_class_words_of_boilerplate(name):
    assert mainblocks.main_text(f"<article><p>{STORY}</p><section class='{name}'><p>{STORY}</p></section></article>") == STORY.strip()


def test_main_text_of_empty_tables_and_long_pages(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{'<p>' + STORY + '</p>' * 1}" * 3000, "clash")], "page_id long, url string, html string, text string")
    r = mainblocks.extract(pages).first()
    assert r.text == "\n".join([STORY.strip()] * 3000) and r.n_chars == len(r.text)
    assert mainblocks.extract(pages.limit(0)).count() == 0


# 7


def plain_words(text):
    text = re.sub(r"\s+", " ", text)
    text = re.sub(r"(?<=[0-9])[.,:/](?=[0-9])", "", text)
    text = re.sub(r"(?<![^\W_])([0-9]+)(?=[^\W\d_])", r"\1 ", text)
    return re.findall(r"[^\W_]+", text.lower().replace("ß", "ss"))


def covered(words, item, coverage=0.8):
    """Whether at one distance, or in one of two overlapping bands of them, enough of the item's windows are in the words."""
    size = min(5, len(item))
    n = len(item) - size + 1
    places = collections.defaultdict(list)
    for k in range(len(words) - size + 1):
        places[tuple(words[k : k + size])].append(k)
    found = collections.defaultdict(set)
    step = max(1, n // 4)
    for i in range(n):
        for at in places.get(tuple(item[i : i + size]), ()):
            shift = at - i
            low = shift - shift % step
            for run in ((shift, 1), (low, 2 * step), (low - step, 2 * step)):
                found[run].add(i)
    return any(len(f) >= coverage * n for f in found.values())


def test_decontamination_equals_brute_force(spark):
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: plain_words(r.text) for r in benchmark.collect()}
    r = random.Random(1)
    extra = []
    for k, words in enumerate(items.values()):
        some = list(words)
        for _ in range(k % 6):
            some[r.randrange(len(some))] = "altered"
        extra.append((10_000 + k, " ".join(["before", *some, "after"])))
    rows = [(x.doc_id, x.text) for x in docs.collect()] + extra
    got = {x.doc_id: set((x.items or "").split(",")) - {""} for x in decontaminate.contamination(rows_of(spark, rows), benchmark).collect()}
    for i, text in rows:
        words = plain_words(text)
        assert got[i] == {str(k) for k, item in items.items() if item and covered(words, item)}, i
    assert sum(map(bool, got.values())) > 20


def test_decontamination_of_null_and_repeated_ids_and_long_texts(spark):
    benchmark = spark.createDataFrame([(1, TRAIN), (2, "What is photosynthesis exactly?")], "item_id long, text string")
    other = "A train leaves Rome at 4 and travels 50 km to Vienna, so how long until the train from Lisbon reaches Oslo?"
    rows = [(None, TRAIN), (None, "nothing of it"), (5, f"So: {TRAIN}"), (5, other), (6, "Well, what is photosynthesis exactly? Yes."), (7, "clean " * 200_000 + TRAIN), (8, None)]
    docs = rows_of(spark, rows).withColumn("items", F.lit("clash"))
    got = sorted(((r.doc_id, r["items"]) for r in decontaminate.contamination(docs, benchmark).collect()), key=repr)
    assert got == sorted([(None, "1"), (None, None), (5, "1"), (5, None), (6, "2"), (7, "1"), (8, None)], key=repr)
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(None, "nothing of it"), (5, other), (8, None)], key=repr)


def test_decontamination_is_the_same_without_anchors(spark, monkeypatch):
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contamination(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "MOST_ANCHORS", 0)
    assert sorted(map(tuple, decontaminate.contamination(docs, benchmark).collect())) == want


# 8


def test_vectors_larger_set_ties_and_clashing_columns(spark):
    r = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        v = r.standard_normal(8)
        rows.append((i, int(r.integers(0, 3)), [float(x) for x in v]))
    rows += [(5000, 7, [1.0, 0.0, 0.0]), (5001, 7, [1.0, 0.0, 0.0]), (5002, 7, [93.0, math.sqrt(100**2 - 93**2), 0.0]), (5003, 7, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "vec_id long, label int, embedding array<double>, key string, rep string")
    got = {x.vec_id: (x.n_links, x.component_id) for x in vectors.near_duplicates(df).collect()}
    want = brute_vectors(rows)
    assert sum(v[0] for v in want.values()) > 200
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values()) and all(got[k][0] <= want[k][0] for k in got)
    assert got[5000][0] >= 1 and got[5003] == (0, 5003)


def test_vectors_of_long_labels_that_end_alike_do_not_meet(spark):
    v = [0.6, 0.8, 0.0]
    rows = [(1, 10000000000000001, v), (2, 20000000000000001, v), (3, 20000000000000001, [1.2, 1.6, 0.0]), (4, 1, v), (5, 1 + 2**62, v), (6, 1 - 2**62, v), (7, -1, v), (8, -1, v)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")).collect()}
    assert got == {1: (0, 1), 2: (1, 2), 3: (1, 2), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (1, 7), 8: (1, 7)}


# 9


def test_warc_index_levels_and_long_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 2)
    monkeypatch.setattr(warc, "FILE_BLOCKS", 2)
    rows = [(i, "http://same.example/" if i % 2 else f"http://h{i}.example/", f"<p>{i // 3}</p>", "clash", "clash") for i in range(90)] + [(200, "http://long.example/", "x" * 3_000_000, "clash", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, response string")
    archive = warc.Archive.write(pages)
    assert archive.directory.count() > 5
    got = {r.page_id: r for r in archive.read_all().collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, h, *_ in rows:
        last[h] = max(i, last.get(h, -1))
    assert all((got[i].payload_bytes, got[i].refers_to) == (len(h), None if last[h] == i else last[h]) for i, _, h, *_ in rows)
    assert archive.lookup(spark.createDataFrame([("nowhere)/", 1), (warc.url_key("http://h4.example/"), 4)], "key string, page_id long")).count() == 1
    assert archive.read_all().rdd.getNumPartitions() > 1


# 10


def brute_terms(texts):
    """Disclosing terms by plain loops over the distinct texts."""
    distinct = sorted({t or "" for t in texts})
    spans = {t: pii.base_spans(t) for t in distinct}
    holds = collections.defaultdict(set)
    for t in distinct:
        for s in spans[t]:
            for e in pii.entities(t, s):
                holds[e].add(t)
    said = {t: {m.lower() for m in re.findall(r"[^\W_]+", t)} for t in distinct}
    beside = {}
    for t in distinct:
        blank = list(t)
        beside[t] = {m[0].lower() for m in re.finditer(r"[^\W_]+", "".join(blank)) if not any(a < m.end() and m.start() < b for _, a, b in spans[t])}
    n_t = collections.Counter(w for t in distinct for w in said[t])
    out = set()
    for having in holds.values():
        if len(having) >= pii.TOGETHER:
            for w, n in collections.Counter(w for t in having for w in beside[t]).items():
                chance = n / n_t[w]
                if n >= pii.TOGETHER and chance >= pii.CHANCE and math.log2(chance / (len(having) / len(distinct))) >= pii.BITS:
                    out.add(w)
    return out


def test_disclosing_terms_equal_brute_force(spark):
    r = random.Random(6)
    filler = lambda n: " ".join(f"common{r.choice('abcdefgh')}" for _ in range(n))
    docs = [(i, f"{filler(9)} {i} ann@corp{i % 5}.example badge{i % 5} room {4000 + i % 5} {filler(3)}") for i in range(60)]
    docs += [(100 + i, f"{filler(20)} {i}") for i in range(900)]
    docs += [docs[3], (None, docs[4][1]), (None, docs[4][1]), (77, "room 4002 again, and badge1 with badge3"), (77, docs[70][1]), (None, None), (2000, "")]
    want = brute_terms([t for _, t in docs])
    assert {"badge0", "4001"} <= want and "room" not in want
    frame = rows_of(spark, docs).withColumnRenamed("kept", "terms")
    got = collections.Counter((x.doc_id, x.spans) for x in pii.personal_data(frame).collect())

    def spans(t):
        base = pii.base_spans(t)
        more = [("term", m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in want and not any(a < m.end() and m.start() < b for _, a, b in base)]
        return ",".join(f"{k}:{a}:{b}" for k, a, b in [*base, *more])

    assert got == collections.Counter((i, spans(t or "")) for i, t in docs)
    clean = pii.sanitise(frame)
    assert clean.columns == frame.columns
    texts = {x.text for x in clean.where("doc_id = 77").collect()}
    assert texts == {"room [NUMBER OF 4 DIGITS] again, and [TERM] with [TERM]", docs[70][1]}
    assert clean.where("text like '%badge%'").count() == 0 and clean.count() == len(docs)
    assert pii.sanitise(frame.limit(0)).count() == 0


def test_term_spans_on_the_tables_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    want = brute_terms([r.text for r in rows])
    got = {w for r in pii.personal_data(docs).join(docs.select("doc_id", "text"), "doc_id").collect() for k, a, b in (s.split(":") for s in (r.spans or "").split(",") if s) if k == "term" for w in [r.text[int(a) : int(b)].lower()]}
    assert got == want


# shared folders


def test_scratch_tables_are_dropped(spark):
    with common.dropped_after():
        scratch = common.Scratch(spark, "gone")
        kept = scratch.keep(spark.range(5), "five")
        assert kept.count() == 5
        path = spark._jvm.org.apache.hadoop.fs.Path(scratch.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert files.exists(path)
    assert not files.exists(path)
