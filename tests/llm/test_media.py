"""WARC, extraction, neighbours, co-training, audio and the pipeline."""

import hashlib
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrace.llm import co_training, collision_knn, shared, style_tree, telephony_audio, warc_zstd

PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2\r\nX: y", "<p>same</p>"), (3, None, None), (4, "u", ""), (None, "v", "<p>same</p>"), (None, "w", "alone"), (5, "x", "é" * 200000), (5, "x", "é" * 200000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "digest": F.lit("x")})
    folder = shared.shared_dir(spark, "warc")
    index = warc_zstd.write_archives(warc_zstd.plan_records(pages), folder, train_bytes=64)
    got = warc_zstd.read_archives(index, folder).collect()
    assert len(got) == len(PAGES)
    for d, _, html in PAGES:
        data = (html or "").encode()
        own = [r for r in got if r.page_id == d and r.payload_digest == warc_zstd.base32_sha1(data)]
        assert own and all(r.payload_bytes == len(data) for r in own)
        largest = max((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        assert all((r.record_type, r.refers_to) == (("response", None) if d == largest else ("revisit", largest)) for r in own)
        assert all(bytes(r.payload) == data for r in own if r.record_type == "response")
    names = os.listdir(folder.removeprefix("file://"))
    assert names and all(open(f"{folder.removeprefix('file://')}/{n}", "rb").read(4) == warc_zstd.DICTIONARY_MAGIC for n in names)
    assert warc_zstd.read_archives(warc_zstd.write_archives(warc_zstd.plan_records(pages.where("false")), folder), folder).count() == 0


def test_trained_dictionary_is_used():
    samples = [f"<html><head><title>{i}</title></head><body class='page'><p>text {i * 7}</p></body></html>".encode() for i in range(500)]
    content = warc_zstd.train(samples, 4096)
    import zstandard as zstd

    plain, own = zstd.ZstdCompressor(), zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content))
    assert len(own.compress(samples[7])) < 0.7 * len(plain.compress(samples[7]))


HTML = "<html><body><nav>menu</nav><div class=x>Read our paper daily</div><article><h1>T {i}</h1><p><b>A &amp; b{i}.<br><p>Second\n  one {i}</p></article><footer>f</footer></body></html>"


def test_extraction_of_odd_pages(spark):
    rows = [(i, f"http://h/{i}", HTML.format(i=i)) for i in range(8)] + [(100, None, None), (101, "http://h/x", ""), (None, "bad url", "<p>a<p>b &lt; c"), (102, "http://h/y", "<div cla")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "removed": F.lit("x")})
    got = {r.page_id: r for r in style_tree.extract(pages).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        assert got[i].text == f"T {i}\nA & b{i}.\nSecond one {i}" and got[i].n_chars == len(got[i].text)
    assert got[100].text == got[101].text == got[102].text == "" and got[None].text == "a\nb < c"
    assert style_tree.extract(pages.where("false")).count() == 0


def test_tree_removes_what_a_site_repeats(spark):
    page = "<body><div class=top><p>All rights belong to us</p></div><div class=story><p>News {i} of day {i}</p></div><div class=end><p>Call us</p></div></body>"
    rows = [(i, f"https://site.org/{i}", page.format(i=i)) for i in range(9)] + [(50, "https://other.org/", page.format(i=50))]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"News {i} of day {i}" for i in range(9))
    assert got[50] == "All rights belong to us\nNews 50 of day 50\nCall us"  # a site of one page shows nothing


def test_tree_decides_in_articles_and_of_classes(spark):
    def page(i: int) -> str:
        body = "".join(f"<{tag}>Part {k} of {i}</{tag}>" for k, tag in enumerate(("h2", "p", "pre", "h3", "blockquote", "section")) if i >> k & 1)
        return (
            f"<div class='content with-sidebar'><article><p>Story {i} here</p><div class=plug><p>Get our app</p></div></article></div>"
            f"<div class=sidebar><p>Best of the week {i}</p></div><div class=lede><p>Lead {i} outside</p></div><div class=related>{body}</div>"
        )

    rows = [(i, f"https://site.org/{i}", page(i)) for i in range(1, 40)] + [(99, "https://other.org/", "<div class='no-sidebar category-social'><p>Text</p></div><nav>Menu</nav>")]
    got = {r.page_id: r.text.split("\n") for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(1, 40):
        # Neither the repeated plug nor the sidebar, nor what is related, however varied.
        assert got[i] == [f"Story {i} here", f"Lead {i} outside"]
    assert got[99] == ["Text"]


def test_comments_go_and_headings_of_articles_stay(spark):
    def page(i: int) -> str:
        said = "".join(f"<{tag}>Reader {k} on {i}: well</{tag}>" for k, tag in enumerate(("p", "div", "blockquote", "section", "pre", "li")[: 2 + i % 5]))
        return (
            f"<article><h1>Title {i}</h1><h2 class=lead>Summary</h2><p>What {i} is about</p><h2 class=ref>References</h2><ul><li>Book {i}</li></ul>"
            f"<div class=plug><h3>Our app</h3><p>Get it now</p></div></article><div class=comments>{said}</div><div class=extra><h2>Weather</h2><p>Mild</p></div>"
        )

    rows = [(i, f"https://site.org/{i}", page(i)) for i in range(8)]
    rows += [(50 + i, f"https://one{i}.org/", f"<nav>Menu</nav><div {a}><p>The story</p></div>") for i, a in enumerate(("class=search", "id=notice", "class=story"))] + [(60, "https://none.org/", "<nav>Menu</nav>")]
    got = {r.page_id: r.text.split("\n") for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == [f"Title {i}", "Summary", f"What {i} is about", "References", f"Book {i}"]
    assert got[50] == got[51] == got[52] == ["The story"] and got[60] == [""]


def article_blocks(html):
    """The blocks of a page's article by another way: a tree of the standard library's parser, and what its parts' names say."""
    from html.parser import HTMLParser

    noise, out, stack, held = style_tree.NOISE, [], [], []

    class Reader(HTMLParser):
        def put(self):
            text = " ".join("".join(held).split())
            held.clear()
            if text and any(x[1] for x in stack) and not any(x[2] for x in stack):
                out.append(text)

        def handle_starttag(self, tag, attrs):
            if tag in style_tree.BLOCKS:
                self.put()
            if tag == "br":
                held.append(" ")
            if tag not in style_tree.VOID:
                named = {w for k, v in attrs if k in ("class", "id", "role") and v for w in v.lower().split()}
                inside = any(x[1] for x in stack)
                around = tag in ("body", "html", "main") or "article" in named
                bad = tag in style_tree.NOISE_TAGS | style_tree.DROPPED or tag == "header" and not inside or bool(named & noise) and not around
                stack.append((tag, inside or tag in ("article", "main"), bad))

        def handle_endtag(self, tag):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in style_tree.BLOCKS:
                        self.put()
                    del stack[i:]
                    break

        def handle_data(self, data):
            if not (stack and stack[-1][0] in style_tree.DROPPED):
                held.append(data)

    reader = Reader(convert_charrefs=True)
    reader.feed(html or "")
    reader.put()
    return out


def test_whole_pages_against_another_parser(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: r.text for r in style_tree.op2_site_style_tree(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    off = [i for i, html in pages.items() if got[i] != "\n".join(article_blocks(html))]
    assert not off, (len(off), off[:5])


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16))
    x[200:700] = x[3]  # a very common vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [1.0, 2.0]), (None, [1.0] * 16), (1499, [float(v) for v in x[1499]])]
    frame = collision_knn.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)))
    got = collision_knn.nearest(frame.where("vec_id % 100 = 0"), frame, block_rows=400, query_rows=4).collect()
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(s == pytest.approx(d[v], abs=0) for _, v, s in own)
        hit += len({v for _, v, _ in own} & set(best.tolist()))
    assert hit >= 0.9 * 150
    assert collision_knn.nearest(frame.where("false"), frame).count() == 0


def test_neighbours_of_repeats_and_huge_components(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(40)] * 4 + [(7, [float(v) for v in x[9]])] * 3  # an id with two vectors
    rows += [(100 + i, [1e308] * 4 + [-1e308] * 4) for i in range(3)] + [(200 + i, [1e200 * (i + 1)] * 8) for i in range(3)] + [(300 + i, [1e-200 * (i + 1)] * 8) for i in range(3)]
    frame = collision_knn.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    vectors = {}
    for i, v in rows:
        vectors.setdefault(i, []).append(np.array(v))
    for block_rows in (16, 1000):
        got = collision_knn.nearest(frame.where("vec_id in (0, 7, 100, 200, 300)"), frame, block_rows=block_rows, query_rows=4).collect()
        for q in (0, 7, 100, 200, 300):
            own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            assert [r for r, _, _ in own] == list(range(1, 11)) and len({v for _, v, _ in own}) == 10
            want = {i: min(math.dist(a, b) for a in vectors[q] for b in vectors[i]) for i in vectors if i != q}
            assert all(s == pytest.approx(want[v], rel=1e-12) for _, v, s in own)
            if q in (0, 200):
                assert len({v for _, v, _ in own} & set(sorted(want, key=lambda i: (want[i], i))[:10])) >= 9


def test_recall_of_neighbours(spark):
    got = collision_knn.op3_collision_knn(spark, "/root/testdata/sf0.1").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    hit = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        own = got[got.query_id == ids[i]].sort_values("rank")
        assert len(own) == 10 and (np.diff(own.score) >= 0).all()
        hit += len(set(own.vec_id) & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hit >= 0.95 * 10 * (ids % 100 == 0).sum()


def test_co_training_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = co_training.train(docs, labels.where("doc_id % 2 = 0"), labelled=1000, pool=1500)
    got = co_training.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.97


def test_thresholds_take_the_surest():
    counts = {900: 3, 500: 4, 250: 9, 100: 50, -300: 2, -301: 1, -3000: 5}
    assert co_training.thresholds(counts, 100, 0.8, 0.9, 0.1) == (500, -3000)  # 8 good at most, 2 bad at most: one margin at least
    assert co_training.thresholds(counts, 1000, 0.5, 0.9, 0.1) == (250, -300)  # all that the view is sure of
    assert co_training.thresholds({100: 5, -100: 5}, 10, 0.5, 0.9, 0.5) == (3001, -3001)  # sure of none
    assert co_training.thresholds({}, 0, 0.5, 0.9, 0.5) == (3001, -3001)


def test_exchanged_labels_cover_all_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rounds, seen = co_training._exchange(docs, labels.select(F.col("doc_id").alias("id")), 10**6, 0.9, 0.05), []
    rng = np.random.default_rng(1)
    widths = (co_training.TEXT + 1, co_training.LANGS + co_training.SOURCES + co_training.NUMBERS)
    done = co_training.Rounds([np.zeros(w) for w in widths], [np.ones(w) for w in widths], 0.5, [], [])
    rows = [r for r in docs.join(labels.select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").collect()]
    batches = list(co_training.views(*(pa.array([r[k] for r in rows], pa.string()) for k in ("text", "lang", "source"))))
    x = [np.concatenate([b[i] for b in batches]) for i in (1, 2)]
    want = [np.full(len(rows), -1), np.full(len(rows), -1)]
    for r in range(2):
        done.weights.append([np.r_[rng.standard_normal(w) * 3, 0.0] for w in widths])
        views, given = rounds(done)
        # The plain way: the n-th surest free row, ties included.
        for i, m in enumerate(done.margins(x, r)):
            free = want[1 - i] < 0
            good, bad = done.cuts[r][i]
            assert good >= 220 and bad <= -220
            want[1 - i][free & (m >= good)], want[1 - i][free & (m <= bad)] = 1, 0
            most = max(1, round(0.025 * len(rows)))
            assert (free & (m >= good)).sum() <= most or len(set(m[free & (m >= good)])) == 1
        labelled = (want[0] >= 0) | (want[1] >= 0)
        assert len(views[0]) == labelled.sum() > 0
        assert all(sorted(g.tolist()) == sorted(w[labelled].tolist()) for g, w in zip(given, want, strict=True))


def test_co_training_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "x", "en", "s"), (2, "", "en", "s"), (2, "", "en", "s")], "doc_id long, text string, lang string, source string").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = co_training.train(docs, labels)
    assert [r.score for r in co_training.score(docs, model).collect()] == [1.0] * 4
    assert co_training.rejected(docs, model).columns == docs.columns
    assert co_training.score(docs.where("false"), co_training.train(docs.where("false"), labels.where("false"))).count() == 0


def test_too_few_labels_reject_nothing(spark):
    docs = spark.createDataFrame([(i, f"clean text {i}", "en", "s") for i in range(20)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i == 0)) for i in range(12)], "doc_id long, quality int")
    model = co_training.train(docs, labels)
    assert model.constant < 0.5
    assert co_training.rejected(docs, model).count() == 20


def test_law_tables():
    # Fixed values of G.711: the extremes and the smallest steps.
    assert [int(telephony_audio.MULAW_TABLE[i]) for i in (0x00, 0x80, 0xFF, 0x7F, 0xFE)] == [-32124, 32124, 0, 0, 8]
    assert [int(telephony_audio.ALAW_TABLE[i]) for i in (0xD5, 0x55, 0x2A, 0xAA)] == [8, -8, -32256, 32256]
    assert len(set(telephony_audio.ALAW_TABLE.tolist())) == 256 and len(set(telephony_audio.MULAW_TABLE.tolist())) == 255


def plain_adpcm(data):
    want = []
    for b in data.reshape(-1, 64):
        sample, index = int(b[:2].copy().view("<i2")[0]), min(int(b[2]), 88)
        want.append(sample)
        for byte in b[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = int(telephony_audio.STEPS[index])
                diff = step >> 3
                diff += (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                sample = max(-32768, min(32767, sample - diff if code & 8 else sample + diff))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                want.append(sample)
    return want


def test_adpcm_equals_a_plain_decoder():
    data = np.random.default_rng(4).integers(0, 256, 64 * 20).astype(np.uint8)
    assert telephony_audio.adpcm_decode(data).tolist() == plain_adpcm(data)


def test_packed_pcm_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 64, 1001):
        for pcm in (rng.integers(-32768, 32768, n).astype(np.int16), np.resize(np.array([-32768, 32767, 32767, -32768, 0], np.int16), n)):
            assert (telephony_audio.unpack_pcm(telephony_audio.pack_pcm(pcm)) == pcm).all() and len(telephony_audio.pack_pcm(pcm)) == 2 * n
    made = telephony_audio.resample(rng.integers(-32768, 32768, 500).astype(np.int16), 8000, 16000)
    assert not any(telephony_audio.pack_pcm(made)[1000:])


def test_audio_features_equal_plain_ones(spark):
    texts = [(1, "abc"), (2, None), (3, "é" * 500), (4, "some longer text of words " * 40)]
    got = {r.doc_id: r for r in telephony_audio.features(telephony_audio.to_media(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    for i, text in texts:
        payload = (text or "").encode()
        payload += b"\0" * (64 - len(payload) % 64 if len(payload) % 64 or not payload else 0)
        first = [int(telephony_audio.MULAW_TABLE[x]) for x in payload]
        other = [int(telephony_audio.ALAW_TABLE[x]) for x in payload]
        twice = []
        for n in range(2 * len(first)):
            low, odd = divmod(n, 2)
            twice.append((first[low] + first[min(low + 1, len(first) - 1)]) // 2 if odd else first[low])
        sounds = (first, other, plain_adpcm(np.frombuffer(payload, np.uint8)), twice)
        figures = [(len(s), sum(x * x for x in s) // len(s), max(map(abs, s)), sum((a < 0) != (b < 0) for a, b in zip(s, s[1:], strict=False))) for s in sounds]
        assert got[i].feature == ";".join(",".join(map(str, f)) for f in figures)
        media = telephony_audio.wave(payload)
        assert media.endswith(b"data" + len(payload).to_bytes(4, "little") + payload) and int.from_bytes(media[4:8], "little") == len(media) - 8
        assert (got[i].media_bytes, got[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_logistic_is_at_the_optimum():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    y = (x[:, 0] + rng.normal(size=700) > 0.3).astype(int)
    w = co_training.logistic(x, y, 2.0)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - y) + 2.0 * w[:-1]).max() < 0.05 and abs((p - y).sum()) < 0.05

def test_audio_round_trip(spark):
    texts = [(1, "abc"), (2, None), (3, ""), (None, "é" * 100), (4, "x" * 64), (4, "x" * 64), (5, "long " * 50000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("media", F.lit(1))
    for tag in (telephony_audio.MULAW, telephony_audio.ALAW, telephony_audio.IMA_ADPCM):
        media = telephony_audio.to_media(docs, tag)
        got = telephony_audio.features(media).collect()
        want = [telephony_audio.padded(t) for _, t in texts]
        key = lambda n, p: (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(key(*x) for x in want)
        pcm = telephony_audio.resampled(media).where("doc_id = 4").first().pcm
        tag_, rate, _, data = telephony_audio.open_wave(bytes(pcm))
        assert (tag_, rate) == (telephony_audio.PCM, 16000) and len(data) >= 2 * 2 * 64
    assert telephony_audio.features(telephony_audio.to_media(docs.where("false"))).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, "", "en", "s", 0), (9003, "token=" + "ab" * 20 + " and some more plain words here", "en", "src1", 77)], docs.schema)
    kept = docs.unionByName(odd)
    rows = kept.count()
    for name, stage in cp.STAGES[:-1]:
        kept = shared.written(stage(spark, kept, sf), name)
        assert kept.columns == docs.columns and 0 < kept.count() <= rows
        rows = kept.count()
    texts = [r.text for r in kept.collect()]
    assert len(set(texts)) == len(texts) and not any("abababab" in (t or "") for t in texts)
    packed = cp.packing(spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def plain_text_view(text):
    """Shares of hashed byte trigrams, and of distinct words, one trigram at a time."""
    data = (text or "").encode()
    out = np.zeros(co_training.TEXT + 1)
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        out[((a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0xFFFFFFFF) >> 23] += 1
    out = np.sqrt(out / max(1, out.sum()))
    words = data.split()
    out[-1] = len(set(words)) / max(1, len(words))
    return out


def test_pipeline_equals_plain_stages(spark):
    from test_text import plain_near, plain_spans
    from tokenizers import Tokenizer

    import corpus_pipeline as cp
    from terrace.llm import secret_scan, word_ids

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    good = shared.written(cp.quality(spark, docs, sf), "quality")
    model = co_training.train(docs, labels)
    sure, unsure = set(), set()
    for r in docs.collect():
        ((_, _, m),) = co_training.views(*(pa.array([v], pa.string()) for v in (r.text, r.lang, r.source)))
        p = float(model.score(plain_text_view(r.text)[None], m)[2][0])
        if abs(p - 0.5) < 1e-4:
            unsure.add(r.doc_id)
        elif p >= 0.5:
            sure.add(r.doc_id)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {i for i, _ in rows} - unsure == sure and len(rows) >= len(sure)

    alone = shared.written(cp.near_dedup(spark, good, sf), "near")
    groups = plain_near(rows)
    want = {min(rows[i][0] for i in range(len(rows)) if groups[i] == g) for g in set(groups)}
    assert sorted(r.doc_id for r in alone.collect()) == sorted(want) and len(want) < len(rows)

    clean = shared.written(cp.secrets(spark, alone, sf), "secrets")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scan(alone).collect()}
    new = {r.doc_id: r for r in clean.collect()}
    marked = 0
    for r in alone.collect():
        own, text, out, at = spans[r.doc_id], r.text or "", "", 0
        assert set(plain_spans(text)) <= set(own)
        for start, _, stop in own:
            if at == 0 or start >= at:
                out += text[at:start] + "[secret]"
            at = max(at, stop)
        assert new[r.doc_id].text == (out + text[at:] if own else r.text)
        assert new[r.doc_id].n_chars == (len(out + text[at:]) if own else r.n_chars)
        marked += bool(own)
    assert marked and len(new) == len(want)

    packed = cp.packing(spark, clean, sf).toPandas()
    tokenizer = Tokenizer.from_file(word_ids.default_path())
    sizes = {i: 1 + len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for i, r in new.items()}
    assert packed.groupby("doc_id").length.sum().to_dict() == sizes
    packed = packed.sort_values(["sequence_id", "offset"])
    ends = packed.offset + packed.length
    assert (ends <= 2048).all() and ((packed.offset == 0) | (packed.offset == ends.shift())).all()


def test_rows_of_one_labelled_id_are_one_before_the_driver(spark):
    rows = [(7, f"text {i} of one id " * (1 + i % 3), "en", "s") for i in range(2000)] + [(8, "another text", "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    sample = spark.createDataFrame([(7, 5, 1, -1, -1), (8, 6, 0, -1, -1)], "id long, h long, y int, y0 int, y1 int")
    found, x = co_training._featured(docs, sample)
    assert found["id"].to_pylist() == [7, 8] and found["y"].to_pylist() == [1, 0] and all(len(v) == 2 for v in x)
    again, z = co_training._featured(docs.orderBy(F.rand(1)), sample)
    assert again["id"].to_pylist() == [7, 8] and all((a == b).all() for a, b in zip(x, z, strict=True))
