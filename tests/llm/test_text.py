"""Packing, token scan, SentencePiece, SimHash, near copies and secrets against brute force, with odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrace.llm import components, histogram_packing, near_copies, piece_scan, secret_scan, separator_scan, simhash_trie, word_ids

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog " * 3), (2, None), (3, ""), (4, " \n\t "), (5, "The quick brown fox jumps over the lazy dog " * 3), (5, "again"), (5, "again"),
    (None, "no id"), (None, None), (6, "word " * 5000), (7, "x" * 3000), (8, "日本語 naïve É <|endoftext|> it's CAN'T a\x1cb 1,2.5%"), (9, "one two"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns with names that operators use inside.
    rows = [(d, t, "en", "s", 0, 1, "x", 2) for d, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, digest string, rank int")


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_ids.default_path())
    want = sorted((d if d is not None else -1, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in ROWS)
    got = histogram_packing.pack(docs).collect()
    assert sum(r.length for r in got) == sum(len(x) for _, x in want)
    ids = {}
    for d, x in want:
        ids.setdefault(d, []).append(x)
    for r in got:
        own = [x for x in ids[-1 if r.doc_id is None else r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert own
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert histogram_packing.pack(docs.where("false")).count() == 0


def test_word_ids_equal_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_ids.default_path())
    texts = ["H\u0331 T\u0308 h\u0331", "J\u030cA. T\u0344;b", "ÉÀ, Ärger. İ;K Σ? ΑΣ. ΑΣ", "it's. CAN'T! a<b", None, "", "<|endoftext|>.A", " \n".join(f"w{i}x." for i in range(300)), "again w7x. É"] * 2
    for parts in ([[t] for t in texts], [texts]):
        own = word_ids.WordEncoder(word_ids.default_path())
        for part in parts:
            ids, edges = own.encode(pa.array(part, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]


def test_pack_histogram_places_all():
    rng = np.random.default_rng(3)
    counts = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 2049), 500, replace=False), rng.integers(1, 50, 500), strict=True)}
    packs = histogram_packing.pack_histogram(counts)
    placed = {}
    for pattern, n in packs:
        assert sum(pattern) <= 2048 and list(pattern) == sorted(pattern, reverse=True)
        for x in pattern:
            placed[x] = placed.get(x, 0) + n
    assert placed == counts
    total = sum(k * n for k, n in counts.items())
    assert 2048 * sum(n for _, n in packs) - total < 0.05 * total


def test_separator_scan_over_tiny_blocks(docs):
    encode = separator_scan.encoding(separator_scan.default_path()).encode_ordinary
    want = sorted((-1 if d is None else d, len(encode(t or "")), True) for d, t in ROWS)
    for block in (3, 64, 1 << 20):
        got = separator_scan.count_tokens(docs, block_ids=block).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.terminated) for r in got) == want
    assert separator_scan.count_tokens(docs.where("false")).count() == 0


def test_open_end_of_a_token_file(spark, tmp_path):
    np.array([5, 6, 9, 9, 7, 7, 7], "<u2").tofile(f"{tmp_path}/a.u16")
    for block in (1, 2, 3, 100):
        got = separator_scan.scan(spark, f"file://{tmp_path}", 9, block).orderBy("ordinal").collect()
        assert [(r.ordinal, r.n_tokens, r.terminated) for r in got] == [(0, 2, True), (1, 0, True), (2, 3, False)]


def test_pieces_equal_the_library(docs):
    library = piece_scan.pieces_of(piece_scan.default_path()).library
    key = lambda d, ids: (-1 if d is None else d, list(ids))
    want = sorted(key(d, library.encode(t or "")) for d, t in ROWS)
    for group in (2, 5, 64):  # ranges of matrices: many levels, few, one
        decoded = piece_scan.decode(piece_scan.encode(docs, chunk=64, group=group)).collect()
        assert sorted(key(r.doc_id, r.ids) for r in decoded) == want
    found = piece_scan.digests(piece_scan.encode(docs, chunk=64, packed=True)).collect()
    ids = [(np.array(library.encode(t or ""), "<u4"), (t or "").encode()) for _, t in ROWS]
    assert sorted((r.n_ids, r.ids_crc32, r.text_sha256) for r in found) == sorted((len(x), zlib.crc32(x.tobytes()), hashlib.sha256(t).hexdigest()) for x, t in ids)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in decoded) == sorted((-1 if d is None else d, t or "") for d, t in ROWS)
    assert piece_scan.encode(docs.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_chunks_equal_the_library(seed):
    p = piece_scan.pieces_of(piece_scan.default_path())
    rng = np.random.default_rng(seed)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "日", "😀", "er", "st", "0", "..", "un"]
    text = "".join(rng.choice(alphabet, 400, p=None)) if seed % 2 else "".join(rng.choice([x for x in alphabet if " " not in x], 300))
    s, chunk = piece_scan.escaped(text), 64
    n = -(-len(s) // chunk)
    chunks = [piece_scan.Chunk(p, s[max(0, k * chunk - 17) : (k + 1) * chunk + 17], min(17, k * chunk), min(17, k * chunk) + min(chunk, len(s) - k * chunk), k == 0, k == n - 1) for k in range(n)]
    matrices = [c.matrix() for c in chunks]
    at = piece_scan.borders(matrices)
    ids = [i for c, a, b in zip(chunks, at, at[1:], strict=False) for i in c.trace(c.sources[a], c.targets[b])]
    assert ids == p.library.encode(text)
    if n > 3:  # the product is associative
        left = piece_scan.product(piece_scan.product(matrices[0], matrices[1]), matrices[2])
        assert np.array_equal(left, piece_scan.product(matrices[0], piece_scan.product(matrices[1], matrices[2])))


def test_a_last_piece_that_starts_in_the_chunk_before(spark):
    # Texts that end 1 to 16 characters behind a border, so that the piece across it is the last one.
    library = piece_scan.pieces_of(piece_scan.default_path()).library
    texts = [("a " * 200)[: 126 - len(word) + k] + word for word in ("information", "hander", "日本語", "the", "        ", "😀") for k in range(len(word))]
    texts += [x + "s" for x in texts] + [("a " * 200)[:127] + "international"[:k] for k in range(1, 14)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in piece_scan.encode(rows, chunk=64).collect()}
    assert got == {i: library.encode(t) for i, t in enumerate(texts)}


def plain_classes(fps, budget):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize(("budget", "extra"), [(3, 0), (3, 2), (8, 1), (1, 0)])
def test_trie_links_connect_all(spark, budget, extra):
    rng = np.random.default_rng(budget)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for _ in range(240):  # chains of near fingerprints
        x = fps[rng.integers(len(fps))]
        for bit in rng.integers(0, 64, rng.integers(1, budget + 3)):
            x ^= 1 << int(bit)
        fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    label = {r.node: r.component for r in components.components(simhash_trie.trie_links(frame, budget, extra)).collect()}
    assert [label.get(i, i) for i in range(len(fps))] == plain_classes(fps, budget)


def crowded(seed, n, bits):
    """Distinct fingerprints that differ only in ``bits`` of 64, spread over the word, as those of one template's documents."""
    rng = np.random.default_rng(seed)
    places = rng.permutation(64)[:bits]
    base = int(rng.integers(0, 1 << 63))
    low = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64))
    return sorted(base ^ sum((int(x) >> i & 1) << int(p) for i, p in enumerate(places)) for x in low)


def as_long(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("budget", "extra", "unit"), [(3, 0, 16), (3, 1, 16), (1, 0, 4), (2, 2, 32)])
def test_a_crowded_prefix_is_split(spark, budget, extra, unit):
    fps = crowded(1, 150, 30) + crowded(2, 100, 12) + crowded(3, 40, 63)
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(i, as_long(x)) for i, x in enumerate(fps)], "node long, fp long")
    got = simhash_trie.subtrees(frame, budget, extra, unit)
    assert got.groupBy("mask", "name").count().agg({"count": "max"}).first()[0] <= unit
    # All of a subtree agree in the bits of its mask.
    assert got.groupBy("mask", "name").agg(F.countDistinct(F.expr("fp & mask")).alias("n")).where("n > 1").isEmpty()
    label = {r.node: r.component for r in components.components(simhash_trie.trie_links(frame, budget, extra, unit=unit)).collect()}
    assert [label.get(i, i) for i in range(len(fps))] == plain_classes(fps, budget)


def test_a_crowded_prefix_with_second_fingerprints(spark):
    rng = np.random.default_rng(4)
    fps = crowded(5, 120, 24)
    rows = [(x, y) for x in fps for y in rng.integers(0, 1 << 63, rng.integers(1, 4)).tolist()]
    rows += [(fps[0], int(y)) for y in rng.integers(0, 1 << 63, 100)]  # one with many: counted once
    frame = spark.createDataFrame([(i, as_long(x), y) for x, y in rows for i in [fps.index(x)]], "node long, fp long, second long")
    root = list(range(len(fps)))
    second = [np.array([y for x, y in rows if x == fp], np.uint64) for fp in fps]
    for i in range(len(fps)):
        for j in range(i):
            near = (fps[i] ^ fps[j]).bit_count() <= 3
            if near and (np.bitwise_count(second[i][:, None] ^ second[j]) <= 30).any():
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    links = simhash_trie.trie_links(frame, 3, 0, 30, unit=16)
    label = {r.node: r.component for r in components.components(links).collect()}
    assert [label.get(i, i) for i in range(len(fps))] == root
    assert len(set(root)) not in (1, len(fps))


def test_a_hot_subtree_at_its_real_size(spark):
    """20,000 documents of one template: whole in one subtree by their first 16 bits, met in units of 8,192 at most."""
    fps = sorted({x & (1 << 44) - 1 for x in crowded(6, 20_000, 40)})
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(fps)], "node long, fp long")
    assert simhash_trie.subtrees(frame, 3).groupBy("mask", "name").count().agg({"count": "max"}).first()[0] <= simhash_trie.UNIT
    whole = simhash_trie.trie_links(frame, 3, unit=1 << 20)
    found = [sorted(map(tuple, components.components(x).collect())) for x in (whole, simhash_trie.trie_links(frame, 3))]
    assert found[0] == found[1] and found[0]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 8), (200, 201)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}
    assert components.components(links.where("false")).count() == 0


def test_simhash_of_odd_rows(docs):
    def fp(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash_trie.classes(docs).collect()
    assert len(got) == len(ROWS)
    assert sorted(r.fp % (1 << 64) for r in got) == sorted(fp(t) for _, t in ROWS)
    of = {r.doc_id: r.component_id for r in got if r.doc_id not in (None, 5)}
    assert of[2] == of[3] == of[4] == 2 and of[1] == 1
    assert {r.component_id for r in got if r.doc_id == 5} == {1, 5}
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["2", "None"]
    assert simhash_trie.classes(docs.where("false")).count() == 0


def test_a_null_id_bridges_two_texts(spark, monkeypatch):
    fps = {"a": 0, "b": 0b111, "c": 0b111111, "d": 0xFFFF << 40, "e": (0xFFFF << 40) + 1}
    monkeypatch.setattr(simhash_trie, "fingerprints", lambda docs, *_: docs.selectExpr("doc_id", "cast(text as long) as fp"))
    rows = [(1, str(fps["a"])), (None, str(fps["b"])), (3, str(fps["c"])), (None, str(fps["d"])), (None, str(fps["e"])), (3, str(fps["c"]))]
    got = simhash_trie.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.fp: r.component_id for r in got} == {fps["a"]: 1, fps["b"]: 1, fps["c"]: 1, fps["d"]: None, fps["e"]: None} and len(got) == len(rows)


def plain_near(rows):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("block", [3, 1024])
def test_near_copies(spark, block):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(12):
        base = list(rng.choice(vocabulary, 220))
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 5):
            copy = list(base)
            for at in rng.integers(0, 220, k):  # few changed words: shingles similar by 0.8 or more
                copy[at] = "changed"
            rows.append((10 * i + k, " ".join(copy)))
    rows += [(1000, rows[0][1]), (None, rows[0][1]), (2000, None), (2001, ""), (3000, "same"), (3000, "same")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"label": F.lit(1), "component": F.lit(2), "digest": F.lit("x"), "row": F.lit(3), "first": F.lit(4), "a.b": F.lit(5)})
    got = near_copies.drop_near_copies(frame, block=block)
    assert got.columns == frame.columns
    groups = plain_near(rows)
    want = {min((rows[i][0] for i in range(len(rows)) if groups[i] == g and rows[i][0] is not None)) for g in set(groups)}
    ids = [r.doc_id for r in got.collect()]
    assert sorted(ids) == sorted(want)
    assert near_copies.drop_near_copies(frame.where("false")).count() == 0


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY = "aB3" + "x" * 37


def plain_spans(text):
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(s + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


SECRETS = [
    (1, "password=token:abcdefghij API_KEY : 'abcdefgh' 😀 secret=short passwd=\"12345678\""), (2, None), (3, ""), (4, "AKIA" + "A" * 11), (5, "😀AKIA" + "A1" * 8 + " é " + "0a" * 20),
    (6, f"AKIA{'B' * 16} and {KEY} at https://s3.example.com/x"), (7, f"only {KEY} alone, https://s3.example.com/x"), (8, f"AKIA{'B' * 16}{' ' * 400}{KEY}"),
    (6, f"AKIA{'B' * 16} and {KEY} at https://s3.example.com/x"), (None, "token=" + "ab" * 20), (9, "token = " * 2000 + "x" * 100000), (10, f"client_id=abcdef12 {KEY}"),
]


def test_secrets(spark):
    frame = spark.createDataFrame(SECRETS, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("kind", F.lit("x"))
    got = secret_scan.scan(frame).collect()
    base = sorted((str(r.doc_id), [(s.start, s.kind, s.stop) for s in r.base]) for r in got)
    assert base == sorted((str(d), plain_spans(t or "")) for d, t in SECRETS)
    linked = {r.doc_id: sorted(secret_scan.KINDS[s.kind] for s in r.linked) for r in got}
    assert linked[6] == ["endpoint", "key"] and linked[7] == [] and linked[8] == [] and linked[10] == ["client", "key"]
    assert secret_scan.scan(frame.where("false")).count() == 0
    joined = secret_scan.scan(frame).join(frame.select("doc_id", "text"), "doc_id").select("doc_id", secret_scan.redact(F.coalesce("text", F.lit("")), F.col("spans")).alias("t"))
    assert {r.t for r in joined.where("doc_id = 5").collect()} == {"😀[secret] é [secret]"}


def test_secrets_by_the_thousand(spark):
    text = "".join(f"é{'0a' * 16}token={'b' * 8}\n" if i % 3 else "password=token:abcdefghij 😀 " for i in range(20000))
    frame = spark.createDataFrame([(1, text), (2, "token=" + "0a" * 20 + " x")], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.scan(frame).join(frame, "doc_id").select("doc_id", "base", secret_scan.redact(F.col("text"), F.col("base")).alias("t")).collect()}
    for d, t in ((1, text), (2, "token=" + "0a" * 20 + " x")):
        want, out, at = plain_spans(t), [], 0
        assert [(s.start, s.kind, s.stop) for s in got[d].base] == want
        for start, _, stop in want:
            if start >= at:
                out += [t[at:start], "[secret]"]
            at = max(at, stop)
        assert got[d].t == "".join([*out, t[at:]])


def test_near_copies_with_stretches_added_cut_and_inserted(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    words = lambda n: list(rng.choice(vocabulary, n))
    rows = []
    for i in range(0, 400, 10):
        base = words(204)
        rows += [(i, base), (i + 1, base + words(48)), (i + 2, base[:165]), (i + 3, base[:90] + words(40) + base[90:])]
    rows = [(d, " ".join(w)) for d, w in rows]
    assert plain_near(rows) == [k // 4 * 4 for k in range(len(rows))]  # each copy is similar to its base by 0.8 or more
    got = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 400, 10))


def test_a_node_keeps_all_shingle_fingerprints(spark):
    x, s1, s2 = 0x0123456789ABCDE, 0, (1 << 40) - 1
    # The same words in another order (s1, s2), a near copy of one of them, and a text that is like neither.
    rows = [(x, s1), (x, s2), (x ^ 3, s2 ^ 1), (x ^ 24, 0xFFFFF << 43)]
    texts = spark.createDataFrame(rows, "fp long, second long")
    label = {r.node: r.component for r in components.components(near_copies._candidate_links(texts, 8)).collect()}
    assert x in label and label[x] == label[x ^ 3] and x ^ 24 not in label


def test_long_values_and_urls_are_redacted_whole(spark):
    access = "AKIA" + "B" * 16
    texts = [
        (1, f"{access} {KEY} https://s3.example.com/x?sig={'ab%2F' * 800} end"),
        (2, f"client_id={'v1' * 400} {KEY} end"),
        (3, f"{access} {KEY} {'a.' * 300}amazonaws.com end"),
        (4, "a." * 100000),  # no quadratic search
    ]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = secret_scan.scan(frame).join(frame, "doc_id").select("doc_id", secret_scan.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    s = "[secret]"
    assert {r.doc_id: r.t for r in got} == {1: f"{s} {s} {s} end", 2: f"{s} {s} end", 3: f"{s} {s} {s} end", 4: "a." * 100000}


@pytest.mark.parametrize(("size", "ids"), [(70_000, [66_000]), (100, [separator_scan.SEPARATOR])])
def test_token_files_refuse_ids_that_do_not_fit(spark, tmp_path, monkeypatch, size, ids):
    # A vocabulary in which one letter has an id beyond 16 bits, or that of the separator.
    import base64

    path = tmp_path / "vocabulary"
    singles = [bytes([i]) for i in range(256) if i != ord("z")]
    path.write_text("".join(f"{base64.b64encode(b).decode()} {i}\n" for i, b in enumerate(singles)) + f"{base64.b64encode(b'z').decode()} {ids[0]}\n")
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert separator_scan.write_tokens(docs, f"file://{tmp_path}/good", str(path)).count() == 2
    with pytest.raises(Exception, match="65535"):
        separator_scan.write_tokens(docs.unionByName(docs.selectExpr("3L as doc_id", "'z' as text")), f"file://{tmp_path}/bad", str(path))
