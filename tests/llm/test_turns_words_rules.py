"""Conversation tries, spelling variants and weakly supervised rules against plain versions, with odd rows."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terrace.llm import prefix_trie, quality_rules, spelling_variants

SF = "/root/testdata/sf0.01"


# ---- tries


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, role, digest, text))
    turns = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    rows = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(p))))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shown(nodes):
    return sorted((tuple(r[c] for c in COLUMNS) for r in nodes.collect()), key=repr)


def talk(spark, rows):
    # Extra columns with names that the operator uses inside.
    return spark.createDataFrame([(*r, "u", 7, "p") for r in rows], "conv_id long, turn long, role string, text string, unit string, level int, path string")


ODD_TURNS = [
    *((c, t, "user" if t % 2 else "assistant", f"turn {t} of {c % 3 if t > 1 else 0}") for c in range(40) for t in range(c % 7)),
    (41, None, None, None), (41, 2, "user", ""), (41, 2, "user", ""), (41, 2, "a", "tie"), (42, 0, "user", None), (43, 0, "user", "é" * 5000), (None, 1, "user", "no conversation"),
    *((50, t, "user", "same") for t in range(30)), *((51, t, "user", "same") for t in range(31)), *((c, t, "user", "same") for c in range(60, 80) for t in range(12)), (7, 100, "user", "end"),
]


@pytest.mark.parametrize("limit", [3, 40, 100_000])
def test_trie(spark, limit):
    members = prefix_trie.rebuilt(prefix_trie.conversation_paths(talk(spark, ODD_TURNS)))
    nodes = prefix_trie.trie(members, limit)
    want = plain_trie(plain_rebuilt(ODD_TURNS))
    assert shown(nodes) == want
    # Every node but the root says its last turn.
    texts = prefix_trie.turn_texts(talk(spark, ODD_TURNS))
    assert nodes.join(texts, "turn").count() == len(want) - 1


def test_trie_of_nothing_and_of_turnless(spark):
    paths = prefix_trie.conversation_paths(talk(spark, ODD_TURNS).where("false"))
    assert prefix_trie.trie(prefix_trie.rebuilt(paths)).collect() == []
    empty = spark.createDataFrame([(3, ""), (12, "")], "conv_id long, path string")
    assert shown(prefix_trie.trie(empty)) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,12").hexdigest())]


def test_trie_of_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert shown(prefix_trie.op11_conversation_trie(spark, SF)) == plain_trie(plain_rebuilt(rows))


def test_a_hot_first_turn_is_split_behind_its_stem(spark):
    # 300 conversations share 50 turns and then differ: one split, by the turn behind the stem.
    rows = [(c, t, "user", f"{t}" if t < 50 else f"{c} {t}") for c in range(300) for t in range(53)]
    paths = prefix_trie.conversation_paths(talk(spark, rows))
    assert shown(prefix_trie.trie(paths, 500)) == plain_trie({c: [("user", f"{t}" if t < 50 else f"{c} {t}") for t in range(53)] for c in range(300)})


# ---- spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_vocabulary(rows, every=97):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(vocab):
    by_length = defaultdict(list)
    for w in vocab:
        by_length[len(w)].append(w)
    form, out = {}, {}
    for w, n in vocab.items():
        others = [o for k in (-1, 0, 1) for o in by_length[len(w) + k] if near(w, o)]
        best = min(others, key=lambda o: (-vocab[o], o), default=None)
        form[w] = best if best and vocab[best] >= 2 * n else None
        out[w] = (n, len(others))
    rows = []
    for w, (n, k) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, k, vocab[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


def variants_of(found):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()), key=repr)


def word_docs(spark):
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abababa", "hello", "hallo", "hell", "hellos", "Éclair", "éclair", "Eclair", "straße", "strasse", "x" * 300, "x" * 299 + "y", "÷÷÷÷÷×"]
    texts = [f" {w} 1{w}, {w.upper() if w.isascii() else w};\n" * (3 + i % 5) for i, w in enumerate(words)]
    rows = [(i % 4, t) for i, t in enumerate(texts)] + [(None, texts[0]), (8, None), (9, ""), (10, "日本語 naïveté naïveté naïveté"), (11, "hello " * 40_000), (11, "hello " * 3)]
    return rows, spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, word string, n int")


def test_spelling_of_odd_rows(spark):
    rows, docs = word_docs(spark)
    for every in (97, 3, None):
        vocab = spelling_variants.vocabulary(docs, every=every)
        assert {r.word: r.n for r in vocab.collect()} == plain_vocabulary(rows, every)
    assert variants_of(spelling_variants.variants(vocab)) == plain_variants(plain_vocabulary(rows, None))
    assert spelling_variants.variants(spelling_variants.vocabulary(docs.where("false"))).count() == 0


def test_words_of_few_letters_are_all_met(spark):
    # Words over two letters share all their bigrams; every pair still has to be found.
    words = {format(i, "b").replace("0", "a").replace("1", "b").rjust(5, "a"): 3 + i % 40 for i in range(600)}
    vocab = spark.createDataFrame(list(words.items()), "word string, n long")
    assert variants_of(spelling_variants.variants(vocab)) == plain_variants(words)


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    # Exploded rows and written tables of words are sized far below what they hold, so Spark would broadcast them at its default.
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b") == str(10 << 20)
    words = {format(i, "b").replace("0", "a").replace("1", "b").rjust(5, "a"): 3 + i % 40 for i in range(60)}
    vocab = spark.createDataFrame(list(words.items()), "word string, n long")
    assert "BroadcastHashJoin" not in plan(spelling_variants.near_pairs(vocab))
    assert "Broadcast" not in plan(spelling_variants.variants(vocab))
    rare = plan(spelling_variants.rare_bigrams(vocab))
    assert rare.count("BroadcastHashJoin") == 1 and "Generate" not in rare[rare.index("BroadcastExchange") :]
    monkeypatch.setattr(spelling_variants, "BIGRAMS", 3)
    assert "Broadcast" not in plan(spelling_variants.rare_bigrams(vocab))
    assert variants_of(spelling_variants.variants(vocab)) == plain_variants(words)


def test_long_texts_are_cut_between_words():
    text = b"abc, " * 100 + b"d" * 50 + b" e"
    pieces = list(spelling_variants._pieces(text, 20))
    assert b"".join(pieces) == text and len(pieces) > 10 and sum((re.findall(b"[a-z]+", p) for p in pieces), []) == re.findall(b"[a-z]+", text)


# ---- rules


def plain_measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


RULE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 8), (2, None), (3, ""), (4, " \n\t \x0b"), (5, "one two three four five"), (5, "one two three four five"), (None, "a b c d e a b c d e f"),
    (6, "same line\nsame line\n same line\n\nother * # $\n" * 5), (7, "x" * 5000), (8, "日本語 naïve É " * 50), (9, "a " * 30_000), (10, "w1 w2 w3 w4 w5 w6 " * 3 + " ".join(f"u{i}" for i in range(60))),
]


def rule_docs(spark):
    return spark.createDataFrame([(*r, 0, "v") for r in RULE_ROWS], "doc_id long, text string, n_words int, quality string")


def test_measures(spark):
    key = lambda d, m: (str(d), *(m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))
    for rows, docs in ((RULE_ROWS, rule_docs(spark)), (None, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))):
        rows = rows or [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(key(r.doc_id, r) for r in quality_rules.measures(docs).collect()) == sorted(key(d, plain_measures(t)) for d, t in rows)
    assert quality_rules.judge(rule_docs(spark).where("false")).count() == 0


def test_estimates_follow_the_plain_recursion(spark):
    voted = quality_rules.votes(quality_rules.measures(spark.read.parquet(f"{SF}/documents.parquet"))).cache()
    names, start = list(quality_rules.RULES), quality_rules.start()
    counts = Counter(tuple(r[f"v_{n}"] for n in names) for r in voted.collect())
    p, t, s = start["p"], {n: start[f"t_{n}"] for n in names}, {n: start[f"s_{n}"] for n in names}
    w, within = quality_rules.WEIGHT, lambda x, low, high: min(high, max(low, x))
    for _ in range(quality_rules.STEPS):
        odds = {v: math.log(p / (1 - p)) + sum(math.log(t[n] / (1 - s[n])) if x > 0 else math.log((1 - t[n]) / s[n]) if x else 0 for x, n in zip(v, names, strict=True)) for v in counts}
        q = {v: 1 / (1 + math.exp(-x)) for v, x in odds.items()}
        p = within(sum(c * q[v] for v, c in counts.items()) / sum(counts.values()), 0.05, 0.99)
        for i, n in enumerate(names):
            good, bad = ({k: sum(c * g(q[v]) for v, c in counts.items() if v[i] == k) for k in (1, -1)} for g in (lambda x: x, lambda x: 1 - x))
            t[n] = within((quality_rules.FOR * w + good[1]) / (w + good[1] + good[-1]), 0.8, 0.995)
            s[n] = within((quality_rules.AGAINST * w + bad[-1]) / (w + bad[1] + bad[-1]), 0.21, 0.98)
    got = quality_rules.fit(voted)
    assert got == pytest.approx({"p": p} | {f"t_{n}": t[n] for n in names} | {f"s_{n}": s[n] for n in names}, abs=1e-9)
    voted.unpersist()


def test_one_odd_rule_rejects_nothing(spark):
    found = quality_rules.op13_quality_rules(spark, SF)
    kept = found.where("kept and votes like '%-%'").count()
    assert kept > 0
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    verdicts = found.select("doc_id", F.col("kept").cast("double").alias("kept")).join(labels, "doc_id")
    share = {r["label"]: r["kept"] for r in verdicts.groupBy("label").agg(F.avg("kept").alias("kept")).collect()}
    # Texts labelled good stay.
    assert share[1] > 0.98 and share[0] < share[1]


def test_no_python_runs_on_the_rules_path(spark):
    plan = quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and os.path.isdir(SF)
