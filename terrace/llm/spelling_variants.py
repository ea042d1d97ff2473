"""Spelling variants: words one edit apart, found by a rare-first q-gram prefix filter; counted in Python, joined and verified by DataFrame functions.

One inserted, deleted or replaced code point changes two bigrams of a word at most. Bigrams are put in one global order,
rarest in the vocabulary first (ties by bigram, then by position); then the first bigram that two near words share is
among the three rarest of both, as at most two others come before it in either word.

The edit lies wholly behind that shared bigram or wholly before it. Behind, the bigram stands equally far from both
words' starts and the text up to it is equal; before, equally far from both ends, and the text from it on is equal.
These position limits go into the join key. The rest of the two words is one edit apart, so its first half or its last
half is equal too, counted by the shorter rest; the key holds that half and the length. A word so has 24 keys at
most, a key meets few words, and each pair that meets is verified by its edit distance.

Keys are 64-bit hashes: words that share one by chance fail the verification. No pair of near words is lost, and there is no cap.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import table, written

RUN = "[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = rb"a-z\xc0-\xff"
NO_LETTER = re.compile(rb"[^%s]" % LETTERS)
#: Bigrams of a word that are joined: one more than an edit can change.
RAREST = 3
#: Bigrams whose frequencies each task gets whole: the letters of ``vocabulary`` make 8,100 at most. More are joined by a shuffle.
BIGRAMS = 1 << 16


def _pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``text`` cut behind runs of letters, so that the words of a very long text are never all in memory."""
    at = 0
    while at < len(text):
        gap = NO_LETTER.search(text, at + size)
        stop = gap.end() if gap else len(text)
        yield text[at:stop]
        at = stop


def _counted(length: int, every: int | None, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (doc_id: string, text) to (word, n): what each ``rows`` or more distinct words of a task have come to."""
    letters = re.compile(rb"[%s]{%d,}" % (LETTERS, length))

    def out(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in counts]), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        crc = zlib.crc32
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                if not text.is_valid:
                    continue
                # A byte is a code point; others become question marks, which are no letters. A-Z alone is ASCII, as is all that bytes put in lower case.
                own: Counter[bytes] = Counter()
                for piece in _pieces(text.as_py().encode("latin-1", "replace").lower()):
                    own.update(letters.findall(piece))
                start = crc(f"{doc_id.as_py() or ''}:".encode())
                for word, n in own.items():
                    if every and not (h := crc(word if word.isascii() else word.decode("latin-1").encode(), start)) % every:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) < length:
                            continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= rows:
                    yield out(counts)
                    counts = {}
        if counts:
            yield out(counts)

    return run


def vocabulary(docs: DataFrame, length: int = 5, least: int = 3, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of maximal runs of letters of all whole texts, A-Z in lower case: those of ``length`` or more code points that occur ``least`` times or more.

    With ``every``, one in so many runs of a document has lost a letter: h = crc32 of ``<doc_id>:<run>``; if ``every`` divides it, the one at
    h % length. Null texts have no words, a null id counts as empty. Tasks count before the shuffle, so a frequent word is a row a task."""
    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_counted(length, every, 1 << 18), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rare_bigrams(vocab: DataFrame) -> DataFrame:
    """(word, n, at): positions (from 0) of each word's three rarest bigrams, in the global order."""
    grams = vocab.select("word", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("at", "gram"))
    # Spark sizes exploded rows as the file they come from, and would broadcast them; the frequencies are as many as pairs of letters.
    often = written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")), "bigram-counts")
    often = F.broadcast(often) if often.limit(BIGRAMS + 1).count() <= BIGRAMS else often.hint("merge")
    order = F.array_sort(F.collect_list(F.struct("often", "gram", "at")))
    ranked = grams.join(often, "gram").groupBy("word", "n").agg(F.slice(order, 1, RAREST).alias("rare"))
    return ranked.select("word", "n", F.explode("rare.at").alias("at"))


def _keys(rare: DataFrame) -> DataFrame:
    """(key, own, word, n): the keys of each word; ``own`` where its rest counts as the shorter or equal one."""
    word, at, length = F.col("word"), F.col("at"), F.length("word")
    sides = ((F.substring(word, F.lit(1), at + 2), F.substring(word, at + 3, length)), (F.substring(word, at + 1, length), F.substring(word, F.lit(1), at)))
    keys = []
    for side, (kept, rest) in enumerate(sides):
        for own in (True, False):
            r = F.length(rest) - (0 if own else 1)
            half = F.floor(r / 2).cast("int")
            first, last = F.substring(rest, F.lit(1), half), F.right(rest, r - half)
            # A rest of no length has two empty halves, of which one is enough; there is none shorter than that.
            for k, (part, ok) in enumerate(((first, r >= 0), (last, r > 0))):
                keys.append(F.struct(F.when(ok, F.xxhash64(F.lit(2 * side + k), kept, r, part)).alias("key"), F.lit(own).alias("own")))
    return rare.select("word", "n", F.inline(F.array(*keys))).where("key is not null")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each two words of ``vocab`` (word: distinct, n) exactly one edit apart, once, with a as long as b or one shorter."""
    keys = _keys(written(rare_bigrams(vocab), "bigrams"))
    a = keys.where("own").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = keys.select("key", "own", F.col("word").alias("b"), F.col("n").alias("n_b"))
    # Keys are 24 rows a bigram, which Spark sizes as the bigrams' file: shuffled at any size, never broadcast.
    met = a.join(b.hint("merge"), "key").where("if(own, length(a) = length(b) and a < b, length(a) + 1 = length(b))")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def forms(vocab: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n): the number of near words, and the one of largest n (ties: smallest), if that is ``times`` the word's n or more."""
    pairs = near_pairs(vocab)
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    found = vocab.join(best.hint("merge"), "word", "left")
    high = -F.col("best.m") >= times * F.col("n")
    return found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(high, F.col("best.other")).alias("form"), F.when(high, -F.col("best.m")).alias("form_n")
    )


def roots(found: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. A form's n is at least twice the word's, so chains are short and have no
    cycle; each round doubles the steps taken, and its table is written, so that a lost executor repeats one round. A written
    table of words is several times its file in memory, so none is broadcast."""
    steps = written(found.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps, before = written(steps.join(on.hint("merge"), "root").select("word", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "roots"), steps
        if not steps.where("moved").limit(1).count():
            return before.select("word", "root")
        steps = steps.drop("moved")


def variants(vocab: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``vocab`` (word, n). Words are distinct and have four code points or more.

    An empty vocabulary gives an empty result; a word without near words has itself as its root; columns besides word and n are left out."""
    found = written(forms(written(vocab.select("word", "n"), "vocabulary"), times), "forms")
    return found.join(roots(found).hint("merge"), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents. Null texts have no words, a null id counts as empty, repeated rows count
    again, texts may be of any length, other columns are ignored, an empty table gives an empty result."""
    return variants(vocabulary(table(spark, sf_dir, "documents"), every=97))


def _crc_table() -> list[int]:
    """The 256 remainders of CRC-32 (polynomial 0xEDB88320), for the SQL."""
    table_ = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table_.append(c)
    return table_


#: DuckDB has no CRC-32: bytes of these letters are one or two. Near words are those that share a deletion of one place, or whose deletion is the other.
ORACLE = f"""WITH RECURSIVE run AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS pre, translate(unnest(regexp_extract_all(text, '{RUN}')), '{CAPITALS}', '{SMALL}') AS x FROM documents),
counted AS (SELECT pre, x, count(*) AS k FROM run GROUP BY ALL),
bytes AS (SELECT x, k, flatten(list_transform(string_split(pre || x, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c)::BIGINT // 64, 128 + unicode(c)::BIGINT % 64] END)) AS b FROM counted),
hashed AS (SELECT x, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, z: xor(({_crc_table()}::BIGINT[])[(xor(c, z) & 255) + 1], c >> 8)), 4294967295) AS h FROM bytes),
word_ AS (SELECT CASE WHEN h % 97 = 0 THEN substr(x, 1, (h % length(x))::INT) || substr(x, (h % length(x))::INT + 2) ELSE x END AS word, k FROM hashed),
vocab AS (SELECT word, sum(k)::BIGINT AS n FROM word_ WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS d FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM vocab)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM cut d JOIN vocab v ON d.d = v.word UNION SELECT v.word, d.word, d.n FROM cut d JOIN vocab v ON d.d = v.word),
best AS (SELECT word, count(*) AS n_near, list_sort(list({{'m': -m, 'o': other}}))[1] AS b FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * n THEN b.o END AS form, CASE WHEN -b.m >= 2 * n THEN -b.m END AS form_n FROM vocab LEFT JOIN best USING (word)),
walk(word, here, k) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT w.word, f.form, k + 1 FROM walk w JOIN formed f ON f.word = w.here WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN (SELECT word, max_by(here, k) AS root FROM walk GROUP BY word) USING (word)"""
