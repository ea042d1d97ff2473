"""Secret scan with multipart credential linking; DataFrame functions only.

Base kinds (positions in code points, end exclusive, leftmost and not overlapping per kind):

* ``assign``  a password-like name, ``:`` or ``=``, and a value of 8 or more characters
* ``access``  ``AKIA`` and capitals or digits, 16 or more characters in all
* ``hex``     32 or more lower-case hexadecimal digits

Candidates too weak to report alone:

* ``key``       a stand-alone run of exactly 40 base64 characters with a digit, a capital and a small letter
* ``client``    ``client_id = value``, ``access_key_id = value`` and the like
* ``endpoint``  an http(s) URL or an ``amazonaws.com`` host

A candidate is reported only if a complementary part lies within ``scope`` code points of it in the same
document: a ``key`` needs an identifier (``access`` or ``client``), a ``client`` needs a secret (``assign``,
``hex`` or ``key``), an ``endpoint`` needs an identifier and a secret. Parts meet by an interval join on
(document, block of ``scope`` code points): each block is reduced to the parts' first start and last end
before the join, so a document with very many parts makes a row per block and never a row per pair.

Positions come from the gaps before matches: ``\\G(.*?)(pattern)`` yields each gap, and lengths add up to positions;
``\\G`` keeps a text without further matches linear. Positions and spans are made block by block, and text is cut from
stretches of it, so that a text with very many matches costs little more than its length.

Null text counts as empty; null ids are kept; repeated rows give repeated results; texts may be of any length; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import table, written

SCOPE = 200
ASSIGN = (
    "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?",
    "[A-Za-z0-9+/_.=-]+",
)
ACCESS = "AKIA[A-Z0-9]{12,}"  # a run that fails at its first AKIA fails at later ones too
HEX = "[0-9a-f]{32,}"
KEY = (
    "(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])"
    "[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
)
CLIENT_NAME = "(?i:client_id|app_id|account_id|access_key_id|user_id)[\"']?\\x20*[:=]\\x20*[\"']?"
CLIENT = CLIENT_NAME + "[A-Za-z0-9_-]{6,}"
URL = "https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]"
#: A host starts where its characters do, so a long run of them is tried once.
ENDPOINT = URL + "{4,}|(?<![a-z0-9.-])[a-z0-9.-]+\\.amazonaws\\.com"
#: The same without look-around, which the SQL's RE2 lacks: greedy matches from the left start there anyway.
SQL_ENDPOINT = URL + "{4,}|[a-z0-9.-]+\\.amazonaws\\.com"
#: Order among spans that start together.
KINDS = ("assign", "access", "hex", "key", "client", "endpoint")
SPANS = "array<struct<start:int,kind:int,stop:int>>"


#: Items of a block. An aggregate copies what it gathers at every step, so it gathers a block's items only.
BLOCK = 64


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _by_blocks(items: Column, total, more, step, kind: str) -> Column:
    """Runs ``step(at, out, item) -> (at, out)`` over ``items`` and gives all that went to ``out`` (arrays of ``kind``).

    ``at`` starts at 0; ``total(block)`` is what a block adds to it and ``more(at, t)`` adds it, so that each block
    of items can start from the ones before it."""

    def run(x: Column) -> Column:
        block = lambda i: F.slice(x, i * BLOCK + 1, F.lit(BLOCK))
        numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / BLOCK).cast("int"), F.lit(0)))

        def from_totals(totals: Column) -> Column:
            before = lambda i: F.aggregate(F.slice(totals, F.lit(1), i), F.lit(0), more)
            start = lambda i: F.struct(before(i).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

            def add(acc: Column, item: Column) -> Column:
                at, out = step(acc["at"], acc["out"], item)
                return F.struct(at.alias("at"), out.alias("out"))

            return F.flatten(F.transform(numbers, lambda i: F.aggregate(block(i), start(i), add, lambda acc: acc["out"])))

        return _bound(F.transform(numbers, lambda i: total(block(i))), from_totals)

    return _bound(items, run)


def _matches(text: Column, pattern: str, kind: str, value: str = "", least: int = 0) -> Column:
    """All spans of ``pattern`` followed by ``value``, without those whose value is shorter than ``least``."""
    full = F.lit(f"(?s)\\G(.*?)({pattern}({value}))")
    part = lambda g: F.transform(F.regexp_extract_all(text, full, F.lit(g)), lambda x: F.length(x))
    parts = F.arrays_zip(part(1).alias("gap"), part(2).alias("own"), part(3).alias("value"))

    def step(at: Column, out: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (begin + x["own"]).alias("stop"))
        return begin + x["own"], F.when(x["value"] >= least, F.concat(out, F.array(span))).otherwise(out)

    total = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["gap"] + x["own"])
    found = _by_blocks(parts, total, lambda at, t: at + t, step, SPANS[6:-1])
    return F.when(F.regexp_like(text, F.lit(f"(?:{pattern}){value}")), found).otherwise(F.array().cast(SPANS))


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, base, weak): the base spans and the candidates of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("digest"),
        F.concat(_matches(text, *ASSIGN[:1], "assign", ASSIGN[1], 8), _matches(text, ACCESS, "access"), _matches(text, HEX, "hex")).alias("base"),
        F.concat(_matches(text, KEY, "key"), _matches(text, CLIENT, "client"), _matches(text, ENDPOINT, "endpoint")).alias("weak"),
    )


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, digest, linked): the candidates with complementary parts in their scope."""
    number = KINDS.index
    some = parts.where(F.size("weak") > 0).select("doc_id", "digest", F.explode(F.concat("base", "weak")).alias("s")).select("doc_id", "digest", "s.*").distinct()
    side = F.when(F.col("kind").isin(number("access"), number("client")), "id").when(F.col("kind") == number("endpoint"), "place").otherwise("secret")
    some = some.withColumn("side", side)
    blocks = (
        some.where("side != 'place'")
        .withColumn("block", F.explode(F.sequence(F.expr(f"start div {scope}"), F.expr(f"(stop - 1) div {scope}"))))
        .groupBy("doc_id", "digest", "side", "block")
        .agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    )
    near = F.sequence(F.expr(f"greatest(0L, start - {scope}) div {scope}"), F.expr(f"(stop - 1 + {scope}) div {scope}"))
    weak = some.where(F.col("kind") >= number("key")).withColumn("block", F.explode(near))
    a, b = weak.alias("a"), blocks.alias("b")
    # A candidate's own span is on its own side, which never completes it.
    met = a.join(
        b,
        F.expr(
            f"a.doc_id <=> b.doc_id and a.digest = b.digest and a.block = b.block and a.side != b.side "
            f"and b.first <= a.stop + {scope} and b.last >= a.start - {scope}"
        ),
    )
    sides = met.groupBy("a.doc_id", "a.digest", "a.start", "a.kind", "a.stop").agg(
        F.max(F.expr("b.side = 'id'")).alias("has_id"), F.max(F.expr("b.side = 'secret'")).alias("has_secret")
    )
    whole = F.when(F.col("kind") == number("endpoint"), F.col("has_id") & F.col("has_secret")).otherwise(F.lit(True))
    return sides.where(whole).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, base, linked, spans): arrays of (start, kind, stop), spans sorted; a row for each input row."""
    parts = written(find_parts(docs, id_col, text_col), "secret-parts")
    linked = link_parts(parts, scope)
    p, q = parts.alias("p"), linked.alias("q")
    none = F.array().cast(SPANS)
    out = p.join(q, F.expr("p.doc_id <=> q.doc_id and p.digest = q.digest"), "left").select(
        "p.doc_id", "p.digest", F.array_sort("p.base").alias("base"), F.coalesce("q.linked", none).alias("linked")
    )
    return out.withColumn("spans", F.array_sort(F.concat("base", "linked")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


#: Code points of a stretch; cutting counts characters from a stretch's start, not from the text's.
STRETCH = 4096


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with each maximal stretch of overlapping spans (sorted by start) replaced by ``mark``."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        """The code points from ``a`` up to ``b``."""
        first, last = F.floor(a / STRETCH).cast("int"), F.floor(b / STRETCH).cast("int")
        piece = lambda i: F.coalesce(F.try_element_at(pieces, i + 1), F.lit(""))
        inside = F.substring(piece(first), a - first * STRETCH + 1, b - a)
        between = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        across = F.concat(F.substring(piece(first), a - first * STRETCH + 1, F.lit(STRETCH)), between, F.substring(piece(last), F.lit(1), b - last * STRETCH))
        return F.when(b <= a, "").when(first == last, inside).otherwise(across)

    def step(at: Column, out: Column, s: Column) -> tuple[Column, Column]:
        gap = F.struct(at.alias("a"), s["start"].alias("b"))
        # A span that starts before the end of another is part of its mark; ``at`` is 0 before the first only, as spans aren't empty.
        return F.greatest(at, s["stop"]), F.when((at == 0) | (s["start"] >= at), F.concat(out, F.array(gap))).otherwise(out)

    furthest = lambda block: F.aggregate(block, F.lit(0), lambda acc, s: F.greatest(acc, s["stop"]))
    gaps = _by_blocks(spans, furthest, lambda at, t: F.greatest(at, t), step, "struct<a:int,b:int>")
    end = furthest(spans)
    done = _bound(pieces, lambda p: F.concat(F.array_join(F.transform(gaps, lambda g: F.concat(cut(p, g["a"], g["b"]), F.lit(mark))), ""), cut(p, end, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def oracle_sql(scope: int = SCOPE) -> str:
    """The query in DuckDB's SQL. RE2 has no look-around: ``key`` is taken from maximal runs instead."""

    def spans(kind: str, pattern: str, value: str = "", where: str = "true", gate: str = "") -> str:
        full = f"(?s)(.*?)({pattern}({value}))".replace("'", "''")
        gate = (gate or f"(?:{pattern}){value}").replace("'", "''")
        pick = ", ".join(f"unnest(regexp_extract_all(x, '{full}', {g})) AS {n}" for g, n in ((1, "gap"), (2, "own"), (3, "val")))
        return f"""SELECT rid, {KINDS.index(kind)} AS kind, e - length(own) AS s, e FROM (
          SELECT *, sum(length(gap) + length(own)) OVER (PARTITION BY rid ORDER BY i)::BIGINT AS e FROM (
          SELECT rid, {pick}, unnest(range(len(regexp_extract_all(x, '{full}', 1)))) AS i FROM t WHERE regexp_matches(x, '{gate}'))) WHERE {where}"""

    key = "length(own) = 40 AND NOT contains(own, '=') AND regexp_matches(own, '[0-9]') AND regexp_matches(own, '[A-Z]') AND regexp_matches(own, '[a-z]')"
    parts = " UNION ALL ".join([
        spans("assign", ASSIGN[0], ASSIGN[1], "length(val) >= 8"), spans("access", ACCESS), spans("hex", HEX),
        spans("key", "[A-Za-z0-9+/=]+", "", key, "[A-Za-z0-9+/]{40}"), spans("client", CLIENT), spans("endpoint", SQL_ENDPOINT),
    ])
    text = lambda where: (
        f"coalesce(string_agg({list(KINDS)}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER ({where}), '')"
    )
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
    p AS (SELECT *, CASE WHEN kind IN (1, 4) THEN 'id' WHEN kind = 5 THEN 'place' ELSE 'secret' END AS side FROM ({parts})),
    met AS (SELECT a.rid, a.kind, a.s, a.e, bool_or(b.side = 'id') AS i, bool_or(b.side = 'secret') AS k FROM p a JOIN p b
      ON a.rid = b.rid AND a.kind >= 3 AND b.side <> 'place' AND a.side <> b.side AND b.s <= a.e + {scope} AND b.e >= a.s - {scope} GROUP BY ALL),
    kept AS (SELECT rid, kind, s, e FROM p WHERE kind < 3 UNION ALL SELECT rid, kind, s, e FROM met WHERE kind < 5 OR (i AND k))
    SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
      sha256({text("kind < 3")}) AS base_sha256, {text("kind IS NOT NULL")} AS spans
    FROM t LEFT JOIN kept USING (rid) GROUP BY rid, doc_id"""
