"""Quality rules under weak supervision; DataFrame functions only.

Each rule votes for a text (1), against it (-1) or abstains (0), by two thresholds with a gap between them. That a text is
good is hidden. A rule that votes has two accuracies: how often it votes for a good text, and how often against a bad one
(a bad text breaks a few rules only, so a vote for it says little). Expectation-maximisation estimates them and the share
of good texts from which votes go together: texts of equal votes count together, so each step is one aggregation over
3 ** rules rows at most, whatever the number of documents. A text is kept if the posterior probability that it is good
is a half or more, so that one odd rule need not reject it.

Accuracies start at ``FOR`` and ``AGAINST``, are drawn there by ``WEIGHT`` votes and stay within bounds in which a vote
against never speaks for a text; that tells the good class from the other. The number of steps is fixed.

Null text counts as empty; null ids stay; repeated rows give repeated results; texts may be of any length (arrays of one
text's words are held); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import table, written

SPACE = "\\x20\\x09-\\x0D"
SYMBOL = "[#*$%&|<>]"
ENDED = f"[.!?:;…»\"”'’)][{SPACE}]*\\z"
#: Names of a page's furniture, for a rule that can only vote against.
FURNITURE = "(?i)(lorem ipsum|javascript|cookie policy|privacy policy|all rights reserved|terms of (use|service)|click here|\\{\\{|\\}\\})"
#: Frequent short words of English, German, French and Spanish, for a rule on running text.
COMMON = "the|of|and|to|in|that|is|with|der|die|das|und|ist|nicht|le|la|les|de|des|et|que|el|los|y|en"
WINDOW = 5
#: Measure, and the expressions (in SQL of both engines) under which it votes for and against.
RULES = {
    "length": ("n_words >= 50", "n_words < 20"),
    "word_length": ("n_words > 0 and word_chars between 3.0 * n_words and 10.0 * n_words", "word_chars > 14.0 * n_words or word_chars < 2.0 * n_words or n_words = 0"),
    "symbols": ("n_symbols <= 0.02 * n_words", "n_symbols > 0.1 * n_words"),
    "letters": ("n_letters >= 0.8 * word_chars and word_chars > 0", "n_letters < 0.6 * word_chars or word_chars = 0"),
    "repeated_lines": ("n_lines > 2 and n_dup_lines <= 0.1 * n_lines", "n_dup_lines > 0.3 * n_lines"),
    "repeated_words": ("n_repeat_words <= 0.05 * n_words and n_words >= 20", "n_repeat_words > 0.15 * n_words"),
    "line_ends": ("n_lines > 0 and n_ended >= 0.5 * n_lines", "n_lines > 3 and n_ended < 0.1 * n_lines"),
    "line_length": ("n_lines > 0 and n_words >= 8.0 * n_lines", "n_lines > 3 and n_words < 3.0 * n_lines"),
    "marked_words": ("n_marked <= 0.02 * n_words", "n_marked > 0.1 * n_words"),
    "common_words": ("n_common >= 0.04 * n_words and n_common >= 2", "n_words >= 50 and n_common < 0.01 * n_words"),
    "furniture": ("false", "n_furniture > 0 and 200.0 * n_furniture > n_words"),
}
STEPS, PRIOR, FOR, AGAINST, WEIGHT = 20, 0.9, 0.95, 0.4, 10.0


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of five which occur twice or more in the array.

    Windows are compared by 64-bit hashes. Only an array with a repeated one is sorted: then equal windows are neighbours."""
    at = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))
    windows = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        step = lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW)))
        return F.aggregate(F.transform(starts, step), F.lit(0), lambda acc, x: acc + x)

    def repeated(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))
        return _bound(F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["i"])), covered)

    def of(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bound(ordered, repeated)).otherwise(F.lit(0))

    return _bound(windows, of)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_repeat_words, n_lines, n_dup_lines, n_ended, n_symbols, n_letters, n_furniture, n_marked, n_common) of each whole text, in one pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    of_words = _bound(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    ended = lambda x: F.rlike(x, F.lit(ENDED))
    of_lines = _bound(
        lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"), F.size(F.filter(x, ended)).alias("n_ended"))
    )
    own = docs.select(
        F.col(id_col).alias("doc_id"), of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(SYMBOL)).alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^\\p{L}]+", "")).alias("n_letters"), F.regexp_count(text, F.lit(FURNITURE)).alias("n_furniture"),
        F.regexp_count(text, F.lit(f"{SYMBOL}[{SPACE}]")).alias("n_marked"), F.regexp_count(text, F.lit(f"(?i)[{SPACE}]({COMMON})[{SPACE}]")).alias("n_common"),
    )
    own = own.select("doc_id", "w.*", "l.*", "n_symbols", "n_letters", "n_furniture", "n_marked", "n_common")
    return own.select("doc_id", *(F.col(c).cast("long") for c in own.columns[1:]))


def votes(measured: DataFrame) -> DataFrame:
    """``measured`` with a column ``v_<rule>`` for each rule: 1, -1 or 0."""
    vote = lambda good, bad: F.expr(f"case when {good} then 1 when {bad} then -1 else 0 end")
    return measured.withColumns({f"v_{name}": vote(*sides) for name, sides in RULES.items()})


def posterior(prior: str, right_for: list[str], right_against: list[str]) -> str:
    """The probability that a text is good, in SQL, from its votes: each adds the logarithm of how much likelier it is for a good one."""
    terms = (f"case v_{name} when 1 then ln(({t}) / (1 - ({s}))) when -1 then ln((1 - ({t})) / ({s})) else 0 end" for name, t, s in zip(RULES, right_for, right_against, strict=True))
    return f"1 / (1 + exp(-(ln(({prior}) / (1 - ({prior}))) + {' + '.join(terms)})))"


def _sums() -> dict[str, str]:
    """The next estimates in SQL, as sums over texts' votes (c of them, good with probability q): p, and t_ and s_ of each rule.

    s_ is how often a rule votes against a bad text; bounds keep it above how often it does against a good one."""
    out = {"p": "least(0.99, greatest(0.05, sum(c * q) / sum(c)))"}
    share = lambda hit, of, start: f"({start * WEIGHT:.1f} + sum(c * {of} * case when {hit} then 1 else 0 end)) / ({WEIGHT:.1f} + sum(c * {of} * abs(v_{name})))"
    for name in RULES:
        out[f"t_{name}"] = f"least(0.995, greatest(0.8, {share(f'v_{name} = 1', 'q', FOR)}))"
        out[f"s_{name}"] = f"least(0.98, greatest(0.21, {share(f'v_{name} = -1', '(1 - q)', AGAINST)}))"
    return {c: out[c] for c in start()}


def fit(voted: DataFrame, steps: int = STEPS) -> dict[str, float]:
    """p, the share of good texts, and t_<rule> and s_<rule>, after ``steps`` of expectation and maximisation over all texts' votes.

    The driver sees one row of sums a step. Without texts the start stays."""
    patterns = written(voted.groupBy(*(f"v_{name}" for name in RULES)).agg(F.count(F.lit(1)).alias("c")).coalesce(1), "votes")
    found = start()
    for _ in range(steps):
        sums = patterns.withColumn("q", F.expr(_posterior(found))).agg(*(F.expr(x).cast("double").alias(c) for c, x in _sums().items())).first().asDict()
        if sums["p"] is None:
            break
        found = sums
    return found


def start() -> dict[str, float]:
    return {"p": PRIOR} | {f"t_{name}": FOR for name in RULES} | {f"s_{name}": AGAINST for name in RULES}


def _posterior(found: dict[str, float]) -> str:
    shown = {c: f"{x!r}D" for c, x in found.items()}
    return posterior(shown["p"], [shown[f"t_{name}"] for name in RULES], [shown[f"s_{name}"] for name in RULES])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures, the votes and ``quality``, the posterior probability that the text is good (nine decimals)."""
    voted = votes(written(measures(docs, id_col, text_col), "quality-measures"))
    return voted.withColumn("quality", F.round(F.expr(_posterior(fit(voted))), 9))


#: A text fails outright under this number of words, or above this share (in percent) of repeated ones.
BASE = "(n_words < 10 or 100 * n_repeat_words > 20 * n_words)"
SHOWN = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
MARKS = " || ".join(f"case v_{name} when 1 then '+' when -1 then '-' else '0' end" for name in RULES)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measures, votes and verdict: ``kept`` unless it fails outright or its posterior is under a half."""
    found = judge(table(spark, sf_dir, "documents"))
    return found.selectExpr(*SHOWN.split(", "), f"{BASE} as base_failed", f"not {BASE} and quality >= 0.5 as kept", f"{MARKS} as votes", "round(quality, 6) as quality")


def oracle_sql(steps: int = STEPS) -> str:
    """The query in DuckDB's SQL: windows are unnested and grouped, and the steps are a recursion over one row of estimates."""
    columns, estimates = [f"v_{name}" for name in RULES], start()
    vote = ", ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END AS v_{name}" for name, (good, bad) in RULES.items())
    moved = ", ".join(f"({x})::DOUBLE" for x in _sums().values())
    q = posterior("p", [f"t_{name}" for name in RULES], [f"s_{name}" for name in RULES])
    return f"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
    word_ AS (SELECT rid, list_filter(regexp_split_to_array(x, '[{SPACE}]+'), lambda w: w <> '') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^{SPACE}]')) AS l FROM t),
    win AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM word_)),
    again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    cover AS (SELECT rid, sum(least({WINDOW}, coalesce(later - i, {WINDOW})))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS later FROM again) GROUP BY rid),
    measured AS (SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, coalesce(n, 0) AS n_repeat_words, len(l)::BIGINT AS n_lines,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(list_filter(l, lambda s: regexp_matches(s, '{ENDED.replace("'", "''")}')))::BIGINT AS n_ended, len(regexp_extract_all(x, '{SYMBOL}'))::BIGINT AS n_symbols,
      length(regexp_replace(x, '[^\\p{{L}}]+', '', 'g'))::BIGINT AS n_letters, len(regexp_extract_all(x, '{FURNITURE}'))::BIGINT AS n_furniture,
      len(regexp_extract_all(x, '{SYMBOL}[{SPACE}]'))::BIGINT AS n_marked, len(regexp_extract_all(x, '(?i)[{SPACE}]({COMMON})[{SPACE}]'))::BIGINT AS n_common FROM t JOIN word_ USING (rid) LEFT JOIN cover USING (rid)),
    voted AS (SELECT *, {vote} FROM measured),
    patterns AS (SELECT {', '.join(columns)}, count(*) AS c FROM voted GROUP BY ALL),
    em(k, {', '.join(estimates)}) AS (SELECT 0, {', '.join(f'{x}::DOUBLE' for x in estimates.values())} UNION ALL
      SELECT k + 1, {moved} FROM (SELECT *, {q} AS q FROM em, patterns WHERE k < {steps}) GROUP BY k),
    judged AS (SELECT voted.*, round({q}, 9) AS quality FROM voted, em WHERE k = {steps})
    SELECT {SHOWN}, {BASE} AS base_failed, NOT {BASE} AND quality >= 0.5 AS kept, {MARKS} AS votes, round(quality, 6) AS quality FROM judged"""
