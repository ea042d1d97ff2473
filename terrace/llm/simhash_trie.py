"""SimHash near-duplicates by a self-join of binary tries.

1. ``fingerprints``: 64-bit SimHash of word shingles, computed batch by batch.
2. ``trie_links``: documents with equal fingerprints are one class. The 64 bits are cut into ``budget + 1``
   blocks; two fingerprints that differ in at most ``budget`` bits agree in at least one block, so one trie
   for each block (with that block's bits moved to the front), cut into subtrees by those bits, sees every link. In a
   subtree, pairs of nodes are walked together from the root, adding up differing bits; a pair of nodes is dropped as
   soon as the sum exceeds the budget. Each subtree returns a spanning forest of its links (a row at most for
   each of its keys), never all pairs: no link between classes is lost for reachability.
3. ``classes``: connected components over all forests; a class id is the smallest document id.

With n distinct fingerprints a trie holds about n / 2**(64 // (budget + 1)) of them; ``extra_blocks`` cuts the
bits finer and asks for agreement in more blocks, for smaller tries at larger n (``finer`` picks it). Fingerprints of
documents from one template crowd into few subtrees: one of more than ``unit`` fingerprints is cut again, by those bits
that differ inside it, until none is (``subtrees``), so no task holds a hot subtree whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.components import components
from terrace.llm.shared import partitions, table, written

SEED = 42
#: Hashes that are turned into bits at once.
SLICE = 1 << 18


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of all word shingles of a text, repeats included; one of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(b" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        bits = np.unpackbits(hashes[i : i + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        # Sums of up to 255 rows fit in bytes, which are added faster than wider numbers.
        whole = len(bits) // 255 * 255
        if whole:
            ones += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): a row for each input row; null text counts as empty, whose fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py() or "", width)) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _walk(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int, budget: int, second: tuple[np.ndarray, np.ndarray] | None = None, within: int = 0) -> np.ndarray:
    """For sorted distinct 64-bit keys, each key's root (an index) in a spanning forest of the links in some subtrees.
    ``second``: other fingerprints, and where those of each key start; some of two keys' must differ in ``within`` bits or fewer too.

    A node is a range of keys that share the bits above ``bit``; the subtrees [lo, hi) are walked together, each
    with itself. Node pairs are taken from a stack in slices, so memory is bounded by the slice and the depth,
    however many pairs there are."""
    parent = np.arange(len(keys))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    limit = 1 << 16
    # (bit, a_lo, a_hi, b_lo, b_hi, differing bits): all pairs of one entry stand at the same depth.
    stack = [(bit, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        bit, al, ah, bl, bh, d = stack.pop()
        if len(al) > limit:
            half = len(al) // 2
            stack.append((bit, *(x[half:] for x in (al, ah, bl, bh, d))))
            stack.append((bit, *(x[:half] for x in (al, ah, bl, bh, d))))
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            linked = np.flatnonzero((np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (i != j))
            if second is not None:
                linked = linked[_agree(*second, i[linked], j[linked], within)]
            if len(linked) > 4096:  # what is connected by now needs no further link
                roots = _flat(parent)
                linked = linked[roots[i[linked]] != roots[j[linked]]]
            for x, y in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            al, ah, bl, bh, d = (x[~single] for x in (al, ah, bl, bh, d))
        if not len(al):
            continue
        am, bm = _split(keys, al, ah, bit), _split(keys, bl, bh, bit)
        same = (al == bl) & (ah == bh)
        parts = []
        for a0, a1, b0, b1, more, keep in (
            (al, am, bl, bm, 0, True),
            (am, ah, bm, bh, 0, True),
            (al, am, bm, bh, 1, True),
            (am, ah, bl, bm, 1, ~same),  # a node with itself: its children meet once
        ):
            # Pairs over the budget go, and so does a leaf with itself.
            ok = (a1 > a0) & (b1 > b0) & (d + more <= budget) & keep & ~((a1 - a0 == 1) & (a0 == b0) & (a1 == b1))
            parts.append(tuple(x[ok] for x in (a0, a1, b0, b1, d + more)))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    return _flat(parent)


#: Pairs of second fingerprints that are compared for two keys; keys with more are linked without.
COMPARED = 1 << 22


def _agree(second: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, within: int) -> np.ndarray:
    """Whether keys i and j have second fingerprints that differ in ``within`` bits or fewer."""
    ok = np.bitwise_count(second[at[i]] ^ second[at[j]]) <= within
    for k in np.flatnonzero(~ok & ((at[i + 1] - at[i] > 1) | (at[j + 1] - at[j] > 1))).tolist():
        a, b = (second[at[x[k]] : at[x[k] + 1]] for x in (i, j))
        ok[k] = len(a) * len(b) > COMPARED or (np.bitwise_count(a[:, None] ^ b) <= within).any()
    return ok


def _flat(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """The first key of each range whose ``bit`` is set; all of a range share the bits above."""
    mask = np.uint64(1 << bit)
    at = keys[lo]
    border = (at >> np.uint64(bit) | np.uint64(1)) << np.uint64(bit)
    return np.where(at & mask != 0, lo, np.clip(np.searchsorted(keys, border), lo, hi))


def _cuts(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of ``blocks`` nearly equal blocks of 64 bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def finer(n: int, budget: int, size: int = 128) -> int:
    """``extra_blocks`` for which n random fingerprints make subtrees of about ``size`` keys or fewer."""
    bits = lambda e: sum(sorted(w for _, w in _cuts(budget + 1 + e))[: 1 + e])
    return next((e for e in range(5) if n <= size << bits(e)), 5)


#: Distinct fingerprints of a subtree that is walked in one piece.
UNIT = 1 << 13


def _large(rows: DataFrame, unit: int) -> DataFrame:
    """(mask, name, varying) of subtrees of more than ``unit`` fingerprints: the bits that are not the same in all of them."""
    key = ["mask", "name"]
    size = F.count(F.lit(1)).alias("n")
    # More than ``unit`` fingerprints differ in more than log2(unit) bits.
    bits = max(unit, 2).bit_length() - 1
    large = rows.groupBy(*key).agg(size, F.expr("bit_or(fp) ^ bit_and(fp)").alias("varying")).where((F.col("n") > unit) & (F.bit_count("varying") > bits))
    large = written(large.drop("n"), "large-subtrees")
    if "second" not in rows.columns or large.isEmpty():
        return large
    # A fingerprint with several rows counts once.
    several = rows.join(large, key, "left_semi").select(*key, "fp").distinct().groupBy(*key).agg(size).where(F.col("n") > unit)
    return written(large.join(several, key, "left_semi"), "large-subtrees")


def subtrees(fps: DataFrame, budget: int, extra_blocks: int = 0, unit: int = UNIT) -> DataFrame:
    """``fps`` (fp among its columns) with a row for each subtree that a fingerprint belongs to, named by ``mask`` (the bits that
    agree in the whole subtree) and ``name`` (a hash of their values and of the larger subtrees around it).

    Two fingerprints that differ in ``budget`` bits or fewer are in one subtree at least. A subtree of more than ``unit``
    fingerprints is cut by the same rule as the whole: of ``budget + 1`` blocks of the bits that vary in it, one agrees.
    Each cut leaves fewer such bits, and few bits hold few fingerprints, so this ends whatever the fingerprints are."""
    blocks, agree = budget + 1 + extra_blocks, 1 + extra_blocks
    if unit < 1 << budget + 1:
        raise ValueError("a unit is larger than what budget + 1 bits tell apart")
    cuts = _cuts(blocks)
    tops = []
    for chosen in combinations(range(blocks), agree):
        mask = sum(((1 << cuts[i][1]) - 1) << cuts[i][0] for i in chosen)
        long = F.lit(mask - (mask >> 63 << 64)).cast("long")
        tops.append(F.struct(long.alias("mask"), F.xxhash64(long, F.col("fp").bitwiseAND(long)).alias("name")))
    open_, settled = fps.select("*", F.inline(F.array(*tops))), []
    key, n = ["mask", "name"], budget + 1
    places = "filter(sequence(0, 63), b -> getbit(varying, b) = 1)"
    parts = f"transform(sequence(0, {n - 1}), k -> aggregate(filter({places}, (b, i) -> i % {n} = k), 0L, (m, b) -> m | shiftleft(1L, b)))"
    while not (large := _large(open_, unit)).isEmpty():
        settled.append(open_.join(large, key, "left_anti"))
        # The large ones' rows are the side that adaptive skew joins may split.
        cut = open_.join(large.withColumn("parts", F.expr(parts)), key).withColumn("part", F.explode("parts"))
        name = F.expr("xxhash64(mask, name, part, fp & part)").alias("name")
        open_ = written(cut.select(*fps.columns, F.expr("~varying | part").alias("mask"), name), "subtrees")
    for rows in settled:
        open_ = open_.unionByName(rows)
    return open_


def trie_links(fps: DataFrame, budget: int = 3, extra_blocks: int = 0, within: int | None = None, unit: int = UNIT) -> DataFrame:
    """(a, b): links between nodes that connect all of ``fps`` (node long, fp long; fp unique) within the budget.
    With ``within``, a column ``second`` (long) must differ in so many bits or fewer too; a node then has a row for
    each of its second fingerprints, any of which may agree."""
    if budget < 1:
        raise ValueError("a budget is one bit or more; equal fingerprints are one node")
    more = [] if within is None else ["second"]
    rows = subtrees(fps.select("node", "fp", *more), budget, extra_blocks, unit)

    def join_tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The tries of one partition, sorted by (mask, name); a trie may continue in the next batch."""
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            last = pdf["name"].to_numpy()[-1], pdf["mask"].to_numpy()[-1]
            open_ = ((pdf["name"] == last[0]) & (pdf["mask"] == last[1])).to_numpy()
            if held and not open_.all() or held and (held[-1]["name"].iloc[-1], held[-1]["mask"].iloc[-1]) != last:
                yield from done(pd.concat([*held, pdf[~open_]]))
                held = [pdf[open_]]
            elif held:
                held.append(pdf)
            else:
                if not open_.all():
                    yield from done(pdf[~open_])
                held = [pdf[open_]]
        if held:
            yield from done(pd.concat(held))

    def done(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        masks, names = pdf["mask"].to_numpy().view(np.uint64), pdf["name"].to_numpy()
        depth = 64 - np.bitwise_count(masks).astype(np.int64)
        fp = pdf["fp"].to_numpy().view(np.uint64)
        trie = np.cumsum(np.r_[False, (masks[1:] != masks[:-1]) | (names[1:] != names[:-1])]).astype(np.uint64)
        # A trie of one row links nothing.
        rows_ = np.flatnonzero(np.bincount(trie.astype(np.int64))[trie.astype(np.int64)] > 1)
        for rest in sorted(set(depth[rows_].tolist())):
            own = rows_[depth[rows_] == rest]
            # The bits that don't agree by the trie's name, below a number of the trie: tries of one depth are walked together.
            low = np.empty(len(own), np.uint64)
            for mask in set(masks[own].tolist()):
                at = masks[own] == mask
                low[at] = _compress(fp[own[at]], 0, ~mask & (1 << 64) - 1)
            number = np.unique(trie[own], return_inverse=True)[1]
            for most in range(0, int(number[-1]) + 1, 1 << (64 - rest)):
                part = (number >= most) & (number < most + (1 << (64 - rest)))
                yield linked(pdf, own[part], (number[part] - most).astype(np.uint64) << np.uint64(rest) | low[part], rest)

    def linked(pdf: pd.DataFrame, own: np.ndarray, key: np.ndarray, rest: int) -> pd.DataFrame:
        order = np.argsort(key, kind="stable")
        key, ids, second = key[order], pdf["node"].to_numpy()[own][order], None
        if within is not None:
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            second = pdf["second"].to_numpy().view(np.uint64)[own][order], np.r_[first, len(key)]
            key, ids = key[first], ids[first]
        top = key >> np.uint64(rest)
        starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
        ends = np.r_[starts[1:], len(key)]
        many = ends - starts > 1
        roots = _walk(key, starts[many], ends[many], rest - 1, budget, second, within or 0)
        member = roots != np.arange(len(roots))
        return pd.DataFrame({"a": ids[roots[member]], "b": ids[member]})

    n = max(partitions(fps.sparkSession), 2 * fps.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(n, "mask", "name").sortWithinPartitions("mask", "name").mapInPandas(join_tries, "a long, b long")


def _compress(fp: np.ndarray, first: int, last: int) -> np.ndarray:
    """The bits under ``first``, in their order, before those under ``last``."""
    out = np.zeros(len(fp), np.uint64)
    for mask in (first, last):
        bit = 64
        while bit:  # a run of mask bits at a time
            bit -= 1
            if not mask >> bit & 1:
                continue
            low = bit
            while low and mask >> (low - 1) & 1:
                low -= 1
            width = bit - low + 1
            out = (out << np.uint64(width) if width < 64 else out) | ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1))
            bit = low
    return out


#: Parts that the nodes of one class are spread over when they learn its id.
SALTS = 16


def classes(docs: DataFrame, width: int = 3, budget: int = 3, extra_blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id): for each row, the smallest doc_id reachable by links of ``budget`` bits or fewer.

    Null text is empty; empty texts have fingerprint zero and link like any other. Rows with a null doc_id link like
    others but name no component: they get the smallest id of their class, null if it has none. Repeated rows get
    repeated results, an empty table an empty one. Texts may be of any length; other columns are ignored.
    ``extra_blocks`` is chosen by the number of distinct fingerprints unless given."""
    own = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.col("fp")), "nodes")
    extra_blocks = finer(nodes.count(), budget) if extra_blocks is None else extra_blocks
    label = components(trie_links(nodes.select("node", "fp"), budget, extra_blocks))
    placed = written(nodes.join(label, "node", "left").select("fp", "first", "component"), "placed")
    several = placed.where("component is not null")
    # A class may hold very many nodes: it is met in parts.
    ids = several.groupBy("component").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    several = several.withColumn("salt", F.pmod(F.hash("fp"), F.lit(SALTS))).join(ids, ["component", "salt"]).select("fp", "component_id")
    known = written(placed.where("component is null").select("fp", F.col("first").alias("component_id")).unionByName(several), "components")
    # Both sides are plain exchanges: a fingerprint with very many rows is split by adaptive skew joins.
    return own.join(known, "fp", "left").select("doc_id", "fp", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
