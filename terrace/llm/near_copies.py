"""Near copies of whole texts: candidates by the SimHash trie join, links by exact Jaccard similarity.

Candidates come from two joins, and a pair found by either of them is one:

* the trie join over fingerprints of distinct words. Copies with scattered changes of words change few of their bits.
  A fingerprint of the shingles themselves must agree within ``WITHIN`` bits too.
* MinHash bands over the word shingles: ``BANDS`` keys, each of ``ROWS`` minima. Texts that share a key are linked. At a
  similarity of 0.8, wherever the changes lie, a pair shares none with a probability of (1 - 0.8**6)**32 = 0.00006.

A link is a candidate whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more; a group
is a connected component of links. Exact copies are one text throughout.

Candidates meet only inside the joins' components. A component is dealt to blocks of about ``block`` texts and ``HELD``
shingles, and each pair of its blocks is one unit of work with bounded memory: it checks a sketch of the shingles, and the sets themselves
only where that doesn't rule the pair out nor other links connect it already. It returns a spanning forest of its
links. Most components are a single block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.components import components
from terrace.llm.shared import partitions, written
from terrace.llm.simhash_trie import finer, fingerprint, shingle_hashes, trie_links

WIDTH, SIMILARITY, BUDGET, WITHIN, BLOCK = 5, 0.8, 8, 19, 1024
BANDS, ROWS = 32, 6
#: Shingles of one block, and parts that a component of several blocks is spread over when it learns their number.
HELD, SALTS = 2_000_000, 64
#: Digests that are broadcast at most (about 100 bytes each).
BROADCAST_ROWS = 200_000


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest, row) of all rows; columns with any names stay in the struct ``row``."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def _rehashed(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same words: the public splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd factors, one for each minimum.
FACTORS = _rehashed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def _bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band, of the band's number and its minima over all shingles."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(h), 2048):
        np.minimum(least, (h[i : i + 2048] * FACTORS[:, None]).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = _rehashed(keys ^ row) + row
    return keys


def _fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, fp, second, bands) of (doc_id, text, digest): SimHash of distinct words and of distinct shingles, and the shingles' bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, bands = [[], []], []
            for t in b.column(1):
                text = t.as_py() or ""
                words, shingles = np.unique(shingle_hashes(text, 1)), np.unique(shingle_hashes(text, width))
                for out, hashes in zip(fps, (words, shingles), strict=True):
                    out.append(fingerprint(hashes))
                bands.append(_bands(shingles).view(np.int64))
            fps = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in fps]
            bands = pa.array(bands, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *fps, bands], ["doc_id", "digest", "fp", "second", "bands"])

    names = "doc_id long, digest string, fp long, second long, bands array<long>"
    return docs.select("doc_id", "text", "digest").mapInArrow(run, names)


BINS = 128


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """The least hash in each of 128 ranges of hashes; the largest number where there is none."""
    h = shingles.view(np.uint64)
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, (h >> np.uint64(57)).astype(np.int64), h)
    return out


def _block_links(similarity: float):
    """A spanning forest of the links between two blocks of a component, or inside one."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, left, right = key
        pdf = pdf.sort_values("id", kind="stable")
        sets = [np.asarray(x, np.int64) for x in pdf["shingles"]]
        ids, size = pdf["id"].to_numpy(), np.array([len(x) for x in sets])
        sketch = np.stack([_sketch(x) for x in sets])
        used = sketch != np.iinfo(np.uint64).max
        block = pdf["block"].to_numpy()
        root, a, b = np.arange(len(ids)), [], []
        for i in range(len(ids)):
            j = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i])))
            if left != right:
                j = j[block[j] != block[i]]
            if not len(j):
                continue
            # The sketch's share of equal ranges estimates the similarity; five deviations below it, a pair is none.
            either = used[i] | used[j]
            n = np.maximum(1, either.sum(axis=1))
            share = ((sketch[j] == sketch[i]) & either).sum(axis=1) / n
            likely = j[(share >= similarity - 5 * np.sqrt(similarity * (1 - similarity) / n)) | ~either.any(axis=1)]
            for k in likely.tolist():
                if root[k] == root[i]:
                    continue
                common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if common >= similarity * (size[i] + size[k] - common):
                    a.append(ids[i]), b.append(ids[k])
                    root[root == max(root[i], root[k])] = min(root[i], root[k])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def drop_near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id and text among its columns) with one row of each group: that with the smallest doc_id.

    Null text is empty; all empty texts are one group. A null id comes after all others; of repeated rows one stays.
    An empty table gives an empty result. All columns are kept as they are."""
    marked = _marked(docs)
    own = written(_fingerprints(marked, width), "fingerprints")
    texts = own.groupBy("digest").agg(F.min("doc_id").alias("first"), *(F.min(c).alias(c) for c in ("fp", "second")), F.count(F.lit(1)).alias("n"))
    texts = written(texts, "texts")
    label = written(components(_candidate_links(texts, budget).unionByName(_band_links(own))), "candidate-components")
    # Texts with the same fingerprint are candidates without any link.
    several = texts.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("fp").alias("node"))
    label = label.unionByName(several.join(label, "node", "left_anti").select("node", F.col("node").alias("component")))
    candidates = written(texts.join(label, F.col("fp") == F.col("node")).select("digest", "first", "component"), "candidates")
    labels = _labels(marked, candidates, width, similarity, block)

    order = F.struct(F.col("first").isNull(), "first", "digest")
    kept = labels.join(candidates, "digest").groupBy("label").agg(F.min(order)["digest"].alias("digest"))
    gone = labels.select("digest").join(kept, "digest", "left_anti").select("digest", F.lit(True).alias("gone"))
    # What isn't simply kept: texts of dropped copies, and texts with several rows.
    held = own.where("doc_id is not null").groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("same"))
    ruled = texts.join(gone, "digest", "left").where("gone or n > 1").select("digest", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    same = held.where("same > 1").select(F.col("digest").alias("d2"), F.col("doc_id").alias("i2"), F.lit(True).alias("same"))
    ruled = ruled.join(same, (ruled["digest"] == same["d2"]) & (ruled["first"] == same["i2"]), "left")
    # Null ids can't be told from one another: several are repeated rows.
    ruled = ruled.select("digest", "first", "gone", (F.coalesce("same", F.lit(False)) | F.col("first").isNull()).alias("same"))
    ruled = written(ruled, "ruled")
    joined = marked.join(_few(ruled, ruled.count()), "digest", "left").where(F.col("gone").isNull() | (~F.col("gone") & F.col("doc_id").eqNullSafe(F.col("first"))))
    if ruled.where("same and not gone").isEmpty():
        return joined.select("row.*")
    repeated = F.coalesce("same", F.lit(False))
    return joined.where(~repeated).select("row.*").unionByName(joined.where(repeated).dropDuplicates(["digest"]).select("row.*"))


def _candidate_links(texts: DataFrame, budget: int) -> DataFrame:
    """(a, b) between texts' nodes: texts with the same ``fp`` are one node, named by it, with all their ``second``."""
    nodes = written(texts.select("fp", "second").distinct().withColumn("node", F.col("fp")), "nodes")
    return trie_links(nodes, budget, finer(nodes.count(), budget), WITHIN)


def _band_links(own: DataFrame) -> DataFrame:
    """(a, b) between nodes with a common band: all nodes of a band to the smallest."""
    keys = written(own.select("fp", F.explode("bands").alias("key")).distinct(), "bands")
    least = keys.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a <> most").drop("most")
    return keys.join(written(least, "least-of-bands"), "key").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def _labels(marked: DataFrame, candidates: DataFrame, width: int, similarity: float, block: int) -> DataFrame:
    """(digest, label) of all candidates; texts of one group have the same label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width)).view(np.int64) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(sets, pa.list_(pa.int64()))], ["digest", "component", "shingles"])

    wanted = candidates.withColumnRenamed("digest", "wanted")
    picked = marked.join(_few(wanted, candidates.count()), F.col("digest") == F.col("wanted")).where(F.col("doc_id").eqNullSafe(F.col("first")))
    rows = picked.select(F.coalesce("text", F.lit("")).alias("text"), "digest", "component")
    rows = written(rows.mapInArrow(run, "digest string, component long, shingles array<long>"), "shingles")
    # The number is made once, and written.
    rows = written(rows.dropDuplicates(["digest"]).withColumn("id", F.monotonically_increasing_id()), "shingle-sets")
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("held"))
    sizes = sizes.select("component", F.expr(f"cast(ceil(greatest(n / {block}, held / {HELD})) as int)").alias("blocks"))
    large = written(sizes.where("blocks > 1"), "large-components")
    # A large component is met in many parts.
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(_few(large, large.count()), ["component", "salt"], "left")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # A row for each pair of blocks, each with itself included.
    facing = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("facing", facing).select(
        "component", F.least("block", "facing").alias("left"), F.greatest("block", "facing").alias("right"), "block", "id", "shingles"
    )
    n = max(partitions(marked.sparkSession), 2 * marked.sparkSession.sparkContext.defaultParallelism)
    links = dealt.repartition(n, "component", "left", "right").groupBy("component", "left", "right").applyInPandas(_block_links(similarity), "a long, b long")
    label = components(written(links, "copy-links")).withColumnRenamed("component", "component_")
    return written(rows.join(label, rows["id"] == label["node"], "left").select("digest", F.coalesce("component_", "id").alias("label")), "labels")
