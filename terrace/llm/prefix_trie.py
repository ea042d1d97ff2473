"""Prefix trie of conversations: which first turns conversations share, and how many bytes of text sharing saves.

A conversation becomes its path: a token of fixed width a turn, made of the turn's digest and its text's bytes. Equal
paths are counted together first. Paths are then dealt by the hash of their first turn's digest, so a bucket holds whole
subtries of first turns, and tries of dictionaries are built in it and summed in an iterative postorder.

A first turn's subtrie of more than ``limit`` turns is too large for one task. Its paths are dealt again by the turn
behind their longest common stem, and so on for the parts; the stem is a chain of single children, whose sums come from
the parts below it. Splitting behind the stem takes at least one branching a round, however long the shared part is.

A node is known by its smallest member's id and its depth; ``turn`` is the digest of its last turn, by which
``turn_texts`` gives role and text.

Null roles and texts count as empty. Turns go by number, null first; turns of equal number by role, then by digest. Rows
with a null conv_id belong to no conversation and are left out. Repeated rows are turns of their own. Other columns are
ignored; an empty table gives an empty result. One conversation's tokens (40 bytes a turn) are held in a task.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import table, written

DIGEST, WIDTH = 32, 40
#: Turns of a bucket of subtries, and of a subtrie that is not split.
LIMIT = 100_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _said(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _digest() -> Column:
    role, text = _said("role"), _said("text")
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, DIGEST)


def turn_texts(conversations: DataFrame) -> DataFrame:
    """(turn, role, text): what each digest of a turn stands for."""
    return conversations.select(_digest().alias("turn"), _said("role").alias("role"), _said("text").alias("text")).dropDuplicates(["turn"])


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of each conversation. Texts are read once and only their digests are shuffled."""
    token = F.concat(_digest(), F.lpad(F.lower(F.hex(F.octet_length(_said("text")))), WIDTH - DIGEST, "0"))
    turns = conversations.where("conv_id is not null").select(
        "conv_id", F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"), _said("role").alias("role"), token.alias("token")).alias("t")
    )
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["token"]), "").alias("path"))


def rebuilt(paths: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, path): conversation c gets the first h turns of c - c % family, then its own behind its first h; h = crc32 of the decimal id % most."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int") * WIDTH
    heads = paths.where(c % family == 0).select(c.alias("base"), F.substring("path", 1, (most - 1) * WIDTH).alias("head"))
    both = paths.join(heads, c - c % family == F.col("base"), "left")
    head = F.substring(F.coalesce("head", F.lit("")), F.lit(1), h)
    return both.select("conv_id", F.concat(head, F.substring(F.col("path"), h + 1, F.length("path"))).alias("path"))


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) to (key, ends): the digest of a key's ids, read on from batch to batch, so a key of any size takes no memory."""
    key, state = None, None
    for b in batches:
        done: list[tuple[str, str]] = []
        keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
        at = 0
        while at < len(keys):
            stop = at + 1
            while stop < len(keys) and keys[stop] == keys[at]:
                stop += 1
            if keys[at] == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = keys[at], hashlib.sha256()
            state.update(",".join(map(str, ids[at:stop])).encode())
            at = stop
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in done], pa.string()), "ends": pa.array([e for _, e in done], pa.string())})
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "ends": [state.hexdigest()]})


def distinct_paths(members: DataFrame) -> DataFrame:
    """(path, first, n, ends): each path once, with its members' smallest id, number, and the digest of their ids."""
    key = F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, DIGEST)
    # A digest of ids in order takes one task a path by its nature; it streams.
    ends = members.select(key.alias("key"), "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hash_ids, "key string, ends string")
    own = members.groupBy("path").agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return own.withColumn("key", key).join(ends, "key").select("path", "first", "n", "ends")


def _tokens(path: str, skip: int = 0) -> list[str]:
    return [path[i : i + WIDTH] for i in range(skip * WIDTH, len(path), WIDTH)]


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the subtries of one bucket, those at their top marked."""
    children: list[dict[str, int]] = []
    token, above, depth, count, first, ends = [], [], [], [], [], []
    tops: dict[str, int] = {}
    row_of: dict[int, tuple] = {}

    def add(t: str, parent: int, d: int) -> int:
        children.append({})
        for column, value in zip((token, above, depth, count, first, ends), (t, parent, d, 0, None, NO_ENDS), strict=True):
            column.append(value)
        return len(token) - 1

    for unit, level, parent, parent_first, path, least, n, end in zip(*(pdf[c] for c in ("unit", "level", "parent", "parent_first", "path", "first", "n", "ends")), strict=True):
        own = _tokens(path, level - 1)
        node = tops.get(unit)
        if node is None:
            node = tops[unit] = add(own[0], -1, level)
            row_of[node] = (unit, parent, parent_first)
        for k, t in enumerate(own):
            if k:
                below = children[node].get(t)
                if below is None:
                    below = children[node][t] = add(t, node, level + k)
                node = below
            count[node] += n
            if first[node] is None or least < first[node]:
                first[node] = least
        ends[node] = end

    order, stack = [], list(tops.values())
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(children[node].values())
    leaves, saved = [0] * len(token), [0] * len(token)
    for node in reversed(order):  # children before their parents
        leaves[node] = leaves[node] or 1
        saved[node] += (count[node] - 1) * int(token[node][DIGEST:], 16)
        if above[node] >= 0:
            leaves[above[node]] += leaves[node]
            saved[above[node]] += saved[node]
    nodes = range(len(token))
    return pd.DataFrame({
        "conv_id": first, "depth": depth, "parent_conv_id": pd.array([first[above[i]] if above[i] >= 0 else row_of[i][2] for i in nodes], "Int64"), "n_convs": count,
        "n_children": [len(children[i]) for i in nodes], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "turn": [t[:DIGEST] for t in token],
        "unit": [row_of[i][0] if i in row_of else None for i in nodes], "parent": [row_of[i][1] if i in row_of else None for i in nodes],
    })


MARKED = f"{NODE}, unit string, parent string"
TOP = "unit string, level int, parent string, parent_first long, stem string, first long, n_convs long"


def _stems(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        common = [os.path.commonprefix([a, b]) for a, b in zip(pdf["low"], pdf["high"], strict=True)]
        yield pdf.assign(stem=[c[: len(c) // WIDTH * WIDTH] for c in common])[[x.split()[0] for x in TOP.split(", ")]]


def _chains(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stem of each split subtrie: a chain of nodes of the same members above its parts."""
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            own, saved = _tokens(r.stem, r.level - 1), int(r.saved)
            for k in reversed(range(len(own))):
                last = k == len(own) - 1
                saved += (r.n_convs - 1) * int(own[k][DIGEST:], 16)
                rows.append((
                    r.first, r.level + k, r.first if k else r.parent_first, r.n_convs, r.parts if last else 1, r.leaves, saved, (r.ends or NO_ENDS) if last else NO_ENDS, own[k][:DIGEST],
                    None if k else r.unit, None if k else r.parent,
                ))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in MARKED.split(", ")])
        yield out.astype({"parent_conv_id": "Int64"})


def _split(units: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """(subtries that fit, stems of the others, where a path ends at a stem, the others' parts), or none where all fit.

    The path of a single conversation always fits: it can't be split."""
    turns = F.length("path") / WIDTH - F.col("level") + 1
    sizes = units.groupBy("unit").agg(F.count(F.lit(1)).alias("paths"), F.sum(turns).alias("turns"))
    large = written(sizes.where((F.col("paths") > 1) & (F.col("turns") > limit)).select("unit"), "large-subtries")
    if not large.limit(1).count():
        return None
    inside = written(units.join(large, "unit"), "large-paths")
    ends_of = inside.groupBy("unit", "level", "parent", "parent_first").agg(
        F.min("path").alias("low"), F.max("path").alias("high"), F.min("first").alias("first"), F.sum("n").alias("n_convs")
    )
    stems = written(ends_of.mapInPandas(_stems, TOP), "stems")
    joined = inside.drop("level", "parent", "parent_first").join(stems.select("unit", "stem", F.col("first").alias("parent_first")), "unit")
    level = (F.length("stem") / WIDTH + 1).cast("int")
    part = F.substring(F.sha2(F.substring(F.col("path"), F.lit(1), level * WIDTH).cast("binary"), 256), 1, DIGEST)
    parts = joined.where("path != stem").select(part.alias("unit"), level.alias("level"), F.col("unit").alias("parent"), "parent_first", "path", "first", "n", "ends")
    return units.join(large, "unit", "left_anti"), stems, joined.where("path = stem").select("unit", "ends"), written(parts, "parts")


def trie(members: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie's nodes, the textless root (depth 0) among them, of ``members`` (conv_id: distinct, path)."""
    paths = written(distinct_paths(members), "paths")
    whole = paths.agg(F.sum(F.length("path") / WIDTH).cast("long").alias("turns"), F.min("first").alias("first"), F.sum("n").alias("n")).first()
    if whole.n is None:
        return paths.select(*(F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in NODE.split(", ")))).where("false")
    spark = members.sparkSession
    units = paths.where("path != ''").select(
        F.substring("path", 1, WIDTH).alias("unit"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent"), F.lit(whole.first).cast("long").alias("parent_first"),
        "path", "first", "n", "ends",
    )
    fit, rounds = None, []
    while cut := _split(units, limit):
        small, stems, at_stem, units = cut
        fit = small if fit is None else fit.unionByName(small)
        rounds.append((stems, at_stem))
    units = units if fit is None else fit.unionByName(units)
    buckets = max(1, -(-whole.turns // limit), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = units.withColumn("bucket", F.pmod(F.xxhash64("unit"), F.lit(buckets)))
    nodes = [written(dealt.groupBy("bucket").applyInPandas(lambda pdf: build(pdf), MARKED), "nodes")]
    for stems, at_stem in reversed(rounds):
        tops = nodes[0] if len(nodes) == 1 else nodes[0].unionByName(nodes[-1])
        below = tops.where("parent is not null").groupBy(F.col("parent").alias("unit")).agg(
            F.count(F.lit(1)).alias("parts"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
        )
        nodes.append(written(stems.join(below, "unit").join(at_stem, "unit", "left").mapInPandas(_chains, MARKED), "chains"))
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    top = every.where("unit is not null and parent is null").agg(F.count(F.lit(1)).alias("k"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    none = paths.where("path = ''").agg(F.max("ends").alias("ends"))  # one row at most
    root = top.join(none).select(
        F.lit(whole.first).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(whole.n).cast("long").alias("n_convs"),
        F.col("k").alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), F.lit(None).cast("string").alias("turn"),
    )
    return every.select(*root.columns).unionByName(root)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with the first turns of its family's first."""
    members = written(rebuilt(conversation_paths(table(spark, sf_dir, "conversations"))), "members")
    return trie(members).drop("turn")
