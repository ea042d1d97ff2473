"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The public vocabulary is a BPE model with byte fallback, so an encoding is right if it equals the library's merges. A
sequence of pieces is that encoding exactly if each adjacent pair is the encoding of its own text; this turns merging
into a search for the best path through a lattice of pieces, whose edges weigh 0 if two pieces may follow each other
and minus infinity if not. Best paths compose: a chunk of text is a max-plus matrix from the pieces that may lie
across its left border to those across its right border.

1. Texts up to ``chunk`` characters are one chunk, from the start to the end.
2. Longer texts are cut anywhere into chunks, each with its neighbours' nearest characters. Each chunk yields its
   matrix; words that lie inside a chunk have a single state on both sides and need no matrix.
3. The product is associative, so matrices are combined in ranges of ``GROUP`` neighbours, the products of those in
   ranges again, until each document has one (the scan's way up). On the way down, the two ends of a range fix the pieces
   across the borders inside it. Ranges of one document are worked on apart, at each level. Each chunk then traces its own
   path between its two borders, independently of the others.

Pieces never reach from a word into the next space, so only words across borders are searched piece by piece; whole
words go to the library.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import partitions, table, written
from terrace.llm.word_ids import slices

CHUNK = 16384
#: Matrices that are multiplied in one place.
GROUP = 64
SPACE = "▁"
#: A piece across a border: (start and end relative to the border, piece).
State = tuple[int, int, int]
#: The state before a text and after it.
EDGE: State = (0, 0, -1)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.names = [self.library.id_to_piece(i) for i in range(n)]
        special = lambda i: self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)
        self.byte = {int(self.names[i][3:5], 16): i for i in range(n) if self.library.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.names) if not special(i) and not self.library.is_byte(i)}
        self.score = [self.library.get_score(i) for i in range(n)]
        self.longest = max(map(len, self.ids))
        self.bytes = [b"" if self.library.is_control(i) else bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.names)]
        self._pairs: dict[tuple[int, int], bool] = {}

    def name(self, piece: int) -> str:
        """A character without a piece is ``-2 - code point``."""
        return self.names[piece] if piece >= 0 else chr(-2 - piece)

    def merged(self, text: str) -> list[int]:
        """BPE by definition: the best-scored adjacent pair merges first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids.get(p, -2 - ord(p[0])) for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may come right after ``a``."""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            found = self._pairs[a, b] = self.merged(self.name(a) + self.name(b)) == [a, b]
        return found

    def starting(self, s: str, at: int) -> list[tuple[int, int]]:
        """(end, piece) of all pieces of ``s`` that start at ``at``; a character without a piece stands for itself."""
        found = [(e, i) for e in range(at + 1, min(len(s), at + self.longest) + 1) if (i := self.ids.get(s[at:e])) is not None]
        return found if s[at] in self.ids else [(at + 1, -2 - ord(s[at])), *found]

    def states(self, s: str, border: int) -> list[State]:
        """All pieces that hold the character before ``border``, in one order on both sides of it."""
        lo = max(0, border - self.longest)
        return sorted((a - border, e - border, i) for a in range(lo, border) for e, i in self.starting(s, a) if e >= border)

    def plain(self, pieces: list[int]) -> list[int]:
        """Ids, with bytes for characters without a piece."""
        out = []
        for p in pieces:
            if p >= 0:
                out.append(p)
            else:
                out.extend(self.byte[b] for b in chr(-2 - p).encode("utf-8", "replace"))
        return out

    def whole(self, s: str) -> list[int]:
        """Ids of an escaped text that starts with a space; the library adds that one itself."""
        return self.library.encode(s[1:].replace(SPACE, " "), num_threads=1)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _word_starts(s: str, lo: int, hi: int) -> list[int]:
    """The first and the last position in [lo, hi) at which no piece can lie across: a space after another character."""
    first = next((i for i in range(max(lo, 1), hi) if s[i] == SPACE and s[i - 1] != SPACE), None)
    if first is None:
        return []
    return [first, next(i for i in range(hi - 1, first - 1, -1) if s[i] == SPACE and s[i - 1] != SPACE)]


def search(p: Pieces, s: str, at: int, before: int | None, end: int) -> dict[State, tuple[float, tuple | None]]:
    """Best paths from ``at`` (after the piece ``before``, None for a word start) to each piece that holds the
    character before ``end``: {state: (weight, chain of (piece, rest of the chain))}."""
    best: dict[int, dict[int | None, tuple[float, tuple | None]]] = {at: {before: (0.0, None)}}
    out: dict[State, tuple[float, tuple | None]] = {}
    for pos in range(at, end):
        here = best.pop(pos, None)
        if not here:
            continue
        border = pos > 0 and s[pos] == SPACE and s[pos - 1] != SPACE
        for stop, piece in p.starting(s, pos):
            for last, (weight, chain) in here.items():
                if not (border or last is None or p.follows(last, piece)):
                    continue
                if last is None and p.merged(p.name(piece)) != [piece]:
                    continue
                new = (weight, (piece, chain))
                if stop >= end:
                    key = (pos - end, stop - end, piece)
                    if key not in out or out[key][0] < weight:
                        out[key] = new
                else:
                    slot = best.setdefault(stop, {})
                    if piece not in slot or slot[piece][0] < weight:
                        slot[piece] = new
    return out


def _unchained(chain: tuple | None) -> list[int]:
    out = []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


class Chunk:
    """The stretch [lo, hi) of ``s``; ``first`` and ``last`` tell whether the text begins and ends with it.

    A chunk owns the pieces that start in it. ``s`` holds the neighbours' characters that pieces across the borders need."""

    def __init__(self, p: Pieces, s: str, lo: int, hi: int, first: bool, last: bool):
        self.p, self.s, self.lo, self.hi, self.first, self.last = p, s, lo, hi, first, last
        self.sources = [EDGE] if first else p.states(s, lo)
        self.targets = [EDGE] if last else p.states(s, hi)
        words = _word_starts(s, lo + first, hi)
        # Between these, the path is the library's.
        self.head, self.tail = words if words else (None, None)

    def _ends(self, found: dict) -> dict[State, tuple[float, tuple | None]]:
        """At the text's end only pieces that end there count, as one state."""
        if not self.last:
            return found
        best = max((v for k, v in found.items() if k[1] == 0), key=lambda v: v[0], default=None)
        return {EDGE: best} if best else {}

    def _from(self, source: State, end: int, whole: bool) -> dict:
        at, before = (self.lo, None) if source == EDGE else (self.lo + source[1], source[2])
        if at >= end:  # the piece across the left border ends where the words begin, or with the text
            found = {(source[0] + self.lo - end, at - end, before): (0.0, None)}
        else:
            found = search(self.p, self.s, at, before, end)
        return self._ends(found) if whole else found

    def matrix(self) -> np.ndarray:
        """Weights from each of ``sources`` to each of ``targets``; minus infinity where there is no path."""
        out = np.full((len(self.sources), len(self.targets)), -np.inf)
        if self.head is None:
            for i, source in enumerate(self.sources):
                found = self._from(source, self.hi, True)
                for j, target in enumerate(self.targets):
                    if target in found:
                        out[i, j] = found[target][0]
            return out
        left = [max((v[0] for k, v in self._from(x, self.head, False).items() if k[1] == 0), default=-np.inf) for x in self.sources]
        right = self._ends(search(self.p, self.s, self.tail, None, self.hi))
        return np.add.outer(np.array(left), np.array([right[x][0] if x in right else -np.inf for x in self.targets]))

    def trace(self, source: State, target: State) -> list[int]:
        """Ids of the pieces that start in this chunk, on the best path between two states."""
        if self.head is None:
            return self.p.plain(_unchained(self._from(source, self.hi, True)[target][1]))
        left = [v for k, v in self._from(source, self.head, False).items() if k[1] == 0]
        own = self.p.plain(_unchained(max(left, key=lambda v: v[0])[1]))
        if self.tail > self.head:
            own += self.p.whole(self.s[self.head : self.tail])
        return own + self.p.plain(_unchained(self._ends(search(self.p, self.s, self.tail, None, self.hi))[target][1]))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def borders(matrices: list[np.ndarray], source: int = 0, target: int = 0) -> list[int]:
    """For neighbouring matrices in order, the state (an index) at each of their borders, from ``source`` to ``target``."""
    forward = [np.where(np.arange(len(matrices[0])) == source, 0.0, -np.inf)]
    for m in matrices:
        forward.append((forward[-1][:, None] + m).max(axis=0))
    if not np.isfinite(forward[-1][target]):
        raise ValueError("no path of pieces")
    at = [target]
    for m, before in zip(reversed(matrices), reversed(forward[:-1]), strict=True):
        at.append(int((before + m[:, at[-1]]).argmax()))
    return at[::-1]


def _chunk_rows(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """(row, doc_id, k, n, lo, part): the chunks of long texts, each with its surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = pieces_of(path).longest + 1
        names = ["row", "doc_id", "k", "n", "lo", "part"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for b in batches:
            for row, doc_id, text in zip(*(b.column(i) for i in range(3)), strict=True):
                s = escaped(text.as_py())
                n = -(-len(s) // chunk)
                rows = []
                for k in range(n):
                    lo = max(0, k * chunk - near)
                    rows.append((row.as_py(), doc_id.as_py(), k, n, k * chunk - lo, s[lo : (k + 1) * chunk + near]))
                for i in range(0, n, 256):
                    part = zip(*rows[i : i + 256], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], names)

    return docs.mapInArrow(run, "row long, doc_id long, k long, n long, lo long, part string")


def _opened(p: Pieces, k: int, n: int, lo: int, part: str, chunk: int) -> Chunk:
    hi = min(lo + chunk, len(part)) if k < n - 1 else len(part)
    return Chunk(p, part, lo, hi, k == 0, k == n - 1)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (row, range) of sorted batches; a range may continue in the next batch."""
    held: list[dict] = []
    for b in batches:
        for x in b.to_pylist():
            if held and (held[-1]["row"], held[-1]["range"]) != (x["row"], x["range"]):
                yield held
                held = []
            held.append(x)
    if held:
        yield held


def _opened_matrix(x: dict) -> np.ndarray:
    return np.array(x["cells"]).reshape(-1, x["width"])


MATRIX = "row long, k long, width int, cells array<double>"
STATES = "row long, k long, source int, target int"


def _batches(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]], most: int = 4096) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for x in rows:
        part.append(x)
        if len(part) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), kinds, strict=True)], [n for n, _ in kinds])
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def scan_matrices(matrices: DataFrame, most: int, group: int = GROUP) -> DataFrame:
    """(row, k, source, target): the states at both borders of each matrix (row, k, width, cells; written) on the best
    path of its document; ``most`` is the largest number of matrices in one document."""
    spark = matrices.sparkSession
    n = max(partitions(spark), 2 * spark.sparkContext.defaultParallelism)
    dealt = lambda x: x.withColumn("range", F.expr(f"k div {group}")).repartition(n, "row", "range").sortWithinPartitions("row", "range", "k")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for own in _ranges(batches):
                m = _opened_matrix(own[0])
                for x in own[1:]:
                    m = product(m, _opened_matrix(x))
                yield own[0]["row"], own[0]["range"], m.shape[1], m.ravel().tolist()

        yield from _batches(rows(), [("row", pa.int64()), ("k", pa.int64()), ("width", pa.int32()), ("cells", pa.list_(pa.float64()))])

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for own in _ranges(batches):
                at = borders([_opened_matrix(x) for x in own], own[0]["source"], own[0]["target"])
                yield from ((x["row"], x["k"], a, b) for x, a, b in zip(own, at, at[1:], strict=False))

        yield from _batches(rows(), [("row", pa.int64()), ("k", pa.int64()), ("source", pa.int32()), ("target", pa.int32())])

    levels = [matrices]
    while most > group:
        levels.append(written(dealt(levels[-1]).mapInArrow(multiply, MATRIX), "range-matrices"))
        most = -(-most // group)
    fixed = None
    for level in reversed(levels):
        own = level.withColumn("range", F.expr(f"k div {group}"))
        if fixed is None:  # a document's text begins and ends in a single state
            own = own.withColumns({"source": F.lit(0), "target": F.lit(0)})
        else:
            own = own.join(fixed.withColumnRenamed("k", "range"), ["row", "range"])
        own = own.repartition(n, "row", "range").sortWithinPartitions("row", "range", "k")
        fixed = written(own.select("row", "range", "k", "width", "cells", "source", "target").mapInArrow(fix, STATES), "border-states")
    return fixed


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, packed: bool = False) -> DataFrame:
    """(doc_id, ids array<int>): a row for each input row, equal to the library's encoding of the whole text.

    ``packed``: ids as binary, little-endian unsigned 32-bit numbers, which is cheaper to pass on. Null and empty texts
    have no ids; null ids and repeated rows are kept; other columns are ignored; an empty table gives an empty result."""
    path = path or default_path()
    if chunk < 64:
        raise ValueError("a chunk must be longer than the longest pieces on both sides")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    binary = lambda ids: np.array(ids, "<u4").tobytes()

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = pieces_of(path).library
        for b in batches:
            for lo, hi in slices(b.column(1), 1 << 20):
                ids = library.encode(b.column(1).slice(lo, hi - lo).to_pylist(), num_threads=1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(map(binary, ids), pa.binary())], ["doc_id", "ids"])

    short = rows.where(F.length("text") < chunk).mapInArrow(direct, "doc_id long, ids binary")
    # The row number is made once and written with the chunks, so that it is the same in each later step.
    long_rows = rows.where(F.length("text") >= chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    chunks = written(_chunk_rows(long_rows, path, chunk), "text-chunks")
    most = chunks.agg(F.max("n")).first()[0]
    if most is None:
        return short if packed else _unpacked(short)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for x in zip(*b.columns, strict=True):
                    row, k, n, lo, part = (v.as_py() for v in x)
                    m = _opened(p, k, n, lo, part, chunk).matrix()
                    yield row, k, m.shape[1], m.ravel().tolist()

        yield from _batches(rows(), [("row", pa.int64()), ("k", pa.int64()), ("width", pa.int32()), ("cells", pa.list_(pa.float64()))])

    fixed = scan_matrices(written(chunks.select("row", "k", "n", "lo", "part").mapInArrow(weigh, MATRIX), "matrices"), most, group)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for x in zip(*b.columns, strict=True):
                    row, doc_id, k, n, lo, part, source, target = (v.as_py() for v in x)
                    c = _opened(p, k, n, lo, part, chunk)
                    yield row, doc_id, k, binary(c.trace(c.sources[source], c.targets[target]))

        yield from _batches(rows(), [("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("ids", pa.binary())], 64)

    both = chunks.join(fixed, ["row", "k"]).select("row", "doc_id", "k", "n", "lo", "part", "source", "target")
    traced = both.mapInArrow(trace, "row long, doc_id long, k long, ids binary")
    whole = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.expr("listagg(ids) WITHIN GROUP (ORDER BY k)").alias("ids"))
    found = short.unionByName(whole.select("doc_id", "ids"))
    return found if packed else _unpacked(found)


def _unpacked(encoded: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x.as_py(), "<u4").astype(np.int32) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return encoded.mapInArrow(run, "doc_id long, ids array<int>")


def _text(parts: list[bytes], ids: list[int]) -> str:
    text = b"".join([parts[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids array<int>): ids as text. Spaces come back from their marks, bytes are joined; a
    text that itself holds U+2581 comes back with a space there. Null ids are null text; other columns are ignored."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = pieces_of(path).bytes
        for b in batches:
            texts = [_text(parts, x.values.to_pylist()) if x.is_valid else None for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text_sha256) of packed ids: the CRC is over them, the hash over the decoded text in UTF-8.

    Decoding and hashing are one pass, so ids and texts go no further than the worker."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = pieces_of(path).bytes
        for b in batches:
            n, crc, sha = [], [], []
            for x in b.column(1):
                x = x.as_py()
                ids = np.frombuffer(x, "<u4").tolist()
                n.append(len(ids)), crc.append(zlib.crc32(x)), sha.append(hashlib.sha256(_text(parts, ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_ids", "ids_crc32", "text_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_sha256 string")


def op8_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), packed=True))
