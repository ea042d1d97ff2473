"""Document quality by co-training two views.

The text view is a histogram of hashed byte trigrams and the share of distinct words; the metadata view is the
row's language and source and the layout (length, lines, shares of character classes). Each view has a logistic
regression. Over ``rounds`` each one labels the documents it is surest of, of all that have no label, and these join the
training set of the *other* view. Both are then calibrated on labelled rows held out from training, and a logistic
combination of the calibrated views scores every document.

A round's surest are found over the whole corpus: both views score every document, counts by margin (in hundredths)
give the thresholds, and documents beyond these are labelled. Only what the regressions are fitted on is a sample of
labelled rows with documented bounds: ``labelled`` given labels and ``pool`` of the labels exchanged, the smallest hashes
of their ids (``pool`` other rows join them to standardise features). Labels of earlier rounds are found again from their
weights and thresholds in each pass, so no state is joined to texts. Scoring reads the whole text of every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import table, written

LABELLED, POOL, ROUNDS = 4000, 4000, 4
TEXT, LANGS, SOURCES = 512, 16, 64
NUMBERS = 9
SURE, SHARE = 0.9, 0.05


def _text_view(data: np.ndarray, edges: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Square roots of trigram shares (unit rows), and the share of distinct words."""
    out = np.zeros((len(edges) - 1, TEXT + 1), np.float32)
    d = data.astype(np.uint32)
    codes = ((d[:-2] * 0x9E3779B1 + d[1:-1] * 0x85EBCA6B + d[2:] * 0xC2B2AE35) >> 23).astype(np.uint16) if len(d) > 2 else np.empty(0, np.uint16)
    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if b - a > 2:
            out[i, :TEXT] = np.bincount(codes[a : b - 2], minlength=TEXT)
    out[:, :TEXT] = np.sqrt(out[:, :TEXT] / np.maximum(out[:, :TEXT].sum(axis=1, keepdims=True), 1))
    out[:, TEXT] = distinct
    return out


def _metadata_view(data: np.ndarray, edges: np.ndarray, langs: list, sources: list) -> np.ndarray:
    n = len(edges) - 1
    out = np.zeros((n, LANGS + SOURCES + NUMBERS), np.float32)
    for i, (lang, source) in enumerate(zip(langs, sources, strict=True)):
        out[i, zlib.crc32(str(lang).encode("utf-8", "surrogatepass")) % LANGS] = 1
        out[i, LANGS + zlib.crc32(str(source).encode("utf-8", "surrogatepass")) % SOURCES] = 1
    kinds = np.zeros(256, np.uint8)
    for k, chars in enumerate((b"\n", b" \t", b"0123456789", bytes(range(65, 91)), bytes(x for x in range(33, 127) if not chr(x).isalnum()))):
        kinds[list(chars)] = k + 1
    kind = kinds[data]
    size = np.diff(edges)
    line = np.flatnonzero(data == 10)
    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        counts = np.bincount(kind[a:b], minlength=6)
        own = line[np.searchsorted(line, a) : np.searchsorted(line, b)]
        longest = np.diff(np.r_[a - 1, own, b]).max() - 1
        shares = counts[1:6] / max(1, b - a)
        out[i, LANGS + SOURCES :] = (np.log1p(size[i]), np.log1p(counts[1]), np.log1p((b - a) / (1 + counts[1])), np.log1p(longest), *np.sqrt(shares))
    return out


def views(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, text view, metadata view) for slices of a batch; null text is empty, null language and source are values of their own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lo = 0
    while lo < len(texts):
        raw, edges, distinct, hi = [], [0], [], lo
        while hi < len(texts) and hi - lo < 500 and edges[-1] < 1 << 20:
            t = texts[hi].as_py().encode("utf-8", "surrogatepass")
            words = t.split()
            raw.append(t), edges.append(edges[-1] + len(t)), distinct.append(len(set(words)) / max(1, len(words)))
            hi += 1
        data, at = np.frombuffer(b"".join(raw), np.uint8), np.array(edges)
        yield slice(lo, hi), _text_view(data, at, np.array(distinct)), _metadata_view(data, at, langs.slice(lo, hi - lo).to_pylist(), sources.slice(lo, hi - lo).to_pylist())
        lo = hi


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Weights and a last intercept by damped Newton steps; the intercept isn't penalised."""
    n = x.shape[1] + 1
    w, penalty = np.zeros(n), np.full(n, ridge)
    penalty[-1] = 1e-6
    parts = [slice(i, i + 512) for i in range(0, len(x), 512)]
    wide = lambda s: np.c_[x[s].astype(np.float64), np.ones(len(x[s]))]  # noqa: E731  a few rows at a time in double precision
    times = lambda v: np.concatenate([wide(s) @ v for s in parts])
    loss = lambda v: float(np.logaddexp(0, np.where(y > 0, -1, 1) * times(v)).sum() + (penalty * v * v).sum() / 2)
    now = loss(w)
    for _ in range(steps):
        gradient, curve = penalty * w, np.diag(penalty)
        for s in parts:
            own = wide(s)
            p = sigmoid(own @ w)
            gradient += own.T @ (p - y[s])
            curve += (own * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ own
        step = np.linalg.solve(curve, gradient)
        size = 1.0
        while (new := loss(w - size * step)) > now and size > 1e-3:
            size /= 2
        if now - new < 1e-5 * max(1.0, abs(now)):
            break
        w, now = w - size * step, new
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    """Both views' weights (for standardised features), their calibrations and the combination."""

    center: list[np.ndarray]
    scale: list[np.ndarray]
    weights: list[np.ndarray]
    calibration: list[np.ndarray]
    combination: np.ndarray
    constant: float | None = None  # the score of all documents if the labels don't hold enough of both classes

    def score(self, *x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text view, metadata view, combined), each a probability of good quality."""
        if self.constant is not None:
            same = np.full(len(x[0]), self.constant)
            return same, same, same
        z = [self.calibration[i][0] * margin((v - self.center[i]) / self.scale[i], self.weights[i]) + self.calibration[i][1] for i, v in enumerate(x)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(margin(np.stack(z, axis=1), self.combination))


#: Margins are counted in hundredths, up to this many on each side.
LARGEST = 3000


@dataclass
class Rounds:
    """What the rounds so far have fitted: features' scales, and of each round both views' weights and thresholds."""

    center: list[np.ndarray]
    scale: list[np.ndarray]
    prior: float
    weights: list[list[np.ndarray]]
    cuts: list[list[tuple[int, int]]]  # a round's (least margin of good ones, largest of bad ones) for each view

    def margins(self, x: tuple[np.ndarray, ...], r: int) -> list[np.ndarray]:
        own = [margin((v - c) / s, w) for v, c, s, w in zip(x, self.center, self.scale, self.weights[r], strict=True)]
        return [np.clip(np.rint(100 * m), -LARGEST, LARGEST).astype(np.int32) for m in own]

    def labels(self, x: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """Each view's training labels, given by the other view in the finished rounds: 1, 0 or -1."""
        given = [np.full(len(x[0]), -1, np.int32) for _ in x]
        for r, cuts in enumerate(self.cuts):
            for i, (m, (good, bad)) in enumerate(zip(self.margins(x, r), cuts, strict=True)):
                free = given[1 - i] < 0
                given[1 - i][free & (m >= good)] = 1
                given[1 - i][free & (m <= bad)] = 0
        return given


Pseudo = tuple[list[np.ndarray], list[np.ndarray]]


def fit(x: list[np.ndarray], y: np.ndarray, held: np.ndarray, exchange: Callable[[Rounds], Pseudo], rounds: int = ROUNDS) -> Model:
    """``x``: the two views of all sample rows; ``y``: 1, 0, or -1 without label; ``held``: labelled rows for calibration.

    ``exchange`` ends a round: it adds the round's thresholds, and gives both views of rows labelled so far and each view's labels of them."""
    known = (y >= 0) & ~held
    if min((y[known] == c).sum() for c in (0, 1)) < 5 or min((y[held] == c).sum() for c in (0, 1)) < 2:
        labels = y[y >= 0]
        return Model([], [], [], [], np.zeros(3), float(labels.mean()) if len(labels) else 1.0)
    center = [v.mean(axis=0) for v in x]
    scale = [np.maximum(v.std(axis=0), 1e-3) for v in x]
    standard = lambda views_: [((v - c) / s).astype(np.float32) for v, c, s in zip(views_, center, scale, strict=True)]
    x = standard(x)
    done = Rounds(center, scale, float(y[known].mean()), [], [])
    more, given = [v[:0] for v in x], [y[:0], y[:0]]
    for r in range(rounds + 1):
        weights = []
        for v, m, lab, k in zip(x, more, given, (20.0, 2.0), strict=True):
            weights.append(logistic(np.concatenate([v[known], m[lab >= 0]]), np.concatenate([y[known], lab[lab >= 0]]), k))
        if r == rounds:
            break
        done.weights.append(weights)
        more, given = exchange(done)
        more = standard(more)
    calibration, z = [], []
    for v, w in zip(x, weights, strict=True):
        m = margin(v[held], w)
        a = logistic(m[:, None], y[held], 1e-2)
        calibration.append(a)
        z.append(a[0] * m + a[1])
    return Model(center, scale, weights, calibration, logistic(np.stack(z, axis=1), y[held], 1e-1))


def thresholds(counts: dict[int, int], n: int, prior: float, sure: float, share: float) -> tuple[int, int]:
    """(least margin of good rows, largest of bad ones), in hundredths, from the number of free rows by margin.

    Of ``n`` rows about ``share`` are taken, good and bad as in the labels; rows of equal margin all are, and one margin at
    least. None is taken that the view isn't ``sure`` of."""
    least = int(np.ceil(100 * np.log(sure / (1 - sure))))
    cuts = []
    for sign, part in ((1, prior), (-1, 1 - prior)):
        most, taken, cut = max(1, round(share * part * n)), 0, LARGEST + 1
        for m in sorted((sign * m for m in counts if sign * m >= least), reverse=True):
            taken += counts[sign * m]
            if taken > most and cut <= LARGEST:
                break
            cut = m
        cuts.append(sign * cut)
    return cuts[0], cuts[1]


FEATURED = "id long, h long, y int, y0 int, y1 int"


def _featured(docs: DataFrame, sample: DataFrame) -> tuple[pa.Table, list[np.ndarray]]:
    """The sample's rows (``FEATURED``) and both views of their texts, by hash: one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t, m in views(b.column(0), b.column(1), b.column(2)):
                n = part.stop - part.start
                lists = [pa.array(v.tobytes()[i * v.shape[1] * 4 : (i + 1) * v.shape[1] * 4] for i in range(n)) for v in (t, m)]
                rest = [b.column(i).slice(part.start, n) for i in range(3, 8)]
                yield pa.RecordBatch.from_arrays([*rest, *(x.cast(pa.binary()) for x in lists)], ["id", "h", "y", "y0", "y1", "t", "m"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "lang", "source").join(F.broadcast(sample), "id")
    found = rows.select("text", "lang", "source", "id", "h", "y", "y0", "y1").mapInArrow(run, FEATURED + ", t binary, m binary")
    # Rows of one id, however many, become one before they reach the driver: the one of the smallest views.
    found = found.groupBy("id", "h", "y", "y0", "y1").agg(F.min(F.struct("t", "m")).alias("v")).select("id", "h", "y", "y0", "y1", "v.t", "v.m")
    found = found.toArrow().sort_by([(k, "ascending") for k in ("h", "id")])
    widths = {"t": TEXT + 1, "m": LANGS + SOURCES + NUMBERS}
    return found, [np.frombuffer(b"".join(found[k].to_pylist()), np.float32).reshape(-1, n) for k, n in widths.items()]


def _exchange(docs: DataFrame, labelled_ids: DataFrame, pool: int, sure: float, share: float) -> Callable[[Rounds], Pseudo]:
    """A round over all documents without a label; each pass writes a few numbers a document."""

    def round_(done: Rounds) -> Pseudo:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, *x in views(b.column(1), b.column(2), b.column(3)):
                    columns = [*done.margins(x, len(done.cuts)), *done.labels(x)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(part.start, part.stop - part.start), *map(pa.array, columns)], ["id", "q0", "q1", "y0", "y1"])

        rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text", "lang", "source")
        scored = rows.mapInArrow(run, "id long, q0 int, q1 int, y0 int, y1 int").join(labelled_ids, "id", "left_anti")
        scored = written(scored, "margins")
        n = scored.count()
        # One row for each margin and view.
        counts = [dict(map(tuple, scored.where(f"y{1 - i} < 0").groupBy(f"q{i}").count().collect())) for i in (0, 1)]
        cuts = [thresholds(c, n, done.prior, sure, share) for c in counts]
        new = {f"y{1 - i}": F.expr(f"case when y{1 - i} >= 0 then y{1 - i} when q{i} >= {good} then 1 when q{i} <= {bad} then 0 else -1 end") for i, (good, bad) in enumerate(cuts)}
        given = scored.withColumns(new).where("y0 >= 0 or y1 >= 0").groupBy("id").agg(F.max("y0").alias("y0"), F.max("y1").alias("y1"))
        sample = given.select("id", F.xxhash64("id", F.lit(5)).alias("h"), F.lit(-1).alias("y"), "y0", "y1").orderBy("h", "id").limit(pool)
        found, x = _featured(docs, written(sample, "exchanged"))
        done.cuts.append(cuts)
        return x, [found[k].to_numpy() for k in ("y0", "y1")]

    return round_


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS, sure: float = SURE, share: float = SHARE) -> Model:
    """Fit on at most ``labelled`` rows of ``labels`` (doc_id, quality) and ``pool`` rows labelled by the views, found over all documents.

    Rows with a null id or label are left out; of several labels of one document the largest counts. The rows
    with the smallest hashes of their ids are taken, which doesn't depend on partitions; of several rows of one id one is.
    With fewer than 5 labels to fit on or 2 held out of either class nothing is fitted: the model is a constant, the
    mean label (1 without any). Null and empty texts are like any other; other columns are ignored."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    key = F.xxhash64("id", F.lit(5))
    chosen = one.withColumn("h", key).orderBy("h", "id").limit(labelled)
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.lit(-1).alias("y")).withColumn("h", key)
    others = ids.join(one.select("id"), "id", "left_anti").orderBy("h", "id").limit(pool)
    none = F.lit(-1)
    sample = chosen.unionByName(others).select("id", "h", "y", none.alias("y0"), none.alias("y1")).dropDuplicates(["id"])
    found, x = _featured(docs, sample)
    y = found["y"].to_numpy()
    held = (y >= 0) & (np.cumsum(y >= 0) % 4 == 0)
    return fit(x, y, held, _exchange(docs, one.select("id"), pool, sure, share), rounds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) scored: (doc_id, p_text, p_metadata, score), a row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t, m in views(b.column(1), b.column(2), b.column(3)):
                p = [np.round(v.astype(np.float64), 6) for v in model.score(t, m)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.start, part.stop - part.start), *map(pa.array, p)], ["doc_id", "p_text", "p_metadata", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    return rows.mapInArrow(run, "doc_id long, p_text double, p_metadata double, score double")


def rejected(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` with its columns, without the rows that score below ``least``; no join, so nulls and repeats are safe.

    A constant model can't tell documents apart: all are kept."""
    if model.constant is not None:
        return docs
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {n: names.index(n) for n in ("text", "lang", "source")}
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for part, t, m in views(*(b.column(at[n]) for n in ("text", "lang", "source"))):
                keep[part] = np.round(model.score(t, m)[2].astype(np.float64), 6) >= least
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op5_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("keep", F.col("score") >= 0.5)
