"""Document quality by naive Bayes support vectors over n-gram indicators.

Method: every distinct n-gram of a text is an indicator, scaled by the log ratio of its counts in the two
classes; a linear model with hinge loss is fitted on the scaled, length-normalised vectors by dual coordinate
descent, pulled towards its mean weight, and its margins are mapped to 0..1 on rows the fit did not see.

N-grams are single words and word pairs, and runs of one to three word shapes (letter case, closing marks,
length, whether a word repeats the one before), so texts of words never seen are judged by their form. All are
hashed into a fixed table. Texts are scored whole; nothing but the text enters a score.

Fitting uses at most ``sample_rows`` labelled rows, chosen by a hash of their id, in one task; the table of
weights has a fixed size. Scoring runs over every row in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.words import blocks, bytes_of, mixed, word_hashes

BITS = 18
SAMPLE_ROWS = 8_000
ROUNDS = 12
COST = 1.0
PULL = 0.25
SMOOTHING = 1.0

_ODD = np.random.default_rng(9).integers(1, 1 << 63, size=8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER, _UPPER, _NUMBER, _MARK = 1, 2, 4, 8
_CLASS = np.full(256, _MARK, dtype=np.uint8)
_CLASS[97:123] = _LOWER
_CLASS[128:] = _LOWER
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _NUMBER


def _shapes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A small code per word: class of its first byte, classes present, its two closing marks, short or long."""
    kinds = _CLASS[raw]
    present = np.bitwise_or.reduceat(kinds, first) if len(first) else np.zeros(0, np.uint8)  # blanks between count as marks
    marks = kinds == _MARK
    closing = np.where(marks[last - 1], raw[last - 1], 0).astype(np.uint64)
    before = np.where((last - first > 1) & marks[last - 1] & marks[last - 2], raw[last - 2], 0).astype(np.uint64)
    size = np.minimum(last - first, 4).astype(np.uint64)
    code = kinds[first].astype(np.uint64) | (present & np.uint8(7)).astype(np.uint64) << np.uint64(4)
    return code | closing << np.uint64(8) | before << np.uint64(16) | size << np.uint64(24)


def indicators(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct table places of each text's n-grams; a text without words has none."""
    shift = np.uint64(64 - BITS)
    for a, b in blocks(offsets):
        part = offsets[a : b + 1]
        words, bounds, first, last = word_hashes(data, part, spans=True)
        n = len(words)
        if not n:
            yield from (np.zeros(0, dtype=np.int64) for _ in range(b - a))
            continue
        raw = data[int(part[0]) : int(part[-1])]
        again = np.zeros(n, dtype=np.uint64)
        again[1:] = words[1:] == words[:-1]
        again[bounds[:-1][bounds[:-1] < n]] = 0  # a text's first word repeats nothing
        shapes = mixed((_shapes(raw, first, last) | again << np.uint64(32)) * _ODD[0] + np.uint64(1))
        grams = np.empty((5, n), dtype=np.uint64)
        grams[0] = words * _ODD[1]
        grams[1, :-1] = words[:-1] * _ODD[2] + words[1:] * _ODD[3]
        grams[2] = shapes * _ODD[4]
        grams[3, :-1] = shapes[:-1] * _ODD[5] + shapes[1:] * _ODD[6]
        grams[4, :-2] = shapes[:-2] * _ODD[6] + shapes[1:-1] * _ODD[7] + shapes[2:] * _ODD[1]
        grams[1, -1:] = grams[3, -1:] = grams[4, -2:] = 0
        places = (mixed(grams) >> shift).astype(np.int32)
        for i in range(b - a):
            low, high = bounds[i], bounds[i + 1]
            if low == high:
                yield np.zeros(0, dtype=np.int64)
                continue
            parts = (places[0, low:high], places[1, low : high - 1], places[2, low:high], places[3, low : high - 1], places[4, low : max(low, high - 2)])
            yield np.unique(np.concatenate(parts)).astype(np.int64)


@dataclass
class QualityModel:
    """weights of the scaled indicators, the scales, and the line from margin to log-odds."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, places: np.ndarray) -> float:
        scale = self.ratios[places]
        length = float(np.sqrt(scale @ scale))
        return (float(self.weights[places].sum()) / length if length else 0.0) + self.bias

    def score(self, places: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(places) + self.shift, -500, 500))))


def constant_model(score: float) -> QualityModel:
    zero = np.zeros(1 << BITS)
    return QualityModel(zero, zero, 0.0, 0.0, float(np.log(score / (1 - score))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.full((2, 1 << BITS), SMOOTHING)
    for places, label in zip(rows, labels, strict=True):
        counts[int(label), places] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, cost: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + sum cost * hinge: each row's multiplier is set in turn to its best value within 0..cost.

    Rows have length one, and one constant component of one that carries the bias.
    """
    w, bias = np.zeros(1 << BITS), 0.0
    held = np.zeros(len(rows))
    order = np.arange(len(rows))
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            places, x, y = rows[i], values[i], signs[i]
            slope = y * (float(w[places] @ x) + bias) - 1.0
            new = min(max(held[i] - slope / (float(x @ x) + 1.0), 0.0), cost[i])
            step = new - held[i]
            if step:
                w[places] += step * y * x
                bias += step * y
                held[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def _line(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), with smoothed targets."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    slope, shift = 2.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -60, 60)))
        weight = np.maximum(p * (1 - p), 1e-9)
        a, b, c = (weight * margins**2).sum() + 1e-3, (weight * margins).sum(), weight.sum() + 1e-9
        g, h = ((p - target) * margins).sum() + 1e-3 * slope, (p - target).sum()
        det = a * c - b * b
        if det <= 0:
            break
        slope, shift = slope - (c * g - b * h) / det, shift - (a * h - b * g) / det
    return max(slope, 1e-3), shift


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> QualityModel:
    """Fit on four fifths of the rows, calibrate on the fifth; one class alone gives a constant score."""
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        return constant_model((ones + 1) / (len(labels) + 2))
    spare = np.zeros(len(rows), dtype=bool)
    for label in (0, 1):  # every fifth of each class
        spare[np.flatnonzero(labels == label)[4::5]] = True
    kept = np.flatnonzero(~spare)
    ratios = log_count_ratios([rows[i] for i in kept], labels[kept])
    values = []
    for i in kept:
        x = ratios[rows[i]]
        values.append(x / (np.sqrt(x @ x) or 1.0))
    signs = np.where(labels[kept] == 1, 1.0, -1.0)
    share = max((signs > 0).mean(), 1e-9)
    cost = np.where(signs > 0, COST * 0.5 / share, COST * 0.5 / max(1 - share, 1e-9))
    w, bias = dual_coordinate_descent([rows[i] for i in kept], values, signs, cost, ROUNDS)
    mean = np.abs(w).sum() / max(1, np.count_nonzero(w))
    pulled = (1 - PULL) * w + PULL * mean * np.sign(w)
    model = QualityModel(pulled * ratios, ratios, bias, 1.0, 0.0)
    probe = np.flatnonzero(spare) if len(set(labels[spare].tolist())) == 2 else kept
    model.slope, model.shift = _line(np.array([model.margin(rows[i]) for i in probe]), labels[probe])
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id's digits leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(doc_id, label): 0 or 1, of ids outside the held-out third; ids with contradicting labels are left out."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").drop("high")


def _selected(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fit(documents: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on at most ``sample_rows`` rows of ``labelled`` (from :func:`training_labels`); without any, every score is one half."""
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = _selected(documents, id_col, text_col).join(F.broadcast(chosen), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [p.astype(np.int32).tobytes() for p in indicators(*bytes_of(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(places, pa.binary())], names=["doc_id", "label", "places"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("places", "ascending")])
        places = [np.frombuffer(p.as_buffer(), dtype=np.int32).astype(np.int64) for p in table["places"]]
        m = fit_rows(places, table["label"].to_numpy().astype(np.int64))
        parts = [m.weights.astype(np.float32).tobytes(), m.ratios.astype(np.float32).tobytes()]
        return pa.table({"weights": [parts[0]], "ratios": [parts[1]], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    encoded = rows.mapInArrow(encode, "doc_id long, label int, places binary")
    found = encoded.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(learn, "weights binary, ratios binary, bias double, slope double, shift double").collect()
    if not found:
        return constant_model(0.5)
    r = found[0]  # one row: two tables of 2**BITS numbers
    weights, ratios = (np.frombuffer(v, dtype=np.float32).astype(np.float64) for v in (r.weights, r.ratios))
    return QualityModel(weights, ratios, r.bias, r.slope, r.shift)


def _scorer(documents: DataFrame, model: QualityModel):
    return documents.sparkSession.sparkContext.broadcast(model)


def score(documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row; null and empty texts get the score of a text without n-grams."""
    shared = _scorer(documents, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(p) for p in indicators(*bytes_of(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return _selected(documents, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def accepted(documents: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows scoring at least ``least``, with all their columns."""
    shared = _scorer(documents, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([model.score(p) >= least for p in indicators(*bytes_of(texts))], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
