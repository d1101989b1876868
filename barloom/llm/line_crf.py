"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score is linear in features of the line and of the lines before and after it; a
2 x 2 table scores each step from line to line. Marginals from forward-backward, weighted by the lines' lengths, average
to the quality of the document.

Labels are known per document, so in training all lines of a document carry its label. The model is fitted on at most
SAMPLE labelled documents of at most SAMPLE_BYTES bytes each, drawn by a hash of doc_id; both bounds are arguments. The
driver therefore holds a bounded number of feature rows. Scoring covers all documents and whole texts in one pass without
a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Rolling, chunked, load, query, text_column, word_bounds, word_hashes

#: Labelled documents that a fit may take, and the longest of them in bytes.
SAMPLE, SAMPLE_BYTES = 6_000, 1 << 16
#: Quality from which a document is kept.
THRESHOLD = 0.3

# --- features -------------------------------------------------------------------------------------------

#: Classes of bytes whose share in a line is a feature.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b" \t",
    b".,;:'\"()-",
    b"!?",
    b"#$%&*@^~=+_\\/",
    b"|<>{}[]",
)
UPPER, LOWER, DIGIT, BLANK, STOP, SHOUT, SYMBOL, BAR, OTHER = range(9)
_CLASS = np.full(256, OTHER, np.int64)
for _k, _members in enumerate(CLASSES):
    _CLASS[list(_members)] = _k
_WORDS = Rolling(11)
#: Features of a line itself, the last ones of which are also taken from both neighbours.
OWN, SHARED = 20, 9
FEATURES = OWN + 2 * SHARED + 2


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x FEATURES), lengths in bytes, and the offsets of the documents' lines."""
    documents = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    doc_of_break = np.searchsorted(offsets, breaks, "right") - 1
    per_doc = np.bincount(doc_of_break, minlength=documents) + 1
    first = np.concatenate(([0], np.cumsum(per_doc)))
    lines = int(first[-1])
    start = np.zeros(lines, np.int64)
    start[first[:-1]] = offsets[:-1]
    later = np.ones(lines, bool)
    later[first[:-1]] = False
    start[later] = breaks + 1
    end = np.zeros(lines, np.int64)
    end[first[1:] - 1] = offsets[1:]
    inner = np.ones(lines, bool)
    inner[first[1:] - 1] = False
    end[inner] = breaks
    length = end - start

    line_of = np.repeat(np.arange(lines), np.diff(np.concatenate((start, [len(raw)]))))
    shares = np.bincount(line_of * 9 + _CLASS[raw], minlength=lines * 9).reshape(-1, 9)[:lines].astype(np.float64)
    shares[:, OTHER] -= np.diff(np.concatenate((start, [len(raw)]))) - length  # the line feeds
    size = np.maximum(length, 1)[:, None]

    w_start, w_end, _ = word_bounds(raw, offsets)
    w_hash = word_hashes(raw, w_start, w_end, _WORDS)
    w_line = np.searchsorted(start, w_start, "right") - 1
    words = np.bincount(w_line, minlength=lines).astype(np.float64)
    same = np.zeros(len(w_start), bool)
    same[1:] = (w_hash[1:] == w_hash[:-1]) & (w_line[1:] == w_line[:-1])
    repeats = np.bincount(w_line[same], minlength=lines)
    tail = _CLASS[raw[w_end - 1]] if len(w_end) else np.zeros(0, np.int64)
    marked = np.bincount(w_line[(tail == SYMBOL) | (tail == SHOUT)], minlength=lines)
    lone = np.bincount(w_line[(w_end - w_start == 1) & ((tail == BAR) | (tail == SYMBOL))], minlength=lines)
    capital = np.bincount(w_line[_CLASS[raw[w_start]] == UPPER], minlength=lines) if len(w_start) else np.zeros(lines)

    whole = _WORDS.prefix(_WORDS.bytes[raw])
    content = _WORDS.of(whole, start, end)
    doc_of = np.repeat(np.arange(documents), per_doc)
    key = np.lexsort((content, doc_of))
    twin = (content[key][1:] == content[key][:-1]) & (doc_of[key][1:] == doc_of[key][:-1])
    copied = np.zeros(lines, bool)
    copied[key[1:][twin]] = True
    copied[key[:-1][twin]] = True
    copied &= length > 0

    def per(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    upper = per(shares[:, UPPER], shares[:, UPPER] + shares[:, LOWER])
    own = np.stack(
        [
            np.log1p(length) / 5,
            np.log1p(words) / 5,
            shares[:, LOWER] / size[:, 0],
            shares[:, DIGIT] / size[:, 0],
            shares[:, BLANK] / size[:, 0],
            shares[:, STOP] / size[:, 0],
            shares[:, OTHER] / size[:, 0],
            np.minimum(per(length, words), 40) / 10,
            per(capital, words),
            (length == 0).astype(float),
            (words <= 2).astype(float),
            # shared with neighbours
            upper,
            (upper > 0.6).astype(float),
            np.minimum(shares[:, SYMBOL] / size[:, 0] * 4, 1),
            np.minimum(shares[:, BAR] / size[:, 0] * 4, 1),
            np.minimum(shares[:, SHOUT] / size[:, 0] * 4, 1),
            per(repeats, words),
            per(marked, words),
            per(lone, words),
            copied.astype(float),
        ],
        axis=1,
    )
    shared = own[:, OWN - SHARED :]
    before = np.zeros_like(shared)
    after = np.zeros_like(shared)
    before[later] = shared[np.flatnonzero(later) - 1]
    after[inner] = shared[np.flatnonzero(inner) + 1]
    edges = np.stack([(~later).astype(float), (~inner).astype(float)], axis=1)
    return np.concatenate((own, before, after, edges), axis=1), length, first


# --- the chain ------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def marginals(score: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains laid end to end: each line's log odds from the front, from behind, and its marginal of being good.

    score: log odds of good of every line alone; step[i, j]: score of going from state i to state j.
    Chains advance together, longest first, one line at a time.
    """
    ahead, behind = score.copy(), np.zeros(len(score))
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begins, ends = first[:-1][order], first[1:][order] - 1
    sizes = sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
    for t in range(1, longest):
        k = active[t]
        at = begins[:k] + t
        a = ahead[at - 1]
        ahead[at] += np.logaddexp(a + step[1, 1], step[0, 1]) - np.logaddexp(a + step[1, 0], step[0, 0])
        at = ends[:k] - t
        b = behind[at + 1] + score[at + 1]
        behind[at] = np.logaddexp(b + step[1, 1], step[1, 0]) - np.logaddexp(b + step[0, 1], step[0, 0])
    return ahead, behind, _sigmoid(ahead + behind)


@dataclass
class LineModel:
    """Weights over standardised features, their bias, and the step table."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    step: np.ndarray
    constant: float | None = None

    def documents(self, features: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of every document; an empty line weighs as one byte."""
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        score = (features - self.mean) / self.scale @ self.weights + self.bias
        _, _, good = marginals(score, first, self.step)
        weight = length + 1.0
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 250, rate: float = 0.08, decay: float = 1e-3) -> LineModel:
    """Maximum likelihood by gradient steps with per-weight rates (Adam); all lines of a document carry its label."""
    lines = int(first[-1])
    mean = features.mean(axis=0)
    scale = np.maximum(features.std(axis=0), 1e-3)
    x = (features - mean) / scale
    y = np.repeat(label.astype(float), np.diff(first))
    # Each document counts once, however many lines it has.
    share = np.repeat(1.0 / np.diff(first), np.diff(first)) / (len(first) - 1)
    inner = np.ones(lines, bool)
    inner[first[1:] - 1] = False
    here = np.flatnonzero(inner)
    theta = np.zeros(x.shape[1] + 5)
    theta[-4:] = [1.0, -1.0, -1.0, 1.0]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        step = theta[-4:].reshape(2, 2)
        score = x @ theta[: x.shape[1]] + theta[-5]
        ahead, behind, good = marginals(score, first, step)
        gap = (y - good) * share
        grad = np.zeros_like(theta)
        grad[: x.shape[1]] = gap @ x
        grad[-5] = gap.sum()
        if len(here):
            a, b = ahead[here], behind[here + 1] + score[here + 1]
            joint = np.stack([np.full(len(here), step[0, 0]), b + step[0, 1], a + step[1, 0], a + b + step[1, 1]], axis=1)
            joint = np.exp(joint - joint.max(axis=1, keepdims=True))
            joint /= joint.sum(axis=1, keepdims=True)
            seen = np.zeros((len(here), 4))
            seen[np.arange(len(here)), np.where(y[here] > 0, 3, 0)] = 1
            grad[-4:] = ((seen - joint) * share[here, None]).sum(axis=0)
        grad -= decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return LineModel(mean, scale, theta[: x.shape[1]], float(theta[-5]), theta[-4:].reshape(2, 2))


# --- Spark ----------------------------------------------------------------------------------------------


def is_held_out(id_col: str | Column) -> Column:
    return F.crc32(F.coalesce(F.col(id_col) if isinstance(id_col, str) else id_col, F.lit(0)).cast("string").cast("binary")) % 5 == 0


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, offsets in chunked(batches):
        features, _, first = line_features(raw, offsets)
        packed = [features[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(packed, pa.binary())], names=["label", "features"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, label_col: str = "quality") -> LineModel:
    """Fit on a sample of labelled documents that are not held out.

    Labels other than 0 and 1 are ignored, as are documents with contradicting labels. Without documents of both
    labels the model is a constant: the share of label 1, or 1 where nothing is labelled.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min(label_col).alias("label"), F.max(label_col).alias("most")).filter("label = most")
    # At most `sample` rows of two numbers, twice over: some belong to documents that are too long or not there.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).select(F.col("doc_id").alias("__labelled"), "label")
    texts = docs.select("doc_id", "text").filter(F.octet_length(F.coalesce("text", F.lit(""))) <= sample_bytes)
    picked = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__labelled")).select("doc_id", "text", "label")
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample)
    rows = text_column(picked, "doc_id", "text", "label").mapInArrow(_feature_rows, "label int, features binary").collect()
    # The order of collected rows must not matter to the fit.
    rows = sorted((bytes(r["features"]), r["label"]) for r in rows)
    label = np.array([y for _, y in rows])
    if len(rows) == 0 or label.min() == label.max():
        return LineModel(*[np.zeros(0)] * 3, 0.0, np.zeros((2, 2)), constant=float(label[0]) if len(rows) else 1.0)
    parts = [np.frombuffer(b, "<f4").reshape(-1, FEATURES) for b, _ in rows]
    first = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return fit(np.concatenate(parts).astype(np.float64), first, label)


def score(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row.

    * Null text is empty; an empty text is one empty line. Text without line feeds is one line.
    * Scores depend on the text alone: equal texts score equally. Repeated rows and null ids come through.
    * Other columns are not read. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in chunked(batches):
            quality = shared.value.documents(*line_features(raw, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(quality)], names=["doc_id", "score"])

    return text_column(docs, id_col, text_col).mapInArrow(work, "doc_id bigint, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents whose quality reaches the threshold, with all their columns (pipeline stage).

    * A null text is empty; an empty text is one empty line and is judged as that. Texts of any length are read whole.
    * Equal texts share their fate; repeated rows and rows with a null doc_id are judged each. Columns stay as they are.
    * Without usable labels every document has one score and stays. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in chunked(batches):
            good = model.value.documents(*line_features(raw, offsets)) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(work, docs.schema)


@query("op10_line_crf")
def _op10(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    scored = score(docs, train(docs, load(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
