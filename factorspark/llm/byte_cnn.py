"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded, convolved with learned filters at a stride, and max-pooled within chunks of fixed length; neighbouring
chunks overlap by half, and together they cover the whole text. The chunks' pooled features are combined by their mean and
their maximum into one probability. The weights are some ten thousand numbers, trained on a bounded sample of labelled texts.

Defined cases: a null or empty text is one chunk of padding and gets a score like any other. A text of any length is read
whole, in bounded slices. Repeated rows are scored each by itself. Without labels of both classes, scores are the share of
label 1 (0.5 without any), and ``filtered`` keeps every row. Ids with contradicting labels are not learned from. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, durable, remainder, text_bytes

#: Labelled texts of each class used for training: the bound of the sample, whatever the number of labels.
SAMPLE_PER_CLASS = 1500
#: Bytes of all texts of the sample; a text that would pass it is left out of training.
SAMPLE_BYTES = 64 << 20
EMBEDDING, FILTERS, WIDTH, STRIDE = 8, 32, 8, 4
#: Bytes of half a chunk: a chunk is two neighbouring halves.
HALF = 256
_STEPS = HALF // STRIDE
#: Halves convolved at once in scoring, and in training, whose windows are larger.
SLICE, TRAINING_SLICE = 256, 256


@dataclass
class Network:
    """Weights; ``shift`` moves the log odds from the balanced sample to the labels' own shares."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    combine: np.ndarray
    offset: float
    shift: float = 0.0
    constant: float | None = None
    parts: tuple[np.ndarray, np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        self.parts = (np.ascontiguousarray(self.kernel[:STRIDE * EMBEDDING]), np.ascontiguousarray(self.kernel[STRIDE * EMBEDDING:]))


def halves(text: bytes | None) -> np.ndarray:
    """The text's bytes plus 1, padded by 0 to whole halves; one half at least, and the overlap of its last window."""
    data = np.frombuffer(text or b"", np.uint8)
    n = max(1, -(-len(data) // HALF))
    out = np.zeros(n * HALF, np.uint16)
    out[:len(data)] = data
    out[:len(data)] += 1
    return out.reshape(n, HALF)


def _windows(net: Network, codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Embedded half chunks with the stride that follows each: (halves, steps + 1, stride * embedding)."""
    x = net.embed[np.concatenate([codes, following], axis=1)]
    return x.reshape(len(codes), _STEPS + 1, STRIDE * EMBEDDING)


def _following(codes: np.ndarray) -> np.ndarray:
    """The first stride of the next half: windows run across the border."""
    out = np.zeros((len(codes), STRIDE), codes.dtype)
    out[:-1] = codes[1:, :STRIDE]
    return out


def _pooled(net: Network, codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The filters' maxima over each half."""
    out = np.empty((len(codes), FILTERS), np.float32)
    for at in range(0, len(codes), SLICE):
        x = _windows(net, codes[at:at + SLICE], following[at:at + SLICE])
        y = (x[:, :-1].reshape(-1, STRIDE * EMBEDDING) @ net.parts[0]).reshape(len(x), _STEPS, FILTERS)
        y += (x[:, 1:].reshape(-1, STRIDE * EMBEDDING) @ net.parts[1]).reshape(len(x), _STEPS, FILTERS)
        out[at:at + SLICE] = y.max(1)
    return np.maximum(out + net.bias, 0)


def chunked(pooled: np.ndarray) -> np.ndarray:
    """Chunks of two neighbouring halves from the halves' maxima."""
    return np.maximum(pooled[:-1], pooled[1:]) if len(pooled) > 1 else pooled


def scores(net: Network, texts: Sequence[bytes | None]) -> np.ndarray:
    """Probability of label 1 of each whole text."""
    if net.constant is not None:
        return np.full(len(texts), net.constant)
    codes = [halves(t) for t in texts]
    following = np.concatenate([_following(c) for c in codes]) if codes else np.zeros((0, STRIDE), np.uint16)
    pooled = _pooled(net, np.concatenate(codes) if codes else np.zeros((0, HALF), np.uint16), following)
    out, at = np.empty(len(texts)), 0
    for i, c in enumerate(codes):
        features = chunked(pooled[at:at + len(c)])
        at += len(c)
        out[i] = np.concatenate([features.mean(0, dtype=np.float64), features.max(0)]) @ net.combine + net.offset + net.shift
    return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def train(texts: Sequence[bytes | None], labels: Sequence[int], share: float, epochs: int = 12, rate: float = 0.004, seed: int = 7) -> Network:
    """Fit by Adam on balanced batches of whole texts; ``share`` is the share of label 1 among all labels."""
    y = np.asarray(labels, np.float64)
    rng = np.random.default_rng(seed)
    size = STRIDE * EMBEDDING
    net = Network(rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32), rng.normal(0, 1 / np.sqrt(2 * size), (2 * size, FILTERS)).astype(np.float32),
                  np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), 0.0)
    if not len(y) or y.min() == y.max():
        net.constant = float(share) if len(y) else 0.5
        return net
    net.embed[0] = 0
    params = [net.embed, net.kernel, net.bias, net.combine, np.zeros(1)]
    moments = [(np.zeros_like(p, np.float64), np.zeros_like(p, np.float64)) for p in params]
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    step, batch = 0, 32
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            chosen = order[lo:lo + batch]
            data = [(codes := halves(texts[i]), _following(codes)) for i in chosen]
            grads = _gradients(net, params[4], data, y[chosen], weight[chosen])
            step += 1
            pace = rate * (1 - epoch / epochs) + rate * 0.05
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
            net.embed[0] = 0
            net.__post_init__()
    net.offset = float(params[4][0])
    net.shift = float(np.log(share / (1 - share)))
    return net


def _gradients(net: Network, offset: np.ndarray, batch: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients over every half of the batch's texts; windows are held for a slice at a time."""
    codes, following = (np.concatenate(parts) for parts in zip(*batch, strict=True))
    peak, pooled = np.empty((len(codes), FILTERS), np.int64), np.empty((len(codes), FILTERS), np.float32)
    for lo in range(0, len(codes), TRAINING_SLICE):
        part = slice(lo, lo + TRAINING_SLICE)
        x = _windows(net, codes[part], following[part])
        response = np.concatenate([x[:, :-1], x[:, 1:]], axis=2) @ net.kernel
        peak[part] = response.argmax(1)
        pooled[part] = np.maximum(np.take_along_axis(response, peak[part][:, None], 1)[:, 0] + net.bias, 0)
    d_pooled = np.zeros(pooled.shape)
    d_combine, d_offset, at = np.zeros_like(net.combine), 0.0, 0
    for (c, _), label, w in zip(batch, y, weight, strict=True):
        own = pooled[at:at + len(c)]
        late = own[1:] > own[:-1] if len(own) > 1 else np.zeros((1, FILTERS), bool)
        features = chunked(own)
        top = features.argmax(0)
        vector = np.concatenate([features.mean(0, dtype=np.float64), features.max(0)])
        slope = w * (1 / (1 + np.exp(-np.clip(vector @ net.combine + offset[0], -60, 60))) - label) / len(batch)
        d_combine += slope * vector
        d_offset += slope
        d_features = np.tile(slope * net.combine[:FILTERS] / len(features), (len(features), 1))
        d_features[top, np.arange(FILTERS)] += slope * net.combine[FILTERS:]
        first = np.where(late, 0, d_features)
        d_pooled[at:at + len(features)] += first
        if len(own) > 1:
            d_pooled[at + 1:at + len(own)] += d_features - first
        at += len(c)
    d_pooled *= pooled > 0
    d_kernel, d_embed = np.zeros_like(net.kernel), np.zeros_like(net.embed)
    for lo in range(0, len(codes), TRAINING_SLICE):
        part = slice(lo, lo + TRAINING_SLICE)
        full = np.concatenate([codes[part], following[part]], axis=1)
        for f in range(FILTERS):
            h = np.flatnonzero(d_pooled[part, f])
            slope = d_pooled[part][h, f].astype(np.float32)
            at_peak = full[h[:, None], peak[part][h, f][:, None] * STRIDE + np.arange(WIDTH)]
            d_kernel[:, f] += slope @ net.embed[at_peak].reshape(len(h), WIDTH * EMBEDDING)
            # The slopes of each byte at each place of the window, times the filter's weights there.
            of = np.bincount((at_peak.astype(np.int64) * WIDTH + np.arange(WIDTH)).ravel(), np.repeat(slope, WIDTH), 257 * WIDTH).reshape(257, WIDTH)
            d_embed += (of @ net.kernel[:, f].reshape(WIDTH, EMBEDDING)).astype(np.float32)
    return [d_embed, d_kernel, d_pooled.sum(0).astype(np.float32), d_combine + 1e-4 * net.combine, np.array([d_offset])]


def fitted(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = SAMPLE_PER_CLASS, judged: DataFrame | None = None) -> Network:
    """The network trained on at most ``per_class`` labelled texts of each class among the ids where ``learn`` holds.

    The sample is taken by the order of a hash of the id, so it does not depend on partitions, until it holds SAMPLE_BYTES. Labels are
    those of the ids of ``docs``, counted in full for the share of label 1; if ``judged`` (rows that the network is meant for) has labels
    of both classes, the share is theirs.
    """
    labels = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    known = labels.where("doc_id is not null and quality in (0, 1)").where(F.lit(True) if learn is None else learn)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("quality")).where("low = quality")

    def counted(rows: DataFrame) -> dict[int, int]:
        return {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}

    counts = counted(known)
    if not counts:
        return train([], [], 0.5)
    place = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = None
    for value in sorted(counts):
        part = known.where(F.col("quality") == value).orderBy(place, "doc_id").limit(per_class).select("doc_id", "quality")
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class ids and labels are sent, and as many texts come back, of SAMPLE_BYTES in all.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = durable(rows.withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)), "place": place}), "cnn-sample")
    held, kept = 0, []
    for r in sorted(rows.select("place", "doc_id", "size").collect(), key=lambda r: (r["place"], str(r["doc_id"]))):
        if held + r["size"] <= SAMPLE_BYTES:
            held += r["size"]
            kept.append(r["doc_id"])
    sample = sorted(rows.where(F.col("doc_id").isin(kept)).collect(), key=lambda r: str(r["doc_id"]))
    if judged is not None and len(counts) == 2:
        own = counted(known.join(judged.select("doc_id"), "doc_id", "left_semi"))
        counts = own if len(own) == 2 else counts
    share = counts.get(1, 0) / sum(counts.values())
    return train([r["text"].encode() if r["text"] else None for r in sample], [r["quality"] for r in sample], share)


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(net, text_bytes(batch)), pa.float64())], ["doc_id", "score"])

    return arrow_map(rows, run, f"doc_id {kind}, score double")


def filtered(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns, in one pass over the texts.

    A network that has not seen both classes cannot tell them apart: all rows stay, with a warning.
    """
    if net.constant is not None:
        warnings.warn("labels of one class or none: the quality classifier keeps every document", stacklevel=2)
        return docs
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=2 << 20):
            keep = scores(net, text_bytes(batch)) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], ["row"])

    kept = arrow_map(rows, run, f"row {rows.schema['row'].dataType.simpleString()}")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def held_out() -> Column:
    """The third of the ids that is never learned from."""
    return F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` with the network learned from the ids that are not held out."""
    rows = scored(docs, fitted(docs, labels, ~held_out()))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
