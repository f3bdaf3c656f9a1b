"""Document quality from a linear-chain conditional random field over lines.

Every line gets a good or bad label.  A line is described by binned measures of
its characters and words, of the line before and of the line after; transitions
between neighbouring labels are learned too.  The score of a document is the mean
of its lines' forward-backward marginals for "good", weighted by line length.

Training: labels come for documents, so every line of a training document takes
its document's label.  The model is fitted by Adam on at most ``TRAIN_DOCS``
labelled documents (those with the smallest hash of the id).  Their whole texts are
cut into stretches of at most ``STRETCH`` lines, chains of their own, of which at most
``TRAIN_STRETCHES`` are taken (the smallest hashes of id and number: any line of a text
has the same chance); their binned measures -- some 40 bytes a line -- are all that
reaches the driver.  Scoring reads every whole text in the tasks, a bounded
piece at a time, and uses nothing but the text.

Defined results: a text without lines (null or empty) scores the share of label
1 among the training stretches; without any labelled document every score is 0.5; a
null id is scored like any other; of repeated labels the lowest counts, null
labels don't; a line over ``PIECE`` bytes counts as several lines; an empty table
gives an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Hasher

TRAIN_DOCS = 4000
STRETCH = 500
TRAIN_STRETCHES = 8000
EPOCHS = 12
PIECE = 1 << 20
CELLS = 1 << 20

#: Bin edges of each measure of a line.
SHARE = (0.0, 0.004, 0.012, 0.03, 0.06, 0.12, 0.25, 0.5)
EDGES = (
    ("length", (1, 3, 5, 6, 7, 8, 9, 11)),  # log2 of bytes
    ("upper", SHARE), ("digit", SHARE), ("beyond_ascii", SHARE), ("stops", SHARE), ("marks", SHARE), ("symbols", SHARE),
    ("space", (0.0, 0.05, 0.1, 0.14, 0.17, 0.2, 0.25, 0.4)),
    ("word_length", (1, 2, 3, 4, 5, 6, 8, 12)),
    ("distinct", (0.1, 0.25, 0.4, 0.55, 0.7, 0.8, 0.9, 0.97)),
    ("words", (0, 1, 2, 3, 4, 5, 6, 8)),  # log2
    ("repeated", (0.5,)),
)
BINS = 10  # up to nine of a measure, and one for "no such line"
WIDTH = 3 * len(EDGES)

_KIND = np.full(128, 6, np.uint8)  # other ASCII: symbols
for _kind, _chars in ((0, b"abcdefghijklmnopqrstuvwxyz"), (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"),
                      (4, b".,;:'\"-()"), (5, b"!?"), (7, b" \t\n\r\x0b\x0c")):
    _KIND[list(_chars)] = _kind
KIND = np.concatenate([_KIND, np.full(128, 3, np.uint8)])


def _lines(data: bytes) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Pieces of whole lines with the starts and ends of their lines."""
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else (data.rfind(b"\n", at, at + PIECE) + 1 or at + PIECE)
        piece = data[at:end]
        breaks = np.flatnonzero(np.frombuffer(piece, np.uint8) == 10)
        starts = np.concatenate([[0], breaks + 1])
        ends = np.concatenate([breaks, [len(piece)]])
        real = ends > starts
        yield piece, starts[real], ends[real]
        at = end


def measures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bins of every non-empty line and its neighbours, line lengths)."""
    rows, hashes, sizes = [], [], []
    for piece, starts, ends in _lines((text or "").encode("utf-8", "replace")):
        if not len(starts):
            continue
        h = Hasher(piece)
        size = (ends - starts).astype(np.float64)
        kinds = KIND[h.bytes]
        cells = np.stack([np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)]) for k in range(1, 8)])
        upper, digit, wide, stops, marks, symbols, space = (cells[:, ends] - cells[:, starts]) / size
        w0, w1 = h.words()
        line = np.searchsorted(starts, w0, "right") - 1
        n_words = np.bincount(line, minlength=len(starts))
        with np.errstate(over="ignore"):
            own = np.unique(h.ranges(w0, w1) + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
        distinct = np.bincount(line[own], minlength=len(starts))
        some = np.maximum(n_words, 1)
        rows.append(np.stack([np.log2(size), upper, digit, wide, stops, marks, symbols, space, size * (1 - space) / some,
                              distinct / some, np.log2(some)]))
        hashes.append(h.ranges(starts, ends))
        sizes.append(size)
    if not rows:
        return np.zeros((0, WIDTH), np.uint8), np.zeros(0)
    _, back, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    values = np.vstack([np.concatenate(rows, axis=1), times[back] > 1])
    own = np.stack([np.searchsorted(edges, v) for (_, edges), v in zip(EDGES, values)], axis=1).astype(np.uint8)
    none = np.full((1, len(EDGES)), BINS - 1, np.uint8)
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])]), np.concatenate(sizes)


@dataclass
class Crf:
    weights: np.ndarray  # (WIDTH, BINS): how much a bin speaks for "good"
    moves: np.ndarray  # (2, 2): transition scores
    prior: float

    def emissions(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(WIDTH), bins].sum(axis=-1)


def forward_backward(good: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" (documents x lines) and expected transitions.

    ``good`` holds the score of label 1 over label 0, padded on the right."""
    n, width = good.shape
    real = np.arange(width)[None, :] < lengths[:, None]
    scores = np.stack([np.zeros_like(good), good], axis=2)
    ahead, back = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    for t in range(width):
        ahead[:, t] = scores[:, t]
        if t:
            step = ahead[:, t - 1, :, None] + moves
            ahead[:, t] += np.logaddexp(step[:, 0], step[:, 1])
    for t in range(width - 2, -1, -1):
        step = moves + (scores[:, t + 1] + back[:, t + 1])[:, None, :]
        back[:, t] = np.where(real[:, t + 1, None], np.logaddexp(step[..., 0], step[..., 1]), 0)
    both = ahead + back
    chance = np.where(real, 1 / (1 + np.exp(np.clip(both[..., 0] - both[..., 1], -500, 500))), 0)
    pairs = np.zeros((2, 2))
    if width > 1:
        total = np.logaddexp(both[..., 0], both[..., 1])[:, :1, None, None]
        joint = ahead[:, :-1, :, None] + moves + (scores + back)[:, 1:, None, :] - total
        pairs = (np.exp(np.minimum(joint, 0)) * real[:, 1:, None, None]).sum(axis=(0, 1))
    return chance, pairs


def _padded(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of like length together: (which, padded bins, lengths)."""
    lengths = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * lengths[order[hi]] * WIDTH <= CELLS:
            hi += 1
        some = order[lo:hi]
        out = np.full((len(some), int(lengths[some].max()), WIDTH), BINS - 1, np.uint8)
        for row, k in enumerate(some):
            out[row, :lengths[k]] = docs[k]
        yield some, out, lengths[some]
        lo = hi


def fit(docs: list[np.ndarray], labels: np.ndarray, *, epochs: int = EPOCHS, rate: float = 0.08, decay: float = 1e-4,
        seed: int = 5) -> Crf | None:
    """Adam on the conditional log likelihood, in batches of like length."""
    if not len(labels):
        return None
    model = Crf(np.zeros((WIDTH, BINS)), np.zeros((2, 2)), float(np.mean(labels)))
    rng, step = np.random.default_rng(seed), 0
    shuffled = rng.permutation(len(docs))
    batches = []
    for lo in range(0, len(docs), 128):
        ids = shuffled[lo:lo + 128]
        batches += [(bins, n, labels[ids[which]]) for which, bins, n in _padded([docs[i] for i in ids])]
    state = [np.zeros_like(x) for x in (model.weights, model.weights, model.moves, model.moves)]
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            bins, n, want = batches[b]
            real = np.arange(bins.shape[1])[None, :] < n[:, None]
            chance, pairs = forward_backward(model.emissions(bins), model.moves, n)
            gap = np.where(real, want[:, None] - chance, 0)
            slots = np.arange(WIDTH) * BINS + bins
            grad_w = np.bincount(slots.ravel(), np.repeat(gap.ravel(), WIDTH), WIDTH * BINS).reshape(WIDTH, BINS)
            seen = np.zeros((2, 2))
            for y in (0, 1):
                seen[y, y] = np.maximum(n[want == y] - 1, 0).sum()
            step += 1
            for k, (value, grad) in enumerate(((model.weights, grad_w), (model.moves, seen - pairs))):
                grad = grad / max(1, real.sum()) - decay * value
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return model


def score_documents(model: Crf | None, texts: list[str | None]) -> list[np.ndarray]:
    """The marginals of every document's lines and, last, its score."""
    if model is None:
        return [np.array([0.5])] * len(texts)
    found = [measures(t) for t in texts]
    out = [np.array([model.prior])] * len(texts)
    for which, bins, n in _padded([f[0] for f in found]):
        chance, _ = forward_backward(model.emissions(bins), model.moves, n)
        for row, k in enumerate(which):
            lines, sizes = chance[row, :n[row]], found[k][1]
            out[k] = np.append(lines, np.clip((lines * sizes).sum() / sizes.sum(), 0.0, 1.0))
    return out


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 3 (null ids: fold 0)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_docs: int = TRAIN_DOCS,
          max_stretches: int = TRAIN_STRETCHES) -> Crf | None:
    """Fit on at most ``max_stretches`` stretches of at most ``max_docs`` labelled documents
    (smallest hashes of the id, then of id and number of the stretch)."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                lines = measures(text.as_py())[0]
                parts = [lines[lo:lo + STRETCH].tobytes() for lo in range(0, max(1, len(lines)), STRETCH)]
                who = pa.array([i] * len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(who), batch.column("label").take(who),
                                                  pa.array(np.arange(len(parts)), pa.int64()), pa.array(parts, pa.binary())],
                                                 ["id", "label", "part", "bins"])

    marked = (labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
              .where("id is not null").groupBy("id").agg(F.min("label").cast("int").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(max_docs))
    kind = marked.schema["id"].dataType.simpleString()
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id")
            .select("id", "label", "text").mapInArrow(binned, f"id {kind}, label int, part bigint, bins binary")
            .orderBy(F.xxhash64("id", "part"), "id", "part", "bins").limit(max_stretches).collect())
    return fit([np.frombuffer(bytes(r["bins"]), np.uint8).reshape(-1, WIDTH) for r in rows],
               np.array([r["label"] for r in rows], np.int64))


def score(docs: DataFrame, model: Crf | None, *, text_col: str = "text", out: str = "quality_score",
          lines_out: str = "line_scores") -> DataFrame:
    """``docs`` with the score of each text and the marginals of its lines."""
    held = docs.sparkSession.sparkContext.broadcast(model and (model.weights, model.moves, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = held.value and Crf(*held.value)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                found = score_documents(crf, [t.as_py() for t in part.column(text_col)])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([float(f[-1]) for f in found], pa.float64()),
                     pa.array([f[:-1] for f in found], pa.list_(pa.float64()))], [*part.schema.names, out, lines_out])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(out), F.lit(None).cast("array<double>").alias(lines_out)).schema)
