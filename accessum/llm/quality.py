"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over them, and each filter's responses are max-pooled within chunks of CHUNK
bytes that overlap by BLOCK bytes and together cover the whole text. The pooled responses are averaged over all chunks
and a small dense layer turns them into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import in_pieces, slices

BLOCK, BLOCKS_A_CHUNK = 32, 4
CHUNK, STEP = BLOCK * BLOCKS_A_CHUNK, BLOCK * (BLOCKS_A_CHUNK - 1)
WIDTH, HOP, EMBED, FILTERS, HIDDEN = 8, 2, 4, 16, 12
#: Bounds of the sample a model is fitted on: rows of each label, and bytes that their whole texts may sum to.
FIT_ROWS, FIT_BYTES = 2000, 8 << 20
#: Bytes of the texts of one step of learning; a longer text is a step of its own.
STEP_BYTES = 1 << 18
EPOCHS, DOCS_A_STEP, RATE, AVERAGED = 10, 64, 0.006, 0.3
THRESHOLD = 0.7
HELD_OUT = 2


def _padded(texts: list[bytes], ahead: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, each filled up with zeros to whole chunks and one block more, so that no window meets another
    text; the first byte of each chunk; and the chunks of each text, one at least. ahead: bytes for that block's start."""
    chunks = [max(1, -(-(len(t) - BLOCK) // STEP)) for t in texts]
    data = np.zeros(sum(chunks) * STEP + 2 * BLOCK * len(texts), np.uint8)
    firsts, at = [], 0
    for i, (t, c) in enumerate(zip(texts, chunks)):
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
        firsts.append(at + STEP * np.arange(c))
        at += c * STEP + BLOCK
        if ahead:
            data[at : at + len(ahead[i])] = np.frombuffer(ahead[i], np.uint8)
        at += BLOCK
    return data, np.concatenate(firsts) if firsts else np.empty(0, np.int64), np.array(chunks)


@dataclass
class ByteConvNet:
    """Parameters and the forward pass. prior: the probability where there was nothing to learn from."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float | None = None

    @classmethod
    def fresh(cls, seed: int = 7) -> ByteConvNet:
        r = np.random.default_rng(seed)
        shapes = {"embed": (256, EMBED), "filters": (WIDTH * EMBED, FILTERS), "bias": (FILTERS,), "dense": (FILTERS, HIDDEN), "dense_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,)}
        scale = {"embed": 0.5, "filters": 0.3, "dense": 0.4, "out": 0.4}
        return cls({k: (r.normal(0, scale.get(k, 0), s)).astype(np.float32) for k, s in shapes.items()})

    def responses(self, data: np.ndarray, texts: list[bytes], chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every HOP bytes of data: the window's embedding, and the filters' rectified responses.

        Windows that start behind a text's end, and not at its start, respond with 0, so that filling up says nothing.
        """
        flat = self.weights["embed"][data].reshape(-1)
        n = (len(data) - WIDTH) // HOP
        windows = np.lib.stride_tricks.as_strided(flat, (n, WIDTH * EMBED), (HOP * EMBED * 4, 4))
        active = np.maximum(windows @ self.weights["filters"] + self.weights["bias"], 0)
        at = 0
        for t, c in zip(texts, chunks):
            end = at + c * STEP + 2 * BLOCK
            active[(at + max(1, len(t)) + HOP - 1) // HOP : end // HOP] = 0
            at = end
        return windows, active

    def pooled(self, texts: list[bytes], ahead: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums over each text's chunks of the filters' largest responses, and the number of chunks."""
        data, firsts, chunks = _padded(texts, ahead)
        _, active = self.responses(data, texts, chunks)
        a_block = BLOCK // HOP
        blocks = active[: len(active) // a_block * a_block].reshape(-1, a_block, FILTERS).max(1)
        at = firsts // BLOCK
        best = blocks[at]
        for k in range(1, BLOCKS_A_CHUNK):
            np.maximum(best, blocks[at + k], out=best)
        return np.add.reduceat(best, np.concatenate([[0], np.cumsum(chunks)[:-1]]), axis=0, dtype=np.float64), chunks

    def score(self, texts: list[bytes], limit: int = 1 << 18) -> np.ndarray:
        """One probability a text; long texts pass piece by piece, cut where a chunk starts."""
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        sums, counts = np.zeros((len(texts), FILTERS)), np.zeros(len(texts))
        size = limit // STEP * STEP
        for i, j in slices([len(t) for t in texts], limit):
            long = texts[i] if j == i + 1 else b""
            for k in range(0, max(1, len(long) - BLOCK), size):
                part = [long[k : k + size + BLOCK]] if long else texts[i:j]
                s, c = self.pooled(part, [long[k + size + BLOCK : k + size + BLOCK + WIDTH]] if long else None)
                sums[i:j] += s
                counts[i:j] += c
        w = self.weights
        hidden = np.tanh((sums / np.maximum(counts, 1)[:, None]) @ w["dense"] + w["dense_bias"])
        return 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_bias"][0], -30, 30)))

    def gradients(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss; a pooled response passes its gradient to the window that gave it."""
        w = self.weights
        data, firsts, chunks = _padded(texts)
        windows, active = self.responses(data, texts, chunks)
        inside = firsts[:, None] // HOP + np.arange(CHUNK // HOP)
        np.minimum(inside, len(active) - 1, out=inside)
        seen = active[inside]  # chunk, place, filter
        place = seen.argmax(1)
        best = np.take_along_axis(seen, place[:, None], 1)[:, 0]
        owner = np.repeat(np.arange(len(texts)), chunks)
        mean = np.add.reduceat(best, np.concatenate([[0], np.cumsum(chunks)[:-1]]), axis=0) / chunks[:, None]
        hidden = np.tanh(mean @ w["dense"] + w["dense_bias"])
        p = 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_bias"][0], -30, 30)))
        d_logit = ((p - labels) * weight / len(texts)).astype(np.float32)
        d_hidden = d_logit[:, None] * w["out"] * (1 - hidden**2)
        d_best = (d_hidden @ w["dense"].T / chunks[:, None])[owner] * (best > 0)
        row, f = np.nonzero(d_best)
        g = d_best[row, f].astype(np.float32)
        at = inside[row, place[row, f]]
        d_filters = np.stack([g[f == k] @ windows[at[f == k]] for k in range(FILTERS)], 1)
        d_embed = np.zeros_like(w["embed"])
        back = (g[:, None] * w["filters"].T[f]).reshape(-1, WIDTH, EMBED)
        hit = data[at[:, None] * HOP + np.arange(WIDTH)]
        for e in range(EMBED):
            d_embed[:, e] = np.bincount(hit.ravel(), back[:, :, e].ravel(), 256)
        return {
            "embed": d_embed, "filters": d_filters, "bias": np.bincount(f, g, FILTERS), "dense": mean.T @ d_hidden,
            "dense_bias": d_hidden.sum(0), "out": hidden.T @ d_logit, "out_bias": d_logit.sum(keepdims=True),
        }

    def fit(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> ByteConvNet:
        """Adam; the weights are averaged over the steps of the last AVERAGED of the epochs. The same sample gives the same model."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros(v.shape) for k, v in self.weights.items()}
        second = {k: np.zeros(v.shape) for k, v in self.weights.items()}
        total = {k: np.zeros(v.shape) for k, v in self.weights.items()}
        step = summed = 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for rows in (order[i:j][k : k + DOCS_A_STEP] for i, j in slices([len(texts[x]) for x in order], STEP_BYTES) for k in range(0, j - i, DOCS_A_STEP)):
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for k, g in self.gradients([texts[x] for x in rows], labels[rows], weight[rows]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] -= (rate * move).astype(np.float32)
                if epoch >= epochs * (1 - AVERAGED):
                    summed += 1
                    for k, v in self.weights.items():
                        total[k] += v
        if summed:
            self.weights = {k: (v / summed).astype(np.float32) for k, v in total.items()}
        return self


def held_out(column: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves HELD_OUT modulo 4. A null id counts as learnable."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == HELD_OUT, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, n_bytes: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> ByteConvNet:
    """A model of labels.quality from a bounded sample, the same for the same tables.

    Of each label at most `rows` rows that aren't held out, those first by a hash of their id, as many as have n_bytes
    bytes of text together (a longer one stays out, and those behind it come in); each with its whole text. Null labels and ids are left out. With one label or none the
    model is a constant, the labels' smoothed share.
    """
    known = labels.select(F.col("doc_id").alias("_id"), "quality").filter(F.col("_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("_id"))
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(totals) < 2:
        return ByteConvNet(prior=(totals.get(1, 0) + 1) / (sum(totals.values()) + 2))
    mixed = F.xxhash64(F.col("_id").cast("string"))
    parts = [known.filter(F.col("quality") == q).select("_id", "quality", mixed.alias("_mix")).orderBy("_mix", "_id").limit(rows) for q in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * rows rows at most
    body = F.encode(F.coalesce(text_col, F.lit("")), "utf-8")
    size = F.octet_length("body")
    upto = Window.partitionBy("quality").orderBy("_mix", "_id", "body")  # of 2 * rows rows, unless ids repeat
    sample = (
        docs.select(F.col(id_col).alias("_doc"), F.col(text_col))
        .join(chosen, F.col("_doc") == F.col("_id"))
        .select("_mix", "_id", "quality", body.alias("body"))
        .filter(size <= n_bytes // 8)
        .withColumn("_sum", F.sum(size.cast("long")).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("_sum") <= n_bytes)
        .drop("_sum")
        .orderBy("_mix", "_id", "body")
        .limit(2 * rows)
        .collect()
    )
    if len({r["quality"] for r in sample}) < 2:
        return ByteConvNet(prior=(totals.get(1, 0) + 1) / (sum(totals.values()) + 2))
    texts, y = [bytes(r["body"]) for r in sample], np.array([r["quality"] for r in sample])
    share = {q: len(y) / max(1, (y == q).sum()) * totals[q] / sum(totals.values()) for q in (0, 1)}  # as frequent as among all labels
    weight = np.array([share[q] for q in y.tolist()])
    # a short piece of each text, as few whole texts are short; those of bad texts are longer, as the fault must be in them
    r = np.random.default_rng(rows)
    sizes = np.exp(r.uniform(np.log(np.where(y == 1, 8, 200)), np.log(np.where(y == 1, 400, 800)))).astype(int)
    pieces = [t[(a := int(r.integers(0, max(1, len(t) - n)))) : a + n] for t, n in zip(texts, sizes.tolist())]
    return ByteConvNet.fresh().fit(texts + pieces, np.concatenate([y, y]), np.concatenate([weight, weight]))


def score_quality(docs: DataFrame, model: ByteConvNet, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold): each whole text.

    Null text: scored as empty. One row per row, repeated and null ids included; no other column is read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 1, 4 << 20):
            score = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(text_col, F.lit("")), "utf-8").alias("body"))
    scored = texts.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: ByteConvNet, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows the model rejects; all columns stay."""

    at = docs.schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_pieces(batches, at, 4 << 20):
            texts = [(t or "").encode("utf-8") for t in part.column(at).to_pylist()]
            yield part.filter(pa.array(model.score(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
