"""Language identification with a byte convolutional network, trained in numpy.

Windows of 256 bytes go through filters of widths 2, 3 and 4 over byte
embeddings, a maximum over the window, and a softmax.  The network is small and
is trained on the driver from a bounded sample of labelled windows.  To predict,
the filters are turned into tables over bytes and byte pairs, so that a filter's
value is a sum of two looked-up rows; a document's probabilities are the mean
over all its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table

#: Bytes of a window, embedding size, filter widths, and filters of each width.
LENGTH, DIM, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16

#: The sample to train on: labelled documents of a language, and windows of a document.
DOCS_PER_LANG, WINDOWS_PER_DOC = 1000, 3

#: Rounds over the sample, and steps of 64 windows to make at least: small samples take more rounds.
EPOCHS, LEAST_STEPS = 3, 600

#: Windows that are looked up at once.
BLOCK = 256


class ByteCNN:
    """Weights of the network for some languages; `fit` trains, `probabilities` predicts."""

    def __init__(self, langs: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), dtype=np.float32)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        e = self.embed[x]
        pooled, kept = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            n = x.shape[1] - w + 1
            cols = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
            z = cols.reshape(-1, w * DIM) @ f
            z = z.reshape(len(x), n, FILTERS)
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + b
            pooled.append(np.maximum(top, 0))
            kept.append((cols, at, top > 0))
        return np.concatenate(pooled, axis=1), kept

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, least_steps: int = LEAST_STEPS, batch: int = 64, rate: float = 0.004, seed: int = 0) -> ByteCNN:
        """Adam on the cross-entropy; the order of the windows is fixed by the seed."""
        rng = np.random.default_rng(seed)
        epochs = max(epochs, -(-least_steps // -(-len(x) // batch)))
        params = [self.embed, *self.filters, *self.bias, self.out, self.out_bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                rows = order[lo : lo + batch]
                xs, ys = x[rows], y[rows]
                h, kept = self._forward(xs)
                d = _softmax(h @ self.out + self.out_bias)
                d[np.arange(len(ys)), ys] -= 1
                d /= len(ys)
                dh = d @ self.out.T
                grads = [np.zeros_like(self.embed)]
                biases = []
                for k, (w, f, (cols, at, live)) in enumerate(zip(WIDTHS, self.filters, kept, strict=True)):
                    g = dh[:, k * FILTERS : (k + 1) * FILTERS] * live
                    picked = cols[np.arange(len(xs))[:, None], at]
                    grads.append(np.einsum("nfd,nf->df", picked, g))
                    biases.append(g.sum(axis=0))
                    back = g[:, :, None] * f.T[None]
                    for j in range(w):
                        np.add.at(grads[0], xs[np.arange(len(xs))[:, None], at + j], back[:, :, j * DIM : (j + 1) * DIM])
                grads += [*biases, h.T @ d, d.sum(axis=0)]
                t += 1
                for p, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> list[list[np.ndarray]]:
        """For each width the rows to add: a byte pair's, and the next pair's or byte's."""
        single = [[self.embed @ f[j * DIM : (j + 1) * DIM] for j in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        return [[pair(s[0], s[1])] + ([s[2]] if len(s) == 3 else [pair(s[2], s[3])] if len(s) == 4 else []) for s in single]

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Probabilities of each window of x (windows, LENGTH) over the languages."""
        out = []
        for lo in range(0, len(x), BLOCK):
            block = x[lo : lo + BLOCK]
            two = block[:, :-1].astype(np.int64) * 256 + block[:, 1:]
            pooled = []
            for w, rows, b in zip(WIDTHS, tables, self.bias, strict=True):
                n = LENGTH - w + 1
                z = rows[0][two[:, :n]]
                if w == 3:
                    z += rows[1][block[:, 2 : 2 + n]]
                elif w == 4:
                    z += rows[1][two[:, 2 : 2 + n]]
                pooled.append(np.maximum(z.max(axis=1) + b, 0))
            out.append(_softmax(np.concatenate(pooled, axis=1) @ self.out + self.out_bias))
        return np.concatenate(out)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows of whole texts (the last one padded with zeros): (windows, document, bytes)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    count = -(-lengths // LENGTH)
    padded = b"".join(t.ljust(int(n) * LENGTH, b"\0") for t, n in zip(texts, count, strict=True))
    doc = np.repeat(np.arange(len(texts)), count)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return np.frombuffer(padded, dtype=np.uint8).reshape(-1, LENGTH), doc, np.minimum(lengths[doc] - step * LENGTH, LENGTH)


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (null: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, seed: int = 0) -> ByteCNN | None:
    """Fits on a sample of the labelled rows of `docs`; None where there are none.

    The sample is bounded: about docs_per_lang documents of each
    language that has a label, chosen by a hash of the id, and WINDOWS_PER_DOC
    windows of each, spread over the text; a third of the windows are shortened,
    as short texts are, and an eighth are in capitals."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).count().collect()
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.2 * docs_per_lang / r["count"]))])
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)) / float(1 << 40)
    sample = labelled.where(part < F.try_element_at(share, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, got = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not _letters(text.decode(errors="ignore")):
                    continue
                last = max(0, len(text) - LENGTH)
                for k, at in enumerate(sorted({last * j // max(1, WINDOWS_PER_DOC - 1) for j in range(WINDOWS_PER_DOC)})):
                    lang.append(name)
                    piece = text[at : at + (LENGTH if k != 1 else 24 + len(text) % 72)]
                    got.append(piece if (at + len(text)) % 8 else piece.decode(errors="ignore").upper().encode())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(got, pa.binary())], names=["lang", "window"])

    rows = sample.mapInArrow(cut, "lang string, window binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["window"])))
    if not rows:
        return None
    x, _, _ = windows([bytes(r["window"]) for r in rows])
    place = {k: i for i, k in enumerate(langs)}
    return ByteCNN(langs, seed).fit(x, np.array([place[r["lang"]] for r in rows]), seed=seed)


def _letters(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the columns `keep` of docs (default: the id).

    One row for each row of `docs`, whole texts.  Null texts, texts without a
    letter, and all texts where there was nothing to learn from, are `und` with
    score 0.  Only the text decides; other columns are passed through, those of
    the new columns' names are replaced."""
    small_batches(docs.sparkSession)
    keep = [c for c in keep or [id_col] if c not in ("lang_pred", "score", "_whole_text")]
    picked = docs.select(*keep, F.col(text_col).cast("string").alias("_whole_text"))
    schema = picked.drop("_whole_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang = np.full(len(texts), "und", dtype=object)
            score = np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if t and _letters(t)] if model else []
            at = 0
            while at < len(rows):
                some, size = [], 0
                while at < len(rows) and (not some or size + len(texts[rows[at]]) <= 1_000_000):
                    some.append(rows[at])
                    size += len(texts[rows[at]])
                    at += 1
                x, doc, n = windows([texts[i].encode() for i in some])
                p = model.probabilities(x, tables) * n[:, None]
                total = np.zeros((len(some), p.shape[1]))
                np.add.at(total, doc, p)
                total /= total.sum(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                lang[some] = [model.langs[k] for k in best]
                score[some] = total[np.arange(len(some)), best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return picked.mapInArrow(run, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id")))
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
