"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's terms are the trigrams of its character classes, over the whole text, and marks of how it repeats
itself. Counts are damped, weighed by inverse document frequency and projected on the leading singular vectors of a
bounded sample of labelled texts (latent semantic analysis). The sample's vectors and labels, whose size is a
parameter, are broadcast; every document takes exact cosine products with all of them, in blocks, and its nearest
neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that the model holds; it needs no more for its accuracy, and that bounds what is broadcast.
SAMPLE = 6_000
DIMENSIONS, NEIGHBOURS = 48, 15
THRESHOLD = 0.3
#: Rows whose terms are spelt out together.
BLOCK = 512
#: Classes: 0 other controls, 1 space, 2 line end, 3 lower, 4 upper, 5 digit, 6 sentence end, 7 pause, 8 exclamation,
#: 9 dollar, hash, percent, ampersand, star, 10 bar, 11 brackets and quotes, 12 dashes and underscores, 13 markup and code, 14 beyond ASCII.
CLASSES = 16
REPEATS = 12
TERMS = CLASSES**3 + 2 * REPEATS


def _class_table() -> np.ndarray:
    t = np.zeros(256, np.uint16)
    for k, chars in ((1, " \t\x0b\x0c"), (2, "\n\r"), (6, ".?"), (7, ",;:"), (8, "!"), (9, "$#%&*"), (10, "|"), (11, "()[]{}\"'`"), (12, "-_~"), (13, "<>=/\\+^@")):
        for c in chars:
            t[ord(c)] = k
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 3, 4, 5
    t[128:] = 14
    return t


_TABLE = _class_table()


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(terms, counts) of a whole text; both empty for null and empty ones."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(0, np.int64), np.zeros(0)
    c = _TABLE[np.frombuffer(data, np.uint8)]
    c = np.concatenate(([2, 2], c, [2]))
    n = np.bincount(c[:-2] * 256 + c[1:-1] * 16 + c[2:], minlength=CLASSES**3)
    terms = np.flatnonzero(n)
    found, weights = terms, n[terms].astype(float)
    words = data.split()
    if words:
        # share of words like the one before, and of words seen before, as one mark each, as heavy as the text is long
        again = sum(map(bytes.__eq__, words[:-1], words[1:])) / len(words)
        seen = 1 - len(set(words)) / len(words)
        marks = [CLASSES**3 + round(again * (REPEATS - 1)), CLASSES**3 + REPEATS + round(seen * (REPEATS - 1))]
        found, weights = np.concatenate((found, marks)), np.concatenate((weights, np.full(2, len(data) / 4)))
    return found, weights


@dataclass
class Model:
    """What is broadcast: idf (terms), axes (terms x dimensions), vectors (labelled rows x dimensions) of unit length, labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x = weighed(rows, self.idf) @ self.axes
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Share of label 1 among the nearest labelled rows, weighed by cosine; the prior where no neighbour is similar."""
        x = self.project(rows)
        if not len(self.labels) or not len(rows):
            return np.full(len(rows), self.prior)
        k = min(self.neighbours, len(self.labels))
        out = np.empty(len(x))
        for at in range(0, len(x), 256):
            s = x[at : at + 256] @ self.vectors.T
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(s, near, 1), 0).astype(float) ** 8
            total = w.sum(axis=1)
            out[at : at + 256] = np.where(total > 0, (w * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def weighed(rows, idf: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, (terms, n) in enumerate(rows):
        if len(terms):
            x[i, terms] = np.sqrt(n / n.sum()) * idf[terms]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS, seed: int = 3) -> Model:
    """The model of labelled rows, by a randomised singular value decomposition that has a block of rows spelt out at a time."""
    df = np.zeros(TERMS)
    for terms, _ in rows:
        df[terms] += 1
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    empty = Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels[:0], float(labels.mean()) if len(labels) else 0.5, neighbours)
    if not len(rows):
        return empty
    blocks = lambda: (weighed(rows[at : at + BLOCK], idf) for at in range(0, len(rows), BLOCK))
    q = np.random.default_rng(seed).standard_normal((TERMS, min(dimensions + 16, len(rows)))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(sum(x.T @ (x @ q) for x in blocks()))
    _, _, vt = np.linalg.svd(np.concatenate([x @ q for x in blocks()]), full_matrices=False)
    axes = (q @ vt.T)[:, :dimensions].astype(np.float32)
    v = np.concatenate([x @ axes for x in blocks()])
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return Model(idf, axes, v / np.where(norm > 0, norm, 1), labels.astype(float), empty.prior, neighbours)


def held_out(id_) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(5)) == 0, F.lit(False))


def _count_batches(batches):
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("terms", pa.binary()), ("n", pa.binary())])
    for b in batches:
        got = [counts(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([t.astype("<i4").tobytes() for t, _ in got], pa.binary()), pa.array([n.astype("<f4").tobytes() for _, n in got], pa.binary())], schema=schema)


def _score_batches(model):
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            scores = []
            for at in range(0, b.num_rows, BLOCK):
                scores.append(model.value.score([counts(t.as_py()) for t in b.column("text")[at : at + BLOCK]]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.concatenate(scores) if scores else np.zeros(0))], schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` labelled rows that are not held out, chosen by a hash of their id.

    Only their ids are broadcast and only their counts come to the driver, so documents are not shuffled. Rows without id
    or label, and labels without document, are left out.
    """
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    own = own.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(sample)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = text.join(F.broadcast(chosen), "id")
    # of the texts of one id, that with the smallest hash
    found = found.groupBy("id").agg(F.min(F.struct(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "label", "text")).alias("x")).select("id", "x.label", "x.text")
    rows = found.mapInArrow(_count_batches, "id long, label int, terms binary, n binary").toArrow().sort_by("id")
    parts = [[np.frombuffer(x.as_buffer(), kind) for x in rows.column(c)] for c, kind in (("terms", "<i4"), ("n", "<f4"))]
    return fit(list(zip(*parts, strict=True)), np.asarray(rows.column("label").combine_chunks()).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, score, predicted.

    A score depends on the text alone; null counts as empty. Without labels every score is 0.5. Ids that are null are not
    held out. Repeated rows are scored each; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, sample))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = slim.mapInArrow(_score_batches(model), "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those that the classifier rejects, all columns as they were, scored where they are read."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, sample))
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                good = model.value.score([counts(t.as_py()) for t in part.column(at)]) >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, schema)
