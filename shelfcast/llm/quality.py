"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text is described by how often each three-character shape occurs in it (case, digits and punctuation
stand out, letters of any alphabet look alike), weighted by TF-IDF, and by how much of it repeats
itself. The shapes of labelled texts span a latent space; every document is compared with every labelled
vector by blocked cosine products, and the labels of its nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.words import counted, mixed, shingle_hashes, sliced, word_hashes

SHAPES = 1024
LATENT = 32
REPEAT_WEIGHT = 1.0  # of the repetition rates beside the latent components
LABELLED_PER_CLASS = 3000  # bound of the labelled sample, for each label
NEIGHBOURS = 21
SHARPNESS = 4  # votes are similarities to this power
BLOCK = 2048  # labelled vectors multiplied at once

# lower-case letters and bytes beyond ASCII, upper-case letters and digits are one kind each
_KIND = np.arange(256, dtype=np.uint64) + np.uint64(4)
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3


def described(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of shapes (texts x SHAPES) and rates of repetition (texts x 4): words equal to one of the
    three before, and three-word runs seen before in the text."""
    n = len(texts)
    raw = [t.encode("utf-8", "replace") for t in texts]
    gap = b"\0\0\0"
    kind = _KIND[np.frombuffer(gap + gap.join(raw) + gap, np.uint8)]
    first = 3 + np.cumsum([0, *(len(r) + 3 for r in raw[:-1])]) if n else np.zeros(0, np.int64)
    shape = mixed((kind[:-2] << np.uint64(20)) + (kind[1:-1] << np.uint64(10)) + kind[2:]) % np.uint64(SHAPES)
    owner = np.maximum(np.searchsorted(first - 2, np.arange(len(shape)), side="right") - 1, 0)
    blank = np.array([len(r) == 0 for r in raw], bool)
    shapes = np.bincount(owner * SHAPES + shape.astype(np.int64), minlength=n * SHAPES)[: n * SHAPES].reshape(n, SHAPES)
    shapes[blank] = 0
    who, words = word_hashes(texts)
    size = np.maximum(np.bincount(who, minlength=n), 1)
    rates = []
    for lag in (1, 2, 3):
        same = (words[lag:] == words[:-lag]) & (who[lag:] == who[:-lag])
        rates.append(np.bincount(who[lag:][same], minlength=n) / size)
    run_of, _, times = counted(*shingle_hashes(who, words, 3))
    runs = np.bincount(run_of, times, n)
    rates.append(1.0 - np.bincount(run_of, minlength=n) / np.maximum(runs, 1.0))
    rates[-1][runs == 0] = 0.0
    return shapes, np.column_stack(rates)


@dataclass
class Voter:
    """idf and axes lead to the latent space; vectors are the labelled texts there, of length 1."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def place(self, shapes: np.ndarray, rates: np.ndarray) -> np.ndarray:
        x = np.log1p(shapes) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        v = np.hstack([x @ self.axes, REPEAT_WEIGHT * rates])
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The weighted share of label 1 among the nearest labelled texts; 0 for empty texts, which are
        near to none, and 0.5 if there are no labelled texts."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        v, k = self.place(*described(texts)), min(NEIGHBOURS, len(self.labels))
        near, which = np.zeros((len(v), 0)), np.zeros((len(v), 0), np.int64)
        for at in range(0, len(self.vectors), BLOCK):
            cos = v @ self.vectors[at : at + BLOCK].T
            top = np.argpartition(-cos, min(k, cos.shape[1]) - 1, axis=1)[:, :k]
            near = np.hstack([near, np.take_along_axis(cos, top, 1)])
            which = np.hstack([which, top + at])
        top = np.argsort(-near, axis=1, kind="stable")[:, :k]
        which = np.take_along_axis(which, top, 1)
        vote = np.maximum(np.take_along_axis(near, top, 1), 0.0) ** SHARPNESS * self.weights[which]
        return np.clip((vote * self.labels[which]).sum(1) / np.maximum(vote.sum(1), 1e-300), 0.0, 1.0)


def _document_counts(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many have each shape: SHAPES + 1 rows at most."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(SHAPES, np.int64)
        for frame in sliced(frames, text):
            n += len(frame)
            total += (described(frame[text].fillna("").tolist())[0] > 0).sum(0)
        yield pd.DataFrame({"shape": np.r_[-1, np.arange(SHAPES)], "n": np.r_[n, total]})

    rows = docs.select(text).mapInPandas(count, "shape int, n long").groupBy("shape").agg(F.sum("n").alias("n")).collect()
    found = {r["shape"]: r["n"] for r in rows}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(SHAPES)], np.float64)


def fit_voter(
    docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label",
    per_class: int = LABELLED_PER_CLASS,
) -> Voter:
    """A voter from the documents named in `labelled` (id, label 0 or 1; other and null labels are left
    out). At most `per_class` rows of each label serve, chosen by a hash of their id; their votes carry
    the weight of the rows they stand for. Document frequencies cover all of `docs`."""
    total, having = _document_counts(docs, text)
    idf = np.log((1.0 + total) / (1.0 + having))
    marks = labelled.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"), F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)).alias("_draw")
    )
    sizes = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("_y") == y, F.lit(min(1.0, per_class / n))).otherwise(share)
    drawn = marks.where(F.col("_draw") < share * F.lit(float(1 << 30)))

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sliced(frames, "_text"):
            shapes, rates = described(frame["_text"].tolist())
            both = np.hstack([np.log1p(shapes), rates]).astype(np.float32)
            yield pd.DataFrame({"y": frame["_y"].to_numpy(), "draw": frame["_draw"].to_numpy(), "x": [r.tobytes() for r in both]})

    # about 2 x per_class rows, so they fit in a broadcast
    chosen = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(drawn), "_id")
    sample = chosen.mapInPandas(describe, "y int, draw long, x binary").toPandas().sort_values(["draw", "y", "x"])
    both = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(len(sample), SHAPES + 4).astype(np.float64)
    y = sample["y"].to_numpy(np.float64)
    drawn_of = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weights = np.array([sizes.get(int(v), 0) / drawn_of[int(v)] for v in y])
    voter = Voter(idf, np.zeros((SHAPES, LATENT)), np.zeros((0, LATENT + 4)), y, weights)
    if len(y):
        x = both[:, :SHAPES] * idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        voter.axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :LATENT]
        voter.vectors = voter.place(np.expm1(both[:, :SHAPES]), both[:, SHAPES:])
    return voter


def with_quality(docs: DataFrame, voter: Voter, text: str = "text", score: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1; higher means label 1 is likelier. Null counts as empty, and empty
    texts score 0. A column of that name is replaced; an empty table gives an empty result. The labelled
    vectors are bounded by the sample and reach the workers as a broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(voter)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sliced(frames, text, 512):
            yield frame.assign(**{score: sent.value.scores(frame[text].fillna("").tolist())})

    keep = docs.select(*[c for c in docs.columns if c != score])
    return keep.mapInPandas(run, keep.select("*", F.lit(0.0).alias(score)).schema)


def scored_documents(docs: DataFrame, labels: DataFrame, text: str = "text", held_out: tuple[int, int] | None = (3, 1)) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, from the quality labels of documents that
    are not held out: those whose crc32(id as text) leaves another remainder than (modulus, remainder)."""
    rest = F.crc32(F.col("doc_id").cast("string")) % held_out[0] if held_out else F.lit(-1)
    out = F.coalesce(rest == (held_out[1] if held_out else 0), F.lit(False))
    seen = labels.where(~out).select("doc_id", F.col("quality").alias("label"))
    voter = fit_voter(docs, seen, text=text)
    marked = with_quality(docs.select("doc_id", text), voter, text)
    return marked.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score `least` or more, with the columns of `docs`; all labels serve."""
    voter = fit_voter(docs, labels.select("doc_id", F.col("quality").alias("label")), text=text)
    return with_quality(docs, voter, text, "_quality").where(F.col("_quality") >= least).select(*docs.columns)
