"""Toxicity by a convolutional text classifier, trained in numpy.

Words (lower-cased runs of letters and digits) are embedded as the sum of hashed rows, one of
the word and one of each of its beginnings, so that forms of a word are alike; filters of
several widths slide over them, each keeps its largest response anywhere in the text (max
pooling), and a logistic layer turns those into a score. Buckets that no training word fell in
are zero, so unknown words say nothing. Whole texts are scored, in pieces that overlap by the
widest filter; the pieces' maxima are the text's.

The network is fitted on a bounded sample of labelled texts (``TRAIN_ROWS`` per class, texts
whole). Thresholds are calibrated per language on all labelled rows that are not held out:
the cut on a grid of hundredths with the best F1. Language is no input of a score.

Null and empty texts get the score of no words. Repeated rows are scored alike. With no
labelled row, or one class only, every score is the share of that class (0.5 if none).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import stage, with_small
from docketlake.llm.learning import calibrating, held_out, scored, training_sample

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 12, 10, (1, 2, 3)
#: Lengths of the word beginnings that are embedded besides the word.
PREFIXES = (3, 4, 5, 6, 7)
EPOCHS, BATCH, RATE, PIECE = 8, 32, 0.02, 1 << 14
#: Training texts that a word must occur in to have an embedding.
MIN_TEXTS = 20
#: Words whose vectors a task holds, about, before it starts afresh.
MOST_WORDS = 200_000
#: The cut of languages with fewer than FEWEST toxic rows to calibrate on.
CUT, FEWEST = 0.7, 20
_WORD = re.compile(r"[^\W_]+")


def buckets(word: str) -> list[int]:
    """Hash buckets (from 1) of a word and of its beginnings; 0 is nothing."""
    parts = [word] + ["^" + word[:k] for k in PREFIXES if len(word) >= k]
    found = [1 + zlib.crc32(p.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for p in parts]
    return found + [0] * (1 + len(PREFIXES) - len(found))


class Vocabulary(dict):
    """Word to place, in order of appearance; place 0 is padding."""

    def __init__(self):
        super().__init__()
        self.rows = [[0] * (1 + len(PREFIXES))]

    def __missing__(self, word):
        self.rows.append(buckets(word))
        self[word] = place = len(self.rows) - 1
        return place

    def places(self, text: str) -> np.ndarray:
        found = _WORD.findall(text.lower())
        return np.fromiter((self[w] for w in found), np.int32, len(found))


class ConvNet:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.vectors = None
        self.conv = {w: r.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out, self.shift, self.constant = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0, None

    def _responses(self, ids: np.ndarray, w: int) -> np.ndarray:
        x, n = self.vectors[ids], len(ids) - w + 1
        return sum(x[j:n + j] @ self.conv[w][j] for j in range(w))

    @staticmethod
    def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Texts one after another with widest - 1 zeros behind each (one word at least), and their starts."""
        pad = np.zeros(max(WIDTHS) - 1, np.int32)
        parts = [np.concatenate([t if len(t) else pad[:1], pad]) for t in texts]
        return np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])[:-1]

    def _pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        flat, starts = self._padded(texts)
        return np.concatenate([np.maximum.reduceat(self._responses(flat, w), starts) for w in WIDTHS], axis=1)

    def _sigmoid(self, pooled: np.ndarray) -> np.ndarray:
        bias = np.concatenate([self.bias[w] for w in WIDTHS])
        return 1 / (1 + np.exp(-np.clip(np.maximum(pooled + bias, 0) @ self.out + self.shift, -30, 30)))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        best = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        step, vocabulary, held, owners, size = PIECE - max(WIDTHS), Vocabulary(), [], [], 0
        self.vectors, known = np.zeros((0, DIM), np.float32), 0

        def pool():
            # Only words that are new since the last piece are composed from their buckets.
            nonlocal known
            new = self.embed[np.array(vocabulary.rows[known:], np.int64).reshape(-1, 1 + len(PREFIXES))].sum(axis=1)
            if known + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors[:known], new, np.zeros((len(self.vectors) + len(new), DIM), np.float32)])
            self.vectors[known:known + len(new)] = new
            known += len(new)
            np.maximum.at(best, owners, self._pooled(held))

        for row, text in enumerate(texts):
            words = vocabulary.places(text)
            for at in range(0, max(len(words), 1), step):
                held.append(words[at:at + PIECE])
                owners.append(row)
                size += len(held[-1])
            if size >= PIECE:
                pool()
                held, owners, size = [], [], 0
                if known > MOST_WORDS:
                    vocabulary, known = Vocabulary(), 0
        if held:
            pool()
        return self._sigmoid(best).astype(float)

    def fit(self, sample: list[tuple[str, int]], seed: int = 0) -> "ConvNet":
        y = np.array([l for _, l in sample], np.float32)
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        vocabulary = Vocabulary()
        texts = [vocabulary.places(t) for t, _ in sample]
        rows = np.array(vocabulary.rows)
        # Buckets of few training texts say nothing: a net could learn such texts by heart.
        texts_of = np.bincount(np.concatenate([np.unique(rows[np.unique(t)]) for t in texts]), minlength=BUCKETS)
        known = texts_of >= MIN_TEXTS
        known[0] = False
        self.embed[~known] = 0
        rows = np.where(known[rows], rows, 0)
        r, state = np.random.default_rng(seed), {}
        squares = np.full(BUCKETS, 1e-6, np.float32)
        for epoch in range(EPOCHS):
            order = r.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                some = order[at:at + BATCH]
                self._step([texts[i] for i in some], y[some], rows, state, squares)
        self.embed[0] = 0
        return self

    def _adam(self, state: dict, name, value, grad) -> None:
        m, v, t = state.setdefault(name, (np.zeros_like(grad), np.zeros_like(grad), 0))
        m, v, t = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad, t + 1
        state[name] = (m, v, t)
        value -= 0.3 * RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)

    def _step(self, texts, y, rows, state, squares) -> None:
        flat, starts = self._padded(texts)
        used, flat = np.unique(np.concatenate([[0], flat]), return_inverse=True)
        flat, buckets_of = flat[1:], rows[used]
        self.vectors = self.embed[buckets_of].sum(axis=1)
        ends = [*starts[1:], len(flat)]
        pooled, places = [], []
        for w in WIDTHS:
            response = self._responses(flat, w)
            where = np.stack([s + np.argmax(response[s:min(e, len(response))], axis=0) for s, e in zip(starts, ends)])
            places.append(where)
            pooled.append(np.take_along_axis(response, where, axis=0))
        pooled = np.concatenate(pooled, axis=1)
        bias = np.concatenate([self.bias[w] for w in WIDTHS])
        hidden = np.maximum(pooled + bias, 0)
        error = (self._sigmoid(pooled) - y) / len(y)
        back = (error[:, None] * self.out) * (hidden > 0)
        embed_rows, embed_grads = [], []
        for k, w in enumerate(WIDTHS):
            own = back[:, k * FILTERS:(k + 1) * FILTERS].astype(np.float32)
            grad = np.zeros_like(self.conv[w])
            for j in range(w):
                ids = flat[places[k] + j]
                grad[j] = np.einsum("nfd,nf->df", self.vectors[ids], own)
                each = (own[:, :, None] * self.conv[w][j].T[None]).reshape(-1, DIM)
                embed_rows.append(buckets_of[ids.ravel()].ravel())
                embed_grads.append(np.repeat(each, 1 + len(PREFIXES), axis=0))
            self._adam(state, ("conv", w), self.conv[w], grad)
            self._adam(state, ("bias", w), self.bias[w], own.sum(axis=0))
        self._adam(state, "out", self.out, hidden.T @ error + 1e-4 * self.out)
        self.shift -= RATE * float(error.sum())
        changed, inverse = np.unique(np.concatenate(embed_rows), return_inverse=True)
        grads = np.zeros((len(changed), DIM), np.float32)
        np.add.at(grads, inverse, np.concatenate(embed_grads))
        squares[changed] += (grads * grads).mean(axis=1)
        self.embed[changed] -= 5 * RATE * grads / np.sqrt(squares[changed])[:, None]
        self.embed[0] = 0


def language_cuts(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (lang, cut) per language with labelled rows: the best F1 on a grid of hundredths."""
    known = labels.select(F.col("doc_id").alias("id_of"), "toxic").filter(F.col("toxic").isin(0, 1) & calibrating(F.col("id_of")))
    seen = scores.join(known, scores["doc_id"] == known["id_of"]).withColumn("step", F.least(F.floor(F.col("score") * 100), F.lit(99)).cast("int"))
    counts = seen.groupBy("lang", "step").agg(F.sum("toxic").alias("yes"), F.count("*").alias("n"))
    per = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("step", "yes", "n")), asc=False).alias("s"), F.sum("yes").alias("all"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("hit"), zero.alias("taken"), F.lit(-1.0).alias("f1"), F.lit(CUT).alias("cut"))

    def add(a, b):
        hit, taken = a["hit"] + b["yes"], a["taken"] + b["n"]
        f1 = 2.0 * hit / (taken + F.col("all"))
        return F.struct(hit.alias("hit"), taken.alias("taken"), F.greatest(a["f1"], f1).alias("f1"), F.when(f1 > a["f1"], b["step"] / 100).otherwise(a["cut"]).alias("cut"))

    return per.select("lang", F.when(F.col("all") >= FEWEST, F.aggregate("s", start, add)["cut"]).otherwise(F.lit(CUT)).alias("cut"))


def op8_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ConvNet().fit(training_sample(docs, labels, "toxic"))
    scores = stage(scored(docs, model, ["doc_id", "lang"]), "toxicity")
    cuts = stage(language_cuts(scores, labels), "toxicity-cuts")
    judged = with_small(scores, cuts, cuts.count(), ["lang"])
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"),
                         (F.col("score") >= F.coalesce("cut", F.lit(CUT))).cast("int").alias("flagged"))
