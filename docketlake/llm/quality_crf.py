"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Emission features describe the line (length, words, word length,
shares of symbols, capitals, digits and distinct words, repetition) and its two neighbours; a
transition matrix ties adjacent lines. Forward-backward gives each line's probability of being
good, and a document's score is their mean weighted by line length.

Documents are labelled, lines are not, so every line of a training document carries the
document's label. The model is fitted by gradient ascent on the conditional likelihood over a
bounded sample (``learning.TRAIN_ROWS`` per class, texts whole). Scores use the text alone.

Null and empty texts are one empty line. With no labelled row, or one class only, every score
is the share of good rows (0.5 if none).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from docketlake.llm.learning import held_out, scored, training_sample

EPOCHS, BATCH, RATE = 12, 64, 0.05
OWN, SHARED = 11, 4
FEATURES = OWN + 2 * SHARED + 2
#: Lines whose chains are worked on together.
LINES = 1 << 13
_SYMBOL, _UPPER, _DIGIT = re.compile(r"[^\w\s.,;:'’?-]"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]")


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, characters per line plus one)."""
    rows, sizes, before, seen = [], [], None, set()
    for line in text.split("\n"):
        words, n = line.split(), len(line)
        count = len(words)
        size, some = max(n, 1), max(count, 1)
        kinds = len(set(words))
        rows.append((1.0, min(np.log1p(n) / 6, 2.0) if n else 0.0, min(count / 40, 2.0), min(n / some / 10, 3.0), len(_SYMBOL.findall(line)) / some,
                     len(_UPPER.findall(line)) / size, len(_DIGIT.findall(line)) / size, 1 - kinds / some if count else 0.0,
                     float(line == before), float(line in seen and n > 0), float(count == 0)))
        sizes.append(n + 1)
        seen.add(line)
        before = line
    own = np.array(rows)
    around = own[:, 4:4 + SHARED]
    edge = np.zeros((1, SHARED))
    first, last = np.zeros((len(own), 1)), np.zeros((len(own), 1))
    first[0], last[-1] = 1, 1
    return np.hstack([own, np.vstack([edge, around[:-1]]), np.vstack([around[1:], edge]), first, last]), np.array(sizes, float)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(a, axis=axis)


class LineChain:
    """States: 0 bad, 1 good."""

    def __init__(self):
        self.emit, self.move, self.constant = np.zeros((FEATURES, 2)), np.zeros((2, 2)), None

    def _marginals(self, chains: list[np.ndarray], pairs: bool = False):
        """Padded log-space forward-backward over several chains: P(state) per line, and expected moves."""
        longest, n = max(len(c) for c in chains), len(chains)
        lengths = np.array([len(c) for c in chains])
        e = np.zeros((longest, n, 2))
        for k, c in enumerate(chains):
            e[:len(c), k] = c @ self.emit
        forth, back = np.zeros_like(e), np.zeros_like(e)
        forth[0] = e[0]
        for t in range(1, longest):
            forth[t] = e[t] + _lse(forth[t - 1][:, :, None] + self.move, 1)
        for t in range(longest - 2, -1, -1):
            live = (t + 1 < lengths)[:, None]
            back[t] = np.where(live, _lse(self.move + (e[t + 1] + back[t + 1])[:, None, :], 2), 0.0)
        total = forth + back
        single = np.exp(total - _lse(total, 2)[:, :, None])
        if not pairs:
            return single, lengths, None
        live = np.arange(1, longest)[:, None] < lengths
        joint = forth[:-1, :, :, None] + self.move + (e[1:] + back[1:])[:, :, None, :]
        joint -= _lse(_lse(joint, 3), 2)[:, :, None, None]
        return single, lengths, (np.exp(joint) * live[:, :, None, None]).sum(axis=(0, 1)) if longest > 1 else np.zeros((2, 2))

    def fit(self, sample: list[tuple[str, int]], seed: int = 0) -> "LineChain":
        labels = np.array([y for _, y in sample])
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        chains = [line_features(t)[0] for t, _ in sample]
        r, state = np.random.default_rng(seed), {}
        for _ in range(EPOCHS):
            # Chains of like length share a batch, the batches come in random order.
            order = np.argsort([len(c) for c in chains], kind="stable")
            starts = np.arange(0, len(order), BATCH)
            for at in r.permutation(starts):
                rows = order[at:at + BATCH]
                some = [chains[i] for i in rows]
                single, lengths, moves = self._marginals(some, True)
                lines = lengths.sum()
                emit, move = np.zeros_like(self.emit), -moves
                for k, i in enumerate(rows):
                    target = np.zeros((lengths[k], 2))
                    target[:, labels[i]] = 1
                    emit += some[k].T @ (target - single[:lengths[k], k])
                    move[labels[i], labels[i]] += lengths[k] - 1
                for name, value, grad in (("emit", self.emit, emit / lines - 1e-3 * self.emit), ("move", self.move, move / lines - 1e-2 * self.move)):
                    m, v, t = state.setdefault(name, (np.zeros_like(grad), np.zeros_like(grad), 0))
                    m, v, t = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad, t + 1
                    state[name] = (m, v, t)
                    value += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return self

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, order = np.zeros(len(texts)), sorted(range(len(texts)), key=lambda i: texts[i].count("\n"))
        at = 0
        while at < len(order):
            # Texts of like line counts together, as many as keep the padded block small.
            n = 1
            while at + n < len(order) and (n + 1) * (texts[order[at + n]].count("\n") + 1) <= LINES:
                n += 1
            some = [line_features(texts[i]) for i in order[at:at + n]]
            single, lengths, _ = self._marginals([f for f, _ in some])
            for k, i in enumerate(order[at:at + n]):
                out[i] = np.average(single[:lengths[k], k, 1], weights=some[k][1])
            at += n
        return np.clip(out, 0.0, 1.0)


def op6_quality_crf(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = LineChain().fit(training_sample(docs, labels, "quality"))
    scores = scored(docs, model, ["doc_id"])
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
