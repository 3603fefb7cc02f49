"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into its leaf blocks (see ``html_blocks``). Each has features from the names
and class words of all its ancestors, from its nearest element, and from its text: length,
share of linked characters, ending, typical phrases. A two-state chain, article or not, with
weights for features and for transitions is trained by stochastic gradient ascent of the
likelihood (forward-backward) on labelled pages, and a page is labelled by Viterbi's
algorithm. The training pages are ``PAGES`` generated ones (see ``html_samples``), or any
others given as (label, html) parts.

Defined results: a null or empty page, and one without article blocks, has the empty text.
White space is what ``str.split`` takes for it. Rows are handled one by one, so repeated
rows have equal results; a null page_id is kept. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import html_blocks, html_samples, kernels

PAGES = 1200
EPOCHS = 5
RATE = 0.25
DECAY = 2e-4
SEED = 11

#: Phrases that boilerplate often has, in lower case.
PHRASES = ("cookie", "subscribe", "newsletter", "sign in", "log in", "copyright", "©", "all rights reserved", "privacy", "share this", "leave a reply", "advertisement", "sponsored", "read more", "related")

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int"


def text_features(block: html_blocks.Block, text: str) -> list[str]:
    """Features of a block's own text."""
    words = text.count(" ") + 1
    share = block.linked / max(1, len(text))
    out = [f"words={min(7, words.bit_length())}", f"linked={min(4, int(share * 4.01))}", "ends" if text[-1] in ".!?:\"”»" else "open"]
    if words < 40:
        low = text.lower()
        out.extend(f"says={p}" for p in PHRASES if p in low)
    return out


class Chain:
    """Weights of a trained chain: features and transitions towards the state article."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves, start

    def weigh(self, sign: str) -> float:
        return self.weights.get(sign, 0.0)

    def emission(self, block: html_blocks.Block, text: str) -> float:
        return block.weight + self.weigh("always") + sum(map(self.weigh, text_features(block, text)))

    def decode(self, emissions: list[float]) -> list[int]:
        """The likeliest states by Viterbi's algorithm."""
        if not emissions:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        s0, s1 = float(self.start[0]), float(self.start[1]) + emissions[0]
        back = []
        for e in emissions[1:]:
            from0, from1 = (0 if s0 + m00 >= s1 + m10 else 1), (0 if s0 + m01 >= s1 + m11 else 1)
            back.append((from0, from1))
            s0, s1 = max(s0 + m00, s1 + m10), max(s0 + m01, s1 + m11) + e
        states = [int(s1 > s0)]
        for step in reversed(back):
            states.append(step[states[-1]])
        return states[::-1]

    def extract(self, page: str) -> tuple[str, int]:
        """The main text and how many blocks it has."""
        found = [(b, t) for b in html_blocks.blocks(page, self.weigh) if (t := b.text())]
        states = self.decode([self.emission(b, t) for b, t in found])
        kept = [t for (_, t), s in zip(found, states, strict=True) if s]
        return " ".join(kept), len(kept)


def labelled(parts: list[tuple[int, str]]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of the blocks of a page that is given in labelled parts."""
    marked = "".join(x if label < 0 else f"{_mark(x, label)}" for label, x in parts)
    features, labels = [], []
    for block in html_blocks.blocks(marked):
        text = block.text()
        label = int("\ue001" in text)
        text = " ".join(text.replace("\ue001", "").replace("\ue000", "").split())
        if text:
            features.append(["always", *block.path, *text_features(block, text)])
            labels.append(label)
    return features, labels


def _mark(part: str, label: int) -> str:
    """The part with a sign of its label at the start of each piece of text."""
    sign = "\ue001" if label else "\ue000"
    out, at = [], 0
    for tag in html_blocks.tags(part):
        piece = part[at : tag.start]
        out.append((sign + piece if piece.strip() else piece) + part[tag.start : tag.end])
        at = tag.end
    rest = part[at:]
    return "".join(out) + (sign + rest if rest.strip() else rest)


def train(pages: list[tuple[list[list[str]], list[int]]], seed: int = SEED) -> Chain:
    """Fit by stochastic gradient ascent of the log-likelihood, page by page."""
    number: dict[str, int] = {}
    data = [([np.array([number.setdefault(f, len(number)) for f in dict.fromkeys(fs)]) for fs in features], labels) for features, labels in pages if labels]
    weights, moves, start = np.zeros(len(number)), np.zeros((2, 2)), np.zeros(2)
    rng = np.random.default_rng(seed)
    steps, done = max(1, EPOCHS * len(data)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            rate = RATE * (1 - 0.9 * done / steps)
            done += 1
            features, labels = data[k]
            n = len(labels)
            emission = [float(weights[f].sum()) for f in features]
            forward = [(start[0], start[1] + emission[0])]
            for e in emission[1:]:
                a, b = forward[-1]
                forward.append((_log_add(a + moves[0, 0], b + moves[1, 0]), _log_add(a + moves[0, 1], b + moves[1, 1]) + e))
            backward = [(0.0, 0.0)]
            for e in reversed(emission[1:]):
                a, b = backward[-1]
                backward.append((_log_add(moves[0, 0] + a, moves[0, 1] + e + b), _log_add(moves[1, 0] + a, moves[1, 1] + e + b)))
            backward.reverse()
            total = _log_add(*forward[-1])
            weights *= 1 - rate * DECAY
            for i, f in enumerate(features):
                weights[f] += rate * (labels[i] - math.exp(min(0.0, forward[i][1] + backward[i][1] - total)))
            for s in (0, 1):
                start[s] += 0.1 * rate * ((labels[0] == s) - math.exp(min(0.0, forward[0][s] + backward[0][s] - total)))
            gradient = np.zeros((2, 2))
            for i in range(1, n):
                gradient[labels[i - 1], labels[i]] += 1
                for s in (0, 1):
                    for t in (0, 1):
                        gradient[s, t] -= math.exp(min(0.0, forward[i - 1][s] + moves[s, t] + (emission[i] if t else 0.0) + backward[i][t] - total))
            moves += 0.1 * rate * gradient
    return Chain({f: float(weights[i]) for f, i in number.items()}, moves, start)


def _log_add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


@functools.lru_cache(maxsize=2)
def default_chain(pages: int = PAGES, seed: int = SEED) -> Chain:
    """The chain trained on generated pages."""
    maker = html_samples.Pages(seed)
    return train([labelled(maker.page()) for _ in range(pages)], seed)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """The main text of every page."""
    chain = chain or default_chain()
    shared_chain = pages.sparkSession.sparkContext.broadcast((chain.weights, chain.moves, chain.start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(*shared_chain.value)
        for block in kernels.blocks(batches, "html"):
            made = [own.extract(h) if h else ("", 0) for h in block.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([t for t, _ in made], pa.string()), pa.array([len(t) for t, _ in made], pa.int64()), pa.array([n for _, n in made], pa.int32())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)
