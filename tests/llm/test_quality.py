"""Context sums and pooled vectors against plain versions."""

import math

import numpy as np
import pyarrow as pa

from vernissage.llm import quality

SETTINGS = quality.Settings(vocabulary=64, width=8, nonzeros=3, reach=2)
TEXTS = ["a b a c, d", "", None, "one", "same same same same", " ".join(f"w{i % 13}" for i in range(400)), "ä ö — x2 (y)"]


def tokens_of_texts():
    token, first = quality._tokens(pa.array(TEXTS, pa.string()), SETTINGS)
    return [token[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


def test_context_sums():
    places, signs = quality.index_vectors(SETTINGS)
    want = np.zeros((SETTINGS.vocabulary, SETTINGS.width))
    for tokens in tokens_of_texts():
        for i, word in enumerate(tokens):
            for j, other in enumerate(tokens):
                if 0 < abs(i - j) <= SETTINGS.reach:
                    for p, s in zip(places[other], signs[other]):
                        want[word, p] += s
    assert np.array_equal(quality.context_sums(pa.array(TEXTS, pa.string()), SETTINGS), want)


def test_pooled_vectors():
    vectors = np.random.default_rng(3).normal(size=(SETTINGS.vocabulary, SETTINGS.width)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    got = quality.pooled(pa.array(TEXTS, pa.string()), vectors, SETTINGS)
    for row, tokens in zip(got, tokens_of_texts(), strict=True):
        own = [vectors[t].astype(float) for t in tokens]
        mean = sum(own) / len(own) if own else np.zeros(SETTINGS.width)
        square = sum(v * v for v in own) / len(own) if own else np.zeros(SETTINGS.width)
        alike = [float(a @ b) for a, b in zip(own, own[1:])]
        pairs = max(len(alike), 1)
        more = [sum(alike) / pairs, sum(x > 0.999 for x in alike) / pairs, np.linalg.norm(mean), math.log1p(len(tokens))]
        assert np.allclose(row, [*mean, *square, *more], atol=1e-4)
