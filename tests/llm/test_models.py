"""The classifier's forward pass by its definition, and planted credentials that no base pattern takes."""

import math
import random

import numpy as np
import pytest

from lodestone.llm import quality_classifier as q
from lodestone.llm import secret_scan


def slow_score(network, data):
    """One document's score, a byte, filter and block at a time."""
    p = {k: v.astype(float).tolist() for k, v in network.p.items()}
    n_blocks = max(1, -(-len(data) // q.BLOCK))
    codes = [*data, *[q._PAD] * (n_blocks * q.BLOCK + q.WIDTH - q.STRIDE - len(data))]
    tops = []
    for block in range(n_blocks):
        best = [-math.inf] * q.FILTERS
        for at in range(block * q.BLOCK, (block + 1) * q.BLOCK, q.STRIDE):
            x = [v for c in codes[at : at + q.WIDTH] for v in p["embed"][c]]
            for f in range(q.FILTERS):
                best[f] = max(best[f], sum(a * row[f] for a, row in zip(x, p["filters"], strict=True)))
        tops.append([max(0.0, b + s) for b, s in zip(best, p["shift"], strict=True)])
    # a chunk is two blocks, and every block but the ends is in two chunks
    chunks = [[max(a, b) for a, b in zip(x, y, strict=True)] for x, y in zip(tops, tops[1:], strict=False)] or tops
    columns = list(zip(*chunks, strict=True))
    pooled = [max(c) for c in columns] + [sum(c) / len(c) for c in columns] + [min(c) for c in columns]
    hidden = [math.tanh(sum(x * row[h] for x, row in zip(pooled, p["hidden"], strict=True)) + p["hidden_shift"][h]) for h in range(q.HIDDEN)]
    logit = sum(h * w for h, w in zip(hidden, p["out"], strict=True)) + p["out_shift"][0]
    return 1 / (1 + math.exp(-logit))


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 700, 1500])
def test_forward_pass(size):
    rng = np.random.default_rng(size)
    network = q.Network(seed=size + 1)
    for k in ("shift", "hidden_shift", "out_shift"):
        network.p[k] += rng.standard_normal(network.p[k].shape).astype(np.float32)
    data = rng.integers(0, 256, size, dtype=np.uint8).tobytes()
    assert network.score(data) == pytest.approx(slow_score(network, data), abs=1e-4)


def test_planted_credentials():
    """Values in credential context that no base pattern takes: random ones are found, words and dates are let be."""
    with open(secret_scan.VOCABULARY, "rb") as f:
        ranks = secret_scan.ranked_words(f.read())
    r = random.Random(4)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!#%&*?@^~"
    signs = ["pwd: {}", 'password = "{}"', "pwd   =   {}", "passwd: '{}'", "secret: {}"]
    strong = ["".join(r.choice(letters) for _ in range(r.randint(11, 18))) + "!" for _ in range(200)]
    weak = [r.choice(["password", "summer", "dragon", "qwerty", "aaaaaa", "letmein", "monkey"]) + r.choice(["", "1", "12", "1999", "!", "2020!"]) for _ in range(200)]
    found = {True: 0, False: 0}
    for n, (value, planted) in enumerate([*((v, True) for v in strong), *((v, False) for v in weak)]):
        text = f"some prose before it {signs[n % len(signs)].format(value)} and after"
        spans = [text[a:b] for kind, a, b, _ in secret_scan.find_spans(text, ranks) if kind == "guess"]
        found[planted] += value in spans
    recall, precision = found[True] / len(strong), found[True] / max(1, sum(found.values()))
    print(f"recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.95 and precision >= 0.95
