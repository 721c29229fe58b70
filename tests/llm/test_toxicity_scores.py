"""Scores of the network against its definition: word by word, window by window, in plain numbers."""

import math
import random

import numpy as np

from modloom.llm import toxicity as tx

M = (1 << 64) - 1


def hashes(word):
    marked = f"^{word or ' '}$"
    step = [(ord(c) + 1) * 0x9E3779B97F4A7C15 & M for c in marked]
    w = sum((s ^ s >> 29) * ((i + 1) * 0xBF58476D1CE4E5B9 & M | 1) for i, s in enumerate(step)) & M
    grams = []
    for n in tx.GRAMS:
        for i in range(len(marked) - n + 1):
            h = step[i]
            for s in step[i + 1 : i + n]:
                h = ((h ^ h >> 27) * 0x94D049BB133111EB + s) & M
            grams.append(h ^ h >> 31 ^ n)
    return w ^ w >> 31, grams, [min(len(marked) - 2, 20) / 10, float(not word.isalpha())]


def inputs(model, word):
    w, grams, shape = hashes(word)
    seen = [float(model.gram_evidence[g % tx.EVIDENCE]) for g in grams]
    chars = [model.p["char"][(g >> 20) % tx.BUCKETS].astype(float) for g in grams]
    return np.array([model.word_evidence[w % tx.EVIDENCE], max(seen), sum(seen) / len(seen), *shape, 1.0, *model.p["word"][(w >> 20) % tx.BUCKETS], *(sum(chars) / len(chars))], float)


def states(x, p, d):
    h, out, n = np.zeros(tx.HIDDEN), [], tx.HIDDEN
    for row in x if d == "f" else x[::-1]:
        g, u = row @ p["W" + d] + p["c" + d], p["U" + d]
        z = 1 / (1 + np.exp(-(g[:n] + h @ u[:, :n])))
        r = 1 / (1 + np.exp(-(g[n : 2 * n] + h @ u[:, n : 2 * n])))
        h = (1 - z) * h + z * np.tanh(g[2 * n :] + (r * h) @ u[:, 2 * n :])
        out.append(h)
    return out if d == "f" else out[::-1]


def score(model, text):
    words, p = tx.words_of(text), {k: v.astype(float) for k, v in model.p.items()}
    starts = [0]
    while starts[-1] + tx.WINDOW < len(words):  # the last window ends with the text
        starts.append(min(starts[-1] + tx.STRIDE, len(words) - tx.WINDOW))
    best = -math.inf
    for at in starts:
        x = [inputs(model, w) for w in words[at : at + tx.WINDOW] or [""]]
        h = [np.concatenate(both) for both in zip(states(x, p, "f"), states(x, p, "b"), strict=True)]
        e = [math.exp(np.tanh(s @ p["A"]) @ p["a"]) for s in h]
        pooled = sum(s * (a / sum(e)) for s, a in zip(h, e, strict=True))
        best = max(best, pooled @ p["v"] + p["b"][0])
    return 1 / (1 + math.exp(-best))


def test_scores_are_their_definition():
    rng, r = np.random.default_rng(11), random.Random(11)
    p = {k: v * (20 if k in ("word", "char") else 3) if k != "b" else v for k, v in tx.new_parameters(rng).items()}
    model = tx.Model(0.1, rng.uniform(-2, 3, tx.EVIDENCE).astype(np.float32), rng.uniform(-2, 3, tx.EVIDENCE).astype(np.float32), p)

    def text(n):
        return " ".join("".join(r.choices("abcdeäß語7-", k=r.randint(1, 9))) for _ in range(n))

    texts = ["", " ", "a", text(3), text(31), text(32), text(33), text(48), text(49), text(130), "語" * 200, text(2) + "\n\n" + "x" * 70, text(33)]
    got = tx.score_texts(model, texts)
    want = [score(model, t) for t in texts]
    assert np.allclose(got, want, atol=2e-4) and np.ptp(want) > 0.1
    assert np.allclose(tx.score_texts(model, texts[::-1]), got[::-1], atol=1e-5)
