"""The convolutional text classifier of ``toxicity``: model and training, with numpy alone.

``train_apart`` trains in a process of its own, which loads neither Spark nor Arrow.
"""

from __future__ import annotations

import os
import pickle
import re
import subprocess
import sys
import zlib
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

BUCKETS = 1 << 20
PREFIX = 4
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
STEPS = 500
BATCH = 64
SEED = 7
#: Toxic and clean rows that a language needs for a threshold of its own.
LANGUAGE_ROWS = 25
#: Texts of a class from which on a fifth of them is set aside for the thresholds.
CALIBRATION_ROWS = 100
_WORD = re.compile(r"\w+")
_COLUMNS = FILTERS * sum(WIDTHS)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _buckets(word: str) -> tuple[int, int]:
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS, BUCKETS + zlib.crc32(b"^" + word[:PREFIX].encode("utf-8", "replace")) % BUCKETS


@dataclass
class Model:
    """Filter outputs per hashed feature (``table``, row 0 for unknown ones), biases and output layer."""

    rows: dict[int, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((1, _COLUMNS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def scorer(self, keep: int = 150_000):
        """A function from a text to its logit; it remembers the features of up to ``keep`` words."""
        rows, table = self.rows, self.table
        known: dict[str, int] = {}

        def logit(text: str) -> float:
            if len(known) > keep:
                known.clear()
            own = words(text)
            codes = []
            for w in own:
                c = known.get(w)
                if c is None:
                    x, y = _buckets(w)
                    c = known[w] = rows.get(x, 0) << 32 | rows.get(y, 0)
                codes.append(c)
            code, back = np.unique(np.array([*codes, 0, 0], np.int64), return_inverse=True)  # padding is the empty word
            flat = table[code >> 32] + table[code & 0xFFFFFFFF]  # filter outputs of the distinct words
            pooled, at = [], 0
            for i, width in enumerate(WIDTHS):
                n, block = len(back) - width + 1, slice(i * FILTERS, (i + 1) * FILTERS)
                if width == 1:
                    best = flat[:, at : at + FILTERS].max(axis=0)
                else:
                    best = np.full(FILTERS, -np.inf, np.float32)
                    for start in range(0, n, 16_384):
                        stop = min(n, start + 16_384)
                        total = flat[back[start:stop], at : at + FILTERS]
                        for j in range(1, width):
                            total = total + flat[back[start + j : stop + j], at + j * FILTERS : at + (j + 1) * FILTERS]
                        best = np.maximum(best, total.max(axis=0))
                pooled.append(np.maximum(best + self.bias[block], 0))
                at += width * FILTERS
            return float(np.concatenate(pooled) @ self.out) + self.shift

        return logit


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Middle of the best cut of logits by weighted accuracy."""
    order = np.argsort(z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    below = np.concatenate([[0], np.cumsum(np.where(y, -weight, weight))])
    best = np.flatnonzero(below >= below.max() - 1e-9)
    low, high = int(best[0]), int(best[-1])
    left = z[low - 1] if low else z[0] - 1
    right = z[high] if high < len(z) else z[-1] + 1
    return float((left + right) / 2)


def train(texts: list[str], labels: list[int], langs: list[str | None] | None = None, seed: int = SEED, steps: int = STEPS) -> Model:
    """Fit a model on labelled whole texts."""
    langs = langs or [None] * len(texts)
    rows = sorted(zip(texts, labels, langs, strict=True), key=lambda r: (r[0], r[1], r[2] or ""))
    one = {t: (label, lang) for t, label, lang in rows}  # copies count once, toxic if any is, in whatever order rows arrive
    texts = sorted(one, key=lambda t: zlib.crc32(t.encode("utf-8", "replace")))
    y = np.array([one[t][0] for t in texts], np.float64)
    langs = [one[t][1] for t in texts]
    if not y.any() or y.all():
        return Model(constant=0.0)
    spare = np.zeros(len(texts), bool)  # every fifth text of a class that has enough sets thresholds and is not fitted on
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        if len(own) >= CALIBRATION_ROWS:
            spare[own[::5]] = True
    if not (spare & (y > 0)).any() or not (spare & (y == 0)).any():
        spare[:] = False
    place: dict[str, int] = {}
    coded: list[tuple[int, int]] = []
    tokens: list[np.ndarray] = []
    toxic, clean = Counter(), Counter()
    every, every_y, every_lang = texts, y, langs
    texts, y = [t for t, s in zip(every, spare, strict=True) if not s], y[~spare]
    for t, label in zip(texts, y, strict=True):
        own = words(t)
        for w in own:
            if w not in place:
                place[w] = len(coded)
                coded.append(_buckets(w))
        tokens.append(np.fromiter((place[w] for w in own), np.int32, len(own)))
        (toxic if label else clean).update({b for i in set(tokens[-1].tolist()) for b in coded[i]})
    del place
    kept = [b for b in (toxic.keys() | clean.keys()) if toxic[b] + clean[b] >= (4 if b < BUCKETS else 3)]
    rows = {b: i + 1 for i, b in enumerate(sorted(kept))}
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (len(rows) + 1, DIM))
    emb[0] = 0
    nt, nc = y.sum(), len(y) - y.sum()
    for b, i in rows.items():  # the first component starts as the feature's shrunk log-odds
        seen = toxic[b] + clean[b]
        emb[i, 0] = np.clip(np.log((toxic[b] + 0.5) / (nt + 1)) - np.log((clean[b] + 0.5) / (nc + 1)), -4, 4) * seen / (seen + 8) / 4
    filters = [rng.normal(0, 0.25, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.5
    bias, out, shift = np.zeros((len(WIDTHS), FILTERS)), np.abs(rng.normal(0.5, 0.1, (len(WIDTHS), FILTERS))), np.zeros(1)
    pair = np.array([(rows.get(a, 0), rows.get(b, 0)) for a, b in coded] + [(0, 0)], np.int64)  # the last one pads
    del coded, toxic, clean
    ids = [np.append(own, np.int32([len(pair) - 1] * 2)) for own in tokens]
    grads = [np.zeros_like(x) for x in (*filters, bias, out, shift)]
    first, second = [g.copy() for g in grads], [g.copy() for g in grads]
    seen_emb = np.full(len(emb), 1e-4)
    pos, neg = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    for step in range(1, steps + 1):
        batch = np.concatenate([rng.choice(pos, BATCH // 2), rng.choice(neg, BATCH // 2)])
        sizes = [len(ids[d]) for d in batch]
        both = pair[np.concatenate([ids[d] for d in batch])]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x = emb[both[:, 0]] + emb[both[:, 1]]
        pooled, places = np.zeros((BATCH, len(WIDTHS), FILTERS)), []
        for i, w in enumerate(WIDTHS):
            n = len(x) - w + 1
            conv = sum(x[j : j + n] @ filters[i][j] for j in range(w))
            ends = starts + np.array(sizes) - w + 1
            at = np.zeros((BATCH, FILTERS), np.int64)
            for d in range(BATCH):
                at[d] = conv[starts[d] : ends[d]].argmax(axis=0) + starts[d]
            places.append(at)
            pooled[:, i] = conv[at, np.arange(FILTERS)] + bias[i]
        act = np.maximum(pooled, 0)
        z = (act * out).sum(axis=(1, 2)) + shift[0]
        err = (_sigmoid(z) - y[batch]) / BATCH
        g_act = err[:, None, None] * out * (pooled > 0)
        touched, g_rows = [], []
        for i, w in enumerate(WIDTHS):
            g = np.zeros_like(filters[i])
            for j in range(w):
                token = places[i] + j
                vec = x[token]  # batch, filter, dim
                g[j] = np.einsum("bfd,bf->df", vec, g_act[:, i])
                push = g_act[:, i][:, :, None] * filters[i][j].T[None]
                for side in (0, 1):
                    touched.append(both[token, side].ravel())
                    g_rows.append(push.reshape(-1, DIM))
            grads[i] = g + 1e-4 * filters[i]
        grads[len(WIDTHS)] = g_act.sum(axis=0)
        grads[len(WIDTHS) + 1] = (err[:, None, None] * act).sum(axis=0) + 1e-4 * out
        grads[len(WIDTHS) + 2] = np.array([err.sum()])
        for k, p in enumerate((*filters, bias, out, shift)):
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            p -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        index = np.concatenate(touched)
        use, where = np.unique(index, return_inverse=True)
        total = np.zeros((len(use), DIM))
        np.add.at(total, where, np.concatenate(g_rows))
        seen_emb[use] += (total**2).mean(axis=1)
        emb[use] -= 0.02 * total / np.sqrt(seen_emb[use])[:, None]
        emb[0] = 0
    wide = np.concatenate([filters[i][j] for i, w in enumerate(WIDTHS) for j in range(w)], axis=1)
    table = (emb @ wide).astype(np.float32)
    model = Model(rows, table, bias.ravel().astype(np.float32), out.ravel().astype(np.float32), float(shift[0]))
    logit = model.scorer()
    judged = spare if spare.any() else ~spare
    z = np.array([logit(t) for t, j in zip(every, judged, strict=True) if j])
    y, langs = every_y[judged], [x for x, j in zip(every_lang, judged, strict=True) if j]
    nt, nc = y.sum(), len(y) - y.sum()
    weight = np.where(y > 0, 0.25 / nt, 0.75 / nc)
    model.shift -= _best_cut(z, y > 0, weight)
    z = z + model.shift - float(shift[0])
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        t, c = int(y[own].sum()), int(own.sum() - y[own].sum())
        if t >= LANGUAGE_ROWS and c >= LANGUAGE_ROWS:
            own_cut = _best_cut(z[own], y[own] > 0, np.where(y[own] > 0, 0.5 / t, 0.5 / c))
            model.thresholds[lang] = float(_sigmoid(own_cut / 2))  # half way from the common threshold
    return model


def train_apart(texts: list[str], labels: list[int], langs: list[str | None] | None = None) -> Model:
    """``train`` in a process of its own, so that the memory it took is given back when it ends."""
    root = str(Path(__file__).resolve().parents[2])
    env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in (root, os.environ.get("PYTHONPATH")) if p)}
    code = "import sys; from linkforge.llm import convolution; convolution.serve(sys.stdin.buffer, sys.stdout.buffer)"
    done = subprocess.run([sys.executable, "-c", code], input=pickle.dumps((texts, labels, langs)), stdout=subprocess.PIPE, env=env, check=True)
    return pickle.loads(done.stdout)


def serve(given, result) -> None:
    """Train the pickled arguments of one stream and write the pickled model to the other."""
    pickle.dump(train(*pickle.load(given)), result)
