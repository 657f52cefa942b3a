"""A linear-chain conditional random field over word shapes, in numpy."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Other words, and for each kind the first word of a span and those that follow in it.
LABELS = ("O", *(f"{part}-{kind}" for kind in KINDS for part in "BI"))
SPECIAL = re.compile("[0-9@]")
#: The only features of a word without a digit or @. Its one label is O: the field's states allow no other.
PLAIN = ("plain",)
NEVER = -1e4
TRIM = string.punctuation.replace("+", "")
CUES = {"call", "tel", "phone", "fax", "mobile", "dial", "card", "visa", "iban", "account", "ip", "host", "server", "address", "mail", "email", "contact", "write"}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _bucket(n: int) -> str:
    return next((f"{a}-{b}" for a, b in ((0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 6), (7, 8), (9, 12), (13, 15), (16, 19)) if a <= n <= b), "20+")


def word_features(word: str) -> tuple[str, ...]:
    """Of the word itself: its shape (runs of a kind of character squeezed), how many digits it has,
    and whether its digits pass what cards and addresses must. Words without a digit or @ are alike."""
    if not SPECIAL.search(word):
        return PLAIN
    w = word.strip(TRIM)
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "d", re.sub("[^\\W\\d_]", "x", w)))
    digits = re.sub("[^0-9]", "", w)
    out = [f"shape={shape}" if len(shape) <= 12 else "shape=long", f"digits={_bucket(len(digits))}", f"length={_bucket(len(w))}"]
    if re.fullmatch(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", w):
        out.append("address")
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", w):
        out.append("quad" if all(int(p) <= 255 for p in w.split(".")) else "no quad")
    if 13 <= len(digits) <= 19:
        out.append("luhn" if luhn(digits) else "no luhn")
    if re.search("[A-Za-z]", w) and digits and "@" not in w:
        out.append("mixed")
    return tuple(out)


def context(word: str | None) -> str:
    """What a word tells about its neighbours."""
    if word is None:
        return "edge"
    low = word.strip(string.punctuation).lower()
    return "cue" if low in CUES else "at" if "@" in word else "number" if SPECIAL.search(word) else "plain"


CONTEXTS = ("edge", "cue", "at", "number", "plain")


class CRF:
    """Scores: emission of a word's own features, of the contexts before and after, and transitions.
    Plain words are O, in training and decoding, so a best path falls apart into runs of other words."""

    def __init__(self, rows: Iterable[list[tuple[str, str]]], rounds: int = 300, rate: float = 0.3, decay: float = 1e-3):
        rows = [r for r in rows if r]
        own = [[word_features(w) for w, _ in r] for r in rows]
        names = sorted({f for r in own for fs in r for f in fs})
        self.index = {f: i for i, f in enumerate(names)}
        k, f, n, longest = len(LABELS), len(names), len(rows), max(map(len, rows))
        x = np.zeros((n, longest, f + 2 * len(CONTEXTS)))
        y, on, plain = np.zeros((n, longest), int), np.zeros((n, longest), bool), np.zeros((n, longest), bool)
        for i, r in enumerate(rows):
            for t, (_, label) in enumerate(r):
                x[i, t, [self.index[q] for q in own[i][t]]] = 1
                x[i, t, f + CONTEXTS.index(context(r[t - 1][0] if t else None))] = 1
                x[i, t, f + len(CONTEXTS) + CONTEXTS.index(context(r[t + 1][0] if t + 1 < len(r) else None))] = 1
                y[i, t], on[i, t], plain[i, t] = LABELS.index(label), True, own[i][t] == PLAIN
        w, tr = np.zeros((x.shape[2], k)), np.zeros((k, k))
        gw, gt = np.full(w.shape, 1e-6), np.full(tr.shape, 1e-6)
        gold = np.eye(k)[y] * on[..., None]
        pair = on[:, 1:]
        gold_t = np.einsum("nta,ntb->ab", gold[:, :-1] * pair[..., None], gold[:, 1:])
        for _ in range(rounds):
            e = x @ w
            e[plain, 1:] = NEVER
            node, edge = self._expected(e, tr, on)
            dw = np.einsum("ntf,ntk->fk", x, gold - node) - decay * n * w
            dt = gold_t - edge - decay * n * tr
            gw += dw**2
            gt += dt**2
            w += rate * dw / np.sqrt(gw)
            tr += rate * dt / np.sqrt(gt)
        self.own, self.before, self.after, self.transition = w[:f], w[f : f + len(CONTEXTS)], w[f + len(CONTEXTS) :], tr

    @staticmethod
    def _expected(e: np.ndarray, tr: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected labels and pairs of labels, by forward-backward over all rows at once."""
        n, longest, k = e.shape
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.where(on[:, t, None], lse(fwd[:, t - 1, :, None] + tr, 1) + e[:, t], fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            bwd[:, t] = np.where(on[:, t + 1, None], lse(tr + (e[:, t + 1] + bwd[:, t + 1])[:, None], 2), 0)
        z = lse(fwd[:, -1], 1)
        node = np.exp(np.minimum(fwd + bwd - z[:, None, None], 0)) * on[..., None]
        p = fwd[:, :-1, :, None] + tr + (e + bwd)[:, 1:, None] - z[:, None, None, None]
        return node, (np.exp(np.minimum(p, 0)) * on[:, 1:, None, None]).sum((0, 1))

    def emission(self, features: tuple[str, ...]) -> np.ndarray:
        at = [self.index[q] for q in features if q in self.index]
        return self.own[at].sum(0)

    def scores(self, words: list[str | None]) -> np.ndarray:
        """Emissions of words[1:-1]; the first and last are neighbours, None beyond the text."""
        around = [CONTEXTS.index(context(w)) for w in words]
        own = np.array([self.emission(word_features(w)) for w in words[1:-1]])
        return own + self.before[around[:-2]] + self.after[around[2:]]

    def viterbi(self, e: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Best labels of a batch of runs (runs, words, labels). left, right: whether a word labelled
        O stands before or after the run."""
        best = e[:, 0] + np.where(left[:, None], self.transition[0], 0)
        back = []
        for t in range(1, e.shape[1]):
            s = best[:, :, None] + self.transition
            back.append(s.argmax(1))
            best = s.max(1) + e[:, t]
        at = (best + np.where(right[:, None], self.transition[:, 0], 0)).argmax(1)
        out = [at]
        for b in reversed(back):
            at = b[np.arange(len(at)), at]
            out.append(at)
        return np.stack(out[::-1], 1)
