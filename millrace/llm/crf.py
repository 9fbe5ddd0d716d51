"""A linear-chain conditional random field over word shapes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O"] + [f"{part}-{kind}" for kind in KINDS for part in "BI"]
N = len(LABELS)
#: Score of a transition that must not happen: into the inside of a span from outside it.
NEVER = -1e6
OUTER = "\"'<>[]{},;:!?*#%&$|`"
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")


def _transitions_allowed() -> np.ndarray:
    allowed = np.ones((N, N), bool)
    for a, before in enumerate(LABELS):
        for b, label in enumerate(LABELS):
            if label[0] == "I" and before[1:] != label[1:]:
                allowed[a, b] = False
    return allowed


ALLOWED = _transitions_allowed()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        twice = int(d) * (1 + k % 2)
        total += twice - 9 * (twice > 9)
    return total % 10 == 0


def core(word: str) -> str:
    """The word without the punctuation around it."""
    return word.strip(OUTER).rstrip(".") if not word[:1].isalpha() or not word[-1:].isalpha() else word


def _shape(word: str, digits: int) -> str:
    """Letter runs as A, a or Aa; digit runs as so many 9s, ``digits`` at most."""

    def run(m):
        s = m[0]
        if s[0].isdecimal():
            return "9" * min(len(s), digits)
        return "a" if s.islower() else "A" if s.isupper() else "Aa"

    return _RUN.sub(run, word)


def features(word: str) -> list[str]:
    """Names of what a word shows of itself."""
    c = core(word)
    if c.isalpha():
        return ["word", "cue=" + c.lower()] if len(c) <= 6 else ["word"]
    figures = [ch for ch in c if "0" <= ch <= "9"]
    found = ["shape=" + _shape(c, 5), "form=" + _shape(c, 1), "first=" + _shape(c[:1], 1), "last=" + _shape(c[-1:], 1), f"digits={min(len(figures), 20)}"]
    if "@" in c:
        found.append("at")
    if 13 <= len(figures) <= 19 and not re.search(r"[^\W\d_]", c):
        found.append(f"luhn={luhn(''.join(figures))}")
    return found


class Crf:
    """Weights of own, previous and next features and of label pairs.

    Both ends of a sequence count as the label O.
    """

    def __init__(self):
        self.number: dict[str, int] = {}
        self.weights = np.zeros((0, 3, N))
        self.pairs = np.zeros((N, N))

    def train(self, rows: Iterable[tuple[list[str], list[str]]], rounds: int = 300, decay: float = 0.02, step: float = 0.1) -> Crf:
        """Maximum likelihood with an L2 penalty, all rows at once (Adam); the same rows give the same weights."""
        rows = [r for r in rows if r[0]]
        shown = [[features(w) for w in words] for words, _ in rows]
        self.number = {f: k for k, f in enumerate(sorted({f for row in shown for fs in row for f in fs}))}
        longest = max(map(len, shown))
        seen = np.zeros((len(rows), longest + 2, len(self.number)))
        mask = np.zeros((len(rows), longest), bool)
        gold = np.zeros((len(rows), longest), int)
        for r, row in enumerate(shown):
            for t, fs in enumerate(row):
                seen[r, t + 1, [self.number[f] for f in fs]] = 1
            mask[r, : len(row)] = True
            gold[r, : len(row)] = [LABELS.index(x) for x in rows[r][1]]
        # One row for each place: its own features, those before and those after it.
        around = np.concatenate([seen[:, 1:-1], seen[:, :-2], seen[:, 2:]], 2).reshape(len(rows) * longest, -1)
        target = np.eye(N)[gold] * mask[..., None]
        gold_pairs = np.zeros((N, N))
        for r, row in enumerate(shown):
            path = [0, *gold[r, : len(row)], 0]
            np.add.at(gold_pairs, (path[:-1], path[1:]), 1)
        flat = np.zeros((3 * len(self.number), N))
        momentum = [(np.zeros_like(x), np.zeros_like(x)) for x in (flat, self.pairs)]
        for k in range(1, rounds + 1):
            emit = (around @ flat).reshape(len(rows), longest, N)
            single, double = self._marginals(emit, mask)
            gradients = around.T @ (target - single).reshape(-1, N) - decay * flat, (gold_pairs - double) * ALLOWED - decay * self.pairs
            for x, g, (m, v) in zip((flat, self.pairs), gradients, momentum, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.weights = flat.reshape(3, len(self.number), N).transpose(1, 0, 2).copy()
        return self

    def _marginals(self, emit: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label and pair probabilities of each row (forward and backward sums in logs)."""
        pairs = np.where(ALLOWED, self.pairs, NEVER)
        total = lambda x, axis: np.logaddexp.reduce(x, axis)
        rows, longest, _ = emit.shape
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = pairs[0] + emit[:, 0]
        for t in range(1, longest):
            moved = total(forward[:, t - 1, :, None] + pairs, 1) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], moved, forward[:, t - 1])
        ends = pairs[:, 0]
        backward[:, -1] = ends
        for t in range(longest - 2, -1, -1):
            moved = total(pairs + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], moved, ends)
        whole = total(forward[:, -1] + ends, 1)
        single = np.exp(forward + backward - whole[:, None, None]) * mask[..., None]
        between = forward[:, :-1, :, None] + pairs + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        double = (np.exp(between) * mask[:, 1:, None, None]).sum((0, 1))
        double[0] += single[:, 0].sum(0)
        lengths = mask.sum(1)
        double[:, 0] += single[np.arange(rows), lengths - 1].sum(0)
        return single, double


class Decoder:
    """Viterbi paths of many sequences at once.

    A word is known by its class, the model's features it shows. A run of labels other
    than O gains over O at most the sum, over its places, of the best gain a label has
    there and the best gain of a transition. Places that lie in no run with a positive
    bound are O on every best path (running sums give all of them at once); only the
    places between them are decoded, stretches of one length together.
    """

    PAD = 0

    def __init__(self, model: Crf):
        self.model = model
        self.pairs = np.where(ALLOWED, model.pairs, NEVER)
        steps = self.pairs - self.pairs[0, 0]
        steps[0, 0] = NEVER
        self.step = float(steps.max())
        self.classes: dict[tuple, int] = {(): self.PAD}
        self.tables = np.zeros((1, 3, N))
        self.known: dict[str, int] = {}

    def class_of(self, word: str) -> int:
        shown = tuple(k for f in features(word) if (k := self.model.number.get(f)) is not None)
        found = self.classes.get(shown)
        if found is None:
            found = self.classes[shown] = len(self.classes)
            self.tables = np.concatenate([self.tables, self.model.weights[list(shown)].sum(0)[None]])
        return found

    def number(self, words: list[str], most: int = 200_000) -> np.ndarray:
        known = self.known
        if len(known) > most:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.class_of(w)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def labels(self, classes: np.ndarray) -> np.ndarray:
        """The label of each place of sequences that are set apart by ``PAD`` (one before, between and after)."""
        own, left, right = self.tables[:, 0], self.tables[:, 1], self.tables[:, 2]
        lead = [(x[:, 1:] - x[:, :1]).max(1) for x in (own, left, right)]
        before, after = np.roll(classes, 1), np.roll(classes, -1)
        # No run reaches over a place between sequences. Each lead bounds a part, so their sum bounds the whole.
        bound = np.where(classes == self.PAD, -1e5, lead[0][classes] + lead[1][before] + lead[2][after] + self.step)
        upto = np.cumsum(bound)
        best_start = np.minimum.accumulate(np.concatenate([[0.0], upto[:-1]]))
        best_end = np.maximum.accumulate(upto[::-1])[::-1]
        open_ = (best_end - best_start + self.step >= -1e-6) & (classes != self.PAD)
        out = np.zeros(len(classes), np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], open_.view("i1"), [0]])))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        for n in np.unique(lengths).tolist():
            at = starts[lengths == n][:, None] + np.arange(n)
            emit = own[classes[at]] + left[before[at]] + right[after[at]]
            score, back = self.pairs[0] + emit[:, 0], np.zeros((len(at), n, N), np.int8)
            for t in range(1, n):
                moved = score[:, :, None] + self.pairs
                back[:, t] = moved.argmax(1)
                score = moved.max(1) + emit[:, t]
            path = (score + self.pairs[:, 0]).argmax(1)
            for t in range(n - 1, -1, -1):
                out[at[:, t]] = path
                path = back[np.arange(len(at)), t, path]
        return out
