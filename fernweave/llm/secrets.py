"""Secret scans by patterns and a character convolutional network (operator 1).

Base spans come from three patterns (assign, access, hex). Candidates are these and every other token of 16 or more
key-like characters that mixes kinds of them. Each candidate with its surrounding characters goes through a small
network in numpy: an embedding of characters (with a channel that tells the candidate from its context), one
convolution, its maximum and mean over the positions, a logistic output. The report's spans are the base spans, which
always stay, and the candidates beyond them that the network finds, as kind `token`; scores() tells what it thinks of each.

Training. The network learns from generated labelled findings (TRAIN_ROWS, fixed seed): keys and passwords of many
forms in and out of code, and as many look-alikes (digests of known files, paths, identifiers, long words, numbers).
A third of them is set aside: on it the output is calibrated (Platt), and the threshold is the highest that keeps recall at
RECALL.

Defined results: null text counts as empty and has no spans; offsets are code points, ends exclusive; repeated rows
give repeated rows; an empty table gives an empty table; columns other than the key and the text are not read. Every
pattern takes linear time. The network goes over the whole of a long candidate in overlapping windows, the most suspicious of
which counts; its span is whole.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches, sha256_hex

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token")
#: Training: rows, seed, share set aside for calibration, passes, recall to keep there.
TRAIN_ROWS, SEED, HELD, EPOCHS, BATCH, RATE, RECALL = 6000, 11, 1 / 3, 6, 64, 2e-3, 0.98
#: Characters seen: before the candidate, of it, after it; the network's sizes.
LEFT, BODY, RIGHT = 24, 48, 12
WIDTH, EMBEDDED, FILTERS = LEFT + BODY + RIGHT, 12, 24
KERNEL = 5
#: Characters between the windows of a candidate longer than BODY.
STEP = BODY // 2

Span = tuple[str, int, int]

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINT = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def base_spans(text: str | None) -> list[Span]:
    """The patterns' spans, by start and then kind."""
    if not text:
        return []
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINT):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def candidates(text: str | None, base: list[Span]) -> list[tuple[int, int]]:
    """Key-like tokens that touch no base span: with a digit and a letter, or with both cases inside."""
    if not text:
        return []
    out, at = [], 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        s = m[0]
        digit, upper, lower = any("0" <= c <= "9" for c in s), s.lower() != s, s.upper() != s
        if not (digit and (upper or lower) or upper and lower and s[1:].lower() != s[1:]):
            continue
        while at < len(base) and base[at][2] <= a:
            at += 1
        if not any(x < b and a < y for _, x, y in base[at : at + 4]):
            out.append((a, b))
    return out


def windows(rows: list[tuple[str, int, int]]) -> np.ndarray:
    """uint8 character codes (rows, WIDTH) of (text, start, end): context, the candidate's beginning, context after it; 128 up for the candidate's own."""
    out = np.zeros((len(rows), WIDTH), np.uint8)
    for i, (text, a, b) in enumerate(rows):
        left, body, right = text[max(0, a - LEFT) : a], text[a : min(b, a + BODY)], text[b : b + RIGHT]
        own = body.encode("ascii", "replace")
        codes = left.encode("ascii", "replace").rjust(LEFT, b"\0") + bytes([c & 127 | 128 for c in own]).ljust(BODY, b"\0") + right.encode("ascii", "replace").ljust(RIGHT, b"\0")
        out[i] = np.frombuffer(codes, np.uint8)
    return out


def pieces(a: int, b: int) -> list[tuple[int, int]]:
    """The candidate, whose beginning windows() takes, and the further bodies that cover the rest of a long one, the last at its end."""
    return [(a, b), *((s, s + BODY) for s in range(a + STEP, b - BODY, STEP)), *([(b - BODY, b)] if b - a > BODY else [])]


class CharCnn:
    """Embedding, one convolution with ReLU, maximum and mean over positions, logistic output; Platt scale and threshold."""

    def __init__(self, rng: np.random.Generator):
        scale = (2 / (KERNEL * (EMBEDDED + 1))) ** 0.5
        self.weights = [rng.normal(0, 0.3, (128, EMBEDDED)), rng.normal(0, scale, (KERNEL * (EMBEDDED + 1), FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1)]
        self.weights = [w.astype(np.float32) for w in self.weights]
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        embedding, kernel, bias, out, last = self.weights
        e = np.concatenate([embedding[x & 127], (x >> 7)[:, :, None].astype(np.float32)], axis=2)
        n = WIDTH - KERNEL + 1
        cols = np.concatenate([e[:, k : k + n] for k in range(KERNEL)], axis=2)
        z = cols @ kernel + bias
        a = np.maximum(z, 0)
        pooled = np.concatenate([a.max(axis=1), a.mean(axis=1)], axis=1)
        return cols, a, pooled, pooled @ out + last[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0, np.float32), *(self._forward(x[i : i + 256])[3] for i in range(0, len(x), 256))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(x) + self.offset)))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        _, kernel, _, out, _ = self.weights
        cols, a, pooled, logit = self._forward(x)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        d_pooled = d[:, None] * out
        d_a = np.repeat(d_pooled[:, None, FILTERS:] / a.shape[1], a.shape[1], axis=1)
        rows, filters = np.indices((len(y), FILTERS))
        d_a[rows, a.argmax(axis=1), filters] += d_pooled[:, :FILTERS]
        d_z = d_a * (a > 0)
        d_cols = d_z @ kernel.T
        d_embedding = np.zeros((128, EMBEDDED), np.float32)
        n = a.shape[1]
        for k in range(KERNEL):
            np.add.at(d_embedding, x[:, k : k + n] & 127, d_cols[:, :, k * (EMBEDDED + 1) : k * (EMBEDDED + 1) + EMBEDDED])
        flat = d_z.reshape(-1, FILTERS)
        return [d_embedding, cols.reshape(len(flat), -1).T @ flat, flat.sum(axis=0), pooled.T @ d, d.sum(keepdims=True)]

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Adam over EPOCHS passes."""
        moment, square, t = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                t += 1
                for w, m, s, g in zip(self.weights, moment, square, self._gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]])):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's scale and offset by Newton steps, then the highest threshold that keeps recall at RECALL."""
        z = self.logits(x).astype(float)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = p * (1 - p) + 1e-9
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, [((p - y) * z).sum() + 1e-3 * a, (p - y).sum()])
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.scale, self.offset = a, b
        found = np.sort(self.probability(x)[y == 1])
        self.threshold = float(found[int((1 - RECALL) * len(found))])


def labelled(rows: int = TRAIN_ROWS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """Generated findings: (text, start, end, 1 if it's a secret)."""
    rng = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    b62 = lower + upper + digit
    some = lambda chars, a, b: "".join(rng.choices(chars, k=rng.randint(a, b)))
    word = lambda: some(lower, 2, 9)
    secrets = (
        lambda: "AKIA" + some(upper + digit, 16, 16),
        lambda: some("0123456789abcdef", 32, 64),
        lambda: some(b62 + "+/", 40, 40),
        lambda: "eyJ" + some(b62 + "_-", 30, 60),
        lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "AIza"]) + some(b62, 24, 40),
        lambda: some(b62, 20, 44),
        lambda: some(b62 + "+/", 42, 42) + "==",
        lambda: some(upper + digit, 20, 32),
    )
    no_secrets = (
        lambda: "/".join(word() for _ in range(rng.randint(4, 7))) + some(digit, 1, 2),
        lambda: "-".join(word() for _ in range(rng.randint(3, 6))) + "-" + some(digit, 1, 4),
        lambda: "_".join(word() for _ in range(rng.randint(3, 5))) + some(digit, 1, 2),
        lambda: "".join(word().capitalize() for _ in range(rng.randint(3, 6))),
        lambda: word() + "".join(word().capitalize() for _ in range(rng.randint(3, 5))) + some(digit, 0, 2),
        lambda: f"20{some(digit, 2, 2)}-{some(digit, 2, 2)}-{some(digit, 2, 2)}T{some(digit, 2, 2)}-{some(digit, 2, 2)}-{some(digit, 2, 2)}Z",
        lambda: some(lower, 16, 30) + some(digit, 1, 2),
        lambda: "+1-" + some(digit, 3, 3) + "-" + some(digit, 3, 3) + "-" + some(digit, 4, 4) + "x" + some(digit, 2, 3),
        lambda: "=" * rng.randint(8, 20) + word() + some(digit, 1, 3) + "=" * rng.randint(4, 10),
        lambda: "ISBN-" + "-".join(some(digit, 1, 5) for _ in range(4)),
    )
    before = ('key = "', "key: ", 'auth="', "Bearer ", "credential = '", "AWS_KEY=", "signing key ", "export KEY=")
    plain = ("see ", "in file ", "the page ", "class ", "import ", "on ", "(", "https://www.example.com/", "\n", "of ")
    out = []
    for i in range(rows):
        secret = i % 2
        value = rng.choice(secrets if secret else no_secrets)()
        lead = rng.choice(before if rng.random() < (0.6 if secret else 0.1) else plain)
        head = " ".join(word() for _ in range(rng.randint(0, 6))) + " " + lead
        tail = rng.choice(['"', "'", "", ",", ")"]) + " " + " ".join(word() for _ in range(rng.randint(0, 4)))
        out.append((head + value + tail, len(head), len(head) + len(value), secret))
    return out


def train(rows: list[tuple[str, int, int, int]]) -> CharCnn:
    rng = np.random.default_rng(SEED)
    net = CharCnn(rng)
    x, y = windows([r[:3] for r in rows]), np.array([r[3] for r in rows], np.float32)
    held = rng.random(len(rows)) < HELD
    net.fit(x[~held], y[~held], rng)
    net.calibrate(x[held], y[held])
    return net


_model: list[CharCnn] = []


def model() -> CharCnn:
    """The default network, trained once in a process."""
    if not _model:
        _model.append(train(labelled()))
    return _model[0]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _judged(net: CharCnn, texts: list[str | None]) -> list[list[tuple[Span, float]]]:
    """All candidates of each text with their probabilities, base spans among them, by start."""
    bases = [base_spans(t) for t in texts]
    spans = [sorted(b + [("token", *c) for c in candidates(t, b)], key=_order) for t, b in zip(texts, bases)]
    cut = [[(t, x, y) for x, y in pieces(a, b)] for t, own in zip(texts, spans) for _, a, b in own]
    each = net.probability(windows([w for c in cut for w in c]))
    p = np.maximum.reduceat(each, np.cumsum([0, *map(len, cut[:-1])])).tolist() if cut else []
    at, out = 0, []
    for own in spans:
        out.append(list(zip(own, p[at : at + len(own)])))
        at += len(own)
    return out


def scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each candidate: the key, kind, start, end, value, probability, and whether it's found."""
    shared = df.sparkSession.sparkContext.broadcast(model())

    def make():
        net = shared.value

        def run(keys, texts):
            rows = [(k, s[0], s[1], s[2], t[s[1] : s[2]], p, s[0] in BASE or p >= net.threshold) for k, t, own in zip(keys, texts, _judged(net, texts)) for s, p in own]
            return {c: [r[i] for r in rows] for i, c in enumerate((key, "kind", "start", "end", "value", "probability", "found"))}

        return run

    return map_batches(df, [key, text], f"`{key}` {df.schema[key].dataType.simpleString()}, kind string, start int, end int, value string, probability double, found boolean", make)


def secret_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_assign, n_access, n_hex and base_sha256 of the base spans, all spans and their number, of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model())
    columns = [f"n_{k}" for k in BASE]

    def make():
        net = shared.value

        def run(keys, texts):
            judged = _judged(net, texts)
            bases = [[s for s, _ in own if s[0] in BASE] for own in judged]
            found = [[s for s, p in own if s[0] in BASE or p >= net.threshold] for own in judged]
            out = {key: keys, "base_sha256": [sha256_hex(joined(b).encode()) for b in bases], "spans": list(map(joined, found)), "n_spans": list(map(len, found))}
            return out | {c: [sum(s[0] == k for s in b) for b in bases] for c, k in zip(columns, BASE)}

        return run

    return map_batches(df, [key, text], f"`{key}` {df.schema[key].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in columns)}, base_sha256 string, spans string, n_spans bigint", make)
