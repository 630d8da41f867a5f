"""Personal data by patterns and a skip-chain conditional random field (operator 4).

Base spans come from four patterns (email, ip, card, phone). The field then labels a document's evidence tokens, those with
a digit or an @ and capitalised words after a cue such as "Mr." or "name:" together with all their repetitions, possessives and
capitals among them; every other token is observed as no entity. Evidence tokens have unary features of their form, the words before
them and the base spans; neighbours share a chain potential; and, however distant, a token shares a skip potential with the last
one that repeats it (equal but for case and punctuation), or else with the last similar one: of the same last seven digits,
the same address before the @, or the same beginning of a name. Sum-product messages run over the loopy graph of all
documents of a batch at once until they settle, and what a label's marginal finds beyond the base spans is added: emails, addresses,
cards and phones in forms the patterns miss, identity numbers (`id`) and names (`name`).

Training. The weights are those of multinomial pseudo-likelihood (each token given its neighbours' true labels), fitted
on generated labelled sentences, TRAIN_SENTENCES of them from a fixed seed.

Defined results: null text counts as empty and has no spans; offsets are code points, ends exclusive; repeated rows
give repeated rows; an empty table gives an empty table; columns other than the key and the text aren't read by the
report, and kept as they are by mask(). Every pattern takes linear time on texts of any form.
"""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, sha256_hex

#: Base kinds in the order of ties, then those that the field adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "name")
LABELS = ("O", *KINDS)
TRAIN_SENTENCES, SEED, STEPS, RATE, DECAY = 3000, 7, 250, 0.5, 1e-4
#: Messages' damping; the marginal from which a label counts.
DAMPING, LEAST = 0.3, 0.9
#: Messages have settled when none changes by more than SETTLED. From round PATIENT on, those that swing are damped more and more.
SETTLED, PATIENT = 1e-4, 50
#: Characters between chained tokens at most, and the words before a token that are looked at.
NEAR, BEFORE = 24, 3

Span = tuple[str, int, int]

_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Matches of local@domain: from each @ that a domain follows, back over the characters of a local part."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        low = max(end, text.rfind("@", end, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str | None) -> list[Span]:
    """The patterns' spans, by start and then kind."""
    if not text:
        return []
    out = emails(text) if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


#: Words that tell what comes next, by what they tell of; part of the model.
CUES = {
    "name": ("mr", "mrs", "ms", "dr", "prof", "name", "named", "signed", "dear", "herr", "frau", "señor", "señora", "monsieur", "madame"),
    "phone": ("phone", "tel", "telephone", "call", "ring", "dial", "mobile", "móvil", "portable", "fax", "telefon", "teléfono", "téléphone"),
    "email": ("email", "e-mail", "mail", "mailto", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte"),
    "id": ("ssn", "passport", "iban", "social", "license", "tax", "identity", "ausweis"),
}
_CUE_OF = {w: kind for kind, words in CUES.items() for w in words}
_NAME_CUE = re.compile(r"(?<!\w)(?:" + "|".join(CUES["name"]) + r")[.:]{0,2} {1,3}(?=[^\W\d_])", re.I)
_NAME_HINT = tuple(c + end for w in CUES["name"] for c in (w, w.capitalize(), w.upper()) for end in (" ", ".", ":"))
_NAME = re.compile(r"[^\W\d_][\w'-]*")
_EVIDENCE = re.compile(r"[0-9@]")
_WORD_BEFORE = re.compile(r"[^\s:=,;.()\"']+")
_SPACE = re.compile(r"\s")
_TRIM = "\"'`,;:!?<>[]{}*&$%#|"
#: A token longer than this is cut at punctuation and changes of script, and each piece with evidence is labelled.
LONGEST = 200
_LATIN = "A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
_PIECE = re.compile(rf"%[0-9A-Fa-f]{{2}}|((?:[{_LATIN}@._+-]|\([0-9+]{{1,5}}\)(?=[0-9-]))+)")
_RUN = re.compile(rf"[{_LATIN}@]+")


def _pieces(text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """The pieces with evidence of a token longer than LONGEST; one that's still longer is cut into its runs of letters and digits."""
    for m in _PIECE.finditer(text, start, stop):
        if m[1] is None or not _EVIDENCE.search(m[1]):
            continue
        low, high = m.span(1)
        while low < high and text[low] in ".-_":
            low += 1
        while low < high and text[high - 1] in ".-_+":
            high -= 1
        if high - low <= LONGEST:
            yield low, high
            continue
        runs: list[tuple[int, int]] = []
        for r in _RUN.finditer(text, low, high):
            # Groups of digits that a dot or dash joins stay together.
            if runs and r.start() == runs[-1][1] + 1 and text[r.start() - 1] in ".-" and r[0].isdecimal() and text[runs[-1][1] - 1].isdecimal() and text[runs[-1][0]].isdecimal():
                runs[-1] = (runs[-1][0], r.end())
            else:
                runs.append(r.span())
        yield from (r for r in runs if _EVIDENCE.search(text, *r))


def _bare(name: str) -> str:
    """A name without its possessive ending, in small letters."""
    return (name[:-2] if name[-2:] in ("'s", "'S") else name).casefold()


def evidence(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that the field labels, by start."""
    found: set[tuple[int, int]] = set()
    end, m = 0, _EVIDENCE.search(text)
    while m:
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = s.start() if (s := _SPACE.search(text, m.start())) else len(text)
        end = stop
        while start < stop and text[start] in _TRIM:
            start += 1
        while start < stop and (text[stop - 1] in _TRIM or text[stop - 1] == "."):
            stop -= 1
        if stop - start > LONGEST:
            found.update(_pieces(text, start, stop))
        elif start < stop:
            found.add((start, stop))
        m = _EVIDENCE.search(text, end)
    if any(hint in text for hint in _NAME_HINT):
        names = set()
        for cue in _NAME_CUE.finditer(text):
            at = cue.end()
            for _ in range(2):
                n = _NAME.match(text, at)
                if not n or not n[0][0].isupper() or len(n[0]) > LONGEST or n[0].lower() in _CUE_OF:
                    break
                names.add(_bare(n[0]))
                at = n.end() + 1
                if text[n.end() : at] != " ":
                    break
        if names:
            found |= {n.span() for n in _NAME.finditer(text) if n[0][0].isupper() and _bare(n[0]) in names}
    out: list[tuple[int, int]] = []
    for span in sorted(found):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


FEATURES = ["bias", "@", ".", "-", "(", "+", "/", ":", "capital", "letters", "digits", "mixed", "luhn", "dots=3", "octets", "dashes=2", "3-2-4", "iban", "domain", *(f"n={n}" for n in ("0", "1-3", "4-6", "7-8", "9-11", "12-15", "16", "17+")), *(f"base={k}" for k in BASE), *(f"cue={k}" for k in CUES), *(f"last={k}" for k in CUES)]
_F = {f: i for i, f in enumerate(FEATURES)}
_324 = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_MAIL = re.compile(r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}")


def features(text: str, start: int, end: int, base: list[Span]) -> list[int]:
    token = text[start:end]
    d = _digits(token)
    on = ["bias", *(c for c in "@.-(+/:" if c in token)]
    n = len(d)
    on.append("n=" + ("0" if not n else "1-3" if n < 4 else "4-6" if n < 7 else "7-8" if n < 9 else "9-11" if n < 12 else "12-15" if n < 16 else "16" if n == 16 else "17+"))
    alpha = any(map(str.isalpha, token))
    on.append("mixed" if alpha and d else "letters" if alpha else "digits")
    parts = token.split(".")
    tests = (("capital", token[0].isupper()), ("luhn", 12 <= n <= 19 and luhn(d)), ("dots=3", len(parts) == 4), ("octets", len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts)), ("dashes=2", token.count("-") == 2), ("3-2-4", bool(_324.fullmatch(token))), ("iban", bool(_IBAN.fullmatch(token))), ("domain", bool(_MAIL.fullmatch(token))))
    on += [name for name, holds in tests if holds]
    on += {f"base={k}" for k, a, b in base if a < end and start < b}
    words = [w.lower() for w in _WORD_BEFORE.findall(text[max(0, start - 40) : start])][-BEFORE:]
    on += {f"cue={_CUE_OF[w]}" for w in words if w in _CUE_OF}
    if words and words[-1] in _CUE_OF:
        on.append(f"last={_CUE_OF[words[-1]]}")
    return [_F[f] for f in dict.fromkeys(on)]


def likeness(token: str) -> list[str]:
    """What tokens have in common that repeat this one, then what similar ones do."""
    plain = "".join([c for c in token.casefold() if c.isalnum()])
    out = [f"={plain}"] if len(plain) > 2 else []
    digits = _digits(token)
    if len(digits) >= 7:
        out.append(f"#{digits[-7:]}")
    elif "@" in token[1:]:
        out.append(f"@{token.casefold().partition('@')[0]}")
    elif token[0].isupper() and token.replace("'", "").replace("-", "").isalpha() and len(plain) > 4:
        out.append(f"~{plain[:5]}")
    return out


def graph(text: str, tokens: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges and skip edges between tokens, by index. Each token is joined to the last that repeats it, or else to the last similar one: as many edges as tokens at most."""
    chain = [(i - 1, i) for i in range(1, len(tokens)) if tokens[i][0] - tokens[i - 1][1] <= NEAR]
    last: dict[str, int] = {}
    skip = []
    for i, (start, end) in enumerate(tokens):
        keys = likeness(text[start:end])
        if (j := next((last[k] for k in keys if k in last), None)) is not None:
            skip.append((j, i))
        last.update(dict.fromkeys(keys, i))
    return chain, skip


class SkipChain:
    """Weights of the field: unary by feature and label, chain and skip by pair of labels."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Label probabilities by loopy sum-product. unary: log potentials; chain, skip: (edges, 2)."""
        edges = np.concatenate([chain, chain[:, ::-1], skip, skip[:, ::-1]])
        if not len(edges):
            return _softmax(unary)
        n, m = len(chain), len(skip)
        weight = np.concatenate([np.repeat(w[None], k, axis=0) for w, k in ((self.chain, n), (self.chain.T, n), (self.skip, m), (self.skip.T, m))])
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n), 2 * n + np.arange(m, 2 * m), 2 * n + np.arange(m)])
        message, before, rate = np.zeros((len(edges), len(LABELS))), 0.0, np.full((len(edges), 1), 1 - DAMPING)
        for done in itertools.count(1):
            belief = unary.copy()
            np.add.at(belief, edges[:, 1], message)
            sent = (belief[edges[:, 0]] - message[back])[:, :, None] + weight
            top = sent.max(axis=1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(sent - top).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = rate * (new - message)
            message = message + change
            if np.abs(change).max() <= SETTLED:
                break
            if done > PATIENT:
                rate[(change * before).sum(axis=1) < 0] *= 0.9
            before = change
        belief = unary.copy()
        np.add.at(belief, edges[:, 1], message)
        return _softmax(belief)

    def label(self, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
        """Spans that the field adds to each text's base spans."""
        tokens = [evidence(t) for t in texts]
        sizes = [len(x) for x in tokens]
        if not sum(sizes):
            return [[] for _ in texts]
        unary, chain, skip, at = [], [], [], 0
        for text, own, base in zip(texts, tokens, bases):
            near = _Near(base)
            unary += [self.unary[features(text, a, b, near.of(a, b))].sum(axis=0) for a, b in own]
            c, s = graph(text, own)
            chain += [(at + i, at + j) for i, j in c]
            skip += [(at + i, at + j) for i, j in s]
            at += len(own)
        p = self.marginals(np.array(unary), np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2))
        best = np.where(p.max(axis=1) >= LEAST, p.argmax(axis=1), 0)
        out, at = [], 0
        for text, own, base in zip(texts, tokens, bases):
            near, added = _Near(base), []
            for (a, b), y in zip(own, best[at : at + len(own)].tolist()):
                if not y or near.of(a, b):
                    continue
                kind = LABELS[y]
                if added and added[-1][0] == kind and kind in ("name", "phone", "card") and text[added[-1][2] : a] == " ":
                    added[-1] = (kind, added[-1][1], b)
                else:
                    added.append((kind, a, b))
            out.append(added)
            at += len(own)
        return out


class _Near:
    """The base spans that overlap ever later tokens."""

    def __init__(self, base: list[Span]):
        self.base, self.at = base, 0

    def of(self, start: int, end: int) -> list[Span]:
        while self.at < len(self.base) and self.base[self.at][2] <= start:
            self.at += 1
        out = []
        for span in self.base[self.at :]:
            if span[1] >= end:
                break
            if span[2] > start:
                out.append(span)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def labelled(sentences: int = TRAIN_SENTENCES, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Generated texts with their true spans: entities with and without cues, repeated later, among look-alikes that are none."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(2, 9)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def card() -> str:
        d = digits(15)
        d = next(d + c for c in "0123456789" if luhn(d + c))
        return rng.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    make = {
        "email": lambda: rng.choice([f"{word()}@{word()}.com", f"{word()}.{digits(2)}@{word()}{digits(1)}.example.org"]),
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice([f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)} {digits(7)}", f"0{digits(9)}"]),
        "id": lambda: rng.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{rng.choice(['DE', 'FR', 'ES'])}{digits(20)}"]),
        "name": lambda: " ".join(word().capitalize() for _ in range(rng.choice([1, 2, 2]))),
    }
    def varied(kind: str, entity: str) -> str:
        """As it is, or in a similar form."""
        if rng.random() < 0.7:
            return entity
        d = _digits(entity)
        return {"name": entity.split()[0] + rng.choice(["", "'s"]), "email": entity.upper(), "phone": f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}"}.get(kind, entity)

    no_luhn = lambda n: next(d for d in iter(lambda: digits(n), "") if not luhn(d))
    alike = (lambda: digits(rng.randint(1, 11)), lambda: no_luhn(16), lambda: no_luhn(rng.randint(12, 19)), lambda: f"{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"{rng.randint(300, 999)}.{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{word()}{digits(2)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"@{word()}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(3)}-{digits(3)}", lambda: digits(40))
    out = []
    for _ in range(sentences):
        text, spans, known = "", [], []
        for _ in range(rng.randint(2, 5)):
            text += " ".join(word() for _ in range(rng.randint(1, 8))) + " "
            roll = rng.random()
            if roll < 0.45:
                text += rng.choice(alike)() + rng.choice([" ", ". ", ", "])
                continue
            if known and roll < 0.65:
                kind, entity = rng.choice(known)
                entity, cue = varied(kind, entity), False
            else:
                kind = rng.choice(KINDS)
                entity = make[kind]()
                # Nothing but a cue tells a name from other words, and a phone's plain digits from a number.
                cue = kind == "name" or kind == "phone" and entity.replace(" ", "").isdecimal() or rng.random() < 0.5
                known.append((kind, entity))
            if cue:
                c = rng.choice(CUES[kind])
                text += (c.capitalize() if kind == "name" else c) + rng.choice([" ", ": ", ". "] if kind == "name" else [" ", ": "])
            spans.append((kind, len(text), len(text) + len(entity)))
            text += entity + rng.choice([" ", ". ", ", "])
        out.append((text, spans))
    return out


def train(data: list[tuple[str, list[Span]]]) -> SkipChain:
    """Pseudo-likelihood by gradient ascent with momentum: full passes over all tokens."""
    L = len(LABELS)
    x_rows, x_columns, y, chain, skip, at = [], [], [], [], [], 0
    for text, truth in data:
        tokens, base = evidence(text), base_spans(text)
        for i, (a, b) in enumerate(tokens):
            f = features(text, a, b, [s for s in base if s[1] < b and a < s[2]])
            x_rows += [at + i] * len(f)
            x_columns += f
            y.append(next((LABELS.index(k) for k, s, e in truth if s < b and a < e), 0))
        c, s = graph(text, tokens)
        chain += [(at + i, at + j) for i, j in c]
        skip += [(at + i, at + j) for i, j in s]
        at += len(tokens)
    n, y = at, np.array(y)
    x = np.zeros((n, len(FEATURES) + 3 * L))
    x[x_rows, x_columns] = 1
    for i, j in chain:  # the left neighbour's label, the right neighbour's, any repetition's
        x[j, len(FEATURES) + y[i]] += 1
        x[i, len(FEATURES) + L + y[j]] += 1
    for i, j in skip:
        x[j, len(FEATURES) + 2 * L + y[i]] += 1
        x[i, len(FEATURES) + 2 * L + y[j]] += 1
    w, step, gold = np.zeros((x.shape[1], L)), np.zeros((x.shape[1], L)), np.eye(L)[y]
    for _ in range(STEPS):
        step = 0.9 * step + RATE * (x.T @ (gold - _softmax(x @ w)) / n - DECAY * w)
        w += step
    w -= w.mean(axis=1, keepdims=True)
    k = len(FEATURES)
    left, right, again = w[k : k + L], w[k + L : k + 2 * L], w[k + 2 * L :]
    return SkipChain(w[:k], (left + right.T) / 2, (again + again.T) / 2)


_model: list[SkipChain] = []


def model() -> SkipChain:
    """The default field, trained once in a process."""
    if not _model:
        _model.append(train(labelled()))
    return _model[0]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, all spans and their number, of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model())
    columns = [f"n_{k}" for k in BASE]

    def make():
        field = shared.value

        def run(keys, texts):
            bases = [base_spans(t) for t in texts]
            added = field.label([t or "" for t in texts], bases)
            out = {key: keys, "base_sha256": [sha256_hex(joined(b).encode()) for b in bases], "spans": [joined(sorted(b + a, key=_order)) for b, a in zip(bases, added)], "n_spans": [len(b) + len(a) for b, a in zip(bases, added)]}
            return out | {c: [sum(s[0] == k for s in b) for b in bases] for c, k in zip(columns, BASE)}

        return run

    return map_batches(df, [key, text], f"`{key}` {df.schema[key].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in columns)}, base_sha256 string, spans string, n_spans bigint", make)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in capitals and brackets; of overlapping spans, the first's."""
    parts, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data in `text` masked, and `n_chars`, if it's there, counted anew where a text changed; order of columns stays."""
    shared = docs.sparkSession.sparkContext.broadcast(model())
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            bases = [base_spans(t) for t in texts]
            added = field.label([t or "" for t in texts], bases)
            new = [masked(t, sorted(b + a, key=_order)) if b or a else t for t, b, a in zip(texts, bases, added)]
            columns = batch.columns
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if count is not None:
                old = columns[count].to_pylist()
                columns[count] = pa.array([n if t == s or t is None else len(t) for n, t, s in zip(old, new, texts)], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
