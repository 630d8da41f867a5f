"""The sequential text operators: sentences with abbreviations, chunks with overlap, reflow of printed lines."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed value that results depend on.
ABBREVIATIONS = frozenset("no vs etc fig figs approx dr mr mrs ms st jr sr prof inc ltd co corp dept est cf al e.g i.e a.m p.m u.s u.k vol eq ref sec".split())

_BOUNDARY = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_HEADING = re.compile(r"#{1,6}[ \t]+[^\n]*")


def split_sentences(text: str) -> list[str]:
    """Sentences end at . ! or ? before white space, but not after a listed abbreviation or a single letter."""
    out, start = [], 0
    for m in _BOUNDARY.finditer(text):
        left = text[max(start, m.start() - 40) : m.start()]
        word = re.search(r"([A-Za-z][A-Za-z.]*)\.$", left)
        if word and (len(w := word[1].lower().rstrip(".")) == 1 or w in ABBREVIATIONS):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    out.append(text[start:].strip())
    return [s for s in out if s]


def join_sentences(sentences: Iterable[str]) -> str:
    """Sentences joined by a space; a heading alone keeps its line end."""
    out = ""
    for s in sentences:
        out += ("" if not out else "\n" if _HEADING.fullmatch(last) else " ") + s
        last = s
    return out


def chunk_text(text: str, size: int = 220, overlap: int = 40, least: int = 25) -> list[str]:
    """Sentence-aligned chunks of about `size` words that share about `overlap` words.

    A chunk is a range of the sentence list, so the state is two indexes over prefix sums of word counts. A sentence
    of `size` words or more is a chunk of its own, and what a chunk before it would have shared comes once more.
    The last sentence of a chunk is always shared, however long, unless `overlap` is 0: then nothing is. A last chunk of
    under `least` words joins the one before it if both fit in `size`.
    """
    if overlap >= size:
        raise ValueError("chunk_overlap must be smaller than chunk_size")
    sentences = [s for p in re.split(r"\n\s*\n", text) if p.strip() for s in split_sentences(p.strip())]
    counts = [len(s.split()) for s in sentences]
    total = [0, *accumulate(counts)]

    def tail(start: int, end: int) -> int:
        """Where the overlap of sentences start..end begins."""
        if overlap <= 0:
            return end
        at = end - 1
        while at > start and total[end] - total[at - 1] <= overlap:
            at -= 1
        return at

    ranges: list[tuple[int, int]] = []
    start = end = 0
    for i, n in enumerate(counts):
        if n >= size:
            if start < end:
                ranges += [r for r in ((start, end), (tail(start, end), end)) if r[0] < r[1]]
            ranges.append((i, i + 1))
            start = i + 1
        elif start < end and total[end] - total[start] + n > size:
            ranges.append((start, end))
            start = tail(start, end)
        end = i + 1
    if start < end:
        ranges.append((start, end))
    chunks = [join_sentences(sentences[a:b]) for a, b in ranges]
    if len(chunks) > 1 and len(chunks[-1].split()) < least and len(chunks[-2].split()) + len(chunks[-1].split()) <= size:
        chunks[-2:] = [f"{chunks[-2]} {chunks[-1]}"]
    return [c for c in chunks if c.strip()]


def reflow(page: str) -> str:
    """Paragraphs of a page's printed lines; short lines that stand like headings get # marks, the page's first one mark."""
    lines = [line.strip() for line in page.split("\n")]
    parts: list[str] = []
    held, before, headed = "", "", False

    def is_heading(i: int) -> bool:
        line = lines[i]
        after = next((x for x in lines[i + 1 :] if x), "")
        return len(line.split()) <= 8 and line[-1] not in ".!?:;," and (not before or before[-1] in ".!?:;") and after[:1].isupper()

    for i, line in enumerate(lines):
        if not line:
            parts.append(held)
            held = ""
            continue
        if is_heading(i):
            parts.append(held)
            held, headed = f"{'##' if headed else '#'} {line}\n", True
        else:
            held += line if not held or held[-1] in "-\n" else f" {line}"
        before = line
    return "\n\n".join(p for p in [*parts, held] if p)


@F.pandas_udf(ArrayType(StringType()))
def sentences_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: split_sentences(t or ""))


def chunks_udf(size: int = 220, overlap: int = 40, least: int = 25):
    """The chunker as an Arrow-batched column function."""
    if overlap >= size:
        raise ValueError("chunk_overlap must be smaller than chunk_size")

    @F.pandas_udf(ArrayType(StringType()))
    def chunk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t or "", size, overlap, least))

    return chunk


@F.pandas_udf(StringType())
def reflow_udf(pages: pd.Series) -> pd.Series:
    return pages.map(lambda t: None if t is None else reflow(t))
