"""Text functions on columns: built-in expressions throughout, so that they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
STOP_WORDS = "a an and are as at be but by for from has have how in into is it its of on or that the their there these this to was were what when where which who why will with".split()
CONTENT_STOP_WORDS = "a an and are as at be by did do does for from how in is it of on or that the to was were what when where which who why with".split()
TAIL_SECTIONS = "See also|References|External links|Further reading|Notes|Bibliography|Sources|Citations"
INSUFFICIENT_CONTEXT = "INSUFFICIENT_CONTEXT"

#: White space as Python's str.split() has it.
SPACE = r"(?U)[\s\x1c-\x1f]"
WORD = r"(?U)[^\s\x1c-\x1f]+"
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, _ENDS, "")


def normalize_whitespace(x: Column) -> Column:
    """Line ends to LF, runs of blanks to one, at most one empty line, no white space at the ends."""
    x = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def stem(name: Column) -> Column:
    """A file name without folder and suffix."""
    base = F.regexp_replace(name, r"^.*/", "")
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def title(text: Column, name: Column) -> Column:
    """A heading that the text starts with, else the file's stem in words."""
    heading = strip(F.regexp_extract(text, r"^\s*#\s+(.+)", 1))
    return F.coalesce(F.nullif(heading, F.lit("")), F.translate(stem(name), "_-", "  "))


def page_title(html: Column) -> Column:
    """The title element of a web page, white space collapsed; empty if there is none."""
    return strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def page_text(html: Column) -> Column:
    """A web page's text: scripts, styles, comments and tags out, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def paragraphs(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"\n\s*\n"), strip), lambda p: p != "")


def naive_sentences(x: Column) -> Column:
    """Pieces between white space that follows . ! or ?, white space collapsed, none empty."""
    collapse = lambda s: strip(F.regexp_replace(s, r"\s+", " "))
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+"), collapse), lambda s: s != "")


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(WORD))


def raw_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1))


def tokenize(x: Column) -> Column:
    """Lower-case runs of a-z and 0-9 without stop words; repetitions stay."""
    return F.filter(raw_tokens(x), lambda t: ~t.isin(STOP_WORDS))


def grams(x: Column) -> Column:
    """All tokens, stop words too, then each with its successor as a_b."""
    tokens = raw_tokens(x)
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.concat(tokens, pairs)


def content_words(x: Column) -> Column:
    """The set of tokens of three characters or more that carry content."""
    return F.array_distinct(F.filter(raw_tokens(x), lambda t: (F.length(t) > 2) & ~t.isin(CONTENT_STOP_WORDS)))


def strip_headings(x: Column, heading: Column) -> Column:
    """Text without its leading title line, heading lines and leftover heading marks."""
    quoted = F.concat(F.lit(r"^\s*#{1,6}\s*\Q"), heading, F.lit(r"\E\s*"))
    x = F.when(heading.isNull() | (heading == ""), x).otherwise(F.regexp_replace(x, quoted, F.lit("")))
    return F.regexp_replace(F.regexp_replace(x, r"#{1,6}[ \t]+[^\n]*\n", " "), r"#{1,6}\s+", "")


def preview(x: Column, characters: int = 400) -> Column:
    marks = F.regexp_replace(x, r"(^|\s)#{1,6}\s+", "$1")
    return F.substring(strip(F.regexp_replace(marks, r"\s+", " ")), 1, characters)


def safe_filename(name: Column) -> Column:
    """A base name of harmless characters: stem of 120 at most, `document` if none is left, suffix in lower case."""
    base = F.regexp_replace(name, r"^.*/", "")
    suffix = F.lower(F.regexp_extract(base, r"(?<=.)(\.[^.]+)$", 1))
    clean = F.regexp_replace(F.regexp_replace(stem(base), r"[^A-Za-z0-9._ -]+", "_"), r"^[ ._]+|[ ._]+$", "")
    return F.concat(F.coalesce(F.nullif(F.substring(clean, 1, 120), F.lit("")), F.lit("document")), suffix)


def slugify(x: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), F.lit(".md"))


def wiki_clean(x: Column) -> Column:
    """Wiki text up to the first tail section, headings as # marks, at most one empty line."""
    x = F.regexp_replace(x, rf"(?is)\n==+\s*(?:{TAIL_SECTIONS})\s*==+.*$", "")
    for marks, heading in ((5, "####"), (4, "###"), (3, "###"), (2, "##")):
        x = F.regexp_replace(x, rf"(?m)^={{{marks}}}\s*(.+?)\s*={{{marks}}}$", f"{heading} $1")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def parse_citations(x: Column, most: Column | int) -> Column:
    """Numbers of [n] markers in 1..most, in order of first appearance."""
    most = F.lit(most) if isinstance(most, int) else most
    numbers = F.transform(F.regexp_extract_all(x, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda d: d.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= most)))


def strip_invalid_citations(x: Column, most: int) -> Column:
    """Text without [n] markers out of 1..most."""
    valid = "|".join(map(str, range(1, most + 1)))
    return F.regexp_replace(x, rf"\[(?!0?(?:{valid})\])\d{{1,2}}\]" if valid else r"\[\d{1,2}\]", "")


def build_prompt(question: Column, contexts: Column) -> Column:
    """The question and its numbered passages; contexts: array of struct(title, source, text)."""
    passages = F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["title"], F.lit(" - "), c["source"], F.lit("\n"), c["text"], F.lit("\n")))
    return strip(F.concat(F.lit("Question: "), question, F.lit("\n\nContext passages:\n\n"), F.array_join(passages, "\n")))


def parse_prompt(x: Column) -> Column:
    """struct(question, passages array of struct(marker, title, text)) of a prompt of build_prompt()'s form. A line that begins with [n] begins a passage; its title ends at the header's last dash."""
    marked = F.filter(F.split(x, r"(?m)^(?=\[\d+\])"), lambda b: F.regexp_like(b, F.lit(r"^\[\d+\]")))

    def passage(block: Column) -> Column:
        body = strip(F.regexp_replace(block, r"^\[\d+\]", ""))
        header = F.substring_index(body, "\n", 1)
        title = F.when(header.contains(" - "), F.regexp_extract(header, r"^(.*) - ", 1)).otherwise(header)
        rest = F.when(body.contains("\n"), F.regexp_replace(body, r"^[^\n]*\n", "")).otherwise("")
        return F.struct(F.regexp_extract(block, r"^\[(\d+)\]", 1).cast("int").alias("marker"), strip(title).alias("title"), strip(rest).alias("text"))

    return F.struct(strip(F.regexp_extract(x, r"Question:\s*(.+)", 1)).alias("question"), F.transform(marked, passage).alias("passages"))


def doc_id_of(key: Column) -> Column:
    return F.substring(F.sha1(key), 1, 12)


# What a failure's message has, and the notice that answers then carry.
FAILURES = (
    (("503", "unavailable", "high demand"), "it is overloaded right now"),
    (("429", "resource_exhausted", "rate limit"), "the free-tier rate limit was reached"),
    (("api key", "api_key", "401", "403"), "the API key was rejected"),
    (("timeout", "deadline"), "it timed out"),
)
OTHER_FAILURE = "it returned an error"
# Marks of failures that are tried again; a hosted answering model has one more.
RETRYABLE = ("429", "rate limit", "resource_exhausted", "503", "500", "unavailable", "deadline")
RETRYABLE_ANSWERING = (*RETRYABLE, "internal error")


def failure_reason(message: str) -> str:
    """The kind of a backend's failure: the first whose marks its message has."""
    low = message.lower()
    return next((reason for marks, reason in FAILURES if any(m in low for m in marks)), OTHER_FAILURE)


def is_retryable(message: str, answering: bool = False) -> bool:
    low = message.lower()
    return any(m in low for m in (RETRYABLE_ANSWERING if answering else RETRYABLE))
