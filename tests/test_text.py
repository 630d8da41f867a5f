"""Text functions and the sequential operators, on hand-checked inputs."""

import pytest
from pyspark.sql import functions as F

from fernweave.functions import sentences as S
from fernweave.functions import text as T


def one(spark, column, *values, names="abcdef"):
    return spark.createDataFrame([tuple(values)], list(names[: len(values)])).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ('He said "go." She left.', ['He said "go."', "She left."]),
        ("Dr. Smith met e.g. Mr. Jones. Done.", ["Dr. Smith met e.g. Mr. Jones.", "Done."]),
        ("Section 3a. Next", ["Section 3a. Next"]),
        ("No. 4. Then", ["No. 4.", "Then"]),
        ("", []),
    ],
)
def test_sentences(text, want):
    assert S.split_sentences(text) == want


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n - 1)) + f" {tag}end."


def test_chunks_cover_and_overlap():
    sentences = [words(4, f"s{i}") for i in range(20)]
    chunks = S.chunk_text(" ".join(sentences), 12, 4, 2)
    assert all(any(s in c for c in chunks) for s in sentences)
    assert all(len(c.split()) <= 12 for c in chunks)
    assert all(set(a.split()) & set(b.split()) for a, b in zip(chunks, chunks[1:]))


def test_oversized_sentence_repeats_the_overlap_before_it():
    chunks = S.chunk_text(f"{words(5, 'a')} {words(30, 'b')} {words(5, 'c')}", 20, 5, 1)
    assert [c.split()[-1] for c in chunks] == ["aend.", "aend.", "bend.", "cend."]


def test_long_tail_may_exceed_the_size():
    chunks = S.chunk_text(f"{words(3, 'a')} {words(18, 'b')} {words(10, 'c')}", 20, 5, 1)
    assert max(len(c.split()) for c in chunks) == 28


def test_short_last_chunk_joins_only_if_it_fits():
    assert len(S.chunk_text(f"{words(10, 'a')} {words(10, 'b')} {words(2, 'c')}", 20, 0, 5)) == 2
    assert S.chunk_text("", 20, 5, 1) == []
    with pytest.raises(ValueError):
        S.chunk_text("x", 5, 5)


def test_reflow():
    page = "Leave Policy\nEmployees become eligible after a\nthree month allow-\nance period.\n\nNext Part\nAll of it."
    assert S.reflow(page) == "# Leave Policy\nEmployees become eligible after a three month allow-ance period.\n\n## Next Part\nAll of it."


def test_tokens(spark):
    assert one(spark, T.tokenize(F.col("a")), "The berth is at No. 4") == ["berth", "no", "4"]
    assert one(spark, T.tokenize(F.col("a")), "café") == ["caf"]
    assert one(spark, T.grams(F.col("a")), "The cat sat") == ["the", "cat", "sat", "the_cat", "cat_sat"]
    assert one(spark, T.grams(F.col("a")), "") == []
    assert one(spark, T.content_words(F.col("a")), "Is it 64 or the large large ship") == ["large", "ship"]
    assert one(spark, T.word_count(F.col("a")), "a b\x1cc d") == 4


def test_citations(spark):
    assert one(spark, T.parse_citations(F.col("a"), 3), "Claim [2]. Another [1]. Repeat [2].") == [2, 1]
    assert one(spark, T.strip_invalid_citations(F.col("a"), 3), "A [1] and B [9].") == "A [1] and B ."
    assert one(spark, T.strip_invalid_citations(F.col("a"), 0), "A [1].") == "A ."


def test_whitespace_titles_and_names(spark):
    assert one(spark, T.normalize_whitespace(F.col("a")), "a\r\n\r\n\r\n\r\nb \t c\n") == "a\n\nb c"
    assert one(spark, T.title(F.col("a"), F.col("b")), "# Big  \nx", "f.md") == "Big"
    assert one(spark, T.title(F.col("a"), F.col("b")), "x", "dir/my_file-name.md") == "my file name"
    assert one(spark, T.doc_id_of(F.col("a")), "a.md") == "5d48a79a3e66"
    assert one(spark, T.strip_headings(F.col("a"), F.col("b")), "# A.b (c)\nText ## Part\nmore", "A.b (c)") == "Text  more"


def test_failures():
    assert T.failure_reason("HTTP 503") == T.FAILURES[0][1]
    assert T.failure_reason("odd") == T.OTHER_FAILURE
    assert T.is_retryable("429") and T.is_retryable("internal error", True) and not T.is_retryable("internal error")


def test_without_overlap_nothing_is_shared():
    assert S.chunk_text("aa bb cc. dd ee ff. gg hh ii. jj kk ll.", 6, 0, 1) == ["aa bb cc. dd ee ff.", "gg hh ii. jj kk ll."]
    assert S.chunk_text(f"{words(5, 'a')} {words(30, 'b')} {words(5, 'c')}", 20, 0, 1) == [words(5, "a"), words(30, "b"), words(5, "c")]


def test_retry_marks():
    for mark in ("resource_exhausted", "Deadline exceeded", "503", "rate limit"):
        assert T.is_retryable(mark)
    assert not T.is_retryable("502 overloaded")


def test_prompts_are_parsed(spark):
    prompt = "Question: Who? \n\nContext passages:\n\n[1] A - B - a.md\nText one.\nMore [2] here.\n\n[12] Plain\n[3]\n"
    told = one(spark, T.parse_prompt(F.col("a")), prompt)
    assert told.question == "Who?" and [tuple(p) for p in told.passages] == [(1, "A - B", "Text one.\nMore [2] here."), (12, "Plain", ""), (3, "", "")]
    assert one(spark, T.parse_prompt(F.col("a")), "nothing").passages == []
