"""Benchmark decontamination with DataFrame functions only (operator 5).

Words are runs of digits, ASCII letters (A-Z lowered) and characters above U+007F. A benchmark item's windows are its
runs of 10 words; an item of fewer words is one window. The windows' distinct hashes are a hash set that goes to the
executors with the plan; each document's windows are looked up there inside the scan, and only documents' hits leave
it. A hit is verified by its words against a table of the windows, and every word that a verified window covers is hit.

The set's size is proven before use: it's counted, and beyond SET_LIMIT windows (8 bytes each) the sets are partitioned: the
hashes of all document windows are dealt out to those of the items' windows by an equi-join, without any words, and what meets goes back to
its row, where the words are compared. The result is the same.

Defined results: null or empty text has no words; an item of null text or without words has no windows; items that
share an item_id count once; repeated rows give repeated rows; with an empty benchmark nothing is hit. Columns other
than doc_id, text and item_id are read only where documents are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

WINDOW = 10
#: Distinct windows in the hash set at most: 8 bytes each in the plan.
SET_LIMIT = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """array<string>; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows: gram (words joined by a space), h (its hash), n (words), item_ids."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).filter("size(w) > 0 and item_id is not null")
    each = w.select("item_id", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {size - 1}, 1)), i -> slice(w, i, {size}))")).alias("g"))
    return each.groupBy(F.array_join("g", " ").alias("gram"), F.size("g").alias("n")).agg(F.collect_set("item_id").alias("item_ids")).withColumn("h", _hash_of_gram())


def _hash_of_gram() -> Column:
    return F.expr("xxhash64(transform(split(gram, ' '), x -> xxhash64(x)))")


def _at(size: int) -> str:
    """The 1-based starts of the windows of `size` words in wh."""
    return f"if(size(wh) >= {size}, sequence(1, size(wh) - {size - 1}), array())"


def _starts(n: int, known: list[str] | None) -> Column:
    """The windows of n words in wh whose hash is known, or all of them: array of (at, n, h)."""
    each = f"transform({_at(n)}, i -> struct(i - 1 as at, {n} as n, xxhash64(slice(wh, i, {n})) as h))"
    return F.expr(f"filter({each}, x -> x.h IN ({', '.join(known)}))" if known else each)


def _covered(cover: Column) -> Column:
    """The positions of (at, n) windows, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(cover, lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))))


def _split(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, row (a number of the row), w (its words) and wh (their hashes)."""
    words = docs.select(*keep, words_of(F.col("text")).alias("w")).withColumn("wh", F.expr("transform(w, x -> xxhash64(x))"))
    return words.withColumn("row", F.monotonically_increasing_id())


def hits(docs: DataFrame, items: DataFrame, keep: list[str], size: int = WINDOW, set_limit: int = SET_LIMIT) -> DataFrame:
    """For every row of docs: `keep`, n_words, covered (0-based positions of hit words, sorted) and item_ids (sorted)."""
    grams = item_windows(items, size)
    sizes = grams.groupBy("n").agg(F.count("*").alias("k")).collect()  # at most `size` rows
    if sum(r.k for r in sizes) > set_limit:
        return _partitioned_hits(docs, grams, sorted(r.n for r in sizes), keep)
    known: dict[int, list[str]] = {}
    for r in grams.select("n", "h").collect():
        known.setdefault(r.n, []).append(f"{r.h}L")
    each_size = [_starts(n, own) for n, own in sorted(known.items())]
    found = F.concat(*each_size) if each_size else F.expr("array(struct(0 as at, 0 as n, 0L as h))").cast("array<struct<at:int,n:int,h:bigint>>")
    told = _split(docs, keep).select("row", *keep, F.size("w").alias("n_words"), F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["h"].alias("h"), F.array_join(F.slice("w", x["at"] + 1, x["n"]), " ").alias("gram"))).alias("found"))
    each = told.select("row", *keep, "n_words", F.explode_outer("found").alias("x")).select("row", *keep, "n_words", "x.*")
    sure = each.join(F.broadcast(grams), ["n", "h", "gram"], "left")  # set_limit rows at most
    cover = F.when(F.col("item_ids").isNotNull(), F.struct("at", "n"))
    by_row = sure.groupBy("row").agg(*(F.first(c).alias(c) for c in [*keep, "n_words"]), F.collect_set(cover).alias("cover"), F.collect_set("item_ids").alias("item_ids"))
    return by_row.select(*keep, "n_words", _covered(F.col("cover")).alias("covered"), F.array_sort(F.array_distinct(F.flatten("item_ids"))).alias("item_ids"))


def _partitioned_hits(docs: DataFrame, grams: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """hits() for any number of windows: rows are numbered and written, and only hashes are joined to the windows."""
    rows = durable(_split(docs, keep))
    known = durable(grams)
    windows = rows.select("row", F.explode(F.concat(*(_starts(n, None) for n in sizes))).alias("x")).select("row", "x.*")
    met = windows.join(known, ["n", "h"]).groupBy("row").agg(F.collect_list(F.struct("at", "n", "gram", "item_ids")).alias("found"))  # of one text
    sure = F.filter(F.coalesce("found", F.array()), lambda x: F.array_join(F.slice("w", x["at"] + 1, x["n"]), " ") == x["gram"])
    told = rows.join(met, "row", "left").select(*keep, F.size("w").alias("n_words"), sure.alias("sure"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("sure", lambda x: x["item_ids"]))))
    return told.select(*keep, "n_words", _covered(F.col("sure")).alias("covered"), ids.alias("item_ids"))


def decontaminate_report(docs: DataFrame, items: DataFrame, size: int = WINDOW, set_limit: int = SET_LIMIT) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs."""
    found = hits(docs, items, ["doc_id"], size, set_limit)
    n_hit = F.size("covered").cast("bigint")
    return found.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, set_limit: int = SET_LIMIT) -> DataFrame:
    """docs without the rows that contain a window of an item; columns and their order stay.

    Up to set_limit windows, hashes and words are both looked up inside the scan and nothing is shuffled. Beyond it,
    rows are numbered and written, each is judged by its own text in hits(), and they leave by an anti-join on the number.
    """
    grams = item_windows(items, size)
    if grams.count() > set_limit:
        numbered = durable(docs.select(F.struct(*docs.columns).alias("d"), F.monotonically_increasing_id().alias("own")))
        bad = hits(numbered.select("own", F.col("d.text").alias("text")), items, ["own"], size, set_limit).filter("size(covered) > 0")
        return numbered.join(bad.select("own"), "own", "left_anti").select(*(F.col(f"d.`{c}`").alias(c) for c in docs.columns))
    by_size: dict[int, list] = {}
    for r in grams.select("n", "h", "gram").collect():
        by_size.setdefault(r.n, []).append(r)
    if not by_size:
        return docs
    columns = [F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    split = docs.select(F.struct(*docs.columns).alias("d"), words_of(F.col("text")).alias("w")).withColumn("wh", F.expr("transform(w, x -> xxhash64(x))"))
    found = F.concat(*(_starts(n, [f"{r.h}L" for r in rows]) for n, rows in sorted(by_size.items())))
    known = ", ".join(f"'{r.gram}'" for rows in by_size.values() for r in rows)  # words have no quotes or backslashes
    told = split.select("d", "w", found.alias("found"))
    # The filter looks at the row number, so that it isn't pushed below, where the words would be split again for each window.
    judged = told.select("d", F.expr(f"exists(found, x -> array_join(slice(w, x.at + 1, x.n), ' ') IN ({known}))").alias("bad"), F.monotonically_increasing_id().alias("row"))
    return judged.filter("not bad and row >= 0").select(*columns)


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
#: The same rows as decontaminate_report()'s.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS k FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS gram FROM s),
p AS (SELECT id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g)),
h AS (SELECT id, k, n, item_id FROM (SELECT id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM p) JOIN g USING (n, gram)),
c AS (SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY id),
t AS (SELECT id, list_sort(list(DISTINCT item_id)) AS items FROM h GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (id) LEFT JOIN t USING (id)
"""
