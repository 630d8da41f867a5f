"""Chat formatting by quotation linking, with DataFrame functions only (operator 8).

A line's quote level is the number of `>` that it starts with; successive lines of one level of at least 1 are a quoted
passage. Passages are normalised (lower case, white space collapsed), hashed, and joined to the first message of the
same conversation that has the passage, or one of its lines, unquoted; the texts are compared as well. A message replies to what
its outermost, then first, linked passage quotes, if that's an earlier turn. Replies hang below the message that they
quote: `thread` is the first turn of the chain, `depth` the links to it, and conversations are ordered by thread,
depth and turn. `content` is the message without quotes, `formatted` its chat form.

Originals are pre-aggregated to one row for each text of a conversation before they meet the quotes, so that a line
that many messages share pairs each quote with one row. Threads come from pointer doubling: as many rounds as
the logarithm of the longest chain, each ended by files in the shared folder. No conversation is gathered in one task.

Defined results: null text counts as empty; null conv_id or turn never links, and such a row is its own thread; rows with the same
conv_id and turn share their links; repeated rows give repeated rows; an empty table gives an empty table; other
columns than conv_id, turn, role and text are not read. Carriage returns count as white space at a line's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, durable, durable_at

PREFIX = r"^(?:[ \t]*>)+[ \t]?"
KEYS = ["conv_id", "turn"]


def _normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[ \t\r\n\f\x0B]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, own (normalised unquoted lines), passages (at, level, lines: normalised). No shuffle."""
    lines = messages.select(*KEYS, "role", F.split(F.coalesce("text", F.lit("")), "\n").alias("line"))
    prefix = F.transform("line", lambda x: F.regexp_extract(x, PREFIX, 0))
    told = lines.withColumn("prefix", prefix).select(*KEYS, "role", F.transform("prefix", lambda p: F.length(p) - F.length(F.replace(p, F.lit(">"), F.lit("")))).alias("level"), F.zip_with("line", "prefix", lambda x, p: F.substring(x, F.length(p) + 1, F.length(x))).alias("body"))
    starts = F.expr("filter(sequence(1, size(level)), i -> level[i - 1] > 0 and (i = 1 or level[i - 2] <> level[i - 1]))")
    ends = F.expr("filter(sequence(1, size(level)), i -> level[i - 1] > 0 and (i = size(level) or level[i] <> level[i - 1]))")
    plain = F.expr("filter(body, (b, i) -> level[i] = 0)")
    runs = told.select(*KEYS, "role", "body", "level", starts.alias("starts"), ends.alias("ends"), plain.alias("plain"))
    texts = lambda xs: F.filter(F.transform(xs, _normal), lambda x: x != "")
    passages = F.zip_with("starts", "ends", lambda a, b: F.struct(a.alias("at"), F.element_at("level", a).alias("level"), texts(F.slice("body", a, b - a + 1)).alias("lines")))
    content = F.regexp_replace(F.array_join("plain", "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return runs.select(*KEYS, "role", content.alias("content"), texts("plain").alias("own"), passages.alias("passages"))


def _sortable(x: Column) -> Column:
    """A number as text that sorts like it: 19 digits, and negative ones counted from the least after a minus, which comes before any digit."""
    least = F.lit(-(1 << 63))
    return F.when(x < 0, F.concat(F.lit("-"), F.lpad((x.cast("bigint") - least).cast("string"), 19, "0"))).otherwise(F.lpad(x.cast("string"), 19, "0"))


def _units(x: Column) -> Column:
    """A passage's whole text (0), then its lines (1, 2, ...), without repetitions."""
    whole = F.when(F.size(x) > 0, F.array(F.array_join(x, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(whole, x))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of the messages that quote an earlier one. messages: from parsed()."""
    originals = messages.select(*KEYS, F.explode(_units(F.col("own"))).alias("unit")).filter("conv_id is not null and turn is not null")
    first = originals.groupBy("conv_id", F.xxhash64("unit").alias("h"), "unit").agg(F.min("turn").alias("source"))
    quoted = messages.filter("conv_id is not null and turn is not null").select(*KEYS, F.explode("passages").alias("p"))
    wanted = quoted.select(*KEYS, "p.at", "p.level", F.posexplode(_units(F.col("p.lines"))).alias("k", "unit")).withColumn("h", F.xxhash64("unit"))
    found = wanted.join(first, ["conv_id", "h", "unit"]).filter("source < turn")
    best = F.min_by("source", F.struct("level", "at", "k")).alias("reply_to")
    return found.groupBy(*KEYS).agg(best, F.count_distinct("at").alias("n_linked"))


def threads(link: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, thread, depth) of the linked messages, by pointer doubling."""
    spark = link.sparkSession
    now, path = durable_at(link.select(*KEYS, F.col("reply_to").alias("thread"), F.lit(1).cast("bigint").alias("depth")))
    for _ in range(most_rounds):
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"), F.col("depth").alias("more"))
        if now.join(up, ["conv_id", "thread"], "left_semi").isEmpty():
            return now
        after = now.join(up, ["conv_id", "thread"], "left").select(*KEYS, F.coalesce("higher", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        after, after_path = durable_at(after)
        drop(spark, path)
        now, path = after, after_path
    raise RuntimeError(f"reply chains did not settle in {most_rounds} rounds")


def conversations(messages: DataFrame) -> DataFrame:
    """Every message without quotes: conv_id, turn, role, content, formatted, n_quoted, n_linked, reply_to, thread, depth, reply_order."""
    own = durable(parsed(messages))  # read three times
    link = durable(links(own))
    told = own.select(*KEYS, "role", "content", F.size("passages").cast("bigint").alias("n_quoted"))
    joined = told.join(link, KEYS, "left").join(threads(link), KEYS, "left")
    thread, depth = F.coalesce("thread", "turn"), F.coalesce("depth", F.lit(0))
    order = F.concat_ws("/", *map(_sortable, (thread, depth, F.col("turn"))))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("content"), F.lit("\n"))
    return joined.select(*KEYS, "role", "content", formatted.alias("formatted"), "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to", thread.alias("thread"), depth.alias("depth"), order.alias("reply_order"))


_NORMAL = r"trim(regexp_replace(lower({}), '[ \t\r\n\f\x0B]+', ' ', 'g'))"
_sorted = lambda x: f"CASE WHEN {x} < 0 THEN '-' || lpad(CAST(CAST({x} AS HUGEINT) + 9223372036854775808 AS VARCHAR), 19, '0') ELSE lpad(CAST({x} AS VARCHAR), 19, '0') END"
ORACLE = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS line FROM conversations),
l AS (SELECT id, conv_id, turn, unnest(line) AS line, generate_subscripts(line, 1) AS i FROM m),
p AS (SELECT *, regexp_extract(line, '{PREFIX}') AS prefix FROM l),
b AS (SELECT id, conv_id, turn, i, CAST(length(prefix) - length(replace(prefix, '>', '')) AS BIGINT) AS level, substr(line, length(prefix) + 1) AS body FROM p),
r AS (SELECT *, {_NORMAL.format('body')} AS n, CASE WHEN level > 0 AND level IS DISTINCT FROM lag(level) OVER (PARTITION BY id ORDER BY i) THEN i END AS start FROM b),
s AS (SELECT *, last_value(start IGNORE NULLS) OVER (PARTITION BY id ORDER BY i) AS pos FROM r),
own AS (SELECT id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS content, coalesce(list(n ORDER BY i) FILTER (level = 0 AND n <> ''), []) AS lines, count(DISTINCT pos) FILTER (level > 0) AS n_quoted FROM s GROUP BY id),
originals AS (SELECT conv_id, turn, unnest(lines || CASE WHEN len(lines) > 0 THEN [array_to_string(lines, ' ')] ELSE [] END) AS unit FROM own WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
firsts AS (SELECT conv_id, unit, min(turn) AS source FROM originals GROUP BY ALL),
passages AS (SELECT id, conv_id, turn, pos, level, list(n ORDER BY i) FILTER (n <> '') AS lines FROM s WHERE level > 0 GROUP BY ALL),
wanted AS (SELECT conv_id, turn, pos, level, 0 AS k, array_to_string(lines, ' ') AS unit FROM passages WHERE len(lines) > 0
           UNION ALL SELECT conv_id, turn, pos, level, generate_subscripts(lines, 1), unnest(lines) FROM passages),
found AS (SELECT w.*, source FROM wanted w JOIN firsts f ON w.conv_id = f.conv_id AND w.unit = f.unit AND source < w.turn),
links AS (SELECT conv_id, turn, arg_min(source, (level, pos, k)) AS reply_to, count(DISTINCT pos) AS n_linked FROM found GROUP BY ALL),
up AS (SELECT conv_id, turn, reply_to AS thread, CAST(1 AS BIGINT) AS depth FROM links
       UNION ALL SELECT u.conv_id, u.turn, k.reply_to, u.depth + 1 FROM up u JOIN links k ON k.conv_id = u.conv_id AND k.turn = u.thread),
tops AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM up GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, content, '<|' || coalesce(m.role, '') || '|>' || chr(10) || content || chr(10) AS formatted, n_quoted,
       coalesce(n_linked, 0) AS n_linked, reply_to, coalesce(thread, m.turn) AS thread, coalesce(depth, 0) AS depth,
       concat_ws('/', {_sorted('coalesce(thread, m.turn)')}, {_sorted('coalesce(depth, 0)')}, {_sorted('m.turn')}) AS reply_order
FROM m JOIN own USING (id) LEFT JOIN links k ON k.conv_id = m.conv_id AND k.turn = m.turn LEFT JOIN tops t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""
