"""DuckDB SQL of the queries, over the same tables."""

from __future__ import annotations

from ..functions.sentences import ABBREVIATIONS
from ..functions.text import CONTENT_STOP_WORDS, INSUFFICIENT_CONTEXT, STOP_WORDS, TAIL_SECTIONS
from ..operators.answer import NO_ANSWER, NOTHING_FOUND
from .queries import _WIKI


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _tokens(x: str, stop: list[str] | None = STOP_WORDS, least: int = 1) -> str:
    raw = f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    return raw if stop is None else f"list_filter({raw}, lambda t: t NOT IN ({_list(stop)}) AND length(t) >= {least})"


def _grams(x: str) -> str:
    raw = _tokens(x, None)
    return f"list_concat({raw}, list_transform(list_zip(({raw})[:-2], ({raw})[2:]), lambda p: p[1] || '_' || p[2]))"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x1c-\x1f\x0b\x85\xa0]+|[\s\x1c-\x1f\x0b\x85\xa0]+$', '', 'g')"


def _collapse(x: str) -> str:
    return _strip(rf"regexp_replace({x}, '[ \t\n\x0B\f\r]+', ' ', 'g')")


def _sentences(x: str) -> str:
    cut = rf"string_split(regexp_replace({x}, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {_collapse('s')}), lambda s: s <> '')"


def _headings_off(x: str, title: str) -> str:
    lead = f"CASE WHEN coalesce({title}, '') = '' THEN {x} ELSE regexp_replace({x}, '^\\s*#{{1,6}}\\s*' || regexp_escape({title}) || '\\s*', '') END"
    return f"regexp_replace(regexp_replace({lead}, '#{{1,6}}[ \\t]+[^\\n]*\\n', ' ', 'g'), '#{{1,6}}\\s+', '', 'g')"


_PASSAGES = "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id AS pos, source AS title, source, lang, text FROM documents"
_QUESTIONS = "SELECT CAST(item_id AS VARCHAR) AS qid, text AS question FROM benchmark"
_TOKENS = f"SELECT chunk_id, pos, {_tokens("concat(title, ' ', text)")} AS tokens FROM passages"
_BASE = f"passages AS ({_PASSAGES}), questions AS ({_QUESTIONS}), tokens AS ({_TOKENS})"
_STATS = """df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM tokens) GROUP BY term),
size AS (SELECT count(*) AS n_chunks, avg(len(tokens)) AS avgdl FROM tokens),
raw AS (SELECT term, df, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS idf FROM df, size),
mean AS (SELECT avg(idf) AS avg_idf FROM raw),
terms AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * avg_idf ELSE idf END AS idf FROM raw, mean)"""


def _lexical(k: int = 20) -> str:
    return f"""{_BASE}, {_STATS},
asked AS (SELECT qid, unnest(t) AS term, generate_subscripts(t, 1) AS qpos FROM (SELECT qid, {_tokens('question')} AS t FROM questions)),
tf AS (SELECT term, chunk_id, pos, dl, count(*) AS tf FROM (SELECT chunk_id, pos, len(tokens) AS dl, unnest(tokens) AS term FROM tokens) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
part AS (SELECT qid, chunk_id, pos, qpos, idf * tf * (1.5 + 1) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS x FROM asked JOIN tf USING (term) JOIN terms USING (term), size),
scored AS (SELECT qid, chunk_id, pos, list_reduce(list(x ORDER BY qpos), lambda a, b: a + b) AS score FROM part GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pos) AS INTEGER) AS rank FROM scored) WHERE rank <= {k} AND score > 0)"""


def _sparse(x: str, key: str, dim: int, source: str) -> str:
    """key, i, w: signed counts of hashed grams."""
    return f"SELECT {key}, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {dim} AS i, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END) AS w FROM (SELECT {key}, md5(unnest({_grams(x)})) AS h FROM {source}) GROUP BY ALL"


_HASHED = f"""dv AS ({_sparse('text', 'chunk_id, pos', 512, 'passages')}), qv AS ({_sparse('question', 'qid', 512, 'questions')}),
dn AS (SELECT chunk_id, sqrt(sum(w * w)) AS n FROM dv GROUP BY ALL), qn AS (SELECT qid, sqrt(sum(w * w)) AS n FROM qv GROUP BY ALL),
dots AS (SELECT qid, chunk_id, pos, sum(qv.w * dv.w) AS dot FROM qv JOIN dv USING (i) GROUP BY ALL),
sims AS (SELECT qid, chunk_id, pos, round(dot / (dn.n * qn.n), 9) AS score FROM dots JOIN dn USING (chunk_id) JOIN qn USING (qid)),
dense AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS INTEGER) AS rank FROM sims) WHERE rank <= 20)"""


def _fused(k: int = 60, dense: float = 1.0, lexical: float = 1.0) -> str:
    return f"""both_ AS (SELECT 'dense' AS source, qid, chunk_id, score AS raw, rank, {dense}::DOUBLE / ({k} + rank) AS part FROM dense UNION ALL SELECT 'lexical', qid, chunk_id, score, rank, {lexical}::DOUBLE / ({k} + rank) FROM lexical),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM (SELECT qid, chunk_id, list_reduce(list(part ORDER BY source), lambda a, b: a + b) AS score FROM both_ GROUP BY ALL))"""


_ALL = f"{_lexical()}, {_HASHED}, {_fused()}"
_ONE = "SELECT qid, chunk_id, round(score, 6) AS score, rank FROM"
_SINGLE = """SELECT 'dense' AS source, qid, chunk_id, round(1.0::DOUBLE / (60 + rank), 6) AS score, rank FROM dense WHERE rank <= 5
UNION ALL SELECT 'lexical', qid, chunk_id, round(1.0::DOUBLE / (60 + rank), 6), rank FROM lexical WHERE rank <= 5"""
_RELEVANT = "relevant AS (SELECT qid, chunk_id AS id FROM passages, questions WHERE contains(text, question))"


def _each(name: str, hits: str, k: int = 5, relevant: str = "relevant", asked: str = "questions", extra: str = "") -> str:
    """CTE `name` of the metrics of hits (qid, id, rank)."""
    return f"""{name} AS (SELECT qid{extra}, CAST(coalesce(f, 0) > 0 AS INTEGER) AS hit, CASE WHEN coalesce(m, 0) > 0 THEN coalesce(f, 0) / m ELSE 0.0::DOUBLE END AS recall, coalesce(f, 0) / {k} AS precision,
CASE WHEN coalesce(m, 0) > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least({k}, m) + 1), lambda r: 1 / log2(r + 1))) ELSE 0.0::DOUBLE END AS ndcg, coalesce(1 / first, 0.0::DOUBLE) AS rr
FROM {asked} LEFT JOIN (SELECT qid, count(*) AS m FROM (SELECT DISTINCT qid, id FROM {relevant}) GROUP BY qid) USING (qid)
LEFT JOIN (SELECT qid, count(*) FILTER (rank <= {k}) AS f, min(rank) AS first, sum(1 / log2(rank + 1)) FILTER (rank <= {k}) AS dcg FROM {hits} JOIN (SELECT DISTINCT qid, id FROM {relevant}) USING (qid, id) GROUP BY qid) USING (qid))"""


def _hits(source: str, k: int = 20) -> str:
    return f"(SELECT qid, chunk_id AS id, rank FROM {source} WHERE rank <= {k})"


_LEX_EACH = f"WITH {_lexical()}, {_RELEVANT}, {_each('each', _hits('lexical'))}"
_CONTEXTS = f"{_lexical(3)}, contexts AS (SELECT qid, rank AS marker, title, source, text FROM lexical JOIN passages USING (chunk_id))"
_SPLIT = f"split AS (SELECT qid, marker, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS spos FROM (SELECT qid, marker, {_sentences(_headings_off('text', 'title'))} AS s FROM contexts))"
_CANDIDATES = f"{_SPLIT}, candidates AS (SELECT * FROM split QUALIFY row_number() OVER (PARTITION BY qid, lower(sentence) ORDER BY marker, spos) = 1)"
_content = lambda x: f"list_distinct({_tokens(x, CONTENT_STOP_WORDS, 3)})"
_CHOSEN = f"""shared AS (SELECT qid, marker, spos, sentence, CAST(len(list_intersect({_content('question')}, {_content('sentence')})) AS INTEGER) AS overlap FROM candidates JOIN questions USING (qid)),
chosen AS (SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, marker, spos) AS INTEGER) AS place, marker, sentence, overlap FROM shared WHERE overlap >= 2) WHERE place <= 3)"""
_RAW = f"raw_answers AS (SELECT qid, coalesce(text, '{INSUFFICIENT_CONTEXT}') AS text FROM questions LEFT JOIN (SELECT qid, string_agg(sentence || ' [' || marker || ']', ' ' ORDER BY place) AS text FROM chosen GROUP BY qid) USING (qid))"
_ANSWERS = f"""{_CONTEXTS}, {_CANDIDATES}, {_CHOSEN}, {_RAW},
answers AS (SELECT qid, n, CASE WHEN n IS NULL THEN '{NOTHING_FOUND}' WHEN abstained THEN '{NO_ANSWER}' ELSE r END AS text, abstained, CASE WHEN abstained THEN [] ELSE marks END AS marks,
CAST(len(regexp_extract_all(r, '[^ \t\n\x0B\f\r]+')) AS INTEGER) AS output_tokens
FROM (SELECT qid, n, text AS r, n IS NULL OR contains(text, '{INSUFFICIENT_CONTEXT}') AS abstained, m AS marks FROM raw_answers LEFT JOIN (SELECT qid, count(*) AS n FROM contexts GROUP BY qid) USING (qid) LEFT JOIN (SELECT qid, list(marker ORDER BY first) AS m FROM (SELECT qid, marker, min(place) AS first FROM chosen GROUP BY ALL) GROUP BY qid) USING (qid)))"""
_GOLD = f"{_RELEVANT}, gold AS (SELECT qid, qid IN (SELECT qid FROM relevant) AS answerable, words FROM (SELECT qid, list_slice(list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda p: list_position(t, p[1]) = p[2]), lambda p: p[1]), 1, 3) AS words FROM (SELECT qid, {_tokens('question', CONTENT_STOP_WORDS, 3)} AS t FROM questions)))"
_COVER = "len(list_filter(words, lambda w: contains(lower(text), w))) / len(words)"
_VECTORS = """v AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS chunk_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
hits AS (SELECT * FROM (SELECT a.chunk_id AS qid, b.chunk_id, round(list_dot_product(a.e, b.e), 9) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e), 9) DESC, b.vec_id) AS INTEGER) AS rank FROM v a, v b WHERE a.vec_id % 20 = 0) WHERE rank <= {k})"""
_SWEEP = ", ".join(_each(f"{mode}_{k}", _hits(source, k), k) for mode, source in (("dense", "dense"), ("lexical", "lexical"), ("hybrid", "fused")) for k in (1, 3, 5, 10))
_cited = "replace(replace(text, '.', ' [1].'), ',', ' [' || doc_id % 12 || '],')"
_marks = f"list_transform(regexp_extract_all({_cited}, '\\[(\\d{{1,2}})\\]', 1), lambda d: CAST(d AS INTEGER))"
_parts = ["'" + x.replace("\n", "' || chr(10) || '") + "'" for x in _WIKI]
_wiki = rf"regexp_replace(source || {_parts[0]} || text || {_parts[1]} || text || {_parts[2]}, '(?is)\n==+\s*(?:{TAIL_SECTIONS})\s*==+.*$', '')"
for _n, _m in ((5, "####"), (4, "###"), (3, "###"), (2, "##")):
    _wiki = rf"regexp_replace({_wiki}, '(?m)^={{{_n}}}\s*(.+?)\s*={{{_n}}}$', '{_m} \1', 'g')"
_title = _strip(r"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\x0B\f\r]+', ' ', 'g')")
_base = "regexp_replace(url, '^.*/', '')"
_stem = rf"CASE WHEN regexp_matches({_base}, '^.+\.[^.]+$') THEN regexp_replace({_base}, '\.[^.]+$', '') ELSE {_base} END"
_suffix = rf"CASE WHEN regexp_matches({_base}, '^.+\.[^.]+$') THEN lower(regexp_extract({_base}, '(\.[^.]+)$', 1)) ELSE '' END"

_words = lambda x: f"regexp_extract_all({x}, '[^ \\t\\n\\x0B\\f\\r]+')"


def _split(source: str, key: str) -> str:
    """CTEs up to `sentences` (key, spos from 1, sentence) of source (key, text): texts are cut at every possible end, and pieces whose end is none join the next."""
    return rf"""cut AS (SELECT {key}, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT {key}, string_split(regexp_replace(text, '([.!?])(["'')\]]*[ \t\n\x0B\f\r]+)', '\1' || chr(2) || '\2' || chr(1), 'g'), chr(1)) AS p FROM {source})),
ended AS (SELECT *, lower(rtrim(regexp_extract(string_split(piece, chr(2))[1], '([A-Za-z][A-Za-z.]*)\.$', 1), '.')) AS word FROM cut),
numbered AS (SELECT {key}, i, replace(piece, chr(2), '') AS piece, coalesce(sum(CASE WHEN contains(piece, chr(2)) AND word <> '' AND (length(word) = 1 OR word IN ({_list(sorted(ABBREVIATIONS))})) THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ended),
whole AS (SELECT {key}, g, {_strip("string_agg(piece, '' ORDER BY i)")} AS sentence FROM numbered GROUP BY {key}, g),
sentences AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY g) AS INTEGER) AS spos, sentence FROM whole WHERE sentence <> '')"""


#: The chunker by its ranges of sentences. t: sums of words before each sentence; a: where the chunk begins; i: the next sentence.
_first = "list_min(list_filter(range(i, n), lambda j: c[j + 1] >= 220 OR (j > a AND t[j + 2] - t[a + 1] > 220)))"
_tail = "list_min(list_filter(range(a, f), lambda j: j = f - 1 OR t[f + 1] - t[j + 1] <= 40))"
_CHUNKS = rf"""WITH RECURSIVE paragraphs AS (SELECT doc_id, struct_pack(d := doc_id, p := generate_subscripts(p, 1)) AS k, unnest(p) AS text FROM (SELECT doc_id, string_split(regexp_replace(text, '\n[ \t\n\x0B\f\r]*\n', chr(3), 'g'), chr(3)) AS p FROM documents)),
{_split('paragraphs', 'k')},
counted AS (SELECT k.d AS doc_id, row_number() OVER (PARTITION BY k.d ORDER BY k.p, spos) AS s, sentence, len({_words('sentence')}) AS w FROM sentences),
held AS (SELECT doc_id, list(sentence ORDER BY s) AS z, list(w ORDER BY s) AS c, [0] || list(upto ORDER BY s) AS t, count(*) AS n FROM (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY s) AS BIGINT) AS upto FROM counted) GROUP BY doc_id),
steps AS (SELECT doc_id, 0 AS step, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[][]) AS made, false AS done FROM held
UNION ALL SELECT doc_id, step + 1, CASE WHEN f IS NULL THEN n WHEN large THEN f + 1 ELSE h END, coalesce(f + 1, n),
CASE WHEN f IS NULL THEN CASE WHEN a < n THEN [[a, n]] ELSE [] END WHEN large THEN CASE WHEN a < f THEN [[a, f], [h, f], [f, f + 1]] ELSE [[f, f + 1]] END ELSE [[a, f]] END, f IS NULL
FROM (SELECT *, c[f + 1] >= 220 AS large, {_tail} AS h FROM (SELECT *, {_first} AS f FROM steps JOIN held USING (doc_id) WHERE NOT done))),
ranges AS (SELECT doc_id, step, generate_subscripts(made, 1) AS m, unnest(made) AS r FROM steps),
chunks AS (SELECT doc_id, row_number() OVER own AS o, count(*) OVER (PARTITION BY doc_id) AS k, t[r[2] + 1] - t[r[1] + 1] AS w, array_to_string(list_transform(z[r[1] + 1:r[2]], lambda x: x || CASE WHEN regexp_full_match(x, '#{{1,6}}[ \t]+[^\n]*') THEN chr(10) ELSE ' ' END), '') AS x FROM ranges JOIN held USING (doc_id) WINDOW own AS (PARTITION BY doc_id ORDER BY step, m)),
near AS (SELECT doc_id, o, k, w, left(x, length(x) - 1) AS x, lead(w) OVER own AS w2, lead(left(x, length(x) - 1)) OVER own AS x2, lag(w) OVER own AS w0 FROM chunks WINDOW own AS (PARTITION BY doc_id ORDER BY o)),
merged AS (SELECT doc_id, o, CASE WHEN o = k - 1 AND w2 < 25 AND w + w2 <= 220 THEN w + w2 ELSE w END AS w, CASE WHEN o = k - 1 AND w2 < 25 AND w + w2 <= 220 THEN x || ' ' || x2 ELSE x END AS x FROM near WHERE NOT (o = k AND k > 1 AND w < 25 AND w0 + w <= 220))
SELECT doc_id || '::' || (o - 1) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(o - 1 AS INTEGER) AS ordinal, CAST(w AS INTEGER) AS n_words, md5(x) AS digest FROM merged"""

#: Reflow by windows over lines: what stands before and after a line tells whether it's a heading; blank lines and headings begin a paragraph.
_REFLOW = rf"""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS i, {_strip('unnest(p)')} AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
near AS (SELECT *, lag(x) OVER own AS before, lead(x) OVER own AS after FROM l WHERE x <> '' WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
heads AS (SELECT doc_id, i, len({_words('x')}) <= 8 AND right(x, 1) NOT IN ('.', '!', '?', ':', ';', ',') AND (before IS NULL OR right(before, 1) IN ('.', '!', '?', ':', ';')) AND coalesce(left(after, 1) = upper(left(after, 1)) AND left(after, 1) <> lower(left(after, 1)), false) AS head FROM near),
grouped AS (SELECT doc_id, i, x, coalesce(head, false) AS head, sum(CASE WHEN x = '' OR head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS heads FROM l LEFT JOIN heads USING (doc_id, i)),
placed AS (SELECT doc_id, g, i, CASE WHEN head THEN CASE WHEN heads = 1 THEN '# ' ELSE '## ' END || x || chr(10) ELSE CASE WHEN lag(x) OVER own IS NULL OR lag(head) OVER own OR right(lag(x) OVER own, 1) = '-' THEN '' ELSE ' ' END || x END AS part FROM grouped WHERE x <> '' WINDOW own AS (PARTITION BY doc_id, g ORDER BY i)),
told AS (SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY g) AS page FROM (SELECT doc_id, g, string_agg(part, '' ORDER BY i) AS p FROM placed GROUP BY doc_id, g) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN md5(coalesce(page, '')) END AS digest FROM documents LEFT JOIN told USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "word_count": r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n_words FROM documents",
    "tokenize_terms": f"SELECT doc_id, array_to_string({_tokens('text')}, ' ') AS terms FROM documents",
    "bigrams": f"SELECT doc_id, array_to_string({_grams('text')}, ' ') AS grams FROM documents",
    "content_words": f"SELECT item_id, array_to_string(list_sort({_content('text')}), ' ') AS words FROM benchmark",
    "naive_sentences": f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS spos, unnest(s) AS sentence FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)",
    "normalize_ws": f"SELECT doc_id, {_strip(r"regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM documents",
    "preview_text": f"SELECT doc_id, substr({_collapse(r"regexp_replace(text, '(^|\s)#{1,6}\s+', '\1', 'g')")}, 1, 400) AS preview FROM documents",
    "safe_filename": rf"SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace({_stem}, '[^A-Za-z0-9._ -]+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g'), 1, 120), ''), 'document') || {_suffix} AS name FROM pages",
    "slugify": f"SELECT page_id, regexp_replace(regexp_replace(lower({_title}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '.md' AS slug FROM pages",
    "page_title": f"SELECT page_id, {_title} AS title FROM pages",
    "document_title": rf"SELECT doc_id, coalesce(nullif({_strip(r"regexp_extract('# ' || text, '^\s*#\s+(.+)', 1)")}, ''), source) AS heading, source || ' x y' AS stem FROM documents",
    "document_key": "SELECT doc_id, substr(sha1(source || '/' || doc_id || '.txt'), 1, 12) AS key FROM documents",
    "wiki_clean": f"SELECT doc_id, {_strip(rf"regexp_replace({_wiki}, '\n{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM documents",
    "paragraphs": f"SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS place, unnest(p) AS paragraph FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {_strip('s')}), lambda s: s <> '') AS p FROM documents)",
    "strip_headings": f"SELECT doc_id, {_headings_off("'# ' || source || chr(10) || '## Part one' || chr(10) || text || ' ### tail'", 'source')} AS text FROM documents",
    "parse_citations": f"SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(m, range(1, len(m) + 1)), lambda p: list_position(m, p[1]) = p[2]), lambda p: p[1]), ',') AS cited FROM (SELECT doc_id, list_filter({_marks}, lambda n: n BETWEEN 1 AND 8) AS m FROM documents)",
    "strip_invalid_citations": rf"SELECT doc_id, regexp_replace({_cited}, '\[(?:0|00|0?[4-9]|[1-9][0-9])\]', '', 'g') AS text FROM documents",
    "prompt_build": f"SELECT item_id, {_strip("'Question: ' || text || chr(10) || chr(10) || 'Context passages:' || chr(10) || chr(10) || '[1] T - s.md' || chr(10) || text || chr(10) || chr(10) || '[2] U - u.md' || chr(10) || 'Other.'")} AS prompt FROM benchmark",
    "prompt_parse": f"SELECT item_id, {_strip(r"regexp_extract(text, '^[ \t\n\x0B\f\r]*([^\n]+)', 1)")} AS question, m AS marker, CASE WHEN m = 1 THEN 'T' ELSE 'U' END AS title, CASE WHEN m = 1 THEN {_strip('text')} ELSE 'Other.' END AS text FROM benchmark, (SELECT CAST(unnest([1, 2]) AS INTEGER) AS m)",
    "postings": f"WITH {_BASE} SELECT term, chunk_id, CAST(dl AS INTEGER) AS dl, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM tokens) GROUP BY ALL",
    "term_stats": f"WITH {_BASE}, {_STATS} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "corpus_stats": f"WITH {_BASE}, {_STATS} SELECT n_chunks, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf FROM size, mean",
    "bm25_topk": f"WITH {_lexical()} {_ONE} lexical",
    "l2_normalize": "SELECT vec_id, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS i, round(unnest(e) / n, 5) + 0.0::DOUBLE AS x FROM (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS e FROM embeddings))",
    "dense_topk": f"WITH {_VECTORS.format(k=20)} {_ONE} hits",
    "hash_md5_vectors": f"WITH {_BASE}, dv AS ({_sparse('text', 'chunk_id', 32, 'passages')}) SELECT chunk_id, CAST(i AS INTEGER) AS i, round(w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)), 6) AS x FROM dv QUALIFY w <> 0",
    "rrf_fuse": f"WITH {_ALL} {_ONE} fused",
    "rrf_weighted": f"WITH {_lexical()}, {_HASHED}, {_fused(10, 0.25, 2.0)} {_ONE} fused",
    "rrf_components": f"WITH {_ALL} SELECT qid, chunk_id, source AS component, round(raw, 6) AS value FROM both_ UNION ALL SELECT qid, chunk_id, source || '_rank', rank FROM both_",
    "hybrid_topk": f"WITH {_ALL} {_ONE} fused WHERE rank <= 5",
    "source_ablation": f"WITH {_ALL} {_SINGLE}",
    "retrieval_debug": f"WITH {_ALL} SELECT qid, count(*) FILTER (s = 1) AS dense_hits, count(*) FILTER (s = 2) AS lexical_hits, count(*) FILTER (s = 3) AS fused_hits FROM (SELECT qid, 1 AS s FROM dense UNION ALL SELECT qid, 2 FROM lexical UNION ALL SELECT qid, 3 FROM fused WHERE rank <= 20) GROUP BY qid",
    "rerank": f"WITH {_lexical()}, pairs AS (SELECT qid, chunk_id, CAST(len(list_intersect({_words('question')}, {_words('text')})) AS DOUBLE) AS score FROM lexical JOIN passages USING (chunk_id) JOIN questions USING (qid)) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM pairs) WHERE rank <= 5",
    "split_sentences": f"WITH {_split('documents', 'doc_id')} SELECT doc_id, spos - 1 AS spos, sentence FROM sentences",
    "chunk_documents": _CHUNKS,
    "pdf_reflow": _REFLOW,
    "list_documents": r"SELECT source AS doc_id, source AS title, source, count(*) AS n_chunks, CAST(sum(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))) AS BIGINT) AS n_words, min(doc_id) AS first_pos FROM documents GROUP BY source",
    "index_stats": "SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_documents FROM documents",
    "delete_document": "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS doc_id FROM documents WHERE source NOT IN ('src3', 'src7')",
    "removed_count": "SELECT count(*) AS n_removed FROM documents WHERE source IN ('src3', 'src7')",
    "upsert_documents": "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, md5(text) AS digest FROM documents ANTI JOIN pages ON doc_id = page_id UNION ALL SELECT CAST(page_id AS VARCHAR), md5(html) FROM pages",
    "upload_status": "SELECT doc_id, source, status, reason, status <> 'skipped' AS late FROM (SELECT *, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN doc_id IN (SELECT CAST(page_id AS VARCHAR) FROM pages) THEN 'updated' ELSE 'added' END AS status FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'f' || doc_id || ['.md', '.TXT', '.exe', ''][doc_id % 4 + 1] AS source, CASE WHEN doc_id % 4 > 1 THEN 'unsupported file type' WHEN doc_id % 10 = 0 OR trim(text) = '' THEN 'no text found' END AS reason FROM documents))",
    "hit_rate_at_k": f"{_LEX_EACH} SELECT qid, hit FROM each",
    **{name: f"{_LEX_EACH} SELECT qid, round({column}, 6) AS {column} FROM each" for name, column in (("recall_at_k", "recall"), ("precision_at_k", "precision"), ("ndcg_at_k", "ndcg"), ("mrr", "rr"))},
    "dense_label_metrics": f"WITH {_VECTORS.format(k=20)}, asked AS (SELECT chunk_id AS qid, label FROM v WHERE vec_id % 20 = 0), relevant AS (SELECT qid, chunk_id AS id FROM asked JOIN v USING (label)), {_each('each', _hits('hits'), 10, asked='asked', extra=', label')} SELECT label, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS rr FROM each GROUP BY label",
    "source_dedup": f"WITH {_lexical()} SELECT qid, source AS id, CAST(row_number() OVER (PARTITION BY qid ORDER BY best) AS INTEGER) AS rank FROM (SELECT qid, source, min(rank) AS best FROM lexical JOIN passages USING (chunk_id) WHERE rank <= 10 GROUP BY ALL)",
    "recall_by_type": f"{_LEX_EACH}, kind AS (SELECT qid, lang FROM lexical JOIN passages USING (chunk_id) WHERE rank = 1) SELECT coalesce(lang, 'none') AS lang, count(*) AS n, round(avg(recall), 6) AS recall FROM each LEFT JOIN kind USING (qid) GROUP BY 1",
    "retrieval_failures": f"WITH {_ALL}, {_RELEVANT}, {_each('each', _hits('dense'))} SELECT qid FROM each WHERE hit = 0",
    "k_sweep": f"WITH {_ALL}, {_RELEVANT}, {_SWEEP} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, {k} AS k, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg FROM {m}_{k}" for m in ("dense", "lexical", "hybrid") for k in (1, 3, 5, 10)),
    "complementarity": f"WITH {_ALL}, {_RELEVANT}, {_each('a', _hits('dense'))}, {_each('b', _hits('lexical'))} SELECT CASE WHEN a.hit > 0 AND b.hit > 0 THEN 'both' WHEN a.hit > 0 THEN 'dense_only' WHEN b.hit > 0 THEN 'lexical_only' ELSE 'both_miss' END AS outcome, count(*) AS n FROM a JOIN b USING (qid) GROUP BY 1",
    "best_retriever": f"WITH {_ALL}, {_RELEVANT}, {_each('a', _hits('dense'))}, {_each('b', _hits('lexical'))}, {_each('c', _hits('fused'))} SELECT mode, round(recall, 6) AS recall FROM (SELECT 1 AS o, 'dense' AS mode, avg(recall) AS recall FROM a UNION ALL SELECT 2, 'lexical', avg(recall) FROM b UNION ALL SELECT 3, 'hybrid', avg(recall) FROM c) ORDER BY round(recall, 9) DESC, o LIMIT 1",
    "p50_upper_median": "SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS p50 FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "candidate_sentences": f"WITH {_CONTEXTS}, {_CANDIDATES} SELECT qid, marker, spos, sentence FROM candidates",
    "answer_by_words": f"WITH {_CONTEXTS}, {_CANDIDATES}, {_CHOSEN} SELECT * FROM chosen",
    "extractive_answer": f"WITH {_CONTEXTS}, {_CANDIDATES}, {_CHOSEN}, {_RAW} SELECT * FROM raw_answers",
    "answers": f"WITH {_ANSWERS} SELECT qid, text, array_to_string(marks, ',') AS cited, abstained, output_tokens FROM answers",
    "resolved_citations": f"WITH {_ANSWERS}, cited AS (SELECT qid, CAST(generate_subscripts(marks, 1) - 1 AS INTEGER) AS nth, unnest(marks) AS marker FROM answers) SELECT qid, nth, marker, title, source FROM cited JOIN contexts USING (qid, marker)",
    "answer_by_meaning_gate": f"WITH {_VECTORS.format(k=10)}, placed AS (SELECT qid, chunk_id AS sentence, score, max(score) OVER (PARTITION BY qid) AS best, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS INTEGER) AS place FROM hits WHERE qid <> chunk_id) SELECT qid, place, sentence, round(score, 6) AS similarity FROM placed WHERE place <= 3 AND best >= 0.45 AND score >= greatest(0.45, best - 0.15)",
    "keyword_coverage": f"WITH {_ANSWERS}, {_GOLD} SELECT qid, round(CASE WHEN len(words) > 0 THEN {_COVER} ELSE 0 END, 6) AS coverage FROM gold JOIN answers USING (qid)",
    "answer_metrics": f"WITH {_ANSWERS}, {_GOLD} SELECT round(coalesce(avg(CASE WHEN len(words) > 0 THEN {_COVER} ELSE 0 END) FILTER (answerable), 0), 6) AS keyword_coverage, round(coalesce(avg(CAST(len(marks) > 0 AS INTEGER)) FILTER (answerable), 0), 6) AS citation_rate, round(avg(CAST(answerable <> abstained AS INTEGER)), 6) AS abstention_accuracy FROM gold JOIN answers USING (qid)",
}
