"""The registered queries over the engine's own operators, and the SQL that they must agree with.

The driver tables hold no blank lines, captions, headings and the like, so a query derives its input from
documents: lines as paragraphs, and injected lines by doc_id, the same in both engines.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import audio, chunking, layout, models, records, scoring
from scriptorium.operators.rows import flat_mapped
from scriptorium.plans import drivers
from scriptorium.plans.config import Config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WS = r"[\t\n\x0b\x0c\r \x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their lines as paragraphs."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


PARAS = f"""WITH l AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS a FROM documents),
e AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS raw FROM l),
p AS (SELECT doc_id, pos, {_trim("raw")} AS text FROM e WHERE length(regexp_replace(raw, '{WS}', '', 'g')) >= 10)
"""
TAGGED = PARAS + """, t AS (SELECT doc_id, row_number() OVER w AS ordinal, text, CASE WHEN lead(pos) OVER w IS NULL THEN NULL ELSE 'Paragraph' END AS trailing_boundary FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
"""


@query(PARAS + "SELECT doc_id, pos::INT AS pos, text FROM p")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.paragraphs(_docs(spark, sf_dir))


@query(TAGGED + "SELECT doc_id, ordinal::INT AS ordinal, text, trailing_boundary FROM t")
def chunk_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(_docs(spark, sf_dir), max_words=0)


def _chunk_sql(most: int) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_trim("text")}, '[^ \\t\\n\\r]+[ \\t\\n\\r]*') AS a FROM documents WHERE length(regexp_replace(text, '{WS}', '', 'g')) >= 10),
w AS (SELECT doc_id, unnest(range(len(a))) AS k, unnest(a) AS tok, len(a) AS n FROM d),
v AS (SELECT *, rtrim(tok, ' ' || chr(9) || chr(10) || chr(13)) AS bare, sum(octet_length(encode(tok))) OVER (PARTITION BY doc_id ORDER BY k) - octet_length(encode(tok)) AS pl FROM w),
u AS (SELECT *, pl + octet_length(encode(bare)) AS e, CASE WHEN right(bare, 1) IN ('.', '!', '?') THEN k END AS stop FROM v),
x AS (SELECT doc_id, k, n, lead(e, {most - 1}) OVER o AS e, min(stop) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {most} FOLLOWING AND {most + 150} FOLLOWING) AS s FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
f AS (SELECT x.doc_id, x.k, CASE WHEN x.n - x.k <= {most} THEN x.n WHEN y.e < x.e + 150 THEN x.s + 1 ELSE x.k + {max(most - 1, 1)} END AS nxt, x.n FROM x LEFT JOIN u y ON y.doc_id = x.doc_id AND y.k = x.s),
r AS (SELECT doc_id, k AS s, nxt, n, 1 AS ordinal FROM f WHERE k = 0 UNION ALL SELECT f.doc_id, f.k, f.nxt, f.n, r.ordinal + 1 FROM r JOIN f ON f.doc_id = r.doc_id AND f.k = r.nxt WHERE r.nxt < r.n)
SELECT r.doc_id, r.ordinal::INT AS ordinal, {_trim("string_agg(u.tok, '' ORDER BY u.k)")} AS text, CASE WHEN max(r.nxt) < max(r.n) THEN 'Sentence' END AS trailing_boundary
FROM r JOIN u ON u.doc_id = r.doc_id AND u.k >= r.s AND u.k < r.nxt GROUP BY r.doc_id, r.ordinal"""


@query(_chunk_sql(200))
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(_t(spark, sf_dir, "documents").select("doc_id", "text"), max_words=200)


@query(_chunk_sql(25))
def chunk_words_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(_t(spark, sf_dir, "documents").select("doc_id", "text"), max_words=25)


@query(PARAS + f"SELECT doc_id, count(*) AS n_paragraphs, sum(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')))::BIGINT AS n_words, max(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')))::INT AS longest FROM p GROUP BY doc_id")
def doc_word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.word_count(F.col("text"))
    return chunking.paragraphs(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.sum(words).alias("n_words"), F.max(words).alias("longest"))


@query(TAGGED + "SELECT doc_id, t.ordinal::INT AS ordinal, CASE WHEN ordinal < 1000 THEN 'paragraph_' || lpad(ordinal::VARCHAR, 3, '0') ELSE 'paragraph_' || ordinal END || '.wav' AS wav, left(text, 60) AS preview FROM t")
def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_boundaries(spark, sf_dir).select("doc_id", "ordinal", T.artifact(F.col("ordinal")).alias("wav"), T.preview(F.col("text"), 60).alias("preview"))


# text functions over conversations, with marks that the tables lack put in by turn
MARKED = "CASE turn % 4 WHEN 0 THEN '“' || text || '”—don’t… ' WHEN 1 THEN ' ' || text || ' – 3.2 km' WHEN 2 THEN '<think>' || text || '</think> ' || text ELSE text END"
SAID = f"WITH c AS (SELECT conv_id, turn, {MARKED} AS x FROM conversations) "


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(MARKED).alias("x"))


def _normal_sql(x: str) -> str:
    return _collapse(f"lower(regexp_replace(translate({x}, '’‘“”—–', '''''\"\"  '), '[^\\pL\\pM\\t\\n\\x0b\\x0c\\r ]', '', 'g'))")


@query(SAID + f"SELECT conv_id, turn, {_normal_sql('x')} AS y FROM c")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("conv_id", "turn", T.normalized(F.col("x")).alias("y"))


SANITIZED = _collapse("regexp_replace(replace(replace(replace(translate(x, '’‘“”', '''''\"\"'), '—', ' — '), '–', ' - '), '…', '...'), '[^\\x21-\\x7E \\n\\t]', '', 'g')")


@query(SAID + f"SELECT conv_id, turn, {SANITIZED} AS y, {SANITIZED} <> {_collapse('x')} AS changed FROM c")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("conv_id", "turn", T.sanitized(F.col("x")).alias("y"), T.sanitize_changed(F.col("x")).alias("changed"))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE {SANITIZED} <> {_collapse('x')}) AS changed FROM (SELECT lang, text AS x FROM documents) GROUP BY lang")
def sanitize_dirty_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.sanitize_changed(F.col("text"))).alias("changed"))


@query(SAID + f"SELECT conv_id, turn, CASE WHEN regexp_matches(regexp_replace(x, '{WS}+$', ''), '[.!?…\"'']$') THEN x ELSE regexp_replace(x, '{WS}+$', '') || '.' END AS y FROM c")
def terminal_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("conv_id", "turn", T.terminated(F.col("x")).alias("y"))


@query(SAID + f"SELECT conv_id, turn, CASE WHEN strpos(x, '</think>') > 0 THEN {_trim('substr(x, strpos(x, $$</think>$$) + 8)')} ELSE x END AS y FROM c")
def think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("conv_id", "turn", T.think_stripped(F.col("x")).alias("y"))


#: A marker beside the text of three documents in five.
MARKER = "CASE doc_id % 5 WHEN 0 THEN ' DROP ' WHEN 1 THEN 'Drop' WHEN 2 THEN 'drop it' END"


@query(f"SELECT doc_id, x FROM (SELECT doc_id, text AS x FROM documents UNION ALL SELECT doc_id, {MARKER} FROM documents) WHERE lower({_trim('x')}) <> 'drop'")
def drop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.col("text"), F.expr(MARKER))).alias("x"))
    return each.where(~T.is_drop(F.col("x")))


@query(r"SELECT doc_id, regexp_replace(replace(text, 'en ', 'en-' || chr(10)), '-\n([a-z])', '\1', 'g') AS y FROM documents")
def rejoin_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.hyphens_rejoined(F.replace("text", F.lit("en "), F.lit("en-\n"))).alias("y"))


def _glyph_sql(x: str) -> str:
    for a, b in T.GLYPHS:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return _trim(f"regexp_replace(regexp_replace({x}, '\\[uni[0-9A-Fa-f]+\\]', '', 'g'), ' {{2,}}', ' ', 'g')")


GLYPHED = "replace(replace(replace(replace(text, 'th', '[fi]th'), ' on', '[emdash]on [uni00e9]'), 'la', '[bracketleft]fl[bracketright] [bullet]'), 'er', '[quoteleft]er')"


@query(f"SELECT doc_id, {_glyph_sql(GLYPHED)} AS y FROM documents")
def glyph_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.glyphs_scrubbed(F.expr(GLYPHED)).alias("y"))


# lines of documents, with some put in by document and place
INJECTED = "CASE WHEN (doc_id + pos) % 11 = 0 THEN 'Figure ' || pos || '. ' || raw WHEN (doc_id + pos) % 13 = 0 THEN ' - ' || pos || ' - ' WHEN (doc_id + pos) % 17 = 0 THEN 'https://x.org/' || pos WHEN (doc_id + pos) % 19 = 0 THEN '' WHEN (doc_id + pos) % 23 = 0 AND pos > 3 THEN '7. References' WHEN (doc_id + pos) % 29 = 0 THEN 'Table of ' || raw ELSE raw END"
#: From lines l (doc_id, line_no, text) on: k tells what each is, m whether it stands in the references, f what stays.
JUDGED = f"""j AS (SELECT *, {_trim("text")} AS x, translate({_trim("text")}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM l),
k AS (SELECT *, x <> '' AND regexp_matches(x, '^[- ]*[0-9]*[- ]*$') AS page,
  (octet_length(encode(x)) < 40 AND NOT regexp_matches(x, '[.?!]$')) OR regexp_matches(x, '^https?://') OR regexp_matches(x, '^10\\.[0-9]{{4,}}/') AS noise,
  octet_length(encode(low)) <= 40 AND (regexp_replace(low, '^[0-9. ()]*', '') IN ('references', 'references and notes', 'bibliography', 'works cited', 'literature cited', 'acknowledgements', 'acknowledgments') OR starts_with(regexp_replace(low, '^[0-9. ()]*', ''), 'appendix')) AS refs,
  regexp_matches(low, '^(figure|fig\\.|fig|table|tbl\\.|tbl) [0-9]') AS caption FROM j),
m AS (SELECT *, max(refs) OVER (PARTITION BY doc_id ORDER BY line_no) AS in_refs FROM k),
f AS (SELECT * FROM m WHERE x = '' OR NOT (page OR noise OR caption OR in_refs))
"""
LINES = f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
e AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS raw FROM s),
l AS (SELECT doc_id, pos::INT AS line_no, {INJECTED} AS text FROM e),
""" + JUDGED
#: From f on: h holds the paragraphs.
ASSEMBLED = """, g AS (SELECT doc_id, line_no, x, sum(CASE WHEN x = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM f),
h AS (SELECT doc_id, g, string_agg(x, ' ' ORDER BY line_no) AS text FROM g WHERE x <> '' GROUP BY doc_id, g)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return each.select("doc_id", F.col("pos").alias("line_no"), F.expr(INJECTED).alias("text"))


@query(LINES + "SELECT doc_id, line_no, text FROM k WHERE noise")
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(T.is_noise(F.col("text")))


@query(LINES + "SELECT doc_id, line_no, text FROM k WHERE caption")
def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(T.is_caption(F.col("text")))


@query(LINES + "SELECT doc_id, line_no, text FROM k WHERE page")
def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(T.is_page_number(F.col("text")))


@query(LINES + "SELECT doc_id, line_no, in_refs FROM m")
def refs_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.latched(_lines(spark, sf_dir)).select("doc_id", "line_no", "in_refs")


@query(LINES + "SELECT doc_id, line_no, text FROM f")
def filter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.filter_lines(_lines(spark, sf_dir))


@query(LINES + ASSEMBLED + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g)::INT AS para, text FROM h")
def assemble_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines_to_paragraphs(layout.filter_lines(_lines(spark, sf_dir)))


#: From lines (doc_id, line_no, text) on: l holds them with hyphens rejoined and glyph names scrubbed.
def _cleaned_sql(src: str) -> str:
    return f"""u AS (SELECT doc_id, regexp_replace(string_agg(text, chr(10) ORDER BY line_no), '-\\n([a-z])', '\\1', 'g') AS text FROM {src} GROUP BY doc_id),
v AS (SELECT doc_id, unnest(range(len(a))) + 1 AS line_no, unnest(a) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM u)),
l AS (SELECT doc_id, line_no, {_glyph_sql('raw')} AS text FROM v)"""


BROKEN = "replace(replace(raw, 'er', '[quoteleft]er'), 'th', '[fi]th') || CASE WHEN (doc_id + pos) % 3 = 0 THEN '-' ELSE '' END"


@query(f"WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), e AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS raw FROM s), n AS (SELECT doc_id, pos AS line_no, {BROKEN} AS text FROM e), {_cleaned_sql('n')} SELECT doc_id, line_no::INT AS line_no, text FROM l")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return layout.clean_lines(each.select("doc_id", F.col("pos").alias("line_no"), F.expr(BROKEN).alias("text")))


# word boxes by index: eight words a line, two columns, forty lines a page; every 37th word is wide
BOXED = """SELECT doc_id, (k // 640)::INT AS page_no, 612.0::DOUBLE AS page_width, k::INT AS word_idx, word AS text,
  ((k % 640) // 320 * 306 + (k % 8) * 36 + 10)::DOUBLE AS x0, ((k % 640) // 320 * 306 + (k % 8) * 36 + CASE WHEN k % 37 = 0 THEN 330 ELSE 40 END)::DOUBLE AS x1,
  ((k % 320) // 8 * 12 + (k % 3) * 0.5)::DOUBLE AS top, ((k % 320) // 8 * 12 + (k % 3) * 0.5 + 8)::DOUBLE AS bottom
FROM (SELECT doc_id, unnest(range(len(a))) AS k, unnest(a) AS word FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda z: z <> '') AS a FROM documents))"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", "[ \n]+"), lambda z: z != "")
    # outer, and the test after it: else the words are split twice, as in chunking.paragraphs
    each = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(words).alias("k", "word")).where("k IS NOT NULL")
    return each.selectExpr(
        "doc_id", "k div 640 AS page_no", "double(612) AS page_width", "k AS word_idx", "word AS text", "double(k % 640 div 320 * 306 + (k % 8) * 36 + 10) AS x0",
        "double(k % 640 div 320 * 306 + (k % 8) * 36 + CASE WHEN k % 37 = 0 THEN 330 ELSE 40 END) AS x1", "double((k % 320) div 8 * 12 + (k % 3) * 0.5) AS top", "double((k % 320) div 8 * 12 + (k % 3) * 0.5 + 8) AS bottom",
    ).withColumn("page_no", F.col("page_no").cast("int"))


def _layout_sql(geometric: bool) -> str:
    side = "CASE WHEN (x0 + x1) / 2 < page_width / 2 THEN 1 ELSE 2 END"
    if geometric:
        side = f"CASE WHEN x0 < page_width / 2 AND x1 > page_width / 2 AND least(page_width / 2 - x0, x1 - page_width / 2) / greatest(x1 - x0, 0.01 * page_width) > 0.1 THEN 0 ELSE {side} END"
    single = "CASE WHEN sum(CASE WHEN col = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id, page_no) > 0 THEN 0 ELSE col END" if geometric else "col"
    return f"""WITH b AS ({BOXED}), c0 AS (SELECT *, {side} AS col, (top + bottom) / 2 AS y FROM b), c AS (SELECT * REPLACE ({single} AS col) FROM c0),
n AS (SELECT *, CASE WHEN lag(col) OVER w IS NULL OR col <> lag(col) OVER w OR abs(y - lag(y) OVER w) > 3.0 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY col, top, x0, word_idx)),
lined AS (SELECT *, sum(new) OVER w AS line, row_number() OVER w AS pl FROM n WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY col, top, x0, word_idx)),
t AS (SELECT doc_id, page_no, line, string_agg(text, ' ' ORDER BY pl) AS text FROM lined GROUP BY ALL UNION ALL SELECT DISTINCT doc_id, page_no, NULL, '' FROM b),
ordered AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line NULLS LAST)::INT AS line_no, text FROM t)
"""


@query(_layout_sql(False) + "SELECT * FROM ordered")
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.words_to_lines(_boxes(spark, sf_dir))


@query(_layout_sql(True) + "SELECT * FROM ordered")
def layout_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.words_to_lines(_boxes(spark, sf_dir), "geometric")


@query(_layout_sql(False) + ", " + _cleaned_sql("ordered") + ", " + JUDGED + ASSEMBLED + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g)::INT AS para, text FROM h")
def rip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.rip(_boxes(spark, sf_dir))


# phonemes: benchmark items against copies without every fifth word
LEX_VALUES = ", ".join(f"({k}, '{x}')" for k, x in enumerate(scoring.SAMPLE.splitlines()))
LEXICON = f"""x AS (SELECT * FROM (VALUES {LEX_VALUES}) v(line_no, value)), y AS (SELECT line_no, lower(split_part(split_part(value, '  ', 1), '(', 1)) AS word,
  list_transform(string_split(split_part(value, '  ', 2), ' '), lambda z: regexp_replace(z, '[0-9]+$', '')) AS phones FROM x WHERE NOT starts_with(value, ';;;')),
lex AS (SELECT word, arg_min(phones, line_no) AS phones FROM y GROUP BY word)"""
#: From pairs b (id, original, transcription) on: p a row a word, q the tokens of each text, r the error rates. The distance
#: counts bytes, so each of the tokens that there are, fewer than 90, is given a printable character.
TOKENS = f"""w AS (SELECT id, k, unnest(range(len(s))) AS pl, unnest(s) AS word FROM (SELECT id, k, string_split({_normal_sql('z')}, ' ') AS s FROM (SELECT id, 0 AS k, original AS z FROM b UNION ALL SELECT id, 1, transcription FROM b))),
p AS (SELECT id, k, pl, w.word, lex.word IS NULL AS oov, list_append(coalesce(lex.phones, list_transform(string_split(w.word, ''), lambda z: CASE z WHEN 'ß' THEN 'SS' ELSE upper(z) END)), '|') AS t FROM w LEFT JOIN lex USING (word) WHERE w.word <> ''),
q AS (SELECT id, k, flatten(list(t ORDER BY pl)) AS tokens FROM p GROUP BY id, k)
"""
PER = """, e AS (SELECT id, k, unnest(range(len(tokens))) AS pl, unnest(tokens) AS tok FROM q), code AS (SELECT tok, chr((33 + row_number() OVER (ORDER BY tok))::INT) AS c FROM (SELECT DISTINCT tok FROM e)),
s AS (SELECT id, k, count(*) AS n, string_agg(c, '' ORDER BY pl) AS s FROM e JOIN code USING (tok) GROUP BY id, k),
d AS (SELECT b.id, coalesce(o.n, 0) AS no, coalesce(h.n, 0) AS nh, coalesce(o.s, '') AS so, coalesce(h.s, '') AS sh FROM b LEFT JOIN s o ON o.id = b.id AND o.k = 0 LEFT JOIN s h ON h.id = b.id AND h.k = 1),
r AS (SELECT id, CASE WHEN greatest(no, nh) = 0 THEN 0.0 ELSE levenshtein(so, sh)::DOUBLE / greatest(no, nh) END::FLOAT AS per FROM d)
"""
SPOKEN = f"""WITH {LEXICON}, a AS (SELECT item_id AS id, text AS original FROM benchmark),
b AS (SELECT id, original, array_to_string(list_filter(string_split_regex(original, '[ \\n]+'), lambda z, i: i % 5 <> 0), ' ') AS transcription FROM a),
{TOKENS}"""
RATED = SPOKEN + PER


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("original"))
    return a.withColumn("transcription", F.array_join(F.filter(F.split("original", "[ \n]+"), lambda z, i: (i + 1) % 5 != 0), " "))


@query(f"WITH {LEXICON} SELECT word, array_to_string(phones, ' ') AS phones FROM lex")
def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.sample_lexicon(spark).select("word", F.array_join("phones", " ").alias("phones"))


@query(SPOKEN + "SELECT id, array_to_string(tokens, ' ') AS tokens FROM q WHERE k = 0")
def phoneme_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.phonemes(_spoken(spark, sf_dir), scoring.sample_lexicon(spark), "original").select("id", F.array_join("tokens", " ").alias("tokens"))


@query(SPOKEN + "SELECT id, count(*) AS n, count(*) FILTER (WHERE oov) AS oov FROM p WHERE k = 0 GROUP BY id")
def oov_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _spoken(spark, sf_dir).select("id", F.explode(F.split(T.normalized(F.col("original")), " ")).alias("word")).where("word <> ''")
    known = each.join(scoring.sample_lexicon(spark), "word", "left")
    return known.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("phones").isNull()).alias("oov"))


@query(RATED + "SELECT id, round(per::DOUBLE, 6) AS per FROM r")
def phoneme_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(_spoken(spark, sf_dir), scoring.sample_lexicon(spark)).select("id", F.round(F.col("per").cast("double"), 6).alias("per"))


@query(RATED + "SELECT id, per <= 0.15::FLOAT AS passed FROM r")
def quarantine_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(_spoken(spark, sf_dir), scoring.sample_lexicon(spark)).select("id", "passed")


# records: events as the batch log, paragraphs as chunks with statuses by number
EVENT = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE event_type END"


@query(f"SELECT pdf, greatest(s - e, 0) AS strikes FROM (SELECT user_id AS pdf, count(*) FILTER (WHERE {EVENT} = 'start') AS s, count(*) FILTER (WHERE {EVENT} IN ('complete', 'fail')) AS e FROM events GROUP BY 1) WHERE s > 0")
def strike_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.strikes(_t(spark, sf_dir, "events").select(F.col("user_id").alias("pdf"), F.expr(EVENT).alias("event")))


@query(f"SELECT pdf, s - e >= 2 AS poisoned FROM (SELECT user_id AS pdf, count(*) FILTER (WHERE {EVENT} = 'start') AS s, count(*) FILTER (WHERE {EVENT} IN ('complete', 'fail')) AS e FROM events GROUP BY 1)")
def poisoned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _t(spark, sf_dir, "events").select(F.col("user_id").alias("pdf"), F.expr(EVENT).alias("event"))
    return records.gated(log.select("pdf").distinct(), log)


STATUS = "CASE WHEN doc_id % 7 = 0 THEN 'Failed' WHEN (doc_id + ordinal) % 5 = 0 THEN 'Quarantined' ELSE 'Ok' END"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunk_boundaries(spark, sf_dir).withColumn("st", F.expr(STATUS))
    status = F.struct(F.col("st").alias("status"), F.when(F.col("st") == "Quarantined", F.col("text")).alias("original_text"), F.when(F.col("st") == "Failed", F.lit("no answer")).alias("reason"))
    return made.select(F.col("doc_id").alias("input_file"), "ordinal", T.artifact(F.col("ordinal")).alias("wav"), "trailing_boundary", status.alias("status"), "text")


@query(TAGGED + f"SELECT {STATUS} AS status, count(*) AS n FROM t GROUP BY 1")
def record_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.status_counts(_records(spark, sf_dir))


@query(TAGGED + f""", c AS (SELECT doc_id AS input_file, count(*) FILTER (WHERE {STATUS} = 'Ok') AS good, count(*) FILTER (WHERE {STATUS} <> 'Ok') AS bad FROM t GROUP BY 1),
o AS (SELECT *, CASE WHEN good = 0 THEN 'Picturebook' WHEN bad = 0 THEN 'Clean' ELSE 'Part' END AS outcome FROM c)
SELECT *, 'complete' AS event, input_file || CASE outcome WHEN 'Clean' THEN '.mp3' WHEN 'Part' THEN '_part.mp3' ELSE '_picturebook.txt' END AS artifact FROM o""")
def outcome_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.outcomes(_records(spark, sf_dir))


@query(TAGGED + f"SELECT doc_id AS input_file, ordinal::INT AS ordinal, text FROM t WHERE {STATUS} = 'Quarantined'")
def retry_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.to_retry(_records(spark, sf_dir)).select("input_file", "ordinal", "text")


@query(TAGGED + f"SELECT doc_id AS input_file, ordinal::INT AS ordinal, CASE WHEN {STATUS} = 'Quarantined' AND ordinal % 2 = 0 THEN 'Ok' ELSE {STATUS} END AS status FROM t")
def quarantine_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return records.repaired(r, records.to_retry(r).where("ordinal % 2 = 0")).select("input_file", "ordinal", F.col("status.status").alias("status"))


@query(TAGGED + f"SELECT doc_id AS input_file, ordinal::INT AS ordinal, (doc_id + ordinal) % 3 <> 0 AS there FROM t WHERE {STATUS} = 'Ok'")
def mergeable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    there, missing = records.mergeable(r, r.where("(input_file + ordinal) % 3 <> 0").select("input_file", "wav"))
    pick = lambda d, yes: d.select("input_file", "ordinal", F.lit(yes).alias("there"))
    return pick(there, True).unionAll(pick(missing, False))


# audio: a chunk's data is taken as 100 bytes a character at 24 kHz, one channel, 16 bits
GAPS = "((24000::BIGINT * CASE trailing_boundary WHEN 'Paragraph' THEN 360 WHEN 'Sentence' THEN 180 ELSE 0 END) // 1000 * 2)"
PLAN = TAGGED + f", u AS (SELECT doc_id, ordinal, length(text) * 100 AS data_len, coalesce({GAPS}, 0) AS gap_len FROM t WHERE {STATUS} = 'Ok') "


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, _ = records.mergeable(_records(spark, sf_dir))
    parts = ok.select(F.col("input_file").alias("doc_id"), "ordinal", (F.length("text").cast("long") * 100).alias("data_len"), "trailing_boundary", F.lit(24000).alias("sample_rate"), F.lit(1).alias("channels"), F.lit(16).alias("bits_per_sample"))
    return audio.merge_plan(parts)


@query(PLAN + "SELECT doc_id, ordinal::INT AS ordinal, gap_len::BIGINT AS gap_len, coalesce(sum(data_len + gap_len) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM u")
def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("doc_id", "ordinal", "gap_len", "start")


@query(PLAN + "SELECT doc_id, least(sum(data_len + gap_len), 4294967295)::BIGINT AS data_len, least(sum(data_len + gap_len), 4294967295)::DOUBLE / 48000 AS seconds FROM u GROUP BY doc_id")
def merged_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.merged_length(_plan(spark, sf_dir))


@query("SELECT event_id, (8000 + event_id % 5 * 11025)::BIGINT * (event_id % 700) // 1000 * (1 + event_id % 2) * 2 AS bytes FROM events")
def silence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = audio.silence_length(F.expr("8000 + event_id % 5 * 11025"), F.expr("1 + event_id % 2"), F.lit(16), F.expr("event_id % 700"))
    return _t(spark, sf_dir, "events").select("event_id", length.cast("long").alias("bytes"))


@query("""WITH e AS (SELECT vec_id, embedding AS v, unnest(range(floor(len(embedding) / 0.75)::INT)) AS i FROM embeddings),
p AS (SELECT vec_id, i, v[floor(i * 0.75::DOUBLE)::INT + 1] AS a, v[least(floor(i * 0.75::DOUBLE)::INT + 2, len(v))] AS b, (i * 0.75::DOUBLE - floor(i * 0.75::DOUBLE))::FLOAT AS f FROM e)
SELECT vec_id, i::INT AS i, round((a + (b - a) * f)::DOUBLE, 6) AS x FROM p""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(audio.resampled(F.col("embedding"), 12000)).alias("i", "x"))
    return out.select("vec_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("SELECT vec_id, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings")
def decode_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components as the samples of float WAVs, read back."""
    le = lambda f: struct.pack(f"<{len(f)}f", *f)
    made = flat_mapped(_t(spark, sf_dir, "embeddings"), ["vec_id"], ["embedding"], "content binary", lambda: lambda v: [(audio.write_header(3, 1, 24000, 32, 4 * len(v)) + le(v),)])
    return audio.decoded(made).select("vec_id", F.posexplode("samples").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"SELECT conv_id, string_agg(x, ' ' ORDER BY turn, x) AS text FROM (SELECT conv_id, turn, {_trim("chr(9) || text || chr(160)")} AS x FROM conversations) WHERE x <> '' GROUP BY conv_id")
def segments_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as the segments of one transcription."""
    said = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("\t"), "text", F.lit("\u00a0")).alias("x"))
    own = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "x"))).alias("s"))
    return own.select("conv_id", audio.segments_joined(F.col("s.x")).alias("text"))


def _wavs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = chunk_boundaries(spark, sf_dir).select(F.struct("doc_id", "ordinal", "trailing_boundary").alias("id"), "text")
    return models.speak(texts, models.tone_speaker).drop("error")


@query(TAGGED + "SELECT doc_id, ordinal::INT AS ordinal, 24000::BIGINT AS sample_rate, (length(text) * 2)::BIGINT AS data_len FROM t")
def wav_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.headers(_wavs(spark, sf_dir).select("id", F.col("wav").alias("content"))).select("id.doc_id", "id.ordinal", "sample_rate", "data_len")


@query(TAGGED + f"SELECT doc_id, (44 + sum(length(text) * 2 + coalesce({GAPS}, 0)))::BIGINT AS bytes, hex(encode('RIFF')) AS magic FROM t GROUP BY doc_id")
def merged_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = audio.merge(_wavs(spark, sf_dir).select("id.*", F.col("wav").alias("content")))
    return merged.select("doc_id", F.octet_length("content").cast("long").alias("bytes"), F.hex(F.substr("content", F.lit(1), F.lit(4))).alias("magic"))


def _shout() -> Callable[[str], str]:
    """A stand-in for a rewriter: drops paragraphs of few letters, answers those that start with E by white space, the rest in part in upper case."""
    return lambda text: " DROP\n" if len(text) < 40 else " \n" if text[0] == "E" else f"<think>hm</think> {text.replace('the', 'THE')} \n" if text[0] < "P" else f"\t{text} "


#: What _shout leaves of a paragraph.
SHOUTED = "CASE WHEN length(text) < 40 THEN NULL WHEN left(text, 1) = 'E' OR left(text, 1) >= 'P' THEN text ELSE replace(text, 'the', 'THE') END"


@query(PARAS + f""", r AS (SELECT *, {SHOUTED} AS cleaned FROM p)
SELECT doc_id, coalesce(string_agg(cleaned, chr(10) || chr(10) ORDER BY pos), '') AS text, count(*) FILTER (WHERE cleaned <> text) AS rewritten, count(*) FILTER (WHERE cleaned IS NULL) AS dropped FROM r GROUP BY doc_id""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.clean_text(_docs(spark, sf_dir), _shout).select("doc_id", "text", "rewritten", "dropped")


def _deaf() -> Callable[[bytes], str]:
    """A stand-in for a listener: what is not ASCII it hears as nothing, and of a text that begins with O only the first ten letters."""

    def hear(wav: bytes) -> str:
        text = models.tone_reader()(wav)
        return text[:10] if text[0] == "O" else text if text.isascii() else ""

    return hear


def _choosy() -> Callable[[str], bytes]:
    """A stand-in for speech that can't speak what begins with T."""

    def say(text: str) -> bytes:
        if text[0] == "T":
            raise ValueError("no voice")
        return models.tone_speaker()(text)

    return say


#: Whether a text ends in a closing mark; what it becomes before it is spoken; what _deaf hears of it.
CLOSED = "regexp_matches(regexp_replace(x, '" + WS + "+$', ''), '[.!?…\"'']$')"
SAYS = f"CASE WHEN {CLOSED} THEN x ELSE regexp_replace(x, '{WS}+$', '') || '.' END"
HEARS = "CASE WHEN left(z, 1) = 'O' THEN left(z, 10) WHEN regexp_matches(z, '[^\\x00-\\x7F]') THEN '' ELSE z END"
#: Both attempts at benchmark items: id * 2 is the first, id * 2 + 1 the second, made for all here and picked by what the first left.
TRIES = f"""WITH {LEXICON}, i AS (SELECT item_id, text AS x FROM benchmark WHERE left(text, 1) <> 'T'),
z AS (SELECT item_id * 2 AS id, x, {SAYS} AS z FROM i UNION ALL SELECT item_id * 2 + 1, x, {SANITIZED} FROM i),
b AS (SELECT id, x AS original, {HEARS} AS transcription FROM z),
{TOKENS}{PER}, t AS (SELECT b.id // 2 AS id, b.id % 2 + 1 AS attempt, b.transcription, r.per, r.per <= 0.15::FLOAT AS passed FROM b JOIN r USING (id)),
u AS (SELECT * FROM t WHERE attempt = 1 OR id IN (SELECT id FROM t WHERE attempt = 1 AND NOT passed))
"""


def _tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return scoring.attempted(items, lambda d: models.speak(d, _choosy), lambda d: models.transcribe(d, _deaf), scoring.sample_lexicon(spark))


@query(TRIES + "SELECT id, attempt::INT AS attempt, transcription, round(per::DOUBLE, 6) AS per, passed FROM u UNION ALL SELECT item_id, 1, NULL, NULL, false FROM benchmark WHERE left(text, 1) = 'T'")
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tries(spark, sf_dir).select("id", "attempt", "transcription", F.round(F.col("per").cast("double"), 6).alias("per"), "passed")


@query(TRIES + "SELECT id, max(attempt)::INT AS attempts, CASE WHEN max_by(passed, attempt) THEN 'Ok' ELSE 'Quarantined' END AS status FROM u GROUP BY id UNION ALL SELECT item_id, 1, 'Failed' FROM benchmark WHERE left(text, 1) = 'T'")
def validate_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.verdicts(_tries(spark, sf_dir)).select("id", "attempts", "status")


@query(TRIES + "SELECT id, 'ORIGINAL:' || chr(10) || any_value(text) || chr(10) || chr(10) || 'TRANSCRIPTION:' || chr(10) || max_by(transcription, attempt) || chr(10) || chr(10) || 'PHONEME_ERROR: ' || printf('%.4f', max_by(per, attempt)::DOUBLE) || chr(10) || 'ATTEMPTS: 2' || chr(10) AS report FROM u JOIN benchmark ON item_id = id GROUP BY id HAVING NOT max_by(passed, attempt)")
def quarantine_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.sidecars(_tries(spark, sf_dir)).where("report IS NOT NULL").select("id", "report")


# whole runs with stand-ins: speech as above, gaps and chunk sizes as the settings have them
RUN = PARAS + f""", r AS (SELECT doc_id, pos, {SHOUTED} AS text FROM p), kept AS (SELECT * FROM r WHERE text IS NOT NULL),
t AS (SELECT doc_id, row_number() OVER w AS ordinal, text, text AS x, CASE WHEN lead(pos) OVER w IS NULL THEN NULL ELSE 'Paragraph' END AS trailing_boundary FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT doc_id, ordinal, text, trailing_boundary, left(text, 1) = 'T' AS mute, length({SAYS}) * 2 + coalesce({GAPS}, 0) AS n FROM t)
"""


def _run(spark: SparkSession, sf_dir: str, **more: object) -> tuple[drivers.Run, drivers.Steps, Config]:
    steps = drivers.Steps(speak=_choosy, rewrite=_shout, transcribe=_deaf, lexicon=scoring.sample_lexicon(spark))
    cfg = Config(llm_clean=True, max_words=0, **more)
    return drivers.default_run(_docs(spark, sf_dir), steps, cfg), steps, cfg


@query(RUN + "SELECT doc_id AS input_file, ordinal::INT AS ordinal, CASE WHEN mute THEN 'Failed' ELSE 'Ok' END AS status, CASE WHEN mute THEN 'ValueError: no voice' END AS reason FROM c")
def default_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[0].chunks.select("input_file", "ordinal", "status.status", "status.reason")


@query(RUN + "SELECT doc_id, (44 + sum(n))::BIGINT AS bytes FROM c WHERE NOT mute GROUP BY doc_id")
def default_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[0].merged.select("doc_id", F.octet_length("content").cast("long").alias("bytes"))


@query(RUN + ", g AS (SELECT d.doc_id, count(*) FILTER (WHERE NOT mute) AS good, count(*) FILTER (WHERE mute) AS failed FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY 1) SELECT doc_id, good, failed, CASE WHEN good = 0 THEN 'Picturebook' WHEN failed = 0 THEN 'Clean' ELSE 'Part' END AS outcome FROM g")
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drivers.job_outcomes(_run(spark, sf_dir)[0]).select("doc_id", "good", "failed", "outcome")


@query(RUN + "SELECT doc_id, (44 + sum(n))::BIGINT AS bytes FROM c WHERE NOT mute AND (doc_id + ordinal) % 3 <> 0 GROUP BY doc_id")
def merge_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the files is lost before merging anew."""
    run, _, cfg = _run(spark, sf_dir, merge=False)
    files = run.chunks.where("audio IS NOT NULL AND (input_file + ordinal) % 3 <> 0").select("input_file", "wav", F.col("audio").alias("content"))
    return drivers.merge_only(run.chunks.drop("audio"), files, cfg)[0].select("doc_id", F.octet_length("content").cast("long").alias("bytes"))


@query(TAGGED + f"SELECT doc_id AS input_file, ordinal::INT AS ordinal, CASE WHEN {STATUS} = 'Quarantined' AND left(ltrim(y), 1) <> 'T' THEN 'Ok' ELSE {STATUS} END AS status FROM (SELECT *, {SANITIZED} AS y FROM (SELECT *, text AS x FROM t))")
def fix_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = drivers.Steps(speak=_choosy)
    return drivers.fix_quarantine(_records(spark, sf_dir), steps, Config())[0].select("input_file", "ordinal", F.col("status.status").alias("status"))
