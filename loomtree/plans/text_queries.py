"""Queries on text: tokenizers, estimates, decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import parsing
from . import sql
from .ingest import conversations
from .registry import query, table

_TEXT = "coalesce(text, '')"


@query(f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({sql.tokens(_TEXT)}) AS token FROM documents) GROUP BY ALL")
def tokenize_index(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.explode(T.index_tokens_h(F.coalesce("text", F.lit("")))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(lower({_TEXT}), '[a-z0-9]+'), lambda t: strlen(t) BETWEEN 2 AND 255)) AS token FROM documents) GROUP BY ALL")
def tokenize_index_e(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.explode(T.index_tokens_e(F.coalesce("text", F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(rf"SELECT doc_id, len(list_filter(string_split_regex(translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r]+'), lambda t: strlen(t) BETWEEN 1 AND 63)[1:64]) AS n, md5(array_to_string(list_filter(string_split_regex(translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r]+'), lambda t: strlen(t) BETWEEN 1 AND 63)[1:64], '|')) AS digest FROM documents")
def tokenize_call_e(spark, sf):
    tokens = T.call_tokens_e(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.size(tokens).cast("long").alias("n"), F.md5(F.array_join(tokens, "|")).alias("digest"))


@query(rf"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_TEXT}, '[\p{{L}}\p{{Nd}}]+')) AS word FROM documents) GROUP BY ALL")
def tokenize_keywords(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.explode(T.keyword_words_h(F.coalesce("text", F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, (strlen({_TEXT}) + 3) // 4 AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))


@query(rf"""WITH l AS (SELECT doc_id, trim(regexp_replace(replace({_TEXT}, chr(10), ' '), ' +', ' ', 'g'), ' ') AS line FROM documents)
SELECT doc_id, CASE WHEN length(line) > 80 THEN left(line, 77) || '...' ELSE line END AS preview FROM l""")
def preview_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.preview(F.coalesce("text", F.lit("")), 80).alias("preview"))


@query("SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'license')")
def substring_ascii(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(T.contains_ascii(F.col("text"), "LICENSE")).select("doc_id")


@query(f"WITH {sql.MESSAGES}, {sql.SENTENCES} SELECT conv_id, turn, block_ix, para, listed FROM p")
def split_paragraphs(spark, sf):
    rows = conversations(table(spark, sf, "conversations"))
    parts = F.posexplode(parsing.paragraphs(F.col("content"))).alias("block_ix", "para")
    rows = rows.select(F.col("session_seq").alias("conv_id"), "turn", parts)
    return rows.select("conv_id", "turn", F.col("block_ix").cast("long").alias("block_ix"), "para", parsing.is_list(F.col("para")).alias("listed"))


@query(f"WITH {sql.MESSAGES}, {sql.SENTENCES} SELECT conv_id, turn, block_ix, stmt_ix, stmt FROM s")
def split_sentences(spark, sf):
    rows = conversations(table(spark, sf, "conversations")).select("session_seq", "turn", F.posexplode(parsing.parse_h(F.col("content"))).alias("block_ix", "b"))
    rows = rows.select("session_seq", "turn", "block_ix", F.posexplode("b.statements").alias("stmt_ix", "s"))
    return rows.select(F.col("session_seq").alias("conv_id"), "turn", F.col("block_ix").cast("long").alias("block_ix"), F.col("stmt_ix").cast("long").alias("stmt_ix"), F.col("s.content").alias("stmt"))


@query(r"""WITH l AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
x AS (SELECT conv_id, turn, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_ix FROM l)
SELECT conv_id, turn, line_ix, regexp_replace(line, '[ \t]+$', '') AS line FROM x""")
def split_code_lines(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(parsing.code_lines(F.coalesce("text", F.lit("")))).alias("line_ix", "line"))
    return rows.withColumn("line_ix", F.col("line_ix").cast("long"))


LISTS = ("- one\n- two\n  more of two\n- three", "1. first\n2. second", "plain\ntext here\nand more\nand - no", "* a\n\n* b", "+ x\nrest\nrest\nrest", "intro\n- a\n- b", "")


@query("SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, true), (4, false), (5, true), (6, false)) t(id, listed)")
def detect_lists(spark, sf):
    rows = spark.createDataFrame(list(enumerate(LISTS)), "id int, para string")
    return rows.select("id", parsing.is_list(F.col("para")).alias("listed"))


@query("""SELECT * FROM (VALUES (0, 0, '- one'), (0, 1, '- two' || chr(10) || '  more of two'), (0, 2, '- three'), (1, 0, '1. first'), (1, 1, '2. second'),
(3, 0, '* a'), (3, 1, '* b'), (5, 0, 'intro'), (5, 1, '- a'), (5, 2, '- b')) t(id, item_ix, item)""")
def split_list_items(spark, sf):
    rows = spark.createDataFrame(list(enumerate(LISTS)), "id int, para string").filter(parsing.is_list(F.col("para")))
    return rows.select("id", F.posexplode(parsing.list_items(F.col("para"))).alias("item_ix", "item"))


FENCED = (
    "Intro text. More here.\n\n```python\nx = 1\n\ny = 2  \n```\nAfter. The end",
    "```\nno lang\n```",
    "Dr. Smith came. He left! Really?\n\n- a\n- b\n  c",
    "   \n ",
    "unclosed ```go\nfunc x() {}",
    "~~~sh\nls\n~~~\nDone. Next",
)


_CODE, _LIST, _DR = "x = 1\n\ny = 2  \n", "- a\n- b\n  c", "Dr. Smith came. He left! Really?"
_PARSED = "id, block_ix, block_type, lang, block, stmt_ix, stmt_type, statement"
PARSED_H = (
    (0, 0, "paragraph", "", "Intro text. More here.", 0, "sentence", "Intro text."),
    (0, 0, "paragraph", "", "Intro text. More here.", 1, "sentence", "More here."),
    (0, 1, "code", "python", _CODE, 0, "code_line", "x = 1"),
    (0, 1, "code", "python", _CODE, 1, "code_line", ""),
    (0, 1, "code", "python", _CODE, 2, "code_line", "y = 2"),
    (0, 1, "code", "python", _CODE, 3, "code_line", ""),
    (0, 2, "paragraph", "", "After. The end", 0, "sentence", "After."),
    (0, 2, "paragraph", "", "After. The end", 1, "sentence", "The end"),
    (1, 0, "code", "", "no lang\n", 0, "code_line", "no lang"),
    (1, 0, "code", "", "no lang\n", 1, "code_line", ""),
    (2, 0, "paragraph", "", _DR, 0, "sentence", "Dr. Smith came."),
    (2, 0, "paragraph", "", _DR, 1, "sentence", "He left!"),
    (2, 0, "paragraph", "", _DR, 2, "sentence", "Really?"),
    (2, 1, "list", "", _LIST, 0, "list_item", "- a"),
    (2, 1, "list", "", _LIST, 1, "list_item", "- b\n  c"),
    (3, None, None, None, None, None, None, None),
    (4, 0, "paragraph", "", FENCED[4], 0, "sentence", FENCED[4]),
    (5, 0, "paragraph", "", FENCED[5], 0, "sentence", "~~~sh\nls\n~~~\nDone."),
    (5, 0, "paragraph", "", FENCED[5], 1, "sentence", "Next"),
)
PARSED_E = (
    (0, 0, "paragraph", "", "Intro text. More here.", 0, "sentence", "Intro text."),
    (0, 0, "paragraph", "", "Intro text. More here.", 1, "sentence", "More here."),
    (0, 1, "code", "python", _CODE[:-1], 0, "code_line", "x = 1"),
    (0, 1, "code", "python", _CODE[:-1], 1, "code_line", "y = 2"),
    (0, 2, "paragraph", "", "After. The end", 0, "sentence", "After."),
    (0, 2, "paragraph", "", "After. The end", 1, "sentence", "The end"),
    (1, 0, "code", "", "no lang", 0, "code_line", "no lang"),
    (2, 0, "paragraph", "", _DR, 0, "sentence", "Dr. Smith came."),
    (2, 0, "paragraph", "", _DR, 1, "sentence", "He left!"),
    (2, 0, "paragraph", "", _DR, 2, "sentence", "Really?"),
    (2, 1, "paragraph", "", _LIST, 0, "sentence", _LIST),
    (3, None, None, None, None, None, None, None),
    (4, 0, "paragraph", "", "unclosed", 0, "sentence", "unclosed"),
    (4, 1, "code", "go", "func x() {}", 0, "code_line", "func x() {}"),
    (5, 0, "code", "sh", "ls", 0, "code_line", "ls"),
    (5, 1, "paragraph", "", "Done. Next", 0, "sentence", "Done."),
    (5, 1, "paragraph", "", "Done. Next", 1, "sentence", "Next"),
)


@query(sql.values(PARSED_H, _PARSED))
def parse_full_message(spark, sf):
    rows = spark.createDataFrame(list(enumerate(FENCED)), "id int, content string")
    return parsing.exploded(rows).select("id", "block_ix", "block_type", "lang", "block", "stmt_ix", "stmt_type", "statement")


@query(sql.values(PARSED_E, _PARSED))
def parse_profile_e(spark, sf):
    rows = spark.createDataFrame(list(enumerate(FENCED)), "id int, content string")
    return parsing.exploded(rows, profile="E").select("id", "block_ix", "block_type", "lang", "block", "stmt_ix", "stmt_type", "statement")


_TEXT = "coalesce(text, '')"


@query(f"SELECT doc_id, {sql.times_hash(_TEXT, 31, 0)} AS h31, {sql.times_hash(_TEXT, 33, 5381)} AS djb2 FROM documents")
def text_hashes(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", T.times_hash(text, 31, 0).alias("h31"), T.djb2(text).alias("djb2"))
