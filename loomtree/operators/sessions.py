"""Sessions, and keywords, identifiers and file paths found in their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import IDENTIFIER_SKIP_WORDS_E, KEYWORD_STOP_WORDS_E, KEYWORD_STOP_WORDS_H, keyword_words_h, word_tokens_e, words
from ..profile import BLOCK, MAX_FILES, MAX_IDENTIFIERS, MAX_KEYWORDS, MESSAGE, SESSION, STATEMENT

# Patterns and directory names that results depend on.
PATH_H = r"""(?:^|[\s"'\(])(/[^\s"'\)]+|[a-zA-Z]:\\[^\s"'\)]+|\.{1,2}/[^\s"'\)]+)"""
IDENTIFIER_H = r"\b([a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z]+_[a-z_0-9]+|[A-Z][a-z]+[A-Z][a-zA-Z0-9]*)\b"
DIRECTORIES = "src lib bin pkg cmd internal test tests docs".split()
# End of fixed values.
PATH_E = r"(?:(?<![A-Za-z0-9_./+-])/[A-Za-z0-9_]|(?<![A-Za-z0-9_/+-])\.\.?/|(?<![A-Za-z0-9_./+-])[A-Za-z0-9])[A-Za-z0-9_/.+-]*"


def file_paths_h(c: Column) -> Column:
    """Absolute, drive and dotted paths that look like files or directories, each once, in order."""
    found = F.transform(F.regexp_extract_all(c, F.lit(PATH_H), F.lit(1)), F.trim)

    def likely(p: Column) -> Column:
        last = F.element_at(F.split(p, "/"), -1)
        known = F.exists(words(*DIRECTORIES), lambda d: F.contains(F.lower(p), d))
        return (F.contains(p, F.lit("/")) | F.contains(p, F.lit("\\"))) & (F.contains(last, F.lit(".")) | known | ((F.octet_length(p) > 3) & (F.size(F.split(p, "/")) > 1)))

    return F.array_distinct(F.filter(found, likely))


def identifiers_h(c: Column) -> Column:
    """camelCase, snake_case and PascalCase names of four bytes or more, each once, in order."""
    stop = words(*sorted(set(KEYWORD_STOP_WORDS_H)))
    found = F.regexp_extract_all(c, F.lit(IDENTIFIER_H), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: (F.octet_length(x) >= 4) & ~F.array_contains(stop, F.lower(x))))


def keyword_list_h(c: Column) -> Column:
    """Lower-cased words that count as keywords, repeated ones too."""
    stop = words(*sorted(set(KEYWORD_STOP_WORDS_H)))
    kept = F.filter(keyword_words_h(c), lambda w: (F.octet_length(w) >= 3) & ~F.array_contains(stop, F.lower(w)))
    return F.transform(kept, F.lower)


def top_keywords(docs: DataFrame, key: str, content: str, k: int = 20) -> DataFrame:
    """key, word, n, rank: the k most frequent keywords of each text, ties by word."""
    said = docs.select(key, F.explode(keyword_words_h(F.col(content))).alias("raw")).withColumn("word", F.lower("raw"))
    said = said.filter((F.octet_length("raw") >= 3) & ~F.col("word").isin(KEYWORD_STOP_WORDS_H))
    counts = said.groupBy(key, "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def extract_many(docs: DataFrame, key: str, content: str) -> DataFrame:
    """kind (keyword, identifier, file), value, n_docs over all texts."""
    kw = top_keywords(docs, key, content).select(F.lit("keyword").alias("kind"), F.col("word").alias("value"), key)
    ids = docs.select(F.lit("identifier").alias("kind"), F.explode(identifiers_h(F.col(content))).alias("value"), key)
    files = docs.select(F.lit("file").alias("kind"), F.explode(file_paths_h(F.col(content))).alias("value"), key)
    return kw.unionByName(ids).unionByName(files).groupBy("kind", "value").agg(F.count("*").alias("n_docs"))


def keyword_words_e(c: Column) -> Column:
    """Words of two letters or more that don't start with a digit and are no stop words."""
    stop = words(*sorted(set(KEYWORD_STOP_WORDS_E)))
    return F.filter(word_tokens_e(c), lambda w: (F.octet_length(w) >= 2) & ~w.rlike("^[0-9]") & ~F.array_contains(stop, w))


def _said_e(docs: DataFrame, key: str, content: str) -> DataFrame:
    """key, word for every keyword_words_e of a text."""
    found = F.regexp_extract_all(F.lower(F.col(content)), F.lit(r"[a-z0-9_]+"), F.lit(0))
    rows = docs.select(key, F.explode(found).alias("word"))
    return rows.filter(F.octet_length("word").between(2, 63) & ~F.substring("word", 1, 1).between("0", "9") & ~F.col("word").isin(KEYWORD_STOP_WORDS_E))


def document_frequencies(docs: DataFrame, content: str) -> DataFrame:
    """word, df: in how many texts a word occurs."""
    return docs.select(F.explode(F.array_distinct(keyword_words_e(F.col(content)))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def tfidf_keywords(docs: DataFrame, key: str, content: str, k: int = 32, frequencies: DataFrame | None = None, n_docs: int | None = None) -> DataFrame:
    """key, word, score, rank by tf x idf x length boost. Without frequencies idf is 1; words unknown to them too.

    The boost is 1 + 0.1 per letter over three, at least 1 (for two letters too) and at most 2.
    """
    counts = _said_e(docs, key, content).groupBy(key, "word").agg(F.count("*").alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"))
    rows = counts.join(totals, key)
    idf = F.lit(1.0)
    if frequencies is not None:
        rows = rows.join(frequencies, "word", "left")
        idf = F.coalesce(F.log(F.lit(float(n_docs)) / F.col("df")), F.lit(1.0))
    boost = F.least(F.greatest(1.0 + 0.1 * (F.octet_length("word") - 3), F.lit(1.0)), F.lit(2.0))
    rows = rows.withColumn("score", F.col("n") / F.col("total") * idf * boost)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "word"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select(key, "word", "score", "rank")


def running_frequencies(docs: DataFrame, order: str, content: str) -> DataFrame:
    """order, word, df_before: in how many earlier texts each word of a text occurred."""
    pairs = docs.select(order, F.explode(F.array_distinct(keyword_words_e(F.col(content)))).alias("word"))
    before = Window.partitionBy("word").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pairs.withColumn("df_before", F.count("*").over(before))


def identifiers_e(c: Column, most: int = 128) -> Column:
    """array<struct<name, kind>>: FUNCTION before an opening parenthesis; TYPE with a capital first and no underscore; CONSTANT in
    capitals with an underscore, three letters or more. Language keywords are skipped. The last word counts like any other."""
    calls = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+\s*\(?"), F.lit(0))
    skip = words(*IDENTIFIER_SKIP_WORDS_E)

    def one(x: Column) -> Column:
        name = F.regexp_extract(x, "^[A-Za-z0-9_]+", 0)
        kind = (
            F.when(x.endswith("("), "FUNCTION")
            .when(name.rlike("^[A-Z]") & ~F.contains(name, F.lit("_")), "TYPE")
            .when(name.rlike("^[A-Z][A-Z0-9_]{2,}$"), "CONSTANT")
        )
        return F.struct(name.alias("name"), F.when((F.octet_length(name) < 2) | (F.octet_length(name) > 63) | F.array_contains(skip, name), None).otherwise(kind).alias("kind"))

    return F.slice(F.filter(F.transform(calls, one), lambda x: x["kind"].isNotNull()), 1, most)


def file_paths_e(c: Column, most: int = 32) -> Column:
    """Rooted and dotted paths, and relative ones with a slash and a short extension; three bytes or more, each once, in order."""
    found = F.regexp_extract_all(c, F.lit(PATH_E), F.lit(0))
    rooted = lambda p: p.rlike(r"^(/[A-Za-z0-9_]|\.\.?/)")
    inner = lambda p: p.rlike(r"\.[A-Za-z]{1,4}(?![A-Za-z])") & (F.octet_length(p) >= 5)
    return F.slice(F.array_distinct(F.filter(found, lambda p: F.contains(p, F.lit("/")) & (F.octet_length(p) >= 3) & (rooted(p) | inner(p)))), 1, most)


def merge_first_seen(values: DataFrame, key: str, value: str, order: list[str], cap: int) -> DataFrame:
    """key, values: distinct values in the order they were first seen, at most cap."""
    first = values.groupBy(key, value).agg(F.min(F.struct(*order)).alias("at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("at", value))
    kept = first.withColumn("r", rank).filter(F.col("r") <= cap)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", value))), lambda x: x[value]).alias("values"))


def merge_scored(values: DataFrame, key: str, order: list[str], cap: int = MAX_KEYWORDS) -> DataFrame:
    """key, words array<struct<word, score>>: the largest score of each word, in the order first seen, at most cap."""
    first = values.groupBy(key, "word").agg(F.min(F.struct(*order)).alias("at"), F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("at", "word"))
    kept = first.withColumn("r", rank).filter(F.col("r") <= cap)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word", "score"))), lambda x: F.struct(x["word"].alias("word"), x["score"].alias("score"))).alias("words"))


def build_sessions(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, agent_id, root_node_id, message_count, block_count, statement_count, created_at, last_active_at, keywords, identifiers,
    files_touched. agent_id is that of the first message."""
    at = lambda level: F.count_if(F.col("level") == level)
    counts = nodes.groupBy("session_id").agg(F.min(F.when(F.col("level") == SESSION, F.col("node_id"))).alias("root_node_id"), at(MESSAGE).alias("message_count"), at(BLOCK).alias("block_count"), at(STATEMENT).alias("statement_count"))
    times = messages.groupBy("session_id").agg(F.min_by("agent_id", "turn").alias("agent_id"), F.min("created_at").alias("created_at"), F.max("created_at").alias("last_active_at"))
    keyed = messages.select("session_id", "turn", F.struct("session_id", "turn").alias("message"), "content")
    kw = top_keywords(keyed, "message", "content").select(F.col("message.session_id").alias("session_id"), F.col("message.turn").alias("turn"), "rank", "word")
    kw = merge_first_seen(kw, "session_id", "word", ["turn", "rank"], MAX_KEYWORDS).withColumnRenamed("values", "keywords")
    out = counts.join(times, "session_id").join(kw, "session_id", "left")
    for name, find, cap in (("identifiers", identifiers_h, MAX_IDENTIFIERS), ("files_touched", file_paths_h, MAX_FILES)):
        found = keyed.select("session_id", "turn", F.posexplode(find(F.col("content"))).alias("pos", "value"))
        out = out.join(merge_first_seen(found, "session_id", "value", ["turn", "pos"], cap).withColumnRenamed("values", name), "session_id", "left")
    for name in ("keywords", "identifiers", "files_touched"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.withColumn("title", F.lit(None).cast("string"))


def get_session(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.filter(F.col("session_id") == session_id)


def list_sessions(sessions: DataFrame, agent_id: str | None = None, since=None, keyword: str | None = None, limit: int = 0) -> DataFrame:
    """By session_id; filters on agent, creation time (inclusive) and keyword substring."""
    out = sessions
    if agent_id is not None:
        out = out.filter(F.col("agent_id") == agent_id)
    if since is not None:
        out = out.filter(F.col("created_at") >= F.lit(since))
    if keyword is not None:
        out = out.filter(F.exists("keywords", lambda k: F.contains(k, F.lit(keyword))))
    out = out.orderBy("session_id")
    return out.limit(limit) if limit > 0 else out


def find_by_file(sessions: DataFrame, part: str) -> DataFrame:
    return sessions.filter(F.exists("files_touched", lambda f: F.contains(f, F.lit(part)))).orderBy("session_id")


def session_stats(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("total_sessions"), F.countDistinct("agent_id").alias("unique_agents"))


def update_session(sessions: DataFrame, session_id: str, **values) -> DataFrame:
    """Set columns of one session: title, last_active_at, ..."""
    out = sessions
    for name, value in values.items():
        out = out.withColumn(name, F.when(F.col("session_id") == session_id, F.lit(value).cast(dict(sessions.dtypes)[name])).otherwise(F.col(name)))
    return out


def touch(sessions: DataFrame, activity: DataFrame) -> DataFrame:
    """last_active_at and counters after activity (session_id, at, messages, blocks, statements)."""
    sums = activity.groupBy("session_id").agg(F.max("at").alias("at"), *(F.sum(c).alias("d_" + c) for c in ("messages", "blocks", "statements")))
    out = sessions.join(sums, "session_id", "left").withColumn("last_active_at", F.greatest("last_active_at", "at"))
    for c in ("message", "block", "statement"):
        out = out.withColumn(f"{c}_count", F.col(f"{c}_count") + F.coalesce(f"d_{c}s", F.lit(0)))
    return out.select(*sessions.columns)


def delete_sessions(sessions: DataFrame, gone: DataFrame) -> DataFrame:
    return sessions.join(gone.select("session_id"), "session_id", "left_anti")
