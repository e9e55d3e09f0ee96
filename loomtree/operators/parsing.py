"""Messages to blocks and statements. Profile H as column expressions; profile E, whose sentence rule needs context, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ABBREVIATIONS_H, MARKER, strip

FENCE = r"(?s)```(\w*)\n?(.*?)```"
_CUT, _MASK = "\u0001", "\u0002"
BLOCKS = "array<struct<type:string,lang:string,content:string,statements:array<struct<content:string,type:string>>>>"

# Abbreviations that end no sentence in profile E.
ABBREVIATIONS_E = (
    "Dr. Mr. Mrs. Ms. Prof. Sr. Jr. vs. etc. e.g. i.e. viz. cf. Inc. Ltd. Corp. Co. "
    "Jan. Feb. Mar. Apr. Jun. Jul. Aug. Sep. Sept. Oct. Nov. Dec. St. Ave. Blvd. Rd. "
    "Fig. fig. Eq. eq. p. pp. vol. ch. sec."
).split()
# End of fixed values.


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\n\s*\n", -1), strip)
    return F.filter(parts, lambda p: p != "")


def is_list(paragraph: Column) -> Column:
    """At least one marker line, and markers on half of all lines (rounded down), blank lines counted as lines."""
    lines = F.split(paragraph, "\n", -1)
    markers = F.size(F.filter(lines, lambda x: strip(x).rlike("^" + MARKER)))
    return (markers > 0) & (markers >= F.floor(F.size(lines) / 2))


def sentences(text: Column) -> Column:
    """Cut after punctuation before white space; six abbreviations don't count. Punctuation that no text precedes is dropped."""
    masked = strip(text)
    for short in ABBREVIATIONS_H:
        masked = F.replace(masked, F.lit(short), F.lit(short.replace(".", _MASK)))
    parts = F.split(F.regexp_replace(masked, r"([.!?]+)\s+", "$1" + _CUT), _CUT, -1)
    parts = F.filter(parts, lambda p, i: (i == F.size(parts) - 1) | ~p.rlike(r"^[.!?]+$"))
    return F.filter(F.transform(parts, lambda p: strip(F.replace(p, F.lit(_MASK), F.lit(".")))), lambda p: p != "")


def code_lines(code: Column) -> Column:
    """Lines without trailing blanks; empty ones stay (ingest drops them)."""
    return F.transform(F.split(code, "\n", -1), lambda x: F.regexp_replace(x, r"[ \t]+$", ""))


def list_items(text: Column) -> Column:
    """Items of a list; a line without a marker goes on with the item before it."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: strip(x) != "")
    marked = F.transform(lines, lambda x: F.when(strip(x).rlike("^" + MARKER), F.concat(F.lit(_CUT), x)).otherwise(x))
    parts = F.split(F.array_join(marked, "\n"), _CUT, -1)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def _statements(items: Column, kind: str) -> Column:
    return F.transform(items, lambda x: F.struct(x.alias("content"), F.lit(kind).alias("type")))


def _text_block(p: Column) -> Column:
    listed = is_list(p)
    return F.struct(
        F.when(listed, "list").otherwise("paragraph").alias("type"),
        F.lit("").alias("lang"),
        p.alias("content"),
        F.when(listed, _statements(list_items(p), "list_item")).otherwise(_statements(sentences(p), "sentence")).alias("statements"),
    )


def parse_h(content: Column) -> Column:
    """Blocks in order: fenced code and, between fences, lists and paragraphs. Text without any block is one paragraph."""
    codes = F.regexp_extract_all(content, F.lit(FENCE), F.lit(0))
    texts = F.split(content, FENCE, -1)

    def code_block(fence: Column) -> Column:
        code = F.regexp_extract(fence, FENCE, 2)
        return F.struct(F.lit("code").alias("type"), F.regexp_extract(fence, FENCE, 1).alias("lang"), code.alias("content"), _statements(code_lines(code), "code_line").alias("statements"))

    parts = F.transform(texts, lambda t, i: F.concat(F.transform(paragraphs(t), _text_block), F.when(i < F.size(codes), F.array(code_block(F.get(codes, i)))).otherwise(F.array().cast(BLOCKS))))
    return F.flatten(parts).cast(BLOCKS)


# Profile E.

_OPEN = re.compile(r"```|~~~")
_BREAK = re.compile(r"\n[ \t]*\n\s*")
_END = re.compile(r"(?P<stop>[.!?])(?P<close>(?<=\.)[\"')])?(?=$|[ \n\t])")
_WORD = re.compile(r"[A-Za-z]*$")
_SHORT = {x[:1].lower() + x[1:] for x in ABBREVIATIONS_E}


def blocks_e(content: str, most: int = 64) -> list[tuple[str, str, str]]:
    """(type, lang, content). A fence of backquotes or tildes may open anywhere and closes at a line's start; without an end it runs
    through the last line. The closing line is no part of the code."""
    out: list[tuple[str, str, str]] = []

    def text(part: str) -> None:
        out.extend(("paragraph", "", p) for p in map(str.strip, _BREAK.split(part)) if p)

    at = 0
    while (m := _OPEN.search(content, at)) and len(out) < most:
        text(content[at : m.start()])
        line = content.find("\n", m.end())
        line = len(content) if line < 0 else line
        lang = content[m.end() : line].split()
        close = re.compile(rf"^{re.escape(m[0])}.*$", re.M).search(content, min(line + 1, len(content)))
        code = content[line + 1 : close.start() if close else len(content)]
        out.append(("code", lang[0][:31] if lang else "", code.removesuffix("\n")))
        at = close.end() if close else len(content)
    text(content[at:])
    return out[:most]


def _ends_sentence(text: str, m: re.Match) -> bool:
    after = text[m.end() :].lstrip(" \t")
    if not after or after[0] == "\n":
        return True
    if not (after[0].isascii() and after[0].isupper() or after[0] in "\"'("):
        return False
    if m["stop"] != ".":
        return True
    # The word with its inner dots, so that e.g. and i.e. are found.
    word = re.search(r"(?:[A-Za-z]\.)*[A-Za-z]*$", text[: m.start()])[0] + "."
    return not (word[:1].lower() + word[1:] in _SHORT or len(word) == 2 and word[0].isupper())


def statements_e(kind: str, content: str, most: int = 128) -> list[str]:
    if kind == "code":
        return [x for x in map(str.strip, content.split("\n")) if x][:most]
    out, start, at = [], 0, 0
    while m := _END.search(content, at):
        at = m.end()
        if at >= start and _ends_sentence(content, m):
            out.append(content[start : m.end()].strip())
            start = m.end()
    out.append(content[start:].strip())
    return [x for x in out if x][:most]


def parse_e(content: Column) -> Column:
    @F.pandas_udf(BLOCKS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([[{"type": t, "lang": lang, "content": c, "statements": [{"content": s, "type": "code_line" if t == "code" else "sentence"} for s in statements_e(t, c)]} for t, lang, c in blocks_e(x)] for x in part.fillna("")])

    return run(content)


def exploded(messages: DataFrame, content: str = "content", profile: str = "H") -> DataFrame:
    """messages with block_ix, block_type, lang, block, stmt_ix, stmt_type, statement; one row a statement (none: nulls)."""
    parse = parse_h if profile == "H" else parse_e
    rows = messages.select("*", F.posexplode_outer(parse(F.col(content))).alias("block_ix", "b"))
    rows = rows.select("*", F.col("b.type").alias("block_type"), F.col("b.lang").alias("lang"), F.col("b.content").alias("block"), F.posexplode_outer("b.statements").alias("stmt_ix", "s"))
    return rows.select("*", F.col("s.content").alias("statement"), F.col("s.type").alias("stmt_type")).drop("b", "s")
