"""Tokenizers and text scalars, as column expressions that stay inside the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists that results depend on.
INDEX_STOP_WORDS = (
    "the is at which on a an and or but in with to for of this that it as be by "
    "are was were been being have has had do does did will would could should may might must can if then else "
    "var let const return func"
).split()
KEYWORD_STOP_WORDS_H = (
    "the a an is are was were be been being have has had do does did will would could "
    "should may might must shall can need dare ought used to of in for on with at by "
    "from as into through during before after above below between under again further then once "
    "here there when where why how all each few more most other some such no nor not only "
    "own same so than too very just and but if or because until while this that these those it its "
    "func function def class struct interface type var let const static public private protected "
    "return else elif switch case default break continue try catch except "
    "finally throw throws import export package module require include using namespace new delete "
    "nil null none true false void int string bool float double char byte long short "
    "async await yield lambda self super"
).split()
KEYWORD_STOP_WORDS_E = (
    "a an the and or but in on at to for of with by from is are was were be been "
    "being have has had do does did will would could should may might must shall can need "
    "this that these those it its i me my we us our you your he him his she her "
    "they them their what which who whom when where why how all each every both few more "
    "most other some such no not only same so than too very just also now here there then "
    "if else as until while during before after"
).split()
IDENTIFIER_SKIP_WORDS_E = (
    "if else for while switch case return break continue goto sizeof typedef struct "
    "union enum static const volatile extern inline void int char float double long "
    "short unsigned signed bool true false NULL nullptr class public private protected "
    "virtual override final new delete this func var let def fn pub mut impl"
).split()
ABBREVIATIONS_H = ("Mr.", "Mrs.", "Dr.", "etc.", "e.g.", "i.e.")
# End of fixed values.

BLANK = r"^\s+|\s+$"
MARKER = r"(?:[-*+] |\d+\.\s)"


def words(*items: str) -> Column:
    return F.array(*map(F.lit, items))


def strip(c: Column) -> Column:
    """Without white space at both ends, newlines and tabs included."""
    return F.regexp_replace(c, BLANK, "")


def is_blank(c: Column) -> Column:
    return c.rlike(r"^[ \t\n\r]*$")


def index_tokens_h(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of two bytes or more that are no stop words."""
    stop = words(*INDEX_STOP_WORDS)
    return F.filter(raw_index_tokens_h(c), lambda t: (F.octet_length(t) >= 2) & ~F.array_contains(stop, t))


def raw_index_tokens_h(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0))


def is_index_token_h(token: Column) -> Column:
    """The same choice on exploded tokens, where a set lookup inside generated code makes it."""
    return (F.octet_length(token) >= 2) & ~token.isin(INDEX_STOP_WORDS)


def index_tokens_e(c: Column, most: int | None = None) -> Column:
    """Lower-cased ASCII letters and digits, two or more, no stop list."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))
    tokens = F.filter(tokens, lambda t: (F.octet_length(t) >= 2) & (F.octet_length(t) <= 255))
    return F.slice(tokens, 1, most) if most else tokens


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def call_tokens_e(c: Column) -> Column:
    """White-space tokens under 64 bytes, punctuation kept, the first 64."""
    tokens = F.split(ascii_lower(c), r"[ \t\n\r]+")
    return F.slice(F.filter(tokens, lambda t: F.octet_length(t).between(1, 63)), 1, 64)


def keyword_words_h(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def word_tokens_e(c: Column, below: int = 64) -> Column:
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+"), F.lit(0))
    return F.filter(tokens, lambda t: F.octet_length(t) < below)


def contains_ascii(c: Column, part: Column | str) -> Column:
    """Substring test that ignores ASCII case only."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.contains(ascii_lower(c), ascii_lower(part))


def preview(c: Column, most: int) -> Column:
    """One line, single spaces, cut to `most` characters with an ellipsis."""
    line = F.trim(F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), " +", " "))
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 3)), F.lit("..."))).otherwise(line)


def cut(c: Column, most: int) -> Column:
    """The first characters; counts characters where byte counts could split one."""
    return F.left(c, F.lit(most))


def token_estimate(c: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(c) + 3) / 4).cast("int")


def level_name(c: Column) -> Column:
    from ..profile import LEVEL_NAMES

    out = F.lit("unknown")
    for i, name in enumerate(LEVEL_NAMES):
        out = F.when(c == i, name).otherwise(out)
    return out


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_ns(c: Column) -> Column:
    return F.timestamp_micros((c.cast("decimal(20,0)") / 1000).cast("long"))


def to_ns(c: Column) -> Column:
    return F.unix_micros(c) * 1000


# Hashes. Arithmetic modulo 2**32 in BIGINT.


def _bytes(c: Column) -> Column:
    """Byte values of a string: pairs of hex digits, cut in one pass."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))


def times_hash(c: Column, factor: int, start: int) -> Column:
    """hash * factor + byte, from `start`: 33 and 5381 give djb2, 31 and 0 the stub embedder's seed."""
    return F.aggregate(_bytes(c), F.lit(start).cast("long"), lambda h, b: (h * factor + b).bitwiseAND(F.lit(0xFFFFFFFF)))


def djb2(c: Column) -> Column:
    return times_hash(c, 33, 5381)


def crc32(c: Column) -> Column:
    return F.crc32(c)
