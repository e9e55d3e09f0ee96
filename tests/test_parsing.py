from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomtree.operators import parsing
from pyspark.sql import functions as F


def parse(spark, text, profile="H"):
    rows = parsing.exploded(spark.createDataFrame([(text,)], "content string"), profile=profile).orderBy("block_ix", "stmt_ix").collect()
    return [(r.block_type, r.lang, r.statement) for r in rows]


def test_code_between_text(spark):
    text = "Intro text. More here.\n\n```python\nx = 1\n\ny = 2  \n```\nAfter. The end"
    assert parse(spark, text) == [
        ("paragraph", "", "Intro text."), ("paragraph", "", "More here."),
        ("code", "python", "x = 1"), ("code", "python", ""), ("code", "python", "y = 2"), ("code", "python", ""),
        ("paragraph", "", "After."), ("paragraph", "", "The end"),
    ]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Dr. Smith came. He left! Really?", ["Dr. Smith came.", "He left!", "Really?"]),
        ("See e.g. this and i.e. that. Done", ["See e.g. this and i.e. that.", "Done"]),
        ("One. ! Two", ["One.", "Two"]),
        ("... Two", ["Two"]),
        ("Wait... what?! Yes", ["Wait...", "what?!", "Yes"]),
        ("   ", []),
        ("3.14 is pi", ["3.14 is pi"]),
    ],
)
def test_sentences(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(parsing.sentences(F.col("t"))).first()
    assert row[0] == expected


def test_list_items_go_on(spark):
    assert parse(spark, "- one\n- two\n  more\n3. three") == [("list", "", "- one"), ("list", "", "- two\n  more"), ("list", "", "3. three")]


def test_blank_has_no_blocks(spark):
    assert parse(spark, "  \n ") == [(None, None, None)]


def test_profile_e_fences(spark):
    assert parsing.blocks_e("a\n\n~~~sh\nls\n~~~\nb") == [("paragraph", "", "a"), ("code", "sh", "ls"), ("paragraph", "", "b")]
    assert parsing.blocks_e("x ```go\nf()\ng()") == [("paragraph", "", "x"), ("code", "go", "f()\ng()")]
    assert len(parsing.blocks_e("\n\n".join("abc"[i % 3] for i in range(100)))) == 64
    assert [r[2] for r in parse(spark, "Hi there. You", "E")] == ["Hi there.", "You"]


def test_profile_e_sentences():
    say = lambda t: parsing.statements_e("paragraph", t)
    assert say("Dr. Smith left. He ran") == ["Dr. Smith left.", "He ran"]
    assert say("It is 3. that small. Next") == ["It is 3. that small.", "Next"]
    assert say('He said "go." Then left') == ['He said "go."', "Then left"]
    assert say("J. Doe wrote e.g. This. End") == ["J. Doe wrote e.g. This.", "End"]
    assert say("no end") == ["no end"]
    assert parsing.statements_e("code", "a\n\n  b \n") == ["a", "b"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab.!? \n`-~*1", max_size=60))
def test_profile_e_keeps_letters(text):
    """Whatever the text, letters outside fence lines come out in order."""
    found = "".join(c for _, _, b in parsing.blocks_e(text) for c in b if c in "ab")
    if "`" not in text and "~" not in text:
        assert found == "".join(c for c in text if c in "ab")
        again = "".join(c for _, _, b in parsing.blocks_e(text) for s in parsing.statements_e("paragraph", b) for c in s if c in "ab")
        assert again == found
