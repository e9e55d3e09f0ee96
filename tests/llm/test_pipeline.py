from __future__ import annotations

import os
import zlib
from collections import defaultdict

import corpus_pipeline as pipeline
import pytest
from loomtree.llm import mixing, near_dedup, suffix_dedup
from loomtree.llm.queries import QUERIES
from public_tokenizers import path
from pyspark.sql import functions as F
from test_operators import WORD, covered_words, prose, removed, table
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "mix_sources", "best_fit_packing"]


def test_each_stage_works_on_what_is_left(spark):
    clean = [(i, f"{prose(70 + i % 40, i)}.", "en", f"s{i % 3}") for i in range(50)]
    passage = prose(100, 77)
    shared = [(100 + i, f"{prose(80, 600 + i)} {passage} {prose(60, 700 + i)}", "en", "s0") for i in range(3)]
    rows = clean + shared + [(200, clean[0][1], "en", "s1"), (201, "short", "en", "s1"), (202, None, None, None)]
    docs = table(spark, rows).select(*pipeline.COLUMNS)
    kept = {r.doc_id for r in pipeline.quality(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {201, 202}
    first = pipeline.near_copies(spark, pipeline.quality(spark, docs, ""), "").cache()
    assert {r.doc_id for r in first.collect()} == kept - {200} and first.columns == list(pipeline.COLUMNS)
    second = pipeline.repeats(spark, first, "").cache()
    texts = {r.doc_id: r.text for r in second.collect()}
    left = {i: (w, n) for i, w, n in covered_words([(r.doc_id, r.text) for r in first.collect()], pipeline.REPEATED)}
    assert {i: WORD.findall(t) for i, t in texts.items()} == {i: w for i, (w, _) in left.items()} and left[100][1] == 100 and left[0][1] == 0
    third = pipeline.mix(spark, second, "").cache()
    assert third.columns == list(pipeline.COLUMNS)
    copies = {r.doc_id: r.n for r in third.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    want = {r.doc_id: r.copies for r in mixing.mix_sources(second).collect() if r.copies}
    assert copies == want
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokens = sum(len(tok.encode(texts[i], add_special_tokens=False).ids) + 1 for i, n in copies.items() for _ in range(n))
    assert sum(r.length for r in pipeline.pack(spark, third, "").collect()) == tokens


def test_passages_of_51_words_are_cut(spark):
    passage = " ".join(f"{'abcde'[k % 5]}{k:04}" for k in range(51))
    assert len(passage) < 400
    docs = table(spark, [(i, f"{prose(60, 900 + i)} {passage} {prose(60, 950 + i)}") for i in range(2)]).select(*pipeline.COLUMNS)
    assert not any(passage[20:-20] in r.text for r in pipeline.repeats(spark, docs, "").collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_runs(spark):
    out = pipeline.run(spark, SF)
    places = defaultdict(list)
    for r in out.collect():
        places[r.sequence_id].append((r.offset, r.length))
    assert places and all(sum(n for _, n in p) <= 1024 for p in places.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op8_sharding", "op9_suffix_dedup", "op10_near_dedup", "op7_quality_rules"])
def test_queries(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES[name](spark, SF)
    assert got.count() == docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    if name == "op9_suffix_dedup":
        words = {i: n for i, _, n in covered_words(rows, 50)}
        assert sorted(map(tuple, got.collect())) == sorted((*r, words[r[0]]) for r in removed(rows, 400))
    if name == "op8_sharding":
        crc = {i: zlib.crc32((t or "").encode()) for i, t in rows}
        assert all(r.text_crc32 == crc[r.doc_id] for r in got.collect())
    assert near_dedup and suffix_dedup
