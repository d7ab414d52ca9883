"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeload.llm import bpe, chat, decontaminate, fingerprint, pii, quality, secrets, simhash, toxicity, urlfilter
from lakeload.llm.queries import RULES, VOCABULARY

from .conftest import ODD

KEY = b"k" * 16


@pytest.fixture
def labels(spark):
    rows = [(1, 1, 0), (4, 1, 0), (4, 0, 1), (6, 1, 1), (None, 1, 1), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture
def benchmark(spark):
    rows = [(1, "one two three four"), (1, "one two three four"), (2, None), (None, ""), (3, "7 8 9")]
    return spark.createDataFrame(rows, "item_id long, text string")


def operators(spark, labels, benchmark):
    vocabulary = bpe.load_vocabulary(VOCABULARY)
    return {
        "pii": lambda d: pii.pseudonymize(d, KEY),
        "fingerprint": fingerprint.compare_with_edits,
        "quality": lambda d: quality.judge(d, labels),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "secrets": secrets.scan,
        "bpe": lambda d: bpe.encode(d, vocabulary, bpe.build_lexicon(d, vocabulary)),
        "simhash": simhash.simhash_classes,
    }


@pytest.mark.parametrize("name", ["pii", "fingerprint", "quality", "toxicity", "secrets", "bpe", "simhash"])
def test_each_row_gets_a_result(spark, frame, labels, benchmark, name):
    run = operators(spark, labels, benchmark)[name]
    docs = frame(ODD)
    ids = [r.doc_id for r in run(docs).collect()]
    assert sorted(ids, key=str) == sorted((i for i, _ in ODD), key=str)
    assert run(docs.limit(0)).collect() == []


def test_decontamination(spark, frame, benchmark):
    found = decontaminate.find_items(frame(ODD), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(None, 1), (4, 1), (5, 1)}
    assert decontaminate.find_items(frame(ODD), benchmark.limit(0)).collect() == []
    assert decontaminate.find_items(frame([]), benchmark).collect() == []


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, frame, labels, benchmark, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, run = corpus_pipeline.STAGES[stage]
    for rows in (ODD, []):
        frame(rows).write.parquet(str(tmp_path / f"in{len(rows)}"))
        docs = spark.read.parquet(str(tmp_path / f"in{len(rows)}"))
        out = run(spark, docs, str(tmp_path))
        kept = out.collect()
        if name != "tokens":
            assert out.columns == docs.columns
            assert out.dtypes == docs.dtypes
        if name == "near_duplicates" and rows:
            texts = [r.text or "" for r in kept]
            assert sorted(t.split()[:1] for t in texts) == [[], ["A"], ["one"], ["é"]]
            assert {r.doc_id for r in kept if r.text and r.text.startswith("one")} == {4}
        elif name == "decontamination" and rows:
            assert sorted((r.doc_id for r in kept), key=str) == [1, 2, 3, 6, 7, None]
        elif name in ("pii", "tokens"):
            assert len(kept) == len(rows)


def test_urls(spark):
    urls = [None, "", "x", "://", "http://", "HTTP://A.COM", "http://a.com/", "http://..com/", "a://b.net/es/?x", "a://b.net/es/?x"]
    pages = spark.createDataFrame([(None, u, "h") for u in urls], "page_id long, url string, key string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("net", None, "block")], urlfilter.RULE_SCHEMA)
    out = urlfilter.judge(pages, rules)
    assert out.count() == len(urls)
    assert out.where("host = 'b.net' and rule = 'net/es/' and verdict = 'block'").count() == 2
    assert out.where("host = '' and path = '' and rule is null and verdict = 'allow'").count() == 5
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert urlfilter.judge(pages, rules.limit(0)).where("rule is null").count() == len(urls)


def test_chat(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None),
        (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "", ""), (None, None, None, None), (4, 0, "user", "<|im_end|>"),
    ]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit("x"))
    out = {r.conv_id: (r.n_turns, r.chat) for r in chat.collapse_and_render(talks).collect()}
    assert out == {
        1: (2, "<|im_start|>user\na<|im_end|>\n<|im_start|>\n<|im_end|>\n"),
        None: (1, "<|im_start|>\n<|im_end|>\n"),
        4: (1, "<|im_start|>user\n<| im_end|><|im_end|>\n"),
    }
    assert chat.collapse_and_render(talks.limit(0)).collect() == []
