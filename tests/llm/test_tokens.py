"""Token counts of each tokenizer file against its library, and the cache."""

import pytest
from pyspark.sql import functions as F

from nearfield.llm import queries, tokens

P = pytest.importorskip("public_tokenizers")
TEXTS = [
    None, "", " ", "some words", "Some  WORDS\n", "SOME words", "a<|endoftext|>b", "a<|ENDOFTEXT|>b", "don't I'M\x1cz\x85y", "é É İstanbul ΣΑΣ", "﻿a᠎b ​c", "12345 'll 's $$$%",
    "\U0001f600̀ a b", "x" * 3000, "tab\tand\x0bmore space　wide", "  lead and trail  ", "\r\nline\r\nline", "日本語 の テキスト", "a\x00b", "'S 's", "end</w> </w>",
]


def library(name):
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        return lambda t: len(model.encode(t))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path(name))
    return lambda t: len(whole.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(name, spark, sf_dir):
    want = library(name)
    odd = spark.createDataFrame(list(enumerate(TEXTS, 1_000_000)), "doc_id long, text string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd)
    found = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, P.path(name)).collect()}
    assert found == {r.doc_id: want(r.text or "") for r in docs.collect()}


def test_only_files_that_part_at_spaces_are_counted_in_pieces():
    assert tokens.counter(P.path("word_bpe_49k.json")).pieces and tokens.counter(P.path("word_bpe_49k.json")).lowers
    assert not tokens.counter(P.path("byte_bpe_50k.json")).pieces


def test_texts_of_one_normal_form_share_a_cache_row(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame(list(enumerate(["some words", "Some  WORDS\n", "a<|endoftext|>b", "a<|ENDOFTEXT|>b"])), "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, P.path("word_bpe_49k.json"), cache).collect()}
    want = library("word_bpe_49k.json")
    assert [found[i] for i in range(4)] == [want(r.text) for r in docs.orderBy("doc_id").collect()]
    assert spark.read.parquet(cache).count() == 3
    tokens.count_tokens(docs, P.path("byte_bpe_50k.json"), cache).collect()  # a cache holds several tokenizers
    assert spark.read.parquet(cache).count() == 7


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_a_filter_that_is_wrong_costs_no_count(bits, spark, sf_dir, tmp_path, monkeypatch):
    """With 64 bits for hundreds of digests nearly all new texts pass as cached, and the join finds them."""
    monkeypatch.setattr(tokens, "FILTER_BITS", bits)
    docs, cache = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), str(tmp_path / "cache")
    path = P.path("word_bpe_49k.json")
    first = docs.where("doc_id % 2 = 0")
    tokens.count_tokens(first, path, cache).collect()
    found = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path, cache).collect()}
    assert found == {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path).collect()}
    assert spark.read.parquet(cache).groupBy("content").count().where("count > 1").isEmpty()


def test_a_warm_cache_answers_all(spark, sf_dir):
    warm = queries.QUERIES["token_cache_warm"](spark, sf_dir)
    assert warm.agg(F.max("appended")).first()[0] == 0
    cold = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.QUERIES["op10_token_counts"](spark, sf_dir).collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in warm.collect()} == cold


def test_empty_tables_and_null_ids(spark):
    path = P.path("word_bpe_49k.json")
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    rows = tokens.count_tokens(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string"), path).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == [(0, 3, 2, False), (0, 3, 2, False), (1, 0, 0, False)]
