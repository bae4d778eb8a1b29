"""Registered queries against their SQL, and against brute force where SQL can't say it."""

import hashlib
import re
import zlib

import pytest

from nearfield.llm import nearcopies, queries, sharding, tokens

from ..conftest import rows_of
from .test_nearcopies import roots

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(name, spark, duck, sf_dir):
    assert rows_of(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.sql(queries.ORACLES[name]).df())


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()


def test_fingerprints_and_components(spark, sf_dir, docs):
    import xxhash

    found = {r.doc_id: r for r in queries.QUERIES["op9_simhash"](spark, sf_dir).collect()}
    prints = {}
    for i, text in docs:
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: r.fingerprint for i, r in found.items()}
    component = dict.fromkeys(prints)
    for i in sorted(prints):
        if component[i] is None:
            stack = [i]
            while stack:
                x = stack.pop()
                if component[x] is None:
                    component[x] = i
                    stack += [y for y in prints if component[y] is None and (prints[x] ^ prints[y]).bit_count() <= 3]
    assert component == {i: r.component_id for i, r in found.items()}


def test_token_counts(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in docs}
    found = {r.doc_id: r for r in queries.QUERIES["op10_token_counts"](spark, sf_dir).collect()}
    assert want == {i: r.n_tokens for i, r in found.items()}
    assert all(r.over_limit == (r.n_tokens > 2048) for r in found.values())


def test_digest_cache_encodes_only_misses(spark, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "some words"), (2, "some words"), (3, "others")], "doc_id long, text string")
    tokens.count_tokens(first, path, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    found = tokens.count_tokens(first.unionByName(spark.createDataFrame([(4, "new")], first.schema)), path, cache).collect()
    assert len(found) == 4 and spark.read.parquet(cache).count() == 3


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "don't I'M\x1cz\x85y", "é É İstanbul ΣΑΣ", "﻿a᠎b ​ c", "12345 'll 's $$$%", "\U0001f600̀ a b", "x" * 5000])
def test_counts_by_piece_are_the_librarys(text):
    c = tokens.Counter(public_tokenizers.path("word_bpe_49k.json"))
    assert c.count(text) == c.whole(text)


def test_base_spans(spark, sf_dir, docs):
    found = {r.doc_id: r for r in queries.QUERIES["op4_secret_scan"](spark, sf_dir).collect()}
    for i, text in docs:
        text = text or ""
        spans = [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0]))))
        assert found[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert found[i].n_hex == sum(s[0] == "hex" for s in spans)


def test_media_values(spark, sf_dir, docs):
    found = {r.doc_id: r for r in queries.QUERIES["op7_matroska"](spark, sf_dir).collect()}
    for i, text in docs:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])


def test_extracted_articles(spark, sf_dir, duck):
    import html

    found = {r.page_id: r for r in queries.QUERIES["op5_html_extraction"](spark, sf_dir).collect()}
    for i, page in duck.sql("SELECT page_id, html FROM pages").fetchall():
        inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"<(h1|/h1|p|/p|br)>", " ", inner))
        assert found[i].text == " ".join(html.unescape(plain).split())
        assert found[i].n_chars == len(found[i].text)


def test_leaks_are_the_contained_items(spark, sf_dir, docs, duck):
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [(i, norm(t)) for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()]
    want = {(d, i) for d, t in docs for i, x in items if len(x) >= 24 and x in norm(t)}
    found = queries.QUERIES["op8_decontamination"](spark, sf_dir).collect()
    assert want <= {(r.doc_id, r.item_id) for r in found}
    assert {d for d, _ in want} == {r.doc_id for r in found}


def test_held_out_toxicity(spark, duck, tmp_path):
    """Accuracy on the labels that are held out, on a larger table."""
    import os

    where = "/root/testdata/sf0.1"
    if not os.path.isdir(where):
        pytest.skip("no larger table here")
    found = {r.doc_id: r for r in queries.QUERIES["op3_toxicity"](spark, where).collect()}
    labels = duck.sql(f"SELECT doc_id, toxic FROM '{where}/labels.parquet'").fetchall()
    held = [(found[i], t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1 and i in found]
    assert held and all(r.held_out for r, _ in held)
    caught = sum(r.predicted for r, t in held if t) / sum(t for _, t in held)
    wrong = sum(r.predicted for r, t in held if not t) / sum(not t for _, t in held)
    assert caught >= 0.9 and wrong < 0.01


def test_pipeline_on_brute_force(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = corpus_pipeline.reject_toxic(spark, docs, sf_dir)
    single = corpus_pipeline.one_of_near_duplicates(spark, clean, sf_dir)
    # the stage's rule is five-word shingles of Jaccard 0.8 and more: the smallest id of each class by all pairs
    texts = sorted((r.doc_id, r.text) for r in clean.collect())
    first = roots([nearcopies.shingles(t.encode() if t else None) for _, t in texts])
    assert {r.doc_id for r in single.select("doc_id").collect()} == {texts[k][0] for k in first}
    rest = corpus_pipeline.without_benchmark(spark, single, sf_dir)
    leaked = {r.doc_id for r in queries.decontaminate.find_leaks(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in rest.select("doc_id").collect()} == {r.doc_id for r in single.select("doc_id").collect()} - leaked
    taken = {r.doc_id: r for r in queries.mixing.allocate(rest).collect()}
    mixed = corpus_pipeline.mixed(spark, rest, sf_dir)
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for i, r in taken.items():  # whole texts: at most the one at the cut differs from the exact words
        assert abs(copies.get(i, 0) * r["size"] - r.taken) < max(1, r["size"]) or r["size"] == 0
    out = corpus_pipeline.run(spark, sf_dir)
    owner = sharding.lookup_table(sharding.shard_names())
    for r in out.collect():
        assert r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS and r.shard == owner[r.slot]
    assert out.count() == mixed.count()


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    """Null ids and texts, ties, repeated rows and columns with names of the stages' own; then no rows at all."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot int, score double, class string"
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "some words of a text without an id"), (None, "some words of a text without an id"), (4, "a text of its own, with few words"), (5, "what an idiot"), (6, " \t\n")]
    rows = [(i, t, "en", s, 0, 7, 0.5, "c") for (i, t), s in zip(rows, [None, "a", "a", "a", "b", "b", None, "b", "a"], strict=True)]
    for name, some in (("odd", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{d}/documents.parquet")
        marks = [(k, k % 2) for k in range(3, 7)] if some else []
        spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")] if some else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        out = corpus_pipeline.run(spark, d)
        assert out.columns == [*docs.columns, "slot_", "shard"] and out.where("slot <> 7").isEmpty()
        if not some:
            assert out.count() == 0
            continue
        kept = {(r.doc_id, (r.text or "").strip()[:20]) for r in out.collect()}
        for stage in (corpus_pipeline.reject_toxic, corpus_pipeline.one_of_near_duplicates, corpus_pipeline.without_benchmark, corpus_pipeline.mixed):
            assert stage(spark, docs, d).columns == docs.columns
        assert kept <= {(1, ""), (3, long[:20]), (None, "some words of a text"), (4, "a text of its own, w"), (5, "what an idiot")} and (1, "") in kept
