"""Decontamination against plain alignment of every window, at every length, and in bounded memory."""

import random
import resource
import time

import numpy as np
import pytest

from nearfield.llm import decontaminate as D

from .test_methods import brute

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(rng):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 9)))


def noise(rng, chars):
    out = ""
    while len(out) < chars:
        out += word(rng) + " "
    return out[:chars].strip()


def edited(rng, text, edits):
    s = list(text)
    for _ in range(edits):
        at = rng.randrange(1, len(s) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice(LETTERS)
        elif kind == 1:
            del s[at]
        else:
            s.insert(at, rng.choice(LETTERS))
    return "".join(s)


def plainly(items, text):
    """Items of which some window is met with its edits, by full alignment; windows without edits as whole words."""
    own = "".join(map(chr, D.normalise(text)[0]))
    out = set()
    for k, item in enumerate(items):
        codes = "".join(map(chr, D.normalise(item)[0]))
        size = min(D.WINDOW, len(codes))
        for start in {*range(0, len(codes) - size + 1, D.STRIDE), len(codes) - size}:
            part, edits = codes[start : start + size], int(D.EDIT_RATE * size)
            if f" {part} " in f" {own} " if not edits else brute(part, own) <= edits:
                out.add(k)
    return out


@pytest.mark.parametrize("length", [1, 2, 5, 6, 7, 8, 16, 17, 23, 24, 33, 34, 49, 50, 51, 52, 67, 99, 100, 101, 160])
def test_every_length_keeps_its_edits(length):
    rng = random.Random(length)
    items = [noise(rng, length * 2)[:length].strip() or "q" for _ in range(4)]
    index = D.Index(list(enumerate(items)))
    budget = int(D.EDIT_RATE * min(length, D.WINDOW))
    texts = []
    for k in range(12):
        item = items[k % 4]
        edits = rng.randint(0, budget + 1) if len(item) > 4 and budget else 0
        texts.append(f"{noise(rng, 40)} {edited(rng, item, edits) if edits else item.upper()}, {noise(rng, 40)}")
    texts += [noise(rng, 90), items[0], f"x{items[0]}x"]
    found = D.search(index, texts)
    assert [{i for i, *_ in f} for f in found] == [plainly(items, t) for t in texts]


def test_passages_of_an_item_from_a_stated_length_on():
    rng = random.Random(3)
    item = noise(rng, 400)
    index = D.Index([(0, item)])
    least = D.WINDOW + D.STRIDE - 1
    for start in range(0, 400 - least - 2, 7):
        assert D.search(index, [f"{noise(rng, 30)} {item[start : start + least + 2]} {noise(rng, 30)}"])[0], start


def test_repeats_take_bounded_memory_and_time():
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    index = D.Index([(0, "a" * 5_000), (1, "ab" * 2_000), (2, "word " * 400)])
    found = D.search(index, ["a" * 50_000, "ab " * 10_000, "word " * 10_000, "b" * 50_000])
    assert [{i for i, *_ in f} for f in found] == [{0}, set(), {2}, set()]
    assert len(found[0]) == 1 and found[0][0][1] == 0 and found[0][0][2] > 49_990  # a band gives its first place
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000 and time.perf_counter() - began < 60


def test_chunks_lose_nothing(monkeypatch):
    rng = random.Random(8)
    items = [noise(rng, 150) for _ in range(6)]
    text = " ".join(x for k in range(40) for x in (noise(rng, 20), edited(rng, items[k % 6], 3)))
    whole = D.search(D.Index(list(enumerate(items))), [text])
    monkeypatch.setattr(D, "CHUNK_PAIRS", 50)
    assert D.search(D.Index(list(enumerate(items))), [text]) == whole and len(whole[0]) >= 36


def test_many_alignments_are_the_plain_ones():
    rng = np.random.default_rng(6)
    patterns, text = rng.integers(0, 3, (50, 12)), rng.integers(0, 3, 40)
    cost, start, end = D.align_many(patterns, text, np.full(50, -12), 53)
    for p, c, s, e in zip(patterns, cost, start, end, strict=True):
        assert c == brute(p.tolist(), text.tolist()) and brute(p.tolist(), text[s:e].tolist()) == c


@pytest.mark.parametrize("block_chars", [4_000_000, 120])
def test_rows_items_and_blocks(spark, block_chars, monkeypatch):
    """Repeated rows and items each give their rows, whatever the blocks; nulls and empty texts none."""
    monkeypatch.setattr(D.blocks_of, "__defaults__", (block_chars,))
    rng = random.Random(9)
    items = [noise(rng, 90) for _ in range(5)]
    bench = spark.createDataFrame([(1, items[0]), (2, items[0]), (3, items[1]), (None, items[2]), (5, None), (6, ""), (7, "?!"), (8, items[3]), (9, items[4])], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {items[0]} it is"), (1, f"so {items[0]} it is"), (None, items[2]), (4, None), (5, ""), (6, noise(rng, 300))], "doc_id long, text string")
    found = D.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0, r.start, r.edits) for r in found) == [(0, 0, 0, 0), (1, 1, 3, 0), (1, 1, 3, 0), (1, 2, 3, 0), (1, 2, 3, 0)]
    assert sorted(r.doc_id for r in D.clean_documents(docs, bench).collect()) == [4, 5, 6]
    assert max(sum(len(t) for _, t in b) for b in D.blocks_of(D.texts_of(bench, "item_id", "text"))) <= max(block_chars, 90)
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(docs, none).count() == 0 and D.clean_documents(docs, none).count() == 6
