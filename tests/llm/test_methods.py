"""Each operator's method by itself."""

import random

import numpy as np
import pytest

from nearfield.llm import decontaminate, htmltext, matroska, mixing, secrets, sharding, simhash, toxicity, urlfilter


def test_lookup_table_by_turns():
    names = sharding.shard_names(5)
    table = sharding.lookup_table(names, 13)
    order = []
    for n in names:
        start, step = sharding._digest(f"{n}#start") % 13, sharding._digest(f"{n}#step") % 12 + 1
        order.append([(start + j * step) % 13 for j in range(13)])
    want = {}
    while len(want) < 13:
        for i in range(5):
            if len(want) < 13:
                want[next(x for x in order[i] if x not in want)] = i
    assert table == [want[i] for i in range(13)]


def test_lookup_table_is_even_and_steady():
    full = sharding.lookup_table(sharding.shard_names(64))
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(sharding.shard_names(63))
    moved = sum(a != b for a, b in zip(full, fewer, strict=True) if a != 63)
    assert moved < 0.1 * len(full)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 12)


def test_bloom_has_no_false_negatives_and_the_join_no_false_positives(spark):
    rules = [(f"host{i}.example/{'x' * (i % 5)}", "block") for i in range(300)] + [("example/", "allow")]
    pages = [(i, f"http://www.host{i}.example/{'x' * (i % 5)}/page?q") for i in range(600)] + [(600, None), (601, "nohost"), (602, "HTTP://HOST1.EXAMPLE/x#y"), (603, "http://host1.example")]
    found = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string"), urlfilter.rules_table(spark, rules)).collect()}
    for i in range(300):
        assert found[i].rule == rules[i][0] and found[i].verdict == "block"
    assert all(found[i].rule == "example/" and found[i].verdict == "allow" for i in range(300, 600))
    assert [(found[i].host, found[i].path, found[i].rule, found[i].verdict) for i in (600, 601, 603)] == [("", "", None, "allow"), ("", "", None, "allow"), ("host1.example", "", None, "allow")]
    assert found[602].host == "host1.example" and found[602].rule == "host1.example/x"


@pytest.mark.parametrize("shape", ["random", "ball", "chain"])
def test_tree_components(shape):
    rng = np.random.default_rng(3)
    if shape == "random":
        fp = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
        fp = np.concatenate([fp, fp[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))])
    elif shape == "ball":
        fp = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    else:
        fp = np.array([(1 << k) - 1 for k in range(0, 64, 2)] + [1 << 40 | 0b10101], dtype=np.uint64)
    fp = np.unique(fp)
    rng.shuffle(fp)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    want = np.arange(len(fp))
    while True:
        new = np.array([want[row].min() for row in near])
        if (new == want).all():
            break
        want = new
    assert (simhash.local_components(fp) == want).all()


def test_large_shards_are_split_without_loss(spark):
    rng = np.random.default_rng(4)
    fp = np.unique(rng.integers(0, 1 << 16, 400))  # one value in three of the four blocks
    df = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    roots = {}
    for rows in (10_000, 40):
        found = simhash.components(simhash.shard_edges(df, shard_rows=rows)).collect()
        roots[rows] = {r.vertex: r.root for r in found}
    assert roots[10_000] == roots[40]
    index = simhash.local_components(fp.astype(np.uint64))
    assert {int(fp[i]): int(fp[r]) for i, r in enumerate(index) if r != i} == roots[40]


def test_mixing_targets_and_cut(spark):
    rows = [(i, "w " * (1 + i % 7), s) for s, n in (("a", 20), ("b", 500), ("c", 300), (None, 40)) for i in range(n)]
    df = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    found = mixing.allocate(df).collect()
    total = sum(r["size"] for r in found)
    by = {}
    for (_, _, s), r in zip(rows, sorted(found, key=lambda r: r.doc_id), strict=True):
        by.setdefault(s, []).append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    targets = {s: x[0].target for s, x in by.items()}
    assert sum(targets.values()) == pytest.approx(total)
    assert targets["a"] == 3 * by["a"][0].source_size  # weight 5, but few words
    for s, x in by.items():
        assert sum(r.taken for r in x) == int(targets[s])
    assert sorted(map(tuple, mixing.allocate(df.repartition(7)).collect())) == sorted(map(tuple, found))


def test_packets_with_every_lacing(spark):
    payload = bytes(random.Random(1).randrange(256) for _ in range(40_000 // 64 * 64))
    for kind, frame in (("ebml", 1024), ("xiph", 1000), ("ebml", 333)):
        media = matroska.parse(data := matroska.mux(payload, frame, 5, uneven=kind))
        assert media.complete and matroska.payload_of(data, media) == payload and len(media.cues) == len(media.clusters)
        assert [p[1] for p in media.packets] == sorted(p[1] for p in media.packets)
    cut = matroska.parse(data[: len(data) // 2])
    assert not cut.complete and 0 < len(cut.packets) < len(media.packets)
    assert matroska.parse(b"\x00\xff junk").packets == []


def test_unknown_sizes_void_and_block_groups():
    element = matroska._element
    block = matroska._size(1) + b"\x00\x05\x00" + b"frame"
    group = element(matroska.BLOCK_GROUP, element(matroska.BLOCK, block) + element(matroska.REFERENCE_BLOCK, b"\x01"))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska._uint(matroska.TIMESTAMP, 10) + element(0xEC, bytes(9)) + group
    data = matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    media = matroska.parse(data)
    assert [(p[1], p[3], p[4]) for p in media.packets] == [(15_000_000, 5, False)] * 2 and len(media.clusters) == 2


def test_packet_table(spark):
    files = matroska.store(spark.createDataFrame([(1, "hello " * 3000), (2, None)], "doc_id long, text string"))
    rows = matroska.packet_table(files, "doc_id").collect()
    by = {r.doc_id: r.media for r in files.collect()}
    joined = b"".join(bytes(by[1])[r.offset : r.offset + r["size"]] for r in sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.packet))
    assert joined.rstrip(b"\0").decode() == "hello " * 3000 and any(r.cue for r in rows)


def test_novelty_tells_keys_from_names():
    key = "q7Zx9Lk2Vb8Rt4Mw1Yp6"
    assert [s.kind for s in secrets.spans(f"the access_key is {key} here")] == ["novel"]
    assert secrets.spans("the access_key is your_api_key_placeholder_value here") == []
    assert secrets.spans(f"plain {key} without context") == []
    assert [s.kind for s in secrets.spans(f'token = "{key}"')] == ["assign"]
    assert [s.kind for s in secrets.spans("AKIA" + "A1" * 8 + " x")] == ["access"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav>Menu, only. Menu.</nav>", ""),
        ("<body><header><h1>Site</h1></header><div class='content'><h2>T &lt; x</h2><p>Real text, here.<p>More&nbsp;text, indeed.</div><div id=comments><p>User says, hello.</p></div><form>name</form></body>", "T < x Real text, here. More text, indeed."),
        ("<article><h1>A</h1><p>b<b>c</b> <i>d</i></p><script>x('</p>')</script><style>p{}</style><!-- <p>no</p> --><ul><li>e<li>f</ul></article><aside><p>Aside, long text that goes on, and on.</p></aside>", "A bc d e f"),
        ("<body><div class='page has-sidebar'><article><p>Text, of it.</p><div class='notice'>Old.</div></article><div id=comments><article class=comment-body><p>Nice, one.</p></article></div></div></body>", "Text, of it."),
        ("<article><p>a &lt;b&gt; 1 < 2 &amp;&amp; x</p></article>", "a <b> 1 < 2 && x"),
    ],
)
def test_pages(page, text):
    assert htmltext.main_text(page) == text


def test_leaks_with_edits():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(20)]
    index = decontaminate.Index(items)
    noise = lambda n: " ".join(word() for _ in range(n))
    texts, want = [], []
    for k in range(60):
        i = rng.randrange(20)
        s = list(items[i][1].upper())
        for _ in range(len(s) * (k % 5) // 100):
            s[rng.randrange(len(s))] = rng.choice("xyz")
        texts.append(f"{noise(30)} -- {''.join(s)}!! {noise(30)}")
        want.append(i)
    found = decontaminate.search(index, texts + [noise(400) for _ in range(30)] + ["", items[0][1][:60]])
    assert [{x[0] for x in f} for f in found[:60]] == [{i} for i in want]
    assert not any(found[60:])
    exact = decontaminate.search(index, ["Intro. " + items[3][1]])[0]
    assert exact == [(3, 7, 7 + len(items[3][1]), 0)]


def brute(pattern, region):
    """Edits of the pattern against the best part of region."""
    row = [0] * (len(region) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, r in enumerate(region, 1):
            new.append(min(row[j - 1] + (p != r), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_alignment_is_exact_within_the_band():
    rng = np.random.default_rng(6)
    for _ in range(60):
        p = rng.integers(0, 3, 12)
        r = rng.integers(0, 3, 20)
        want = brute(p.tolist(), r.tolist())
        found = decontaminate.align(p, r, -12, 20, 12)
        assert found[0] == want and brute(p.tolist(), r[found[1] : found[2]].tolist()) <= want


def test_subsequence_kernel_is_the_sum_over_subsequences():
    strings = ["^idiot$", "^idxiot$", "^clean$"]
    kernel = toxicity.Kernel(["^idiot$", "^other$"])

    def features(s):
        out = {}
        for p, span in toxicity.SPAN.items():
            from itertools import combinations

            for at in combinations(range(len(s)), p):
                if at[-1] - at[0] < span:
                    out["".join(s[i] for i in at)] = out.get("".join(s[i] for i in at), 0) + toxicity.DECAY ** (at[-1] - at[0] + 1 - p)
        return out

    def k(a, b):
        a, b = features(a), features(b)
        return sum(v * b.get(u, 0) for u, v in a.items())

    assert np.allclose(kernel.values(strings), [[k(s, x) for x in kernel.landmarks] for s in strings], atol=1e-4)
    by_landmark = np.array([0.5, -1.0], dtype=np.float32)
    scorer = toxicity.Scorer(toxicity.Model(kernel.folded(by_landmark), 0.25, np.zeros(0)))
    assert np.allclose(scorer.margins(strings), kernel.values(strings) @ by_landmark + 0.25, atol=1e-4)


def test_disguised_insults():
    rng = random.Random(4)
    words = ["".join(rng.choice(["an", "or", "the", "st", "li", "ve", "mu"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    texts, labels = [], []
    for k in range(400):
        body = [rng.choice(words) for _ in range(30)]
        if k % 4 == 0:
            body[rng.randrange(30)] = rng.choice(["dumbface", "ratbag"])
        texts.append(" ".join(body) + f" {k}")
        labels.append(int(k % 4 == 0))
    scorer = toxicity.Scorer(toxicity.fit(texts, labels))
    harmless = " ".join(words[:20])
    shown = scorer.scores([f"{harmless} {w} {harmless}" for w in ("dumbface", "d.u.m.b.f.a.c.e", "dumb-face", "dumbxface", "r a t b a g", "RATBAG!")])
    assert (shown >= toxicity.THRESHOLD).all() and scorer.scores([harmless])[0] < 0.5


def test_long_tokens_are_scored_whole():
    chain = ".".join("idiot" * 9)
    assert "idiot" * 9 in toxicity.forms(chain)
    scorer = toxicity.Scorer(toxicity.fit([f"you {w} there {k}" for k in range(40) for w in ("idiot", "friend")], [1, 0] * 40))
    plain = "-".join(["walking", "talking", "reading", "singing"] * 4)
    whole, inside, low = scorer.scores([chain, f"{plain}-i.d.i.o.t-{plain}", plain])
    assert min(whole, inside) > low + 0.3 and low < 0.3


def test_training_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, ("idiot " if i % 2 else "friend ") * 100 + str(i)) for i in range(40)] + [(50, None), (None, "idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    seen = []
    fit, toxicity.fit = toxicity.fit, lambda texts, marks: seen.append((texts, marks))
    try:
        toxicity.fit_on(docs, labels, most_bytes=10_000)
        toxicity.fit_on(docs, labels)
    finally:
        toxicity.fit = fit
    assert 0 < sum(len(t) for t in seen[0][0]) <= 10_000 and len(seen[1][0]) == 40


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_links_are_the_same_for_all_layouts(blocks, spark):
    """Keys of one, two or three agreeing blocks find every link of three bits, wherever the bits lie."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 62, 150)
    near = [int(x) ^ int(sum(1 << int(b) for b in rng.choice(63, 3, replace=False))) for x in base]
    fp = np.unique(np.concatenate([base, np.array(near)]))
    found = simhash.components(simhash.shard_edges(spark.createDataFrame([(int(x),) for x in fp], "fp long"), blocks=blocks)).collect()
    index = simhash.local_components(fp.astype(np.uint64))
    assert {r.vertex: r.root for r in found} == {int(fp[i]): int(fp[r]) for i, r in enumerate(index) if r != i}


def test_layout_grows_with_the_count():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**10)] == [4, 4, 5, 6]
    for blocks in (4, 5, 6):
        masks = simhash.key_masks(blocks)
        assert all(any(m & flips == 0 for m in masks) for flips in (0, 7, 1 << 63 | 1 | 1 << 31, 0x8000800080000000, 1 << 20 | 1 << 40 | 1 << 60))


def test_rules_listed_twice_and_with_many_lengths(spark):
    """A rule that is listed both ways blocks; hosts are compared in lower case; any number of path lengths is met."""
    rules = [("a.example/x", "allow"), ("A.example/x", "block"), ("B.Example/y", "block")] + [("long.example/" + "p" * k, "allow" if k % 2 else "block") for k in range(1, 5_000)]
    pages = [(1, "http://a.example/x"), (2, "http://b.example/yy"), (3, "http://long.example/" + "p" * 4_999 + "q"), (4, "http://long.example/" + "p" * 4_242 + "/"), (5, "http://long.example/")]
    found = {r.page_id: (r.rule and len(r.rule), r.verdict) for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string"), urlfilter.rules_table(spark, rules)).collect()}
    assert found == {1: (11, "block"), 2: (11, "block"), 3: (13 + 4_999, "allow"), 4: (13 + 4_242, "block"), 5: (None, "allow")}


def test_placing_keeps_the_columns_of_the_input(spark):
    docs = spark.createDataFrame([(1, "mine", 7)], "doc_id long, shard string, slot int")
    row = sharding.place(docs).first()
    assert (row.shard, row.slot) == ("mine", 7) and 0 <= row.shard_ < sharding.SHARDS and 0 <= row.slot_ < sharding.SLOTS
