"""SimHash near-duplicates: exact links within a Hamming radius, found by BK-trees over shards.

Two fingerprints of 64 bits that differ in at most three bits agree in all but three of any number of blocks. A shard
holds the fingerprints that agree in so many blocks (one of four, two of five or three of six, by how many
fingerprints there are, so that shards stay small), and there is a table of shards for each choice of blocks, so every link lies inside some shard and
no tree has to reach all executors. In a shard a BK-tree is built and walked for all its fingerprints at
once: children are keyed by their distance to the parent, and only edges within the radius of a query's
distance are followed. A shard larger than SHARD_ROWS is dealt into parts, and each pair of parts is a
task of its own, so no task holds more than two parts and no link is lost. Shards give star edges;
alternating large-star and small-star rounds turn them into components, each round written to the shared
folder.

Equal fingerprints are one vertex, so copies cost one row however many there are.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a text of fewer
words than a shingle is one shingle; a null id never is a component's smallest id unless all ids of the
component are null; repeated rows give repeated results; an empty table gives no rows; only the id and the
text are read, so other columns' names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist_table

RADIUS = 3
SHINGLE = 3
#: Fingerprints that a shard should hold on average, at most.
SHARD_MEAN = 64
SEED = 42
#: Fingerprints in one part of a shard; a task holds two parts at most.
SHARD_ROWS = 8_192
#: Below so many comparisons a subtree is a leaf, compared directly.
LEAF_PAIRS = 4_096
#: Shingles whose bits are counted at once.
BIT_ROWS = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit integer."""
    # on bytes, lower() changes A-Z only and split() parts at space and U+0009 to U+000D
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, BIT_ROWS):
        stop = min(n, at + BIT_ROWS)
        if shingle == 3 and n > 1:
            run = words[at : stop + 2]
            raw = b"".join([digest(b"%b %b %b" % t, SEED) for t in zip(run, run[1:], run[2:], strict=False)])
        else:
            raw = b"".join([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, stop)])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def digest(text_col: str) -> Column:
    """MD5 of a text, 16 bytes; of an empty one for null."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, digests: bool = False) -> DataFrame:
    """id and fp (LONG) of every row, and digest of its text where asked for."""
    more = [digest(text_col).alias("digest")] if digests else []
    light = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), *more)
    id_type = light.schema["id"].dataType.simpleString()
    names = ["id", "fp", "digest"] if digests else ["id", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], names=names)

    return light.mapInArrow(run, f"id {id_type}, fp long" + (", digest binary" if digests else ""))


def _within(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, radius: int, out: list) -> None:
    close = np.bitwise_count(a[ia][:, None] ^ a[ib][None, :]) <= radius
    x, y = np.nonzero(close)
    out.append((ia[x], ib[y]))


def _search(fp: np.ndarray, tree: np.ndarray, asked: np.ndarray, radius: int, out: list) -> None:
    """Links between the fingerprints of a subtree and those asked, as index pairs that connect the same components."""
    stack = [(tree, asked)]
    while stack:
        tree, asked = stack.pop()
        if not len(tree) or not len(asked):
            continue
        if len(tree) * len(asked) <= LEAF_PAIRS:
            _within(fp, fp, tree, asked, radius, out)
            continue
        root = tree[0]
        far = np.bitwise_count(fp[asked] ^ fp[root]).astype(np.int16)
        near = asked[far <= radius]
        out.append((np.full(len(near), root), near))
        edges = np.bitwise_count(fp[tree[1:]] ^ fp[root]).astype(np.int16)
        for e in np.unique(edges):
            follow = np.abs(far - e) <= radius
            if e <= radius:  # these children and the linked queries are joined through the root already
                follow &= far > radius
            stack.append((tree[1:][edges == e], asked[follow]))
        inner = tree[1:][edges <= radius]
        if len(near) and len(inner):
            out.append((np.full(len(inner), root), inner))


def links(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose connected components are those of all links within the radius."""
    out: list = []
    stack = [np.arange(len(fp))]
    while stack:
        tree = stack.pop()
        if len(tree) < 2:
            continue
        if len(tree) ** 2 <= LEAF_PAIRS:
            _within(fp, fp, tree, tree, radius, out)
            continue
        root, rest = tree[0], tree[1:]
        edges = np.bitwise_count(fp[rest] ^ fp[root]).astype(np.int16)
        near = rest[edges <= radius]
        out.append((np.full(len(near), root), near))
        rings = [(int(e), rest[edges == e]) for e in np.unique(edges)]
        for i, (e, ring) in enumerate(rings):
            if e > radius:
                stack.append(ring)
            for e2, ring2 in rings[i + 1 :]:
                if e2 - e > radius:
                    break
                if e2 > radius:  # rings within the radius are joined through the root
                    _search(fp, ring, ring2, radius, out)
    return out


def local_components(fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint the smallest index of its component."""
    parent = np.arange(len(fp))
    found = links(fp, radius)
    if not found:
        return parent
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    while True:
        low = np.minimum(parent[a], parent[b])
        new = parent.copy()
        np.minimum.at(new, parent[a], low)
        np.minimum.at(new, parent[b], low)
        new = new[new]
        if (new == parent).all():
            return parent
        parent = new


def blocks_for(count: int, radius: int = RADIUS) -> int:
    """Blocks of a fingerprint: the fewest of up to radius + 3 for which shards hold SHARD_MEAN fingerprints on average."""
    blocks = radius + 1
    while blocks < radius + 3 and count / 2.0 ** (64 * (blocks - radius) / blocks) > SHARD_MEAN:
        blocks += 1
    return blocks


def key_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Bits of the keys: each choice of all blocks but radius."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def shard_edges(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, blocks: int | None = None, masks: list[int] | None = None) -> DataFrame:
    """Star edges a > b between the distinct fingerprints fp of fps whose components are those of all links (inside the shards, where masks name their keys' bits)."""
    masks = masks or key_masks(blocks or blocks_for(fps.count(), radius), radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    value = [F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks]
    dealt = fps.select("fp", F.posexplode(F.array(*value)).alias("block", "value"))
    large = dealt.groupBy("block", "value").count().where(F.col("count") > shard_rows).select("block", "value", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))
    large = persist_table(large, "simhash-large-shards")
    if large.isEmpty():
        tasks = dealt.withColumn("pair", F.lit(0))
    else:
        part = F.pmod(F.xxhash64("fp"), F.col("parts"))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        split = dealt.join(large, ["block", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        split = split.withColumn("part", part).withColumn("other", other)
        tasks = split.withColumn("pair", (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).cast("int"))
    tasks = tasks.select("block", "value", "pair", "fp").repartition("block", "value", "pair").sortWithinPartitions("block", "value", "pair", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None

        def grouped(rows: np.ndarray, last: bool):
            cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(rows)]])
            keep = None if last else rows[starts[-1] :]
            if not last:
                starts, ends = starts[:-1], ends[:-1]
            more = ends - starts > 1
            a: list[int] = []
            b: list[int] = []
            for s, e in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
                fp = rows[s:e, 3]
                if e - s == 2:
                    x, y = fp.tolist()
                    if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius and x != y:
                        a.append(y)
                        b.append(x)
                    continue
                root = local_components(fp.view(np.uint64) if fp.flags.c_contiguous else np.ascontiguousarray(fp).view(np.uint64), radius)
                moved = np.flatnonzero(root != np.arange(len(root)))
                a += fp[moved].tolist()
                b += fp[root[moved]].tolist()
            return keep, a, b

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            rest = rows if rest is None else np.concatenate([rest, rows])
            rest, a, b = grouped(rest, False)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if rest is not None and len(rest):
            _, a, b = grouped(rest, True)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = tasks.mapInArrow(run, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """vertex, root (the component's smallest vertex) for each vertex that has edges a > b and is not a root."""
    edges = persist_table(edges.select("a", "b"), "components-edges")
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = persist_table(large, "components-large")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        edges = persist_table(small, "components-small")
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    """rows with root (the smallest fingerprint of the component) and component_id (its smallest id)."""
    fps = persist_table(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    member = components(shard_edges(fps.select("fp"), radius)).withColumnRenamed("vertex", "fp")
    rooted = fps.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(lowest, "root").select("fp", "root", "component_id")
    return rows.join(by_fp, "fp", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id_col, fp (LONG) and component_id (smallest id reachable by links) of every row."""
    rows = persist_table(with_fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    return _grouped(rows, radius).select(F.col("id").alias(id_col), "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each group of near-duplicates: of its smallest id, and of the smallest digest of the text where ids repeat.

    Rows with a null id have no smallest id to compare and are kept only where a whole group has none. Groups
    are told apart by their links, so different texts with one id, or with none, each keep a row.
    """
    rows = persist_table(with_fingerprints(docs, id_col, text_col, shingle, digests=True), "simhash-fingerprints")
    # id and digest tell the text, and so the group; a count of rows for each, then one of them for each group
    first = _grouped(rows, radius).where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", "id", "digest").agg(F.count("*").alias("rows"))
    keep = first.groupBy("root").agg(F.min(F.struct("digest", "id", "rows")).alias("kept"))
    return rows_kept(docs, keep.select(F.col("kept.id").alias("__keep_id"), F.col("kept.digest").alias("__keep_digest"), F.col("kept.rows").alias("__rows")), id_col, text_col)


def rows_kept(docs: DataFrame, keep: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that keep names by __keep_id and __keep_digest, one for each where __rows of them are alike."""
    keep = persist_table(keep, "simhash-keep")
    # as many as documents that stay: they are never broadcast, however few they are here
    kept = docs.withColumn("__digest", digest(text_col)).join(keep.hint("merge"), F.col(id_col).eqNullSafe(F.col("__keep_id")) & (F.col("__digest") == F.col("__keep_digest")))
    if keep.where("__rows > 1").isEmpty():
        return kept.select(*docs.columns)
    once, more = kept.where("__rows = 1"), kept.where("__rows > 1").dropDuplicates(["__keep_id", "__keep_digest"])
    return once.select(*docs.columns).unionByName(more.select(*docs.columns))
