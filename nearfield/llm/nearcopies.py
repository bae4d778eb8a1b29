"""Near-duplicate documents: five-word shingles of Jaccard 0.8 and more, with SimHash and BK-trees for candidates.

Texts are told apart by digest, so copies are one. An edit changes fewer short shingles than long ones, so candidates come
from SimHash fingerprints of two-word shingles: those within CANDIDATE_BITS bits, found by BK-trees in shards of
fingerprints that agree in two of eight blocks. Linked candidates form groups, and inside a group texts are compared
by their sets of five-word shingles: a link is a Jaccard similarity of SIMILARITY or more, of whole texts and without
sketches. A group is dealt into parts of bounded size, each pair of parts is a task, and a task compares a text only
with those that are not yet connected to it, so a group of many near copies takes about as many comparisons as it
has texts. Connected texts are one class.

The candidates' recall is that of the fingerprints: of pairs of 0.8 exactly most, of 0.9 nearly all are within reach
(README). No link is false.

Defined results: words are as in the fingerprints (A-Z lowered, parted at space and U+0009 to U+000D); a text of
fewer words than a shingle is one shingle; texts without words, null among them, are one class; a null id is kept only where a
class has no other; rows of one id and text are one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import persist_table

SHINGLE = 5
SIMILARITY = 0.8
CANDIDATE_SHINGLE = 2
CANDIDATE_BITS = 8
#: Texts and shingles in one part of a group; a task holds two parts at most.
PART_TEXTS = 4_000
PART_SHINGLES = 2_000_000


def candidate_masks() -> list[int]:
    """Bits of the shards' keys: two of eight blocks."""
    return [255 << 8 * a | 255 << 8 * b for a, b in combinations(range(8), 2)]


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of a UTF-8 text, ascending."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.int64)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size])) for i in range(max(1, len(words) - size + 1))]
    return np.unique(np.array(hashes, dtype=np.uint64)).view(np.int64)


def connected(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the first of those it is connected to by links of the similarity; sets without elements are alike."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if not n:
        return np.zeros(0, dtype=int)
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    first = np.full(n, -1)
    empty = np.flatnonzero(sizes == 0)
    first[empty] = empty[0] if len(empty) else 0
    mark = np.zeros(len(distinct), dtype=np.int64)
    rest = np.flatnonzero(sizes > 0)
    while len(rest):
        root, rest = rest[0], rest[1:]
        first[root] = root
        frontier = [root]
        # the tokens of the rest, gathered anew when half of it has gone
        own = np.concatenate([flat[starts[i] : starts[i + 1]] for i in rest]) if len(rest) else flat[:0]
        begin = np.concatenate([[0], np.cumsum(sizes[rest])])[:-1]
        alive = np.ones(len(rest), dtype=bool)
        while frontier and alive.any():
            x = frontier.pop()
            mine = flat[starts[x] : starts[x + 1]]
            mark[mine] = 1
            common = np.add.reduceat(mark[own], begin)
            mark[mine] = 0
            near = np.flatnonzero(alive & (common >= similarity * (sizes[x] + sizes[rest] - common) - 1e-9))
            if len(near):
                first[rest[near]] = root
                frontier += rest[near].tolist()
                alive[near] = False
                if alive.sum() * 2 < len(alive):
                    rest, alive = rest[alive], np.ones(int(alive.sum()), dtype=bool)
                    own = np.concatenate([flat[starts[i] : starts[i + 1]] for i in rest]) if len(rest) else flat[:0]
                    begin = np.concatenate([[0], np.cumsum(sizes[rest])])[:-1]
        rest = rest[alive]
    return first


def _with_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """group, text number and shingle hashes of rows (group, number, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([shingles(t.as_py(), shingle) for t in part.column(2)], pa.list_(pa.int64()))], names=["group", "number", "hashes"])

    return rows.select("group", "number", "text").mapInArrow(run, "group long, number long, hashes array<long>")


def _linked(sets: DataFrame, similarity: float) -> DataFrame:
    """Star edges a > b between text numbers of sets (group, number, hashes) whose components are those of all links in groups."""
    sizes = sets.groupBy("group").agg(F.count("*").alias("texts"), F.sum(F.size("hashes").cast("long")).alias("n"))
    parts = sizes.where("texts > 1").select("group", F.greatest(F.ceil(F.col("texts") / PART_TEXTS), F.ceil(F.col("n") / PART_SHINGLES)).cast("int").alias("parts"))
    dealt = sets.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("number"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = dealt.select("group", (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).cast("long").alias("pair"), "number", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, numbers, hashes = None, [], []

        def edges() -> pa.RecordBatch:
            first = connected(hashes, similarity)
            moved = np.flatnonzero(first != np.arange(len(first)))
            n = np.array(numbers, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(n[moved]), pa.array(n[first[moved]])], names=["a", "b"])

        for batch in batches:
            for i, now in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if now != key:
                    if len(numbers) > 1:
                        yield edges()
                    key, numbers, hashes = now, [], []
                numbers.append(batch.column(2)[i].as_py())
                hashes.append(np.array(batch.column(3)[i].values, dtype=np.int64))
        if len(numbers) > 1:
            yield edges()

    found = tasks.repartition("group", "pair").sortWithinPartitions("group", "pair", "number").mapInArrow(run, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows (id, fp, digest) of docs, and (digest, class) of texts that are not alone; a text's class is its digest where it is.

    Classes are told by the first eight bytes of digests.
    """
    rows = persist_table(simhash.with_fingerprints(docs, id_col, text_col, CANDIDATE_SHINGLE, digests=True), "near-fingerprints")
    texts = persist_table(rows.groupBy("digest", "fp").agg(F.min("id").alias("id")), "near-texts")
    fps = texts.select("fp").distinct()
    group = simhash.components(simhash.shard_edges(fps, CANDIDATE_BITS, masks=candidate_masks())).withColumnRenamed("vertex", "fp")
    grouped = texts.join(group, "fp", "left").withColumn("group", F.coalesce("root", "fp")).drop("root")
    several = grouped.groupBy("group").count().where("count > 1").select("group")
    number = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long").alias("number")  # of 60 bits
    chosen = persist_table(grouped.join(several, "group").select("group", "digest", "id", number), "near-candidates")
    # one row of each candidate text; texts of other documents are left out before the shuffle where the filter of the join allows
    found = docs.select(F.col(id_col).alias("id"), simhash.digest(text_col).alias("digest"), F.col(text_col).cast("binary").alias("text"))
    one = found.join(chosen.hint("merge"), found.digest.eqNullSafe(chosen.digest) & found.id.eqNullSafe(chosen.id)).select("group", "number", "text")
    sets = persist_table(_with_sets(one, shingle).dropDuplicates(["group", "number"]), "near-sets")
    member = simhash.components(_linked(sets, similarity))
    by_number = chosen.select("digest", "number").join(member, F.col("number") == F.col("vertex"), "left")
    return rows, persist_table(by_number.select("digest", F.coalesce("root", "number").alias("class")), "near-classes")


def _classed(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """id, fp, digest and class of every row."""
    rows, known = classes(docs, id_col, text_col, shingle, similarity)
    alone = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    return rows.join(known, "digest", "left").withColumn("class", F.coalesce("class", alone))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """id_col, fp (LONG, of two-word shingles) and component_id (the smallest id of the row's class) of every row."""
    rows = persist_table(_classed(docs, id_col, text_col, shingle, similarity), "near-classed")
    lowest = rows.groupBy("class").agg(F.min("id").alias("component_id"))
    return rows.join(lowest, "class").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class: of its smallest id, and of the smallest digest of the text where ids repeat."""
    rows = _classed(docs, id_col, text_col, shingle, similarity).groupBy("class", "id", "digest").agg(F.count("*").alias("rows"))
    # a null id comes after all others
    keep = rows.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "rows")).alias("kept"))
    return simhash.rows_kept(docs, keep.select(F.col("kept.id").alias("__keep_id"), F.col("kept.digest").alias("__keep_digest"), F.col("kept.rows").alias("__rows")), id_col, text_col)
