"""Benchmark decontamination by the q-gram lemma over diagonal bands, verified by banded alignment.

Texts and benchmark items are normalised: lower-cased, with every run of other characters than letters
and digits as one space. Each item is cut into overlapping windows of up to WINDOW characters; an item that is
shorter is one window, and windows that are equal are looked for once. A window of m characters may be met with
k = EDIT_RATE * m edits (rounded down). It then shares at least m - q + 1 - k * q of its q-grams with the text, and their diagonals
(position in the text less position in the window) differ by at most k. So shared q-grams are counted in bands of 2(k + 1)
diagonals that start every k + 1 diagonals, some of which holds every such run of diagonals whole; bands that
reach the bound are aligned to the window within the band, and those with at most k edits are leaks. Windows of an item
that meet become one span.

q is 12 for windows of 52 characters and more, 8 for shorter ones and 3 for the shortest, so that the bound is always
positive and no window loses an edit. Windows too short for any edit are met as whole words. A passage of an item
is sure to be met if it holds a window whole, so from WINDOW + STRIDE - 1 characters on.

The q-grams of a batch of texts are hashed with array operations, so a text costs a few passes over its
characters, and only texts with enough shared q-grams are looked at closer, CHUNK_PAIRS pairs of places at a time, so
memory is bounded however often a text and an item repeat themselves. Different item texts go to the executors in
blocks of at most BLOCK_CHARS characters (a longer item is a block of its own); a benchmark of one block takes one pass over the documents.

Defined results: null and empty texts, and items without letters and digits, have no leaks; repeated rows and repeated items
each give their own rows; an item with several separate spans in a text gives a row each; empty tables give no
rows; of docs only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_table

WINDOW = 100
STRIDE = 50
#: Edits allowed for each character of a window.
EDIT_RATE = 0.06
#: Lengths of q-grams, and the shortest windows (with the spaces around whole words) that each is for.
TIERS = ((12, 52), (8, 8), (3, 0))
#: Characters of benchmark text in one block, and of documents hashed at once.
BLOCK_CHARS = 4_000_000
CHUNK_CHARS = 500_000
#: Pairs of a text's and windows' places held at once, and bands aligned at once.
CHUNK_PAIRS = 1_000_000
ALIGNED = 2_000
TABLE_BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.uint32(32)


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """For each code point of the basic plane its lower case, or a space where it is no letter or digit."""
    out = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if not c.isalnum():
            out[i] = 32
        elif len(low := c.lower()) == 1:
            out[i] = ord(low)
    return out


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points, and the position in the text of each."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _folding()
    folded = np.where(raw < 0x10000, table[np.minimum(raw, 0xFFFF)], raw) if len(raw) and raw.max() >= 0x10000 else table[raw]
    space = folded == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    if len(keep) and space[0]:
        keep[0] = False
    at = np.flatnonzero(keep)
    if len(at) and folded[at[-1]] == 32:
        at = at[:-1]
    return folded[at], at


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of q code points."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        single = codes.astype(np.uint64) * SPREAD
        if q % 4:
            h = single[:n].copy()
            for i in range(1, q):
                h = h * BASE + single[i : i + n]
            return h
        two = single[:-1] * BASE + single[1:]
        square = BASE * BASE
        fours = two[:-2] * square + two[2:]
        h = fours[:n]
        for i in range(4, q, 4):
            h = h * (square * square) + fours[i : i + n]
        return h


class Tier:
    """The q-grams of windows of similar length: for each gram the windows and places that hold it."""

    def __init__(self, q: int, patterns: list[np.ndarray], edits: list[int]):
        self.q, self.patterns = q, patterns
        self.size = np.array([len(p) for p in patterns], dtype=np.int64)
        self.edits = np.array(edits, dtype=np.int64)
        self.need = self.size - q + 1 - self.edits * q
        self.least = int(self.need.min())
        self.reach = int((self.size + 2 * self.edits).max())
        hashes = [gram_hashes(p, q) for p in patterns]
        h = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(patterns), dtype=np.int32), [len(x) for x in hashes])
        place = np.concatenate([np.arange(len(x), dtype=np.int16) for x in hashes])
        order = np.argsort(h, kind="stable")
        self.hashes, self.starts = np.unique(h[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(h))
        self.owner, self.place = owner[order], place[order]
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        with np.errstate(over="ignore"):
            self.table[(self.hashes * SPREAD) >> np.uint64(64 - TABLE_BITS)] = True

    def occurrences(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of hashes that are grams of windows, and each one's row in self.hashes."""
        with np.errstate(over="ignore"):
            maybe = np.flatnonzero(self.table[(hashes * SPREAD) >> np.uint64(64 - TABLE_BITS)])
        if not len(maybe):
            return maybe, maybe
        row = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        same = self.hashes[row] == hashes[maybe]
        return maybe[same], row[same]

    def hits(self, codes: np.ndarray, at: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(window, start, end, edits) in one text, from its shared q-grams."""
        if len(at) < self.least:
            return
        n = (self.ends - self.starts)[rows]
        upto = np.cumsum(n)
        lo = 0
        while lo < len(at):
            # as many places as CHUNK_PAIRS allows, and at least twice the reach of a window; the next chunk begins a reach earlier
            hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK_PAIRS, side="right"))
            hi = max(hi, int(np.searchsorted(at, at[lo] + 2 * self.reach, side="right")), lo + 1)
            yield from self._chunk(codes, at[lo:hi], rows[lo:hi], n[lo:hi])
            if hi >= len(at):
                return
            lo = max(lo + 1, int(np.searchsorted(at, at[hi - 1] - self.reach)))

    def _chunk(self, codes: np.ndarray, at: np.ndarray, rows: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        total = int(n.sum())
        posting = np.repeat(self.starts[rows], n) + (np.arange(total) - np.repeat(np.cumsum(n) - n, n))
        window = self.owner[posting].astype(np.int64)
        often = np.bincount(window, minlength=len(self.patterns)) >= self.need
        kept = often[window]
        if not kept.any():
            return
        window, diagonal = window[kept], (np.repeat(at, n) - self.place[posting])[kept]
        band = diagonal // (self.edits[window] + 1)
        both = np.stack([np.concatenate([window, window]), np.concatenate([band, band - 1])])
        low = int(both[1].min())
        keys, counts = np.unique(both[0] * (int(both[1].max()) - low + 1) + (both[1] - low), return_counts=True)
        windows, bands = np.divmod(keys, int(both[1].max()) - low + 1)
        good = counts >= self.need[windows]
        windows, bands = windows[good], bands[good] + low
        for size in np.unique(self.size[windows]):
            of_size = np.flatnonzero(self.size[windows] == size)
            for k in range(0, len(of_size), ALIGNED):
                some = of_size[k : k + ALIGNED]
                w, edits = windows[some], int(self.edits[windows[some[0]]])
                first = bands[some] * (edits + 1) - edits
                cost, start, end = align_many(np.stack([self.patterns[i] for i in w]), codes, first, 4 * edits + 2)
                for j in np.flatnonzero(cost <= edits).tolist():
                    yield int(w[j]), int(start[j]), int(end[j]), int(cost[j])


def align_many(patterns: np.ndarray, codes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of patterns the fewest edits of the whole pattern against a part of codes, on the diagonals first to first + width - 1; its start and end.

    Of parts with equally few edits the one that ends first, and then starts last.
    """
    count, m = patterns.shape
    far = np.int64(1) << 60
    unit = np.int64(1) << 40  # an edit; below it the start counts, later ones for less
    columns = np.arange(width)
    at = first[:, None] + columns[None, :]  # text position before which the pattern's prefix of length 0 ends
    row = np.where((at >= 0) & (at <= len(codes)), unit - at, far)
    padded = np.append(codes.astype(np.int64), -1)
    for i in range(1, m + 1):
        here = at + i
        inside = (here >= 1) & (here <= len(codes))
        letter = padded[np.where(inside, here - 1, len(codes))]
        new = np.where(inside, row + unit * (letter != patterns[:, i - 1 : i]), far)  # along the diagonal
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + unit)  # a character of the pattern left out
        new = np.minimum.accumulate(new - columns * unit, axis=1) + columns * unit  # characters of the text left out
        row = np.where((here >= 0) & (here <= len(codes)), np.minimum(new, far), far)
    cost = np.where(row >= far // 2, m + width, (row - 1) // unit)  # more edits than any alignment where there is none
    rows, best = np.arange(count), cost.argmin(axis=1)
    cost = cost[rows, best]
    return cost, (cost + 1) * unit - row[rows, best], at[rows, best] + m


def align(pattern: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits of the whole pattern against a part of region, with diagonals from low to high: edits, start, end; None above most."""
    cost, start, end = align_many(pattern[None, :], region, np.array([low]), high - low + 1)
    return (int(cost[0]), int(start[0]), int(end[0])) if cost[0] <= most else None


class Index:
    """The windows of a block of items, equal ones once, by the length of their q-grams."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW, stride: int = STRIDE, rate: float = EDIT_RATE):
        self.items: list[object] = []
        owners: dict[tuple[bool, bytes], set[int]] = {}
        for item_id, text in items:
            codes, _ = normalise(text or "")
            if not len(codes):
                continue
            k = len(self.items)
            self.items.append(item_id)
            size = min(window, len(codes))
            for start in sorted({*range(0, len(codes) - size + 1, stride), len(codes) - size}):
                whole = int(rate * size) == 0
                part = codes[start : start + size]
                owners.setdefault((whole, (np.concatenate([[SPACE], part, [SPACE]]) if whole else part).astype(np.uint32).tobytes()), set()).add(k)
        self.tiers: list[tuple[Tier, list[list[int]], bool]] = []  # tier, items of each window, whether spaces stand around texts
        for i, (q, least) in enumerate(TIERS):
            below = TIERS[i - 1][1] if i else 1 << 60
            for spaced in (False, True):
                some = [(np.frombuffer(raw, dtype=np.uint32), sorted(of)) for (whole, raw), of in owners.items() if whole == spaced and least <= len(raw) // 4 < below]
                if some:
                    edits = [0 if spaced else int(rate * len(p)) for p, _ in some]
                    self.tiers.append((Tier(q, [p for p, _ in some], edits), [of for _, of in some], spaced))


def search(index: Index, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """For each text its leaks as (item, start, end, edits), with code point positions in the text."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    i = 0
    while i < len(texts) and index.tiers:
        size, j = 0, i
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_CHARS):
            size += len(texts[j])
            j += 1
        # the chunk is normalised as one text, with a space between documents
        codes, origin = normalise(" ".join(texts[i:j]))
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        bounds = np.searchsorted(origin, starts)
        found: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in range(i, j)]
        for tier, of, spaced in index.tiers:
            if spaced:  # the space that parts documents serves both, and the ends get one
                text, shift = np.concatenate([[SPACE], codes, [SPACE]]).astype(np.uint32), 1
            else:
                text, shift = codes, 0
            at, rows = tier.occurrences(gram_hashes(text, tier.q))
            if not len(at):
                continue
            doc = np.searchsorted(bounds[:-1], np.minimum(at, len(codes) - 1), side="right") - 1
            cuts = np.flatnonzero(np.diff(doc)) + 1
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(doc)]]), strict=True):
                if hi - lo < tier.least:
                    continue
                d = int(doc[lo])
                a, b = int(bounds[d]), int(bounds[d + 1])
                while b > a and codes[b - 1] == SPACE:
                    b -= 1
                while a < b and codes[a] == SPACE:
                    a += 1
                own = text[a : b + 2 * shift]  # with the spaces around it, where there are such
                for w, s, e, x in tier.hits(own, at[lo:hi] - a, rows[lo:hi]):
                    s, e = max(a, s + a), min(b, e + a - 2 * shift)  # without the spaces around whole words
                    if s < e:
                        for item in of[w]:
                            found[d].setdefault(item, []).append((s, e, x))
        for d, of_items in enumerate(found):
            for item, spans in sorted(of_items.items()):
                out[i + d] += [(item, int(origin[s] - starts[d]), int(origin[e - 1] - starts[d]) + 1, x) for s, e, x in merged(spans)]
        i = j
    return out


def merged(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """Spans that meet as one, with the most edits of any."""
    out: list[list[int]] = []
    for s, e, x in sorted(set(spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
            out[-1][2] = max(out[-1][2], x)
        else:
            out.append([s, e, x])
    return out


def texts_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, key and text of benchmark items with a text, in the shared folder; equal texts have equal keys."""
    some = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    return persist_table(some.select("item", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text"), "benchmark-items")


def blocks_of(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[bytes, str]]]:
    """Different texts (key, text) in lists of at most block_chars characters, but for a longer text, which is a list of its own."""
    different = persist_table(items.groupBy("key").agg(F.first("text").alias("text")), "benchmark-texts")
    total = different.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    while n:
        block = F.pmod(F.xxhash64("key"), F.lit(n))
        sizes = different.groupBy(block.alias("b")).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("texts"))
        if sizes.where((F.col("chars") > block_chars) & (F.col("texts") > 1)).isEmpty():
            break
        n = 2 * n + 1
    for b in range(n):
        rows = different.where(F.pmod(F.xxhash64("key"), F.lit(n)) == b).collect()
        if rows:
            yield [(bytes(r.key), r.text) for r in rows]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per leaked span: id_col, item_id, start, end (code points of the text, end exclusive), edits."""
    spark = docs.sparkSession
    light = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = texts_of(benchmark, item_id_col, item_text_col)
    schema = f"id {light.schema['id'].dataType.simpleString()}, key binary, start long, end long, edits long"
    out = None
    for block in blocks_of(items):
        shared = spark.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = search(index, [t.as_py() or "" for t in batch.column(1)])
                rows = [(i, index.items[item], s, e, x) for i, each in enumerate(found) for item, s, e, x in each]
                if rows:
                    ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.binary()), *[pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3, 4)]], names=["id", "key", "start", "end", "edits"])

        found = light.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    named = out.join(items.select("key", F.col("item").alias("item_id")), "key")
    return named.select(F.col("id").alias(id_col), "item_id", "start", "end", "edits")


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no leak, in one pass over docs and without a shuffle."""
    spark = docs.sparkSession
    out = docs
    for block in blocks_of(texts_of(benchmark, item_id_col, item_text_col)):
        shared = spark.sparkContext.broadcast(Index(block))
        place = out.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = search(shared.value, [t.as_py() or "" for t in batch.column(place)])
                yield batch.filter(pa.array([not x for x in found], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
