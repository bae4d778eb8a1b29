"""Token counts through a digest cache.

A cache row is (content, tokenizer, n_tokens): digests of a normalised text and of a tokenizer's file and
library version, and the count. The cache is a folder of Parquet files in the shared folder, so a lost executor
loses nothing that was stored, and a second run over the same texts encodes nothing.

Texts never travel. One pass over the documents digests each normalised text and asks a Bloom filter of the
cached digests: what it says no to is a miss, and is encoded where it is, once for each task that reads it; copies in
the task take the count. What it says yes to is joined to the cache by digest, so only digests are shuffled. The
filter has at most FILTER_BITS bits; the few texts that it lets pass wrongly (all, if the cache far outgrows it) are
found by that join and encoded in a second pass. Distinct counts are then appended to the cache.

Normalising keeps the count: white space is brought to single spaces and A-Z to a-z where the tokenizer's own file
drops the one and lowers the other, and texts with a special token's string stay as they are. Where a file's
pre-tokenizer never crosses white space, and every step before the BPE works on the pieces between white space alone, a text's count is
the sum of its pieces' counts, and each worker remembers the counts of short pieces, up to a fixed number. For other
files (.json for tokenizers, .model for sentencepiece) texts are encoded whole and digested as they are.

Defined results: a null text counts as an empty one, with 0 bytes and 0 tokens; equal texts have equal
counts; repeated rows give repeated results; an empty table gives no rows; only the id and the text are
read, so other columns' names do no harm.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_table, scratch_path

LIMIT = 2048
#: Pieces of at most so many characters whose counts a worker remembers, and how many of them; and of digests.
PIECE_CHARS = 48
PIECES = 600_000
DIGESTS = 200_000
#: Most bits of the filter, and bits for each cached digest.
FILTER_BITS = 1 << 27
BITS_PER_DIGEST = 16
#: Characters at which Python splits and the tokenizer's pattern need not, and marks of special tokens.
ODD = re.compile("[\x1c-\x1f\x85\u180e\ufeff]|<\\||\\|>")
# Fixed value of tokenizer files: a pattern whose matches hold no white space; what it does not match is removed.
SPACE_FREE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_at_spaces(spec: dict) -> tuple[bool, bool]:
    """Whether a tokenizer file's steps work on the pieces between white space alone, and whether it lowers letters."""
    normalizer = spec.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    plain = all(n["type"] in ("NFC", "NFD", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in steps)
    before = spec.get("pre_tokenizer") or {}
    chain = before.get("pretokenizers", [before] if before else [])
    first = chain[0] if chain else {}
    removes = first.get("type") == "WhitespaceSplit" or (first.get("type") == "Split" and first["pattern"] == {"Regex": SPACE_FREE} and first["behavior"] == "Removed" and first["invert"])
    rest = all(c["type"] == "ByteLevel" and not c.get("add_prefix_space") and not c.get("use_regex") for c in chain[1:])
    ends = spec.get("post_processor") is None and not spec["model"].get("dropout")
    return plain and removes and rest and ends, any(n["type"] == "Lowercase" for n in steps)


class Counter:
    """Counts tokens as the library of a tokenizer file does."""

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        self.pieces = self.lowers = False
        self.specials: list[str] = []
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.tokenizer = None
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.lowers = parts_at_spaces(json.loads(Path(path).read_text("utf-8")))

    def whole(self, text: str) -> int:
        if self.tokenizer is None:
            return len(self.model.encode(text, num_threads=1))
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def learn(self, pieces: list[str]) -> None:
        if len(self.known) + len(pieces) > PIECES:
            self.known.clear()
        for piece, e in zip(pieces, self.tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True):
            self.known[piece] = len(e.ids)

    def parts(self, text: str) -> list[str] | None:
        """The pieces of which the counts add up, or None."""
        if not self.pieces or ODD.search(text) or any(s in text for s in self.specials):
            return None
        return text.split()

    def digest(self, text: str, parts: list[str] | None) -> bytes:
        """Of the normalised text; equal digests have equal counts."""
        if parts is None:
            return hashlib.md5(b"whole:" + text.encode("utf-8", "surrogatepass")).digest()
        raw = " ".join(parts).encode("utf-8", "surrogatepass")
        return hashlib.md5(raw.lower() if self.lowers else raw).digest()  # bytes.lower() changes A-Z only

    def count(self, text: str) -> int:
        return self.count_parts(text, self.parts(text))

    def count_parts(self, text: str, pieces: list[str] | None) -> int:
        if pieces is None:
            return self.whole(text)
        known = self.known
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            pass
        missing = {p for p in pieces if p not in known}
        long = {p for p in missing if len(p) > PIECE_CHARS}
        short = list(missing - long)
        if len(short) > PIECES // 2:
            return self.whole(text)
        if len(known) + len(short) > PIECES:  # start again, with the pieces of this text
            known.clear()
            short = list(set(pieces) - long)
        self.learn(short)
        return sum([known[p] if p in known else self.whole(p) for p in pieces])


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def tokenizer_digest(path: str) -> str:
    """Changes with the file and with the library, as both decide the counts."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(Path(path).read_bytes() + library.__version__.encode()).hexdigest()


def _read_cache(spark, cache: str, version: str) -> DataFrame | None:
    files = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return None
    stored = spark.read.schema("content binary, tokenizer string, n_tokens long").parquet(cache)
    return stored.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


class Filter:
    """A Bloom filter of digests: three bits for each, from the digest's own bytes."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, len(words) * 64 - 1

    def __contains__(self, digest: bytes) -> bool:
        return all(int(self.words[b >> 6]) >> (b & 63) & 1 for b in (int.from_bytes(digest[4 * i : 4 * i + 4], "big") & self.mask for i in range(3)))


def filter_of(digests: DataFrame) -> Filter:
    """Of digests (content), with at most FILTER_BITS bits: that many bits, in words, are all that reaches the driver."""
    n = digests.count()
    bits = 64
    while bits < min(FILTER_BITS, BITS_PER_DIGEST * n):
        bits *= 2
    at = [F.conv(F.hex(F.substring("content", 4 * i + 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit(bits - 1)) for i in range(3)]
    ones = digests.select(F.explode(F.array(*at)).alias("bit"))
    rows = ones.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("ones")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("ones").to_numpy().view(np.uint64)
    return Filter(words)


def _digested(docs: DataFrame, path: str, known: Filter | None, inside: bool = False) -> DataFrame:
    """id, n_bytes, content and n_tokens of docs (id, text); texts outside the filter are encoded (or those inside), all without one."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, cached = counter(path), shared.value
        seen: dict[bytes, int] = {}
        for batch in batches:
            contents, counts, sizes = [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                parts = c.parts(text)
                digest = c.digest(text, parts)
                n = seen.get(digest)
                if n is None and (cached is None or (digest in cached) == inside):
                    n = c.count_parts(text, parts)
                    if len(seen) >= DIGESTS:
                        seen.clear()
                    seen[digest] = n
                contents.append(digest)
                counts.append(n)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "content", "n_tokens"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_bytes long, content binary, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    cache is the cache's folder, of which the tokenizer's rows are used and to which misses are appended;
    without it the call starts an empty one.
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    light = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def append(rows: DataFrame) -> None:
        fresh = rows.where("n_tokens is not null").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
        fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    stored = _read_cache(spark, cache, version)
    rows = persist_table(_digested(light, tokenizer_path, None if stored is None else filter_of(stored)), "token-rows")
    append(rows)
    out = rows.where("n_tokens is not null")
    if stored is not None:
        asked = rows.where("n_tokens is null").drop("n_tokens")
        lost = asked.join(stored, "content", "left_anti").select("content").distinct()
        if not lost.isEmpty():  # the filter was wrong about these: their texts are digested again, and encoded
            again = _digested(light, tokenizer_path, filter_of(lost), inside=True)
            append(persist_table(again.join(lost, "content", "left_semi"), "token-rows-lost"))
        out = out.unionByName(asked.join(_read_cache(spark, cache, version), "content"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
