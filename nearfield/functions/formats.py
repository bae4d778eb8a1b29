"""How points are stored: unit vectors (optionally as 16-bit fixed point), raw vectors, and token sets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the 16-bit format: scale and largest code.
Q15_SCALE = 32_768
Q15_MAX = 32_767
#: Elements that the 16-bit format pads to (256 bits).
PAD = 16


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))


def normalise(v: Column) -> Column:
    """v at length 1, as doubles; a zero vector stays zero."""
    # the norm is bound as a variable: inside the lambda it would be computed again for each element
    bound = F.array(F.struct(v.alias("v"), F.sqrt(squared_norm(v)).alias("norm")))
    return F.transform(bound, lambda p: F.transform(p["v"], lambda x: F.when(p["norm"] > 0, x.cast("double") / p["norm"]).otherwise(x.cast("double"))))[0]


def to_q15(x: Column) -> Column:
    """A number as a 16-bit fixed point code: truncated toward zero, at most 32,767."""
    scaled = x.cast("double") * Q15_SCALE
    whole = F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled))
    return F.greatest(F.lit(-Q15_SCALE), F.least(whole, F.lit(Q15_MAX))).cast("short")


def from_q15(code: Column) -> Column:
    return code.cast("double") / Q15_SCALE


def quantise(v: Column) -> Column:
    return F.transform(v, to_q15)


def dequantise(codes: Column) -> Column:
    return F.transform(codes, from_q15)


def checked_vector(v: Column, dimensions: int) -> Column:
    """v, or an error for a row of another length."""
    return F.when(F.size(v) == dimensions, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimensions} dimensions, got "), F.size(v).cast("string"))))


def token_set(tokens: Column, universe: int | None = None) -> Column:
    """Distinct tokens in ascending order, or an error for a token outside [0, universe)."""
    ordered = F.array_sort(F.array_distinct(tokens))
    if universe is None:
        return ordered
    return F.when(~F.exists(tokens, lambda t: (t < 0) | (t >= universe)), ordered).otherwise(F.raise_error(F.lit(f"token outside [0, {universe})")))


def text_tokens(text: Column, universe: int) -> Column:
    """Words of a text as a set of MD5-derived tokens in [0, universe); universe is a power of two."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(universe)).cast("int"))))


#: Words whose tokens a task remembers.
WORDS = 200_000
#: Texts that a task holds as Python strings.
TEXTS = 256


def text_sets(texts: DataFrame, universe: int) -> DataFrame:
    """texts (an id, text) with text_tokens of the texts, as tokens; each word is hashed about once in a task."""
    key = texts.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = re.compile("[a-z0-9]+").findall, {}
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            sets = []
            for text in batch.column(1).to_pylist():
                if len(known) > WORDS:
                    known.clear()
                found = None if text is None else set(words(text))
                for w in found or ():
                    if w not in known:
                        known[w] = int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:8], 16) % universe
                sets.append(None if found is None else sorted({known[w] for w in found}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=[key, "tokens"])

    return texts.select(key, F.lower("text").alias("text")).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, tokens array<int>")


def padded_dimensions(dimensions: int) -> int:
    return -(-dimensions // PAD) * PAD
