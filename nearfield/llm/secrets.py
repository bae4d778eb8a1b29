"""Secret scans: fixed patterns, and novelty of strings in sensitive context by dictionary-primed zstandard.

A candidate is a run of LEAST or more key-like characters with a sensitive word within REACH characters on either
side. The text around it, AROUND characters on each side, is compressed with and without the candidate, each time
with a compressor primed with a dictionary of identifiers; other occurrences of the candidate are taken out of its
surroundings first, so a key that is repeated does not vouch for itself. The difference is what the candidate costs
given its surroundings: identifiers, words and repetitions cost little, random keys cost nearly their entropy.
Candidates that cost at least NOVEL_RATIO of their length are the method's findings. No rule on digits or letters
stands beside the cost.

The dictionary holds a list of identifiers and those of the corpus: words that follow sensitive words in at least
CORPUS_LEAST different places, counted over all documents, the most frequent CORPUS_WORDS of them (the bound is that
of a dictionary that a compressor is primed with for each call).

Defined results: a null text counts as an empty one and has no spans; positions are code points, ends are
exclusive; spans are ordered by start, then by kind as in KINDS; a finding that overlaps a pattern's span is counted
in n_novel and left out of the spans; equal texts have equal spans; an empty table gives no rows; only the id and the
text are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")

# Fixed values of the contract: the base patterns and the least lengths that their matches must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_CHARS = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_CHARS = 20
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more; shorter runs are dropped

#: Words that make what stands around them sensitive, how far they reach, and what is judged.
SENSITIVE = re.compile(r"(?:secret|passw|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|client[ _-]?id|signature|pwd\b)", re.IGNORECASE | re.ASCII)
#: Lower-case strings of which one stands in every match, to pass over other texts cheaply.
SIGNS = ("secret", "passw", "token", "key", "credential", "bearer", "client", "signature", "pwd")
REACH = 64
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
AROUND = 512
NOVEL_RATIO = 0.66
#: A high level: the lower ones leave more to chance on texts of a few hundred bytes.
LEVEL = 19
#: Different places in which a corpus word must stand, and the words that the dictionary takes.
CORPUS_LEAST = 3
CORPUS_WORDS = 2_000

#: Priming text: identifiers and words that stand around keys without being keys.
IDENTIFIERS = (
    "const let var function return import export default class public private static void string String int bool boolean null None True False self this new def async await "
    "if else for while try catch except finally raise throw with from as lambda yield "
    "os.environ process.env getenv System.getProperty config settings options params request response headers Authorization Bearer Basic Content-Type application/json "
    "username user_name password passwd pwd secret secret_key SECRET_KEY token access_token refresh_token api_key apikey API_KEY client_id client_secret private_key public_key "
    "aws_access_key_id aws_secret_access_key connection_string database_url DATABASE_URL hostname localhost example.com http:// https:// www. placeholder changeme your_api_key_here xxxxxxxxxxxxxxxx "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 test_example_sample_dummy_value "
    "environment variable process application configuration connection database authorization header value proxy charset service account project resource document element "
)


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


class Novelty:
    """Marginal compressed size of a string in its surroundings."""

    def __init__(self, corpus_words: Sequence[str] = (), level: int = LEVEL):
        # what stands last in a dictionary is reached at least cost
        primed = zstandard.ZstdCompressionDict((" ".join(corpus_words) + " " + IDENTIFIERS).encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def cost(self, before: str, candidate: str, after: str) -> int:
        before, after = before.replace(candidate, ""), after.replace(candidate, "")
        size = lambda text: len(self.compressor.compress(text.encode("utf-8", "surrogatepass")))
        return size(before + candidate + after) - size(before + after)


def sensitive(text: str) -> bool:
    """Whether a text may hold a sensitive word at all."""
    low = text.lower()
    return any(w in low for w in SIGNS)


def corpus_words(docs: DataFrame, text_col: str = "text", least: int = CORPUS_LEAST, most: int = CORPUS_WORDS) -> list[str]:
    """Words that follow sensitive words in the most different places, the most frequent last.

    A place is the text that follows, so copies of a document count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {text[m.start() : m.end() + REACH] for t in batch.column(0) if sensitive(text := t.as_py() or "") for m in SENSITIVE.finditer(text)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["place"])

    places = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "place string").distinct()
    words = places.select(F.explode(F.array_distinct(F.regexp_extract_all("place", F.lit("[A-Za-z_]{4,}"), F.lit(0)))).alias("word"))
    often = words.groupBy("word").count().where(F.col("count") >= least).orderBy(F.desc("count"), "word").limit(most)
    return [r[0] for r in often.collect()][::-1]


def base_spans(text: str) -> list[Span]:
    low = text.lower()
    found = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found = [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def novel_spans(text: str, novelty: Novelty) -> list[Span]:
    """Incompressible candidates within reach of a sensitive word, whatever the patterns say."""
    if not sensitive(text):
        return []
    words = [m.span() for m in SENSITIVE.finditer(text)]
    found: list[Span] = []
    starts = [a for a, _ in words]
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        # a word before it that ends within reach, or one after it that starts within reach; words inside it say nothing
        k = bisect_left(starts, start)
        near = (k > 0 and start - words[k - 1][1] <= REACH) or ((j := bisect_left(starts, end)) < len(starts) and starts[j] - end <= REACH)
        if near and novelty.cost(text[max(0, start - AROUND) : start], m[0], text[end : end + AROUND]) >= NOVEL_RATIO * (end - start):
            found.append(Span("novel", start, end))
    return found


def spans(text: str | None, novelty: Novelty | None = None) -> list[Span]:
    return _both(text or "", novelty or Novelty())[0]


def _both(text: str, novelty: Novelty) -> tuple[list[Span], int]:
    """All spans in order, and the number of the method's findings."""
    base = base_spans(text)
    novel = novel_spans(text, novelty)
    added = [n for n in novel if not any(s.start < n.end and n.start < s.end for s in base)]
    return sorted([*base, *added], key=lambda s: (s.start, KINDS.index(s.kind))), len(novel)


def joined(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Sequence[str] | None = None) -> DataFrame:
    """Per row of docs: id_col, found (array of kind, start, end), n_assign, n_access, n_hex, base_sha256, spans, n_novel.

    words are the corpus's identifiers; None counts them first, in a pass over docs.
    """
    words = corpus_words(docs, text_col) if words is None else list(words)
    light = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for batch in batches:
            both = [_both(t.as_py() or "", novelty) for t in batch.column(1)]
            each = [x for x, _ in both]
            cols = [pa.array([[{"kind": s.kind, "start": s.start, "end": s.end} for s in x] for x in each], pa.list_(span))]
            cols += [pa.array([sum(s.kind == k for s in x) for x in each], pa.int64()) for k in KINDS[:3]]
            cols.append(pa.array([hashlib.sha256(joined([s for s in x if s.kind != "novel"]).encode()).hexdigest() for x in each], pa.string()))
            cols += [pa.array([joined(x) for x in each], pa.string()), pa.array([n for _, n in both], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "found", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    schema = f"id {light.schema['id'].dataType.simpleString()}, found array<struct<kind string, start long, end long>>, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    return light.mapInArrow(run, schema).withColumnRenamed("id", id_col)
