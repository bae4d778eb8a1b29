"""Toxicity by a subsequence string kernel: a support vector machine on Nyström landmarks.

The kernel counts common subsequences of three and four characters of two strings, each weighted by DECAY
for every character that it skips, so an insult with gaps or inserted characters still shares most of its
subsequences with the plain one. Strings are a sentence's tokens, with marks for their beginning and end;
characters such as digits and signs between letters are folded away, spelled-out letters are joined, and
long tokens are cut into overlapping windows.

Labels are given for whole texts, and a toxic text is mostly made of harmless sentences, so the sentences'
own labels are found first: substrings that occur in many toxic and hardly any clean texts are chosen
greedily until they cover the toxic texts (in some, or in more than one, of a text's words); sentences and tokens that hold one are positive, those of clean
texts negative. A linear machine with squared hinge loss is fitted on the landmarks' kernel values
(Nyström features), harmful negatives are added, and it is fitted again. As the kernel is a scalar product
over subsequences, the fitted machine is folded into one weight for each subsequence, which makes scoring a
token a few hundred table look-ups. A text's score is a logistic function, fitted on training texts that
the machine has not seen, of its highest margin, its number of positive tokens and, where there are any, its length.

The training sample is bounded by TRAIN_TOXIC and TRAIN_CLEAN texts and TRAIN_BYTES bytes, chosen by hash, and the
words fitted on by FIT_POSITIVE, FIT_NEGATIVE and FIT_ADDED; scoring covers all texts and all their tokens. The
score's constant is set so that THRESHOLD is the cut that parts the texts held back best.

Defined results: null and empty texts get the score of a text without tokens; equal texts get equal
scores; rows with a null label or text are not trained on; without labels of both classes every score
is 0; an empty table gives no rows; only the id and the text are read to score a row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, persist_table

#: The training sample: most texts of each class, and most bytes of both, chosen by hash.
TRAIN_TOXIC = 1_000
TRAIN_CLEAN = 2_000
TRAIN_BYTES = 48_000_000
#: Most words of the sample that the machine is fitted on: those with witnesses, harmless ones, and harmless ones added in a round.
FIT_POSITIVE = 4_000
FIT_NEGATIVE = 8_000
FIT_ADDED = 3_000
#: How many times a wrongly flagged share of clean texts counts against a found share of toxic ones where the cut is set.
FALSE_ALARM = 1.5
#: Parts of the sample, each judged by a machine fitted on the others.
FOLDS = 3
#: How often substrings should cover a toxic text.
COVER = 3
LANDMARKS = 160
DECAY = 0.6
#: Characters, marks included, that subsequences of three and of four may span.
SPAN = {3: 5, 4: 7}
WIDTH = 16
SYMBOLS = 48
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêçñóíáúàôîï"
THRESHOLD = 0.7
#: Tokens whose margins a worker remembers.
REMEMBERED = 500_000

SENTENCE = re.compile(r"[.!?]+\s|\n")
SPELLED = re.compile(r"(?<!\S)[^\W\d_](?:[\s.\-_*]+[^\W\d_]){3,}(?!\S)")
SIGNS = ".,;:!?¿¡…\"'`´“”„«»()[]{}<>|/\\*%$#&+=~^_-"
PLAIN = re.compile(r"[^\W\d_]+")
#: Signs that stand for letters inside a word.
LOOKS_LIKE = str.maketrans("0134578@$!€", "oieastbasie")


def _codes() -> np.ndarray:
    out = np.array([3 + i % (SYMBOLS - 3) for i in range(0x10000)], dtype=np.int32)
    for i, c in enumerate(LETTERS):
        out[ord(c)] = 3 + i
    out[ord("^")], out[ord("$")], out[0] = 1, 2, 0
    return out


CODES = _codes()
SHAPES = {p: [(0, *rest) for rest in combinations(range(1, SPAN[p]), p - 1)] for p in SPAN}


def forms(token: str) -> list[str]:
    """The strings that a lower-case token is judged by: its letters, and its parts where signs part it."""
    if token.isalpha():
        return [token]
    core = token.strip(SIGNS)
    if core.isalpha():
        return [core]
    parts = [p for p in PLAIN.findall(core) if len(p) > 1]
    folded = "".join(PLAIN.findall(core.translate(LOOKS_LIKE)))
    bare = "".join(PLAIN.findall(core))
    return list(dict.fromkeys(x for x in (*parts, folded, bare) if x))


def windows(word: str) -> list[str]:
    marked = f"^{word}$"
    if len(marked) <= WIDTH:
        return [marked]
    return [marked[i : i + WIDTH] for i in range(0, len(marked) - WIDTH // 2, WIDTH // 2)]


def encode(strings: list[str]) -> np.ndarray:
    """Symbols of strings of at most WIDTH characters, padded with 0."""
    if not strings:
        return np.zeros((0, WIDTH), dtype=np.int32)
    raw = np.array(strings, dtype=f"<U{WIDTH}").view(np.uint32).reshape(-1, WIDTH)
    return CODES[raw & 0xFFFF]


def subsequences(x: np.ndarray) -> Iterator[tuple[int, float, np.ndarray]]:
    """For each shape of skipping: length, weight, and the subsequences' numbers by row and position."""
    for p, shapes in SHAPES.items():
        for shape in shapes:
            n = x.shape[1] - shape[-1]
            number = x[:, :n].astype(np.int32)
            whole = number > 0
            for o in shape[1:]:
                part = x[:, o : o + n]
                whole &= part > 0
                number = number * SYMBOLS + part
            yield p, DECAY ** (shape[-1] + 1 - p), np.where(whole, number, 0)


class Kernel:
    """Kernel values against landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        x = encode(landmarks)
        columns: dict[tuple[int, int], int] = {}
        entries: list[tuple[int, int, float]] = []
        for p, weight, number in subsequences(x):
            for row, col in zip(*np.nonzero(number), strict=True):
                key = (p, int(number[row, col]))
                entries.append((columns.setdefault(key, len(columns)), int(row), weight))
        self.features = np.zeros((len(columns) + 1, len(landmarks)), dtype=np.float32)
        for c, row, weight in entries:
            self.features[c, row] += weight
        self.columns = {p: np.full(SYMBOLS**p, len(columns), dtype=np.int32) for p in SHAPES}
        self.keys = {p: [] for p in SHAPES}
        for (p, number), c in columns.items():
            self.columns[p][number] = c
            self.keys[p].append((number, c))

    def values(self, strings: list[str], batch: int = 512) -> np.ndarray:
        out = np.zeros((len(strings), len(self.landmarks)), dtype=np.float32)
        for at in range(0, len(strings), batch):
            part = strings[at : at + batch]
            counts = np.zeros((len(part), len(self.features)), dtype=np.float32)
            rows = np.arange(len(part))[:, None]
            for p, weight, number in subsequences(encode(part)):
                column = np.broadcast_to(self.columns[p][number], number.shape)
                np.add.at(counts, (np.broadcast_to(rows, number.shape), column), weight)
            counts[:, -1] = 0
            out[at : at + batch] = counts @ self.features
        return out

    def folded(self, by_landmark: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """One weight for each subsequence: numbers and weights by length."""
        weights = self.features @ by_landmark
        return {p: (np.array([k for k, _ in keys], dtype=np.int64), np.array([weights[c] for _, c in keys], dtype=np.float32)) for p, keys in self.keys.items()}


def squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights, the last for a constant, of a linear machine with squared hinge loss, by Newton's method."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        return 0.5 * float((ridge * w * w).sum()) + float((cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    before = loss(w)
    for _ in range(rounds):
        open_ = 1 - y * (x @ w) > 0
        xo, c = x[open_], cost[open_]
        gradient = ridge * w - 2 * xo.T @ (c * (y[open_] - xo @ w))
        hessian = np.diag(ridge) + 2 * (xo * c[:, None]).T @ xo
        step = np.linalg.solve(hessian, gradient)
        rate = 1.0
        while loss(w - rate * step) > before and rate > 1e-4:
            rate /= 2
        w = w - rate * step
        now = loss(w)
        if before - now < 1e-6 * max(1.0, before):
            break
        before = now
    return w


@dataclass
class Model:
    """A fitted machine: weights of subsequences, a constant, and the logistic function of a text's features."""

    weights: dict[int, tuple[np.ndarray, np.ndarray]]
    constant: float
    logistic: np.ndarray

    def tables(self) -> dict[int, np.ndarray]:
        out = {}
        for p in SHAPES:
            out[p] = np.zeros(SYMBOLS**p, dtype=np.float32)
            numbers, weights = self.weights[p]
            out[p][numbers] = weights
        return out


class Scorer:
    """Scores texts with a model."""

    def __init__(self, model: Model):
        self.model, self.tables, self.known = model, model.tables(), {}

    def margins(self, strings: list[str], batch: int = 8_192) -> np.ndarray:
        out = np.full(len(strings), self.model.constant, dtype=np.float64)
        for at in range(0, len(strings), batch):
            for p, weight, number in subsequences(encode(strings[at : at + batch])):
                out[at : at + batch] += weight * self.tables[p][number].sum(axis=1)
        return out

    def learn(self, tokens: list[str]) -> None:
        """Remember the margins of tokens: the highest of their forms' windows."""
        strings, starts = [], []
        for t in tokens:
            starts.append(len(strings))
            strings += [w for f in forms(t) for w in windows(f)] or ["^$"]
        if strings:
            self.known.update(zip(tokens, np.maximum.reduceat(self.margins(strings), starts).tolist(), strict=True))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Highest margin, log of 1 + sum of the positive margins (each up to 1) and, if there are any, log of 1 + number of tokens."""
        sets = [tokens_of(t) for t in texts]
        out = np.zeros((len(texts), 3))
        at = 0
        while at < len(sets):
            stop, new = at, set()
            while stop < len(sets) and (stop == at or len(new) < REMEMBERED // 4):
                new.update(t for t in sets[stop] if t not in self.known)
                stop += 1
            if len(self.known) + len(new) > REMEMBERED:
                self.known = {}
                new = set().union(*sets[at:stop])
            self.learn(list(new))
            get = self.known.__getitem__
            for i in range(at, stop):
                values = list(map(get, sets[i]))
                positive = [v for v in values if v > 0]
                top = max(positive) if positive else max(values, default=-2.0)
                out[i] = max(-2.0, min(2.0, top)), np.log1p(sum(min(1.0, v) for v in positive)), np.log1p(len(values)) * bool(positive)
            at = stop
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.model.logistic.size:
            return np.zeros(len(texts))
        w = self.model.logistic
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ w[:-1] + w[-1], -30, 30)))


def tokens_of(text: str | None) -> set[str]:
    low = (text or "").lower()
    found = set(low.split())
    for m in SPELLED.finditer(low):
        found.add("".join(PLAIN.findall(m[0])))
    return found


def _substrings(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + k] for k in (4, 5, 6) for i in range(len(marked) - k + 1)]


def _number(g: str) -> int:
    """A substring's number: its length, then a hash."""
    return len(g) << 32 | zlib.crc32(g.encode("utf-8", "surrogatepass"))


class _Numbers:
    """Numbers of the substrings of words; each text's as those in some word and those in more than one."""

    def __init__(self):
        self.of: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        if w not in self.of:
            self.of[w] = np.unique(np.array([_number(g) for g in _substrings(w)], dtype=np.int64))
        return self.of[w]

    def text(self, words: set[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.word(w) for w in words if len(w) > 1]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        numbers, counts = np.unique(np.concatenate(parts), return_counts=True)
        return numbers, numbers[counts > 1]


def _overlap(g: str, h: str) -> bool:
    """Whether g and h may be parts of one longer string."""
    return g in h or h in g or any(g[:k] == h[-k:] or h[:k] == g[-k:] for k in range(2, min(len(g), len(h))))


def _apart(texts: list[set[str]]) -> list[int]:
    """Texts of which no earlier one has the same two words of smallest hash: near copies count once."""
    seen, out = set(), []
    for i, words in enumerate(texts):
        key = tuple(sorted((zlib.crc32(w.encode("utf-8", "surrogatepass")), w) for w in words if len(w) > 2)[:2])
        if len(key) < 2 or key not in seen:
            seen.add(key)
            out.append(i)
    return out


def witnesses(toxic: list[set[str]], clean: list[set[str]], least: int = 3) -> list[str]:
    """Substrings chosen greedily that cover the toxic texts and occur in hardly any clean text."""
    numbers = _Numbers()
    share = len(clean) / max(1, len(toxic))
    held = [numbers.text(words) for words in toxic]
    where: dict[tuple[int, int], set[int]] = {}
    in_clean: dict[tuple[int, int], int] = {}
    often = []
    for n in (0, 1):
        every, counts = np.unique(np.concatenate([h[n] for h in held]), return_counts=True)
        often.append((every[counts >= least], counts[counts >= least], np.zeros(int((counts >= least).sum()), dtype=np.int64)))
    for words in clean:
        for n, some in enumerate(numbers.text(words)):
            every, _, count = often[n]
            at = np.searchsorted(every, some)
            at = at[at < len(every)]
            count[at[np.isin(every[at], some)]] += 1
    for n, (every, counts, count) in enumerate(often):
        good = count <= 0.02 * counts * share
        in_clean |= {(g, n): c for g, c in zip(every[good].tolist(), count[good].tolist(), strict=True)}
    for i, h in enumerate(held):
        for n in (0, 1):
            for g in h[n].tolist():
                if (g, n) in in_clean:
                    where.setdefault((g, n), set()).add(i)
    names = {v: g for words in toxic for w in words for g in _substrings(w) if ((v := _number(g)), 0) in in_clean or (v, 1) in in_clean}
    where = {(names[g], n): d for (g, n), d in where.items()}
    in_clean = {(names[g], n): c for (g, n), c in in_clean.items()}
    chosen: list[str] = []
    need = dict.fromkeys(range(len(toxic)), COVER)
    few = max(least, len(toxic) // 50)
    while where:
        # of equally good ones the longest
        best = max(where, key=lambda f: (len(where[f]) - 5 * in_clean[f] / share, len(f[0]), f))
        gain = where.pop(best)
        # texts that are covered already count only for substrings that many texts have
        if len(gain) < (few if any(need[i] < COVER for i in gain) else least):
            break
        if best[0] not in chosen:
            chosen.append(best[0])
        for i in gain:
            need[i] -= 1
        full = {i for i in gain if need[i] == 0}
        where = {f: rest for f, d in where.items() if len(rest := d - (gain if _overlap(f[0], best[0]) else full)) >= least}
    return chosen


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, seed: int = 7) -> Model:
    """Fit on whole texts and their labels (1 toxic, 0 clean).

    For each of FOLDS parts a machine is fitted on the others and judges it, so every text is judged by a machine that
    has not seen it; the logistic function is fitted on those judgements. The model's weights are the machines' mean.
    """
    nothing = Model({p: (np.zeros(0, np.int64), np.zeros(0, np.float32)) for p in SHAPES}, -1.0, np.zeros(0))
    texts, labels = zip(*dict(zip(texts, labels, strict=True)).items(), strict=True) if texts else ((), ())  # copies tell nothing new
    y = np.array(labels)
    if not (y == 1).any() or not (y == 0).any():
        return nothing
    rng = np.random.default_rng(seed)
    words = [{f for s in SENTENCE.split(t) for token in tokens_of(s) for f in forms(token)} for t in texts]
    fold = np.zeros(len(texts), dtype=int)
    for label in (0, 1):
        of = rng.permutation(np.flatnonzero(y == label))
        fold[of] = np.arange(len(of)) % FOLDS
    parts = [(fold != k, fold == k) for k in range(FOLDS)]
    if min((y == 1).sum(), (y == 0).sum()) < 2 * FOLDS:
        parts = [(fold >= 0, fold >= 0)]
    machines, x = [], np.zeros((len(texts), 3))
    for learned, judged in parts:
        machine = _machine(words, y, learned, landmarks, rng)
        if machine is None:
            return nothing
        machines.append(machine)
        x[judged] = Scorer(machine).features([texts[i] for i in np.flatnonzero(judged)])
    w = _logistic(x, y.astype(float))
    if w[2] > 0:  # a text is not more toxic for being longer
        w = np.insert(_logistic(x[:, :2], y.astype(float)), 2, 0.0)
    w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - _cut(x @ w[:-1] + w[-1], y)
    weights = {}
    for p in SHAPES:
        numbers, place = np.unique(np.concatenate([m.weights[p][0] for m in machines]), return_inverse=True)
        weights[p] = (numbers, (np.bincount(place, np.concatenate([m.weights[p][1] for m in machines]), len(numbers)) / len(machines)).astype(np.float32))
    return Model(weights, float(np.mean([m.constant for m in machines])), w)


def _machine(words: list[set[str]], y: np.ndarray, use: np.ndarray, landmarks: int, rng: np.random.Generator) -> Model | None:
    """The kernel machine of the words of the texts to use, without the logistic function; None where nothing sets toxic texts apart."""
    toxic = [w for w, t, u in zip(words, y, use, strict=True) if u and t == 1]
    toxic = [toxic[i] for i in _apart(toxic)]
    clean = [w for w, t, u in zip(words, y, use, strict=True) if u and t == 0]
    chosen = witnesses(toxic, clean, 3 if len(toxic) >= 30 else 1)
    harmless = set().union(*clean)
    marks = re.compile("|".join(map(re.escape, chosen))) if chosen else None
    positive = sorted({w for ws in toxic for w in ws if marks and marks.search(f"^{w}$")} - harmless)
    if not positive:
        return None
    positive = [positive[i] for i in sorted(rng.permutation(len(positive))[:4_000])]
    harmless = sorted(harmless)
    negative = [harmless[i] for i in rng.permutation(len(harmless))[:FIT_NEGATIVE]]
    # landmarks: for each witness its shortest words, then words of both classes
    ranked: list[str] = []
    each = max(2, landmarks * 3 // 4 // max(1, len(chosen)))
    for g in chosen:
        ranked += sorted((w for w in positive if g in f"^{w}$"), key=lambda w: (len(w), w))[:each]
    ranked = list(dict.fromkeys(ranked))[: landmarks * 3 // 4]
    ranked += [negative[i] for i in rng.permutation(len(negative))[: landmarks - len(ranked)]]
    kernel = Kernel(list(dict.fromkeys(windows(w)[0] for w in ranked)))
    own = kernel.values(kernel.landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    kept = values > 1e-6 * values.max()
    nystroem = vectors[:, kept] / np.sqrt(values[kept])

    def at_witness(w: str) -> str:
        """The window of a positive word that holds the witness."""
        return next((x for x in windows(w) if marks.search(x)), windows(w)[0])

    def inserted(w: str) -> str:
        """The word with a letter too many."""
        at = int(rng.integers(1, len(w)))
        return w[:at] + (w[at] if rng.random() < 0.3 else "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))]) + w[at:]

    short = [w for w in positive if 4 < len(w) <= 11 and any(len(g.strip("^$")) >= len(w) - 4 for g in chosen if g in f"^{w}$")]
    disguised = {inserted(w) for w in short for _ in range(12 if len(short) < 200 else 2)} - set(harmless)
    pos = list(dict.fromkeys([*(at_witness(w) for w in positive), *(f"^{w}$" for w in sorted(disguised))]))
    plain = np.array([x[1:-1] not in disguised for x in pos])
    neg = list(dict.fromkeys(x for w in negative for x in windows(w)))
    every = list(dict.fromkeys(x for w in harmless for x in windows(w)))
    model = None
    for _ in range(6):
        z = np.vstack([kernel.values(pos), kernel.values(neg)]) @ nystroem
        t = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        cost = np.concatenate([np.where(plain, 10.0, 2.0) * max(1.0, len(neg) / len(pos)) ** 0.5, np.full(len(neg), 20.0)])
        w = squared_hinge(z, t, cost)
        model = Model(kernel.folded((nystroem @ w[:-1]).astype(np.float32)), float(w[-1]), np.zeros(0))
        margins = Scorer(model).margins(every)
        hard = [every[i] for i in np.flatnonzero(margins > -0.6)]
        new = [x for x in dict.fromkeys(hard) if x not in set(neg)] if hard else []
        if not new:
            break
        neg += new[:FIT_ADDED]
    return model


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """The value that parts toxic from clean texts best: found share less FALSE_ALARM times the wrong share; in the middle of the widest best gap."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    above = lambda hit: np.concatenate([[hit.sum()], hit.sum() - np.cumsum(hit)]) / max(1, hit.sum())
    gain = above(y == 1) - FALSE_ALARM * above(y == 0)
    width = np.where(gain >= gain.max() - 1e-12, np.diff(edges), -1.0)
    k = int(width.argmax())
    return float(edges[k] + edges[k + 1]) / 2


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights and constant of a ridge logistic regression; classes count equally."""
    x = np.hstack([x, np.ones((len(x), 1))])
    cost = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.1)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (cost * (p - y)) + ridge * w
        hessian = (x * (cost * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most toxic and clean labelled texts, those whose ids have the smallest hashes, of most_bytes bytes at most."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    picked = None
    for label, most in ((1, toxic), (0, clean)):
        some = marked.where(F.col("label") == label).orderBy(F.xxhash64("id", F.lit("train")), "id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(picked), "id")
    # a text for each id, however many rows repeat it; then the first of them by hash that fit the bytes
    found = persist_table(found.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "toxicity-sample")
    # at most toxic + clean rows of numbers: one task orders them
    w = Window.orderBy(F.xxhash64("id", F.lit("train")), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fitting = found.select("id", F.sum(F.octet_length("text")).over(w).alias("upto")).where(F.col("upto") <= most_bytes).select("id")
    rows = found.join(F.broadcast(fitting), "id").collect()
    ordered = sorted(rows, key=lambda r: r["id"])
    return fit([r["text"] for r in ordered], [int(r["label"]) for r in ordered])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of each whole text in score_col, with an underscore more where docs have such a column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    score_col = free_name(docs, score_col)
    place = docs.columns.index(text_col)
    names = [*docs.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer.scores(part.column(place).to_pylist()), pa.float64())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
