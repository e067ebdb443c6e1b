"""Toxicity of texts, read through their disguises: a noisy channel, decoded by Viterbi, then a scorer of words.

A character language model is counted over the words of all documents: the chance of a letter (or
a word's end) after the three before it, smoothed by shorter contexts. Tasks add up their counts before they
are shuffled; the table has SYMBOLS^4 cells, whatever the corpus.

The channel says how a writer may have disguised a word: look-alike digits and signs, a sign in place of
a letter, letters repeated, letters parted by signs or by spaces. What is seen is a lattice of what may have been meant,
each reading at its price; the cheapest way through the lattice, prices and language model together, is what is read.
A token without any such ambiguity has one reading and is not decoded. Case, accents, wide and look-alike letters and
invisible characters are folded before. A run of three or more single characters between spaces is read as a whole.
Words that are merely cut in two longer parts are not joined.

Documents are scored by the words in them once restored. Which words count is chosen by a logistic model under L1 and L2 penalties (few words, but none left out because it goes with another), fitted on a
bounded sample of at most TRAIN_DOCS labelled texts (equal texts count once, and so do near copies); what a word counts is the share of the
texts with it that are toxic, and words add up as independent causes, so that one is enough. Labels, languages, sources and ids are no inputs.
Languages that build words leave no single word frequent. In training texts without any chosen word, stems (how words begin) are therefore
chosen one after the other: the one that tells most about the texts that none before it is in, and of those in the same texts the longest.

Null and empty texts score what a text without any known word scores. Repeated rows each get their row; repeated labels
of a document are averaged, labels that are null or neither 0 nor 1 are ignored. Without labels of both kinds every text
scores the share of ones (0 without labels). Columns other than those named are not looked at.
"""

from __future__ import annotations

import array
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_texts, only, settle, slices, texts_of
from .neardup import mixed, shingle_hashes

#: A word's end, 26 letters, any other letter.
SYMBOLS = 28
#: How much a context is worth against the next shorter one, in occurrences.
SMOOTHING = 4.0
TRAIN_DOCS = 20_000
#: A word is looked at if so many training texts have it, and if its share of toxic ones is so many standard deviations off.
LEAST_TEXTS, LEAST_Z = 5, 4.0
LASSO, RIDGE = 0.01, 0.03
#: Stems have so many letters. One counts if most texts with it are toxic and twice its log likelihood ratio is so much, which chance reaches once in billions of stems.
STEMS, STEM_EVIDENCE = (4, 12), 40.0
TOXIC_AT = 0.3

# What a digit or sign may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "¥": "y", "§": "s"}
# Letters of other scripts that look like Latin ones and that Unicode does not decompose.
SAME_SHAPE = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d"}
#: Signs that stand for any letter.
MASKS = frozenset("*#")

# Prices (negative logarithms) of what the channel does.
DOUBLED, DOUBLE_KEPT = 6.0, 0.0  # a pair of equal letters stands for one, for itself
STRETCHED_TO_TWO = 0.7  # three or more equal letters for two instead of one
LOOKS_LIKE, MASKED = 1.0, 3.0
SIGN_PARTS, SIGN_JOINS = 0.3, 1.5  # a sign within a token: words apart, or nothing
DIGIT_PARTS, LOOK_ALIKE_JOINS = 2.0, 2.0
SPACE_PARTS, SPACE_JOINS = 1.5, 0.3  # between single characters

_MARKS = re.compile("[̀-ͯ­​-‏⁠﻿]+")
_SHAPES = re.compile(f"[{''.join(SAME_SHAPE)}]")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
_EDGES = ".,;:?\"'()[]{}<>-_/\\~^`=&%"
_PAIR = re.compile(r"(.)\1")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_MEMO = 200_000


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))
    return _SHAPES.sub(lambda m: SAME_SHAPE[m[0]], text)


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else SYMBOLS - 1


# -- the language model

def gram_counts(words: dict[str, int]) -> np.ndarray:
    """How often each symbol follows each three, by code, in words that occur so often."""
    if not words:
        return np.zeros(SYMBOLS**4, np.int64)
    seen = np.frombuffer(("   " + "   ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    c = np.where((seen >= 97) & (seen <= 122), seen - 96, np.where(seen == 32, 0, SYMBOLS - 1))
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 3)
    times = np.append(times, times[-1])
    code = ((c[:-3] * SYMBOLS + c[1:-2]) * SYMBOLS + c[2:-1]) * SYMBOLS + c[3:]
    real = (c[2:-1] > 0) | (c[3:] > 0)  # from a word's first letter to its end
    return np.bincount(code[real], times[2:-1][real], SYMBOLS**4).astype(np.int64)


def counted_grams(df: DataFrame, *, text: str = "text") -> DataFrame:
    """(gram, n) over the words of all texts: tokens of letters only, once what ends sentences is off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**4, np.int64)
        for part in slices(batches):
            tokens: Counter[str] = Counter()
            for t in texts_of(part):
                tokens.update(folded(t).split())
            words: Counter[str] = Counter()
            for w, n in tokens.items():
                if (w := w.strip(_EDGES)).isalpha():
                    words[w] += n
            total += gram_counts(words)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"])

    each = only(df, text=text).mapInArrow(run, "gram int, n long")
    return each.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(df: DataFrame, *, text: str = "text") -> np.ndarray:
    """Prices of a symbol after three others; at most SYMBOLS^4 counts come to the driver."""
    found = counted_grams(df, text=text).toArrow()
    counts = np.zeros(SYMBOLS**4)
    counts[found["gram"].to_numpy()] = found["n"].to_numpy()
    counts = counts.reshape((SYMBOLS,) * 4)
    shorter = [counts, counts.sum(0), counts.sum((0, 1)), counts.sum((0, 1, 2))]
    p = (shorter[3] + 1) / (shorter[3].sum() + SYMBOLS)
    for c in (shorter[2], shorter[1], shorter[0]):
        p = (c + SMOOTHING * p) / (c.sum(-1, keepdims=True) + SMOOTHING)
    return -np.log(p).astype(np.float32).ravel()


# -- the lattice

#: A place of the lattice: readings (what is written, price); an empty string parts words, None is nothing.
Place = list[tuple[tuple[str, ...] | str | None, float]]
_ANY: Place = [((c,), MASKED) for c in "abcdefghijklmnopqrstuvwxyz"]


def single(seen: str, at: int, way: int) -> bool:
    """Whether the character at `at` is a letter or digit and the next one, that way, is not."""
    return 0 <= at < len(seen) and seen[at].isalnum() and not (0 <= at + way < len(seen) and seen[at + way].isalnum())


def lattice(seen: str, twice: bool = False) -> list[Place]:
    """The places of a token, or of single characters between spaces; with twice, three or more equal letters stand for two."""
    places: list[Place] = []
    i, n = 0, len(seen)
    while i < n:
        c, j = seen[i], i + 1
        while j < n and seen[j] == c:
            j += 1
        times, i = j - i, j
        if c.isspace():
            places.append([("", SPACE_PARTS), (None, SPACE_JOINS)])
        elif c.isalpha():
            if times == 1:
                places.append([((c,), 0.0)])
            elif times == 2:
                places.append([((c,), DOUBLED), ((c, c), DOUBLE_KEPT)])
            else:
                places.append([((c, c), 0.0)] if twice else [((c,), 0.0), ((c, c), STRETCHED_TO_TWO)])
        elif c in LOOK_ALIKES:
            digit = c.isdigit()
            meant: Place = [((x,), LOOKS_LIKE) for x in LOOK_ALIKES[c]]
            places.append([*meant, ("", DIGIT_PARTS if digit else SIGN_PARTS), (None, LOOK_ALIKE_JOINS)])
        elif times == 1 and single(seen, i - 2, -1) and single(seen, i, 1):
            places.append([("", SPACE_PARTS), (None, SPACE_JOINS)])
        else:
            within = c in MASKS and times == 1 and 0 < i - 1 and i < n and seen[i - 2].isalnum() and seen[i].isalnum()
            places.append([("", SIGN_PARTS), (None, SIGN_JOINS), *(_ANY if within else ())])
    return places


def decoded(places: list[Place], prices: array.array) -> tuple[str, ...]:
    """The words of the cheapest way through the places; of equal ones the first found."""
    ways: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # last three symbols: price, and what was written, backwards
    for place in places:
        after: dict[int, tuple[float, tuple | None]] = {}
        for last, (price, path) in ways.items():
            for meant, cost in place:
                h, now, written = last, price + cost, path
                if meant == "":
                    if h:  # a word ends
                        now += prices[h * SYMBOLS]
                        h, written = 0, (path, " ")
                elif meant is not None:
                    for c in meant:
                        s = symbol(c)
                        now += prices[h * SYMBOLS + s]
                        h = (h * SYMBOLS + s) % SYMBOLS**3
                        written = (written, c)
                if h not in after or now < after[h][0]:
                    after[h] = (now, written)
        ways = after
    best = None
    for h, (price, path) in ways.items():
        price += prices[h * SYMBOLS] if h else 0.0
        if best is None or price < best[0]:
            best = (price, path)
    out, path = [], best[1]
    while path is not None:
        path, c = path
        out.append(c)
    return tuple("".join(reversed(out)).split())


@dataclass
class Reader:
    """Reads texts as they were meant; remembers tokens that it has read."""

    prices: array.array
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)
    both: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, prices: np.ndarray) -> Reader:
        return cls(array.array("f", prices.tobytes()))

    def token(self, seen: str) -> tuple[str, ...]:
        words = self.memo.get(seen)
        if words is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            inner = seen.strip(_EDGES)
            if inner.isalpha():
                words = decoded(lattice(inner), self.prices) if _PAIR.search(inner) else (inner,)
            elif any(map(str.isalpha, inner)):
                words = decoded(lattice(inner), self.prices)
            else:
                words = ()
            self.memo[seen] = words
        return words

    def readings(self, seen: str) -> tuple[str, ...]:
        """The words of a token; whether one letter or two were stretched, short contexts cannot tell: both count."""
        words = self.both.get(seen)
        if words is None:
            if len(self.both) >= _MEMO:
                self.both.clear()
            words = self.token(seen)
            if _STRETCHED.search(seen):
                words += decoded(lattice(seen.strip(_EDGES), True), self.prices)
            self.both[seen] = words
        return words

    def run(self, seen: str) -> tuple[str, ...]:
        return decoded(lattice(" ".join(seen.split())), self.prices) if any(map(str.isalpha, seen)) else ()

    def words(self, text: str) -> set[str]:
        """The distinct words of a text, restored."""
        text = folded(text)
        found: set[str] = set()
        for seen in set(text.split()):
            found.update(self.readings(seen))
        for m in _SPACED.finditer(text):
            found.update(self.run(m[0]))
        return found

    def restored(self, text: str) -> str:
        """The text as read: folded, words one space apart, lines kept."""
        lines = []
        for line in folded(text).split("\n"):
            out, at = [], 0
            for m in _SPACED.finditer(line):
                out += [w for seen in line[at : m.start()].split() for w in self.token(seen)]
                out += self.run(m[0])
                at = m.end()
            lines.append(" ".join(out + [w for seen in line[at:].split() for w in self.token(seen)]))
        return "\n".join(lines)


# -- the scorer

@dataclass
class Scorer:
    """Each known word or stem makes a text toxic by a chance of its own, whatever else is there; without any there is a chance left.
    Chances that it does not are kept as negative logarithms."""

    weights: dict[str, float]
    start: float
    stems: dict[str, float] = field(default_factory=dict)

    def score(self, words: set[str]) -> float:
        found = [self.weights[w] for w in self.weights.keys() & words]
        for k in {len(s) for s in self.stems}:
            found += [self.stems[s] for s in self.stems.keys() & {w[:k] for w in words}]
        return 1 - math.exp(-self.start - sum(sorted(found)))


def logistic(row: np.ndarray, column: np.ndarray, y: np.ndarray, k: int, lasso: float, ridge: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and start of the penalised logistic model on the ones at (row, column), by accelerated proximal steps."""
    n = len(y)
    forward = lambda w: np.bincount(row, w[column], n)
    v = np.ones(k)
    for _ in range(30):  # the largest singular value bounds the step
        u = np.bincount(column, forward(v)[row], k)
        size = float(np.linalg.norm(u))
        v = u / max(size, 1e-12)
    rate = 1 / (0.25 * 1.1 * (size / n + 1) + ridge)
    w, b, at_w, at_b, t = np.zeros(k), math.log(y.mean() / (1 - y.mean())), np.zeros(k), 0.0, 1.0
    at_b = b
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at_b + forward(at_w), -500, 500)))
        g = p - y
        new = at_w - rate * (np.bincount(column, g[row], k) / n + ridge * at_w)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0)
        new_b = at_b - rate * g.mean()
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        at_w, at_b = new + (last - 1) / t * (new - w), new_b + (last - 1) / t * (new_b - b)
        w, b = new, new_b
    return w, b


def families(texts: list[str]) -> list[str]:
    """Two least hashes of each text's shingles: near copies mostly agree in both."""
    hashes, counts = shingle_hashes(texts)
    out = []
    for own in np.split(hashes, np.cumsum(counts)[:-1]):
        out.append(f"{own.min()}:{mixed(own).min()}" if len(own) else "")
    return out


def stem_pairs(read: DataFrame, known: list[str], rate: float) -> pa.Table:
    """(doc_id, stem) of the texts without a known word, for stems that tell enough where a text is toxic at this rate."""
    least, most = STEMS
    bare = read.where(~F.arrays_overlap("words", F.array(*map(F.lit, known)))) if known else read
    long = F.filter("words", lambda w: F.length(w) >= least)
    stems = F.array_distinct(F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(least), F.least(F.length(w), F.lit(most))), lambda k: F.substring(w, F.lit(1), k)))))
    pairs = bare.select("doc_id", "y", F.explode(stems).alias("stem"))
    share = F.avg("y")
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    evidence = 2 * F.count("*") * (share * F.log(share / rate) + rest)
    told = pairs.groupBy("stem").agg(F.count("*").alias("n"), share.alias("share"), evidence.alias("evidence"))
    told = told.where((F.col("n") >= LEAST_TEXTS) & (F.col("share") > max(0.5, rate)) & (F.col("evidence") >= STEM_EVIDENCE)).select("stem")
    return pairs.join(told, "stem").select("doc_id", "stem").toArrow()


def chosen_stems(row: np.ndarray, column: np.ndarray, y: np.ndarray, k: int, rate: float) -> tuple[list[tuple[int, float, int]], np.ndarray]:
    """(number, toxic texts, texts) of stems one after the other, each counted over the texts that none before it is in, and which texts have one."""
    chosen, done = [], np.zeros(len(y), bool)
    while True:
        on = ~done[row]
        n, toxic = np.bincount(column[on], minlength=k), np.bincount(column[on], y[row[on]], k)
        share = np.clip(toxic / np.maximum(n, 1), 1e-12, 1 - 1e-12)
        evidence = 2 * n * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
        evidence[(n < LEAST_TEXTS) | (share <= max(0.5, rate))] = 0
        best = int(np.argmax(evidence)) if k else 0
        if not k or evidence[best] < STEM_EVIDENCE:
            return chosen, done
        chosen.append((best, float(toxic[best]), int(n[best])))
        done[row[column == best]] = True


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % 4


def train(df: DataFrame, labels: DataFrame, prices: np.ndarray, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", docs: int = TRAIN_DOCS) -> Scorer:
    """Learns from labelled rows whose fold is not 2, at most `docs` of them, chosen by a hash of their ids."""
    known = only(labels, doc_id=doc_id, y=label).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold_of() != 2))
    n, parts = known.count(), 1 << 20
    share = parts if n <= docs else max(1, int(parts * docs * 0.95 / n))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share).groupBy("doc_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("doc_id")).limit(docs)
    labelled = only(df, doc_id=doc_id, text=text).join(F.broadcast(some), "doc_id")  # at most `docs` rows
    texts = labelled.groupBy(F.xxhash64("text").alias("doc_id")).agg(F.avg("y").alias("y"), F.any_value("text").alias("text"))
    work = lambda b: [words_of(b, prices), b.column(2), families(texts_of(b))]
    read = map_texts(texts, "doc_id long, words array<string>, y double, family string", ["words", "y", "family"], work, keep=("y",), model="toxicity")
    # A family of near copies counts once: its label says little about its words, however often it is repeated.
    read = cut_lineage(read.groupBy("family").agg(F.min("doc_id").alias("doc_id"), F.avg("y").alias("y"), F.min_by("words", "doc_id").alias("words")), "words")
    rows = read.agg(F.count("*").alias("n"), F.avg("y").alias("y")).first()
    rate = rows["y"] if rows["n"] else 0.0
    if not 0 < rate < 1:
        return Scorer({}, 700.0 if rate else 0.0)
    pairs = read.select("doc_id", "y", F.explode("words").alias("word"))
    z = F.abs(F.sum("y") - F.count("*") * rate) / F.sqrt(F.count("*") * rate * (1 - rate))
    vocabulary = pairs.groupBy("word").agg(F.count("*").alias("n"), z.alias("z")).where((F.col("n") >= LEAST_TEXTS) & (F.col("z") >= LEAST_Z)).select("word")
    found = pairs.join(vocabulary, "word").select("doc_id", "word").toArrow()
    every = read.select("doc_id", "y").toArrow().sort_by("doc_id")
    words = sorted(set(found["word"].to_pylist()))
    number = {w: i for i, w in enumerate(words)}
    row = np.searchsorted(every["doc_id"].to_numpy(), found["doc_id"].to_numpy())
    column = np.fromiter((number[w] for w in found["word"].to_pylist()), np.int64, len(found))
    order = np.lexsort((column, row))
    row, column, y = row[order], column[order], every["y"].to_numpy()
    w, _ = logistic(row, column, y, len(words), LASSO, RIDGE)
    n_texts, n_toxic = np.bincount(column, minlength=len(words)), np.bincount(column, y[row], len(words))
    chosen = np.flatnonzero(w > 0)
    bare = np.bincount(row[np.isin(column, chosen)], minlength=len(y)) == 0
    chance = lambda toxic, n: -np.log1p(-(toxic + rate) / (n + 1))  # noqa: E731  one more text, as toxic as all are
    weights, stems = {words[i]: float(chance(n_toxic[i], n_texts[i])) for i in chosen.tolist()}, {}
    left = float(y[bare].mean()) if bare.any() else 0.0
    if 0 < left < 1:
        found = stem_pairs(read, sorted(weights), left)
        names = sorted(set(found["stem"].to_pylist()), key=lambda s: (-len(s), s))
        number = {s: i for i, s in enumerate(names)}
        row = np.searchsorted(every["doc_id"].to_numpy(), found["doc_id"].to_numpy())
        column = np.fromiter((number[s] for s in found["stem"].to_pylist()), np.int64, len(found))
        order = np.lexsort((column, row))
        picked, done = chosen_stems(row[order], column[order], y, len(names), left)
        stems = {names[i]: float(chance(toxic, n)) for i, toxic, n in picked}
        bare &= ~done
    return Scorer(weights, float(chance(y[bare].sum(), bare.sum())), stems)


_reader: list = []


def reader(prices: np.ndarray) -> Reader:
    """The worker's reader for these prices."""
    key = prices.tobytes()[:: 97 * 4]
    if not _reader or _reader[0] != key:
        _reader[:] = [key, Reader.of(prices)]
    return _reader[1]


def words_of(batch: pa.RecordBatch, prices: np.ndarray) -> list[list[str]]:
    r = reader(prices)
    return [sorted(r.words(t)) for t in texts_of(batch)]


def scores(df: DataFrame, prices: np.ndarray, scorer: Scorer, *, least: float = TOXIC_AT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: whether it was held out, its score, whether that reaches `least`."""

    def work(batch: pa.RecordBatch) -> list:
        r = reader(prices)
        found = [scorer.score(r.words(t)) for t in texts_of(batch)]
        return [found, [int(x >= least) for x in found]]

    out = map_texts(df, "doc_id long, score double, predicted int", ["score", "predicted"], work, doc_id=doc_id, text=text, model="toxicity")
    return out.select("doc_id", (fold_of() == 2).alias("held_out"), "score", "predicted")


def restored_texts(df: DataFrame, prices: np.ndarray, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored): every text as it is read."""
    return map_texts(df, "doc_id long, restored string", ["restored"], lambda b: [[reader(prices).restored(t) for t in texts_of(b)]], doc_id=doc_id, text=text, model="toxicity")


def without_toxic(df: DataFrame, prices: np.ndarray, scorer: Scorer, *, least: float = TOXIC_AT, text: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, that score below `least`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("toxicity")
        r = reader(prices)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(r.words(t)) < least for t in texts_of(batch, text)], pa.bool_()))

    return df.mapInArrow(work, df.schema)
