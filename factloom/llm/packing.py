"""Packing documents into training sequences of at most 2048 tokens by non-negative least squares.

Each partition packs its own documents, in blocks of bounded size, so nothing is shuffled and a
lost task costs only its own work. A document gives whole windows and a remainder. The
remainders' length histogram is packed with shallow combinations that fill a window exactly (one
to three lengths): non-negative least squares gives how often each combination repeats, which is
rounded to the nearest number and, most frequent first, kept within what the histogram still has;
what is left is laid end to end, longest first, and cut at window ends. What a partition has left over at its end, less than a window, is cut into sequences of
power-of-two lengths, which need no padding.

Null and empty texts are their end id alone. Rows that repeat an id are packed as documents of
their own. Piece rows carry doc_id as it came, null included. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, slices, texts_of
from .pieces import spread

WINDOW = 2048
END_ID = 1
#: Tokens that a task holds before it packs them.
BLOCK_TOKENS = 8 << 20
#: Lengths of three-part combinations are multiples of this.
GRID = 64
#: Words whose ids a worker remembers; the memory is emptied when full.
MEMORY_WORDS = 500_000

# The splitting pattern of the tokenizer, and an equal one for texts of plain characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Outside these the two patterns could differ.
NOT_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")


#: Such words stay apart when they are written end to end.
EASY = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Texts of letters, single spaces, points, commas and line feeds, none of which meet in another way,
#: are parted before each space, point and comma, and around line feeds: as the pattern does it.
NOT_SIMPLE = re.compile("[^A-Za-zÀ-ÖØ-öø-ÿ ,.\n]")
CROWDED = re.compile(" [ ,.\n]|[,.][,.]|\n[ \n]")


class Numbers(dict):
    """Numbers words as they first occur, and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordTokenizer:
    """The ids of a tokenizers file, looked up by word: the library encodes each word once."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # A special token in a text is one id, as the library has it: such a string is a word of its own.
        special = list(self.library.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or t.single_word for t in special):
            raise ValueError("special tokens that depend on what is around them")
        names = sorted((t.content for t in special), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        self.split, self.plain = regex.compile(PATTERN), re.compile(PLAIN_PATTERN)
        self.spaced = np.zeros(self.library.get_vocab_size(), bool)
        self.spaced[[i for w, i in self.library.get_vocab().items() if w.startswith("Ġ")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.flat, self.lengths, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Words of a space and letters are encoded many at a time, end to end: each begins where a token begins with a space."""
        is_easy = np.fromiter((EASY.fullmatch(w) is not None for w in words), bool, len(words))
        easy = [w for w, e in zip(words, is_easy, strict=True) if e]
        other = [w for w, e in zip(words, is_easy, strict=True) if not e]
        joined = ["".join(easy[a : a + 500]) for a in range(0, len(easy), 500)]
        ids = np.array([i for e in self.library.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], np.int32)
        begins = np.flatnonzero(self.spaced[ids])
        if len(begins) != len(easy):
            raise ValueError("words and tokens are out of step")
        found = [e.ids for e in self.library.encode_batch_fast(other, add_special_tokens=False)]
        lengths, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        lengths[is_easy], lengths[~is_easy] = np.diff(begins, append=len(ids)), np.fromiter(map(len, found), np.int64, len(found))
        starts[is_easy], starts[~is_easy] = begins, len(ids) + np.cumsum(lengths[~is_easy]) - lengths[~is_easy]
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids, np.array([i for x in found for i in x], np.int32)])

    def words_of(self, text: str) -> list[str]:
        """What the tokenizer's pattern parts a text into, special tokens apart; empty strings do no harm."""
        if not (NOT_SIMPLE.search(text) or CROWDED.search(text)):
            return text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n\0").split("\0")
        split = self.split if NOT_PLAIN.search(text) else self.plain
        if self.special is None or not self.special.search(text):
            return split.findall(text)
        parts = self.special.split(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else split.findall(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each text's followed by the end id, and how many each has."""
        if len(self.known) > MEMORY_WORDS or len(self.flat) > 8 * MEMORY_WORDS:
            self.forget()
        words: list[str] = []
        counts = []
        for text in texts:
            found = self.words_of(text)
            counts.append(len(found))
            words += found
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        lengths = self.lengths[index]
        body = self.flat[spread(self.starts[index], lengths)] if len(index) else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        total = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]) + 1
        ids = np.empty(int(total.sum()), np.int32)
        inner = np.ones(len(ids), bool)
        inner[np.cumsum(total) - 1] = False
        ids[~inner], ids[inner] = END_ID, body
        return ids, total


def load(path: str) -> WordTokenizer:
    return resident(("packing", path), lambda: WordTokenizer(path))


@lru_cache(maxsize=4)
def combinations(window: int, grid: int) -> np.ndarray:
    """Rows of three lengths that add up to the window, in falling order; 0 stands for none."""
    pairs = [(window - b, b, 0) for b in range(1, window // 2 + 1)]
    triples = [(a, b, window - a - b) for a in range(grid, window, grid) for b in range(grid, min(a, window - a - 1) + 1, grid) if window - a - b <= b]
    return np.array(pairs + triples)


def repeat_counts(histogram: np.ndarray, window: int, grid: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """How often each combination repeats: argmin |A x - histogram| over x >= 0 by accelerated
    projected gradients, rounded and kept within the histogram, most frequent first."""
    combos = combinations(window, grid)
    used = combos[(histogram[combos] * (combos > 0)).min(1, where=combos > 0, initial=1 << 62) > 0]
    if not len(used):
        return used, np.zeros(0, np.int64)
    flat, mask = used.ravel(), (used > 0).ravel()
    goal = histogram.astype(float)

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3) * mask, len(goal))

    def transposed(r: np.ndarray) -> np.ndarray:
        return (r[used] * (used > 0)).sum(1)

    v = np.ones(len(used))
    for _ in range(20):
        v = transposed(apply(v))
        v /= np.linalg.norm(v)
    rate = 1 / (1.05 * max(1.0, float(v @ transposed(apply(v)))))
    x = np.zeros(len(used))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * transposed(apply(y) - goal))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    left, counts = histogram.copy(), np.zeros(len(used), np.int64)
    for k in np.argsort(-x, kind="stable"):
        lengths, times = np.unique(used[k][used[k] > 0], return_counts=True)
        n = min(int(x[k] + 0.5), *(int(left[m]) // int(c) for m, c in zip(lengths, times, strict=True)))
        counts[k] = n
        left[lengths] -= n * times
    return used, counts


class Packer:
    """Takes documents' ids, and gives pieces (document, start, length, sequence, offset) once a block is full."""

    def __init__(self, partition: int, window: int = WINDOW, grid: int = GRID) -> None:
        self.window, self.grid, self.sequence = window, grid, partition << 36
        self.rest: list[tuple[int, int, int]] = []  # pieces carried over: document, start, length

    def pack(self, lengths: np.ndarray, last: bool, carried: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, ...]]:
        """lengths: tokens of this block's documents. carried: pieces left by the block before, which come first."""
        w, out = self.window, []
        whole = lengths // w
        document = np.repeat(np.arange(len(lengths)), whole)
        start = spread(np.zeros(len(lengths), np.int64), whole) * w
        out.append((document, start, np.full(len(document), w), self._new(len(document)), np.zeros(len(document), np.int64)))
        rest = lengths - whole * w
        order = np.argsort(rest, kind="stable")
        order = order[rest[order] > 0]
        histogram = np.bincount(rest[order], minlength=w + 1)
        first = np.cumsum(histogram) - histogram
        combos, counts = repeat_counts(histogram, w, self.grid)
        for combo, n in zip(combos[counts > 0].tolist(), counts[counts > 0].tolist(), strict=True):
            sequence, offset = self._new(n), 0
            for m in combo:
                if m:
                    d = order[first[m] : first[m] + n]
                    first[m] += n
                    out.append((d, whole[d] * w, np.full(n, m), sequence, np.full(n, offset)))
                    offset += m
        ends = np.cumsum(histogram)
        left = np.concatenate([order[a:b] for a, b in zip(first[::-1], ends[::-1], strict=True) if a < b] or [order[:0]])
        d = np.concatenate([np.array([p[0] for p in carried], np.int64), left])
        s = np.concatenate([np.array([p[1] for p in carried], np.int64), whole[left] * w])
        n = np.concatenate([np.array([p[2] for p in carried], np.int64), rest[left]])
        total = int(n.sum())
        cuts = np.arange(0, total + 1, w)
        tail = total - int(cuts[-1])
        if last and tail:
            bits = [1 << b for b in range(w.bit_length() - 1, -1, -1) if tail >> b & 1]
            cuts = np.concatenate([cuts, cuts[-1] + np.cumsum(bits)])
        begin = np.cumsum(n) - n
        marks = np.unique(np.concatenate([begin, cuts]))
        marks = np.append(marks[marks < total], total)
        a, size = marks[:-1], np.diff(marks)
        of = np.searchsorted(begin, a, side="right") - 1
        slot = np.searchsorted(cuts, a, side="right") - 1
        d, s, offset = d[of], s[of] + a - begin[of], a - cuts[slot]
        kept = slot < len(cuts) - 1
        sequence = self._new(len(cuts) - 1)
        out.append((d[kept], s[kept], size[kept], sequence[slot[kept]], offset[kept]))
        self.rest = list(zip(d[~kept].tolist(), s[~kept].tolist(), size[~kept].tolist(), strict=True))
        return out

    def _new(self, n: int) -> np.ndarray:
        self.sequence += n
        return np.arange(self.sequence - n, self.sequence)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(df: DataFrame, tokenizer: str, *, window: int = WINDOW, grid: int = GRID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece; with_ids adds the piece's ids."""
    ddl = PIECES + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId(), window, grid)
        names: list = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        before: list[np.ndarray] = []  # ids of pieces carried over

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            # Documents that a carried piece belongs to come first, so that pieces name a place in this block's lists.
            carried = [(i, p[1], p[2]) for i, p in enumerate(packer.rest)]
            shift = len(carried)
            own = [names_before[i] for i in range(shift)] + names
            tokens = np.array(totals_before + sizes, np.int64)
            parts = packer.pack(np.array([0] * shift + sizes, np.int64), last, carried)
            d, s, n, q, o = (np.concatenate(x) for x in zip(*parts, strict=True))
            starts_before = [c[1] for c in carried]
            ids = [(before[i][a - starts_before[i] :][:m] if i < shift else held[i - shift][a : a + m]) for i, a, m in zip(d.tolist(), s.tolist(), n.tolist(), strict=True)]
            crc = [zlib.crc32(x.astype("<u4")) for x in ids]
            columns = [pa.array([own[i] for i in d.tolist()], pa.int64()), pa.array(s), pa.array(n), pa.array(crc, pa.int64()), pa.array(tokens[d] if len(d) else d, pa.int64()), pa.array(q), pa.array(o)]
            labels = PIECES_NAMES
            if with_ids:
                at = np.concatenate([[0], np.cumsum(n)])
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32))))
                labels = [*labels, "ids"]
            rest = packer.rest
            keep = [(own[i], int(tokens[i]), (before[i][a - starts_before[i] :][:m] if i < shift else held[i - shift][a : a + m]).copy()) for i, a, m in rest]
            names_before[:] = [k[0] for k in keep]
            totals_before[:] = [k[1] for k in keep]
            before[:] = [k[2] for k in keep]
            names.clear(), held.clear(), sizes.clear()
            for a in range(0, len(d), 20_000):
                yield pa.RecordBatch.from_arrays([c.slice(a, 20_000) for c in columns], names=labels)

        names_before: list = []
        totals_before: list[int] = []
        waiting = 0
        for part in slices(batches, keep="packing"):
            tokenizer_ = load(tokenizer)
            ids, counts = tokenizer_.encode(texts_of(part))
            ids = ids.astype(np.uint16 if tokenizer_.library.get_vocab_size() <= 1 << 16 else np.int32)
            ends = np.cumsum(counts)
            names += part.column(0).to_pylist()
            held += [ids[b - n : b] for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            sizes += counts.tolist()
            waiting += len(ids)
            if waiting >= BLOCK_TOKENS:
                yield from flush(False)
                waiting = 0
        yield from flush(True)

    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, ddl)


PIECES_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
