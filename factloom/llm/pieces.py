"""SentencePiece encoding and decoding (byte-pair models) in numpy.

All words of a slice lie end to end in flat symbol arrays. Each round takes every word's
smallest pair rank (a segmented minimum), merges all its leftmost non-overlapping pairs of
that rank at once, and closes the gaps; it ends when no word has a pair left. Merging at once
equals merging one by one unless a merge creates a pair that would come first itself; words
where that happens are redone one merge at a time.

Words end before a space that follows another character and around line feeds, which is exact
as long as no piece reaches over such a place; this is checked when a model is loaded.
Null and empty texts give begin and end ids only. Repeated rows each get their row.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, resident, texts_of

NONE = np.int32(2**31 - 1)
#: Words whose ids a worker remembers; the memory is emptied when full.
MEMORY_WORDS = 300_000
#: Longer words are merged one pair at a time with a heap, with the same result: a round costs the
#: whole word, and random text of a megabyte without a space has thousands of rounds.
LONG_WORD = 2_000


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1, ... for each of the runs, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class PieceModel:
    def __init__(self, path: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.size, self.bos, self.eos, self.unk = n, lib.bos_id(), lib.eos_id(), lib.unk_id()
        special = [lib.is_control(i) or lib.is_unknown(i) for i in range(n)]
        as_byte = [lib.is_byte(i) for i in range(n)]
        names = [lib.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not special[i] and not as_byte[i] and not lib.is_unused(i)]
        self.ids = {names[i]: i for i in normal}
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if as_byte[i]}
        order = np.unique(-np.array([lib.get_score(i) for i in range(n)], np.float64), return_inverse=True)[1]
        pairs = [(self.ids[a] * n + self.ids[b], i) for i in normal for k in range(1, len(names[i])) if (a := names[i][:k]) in self.ids and (b := names[i][k:]) in self.ids]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_ids = np.array([i for _, i in pairs] or [0], np.int32)
        self.pair_ranks = order[self.pair_ids].astype(np.int32)
        self.pair_of = {k: (int(r), int(i)) for k, r, i in zip(self.pair_keys, self.pair_ranks, self.pair_ids, strict=True)}
        whole = any(re.search("[^▁]▁|\n", names[i]) for i in normal)
        self.word = re.compile(r"(?s).+" if whole else r" *[^ \n]+|\n| +")
        out = [b"" if special[i] else bytes([int(names[i][1:-1], 16)]) if as_byte[i] else names[i].replace("▁", " ").encode() for i in range(n)]
        self.out_length = np.array([len(x) for x in out], np.int64)
        self.out_start = np.cumsum(self.out_length) - self.out_length
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.characters = {c: i for c, i in self.ids.items() if len(c) == 1}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    # -- one word, one merge at a time

    def merge_singly(self, symbols: list[int]) -> list[int]:
        n, size, pair_of = len(symbols), self.size, self.pair_of
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and symbols[a] >= 0 and symbols[b] >= 0 and (found := pair_of.get(symbols[a] * size + symbols[b])):
                heapq.heappush(heap, (found[0], a, b, symbols[a] * size + symbols[b], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = bytearray(n)
        while heap:
            _, a, b, key, made = heapq.heappop(heap)
            if gone[a] or gone[b] or right[a] != b or symbols[a] * size + symbols[b] != key:
                continue
            symbols[a], gone[b], right[a] = made, 1, right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    # -- many words, all at once

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((a < 0) | (b < 0), np.int64(-2), a.astype(np.int64) * self.size + b)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NONE), self.pair_ids[at]

    def merge(self, words: list[list[int]]) -> list[np.ndarray]:
        """The ids of each word, given its symbols: piece ids, or below 0 where a character has no piece."""
        done: list[np.ndarray | None] = [None] * len(words)
        number = []
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                done[k] = np.array(self.merge_singly(list(w)), np.int32)
            else:
                number.append(k)
        number = np.array(number, np.int64)
        lengths = np.array([len(words[k]) for k in number], np.int64)
        symbols = np.array([s for k in number for s in words[k]], np.int32)
        if len(symbols) == 0:
            return [np.zeros(0, np.int32) if d is None else d for d in done]
        rank, made = np.full(len(symbols), NONE, np.int32), np.zeros(len(symbols), np.int32)
        rank[:-1], made[:-1] = self.look_up(symbols[:-1], symbols[1:])
        rank[np.cumsum(lengths) - 1] = NONE
        while len(number):
            starts = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(rank, starts)
            open_ = least != NONE
            if not open_.all():
                for k, s, n in zip(number[~open_], starts[~open_], lengths[~open_], strict=True):
                    done[k] = symbols[s : s + n]
                stay = np.repeat(open_, lengths)
                symbols, rank, made = symbols[stay], rank[stay], made[stay]
                number, lengths, least = number[open_], lengths[open_], least[open_]
                if not len(number):
                    break
                starts = np.cumsum(lengths) - lengths
            of = np.repeat(np.arange(len(number)), lengths)
            at = np.flatnonzero(rank == least[of])
            fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            before = (symbols, rank, made, lengths, starts)
            symbols, rank, made = symbols.copy(), rank.copy(), made.copy()
            symbols[at] = made[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            new = np.cumsum(stay) - 1
            merged_in = of[at]
            count = np.bincount(merged_in, minlength=len(number))
            symbols, rank, made, of = symbols[stay], rank[stay], made[stay], of[stay]
            lengths = lengths - count
            here = new[at]
            touched = np.unique(np.concatenate([here, here[here > 0] - 1]))
            nxt = np.minimum(touched + 1, len(symbols) - 1)
            same = (of[touched] == of[nxt]) & (touched != nxt)
            r, m = self.look_up(symbols[touched], symbols[nxt])
            rank[touched], made[touched] = np.where(same, r, NONE), m
            early = np.zeros(len(number), bool)
            early[of[touched[rank[touched] <= least[of[touched]]]]] = True
            early &= count > 1
            if early.any():
                for k in np.flatnonzero(early):
                    s, n = before[4][k], before[3][k]
                    done[number[k]] = np.array(self.merge_singly(before[0][s : s + n].tolist()), np.int32)
                stay = ~early[of]
                symbols, rank, made = symbols[stay], rank[stay], made[stay]
                number, lengths = number[~early], lengths[~early]
        return done

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not yet known."""
        chars = self.characters
        symbols = [[chars.get(c, -1 - ord(c)) for c in w.replace(" ", "▁")] for w in words]
        out = self.merge(symbols)
        for k, ids in enumerate(out):
            if len(ids) and ids.min() < 0:
                out[k] = np.array([j for s in ids.tolist() for j in ([s] if s >= 0 else self.fallback(-1 - s))], np.int32)
        base = len(self.known)
        self.known.update((w, base + i) for i, w in enumerate(words))
        self.lengths.append(np.array([len(x) for x in out], np.int64))
        self.flat.append(np.concatenate(out) if out else np.zeros(0, np.int32))

    def fallback(self, code: int) -> list[int]:
        return [self.bytes.get(b, self.unk) for b in chr(code).encode("utf-8", "replace")] if self.bytes else [self.unk]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, begin and end ids included, and how many each text has."""
        if len(self.known) > MEMORY_WORDS:
            self.forget()
        words: list[str] = []
        counts = []
        for text in texts:
            found = self.word.findall(" " + text.replace("▁", " ")) if text else []
            counts.append(len(found))
            words += found
        known = self.known
        if missing := list(set(words).difference(known)):
            self.learn(missing)
        lengths = self.lengths[0] if len(self.lengths) == 1 else np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64)
        flat = self.flat[0] if len(self.flat) == 1 else np.concatenate(self.flat) if self.flat else np.zeros(0, np.int32)
        self.lengths, self.flat = [lengths], [flat]
        starts = np.cumsum(lengths) - lengths
        index = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        body = flat[spread(starts[index], lengths[index])] if len(index) else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(lengths[index])])
        of_text = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        total = of_text + 2
        ids = np.empty(int(total.sum()), np.int32)
        first = np.cumsum(total) - total
        inner = np.ones(len(ids), bool)
        inner[first] = inner[first + total - 1] = False
        ids[first], ids[first + total - 1], ids[inner] = self.bos, self.eos, body
        return ids, total

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids; the space that encoding puts in front is taken off."""
        lengths = self.out_length[ids]
        data = self.out_bytes[spread(self.out_start[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            x = data[a + 1 : b] if data[a : a + 1] == b" " and b > a else data[a:b]
            out.append(x)
        return out


def load(path: str) -> PieceModel:
    """A worker reads a model once and keeps what it has learned of words for later tasks."""
    return resident(("pieces", path), lambda: PieceModel(path))


def piece_digests(df: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: number of ids, hash of the ids, hash of the text decoded from them."""

    def work(batch: pa.RecordBatch) -> list:
        m = load(model)
        ids, counts = m.encode(texts_of(batch))
        raw = ids.astype("<u4").tobytes()
        ends = [0, *(np.cumsum(counts) * 4).tolist()]
        hashes = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [counts, hashes, [hashlib.sha256(x).hexdigest() for x in m.decode(ids, counts)]]

    return map_texts(df, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"], work, doc_id=doc_id, text=text, limit=2 << 20, model="pieces")


def encode_table(df: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: its ids, and the text decoded from them."""

    def work(batch: pa.RecordBatch) -> list:
        m = load(model)
        ids, counts = m.encode(texts_of(batch))
        at = np.concatenate([[0], np.cumsum(counts)])
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), [x.decode("utf-8", "replace") for x in m.decode(ids, counts)]]

    return map_texts(df, "doc_id long, ids array<int>, decoded string", ["ids", "decoded"], work, doc_id=doc_id, text=text, limit=2 << 20, model="pieces")
