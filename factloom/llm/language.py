"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time, on the driver, from a bounded
sample: at most TRAIN_DOCS labelled documents of a language, from each at most TRAIN_PIECES
pieces of STEPS bytes spread over its text. It labels every byte of a text; a document's
probabilities are the means over the bytes of its letters.

All bytes of a text are read, in both directions. The state is carried through the text, in spans of SPAN bytes for long ones;
a span is entered RUN_IN bytes early from either side, so no byte is labelled by a state that has only just begun. Null
texts and texts without a letter are "und" with score 0. Repeated rows each get their row. If
nothing is labelled, everything is "und".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, only, slices, texts_of, utf8_of

STEPS = 64
#: Bytes of a text through which the network's state is carried, and bytes read before they are labelled.
SPAN, RUN_IN = 2048, 64
HIDDEN = 8
TRAIN_DOCS = 300
TRAIN_PIECES = 6
#: The network has a label for at most so many languages, the most frequent ones: with TRAIN_DOCS it bounds the sample that is fitted.
MOST_LANGUAGES = 500
EPOCHS = 5
BATCH = 96
#: Small samples are gone through more often.
LEAST_STEPS = 250
#: Bytes that are stepped through together, whose states are held at once.
TOGETHER = 1 << 20
UNKNOWN = "und"
#: A document goes if its best language has less than this mean probability.
REJECT_BELOW = 0.4

_LATIN = re.compile("[A-Za-z]")
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[65:91] = _LETTER_BYTE[97:123] = _LETTER_BYTE[128:] = True


def has_letter(text: str) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


def pieces(data: bytes) -> np.ndarray:
    """The bytes as rows of STEPS, the last filled up with zeros."""
    n = -(-len(data) // STEPS)
    out = np.zeros(n * STEPS, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, STEPS)


@dataclass
class Network:
    """table: what each byte adds to the gates, per direction; inner: recurrent weights; out, bias: the labels."""

    languages: list[str]
    table: np.ndarray  # 2, 256, 3 * hidden: reset, update, candidate
    inner: np.ndarray  # 2, hidden, 3 * hidden
    out: np.ndarray  # 2 * hidden, languages
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.25).astype(np.float32)
        return cls(languages, draw(2, 256, 3 * hidden), draw(2, hidden, 3 * hidden), draw(2 * hidden, len(languages)), np.zeros(len(languages), np.float32))

    def states(self, x: np.ndarray, memory: list | None = None) -> np.ndarray:
        """Hidden states (step, piece, 2 * hidden) for bytes x (step, piece)."""
        steps, n = x.shape
        h = self.inner.shape[1]
        all_ = np.empty((steps, n, 2 * h), np.float32)
        for way in (0, 1):
            state = np.zeros((n, h), np.float32)
            table, inner = self.table[way], self.inner[way]
            gates_in, cand_in = np.ascontiguousarray(inner[:, : 2 * h]), np.ascontiguousarray(inner[:, 2 * h :])
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                a = table[x[t]]
                g = state @ gates_in
                g += a[:, : 2 * h]
                g *= 0.5
                np.tanh(g, g)
                g += 1
                g *= 0.5
                r, z = g[:, :h], g[:, h:]
                c = (r * state) @ cand_in
                c += a[:, 2 * h :]
                np.tanh(c, c)
                new = state - c
                new *= z
                new += c
                if memory is not None:
                    memory.append((way, t, state, g, c))
                state = new
                all_[t, :, way * h : (way + 1) * h] = state
        return all_

    def ragged_states(self, x: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Hidden states (byte, 2 * hidden) for texts of different lengths, the longest first: x has step for step the bytes of the
        texts that are that long, and active how many those are."""
        h, first = self.inner.shape[1], np.cumsum(active) - active
        out = np.empty((len(x), 2 * h), np.float32)
        for way in (0, 1):
            state = np.zeros((int(active[0]), h), np.float32)
            table, inner = self.table[way], self.inner[way]
            gates_in, cand_in = np.ascontiguousarray(inner[:, : 2 * h]), np.ascontiguousarray(inner[:, 2 * h :])
            for t in range(len(active)) if way == 0 else range(len(active) - 1, -1, -1):
                m = int(active[t])
                at = slice(int(first[t]), int(first[t]) + m)
                a, s = table[x[at]], state[:m]
                g = s @ gates_in
                g += a[:, : 2 * h]
                g *= 0.5
                np.tanh(g, g)
                g += 1
                g *= 0.5
                c = (g[:, :h] * s) @ cand_in
                c += a[:, 2 * h :]
                np.tanh(c, c)
                s -= c  # in place: a text's state goes on at its next step
                s *= g[:, h:]
                s += c
                out[at, way * h : (way + 1) * h] = s
        return out

    def labels(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.out
        logits += self.bias
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over labelled bytes, back through all steps."""
        memory: list = []
        states = self.states(x, memory)
        d = self.labels(states)
        np.put_along_axis(d, y[None, :, None], np.take_along_axis(d, y[None, :, None], 2) - 1, 2)
        d *= (weight / max(1.0, weight.sum()))[:, :, None]
        h = self.inner.shape[1]
        flat = states.reshape(-1, 2 * h)
        g_out, g_bias = flat.T @ d.reshape(-1, d.shape[2]), d.sum((0, 1))
        back = d @ self.out.T
        g_table, g_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        carry = {0: np.zeros((x.shape[1], h), np.float32), 1: np.zeros((x.shape[1], h), np.float32)}
        for way, t, state, g, c in reversed(memory):
            r, z = g[:, :h], g[:, h:]
            dh = carry[way] + back[t, :, way * h : (way + 1) * h]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (state - c) * z * (1 - z)
            through = dc @ self.inner[way][:, 2 * h :].T
            dr = through * state * r * (1 - r)
            da = np.concatenate([dr, dz, dc], 1)
            np.add.at(g_table[way], x[t], da)
            g_inner[way][:, : 2 * h] += state.T @ da[:, : 2 * h]
            g_inner[way][:, 2 * h :] += (r * state).T @ dc
            carry[way] = dh * z + through * r + da[:, : 2 * h] @ self.inner[way][:, : 2 * h].T
        return [g_table, g_inner, g_out, g_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 7) -> None:
        """x: pieces (piece, step); y: their languages. Adam on shuffled batches."""
        rng = np.random.default_rng(seed)
        values = [self.table, self.inner, self.out, self.bias]
        first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        epochs = max(epochs, -(-LEAST_STEPS // max(1, -(-len(x) // BATCH))))
        step, total = 0, epochs * -(-len(x) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), BATCH):
                rows = order[a : a + BATCH]
                xs = np.ascontiguousarray(x[rows].T)
                grads = self.gradients(xs, y[rows], _LETTER_BYTE[xs].astype(np.float32))
                norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for v, g, m, s in zip(values, grads, first, second, strict=True):
                    g *= min(1.0, 1 / (norm + 1e-8))
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over each text's letter bytes; a row of zeros where there are none."""
        k = len(self.languages)
        out, count = np.zeros((len(texts), k)), np.zeros(len(texts))
        spans = [(i, *s) for i, t in enumerate(texts) for s in spans_of(len(t))] if k else []
        spans.sort(key=lambda s: s[1] - s[2])  # the longest first
        while spans:
            size, n = 0, 0
            while n < len(spans) and (not n or size + spans[n][2] - spans[n][1] <= TOGETHER):
                size += spans[n][2] - spans[n][1]
                n += 1
            self._add_labels(texts, spans[:n], out, count)
            spans = spans[n:]
        return out / np.maximum(count, 1)[:, None]

    def _add_labels(self, texts: list[bytes], spans: list[tuple[int, int, int, int, int]], out: np.ndarray, count: np.ndarray) -> None:
        lengths = np.array([b - a for _, a, b, _, _ in spans])
        padded = np.zeros((len(spans), lengths[0]), np.uint8)
        counted = np.zeros(padded.shape, bool)
        for row, (i, a, b, from_, to) in enumerate(spans):
            padded[row, : b - a] = np.frombuffer(texts[i], np.uint8, b - a, a)
            counted[row, from_ - a : to - a] = True
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        there = np.arange(len(spans))[None] < active[:, None]  # (step, span)
        x = padded.T[there]
        letter = _LETTER_BYTE[x] & counted.T[there]
        owner = np.broadcast_to(np.array([s[0] for s in spans])[None], there.shape)[there][letter]
        p = self.labels(self.ragged_states(x, active)[letter])
        count += np.bincount(owner, minlength=len(count))
        for j in range(p.shape[1]):
            out[:, j] += np.bincount(owner, p[:, j], len(out))


def spans_of(n: int) -> list[tuple[int, int, int, int]]:
    """(read from, read to, label from, label to) of a text of n bytes."""
    return [(max(0, a - RUN_IN), min(n, a + SPAN + RUN_IN), a, min(n, a + SPAN)) for a in range(0, n, SPAN)]


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % 5


def train(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = TRAIN_DOCS, most_languages: int = MOST_LANGUAGES) -> Network:
    """Learns from rows with text and language whose fold is not 0."""
    known = only(df, doc_id=doc_id, text=text, lang=lang).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of() != 0))
    counts = known.groupBy("lang").count()
    sizes = {r["lang"]: r["count"] for r in counts.orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    languages = sorted(sizes)
    parts = 1 << 24
    spark = df.sparkSession
    shares = spark.createDataFrame([(name, int(parts * min(1.0, 1.3 * docs / n))) for name, n in sizes.items()], "lang string, share long")  # at most most_languages rows
    number = F.xxhash64("doc_id", "lang", "text")
    drawn = known.join(F.broadcast(shares), "lang").withColumn("number", number).where(F.pmod("number", F.lit(parts)) < F.col("share"))
    # Equal rows count once, and a language's documents are cut to their number before they move.
    once = drawn.groupBy("lang", "number").agg(F.min("doc_id").alias("doc_id"), F.any_value("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("number"))
    chosen = once.withColumn("place", place).where(F.col("place") <= docs).select("doc_id", "text", "lang")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, names, kept = [], [], []
            for i, data, name in zip(part.column(0).to_pylist(), utf8_of(part), part.column(2).to_pylist(), strict=True):
                if has_letter(data.decode("utf-8", "replace")):
                    all_ = pieces(data)
                    ids.append(i)
                    names.append(name)
                    kept.append(all_[np.unique(np.linspace(0, len(all_) - 1, TRAIN_PIECES).astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "lang", "pieces"])

    rows = chosen.mapInArrow(work, "doc_id long, lang string, pieces binary").collect()
    by_language: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["pieces"]))):
        by_language.setdefault(r["lang"], []).append(r)
    x, y = [np.zeros((0, STEPS), np.uint8)], []
    for k, name in enumerate(languages):
        for r in by_language.get(name, ()):
            found = np.frombuffer(bytes(r["pieces"]), np.uint8).reshape(-1, STEPS)
            x.append(found)
            y += [k] * len(found)
    network = Network.fresh(languages)
    network.fit(np.concatenate(x), np.array(y, np.int64))
    return network


def judge(network: Network, batch: pa.RecordBatch) -> tuple[list[str], list[float]]:
    p = network.documents(utf8_of(batch))
    letters = [has_letter(t) for t in texts_of(batch)]
    best = p.argmax(1) if p.shape[1] else np.zeros(len(p), int)
    names = [network.languages[k] if ok and network.languages else UNKNOWN for k, ok in zip(best.tolist(), letters, strict=True)]
    score = [min(1.0, float(p[i, k])) if ok and network.languages else 0.0 for i, (k, ok) in enumerate(zip(best.tolist(), letters, strict=True))]
    return names, score


def predict(df: DataFrame, network: Network, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: its language and the mean probability of it."""
    out = map_texts(df, "doc_id long, lang_pred string, score double", ["lang_pred", "score"], lambda batch: list(judge(network, batch)), doc_id=doc_id, text=text)
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, network: Network, *, text: str = "text", least: float = REJECT_BELOW) -> DataFrame:
    """The rows of df, all columns as they are, whose language the network is sure enough of."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=text):
            column = part.schema.get_field_index(text)
            names, score = judge(network, pa.RecordBatch.from_arrays([part.column(column)], names=["text"]))
            yield part.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, score, strict=True)]))

    return df.mapInArrow(work, df.schema)
