"""Line deduplication by winnowing over line hashes.

A window is a shortest stretch of lines of at least LEAST_WORDS words: one from each line on, and
one up to each line. Its smallest line hash is a fingerprint, so that equal runs of that many words are guaranteed to
share one. Windows around fingerprints that occur once are dropped; the others' positions are
joined on the window's whole content, and a match is extended both ways by the windows before
and after it: the union of matching windows is the longest common run. Each run stays where it
occurs first, by id and place, and is deleted everywhere else. In one document, a repeat must
lie behind the first run, so that periodic text keeps one full run.

Lines are what line feeds part; blank lines do not count but go with the run around them. Null
and empty texts have no lines. Rows with equal id and text are one document and get the same
result. A null id sorts before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, pa_schema, row_key, slices, texts_of

LEAST_WORDS = 50


def lines_of(text: str) -> list[tuple[int, str]]:
    """(line number, line) of each line that is not blank."""
    return [(i, x) for i, x in enumerate(text.split("\n")) if x and not x.isspace()]


def windows(text: str, least: int = LEAST_WORDS) -> tuple[list[tuple[bytes, int, int, int]], list[int]]:
    """(hash of the content, fingerprint, first line, last line) of each window, where lines count
    without blank ones; and the fingerprints, one for each line that is one."""
    lines = [x for _, x in lines_of(text)]
    sizes = [len(x.split()) for x in lines]
    names = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines]
    spans, end, total = set(), 0, 0
    for start in range(len(lines)):
        while end < len(lines) and total < least:
            total += sizes[end]
            end += 1
        if total < least:
            break
        spans.add((start, end))
        total -= sizes[start]
    start = total = 0
    for end in range(1, len(lines) + 1):
        total += sizes[end - 1]
        while total - sizes[start] >= least:
            total -= sizes[start]
            start += 1
        if total >= least:
            spans.add((start, end))
    found, places = [], set()
    for a, b in sorted(spans):
        place = min(range(a, b), key=names.__getitem__)
        places.add(place)
        found.append((xxhash.xxh3_128_digest("\n".join(lines[a:b])), names[place], a, b - 1))
    return found, [names[i] for i in places]


def without(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the runs (by first and last line that is not blank), lines removed, and runs after joining."""
    number = [i for i, _ in lines_of(text)]
    gone: set[int] = set()
    removed = joined = 0
    last = -1
    for a, b in sorted(runs):
        if a > last + 1 or last < 0:
            joined += 1
            from_ = number[a]
        else:
            from_ = number[last]
        if b > last:
            gone.update(range(from_, number[b] + 1))
            removed += b - max(a, last + 1) + 1
            last = b
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), removed, joined


def repeated_runs(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(_id, _h, runs): for each document with repeated runs the windows to delete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [windows(t, least) for t in texts_of(part)]
            rows = [[dict(zip(("hash", "mark", "first", "last"), w, strict=True)) for w in f[0]] for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array(rows, kind)], names=["_id", "_h", "marks", "windows"])

    ddl = "_id long, _h long, marks array<long>, windows array<struct<hash: binary, mark: long, first: int, last: int>>"
    kind = pa_schema(df.sparkSession, ddl).field("windows").type
    held = df.select(*row_key(doc_id, text), F.col(f"`{text}`").alias("text")).mapInArrow(run, ddl)
    held = cut_lineage(held.where(F.size("windows") > 0), "windows")
    # Counts and minima are aggregated before they are shuffled and written down, so that the joins
    # have two plain shuffles, of which the adaptive engine splits a hot key's part.
    marks = held.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    shared = cut_lineage(held.select("_id", "_h", F.inline("windows")).join(cut_lineage(marks, "marks").hint("merge"), "mark"), "shared")
    firsts = shared.groupBy("hash").agg(F.min(F.struct("_id", "_h", "first", "last")).alias("head"), F.count("*").alias("n")).where("n > 1").select("hash", "head")
    met = shared.select("hash", "_id", "_h", "first", "last").join(cut_lineage(firsts, "firsts").hint("merge"), "hash")
    same: Column = (F.col("head._id") == F.col("_id")) & (F.col("head._h") == F.col("_h"))
    later = met.where(~same | (F.col("first") > F.col("head.last")))
    return later.groupBy("_id", "_h").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def rewritten(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """df with repeated runs deleted from its text; adds the columns counts_of(df): lines, lines removed, and in how many runs."""
    id_, hash_, extra_ = fresh(df.columns, "_id", "_h", "_runs")
    names, stats_ = df.columns, counts_of(df)
    tagged = df.withColumns(dict(zip((id_, hash_), row_key(doc_id, text), strict=True)))
    runs = repeated_runs(df, doc_id=doc_id, text=text, least=least).select(F.col("_id").alias(id_), F.col("_h").alias(hash_), F.col("runs").alias(extra_))
    # Written down first, so that equal rows, which share a key, can be split by the adaptive engine; by shuffles at any size, as
    # the runs grow with the table: a small table costs its share of what a large one does.
    joined = tagged.join(cut_lineage(runs, "runs").hint("merge"), [id_, hash_], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=text):
            at, extra = part.schema.get_field_index(text), part.schema.get_field_index(extra_)
            new, stats = [], []
            for x, found in zip(part.column(at).to_pylist(), part.column(extra).to_pylist(), strict=True):
                n = len(lines_of(x or ""))
                if found:
                    x, removed, count = without(x, [(r["first"], r["last"]) for r in found])
                    stats.append((n, removed, count))
                else:
                    stats.append((n, 0, 0))
                new.append(x)
            columns = [pa.array(new, part.column(at).type) if i == at else part.column(i) for i in range(len(part.schema)) if i != extra]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in zip(*stats, strict=True))], names=[*(f.name for i, f in enumerate(part.schema) if i != extra), *stats_])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in stats_)])
    return joined.select(*[F.col(f"`{c}`") for c in names], extra_).mapInArrow(run, schema)


def line_dedup(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """The rows of df, all columns as they are but for the text, which lacks its repeated runs."""
    return rewritten(df, doc_id=doc_id, text=text, least=least).select(*[F.col(f"`{c}`") for c in df.columns])


def counts_of(df: DataFrame) -> list[str]:
    return fresh(df.columns, "n_lines", "n_removed", "n_runs")


def line_digests(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """One row for each row of df: its lines, how many were removed in how many runs, and a hash of what is left."""
    out = rewritten(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), least=least)
    return out.select("doc_id", "n_lines", F.col("n_removed").alias("n_removed_lines"), "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str]], least: int = LEAST_WORDS) -> dict[int, str]:
    """What line_dedup leaves, by looking at every run of every document; for tests on small tables with unique ids."""
    first: dict[str, tuple] = {}
    every = []
    for i, text in sorted(rows):
        lines = [x for _, x in lines_of(text or "")]
        sizes = [len(x.split()) for x in lines]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(sizes[a : b + 1]) >= least:
                    content = "\n".join(lines[a : b + 1])
                    first.setdefault(content, (i, a, b))
                    every.append((content, i, a, b))
    cut: dict[int, list] = {}
    for content, i, a, b in every:
        j, _, d = first[content]
        if j != i or a > d:
            cut.setdefault(i, []).append((a, b))
    return {i: without(text, cut[i])[0] if i in cut else text for i, text in rows}


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
