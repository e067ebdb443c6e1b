"""The prefix trie of conversations, by partition refinement.

A conversation is its turns in order. Nodes are the distinct sequences of a conversation's first d turns
(role and text); the root is the empty one. All conversations start in the root's class. A round takes the
next block of turns and splits each class by them: a class's members that agree in all turns up to one
form the class of that turn's node. Blocks are one turn, one, two, four, ... up to MOST_BLOCK turns, so long
shared beginnings take few rounds. A class of one member retires: what is left of its conversation is a
unary chain that needs no further comparison, and it leaves the rounds. Only classes of two or more go on.

Sums over subtrees are folded back block by block, from the deepest: every node is the business of its smallest
member, so a member's figures at a turn are its own from that turn on, and a node's are its members'
added up. That is grouped addition: no level of the tree and no group of members is ever gathered.

What a node is called is an MD5 of its class's name and of the running sums of its turns' hashes (128 bits);
turns are told apart by the SHA-256 of role and text. A digest of a node's ending members
needs them in order; they pass one after the other through one running hash, at no cost of memory.

Turns are ordered by turn, nulls first, and equal turns by the hash of role and text; repeated rows are turns of their
own. Null roles and texts are empty. Rows with a null conv_id belong to no conversation. No rows, no nodes: not
even a root. Columns other than the four are not looked at.

A very long conversation is no single task's: its places are counted by parts of a range-partitioned sort,
and blocks bound what is looked at together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut_lineage

#: Turns in the longest block.
MOST_BLOCK = 1024
#: Turns of a unary chain that are laid out from one row at a time.
_CHAIN = 1024
_TURNS = ("conv_id", "pos", "tid", "n_chars")


def turn_id(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered_turns(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, tid, n_chars): pos counts a conversation's turns from 1."""
    c = {name: F.col(f"`{col}`") for name, col in (("conv_id", conv_id), ("turn", turn), ("role", role), ("text", text))}
    rows = df.where(c["conv_id"].isNotNull()).select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].alias("turn"), turn_id(c["role"], c["text"]).alias("tid"), F.coalesce(F.char_length(c["text"]), F.lit(0)).cast("long").alias("n_chars"))
    dealt = cut_lineage(rows.repartitionByRange("conv_id", "turn", "tid").withColumn("part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "tid"))
    return dealt.withColumn("place", place).join(before, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("before")).cast("long").alias("pos"), "tid", "n_chars")


def grafted(turns: DataFrame, *, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations c rebuilt on shared beginnings: the first h turns of c - c % every (truncated, as SQL has it), h being crc32(c) %
    heads, then c's own turns after its first h. Gives the turns, and (conv_id, length) of all conversations, turnless ones included."""
    turns = cut_lineage(turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % every
    convs = sizes.select("conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    bases = convs.where("conv_id = base").select("base", F.least("n", F.lit(heads)).alias("n_base"))
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    members = convs.join(bases, "base", "left").withColumn("head", head).withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    members = cut_lineage(members.select("conv_id", "base", "h", "head", "length"), "members")
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    lent = members.where("head > 0").select("conv_id", "base", "head").join(first, "base").where("pos <= head").select(*_TURNS)
    own = turns.join(members.select("conv_id", "h", "head"), "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("head")).select(*_TURNS)
    return lent.unionByName(own), members.select("conv_id", "length")


def block_of(pos: Column) -> Column:
    """0 for turn 1, 1 for turn 2, 2 for 3 and 4, 3 for 5 to 8, ...: blocks double up to MOST_BLOCK turns and stay so long then."""
    last = (2 * MOST_BLOCK).bit_length() - 1
    doubling = F.when(pos == 1, 0).otherwise(F.length(F.bin(pos - 1)))
    return F.when(pos <= 2 * MOST_BLOCK, doubling).otherwise(last + F.ceil((pos - 2 * MOST_BLOCK) / MOST_BLOCK)).cast("int")


def block_end(block: int) -> int:
    last = (2 * MOST_BLOCK).bit_length() - 1
    return 1 << block if block <= last else 2 * MOST_BLOCK + (block - last) * MOST_BLOCK


def named(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, cls, pos, tid, ...) of one block with the names of their nodes and of the nodes before them."""
    w = Window.partitionBy("conv_id").orderBy("pos")
    hashes = [F.xxhash64("tid", "pos"), F.xxhash64("pos", "tid", F.lit(1))]
    lanes = [lane for h in hashes for lane in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    sums = [F.sum(lane).over(w).cast("string") for lane in lanes]
    rows = rows.withColumn("node", F.unhex(F.md5(F.concat_ws(",", F.hex("cls"), F.col("pos").cast("string"), *sums).cast("binary"))))
    return rows.withColumn("parent", F.coalesce(F.lag("node").over(w), F.col("cls")))


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row a node of the trie of conversations, given by turns (conv_id, pos, tid, n_chars), pos from 1 without gaps, and members
    (conv_id, length), one for each conversation: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    root = F.unhex(F.lit(hashlib.md5(b"root").hexdigest()))
    blocked = turns.withColumn("block", block_of(F.col("pos")))
    turns = cut_lineage(blocked.repartition("block", "conv_id"), "blocks", by=["block"])
    members = cut_lineage(members, "lengths")
    top = members.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.count_if(F.col("length") == 0).alias("n_ends")).first()
    if not top["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    root_row = spark.createDataFrame([(top["n"], top["conv_id"], top["n_ends"])], "n long, conv_id long, n_ends long").select(root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("pos"), "n", "conv_id", F.lit(0).cast("long").alias("n_chars"), "n_ends")
    columns = root_row.columns
    active = members.where("length > 0").select("conv_id", root.alias("cls"), "length")
    rounds: list[tuple[DataFrame, DataFrame]] = []  # (rows of shared nodes, nodes) of each block
    block = 0
    while top["n"] > 1:
        rows = turns.where(F.col("block") == block).join(active, "conv_id")
        rows = cut_lineage(named(rows).select("conv_id", "pos", "length", "n_chars", "node", "parent"), f"rows{block}")
        nodes = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("pos").alias("pos"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min("n_chars").alias("n_chars"), F.count_if(F.col("pos") == F.col("length")).alias("n_ends"))
        nodes = cut_lineage(nodes.select(*columns), f"nodes{block}")
        alone = nodes.where("n = 1").select("conv_id", "pos")
        rounds.append((rows.join(alone, ["conv_id", "pos"], "left_anti"), nodes))
        end = block_end(block)
        active = cut_lineage(rows.where((F.col("pos") == end) & (F.col("length") > end)).join(alone.where(F.col("pos") == end), "conv_id", "left_anti").select("conv_id", F.col("node").alias("cls"), "length"), f"active{block}")
        if active.isEmpty():
            break
        block += 1
    every = reduce(DataFrame.unionByName, [nodes for _, nodes in rounds], root_row)
    shared = cut_lineage(every.where("n > 1"), "shared")
    # A retired conversation's first own node, below a shared one (or, if it is the only conversation, the root).
    retired = every.where("n = 1").groupBy("conv_id").agg(F.min(F.struct("pos", "parent")).alias("_r")).select("conv_id", "_r.pos", "_r.parent")
    retired = cut_lineage(retired.join(members, "conv_id"), "retired")
    sums = folded_back(rounds, retired, root)
    children = shared.select("parent").unionAll(retired.select("parent")).where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    ending = [rows.where("pos = length").select("node", "conv_id") for rows, _ in rounds]
    ends = end_digests(reduce(DataFrame.unionAll, ending, members.where("length = 0").select(root.alias("node"), "conv_id")))
    full = shared.join(children, "node", "left").join(sums, "node", "left").join(ends, "node", "left")
    names = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    inner = attach(full, names, ["parent"], F.col("node")).select("conv_id", F.col("pos").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), zero("n_children"), zero("n_leaves"), zero("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    return inner.unionByName(chains(attach(retired, names, ["parent"], F.col("conv_id")), none))


def chains(retired: DataFrame, none: str) -> DataFrame:
    """The nodes of retired conversations (conv_id, pos, length, parent_conv_id), from pos on."""
    spans = retired.withColumn("start", F.explode(F.sequence(F.col("pos"), F.col("length"), F.lit(_CHAIN).cast("long"))))
    each = spans.withColumn("depth", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + _CHAIN - 1, F.col("length")))))
    last = F.col("depth") == F.col("length")
    one, long = F.lit(1).cast("long"), lambda c: c.cast("long")
    above = F.when(F.col("depth") == F.col("pos"), F.col("parent_conv_id")).otherwise(F.col("conv_id"))
    return each.select("conv_id", "depth", above.alias("parent_conv_id"), one.alias("n_convs"), long(F.when(last, 0).otherwise(1)).alias("n_children"), one.alias("n_leaves"), long(F.lit(0)).alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(none)).alias("ends_sha256"))


def folded_back(rounds: list[tuple[DataFrame, DataFrame]], retired: DataFrame, root: Column) -> DataFrame:
    """(node, n_leaves, saved_tokens) of shared nodes. carry: what each conversation brings from all blocks that are done."""
    carry = retired.select("conv_id", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    found = []
    down = Window.partitionBy("conv_id").orderBy(F.col("pos").desc())
    zero = F.lit(0).cast("long")
    for i, (rows, nodes) in reversed(list(enumerate(rounds))):
        own = nodes.where("n > 1").select("conv_id", "pos", ((F.col("n") - 1) * F.col("n_chars")).alias("saves"), (F.col("n") == F.col("n_ends")).cast("long").alias("leaf"))
        here = rows.select("conv_id", "pos", "node").join(own, ["conv_id", "pos"], "left").join(carry, "conv_id", "left")
        from_here = here.select("conv_id", "node", *((F.sum(F.coalesce(x, zero)).over(down) + F.coalesce(y, zero)).alias(y) for x, y in (("leaf", "leaves"), ("saves", "saved"))))
        from_here = cut_lineage(from_here, f"fold{i}")
        found.append(from_here.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
        # Figures only grow on the way up, so a conversation's largest are those of the block's first turn.
        carry = cut_lineage(carry.unionByName(from_here.drop("node")).groupBy("conv_id").agg(F.max("leaves").alias("leaves"), F.max("saved").alias("saved")), f"carry{i}")
    # A root all of whose members are turnless is a leaf itself.
    whole = carry.agg(F.greatest(F.coalesce(F.sum("leaves"), zero), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), zero).alias("saved_tokens"))
    return reduce(DataFrame.unionByName, found, whole.select(root.alias("node"), "n_leaves", "saved_tokens"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): one hash a node over its ids in order, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running = None, None
        for batch in batches:
            nodes, digests = [], []
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != last:
                    if last is not None:
                        nodes.append(last)
                        digests.append(running.hexdigest())
                    last, running = node, hashlib.sha256(str(conv).encode())
                else:
                    running.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node binary, ends_sha256 string")


def conversation_trie(df: DataFrame, **columns: str) -> DataFrame:
    """prefix_trie of the conversations of df as they are."""
    turns = cut_lineage(ordered_turns(df, **columns), "turns")
    return prefix_trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("length")))


def grafted_trie(df: DataFrame, *, every: int = 100, heads: int = 6, **columns: str) -> DataFrame:
    """prefix_trie of the conversations of df, rebuilt on shared beginnings."""
    return prefix_trie(*grafted(ordered_turns(df, **columns), every=every, heads=heads))


def trie_sql(every: int = 100, heads: int = 6) -> str:
    """grafted_trie by whole prefixes, for DuckDB; the checksum is worked out bit by bit."""
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) for i in range(8)]), lambda c, d: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS l FROM turns GROUP BY conv_id),
        sized AS MATERIALIZED (SELECT conv_id, l, CAST({crc} % {heads} AS BIGINT) AS h FROM own),
        rebuilt AS MATERIALIZED (SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM sized a LEFT JOIN sized b ON b.conv_id = a.conv_id - a.conv_id % {every}),
        starts AS MATERIALIZED (SELECT conv_id, len(l) AS n, d, l[1:d] AS p FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM rebuilt)),
        nodes AS MATERIALIZED (SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, count(*) FILTER (n = d) AS n_ends,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM starts GROUP BY p),
        kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
        sums AS (SELECT q AS p, sum(leaf) AS n_leaves, sum(saves) AS saved_tokens FROM (SELECT p[1:d] AS q, leaf, saves FROM (SELECT p, CAST(n_ends = n_convs AS INTEGER) AS leaf,
            CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(p[depth].x) END AS saves, unnest(range(depth + 1)) AS d FROM nodes)) GROUP BY q)
        SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
        CAST(saved_tokens AS BIGINT) AS saved_tokens, nodes.ends_sha256 FROM nodes JOIN sums ON sums.p = nodes.p LEFT JOIN kids ON kids.p = nodes.p LEFT JOIN nodes up ON up.depth = nodes.depth - 1 AND up.p = nodes.p[1:nodes.depth - 1]"""
