"""Secret scans in DataFrame functions only.

Base spans are found by regular expressions; a match's place comes from the lengths of the
pieces between matches. The values found, and tokens with well-known prefixes, are candidates:
their hashes are counted over the corpus by distinct repositories and owners. A candidate that
looks live, that few owners hold and that stands in few repositories is a credential of its owner
(kind "live"); one that many hold was copied around and is an example. The counts are taken from
pre-aggregated (hash, owner, repository) rows, and joined back salted, so that no value's rows
meet in a task; equal rows are spread over tasks in the same way.

Null and empty texts have no spans; a null owner or repository counts as one of its own; rows
with the same id and text share their spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, cut_lineage, fresh, row_key

#: A value that more owners hold, or that stands in more repositories, is an example, not a secret:
#: widely copied within one owner is copied all the same.
MOST_OWNERS = 2
MOST_REPOSITORIES = 3
LEAST_LENGTH = 16
LEAST_DISTINCT = 8

# The patterns of the base kinds and of tokens with known prefixes.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
PREFIXED = r"(?:gh[opsu]_|glpat-|sk_live_|rk_live_|xox[abpr]-|AIza|eyJ)[A-Za-z0-9_.-]{16,}"
PLACEHOLDER = r"(?i)example|placeholder|changeme|change_me|your[_-]|dummy|sample|xxxx|0000000|1234567|abcdef"

KINDS = ("assign", "access", "hex", "live")
_SPAN = "struct<kind:int,start:int,stop:int,value:string>"


#: Matches that are added up together.
_STEP = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def sums_before(lengths: Column) -> Column:
    """For each stretch of _STEP numbers the sum of all before it. Only these few sums are appended one by one."""
    n = F.size(lengths)
    stretches = F.transform(F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / _STEP).cast("int"))).otherwise(F.array().cast("array<int>")), lambda b: F.aggregate(F.slice(lengths, b * _STEP + 1, _STEP), F.lit(0), lambda x, y: x + y))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(stretches, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches as an array of spans. The pieces between them, from split(), give the places."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    found = F.struct(pieces.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def spans(x: Column) -> Column:
        hits = F.zip_with(F.slice(x["gaps"], 1, F.size(x["hits"])), x["hits"], lambda g, h: F.struct(g.alias("gap"), h.alias("hit"), (g + F.char_length(h)).alias("n")))
        return let(hits, lambda hs: let(F.transform(hs, lambda h: h["n"]), lambda ns: let(sums_before(ns), lambda bases: F.transform(hs, lambda h, i: span(h, i, ns, bases)))))

    def span(h: Column, i: Column, ns: Column, bases: Column) -> Column:
        stretch = F.floor(i / _STEP).cast("int")
        inside = F.aggregate(F.slice(ns, stretch * _STEP + 1, F.pmod(i, F.lit(_STEP))), F.lit(0), lambda a, b: a + b)
        start = F.element_at(bases, stretch + 1) + inside + h["gap"]
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start - h["gap"] + h["n"]).alias("stop"), h["hit"].alias("value"))

    return let(found, spans)


def none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, 0), lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    access = F.filter(matches(text, ACCESS, 1), lambda s: F.char_length(s["value"]) >= 20)
    return F.concat(
        F.when(text.rlike("[:=]") & text.rlike(ASSIGN_HINT), assign).otherwise(none()),
        F.when(F.contains(text, F.lit("AKIA")), access).otherwise(none()),
        F.when(text.rlike("[0-9a-f]{24}"), matches(text, HEX, 2)).otherwise(none()),
    )


def candidates(base: Column, text: Column) -> Column:
    """The values of the base spans (for an assignment, what is assigned), and tokens with known prefixes."""

    def value(s: Column) -> Column:
        own = F.when(s["kind"] == 0, F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"])
        return F.struct(F.lit(3).alias("kind"), (s["stop"] - F.char_length(own)).cast("int").alias("start"), s["stop"].alias("stop"), own.alias("value"))

    prefixed = F.when(text.rlike(PREFIXED), matches(text, PREFIXED, 3)).otherwise(none())
    return F.array_distinct(F.concat(F.transform(base, value), prefixed))


def looks_live(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.array_remove(F.split(value, ""), "")))
    return (F.char_length(value) >= LEAST_LENGTH) & (distinct >= LEAST_DISTINCT) & ~value.rlike(PLACEHOLDER)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["stop"])))
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["stop"])), ",")


def secret_scan(df: DataFrame, *, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """One row for each row of df: base counts and digest, all spans, and how many candidates are live or examples.

    Columns _id and _h tell rows apart for joins; live_spans holds the places of live values.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    scanned = df.select(*row_key(doc_id, text), F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(owner, F.lit("")).alias("_owner"), F.coalesce(repository, F.lit("")).alias("_repo"), whole.alias("_text"), base_spans(whole).alias("_base"))
    scanned = scanned.withColumn("_found", F.when((F.size("_base") > 0) | F.col("_text").rlike(PREFIXED), candidates(F.col("_base"), F.col("_text"))).otherwise(none()))

    def of_kind(k: int):
        return lambda s: s["kind"] == k

    count = [F.size(F.filter("_base", of_kind(k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS[:3])]
    rows = cut_lineage(scanned.select("_id", "_h", "doc_id", "_owner", "_repo", *count, F.transform("_base", lambda s: F.struct(s["kind"], s["start"], s["stop"])).alias("_base"), F.transform("_found", lambda s: F.struct(s["start"], s["stop"], F.sha2(s["value"], 256).alias("hash"), looks_live(s["value"]).alias("live"))).alias("_found")), "secrets")
    each = rows.where(F.size("_found") > 0).select("_id", "_h", "_owner", "_repo", F.inline("_found"))
    owners = each.groupBy("hash", "_owner", "_repo").agg(F.lit(1).alias("one")).groupBy("hash", "_owner").agg(F.count("one").alias("repos"))
    stats = owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repositories"))
    judged = attach(each, stats, ["hash"], F.struct("_id", "_h"))
    is_live = F.col("live") & (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    per_row = judged.where(is_live).groupBy("_id", "_h").agg(F.collect_set(F.struct(F.lit(3).alias("kind"), "start", "stop")).alias("live_spans"))
    # Rows without candidates have nothing to look up. Written down first, so that equal rows, which share a key, can be split by the adaptive engine.
    without, with_ = rows.where(F.size("_found") == 0), rows.where(F.size("_found") > 0)
    out = with_.join(cut_lineage(per_row, "live"), ["_id", "_h"], "left").unionByName(without, allowMissingColumns=True)
    live = F.coalesce(F.col("live_spans"), F.array().cast("array<struct<kind:int,start:int,stop:int>>"))
    return out.select(
        "_id", "_h", "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
        joined(F.concat("_base", live)).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        (F.size("_found") - F.size(live)).cast("long").alias("n_example"),
        live.alias("live_spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with the characters of each span replaced by "<secret>"; spans that overlap count as one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.struct(acc["at"].alias("start"), s["start"].alias("stop"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.array_append(acc["out"], gap)).alias("out"))

    kept = F.aggregate(ordered, first, step, lambda acc: F.array_append(acc["out"], F.struct(acc["at"].alias("start"), F.char_length(text).alias("stop"))))
    return F.array_join(F.transform(kept, lambda g: F.substring(text, g["start"] + 1, g["stop"] - g["start"])), "<secret>")


def mask_live(df: DataFrame, *, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, all columns as they are but for the text, in which live credentials are masked."""
    id_, hash_, spans = fresh(df.columns, "_id", "_h", "_spans")
    found = secret_scan(df, owner=owner, repository=repository, doc_id=doc_id, text=text).where("n_live > 0")
    found = found.groupBy(F.col("_id").alias(id_), F.col("_h").alias(hash_)).agg(F.any_value("live_spans").alias(spans))
    keys = row_key(doc_id, text)
    joined = df.withColumns({id_: keys[0], hash_: keys[1]}).join(cut_lineage(found, "masks"), [id_, hash_], "left")
    new = F.when(F.col(spans).isNull(), F.col(f"`{text}`")).otherwise(masked(F.col(f"`{text}`"), F.col(spans)))
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def _sql_spans(kind: str, pattern: str, name: str) -> str:
    """A list of (kind, start, stop, value) for a pattern, from its matches m_<name> and the pieces between them g_<name>."""
    before = f"coalesce(list_sum(list_transform(g_{name}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m_{name}[1:i - 1], lambda x: length(x))), 0)"
    return f"list_transform(range(1, len(m_{name}) + 1), lambda i: {{'kind': {kind}, 'start': CAST({before} AS BIGINT), 'stop': CAST({before} + length(m_{name}[i]) AS BIGINT), 'value': m_{name}[i]}})"


def scan_sql() -> str:
    """secret_scan() of documents as DuckDB SQL: a source is an owner, its documents in one language are a repository."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    patterns = {"a": ASSIGN, "k": ACCESS, "h": HEX, "p": PREFIXED}
    found = ", ".join(f"regexp_extract_all(t, {quoted(p)}, 0) AS m_{n}, string_split_regex(t, {quoted(p)}) AS g_{n}" for n, p in patterns.items())
    group = f"regexp_extract(x.value, {quoted(ASSIGN)}, 2)"
    spans = ", ".join(f"{_sql_spans(k, p, n)} AS s_{n}" for (n, p), k in zip(patterns.items(), "0123", strict=True))
    text_of = lambda rows: f"coalesce(string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind){rows}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, owner, repo, {found} FROM d),
s AS (SELECT doc_id, owner, repo, {spans} FROM m),
base AS (SELECT doc_id, owner, repo, list_concat(list_filter(s_a, lambda x: length({group}) >= 6), list_filter(s_k, lambda x: length(x.value) >= 20), s_h) AS b, s_p FROM s),
rows_ AS (SELECT doc_id, owner, repo, unnest(b, recursive := true) FROM base),
cand AS (SELECT DISTINCT doc_id, owner, repo, 3 AS kind, stop - length(v) AS start, stop, v FROM (SELECT doc_id, owner, repo, stop, CASE WHEN kind = 0 THEN regexp_extract(value, {quoted(ASSIGN)}, 2) ELSE value END AS v FROM rows_ UNION ALL SELECT doc_id, owner, repo, stop, value FROM (SELECT doc_id, owner, repo, unnest(s_p, recursive := true) FROM base))),
owners AS (SELECT v, count(DISTINCT owner) AS n, count(DISTINCT owner || chr(0) || repo) AS r FROM cand GROUP BY v),
live AS (SELECT cand.* FROM cand JOIN owners USING (v) WHERE n <= {MOST_OWNERS} AND r <= {MOST_REPOSITORIES} AND length(v) >= {LEAST_LENGTH} AND len(list_distinct(string_split(v, ''))) >= {LEAST_DISTINCT} AND NOT regexp_matches(v, {quoted(PLACEHOLDER)})),
every AS (SELECT doc_id, kind, start, stop, true AS is_base FROM rows_ UNION ALL SELECT doc_id, kind, start, stop, false FROM live),
n AS (SELECT doc_id, count(*) AS n FROM cand GROUP BY 1)
SELECT d.doc_id, count(*) FILTER (WHERE is_base AND kind = 0) AS n_assign, count(*) FILTER (WHERE is_base AND kind = 1) AS n_access, count(*) FILTER (WHERE is_base AND kind = 2) AS n_hex,
 sha256({text_of(" FILTER (WHERE is_base)")}) AS base_sha256, {text_of("")} AS spans, count(*) FILTER (WHERE NOT is_base) AS n_live, coalesce(any_value(n.n), 0) - count(*) FILTER (WHERE NOT is_base) AS n_example
FROM d LEFT JOIN every ON every.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
