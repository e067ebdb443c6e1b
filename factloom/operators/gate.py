"""The gate: a claim is taken only if all nodes it cites exist, and never with more confidence than they support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONFIDENCE_RANKS, confidence_name, confidence_rank


def missing_keys(support: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cited keys (claim_id, pos, node_key) that no node has."""
    return support.join(nodes.select("node_key").distinct(), "node_key", "left_anti")


def edge_evidence(edges: DataFrame) -> DataFrame:
    """(node_key, n, all_c, any_s) over the edges with a confidence, each counted at both its ends."""
    sure = F.col("confidence") == "confirmed"
    ends = edges.where("confidence is not null").select(F.explode(F.array("src_key", "dst_key")).alias("node_key"), sure.alias("c"), (sure | (F.col("confidence") == "suspected")).alias("s"))
    return ends.groupBy("node_key").agg(F.count("*").alias("n"), F.bool_and("c").alias("all_c"), F.bool_or("s").alias("any_s"))


def node_evidence(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node_key, known, disputed, n, all_c, any_s): all that a claim needs to know of a node, in one row each."""
    parts = edge_evidence(edges).select("node_key", F.lit(False).alias("known"), F.lit(False).alias("disputed"), "n", "all_c", "any_s")
    if nodes is not None:
        own = nodes.select("node_key", F.lit(True), F.coalesce("disputed", F.lit(False)), F.lit(0).cast("long"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"))
        parts = own.unionAll(parts)
    return parts.toDF("node_key", "known", "disputed", "n", "all_c", "any_s").groupBy("node_key").agg(F.bool_or("known").alias("known"), F.bool_or("disputed").alias("disputed"), F.sum("n").alias("n"), F.bool_and("all_c").alias("all_c"), F.bool_or("any_s").alias("any_s"))


def by_claim(support: DataFrame, info: DataFrame) -> DataFrame:
    """What the nodes cited by a claim say together: one join and one aggregate."""
    unknown = ~F.coalesce("known", F.lit(False))
    return support.join(info, "node_key", "left").groupBy("claim_id").agg(
        F.count("*").alias("n_cited"), F.count_if(unknown).alias("n_missing"), F.min_by("node_key", F.when(unknown, F.col("pos"))).alias("first_missing"),
        F.coalesce(F.bool_or("disputed"), F.lit(False)).alias("any_disputed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"),
        F.coalesce(F.bool_and("all_c"), F.lit(False)).alias("all_confirmed"), F.coalesce(F.bool_or("any_s"), F.lit(False)).alias("any_supported"),
    )


def evidence_by_claim(support: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim_id, n_edges, all_confirmed, any_supported) over the edges with a confidence that touch cited nodes; an edge counts once at each end that is cited."""
    return by_claim(support, node_evidence(None, edges)).select("claim_id", "n_edges", "all_confirmed", "any_supported")


def evidence_confidence() -> Column:
    return F.when(F.col("n_edges") == 0, "inferred").when(F.col("all_confirmed"), "confirmed").when(F.col("any_supported"), "suspected").otherwise("inferred")


def final_confidence(hint: Column, evidence: Column) -> Column:
    """The lower of the two."""
    return confidence_name(F.least(confidence_rank(hint), confidence_rank(evidence)))


def judge(claims: DataFrame, support: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """claims (claim_id, hint) with decision, final_confidence, n_missing and first_missing.

    nodes: node_key, disputed. Rules in order: something is cited; all of it exists; a disputed node
    makes the claim disputed; else the lower of hint and evidence.
    """
    df = claims.join(by_claim(support, node_evidence(nodes, edges)), "claim_id", "left")
    df = df.fillna({"n_cited": 0, "n_missing": 0, "n_edges": 0}).fillna(False, ["any_disputed", "all_confirmed", "any_supported"])
    final = F.when(F.col("any_disputed"), F.lit("disputed")).otherwise(final_confidence(F.col("hint"), evidence_confidence()))
    rejected = F.when(~F.col("hint").isin(*CONFIDENCE_RANKS), "bad_confidence_hint").when(F.col("n_cited") == 0, "rejected_empty_support").when(F.col("n_missing") > 0, "rejected_missing_node")
    decision = F.coalesce(rejected, F.when(final != F.col("hint"), "downgraded_confidence").otherwise("accepted"))
    return df.select("claim_id", "hint", "n_cited", "n_missing", "first_missing", "n_edges", decision.alias("decision"), F.when(rejected.isNull(), final).alias("final_confidence"))


def commits(claims: DataFrame, support: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Findings put forward as a table: claims (claim_id, claim, hint) with their outcome, and the confidence of those that are taken.

    What the service answers one by one: a hint that there is not, then what the gate rejects, then an empty claim.
    """
    judged = judge(claims.select("claim_id", "hint"), support, nodes, edges)
    empty = ~F.col("decision").startswith("rejected") & (F.col("decision") != "bad_confidence_hint") & (F.coalesce("claim", F.lit("")) == "")
    df = claims.select("claim_id", "claim").join(judged, "claim_id").withColumn("_empty", empty)
    return df.select("claim_id", F.when(F.col("_empty"), "empty_claim").otherwise(F.col("decision")).alias("outcome"), F.when(~F.col("_empty"), F.col("final_confidence")).alias("final_confidence"), "n_missing", "first_missing")
