"""Causal chains on the board: overlapping walks dropped, structure upserted, words kept while the structure stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import absorb, reconcile

#: Share of a later walk's nodes that makes it the same cascade, chains on the board, chains told anew in a run, days until a chain that is gone retires, sectors of a chain.
MOST_NODE_OVERLAP, BOARD, MOST_TOLD, RETIRE_DAYS, MOST_SECTORS = 0.6, 6, 4, 21, 6
#: Words of a chain, which a telling gives and a structure does not.
WORDS = ("title", "catalyst_event", "terminal_outcome")


def distinct_walks(chains: DataFrame, cut: Callable[[DataFrame], DataFrame], most: float = MOST_NODE_OVERLAP) -> DataFrame:
    """Chains (signature, nodes, confidence) without those that share ``most`` of their own nodes with a longer or stronger kept one; ties by signature."""
    nodes = chains.select(F.col("signature").alias("id"), F.explode("nodes").alias("member"))
    later = absorb.contained(nodes, nodes, most, directed=True)
    kept = reconcile.keep_first(chains, later, "signature", [-F.size("nodes"), -F.col("confidence")], cut)
    return chains.join(kept.where("signature = kept_by").select("signature"), "signature", "left_semi")


def structure_hash(nodes: Column, elasticities: Column) -> Column:
    """What a telling depends on: the nodes and the strength of each step to three places."""
    return F.md5(F.concat_ws("|", F.array_join(nodes, ">"), F.array_join(F.transform(elasticities, lambda e: F.format_number(e, 3)), ">")))


def upsert(stored: DataFrame, built: DataFrame, now: Column, board: int = BOARD, most_told: int = MOST_TOLD, retire_days: int = RETIRE_DAYS) -> DataFrame:
    """The board after a run: (signature, action, words, confidence, prose_hash, *WORDS, retired_at, updated_at).

    built: signature, prose_hash, confidence; the ``board`` strongest go on.  stored: the same with *WORDS, retired_at, updated_at.  A chain is
    'new' or 'updated' (and comes back if it had retired).  Its words are 'kept' while the structure's hash is the same and it has a title; of the
    others the ``most_told`` strongest are 'told' anew, and the rest has words to 'fill' in from the structure.  Stored chains that were
    not built 'retire' once they have not changed for ``retire_days``, else they 'stay'.
    """
    strong = built.orderBy(F.desc("confidence"), "signature").limit(board)
    old = stored.select(F.col("signature").alias("s"), F.col("prose_hash").alias("h"), F.col("confidence").alias("c"), *[F.col(w).alias(f"old_{w}") for w in WORDS], "retired_at", "updated_at")
    both = strong.join(old, F.col("signature") == F.col("s"), "full")
    fresh = F.col("signature").isNotNull()
    kept = fresh & (F.col("h") == F.col("prose_hash")) & (F.coalesce("old_title", F.lit("")) != "")
    both = both.withColumns({"fresh": fresh, "kept": F.coalesce(kept, F.lit(False))})
    turn = F.row_number().over(Window.partitionBy("fresh", "kept").orderBy(F.desc("confidence"), "signature"))  # at most ``board`` rows are fresh
    asked = both.where("fresh AND NOT kept").withColumn("turn", turn)
    rest = both.where("NOT fresh OR kept").withColumn("turn", F.lit(0))
    both = asked.unionByName(rest)
    words = F.when(F.col("kept"), "kept").when(F.col("fresh"), F.when(F.col("turn") <= most_told, "told").otherwise("fill"))
    gone = F.col("retired_at").isNull() & (F.col("updated_at") < F.timestamp_seconds(F.unix_timestamp(now) - retire_days * 86_400))
    action = F.when(F.col("fresh"), F.when(F.col("s").isNull(), "new").otherwise("updated")).otherwise(F.when(gone, "retire").otherwise("stay"))
    held = F.col("kept") | ~F.col("fresh")
    return both.select(
        F.coalesce("signature", "s").alias("signature"), action.alias("action"), words.alias("words"), F.coalesce("confidence", "c").alias("confidence"), F.coalesce("prose_hash", "h").alias("prose_hash"),
        *[F.when(held, F.col(f"old_{w}")).alias(w) for w in WORDS], F.when(~F.col("fresh"), F.when(gone, now).otherwise(F.col("retired_at"))).alias("retired_at"), F.when(F.col("fresh"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def sectors_of(chains: DataFrame, stories: DataFrame, most: int = MOST_SECTORS) -> DataFrame:
    """(signature, sectors): the distinct sectors of the stories (id, sectors) that a chain (signature, story_ids) rests on, in order of its stories, ``most`` at most."""
    told = chains.select("signature", F.posexplode("story_ids").alias("pos", "id")).join(stories.select("id", "sectors"), "id")
    each = told.select("signature", "pos", F.posexplode_outer("sectors").alias("place", "sector"))
    first = each.groupBy("signature", "sector").agg(F.min(F.struct("pos", "place")).alias("at"))  # a chain's sectors are few, its stories' lines are not
    listed = first.groupBy("signature").agg(F.sort_array(F.collect_list(F.when(F.col("sector") != "", F.struct("at", "sector")))).alias("s"))
    return listed.select("signature", F.slice(F.col("s.sector"), 1, most).alias("sectors"))


def in_domain(domain: str, *texts: Column, lists: Column) -> Column:
    """Whether a domain is part of one of the texts, or of an entry of the list, whatever the case; everything is in an empty domain."""
    want = domain.lower()
    hit = F.exists(F.coalesce(lists, F.array().cast("array<string>")), lambda s: F.contains(F.lower(s), F.lit(want)))
    for text in texts:
        hit |= F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(want))
    return hit if want else F.lit(True)
