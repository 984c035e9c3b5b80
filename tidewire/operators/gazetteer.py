"""A memory of names: what extractions have told, and articles answered from it alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# How much of an extraction is learnt and given out, and how many terms are known at most, most seen first.
TERMS_LEARNT, ASSOCIATED = 24, 8
ENTITIES_OUT, OTHERS_OUT, FALLBACK = 12, 4, 3
MOST_TERMS = 20_000
MOST_UNKNOWN = 0


def learn(extractions: DataFrame) -> DataFrame:
    """(kind, norm, term, tokens, sectors, regions, seen, first_seen, last_seen) out of extractions (entities, sectors, regions: arrays; at, id).

    A term is known by its kind and its normal form; its first spelling stays; an entity keeps the sectors and regions of its last
    extraction that had any.  Terms without a telling word are not learnt.  Upserts into what is stored by merge().
    """
    few = lambda c: F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, ASSOCIATED)
    own = extractions.select("entities", "sectors", "regions", few("sectors").alias("s"), few("regions").alias("r"), "at", "id")
    terms = None
    for kind in ("entities", "sectors", "regions"):
        rows = own.select(F.lit(kind).alias("kind"), F.posexplode(F.slice(kind, 1, TERMS_LEARNT)).alias("pos", "term"), "s", "r", "at", "id")
        terms = rows if terms is None else terms.unionByName(rows)
    terms = terms.withColumns({"norm": F.array_join(T.tokens(F.col("term")), " "), "tokens": T.key_tokens(F.col("term")), "order": F.struct("at", "id", "pos")}).where((F.col("norm") != "") & (F.size("tokens") > 0))
    telling = (F.col("kind") == "entities") & ((F.size("s") > 0) | (F.size("r") > 0))
    assoc = F.max_by(F.struct("s", "r"), F.when(telling, F.col("order")))
    return terms.groupBy("kind", "norm").agg(
        F.min_by(F.substring("term", 1, 120), "order").alias("term"), F.min_by("tokens", "order").alias("tokens"), F.when(F.max(telling), assoc).alias("assoc"),
        F.count("*").alias("seen"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"),
    ).select("kind", "norm", "term", "tokens", F.col("assoc.s").alias("sectors"), F.col("assoc.r").alias("regions"), "seen", "first_seen", "last_seen")


def merge(stored: DataFrame, learnt: DataFrame) -> DataFrame:
    """Both memories as one: first spellings and the latest associations stay, counts add up."""
    both = stored.unionByName(learnt)
    assoc = F.max_by(F.struct("sectors", "regions"), F.when(F.col("sectors").isNotNull(), F.col("last_seen")))
    return both.groupBy("kind", "norm").agg(
        F.min_by("term", "first_seen").alias("term"), F.min_by("tokens", "first_seen").alias("tokens"), F.when(F.max(F.col("sectors").isNotNull()), assoc).alias("assoc"),
        F.sum("seen").alias("seen"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    ).select("kind", "norm", "term", "tokens", F.col("assoc.sectors").alias("sectors"), F.col("assoc.regions").alias("regions"), "seen", "first_seen", "last_seen")


def match(articles: DataFrame, memory: DataFrame, most_unknown: int = MOST_UNKNOWN, most_terms: int = MOST_TERMS) -> DataFrame:
    """(id, reason, entities, sectors, regions) of articles (id, title, summary), answered from memory alone or refused with a reason.

    A term is found if all its words are in the text: entities and regions among the anchors, sectors among all words.  The most specific
    comes first.  Refused: no_anchors, no_known_entity, unknown_anchors:n (an anchor that no found entity or region claims is news that
    must not be guessed), no_sector (neither in the text nor known with a found entity); empty_gazetteer if nothing is known.
    The terms known at most travel to every task, listed by their first word; an article's words meet only those.
    """
    known = memory.orderBy(F.desc("seen"), F.desc("last_seen"), "kind", "norm").limit(most_terms)
    listed = known.select(F.get("tokens", F.lit(0)).alias("word"), F.struct((-F.size("tokens")).alias("length"), (-F.col("seen")).alias("often"), "kind", "term", "tokens", "sectors", "regions").alias("hit")).withColumn("upper", F.col("hit.kind") != "sectors")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    own = articles.select("id", F.filter(T.anchors(text), lambda a: ~a.rlike(r"^\d")).alias("anchors"), F.array_distinct(T.tokens(text)).alias("words"))
    present = F.concat(F.transform("anchors", lambda w: F.struct(w.alias("word"), F.lit(True).alias("upper"))), F.transform("words", lambda w: F.struct(w.alias("word"), F.lit(False).alias("upper"))))
    asked = own.select("id", "anchors", "words", F.explode_outer(present).alias("p")).select("id", "anchors", "words", F.col("p.word").alias("word"), F.col("p.upper").alias("upper"))
    met = asked.join(F.broadcast(listed), ["word", "upper"], "left")
    whole = F.forall("hit.tokens", lambda w: F.array_contains(F.when(F.col("upper"), F.col("anchors")).otherwise(F.col("words")), w))
    held = met.select("id", "anchors", F.when(F.col("hit").isNotNull() & whole, F.col("hit")).alias("whole"))
    found = held.groupBy("id").agg(F.first("anchors").alias("anchors"), F.array_sort(F.collect_list("whole")).alias("hits"))
    return found.crossJoin(F.broadcast(known.agg(F.count("*").alias("terms")))).select("id", "terms", "anchors", *[_of_kind(kind) for kind in ("entities", "sectors", "regions")]).transform(lambda rows: _answers(rows, most_unknown))


def _of_kind(kind: str) -> Column:
    return F.filter("hits", lambda h: h["kind"] == kind).alias(kind)


def _answers(found: DataFrame, most_unknown: int) -> DataFrame:
    names = lambda c: F.array_distinct(F.transform(c, lambda h: h["term"]))
    claimed = F.flatten(F.transform(F.concat("entities", "regions"), lambda h: h["tokens"]))
    unknown = F.size(F.array_except(F.array_except("anchors", claimed), F.array(*[F.lit(w) for w in T.WEAK_NAMES])))

    def told(kind: str) -> Column:
        lists = F.filter(F.transform("entities", lambda h: h[kind]), lambda a: F.size(a) > 0)
        return F.when(F.size(kind) > 0, names(kind)).otherwise(F.coalesce(F.slice(F.get(lists, F.lit(0)), 1, FALLBACK), F.array().cast("array<string>")))

    rows = found.select("id", "terms", "anchors", names("entities").alias("names"), unknown.alias("unknown"), told("sectors").alias("told_sectors"), told("regions").alias("told_regions"))
    reason = (
        F.when(F.col("terms") == 0, "empty_gazetteer").when(F.size("anchors") == 0, "no_anchors").when(F.size("names") == 0, "no_known_entity")
        .when(F.col("unknown") > most_unknown, F.concat(F.lit("unknown_anchors:"), "unknown")).when(F.size("told_sectors") == 0, "no_sector").otherwise("matched")
    )
    out = lambda c, n: F.when(F.col("reason") == "matched", F.slice(F.array_distinct(c), 1, n))
    return rows.withColumn("reason", reason).select("id", "reason", out("names", ENTITIES_OUT).alias("entities"), out("told_sectors", OTHERS_OUT).alias("sectors"), out("told_regions", OTHERS_OUT).alias("regions"))


def shadow(expected: DataFrame, answered: DataFrame) -> DataFrame:
    """(id, missed, invented) where an answer differs from the extraction (id, entities): names it lacks and names it adds, by normal form, the first four of each."""
    norms = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.array_join(T.tokens(x), " ")), lambda n: n != ""))
    both = answered.where("reason = 'matched'").select("id", norms("entities").alias("got")).join(expected.select("id", norms("entities").alias("want")), "id")
    rows = both.select("id", F.array_sort(F.array_except("want", "got")).alias("missed"), F.array_sort(F.array_except("got", "want")).alias("invented"))
    return rows.where((F.size("missed") > 0) | (F.size("invented") > 0)).select("id", F.slice("missed", 1, 4).alias("missed"), F.slice("invented", 1, 4).alias("invented"))
