"""What a model's answer may say: rows are held against their rules one by one, and what breaks one goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of a beat's label and least ones of its text, beats of a story, characters of a quote.
LABEL, BEAT_TEXT, LEAST_BEATS, QUOTE = 60, 40, 2, 24
# Entities, metrics and relations that an extraction gives.
ENTITIES, METRICS, RELATIONS = 40, 30, 30
# Cards, and the categories that readers choose.
CATEGORY_TYPES = {"breaking": "breaking", "sports": "score", "finance": "market", "events": "event"}
#: Characters of a piece of a stand-in narrative, at least one more.
PIECE = 40


def beats(raw: Column) -> Column:
    """Beats (label, text) with a label and BEAT_TEXT characters of text; null for fewer than LEAST_BEATS: one beat is no structure."""
    trimmed = F.transform(raw, lambda b: F.struct(F.substring(F.trim(F.coalesce(b["label"], F.lit(""))), 1, LABEL).alias("label"), F.trim(F.coalesce(b["text"], F.lit(""))).alias("text")))
    kept = F.filter(trimmed, lambda b: (b["label"] != "") & (F.length(b["text"]) >= BEAT_TEXT))
    return F.when(F.size(kept) >= LEAST_BEATS, kept)


def quotes(raw: Column, n_claims: Column, kept: Column) -> Column:
    """Anchors (claim, quote) whose claim exists and whose quote, of QUOTE characters or more, stands word for word in the beats; each quote once, null for none."""
    body = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    own = F.transform(raw, lambda a: F.struct(a["claim"].try_cast("int").alias("claim"), F.trim(F.coalesce(a["quote"], F.lit(""))).alias("quote")))
    fit = F.filter(own, lambda a: a["claim"].isNotNull() & (a["claim"] >= 0) & (a["claim"] < n_claims) & (F.length(a["quote"]) >= QUOTE) & F.contains(body, a["quote"]))
    first = F.filter(fit, lambda a, i: F.array_position(F.transform(fit, lambda x: x["quote"]), a["quote"]) == i + 1)
    return F.when(F.size(first) > 0, first)


def outlet(said: Column, cited: Column) -> Column:
    """The first cited outlet that is what an answer names, or part of it, or holds it, whatever the case; null if none is or the name is blank."""
    key = F.lower(F.trim(F.coalesce(said, F.lit(""))))
    return F.when(key != "", F.get(F.filter(F.transform(cited, F.lower), lambda a: F.contains(key, a) | F.contains(a, key)), F.lit(0)))


def extracted(rows: DataFrame) -> DataFrame:
    """Extractions (id, entities: name; metrics: name, value, verbatim; relations: subject, predicate, object) as their rules leave them.

    ENTITIES named entities; METRICS metrics, a value only with a digit in what it quotes; RELATIONS relations between two different extracted
    entities, whatever the case, related_to where unnamed.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    names = F.filter(F.transform(F.slice("entities", 1, ENTITIES), lambda e: blank(e["name"])), lambda n: n != "")
    metrics = F.filter(F.transform(F.slice("metrics", 1, METRICS), lambda m: F.struct(F.coalesce(F.nullif(blank(m["name"]), F.lit("")), F.lit("value")).alias("name"), m["value"].alias("value"), blank(m["verbatim"]).alias("verbatim"))), lambda m: m["value"].isNull() | m["verbatim"].rlike(r"\d"))
    known = F.transform(F.col("names"), F.lower)
    ends = F.transform(F.slice("relations", 1, RELATIONS), lambda r: F.struct(blank(r["subject"]).alias("subject"), F.coalesce(F.nullif(blank(r["predicate"]), F.lit("")), F.lit("related_to")).alias("predicate"), blank(r["object"]).alias("object")))
    kept = F.filter(ends, lambda r: F.array_contains(known, F.lower(r["subject"])) & F.array_contains(known, F.lower(r["object"])) & (F.lower(r["subject"]) != F.lower(r["object"])))
    return rows.withColumn("names", names).select("id", F.col("names").alias("entities"), metrics.alias("metrics"), kept.alias("relations"))


def live_categories(override: Column, enabled: Column, chosen: Column) -> Column:
    """The categories a reader sees: those asked for, else their own that exist, else all; null where the section is switched off."""
    everything = F.array(*[F.lit(c) for c in CATEGORY_TYPES])
    asked = F.filter(F.transform(F.split(override, ","), lambda c: F.trim(c)), lambda c: c != "")
    own = F.when(~F.coalesce(enabled, F.lit(True)), F.lit(None)).when(F.size(chosen) > 0, F.filter(chosen, lambda c: F.array_contains(everything, c))).otherwise(everything)
    return F.when(F.coalesce(override, F.lit("")) != "", asked).otherwise(own)


def card_types(categories: Column) -> Column:
    """The types of cards that categories stand for; unknown ones stand for none."""
    kinds = F.create_map(*[F.lit(x) for pair in CATEGORY_TYPES.items() for x in pair])
    return F.filter(F.transform(categories, lambda c: F.try_element_at(kinds, c)), lambda k: k.isNotNull())


def stand_in(articles: DataFrame, cleaned: str = "text") -> DataFrame:
    """(story, narrative): readable text of a story that is not written yet, from its articles (story, id, at, summary, title, both cleaned).

    In order of time an article gives its summary, or else its title, if that is longer than PIECE characters and not told before, whatever the case; sentences get a full stop.
    """
    fit = lambda c: F.length(c) > PIECE
    pieces = F.array_sort(F.collect_list(F.struct("at", "id", "summary", "title")))

    def add(told: Column, a: Column) -> Column:
        new = lambda c: fit(c) & ~F.exists(told, lambda t: F.lower(t) == F.lower(c))
        piece = F.when(new(a["summary"]), a["summary"]).when(new(a["title"]), a["title"])
        return F.when(piece.isNull(), told).otherwise(F.concat(told, F.array(piece)))

    told = F.aggregate(pieces, F.array().cast("array<string>"), add)
    ended = F.transform(told, lambda t: F.when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit("."))))
    return articles.groupBy("story").agg(F.array_join(ended, " ").alias("narrative"))


def stories_of(entity: str, ticker: str, finance: DataFrame, general: DataFrame, limit: int = 10) -> DataFrame:
    """Stories that mention an entity: of finance (id, headline, entities, tickers, updated_at) by name or ticker, else, if there is none at all, of general (id, headline, narrative, created_at) by its words; 50 at most, newest first."""
    limit = max(1, min(limit, 50))
    mentions = lambda c, what: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit(what.lower())))
    own = finance.where(mentions("entities", entity) | mentions("tickers", ticker)).select("id", "headline", F.lit("finance").alias("kind"), F.col("updated_at").alias("at"))
    some = own.limit(1).agg((F.count("*") > 0).alias("some"))
    words = F.contains(F.lower(F.concat_ws(" ", "headline", "narrative")), F.lit(entity.lower()))
    rest = general.where(words).select("id", "headline", F.lit("news").alias("kind"), F.col("created_at").alias("at")).crossJoin(F.broadcast(some)).where("NOT some").drop("some")  # one row
    return own.unionByName(rest).orderBy(F.desc("at"), "id").limit(limit)
