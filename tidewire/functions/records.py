"""Records from outside: JSON answers, usage counts, headers, phrases, keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys under which an object names a term, and paths that are no page views.
TERM_KEYS = ("name", "entity", "text", "label", "title", "value")
IGNORED_PATHS = ("/admin", "/live/stream", "/robots.txt", "/sitemap.xml", "/favicon", "/track", "/docs", "/openapi.json", "/redoc")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_json(text: Column) -> Column:
    """The first JSON object or array in free text, from its opening to the last closing bracket; null if it does not parse."""
    blob = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}|\[.*\]", 0), F.lit(""))
    return F.when(F.try_parse_json(blob).isNotNull(), blob)


def as_object(blob: Column) -> Column:
    """A JSON object, also out of an array of that one object; null for any other shape."""
    one = F.when(F.json_array_length(blob) == 1, F.get_json_object(blob, "$[0]"))
    return F.when(F.ltrim(blob).startswith("{"), blob).when(F.ltrim(one).startswith("{"), one)


def items_of(blob: Column, key: str, bare: bool = True) -> Column:
    """The array under a key, or a bare array (unless not asked for); empty otherwise."""

    def array(blob: Column) -> Column:
        bare_one = F.ltrim(blob).startswith("[")
        return F.when(bare_one, blob if bare else F.lit("[]")).otherwise(_once(F.get_json_object(blob, f"$.{key}"), lambda inner: F.when(F.ltrim(inner).startswith("["), inner).otherwise(F.lit("[]"))))

    return F.coalesce(F.from_json(_once(blob, array), "array<string>"), F.array().cast("array<string>"))


def item_place(item: Column, position: Column) -> Column:
    """The place an item of a batch answers to, from 0: its own 1-based index, or its position if it has none; null for junk."""
    return _once(F.get_json_object(item, "$.i"), lambda told: F.when(told.isNull(), position).otherwise(told.try_cast("int") - 1))


def terms(items: Column) -> Column:
    """Names out of items that are strings, numbers or objects: trimmed, distinct, in order."""

    def name(item: Column) -> Column:
        named = F.coalesce(*[F.get_json_object(item, f"$.{k}") for k in TERM_KEYS])
        return F.trim(F.when(F.ltrim(item).startswith("{"), named).otherwise(item))

    return F.array_distinct(F.filter(F.transform(items, name), lambda n: n.isNotNull() & (n != "")))


#: Lists within lists that variant_terms looks through.
NESTED = 8


def variant_terms(doc: Column, *keys: str) -> Column:
    """Names under the keys of a VARIANT object: distinct, in order, as JSON of any shape tells them.

    A value is one string or number, or a list of strings, numbers, objects (the first of TERM_KEYS that holds a string, number or boolean) and
    lists of these; booleans, nulls, blanks and objects without a name give nothing, nor does a document that is no object.
    """
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    plain = lambda v: kind(v).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
    none = F.array().cast("array<variant>")

    def name(item: Column) -> Column:
        told = F.filter(F.array(*[F.try_variant_get(item, f"$.{k}", "variant") for k in TERM_KEYS]), lambda v: v.isNotNull() & plain(v))
        value = F.when(kind(item).startswith("OBJECT"), F.get(told, F.lit(0))).otherwise(item)
        text = F.when(kind(value).rlike(r"^(DECIMAL\(\d+,[1-9]|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double").cast("string")).when(~kind(value).startswith("BOOLEAN") & plain(value), F.try_variant_get(value, "$", "string"))
        return F.trim(text)

    def items(raw: Column) -> Column:
        out = F.when(plain(raw), F.array(raw)).otherwise(F.coalesce(F.try_variant_get(raw, "$", "array<variant>"), none))
        for _ in range(NESTED):
            out = F.flatten(F.transform(out, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
        return F.transform(out, name)

    found = F.concat(*[items(F.try_variant_get(doc, f"$.{k}", "variant")) for k in keys])
    return F.when(kind(doc).startswith("OBJECT"), F.array_distinct(F.filter(found, lambda n: n.isNotNull() & (n != "")))).otherwise(F.array().cast("array<string>"))


def usage(answer: Column) -> list[Column]:
    """prompt, completion, cached and total tokens from either provider's form of a usage record."""
    at = lambda path: F.coalesce(F.get_json_object(answer, path).try_cast("long"), F.lit(0))
    hit = at("$.usage.prompt_cache_hit_tokens")
    cached = F.when(hit != 0, hit).otherwise(at("$.usage.prompt_tokens_details.cached_tokens"))
    other = F.get_json_object(answer, "$.usageMetadata").isNotNull()
    prompt = F.when(other, at("$.usageMetadata.promptTokenCount")).otherwise(at("$.usage.prompt_tokens"))
    completion = F.when(other, at("$.usageMetadata.candidatesTokenCount") + at("$.usageMetadata.thoughtsTokenCount")).otherwise(at("$.usage.completion_tokens"))
    told = F.when(other, at("$.usageMetadata.totalTokenCount")).otherwise(at("$.usage.total_tokens"))
    return [prompt.alias("prompt"), completion.alias("completion"), F.when(other, at("$.usageMetadata.cachedContentTokenCount")).otherwise(cached).alias("cached"), F.when(told != 0, told).otherwise(prompt + completion).alias("total")]


def country(*headers: Column) -> Column:
    """The first header that is a country's two letters, but not XX or T1; empty if none is."""
    codes = [F.upper(F.trim(h)) for h in headers]
    return F.coalesce(*[F.when(c.rlike("^[A-Z]{2}$") & ~c.isin("XX", "T1"), c) for c in codes], F.lit(""))


def trackable(path: Column) -> Column:
    out = F.lit(True)
    for prefix in IGNORED_PATHS:
        out = out & ~path.startswith(prefix)
    return out


def in_peak(at: Column, windows: list[tuple[int, int]]) -> Column:
    """Whether the hour lies in one of the half-open windows."""
    hour, out = F.hour(at), F.lit(False)
    for start, end in windows:
        out = out | ((hour >= start) & (hour < end))
    return out


def horizon_date(phrase: Column, start: Column) -> Column:
    """The day a phrase such as 'in 3-6 months' reaches: its last number times its unit; null without a unit."""
    numbers = F.regexp_extract_all(F.lower(phrase), F.lit(r"\d+"), F.lit(0))
    n = F.coalesce(F.try_element_at(numbers, F.lit(-1)).cast("int"), F.lit(1))
    low = F.lower(phrase)
    days = F.when(low.contains("year"), 365).when(low.contains("quarter"), 90).when(low.contains("month"), 30).when(low.contains("week"), 7).when(low.contains("day"), 1)
    return F.date_add(start, n * days)


def coerced(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """A label of a closed list, spelled like the list, else the default."""
    label = F.replace(F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))
    return F.when(label.isin(*allowed), label).otherwise(default)


def cache_key(task: Column, prompt: Column) -> Column:
    """SHA-256 of task, a zero character, and prompt."""
    return F.sha2(F.concat(task, F.char(F.lit(0)), prompt).cast("binary"), 256)


def short_id(*natural: Column) -> Column:
    """Twelve hexadecimal digits that stand for a natural key."""
    return F.substring(F.sha2(F.concat_ws("|", *[n.cast("string") for n in natural]), 256), 1, 12)


def linked(text: Column, headlines: Column) -> Column:
    """Text with each 12-digit id that the map headlines knows replaced by its headline."""
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[0-9a-f]{12}\b"), F.lit(0)))
    return F.aggregate(ids, text, lambda done, i: F.coalesce(F.replace(done, i, F.try_element_at(headlines, i)), done))
