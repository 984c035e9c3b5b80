"""Prose out of feeds and pages, in Arrow batches: every character reference, furniture, sentences, facts, HTML."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .text import ABBREVIATIONS, BOILERPLATE, FLUFF

# Agencies, datelines, sentence ends, and the elements of a page that are no prose or may be.
AGENCY = r"\((?:Reuters|AP|AFP|PTI|IANS|Bloomberg)\)\s*[-–—]?\s*"
DATELINE = r"^\s*(?:[A-Z][A-Za-z.]*(?:[ ,][A-Z][A-Za-z.]*){0,3},?\s*)?(?:\((?:Reuters|AP|AFP|PTI|IANS|Bloomberg)\)\s*)?[-–—]\s+"
SENTENCE_END = r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])"
STRIPPED = r"<(script|style|noscript|nav|header|footer|aside|form|figure|iframe|svg)\b[^>]*>.*?</\1>"
ARTICLE = r"<article\b[^>]*>(.*?)</article>"
BLOCK = r"<(p|h1|h2|h3|li)\b[^>]*>(.*?)</\1>"
EDGES = " -–—|·•\t"
# Characters of a page's prose, words of a block, characters of a sentence and of a fact, facts an article gives.
PAGE_CHARS, BLOCK_WORDS, SENTENCE_CHARS, FACT_CHARS, FACTS_AN_ARTICLE = 6000, 8, 25, 30, 8

_TAG, _URL = re.compile(r"<[^>]+>"), re.compile(r"https?://\S+|www\.\S+")
_LEADS = [re.compile(AGENCY), re.compile(DATELINE)]
_FURNITURE = [re.compile(p, re.I) for p in BOILERPLATE]
_STRIPPED, _ARTICLE, _BLOCK = (re.compile(p, re.I | re.S) for p in (STRIPPED, ARTICLE, BLOCK))
_SENTENCE_END, _FLUFF = re.compile(SENTENCE_END), re.compile(FLUFF)
_ABBREVIATIONS = tuple(ABBREVIATIONS)


#: What a text must hold, in lower case, for a pattern of furniture to match: patterns without regard to case are slow where nothing matches.
_HINTS = (
    ("read more", "read the full story"), ("continue reading",), ("click here",), ("sign up", "subscribe"), ("advertisement",), ("sponsored content",), ("the post ",), ("all rights reserved",),
    ("photo", "image", "credit"), ("getty images",), ("follow us on",), ("share this ",), ("this article ",), ("copyright",),
)
#: Letters beyond ASCII that patterns take for i, k or s, but lower() does not.
_ODD_CASES = re.compile("[\u0130\u0131\u017f\u212a]")


def _without_furniture(text: str) -> str:
    odd, low = _ODD_CASES.search(text), text.lower()
    for furniture, hints in zip(_FURNITURE, _HINTS, strict=True):
        if odd or any(h in low for h in hints):
            text = furniture.sub(" ", text)
            low = text.lower()
    return text


def cleaned(text: str | None) -> str:
    """Text without references, tags, URLs, agencies, datelines and boilerplate; white space collapsed."""
    if not text:
        return ""
    text = _TAG.sub(" ", html.unescape(html.unescape(text)))
    if "http" in text or "www." in text:
        text = _URL.sub(" ", text)
    agency, dateline = _LEADS
    if "(" in text:
        text = agency.sub("", text)
    if lead := dateline.match(text):
        text = text[lead.end() :]
    return " ".join(_without_furniture(text).split()).strip(EDGES)


def _sentences(text: str) -> Iterator[str]:
    """Sentences of cleaned text, as they are asked for; a part after an abbreviation is joined to it again."""
    found, start = "", 0
    for end in chain(_SENTENCE_END.finditer(text), (None,)):
        part = (text[start : end.start()] if end else text[start:]).strip()
        start = end.end() if end else start
        if not part:
            continue
        if found and not found.lower().endswith(_ABBREVIATIONS):
            yield found
            found = part
        else:
            found = f"{found} {part}" if found else part
    if found:
        yield found


def sentences_of(text: str) -> list[str]:
    """Sentences of cleaned text; a part after an abbreviation is joined to it again."""
    return list(_sentences(text))


def reports(sentence: str) -> bool:
    """Whether a sentence reports something: long enough, no lead-in, half letters at least."""
    return len(sentence) >= SENTENCE_CHARS and not _FLUFF.match(sentence) and 2 * sum(map(str.isalpha, sentence)) >= len(sentence)


def facts_of(title: str, body: str) -> list[str]:
    """The first sentences of a body that report something, without the cleaned title where they begin with it."""
    found = []
    for sentence in filter(reports, _sentences(cleaned(body))):
        if title and sentence.startswith(title):
            sentence = sentence.removeprefix(title).lstrip(" -–—:.")
        if len(sentence) >= FACT_CHARS:
            found.append(sentence)
        if len(found) == FACTS_AN_ARTICLE:
            break
    return found


def prose_of(page: str | None, most: int = PAGE_CHARS) -> str:
    """Paragraphs, headings and items of BLOCK_WORDS words or more, of the article if the page marks one, each kept once; cut at ``most`` characters."""
    page = _STRIPPED.sub(" ", page or "")
    article = _ARTICLE.search(page)
    kept: dict[str, str] = {}
    length = 0
    for match in _BLOCK.finditer(article[1] if article else page):
        block = cleaned(_TAG.sub(" ", match[2]))
        if len(block.split()) >= BLOCK_WORDS and block[:80].lower() not in kept:
            kept[block[:80].lower()] = block
            length += len(block)
            if length >= most:
                break
    return " ".join(kept.values())[:most]


@F.pandas_udf(StringType())
def clean(texts: pd.Series) -> pd.Series:
    return texts.map(cleaned)


@F.pandas_udf(ArrayType(StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    """Sentences of a text as it came, cleaned first."""
    return texts.map(lambda t: sentences_of(cleaned(t)))


@F.pandas_udf(StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(prose_of)


@F.pandas_udf(StructType().add("title", StringType()).add("facts", ArrayType(StringType())))
def facts(titles: pd.Series, bodies: pd.Series) -> pd.DataFrame:
    """The cleaned title of an article and the facts of its body."""
    heads = titles.map(cleaned)
    return pd.DataFrame({"title": heads, "facts": [facts_of(t, b) for t, b in zip(heads, bodies, strict=True)]})
