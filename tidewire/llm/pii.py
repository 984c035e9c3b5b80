"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Four base kinds (email, ip, card, phone) are always reported.  The further
kinds below are reported from a score of MIN_SCORE on:

* iban: 15 to 34 characters, as many as the country's have, whose mod-97
  remainder is 1; groups that follow it are left out;
* ssn: three digit groups, only beside a context word;
* local_phone: a national number, only beside a context word.

Defined cases: null text counts as empty; an empty text has no spans; repeated
rows are scanned each for itself; texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone")
MIN_SCORE = 0.5
#: Characters looked at before and after a span for context words.
CONTEXT_CHARS = 48
CONTEXT_BONUS = 0.35

BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "local_phone": 0.2}
CONTEXT_WORDS = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "visa", "credit", "debit", "payment", "mastercard"},
    "phone": {"phone", "call", "tel", "mobile", "fax"},
    "iban": {"iban", "bank", "account", "transfer"},
    "ssn": {"ssn", "social", "security"},
    "local_phone": {"phone", "call", "tel", "telephone", "mobile", "cell", "fax"},
}

_LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its first digit only: a later start fails as the first one did.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_GROUP_END = re.compile(r"(?=\x20|$)")
#: Characters of the countries' numbers; of other countries any length may be.
IBAN_LENGTHS = {
    code: int(length)
    for length, codes in (item.split(":") for item in (
        "15:NO 16:BE 18:DK,FK,FI,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,XK,LT,LU,MN 21:HR,LV,LI,CH 22:BH,BG,CR,GE,DE,IE,ME,RS,GB,VA "
        "23:TL,GI,IQ,IL,OM,SO,AE 24:AD,CZ,MD,PK,RO,SA,SK,ES,SE,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MR,MC,SM 28:AL,AZ,BY,CY,DO,SV,GT,HU,LB,NI,PL "
        "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for code in codes.split(",")
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[A-Za-z]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        twice = 2 * int(d)
        total += twice - 9 if twice > 9 else twice
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _ibans(text: str):
    """Of each candidate the longest run of whole groups that has the country's length and passes."""
    at, match = 0, _IBAN.search(text)
    while match:
        at = match.end()
        for end in reversed([m.start() for m in _GROUP_END.finditer(match[0])]):
            iban = match[0][:end].replace(" ", "")
            if 15 <= len(iban) <= 34 and len(iban) == IBAN_LENGTHS.get(iban[:2], len(iban)) and mod97(iban):
                at = match.start() + end
                yield match.start(), at
                break
        else:
            at = match.start() + 4  # another may begin in a later group
        match = _IBAN.search(text, at)


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at  # back over the run of letters before the "@": no letter lies before two of them
        while start > done and text[start - 1] in _LOCAL_PART:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base kinds, by kind and start; offsets in code points, end exclusive."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdecimal, m[0])) <= 15]
    return found


def _scored(kind: str, start: int, end: int, text: str) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    bonus = CONTEXT_BONUS if CONTEXT_WORDS[kind] & set(_WORD.findall(near.lower())) else 0.0
    return min(1.0, BASE_SCORE[kind] + bonus)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans with scores, by start, then kind in the order of KINDS."""
    found = base_spans(text)
    if _DIGIT.search(text):
        found += [("iban", a, b) for a, b in _ibans(text)]
        found += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
        found += [("local_phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    scored = [(*span, _scored(*span, text)) for span in found]
    kept = [s for s in scored if s[0] in BASE_KINDS or s[3] >= MIN_SCORE]
    return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0])))


def redact_text(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Each span, or run of overlapping spans, becomes the first one's kind in angle brackets."""
    out, done, i = [], 0, 0
    while i < len(spans):
        kind, start, end, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[done:start], f"<{kind.upper()}>"]
        done = end
    return "".join([*out, text[done:]])


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (array of kind, start, end, score)."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t)] for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPAN)], ["doc_id", "spans"])

    return map_rows(texts(docs, id_col, text_col), scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns; personal data in the text is replaced, a null text stays null."""
    names = docs.columns
    place = names.index(text_col)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = [t if t is None else redact_text(t, find_spans(t)) for t in batch.column(place).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema.set(place, pa.field(names[place], pa.string())))

    return map_rows(docs, scan, docs.schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    from .common import table

    spans = detect(table(spark, sf_dir, "documents"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return spans.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"))



def redacted_documents(docs: DataFrame) -> DataFrame:
    """redact() for the documents table: n_chars, where there is such a column, becomes the new text's length."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out
