"""Rows that share an id, planning at many ranges, and whole-table brute force of op4 and op9."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.oracle import SF
from tidewire.llm import decontamination, merkle, pii, resampling, simhash
from tidewire.llm.common import table

pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the generated tables")


def held(frame):
    return sorted((str(x.doc_id), x.text or "", x.h) for x in frame.select("doc_id", "text", "h").collect())


def test_quality_drops_rows_not_ids(spark):
    r = random.Random(10)
    clean = lambda: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60))
    junk = lambda: " ".join(r.choice("%%% ### buy now free spam".split()) for _ in range(60))
    rows = [(i, clean() if i % 5 else junk(), "good" if i % 5 else "bad") for i in range(400)]
    rows += [(None, clean(), "good") for _ in range(10)] + [(None, junk(), "bad"), (2000, clean(), "good"), (2000, junk(), "bad")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    taken = held(resampling.selected_documents(df, labels))
    assert not any(h == "bad" for *_, h in taken)
    assert sum(i == "None" for i, *_ in taken) == 10 and sum(i == "2000" for i, *_ in taken) == 1


def test_decontamination_drops_rows_not_ids(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    item, plain = " ".join(words[:30]), " ".join(words[100:200])
    rows = [(None, item, "bad"), (None, plain, "good"), (5, plain + " " + item, "bad"), (5, plain, "good"), (5, plain, "good")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert held(decontamination.clean_documents(df, items)) == sorted([("None", plain, "good"), ("5", plain, "good"), ("5", plain, "good")])


def test_near_copies_tell_rows_of_one_id_apart(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    one, two, three, four = (" ".join(word() for _ in range(120)) for _ in range(4))
    rows = [(1, one), (1, two), (1, two), (2, one + " end"), (3, three), (4, three), (4, four), (None, one), (None, one)]
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, h string").repartition(3)
    assert held(simhash.deduplicated_documents(df)) == sorted([("1", one, "s"), ("1", two, "s"), ("3", three, "s"), ("4", four, "s"), ("None", one, "s"), ("None", one, "s")])


def test_ranges_plan_in_bounded_time(spark):
    keys = spark.range(5000)
    for n in (1, 7, 500, 10_000):
        began = time.perf_counter()
        found = keys.select("id", merkle._range_of(F.col("id"), [3 * i for i in range(1, n + 1)]).alias("p"))
        assert found.where(F.col("p") != F.least(F.floor(F.col("id") / 3), F.lit(n))).count() == 0
        assert time.perf_counter() - began < 20


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    order = ["email", "ip", "card", "phone"]
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


def test_op4_on_whole_table(spark):
    texts = {x.doc_id: x.text or "" for x in table(spark, str(SF), "documents").collect()}
    rows = pii.op4_pii(spark, str(SF)).collect()
    assert len(rows) == len(texts)
    for x in rows:
        spans = base_spans(texts[x.doc_id])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert x.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))
        assert set(told.split(",")) - {""} <= set(x.spans.split(","))


def brute_best(item, passage):
    """The best Smith-Waterman score over a whole document, row by row."""
    best, before = 0, [0] * (len(passage) + 1)
    for w in item:
        row = [0]
        for j, p in enumerate(passage, 1):
            row.append(max(0, before[j - 1] + (decontamination.MATCH if w == p else decontamination.MISMATCH), before[j] + decontamination.GAP, row[-1] + decontamination.GAP))
        best, before = max(best, max(row)), row
    return best


def test_op9_against_exhaustive_alignment(spark):
    """Every document that holds words of an item, against it, in full."""
    docs = {x.doc_id: decontamination.words(x.text or "") for x in table(spark, str(SF), "documents").collect()}
    items = {x.item_id: decontamination.words(x.text or "") for x in table(spark, str(SF), "benchmark").collect()}
    want = set()
    for i, item in items.items():
        known = set(item)
        for d, words in docs.items():
            if len(known & set(words)) * 2 >= len(known) and brute_best(item, words) >= decontamination.MIN_SCORE * decontamination.MATCH * len(item):
                want.add((d, i))
    found = {(x.doc_id, x.item_id) for x in decontamination.op9_decontamination(spark, str(SF)).collect()}
    assert want and found == want
