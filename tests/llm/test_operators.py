"""The other training-data operators on small tables: brute force, round trips, odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tests.oracle import SF, spark_rows, sql_rows
from tidewire.llm import bpe, decontamination, merkle, pii, queries, resampling, simhash, url_lists, warc
from tidewire.llm.common import batches

ODD = [(1, ""), (2, None), (3, "a"), (3, "a"), (None, "b c"), (4, "word " * 3000), (5, "é😀\n\n x\x1c y  z")]


def odd_documents(spark):
    return spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, fingerprint int")


@pytest.mark.parametrize("name", ["op1_warc", "op2_url_filters"])
def test_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, str(SF))) == sql_rows(queries.ORACLE_SQL[name])


def test_warc(spark, tmp_path):
    records = [warc.ArcRecord("http://a b/\n", "1.2.3.4", "20240102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n"), warc.ArcRecord("", "0.0.0.0", "odd", "text/plain", b"")]
    for version in (1, 2):
        back = list(warc.read_arc(warc.write_arc(records, version)))
        assert [(r.block, r.ip, r.content_type) for r in back] == [(r.block, r.ip, r.content_type) for r in records]
        assert [r.url for r in back] == ["http://a%20b/%0A", "about:blank"]
        arcs = spark.createDataFrame([(bytearray(warc.write_arc(records, version)),)], "content binary")
        warc.write(warc.convert(arcs), f"file://{tmp_path}/v{version}")
        rows = warc.read(spark, f"file://{tmp_path}/v{version}").collect()
        assert [(r.fields["WARC-Type"], r.payload_bytes) for r in rows] == [("response", 12), ("resource", 0)]
        assert [r.fields["WARC-Date"] for r in rows] == ["2024-01-02T03:04:05Z", "1970-01-01T00:00:00Z"]
    with pytest.raises(ValueError, match="shorter"):
        list(warc.read_arc(warc.write_arc(records[:1], 1)[:-9]))


def test_warc_odd_pages(spark, tmp_path):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(1, None, None), (2, "u", big), (3, "v", big), (3, "v", big), (None, "w", big), (5, "", "small"), (6, "", "small")], "page_id long, url string, html string")
    warc.write(warc.page_records(pages), f"file://{tmp_path}/w")
    rows = warc.read(spark, f"file://{tmp_path}/w").collect()
    got = sorted((r.fields["Page-ID"], r.fields["WARC-Type"], r.fields.get("Refers-To-Page-ID")) for r in rows)
    assert got == [("", "response", None), ("1", "response", None), ("2", "response", None), ("3", "revisit", "2"), ("3", "revisit", "2"), ("5", "response", None), ("6", "response", None)]
    assert warc.page_records(pages.limit(0)).collect() == []


def test_url_lists(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    captures = spark.createDataFrame([(1, "http://www.A.b.com:80/x/y?q", "2024-02-01"), (2, "http://a.b.com/ok/z", "2024-02-01"), (3, "http://a.b.com/x", "2023-01-01"), (4, None, "2024-02-01"), (5, "no url", "2024-02-01"), (6, "http://c.b.com", "2024-03-01"), (6, "http://c.b.com", "2024-03-01")], "page_id long, url string, at string").withColumn("fetched_at", F.col("at").cast("timestamp"))
    entries = spark.createDataFrame([("b.com", "domain", "block", "add", "2024-01-01"), ("b.com", "domain", "block", "remove", "2024-02-15"), ("a.b.com/ok", "prefix", "allow", "add", "2024-01-01"), ("a.b.com/ok", "prefix", "allow", "add", "2024-01-05")], "key string, kind string, action string, op string, at string").withColumn("at", F.col("at").cast("timestamp"))
    out = {(r.page_id, r.blocked, r.entry_kind) for r in url_lists.filter_captures(captures, entries).collect()}
    assert out == {(1, True, "domain"), (2, False, "prefix"), (3, False, None), (4, False, None), (5, False, None), (6, False, None)}
    assert url_lists.filter_captures(captures, entries.limit(0)).where("blocked").count() == 0 and t is not None


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_pii_base_kinds():
    r = random.Random(4)
    texts = ["".join(r.choice("a@.+- 0123456789()x") for _ in range(r.randint(0, 90))) for _ in range(3000)]
    texts += ["mail a.b+c@x-y.co.uk. 4111 1111 1111 1111 +44 (20) 7946-0958 1.2.3.4 256.1.1.1", "@", "a@b", "1" * 5000]
    for text in texts:
        want = []
        for kind, pattern in PATTERNS.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
                if ok:
                    want.append((kind, *m.span()))
        assert sorted(pii.base_spans(text)) == sorted(want), text


def test_pii_context_and_redaction(spark):
    text = "My bank account: GB82 WEST 1234 5698 7654 32, ssn 219-09-9999, order 219-09-9998 ..." + "." * 60 + " 219-09-9997"
    kinds = [s[0] for s in pii.find_spans(text)]
    assert kinds.count("iban") == 1 and kinds.count("ssn") == 2
    assert pii.redact_text("x a@b.c y", pii.find_spans("x a@b.c y")) == "x <EMAIL> y"
    rows = pii.redacted_documents(odd_documents(spark).withColumn("n_chars", F.lit(9))).collect()
    assert len(rows) == len(ODD) and [r.text for r in rows if r.doc_id == 2] == [None]
    assert pii.detect(odd_documents(spark)).count() == len(ODD)


def test_pii_iban_beside_capitals():
    for iban in ("GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "NO93 8601 1117 947", "DE89370400440532013000"):
        for before, after in (("IBAN ", " BIC ABCDGB2L"), ("pay ", " USD 500"), ("XX12 ABCD 1234 5678 901 ", ""), ("", " NO93 8601 1117 948"), ("", "")):
            text = before + iban + after
            assert [text[a:b] for kind, a, b, _ in pii.find_spans(text) if kind == "iban"] == [iban], text
    two = "GB82 WEST 1234 5698 7654 32 NO93 8601 1117 947"
    assert [two[a:b] for kind, a, b, _ in pii.find_spans(two) if kind == "iban"] == [two[:27], two[28:]]
    assert not [s for s in pii.find_spans("GB82 WEST 1234 5698 7654 33 BIC") if s[0] == "iban"]


def test_bpe_like_tiktoken(spark):
    codec = bpe.codec(bpe.vocabulary_path(), bpe.default_pattern())
    reference = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(5)
    texts = ["", " ", "  x", "x \n y", "it's\tI'll", "a" * 3000, "<|endoftext|> 1½ ٣", "　x\u0085"] + ["".join(r.choice("abc  \n\t.é1\x1c'漢😀") for _ in range(r.randint(1, 60))) for _ in range(400)]
    texts += ["".join(r.choice("etaoinshr") for _ in range(600)) for _ in range(3)]
    texts += ["a" * 50_000, "".join(r.choice("acgt") for _ in range(2000)), "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(3000))]
    texts += [" ".join("".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(80)) for _ in range(1000))]
    ids = [np.frombuffer(x, np.int32) for x in codec.encode(texts)]
    assert [i.tolist() for i in ids] == [reference.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]
    rows = bpe.decode(bpe.encode(odd_documents(spark))).collect()
    assert sorted(bytes(x.decoded) for x in rows) == sorted((t or "").encode() for _, t in ODD)
    assert bpe.tokenised_documents(odd_documents(spark).limit(0)).collect() == []


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, monkeypatch):
    r = random.Random(6)
    base = [" ".join(r.choice("ab cd ef gh ij kl mn op".split()) for _ in range(r.randint(3, 9))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(base + base[:20] + [base[0] + " zz"])] + [(900, ""), (901, None), (902, "  "), (None, base[3]), (5, base[5])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    prints = [brute_fingerprint(t) for _, t in docs]
    up = list(range(len(docs)))
    for _ in docs:
        for i, x in enumerate(prints):
            for j, y in enumerate(prints):
                if (x ^ y).bit_count() <= 2:
                    up[i] = up[j] = min(up[i], up[j])
    least = {c: min((docs[i][0] for i in range(len(docs)) if up[i] == c and docs[i][0] is not None), default=None) for c in set(up)}
    want = sorted((str(d), p, str(least[u])) for (d, _), p, u in zip(docs, prints, up, strict=True))
    for tile in (4096, 3):  # small tiles: several to a group, compared by pairs
        monkeypatch.setattr(simhash, "TILE", tile)
        got = sorted((str(x.doc_id), x.fp % (1 << 64), str(x.component_id)) for x in simhash.near_duplicates(df).collect())
        assert got == want


def test_near_copies_stage(spark):
    r = random.Random(7)
    long = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(120)) for _ in range(8)]
    edit = lambda t, k: " ".join("EDITED" if i in k else w for i, w in enumerate(t.split()))
    docs = [(i, t) for i, t in enumerate(long)] + [(20, long[0]), (21, edit(long[1], {60})), (22, edit(long[2], set(range(0, 120, 3)))), (30, ""), (31, ""), (None, long[0])]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, source string")
    assert sorted(str(x.doc_id) for x in simhash.deduplicated_documents(df).collect()) == sorted(map(str, [*range(8), 22, 30, None]))


@pytest.mark.parametrize("tile", [8192, 8])  # whole groups, and groups in several tiles
def test_near_copies_stage_at_the_bound(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "STAGE_TILE", tile)
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(6))
    docs = []
    for i in range(600):  # n shingles, of which each of e edits takes 5: Jaccard 0.80 to 0.85
        n, e = ((45, 1), (90, 2), (225, 5), (60, 1), (300, 6), (615, 10))[i % 6]
        words = [word() for _ in range(n + 4)]
        at = {(n // e) * j + n // (2 * e) + 2 for j in range(e)}
        edited = [word() if j in at else w for j, w in enumerate(words)]
        one, two = (set(simhash.shingle_hashes(" ".join(w), 5, True).tolist()) for w in (words, edited))
        assert 0.8 <= len(one & two) / len(one | two) <= 0.851
        docs += [(i, " ".join(words)), (1000 + i, " ".join(edited))]
    base = [word() for _ in range(100)]
    docs += [(5000 + i, " ".join(base[:i] + [word()] + base[i + 1 :])) for i in range(100)]  # a large group
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    kept = sorted(x.doc_id for x in simhash.deduplicated_documents(df).collect())
    assert kept == [*range(600), 5000]


def test_decontamination(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    item = words[:30]
    edited = [w if i % 7 else "changed" for i, w in enumerate(item)]
    docs = [(1, " ".join(words[100:150] + item + words[150:200])), (2, " ".join(words[200:250] + edited)), (3, " ".join(words[200:300])), (4, None), (5, ""), (None, " ".join(item))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, ""), (9, None), (10, "never seen words here")], "item_id long, text string")
    found = {(x.doc_id, x.item_id): (x.score, x.start_word, x.end_word) for x in decontamination.matches(df, items).where("contaminated").collect()}
    assert set(found) == {(1, 7), (2, 7), (None, 7)} and found[(1, 7)] == (1.0, 50, 80)
    assert sorted(x.doc_id for x in decontamination.clean_documents(df, items).collect()) == [3, 4, 5]
    assert decontamination.matches(df, items.limit(0)).count() == 0 == decontamination.matches(df.limit(0), items).count()


def brute_align(item, passage):
    best, rows = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


def test_alignment():
    rng = np.random.RandomState(9)
    for _ in range(200):
        item, passage = rng.randint(0, 4, rng.randint(1, 15)), rng.randint(0, 4, rng.randint(1, 25))
        assert decontamination.align(item, passage)[0] == brute_align(item.tolist(), passage.tolist())


def test_quality(spark):
    r = random.Random(10)
    clean = lambda: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60))
    junk = lambda: " ".join(r.choice("%%% ### buy now free spam".split()) for _ in range(60))
    docs = [(i, clean() if i % 5 else junk()) for i in range(400)] + [(1000, None), (None, clean())]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    taken = {x.doc_id for x in resampling.selected_documents(df, labels).collect()}
    assert not any(i % 5 == 0 for i in taken if i is not None and i < 400)
    assert sum(i % 5 > 0 for i in range(400) if i in taken) >= 310 and {1000, None} <= taken
    assert resampling.selected_documents(df, labels.limit(0)).count() == len(docs)
    assert resampling.resample(df.limit(0), labels).collect() == []


@pytest.mark.parametrize("size", [400, 4000])
def test_quality_rejects_toxic(spark, size):
    r = random.Random(18)
    words = ["".join(r.choice("aeioulnrst") for _ in range(6)) for _ in range(3000)]
    prose = lambda: [words[int(3000 * r.random() ** 3)] for _ in range(r.choice([20, 150, 1200]))]
    bad = "scum moron idiot trash clown loser stupid worthless".split()
    toxic = {i for i in range(size) if i % 10 == 3}

    def text(i):
        out = prose()
        for _ in range(r.randint(2, 5) if i in toxic else 0):
            out.insert(r.randrange(len(out)), r.choice(bad))
        return " ".join(out)

    df = spark.createDataFrame([(i, text(i)) for i in range(size)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(size) if i % 20 < 10], "doc_id long, quality int, toxic int")
    taken = {x.doc_id for x in resampling.selected_documents(df, labels).collect()}
    assert not taken & toxic and len(taken) >= 0.97 * (size - len(toxic))


def test_quality_counts_each_ngram(spark, monkeypatch):
    words = [f"w{i}" for i in range(100_000)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 1000 : (i + 1) * 1000] + ["telling", "common"] * 40)) for i in range(100)] + [(200, None), (None, "telling x"), (3, "telling x")], "doc_id long, text string").repartition(3)
    fit = spark.createDataFrame([(i, False) for i in range(50)] + [(i, True) for i in range(50, 57)], "doc_id long, is_toxic boolean")
    one = lambda w: int(resampling._Hasher().keys(w)[0])
    monkeypatch.setattr(resampling, "COUNTED", 10_000)
    counts = {x.ngram: tuple(x)[1:] for x in resampling.models(docs, fit).collect()}
    assert counts[one("telling")] == (4002, 2001, 7, 51) and counts[resampling.ALL_WORDS][:2] == (108_004, 54_002)
    assert counts[resampling.ALL_DOCS] == (0, 0, 7, 51) and counts[resampling.ALL_PAIRS][:2] == (107_902, 53_951)
    assert len({k for w in range(100) for k in resampling._Hasher().keys(" ".join(words[w * 1000 : (w + 1) * 1000])).tolist()}) == 100_000 + 99_900
    ratios = spark.createDataFrame([(one("telling"), 1_500_000), (one("w7"), -2)], "ngram long, ratio long")
    rows = sorted(map(str, resampling.weights(docs, ratios).collect()))
    monkeypatch.setattr(resampling, "MOST_BROADCAST", 1)
    assert sorted(map(str, resampling.weights(docs, ratios).collect())) == rows and len(rows) == 103


def test_sample_follows_the_weights(spark):
    """Over many ids, Gumbel top-k takes documents about in proportion to their weights."""
    docs = spark.createDataFrame([(i, "heavy" if i % 2 else "light") for i in range(40_000)], "doc_id long, text string")
    key = int(resampling._Hasher().keys("heavy")[0])
    scored = resampling.weights(docs, spark.createDataFrame([(key, 1_098_612)], "ngram long, ratio long")).withColumn("decent", F.lit(True))  # weights 3 and 1
    taken = resampling.sampled(scored, 2000).where("selected").select("doc_id").collect()
    assert len(taken) == 2000 and 0.70 < sum(x.doc_id % 2 for x in taken) / 2000 < 0.80


def test_nth_smallest(spark):
    r = random.Random(11)
    values = [r.randint(-(1 << 62), 1 << 62) for _ in range(200)] + [5] * 10
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for n in (1, 77, 210):
        want = sorted(values)[n - 1]
        assert resampling.nth_smallest(df, "v", n) == (want, sum(v < want for v in values))
    assert resampling.nth_smallest(df, "v", 211) is None


def test_merkle(spark, monkeypatch):
    r = random.Random(12)
    docs = [(i * 2, "\n".join(" ".join("".join(r.choice("abcdef") for _ in range(4)) for _ in range(r.randint(1, 30))) for _ in range(r.randint(0, 6)))) for i in range(50)] + [(200, None), (201, ""), (None, "é" * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    order = sorted(docs, key=lambda d: -(1 << 62) if d[0] is None else -d[0])
    for rows_a_range in (4000, 7):
        monkeypatch.setattr(merkle, "RANGE_ROWS", rows_a_range)
        got = {x.doc_id: x for x in merkle.with_next(df).collect()}
        assert len(got) == len(docs)
        for at, (doc_id, text) in enumerate(order):
            text, following = text or "", order[(at + 1) % len(order)][1] or ""
            third = len(text) // 3
            changed = text[: len(text) - third] + following[:third]
            x = got[doc_id]
            assert (x.n_chars, x.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
            assert x.near_next == merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(following))
            assert (x.near_edited == 1.0) == (changed == text)
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("a")) == 0.0
    assert merkle.with_next(df.limit(0)).collect() == []
    assert merkle.differing(merkle.fingerprint("a\nb\nc"), merkle.fingerprint("a\nx\nc")) == [1]


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, str(SF)).collect()
    assert out and len({x.doc_id for x in out}) == len(out) and all(x.n_tokens == len(x.ids) for x in out)


def test_batches_put_together_and_split():
    rows = lambda *sizes: pa.RecordBatch.from_pydict({"text": ["x" * n for n in sizes]})
    given = [rows(), rows(10, 20), rows(5000), rows(*[100] * 50), rows(1)]
    out = list(batches(iter(given), 1000))
    assert [len(t) for b in out for t in b.column("text").to_pylist()] == [10, 20, 5000, *[100] * 50, 1]
    assert all(b.nbytes <= 1000 or b.num_rows == 1 for b in out) and len(out) <= 10
    assert list(batches(iter([]))) == []
