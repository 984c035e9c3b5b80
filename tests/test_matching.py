"""Matching, absorbing, gazetteer, subjects, story upserts and versions against sequential brute force."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import absorb, chains, gazetteer, stories
from tidewire.operators.checkpoint import cut
from tidewire.sources import versions

ROW = "id long, kind string, name string, members array<string>"
STOP = set(T.TREND_STOP_WORDS)


def counts(name):
    return Counter(w for w in re.findall("[a-z0-9]{2,}", name.lower()) if w not in STOP)


def cosine(a, b):
    a, b = counts(a), counts(b)
    if not a or not b:
        return 0.0
    return sum(n * b[w] for w, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def containment(a, b):
    a, b = set(a), set(b)
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def some_rows(seed, n=60):
    r = random.Random(seed)
    words = ["rate", "cut", "bank", "rise", "of", "ai", "chip", "export", "the", "oil", "storm", "vote"]
    return [(i, r.choice("ab"), " ".join(r.choices(words, k=r.randint(0, 4))), sorted({f"m{r.randint(0, 70)}" for _ in range(r.randint(0, 5))})) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_similarity_joins(spark, seed):
    rows, others = some_rows(seed), some_rows(seed + 10)
    left, right = spark.createDataFrame(rows, ROW), spark.createDataFrame(others, ROW)
    found = {tuple(x) for x in absorb.similar_names(left.select("id", "name"), right.select("id", "name")).collect()}
    assert found == {(a[0], b[0]) for a in rows for b in others if cosine(a[2], b[2]) >= 0.6 - 1e-12}
    members = lambda f: f.select("id", F.explode("members").alias("member"))
    found = {tuple(x) for x in absorb.contained(members(left), members(right)).collect()}
    assert found == {(a[0], b[0]) for a in rows for b in others if containment(a[3], b[3]) >= 0.5}
    found = {tuple(x) for x in absorb.contained(members(left), members(right), 0.6, directed=True).collect()}
    assert found == {(a[0], b[0]) for a in rows for b in others if a[3] and len(set(a[3]) & set(b[3])) >= 0.6 * len(a[3]) - 1e-9 and set(a[3]) & set(b[3])}


def fold(rows, renew, held=()):
    """Rows in order; the sequential rule."""
    kept, out = [], {}
    for i, kind, name, members in rows:
        hit = None
        if i not in held:
            for k in kept:
                same_key = not renew and re.sub("[^a-z0-9]+", " ", name.lower()).strip() and re.sub("[^a-z0-9]+", " ", name.lower()).strip() == re.sub("[^a-z0-9]+", " ", k[4].lower()).strip()
                if k[1] == kind and (same_key or cosine(name, k[2]) >= 0.6 - 1e-12 or containment(members, k[3]) >= 0.5):
                    hit = k
                    break
        if hit is None:
            kept.append([i, kind, name, set(members), name])
            out[i] = i
        else:
            out[i] = hit[0]
            hit[3] |= set(members)
            if renew:
                hit[2] = name
    return out, {k[0]: sorted(k[3]) for k in kept}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_absorb_is_the_sequential_fold(spark, seed):
    rows = some_rows(seed)
    frame = spark.createDataFrame(rows, ROW).repartition(3)
    for renew in (False, True):
        by, ends = fold(rows[::-1], renew)
        out = absorb.absorb(frame, [-F.col("id")], cut, "kind", renew=renew).collect()
        assert {x.id: x.kept_by for x in out} == by
        assert {x.id: x.members for x in out if x.id == x.kept_by} == ends
    held = {i for i, *_ in rows if i % 3 == 0}
    by, ends = fold([r for r in rows if r[0] in held] + [r for r in rows if r[0] not in held], True, held)
    out = absorb.absorb(frame.withColumn("old", F.col("id") % 3 == 0), [], cut, "kind", renew=True, stored="old").collect()
    assert {x.id: x.kept_by for x in out} == by and {x.id: x.members for x in out if x.id == x.kept_by} == ends


def test_reworded_trend_keeps_its_row_and_comes_back(spark):
    stored = [(1, "macro", "RBI tightens lending rules", ["a", "b"], None), (2, "macro", "Oil prices climb", ["c"], None), (3, "macro", "AI chip export curbs", ["d", "e", "f", "g"], "2024-01-20"), (4, "macro", "Old monsoon story", ["z"], "2023-10-01")]
    fresh = [(11, "macro", "Lending rules tightened by RBI", ["x"]), (12, "macro", "New export curbs on chips", ["d", "e"]), (13, "macro", "Elections in Brazil", ["q"])]
    old = spark.createDataFrame(stored, "id long, kind string, name string, members array<string>, gone string").select("id", "kind", "name", "members", F.col("gone").cast("timestamp").alias("retired_at"))
    new = spark.createDataFrame(fresh, ROW)
    now = F.lit("2024-02-01").cast("timestamp")
    out = {(x.id, x.fresh_id): (x.action, x.members) for x in absorb.reconcile_fuzzy(old, new, now, cut, "kind", merge_members=True).collect()}
    assert out == {(1, 11): ("update", ["a", "b", "x"]), (3, 12): ("revive", ["d", "e", "f", "g"]), (None, 13): ("insert", ["q"]), (2, None): ("retire", ["c"]), (4, None): ("purge", ["z"])}
    failed = {x.id: x.action for x in absorb.reconcile_fuzzy(old, new.limit(0), now, cut, "kind", prune=False).collect()}
    assert failed == {1: "keep", 2: "keep", 3: "stay", 4: "stay"}


def test_first_matches_in_order(spark):
    r = random.Random(9)
    pairs = sorted({(r.randint(0, 30), r.randint(0, 30)) for _ in range(90)})
    taken, want = set(), []
    for a in sorted({a for a, _ in pairs}):
        hit = next((b for x, b in pairs if x == a and b not in taken), None)
        if hit is not None:
            taken.add(hit)
            want.append((a, hit))
    assert sorted(tuple(x) for x in absorb.first_matches(spark.createDataFrame(pairs, "a long, b long"), cut).collect()) == want


def extraction(i, entities, sectors, regions):
    return (i, i, entities, sectors, regions)


EXTRACTION = "id long, at long, entities array<string>, sectors array<string>, regions array<string>"


def test_gazetteer_answers_only_what_it_knows(spark):
    memory = gazetteer.learn(spark.createDataFrame([extraction(1, ["Reserve Bank of India", "HDFC Bank"], ["banking"], ["India"]), extraction(2, ["HDFC bank"], [], []), extraction(3, ["Tata Steel", "Ltd"], [], ["India"])], EXTRACTION))
    known = {(x.kind, x.norm): x for x in memory.collect()}
    assert known["entities", "hdfc bank"].term == "HDFC Bank" and known["entities", "hdfc bank"].seen == 2 and known["entities", "hdfc bank"].sectors == ["banking"]
    assert ("entities", "ltd") not in known and known["entities", "reserve bank india"].tokens == ["reserve", "bank", "india"]
    asked = [
        (1, "HDFC Bank fined by Reserve Bank of India", "The regulator acted over India lending rules."), (2, "HDFC Bank to merge with Zeptolytics", "India deal."), (3, "Cabinet clears policy", "No names."),
        (4, "HDFC Bank names new chief", "Reserve Bank of India cleared it."), (5, "all lower case", None), (6, "Tata Steel cuts output", "and banks wait"), (7, None, None),
    ]
    articles = spark.createDataFrame(asked, "id long, title string, summary string")
    out = {x.id: x for x in gazetteer.match(articles, memory).collect()}
    assert {i: x.reason for i, x in out.items()} == {1: "matched", 2: "unknown_anchors:1", 3: "no_known_entity", 4: "matched", 5: "no_anchors", 6: "no_sector", 7: "no_anchors"}
    assert out[1].entities == ["Reserve Bank of India", "HDFC Bank"] and out[1].sectors == ["banking"] and out[1].regions == ["India"] and out[2].entities is None
    assert {x.reason for x in gazetteer.match(articles, memory.limit(0)).collect()} == {"empty_gazetteer"}
    expected = spark.createDataFrame([(1, ["HDFC bank", "Infosys"]), (4, ["Reserve Bank of India", "hdfc Bank"])], "id long, entities array<string>")
    assert [tuple(x) for x in gazetteer.shadow(expected, gazetteer.match(articles, memory)).collect()] == [(1, ["infosys"], ["reserve bank india"])]


def test_gazetteer_merge_keeps_first_spelling_and_last_association(spark):
    first = gazetteer.learn(spark.createDataFrame([extraction(1, ["HDFC Bank"], ["banking"], [])], EXTRACTION))
    second = gazetteer.learn(spark.createDataFrame([extraction(5, ["HDFC BANK"], ["finance"], ["India"]), extraction(6, ["HDFC BANK"], [], [])], EXTRACTION))
    x = gazetteer.merge(first, second).where("kind = 'entities'").first()
    assert (x.term, x.seen, x.sectors, x.regions, x.first_seen, x.last_seen) == ("HDFC Bank", 3, ["finance"], ["India"], 1, 6)


def test_subjects_in_tiles_and_with_a_reference(spark):
    r = random.Random(4)
    topics = [["Kathmandu quake homes destroyed", "Nepal Army Pokhara rescue"], ["Sensex Nifty rally traders", "Mumbai stocks gains"], ["Lisbon tram strike", "Portugal unions pay"]]
    rows = []
    for i in range(40):
        a, b = topics[i % 3] if i < 36 else (f"Lone{i} item{i}", "")
        words = (a + " " + b).split()
        rows.append((7 if i < 30 else 8, i, " ".join(r.sample(words, 4)) if i < 36 else a, " ".join(words) if i < 36 else None))
    frame = spark.createDataFrame(rows, "story long, id long, title string, summary string")
    model = stories.rarity(spark.createDataFrame([(100 + i, f"other words {i}", "quite another reference") for i in range(50)] + [(i, t, s) for _, i, t, s in rows], "id long, title string, summary string"))
    whole = sorted(map(tuple, stories.subjects(frame, model, cut).collect()))
    assert whole == sorted(map(tuple, stories.subjects(frame, model, cut, tile=5).collect()))
    subject = {(s, i): (x, k) for s, i, x, k in whole}
    assert {subject[7, i][0] for i in range(0, 30, 3)} == {0} and {subject[7, i][0] for i in range(1, 30, 3)} == {1}
    assert all(subject[7, i][1] == (i % 3 == 0) for i in range(30)) and subject[8, 38] == (38, False)
    unseen = {x.term: x.w for x in stories.rare_vectors(spark.createDataFrame([(1, "zz unseen", None)], "id long, title string, summary string"), model).collect()}
    assert len(set(unseen.values())) == 1  # terms that the reference lacks weigh alike


def test_terms_are_counted_where_an_article_lies(spark):
    from tidewire.operators import similarity

    counted = similarity.term_counts(spark.createDataFrame([(1, "Quake hits quake hits", "A quake in Nepal"), (2, None, None)], "id long, title string, summary string"))
    assert {(x.id, x.term): x.tf for x in counted.collect()} == {(1, "quake"): 7, (1, "hits"): 6, (1, "quake_hits"): 6, (1, "hits_quake"): 3, (1, "nepal"): 1}
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_stored_and_built_chains_come_of_one_pass(spark, monkeypatch):
    from tests.oracle import SF
    from tidewire.plans import matching

    if not SF.exists():
        pytest.skip("needs the generated tables")
    read, load = [], matching.t.load
    monkeypatch.setattr(matching.t, "load", lambda spark, sf_dir, name: read.append(name) or load(spark, sf_dir, name))
    assert matching.chain_upsert(spark, str(SF)).columns[0] == "signature"
    assert read.count("lineitem") == 1


def test_story_upsert_rules(spark):
    prior = [(1, 101, ["a", "b"], ["t1"]), (2, None, ["c", "d"], []), (3, None, [f"x{i}" for i in range(30)] + ["e"], ["t2"]), (4, None, ["a"], ["dead"]), (5, 104, ["g"], ["t1"]), (6, None, ["h"], ["t2"])]
    events = [(101, ["a", "b", "n1"], ["t1"]), (102, ["c", "n2"], []), (103, ["e"], ["t2"]), (104, ["g"], ["t1", "t2"]), (105, ["n3", "h"], ["t2"]), (106, [], ["t1"]), (107, ["n4"], ["t1"])]
    kinds = "event_id long, article_ids array<string>, trend_ids array<string>"
    out = stories.upsert(spark.createDataFrame(prior, "id long, " + kinds), spark.createDataFrame(events, kinds), spark.createDataFrame([("t1",), ("t2",)], "id string"), cut).collect()
    told = {(x.story_id, x.event_id): (x.action, x.article_ids, x.trend_ids, x.absorbed_by) for x in out}
    assert told[1, 101] == ("update", ["a", "b", "n1"], ["t1"], None)
    assert told[2, 102] == ("update", ["c", "d", "n2"], [], None)
    assert told[None, 103][0] == "covered"  # the blob is no story of it, but has told it
    assert told[5, 104] == ("relabel", ["g"], ["t1", "t2"], None)
    assert told[6, 105][0] == "update" and told[None, 107] == ("insert", ["n4"], ["t1"], None)
    assert told[4, None] == ("absorb", ["a"], ["dead"], 101) and told[3, None][0] == "keep"
    assert len(told) == len(out) == 8


def test_versions_survive_a_killed_write(spark, tmp_path):
    path = f"file://{tmp_path}/stories"
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    assert versions.commit_version(spark.range(3), path, 0) == 1
    spark.range(9).write.parquet(f"{path}/data/000000000002-killed")  # data without its manifest
    (tmp_path / "stories" / "_manifests" / "0123.draft").write_text("{")  # a manifest cut off
    assert versions.read_version(spark, path).count() == 3
    assert versions.commit_version(versions.read_version(spark, path).union(spark.range(2)), path, 1) == 2
    with pytest.raises(versions.Conflict):
        versions.commit_version(spark.range(1), path, 1)
    assert versions.read_version(spark, path).count() == 5 and versions.read_version(spark, path, 1).count() == 3
    versions.commit_version(spark.range(1), path, 2)
    assert versions.expire(spark, path, keep=2) == 1
    assert [v for v, _ in versions.versions(spark, path)] == [2, 3] and len(list((tmp_path / "stories" / "data").iterdir())) == 2


def test_sets_meet_by_two_members(spark):
    """sets that share one member only are no candidates where two are needed, however many have it."""
    rows = [(i, m) for i in range(400) for m in (f"x{i % 20}", f"y{i // 20}", f"z{i}")]
    own = spark.createDataFrame(rows, "id int, member string")
    found, _ = absorb.candidates(own, own, 0.6, True)
    assert found.count() == 400  # each with itself; 7,980 pairs share one member
    wide = spark.createDataFrame([(1000, m) for m in ("x1", "y1", *map(str, range(40)))] + [(1001, "x1"), (1001, "y1"), (1001, "q")], "id int, member string")
    assert {tuple(r) for r in absorb.contained(wide, wide).collect()} == {(1000, 1000), (1000, 1001), (1001, 1000), (1001, 1001)}


def test_absorb_joins_distinct_names(spark, monkeypatch):
    """copies of a name meet through one of them, and the fold takes the first kept row by name, key or members."""
    rows = [(i, "a", ["oil price storm", "storm oil price", "chip export vote", "oil price"][i % 4], [f"m{i}", f"n{i % 7}", f"o{i % 5}"]) for i in range(80)]
    sizes, join = [], absorb.similar_names
    monkeypatch.setattr(absorb, "similar_names", lambda left, right, **more: sizes.append(left.count()) or join(left, right, **more))
    out = {x.id: x.kept_by for x in absorb.absorb(spark.createDataFrame(rows, ROW), [], cut, "kind", renew=True).collect()}
    assert sizes == [3]
    assert out == fold(rows, True)[0]


def test_fuzzy_matches_meet_by_keys(spark, monkeypatch):
    """rows that share a line or a name are queued by it instead of paired; the least stored row not taken before is taken."""
    rows = [(i, k, n, m + (["everyone"] if i % 2 else []) + (["most"] if i % 3 else [])) for i, k, n, m in some_rows(21, 120)] + [(200 + i, "a", "storm oil storm", [f"q{i}"]) for i in range(30)]
    stored, fresh = [r for r in rows if r[0] % 5 < 2], [r for r in rows if r[0] % 5 >= 2]
    taken, want = set(), {}
    for f in fresh:
        hit = next((s[0] for s in stored if s[0] not in taken and s[1] == f[1] and (cosine(s[2], f[2]) >= 0.6 - 1e-12 or containment(s[3], f[3]) >= 0.5)), None)
        if hit is not None:
            taken.add(hit)
            want[f[0]] = hit
    sizes, join = [], absorb.similar_names
    monkeypatch.setattr(absorb, "similar_names", lambda left, right, **more: sizes.append((left.count(), right.count())) or join(left, right, **more))
    old = spark.createDataFrame(stored, ROW).withColumn("retired_at", F.lit(None).cast("timestamp"))
    out = absorb.reconcile_fuzzy(old, spark.createDataFrame(fresh, ROW), F.lit("2024-02-01").cast("timestamp"), cut, "kind").collect()
    assert {x.fresh_id: x.id for x in out if x.fresh_id is not None and x.id is not None} == want
    distinct = lambda side: len({(k, tuple(sorted(counts(n).items()))) for _, k, n, _ in side if counts(n)})
    assert sizes == [(distinct(fresh), distinct(stored))]


def test_names_in_tiles(spark, monkeypatch):
    """long names of common words are compared in tiles, by exact counts behind a bound in which words share columns."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    names = [(i, " ".join(r.choices(words[:40], k=r.randint(3, 30)) + r.sample(words, 5))) for i in range(90)]
    frame = spark.createDataFrame(names, "id long, name string")
    monkeypatch.setattr(absorb.tiles, "CHUNK", 7)
    spread = absorb.tiles.paired
    monkeypatch.setattr(absorb.tiles, "paired", lambda left, right, by=None: spread(left, right, by, 16))
    want = {(a, b) for a, x in names for b, y in names if cosine(x, y) >= 0.6 - 1e-12}
    assert {tuple(x) for x in absorb.similar_names(frame, frame).collect()} == want and len(want) > len(names)


def test_pairs_of_large_sets_are_not_spelled_out(spark):
    """only sets that fit into one of few members meet it by pairs of members; a blob's pairs would be its size squared."""
    blob = spark.range(30_000).select(F.lit(0).cast("long").alias("id"), F.concat(F.lit("m"), "id").alias("member"))
    small = spark.createDataFrame([(1, [f"m{i}" for i in range(3)]), (2, ["m0", "m1", "x"]), (3, [f"m{i}" for i in range(40)])], "id long, m array<string>").select("id", F.explode("m").alias("member"))
    began = time.perf_counter()
    assert {tuple(r) for r in absorb.contained(small, blob).collect()} == {(1, 0), (2, 0), (3, 0)}
    assert {tuple(r) for r in absorb.contained(blob, small, 0.6, directed=True).collect()} == set()
    assert time.perf_counter() - began < 60  # 112 million keys before


def test_first_matches_settle_sure_pairs_at_once(spark):
    """pairs that are each other's first are taken without a pass of their own, and what is left is matched as in order."""
    r = random.Random(13)
    for most in (4, 12, 60):
        pairs = sorted({(r.randint(0, most), r.randint(0, most)) for _ in range(60)})
        taken, expected = set(), set()
        for a in sorted({a for a, _ in pairs}):
            b = min((y for x, y in pairs if x == a and y not in taken), default=None)
            if b is not None:
                taken.add(b)
                expected.add((a, b))
        assert {tuple(x) for x in absorb.first_matches(spark.createDataFrame(pairs, "a long, b long"), cut).collect()} == expected
    alone = absorb.first_matches(spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 10_000).alias("b")), cut)
    assert alone.count() == 3000


def test_sectors_of_chains_take_first_places_only(spark):
    """a chain's sectors come of the first place of each, not of a list of all its stories' sectors."""
    r = random.Random(18)
    told = {i: [r.choice(["Eco", "steel", "tin", "", None]) for _ in range(r.randint(0, 4))] for i in range(40)}
    rests = {f"c{i}": r.sample(range(45), r.randint(1, 8)) for i in range(30)} | {"none": [1000], "blank": [100]}
    told[100] = ["", None]
    want = {}
    for name, ids in rests.items():
        if any(i in told for i in ids):
            want[name] = list(dict.fromkeys(s for i in ids for s in told.get(i, []) if s))[:2]
    rows = spark.createDataFrame(list(rests.items()), "signature string, story_ids array<long>")
    found = chains.sectors_of(rows, spark.createDataFrame(list(told.items()), "id long, sectors array<string>"), 2)
    assert {x.signature: x.sectors for x in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "min(" in plan  # sorted all of a chain's lists by a lambda before


def test_like_names_are_joined_by_a_forest(spark, monkeypatch):
    """where most names are alike, only as many pairs are told as join them up; the pass compares them itself, with kept rows' names of the time."""
    r = random.Random(31)
    common = "rate bank rise chip export oil storm vote".split()
    rows = [(i, "ab"[i % 2], " ".join([*common, *r.sample([f"w{j}" for j in range(30)], r.randint(1, 9))]), [f"m{r.randint(0, 400)}" for _ in range(r.randint(0, 4))]) for i in range(300)]
    told, join = [], absorb.similar_names
    monkeypatch.setattr(absorb, "similar_names", lambda left, right, **more: told.append(cut(join(left, right, **more))) or told[-1])
    monkeypatch.setattr(absorb, "LOOKED", 7)
    frame, held = spark.createDataFrame(rows, ROW), {i for i, *_ in rows if i % 5 == 0}
    for renew in (False, True):
        by, ends = fold([x for x in rows if x[0] in held] + [x for x in rows if x[0] not in held], renew, held)
        out = absorb.absorb(frame.withColumn("old", F.col("id") % 5 == 0), [], cut, "kind", renew=renew, stored="old").collect()
        assert {x.id: x.kept_by for x in out} == by and {x.id: x.members for x in out if x.id == x.kept_by} == ends
        assert told[-1].where("a <> b").count() < 2 * len(rows)  # the pairs are some 30,000


@pytest.mark.parametrize("seed", range(6))
def test_growing_sets_meet_by_rare_members(seed):
    """rows find the least kept set by members that are rare in either, whatever the sets have grown to; all that have a popular one were counted before."""
    r = random.Random(seed)
    sets = [sorted({*r.sample(["every", "most", "many"], r.randint(0, 3)), *(f"m{int(r.paretovariate(0.4)) % 60}" for _ in range(r.randint(0, 9)))}) for _ in range(400)]
    kept, own = absorb.Kept(sets), []
    for i, s in enumerate(sets):
        want = next((k for k, x in enumerate(own) if s and x and len(x & set(s)) >= absorb.OVERLAP * min(len(s), len(x))), None)
        assert kept.least(i, absorb.NOWHERE) == (absorb.NOWHERE if want is None else want)
        if want is None or r.random() < 0.3:
            assert kept.add(i) == len(own)
            own.append(set(s))
        else:
            k = r.choice([want, r.randrange(len(own))])
            kept.grow(k, i)
            own[k] |= set(s)


def test_small_components_share_a_pass(spark):
    """rows that nothing ties to others need no pass, and components are taken to passes together; a group each took a minute for 26,000 rows."""
    rows = spark.range(20_000).select("id", F.lit("a").alias("kind"), F.concat(F.lit("n"), F.floor(F.col("id") / 2)).alias("name"), F.array(F.concat(F.lit("m"), "id")).alias("members"))
    out = absorb.absorb(rows, [], cut, "kind")
    assert out.where("kept_by = id - id % 2").count() == 20_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [bucket" in plan


def test_fuzzy_matches_compare_names_in_the_pass(spark, monkeypatch):
    """where most names are alike no pair of them is written; each fresh row takes the least stored one left, by name, key or members."""
    r = random.Random(34)
    common = "rate bank rise chip export oil storm vote".split()
    rows = [(i, "ab"[i % 2], " ".join([*common[: r.randint(1, 8)], *r.sample([f"w{j}" for j in range(8)], r.randint(0, 4))]) if i % 11 else "", [f"m{r.randint(0, 60)}" for _ in range(r.randint(0, 5))]) for i in range(240)]
    stored, fresh = [x for x in rows if x[0] % 5 < 2], [x for x in rows if x[0] % 5 >= 2]
    taken, want = set(), {}
    for f in fresh:
        hit = next((s[0] for s in stored if s[0] not in taken and s[1] == f[1] and (cosine(s[2], f[2]) >= 0.6 - 1e-12 or containment(s[3], f[3]) >= 0.5)), None)
        if hit is not None:
            taken.add(hit)
            want[f[0]] = hit
    told, join = [], absorb.similar_names
    monkeypatch.setattr(absorb, "similar_names", lambda left, right, **more: told.append(cut(join(left, right, **more))) or told[-1])
    monkeypatch.setattr(absorb, "LOOKED", 7)
    old = spark.createDataFrame(stored, ROW).withColumn("retired_at", F.lit(None).cast("timestamp"))
    out = absorb.reconcile_fuzzy(old, spark.createDataFrame(fresh, ROW), F.lit("2024-02-01").cast("timestamp"), cut, "kind").collect()
    assert {x.fresh_id: x.id for x in out if x.fresh_id is not None and x.id is not None} == want
    assert told[0].count() < len(rows) < sum(cosine(s[2], f[2]) >= 0.6 for s in stored for f in fresh if s[1] == f[1])


def test_tiles_are_laid_down_once(spark):
    """a row lies in one tile and is not copied for the tiles of the other side; pairs of tiles read what lies."""
    left = spark.range(200).select("id", F.lit("x").alias("words"))
    pairs = absorb.tiles.paired(left, spark.range(300, 400).select("id", F.lit("y").alias("words")), None, 32)
    met = [(a.id, b.id) for x in pairs.collect() for a in x.one for b in x.other]
    assert len(met) == len(set(met)) == 20_000
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Generate" not in plan
