"""Ball k-means, compression toxicity and conversation repair against brute force."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tests.oracle import SF, spark_rows, sql_rows
from tidewire.llm import ball_kmeans, toxicity, turns

ROWS = "conv_id long, turn long, role string, text string"


def lloyd(vectors, k, rounds, seed="2:"):
    """Exhaustive Lloyd over {id: integers}."""
    order = sorted(vectors, key=lambda i: hashlib.sha256(f"{seed}{i}".encode()).hexdigest())
    centroids = [list(vectors[i]) for i in order[:k]]
    for done in range(rounds + 1):
        at = {}
        for i, v in vectors.items():
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            at[i] = (d.index(min(d)), min(d))
        if done == rounds:
            return at, centroids
        for c in range(len(centroids)):
            own = [vectors[i] for i in vectors if at[i][0] == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]


@pytest.mark.parametrize("k,size,n,spread", [(5, 3, 200, 2), (8, 2, 300, 40), (3, 4, 2, 5), (12, 2, 400, 1)])
def test_ball_kmeans_is_lloyd(spark, k, size, n, spread):
    r = random.Random(k)
    rows = [(i, [float(r.randint(-spread, spread) + 10 * (i % 3)) / 16 for _ in range(size)], "x") for i in range(n)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string").repartition(3)
    found, centroids = ball_kmeans.ball_kmeans(frame, k, 4, size)
    want, means = lloyd({i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows}, k, 4)
    assert {x.vec_id: (x.cluster, x.distance) for x in found.collect()} == want
    assert centroids.tolist() == means


def test_ball_kmeans_odd_vectors(spark):
    rows = [(1, [0.5, None]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 2.0]), (6, [3.0e38, -3.0e38]), (7, [1.0, 2.0]), (7, [1.0, 2.0])]
    found, _ = ball_kmeans.ball_kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2, 2, 2)
    assert sorted(str(x.vec_id) for x in found.collect()) == ["6", "7", "7", "None"]
    empty, centroids = ball_kmeans.ball_kmeans(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.count() == 0 and len(centroids) == 0


@pytest.mark.skipif(not SF.exists(), reason="needs the generated tables")
def test_op11_against_its_sql(spark):
    assert spark_rows(ball_kmeans.op11_ball_kmeans(spark, str(SF))) == sql_rows(ball_kmeans.OP11_SQL)


def cheapest(rows):
    """(cost, audit, repaired) by searching all edits, least cost first, then least audit."""
    seen, found = set(), None
    flagged, keys = [], set()
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        flagged.append((role, text, 1 if not last else 2 if (role, text) in keys else 3 if last[-1] not in ".!?" else 0))
        keys.add((role, text))
    heap = [(0, "", 0, "", ())]  # cost, audit, rows taken, initials, repaired
    while heap:
        cost, audit, i, initials, repaired = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in repaired), flagged
        state = (i, initials[-1:], bool(initials))
        if state in seen:
            continue
        seen.add(state)

        def go(more, letter, j, row):
            grown = initials + row[0][:1] if row else initials
            if re.fullmatch("s?(ua)*u?", grown):
                heapq.heappush(heap, (cost + more, audit + letter, j, grown, (*repaired, row) if row else repaired))

        for role in ("user", "assistant"):
            go(5, "I", i, (role, ""))
        if i < len(rows):
            role, text, wrong = flagged[i]
            go(2, "D", i + 1, None)
            if wrong in (0, 3):
                more = 5 if wrong else 0
                go(more, "K", i + 1, (role, text))
                for other in ("user", "assistant"):
                    go(more + 1, "R", i + 1, (other, text))
    return found


def random_rows(r, n):
    return [(r.choice(["user", "assistant", "system", "tool", " ", "user", "assistant"]), r.choice(["Hi.", "Yes!", "no", "", " \n", "Well? ", f"t{r.randint(0, 9)}."])) for _ in range(n)]


def test_repair_is_cheapest():
    r = random.Random(5)
    for n in [*range(9)] * 25:
        rows = random_rows(r, n)
        cost, audit, text, flagged = cheapest(rows)
        assert turns._flagged(rows) == flagged
        mine = turns.repair(flagged)
        assert (mine[0], mine[1], "\n".join(f"{role}:{t}" for letter, role, t in mine[2] if letter != "D")) == (cost, audit, text), rows


def test_damage_and_repair_of_rows(spark):
    r = random.Random(8)
    rows = [(c, t, role, text) for c in [1, 2, 3, None] for t, (role, text) in enumerate(random_rows(r, 12))]
    rows += [(4, None, None, None), (4, 3, "user", "Hm."), (4, 3, "user", "Hm."), (5, 7, "assistant", "A. B!"), (4, -2, "", "x")]
    frame = spark.createDataFrame([(*x, 1) for x in rows], ROWS + ", kind int").repartition(3)
    want: dict = {}
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for ways in ({}, {"most_rows": 3, "block_rows": 2}):
        found = {x.conv_id: x for x in turns.repaired(turns.damaged(frame), **ways).collect()}
        assert set(found) == {c for c in want if want[c]}
        for conv, x in found.items():
            own = sorted(want[conv], key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))
            cost, audit, text, flagged = cheapest([y[1:] for y in own])
            at = [y[0] for y in own if y[0] is not None]
            wrong = [f for *_, f in flagged]
            illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (_, a, _), (_, b, _) in itertools.pairwise(own))
            gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
            assert tuple(x) == (conv, gaps, wrong.count(1), wrong.count(2), wrong.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), (conv, ways)
        told = turns.repaired_turns(turns.damaged(frame), **ways).collect()
        for conv in found:
            text = "\n".join(f"{x.role}:{x.text}" for x in sorted(told, key=lambda x: x.place) if x.conv_id == conv)
            assert hashlib.sha256(text.encode()).hexdigest() == found[conv].repaired_sha256


def test_long_conversation_by_blocks(spark):
    r = random.Random(11)
    rows = [(1, t, *x) for t, x in enumerate(random_rows(r, 400))] + [(2, t, *x) for t, x in enumerate(random_rows(r, 5))]
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    whole = sorted(map(tuple, turns.repaired(frame).collect()))
    assert whole == sorted(map(tuple, turns.repaired(frame, most_rows=100, block_rows=16).collect()))
    assert whole == sorted(map(tuple, turns.repaired(frame, most_chars=900, block_rows=7).collect()))


def test_no_conversations(spark):
    assert turns.repaired(turns.damaged(spark.createDataFrame([], ROWS))).count() == 0
    assert turns.repaired_turns(spark.createDataFrame([], ROWS)).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="needs the generated tables")
def test_op13_returns_every_conversation(spark, tmp_path):
    rows = [(c, t, "user", "Yes.") for c in range(400) for t in range(1 + c % 2)]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {x.conv_id: x for x in turns.op13_turns(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(400))
    gone = [c for c in range(400) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in range(1 + c % 2))]
    assert gone
    for c in gone:
        assert tuple(out[c])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turns.op13_turns(spark, str(SF)).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def toxic_rows(n, seed=1):
    r = random.Random(seed)
    plain_words = ["".join(r.choice(["ba", "ke", "li", "mo", "nu", "ta", "re"]) for _ in range(r.randint(2, 4))) for _ in range(300)]
    bad = ["scoundrel", "nincompoop", "blackguard", "dunderhead"]
    rows = []
    for i in range(n):
        words = [r.choice(plain_words) for _ in range(r.randint(20, 80))]
        toxic = int(r.random() < 0.3)
        for _ in range(2 + len(words) // 20 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(900)
    docs = spark.createDataFrame([(i, t, "en", i) for i, t, _ in rows], "doc_id long, text string, lang string, score int").repartition(3)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = {x.doc_id: x for x in toxicity.scored(docs, toxicity.trained(docs, labels)).collect()}
    held = [(x, t) for i, _, t in rows for x in [found[i]] if x.held_out]
    assert {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0} == {x.doc_id for x, _ in held}
    assert sum(x.predicted == t for x, t in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in found.values())


def test_toxicity_of_odd_texts(spark):
    rows = toxic_rows(600)
    model = toxicity.fit([(zlib.crc32(str(i).encode()) % 5, t, " ".join(toxicity.words_of(x))) for i, x, t in rows if zlib.crc32(str(i).encode()) % 5])
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "12 34"), (4, "x" * 300_000), (4, "x" * 300_000), (5, "nincompoop dunderhead " * 50_000)], "doc_id long, text string")
    out = [(x.doc_id, x.score, x.predicted) for x in toxicity.scored(docs, model).collect()]
    assert len(out) == 6 and all(0 <= s <= 1 for _, s, _ in out)
    assert {s for i, s, _ in out if i in (1, 2, None)} == {model.score(np.zeros(0))}
    assert next(p for i, _, p in out if i == 5) == 1
    assert toxicity.fit([]).score(np.zeros(0)) == 0.0
    assert toxicity.fit([(1, 0, "a"), (4, 0, "b")]).score(np.ones(3)) == 0.0
    one_kind = toxicity.scored(docs, toxicity.trained(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert {x.score for x in one_kind.collect()} == {0.0}


