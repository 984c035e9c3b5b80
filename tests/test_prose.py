"""Cleaning, sentences, pages and briefs against hand-made cases."""

import pandas as pd
from pyspark.sql import functions as F

from tidewire.functions import prose as P
from tidewire.functions import text as T
from tidewire.operators import similarity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clean(spark):
    cases = {
        "<p>Rates &amp;amp; prices</p> rise. Read more at https://x.example/y": "Rates & prices rise.",
        "NEW DELHI, Jan 5 (AP) — Banks cut rates": "NEW DELHI, Jan 5 Banks cut rates",
        "LONDON — Shares rose": "Shares rose",
        "MUMBAI (Reuters) - Sensex gains &rarr; 3&frac12; &eacute;t&eacute; &#8364;5 &#x41;": "MUMBAI Sensex gains → 3½ été €5 A",
        "Photo: someone. Quake hits. Sign up today for more. Copyright © 2024 X": ". Quake hits.",
        "  -- | A b •": "A b",
        None: "",
    }
    for text, want in cases.items():
        assert one(spark, P.clean(F.lit(text).cast("string"))) == want, text


def test_sentences(spark):
    assert one(spark, P.sentences(F.lit("Mr. Bose spoke. Rates rose! Why? No one knows. it went on."))) == ["Mr. Bose spoke.", "Rates rose!", "Why?", "No one knows. it went on."]
    assert one(spark, P.sentences(F.lit(None).cast("string"))) == []
    assert not P.reports("Too short.") and not P.reports("Read on to find out what happens next week") and not P.reports("1234567890 1234567890 1234567890 a") and P.reports("The bank raised its rate by a quarter point.")


def test_references_in_anchors(spark):
    assert "hdfc" in one(spark, T.anchors(F.lit("&#72;DFC gains")))
    assert one(spark, T.anchors(F.lit("Étion Noël Müller Zürich Berlin"))) == ["berlin"]


def test_pages(spark):
    page = "<nav><p>one two three four five six seven eight</p></nav><article><p>a b c d e f g h</p><p>short</p><p>a b c d e f g h</p><li>1 2 3 4 5 6 7 8 9 &copy; Read more here</li></article><p>i j k l m n o p q r</p>"
    assert one(spark, P.html_to_text(F.lit(page))) == "a b c d e f g h 1 2 3 4 5 6 7 8 9 ©"
    plain = "<svg><p>x x x x x x x x</p></svg><h2>Some heading of just enough words to stay here</h2>"
    assert one(spark, P.html_to_text(F.lit(plain))) == "Some heading of just enough words to stay here"
    long = "".join(f"<p>{i} " + "word " * 200 + "</p>" for i in range(20))
    assert len(P.prose_of(long)) == 6000 and P.prose_of(None) == ""


def test_facts():
    body = "Bank raises rates. Bank raises rates by a quarter point to fight inflation, it said. Read on to see what else the bank had to say. Markets fell after the surprise decision on Tuesday. Short one."
    assert P.facts_of("Bank raises rates", body) == ["by a quarter point to fight inflation, it said.", "Markets fell after the surprise decision on Tuesday."]


def rows(spark, articles):
    """(place, source, tier, title, facts) as _facts gives them."""
    frame = spark.createDataFrame([(1, *a) for a in articles], "story_id long, place int, source string, tier int, title string, facts array<string>")
    out = frame.select("story_id", "place", "source", "tier", "title", F.posexplode_outer("facts").alias("pos", "fact"))
    return out.withColumns({"words": T.tokens(F.col("fact")), "info": similarity.info_score(F.col("fact")), "numbers": T.numbers(F.col("fact"))})


def test_brief(spark):
    first = "The quake killed 12 people in Kathmandu on Monday."
    second = "On Monday the Kathmandu quake killed 14 people."
    third = "Rescue teams reached villages near Pokhara by helicopter."
    told = similarity.briefs(rows(spark, [(1, "Post", 2, "Quake kills 12", [first, third]), (2, "Times", 1, "Nepal quake", [second]), (3, "Post", 2, "", None)]), 2600).first()
    assert tuple(told)[1:6] == (3, 1, 1, 1, 2)
    assert told.text == "\n".join([
        "HOW EACH OUTLET FRAMED IT", "- [Post] Quake kills 12", "- [Times] Nepal quake", "",
        "CORE FACTS (reported by more than one outlet)", f"[1] (2 sources: Post, Times) {first}", "",
        "ADDITIONAL DETAIL (only one outlet reported this — include if relevant)", f"[2] (Post) {third}", "",
        "DISCREPANCIES (report the disagreement; do not silently pick one)", f"- {first} → Post: 12; Times: 14", "", "SOURCES: Post, Times",
    ])
    cut = similarity.briefs(rows(spark, [(1, "Post", 2, "Quake kills 12", [first, third]), (2, "Times", 1, "Nepal quake", [second])]), 150).first()
    assert cut.text == "HOW EACH OUTLET FRAMED IT\n- [Post] Quake kills 12\n- [Times] Nepal quake\n\nCORE FACTS (reported by more than one outlet)\n\nSOURCES: Post, Times"


def test_brief_without_facts_or_corroboration(spark):
    none = similarity.briefs(rows(spark, [(1, "Post", 2, "A head", None), (2, "Post", 2, "Another", [])]), 2600).first()
    assert tuple(none)[1:] == (0, 0, 0, 0, 1, "- [Post] A head\n- [Post] Another")
    single = similarity.briefs(rows(spark, [(1, "Post", 2, "", ["Rescue teams reached villages near Pokhara by helicopter."])]), 2600).first()
    assert single.text == "\nREPORTED FACTS (each carried by a single outlet — attribute in the prose)\n[1] (Post) Rescue teams reached villages near Pokhara by helicopter.\n\nSOURCES: Post"


def test_furniture_by_hints_and_sentences_on_demand(monkeypatch):
    """F8, F11: a pattern runs only where its words are, whatever the case, and a body is split only as far as its facts reach."""
    for text in ("Prices rose. Read More at the bank", "clıck here to win", "ſHARE THIS STORY. Rain", "All Rights reserved", "Photo : a b. Left", "x CREDIT: y", "Kopyright, Copyright © 2020 me. Rest"):
        want = text
        for pattern in P._FURNITURE:
            want = pattern.sub(" ", want)
        assert P.cleaned(text) == " ".join(want.split()).strip(P.EDGES)
    assert P.cleaned("nothing to see of all that") == "nothing to see of all that"
    asked, end = [], P._SENTENCE_END

    class Watched:
        def finditer(self, text):
            return (asked.append(m.start()) or m for m in end.finditer(text))

    monkeypatch.setattr(P, "_SENTENCE_END", Watched())
    body = " ".join(f"The minister said that number {i} was reported twice." for i in range(500))
    assert len(P.facts_of("", body)) == P.FACTS_AN_ARTICLE and len(asked) < 12


def test_stop_words_are_a_set(spark):
    """a word is looked up among the stop words by its hash, not compared with each of them."""
    plan = spark.createDataFrame([("The bank of Nepal said",)], "t string").select(T.tokens(F.col("t")).alias("w"), T.trend_tokens(F.col("t")).alias("v"))
    assert tuple(plan.first()) == (["bank", "nepal"], ["bank", "nepal"])
    told = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in told and "array_contains" not in told


def test_brief_groups_no_frames(monkeypatch):
    """F8: a story's clusters are told without a frame each; clusters, best wording, order and disagreement stay."""
    columns = ["place", "source", "tier", "title", "pos", "fact", "words", "info", "numbers"]
    rows = [(2, "Times", 1, "Two", 0, "Quake killed 14 people", ["quake", "killed", "people"], 1.0, ["14"]), (1, "Post", 2, "One", 0, "Quake killed 12 people in Nepal", ["quake", "killed", "people"], 2.0, ["12"]), (1, "Post", 2, "One", 1, "Rescue teams arrived", ["rescue", "teams", "arrived"], 0.5, []), (3, "Sun", 3, "", None, None, None, None, None)]
    story = pd.DataFrame(rows, columns=columns)
    monkeypatch.setattr(pd.DataFrame, "groupby", None)
    facts, core, single, differ, sources, text = similarity.told_brief(story, 2600)
    assert (facts, core, single, differ, sources) == (3, 1, 1, 1, 3)
    assert "[1] (2 sources: Post, Times) Quake killed 12 people in Nepal" in text and "[2] (Post) Rescue teams arrived" in text
    assert "Post: 12; Times: 14" in text and text.endswith("SOURCES: Post, Times, Sun")
