from __future__ import annotations

import random

import pytest

from sievework.llm.garbled import Matcher, _decode, examine_texts, find_patterns, pack, text_grams, unpack

LINES = [
    "L’image 12 a été écartée car la feuille était coupée.", "Größe der Flecken: 43 mm, Ränder bräunlich.", "Night temperature fell to 12 °C – no new rust since then.",
    "After 5 × 5 m plots cost £33 per bag, the café said “enough”.", "Снимок 205 размыт, его нельзя использовать для обучения.", "Liście żółkną od brzegów, żyłki są zielone.",
    "पत्तियों के नीचे पीले धब्बे हैं।", "下部叶片发黄,新叶正常。", "Plain text without anything special.", "├── train (5)\n│   └── √ checked, × dropped, ≈ 0.4 ± 0.1", "Ångström scale, Δ = 7, ½ m, Ø 3 mm",
]
PAIRS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("cp1252", "cp437"), ("cp1252", "mac-roman"), ("cp1251", "cp1252"), ("cp1250", "cp1252")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    clean = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 6)))) for i in range(3000)]
    bad = {}
    for k in range(60):
        written, read = PAIRS[k % len(PAIRS)]
        lines = [x for x in LINES[:8] if all(ord(c) < 128 or c.encode(written, "ignore") for c in x)]
        line = rng.choice(lines)
        seen = _decode(line.encode(written), read)
        # where nothing changes the text isn't garbled
        if seen is None or seen == line:
            continue
        whole = f"{rng.choice(LINES)}\n{seen}" if k % 2 else seen
        bad[10_000 + k] = (whole, whole.replace(seen, line))
    return clean, bad


def test_packing():
    for gram in ("a", "é ", "🌱x\U0010ffff"):
        assert unpack(pack(gram)) == gram
    assert {unpack(g) for g in text_grams("a1é")} == {"é", "0é", "a0é"} and len(text_grams("abc")) == 0 == len(text_grams(""))


def test_finds_and_restores(spark, corpus):
    clean, bad = corpus
    odd = [(-1, None), (-2, ""), (-3, "   "), (-4, "x" * 100_000), (-5, "lost � here"), (-6, "caf&Atilde;&copy; &amp; more"), (-7, "caf&eacute; &amp; more")]
    rows = clean + [(i, t) for i, (t, _) in bad.items()] + odd
    df = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id bigint, body string, restored string")
    got = {r["doc_id"]: r for r in examine_texts(df, "doc_id", "body").collect()}
    assert set(got) == set(bad) | {-5, -6}
    assert not got[-5]["complete"] and got[-6]["restored"] == "café & more"
    right = sum(got[i]["restored"] == want for i, (_, want) in bad.items())
    assert right >= 0.9 * len(bad)


def test_twice_garbled(spark, corpus):
    clean, _ = corpus
    text = LINES[0]
    for _ in range(2):
        text = _decode(text.encode(), "cp1252")
    # the first stage has to be common enough to be known, as it is in a corpus that has such texts
    once = [(20_000 + i, _decode(LINES[0].encode(), "cp1252")) for i in range(10)]
    df = spark.createDataFrame(clean + once + [(1, text)], "doc_id bigint, text string")
    matcher = Matcher(find_patterns(df, "text"))
    assert matcher.examine(text) == (True, LINES[0], True)
    assert all(not matcher.examine(x)[0] for x in LINES)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert examine_texts(df, "doc_id", "text").count() == 0
    assert Matcher([]).examine("é") == (False, "é", True)


@pytest.mark.parametrize(("written", "read", "line"), [("utf-8", "cp1252", 0), ("utf-8", "cp1251", 1), ("cp1251", "cp1252", 4), ("cp1252", "cp437", 0), ("cp1250", "cp1252", 5)])
def test_a_third_garbled(spark, written, read, line):
    rng = random.Random(7)
    bad = _decode(LINES[line].encode(written, "ignore"), read)
    clean = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 3)))) for i in range(400)]
    df = spark.createDataFrame([*clean, *[(1000 + i, bad) for i in range(200)]], "doc_id bigint, text string")
    got = {r["doc_id"]: r["restored"] for r in examine_texts(df, "doc_id", "text").collect()}
    assert set(got) == set(range(1000, 1200))
    assert set(got.values()) == {LINES[line].encode(written, "ignore").decode(written)}


def test_clean_text_of_the_same_form():
    clean = ["« bien enlevé\u00a0», dit-il", "Сёмга, всё её", "«École» “Élan”", "3 Å², MAÇÃ…", "СССР» УМ", "├── été\n│", "Große “Maß” und „Maß“", "đường, ượt", "5 µm, kΩ, ΔT, ½ m", "В\u00a0«поле»"]
    assert [x for x in clean if Matcher([]).examine(x)[0]] == []


@pytest.mark.parametrize("others", [1_000, 60_000])
def test_recall_does_not_depend_on_the_size_of_the_corpus(spark, others):
    hungarian = [(i, f"A levelek szélén {i} sárga foltok, később őszi hőség és szűkülő erek.") for i in range(20)]
    seen = _decode(hungarian[0][1].encode("cp1250", "ignore"), "cp1252")
    ascii_texts = spark.range(100, 100 + others).selectExpr("id", "concat('plain text ', id) t")
    df = ascii_texts.unionByName(spark.createDataFrame([*hungarian, (50, seen), (51, _decode(hungarian[1][1].encode(), "cp1252"))], "id bigint, t string"))
    got = {r["id"]: r["restored"] for r in examine_texts(df, "id", "t").collect()}
    assert got == {50: hungarian[0][1], 51: hungarian[1][1]}


def test_references_in_mixed_text():
    text = "caf&Atilde;&copy; &amp; thé glacÃ© &eacute; &#233;"
    assert Matcher([]).examine(text) == (True, "café &amp; thé glacé &eacute; &#233;", True)


def test_many_passes():
    text = LINES[0]
    for _ in range(7):
        text = _decode(text.encode(), "cp1252")
    assert Matcher([]).examine(text) == (True, LINES[0], True)


def test_the_automaton_finds_what_was_lost():
    assert Matcher([]).examine("lost � here") == (True, "lost � here", False)
    assert Matcher([]).examine("a \x93quote\x94")[0] and not Matcher([]).examine("next\x85line")[0]


def test_rare_originals_in_a_large_corpus(spark):
    filler = [(i, f"plain text {i}") for i in range(12_000)]
    clean = [(20_000 + i, "Подкормка огурцов") for i in range(4)]
    twice = _decode(_decode("ľan a café".encode(), "cp1252").encode(), "cp1252")
    bad = {1_000_000: ("Ä¾an", "ľan"), 1_000_001: (_decode("Подкормка огурцов".encode("cp1251"), "cp1252"), "Подкормка огурцов"), 1_000_002: (twice, "ľan a café")}
    df = spark.createDataFrame([*filler, *clean, *[(i, t) for i, (t, _) in bad.items()]], "doc_id bigint, text string")
    assert {r["doc_id"]: r["restored"] for r in examine_texts(df, "doc_id", "text").collect()} == {i: want for i, (_, want) in bad.items()}


@pytest.mark.parametrize("read", ["cp1252", "latin-1"])
def test_long_runs(read):
    text = "下部叶片发黄、新叶正常。" * 60 + "罕"
    seen = _decode(text.encode(), read)
    known = [(_decode(c.encode(), read), c, f"utf-8>{read}", True) for c in "叶新"]
    assert Matcher(known).examine(seen) == (True, text, True)
    # a cut sequence in the middle leaves both sides restored
    cut = Matcher(known).examine(seen[:1000] + seen[1001:])[1]
    assert cut.startswith(text[:320]) and cut.endswith(text[350:])
