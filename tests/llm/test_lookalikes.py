import itertools
import unicodedata

from glossmill.llm.lookalikes import folded_form, look_alike_pairs, look_form, records, with_forms


def test_forms_join_what_looks_alike_and_keep_what_does_not():
    same = [("ＡＢ１２", "AB12"), ("é", "é"), ("a​b", "ab"), ("a　b", "a b"), ("a b", "a b"), ("SΤ44", "ST44"), ("Nо. 3", "No. 3"), ("⽥花", "田花"), ("量", "量"), ("タ梅", "夕梅"), ("ｶﾞ", "ガ"), ("a­b", "ab")]
    for a, b in same:
        assert look_form(a) == look_form(b), (a, b)
    for a, b in [("AB", "ab"), ("1²", "12"), ("①", "1"), ("lǐ", "lí"), ("講", "讲"), ("士", "土"), ("a b", "ab"), ("½", "1⁄2"), ("第⑴", "第(1)")]:
        assert look_form(a) != look_form(b), (a, b)
    assert folded_form(look_form("STRASSE")) == folded_form(look_form("straße"))


def test_form_is_stable_and_composed():
    for text in ["ﬁ①é̃", "Ａ️Ι", "ﾊﾟ", "한"]:
        assert look_form(look_form(text)) == look_form(text)
        assert unicodedata.is_normalized("NFC", look_form(text))


def test_pairs_against_brute_force_with_dirt(spark):
    rows = [("a", "喜丹 3"), ("b", "喜丹　3"), ("b", "喜丹　3"), ("c", "喜​丹 3"), ("d", "喜丹 3"), ("e", None), (None, "喜丹 3"), ("f", ""), ("g", "​"), ("h", "喜丹 ³"), ("i", "x" * 200_000), ("j", "x" * 200_000 + "​")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "id string, text string, value string, form string")
    got = {(r.id_a, r.id_b) for r in look_alike_pairs(records(df, "f", "id", "text")).collect()}
    known = sorted({(i, t) for i, t in rows if i and t is not None})
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(known, 2) if a != b and x != y and look_form(x) == look_form(y)}
    assert got == want and ("a", "b") in got and ("a", "d") not in got and ("f", "g") in got


def test_hot_values_and_classes_are_split_without_loss(spark, monkeypatch):
    rows = [(f"{i:03d}", "喜丹 3" if i % 3 else "喜丹" + "　" * (i % 5) + " 3") for i in range(60)] + [(f"x{i}", "喜丹 3" + "\u200b" * i) for i in range(12)]
    items = records(spark.createDataFrame(rows, "id string, text string"), "f", "id", "text")
    whole = {tuple(r) for r in look_alike_pairs(items).collect()}
    want = {("f", min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(rows, 2) if x != y and look_form(x) == look_form(y)}
    monkeypatch.setattr("glossmill.llm.pairing.CHUNK", 4)
    assert whole == want == {tuple(r) for r in look_alike_pairs(items).collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert look_alike_pairs(records(df, "f", "id", "text")).count() == 0
    assert with_forms(records(df, "f", "id", "text")).count() == 0
