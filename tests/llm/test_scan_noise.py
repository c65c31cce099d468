import pytest

from glossmill.llm.scan_noise import ScanNoise, heading_key, misread_finder, repair_text, variants


@pytest.fixture(scope="module")
def found(spark):
    body = "凡肺津受病，先看头顶，后问咽中。取白云草三克。"
    rows = [(f"p{i}", f"脉诊讲堂\n{body}第{'一二三四五六七八'[i % 8]}次。", "脉诊讲堂 p%d" % i, i, i) for i in range(1, 6)]
    rows += [(f"n{i}", f"〔{i + 8}〕\n{body}又{i}。", None, i, i) for i in range(20, 26)]
    rows += [
        ("damaged", "脉诊一堂 · 31 ·\n" + body + "甲", None, 23, 23), ("stuck", "31切记头顶发热。" + body, "x p1", 23, 23), ("content", "At\n7\np.m. it ended well. " + body, None, 23, 23),
        ("hyphen", "The dec-\noction was taken. The decoction worked. " + body, None, 2, 2), ("range", "用量2-\n27克，" + body, None, 2, 2), ("compound", "A well-\nknown herb, well-known here.", None, 2, 2),
        ("misread", "宜自云草配之。用s1mmer。", None, 2, 2), ("script", "宜白雲草配之。", None, 2, 2), ("cited", "见《脉诊讲堂》Vol.3，p.31，论头。" + body, None, 23, 23),
        ("null", None, None, None, None), (None, "〔9〕\n文", None, 1, 1), ("empty", "", None, 1, 1), ("nopage", "〔77〕\n" + body, None, None, None), ("p1", f"脉诊讲堂\n{body}第二次。", "脉诊讲堂 p1", 1, 1),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "item_id string, text string, title string, page_start int, page_end int, key string")
    lexicon = spark.createDataFrame([("白云草", "herb", "zh"), ("simmer", "term", "en"), (None, None, None)], "term string, term_type string, lang string")
    noise = ScanNoise(df, lexicon)
    kinds = {}
    for r in noise.kinds().collect():
        kinds.setdefault(r.item_id, set()).add(r.noise_kind)
    return kinds, {r.item_id: r.text for r in noise.repaired().collect()}


def test_kinds(found):
    kinds, _ = found
    assert all(kinds[f"p{i}"] == {"running_header"} for i in range(1, 6))
    assert all(kinds[f"n{i}"] == {"page_number"} for i in range(20, 26))
    assert kinds["damaged"] == {"running_header", "page_number"} and kinds["stuck"] == {"page_number"}
    assert kinds["hyphen"] == {"hyphenation"} and kinds["misread"] == {"misread"} and kinds["nopage"] == {"page_number"}
    assert not {"content", "range", "compound", "script", "cited", "null", "empty"} & set(kinds)


def test_repair(found):
    _, text = found
    assert text["p1"].startswith("凡肺津") and text["n20"].startswith("凡肺津") and text["stuck"].startswith("切记")
    assert text["hyphen"].startswith("The decoction was taken.") and "well-known herb" in text["compound"]
    assert text["misread"].startswith("宜白云草配之。用simmer") and "2-27克" in text["range"].replace("- ", "-")


def test_pieces_of_the_method(spark):
    from glossmill.llm.scripts import simplified_map

    table = simplified_map(spark)
    assert heading_key("第五讲 醫 案 講 堂", table) == heading_key("医案讲堂 讲义 － 12 －", table) == "医案讲堂"
    assert "自云草" in variants("白云草") and "s1mmer" in variants("simmer") and "白云草" not in variants("白云草")
    find = misread_finder({v: t for t in ("白云草", "simmer") for v in variants(t)}, table)
    assert find("自\n云草与白雲草") == [("自云草", "白云草")] and find("") == []
    assert repair_text("a", None, None, None, None) == "a"


def test_empty(spark):
    df = spark.createDataFrame([], "item_id string, text string, title string, page_start int, page_end int")
    lexicon = spark.createDataFrame([], "term string, term_type string, lang string")
    noise = ScanNoise(df, lexicon)
    assert noise.kinds().count() == 0 and noise.repaired().count() == 0


def test_forms_in_several_passes_and_long_headings(spark, monkeypatch):
    title = "关于草木金石诸类药物之性味归经与煎煮法度的讲义汇编第二辑增订本"
    rows = [(f"h{i}", f"{title}\n凡肺津受病，先看头顶{i}。", title, i, i) for i in range(4)] + [("m", "宜自云草配之，再用s1mmer。", None, 2, 2), ("w", "自云草", None, 2, 2)]
    df = spark.createDataFrame(rows, "item_id string, text string, title string, page_start int, page_end int")
    lexicon = spark.createDataFrame([("白云草",), ("simmer",), ("白石草",)], "term string")
    whole = {tuple(r) for r in ScanNoise(df, lexicon).kinds().collect()}
    assert {("m", "misread"), ("w", "misread")} | {(f"h{i}", "running_header") for i in range(4)} == whole
    monkeypatch.setattr("glossmill.llm.scan_noise.MOST_FORMS", 7)
    noise = ScanNoise(df, lexicon)
    assert {tuple(r) for r in noise.kinds().collect()} == whole
    assert {r.item_id: r.text for r in noise.repaired().collect()}["m"] == "宜白云草配之，再用simmer。"


def test_every_document_has_its_own_distance(spark):
    rows = [(f"d{d}-{i}", f"d{d}", f"〔{i * 7 + d * 13 + 5}〕\n凡肺津受病，先看头顶{d}{i}。", None, i * 7, i * 7) for d in range(30) for i in range(1, 5)]
    rows += [(f"x{i}", "hot", f"甲\n{i % 9 + 1}\n乙{i}", None, i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "item_id string, doc_id string, text string, title string, page_start int, page_end int")
    lexicon = spark.createDataFrame([], "term string, term_type string, lang string")
    found = {r.item_id for r in ScanNoise(df, lexicon).kinds().filter("noise_kind = 'page_number'").collect()}
    assert {r[0] for r in rows if r[1] != "hot"} <= found
