import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossmill.llm.pieces import _joined, cut, pieces


def whole(text, spans, limit, overlap):
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans)
    assert all(nxt[0] == one[1] - overlap for one, nxt in zip(spans, spans[1:], strict=False))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab。，\n .“”中文á́", min_size=31, max_size=300), st.integers(12, 30), st.integers(0, 9))
def test_pieces_cover_with_exact_overlap(text, limit, overlap):
    whole(text, cut(text, limit, overlap), limit, overlap)


def test_cuts_at_sentence_ends_where_there_are_any():
    text = "".join(f"这是第{i}个句子，说了一些话。" for i in range(60))
    spans = cut(text, 200, 20)
    whole(text, spans, 200, 20)
    assert all(text[b - 1] == "。" for _, b in spans)
    lines = "\n".join("没有标点的一行诗句" for _ in range(60))
    assert all("\n" in lines[b - 1 : b + 1] for _, b in cut(lines, 100, 10)[:-1])


def test_limits_and_long_texts():
    assert cut("abc", 3, 1) == [(0, 3)] and cut("", 3, 1) == [(0, 0)]
    for text in ("x" * 100_000, "。" * 20_000, " " * 5_000):
        whole(text, cut(text, 900, 80), 900, 80)


def test_table(spark):
    rows = [("f", "a", "x" * 50, 20, 5, "no"), ("f", "a", "x" * 50, 20, 5, "no"), ("f", "b", "short", 20, 5, ""), ("f", "c", None, 20, 5, ""), ("f", None, "y" * 50, 20, 5, ""), ("f", "d", "", 20, 5, "")]
    df = spark.createDataFrame(rows, "field_name string, item_id string, text string, max_chars int, overlap_chars int, piece string")
    got = pieces(df).collect()
    assert {r.item_id for r in got} == {"a", "b", "d"}
    mine = sorted((r.start_pos, r.end_pos) for r in got if r.item_id == "a")
    whole("x" * 50, mine, 20, 5)
    assert {r.item_id for r in pieces(df, oversized_only=True).collect()} == {"a"}
    assert pieces(df.limit(0)).count() == 0


def test_overlap_must_be_below_the_limit(spark):
    df = spark.createDataFrame([("f", "a", "x" * 50, 20, 20)], "field_name string, item_id string, text string, max_chars int, overlap_chars int")
    with pytest.raises(Exception, match="overlap_chars"):
        pieces(df).collect()


def test_forced_cuts_keep_what_is_seen_as_one():
    for unit in ("é", "का", "👩‍🌾", "👋🏽", "ก็"):
        text = unit * 120
        spans = cut(text, 41, 7)
        assert all(end == len(text) or not _joined(text, end) for _, end in spans) and max(b - a for a, b in spans) <= 41
