import random
import time

from glossmill.llm import spam_pages as module
from glossmill.llm.spam_pages import LINK, TAG, _spread, covered, may_cover, repeats, spam_pages, stuffed_share, symbols

R = random.Random(5)
GOODS, WORDS = ["足浴包", "汐瑶梅饮", "艾条"], ["哪里买", "代理", "价格", "官网", "批发", "图片"]
SPAM = {
    "keywords": "，".join(R.choice(GOODS) + R.choice(WORDS) for _ in range(60)),
    "tags": " ".join("#" + R.choice(GOODS) + R.choice(WORDS) for _ in range(40)),
    "links": "\n".join(f"https://www.herb-{R.choice('abcdef')}{i}.example/p-{R.randint(100, 999)}" for i in range(12)),
    "sentences": "".join(f"买{R.choice(GOODS)}就找{R.choice(GOODS)}，{R.choice(GOODS)}{R.choice(WORDS)}，{R.choice(GOODS)}{R.choice(WORDS)}尽在{R.choice(GOODS)}。" for _ in range(20)),
}
HAN = [chr(c) for c in range(0x4E00, 0x5200)]
PROSE = "".join("".join(R.choices(HAN, k=R.randint(12, 30))) + "，" + "".join(R.choices(HAN, k=12)) + "。" for _ in range(30))
VERSE = "\n".join("".join(R.choices(HAN, k=11)) if i % 3 else "莫忘" + "".join(R.choices(HAN, k=2)) + "须常护" for i in range(40))
CONTENTS = "\n".join("".join(R.choices(HAN, k=5)) + f" …… {i * 7}" for i in range(30))


def naive_repeats(s, reach, long):
    """By brute force: the longest dense, and the longest dense or long, substring that ends at each symbol."""
    near, far = [0] * len(s), [0] * len(s)
    for i in range(len(s)):
        for size in range(i + 1, 1, -1):
            ends = [e for e in range(size - 1, len(s)) if s[e + 1 - size : e + 1] == s[i + 1 - size : i + 1]]
            if len(ends) < 3:
                continue
            dense = ends[-1] - ends[0] <= (len(ends) - 1) * reach
            far[i] = far[i] or (size if dense or size >= long else 0)
            near[i] = near[i] or (size if dense else 0)
    return near, far


def test_automaton_against_brute_force():
    for seed in range(30):
        rng = random.Random(seed)
        s = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        assert repeats(s, 8, 4) == naive_repeats(s, 8, 4), s


def test_covered_symbols_are_those_of_the_substrings():
    for seed in range(30):
        rng = random.Random(seed)
        lengths = [rng.choice([0, 0, 0, rng.randint(0, i + 1)]) for i in range(40)]
        want = [any(i + 1 - size <= k <= i for i, size in enumerate(lengths)) for k in range(40)]
        assert _spread(lengths) == want, lengths


def test_lists_of_any_period_and_very_long_pages():
    words = ["".join(R.choices(HAN, k=R.randint(2, 4))) for _ in range(120)]
    assert stuffed_share("，".join(words[:30] * 100)) > 0.9  # a period of 120 symbols
    assert stuffed_share("，".join(words * 25)) > 0.9  # 480 symbols
    assert stuffed_share("，".join(R.choice(words[:60]) for _ in range(1200))) > 0.9  # no order
    began = time.time()
    assert stuffed_share("买" * 1_000_000) > 0.9
    assert stuffed_share("\n".join(f"https://www.a{i}.example/{i} {words[i % 120] * 9}" for i in range(2000))) > 0.5
    assert time.time() - began < 20


def test_kinds_of_pages():
    for name, text in SPAM.items():
        assert stuffed_share(text) > 0.5, name
    for text in (PROSE, VERSE, CONTENTS, PROSE + "\n" + SPAM["tags"][:60], "", "字"):
        assert stuffed_share(text) <= 0.5, text[:40]
    assert stuffed_share(PROSE[:100] + "\n" + SPAM["keywords"]) > 0.5


def test_symbols():
    s, sizes = symbols("见 http://a.example/x #标签 12.5克\n目录 …… 7")
    assert LINK in s and TAG in s and "<0>" in s and "\n" in s and sum(sizes) == len("见 http://a.example/x #标签 12.5克\n目录 …… 7")


def test_table_and_long_page(spark):
    rows = [(1, SPAM["tags"]), (1, SPAM["tags"]), (2, PROSE), (3, None), (None, SPAM["tags"]), (4, ""), (5, SPAM["keywords"] * 200), (6, PROSE * 30)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, stuffed double")
    assert sorted(r.item_id for r in spam_pages(df, "doc_id", "text").collect()) == [1, 5]
    assert spam_pages(df.limit(0), "doc_id", "text").count() == 0


def test_pages_without_recurring_pairs_need_no_automaton(monkeypatch):
    for seed in range(40):
        rng = random.Random(seed)
        text = "".join(rng.choice(["a ", "b ", "，", "甲", "乙", "\n", "#x ", "http://a.example/x "]) for _ in range(rng.randint(0, 90)))
        s, _ = symbols(text)
        near, far = covered(s, text)
        may = may_cover(s)
        assert all(m or not (a or b) for m, a, b in zip(may, near, far, strict=True)), text
    monkeypatch.setattr(module, "suffix_automaton", lambda s: 1 / 0)
    assert stuffed_share(PROSE) == 0.0 and stuffed_share("") == 0.0


def test_pages_whose_pairs_recur_far_apart_need_no_automaton(monkeypatch):
    for seed in range(60):
        rng = random.Random(seed)
        common = ["".join(rng.choices(HAN, k=rng.choice([2, 3, 30]))) for _ in range(3)]
        text = "".join(x for _ in range(rng.randint(3, 12)) for x in ("".join(rng.choices(HAN, k=rng.choice([1, 20, 45, 100]))), rng.choice([*common, "，", "\n", common[0] + "，"])))
        s, _ = symbols(text)
        may = module._may(s)
        for have, want in zip(may, covered(s, text), strict=True):
            assert all(m or not x for m, x in zip(have, want, strict=True)), text
    monkeypatch.setattr(module, "suffix_automaton", lambda s: 1 / 0)
    assert stuffed_share("\n".join(["甲乙", *("".join(R.sample(HAN, 119)) + "\n甲乙" for _ in range(3))])) == 0.0
