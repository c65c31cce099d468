import pytest

from glossmill.llm.sentences import _WORDS, add_words, first_word, last_word, segmented, sentence_ends, sentence_texts, sentence_units


def split(text, **kw):
    out, at = [], 0
    for end in sentence_ends(text, **kw):
        out.append(text[at:end].strip())
        at = end
    return out


CASES = [
    ["甲生说：“先看胸闷。再问便溏。”", "针藤穴，深2.6寸；", "终至声哑……", "难道同出一源？！"],
    ["忽然跳动……，皆属失和，紫散可商。", "“胃火未复？”之问，丁生以掌心作答。", "所附医案（问热。答以根。）计12例，均见发硬。"],
    ["见《讲堂》Vol.8 No.34，p.118，论灼热。", "课堂笔记写道：「昏沉者少。抽掣者多。」", "若不足，则宜草2.5克。"],
    ["先生は「熱を見なさい。次に痛みを問う。」と述べた。", "なぜ薬を与えるのか？", "脈は細であり、痛みを伴う。"],
    ['"Is the headache gone?" asked the tongue before noon.', "The dose was taken at 6 a.m. and again at 5 p.m. by 61 patients.", "It ended at 9 p.m.", "See Fig. 27 and No. 30 (vol. 12, p. 90) for pain.", 'The teacher said: "Watch the tongue. Then warm the pulse."', "Use A vs. Benp only if it persists!", "It weighs 1.73 oz. before and 3.78 oz. after, etc., as seen."],
    ["Am 15. Tag kehrte es zurück, z. B. nach Punk oder Forbel.", "Man nimmt ca. 24,6 g bei Würgen.", "Der Sud lindert Ziehen usw. in 28 Std. deutlich.", "Dr. Torlash fragte: „Wo sitzt es? Seit wann?“", "Warum folgt das?"],
]


@pytest.mark.parametrize("parts", CASES)
def test_marks_quotations_abbreviations(parts):
    text = ("" if ord(parts[0][0]) > 0x2E80 else " ").join(parts)
    assert split(text) == parts


def test_lines_noise_and_cut_off():
    assert split("白露草合肘尖\n木露花合胯骨\n大溪藤治足跟") == ["白露草合肘尖", "木露花合胯骨", "大溪藤治足跟"]
    assert split("脉诊讲堂\n〔12〕\n白露草合肘尖\n木露花合胯骨", headings=frozenset({"脉诊讲堂"})) == ["脉诊讲堂\n〔12〕\n白露草合肘尖", "木露花合胯骨"]
    assert split("先有一句。老学员说：“先看头。再问") == ["先有一句。", "老学员说：“先看头。再问"]
    assert split("一句。\n[36]\n二句。") == ["一句。", "[36]\n二句。"]
    assert sentence_ends("") == [] and sentence_ends(" \n ") == []
    assert sentence_ends("一句。  ") == [3]


def test_very_long_texts_stay_linear():
    assert len(sentence_ends("一句话。" * 50_000)) == 50_000
    assert sentence_ends("字" * 300_000) == [300_000]


SCRIPTS = {
    "thai": ["สวัสดีครับ", "วันนี้อากาศดีมากค่ะ", "ไปกินข้าวกันนะครับ", "ชาและ กาแฟ", "แต่ฝนตก"],
    "japanese": ["今日は天気がいいです", "どこへ行きますか", "薬 草を見ました", "そして 帰る"],
    "chinese": ["他来了", "你看见白云 草吗", "然后 回家"],
    "hindi": ["यह पहला वाक्य है।", "यह दूसरा वाक्य है।", "क्या यह सच है?"],
    "arabic": ["هل أنت بخير؟", "نعم، أنا بخير؛ شكرا۔", "الجملة الأخيرة."],
    "armenian": ["Սա առաջինն է։", "Սա երկրորդն է։"],
    "amharic": ["ይህ የመጀመሪያው ነው።", "ይህ ሁለተኛው ነው።"],
    "burmese": ["ဒါပထမပါ။", "ဒါဒုတိယပါ။"],
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_scripts_by_marks_or_particles(name):
    assert split(" ".join(SCRIPTS[name])) == SCRIPTS[name]


def test_periods_are_read_together():
    assert split("The dose is 5. 6. Then rest.") == ["The dose is 5.", "6. Then rest."]
    assert split("So it ends.\np. 49\n\nDr. Tu asks.") == ["So it ends.", "p. 49\n\nDr. Tu asks."]
    assert split("Add 3. Then rest. Done.") == ["Add 3.", "Then rest.", "Done."]
    assert split("See Dr. A. Smith. He knows.") == ["See Dr. A. Smith.", "He knows."]


def test_last_word_is_that_of_the_whole_clause():
    words = add_words(["了解", "白云草"])
    assert last_word("你看了", 0, 3, words) == "了" and last_word("我了解", 0, 3, words) == "了解" and last_word("有白云草。", 0, 5, words) == "白云草"
    assert segmented("我了解白云草吗", words) == ["我", "了解", "白云草", "吗"]


def test_lattice_prefers_the_longer_word():
    assert first_word("とても痛い", 0, _WORDS) == "とても" and first_word("と述べた", 0, _WORDS) == "と"
    assert first_word("之问，", 0, _WORDS) == "之问" and first_word("白云草", 0, add_words(["白云草"])) == "白云草"


def test_table(spark):
    rows = [("a", "一。二。", "t p1", 1), ("a", "一。二。", "t p1", 1), ("b", None, None, 1), (None, "一。", None, 1), ("c", " ", None, 1), ("d", "Ein Satz. Noch einer.", None, 1)]
    df = spark.createDataFrame(rows, "pid string, text string, title string, end_pos int")
    got = sorted((r.item_id, r.end_pos) for r in sentence_units(df, "pid", "text", "title").collect())
    assert got == [("a", 2), ("a", 4), ("d", 9), ("d", 21)]
    assert sentence_units(df.limit(0), "pid", "text").count() == 0
    texts = [(r.item_id, r.sentence_no, r.start_pos, r.end_pos, r.sentence) for r in sentence_texts(df, "pid", "text", "title").collect()]
    assert sorted(texts) == [("a", 0, 0, 2, "一。"), ("a", 1, 2, 4, "二。"), ("d", 0, 0, 9, "Ein Satz."), ("d", 1, 9, 21, "Noch einer.")]
