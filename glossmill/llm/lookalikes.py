"""Problem 1: text that looks the same but is made of other characters.

Each distinct value is brought to two forms in one vectorised pass:

* `folded`: compatibility normalisation in composed form, full case folding,
  every white space one blank, default-ignorable characters removed: the form
  to compare by where case and fonts don't matter.
* `form`: the same, but what the eye can tell apart stays apart: case, raised,
  lowered, circled and squared characters, fractions, mathematical fonts.
  Letters and ideographs of the same shape become one. Two values look alike
  exactly if their `form` is equal; it decides finer than `folded`.

Same shapes are listed for Greek, Cyrillic, Armenian and Cherokee letters, kana,
phonetic signs and radicals against Latin letters and ideographs; other scripts
keep their letters.

Defined results: null gives null and is no look-alike of anything; an empty or
invisible value gives an empty form; equal values are no pair; duplicate rows
count once; an id is never paired with itself. Whole texts of any length are
used. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glossmill.llm.pairing import named_pairs, pairs_within
from glossmill.session import written

# Default-ignorable code points of the Unicode standard.
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# Letters of the same shape (first of each pair becomes the second).
SAME_SHAPE = (
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϲc ϳj ϹC "
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl "
    "օo հh ոn սu ցg ՕO ՍU ՏS ԼL ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎥI ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ ѵv ѴV ԌG "
    "カ力 ロ口 エ工 タ夕 ト卜 ハ八 ニ二 ヘへ ー一 ㄧ一 ㄚ丫 ㄏ厂 ㄙ厶 ㄦ儿 ㄈ匚 ㄇ冂 ㄐ丩 ㇐一 ㇑丨 ㇠乙 "
    "⺟母 ⺠民 ⻁虎 ⻄西 ⻅见 ⻉贝 ⻋车 ⻑長 ⻓长 ⻔门 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻢马 ⻤鬼 ⻥鱼 ⻨麦 ⻩黄 ⻬齐 ⻮齿 ⻰龙 ⻳龟"
)
#: Compatibility mappings after which the eye sees no other text.
UNSEEN = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}

FORMS = StructType([StructField("folded", StringType()), StructField("form", StringType())])


def _kept(char: str) -> bool:
    """Whether the eye sees that `char` isn't its compatibility mapping."""
    kind = unicodedata.decomposition(char).split(" ")[0]
    if not kind.startswith("<"):
        return False
    plain = unicodedata.normalize("NFKC", char)
    return kind not in UNSEEN or ("(" in plain and len(plain) > 1) or (plain[0] == " " and len(plain) > 1)


@cache
def look_table() -> dict[int, str]:
    """Code point to what stands for it in `form`, derived from the Unicode data of Python."""
    table: dict[int, str] = {}
    for code in [*range(0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x2F800, 0x2FA20)]:
        char = chr(code)
        if char.isspace():
            table[code] = " "
        elif unicodedata.decomposition(char) and not _kept(char):
            table[code] = unicodedata.normalize("NFKD", char)
    for pair in SAME_SHAPE.split():
        table[ord(pair[0])] = pair[1]
    for low, high in IGNORABLE:
        table |= dict.fromkeys(range(low, high + 1), "")
    return table


def look_form(text: str) -> str:
    """What the eye sees of `text`, in one spelling."""
    if text.isascii() and text.isprintable():
        return text
    table = look_table()
    return unicodedata.normalize("NFC", text.translate(table).translate(table))


def folded_form(look: str) -> str:
    """Compatibility composed form with full case folding, of a `look_form`."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", look).casefold())


@F.pandas_udf(FORMS)
def _forms(texts: pd.Series) -> pd.DataFrame:
    looks = [None if t is None else look_form(t) for t in texts]
    return pd.DataFrame({"folded": [None if x is None else folded_form(x) for x in looks], "form": looks})


def consistent_forms(df: DataFrame, text: str) -> DataFrame:
    """Each distinct non-null value of `text`, with its `folded` and `form`."""
    values = df.select(F.col(text).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return values.withColumn("_f", _forms("value")).select("value", "_f.folded", "_f.form")


def records(df: DataFrame, field_name: str, item_id: str, text: str) -> DataFrame:
    """(field_name, item_id, value) of one field, duplicate rows once."""
    one = df.select(F.lit(field_name).alias("field_name"), F.col(item_id).alias("item_id"), F.col(text).alias("value"))
    return one.filter(F.col("value").isNotNull() & F.col("item_id").isNotNull()).distinct()


def with_forms(items: DataFrame) -> DataFrame:
    """`records` with `folded` and `form`; each distinct value is normalised once."""
    return items.join(consistent_forms(items, "value"), "value")


def look_alike_pairs(items: DataFrame) -> DataFrame:
    """(field_name, id_a, id_b) of records whose different values look alike.

    Classes are found on distinct values, keyed by 128-bit digests, so that
    copies of one value cost one row until the last join names their ids.
    """
    keyed = items.select("field_name", "item_id", F.md5("value").alias("value"))
    forms = written(consistent_forms(items, "value").select(F.md5("value").alias("value"), F.md5("form").alias("form")))
    # Only values of a form that others share can be in a pair.
    shared = forms.join(forms.groupBy("form").agg(F.count("*").alias("n")).filter("n > 1").select("form"), "form")
    members = written(keyed.join(shared, "value"))
    pairs = pairs_within(members.select("field_name", "form", "value").distinct(), ["field_name", "form"], "value")
    return named_pairs(pairs.drop("form"), members.drop("form"), ["field_name"])
