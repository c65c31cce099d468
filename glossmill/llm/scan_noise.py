"""Problem 6: repairing text of scanned pages.

1. Running headers: short lines are brought to a key (one script, without
   blanks, punctuation, numbers and lecture marks). Keys that open `REPEATS`
   or more texts, or are the title of as many, are the headings of the corpus.
   A line is a header if its key is a heading or one character away from one;
   the fuzzy match is a join on keys with one character left out.
2. Page numbers: numbers alone on a line, beside a header or stuck to the start
   of a text. Their distance from the page that the text is said to be on is
   counted in each document; a distance that `REPEATS` different numbers share
   there and that stands out from the distances round it is a numbering
   sequence, and only numbers that follow one are page numbers. Distances that
   recur over the whole corpus count too, for documents with few pages.
3. Hyphenation: a letter, a hyphen, a line break and a small letter, unless the
   corpus vocabulary has the hyphenated word and not the joined one.
4. Misread terms: lexicon terms in which one character was taken for another
   of similar shape, found in the text without line breaks.

Defined results: null texts and ids have no noise and no repair; null pages
follow no sequence, so only decorated numbers on lines of their own count
there; a null title uses the file name given; duplicate rows count once; an
empty table gives an empty result. Whole texts are read; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.lookalikes import look_form
from glossmill.session import written

#: Texts that a heading opens at least; part of all numbers on own lines that a numbering sequence has at least.
REPEATS, SEQUENCE_PART = 3, 0.05
#: Characters by which a header may be longer than the longest title: lecture mark, page number and decoration; and what a line of a page number has at most.
AROUND_TITLE, LONGEST_NUMBER = 20, 28
#: A distance stands out if it has so many times the mean of the `ROUND` distances on either side.
STANDS_OUT, ROUND = 4, 10
#: Misread forms of the lexicon that are spread to all tasks at once; more of them come in further passes.
MOST_FORMS = 500_000

# Ideographs that recognition takes for one another, by group.
SIMILAR_IDEOGRAPHS = (
    "乌鸟 木本术禾朩 天夫夭无 贝见 千干于 白自曰日目百 土士上 石右古 风凤 玉王主五 田由甲申 大犬太丈 未末 己已巳 人入八 口日 力刀九 云去 小少 七匕 "
    "砂沙秒 松枩公 泉皇帛 草早革 花化苍 根恨很 皮反波 叶吐时 藤滕膝 溪汊 岭铃冷 霜箱 露路 鹿麂 雀崔 今令 水永氷 手毛 火灭 牛午 月用 心必 爪瓜 米来 虫中 舟丹 竹什 羊半 耳且 衣农 豆亘 足是 车东 门们 马乌 鱼鲁 麦麥 黄寅"
).split()
# Latin letters and what recognition makes of them.
SIMILAR_LETTERS = {"m": ["rn", "nn"], "l": ["1", "i", "|"], "i": ["1", "l", "|"], "o": ["0"], "g": ["9", "q"], "s": ["5"], "w": ["vv"], "d": ["cl"], "b": ["6"], "e": ["c"], "a": ["4"], "z": ["2"], "t": ["7"], "n": ["ri"], "h": ["li"], "u": ["ii"]}

_PAGE_LINE = r"(?U)^[\s\-－—–·•\[\]〔〕()（）|]*(?:[pP]\.\s*|第\s*)?([0-9０-９]{1,4})(?:\s*/\s*[0-9]{1,4})?\s*[页頁]?[\s\-－—–·•\[\]〔〕()（）|]*$"
# A lecture mark with one of its characters damaged at most, and what stands for a damaged character.
_LECTURE = r"第[0-9０-９一二三四五六七八九十百□■口丨\s]{1,6}[讲講□■口丨一]|[□■口丨一][0-9０-９一二三四五六七八九十百]{1,5}[讲講]"
_HYPHEN = r"([A-Za-zÀ-ÖØ-öø-ÿ]+)[-‐¬­][^\S\n]*\n\s*([a-zß-öø-ÿ]+)"


def variants(term: str) -> set[str]:
    """`term` with one character misread."""
    found = set()
    if term.isascii():
        for i, char in enumerate(term):
            found |= {term[:i] + other + term[i + 1 :] for other in SIMILAR_LETTERS.get(char, [])}
    else:
        for i, char in enumerate(term):
            for group in SIMILAR_IDEOGRAPHS:
                if char in group:
                    found |= {term[:i] + other + term[i + 1 :] for other in group if other != char}
    return found


def _misread_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(v, term) for term in batch["term"] for v in sorted(variants(term))]
        yield pd.DataFrame(rows, columns=["form", "term"], dtype=object)


def misread_finder(forms: dict[str, str], simplified: dict[int, str]):
    """A function from text to the sorted (as read, as meant) pairs in it; `forms` are misread forms with their terms."""
    import ahocorasick

    latin = {v: t for v, t in forms.items() if t.isascii()}
    automaton = ahocorasick.Automaton()
    for v, term in forms.items():
        if not term.isascii():
            automaton.add_word(v, (v, term))
    automaton.make_automaton()

    def find(text: str) -> list[tuple[str, str]]:
        joined = re.sub(r"[-‐¬­][^\S\n]*\n\s*(?=[a-z0-9])", "", text)
        seen = look_form(joined)
        pairs = {(w, latin[w.lower()]) for w in re.findall(r"[A-Za-z0-9|]+", seen) if w.lower() in latin}
        if len(automaton):
            bare = re.sub(r"\s+", "", seen).translate(simplified)
            pairs |= {pair for _, pair in automaton.iter(bare)}
        return sorted(pairs)

    return find


def _finder(forms: dict[str, str], simplified: dict[int, str]):
    @F.pandas_udf("array<struct<seen string, meant string>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = misread_finder(forms, simplified)  # once a task
        for texts in batches:
            yield texts.map(lambda t: [{"seen": a, "meant": b} for a, b in finder(t)])

    return find


def heading_key(line: str, simplified: dict[int, str]) -> str:
    """What is left of a header without script, blanks, numbers, marks and lecture."""
    line = look_form(line).translate(simplified)
    line = re.sub(r"第\s*\d+\s*页|[pP]\.\s*\d+", "", line)
    line = re.sub(_LECTURE, "", re.sub(r"\s", "", line))
    return re.sub(r"(?<=...)讲义$|(?<=....)(?:讲[口丨一]?|[口丨一]义)$", "", re.sub(r"[\W\d_]", "", line))


def _without_one(key: Column) -> Column:
    """The key and all forms of it with one character left out."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key))))
    return F.array_distinct(F.array_append(shorter, key))


class ScanNoise:
    """The noise of a corpus: `paragraphs`(item_id, text, title, page_start, page_end), with doc_id if documents are known."""

    def __init__(self, paragraphs: DataFrame, lexicon: DataFrame):
        from glossmill.llm.scripts import simplified_map

        spark = paragraphs.sparkSession
        self.simplified = simplified_map(spark)
        self.terms = lexicon.select("term").filter(F.length("term") > 2).distinct()
        rows = paragraphs.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
        doc = F.col("doc_id").cast("string") if "doc_id" in paragraphs.columns else F.lit(None).cast("string")
        rows = rows.select("item_id", doc.alias("doc_id"), "text", F.regexp_replace("title", r"\s*p\d+$", "").alias("title"), "page_start", F.coalesce("page_end", "page_start").alias("page_end"))
        self.texts = written(rows.distinct().withColumn("text_id", F.xxhash64("text")))
        lines = self.texts.select("item_id", "doc_id", "text_id", "page_start", "page_end", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        longest = self.texts.agg(F.max(F.length("title"))).first()[0] or 0
        short = (F.length("line") <= max(LONGEST_NUMBER, longest + AROUND_TITLE)) & ~F.col("line").rlike(r"[，。；：？！「」『』“”\"…、,;:?!]")
        lines = lines.filter(short & (F.trim("line") != ""))
        self.lines = written(self._with_keys(lines))

    def _key(self):
        table = self.simplified

        @F.pandas_udf("string")
        def key(lines: pd.Series) -> pd.Series:
            return lines.map(lambda x: None if x is None else heading_key(x, table))

        return key

    def _with_keys(self, lines: DataFrame) -> DataFrame:
        """Each distinct line gets its key once."""
        keys = lines.select("line").distinct().withColumn("key", self._key()("line"))
        return lines.join(keys, "line")

    def headers(self) -> DataFrame:
        """(item_id, text_id, line_no, line): lines that are running headers."""
        opening = self.lines.filter((F.col("line_no") <= 1) & (F.length("key") >= 3)).groupBy("key").agg(F.count_distinct("item_id").alias("n"))
        titles = self.texts.filter(F.col("title").isNotNull()).groupBy("title").agg(F.count("*").alias("n"))
        titles = titles.withColumn("key", self._key()("title")).select("key", "n").filter(F.length("key") >= 3)
        headings = opening.unionByName(titles).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= REPEATS)
        # An opening line of a verse recurs only if the verse does; a heading is the title of something.
        of_titles = titles.select(F.explode(_without_one(F.col("key"))).alias("form")).distinct()
        headings = headings.select("key", F.explode(_without_one(F.col("key"))).alias("form")).join(of_titles, "form", "left_semi").select("key").distinct()
        forms = headings.select(F.explode(_without_one(F.col("key"))).alias("form")).distinct()
        mine = self.lines.filter(F.length("key") >= 3).select("key").distinct().withColumn("form", F.explode(_without_one(F.col("key"))))
        matched = mine.join(forms, "form", "left_semi").select("key").distinct()
        return self.lines.join(matched, "key", "left_semi").select("item_id", "doc_id", "text_id", "line_no", "line", "page_start", "page_end")

    def page_numbers(self, headers: DataFrame) -> DataFrame:
        """(item_id, text_id, line_no, part): what of a line is a page number."""
        plain = F.regexp_replace(F.translate("line", "０１２３４５６７８９", "0123456789"), _LECTURE, "")
        alone = self.lines.select("item_id", "doc_id", "text_id", "line_no", "line", "page_start", "page_end", F.regexp_extract(plain, _PAGE_LINE, 1).alias("number"), plain.rlike(r"^\s*\d+\s*$").alias("bare"))
        alone = alone.filter(F.col("number") != "")
        beside = headers.withColumn("number", F.regexp_extract(plain, r"(?:^|[^\d/])(\d{1,4})(?:\s*/\s*\d+)?(?=\D|$)", 1)).filter(F.col("number") != "").withColumn("bare", F.lit(False))
        stuck = self.texts.select("item_id", "doc_id", "text_id", F.lit(0).alias("line_no"), F.regexp_extract("text", r"^\s*(\d{1,4})(?=[^\d\s.,/:%~\-枚克钱两分升斗斤铢例味]|\s+[A-Z\"“])", 1).alias("number"), "page_start", "page_end")
        stuck = stuck.filter(F.col("number") != "").withColumn("line", F.col("number")).withColumn("bare", F.lit(True))
        both = alone.unionByName(beside.select(alone.columns)).unionByName(stuck.select(alone.columns))
        first = F.col("number").cast("int") - F.col("page_start")
        last = F.col("number").cast("int") - F.col("page_end")
        both = written(both.withColumn("off", F.array_distinct(F.array(first, last))))
        each = both.withColumn("off", F.explode("off")).filter(F.col("off").isNotNull())
        total = both.count()
        # At most 2 / SEQUENCE_PART distances pass.
        runs = [r["off"] for r in each.groupBy("off").count().filter(F.col("count") >= max(3, SEQUENCE_PART * total)).collect()]
        inside = each.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", "off").agg(F.count_distinct("number").alias("numbers"))
        # A document has no more distances than pages and numbers of four digits allow.
        near = F.sum("numbers").over(Window.partitionBy("doc_id").orderBy("off").rangeBetween(-ROUND, ROUND)) - F.col("numbers")
        inside = inside.withColumn("near", near).filter((F.col("numbers") >= REPEATS) & (F.col("numbers") >= STANDS_OUT * F.col("near") / (2 * ROUND)))
        follows = each.join(inside.select("doc_id", "off"), ["doc_id", "off"], "left_semi").select("item_id", "text_id", "line_no", "line")
        if runs:
            follows = follows.unionByName(each.filter(F.col("off").isin(runs)).select(follows.columns))
        decorated = both.filter(~F.col("bare") & F.col("page_start").isNull()).select(follows.columns)
        return follows.unionByName(decorated).distinct().withColumnRenamed("line", "part")

    def hyphenations(self) -> DataFrame:
        """(item_id, text_id, head, tail): words broken across lines."""
        broken = self.texts.filter(F.col("text").rlike(_HYPHEN))
        pairs = F.regexp_extract_all("text", F.lit(_HYPHEN), F.lit(0))
        broken = broken.select("item_id", "text_id", F.explode(F.array_distinct(pairs)).alias("m"))
        broken = broken.select("item_id", "text_id", F.regexp_extract("m", _HYPHEN, 1).alias("head"), F.regexp_extract("m", _HYPHEN, 2).alias("tail"))
        words = self.texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-zß-öø-ÿ]+(?:-[a-zß-öø-ÿ]+)*"), F.lit(0))).alias("word")).groupBy("word").count()
        joined, kept = F.lower(F.concat("head", "tail")), F.lower(F.concat_ws("-", "head", "tail"))
        broken = broken.withColumn("joined", joined).withColumn("kept", kept)
        as_one = words.select(F.col("word").alias("joined"), F.col("count").alias("n_joined"))
        as_two = words.select(F.col("word").alias("kept"), F.col("count").alias("n_kept"))
        broken = broken.join(as_one, "joined", "left").join(as_two, "kept", "left")
        zero = F.lit(0)
        return broken.filter(F.coalesce("n_kept", zero) <= F.coalesce("n_joined", zero)).select("item_id", "text_id", "head", "tail")

    def misreads(self) -> DataFrame:
        """(item_id, text_id, misread): pairs of a term as read and as meant."""
        forms = self.terms.mapInPandas(_misread_forms, "form string, term string")
        forms = written(forms.join(self.terms.withColumnRenamed("term", "form"), "form", "left_anti").groupBy("form").agg(F.min("term").alias("term")))
        passes = max(1, -(-forms.count() // MOST_FORMS))
        texts = self.texts.select("text_id", "text").dropDuplicates(["text_id"])
        each = None
        for part in range(passes):
            pairs = forms.filter(F.pmod(F.xxhash64("form"), F.lit(passes)) == part).collect()
            one = texts.select("text_id", _finder(dict(map(tuple, pairs)), self.simplified)("text").alias("misread")).filter(F.size("misread") > 0)
            each = one if each is None else each.unionByName(one)
        if passes > 1:
            each = each.groupBy("text_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("misread")))).alias("misread"))
        return self.texts.select("item_id", "text_id").join(each, "text_id")

    def kinds(self) -> DataFrame:
        """(item_id, noise_kind): which noise each text has."""
        headers = written(self.headers())
        parts = {
            "running_header": headers, "page_number": self.page_numbers(headers),
            "hyphenation": self.hyphenations(), "misread": self.misreads(),
        }
        out = None
        for kind, rows in parts.items():
            one = rows.select("item_id", F.lit(kind).alias("noise_kind"))
            out = one if out is None else out.unionByName(one)
        return out.distinct()

    def repaired(self) -> DataFrame:
        """(item_id, text): the texts without headers and page numbers, lines joined, words and terms restored."""
        headers = written(self.headers())
        numbers = written(self.page_numbers(headers))
        drop = headers.select("item_id", "text_id", "line_no").unionByName(numbers.filter(~F.col("part").rlike(r"^\d+$") | (F.col("line_no") > 0)).select("item_id", "text_id", "line_no"))
        drop = drop.groupBy("item_id", "text_id").agg(F.collect_set("line_no").alias("drop"))
        stuck = numbers.filter((F.col("line_no") == 0) & F.col("part").rlike(r"^\d+$")).select("item_id", "text_id", F.col("part").alias("stuck")).distinct()
        hyphens = self.hyphenations().groupBy("item_id", "text_id").agg(F.collect_set(F.concat_ws("-", "head", "tail")).alias("broken"))
        keys = ["item_id", "text_id"]
        rows = self.texts.join(drop, keys, "left").join(stuck, keys, "left").join(hyphens, keys, "left").join(self.misreads().distinct(), keys, "left")

        @F.pandas_udf("string")
        def repair(text: pd.Series, drop: pd.Series, stuck: pd.Series, broken: pd.Series, misread: pd.Series) -> pd.Series:
            return pd.Series([repair_text(*x) for x in zip(text, drop, stuck, broken, misread, strict=True)])

        return rows.select("item_id", repair("text", "drop", "stuck", "broken", "misread").alias("text")).distinct()


def repair_text(text: str, drop, stuck: str | None, broken, misread) -> str:
    """One continuous text: see `ScanNoise.repaired`."""
    drop, broken = set(drop if drop is not None else ()), set(broken if broken is not None else ())
    lines = text.split("\n")
    text = "\n".join(x for i, x in enumerate(lines) if i not in drop)
    if stuck and text.lstrip().startswith(stuck):
        text = text.lstrip()[len(stuck) :].lstrip()
    text = re.sub(_HYPHEN, lambda m: m.group(1) + m.group(2) if f"{m.group(1)}-{m.group(2)}" in broken else f"{m.group(1)}-{m.group(2)}", text)
    wide = r"[⺀-鿿豈-﫿＀-｠　-ヿ，。；：？！]"
    text = re.sub(rf"(?<={wide})[^\S\n]*\n\s*(?={wide})|(?<={wide})[^\S\n]*\n\s*(?=[^\s])|(?<=\S)[^\S\n]*\n\s*(?={wide})", "", text)
    text = re.sub(r"\s*\n\s*", " ", text).strip()
    for pair in misread if misread is not None else ():
        text = text.replace(pair["seen"], pair["meant"])
    return text
