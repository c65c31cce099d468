"""Problem 4: sentence ends in every language and layout.

A text is read once for its marks (terminators, quotation marks, brackets). A
stack of what is open decides which marks count; each remaining gap is then
classified:

* In scripts without spaces the clauses on both sides of the gap are segmented
  by the cheapest path through a lattice of dictionary words (function words
  and the given lexicon). The last word before the gap (a final particle) and
  the first after it (a word that opens a sentence, or one that carries it on,
  such as a particle or "said so") then classify the gap. Behind quotations,
  brackets and ellipses a gap is an end unless the sentence is carried on;
  at a blank of a script that has no end marks (Thai, Lao, Khmer), and of a
  single line of Chinese or Japanese without any mark, it is one only behind a
  final particle or before an opening word.
* In spaced scripts all periods of a text are read by one cheapest path through
  a lattice of what each may be: the end of a sentence, or part of an
  abbreviation, an ordinal or a number. The words on both sides give the costs
  of each reading, and two ends in a row with no word between them cost more.

Defined results: null texts and texts of nothing but white space have no
sentences; a text cut off ends with its last non-white character; a text
without any end mark is split at line breaks, where lines of page noise belong
to the line after them; closing marks belong to the sentence they close; a
quotation left open lasts to the end of a short rest and is ignored otherwise.
Repeated rows count once and ids with several texts give the ends of each.
Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = {"“": "”", "‘": "’", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "〔": "〕", "《": "》", "〈": "〉", "[": "]", "«": "»", "„": "“”", "‚": "‘’", "｢": "｣"}
CLOSE = set("”’」』）)】〕》〉]»“‘｣")
QUOTES = set("“‘「『„‚\"«｢")
#: Marks that always end a sentence: of Chinese and Japanese, Devanagari, Arabic and Urdu, Armenian, Ethiopic, Burmese, Khmer, Tibetan, Mongolian.
ALWAYS = "。｡！？；।॥؟۔։።፧။។៕།᠃"
ENDS = set(ALWAYS) | set("!?;…")
_MARK = re.compile(rf"[{ALWAYS}!?;…]+|\.+|[“”‘’「」『』（）()【】〔〕《》〈〉\[\]«»„‚\"｢｣]")
_IGNORED = re.compile(r"[\s­͏؜​-‏‪-‮⁠-⁯︀-️﻿]*")
_NOISE = re.compile(r"[^\S\n]*[\W_]{0,3}\s?(?:p\.\s?)?第?\s?\d{1,4}(?:\s?/\s?\d{1,4})?[页頁]?\s?[\W_]{0,3}[^\S\n]*(?:\n|$)")
#: An open quotation or bracket lasts to the end of a rest of at most this many characters.
CUT_OFF = 240

# Words that carry on the sentence after a quotation, a bracket or an ellipsis.
CONTINUING = (
    "之问 之問 之说 之說 之语 之語 之言 之类 之類 之 的说法 的說法 的话 的話 的 地 得 这句话 這句話 这话 這話 这一 這一 等语 等語 等 一句 一语 一語 二字 四字 云云 "
    "者 而 而且 并 並 则 則 皆 均 与 與 和 及 或 又 且 以及 と という といった といい とは って は も が を に の で へ や から まで より など"
).split()
# Words that open a sentence although a shorter word of the list above begins them.
OPENING = "之后 之後 之前 之所以 的确 的確 地上 得知 这样 這樣 这时 這時 等到 一诊 一診 者番 而今 和平 及至 又如 与其 與其 とても とき ところ ところが もし もの もう はい はじめ がん にわか のち のど でも では やがて へや をり からだ".split()
# Abbreviations that stand before what they belong to, those that stand before a number, and those that may close a sentence.
BEFORE = set("dr prof mr mrs ms st hr fr sr jr vs e.g i.e approx ca cf ed eds z.b d.h u.a bzw ggf inkl evtl sog usf incl resp al".split())
NUMBERED = set("fig figs no nos nr vol vols p pp s abb tab bd kap sec ch eq art".split())
CLOSING = set("a.m p.m etc usw std min oz hrs sec kg mg lb ft in tbsp tsp u.s b.c a.d".split())
ORDINAL = set("am vom zum zur der die das dem den des im beim seit bis jeden ein eine einen und".split())

# Particles that close a sentence, and words that begin one, in Chinese, Japanese, Thai, Lao and Khmer.
FINAL = "了 吗 嗎 呢 吧 啊 呀 嘛 啦 矣 焉 哉 乎 也 です でした ます ました ません だ である か よ ね ครับ ครับผม ค่ะ คะ นะ นะคะ นะครับ จ้ะ จ๊ะ ล่ะ เลย แล้ว ແລ້ວ ເດີ ទេ ហើយ".split()
STARTING = (
    "然后 然後 但是 可是 不过 不過 所以 因此 于是 於是 接着 首先 其次 最后 最後 另外 此外 そして しかし また 次に ところで だから さて まず つぎに "
    "แต่ ดังนั้น จากนั้น ต่อมา นอกจากนี้ อย่างไรก็ตาม เพราะฉะนั้น แล้วก็ ແຕ່ ดังน้ัน ដូច្នេះ ប៉ុន្តែ"
).split()
#: Words that carry on a sentence over a blank.
BINDING = set(CONTINUING) | set("และ หรือ ที่ ซึ่ง ว่า เพราะ กับ ແລະ ຫຼື ທີ່ និង ឬ ដែល".split())
_FINAL, _STARTING, _CARRIED = set(FINAL), set(STARTING), set(CONTINUING)

_WORDS = {w: 1.0 + 0.2 / len(w) for w in [*CONTINUING, *OPENING, *FINAL, *STARTING, *BINDING]}


def add_words(words: list[str]) -> dict[str, float]:
    """The dictionary of the lattice with domain terms added."""
    return _WORDS | {w: 1.0 + 0.2 / len(w) for w in words if w}


def segmented(text: str, words: dict[str, float], longest: int = 0) -> list[str]:
    """The cheapest segmentation of a text; an unknown character costs 2."""
    n = len(text)
    longest = longest or max(map(len, words), default=1)
    best = [0.0] * (n + 1)
    take = [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        best[i] = best[i + 1] + 2.0
        for size in range(1, min(longest, n - i) + 1):
            cost = words.get(text[i : i + size])
            if cost is not None and best[i + size] + cost < best[i]:
                best[i], take[i] = best[i + size] + cost, size
    out, at = [], 0
    while at < n:
        out.append(text[at : at + take[at]])
        at += take[at]
    return out


_CLAUSE = re.compile(rf"[^{ALWAYS}!?;….,，、：:\s“”‘’「」『』（）()【】]+")
_CLAUSE_END = re.compile(_CLAUSE.pattern + r"\Z")


def first_word(text: str, at: int, words: dict[str, float]) -> str:
    """First word of the clause that begins at a place."""
    m = _CLAUSE.match(text, at)
    return segmented(m.group(), words)[0] if m else ""


def last_word(text: str, start: int, at: int, words: dict[str, float]) -> str:
    """Last word of the clause before a place, marks left out."""
    clause = text[start:at].rstrip("".join(ENDS | CLOSE) + " \t\r\n\u3000.")
    m = _CLAUSE_END.search(clause)
    return segmented(m.group(), words)[-1] if m else ""


def _spaceless(char: str) -> bool:
    return "⺀" <= char <= "꓏" or "豈" <= char <= "﫿" or "︰" <= char <= "￯" or char >= "\U00020000" or _unmarked(char)


def _unmarked(char: str) -> bool:
    """Of a script that has neither spaces between words nor marks at the ends of sentences."""
    return "\u0e00" <= char <= "\u0eff" or "\u1780" <= char <= "\u17ff"


_BLANK = re.compile(r"(?<=\S)[^\S\n]+(?=\S)")


def blank_ends(text: str, start: int, end: int, words: dict[str, float]) -> list[int]:
    """Ends at blanks in a piece of a text without marks, by the words on both sides."""
    out, since = [], start
    for m in _BLANK.finditer(text, start, end):
        at, after = m.start(), m.end()
        if not (_spaceless(text[at - 1]) and _spaceless(text[after])):
            continue
        right = first_word(text, after, words)
        if right in BINDING:
            continue
        if right in _STARTING or last_word(text, since, at, words) in _FINAL:
            out.append(at)
            since = after
    return out


def _skip(text: str, at: int) -> int:
    return _IGNORED.match(text, at).end()


def _last(text: str, at: int) -> str:
    """The last character before `at` that isn't white or ignorable."""
    at -= 1
    while at >= 0 and (text[at].isspace() or unicodedata.category(text[at]) in ("Cf", "Mn")):
        at -= 1
    return text[at] if at >= 0 else ""


def _continues(text: str, at: int, words: dict[str, float]) -> bool:
    """Whether what follows a closed quotation, a bracket or an ellipsis belongs to the same sentence."""
    at = _skip(text, at)
    while (noise := _NOISE.match(text, at)) and noise.end() > at:  # a page number on its own line
        at = _skip(text, noise.end())
    if at >= len(text):
        return False
    char = text[at]
    if char in "，,、：:；;。.！!？?…—-～~）)】」』”":
        return True
    if _spaceless(char):
        return first_word(text, at, words) in _CARRIED
    return char.islower()


_BEFORE_PERIOD = re.compile(r"(?<![A-Za-zÀ-ÿ])(?:[A-Za-zÀ-ÿ]\.\s?)+[A-Za-zÀ-ÿ]$|[A-Za-zÀ-ÿ]+$|\d+$")
_INITIAL = re.compile(r"([A-Za-z]+)\.\s+[A-ZÀ-Þ]$")
_ORDINAL_LEAD = re.compile(r"([A-Za-zÀ-ÿ]+)\s+\d+$")
#: No abbreviation, with the word before an ordinal, is longer.
LOOK_BACK = 24


def period_costs(text: str, at: int, end: int) -> tuple[float, float]:
    """Costs of reading a single period at `at` as the end of a sentence, and as part of an abbreviation, ordinal or number."""
    never, always = (9.0, 0.0), (0.0, 9.0)
    nxt = _skip(text, end)
    glued = nxt == end
    while (noise := _NOISE.match(text, nxt)) and noise.end() > nxt and "\n" in text[end:nxt]:
        nxt = _skip(text, noise.end())
    after = text[nxt] if nxt < len(text) else ""
    if not after:
        return always
    if glued and not (after in QUOTES or _spaceless(after)):
        return never
    if _spaceless(_last(text, at)) or (glued and _spaceless(after)):
        return never  # a dot between ideographs, or as in "No.9"
    lead_in = text[max(0, at - LOOK_BACK) : at]
    before = _BEFORE_PERIOD.search(lead_in)
    word = re.sub(r"\s", "", before.group()).lower() if before else ""
    as_end = 2.0 if after.islower() else 0.0
    as_other = 1.0
    if word in BEFORE or (len(word) == 1 and word.isalpha() and re.match(r"\s?[A-ZÀ-Þa-z]\.", text[end : end + 3])):
        as_other = -1.0
    elif (title := _INITIAL.search(lead_in)) and title.group(1).lower() in BEFORE:
        as_other = -1.0  # an initial behind a title
    elif word in NUMBERED:
        as_other = -1.0 if after.isdigit() or after.islower() else 1.5
    elif word in CLOSING:
        as_other = 0.5 if after.islower() or after.isdigit() else 1.0
        as_end += 1.0 if after.isdigit() else 0.0
    elif word.isdigit() and len(word) <= 2:
        lead = _ORDINAL_LEAD.search(lead_in)
        as_other = -1.0 if lead and lead.group(1).lower() in ORDINAL else 1.0
    return as_end, as_other


_LETTERS = re.compile(r"[^\W\d_]{2}")


def period_readings(text: str, marks: list[re.Match]) -> set[int]:
    """Places of the single periods that end a sentence, by the cheapest path through the readings of all."""
    steps = []  # place, costs, extra cost of an end right behind an end
    previous = None
    for m in marks:
        if m.group() != ".":
            previous = previous if m.group()[0] != "." and m.group() not in ENDS else None
            continue
        empty = previous is not None and not _LETTERS.search(text, previous, m.start())
        steps.append((m.start(), period_costs(text, m.start(), m.end()), 1.25 if empty else 0.0))
        previous = m.end()
    end, other = 0.0, 0.0
    came: list[tuple[bool, bool]] = []  # whether the cheapest way to an end, and to another reading, comes from an end
    for _, (as_end, as_other), extra in steps:
        from_end, to_other = end + extra < other, end < other
        came.append((from_end, to_other))
        end, other = as_end + min(end + extra, other), as_other + min(end, other)
    out = set()
    is_end = end < other
    for (at, _, _), (from_end, to_other) in zip(reversed(steps), reversed(came), strict=True):
        if is_end:
            out.add(at)
        is_end = from_end if is_end else to_other
    return out


def sentence_ends(text: str, words: dict[str, float] = _WORDS, headings: frozenset[str] = frozenset()) -> list[int]:
    """Ends of the sentences of `text`, each the number of characters up to and with its last one."""
    marks = list(_MARK.finditer(text))
    ends: list[int] = []
    stack: list[tuple[str, int]] = []  # closing characters, place of the opening
    start, skip_to, any_mark = 0, 0, False
    closed = _closings(text, marks)
    periods = period_readings(text, marks) if "." in text else ()

    def finish(at: int) -> None:
        nonlocal start
        while at < len(text) and text[at] in CLOSE and text[at] not in "“‘" and not stack:
            at += 1
        ends.append(at)
        start = at

    for m in marks:
        at, end, mark = m.start(), m.end(), m.group()
        if at < skip_to:
            continue
        if mark in OPEN or mark == '"':
            kind = closed.get(at)
            if kind == "open":
                stack.append((mark, at))
                continue
            if kind != "close":
                continue
        if mark in CLOSE or mark == '"':
            if closed.get(at) != "close" or not stack:
                continue
            opener, since = stack.pop()
            if stack or opener in "《〈[【〔":
                continue
            if _last(text, at) not in ENDS and _last(text, at) != ".":
                continue
            lead = _last(text, since)
            fresh = _skip(text, start) >= since or not lead
            if _continues(text, end, words):
                continue
            if opener in QUOTES and not fresh:
                finish(end)
            elif opener in QUOTES and not _spaceless(_last(text, at)) and end < len(text):
                finish(end)  # a quotation that is a sentence of its own
            elif fresh:
                finish(end)
            continue
        if mark[0] == ".":
            if stack:
                any_mark = True
                continue
            if len(mark) > 1:
                any_mark = True
                if not _continues(text, end, words) and (end >= len(text) or text[end].isspace()):
                    finish(end)
            elif at in periods:
                any_mark = True
                finish(end)
            continue
        lead = _last(text, at)
        if set(mark) <= set(";；") and not _spaceless(lead) and lead not in CLOSE and mark[0] == ";":
            continue  # a semicolon of spaced scripts
        any_mark = True
        if stack:
            continue
        if set(mark) == {"…"} or mark[-1] == "…":
            if not _continues(text, end, words):
                finish(end)
        elif lead and _spaceless(lead) or any(c in ALWAYS for c in mark):
            at = _skip(text, end)
            after = text[at : at + 1]
            if after not in tuple("，,、：:") and not (after and _spaceless(after) and first_word(text, at, words) in ("と", "という", "って", "とは")):
                finish(end)
        else:  # ! or ? of a spaced script
            after = _skip(text, end)
            if after >= len(text) or not text[after].islower():
                if after > end or after >= len(text) or _spaceless(text[after]) or text[after] in QUOTES:
                    finish(end)
    if not any_mark:
        ends = _line_ends(text, headings)
        return _with_blank_ends(text, ends, words) if len(ends) == 1 or _UNMARKED.search(text) else ends
    rest = text[start:].rstrip()
    if rest and _IGNORED.fullmatch(rest) is None:
        ends.append(start + len(rest))
    return _with_blank_ends(text, ends, words) if _UNMARKED.search(text) else ends


_UNMARKED = re.compile(r"[\u0e01-\u0eff\u1780-\u17ff]")


def _with_blank_ends(text: str, ends: list[int], words: dict[str, float]) -> list[int]:
    out, start = [], 0
    for end in ends:
        out += [*blank_ends(text, start, end, words), end]
        start = end
    return out


def _closings(text: str, marks: list[re.Match]) -> dict[int, str]:
    """Which quotation marks and brackets open and close; those without a partner are left out."""
    role: dict[int, str] = {}
    stack: list[tuple[str, int]] = []
    for m in marks:
        char, at = m.group(), m.start()
        if char == '"':
            held = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            opens = (at == 0 or text[at - 1].isspace() or text[at - 1] in "（(") and at + 1 < len(text) and not text[at + 1].isspace()
            if held is None and (opens or at + 1 < len(text)):
                stack.append(('"', at))
            elif held is not None and not (opens and text[at - 1 : at].isspace() and "\n" not in text[at - 1 : at]):
                role[stack[held][1]], role[at] = "open", "close"
                del stack[held:]
            elif held is not None:
                stack[held] = ('"', at)
            continue
        if char in CLOSE:
            held = next((k for k in range(len(stack) - 1, -1, -1) if char in OPEN.get(stack[k][0], "")), None)
            if held is not None:
                role[stack[held][1]], role[at] = "open", "close"
                del stack[held:]
                continue
        if char in OPEN and not (char in "‘‚" and at and text[at - 1].isalnum()):
            stack.append((char, at))
    for _, at in stack:
        if len(text) - at <= CUT_OFF and text[at] not in "[〔":
            role[at] = "open"
            break
    return role


def _bare(line: str) -> str:
    return re.sub(r"[\W\d_]|讲义|講義|第.?.?[讲講]", "", unicodedata.normalize("NFKC", line))


def is_noise_line(line: str, headings: frozenset[str] = frozenset()) -> bool:
    """A page number on a line of its own, or a heading (one of `headings`, up to half of its characters)."""
    if _NOISE.fullmatch(line) or not line.strip():
        return True
    bare = _bare(line)
    return any(h and len(bare) <= len(h) + 4 and 2 * len(set(bare) & set(h)) >= len(set(h)) for h in headings)


def _line_ends(text: str, headings: frozenset[str]) -> list[int]:
    ends, at = [], 0
    for line in text.split("\n"):
        stop = at + len(line.rstrip())
        if line.strip() and not is_noise_line(line, headings):
            ends.append(stop)
        at += len(line) + 1
    last = len(text.rstrip())
    if last and (not ends or ends[-1] < last):
        ends = [*ends[:-1], last] if ends else [last]
    return ends


def _units_of(words: dict[str, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text, title in batch[["item_id", "text", "title"]].itertuples(index=False):
                headings = frozenset({_bare(re.sub(r"\s*p\d+$", "", title))}) if isinstance(title, str) else frozenset()
                start = 0
                for no, end in enumerate(sentence_ends(text, words, headings)):
                    out.append((item, no, start, end, text[start:end].strip()))
                    start = end
            yield pd.DataFrame(out, columns=["item_id", "sentence_no", "start_pos", "end_pos", "sentence"])

    return run


def _ends_of(words: dict[str, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text, title in batch[["item_id", "text", "title"]].itertuples(index=False):
                headings = frozenset({_bare(re.sub(r"\s*p\d+$", "", title))}) if isinstance(title, str) else frozenset()
                out += [(item, end) for end in sentence_ends(text, words, headings)]
            yield pd.DataFrame(out, columns=["item_id", "end_pos"])

    return run


#: Terms that may be spread to all tasks.
MOST_TERMS = 1_000_000


def _items(df: DataFrame, item_id: str, text: str, title: str | None) -> DataFrame:
    items = df.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"), (F.col(title) if title else F.lit(None).cast("string")).alias("title"))
    return items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()


def lexicon_words(lexicon: DataFrame, term: str = "term") -> list[str]:
    """The terms of a small given table, for the lattice."""
    terms = lexicon.select(term).dropna().distinct()
    if terms.count() > MOST_TERMS:
        raise ValueError("the lexicon is too large to be spread")
    return [r[0] for r in terms.collect()]


def sentence_units(df: DataFrame, item_id: str, text: str, title: str | None = None, lexicon: list[str] = ()) -> DataFrame:
    """(item_id, end_pos): one row per sentence. `lexicon` adds words to the lattice."""
    return _items(df, item_id, text, title).mapInPandas(_ends_of(add_words(list(lexicon))), "item_id string, end_pos int").distinct()


def sentence_texts(df: DataFrame, item_id: str, text: str, title: str | None = None, lexicon: list[str] = ()) -> DataFrame:
    """(item_id, sentence_no, start_pos, end_pos, sentence), cut where the text is, so that no text is joined to its sentences."""
    return _items(df, item_id, text, title).mapInPandas(_units_of(add_words(list(lexicon))), "item_id string, sentence_no int, start_pos int, end_pos int, sentence string")
