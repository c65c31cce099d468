"""Problem 10: pages of stuffed keywords, links or product tags.

For every page a suffix automaton is built over its symbols (ideographs and
other single characters, whole Latin words, numbers, links and tags as one
symbol each). The number of places where the substrings of a state end, the
first and the last of them, are then summed once over the states in the order
of their length. A maximal repeated substring of two or more symbols counts if
it occurs three times or more and its occurrences are `REACH` symbols apart or
less on average: phrases recur everywhere, but densely only where a page is
stuffed. In lines without clauses a substring of `LONG` symbols or more counts
at any distance, and so do items of two or more symbols between separators that
the page holds `ITEM_TIMES` times or more. All occurrences are covered, and three
links or tags within `ROW` symbols. The work is linear in the page; a page in
which pairs of symbols recur too seldom, or too far apart, needs no automaton.

Coverage is combined with missing clause structure, line by line:

* A line is without clauses if most of it isn't in sentences that are ended
  and long enough. All such lines of a page together are stuffed if at least
  `BARE_COVER` of their characters are covered.
* A line of sentences is stuffed if at least `CLAUSE_COVER` of it is covered
  and its words vary little: of any `SPAN` words in a row no more than
  `VARIETY` are different on average.

A page is spam if stuffed lines hold more than half of its characters.

Defined results: null and empty texts and null ids are no spam; a null text
counts as a page without characters; duplicate rows count once; whole texts
are read, a page of n symbols has at most 2 n states; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from operator import mul

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: See above. The thresholds lie in wide gaps between the two kinds of lines (README).
REACH, LONG, ROW, ITEM_TIMES, BARE_COVER, CLAUSE_COVER, VARIETY, SPAN = 40, 24, 80, 5, 0.34, 0.3, 0.44, 80
#: A clause has at least so many ideographs, a Latin word counting for three.
CLAUSE = 12

_LINK = r"(?:https?://)?(?:[A-Za-z0-9-]+\.)+[a-z]{3,8}(?:[/?][^\s，,)>\]]*)?"
# groups: link, tag, leader with its page; private characters stand for them among the symbols
_SPECIAL = re.compile(rf"({_LINK})|(#\w+#?)|(\s*(?:…|\.\.\.|·{{3,}})[….·]*\s*\d+)")
#: What every link, tag or leader holds; most pages have none of it.
_MAY = re.compile(r"[.#…·](?:(?<=\.)[A-Za-z]{3}|(?<=#)\w|(?<=…)[….·]*\s*\d|(?<=\.)\.\.[….·]*\s*\d|(?<=·)··[….·]*\s*\d)")
LINK, TAG, LEADER = "\ue000", "\ue001", "\ue002"
_STANDS = [LINK, TAG, LEADER]
#: What stands between the items of a list.
_BETWEEN = set("\n ,，、;；|/")
_ITEM = re.compile(r"[^\n ,，、;；|/]{2,}")
_SYMBOL = re.compile(r"[A-Za-zÀ-ÿ]+|[0-9]+(?:\.[0-9]+)?|\n|[^\S\n]+|.", re.S)
_SENTENCE = re.compile(r"[^。！？!?；;\n.…]*(?:\.(?!\s|$)[^。！？!?；;\n.…]*|(?<=\b[A-Za-z])\.[^。！？!?；;\n.…]*)*(?:[。！？!?；;]+|\.|……)?[”\"’」』）)]*")
_LETTER = re.compile(r"[一-鿿぀-ヿ㐀-䶿豈-﫿]")
_LATIN = re.compile(r"[A-Za-zÀ-ÿ]+")
_WORD = re.compile(r"[A-Za-zÀ-ÿ]+|[一-鿿぀-ヿ㐀-䶿豈-﫿]")
_ENDED = re.compile(r"[。！？!?；;.…][”\"’」』）)]*$")
_LINKS = re.compile(_LINK)


def symbols(text: str) -> tuple[list, list[int]]:
    """(symbols, their lengths); a leader of dots with its page number equals nothing else."""
    real: list[int] = []

    def put(m: re.Match) -> str:
        real.append(m.end() - m.start())
        return _STANDS[m.lastindex - 1]

    for x in _STANDS:
        text = text.replace(x, "\ue003")
    out = _SYMBOL.findall(_SPECIAL.sub(put, text) if _MAY.search(text) else text)
    sizes = list(map(len, out))
    out = ["<0>" if "0" <= x < ":" else x for x in out]
    if real:
        at = iter(real)
        for i, x in enumerate(out):
            if x in _STANDS:
                sizes[i] = next(at)
                if x == LEADER:
                    out[i] = -i
    return out, sizes


def suffix_automaton(s: list) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, greatest lengths and first ends of the states: 0 is the empty one, 1 to n are the prefixes, clones follow."""
    n = len(s)
    nxt: list = [{} for _ in range(n + 1)]
    link = [0] * (n + 1)
    link[0] = -1
    length = list(range(n + 1))
    first = list(range(-1, n))
    last = cur = 0
    for c in s:
        cur += 1
        p, last = last, cur
        t = nxt[p]
        while c not in t:
            t[c] = cur
            p = link[p]
            if p < 0:
                break
            t = nxt[p]
        else:
            q = t[c]
            size = length[p] + 1
            if size == length[q]:
                link[cur] = q
            else:
                k = len(link)
                nxt.append(nxt[q].copy())
                length.append(size)
                link.append(link[q])
                first.append(first[q])
                link[q] = link[cur] = k
                t[c] = k
                p = link[p]
                while p >= 0:
                    t = nxt[p]
                    if t[c] != q:
                        break
                    t[c] = k
                    p = link[p]
    return link, length, first


def repeats(s: list, reach: float = REACH, long: int = LONG) -> tuple[list[int], list[int]]:
    """For every symbol the length of the longest dense substring that ends there, and of the longest dense or long one; 0 if there is none."""
    link, length, first = suffix_automaton(s)
    inner = set(link)  # the other states are the ends of one substring only
    inner.discard(-1)
    times, ends = [0] * len(link), first[:]
    for v, p in enumerate(link[1 : len(s) + 1], 1):
        if v in inner:
            times[v] += 1
            if v > ends[v]:
                ends[v] = v - 1
        else:
            times[p] += 1
            ends[p] = v - 1
    inner.discard(0)
    order = sorted(inner, key=length.__getitem__, reverse=True)
    for v in order:  # longer substrings before their suffixes
        p = link[v]
        times[p] += times[v]
        if ends[v] > ends[p]:
            ends[p] = ends[v]
    near, far = [0] * len(link), [0] * len(link)
    for v in reversed(order):
        n, size = times[v], length[v]
        if n < 3 or size < 2:
            near[v], far[v] = near[link[v]], far[link[v]]
        elif ends[v] - first[v] <= (n - 1) * reach:
            near[v] = far[v] = size
        else:
            near[v], far[v] = near[link[v]], size if size >= long else far[link[v]]
    up = link[1 : len(s) + 1]
    return [x or near[p] for x, p in zip(near[1:], up)], [x or far[p] for x, p in zip(far[1:], up)]  # noqa: B905


def _spread(lengths: list[int]) -> list[bool]:
    """Which symbols lie in a substring of the length given at its last symbol."""
    out = [False] * len(lengths)
    left = 0
    for i in [i for i, size in enumerate(lengths) if size][::-1]:
        start, stop = i + 1 - lengths[i], left if out[i] else i + 1
        if start < stop:
            out[start:stop] = [True] * (stop - start)
            left = start
    return out


def covered(s: list, text: str) -> tuple[list[bool], list[bool]]:
    """Whether each symbol of `text` is covered, in lines of sentences and in lines without clauses.

    Long substrings and items of a list count in the latter only: forms and
    instructions repeat whole clauses.
    """
    near, far = repeats(s)
    same = near == far
    near = _spread(near)
    far = near[:] if same else _spread(far)
    items = _ITEM.findall(text)
    if len(items) - len(set(items)) >= ITEM_TIMES - 1 and Counter(items).most_common(1)[0][1] >= ITEM_TIMES:
        places_of: dict[tuple, list[int]] = {}
        start = 0
        for i in [i for i, c in enumerate([*s, "\n"]) if c in _BETWEEN]:
            if i - start > 1:
                places_of.setdefault(tuple(s[start:i]), []).append(start)
            start = i + 1
        for item, places in places_of.items():
            if len(places) >= ITEM_TIMES:
                for at in places:
                    far[at : at + len(item)] = [True] * len(item)
    for kind in (LINK, TAG):
        places = [i for i, c in enumerate(s) if c == kind] if kind in s else []
        for a, b, c in zip(places, places[1:], places[2:], strict=False):
            if c - a <= ROW:
                for x in (near, far):
                    x[a] = x[b] = x[c] = True
    return near, far


def clause_share(line: str) -> float:
    """Share of a line in sentences that are ended and long enough for a clause."""
    body = _LINKS.sub("", line) if "." in line else line
    good = at = 0
    while at < len(body):
        m = _SENTENCE.match(body, at)
        end = max(m.end(), at + 1)
        x = body[at:end]
        if end - at >= 4 and _ENDED.search(x):
            size = len(_LETTER.findall(x))
            if size >= CLAUSE or size + 3 * len(_LATIN.findall(x)) >= CLAUSE:
                good += end - at
        at = end
    return good / len(line)


def variety(line: str) -> float:
    """Share of different words among `SPAN` words in a row, on average."""
    words = [w.lower() for w in _WORD.findall(line)]
    if len(words) <= SPAN:
        return len(set(words)) / max(1, len(words))
    shares = [len(set(words[a : a + SPAN])) / SPAN for a in range(0, len(words) - SPAN + 1, SPAN // 4)]
    return sum(shares) / len(shares)


def _may(s: list) -> tuple[list[bool], list[bool]]:
    """Which symbols can be covered at all, in lines of sentences and in lines without clauses.

    All that counts holds two symbols or more and recurs, so its pairs do. Of
    three occurrences or more, `REACH` apart on average, some three in a row lie
    within 3 `REACH`: of an even number of gaps two neighbours sum to 2 `REACH`
    at most, of an odd number m to 2 m / (m - 1) of it. Long substrings are runs
    of pairs that the page has three times, pairs of items it has `ITEM_TIMES`.
    """
    near = [c == LINK or c == TAG for c in s] if LINK in s or TAG in s else [False] * len(s)
    pairs = list(zip(s, s[1:]))  # noqa: B905
    times = {x: n for x, n in Counter(pairs).items() if n >= 3}
    if not times:
        return near, near
    at = [i for i, x in enumerate(pairs) if x in times]
    last: dict[tuple, tuple[int, int]] = {}
    dense = set()
    for i in at:
        x = pairs[i]
        if x not in dense:
            before, one = last.get(x, (-len(s), -len(s)))
            if i - before <= 3 * REACH and before >= 0:
                dense.add(x)
            last[x] = one, i
    far = near[:]
    begin = end = -1
    for i in at:
        x = pairs[i]
        if x in dense:
            near[i] = near[i + 1] = far[i] = far[i + 1] = True
        elif times[x] >= ITEM_TIMES:
            far[i] = far[i + 1] = True
        if i != end + 1 or begin < 0:
            begin = i
        end = i
        if end - begin == LONG - 2:
            far[begin : end + 2] = [True] * LONG
        elif end - begin > LONG - 2:
            far[i + 1] = True
    return near, far


def may_cover(s: list) -> list[bool]:
    """Which symbols can be covered in lines of either kind."""
    return _may(s)[1]


def _reaches(n: int, near: int, far: int) -> bool:
    """Whether a line of n characters is covered enough for either kind."""
    return n > 0 and (near >= CLAUSE_COVER * n or far >= BARE_COVER * n)


def stuffed_share(text: str) -> float:
    """Share of the characters of a page that lie in stuffed lines."""
    s, sizes = symbols(text)
    ends = [0, *accumulate(sizes)]
    may_near, may_far = ([0, *accumulate(map(mul, sizes, x))] for x in _may(s))
    cuts = [-1, *[i for i, c in enumerate(s) if c == "\n"], len(s)]
    # Most pages end here, without an automaton.
    if not any(_reaches(ends[b] - ends[a + 1], may_near[b] - may_near[a + 1], may_far[b] - may_far[a + 1]) for a, b in zip(cuts, cuts[1:])):  # noqa: B905
        return 0.0
    near, far = covered(s, text)
    if True not in far:
        return 0.0
    over_near = [0, *accumulate(map(mul, sizes, near))]
    over_far = [0, *accumulate(map(mul, sizes, far))] if near != far else over_near
    lines = []
    first = 0
    for last in cuts[1:]:
        if ends[last] > ends[first]:
            lines.append((ends[first], ends[last], over_near[last] - over_near[first], over_far[last] - over_far[first]))
        first = last + 1
    # Where no line reaches a limit, no set of lines does.
    if not any(_reaches(end - start, a, b) for start, end, a, b in lines):
        return 0.0
    bare = bare_covered = stuffed = total = 0
    for start, end, in_near, in_far in lines:
        n, line = end - start, text[start:end]
        total += n
        if clause_share(line) < 0.5:
            bare += n
            bare_covered += in_far
        elif in_near >= CLAUSE_COVER * n and variety(line) <= VARIETY:
            stuffed += n
    if bare and bare_covered >= BARE_COVER * bare:
        stuffed += bare
    return stuffed / max(1, total)


def _shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    gc.disable()  # an automaton has no cycles; the collector would walk its states again and again
    try:
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"], "stuffed": [stuffed_share(t) for t in batch["text"]]})
            gc.collect()
    finally:
        gc.enable()


def page_scores(df: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, stuffed): the stuffed share of every page; no shuffle of texts."""
    pages = df.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    kind = pages.schema["item_id"].dataType.simpleString()
    return pages.mapInPandas(_shares, f"item_id {kind}, stuffed double").distinct()


def spam_pages(df: DataFrame, item_id: str, text: str) -> DataFrame:
    """Ids of the pages of which more than half the characters are stuffed."""
    return page_scores(df, item_id, text).filter(F.col("stuffed") > 0.5).select("item_id").distinct()
