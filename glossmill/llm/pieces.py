"""Problem 2: cutting oversized texts at natural boundaries, with overlap.

Dynamic programming over the boundary positions of a text: the cost of a cut is
the penalty of its kind of boundary (end of a paragraph, line or sentence is
free or cheap, then clause, word, any character), plus the squared deviation of
the piece's length from an even share. The pieces of least total cost under the
limit are chosen. Each piece but the first begins `overlap` characters before
the end of the piece before it, so that nothing is lost and exactly `overlap`
characters are shared.

Only texts over the limit reach Python; Spark filters them beside the scan.

Defined results: null texts and ids give no pieces; a text within the limit is
one piece, also an empty one; a grapheme's combining marks are kept with it
where the limit allows; where there's no boundary within reach the cut is made
at the limit. Whole texts of any length are cut: the work is linear in the
number of boundaries. Duplicate rows count once; extra columns are ignored.
The overlap must be smaller than the limit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.sentences import sentence_ends

#: Penalty of a cut by what ends there, from best to worst. A cut inside a
#: sentence costs more than any imbalance can save.
SENTENCE_AND_LINE, SENTENCE, LINE, CLAUSE, WORD, ANYWHERE = 0.0, 0.05, 0.1, 4.0, 6.0, 9.0
_CLAUSE, _WORD, _LINE = re.compile(r"[，、,;：:]|—+"), re.compile(r"\s+"), re.compile(r"\n\s*")


def _joined(text: str, at: int) -> bool:
    """Whether the character at a place belongs to what the eye sees as one with that before it."""
    char = text[at]
    return unicodedata.category(char) in ("Mn", "Me", "Mc") or "\u200d" in (char, text[at - 1]) or "\U0001f3fb" <= char <= "\U0001f3ff"


def boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties), sorted, the text's end last; gaps wider than `reach` get forced positions."""
    cost: dict[int, float] = {}
    for pattern, penalty in ((_WORD, WORD), (_CLAUSE, CLAUSE), (_LINE, LINE)):
        for m in pattern.finditer(text):
            cost[m.end()] = penalty
    for end in sentence_ends(text):
        cost[end] = SENTENCE_AND_LINE if text[end : end + 1] == "\n" else SENTENCE
    cost.pop(0, None)
    cost[len(text)] = 0.0
    at = 0
    for end in sorted(cost):
        if end - at > reach:  # one forced place each reach / 8, so that a way within the limit always exists
            for forced in range(at + max(1, reach // 8), end, max(1, reach // 8)):
                while forced > at + 1 and _joined(text, forced):
                    forced -= 1
                cost.setdefault(forced, ANYWHERE)
        at = end
    places = np.array(sorted(cost))
    return places, np.array([cost[p] for p in places.tolist()])


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of `text`."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    step = limit - overlap
    places, penalties = boundaries(text, max(1, step // 2))
    pieces = max(2, -(-(n - overlap) // step))
    share = (n - overlap) / pieces  # new characters of a piece if all were even
    best = np.full(len(places) + 1, np.inf)
    back = np.zeros(len(places) + 1, np.int64)
    ends = np.concatenate([[0], places])
    best[0] = 0.0
    low = 0
    for j in range(1, len(ends)):
        # a piece from the cut i has its overlap before it, except the first
        while ends[j] - max(0, ends[low] - overlap) > limit:
            low += 1
        new = ends[j] - ends[low:j]
        # every piece must be longer than the overlap of the next
        fits = (ends[low:j] == 0) | (ends[low:j] > overlap)
        total = best[low:j] + ((new - share) / share) ** 2 + penalties[j - 1] + np.where(fits, 0, np.inf)
        k = int(np.argmin(total))
        best[j], back[j] = total[k], low + k
    out, j = [], len(ends) - 1
    while j > 0:
        i = int(back[j])
        out.append((max(0, int(ends[i]) - overlap), int(ends[j])))
        j = i
    return out[::-1]


def _cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name, item, text, limit, overlap in batch[["field_name", "item_id", "text", "max_chars", "overlap_chars"]].itertuples(index=False):
            spans = cut(text, limit, overlap)
            rows += [(name, item, no, a, b, len(spans), text[a:b]) for no, (a, b) in enumerate(spans)]
        yield pd.DataFrame(rows, columns=["field_name", "item_id", "piece_no", "start_pos", "end_pos", "n_pieces", "piece"])


def pieces(items: DataFrame, oversized_only: bool = False) -> DataFrame:
    """Pieces of the texts of `items`(field_name, item_id, text, max_chars, overlap_chars), numbered from 0."""
    items = items.select("field_name", "item_id", "text", "max_chars", "overlap_chars")
    items = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    items = items.withColumn("max_chars", F.when(F.col("overlap_chars") < F.col("max_chars"), F.col("max_chars")).otherwise(F.raise_error(F.lit("overlap_chars must be below max_chars"))))
    large = items.filter(F.length("text") > F.col("max_chars")).distinct()
    # distinct has moved them by a hash already, so a source file full of long texts is no straggler
    schema = "field_name string, item_id string, piece_no int, start_pos int, end_pos int, n_pieces int, piece string"
    made = large.mapInPandas(_cut_batches, schema)
    if oversized_only:
        return made
    small = items.filter(F.length("text") <= F.col("max_chars")).distinct()
    whole = small.select(
        "field_name", "item_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start_pos"), F.length("text").alias("end_pos"), F.lit(1).alias("n_pieces"), F.col("text").alias("piece")
    )
    return made.unionByName(whole)
