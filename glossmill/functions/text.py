"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(term: str) -> str:
    """`term` as a literal inside a Java or RE2 pattern."""
    return re.sub(r"([\\.\[\]{}()*+?^$|/-])", r"\\\1", term)


def one_spaced(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def cleaned(text: Column) -> Column:
    """Ideographic blanks as blanks, blanks collapsed, empty lines collapsed."""
    text = F.regexp_replace(F.translate(text, "　", " "), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(text, r"\n\s*\n+", "\n"))


def sentences(text: Column, marks: str = "。！？!?；;") -> Column:
    """Sentences that keep their mark; all white space is removed first."""
    m = quoted(marks)
    return F.regexp_extract_all(without_space(text), F.lit(f"[^{m}]+[{m}]?"), F.lit(0))


def stable_id(*parts: Column, length: int = 16) -> Column:
    """First digits of the SHA-1 of the parts, one a line."""
    return F.left(F.sha1(F.concat_ws("\n", *[p.cast("string") for p in parts])), F.lit(length))


def quote(text: Column, most: int = 240) -> Column:
    """Without white space, cut with an ellipsis."""
    bare = without_space(text)
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(F.substring(bare, 1, most - 1), F.lit("…")))


def known_terms(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """The terms contained in the text, in the order of the list."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def longest_terms(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """Distinct terms by leftmost longest matches that don't overlap."""
    alternatives = "|".join(quoted(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({alternatives})"), F.lit(0)))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term occurs, overlapping ones included."""
    return F.regexp_count(text, F.concat(F.lit("(?=\\Q"), term, F.lit("\\E)")))


def any_of(text: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """Whether one of the terms is in the text."""
    return text.rlike("|".join(quoted(t) for t in terms))


def followed_safely(text: Column, term: str, continuations: tuple[str, ...]) -> Column:
    """Whether the term occurs where none of the continuations follows."""
    return text.rlike(f"{quoted(term)}(?!{'|'.join(map(quoted, continuations))})")


def repeated_phrase(text: Column, least: int = 2, most: int = 8, times: int = 3) -> Column:
    """Whether an ideographic phrase stands `times` in a row, as recognition stutters."""
    return without_space(text).rlike(rf"([一-鿿]{{{least},{most}}})\1{{{times - 1},}}")


def leaders(text: Column) -> Column:
    """Dot leaders of a table of contents."""
    return text.rlike(r"[.·…]{6,}") | (F.regexp_count(text, F.lit(r"\.\.\.")) >= 2)


def measures(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-case text, by one pass of a lookahead pattern."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{n}}}))"), F.lit(1)))


def folded(text: Column, scripts: tuple[str, str]) -> Column:
    """Lower case in one script: characters of the first string become those of the second."""
    return F.lower(F.translate(text, *scripts))


def script_variants(term: Column, scripts: tuple[str, str], most: int = 8) -> Column:
    """The term as it may be written in the other script: the first `most` combinations of the forms of its characters."""
    forms: dict[str, list[str]] = {}
    for other, plain in zip(*scripts, strict=True):
        forms.setdefault(plain, []).append(other)
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in forms.items() for x in pair])
    chars = F.filter(F.split(term, ""), lambda c: c != "")
    grown = lambda s, c: F.slice(F.flatten(F.transform(s, lambda p: F.transform(F.coalesce(table[c], F.array(c)), lambda f: F.concat(p, f)))), 1, most)
    return F.aggregate(chars, F.array(F.lit("")), grown)


def source_noise(text: Column) -> Column:
    """Whether a text is a table of contents or stutters."""
    return leaders(text) | repeated_phrase(text)


def clean_source(text: Column, least: int = 12) -> Column:
    """Whether a text is long enough and free of noise."""
    spaced = one_spaced(text)
    return (F.length(spaced) >= least) & ~source_noise(spaced)


def without_page_head(text: Column, mark: str | None = None) -> Column:
    """One-spaced text without the given mark (a pattern) and page number before its first ideograph."""
    text = one_spaced(text)
    if mark:
        text = F.regexp_replace(text, f"^(?:{mark})", "")
    return F.trim(F.regexp_replace(text, r"^\d{1,4}(?=[一-鿿])", ""))


def public_path(path: Column, rounds: int = 8) -> Column:
    """A path without private parts.

    It is decoded until nothing changes, in at most `rounds` rounds; what is
    still encoded then leaves no name at all. Absolute, drive, scheme and
    upward paths, paths of a home folder, and those in which decoding brought
    separators, queries or fragments to light leave their file name only.
    """
    decode = lambda p, _: F.coalesce(F.try_url_decode(F.regexp_replace(p, r"\+", "%2B")), p)
    decoded = F.aggregate(F.array_repeat(F.lit(0), rounds), path, decode)
    # An array of one element names the decoded path, so that it is made once.
    return F.get(F.transform(F.array(decoded), lambda d: _shown(path, d)), F.lit(0))


def _shown(path: Column, decoded: Column) -> Column:
    slashed = F.regexp_replace(F.trim(decoded), r"\\", "/")
    name = F.regexp_extract(F.regexp_replace(slashed, r"[?#].*$", ""), r"([^/]*)/*$", 1)
    name = F.regexp_replace(F.regexp_replace(name, r"\p{Cntrl}", ""), r"^[._ ]+", "")
    tidy = F.regexp_replace(F.regexp_replace(slashed, r"^(?:\./+)+", ""), r"/(?:\./+|/+)", "/")
    brought = (F.length(F.regexp_replace(decoded, r"[^/\\]", "")) > F.length(F.regexp_replace(path, r"[^/\\]", "")))
    unsafe = brought | slashed.rlike(r"^/|^[A-Za-z]:|^[A-Za-z][A-Za-z0-9+.-]*:|(?:^|/)~|(?:^|/)\.\.(?:/|$)|[?#\x00-\x1f]")
    out = F.when(decoded.rlike("%[0-9A-Fa-f]{2}"), F.lit("pdfs/source.pdf")).when(unsafe, F.concat(F.lit("pdfs/"), F.when(name == "", "source.pdf").otherwise(name)))
    return F.when(path.isNull() | (F.trim(path) == ""), F.lit("")).otherwise(out.otherwise(tidy))


def citation(path: Column, first: Column, last: Column) -> Column:
    """File name with its page or pages."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    pages = F.when(last.isNull() | (last == first), F.concat(F.lit("p"), first)).otherwise(F.concat(F.lit("p"), first, F.lit("-"), last))
    return F.concat_ws(" ", name, pages)


def term_snippet(text: Column, pattern: str, most: int = 120, before: int = 30) -> Column:
    """A piece of the text round the first match, the beginning where nothing matches."""
    found = F.regexp_instr(text, F.lit(pattern))
    at = F.greatest(F.lit(1), found - before)
    return F.when(F.length(text) <= most, text).otherwise(F.substring(text, at, F.lit(most)))


def strip_tags(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return one_spaced(F.regexp_replace(text, r"(?s)<[^>]+>", " "))
