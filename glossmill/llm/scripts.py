"""Traditional to simplified characters, from the library that ships with Spark."""

from __future__ import annotations

from pyspark.sql import SparkSession

from glossmill.config import DOMAIN

_MADE: dict[int, str] = {}


def simplified_map(spark: SparkSession) -> dict[int, str]:
    """A table for `str.translate`: about 3,000 characters, made once on the driver.

    A session without a JVM of its own has the pairs of the domain only.
    """
    if not hasattr(spark, "_jvm"):
        return {ord(a): b for a, b in zip(*DOMAIN.scripts, strict=True)}
    if not _MADE:
        chars = [chr(c) for c in range(0x4E00, 0xA000)]
        change = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
        plain = change.transliterate("\n".join(chars)).split("\n")
        _MADE.update({ord(a): b for a, b in zip(chars, plain, strict=True) if a != b and len(b) == 1})
    return _MADE
