"""SQL functions: pii_detect(text), pii_mask(text), pii_normalize(text), and the table function pii_spans(text).

SQL has no way to take a Column as a function body, so these run over Arrow batches; in DataFrame code use
`detect.detect` and `rewrite.apply`, which stay in the JVM and give the same detections.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sluice.functions.catalogue import PATTERNS, Pattern
from sluice.operators.normalize import normalize

Found = tuple[str, int, int, str, float, str]
SPAN = "category string, start int, end int, matched_text string, confidence double, detector string"


class Scanner:
    """The catalogue in Python's spelling, which the patterns share but for the flags that Java needs."""

    def __init__(self, patterns: Iterable[Pattern] = PATTERNS) -> None:
        self.patterns = [(k, p, re.compile(p.regex)) for k, p in enumerate(patterns)]

    def detect(self, text: str | None) -> list[Found]:
        """Detections by start and end, overlaps within a category resolved by start, length and confidence."""
        by_category: dict[str, list[tuple[int, int, float, int, Found]]] = {}
        low = (text or "").lower()
        for k, p, regex in self.patterns:
            if p.anchors and not any(a in (low if p.regex.startswith("(?i)") else text or "") for a in p.anchors):
                continue
            for m in regex.finditer(text or ""):
                found = (p.category, m.start(), m.end(), m[0], p.confidence, p.detector)
                by_category.setdefault(p.category, []).append((m.start(), m.start() - m.end(), -p.confidence, k, found))
        kept = []
        for group in by_category.values():
            last = 0
            for start, _, _, k, found in sorted(group):
                if start >= last:
                    last = found[2]
                    kept.append((start, last, k, found))
        return [x[-1] for x in sorted(kept)]

    def mask(self, text: str | None) -> str | None:
        """The text with its detections masked, longest first, none overlapping another."""
        taken: list[Found] = []
        for d in sorted(self.detect(text), key=lambda d: (d[1] - d[2], -d[4])):
            if all(d[2] <= t[1] or t[2] <= d[1] for t in taken):
                taken.append(d)
        for category, start, end, *_ in sorted(taken, key=lambda t: -t[1]):
            text = f"{text[:start]}[{category.upper()}_REDACTED]{text[end:]}"
        return text


def register(spark: SparkSession, patterns: Iterable[Pattern] = PATTERNS) -> None:
    """Makes the functions known to the session's SQL."""
    scanner = Scanner(patterns)

    @F.pandas_udf(f"array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>")
    def pii_detect(text: pd.Series) -> pd.Series:
        names = [x.split()[0] for x in SPAN.split(", ")]
        return pd.Series([[dict(zip(names, d, strict=True)) for d in scanner.detect(t)] for t in text], dtype=object)

    @F.pandas_udf("string")
    def pii_mask(text: pd.Series) -> pd.Series:
        return pd.Series([scanner.mask(t) for t in text], dtype=object)

    @F.pandas_udf("string")
    def pii_normalize(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else normalize(t)[0].text for t in text], dtype=object)

    @F.udtf(returnType=SPAN)
    class PiiSpans:
        def eval(self, text: str) -> Iterator[Found]:
            yield from scanner.detect(text)

    for name, function in (("pii_detect", pii_detect), ("pii_mask", pii_mask), ("pii_normalize", pii_normalize)):
        spark.udf.register(name, function)
    spark.udtf.register("pii_spans", PiiSpans)
