"""Detection: every match of a catalogue with code-point offsets, and the rule for overlaps within a category.

All of it is Column expressions. A pattern's matches and the gaps between them come from one regex each, and offsets
are running sums of their lengths. A text without a pattern's literal anchor, or its gate, is never given to its regex.
Folds over a text's matches run in blocks of about the square root of their number, because an array that grows by one
element is copied each time.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.catalogue import ENTITY_LABELS, PATTERNS, PRIVACY_MODEL_LABELS, Pattern

DETECTION = "struct<category:string,start:int,end:int,matched_text:string,confidence:double,detector:string,ord:int>"
NONE = f"array<{DETECTION}>"


def empty() -> Column:
    return F.array().cast(NONE)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, wherever body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(items: Column) -> Column:
    """Places, from 1, where the blocks of an array start; and with F.slice and `width`, the blocks."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), width(items))).otherwise(F.array().cast("array<int>"))


def width(items: Column) -> Column:
    return F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"))


def folded(items: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What step(carry, item) -> (carry, array<kind>) gives for each item in order, in one array."""
    none = F.array().cast(f"array<{kind}>")

    def over(array: Column) -> Column:
        def block(done: Column, at: Column) -> Column:
            def one(s: Column, x: Column) -> Column:
                after, out = step(s["carry"], x)
                return F.struct(after.alias("carry"), F.concat(s["out"], out).alias("out"))

            start = F.struct(F.element_at(done, -1)["carry"].alias("carry"), none.alias("out"))
            return F.concat(done, F.array(F.aggregate(F.slice(array, at, width(array)), start, one)))

        done = F.aggregate(blocks(array), F.array(F.struct(carry.alias("carry"), none.alias("out"))), block)
        return F.flatten(F.transform(done, lambda s: s["out"]))

    return bound(items, over)


def slices(text: Column, spans: Column) -> Column:
    """The text of each span (start, end), for spans that ascend by start. A block's part of the text is cut out first,
    because finding a place in a string takes time by its distance."""

    def block(array: Column, at: Column) -> Column:
        some = F.slice(array, at, width(array))

        def cut(own: Column) -> Column:
            first = F.array_min(F.transform(own, lambda s: s["start"]))
            part = F.substring(text, first + 1, F.array_max(F.transform(own, lambda s: s["end"])) - first)
            pair = F.struct(first.alias("first"), part.alias("part"))
            return bound(pair, lambda p: F.transform(own, lambda s: F.substring(p["part"], s["start"] - p["first"] + 1, s["end"] - s["start"])))

        return bound(some, cut)

    return bound(spans, lambda array: F.flatten(F.transform(blocks(array), lambda at: block(array, at))))


def could_match(text: Column, low: Column, pattern: Pattern) -> Column:
    """Whether a text holds what every match of the pattern holds."""
    could = F.length(text) > 0
    if pattern.anchors:
        folds = pattern.regex.startswith("(?i)")
        could = could & reduce(lambda a, b: a | b, (F.contains(low if folds else text, F.lit(a)) for a in pattern.anchors))
    if pattern.gate:
        could = could & F.regexp_like(text, F.lit(pattern.gate))
    return could


def raw(text: Column, low: Column, pattern: Pattern, ordinal: int) -> Column:
    """A pattern's matches in order and the gaps around them, null if there are none, beside what names the pattern."""
    hits = F.when(could_match(text, low, pattern), F.regexp_extract_all(text, F.lit(pattern.java), F.lit(0)))
    return F.struct(
        F.lit(pattern.category).alias("category"),
        F.lit(pattern.confidence).alias("confidence"),
        F.lit(pattern.detector).alias("detector"),
        F.lit(ordinal).alias("ord"),
        hits.alias("hits"),
        F.lit(pattern.java).alias("regex"),
    )


def place(text: Column, found: Column) -> Column:
    """Detections, ascending, of what `raw` finds."""

    def step(at: Column, piece: Column) -> tuple[Column, Column]:
        start = at + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        one = F.struct(
            found["category"].alias("category"),
            start.alias("start"),
            end.alias("end"),
            piece["hit"].alias("matched_text"),
            found["confidence"].alias("confidence"),
            found["detector"].alias("detector"),
            found["ord"].alias("ord"),
        )
        return F.coalesce(end, at), F.when(piece["hit"].isNull(), empty()).otherwise(F.array(one).cast(NONE))

    pieces = F.arrays_zip(F.split(text, found["regex"], -1).alias("gap"), found["hits"].alias("hit"))
    return F.when(F.size(found["hits"]) > 0, folded(pieces, F.lit(0), step, DETECTION)).otherwise(empty())


def lowered(text: Column) -> Column:
    """In lower case; the signs beside ASCII that a regex takes for ASCII letters in either case are these letters."""
    strange = reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in "\u017f\u0130\u0131\u212a"))
    return F.lower(F.when(strange, F.translate(text, "\u017f\u0130\u0131\u212a", "siik")).otherwise(text))


def settle(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with the columns added behind a one-element generator. The optimiser neither copies an expression through it
    into later ones nor pushes predicates on its result below, so long expressions are planned and computed once."""
    names = [n for n in rows.columns if n not in columns]
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__settled")
    return rows.select("*", one).select(*names, *[F.col(f"__settled.{n}").alias(n) for n in columns])


def overlap_free(found: Column) -> Column:
    """Of one category's detections, those that start where the last kept one has ended or later, by start, then the
    longer, then the more confident."""
    key = lambda d: F.struct(d["start"].alias("a"), (d["start"] - d["end"]).alias("b"), (-d["confidence"]).alias("c"), d["ord"].alias("e"), d.alias("d"))

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        keep = x["a"] >= last
        return F.when(keep, x["d"]["end"]).otherwise(last), F.when(keep, F.array(x["d"])).otherwise(empty())

    return F.when(F.size(found) < 2, found).otherwise(folded(F.sort_array(F.transform(found, key)), F.lit(0), step, DETECTION))


def by_position(found: Column) -> Column:
    """By start and end; ties in the catalogue's order."""
    order = F.sort_array(
        F.transform(found, lambda d: F.struct(d["start"].alias("a"), d["end"].alias("b"), d["ord"].alias("c"), d.alias("d")))
    )
    return F.transform(order, lambda x: x["d"])


def detect(text: Column, patterns: Iterable[Pattern] = PATTERNS, dedupe: bool = True) -> Column:
    """The catalogue's detections in a text. Categories never suppress each other."""
    patterns = list(patterns)

    def scan(x: Column) -> Column:
        each = F.array(*[raw(x["text"], x["low"], p, k) for k, p in enumerate(patterns)])
        return F.transform(each, lambda found: place(x["text"], found))

    def settled(each: Column) -> Column:
        if not dedupe:
            return F.flatten(each)
        grouped: dict[str, list[Column]] = {}
        for k, p in enumerate(patterns):
            grouped.setdefault(p.category, []).append(F.get(each, F.lit(k)))
        by_category = F.array(*[F.concat(*c) if len(c) > 1 else c[0] for c in grouped.values()])
        return by_position(F.flatten(F.transform(by_category, overlap_free)))

    return bound(bound(F.struct(text.alias("text"), lowered(text).alias("low")), scan), settled) if patterns else empty()


class Detector(ABC):
    """A detector makes a Column of struct<detections: array of DETECTION, error: string> from a text column. matched_text
    must be the text from start to end."""

    name: str

    @abstractmethod
    def column(self, text: Column) -> Column: ...

    def validate(self) -> None:
        """Raises if the detector cannot run; called when a plan is built."""


class RegexDetector(Detector):
    name = "regex"

    def __init__(self, patterns: Sequence[Pattern] = PATTERNS, dedupe: bool = True) -> None:
        self.patterns, self.dedupe = tuple(patterns), dedupe

    def column(self, text: Column) -> Column:
        return F.struct(detect(text, self.patterns, self.dedupe).alias("detections"), F.lit(None).cast("string").alias("error"))


class ModelDetector(Detector):
    """Detections of a token-classification model. call: from a text column to LABELLED (a pandas UDF, in general), or with
    tells to a struct of these (found) and an error, as `guarded` makes of a plain function. Labels map to categories; others
    are `other`."""

    def __init__(self, name: str, call, labels: Mapping[str, str], upper: bool = False, ready=None, tells: bool = False) -> None:
        self.name, self.call, self.labels, self.upper, self.ready, self.tells = name, call, dict(labels), upper, ready, tells

    def validate(self) -> None:
        if self.ready is not None and (why := self.ready()):
            raise RuntimeError(f"detector {self.name} is not ready: {why}")

    def column(self, text: Column) -> Column:
        fold = F.upper if self.upper else F.lower
        table = F.create_map(*[F.lit(v) for kv in self.labels.items() for v in kv])

        def one(x: Column) -> Column:
            return F.struct(
                F.coalesce(F.try_element_at(table, fold(x["label"])), F.lit("other")).alias("category"),
                x["start"].cast("int").alias("start"),
                x["end"].cast("int").alias("end"),
                F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("matched_text"),
                x["score"].cast("double").alias("confidence"),
                F.concat(F.lit(f"{self.name}:"), F.coalesce(F.nullif(fold(x["label"]), F.lit("")), F.lit("unknown"))).alias("detector"),
                F.lit(1000).alias("ord"),
            )

        def result(reply: Column) -> Column:
            why = reply["error"] if self.tells else F.when(text.isNotNull() & reply.isNull(), F.lit("no reply"))
            found = reply["found"] if self.tells else reply
            return F.struct(F.coalesce(F.transform(found, one), empty()).alias("detections"), why.alias("error"))

        return bound(self.call(text), result)


LABELLED = "array<struct<label:string,start:int,end:int,score:double>>"


def guarded(function: Callable[[str], Iterable[Mapping]], entities: Iterable[str] | None = None) -> Callable[[Column], Column]:
    """A call for ModelDetector of a function from a text to mappings with label (or entity_type, or entity_group), start,
    end and score; a reply may also be a mapping that holds them under `detections`. What it raises on a text becomes that
    row's error; other texts and other detectors keep their detections. entities: the labels to keep, all if None."""
    wanted = None if entities is None else {x.lower() for x in entities}

    def one(text: str) -> dict:
        try:
            reply = function(text)
            reply = reply["detections"] if isinstance(reply, Mapping) else reply
            rows = [(str(x.get("label") or x.get("entity_type") or x.get("entity_group") or ""), int(x["start"]), int(x["end"]), float(x["score"])) for x in reply]
            rows = [r for r in rows if wanted is None or r[0].lower() in wanted]
            return {"found": [dict(zip(("label", "start", "end", "score"), r, strict=True)) for r in rows], "error": None}
        except Exception as e:  # whatever it is, it is this row's error
            return {"found": None, "error": f"{type(e).__name__}: {e}"}

    @F.pandas_udf(f"struct<found:{LABELLED},error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{"found": None, "error": None} if t is None else one(t) for t in texts], columns=["found", "error"])

    return run


STRATEGIES = ("simple", "first", "average", "max")


def entities(tokens: Column, strategy: str = "simple") -> Column:
    """Entities of a token classifier's tokens, array<struct<label, start, end, score, inside>> in order, where a label may
    begin with B- or I- and `inside` says that a token goes on in the word of the one before: array LABELLED. Under `simple`
    tokens stand for themselves. Else a word has one label and score: under `first` those of its first token, under `max`
    those of its surest, under `average` the label with the largest mean over its tokens. Neighbours of equal label are one
    entity with their mean score, unless the later begins with B-; the label O is none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"the strategy must be one of {', '.join(STRATEGIES)}")
    word_type = "struct<start:int,end:int,tokens:array<struct<label:string,score:double>>>"
    token = lambda x: F.struct(x["label"].alias("label"), x["score"].cast("double").alias("score"))
    fresh = lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), F.array(token(x)).alias("tokens")).cast(word_type)
    none = F.lit(None).cast(word_type)

    def join(word: Column, x: Column) -> tuple[Column, Column]:
        on = F.lit(False) if strategy == "simple" else word.isNotNull() & F.coalesce(x["inside"], F.lit(False)) & x["end"].isNotNull()
        longer = F.struct(word["start"].alias("start"), x["end"].cast("int").alias("end"), F.concat(word["tokens"], F.array(token(x))).alias("tokens")).cast(word_type)
        closed = F.when(on | word.isNull(), F.array().cast(f"array<{word_type}>")).otherwise(F.array(word))
        return F.when(on, longer).otherwise(F.when(x["end"].isNull(), none).otherwise(fresh(x))), closed

    stop = F.array(F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("label", "string"), ("start", "int"), ("end", "int"), ("score", "double"), ("inside", "boolean"))]))
    kind = "array<struct<label:string,start:int,end:int,score:double,inside:boolean>>"

    def settled(w: Column) -> Column:
        first = F.get(w["tokens"], F.lit(0))
        best = F.sort_array(F.transform(w["tokens"], lambda t, k: F.struct((-t["score"]).alias("a"), k.alias("k"), t["label"].alias("label"))))
        means = F.transform(F.array_distinct(F.transform(w["tokens"], lambda t: t["label"])), lambda n: F.struct((-F.aggregate(F.filter(w["tokens"], lambda t: t["label"] == n), F.lit(0.0), lambda a, t: a + t["score"]) / F.size(w["tokens"])).alias("a"), F.lit(0).alias("k"), n.alias("label")))
        pick = F.get(F.sort_array(means) if strategy == "average" else best, F.lit(0))
        label, sure = (first["label"], first["score"]) if strategy in ("simple", "first") else (pick["label"], -pick["a"])
        return F.struct(F.regexp_replace(label, "^[BI]-", "").alias("label"), w["start"].alias("start"), w["end"].alias("end"), F.array(sure).alias("scores"), F.startswith(label, F.lit("B-")).alias("begins"))

    group = "struct<label:string,start:int,end:int,scores:array<double>,begins:boolean>"
    empty_group, no_groups = F.lit(None).cast(group), F.array().cast(f"array<{group}>")

    def merge(open_: Column, w: Column) -> tuple[Column, Column]:
        on = open_.isNotNull() & (w["label"] == open_["label"]) & ~w["begins"]
        longer = F.struct(open_["label"].alias("label"), open_["start"].alias("start"), w["end"].alias("end"), F.concat(open_["scores"], w["scores"]).alias("scores"), open_["begins"].alias("begins")).cast(group)
        return F.when(F.coalesce(on, F.lit(False)), longer).otherwise(w.cast(group)), F.when(F.coalesce(on, F.lit(False)) | open_.isNull(), no_groups).otherwise(F.array(open_))

    words = F.transform(folded(F.concat(tokens.cast(kind), stop), none, join, word_type), settled).cast(f"array<{group}>")
    groups = folded(F.concat(words, F.array(empty_group)), empty_group, merge, group)
    mean = lambda g: F.aggregate(g["scores"], F.lit(0.0), lambda a, x: a + x) / F.size(g["scores"])
    named = F.filter(groups, lambda g: g["label"] != "O")
    return F.transform(named, lambda g: F.struct(g["label"].alias("label"), g["start"].alias("start"), g["end"].alias("end"), mean(g).alias("score"))).cast(LABELLED)


def privacy_model(call, ready=None, tells: bool = False) -> ModelDetector:
    return ModelDetector("opf", call, PRIVACY_MODEL_LABELS, ready=ready, tells=tells)


def entity_model(call, ready=None, tells: bool = False) -> ModelDetector:
    return ModelDetector("presidio", call, ENTITY_LABELS, upper=True, ready=ready, tells=tells)


def detect_all(text: Column, detectors: Sequence[Detector], on_error: str = "open") -> Column:
    """struct<detections, errors>: all detections in the detectors' order. on_error: `open` keeps the others'
    detections beside the errors, `closed` fails the query."""
    if not detectors:
        raise ValueError("a policy must enable a detector")
    results = [d.column(text) for d in detectors]
    errors = F.array_compact(F.array(*[r["error"] for r in results]))
    found = F.concat(*[r["detections"] for r in results]) if len(results) > 1 else results[0]["detections"]
    if on_error == "closed":
        found = F.when(F.size(errors) > 0, F.raise_error(F.concat_ws("; ", errors)).cast(NONE)).otherwise(found)
    return F.struct(found.alias("detections"), errors.alias("errors"))
