"""Chat bodies: the inspected strings of a request in order, and the body with those strings replaced.

A body is JSON: `system` (a string, or blocks with `text`), then for each message `content` (a string, or blocks with
`text` and nested `content` of the same). Everything else passes through. Every string is a row of its own; nothing is
joined, so no pattern can match across strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = "struct<segment_no:int,path:string,segment:string>"


def _text(value: Column, path: Column) -> Column:
    """array<struct<path, segment>> with one string, or none."""
    return F.when(F.schema_of_variant(value) == "STRING", F.array(F.struct(path.alias("path"), F.variant_get(value, "$", "string").alias("segment")))).otherwise(
        F.array().cast("array<struct<path:string,segment:string>>")
    )


def _items(value: Column, at: str) -> Column:
    """The elements of the array at a path; nothing if it is no array."""
    return F.coalesce(F.try_variant_get(value, at, "array<variant>"), F.array().cast("array<variant>"))


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _index(path: Column, name: str, k: Column) -> Column:
    return F.concat(path, F.lit(f".{name}["), k.cast("string"), F.lit("]"))


def segments(body: Column) -> Column:
    """array<struct<path, segment>> of a JSON body, in order. A body that is no JSON object has none."""
    v = F.try_parse_json(body)

    def block(b: Column, path: Column) -> Column:
        nested = F.transform(_items(b, "$.content"), lambda x, k: _text(_field(x, "text"), F.concat(_index(path, "content", k), F.lit(".text"))))
        return F.concat(_text(_field(b, "text"), F.concat(path, F.lit(".text"))), F.flatten(nested))

    def message(m: Column, k: Column) -> Column:
        path = F.concat(F.lit("messages["), k.cast("string"), F.lit("]"))
        blocks = F.transform(_items(m, "$.content"), lambda b, j: block(b, _index(path, "content", j)))
        return F.concat(_text(_field(m, "content"), F.concat(path, F.lit(".content"))), F.flatten(blocks))

    system = F.transform(_items(v, "$.system"), lambda b, k: _text(_field(b, "text"), F.concat(F.lit("system["), k.cast("string"), F.lit("].text"))))
    return F.concat(_text(_field(v, "system"), F.lit("system")), F.flatten(system), F.flatten(F.transform(_items(v, "$.messages"), message)))


def flatten(requests: DataFrame, body: str = "body") -> DataFrame:
    """A row for each inspected string: the request's columns, segment_no, path, segment."""
    return requests.select("*", F.posexplode(segments(F.col(body))).alias("segment_no", "__s")).select(
        "*", F.col("__s.path").alias("path"), F.col("__s.segment").alias("segment")
    ).drop("__s")


def steps(path: str) -> list[str | int]:
    """messages[0].content[1].text as its steps."""
    return [int(x) if x.isdigit() else x for x in path.replace("]", "").replace("[", ".").split(".")]


@F.pandas_udf(T.StringType())
def _write_back(bodies: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for body, paths, texts in bodies:
        out = []
        for b, ps, ts in zip(body, paths, texts, strict=True):
            if b is None or ps is None or not len(ps):
                out.append(b)
                continue
            root = json.loads(b)
            for p, t in zip(ps, ts, strict=True):
                *way, last = steps(p)
                node = root
                for s in way:
                    node = node[s]
                node[last] = t
            out.append(json.dumps(root, ensure_ascii=False, separators=(",", ":")))
        yield pd.Series(out, dtype=object)


def rebuild(requests: DataFrame, rewritten: DataFrame, key: str = "request_id", body: str = "body", text: str = "rewritten_text", also: Mapping[str, Column] | None = None) -> DataFrame:
    """requests with `new_body`: every string of rewritten(key, path, segment_no, text) written back at its path. Strings
    are gathered for each request; a request with more or fewer of them than its body has fails the query, because a string
    that is lost would leave its place as it was. A body without strings stays as it is. also: further
    aggregates over a request's strings, by name."""
    more = [c.alias(n) for n, c in (also or {}).items()]
    parts = rewritten.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("segment_no", "path", F.col(text).alias("text")))).alias("__parts"), *more)
    joined = requests.join(parts, key, "left").withColumn("__n", F.coalesce(F.size(segments(F.col(body))), F.lit(0)))
    have = F.when(F.col("__parts").isNull(), 0).otherwise(F.size("__parts"))
    wrong = F.raise_error(F.concat(F.lit("a request has "), F.col("__n").cast("string"), F.lit(" strings, rewritten are "), have.cast("string"))).cast("string")
    some = lambda c: F.when(F.col("__parts").isNotNull(), c)
    new = _write_back(some(F.col(body)), F.transform("__parts", lambda x: x["path"]), F.transform("__parts", lambda x: x["text"]))
    return joined.withColumn("new_body", F.when(have != F.col("__n"), wrong).when(F.col("__parts").isNull(), F.col(body)).otherwise(new)).drop("__parts", "__n")


def requests(spark: SparkSession, path: str, stream: bool = False, at: Column | None = None) -> DataFrame:
    """Chat requests from JSON lines, as a batch or a stream: body, request_id, conversation_id. A request's id is
    pg_<seconds of `at`>_<8 hex digits of the body's SHA-256>, the same when a task is repeated; `at` is a fixed time, or
    the file's. A conversation is what metadata.conversation_id names, or the request itself."""
    lines = (spark.readStream if stream else spark.read).text(path).select(F.col("value").alias("body"), "_metadata.file_modification_time")
    when = F.unix_timestamp(F.col("file_modification_time") if at is None else at).cast("string")
    rows = lines.select("body", F.concat(F.lit("pg_"), when, F.lit("_"), F.substring(F.sha2("body", 256), 1, 8)).alias("request_id"))
    named = F.try_variant_get(F.try_parse_json("body"), "$.metadata.conversation_id", "string")
    return rows.withColumn("conversation_id", F.coalesce(F.nullif(named, F.lit("")), F.col("request_id")))


def conversation_bodies(turns: DataFrame) -> DataFrame:
    """A chat body for each conversation of turns(conv_id, turn, role, text)."""
    message = F.struct(F.col("role"), F.col("text").alias("content"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", message.alias("m"))))
    return turns.groupBy("conv_id").agg(F.to_json(F.struct(F.transform(ordered, lambda x: x["m"]).alias("messages"))).alias("body"))
