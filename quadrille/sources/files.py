"""File sources and sinks: declared schemas, positions as explicit columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import ranked

MODELS = "position long, name string, developer string, experimental boolean, max_sequence_length long, batch_size long, iteration_offset long, approx_model_size long"
SCORES = "position long, model string, iteration long, AVG double, EL double, FA double, HE double, MC double, MR double, MT double, NLI double, QA double, RC double, SUM double"
LOSS = "position long, steps long, loss double"
CURVE = "position long, loss double, eval double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, by a declared schema; empty fields are null."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_run_losses(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Loss files of several runs; the run is the file's name without its ending."""
    rows = spark.read.schema(LOSS).option("header", True).csv(paths)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return rows.withColumn("model", F.regexp_extract(name, r"^(.*)\.csv$", 1))


def read_tsv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """A headerless (and perhaps gzipped) TSV as strings _c0, _c1, ..; a gzip file is one task."""
    schema = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(columns)])
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``index``: their position by an explicit order of columns of any types."""
    return ranked(rows, F.col(order[0]), list(order[1:]), "index")


def read_numbers(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines of numbers apart by white space, as one double column for each name."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(*[F.get(parts, F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)])


def write_numbers(rows: DataFrame, path: str, columns: list[str], form: str = "%16.14f ") -> None:
    rows.select(F.format_string(form * len(columns), *columns).alias("value")).write.text(path)


def ascii_json(text: Column) -> Column:
    """A JSON string of text in which everything beyond ASCII is a \\u escape, in UTF-16 units."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    units = F.regexp_replace(F.hex(F.encode(quoted, "UTF-16BE")), "(....)", "$1 ")
    each = F.transform(F.filter(F.split(units, " "), lambda u: u != ""), lambda u: F.when(u < "0080", F.decode(F.unhex(F.substring(u, 3, 2)), "US-ASCII")).otherwise(F.concat(F.lit("\\u"), F.lower(u))))
    return F.when(F.octet_length(quoted) == F.char_length(quoted), quoted).otherwise(F.array_join(each, ""))


def write_jsonl(rows: DataFrame, path: str, text: str = "text") -> None:
    """{"text": ".."} a line, escaped to ASCII; null texts are left out."""
    rows.where(F.col(text).isNotNull()).select(F.concat(F.lit('{"text": '), ascii_json(F.col(text)), F.lit("}")).alias("value")).write.text(path)


def read_yaml(path: str) -> dict:
    """A configuration file of nested keys, lists of scalars and scalars, two or more spaces a level, with # comments.

    That is the part of YAML that configurations use; anchors, block texts and inline collections raise an error.
    """
    def scalar(text: str):
        if text in ("", "null", "~"):
            return None
        if text[0] in "{[&*|>":
            raise ValueError(f"not supported: {text}")
        if text[0] in "'\"":
            return text[1:-1]
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                pass
        return {"true": True, "false": False}.get(text.lower(), text)

    with open(path, encoding="utf-8") as file:
        lines = [(len(x) - len(x.lstrip()), x.strip()) for x in (re.sub(r"(^|\s)#.*$", "", line).rstrip() for line in file) if x.strip() and x.strip() != "---"]

    def block(at: int, indent: int):
        if lines[at][1].startswith("-"):
            out = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
                out.append(scalar(lines[at][1][1:].strip()))
                at += 1
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == indent:
            key, colon, rest = lines[at][1].partition(":")
            if not colon:
                raise ValueError(f"not a key: {key}")
            at += 1
            deeper = at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("-")))
            if not rest.strip() and deeper:
                out[key.strip()], at = block(at, lines[at][0])
            else:
                out[key.strip()] = scalar(rest.strip())
        return out, at

    found, at = block(0, lines[0][0]) if lines else ({}, 0)
    if at < len(lines):
        raise ValueError(f"wrong indentation: {lines[at][1]}")
    return found


def write_index_csv(rows: DataFrame, path: str, *order: str) -> None:
    """CSV with a header and a leading index column."""
    named = numbered(rows, *order)
    named.select("index", *rows.columns).write.option("header", True).csv(path)


def override(table: DataFrame, answers: DataFrame | None, key: str, value: str) -> DataFrame:
    """table with ``value`` from answers where they have the key; answers may be missing altogether."""
    if answers is None:
        return table
    given = answers.select(key, F.col(value).alias("__given"))
    return table.join(given, key, "left").withColumn(value, F.coalesce("__given", value)).drop("__given")


def setting(environment: dict[str, str], *names: str, default: str = "0") -> str:
    """The first of the names that is set; the launchers' names go in falling priority."""
    return next((environment[n] for n in names if n in environment), default)


def fetch(urls: DataFrame, get) -> DataFrame:
    """(url, name, content) by ``get(url) -> bytes``; empty answers are dropped, of equal names the last url stays."""
    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"url": x.url, "name": x.url.str.rsplit("/", n=1).str[-1], "content": [get(u) for u in x.url]})

    got = urls.select("url").mapInPandas(load, "url string, name string, content binary").where("length(content) > 0")
    return got.groupBy("name").agg(F.max_by(F.struct("url", "content"), "url").alias("x")).select("x.url", "name", "x.content")


def cluster_dump(members: DataFrame, centroids: DataFrame) -> DataFrame:
    """(k, ord, id, x, y): each cluster's centroid, then its members, in order."""
    head = centroids.select("k", F.lit(0).alias("ord"), F.lit(None).cast("long").alias("id"), "x", "y")
    return head.unionByName(members.select("k", F.lit(1).alias("ord"), "id", "x", "y")).orderBy("k", "ord", "id")


def rank_report(pairs: DataFrame) -> DataFrame:
    """Lines for ranks 1, 10, 100 and 1000 of closest pairs."""
    text = F.format_string("%5d %10.15e %d %d", F.col("rank").cast("int"), F.sqrt("dist2"), "i", "j")
    return pairs.where(F.col("rank").isin(1, 10, 100, 1000)).select("rank", text.alias("line"))


def config_row(spark: SparkSession, settings: dict) -> DataFrame:
    """A nested configuration as one row of nested structs."""
    import json

    text = json.dumps(settings)
    schema = spark.range(1).select(F.schema_of_json(F.lit(text)).alias("s")).first().s
    return spark.range(1).select(F.from_json(F.lit(text), schema).alias("config")).select("config.*")


def free_busy(answers: DataFrame, column: str = "value") -> DataFrame:
    """(cal, s, e) of JSON answers {"calendars": {id: {"busy": [{"start", "end"}]}}} with RFC 3339 times."""
    schema = "calendars map<string, struct<busy: array<struct<start: string, end: string>>>>"
    by_calendar = answers.select(F.explode(F.from_json(column, schema)["calendars"]).alias("cal", "own"))
    each = by_calendar.select("cal", F.explode("own.busy").alias("b"))
    return each.select("cal", F.to_timestamp("b.start").alias("s"), F.to_timestamp("b.end").alias("e"))


def write_contents(rows: DataFrame, uri: str) -> None:
    """A file for each (name, content) under a shared folder; empty contents leave none, repeated names the largest content.

    Files are written under the name of the attempt and then renamed, so a repeated task changes nothing.
    """
    last = rows.where("length(content) > 0").groupBy("name").agg(F.max("content").alias("content"))

    def put(part) -> None:
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder)
        for r in part:
            temporary = f"{folder}/.{TaskContext.get().taskAttemptId()}-{r['name']}"
            with store.open_output_stream(temporary, compression=None) as out:
                out.write(bytes(r["content"]))
            store.move(temporary, f"{folder}/{r['name']}")

    last.foreachPartition(put)


def missing_columns(rows: DataFrame, *needed: str) -> list[str]:
    """Which of the columns a run's history doesn't have."""
    return [c for c in needed if c not in rows.columns]
