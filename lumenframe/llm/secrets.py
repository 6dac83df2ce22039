"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its content. The ledger keeps, per rule and its version, which blobs have been
scanned and what was found; a scan reads only pairs of blob and rule version that the ledger doesn't hold yet, and the
findings are joined back to every path that has the blob.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, prepare, text_column


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and don't overlap; ``keep`` may drop one, without a retry. ``hints``: a text whose
    lower-cased form holds none of them has no match, which saves the search."""

    name: str
    version: int
    pattern: str
    flags: int = 0
    least: int = 0
    group: int = 0
    hints: tuple[str, ...] = ()

    def finder(self) -> Callable[[str, str], list[tuple[int, int]]]:
        search, least, group, hints = re.compile(self.pattern, self.flags), self.least, self.group, self.hints

        def find(text: str, low: str) -> list[tuple[int, int]]:
            if hints and not any(h in low for h in hints):
                return []
            return [m.span() for m in search.finditer(text) if m.end(group) - m.start(group) >= least]

        return find


#: The rules whose spans are the base, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 6, 2,
         ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, 0, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: Rules beyond the base, for secrets that have a form of their own.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 0, 0, ("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, 0, ("eyj",)),
    Rule("url", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/@]{3,}@[A-Za-z0-9.-]+", 0, 0, 0, ("://",)),
)
LEDGER = "blob string, rule string, version int, spans string"


def blob_of(text: Column) -> Column:
    """The content address: SHA-256 of the UTF-8 text, null as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """One row per scanned blob and rule version; spans is a JSON list of [start, end]. A folder not yet there is empty."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def update(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Scan what the ledger lacks of the texts of ``docs``; returns blob, findings of all its blobs that have any.

    findings is array<struct<rule, start, end>> in code points, ordered by start, then by the order of ``rules``. Null
    texts are empty ones; an empty table scans nothing. Only blobs that lack one of the rule versions move: one row per
    distinct text after a partial aggregate in each task, so a group of copies costs one scan however large it is. The
    ledger is append-only Parquet; a scan that is run twice adds the same rows, of which readers take one.
    """
    spark = docs.sparkSession
    prepare(spark)
    wanted = {r.name: r.version for r in rules}
    held = read_ledger(spark, ledger)
    current = held.where(F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])[F.col("rule")] == F.col("version"))
    known = current.groupBy("blob").agg(F.collect_set("rule").alias("known"))
    texts = docs.select(text_column().alias("text")).withColumn("blob", blob_of(F.col("text")))
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    unseen = blobs.join(known, "blob", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    unseen = unseen.where(F.size("known") < len(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [(r, r.finder()) for r in rules]
        for batch in batches:
            out: dict[str, list] = {"blob": [], "rule": [], "version": [], "spans": []}
            for blob, text, seen in zip(*(c.to_pylist() for c in batch.columns)):
                low = text.lower()
                for r, find in finders:
                    if r.name not in seen:
                        for k, v in zip(out, (blob, r.name, r.version, json.dumps(find(text, low), separators=(",", ":")))):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("blob", pa.string()), ("rule", pa.string()), ("version", pa.int32()), ("spans", pa.string())]))

    unseen.select("blob", "text", "known").mapInArrow(run, LEDGER).write.mode("append").parquet(ledger)

    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    span = F.from_json("spans", "array<array<int>>")
    return (
        read_ledger(spark, ledger)
        .where(F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])[F.col("rule")] == F.col("version"))
        .where("spans != '[]'")
        .dropDuplicates(["blob", "rule"])
        .groupBy("blob")
        .agg(F.flatten(F.collect_list(F.transform(span, lambda s: F.struct(s[0].alias("start"), order[F.col("rule")].alias("at"), F.col("rule").alias("rule"), s[1].alias("end"))))).alias("f"))
        .select("blob", F.transform(F.array_sort("f"), lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings"))
    )


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """The columns of ``docs`` but text, with blob and findings: those of :func:`update`, joined back to every path.

    Repeated rows stay; a null text counts as an empty one; a text without findings has an empty list, however long it is;
    columns blob and findings of ``docs`` are replaced; an empty table gives an empty one. The join is on the blob; Spark's skew
    join splits a hot one.
    """
    found = update(docs, ledger, rules)
    paths = docs.withColumn("blob", blob_of(F.col("text"))).drop("text", "findings")
    return paths.join(found, "blob", "left").withColumn("findings", F.coalesce("findings", _nothing()))


def _nothing() -> Column:
    return F.array().cast("array<struct<rule:string,start:int,end:int>>")


def redacted(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mark: str = "<secret>") -> DataFrame:
    """The rows and columns of ``docs``, each finding in a text replaced by ``mark``, findings that overlap by one; n_chars,
    where there is such a column, follows the new text. Texts without findings, null and empty ones among them, stay as they are, and
    so do all other columns, whatever their names; repeated rows stay; an empty table gives an empty one."""
    found = update(docs, ledger, rules)
    both = packed(docs).withColumn("blob", blob_of(F.col("_row.text"))).join(found, "blob", "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, s, mark) for t, s in zip(text, spans)], dtype=object)

    none, own = F.col("findings").isNull(), F.col("_row.text")
    text = F.when(none, own).otherwise(cut(own, F.transform("findings", lambda x: F.array(x["start"], x["end"]))))
    out = both.select("_row", "findings", text.alias("_text"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(none, F.col("_row.n_chars")).otherwise(F.char_length("_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _cut(text: str | None, spans, mark: str) -> str | None:
    if text is None or spans is None:
        return text
    out, at = [], 0
    for start, end in sorted((int(s[0]), int(s[1])) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def listed(findings: Column) -> Column:
    """rule:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")


def count(findings: Column, rule: str) -> Column:
    return F.size(F.filter(findings, lambda x: x["rule"] == rule)).cast("long")
