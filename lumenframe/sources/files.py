"""Readers and sinks: delimited text, JSON, Parquet, ORC, text, JDBC; versioned datasets, tables with a manifest, exports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings tried in this order, delimiters, rows of a preview.
ENCODINGS = ("utf-8", "latin-1", "iso-8859-1", "cp1252")
DELIMITERS = (",", "\t", ";", "|")
PREVIEW = 25


def sniff(head: bytes) -> tuple[str, str]:
    """The first encoding that decodes a file's beginning, and the delimiter that cuts its lines most evenly."""
    for encoding in ENCODINGS:
        try:
            text = head.decode(encoding)
            break
        except UnicodeDecodeError as e:
            if encoding == "utf-8" and e.start >= len(head) - 4:
                text = head[: e.start].decode(encoding)
                break
    lines = [x for x in text.splitlines() if x][:20] or [""]
    return encoding, max(DELIMITERS, key=lambda d: (min(x.count(d) for x in lines), -DELIMITERS.index(d)))


def _head(spark: SparkSession, path: str, size: int = 10_000) -> bytes:
    """The first bytes of the path's first file that has any, however large it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    waiting = sorted(files.globStatus(where) or [], key=lambda x: x.getPath().toString())
    while waiting:
        found = waiting.pop(0)
        if found.isDirectory():
            inside = [x for x in files.listStatus(found.getPath()) if x.getPath().getName()[:1] not in ("_", ".")]
            waiting = sorted(inside, key=lambda x: x.getPath().toString()) + waiting
        elif found.getLen():
            stream = files.open(found.getPath())
            try:
                return bytes(stream.readNBytes(size))
            finally:
                stream.close()
    return b""


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str | None = None, delimiter: str | None = None, header: bool = True) -> DataFrame:
    """Lines that don't fit are left out. Without a schema, encoding or delimiter the file's beginning tells."""
    if not (encoding and delimiter):
        e, d = sniff(_head(spark, path))
        encoding, delimiter = encoding or e, delimiter or d
    charset = "iso-8859-1" if encoding.lower() in ("latin-1", "latin1", "cp1252") else encoding  # the one that Spark knows
    reader = spark.read.options(header=header, sep=delimiter, encoding=charset, mode="DROPMALFORMED")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """By the given kind or the path's ending."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        return read_csv(spark, path, **options)
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.options(multiLine=kind == "json", **options).json(path)
    if kind in ("parquet", "orc"):
        return spark.read.options(**options).format(kind).load(path)
    if kind in ("txt", "text", "md"):
        return spark.read.options(wholetext=True).text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    raise ValueError(f"no reader for {kind}")


#: Driver classes by URL scheme.
JDBC = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "sqlite": "org.sqlite.JDBC", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver"}


def jdbc_options(url: str, query: str, timeout: int = 15, limit: int | None = 200_000) -> dict[str, str]:
    """Options of a guarded read-only query; the scheme chooses the driver. Without a limit all rows are read."""
    from ..plans.sql import validate_readonly

    scheme = url.split(":")[1] if url.startswith("jdbc:") else url.split(":")[0]
    return {"url": url if url.startswith("jdbc:") else f"jdbc:{url}", "driver": JDBC[scheme], "query": f"SELECT * FROM ({validate_readonly(query)}) AS q" + (f" LIMIT {limit}" if limit is not None else ""), "queryTimeout": str(timeout)}


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).partitionBy(*(partition_by or []))
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def version_id(parent: str, steps: list[dict]) -> str:
    """Equal parents and steps give an equal version."""
    return hashlib.sha256(json.dumps([parent, steps], sort_keys=True, default=str).encode()).hexdigest()[:16]


def transform_version(spark: SparkSession, root: str, parent: str, steps: list[dict]) -> str:
    """Apply steps to a stored version and write the result as a child version, with the steps beside it."""
    from ..operators.transforms import apply

    child = version_id(parent, steps)
    out = apply(spark.read.parquet(f"{root}/{parent}"), steps)
    out.write.mode("overwrite").parquet(f"{root}/{child}")
    spark.createDataFrame([(child, parent, json.dumps(steps, default=str))], "version string, parent string, steps string").coalesce(1).write.mode("overwrite").json(f"{root}/_meta/{child}")
    return child


def write_table(df: DataFrame, root: str, name: str, operator: str = "", params: dict | None = None) -> DataFrame:
    """Parquet and a manifest row: place, schema, rows and a preview as JSON."""
    key = hashlib.sha256(name.encode()).hexdigest()
    path = f"{root}/{key[:2]}/{key[2:4]}/{name}"
    df.write.mode("overwrite").parquet(path)
    kept = df.sparkSession.read.parquet(path)
    preview = json.dumps([r.asDict(recursive=True) for r in kept.limit(PREVIEW).collect()], default=str)
    manifest = [(name, path, kept.schema.json(), kept.count(), operator, json.dumps(params or {}, default=str), preview)]
    out = df.sparkSession.createDataFrame(manifest, "name string, path string, schema string, rows long, operator string, params string, preview string")
    out.coalesce(1).write.mode("overwrite").json(f"{path}.manifest")
    return out


def write_metric(spark: SparkSession, root: str, name: str, value: float, unit: str = "") -> None:
    spark.createDataFrame([(name, float(value), unit)], "name string, value double, unit string").coalesce(1).write.mode("overwrite").json(f"{root}/metrics/{name}")


def catalog_entry(df: DataFrame, name: str, tags: list[str] = (), owner: str = "", description: str = "") -> DataFrame:
    return df.sparkSession.createDataFrame([(name, list(tags), owner, description, df.schema.json())], "name string, tags array<string>, owner string, description string, schema string")


def search_catalog(entries: DataFrame, text: str | None = None, tags: list[str] | None = None, owner: str | None = None) -> DataFrame:
    out = entries
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "name", "description")), F.lit(text.lower())))
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return out.where(F.col("owner") == owner) if owner else out


def lineage(edges: DataFrame, column: str, upstream: bool = True, most: int = 50) -> DataFrame:
    """All columns that reach a column (or that it reaches) through edges (source, target)."""
    a, b = ("target", "source") if upstream else ("source", "target")
    seen = edges.sparkSession.createDataFrame([(column, 0)], "node string, depth int")
    front = seen
    for depth in range(1, most + 1):
        front = edges.join(F.broadcast(front), edges[a] == front["node"]).select(F.col(b).alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.where("depth > 0")


def log_run(spark: SparkSession, root: str, run: str, params: dict, metrics: dict[str, float]) -> None:
    """One run of an experiment as a row of its own, so that runs can be written side by side."""
    row = [(run, json.dumps(params, sort_keys=True, default=str), {k: float(v) for k, v in metrics.items()})]
    spark.createDataFrame(row, "run string, params string, metrics map<string,double>").coalesce(1).write.mode("append").parquet(f"{root}/runs")


def best_run(spark: SparkSession, root: str, metric: str, largest: bool = True) -> DataFrame:
    value = F.col("metrics")[metric]
    return spark.read.parquet(f"{root}/runs").where(value.isNotNull()).orderBy(value.desc() if largest else value.asc(), "run").limit(1)


def choose_chart(df: DataFrame, x: str | None = None, y: str | None = None) -> str:
    """By the columns' types: line over time, scatter of numbers, bars by category, histogram of one number."""
    kind = lambda c: None if c is None else "time" if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "number" if isinstance(df.schema[c].dataType, T.NumericType) else "category"
    a, b = kind(x), kind(y)
    return {("time", "number"): "line", ("number", "number"): "scatter", ("category", "number"): "bar", ("number", "category"): "box", ("category", "category"): "heatmap", ("number", None): "histogram", ("category", None): "bar", ("time", None): "line"}.get((a, b), "table")
