"""Guarded read-only SQL over one view, a statement builder, cost hints, and plain-language questions."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that a statement may not hold outside of literals, functions that read files, limits.
FORBIDDEN = tuple("insert update delete drop alter create truncate grant revoke copy call execute vacuum attach detach pragma".split())
FILE_FUNCTIONS = tuple("read_csv read_csv_auto read_parquet read_json read_json_auto parquet_scan csv_scan json_scan sqlite_scan postgres_scan mysql_scan iceberg_scan delta_scan".split())
DEFAULT_ROWS, MAX_ROWS = 1000, 50_000
#: Nodes of a parsed statement that only read, table functions that make rows of their arguments, functions that reach the machine.
READING = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Union Except Intersect UnresolvedWith SubqueryAlias UnresolvedHaving "
    "OneRowRelation UnresolvedInlineTable UnresolvedRelation UnresolvedTableValuedFunction UnresolvedSubqueryColumnAliases Generate WithWindowDefinition Window Pivot "
    "Unpivot UnresolvedPivot LateralJoin Sample Tail LocalRelation UnresolvedOrderByAll Expand AggregateInPandas".split()
)
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
MACHINE_FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name".split())


class UnsafeSQL(ValueError):
    """The statement isn't a single read of the dataset."""


#: Literals, quoted names and comments.
_LITERALS = re.compile(r"""'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/""", re.S)


def _bare(sql: str) -> str:
    """Without comments and the contents of literals."""
    return _LITERALS.sub(lambda m: " " if m[0][:2] in ("--", "/*") else m[0][0] * 2, sql).strip()


def normalize(sql: str) -> str:
    out = sql.strip()
    while _bare(out).endswith(";") and out.endswith(";"):
        out = out[:-1].rstrip()
    if not out or ";" in _bare(out):
        raise UnsafeSQL("one statement is asked for")
    return out


def validate_readonly(sql: str) -> str:
    out = normalize(sql)
    bare = _bare(out)
    if not re.match(r"(?i)(select|with)\b", bare):
        raise UnsafeSQL("only SELECT and WITH are allowed")
    if m := re.search(rf"(?i)\b({'|'.join(FORBIDDEN)})\b", bare):
        raise UnsafeSQL(f"{m[1]} isn't allowed")
    return out


def validate_dataset(sql: str) -> str:
    out = validate_readonly(sql)
    bare = _bare(out)
    if m := re.search(rf"(?i)\b({'|'.join(FILE_FUNCTIONS)})\b", bare):
        raise UnsafeSQL(f"{m[1]} isn't allowed")
    if re.search(r"""(?i)\b(from|join)\s+['"]""", bare):
        raise UnsafeSQL("files can't be read")
    return out


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _checked_expression(node, names: frozenset[str]) -> None:
    if node.nodeName() == "UnresolvedFunction" and (called := [str(x).lower() for x in _items(node.nameParts())]) and called[-1] in MACHINE_FUNCTIONS:
        raise UnsafeSQL(f"{called[-1]} isn't allowed")
    for child in _items(node.children()):
        _checked_expression(child, names)


def _checked(plan, names: frozenset[str]) -> None:
    """Refuses a parsed plan that does more than read the relations of ``names``, at any depth."""
    kind = plan.nodeName()
    if kind not in READING:
        raise UnsafeSQL(f"{kind} isn't allowed")
    if kind == "UnresolvedRelation":
        parts = [str(x).lower() for x in _items(plan.multipartIdentifier())]
        if len(parts) != 1 or parts[0] not in names:
            raise UnsafeSQL(f"unknown relation: {'.'.join(parts)}")
    elif kind == "UnresolvedTableValuedFunction":
        called = [str(x).lower() for x in _items(plan.name())]
        if called[-1] not in TABLE_FUNCTIONS:
            raise UnsafeSQL(f"{called[-1]} isn't allowed")
    elif kind == "UnresolvedWith":
        for pair in _items(plan.cteRelations()):
            _checked(pair._2(), names)
            names |= {str(pair._1()).lower()}
    for expression in _items(plan.expressions()):
        _checked_expression(expression, names)
    for part in [*_items(plan.children()), *_items(plan.subqueries())]:
        _checked(part, names)


def query_dataset(df: DataFrame, sql: str, limit: int = DEFAULT_ROWS) -> DataFrame:
    """The statement over a view ``dataset``. The parsed plan is walked, with its subqueries and named parts: other relations, files,
    other table functions, and anything that isn't a read are refused."""
    checked = validate_dataset(sql)
    spark = df.sparkSession
    _checked(spark._jsparkSession.sessionState().sqlParser().parsePlan(checked), frozenset({"dataset"}))
    name = f"dataset_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        return spark.sql(f"WITH dataset AS (SELECT * FROM {name}) SELECT * FROM ({checked})").limit(max(1, min(limit, MAX_ROWS)))
    finally:
        spark.catalog.dropTempView(name)


def quote(identifier: str) -> str:
    parts = identifier.split(".")
    if not all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", p) for p in parts):
        raise UnsafeSQL(f"not an identifier: {identifier}")
    return ".".join(f"`{p}`" for p in parts)


def page(df: DataFrame, order_by: list[str], offset: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy(*order_by).offset(offset).limit(limit)


@dataclass
class Builder:
    """A SELECT put together step by step; ``df`` runs the same steps without text."""

    _select: list[str] = field(default_factory=list)
    _from: str = "dataset"
    _joins: list[str] = field(default_factory=list)
    _where: list[str] = field(default_factory=list)
    _group: list[str] = field(default_factory=list)
    _having: list[str] = field(default_factory=list)
    _order: list[str] = field(default_factory=list)
    _limit: int | None = None
    _offset: int | None = None

    def select(self, *columns: str) -> Builder:
        self._select += columns
        return self

    def table(self, name: str) -> Builder:
        self._from = name
        return self

    def join(self, table: str, condition: str | None = None, how: str = "INNER") -> Builder:
        self._joins.append(f"{how.upper()} JOIN {table}" + (f" ON {condition}" if condition and how.upper() != "CROSS" else ""))
        return self

    def where(self, condition: str) -> Builder:
        self._where.append(condition)
        return self

    def or_where(self, condition: str) -> Builder:
        """Either this or the condition before it."""
        self._where[-1:] = [f"({self._where[-1]} OR {condition})"] if self._where else [condition]
        return self

    def group_by(self, *columns: str) -> Builder:
        self._group += columns
        return self

    def having(self, condition: str) -> Builder:
        self._having.append(condition)
        return self

    def order_by(self, column: str, desc: bool = False) -> Builder:
        self._order.append(f"{column} {'DESC' if desc else 'ASC'}")
        return self

    def limit(self, n: int) -> Builder:
        self._limit = n
        return self

    def offset(self, n: int) -> Builder:
        self._offset = n
        return self

    def sql(self) -> str:
        out = f"SELECT {', '.join(self._select) or '*'} FROM {self._from}"
        out += "".join(f" {j}" for j in self._joins)
        for word, parts, by in (("WHERE", self._where, " AND "), ("GROUP BY", self._group, ", "), ("HAVING", self._having, " AND "), ("ORDER BY", self._order, ", ")):
            out += f" {word} {by.join(parts)}" if parts else ""
        return out + (f" LIMIT {self._limit}" if self._limit is not None else "") + (f" OFFSET {self._offset}" if self._offset is not None else "")

    def run(self, spark: SparkSession, **tables: DataFrame) -> DataFrame:
        return spark.sql(re.sub(r"(?i)\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in tables else m[0], self.sql()), **tables)


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate for the plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def advice(sql: str) -> list[str]:
    bare, out = _bare(sql).lower(), []
    if re.search(r"select\s+\*", bare):
        out.append("name the columns that are needed")
    if " where " not in f" {bare} ":
        out.append("a filter would let files and row groups be skipped")
    if " order by " in bare and " limit " not in bare:
        out.append("a sort without a limit shuffles every row")
    if re.search(r"like\s+'%", bare):
        out.append("a pattern that starts with % can't be pushed down")
    return out


# Plain-language questions

#: Words that ask for an aggregate.
ASKED = {"average": "avg", "mean": "avg", "avg": "avg", "total": "sum", "sum": "sum", "count": "count", "how many": "count", "number of": "count", "maximum": "max", "highest": "max", "max": "max", "minimum": "min", "lowest": "min", "min": "min"}
_COMPARED = ((r"(?:at least|>=)", ">="), (r"(?:at most|<=)", "<="), (r"(?:greater than|more than|above|over|>)", ">"), (r"(?:less than|below|under|<)", "<"), (r"(?:equals|equal to|=|is)", "="))


@dataclass
class Question:
    """What a question asks: aggregate, column, group, filters, top and order."""

    aggregate: str | None = None
    column: str | None = None
    group: str | None = None
    filters: list[tuple[str, str, str]] = field(default_factory=list)
    top: int | None = None
    descending: bool = True

    def run(self, df: DataFrame) -> DataFrame:
        ops = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__, "=": Column.__eq__}
        for c, op, v in self.filters:
            df = df.where(ops[op](F.col(c), F.lit(v).cast(df.schema[c].dataType)))
        if self.aggregate:
            how = {"avg": F.avg, "sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[self.aggregate]
            value = how(self.column or "*") if self.aggregate == "count" else how(self.column)
            df = (df.groupBy(self.group) if self.group else df).agg(value.alias("value"))
            return df.orderBy(F.desc("value") if self.descending else F.asc("value"), self.group).limit(self.top) if self.top and self.group else df
        if self.top and self.column:
            return df.orderBy(F.desc(self.column) if self.descending else F.asc(self.column)).limit(self.top)
        return df.limit(self.top) if self.top else df


def understand(question: str, columns: list[str]) -> Question:
    """Columns by name (underscores as spaces too), an aggregate, "by" or "per" a column, "top N", and comparisons with numbers or quoted texts."""
    low = " ".join(question.lower().split())
    spoken = sorted(((c.lower().replace("_", " "), c) for c in columns), key=lambda x: -len(x[0])) + sorted(((c.lower(), c) for c in columns), key=lambda x: -len(x[0]))
    out = Question()

    def column_in(text: str) -> str | None:
        found = [(text.find(s), -len(s), c) for s, c in spoken if re.search(rf"\b{re.escape(s)}\b", text)]
        return min(found)[2] if found else None

    for words, op in _COMPARED:
        for m in re.finditer(rf"([\w ]+?)\s+{words}\s+('[^']*'|-?[0-9.]+)", low):
            if (c := column_in(m[1])) and not any(f[0] == c for f in out.filters):
                out.filters.append((c, op, m[2].strip("'")))
    if m := re.search(r"\b(?:by|per|for each)\s+([\w ]+)", low):
        out.group = column_in(m[1])
    if m := re.search(r"\b(top|first|bottom|last|lowest|highest)\s+(\d+)\b", low):
        out.top, out.descending = int(m[2]), m[1] in ("top", "first", "highest")
    for word, how in ASKED.items():
        if m := re.search(rf"\b{word}\b(.*)", low):
            out.aggregate = how
            rest = re.split(r"\b(?:by|per|for each|where|with)\b", m[1])[0]
            out.column = column_in(rest)
            break
    if not out.aggregate:
        out.column = column_in(re.sub(r"\b(?:by|per)\s+[\w ]+", "", low)) or out.group
    if out.aggregate in ("avg", "sum", "max", "min") and not out.column:
        out.aggregate = None
    return out


def ask(df: DataFrame, question: str) -> DataFrame:
    return understand(question, df.columns).run(df)
