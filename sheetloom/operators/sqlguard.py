"""Ad-hoc queries under guard: one SELECT over allowed tables, of allowed functions, with a limit, not nested too deep.

What a query does is read off its parsed plan, subqueries and named ones too: nodes, relations and functions have to be
on a list. What isn't, such as functions that call Java, functions that give tables, inline tables, files as tables and
commands, is refused. The words outside quotes are looked at besides.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

LIMIT, DEPTH, SHOWN = 10_000, 3, 100
#: Words that no query may have outside quotes.
FORBIDDEN = {"insert", "update", "delete", "drop", "alter", "create", "truncate", "merge", "grant", "revoke", "attach", "pragma", "load", "set", "cache", "refresh", "call", "execute", "into"}
#: Functions that a query may use.
FUNCTIONS = set(
    "abs avg between bround case cast ceil ceiling coalesce concat concat_ws contains count count_if current_date date date_add date_diff date_format date_sub "
    "date_trunc datediff day dayofmonth dayofweek dense_rank endswith extract first_value floor greatest hour if ifnull isnotnull isnull lag last_value lead least left "
    "length like log10 lower lpad ltrim max max_by mean median min min_by minute mod month months_between nullif nvl percentile percentile_approx power quarter rank replace right "
    "round row_number rpad rtrim second sign split_part sqrt startswith stddev substr substring sum to_date trim try_cast upper variance weekofyear year".split()
)
#: Nodes that a plan may have.
NODES = set("Aggregate Distinct Except Filter GlobalLimit Intersect Join LocalLimit Offset OneRowRelation Project Sort SubqueryAlias Union UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition".split())
#: Unresolved parts that a plan may have besides relations and functions.
PARTS = set("UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedHaving UnresolvedOrdinal UnresolvedRelation UnresolvedStar UnresolvedSubqueryColumnAliases UnresolvedWith".split())


class Refused(ValueError):
    pass


def bare(sql: str) -> str:
    """The text without comments, its quoted parts emptied."""
    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", lambda m: " " if m[0][:2] in ("--", "/*") else m[0][0] * 2, sql, flags=re.S)


def checked(spark: SparkSession, sql: str, allowed: set[str]) -> str:
    """The query, or Refused."""
    text = bare(sql).strip().rstrip(";").strip()
    if ";" in text:
        raise Refused("one statement only")
    words = re.findall(r"[a-z_]+", text.lower())
    if not words or words[0] not in ("select", "with"):
        raise Refused("only SELECT")
    if found := FORBIDDEN & set(words):
        raise Refused(f"not allowed: {', '.join(sorted(found))}")
    depth = most = 0
    opened: list[bool] = []
    for m in re.finditer(r"\(\s*(select\b)?|\)", text.lower()):
        if m[0] == ")":
            depth -= opened.pop() if opened else 0
        else:
            opened.append(bool(m[1]))
            depth += bool(m[1])
            most = max(most, depth)
    if most > DEPTH:
        raise Refused("nested too deep")
    limit = re.search(r"\blimit\s+(\d+)\s*(?:offset\s+\d+\s*)?$", text.lower())
    if not limit or not 1 <= int(limit[1]) <= LIMIT:
        raise Refused(f"needs a LIMIT from 1 to {LIMIT}")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except ParseException as e:
        raise Refused(f"can't be read: {e.getCondition()}") from e
    own = set(re.findall(r"\b([a-z_0-9]+)\s+as\s*\(\s*select", text.lower()))
    tables = {t.lower() for t in allowed} | own
    if hidden := [t for t in sorted(own - {t.lower() for t in allowed}) if spark.catalog.tableExists(t)]:
        raise Refused(f"named like a table: {', '.join(hidden)}")  # outside its scope the name would mean that table
    for kind, name in parts(json.loads(plan.toJSON())):
        if kind == "relation" and name not in tables:
            raise Refused(f"unknown table: {name}")
        if kind == "function" and name not in FUNCTIONS:
            raise Refused(f"unknown function: {name}")
        if kind == "other":
            raise Refused(f"not allowed: {name}")
    return sql


def parts(node: object) -> Iterator[tuple[str, str]]:
    """(kind, name) of the relations and functions of a plan, and of what it may not have."""
    if isinstance(node, list):
        for x in node:
            yield from parts(x)
    elif isinstance(node, dict):
        package, _, name = node.get("class", "").rpartition(".")
        if name == "UnresolvedRelation":
            yield "relation", str(node["multipartIdentifier"]).strip("[]").lower()
        elif name == "UnresolvedFunction":
            yield "function", str(node["nameParts"]).strip("[]").lower()
        elif (package.endswith("plans.logical") and name not in NODES) or (package.endswith("catalyst.analysis") and name not in PARTS):
            yield "other", name
        elif package.startswith("org.apache.spark.sql.execution"):
            yield "other", name
        for x in node.values():
            yield from parts(x)


def asked(spark: SparkSession, sql: str, tables: dict[str, DataFrame], shown: int = SHOWN) -> DataFrame:
    """The guarded query over the given tables; at most `shown` rows."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(checked(spark, sql, set(tables)).strip().rstrip(";")).limit(shown)
