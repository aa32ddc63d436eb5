"""The read-only query console: one SELECT over allowed relations, with a row cap."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Words that begin or contain anything but reading.
FORBIDDEN = re.compile(r"\b(insert|update|delete|merge|create|drop|alter|truncate|grant|revoke|set|reset|add|cache|uncache|refresh|load|export|import|use|call|declare|execute|analyze|msck|repair)\b", re.I)
#: Functions that reach out of the data.
OUTSIDE = re.compile(r"\b(java_method|reflect|read_files|input_file_name|current_user|session_user|version|try_reflect)\s*\(", re.I)


class Refused(ValueError):
    """The statement is not one that the console runs."""


@dataclass(frozen=True)
class Answer:
    columns: list[str]
    rows: list[Row]
    truncated: bool


def _bare(sql: str) -> str:
    """The statement without comments and string literals."""
    return re.sub(r"--[^\n]*|/\*.*?\*/", " ", re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql), flags=re.S)


def check(spark: SparkSession, sql: str, allowed: Iterable[str]) -> str:
    """The statement, or Refused: it must be a single query, parse, and name allowed relations only."""
    text = sql.strip().rstrip(";").strip()
    bare = _bare(text)
    if not text or ";" in bare:
        raise Refused("exactly one statement")
    if not re.match(r"(select|with|\()", bare.strip(), re.I) or FORBIDDEN.search(bare):
        raise Refused("only SELECT")
    if OUTSIDE.search(bare):
        raise Refused("function not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Refused("it does not parse") from e
    names = {n.strip("` ").lower() for n in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan.toString())}
    ctes = {n.lower() for n in re.findall(r"\b([A-Za-z_]\w*)\s+as\s*\(", bare, re.I)}
    known = {a.lower() for a in allowed}
    # A name of a WITH clause only counts for itself: inside its own text, or in another scope, it may mean a stored relation of that name.
    hidden = sorted(c for c in ctes - known if spark.catalog.tableExists(c))
    unknown = sorted(names - known - ctes) + hidden
    if unknown:
        raise Refused(f"relation not allowed: {unknown[0]}")
    return text


def frame(spark: SparkSession, sql: str, allowed: Iterable[str]) -> DataFrame:
    return spark.sql(check(spark, sql, allowed))


class TimedOut(RuntimeError):
    """The statement ran longer than it may."""


def run(spark: SparkSession, sql: str, allowed: Iterable[str], cap: int = 1000, seconds: float | None = None) -> Answer:
    """At most `cap` rows; one more is fetched to tell whether the result goes on. Beyond `seconds` its jobs are cancelled."""
    df, sc = frame(spark, sql, allowed), spark.sparkContext
    group, over = f"console-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        sc.cancelJobGroup(group)

    sc.setJobGroup(group, "console", True)
    timer = threading.Timer(seconds, stop) if seconds is not None else None
    try:
        if timer:
            timer.start()
        rows = df.limit(cap + 1).collect()
    except Exception as e:
        if over.is_set():
            raise TimedOut(f"stopped after {seconds} s") from e
        raise
    finally:
        if timer:
            timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    return Answer(df.columns, rows[:cap], len(rows) > cap)


def sort_by(df: DataFrame, column: str, allowed: Sequence[str], tie: Sequence[str], descending: bool = True, limit: int | None = None) -> DataFrame:
    """Rows by a column that a user names, if it is an allowed one; NULLs last, then by `tie`."""
    if column not in allowed:
        raise Refused(f"no sorting by {column}")
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    out = df.orderBy(key, *tie)
    return out if limit is None else out.limit(limit)
