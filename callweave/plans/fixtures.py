"""Code-shaped views over the driver's tables (``fx_*``), in SQL that Spark and DuckDB both accept.

The tables hold no source code, so symbols, call sites, conditionals and so on are
projected from them by fixed arithmetic. ``{table}`` stands for a driver table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import stored

_N = "CAST({} AS VARCHAR(20))"
_CALLEE = f"concat('fn', {_N.format('(l_suppkey * 13 + l_linenumber) % 500')})"

VIEWS: dict[str, str] = {
    "fx_symbols": f"""
        SELECT s.*, concat(file_path, ':', {_N.format("line")}, ':', name) AS node_id FROM (
          SELECT *, line AS body_start, line + size_ AS body_end FROM (
            SELECT sym_id, file_path, name, kind, CASE WHEN kind = 'method' THEN concat('Cls', {_N.format("sym_id % 37")}, '.', name) ELSE name END AS qualified_name,
                   20 * (row_number() OVER (PARTITION BY file_path ORDER BY sym_id) - 1) AS line, visibility, size_
            FROM (SELECT CAST(p_partkey AS BIGINT) AS sym_id,
                         concat('src/mod', {_N.format("p_partkey % 7")}, '/f', {_N.format("p_partkey % 53")}, '.ts') AS file_path,
                         concat('fn', {_N.format("p_partkey % 400")}) AS name,
                         CASE WHEN p_partkey % 10 = 0 THEN 'class' WHEN p_partkey % 3 = 0 THEN 'method' ELSE 'function' END AS kind,
                         CASE WHEN p_partkey % 4 = 0 THEN 'public' WHEN p_partkey % 4 = 1 THEN 'private' ELSE 'default' END AS visibility,
                         CAST(p_size AS BIGINT) % 20 AS size_ FROM {{part}}) a) b) s""",
    "fx_call_sites": f"""
        SELECT DISTINCT file_path, line + l_orderkey % 25 AS line, CAST(l_linenumber AS BIGINT) AS col_no,
               concat(CASE WHEN l_linenumber % 4 = 0 THEN 'obj.' ELSE '' END, {_CALLEE}) AS callee_name
        FROM {{lineitem}} JOIN fx_symbols ON l_partkey = sym_id""",
    "fx_conditionals": """
        SELECT file_path, line + l_orderkey % 20 AS line, line + l_orderkey % 20 + l_linenumber AS end_line,
               CASE WHEN l_linestatus = 'O' THEN 'if' ELSE 'switch' END AS kind, CAST(l_linenumber AS BIGINT) AS branches
        FROM {lineitem} JOIN fx_symbols ON l_partkey = sym_id WHERE l_returnflag = 'R'""",
    "fx_exports": "SELECT name, kind, file_path FROM fx_symbols WHERE visibility = 'public'",
    "fx_imports": f"""
        SELECT DISTINCT file_path, concat('./f', {_N.format("l_suppkey % 53")}) AS source, {_CALLEE} AS specifier
        FROM {{lineitem}} JOIN fx_symbols ON l_partkey = sym_id WHERE l_linenumber = 1""",
    "fx_commits": """
        SELECT commit_id, author_ts, file_path, CASE WHEN row_number() OVER (PARTITION BY file_path ORDER BY author_ts, commit_id) = 1 THEN 'A' ELSE 'M' END AS status
        FROM (SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS commit_id, CAST(o_orderdate AS TIMESTAMP) AS author_ts, file_path
              FROM {lineitem} JOIN fx_symbols ON l_partkey = sym_id JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber = 1) c""",
    "fx_line_hits": """
        SELECT file_path, line + l_linenumber AS line, CAST(floor(max(l_quantity)) AS BIGINT) % 3 AS hits
        FROM {lineitem} JOIN fx_symbols ON l_partkey = sym_id GROUP BY file_path, line + l_linenumber""",
    "fx_hunks": "SELECT file_path, min(line) AS start_line, min(line) + 40 AS end_line FROM fx_symbols WHERE sym_id % 5 = 0 GROUP BY file_path",
    "fx_annotations": f"""
        SELECT CAST(event_id AS BIGINT) AS id, coalesce(node_id, concat('gone:', {_N.format("event_id")})) AS node_id, event_type AS text, {_N.format("user_id")} AS author, ts
        FROM {{events}} LEFT JOIN fx_symbols ON event_id % 2500 = sym_id""",
}


def _needed(sql: str) -> list[str]:
    found: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in found:
                visit(VIEWS[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def oracle(sql: str, recursive: bool = False) -> str:
    """``sql`` for DuckDB, led by the views it names. ``sql`` may itself begin with WITH."""
    if not _needed(sql):
        return sql.strip()
    parts = [f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', VIEWS[n])})" for n in _needed(sql)]
    body = sql.strip()
    if (m := re.match(r"WITH (RECURSIVE )?", body)) is not None:
        recursive, body = recursive or bool(m[1]), ",\n" + body[m.end() :]
    else:
        body = "\n" + body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + body


#: Symbols up to which Spark may broadcast them: it takes their views for smaller than they are.
FEW = 100_000
#: Views that most queries read several times: with more symbols than that, each is worked out once and stored.
READ_OFTEN = ("symbols", "call_sites", "conditionals")
#: Rows of the largest table that a task takes to make a stored view: more rows make more tasks, not larger ones.
TASK_ROWS = 500_000
#: Spark counts the bytes that it joins small partitions to packed; told apart, their rows take ten times as many.
JOINED = "spark.sql.adaptive.coalescePartitions.enabled"


@contextmanager
def dealt_by_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run meanwhile is shuffled into partitions of about ``TASK_ROWS`` of ``rows``, at least one for each core."""
    set_ = {"spark.sql.shuffle.partitions": str(max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))), JOINED: "false"}
    before = {k: spark.conf.get(k, None) for k in set_}
    for k, v in set_.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Fixtures:
    """The views as DataFrames over the tables in ``sf_dir``; each is planned once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}
        self._large: bool | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _many(self) -> bool:
        if self._large is None:
            self._large = self.table("part").count() > FEW
        return self._large

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            sql, frames = VIEWS[f"fx_{name}"], {}
            for t in re.findall(r"\{(\w+)\}", sql):
                frames[t] = self.table(t)
            for t in re.findall(r"\bfx_(\w+)", sql):
                # a row of a table has at most one symbol: looked up in a hash table of a share of them, large tables are not sorted
                frames[f"fx_{t}"] = getattr(self, t).hint("shuffle_hash") if t == "symbols" and self._many() else getattr(self, t)
            made = self.spark.sql(re.sub(r"\bfx_(\w+)", r"{fx_\1}", sql), **frames)
            if name in READ_OFTEN and self._many():
                with dealt_by_rows(self.spark, max(frames[t].count() for t in frames if not t.startswith("fx_"))):
                    made = stored(made)
            self._made[name] = made.hint("merge") if name == "symbols" and self._many() else made
        return self._made[name]
