"""Source files made of the fixture's symbols, in all seven languages, and the rows that a scan must give.

Each file is in the language of its number: two lines of head, then eight lines for each
symbol, and a closing line where the head opens a class. ``{name}``, ``{a}``, ``{b}`` and
``{n}`` stand for the symbol's name, two callees and the file's number.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import Fixtures

# language, head, first line if exported or public, first line if not, the other lines, tail
LANGUAGES: list[tuple[str, str, str, str, list[str], str]] = [
    ("typescript", 'import {{ f1, f2 as g }} from "./f{n}";\n', "export function {name}(a) {{", "function {name}(a) {{", ["  if (a > 1) {{", "    {a}(a);", "  }} else {{", "    obj.{b}(a);", "  }}", "}}", ""], ""),
    ("javascript", 'const {{ f1, f2 }} = require("./f{n}");\n', "export const {name} = async (a) => {{", "const {name} = async (a) => {{", ["  switch (a) {{", "    case 1: {a}(a); break;", "    default: this.{b}(a);", "  }}", "  return a;", "}};", ""], ""),
    ("python", "from m.f{n} import f1, f2 as g\n", "def {name}(a):", "def _{name}(a):", ["    if a > 1:", "        {a}(a)", "    else:", "        obj.{b}(a)", "    return a", "", ""], ""),
    ("rust", "use a::f{n}::{{f1, f2 as g}};\n", "pub fn {name}(a: i32) {{", "fn {name}(a: i32) {{", ["    match a {{", "        1 => {a}(a),", "        _ => obj.{b}(a),", "    }}", "    ", "}}", ""], ""),
    ("go", 'import "a/f{n}"\n', "func F{name}(a int) {{", "func f{name}(a int) {{", ["    if a > 1 {{", "        {a}(a)", "    }} else {{", "        obj.{b}(a)", "    }}", "}}", ""], ""),
    ("java", "import a.f{n}.F1;\npublic class K{n} {{", "    public int {name}(int a) {{", "    private int {name}(int a) {{", ["        if (a > 1) {{", "            {a}(a);", "        }} else {{", "            obj.{b}(a);", "        }}", "    }}", ""], "}}"),
    ("csharp", "using A.F{n};\npublic class K{n} {{", "    public int {name}(int a) {{", "    private int {name}(int a) {{", ["        var x = a > 1 ? {a}(a) : {b}(a);", "        ", "        ", "        ", "        return x;", "    }}", ""], "}}"),
]


def _sql(template: str) -> str:
    """An SQL expression for a template."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(name|a|b|n)\}", template)):
        if i % 2:
            parts.append({"n": "CAST(num AS VARCHAR(20))"}.get(piece, piece))
        elif piece:
            text = piece.replace("{{", "{").replace("}}", "}").replace("'", "''")
            parts.append(", chr(10), ".join(f"'{x}'" for x in text.split("\n")))
    return f"concat({', '.join(parts)})" if parts else "''"


def _by_language(pick) -> str:
    return "CASE lang " + " ".join(f"WHEN {i} THEN {pick(x)}" for i, x in enumerate(LANGUAGES)) + " END"


#: One row a symbol: its file, the file's number and language, its place there, name, callees, whether it is public, its first line.
PLACED = """placed AS (SELECT file_path, num, num % 7 AS lang, 2 + 8 * (row_number() OVER (PARTITION BY file_path ORDER BY sym_id) - 1) AS line, name, sym_id,
  concat('fn', CAST(sym_id * 3 % 400 AS VARCHAR(20))) AS a, concat('fn', CAST(sym_id * 7 % 400 AS VARCHAR(20))) AS b, sym_id % 2 = 0 AS pub FROM (SELECT *, sym_id % 53 AS num FROM fx_symbols) x)"""
TEXTS = f"""SELECT file_path, lang, line, concat(CASE WHEN pub THEN {_by_language(lambda x: _sql(x[2]))} ELSE {_by_language(lambda x: _sql(x[3]))} END, chr(10), {_by_language(lambda x: _sql(chr(10).join(x[4])))}) AS text,
  {_by_language(lambda x: _sql(x[1]))} AS head, {_by_language(lambda x: _sql(x[5]))} AS tail FROM placed"""


def files(fx: Fixtures) -> DataFrame:
    """(file_path, language_id, content, sha256)."""
    sql = f"WITH {PLACED} {TEXTS}".replace("{", "{{").replace("}", "}}").replace("fx_symbols", "{fx_symbols}")
    rows = fx.spark.sql(sql, fx_symbols=fx.symbols)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    whole = rows.groupBy("file_path", "lang", "head", "tail").agg(body.alias("body")).select("file_path", "lang", F.concat_ws("\n", "head", "body", "tail").alias("content"))
    names = F.array(*[F.lit(x[0]) for x in LANGUAGES])
    return whole.select("file_path", F.get(names, F.col("lang").cast("int")).alias("language_id"), "content", F.sha2("content", 256).alias("sha256"))
