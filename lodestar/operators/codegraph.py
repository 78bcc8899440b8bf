"""Code graph: elements of source files, nodes and edges, validation of scripts by anti-join, queries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.registry import query

# Extensions that are source files.
EXTENSIONS = ("rs", "py", "js", "ts", "java", "cpp", "c", "h", "hpp")
ELEMENTS = "name string, element_type string, line int, parent string, visibility string, attributes array<string>"


def source_files(spark: SparkSession, folder: str, repository: str) -> DataFrame:
    """(repository, path, text) of the source files under a folder that Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kept = files.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*EXTENSIONS))
    return kept.select(F.lit(repository).alias("repository"), "path", F.decode("content", "UTF-8").alias("text"))


def python_elements(files: DataFrame) -> DataFrame:
    """(repository, path, name, element_type, line) of functions (also async ones) and classes, by lines; built-in functions only."""
    lines = files.select("repository", "path", F.posexplode(F.split("text", "\n")).alias("no", "code"))
    name = F.regexp_extract("code", r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", 1)
    cls = F.regexp_extract("code", r"^\s*class\s+(\w+)", 1)
    rows = lines.select("repository", "path", (F.col("no") + 1).alias("line"), F.when(name != "", name).otherwise(cls).alias("name"), F.when(name != "", "function").otherwise("class").alias("element_type"))
    return rows.filter("name <> ''")


def scan_rust(text: str | None) -> list[dict]:
    """Functions, structs, enums, traits and modules outside of impl blocks, with module path, visibility and attributes."""
    if not text:
        return []
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    code = re.sub(r'//[^\n]*|/\*.*?\*/|b?r#*".*?"#*|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])\'', blank, text, flags=re.S)
    out, stack, attributes = [], [], []
    token = re.compile(r"(#!?\[[^\]]*\])|\b((?:pub(?:\s*\([^)]*\))?\s+)?)(?:(?:async|unsafe|const|extern)\s+)*(fn|struct|enum|trait|mod|impl)\b\s*(\w*)|([{};])")
    pending: str | None = None
    for m in token.finditer(code):
        if m[1]:
            attributes.append(m[1])
        elif m[3]:
            kind, name = m[3], m[4]
            visible = re.sub(r"\s+", "", m[2]) or "private"
            if kind == "impl":
                pending = "impl"
            elif kind == "mod":
                pending = f"mod {name}"
                out.append({"name": name, "element_type": "module", "line": code.count("\n", 0, m.start(3)) + 1, "parent": "::".join(s[4:] for s in stack if s.startswith("mod ")) or None, "visibility": visible, "attributes": []})
            else:
                pending = kind
                if "impl" not in stack and "trait" not in stack:
                    out.append({"name": name, "element_type": {"fn": "function"}.get(kind, kind), "line": code.count("\n", 0, m.start(3)) + 1, "parent": "::".join(s[4:] for s in stack if s.startswith("mod ")) or None, "visibility": visible, "attributes": attributes if kind == "fn" else []})
            attributes = []
        elif m[5] == "{":
            stack.append(pending or "block")
            pending = None
        elif m[5] == "}":
            if stack:
                stack.pop()
        else:
            pending = None
    return out


def rust_elements(files: DataFrame) -> DataFrame:
    """(repository, path) and ELEMENTS of Rust files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, p, e) for r, p, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for e in scan_rust(t)]
            columns = [pa.array([r for r, _, _ in rows], pa.string()), pa.array([p for _, p, _ in rows], pa.string())]
            kinds = {"line": pa.int32(), "attributes": pa.list_(pa.string())}
            names = [x.split()[0] for x in ELEMENTS.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([e[n] for _, _, e in rows], kinds.get(n, pa.string())) for n in names)], names=["repository", "path", *names])

    return files.select("repository", "path", "text").mapInArrow(run, f"repository string, path string, {ELEMENTS}")


def graph(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, name, repository) and edges (src, dst, rel): repository CONTAINS file DEFINES element."""
    rid = F.concat(F.lit("r:"), "repository")
    fid = F.concat(F.lit("f:"), "repository", F.lit(":"), "path")
    eid = F.concat(F.lit("e:"), "repository", F.lit(":"), "path", F.lit(":"), "element_type", F.lit(":"), "name", F.lit(":"), F.col("line").cast("string"))
    nodes = elements.select(F.explode(F.array(F.struct(rid.alias("id"), F.lit("Repository").alias("label"), F.col("repository").alias("name"), "repository"), F.struct(fid.alias("id"), F.lit("File").alias("label"), F.col("path").alias("name"), "repository"), F.struct(eid.alias("id"), F.initcap("element_type").alias("label"), F.col("name").alias("name"), "repository"))).alias("n")).select("n.*").distinct()
    edges = elements.select(F.explode(F.array(F.struct(rid.alias("src"), fid.alias("dst"), F.lit("CONTAINS").alias("rel")), F.struct(fid.alias("src"), eid.alias("dst"), F.lit("DEFINES").alias("rel")))).alias("e")).select("e.*").distinct()
    return nodes, edges


def cleared(nodes: DataFrame, edges: DataFrame, repository: str) -> tuple[DataFrame, DataFrame]:
    """Both without a repository's nodes and what hangs on them."""
    gone = nodes.filter(F.col("repository") == repository).select(F.col("id").alias("src"))
    return nodes.filter(F.col("repository") != repository), edges.join(gone, "src", "left_anti")


def validate(script: DataFrame, known: DataFrame) -> DataFrame:
    """(path, valid, issues, confidence): functions of a script that the graph lacks and that are no tests are issues."""
    missing = script.filter("element_type = 'function' AND name NOT LIKE 'test\\_%'").join(known.select("name", "element_type").distinct(), ["name", "element_type"], "left_anti")
    by = script.select("path").distinct().join(missing.groupBy("path").agg(F.count("*").alias("issues"), F.sort_array(F.collect_set("name")).alias("names")), "path", "left")
    n = F.coalesce("issues", F.lit(0))
    return by.select("path", (n == 0).alias("valid"), n.alias("issues"), F.array_join(F.coalesce("names", F.array().cast("array<string>")), ",").alias("names"), F.when(n == 0, 1 - F.least(F.lit(0.1) * n, F.lit(0.8))).otherwise(0.3).alias("confidence"))


#: Sources of the queries, by path.
SAMPLES = {
    "a.py": "import os\n\nclass Store:\n    def get(self, key):\n        return key\n\n    async def put(self, key):\n        pass\n\ndef main():\n    Store().get(1)\n",
    "b.py": "def helper(x):\n    return x\n\ndef main():\n    helper(1)\n",
}
SCRIPT = {"s.py": "def main():\n    pass\n\ndef unknown():\n    pass\n\ndef test_it():\n    pass\n"}
_VALUES = lambda d: ", ".join("('r', '{}', '{}')".format(p, t.replace("'", "''")) for p, t in d.items())
_ELEMENTS_SQL = """
WITH f(repository, path, text) AS (VALUES {files}),
l AS (SELECT repository, path, unnest(string_split(text, chr(10))) AS code, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM f),
n AS (SELECT *, regexp_extract(code, '^\\s*(?:async\\s+)?def\\s+(\\w+)\\s*\\(', 1) AS f, regexp_extract(code, '^\\s*class\\s+(\\w+)', 1) AS c FROM l),
el AS (SELECT repository, path, CAST(line AS INTEGER) AS line, CASE WHEN f <> '' THEN f ELSE c END AS name, CASE WHEN f <> '' THEN 'function' ELSE 'class' END AS element_type FROM n WHERE f <> '' OR c <> '')"""


def _files(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([("r", p, t) for p, t in files.items()], "repository string, path string, text string")


@query(_ELEMENTS_SQL.format(files=_VALUES(SAMPLES)) + " SELECT * FROM el")
def code_elements_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_elements(_files(spark, SAMPLES))


@query(_ELEMENTS_SQL.format(files=_VALUES(SAMPLES)) + """
SELECT DISTINCT 'r:' || repository AS src, 'f:' || repository || ':' || path AS dst, 'CONTAINS' AS rel FROM el
UNION SELECT 'f:' || repository || ':' || path, 'e:' || repository || ':' || path || ':' || element_type || ':' || name || ':' || line, 'DEFINES' FROM el""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(python_elements(_files(spark, SAMPLES)))[1]


@query(_ELEMENTS_SQL.format(files=_VALUES(SAMPLES) + ", " + _VALUES(SCRIPT)) + """,
m AS (SELECT * FROM el WHERE path = 's.py' AND element_type = 'function' AND name NOT LIKE 'test\\_%' ESCAPE '\\' AND name NOT IN (SELECT name FROM el WHERE path <> 's.py' AND element_type = 'function'))
SELECT 's.py' AS path, count(*) = 0 AS valid, count(*) AS issues, coalesce(string_agg(name, ',' ORDER BY name), '') AS names, CAST(CASE WHEN count(*) = 0 THEN 1.0 ELSE 0.3 END AS DOUBLE) AS confidence FROM m""")
def validate_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(python_elements(_files(spark, SCRIPT)), python_elements(_files(spark, SAMPLES)))


def repository_name(url: str) -> F.Column:
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"(\.git)+$", "")
