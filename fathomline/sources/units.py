"""Files to line-addressed units: text chunks, Python syntax, identities and checks."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

MAX_LINES, MAX_CHARS = 65, 1800
UNIT = "path string, symbol string, kind string, owner string, start int, stop int, text string"
_BREAK = re.compile(r"\r\n|\r|\n")


def split_lines(text: str) -> list[str]:
    lines = _BREAK.split(text)
    return lines[:-1] if lines[-1] == "" else lines


def chunks(lines: list[str], max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> list[tuple[int, int]]:
    """Half-open line ranges: as long as the limits allow, preferably up to a blank line of the later half."""
    out, at = [], 0
    while at < len(lines):
        room, stop = max_chars, at
        while stop < min(len(lines), at + max_lines) and (stop == at or len(lines[stop]) < room):
            room -= len(lines[stop]) + 1
            stop += 1
        if stop < len(lines):
            stop = next((k + 1 for k in range(stop - 1, at + (stop - at) // 2 - 1, -1) if not lines[k].strip()), stop)
        out.append((at, stop))
        at = stop
    return out


def text_units(path: str, text: str) -> list[tuple]:
    lines = split_lines(text)
    return [(path, f"text:{path}:L{a + 1}", "text", None, a + 1, b, "\n".join(lines[a:b])) for a, b in chunks(lines) if any(x.strip() for x in lines[a:b])]


def python_units(path: str, text: str) -> list[tuple]:
    """A unit for each function and class body, and for the runs of lines between them; text chunks where the syntax fails."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return text_units(path, text)
    lines = text.splitlines()
    owner = [(0, "module", path, None)] * len(lines)

    def visit(node: ast.AST, depth: int, scope: str, inside: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{scope}.{child.name}"
                kind = "class-body" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                for k in range(first - 1, child.end_lineno):
                    owner[k] = (depth, kind, name, inside)
                visit(child, depth + 1, name, name)
            else:
                visit(child, depth, scope, inside)

    visit(tree, 1, path, None)
    out, at = [], 0
    for k in range(1, len(lines) + 1):
        if k == len(lines) or owner[k] != owner[at]:
            for a, b in chunks(lines[at:k]):
                part = lines[at + a : at + b]
                if any(x.strip() for x in part):
                    _, kind, name, inside = owner[at]
                    out.append((path, name, kind, inside, at + a + 1, at + b, "\n".join(part)))
            at = k
    return out


def adapters() -> dict:
    """Language: the function that cuts a file (path, text) into units."""
    from .braces import brace_units

    return {"python": python_units, "text": text_units, "go": brace_units("go"), "javascript": brace_units("javascript"), "typescript": brace_units("typescript")}


#: part of the identity of what is extracted; changes with the rules of the adapters
ADAPTER_VERSIONS = {"python": "ast-2", "text": "chunks-1", "go": "braces-1", "javascript": "braces-1", "typescript": "braces-1"}


def extract(files: DataFrame) -> DataFrame:
    """Units of files (path, text, language); languages without an adapter are cut as text."""
    columns = [c.split()[0] for c in UNIT.split(", ")]

    def run(frames):
        known = adapters()
        for f in frames:
            rows = [u for p, t, lang in zip(f.path, f.text, f.language, strict=True) if t for u in known.get(lang, text_units)(p, t)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "text", "language").mapInPandas(run, UNIT)


def fell_back(files: DataFrame, units: DataFrame) -> DataFrame:
    """(path, language): files of a structural language that were cut as text, because their syntax failed."""
    text = units.where("kind = 'text'").select("path").distinct()
    return files.where(F.col("language").isin([k for k in ADAPTER_VERSIONS if k != "text"])).select("path", "language").join(text, "path", "left_semi")


def fingerprint(files: DataFrame, options: str = "") -> DataFrame:
    """``files`` with ``fingerprint``: content, options and the version of the file's adapter."""
    version = F.create_map(*[F.lit(x) for pair in ADAPTER_VERSIONS.items() for x in pair])
    return files.withColumn("fingerprint", F.sha2(F.concat_ws("\x01", "path", "sha256", F.lit(options), F.coalesce(F.try_element_at(version, "language"), F.lit(""))), 256))


def extract_changed(files: DataFrame, before: DataFrame, options: str = "") -> DataFrame:
    """Units with ``fingerprint``: those of ``before`` where nothing changed, and of the other files anew."""
    now = fingerprint(files, options)
    kept = before.join(now.select("path", "fingerprint"), ["path", "fingerprint"], "left_semi")
    new = now.join(before.select("path", "fingerprint").distinct(), ["path", "fingerprint"], "left_anti")
    fresh = extract(new).join(now.select("path", "fingerprint"), "path")
    return kept.select(*fresh.columns).unionByName(fresh)


def calls(files: DataFrame) -> DataFrame:
    """(path, line, name) of the calls in Python files, as they are written."""

    def run(frames):
        for f in frames:
            rows = []
            for p, t in zip(f.path, f.text, strict=True):
                try:
                    tree = ast.parse(t or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, ast.Call):
                        try:
                            rows.append((p, node.lineno, ast.unparse(node.func)))
                        except RecursionError:
                            continue
            yield pd.DataFrame(rows, columns=["path", "line", "name"])

    return files.select("path", "text").mapInPandas(run, "path string, line int, name string")


#: units that one cell should hold
CELL_UNITS = 1 << 18


def with_ids(units: DataFrame) -> DataFrame:
    """Dense ids by a digest of the path, then the start. Cells of about ``CELL_UNITS`` are numbered by themselves and moved by the counts before them."""
    digits = 0
    n = units.count()
    while CELL_UNITS << (4 * digits) < n:
        digits += 1
    cell = F.substring(F.sha2("path", 256), 1, digits)
    sizes = units.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("cell", F.coalesce(F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("cell").orderBy(F.sha2("path", 256), "start")) - 1
    return units.withColumn("cell", cell).withColumn("k", place).join(starts, "cell").withColumn("uid", F.col("base") + F.col("k")).drop("k", "base")


def violations(units: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, fault): lines of units that overlap, differ from the file or lie outside it, and uncovered lines."""
    owned = units.select("path", "start", F.posexplode(T.physical_lines(F.col("text"))).alias("k", "own")).select("path", (F.col("start") + F.col("k")).alias("line"), "own")
    source = files.select("path", F.posexplode(T.physical_lines(F.col("text"))).alias("k", "truth")).select("path", (F.col("k") + 1).alias("line"), "truth")
    each = owned.groupBy("path", "line").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("own"))
    met = each.join(source, ["path", "line"], "full")
    fault = F.when(F.col("n") > 1, "overlap").when(F.col("truth").isNull(), "outside").when(F.col("n").isNull() & (F.trim("truth") != ""), "uncovered").when(F.col("own") != F.col("truth"), "differs")
    return met.select("path", "line", fault.alias("fault")).where("fault is not null")
