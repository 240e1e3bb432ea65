"""Units and links of brace languages (Go, JavaScript, TypeScript) by a scanner of our own.

Comments and the contents of strings, templates and regular expressions are blanked first, so that
braces and names that are left belong to the code. Declarations are found by their keywords at the
start of a statement and reach to the brace that closes their body, or to the end of the line. The
scanner knows syntax, not types: method calls are linked only by an import or a function of the same package.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .units import chunks, split_lines, text_units

_GO = [
    ("method", re.compile(r"^func\s*\(\s*(?:\w+\s+)?\*?\s*(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)\s*[(\[]", re.M)),
    ("function", re.compile(r"^func\s+(?P<name>\w+)\s*[(\[]", re.M)),
    ("interface", re.compile(r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b", re.M)),
    ("type", re.compile(r"^type\s+(?P<name>\w+)\b", re.M)),
]
_HEAD = r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_JS = [
    ("class-body", re.compile(_HEAD + r"(?:abstract\s+)?class\s+(?P<name>[\w$]+)", re.M)),
    ("function", re.compile(_HEAD + r"(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*[(<]", re.M)),
    ("function", re.compile(_HEAD + r"(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=\n]+)?=>|[\w$]+\s*=>)", re.M)),
    ("interface", re.compile(_HEAD + r"interface\s+(?P<name>[\w$]+)", re.M)),
    ("type-alias", re.compile(_HEAD + r"type\s+(?P<name>[\w$]+)(?:<[^=\n]*>)?\s*=", re.M)),
    ("type", re.compile(_HEAD + r"(?:const\s+)?enum\s+(?P<name>[\w$]+)", re.M)),
]
_METHOD = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*\*?(?P<name>#?[\w$]+)\s*(?:<[^(\n]*>)?\([^;{]*\)\s*(?::[^{;\n]+)?\{", re.M)
_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "do", "else", "func", "super"}
_REGEX_BEFORE = set("(,=:[!&|?{};+-*%<>~^\n") | {""}


def masked(text: str, language: str) -> str:
    """The text with comments and string contents as spaces; lines stay where they are."""
    out, at, n, last = list(text), 0, len(text), ""

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while at < n:
        two, ch = text[at : at + 2], text[at]
        if two == "//":
            stop = text.find("\n", at)
            stop = n if stop < 0 else stop
        elif two == "/*":
            stop = text.find("*/", at + 2)
            stop = n if stop < 0 else stop + 2
        elif ch in "\"'`" or (ch == "/" and language != "go" and last in _REGEX_BEFORE):
            stop, inside = at + 1, False
            while stop < n and (inside or text[stop] != ch) and (text[stop] != "\n" or ch == "`"):
                if ch == "/" and text[stop] in "[]":
                    inside = text[stop] == "["
                stop += 2 if text[stop] == "\\" and not (language == "go" and ch == "`") else 1
            stop = min(n, stop + 1)
            last = ch
        else:
            last = ch if not ch.isspace() or ch == "\n" and last == "" else last
            at += 1
            continue
        blank(at, stop)
        at = stop
    return "".join(out)


def _body_end(code: str, at: int) -> int:
    """Where the declaration that begins at ``at`` ends: after its closing brace, or at its line's end if none opens before a statement ends."""
    depth, k = 0, at
    round_depth = 0
    while k < len(code):
        ch = code[k]
        if ch in "([":
            round_depth += 1
        elif ch in ")]":
            round_depth -= 1
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth <= 0 and round_depth <= 0:
                return k + 1
        elif (ch == ";" or ch == "\n" and not code[at:k].rstrip().endswith(("=", "=>", ",", "|", "&"))) and depth == 0 and round_depth <= 0:
            return k
        k += 1
    return len(code)


def declarations(code: str, language: str) -> list[tuple[int, int, str, str, str | None]]:
    """(first offset, end, kind, dotted name, owner) of masked code; inner declarations after outer ones."""
    out = []
    for kind, pattern in _GO if language == "go" else _JS:
        for m in pattern.finditer(code):
            name, owner = m["name"], m.groupdict().get("owner")
            if not any(a == m.start() for a, *_ in out):
                out.append((m.start(), _body_end(code, m.start()), kind, f"{owner}.{name}" if owner else name, owner))
    if language != "go":
        for a, b, kind, name, _ in list(out):
            if kind == "class-body":
                inner = code.find("{", a)
                depth = 0
                level = {}
                for k in range(inner, b):
                    depth += (code[k] == "{") - (code[k] == "}")
                    level[k] = depth
                for m in _METHOD.finditer(code, inner, b):
                    if m["name"] not in _WORDS and level.get(m.start(), 0) == 1:
                        out.append((m.start(), _body_end(code, m.end() - 1), "method", f"{name}.{m['name']}", name))
    return sorted(out, key=lambda d: (d[0], -d[1]))


def balanced(code: str) -> bool:
    depth = 0
    for ch in code:
        depth += (ch == "{") - (ch == "}")
        if depth < 0:
            return False
    return depth == 0


def brace_units(language: str):
    """The adapter of a language: a unit for each declaration and for the runs of lines between them; text chunks where braces do not close."""

    def units(path: str, text: str) -> list[tuple]:
        code = masked(text, language)
        if not balanced(code):
            return text_units(path, text)
        lines = split_lines(text)
        owner = [("module", path, None)] * len(lines)
        begins = [0]
        for m in re.finditer(r"\r\n|\r|\n", text):
            begins.append(m.end())

        def line_of(offset: int) -> int:
            lo, hi = 0, len(begins)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if begins[mid] <= offset else (lo, mid)
            return lo

        for a, b, kind, name, holder in declarations(code, language):
            for k in range(line_of(a), min(len(lines), line_of(max(a, b - 1)) + 1)):
                owner[k] = (kind, f"{path}.{name}", f"{path}.{holder}" if holder else None)
        out, at = [], 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or owner[k] != owner[at]:
                for a, b in chunks(lines[at:k]):
                    part = lines[at + a : at + b]
                    if any(x.strip() for x in part):
                        kind, name, holder = owner[at]
                        out.append((path, name, kind, holder, at + a + 1, at + b, "\n".join(part)))
                at = k
        return out

    return units


_CALL = re.compile(r"(?<![\w$.])(?P<name>[A-Za-z_$][\w$]*)\s*\(")
_IMPORT = re.compile(r"import\s+(?:(?P<star>\*\s+as\s+[\w$]+)|(?P<one>[\w$]+))?\s*,?\s*(?:\{(?P<many>[^}]*)\})?\s*from\s*[\"'](?P<from>[^\"']+)[\"']")
_REQUIRE = re.compile(r"(?:const|let|var)\s+(?:(?P<one>[\w$]+)|\{(?P<many>[^}]*)\})\s*=\s*require\(\s*[\"'](?P<from>[^\"']+)[\"']\s*\)")
_BASE = re.compile(r"\bclass\s+[\w$]+(?:<[^{]*?>)?\s+extends\s+(?P<base>[\w$]+)|\b(?:implements|interface\s+[\w$]+\s+extends)\s+(?P<more>[\w$, ]+)")


def _beside(path: str, target: str) -> str:
    """A relative module's path without its ending; null bytes stand for packages from elsewhere."""
    if not target.startswith("."):
        return "\0" + target
    parts = path.split("/")[:-1]
    for piece in target.split("/"):
        if piece == "..":
            parts = parts[:-1]
        elif piece not in (".", ""):
            parts.append(piece)
    return re.sub(r"\.(js|ts|jsx|tsx|mjs|cjs|mts|cts)$", "", "/".join(parts))


def brace_links(path: str, text: str, language: str) -> list[tuple[str, int, str, str]]:
    """(path, line, kind, target): ``file#name`` for imported names, ``#name`` for names of the own file or, in Go, the own folder."""
    code, bound, out = masked(text, language), {}, []
    if language != "go":
        for m in [*_IMPORT.finditer(text), *_REQUIRE.finditer(text)]:
            home = _beside(path, m["from"])
            line = text.count("\n", 0, m.start()) + 1
            out.append((path, line, "imports", f"{home}#"))
            for part in (m["many"] or "").split(","):
                name, _, alias = (x.strip() for x in re.sub(r"\s+as\s+|\s*:\s*", "\0", part.strip().removeprefix("type ")).partition("\0"))
                if name:
                    bound[alias or name] = f"{home}#{name}"
            if m["one"]:
                bound[m["one"]] = f"{home}#default"
        for m in _BASE.finditer(code):
            for name in (m["base"] or m["more"]).replace(" ", "").split(","):
                if name:
                    out.append((path, code.count("\n", 0, m.start()) + 1, "inherits" if m["base"] else "implements", bound.get(name, f"#{name}")))
    starts = {m.start("name") for _, pattern in (_GO if language == "go" else _JS) for m in pattern.finditer(code)} | {m.start("name") for m in _METHOD.finditer(code)}
    for m in _CALL.finditer(code):
        if m["name"] not in _WORDS and m.start("name") not in starts:
            out.append((path, code.count("\n", 0, m.start()) + 1, "calls", bound.get(m["name"], f"#{m['name']}")))
    return out


BRACE_LANGUAGES = ("go", "javascript", "typescript")
#: kind: confidence
CONFIDENCE = {"calls": 0.9, "imports": 1.0, "inherits": 0.9, "implements": 0.9}


def brace_relations(files: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst, kind, confidence, resolution) between units of brace languages (uid, path, symbol, start, stop); src differs from dst.

    An imported name is a declaration of the file it is imported from; a file is found with or without
    its ending, or as the ``index`` of a folder. Other names are those of the own file or, in Go, of the
    own folder, where exactly one file declares them.
    """

    def run(frames):
        for f in frames:
            rows = [x for p, t, g in zip(f.path, f.text, f.language, strict=True) for x in brace_links(p, t or "", g)]
            yield pd.DataFrame(rows, columns=["path", "line", "kind", "target"])

    code = files.where(F.col("language").isin(*BRACE_LANGUAGES))
    found = code.select("path", "text", "language").mapInPandas(run, "path string, line int, kind string, target string")
    spans = units.select(F.col("path").alias("module"), "start", F.col("stop").alias("end"), "uid")
    placed = graph.within(found.withColumnRenamed("path", "module"), spans).select(F.col("uid").alias("src"), F.col("module").alias("path"), "kind", "target").distinct()
    home, name = F.substring_index("target", "#", 1), F.substring_index("target", "#", -1)
    folder = lambda p: F.regexp_replace(p, "[^/]*$", "")
    asked = placed.join(code.select("path", "language"), "path").select("src", "kind", "path", "language", home.alias("home"), name.alias("name"))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    places = code.select(F.col("path").alias("at"), F.explode(F.array(stem, F.regexp_replace(stem, "/index$", ""))).alias("home")).distinct()
    named = asked.where("home <> '' and name <> ''").join(places, "home").select("src", "kind", F.concat_ws(".", "at", "name").alias("symbol"))
    files_named = asked.where("home <> '' and name = ''").join(places, "home").select("src", "kind", F.col("at").alias("symbol"))
    local = asked.where("home = '' and language <> 'go'").select("src", "kind", F.concat_ws(".", "path", "name").alias("symbol"))
    declared = units.join(code.where("language = 'go'").select("path"), "path").where("kind = 'function'").select(folder(F.col("path")).alias("folder"), F.expr("substring(symbol, length(path) + 2)").alias("name"), "symbol").distinct()
    only = declared.groupBy("folder", "name").agg(F.min("symbol").alias("symbol"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    package = asked.where("home = '' and language = 'go'").withColumn("folder", folder(F.col("path"))).join(only, ["folder", "name"]).select("src", "kind", "symbol")
    ends = named.unionByName(files_named).unionByName(local).unionByName(package).join(units.select("symbol", F.col("uid").alias("dst")), "symbol")
    sure = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return ends.where("src <> dst").select("src", "dst", "kind").distinct().withColumn("confidence", F.element_at(sure, F.col("kind"))).withColumn("resolution", F.lit("syntax"))
