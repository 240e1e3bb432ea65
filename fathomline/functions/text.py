"""Column builders over text, paths and queries; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, endings and patterns that decide results.
SKIP_DIRS = [".git", ".hg", ".svn", "node_modules", "vendor", ".venv", "venv", "__pycache__", "dist", "build", "target", ".next", ".cache", ".pilot-state", "runs"]
SKIP_SUFFIXES = [".min.js", ".min.css", ".map", ".pyc", ".pyo", ".so", ".dylib", ".dll", ".exe", ".o", ".a", ".class", ".jar", ".wasm", ".zip", ".gz", ".tar", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".woff", ".woff2", ".mp3", ".mp4", ".sqlite", ".db", ".pem", ".key"]
LOCKFILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "uv.lock", "Cargo.lock", "go.sum"]
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".go": "go", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript"}
MAX_BYTES = 1024 * 1024
CONTROL = r"[\x00-\x08\x0b\x0e-\x1f]"
GENERATED = r"(?im)^[ \t]*(?://|#|/\*|\*)[ \t]*(?:code generated\b[^\n]*do not edit|(?:this file (?:is|was) |@)?(?:auto[- ]?)?generated\b[^\n]*do not edit)"
TEST_PATH = r"(^|/)(tests?|__tests__|fixtures)(/|$)|(^|/)test_[^/]+|[._](test|spec)\."
DOC_PATH = r"(^|/)(docs?|examples?)/|\.(md|rst|txt)$"
ASKS_TEST = r"(?i)^(?:find|show|locate|list)\s+(?:the\s+)?(?:(?:unit|regression)\s+)?tests?\b|^(?:查找|找到|列出|展示).{0,5}(?:测试|用例)"
ASKS_DOC = r"(?i)^(?:find|show|locate|list)\s+(?:the\s+)?(?:docs?|documentation|readme)\b|^(?:查找|找到|列出|展示).{0,5}文档"
SCOPES = [(r"(?i)\bpython\b", ["python"]), (r"(?i)\bgolang\b", ["go"]), (r"(?i)\btypescript\b", ["typescript"]), (r"(?i)\bjavascript\b", ["javascript", "typescript"]), (r"(?i)\b(?:frontend|front-end|react)\b|前端", ["javascript", "typescript"]), (r"\bGo\b|\bgo\s+(?:code|service|backend|worker|implementation)\b", ["go"])]
CLAUSE = r"(?i)[:：;；，]|,\s+(?=how|which|why|where|what)|\s+and\s+(?=how|which|why|where|what|preserve|restore|validate|enforce|handle|load|save|reject|filter|check|merge|retain|stop)"
QUESTION = r"(?i)[:：;；，]|,\s+(?=how|which|why|where|what)|\s+and\s+(?=how|which|why|where|what)"
ASKS_DECLARATION = r"(?i)\b(interface|type alias|schema)\b|类型定义|接口类型"
ASKS_FOR_TESTS = r"(?i)\btests?\b|测试|回归"
FACET_CONTEXT = "\nContext for this part of the request: "
INSTRUCTION = "Instruct: Retrieve source code implementing the requested behavior.\nQuery: "
SECRETS = [(r"(?i)Bearer\s+[^\s\"\\\\]+", "Bearer [REDACTED]"), (r"sk-[A-Za-z0-9_-]{12,}", "[REDACTED]")]
CONDITION = r"(?i)^(when|if|after|before|unless|given)\b"
DECLARATIONS = ["property", "parameter", "type", "interface", "type-alias"]
NOT_EXECUTABLE = r"^(//|/\*|\*|#|import |from |export type |\})"
TOKEN = r"[A-Za-z]+|[0-9]{1,3}|[^ \t\n\r\f\x0BA-Za-z0-9]"
NEWLINE = r"\r\n|\r|\n"
SLACK = 2


def terms(text: Column) -> Column:
    """Lower-case words of two characters or more, camel case and underscores split."""
    split = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.replace(F.lower(split), F.lit("_"), F.lit(" ")), F.lit("[a-z][a-z0-9]+"), F.lit(0))


def physical_lines(text: Column) -> Column:
    """Lines by CRLF, CR or LF; one empty line at the end is not a line."""
    lines = F.split(text, NEWLINE, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def document(path: Column, symbol: Column, text: Column, limit: int = 2200) -> Column:
    return F.substring(F.concat_ws("\n", path, symbol, text), 1, limit)


def render(path: Column, start: Column, text: Column) -> Column:
    """A path header and numbered lines."""
    rows = F.transform(physical_lines(text), lambda line, i: F.concat_ws("\t", (start + i).cast("string"), line))
    return F.concat_ws("\n", path, F.array_join(rows, "\n"))


def tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def token_cost(text: Column) -> Column:
    return tokens(text) + SLACK


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_exclusion(path: Column) -> Column:
    """The reason to leave a path out, or null."""
    parts = F.split(path, "/")
    name = file_name(path)
    lower = F.lower(path)
    suffix = F.exists(F.array(*[F.lit(s) for s in SKIP_SUFFIXES]), lambda s: F.endswith(lower, s))
    return (
        F.when(F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(d) for d in SKIP_DIRS])), "dependency-or-build-directory")
        .when(name.isin(LOCKFILES) | suffix, "generated-or-non-source-name")
        .when((name == ".env") | (name.startswith(".env.") & ~name.isin(".env.example", ".env.sample")), "local-environment")
    )


def glob_pattern(glob: str) -> str:
    """A regular expression for a case-sensitive glob whose ``*`` also crosses ``/``."""
    out = {"*": ".*", "?": "."}
    return "^" + "".join(out.get(c, "\\" + c if c in ".^$+{}()|[]\\" else c) for c in glob) + "$"


def eligibility(text: Column) -> Column:
    """The reason to leave a text out, or null."""
    return F.when(F.octet_length(text) > MAX_BYTES, "file-too-large").when(text.rlike(CONTROL), "binary-content").when(F.substring(text, 1, 2048).rlike(GENERATED), "generated-header")


def language_for(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))), F.lit("text"))


def source_role(path: Column, language: Column) -> Column:
    lower = F.lower(path)
    return F.when(lower.rlike(TEST_PATH), "test").when((language == "text") | lower.rlike(DOC_PATH), "documentation").otherwise("implementation")


def requested_role(query: Column) -> Column:
    return F.when(query.rlike(ASKS_TEST), "test").when(query.rlike(ASKS_DOC), "documentation").otherwise("implementation")


def wants_tests(query: Column) -> Column:
    """Whether a query speaks of tests anywhere."""
    return query.rlike(ASKS_FOR_TESTS)


def requested_languages(query: Column) -> Column:
    """The languages a query names, sorted."""
    none = F.array().cast("array<string>")
    found = [F.when(query.rlike(pattern), F.array(*[F.lit(v) for v in values])).otherwise(none) for pattern, values in SCOPES]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def facets(query: Column) -> Column:
    """Clauses of a query that ask for something: 2 to 4 of them, or the query itself."""
    parts = F.filter(F.transform(F.split(query, CLAUSE), lambda p: F.trim(p)), lambda p: F.length(p) > 7)
    asked = F.filter(parts, lambda p: ~p.rlike(CONDITION) & ~(F.endswith(p, F.lit("时")) & ~p.rlike("如何|怎么|哪里|怎样")))
    chosen = F.get(F.transform(F.array(asked), lambda a: F.when((F.size(a) > 1) & (F.size(a) <= 4), a).otherwise(F.array(query))), F.lit(0))
    return F.transform(chosen, lambda p: F.struct(p.alias("question"), F.regexp_extract_all(p, F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0)).alias("terms")))


def prompts(intent: Column, questions: Column) -> Column:
    """The queries that are scored: the intent, and up to four other facets with it as context."""
    others = F.slice(F.array_distinct(F.filter(questions, lambda q: q != intent)), 1, 4)
    return F.concat(F.array(intent), F.transform(others, lambda q: F.concat(q, F.lit(FACET_CONTEXT), intent)))


def embedding_prompts(prompts: Column) -> Column:
    """The texts that are embedded for the queries of ``prompts``."""
    return F.transform(prompts, lambda q: F.concat(F.lit(INSTRUCTION), q))


def literal_facets(query: Column) -> Column:
    """The older planner: clauses of over seven characters, 2 to 4 of them, or the query itself; conditions stay."""
    parts = F.filter(F.transform(F.split(query, QUESTION), lambda p: F.trim(p)), lambda p: F.length(p) > 7)
    return F.get(F.transform(F.array(parts), lambda a: F.when((F.size(a) > 1) & (F.size(a) <= 4), a).otherwise(F.array(query))), F.lit(0))


def relative_path(path: Column) -> Column:
    """The path with forward slashes, without empty and ``.`` parts; null if it is absolute, climbs, or has over 4096 characters."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(slashed, "/")
    bad = ~F.length(path).between(1, 4096) | F.contains(path, F.lit("\x00")) | slashed.startswith("/") | slashed.rlike("^[A-Za-z]:") | F.array_contains(parts, "..")
    tidy = F.array_join(F.filter(parts, lambda p: (p != "") & (p != ".")), "/")
    return F.when(~bad, F.when(tidy == "", ".").otherwise(tidy))


def redacted(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """The text without the given secrets, bearer tokens and keys."""
    for secret in filter(None, secrets):
        text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    for pattern, shown in SECRETS:
        text = F.regexp_replace(text, pattern, shown)
    return text


def asks_declaration(intent: Column) -> Column:
    """Whether a query asks for an interface, a type alias or a schema."""
    return intent.rlike(ASKS_DECLARATION)


def substance_for(intent: Column, role: Column, kind: Column, text: Column) -> Column:
    """``substance``, but a type or an interface counts in full where the query asks for one."""
    return F.when(asks_declaration(intent) & kind.isin("type", "interface", "type-alias"), 1.0).otherwise(substance(role, kind, text))


def substance(role: Column, kind: Column, text: Column) -> Column:
    """How much a unit explains, by its kind and its number of executable lines."""
    lines = F.filter(F.transform(F.split(text, NEWLINE), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike(NOT_EXECUTABLE))
    n = F.size(lines)
    body = F.when(n == 0, 0.1).when(kind.isin("function", "method"), F.when(n >= 2, 1.0).otherwise(0.5)).otherwise(F.when(n >= 5, 1.0).otherwise(0.25))
    return F.when(role != "implementation", 1.0).when(kind.isin(DECLARATIONS), 0.25).otherwise(body)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def affinity(score: Column, best: Column) -> Column:
    return F.exp(F.least(F.lit(0.0), score - best) / 0.06)


def size_damp(cost: Column) -> Column:
    return F.pow(F.greatest(F.lit(120), cost) / 300, F.lit(0.35))


def value(relevance: Column, rank: Column, substance: Column, intent: Column, in_scope: Column) -> Column:
    """Worth of a unit for a query; nothing below a relevance of 0.1."""
    worth = (relevance * 0.5 + F.exp(-rank / 8) * 0.5) * substance * intent * F.when(in_scope, 1.0).otherwise(0.25)
    return F.when(relevance < 0.1, 0.0).otherwise(worth)


def digest(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *columns), 256)


def hash_score(query: Column, text: Column) -> Column:
    """The deterministic pair score: leading 32 bits of SHA-256 as a fraction."""
    return F.conv(F.substring(F.sha2(F.concat(query, text), 256), 1, 8), 16, 10).cast("double") / 4294967295.0
