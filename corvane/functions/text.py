"""Text functions: hashes, chunks, tokens, trigrams, references, masking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a secret, and what it turns into.
SECRETS = (
    ("(?i)(token|secret|password|api_key)\\s*=\\s*\"[^\"]*\"", "$1 = \"***\""),
    ("gh[pousr]_[A-Za-z0-9]{20,}", "***"),
    ("AKIA[0-9A-Z]{16}", "***"),
    ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "<email>"),
)
# Languages by file extension, and question intents by words, first match first.
EXTENSIONS = {"py": "Python", "pyi": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript"}
INTENTS = (("decision", "decid|decision|why|chosen"), ("contributor", "who|author|contributor|reviewed"), ("dependency", "depend|import|package"), ("historical", "when|history|first|last|changed"), ("subsystem", "subsystem|module|component"), ("architecture", "architecture|structure|design"), ("symbol", "function|class|method|symbol"), ("file", "file|path"), ("overview", "what is|overview|about"))


def canonical_key(kind: str, *parts: str) -> Column:
    """``github:kind:part:part``."""
    return F.concat_ws(":", F.lit("github"), F.lit(kind), *(F.col(p).cast("string") for p in parts))


def content_hash(text: Column) -> Column:
    """F5."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def normal_path(path: Column) -> Column:
    """no ``./``, no doubled or leading slash."""
    path = F.regexp_replace(path, "/+", "/")
    return F.regexp_replace(F.regexp_replace(path, "(^|/)(\\./)+", "$1"), "^/+", "")


def chunks(docs: DataFrame, id_col: str, text_col: str, lines: int) -> DataFrame:
    """Blocks of ``lines`` lines with their range, counted from 1, and hash (F7); rows without text give none."""
    all_lines = F.split(text_col, "\n")
    rows = docs.where(F.col(text_col).isNotNull()).withColumn("_lines", all_lines)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / lines))))
    start = (F.col("chunk") * lines + 1).cast("int")
    part = F.array_join(F.slice("_lines", start, F.lit(lines)), "\n")
    out = rows.select(F.col(id_col), F.col("chunk").cast("long").alias("chunk"), start.cast("long").alias("start_line"), F.least(start + lines - 1, F.size("_lines")).cast("long").alias("end_line"), part.alias("text"))
    return out.withColumn("content_hash", content_hash(F.col("text")))


def excerpt(text: Column, start: Column, n: int) -> Column:
    """``n`` lines from ``start``."""
    return F.array_join(F.slice(F.split(text, "\n"), start, n), "\n")


def tokens(text: Column) -> Column:
    """words of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), 0)


def trigrams(text: Column) -> Column:
    """the distinct three-character windows; a shorter text is its own window."""
    text = F.lower(F.coalesce(text, F.lit("")))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: text.substr(i, F.lit(3)))
    return F.array_distinct(windows)


def cosine(a: Column, b: Column) -> Column:
    """F8: in double precision, null if a vector is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def issue_references(text: Column) -> Column:
    """F16: numbers after ``#``."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("#(\\d+)"), 1)


def mask_secrets(text: Column) -> Column:
    """F18."""
    return reduce(lambda t, s: F.regexp_replace(t, *s), SECRETS, text)


def language_of(path: Column) -> Column:
    """Null for other files."""
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return known[F.regexp_extract(F.lower(path), "\\.([a-z]+)$", 1)]


def intent(question: Column) -> Column:
    """``mixed`` if no rule fits."""
    text = F.lower(F.coalesce(question, F.lit("")))
    return reduce(lambda rest, rule: F.when(text.rlike(rule[1]), rule[0]).otherwise(rest), reversed(INTENTS), F.lit("mixed"))


def imports_of(files: DataFrame, path_col: str = "path", text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """((path, module) per import line, (path, reason) of files that can't be read) for three languages."""
    language = language_of(F.col(path_col))
    rejects = files.where(F.col(text_col).isNull() | language.isNull()).select(path_col, F.when(language.isNull(), "unsupported_language").otherwise("no_content").alias("reject_reason"))
    python = F.regexp_extract_all(text_col, F.lit("(?m)^\\s*(?:from|import)\\s+([\\w.]+)"), 1)
    script = F.regexp_extract_all(text_col, F.lit("(?m)(?:from|import|require\\()\\s*['\"]([^'\"]+)['\"]"), 1)
    good = files.where(F.col(text_col).isNotNull() & language.isNotNull())
    return good.select(path_col, F.explode(F.when(language == "Python", python).otherwise(script)).alias("module")).distinct(), rejects


def symbols_of(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, symbol, kind) of functions and classes that begin a line, by line patterns for three languages."""
    language = language_of(F.col(path_col))
    good = files.where(F.col(text_col).isNotNull() & language.isNotNull())
    found = lambda python, script: F.when(language == "Python", F.regexp_extract_all(text_col, F.lit(python), 1)).otherwise(F.regexp_extract_all(text_col, F.lit(script), 1))
    kinds = {"function": found("(?m)^[ \\t]*(?:async )?def (\\w+)", "(?m)^[ \\t]*(?:export )?(?:async )?function (\\w+)"), "class": found("(?m)^[ \\t]*class (\\w+)", "(?m)^[ \\t]*(?:export )?class (\\w+)")}
    parts = [good.select(path_col, F.explode(names).alias("symbol"), F.lit(kind).alias("kind")) for kind, names in kinds.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def declared_dependencies(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, dependency) that requirements files and package manifests declare; other files declare none."""
    listed = F.regexp_extract_all(text_col, F.lit("(?m)^[ \\t]*([A-Za-z0-9][A-Za-z0-9._-]*)[ \\t]*(?:\\[|[=<>~!;]|$)"), 1)
    named = F.concat(*(F.coalesce(F.map_keys(F.from_json(F.get_json_object(text_col, f"$.{k}"), "map<string,string>")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")))
    name = F.element_at(F.split(path_col, "/"), -1)
    found = F.when(name.rlike("^requirements.*[.]txt$"), listed).when(name == "package.json", named)
    return files.where(F.col(text_col).isNotNull()).select(path_col, F.explode(found).alias("dependency")).distinct()


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Modules to files (J9): the module's path with an extension or as a package; others stay unresolved."""
    base = F.regexp_replace(F.regexp_replace("module", "^[./]+", ""), "[.]", "/")
    ends = ["", ".py", "/__init__.py", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"]
    asked = imports.withColumn("candidate", F.explode(F.array(*(F.concat(base, F.lit(e)) for e in ends))))
    hit = asked.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("path", "module").agg(F.min("candidate").alias("target"))
    return imports.join(hit, ["path", "module"], "left").withColumn("resolved", F.col("target").isNotNull())
