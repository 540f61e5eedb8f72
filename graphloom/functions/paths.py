"""Functions of project-relative paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What names a test file, and folders that hold nothing but tests.
TEST_FILE = r"(_test\.go|_test\.py|_spec\.rb|_test\.rb|_spec\.lua|_test\.lua|\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs))$|^test_.*\.py$"
TEST_FOLDERS = ("testdata", "__tests__", "__mocks__", "test", "tests")
#: Top folders whose children are the subsystems.
GROUPING_FOLDERS = ("internal", "cmd", "pkg")
# Extension to language.
LANGUAGES = {
    "go": "go", "py": "python", "pyw": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "rb": "ruby", "lua": "lua", "gd": "gdscript", "css": "css", "scss": "scss", "sass": "sass", "less": "less", "html": "html",
    "htm": "html", "sql": "sql", "yml": "yaml", "yaml": "yaml", "md": "markdown", "markdown": "markdown", "vue": "vue",
}


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    """Folder of a file; '' at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_test_file(path: Column) -> Column:
    return F.lower(base_name(path)).rlike(TEST_FILE)


def is_test_path(path: Column) -> Column:
    """A test file, or any file below a folder for tests."""
    parts = F.split(F.lower(folder(path)), "/")
    return is_test_file(path) | F.arrays_overlap(parts, F.array(*map(F.lit, TEST_FOLDERS)))


def is_test_node(kind: Column, path: Column) -> Column:
    return (kind == "test") | is_test_path(path)


def subsystem(path: Column) -> Column:
    """The first folder, or the first two below a grouping folder; '(root)' for files at the root."""
    where = folder(F.regexp_replace(path, r"^(\./)+", ""))
    parts = F.split(where, "/")
    two = parts[0].isin(*GROUPING_FOLDERS) & (F.size(parts) >= 2)
    return F.when(where == "", "(root)").when(two, F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(parts[0])


def language(path: Column) -> Column:
    """Language by extension, null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def ancestors(path: Column) -> Column:
    """All folders above a file, the root '' first."""
    parts = F.split(folder(path), "/")
    return F.when(folder(path) == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))))


def normalized(path: Column) -> Column:
    """A path without '.', '..' and empty parts; null if it leaves the root."""
    away = F.lit(None).cast("array<string>")

    def step(out: Column, part: Column) -> Column:
        up = F.when(F.size(out) > 0, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(away)
        return F.when(out.isNull(), away).when(part.isin("", "."), out).when(part == "..", up).otherwise(F.concat(out, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(parts.isNotNull(), F.concat_ws("/", parts))


def glob_regex(pattern: str) -> str:
    """Regex of an exclude glob. A bare name matches any path segment; with a slash it is tied to the root; ``**/`` is any depth."""
    deep = pattern.startswith("**/")
    pattern = pattern.removeprefix("**/")
    tied = deep or "/" in pattern  # a slash at the end ties as well
    pattern = pattern.removeprefix("./").strip("/")
    out = ""
    i = 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}(?:/|$)" if tied and not deep else f"(?:^|/){out}(?:/|$)"


def matches_any_glob(path: Column, patterns: list[str]) -> Column:
    clean = F.regexp_replace(path, r"^\./", "")
    found = F.lit(False)
    for p in patterns:
        found = found | clean.rlike(glob_regex(p))
    return found
