"""From file contents to symbols and references.

Small per-file helpers, one per language, run in ``mapInPandas``; all that relates files to each other is left to joins.
Python and HTML are read with the standard library's parsers, Markdown and SQL by line and token rules, other
languages by declaration patterns (approximate, and labelled so by their resolver never covering them).
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..ship import ship
from . import blocks

#: Symbols and references in one table: ``row`` says which a row is.
EXTRACTED = "file_path string, row string, kind string, name string, fqn string, start_line int, end_line int, from_fqn string, docstring string"
#: Longer files are hashed but not parsed; generated and minified ones neither.
MAX_BYTES = 2 << 20
#: Fixed values.
GENERATED = r"(?m)^\s*// Code generated .* DO NOT EDIT\.\s*$"
MINIFIED = r"\.min\.(js|mjs|css|js\.map|css\.map)$"

Row = tuple[str, str, str, str, int, int, str | None, str | None]


def _symbol(kind: str, name: str, fqn: str, a: int, b: int, doc: str | None = None) -> Row:
    return ("symbol", kind, name, fqn, a, b, None, doc)


def _reference(kind: str, name: str, line: int, source: str | None) -> Row:
    return ("reference", kind, name, name, line, line, source, None)


def python_rows(text: str) -> list[Row]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[Row] = []

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute) and (head := dotted(node.value)):
            return f"{head}.{node.attr}"
        return None

    def walk(node: ast.AST, owner: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                fqn = f"{owner}.{child.name}" if owner else child.name
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "test" if child.name.startswith("test_") else "method" if in_class else "function"
                out.append(_symbol(kind, child.name, fqn, child.lineno, child.end_lineno or child.lineno, ast.get_docstring(child)))
                if is_class:
                    out.extend(_reference("extends", b, child.lineno, fqn) for b in map(dotted, child.bases) if b)
                walk(child, fqn, is_class)
                continue
            if isinstance(child, ast.Import):
                out.extend(_reference("imports", a.name, child.lineno, owner or None) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append(_reference("imports", "." * child.level + (child.module or ""), child.lineno, owner or None))
            elif isinstance(child, ast.Call) and (name := dotted(child.func)):
                if name.startswith(("self.", "cls.")) and "." in owner:
                    name = owner.rsplit(".", 1)[0] + name[name.index(".") :]
                out.append(_reference("calls", name, child.lineno, owner or None))
            walk(child, owner, in_class and not isinstance(child, ast.expr))

    walk(tree, "", False)
    return out


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[Row] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        line = self.getpos()[0]
        for key, value in attrs:
            if not value:
                continue
            if key == "class":
                self.rows += [_reference("styles", f".{c}", line, None) for c in value.split()]
            elif key == "id":
                self.rows += [_reference("styles", f"#{value}", line, None)]
            elif (tag, key) in (("script", "src"), ("link", "href"), ("img", "src")):
                self.rows.append(_reference("imports", value, line, None))


def html_rows(text: str) -> list[Row]:
    parser = _Html()
    parser.feed(text)
    return parser.rows


def markdown_rows(text: str) -> list[Row]:
    """Sections nest by level and end where the next of their level or above begins; links to local files document them."""
    out: list[Row] = []
    open_: list[tuple[int, str, str, int]] = []
    lines = text.split("\n")
    fenced = False

    def close(level: int, line: int) -> None:
        while open_ and open_[-1][0] >= level:
            _, name, fqn, start = open_.pop()
            out.append(_symbol("section", name, fqn, start, line))

    for i, line in enumerate(lines, 1):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if fenced:
            continue
        if m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            level = len(m[1])
            close(level, i - 1)
            open_.append((level, m[2], "/".join([*(o[1] for o in open_), m[2]]), i))
        for target in re.findall(r"\]\(([^)\s#]+)[^)]*\)", line):
            if not re.match(r"[a-z]+:|//", target):
                out.append(_reference("documents", target, i, open_[-1][2] if open_ else None))
    close(1, len(lines))
    return out


_SQL_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_][\w$.]*|\d+|[^\s]", re.DOTALL)


def sql_rows(text: str) -> list[Row]:
    """Tables and views declared, tables read and written; names of WITH clauses are no tables, and DELETE writes."""
    starts = blocks.line_starts(text)
    tokens = [(m.group(), bisect_right(starts, m.start())) for m in _SQL_TOKEN.finditer(text) if not m.group().startswith(("--", "/*"))]
    out: list[Row] = []
    statement: list[tuple[str, int]] = []
    n = 0
    for token, line in [*tokens, (";", 0)]:
        if token != ";":
            statement.append((token, line))
            continue
        if statement:
            n += 1
            low = [t.lower() for t, _ in statement]
            ctes = {low[i - 1] for i, t in enumerate(low) if t == "as" and i and i + 1 < len(low) and low[i + 1] == "("} if "with" in low else set()
            name = lambda i: statement[i][0].strip('"`') if i < len(statement) and re.match(r"[\w\"`]", statement[i][0]) else None
            query = f"query{n}"
            made = None
            for i, t in enumerate(low):
                if t == "create":
                    k = i + 1
                    while k < len(low) and low[k] in ("or", "replace", "temp", "temporary", "materialized"):
                        k += 1
                    if k < len(low) and low[k] in ("table", "view"):
                        j = k + 1 + 3 * (low[k + 1 : k + 4] == ["if", "not", "exists"])
                        if made := name(j):
                            out.append(_symbol(low[k], made, made, statement[0][1], statement[-1][1]))
                elif t in ("from", "join") and (x := name(i + 1)) and x.lower() not in ctes and x.lower() not in ("select", "lateral"):
                    out.append(_reference("writes" if t == "from" and i and low[i - 1] == "delete" else "reads", x, statement[i][1], made or query))
                elif t in ("into", "update") and (x := name(i + 1)) and not (i and low[i - 1] in ("for", "do", "key")):
                    out.append(_reference("writes", x, statement[i][1], made or query))
            if made is None:
                out.append(_symbol("query", query, query, statement[0][1], statement[-1][1]))
        statement = []
    return out


#: Declarations by pattern: (kind, expression with the name as group 1), for languages without a parser here.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "go": [("function", r"^func\s+(\w+)\s*[\[(]"), ("method", r"^func\s+\([^)]*\)\s*(\w+)\s*\("), ("type", r"^type\s+(\w+)\s")],
    "typescript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("type", r"^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?(#?\w+)\s*(?:<[^<>]*>)?\([^;]*\{\s*$"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>")],
    "ruby": [("class", r"^\s*class\s+([\w:]+)"), ("module", r"^\s*module\s+([\w:]+)"), ("method", r"^\s*def\s+(?:self\.)?([\w?!=]+)")],
    "lua": [("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)")],
    "gdscript": [("function", r"^\s*(?:static\s+)?func\s+(\w+)"), ("class", r"^\s*class(?:_name)?\s+(\w+)")],
    "css": [("selector", r"^\s*([.#][\w-]+)[^{};]*\{")],
    "yaml": [("key", r"^([\w.-]+):(?:\s|$)")],
}
for _same, _of in (("javascript", "typescript"), ("vue", "typescript"), ("scss", "css"), ("less", "css")):
    PATTERNS[_same] = PATTERNS[_of]
IMPORTS: dict[str, str] = {
    "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$",
    "typescript": r"(?:from|import|require\()\s*['\"]([^'\"]+)['\"]",
    "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]",
    "lua": r"require\s*\(?\s*['\"]([^'\"]+)['\"]",
    "css": r"@(?:import|use|forward)\s+(?:url\()?['\"]([^'\"]+)['\"]",
}
for _same, _of in (("javascript", "typescript"), ("vue", "typescript"), ("scss", "css"), ("less", "css")):
    IMPORTS[_same] = IMPORTS[_of]


#: Languages whose calls are read, and how the rules of their blocks are called.
CALLING = {"go": "go", "typescript": "typescript", "javascript": "typescript", "vue": "typescript", "ruby": "ruby", "lua": "lua"}
_RECEIVER = re.compile(r"^func\s+\(\s*(?:\w+\s+)?\*?(\w+)")
_BASES = re.compile(r"\b(extends|implements)\s+([\w$.]+(?:\s*,\s*[\w$.]+)*)|\bclass\s+[\w:]+\s*(<)\s*([\w:]+)")


def _script(text: str) -> str:
    """A component file with all but its scripts blanked, so that lines keep their numbers."""
    blank = lambda part: re.sub(r"[^\n]", " ", part)
    out, last = [], 0
    for m in re.finditer(r"<script[^>]*>(.*?)</script>", text, re.DOTALL | re.IGNORECASE):
        out += [blank(text[last : m.start(1)]), m[1]]
        last = m.end(1)
    return "".join([*out, blank(text[last:])])


def pattern_rows(language: str) -> Callable[[str], list[Row]]:
    rules = [(kind, re.compile(rule)) for kind, rule in PATTERNS.get(language, [])]
    wanted = re.compile(IMPORTS[language]) if language in IMPORTS else None
    calling = CALLING.get(language)
    braces = calling in ("go", "typescript") or PATTERNS.get(language) is PATTERNS["css"]

    def rows(text: str) -> list[Row]:
        """Declarations with the lines they span and the declarations around them, imports, bases and calls.

        A call belongs to the innermost declaration around it, or to none.
        """
        if language == "vue":
            text = _script(text)
        rules_of = calling or ("css" if braces else language)
        code = blocks.code_only(text, rules_of)
        lines, starts = code.split("\n"), blocks.line_starts(code)
        ends = blocks.block_ends(code, rules_of) if calling or braces else []
        openings = [a for a, _ in ends]
        found: list[tuple[int, int, str, str, str]] = []
        for i, line in enumerate(lines, 1):
            for kind, rule in rules:
                if (m := rule.search(line)) and m[1] not in blocks.KEYWORDS:
                    kind = "test" if kind == "function" and re.match(r"Test[A-Z_]|test_", m[1]) else kind
                    # Its block is the first that opens on its lines, before any next statement.
                    at, last = starts[i - 1] + (m.start() if not braces else m.start(1)), i
                    k = bisect_left(openings, at)
                    if k < len(ends) and ";" not in code[at : ends[k][0]] and code.count("\n", at, ends[k][0]) <= 20:
                        last = bisect_right(starts, ends[k][1] - 1)
                    elif braces and kind == "method":
                        break
                    receiver = _RECEIVER.match(line) if calling == "go" else None
                    found.append((i, last, kind, m[1], f"{receiver[1]}.{m[1]}" if receiver else m[1]))
                    break
        out: list[Row] = []
        around: list[tuple[int, str, str]] = []
        owner_of: dict[int, str] = {}
        names_at = {}
        for i, last, kind, name, own in found:
            while around and around[-1][0] < i:
                around.pop()
            inside = around[-1] if around else None
            if kind == "method" and calling == "typescript" and not (inside and inside[2] == "class"):
                continue  # a call with a block, not a member
            fqn = f"{inside[1]}.{own}" if inside else own
            out.append(_symbol(kind, name, fqn, i, last))
            names_at[i] = name
            around.append((last, fqn, kind))
            for k in range(i, last + 1):
                owner_of[k] = fqn  # the innermost comes last
            if calling in ("typescript", "ruby") and kind in ("class", "type"):
                for m in _BASES.finditer(lines[i - 1]):
                    for base in re.split(r"\s*,\s*", m[2] or m[4]):
                        out.append(_reference(m[1] or "extends", base.replace("::", "."), i, fqn))
        if wanted:
            out += [_reference("imports", m[1], i, None) for i, line in enumerate(text.split("\n"), 1) for m in wanted.finditer(line)]
        for name, at in blocks.calls(code, calling) if calling else []:
            i = bisect_right(starts, at)
            if names_at.get(i) != name:
                out.append(_reference("calls", name, i, owner_of.get(i)))
        return out

    return rows


EXTRACTORS: dict[str, Callable[[str], list[Row]]] = {"python": python_rows, "html": html_rows, "markdown": markdown_rows, "sql": sql_rows}


def register(language: str, extractor: Callable[[str], list[Row]]) -> None:
    """Use ``extractor`` for a language from now on; it is shipped with the plan."""
    EXTRACTORS[language] = extractor


def extract(files: DataFrame) -> DataFrame:
    """EXTRACTED rows of ``files`` (file_path, content string), routed by extension; unknown, oversized, generated and minified files give none."""
    ship(files.sparkSession)
    of = {**{k: pattern_rows(k) for k in PATTERNS}, **EXTRACTORS}
    known = paths.language(F.col("file_path"))
    head = F.left("content", F.lit(4096))
    fit = (F.octet_length("content") <= MAX_BYTES) & ~head.rlike(GENERATED) & ~F.lower("file_path").rlike(MINIFIED)
    todo = files.where(fit).select("file_path", known.alias("language"), "content").where(F.col("language").isin(*of))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *row) for path, language, text in batch.itertuples(index=False) for row in of[language](text)]
            yield pd.DataFrame(rows, columns=["file_path", "row", "kind", "name", "fqn", "start_line", "end_line", "from_fqn", "docstring"])

    return todo.mapInPandas(run, EXTRACTED)

