"""Where declarations end and what they call, for languages read by patterns: small per-file helpers, linear in the text."""

from __future__ import annotations

import re
from bisect import bisect_right

_C_LIKE = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
#: Comments and strings of each language, which hold no code.
QUIET = {
    "go": _C_LIKE.replace(r"`(?:\\.|[^`\\])*`", "`[^`]*`"),
    "typescript": _C_LIKE,
    "css": r"/\*.*?\*/",
    "ruby": r"^=begin\b.*?^=end\b|#(?!\{)[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'",
    "lua": r"--\[\[.*?\]\]|--[^\n]*|\[\[.*?\]\]|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "gdscript": r"#[^\n]*|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
}
#: What opens and closes a block where braces do not: at any place, or (``at_start``) only as the first word of a line.
_ENDS = {
    "ruby": re.compile(r"(?P<open>\bdo\b|^[ \t]*(?:def|class|module|begin|case|if|unless|while|until|for)\b|=[ \t]*(?:case|if|begin)\b)|(?P<close>^[ \t]*end\b|[;\s]end\b)", re.MULTILINE),
    "lua": re.compile(r"(?P<open>\bfunction\b|\bdo\b|\bif\b|\brepeat\b)|(?P<close>\bend\b|\buntil\b)"),
}
_BRACE = re.compile(r"(?P<open>\{)|(?P<close>\})")
#: A loop's own "do" opens nothing more than its "while" or "for" did.
_RUBY_LOOP = re.compile(r"^[ \t]*(?:while|until|for)\b", re.MULTILINE)
_CALL = re.compile(r"(?<![\w.$:@])([A-Za-z_$][\w$]*[?!]?(?:(?:\?\.|::|[.:])[A-Za-z_$][\w$]*[?!]?)*)[ \t]*(?:\[[^\[\]\n()]*\])?\(")
#: A member of what a call gave.
_CHAINED = re.compile(r"\)(?:\?\.|[.:])([A-Za-z_$][\w$]*[?!]?)[ \t]*\(")
#: Words that stand before a parenthesis without being called (fixed values).
KEYWORDS = frozenset(["if", "for", "while", "switch", "catch", "return", "function", "func", "with", "await", "typeof", "new", "super", "select", "go", "defer", "range", "case", "do", "elsif", "elseif", "unless", "until", "and", "or", "not", "in", "def", "yield", "then", "local", "import", "type", "struct", "interface", "map", "chan", "else", "void", "delete", "throw", "instanceof", "of"])
#: Built into the language (fixed values).
BUILT_IN = {
    "go": frozenset(["append", "cap", "clear", "close", "complex", "copy", "delete", "imag", "len", "make", "max", "min", "new", "panic", "print", "println", "real", "recover", "string", "byte", "rune", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "bool", "error", "any"]),
    "typescript": frozenset(["require"]),
    "lua": frozenset(["require"]),
    "ruby": frozenset(["require", "require_relative"]),
}


def code_only(text: str, language: str) -> str:
    """The text with comments and strings blanked, each character in its place."""
    rule = QUIET.get(language)
    if not rule:
        return text
    return re.sub(rule, lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.DOTALL | re.MULTILINE)


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def block_ends(code: str, language: str) -> list[tuple[int, int]]:
    """(position of the opening, position of the closing) of each closed block, by opening."""
    rule = _ENDS.get(language, _BRACE)
    loops = set()
    if language == "ruby":
        starts = line_starts(code)
        loops = {bisect_right(starts, m.start()) for m in _RUBY_LOOP.finditer(code)}
    found, stack = [], []
    for m in rule.finditer(code):
        if m.lastgroup == "open":
            if not (language == "ruby" and m.group() == "do" and bisect_right(starts, m.start()) in loops):
                stack.append(m.start())
        elif stack:
            found.append((stack.pop(), m.end()))
    return sorted(found)


def calls(code: str, language: str) -> list[tuple[str, int]]:
    """(dotted name, position) of what is called with parentheses."""
    skipped = BUILT_IN.get(language, frozenset())
    out = []
    for m in _CALL.finditer(code):
        name = re.sub(r"\?\.|::|:", ".", m[1])
        if language == "ruby":
            name = name.removesuffix(".new")
        head, last = name.split(".", 1)[0], name.rsplit(".", 1)[-1]
        if last not in KEYWORDS and head not in KEYWORDS - {"new"} and name not in skipped:
            out.append((name, m.start(1)))
    return sorted(out + [(f"_.{m[1]}", m.start(1)) for m in _CHAINED.finditer(code)], key=lambda x: x[1])
