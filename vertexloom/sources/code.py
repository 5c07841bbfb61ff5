"""Source code as edges by regular expressions: definitions, members, inheritance, imports and calls within a file.

A language is a handful of patterns and the way its blocks end, by braces or by indentation. Comments and strings are
blanked first. A name that a pattern doesn't know gives no edge, and nothing that isn't written in the file is guessed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

Edge = tuple[str, str, str]
_NAME = r"[A-Za-z_$][\w$]*"
_DOTTED = rf"{_NAME}(?:(?:\.|::|\\|/)\w+)*"


@dataclass(frozen=True)
class Language:
    """Patterns are matched at the start of a line without its indentation. `types` have groups name and bases, `functions`
    name and owner (both optional but the names), `imports` name."""

    types: str
    functions: str
    imports: str
    braces: bool = True
    comment: str = r"//[^\n]*|/\*.*?\*/"
    strings: str = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    keep_strings: str = r"(?:import|from|require|include|use|source|library)\b"


def _types(words: str, bases: str = r"", before: str = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|data|export|default|partial|pub(?:\([^)]*\))?|async|inline|case|readonly|unsafe)\s+)*") -> str:
    return rf"{before}(?:{words})\s+(?P<name>{_NAME})(?:\s*<[^>{{]*>)?{bases}"


_COLON_BASES = r"(?:\s*(?:\([^)]*\))?\s*:\s*(?P<bases>[^{]+))?"
_EXTENDS = r"(?:\s*\([^)]*\))?(?:\s+(?:extends|implements|with)\s+(?P<bases>[^{]+))?"
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|export|default|open|inline|suspend|synchronized|native|sealed|extern|const|constexpr|unsafe|pub(?:\([^)]*\))?)\s+)*"
_TYPED = rf"{_MODIFIERS}(?!(?:return|new|else|throw|await|delete|case|goto|using|package|import|typedef|if|for|while|switch|catch|do)\b)(?:[\w<>\[\],.:&*?]+\s+)+[*&]*(?P<name>{_NAME})\s*\([^;{{]*\)[^;{{]*\{{"

_JS = Language(
    _types("class|interface|enum", _EXTENDS),
    rf"{_MODIFIERS}(?:function\s*\*?\s*(?P<name>{_NAME})\s*[(<]|(?:const|let|var)\s+(?P<name2>{_NAME})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|{_NAME}\s*=>)|(?:get\s+|set\s+)?(?!(?:if|for|while|switch|catch|return|function)\b)(?P<name3>{_NAME})\s*\([^)]*\)\s*(?::[^{{;]+)?\{{)",
    r"(?:import\b[^'\"]*|export\b[^'\"]*\bfrom\s*|.*\brequire\s*\(\s*)['\"](?P<name>[^'\"]+)",
)
_JAVA = Language(_types("class|interface|enum|record", _EXTENDS), _TYPED, rf"import\s+(?:static\s+)?(?P<name>{_DOTTED})")
_C = Language(_types("class|struct|union|enum(?:\\s+class)?", r"(?:\s+final)?" + _COLON_BASES + r"(?=\s*\{|\s*$)"), _TYPED, r"#\s*include\s*[<\"](?P<name>[^>\"]+)")
_PY = Language(
    rf"class\s+(?P<name>{_NAME})(?:\((?P<bases>[^)]*)\))?", rf"(?:async\s+)?def\s+(?P<name>{_NAME})", rf"(?:from\s+(?P<name>\.*[\w.]*)\s+import|import\s+(?P<name2>[\w.]+))",
    False, r"#[^\n]*", r"(?s:\"\"\".*?\"\"\"|'''.*?''')|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", r"(?!)",
)
_RUBY = Language(rf"(?:class|module)\s+(?P<name>{_NAME}(?:::\w+)*)(?:\s*<\s*(?P<bases>[\w:]+))?", rf"def\s+(?:self\.)?(?P<name>{_NAME}[?!]?)", r"require(?:_relative)?\s*\(?['\"](?P<name>[^'\"]+)", False, r"#[^\n]*")

LANGUAGES: dict[str, Language] = {
    **dict.fromkeys("py pyi pyw".split(), _PY), **dict.fromkeys("js jsx mjs cjs ts tsx mts cts vue svelte".split(), _JS), **dict.fromkeys("java groovy".split(), _JAVA),
    **dict.fromkeys("c h cc cpp cxx hpp m mm cu".split(), _C), **dict.fromkeys("rb rake".split(), _RUBY),
    **dict.fromkeys("kt kts".split(), Language(_types("class|interface|object|enum class", _COLON_BASES), rf"{_MODIFIERS}fun\s+(?:<[^>]*>\s*)?(?:{_NAME}\.)?(?P<name>{_NAME})", rf"import\s+(?P<name>{_DOTTED})")),
    "scala": Language(_types("class|trait|object", _EXTENDS), rf"{_MODIFIERS}def\s+(?P<name>{_NAME})", rf"import\s+(?P<name>{_DOTTED})"),
    "go": Language(rf"type\s+(?P<name>{_NAME})\s+(?:struct|interface)", rf"func\s+(?:\(\s*\w*\s*\*?(?P<owner>{_NAME})[^)]*\)\s*)?(?P<name>{_NAME})", r"(?:import\s+)?(?:[\w.]+\s+)?\"(?P<name>[^\"]+)\"\s*$", keep_strings=r"(?:import|[\w.]*\s*\"[^\"]*\"\s*$)"),
    "rs": Language(rf"(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(?P<name>{_NAME})(?:<[^>{{]*>)?(?:\s*:\s*(?P<bases>[^{{]+))?", rf"{_MODIFIERS}fn\s+(?P<name>{_NAME})", rf"(?:pub\s+)?(?:use|mod|extern\s+crate)\s+(?P<name>{_DOTTED})", strings=r"\"(?:\\.|[^\"\\])*\""),
    "cs": Language(_types("class|interface|struct|record|enum", _COLON_BASES), _TYPED, rf"using\s+(?:static\s+)?(?P<name>{_DOTTED})\s*;"),
    "swift": Language(_types("class|struct|protocol|enum|extension|actor", _COLON_BASES), rf"{_MODIFIERS}(?:mutating\s+)?func\s+(?P<name>{_NAME})", rf"import\s+(?P<name>{_DOTTED})"),
    "php": Language(_types("class|interface|trait|enum", _EXTENDS), rf"{_MODIFIERS}function\s+&?(?P<name>{_NAME})", r"(?:use\s+(?P<name>[\w\\]+)|(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<name2>[^'\"]+))", comment=r"//[^\n]*|#[^\n]*|/\*.*?\*/"),
    "dart": Language(_types("class|mixin|enum|extension", _EXTENDS), _TYPED, r"(?:import|export|part)\s+['\"](?P<name>[^'\"]+)"),
    "lua": Language(r"(?!)", rf"(?:local\s+)?function\s+(?:(?P<owner>{_NAME})[.:])?(?P<name>{_NAME})", r".*\brequire\s*\(?\s*['\"](?P<name>[^'\"]+)", False, r"--\[\[.*?\]\]|--[^\n]*", keep_strings=r".*\brequire\b"),
    **dict.fromkeys("sh bash zsh".split(), Language(r"(?!)", rf"(?:function\s+(?P<name>[\w-]+)|(?P<name2>[\w-]+)\s*\(\s*\))\s*(?:\(\s*\))?\s*\{{?", r"(?:source|\.)\s+(?P<name>[^\s;]+)", True, r"(?:(?<=\s)|^)#[^\n]*")),
    **dict.fromkeys("ex exs".split(), Language(rf"def(?:module|protocol|impl)\s+(?P<name>{_DOTTED})", rf"defp?\s+(?P<name>{_NAME}[?!]?)", rf"(?:import|alias|use|require)\s+(?P<name>{_DOTTED})", False, r"#[^\n]*")),
    "jl": Language(rf"(?:mutable\s+)?(?:struct|abstract\s+type|module)\s+(?P<name>{_NAME})(?:\{{[^}}]*\}})?(?:\s*<:\s*(?P<bases>\w+))?", rf"function\s+(?P<name>{_NAME})", rf"(?:using|import)\s+(?P<name>{_DOTTED})", False, r"#[^\n]*"),
    **dict.fromkeys("pl pm".split(), Language(r"package\s+(?P<name>[\w:]+)", rf"sub\s+(?P<name>{_NAME})", r"use\s+(?P<name>[A-Z][\w:]*)", True, r"#[^\n]*")),
    "r": Language(r"(?!)", rf"(?P<name>[\w.]+)\s*(?:<-|=)\s*function\b", r"(?:library|require)\s*\(\s*['\"]?(?P<name>[\w.]+)", True, r"#[^\n]*"),
    "sol": Language(rf"(?:abstract\s+)?(?:contract|interface|library)\s+(?P<name>{_NAME})(?:\s+is\s+(?P<bases>[^{{]+))?", rf"function\s+(?P<name>{_NAME})", r"import\b[^'\"]*['\"](?P<name>[^'\"]+)"),
    "zig": Language(rf"(?:pub\s+)?const\s+(?P<name>{_NAME})\s*=\s*(?:extern\s+|packed\s+)?(?:struct|enum|union)\b", rf"{_MODIFIERS}fn\s+(?P<name>{_NAME})", r".*@import\(\s*\"(?P<name>[^\"]+)", keep_strings=r".*@import"),
}


def _blank(body: str, language: Language) -> str:
    """Comments away and strings empty, lines kept; lines that import by a string keep it."""

    def one(m: re.Match) -> str:
        if m["c"] is not None:
            return re.sub(r"[^\n]", " ", m["c"])
        start = body.rfind("\n", 0, m.start()) + 1
        if re.match(language.keep_strings, body[start : body.find("\n", m.end()) if "\n" in body[m.end() :] else len(body)].strip()) or re.match(r".*\brequire\s*\(\s*$", body[start : m.start()]):
            return m[0]
        return '""' + "\n" * m[0].count("\n")

    return re.sub(rf"(?P<s>{language.strings})|(?P<c>{language.comment})", one, body, flags=re.S)


def _group(m: re.Match, *names: str) -> str | None:
    found = m.groupdict()
    return next((found[n] for n in names if found.get(n)), None)


def _bases(text: str | None) -> list[str]:
    bare = re.sub(r"<[^<>]*>|\([^()]*\)|\b(?:public|private|protected|virtual|extends|implements|with|where)\b", " ", text or "")
    return [b for b in (re.match(rf"\s*({_DOTTED})\s*$", p) for p in re.split(r"[,+]|\s{1,}(?=\w)", bare)) if b]


def code_edges(body: str | None, extension: str) -> list[Edge]:
    """(src, relation, dst): `file` contains types and functions, types have methods and inherit, functions call what the file defines."""
    language = LANGUAGES[extension]
    out: list[Edge] = []
    scopes: list[tuple[str, str, int]] = []  # kind, name, depth at which it began
    functions: dict[str, str] = {}
    inside: list[tuple[str, str]] = []
    depth = 0
    for line in _blank(body or "", language).splitlines():
        bare = line.strip()
        if not bare:
            continue
        level = depth if language.braces else len(line) - len(line.lstrip())
        if not re.match(r"[)}\]]", bare) or not language.braces:
            while scopes and level <= scopes[-1][2]:
                scopes.pop()
        owner = next((n for k, n, _ in reversed(scopes) if k == "type"), None)
        if m := re.match(language.imports, bare):
            out.append(("file", "imports", _group(m, "name", "name2")))
        elif extension == "rs" and (m := re.match(rf"impl(?:<[^>]*>)?\s+(?:(?P<trait>{_DOTTED})(?:<[^>]*>)?\s+for\s+)?(?P<name>{_NAME})", bare)):
            scopes.append(("type", m["name"], level))
            out += [(m["name"], "implements", m["trait"])] if m["trait"] else []
        elif m := re.match(language.types, bare):
            name = m["name"]
            out.append((owner or "file", "contains", name))
            relation = "implements" if re.search(r"\bimplements\b", m[0]) and not re.search(r"\bextends\b", m[0]) else "inherits"
            out += [(name, relation, b[1]) for b in _bases(m.groupdict().get("bases"))]
            scopes.append(("type", name, level))
        elif m := re.match(language.functions, bare):
            name = _group(m, "name", "name2", "name3")
            within = m.groupdict().get("owner") or (owner if scopes and scopes[-1][0] == "type" else None)
            shown = f".{name}()" if within else f"{name}()"
            out.append((within, "method", shown) if within else (next((n for k, n, _ in reversed(scopes) if k == "function"), "file"), "contains", shown))
            functions.setdefault(name, shown)
            scopes.append(("function", shown, level))
            if rest := bare[m.end() :]:
                inside.append((shown, rest))
        else:
            caller = next((n for k, n, _ in reversed(scopes) if k == "function"), None)
            if caller:
                inside.append((caller, bare))
        if language.braces:
            depth += line.count("{") - line.count("}")
    for caller, text in inside:
        for name in re.findall(rf"({_NAME}[?!]?)\s*\(", text):
            if name in functions and functions[name] != caller:
                out.append((caller, "calls", functions[name]))
    return list(dict.fromkeys(out))


def extractor(extension: str) -> Callable[[str | None], list[Edge]]:
    return lambda body: code_edges(body, extension)
