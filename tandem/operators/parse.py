"""Functions, calls, imports and classes out of source text (PR1-PR20 but PR8).

Parsing is the one place where rows pass through Python: an Arrow map in which each file is
handled by itself. Python is parsed with its own grammar; the other languages by
patterns and matching braces, so their spans can differ from a full parser's on odd code.
Filter files before calling these: a filter does not move below a Python map.

A file that cannot be parsed gives what the patterns find, with the reason in ``error``.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import PARSED_LANGUAGES
from .state import ship

# The patterns of functions, calls and imports in each language.
_CLIKE = r"(?:^|\n)\s*(?:\w+\s+)*\w+(?:\s*<(?:[^<>]|<[^<>]*>)*>)?\s+(\w+)\s*\([^)]*\)\s*(?:const\s*)?(?:final\s*)?{"
_JS = [
    r"(?:^|\s)(\w+)\s*=\s*function\s*\([^)]*\)\s*{",
    r"(?:^|\s)function\s+(\w+)\s*\([^)]*\)\s*{",
    r"(?:^|\s)(\w+)\s*:\s*function\s*\([^)]*\)\s*{",
    r"(?:^|\s)(\w+)\s*=\s*\([^)]*\)\s*=>\s*{",
]
FUNCTION_PATTERNS = {
    "c": [_CLIKE],
    "cpp": [_CLIKE],
    "java": [_CLIKE],
    "go": [_CLIKE],
    "python": [r"(?:^|\s*)(?:async\s+)?def\s+(\w+)\s*\([^)]*\)\s*:"],
    "javascript": _JS,
    "typescript": [*_JS, r"(?:^|\s)(\w+)\s*\([^)]*\)\s*{\s*"],
    "c_sharp": [r"(?:^|\n)\s*(?:public|private|protected|internal|\s)*\s*\w+\s+\w*\s*(\w+)\s*\([^)]*\)\s*{"],
    "other": [r"(?:^|\n)(?:\w+\s+)*(\w+)\s*\([^)]*\)\s*{"],
}
CALL_PATTERN = r"\b(\w+(?:\.\w+)*)\.(\w+)\s*\(|\b(\w+)\s*\("
PLAIN_CALL_PATTERN = r"\b(\w+)\s*\("
JAVA_IMPORT = r"import\s+(static\s+)?([\w.*]+)(?:\s+as\s+(\w+))?\s*;"
JS_REQUIRE = r"(?:const|let|var)\s+(\w+)\s*=\s*require\(['\"]([^'\"]+)['\"]\)"
JS_IMPORT = r"import\s+(?:(\w+)\s*,?\s*)?(?:\{([^}]*)\})?\s*from\s*['\"]([^'\"]+)['\"]"
C_INCLUDE = r"#include\s*[<\"]([^>\"]+)[>\"]"

_KEYWORDS = frozenset("if for while switch catch return sizeof new else do try synchronized throw".split())


#: Words and blanks without any other mark: what of such a run the patterns see at most, from its end.
_RUN, _SEEN = re.compile(r"[\w\s]{300,}"), 100


def _liner(code: str):
    """From offsets to line numbers."""
    ends = [m.start() for m in re.finditer("\n", code)]
    return lambda offset: bisect_left(ends, offset) + 1


def _shortened(code: str) -> str:
    """The code with the beginnings of long runs of words and blanks taken out but for their line ends: no function's head is that
    long, and the patterns' time grows with the square or cube of such a run."""
    return _RUN.sub(lambda m: ";\n" * m[0].count("\n", 0, len(m[0]) - _SEEN) + ";" + m[0][-_SEEN:], code)


def regex_functions(code: str, language: str) -> list[dict]:
    """PR7: name to line of each match; of equal names the last one's line stays."""
    found: dict[str, int] = {}
    code = _shortened(code) if "(" in code else ""
    line = _liner(code)
    for pattern in FUNCTION_PATTERNS.get(language, FUNCTION_PATTERNS["other"]):
        for m in re.finditer(pattern, code, re.MULTILINE):
            found[m[1]] = line(m.start())
    return [_function(n, at, at, language) for n, at in found.items()]


def _function(name: str, start: int, end: int, language: str, class_name: str | None = None, parameters: list[str] | None = None) -> dict:
    return {"name": name, "start_line": start, "end_line": end, "language": language, "class_name": class_name, "parameters": parameters or [], "body_size": end - start + 1}


_QUOTED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)
_TEMPLATE = re.compile(r"\btemplate\s*<[^<>;{}]{0,400}(?:<[^<>;{}]{0,400}>[^<>;{}]{0,400}){0,20}>")
_DIRECTIVE = re.compile(r"^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", re.M)


def _masked(code: str, kind: str) -> str:
    """The code with strings, comments and, in C, preprocessor lines and template heads blanked out; every offset and line stays."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    code = _QUOTED.sub(blank, code)
    return _TEMPLATE.sub(blank, _DIRECTIVE.sub(blank, code)) if kind == "c" else code


def _closings(masked: str) -> dict[int, int]:
    """From the offset of each brace and parenthesis to that of the one that closes it. A closing mark of the other kind than
    the last open one ends what was opened in between as well; what never closes is left out."""
    out, open_at = {}, []
    for m in re.finditer(r"[(){}]", masked):
        mark = m[0]
        if mark in "({":
            open_at.append((mark, m.start()))
            continue
        wanted = "(" if mark == ")" else "{"
        if mark == ")" and open_at and open_at[-1][0] == "{":
            continue  # a stray parenthesis does not end a block
        while open_at and open_at[-1][0] != wanted:
            open_at.pop()
        if open_at:
            out[open_at.pop()[1]] = m.start()
    return out


def _names(parameters: str, language: str) -> list[str]:
    """PR6: plain and typed parameters; those with a default and variadic ones are not counted."""
    out = []
    depth, part, parts = 0, "", []
    for c in re.sub(r"[=-]>", "=", parameters):
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and depth <= 0:
            parts.append(part)
            part = ""
        else:
            part += c
    for p in (x.strip() for x in [*parts, part]):
        if not p or "=" in p or "..." in p or p == "void":
            continue
        pointer = re.search(r"\(\s*[*&]\s*(\w+)", p)
        out.append(p if language == "javascript" else pointer[1] if pointer else re.split(r"[\s*&]+", re.sub(r"(?:\[[^\]]*\]\s*)+$", "", p).strip())[-1])
    return out


#: What stands before a function's parentheses, and what between them and its brace.
_HEADS = {
    "java": r"(?:^|[;{}\n])[ \t]*(?:@[\w.]+(?:\([^()]*\))?\s+)*((?:[\w<>\[\],.?&]+\s+){1,16})(\w+)\s*\(",
    "javascript": r"(?:function\s*\*?\s+(\w+)|(?:^|[;{}\n])[ \t]*(?:async\s+|static\s+|get\s+|set\s+)*(\w+))\s*\(",
    "c": r"(?:^|[;{}\n])[ \t]*((?:[\w<>:,]+[\s*&]+){1,16})(\w+)\s*\(",
}
_TAILS = {
    "java": re.compile(r"\s*(?:throws\s+[\w.,\s<>]{1,400}?)?\{"),
    "javascript": re.compile(r"\s*\{"),
    "c": re.compile(r"\s*(?:(?:const|noexcept|override|final|volatile)\s*){0,5}(?:->\s*[\w:<>*&\s]{1,200}?)?\{"),
}


def brace_functions(code: str, language: str) -> list[dict]:
    """PR3-PR5: methods, functions and their spans. Heads are found outside strings and comments; parentheses and braces are matched."""
    kind = "c" if language in ("c", "cpp") else language
    classes, out = class_spans(code, language, any_language=True), []
    masked, line = _masked(code, kind), _liner(code)
    closes, inside_to = _closings(masked), -1
    for m in re.finditer(_HEADS[kind], masked):
        name = m[2] or (m[1] if kind == "javascript" else None)
        lead = (m[1] or "").split() if kind != "javascript" else []
        open_at = m.end() - 1
        if open_at < inside_to or not name or name in _KEYWORDS or {"new", "return", "else", "throw"} & set(lead):
            continue
        close = closes.get(open_at)
        tail = _TAILS[kind].match(masked, close + 1) if close else None
        if not tail or (kind == "java" and not lead):
            continue
        inside_to = close
        head = m.start(2) if m[2] else m.start(1)
        line_start = m.start() + len(re.match(r"[;{}\n]?\s*", m[0])[0])
        start, end = line(min(line_start, head)), line(closes.get(tail.end() - 1, len(code) - 1))
        owner = next((c["name"] for c in classes if c["start_line"] <= start <= c["end_line"]), None)
        out.append(_function(name, start, end, language, owner if kind == "c" else None, _names(masked[open_at + 1 : close], language)))
    return out


def python_functions(code: str) -> list[dict]:
    """PR2: every function once, methods too, in order of lines."""
    out = []
    for node in ast.walk(ast.parse(code)):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            a = node.args
            plain = [x.arg for x in a.posonlyargs + a.args]
            plain = plain[: len(plain) - len(a.defaults)] if a.defaults else plain
            plain += [x.arg for x, d in zip(a.kwonlyargs, a.kw_defaults) if d is None]
            out.append(_function(node.name, node.lineno, node.end_lineno or node.lineno, "python", None, plain))
    return sorted(out, key=lambda f: (f["start_line"], -f["end_line"]))


def functions_of(code: str, language: str | None) -> list[dict]:
    """PR1: the grammar's or the braces' functions; the patterns' where those fail or find nothing."""
    if not code or language is None:
        return []
    if language not in PARSED_LANGUAGES:
        return regex_functions(code, language)
    try:
        found = python_functions(code) if language == "python" else brace_functions(code, language)
    except (SyntaxError, ValueError, RecursionError):
        found = []
    return found or regex_functions(code, language)


def regex_calls(code: str, language: str) -> list[dict]:
    """PR14."""
    out, line = [], _liner(code)
    dotted = language in ("python", "java", "javascript")
    for m in re.finditer(CALL_PATTERN if dotted else PLAIN_CALL_PATTERN, code):
        name = f"{m[1]}.{m[2]}" if dotted and m[1] and m[2] else m[3] if dotted else m[1]
        out.append({"function": name, "line_number": line(m.start()), "type": "method_call" if "." in name else "function_call"})
    return out


def calls_of(code: str, language: str | None) -> list[dict]:
    """PR9-PR13: f(...) and obj.m(...); longer chains are dropped. Of Java's obj.m() the method is taken."""
    if not code or language not in PARSED_LANGUAGES:
        return regex_calls(code, language) if code and language else []
    if language == "python":
        out = []
        for node in ast.walk(ast.parse(code)):
            if isinstance(node, ast.Call):
                f = node.func
                if isinstance(f, ast.Name):
                    out.append({"function": f.id, "line_number": node.lineno, "type": "function_call"})
                elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                    out.append({"function": f"{f.value.id}.{f.attr}", "line_number": node.lineno, "type": "method_call"})
        return sorted(out, key=lambda c: c["line_number"])
    heads = {(f["name"], f["start_line"]) for f in brace_functions(code, language)}
    out, line_of = [], _liner(code)
    code = _masked(code, "c" if language in ("c", "cpp") else language)
    for m in re.finditer(r"(?<![\w.])(?:(\w+)\s*(?:\.|->)\s*)?(\w+)\s*\(", code):
        line = line_of(m.start())
        if m[2] in _KEYWORDS or (not m[1] and (m[2], line) in heads) or re.search(r"(?:function|new)\s+$", code[max(0, m.start() - 12) : m.start()]):
            continue
        name = m[2] if language == "java" or not m[1] else f"{m[1]}.{m[2]}"
        out.append({"function": name, "line_number": line, "type": "method_call" if m[1] else "function_call"})
    return out


def imports_of(code: str, language: str | None) -> dict[str, str]:
    """PR15-PR18, PR20, FLT20: alias to path; what cannot be read gives nothing."""
    out: dict[str, str] = {}
    if not code:
        return out
    if language == "python":
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError):
            return out
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                out |= {a.asname or a.name: a.name for a in node.names}
            elif isinstance(node, ast.ImportFrom):
                out |= {a.asname or a.name: f"{node.module}.{a.name}" if node.module else a.name for a in node.names}
    elif language == "java":
        for m in re.finditer(JAVA_IMPORT, code):
            if "*" not in m[2]:
                out[m[3] or m[2].rsplit(".", 1)[-1]] = m[2]
    elif language in ("javascript", "typescript", "tsx"):
        for m in re.finditer(JS_IMPORT, code):
            if m[1]:
                out[m[1]] = f"{m[3]}/{m[1]}"
            for item in (m[2] or "").split(","):
                name, _, alias = (x.strip() for x in item.partition(" as "))
                if name:
                    out[alias or name] = f"{m[3]}/{name}"
        out |= {m[1]: m[2] for m in re.finditer(JS_REQUIRE, code)}
    elif language in ("c", "cpp"):
        out |= {m[1].rsplit("/", 1)[-1]: m[1] for m in re.finditer(C_INCLUDE, code)}
    return out


def class_spans(code: str, language: str | None, any_language: bool = False) -> list[dict]:
    """PR19: classes of Python, Java and JavaScript; of C and C++ only for their own functions' class."""
    if not code or (language not in ("python", "java", "javascript") and not any_language):
        return []
    if language == "python":
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError):
            return []
        found = [{"name": n.name, "start_line": n.lineno, "end_line": n.end_lineno or n.lineno} for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]
    else:
        found, line = [], _liner(code)
        masked = _masked(code, "c" if language in ("c", "cpp") else language)
        closes = _closings(masked)
        for m in re.finditer(r"\b(?:class|interface|enum|struct)\s+(\w+)[^;{}()]{0,2000}\{", masked):
            found.append({"name": m[1], "start_line": line(m.start()), "end_line": line(closes.get(m.end() - 1, len(code) - 1))})
    return sorted(found, key=lambda c: (c["start_line"], -c["end_line"]))


_FUNCTION = pa.struct([("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("language", pa.string()), ("class_name", pa.string()), ("parameters", pa.list_(pa.string())), ("body_size", pa.int32())])
_CALL = pa.struct([("function", pa.string()), ("line_number", pa.int32()), ("type", pa.string())])
_CLASS = pa.struct([("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])
_SHAPE = """functions array<struct<name:string,start_line:int,end_line:int,language:string,class_name:string,parameters:array<string>,body_size:int>>,
 calls array<struct<function:string,line_number:int,type:string>>, classes array<struct<name:string,start_line:int,end_line:int>>, imports map<string,string>, error string"""


def parse_files(files: DataFrame, path: str = "path", language: str = "language", code: str = "code") -> DataFrame:
    """(path, language, functions, calls, classes, imports, error): everything of a file in one pass."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, codes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cols: list[list] = [[], [], [], [], []]
            for lang, text in zip(langs, codes):
                error = None
                try:
                    calls = calls_of(text or "", lang)
                except (SyntaxError, ValueError, RecursionError) as e:
                    calls, error = regex_calls(text or "", lang or ""), f"{type(e).__name__}: {e}"
                for c, v in zip(cols, (functions_of(text or "", lang), calls, class_spans(text or "", lang), list(imports_of(text or "", lang).items()), error)):
                    c.append(v)
            kinds = [pa.list_(_FUNCTION), pa.list_(_CALL), pa.list_(_CLASS), pa.map_(pa.string(), pa.string()), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["path", "language", "functions", "calls", "classes", "imports", "error"])

    return files.select(F.col(path).alias("path"), F.col(language).alias("language"), F.col(code).alias("code")).mapInArrow(run, f"path string, language string, {_SHAPE}")


def call_names(code: Column) -> Column:
    """PR14 without line numbers, as an expression: the bare names before '('."""
    return F.regexp_extract_all(code, F.lit(r"([\p{L}\p{N}_]+)\s*\("), F.lit(1))


def python_function_names(code: Column) -> Column:
    """PR7 for Python without line numbers, as an expression."""
    return F.regexp_extract_all(code, F.lit(r"def\s+(\w+)\s*\([^)]*\)\s*:"), F.lit(1))
