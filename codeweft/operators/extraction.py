"""Symbols and references of source files: definitions with their spans, calls, imports and bases."""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For languages other than Python: patterns of definitions by kind (the name is the last group that matched), and of imports and bases.
_NAME = r"([A-Za-z_$][\w$]*)"
_ANNOTATED, _MODIFIED = r"(?:@[\w.]+(?:\([^()]*\))?[ \t]+)*", r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*"
_PARAMS, _STATEMENT = r"\([^(){};]*(?:\([^()]*\)[^(){};]*)*\)", r"(?:if|for|while|do|switch|case|catch|try|return|throw|new|else|assert|yield|await|delete|goto|package|import|using|typedef|class|interface|enum|record|struct|extends|implements)\b"
DEFINITIONS = {
    "javascript": [("class", rf"^[ \t]*+(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(?!extends\b|implements\b){_NAME}"), ("function", rf"^[ \t]*+(?:export\s+(?:default\s+)?)?(?:async\s+)?function\*?\s+{_NAME}"), ("function", rf"^[ \t]*+(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:\((?:[^();]|\([^()]*\))*\)(?:\s*:[^=;{{}}]+)?|\w+)\s*=>"), ("method", rf"^[ \t]++(?:(?:static|async|private|public|protected|override|get|set)\s+)*(?:\*\s*)?(?!function\b|with\b|{_STATEMENT})([A-Za-z_$][\w$]*+)\s*(?:<[^;{{}}()]*>\s*)?\((?:[^();]|\([^()]*\))*\)\s*(?::[^{{=;]+)?\{{")],
    "java": [("class", rf"^[ \t]*+{_ANNOTATED}(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record)\s+{_NAME}"), ("method", rf"^[ \t]*+{_ANNOTATED}{_MODIFIED}(?:<[^;{{}}()]*>\s*)?(?!{_STATEMENT})[\w.$]+(?:\s*<[^;{{}}()=]*>)?(?:\s*\[\s*\])*\s+{_NAME}\s*{_PARAMS}\s*(?:\[\s*\]\s*)*(?:throws\s[^;{{}}()]*)?(?:default\b|[{{;])"), ("constructor", rf"^[ \t]*+{_ANNOTATED}{_MODIFIED}(?:<[^;{{}}()]*>\s*)?{_NAME}\s*{_PARAMS}\s*(?:throws\s[^;{{}}()]*)?\{{")],
    "go": [("class", rf"^type\s+{_NAME}\b\s*(?:\[[^\]\n]+\]\s*)?(?!\s*=)\S"), ("method", rf"^func\s+\([^)]*\)\s*{_NAME}"), ("function", rf"^func\s+{_NAME}")],
    "c": [("class", rf"^(?:typedef\s+)?(?:struct|union|enum)\s+{_NAME}\s*\{{"), ("function", rf"^(?!\s*(?:if|for|while|switch|return)\b)[A-Za-z_][\w\s*]*?\b{_NAME}\s*\([^;]*\)\s*\{{")],
    "rust": [("class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+{_NAME}"), ("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+{_NAME}")],
}
DEFINITIONS["typescript"] = DEFINITIONS["javascript"] + [("class", rf"^[ \t]*+(?:export\s+(?:default\s+)?)?(?:declare\s+)?interface\s+{_NAME}"), ("alias", rf"^[ \t]*+(?:export\s+)?(?:declare\s+)?type\s+{_NAME}\s*(?:<[^;{{}}()]*?>\s*)?=(?!=)")]
_BODY = r"(?:\s|const|noexcept|override|final|&)*+(?:(?:->|:)[^{;]*+)?\{"
DEFINITIONS["cpp"] = DEFINITIONS["c"] + [("class", rf"^\s*class\s+{_NAME}[^;{{]*\{{"), ("function", rf"^(?!\s*{_STATEMENT})(?:[A-Za-z_][\w \t*&<>,:]*?[ \t*&])?(?:\w+(?:<[^<>;{{}}()]*>)?::)+(~?[A-Za-z_]\w*)\s*{_PARAMS}{_BODY}"), ("function", rf"^[ \t]+(?!{_STATEMENT})[A-Za-z_][\w \t*&<>,:]*?[ \t*&](?!{_STATEMENT})(~?[A-Za-z_]\w*)\s*{_PARAMS}{_BODY}"), ("constructor", rf"^[ \t]+(?:explicit\s+|inline\s+|virtual\s+)*(~?[A-Za-z_]\w*)\s*{_PARAMS}{_BODY}")]
IMPORTS = {
    "javascript": r"(?:from|require\(|import)\s*[\"']([^\"']+)[\"']", "typescript": r"(?:from|require\(|import)\s*[\"']([^\"']+)[\"']",
    "java": r"^import\s+(?:static\s+)?([\w.]+)", "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$", "c": r"^\s*#\s*include\s*[<\"]([^>\"]+)", "cpp": r"^\s*#\s*include\s*[<\"]([^>\"]+)", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
}
#: The name of a class and what stands between it and its body; words there that are no bases.
BASES = {k: rf"(?<![\w.$]){word}\s+(?!extends\b|implements\b){_NAME}([^{{;]*)\{{" for k, word in (("javascript", "class"), ("typescript", "class"), ("java", "(?:class|enum|record)"), ("cpp", "(?:class|struct)"))}
_NO_BASE = frozenset("public private protected virtual final".split())
GENERIC = [("class", rf"^\s*(?:\w+\s+)*(?:class|struct|trait|interface|module)\s+{_NAME}"), ("function", rf"^\s*(?:\w+\s+)*(?:def|func|fun|function|sub|fn)\s+{_NAME}")]
_CALL = re.compile(r"(?<![\w.$])((?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*)\s*\(")
_NO_CALL = frozenset("if for while switch catch return function sizeof match fn func def class new typeof await and or not in elif with print assert lambda".split())
_STRINGS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|//[^\n]*|/\*.*?\*/", re.S)

_CHARS = re.compile(_STRINGS.pattern.replace(r"'(?:[^'\\\n]|\\.)*'", r"'(?:[^'\\\n]|\\.[^'\n]*)'"), re.S)  # an apostrophe alone is a lifetime
_JS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*.*?(?:\*/|\Z)|[`{}/]", re.S)
_TEMPLATE, _REGEX = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{)|\\\Z)*(?:`|\$\{|\Z)", re.S), re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?<![\w$.])(?:return|typeof|case|in|of|do|else|void|delete|throw|new|await|yield)\Z")

SYMBOL = pa.struct([("kind", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("signature", pa.string())])
REF = pa.struct([("kind", pa.string()), ("source", pa.string()), ("target_name", pa.string())])
SCHEMA = "repo string, path string, parse_error boolean, symbols array<struct<kind:string,name:string,qualified_name:string,line_start:int,line_end:int,signature:string>>, refs array<struct<kind:string,source:string,target_name:string>>"


def _python(text: str, module: str) -> tuple[list, list]:
    syms, refs, lines = [], [], text.split("\n")

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            head = dotted(node.value)
            return f"{head}.{node.attr}" if head else node.attr
        return None

    def walk(node: ast.AST, scope: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                cls = isinstance(child, ast.ClassDef)
                kind, qname = "class" if cls else "method" if in_class else "function", f"{scope}.{child.name}"
                syms.append((kind, child.name, qname, child.lineno, child.end_lineno, lines[child.lineno - 1].strip()))
                if cls:
                    refs.extend(("inherits", qname, d) for d in map(dotted, child.bases) if d)
                walk(child, qname, cls)
                continue
            if isinstance(child, ast.Import):
                refs.extend(("imports", module, a.name.split(".")[0]) for a in child.names)
            elif isinstance(child, ast.ImportFrom) and child.module:
                refs.append(("imports", module, child.module.split(".")[0]))
            elif isinstance(child, ast.Call) and (d := dotted(child.func)):
                refs.append(("calls", scope, d))
            walk(child, scope, in_class and isinstance(child, ast.If | ast.Try | ast.With))

    walk(ast.parse(text), module, False)
    return syms, refs


_PY_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)(?:[ \t]*\(([^()]*)\))?")
_PY_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+([A-Za-z_][\w.]*)[ \t]+import\b|import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*))")
_PY_STRINGS = re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|\"(?:[^\"\\\n]|\\.)*\"|\'(?:[^\'\\\n]|\\.)*\'|#[^\n]*", re.S)


def _indented(text: str, module: str) -> tuple[list, list]:
    """Symbols and references of Python that doesn't parse: heads by line, spans by indent."""
    lines, plain = text.split("\n"), _PY_STRINGS.sub(lambda m: _blank(m[0]), text).split("\n")
    syms, refs, open_ = [], [], []  # open_: indent, qualified name, is class, place in syms
    last = 0
    for k, line in enumerate(plain, 1):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and open_[-1][0] >= indent:
            syms[open_.pop()[3]][4] = last
        last = k
        scope = open_[-1][1] if open_ else module
        if m := _PY_HEAD.match(line):
            cls = m[2] == "class"
            syms.append(["class" if cls else "method" if open_ and open_[-1][2] else "function", m[3], f"{scope}.{m[3]}", k, k, lines[k - 1].strip()])
            open_.append((indent, f"{scope}.{m[3]}", cls, len(syms) - 1))
            if cls:
                refs += [("inherits", f"{scope}.{m[3]}", b.strip()) for b in (m[4] or "").split(",") if re.fullmatch(r"[A-Za-z_][\w.]*", b.strip())]
            line = line[m.end() :]
        elif m := _PY_IMPORT.match(line):
            refs += [("imports", module, x.split()[0].split(".")[0]) for x in (m[1] or m[2]).split(",")]
            continue
        refs += [("calls", open_[-1][1] if open_ else module, m[1]) for m in _CALL.finditer(line) if m[1] not in _NO_CALL]
    for _, _, _, at in open_:
        syms[at][4] = last
    return [tuple(x) for x in syms], refs


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _bare(text: str, lang: str) -> str:
    """The text with blanks in place of strings and comments; in JavaScript of regular expressions and templates, but not the code in them, too."""
    if lang not in ("javascript", "typescript"):
        return (_CHARS if lang == "rust" else _STRINGS).sub(lambda m: _blank(m[0]), text)
    out, at, depths, inside = [], 0, [], False  # the depths of braces in the ${ } that are open
    while at < len(text):
        if inside:  # a template
            m = _TEMPLATE.match(text, at)
            out.append(_blank(m[0]))
            at, inside = m.end(), False
            if m[0].endswith("${"):
                depths.append(0)
            continue
        m = _JS.search(text, at)
        if not m:
            break
        out.append(text[at : m.start()])
        token, at = m[0], m.end()
        if token == "/":
            before = text[max(0, m.start() - 40) : m.start()].rstrip()
            x = _REGEX.match(text, m.start()) if not before or before[-1] in "(,=:[!&|?{};+-*%<>~^" or _BEFORE_REGEX.search(before) else None
            at = x.end() if x else at
            out.append(_blank(x[0]) if x else token)
        elif token == "`":
            out.append(" ")
            inside = True
        elif token in "{}":
            if depths and token == "}" and depths[-1] == 0:
                depths.pop()
                out.append(" ")
                inside = True
            else:
                if depths:
                    depths[-1] += 1 if token == "{" else -1
                out.append(token)
        else:
            out.append(_blank(token))
    return "".join([*out, text[at:]])


def _end(lines: list[str], start: int) -> int:
    """The line on which the braces opened from start on are closed."""
    depth, opened = 0, False
    for k in range(start, len(lines)):
        depth += lines[k].count("{") - lines[k].count("}")
        opened = opened or "{" in lines[k]
        if opened and depth <= 0:
            return k + 1
        if not opened and lines[k].rstrip().endswith(";"):
            return k + 1
    return len(lines)


def _end_of_statement(lines: list[str], start: int) -> int:
    """The line on which a statement ends that has no body of its own: brackets are closed and no operator goes on."""
    depth = 0
    for k in range(start, len(lines)):
        depth += sum((c in "({[") - (c in ")}]") for c in lines[k])
        line, after = lines[k].rstrip(), next((x.strip() for x in lines[k + 1 :] if x.strip()), "")
        if depth <= 0 and (line.endswith(";") or not (line.endswith(("=", "|", "&", "?", ":", ",", "=>")) or not line.strip() or after.startswith(("|", "&", "?", ":", "=", ".")))):
            return k + 1
    return len(lines)


def _grouped(bare: str) -> list[tuple[int, int, str]]:
    """Start, end and name of every type in Go's ``type ( ... )``."""
    out = []
    for m in re.finditer(r"^type\s*\(", bare, re.M):
        depth, begin, at = 0, m.end(), m.end()
        while at < len(bare) and depth >= 0:
            c = bare[at]
            depth += (c in "({[") - (c in ")}]")
            if depth < 0 or (depth == 0 and c in "\n;"):
                if x := re.match(rf"\s*{_NAME}\b\s*(?:\[[^\]\n]+\]\s*)?(?!\s*=)\S", bare[begin:at]):
                    out.append((begin + x.start(1), begin + x.end(1), x[1]))
                begin = at + 1
            at += 1
    return out


def _bases(clause: str, lang: str) -> list[str]:
    """The names in what follows the name of a class, without type arguments."""
    before = None
    while before != clause:
        before, clause = clause, re.sub(r"<[^<>]*>|\([^()]*\)", " ", clause)
    if lang == "cpp":
        lists = [clause.partition(":")[2]]
    else:
        lists = re.split(r"\b(?:extends|implements)\b", clause.partition(" permits ")[0])[1:]
    words = [[w for w in re.findall(r"[\w.$:]+", x) if w not in _NO_BASE] for names in lists for x in names.split(",")]
    return [w[0] for w in words if w]


def _braced(text: str, module: str, lang: str) -> tuple[list, list]:
    lines, found, heads = text.split("\n"), [], []
    bare = _bare(text, lang)
    plain = bare.split("\n")
    for kind, pattern in DEFINITIONS.get(lang, GENERIC):
        for m in re.finditer(pattern, bare, re.M):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            found.append((start, m.end(), kind, m[m.lastindex]))
    if lang == "go":
        found += [(a, b, "class", name) for a, b, name in _grouped(bare)]
    breaks = [m.start() for m in re.finditer("\n", bare)]
    classes = {x[3] for x in found if x[2] == "class"}
    spans, seen = [], set()
    for start, end, kind, name in sorted(found, key=lambda x: (bisect.bisect_left(breaks, x[0]), x[2] != "class", x[2] == "constructor", x[2], x[0])):
        at = bisect.bisect_left(breaks, start)
        if kind == "constructor" and name.lstrip("~") not in classes:
            continue
        heads.append((start, end))
        if (at, name) not in seen:
            seen.add((at, name))
            rest = bare[end:].partition("\n")[0]
            alone = kind == "alias" or (lang == "go" and kind == "class" and "{" not in plain[at]) or (bare[start:end].endswith("=>") and not rest.lstrip().startswith("{"))
            kind = {"alias": "class", "constructor": "method"}.get(kind, kind)
            spans.append((at + 1, _end_of_statement(plain, at) if alone else _end(plain, at), kind, name))
    syms, open_ = [], []
    for a, b, kind, name in spans:
        open_ = [o for o in open_ if o[1] >= b and o[0] < a]
        owner = open_[-1] if open_ else None
        kind = "method" if kind == "function" and owner and owner[2] == "class" else kind
        qname = f"{owner[3] if owner else module}.{name}"
        syms.append((kind, name, qname, a, b, lines[a - 1].strip()))
        open_.append((a, b, kind, qname))
    if lang not in DEFINITIONS:
        return syms, []
    refs = [("imports", module, m[1]) for m in re.finditer(IMPORTS[lang], text, re.M)]
    named = {s[1]: s[2] for s in syms}
    named |= {s[1]: s[2] for s in syms if s[0] == "class"}
    refs += [("inherits", named.get(m[1], module), x) for m in re.finditer(BASES[lang], bare) for x in _bases(m[2], lang)] if lang in BASES else []
    parts, done = [], 0
    for a, b in sorted(heads):  # what a definition's own name and parameters look like is no call
        parts += [bare[done:a], _blank(bare[max(a, done) : b])]
        done = max(done, b)
    owner = [module] * (len(lines) + 2)  # of each line, the innermost definition: later spans lie in earlier ones
    for _, _, qname, a, b, _ in syms:
        owner[a : b + 1] = [qname] * (b + 1 - a)
    for k, line in enumerate("".join([*parts, bare[done:]]).split("\n"), 1):
        refs += [("calls", owner[k], m[1]) for m in _CALL.finditer(line) if m[1] not in _NO_CALL]
    return syms, refs


def extract(lang: str | None, content: bytes | None, path: str) -> tuple[bool, list, list]:
    """Whether the file could not be read as its language, its symbols and its references."""
    if lang is None or content is None:
        return False, [], []
    module = re.sub(r"\.[^./]*$", "", path).replace("/", ".")
    try:
        text = content.decode("utf-8", "replace").removeprefix("\ufeff").replace("\r\n", "\n")
        syms, refs = _python(text, module) if lang == "python" else _braced(text, module, lang)
        return False, syms, refs
    except (SyntaxError, ValueError, RecursionError):
        return True, *(_indented(text, module) if lang == "python" else ([], []))


def extracted(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """repo, path, parse_error, symbols, refs (and columns to keep) of every file (repo, path, lang, content), where it is read.

    Python by its own syntax tree, or by heads and indents where it doesn't parse; other
    languages by patterns and braces; languages without patterns of their own give
    definitions only.  Qualified names are the dotted path and the chain of enclosing
    definitions; imports belong to the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [extract(lang, c, p or "") for lang, c, p in zip(b.column("lang").to_pylist(), b.column("content").to_pylist(), b.column("path").to_pylist())]
            syms = pa.array([[dict(zip(("kind", "name", "qualified_name", "line_start", "line_end", "signature"), s)) for s in r[1]] for r in rows], pa.list_(SYMBOL))
            refs = pa.array([[dict(zip(("kind", "source", "target_name"), x)) for x in r[2]] for r in rows], pa.list_(REF))
            yield pa.RecordBatch.from_arrays([b.column("repo"), b.column("path"), pa.array([r[0] for r in rows]), syms, refs, *(b.column(c) for c in keep)], ["repo", "path", "parse_error", "symbols", "refs", *keep])

    rows = files.select("repo", "path", "lang", "content", *keep)
    return rows.mapInArrow(run, ", ".join([SCHEMA, *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)]))


def current_symbols(scans: DataFrame) -> DataFrame:
    """repo, path, parse_error, symbols, refs of the current version of every scanned file.

    Every version is read where it lies, and only what was found in it is shuffled.
    """
    stamped = scans.withColumns({"modification_time": F.col("modification_time").cast("timestamp_ntz"), "tie": F.xxhash64("content")})
    found = extracted(stamped, ("modification_time", "tie")).dropna(subset=["repo", "path"])
    last = F.max(F.struct("modification_time", "tie", "parse_error", "symbols", "refs")).alias("v")
    return found.groupBy("repo", "path").agg(last).select("repo", "path", "v.parse_error", "v.symbols", "v.refs")
