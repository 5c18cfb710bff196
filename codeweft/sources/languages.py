"""Which files belong to a graph, by name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix and language.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".go": "go", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".rs": "rust",
    ".rb": "ruby", ".php": "php", ".cs": "csharp", ".kt": "kotlin", ".swift": "swift", ".scala": "scala", ".lua": "lua", ".sh": "bash", ".bash": "bash",
    ".zsh": "bash", ".pl": "perl", ".r": "r", ".jl": "julia", ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".hs": "haskell", ".ml": "ocaml",
    ".dart": "dart", ".zig": "zig", ".sql": "sql",
}
#: Suffixes of texts without a language, folders and suffixes that are left out, suffixes to sniff.
TEXTS = [".md", ".rst", ".txt", ".yaml", ".yml", ".json", ".toml", ".ini", ".cfg", ".csv", ".xml", ".html", ".css", ".proto", ".graphql", ".tf", ".dockerfile", ".gitignore"]
FOLDERS = [".git", ".hg", ".svn", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", "dist", "build", ".idea", ".vscode", ".tox", "target", ".next", ".cache"]
LEFT_OUT = [".min.js", ".min.css", ".lock"]
SNIFFED = [".js", ".jsx", ".mjs", ".css", ".html"]
LARGEST, HEAD, LONGEST = 1_000_000, 8192, 2000


def suffix(path: Column) -> Column:
    """The last suffix of a file name in lower case; the whole name if it has none."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.rlike(r".\.[^.]+$"), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise(name)


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return table[suffix(path)]


def looks_minified(path: Column, content: Column) -> Column:
    """Web files with a line of more than LONGEST bytes among the first HEAD."""
    head = F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")
    return suffix(path).isin(*SNIFFED) & F.coalesce(F.exists(F.split(head, "\n"), lambda x: F.length(x) > LONGEST), F.lit(False))


def pattern_of(line: str) -> tuple[str, bool] | None:
    """An ignore pattern as a regular expression over paths (folders end in /), and whether it takes files back in."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    folder = line.endswith("/")
    body = line.strip("/") if not line.startswith("/") else line.rstrip("/")[1:]
    rooted = line.startswith("/") or "/" in body
    out, k = "", 0
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        elif body[k] == "[" and (end := body.find("]", k + 2)) > 0:
            inner = body[k + 1 : end]
            out, k = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            out, k = out + re.escape(body[k]), k + 1
    return ("^" if rooted else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), back


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether a path is left out by ignore patterns; the last that matches decides."""
    result = F.lit(False)
    for found in filter(None, map(pattern_of, lines)):
        result = F.when(path.rlike(found[0]), F.lit(not found[1])).otherwise(result)
    return result


def decision(path: Column, n_bytes: Column, ignore: list[str] = ()) -> Column:
    """Why a file is left out by name and size, or "kept"."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda x: x.startswith(".") | x.isin(*FOLDERS))
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    dropped = F.lit(False)
    for s in LEFT_OUT:
        dropped = dropped | name.endswith(s)
    known = language_of(path).isNotNull() | suffix(path).isin(*TEXTS)
    return (
        F.when(hidden, "folder").when(ignored(path, list(ignore)), "ignored").when(dropped, "suffix").when(~known, "kind").when(n_bytes > LARGEST, "size").otherwise("kept")
    )
