"""Source text to token classes: one character per token, so that a grammar reads a plain string.

``classes(language, text)`` returns the class string and the tokens.  White space and
comments have no class.  A token that its language can't have has the class BAD.
"""

from __future__ import annotations

import re

BAD, END = "\x01", "\x00"

#: Operators of more than one character and their class.
OPERATORS = {
    "==": "E", "!=": "E", "===": "E", "!==": "E", "<=": "E", ">=": "E", "&&": "A", "||": "O", "??": "H", "<<": "S",
    "+=": "Q", "-=": "Q", "*=": "Q", "/=": "Q", "%=": "Q", "&=": "Q", "|=": "Q", "^=": "Q", "<<=": "Q", ">>=": "Q", ">>>=": "Q",
    "**=": "Q", "//=": "Q", "@=": "Q", "&&=": "Q", "||=": "Q", "??=": "Q", "&^=": "Q", "&^": "&",
    "=>": "F", "->": "R", "::": "D", "++": "U", "--": "U", "...": "V", "..": "W", "..=": "W", ":=": "L", "<-": "C", "**": "P", "?.": "N", "//": "/",
}

#: The reserved words of each language that its grammar tells apart.
WORDS = {
    "python": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "async await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new of return static switch throw try typeof var void while yield get set",
    "java": "assert break case catch class continue default do else enum extends finally for if implements import instanceof interface new package permits record return super switch throw throws try while yield",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "c": "break case continue default do else for goto if return sizeof switch while",
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while union",
}
WORDS["typescript"] = WORDS["javascript"] + " interface type enum namespace declare abstract readonly public private protected implements as satisfies keyof infer is asserts override"

#: Words that share a class. M is a modifier, T a type word, G a tag word.
SHARED = {
    "java": {"M": "public private protected static final abstract synchronized native transient volatile strictfp sealed non", "T": "int long short byte char boolean float double void var"},
    "c": {"M": "static extern const volatile inline register restrict typedef auto _Noreturn __inline __restrict", "T": "int char long short float double void unsigned signed _Bool", "G": "struct union enum"},
}

KEYWORD = {w: chr(0x100 + k) for k, w in enumerate(sorted({w for ws in WORDS.values() for w in ws.split()}))}
NAME_OF = {c: w for w, c in KEYWORD.items()}

_SLASHES = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
_QUOTED = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'"
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d[\d_]*)?)"
_TRIPLE = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""' + r"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
_HOLE = r"\{(?:[^{}\"'\n]|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}]*\})*\}"  # a format field, with strings of its own
_FORMAT = rf"(?:[fF][rR]?|[rR][fF])(?:\"(?!\"\")(?:[^\"\\\n{{]|\\[\s\S]|\{{\{{|{_HOLE})*\"|'(?!'')(?:[^'\\\n{{]|\\[\s\S]|\{{\{{|{_HOLE})*')"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{(?:[^{}]|\{[^{}]*\})*\})*\})*`"
_REGEX = r"(?:(?<=[=(,:\[!&|?{};>])|(?<=[=(,:\[!&|?{};>] )|(?<=return ))/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"

#: For each language: patterns of space and comments, of strings, and the suffix of numbers.
LEXICON = {
    "python": (r"#[^\n]*|\\\n", rf"(?:[rRbBfFuU]|[rR][bBfF]|[bBfF][rR])?(?:{_TRIPLE}|(?!\"\"\"|''')(?:{_QUOTED}|{_SINGLE}))", "[jJ]?"),
    "javascript": (_SLASHES, rf"{_QUOTED}|{_SINGLE}|{_TEMPLATE}|{_REGEX}", "n?"),
    "java": (_SLASHES, r'"""[ \t]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|(?!""")' + _QUOTED + r"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'", "[lLfFdD]?"),
    "go": (_SLASHES, rf"{_QUOTED}|{_SINGLE}|`[^`]*`", "i?"),
    "c": (_SLASHES + r"|\\\n|(?m:^[ \t]*#(?![#]))(?:[^\n\\/]|\\[\s\S]|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*", rf"(?:L|u8?|U)?(?:{_QUOTED}|{_SINGLE})", "[uUlLfF]*"),
    "rust": (_SLASHES, r"b?r(?:\"[^\"]*\"|#\"[\s\S]*?\"#|##\"[\s\S]*?\"##)|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'|'[^\W\d]\w*(?!')", r"(?:[iu](?:8|16|32|64|128|size)|f32|f64)?"),
}
LEXICON["typescript"] = LEXICON["javascript"]


def _table(language: str):
    skip, text, suffix = LEXICON[language]
    text = f"{_FORMAT}|{text}" if language == "python" else text
    digits = _NUMBER if language != "rust" else r"(?:0[xX][0-9a-fA-F_]+?|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)"
    fixed = {w: KEYWORD[w] for w in WORDS[language].split()} | {w: c for c, ws in SHARED.get(language, {}).items() for w in ws.split()}
    ops = {o: c for o, c in OPERATORS.items() if language in ("javascript", "typescript") or o not in ("===", "!==", "??", "?.", "??=", "&&=", "||=")}
    ops = {o: c for o, c in ops.items() if (o not in ("//", "//=", "@=") if language != "python" else o not in ("::", "--", "++", "&&", "||", "=>", "..", "..=", "<-", "&^", "&^=", ">>>="))}
    signs = "|".join(re.escape(o) for o in sorted(ops, key=len, reverse=True))
    # What is frequent stands first; a name isn't the prefix of a string.
    name = rf"[A-Za-z_]\w*+(?![\w\"'#$]|[^\x00-\x7f])[ \t]*+"
    soft = r"\n\s*+(?:match|case)\b(?=[ \t]*(?:[(\[{][ \t]*\n|[^\s=.,;)\]}:][^\n]*(?::|[(\[{,][ \t]*\n)))|" if language == "python" else ""
    marks = r"\n\s*+|[()\[\]{};,][()\[\]{};, \t]*+|[ \t\r\f]++" if language == "python" else r"[()\[\]{};,\s]++"
    name = r"type[ \t]+[A-Za-z_]\w*+(?=[ \t]*(?:\[[^\]\n]*\][ \t]*)?=(?!=))|" + name if language == "python" else name
    pattern = re.compile(rf"{soft}{name}|{marks}|(?:{skip})[ \t]*|(?:{text})[ \t]*|{digits}{suffix}(?!\w)[ \t]*|\d\w*|[^\W\d][\w$]*[ \t]*|[$@#]\w+[ \t]*|(?:{signs})[ \t]*|[\s\S]")
    quoted, number, word, hidden = re.compile(text), re.compile(digits + suffix), re.compile(r"[^\W\d]|\$"), re.compile(skip)
    plain = set("()[]{};,.:?=<>+-*/%&|^~!" + ("@" if language in ("python", "java", "typescript", "javascript", "rust") else "") + ("#" if language == "rust" else ""))
    if language == "python":
        plain -= set("?")

    class Table(dict):
        """The class of each token seen so far; bounded, as identifiers never end."""

        def __missing__(self, token: str) -> str:
            if len(self) > 200_000:
                self.clear()
            t = token.rstrip(" \t")
            if token[0] == "\n" and t[-1].isalpha():  # a line that may begin a match or case
                c = "\nX" if t.endswith("match") else "\nZ"
            elif token[0] in "()[]{};, \t\r\f\n":  # a run of marks and space: the marks, with line ends where they count
                c = "".join(x for x in token if x in "()[]{};,\n")
                c = re.sub("\n+", "\n" if language in ("python", "javascript", "typescript", "go") else "", c)
            elif hidden.fullmatch(token) or hidden.fullmatch(t):
                c = "\n" if "\n" in t and language in ("javascript", "typescript", "go") and t[:2] == "/*" else ""
            elif quoted.fullmatch(t) or t[0] == "/" and len(t) > 2 and language in ("javascript", "typescript"):
                c = "l" if language == "rust" and t[0] == "'" and t[-1] != "'" else "s"
            elif t.startswith(("type ", "type\t")) and language == "python":
                c = "Yi"  # the start of a type statement
            elif t in fixed:
                c = fixed[t]
            elif t in ops:
                c = ops[t]
            elif number.fullmatch(t):
                c = BAD if language == "python" and re.fullmatch(r"0\d*[1-9]\d*", t) else "n"
            elif word.match(t) or language in ("javascript", "typescript") and t[0] == "#" and len(t) > 1:
                c = "i"
            elif t[0] == "@" and len(t) > 1 and "@" in plain:
                c = "@" + self[t[1:]]
            elif t[0] == "#" and "#" in plain:
                c = "#" if len(t) == 1 else "#" + self[t[1:]]
            else:
                c = t if t in plain else BAD
            self[token] = c
            return c

    return pattern, Table()


_TABLES: dict = {}


def classes(language: str, text: str) -> tuple[str, list[str]]:
    if language not in _TABLES:
        _TABLES[language] = _table(language)
    pattern, table = _TABLES[language]
    tokens = pattern.findall(text)
    return "".join(map(table.__getitem__, tokens)), tokens


def table_of(language: str) -> dict[str, str]:
    """The classes of the tokens of a language."""
    return _TABLES[language][1]


def lines_of(language: str, tokens: list[str], places: list[int]) -> list[int]:
    """The line of each place in the class string, places ascending."""
    table, out, line, seen, k = _TABLES[language][1], [], 1, 0, 0
    for t in tokens:
        c = table[t]
        while k < len(places) and places[k] < seen + len(c):
            out.append(line)
            k += 1
        seen += len(c)
        line += t.count("\n")
    return out + [line] * (len(places) - len(out))
