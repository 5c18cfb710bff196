"""Recursive-descent statements with precedence-climbing expressions over token classes.

``errors(language, text)`` gives every syntax error of a text as (line, cause), the first
cause first.  After an error the parser skips to the end of the statement (panic mode) and
goes on.  Statements, bracketed groups and heads that were accepted before are recognised
by their class string, as the same shapes come again all the time.
"""

from __future__ import annotations

import re
from functools import lru_cache

from codeweft.llm.lexing import BAD, END, KEYWORD, NAME_OF, classes, lines_of, table_of

K = KEYWORD
NAMES = {"i": "name", "n": "number", "s": "string", "\n": "end of line", END: "end of file", BAD: "invalid character", "Q": "assignment", "E": "comparison", "L": ":=", "F": "=>", "R": "->", "D": "::"}
_KEEP = 100_000


@lru_cache(None)
def kw(words: str) -> str:
    return "".join(K[w] for w in words.split())


class Bad(Exception):
    def __init__(self, place: int, cause: str):
        self.place, self.cause = place, cause


def group(inner: str, depth: int = 4) -> str:
    """A pattern of round brackets nested up to depth, with inner as what may stand between."""
    p = rf"\({inner}*\)"
    for _ in range(depth):
        p = rf"\({inner}*(?:{p}{inner}*)*\)"
    return p


PAREN = re.compile(group(r"[^;{}()]"))
PAREN_FOR = re.compile(group(r"[^{}()]"))
SIMPLE = re.compile(r"[^;{}]*(?:\{[^;{}]*\}[^;{}]*)*;")
HEAD = re.compile(r"[^;{}]*(?=\{)")


class Parser:
    """What all languages share: places, errors, panic mode, memory of shapes and binary operators."""

    language = ""
    #: Binary operators by class: the level each binds at.
    LEVELS = {"O": 1, "A": 2, "|": 3, "^": 4, "&": 5, "E": 6, "<": 7, ">": 7, "S": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "P": 11}
    PREFIX = "!-+~*&U"
    NOT_ALONE = ""  # statements that may go on behind their ";"

    seen: dict = {}

    def __init__(self, s: str):
        self.s, self.p, self.errors = s + END, 0, []

    # -- places
    def at(self, chars: str) -> bool:
        return self.s[self.p] in chars

    def eat(self, c: str) -> bool:
        if self.s[self.p] == c:
            self.p += 1
            return True
        return False

    def need(self, c: str) -> None:
        if self.s[self.p] != c:
            self.fail("expected " + NAMES.get(c, NAME_OF.get(c, c)))
        self.p += 1

    def fail(self, cause: str = ""):
        c = self.s[self.p]
        found = NAMES.get(c, NAME_OF.get(c, c))
        raise Bad(self.p, (cause + ", " if cause else "unexpected ") + (f"found {found}" if cause else found))

    def rx(self, pattern) -> bool:
        m = pattern.match(self.s, self.p)
        if m:
            self.p = m.end()
        return bool(m)

    # -- shapes accepted before
    def known(self, tag: str, pattern, rule) -> bool:
        """True if the text of pattern here is, as a whole, what rule accepts; then it is passed."""
        m = pattern.match(self.s, self.p)
        if not m:
            return False
        key = (self.language, tag, m.group())
        ok = self.seen.get(key)
        if ok is None:
            part = type(self)(m.group())
            try:
                rule(part)
                ok = part.p == len(part.s) - 1 and not part.errors
            except Bad:
                ok = False
            if len(self.seen) > _KEEP:
                self.seen.clear()
            self.seen[key] = ok
        if ok:
            self.p = m.end()
        return ok

    # -- statement lists with panic mode
    def listed(self, end: str, rule, tag: str) -> None:
        """Statements up to end, which isn't passed; an error inside costs one statement."""
        while not self.at(end):
            if self.at(END):
                self.fail(f"expected {NAMES.get(end, end)}")
            start = self.p
            if not self.at(self.NOT_ALONE) and self.known(tag, SIMPLE, rule):
                continue
            try:
                rule(self)
                if self.p == start:
                    self.fail()
            except Bad as e:
                self.errors.append((e.place, e.cause))
                self.p = max(e.place, start)
                self.panic(start)

    def panic(self, start: int) -> None:
        depth = 0
        while not self.at(END):
            c = self.s[self.p]
            if c == "}" and depth == 0:
                if self.p == start:
                    self.p += 1
                return
            depth += (c == "{") - (c == "}")
            self.p += 1
            if c in ";}" and depth == 0:
                return

    def block(self) -> None:
        self.need("{")
        self.listed("}", type(self).statement, "statement")
        self.need("}")

    def file(self) -> None:
        while True:
            self.listed_file()
            if self.at(END):
                return
            self.errors.append((self.p, "unmatched }"))
            self.p += 1

    def listed_file(self) -> None:
        start = self.p
        while not self.at(END) and not self.at("}"):
            start = self.p
            if not self.at(self.NOT_ALONE) and self.known("top", SIMPLE, type(self).top):
                continue
            try:
                self.top()
                if self.p == start:
                    self.fail()
            except Bad as e:
                self.errors.append((e.place, e.cause))
                self.p = max(e.place, start)
                self.panic(start)

    def top(self) -> None:
        self.statement()

    # -- expressions
    def binary(self, level: int = 1) -> None:
        """Precedence climbing: an operand, then operators that bind at level or tighter."""
        self.unary()
        while True:
            op = self.level()
            if op < level:
                return
            self.operator()
            self.binary(op + 1)

    def level(self) -> int:
        return self.LEVELS.get(self.s[self.p], 0)

    def operator(self) -> None:
        c = self.s[self.p]
        self.p += 1
        while c in "<>" and self.at(c):  # shifts are single marks, as generics need them
            self.p += 1

    def unary(self) -> None:
        while self.at(self.PREFIX):
            self.p += 1
        self.postfix()

    def items(self, end: str, rule, trailing: bool = True) -> None:
        """Rules with commas between, up to end, which is passed."""
        while not self.eat(end):
            rule()
            if not self.eat(","):
                self.need(end)
                return
            if not trailing and self.at(end):
                self.fail()

    def braces(self, a: str, b: str) -> None:
        """Balanced brackets with anything inside."""
        self.need(a)
        stack = [b]
        while stack:
            c = self.s[self.p]
            if c == END or c == BAD:
                self.fail(f"expected {stack[-1]}")
            if c in "([{":
                stack.append({"(": ")", "[": "]", "{": "}"}[c])
            elif c in ")]}" and c != stack.pop():
                self.fail("unmatched bracket")
            self.p += 1

    def condition(self) -> None:
        if not self.known("paren", PAREN, type(self).paren):
            self.paren()

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")


class CFamily(Parser):
    """C and Java: typed declarations, parenthesised conditions."""

    TYPE = DECL = CAST = None

    def expression(self) -> None:
        self.assigned()
        while self.eat(","):
            self.assigned()

    def assigned(self) -> None:
        self.binary()
        if self.eat("?"):
            self.expression()
            self.need(":")
            self.assigned()
        elif self.at("=Q"):
            self.p += 1
            self.assigned()

    def semi(self) -> None:
        self.need(";")

    def controlled(self, c: str) -> bool:
        """Statements that both languages have."""
        if c == K["if"]:
            self.p += 1
            self.condition()
            self.statement()
            if self.eat(K["else"]):
                self.statement()
        elif c == K["while"] or c == K["switch"]:
            self.p += 1
            self.condition()
            self.statement() if c == K["while"] else self.switch()
        elif c == K["for"]:
            self.p += 1
            if not self.known("for", PAREN_FOR, type(self).for_head):
                self.for_head()
            self.statement()
        elif c == K["do"]:
            self.p += 1
            self.statement()
            self.need(K["while"])
            self.condition()
            self.semi()
        elif c == K["return"]:
            self.p += 1
            if not self.at(";"):
                self.expression()
            self.semi()
        elif c == K["break"] or c == K["continue"]:
            self.p += 1
            self.eat("i")
            self.semi()
        elif c == "{":
            self.block()
        elif c == ";":
            self.p += 1
        elif c == "i" and self.s[self.p + 1] == ":":
            self.p += 2
            if not self.at("}"):
                self.statement()
        else:
            return False
        return True

    def switch(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement()

    def for_head(self) -> None:
        self.need("(")
        if not self.eat(";"):
            if self.rx(self.EACH):
                self.expression()
                self.need(")")
                return
            self.simple()
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")

    EACH = re.compile(r"(?!)")


class C(CFamily):
    language = "c"
    NOT_ALONE = kw("if do else for while switch")
    PREFIX = "!-+~*&U" + K["sizeof"]
    TYPE = re.compile(r"M*(?:T[MT]*|Gi|i)[M*]*")
    DECL = re.compile(r"M+(?:T[MT]*|Gi?|i)?[M*]*|(?:T[MT]*|Gi?)[M*]*|i[M*]*(?=i[=;,\[(:)]|i\Z)|i(?=\(\*+i\)\()")
    CAST = re.compile(r"\((?:M*(?:T[MT]*|Gi)[M*]*(?:\(\*+\)\([^()]*\))?(?:\[\])?|M*i[M*]*\*|M+i[M*]*|i(?=\)[ins]))\)")
    ALONE = re.compile(r"i" + group(r"[^;{}()]") + r"(?![;=.,\[(R])")

    def top(self) -> None:
        if self.eat(";"):
            return
        self.declaration(True)

    def statement(self) -> None:
        c = self.s[self.p]
        if self.controlled(c):
            return
        if c == K["case"]:
            self.p += 1
            self.binary()
            if self.eat("V"):
                self.binary()
            self.need(":")
        elif c == K["default"]:
            self.p += 1
            self.need(":")
        elif c == K["goto"]:
            self.p += 1
            self.need("i")
            self.semi()
        else:
            self.simple()

    def simple(self) -> None:
        if self.DECL.match(self.s, self.p):
            self.declaration(False)
        else:
            self.expression()
            self.semi()

    def declaration(self, outside: bool) -> None:
        start = self.p
        if not self.rx(self.DECL) and not (outside and self.rx(re.compile(r"i[M*]*"))):
            self.fail()
        if self.at("{"):
            tag = "Gi" if self.s[self.p - 1] == "i" else "G"
            self.enum() if self.s[self.p - len(tag)] == "G" and self.enumerated() else self.fields()
            self.rx(re.compile(r"[M*]+"))
        if self.eat(";"):
            return
        if not self.at("i(*"):
            if outside and self.s[self.p - 1] == "i" and self.at("("):
                pass
            elif not (self.p > start + 1 and self.s[self.p - 1] == "i"):
                self.fail("expected a declarator")
            else:
                self.p -= 1
        while True:
            self.declarator()
            if self.at("{") and outside:
                self.block()
                return
            if self.eat(":"):
                self.binary()
            if self.eat("="):
                self.initial()
            if not self.eat(","):
                break
        self.semi()

    def enumerated(self) -> bool:
        """An enum body has names and commas where a struct has fields; empty counts as either."""
        return bool(re.compile(r"\{i[,}=]").match(self.s, self.p))

    def enum(self) -> None:
        self.need("{")
        self.items("}", self.enumerator)

    def enumerator(self) -> None:
        self.need("i")
        if self.eat("="):
            self.binary()

    def fields(self) -> None:
        self.need("{")
        self.listed("}", lambda q: q.declaration(False), "field")
        self.need("}")

    def declarator(self) -> None:
        self.rx(re.compile(r"[M*]*"))
        if self.eat("("):
            self.declarator()
            self.need(")")
        elif not self.eat("i"):
            if self.at("["):
                pass
            elif not self.at("),"):
                self.fail("expected a name")
        while self.at("(["):
            if self.at("("):
                self.params()
            else:
                self.p += 1
                self.rx(re.compile("M*"))
                if not self.at("]"):
                    self.assigned()
                self.need("]")

    def params(self) -> None:
        self.need("(")
        self.items(")", self.param, False)

    def param(self) -> None:
        if self.eat("V"):
            return
        if not self.rx(self.TYPE):
            self.fail("expected a parameter")
        if not self.at(",)"):
            self.declarator()

    def initial(self) -> None:
        if self.eat("{"):
            self.items("}", self.element)
        else:
            self.assigned()

    def element(self) -> None:
        named = False
        while self.at(".["):
            named = True
            if self.eat("."):
                self.need("i")
            else:
                self.p += 1
                self.binary()
                self.need("]")
        if named:
            self.need("=")
        self.initial()

    def unary(self) -> None:
        while True:
            if self.at(self.PREFIX):
                self.p += 1
                if self.s[self.p - 1] == K["sizeof"] and self.rx(re.compile(r"\(M*(?:T[MT]*|Gi|i)[M*]*\)")):
                    break
            elif self.rx(self.CAST):
                if self.at("{"):
                    self.initial()
                    break
            else:
                self.postfix()
                return
        else:
            return
        self.after()

    def postfix(self) -> None:
        if self.at("s"):
            while self.at("s") or self.at("i") and self.s[self.p + 1] == "s":
                self.p += 1
        elif self.at("in"):
            self.p += 1
            if self.at("s") and self.s[self.p - 1] == "i":  # a macro between strings
                while self.at("si"):
                    self.p += 1
        elif self.at("("):
            if self.s[self.p + 1] == "{":
                self.p += 1
                self.block()
                self.need(")")
            else:
                self.condition()
        else:
            self.fail("expected an expression")
        self.after()

    def after(self) -> None:
        while True:
            if self.at("("):
                self.p += 1
                self.items(")", self.argument, False)
            elif self.at("["):
                self.p += 1
                self.expression()
                self.need("]")
            elif self.at(".R"):
                self.p += 1
                self.need("i")
            elif self.at("U"):
                self.p += 1
            else:
                return

    def argument(self) -> None:
        if self.rx(re.compile(r"M*(?:T[MT]*|Gi)[M*]*(?=[,)])")):
            return
        self.assigned()


def _generic(depth: int = 3) -> str:
    """A pattern of type arguments nested up to depth."""
    inner = "<>"
    for _ in range(depth):
        one = rf"(?:@i)*(?:i(?:{inner})?(?:\.i(?:{inner})?)*|T)(?:\[\])*"
        arg = rf"(?:\?(?:[{kw('extends super')}]{one})?|{one}(?:{K['extends']}{one})?)(?:&{one})*"
        inner = rf"<(?:{arg}(?:,{arg})*)?>"
    return f"(?:{inner})"


_JG = _generic()


class Java(CFamily):
    language = "java"
    NOT_ALONE = kw("if do else for while switch try")
    TYPE = re.compile(rf"(?:@i(?:\.i)*)*(?:i{_JG}?(?:\.i{_JG}?)*|T)(?:\[\])*")
    DECL = re.compile(rf"(?:M|@i(?:\.i)*(?:{group('[^;()]')})?)*(?:i{_JG}?(?:\.i{_JG}?)*|T)(?:\[\])*(?=i[=;,:\[)])")
    EACH = re.compile(DECL.pattern + "i:")
    CAST = re.compile(rf"\((?:T(?:\[\])*\)(?=[-+ins(!~U{kw('new super switch')}])|i{_JG}?(?:\.i{_JG}?)*(?:\[\])*(?:&i{_JG}?)*\)(?=[ins(!~{kw('new super switch')}]))")
    GENERIC, OWNER = re.compile(_JG), re.compile(rf"{_JG}(?=D|\.)")
    CASE = re.compile(rf"M*{TYPE.pattern}i(?=[R:,&{K['if']}])")
    KIND = re.compile(rf"(?:M|@i)*[{kw('class interface enum record')}]")
    LAMBDA = re.compile(rf"(?:i|\((?:(?:M*(?:{TYPE.pattern})?V?i,?)*)\))R")
    NEW = re.compile(rf"(?:@i)*(?:i{_JG}?(?:\.i{_JG}?)*|T)")
    MODS = re.compile(rf"(?:M(?:-[iM{kw('permits')}])?|@i(?:\.i)*|{K['default']}(?!:|R))*")
    ANN = re.compile(group(r"[^;()]"))

    def mods(self) -> None:
        while True:
            p = self.p
            if self.at("M") or self.at(K["default"]) and self.s[self.p + 1] not in ":R":
                self.p += 1
                if self.eat("-"):
                    self.p += 1
            elif self.at("@") and self.s[self.p + 1] == "i":
                self.p += 2
                while self.at(".") and self.s[self.p + 1] == "i":
                    self.p += 2
                if self.at("("):
                    self.braces("(", ")")
            if self.p == p:
                return

    def typed(self) -> None:
        if not self.rx(self.TYPE):
            self.fail("expected a type")

    def types(self) -> None:
        self.typed()
        while self.eat(",") or self.eat("&"):
            self.typed()

    def top(self) -> None:
        if self.eat(";"):
            return
        if self.at(K["import"]):
            self.p += 1
            self.eat("M")
            if not self.rx(re.compile(r"i(?:\.i)*(?:\.\*)?;")):
                self.fail("expected an import")
            return
        self.mods()
        if self.at(K["package"]):
            self.p += 1
            if not self.rx(re.compile(r"i(?:\.i)*;")):
                self.fail("expected a package")
            return
        if not self.kind():
            self.fail("expected a class")

    def kind(self) -> bool:
        """A class, interface, enum, record or annotation, without its modifiers."""
        c = self.s[self.p]
        if c == "@" and self.s[self.p + 1] == K["interface"]:
            self.p += 1
        elif c == K["record"]:
            if not re.compile(rf"{c}i{_JG}?\(").match(self.s, self.p):
                return False
        elif c not in kw("class interface enum"):
            return False
        self.p += 1
        self.need("i")
        self.rx(self.GENERIC)
        if c == K["record"]:
            self.params()
        while self.at(kw("extends implements permits")):
            self.p += 1
            self.types()
        self.need("{")
        if c == K["enum"]:
            while self.at("i@"):
                self.mods()
                self.need("i")
                if self.at("("):
                    self.arguments()
                if self.at("{"):
                    self.members()
                if not self.eat(","):
                    break
            if not self.at("}"):
                self.need(";")
        self.listed("}", type(self).member, "member")
        self.need("}")
        return True

    def members(self) -> None:
        self.need("{")
        self.listed("}", type(self).member, "member")
        self.need("}")

    METHOD = re.compile(rf"(?:M|@i|{_JG})*(?:{TYPE.pattern})?i\([^;{{}}]*(?=\{{)")

    def member(self) -> None:
        if self.eat(";"):
            return
        if self.known("method", self.METHOD, type(self).method_head):
            self.block()
            return
        self.mods()
        if self.at("{"):
            self.block()
        elif not self.kind():
            self.rx(self.GENERIC)
            if self.rx(re.compile(r"i(?=\()")):
                self.method_rest()
            elif self.rx(re.compile(r"i(?=\{)")):
                self.block()
            else:
                self.typed()
                self.need("i")
                if self.at("("):
                    self.method_rest()
                else:
                    self.declarators()

    def method_head(self) -> None:
        self.mods()
        self.rx(self.GENERIC)
        if not self.rx(re.compile(r"i(?=\()")):
            self.typed()
            self.need("i")
        self.params()
        self.throws()

    def throws(self) -> None:
        self.rx(re.compile(r"(?:\[\])+"))
        if self.eat(K["throws"]):
            self.types()

    def method_rest(self) -> None:
        self.params()
        self.throws()
        if self.eat(K["default"]):
            self.element()
        if self.at("{"):
            self.block()
        else:
            self.semi()

    def params(self) -> None:
        self.need("(")
        self.items(")", self.param, False)

    def param(self) -> None:
        self.mods()
        self.typed()
        self.eat("V")
        if not self.eat(K["this"] if "this" in K else "i"):
            self.need("i")
        self.rx(re.compile(r"(?:\[\])+"))

    def declarators(self) -> None:
        while True:
            self.rx(re.compile(r"(?:\[\])+"))
            if self.eat("="):
                self.element()
            if not self.eat(","):
                break
            self.need("i")
        self.semi()

    def element(self) -> None:
        if self.eat("{"):
            self.items("}", self.element)
        else:
            self.assigned()

    def statement(self) -> None:
        c = self.s[self.p]
        if self.controlled(c):
            return
        if c in kw("throw"):
            self.p += 1
            self.expression()
            self.semi()
        elif c == K["yield"] and self.s[self.p + 1] not in "=.(":
            self.p += 1
            self.expression()
            self.semi()
        elif c == K["assert"]:
            self.p += 1
            self.expression()
            if self.eat(":"):
                self.expression()
            self.semi()
        elif c in kw("case default") and self.s[self.p] != END:
            self.label()
        elif c == K["try"]:
            self.tried()
        elif c == "M" and self.s[self.p + 1] == "(":
            self.p += 1
            self.condition()
            self.block()
        elif self.KIND.match(self.s, self.p) and not re.compile(rf"{K['record']}[^i]").match(self.s, self.p):
            self.mods()
            if not self.kind():
                self.fail()
        else:
            self.simple()

    def simple(self) -> None:
        if self.rx(self.DECL):
            self.need("i")
            self.declarators()
        else:
            start = self.p
            self.expression()
            part = self.s[start : self.p]
            if part[-1] not in ")U}" and part[0] != "U" and "=" not in part and "Q" not in part:
                self.fail("not a statement")
            self.semi()

    def label(self) -> None:
        if self.eat(K["default"]):
            pass
        else:
            self.p += 1
            while True:
                if self.rx(self.CASE) or self.eat(K["default"]):
                    pass
                else:
                    self.binary()
                if not self.eat(","):
                    break
            if self.at("i"):
                self.p += 1
                self.binary()
        if not self.eat("R"):
            self.need(":")
        elif self.at("{" + K["throw"]):
            self.statement()
        else:
            self.expression()
            self.semi()

    def tried(self) -> None:
        self.p += 1
        resources = self.at("(")
        if resources:
            self.p += 1
            while not self.eat(")"):
                if self.rx(self.DECL):
                    self.need("i")
                    self.need("=")
                self.expression()
                if not self.at(")"):
                    self.need(";")
        self.block()
        handled = resources
        while self.eat(K["catch"]):
            handled = True
            self.need("(")
            self.mods()
            self.typed()
            while self.eat("|"):
                self.typed()
            self.need("i")
            self.need(")")
            self.block()
        if self.eat(K["finally"]):
            self.block()
        elif not handled:
            self.fail("expected catch")

    def level(self) -> int:
        return 7 if self.at(K["instanceof"]) else self.LEVELS.get(self.s[self.p], 0)

    def binary(self, level: int = 1) -> None:
        self.unary()
        while True:
            op = self.level()
            if op < level or op == 0:
                return
            if self.eat(K["instanceof"]):
                self.eat("M")
                self.typed()
                self.eat("i")
                if self.at("("):
                    self.braces("(", ")")
                continue
            self.operator()
            self.binary(op + 1)

    def assigned(self) -> None:
        if self.rx(self.LAMBDA):
            self.block() if self.at("{") else self.assigned()
        else:
            super().assigned()

    def unary(self) -> None:
        while True:
            if self.at("!-+~U"):
                self.p += 1
            elif self.rx(self.CAST):
                if self.rx(self.LAMBDA):
                    self.block() if self.at("{") else self.assigned()
                    return
            else:
                self.postfix()
                return

    def arguments(self) -> None:
        self.need("(")
        self.items(")", self.assigned, False)

    def postfix(self) -> None:
        c = self.s[self.p]
        if c == "(":
            self.condition()
        elif c in "ins" + K["super"]:
            self.p += 1
        elif c == K["new"]:
            self.p += 1
            if not self.rx(self.NEW):
                self.fail("expected a type")
            if self.at("["):
                while self.eat("["):
                    if not self.at("]"):
                        self.expression()
                    self.need("]")
                if self.at("{"):
                    self.element()
            else:
                self.arguments()
                if self.at("{"):
                    self.members()
        elif c == K["switch"]:
            self.p += 1
            self.condition()
            self.switch()
        elif c == "T":
            self.p += 1
            self.rx(re.compile(r"(?:\[\])+"))
            if not self.at(".D"):
                self.fail("expected an expression")
        else:
            self.fail("expected an expression")
        while True:
            if self.at("("):
                self.arguments()
            elif self.at("["):
                self.p += 1
                if self.eat("]"):
                    self.rx(re.compile(r"(?:\[\])+"))
                    if not self.at(".D"):
                        self.fail("expected an index")
                    continue
                self.expression()
                self.need("]")
            elif self.at("."):
                self.p += 1
                self.rx(self.GENERIC)
                if self.at(K["new"]):
                    self.p += 1
                    self.rx(self.NEW)
                elif not self.at("i" + kw("class super record permits yield")):
                    self.fail("expected a name")
                else:
                    self.p += 1
            elif self.at("D"):
                self.p += 1
                self.rx(self.GENERIC)
                if not self.at("i" + K["new"]):
                    self.fail("expected a method")
                self.p += 1
            elif self.at("U"):
                self.p += 1
            elif self.at("<") and self.rx(self.OWNER):
                pass
            else:
                return


class Script(Parser):
    """JavaScript and TypeScript. Line ends stand in the class string only where a statement may end."""

    language = "javascript"
    typed = False
    SOFT = "i" + kw("async of get set static let yield await") + kw("type namespace declare abstract readonly public private protected implements as satisfies keyof infer is asserts override interface enum")
    NOT_ALONE = kw("if do else for while switch try")
    LEVELS = Parser.LEVELS | {"H": 1, K["in"]: 7, K["instanceof"]: 7}
    PREFIX = "!-+~U" + kw("typeof void delete await")
    OPEN = kw("typeof void delete await in instanceof")
    ARROW = re.compile(r"(?:" + f"[{SOFT}]" + "|" + group(r"[^;()]", 3) + r")F")

    def is_name(self, c: str) -> bool:
        return c in self.SOFT

    def is_word(self, c: str) -> bool:
        return c == "i" or c >= "Ā"

    def name(self) -> None:
        if not self.is_name(self.s[self.p]):
            self.fail("expected a name")
        self.p += 1

    def skip(self) -> None:
        while self.at("\n"):
            self.p += 1

    def semi(self) -> None:
        if self.eat(";") or self.at("}") or self.at(END):
            return
        if self.at("\n"):
            self.skip()
            return
        self.need(";")

    def listed(self, end: str, rule, tag: str) -> None:
        def one(q) -> None:
            rule(q)
            q.skip()

        super().listed(end, one, tag)

    def top(self) -> None:
        self.skip()
        if not self.at(END) and not self.at("}"):
            self.statement()
        self.skip()

    def expression(self) -> None:
        self.assigned()
        while self.eat(","):
            self.assigned()

    def assigned(self) -> None:
        self.eat(K["async"]) if self.at(K["async"]) and (self.is_name(self.s[self.p + 1]) or self.s[self.p + 1] in "(<") and self.arrow_at(self.p + 1) else None
        if self.arrow_at(self.p):
            self.arrow()
            return
        if self.at(K["yield"]) and self.s[self.p + 1] not in "=.,;)F":
            self.p += 1
            self.eat("*")
            if not self.at(")]},;\n" + END):
                self.assigned()
            return
        start = self.p
        self.binary()
        if self.at("?"):
            self.p += 1
            self.assigned()
            self.need(":")
            self.assigned()
        elif self.at("=Q"):
            if not self.target(start):
                self.fail("can't assign here")
            self.p += 1
            self.assigned()

    def target(self, start: int) -> bool:
        c, depth = self.s[self.p - 1], 0
        for x in self.s[start : self.p - (c == "!")]:
            depth += (x in "([{") - (x in ")]}")
            if depth == 0 and (x in "+-*/%&|^~!ESPAOH<>U" or x in self.OPEN):
                return c == ">" and self.typed
        return c in "]}" or self.is_word(c) or c in ")!>" and self.typed or c == ")" and self.s[start] == "("

    def arrow_at(self, p: int) -> bool:
        c = self.s[p]
        if c == "(":
            m = self.CLOSE.match(self.s, p)
            if not m:
                return False
            k = m.end()
            return self.s[k] == "F" or self.typed and self.s[k] == ":" and bool(self.RETURNS.match(self.s, k))
        return self.is_name(c) and self.s[p + 1] == "F" or self.typed and c == "<" and bool(re.compile(r"<[^;(]*>\(").match(self.s, p)) and ")" in self.s[p:]

    CLOSE = re.compile(group(r"[^()]", 5))
    RETURNS = re.compile(r":[^;(){}=]*(?:\{[^{}]*\})?[^;(){}=]*F")

    def arrow(self) -> None:
        if self.at("<"):
            self.angles()
        if self.at("("):
            self.params()
            if self.typed and self.eat(":"):
                self.type()
        else:
            self.name()
        self.need("F")
        self.skip()
        self.block() if self.at("{") else self.assigned()

    def binary(self, level: int = 1) -> str:
        """The logical operators met outside brackets come back, as ?? takes brackets beside || and &&."""
        self.unary()
        met = ""
        while True:
            if self.typed and self.at(kw("as satisfies")):
                self.p += 1
                self.eat(K["const"]) or self.type()
                continue
            op = self.level()
            if op < level or op == 0 or op == 7 and self.at(K["in"]) and self.no_in:
                return met
            if op <= 2:
                met += self.s[self.p]
            self.operator()
            self.skip()
            met += self.binary(op + 1)
            if "H" in met and ("O" in met or "A" in met):
                self.fail("?? beside || or && without brackets")

    no_in = False

    def postfix(self) -> None:
        c = self.s[self.p]
        if c in "nst":
            self.p += 1
        elif c == "(":
            if not self.known("paren", PAREN, type(self).paren):
                saved, self.no_in = self.no_in, False
                self.paren()
                self.no_in = saved
        elif c == "[":
            self.p += 1
            while not self.eat("]"):
                while self.eat(","):
                    pass
                if self.eat("]"):
                    break
                self.eat("V")
                self.assigned()
                if not self.at("]"):
                    self.need(",")
        elif c == "{":
            self.p += 1
            self.items("}", self.property)
        elif c == K["function"] or c == K["async"] and self.s[self.p + 1] == K["function"]:
            self.eat(K["async"])
            self.function(False)
        elif c == K["class"]:
            self.classed(False)
        elif c == K["new"]:
            self.p += 1
            if self.eat("."):
                self.need("i")
            else:
                self.unary()
                if self.typed and self.at("<"):
                    self.generic_call()
            return
        elif c == K["import"] and self.s[self.p + 1] in "(.":
            self.p += 1
        elif c == "<" and self.typed:
            self.angles()
            self.unary()
            return
        elif self.is_name(c):
            self.p += 1
        else:
            self.fail("expected an expression")
        self.after()

    def generic_call(self) -> bool:
        m = self.GENERIC.match(self.s, self.p)
        if m:
            self.p = m.end()
        return bool(m)

    GENERIC = re.compile(r"<[^;(){}=]*(?:\{[^{}]*\})?[^;(){}=]*>(?=[(s])")

    def after(self) -> None:
        while True:
            c = self.s[self.p]
            if c in ".N":
                self.p += 1
                if c == "N" and self.at("(["):
                    continue
                if not self.is_word(self.s[self.p]):
                    self.fail("expected a name")
                self.p += 1
            elif c == "(":
                self.p += 1
                self.items(")", self.argument)
            elif c == "[":
                self.p += 1
                self.expression()
                self.need("]")
            elif c == "s" and self.s[self.p - 1] != "s":
                self.p += 1
            elif c == "U":
                self.p += 1
                return
            elif c == "!" and self.typed and self.s[self.p + 1] in ".)]};,[(=\n?:" + "ASOE+-*/<>|&" + K["as"]:
                self.p += 1
            elif c == "<" and self.typed and self.generic_call():
                pass
            else:
                return

    def argument(self) -> None:
        self.skip()
        self.eat("V")
        self.assigned()
        self.skip()

    def key(self) -> None:
        if self.eat("["):
            self.assigned()
            self.need("]")
        elif self.at("sn") or self.is_word(self.s[self.p]):
            self.p += 1
        else:
            self.fail("expected a name")

    def property(self) -> None:
        self.skip()
        if self.eat("V"):
            self.assigned()
            self.skip()
            return
        while self.at(kw("get set async")) and (self.s[self.p + 1] in "[sn*" or self.is_word(self.s[self.p + 1])):
            self.p += 1
        self.eat("*")
        plain = self.is_name(self.s[self.p])
        self.key()
        if self.at("(<"):
            self.method()
        elif self.eat(":"):
            self.skip()
            self.assigned()
        elif not plain:
            self.need(":")
        elif self.eat("="):
            self.assigned()
        self.skip()

    def method(self) -> None:
        if self.typed and self.at("<"):
            self.angles()
        self.params()
        if self.typed and self.eat(":"):
            self.type()
        self.block()

    def function(self, named: bool) -> None:
        self.need(K["function"])
        self.eat("*")
        if named or self.is_name(self.s[self.p]):
            self.name()
        if self.known("signature", HEAD, type(self).signature):
            self.block()
            return
        self.signature()
        if self.typed and not self.at("{"):
            self.semi()
        else:
            self.block()

    def signature(self) -> None:
        if self.typed and self.at("<"):
            self.angles()
        self.params()
        if self.typed and self.eat(":"):
            self.type()

    def params(self) -> None:
        self.need("(")
        self.items(")", self.param)

    def param(self) -> None:
        self.skip()
        if self.typed:
            while self.at("@"):
                self.decorator()
            while self.at(kw("public private protected readonly override")) and self.is_name(self.s[self.p + 1]):
                self.p += 1
        self.eat("V")
        self.pattern()
        if self.typed:
            self.eat("?")
            if self.eat(":"):
                self.type()
        if self.eat("="):
            self.assigned()
        self.skip()

    def pattern(self) -> None:
        if self.at("[{"):
            self.postfix()
        elif self.typed and self.at(K["this"] if "this" in K else "i"):
            self.p += 1
        else:
            self.name()

    def classed(self, named: bool) -> None:
        self.need(K["class"])
        if self.is_name(self.s[self.p]) and not self.at(K["implements"]):
            self.p += 1
        elif named:
            self.fail("expected a name")
        if self.typed and self.at("<"):
            self.angles()
        if self.eat(K["extends"]):
            self.unary()
            if self.typed and self.at("<"):
                self.angles()
        if self.typed and self.eat(K["implements"]):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        self.listed("}", type(self).member, "member")
        self.need("}")

    def decorator(self) -> None:
        self.need("@")
        self.p += 1
        while self.eat("."):
            self.p += 1
        if self.at("("):
            self.braces("(", ")")
        self.skip()

    def member(self) -> None:
        self.skip()
        if self.eat(";") or self.at("}"):
            return
        while self.at("@"):
            self.decorator()
        if self.at(K["static"]) and self.s[self.p + 1] == "{":
            self.p += 1
            self.block()
            return
        mods = kw("static async get set") + (kw("public private protected readonly abstract override declare") if self.typed else "")
        while self.at(mods) and (self.s[self.p + 1] in "[sn*" or self.is_word(self.s[self.p + 1])):
            self.p += 1
        self.eat("*")
        if self.typed and self.at("[") and re.compile(r"\[i:[^\]]*\]:").match(self.s, self.p):
            self.braces("[", "]")
            self.need(":")
            self.type()
            self.semi()
            return
        self.key()
        if self.typed:
            self.eat("?") or self.eat("!")
        if self.at("(<"):
            if self.known("signature", HEAD, type(self).signature):
                self.block()
                return
            self.signature()
            if self.typed and not self.at("{"):
                self.semi()
            else:
                self.block()
            return
        if self.typed and self.eat(":"):
            self.type()
        if self.eat("="):
            self.assigned()
        self.semi()

    def binding(self, const: bool) -> None:
        while True:
            self.skip()
            start = self.p
            self.pattern()
            if self.typed:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.skip()
                self.assigned()
            elif (const or self.s[start] in "[{") and not self.at(K["of"] + K["in"]):
                self.fail("expected a value")
            self.skip() if self.at("\n") and self.s[self.p + 1] == "," else None
            if not self.eat(","):
                return

    def statement(self) -> None:
        self.skip()
        c = self.s[self.p]
        nxt = self.s[self.p + 1] if c != END else END
        if c == K["if"]:
            self.p += 1
            self.condition()
            self.skip()
            self.statement()
            k = self.p
            self.skip()
            if self.eat(K["else"]):
                self.statement()
            else:
                self.p = k
        elif c == K["while"]:
            self.p += 1
            self.condition()
            self.skip()
            self.statement()
        elif c == K["for"]:
            self.p += 1
            self.eat(K["await"])
            if not self.known("for", PAREN_FOR, type(self).for_head):
                self.for_head()
            self.skip()
            self.statement()
        elif c == K["do"]:
            self.p += 1
            self.statement()
            self.skip()
            self.need(K["while"])
            self.condition()
            self.eat(";")
        elif c == "{":
            self.block()
        elif c == ";":
            self.p += 1
        elif c in kw("const var") or c == K["let"] and (nxt in "[{" or self.is_name(nxt)):
            self.p += 1
            if self.typed and self.at(K["enum"]):
                self.enum()
                return
            self.binding(c == K["const"])
            self.semi()
        elif c == K["function"] or c == K["async"] and nxt == K["function"]:
            self.eat(K["async"])
            self.function(True)
        elif c == K["class"]:
            self.classed(True)
        elif c == "@":
            self.decorator()
            self.statement()
        elif c == K["return"] or c == K["throw"]:
            self.p += 1
            if not self.at(";}\n" + END):
                self.expression()
            elif c == K["throw"]:
                self.fail("expected an expression")
            self.semi()
        elif c in kw("break continue"):
            self.p += 1
            if self.is_name(self.s[self.p]):
                self.p += 1
            self.semi()
        elif c == K["debugger"]:
            self.p += 1
            self.semi()
        elif c == K["try"]:
            self.p += 1
            self.block()
            self.skip()
            handled = self.eat(K["catch"])
            if handled:
                if self.eat("("):
                    self.pattern()
                    if self.typed and self.eat(":"):
                        self.type()
                    self.need(")")
                self.block()
                self.skip()
            if self.eat(K["finally"]):
                self.block()
            elif not handled:
                self.fail("expected catch")
        elif c == K["switch"]:
            self.p += 1
            self.condition()
            self.need("{")
            self.skip()
            while not self.eat("}"):
                if self.eat(K["case"]):
                    self.expression()
                    self.need(":")
                elif self.eat(K["default"]):
                    self.need(":")
                else:
                    self.statement()
                self.skip()
        elif c == K["import"] and nxt not in "(.":
            self.imported()
        elif c == K["export"]:
            self.exported()
        elif self.is_name(c) and nxt == ":" and c not in kw("await yield"):
            self.p += 2
            self.statement()
        elif self.typed and self.declared(c, nxt):
            pass
        else:
            self.expression()
            self.semi()

    def for_head(self) -> None:
        self.need("(")
        if not self.eat(";"):
            c = self.s[self.p]
            self.no_in = True
            if c in kw("const let var"):
                self.p += 1
                self.binding(c == K["const"])
            else:
                self.expression()
            self.no_in = False
            if self.eat(K["of"]) or self.eat(K["in"]):
                self.expression()
                self.need(")")
                return
            self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")

    def spec(self) -> None:
        self.skip()
        if self.typed and self.at(K["type"]) and self.is_word(self.s[self.p + 1]):
            self.p += 1
        self.key()
        if self.eat(K["as"]) if self.typed else self.at("i") and self.eat("i"):
            self.key()
        self.skip()

    def imported(self) -> None:
        self.p += 1
        if not self.at("s"):
            if self.typed and self.at(K["type"]) and self.s[self.p + 1] in "{i*":
                self.p += 1
            if self.is_name(self.s[self.p]):
                self.p += 1
                if self.typed and self.eat("="):
                    self.expression()
                    self.semi()
                    return
                if not self.eat(","):
                    self.need("i")  # from
                    self.need("s")
                    self.semi()
                    return
            if self.eat("*"):
                self.p += 1
                self.name()
            else:
                self.need("{")
                self.items("}", self.spec)
            self.need("i")
        self.need("s")
        self.semi()

    def exported(self) -> None:
        self.p += 1
        if self.eat(K["default"]):
            if self.at(kw("function class async")):
                self.statement() if self.s[self.p + 1] not in "({" and not self.at(K["async"]) else (self.assigned(), self.semi())
            elif self.typed and self.at(kw("interface abstract")):
                self.statement()
            else:
                self.assigned()
                self.semi()
        elif self.at("{") or self.typed and self.at(K["type"]) and self.s[self.p + 1] == "{":
            self.eat(K["type"])
            self.need("{")
            self.items("}", self.spec)
            if self.eat("i"):
                self.need("s")
            self.semi()
        elif self.eat("*"):
            if not self.at("i") or self.s[self.p + 1] != "s":
                self.p += 1
                self.name()
            self.need("i")
            self.need("s")
            self.semi()
        elif self.typed and self.eat("="):
            self.expression()
            self.semi()
        elif self.at(kw("const let var function class async") + "@") or self.typed and self.at(kw("interface type enum namespace declare abstract import")):
            self.statement()
        else:
            self.fail("expected a declaration")

    def declared(self, c: str, nxt: str) -> bool:
        return False


class JavaScript(Script):
    SOFT = "i" + kw("async of get set static let yield await")


class TypeScript(Script):
    language = "typescript"
    typed = True

    def declared(self, c: str, nxt: str) -> bool:
        if c == K["interface"] and self.is_name(nxt):
            self.p += 2
            if self.at("<"):
                self.angles()
            if self.eat(K["extends"]):
                self.type()
                while self.eat(","):
                    self.type()
            self.object_type()
        elif c == K["type"] and self.is_name(nxt):
            self.p += 2
            if self.at("<"):
                self.angles()
            self.need("=")
            self.type()
            self.semi()
        elif c == K["enum"] and self.is_name(nxt):
            self.enum()
        elif c in kw("declare abstract") and self.is_word(nxt):
            self.p += 1
            self.statement()
        elif c == K["namespace"] and (self.is_name(nxt) or nxt == "s"):
            self.p += 2
            while self.eat("."):
                self.name()
            self.block()
        else:
            return False
        return True

    def enum(self) -> None:
        self.need(K["enum"])
        self.name()
        self.need("{")
        self.items("}", self.enumerator)

    def enumerator(self) -> None:
        self.skip()
        self.key()
        if self.eat("="):
            self.assigned()
        self.skip()

    def angles(self) -> None:
        """Type parameters or arguments."""
        self.need("<")
        while not self.eat(">"):
            self.eat(K["const"])
            self.type()
            if self.eat("="):
                self.type()
            if not self.eat(","):
                self.need(">")
                return

    def type(self) -> None:
        self.skip() if self.at("\n") and self.s[self.p + 1] in "|&" else None
        self.eat("|") or self.eat("&")
        self.type_unit()
        while True:
            if self.at("|&"):
                self.p += 1
                self.type_unit()
            elif self.eat(K["extends"]):
                self.type_unit()
                if self.eat("?"):
                    self.type()
                    self.need(":")
                    self.type()
            elif self.eat(K["is"]):
                self.type()
            else:
                return

    def type_unit(self) -> None:
        while self.at(kw("keyof readonly infer asserts typeof new abstract")) and (self.is_word(self.s[self.p + 1]) or self.s[self.p + 1] in "([{"):
            self.p += 1
        c = self.s[self.p]
        if c == "(" or c == "<":
            if c == "<":
                self.angles()
            m = self.CLOSE.match(self.s, self.p)
            if m and self.s[m.end()] == "F":
                self.params()
                self.need("F")
                self.type()
                return
            self.need("(")
            self.type()
            self.need(")")
        elif c == "{":
            self.object_type()
        elif c == "[":
            self.p += 1
            self.items("]", self.tuple_item)
        elif c == "-":
            self.p += 1
            self.need("n")
        elif c in "sn":
            self.p += 1
        elif self.is_name(c) or c in kw("void import const"):
            self.p += 1
            if c == K["import"]:
                self.braces("(", ")")
            while self.eat("."):
                self.p += 1
            if self.at("<"):
                self.angles()
        else:
            self.fail("expected a type")
        while self.at("["):
            self.p += 1
            if not self.at("]"):
                self.type()
            self.need("]")

    def tuple_item(self) -> None:
        self.eat("V")
        if self.is_name(self.s[self.p]) and self.s[self.p + 1] in ":?":
            self.p += 1
            self.eat("?")
            self.eat(":")
        if not self.at(",]"):
            self.type()

    def object_type(self) -> None:
        self.need("{")
        self.skip()
        while not self.eat("}"):
            while self.at(kw("readonly get set") + "+-") and (self.is_word(self.s[self.p + 1]) or self.s[self.p + 1] in "[sn"):
                self.p += 1
            if self.at("["):
                self.braces("[", "]")
            elif not self.at("(<"):
                self.key()
            self.eat("?") or self.eat("-") and self.eat("?")
            if self.at("(<"):
                self.signature()
            elif self.eat(":"):
                self.type()
            if self.at(",;\n"):
                self.p += 1
                self.skip()
            elif not self.at("}"):
                self.fail("expected ;")


class Go(Parser):
    language = "go"
    PREFIX = "!-+~*&^C"
    LEVELS = {"O": 1, "A": 2, "E": 3, "<": 3, ">": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "S": 5, "&": 5}
    NOT_ALONE = kw("if for switch select")
    COND = re.compile(r"[^{}]*?(?=\{)")
    literals = True

    def __init__(self, s: str):
        s = re.sub(rf"(?<=[ins)\]}}U{kw('return break continue fallthrough')}])\n", ";", s)
        super().__init__(s.replace("\n", ""))

    def top(self) -> None:
        c = self.s[self.p]
        if c == ";":
            self.p += 1
        elif c == K["package"]:
            self.p += 1
            self.need("i")
            self.semi()
        elif c == K["import"]:
            self.p += 1
            self.group(self.import_spec)
        elif c in kw("var const type"):
            self.statement()
        elif c == K["func"]:
            self.p += 1
            if not self.known("func", HEAD, type(self).func_head):
                self.func_head()
            if self.at("{"):
                self.block()
            self.semi()
        else:
            self.fail("expected a declaration")

    def file(self) -> None:
        while self.eat(";"):
            pass
        if not self.at(K["package"]) and not self.at(END):
            self.errors.append((self.p, "expected package"))
        super().file()

    def func_head(self) -> None:
        if self.at("("):
            self.params()
        self.need("i")
        if self.at("["):
            self.braces("[", "]")
        self.signature()

    def signature(self) -> None:
        self.params()
        if self.at("("):
            self.params()
        elif self.type_at():
            self.type()

    def params(self) -> None:
        self.need("(")
        self.items(")", self.param)

    def param(self) -> None:
        self.eat("V")
        self.type()
        if not self.at(",)"):
            self.eat("V")
            self.type()

    def type_at(self) -> bool:
        return self.at("i*([C" + kw("func map chan struct interface"))

    def type(self) -> None:
        c = self.s[self.p]
        if c in "*C":
            self.p += 1
            self.eat(K["chan"]) if c == "C" else None
            self.type()
        elif c == "i":
            self.p += 1
            if self.eat("."):
                self.need("i")
            if self.at("[") and re.compile(r"\[(?:[i*.,]|\[\]|" + K["map"] + r"\[i\])+\](?![in({\[])").match(self.s, self.p) and self.s[self.p + 1] != "]":
                self.braces("[", "]")
        elif c == "(":
            self.p += 1
            self.type()
            self.need(")")
        elif c == "[":
            self.p += 1
            if not self.eat("V") and not self.at("]"):
                self.binary()
            self.need("]")
            self.type()
        elif c == K["map"]:
            self.p += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif c == K["chan"]:
            self.p += 1
            self.eat("C")
            self.type()
        elif c == K["func"]:
            self.p += 1
            self.signature()
        elif c == K["struct"]:
            self.p += 1
            self.need("{")
            self.listed("}", type_rule("field"), "field")
            self.need("}")
        elif c == K["interface"]:
            self.p += 1
            self.need("{")
            self.listed("}", type_rule("method"), "method")
            self.need("}")
        else:
            self.fail("expected a type")

    def field(self) -> None:
        if self.eat(";"):
            return
        if self.at("*") or re.compile(r"i(?:\.i)?[s;}]").match(self.s, self.p):
            self.type()
        else:
            self.need("i")
            while self.eat(","):
                self.need("i")
            self.type()
        self.eat("s")
        self.semi()

    def method(self) -> None:
        if self.eat(";"):
            return
        if re.compile(r"i\(").match(self.s, self.p):
            self.p += 1
            self.signature()
        else:
            self.eat("~")
            self.type()
            while self.eat("|"):
                self.eat("~")
                self.type()
        self.semi()

    def semi(self) -> None:
        if not self.at("})" + END):
            self.need(";")

    def group(self, rule) -> None:
        if self.eat("("):
            while not self.eat(")"):
                rule()
                if not self.at(")"):
                    self.need(";")
        else:
            rule()
        self.semi()

    def import_spec(self) -> None:
        self.eat("i") or self.eat(".")
        self.need("s")

    def var_spec(self) -> None:
        self.need("i")
        while self.eat(","):
            self.need("i")
        if not self.at("=;)"):
            self.type()
        if self.eat("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need("i")
        if self.at("[") and re.compile(r"\[i[^\]]").match(self.s, self.p):
            self.braces("[", "]")
        self.eat("=")
        self.type()

    def expressions(self) -> None:
        self.binary()
        while self.eat(","):
            self.binary()

    def statement(self) -> None:
        c = self.s[self.p]
        if c == ";":
            self.p += 1
            return
        if c in kw("var const"):
            self.p += 1
            self.group(self.var_spec)
            return
        if c == K["type"]:
            self.p += 1
            self.group(self.type_spec)
            return
        if c == "{":
            self.block()
        elif c == K["if"]:
            self.branch()
        elif c == K["for"]:
            self.p += 1
            if not self.known("for", self.COND, type(self).for_head):
                self.for_head()
            self.block()
        elif c in kw("switch select"):
            self.p += 1
            if not self.at("{"):
                self.head()
            self.need("{")
            while not self.eat("}"):
                if self.eat(K["case"]):
                    self.types = True
                    self.simple() if c == K["select"] else self.cases()
                    self.need(":")
                elif self.eat(K["default"]):
                    self.need(":")
                elif self.at(END):
                    self.fail("expected }")
                else:
                    self.statement()
        elif c in kw("return"):
            self.p += 1
            if not self.at(";}"):
                self.expressions()
        elif c in kw("break continue goto fallthrough"):
            self.p += 1
            self.eat("i")
        elif c in kw("go defer"):
            self.p += 1
            self.binary()
        elif c == "i" and self.s[self.p + 1] == ":":
            self.p += 2
            if not self.at("}"):
                self.statement()
            return
        else:
            self.simple()
        self.semi()

    def cases(self) -> None:
        self.case()
        while self.eat(","):
            self.case()

    def case(self) -> None:
        if self.at("*[" + kw("map chan func struct interface")):
            self.type()
        else:
            self.binary()

    def branch(self) -> None:
        self.need(K["if"])
        if not self.known("if", self.COND, Go.test):
            self.test()
        self.block()
        if self.eat(K["else"]):
            self.branch() if self.at(K["if"]) else self.block()

    def test(self) -> None:
        self.head()
        if self.s[self.p - 1] == ";":
            self.fail("expected a condition")

    def head(self) -> None:
        saved, self.literals = self.literals, False
        if not self.at(";"):
            self.simple()
        if self.eat(";") and not self.at("{"):
            self.simple()
        self.literals = saved

    def for_head(self) -> None:
        saved, self.literals = self.literals, False
        if not self.at("{" + END):
            if self.eat(K["range"]):
                self.binary()
            else:
                if not self.at(";"):
                    self.simple()
                if self.eat(";"):
                    if not self.at(";"):
                        self.binary()
                    if self.eat(";") and not self.at("{" + END):
                        self.simple()
        self.literals = saved

    def simple(self) -> None:
        self.expressions()
        if self.at("L=Q"):
            self.p += 1
            if self.eat(K["range"]):
                self.binary()
            else:
                self.expressions()
        elif self.at("U"):
            self.p += 1
        elif self.eat("C"):
            self.binary()

    def postfix(self) -> None:
        c = self.s[self.p]
        if c in "ns":
            self.p += 1
        elif c == "i":
            self.p += 1
            if self.literals and re.compile(r"(?:\.i)?(?:\[[i,.*\[\]]+\])?\{").match(self.s, self.p):
                self.rx(re.compile(r"(?:\.i)?(?:\[[i,.*\[\]]+\])?"))
                self.literal()
        elif c == "(":
            self.p += 1
            saved, self.literals = self.literals, True
            self.case()
            self.literals = saved
            self.need(")")
        elif c == K["func"]:
            self.p += 1
            self.signature()
            if self.at("{"):
                saved, self.literals = self.literals, True
                self.block()
                self.literals = saved
        elif c in "[" + kw("map chan struct interface"):
            self.type()
            if self.at("{"):
                self.literal()
            elif not self.at("(),"):
                self.fail("expected a value")
        else:
            self.fail("expected an expression")
        while True:
            c = self.s[self.p]
            if c == ".":
                self.p += 1
                if self.eat("("):
                    self.eat(K["type"]) or self.type()
                    self.need(")")
                else:
                    self.need("i")
            elif c == "(":
                self.p += 1
                saved, self.literals = self.literals, True
                self.items(")", self.argument)
                self.literals = saved
            elif c == "[":
                self.p += 1
                saved, self.literals = self.literals, True
                while not self.eat("]"):
                    if not self.eat(":") and not self.eat(","):
                        self.case()
                self.literals = saved
            else:
                return

    def argument(self) -> None:
        self.case()
        self.eat("V")

    def literal(self) -> None:
        self.need("{")
        saved, self.literals = self.literals, True
        self.items("}", self.element)
        self.literals = saved

    def element(self) -> None:
        self.literal() if self.at("{") else self.binary()
        if self.eat(":"):
            self.literal() if self.at("{") else self.binary()


def type_rule(name: str):
    return lambda q: getattr(q, name)()


class Rust(Parser):
    language = "rust"
    PREFIX = "!-*"
    LEVELS = {"=": 1, "Q": 1, "W": 2, "O": 3, "A": 4, "E": 5, "<": 5, ">": 5, "|": 6, "^": 7, "&": 8, "S": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, K["as"]: 12}
    NOT_ALONE = kw("if while for loop match unsafe fn impl struct enum trait mod pub")
    COND = re.compile(r"[^;{}]*(?=\{)")
    PATHS = "i" + kw("crate union")
    literals = True

    def attributes(self) -> None:
        while self.at("#"):
            self.p += 1
            self.eat("!")
            self.braces("[", "]")

    def top(self) -> None:
        self.attributes()
        if self.at(END) or self.at("}"):
            return
        if not self.item():
            self.fail("expected an item")

    def item(self) -> bool:
        """An item with its visibility; False, without moving, where none begins."""
        start = self.p
        if self.eat(K["pub"]) and self.at("("):
            self.braces("(", ")")
        c, nxt = self.s[self.p], self.s[min(self.p + 1, len(self.s) - 1)]
        if c == K["use"]:
            self.p += 1
            self.used()
            self.need(";")
        elif c == K["extern"] and nxt == K["crate"]:
            self.p += 2
            self.need("i")
            if self.eat(K["as"]):
                self.need("i")
            self.need(";")
        elif c == K["mod"]:
            self.p += 1
            self.need("i")
            if not self.eat(";"):
                self.need("{")
                self.listed("}", Rust.top, "item")
                self.need("}")
        elif re.compile(rf"[{kw('const async unsafe')}]*(?:{K['extern']}s?)?{K['fn']}").match(self.s, self.p):
            if self.known("fn", HEAD, Rust.fn_head):
                self.block()
            else:
                self.fn_head()
                if not self.eat(";"):
                    self.block()
        elif c in kw("const static") and nxt in "i" + K["mut"]:
            self.p += 1
            self.eat(K["mut"])
            self.need("i")
            self.need(":")
            self.type()
            if self.eat("="):
                self.binary()
            self.need(";")
        elif c == K["type"]:
            self.p += 1
            self.need("i")
            self.generics()
            if self.eat(":"):
                self.bounds()
            if self.eat("="):
                self.type()
            self.need(";")
        elif c == K["struct"] or c == K["union"] and nxt == "i":
            self.p += 1
            self.need("i")
            self.generics()
            self.where()
            if self.at("("):
                self.p += 1
                self.items(")", self.tuple_field)
                self.where()
                self.need(";")
            elif not self.eat(";"):
                self.fields()
        elif c == K["enum"]:
            self.p += 1
            self.need("i")
            self.generics()
            self.where()
            self.need("{")
            self.items("}", self.variant)
        elif c == K["impl"] or c in kw("unsafe") and nxt in kw("impl trait"):
            self.eat(K["unsafe"])
            if self.at(K["trait"]):
                return self.item()
            self.p += 1
            self.generics()
            self.eat("!")
            self.type()
            if self.eat(K["for"]):
                self.type()
            self.where()
            self.members()
        elif c == K["trait"]:
            self.p += 1
            self.need("i")
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            self.members()
        elif c == K["extern"]:
            self.p += 1
            self.eat("s")
            self.members()
        elif c == "i" and nxt == "!" and self.s[self.p + 2] in "i{([":
            self.p += 2
            self.eat("i")
            braced = self.at("{")
            self.tree()
            if not braced:
                self.need(";")
        else:
            self.p = start
            return False
        return True

    def members(self) -> None:
        self.need("{")
        self.listed("}", Rust.top, "item")
        self.need("}")

    def used(self) -> None:
        self.eat("D")
        while True:
            if self.eat("*"):
                return
            if self.eat("{"):
                self.items("}", self.used)
                return
            if not self.at(self.PATHS):
                self.fail("expected a path")
            self.p += 1
            if not self.eat("D"):
                break
        if self.eat(K["as"]):
            self.need("i")

    def fn_head(self) -> None:
        while not self.eat(K["fn"]):
            self.p += 1
        self.need("i")
        self.generics()
        self.need("(")
        self.items(")", self.param)
        if self.eat("R"):
            self.type()
        self.where()

    def param(self) -> None:
        self.attributes()
        if self.rx(re.compile(rf"(?:&l?)?{K['mut']}?i(?=[,)])")):
            return
        if self.eat("V"):
            return
        self.pattern()
        self.need(":")
        self.type()

    def generics(self) -> None:
        if self.at("<"):
            self.p += 1
            while not self.eat(">"):
                self.attributes()
                if self.eat("l"):
                    if self.eat(":"):
                        self.bounds()
                else:
                    self.eat(K["const"])
                    self.need("i")
                    if self.eat(":"):
                        self.bounds()
                    if self.eat("="):
                        self.type()
                if not self.eat(","):
                    self.need(">")
                    return

    def where(self) -> None:
        if self.eat(K["where"]):
            while not self.at("{;="):
                if not self.eat("l"):
                    self.type()
                self.need(":")
                self.bounds()
                if not self.eat(","):
                    return

    def bounds(self) -> None:
        while self.at("l?(" + self.PATHS + kw("for dyn impl") + "&[*"):
            self.eat("?")
            if not self.eat("l"):
                self.type()
            if not self.eat("+"):
                return

    def tuple_field(self) -> None:
        self.attributes()
        if self.eat(K["pub"]) and self.at("("):
            self.braces("(", ")")
        self.type()

    def fields(self) -> None:
        self.need("{")
        self.items("}", self.field)

    def field(self) -> None:
        self.attributes()
        if self.eat(K["pub"]) and self.at("("):
            self.braces("(", ")")
        self.need("i")
        self.need(":")
        self.type()

    def variant(self) -> None:
        self.attributes()
        self.need("i")
        if self.eat("("):
            self.items(")", self.tuple_field)
        elif self.at("{"):
            self.fields()
        if self.eat("="):
            self.binary(2)

    def type(self) -> None:
        c = self.s[self.p]
        if c in "&A":
            self.p += 1
            self.eat("l")
            self.eat(K["mut"])
            self.type()
        elif c == "*":
            self.p += 1
            if not self.at(kw("const mut")):
                self.fail("expected const")
            self.p += 1
            self.type()
        elif c == "[":
            self.p += 1
            self.type()
            if self.eat(";"):
                self.binary()
            self.need("]")
        elif c == "(":
            self.p += 1
            self.items(")", self.type)
        elif c == "!":
            self.p += 1
        elif c in kw("impl dyn"):
            self.p += 1
            self.bounds()
        elif c == K["for"]:
            self.p += 1
            self.generics()
            self.type()
        elif c in kw("fn unsafe extern"):
            while not self.eat(K["fn"]):
                self.p += 1
                self.eat("s")
            self.need("(")
            self.items(")", self.fn_type_param)
            if self.eat("R"):
                self.type()
        elif c in "<D" + self.PATHS:
            self.path(False)
        else:
            self.fail("expected a type")

    def fn_type_param(self) -> None:
        self.rx(re.compile("i:(?!:)"))
        self.type()

    def path(self, value: bool) -> None:
        if self.eat("<"):
            self.type()
            if self.eat(K["as"]):
                self.type()
            self.need(">")
            self.need("D")
        self.eat("D")
        while True:
            if not self.at(self.PATHS):
                self.fail("expected a path")
            self.p += 1
            if not value and self.at("<"):
                self.angles()
            if not value and self.at("(") and self.s[self.p - 1] == "i":
                self.p += 1
                self.items(")", self.type)
                if self.eat("R"):
                    self.type()
            if not self.eat("D"):
                return
            if self.at("<"):
                self.angles()
                if not self.eat("D"):
                    return

    def angles(self) -> None:
        self.need("<")
        while not self.eat(">"):
            if self.eat("l") or self.eat("n") or self.eat("s"):
                pass
            elif self.at("{"):
                self.block()
            else:
                self.type()
                if self.eat("="):
                    self.type()
                elif self.eat(":"):
                    self.bounds()
            if not self.eat(","):
                self.need(">")
                return

    def pattern(self) -> None:
        self.eat("|")
        while True:
            self.pattern_unit()
            if not self.eat("|"):
                return

    def pattern_unit(self) -> None:
        c = self.s[self.p]
        if c in "&A":
            self.p += 1
            self.eat(K["mut"])
            self.pattern_unit()
        elif c in kw("ref mut"):
            self.p += 1
            self.eat(K["mut"])
            self.need("i")
            if self.eat("@"):
                self.pattern_unit()
        elif c == "(":
            self.p += 1
            self.items(")", self.pattern)
        elif c == "[":
            self.p += 1
            self.items("]", self.pattern)
        elif c in "ns-":
            self.p += 1
            if c == "-":
                self.need("n")
            self.ranged()
        elif c == "W":
            self.ranged()
        elif c in "<D" + self.PATHS:
            self.path(True)
            if self.eat("!"):
                self.tree()
            elif self.eat("("):
                self.items(")", self.pattern)
            elif self.at("{"):
                self.p += 1
                self.items("}", self.field_pattern)
            elif self.eat("@"):
                self.pattern_unit()
            else:
                self.ranged()
        else:
            self.fail("expected a pattern")

    def ranged(self) -> None:
        if self.eat("W") or self.eat("V"):
            if self.at("-"):
                self.p += 1
            if self.at("ns"):
                self.p += 1
            elif self.at(self.PATHS):
                self.path(True)

    def field_pattern(self) -> None:
        self.attributes()
        if self.eat("W"):
            return
        self.eat(K["ref"])
        self.eat(K["mut"])
        if not self.eat("n"):
            self.need("i")
        if self.eat(":"):
            self.pattern()

    def tree(self) -> None:
        c = self.s[self.p]
        if c not in "([{":
            self.fail("expected a bracket")
        self.braces(c, {"(": ")", "[": "]", "{": "}"}[c])

    BLOCKS = kw("if match while for loop unsafe") + "{"

    def statement(self) -> None:
        self.attributes()
        c = self.s[self.p]
        if c == ";":
            self.p += 1
        elif c == K["let"]:
            self.p += 1
            self.pattern()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.binary()
                if self.eat(K["else"]):
                    self.block()
            self.need(";")
        elif c == "i" and self.s[self.p + 1] == "!" or not self.item():
            if c in self.BLOCKS or c == "l":
                self.primary()
                if self.at(".?"):
                    self.after()
                    self.rest()
                    if not self.at("}"):
                        self.need(";")
                else:
                    self.eat(";")
                return
            braced = re.compile(r"i!i?\{").match(self.s, self.p)
            self.binary()
            if not self.at("}") and not (braced and self.s[self.p - 1] == "}"):
                self.need(";")

    def rest(self) -> None:
        while self.level():
            self.operator()
            self.binary(2)

    def operator(self) -> None:
        if self.eat(K["as"]):
            return
        super().operator()

    def binary(self, level: int = 1) -> None:
        self.unary()
        while True:
            op = self.level()
            if op < level or op == 0:
                return
            if self.eat(K["as"]):
                self.type()
                continue
            ranged = self.at("W")
            self.operator()
            if ranged and (self.at(")]},;=" + END) or self.at("{") and not self.literals):
                return
            self.binary(op + 1 if op > 1 else 1)

    def unary(self) -> None:
        while True:
            if self.at(self.PREFIX):
                self.p += 1
            elif self.at("&A"):
                self.p += 1
                self.eat(K["mut"])
            else:
                break
        if self.at("W"):
            self.p += 1
            if not self.at(")]},;" + END):
                self.binary(3)
            return
        self.primary()
        self.after()

    def after(self) -> None:
        while True:
            c = self.s[self.p]
            if c == "?":
                self.p += 1
            elif c == ".":
                self.p += 1
                if not self.at("in" + K["await"]):
                    self.fail("expected a name")
                self.p += 1
                if self.at("D"):
                    self.p += 1
                    self.angles()
            elif c == "(":
                self.p += 1
                self.inside(lambda: self.items(")", self.binary))
            elif c == "[":
                self.p += 1
                self.inside(self.binary)
                self.need("]")
            else:
                return

    def inside(self, rule) -> None:
        saved, self.literals = self.literals, True
        rule()
        self.literals = saved

    def primary(self) -> None:
        c = self.s[self.p]
        if c in "ns":
            self.p += 1
        elif c in "<D" + self.PATHS:
            self.path(True)
            if self.at("!") and self.s[self.p + 1] in "([{":
                self.p += 1
                self.tree()
            elif self.literals and self.at("{"):
                self.p += 1
                self.items("}", self.field_value)
        elif c == "(":
            self.p += 1
            self.inside(lambda: self.items(")", self.binary))
        elif c == "[":
            self.p += 1
            self.inside(self.array)
        elif c == "{":
            self.inside(self.block)
        elif c in "|O" + K["move"] or c == K["async"] and self.s[self.p + 1] in "|O" + K["move"]:
            self.closure()
        elif c in kw("unsafe async"):
            self.p += 1
            self.inside(self.block)
        elif c == K["if"]:
            self.p += 1
            self.head("if")
            self.inside(self.block)
            if self.eat(K["else"]):
                self.primary() if self.at(K["if"]) else self.inside(self.block)
        elif c == K["while"]:
            self.p += 1
            self.head("if")
            self.inside(self.block)
        elif c == K["loop"]:
            self.p += 1
            self.inside(self.block)
        elif c == K["for"]:
            self.p += 1
            if not self.known("for", self.COND, Rust.for_head):
                self.for_head()
            self.inside(self.block)
        elif c == K["match"]:
            self.p += 1
            self.head("if")
            self.need("{")
            self.inside(self.arms)
        elif c == "l":
            self.p += 1
            self.need(":")
            self.primary()
        elif c in kw("return break continue"):
            self.p += 1
            self.eat("l")
            if c != K["continue"] and not self.at(";})," + END):
                self.binary()
        else:
            self.fail("expected an expression")

    def head(self, tag: str) -> None:
        if not self.known(tag, self.COND, Rust.condition_here):
            self.condition_here()

    def condition_here(self) -> None:
        saved, self.literals = self.literals, False
        while True:
            if self.eat(K["let"]):
                self.pattern()
                self.need("=")
                self.binary(4)
            else:
                self.binary()
            if not self.eat("A"):
                break
        self.literals = saved

    def for_head(self) -> None:
        self.pattern()
        self.need(K["in"])
        saved, self.literals = self.literals, False
        self.binary()
        self.literals = saved

    def arms(self) -> None:
        while not self.eat("}"):
            self.attributes()
            self.pattern()
            if self.eat(K["if"]):
                self.binary()
            self.need("F")
            if self.at("{"):
                self.block()
                if self.at(".?"):
                    self.after()
                self.eat(",")
            else:
                self.binary()
                if not self.eat(",") and not self.at("}") and self.s[self.p - 1] != "}":
                    self.need(",")

    def array(self) -> None:
        if self.eat("]"):
            return
        self.binary()
        if self.eat(";"):
            self.binary()
            self.need("]")
        elif self.eat(","):
            self.items("]", self.binary)
        else:
            self.need("]")

    def field_value(self) -> None:
        self.attributes()
        if self.eat("W"):
            if not self.at("}"):
                self.binary()
            return
        if not self.eat("n"):
            self.need("i")
        if self.eat(":"):
            self.binary()

    def closure(self) -> None:
        self.eat(K["async"])
        self.eat(K["move"])
        if not self.eat("O"):
            self.need("|")
            while not self.eat("|"):
                self.pattern_unit()
                if self.eat(":"):
                    self.type()
                if not self.eat(","):
                    self.need("|")
                    break
        if self.eat("R"):
            self.type()
            self.block()
        else:
            self.binary()


class Python(Parser):
    """One logical line after the other; the block structure comes from the indents."""

    language = "python"
    LEVELS = {K["or"]: 1, K["and"]: 2, "E": 4, "<": 4, ">": 4, K["in"]: 4, K["is"]: 4, K["not"]: 4, "|": 5, "^": 6, "&": 7, "S": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "@": 10, "P": 12}
    OPENERS = {"if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class", "match", "case"}
    AFTER = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except", "try"), "except": ("try", "except"), "finally": ("try", "except", "else")}

    # -- one line
    def line(self) -> str:
        """The keyword of a compound statement, "decorator", or "" for simple statements."""
        c = self.s[self.p]
        if c == "@":
            self.p += 1
            self.named()
            self.need(END)
            return "decorator"
        a = self.p
        if c == K["async"]:
            self.p += 1
            if not self.at(kw("def for with")):
                self.fail("expected def")
            c = self.s[self.p]
        word = NAME_OF.get(c, "")
        if c in "XZ":
            if self.soft():
                return self.soft_word
            self.s = "i" + self.s[1:]
        if word not in self.OPENERS:
            self.p = a
            self.simple()
            return ""
        self.p += 1
        if word in ("if", "elif", "while"):
            self.named()
        elif word == "for":
            self.targets()
            self.need(K["in"])
            self.stars()
        elif word == "except":
            self.eat("*")
            if not self.at(":"):
                self.ternary()
                if self.at(","):
                    self.fail("expected brackets")
                if self.eat(K["as"]):
                    self.need("i")
        elif word == "with":
            if not self.bracketed_with():
                self.withs(":")
        elif word == "def":
            self.need("i")
            if self.at("["):
                self.braces("[", "]")
            self.need("(")
            self.params(")", True)
            self.need(")")
            if self.eat("R"):
                self.ternary()
        elif word == "class":
            self.need("i")
            if self.at("["):
                self.braces("[", "]")
            if self.eat("("):
                self.arguments()
        self.need(":")
        if not self.at(END):
            self.simple()
            return "+" + word
        return word

    soft_word = ""

    def soft(self) -> bool:
        """match and case are names too: a line with a subject or pattern and a colon is a statement."""
        word = "match" if self.at("X") else "case"
        a, self.p = self.p, self.p + 1
        try:
            while True:
                self.eat("*")
                self.binary(5)
                if self.eat(K["as"]):
                    self.need("i")
                if not self.eat(",") or self.at(":" + K["if"]):
                    break
            if self.eat(K["if"]):
                self.named()
            self.need(":")
            self.soft_word = word
            if self.at(END):
                return True
            self.simple()
            self.soft_word = "+" + word
            return True
        except Bad:
            pass
        self.p = a
        return False

    def withs(self, end: str) -> None:
        while True:
            self.ternary()
            if self.eat(K["as"]):
                self.target_unit()
            if not self.eat(",") or self.at(end):
                return

    def bracketed_with(self) -> bool:
        a = self.p
        if self.eat("("):
            try:
                self.withs(")")
                self.need(")")
                if self.at(":"):
                    return True
            except Bad:
                pass
        self.p = a
        return False

    def simple(self) -> None:
        while True:
            self.small()
            if not self.eat(";") or self.at(END):
                break
        self.need(END)

    def small(self) -> None:
        c = self.s[self.p]
        if c in kw("pass break continue"):
            self.p += 1
        elif c == K["return"]:
            self.p += 1
            if not self.at(";" + END):
                self.stars()
        elif c == K["raise"]:
            self.p += 1
            if not self.at(";" + END):
                self.ternary()
                if self.eat(K["from"]):
                    self.ternary()
        elif c == K["assert"]:
            self.p += 1
            self.ternary()
            if self.eat(","):
                self.ternary()
        elif c == K["del"]:
            self.p += 1
            self.targets()
        elif c in kw("global nonlocal"):
            self.p += 1
            self.need("i")
            while self.eat(","):
                self.need("i")
        elif c == K["import"]:
            self.p += 1
            self.dotted(True)
            while self.eat(","):
                self.dotted(True)
        elif c == K["from"]:
            self.p += 1
            dots = self.rx(re.compile(r"[.V]+"))
            if not dots or self.at("i"):
                self.dotted(False)
            self.need(K["import"])
            if self.eat("*"):
                return
            if self.eat("("):
                if self.at(")"):
                    self.fail()
                self.items(")", self.alias)
            else:
                self.alias()
                while self.eat(","):
                    self.alias()
        elif c == "Y":
            self.p += 1
            self.need("i")
            if self.at("["):
                self.braces("[", "]")
            self.need("=")
            self.ternary()
        else:
            self.assignment()

    def dotted(self, named: bool) -> None:
        self.need("i")
        while self.eat("."):
            self.need("i")
        if named and self.eat(K["as"]):
            self.need("i")

    def alias(self) -> None:
        self.need("i")
        if self.eat(K["as"]):
            self.need("i")

    def assignment(self) -> None:
        start = self.p
        self.stars()
        if self.at(":") :
            if not self.target(self.s[start : self.p]):
                self.fail("can't annotate this")
            self.p += 1
            self.ternary()
            if self.eat("="):
                self.stars()
        elif self.at("Q"):
            if not self.target(self.s[start : self.p]) or self.s[self.p - 1] in ")]" and self.s[start] in "([" and re.compile(group("[^()]", 3) + r"\Z").match(self.s[start : self.p]):
                self.fail("can't assign to this")
            self.p += 1
            self.stars()
        else:
            while self.at("="):
                if not self.target(self.s[start : self.p]):
                    self.fail("can't assign to this")
                self.p += 1
                start = self.p
                self.stars()

    UNIT = re.compile(r"\*?i(?:[.]i|\[.*\]|\(.*\))*\Z", re.S)

    def target(self, part: str) -> bool:
        """Whether an expression, already accepted, may stand left of an assignment."""
        depth, piece, pieces = 0, "", []
        for c in part:
            if c == "," and depth == 0:
                pieces.append(piece)
                piece = ""
                continue
            depth += (c in "([{") - (c in ")]}")
            piece += c
        pieces.append(piece) if piece else None
        for x in pieces:
            x = x.lstrip("*")
            if not x:
                return False
            if x[0] in "([" and x[-1] in ")]" and self.wrapped(x):
                if x[1:-1] and not self.target(x[1:-1]):
                    return False
            elif x[0] in "ns" and len(x) == 1 or x[-1] not in "i]" or x[-1] == "]" and x[0] == "[" or self.open_operator(x):
                return False
        return True

    def wrapped(self, x: str) -> bool:
        depth = 0
        for k, c in enumerate(x):
            depth += (c in "([{") - (c in ")]}")
            if depth == 0:
                return k == len(x) - 1
        return False

    def open_operator(self, x: str) -> bool:
        depth = 0
        for c in x:
            depth += (c in "([{") - (c in ")]}")
            if depth == 0 and (c in "+-*/%@&|^~ESP<>" or c >= "Ā"):
                return True
        return False

    def targets(self) -> None:
        while True:
            self.eat("*")
            self.target_unit()
            if not self.eat(",") or self.at(K["in"] + "=:;" + END):
                return

    def target_unit(self) -> None:
        a = self.p
        self.atom()
        self.trail()
        if not self.target(self.s[a : self.p]):
            self.p = a
            self.fail("can't assign to this")

    # -- expressions
    def stars(self) -> None:
        """Expressions with commas between, stars and yield allowed."""
        if self.at(K["yield"]):
            self.yielded()
            return
        while True:
            self.eat("*")
            self.named()
            if not self.eat(",") or self.at("=:;)]}Q" + END):
                return

    def yielded(self) -> None:
        self.p += 1
        if self.eat(K["from"]):
            self.ternary()
        elif not self.at(";)=]}" + END):
            self.stars()

    def named(self) -> None:
        if self.at("i") and self.s[self.p + 1] == "L":
            self.p += 2
        self.ternary()

    def ternary(self) -> None:
        if self.at(K["lambda"]):
            self.p += 1
            self.params(":", False)
            self.need(":")
            self.ternary()
            return
        self.binary()
        if self.at(K["if"]):
            self.p += 1
            self.binary()
            self.need(K["else"])
            self.ternary()

    def operator(self) -> None:
        c = self.s[self.p]
        self.p += 1
        if c == K["is"]:
            self.eat(K["not"])
        elif c == K["not"]:
            self.need(K["in"])
        elif c in "<>" and self.at(c):
            self.p += 1

    def binary(self, level: int = 1) -> None:
        if level <= 3 and self.at(K["not"]):
            self.p += 1
            self.binary(3)
        else:
            self.unary()
        while True:
            op = self.level()
            if op < level or op == 0:
                return
            self.operator()
            self.binary(op if op == 12 else op + 1)

    def unary(self) -> None:
        while self.at("-+~"):
            self.p += 1
        self.eat(K["await"])
        self.atom()
        self.trail()

    def atom(self) -> None:
        c = self.s[self.p]
        if c == "s":
            while self.eat("s"):
                pass
        elif c in "inV":
            self.p += 1
        elif c == "(":
            self.p += 1
            if not self.eat(")"):
                if self.at(K["yield"]):
                    self.yielded()
                else:
                    self.elements(")")
                self.need(")")
        elif c == "[":
            self.p += 1
            if not self.eat("]"):
                self.elements("]")
                self.need("]")
        elif c == "{":
            self.p += 1
            while not self.at("}"):
                if self.eat("P"):
                    self.binary(5)
                elif self.eat("*"):
                    self.binary(5)
                else:
                    self.named()
                    if self.eat(":"):
                        self.ternary()
                    if self.comprehension():
                        break
                if not self.eat(","):
                    break
            self.need("}")
        else:
            self.fail("expected an expression")

    def elements(self, end: str) -> None:
        while not self.at(end):
            self.eat("*")
            self.named()
            if self.comprehension():
                return
            if not self.eat(","):
                return

    def comprehension(self) -> bool:
        found = False
        while self.at(K["for"]) or self.at(K["async"]) and self.s[self.p + 1] == K["for"]:
            found = True
            self.eat(K["async"])
            self.p += 1
            self.targets()
            self.need(K["in"])
            self.binary()
            while self.eat(K["if"]):
                if self.at("i") and self.s[self.p + 1] == "L":
                    self.p += 2
                self.binary()
        return found

    def trail(self) -> None:
        while True:
            c = self.s[self.p]
            if c == ".":
                self.p += 1
                self.need("i")
            elif c == "(":
                self.p += 1
                self.arguments()
            elif c == "[":
                self.p += 1
                if self.at("]"):
                    self.fail("expected an index")
                while not self.at("]"):
                    self.slice()
                    if not self.eat(","):
                        break
                self.need("]")
            else:
                return

    def slice(self) -> None:
        self.eat("*")
        if not self.at(":"):
            self.named()
        for _ in range(2):
            if self.eat(":") and not self.at(":,]"):
                self.ternary()

    def arguments(self) -> None:
        """After a keyword no plain argument may come, after ** none with * either; a generator without brackets stands alone."""
        named = double = False
        first = True
        while not self.eat(")"):
            if self.eat("P"):
                self.ternary()
                double = True
            elif self.at("*"):
                if double:
                    self.fail("* after ** in a call")
                self.p += 1
                self.ternary()
            elif self.at("i") and self.s[self.p + 1] == "=":
                self.p += 2
                self.ternary()
                named = True
            else:
                a = self.p
                self.named()
                if self.comprehension():
                    if not first or not self.at(")"):
                        self.fail("generator without brackets")
                elif named or double:
                    raise Bad(a, "plain argument after a keyword")
            first = False
            if not self.eat(","):
                self.need(")")
                return

    def params(self, end: str, typed: bool) -> None:
        defaults = starred = False
        while not self.at(end):
            if self.eat("/"):
                pass
            elif self.eat("P"):
                self.need("i")
                if typed and self.eat(":"):
                    self.ternary()
            else:
                star = self.eat("*")
                starred = starred or star
                if not star or self.at("i"):
                    self.need("i")
                    if typed and self.eat(":"):
                        self.eat("*")
                        self.ternary()
                    if not star and self.eat("="):
                        self.ternary()
                        defaults = True
                    elif defaults and not starred:
                        self.fail("expected a default")
            if not self.eat(","):
                return

    # -- the file
    def parse(self, indents: list[str]) -> list[tuple[int, str]]:
        """Errors of the whole text; indents has the space before each physical line but the first."""
        out, stack, blocks, need, at, k = self.errors, [""], [[]], None, 0, -1
        lines = self.s[:-1].split("\n")
        number, total = 0, len(lines)
        while number < total:
            text, start, indent = lines[number], at, indents[number]
            at += len(text) + 1
            number += 1
            if not text:
                continue
            depth = self.depth(text)
            while depth > 0 and number < total:
                text += lines[number]
                at += len(lines[number]) + 1
                number += 1
                depth = self.depth(text)
            kind, error = self.shape(text)
            if error:
                out.append((start + min(error[0], max(0, at - start - 2)), error[1]))
            if kind is None:
                kind = ""
            if indent != stack[-1]:
                if indent.startswith(stack[-1]):
                    if need == "match" and kind not in ("case", "+case"):
                        out.append((start, "expected case"))
                    if need is None:
                        out.append((start, "unexpected indent"))
                    else:
                        stack.append(indent)
                        blocks.append([])
                    need = None
                    if stack[-1] != indent:
                        stack.append(indent)
                        blocks.append([])
                else:
                    if need is not None:
                        out.append((start, f"expected a block after {need}"))
                        need = None
                    while len(stack) > 1 and len(stack[-1]) > len(indent):
                        self.closed(blocks.pop(), out, start)
                        stack.pop()
                    if stack[-1] != indent:
                        out.append((start, "unindent matches no outer level"))
                        stack.append(indent)
                        blocks.append([])
            elif need is not None:
                out.append((start, f"expected a block after {need}"))
                need = None
            word = kind.lstrip("+")
            seq = blocks[-1]
            last = seq[-1] if seq else ""
            if not error or kind:
                if word in self.AFTER and last not in self.AFTER[word]:
                    out.append((start, f"{word} without a statement it belongs to"))
                if last == "try" and word not in ("except", "finally"):
                    out.append((start, "try without except"))
                if last == "decorator" and word not in ("def", "class", "decorator"):
                    out.append((start, "decorator without a definition"))
            seq[:] = [word]
            need = kind if kind and kind[0] != "+" and kind != "decorator" else None
        if need is not None:
            out.append((len(self.s) - 1, f"expected a block after {need}"))
        while blocks:
            self.closed(blocks.pop(), out, len(self.s) - 1)
        return out

    def closed(self, seq: list[str], out: list, place: int) -> None:
        if seq and seq[-1] in ("try", "decorator"):
            out.append((place, f"{seq[-1]} without what it needs"))

    def depth(self, text: str) -> int:
        """Brackets left open; a mismatch counts as closed, the grammar finds it."""
        depth = 0
        for c in _BRACKET.findall(text):
            depth += 1 if c in "([{" else -1
            if depth < 0:
                return 0
        return depth

    def shape(self, text: str) -> tuple[str | None, tuple[int, str] | None]:
        key = (self.language, text)
        found = self.seen.get(key)
        if found is None:
            part = Python(text)
            try:
                found = (part.line(), None)
            except Bad as e:
                word = NAME_OF.get(text[0], "")
                opens = word in self.OPENERS and text[-1] == ":"
                found = (word if opens else None, (e.place, e.cause))
            if len(self.seen) > _KEEP:
                self.seen.clear()
            self.seen[key] = found
        return found


_BRACKET = re.compile(r"[()\[\]{}]")
_SOFT_START = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\n)*(?:match|case)\b")
PARSERS = {"c": C, "java": Java, "javascript": JavaScript, "typescript": TypeScript, "go": Go, "rust": Rust}
_SOFT = re.compile(r"(?<=[;{(\[,=+\-*/%&|^~!?:<>.EAOHSQFVP])\n+|\n+(?=[)\],.?:;=+*/%&|^<>EAOHSQFP])|^\n+")


def prepared(language: str, s: str) -> str:
    """Without the line ends at which no statement of JavaScript or TypeScript can end."""
    return _SOFT.sub("", s) if language in ("javascript", "typescript") else s


def places_in(whole: str, part: str, places: list[int]) -> list[int]:
    """Where the places of part, which is whole without some line ends, are in whole."""
    out, j, k, wanted = {}, 0, 0, set(places)
    for k, c in enumerate(part):
        while j < len(whole) - 1 and whole[j] != c and not (whole[j] == "\n" and c == ";"):
            j += 1
        if k in wanted:
            out[k] = j
        j += 1
    return [out.get(k, len(whole)) for k in places]


#: Fixed value: brackets that Python's own tokenizer lets nest.
PYTHON_DEPTH = 200
_FORMATTED = re.compile(r"(?:[fF][rR]?|[rR][fF])(\"\"\"|\'\'\'|\"|\')")
_NAME_END = re.compile(r"[=<>!]=$")


def _past_string(text: str, k: int) -> int:
    """The place behind the string that begins at k."""
    mark = text[k : k + 3] if text[k : k + 3] in ('"""', "\'\'\'") else text[k]
    k += len(mark)
    while k < len(text) and not text.startswith(mark, k):
        k += 2 if text[k] == "\\" else 1
    return k + len(mark)


def _past_code(text: str, k: int, stops: str) -> int:
    """The first place from k on outside strings and brackets that holds one of stops, or the end."""
    depth = 0
    while k < len(text):
        c = text[k]
        if depth == 0 and c in stops and not (c == "!" and text[k + 1 : k + 2] == "="):
            return k
        if c in "\"'`":
            k = _past_template(text, k + 1, "`") + 1 if c == "`" else _past_string(text, k)
            continue
        depth += (c in "([{") - (c in ")]}")
        k += 1
    return k


def _past_template(text: str, k: int, end: str) -> int:
    """The place of the mark that ends a template whose inside begins at k."""
    while k < len(text) and text[k] != end:
        if text.startswith("${", k):
            k = _past_code(text, k + 2, "}") + 1
        else:
            k += 2 if text[k] == "\\" else 1
    return k


def _python_fields(body: str, spec: bool = False) -> str | None:
    """What is wrong with the fields of a format string, None if nothing."""
    k = 0
    while k < len(body):
        c = body[k]
        if c in "{}" and not spec and body[k + 1 : k + 2] == c:
            k += 2
        elif c == "}":
            return "single } in a format string"
        elif c == "{":
            end = _past_code(body, k + 1, ":!}")
            code = body[k + 1 : end].rstrip()
            if code.endswith("=") and not _NAME_END.search(code):
                code = code[:-1]
            if wrong := _fragment("python", code):
                return wrong
            if body[end : end + 1] == "!":
                at = end + 1
                end = _past_code(body, at, ":}")
                if body[at:end].strip() not in ("r", "s", "a"):
                    return "conversion of a format field"
            if body[end : end + 1] == ":":
                at = end + 1
                end = _past_code(body, at, "}")
                if wrong := _python_fields(body[at:end], True):
                    return wrong
            if body[end : end + 1] != "}":
                return "format field without end"
            k = end + 1
        else:
            k += 1
    return None


@lru_cache(20_000)
def _fragment(language: str, code: str) -> str | None:
    """What is wrong with an expression on its own, None if nothing."""
    s, tokens = classes(language, code.strip())
    if language == "python":
        parser = Python(s.replace("\n", ""))
        rule = parser.yielded if parser.at(K["yield"]) else parser.stars
    else:
        parser = PARSERS[language](prepared(language, s))
        rule = parser.expression
    try:
        rule()
        parser.rx(re.compile(r"\n*"))
        parser.need(END)
    except Bad as e:
        return e.cause
    inner = inside(language, s, tokens)
    return inner[0][1] if inner else None


def inside(language: str, s: str, tokens: list[str]) -> list[tuple[int, str]]:
    """Errors in the fields of Python's format strings and of script templates, at the place of the string."""
    out, place, table = [], 0, table_of(language)
    for t in tokens:
        if language == "python":
            m = _FORMATTED.match(t)
            body = t.rstrip()[m.end() : -len(m[1])] if m and "{" in t or m and "}" in t else None
            wrong = _python_fields(body) if body is not None else None
        elif t[0] == "`" and "${" in t:
            wrong, k, t2 = None, 1, t.rstrip()
            while wrong is None and (k := t2.find("${", k)) > 0:
                if (len(t2[:k]) - len(t2[:k].rstrip("\\"))) % 2:  # escaped
                    k += 2
                    continue
                end = _past_code(t2, k + 2, "}")
                wrong, k = _fragment(language, t2[k + 2 : end]), end + 1
        else:
            wrong = None
        if wrong:
            out.append((place, wrong))
        place += len(table[t])
    return out


def too_deep(s: str, most: int) -> list[tuple[int, str]]:
    """Where brackets nest deeper than ``most``."""
    depth = 0
    for m in _BRACKET.finditer(s):
        depth += 1 if m[0] in "([{" else -1
        if depth > most:
            return [(m.start(), "too many nested brackets")]
    return []


def errors(language: str, text: str) -> list[tuple[int, str]]:
    """All errors of a text as (line, cause), in order of place."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    ahead = 0
    if language == "python" and _SOFT_START.match(text):  # match and case are told by the line end before them
        text, ahead = "\n" + text, 1
    s, tokens = classes(language, text)
    if language == "python":
        found = too_deep(s, PYTHON_DEPTH)
        if not found:
            parser = Python(s)
            indents = [(tokens[0] if tokens and tokens[0].isspace() and "\n" not in tokens[0] else "")] + [t.rpartition("\n")[2].rstrip("casemth") for t in tokens if t[0] == "\n"]
            found = parser.parse(indents)
    else:
        parser = PARSERS[language](prepared(language, s))
        parser.file()
        found = parser.errors
    if not found and BAD in s:
        found = [(s.index(BAD), "invalid character")]
    script = language in ("javascript", "typescript")
    fields = inside(language, s, tokens) if language == "python" and _FORMATTED.search(text) or script and "${" in text else []
    if not found and not fields:
        return []
    found.sort()
    where = [min(p, len(s)) for p, _ in found]
    if script or language == "go":
        where = places_in(s, parser.s[:-1], where)
    both = sorted([*zip(where, (c for _, c in found)), *fields])
    return [(line - ahead, cause) for line, (_, cause) in zip(lines_of(language, tokens, [p for p, _ in both]), both)]
