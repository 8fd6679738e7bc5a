"""Query text to a Spark column: lexer, recursive-descent parser, compiler.

    query   := clause (["AND" | "OR"] clause)*      AND binds tighter; side by side is OR
    clause  := ["NOT" | "!" | "-" | "+"] ("(" query ")" | [field ":"] value)
    value   := word | "phrase" | [a TO b] | {a TO b} | >x >=x <x <=x | "(" values ")" | /regex/

The result is a Column, never SQL text. Fuzziness and boosts are refused. A keyword equals exactly; an analysed
text field holds the token, whatever its case; numbers and times compare by their type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewire.functions.ids import quoted


class QueryError(ValueError):
    """The query text cannot be understood, or asks for what is not supported."""


@dataclass
class Token:
    kind: str
    text: str
    at: int
    glued: bool = False


_LEX = re.compile(r'(?P<space>\s+)|(?P<phrase>"(?:\\.|[^"\\])*")|(?P<regex>/(?:\\.|[^/\\])+/)|(?P<sign>&&|\|\||[()\[\]{}:]|>=|<=|[<>])|(?P<word>(?:\\.|[^\s()\[\]{}":<>\\])+)', re.S)


def tokens(text: str) -> list[Token]:
    out, at, gap = [], 0, True
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup == "space":
            gap = True
        else:
            out.append(Token(str(m.lastgroup), m[0], at, not gap))
            gap = False
        at = m.end()
    return out


@dataclass
class Fields:
    """The columns of a table: dotted names, a `.keyword` suffix that means the column itself, paths into variants and
    maps. `analysed` are text fields; `everywhere` are searched by words without a field."""

    schema: T.StructType
    analysed: frozenset[str] = frozenset()
    everywhere: list[str] = field(default_factory=list)

    def find(self, name: str) -> tuple[Column, T.DataType, bool] | None:
        for known in (name, name.removesuffix(".keyword")):
            if known in self.schema.fieldNames():
                kind = self.schema[known].dataType
                return quoted(known), kind, known in self.analysed and known == name
        head, dot, rest = name.removesuffix(".keyword").partition(".")
        while dot:
            if head in self.schema.fieldNames():
                kind = self.schema[head].dataType
                if isinstance(kind, T.VariantType):
                    path = "$" + "".join(f'["{p}"]' for p in rest.split("."))
                    return F.try_variant_get(quoted(head), path, "string"), T.StringType(), False
                if isinstance(kind, T.MapType):
                    return quoted(head)[rest], kind.valueType, False
                if isinstance(kind, T.StructType) and rest in kind.fieldNames():
                    return quoted(head)[rest], kind[rest].dataType, False
            step, dot, rest = rest.partition(".")
            head = f"{head}.{step}"
        return None


def fields_of(df: DataFrame, analysed: frozenset[str] | set[str] = frozenset()) -> Fields:
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return Fields(df.schema, frozenset(analysed), strings)


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _wild(text: str) -> bool:
    return bool(re.search(r"(?<!\\)(?:\\\\)*[*?]", text))


def _like(text: str) -> str:
    """A wildcard as a LIKE pattern with backslash escapes."""
    out = []
    for m in re.finditer(r"\\(.)|(.)", text, re.S):
        if m[2] in ("*", "?"):
            out.append("%" if m[2] == "*" else "_")
        else:
            c = m[1] or m[2]
            out.append("\\" + c if c in "%_\\" else c)
    return "".join(out)


class _Parser:
    def __init__(self, text: str, fields: Fields):
        self.list, self.at, self.fields, self.must = tokens(text), 0, fields, []

    def peek(self, k: int = 0) -> Token | None:
        return self.list[self.at + k] if self.at + k < len(self.list) else None

    def take(self, text: str | None = None) -> Token:
        t = self.peek()
        if t is None or text and t.text != text:
            raise QueryError(f"expected {text or 'more'} at {t.at if t else 'the end'}")
        self.at += 1
        return t

    def is_word(self, *texts: str) -> bool:
        t = self.peek()
        return t is not None and t.kind in ("word", "sign") and t.text in texts

    def needed(self, c: Column) -> bool:
        return any(c is m for m in self.must)

    def query(self, name: str | None = None) -> Column:
        groups = [[self.clause(name)]]
        while (t := self.peek()) is not None and t.text != ")":
            if self.is_word("AND", "&&"):
                self.take()
                groups[-1].append(self.clause(name))
            else:
                if self.is_word("OR", "||"):
                    self.take()
                groups.append([self.clause(name)])
        required = [c for g in groups for c in g if self.needed(c)]
        parts = [reduce(lambda a, b: a & b, g) for g in groups if not all(self.needed(c) for c in g)]
        if required:
            return reduce(lambda a, b: a & b, required)
        return reduce(lambda a, b: a | b, parts)

    def clause(self, name: str | None) -> Column:
        if self.is_word("NOT", "!"):
            self.take()
            return _not(self.clause(name))
        t = self.peek()
        if t is not None and t.kind == "word" and len(t.text) > 1 and t.text[0] in "+-!" and not t.glued:
            self.list[self.at] = Token(t.kind, t.text[1:], t.at + 1)
            made = self.clause(name)
            made = made & F.lit(True) if t.text[0] == "+" else _not(made)
            self.must.append(made)
            return made
        if self.is_word("("):
            self.take()
            made = self.query(name)
            self.take(")")
            return made
        after = self.peek(1)
        if name is None and t is not None and t.kind in ("word", "phrase") and after is not None and after.text == ":" and after.glued:
            self.take()
            self.take(":")
            own = _plain(t.text[1:-1] if t.kind == "phrase" else t.text)
            if self.is_word("("):
                self.take()
                made = self.query(own)
                self.take(")")
                return made
            return self.value(own)
        return self.value(name)

    def value(self, name: str | None) -> Column:
        t = self.take()
        if t.text in ("[", "{"):
            return self.span(name, t.text == "[")
        if t.text in (">", ">=", "<", "<="):
            v = self.take()
            return self.on(name, lambda c, kind, _: _compare(c, kind, t.text, v))
        if t.kind == "sign" or t.text in ("AND", "OR"):
            raise QueryError(f"unexpected {t.text!r} at {t.at}")
        if t.kind == "word" and re.search(r"(?<!\\)[~^]\d*(?:\.\d+)?$", t.text):
            raise QueryError(f"fuzziness and boosts are not supported: {t.text!r}")
        nxt = self.peek()
        if t.kind == "phrase" and nxt is not None and nxt.glued and nxt.text[0] in "~^":
            raise QueryError("proximity and boosts are not supported")
        if name is None and t.text == "*":
            return F.lit(True)
        while t.kind == "word" and name is not None and (c := self.peek()) is not None and c.text == ":" and c.glued:
            self.take()
            more = self.take() if self.peek() is not None and self.peek().glued else None
            t = Token("word", t.text + ":" + (more.text if more else ""), t.at)
        return self.on(name, lambda c, kind, analysed: _matches(c, kind, analysed, t))

    def span(self, name: str | None, closed: bool) -> Column:
        low = self.bound()
        if self.take().text != "TO":
            raise QueryError("a range needs TO")
        high = self.bound()
        end = self.take()
        if end.text not in ("]", "}"):
            raise QueryError("a range needs an end")

        def made(c, kind, _):
            out = c.isNotNull()
            if low.text != "*":
                out = out & _compare(c, kind, ">=" if closed else ">", low)
            if high.text != "*":
                out = out & _compare(c, kind, "<=" if end.text == "]" else "<", high)
            return out

        return self.on(name, made)

    def bound(self) -> Token:
        t = self.take()
        while (c := self.peek()) is not None and c.glued and c.kind in ("word", "sign") and c.text not in ("]", "}"):
            t = Token(t.kind, t.text + self.take().text, t.at)
        return t

    def on(self, name: str | None, make) -> Column:
        if name is None:
            every = [make(*found) for c in self.fields.everywhere if (found := self.fields.find(c))]
            return reduce(lambda a, b: a | b, every, F.lit(False))
        found = self.fields.find(name)
        return F.lit(False) if found is None else make(*found)


def _not(c: Column) -> Column:
    """Rows that do not match; a missing value does not. Only here are nulls settled, so that other predicates stay as
    they are and reach the scan."""
    return ~F.coalesce(c, F.lit(False))


def _literal(kind: T.DataType, text: str) -> Column | None:
    if isinstance(kind, T.NumericType):
        return F.lit(text).try_cast("double" if "." in text or isinstance(kind, (T.DoubleType, T.FloatType)) else "decimal(38,0)")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(text).try_cast(kind.simpleString())
    if isinstance(kind, T.BooleanType):
        return F.lit(text.lower()).try_cast("boolean")
    return F.lit(text)


def _text(t: Token) -> str:
    return _plain(t.text[1:-1] if t.kind == "phrase" else t.text)


def _compare(c: Column, kind: T.DataType, sign: str, t: Token) -> Column:
    v = _literal(kind, _text(t))
    return {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[sign]


def _matches(c: Column, kind: T.DataType, analysed: bool, t: Token) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.exists(c, lambda x: _matches(x, kind.elementType, analysed, t))
    if t.kind == "word" and t.text == "*":
        return c.isNotNull()
    if t.kind == "regex":
        return c.cast("string").rlike("^(?:" + t.text[1:-1].replace("\\/", "/") + ")$")
    if isinstance(kind, T.StringType):
        if analysed:
            words = [re.escape(w) for w in re.findall(r"\w+", _text(t).lower())]
            if t.kind == "word" and _wild(t.text):
                words = ["".join({"*": r"\w*", "?": r"\w"}.get(x, re.escape(x)) for x in t.text.lower())]
            return F.lower(c).rlike(r"(?U)(?<!\w)" + r"\W+".join(words) + r"(?!\w)") if words else F.lit(False)
        if t.kind == "word" and _wild(t.text):
            inner = t.text.strip("*")
            if not _wild(inner) and "\\" not in inner:
                if t.text == inner + "*":
                    return c.startswith(inner)
                if t.text == "*" + inner:
                    return c.endswith(inner)
                if t.text == f"*{inner}*":
                    return c.contains(inner)
            return c.like(_like(t.text))
        return c == F.lit(_text(t))
    return c == _literal(kind, _text(t))


def compile_query(text: str, fields: Fields) -> Column:
    """The predicate of a query text; blank text and `*` match everything."""
    if not text.strip():
        return F.lit(True)
    parser = _Parser(text, fields)
    made = parser.query()
    if parser.peek() is not None:
        raise QueryError(f"unexpected {parser.peek().text!r} at {parser.peek().at}")
    return made
