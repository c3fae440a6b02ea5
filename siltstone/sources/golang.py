"""Syntax facts of Go source files.

A file is lexed and its statements are parsed in a Python worker, one file at
a time, as trees are not relational; everything after that is DataFrames.
There is no type checker: facts that need one (uses across packages, methods
of interfaces, constant values) are approximated by names, or are inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.text import has_build_constraint, is_generated_path

#: White space, then a comment, a text, a word, a number, an operator, or line ends.
_TOKEN = re.compile(
    r"[^\S\n]*(//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[^\W\d]\w*|\.?\d[\w.]*"
    r"|<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[-+*/%&|^]=|<<|>>|&\^|[^\s\w]|\n\s*|\Z)",
    re.S,
)
_KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS = {")", "]", "}", "++", "--"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    line: int


@dataclass(slots=True)
class Node:
    """A statement: what it is, its own tokens, blocks in its expressions, and its parts."""

    kind: str
    line: int
    head: list[Token] = field(default_factory=list)
    inner: list[list[Node]] = field(default_factory=list)
    body: list[Node] = field(default_factory=list)
    other: list[Node] | None = None
    other_is_if: bool = False
    cases: int = 0
    end: int = 0


def _kind(text: str) -> str:
    first = text[0]
    if first == "\n":
        return "nl"
    if text[:2] in ("//", "/*"):
        return "comment"
    if first in "`\"'" and len(text) > 1:
        return "str"
    if first.isdecimal() or (first == "." and text[1:2].isdecimal()):
        return "num"
    return "word" if first == "_" or first.isalnum() else "op"


def _may_end(kind: str, text: str) -> bool:
    """Whether a statement ends with a line that ends with the token."""
    return kind in ("num", "str") or text in _ENDS or (kind == "word" and (text not in _KEYWORDS or text in ("break", "continue", "fallthrough", "return")))


def lex(src: str) -> tuple[list[Token], list[Token]]:
    """(tokens with statement ends as ``;``, comments)."""
    tokens: list[Token] = []
    comments: list[Token] = []
    known: dict[str, tuple[str, bool]] = {}
    line, ends, ended = 1, False, 0
    for text in _TOKEN.findall(src):
        if not text:
            continue
        if text not in known:
            kind = _kind(text)
            known[text] = kind, _may_end(kind, text)
        kind, may_end = known[text]
        if kind == "nl" or kind == "comment":
            if kind == "comment":
                comments.append(Token(kind, text, line))
            more = text.count("\n")
            if more and ends:
                tokens.append(Token("op", ";", ended))
                ends = False
            line += more
            continue
        tokens.append(Token(kind, text, line))
        ends, ended = may_end, line
        if kind == "str":
            line += text.count("\n")
    if ends:
        tokens.append(Token("op", ";", ended))
    return tokens, comments


class Parser:
    """Statements of a token list; anything unexpected is passed over."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k].text if k < len(self.tokens) else ""

    def line(self) -> int:
        return self.tokens[min(self.at, len(self.tokens) - 1)].line if self.tokens else 0

    def expression(self, node: Node, stop: set[str], header: bool = False) -> None:
        """Tokens up to a stop at depth 0; bodies of function literals become inner blocks."""
        depth, literal = 0, False
        while self.at < len(self.tokens):
            t = self.tokens[self.at]
            if depth == 0 and t.text in stop and not (t.text == "{" and literal):
                return
            if t.text == "func":
                literal = True
            if t.text == "{" and literal and depth == self._func_depth:
                literal = False
                node.inner.append(self.block())
                continue
            if t.text == "{" and self.peek(-1) in ("struct", "interface"):
                self.skip_braces(node)
                continue
            if t.text in ("(", "[", "{"):
                depth += 1
            elif t.text in (")", "]", "}"):
                depth -= 1
                if depth < 0:
                    return
            if t.text == "func":
                self._func_depth = depth
            node.head.append(t)
            self.at += 1

    _func_depth = 0

    def skip_braces(self, node: Node | None = None) -> None:
        depth = 0
        while self.at < len(self.tokens):
            t = self.tokens[self.at]
            depth += (t.text == "{") - (t.text == "}")
            if node is not None:
                node.head.append(t)
            self.at += 1
            if depth == 0:
                return

    def block(self) -> list[Node]:
        """The statements in braces, from the opening one on."""
        self.at += 1
        out = self.statements({"}"})
        self.at += self.peek() == "}"
        return out

    def statements(self, stop: set[str]) -> list[Node]:
        out = []
        while self.at < len(self.tokens) and self.peek() not in stop:
            if self.peek() == ";":
                self.at += 1
                continue
            before = self.at
            node = self.statement()
            node.end = self.tokens[max(0, min(self.at, len(self.tokens)) - 1)].line
            out.append(node)
            if self.at == before:
                self.at += 1
        return out

    def statement(self) -> Node:
        word, line = self.peek(), self.line()
        if word == "if":
            node = Node("if", line)
            self.at += 1
            self.expression(node, {"{"}, True)
            node.body = self.block() if self.peek() == "{" else []
            if self.peek() == "else":
                self.at += 1
                node.other_is_if = self.peek() == "if"
                node.other = [self.statement()] if node.other_is_if else self.block()
            return node
        if word == "for":
            node = Node("for", line)
            self.at += 1
            self.expression(node, {"{"}, True)
            node.body = self.block() if self.peek() == "{" else []
            return node
        if word in ("switch", "select"):
            node = Node(word, line)
            self.at += 1
            self.expression(node, {"{"}, True)
            texts = [t.text for t in node.head]
            if word == "switch" and any(texts[k : k + 4] == [".", "(", "type", ")"] for k in range(len(texts))):
                node.kind = "typeswitch"
            self.at += 1
            while self.at < len(self.tokens) and self.peek() != "}":
                if self.peek() not in ("case", "default"):
                    self.at += 1
                    continue
                clause = Node("clause", self.line())
                listed = self.peek() == "case"
                self.at += 1
                self.expression(clause, {":"})
                clause.cases = _commas(clause.head) + 1 if listed else 0
                self.at += 1
                clause.body = self.statements({"case", "default", "}"})
                node.body.append(clause)
            self.at += 1
            return node
        if word == "{":
            return Node("block", line, body=self.block())
        if self.at + 1 < len(self.tokens) and self.tokens[self.at].kind == "word" and word not in _KEYWORDS and self.peek(1) == ":":
            self.at += 2
            return self.statement() if self.peek() not in ("}", ";", "") else Node("label", line)
        node = Node(word if word in ("return", "go", "defer", "var", "const", "type") else "simple", line)
        self.expression(node, {";", "}"})
        return node


def _commas(tokens: list[Token]) -> int:
    depth = n = 0
    for t in tokens:
        depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
        n += t.text == "," and depth == 0
    return n


def _logic(tokens: list[Token]) -> int:
    return sum(t.text in ("&&", "||") for t in tokens)


def cyclomatic(body: list[Node]) -> int:
    """Decision points: branches, loops, clauses, and logical operators."""
    n = 0
    for s in body:
        n += (s.kind in ("if", "for", "clause")) + _logic(s.head) + sum(cyclomatic(b) for b in s.inner) + cyclomatic(s.body) + cyclomatic(s.other or [])
    return n


def cognitive(body: list[Node], nesting: int = 0) -> int:
    """Branches weighted by depth.  Conditions of ``if`` and tags of ``switch`` count for nothing; type switches and selects add nothing of their own."""
    n = 0
    for s in body:
        own = _logic(s.head) + sum(cognitive(b, nesting) for b in s.inner)
        if s.kind == "if":
            n += 1 + nesting + cognitive(s.body, nesting + 1)
            if s.other is not None:
                n += (0 if s.other_is_if else 2 + nesting) + cognitive(s.other, nesting + 1)
        elif s.kind == "for":
            n += 1 + nesting + _logic(s.head) + sum(cognitive(b, nesting + 1) for b in s.inner) + cognitive(s.body, nesting + 1)
        elif s.kind == "switch":
            n += 1 + nesting + sum(c.cases + cognitive(c.body, nesting + 1) for c in s.body)
        else:
            n += own + cognitive(s.body, nesting)
    return n


def _every(body: list[Node]) -> Iterator[Node]:
    for s in body:
        yield s
        for b in s.inner:
            yield from _every(b)
        yield from _every(s.body)
        yield from _every(s.other or [])


def _calls(tokens: list[Token]) -> Iterator[tuple[str, str, int, list[list[Token]]]]:
    """(qualifier, name, line, arguments) of calls by name."""
    for k, t in enumerate(tokens):
        if t.text != "(" or k == 0 or tokens[k - 1].kind != "word" or tokens[k - 1].text in _KEYWORDS:
            continue
        qualifier = tokens[k - 3].text if k >= 3 and tokens[k - 2].text == "." else "." if k >= 2 and tokens[k - 2].text == "." else ""
        args: list[list[Token]] = [[]]
        depth = 0
        for u in tokens[k:]:
            depth += (u.text in ("(", "[", "{")) - (u.text in (")", "]", "}"))
            if depth == 0:
                break
            if u.text == "," and depth == 1:
                args.append([])
            elif not (u is t):
                args[-1].append(u)
        yield qualifier, tokens[k - 1].text, tokens[k - 1].line, [a for a in args if a]


def _argument(tokens: list[Token]) -> dict:
    texts = [t.text for t in tokens]
    strings = " ".join(t.text.strip("\"`'") for t in tokens if t.kind == "str")
    if len(tokens) == 1 and tokens[0].kind == "str":
        kind = "constant"
    elif texts[:3] == ["fmt", ".", "Sprintf"]:
        kind = "sprintf"
    elif "+" in texts and any(t.kind == "word" for t in tokens):
        kind = "concat"
    elif all(t.kind == "str" or t.text == "+" for t in tokens):
        kind = "constant"
    else:
        kind = "other"
    return {"kind": kind, "text": strings}


def _flat(body: list[Node]) -> list[str]:
    out: list[str] = []
    for s in body:
        out += [s.kind, *(t.text for t in s.head)]
        for b in [*s.inner, s.body, s.other or []]:
            if b:
                out += ["{", *_flat(b), "}"]
    return out


def facts(src: str, wanted: pa.Schema | None = None) -> dict:
    """The facts of one file, as the fields of :data:`FACTS`; what a schema of fewer fields does not have may be left out."""
    has = frozenset(_paths(wanted or FACTS))
    tokens, comments = lex(src)
    p = Parser(tokens)
    out: dict = {"package": None, "package_line": 0, "end_line": src.count("\n") + 1, "n_types": 0, "n_decls": 0, "imports": [], "funcs": [], "names": [], "calls": [], "selectors": [], "literals": [], "refs": [], "fields": [], "iface_methods": [], "aliases": []}
    decl_lines: list[int] = []
    while p.at < len(tokens):
        word, line = p.peek(), p.line()
        if word == ";":
            p.at += 1
        elif word == "package":
            out["package"], out["package_line"] = p.peek(1), line
            p.at += 2
        elif word == "import":
            node = Node("import", line)
            p.at += 1
            p.expression(node, {";"})
            parts = [t for t in node.head if t.text not in ("(", ")")]
            alias = ""
            for t in parts:
                if t.kind == "str":
                    out["imports"].append({"path": t.text.strip('"`'), "alias": alias, "line": t.line})
                    alias = ""
                elif t.text != ";":
                    alias = t.text
        elif word == "func":
            decl_lines.append(line)
            out["n_decls"] += 1
            _function(p, out, has)
        elif word in ("type", "var", "const"):
            decl_lines.append(line)
            out["n_decls"] += 1
            node = Node(word, line)
            p.at += 1
            p.expression(node, {";"})
            declared = _names(word, node, out, line)
            if word == "type":
                _types(node, out)
            for s in _every([node]):
                _record(s.head, False, out, has)
                # a name is not referred to by its own declaration
                out["refs"] += [t.text for t in s.head if t.kind == "word" and t.text not in _KEYWORDS and id(t) not in declared]
        else:
            p.at += 1
    _injected(comments, out)
    out["comments"] = [{"line": c.line, "text": c.text, "decl_line": next((d for d in decl_lines if c.line <= d <= c.line + 20), 0), "before_package": c.line < out["package_line"]} for c in comments]
    return out


def _injected(comments: list[Token], out: dict) -> None:
    """Marks variables whose comment, above them or their declaration or on their line, says that the linker sets them."""
    says = {}
    for c in comments:
        says[c.line + c.text.count("\n")] = (c.line, "-ldflags" in c.text or "-X " in c.text)
    for n in out["names"]:
        found = n["kind"] == "var" and says.get(n["line"], (0, False))[1]
        for at in (n["line"] - 1, n.pop("decl") - 1):
            while n["kind"] == "var" and at in says:
                found |= says[at][1]
                at = says[at][0] - 1
        n["injected"] = bool(found)


def _specs(node: Node) -> list[list[Token]]:
    """The tokens of each declared item of a declaration."""
    grouped = bool(node.head) and node.head[0].text == "("
    out: list[list[Token]] = [[]]
    depth = 0
    for t in node.head[1:] if grouped else node.head:
        depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
        if t.text == ";" and depth == 0:
            out.append([])
        elif depth >= 0:
            out[-1].append(t)
    return [x for x in out if x]


def _named_types(tokens: list[Token]) -> list[str]:
    """The types that tokens name, with their package's name where they have one."""
    out = []
    for k, t in enumerate(tokens):
        if t.kind == "word" and t.text[:1].isupper():
            out.append(f"{tokens[k - 2].text}.{t.text}" if k >= 2 and tokens[k - 1].text == "." else t.text)
    return out


def _names(word: str, node: Node, out: dict, line: int) -> set[int]:
    """Records what a declaration declares; the tokens that are the names."""
    declared: set[int] = set()
    for spec in _specs(node):
        k = 0
        while k < len(spec) and spec[k].kind == "word":
            t = spec[k]
            declared.add(id(t))
            rest = next((j for j in range(k, len(spec)) if spec[j].text == "="), len(spec))
            types = _named_types(spec[k + 1 : rest]) if word == "var" else []
            out["names"].append({"name": t.text, "kind": word, "line": t.line, "exported": t.text[:1].isupper(), "types": types, "decl": line})
            out["n_types"] += word == "type"
            if word == "type" or k + 2 >= len(spec) or spec[k + 1].text != ",":
                break
            k += 2
    return declared


def _types(node: Node, out: dict) -> None:
    """Fields of structs, methods of interfaces, and aliases of plain names."""
    for spec in _specs(node):
        owner, texts = spec[0].text, [t.text for t in spec]
        if len(spec) == 3 and texts[1] == "=" and spec[2].kind == "word":
            out["aliases"].append({"name": owner, "target": texts[2], "line": spec[0].line})
        kind = next((w for w in ("struct", "interface") if w in texts[1:]), None)
        at = texts.index(kind) + 1 if kind else 0
        if not kind or texts[at : at + 1] != ["{"]:
            continue
        depth, item = 0, []
        for t in spec[at:]:
            depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
            if (t.text == ";" and depth == 1) or depth == 0:
                _member(kind, owner, item, out)
                item = []
            elif not (t.text == "{" and depth == 1):
                item.append(t)
            if depth == 0:
                break


def _member(kind: str, owner: str, item: list[Token], out: dict) -> None:
    if kind == "interface":
        if len(item) > 1 and item[0].kind == "word" and item[1].text == "(":
            out["iface_methods"].append({"owner": owner, "name": item[0].text, "line": item[0].line})
        return
    item = [t for t in item if t.kind != "str"]
    if not item:
        return
    texts = [t.text for t in item]
    if len(item) == 1 or texts[0] == "*" or (len(item) == 3 and texts[1] == "."):
        out["fields"].append({"owner": owner, "name": texts[-1], "line": item[0].line, "exported": texts[-1][:1].isupper(), "embedded": True})
        return
    for k in range(0, len(item), 2):
        out["fields"].append({"owner": owner, "name": texts[k], "line": item[k].line, "exported": texts[k][:1].isupper(), "embedded": False})
        if k + 1 >= len(item) or texts[k + 1] != ",":
            break


def _record(tokens: list[Token], condition: bool, out: dict, has: frozenset[str]) -> None:
    if "calls" in has:
        for qualifier, name, line, args in _calls(tokens):
            out["calls"].append({"line": line, "qualifier": qualifier, "selector": name, "args": [_argument(a) for a in args], "in_condition": condition})
    if "selectors" in has:
        for a, dot, b in zip(tokens, tokens[1:], tokens[2:]):
            if dot.text == "." and a.kind == b.kind == "word":
                out["selectors"].append({"line": a.line, "x": a.text, "sel": b.text})
    if "literals" in has:
        out["literals"] += [{"line": t.line, "text": t.text} for t in tokens if t.kind == "str"]


def _function(p: Parser, out: dict, has: frozenset[str]) -> None:
    line = p.line()
    p.at += 1
    recv = recv_name = ""
    if p.peek() == "(":
        end = p.at
        while end < len(p.tokens) and p.tokens[end].text != ")":
            end += 1
        inside = [t.text for t in p.tokens[p.at + 1 : end]]
        inside = inside[: inside.index("[")] if "[" in inside else inside
        star = "*" if "*" in inside else ""
        words = [x for x in inside if x != "*"]
        recv, recv_name = (star + words[-1] if words else ""), (words[0] if len(words) > 1 else "")
        p.at = end + 1
    name = p.peek()
    signature = Node("signature", line)
    p.at += 1
    p.expression(signature, {"{", ";"})
    has_body = p.peek() == "{"
    body = p.block() if has_body else []
    end = p.tokens[max(0, min(p.at, len(p.tokens)) - 1)].line
    called: list[str] = []
    refs = "funcs.refs" in has
    for s in _every(body) if refs or has & {"calls", "selectors", "literals"} else ():
        condition = s.kind in ("if", "for", "switch", "clause")
        _record(s.head, condition, out, has)
        if refs:
            called += [n for _, n, _, _ in _calls(s.head)] + [t.text for t in s.head if t.kind == "word" and t.text not in _KEYWORDS]
    first = next(_calls(body[0].head), None) if body and body[0].kind in ("return", "simple") else None
    single = _wrapped(body)
    out["funcs"].append(
        {
            "name": name, "recv": recv, "recv_name": recv_name, "exported": name[:1].isupper(), "line": line, "end_line": end, "has_body": has_body,
            "cyclomatic": 1 + cyclomatic(body) if "funcs.cyclomatic" in has else None, "cognitive": cognitive(body) if "funcs.cognitive" in has else None,
            "stmt_count": len(body), "refs": sorted(set(called)), "tokens": _flat(body) if "funcs.tokens" in has else None,
            "windows": ["|".join(_flat([s])) for s in body] if "funcs.windows" in has else None, "stmt_lines": [s.line for s in body], "stmt_ends": [s.end for s in body],
            "first_qualifier": first[0] if first else None, "first_call": first[1] if first else None, "wraps": single,
            "signature": _named_types(signature.head), "makes_command": [t.text for t in signature.head][-4:] == ["*", "cobra", ".", "Command"],
        }
    )


def _wrapped(body: list[Node]) -> str | None:
    """What a body only calls: one call by a plain name with plain arguments, or a call and then a bare return."""
    if not 1 <= len(body) <= 2 or body[0].kind not in ("return", "simple") or body[0].inner:
        return None
    tokens = [t for t in body[0].head if t.text != "return"]
    if len(tokens) < 3 or tokens[-1].text != ")":
        return None
    if len(body) == 1:
        if tokens[0].kind != "word" or tokens[1].text != "(" or len(list(_calls(tokens))) != 1:
            return None
        depth = 0
        for t in tokens[1:-1]:
            depth += (t.text == "(") - (t.text == ")")
            if depth == 0:
                return None
        return tokens[0].text
    last = [t for t in body[1].head if t.text != "return"]
    if body[0].kind != "simple" or body[1].kind != "return" or any(t.text in ("=", ":=") for t in tokens) or len(last) > 1 or any(t.kind != "word" for t in last):
        return None
    found = list(_calls(tokens))
    return found[0][1] if found else None


_S, _I, _B = pa.string(), pa.int32(), pa.bool_()
_list = lambda **fields: pa.list_(pa.struct(list(fields.items())))
FACTS = pa.schema(
    [
        ("file", _S), ("package", _S), ("package_line", _I), ("end_line", _I), ("n_types", _I), ("n_decls", _I), ("error", _S), ("refs", pa.list_(_S)),
        ("imports", _list(path=_S, alias=_S, line=_I)), ("names", _list(name=_S, kind=_S, line=_I, exported=_B, types=pa.list_(_S), injected=_B)),
        ("fields", _list(owner=_S, name=_S, line=_I, exported=_B, embedded=_B)), ("iface_methods", _list(owner=_S, name=_S, line=_I)), ("aliases", _list(name=_S, target=_S, line=_I)),
        ("funcs", _list(name=_S, recv=_S, recv_name=_S, exported=_B, line=_I, end_line=_I, has_body=_B, cyclomatic=_I, cognitive=_I, stmt_count=_I, refs=pa.list_(_S), tokens=pa.list_(_S), windows=pa.list_(_S), stmt_lines=pa.list_(_I), stmt_ends=pa.list_(_I), first_qualifier=_S, first_call=_S, wraps=_S, signature=pa.list_(_S), makes_command=_B)),
        ("calls", _list(line=_I, qualifier=_S, selector=_S, args=_list(kind=_S, text=_S), in_condition=_B)), ("selectors", _list(line=_I, x=_S, sel=_S)),
        ("literals", _list(line=_I, text=_S)), ("comments", _list(line=_I, text=_S, decl_line=_I, before_package=_B)),
    ]
)


#: Facts of so many files are held at once.
_FILES = 256
#: Files that one task reads where rows, not sizes, say how much work there is.
FILES_PER_TASK = 2048


@cache
def _paths(schema: pa.Schema) -> tuple[str, ...]:
    """The names of the fields, and of the parts of functions as ``funcs.name``."""
    parts = (f"funcs.{x.name}" for f in schema if f.name == "funcs" for x in f.type.value_type)
    return (*schema.names, *parts)


def _only(fields: tuple[str, ...]) -> pa.Schema:
    """The named fields of :data:`FACTS`, and ``file`` and ``error``; parts of functions are named ``funcs.part``."""
    if not fields:
        return FACTS
    parts = [x for x in FACTS.field("funcs").type.value_type if f"funcs.{x.name}" in fields]
    if missing := set(fields) - set(_paths(FACTS)):
        raise ValueError(f"no such facts: {sorted(missing)}")
    named = [f for f in FACTS if f.name in (*fields, "file", "error")]
    return pa.schema([*named, *([pa.field("funcs", pa.list_(pa.struct(parts)))] if parts else [])])


def dealt(rows: DataFrame, like: DataFrame | None = None, per_task: int = FILES_PER_TASK) -> DataFrame:
    """The rows in a number of partitions that grows with them (or with the rows of a table of no fewer): a small row may stand for a long file, so sizes say little."""
    n = (rows if like is None else like).count()
    return rows.repartition(max(1, -(-n // per_task)))


def extract(files: DataFrame, *fields: str) -> DataFrame:
    """The facts of (file, src) rows, or the named ones (``package``, ``funcs.line`` ...); a file that cannot be read has an ``error`` and no facts."""
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = _only(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _FILES):
                batch = whole.slice(k, _FILES)
                rows = []
                for file, src in zip(batch.column("file").to_pylist(), batch.column("src").to_pylist()):
                    try:
                        rows.append({"file": file, "error": None, **facts(src or "", schema)})
                    except (RecursionError, IndexError) as e:
                        rows.append({"file": file, "error": type(e).__name__})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("file", "src").mapInArrow(run, from_arrow_schema(schema))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(file, src, is_generated, has_build_constraint) of the Go files below a folder."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.go").text(path, wholetext=True)
    rows = whole.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("src"))
    generated = is_generated_path(F.col("file")) | (F.col("src").contains("Code generated") & F.col("src").contains("DO NOT EDIT"))
    return rows.select("file", "src", generated.alias("is_generated"), has_build_constraint(F.col("src")).alias("has_build_constraint"))


def exploded(found: DataFrame, what: str) -> DataFrame:
    """One row for each item of a list of facts, with its file and package."""
    return found.select("file", "package", F.explode(what).alias("x")).select("file", "package", "x.*")


def reexports(found: DataFrame) -> DataFrame:
    """(src_pkg, dst_pkg) of type aliases that name an import, by its alias or the last part of its path; ``found`` has folder."""
    own = exploded(found, "aliases").select("file", F.col("target").alias("x")).join(found.select("file", F.col("folder").alias("src_pkg")), "file")
    named = F.when(F.col("alias") == "", F.regexp_extract("path", "([^/]*)$", 1)).otherwise(F.col("alias"))
    known = exploded(found, "imports").select("file", named.alias("x"), F.col("path").alias("dst_pkg"))
    return own.join(known, ["file", "x"]).select("src_pkg", "dst_pkg").distinct()


def unloaded_imports(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """(import_path): what the source files (file, src) on disk that were not loaded (file) import; tests are no such files."""
    left = files.where(~F.col("file").endswith("_test.go")).join(loaded.select("file").distinct(), "file", "left_anti")
    return exploded(extract(dealt(left, files), "package", "imports"), "imports").select(F.col("path").alias("import_path")).distinct()
