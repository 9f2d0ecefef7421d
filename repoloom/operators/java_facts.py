"""Call facts of Java sources by a scanner with a stack.

One pass over the tokens of a file, without comments, literals and annotations. Braces open frames (class, enum constants, annotation type, block),
parentheses are matched beforehand, so that what follows an argument list tells a declaration from a call: a name behind a type whose parameters are
followed by a body, ``;``, ``throws`` or ``default`` is declared, everything else is called. Methods belong to the innermost named
class around them, bodies of anonymous classes and of enum constants to the class they stand in. Calls may run over lines, through
lambdas and chains; a call on the result of another call has no qualifier, like one on ``this``. Constructors, their calls and calls of
``super`` are no facts. Broken sources give what can be read.

The scanner takes time in proportion to the file and knows nothing but its row; the rest of the call graph is joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""(?s)/\*.*?(?:\*/|\Z)|//[^\n]*+|\"{3}.*?(?:(?<!\\)\"{3}|\Z)|"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\[^\n])++'|\d[\w.]*+"""
    r"""|(?P<token>[^\W\d][\w$]*+|\$[\w$]*+|->|::|&&|\|\||\.\.\.|[^\s\w])"""
)
# Words of the language that are followed by parentheses or stand before a name without being its type.
_STATEMENTS = frozenset(
    "assert case catch do else extends for if implements import instanceof new package return super switch synchronized this throw throws try while yield".split()
)
_MODIFIERS = frozenset("abstract default final native non private protected public sealed static strictfp synchronized transient volatile".split())
_INSIDE_TYPE_ARGUMENTS = frozenset(".,?&[]<>@")
_KINDS = {"class": "class", "interface": "class", "enum": "enum"}


class Fact(NamedTuple):
    kind: str
    owner: str | None
    name: str
    qualifier: str | None
    params: list[str]


class Scanner:
    """The facts of one source in ``facts``, its package in ``package`` and its first class in ``first_class``."""

    def __init__(self, code: str) -> None:
        self.tokens = [t for m in _TOKEN.finditer(code) if (t := m.group("token")) is not None]
        self.close = self._matching()
        self.facts: list[Fact] = []
        self.package = self.first_class = self.pending = None
        self.frames: list[list] = []  # kind, class name, depth of parentheses
        self.bodies: set[int] = set()  # braces that open a class without a name
        self.depth = 0
        i = 0
        while i < len(self.tokens):
            i = self._step(i)

    def _matching(self) -> dict[int, int]:
        found, open_ = {}, []
        for i, t in enumerate(self.tokens):
            if t == "(":
                open_.append(i)
            elif t == ")" and open_:
                found[open_.pop()] = i
        return found

    def at(self, i: int) -> str:
        return self.tokens[i] if 0 <= i < len(self.tokens) else ""

    def _is_name(self, i: int) -> bool:
        t = self.at(i)
        return t[:1].isalpha() or t[:1] in ("_", "$") and t != ""

    def _owner(self) -> str | None:
        return next((f[1] for f in reversed(self.frames) if f[0] != "block"), None)

    # ------------------------------------------------------------ frames

    def _step(self, i: int) -> int:
        t = self.tokens[i]
        if t == "@":
            return self._annotation(i)
        if t == "{":
            kind, name = self.pending or (("class", self._owner()) if i in self.bodies else ("block", None))
            self.pending = None
            self.frames.append([kind, name, self.depth])
        elif t == "}":
            if self.frames:
                self.depth = self.frames.pop()[2]
        elif t == "(":
            self.depth += 1
            if self.at(i - 1) == ">":
                self._creator_with_type_arguments(i)
        elif t == ")":
            self.depth = max(self.depth - 1, 0)
        elif t == ";":
            if self.frames and self.frames[-1][0] == "enum" and self.depth == self.frames[-1][2]:
                self.frames[-1][0] = "class"
        elif t == "package" and self.package is None and not self.frames:
            j = i + 1
            while self._is_name(j) or self.at(j) == ".":
                j += 1
            self.package = "".join(self.tokens[i + 1 : j]) or None
            return j
        elif t in _KINDS and self.at(i - 1) not in (".", "::") and self._is_name(i + 1):
            return self._class(_KINDS[t], i + 1)
        elif t == "record" and self._is_name(i + 1) and self.at(self._after_parameters(i + 2)) in ("{", "implements"):
            self._class("class", i + 1)
            return self._after_parameters(i + 2)
        elif self.at(i + 1) == "(" and self._is_name(i):
            self._named(i)
        return i + 1

    def _class(self, kind: str, name: int) -> int:
        self.pending = (kind, self.tokens[name])
        if self.tokens[name - 1] == "class" and self.first_class is None:
            self.first_class = self.tokens[name]
        return name + 1

    def _annotation(self, i: int) -> int:
        if self.at(i + 1) == "interface" and self._is_name(i + 2):
            return self._class("annotation", i + 2)
        j = i + 1
        while self._is_name(j):
            j += 2 if self.at(j + 1) == "." else 1
            if self.at(j - 1) != ".":
                break
        return self.close.get(j, j - 1) + 1 if self.at(j) == "(" else max(j, i + 1)

    def _after_parameters(self, i: int) -> int:
        """Place behind type parameters and a parameter list that begin at ``i``; -1 where there is no list."""
        if self.at(i) == "<":
            level, i = 1, i + 1
            while level and i < len(self.tokens) and self.tokens[i] not in "(){};":
                level += {"<": 1, ">": -1}.get(self.tokens[i], 0)
                i += 1
        return self.close[i] + 1 if i in self.close else -1

    def _creator_with_type_arguments(self, i: int) -> None:
        opened = self._type_arguments(i - 1)
        if opened is not None and self.at(self._chain(opened - 1) - 1) == "new":
            self._body_behind(i)

    def _body_behind(self, opening: int) -> None:
        closing = self.close.get(opening)
        if closing is not None and self.at(closing + 1) == "{":
            self.bodies.add(closing + 1)

    # ------------------------------------------------------------ names before parentheses

    def _chain(self, i: int) -> int:
        """First name of the dotted names that end at ``i``."""
        while self.at(i - 1) == "." and self._is_name(i - 2):
            i -= 2
        return i

    def _type_arguments(self, i: int) -> int | None:
        """Place of the ``<`` that the ``>`` at ``i`` closes, if only a type stands between them."""
        level = 0
        while i >= 0 and (self._is_name(i) or self.tokens[i] in _INSIDE_TYPE_ARGUMENTS):
            level += {">": 1, "<": -1}.get(self.tokens[i], 0)
            if level == 0:
                return i
            i -= 1
        return None

    def _ends_type(self, i: int) -> bool:
        if self.at(i) == "]" and self.at(i - 1) == "[":
            return self._ends_type(i - 2)
        if self.at(i) == ">":
            opened = self._type_arguments(i)
            return opened is not None and self._ends_type(opened - 1)
        return self._is_name(i) and self.at(i) not in _STATEMENTS and self.at(i) not in _MODIFIERS

    def _named(self, i: int) -> None:
        name, opening = self.tokens[i], i + 1
        if name in _STATEMENTS:
            return
        first = self._chain(i)
        closing = self.close.get(opening)
        behind = (closing if closing is not None else len(self.tokens)) + 1
        while self.at(behind) == "[" and self.at(behind + 1) == "]":
            behind += 2
        if self.at(first - 1) == "new":
            self._body_behind(opening)
        elif self.frames and self.frames[-1][0] == "enum" and self.depth == self.frames[-1][2] and first == i and self.at(i - 1) != ".":
            self._body_behind(opening)
        elif first == i and self.at(behind) in ("{", ";", "throws", "default") and self._ends_type(i - 1):
            if not self.frames or self.frames[-1][0] != "annotation":
                self.facts.append(Fact("decl", self._owner(), name, None, self._parameters(opening + 1, closing)))
        elif first == i and self.at(i - 1) != "." and self.at(behind) in ("{", "throws"):
            pass  # a constructor
        else:
            self._call(i, first)

    def _call(self, i: int, first: int) -> None:
        names = self.tokens[first:i:2]
        if self.at(i - 1) == ">":
            # a.<T>f(): the qualifier stands before the type argument.
            opened = self._type_arguments(i - 1)
            if opened is not None and self.at(opened - 1) == "." and self._is_name(opened - 2):
                first = self._chain(opened - 2)
                names = self.tokens[first : opened - 1 : 2]
        if names[-1:] == ["super"] or self.at(i - 1) == "::":
            return
        inner = self.at(first - 1) == "." or "this" in names or "super" in names
        self.facts.append(Fact("call", self._owner(), self.tokens[i], ".".join(names) if names and not inner else None, []))

    def _parameters(self, i: int, end: int) -> list[str]:
        """Simple type names of the parameters between two places, without type arguments and dimensions."""
        types, names, level, dotted = [], [], 0, True
        while i <= end:
            t = self.tokens[i]
            if t == "@":
                i = self._annotation(i)
                continue
            if i == end or (t == "," and level == 0):
                if len(names) > 1 and self.at(i - 1) != "this":
                    types.append(names[0])
                names = []
            elif t in "<>":
                level += 1 if t == "<" else -1
            elif level == 0 and self._is_name(i) and t != "final":
                if names and self.at(i - 1) == ".":
                    names[-1] = t
                else:
                    names.append(t)
            i += 1
        return types


def scan(code: str) -> tuple[str | None, str | None, list[Fact]]:
    """Package, first class and facts of a source, in its order."""
    s = Scanner(code)
    return s.package, s.first_class, s.facts


def scanned_call_facts(files: DataFrame, compat: bool = False) -> DataFrame:
    """Facts (file_no, pos, kind, file_path, package, class, name, qualifier, param_types) of Java files (file_no, path, text).

    ``compat`` gives all facts to the first class of the file, and none where there is no class. A null text has no facts.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema(
            [("file_no", pa.int64()), ("pos", pa.int64())]
            + [(c, pa.string()) for c in ("kind", "file_path", "package", "class", "name", "qualifier")]
            + [("param_types", pa.list_(pa.string()))]
        )
        for batch in batches:
            for number, path, text in zip(*(c.to_pylist() for c in batch.columns)):
                package, first, facts = scan(text or "")
                owned = [f._replace(owner=first) for f in facts] if compat else facts
                rows = [(number, i, f.kind, path, package or "default", f.owner, f.name, f.qualifier, f.params) for i, f in enumerate(owned) if f.owner is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    rows = files.select(F.col("file_no").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "file_no long, pos long, kind string, file_path string, package string, class string, name string, qualifier string, param_types array<string>")
