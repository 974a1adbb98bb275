"""The match language: terms, "phrases", AND, OR, NOT, parentheses, prefix stars."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of the smallest thing that can be searched for.
LEAST = 3
COLUMN = "text"

_TOKEN = re.compile(r'\s+|"((?:[^"]|"")*)"(\s*\*)?|([A-Za-z0-9_\u0080-\U0010ffff\x1a]+)|([():*])')


class MatchSyntaxError(ValueError):
    """The text is not a query."""


@dataclass(frozen=True)
class Node:
    """``phrase``, ``and``, ``or``, ``not`` or ``nothing`` (a phrase too short to search for)."""

    kind: str
    parts: tuple = ()
    phrase: int = -1


@dataclass(frozen=True)
class Match:
    root: Node
    phrases: tuple[str, ...]

    def condition(self, has: list[Column], node: Node | None = None) -> Column:
        """Whether a row matches; ``has[i]`` says that it contains phrase i."""
        node = node or self.root
        if node.kind == "phrase":
            return has[node.phrase]
        if node.kind == "nothing":
            return F.lit(False)
        a, b = (self.condition(has, p) for p in node.parts)
        return a & b if node.kind == "and" else a | b if node.kind == "or" else a & ~b

    def counted(self, has: list[Column]) -> list[Column | None]:
        """For each phrase, when it adds to a matching row's score (None: always).

        A phrase counts only where every part of the query around it matches.
        """
        out: list[Column | None] = [None] * len(self.phrases)

        def walk(node: Node, under: Column | None) -> None:
            if node.kind == "phrase":
                out[node.phrase] = under
            for i, part in enumerate(node.parts):
                if node.kind == "not" and i == 1:
                    walk(part, F.lit(False))
                elif node.kind == "or":
                    own = self.condition(has, part)
                    walk(part, own if under is None else under & own)
                else:
                    walk(part, under)

        walk(self.root, None)
        return out


class _Parser:
    def __init__(self, query: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(query):
            found = _TOKEN.match(query, at)
            if not found:
                raise MatchSyntaxError(f"unexpected {query[at]!r} in {query!r}")
            at = found.end()
            if found[1] is not None:
                self.tokens.append(("phrase", found[1].replace('""', '"')))
            elif found[3]:
                word = found[3]
                self.tokens.append(("op", word) if word in ("AND", "OR", "NOT") else ("word", word))
            elif found[4]:
                self.tokens.append((found[4], found[4]))
        self.at, self.phrases = 0, []

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def parse(self) -> Match:
        root = self.any_of()
        if self.peek()[0] != "end":
            raise MatchSyntaxError(f"unexpected {self.peek()[1]!r}")
        return Match(root, tuple(self.phrases))

    def any_of(self) -> Node:
        node = self.all_of()
        while self.peek() == ("op", "OR"):
            self.take()
            node = self.join("or", node, self.all_of())
        return node

    def all_of(self) -> Node:
        node = self.but_not()
        while self.peek() == ("op", "AND"):
            self.take()
            node = self.join("and", node, self.but_not())
        return node

    def but_not(self) -> Node:
        node = self.side_by_side()
        while self.peek() == ("op", "NOT"):
            self.take()
            node = self.join("not", node, self.side_by_side())
        return node

    @staticmethod
    def join(kind: str, a: Node, b: Node) -> Node:
        if kind == "or" and "nothing" in (a.kind, b.kind):
            return b if a.kind == "nothing" else a
        if kind == "not" and b.kind == "nothing":
            return a
        return Node(kind, (a, b))

    def side_by_side(self) -> Node:
        """Things next to each other must all match; what is too short is passed over."""
        node = self.single()
        while self.peek()[0] in ("word", "phrase", "("):
            other = self.single()
            if "nothing" in (node.kind, other.kind):
                node = other if node.kind == "nothing" else node
            else:
                node = Node("and", (node, other))
        return node

    def single(self) -> Node:
        kind, value = self.take()
        if kind == "(":
            node = self.any_of()
            if self.take()[0] != ")":
                raise MatchSyntaxError("a parenthesis is not closed")
            return node
        if kind == "word" and self.peek()[0] == ":":
            if value.lower() != COLUMN:
                raise MatchSyntaxError(f"no such column: {value}")
            self.take()
            return self.single()
        if kind not in ("word", "phrase"):
            raise MatchSyntaxError(f"unexpected {value!r}" if value else "the query ends too early")
        if self.peek()[0] == "*":
            self.take()
        if len(value) < LEAST:
            return Node("nothing")
        self.phrases.append(value.lower())
        return Node("phrase", phrase=len(self.phrases) - 1)


def parse_match(query: str) -> Match:
    """Parse a query; raises :class:`MatchSyntaxError`."""
    return _Parser(query).parse()


def overlaps_itself(phrase: str) -> bool:
    """Whether two occurrences can share characters."""
    return any(phrase.endswith(phrase[:k]) for k in range(1, len(phrase)))


def occurrences(text: Column, phrase: str) -> Column:
    """Occurrences of a phrase in (lower-cased) text, overlapping ones too."""
    if overlaps_itself(phrase):
        return F.regexp_count(text, F.lit("(?=" + re.escape(phrase) + ")"))
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))).cast("int")
