"""Query trees. Any part can be limited to fields; `strict` parts filter, unscored."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    def within(self, *fields: str) -> Fields:
        return Fields(tuple(f.lower() for f in fields), self)

    def __and__(self, other):
        return And((self, other))

    def __or__(self, other):
        return Or((self, other))

    def __invert__(self):
        return Not(self)


@dataclass(frozen=True)
class Term(Node):
    """One term. Without modifiers its inflections count too where `morph` is set;
    `weight` replaces the idf as the query's weight."""

    text: str
    morph: bool = False
    stem: bool = False
    expand: bool = False
    case: bool = False
    exact: bool = False
    weight: float | None = None

    def __post_init__(self):
        if self.exact and (self.morph or self.stem or self.expand):
            raise ValueError("exact excludes morph, stem and expand")


@dataclass(frozen=True)
class TermOr(Node):
    """Several terms counted as one."""

    parts: tuple[Term, ...]


@dataclass(frozen=True)
class _Many(Node):
    parts: tuple[Node, ...]


class And(_Many):
    pass


class Or(_Many):
    pass


@dataclass(frozen=True)
class _One(Node):
    part: Node


class Not(_One):
    pass


class If(_One):
    """Filters without scoring."""


class Hide(_One):
    """Scores, but is not highlighted."""


@dataclass(frozen=True)
class Weight(Node):
    weight: float
    part: Node


@dataclass(frozen=True)
class Fields(Node):
    names: tuple[str, ...]
    part: Node


@dataclass(frozen=True)
class Window(Node):
    """Terms near each other: the distance from the first to the last is `size` at most.
    kind: phrase, near, within, pand, passage."""

    kind: str
    parts: tuple[Node, ...]
    size: int
    ordered: bool = False
    missing: int = 0
    any_term: bool = False


def Phrase(*parts) -> Window:
    return Window("phrase", tuple(parts), len(parts) - 1, True)


def Near(*parts, n: int = 1000) -> Window:
    return Window("near", tuple(parts), n + 1)


def Within(n: int, *parts) -> Window:
    return Window("within", tuple(parts), n)


def PAnd(*parts) -> Window:
    return Window("pand", tuple(parts), 100 + 25 * len(parts), False, min(len(parts) // 2, 9))


def Passage(*parts) -> Window:
    return Window("passage", tuple(parts), 100 + 25 * len(parts), False, min(len(parts) // 2, 9), True)


@dataclass(frozen=True)
class Relation(Node):
    """A saved field compared with a value. op: = != < <= > >= matches substring starts
    ends similar."""

    name: str
    op: str
    value: object


@dataclass(frozen=True)
class Range(Node):
    name: str
    low: object
    high: object
    low_open: bool = False
    high_open: bool = False


@dataclass(frozen=True)
class Undefined(Node):
    name: str


@dataclass(frozen=True)
class MatchAll(Node):
    pass


@dataclass(frozen=True)
class Parsed(Node):
    """Query text as a part of a tree."""

    text: str
    grammar: str = "strict"
    default: str = field(default="and")


def children(node: Node) -> tuple[Node, ...]:
    if isinstance(node, (And, Or, Window, TermOr)):
        return node.parts
    if isinstance(node, (Not, If, Hide, Weight, Fields)):
        return (node.part,)
    return ()


def any_terms(*words: str) -> Or:
    return Or(tuple(Term(w) for w in words))


def all_terms(*words: str) -> And:
    return And(tuple(Term(w) for w in words))
