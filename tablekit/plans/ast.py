"""What statements say."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..schema import Meta


@dataclass(frozen=True)
class Literal:
    """A constant as written: text, a number's digits, or None for NULL."""

    value: str | None
    quoted: bool = False


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: Literal


@dataclass(frozen=True)
class InList:
    column: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Between:
    column: str
    low: Literal
    high: Literal


@dataclass(frozen=True)
class IsNull:
    column: str


@dataclass(frozen=True)
class Not:
    term: Any


@dataclass(frozen=True)
class And:
    terms: tuple


@dataclass(frozen=True)
class Or:
    terms: tuple


@dataclass(frozen=True)
class Item:
    """A selected column, or an aggregate with its arguments; ``text`` is the expression as written."""

    text: str
    column: str | None = None
    function: str | None = None
    arguments: tuple[str, ...] = ()
    alias: str | None = None

    @property
    def name(self) -> str:
        return (self.alias or self.text).lower()


@dataclass
class Select:
    items: list[Item]
    table: str
    star: bool = False
    distinct: bool = False
    index: str | None = None
    descending: bool = False
    where: Any = None
    group_by: list[str] = field(default_factory=list)
    having: Any = None
    order_by: list[tuple[str, bool]] = field(default_factory=list)
    offset: int = 0
    limit: int = -1
    into: str | None = None


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    values: list[Literal] | None = None
    source: Select | None = None
    replace: bool = False
    ignore: bool = False


@dataclass
class Update:
    table: str
    assignments: list[tuple[str, Literal]]
    where: Any


@dataclass
class Delete:
    table: str
    where: Any


@dataclass
class Create:
    meta: Meta
    table: str
    temporary: bool = False


@dataclass
class Simple:
    """DROP, DESC, META, SHOW, BEGIN, COMMIT and ROLLBACK."""

    verb: str
    target: str | None = None
    recursive: bool = False
