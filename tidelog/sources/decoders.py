"""Decoders of one's own for column types and event codes, with priorities.

A registry is made on the driver and given to the readers, which carry it to the executors. Where several decoders are
registered for one type the strategy says which is used: the one of the highest priority (the earliest of equals), the
latest, the first (later ones are ignored), or none (a second registration is an error).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HIGHEST_PRIORITY, MOST_RECENT, FIRST_WINS, FAIL_ON_CONFLICT = "highest_priority", "most_recent", "first_wins", "fail_on_conflict"
STRATEGIES = (HIGHEST_PRIORITY, MOST_RECENT, FIRST_WINS, FAIL_ON_CONFLICT)
# The named priorities of event decoders.
LOW, NORMAL, HIGH, CRITICAL = 0, 1, 2, 3


@dataclass(frozen=True)
class Entry:
    kind: int
    name: str
    priority: int
    registered: int
    decode: Callable


class Decoders:
    """cells: (cursor over bytes, column) -> text, by column type; events: (cursor, state) -> (body, columns), by event code."""

    def __init__(self, strategy: str = HIGHEST_PRIORITY):
        if strategy not in STRATEGIES:
            raise ValueError(f"no such strategy: {strategy}")
        self.strategy, self.count, self.entries = strategy, 0, {"cells": {}, "events": {}}
        self.names: dict[str, int] = {}
        self.callbacks: list[Callable[[str, int, int], None]] = []

    def _register(self, what: str, kind: int, name: str, decode: Callable, priority: int) -> bool:
        own = self.entries[what].setdefault(kind, [])
        if own and self.strategy == FAIL_ON_CONFLICT:
            raise ValueError(f"a decoder for {kind} is there already: {own[0].name}")
        if own and self.strategy == FIRST_WINS:
            return False
        self.count += 1
        own.append(Entry(kind, name, priority, self.count, decode))
        for call in self.callbacks:
            call(name, kind, priority)
        return True

    def register_type(self, kind: int, name: str, decode: Callable, priority: int = 0, type_name: str | None = None) -> bool:
        """Whether it was taken. type_name: a name under which the type's code is found."""
        taken = self._register("cells", kind, name, decode, priority)
        if taken and type_name:
            self.names[type_name] = kind
        return taken

    def register_event(self, code: int, name: str, decode: Callable, priority: int = NORMAL) -> bool:
        return self._register("events", code, name, decode, priority)

    def unregister(self, what: str, kind: int, name: str) -> bool:
        own = self.entries[what].get(kind, [])
        left = [e for e in own if e.name != name]
        self.entries[what][kind] = left
        return len(left) < len(own)

    def all_of(self, what: str, kind: int) -> list[Entry]:
        """A type's decoders, the one that is used first."""
        order = {MOST_RECENT: lambda e: -e.registered, FIRST_WINS: lambda e: e.registered}.get(self.strategy, lambda e: (-e.priority, e.registered))
        return sorted(self.entries[what].get(kind, []), key=order)

    def chosen(self, what: str) -> dict[int, Callable]:
        return {kind: found[0].decode for kind in self.entries[what] if (found := self.all_of(what, kind))}


def winners(registrations: DataFrame, strategy: str = HIGHEST_PRIORITY) -> DataFrame:
    """The registration (type, name, priority, registered) that is used for each type; none of a type in conflict where that is an error."""
    order = {MOST_RECENT: [F.desc("registered")], FIRST_WINS: [F.asc("registered")]}.get(strategy, [F.desc("priority"), F.asc("registered")])
    own = Window.partitionBy("type")
    out = registrations.withColumns({"_place": F.row_number().over(own.orderBy(*order)), "_n": F.count("*").over(own)}).where("_place = 1")
    return (out.where("_n = 1") if strategy == FAIL_ON_CONFLICT else out).drop("_place", "_n")
