"""Safety rules: a small condition language compiled to a column.

Terms: detected(c), NOT detected(c), absent_for(c, seconds), any_of([c, ...]). An any_of anywhere decides the whole condition; otherwise AND splits
first and OR within its parts, so OR binds tighter; there are no parentheses; whatever is not understood is false.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed order of severities.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    condition: str
    severity: str = "INFO"
    cooldown: float = 60.0
    message: str = ""

    @property
    def level(self) -> int:
        return SEVERITIES.index(self.severity)


#: The language's words, fixed by it: an opening, the kind of term it makes, and how many arguments stand in its parentheses.
WORDS = (("NOT detected", "lacks", 1), ("absent_for", "absent", 2), ("detected", "has", 1))
LIST_WORD = "any_of"


def _arguments(text: str) -> list[str] | None:
    """What stands in the parentheses that text begins with, cut at commas; None if it does not begin so."""
    if not text.startswith("(") or ")" not in text:
        return None
    return [a.strip() for a in text[1 : text.index(")")].split(",")]


def _is_name(text: str) -> bool:
    return text != "" and text.replace("_", "a").isalnum()


def _is_number(text: str) -> bool:
    whole, dot, part = text.partition(".")
    return whole.isdecimal() and (part.isdecimal() if dot else True)


def _term(text: str) -> tuple[str, tuple]:
    words = " ".join(text.split())
    for opening, kind, n in WORDS:
        if not words.startswith(opening):
            continue
        found = _arguments(words[len(opening) :])
        if found and len(found) == n and _is_name(found[0]) and all(map(_is_number, found[1:])):
            return kind, (found[0], *map(float, found[1:]))
    return "never", ()


@lru_cache(maxsize=1024)
def terms(condition: str) -> list[list[tuple[str, tuple]]]:
    """The condition as a conjunction of disjunctions of (kind, arguments)."""
    _, named, rest = condition.partition(f"{LIST_WORD}([")
    inside, closed, _ = rest.partition("])")
    if named and closed and inside and "]" not in inside:
        return [[("has", (c.strip(),)) for c in inside.split(",")]]
    return [[_term(choice) for choice in part.split(" OR ")] for part in condition.strip().split(" AND ")]


def compile_condition(condition: str, classes: Column, frames_since: Column, fps: Column | float, unseen: int = 150) -> Column:
    """The condition over the frame's class names (array) and the frames since each class was last seen (map; a class it lacks counts as `unseen`)."""
    fps = F.greatest(fps if isinstance(fps, Column) else F.lit(float(fps)), F.lit(1.0))

    def one(kind: str, args: tuple) -> Column:
        if kind == "never":
            return F.lit(False)
        if kind == "absent":
            return F.coalesce(F.try_element_at(frames_since, F.lit(args[0])), F.lit(unseen)) / fps >= args[1]
        has = F.coalesce(F.array_contains(classes, args[0]), F.lit(False))
        return has if kind == "has" else ~has

    return reduce(Column.__and__, [reduce(Column.__or__, [one(*t) for t in part]) for part in terms(condition)])


def holds(condition: str, names: set[str], frames_since: dict[str, int], fps: float, unseen: int = 150) -> bool:
    """The same of one frame, for the stateful operator."""

    def one(kind: str, args: tuple) -> bool:
        if kind == "never":
            return False
        if kind == "absent":
            return frames_since.get(args[0], unseen) / max(fps, 1.0) >= args[1]
        return (args[0] in names) == (kind == "has")

    return all(any(one(*t) for t in part) for part in terms(condition))


def load_rules(rows: list[dict]) -> list[Rule]:
    """Of a configuration's rows; those without an id are skipped."""
    return [Rule(r["id"], r.get("condition", ""), r.get("severity", "INFO"), float(r.get("cooldown_seconds", 60)), r.get("message_en", "")) for r in rows if r.get("id")]


@lru_cache(maxsize=64)
def parsed_rules(text: str) -> tuple[Rule, ...]:
    """Rules of a configuration's rows as JSON."""
    return tuple(load_rules(json.loads(text)))


def rules_text(rules: list[Rule] | tuple[Rule, ...]) -> str:
    """The reverse of parsed_rules."""
    return json.dumps([{"id": r.rule_id, "condition": r.condition, "severity": r.severity, "cooldown_seconds": r.cooldown, "message_en": r.message} for r in rules])


def rules_of(table) -> list[Rule]:
    """The rules of a table (id, condition, severity, cooldown_seconds, message_en), in order of id: a configuration, so small."""
    return load_rules([r.asDict() for r in table.orderBy("id").collect()])
