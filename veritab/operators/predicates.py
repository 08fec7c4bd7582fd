"""Candidate predicates from column roles: which comparisons make sense, and as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import logic
from veritab.operators import profile

OPERATORS = {"=": logic.eq, "!=": logic.ne, ">": logic.gt, ">=": logic.ge, "<": logic.lt, "<=": logic.le}
ORDERING = (">", ">=", "<", "<=")
#: Roles that make columns comparable by order; the first that a column has is its group.
GROUPS = ("size", "count", "time", "sequence")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # integer, real, categorical, string, boolean
    roles: tuple[str, ...] = ()
    constants: tuple = ()
    scalars: tuple = ()
    additions: tuple = ()
    #: names of the constants in the predicates' texts, where they have any (p50, top1)
    labels: tuple[str, ...] = ()
    #: name of the column family, for columns of a context window
    family: str | None = None

    @property
    def ordered(self) -> bool:
        return self.kind in ("integer", "real")

    @property
    def group(self) -> str | None:
        return next((g for g in GROUPS if g in self.roles), None)

    def column(self) -> Column:
        return F.col(f"`{self.name}`")


@dataclass(frozen=True)
class Predicate:
    text: str
    #: makes the column when it is asked for, so that predicates can be listed without a session
    make: Callable[[], Column] = field(compare=False)
    #: (left text, operator, right text), where the predicate is one comparison
    parts: tuple[str, str, str] | None = None

    @property
    def column(self) -> Column:
        return self.make()


def compare(left: str, a: Callable[[], Column], op: str, right: str, b: Callable) -> Predicate:
    return Predicate(f"{left} {op} {right}", lambda: OPERATORS[op](a(), b()), (left, op, right))


def field_constant(fields: Iterable[Field], ops: Sequence[str]) -> list[Predicate]:
    """Each field against its constants; order only for ordered fields."""
    out = []
    for f in fields:
        for i, k in enumerate(f.constants):
            text = f.labels[i] if i < len(f.labels) and f.labels[i] else repr(k) if isinstance(k, str) else str(k)
            out += [compare(f.name, f.column, op, text, lambda k=k: k) for op in ops if f.ordered or op not in ORDERING]
    return out


def select_fields(
    fields: Iterable[Field], names: Iterable[str] = (), pattern: str | None = None, kinds: Iterable[str] = (), roles: Iterable[str] = (),
    exclude: Iterable[str] = (), derived: bool | None = None, family: str | None = None, window: bool | None = None,
) -> list[Field]:
    """Fields that meet every condition given, in the order of `names` if there are any: the pattern found in the name, one of the kinds, one of the roles,
    not excluded, derived or not (role "derived"), of that family, of any window family or of none.
    """
    by_name = {f.name: f for f in fields}
    kinds, roles, exclude = set(kinds), set(roles), set(exclude)
    chosen = [by_name[n] for n in (list(names) or by_name) if n in by_name and n not in exclude]
    return [
        f for f in chosen
        if (pattern is None or re.search(pattern, f.name)) and (not kinds or f.kind in kinds) and (not roles or roles & set(f.roles))
        and derived in (None, "derived" in f.roles) and family in (None, f.family) and window in (None, f.family is not None)
    ]


def profiled(df: DataFrame, fields: Sequence[Field], quantiles: Sequence[float] = (0.5,), top: int = 1, whole_domain: bool = False) -> list[Field]:
    """The fields with constants from the table: quantiles of ordered ones (p50), the commonest values (top1) or the domain of the others.

    What reaches the driver are the constants: as many as are asked for; of a domain, one for each value of a categorical field.
    """
    ordered = [f.name for f in fields if f.ordered]
    found: dict[str, list] = {f.name: [] for f in fields}
    if ordered:
        for r in profile.quantiles(df, ordered, quantiles).collect():
            found[r["column"]].append((int(r["label"][1:]), r["label"], r["value"]))
    for f in fields:
        if not f.ordered:
            rows = profile.domain(df, f.name).orderBy("value") if whole_domain else profile.top_values(df, f.name, top)
            found[f.name] = [(i, "" if whole_domain else f"top{i}", r["value"]) for i, r in enumerate(rows.collect(), 1)]
    return [replace(f, constants=tuple(v for *_, v in sorted(found[f.name], key=lambda x: x[0])), labels=tuple(n for _, n, _ in sorted(found[f.name], key=lambda x: x[0]))) for f in fields]


def unknown_fields(predicates: Iterable[Predicate], columns: Iterable[str], uses: Callable[[Predicate], Iterable[str]] | None = None) -> dict[str, list[str]]:
    """Texts of predicates or rules that name columns a table lacks, each with those names in order. uses: the names in one, its `fields` by default."""
    have = set(columns)
    missing = {p.text: [c for c in (uses(p) if uses else p.fields) if c not in have] for p in predicates}
    return {t: m for t, m in missing.items() if m}


def _comparable(a: Field, b: Field, ops: Sequence[str]) -> bool:
    if any(op in ORDERING for op in ops):
        return a.ordered and b.ordered and a.group is not None and a.group == b.group
    return a.kind == b.kind or {a.kind, b.kind} == {"categorical", "string"}


def field_field(fields: Sequence[Field], ops: Sequence[str], right: Sequence[Field] | None = None, same_field: bool = False) -> list[Predicate]:
    """Each pair of different comparable fields, in one direction; with a right side of its own, each left field with each right one."""
    if right is not None:
        pairs = ((a, b) for a in fields for b in right if same_field or a.name != b.name)
        return [compare(a.name, a.column, op, b.name, b.column) for a, b in pairs if _comparable(a, b, ops) for op in ops]
    return [compare(a.name, a.column, op, b.name, b.column) for i, a in enumerate(fields) for b in fields[i + 1 :] if _comparable(a, b, ops) for op in ops]


def scaled_field(fields: Sequence[Field], ops: Sequence[str]) -> list[Predicate]:
    """a * k against b, for a's scalars; groups don't matter, as a scalar changes the unit."""
    return [compare(f"({a.name} * {k})", lambda a=a, k=k: a.column() * F.lit(k), op, b.name, b.column) for a in fields for k in a.scalars for b in fields if a.name != b.name and a.ordered and b.ordered for op in ops]


def summed_fields(fields: Sequence[Field], ops: Sequence[str]) -> list[Predicate]:
    """a + b, or a + constant, against c: within one group, or sequence + size against sequence."""
    out = []
    for i, a in enumerate(fields):
        for b in fields:
            group = a.group if a.group == b.group and fields.index(b) > i else "sequence" if (a.group, b.group) == ("sequence", "size") else None
            if group is None or not (a.ordered and b.ordered):
                continue
            for c in fields:
                if c.name not in (a.name, b.name) and c.ordered and c.group == group:
                    out += [compare(f"({a.name} + {b.name})", lambda a=a, b=b: a.column() + b.column(), op, c.name, c.column) for op in ops]
        for k in a.additions:
            for c in fields:
                if c.name != a.name and a.ordered and c.ordered and a.group and a.group == c.group:
                    out += [compare(f"({a.name} + {k})", lambda a=a, k=k: a.column() + F.lit(k), op, c.name, c.column) for op in ops]
    return out


@dataclass(frozen=True)
class Term:
    """A side of a comparison: a field, a field times a number, a sum of fields, a field plus a number, or a constant."""

    text: str
    make: Callable[[], Column]
    fields: tuple[str, ...]
    #: as of Field; of a constant, that of its value
    kind: str
    group: str | None
    #: a scaled field compares with any ordered field, as a scalar changes the unit
    scaled: bool = False

    @property
    def ordered(self) -> bool:
        return self.kind in ("integer", "real")


def field_terms(fields: Sequence[Field]) -> list[Term]:
    return [Term(f.name, f.column, (f.name,), f.kind, f.group) for f in fields]


def constant_terms(values: Iterable) -> list[Term]:
    kind = lambda v: "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "real" if isinstance(v, float) else "string"
    return [Term(repr(v) if isinstance(v, str) else str(v), lambda v=v: F.lit(v), (), kind(v), None) for v in values]


def scaled_terms(fields: Sequence[Field]) -> list[Term]:
    """Each ordered field times its scalars."""
    return [Term(f"({f.name} * {k})", lambda f=f, k=k: f.column() * F.lit(k), (f.name,), "real" if isinstance(k, float) else f.kind, f.group, True) for f in fields if f.ordered for k in f.scalars]


def sum_terms(fields: Sequence[Field]) -> list[Term]:
    """Sums of two ordered fields of a group, and each ordered field plus its additions."""
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :] if a.ordered and b.ordered and a.group and a.group == b.group]
    wider = lambda a, b: "real" if "real" in (a, b) else "integer"
    sums = [Term(f"({a.name} + {b.name})", lambda a=a, b=b: a.column() + b.column(), (a.name, b.name), wider(a.kind, b.kind), a.group) for a, b in pairs]
    return sums + [Term(f"({f.name} + {k})", lambda f=f, k=k: f.column() + F.lit(k), (f.name,), f.kind, f.group) for f in fields if f.ordered for k in f.additions]


def _compatible(a: Term, b: Term, op: str) -> bool:
    """Order is for numbers. Two numbers with fields need one group on both sides, unless one is scaled or they are only asked to be equal and differ in
    kind; constants go with any number. Others need one kind, where categories and strings are one."""
    if not (a.ordered and b.ordered):
        return op not in ORDERING and (a.kind == b.kind or {a.kind, b.kind} == {"categorical", "string"})
    if not (a.fields and b.fields) or a.scaled or b.scaled or (op not in ORDERING and a.kind != b.kind):
        return True
    return a.group is not None and a.group == b.group


def term_term(left: Sequence[Term], right: Sequence[Term], ops: Sequence[str], same_field: bool = False) -> list[Predicate]:
    """Compatible terms of any kinds against each other; no field on both sides, unless same_field."""
    return [
        compare(a.text, a.make, op, b.text, b.make)
        for a in left for b in right for op in ops
        if (same_field or not set(a.fields) & set(b.fields)) and (a.fields or b.fields) and _compatible(a, b, op)
    ]


def check_shape(left: Sequence | None, field: Sequence | None = None, constant: Sequence | None = None, term: Sequence | None = None) -> None:
    """A template of comparisons has a left side and exactly one right side."""
    if left is None:
        raise ValueError("a template needs a left side")
    if sum(x is not None for x in (field, constant, term)) != 1:
        raise ValueError("a template needs exactly one right side: fields, constants or terms")


def labelled_constants(fields: Iterable[Field], of_families: Iterable[Field] = ()) -> dict[str, dict[str, dict]]:
    """The named constants of fields and of families: {"fields": {name: {label: value}}, "families": ...}; the first value of a label stays."""
    out: dict[str, dict[str, dict]] = {"fields": {}, "families": {}}
    for kind, items in (("fields", fields), ("families", of_families)):
        for f in items:
            for label, value in zip(f.labels, f.constants):
                if label:
                    out[kind].setdefault(f.name, {}).setdefault(label, value)
    return out


def quantified(family: Sequence[str], name: str, ops: Sequence[str], constants: Sequence, every: bool = True) -> list[Predicate]:
    """All (or any) columns of a family against constants; ordering comparisons need only the least or greatest column."""

    def holds(op, k) -> Column:
        cols = [F.col(f"`{c}`") for c in family]
        if op in ORDERING:
            return OPERATORS[op](logic.row_min(*cols) if (op[0] == ">") == every else logic.row_max(*cols), k)
        return (logic.all_of if every else logic.any_of)([OPERATORS[op](c, k) for c in cols])

    return [Predicate(f"{'forall' if every else 'exists'} {name} {op} {k}", lambda op=op, k=k: holds(op, k)) for op in ops for k in constants]


def distinct(predicates: Iterable[Predicate]) -> list[Predicate]:
    """One for each text, in order of text; a predicate's number is its place."""
    return [p for _, p in sorted({p.text: p for p in predicates}.items())]
