"""Questions in the ontology's words, rewritten over the mappings (Q0).

A pattern names no mapping. It becomes the union of all that can give its triples: literals and links of every mapping, links
of the inverse property the other way round, and for a class what the mappings assert of it and its subclasses and what
the domains and ranges of properties entail. Every access knows the kind of its subject and object (the subject template,
or a literal's type), and terms of different kinds are never equal; so an assignment of kinds to variables prunes the union, and
assignments have no solution in common.

The graph is a set of triples and keys are unique in their tables (see `answer` for others), so one access gives each triple once; only patterns that several
accesses of the same kinds give are made distinct. A class pattern that another pattern of the variable entails is dropped, and
patterns that read one row of one table become one projection of it. What is left are equi-joins on raw keys, for Catalyst to order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplake.functions.scalars import resource
from triplake.operators.entailment import SUBCLASSES, closure, implied
from triplake.operators.mapping import MAPPINGS, SPARK_TYPE, Mapping

CLASS = "a"


@dataclass(frozen=True)
class Triple:
    """A pattern; terms that start with ? are variables, p is a property or CLASS, o a variable, a class or a constant literal."""

    s: str
    p: str
    o: object

    @property
    def variables(self) -> list[str]:
        return [x for x in (self.s, self.o) if isinstance(x, str) and x.startswith("?")]


@dataclass(frozen=True)
class Access:
    """Columns of a table that give pairs of subject and object; kinds tell their templates or types. A class has no object."""

    table: str
    subject: str
    subject_kind: str
    object: str | None = None
    object_kind: str | None = None
    unique: str | None = None  # the side whose column is the table's key
    classes: tuple[str, ...] = ()  # what is entailed of the key's subject by its mapping

    @property
    def kinds(self) -> tuple[str, str | None]:
        return self.subject_kind, self.object_kind


def readable(tables: dict[str, DataFrame], mappings: tuple[Mapping, ...]) -> list[tuple[Mapping, str, str, str, bool]]:
    """(mapping, property, column, kind or type, whether it is a link) of all terms whose columns exist."""
    out = []
    for m in mappings:
        if m.table in tables:
            have = set(m.columns or tables[m.table].columns) & set(tables[m.table].columns)
            out += [(m, p, c, t, False) for p, c, t in m.literals if c in have]
            out += [(m, p, c, kind, True) for p, kind, c in m.links if c in have]
    return out


def accesses(pattern: Triple, tables: dict[str, DataFrame], mappings: tuple[Mapping, ...] = MAPPINGS, parents: dict = SUBCLASSES) -> list[Access]:
    """All accesses that give the pattern's triples in the entailed graph."""
    above: dict[str, set[str]] = {}
    for c, a in closure(parents):
        above.setdefault(c, {c}).add(a)
    up = lambda cls: above.get(cls, {cls}) if cls else set()
    of, to, inverse = implied(parents)
    found: list[Access] = []
    terms = readable(tables, mappings)
    if pattern.p == CLASS:
        found += [Access(m.table, m.key, m.kind, unique="s") for m in mappings if m.table in tables and pattern.o in up(m.cls)]
        asserted = {(a.table, a.subject) for a in found}  # the key's class needs no value of the row
        for m, p, c, kind, link in terms:
            if pattern.o in of.get(p, ()) and (m.table, m.key) not in asserted:
                found.append(Access(m.table, m.key, m.kind, c, kind, "s"))
            if link and pattern.o in to.get(p, ()):
                found.append(Access(m.table, c, kind))
        return list(dict.fromkeys(Access(a.table, a.subject, a.subject_kind, a.object if a.unique else None, None, a.unique) for a in found))
    for m, p, c, kind, link in terms:
        if p == pattern.p:
            found.append(Access(m.table, m.key, m.kind, c, kind, "s", tuple(sorted(up(m.cls)))))
        if link and inverse.get(p) == pattern.p:
            found.append(Access(m.table, c, kind, m.key, m.kind, "o", tuple(sorted(up(m.cls)))))
    return list(dict.fromkeys(found))


def assignments(patterns: list[Triple], every: list[list[Access]]) -> Iterator[tuple[dict[str, str], list[list[Access]]]]:
    """Kinds of the variables under which every pattern has an access, and each pattern's accesses then."""

    def go(i: int, kinds: dict[str, str], chosen: list[list[Access]]) -> Iterator[tuple[dict[str, str], list[list[Access]]]]:
        if i == len(patterns):
            yield kinds, chosen
            return
        pattern, options = patterns[i], {}
        for a in every[i]:
            options.setdefault(a.kinds if pattern.p != CLASS else (a.subject_kind, None), []).append(a)
        for (s, o), own in options.items():
            new = {pattern.s: s} | ({pattern.o: o} if len(pattern.variables) > 1 else {})
            if pattern.s == pattern.o and s != o:
                continue
            if all(kinds.get(v, k) == k for v, k in new.items()):
                yield from go(i + 1, kinds | new, [*chosen, own])

    yield from go(0, {}, [])


def _entailed_by(pattern: Triple, others: list[tuple[Triple, list[Access]]], of: dict, to: dict) -> bool:
    """Whether every solution of some other pattern has the class pattern's triple."""
    for other, own in others:
        if other.p == CLASS:
            continue
        if other.s == pattern.s and (pattern.o in of.get(other.p, ()) or all(a.unique == "s" and pattern.o in a.classes for a in own)):
            return True
        if other.o == pattern.s and (pattern.o in to.get(other.p, ()) or all(a.unique == "o" and pattern.o in a.classes for a in own)):
            return True
    return False


def _value(df: DataFrame, column: str, kind: str | None) -> Column:
    """A literal in its type, a key as text, so that keys of one kind meet whatever their columns' types."""
    return F.col(column).cast(SPARK_TYPE[kind]) if kind in SPARK_TYPE else F.col(column).cast("string")


def answer(tables: dict[str, DataFrame], patterns: list[Triple], select: list[str], where: Column | None = None, mappings: tuple[Mapping, ...] = MAPPINGS, parents: dict = SUBCLASSES, unique: bool = True) -> DataFrame:
    """The bag of solutions of the patterns over the entailed graph, projected to the variables of `select` (without ?).

    Variables of subjects come out as IRIs, others as typed values. Where kinds of a variable differ in type, it comes out as text.
    Where keys may repeat in their tables (unique is False), every pattern is read and made distinct on its own.
    """
    of, to, _ = implied(parents)
    every = [accesses(p, tables, mappings, parents) for p in patterns]
    members = []
    for kinds, chosen in assignments(patterns, every):
        rest = list(zip(patterns, chosen, strict=True))
        for item in [x for x in rest if x[0].p == CLASS]:
            others = [x for x in rest if x is not item]
            twin = any(x[0] == item[0] for x in others)
            if twin or _entailed_by(item[0], others, of, to):
                rest = others
        members.append((kinds, _joined(tables, rest, unique)))
    types = {v: {"string" if k not in SPARK_TYPE else SPARK_TYPE[k] for k in {kinds[f"?{v}"] for kinds, _ in members}} for v in select}
    told = []
    for kinds, df in members:
        shown = lambda v, k: F.col(f"?{v}") if k in SPARK_TYPE else resource(k, F.col(f"?{v}"))
        told.append(df.select(*[(shown(v, kinds[f"?{v}"]).cast("string") if len(types[v]) > 1 else shown(v, kinds[f"?{v}"])).alias(v) for v in select]))
    if not told:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], ", ".join(f"`{v}` string" for v in select))
    out = reduce(DataFrame.unionByName, told)  # solutions of different kinds are different
    return out.where(where) if where is not None else out


def _joined(tables: dict[str, DataFrame], patterns: list[tuple[Triple, list[Access]]], unique: bool) -> DataFrame:
    """Solutions with a column for each variable, named with its ?."""
    rows: dict[tuple[str, str, str], DataFrame] = {}  # by table, key column and the key's variable
    frames: list[DataFrame] = []
    for pattern, own in patterns:
        if unique and len(own) == 1 and own[0].unique:
            a = own[0]
            on_subject = a.unique == "s"
            key, variable = (a.subject, pattern.s) if on_subject else (a.object, pattern.o)
            place = (a.table, key, variable)
            held = rows.get(place)
            if held is None:
                held = tables[a.table].where(F.col(key).isNotNull()).withColumn(variable, _value(tables[a.table], key, None))
            if pattern.p == CLASS:
                rows[place] = held if a.object is None else held.where(F.col(a.object).isNotNull())
                continue
            column, kind, term = (a.object, a.object_kind, pattern.o) if on_subject else (a.subject, a.subject_kind, pattern.s)
            rows[place] = _bound(held, _value(held, column, kind), term)
        else:
            parts = []
            for a in own:
                df = tables[a.table].where(F.col(a.subject).isNotNull())
                df = df.where(F.col(a.object).isNotNull()) if a.object else df
                df = df.withColumn(pattern.s, _value(df, a.subject, a.subject_kind))
                df = df if pattern.p == CLASS else _bound(df, _value(df, a.object, a.object_kind), pattern.o)
                parts.append(df.select(*[c for c in df.columns if c.startswith("?")]))
            frames.append(reduce(DataFrame.unionByName, parts).distinct())
    frames += [df.select(*[c for c in df.columns if c.startswith("?")]) for df in rows.values()]
    out, rest = frames[0], frames[1:]
    while rest:
        nxt = next((f for f in rest if set(f.columns) & set(out.columns)), None)
        if nxt is None:
            raise ValueError("the patterns share no variable")
        rest = [f for f in rest if f is not nxt]
        out = out.join(nxt, sorted(set(out.columns) & set(nxt.columns)))
    return out


def _bound(df: DataFrame, value: Column, term: object) -> DataFrame:
    """df where the value is the term: a constant, a variable with a column already, or a new one."""
    if not (isinstance(term, str) and term.startswith("?")):
        return df.where(value == F.lit(term))
    if term in df.columns:
        return df.where(value == F.col(f"`{term}`"))
    return df.withColumn(term, value).where(F.col(f"`{term}`").isNotNull())
