"""Graph patterns as joins of property tables (Q0)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplake.operators.mapping import MAPPINGS, Mapping


@dataclass(frozen=True)
class Pattern:
    """?subject property ?value, of the mapping `of`; a value that is not a variable is a constant to match."""

    subject: str
    prop: str
    value: str | None
    of: str
    constant: object = None


def pattern_join(tables: dict[str, DataFrame], patterns: list[Pattern], select: list[str], where: Column | None = None, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Solutions of a conjunction of patterns as a bag, projected to `select`.

    Patterns of one subject and mapping come from one row, so they are one projection of the source instead of
    self-joins; the rest are inner joins on the shared variables, each next pattern one that shares a variable.
    """
    by_id = {m.id: m for m in mappings}
    groups: dict[tuple[str, str], DataFrame] = {}
    for p in patterns:
        m = by_id[p.of]
        key = (p.subject, p.of)
        if key not in groups:
            groups[key] = tables[m.table].withColumn(f"?{p.subject}", F.col(m.key)).where(F.col(m.key).isNotNull())
        held = groups[key]
        column = next((F.col(c) for q, c, _ in m.literals if q == p.prop), None)
        if column is None:
            column = next(F.col(c) for q, _, c in m.links if q == p.prop)
        if p.value is None:
            held = held.where(column == F.lit(p.constant))
        elif f"?{p.value}" in held.columns:
            held = held.where(column == F.col(f"?{p.value}"))
        else:
            held = held.withColumn(f"?{p.value}", column).where(column.isNotNull())
        groups[key] = held
    frames = [df.select(*[F.col(c).alias(c[1:]) for c in df.columns if c.startswith("?")]) for df in groups.values()]
    out, rest = frames[0], frames[1:]
    while rest:
        nxt = next((f for f in rest if set(f.columns) & set(out.columns)), None)
        if nxt is None:
            raise ValueError("the patterns share no variable")
        rest = [f for f in rest if f is not nxt]
        out = out.join(nxt, sorted(set(out.columns) & set(nxt.columns)))
    if where is not None:
        out = out.where(where)
    return out.select(*select)
