"""Where each output column of a query comes from, read off Spark's analyzed plan."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _seq(items) -> list:
    return [items.apply(k) for k in range(items.size())]


def lineage(df: DataFrame) -> dict[str, set[str]]:
    """Output column to the `relation.column` names that it is made of, through projections, aggregates, windows and set operations.

    Relations are named by the view or alias nearest to them, or else by the kind of their source.
    """
    made: dict[int, set[int]] = {}
    source: dict[int, str] = {}
    plan = df._jdf.queryExecution().analyzed()

    def walk(node, alias: str) -> None:
        kind = node.nodeName()
        if kind == "SubqueryAlias":
            alias = node.identifier().name()
        children = _seq(node.children())
        if not children:
            for a in _seq(node.output()):
                source[a.exprId().id()] = f"{alias or kind.lower()}.{a.name()}"
        for e in _seq(node.expressions()):
            stack = [e]
            while stack:
                x = stack.pop()
                if x.nodeName() == "Alias":
                    made.setdefault(x.exprId().id(), set()).update(a.exprId().id() for a in _refs(x))
                stack += _seq(x.children())
        if kind in ("Union", "Intersect", "Except"):
            for child in children:
                for out, own in zip(_seq(node.output()), _seq(child.output()), strict=True):
                    if out.exprId().id() != own.exprId().id():
                        made.setdefault(out.exprId().id(), set()).add(own.exprId().id())
        if kind in ("Generate",):
            for a in _seq(node.generatorOutput()):
                made.setdefault(a.exprId().id(), set()).update(r.exprId().id() for r in _refs(node.generator()))
        for child in children:
            walk(child, alias)

    def _refs(expression) -> list:
        return _seq(expression.references().toSeq())

    walk(plan, "")

    def origins(i: int, seen: frozenset[int] = frozenset()) -> set[str]:
        if i in source:
            return {source[i]}
        return set().union(*(origins(j, seen | {i}) for j in made.get(i, ()) if j not in seen), set())

    return {a.name(): origins(a.exprId().id()) for a in _seq(plan.output())}
