"""Pattern matching over a key's rows: a pattern builder, the matcher, and MATCH_RECOGNIZE.

The matcher is deterministic: every row may begin one partial match, and each partial match takes
a row, waits or dies. A quantified step takes rows while they fit (greedy), or moves on as soon as
its least count is reached and the next step fits (lazy). It is plain Python without Spark, so the
batch driver here and the streaming one in `millrace.streaming` share it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import Refused
from millrace.operators.keyed import Row, run_keyed

Condition = Callable[[Row, "Match"], bool]
Match = dict[str, list[Row]]
UNBOUNDED = 1 << 62


@dataclass(frozen=True)
class Step:
    name: str
    edge: str = "begin"  # begin, next, followed_by, not_next, not_followed_by
    test: Condition = lambda row, match: True
    least: int = 1
    most: int = 1
    lazy: bool = False

    @property
    def negative(self) -> bool:
        return self.edge.startswith("not_")


@dataclass(frozen=True)
class Pattern:
    """Steps in order, built from `begin`; each method gives a new pattern."""

    steps: tuple[Step, ...] = ()
    within_ms: int | None = None
    skip: str = "no_skip"  # no_skip, past_last, to_next, to_first, to_last
    skip_to: str | None = None

    @staticmethod
    def begin(name: str) -> Pattern:
        return Pattern((Step(name),))

    def _add(self, step: Step) -> Pattern:
        return replace(self, steps=(*self.steps, step))

    def _last(self, **changes) -> Pattern:
        return replace(self, steps=(*self.steps[:-1], replace(self.steps[-1], **changes)))

    def where(self, test: Callable) -> Pattern:
        """A condition on a row, or on a row and the match so far. Several conditions hold together."""
        takes_match = test.__code__.co_argcount > 1
        own: Condition = test if takes_match else lambda row, match: test(row)
        before = self.steps[-1].test
        return self._last(test=lambda row, match: before(row, match) and own(row, match))

    def next(self, name: str) -> Pattern:
        return self._add(Step(name, "next"))

    def followed_by(self, name: str | Pattern) -> Pattern:
        """A step, or all steps of another pattern."""
        if isinstance(name, Pattern):
            first, *rest = name.steps
            return replace(self, steps=(*self.steps, replace(first, edge="followed_by"), *rest))
        return self._add(Step(name, "followed_by"))

    def not_next(self, name: str) -> Pattern:
        return self._add(Step(name, "not_next"))

    def not_followed_by(self, name: str) -> Pattern:
        return self._add(Step(name, "not_followed_by"))

    def _quantified(self, **changes) -> Pattern:
        if self.steps[-1].negative:
            raise Refused("a negative step takes no quantifier")
        return self._last(**changes)

    def times(self, least: int, most: int | None = None) -> Pattern:
        most = least if most is None else most
        if least < 0 or most < max(1, least):
            raise Refused("times takes a least count and a most that is not below it")
        return self._quantified(least=least, most=most)

    def one_or_more(self) -> Pattern:
        return self._quantified(least=1, most=UNBOUNDED)

    def optional(self) -> Pattern:
        return self._quantified(least=0)

    def lazily(self) -> Pattern:
        if self.steps[-1].most == 1:
            raise Refused("lazy needs a quantifier that can take several rows")
        return self._quantified(lazy=True)

    def within(self, ms: int) -> Pattern:
        return replace(self, within_ms=ms)

    def after_match_skip(self, how: str, to: str | None = None) -> Pattern:
        if how not in ("no_skip", "past_last", "to_next", "to_first", "to_last") or (how in ("to_first", "to_last")) != (to is not None):
            raise Refused(f"unknown skip {how}")
        return replace(self, skip=how, skip_to=to)

    def validate(self) -> Pattern:
        names = [s.name for s in self.steps]
        if not names or self.steps[0].edge != "begin" or any(s.edge == "begin" for s in self.steps[1:]):
            raise Refused("a pattern begins once")
        if len(set(names)) < len(names):
            raise Refused("step names differ")
        if self.steps[-1].edge == "not_followed_by" and self.within_ms is None:
            raise Refused("a pattern that ends with not_followed_by needs within")
        if self.skip_to is not None and self.skip_to not in names:
            raise Refused(f"no step {self.skip_to} to skip to")
        return self


@dataclass(eq=False)
class Partial:
    start: int  # ordinal of the first row
    start_ts: int | None
    step: int = 0
    count: int = 0
    taken: list[tuple[str, int, Row]] = field(default_factory=list)

    def match(self) -> Match:
        out: Match = {}
        for name, _, row in self.taken:
            out.setdefault(name, []).append(row)
        return out


class Matcher:
    """The partial matches of one key."""

    def __init__(self, pattern: Pattern, ts: Callable[[Row], int | None] = lambda row: None):
        self.pattern, self.ts = pattern.validate(), ts
        self.partials: list[Partial] = []
        self.n = 0

    def _offer(self, p: Partial, row: Row) -> str:
        """Offer a row to a partial match: kept, done or dead."""
        steps = self.pattern.steps
        while p.step < len(steps):
            s = steps[p.step]
            if s.negative:
                if s.test(row, p.match()):
                    return "dead"
                if s.edge == "not_next":
                    p.step, p.count = p.step + 1, 0
                    if p.step == len(steps):
                        return "done"
                    return self._offer_positive_later(p, row)
                following = p.step + 1
                if following == len(steps):
                    return "kept"  # the end of `within` completes it
                if steps[following].test(row, p.match()):
                    p.step, p.count = following, 0
                    continue
                return "kept"
            enough = p.count >= s.least
            if s.lazy and enough and p.step + 1 < len(steps) and steps[p.step + 1].test(row, p.match()):
                p.step, p.count = p.step + 1, 0
                continue
            if p.count < s.most and s.test(row, p.match()):
                p.taken.append((s.name, self.n, row))
                p.count += 1
                if p.count == s.most or (s.lazy and p.count >= s.least and p.step + 1 == len(steps)):
                    p.step, p.count = p.step + 1, 0
                    return "done" if p.step == len(steps) else "kept"
                return "kept"
            if enough:
                p.step, p.count = p.step + 1, 0
                continue
            strict = s.edge == "next" or (s.edge == "begin")
            return "dead" if strict else "kept"
        return "done"

    def _offer_positive_later(self, p: Partial, row: Row) -> str:
        """After not_next the same row may be the next positive step's; a relaxed step may wait for another."""
        s = self.pattern.steps[p.step]
        if s.negative or s.test(row, p.match()) or s.edge == "next":
            return self._offer(p, row)
        return "kept"

    def _expired(self, now: int | None) -> tuple[list[Partial], list[Partial]]:
        """Partial matches that `within` ends: those that it completes and those that time out."""
        w = self.pattern.within_ms
        if w is None or now is None:
            return [], []
        late = [p for p in self.partials if p.start_ts is not None and now - p.start_ts > w]
        self.partials = [p for p in self.partials if not (p.start_ts is not None and now - p.start_ts > w)]
        last = len(self.pattern.steps) - 1
        good = [p for p in late if p.step == last and self.pattern.steps[last].edge == "not_followed_by"]
        return good, [p for p in late if p not in good]

    def _skip(self, done: Partial) -> None:
        how = self.pattern.skip
        if how == "no_skip":
            return
        last = done.taken[-1][1] if done.taken else self.n
        if how == "past_last":
            self.partials = [p for p in self.partials if p.start > last]
        elif how == "to_next":
            self.partials = [p for p in self.partials if p.start != done.start]
        else:
            named = [i for name, i, _ in done.taken if name == self.pattern.skip_to]
            if named:
                bound = named[0] if how == "to_first" else named[-1]
                self.partials = [p for p in self.partials if p.start >= bound]

    def advance(self, row: Row) -> tuple[list[Match], list[Match]]:
        """Matches that this row completes, and partial matches that have timed out."""
        now = self.ts(row)
        done, out = self._expired(now)
        matches = [p.match() for p in done]
        fresh = Partial(self.n, now)
        finished: list[Partial] = []
        blocked = -1
        for p in [*self.partials, fresh]:
            if p.start <= blocked:
                if p in self.partials:
                    self.partials.remove(p)
                continue
            before = len(p.taken)
            state = self._offer(p, row)
            if p is fresh:
                if state == "kept" and p.taken:
                    self.partials.append(p)
            elif state != "kept":
                self.partials.remove(p)
            if state == "done" and p.taken:
                finished.append(p)
                if self.pattern.skip == "past_last":
                    blocked = p.taken[-1][1] if len(p.taken) > before else p.taken[-1][1]
                self._skip(p)
        self.n += 1
        return matches + [p.match() for p in finished], [p.match() for p in out]

    def finish(self) -> tuple[list[Match], list[Match]]:
        """At the end of a bounded input: partial matches whose open step has enough rows are complete."""
        good, rest, blocked = [], [], -1
        for p in self.partials:
            steps = self.pattern.steps[p.step :]
            complete = bool(steps) and p.count >= steps[0].least and not steps[0].negative and all(s.least == 0 for s in steps[1:] if not s.negative)
            complete = complete or (bool(steps) and len(steps) == 1 and steps[0].negative)
            if complete and p.start > blocked:
                good.append(p.match())
                if self.pattern.skip == "past_last":
                    blocked = p.taken[-1][1]
            elif not complete:
                rest.append(p.match())
        self.partials = []
        return good, rest


def match_pattern(df: DataFrame, keys: list[str], order: list[Column], pattern: Pattern, select: Callable[[Match], Row | Iterable[Row]], schema: str, ts: str | None = None, timed_out: Callable[[Match], Row] | None = None) -> DataFrame:
    """Rows that `select` makes of each match (one, or several), and `timed_out` of each partial match that `within` ended."""
    pattern.validate()

    class Run:
        def __init__(self):
            self.m = Matcher(pattern, (lambda row: None if row[ts] is None else int(row[ts].timestamp() * 1000) if hasattr(row[ts], "timestamp") else int(row[ts])) if ts else (lambda row: None))

        def _rows(self, got) -> Iterable[Row]:
            for m in got[0]:
                r = select(m)
                yield from ([r] if isinstance(r, dict) else r)
            if timed_out is not None:
                yield from map(timed_out, got[1])

        def row(self, row: Row) -> Iterable[Row]:
            return self._rows(self.m.advance(row))

        def finish(self) -> Iterable[Row]:
            return self._rows(self.m.finish())

    return run_keyed(df, keys, order, Run, schema)


def sequence_pattern(text: str, define: dict[str, Condition]) -> Pattern:
    """The pattern of MATCH_RECOGNIZE: variables with + * ? {n} {n,m}, each directly after the one before, past the last row."""
    import re

    steps = []
    for k, (name, q) in enumerate(re.findall(r"([A-Za-z_]\w*)\s*(\+|\*|\?|\{\s*\d+\s*(?:,\s*\d+\s*)?\})?", text)):
        least, most = {"": (1, 1), "+": (1, UNBOUNDED), "*": (0, UNBOUNDED), "?": (0, 1)}.get(q, (0, 0))
        if q.startswith("{"):
            n = [int(x) for x in re.findall(r"\d+", q)]
            least, most = n[0], n[-1]
        steps.append(Step(name, "begin" if not k else "next", define.get(name, lambda row, match: True), least, most))
    if re.sub(r"[A-Za-z_]\w*\s*(\+|\*|\?|\{[\d\s,]*\})?", "", text).strip():
        raise Refused(f"groups, alternatives and reluctant quantifiers are not supported: PATTERN ({text})")
    return Pattern(tuple(steps), skip="past_last").validate()


def match_recognize(df: DataFrame, keys: list[str], order: str, pattern: str, define: dict[str, Column], measures: dict[str, tuple[str, str, str]], schema: str, all_rows: bool = False) -> DataFrame:
    """MATCH_RECOGNIZE.

    define: a column expression for each variable, made before matching; `prev(column)` gives the
    row before in the partition. measures: name to (FIRST or LAST, variable, column), or
    ("CLASSIFIER", "", ""). Output: keys, and the measures (ONE ROW PER MATCH) or every matched row
    with the measures so far (ALL ROWS). Rows of equal order are taken in order of their other columns.
    """
    rows = df
    for name, test in define.items():
        rows = rows.withColumn(f"_d_{name}", F.coalesce(test, F.lit(False)))
    tests: dict[str, Condition] = {n: (lambda row, match, c=f"_d_{n}": bool(row[c])) for n in define}
    built = sequence_pattern(pattern, tests)
    variables = [s.name for s in built.steps]

    def value(m: list[tuple[str, Row]], how: str, variable: str, column: str) -> Any:
        if how == "CLASSIFIER":
            return m[-1][0]
        own = [r for v, r in m if v == variable or not variable]
        return (own[0] if how == "FIRST" else own[-1])[column] if own else None

    def select(match: Match) -> Iterable[Row]:
        taken = [(v, r) for v in variables for r in match.get(v, [])]
        for n in range(1 if all_rows else len(taken), len(taken) + 1):
            seen = taken[:n]
            yield {**seen[-1][1], **{k: value(seen, *m) for k, m in measures.items()}} if all_rows else {**{k: seen[-1][1][k] for k in keys}, **{k: value(seen, *m) for k, m in measures.items()}}

    return match_pattern(rows, keys, [F.col(order)], built, select, schema)


def prev(column: str, keys: list[str], order: str) -> Column:
    """PREV(column): the value of the row before in the partition."""
    from pyspark.sql import Window

    return F.lag(column).over(Window.partitionBy(*keys).orderBy(order))
