"""Recording operators as a plan: fields by name, dependencies between operators, lazy runs, and export as a graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as default

from pyspark.sql import DataFrame

from gridloom.operators.stencils import check_stencil_reads
from gridloom.plans.checkpoint import cut

MAP, STENCIL, REDUCE = "map", "stencil", "reduce"


@dataclass(frozen=True)
class Operator:
    """A named step. fn takes the fields that it reads, by name, and returns those that it writes.

    Scalars that change between runs belong into fn's body, which is evaluated at each run.
    """

    name: str
    reads: tuple[str, ...]
    writes: tuple[str, ...]
    fn: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    pattern: str = MAP

    def __post_init__(self) -> None:
        if self.pattern not in (MAP, STENCIL, REDUCE):
            raise ValueError(f"unknown pattern: {self.pattern}")
        if self.pattern == STENCIL:
            check_stencil_reads(self.reads, self.writes)


@dataclass
class Pipeline:
    """A sequence of operators and nested pipelines over an environment of named DataFrames.

    A run binds each result to its name; nothing is computed before an action. OCC modes of overlapping exchange and
    computation are accepted and change nothing, since Spark overlaps them by itself.
    """

    name: str = "pipeline"
    occ: str = "none"
    steps: list[Operator | Pipeline] = default(default_factory=list)
    manual: list[tuple[str, str]] = default(default_factory=list)

    def sequence(self, *steps: Operator | Pipeline) -> Pipeline:
        self.steps = list(steps)
        return self

    def depend(self, before: str, after: str) -> Pipeline:
        """An edge beyond those that the data ask for."""
        self.manual.append((before, after))
        return self

    def add(self, step: Operator | Pipeline) -> Pipeline:
        self.steps.append(step)
        return self

    def clone(self, name: str | None = None) -> Pipeline:
        """A copy whose steps and nested plans can be changed on their own."""
        steps = [s.clone() if isinstance(s, Pipeline) else s for s in self.steps]
        return Pipeline(name or self.name, self.occ, steps, list(self.manual))

    def remove(self, name: str) -> Pipeline:
        """Drops the steps of a name, here or in nested plans, with the edges that were set by hand to what goes."""
        gone: set[str] = set()

        def walk(plan: Pipeline) -> None:
            kept = []
            for s in plan.steps:
                if s.name == name:
                    gone.update([s.name, *(o.name for o in s.flat())] if isinstance(s, Pipeline) else [s.name])
                    continue
                if isinstance(s, Pipeline):
                    walk(s)
                kept.append(s)
            plan.steps = kept

        def forget(plan: Pipeline) -> None:
            plan.manual = [e for e in plan.manual if not gone & set(e)]
            for s in plan.steps:
                if isinstance(s, Pipeline):
                    forget(s)

        walk(self)
        if not gone:
            raise KeyError(f"no such step: {name}")
        forget(self)
        return self

    def edges(self) -> list[tuple[str, str]]:
        """The edges set by hand, those of nested plans included."""
        return [*self.manual, *[e for s in self.steps if isinstance(s, Pipeline) for e in s.edges()]]

    def expand(self) -> Pipeline:
        """The same plan with nested ones replaced by their operators."""
        return Pipeline(self.name, self.occ, list(self.flat()), self.edges())

    def flat(self) -> list[Operator]:
        return [o for s in self.steps for o in (s.flat() if isinstance(s, Pipeline) else [s])]

    def run(self, env: dict[str, DataFrame], times: int = 1, cut_every: int = 0) -> dict[str, DataFrame]:
        """times runs in a row; every cut_every-th ends with its written fields as tables in the shared folder."""
        env = dict(env)
        written = {w for o in self.flat() for w in o.writes}
        for k in range(times):
            for op in self.flat():
                missing = [r for r in op.reads if r not in env]
                if missing:
                    raise KeyError(f"{op.name} reads fields that aren't there: {missing}")
                out = op.fn({r: env[r] for r in op.reads})
                if set(out) != set(op.writes):
                    raise ValueError(f"{op.name} wrote {sorted(out)}, not {sorted(op.writes)}")
                env.update(out)
            if cut_every and (k + 1) % cut_every == 0:
                env.update({w: cut(env[w], w) for w in written})
        return env

    def swap(self, env: dict[str, DataFrame], a: str, b: str) -> dict[str, DataFrame]:
        return env | {a: env[b], b: env[a]}

    def dependencies(self) -> list[tuple[str, str, str]]:
        """(before, after, kind) with kinds RAW, WAR, WAW and manual, without those that others imply."""
        ops = self.flat()
        edges: dict[tuple[int, int], str] = {}
        for j, later in enumerate(ops):
            for data in (*later.reads, *later.writes):
                for i in range(j - 1, -1, -1):
                    earlier = ops[i]
                    if data in earlier.writes:
                        edges.setdefault((i, j), "RAW" if data in later.reads else "WAW")
                        break
                    if data in earlier.reads and data in later.writes:
                        edges.setdefault((i, j), "WAR")
        number = {o.name: i for i, o in enumerate(ops)}
        edges.update({(number[a], number[b]): "manual" for a, b in self.edges()})
        after = {i: {j for (a, j) in edges if a == i} for i in range(len(ops))}

        def reach(i: int, seen: set[int]) -> set[int]:
            for j in after[i] - seen:
                seen.add(j)
                reach(j, seen)
            return seen

        kept = []
        for (i, j), kind in sorted(edges.items()):
            others = set()
            for m in after[i] - {j}:
                others |= {m} | reach(m, set())
            if j not in others or kind == "manual":
                kept.append((ops[i].name, ops[j].name, kind))
        return kept

    def to_dot(self) -> str:
        """The plan in Graphviz's language."""
        quote = lambda s: '"' + s.replace('"', "'") + '"'
        lines = [f"digraph {quote(self.name)} {{"]
        lines += [f"  {quote(o.name)} [label={quote(f'{o.name} ({o.pattern})')}];" for o in self.flat()]
        lines += [f"  {quote(a)} -> {quote(b)} [label={quote(kind)}];" for a, b, kind in self.dependencies()]
        return "\n".join([*lines, "}"])


def on_pandas(fn: Callable, schema: str) -> Callable[[DataFrame], DataFrame]:
    """An operator of arbitrary Python on batches of rows, for what columns can't express."""
    return lambda df: df.mapInPandas(lambda batches: map(fn, batches), schema)
