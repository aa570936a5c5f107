"""Stages as functions of tables: only what is asked for, and what it needs, is ever computed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...]
    run: Callable[..., DataFrame]


class Pipeline:
    """A registry of stages. A stage may only need stages or inputs registered before; cycles can't arise unseen."""

    def __init__(self, stages: list[Stage], inputs: tuple[str, ...] = ()):
        self.stages = {s.name: s for s in stages}
        self.inputs = inputs
        if len(self.stages) != len(stages):
            raise ValueError("two stages have one name")
        for s in stages:
            missing = [n for n in s.needs if n not in self.stages and n not in inputs]
            if missing:
                raise ValueError(f"stage {s.name} needs {missing}, which nothing makes")

    def resolve(self, wanted: list[str]) -> list[Stage]:
        """The wanted stages and all that they need, in order of registration."""
        need: set[str] = set()
        path: list[str] = []

        def visit(name: str) -> None:
            if name in path:
                raise ValueError(f"stages need each other: {' -> '.join([*path, name])}")
            if name in self.inputs or name in need:
                return
            if name not in self.stages:
                raise KeyError(name)
            path.append(name)
            for n in self.stages[name].needs:
                visit(n)
            path.pop()
            need.add(name)

        for name in wanted:
            visit(name)
        return [s for s in self.stages.values() if s.name in need]

    def run(self, inputs: dict[str, DataFrame], wanted: list[str]) -> dict[str, DataFrame]:
        """Lazy tables of the wanted stages; a stage that two others need is composed once."""
        made = dict(inputs)
        ready: set[str] = set(inputs)
        todo = self.resolve(wanted)
        while todo:
            runnable = [s for s in todo if all(n in ready for n in s.needs)]
            for s in runnable:
                made[s.name] = s.run(*[made[n] for n in s.needs])
                ready.add(s.name)
            todo = [s for s in todo if s.name not in ready]
        return {w: made[w] for w in wanted}


def reports() -> Pipeline:
    """The report pipeline from page headers and lines to text."""
    from laudario.operators import assemble, derived, project, sanitize, semantic

    return Pipeline(
        [
            Stage("classified", ("lines",), sanitize.classify),
            Stage("ledger", ("headers",), assemble.ledger),
            Stage("blocks", ("headers", "lines"), assemble.content_blocks),
            Stage("coverage", ("headers", "lines"), assemble.coverage),
            Stage("owned", ("lines", "concepts"), lambda lines, concepts: semantic.continued(semantic.anchored(lines, concepts))),
            Stage("routes", ("owned",), semantic.routed),
            Stage("observations", ("routes",), semantic.observations),
            Stage("rates", ("derived_inputs",), lambda d: derived.assess(derived.with_candidates(d))),
            Stage("rendered", ("lab_observations", "concepts", "rates"), project.occurrences),
            Stage("texts", ("rendered",), project.episode_texts),
        ],
        inputs=("headers", "lines", "concepts", "derived_inputs", "lab_observations"),
    )
