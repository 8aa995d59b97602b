"""Steps with fingerprints: skip what is there already, prove that inputs stayed as they were."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from strandmill.gates import GateError, fingerprint

Step = tuple[str, Callable[[SparkSession, Mapping[str, DataFrame]], DataFrame]]


@dataclass
class Pipeline:
    """Named steps in a fixed order, each a function of the session and the tables so far; each result is written as parquet.

    ``state.json`` keeps for each step the fingerprint of the table it wrote and a key over the fingerprints of all
    inputs, the code of the step and the keys of the steps before. On ``resume`` a step is skipped if its table is there
    with its fingerprint and the key is the same, so that a changed input or step runs again. ``dry_run`` lists what
    would run. ``outputs`` maps steps to writers that are called with the table once the step ran.
    """

    folder: Path
    steps: Sequence[Step]
    ran: list[str] = field(default_factory=list)
    outputs: Mapping[str, Callable[[DataFrame], object]] = field(default_factory=dict)

    def _state(self) -> dict[str, list[str]]:
        p = self.folder / "state.json"
        return json.loads(p.read_text()) if p.exists() else {}

    def run(self, spark: SparkSession, inputs: Mapping[str, DataFrame], resume: bool = False, first: str | None = None, last: str | None = None, dry_run: bool = False) -> dict[str, DataFrame]:
        names = [n for n, _ in self.steps]
        for x in (first, last):
            if x is not None and x not in names:
                raise GateError(f"no step {x}")
        lo, hi = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
        self.folder.mkdir(parents=True, exist_ok=True)
        state, tables = self._state(), dict(inputs)
        key = hashlib.sha256("|".join(f"{k}={fingerprint(v)}" for k, v in sorted(inputs.items())).encode()).hexdigest()
        self.ran = []
        for i, (name, step) in enumerate(self.steps[: hi + 1]):
            path = str(self.folder / name)
            key = hashlib.sha256(f"{key}|{name}|{_code_of(step)}".encode()).hexdigest()
            there = Path(path).exists()
            if i < lo:
                if not there:
                    raise GateError(f"step {name} has no result to start from")
                tables[name] = spark.read.parquet(path)
                continue
            if resume and there and state.get(name) == [key, fingerprint(spark.read.parquet(path))]:
                tables[name] = spark.read.parquet(path)
                continue
            self.ran.append(name)
            if dry_run:
                continue
            step(spark, tables).write.mode("overwrite").parquet(path)
            tables[name] = spark.read.parquet(path)
            state[name] = [key, fingerprint(tables[name])]
            if name in self.outputs:
                self.outputs[name](tables[name])
            (self.folder / "state.json").write_text(json.dumps(state, sort_keys=True, indent=2))
        return tables


def _code_of(step: Callable) -> str:
    """The byte code and constants of a step, so that a changed step counts as another one."""
    code = getattr(step, "__code__", None)
    return repr(step) if code is None else f"{code.co_code.hex()}|{[c if not hasattr(c, 'co_code') else c.co_code.hex() for c in code.co_consts]!r}|{code.co_names}"


class Frozen:
    """Proof that tables did not change: fingerprints before and after."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = dict(tables)

    def __enter__(self) -> Frozen:
        self.before = {k: fingerprint(v) for k, v in self.tables.items()}
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            changed = [k for k, v in self.tables.items() if fingerprint(v) != self.before[k]]
            if changed:
                raise GateError(f"inputs changed: {changed}")


def golden(results: Mapping[str, DataFrame], expected: Mapping[str, str]) -> dict[str, bool]:
    """Per result whether its fingerprint is the expected one; a missing result is False."""
    return {k: k in results and fingerprint(results[k]) == v for k, v in expected.items()}


def chain_pipeline(folder: str | Path, reports: str | Path | None = None) -> Pipeline:
    """The evidence pipeline over the tables of a data folder, from the sub-graph to the reports.

    Steps: sub-graph (edges with their causality), merge of the increment, reconciliation, chains, cohort annotation,
    cards, top list. With ``reports``, results are also written there as text tables with stable bytes.
    """
    from strandmill.plans import evidence_scoring as es
    from strandmill.sinks.files import write_tsv

    def at(t: Mapping[str, DataFrame]) -> str:
        return t["sf_dir"].first()[0]

    et = es.et
    out: dict[str, Callable[[DataFrame], object]] = {}
    if reports is not None:
        d = Path(reports)
        out = {
            "subgraph": lambda df: write_tsv(df, d / "edges.tsv", ["edge_id", "subject", "predicate", "object", "causality", "basis"], ["subject", "predicate", "object", "edge_id"]),
            "top": lambda df: write_tsv(df, d / "top.tsv", ["rank", "chain_id", "votes_total", "evidence_score", "borda", "verified_rate"], ["rank"]),
        }
    return Pipeline(
        Path(folder),
        [
            ("subgraph", lambda s, t: et.induced_subgraph(s, at(t)).join(et.edge_causality(s, at(t)).drop("predicate"), "edge_id")),
            ("merged", lambda s, t: et.edge_upsert(s, at(t))),
            ("buckets", lambda s, t: et._buckets(s, at(t)).drop("ka", "kb")),
            ("chains", lambda s, t: et.chain_assembly(s, at(t))),
            ("annotations", lambda s, t: es.chain_annotations(s, at(t))),
            ("cards", lambda s, t: es._cards(s, at(t))),
            ("top", lambda s, t: es.vo.top_cards(t["cards"])),
        ],
        outputs=out,
    )


def same_twice(folder: str | Path, spark: SparkSession, steps: Sequence[Step], inputs: Mapping[str, DataFrame]) -> dict[str, bool]:
    """Each step's result of two runs in separate folders compared by fingerprint: whether the steps depend on their inputs only."""
    first, second = (Pipeline(Path(folder) / n, steps).run(spark, inputs) for n in ("first", "second"))
    return golden({n: second[n] for n, _ in steps}, {n: fingerprint(first[n]) for n, _ in steps})
