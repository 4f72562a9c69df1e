"""Named methods with checked parameters, plans with fingerprints, step pipelines, registries.

A plan holds names, parameters and input hashes and no data; running it builds a lazy DataFrame.  Registries are small
driver-side JSON; everything that grows with the data stays in Spark."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Method:
    """A query by name with its defaults, required parameters and guards (ORC01)."""

    name: str
    build: Callable[..., DataFrame]
    category: str = "query"
    defaults: Mapping[str, Any] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    protected: tuple[str, ...] = ()

    def describe(self) -> dict:
        return {"name": self.name, "category": self.category, "summary": (self.build.__doc__ or "").strip(), "defaults": dict(self.defaults), "required": list(self.required)}


@dataclass(frozen=True)
class Plan:
    method: str
    parameters: Mapping[str, Any]
    inputs: Mapping[str, str]
    fingerprint: str
    missing: tuple[str, ...]


def methods() -> dict[str, Method]:
    from . import catalog

    return {name: Method(name, f, category=name.split("_")[0]) for name, f in catalog.QUERIES.items()}


def merged(base: Mapping, over: Mapping) -> dict:
    """Deep merge; over wins (ORC04)."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def file_hash(path: str) -> str:
    """SHA-256 of a local file, read in blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def mismatched(hashes: Mapping[str, str], folder: str = "") -> list[str]:
    """Files whose content isn't what the pin says, or that are missing (ORC08)."""
    return sorted(n for n, h in hashes.items() if not os.path.isfile(os.path.join(folder, n)) or file_hash(os.path.join(folder, n)) != h)


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Path and SHA-256 of each file under a path that executors reach."""
    from pyspark.sql import functions as F

    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def plan(method: Method, parameters: Mapping[str, Any] | None = None, inputs: Mapping[str, str] | None = None) -> Plan:
    """Checked parameters with defaults, input hashes, and a fingerprint of both (ORC02)."""
    given = dict(parameters or {})
    if any("api_key" in k and not k.endswith("_file") for k in given):
        raise ValueError("pass the path of a key file, never a key")
    unknown, barred = set(given) - set(method.defaults) - set(method.required), set(given) & set(method.protected)
    if unknown or barred:
        raise ValueError(f"unknown or protected parameters: {sorted(unknown | barred)}")
    full = {**method.defaults, **given}
    missing = tuple(sorted(k for k in method.required if full.get(k) in (None, "", [], {})))
    known = {k: file_hash(p) if os.path.isfile(p) else "" for k, p in (inputs or {}).items()}
    body = json.dumps([method.name, full, known], sort_keys=True, default=str)
    return Plan(method.name, full, dict(inputs or {}), hashlib.sha256(body.encode()).hexdigest(), missing)


def execute(spark: SparkSession, method: Method, made: Plan, sf_dir: str) -> DataFrame:
    """The method's DataFrame, if the plan is complete and its inputs are as they were (ORC03)."""
    if made.missing:
        raise ValueError(f"missing parameters: {list(made.missing)}")
    given = {k: v for k, v in made.parameters.items() if k in method.required or method.defaults.get(k) != v}
    if plan(method, given, made.inputs).fingerprint != made.fingerprint:
        raise ValueError("inputs or parameters changed since the plan was made")
    spark.sparkContext.setJobDescription(f"{method.name} {made.fingerprint[:12]}")
    return method.build(spark, sf_dir, **made.parameters)


def expanded(value: Any, variables: Mapping[str, str]) -> Any:
    """value with ${name} filled in, at any depth; an unknown name is an error."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: str(variables[m[1]]), value)
    if isinstance(value, list):
        return [expanded(v, variables) for v in value]
    return {k: expanded(v, variables) for k, v in value.items()} if isinstance(value, dict) else value


def run_steps(steps: list[dict], actions: Mapping[str, Callable], variables: Mapping[str, str] | None = None, start_at: str | int | None = None,
              only: str | int | None = None, dry_run: bool = False, exists: Callable[[str], bool] = os.path.exists) -> list[dict]:
    """Named steps in order (ORC05): {name, action, args, skip_if_exists}; each gives name and status.

    start_at and only take a name or a place from 1.  The first failure ends the run and is reported."""
    names = [s["name"] for s in steps]
    if len(set(names)) < len(names):
        raise ValueError("step names repeat")

    def place(which):
        if isinstance(which, int) or str(which).isdigit():
            if not 1 <= int(which) <= len(names):
                raise ValueError(f"no step {which} of {len(names)}")
            return int(which) - 1
        return names.index(which)

    first = place(start_at) if start_at is not None else 0
    chosen = {place(only)} if only is not None else set(range(first, len(steps)))
    report = []
    for i, step in enumerate(steps):
        made = expanded({k: v for k, v in step.items() if k != "name"}, variables or {})
        if i not in chosen:
            status = "not_selected"
        elif made.get("skip_if_exists") and exists(made["skip_if_exists"]):
            status = "skipped"
        elif dry_run:
            status = "planned"
        else:
            try:
                actions[made["action"]](**made.get("args", {}))
                status = "done"
            except Exception as error:  # reported with the step; later steps don't run
                report.append({"name": names[i], "status": "failed", "error": f"{type(error).__name__}: {error}"})
                break
        report.append({"name": names[i], "status": status})
    return report


def differences(a: Any, b: Any, prefix: str = "") -> list[str]:
    """Dotted paths where two nested mappings differ (ORC13)."""
    if not (isinstance(a, Mapping) and isinstance(b, Mapping)):
        return [] if a == b else [prefix]
    out: list[str] = []
    for k in sorted({*a, *b}):
        path = f"{prefix}.{k}".lstrip(".")
        out += differences(a[k], b[k], path) if k in a and k in b else [path]
    return out


def set_nested(document: Mapping, path: str, value: Any) -> dict:
    """A copy with value at a dotted path (ORC10)."""
    head, _, rest = path.partition(".")
    inner = document.get(head)
    return {**document, head: set_nested(inner if isinstance(inner, Mapping) else {}, rest, value) if rest else value}


class Registry:
    """Runs and aliases in one JSON file, written whole and renamed into place (SRC05, ORC06, ORC07)."""

    def __init__(self, path: str):
        self.path = path

    def _load(self) -> dict:
        if not os.path.exists(self.path):
            return {"runs": {}, "aliases": {}}
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def _save(self, state: dict) -> None:
        scratch = f"{self.path}.{os.getpid()}.tmp"
        with open(scratch, "w", encoding="utf-8") as f:
            json.dump(state, f, ensure_ascii=False, indent=2, sort_keys=True)
        os.replace(scratch, self.path)

    def upsert(self, manifest: Mapping) -> None:
        state = self._load()
        state["runs"][str(manifest["run_id"])] = dict(manifest)
        self._save(state)

    def runs(self, **where: Any) -> list[dict]:
        """Runs whose fields equal those given, newest first."""
        found = [r for r in self._load()["runs"].values() if all(r.get(k) == v for k, v in where.items())]
        return sorted(found, key=lambda r: (r.get("created_at") or "", r["run_id"]), reverse=True)

    def promote(self, alias: str, run_id: str) -> None:
        state = self._load()
        if run_id not in state["runs"]:
            raise KeyError(run_id)
        state["aliases"][self._slug(alias)] = run_id
        self._save(state)

    def resolve(self, alias: str) -> dict:
        state = self._load()
        return state["runs"][state["aliases"][self._slug(alias)]]

    @staticmethod
    def _slug(alias: str) -> str:
        return re.sub("[^a-z0-9]+", "-", alias.lower()).strip("-") or "alias"
