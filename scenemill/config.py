"""Experiment configs and the registry of components, on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml


class Registry:
    """Components by name, case and outer spaces aside."""

    def __init__(self, kind: str) -> None:
        self.kind, self.made = kind, {}

    @staticmethod
    def key(name: str) -> str:
        return name.strip().lower()

    def register(self, name: str):
        def add(component):
            if self.key(name) in self.made:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self.made[self.key(name)] = component
            return component

        return add

    def alias(self, name: str, target: str) -> None:
        self.register(name)(self.get(target))

    def get(self, name: str):
        try:
            return self.made[self.key(name)]
        except KeyError:
            raise ValueError(f"unknown {self.kind} {name!r}; there are {', '.join(sorted(self.made))}") from None


@dataclass(frozen=True)
class Experiment:
    name: str
    seed: int
    output_dir: str
    dataset: dict[str, Any]
    model: dict[str, Any]
    metrics: list[dict[str, Any]] = field(default_factory=list)
    interval_law: str = "replay"


def read_mapping(path: Path) -> dict:
    text = path.read_text()
    found = json.loads(text) if path.suffix == ".json" else yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return found


def _layers(path: Path, seen: tuple[Path, ...] = ()) -> dict[str, tuple[Any, Path]]:
    """Each key's value and the folder of the file that sets it; a file overrides whole keys of what it extends."""
    path = path.resolve()
    if path in seen:
        raise ValueError(f"{path} extends itself")
    own = read_mapping(path)
    base = _layers(path.parent / own.pop("extends"), (*seen, path)) if "extends" in own else {}
    return base | {k: (v, path.parent) for k, v in own.items()}


PATHS = ("manifest", "predictions", "prediction_dir", "mesh_root")


def _placed(parameters: dict, folder: Path) -> dict:
    return {k: str((folder / v).resolve()) if k in PATHS and isinstance(v, str) else v for k, v in parameters.items()}


def _component(value: Any, folder: Path) -> dict:
    value = {"type": value} if isinstance(value, str) else value
    return {"type": value["type"], "parameters": _placed(value.get("parameters") or {}, folder)}


def expanded(entries: list, folder: Path) -> list[dict]:
    """Metrics; one marked per_class becomes one for each of its classes, named <name>_<class>."""
    out = []
    for entry in entries:
        made = _component(entry, folder)
        each = made["parameters"].pop("per_class", None)
        if each is None:
            out.append(made)
            continue
        classes = made["parameters"].get("classes")
        if not classes:
            raise ValueError("per_class needs classes")
        prefix = each if isinstance(each, str) else made["parameters"].get("name", made["type"])
        out += [{"type": made["type"], "parameters": made["parameters"] | {"classes": [c], "name": f"{prefix}_{c}"}} for c in classes]
    names = [m["parameters"].get("name", m["type"]) for m in out]
    if len(set(names)) < len(names):
        raise ValueError(f"metric names are not unique: {', '.join(sorted(n for n in set(names) if names.count(n) > 1))}")
    return out


def load(path: str | Path) -> Experiment:
    found = _layers(Path(path))
    get = lambda k, default=None: found.get(k, (default, Path(path).parent))
    output, where = get("output_dir", "runs")
    return Experiment(
        str(get("experiment_name", Path(path).stem)[0]), int(get("seed", 0)[0]), str((where / output).resolve()),
        _component(*get("dataset")), _component(*get("model")), expanded(*get("metrics", [])),
        str(get("interval_law", "replay")[0]),
    )
