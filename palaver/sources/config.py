"""Settings of a run: defaults, a file and explicit values, in rising precedence."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

METHODOLOGIES = ("meddic", "bant", "spin", "challenger")
FRAMEWORKS = ("mom_test", "jtbd", "problem_solution")


@dataclass(frozen=True)
class Settings:
    """What changes results; lists and maps are copied into plans when they are built."""

    custom_lexicons: dict[str, list[str]] = field(default_factory=dict)
    competitors: tuple[str, ...] = ()
    methodology: str = "meddic"
    framework: str = "mom_test"
    relationship_insights: bool = False
    min_topic_seconds: float = 60
    max_topics: int = 20
    calendar_window_minutes: int = 30
    budget_usd: float | None = None
    channels: tuple[dict, ...] = ()

    def __post_init__(self):
        if self.methodology not in METHODOLOGIES:
            raise ValueError(f"methodology must be one of {METHODOLOGIES}")
        if self.framework not in FRAMEWORKS:
            raise ValueError(f"framework must be one of {FRAMEWORKS}")


def read_file(path: str) -> dict:
    """A JSON file, or a YAML file where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text or "{}")
    import yaml

    return yaml.safe_load(text) or {}


def settings(path: str | None = None, **given) -> Settings:
    """Settings from a file, overridden by the given values that are not None; unknown names are refused."""
    names = {f.name for f in fields(Settings)}
    values = {**(read_file(path) if path else {}), **{k: v for k, v in given.items() if v is not None}}
    if unknown := values.keys() - names:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(Settings(), **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
