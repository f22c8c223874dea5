"""Options: defaults, levels, a file, the environment; later ones win, levels only fill what nobody set."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

# What each level changes.
LEVELS = {
    "normal": {},
    "compact": {"max_output_bytes": 51_200, "search_max_bytes": 20_480, "batch_max_bytes": 40_960, "search_limit": 2, "intent_search_threshold": 3_000},
    "ultra": {"max_output_bytes": 25_600, "search_max_bytes": 10_240, "batch_max_bytes": 20_480, "search_limit": 1, "intent_search_threshold": 2_000},
}


@dataclass(frozen=True)
class Options:
    """Limits of search, compaction and execution."""

    intent_search_threshold: int = 5_000
    max_output_bytes: int = 102_400
    hard_cap_bytes: int = 100 * 1024 * 1024
    search_max_bytes: int = 40_960
    batch_max_bytes: int = 81_920
    search_limit: int = 3
    search_window_ms: int = 60_000
    search_reduce_after: int = 3
    search_block_after: int = 8
    compression_level: str = "normal"
    persist: bool = False
    store_dir: str | None = None
    passthrough_env: tuple[str, ...] = ()

    def clamped(self) -> Options:
        """Every value within its bounds."""
        reduce_after = max(1, self.search_reduce_after)
        most = max(1024, self.max_output_bytes)
        return replace(
            self,
            max_output_bytes=most,
            hard_cap_bytes=max(most, self.hard_cap_bytes),
            intent_search_threshold=max(0, self.intent_search_threshold),
            search_limit=max(1, self.search_limit),
            search_window_ms=max(1000, self.search_window_ms),
            search_reduce_after=reduce_after,
            search_block_after=max(reduce_after + 1, self.search_block_after),
            search_max_bytes=max(1024, self.search_max_bytes),
            batch_max_bytes=max(1024, self.batch_max_bytes),
            persist=self.persist or bool(self.store_dir),
        )


def _valid(name: str, value: object) -> bool:
    default = getattr(Options(), name)
    if name == "compression_level":
        return value in LEVELS
    if name == "store_dir":
        return value is None or isinstance(value, str)
    if name == "passthrough_env":
        return isinstance(value, list) and all(isinstance(v, str) for v in value)
    if isinstance(default, bool):
        return isinstance(value, bool)
    least = 0 if name == "search_reduce_after" else 1
    return isinstance(value, int) and not isinstance(value, bool) and value >= least


def from_file(folders: list[str], name: str = ".lodestone.json") -> dict[str, object]:
    """The first file that can be parsed; one with a wrong value counts as empty and ends the search."""
    known = {f.name for f in fields(Options)}
    for folder in folders:
        try:
            found = json.loads(Path(folder, name).read_text())
        except (OSError, ValueError):
            continue
        if not isinstance(found, dict) or not all(_valid(k, v) for k, v in found.items() if k in known):
            return {}
        return {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in known}
    return {}


def from_environment(env: dict[str, str] | None = None, prefix: str = "LODESTONE_") -> dict[str, object]:
    """Options named in the environment; values that don't parse are ignored."""
    env, found = dict(os.environ) if env is None else env, {}
    for name, default in asdict(Options()).items():
        text = env.get(prefix + name.upper())
        if text is None:
            continue
        value: object = text
        if isinstance(default, bool):
            value = text.lower() in ("1", "true", "yes")
        elif isinstance(default, int):
            value = int(text) if text.isdigit() else None
        elif isinstance(default, tuple):
            value = [v.strip() for v in text.split(",") if v.strip()]
        if _valid(name, value):
            found[name] = tuple(value) if isinstance(value, list) else value
    return found


def load(folders: list[str] | None = None, env: dict[str, str] | None = None) -> Options:
    """Environment over file over level over defaults, clamped."""
    given = from_file(folders or []) | from_environment(env)
    level = LEVELS[str(given.get("compression_level", "normal"))]
    return Options(**{**level, **given}).clamped()
