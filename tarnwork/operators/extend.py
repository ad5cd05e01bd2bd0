"""Extension points: registries of lanes, layers, projections, parsers and detectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Registry:
    """Named functions with unique ids; at least one must stay enabled to be used."""

    def __init__(self, what: str):
        self.what = what
        self._known: dict[str, Callable[..., DataFrame]] = {}
        self._off: set[str] = set()

    def add(self, name: str, f: Callable[..., DataFrame]) -> None:
        if name in self._known:
            raise ValueError(f"{self.what} {name} is registered already")
        self._known[name] = f

    def disable(self, name: str) -> None:
        self._off.add(name)

    def enabled(self) -> dict[str, Callable[..., DataFrame]]:
        found = {k: f for k, f in self._known.items() if k not in self._off}
        if not found:
            raise ValueError(f"no {self.what} is enabled")
        return found

    def run(self, *arguments) -> tuple[dict[str, DataFrame], list[str]]:
        """Each enabled function's result, and the names of those that failed to plan."""
        out, failed = {}, []
        for name, f in self.enabled().items():
            try:
                out[name] = f(*arguments)
            except Exception:  # noqa: BLE001  a broken extension must not take the others down; its name is reported
                failed.append(name)
        return out, failed
