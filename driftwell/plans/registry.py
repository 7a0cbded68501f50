"""Named components: detectors, thresholds, rollouts, policies, exporters and scenarios."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from .errors import RegistryError


class Registry:
    """Factories by name, without regard to case."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self._made: dict[str, Any] = {}

    def register(self, name: str):
        key = name.lower()

        def add(factory):
            if key in self._made:
                raise RegistryError(f"{self.kind} '{name}' is registered twice")
            self._made[key] = factory
            return factory

        return add

    def get(self, name: str):
        if name.lower() not in self._made:
            raise RegistryError(f"unknown {self.kind} '{name}'; known: {', '.join(self.names()) or 'none'}")
        return self._made[name.lower()]

    def create(self, name: str, **params):
        return self.get(name)(**params)

    def names(self) -> list[str]:
        return sorted(self._made)

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._made

    def __iter__(self) -> Iterator[str]:
        return iter(self.names())

    def __len__(self) -> int:
        return len(self._made)


DETECTORS = Registry("detector")
THRESHOLDS = Registry("threshold")
ROLLOUTS = Registry("rollout")
POLICIES = Registry("policy")
EXPORTERS = Registry("exporter")
SCENARIOS = Registry("scenario")
