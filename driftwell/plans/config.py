"""Deployment configurations from mappings or YAML files."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .errors import ConfigError


@dataclass
class ComponentSpec:
    """A component's name and parameters."""

    name: str
    params: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def parse(cls, value: Any) -> ComponentSpec:
        """From a name, or a mapping with ``name``; a nested ``params`` wins over keys beside it."""
        if isinstance(value, ComponentSpec):
            return value
        if isinstance(value, str):
            return cls(value)
        if isinstance(value, dict) and isinstance(value.get("name"), str):
            beside = {k: v for k, v in value.items() if k not in ("name", "params")}
            return cls(value["name"], beside | dict(value.get("params") or {}))
        raise ConfigError(f"a component is a name or a mapping with a name, not {value!r}")


@dataclass
class DeploymentConfig:
    detector: ComponentSpec
    rollout: ComponentSpec
    policy: ComponentSpec
    threshold: ComponentSpec | None = None
    scenario: ComponentSpec = field(default_factory=lambda: ComponentSpec("healthy"))
    exporters: list[ComponentSpec] = field(default_factory=list)
    risk_tier: str = "standard"
    seed: int = 0

    @classmethod
    def from_dict(cls, data: Any) -> DeploymentConfig:
        """Detector, rollout and policy are needed; unknown keys are ignored."""
        if not isinstance(data, dict):
            raise ConfigError("a configuration is a mapping")
        missing = [k for k in ("detector", "rollout", "policy") if k not in data]
        if missing:
            raise ConfigError(f"the configuration lacks {', '.join(missing)}")
        spec = ComponentSpec.parse
        return cls(
            spec(data["detector"]), spec(data["rollout"]), spec(data["policy"]), spec(data["threshold"]) if data.get("threshold") else None,
            spec(data.get("scenario") or "healthy"), [spec(e) for e in data.get("exporters") or []], str(data.get("risk_tier", "standard")), int(data.get("seed", 0)),
        )

    @classmethod
    def from_yaml(cls, path: str) -> DeploymentConfig:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("YAML files need the package pyyaml") from e
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f))
