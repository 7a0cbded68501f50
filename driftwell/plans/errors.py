"""Errors of the engine."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of this package."""


class ConfigError(EngineError):
    """A configuration lacks a part or has one of the wrong kind."""


class RegistryError(EngineError):
    """A name is unknown or taken."""


class NotFittedError(EngineError):
    """A model is used before it is fitted."""


class SignalError(EngineError):
    """A signal does not fit its schema."""


class PolicyError(EngineError):
    """A gate policy or risk tier is unknown."""


class DeploymentError(EngineError):
    """A deployment takes a step that its state forbids."""


class RollbackError(DeploymentError):
    """There is no snapshot to go back to, or its id is unknown or taken."""
