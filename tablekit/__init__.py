"""A PySpark-native analytics engine for file-backed tables."""

from __future__ import annotations

__all__ = ["Engine", "EngineError"]


def __getattr__(name: str):
    """Loads the engine when it is asked for, so that Python workers import only what they run."""
    if name == "Engine":
        from .engine import Engine

        return Engine
    if name == "EngineError":
        from .errors import EngineError

        return EngineError
    raise AttributeError(name)
