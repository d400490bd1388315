"""Settings in layers."""

from __future__ import annotations

import os
from collections.abc import Mapping

# Settings, their defaults, and what they may be.
DEFAULTS = {"strategy": "placeholder", "min_confidence": "low", "ruleset": "all", "format": "auto"}
ALLOWED = {
    "strategy": ("placeholder", "mask", "hash", "numbered", "corpus", "random", "consistent", "fake"), "min_confidence": ("low", "medium", "high"),
    "ruleset": ("programming", "repository", "identity", "contact", "financial", "gdpr", "hipaa", "all", "minimal"), "format": ("auto", "text", "json", "jsonl"),
}


def layered(*layers: Mapping[str, str], environment: Mapping[str, str] | None = None, prefix: str = "GLEANER_") -> dict[str, str]:
    """Defaults, then each layer (global, local), then the environment; an unknown name or value is an error, whatever the layer."""
    env = os.environ if environment is None else environment
    out = dict(DEFAULTS)
    for layer in (*layers, {k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix)}):
        for name, value in layer.items():
            if name not in ALLOWED or value not in ALLOWED[name]:
                raise ValueError(f"bad setting: {name}")
            out[name] = value
    return out
