"""Layered configuration: YAML files merged in order, dotted overrides, and a hash of the meaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from vitrine.sources.sinks import json_digest


class ConfigError(ValueError):
    """A configuration contradicts itself or the known keys."""


def read_yaml(text: str) -> dict:
    """Parse YAML; a repeated key is an error. Needs PyYAML."""
    try:
        import yaml
    except ImportError as error:
        raise ConfigError("PyYAML is needed to read configuration files") from error

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        seen = set()
        for key, _ in node.value:
            name = loader.construct_object(key)
            if name in seen:
                raise ConfigError(f"repeated key {name!r}")
            seen.add(name)
        return yaml.SafeLoader.construct_mapping(loader, node, deep=True)

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return yaml.load(text, Loader) or {}  # noqa: S506  (a safe loader)


def merged(base: Mapping, layer: Mapping) -> dict:
    """``layer`` over ``base``; mappings merge, everything else is replaced."""
    out = dict(base)
    for key, value in layer.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def with_overrides(config: Mapping, overrides: Mapping[str, object]) -> dict:
    """Set dotted keys. Unknown keys are an error, so a typing slip cannot pass as a setting."""
    out = merged({}, config)
    for dotted, value in overrides.items():
        *path, last = dotted.split(".")
        at = out
        for step in path:
            if not isinstance(at.get(step), Mapping):
                raise ConfigError(f"no section {step!r} in {dotted!r}")
            at[step] = dict(at[step])
            at = at[step]
        if last not in at:
            raise ConfigError(f"unknown key {dotted!r}")
        at[last] = value
    return out


def load(paths: Sequence[Path], overrides: Mapping[str, object] | None = None) -> tuple[dict, str]:
    """(configuration, hash of its meaning)."""
    config: dict = {}
    for p in paths:
        config = merged(config, read_yaml(Path(p).read_text(encoding="utf-8")))
    config = with_overrides(config, overrides or {})
    return config, json_digest(config)
