"""Configuration: a YAML or JSON file over defaults, profile names, rule packs."""

from __future__ import annotations

import json
import re
from copy import deepcopy
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "active_profile": "default",
    "redaction": {"enabled": True, "detectors": ["pem_private_key", "jwt", "bearer_token", "credential_kv", "url_credentials", "vendor_token"]},
    "footprint_budget": {"factor": 3.0, "warn": 0.8, "block": 1.0},
    "chunking": {"tokens": 200, "overlap": 40},
    "profiles": {"default": {}},
}
SECRET_KEYS = re.compile(r"(?i)(key|token|secret|password)$")


class ConfigError(ValueError):
    pass


class RulePackError(ConfigError):
    """A rule pack is missing or malformed; the command line exits with 5."""


def profile_name(name: str) -> str:
    """The name, if it cannot leave its folder."""
    if not name or "/" in name or "\\" in name or ".." in name:
        raise ConfigError(f"bad profile name {name!r}")
    return name


@dataclass(frozen=True)
class Config:
    raw: dict[str, Any] = field(default_factory=lambda: deepcopy(DEFAULTS))

    def section(self, name: str) -> dict[str, Any]:
        """A section; redaction and the budget fall back to defaults key by key."""
        found = self.raw.get(name) or {}
        return {**DEFAULTS.get(name, {}), **found} if name in ("redaction", "footprint_budget", "chunking") else found

    @property
    def profile(self) -> dict[str, Any]:
        return (self.raw.get("profiles") or {}).get(profile_name(self.raw.get("active_profile", "default"))) or {}

    def snapshot(self) -> str:
        """Canonical JSON without secrets."""

        def clean(x: Any) -> Any:
            if isinstance(x, dict):
                return {k: clean(v) for k, v in x.items() if not SECRET_KEYS.search(k)}
            return [clean(v) for v in x] if isinstance(x, list) else x

        return json.dumps(clean(self.raw), sort_keys=True)


def read(path: str | Path | None) -> Any:
    if path is None:
        return None
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml

    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise ConfigError(f"{path}: {error}") from error


def load(path: str | Path | None = None) -> Config:
    """The file as it stands; defaults only where there is no file."""
    raw = read(path)
    if raw is None:
        return Config()
    if not isinstance(raw, dict):
        raise ConfigError("the configuration is not a mapping")
    return Config(raw)


def check_rule_packs(config: Config, root: str | Path = ".") -> list[str]:
    """Paths of the profile's rule packs, each a mapping with a list of rules."""
    paths = [p for key in ("extractors", "link_rules") for p in config.profile.get(key) or []]
    for p in paths:
        try:
            pack = read(Path(root) / p)
        except FileNotFoundError as error:
            raise RulePackError(f"{p} is missing") from error
        if pack is not None and (not isinstance(pack, dict) or not isinstance(pack.get("rules", []), list)):
            raise RulePackError(f"{p} is no rule pack")
    return [str(p) for p in paths]


SCAFFOLD = {
    "config.json": lambda: Config().snapshot(),
    "config/extractors/core.json": lambda: json.dumps({"rules": []}),
    "config/link_rules/core.json": lambda: json.dumps({"rules": []}),
}
FOLDERS = ("exports/reports", "profiles")


def scaffold(root: str | Path) -> list[str]:
    """Makes a workspace's folders, configuration and empty rule packs; what is there already stays. The paths made."""
    made = []
    for name in FOLDERS:
        if not (Path(root) / name).exists():
            (Path(root) / name).mkdir(parents=True)
            made.append(name)
    for name, text in SCAFFOLD.items():
        path = Path(root) / name
        if not path.exists():
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text(), encoding="utf-8")
            made.append(name)
    return made
