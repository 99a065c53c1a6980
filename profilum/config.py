"""Folders and defaults: environment, then a TOML file, then the platform's usual places."""

from __future__ import annotations

import os
import sys
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

DATA_VARIABLE, CONFIG_VARIABLE = "PROFILUM_DATA_DIR", "PROFILUM_CONFIG_DIR"


def _usual(kind: str) -> Path:
    home = Path.home()
    if sys.platform == "darwin":
        return home / "Library/Application Support/profilum"
    if sys.platform == "win32":
        return Path(os.environ.get("APPDATA", home)) / "profilum"
    base = os.environ.get("XDG_DATA_HOME" if kind == "data" else "XDG_CONFIG_HOME")
    return (Path(base) if base else home / (".local/share" if kind == "data" else ".config")) / "profilum"


@dataclass
class Config:
    """Where databases and state lie, and defaults of searches."""

    data_dir: Path
    config_dir: Path
    defaults: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def load(cls) -> "Config":
        config_dir = Path(os.environ.get(CONFIG_VARIABLE) or _usual("config"))
        told: dict[str, Any] = {}
        if (file := config_dir / "config.toml").exists():
            told = tomllib.loads(file.read_text(encoding="utf-8"))
        data_dir = Path(os.environ.get(DATA_VARIABLE) or told.get("data_dir") or _usual("data"))
        return cls(data_dir, config_dir, dict(told.get("defaults", {})))

    def ensure_dirs(self) -> None:
        self.data_dir.mkdir(parents=True, exist_ok=True)
        self.config_dir.mkdir(parents=True, exist_ok=True)

    def resolve(self, path: str) -> Path:
        """An absolute path, or one below the data folder."""
        return Path(path) if Path(path).is_absolute() else self.data_dir / path


_config: Config | None = None


def get_config() -> Config:
    global _config
    _config = _config or Config.load()
    return _config


def reset_config() -> None:
    """Forget what was loaded, as after a change of the environment."""
    global _config
    _config = None
