"""Settings from a mapping of names (usually the environment)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from tessera.operators.vector import Identity
from tessera.sources.providers import BatchProvider, Provider, SingleProvider

PREFIX = "TESSERA_"
LEVELS = ("CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG")
EMBEDDING = ("BASE_URL", "API_KEY", "MODEL", "DIMENSION", "BATCH_SIZE")


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    store: str
    log_level: str = "INFO"
    default_repo: str | None = None
    require_repo: bool = False
    alias_file: str | None = None
    provider: Provider | None = None


def flag(value: str, name: str) -> bool:
    low = value.strip().lower()
    if low in ("1", "true", "yes", "on"):
        return True
    if low in ("0", "false", "no", "off"):
        return False
    raise SettingsError(f"{name} must be true or false")


def positive(value: str, name: str) -> int:
    if not value.strip().isdecimal() or int(value) <= 0:
        raise SettingsError(f"{name} must be a positive integer")
    return int(value)


def load(env: Mapping[str, str], embeddings: bool = True) -> Settings:
    """The embedding settings are complete or absent; without embeddings they are ignored."""
    get = lambda name: (env.get(PREFIX + name) or "").strip() or None
    if not get("STORE"):
        raise SettingsError(f"{PREFIX}STORE is missing")
    level = (get("LOG_LEVEL") or "INFO").upper()
    if level not in LEVELS:
        raise SettingsError(f"{PREFIX}LOG_LEVEL must be one of {', '.join(LEVELS)}")
    provider = None
    values = {n: get(f"EMBEDDING_{n}") for n in ("PROVIDER", *EMBEDDING)}
    if embeddings and any(values.values()):
        if absent := [f"{PREFIX}EMBEDDING_{n}" for n in EMBEDDING if not values[n]]:
            raise SettingsError(f"incomplete embedding settings, missing {', '.join(absent)}")
        kind = (values["PROVIDER"] or "openai").lower()
        classes = {"openai": BatchProvider, "infer": SingleProvider}
        if kind not in classes:
            raise SettingsError(f"unknown embedding provider {kind}")
        identity = Identity(kind, values["MODEL"], positive(values["DIMENSION"], f"{PREFIX}EMBEDDING_DIMENSION"))
        provider = classes[kind](identity, values["BASE_URL"], values["API_KEY"], positive(values["BATCH_SIZE"], f"{PREFIX}EMBEDDING_BATCH_SIZE"))
    return Settings(get("STORE"), level, get("DEFAULT_REPO"), flag(get("REQUIRE_REPO") or "false", f"{PREFIX}REQUIRE_REPO"), get("ALIAS_FILE"), provider)


def redacted(url: str) -> str:
    """A location without its password."""
    head, sep, rest = url.partition("://")
    who, at, place = rest.rpartition("@")
    return f"{head}{sep}{who.split(':')[0]}:***@{place}" if at and ":" in who else url
