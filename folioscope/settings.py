"""All knobs of a run as frozen dataclasses, read from YAML, overridden by the environment, hashed canonically."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import PurePath
from typing import Any

PREFIX = "FOLIOSCOPE_"


@dataclass(frozen=True)
class Chunking:
    size: int = 448
    overlap: int = 64
    unit: str = "tokens"
    table_mode: str = "flat"

    def __post_init__(self) -> None:
        if self.overlap >= self.size:
            raise ValueError("overlap must be smaller than size")
        if self.unit not in ("tokens", "chars") or self.table_mode not in ("flat", "markdown", "linearized"):
            raise ValueError(f"unknown unit {self.unit!r} or table mode {self.table_mode!r}")


@dataclass(frozen=True)
class Sparse:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    stopwords: bool = False


@dataclass(frozen=True)
class Retrieval:
    backend: str = "dense"
    top_k: int = 50

    def __post_init__(self) -> None:
        if self.backend not in ("dense", "sparse", "hybrid", "frozen") or self.top_k < 1:
            raise ValueError(f"unknown backend {self.backend!r} or top_k under 1")


@dataclass(frozen=True)
class Fusion:
    k: int = 60
    dense_weight: float = 1.0
    sparse_weight: float = 1.0


@dataclass(frozen=True)
class Rerank:
    enabled: bool = False
    top_n: int = 5
    revision: str = ""


@dataclass(frozen=True)
class Evaluation:
    metrics: tuple[str, ...] = ("recall@10", "recall@50", "recall@k", "ndcg@10", "mrr", "hit@1")
    gated: tuple[str, ...] = ("recall@10", "ndcg@10", "recall@50")
    gate_tolerance: float = 0.02
    context_size: int = 50


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    sparse: Sparse = field(default_factory=Sparse)
    retrieval: Retrieval = field(default_factory=Retrieval)
    fusion: Fusion = field(default_factory=Fusion)
    rerank: Rerank = field(default_factory=Rerank)
    evaluation: Evaluation = field(default_factory=Evaluation)


def _cast(old: Any, new: Any) -> Any:
    if isinstance(old, bool):
        return new if isinstance(new, bool) else str(new).lower() in ("1", "true", "yes")
    if isinstance(old, tuple):
        return tuple(json.loads(new) if isinstance(new, str) else new)
    return type(old)(new)


def _updated(section: Any, values: Mapping[str, Any]) -> Any:
    known = {f.name: getattr(section, f.name) for f in fields(section)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return replace(section, **{k: _updated(known[k], v) if is_dataclass(known[k]) else _cast(known[k], v) for k, v in values.items()})


def load(path: str | None = None, environ: Mapping[str, str] | None = None) -> Settings:
    """Defaults, then the YAML file, then variables such as ``FOLIOSCOPE_RETRIEVAL__TOP_K``; unknown names raise."""
    settings = Settings()
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            settings = _updated(settings, yaml.safe_load(f) or {})
    given: dict[str, dict[str, str]] = {}
    for name, value in (os.environ if environ is None else environ).items():
        if name.startswith(PREFIX) and "__" in name:
            section, _, key = name[len(PREFIX) :].lower().partition("__")
            given.setdefault(section, {})[key] = value
    return _updated(settings, given)


def _plain(value: Any) -> Any:
    if isinstance(value, Mapping):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value.as_posix() if isinstance(value, PurePath) else value


def canonical_json(value: Any) -> str:
    """Compact JSON with sorted keys, paths with forward slashes."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def config_hash(settings: Settings) -> str:
    """SHA-256 of the canonical JSON of all knobs."""
    return hashlib.sha256(canonical_json(asdict(settings)).encode()).hexdigest()


def run_label(s: Settings) -> str:
    """A run's name: backend, then what differs from the defaults."""
    parts = [s.retrieval.backend]
    if s.sparse.stopwords:
        parts.append("stopwords")
    if s.retrieval.backend == "hybrid":
        parts.append(f"sw{s.fusion.sparse_weight:g}")
    if s.rerank.enabled:
        parts.append("rerank")
    if s.retrieval.top_k != 50:
        parts.append(f"k{s.retrieval.top_k}")
    return " ".join(parts)
