"""Settings with their defaults; overlays win over them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Settings:
    model: str = "free"
    voice_id: str = ""
    speed: float = 1.0
    volume: float = 0
    language: str = "en"
    skip_code: bool = True
    skip_tables: bool = False
    read_headings: bool = True
    read_figures: bool = True
    max_chunk_chars: int = 420
    first_chunk_chars: int = 180
    hard_wrap_chars: int = 1800
    prefetch_ahead: int = 2
    #: "uax29" follows Unicode's rules in Python; "regex" splits sentences in Spark's own expressions.
    sentences: str = "uax29"
    #: Tables with cells are read with each cell's header.
    pair_tables: bool = False


def overlaid(*layers: Mapping[str, Any] | None, base: Settings | None = None) -> Settings:
    """Defaults, then each layer in turn. Unknown keys are an error, None keeps what is there."""
    known = {f.name for f in fields(Settings)}
    out = base or Settings()
    for layer in layers:
        if layer:
            if unknown := set(layer) - known:
                raise KeyError(f"unknown settings: {sorted(unknown)}")
            out = replace(out, **{k: v for k, v in layer.items() if v is not None})
    return out
