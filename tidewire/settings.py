"""What a deployment sets from outside: services, keys and the report's time zone."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from . import params


@dataclass(frozen=True)
class Settings:
    """Services and keys; without a URL a service is not there."""

    search_url: str | None = None
    search_key: str | None = None
    second_url: str | None = None
    second_key: str | None = None
    model_url: str | None = None
    model_key: str | None = None
    model: str = ""
    zone: str = params.REPORT_TIMEZONE
    timeout: float = 60.0

    @classmethod
    def from_environment(cls, environ: Mapping[str, str] | None = None) -> Settings:
        """The values of TIDEWIRE_SEARCH_URL, TIDEWIRE_ZONE and so on; empty ones count as not set."""
        given = os.environ if environ is None else environ
        found = {name: given.get(f"TIDEWIRE_{name.upper()}", "").strip() for name in cls.__dataclass_fields__}
        values = {k: float(v) if k == "timeout" else v for k, v in found.items() if v}
        if "zone" in values:
            from zoneinfo import ZoneInfo

            ZoneInfo(values["zone"])  # fails here rather than within a plan
        return cls(**values)
