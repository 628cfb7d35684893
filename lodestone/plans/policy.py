"""The policy of a run: bounded settings, and the digest that ties a crawl to them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, replace

from lodestone.functions.urls import normalize_domains

#: Bounds of the numbers: least (open where None), most.
BOUNDS = {
    "timeout_seconds": (0.0, 120.0),
    "max_bytes": (1_024, 50_000_000),
    "max_redirects": (0, 10),
    "min_interval_seconds": (0.0, 60.0),
    "min_normalized_chars": (1, 10_000),
    "max_pages": (1, 1_000),
    "max_depth": (0, 10),
}


@dataclass(frozen=True)
class Policy:
    user_agent: str = "Lodestone/1.0"
    timeout_seconds: float = 20.0
    max_bytes: int = 5_000_000
    max_redirects: int = 5
    obey_robots: bool = True
    robots_fail_closed: bool = True
    deny_private_networks: bool = True
    allow_subdomains: bool = True
    require_https: bool = False
    allow_remote: bool = False
    allow_authenticated: bool = False
    min_interval_seconds: float = 1.0
    min_normalized_chars: int = 160
    max_pages: int = 20
    max_depth: int = 1
    allowed_domains: list[str] = field(default_factory=list)
    denied_domains: list[str] = field(default_factory=list)

    def __post_init__(self):
        for name, (least, most) in BOUNDS.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int | float) or not least <= value <= most or (name == "timeout_seconds" and value <= 0):
                raise ValueError(f"invalid_input: {name} must be within {least} and {most}")
        for name in ("allowed_domains", "denied_domains"):
            object.__setattr__(self, name, normalize_domains(getattr(self, name)))

    def override(self, **settings) -> Policy:
        """A copy with other settings, which are checked again; consent to authenticated readers includes remote ones."""
        if settings.get("allow_authenticated"):
            settings["allow_remote"] = True
        return replace(self, **{k: v for k, v in settings.items() if v is not None})

    def digest(self) -> str:
        body = json.dumps(asdict(self), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        return hashlib.sha256(body.encode()).hexdigest()


def load_policy(text: str) -> Policy:
    """A policy from JSON; unknown fields are errors."""
    values = json.loads(text)
    if not isinstance(values, dict) or (unknown := set(values) - {f.name for f in fields(Policy)}):
        raise ValueError(f"invalid_input: unknown settings {sorted(unknown) if isinstance(values, dict) else values!r}")
    return Policy(**values)
