"""The nine record contracts as Spark types, printed as JSON Schema; and the loader of provider manifests."""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

S, L, I, B, D, AT = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampType()  # noqa: E741


def _record(*fields, optional: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(name, kind, name in optional) for name, kind in fields])


_LINK = _record(("text", S), ("url", S))
_ARTIFACT = _record(("role", S), ("path", S), ("media_type", S), ("sha256", S), ("bytes", L))
_ATTEMPT = _record(("adapter", S), ("status", S), ("code", S), ("message", S), ("retryable", B), ("http_status", I), ("method", S), ("raw_bytes", L), optional=("code", "message", "http_status", "method", "raw_bytes"))
_CANDIDATE = _record(("rank", L), ("title", S), ("locator", S), ("snippet", S), ("provider", S), ("scope", S), ("source_class", S), ("evidence_state", S), ("sensitivity", S), ("published_at", S), ("provider_rank", L), optional=("published_at", "provider_rank"))
_SEARCH_ATTEMPT = _record(("provider", S), ("scope", S), ("status", S), ("candidate_count", L), ("code", S), ("message", S), optional=("code", "message"))
_PROVIDED = _record(("title", S), ("locator", S), ("snippet", S), ("published_at", S), ("metadata", T.MapType(S, S)), optional=("published_at", "metadata"))
_SPEC = _record(("name", S), ("scope", S), ("command", T.ArrayType(S, False)), ("timeout_seconds", D), ("sensitivity", S), ("source_class", S), ("isolated", B), optional=("timeout_seconds", "sensitivity", "source_class", "isolated"))
_PAGE = _record(("url", S), ("depth", I), ("status", S), ("bundle_path", S), ("error_code", S), optional=("bundle_path", "error_code"))

CONTRACTS = {
    "crawl": _record(("crawl_id", S), ("root_url", S), ("reader", S), ("policy_sha256", S), ("crawl_state_sha256", S), ("created_at", S), ("status", S), ("max_pages", I), ("max_depth", I), ("pages", T.ArrayType(_PAGE, False)), ("failures_by_code", T.MapType(S, L, False))),
    "doctor": _record(("name", S), ("status", S), ("capability", S)),
    "error": _record(("error", S), ("message", S), ("retryable", B)),
    "evidence": _record(("receipt_id", S), ("requested_url", S), ("final_url", S), ("status", S), ("route", T.ArrayType(S, False)), ("source_sha256", S), ("source_bytes", L), ("normalized_chars", L), ("anchor_count", L), ("link_count", L), ("policy_sha256", S), ("remote_adapter_used", B), ("authenticated_adapter_used", B), ("robots_status", S), ("title", S), ("method", S), ("warnings", T.ArrayType(S, False)), ("artifacts", T.ArrayType(_ARTIFACT, False)), ("attempts", T.ArrayType(_ATTEMPT, False)), optional=("title", "method", "robots_status")),
    "provider-manifest": _record(("providers", T.ArrayType(_SPEC, False))),
    "provider-request": _record(("query", S), ("limit", I), ("provider", S), ("scope", S)),
    "provider-response": _record(("candidates", T.ArrayType(_PROVIDED, False)), ("warnings", T.ArrayType(S, False)), optional=("warnings",)),
    "provider-search": _record(("query", S), ("candidates", T.ArrayType(_CANDIDATE, False)), ("attempts", T.ArrayType(_SEARCH_ATTEMPT, False)), ("warnings", T.ArrayType(S, False))),
    "search": _record(("query", S), ("scopes", T.ArrayType(S, False)), ("status", S), ("sensitivity", S), ("candidates", T.ArrayType(_CANDIDATE, False)), ("attempts", T.ArrayType(_SEARCH_ATTEMPT, False)), ("warnings", T.ArrayType(S, False))),
}
MOST_MANIFEST_BYTES = 1_000_000
_NAMES = {S: "string", L: "integer", I: "integer", B: "boolean", D: "number", AT: "string"}


def json_schema(kind: T.DataType) -> dict:
    """A Spark type as JSON Schema; records are closed."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind}, "required": [f.name for f in kind if not f.nullable], "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    return {"type": _NAMES[kind]}


def schema(contract: str) -> dict:
    if contract not in CONTRACTS:
        raise ValueError(f"invalid_input: unknown contract {contract}; known are {', '.join(sorted(CONTRACTS))}")
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": contract, **json_schema(CONTRACTS[contract])}


def load_manifest(raw: bytes) -> list[dict]:
    """Specs of command providers from a manifest of at most a megabyte: closed fields, names, scopes, sensitivities,
    isolation and commands are checked; the first fault is `invalid_input`."""
    if len(raw) > MOST_MANIFEST_BYTES:
        raise ValueError("invalid_input: provider manifest exceeds one megabyte")
    try:
        value = json.loads(raw.decode())
    except ValueError as e:
        raise ValueError(f"invalid_input: provider manifest is no JSON: {e}") from e
    if not isinstance(value, dict) or set(value) - {"providers", "schema_version"} or not isinstance(value.get("providers", []), list):
        raise ValueError("invalid_input: provider manifest holds providers alone")
    out, names = [], set()
    known = {f.name: f.dataType for f in _SPEC}
    for pos, spec in enumerate(value.get("providers", [])):
        if not isinstance(spec, dict) or (odd := set(spec) - set(known)):
            raise ValueError(f"invalid_input: unknown fields in provider {pos}: {sorted(odd) if isinstance(spec, dict) else spec!r}")
        row = {"timeout_seconds": 60.0, "sensitivity": "public", "source_class": "external-candidate", "isolated": False} | spec | {"pos": pos}
        name, scope, command = row.get("name"), row.get("scope"), row.get("command")
        pattern = r"[a-z][a-z0-9_-]{0,63}"
        faults = (
            (not all(isinstance(x, str) and re.fullmatch(pattern, x) for x in (name, scope)), "name pattern"),
            (name in ("workspace", "exa", "github"), "reserved provider name"),
            (scope in ("auto", "local", "public"), "reserved scope"),
            (name in names, "duplicate provider name"),
            (row["sensitivity"] not in ("public", "project", "account-visible", "internal"), "unknown sensitivity"),
            (row["sensitivity"] == "internal" and row["isolated"] is not True, "internal provider must be isolated"),
            (not isinstance(row["isolated"], bool), "isolated is true or false"),
            (not isinstance(row["timeout_seconds"], int | float) or isinstance(row["timeout_seconds"], bool) or not 0 < row["timeout_seconds"] <= 300, "timeout_seconds must be above 0 and at most 300"),
            (not isinstance(command, list) or not command or not all(isinstance(c, str) and c and "\x00" not in c for c in command), "empty command part"),
        )
        for broken, rule in faults:
            if broken:
                raise ValueError(f"invalid_input: {rule}: {name}")
        names.add(name)
        out.append(row)
    return out
