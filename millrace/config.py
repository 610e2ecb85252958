"""Limits and settings of the message engine, checked when they are made."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields

from millrace.functions.urls import UnwrapRule


@dataclass(frozen=True)
class EngineConfig:
    max_message_bytes: int = 52_428_800
    max_attachment_bytes: int = 26_214_400
    max_nesting_depth: int = 5
    max_mime_parts: int = 500
    max_inline_body_bytes: int = 262_144
    max_observable_places: int = 50_000
    max_links: int = 50_000
    max_resources: int = 50_000
    unwrap_rules: tuple[UnwrapRule, ...] = ()
    extra_file_extensions: tuple[str, ...] = ()
    #: Milliseconds after which no further message or text of an input is begun; 0 for no end.
    max_input_millis: int = 0
    keep_payloads: bool = True
    suffix_list: str | None = None
    suffix_list_sha256: str | None = None
    media_types: str | None = None
    media_types_sha256: str | None = None

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name.startswith("max_") and (not isinstance(v, int) or isinstance(v, bool) or v < 0):
                raise ValueError(f"{f.name}: a number from 0, not {v!r}")
        for name in ("suffix_list_sha256", "media_types_sha256"):
            if (v := getattr(self, name)) is not None and not re.fullmatch(r"[0-9a-fA-F]{64}", v):
                raise ValueError(f"{name}: 64 hexadecimal digits, not {v!r}")
        object.__setattr__(self, "extra_file_extensions", extensions(self.extra_file_extensions))
        object.__setattr__(self, "unwrap_rules", tuple(self.unwrap_rules))

    @classmethod
    def from_conf(cls, get, prefix: str = "spark.millrace.") -> EngineConfig:
        """From session settings: ``get(name, default)``. Rules and extensions may be JSON."""
        said = {f.name: get(prefix + f.name, None) for f in fields(cls)}
        made: dict = {k: int(v) for k, v in said.items() if v is not None and k.startswith("max_")}
        made |= {k: said[k] for k in ("suffix_list", "suffix_list_sha256", "media_types", "media_types_sha256") if said[k]}
        if said["keep_payloads"] is not None:
            made["keep_payloads"] = str(said["keep_payloads"]).strip().lower() == "true"
        if said["unwrap_rules"]:
            try:
                made["unwrap_rules"] = tuple(UnwrapRule(**r) for r in json.loads(said["unwrap_rules"]))
            except (TypeError, json.JSONDecodeError) as e:
                raise ValueError(f"unwrap_rules: {e}") from e
        if said["extra_file_extensions"]:
            made["extra_file_extensions"] = extensions(said["extra_file_extensions"])
        return cls(**made)


def extensions(said: str | tuple[str, ...] | list[str]) -> tuple[str, ...]:
    """A comma list, a JSON list or a sequence, as sorted extensions in lower case."""
    if isinstance(said, str):
        said = json.loads(said) if said.lstrip().startswith("[") else [x for x in said.split(",") if x.strip()]
    if not isinstance(said, list | tuple) or not all(isinstance(x, str) for x in said):
        raise ValueError("file extensions: a list of texts")
    out = sorted({x.strip().lower().removeprefix(".") for x in said})
    if bad := [x for x in out if not re.fullmatch(r"[a-z0-9][a-z0-9_+-]*", x)]:
        raise ValueError(f"file extensions: not {', '.join(map(repr, bad))}")
    return tuple(out)
