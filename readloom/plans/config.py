"""Settings of a library, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

CHEMISTRIES = ("none", "unstranded", "fiveprime", "threeprime")
UNION, FALLBACK, FORCE = 0, 1, 2


@dataclass(frozen=True)
class Config:
    score_percent: float = 0.0
    score_threshold: int = 0
    score_filter: int = 0
    num_mismatches: int = 0
    discard_multiple_matches: bool = False
    require_valid_pair: bool = False
    discard_multi_hits: int = 0
    intersect_level: int = UNION
    max_hits_to_report: int = 1000
    group_on: str = ""
    trim_target_length: int = 40
    trim_strictness: float = 0.9
    chemistry: str = "none"
    discard_nonzero_mismatch: bool = False
    #: Reproduce odd behaviour of existing outputs: mates swapped in BAM results, a failed forced intersection reported as an empty
    #: class, tags that aren't text left empty, a lone read in the second slot, reads without qualities trimmed away.
    compat: bool = False

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            kind = {"float": (int, float), "int": int, "bool": bool, "str": str}[f.type]
            if not isinstance(value, kind) or (f.type in ("int", "float") and isinstance(value, bool)):
                raise ValueError(f"{f.name} must be a {f.type}, not {value!r}")
        for name in ("score_percent", "trim_strictness"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        for name in ("score_threshold", "score_filter", "num_mismatches", "discard_multi_hits", "max_hits_to_report", "trim_target_length"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.intersect_level not in (UNION, FALLBACK, FORCE):
            raise ValueError("intersect_level must be 0, 1 or 2")
        if self.chemistry not in CHEMISTRIES:
            raise ValueError(f"chemistry must be one of {', '.join(CHEMISTRIES)}")

    def trimmed_to(self, target: int, strictness: float) -> Config:
        return replace(self, trim_target_length=target, trim_strictness=strictness)


#: Keys that a library file must hold.
REQUIRED = tuple(f.name for f in fields(Config) if f.name not in ("chemistry", "discard_nonzero_mismatch", "compat"))


def from_json(found: dict, chemistry: str = "none") -> Config:
    """The settings of a library file; a missing key is an error, unknown ones are ignored."""
    missing = [k for k in REQUIRED if k not in found]
    if missing:
        raise ValueError(f"the library's settings lack {missing[0]}")
    return Config(**{k: found[k] for k in REQUIRED}, chemistry=chemistry)


def trim_overrides(text: str, configs: list[Config]) -> list[Config]:
    """``length:strictness`` per library, separated by commas."""
    parts = [p.split(":") for p in text.split(",")]
    if len(parts) != len(configs):
        raise ValueError(f"{len(parts)} trim settings for {len(configs)} libraries")
    return [c.trimmed_to(int(a), float(b)) for c, (a, b) in zip(configs, parts)]
