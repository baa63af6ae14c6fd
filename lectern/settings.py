"""Settings with their defaults; whatever is missing or of the wrong kind takes its default."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Limits in characters and numbers, all parameters of the operators."""

    retain_conversations: bool = False
    model: str = ""
    request_budget: int = 64_000
    relevant_budget: int = 24_000
    windows: int = 8
    chunk_target: int = 900
    chunk_maximum: int = 1_200
    candidates: int = 20
    history_budget: int = 48_000
    recent_budget: int = 24_000
    recent_turns: int = 6
    recalled_turns: int = 6
    traces: int = 10
    archive_quota: int = 10 * 1024 * 1024

    @classmethod
    def load(cls, given: dict | None) -> Settings:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: v for k, v in (given or {}).items() if k in kinds and type(v) is kinds[k]})

    def save(self) -> dict:
        return asdict(self)
