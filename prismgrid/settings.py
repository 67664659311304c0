"""Settings of a capture: strict keys, refusal without authority, and plain checks."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from urllib.parse import urlparse

PRODUCTION = ("prod", "production")


@dataclass(frozen=True)
class Settings:
    """A flat capture configuration; unknown keys are an error."""

    target: str = ""
    start_url: str | None = None
    environment: str | None = None
    authorized: bool | None = None
    authorized_by: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    modules: dict[str, str] = field(default_factory=dict)
    drop_params: tuple[str, ...] = ()
    dedupe_queries: bool = False
    hash_routes: bool = False
    max_pages: int = 25
    max_depth: int = 3
    max_interactions: int = 40
    block_words: tuple[str, ...] = ()
    caution_words: tuple[str, ...] = ()
    never_touch: tuple[str, ...] = ()
    redact_entities: tuple[str, ...] | None = None
    replace_style: str = "tag"
    person_names: tuple[str, ...] = ()
    network_keys: tuple[str, ...] = ()
    auth_required: bool = False
    auth_state_file: str | None = None
    keep_history: bool = True
    retention_days: int = 0
    adapters: tuple[dict, ...] = ()

    @classmethod
    def of(cls, values: dict) -> Settings:
        known = {f.name: f for f in fields(cls)}
        if unknown := sorted(set(values) - set(known)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    def dumped(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False, default=str)

    def digest(self) -> str:
        """Equal for equal resolved settings, wherever they came from."""
        return hashlib.sha256(self.dumped().encode()).hexdigest()

    def over(self, **flags) -> Settings:
        """Given flags win over the file's values; None means not given."""
        return Settings.of(asdict(self) | {k: v for k, v in flags.items() if v is not None})

    def refusal(self) -> str | None:
        """Why a run against production must not start; None if it may."""
        if (self.environment or "").strip().lower() not in PRODUCTION:
            return None
        lacking = [n for n, ok in (("authorized: true", self.authorized is True), ("authorized_by", bool((self.authorized_by or "").strip()))) if not ok]
        return f"production needs {' and '.join(lacking)}" if lacking else None

    def advice(self) -> list[str]:
        """What to look at twice; nothing here stops a run."""
        checks = (
            (self.authorized is not True, "nobody confirmed that this target may be captured"),
            (bool(self.authorized) and not self.authorized_by, "who approved the capture is not recorded"),
            ((self.environment or "").lower() in PRODUCTION, "the environment is production"),
            (not self.start_url and not self.modules, "there is neither a start URL nor a module"),
            (self.auth_required and not self.auth_state_file, "a session is required but none is named"),
            (not self.keep_history, "new captures replace old ones, so nothing is left to compare"),
        )
        return [text for hit, text in checks if hit]


def load(path: str) -> Settings:
    """Read JSON, or YAML where a YAML reader is installed; a byte order mark is skipped."""
    text = Path(path).read_text(encoding="utf-8-sig")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML settings need a YAML reader; use JSON") from e
        return Settings.of(yaml.safe_load(text) or {})
    return Settings.of(json.loads(text))


def session_expiry(state: dict, target_url: str, now: float) -> dict:
    """What the target's bearer tokens say of a saved session: the longest-lived counts."""
    host, best = urlparse(target_url).netloc.lower(), None
    for origin in state.get("origins") or []:
        own = urlparse(origin.get("origin", "")).netloc.lower()
        if own and own != host:
            continue
        for item in origin.get("localStorage") or []:
            parts = str(item.get("value", "")).split(".")
            if len(parts) == 3:
                try:
                    exp = json.loads(base64.urlsafe_b64decode(parts[1] + "=" * (-len(parts[1]) % 4))).get("exp")
                except (ValueError, AttributeError):
                    continue
                if isinstance(exp, (int, float)) and (best is None or exp > best):
                    best = exp
    return {"known": False} if best is None else {"known": True, "seconds_remaining": best - now, "expired": best <= now}


def command_line(args: list[str]) -> str:
    """An invocation for the record: folders of scripts, sessions and outputs left out."""
    out, bare = [], False
    for a in args:
        out.append(Path(a).name if bare or a.endswith(".py") else a)
        bare = a in ("--auth-state", "--output")
    return " ".join(out)[:500]


def describe_envelope(settings: Settings) -> dict:
    """The safety rules in force as plain sorted data, defaults and additions counted together."""
    from prismgrid.functions.identity import ALLOWED_INTERACTIONS, BLOCK_WORDS, CAUTION_WORDS

    extra = {k: sorted({w.lower() for w in words}) for k, words in (("block", settings.block_words), ("caution", settings.caution_words))}
    return {
        "allow_list": sorted(ALLOWED_INTERACTIONS),
        "block_words": len({*BLOCK_WORDS, *extra["block"]}),
        "caution_words": len({*CAUTION_WORDS, *extra["caution"]}),
        "block_words_extra": extra["block"],
        "caution_words_extra": extra["caution"],
        "never_touch": list(settings.never_touch),
    }


#: A session that ends sooner than this many seconds is worth a warning.
SOON = 1800


def describe_session(state: dict | None, path: str, target_url: str, now: float) -> list[str]:
    """What to tell before a run with a saved session; nothing without one."""
    if not state:
        return []
    found = session_expiry(state, target_url, now)
    if not found["known"]:
        return [f"info: session {path} says nothing readable of its end"]
    left = found["seconds_remaining"]
    if found["expired"]:
        return [f"error: session {path} ended {-left / 3600:.1f} h ago", "error: sign in again before the run"]
    if left < SOON:
        return [f"warning: session {path} ends in {left / 60:.0f} min, perhaps during the run"]
    return [f"info: session {path} holds for {left / 3600:.1f} h"]


def output_folder(root: str, product: str, keep_history: bool, day: str) -> str:
    """``root/product``, or ``root/day/product`` where captures are kept for comparison."""
    return str(Path(root, day, product) if keep_history else Path(root, product))
