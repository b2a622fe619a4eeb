"""Small files that the driver reads: questions of the recall gate, identities, and the trust of agents."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import InvalidInput
from ..functions.scores import TRUST_FLOOR

#: Hits looked at for a question that doesn't say.
DEFAULT_K = 10
TOKEN = r"[a-z]+_[0-9a-f]{64}"


@dataclass(frozen=True)
class Question:
    q: str
    must_reference_entities: tuple[str, ...] = ()
    k: int = DEFAULT_K


@dataclass(frozen=True)
class EvalFile:
    name: str
    scope: str
    queries: tuple[Question, ...]


@dataclass(frozen=True)
class Identity:
    """Who asks: never taken from a request's own fields."""

    actor_type: str
    actor_id: str
    scope: str


@dataclass(frozen=True)
class Trust:
    """Agents whose facts count at once, from a confidence on."""

    whitelist: tuple[str, ...] = field(default=())
    floor: float = TRUST_FLOOR


def parse_eval(text: str) -> EvalFile:
    """Questions from YAML, of which JSON is a part; without a YAML parser, JSON alone is read."""
    try:
        import yaml
    except ImportError:
        data = json.loads(text)
    else:
        data = yaml.safe_load(text)
    items = [Question(str(q["q"]), tuple(map(str, q.get("must_reference_entities") or ())), int(q.get("k") or DEFAULT_K)) for q in data.get("queries") or ()]
    return EvalFile(str(data.get("name", "")), str(data.get("scope", "")), tuple(items))


def read_evals(folder: str) -> list[EvalFile]:
    """All files of questions in a folder, by name; none at all is an error."""
    paths = sorted(p for p in Path(folder).iterdir() if p.suffix in (".yaml", ".yml", ".json"))
    if not paths:
        raise FileNotFoundError(f"{folder} has no file of questions")
    return [parse_eval(p.read_text(encoding="utf-8")) for p in paths]


def parse_identities(text: str) -> dict[str, Identity]:
    """Identities by token from a JSON list of objects with just the fields token, actor_type, actor_id and scope. All
    are checked before any counts: what isn't whole gives access to nobody."""
    rows = json.loads(text)
    if not isinstance(rows, list) or not rows:
        raise InvalidInput("a list of identities is needed")
    out: dict[str, Identity] = {}
    for n, row in enumerate(rows, 1):
        if not isinstance(row, dict) or set(row) - {"token", "actor_type", "actor_id", "scope"}:
            raise InvalidInput(f"identity {n} has other fields")
        token, *rest = (str(row.get(k, "")).strip() for k in ("token", "actor_type", "actor_id", "scope"))
        who = Identity(*rest)
        wrong = (
            "token" if not re.fullmatch(TOKEN, token)
            else "actor_type" if who.actor_type not in ("human", "agent")
            else "actor_id" if not who.actor_id
            else "scope" if not who.scope
            else "token, which is there twice" if token in out
            else ""
        )
        if wrong:
            raise InvalidInput(f"identity {n} has a wrong {wrong}")
        out[token] = who
    return out


def identify(header: str | None, known: dict[str, Identity]) -> Identity | None:
    """Who sent `Authorization: Bearer <token>`; nobody, if it isn't known."""
    kind, _, token = (header or "").strip().partition(" ")
    return known.get(token.strip()) if kind.lower() == "bearer" else None


def parse_trust(whitelist: str | None = None, floor: str | None = None, default: Trust = Trust()) -> Trust:
    """Trust from two settings: ids between commas replace the default list as a whole; a floor that isn't set, is no
    number, or lies outside [0, 1] is the usual one."""
    names = tuple(x.strip() for x in whitelist.split(",") if x.strip()) if whitelist is not None else default.whitelist
    try:
        value = float(floor) if floor is not None else TRUST_FLOOR
    except ValueError:
        value = TRUST_FLOOR
    return Trust(names, value if not math.isnan(value) and 0 <= value <= 1 else TRUST_FLOOR)


def strict_int(raw: str, name: str) -> int:
    """An integer written the one usual way: neither 07 nor +7, nor with blanks."""
    if not re.fullmatch(r"0|-?[1-9][0-9]*", raw):
        raise InvalidInput(f"{name} must be an integer")
    return int(raw)
