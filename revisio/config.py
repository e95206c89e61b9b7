"""Settings: explicit values, then the environment, a dotenv file, defaults, and at last a prompt."""
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Callable

MISSING = object()
#: Texts of booleans.
TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


def text(value):
    if not isinstance(value, str) or not value.strip():
        raise ValueError("expected a nonblank text")
    return value


def boolean(value):
    if isinstance(value, bool):
        return value
    said = value.strip().casefold() if isinstance(value, str) else None
    if said not in TRUE + FALSE:
        raise ValueError("expected a boolean")
    return said in TRUE


def integer(value):
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise ValueError("expected an integer")
    return int(value) if isinstance(value, int) else int(value.strip(), 10)


def positive(value):
    if integer(value) < 1:
        raise ValueError("expected a positive integer")
    return integer(value)


def path(value):
    return value if isinstance(value, Path) else Path(text(value))


def json_object(value):
    made = json.loads(text(value)) if isinstance(value, str) else value
    if not isinstance(made, dict) or not all(isinstance(k, str) for k in made):
        raise ValueError("expected a JSON object")
    return made


@dataclass(frozen=True)
class Setting:
    name: str
    parse: Callable = text
    variable: str | None = None
    default: object = MISSING
    prompt: str | None = None
    secret: bool = False
    blank_is_missing: bool = True


@dataclass(frozen=True)
class Resolved:
    """Values by name; sources tell where each came from. Secrets do not show in its text."""
    values: dict
    sources: dict
    secrets: frozenset = field(default_factory=frozenset)

    def __getitem__(self, name):
        return self.values[name]

    def __repr__(self):
        shown = {k: "***" if k in self.secrets else v for k, v in self.values.items()}
        return f"Resolved({shown})"


def dotenv(path, encoding="utf-8"):
    """NAME=value lines; comments, `export` and matching quotes are dropped."""
    out = {}
    for n, line in enumerate(Path(path).read_text(encoding).splitlines(), 1):
        line = line.strip().removeprefix("export ").strip()
        if not line or line.startswith("#"):
            continue
        name, sign, value = line.partition("=")
        if not sign or not name.strip().isidentifier():
            raise ValueError(f"dotenv line {n} is no NAME=value")
        value = value.strip()
        out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def resolve(settings, explicit=None, environment=None, dotenv=None, ask=None):
    """All settings, or an error that names what is missing, unknown or refused. ask(prompt, secret) reads from a person."""
    explicit, environment, dotenv = explicit or {}, environment or {}, dotenv or {}
    names = [s.name for s in settings]
    variables = [s.variable for s in settings if s.variable]
    if len(set(names)) < len(names) or len(set(variables)) < len(variables):
        raise ValueError("settings or variables are repeated")
    if unknown := sorted(set(explicit) - set(names)):
        raise ValueError(f"unknown settings {unknown}")
    values, sources, missing = {}, {}, []
    for s in settings:
        found = [(explicit.get(s.name), "explicit"), (environment.get(s.variable), "environment"), (dotenv.get(s.variable), "dotenv"), (None if s.default is MISSING else s.default, "default")]
        usable = [(v, w) for v, w in found if (v is not None or w == "default" and s.default is None) and not (s.blank_is_missing and isinstance(v, str) and not v.strip())]
        if not usable and ask and s.prompt:
            said = ask(s.prompt, s.secret)
            usable = [(said, "prompt")] if said and said.strip() else []
        if not usable:
            missing.append(s.name)
            continue
        value, source = usable[0]
        try:
            values[s.name] = value if source == "default" and value is None else s.parse(value)
        except (TypeError, ValueError) as e:
            raise ValueError(f"setting {s.name} from {source}: {'refused' if s.secret else e}") from None
        sources[s.name] = source
    if missing:
        raise ValueError(f"missing settings {missing}")
    return Resolved(values, sources, frozenset(s.name for s in settings if s.secret))
