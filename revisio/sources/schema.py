"""Schema documents: {"columns": [{"name", "type", "nullable"?}]}; nothing is inferred."""
import json
from pathlib import Path

from revisio.sources.convert import TYPES


def parse(document):
    """[(name, type, nullable)] of a decoded document; names are unique and not blank, nullable is false unless said."""
    if not isinstance(document, dict) or set(document) != {"columns"} or not isinstance(document["columns"], list) or not document["columns"]:
        raise ValueError("a schema is an object with a list of columns")
    out = []
    for c in document["columns"]:
        if not isinstance(c, dict) or not {"name", "type"} <= set(c) <= {"name", "type", "nullable"}:
            raise ValueError("a column has a name, a type and perhaps nullable")
        if not isinstance(c["name"], str) or not c["name"].strip() or c["name"] in {n for n, _, _ in out}:
            raise ValueError(f"column name {c['name']!r} is blank or repeated")
        if c["type"] not in TYPES or not isinstance(c.get("nullable", False), bool):
            raise ValueError(f"column {c['name']}: unknown type or nullable is no boolean")
        out.append((c["name"], c["type"], c.get("nullable", False)))
    return out


def load(path):
    return parse(json.loads(Path(path).read_text("utf-8")))


def require(schema, names):
    """Raises if a schema lacks columns that an analysis needs."""
    missing = sorted(set(names) - {n for n, _, _ in schema})
    if missing:
        raise ValueError(f"schema lacks required columns {missing}")


def same_names(columns, schema):
    """Raises unless the columns are the schema's, in any order, none blank or repeated."""
    names = [n for n, _, _ in schema]
    blank, twice, odd = [c for c in columns if not str(c).strip()], sorted({c for c in columns if list(columns).count(c) > 1}), sorted(set(columns) ^ set(names))
    if blank or twice or odd:
        raise ValueError(f"header: {len(blank)} blank, repeated {twice}, missing or unexpected {odd}")
