"""Settings: defaults, a base given by the caller, then the environment, each validated."""

from __future__ import annotations

import copy
import os
from dataclasses import dataclass, field, fields
from urllib.parse import quote

from factloom.model import GraphError, check_identifier


def _ranged(low, high, default):
    return field(default=default, metadata={"range": (low, high)})


@dataclass
class Guardrails:
    max_entity_types: int = _ranged(1, 50, 15)
    similarity_threshold: float = _ranged(0, 1, 0.7)
    min_examples_per_type: int = _ranged(0, 20, 3)
    min_confidence_to_store: float = _ranged(0, 1, 0.6)


@dataclass
class QueryLimits:
    max_depth: int = _ranged(1, 10, 3)
    default_limit: int = _ranged(1, 1000, 50)
    max_limit: int = _ranged(1, 10000, 200)
    mermaid_max_nodes: int = _ranged(1, 500, 30)
    query_timeout_ms: int = _ranged(100, 60000, 5000)


@dataclass
class Config:
    graph_name: str = "memory"
    preset: str = "dev-team"
    store: str = ""
    guardrails: Guardrails = field(default_factory=Guardrails)
    query_limits: QueryLimits = field(default_factory=QueryLimits)
    jdbc: dict = field(default_factory=dict)


#: Environment variables and the settings they override.
ENVIRONMENT = {
    "FACTLOOM_GRAPH": "graph_name", "FACTLOOM_PRESET": "preset", "FACTLOOM_STORE": "store",
    **{f"FACTLOOM_{f.name.upper()}": f"{part}.{f.name}" for part, kind in (("guardrails", Guardrails), ("query_limits", QueryLimits)) for f in fields(kind)},
    **{f"FACTLOOM_JDBC_{k.upper()}": f"jdbc.{k}" for k in ("host", "port", "database", "user", "password", "sslmode")},
}


def _number(value, kind, name: str):
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise GraphError(f'{name} must be a number, not "{value}"') from None
    if kind in (int, "int"):
        if number != int(number):
            raise GraphError(f"{name} must be a whole number")
        return int(number)
    return number


def load_config(base: dict | None = None, environ: dict | None = None) -> Config:
    """Defaults, overridden by `base`, overridden by the environment. Raises for values out of range."""
    settings = copy.deepcopy(base or {})
    for variable, place in ENVIRONMENT.items():
        value = (os.environ if environ is None else environ).get(variable)
        if value not in (None, ""):
            *parents, last = place.split(".")
            node = settings
            for p in parents:
                node = node.setdefault(p, {})
            node[last] = value
    parts = {}
    for part, kind in (("guardrails", Guardrails), ("query_limits", QueryLimits)):
        given = settings.pop(part, {})
        values = {}
        for f in fields(kind):
            value = _number(given.get(f.name, f.default), f.type, f.name)
            low, high = f.metadata["range"]
            if not low <= value <= high:
                raise GraphError(f"{f.name} must be between {low} and {high}")
            values[f.name] = value
        parts[part] = kind(**values)
    config = Config(**{k: v for k, v in settings.items() if k in {f.name for f in fields(Config)}}, **parts)
    check_identifier(config.graph_name, "graph name")
    return config


def jdbc_url(jdbc: dict) -> str:
    """A PostgreSQL JDBC URL with encoded credentials."""
    user = f"?user={quote(str(jdbc['user']), safe='')}" if jdbc.get("user") else "?"
    password = f"&password={quote(str(jdbc['password']), safe='')}" if jdbc.get("password") else ""
    ssl = f"&sslmode={quote(str(jdbc['sslmode']), safe='')}" if jdbc.get("sslmode") else ""
    return f"jdbc:postgresql://{jdbc.get('host', 'localhost')}:{jdbc.get('port', 5432)}/{quote(str(jdbc.get('database', 'postgres')), safe='')}{user}{password}{ssl}".rstrip("?")
