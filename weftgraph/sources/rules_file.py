"""Rules files (TOML)."""

from __future__ import annotations

import tomllib

from weftgraph.operators.rules import Rule


class RulesError(Exception):
    """The file can't be read or doesn't hold rules."""


class RulesNotFound(RulesError):
    """There is no such file."""


def load_rules(path: str) -> list[Rule]:
    """Rules in the order of the file.

    A default severity other than ``error`` replaces every ``error``, also one that a rule names itself.
    """
    try:
        with open(path, "rb") as f:
            doc = tomllib.load(f)
    except FileNotFoundError as e:
        raise RulesNotFound(f"{path}: not found") from e
    except OSError as e:
        raise RulesError(f"{path}: {e}") from e
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise RulesError(f"{path}: {e}") from e
    default = doc.get("config", {}).get("default_severity", "error")
    out = []
    for r in doc.get("rules", []):
        try:
            severity = r.get("severity", "error")
            severity = default if severity == "error" and default != "error" else severity
            if r["type"] not in ("forbidden-dependency", "no-cycles", "layers") or severity not in ("error", "warn", "ignore"):
                raise RulesError(f"{path}: {r['type']}, {severity}")
            out.append(Rule(r["type"], r["name"], severity, r.get("from", ""), r.get("to", ""), r.get("scope", "**"), tuple(r.get("layers", ())), r.get("direction", "top-down")))
        except KeyError as e:
            raise RulesError(f"{path}: a rule lacks {e}") from e
    return out
