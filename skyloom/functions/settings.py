"""Settings with their checks: a value given by the caller or else configured, and what it must fulfil."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any


def at(config: Mapping[str, Any], path: str) -> Any:
    """The value at a dotted path; a missing one is an error that names the path."""
    node: Any = config
    for part in path.split("."):
        if not isinstance(node, Mapping) or part not in node:
            raise KeyError(f"the configuration has no {path}")
        node = node[part]
    return node


def setting(config: Mapping[str, Any], path: str, given: Any = None, kind: Callable[[Any], Any] | None = None, choices: Sequence[Any] | None = None, least: float | None = None, most: float | None = None, above: float | None = None, below: float | None = None) -> Any:
    """``given``, or what the configuration has at ``path``; refused if it is no choice or out of its range."""
    value = at(config, path) if given is None else given
    value = kind(value) if kind else value
    if choices is not None and value not in choices:
        raise ValueError(f"{path} is {value!r}; there are {', '.join(map(str, choices))}")
    for ok, rule in ((least is None or value >= least, f"at least {least}"), (most is None or value <= most, f"at most {most}"), (above is None or value > above, f"above {above}"), (below is None or value < below, f"below {below}")):
        if not ok:
            raise ValueError(f"{path} is {value!r} and must be {rule}")
    return value


def names(config: Mapping[str, Any], path: str, given: Sequence[str] | None = None, known: Sequence[str] | None = None, response: str | None = None) -> list[str]:
    """Names without repeats, in order; refused if there are none, if one is unknown, or if the response is among them."""
    out = list(dict.fromkeys(map(str, at(config, path) if given is None else given)))
    if not out:
        raise ValueError(f"{path} has no names")
    if known is not None and (odd := [n for n in out if n not in known]):
        raise ValueError(f"{path} has unknown names {odd}")
    if response in out:
        raise ValueError(f"the response {response!r} is among the predictors")
    return out


def increasing(values: Sequence[float], labels: Sequence[str] | None = None) -> list[float]:
    """Class breaks, if they rise and, with labels, if there is one label more."""
    out = [float(v) for v in values]
    if not out or any(b <= a for a, b in zip(out, out[1:], strict=False)):
        raise ValueError("class breaks rise strictly, and there is one at least")
    if labels is not None and len(labels) != len(out) + 1:
        raise ValueError(f"{len(out)} breaks need {len(out) + 1} labels")
    return out


def spans(config: Mapping[str, Any], path: str, given: Mapping[str, Sequence[int]] | None = None) -> list[tuple[str, int, int]]:
    """Labelled windows of years in order of their starts; refused if empty, inverted or not a pair."""
    out = []
    for label, ends in (at(config, path) if given is None else given).items():
        if len(ends) != 2 or ends[1] < ends[0]:
            raise ValueError(f"{path}.{label} is no window from one year to a later one")
        out.append((str(label), int(ends[0]), int(ends[1])))
    if not out:
        raise ValueError(f"{path} has no window")
    return sorted(out, key=lambda x: x[1:])


def split_method(config: Mapping[str, Any], path: str, given: str | None = None, allowed: Sequence[str] = ("spatial_block",)) -> str:
    """How held-out rows are chosen; rows at random would leak neighbours and are refused by name."""
    value = at(config, path) if given is None else given
    if value == "random":
        raise ValueError("a random split leaks neighbours into the test; compare both kinds of split to measure that")
    return setting({}, path, value, choices=allowed)


def overridden(config: Mapping[str, Any], path: str, **changes: Any) -> dict[str, Any]:
    """A block of settings with changes; unknown ones are refused."""
    block = dict(at(config, path))
    if odd := sorted(set(changes) - set(block)):
        raise ValueError(f"{path} has no {odd}")
    return block | changes


def criteria(entries: Sequence[Mapping[str, Any]], wanted: Sequence[str] | None = None) -> list[dict[str, Any]]:
    """Criteria by name, each once and with a direction; the wanted ones in the wanted order."""
    found = {}
    for e in entries:
        if e["name"] in found or e.get("direction") not in ("benefit", "cost"):
            raise ValueError(f"criterion {e['name']!r} comes twice or has no direction")
        found[e["name"]] = dict(e)
    if not found:
        raise ValueError("there are no criteria")
    if odd := [n for n in wanted or () if n not in found]:
        raise ValueError(f"no criteria {odd}")
    return [found[n] for n in (found if wanted is None else wanted)]
