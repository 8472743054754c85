"""Argument forms: names and index pairs as text or lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import wraps

#: Arguments that steer a local machine or its screen; a plan has no use for them.
LOCAL = ("showPlot", "verbose", "numProcess", "backend")


def without_local(call: Callable) -> Callable:
    """``call``, which so takes the arguments of LOCAL too, without effect."""

    @wraps(call)
    def run(*args, **named):
        return call(*args, **{k: v for k, v in named.items() if k not in LOCAL})

    return run


def split_columns(x: str | Iterable[str] | None) -> list[str]:
    """One string is split at white space; a list is taken as it is, so that names may hold spaces."""
    if x is None:
        return []
    return x.split() if isinstance(x, str) else [str(c) for c in x]


def parse_pairs(x: str | Iterable[int], what: str = "pairs") -> list[tuple[int, int]]:
    """(start, end) pairs from "1 100 201 300", a flat list, or a list of pairs."""
    flat: list = x.split() if isinstance(x, str) else list(x)
    if flat and isinstance(flat[0], (list, tuple)):
        flat = [v for pair in flat for v in pair]
    try:
        numbers = [int(v) for v in flat]
        whole = all(float(v) == n for v, n in zip(flat, numbers, strict=True))
    except (TypeError, ValueError):
        whole = False
    if not whole:
        raise ValueError(f"{what}: integers are expected, not {x!r}")
    if not numbers or len(numbers) % 2:
        raise ValueError(f"{what}: an even number of integers is expected, not {len(numbers)}")
    return list(zip(numbers[::2], numbers[1::2], strict=True))


def expand_pairs(x: str | Iterable[int]) -> list[int]:
    """Every index of the pairs; starts are 1 or more, ends not below starts."""
    out: list[int] = []
    for a, b in parse_pairs(x):
        if a < 1 or b < a:
            raise ValueError(f"index pair {a} {b}: the start must be 1 or more, and the end not below it")
        out += range(a, b + 1)
    return out


def flatten_to_string(x, delimiter: str = " ") -> str:
    """Scalars and nested lists as one string."""
    if isinstance(x, str):
        return x
    if isinstance(x, dict):
        x = x.values()
    if isinstance(x, Iterable):
        return delimiter.join(flatten_to_string(v, delimiter) for v in x)
    return str(x)
