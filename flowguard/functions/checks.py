"""Packet checks as boolean columns: true lets the packet pass.

Each builder takes a ``RuleBook`` (see ``operators.rules``). Cheap set probes
come before regular expressions, and a NULL field never blocks a packet.
``level`` selects rules scoped to one level: a number, or a column of numbers.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PROFILE_BY_VERBOSITY

_PROFILES: dict[str, Callable[..., Column]] = {}


def _is(proto: str) -> Column:
    return F.col("proto").eqNullSafe(proto)


def port_ok(book, direction: str, level=None) -> Column:
    return ~book.hit("port", direction, level)


def ip_ok(book, direction: str, level=None) -> Column:
    return ~book.hit("ip", direction, level)


def flags_ok(book, level=None) -> Column:
    """Blocks TCP packets whose whole flag vector equals a listed one."""
    return ~(_is("TCP") & book.hit("flags", None, level))


def payload_ok(book, mode: str = "full", level=None) -> Column:
    """Blocks payloads that match a signature as a whole, or (``find``) anywhere."""
    return ~book.payload_hit(mode, level)


def register_profile(name: str, build: Callable[..., Column]) -> None:
    """Add a named profile; ``build(book, level)`` returns a boolean column."""
    _PROFILES[name] = build


def profile_names() -> list[str]:
    return sorted(_PROFILES)


def profile_ok(name: str | int, book, level=None) -> Column:
    """The profile of that name, or of that verbosity number (0 to 3)."""
    name = PROFILE_BY_VERBOSITY.get(name, name)
    if name not in _PROFILES:
        raise KeyError(f"unknown profile {name!r}; known: {', '.join(profile_names())}")
    return _PROFILES[name](book, level)


def _basic(book, level=None) -> Column:
    has_ports = _is("TCP") | _is("UDP")
    known = has_ports | _is("IP")
    ports = port_ok(book, "src", level) & port_ok(book, "dst", level)
    addresses = ip_ok(book, "src", level) & ip_ok(book, "dst", level)
    return (~has_ports | ports) & (~known | addresses) & flags_ok(book, level)


def _dpi(book, level=None) -> Column:
    return ~(_is("TCP") | _is("UDP")) | payload_ok(book, "full", level)


def _full(book, level=None) -> Column:
    known = _is("TCP") | _is("UDP") | _is("IP")
    return known & _basic(book, level) & _dpi(book, level)


register_profile("empty", lambda book, level=None: F.lit(True))
register_profile("basic", _basic)
register_profile("dpi", _dpi)
register_profile("full", _full)
