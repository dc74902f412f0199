"""Column functions on single packets."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PACKET_TYPES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def packet_type(proto="proto") -> Column:
    """1 for IP, 2 for TCP, 3 for UDP, NULL for any other protocol."""
    proto = _col(proto)
    out = None
    for name, code in PACKET_TYPES.items():
        out = F.when(proto == name, code) if out is None else out.when(proto == name, code)
    return out.cast("int")


def ipv4_long(address) -> Column:
    """Dotted IPv4 text as its 32-bit number; NULL for anything else."""
    address = _col(address)
    octets = F.split(address, "\\.")
    parts = [F.get(octets, F.lit(i)).try_cast("bigint") for i in range(4)]
    in_range = (F.size(octets) == 4)
    for p in parts:
        in_range = in_range & p.between(0, 255)
    number = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
    return F.when(in_range, number)


# Address forms as SQL text, so that a literal set of addresses can be compared
# with one in a single parsed expression.

def _ipv4_text(a: str) -> str:
    """IPv4 text without leading zeros in its parts."""
    return (f"CASE WHEN startswith({a}, '0') OR contains({a}, '.0') "
            f"THEN regexp_replace({a}, r'(\\A|\\.)0+(?=[0-9])', '$1') ELSE {a} END")


# The first 96 bits of an IPv4-mapped IPv6 address in any spelling: five groups of zeros, some of which may be
# left out, and ffff.
_MAPPED = r"(?i)\A(?:(?:0{1,4}:){5}|(?:(?:0{1,4}:){1,4}|:):(?:0{1,4}:){0,4})ffff:"
_DOTTED = r"([0-9]{1,3}(?:[.][0-9]{1,3}){3})\z"
_TWO_GROUPS = r"([0-9a-f]{0,4}):([0-9a-f]{1,4}|:|)\z"


def _mapped_ipv4(a: str) -> str:
    """The IPv4 address in an IPv4-mapped IPv6 address, whose end may be dotted or two groups; else NULL."""
    dotted = f"nullif(regexp_extract({a}, r'{_MAPPED}{_DOTTED}', 1), '')"
    # An empty group is one that '::' leaves out.
    high, low = (f"coalesce(conv(regexp_extract({a}, r'{_MAPPED}{_TWO_GROUPS}', {i}), 16, 10), '0')" for i in (1, 2))
    parts = [f"CAST({g} AS INT) div 256, CAST({g} AS INT) % 256" for g in (high, low)]
    return (rf"coalesce(regexp_replace({dotted}, r'(\A|\.)0+(?=[0-9])', '$1'), "
            f"CASE WHEN {a} RLIKE r'{_MAPPED}{_TWO_GROUPS}' THEN concat_ws('.', {', '.join(parts)}) END)")


def _hex_tail(a: str) -> str:
    """IPv6 text with a dotted end written as two groups."""
    octet = [rf"try_cast(regexp_extract({a}, r'([0-9]{{1,3}})[.]([0-9]{{1,3}})[.]([0-9]{{1,3}})[.]([0-9]{{1,3}})\z', {i}) AS INT)"
             for i in range(1, 5)]
    byte = [f"CASE WHEN {o} < 256 THEN lpad(hex({o}), 2, '0') END" for o in octet]
    return (rf"CASE WHEN contains({a}, '.') THEN concat(regexp_extract({a}, r'\A(.*:)[0-9.]+\z', 1), "
            f"{byte[0]}, {byte[1]}, ':', {byte[2]}, {byte[3]}) ELSE {a} END")


def _ipv6_hex(a: str) -> str:
    """IPv6 text (any zero compression or case, dotted end or not) as 32 hex digits, else NULL."""
    def digits(b):
        closed = (f"concat(CASE WHEN startswith({b}, '::') THEN '0' ELSE '' END, lower({b}), "
                  f"CASE WHEN endswith({b}, '::') THEN '0' ELSE '' END)")
        zeros = f"concat(':', repeat('0:', 8 - (length({closed}) - length(translate({closed}, ':', '')))))"
        groups = f"transform(split(replace({closed}, '::', {zeros}), ':'), g -> lpad(g, 4, '0'))"
        return rf"nullif(regexp_extract(array_join({groups}, ''), r'\A[0-9a-f]{{32}}\z', 0), '')"
    return f"element_at(transform(array({_hex_tail(a)}), b -> {digits('b')}), 1)"


def ip_key_sql(column: str, v6: bool = True) -> str:
    long_form = _mapped_ipv4(column)
    if v6:
        long_form = f"coalesce({long_form}, {_ipv6_hex(column)}, lower({column}))"
    return f"CASE WHEN contains({column}, ':') THEN {long_form} ELSE {_ipv4_text(column)} END"


def ip_key(column: str, v6: bool = True) -> Column:
    """One text key per address, the same for every spelling of it.

    IPv4 (also when mapped into IPv6) becomes plain dotted text, IPv6 its 32
    hex digits; anything that is no address is compared as lower-case text.
    With ``v6=False`` an IPv6 address that maps no IPv4 one has no key.
    """
    return F.expr(ip_key_sql(column, v6))


def payload_text(payload) -> Column:
    """Payload bytes as UTF-8 text; malformed bytes become U+FFFD."""
    return F.make_valid_utf8(_col(payload).cast("string"))


def flag_is_set(flag: int, mask="flag_mask") -> Column:
    """True when bit ``flag`` of the mask is set; NULL masks have no bits."""
    return F.coalesce(_col(mask).bitwiseAND(F.lit(1 << flag)) != 0, F.lit(False))


def micros(ts="ts") -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def div(a: Column, b) -> Column:
    """Integer division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def slot_of(ts, seconds: float, t0_micros: int = 0) -> Column:
    """Number of the fixed-length slot (or round) a time falls into."""
    length = int(round(seconds * 1_000_000))
    at = micros(ts)
    if t0_micros:
        at = at - F.lit(t0_micros).cast("bigint")
    return div(at - F.pmod(at, F.lit(length).cast("bigint")), length)
