"""Screening packets against rules: profiles, verdicts and level cascades."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import profile_ok
from ..functions.packet import ip_key
from ..schema import DEFAULT_LEVELS, DROP_REPORT, PACKET, PACKET_TYPES
from .lookup import BROADCAST_ROWS, Lookup, look_up
from .rules import RuleBook

IP_COLUMNS = ["packet_id", "ts", "node_id", "src_mac", "dst_mac", "src_ip", "dst_ip"]
UDP_COLUMNS = IP_COLUMNS + ["src_port", "dst_port", "payload"]
TCP_COLUMNS = UDP_COLUMNS + ["flag_mask"]


def as_book(rules) -> RuleBook:
    """A rule book as it is, or one loaded from a rule table; None has no rules."""
    if rules is None:
        return RuleBook({}, {}, {})
    return rules if isinstance(rules, RuleBook) else RuleBook.load(rules)


def merge_typed(ip: DataFrame, tcp: DataFrame, udp: DataFrame) -> DataFrame:
    """One packet table from the three typed ones; missing fields are NULL."""
    typed = [d.withColumn("proto", F.lit(p)) for d, p in ((ip, "IP"), (tcp, "TCP"), (udp, "UDP"))]
    merged = typed[1].unionByName(typed[2], allowMissingColumns=True) \
        .unionByName(typed[0], allowMissingColumns=True)
    return merged.select(*PACKET.fieldNames())


def split_by_type(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ip, tcp, udp, rejected); rejected holds packets of any other type."""
    proto = F.col("proto")
    return (df.filter(proto == "IP").select(*IP_COLUMNS),
            df.filter(proto == "TCP").select(*TCP_COLUMNS),
            df.filter(proto == "UDP").select(*UDP_COLUMNS),
            df.filter(~F.coalesce(proto.isin(*PACKET_TYPES), F.lit(False))))


def screen(df: DataFrame, profile: str, rules) -> DataFrame:
    """Add ``verdict``: whether the packet passes one profile."""
    return as_book(rules).add(df, verdict=lambda book: profile_ok(profile, book))


def profile_by_level(df: DataFrame, level_profiles: dict[int, str], rules,
                     nodes: DataFrame | None = None) -> DataFrame:
    """Add ``verdict`` under the profile that the packet's level runs.

    Levels come from a ``level`` column, or from ``nodes(node_id, level)``.
    Packets of a level without a profile pass.
    """
    book = as_book(rules)
    columns = df.columns
    if nodes is not None:
        df = look_up(df, [Lookup(F.col("node_id").cast("string"),
                                 nodes.select(F.col("node_id").cast("string").alias("key"), "level"))])


    def verdict(book):
        out = None
        for level, profile in sorted(level_profiles.items()):
            here, ok = F.col("level") == level, profile_ok(profile, book, level)
            out = F.when(here, ok) if out is None else out.when(here, ok)
        return F.lit(True) if out is None else out.otherwise(True)

    return book.add(df, verdict=verdict).select(*columns, *([] if nodes is None else ["level"]), "verdict")


def split_verdict(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed packets, one drop report per dropped packet)."""
    passed = df.filter("verdict").drop("verdict")
    return passed, drop_reports(df.filter(~F.col("verdict")))


def drop_reports(dropped: DataFrame) -> DataFrame:
    return dropped.select("packet_id", "ts", "node_id", F.lit(DROP_REPORT).alias("report_type"),
                          F.col("src_ip").alias("key"))


def cascade(df: DataFrame, levels: dict[int, str] = DEFAULT_LEVELS, rules=None) -> DataFrame:
    """Add ``dropped_at``: the first level whose profile stops the packet.

    NULL means that the packet passed all levels. All levels run in one narrow
    stage; a later level is not evaluated for a packet that is already dropped.
    """
    def dropped_at(book):
        out = None
        for level, profile in sorted(levels.items()):
            fails = ~profile_ok(profile, book, level)
            out = F.when(fails, level) if out is None else out.when(fails, level)
        return out.cast("int")

    return as_book(rules).add(df, dropped_at=dropped_at)


def mark_monitored(df: DataFrame, rules) -> DataFrame:
    """Add ``monitored``: the packet comes from or goes to a watched address."""
    return as_book(rules).add(
        df, monitored=lambda book: book.hit("monitored_ip", "src") | book.hit("monitored_ip", "dst"))


def mark_known_bad(df: DataFrame, bad_ips: DataFrame, out: str,
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add a boolean: the source address is in the given list (column ``ip``)."""
    known = bad_ips.select(ip_key("ip").alias("key")).distinct().withColumn(out, F.lit(True))
    marked = look_up(df, [Lookup(ip_key("src_ip"), known)], broadcast_rows)
    return marked.withColumn(out, F.coalesce(out, F.lit(False)))


def leaked(passed: DataFrame, bad_ips: DataFrame) -> DataFrame:
    """Packets that got through although their source is known to be bad."""
    return mark_known_bad(passed, bad_ips, "_bad").filter("_bad").drop("_bad")


def reached(level: int) -> Column:
    return F.col("dropped_at").isNull() | (F.col("dropped_at") >= level)


def processed(cascaded: DataFrame, levels: Iterable[int] = tuple(DEFAULT_LEVELS),
              by: Iterable[str] = ("node_id",)) -> DataFrame:
    """Packets that each level saw: rows (by, level, n) from one aggregate."""
    levels, by = sorted(levels), list(by)
    counts = cascaded.groupBy(*by).agg(
        *[F.sum(reached(n).cast("bigint")).alias(f"_level_{n}") for n in levels])
    pairs = ", ".join(f"{n}, _level_{n}" for n in levels)
    return counts.select(*by, F.expr(f"stack({len(levels)}, {pairs}) AS (level, n)"))


def dropped(cascaded: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Number of dropped packets, in total or per group."""
    return cascaded.filter(F.col("dropped_at").isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
