"""DuckDB statements that say, in plain SQL, what the registered queries return."""

from .catalog import (BAD_IPS, DERIVED_LOG, DERIVED_RULES, ORDER_SIGNATURES, LEVEL_OF_NODE, REPORT_KEY, REPORT_TYPE,
                      RULE_VALUES, UNKNOWN_TYPE)

PACKETS = """
    SELECT packet_id, ts, CAST(CASE WHEN k % 16 < 8 THEN k % 8 ELSE 7 END AS INT) AS node_id,
      concat('02:00:00:00:01:', lpad(CAST(u % 100 AS VARCHAR(9)), 2, '0')) AS src_mac,
      concat('02:00:00:00:00:', lpad(CAST(k % 16 AS VARCHAR(9)), 2, '0')) AS dst_mac,
      concat('10.0.', CAST(CAST(floor(u / 256) AS INT) AS VARCHAR(9)), '.', CAST(u % 256 AS VARCHAR(9))) AS src_ip,
      concat('192.168.1.', CAST(k AS VARCHAR(9))) AS dst_ip,
      proto,
      CAST(CASE WHEN proto <> 'IP' THEN 1024 + (packet_id * 31) % 64512 END AS INT) AS src_port,
      CAST(CASE WHEN proto <> 'IP' THEN CASE k % 8 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 443
           WHEN 4 THEN 23 WHEN 5 THEN 8080 WHEN 6 THEN 3306 ELSE 1000 + k END END AS INT) AS dst_port,
      CAST(CASE WHEN proto = 'TCP' THEN packet_id % 256 END AS INT) AS flag_mask,
      CASE WHEN proto <> 'IP' THEN concat(event_type, ' ', props) END AS payload
    FROM (SELECT event_id AS packet_id, ts, user_id AS u, event_type, props,
            CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
            CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'TCP'
                 WHEN event_type = 'signup' THEN 'UDP' ELSE 'IP' END AS proto
          FROM events) e"""

DAY_SLOT = "(epoch_us(ts) // 86400000000)"
REPORT_ROUND = "(epoch_us(ts) // 21600000000)"

CTES = {
    "packets": ((), PACKETS),
    "mixed": (("packets",), f"SELECT * REPLACE ({UNKNOWN_TYPE} AS proto) FROM packets"),
    "small_rules": ((), f"SELECT * FROM (VALUES {RULE_VALUES}) t(scope, kind, direction, value)"),
    "derived_rules": ((), DERIVED_RULES),
    "both_rules": (("small_rules", "derived_rules"),
                   "SELECT * FROM small_rules UNION ALL SELECT * FROM derived_rules"),
    "bad": ((), f"SELECT * FROM (VALUES {BAD_IPS}) t(ip)"),
    "nodes": (("packets",), f"SELECT node_id, {LEVEL_OF_NODE} AS level FROM packets GROUP BY node_id"),
    "rule_log": ((), DERIVED_LOG),
    "reports": (("packets",), f"""SELECT * FROM (
        SELECT packet_id, ts, node_id, {REPORT_TYPE} AS report_type, {REPORT_KEY} AS key FROM packets) r
        WHERE report_type IS NOT NULL"""),
    "routed": (("reports",), """SELECT * FROM (
        SELECT *, CASE report_type WHEN 1 THEN 'port' WHEN 2 THEN 'unexpected_port' WHEN 3 THEN 'ip'
          WHEN 4 THEN 'ip' WHEN 6 THEN 'dropped' WHEN 7 THEN 'bad_flag' END AS kind FROM reports) r
        WHERE kind IS NOT NULL"""),
    "src_days": (("packets",), f"SELECT src_ip, {DAY_SLOT} AS slot, count(*) AS n FROM packets GROUP BY ALL"),
}


def hit(kind: str, direction: str | None, rules: str = "small_rules", level: str | None = None) -> str:
    """A condition: packet p is in a rule set that applies to it."""
    value = {("ip", "src"): "p.src_ip", ("ip", "dst"): "p.dst_ip", ("port", "src"): "CAST(p.src_port AS VARCHAR)",
             ("port", "dst"): "CAST(p.dst_port AS VARCHAR)", ("flags", None): "CAST(p.flag_mask AS VARCHAR)",
             ("monitored_ip", "src"): "p.src_ip"}[(kind, direction)]
    where = "" if direction is None else f" AND r.direction = '{direction}'"
    scope = "r.scope IN ('all', 'node:' || p.node_id" + (f", 'level:' || {level})" if level else ")")
    return (f"EXISTS (SELECT 1 FROM {rules} r WHERE r.kind = '{kind}'{where} AND r.value = {value} AND {scope})")


def payload_hit(level: str | None = None, rules: str = "small_rules", call: str = "regexp_full_match") -> str:
    scope = "r.scope IN ('all', 'node:' || p.node_id" + (f", 'level:' || {level})" if level else ")")
    return (f"EXISTS (SELECT 1 FROM {rules} r WHERE r.kind = 'pattern' AND {call}(p.payload, r.value) AND {scope})")


def basic(rules: str = "small_rules", level: str | None = None) -> str:
    """A condition: packet p passes the basic profile."""
    ports = f"NOT {hit('port', 'src', rules, level)} AND NOT {hit('port', 'dst', rules, level)}"
    ips = f"NOT {hit('ip', 'src', rules, level)} AND NOT {hit('ip', 'dst', rules, level)}"
    return f"""(CASE p.proto WHEN 'TCP' THEN {ports} AND {ips} AND NOT {hit('flags', None, rules, level)}
      WHEN 'UDP' THEN {ports} AND {ips} WHEN 'IP' THEN {ips} ELSE true END)"""


def dpi(rules: str = "small_rules", level: str | None = None) -> str:
    return f"(CASE WHEN p.proto IN ('TCP', 'UDP') THEN NOT {payload_hit(level, rules)} ELSE true END)"


def full(rules: str, level: str | None = None) -> str:
    return f"(p.proto IN ('TCP', 'UDP', 'IP') AND {basic(rules, level)} AND {dpi(rules, level)})"


CTES["cascaded"] = (("packets", "small_rules"), f"""SELECT *, CAST(CASE WHEN NOT {basic(level='0')} THEN 0
    WHEN NOT {dpi(level='1')} THEN 1 END AS INT) AS dropped_at FROM packets p""")


def sql(select: str, *names: str, more: str = "") -> str:
    """The statement with the table expressions it needs, in order."""
    order: list[str] = []

    def add(name):
        for needed in CTES[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({CTES[name][1]})" for name in order] + ([more] if more else [])
    return f"WITH RECURSIVE {', '.join(parts)}\n{select}"


def cma(counts: str, key: str, order: str, ratio: float, floor: int, keep: str = "") -> str:
    """Table expressions ending in ``avg``: the integer moving average per key."""
    keys = key.split(", ")
    same = " AND ".join(f"q.{k} = f.{k}" for k in keys)
    picked = ", ".join(f"q.{k}" for k in keys)
    return f"""counted AS ({counts}),
    q AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i FROM counted),
    f AS (SELECT {key}, {order}{keep}, n, i, CAST(NULL AS BIGINT) AS prior, n AS cma FROM q WHERE i = 1
      UNION ALL
      SELECT {picked}, q.{order}{keep.replace(', ', ', q.')}, q.n, q.i, f.cma, (q.n + (q.i - 1) * f.cma) // q.i
      FROM f JOIN q ON {same} AND q.i = f.i + 1),
    avg AS (SELECT * EXCLUDE (i),
      coalesce(i > 1 AND n > prior * CAST({ratio} AS DOUBLE) AND n > {floor}, false) AS alert FROM f)"""


PACKET_COLUMNS = ("packet_id, ts, node_id, src_mac, dst_mac, src_ip, dst_ip, proto, src_port, dst_port, "
                  "flag_mask, payload")

DIMENSION_ROWS = """dimension_rows AS (
    SELECT packet_id, ts, node_id, 'src_ip' AS dimension, src_ip AS key FROM {t}
    UNION ALL SELECT packet_id, ts, node_id, 'dst_ip', dst_ip FROM {t}
    UNION ALL SELECT packet_id, ts, node_id, 'src_port', CAST(src_port AS VARCHAR) FROM {t} WHERE proto IN ('TCP', 'UDP')
    UNION ALL SELECT packet_id, ts, node_id, 'dst_port', CAST(dst_port AS VARCHAR) FROM {t} WHERE proto IN ('TCP', 'UDP')
    UNION ALL SELECT packet_id, ts, node_id, 'flag', CAST(i AS VARCHAR) FROM {t}, range(9) s(i)
      WHERE proto = 'TCP' AND (flag_mask >> CAST(i AS INT)) & 1 = 1)"""

COUNT_WINDOWS = """numbered AS (
    SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts, packet_id) - 1 AS idx,
      count(*) OVER (PARTITION BY node_id) AS total FROM packets),
  windows AS (SELECT *, idx // 100 AS win FROM numbered WHERE idx < (total // 100) * 100)"""


def zero_tail(key: str, table: str, slots: int, running: bool = False) -> str:
    """Counts per window as a running counter would report them, to the last slot of the data or beyond it."""
    picked = ", ".join(f"s.{k}" for k in key.split(", "))
    return f"""per_slot AS (SELECT {key}, {DAY_SLOT} AS slot, count(*) AS n FROM {table} GROUP BY ALL),
    sliding AS (SELECT {picked}, slot + o AS end_slot,
        CAST(sum(CASE WHEN o < {slots} THEN n ELSE 0 END) AS BIGINT) AS n
      FROM per_slot s, range({slots + 1}) r(o)
      WHERE {running} OR slot + o <= (SELECT max(slot) FROM per_slot) GROUP BY ALL)"""


def sliding_alerts(dimensions: str, ratio: float | str, floor: int, source: str = "packets",
                   names: tuple = ("packets",), running: bool = False) -> str:
    more = DIMENSION_ROWS.format(t=source) + f""",
      tested AS (SELECT * FROM dimension_rows WHERE dimension IN ({dimensions})),
      """ + zero_tail("node_id, dimension, key", "tested", 2, running) + ", " + \
        cma("SELECT * FROM sliding", "node_id, dimension, key", "end_slot", ratio, floor)
    return sql("""SELECT node_id, make_timestamp((end_slot + 1) * 86400000000) AS ts, end_slot AS win,
        CAST(CASE dimension WHEN 'src_ip' THEN 3 WHEN 'dst_ip' THEN 4 ELSE 1 END AS INT) AS report_type, key, n, prior
      FROM avg WHERE alert""", *names, more=more)


CLASSIC = sql(
    """SELECT node_id, closed AS ts, win, CAST(CASE dimension WHEN 'src_ip' THEN 3 ELSE 4 END AS INT) AS report_type,
         key, n, prior FROM avg WHERE alert""", "packets",
    more=COUNT_WINDOWS + ", " + DIMENSION_ROWS.format(t="windows").replace("packet_id, ts,", "win, packet_id, ts,")
    + ", closings AS (SELECT node_id, win, max(ts) AS closed FROM windows GROUP BY ALL), "
    + cma("""SELECT d.node_id, d.dimension, d.key, d.win, any_value(c.closed) AS closed, count(*) AS n
             FROM dimension_rows d JOIN closings c ON c.node_id = d.node_id AND c.win = d.win
             WHERE d.dimension IN ('src_ip', 'dst_ip') GROUP BY d.node_id, d.dimension, d.key, d.win""",
          "node_id, dimension, key", "win", 1.5, 3, keep=", closed"))

# A change or reset reaches the nodes of its scope.
NODE_LOG = """node_log AS (
    SELECT n.node_id, l.* EXCLUDE (scope) FROM rule_log l JOIN nodes n
      ON l.scope IN ('all', 'level:' || n.level, 'node:' || n.node_id))"""


def rules_as_of(profile: str, table: str = "mixed") -> str:
    """The state of a rule at a packet's time is the last change of that rule, or reset, that reached the packet's
    node no later than the packet. A profile asks for some kinds of rules only."""
    kinds = "'ip', 'port', 'flags'" + (", 'pattern'" if profile == "full" else "")
    unknown = "false" if profile == "full" else "true"
    return sql(
        f"""SELECT packet_id, node_id, CASE WHEN proto IN ('IP', 'TCP', 'UDP') THEN packet_id NOT IN (
             SELECT packet_id FROM states WHERE kind IN ({kinds}) GROUP BY packet_id, kind, direction, value
             HAVING arg_max(op, seq) = 'add') ELSE {unknown} END AS verdict FROM {table}""",
        table, "nodes", "rule_log",
        more=NODE_LOG + f""",
          signatures AS (SELECT DISTINCT value FROM node_log WHERE kind = 'pattern'),
          probes AS (
            SELECT packet_id, node_id, ts, 'ip' AS kind, 'src' AS direction, src_ip AS value FROM {table}
            UNION ALL SELECT packet_id, node_id, ts, 'port', 'dst', CAST(dst_port AS VARCHAR) FROM {table}
              WHERE proto IN ('TCP', 'UDP')
            UNION ALL SELECT packet_id, node_id, ts, 'flags', NULL, CAST(flag_mask AS VARCHAR) FROM {table}
              WHERE proto = 'TCP'
            UNION ALL SELECT packet_id, node_id, ts, 'pattern', NULL, s.value FROM {table}, signatures s
              WHERE proto IN ('TCP', 'UDP') AND regexp_full_match(payload, s.value)),
          states AS (
            SELECT p.packet_id, p.kind, p.direction, p.value, l.seq, l.op FROM probes p JOIN node_log l
              ON l.node_id = p.node_id AND l.kind = p.kind AND l.value = p.value
              AND l.direction IS NOT DISTINCT FROM p.direction AND l.ts <= p.ts
            UNION ALL SELECT p.packet_id, p.kind, p.direction, p.value, l.seq, l.op FROM probes p JOIN node_log l
              ON l.node_id = p.node_id AND l.op = 'reset' AND l.ts <= p.ts)""")


# The log of rules and profiles at every level of every node. Within a level the last profile no later than the packet
# says which kinds of rules count; the profiles of the levels stand at the beginning.
PROFILE_LOG = """profile_log AS (
    SELECT * REPLACE (CASE WHEN op = 'reset' AND seq % 2 = 0 THEN 'profile' ELSE op END AS op,
      CASE WHEN op = 'reset' AND seq % 2 = 0 THEN CAST(seq % 4 AS VARCHAR) ELSE value END AS value) FROM rule_log)"""


def cascade_as_of(table: str) -> str:
    kinds = {"src": "p.src_ip", "dst": "CAST(p.dst_port AS VARCHAR)", None: "CAST(p.flag_mask AS VARCHAR)"}
    return PROFILE_LOG + f""",
      places AS (SELECT node_id, unnest([0, 1, 2]) AS level FROM nodes),
      place_log AS (SELECT n.node_id, n.level, l.* EXCLUDE (scope) FROM profile_log l JOIN places n
        ON l.scope IN ('all', 'level:' || n.level, 'node:' || n.node_id)),
      signatures AS (SELECT DISTINCT value FROM place_log WHERE kind = 'pattern'),
      probes AS (
        SELECT packet_id, node_id, ts, proto, 'ip' AS kind, 'src' AS direction, {kinds['src']} AS value FROM {table} p
        UNION ALL SELECT packet_id, node_id, ts, proto, 'port', 'dst', {kinds['dst']} FROM {table} p WHERE proto IN ('TCP', 'UDP')
        UNION ALL SELECT packet_id, node_id, ts, proto, 'flags', NULL, {kinds[None]} FROM {table} p WHERE proto = 'TCP'
        UNION ALL SELECT packet_id, node_id, ts, proto, 'pattern', NULL, s.value FROM {table} p, signatures s
          WHERE proto IN ('TCP', 'UDP') AND regexp_full_match(payload, s.value)),
      states AS (
        SELECT p.packet_id, l.level, p.kind, p.direction, p.value, l.seq, l.op FROM probes p JOIN place_log l
          ON l.node_id = p.node_id AND l.kind = p.kind AND l.value = p.value
          AND l.direction IS NOT DISTINCT FROM p.direction AND l.ts <= p.ts
        UNION ALL SELECT p.packet_id, l.level, p.kind, p.direction, p.value, l.seq, l.op FROM probes p JOIN place_log l
          ON l.node_id = p.node_id AND l.op IN ('reset', 'profile') AND l.ts <= p.ts),
      hits AS (SELECT DISTINCT packet_id, level, kind FROM (
        SELECT packet_id, level, kind, direction, value FROM states GROUP BY ALL HAVING arg_max(op, seq) = 'add') h),
      profiles AS (
        SELECT p.packet_id, p.proto, n.level, coalesce(
            (SELECT arg_max(l.value, l.seq) FROM place_log l WHERE l.op = 'profile' AND l.node_id = p.node_id
              AND l.level = n.level AND l.ts <= p.ts), CASE n.level WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '0' END) AS profile
        FROM {table} p JOIN places n ON n.node_id = p.node_id),
      failed AS (
        SELECT packet_id, level FROM profiles r WHERE
          (profile = '3' AND proto NOT IN ('IP', 'TCP', 'UDP'))
          OR (proto IN ('IP', 'TCP', 'UDP') AND EXISTS (SELECT 1 FROM hits h WHERE h.packet_id = r.packet_id AND h.level = r.level
            AND (profile IN ('1', '3') AND h.kind <> 'pattern' OR profile IN ('2', '3') AND h.kind = 'pattern')))),
      screened AS (SELECT p.packet_id, p.node_id, p.src_ip, CAST((SELECT min(level) FROM failed f WHERE f.packet_id = p.packet_id) AS INT)
        AS dropped_at FROM {table} p)"""


# What packets would meet after the whole log: of all that reached a node, no reset and no removal came after an add.
CURRENT_RULES = sql(
    """SELECT DISTINCT node_id, kind, direction, value FROM node_log a WHERE op = 'add' AND NOT EXISTS (
         SELECT 1 FROM node_log b WHERE b.node_id = a.node_id AND b.seq > a.seq AND (b.op = 'reset' OR (
           b.op = 'remove' AND b.kind = a.kind AND b.direction IS NOT DISTINCT FROM a.direction AND b.value = a.value)))""",
    "nodes", "rule_log", more=NODE_LOG)


def evaluation(run: str) -> str:
    rows = [("Emitter", "src_ip IN (SELECT ip FROM bad)", "EMITTED"),
            ("LVL0", "true", "PROCESSED"),
            ("LVL1", "dropped_at IS NULL OR dropped_at >= 1", "PROCESSED"),
            ("LVL2", "dropped_at IS NULL OR dropped_at >= 2", "PROCESSED"),
            ("OVERALL", "dropped_at IS NOT NULL", "DROPPED"),
            ("Aggregator", "dropped_at IS NULL AND src_ip IN (SELECT ip FROM bad)", "UNWANTED")]
    return " UNION ALL ".join(
        f"SELECT '{run}' AS run, '{part}' AS component, (SELECT count(*) FROM cascaded WHERE {cond}) AS number, "
        f"'{kind}' AS kind" for part, cond, kind in rows)


def hits(dimension: str) -> str:
    where = " WHERE proto IN ('TCP', 'UDP')" if dimension.endswith("port") else ""
    return sql(f"SELECT node_id, {dimension} AS key, count(*) AS n FROM packets{where} GROUP BY ALL", "packets")


ESCALATION = f"""rounds AS (
    SELECT kind, key, node_id, {REPORT_ROUND} AS round, count(*) AS hits, arg_min(packet_id, (ts, packet_id)) AS first_id
    FROM routed GROUP BY ALL),
  escalation AS (SELECT *, coalesce(lag(round) OVER (PARTITION BY kind, key, node_id ORDER BY round) = round - 1,
    false) AS escalated FROM rounds)"""



def oracle_sql() -> dict[str, str]:
    scan = sql(f"SELECT {PACKET_COLUMNS} FROM packets", "packets")
    first = sql("SELECT packet_id, ts, src_ip FROM packets ORDER BY ts, packet_id LIMIT 5000", "packets")
    as_of = rules_as_of("full")
    counts_of_windows = sql(
        "SELECT node_id, win, dimension, key, count(*) AS n FROM dimension_rows WHERE dimension <> 'flag' GROUP BY ALL",
        "packets", more=COUNT_WINDOWS + ", "
        + DIMENSION_ROWS.format(t="windows").replace("packet_id, ts,", "win, packet_id, ts,"))
    passing = lambda column, condition: sql(
        f"SELECT packet_id, {column} FROM packets p WHERE NOT {condition}", "packets", "derived_rules")
    verdict = lambda condition, *names: sql(
        f"SELECT packet_id, proto, {condition} AS verdict FROM mixed p", "mixed", *names)
    avg_src = lambda ratio, floor: cma("SELECT * FROM src_days", "src_ip", "slot", ratio, floor)
    return {
        "s01_packet_scan": scan,
        "s02_packet_stream": scan,
        "s03_take_packets": first,
        "s03_take_packets_numbered": first.replace("LIMIT 5000", "LIMIT 150000"),
        "s04_rule_log": sql("SELECT * FROM rule_log", "rule_log"),
        "s05_report_sink": sql(f"""SELECT packet_id, node_id, 6 AS report_type, src_ip AS key FROM packets p
            WHERE NOT {basic()} UNION ALL SELECT packet_id, node_id, report_type, key FROM reports""",
            "small_rules", "reports"),
        "s06_sink_by_proto": sql(f"""SELECT {PACKET_COLUMNS} FROM mixed p
            WHERE {basic()} AND proto IN ('IP', 'TCP', 'UDP')""", "mixed", "small_rules"),
        "s07_eval_sink": sql(f"{evaluation('first')} UNION ALL {evaluation('second')}", "cascaded", "bad"),
        "p01_packet_type": sql("""SELECT packet_id, proto, CAST(CASE proto WHEN 'IP' THEN 1 WHEN 'TCP' THEN 2
            WHEN 'UDP' THEN 3 END AS INT) AS type FROM mixed""", "mixed"),
        # The typed tables keep only the fields of their type.
        "p02_merge_typed": sql("""SELECT * REPLACE (CASE WHEN proto <> 'IP' THEN src_port END AS src_port,
            CASE WHEN proto <> 'IP' THEN dst_port END AS dst_port, CASE WHEN proto = 'TCP' THEN flag_mask END AS flag_mask,
            CASE WHEN proto <> 'IP' THEN payload END AS payload) FROM mixed WHERE proto IN ('IP', 'TCP', 'UDP')""", "mixed"),
        "p03_split_by_type": sql("""SELECT packet_id, CASE WHEN proto IN ('IP', 'TCP', 'UDP') THEN lower(proto)
            ELSE 'rejected' END AS route FROM mixed""", "mixed"),
        "p04_address_numbers": sql("""SELECT packet_id,
            list_reduce([CAST(x AS BIGINT) FOR x IN string_split(src_ip, '.')], lambda a, b: a * 256 + b) AS src_number,
            list_reduce([CAST(x AS BIGINT) FOR x IN string_split(dst_ip, '.')], lambda a, b: a * 256 + b) AS dst_number
            FROM packets""", "packets"),
        "p04_address_match": sql(f"SELECT packet_id, {basic('derived_rules')} AS verdict FROM packets p",
                                 "packets", "derived_rules"),
        "p06_flag_rows": sql("""SELECT packet_id, CAST(i AS INT) AS flag FROM packets, range(9) s(i)
            WHERE proto = 'TCP' AND (flag_mask >> CAST(i AS INT)) & 1 = 1""", "packets"),
        "f01_src_port": passing("src_port", hit("port", "src", "derived_rules")),
        "f02_dst_port": passing("dst_port", hit("port", "dst", "derived_rules")),
        "f03_src_ip": passing("src_ip", hit("ip", "src", "derived_rules")),
        "f04_dst_ip": passing("dst_ip", hit("ip", "dst", "derived_rules")),
        "f05_flags": passing("flag_mask", f"(p.proto = 'TCP' AND {hit('flags', None, 'derived_rules')})"),
        "f06_payload_full": sql("""SELECT packet_id, payload FROM packets
            WHERE NOT coalesce(regexp_full_match(payload, 'view .*'), false)""", "packets"),
        "f07_payload_find": sql("""SELECT packet_id, payload FROM packets
            WHERE NOT coalesce(regexp_matches(payload, '"k": 7[0-9]'), false)
              AND NOT coalesce(regexp_matches(payload, 'purchase .*5'), false)""", "packets"),
        "f06_signature_index": sql(f"""SELECT packet_id, payload FROM packets p WHERE NOT EXISTS (
            SELECT 1 FROM ({ORDER_SIGNATURES.replace("{orders}", "orders").replace("STRING", "VARCHAR")}) s
            WHERE (s.scope = 'all' OR s.scope = concat('node:', CAST(p.node_id AS VARCHAR)))
              AND regexp_extract(s.value, '[0-9]+') = regexp_extract(p.payload, '[0-9]+')
              AND regexp_full_match(p.payload, s.value))""", "packets"),
        "f08_basic_profile": verdict(basic("derived_rules"), "derived_rules"),
        "f09_dpi_profile": verdict(dpi(), "small_rules"),
        "f10_full_profile": verdict(full("both_rules"), "both_rules"),
        "f12_profile_by_level": sql(f"""SELECT packet_id, p.node_id, n.level,
            CASE n.level WHEN 1 THEN {full('small_rules', '1')} WHEN 2 THEN {basic('small_rules', '2')}
              ELSE true END AS verdict FROM packets p JOIN nodes n ON n.node_id = p.node_id""",
            "packets", "small_rules", "nodes"),
        "f13_split_verdict": sql(f"""SELECT packet_id, CASE WHEN {basic()} THEN 0 ELSE 6 END AS report_type,
            src_ip AS key FROM packets p""", "packets", "small_rules"),
        "f14_cascade": sql("SELECT packet_id, node_id, dropped_at FROM cascaded", "cascaded"),
        "f14_cascade_large_sets": sql(f"""SELECT packet_id, node_id, CAST(CASE WHEN NOT {basic('both_rules', '0')} THEN 0
            WHEN NOT {dpi('both_rules', '1')} THEN 1 END AS INT) AS dropped_at FROM packets p""", "packets", "both_rules"),
        "f15_monitored": sql(f"SELECT packet_id, src_ip, {hit('monitored_ip', 'src')} AS monitored FROM packets p",
                             "packets", "small_rules"),
        "j01_rules_as_of": as_of,
        "j01_rules_as_of_large_log": as_of,
        "j01_rules_as_of_basic": rules_as_of("basic"),
        "j01_cascade_as_of": sql("SELECT packet_id, node_id, dropped_at FROM screened", "mixed", "nodes", "rule_log",
                                 more=cascade_as_of("mixed")),
        "t07_stream_cascade_log": sql("""SELECT packet_id, CAST(dropped_at AS VARCHAR) AS result FROM screened
            UNION ALL SELECT packet_id, 'report ' || src_ip FROM screened WHERE dropped_at IS NOT NULL""",
            "packets", "nodes", "rule_log", more=cascade_as_of("packets")),
        "j02_current_rules": CURRENT_RULES,
        "j03_expand_scope": CURRENT_RULES,
        "j03_addressed_rules": sql("""SELECT n.node_id, kind,
            CASE WHEN kind IN ('ip', 'port', 'monitored_ip') THEN coalesce(direction, 'src') END AS direction, value
            FROM both_rules r JOIN nodes n ON r.scope IN ('all', 'level:' || n.level, 'node:' || n.node_id)""",
            "both_rules", "nodes"),
        "j04_leaked": sql("""SELECT packet_id, src_ip FROM cascaded
            WHERE dropped_at IS NULL AND src_ip IN (SELECT ip FROM bad)""", "cascaded", "bad"),
        "a01_src_ip_hits": hits("src_ip"),
        "a02_dst_ip_hits": hits("dst_ip"),
        "a03_src_port_hits": hits("src_port"),
        "a04_dst_port_hits": hits("dst_port"),
        "a05_flag_hits": sql("""SELECT node_id, CAST(i AS INT) AS flag,
            CAST(sum((flag_mask >> CAST(i AS INT)) & 1) AS BIGINT) AS n FROM packets, range(9) s(i)
            WHERE proto = 'TCP' GROUP BY ALL""", "packets"),
        "a06_port_hits": sql("""SELECT node_id, port, count(*) AS n FROM (
            SELECT node_id, src_port AS port FROM packets WHERE proto IN ('TCP', 'UDP')
            UNION ALL SELECT node_id, dst_port FROM packets WHERE proto IN ('TCP', 'UDP')) x GROUP BY ALL""", "packets"),
        "a07_all_hits": sql("SELECT node_id, dimension, key, count(*) AS n FROM dimension_rows GROUP BY ALL",
                            "packets", more=DIMENSION_ROWS.format(t="packets")),
        "a08_processed": sql("""SELECT node_id, CAST(l AS INT) AS level,
            CAST(sum(CASE WHEN dropped_at IS NULL OR dropped_at >= l THEN 1 ELSE 0 END) AS BIGINT) AS n
            FROM cascaded, range(3) s(l) GROUP BY ALL""", "cascaded"),
        "a09_dropped_total": sql("SELECT count(*) AS n FROM cascaded WHERE dropped_at IS NOT NULL", "cascaded"),
        "a09_dropped_by_source": sql("""SELECT src_ip, node_id, count(*) AS n FROM cascaded
            WHERE dropped_at IS NOT NULL GROUP BY ALL""", "cascaded"),
        "a10_unwanted": sql("""SELECT count(*) AS unwanted FROM cascaded
            WHERE dropped_at IS NULL AND src_ip IN (SELECT ip FROM bad)""", "cascaded", "bad"),
        "a11_report_hits": sql("SELECT kind, key, node_id, count(*) AS hits FROM routed GROUP BY ALL", "routed"),
        "a12_report_matrix": sql("SELECT kind, key, " + ", ".join(
            f"count(*) FILTER (node_id = {n}) AS node_{n}" for n in range(6))
            + ", count(*) FILTER (node_id IS NULL OR node_id NOT BETWEEN 0 AND 5) AS node_other FROM routed GROUP BY kind, key", "routed"),
        "a13_route_reports": sql("""SELECT r.packet_id, r.report_type, k.kind FROM reports r
            LEFT JOIN routed k ON k.packet_id = r.packet_id""", "routed"),
        "a14_evaluate": sql(evaluation("run-1"), "cascaded", "bad"),
        "a14_rates": sql("""SELECT 'run-1' AS run,
            count(*) FILTER (b AND dropped_at IS NOT NULL) / count(*) FILTER (b) AS detection_rate,
            count(*) FILTER (b AND dropped_at IS NULL) / count(*) FILTER (b) AS leak_rate,
            count(*) FILTER (NOT b AND dropped_at IS NOT NULL) / count(*) FILTER (NOT b) AS false_drop_rate
            FROM (SELECT *, src_ip IN (SELECT ip FROM bad) AS b FROM cascaded) x""", "cascaded", "bad"),
        "w01_count_windows": sql("SELECT packet_id, node_id, win FROM windows", "packets", more=COUNT_WINDOWS),
        "w02_slot_counts": sql(f"""SELECT node_id, src_ip, {DAY_SLOT} AS slot, count(*) AS n
            FROM packets GROUP BY ALL""", "packets"),
        "w03_sliding_counts": sql("""SELECT src_ip, epoch_us(ts) // 30000000 + o AS end_slot, count(*) AS n
            FROM packets, range(2) r(o) GROUP BY ALL""", "packets"),
        "w04_sliding_zero_tail": sql("SELECT node_id, src_ip, end_slot, n FROM sliding", "packets",
                                     more=zero_tail("node_id, src_ip", "packets", 3)),
        "w05_cma": sql("SELECT src_ip, slot, n, prior, cma, alert FROM avg", "src_days", more=avg_src(1.5, 3)),
        # The first value is not counted: the average starts at 0 with the second.
        "w06_cma_discard_first": sql("""SELECT dst_port, slot, n, prior, cma,
              coalesce(n > prior * CAST(1.5 AS DOUBLE) AND n > 3, false) AS alert FROM f""", "packets",
            more=f"""counted AS (SELECT dst_port, {DAY_SLOT} AS slot, count(*) AS n FROM packets
                WHERE dst_port IS NOT NULL GROUP BY ALL),
              q AS (SELECT *, row_number() OVER (PARTITION BY dst_port ORDER BY slot) AS i FROM counted),
              f AS (SELECT dst_port, slot, n, i, CAST(NULL AS BIGINT) AS prior, CAST(0 AS BIGINT) AS cma FROM q WHERE i = 1
                UNION ALL SELECT q.dst_port, q.slot, q.n, q.i, f.cma, (q.n + (q.i - 2) * f.cma) // (q.i - 1)
                FROM f JOIN q ON q.dst_port = f.dst_port AND q.i = f.i + 1)"""),
        "w07_last_10_average": sql("""SELECT src_ip, slot, n, CAST(sum(n) OVER (PARTITION BY src_ip ORDER BY slot
            ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) // 10 AS BIGINT) AS avg_last FROM src_days""", "src_days"),
        "w08_jumps": sql("SELECT src_ip, slot, n, prior FROM avg WHERE alert", "src_days", more=avg_src(1.5, 0)),
        "w09_jumps_above_floor": sql("SELECT dst_ip, slot, n, prior FROM avg WHERE alert", "packets",
            more=cma(f"SELECT dst_ip, {DAY_SLOT} AS slot, count(*) AS n FROM packets GROUP BY ALL",
                     "dst_ip", "slot", 1.2, 5)),
        "w10_classic_detector": CLASSIC,
        "w11_sliding_detector": sliding_alerts("'src_ip', 'dst_ip'", 1.5, 3),
        "w13_escalation": sql("SELECT kind, key, node_id, round, hits, escalated FROM escalation",
                              "routed", more=ESCALATION),
        "w13_escalated_reports": sql("""SELECT r.packet_id, r.kind, r.key, r.node_id,
            e.escalated AND e.first_id = r.packet_id AS escalated FROM routed r JOIN escalation e
            ON e.kind = r.kind AND e.key = r.key AND e.node_id = r.node_id
              AND e.round = epoch_us(r.ts) // 21600000000""", "routed", more=ESCALATION),
        "w14_window_length": sql("""SELECT node_id, slot,
            coalesce((slot - lag(slot, 2) OVER (PARTITION BY node_id ORDER BY slot)) * 3600 = 7200, false) AS ok
            FROM (SELECT DISTINCT node_id, epoch_us(ts) // 3600000000 AS slot FROM packets) x""", "packets"),
        "w15_detector_by_level": " UNION ALL ".join(
            f"SELECT *, CAST({level} AS INT) AS level FROM (" + sliding_alerts(
                "'src_ip', 'dst_ip'", 1.5, 3, f"(SELECT * FROM cascaded WHERE dropped_at IS NULL OR dropped_at >= {level})",
                ("cascaded",)) + ") x" for level in range(3)),
        "w16_ratio_per_node": sliding_alerts("'dst_port'", "CASE WHEN node_id < 4 THEN 1.5 ELSE 3.0 END", 3),
        "w16_ratio": sliding_alerts("'dst_port'", 2.5, 3),
        "t01_stream_cascade": sql("SELECT packet_id, node_id, dropped_at FROM cascaded", "cascaded"),
        "t02_stream_sliding_counts": sql("""SELECT src_ip, slot + o AS end_slot, CAST(sum(n) AS BIGINT) AS n
            FROM src_days, range(2) r(o) GROUP BY ALL""", "src_days"),
        "t03_stream_rounds": sql(f"""SELECT kind, key, node_id, {REPORT_ROUND} AS round, count(*) AS hits FROM routed
            GROUP BY ALL""", "routed"),
        "t04_stream_cma": sql("""SELECT src_ip, slot, n, prior, cma, alert FROM avg""", "src_days", more=avg_src(1.5, 3)),
        "t05_stream_count_windows": counts_of_windows,
        "t06_stream_escalation": sql("""SELECT kind, key, node_id, round, hits, escalated FROM escalation""",
                                     "routed", more=ESCALATION),
        "t07_stream_rule_log": rules_as_of("full", "packets"),
        "t08_stream_outputs": sql("""SELECT CASE WHEN dropped_at IS NULL THEN 'passed' ELSE 'reports' END AS output,
            packet_id FROM cascaded UNION ALL SELECT 'leaked', packet_id FROM cascaded
            WHERE dropped_at IS NULL AND src_ip IN (SELECT ip FROM bad)""", "cascaded", "bad"),
        "t09_running_counters": sql("""SELECT node_id, count(*) AS processed,
            count(*) FILTER (dropped_at IS NOT NULL) AS dropped,
            count(*) FILTER (dropped_at IS NULL AND src_ip IN (SELECT ip FROM bad)) AS leaked
            FROM cascaded GROUP BY node_id""", "cascaded", "bad"),
        "t09_query_totals": sql("""SELECT 'processed' AS metric, count(*) AS n FROM cascaded
            UNION ALL SELECT 'dropped', count(*) FROM cascaded WHERE dropped_at IS NOT NULL""", "cascaded"),
        "t10_stream_sliding_detector": sliding_alerts("'src_ip', 'dst_ip'", 1.5, 3, running=True),
        "t11_stream_classic_detector": CLASSIC,
        "t12_stream_detector_rounds": f"""SELECT *, coalesce(lag(round) OVER (PARTITION BY kind, key, node_id ORDER BY round)
              = round - 1, false) AS escalated
            FROM (SELECT 'ip' AS kind, key, node_id, epoch_us(ts) // 172800000000 AS round, count(*) AS hits
              FROM ({sliding_alerts("'src_ip', 'dst_ip'", 1.5, 3, running=True)}) a GROUP BY ALL) r""",
        "u01_custom_profile": sql(f"""SELECT packet_id, CAST(CASE WHEN {hit('ip', 'src', level='0')}
            OR {hit('port', 'src', level='0')} THEN 0 WHEN NOT {dpi(level='1')} THEN 1 END AS INT) AS dropped_at
            FROM packets p""", "packets", "small_rules"),
        "u02_custom_detector": sql(f"""SELECT node_id, {DAY_SLOT} AS slot, dst_ip AS key, count(*) AS n
            FROM packets GROUP BY ALL HAVING count(*) > 4""", "packets"),
    }
