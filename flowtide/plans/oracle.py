"""The registered queries as SQL over the same tables (DuckDB dialect).

Nothing is decoded or streamed here: the expected result follows from
``events`` by arithmetic, and sessions by window functions.
"""

DAY = 86_400
HALF_HOUR = 1_800
AS_OF = "2024-01-15 12:00:00"
FAR = 4097 << 42
SIZES = """, min(len) AS len_min, max(len) AS len_max, sum(CAST(len AS HUGEINT) * len)::HUGEINT AS squares"""
DIRECTIONS = """, CAST(sum(CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS forward_packets,
        CAST(sum(CASE WHEN seq % 2 = 0 THEN len ELSE 0 END) AS BIGINT) AS forward_bytes"""
QUANTILES = ", " + ", ".join(f"quantile_disc(len, {q}) AS len_p{round(100 * q)}" for q in (0.5, 0.9, 0.99))
FLAGS = ", " + ", ".join(
    f"CAST(sum(CASE WHEN user_id % 2 = 0 AND (seq & {bit}) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS {flag}_packets"
    for flag, bit in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32))
)
SOME_NULL = "CASE WHEN user_id % 8 <> 3 THEN CAST(user_id % 8 AS VARCHAR) END"

KEY = "capture_id, ip_version, src_ip, dst_ip, src_ip6, dst_ip6, src_port, dst_port, protocol"


def packets(cut: str = "100000", capture: str = "CAST(user_id % 8 AS VARCHAR)", keep: str = "TRUE") -> str:
    """CTE ``packets``: one decoded frame per event, cut to ``cut`` bytes."""
    return f"""
    shapes AS (
      SELECT *, {capture} AS capture_id, event_id AS seq, epoch_us(ts) AS us,
        epoch_us(ts) // 1000000 AS sec, 74 + event_id % 1447 AS len,
        event_type = 'error' AS flowless, event_id % 4 AS variant, user_id % 3 = 0 AS v6,
        CASE WHEN user_id % 3 = 0 THEN 54 ELSE 34 + 4 * (event_id % 3) END AS l4
      FROM events WHERE {keep}),
    sizes AS (
      SELECT *, flowless AND variant IN (1, 2) AS is_foreign,
        LEAST({cut}, l4 + CASE WHEN flowless THEN 8 WHEN user_id % 2 = 0 THEN 20 ELSE 8 END) AS size
      FROM shapes),
    layers AS (
      SELECT *, NOT is_foreign AND NOT v6 AND size >= l4 AS has_ipv4,
        NOT is_foreign AND v6 AND size >= 54 AS has_ipv6,
        NOT flowless AND size >= l4 + CASE WHEN user_id % 2 = 0 THEN 20 ELSE 8 END AS has_transport,
        flowless AND variant = 0 AND size >= l4 + 8 AS has_message,
        CASE WHEN NOT flowless THEN CASE WHEN user_id % 2 = 0 THEN 6 ELSE 17 END
             WHEN variant = 0 THEN CASE WHEN v6 THEN 58 ELSE 1 END
             WHEN v6 THEN 0 ELSE 47 END AS number
      FROM sizes),
    packets AS (
      SELECT capture_id, seq, us, sec, len, CAST(size AS INTEGER) AS caplen,
        CASE WHEN size >= 14 THEN printf('0200%08X', user_id) END AS src_mac,
        CASE WHEN size >= 14 THEN printf('0201%08X', event_id) END AS dst_mac,
        CAST(CASE WHEN size < 14 THEN 0 WHEN flowless AND variant = 1 THEN 2054
             WHEN flowless AND variant = 2 THEN 33024 WHEN v6 THEN 34525 ELSE 2048 END AS INTEGER) AS ether_type,
        has_ipv4, has_ipv6, has_transport,
        has_message AND NOT v6 AS has_icmp, has_message AND v6 AS has_icmpv6,
        CAST(CASE WHEN has_ipv6 THEN 6 WHEN has_ipv4 THEN 4 END AS INTEGER) AS ip_version,
        CASE WHEN has_ipv4 THEN 167772160 + user_id END AS src_ip,
        CASE WHEN has_ipv4 THEN CAST(167837696 AS BIGINT) END AS dst_ip,
        CASE WHEN has_ipv6 THEN printf('20010DB80000000000000000%08X', user_id) END AS src_ip6,
        CASE WHEN has_ipv6 THEN printf('FE8000000000%04X000000000000%04X', 1 + user_id % 65535, user_id % 7) END AS dst_ip6,
        CAST(CASE WHEN has_ipv4 OR has_ipv6 THEN number ELSE 0 END AS INTEGER) AS protocol,
        CAST(CASE WHEN has_ipv4 OR has_ipv6 THEN 32 + event_id % 200 ELSE 0 END AS INTEGER) AS ttl,
        CAST(CASE WHEN has_transport THEN 1024 + user_id % 50000 END AS INTEGER) AS src_port,
        CAST(CASE WHEN has_transport THEN CASE WHEN user_id % 2 = 0 THEN 443 ELSE 53 END END AS INTEGER) AS dst_port,
        CAST(CASE WHEN has_message THEN event_id % 256 END AS INTEGER) AS icmp_type,
        CAST(CASE WHEN has_message THEN event_id % 16 END AS INTEGER) AS icmp_code,
        user_id, event_id
      FROM layers)"""


def flows(mode: str, idle: int, more: str = "", **shape: str) -> str:
    """CTE ``flows`` on top of ``packets``; ``more`` adds aggregates."""
    if mode == "eager":
        order, entered = "us, seq", "sec"
    else:
        order, entered = "seq", "clock"
    return f"""
    {packets(**shape)},
    clocked AS (
      SELECT *, max(sec) OVER (PARTITION BY capture_id ORDER BY seq
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock
      FROM packets),
    gaps AS (
      SELECT *, {entered} - lag(sec) OVER (PARTITION BY {KEY} ORDER BY {order}) AS idle
      FROM clocked WHERE (has_ipv4 OR has_ipv6) AND has_transport),
    numbered AS (
      SELECT *, sum(CASE WHEN idle < {idle} THEN 0 ELSE 1 END)
        OVER (PARTITION BY {KEY} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS flow_no
      FROM gaps),
    grouped AS (
      SELECT {KEY}, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes,
        arg_max(len, seq) AS last_len, min(seq) AS first_seq, max(seq) AS last_seq,
        arg_min(us, seq) AS first_seen, arg_max(us, seq) AS last_seen{more}
      FROM numbered GROUP BY {KEY}, flow_no),
    ends AS (SELECT capture_id AS ended, max(sec) AS final FROM packets GROUP BY capture_id),
    flows AS (
      SELECT grouped.*, (last_seen - first_seen) / CAST(1e6 AS DOUBLE) AS duration,
        final - last_seen // 1000000 >= {idle} AS is_closed
      FROM grouped JOIN ends ON grouped.capture_id IS NOT DISTINCT FROM ended)"""


def features(where: str) -> str:
    return f"""
    SELECT duration, packets, bytes,
      CASE WHEN duration > 0 THEN packets / duration ELSE 0 END AS "packetsPerSecond",
      CASE WHEN duration > 0 THEN bytes / duration ELSE 0 END AS "bytesPerSecond",
      CAST(bytes AS DOUBLE) / packets AS "averagePacketSize",
      src_port AS "srcPort", dst_port AS "dstPort", protocol
    FROM flows WHERE {where}"""


def dotted(ip: str) -> str:
    return (
        f"concat_ws('.', {ip} // 16777216, ({ip} // 65536) % 256, ({ip} // 256) % 256, {ip} % 256)"
    )


def groups_text(hex32: str) -> str:
    """``:a:b:...:h:`` text of an address given as 32 hex digits."""
    return "(':' || " + " || ".join(
        f"printf('%x:', CAST('0x' || substr({hex32}, {i * 4 + 1}, 4) AS INTEGER))" for i in range(8)
    ) + ")"


def address6(column: str) -> str:
    """Zero-run compression on ``:a:b:...:`` text; no dotted tails occur in
    the addresses it is used for unless stated by the caller."""
    text = groups_text(column)
    cases = []
    for n in range(8, 1, -1):
        run = ":0" * n + ":"
        found = f"instr({text}, '{run}')"
        cases.append(
            f"WHEN {found} > 0 THEN trim(substr({text}, 1, {found} - 1), ':') || '::' || "
            f"trim(substr({text}, {found} + {len(run)}), ':')"
        )
    return f"CASE WHEN {column} IS NULL THEN NULL {' '.join(cases)} ELSE trim({text}, ':') END"


PACKET_TEXT = f"""
    SELECT capture_id, seq, len,
      lower(regexp_replace(src_mac, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')) AS src_mac_text,
      lower(regexp_replace(dst_mac, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')) AS dst_mac_text,
      printf('0x%04x', ether_type) AS ether_type_text,
      CASE WHEN has_ipv6 THEN 'IPv6' WHEN has_ipv4 THEN 'IPv4' END AS family,
      CASE WHEN has_ipv6 THEN {address6('src_ip6')} WHEN has_ipv4 THEN {dotted('src_ip')} END AS src_addr,
      CASE WHEN has_ipv6 THEN {address6('dst_ip6')} WHEN has_ipv4 THEN {dotted('dst_ip')} END AS dst_addr,
      CASE WHEN has_ipv4 OR has_ipv6 THEN protocol END AS protocol,
      CASE WHEN has_ipv4 OR has_ipv6 THEN ttl END AS ttl,
      src_port, dst_port, icmp_type, icmp_code"""

ACTIVE = f"""
    SELECT capture_id, ip_version,
      CASE WHEN ip_version = 6 THEN {address6('src_ip6')} ELSE {dotted('src_ip')} END AS src_addr, src_port,
      CASE WHEN ip_version = 6 THEN {address6('dst_ip6')} ELSE {dotted('dst_ip')} END AS dst_addr, dst_port,
      protocol, packets, bytes,
      strftime(make_timestamp(first_seen), '%Y-%m-%d %H:%M:%S') AS first_seen_text,
      strftime(make_timestamp(last_seen), '%Y-%m-%d %H:%M:%S') AS last_seen_text,
      duration, CAST(bytes AS DOUBLE) / packets AS average_packet_size,
      CASE WHEN duration > 0 THEN bytes / duration END AS bps,
      CASE WHEN duration > 0 THEN packets / duration END AS pps,
      CASE WHEN NOT duration > 0 THEN bytes END AS burst_bytes
    FROM flows WHERE NOT is_closed"""

FLOW_COLUMNS = f"{KEY}, packets, bytes, last_len, first_seq, last_seq, first_seen, last_seen, duration, is_closed"

UNTIL = {"keep": f"ts <= TIMESTAMP '{AS_OF}'"}

# A frame as hex text, for the queries that digest whole frames.
FRAME_HEX = """
    printf('0201%08X', event_id) || printf('0200%08X', user_id) || printf('%04X', ether_type) ||
    CASE WHEN user_id % 3 = 0
      THEN '600000000000' || printf('%02X', number) || printf('%02X', 32 + event_id % 200)
        || printf('20010DB80000000000000000%08X', user_id)
        || printf('FE8000000000%04X000000000000%04X', 1 + user_id % 65535, user_id % 7)
      ELSE '4' || (5 + event_id % 3) || '00000000000000' || printf('%02X', 32 + event_id % 200)
        || printf('%02X', number) || '0000' || printf('%08X', 167772160 + user_id) || '0A010000'
        || repeat('01010101', event_id % 3) END ||
    CASE WHEN flowless THEN printf('%02X', event_id % 256) || printf('%02X', event_id % 16) || repeat('0', 12)
      ELSE printf('%04X', 1024 + user_id % 50000) ||
        CASE WHEN user_id % 2 = 0 THEN '01BB' || repeat('0', 16) || '50' || printf('%02X', event_id % 64) || repeat('0', 12) ELSE '0035' || repeat('0', 8) END END"""

SIX_DIGITS = {
    "rounded": "CAST(printf('%.5e', x) AS DOUBLE)",
    "text": "printf('%g', x)",
    "small_text": "printf('%g', x / CAST(1e9 AS DOUBLE))",
    "large_text": "printf('%g', x * CAST(1e4 AS DOUBLE))",
}

ORACLE: dict[str, str] = {
    "decode_ethernet": f"WITH {packets()} SELECT capture_id, seq, caplen, len, src_mac, dst_mac, ether_type FROM packets",
    "decode_ipv4": f"""WITH {packets()} SELECT seq, has_ipv4, src_ip, dst_ip,
        CASE WHEN has_ipv4 THEN protocol END AS protocol, CASE WHEN has_ipv4 THEN ttl END AS ttl FROM packets""",
    "decode_ipv6": f"""WITH {packets()} SELECT seq, has_ipv6, src_ip6, dst_ip6,
        CASE WHEN has_ipv6 THEN protocol END AS next_header, CASE WHEN has_ipv6 THEN ttl END AS hop_limit FROM packets""",
    "decode_transport": f"WITH {packets()} SELECT seq, protocol, has_transport, src_port, dst_port FROM packets",
    "decode_icmp": f"WITH {packets()} SELECT seq, has_icmp, has_icmpv6, icmp_type, icmp_code FROM packets",
    "truncated_frames": f"""WITH {packets(cut="event_id % 80")} SELECT seq, caplen, ether_type, has_ipv4, has_ipv6,
        protocol, ttl, has_transport, src_port, dst_port, has_icmp, has_icmpv6 FROM packets""",
    "snaplen": """SELECT doc_id AS seq, CAST(LEAST(2048, 14 + octet_length(encode(text))) AS INTEGER) AS caplen,
        CAST(14 + octet_length(encode(text)) AS BIGINT) AS len,
        md5(substr('02000000000102000000000288B5' || hex(encode(text)), 1, 4096)) AS digest FROM documents""",
    "capture_files": f"""WITH {packets()} SELECT p.capture_id AS capture, p.us, p.caplen, p.len,
        md5(d.digits) AS digest FROM packets p JOIN (
          SELECT event_id, {FRAME_HEX} AS digits FROM (SELECT *, CASE WHEN flowless AND variant = 1 THEN 2054
             WHEN flowless AND variant = 2 THEN 33024 WHEN v6 THEN 34525 ELSE 2048 END AS ether_type FROM layers)
        ) d USING (event_id)""",
    "packet_text": f"WITH {packets()} {PACKET_TEXT} FROM packets",
    "mac_ip_text": f"""WITH {packets()} SELECT seq,
        lower(regexp_replace(src_mac, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')) AS src_mac_text,
        printf('0x%04x', ether_type) AS ether_type_text,
        CASE WHEN src_ip IS NOT NULL THEN {dotted('src_ip')} END AS src_ip_text,
        {address6('src_ip6')} AS src_ip6_text FROM packets""",
    "ipv6_zero_runs": f"""WITH digits AS (SELECT event_id, CASE WHEN event_id % 97 = 0
          THEN '00000000000000000000FFFF' || printf('%08X', event_id * 7919) ELSE {" || ".join(
          f"CASE WHEN (event_id // {2 ** i}) % 2 = 1 THEN '0000' ELSE printf('%04X', 1 + (event_id * 31 + {i * 7}) % 65535) END"
          for i in range(8))} END AS h FROM events),
        quads AS (SELECT *, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS low FROM digits)
        SELECT event_id, CASE WHEN substr(h, 1, 24) = '00000000000000000000FFFF' THEN '::ffff:' || {dotted('low')}
            WHEN substr(h, 1, 24) = '000000000000000000000000' AND substr(h, 25, 4) <> '0000'
            THEN '::' || {dotted('low')} ELSE {address6('h')} END AS address_text FROM quads""",
    "time_of_day_text": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM events",
    "six_digit_format": f"""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE)
          / (CAST(l_quantity AS DOUBLE) + l_linenumber) AS x FROM lineitem)
        SELECT l_orderkey, l_linenumber, {", ".join(f"{e} AS {n}" for n, e in SIX_DIGITS.items())} FROM v""",
    "frames_per_capture": f"WITH {packets()} SELECT capture_id, count(*) AS frames FROM packets GROUP BY capture_id",
    "flow_eligibility": f"""WITH {packets()} SELECT capture_id, (has_ipv4 OR has_ipv6) AND has_transport AS eligible,
        protocol, count(*) AS frames FROM packets GROUP BY ALL""",
    "packet_flow_keys": f"WITH {packets()} SELECT seq, {KEY} FROM packets WHERE (has_ipv4 OR has_ipv6) AND has_transport",
    "flow_key_totals": f"""WITH {packets()} SELECT {KEY}, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes
        FROM packets WHERE (has_ipv4 OR has_ipv6) AND has_transport GROUP BY {KEY}""",
    "flows_eager": f"WITH {flows('eager', DAY)} SELECT {FLOW_COLUMNS} FROM flows",
    "flows_eager_half_hour": f"WITH {flows('eager', HALF_HOUR)} SELECT {FLOW_COLUMNS} FROM flows",
    "flows_arrival": f"WITH {flows('arrival', DAY)} SELECT {FLOW_COLUMNS} FROM flows",
    "flows_arrival_half_hour": f"WITH {flows('arrival', HALF_HOUR)} SELECT {FLOW_COLUMNS} FROM flows",
    "flows_one_capture": f"""WITH {flows('arrival', HALF_HOUR, capture="'all'")}
        SELECT {FLOW_COLUMNS} FROM flows""",
    "flows_far_positions": f"""WITH {flows('arrival', HALF_HOUR)}
        SELECT * REPLACE (first_seq + {FAR} AS first_seq, last_seq + {FAR} AS last_seq)
        FROM (SELECT {FLOW_COLUMNS} FROM flows)""",
    "flows_null_captures": f"WITH {flows('arrival', HALF_HOUR, capture=SOME_NULL)} SELECT {FLOW_COLUMNS} FROM flows",
    "flows_null_captures_eager": f"WITH {flows('eager', HALF_HOUR, capture=SOME_NULL)} SELECT {FLOW_COLUMNS} FROM flows",
    "flow_packet_sizes": f"""WITH {flows('arrival', HALF_HOUR, more=SIZES)} SELECT {FLOW_COLUMNS}, len_min, len_max,
        CAST(bytes AS DOUBLE) / packets AS len_mean,
        sqrt(CAST(packets * squares - CAST(bytes AS HUGEINT) * bytes AS DOUBLE)) / packets AS len_deviation FROM flows""",
    "flow_packet_gaps": f"""WITH {flows('arrival', DAY)},
        steps AS (SELECT *, us - lag(us) OVER (PARTITION BY {KEY}, flow_no ORDER BY seq) AS gap FROM numbered),
        gaps_of AS (SELECT {KEY}, min(seq) AS first_seq, min(gap) AS gap_min, max(gap) AS gap_max, count(gap) AS n,
          sum(gap)::HUGEINT AS total, sum(gap::HUGEINT * gap)::HUGEINT AS squares FROM steps GROUP BY {KEY}, flow_no)
        SELECT {', '.join('f.' + c for c in FLOW_COLUMNS.split(', '))}, gap_min, gap_max,
          CASE WHEN n > 0 THEN CAST(total AS DOUBLE) / n END AS gap_mean,
          CASE WHEN n > 0 THEN sqrt(CAST(n * squares - total * total AS DOUBLE)) / n END AS gap_deviation
        FROM flows f JOIN gaps_of g ON f.capture_id = g.capture_id AND f.first_seq = g.first_seq""",
    "flow_size_quantiles": f"""WITH {flows('arrival', DAY, more=QUANTILES)}
        SELECT {FLOW_COLUMNS}, len_p50, len_p90, len_p99 FROM flows""",
    "flow_tcp_flags": f"""WITH {flows('eager', DAY, more=FLAGS)} SELECT {FLOW_COLUMNS},
        fin_packets, syn_packets, rst_packets, psh_packets, ack_packets, urg_packets FROM flows""",
    # The clients' end is the lesser one over IPv4; over IPv6 it is too, and every second packet goes back.
    "two_way_flows": f"""WITH {flows('eager', HALF_HOUR, more=DIRECTIONS)}
        SELECT {FLOW_COLUMNS}, forward_packets, forward_bytes FROM flows""",
    "flow_features_closed": f"WITH {flows('eager', DAY)} {features('is_closed')}",
    "flow_features_all": f"WITH {flows('arrival', DAY)} {features('TRUE')}",
    "frames_to_features": f"WITH {flows('arrival', DAY)} {features('is_closed')}",
    "throughput_label": f"""WITH {flows('eager', DAY)} SELECT capture_id, first_seq, duration,
        CASE WHEN duration > 0 THEN bytes / duration END AS bps,
        CASE WHEN duration > 0 THEN packets / duration END AS pps,
        CASE WHEN NOT duration > 0 THEN bytes END AS burst_bytes FROM flows""",
    "active_flows_now": f"WITH {flows('arrival', DAY)} {ACTIVE}",
    "active_flows_as_of": f"WITH {flows('arrival', DAY, **UNTIL)} {ACTIVE}",
    "active_flows_as_of_eager": f"WITH {flows('eager', DAY, **UNTIL)} {ACTIVE}",
    "active_flow_counts": f"""WITH {flows('arrival', DAY, **UNTIL)} SELECT capture_id, count(*) AS active_flows
        FROM flows WHERE NOT is_closed GROUP BY capture_id""",
    "latest_packets": f"""WITH {packets()} {PACKET_TEXT} FROM packets
        WHERE (capture_id, seq) IN (SELECT (capture_id, max(seq)) FROM packets
          WHERE (has_ipv4 OR has_ipv6) AND has_transport GROUP BY capture_id)""",
    "csv_roundtrip": f"WITH {flows('eager', DAY)} {features('is_closed')}",
    "csv_compat_roundtrip": f"""WITH {flows('eager', DAY)}, f AS ({features('is_closed')})
        SELECT printf('%g', duration) AS duration, CAST(packets AS VARCHAR) AS packets,
          CAST(bytes AS VARCHAR) AS bytes, printf('%g', "packetsPerSecond") AS "packetsPerSecond",
          printf('%g', "bytesPerSecond") AS "bytesPerSecond",
          printf('%g', "averagePacketSize") AS "averagePacketSize", CAST("srcPort" AS VARCHAR) AS "srcPort",
          CAST("dstPort" AS VARCHAR) AS "dstPort", CAST(protocol AS VARCHAR) AS protocol FROM f""",
    "parquet_roundtrip": f"WITH {flows('eager', DAY)} {features('is_closed')}",
    "stream_features": f"""WITH {flows('eager', DAY, capture="'all'")} {features('is_closed')}""",
    "stream_csv_export": f"""WITH {flows('eager', DAY, capture="'all'")} {features('is_closed')}""",
    "stream_table_features": f"WITH {flows('eager', DAY)} {features('is_closed')}",
    "stream_arrival_features": f"WITH {flows('arrival', HALF_HOUR)} {features('is_closed')}",
    "stream_active_flows": f"WITH {flows('arrival', DAY)} {ACTIVE}",
}
ORACLE["stream_capture_files"] = ORACLE["capture_files"].replace(
    "md5(d.digits) AS digest", "md5(d.digits) AS digest, row_number() OVER (PARTITION BY p.capture_id ORDER BY p.seq) - 1 AS seq"
)
ORACLE["stream_latest_packets"] = ORACLE["latest_packets"]
