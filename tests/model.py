"""The flow rules, one packet at a time, for comparison with Spark."""


def fields(p):
    return dict(n=1, bytes=p["len"], first_seq=p["seq"], last_seq=p["seq"], first=p["us"], last=p["us"], last_len=p["len"])


def add(flow, p):
    flow["n"] += 1
    flow["bytes"] += p["len"]
    flow["last_seq"], flow["last"], flow["last_len"] = p["seq"], p["us"], p["len"]


def arrival(packets, idle, batches=None):
    """A flow table swept after every frame. Returns (closed, open)."""
    tables, clocks, closed = {}, {}, []
    for p in sorted(packets, key=lambda p: p["seq"]):
        capture = p["capture"]
        table = tables.setdefault(capture, {})
        clocks[capture] = max(clocks.get(capture, -(10**9)), p["us"] // 10**6)
        if p["key"] is not None:
            if p["key"] in table:
                add(table[p["key"]], p)
            else:
                table[p["key"]] = fields(p) | dict(capture=capture, key=p["key"])
        for key in [k for k, f in table.items() if clocks[capture] - f["last"] // 10**6 >= idle]:
            closed.append(table.pop(key))
    return closed, [f for t in tables.values() for f in t.values()]


def eager(packets, idle):
    """Runs of packets, ordered by time, with gaps below the idle time."""
    clocks, keys = {}, {}
    for p in packets:
        clocks[p["capture"]] = max(clocks.get(p["capture"], -(10**9)), p["us"] // 10**6)
        if p["key"] is not None:
            keys.setdefault((p["capture"], p["key"]), []).append(p)
    closed, still_open = [], []
    for (capture, key), members in keys.items():
        members.sort(key=lambda p: p["us"])
        runs = [[members[0]]]
        for a, b in zip(members, members[1:]):
            if b["us"] // 10**6 - a["us"] // 10**6 >= idle:
                runs.append([])
            runs[-1].append(b)
        for run in runs:
            end = max(p["us"] for p in run) // 10**6
            run.sort(key=lambda p: p["seq"])
            flow = fields(run[0]) | dict(capture=capture, key=key)
            for p in run[1:]:
                add(flow, p)
            (closed if clocks[capture] - end >= idle else still_open).append(flow)
    return closed, still_open


def rows(flows):
    names = ("capture", "key", "n", "bytes", "first_seq", "last_seq", "first", "last", "last_len")
    return sorted(tuple(f[n] for n in names) for f in flows)


def frame_rows(packets):
    """Model packets as rows of a decoded-packet DataFrame; see SCHEMA."""
    out = []
    for p in packets:
        flow = p["key"] is not None
        v6 = flow and p["key"] % 2 == 1
        out.append(
            (
                p["capture"], p["seq"], p["us"], p["len"], flow and not v6, v6, flow,
                p["key"] if flow and not v6 else None,
                bytearray(bytes(15) + bytes([p["key"] % 256])) if v6 else None,
                1000 + p["key"] if flow else None,
            )
        )
    return out


SCHEMA = "capture_id string, seq bigint, us bigint, len bigint, has_ipv4 boolean, has_ipv6 boolean, " \
    "has_transport boolean, src_ip bigint, src_ip6 binary, src_port int"


def packets_df(spark, packets):
    return spark.createDataFrame(frame_rows(packets), SCHEMA).selectExpr(
        "capture_id", "seq", "timestamp_micros(us) AS ts", "len", "has_ipv4", "has_ipv6", "has_transport",
        "src_ip", "IF(has_ipv4, 7L, NULL) AS dst_ip", "src_ip6", "src_ip6 AS dst_ip6", "src_port",
        "IF(has_transport, 443, NULL) AS dst_port", "IF(has_transport, 6, 0) AS protocol",
        "X'000000000001' AS src_mac", "X'000000000002' AS dst_mac", "2048 AS ether_type", "64 AS ttl",
        "false AS has_icmp", "false AS has_icmpv6", "CAST(NULL AS INT) AS icmp_type", "CAST(NULL AS INT) AS icmp_code",
    )


def flow_rows(df, *more):
    got = df.selectExpr(
        "capture_id", "src_port - 1000 AS key", "packets", "bytes", "first_seq", "last_seq",
        "unix_micros(first_seen)", "unix_micros(last_seen)", "last_len", *more,
    ).collect()
    return sorted(tuple(r) for r in got)


def packet(seq, seconds, key=1, capture="a", length=100):
    return dict(seq=seq, us=round(seconds * 10**6), key=key, capture=capture, len=length + seq % 7)
