"""Ethernet, IPv4/IPv6, TCP/UDP and ICMP headers as columns.

One narrow projection per layer, no shuffle and no Python. A header that does
not fit in the captured bytes leaves its own layer and all above it empty; the
frame itself is never dropped.
"""

from pyspark.sql import DataFrame

from ..functions.octets import big_endian, octets, word_pair

# Fixed values of the published protocols: header sizes in bytes, EtherTypes
# and protocol numbers as they stand on the wire.
ETHERNET = 14
IPV4_MIN = 20
IPV6 = 40
TCP_MIN = 20
UDP = 8
ICMP = 8
TYPE_IPV4 = "X'0800'"
TYPE_IPV6 = "X'86DD'"
NUMBER_ICMP = "X'01'"
NUMBER_TCP = "X'06'"
NUMBER_UDP = "X'11'"
NUMBER_ICMPV6 = "X'3A'"


def decode_packets(frames: DataFrame) -> DataFrame:
    """Replace ``frame`` by the decoded header columns of each layer.

    Fields of a layer that is absent are NULL, except ``ether_type``,
    ``protocol`` and ``ttl``, which are 0. Frames are taken as they are: no
    version, fragment or checksum test, no VLAN or extension-header walk.

    The presence flags compare raw bytes and are written straight on the frame.
    A filter on them is pushed down to the scan with its whole definition; kept
    small like this, scan, filter and projections stay one compiled method.
    """
    kept = [c for c in frames.columns if c != "frame"]
    ether = octets("frame", 12, 2)
    # The low half of the first IPv4 byte counts 32-bit header words.
    options_end = f"({big_endian('frame', ETHERNET, 1)} & 15) * 4 + {ETHERNET}"
    # Bytes behind the network header and the protocol number in it.
    behind = f"""CASE {ether} WHEN {TYPE_IPV4} THEN IF(_size >= {ETHERNET + IPV4_MIN}, _size - ({options_end}), -1)
                              WHEN {TYPE_IPV6} THEN _size - {ETHERNET + IPV6} ELSE -1 END"""
    number = f"substring(frame, IF({ether} = {TYPE_IPV4}, 24, 21), 1)"
    sized = frames.selectExpr(*kept, "frame", "coalesce(length(frame), 0) AS _size")
    upper = sized.selectExpr(
        "*",
        f"{ether} = {TYPE_IPV4} AND {behind} >= 0 AS _v4",
        f"{ether} = {TYPE_IPV6} AND _size >= {ETHERNET + IPV6} AS _v6",
        f"""{behind} >= CASE {number} WHEN {NUMBER_TCP} THEN {TCP_MIN}
                                      WHEN {NUMBER_UDP} THEN {UDP} END AS _ports_fit""",
        f"""{behind} >= {ICMP} AND {number} = IF({ether} = {TYPE_IPV4}, {NUMBER_ICMP}, {NUMBER_ICMPV6}) AS _message_fits""",
    ).selectExpr(
        *kept,
        "frame",
        "_size",
        "coalesce(_v4, false) AS has_ipv4",
        "coalesce(_v6, false) AS has_ipv6",
        "coalesce(_ports_fit, false) AS has_transport",
        "coalesce(_v4 AND _message_fits, false) AS has_icmp",
        "coalesce(_v6 AND _message_fits, false) AS has_icmpv6",
    ).selectExpr(
        "*",
        f"CAST(IF(has_ipv4, {options_end}, {ETHERNET + IPV6}) AS INT) AS _l4",
    )
    # Neighbouring fields are converted in one go and split by shifts below.
    numbers = upper.selectExpr(
        "*",
        # IPv4 stores TTL then protocol, IPv6 next header then hop limit.
        f"""CASE WHEN has_ipv4 THEN {big_endian('frame', 22, 2)}
                 WHEN has_ipv6 THEN {big_endian('frame', 20, 2)} ELSE 0L END AS _hop""",
        f"CASE WHEN has_ipv4 THEN {word_pair('frame', 26)} END AS _addresses",
        f"CASE WHEN has_transport THEN {big_endian('frame', '_l4', 4)} END AS _ports",
        f"CASE WHEN has_icmp OR has_icmpv6 THEN {big_endian('frame', '_l4', 2)} END AS _message",
        f"CASE WHEN has_transport AND {number} = {NUMBER_TCP} THEN {big_endian('frame', '_l4 + 13', 1)} END AS _flags",
    )
    return numbers.selectExpr(
        *kept,
        f"CASE WHEN _size >= {ETHERNET} THEN {octets('frame', 6, 6)} END AS src_mac",
        f"CASE WHEN _size >= {ETHERNET} THEN {octets('frame', 0, 6)} END AS dst_mac",
        f"CAST(CASE WHEN _size >= {ETHERNET} THEN {big_endian('frame', 12, 2)} ELSE 0 END AS INT) AS ether_type",
        "has_ipv4",
        "shiftrightunsigned(_addresses, 32) AS src_ip",
        "_addresses & 4294967295 AS dst_ip",
        "CAST(CASE WHEN has_ipv6 THEN shiftright(_hop, 8) ELSE _hop & 255 END AS INT) AS protocol",
        "CAST(CASE WHEN has_ipv6 THEN _hop & 255 ELSE shiftright(_hop, 8) END AS INT) AS ttl",
        "has_transport",
        "CAST(shiftright(_ports, 16) AS INT) AS src_port",
        "CAST(_ports & 65535 AS INT) AS dst_port",
        "CAST(_flags AS INT) AS tcp_flags",
        "has_icmp",
        "has_icmpv6",
        "CAST(shiftright(_message, 8) AS INT) AS icmp_type",
        "CAST(_message & 255 AS INT) AS icmp_code",
        "has_ipv6",
        f"CASE WHEN has_ipv6 THEN {octets('frame', 22, 16)} END AS src_ip6",
        f"CASE WHEN has_ipv6 THEN {octets('frame', 38, 16)} END AS dst_ip6",
    )
