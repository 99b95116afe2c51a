from .rates import average_packet_size, duration_seconds, per_second
from .text import (
    ethertype_text,
    ipv4_text,
    ipv6_text,
    mac_text,
    six_digit_text,
    six_digits,
    time_text,
)

__all__ = [
    "average_packet_size",
    "duration_seconds",
    "ethertype_text",
    "ipv4_text",
    "ipv6_text",
    "mac_text",
    "per_second",
    "six_digit_text",
    "six_digits",
    "time_text",
]
