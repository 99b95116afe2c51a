from .decode import decode_packets
from .features import flow_features
from .flows import (
    build_flows,
    capture_clock,
    closed_flows,
    eligible,
    flow_key,
    frame_count,
    with_flow_key,
)
from .views import (
    active_flow_count,
    active_flows,
    captured_until,
    latest_packet,
    packet_details,
    throughput,
)

__all__ = [
    "active_flow_count",
    "active_flows",
    "build_flows",
    "capture_clock",
    "captured_until",
    "closed_flows",
    "decode_packets",
    "eligible",
    "flow_features",
    "flow_key",
    "frame_count",
    "latest_packet",
    "packet_details",
    "throughput",
    "with_flow_key",
]
