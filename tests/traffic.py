"""Packets that several tests use."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"


def syn_scan(src="10.0.0.50", n=10, step=0.5, flags="S", proto=6, size=20, begin=0.0):
    return [
        (begin + i * step, src, 50000 + i, "192.168.1.100", 20 + i, proto, size, flags) for i in range(n)
    ]


def background():
    """One UDP lookup and one handshake next to the scan."""
    return [
        (0.0, "192.168.1.5", 54321, "8.8.8.8", 53, 17, 41, ""),
        (0.1, "192.168.1.6", 49152, "192.168.1.100", 80, 6, 20, "S"),
        (0.2, "192.168.1.100", 80, "192.168.1.6", 49152, 6, 20, "SA"),
        (0.3, "192.168.1.6", 49152, "192.168.1.100", 80, 6, 20, "A"),
    ]
