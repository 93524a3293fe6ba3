"""Big-endian fields of a datagram, read in order."""

from __future__ import annotations

import struct


class Short(ValueError):
    """The datagram ends before the field does."""


class Fields:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def left(self) -> int:
        return len(self.raw) - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.left():
            raise Short(f"{n} bytes wanted, {self.left()} left")
        self.at += n
        return self.raw[self.at - n : self.at]

    def read(self, form: str) -> tuple:
        return struct.unpack("!" + form, self.take(struct.calcsize("!" + form)))

    def u32(self) -> int:
        return self.read("I")[0]

    def u16(self) -> int:
        return self.read("H")[0]


def dispatch(raw: bytes) -> str:
    """Which decoder a datagram is for, by its first bytes: sflow, nf5, nf9, ipfix, or '' if none."""
    if len(raw) >= 4 and raw[:4] == b"\0\0\0\5":
        return "sflow"
    return {5: "nf5", 9: "nf9", 10: "ipfix"}.get(struct.unpack_from("!H", raw)[0], "") if len(raw) >= 2 else ""
