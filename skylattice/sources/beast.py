"""The binary frame stream: 0x1A, a type, a 6-byte tick, a signal byte, a payload; 0x1A is doubled inside."""

from __future__ import annotations

import glob
import socket
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..config import FRAME_KINDS, PAYLOAD_BYTES, TICK_CORRECTION
from ..schema import FRAMES

MARK = 0x1A
_BODY = {0x30 + k: 7 + n for k, n in PAYLOAD_BYTES.items()}


class Parser:
    """feed() takes chunks of any size and yields (type, body) of whole frames; what cannot be a frame is skipped and
    counted, and the search goes on at once."""

    def __init__(self):
        self.held, self.errors = bytearray(), 0

    def feed(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        buf = self.held
        buf += data
        at = 0
        while True:
            start = buf.find(MARK, at)
            if start < 0:
                self.errors += at < len(buf)
                at = len(buf)
                break
            self.errors += start > at
            at = start
            if at + 1 >= len(buf):
                break
            need = _BODY.get(buf[at + 1])
            if need is None:
                self.errors += 1
                at += 2 if buf[at + 1] == MARK else 1
                continue
            body, k, cut = bytearray(), at + 2, False
            while len(body) < need and k < len(buf):
                if buf[k] != MARK:
                    body.append(buf[k])
                    k += 1
                elif k + 1 >= len(buf):
                    break
                elif buf[k + 1] == MARK:
                    body.append(MARK)
                    k += 2
                else:
                    cut = True
                    break
            if cut:  # a new frame begins inside this one
                self.errors += 1
                at = k
            elif len(body) < need:
                break
            else:
                yield buf[at + 1] - 0x30, bytes(body)
                at = k
        del buf[:at]


def decode(station: str, kind: int, body: bytes, utc_ns: int, mono_ns: int) -> tuple:
    """A row of schema.FRAMES; a tick of zero is a missing one and stays zero."""
    tick = int.from_bytes(body[:6], "big")
    return (station, utc_ns, mono_ns, kind, FRAME_KINDS[kind], tick, tick - TICK_CORRECTION[kind] if tick else 0, body[6], body[7:].hex())


class _Files(DataSourceReader):
    def __init__(self, options):
        self.files, self.station, self.utc_ns = sorted(glob.glob(options["path"])), options.get("station", ""), int(options.get("utc_ns", 0))

    def partitions(self):
        return [InputPartition(f) for f in self.files]

    def read(self, partition):
        parser = Parser()
        with open(partition.value, "rb") as f:
            while chunk := f.read(1 << 16):
                for kind, body in parser.feed(chunk):
                    yield decode(self.station, kind, body, self.utc_ns, 0)


class _Live(SimpleDataSourceStreamReader):
    """One TCP connection; the offset counts frames. Unread data waits in the socket, so a slow query slows the sender
    instead of losing frames; `max_frames` bounds a batch."""

    def __init__(self, options):
        self.host, self.port, self.station = options.get("host", "127.0.0.1"), int(options["port"]), options.get("station", "")
        self.most, self.parser, self.link = int(options.get("max_frames", 50_000)), Parser(), None

    def initialOffset(self):
        return {"frames": 0}

    def read(self, start):
        if self.link is None:
            self.link = socket.create_connection((self.host, self.port), timeout=5)
            self.link.settimeout(0.2)
        rows = []
        while len(rows) < self.most:
            try:
                chunk = self.link.recv(1 << 16)
            except TimeoutError:
                break
            if not chunk:
                break
            now, mono = time.time_ns(), time.monotonic_ns()
            rows += [decode(self.station, k, b, now, mono) for k, b in self.parser.feed(chunk)]
        return iter(rows), {"frames": start["frames"] + len(rows)}

    def readBetweenOffsets(self, start, end):
        return iter(())  # a live feed cannot be asked twice


class BeastSource(DataSource):
    """spark.dataSource.register(BeastSource); format 'beast': option path (files) or host and port (stream), station."""

    @classmethod
    def name(cls):
        return "beast"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return _Files(self.options)

    def simpleStreamReader(self, schema):
        return _Live(self.options)
