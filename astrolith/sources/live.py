"""A live feed as a streaming source: frames over TCP, each a length and that many bytes."""

from __future__ import annotations

import socket
import struct
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Seconds without a frame after which the connection is made anew.
IDLE = 120.0


class FrameReader(SimpleDataSourceStreamReader):
    """Frames since the last call, up to ``most``: a bound on what a micro-batch takes, so a fast feed waits in
    its socket. A feed keeps no past: frames that come while no one listens are lost, as with any subscription."""

    def __init__(self, options: dict):
        self.address = (options.get("host", "127.0.0.1"), int(options["port"]))
        self.most, self.wait = int(options.get("most", 500)), float(options.get("wait", 0.25))
        self.idle = float(options.get("idle", IDLE))
        self.link: socket.socket | None = None
        self.buffer, self.heard = b"", time.monotonic()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frames": 0}

    def _receive(self, until: float) -> bool:
        try:
            if self.link is None:
                self.link = socket.create_connection(self.address, timeout=self.wait)
                self.buffer = b""
            self.link.settimeout(max(0.001, until - time.monotonic()))
            data = self.link.recv(1 << 16)
            if data:
                self.buffer += data
                self.heard = time.monotonic()
                return True
        except TimeoutError:
            if time.monotonic() - self.heard < self.idle:
                return False
        except OSError:
            time.sleep(min(0.05, self.wait))
        if self.link is not None:  # closed, broken or idle for too long
            self.link.close()
        self.link, self.heard = None, time.monotonic()
        return False

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        frames: list[bytes] = []
        until = time.monotonic() + self.wait
        while len(frames) < self.most and time.monotonic() < until:
            self._receive(until)
            while len(self.buffer) >= 4 and len(frames) < self.most:
                size = struct.unpack(">I", self.buffer[:4])[0]
                if len(self.buffer) < 4 + size:
                    break
                frames.append(self.buffer[4 : 4 + size])
                self.buffer = self.buffer[4 + size :]
        first = start["frames"]
        return iter([(first + k, bytearray(f)) for k, f in enumerate(frames)]), {"frames": first + len(frames)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([])  # a replay after a restart finds no past frames


class FrameSource(DataSource):
    """``spark.dataSource.register(FrameSource)``, then ``readStream.format("frames").option("port", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "seq long, frame binary"

    def simpleStreamReader(self, schema) -> FrameReader:  # noqa: N802
        return FrameReader(self.options)
