"""Records to a syslog server, over TCP, UDP or TLS."""

from __future__ import annotations

import socket
import ssl
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.syslog import syslog_line


@dataclass(frozen=True)
class Target:
    """Where lines go: protocol tcp, udp or tls, address host:port, timeouts in seconds."""

    protocol: str = "tcp"
    address: str = "127.0.0.1:514"
    connect_timeout: float = 10
    write_timeout: float = 5
    ca_file: str | None = None
    attempts: int = 3

    def __post_init__(self):
        if self.protocol not in ("tcp", "udp", "tls"):
            raise ValueError(f"no protocol {self.protocol}")

    def connect(self) -> socket.socket:
        host, _, port = self.address.rpartition(":")
        if self.protocol == "udp":
            family = socket.getaddrinfo(host, int(port), type=socket.SOCK_DGRAM)[0]
            s = socket.socket(family[0], socket.SOCK_DGRAM)
            s.connect(family[4])
        else:
            s = socket.create_connection((host, int(port)), self.connect_timeout)
            if self.protocol == "tls":
                s = ssl.create_default_context(cafile=self.ca_file).wrap_socket(s, server_hostname=host)
        s.settimeout(self.write_timeout)
        return s

    def send(self, lines: Iterable[str]) -> int:
        """Send lines, each ended by a line feed; connects again where the connection was lost."""
        s, sent = None, 0
        try:
            for line in lines:
                data = line.encode() if line.endswith("\n") else line.encode() + b"\n"
                for attempt in range(self.attempts):
                    try:
                        s = s or self.connect()
                        s.sendall(data)
                        sent += 1
                        break
                    except OSError:
                        if s is not None:
                            s.close()
                        s = None
                        if attempt + 1 == self.attempts:
                            raise
        finally:
            if s is not None:
                s.close()
        return sent


@dataclass(frozen=True)
class Syslog:
    """Sends each record as a syslog line; templates as for syslog_line. A failure fails the batch, which then comes again.

    One task sends all lines over one connection in the order of the rows, reading one sorted
    partition after the other. With `ordered` off each partition has a connection of its own.
    """

    target: Target = field(default_factory=Target)
    templates: tuple[tuple[str, str], ...] = ()
    replace_newlines: bool = True
    limit: int = 1024
    ordered: bool = True

    def __call__(self, rows: DataFrame) -> None:
        target = self.target
        lines = rows.select(syslog_line(**dict(self.templates), replace_newlines=self.replace_newlines, limit=self.limit).alias("line"))

        def send(batches):
            target.send(line for batch in batches for line in batch["line"])
            yield from ()

        (lines.coalesce(1) if self.ordered else lines).mapInPandas(send, "line string").count()
