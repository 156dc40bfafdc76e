"""Socket messages and directory streams that feed the batch operators."""

from __future__ import annotations

import socket

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def tcp_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of the lines that a TCP server sends."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


class UdpSource(DataSource):
    """Stream of UDP datagrams (options host, port, wait): format ``udp_text``, one column value."""

    @classmethod
    def name(cls) -> str:
        return "udp_text"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema):  # noqa: N802
        return UdpReader(self.options)


class UdpReader(SimpleDataSourceStreamReader):
    """Datagrams received so far are kept until their batch is committed, so that a batch can be read again."""

    def __init__(self, options):
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((options.get("host", "127.0.0.1"), int(options.get("port", "1024"))))
        self.socket.settimeout(float(options.get("wait", "0.2")))
        self.first, self.held = 0, []

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0}

    def read(self, start: dict):
        try:
            while True:
                self.held.append((self.socket.recv(65535).decode("utf-8", "replace"),))
        except TimeoutError:
            pass
        end = self.first + len(self.held)
        return iter(self.held[start["next"] - self.first :]), {"next": end}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        return iter(self.held[start["next"] - self.first : end["next"] - self.first])

    def commit(self, end: dict) -> None:
        self.held, self.first = self.held[end["next"] - self.first :], end["next"]


def send_tcp(message: bytes, host: str, port: int) -> None:
    with socket.create_connection((host, port), timeout=10) as s:
        s.sendall(message)


def send_udp(message: bytes, host: str, port: int) -> None:
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(message, (host, port))


def to_udp(stream: DataFrame, host: str, port: int, column: str = "value"):
    """A stream writer that sends each row of a batch as a datagram, from the executors."""
    def send(batch: DataFrame, _: int) -> None:
        batch.select(column).foreachPartition(lambda rows: [send_udp(str(r[0]).encode(), host, port) for r in rows])

    return stream.writeStream.foreachBatch(send)


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the parquet files of a folder, for the same operators as a batch."""
    return spark.readStream.schema(schema).parquet(path)
