"""Connection policy of the graph database sink."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import urlparse

# The schemes of the driver protocol.
PLAIN, SECURE = ("bolt", "neo4j"), ("bolt+s", "bolt+ssc", "neo4j+s", "neo4j+ssc")


class TlsRequired(RuntimeError):
    """The command line exits with 4."""


@dataclass(frozen=True)
class Connection:
    uri: str
    user: str
    password: str
    database: str
    warning: str | None = None


def connection(env: Mapping[str, str] = os.environ, require_tls: bool = False) -> Connection:
    """From NEO4J_URI, NEO4J_USER, NEO4J_PASSWORD and NEO4J_DATABASE; plain text beyond this host warns or raises."""
    uri = env.get("NEO4J_URI", "bolt://localhost:7687")
    parts = urlparse(uri)
    if parts.scheme not in PLAIN + SECURE:
        raise ValueError(f"scheme {parts.scheme!r} is not supported")
    warning = None
    if parts.scheme in PLAIN and (parts.hostname or "") not in ("localhost", "127.0.0.1", "::1"):
        if require_tls:
            raise TlsRequired(f"{parts.scheme} to {parts.hostname} is not encrypted")
        warning = f"{parts.scheme} to {parts.hostname} is not encrypted"
    return Connection(uri, env.get("NEO4J_USER", "neo4j"), env.get("NEO4J_PASSWORD", ""), env.get("NEO4J_DATABASE", "neo4j"), warning)


class _Session:
    """A database session that runs statements in one transaction each batch."""

    def __init__(self, driver, database: str):
        self.driver, self.session = driver, driver.session(database=database)

    def run(self, statements: list[str]) -> None:
        def work(transaction) -> None:
            for statement in statements:
                transaction.run(statement)

        self.session.execute_write(work)

    def close(self) -> None:
        self.session.close()
        self.driver.close()


def driver(made: Connection):
    """A function that connects, for ``operators.exports.sync``; needs the database's Python driver on the executors."""

    def connect():
        from neo4j import GraphDatabase

        return _Session(GraphDatabase.driver(made.uri, auth=(made.user, made.password)), made.database)

    return connect
