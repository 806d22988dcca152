"""Configuration and the Spark session."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import SparkSession

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


@dataclass(frozen=True)
class DatabaseConfig:
    """Where a JDBC source is; read from DB_* variables."""

    host: str = "localhost"
    port: int = 5432
    name: str = "housing"
    user: str = "postgres"
    password: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> DatabaseConfig:
        base = cls()
        return cls(env.get("DB_HOST", base.host), int(env.get("DB_PORT", base.port)), env.get("DB_NAME", base.name), env.get("DB_USER", base.user), env.get("DB_PASSWORD", base.password))

    def url(self) -> str:
        """The JDBC address, parts escaped; fails without a password."""
        if not self.password:
            raise ValueError("DB_PASSWORD is not set")
        return f"jdbc:postgresql://{self.host}:{self.port}/{quote(self.name, safe='')}?user={quote(self.user, safe='')}&password={quote(self.password, safe='')}"


def checked_identifier(name: str) -> str:
    if not IDENTIFIER.match(name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name


def session(name: str = "plotwright", **conf: str) -> SparkSession:
    """A session as the engine expects it: UTC, ANSI, adaptive execution; intermediate tables go when nothing refers to them any more, and streams keep state with timers."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    return SparkSession.builder.appName(name).config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
