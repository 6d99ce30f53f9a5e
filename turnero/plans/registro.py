"""Registry of named queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnero.sources.derivadas import PRELUDIO, Derivadas, hm_sql

Consulta = Callable[[SparkSession, str], DataFrame]

CONSULTAS: dict[str, Consulta] = {}
ORACULO: dict[str, str] = {}

# Period and day the registered queries use.
DESDE, HASTA, HOY = "2024-01-01", "2024-01-30", "2024-01-15"


def consulta(nombre: str, sql: str | None = None):
    """Registers a query on the derived tables; ``sql`` follows the shared prelude."""
    def registrar(f: Callable[[Derivadas], DataFrame]):
        CONSULTAS[nombre] = lambda spark, carpeta: f(Derivadas(spark, carpeta))
        if sql is not None:
            ORACULO[nombre] = PRELUDIO + sql
        return f

    return registrar


def hm(campo: str, alias: str | None = None) -> str:
    return f"{hm_sql(campo)} {alias}" if alias else hm_sql(campo)


HORAS = f"{hm('ini', 'hora_inicio')}, {hm('fin', 'hora_fin')}"
