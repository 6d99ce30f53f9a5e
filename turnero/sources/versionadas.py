"""Stored tables whose changes, however many months they touch, are seen whole or not at all.

Rows lie in parts, each written once and never changed: ``<tabla>/parte=<id>/mes=<yyyy-MM>``.  A commit is one
row in ``<tabla>_confirmadas`` with the parts that make up every month from then on; readers take the row with
the highest version.  A part that was written but not committed is not there for anybody, so a job that breaks
off leaves the table as it was.  Two writers that start from the same version both write a row of the next
one; all readers take the one with the least part name and the other writer gets ``VersionPerdida``.

Tables without a date have one month, ``todo``.  A row without date is in ``mes`` null.

Layout.  The number of files follows the bytes of the rows, not the number of tasks and months.  Rows are
dealt out by range of (month, professional, date) and a hash that spreads a crowded day, and sorted so in each
file: statistics of files and row groups then tell which of them a professional or date is in.
"""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from turnero.sources.tablas import claves_distintas, con_mes, materializar

TODO = "todo"
SIN_MES = "__HIVE_DEFAULT_PARTITION__"
BYTES_ARCHIVO = 256 * 1024 * 1024

CONFIRMADAS = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("parte", T.StringType()),
    T.StructField("meses", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])


class VersionPerdida(Exception):
    """Another writer committed the same version first."""


# ---- Layout ----


def _ancho(campo: T.StructField) -> Column:
    """Bytes a value takes, before compression."""
    if isinstance(campo.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(campo.name), F.lit(0))
    if isinstance(campo.dataType, T.AtomicType):
        return F.lit(8)
    return F.coalesce(F.octet_length(F.to_json(F.struct(campo.name))), F.lit(0))


def escribir_por_mes(df: DataFrame, ruta: str, bytes_archivo: int = BYTES_ARCHIVO) -> list[str]:
    """Writes rows with a column ``mes``, by month, in files of about ``bytes_archivo``; the months written.

    The rows are measured first; the number of files is at most bytes / ``bytes_archivo`` + 1 a month.
    """
    ancho = sum((_ancho(c) for c in df.schema), F.lit(0))
    medidas = df.groupBy("mes").agg(F.sum(ancho).alias("bytes")).collect()
    n = max(1, math.ceil(sum(m["bytes"] for m in medidas) / bytes_archivo))
    orden = ["mes", *[c for c in ("audiologo_id", "fecha") if c in df.columns]]
    sal = F.hash(*[c for c in df.columns if isinstance(df.schema[c].dataType, T.AtomicType)])
    (
        df.withColumn("_sal", sal).repartitionByRange(n, *orden, "_sal").sortWithinPartitions(*orden, "_sal")
        .drop("_sal").write.partitionBy("mes").parquet(ruta)
    )
    return [SIN_MES if m["mes"] is None else m["mes"] for m in medidas]


# ---- Versions ----


def confirmada(spark: SparkSession, carpeta: str, nombre: str, version: int | None = None) -> tuple[int, dict[str, list[str]]]:
    """The last committed version, or the given one, and the parts of every month; version 0 has none."""
    try:
        filas = spark.read.schema(CONFIRMADAS).parquet(f"{carpeta}/{nombre}_confirmadas")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    if version is not None:
        filas = filas.filter(F.col("version") == version)
    ultima = filas.orderBy(F.desc("version"), "parte").limit(1).collect()
    return (ultima[0]["version"], dict(ultima[0]["meses"])) if ultima else (0, {})


def confirmar(spark: SparkSession, carpeta: str, nombre: str, base: int, parte: str, meses: dict[str, list[str]]) -> int:
    """Makes ``meses`` the table's content in the version after ``base``: one row, written last."""
    fila = spark.createDataFrame([(base + 1, parte, meses)], CONFIRMADAS)
    fila.coalesce(1).write.mode("append").parquet(f"{carpeta}/{nombre}_confirmadas")
    if confirmada(spark, carpeta, nombre, base + 1)[1] != meses:
        raise VersionPerdida(f"{nombre}: version {base + 1} is another writer's")
    return base + 1


def leer(
    spark: SparkSession, carpeta: str, nombre: str, esquema: T.StructType,
    desde: str | None = None, hasta: str | None = None, version: int | None = None,
    solo: list[str] | None = None,
) -> DataFrame:
    """The table as last committed, or in a version, with ``mes``; only the months from ``desde`` to ``hasta``.

    Dates cut months only, rows without date are always there.  ``solo`` names the months instead.  Months that
    are left out are not even listed.
    """
    _, meses = confirmada(spark, carpeta, nombre, version)
    rutas = [
        f"{carpeta}/{nombre}/parte={p}/mes={m}" for m, partes in sorted(meses.items()) for p in partes
        if (m in solo if solo is not None else _toca(m, desde, hasta))
    ]
    campos = [c for c in esquema.fields if c.name != "mes"]
    con_particion = T.StructType([*campos, T.StructField("parte", T.StringType()), T.StructField("mes", T.StringType())])
    if not rutas:
        return spark.createDataFrame([], con_particion).drop("parte")
    lector = spark.read.schema(con_particion).option("basePath", f"{carpeta}/{nombre}")
    return lector.parquet(*rutas).drop("parte")


def _toca(mes: str, desde: str | None, hasta: str | None) -> bool:
    if mes in (TODO, SIN_MES):
        return True
    return (desde is None or mes >= desde[:7]) and (hasta is None or mes <= hasta[:7])


def _nueva_parte(df: DataFrame, carpeta: str, nombre: str, bytes_archivo: int) -> tuple[str, list[str]]:
    parte = uuid.uuid4().hex
    df = con_mes(df) if "fecha" in df.columns else df.withColumn("mes", F.lit(TODO))
    # Measured and written from one result, so that both see the same rows.
    fijas = materializar(df, "parte")
    return parte, escribir_por_mes(fijas, f"{carpeta}/{nombre}/parte={parte}", bytes_archivo)


def agregar_filas(df: DataFrame, carpeta: str, nombre: str, bytes_archivo: int = BYTES_ARCHIVO) -> int:
    """Adds rows; the new version."""
    spark = df.sparkSession
    version, meses = confirmada(spark, carpeta, nombre)
    parte, escritos = _nueva_parte(df, carpeta, nombre, bytes_archivo)
    for m in escritos:
        meses[m] = [*meses.get(m, []), parte]
    return confirmar(spark, carpeta, nombre, version, parte, meses)


def reemplazar(
    df: DataFrame, carpeta: str, nombre: str, desde: str | None = None, hasta: str | None = None,
    bytes_archivo: int = BYTES_ARCHIVO, solo: list[str] | None = None,
) -> int:
    """Puts ``df`` in place of all rows in the months from ``desde`` to ``hasta``; the new version.

    Both ends are open when null; ``solo`` names the months instead.  A month of the table in that span which ``df`` has no row of is empty
    afterwards, in the same commit.  Rows without date are replaced only when both ends are open.
    ``df`` may be computed from the table itself, which is read until the commit.  Rows of ``df`` outside
    the span are an error, for they would be doubled.
    """
    spark = df.sparkSession
    version, meses = confirmada(spark, carpeta, nombre)
    parte, escritos = _nueva_parte(df, carpeta, nombre, bytes_archivo)
    todo = desde is None and hasta is None

    def dentro(m: str) -> bool:
        if solo is not None:
            return m in solo
        return todo or (m not in (SIN_MES, TODO) and _toca(m, desde, hasta))

    fuera = [m for m in escritos if not dentro(m)]
    if fuera:
        raise ValueError(f"rows outside the months to replace: {fuera}")
    meses = {m: p for m, p in meses.items() if not dentro(m)} | {m: [parte] for m in escritos}
    return confirmar(spark, carpeta, nombre, version, parte, meses)


def fundir(
    cambios: DataFrame, carpeta: str, nombre: str, esquema: T.StructType, clave: str = "id",
    bytes_archivo: int = BYTES_ARCHIVO,
) -> int:
    """Puts changed and new rows (whole rows, by ``clave``) into the table; the new version.

    Only the months that held a changed row, or get one, are written again; the others keep their parts.
    """
    spark = cambios.sparkSession
    version, meses = confirmada(spark, carpeta, nombre)
    cambios = materializar(con_mes(cambios) if "fecha" in cambios.columns else cambios.withColumn("mes", F.lit(TODO)), "cambios")
    actual = leer(spark, carpeta, nombre, esquema, version=version) if version else None
    claves = claves_distintas(cambios, [clave])
    tocados = {f["mes"] for f in cambios.select("mes").distinct().collect()}
    if actual is not None:
        tocados |= {f["mes"] for f in actual.join(claves, clave, "left_semi").select("mes").distinct().collect()}
    nombres = {SIN_MES if m is None else m for m in tocados}
    columnas = [c.name for c in esquema.fields if c.name != "mes"]
    nuevas = cambios.select(*columnas, "mes")
    if actual is not None:
        de_esos = actual.filter(F.coalesce("mes", F.lit(SIN_MES)).isin(sorted(nombres)))
        nuevas = de_esos.join(claves, clave, "left_anti").select(*columnas, "mes").unionByName(nuevas)
    parte, escritos = _nueva_parte(nuevas, carpeta, nombre, bytes_archivo)
    meses = {m: p for m, p in meses.items() if m not in nombres} | {m: [parte] for m in escritos}
    return confirmar(spark, carpeta, nombre, version, parte, meses)
