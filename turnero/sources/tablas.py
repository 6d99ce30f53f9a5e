"""Reading and writing the domain tables as parquet.

Dated tables are partitioned by month of ``fecha``, so a date range prunes files.  A table is
replaced by writing a new version beside the old one and then recording it, so readers see
either the whole old table or the whole new one, and a lost job leaves nothing half replaced.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnero.sources.esquemas import ESQUEMAS, POR_DEFECTO

LIMPIEZA = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FECHADAS = ["citas", "horarios_fecha", "bloqueos"]


def read_table(spark: SparkSession, carpeta: str, nombre: str) -> DataFrame:
    """Whole domain table with its declared schema: no inference pass over the files."""
    return spark.read.schema(ESQUEMAS[nombre]).parquet(f"{carpeta}/{nombre}")


def valores(spark: SparkSession, filas: list[tuple], columnas: list[str]) -> DataFrame:
    """A VALUES relation: a few rows of literals that are part of the plan and read no file."""
    marcas = ", ".join("(" + ", ".join(f":v{i}_{j}" for j in range(len(columnas))) + ")" for i in range(len(filas)))
    datos = {f"v{i}_{j}": v for i, fila in enumerate(filas) for j, v in enumerate(fila)}
    return spark.sql(f"select * from values {marcas} as t({', '.join(columnas)})", args=datos)


def con_mes(df: DataFrame) -> DataFrame:
    return df.withColumn("mes", F.date_format("fecha", "yyyy-MM"))


def entre_fechas(df: DataFrame, desde: str, hasta: str) -> DataFrame:
    """Rows of a date range; a ``mes`` partition column, when there is one, is filtered too.

    ``fecha`` decides: a row without month is never dropped for it.
    """
    if "mes" in df.columns:
        df = df.filter(F.col("mes").between(desde[:7], hasta[:7]) | F.col("mes").isNull())
    return df.filter(F.col("fecha").between(F.lit(desde).cast("date"), F.lit(hasta).cast("date")))


def en_fechas_de(tabla: DataFrame, lote: DataFrame) -> DataFrame:
    """Rows of ``tabla`` from the first to the last date of ``lote``.

    The bounds are scalar subqueries, so they prune months and row groups when the scan starts:
    a batch for the coming weeks does not read the appointments of past years.
    """
    limites = lote.agg(F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"))
    desde, hasta = limites.select("desde").scalar(), limites.select("hasta").scalar()
    if "mes" in tabla.columns:
        tabla = tabla.filter(
            F.col("mes").between(F.date_format(desde, "yyyy-MM"), F.date_format(hasta, "yyyy-MM"))
            | F.col("mes").isNull()
        )
    return tabla.filter(F.col("fecha").between(desde, hasta))


def _escritor(df: DataFrame, nombre: str):
    if nombre in FECHADAS:
        return con_mes(df).write.partitionBy("mes")
    return df.write


def append_table(df: DataFrame, carpeta: str, nombre: str) -> None:
    """Adds rows to a stored table."""
    _escritor(df, nombre).mode("append").parquet(f"{carpeta}/{nombre}")


def replace_months(df: DataFrame, carpeta: str, nombre: str, meses: list[str] | None = None) -> None:
    """Replaces the months present in ``df`` and leaves every other month alone.

    ``meses`` (``yyyy-MM``) names months that are replaced even when ``df`` has no row of them, such as
    a month whose last row was removed: it is then empty.
    """
    (
        con_mes(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("mes").parquet(f"{carpeta}/{nombre}")
    )
    if meses:
        hay = {f["mes"] for f in con_mes(df).filter(F.col("mes").isin(meses)).select("mes").distinct().collect()}
        for mes in set(meses) - hay:
            df.drop("mes").limit(0).write.mode("overwrite").parquet(f"{carpeta}/{nombre}/mes={mes}")


def publish_table(df: DataFrame, carpeta: str, nombre: str, version: int) -> None:
    """Writes ``df`` as a version of the table and records it once it is complete."""
    _escritor(df, nombre).mode("overwrite").parquet(f"{carpeta}/{nombre}/v{version}")
    (
        df.sparkSession.range(1).select(F.lit(version).alias("version"))
        .coalesce(1).write.mode("append").parquet(f"{carpeta}/{nombre}_versiones")
    )


def read_published(spark: SparkSession, carpeta: str, nombre: str) -> DataFrame:
    """The last version whose write finished."""
    versiones = spark.read.schema("version int").parquet(f"{carpeta}/{nombre}_versiones")
    ultima = versiones.agg(F.max("version").alias("v")).first()["v"]
    return spark.read.schema(ESQUEMAS[nombre]).parquet(f"{carpeta}/{nombre}/v{ultima}")


def con_valores_por_defecto(df: DataFrame, nombre: str, ahora: Column) -> DataFrame:
    """Adds defaulted columns that are absent; an explicit null stays null."""
    for columna, valor in POR_DEFECTO[nombre].items():
        if columna not in df.columns:
            nueva = ahora if valor == "ahora" else F.lit(valor)
            df = df.withColumn(columna, nueva.cast(ESQUEMAS[nombre][columna].dataType))
    return df


def con_id(nuevas: DataFrame, lote: str, unicas: bool) -> DataFrame:
    """Adds an ``id`` that a retried task computes again with the same value.

    The id hashes the batch label and the row.  Rows that may repeat are first counted and then
    written out again with their occurrence number, so equal rows get different ids.
    """
    columnas = nuevas.columns
    if not unicas:
        nuevas = (
            nuevas.groupBy(*columnas).agg(F.count(F.lit(1)).alias("_veces"))
            .withColumn("_vez", F.explode(F.sequence(F.lit(1), F.col("_veces")))).drop("_veces")
        )
    texto = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in nuevas.columns]
    return nuevas.withColumn(
        "id", F.sha2(F.concat_ws("\u0001", F.lit(lote), *texto), 256)
    ).select("id", *columnas)


def unir(tabla: DataFrame, nuevas: DataFrame) -> DataFrame:
    """Table plus rows that have some of its columns.

    A stored dated table has its month as a column; that of the new rows follows from their date.
    """
    if "mes" in tabla.columns and "fecha" in nuevas.columns:
        nuevas = con_mes(nuevas)
    return tabla.unionByName(nuevas, allowMissingColumns=True)


def anexar(
    tabla: DataFrame, nuevas: DataFrame, nombre: str, lote: str = "", unicas: bool = False,
    ahora: Column | None = None,
) -> DataFrame:
    """Table plus new rows, with the defaults of table ``nombre``.

    Ids are generated when the table has them and the rows do not.
    """
    columnas = [c for c in nuevas.columns if c in tabla.columns]
    nuevas = nuevas.select(*columnas)
    if "id" in tabla.columns and "id" not in columnas:
        nuevas = con_id(nuevas, lote, unicas)
        tabla = tabla.withColumn("id", F.col("id").cast("string"))
    nuevas = con_valores_por_defecto(
        nuevas, nombre, F.current_timestamp() if ahora is None else ahora)
    return unir(tabla, nuevas.select([c for c in nuevas.columns if c in tabla.columns]))


def carpeta_compartida(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    A local session that names none, as in tests, gets a folder of its own, set once for the
    session; on a cluster a local folder would lose data, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        fijada = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = fijada.get() if fijada.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="turnero-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def carpeta_de_trabajo(spark: SparkSession, nombre: str) -> str:
    """A new folder for one run, in the shared storage the session names."""
    return f"{carpeta_compartida(spark)}/{nombre}-{uuid.uuid4().hex}"


@contextmanager
def sin_restos(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of an action go when it ends; a second action would compute them again."""
    antes = spark.conf.get(LIMPIEZA, "false")
    spark.conf.set(LIMPIEZA, "true")
    try:
        yield
    finally:
        spark.conf.set(LIMPIEZA, antes)


def materializar(df: DataFrame, nombre: str, **opciones: str) -> DataFrame:
    """Writes ``df`` to a working folder, with options of the Parquet writer, and reads it back.

    For a result that several later steps use: it is computed once, all steps see the same rows
    even when executors are lost, and the plan behind it is cut off.  Nothing reads the shuffle files of that plan
    any more, so Spark removes them with the end of the write and not when the driver collects its garbage.
    """
    ruta = carpeta_de_trabajo(df.sparkSession, nombre)
    with sin_restos(df.sparkSession):
        df.write.options(**opciones).parquet(ruta)
    return df.sparkSession.read.schema(df.schema).parquet(ruta)


def claves_distintas(df: DataFrame, columnas: list[str]) -> DataFrame:
    """Distinct keys for the small side of a semi or anti join.

    A plain ``distinct`` leaves its rows where the join wants them, so the join adds no exchange on
    that side, and AQE splits a crowded key of the other side only between two exchanges.  Grouping
    by a hash as well makes the keys move once more, after they were reduced.
    """
    return df.select(*columnas, F.hash(*columnas).alias("_sal")).distinct().drop("_sal")


def reducir_a(
    grande: DataFrame, claves: DataFrame, columnas: list[str],
    reducir: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``reducir`` applied to the rows of ``grande`` whose ``columnas`` occur in ``claves``.

    ``reducir`` must aggregate by ``columnas`` or more.  Rows are reduced first: the aggregation
    shrinks a crowded key on the map side, where a join would bring all of its rows into one task.
    What is left is dealt out by another hash, so that whoever joins it moves both sides: AQE splits a
    crowded key of the other side only between two exchanges.
    """
    claves = claves.select(*columnas).distinct()
    reducida = reducir(grande).join(claves, columnas, "left_semi")
    return reducida.repartition(F.hash(*columnas, F.lit(1)))
