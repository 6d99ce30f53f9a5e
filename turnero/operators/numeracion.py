"""Position numbers inside groups, without gathering a group.

``row_number()`` over a group puts the whole group into one task.  Here the rows are dealt out by range
of (group, order), so a crowded group covers several parts; rows are numbered inside their part, and the
rows of the group in earlier parts are added.  A group goes on from an earlier part only when it is the
first of a part, so there is at most one such sum a part, and they can be sent to every task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnero.sources.tablas import materializar


def por_turno(df: DataFrame, orden: list, nombre: str = "t") -> DataFrame:
    """Adds ``nombre``, a number that grows by ``orden``, no two rows the same; it has gaps.

    Enough to tell earlier from later, and rows move once only.  Equal rows come in any order, but only once:
    the numbers are written and read back.
    """
    return materializar(
        df.repartitionByRange(*orden).sortWithinPartitions(*orden)
        .withColumn(nombre, F.monotonically_increasing_id()), "turnos")


def numerar(
    df: DataFrame, clave: list[str], orden: list, nombre: str = "numero", partes: int | None = None,
) -> DataFrame:
    """Adds ``nombre``, the place of a row in its group from 1: ``row_number`` by ``clave`` and ``orden``.

    A null key is a group, and nulls come first, as in ``row_number``.  Rows that are equal in ``orden``
    are numbered in any order, but only once: the numbers are written and read back.  ``partes`` is the
    number of parts; without it the session's number of shuffle partitions holds.
    """
    rango = [*[F.col(c).asc_nulls_first() for c in clave], *orden]
    repartidas = df.repartitionByRange(partes, *rango) if partes else df.repartitionByRange(*rango)
    fijas = materializar(
        repartidas.sortWithinPartitions(*rango)
        .withColumns({"_parte": F.spark_partition_id(), "_fila": F.monotonically_increasing_id()}),
        "numeradas",
    )
    por_parte = fijas.groupBy("_parte", *clave).agg(F.count(F.lit(1)).alias("_n"))
    anteriores = Window.partitionBy(*clave).orderBy("_parte").rowsBetween(Window.unboundedPreceding, -1)
    siguen = (
        por_parte.withColumn("_antes", F.sum("_n").over(anteriores)).filter(F.col("_antes").isNotNull())
        .select("_parte", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(clave)], "_antes")
    )
    local = fijas.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_parte", *clave).orderBy("_fila"))
    )
    iguales: Column = reduce(
        lambda a, b: a & b, [local[c].eqNullSafe(siguen[f"_c{i}"]) for i, c in enumerate(clave)],
        local["_parte"] == siguen["_parte"],
    )
    numero = F.col("_local").cast("long") + F.coalesce("_antes", F.lit(0))
    return local.join(F.broadcast(siguen), iguales, "left").select(
        *[local[c] for c in df.columns], numero.alias(nombre)
    )
