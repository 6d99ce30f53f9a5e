"""Sites, professionals and blocks: catalogue reads and bulk changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from turnero.functions.tiempo import hhmmss, serie_fechas
from turnero.sources.tablas import anexar, claves_distintas


def sedes_activas(sedes: DataFrame) -> DataFrame:
    return sedes.filter(F.col("activa")).orderBy("nombre", "id")


def audiologos_activos(audiologos: DataFrame) -> DataFrame:
    return audiologos.filter(F.col("activo")).orderBy("nombre", "id")


def audiologos_de_sede(audiologos: DataFrame, sede=None) -> DataFrame:
    """Professionals of one site, or all of them when no site is chosen."""
    return audiologos if sede is None else audiologos.filter(F.col("sede_id") == sede)


def con_nombre_de_sede(audiologos: DataFrame, sedes: DataFrame) -> DataFrame:
    """Professionals with site name and city; those without a site are dropped."""
    de_sede = sedes.select(
        F.col("id").alias("sede_id"), F.col("nombre").alias("sede"), "ciudad"
    )
    return audiologos.join(de_sede, "sede_id")


def audiologos_en(audiologos: DataFrame, sedes: DataFrame, nombres: list[str]) -> DataFrame:
    """Professionals of the named sites."""
    return con_nombre_de_sede(audiologos, sedes).filter(F.col("sede").isin(nombres))


def audiologos_fuera_de(
    audiologos: DataFrame, sedes: DataFrame, nombres: list[str]
) -> DataFrame:
    """Professionals of every site but the named ones."""
    return con_nombre_de_sede(audiologos, sedes).filter(~F.col("sede").isin(nombres))


# ---- Blocks ----


def cerrar_sedes(
    bloqueos: DataFrame, audiologos: DataFrame, sedes: DataFrame, nombres: list[str],
    desde: str, hasta: str, motivo: str, limpiar: bool = False, lote: str = "",
) -> DataFrame:
    """One whole-day block per professional of the sites and day of the period.

    ``limpiar`` first removes every block those professionals have in the period, whatever its
    reason; without it, running the closure twice adds the blocks twice.
    """
    quienes = audiologos_en(audiologos, sedes, nombres).select(
        F.col("id").alias("audiologo_id")
    )
    if limpiar:
        bloqueos = borrar_bloqueos(bloqueos, None, desde, hasta, quienes)
    cierre = quienes.select(
        "audiologo_id", F.explode(serie_fechas(desde, hasta)).alias("fecha"),
        F.lit(None).cast("string").alias("hora_inicio"),
        F.lit(None).cast("string").alias("hora_fin"), F.lit(motivo).alias("motivo"),
    )
    return anexar(bloqueos, cierre, "bloqueos", lote, unicas=True)


def por_nombre(lista: DataFrame, audiologos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows matched to professionals by name, and the rows whose name matches nobody.

    A name that several professionals share gives a row for each.
    """
    ids = audiologos.select("nombre", F.col("id").alias("audiologo_id"))
    return (
        lista.join(ids, "nombre"),
        lista.join(claves_distintas(ids, ["nombre"]), "nombre", "left_anti"),
    )


def bloquear_espacios(
    bloqueos: DataFrame, audiologos: DataFrame, lista: DataFrame, motivo: str, lote: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Adds time blocks from a list (``nombre, fecha, hora_inicio, hora_fin``).

    Also returns the rows whose name matches nobody.
    """
    cruzadas, sin_cruce = por_nombre(lista, audiologos)
    nuevos = cruzadas.select(
        "audiologo_id", F.col("fecha").cast("date").alias("fecha"),
        hhmmss("hora_inicio").alias("hora_inicio"), hhmmss("hora_fin").alias("hora_fin"),
        F.lit(motivo).alias("motivo"),
    )
    return anexar(bloqueos, nuevos, "bloqueos", lote), sin_cruce


def borrar_bloqueos(
    bloqueos: DataFrame, motivo: str | None = None, desde: str | None = None,
    hasta: str | None = None, audiologos: DataFrame | None = None,
) -> DataFrame:
    """Removes the blocks that meet every condition given; a null reason meets no reason.

    ``audiologos`` is a table with ``audiologo_id``.
    """
    cae = F.lit(True)
    if motivo is not None:
        cae = cae & F.col("motivo").eqNullSafe(F.lit(motivo))
    if desde is not None:
        cae = cae & F.coalesce(F.col("fecha") >= F.lit(desde).cast("date"), F.lit(False))
    if hasta is not None:
        cae = cae & F.coalesce(F.col("fecha") <= F.lit(hasta).cast("date"), F.lit(False))
    if audiologos is None:
        return bloqueos.filter(~cae)
    quienes = claves_distintas(
        audiologos.select(F.col("audiologo_id").alias("_quien")), ["_quien"]
    )
    return bloqueos.join(quienes, (F.col("audiologo_id") == F.col("_quien")) & cae, "left_anti")


# ---- Sites and professionals ----


def reactivar_sedes(sedes: DataFrame, patrones: list[str]) -> DataFrame:
    """Turns on the sites whose name matches any pattern, case ignored and accents significant."""
    coincide = F.lit(False)
    for patron in patrones:
        coincide = coincide | F.col("nombre").ilike(patron)
    return sedes.withColumn(
        "activa", F.when(coincide, F.lit(True)).otherwise(F.col("activa"))
    )


def renombrar(audiologos: DataFrame, mapa: dict[str, str]) -> DataFrame:
    """New name for every professional whose name is in the map."""
    pares = F.create_map(*[F.lit(v) for par in mapa.items() for v in par])
    return audiologos.withColumn(
        "nombre", F.coalesce(F.try_element_at(pares, F.col("nombre")), F.col("nombre"))
    )


def agregar_columna(df: DataFrame, nombre: str, tipo: T.DataType | str) -> DataFrame:
    """Adds a nullable column unless it is there already."""
    return df if nombre in df.columns else df.withColumn(nombre, F.lit(None).cast(tipo))


def cargar_catalogo(
    sedes: DataFrame, audiologos: DataFrame, sedes_nuevas: DataFrame,
    audiologos_nuevos: DataFrame, lote: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Adds sites (``nombre, ciudad``), then professionals (``nombre, sede, especialidad``).

    Professionals find their site by name; one whose site name is unknown is not added, and one
    whose site name is shared is added for each.
    """
    con_nuevas = anexar(sedes, sedes_nuevas, "sedes", f"{lote}/sedes")
    ids = con_nuevas.select(F.col("nombre").alias("sede"), F.col("id").alias("sede_id"))
    filas = audiologos_nuevos.join(ids, "sede").drop("sede")
    return con_nuevas, anexar(
        audiologos.withColumn("sede_id", F.col("sede_id").cast("string")), filas,
        "audiologos", f"{lote}/audiologos",
    )
