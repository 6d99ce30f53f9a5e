"""Booking requests as a stream.

Each micro-batch is one bulk booking against the tables as the earlier batches left them.  What a
batch adds is kept in four parts, each under a folder of this attempt's own (``intento=<id>``):

* ``decisiones``: every request with its reason, null when accepted;
* ``novedades``: per phone of the accepted requests, what it adds or changes;
* ``citas``: the new appointments, by month when the table has months;
* ``pacientes``: the new or changed patients, whole rows.

One row in ``lotes``, written when all four are complete, makes the batch count: it lists the attempts that
are alive from then on, and readers take the last row's and no others.  A batch that broke off half-way is as
if it had never been.  Each row also says how far every streaming query (its id lasts as long as its
checkpoint) has come, so a batch run again is skipped, and a new checkpoint over the same folder goes on from
what the earlier ones booked.  Nothing is ever overwritten.  Late requests are simply later in order; there is
no event-time rule.  One query at a time may write to a folder.

Compaction.  ``JUNTAR`` attempts of one level are merged into one of the next, with a row in ``lotes`` of
their own: readers see either the batches or the merged attempt.  So the attempts a batch has to read, and the
files in them, grow with the logarithm of the number of batches.  Merged patients keep their last version only.

Delivered twice.  ``solicitud_id`` names a request.  Within a batch its first arrival is decided, and a request
that an earlier batch decided is not decided again.  The ids are looked up among all committed decisions: a
watermark would bound that, but it would drop requests that are later than it.
"""

from __future__ import annotations

import dataclasses
import uuid
from concurrent.futures import Future

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from turnero.operators.reservas import (
    Estado, aceptar, aplicar_novedades, citas_de, completar_opcionales, decidir,
    novedades_pacientes, primeras,
)
from turnero.sources.tablas import claves_distintas, con_mes, con_valores_por_defecto

VIVO = T.StructType([
    T.StructField("intento", T.StringType()), T.StructField("nivel", T.IntegerType()),
])
LOTES = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("corrida", T.StringType()),
    T.StructField("lote", T.LongType()), T.StructField("intento", T.StringType()),
    T.StructField("vivos", T.ArrayType(VIVO)),
    T.StructField("avance", T.MapType(T.StringType(), T.LongType())),
])
PARTES = ["decisiones", "novedades", "citas", "pacientes"]
# Attempts of one level that are merged into one of the next.
JUNTAR = 8
# Commit rows in one folder: a reader lists the folders and then the last one only.
TRAMO = 64


@dataclasses.dataclass
class Confirmado:
    """The last commit row: version, attempts alive as (name, level) in order, last batch of every query."""

    version: int
    vivos: list[tuple[str, int]]
    avance: dict[str, int]


def _ruta(spark: SparkSession, ruta: str):
    camino = spark._jvm.org.apache.hadoop.fs.Path(ruta)
    return camino.getFileSystem(spark._jsc.hadoopConfiguration()), camino


def lotes(spark: SparkSession, carpeta: str) -> DataFrame:
    """The batches that count, one row each; none before the first."""
    try:
        return spark.read.schema(LOTES).parquet(f"{carpeta}/lotes").filter(F.col("lote").isNotNull())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOTES)


def confirmado(spark: SparkSession, carpeta: str) -> Confirmado:
    """What the last commit row says."""
    fs, camino = _ruta(spark, f"{carpeta}/lotes")
    if not fs.exists(camino):
        return Confirmado(0, [], {})
    tramos = [e.getPath().getName() for e in fs.listStatus(camino) if e.isDirectory()]
    for tramo in sorted((t for t in tramos if t.startswith("tramo=")), key=lambda t: -int(t[6:])):
        filas = spark.read.schema(LOTES).parquet(f"{carpeta}/lotes/{tramo}").orderBy(F.desc("version")).limit(1).collect()
        if filas:
            f = filas[0]
            return Confirmado(f["version"], [(v["intento"], v["nivel"]) for v in f["vivos"]], dict(f["avance"]))
    return Confirmado(0, [], {})


def _confirmar(
    spark: SparkSession, carpeta: str, nuevo: Confirmado, corrida: str | None, lote: int | None, intento: str,
) -> None:
    fila = spark.createDataFrame([(nuevo.version, corrida, lote, intento, nuevo.vivos, nuevo.avance)], LOTES)
    fila.coalesce(1).write.mode("append").parquet(f"{carpeta}/lotes/tramo={nuevo.version // TRAMO}")


def _guardar(df: DataFrame, carpeta: str, nombre: str, intento: str) -> None:
    escritor = df.write.partitionBy("mes") if "mes" in df.columns else df.write
    escritor.parquet(f"{carpeta}/{nombre}/intento={intento}")


def _escribir(df: DataFrame, carpeta: str, nombre: str, intento: str) -> DataFrame:
    """Writes one part of a batch and reads it back, which also cuts its lineage."""
    _guardar(df, carpeta, nombre, intento)
    return _leer(df.sparkSession, carpeta, nombre, df.schema, [intento])


def _leer(spark: SparkSession, carpeta: str, nombre: str, esquema: T.StructType, intentos: list[str]) -> DataFrame:
    """One part of the given attempts; other folders are not even listed."""
    if not intentos:
        return spark.createDataFrame([], esquema)
    rutas = [f"{carpeta}/{nombre}/intento={i}" for i in intentos]
    con_intento = T.StructType([*esquema.fields, T.StructField("intento", T.StringType())])
    df = spark.read.schema(con_intento).option("basePath", f"{carpeta}/{nombre}").parquet(*rutas)
    return df.select(*esquema.names)


def _parte(spark: SparkSession, carpeta: str, nombre: str, esquema: T.StructType) -> DataFrame:
    """One part of all attempts that count."""
    return _leer(spark, carpeta, nombre, esquema, [i for i, _ in confirmado(spark, carpeta).vivos])


def _con_orden(esquema: T.StructType) -> T.StructType:
    """Patients are kept with ``orden``, the version that wrote them."""
    return T.StructType([*esquema.fields, T.StructField("orden", T.LongType())])


def _ultimos(pacientes: DataFrame) -> DataFrame:
    """Each patient as the last attempt left it."""
    return primeras(pacientes, ["id"], [F.desc("orden")])


def compactar(spark: SparkSession, carpeta: str, partes: dict[str, T.StructType], juntar: int = JUNTAR) -> None:
    """Merges the last attempts of a level while there are ``juntar`` of them, lowest level first.

    ``partes`` has the schema of every part, patients with ``orden``.
    """
    while True:
        c = confirmado(spark, carpeta)
        if not c.vivos:
            return
        # Newer attempts have lower levels, so those of the lowest level are the last ones.
        nivel = min(n for _, n in c.vivos)
        grupo = [i for i, n in c.vivos if n == nivel]
        if len(grupo) < juntar:
            return
        intento = uuid.uuid4().hex
        for nombre, esquema in partes.items():
            df = _leer(spark, carpeta, nombre, esquema, grupo)
            if nombre == "pacientes":
                df = _ultimos(df)
            orden = [x for x in ("mes", "fecha", "audiologo_id", "solicitud_id", "telefono", "id") if x in df.columns][:3]
            df = df.repartitionByRange(*orden).sortWithinPartitions(*orden)
            _guardar(df, carpeta, nombre, intento)
        vivos = [(i, n) for i, n in c.vivos if n != nivel] + [(intento, nivel + 1)]
        _confirmar(spark, carpeta, Confirmado(c.version + 1, vivos, c.avance), None, None, intento)


def _esquemas(estado: Estado) -> Estado:
    """The same tables with text ids, as they are after a booking."""
    return dataclasses.replace(
        estado,
        citas=estado.citas.withColumns(
            {c: F.col(c).cast("string") for c in ("id", "paciente_id")}
        ),
        pacientes=estado.pacientes.withColumn("id", F.col("id").cast("string")),
    )


def estado_en(spark: SparkSession, base: Estado, carpeta: str) -> Estado:
    """The tables with what all batches added; a patient changed by several is as the last left it."""
    base = _esquemas(base)
    citas = _parte(spark, carpeta, "citas", base.citas.schema)
    ultimos = _ultimos(_parte(spark, carpeta, "pacientes", _con_orden(base.pacientes.schema))).drop("orden")
    sin_cambio = base.pacientes.join(claves_distintas(ultimos, ["id"]), "id", "left_anti")
    return dataclasses.replace(
        base,
        citas=base.citas.unionByName(citas),
        pacientes=sin_cambio.unionByName(ultimos),
    )


def procesar_lote(
    solicitudes: DataFrame, batch_id: int, base: Estado, carpeta: str,
    ahora: Column | None = None, corrida: str = "", juntar: int = JUNTAR,
) -> None:
    """Decides one micro-batch of the query ``corrida`` and writes what it adds."""
    spark = solicitudes.sparkSession
    antes = confirmado(spark, carpeta)
    if batch_id <= antes.avance.get(corrida, -1):
        return
    intento, orden = uuid.uuid4().hex, antes.version + 1
    estado = estado_en(spark, base, carpeta)
    lote = completar_opcionales(solicitudes)
    campos = T.StructType([*lote.schema.fields, T.StructField("motivo_rechazo", T.StringType())])
    hechas = _leer(spark, carpeta, "decisiones", campos, [i for i, _ in antes.vivos])
    nuevas_solicitudes = lote.join(claves_distintas(hechas, ["solicitud_id"]), "solicitud_id", "left_anti").select(*lote.columns)
    decididas = _escribir(decidir(nuevas_solicitudes, estado), carpeta, "decisiones", intento)
    ok = decididas.filter(F.col("motivo_rechazo").isNull()).drop("motivo_rechazo")

    novedades = _escribir(
        novedades_pacientes(estado.pacientes, ok), carpeta, "novedades", intento
    )
    conocidos = estado.pacientes.join(
        novedades.select(F.col("paciente_id").alias("id")), "id", "left_semi"
    )
    pacientes = _escribir(
        aplicar_novedades(conocidos, novedades, ahora).withColumn("orden", F.lit(orden).cast("long")),
        carpeta, "pacientes", intento,
    )
    nuevas = con_valores_por_defecto(
        citas_de(aceptar(ok, estado, novedades)), "citas",
        F.current_timestamp() if ahora is None else ahora,
    )
    if "mes" in estado.citas.columns:
        nuevas = con_mes(nuevas)
    faltan = {
        f.name: F.lit(None).cast(f.dataType)
        for f in estado.citas.schema if f.name not in nuevas.columns
    }
    nuevas = nuevas.withColumns(faltan) if faltan else nuevas
    tipos = {f.name: f.dataType for f in estado.citas.schema}
    citas = _escribir(
        nuevas.select(*[F.col(c).cast(t).alias(c) for c, t in tipos.items()]),
        carpeta, "citas", intento,
    )
    nuevo = Confirmado(orden, [*antes.vivos, (intento, 0)], {**antes.avance, corrida: batch_id})
    _confirmar(spark, carpeta, nuevo, corrida, batch_id, intento)
    partes = zip(PARTES, (decididas, novedades, citas, pacientes))
    compactar(spark, carpeta, {n: df.schema for n, df in partes}, juntar)


def reservas_stream(
    fuente: DataFrame, base: Estado, carpeta: str, checkpoint: str,
    ahora: Column | None = None,
) -> StreamingQuery:
    """Starts the intake of a streaming DataFrame of requests and handles all there is.

    ``carpeta`` and ``checkpoint`` must be in storage every executor reaches.
    """
    corrida: Future[str] = Future()  # known once the query has started
    consulta = (
        fuente.writeStream
        .foreachBatch(lambda df, i: procesar_lote(df, i, base, carpeta, ahora, corrida.result()))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    corrida.set_result(str(consulta.id))
    return consulta


def decisiones(spark: SparkSession, carpeta: str, esquema: T.StructType) -> DataFrame:
    """Every request decided so far; ``esquema`` is that of the requests."""
    campos = T.StructType([*esquema.fields, T.StructField("motivo_rechazo", T.StringType())])
    return _parte(spark, carpeta, "decisiones", campos)
