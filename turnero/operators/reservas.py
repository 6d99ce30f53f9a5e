"""Booking requests, decided in bulk.

A batch gives the same result as its requests one by one in order of arrival: a request is accepted
when no active appointment holds its professional, date and start and no earlier valid request of
the batch asked for it.  Rejected requests are data, each with its reason, and leave no trace in the
tables: patients are created or updated only for accepted ones.

How it scales.  A batch is usually small beside the stored tables, so those are narrowed to its
keys after a map-side reduction.
The winner of a contested slot comes from a filtered ``row_number``, which Spark limits per group
before the shuffle, and the loser is whoever is not among the winners, so a slot wanted by a third
of all requests never gathers them in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnero.functions.texto import acciones, activa
from turnero.functions.tiempo import dow, hms, seg
from turnero.functions.valores import DURACION_POR_DEFECTO, ESTADOS
from turnero.operators.en_orden import decidir_en_orden, estado_actual
from turnero.operators.numeracion import por_turno
from turnero.sources.tablas import (
    con_valores_por_defecto, en_fechas_de, materializar, reducir_a, unir,
)

DIA = ["audiologo_id", "fecha"]
LLEGADA = ["recibida_en", "solicitud_id"]


@dataclass
class Estado:
    """Tables a booking reads and changes."""

    citas: DataFrame
    pacientes: DataFrame
    audiologos: DataFrame
    sedes: DataFrame
    horarios_fecha: DataFrame
    horarios_disponibles: DataFrame


@dataclass
class Resultado:
    """Outcome of a batch.  The decisions are fixed already; the parts are lazy."""

    aceptadas: DataFrame
    rechazadas: DataFrame
    pacientes: DataFrame
    citas: DataFrame


def id_estable(prefijo: str, *columnas) -> Column:
    """Generated id that a retried task computes again with the same value."""
    partes = [F.col(c).cast("string") if isinstance(c, str) else c for c in columnas]
    return F.sha2(F.concat_ws("|", F.lit(prefijo), *partes), 256)


# ---- Validity ----


def marcar_existente(df: DataFrame, clave: str, padre: DataFrame, marca: str) -> DataFrame:
    ids = padre.select(F.col("id").alias(clave), F.lit(True).alias(marca))
    return df.join(ids, clave, "left")


def validar_solicitudes(
    solicitudes: DataFrame, audiologos: DataFrame, sedes: DataFrame
) -> DataFrame:
    """Adds ``motivo_rechazo``: why a request cannot be stored at all, or null.

    Id, name, phone, date and start are required.  Professional and site may be null but must exist.
    """
    df = marcar_existente(solicitudes, "audiologo_id", audiologos, "_a")
    df = marcar_existente(df, "sede_id", sedes, "_s")
    motivo = (
        F.when(F.col("solicitud_id").isNull(), "falta_id")
        .when(F.col("nombre").isNull(), "falta_nombre")
        .when(F.col("telefono").isNull(), "falta_telefono")
        .when(F.col("fecha").isNull(), "falta_fecha")
        .when(seg("hora_inicio").isNull(), "falta_hora")
        .when(F.col("audiologo_id").isNotNull() & F.col("_a").isNull(), "audiologo_desconocido")
        .when(F.col("sede_id").isNotNull() & F.col("_s").isNull(), "sede_desconocida")
    )
    return df.withColumn("motivo_rechazo", motivo).select(*solicitudes.columns, "motivo_rechazo")


# ---- Duration ----


def _primera_duracion(horario: DataFrame, clave: list[str], nombre: str) -> DataFrame:
    """Slot length of the first row per key (least start, end, length); it may be null."""
    fila = F.struct("hora_inicio", "hora_fin", "duracion_cita_min")
    return horario.groupBy(*clave).agg(F.min(fila)["duracion_cita_min"].alias(nombre))


def resolver_duracion(
    solicitudes: DataFrame, horarios_fecha: DataFrame, horarios_disponibles: DataFrame,
) -> DataFrame:
    """Adds ``duracion``: of the dated row, else of the weekly row, else the default.

    Only the first row of a key is asked; when its length is null the next level decides.
    """
    de_fecha = reducir_a(
        en_fechas_de(horarios_fecha, solicitudes), solicitudes, DIA,
        lambda h: _primera_duracion(h, DIA, "_dur_fecha"),
    )
    semanal = reducir_a(
        horarios_disponibles, solicitudes, ["audiologo_id"],
        lambda h: _primera_duracion(h, ["audiologo_id", "dia_semana"], "_dur_semana"),
    )
    # Without a professional there is no schedule to ask, and no key to gather such requests by.
    con_profesional = F.col("audiologo_id").isNotNull()
    por_defecto = F.lit(DURACION_POR_DEFECTO)
    return (
        solicitudes.filter(con_profesional).join(de_fecha, DIA, "left")
        .withColumn("dia_semana", dow("fecha"))
        .join(semanal, ["audiologo_id", "dia_semana"], "left")
        .withColumn("duracion", F.coalesce("_dur_fecha", "_dur_semana", por_defecto))
        .select(*solicitudes.columns, "duracion")
        .unionByName(
            solicitudes.filter(~con_profesional).withColumn("duracion", por_defecto)
        )
    )


# ---- Slots taken and first come ----


def claves_tomadas(citas: DataFrame, claves: DataFrame) -> DataFrame:
    """Which of the ``claves`` (professional, date, ``ini``) an active appointment holds."""
    clave = [*DIA, "ini"]
    activas = (
        en_fechas_de(citas, claves).filter(activa() & F.col("audiologo_id").isNotNull())
        .select(*DIA, seg("hora_inicio").alias("ini"))
    )
    return reducir_a(activas, claves, clave, DataFrame.distinct)


def primeras(df: DataFrame, clave: list[str], orden: list) -> DataFrame:
    """First row of each key in the given order."""
    w = Window.partitionBy(*clave).orderBy(*orden)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def con_turno(
    candidatas: DataFrame, citas: DataFrame, orden: list[str], lote: DataFrame | None = None
) -> DataFrame:
    """The candidates that get their slot; those without a professional always do.

    ``lote``, a cheaper superset of the candidates, is used to narrow the appointments.
    """
    lote = candidatas if lote is None else lote
    candidatas = candidatas.withColumn("ini", seg("hora_inicio"))
    con_clave = candidatas.filter(F.col("audiologo_id").isNotNull())
    ganadoras = primeras(con_clave, [*DIA, "ini"], orden)
    tomadas = claves_tomadas(
        citas, lote.select(*DIA, seg("hora_inicio").alias("ini"))
    )
    return (
        ganadoras.join(tomadas, [*DIA, "ini"], "left_anti")
        .unionByName(candidatas.filter(F.col("audiologo_id").isNull()))
        .drop("ini")
    )


# ---- Patients ----


def paciente_por_telefono(
    pacientes: DataFrame, solicitudes: DataFrame,
) -> DataFrame:
    """One patient per phone of the requests: the least (``creado_en``, ``id``) that has it."""
    orden = F.struct(*[c for c in ("creado_en", "id") if c in pacientes.columns])

    def primero(df: DataFrame) -> DataFrame:
        return df.groupBy("telefono").agg(
            F.min_by("id", orden).cast("string").alias("paciente_id")
        )

    con_telefono = pacientes.filter(F.col("telefono").isNotNull())
    return reducir_a(con_telefono, solicitudes, ["telefono"], primero)


def lookup_paciente(pacientes: DataFrame, solicitudes: DataFrame) -> DataFrame:
    """Requests with the id of the stored patient of their phone, or null."""
    return solicitudes.join(paciente_por_telefono(pacientes, solicitudes), "telefono", "left")


def novedades_pacientes(
    pacientes: DataFrame, aceptadas: DataFrame,
) -> DataFrame:
    """Per phone of the accepted requests: patient id, whether it is new, newest values.

    The newest name wins; the newest e-mail and insurer that are not null win.
    """
    orden = F.struct(*LLEGADA)

    def ultimo(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), orden)).alias(f"{c}_nuevo")

    por_telefono = aceptadas.groupBy("telefono").agg(
        F.max_by("nombre", orden).alias("nombre_nuevo"), ultimo("email"), ultimo("eps")
    )
    conocidos = paciente_por_telefono(pacientes, aceptadas)
    return (
        por_telefono.join(conocidos, "telefono", "left")
        .withColumn("es_nuevo", F.col("paciente_id").isNull())
        .withColumn(
            "paciente_id", F.coalesce("paciente_id", id_estable("paciente", "telefono"))
        )
    )


def aplicar_novedades(
    pacientes: DataFrame, novedades: DataFrame, ahora: Column | None = None
) -> DataFrame:
    """Patients after the changes: updated in place by id, new ones added."""
    cambios = novedades.filter(~F.col("es_nuevo")).select(
        F.col("paciente_id").alias("id"), "nombre_nuevo", "email_nuevo", "eps_nuevo",
        F.lit(True).alias("_cambia"),
    )
    actualizados = (
        pacientes.withColumn("id", F.col("id").cast("string")).join(cambios, "id", "left")
        .withColumn(
            "nombre", F.when(F.col("_cambia"), F.col("nombre_nuevo")).otherwise(F.col("nombre"))
        )
        .withColumn("email", F.coalesce("email_nuevo", "email"))
        .withColumn("eps", F.coalesce("eps_nuevo", "eps"))
        .select(*pacientes.columns)
    )
    nuevos = novedades.filter("es_nuevo").select(
        F.col("paciente_id").alias("id"), F.col("nombre_nuevo").alias("nombre"), "telefono",
        F.col("email_nuevo").alias("email"), F.col("eps_nuevo").alias("eps"),
    )
    return agregar(actualizados, nuevos, "pacientes", ahora)


def agregar(tabla: DataFrame, nuevas: DataFrame, nombre: str, ahora: Column | None) -> DataFrame:
    """Adds rows with the defaults of the columns the table has."""
    ahora = F.current_timestamp() if ahora is None else ahora
    con_todo = con_valores_por_defecto(nuevas, nombre, ahora)
    return unir(tabla, con_todo.select([c for c in con_todo.columns if c in tabla.columns]))


def upsert_pacientes(
    pacientes: DataFrame, aceptadas: DataFrame, ahora: Column | None = None
) -> DataFrame:
    """Patients after the accepted requests."""
    return aplicar_novedades(pacientes, novedades_pacientes(pacientes, aceptadas), ahora)


# ---- The whole batch ----


def primera_entrega(solicitudes: DataFrame) -> DataFrame:
    """One row per request: the first that arrived; a delivery repeated later is no new request.

    Only ids that repeat are ordered, and Spark limits that per group before the shuffle.  A row without id
    cannot be told from another and stays.
    """
    con_id = solicitudes.filter(F.col("solicitud_id").isNotNull())
    resto = [F.col(c) for c, t in solicitudes.dtypes if c not in LLEGADA and not t.startswith("map")]
    return primeras(con_id, ["solicitud_id"], [F.col("recibida_en"), *resto]).unionByName(
        solicitudes.filter(F.col("solicitud_id").isNull()))


def decidir(solicitudes: DataFrame, estado: Estado) -> DataFrame:
    """Every request with ``motivo_rechazo``: null when accepted.

    A request delivered more than once is decided once, as it first arrived.  The accepted ones are found by
    slot and the rest follow by request id, so no step groups all requests of a contested slot.  The reviewed
    batch is written once and read by the three branches that need it.
    """
    revisadas = materializar(
        validar_solicitudes(primera_entrega(solicitudes), estado.audiologos, estado.sedes), "revisadas"
    )
    validas = revisadas.filter(F.col("motivo_rechazo").isNull())
    ganadoras = con_turno(
        validas.select(*LLEGADA, *DIA, "hora_inicio"), estado.citas, LLEGADA, revisadas
    ).select("solicitud_id", F.lit(True).alias("_gana"))
    return (
        revisadas.join(ganadoras, "solicitud_id", "left")
        .withColumn(
            "motivo_rechazo",
            F.coalesce(
                "motivo_rechazo",
                F.when(F.col("_gana").isNull(), F.lit("horario_tomado")),
            ),
        )
        .drop("_gana")
    )


def aceptar(
    aceptadas: DataFrame, estado: Estado, novedades: DataFrame,
) -> DataFrame:
    """Accepted requests with appointment id, patient id, duration and end."""
    ids = novedades.select("telefono", "paciente_id")
    return (
        resolver_duracion(
            aceptadas, estado.horarios_fecha, estado.horarios_disponibles
        )
        .join(ids, "telefono", "left")
        .withColumn("cita_id", id_estable("cita", "solicitud_id"))
        .withColumn("hora_fin", hms(seg("hora_inicio") + F.col("duracion") * 60))
        .withColumn("hora_inicio", hms(seg("hora_inicio")))
    )


def citas_de(aceptadas: DataFrame) -> DataFrame:
    """Accepted requests as appointment rows."""
    return aceptadas.select(
        F.col("cita_id").alias("id"), "paciente_id", "audiologo_id", "sede_id", "fecha",
        "hora_inicio", "hora_fin", F.col("motivo").alias("motivo_consulta"),
        F.lit("pendiente").alias("estado"),
    )


def ids_texto(citas: DataFrame) -> DataFrame:
    return citas.withColumns({c: F.col(c).cast("string") for c in ("id", "paciente_id")})


def completar_opcionales(solicitudes: DataFrame) -> DataFrame:
    """Optional request columns that are absent count as null: the shorter call form."""
    faltan = {c: F.lit(None).cast("string") for c in ("motivo", "email", "eps")
              if c not in solicitudes.columns}
    return solicitudes.withColumns(faltan) if faltan else solicitudes


def reservar(
    solicitudes: DataFrame, estado: Estado, ahora: Column | None = None
) -> Resultado:
    """Decides a batch of requests and gives the tables after it.

    Schedules, blocks and overlaps are not looked at: only an equal professional, date and start
    makes a conflict.  ``solicitud_id`` names a request: delivered twice, it is decided once.  The call runs
    the job that decides, so that appointments and patients follow from the same decisions.
    """
    lote = completar_opcionales(solicitudes)
    decididas = materializar(decidir(lote, estado), "decisiones")
    ok = decididas.filter(F.col("motivo_rechazo").isNull()).drop("motivo_rechazo")
    novedades = materializar(novedades_pacientes(estado.pacientes, ok), "novedades")
    aceptadas = aceptar(ok, estado, novedades)
    return Resultado(
        aceptadas=aceptadas,
        rechazadas=decididas.filter(F.col("motivo_rechazo").isNotNull()),
        pacientes=aplicar_novedades(estado.pacientes, novedades, ahora),
        citas=agregar(ids_texto(estado.citas), citas_de(aceptadas), "citas", ahora),
    )


# ---- Changes of stored appointments ----


def marcar_actualizado(df: DataFrame, ahora: Column, cambia: Column) -> DataFrame:
    """Stamps ``actualizado_en`` on the rows that change, when the table has the column."""
    if "actualizado_en" not in df.columns:
        return df
    return df.withColumn(
        "actualizado_en", F.when(cambia, ahora).otherwise(F.col("actualizado_en"))
    )


def con_acciones(citas: DataFrame) -> DataFrame:
    """Adds the actions allowed in each appointment's state."""
    return citas.withColumn("acciones", acciones("estado"))


def revisar_cambios_estado(citas: DataFrame, cambios: DataFrame) -> DataFrame:
    """Every change with ``motivo_rechazo``, null when it holds at the end.

    ``cambios`` has ``id``, ``estado`` and ``orden``; changes are decided one by one in that order (equal ones
    by id and state).  An unknown state or appointment never applies, and reviving an appointment is refused
    while another active one holds its slot.  A change that applied and was followed by another of the same
    appointment that applied is ``reemplazado``.
    """
    todos = cambios.select("id", F.col("estado").alias("nuevo"), "orden")
    con_turno = por_turno(todos, [F.col("orden"), F.col("id"), F.col("nuevo")])
    actuales = estado_actual(citas, con_turno)
    existen = actuales.select("id", F.lit(True).alias("_existe"))
    revisados = materializar(
        con_turno.join(existen, "id", "left").withColumn(
            "_motivo",
            F.when(~F.coalesce(F.col("nuevo").isin(ESTADOS), F.lit(False)), "estado_invalido")
            .when(F.col("_existe").isNull(), "cita_desconocida"),
        ).drop("_existe"), "cambios",
    )
    validos = revisados.filter(F.col("_motivo").isNull())
    dichos = materializar(decidir_en_orden(citas, validos.select(
        "t", "id", activa("nuevo").alias("activa")), actuales), "dichos")
    return con_motivo(revisados, dichos).select("id", "nuevo", "motivo_rechazo")


def con_motivo(revisados: DataFrame, dichos: DataFrame) -> DataFrame:
    """Changes (``t``, ``id``, ``_motivo``) with the outcome of ``decidir_en_orden`` as ``motivo_rechazo``."""
    juntos = revisados.join(dichos, "t", "left")
    ultimos = juntos.filter("aplica").groupBy("id").agg(F.max("t").alias("t")).select("t", F.lit(True).alias("_ultimo"))
    return juntos.join(ultimos, "t", "left").withColumn(
        "motivo_rechazo",
        F.coalesce("_motivo", F.when(~F.col("aplica"), "horario_tomado")
                   .when(F.col("_ultimo").isNull(), "reemplazado")),
    ).drop("_motivo", "aplica", "_ultimo")


def cambiar_estado(
    citas: DataFrame, cambios: DataFrame, ahora: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Appointments after the state changes, and the changes that were refused or replaced."""
    ahora = F.current_timestamp() if ahora is None else ahora
    revisados = materializar(revisar_cambios_estado(citas, cambios), "cambios")
    aplican = revisados.filter(F.col("motivo_rechazo").isNull()).select("id", "nuevo")
    despues = citas.join(aplican, "id", "left").withColumn(
        "estado", F.coalesce("nuevo", "estado")
    )
    despues = marcar_actualizado(despues, ahora, F.col("nuevo").isNotNull())
    return (
        despues.select(*citas.columns),
        revisados.filter(F.col("motivo_rechazo").isNotNull()),
    )
