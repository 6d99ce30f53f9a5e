"""Appointments entered or edited by staff.

Staff entry differs from a booking request: all four form fields are required, a known patient is
left as stored, a new patient stays even when the slot turns out to be taken, and an appointment
lasts the default time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnero.functions.texto import activa, presente, vacio_a_nulo
from turnero.functions.tiempo import hms, seg
from turnero.functions.valores import DURACION_POR_DEFECTO
from turnero.operators.en_orden import decidir_en_orden, estado_actual, hueco
from turnero.operators.numeracion import por_turno
from turnero.operators.reservas import (
    Estado, Resultado, agregar, con_motivo, id_estable, ids_texto, marcar_actualizado, marcar_existente,
)
from turnero.sources.tablas import con_mes, materializar, reducir_a

CAMPOS = ["sede_id", "audiologo_id", "nombre", "telefono"]
DATOS = [
    "paciente_id", "audiologo_id", "sede_id", "fecha", "hora_inicio", "hora_fin",
    "motivo_consulta", "notas",
]


def form_valida() -> Column:
    """Site, professional, name and phone are all filled in."""
    condicion = presente(CAMPOS[0])
    for campo in CAMPOS[1:]:
        condicion = condicion & presente(campo)
    return condicion


def separar_validas(solicitudes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete forms and incomplete ones."""
    return solicitudes.filter(form_valida()), solicitudes.filter(~form_valida())


def revisar_ediciones(citas: DataFrame, cambios: DataFrame) -> DataFrame:
    """Every edit with ``motivo_rechazo``, null when its values are those that hold at the end.

    Edits are decided one by one by ``orden`` (equal ones by id).  An edit of an active appointment is refused
    while another active appointment holds the new slot; an edit that applied and was followed by another of
    the same appointment that applied is ``reemplazado``.  ``cambios`` has ``id``, ``orden`` and the new values; rows
    with ``alta`` true are new appointments, which take part in the same order.  Only the columns that decide move from
    step to step; the edits stay as written (``con_fila``) and take their outcome by row at the end.
    """
    if "alta" not in cambios.columns:
        cambios = cambios.withColumn("alta", F.lit(False))
    filas = cambios if "_fila" in cambios.columns else con_fila(cambios, "ediciones")
    con_turno = por_turno(
        filas.select("_fila", "id", "orden", "alta", "audiologo_id", "fecha", "hora_inicio"), [F.col("orden"), F.col("id")])
    actuales = estado_actual(citas, con_turno)
    existen = actuales.select("id", F.lit(True).alias("_existe"))
    revisados = materializar(
        con_turno.select("t", "_fila", "id", "alta", hueco().alias("hueco")).join(existen, "id", "left").withColumn(
            "_motivo", F.when(F.col("_existe").isNull() & ~F.col("alta"), "cita_desconocida")).drop("_existe"),
        "revisados",
    )
    dichos = materializar(decidir_en_orden(citas, revisados.filter(F.col("_motivo").isNull()).select(
        "t", "id", F.lit(True).alias("mueve"), "hueco", F.when(F.col("alta"), True).alias("activa")), actuales), "dichos")
    resueltos = materializar(con_motivo(revisados, dichos).select("_fila", "motivo_rechazo"), "resueltos")
    return filas.join(resueltos, "_fila").drop("_fila")


def con_fila(cambios: DataFrame, nombre: str) -> DataFrame:
    """Writes the rows with ``_fila``, by which each is found again, and reads them back."""
    return materializar(cambios.withColumn("_fila", F.monotonically_increasing_id()), nombre)


def normalizar_ediciones(cambios: DataFrame) -> DataFrame:
    """Edits as they are stored: the end is the start plus the default time, empty texts are null.

    The start is ``hora_inicio``, or ``_ini`` in seconds where it was read already.
    """
    if "_ini" not in cambios.columns:
        cambios = cambios.withColumn("_ini", seg("hora_inicio"))
    return (
        cambios.withColumn("hora_fin", hms(F.col("_ini") + DURACION_POR_DEFECTO * 60))
        .withColumn("hora_inicio", hms("_ini")).drop("_ini")
        .withColumn("motivo_consulta", vacio_a_nulo("motivo_consulta"))
        .withColumn("notas", vacio_a_nulo("notas"))
    )


def citas_editadas(citas: DataFrame, aplican: DataFrame, ahora: Column | None = None) -> DataFrame:
    """Only the appointments that the edits change, as they are after them: a delta to store by month."""
    ahora = F.current_timestamp() if ahora is None else ahora
    datos = [c for c in DATOS if c in citas.columns]
    nuevos = aplican.select("id", F.struct(*datos).alias("_n"))
    despues = citas.join(nuevos, "id").withColumns({c: F.col("_n")[c] for c in datos})
    if "mes" in citas.columns:
        despues = con_mes(despues)
    return marcar_actualizado(despues, ahora, F.lit(True)).select(*citas.columns)


def editar(
    citas: DataFrame, cambios: DataFrame, ahora: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Appointments after the edits, and the edits that were refused or replaced.

    An edit replaces patient, professional, site, date, start, reason and notes; the end becomes
    the start plus the default time and the state stays.
    """
    revisados = revisar_ediciones(citas, normalizar_ediciones(cambios)).drop("alta")
    aplican = revisados.filter(F.col("motivo_rechazo").isNull())
    return (
        con_ediciones(citas, aplican, ahora),
        revisados.filter(F.col("motivo_rechazo").isNotNull()),
    )


def con_ediciones(citas: DataFrame, aplican: DataFrame, ahora: Column | None = None) -> DataFrame:
    """All appointments after the edits; the table is gone through once."""
    ahora = F.current_timestamp() if ahora is None else ahora
    datos = [c for c in DATOS if c in citas.columns]
    nuevos = aplican.select("id", F.struct(*datos).alias("_n"))
    cambia = F.col("_n").isNotNull()
    despues = citas.join(nuevos, "id", "left").withColumns(
        {c: F.when(cambia, F.col("_n")[c]).otherwise(F.col(c)) for c in datos})
    if "mes" in citas.columns:
        despues = despues.withColumn("mes", F.when(cambia, F.date_format("fecha", "yyyy-MM")).otherwise(F.col("mes")))
    return marcar_actualizado(despues, ahora, cambia).select(*citas.columns)


def pacientes_del_panel(
    pacientes: DataFrame, validas: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Forms with their patient id, and the patients to create.

    A phone with exactly one stored patient gives that patient.  An unknown phone gets one new
    patient, named by the first form.  A phone with several stored patients finds none of them, so
    each of its forms gets a new patient.
    """
    def contar(df: DataFrame) -> DataFrame:
        return df.groupBy("telefono").agg(
            F.count(F.lit(1)).alias("_n"), F.min("id").cast("string").alias("_id")
        )

    conocidos = reducir_a(pacientes, validas, ["telefono"], contar)
    propio = id_estable("paciente-panel", "solicitud_id")
    comun = id_estable("paciente", "telefono")
    con_id = (
        validas.join(conocidos, "telefono", "left")
        .withColumn(
            "paciente_id",
            F.when(F.col("_n").isNull(), comun).when(F.col("_n") == 1, F.col("_id"))
            .otherwise(propio),
        )
        .withColumn("_nuevo", F.coalesce(F.col("_n") != 1, F.lit(True)))
    )
    nuevos = con_id.filter("_nuevo").groupBy("paciente_id", "telefono").agg(
        F.min_by("nombre", F.struct("recibida_en", "solicitud_id")).alias("nombre")
    ).select(F.col("paciente_id").alias("id"), "nombre", "telefono")
    return con_id.drop("_n", "_id", "_nuevo"), nuevos


def guardar_panel(
    ediciones: DataFrame, estado: Estado, ahora: Column | None = None
) -> Resultado:
    """Saves a batch of staff forms.

    ``ediciones`` has ``solicitud_id``, ``recibida_en``, ``cita_id`` (null for a new appointment),
    the four required fields, ``fecha``, ``hora_inicio``, ``motivo`` and ``notas``.  Forms are decided one by
    one in order of arrival, edits and new appointments alike.
    """
    completas, incompletas = separar_validas(ediciones)
    con_paciente, nuevos = pacientes_del_panel(estado.pacientes, completas)
    df = marcar_existente(con_paciente, "audiologo_id", estado.audiologos, "_a")
    alta = F.col("cita_id").isNull()
    escritos = con_fila(marcar_existente(df, "sede_id", estado.sedes, "_s").select(
        F.when(alta, id_estable("cita", "solicitud_id")).otherwise(F.col("cita_id").cast("string")).alias("id"),
        alta.alias("alta"), F.struct("recibida_en", "solicitud_id").alias("orden"),
        "solicitud_id", "paciente_id", "audiologo_id", "sede_id", "fecha", seg("hora_inicio").alias("_ini"),
        F.col("motivo").alias("motivo_consulta"), "notas", "_a", "_s",
    ), "formularios")
    # The start is read once, before the write; what follows from it is cheap.
    formularios = normalizar_ediciones(escritos).withColumn(
        "motivo_rechazo",
        F.when(F.col("fecha").isNull(), "falta_fecha")
        .when(F.col("hora_inicio").isNull(), "falta_hora")
        .when(F.col("_a").isNull(), "audiologo_desconocido")
        .when(F.col("_s").isNull(), "sede_desconocida"),
    ).drop("_a", "_s")

    citas = ids_texto(estado.citas)
    revisadas = revisar_ediciones(
        citas, formularios.filter(F.col("motivo_rechazo").isNull()).drop("motivo_rechazo"))
    valen = revisadas.filter(F.col("motivo_rechazo").isNull())
    aceptadas = valen.filter("alta").select(
        "solicitud_id", "id", "paciente_id", "audiologo_id", "sede_id", "fecha", "hora_inicio", "hora_fin",
        "motivo_consulta", "notas", F.lit("pendiente").alias("estado"),
    )
    rechazadas = (
        incompletas.select("solicitud_id", F.lit("formulario_incompleto").alias("motivo_rechazo"))
        .unionByName(
            formularios.filter(F.col("motivo_rechazo").isNotNull()).select("solicitud_id", "motivo_rechazo")
        )
        .unionByName(
            revisadas.filter(F.col("motivo_rechazo").isNotNull()).select("solicitud_id", "motivo_rechazo"))
    )
    pacientes = estado.pacientes.withColumn("id", F.col("id").cast("string"))
    return Resultado(
        aceptadas=aceptadas,
        rechazadas=rechazadas,
        pacientes=agregar(pacientes, nuevos, "pacientes", ahora),
        citas=agregar(con_ediciones(citas, valen.filter(~F.col("alta")), ahora), aceptadas, "citas", ahora),
    )
