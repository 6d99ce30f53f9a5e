"""Schemas and constraints of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TIPOS = {
    "string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
    "bigint": T.LongType(), "double": T.DoubleType(),
}


def esquema(columnas: str) -> T.StructType:
    """Nullable columns out of ``name type, name type, ...``; needs no session."""
    pares = [c.split() for c in columnas.split(",")]
    return T.StructType([T.StructField(nombre, _TIPOS[tipo]) for nombre, tipo in pares])


ESQUEMAS: dict[str, T.StructType] = {
    "sedes": esquema(
        "id string, nombre string, ciudad string, direccion string, telefono string,"
        " activa boolean, creado_en timestamp"
    ),
    "audiologos": esquema(
        "id string, nombre string, sede_id string, especialidad string, telefono string,"
        " email string, activo boolean, creado_en timestamp"
    ),
    "horarios_disponibles": esquema(
        "id string, audiologo_id string, dia_semana int, hora_inicio string, hora_fin string,"
        " duracion_cita_min int, creado_en timestamp"
    ),
    "horarios_fecha": esquema(
        "id string, audiologo_id string, fecha date, hora_inicio string, hora_fin string,"
        " duracion_cita_min int, creado_en timestamp"
    ),
    "bloqueos": esquema(
        "id string, audiologo_id string, fecha date, hora_inicio string, hora_fin string,"
        " motivo string, creado_en timestamp"
    ),
    "pacientes": esquema(
        "id string, nombre string, telefono string, email string, documento string, eps string,"
        " creado_en timestamp"
    ),
    "citas": esquema(
        "id string, paciente_id string, audiologo_id string, sede_id string, fecha date,"
        " hora_inicio string, hora_fin string, estado string, motivo_consulta string,"
        " notas string, notificacion_enviada boolean, creado_en timestamp,"
        " actualizado_en timestamp"
    ),
    "solicitudes": esquema(
        "solicitud_id string, recibida_en timestamp, sede_id string, audiologo_id string,"
        " fecha date, hora_inicio string, nombre string, telefono string, motivo string,"
        " email string, eps string"
    ),
}

# Columns that may not be null.
OBLIGATORIAS: dict[str, list[str]] = {
    "sedes": ["nombre", "ciudad"],
    "audiologos": ["nombre"],
    "horarios_disponibles": ["dia_semana", "hora_inicio", "hora_fin"],
    "horarios_fecha": ["fecha", "hora_inicio", "hora_fin"],
    "bloqueos": ["fecha"],
    "pacientes": ["nombre", "telefono"],
    "citas": ["fecha", "hora_inicio", "hora_fin", "estado"],
}

# Foreign keys as (table, column, parent, rule on delete).
FORANEAS: list[tuple[str, str, str, str]] = [
    ("audiologos", "sede_id", "sedes", "restrict"),
    ("horarios_disponibles", "audiologo_id", "audiologos", "cascade"),
    ("horarios_fecha", "audiologo_id", "audiologos", "cascade"),
    ("bloqueos", "audiologo_id", "audiologos", "cascade"),
    ("citas", "paciente_id", "pacientes", "restrict"),
    ("citas", "audiologo_id", "audiologos", "restrict"),
    ("citas", "sede_id", "sedes", "restrict"),
]

# Defaults of omitted columns; "ahora" stands for the time of the job.
POR_DEFECTO: dict[str, dict[str, object]] = {
    "sedes": {"activa": True, "creado_en": "ahora"},
    "audiologos": {"activo": True, "creado_en": "ahora"},
    "horarios_disponibles": {"duracion_cita_min": 30, "creado_en": "ahora"},
    "horarios_fecha": {"duracion_cita_min": 30, "creado_en": "ahora"},
    "bloqueos": {"creado_en": "ahora"},
    "pacientes": {"creado_en": "ahora"},
    "citas": {
        "estado": "pendiente", "notificacion_enviada": False,
        "creado_en": "ahora", "actualizado_en": "ahora",
    },
}
