"""Fixed values of the domain."""

# States of an appointment, with the label shown for each.
ESTADOS = ["pendiente", "confirmada", "cancelada", "completada", "no_asistio"]
ETIQUETAS_ESTADO = {
    "pendiente": "Pendiente",
    "confirmada": "Confirmada",
    "cancelada": "Cancelada",
    "completada": "Completada",
    "no_asistio": "No asistió",
}

# Weekday names by number, 0 = Sunday.
DIAS = ["Domingo", "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado"]
DIAS_CORTOS = ["Dom", "Lun", "Mar", "Mié", "Jue", "Vie", "Sáb"]

# Month names, January first.
MESES = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
]

DURACION_POR_DEFECTO = 30
SEGUNDOS_DIA = 86400
