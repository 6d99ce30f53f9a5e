"""Column expressions for labels and text fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnero.functions.tiempo import _col
from turnero.functions.valores import DURACION_POR_DEFECTO, ETIQUETAS_ESTADO


def vacio_a_nulo(c) -> Column:
    """Empty string to null."""
    return F.nullif(_col(c), F.lit(""))


def presente(c) -> Column:
    """True when a form field has a value: neither null nor empty."""
    return F.coalesce(_col(c).cast("string") != "", F.lit(False))


def etiqueta_estado(c) -> Column:
    """State to its label; null for an unknown state."""
    pares = [F.lit(v) for par in ETIQUETAS_ESTADO.items() for v in par]
    return F.try_element_at(F.create_map(*pares), _col(c))


def detalle_cita(profesional, sede, motivo) -> Column:
    """``professional · site[ · reason]``; absent parts are left out."""
    return F.concat_ws(" · ", _col(profesional), _col(sede), vacio_a_nulo(motivo))


def nombre_paciente(c) -> Column:
    return F.coalesce(vacio_a_nulo(c), F.lit("Paciente"))


def acciones(c) -> Column:
    """What may be done with an appointment in this state, as an array of action names."""
    c = _col(c)
    return (
        F.when(c == "pendiente", F.array(F.lit("confirmar"), F.lit("editar"), F.lit("cancelar")))
        .when(c == "confirmada", F.array(F.lit("editar"), F.lit("cancelar")))
        .otherwise(F.array().cast("array<string>"))
    )


def activa(c="estado") -> Column:
    """True when an appointment occupies its slot: every state but ``cancelada``."""
    return _col(c) != "cancelada"


def duracion_o_defecto(c) -> Column:
    """Slot length typed in a form: null, blank, zero and non-numbers become the default."""
    numero = _col(c).try_cast("int")
    return F.when(numero.isNull() | (numero == 0), F.lit(DURACION_POR_DEFECTO)).otherwise(numero)
