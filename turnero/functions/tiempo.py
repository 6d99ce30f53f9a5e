"""Column expressions for times of day and dates.

A time of day is the string ``HH:mm:ss`` in tables and results, and an ``int`` of seconds since
midnight inside the operators.  All functions are JVM-side expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnero.functions.valores import DIAS, DIAS_CORTOS, MESES, SEGUNDOS_DIA


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lista(valores) -> Column:
    return F.array(*[F.lit(v) for v in valores])


def seg(c) -> Column:
    """``HH:mm`` or ``HH:mm:ss`` to seconds since midnight; null when there is no such time of day.

    The hour may have one digit; fractions of a second are dropped.  ``24:00`` is the end of the day.
    Texts in the form tables have (two digits each) are read by position, which costs less than a third of the pattern.
    """
    c = _col(c)

    def cifras(n: int) -> Column:
        return F.substring(c, n, 2).try_cast("int")

    habitual = (
        F.translate(c, "123456789", "000000000").isin("00:00:00", "00:00")
        & (c < "24") & (F.substring(c, 4, 1) < "6") & (F.substring(c, 7, 1) < "6")
    )

    def parte(n: int) -> Column:
        return F.split_part(c, F.lit(":"), F.lit(n))

    segundos = F.when(parte(3) == "", F.lit(0)).otherwise(F.substring(parte(3), 1, 2).try_cast("int"))
    return F.when(habitual, cifras(1) * 3600 + cifras(4) * 60 + F.coalesce(cifras(7), F.lit(0))).when(
        c.rlike(r"^(([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]+)?)?|24:00(:00([.]0+)?)?)$"),
        parte(1).try_cast("int") * 3600 + parte(2).try_cast("int") * 60 + segundos,
    )


def envolver(s) -> Column:
    """Seconds brought back into one day: time arithmetic wraps at midnight."""
    return F.pmod(_col(s), F.lit(SEGUNDOS_DIA))


def _dos_cifras(n: Column) -> Column:
    """0..59 as two digits, by position in a constant list."""
    lista = F.split(F.lit(" ".join(f"{i:02d}" for i in range(60))), " ")
    return F.get(lista, n.cast("int"))


def hms(s) -> Column:
    """Seconds since midnight to ``HH:mm:ss``, modulo one day."""
    s = _col(s)
    return F.concat(
        _dos_cifras(F.call_function("div", envolver(s), F.lit(3600))), F.lit(":"),
        _dos_cifras(F.call_function("div", F.pmod(s, F.lit(3600)), F.lit(60))), F.lit(":"),
        _dos_cifras(F.pmod(s, F.lit(60))),
    )


def sumar_minutos(hora, minutos) -> Column:
    """Start plus a number of minutes, modulo 24 hours, as ``HH:mm:ss``."""
    return hms(seg(hora) + (_col(minutos) if isinstance(minutos, str) else F.lit(minutos)) * 60)


def minutos_entre(a, b) -> Column:
    """Minutes from time ``a`` to time ``b``; negative when ``b`` is earlier."""
    return (seg(b) - seg(a)) / F.lit(60.0)


def hhmm(c) -> Column:
    """``HH:mm:ss`` cut to ``HH:mm``."""
    return F.substring(_col(c), 1, 5)


def hhmmss(c) -> Column:
    """``HH:mm`` padded to ``HH:mm:ss``; longer values are left alone."""
    c = _col(c)
    return F.when(F.length(c) == 5, F.concat(c, F.lit(":00"))).otherwise(c)


def fmt_hora(c) -> Column:
    """``08:30:00`` to ``8:30 am``; midnight is 12 am and noon is 12 pm."""
    c = _col(c)
    h = F.substring(c, 1, 2).try_cast("int")
    doce = F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12)
    sufijo = F.when(h >= 12, F.lit(" pm")).otherwise(F.lit(" am"))
    return F.concat(doce.cast("string"), F.lit(":"), F.substring(c, 4, 2), sufijo)


def dow(c) -> Column:
    """Weekday with 0 = Sunday."""
    return F.dayofweek(_col(c)) - 1


def nombre_dia(c) -> Column:
    """Weekday number (0 = Sunday) to its name; null outside 0..6."""
    return F.get(_lista(DIAS), _col(c))


def nombre_dia_corto(c) -> Column:
    """Weekday number (0 = Sunday) to its three-letter heading."""
    return F.get(_lista(DIAS_CORTOS), _col(c))


def orden_dia(c) -> Column:
    """Position of a weekday in a list that starts on Monday: Monday 0, Sunday 6."""
    return F.pmod(_col(c) + 6, F.lit(7))


def nombre_mes(c) -> Column:
    """Month number (1 = January) to its name; null outside 1..12."""
    return F.get(_lista(MESES), _col(c) - 1)


def fmt_fecha_grupo(c) -> Column:
    """Long Spanish date without the year, for instance ``lunes, 3 de agosto``."""
    c = _col(c)
    return F.lower(
        F.concat(
            nombre_dia(dow(c)), F.lit(", "), F.dayofmonth(c).cast("string"),
            F.lit(" de "), nombre_mes(F.month(c)),
        )
    )


def fecha_de(anio, mes0, dia) -> Column:
    """Date from year, zero-based month and day."""
    return F.make_date(_col(anio), _col(mes0) + 1, _col(dia))


def ultimo_dia(c) -> Column:
    return F.last_day(_col(c))


def sumar_meses(c, n: int) -> Column:
    """Same position ``n`` months away, stepping over year ends."""
    return F.add_months(_col(c), n)


def serie_fechas(desde: str, hasta: str) -> Column:
    """Array of all dates from ``desde`` to ``hasta``, both included; empty if reversed."""
    d, h = F.lit(desde).cast("date"), F.lit(hasta).cast("date")
    vacia = F.array().cast("array<date>")
    return F.when(d <= h, F.sequence(d, h, F.expr("interval 1 day"))).otherwise(vacia)


def serie_dias(desde: int, hasta: int) -> Column:
    """Array of the integers ``desde`` .. ``hasta``, both included; empty if reversed."""
    return _lista(range(desde, hasta + 1)).cast("array<int>")
