"""Secret scans: patterns, and sliding-window entropy over candidate strings.

Three patterns give the base spans.  Further candidates are runs of at least ``VENTANA`` characters of
a class (hexadecimal, base 64) that hold a digit and a letter.  A window of ``VENTANA`` characters slides over
a candidate; its Shannon entropy follows from the counts of the characters in it, of which each step
changes two.  A candidate is a secret when some window's entropy reaches the threshold of its class,
no allow-list pattern matches it, and no base span touches it.  Base spans all stay.

How it scales.  One pass, no shuffle, no Python.  Matching is by the regular expressions of SQL
functions; a match's position is the length of what comes before it.  Steps run only on texts that have a
match, and entropy only on candidates.

Defined results.  Null and empty texts have no spans.  Repeated rows are scanned alike.  Positions are
code points, end exclusive.  Spans of different kinds may overlap.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns, and the least lengths of what they match.
ASIGNA = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
LARGO_ASIGNA = 12
# A run is one match, so the least length may stand in the pattern.
ACCESO = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

VENTANA = 20
# Class: characters as in a regular expression, all of them, least entropy in bits.
CIFRAS, MINUSCULAS, MAYUSCULAS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASES = {
    "hexadecimal": ("0-9A-Fa-f", CIFRAS + "abcdefABCDEF", 3.0),
    "base64": ("A-Za-z0-9+/_=-", CIFRAS + MINUSCULAS + MAYUSCULAS + "+/_=-", 3.7),
}
PERMITIDOS = r"(?i)example|sample|dummy|placeholder|xxxx|0123456789|abcdefgh"
CLASE_SPAN = "struct<kind:string,start:bigint,end:bigint,base:boolean>"


def con(valor: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(valor), f)[0]


def lugares(texto: Column, patron: str) -> Column:
    """Leftmost non-overlapping matches: array of (``start``, ``end``, ``m``); null when there is none."""
    hallados = F.regexp_extract_all(texto, F.lit(patron), F.lit(0))
    tipo = "array<struct<start:bigint,end:bigint,m:string>>"

    def situar(ms: Column) -> Column:
        # What stands between the matches, so that positions add up from left to right.
        def suma(piezas: Column) -> Column:
            def paso(s: Column, m: Column) -> Column:
                k = F.size(s["v"])
                inicio = s["fin"] + F.length(piezas[k])
                fin = inicio + F.length(m)
                return F.struct(
                    fin.cast("long").alias("fin"),
                    F.concat(s["v"], F.array(F.struct(inicio.cast("long").alias("start"),
                                                      fin.cast("long").alias("end"), m.alias("m")))).alias("v"),
                )

            cero = F.struct(F.lit(0).cast("long").alias("fin"), F.array().cast(tipo).alias("v"))
            return F.aggregate(ms, cero, paso)["v"]

        return F.when(F.size(ms) > 0, con(F.split(texto, patron, -1), suma))

    return con(hallados, situar)


def _bits(c: Column) -> Column:
    """Count times its binary logarithm."""
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def entropia_maxima(cadena: Column, alfabeto: str, ventana: int = VENTANA) -> Column:
    """Largest entropy of any window of a string, by counts that change with each step."""
    letras = len(alfabeto)
    # Each character's place in the alphabet, from 1, taken once: a step looks up two of them.
    numeros = F.transform(F.split(cadena, ""), lambda c: F.instr(F.lit(alfabeto), c))

    def cambiar(s: Column, entra: Column, sale: Column) -> Column:
        """Adds character number ``entra`` and takes ``sale`` out (0: none)."""
        def con_cuentas(antes: Column) -> Column:
            despues = F.transform(antes, lambda c, j: c + (j == entra - 1).cast("int") - (j == sale - 1).cast("int"))
            mas, menos = F.get(antes, entra - 1), F.get(antes, sale - 1)
            suma = s["suma"] + _bits(mas + 1) - _bits(mas)
            suma = F.when((sale == 0) | (sale == entra), F.when(sale == entra, s["suma"]).otherwise(suma)).otherwise(
                suma + _bits(menos - 1) - _bits(menos))
            return F.struct(despues.alias("cuentas"), suma.alias("suma"))

        return con(s["cuentas"], con_cuentas)

    def pasos(ns: Column) -> Column:
        def paso(s: Column, i: Column) -> Column:
            sale = F.when(i > ventana, F.get(ns, i - ventana - 1)).otherwise(0)
            nuevo = con(F.get(ns, i - 1), lambda e: con(sale, lambda o: cambiar(s, e, o)))
            return con(nuevo, lambda n: F.struct(
                n["cuentas"].alias("cuentas"), n["suma"].alias("suma"),
                F.when(i >= ventana, F.greatest(s["mayor"], F.lit(math.log2(ventana)) - n["suma"] / ventana))
                .otherwise(s["mayor"]).alias("mayor"),
            ))

        return F.aggregate(F.sequence(F.lit(1), F.length(cadena)), cero, paso)["mayor"]

    cero = F.struct(F.array_repeat(F.lit(0), letras).alias("cuentas"), F.lit(0.0).alias("suma"),
                    F.lit(0.0).alias("mayor"))
    return con(numeros, pasos)


def con_entropia(texto: Column, permitidos: str) -> Column:
    """Candidate strings of each class whose entropy is high enough."""
    def de_clase(caracteres: str, alfabeto: str, minimo: float) -> Column:
        patron = f"(?<![{caracteres}])[{caracteres}]{{{VENTANA},}}"

        def secreto(x: Column) -> Column:
            posible = x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") & ~x["m"].rlike(permitidos)
            return F.when(posible, entropia_maxima(x["m"], alfabeto) >= minimo).otherwise(False)

        return F.filter(lugares(texto, patron), secreto)

    vacio = F.array().cast("array<struct<start:bigint,end:bigint,m:string>>")
    return F.concat(*[F.coalesce(de_clase(*c), vacio) for c in CLASES.values()])


def detectar_secretos(
    docs: DataFrame, doc: str = "doc_id", texto: str = "text", permitidos: str = PERMITIDOS
) -> DataFrame:
    """One row per document: id and ``spans``, an array of (``kind``, ``start``, ``end``, ``base``).

    Base kinds are ``assign``, ``access`` and ``hex``; what entropy adds is ``entropy``.  Spans are sorted by
    start, then kind in this order.
    """
    t = F.coalesce(F.col(texto).cast("string"), F.lit(""))
    tipo = f"array<{CLASE_SPAN}>"

    def spans(x: Column | None, clase: str, es_base: bool) -> Column:
        return F.coalesce(
            F.transform(x, lambda s: F.struct(F.lit(clase).alias("kind"), s["start"].alias("start"),
                                              s["end"].alias("end"), F.lit(es_base).alias("base"))),
            F.array()).cast(tipo)

    # A text without the sign every match needs is not scanned for it.
    asigna = F.when(t.contains(":") | t.contains("="), F.filter(
        lugares(t, ASIGNA),
        lambda s: F.length(F.regexp_extract(s["m"], ASIGNA, 2)) >= LARGO_ASIGNA))
    acceso = F.when(t.contains("AKIA"), lugares(t, ACCESO))
    hexa = lugares(t, HEX)
    base = F.concat(spans(asigna, "assign", True), spans(acceso, "access", True), spans(hexa, "hex", True))

    def sumar(b: Column) -> Column:
        libres = F.filter(con_entropia(t, permitidos), lambda c: ~F.exists(
            b, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
        # A string of both classes is one candidate.
        return F.concat(b, F.array_distinct(spans(libres, "entropy", False)))

    orden = F.array(*[F.lit(k) for k in ("assign", "access", "hex", "entropy")])

    def comparar(a: Column, b: Column) -> Column:
        def llave(s: Column) -> Column:
            return s["start"] * 8 + F.array_position(orden, s["kind"])

        return F.when(llave(a) < llave(b), -1).when(llave(a) > llave(b), 1).otherwise(0)

    return docs.select(F.col(doc), F.array_sort(con(base, sumar), comparar).alias("spans"))
