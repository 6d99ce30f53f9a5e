"""Changes of appointments decided as if each came alone, in its turn.

A change may need a slot (a move, a revival, a new appointment) and may give one up (a move, a
cancellation).  It gets the slot when no other active appointment holds it at that moment.  Whether one does
depends on earlier changes, these on others before them, and so on.

How it scales.  Only appointments that may want a slot some other appointment may hold are looked at in
rounds; all changes of the others apply at once, whatever their number.  A round takes, of every appointment
in dispute, its changes up to the first that needs a slot: those before need none and apply.  That one is

* refused when some appointment surely holds the slot then: nothing undecided before that moment can free it;
* applied when none holds it, and no undecided change before that moment may take or free it;
* left for the next round otherwise.

The earliest undecided change is always decided, so rounds end by themselves; how many there are depends on
how often slots change hands in turn, not on how many want them: all who ask for a held slot are refused in
one round.  Who holds a slot is kept as intervals of turns, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnero.functions.texto import activa
from turnero.functions.tiempo import seg
from turnero.sources.tablas import claves_distintas, en_fechas_de, materializar, reducir_a

HUECO = ["audiologo_id", "fecha", "ini"]


def hueco(inicio: str = "hora_inicio") -> Column:
    """Professional, date and start; null when one of them is, since then nothing is in conflict."""
    campos = F.struct("audiologo_id", "fecha", seg(inicio).alias("ini"))
    return F.when(
        F.col("audiologo_id").isNotNull() & F.col("fecha").isNotNull() & seg(inicio).isNotNull(), campos
    )


def _caja(c: str) -> Column:
    """A value that may be null, boxed so that null is told from absent."""
    return F.struct(F.col(c).alias("v"))


def estado_actual(citas: DataFrame, cambios: DataFrame) -> DataFrame:
    """Stored appointments that ``cambios`` names: active (``a``) and in which slot (``h``); the table is gone through once."""
    return materializar(
        citas.join(claves_distintas(cambios, ["id"]), "id", "left_semi").select(
            "id", activa().alias("a"), hueco().alias("h")), "actuales")


def _inicio(actuales: DataFrame, ops: DataFrame) -> DataFrame:
    """Per appointment of the batch: is it active before it (``a``), and in which slot (``h``)."""
    return ops.groupBy("id").agg(
        F.coalesce(F.max("activa"), F.lit(False)).alias("_alguna"),
        F.coalesce(F.min("activa"), F.lit(True)).alias("_todas"),
    ).join(actuales, "id", "left").withColumn("a", F.coalesce("a", F.lit(False)))


def _disputas(citas: DataFrame, ops: DataFrame, inicio: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Appointments that may want a slot another one may hold, and who holds such slots before the batch."""
    # A revival needs the appointment to be inactive, before the batch or by a change of it.
    reviven = inicio.filter(F.col("_alguna") & (~F.col("a") | ~F.col("_todas")) & F.col("h").isNotNull())
    quieren = materializar(
        ops.filter(F.col("mueve") & F.col("hueco").isNotNull()).select("hueco", "id")
        .unionByName(reviven.select(F.col("h").alias("hueco"), "id")).distinct(), "quieren")
    moviles = inicio.filter(F.col("a") & F.col("h").isNotNull()).select(F.col("h").alias("hueco"), "id")
    claves = quieren.select("hueco.*")
    activas = (
        en_fechas_de(citas, claves).filter(activa())
        # Never null, so no check for null is pushed down to be computed once more; -1 is nobody's start.
        .select("audiologo_id", "fecha", F.coalesce(seg("hora_inicio"), F.lit(-1)).alias("ini"))
    )
    # Somebody outside the batch holds a slot when more hold it than those of the batch; no join by id is needed.
    todas = reducir_a(activas, claves, HUECO, lambda c: c.groupBy(*HUECO).agg(F.count(F.lit(1)).alias("_n")))
    del_lote = moviles.groupBy("hueco").agg(F.count(F.lit(1)).alias("_m"))
    fijos = materializar(
        todas.select(F.struct(*HUECO).alias("hueco"), "_n").join(del_lote, "hueco", "left")
        .filter(F.col("_n") > F.coalesce("_m", F.lit(0))).select("hueco"), "fijos")
    disputados = materializar(
        quieren.unionByName(moviles).groupBy("hueco").agg(F.min("id").alias("a"), F.max("id").alias("b"))
        .filter("a <> b").select("hueco").unionByName(fijos), "disputados")
    ids = materializar(quieren.join(disputados, "hueco", "left_semi").select("id").distinct(), "en_disputa")

    # An appointment that is in no dispute gives its slot up at its first cancellation or move.
    suyas = ops.join(moviles.withColumnRenamed("hueco", "h"), "id")
    deja = ~F.col("activa") | (F.col("mueve") & ~F.col("hueco").eqNullSafe(F.col("h")))
    salidas = suyas.filter(deja).join(ids, "id", "left_anti").groupBy("id").agg(F.min("t").alias("hasta"))
    nunca = F.lit(None).cast("long")
    tenedores = (
        moviles.join(disputados, "hueco", "left_semi").join(salidas, "id", "left")
        .select("hueco", "id", nunca.alias("desde"), "hasta")
        .unionByName(fijos.select(
            "hueco", F.lit(None).cast("string").alias("id"), nunca.alias("desde"), nunca.alias("hasta")))
    )
    return ids, tenedores


def _simular(pendientes: DataFrame, estados: DataFrame) -> DataFrame:
    """Pending changes with the state before and after each, if all before it apply.

    ``primera`` is the turn of the appointment's first change that needs a slot: up to it this holds.
    """
    w = Window.partitionBy("id").orderBy("t")
    df = (
        pendientes.join(estados, "id")
        .withColumn("h1", F.coalesce(
            F.last(F.when(F.col("mueve"), _caja("hueco")), True).over(w), _caja("h"))["v"])
        .withColumn("a1", F.coalesce(F.last("activa", True).over(w), F.col("a")))
        .withColumn("h0", F.coalesce(F.lag(_caja("h1")).over(w), _caja("h"))["v"])
        .withColumn("a0", F.coalesce(F.lag("a1").over(w), F.col("a")))
    )
    tenia, tiene = F.col("a0") & F.col("h0").isNotNull(), F.col("a1") & F.col("h1").isNotNull()
    mismo = F.col("h0").eqNullSafe(F.col("h1"))
    df = df.withColumns({"toma": tiene & ~(tenia & mismo), "deja": tenia & ~(tiene & mismo)}).drop("a", "h")
    return df.withColumn("primera", F.min(F.when(F.col("toma"), F.col("t"))).over(Window.partitionBy("id")))


def _primeros_posibles(quedan: DataFrame) -> DataFrame:
    """Per slot the earliest undecided turn that may take it."""
    mueven = quedan.filter(F.col("mueve") & F.col("hueco").isNotNull()).select("hueco", "t")
    reviven = (
        quedan.groupBy("id").agg(
            F.min(F.when(F.col("activa"), F.col("t"))).alias("t"), F.min("activa").alias("_todas"),
            F.min_by("a0", "t").alias("a0"), F.min_by(_caja("h0"), "t")["v"].alias("hueco"),
        )
        .filter(F.col("t").isNotNull() & F.col("hueco").isNotNull() & (~F.col("a0") | ~F.col("_todas")))
        .select("hueco", "t")
    )
    return mueven.unionByName(reviven).groupBy("hueco").agg(F.min("t").alias("t0"))


def _decidir(ronda: DataFrame, tenedores: DataFrame) -> DataFrame:
    """First needs of the appointments with ``aplica``: true, false, or null when it stays open."""
    piden = ronda.filter(F.col("t") == F.col("primera")).select(
        "id", "t", F.col("h1").alias("hueco"), "a1", "a0", "h0", "deja")
    primeros = _primeros_posibles(ronda.filter(F.col("t") >= F.col("primera")))
    frente = tenedores.unionByName(primeros, allowMissingColumns=True)
    p, f = piden.alias("p"), frente.repartition(F.hash("hueco", F.lit(1))).alias("f")
    cubre = (
        ~F.col("f.id").eqNullSafe(F.col("p.id"))
        & (F.col("f.desde").isNull() | (F.col("f.desde") < F.col("p.t")))
        & (F.col("f.hasta").isNull() | (F.col("f.hasta") > F.col("p.t")))
    )
    seguro = F.col("f.hasta").isNotNull() | F.col("f.proxima").isNull() | (F.col("f.proxima") > F.col("p.t"))
    tiene = F.col("f.hueco").isNotNull() & F.col("f.t0").isNull()
    juntos = p.join(
        f, (F.col("p.hueco") == F.col("f.hueco")) & (F.col("f.t0").isNotNull() | cubre), "left"
    ).groupBy("p.id", "p.t").agg(
        F.first(F.struct("p.hueco", "p.a1", "p.a0", "p.h0", "p.deja")).alias("x"),
        F.coalesce(F.max(tiene & seguro), F.lit(False)).alias("pierde"),
        F.coalesce(F.max(tiene), F.lit(False)).alias("duda"), F.min("f.t0").alias("t0"),
    )
    aplica = F.when(F.col("pierde"), False).when(~F.col("duda") & (F.col("t0") == F.col("t")), True)
    return juntos.select("id", "t", "x.*", aplica.alias("aplica"))


def decidir_en_orden(citas: DataFrame, ops: DataFrame, actuales: DataFrame | None = None) -> DataFrame:
    """Which changes apply: (``t``, ``aplica``), one row per change.

    ``ops`` has ``t`` (the turn, unique), ``id`` (of a stored appointment or a new one), ``activa`` (does it
    make the appointment active, inactive, or neither: null) and, where there are moves, ``mueve`` (does it set
    the slot) and ``hueco`` (to which, see ``hueco``).  An active appointment that keeps its slot is never in
    conflict.  ``actuales`` is what ``estado_actual`` gives for these changes or more, if the caller has it.
    """
    tipo = citas.select(hueco().alias("h")).schema["h"].dataType
    if "mueve" not in ops.columns:
        ops = ops.withColumns({"mueve": F.lit(False), "hueco": F.lit(None)})
    ops = materializar(ops.select(
        "t", F.col("id").cast("string").alias("id"), "mueve", F.col("hueco").cast(tipo).alias("hueco"), "activa"), "turnos")
    if actuales is None:
        actuales = estado_actual(citas.withColumn("id", F.col("id").cast("string")), ops)
    inicio = materializar(_inicio(actuales.withColumn("id", F.col("id").cast("string")), ops), "inicio")
    ids, tenedores = _disputas(citas, ops, inicio)
    decididas = ops.join(ids, "id", "left_anti").select("t", F.lit(True).alias("aplica"))
    pendientes = ops.join(ids, "id", "left_semi")
    estados = inicio.join(ids, "id", "left_semi").select("id", "a", "h")
    while not (ronda := materializar(_simular(pendientes, estados), "ronda")).isEmpty():
        antes = F.col("primera").isNull() | (F.col("t") < F.col("primera"))
        por_id = ronda.groupBy("id").agg(
            F.first("primera").alias("proxima"), F.min(F.when(F.col("deja") & antes, F.col("t"))).alias("_cierre"))
        tenedores = materializar(
            tenedores.join(por_id, "id", "left").withColumn("hasta", F.coalesce("hasta", "_cierre")).drop("_cierre"),
            "tenedores")
        dicho = materializar(_decidir(ronda, tenedores), "dicho")
        gana = dicho.filter("aplica")
        decididas = (
            decididas.unionByName(ronda.filter(antes).select("t", F.lit(True).alias("aplica")))
            .unionByName(dicho.filter(F.col("aplica").isNotNull()).select("t", "aplica"))
        )
        resuelta = dicho.select("id", "aplica")
        pendientes = ronda.join(resuelta, "id").filter(
            (F.col("t") > F.col("primera")) | ((F.col("t") == F.col("primera")) & F.col("aplica").isNull())
        ).select("t", "id", "mueve", "hueco", "activa")
        estados = dicho.select(
            "id", F.when(F.col("aplica"), F.col("a1")).otherwise(F.col("a0")).alias("a"),
            F.when(F.col("aplica"), F.col("hueco")).otherwise(F.col("h0")).alias("h"))
        cierres = gana.filter("deja").select("id", F.col("t").alias("_cierre"))
        tenedores = (
            tenedores.drop("proxima").join(cierres, "id", "left")
            .withColumn("hasta", F.coalesce("hasta", "_cierre")).drop("_cierre")
            .unionByName(gana.select("hueco", "id", F.col("t").alias("desde"), F.lit(None).cast("long").alias("hasta")))
        )
    return decididas
