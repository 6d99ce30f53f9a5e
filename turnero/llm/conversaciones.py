"""Chat formatting: reply trees to conversations.

Messages form trees by parent id.  Self-joins that double the distance they reach enumerate the
root-to-leaf paths: a path of depth d takes about 2 log2(d) joins of id rows, and texts join once, at
the end.  Branches of a tree are ranked by the sum of their messages' scores, and each chosen path
becomes one conversation.

Template.  A turn to learn from is ``<s>role\\ntext</s>``, any other ``[INST]role\\ntext[/INST]``.
Control strings inside roles and texts get a backslash after their first character, so the
marks of the template stay the only ones; ``leer_conversaciones`` takes the turns back out.

Defined results.  A null role or text counts as empty.  A message whose parent is null or absent is a
root.  A message without id cannot be placed in a tree and is in no path.  Messages on a cycle hang on no root and are in no path.  Messages that repeat a (tree, id)
count once: the least (role, text) stays.  A null tree key is a tree of its own.  Equal branch scores
go by leaf id.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnero.sources.tablas import materializar

# The template's marks.
ABRE, CIERRA, ABRE_META, CIERRA_META = "[INST]", "[/INST]", "<s>", "</s>"
MARCA = r"([\[<])(\\*)(/?(?:INST\]|s>))"
MARCA_ESCAPADA = r"([\[<])\\(\\*)(/?(?:INST\]|s>))"
TURNO = r"(?s)(?:\[INST\]|<s>).*?(?:\[/INST\]|</s>)"


def escapar(c: Column) -> Column:
    """Breaks every control string by a backslash; strings so broken before get one more."""
    return F.regexp_replace(c, MARCA, r"$1\\$2$3")


def desescapar(c: Column) -> Column:
    return F.regexp_replace(c, MARCA_ESCAPADA, "$1$2$3")


def _rol_escrito(c: Column) -> Column:
    """Role on one line: backslash and line feed are written as two characters."""
    return escapar(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _rol_leido(c: Column) -> Column:
    c = F.replace(desescapar(c), F.lit("\\\\"), F.lit("\\\u0000"))
    return F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\\u0000"), F.lit("\\"))


def _texto_o_vacio(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def preparar_mensajes(
    mensajes: DataFrame, arbol: str, mensaje: str, padre: str, rol: str, texto: str, puntos: Column
) -> DataFrame:
    """Messages once each under fixed names; the tree key is a text, so that null is a key too."""
    llave = F.when(F.col(arbol).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(arbol)))
    return (
        mensajes.filter(F.col(mensaje).isNotNull())
        .select(
            llave.alias("arbol"), F.col(arbol).alias("original"), F.col(mensaje).alias("nodo"),
            F.col(padre).alias("padre"), _texto_o_vacio(rol).alias("rol"),
            _texto_o_vacio(texto).alias("texto"), puntos.cast("double").alias("puntos"),
        )
        .groupBy("arbol", "nodo")
        .agg(F.min(F.struct("rol", "texto", "padre", "puntos", "original")).alias("m"))
        .select("arbol", "nodo", "m.*")
    )


def caminos(mensajes: DataFrame) -> DataFrame:
    """Every (leaf, node, distance) of the root-to-leaf paths, by self-joins of doubling reach.

    ``saltos[k]`` has each node's ancestor 2**k steps up.  Going down from the largest k, each
    known ancestor adds the one 2**k above it, so every distance is reached by its binary digits.
    """
    nodos = mensajes.select("arbol", "nodo", "padre")
    existe = nodos.select("arbol", F.col("nodo").alias("padre"))
    enlaces = materializar(
        nodos.filter(F.col("padre").isNotNull()).join(existe, ["arbol", "padre"], "left_semi")
        .select("arbol", "nodo", F.col("padre").alias("arriba")), "enlaces",
    )
    total = nodos.count()
    saltos, alcance = [enlaces], 1
    while alcance < total:
        s = saltos[-1]
        mas = s.select("arbol", F.col("nodo").alias("arriba"), F.col("arriba").alias("lejos"))
        siguiente = materializar(
            s.join(mas, ["arbol", "arriba"]).select("arbol", "nodo", F.col("lejos").alias("arriba")),
            "saltos",
        )
        if siguiente.isEmpty():
            break
        saltos.append(siguiente)
        alcance *= 2
    con_hijos = enlaces.select("arbol", F.col("arriba").alias("nodo")).distinct()
    ruta = (
        nodos.join(con_hijos, ["arbol", "nodo"], "left_anti")
        .select("arbol", F.col("nodo").alias("hoja"), "nodo", F.lit(0).cast("long").alias("altura"))
    )
    for k in reversed(range(len(saltos))):
        ruta = ruta.join(saltos[k], ["arbol", "nodo"], "left")
        ruta = materializar(
            ruta.select(
                "arbol", "hoja",
                F.inline(F.filter(F.array(
                    F.struct(F.col("nodo").alias("nodo"), F.col("altura").alias("altura")),
                    F.struct(F.col("arriba").alias("nodo"), (F.col("altura") + 2**k).alias("altura")),
                ), lambda x: x["nodo"].isNotNull())),
            ), "ruta",
        )
    return ruta


def mejores_ramas(ruta: DataFrame, mensajes: DataFrame, por_arbol: int | None) -> DataFrame:
    """Branches with score and rank; ``por_arbol`` keeps that many of each tree, None keeps all."""
    ramas = (
        ruta.join(mensajes.select("arbol", "nodo", "puntos"), ["arbol", "nodo"])
        .groupBy("arbol", "hoja").agg(F.sum(F.coalesce("puntos", F.lit(0.0))).alias("puntos"))
    )
    w = Window.partitionBy("arbol").orderBy(F.desc("puntos"), "hoja")
    ramas = ramas.withColumn("puesto", F.row_number().over(w))
    return ramas if por_arbol is None else ramas.filter(F.col("puesto") <= por_arbol)


def formatear_conversaciones(
    mensajes: DataFrame, arbol: str = "tree_id", mensaje: str = "message_id",
    padre: str = "parent_id", rol: str = "role", texto: str = "text",
    puntos: Column | None = None, por_arbol: int | None = 1, aprende: str = "assistant",
) -> DataFrame:
    """One row per chosen branch: tree key, leaf, score, rank, ``formatted`` and ``loss_spans``.

    ``loss_spans`` are the code point ranges (end exclusive) of the texts of role ``aprende``.
    A conversation is one cell, so its turns meet in one row; nothing larger does.
    """
    m = materializar(
        preparar_mensajes(
            mensajes, arbol, mensaje, padre, rol, texto, F.lit(0) if puntos is None else puntos
        ), "mensajes",
    )
    ruta = caminos(m)
    elegidas = mejores_ramas(ruta, m, por_arbol)
    meta = F.col("rol") == aprende
    cabeza = F.concat(
        F.when(meta, ABRE_META).otherwise(ABRE), _rol_escrito(F.col("rol")), F.lit("\n")
    )
    cuerpo = escapar(F.col("texto"))
    turnos = (
        ruta.join(elegidas, ["arbol", "hoja"]).drop("puntos").join(m, ["arbol", "nodo"])
        .select(
            "arbol", "hoja", "puesto", "original", "altura", meta.alias("meta"),
            F.concat(cabeza, cuerpo, F.when(meta, CIERRA_META).otherwise(CIERRA)).alias("pieza"),
            F.length(cabeza).cast("long").alias("antes"), F.length(cuerpo).cast("long").alias("dentro"),
        )
    )
    # Ends of the turns so far, then the span of each turn to learn from.
    w = Window.partitionBy("arbol", "hoja").orderBy(F.desc("altura"))
    turnos = turnos.withColumn("fin", F.sum(F.length("pieza").cast("long")).over(w))
    desde = F.col("fin") - F.length("pieza") + F.col("antes")
    tramo = F.struct(desde.alias("start"), (desde + F.col("dentro")).alias("end"))
    juntas = turnos.groupBy("arbol", "hoja").agg(
        F.first("original").alias(arbol), F.first("puesto").alias("rank"),
        F.array_sort(F.collect_list(F.struct("fin", "pieza"))).alias("piezas"),
        F.array_sort(F.collect_list(F.when(F.col("meta"), tramo))).alias("loss_spans"),
    )
    return juntas.join(elegidas.select("arbol", "hoja", "puntos"), ["arbol", "hoja"]).select(
        arbol, F.col("hoja").alias("leaf"), F.col("puntos").alias("score"), "rank",
        F.array_join("piezas.pieza", "").alias("formatted"), "loss_spans",
    )


def leer_conversaciones(formateadas: DataFrame) -> DataFrame:
    """Reads turns and the masked texts back from ``formatted`` and ``loss_spans``.

    Adds ``turns`` (array of role and text) and ``loss_text`` (the texts under the mask, unescaped,
    joined with nothing between).
    """
    def turno(p: Column) -> Column:
        dentro = F.regexp_replace(p, r"^(?:\[INST\]|<s>)|(?:\[/INST\]|</s>)$", "")
        corte = F.instr(dentro, "\n")
        return F.struct(
            _rol_leido(F.substring(dentro, F.lit(1), corte - 1)).alias("role"),
            desescapar(F.substring(dentro, corte + 1, F.length(dentro))).alias("text"),
        )

    def tapado(s: Column) -> Column:
        return desescapar(F.substring(F.col("formatted"), s["start"].cast("int") + 1,
                                      (s["end"] - s["start"]).cast("int")))

    return formateadas.withColumns({
        "turns": F.transform(F.regexp_extract_all("formatted", F.lit(TURNO), F.lit(0)), turno),
        "loss_text": F.array_join(F.transform("loss_spans", tapado), ""),
    })


def hilos_de_turnos(
    conversaciones: DataFrame, conv: str = "conv_id", turno: str = "turn", rol: str = "role",
    texto: str = "text",
) -> DataFrame:
    """Plain conversations as reply trees: each row answers the one before it.

    Rows go by turn (null first), then role and text; equal rows are separate turns.
    """
    w = Window.partitionBy(conv).orderBy(turno, rol, texto)
    return conversaciones.select(
        F.col(conv).alias("tree_id"), F.row_number().over(w).cast("long").alias("message_id"),
        F.col(rol).alias("role"), F.col(texto).alias("text"),
    ).withColumn("parent_id", F.col("message_id") - 1)
