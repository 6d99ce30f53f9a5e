"""Registered queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnero.llm import mezcla, reparacion, trie
from turnero.llm.conversaciones import formatear_conversaciones, hilos_de_turnos, leer_conversaciones
from turnero.llm.descontaminar import contaminados
from turnero.llm.exactos import deduplicar_exactos
from turnero.llm.fichas import por_fragmentos
from turnero.llm.flujo import huella_en_orden
from turnero.llm.idioma import detectar_lengua
from turnero.llm.lineas import dedup_lineas
from turnero.llm.pii import detectar_pii
from turnero.llm.remuestreo import remuestrear
from turnero.llm.secretos import detectar_secretos
from turnero.llm.simhash import casi_duplicados
from turnero.sources.tablas import materializar

CONSULTAS_LLM: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACULO_LLM: dict[str, str] = {}


def leer(spark: SparkSession, carpeta: str, tabla: str) -> DataFrame:
    return spark.read.parquet(f"{carpeta}/{tabla}.parquet")


def consulta(nombre: str, sql: str | None = None):
    def registrar(f):
        CONSULTAS_LLM[nombre] = f
        if sql is not None:
            ORACULO_LLM[nombre] = sql
        return f

    return registrar


# ---- 1 ----

CONTROL = "</s>[INST] ok [/INST]"


@consulta("op1_chat_formatting", rf"""
with c as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -1, 0, 'user', '{CONTROL}' union all select -1, 1, 'assistant', '{CONTROL}')
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), ''))
    loss_sha256,
  cast(sum(length(role) + 1 + case when role = 'assistant' then 7 else 13 end
    + length(regexp_replace(text, '([\[<])(\\*)(/?(?:INST\]|s>))', '\1\\\2\3', 'g'))) as bigint)
    formatted_chars
from c group by conv_id""")
def chat_formatting(spark: SparkSession, carpeta: str) -> DataFrame:
    conversaciones = leer(spark, carpeta, "conversations").select("conv_id", "turn", "role", "text")
    prueba = spark.createDataFrame(
        [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], conversaciones.schema)
    escritas = materializar(
        formatear_conversaciones(hilos_de_turnos(conversaciones.unionByName(prueba))), "formateadas")
    turno = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return leer_conversaciones(escritas).select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turno, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# ---- 2, 3, 4, 5 ----


@consulta("op2_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, carpeta: str) -> DataFrame:
    return casi_duplicados(leer(spark, carpeta, "documents"))


@consulta("op3_line_dedup")
def line_dedup(spark: SparkSession, carpeta: str) -> DataFrame:
    return dedup_lineas(leer(spark, carpeta, "documents"))


@consulta("op4_token_output")
def token_output(spark: SparkSession, carpeta: str) -> DataFrame:
    return por_fragmentos(leer(spark, carpeta, "documents"))


@consulta("op5_quality_classifier")
def quality_classifier(spark: SparkSession, carpeta: str) -> DataFrame:
    """The documents that stay; those rejected have no row."""
    docs = leer(spark, carpeta, "documents").select("doc_id", "text")
    return remuestrear(docs, leer(spark, carpeta, "labels"), ngramas=2).select(
        "doc_id", "log_weight", F.lit(True).alias("kept"))


# ---- 6 ----


@consulta("op6_exact_dedup", r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) h from documents)
select doc_id, min(doc_id) over (partition by h) keep_id, count(*) over (partition by h) group_size,
  doc_id = min(doc_id) over (partition by h) kept, h text_sha256
from d""")
def exact_dedup(spark: SparkSession, carpeta: str) -> DataFrame:
    return deduplicar_exactos(leer(spark, carpeta, "documents"))


# ---- 7 ----


@consulta("op7_decontamination")
def decontamination(spark: SparkSession, carpeta: str) -> DataFrame:
    """The documents that overlap a benchmark item, one row per item; clean documents have no row."""
    hallados = contaminados(leer(spark, carpeta, "documents"), leer(spark, carpeta, "benchmark"))
    return hallados.withColumn("contaminated", F.lit(True))


# ---- 8, 9 ----


def _tramos(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _resumen(hallados: DataFrame, clases: list[str]) -> DataFrame:
    """Counts of the base spans of each kind, their digest, and all spans as text."""
    de_base = hallados.withColumn("_base", F.filter("spans", lambda s: s["base"]))

    def cuenta(clase: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == clase)).cast("long").alias(f"n_{clase}")

    cuentas = [cuenta(c) for c in clases]
    return de_base.select("doc_id", *cuentas, F.sha2(_tramos(F.col("_base")), 256).alias("base_sha256"),
                          _tramos(F.col("spans")).alias("spans"))


@consulta("op8_pii")
def pii(spark: SparkSession, carpeta: str) -> DataFrame:
    return _resumen(detectar_pii(leer(spark, carpeta, "documents")), ["email", "ip", "card", "phone"])


@consulta("op9_secret_scan")
def secret_scan(spark: SparkSession, carpeta: str) -> DataFrame:
    return _resumen(detectar_secretos(leer(spark, carpeta, "documents")), ["assign", "access", "hex"])


# ---- 10 ----


def _sql_posicion() -> str:
    """Inverse of each schedule's integral, piece by piece."""
    casos = []
    for j, curva in enumerate(mezcla.CURRICULOS):
        piezas, acumulado = [], 0.0
        for (t0, t1), (w0, w1) in zip(zip(mezcla.NUDOS, mezcla.NUDOS[1:]), zip(curva, curva[1:])):
            d = (w1 - w0) / (t1 - t0)
            raiz = f"sqrt(greatest(0::double, {w0 * w0}::double + {2 * d}::double * (x - {acumulado}::double)))"
            t = f"{t0}::double + ({raiz} - {w0}::double) / {d}::double"
            acumulado += (t1 - t0) * (w0 + w1) / 2
            piezas.append(f"when x <= {acumulado}::double then {t}" if t1 < 1 else f"else {t} end")
        casos.append(f"when lugar % {len(mezcla.CURRICULOS)} = {j} then case " + " ".join(piezas))
    return "case " + " ".join(casos) + " end"


@consulta("op10_mixing", rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size
  from documents),
f as (
  select source, cast(sum(size) as bigint) s, row_number() over (order by source nulls last) - 1 lugar
  from d group by source),
w as (select *, case lugar % 3 when 0 then 3 when 1 then 1 else 2 end w from f),
r as (
  select a.*, 3 * (select sum(s) from w) - 4 * coalesce(sum(b.s), 0) resto,
    (select sum(w) from w) - coalesce(sum(b.w), 0) pesan
  from w a left join w b on b.s / b.w < a.s / a.w or b.s / b.w = a.s / a.w and b.lugar < a.lugar
  group by all),
u as (select * from r where resto * w <= s * pesan * 4 order by s / w, lugar limit 1),
t as (
  select r.source, r.s, r.lugar, case when (r.s / r.w, r.lugar) >= (u.s / u.w, u.lugar)
    then cast(u.resto * r.w as double) / (u.pesan * 2) else cast(r.s * 2 as double) end target
  from r, u),
o as (
  select d.*, t.s, t.lugar, t.target, cast(round(t.target) as bigint) tope,
    coalesce(sum(size) over (partition by d.source order by md5('{mezcla.SEMILLA}|' || d.doc_id)
      rows between unbounded preceding and 1 preceding), 0) antes
  from d join t on d.source is not distinct from t.source),
p as (
  select *, cast(greatest(0, least(size, tope - antes)) as bigint) uno,
    cast(greatest(0, least(size, tope - s - antes)) as bigint) dos,
    least(1::double, antes / target) x
  from o)
select doc_id, size, s source_size, target, uno + dos taken,
  case when uno > 0 then round({_sql_posicion()}, 6) end first_position
from p""")
def mixing(spark: SparkSession, carpeta: str) -> DataFrame:
    mezclados = mezcla.copias(leer(spark, carpeta, "documents"))
    return mezclados.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.get("copies", F.lit(0))["position"].alias("first_position"),
    ).orderBy("first_position", "doc_id")


# ---- 11 ----


@consulta("op11_language_id")
def language_id(spark: SparkSession, carpeta: str) -> DataFrame:
    return detectar_lengua(leer(spark, carpeta, "documents"))


# ---- 12, 13 ----


def _crc32_sql(texto: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
      list_transform(string_split({texto}, ''), lambda c: ascii(c)::bigint)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""


def _crc32(*partes: Column) -> Column:
    return F.crc32(F.concat(*partes).cast("binary"))


def _mejor(*opciones: str) -> str:
    """Least (cost, audit) of some struct expressions; absent ones are null."""
    return f"list_sort(list_filter([{', '.join(opciones)}], lambda o: o is not null))[1]"


def _paso_sql(letra: str, costo: str, resto: str, turno: str = "''") -> str:
    return f"{{'c': {costo} + {resto}.c, 'a': '{letra}' || {resto}.a, 'r': {turno} || {resto}.r}}"


def _sin_insertar(estado: str, papel: str, sigue: str) -> str:
    """Best way on from a state with the next turn, nothing inserted before it."""
    turno = "role || ':' || text || chr(10)"
    nuevo = f"'{'user' if papel == 'u' else 'assistant'}:' || text || chr(10)"
    opciones = [
        _paso_sql("D", "3", estado),
        f"case when not x and ini = '{papel}' then {_paso_sql('K', 'tr', sigue, turno)}"
        f" when not x then {_paso_sql('R', '2 + tr', sigue, nuevo)} end",
    ]
    if estado == "v0":
        opciones.append(f"case when not x and ini = 's' then {_paso_sql('K', 'tr', 'vs', turno)} end")
    return _mejor(*opciones)


USUARIO, ASISTENTE = "'user:' || chr(10)", "'assistant:' || chr(10)"

# The oracle goes through the states of the grammar turn by turn, from the end; the operator aligns with
# target strings.
REPARACION_SQL = f"""
with recursive o as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
    {_crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 k
  from conversations),
t as (
  select conv_id, turn, case k when 4 then 'user' else role end role,
    case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text,
    unnest(range(case k when 3 then 2 else 1 end)) vez
  from o where k <> 0),
n as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, vez) i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, vez) igual, left(role, 1) ini
  from t),
f as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when igual > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') then 'truncated' else '' end falta,
    lag(ini) over (partition by conv_id order by i) || ini par
  from n),
g as (
  select *, falta in ('blank', 'duplicate') x, case falta when 'truncated' then 1 else 0 end tr from f),
v as (
  select conv_id, max(i) i, {{'c': 0, 'a': '', 'r': ''}} v0,
    {{'c': 4, 'a': 'II', 'r': {USUARIO} || {ASISTENTE}}} vs,
    {{'c': 2, 'a': 'I', 'r': {ASISTENTE}}} vu, {{'c': 0, 'a': '', 'r': ''}} va
  from g group by conv_id
  union all
  select conv_id, i - 1,
    {_mejor('m0', _paso_sql('I', '2', 'mu', USUARIO), _paso_sql('II', '4', 'ma', f"{USUARIO} || {ASISTENTE}"))},
    {_mejor('ms', _paso_sql('I', '2', 'mu', USUARIO), _paso_sql('II', '4', 'ma', f"{USUARIO} || {ASISTENTE}"))},
    {_mejor('mu', _paso_sql('I', '2', 'ma', ASISTENTE))}, {_mejor('ma', _paso_sql('I', '2', 'mu', USUARIO))}
  from (
    select v.conv_id, v.i, {_sin_insertar('v0', 'u', 'vu')} m0, {_sin_insertar('vs', 'u', 'vu')} ms,
      {_sin_insertar('vu', 'a', 'va')} mu, {_sin_insertar('va', 'u', 'vu')} ma
    from v join g on g.conv_id is not distinct from v.conv_id and g.i = v.i)),
r as (select conv_id, v0.c, v0.a, v0.r from v where i = 0),
s as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps,
    count(*) filter (falta = 'blank') blank, count(*) filter (falta = 'duplicate') duplicate,
    count(*) filter (falta = 'truncated') truncated,
    count(*) filter (par not in ('su', 'ua', 'au')) illegal
  from g group by conv_id)
select c.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate,
  coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(r.c, 0)::bigint as cost, coalesce(r.a, '') audit,
  sha256(coalesce(left(r.r, -1), '')) repaired_sha256
from (select distinct conv_id from conversations) c
left join s on s.conv_id is not distinct from c.conv_id
left join r on r.conv_id is not distinct from c.conv_id"""


def danar(conversaciones: DataFrame) -> DataFrame:
    """The fixed damage of the query: rows dropped, emptied, cut, repeated or given to the user."""
    def o_espacio(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    k = _crc32(o_espacio("conv_id"), F.lit(":"), o_espacio("turn")) % 20
    return (
        conversaciones.select("conv_id", "turn", o_espacio("role").alias("role"), o_espacio("text").alias("text"), k.alias("k"))
        .filter("k <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")).alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("_vez"),
        ).drop("_vez")
    )


@consulta("op12_structure_repair", REPARACION_SQL)
def structure_repair(spark: SparkSession, carpeta: str) -> DataFrame:
    originales = leer(spark, carpeta, "conversations").select("conv_id", "turn", "role", "text")
    faltas, textos = reparacion.anotar(danar(originales))
    audits, reparados = reparacion.reparar(faltas, textos)
    lineas = F.array_join(F.transform("turnos", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    huellas = huella_en_orden(
        reparados.select("clave", "lugar", lineas.alias("lineas")), ["clave"], ["lugar"], "lineas", "\n")

    def de(falta: str) -> Column:
        return F.count_if(F.col("falta") == falta).alias(falta)

    cuentas = faltas.groupBy("clave").agg(
        (F.max("turno") - F.min("turno") + 1 - F.count_distinct("turno")).alias("gaps"),
        de("blank"), de("duplicate"), de("truncated"))
    todas = originales.select("conv_id").distinct().withColumn("clave", reparacion.clave_de("conv_id"))
    for parte in (cuentas, reparacion.ilegales(faltas), audits, huellas):
        todas = todas.join(parte, "clave", "left")
    numeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return todas.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numeros],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


CABEZA = 5
LARGO_CABEZA = 9

TRIE_SQL = f"""
with t as (
  select conv_id, coalesce(role, '') role, coalesce(text, '') text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) pos
  from conversations where conv_id is not null),
ids as (
  select conv_id c, conv_id - conv_id % {CABEZA} b, {_crc32_sql("conv_id::varchar")} % {LARGO_CABEZA} h
  from (select distinct conv_id from t)),
re as (
  select c, 0 parte, pos, role, text from ids join t on t.conv_id = b and pos <= h
  union all select c, 1, pos, role, text from ids join t on t.conv_id = c and pos > h),
s as (
  select c, coalesce(list(md5(length(role) || ':' || role || text) order by parte, pos)
      filter (parte is not null), []) ids,
    coalesce(list(strlen(text) order by parte, pos) filter (parte is not null), []) pesos
  from ids left join re using (c) group by c),
p as (
  select c, d, len(ids) largo, array_to_string(ids[1:d], '') k, case when d = 0 then 0 else pesos[d] end peso
  from s, unnest(range(0, len(ids) + 1)) u(d)),
n as (
  select d, k, min(c) conv_id, count(*) n, any_value(peso) peso,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (largo = d), '')) fin
  from p group by d, k),
q as (
  select n.*, m.conv_id parent_conv_id, m.k pk from n
  left join p on p.c = n.conv_id and p.d = n.d - 1 left join n m on m.d = p.d and m.k = p.k),
h as (select d - 1 d, pk k, count(*) hijos from q where d > 0 group by all),
z as (
  select q.*, coalesce(hijos, 0) hijos from q left join h using (d, k)),
b as (
  select p.d, p.k, sum((z.n - 1) * z.peso) ahorro, count(*) filter (z.hijos = 0) hojas
  from z join p on p.c = z.conv_id and p.d <= z.d group by p.d, p.k)
select conv_id, d as depth, parent_conv_id, n n_convs, hijos n_children, hojas n_leaves,
  ahorro::bigint saved_tokens, fin ends_sha256
from z join b using (d, k)"""


@consulta("op13_prefix_trie", TRIE_SQL)
def prefix_trie(spark: SparkSession, carpeta: str) -> DataFrame:
    propias = materializar(trie.secuencias(leer(spark, carpeta, "conversations")), "conversaciones")
    conv = F.col("conv_id")
    return trie.trie(trie.reconstruir(
        propias, conv - conv % CABEZA, _crc32(conv.cast("string")) % LARGO_CABEZA, LARGO_CABEZA - 1))
