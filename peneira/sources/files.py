"""Reading batches of texts and writing results.

Sheets come as CSV or XLSX with a text and an id column under any of several headings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peneira.sources import sheets

# Headings in order of preference.
TEXT_HEADINGS = ("texto mascarado", "texto", "text", "mensagem", "descricao", "descrição", "conteudo", "conteúdo", "manifestacao", "manifestação", "solicitacao", "pedido", "teor")
ID_HEADINGS = ("id", "codigo", "código", "protocolo", "numero", "número", "identificador", "ref")


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(path)


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1, schema: str | None = None) -> DataFrame:
    """Sheets of one workbook or of many; ``schema`` picks columns by heading."""
    sheets.register(spark)
    reader = spark.read.format("sheet").option("sheet", sheet)
    return (reader if schema is None else reader.schema(schema)).load(path)


def read_inline(spark: SparkSession, items: list[dict], most: int = 200) -> DataFrame:
    """A batch of ``{id, text}``; more than ``most`` are refused."""
    if len(items) > most:
        raise ValueError(f"a batch has at most {most} items")
    return spark.createDataFrame([(str(x.get("id")) if x.get("id") is not None else None, x.get("text")) for x in items], "id string, text string")


def _find(columns: list[str], wanted: tuple[str, ...]) -> str | None:
    low = {c.strip().lower(): c for c in reversed(columns)}
    for name in wanted:
        if name in low:
            return low[name]
    return next((c for name in wanted for c in columns if name in c.lower()), None)


def text_column(columns: list[str]) -> str:
    """The text column: an exact heading, else one that contains a heading, else the first."""
    return _find(columns, TEXT_HEADINGS) or columns[0]


def id_column(columns: list[str]) -> str | None:
    return _find(columns, ID_HEADINGS)


def numbered(rows: DataFrame, name: str = "_row") -> DataFrame:
    """Adds the row number from 0 on, in the order of the partitions: a row's place in its own, and the counts of those before."""
    at = F.col("_at")
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    counts = placed.groupBy(F.shiftright(at, 33).alias("_part")).agg(F.count("*").alias("_n"))
    # one row for each partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", F.shiftright(at, 33)).join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_before") + at.bitwiseAND((1 << 33) - 1)).select(*(F.col(f"`{c}`") for c in rows.columns), name)


def documents(rows: DataFrame) -> DataFrame:
    """row, id, text from a sheet; blank texts are dropped, the row number of the sheet stays."""
    text, ident = text_column(rows.columns), id_column(rows.columns)
    rows = numbered(rows)
    row_id = F.coalesce(F.col(f"`{ident}`").cast("string"), (F.col("_row") + 1).cast("string")) if ident else (F.col("_row") + 1).cast("string")
    return rows.select(F.col("_row").alias("row"), row_id.alias("id"), F.trim(F.col(f"`{text}`")).alias("text")).where(F.length("text") > 0)


def loose_text(rows: DataFrame) -> Column:
    """``texto``, else ``Texto``, else the whole row as JSON; empty counts as missing."""
    named = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in ("texto", "Texto") if c in rows.columns]
    return F.coalesce(*named, F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))))


def normal_heading(name: str) -> str:
    return "".join(c for c in name.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def violations(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """The first row (as a sheet numbers it, headings being row 1) without an id or a text; none if all is well."""
    lines = numbered(rows).withColumn("linha", F.col("_row") + 2)
    blank = lambda c: F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) == ""
    bad = lines.where(blank(ident) | blank(text)).select("linha", F.when(blank(ident), "id").otherwise("texto").alias("falta"))
    return bad.orderBy("linha").limit(1)


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case names, acronyms and aliases of a nested JSON file."""
    raw = spark.read.option("multiLine", True).json(path)
    parts = None
    for c in raw.columns:
        e = raw.select(F.explode(c).alias("e"))
        terms = e.select(F.explode(F.concat(F.array("e.nome", "e.sigla"), F.coalesce("e.aliases", F.expr("cast(array() as array<string>)")))).alias("t"))
        parts = terms if parts is None else parts.unionByName(terms)
    return parts.select(F.trim(F.lower("t")).alias("termo")).where("termo is not null and termo <> ''").distinct()


_LABELS = {"critical": "Crítico", "high": "Alto", "moderate": "Moderado", "low": "Baixo", "safe": "Seguro"}


def export_rows(analyses: DataFrame) -> DataFrame:
    """Analyses as the ten report columns; findings as ``tipo: valor`` joined by ``; ``, or ``Nenhum``.

    Needs id, ts, type (``individual`` or other), text, classificacao, risco, confianca and entities (tipo, valor).
    The text is shown by its first 100 characters.
    """
    from peneira.functions.confidence import preview, shown_confidence, ui_level_of_risk

    listed = F.array_join(F.transform("entities", lambda e: F.concat(e["tipo"], F.lit(": "), e["valor"])), "; ")
    shown = shown_confidence("classificacao", "confianca")
    level = F.element_at(F.create_map(*(F.lit(x) for kv in _LABELS.items() for x in kv)), ui_level_of_risk(F.col("risco")))
    return analyses.select(
        F.col("id").alias("ID"), F.date_format("ts", "dd/MM/yyyy").alias("Data"), F.date_format("ts", "HH:mm").alias("Horário"),
        F.when(F.col("type") == "individual", "Individual").otherwise("Lote").alias("Tipo"), F.col("classificacao").alias("Classificação"),
        F.format_string("%.1f%%", shown * 100).alias("Confiança"), F.format_string("%.2f", shown).alias("Risco"), level.alias("Nível de Risco"),
        preview(F.col("text")).alias("Prévia do Pedido"), F.coalesce(F.nullif(listed, F.lit("")), F.lit("Nenhum")).alias("Dados Identificados"),
    )


def report_json(analyses: DataFrame) -> DataFrame:
    """The same analyses for a JSON report, with their findings nested."""
    from peneira.functions.confidence import preview, ui_level_of_risk

    return analyses.select(
        F.col("id"), F.date_format("ts", "dd/MM/yyyy").alias("data"), F.date_format("ts", "HH:mm").alias("horario"), F.col("type").alias("tipo"), "classificacao",
        F.col("confianca").alias("probabilidade"), ui_level_of_risk(F.col("risco")).alias("nivel_risco"), preview(F.col("text")).alias("previa_pedido"), F.col("entities").alias("dados_identificados"),
    )


def write_report(rows: DataFrame, path: str) -> None:
    """CSV parts with semicolons and a header, each part with a byte order mark."""
    first, *rest = rows.columns
    marked = rows.select(F.col(f"`{first}`").alias("\ufeff" + first), *(F.col(f"`{c}`") for c in rest))
    marked.write.option("header", True).option("sep", ";").option("quoteAll", False).csv(path)


def write_xlsx(rows: DataFrame, path: str, most: int = sheets.MOST) -> None:
    """A folder of workbooks, one for each part and for each ``most`` of its rows."""
    sheets.register(rows.sparkSession)
    rows.write.format("sheet").mode("append").option("name", "Classificação PII").option("most", most).save(path)


def write_json(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON lines in parts (those without rows are empty), or in one file, for reports of the size of one."""
    (rows.coalesce(1) if one_file else rows).write.json(path)


def feedback_spans(feedback: DataFrame) -> DataFrame:
    """Labelled spans for training a name model: text, start, end, label of rows marked right."""
    return feedback.where("validacao_humana = 'CORRETO' and inicio is not null").select("text", "inicio", "fim", F.col("tipo").alias("rotulo"))


def feedback_export(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All feedback records, and their counters by kind with a row of null kind for all."""
    from peneira.plans.feedback import counters

    return feedback.withColumn("exported_at", F.current_timestamp()), counters(feedback)


def write_feedback_export(feedback: DataFrame, path: str) -> None:
    """The records and the counters as JSON parts in two folders."""
    records, stats = feedback_export(feedback)
    records.write.json(f"{path}/feedbacks")
    stats.write.json(f"{path}/stats")
