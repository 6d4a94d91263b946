"""Two further packs of patterns beside the engine's: a small one with context rules and heuristics, and a scored one.

Fixed values: the expressions, terms and scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.normalize import after, around, before
from peneira.functions.validators import digits
from peneira.operators.patterns import Pattern
from peneira.operators.scan import scan

_SEI = r"\b\d{4,5}[-\.]\d{5,10}/\d{4}(?:-\d{2})?\b|\b\d{5,13}/\d{4}(?:-\d{2})?\b|\bProcesso(?:\s+(?:SEI|n[°º]?|nº?))?\s*:?\s*\d{4,13}[-\./]?\d{0,10}/?(?:\d{4})?(?:-\d{2})?\b"
CONTEXTUAL = (
    Pattern("CNH", r"(?:(?:cnh|carteira de motorista|habilita[cç][aã]o|documento de identifica(?:ção|cao)?|minha cnh|meu documento|minha carteira|identidade civil|identidade|meu rg|minha identidade)[\s:;,.\-]*)?(\d{2}[\s\-\.]?\d{2}[\s\-\.]?\d{2}[\s\-\.]?\d{2,6})", 1),
    Pattern("CPF", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b|\b\d{11}\b|\b\d{3}\.\d{3}\.\d{3}-\d{1}\b|\b\d{3}\.\d{3}\.\d{3}\b", 0),
    Pattern("TELEFONE", r"(?<!\d)(\d{2}[\s-]?)?9?\d{4}[\s-]?\d{4}(?!\d)", 1),
    Pattern("MATRICULA_SERVIDOR", r"\b\d{7,8}[A-Za-zXx-]?\b", 0),
    Pattern("PROCESSO_SEI", _SEI, 0),
    Pattern("DADOS_BANCARIOS", r"(ag[êe]ncia|ag)\s*\d{3,4}\s*(conta( corrente| c/c| cc)?|c/c|cc)?\s*\d{5,8}-\d|conta:?\s*\d{5,8}-\d|cc:?\s*\d{5,8}-\d", 3),
    Pattern("CODIGO_BARRAS", r"\b\d{11,}\b", 0),
)
_CNH_WORDS = r"cnh|carteira de motorista|habilita[cç][aã]o|documento de identifica|minha cnh|meu documento|minha carteira|identidade civil|identidade|meu rg|minha identidade|portador da|portador do|registro n[uú]mero|documento n[uú]mero|n[uú]mero do documento"
_CNH_NOT = r"c[oó]digo de barras|boleto|linha digit[aá]vel|processo sei|sei[-/]"
_CPF_WORDS = r"cpf|contribuinte|titular|cadastro|precisa ser verificado|formato real|com d[ií]gito|com dv|n[uú]mero do cpf|cadastrado com cpf|documento|identifica[cç][aã]o"
_PHONE_WORDS = r"telefone|celular|tel[.:]|fone|contato|ligar|whatsapp|n[uú]mero de contato|meu n[uú]mero"
_BANK_WORDS = r"ag[eê]ncia|conta|banco|dep[oó]sito|transfer[eê]ncia|pix|pagamento|recebimento|c/c|cc|ag\."
_HEALTH = r"tratamento de c[aâ]ncer|diagn[oó]stico de c[aâ]ncer|laudo m[eé]dico|prontu[aá]rio|interna[cç][aã]o|alta m[eé]dica|consulta m[eé]dica|exame de sangue|receita m[eé]dica|atestado m[eé]dico|cid-?\d+|paciente portador|hist[oó]rico m[eé]dico|tratamento oncol[oó]gico"
_HEALTH_HINTS = ("diagn[oó]stico", "tratamento", "c[aâ]ncer", "doen[cç]a", "paciente", "exame", "cirurgia", "medica[cç][aã]o", "rem[eé]dio")
_AGE = r"\b(\d{1,2})\s*anos?\b"
_MINOR = r"estudante|aluno|aluna|escola|col[eé]gio|menor|crian[cç]a|adolescente|filho|filha|respons[aá]vel|guarda|tutor"
_MINOR_SAID = r"menor de idade|crian[cç]a identificad|adolescente identificad|aluno\s+\w+\s+\w+|estudante\s+\w+\s+\w+"

SCORED = (
    ("PROCESSO_SEI", "sei_padrao", r"\d{5}-\d{8}/\d{4}-\d{2}", 0.9), ("PROCESSO_SEI", "sei_ponto", r"\d{4,5}[.-]\d{5,10}/\d{4}(?:-\d{2})?", 0.85), ("PROCESSO_SEI", "sei_simples", r"\d{5,13}/\d{4}(?:-\d{2})?", 0.7),
    ("PROCESSO_CNJ", "cnj_padrao", r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}", 0.95),
    ("PROTOCOLO_LAI", "lai_padrao", r"LAI-?\d{5,8}/?\d{0,4}", 0.9), ("PROTOCOLO_LAI", "ouv_padrao", r"OUV-\d{5,8}/\d{4}", 0.9),
    ("MATRICULA_GDF", "mat_gdf", r"\d{2}-\d{4}-\d{1,4}", 0.85), ("MATRICULA_GDF", "mat_ponto", r"\d{2,3}\.\d{3}-\d", 0.8),
    ("INSCRICAO_CAESB", "caesb", r"(?:inscrição|inscricao)[:\s]*\d{6,9}-?\d?", 0.85),
    ("OAB_REGISTRO", "oab", r"OAB[/-]?[A-Z]{2}[:\s]*\d{2,6}", 0.9),
    ("TELEFONE_BR", "cel_ddd", r"\(\d{2}\)\s*9\d{4}-?\d{4}", 0.9), ("TELEFONE_BR", "tel_ddd", r"\(\d{2}\)\s*\d{4}-?\d{4}", 0.85), ("TELEFONE_BR", "cel_simples", r"\b9\d{4}-?\d{4}\b", 0.7),
    ("CEP_BR", "cep", r"\d{5}-?\d{3}", 0.7),
    ("CPF_BR", "cpf", r"\d{3}\.\d{3}\.\d{3}-\d{2}", 0.9), ("CPF_BR", "cpf_simples", r"\b\d{11}\b", 0.5),
    ("CNPJ_BR", "cnpj", r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}", 0.9),
    ("DATA_NASCIMENTO", "data_nasc", r"(?:nascimento|nasc\.?)[:\s]*\d{2}/\d{2}/\d{4}", 0.85), ("DATA_NASCIMENTO", "data_br", r"\(\d{2}/\d{2}/\d{4}\)", 0.7),
)


def _accepted(kind: Column, value: Column, text: Column, start: Column, end: Column, inside_process: Column) -> Column:
    low = F.lower(text)
    near = F.lower(around(text, start, end, 80))
    n = F.length(digits(value))
    labelled = near.rlike(_CNH_WORDS) | F.lower(before(text, start, 50)).rlike(_CNH_WORDS) | F.lower(after(text, end, 50)).rlike(_CNH_WORDS)
    cpf = ((n >= 11) | near.rlike(_CPF_WORDS)) & ((n != 9) | near.rlike("cpf:|meu cpf|cpf do"))
    return (
        F.when(kind == "CNH", ~near.rlike(_CNH_NOT) & (~n.isin(10, 12) | labelled))
        .when(kind == "CODIGO_BARRAS", ~low.rlike(r"cnh|carteira de motorista|habilita[cç][aã]o"))
        .when(kind == "MATRICULA_SERVIDOR", ~inside_process)
        .when(kind == "CPF", cpf)
        .when(kind == "TELEFONE", value.rlike(r"[-\s]") | F.lower(around(text, start, end, 60)).rlike(_PHONE_WORDS))
        .when(kind == "DADOS_BANCARIOS", near.rlike(_BANK_WORDS))
        .otherwise(True)
    )


def contextual(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, tipo, valor, inicio, fim: matches of the first pack that their context allows, and its two heuristics.

    A value is a pattern's first group where that has a part, else the whole match.
    """
    bodies = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = scan(bodies, CONTEXTUAL)
    value = F.coalesce("g1", "m")
    found = found.select("doc_id", "text", F.col("name").alias("tipo"), value.alias("valor"), "inicio", "fim")
    # places inside a process number, told by an aggregation of the document's process spans
    process = found.where("tipo = 'PROCESSO_SEI'").groupBy("doc_id").agg(F.collect_list(F.struct("inicio", "fim")).alias("_process"))
    joined = found.join(process, "doc_id", "left")
    inside = F.coalesce(F.exists("_process", lambda p: (p["inicio"] <= F.col("inicio")) & (F.col("fim") <= p["fim"])), F.lit(False))
    fine = joined.where(_accepted(F.col("tipo"), F.col("valor"), F.col("text"), F.col("inicio"), F.col("fim"), inside)).select("doc_id", "tipo", "valor", "inicio", "fim")
    return fine.unionByName(health(bodies)).unionByName(minors(bodies))


def _whole(docs: DataFrame, kind: str, value: str) -> DataFrame:
    return docs.select("doc_id", F.lit(kind).alias("tipo"), F.lit(value).alias("valor"), F.lit(0).alias("inicio"), F.length("text").alias("fim"))


def health(docs: DataFrame) -> DataFrame:
    """Texts with one strong sign of health data, or two weak ones."""
    low = F.lower("text")
    hints = sum((low.rlike(p).cast("int") for p in _HEALTH_HINTS), F.lit(0))
    return _whole(docs.where(low.rlike(_HEALTH) | (hints >= 2)), "DADO_SAUDE", "Dado sensível saúde (contexto)")


def minors(docs: DataFrame) -> DataFrame:
    """Texts whose first age is under 18 with a word for it, or, without any age, with a phrase that says so."""
    low = F.lower("text")
    age = F.nullif(F.regexp_extract(low, _AGE, 1), F.lit("")).cast("int")
    young = F.when(age.isNotNull(), (age < 18) & low.rlike(_MINOR)).otherwise(low.rlike("(?U)" + _MINOR_SAID))
    return _whole(docs.where(young), "MENOR_IDENTIFICADO", "Menor de idade identificado (contexto)")


def scored(docs: DataFrame, entities: Sequence[str] | None = None, least: float = 0.0, text: str = "text") -> DataFrame:
    """doc_id, entity, pattern, start, end, score, value of the scored pack; only some ``entities`` if they are named."""
    wanted = [(e, n, r, s) for e, n, r, s in SCORED if (entities is None or e in entities) and s >= least]
    bodies = docs.select("doc_id", F.col(text).alias("text"))
    if not wanted:
        return bodies.limit(0).select("doc_id", F.lit("").alias("entity"), F.lit("").alias("pattern"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("score"), F.lit("").alias("value"))
    found = scan(bodies, [Pattern(n, r, 0) for _, n, r, _ in wanted])
    entry = F.element_at(F.create_map(*(x for e, n, _, s in wanted for x in (F.lit(n), F.struct(F.lit(e).alias("entity"), F.lit(s).alias("score"))))), F.col("name"))
    return found.select("doc_id", entry["entity"].alias("entity"), F.col("name").alias("pattern"), F.col("inicio").alias("start"), F.col("fim").alias("end"), entry["score"].alias("score"), F.col("m").alias("value"))
