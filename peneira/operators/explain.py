"""Why a finding was made: reasons, checks, context and source in words. The wordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.confidence import percent
from peneira.functions.normalize import after, before
from peneira.functions.validators import cnpj_valid, cpf_valid, digits

SOURCES = {"regex": "Regex (padrão)", "bert": "BERT NER (monilouise/ner_news_portuguese)", "nuner": "NuNER (numind/NuNER_Zero)", "spacy": "spaCy (pt_core_news_lg)", "presidio": "Presidio Analyzer", "gatilho": "Gatilho linguístico contextual"}
VOTES = {"documento_validado": "✓ Documento com validação de integridade", "dado_sensivel_lgpd": "✓ Dado sensível LGPD (proteção especial)", "peso_alto": "✓ Alta relevância (peso ≥ 4)", "gatilho_linguistico": "✓ Contexto linguístico confirma PII", "votacao_2_fontes": "✓ Confirmado por 2+ engines", "votacao_3_fontes": "✓ Confirmado por 3+ engines", "alta_confianca": "✓ Alta confiança (≥ 85%)", "confianca_moderada_evitar_fn": "⚠ Confiança moderada (70-85%)"}
OWN_WORDS = ("meu", "minha", "moro", "resido", "telefone", "celular", "contato", "cpf", "email")


def reason(kind: Column, value: Column) -> Column:
    d = digits(value)
    return (
        F.when(kind == "CPF", "✓ Formato XXX.XXX.XXX-XX identificado")
        .when(kind == "CNPJ", "✓ Formato XX.XXX.XXX/XXXX-XX identificado")
        .when(kind.isin("TELEFONE", "CELULAR"), F.when(F.length(d) >= 10, "✓ Telefone com DDD identificado").when(F.length(d) >= 8, "✓ Telefone sem DDD identificado"))
        .when(kind == "EMAIL_PESSOAL", "✓ Formato de email identificado")
        .when(kind == "NOME", "✓ Nome próprio identificado")
        .when(kind == "ENDERECO_RESIDENCIAL", "✓ Endereço residencial identificado")
        .when(kind == "PROCESSO_SEI", "✓ Número de processo SEI/GDF identificado")
        .when(kind == "DADO_SAUDE", "✓ Dado de saúde sensível (LGPD Art. 5º, II)")
        .when(kind == "MENOR_IDENTIFICADO", "✓ Menor de idade identificado")
        .when(kind == "CONTA_BANCARIA", "✓ Dados bancários identificados")
        .when(kind.isin("RG", "CNH", "PIS", "CTPS", "PASSAPORTE"), F.concat(F.lit("✓ Documento "), kind, F.lit(" identificado")))
        .otherwise(F.concat(F.lit("✓ "), kind, F.lit(" identificado por padrão")))
    )


def check(kind: Column, value: Column, source: Column) -> Column:
    d, up = digits(value), F.upper(value)
    ner = F.when(source == "bert", "BERT NER").when(source == "nuner", "NuNER").when(source == "spacy", "spaCy NER")
    return (
        F.when((kind == "CPF") & (F.length(d) >= 11), F.when(cpf_valid(F.substring(d, 1, 11)), "✓ Dígito verificador válido (mod 11)").otherwise("⚠ Dígito verificador inválido (possível erro de digitação)"))
        .when((kind == "CNPJ") & (F.length(d) >= 14), F.when(cnpj_valid(F.substring(d, 1, 14)), "✓ Dígito verificador válido").otherwise("⚠ Dígito verificador inválido"))
        .when(kind.isin("TELEFONE", "CELULAR") & (d.startswith("9") | (F.substring(d, 3, 1) == "9")), "✓ Padrão de celular (começa com 9)")
        .when((kind == "EMAIL_PESSOAL") & ~F.lower(value).rlike(r"\.gov\.br|\.org\.br|\.edu\.br"), "✓ Domínio pessoal (não institucional)")
        .when(kind == "NOME", F.when(source == "bert", F.concat(F.lit("✓ Confirmado por modelo "), ner)).when(source == "nuner", F.concat(F.lit("✓ Confirmado por modelo "), ner)).when(source == "spacy", F.concat(F.lit("✓ Confirmado por "), ner)))
        .when((kind == "ENDERECO_RESIDENCIAL") & up.rlike("SQN|SQS|SHIN|SHIS|QNM|CLSW"), "✓ Padrão de endereço de Brasília/DF")
        .when(kind == "PROCESSO_SEI", "✓ Formato XXXXX-XXXXXXXX/AAAA-XX")
        .when(kind == "DADO_SAUDE", "⚠ Categoria especial - proteção reforçada")
        .when(kind == "MENOR_IDENTIFICADO", "⚠ Proteção especial (ECA + LGPD)")
        .when(kind == "CONTA_BANCARIA", "✓ Contexto bancário detectado")
        .when(kind.isin("RG", "CNH", "PIS", "CTPS", "PASSAPORTE"), "✓ Formato válido")
    )


def explained(findings: DataFrame, context: Column | None = None) -> DataFrame:
    """Adds ``explicacao``. ``context``: lower-case text within 50 characters of the span, or null."""
    kind, value, source = F.col("tipo"), F.col("valor"), F.col("source")
    voted = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in VOTES.items() for x in kv)), F.col("votacao_motivo")), F.col("votacao_motivo"))
    near = F.lit(None).cast("string") if context is None else context
    own = F.get(F.filter(F.array(*(F.lit(w) for w in OWN_WORDS)), lambda w: F.contains(near, w)), F.lit(0))
    box = lambda *c: F.array_compact(F.array(*c))
    return findings.withColumn(
        "explicacao",
        F.struct(
            box(reason(kind, value), voted).alias("motivos"),
            box(F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SOURCES.items() for x in kv)), source), source)).alias("fontes"),
            box(check(kind, value, source)).alias("validacoes"),
            box(F.when(own.isNotNull(), F.concat(F.lit("✓ Contexto pessoal: '"), own, F.lit("' encontrado")))).alias("contexto"),
            percent("confianca").alias("confianca_percent"),
            F.col("peso").alias("peso"),
        ),
    )


def near_text(text: Column, start: Column, end: Column) -> Column:
    """Lower-case text within 50 characters of a span, on either side."""
    return F.lower(F.concat_ws("\n", before(text, start, 50), after(text, end, 50)))
