"""Views over the star-schema tables that hold Portuguese texts, findings, spans and feedback.

The same SQL runs in Spark and in DuckDB; only the name of the string type differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _digits(expr: str, weights: list[int]) -> str:
    return "+".join(f"cast(substr({expr},{i},1) as int)*{w}" for i, w in enumerate(weights, 1))


def _check(expr: str, n: int) -> str:
    total = f"(({_digits(expr, list(range(n + 1, 1, -1)))})*10)%11"
    return f"case when {total}>=10 then 0 else {total} end"


def _cases(key: str, parts: list[str]) -> str:
    return "case " + " ".join(f"when {key}={i} then {p}" for i, p in enumerate(parts)) + " end"


_B9 = "lpad(cast(c_custkey as {T}),9,'1')"
_TEXTS = [
    "'Exemplo de CPF: '||f",
    "'Meu CPF é '||f||' e meu email é user'||cast(k as {T})||'@gmail.com'",
    "'O processo '||f||' foi arquivado'",
    "'Contato: ouvidoria'||cast(k as {T})||'@saude.df.gov.br'",
    "'Meu celular: (61) 9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)",
    "'Ramal da secretaria: (61) 3105-'||substr(cpf,6,4)",
    "'Me chamo Maria Souza, moro na quadra '||cast(k%90+10 as {T})||', CEP 7'||substr(cpf,6,4)||'-'||substr(cpf,3,3)",
    "'Solicito acesso ao Processo SEI 000'||substr(cpf,8,2)||'-'||substr(cpf,2,8)||'/2024-'||substr(cpf,10,2)",
]
_MORE = [
    "'CNPJ da empresa: '||substr(cpf,1,2)||'.'||substr(cpf,3,3)||'.'||substr(cpf,6,3)||'/0001-'||substr(cpf,10,2)",
    "'Meu CNPJ é '||substr(cpf,1,2)||'.'||substr(cpf,3,3)||'.'||substr(cpf,6,3)||'/0001-'||substr(cpf,10,2)||', sou MEI'",
    "'RG: '||substr(cpf,1,7)||' SSP/DF'",
    "'Minha CNH: '||cpf",
    "'Boleto, codigo de barras CNH: '||cpf",
    "'PIS: '||substr(cpf,1,3)||'.'||substr(cpf,4,5)||'.'||substr(cpf,9,2)||'-'||substr(cpf,11,1)",
    "'Cartão SUS 7'||cpf||'123'",
    "'Título de eleitor '||substr(cpf,1,4)||' '||substr(cpf,5,4)||' '||substr(cpf,8,4)",
    "'Passaporte AB'||substr(cpf,6,6)",
    "'CTPS: '||substr(cpf,5,7)||'/'||substr(cpf,1,5)||'-DF'",
    "'Processo OAB/DF '||substr(cpf,7,5)",
    "'Placa ABC'||substr(cpf,8,4)",
    "'Meu pix é '||substr(cpf,1,8)||'-1234-5678-9abc-'||cpf||'0'",
    "'Depositar na conta: '||substr(cpf,4,5)||' '||substr(cpf,1,8)",
    "'Nascimento: 1'||substr(cpf,9,1)||'/05/19'||substr(cpf,10,2)",
    "'Dona Lúcia, CID F'||substr(cpf,10,2)",
    "'Paciente Pedro Lima, '||cast(k%25 as {T})||' anos'",
    "'Matrícula: '||substr(cpf,4,7)",
    "'Inscrição imóvel: '||substr(cpf,3,9)",
    "'Protocolo LAI LAI-'||substr(cpf,6,6)||'/2024'",
    "'Ocorrência 20'||cpf||'77'",
    "'Moro na SQN '||substr(cpf,9,3)||' Bloco B'",
    "'Acesso via 10.'||cast(k%256 as {T})||'.0.7'",
    "'Sem dado pessoal no item '||cast(k as {T})",
]
#: Recognizer, sentence, and what it must find: kind, value, weight.
OTHERS = [
    ("RG_ORGAO", "'Identidade '||substr(cpf,1,7)||' SSP/DF'", "RG", "substr(cpf,1,7)||' '", 5),
    ("REGISTRO_ACADEMICO", "'Registro acadêmico: '||substr(cpf,1,8)||'7'", "REGISTRO_ACADEMICO", "substr(cpf,1,8)||'7'", 5),
    ("CERTIDAO", "'Consta 123456 01 55 2010 1 00012 123 12345'||substr(cpf,8,2)||' '||substr(cpf,10,2)", "CERTIDAO", "'123456 01 55 2010 1 00012 123 12345'||substr(cpf,8,2)||' '||substr(cpf,10,2)", 5),
    ("NIRE", "'A empresa tem NIRE: '||cpf", "NIRE", "cpf", 3),
    ("MATRICULA_IMOVEL", "'Matrícula nº '||substr(cpf,1,2)||'.'||substr(cpf,3,3)||' 2º RI'", "MATRICULA_IMOVEL", "substr(cpf,1,2)||'.'||substr(cpf,3,3)", 3),
    ("CDA", "'Certidão de Dívida Ativa nº '||substr(cpf,1,9)", "CDA", "substr(cpf,1,9)", 3),
    ("CDA_ADICIONAL", "'Inscrito em Dívida Ativa, guia paga e '||substr(cpf,1,9)", "CDA", "substr(cpf,1,9)", 3),
    ("AUTO_INFRACAO", "'Auto de Infração nº D-'||substr(cpf,1,4)||'-'||substr(cpf,5,6)", "AUTO_INFRACAO", "'D-'||substr(cpf,1,4)||'-'||substr(cpf,5,6)", 3),
    ("PROTOCOLO_OUV", "'Meu protocolo OUV-'||substr(cpf,6,6)||'/2024'", "PROTOCOLO_OUV", "'OUV-'||substr(cpf,6,6)||'/2024'", 3),
    ("PROTOCOLO_DFP", "'Registrado sob DFP'||substr(cpf,1,10)", "PROTOCOLO_DFP", "'DFP'||substr(cpf,1,10)", 3),
    ("PROTOCOLO_GENERICO", "'Solicito acesso ao protocolo: '||substr(cpf,1,5)||'.2024-11'", "PROTOCOLO_GENERICO", "substr(cpf,1,5)||'.2024-11'", 3),
    ("INSCRICAO_IMOVEL_15", "'Imóvel de número '||cpf||'1234'", "INSCRICAO_IMOVEL", "cpf||'1234'", 4),
    ("CARTAO_FINAL", "'Meu cartão de crédito final '||substr(cpf,8,4)||' foi cobrado'", "DADOS_BANCARIOS", "substr(cpf,8,4)", 4),
    ("DADO_BIOMETRICO", "'Anexei a impressão digital número '||cast(k as {T})", "DADO_BIOMETRICO", "'impressão digital'", 5),
    ("NOME_TITULO", "'Fui atendido por Dra. Ana Souza Lima, sala '||cast(k as {T})", "NOME", "'Ana Souza Lima'", 4),
    ("NOME_ASSINATURA", "'Item '||cast(k as {T})||' _____________ Rita Braga Lima'", "NOME", "'Rita Braga Lima'", 4),
    ("NOME_CARGO", "'Conversei com a servidora Paula Braga, sala '||cast(k as {T})", "NOME", "'Paula Braga'", 4),
    ("NOME_CONDOMINIO", "'O Edifício Carlos Gomes tem '||cast(k as {T})||' salas'", "NOME", "'Carlos Gomes'", 4),
    ("TELEFONE_DDI", "'Meu telefone: +55 61 9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)", "TELEFONE", "'+55 61 9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)", 4),
    ("TELEFONE_INTERNACIONAL", "'Meu telefone: +1 212 555 0'||substr(cpf,8,3)", "TELEFONE", "'+1 212 555 0'||substr(cpf,8,3)", 4),
    ("TELEFONE_CURTO", "'Meu celular: 9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)", "TELEFONE", "'9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)", 4),
    ("TELEFONE_FIXO", "'Meu telefone: (61) 3'||substr(cpf,6,3)||'-'||substr(cpf,2,4)", "TELEFONE", "'(61) 3'||substr(cpf,6,3)||'-'||substr(cpf,2,4)", 4),
    ("TELEFONE_DDD_HIFEN", "'Meu telefone: 61-9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)", "TELEFONE", "'61-9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)", 4),
    ("ENDERECO_MORO_EM", "'Eu moro na Vila Nova Casa '||cast(k%90+10 as {T})", "ENDERECO_RESIDENCIAL", "'Vila Nova Casa '||cast(k%90+10 as {T})", 4),
    ("ENDERECO_CONTEXTO_PESSOAL", "'Podem me encontrar na Vila da Rua Sete casa '||cast(k%90+10 as {T})", "ENDERECO_RESIDENCIAL", "'Vila da Rua Sete casa '||cast(k%90+10 as {T})", 4),
    ("ENDERECO_LABEL", "'Endereço: Vila Nova, Lote '||cast(k%90+10 as {T})", "ENDERECO_RESIDENCIAL", "'Vila Nova, Lote '||cast(k%90+10 as {T})", 4),
    ("ENDERECO_RESIDENCIAL", "'Resido com minha mãe, casa '||cast(k%90+10 as {T})", "ENDERECO_RESIDENCIAL", "'Resido com minha mãe, casa '||cast(k%90+10 as {T})", 4),
    ("ENDERECO_DF_RESIDENCIAL", "'Sou inquilina da CLN '||cast(k%90+110 as {T})||' Bloco B sala '||cast(k%90+10 as {T})", "ENDERECO_RESIDENCIAL", "'CLN '||cast(k%90+110 as {T})||' Bloco B sala '||cast(k%90+10 as {T})", 4),
    ("CONTA_BANCARIA_CONTEXTUAL", "'Minha conta corrente: '||substr(cpf,2,7)||'-1'", "CONTA_BANCARIA", "'Conta '||substr(cpf,2,7)||'-1'", 5),
    ("DADOS_BANCARIOS", "'Minha agência '||substr(cpf,2,4)||' conta '||substr(cpf,5,7)", "DADOS_BANCARIOS", "'Agência '||substr(cpf,2,4)||' Conta '||substr(cpf,5,7)", 4),
    ("CARTAO_CREDITO", "'Meu cartão é 4111 '||substr(cpf,1,4)||' '||substr(cpf,5,4)||' 1'||substr(cpf,9,3)", "DADOS_BANCARIOS", "'4111 '||substr(cpf,1,4)||' '||substr(cpf,5,4)||' 1'||substr(cpf,9,3)", 4),
    ("CELULAR_SEM_FORMATACAO", "'Meu telefone é 619'||substr(cpf,6,4)||substr(cpf,2,4)", "TELEFONE", "'619'||substr(cpf,6,4)||substr(cpf,2,4)", 4),
]
#: Sentence (by its recognizer), and what another recognizer finds in it.
BESIDE = [
    ("REGISTRO_ACADEMICO", "CELULAR_SEM_FORMATACAO", "TELEFONE", "substr(cpf,1,8)||'7'", 3), ("CDA", "CELULAR_SEM_FORMATACAO", "TELEFONE", "substr(cpf,1,9)", 3),
    ("CDA_ADICIONAL", "CELULAR_SEM_FORMATACAO", "TELEFONE", "substr(cpf,1,9)", 3), ("PROTOCOLO_DFP", "CELULAR_SEM_FORMATACAO", "TELEFONE", "substr(cpf,1,10)", 3),
    ("TELEFONE_DDI", "TELEFONE_CURTO", "TELEFONE", "'9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)", 4), ("TELEFONE_FIXO", "TELEFONE_CURTO", "TELEFONE", "'3'||substr(cpf,6,3)||'-'||substr(cpf,2,4)", 4),
    ("TELEFONE_DDD_HIFEN", "TELEFONE_CURTO", "TELEFONE", "'9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)", 4), ("ENDERECO_MORO_EM", "ENDERECO_RESIDENCIAL", "ENDERECO_RESIDENCIAL", "'moro na Vila Nova Casa '||cast(k%90+10 as {T})", 4),
    ("ENDERECO_LABEL", "ENDERECO_RESIDENCIAL", "ENDERECO_RESIDENCIAL", "'Endereço: Vila Nova, Lote '||cast(k%90+10 as {T})", 4),
]
#: The same for recognizers whose findings others share, sentence by sentence.
REST = [
    ("'Celular 61 9'||substr(cpf,6,4)||' '||substr(cpf,2,4)||', favor ligar'", [("TELEFONE_DDD_ESPACO", "TELEFONE", "'61 9'||substr(cpf,6,4)||' '||substr(cpf,2,4)", 4)]),
    ("'Meu telefone: 061 9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)", [("TELEFONE_DDD_ZERO", "TELEFONE", "'061 9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)", 4), ("TELEFONE_LOCAL", "TELEFONE", "'9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)", 4)]),
    ("'Meu telefone é 9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)", [("TELEFONE_LOCAL", "TELEFONE", "'9'||substr(cpf,6,4)||'-'||substr(cpf,2,4)", 4)]),
    ("'Minha casa fica na SHIN QI '||cast(k%20+1 as {T})||' Conjunto 7 Casa 12'", [("ENDERECO_SHIN_SHIS", "ENDERECO_RESIDENCIAL", "'SHIN'", 4)]),
    ("'Moro na SHCE QUADRA '||cast(k%90+300 as {T})", [("ENDERECO_SETOR_DF", "ENDERECO_RESIDENCIAL", "'SHCE QUADRA '||cast(k%90+300 as {T})", 4)]),
    ("'Moro no SAS '||cast(k%9+1 as {T})||' Bloco B'", [("ENDERECO_SETOR_DF", "ENDERECO_RESIDENCIAL", "'SAS '||cast(k%9+1 as {T})||' Bloco B'", 4)]),
]
#: Sentences for the patterns that are scanned on request, with the match of each.
ON_REQUEST = [
    ("PROCESSO_CNJ", "'Processo 00'||substr(cpf,1,5)||'-56.2024.8.07.0001 em curso'", "'00'||substr(cpf,1,5)||'-56.2024.8.07.0001'"),
    ("MATRICULA", "'Minha matrícula: '||substr(cpf,1,3)||'.'||substr(cpf,4,3)||'-7 da escola'", "'matrícula: '||substr(cpf,1,3)||'.'||substr(cpf,4,3)||'-7'"),
    ("COORDENADAS_GEO", "'Fica em latitude: -15.7'||substr(cpf,7,4)||', longitude: -47.88212'", "'latitude: -15.7'||substr(cpf,7,4)||', longitude: -47.88212'"),
    ("COORDENADAS_GEO", "'O GPS -15.7'||substr(cpf,7,4)||' -47.88212 no local'", "'GPS -15.7'||substr(cpf,7,4)||' -47.88212'"),
    ("USER_AGENT", "'Navegador: Mozilla/5.0 (X11; Linux) Gecko/'||cpf", "'Navegador: Mozilla/5.0 (X11; Linux) Gecko/'||cpf"),
]
#: Sentences for the heuristics of whole texts: kind, value and start, or none.
HEURISTICS = [
    ("'Solicito cópia do meu tratamento de câncer, item '||cast(k as {T})", ("DADO_SAUDE", "'Tratamento de câncer'", 0)),
    ("'Isenção de imposto de renda de aposentado, tratamento de câncer '||cast(k as {T})", None),
    ("'Item '||cast(k%90+10 as {T})||'. Maria Souza Lima informou seu cpf no balcão'", ("NOME", "'Maria Souza Lima informou'", 9)),
    ("'Item '||cast(k%90+10 as {T})||'. O cidadão foi identificado como Pedro, na sala'", ("NOME", "'Pedro'", 41)),
    ("'O cidadão foi identificado como pedro, sala '||cast(k as {T})", None),
    ("'Item '||cast(k as {T})||': o paciente segue em tratamento  realizado de câncer'", ("DADO_SAUDE", "'Tratamento de câncer'", 0)),
]
#: Agents of browsers, programs and crawlers.
AGENTS = ["Mozilla/5.0 (X11; Linux x86_64) Gecko/20100101 Firefox/128.0", "Googlebot/2.1 (+http://www.google.com/bot.html)", "curl/8.5.0", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_5 like Mac OS X) Safari/604.1", "python-requests/2.32", "Mozilla/5.0 HeadlessChrome/126.0", "", "Wget/1.24", "Opera/9.80", "Java/17.0.2", "Mozilla/5.0 (compatible; AhrefsBot/7.0)", None, "Lynx/2.9"]
_SEQ = "cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_discount,l_extendedprice,l_tax) as int) as seq"

VIEWS = {
    "fx_cpf": f"select k, b9||cast(d1 as {{T}})||cast(case when k%5=0 then (d2+1)%10 else d2 end as {{T}}) as cpf, (k%5<>0) as dv_ok from (select *, {_check('b9||cast(d1 as {T})', 10)} as d2 from (select c_custkey as k, {_B9} as b9, {_check(_B9, 9)} as d1 from customer) a) b",
    "fx_text": f"select k as doc_id, {_cases('k%8', _TEXTS)} as text from (select k, cpf, substr(cpf,1,3)||'.'||substr(cpf,4,3)||'.'||substr(cpf,7,3)||'-'||substr(cpf,10,2) as f from fx_cpf) z",
    "fx_text2": f"select k as doc_id, {_cases('k%24', _MORE)} as text from fx_cpf",
    "fx_text3": f"select k as doc_id, {_cases(f'k%{len(OTHERS)}', [x[1] for x in OTHERS])} as text from fx_cpf",
    "fx_rest": f"select k as doc_id, {_cases(f'k%{len(REST)}', [x[0] for x in REST])} as text from fx_cpf",
    "fx_request": f"select k as doc_id, {_cases(f'k%{len(ON_REQUEST)}', [x[1] for x in ON_REQUEST])} as text from fx_cpf",
    "fx_heur": f"select k as doc_id, {_cases(f'k%{len(HEURISTICS)}', [x[0] for x in HEURISTICS])} as text from fx_cpf",
    "fx_agents": f"select event_id, {_cases(f'event_id%{len(AGENTS)}', ['null' if a is None else repr(a) for a in AGENTS])} as user_agent from events",
    "fx_findings": f"select l_orderkey as doc_id, {_SEQ}, case l_linenumber%4 when 0 then 'NOME' when 1 then 'TELEFONE' when 2 then 'CPF' else 'EMAIL_PESSOAL' end as tipo, case l_linenumber%4 when 0 then 'Ana '||substr('Souza Lima Braga',1,cast(5+l_partkey%12 as int)) when 1 then substr('61999998888',1,cast(3+l_suppkey%9 as int)) else 'v'||cast(l_partkey%3 as {{T}}) end as valor, round(0.5+l_discount*4,4) as confianca, cast(2+l_partkey%4 as int) as peso, case l_suppkey%4 when 0 then 'regex' when 1 then 'bert' when 2 then 'gatilho' else 'spacy' end as source from lineitem",
    "fx_spans": f"select l_orderkey as doc_id, {_SEQ}, cast(l_partkey%60 as int) as s, cast(l_partkey%60+1+cast(l_quantity as int)%12 as int) as e, round(1-l_discount,4) as score, case l_suppkey%3 when 0 then 'regex' when 1 then 'bert_ner' else 'spacy' end as fonte from lineitem",
    "fx_feedback": "select l_orderkey as fb_id, case l_partkey%4 when 0 then 'CPF' when 1 then 'NOME' when 2 then 'TELEFONE' else 'EMAIL_PESSOAL' end as tipo, case l_suppkey%3 when 0 then 'regex' when 1 then 'bert_ner' else 'spacy' end as fonte, round(1-l_discount*5,4) as confianca_modelo, case when l_linenumber%7=0 then 'PARCIAL' when l_returnflag='R' then 'INCORRETO' else 'CORRETO' end as validacao_humana from lineitem",
    "fx_scores": "select case l_suppkey%3 when 0 then 'regex' when 1 then 'bert_ner' else 'spacy' end as fonte, 'CPF' as tipo, cast((l_partkey*613+l_suppkey*97+l_linenumber*31)%1009 as double)/1009 as score, case when (l_orderkey*769+l_linenumber*331)%1200 < (l_partkey*613+l_suppkey*97+l_linenumber*31)%1009 then 1 else 0 end as label from lineitem",
    "fx_access": "select event_id, user_id as ip, ts, event_type from events",
}
_NEEDS = {"fx_cpf": "customer", "fx_text": "fx_cpf", "fx_text2": "fx_cpf", "fx_text3": "fx_cpf", "fx_rest": "fx_cpf", "fx_request": "fx_cpf", "fx_heur": "fx_cpf", "fx_agents": "events", "fx_findings": "lineitem", "fx_spans": "lineitem", "fx_feedback": "lineitem", "fx_scores": "lineitem", "fx_access": "events"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table where there is no view of that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base = _NEEDS[name]
    sql = VIEWS[name].replace("{T}", "string")
    head, _, tail = sql.rpartition(f"from {base}")
    df = spark.sql(f"{head}from {{{base}}}{tail}", **{base: view(spark, sf_dir, base)})
    # a generator, so that the optimizer doesn't repeat these long expressions wherever a column is used
    return df.select(F.inline(F.array(F.struct(*df.columns)))) if base in ("customer", "fx_cpf") else df


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    wanted: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                add(VIEWS[name])
                wanted.append(name)

    add(sql)
    ctes = ", ".join(f"{n} as ({VIEWS[n].replace('{T}', 'varchar')})" for n in wanted)
    sql = sql.strip()
    if not ctes:
        return sql
    for head in ("with recursive ", "with "):
        if sql.lower().startswith(head):
            return f"{head}{ctes}, {sql[len(head):]}"
    return f"with {ctes} {sql}"
