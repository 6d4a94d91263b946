"""Accept rules: which matches become findings, of what kind, value, weight and confidence.

A rule sees a match and the text around it and is a column expression, so all rules
run in the projection that scans. What a rule asks of the whole text is answered once for
the text (``_whole``), or for the match while the text is at hand (``_each``); the match
goes on with a slice of bounded size. Fixed values: the terms in the tuples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.confidence import finding_confidence
from peneira.functions.normalize import after, around, before, contains_any, fold_lower
from peneira.functions.validators import cnpj_valid, cpf_shape, cpf_valid, digits, iban_valid, luhn_valid, uniform
from peneira.operators.explain import near_text
from peneira.operators.names import suppressed
from peneira.operators.patterns import COMPLEMENT, PATTERNS, PHONES, Pattern
from peneira.operators.scan import GROUPS, once, slices

NUMBER_IN_PROCESS = r"\b\d{4,5}-\d{5,8}/\d{4}(?:-\d{2})?\b"

CPF_LABELS = ("meu cpf", "minha cpf", "conforme cadastro", "precisa ser verificado", "cpf do titular", "cpf contribuinte", "cadastrado com cpf", "cpf formato real", "cpf com dígito", "cpf com dv", "cpf:", "contribuinte", "titular", "o cpf", "seu cpf", "nome:", "e-mail:", "email:", "telefone:", "fone:", "celular:", "endereço:", "cpf da mãe", "cpf do pai", "cpf mãe", "cpf pai", "filiação")
CPF_FICTION = ("INVALIDO", "INVÁLIDO", "FALSO", "FICTICIO", "FICTÍCIO", "EXEMPLO", "TESTE", "FAKE", "GENERICO", "GENÉRICO", "000.000.000-00", "111.111.111-11", "XXX.XXX.XXX-XX", "CODIGO DE BARRAS", "CÓDIGO DE BARRAS", "COD BARRAS")
LEGAL = ("decreto", "lei ", "lei:", "portaria", "resolução", "resolucao", "instrução normativa", "instrucao normativa", "edital")
FEDERAL = ("cgu", "tcu", "stf", "stj", "pgr", "mpu", "advocacia geral", "ministerio", "ministério", "receita federal", "inss", "ibama", "anatel", "anvisa", "ana ", " ana,", "caixa federal")
REFERENCE = ("referência:", "referencia:", "ref:", "conforme ", "considerando o processo", "proc.")
PROTOCOL_LABELS = ("protocolo lai", "protocolo ouv", "lai-", "ouv-")
PROTOCOL_NOT = ("exemplo", "referencia", "nao e protocolo", "nao protocolo", "nao e valido")
PROCESS_NOT = ("nao e um processo", "exemplo de processo", "exemplo de protocolo", "nao e valido")
PROCESS_LABELS = ("processo sei", "processo no", "processo administrativo", "autos do processo", "acesso ao processo")
OWNED = ("meu processo", "minha processo", "do requerente", "do cidadao", "do solicitante", "do interessado", "do titular", "do usuario", "do paciente", "do denunciante", "do autor", "do beneficiario", "do responsavel", "referente ao processo", "processo do", "processo da", "solicito acesso", "gostaria de acesso", "acesso aos autos", "acesso externo", "consultar o andamento")
EXAMPLE = ("exemplo", "referência", "referencia", "não é ocorrência", "nao é ocorrência")
CNPJ_PROCESS = ("PROCESSO SEI", "PROCESSO Nº", "PROCESSO N°", "PROCESSO NUMERO", "AUTOS DO PROCESSO", "PROCESSO ADMINISTRATIVO", "SEI Nº", "SEI N°")
CNPJ_COMPANY = ("CNPJ", "EMPRESA", "RAZÃO SOCIAL", "MEI", "PESSOA JURÍDICA")
CNPJ_OWN = ("MEU CNPJ", "MINHA EMPRESA", "SOU MEI")
PHONE_PROCESS = ("PROCESSO", "PROTOCOLO", "SEI", "AUTUAÇÃO", "AUTUACAO", "NIRE")
PHONE_WORDS = ("TEL", "FONE", "CELULAR", "CONTATO")
PHONE_NOT = ("código", "codigo", "referência", "referencia", "ref:", "ref.", "número do pedido", "numero do pedido", "nº pedido", "n° pedido", "ordem de serviço", "ordem de servico", "o.s.:", "o.s. n", "ticket", "chamado", "solicitação nº", "solicitacao n", "versão", "versao", "modelo", "série", "serie", "lote nº", "lote n°", "item nº", "item n°", "artigo", "parágrafo", "paragrafo")
PHONE_CALL = ("tel", "fone", "celular", "contato", "ligar", "whats")
PHONE_OFFICE = ("institucional", "fixo", "ramal", "central", "sac", "atendimento", "ouvidoria", "departamento", "setor", "secretaria", "empresa", "comercial", "pabx", "0800", "4003", "3312", "3105", "3325", "3961", "3214", "3411", "3344", "3048", "3349", "3346", "3462", "3190", "3901", "3326", "3348", "disque", "servico", "suporte", "helpdesk", "callcenter")
PHONE_PREFIXES = ("3105", "3312", "3325", "3961", "3214", "3411", "3344", "3048", "3349", "3346", "3462", "3190", "3901", "3326", "3348")
PHONE_OWN = ("meu", "minha", "celular", "telefone", "contato", "whatsapp", "pessoal", "falar com", "ligar para", "recado", "urgente", "residencial", "para retorno", "para contato")
CNH_NOT = r"c[oó]digo\s+de\s+barras|boleto|linha\s+digit[aá]vel|ocorr[eê]ncia|pmdf|pcdf|cbmdf|boletim|cda|d[ií]vida\s+ativa|certid[ãa]o|nis|pis|pasep|benefici[aá]rio|conta|ag[eê]ncia|dep[oó]sito|transfer[eê]ncia|processo\s+n|protocolo|sei\s*n|inscri[çc][aã]o|im[oó]vel|cart[aã]o|nota\s+fiscal"
CNH_LABELS = ("minha cnh", "cnh do titular", "cnh cadastrada", "habilitação", "habilitacao", "carteira de motorista", "cnh:", "cnh ", "minha carteira", "numero da cnh", "n da cnh")
HOME = ("inquilina", "inquilino", "imovel localizado", "moro", "resido", "minha casa", "meu endere", "minha resid", "mora na", "mora no", "moradora", "morador", "endereco:", "residencia", "residencial", "me encontrar", "entrega", "buscar")
SHOP_BLOCKS = ("crn", "cln", "cls", "scln", "scrn", "scrs", "scls", "sbs", "scs", "sds", "shs", "sep")
PUBLIC_WORK = ("fiscaliza", "denuncia", "reclama", "solicita", "melhoria", "conserto", "buraco", "calcada", "ilumina", "limpeza", "coleta", "lixo", "esgoto", "agua", "asfalto", "pavimento", "sinalizacao")
HOUSING = ("shin", "shis", "shlp", "shln", "sqn", "sqs", "shdf", "shce", "shcg", "shn", "shs")
DWELLING = ("apt", "apartamento", "casa", "residencia", "moro", "resido", "minha", "meu")
OFFICES = ("sas", "scs", "sds", "sbs", "scn", "sen", "sgo", "sia", "sig")
INSTITUTION = ("secretaria", "hospital", "escola", "orgao", "empresa", "administracao", "departamento", "diretoria", "coordenacao", "tribunal", "camara", "senado", "autarquia", "fundacao", "instituto", "agencia", "conselho", "comissao", "gdf", "seedf", "sesdf", "sedf", "sejus", "pcdf", "pmdf", "cbmdf", "detran", "caesb", "ceb", "novacap", "terracap", "brb", "metro", "ubs", "upa", "posto", "servico", "bloco institucional")
BANK_OWN = r"minha\s+conta|meu\s+banco|depositar|transferir|pix|minha\s+ag[êe]ncia|receber\s+em|pagamento|meu\s+cart[ãa]o|cart[ãa]o\s+final|dep[óo]sito|ag[êe]ncia|ag\s*\d|cc\s*\d|conta\s*corrente|conta\s*:"
BANK_OFFICE = ("agência institucional", "agencia institucional", "conta institucional", "conta corporativa", "conta empresa", "conta comercial", "conta governo")
MINOR_NOT = ("solicitação genérica", "solicito informações", "benefício geral", "aposentadoria", "requerimento genérico", "dados epidemiológicos", "dados epidemiologicos", "dados estatísticos", "dados estatisticos", "estatística geral", "secretaria de educação", "secretaria de educacao", "informação institucional", "dados públicos", "dados publicos")
HEALTH_NOT = ("ISENÇÃO", "IMPOSTO DE RENDA", "APOSENTADO", "SOLICITAÇÃO", "SOLICITO", "PEDIDO", "BENEFÍCIO", "BENEFICIO", "AUXÍLIO", "AUXILIO", "APOSENTADORIA", "REQUERIMENTO", "GENÉRICO", "GENERICA", "GENÉRICA", "PARA", "SOBRE", "REFERENTE", "REFERÊNCIA", "REFERENCIA", "INFORMAÇÃO", "INFORMACAO", "INFORMAÇÕES", "INFORMACOES", "DADOS EPIDEMIOLÓGICOS", "DADOS EPIDEMIOLOGICOS", "DADOS ESTATÍSTICOS", "DADOS ESTATISTICOS", "ESTATÍSTICA", "ESTATISTICA", "PÚBLICO", "PUBLICO", "SES-DF", "SECRETARIA", "GDF", "PÚBLICA", "PUBLICA", "HOSPITAL", "CLÍNICA", "CLINICA", "UNIDADE", "UBS", "UPA", "POSTO", "SERVIÇO", "SERVICO")
PUBLIC_CEP = ("70000", "70001", "70002", "70003", "70004", "70005", "70040", "70041", "70042", "70043", "70044", "70050", "70051")
CEP_THIRD = ("ocupação do solo", "ocupacao do solo", "circulação de pessoas", "circulacao de pessoas", "espaço público", "espaco publico", "estabelecimento comercial", "complexo")
CEP_OWN = ("meu endere", "minha casa", "moro", "resido", "interesse", "inscrição imobil", "inscricao imobil", "matrícula", "matricula")
CEP_ADDRESS = r"endere[çc]o|resid|moro|casa|apt|apartamento|rua|av[en]|quadra|bloco|lote|lt|conjunto|cj|setor|im[oó]vel|localizado|cep\s*:"
STAFF_NOT = r"inscri[cç][ãa]o\s*(imobili[aá]ria|im[oó]vel|iptu)|iptu|matr[ií]cula\s*(do\s+)?im[oó]vel|registr[oa]\s*(de\s+)?im[oó]v|\d+[ºo°]\s*ri\b|\d+[ºo°]\s*registro|inscri[cç][aã]o\s*imobil|cart[oó]rio"
STAFF = r"servidor|funcional|servi[cç]o\s+p[uú]blico|gdf|seedf|sedf|se[jc]us|tcdf|pmdf|pcdf|cbmdf|gest[aã]o\s+de\s+pessoas|funcion[aá]rio|mat[r\.]|matr[ií]cula|aluno|estudante|boletim|escolar"
PASSPORT_NOT = ("exemplo", "ficticio", "fictício", "teste", "000000", "aa000000")


class Match:
    """Columns of a match and of what stands around it."""

    def __init__(self):
        self.text, self.m = F.col("near"), F.col("m")
        self.start, self.end = F.col("inicio") - F.col("near_at"), F.col("fim") - F.col("near_at")
        self.g = [None, *(F.col(f"g{i}") for i in range(1, GROUPS + 1))]
        self.basis = ""

    def near(self, left: int, right: int | None = None) -> Column:
        return around(self.text, self.start, self.end, left, right)

    def pre(self, width: int) -> Column:
        return before(self.text, self.start, width)

    def post(self, width: int) -> Column:
        return after(self.text, self.end, width)

    def confidence(self, kind: str) -> Column:
        """Confidence as of ``kind``; computed once for all rules, by the basis that each notes here."""
        self.basis = kind
        return F.col("_confidence")


@dataclass
class Verdict:
    """What a rule says of a match; ``accept`` may be null for no."""

    kind: Column
    value: Column
    weight: Column
    confidence: Column
    accept: Column


Rule = Callable[[Match, str], Verdict]


def _value(x: Match, name: str) -> Column:
    groups = next(p.groups for p in (*PATTERNS, *COMPLEMENT) if p.name == name)
    return F.coalesce(x.g[1], F.when(F.coalesce(*x.g[1 : groups + 1]).isNull(), x.m)) if groups else x.m


def _plain(kind: str | None = None, weight: int = 3, whole: bool = False, confidence: float | None = None) -> Rule:
    def rule(x: Match, name: str) -> Verdict:
        k = kind or name
        return Verdict(F.lit(k), x.m if whole else _value(x, name), F.lit(weight), x.confidence(k) if confidence is None else F.lit(confidence), F.lit(True))

    return rule


def _only(rule: Rule, test: Callable[[Match, Column], Column]) -> Rule:
    def both(x: Match, name: str) -> Verdict:
        v = rule(x, name)
        v.accept = v.accept & test(x, v.value)
        return v

    return both


def _lowered(c: Column, valid: Column) -> Column:
    return F.when(valid, c).otherwise(F.greatest(F.lit(0.6), c * 0.8))


def _cpf(x: Match, name: str) -> Verdict:
    value, fiction = _value(x, name), contains_any(F.upper(F.coalesce("first_near", F.lit(""))), CPF_FICTION)
    accept = ~F.lower(x.pre(20)).rlike(r"\bprocesso\s*$") & ~fiction & (cpf_shape(value) | contains_any(F.lower(x.near(60)), CPF_LABELS))
    return Verdict(F.lit("CPF"), value, F.when(cpf_valid(value), 5).otherwise(3), _lowered(x.confidence("CPF"), cpf_valid(value)), accept)


def _cnpj(x: Match, name: str) -> Verdict:
    value, near = _value(x, name), F.upper(x.near(50))
    d, own = digits(value), contains_any(near, CNPJ_OWN)
    accept = (F.length(d) == 14) & ~uniform(d) & ~x.pre(10).rlike(r"\d{4,5}[-\s]$") & (~contains_any(near, CNPJ_PROCESS) | contains_any(near, CNPJ_COMPANY))
    return Verdict(F.when(own, "CNPJ_PESSOAL").otherwise("CNPJ"), value, F.when(own, 4).otherwise(3), _lowered(x.confidence("CNPJ"), cnpj_valid(value)), accept)


def _process(x: Match, name: str) -> Verdict:
    pre, post, near = F.lower(x.pre(30)), F.lower(x.post(50)), fold_lower(x.near(120))
    out = contains_any(pre, LEGAL) | contains_any(pre, FEDERAL) | contains_any(post, FEDERAL) | contains_any(pre, REFERENCE)
    owned = ~contains_any(near, PROCESS_NOT) & (contains_any(near, PROCESS_LABELS) | F.col("_owned"))
    if name in ("PROTOCOLO_LAI", "PROTOCOLO_OUV"):
        owned = owned | (contains_any(near, PROTOCOL_LABELS) & ~F.col("_no_protocol"))
    return Verdict(F.lit(name), _value(x, name), F.lit(3), x.confidence(name), ~out & owned)


def _phone(x: Match, name: str) -> Verdict:
    near30, near40 = F.upper(x.near(30)), F.lower(x.near(40))
    d = digits(x.m)
    prefix = F.when(F.length(d) >= 10, F.substring(d, 3, 4)).when(F.length(d) >= 8, F.substring(d, 1, 4)).otherwise("")
    pre, post = F.lower(x.pre(80)), F.lower(x.post(80))
    out = (
        (contains_any(near30, PHONE_PROCESS) & ~contains_any(near30, PHONE_WORDS))
        | (contains_any(near40, PHONE_NOT) & ~contains_any(near40, PHONE_CALL))
        | d.startswith("000")
        | prefix.isin(*PHONE_PREFIXES)
        | contains_any(fold_lower(x.pre(80)), PHONE_OFFICE)
        | contains_any(fold_lower(x.post(80)), PHONE_OFFICE)
    )
    own = contains_any(pre, PHONE_OWN) | contains_any(post, PHONE_OWN)
    return Verdict(F.lit("TELEFONE"), x.m, F.when(own, 4).otherwise(3), F.least(F.lit(1.0), x.confidence("TELEFONE") + F.when(own, 0.1).otherwise(0.0)), ~out)


def _address(x: Match, name: str) -> Verdict:
    value = x.m if name == "ENDERECO_SETOR_DF" else _value(x, name)
    near, low = fold_lower(x.near(120)), fold_lower(value)
    home, office = contains_any(near, HOME), contains_any(near, INSTITUTION)
    if name in ("ENDERECO_MORO_EM", "ENDERECO_LABEL", "ENDERECO_CONTEXTO_PESSOAL"):
        accept = F.lit(True)
    else:
        shop = F.trim(low).rlike("^(" + "|".join(SHOP_BLOCKS) + ")( |$)")
        accept = (
            F.when(shop & ~home, False)
            .when(home, True)
            .when(contains_any(low, HOUSING), ~contains_any(near, PUBLIC_WORK) & contains_any(near, DWELLING))
            .when(contains_any(low, OFFICES), False)
            .when(office | F.contains(near, F.lit("setor")), False)
            .otherwise(near.rlike(r"moro|resido|minha\s+casa|meu\s+endere|minha\s+resid|residencia\s*:"))
        )
    return Verdict(F.lit("ENDERECO_RESIDENCIAL"), value, F.lit(4), x.confidence("ENDERECO_RESIDENCIAL"), accept)


def _bank(x: Match, name: str) -> Verdict:
    near = F.lower(x.near(80))
    if name == "DADOS_BANCARIOS":
        pair = lambda a, b, form: F.when(x.g[a].isNotNull() & x.g[b].isNotNull(), F.format_string(form, x.g[a], x.g[b]))
        two = "Agência %s Conta %s"
        value = F.coalesce(pair(1, 2, two), pair(3, 4, two), pair(5, 6, two), x.m)
    elif name == "CONTA_BANCARIA":
        value = F.coalesce(F.nullif(F.concat_ws(" ", x.g[1], x.g[2]), F.lit("")), x.m)
    else:
        value = _value(x, name)
    accept = near.rlike(BANK_OWN) & ~contains_any(near, BANK_OFFICE)
    return Verdict(F.lit("DADOS_BANCARIOS"), value, F.lit(4), x.confidence("CONTA_BANCARIA"), accept)


def _account(x: Match, name: str) -> Verdict:
    value = F.concat(F.lit("Conta "), x.g[1], F.coalesce(F.concat(F.lit(" Ag "), x.g[2]), F.lit("")))
    return Verdict(F.lit("CONTA_BANCARIA"), value, F.lit(5), F.lit(0.92), F.length(digits(x.g[1])) >= 4)


def _minor(x: Match, name: str) -> Verdict:
    age = F.coalesce(x.g[2], x.g[4]).cast("int")
    accept = ~contains_any(F.lower(x.near(60)), MINOR_NOT) & ~F.coalesce(age >= 18, F.lit(False))
    return Verdict(F.lit(name), F.concat_ws(" ", *x.g[1:5]), F.lit(5), x.confidence(name), accept)


def _profession(x: Match, name: str) -> Verdict:
    value = F.concat(F.upper(x.g[1]), F.coalesce(F.concat(F.lit("/"), F.upper(x.g[2])), F.lit("")), F.lit(" "), x.g[3])
    return Verdict(F.lit("OAB"), value, F.lit(4), F.lit(0.85), F.lit(True))


def _staff(x: Match, name: str) -> Verdict:
    value, near = _value(x, name), F.lower(x.near(100))
    accept = ~F.col("in_process") & ~near.rlike(STAFF_NOT) & near.rlike(STAFF)
    return Verdict(F.lit(name), value, F.lit(3), x.confidence(name), accept)


def _cep(x: Match, name: str) -> Verdict:
    value, near = _value(x, name), F.lower(x.near(80, 50))
    bare = F.regexp_replace(value, "[. -]", "")
    accept = (
        ~F.col("in_process")
        & ~((F.length(bare) == 8) & F.substring(bare, 1, 5).isin(*PUBLIC_CEP))
        & ~(contains_any(near, CEP_THIRD) & ~contains_any(near, CEP_OWN))
        & near.rlike(CEP_ADDRESS)
    )
    return Verdict(F.lit("CEP"), value, F.lit(3), F.lit(0.85), accept)


def _name(x: Match, name: str) -> Verdict:
    value = F.trim(_value(x, name))
    words = F.split(value, r"\s+")
    fine = F.forall(words, lambda w: F.lower(w).isin("de", "da", "do", "dos", "das", "e") | (w.rlike(r"^\p{Lu}") & (F.length(w) > 1)))
    return Verdict(F.lit("NOME"), value, F.lit(4), F.lit(0.85), F.size(words).between(2, 5) & (F.length(value) <= 45) & fine)


def _complement(kind: str, weight: int, confidence: float, sound: Callable[[Column], Column]) -> Rule:
    return lambda x, name: Verdict(F.lit(kind), x.g[1], F.lit(weight), F.lit(confidence), sound(x.g[1]))


def _email(x: Match, value: Column) -> Column:
    return ~F.lower(value).rlike(r"\.gov\.br|\.org\.br|\.edu\.br")


RULES: dict[str, Rule] = {
    "CPF": _cpf, "CNPJ": _cnpj, "PROCESSO_SEI": _process, "PROTOCOLO_LAI": _process, "PROTOCOLO_OUV": _process, "PROTOCOLO_GENERICO": _process,
    "RG": _plain("RG", 5), "RG_ORGAO": _plain("RG", 5),
    "CNH": _only(_plain("CNH", 5), lambda x, v: ~F.lower(x.near(80)).rlike(CNH_NOT) & contains_any(F.lower(x.near(80)), CNH_LABELS) & (F.length(v) >= 9)),
    "PIS": _plain(weight=5), "TITULO_ELEITOR": _plain(weight=5), "REGISTRO_ACADEMICO": _plain(weight=5), "CNS": _plain(weight=5), "CERTIDAO": _plain(weight=5),
    "PASSAPORTE": _only(_plain(weight=5), lambda x, v: ~contains_any(F.lower(x.near(60)), PASSPORT_NOT)),
    "CTPS": lambda x, name: Verdict(F.lit(name), F.coalesce(x.g[1], F.nullif(F.concat_ws("-", *x.g[2:6]), F.lit("")), x.m), F.lit(5), x.confidence(name), F.lit(True)),
    "REGISTRO_PROFISSIONAL": _profession,
    "EMAIL_PESSOAL": _only(_plain(weight=4), _email),
    **dict.fromkeys(PHONES, _phone),
    **dict.fromkeys(("ENDERECO_RESIDENCIAL", "ENDERECO_MORO_EM", "ENDERECO_CONTEXTO_PESSOAL", "ENDERECO_LABEL", "ENDERECO_BRASILIA", "ENDERECO_SHIN_SHIS", "ENDERECO_SETOR_DF", "ENDERECO_DF_RESIDENCIAL"), _address),
    "CEP": _cep,
    "PROTOCOLO_DFP": _plain(), "NIRE": _plain(), "MATRICULA_IMOVEL": _plain(), "CDA": _plain("CDA"), "CDA_ADICIONAL": _plain("CDA"), "AUTO_INFRACAO": _plain(),
    "MATRICULA_SERVIDOR": _staff,
    "OCORRENCIA_POLICIAL": _only(_plain(), lambda x, v: ~contains_any(F.lower(x.near(100)), EXAMPLE)),
    "INSCRICAO_IMOVEL_15": _plain("INSCRICAO_IMOVEL", 4), "INSCRICAO_IMOVEL_LABEL": _plain("INSCRICAO_IMOVEL", 4),
    "PLACA_VEICULO": _plain(),
    "CONTA_BANCARIA": _bank, "DADOS_BANCARIOS": _bank, "CARTAO_CREDITO": _bank, "CARTAO_FINAL": _bank,
    "PIX_UUID": _plain("PIX", 4),
    "DATA_NASCIMENTO": lambda x, name: Verdict(F.lit(name), F.coalesce(x.g[1], x.g[2], x.m), F.lit(3), x.confidence(name), F.lit(True)),
    "NOME_TITULO": _name, "NOME_ASSINATURA": _name, "NOME_CARGO": _name, "NOME_CONDOMINIO": _name,
    "IP_ADDRESS": _only(_plain(weight=2), lambda x, v: ~v.rlike(r"^(127|0|255)\.")),
    "DADO_SAUDE": _only(_plain(weight=5), lambda x, v: ~contains_any(F.upper(x.near(100, 50)), HEALTH_NOT)),
    "DADO_BIOMETRICO": _plain(weight=5),
    "MENOR_IDENTIFICADO": _minor,
    "CONTA_BANCARIA_CONTEXTUAL": _account,
    "IBAN": _complement("CONTA_BANCARIA_INTERNACIONAL", 4, 1.0, lambda v: iban_valid(v) & ~suppressed(v)),
    "ANY_IBAN": _complement("CONTA_BANCARIA_INTERNACIONAL", 4, 1.0, iban_valid),
    "CARD": _complement("CARTAO_CREDITO", 4, 1.0, lambda v: luhn_valid(F.regexp_replace(v, "[ -]", ""))),
    "ADDRESS": _complement("IP", 3, 0.6, lambda v: F.forall(F.split(v, "[.]"), lambda x: x.cast("int") <= 255)),
}


_ASK_WHOLE, _ASK_NUMBERS = ("PROCESSO_SEI", "PROTOCOLO_LAI", "PROTOCOLO_OUV", "PROTOCOLO_GENERICO"), ("MATRICULA_SERVIDOR", "CEP")


def _whole(text: Column) -> dict[str, Column]:
    """What rules ask of the whole text, if there is a match whose rule asks."""
    asked = lambda *names: F.exists("_found", lambda z: z["name"].isin(*names))
    fiction = F.concat(F.lit("(?s)"), F.lit("|".join(f"\\Q{t}\\E" for t in CPF_FICTION)))
    upper = F.upper(text)
    # the ends of the pieces between words of fiction, with these words: a number beside one stands in there
    ends = F.transform(F.split(upper, fiction, -1), lambda p: F.when(F.length(p) <= 160, p).otherwise(F.concat(F.left(p, F.lit(80)), F.lit("\n\n"), F.right(p, F.lit(80)))))
    words = F.regexp_extract_all(upper, fiction, F.lit(0))
    joined = F.array_join(F.zip_with(ends, words, lambda p, w: F.concat(p, F.coalesce(w, F.lit("")))), "")
    return {
        "_owned": F.when(asked(*_ASK_WHOLE), contains_any(fold_lower(text), OWNED)),
        "_no_protocol": F.when(asked(*_ASK_WHOLE), contains_any(fold_lower(text), PROTOCOL_NOT)),
        "_numbers": F.when(asked(*_ASK_NUMBERS), F.regexp_extract_all(text, F.lit(NUMBER_IN_PROCESS), F.lit(0))),
        "_fiction": F.when(asked("CPF") & contains_any(upper, CPF_FICTION), joined),
    }


def _each(z: Column) -> dict[str, Column]:
    """What rules ask of the whole text for one match."""
    value, numbers = F.coalesce(z["g1"], z["m"]), F.col("_numbers")
    # whether the match lies in, or its value occurs in, a process number of the text
    inside = F.exists(numbers, lambda n: F.contains(n, value) | (F.contains(n, z["m"]) & (F.length(z["m"]) < F.length(n))))
    # a number counts as fiction by what stands around its first place
    first = F.instr(F.col("_body"), z["g1"]) - 1
    near = F.when((z["name"] == "CPF") & F.contains(F.col("_fiction"), F.upper(z["g1"])), around(F.col("_body"), first, first + F.length(z["g1"]), 50))
    return {"in_process": F.when(z["name"].isin(*_ASK_NUMBERS), inside), "first_near": near}


_BUILT: dict[tuple, dict[str, Column]] = {}


def verdicts(names: tuple[str, ...]) -> dict[str, Column]:
    """For each part of a verdict, the column that picks it by the pattern's name; built once for a session."""
    key = (SparkContext.getOrCreate().applicationId, names)
    if key in _BUILT:
        return _BUILT[key]
    parts = []
    for n in names:
        if (key[0], n) not in _BUILT:
            x = Match()
            v = RULES[n](x, n)
            _BUILT[key[0], n] = {"accept": v.accept, "tipo": v.kind, "valor": v.value, "peso": v.weight, "confianca": v.confidence, "_basis": F.lit(x.basis or n)}
        parts.append((n, _BUILT[key[0], n]))

    def pick(part: str) -> Column:
        out = F.lit(None)
        for n, v in reversed(parts):
            out = F.when(F.col("name") == n, v[part]).otherwise(out)
        return out

    out = {part: pick(part) for part in ("accept", "tipo", "valor", "peso", "confianca", "_basis")}
    x = Match()
    out["_confidence"] = finding_confidence(F.col("_basis"), x.text, x.start, x.end)
    _BUILT[key] = out
    return out


def judge(docs: DataFrame, patterns: Sequence[Pattern], text: str = "text", beside: Callable[[Column], Column] | None = None) -> DataFrame:
    """Scans texts and keeps the matches that their rules accept, with tipo, valor, peso, confianca and contexto (what stands near).

    The columns of ``docs`` stay, but for the text. With ``beside`` the findings that it makes of a text (structs
    of tipo, valor, confianca, peso, inicio, fim, source, ord, yields) stand in column ``made`` of rows of their own.
    """
    v = verdicts(tuple(p.name for p in patterns))
    found = slices(docs, patterns, text, _whole, _each, beside)
    made = F.lit(False) if beside is None else F.col("made").isNotNull()
    # steps of their own: the verdicts are large expressions, and what follows uses them many times
    own = ("_owned", "_no_protocol", "_numbers", "_fiction", "near", "near_at", "in_process", "first_near")
    stay = [F.col(f"`{c}`") for c in found.columns if c not in own]
    near = near_text(F.col("near"), F.col("inicio") - F.col("near_at"), F.col("fim") - F.col("near_at"))
    judged = found.select("*", once(_accept=F.when(made, True).otherwise(F.coalesce(v["accept"], F.lit(False))))).where("_accept").drop("_accept")
    kept = judged.select("*", once(_basis=v["_basis"], contexto=near))
    sure = kept.select("*", once(_confidence=v["_confidence"]))
    out = sure.select(*stay, "contexto", once(tipo=v["tipo"], valor=v["valor"], peso=v["peso"].cast("int"), confianca=v["confianca"].cast("double")))
    return out.where(made | F.col("valor").isNotNull())
