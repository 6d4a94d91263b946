"""Word lists, weights and thresholds.

Fixed values throughout this module: results depend on them being as they are.
"""

from peneira.operators.block_list import BLOCK_TERMS  # noqa: F401

SAFE_TERMS = (
    "GDF", "PMDF", "PCDF", "CBMDF", "SEEDF", "SESDF", "SSP", "DETRAN", "BRB", "NOVACAP", "CGDF", "CLDF", "TCDF", "DODF", "SEI", "TERRACAP",
    "CAESB", "NEOENERGIA", "CEB", "METRO-DF", "METRO DF", "DFTRANS", "AGEFIS", "ADASA", "CODHAB", "EMATER", "FAPDF", "INESP",
    "BRASILIA", "PLANO PILOTO", "GAMA", "TAGUATINGA", "BRAZLANDIA", "SOBRADINHO", "PLANALTINA", "PARANOA", "NUCLEO BANDEIRANTE",
    "CEILANDIA", "GUARA", "CRUZEIRO", "SAMAMBAIA", "SANTA MARIA", "SAO SEBASTIAO", "RECANTO DAS EMAS", "LAGO SUL", "LAGO NORTE",
    "CANDANGOLANDIA", "RIACHO FUNDO", "SUDOESTE", "OCTOGONAL", "VARJAO", "PARK WAY", "SCIA", "ESTRUTURAL", "JARDIM BOTANICO",
    "ITAPOA", "SIA", "VICENTE PIRES", "FERCAL", "SOL NASCENTE", "POR DO SOL", "ARNIQUEIRA", "AGUAS CLARAS",
    "ASA SUL", "ASA NORTE", "EIXO MONUMENTAL", "ESPLANADA DOS MINISTERIOS", "W3", "L2", "SQS", "SQN", "SRES", "SHIS", "SHIN", "SHLN", "SGAS", "SGAN",
    "SRTVS", "SRTVN", "SCN", "SCS", "SBS", "SBN", "SDN", "SDS",
    "STF", "STJ", "TST", "TSE", "STM", "TJDFT", "TRF1", "TRT10", "MPF", "MPDFT", "DPU", "AGU", "CGU", "TCU", "SENADO", "CAMARA",
    "DISTRITO FEDERAL", "CENTRO ADMINISTRATIVO", "CENTRO METROPOLITANO",
)
BLOCK_WORDS = (
    "SECRETARIA", "MINISTERIO", "GOVERNO", "FEDERAL", "ESTADUAL", "MUNICIPAL", "DISTRITAL", "ADMINISTRACAO", "DEPARTAMENTO", "DIRETORIA",
    "COORDENACAO", "GERENCIA", "ASSESSORIA", "GABINETE", "TRIBUNAL", "CAMARA", "SENADO", "ASSEMBLEIA", "AUTARQUIA", "FUNDACAO", "EMPRESA",
    "INSTITUTO", "AGENCIA", "CONSELHO", "COMISSAO", "GDF", "SEEDF", "SESDF", "SEDF", "SEJUS", "PCDF", "PMDF", "CBMDF", "DETRAN", "CAESB",
    "CEB", "NOVACAP", "TERRACAP", "BRB", "METRO",
)
SERVANTS = (
    "SERVIDOR", "SERVIDORA", "FUNCIONARIO", "FUNCIONARIA", "ANALISTA", "TECNICO", "AUDITOR", "FISCAL", "PERITO", "DELEGADO", "DELEGADA", "ADMINISTRADOR", "ADMINISTRADORA",
    "COORDENADOR", "COORDENADORA", "DIRETOR", "DIRETORA", "SECRETARIO", "SECRETARIA", "AGENTE", "MEDICO", "MEDICA", "ASSESSOR", "ASSESSORA", "CHEFE", "GERENTE",
    "SUPERINTENDENTE", "SUBSECRETARIO", "SUBSECRETARIA",
)
TITLES = ("DRA", "DR", "SR", "SRA", "PROF", "DOUTOR", "DOUTORA", "EXMO", "EXMA", "ILMO", "ILMA", "MM", "MERITISSIMO")
TRIGGERS = (
    "FALAR COM", "TRATAR COM", "LIGAR PARA", "CONTATO COM", "TELEFONE DO", "TELEFONE DA", "CELULAR DO", "CELULAR DA", "WHATSAPP DO", "WHATSAPP DA", "EMAIL DO", "EMAIL DA",
    "FALAR COM O", "FALAR COM A", "CONTATO DO", "CONTATO DA", "PROCURAR", "CHAMAR", "AVISAR", "COMUNICAR COM", "ENDERECO DO", "ENDERECO DA", "RESIDENCIA DO", "RESIDENCIA DA",
    "CASA DO", "CASA DA", "MORA NA", "MORA NO", "RESIDE NA", "RESIDE NO", "CONTATO:", "SERVIDOR", "SERVIDORA", "SR.", "SRA.", "SENHOR", "SENHORA", "DIRETOR", "DIRETORA",
    "DADOS DO", "DADOS DA", "SOLICITO DADOS", "IDENTIFICADO COMO", "CIDADAO", "CIDADA", "TESTEMUNHA:", "VITIMA:", "VÍTIMA:", "DECLARANTE:", "DENUNCIANTE:", "BENEFICIARIO:",
    "BENEFICIÁRIO:", "REQUERENTE:", "PACIENTE:", "RESPONSAVEL:", "RESPONSÁVEL:", "TITULAR:", "AUTOR:", "AUTORA:", "REU:", "RÉU:", "RE:", "RÉ:", "RECLAMANTE:", "RECLAMADO:",
    "RECLAMADA:", "ME CHAMO", "SOU O", "SOU A", "MEU NOME E", "MEU NOME É", "FILHO", "FILHA", "MINHA FILHA", "MEU FILHO", "PARA MINHA FILHA", "PARA MEU FILHO",
    "PRO MINHA FILHA", "PRO MEU FILHO",
)
NOT_NAMES = (
    "cpf", "cnpj", "rg", "tel", "telefone", "celular", "email", "e-mail", "endereço", "endereco", "cep", "processo", "sei", "observação", "observacao", "dados", "meus",
    "atenciosamente", "att", "obrigado", "obrigada", "grata", "grato", "cordialmente", "respeitosamente", "prezados", "prezadas", "residente", "estudante", "professor",
    "professora", "doutor", "doutora", "inciso", "artigo", "parágrafo", "estatuto", "ordem", "advogados", "brasil", "lei", "decreto", "portaria", "resolução", "resolucao",
    "gostaria", "solicito", "venho", "requerer", "informar", "setor", "recursos", "hídricos", "departamento", "coordenação", "diretoria", "centro", "atlântica", "atlantica",
    "edifício", "edificio", "shopping", "mall", "set",
)
NAME_ENDS = ("GOSTARIA", "QUERO", "PRECISO", "SOLICITO", "VENHO", "PEÇO", "ESTOU", "TENHO", "FAÇO", "MORO", "TRABALHO", "SOU")

BASE_CONFIDENCE = {
    "CPF": 0.98, "PIS": 0.98, "CNS": 0.98, "CNH": 0.98, "TITULO_ELEITOR": 0.98, "CTPS": 0.98, "CARTAO_CREDITO": 0.95, "CNPJ_PESSOAL": 0.90, "EMAIL_PESSOAL": 0.95,
    "PROCESSO_CNJ": 0.90, "TELEFONE": 0.88, "TELEFONE_INTERNACIONAL": 0.90, "PLACA_VEICULO": 0.88, "PIX": 0.88, "RG": 0.85, "PASSAPORTE": 0.85, "ENDERECO_RESIDENCIAL": 0.85,
    "CONTA_BANCARIA": 0.85, "CERTIDAO": 0.85, "REGISTRO_PROFISSIONAL": 0.85, "DADO_SAUDE": 0.95, "DADO_BIOMETRICO": 0.95, "MENOR_IDENTIFICADO": 0.95, "MATRICULA": 0.88,
    "CEP": 0.75, "DATA_NASCIMENTO": 0.70, "NOME_BERT": 0.0, "NOME_SPACY": 0.70, "NOME_GATILHO": 0.85, "NOME": 0.82, "COORDENADAS_GEO": 0.80, "USER_AGENT": 0.70,
}
DEFAULT_BASE = 0.85
#: Least weight and confidence by kind, before ``thresholds`` relaxes them.
THRESHOLDS = {
    "CPF": (3, 0.60), "CNPJ": (2, 0.55), "CNPJ_PESSOAL": (2, 0.55), "PROCESSO_SEI": (1, 0.55), "PROTOCOLO_LAI": (1, 0.55), "PROTOCOLO_OUV": (1, 0.55), "NOME": (2, 0.70),
    "EMAIL_PESSOAL": (2, 0.75), "EMAIL_ADDRESS": (2, 0.75), "TELEFONE": (2, 0.75), "ENDERECO_RESIDENCIAL": (2, 0.75), "RG": (3, 0.80), "CNH": (3, 0.80),
    "CARTAO_CREDITO": (3, 0.80), "DADO_SAUDE": (4, 0.75), "MENOR_IDENTIFICADO": (4, 0.75),
}
DOCUMENT_KINDS = ("CPF", "CNPJ", "PIS", "CNS", "TITULO_ELEITOR", "RG", "CNH", "PASSAPORTE", "CTPS")
SENSITIVE_KINDS = ("DADO_SAUDE", "DADO_BIOMETRICO", "MENOR_IDENTIFICADO")
#: Miss and false-alarm rates of sources.
FN_RATE = {"bert_ner": 0.008, "nuner": 0.006, "spacy": 0.015, "regex": 0.003, "dv_validation": 0.0001, "gatilho": 0.02}
FP_RATE = {"bert_ner": 0.02, "nuner": 0.015, "spacy": 0.03, "regex": 0.0002, "dv_validation": 0.00001, "gatilho": 0.05}
DEFAULT_FN, DEFAULT_FP, PRIOR = 0.1, 0.01, 0.01
LGPD_WEIGHTS = {
    "CPF": 5, "RG": 5, "CNH": 5, "PASSAPORTE": 5, "TITULO_ELEITOR": 5, "PIS": 5, "CNS": 5, "CNPJ_PESSOAL": 5, "CERTIDAO": 5, "CTPS": 5, "REGISTRO_PROFISSIONAL": 5,
    "EMAIL_PESSOAL": 4, "TELEFONE": 4, "ENDERECO_RESIDENCIAL": 4, "NOME": 4, "CONTA_BANCARIA": 4, "PIX": 4, "CARTAO_CREDITO": 4, "PLACA_VEICULO": 3, "CEP": 3,
    "DATA_NASCIMENTO": 3, "PROCESSO_CNJ": 3, "IP_ADDRESS": 2, "COORDENADAS_GEO": 2, "USER_AGENT": 2,
}
CONTEXT_WORDS = {
    "CPF": ("cpf", "cadastro", "documento", "pessoa física", "contribuinte"), "CNPJ": ("cnpj", "empresa", "pessoa jurídica", "razão social"),
    "CNPJ_PESSOAL": ("mei", "microempreendedor", "cnpj", "empresa"), "EMAIL_PESSOAL": ("email", "e-mail", "correio", "contato", "enviar"),
    "TELEFONE": ("telefone", "celular", "ligar", "whatsapp", "contato", "fone"), "NOME": ("nome", "senhor", "senhora", "sr.", "sra.", "chamado", "chama"),
    "ENDERECO_RESIDENCIAL": ("endereço", "rua", "avenida", "mora", "reside", "casa"), "DATA_NASCIMENTO": ("nascimento", "nasceu", "idade", "aniversário", "data de"),
    "RG": ("rg", "identidade", "carteira", "registro geral"), "CNH": ("cnh", "habilitação", "motorista", "carteira de"), "PIS": ("pis", "pasep", "nis", "trabalhador"),
    "CNS": ("cns", "cartão sus", "carteira nacional saúde"), "TITULO_ELEITOR": ("título", "eleitor", "votação", "zona eleitoral"),
    "CONTA_BANCARIA": ("conta", "banco", "agência", "depósito", "transferência"), "PIX": ("pix", "chave pix", "transferência", "pagamento"),
    "CARTAO_CREDITO": ("cartão", "crédito", "débito", "visa", "mastercard"),
}
BOTS = (
    "bot", "crawler", "spider", "scraper", "curl", "wget", "python-requests", "httpx", "aiohttp", "go-http-client", "java", "perl", "ruby", "php", "headless", "phantom",
    "selenium", "puppeteer", "playwright", "yandex", "baidu", "duckduck", "facebookexternal", "whatsapp", "semrush", "ahrefs", "dataforseo", "bytespider", "anthropic",
)
