"""Terms that are no names: formulas, offices, institutions, places, references to law, and diseases named after people.

Fixed values: results depend on the whole list. Terms are upper case without accents.
"""

BLOCK_TERMS = (
    "AGRADECO", "ATENCIOSAMENTE", "CORDIALMENTE", "RESPEITOSAMENTE", "BOM DIA", "BOA TARDE", "BOA NOITE", "PREZADOS", "PREZADO", "PREZADA",
    "CORDIAIS SAUDACOES", "SOLICITO", "INFORMO", "ENCAMINHO", "DESPACHO", "PROCESSO", "AUTOS", "REQUERIMENTO", "PROTOCOLO", "MANIFESTACAO", "DEMANDA",
    "REQUEIRO", "AUTORIZO", "ACESSO", "INTEGRAL", "DRA", "DR", "SR", "SRA", "PROF", "PROFESSOR", "PROFESSORA", "DOUTOR", "DOUTORA", "EXCELENTISSIMO",
    "EXCELENTISSIMA", "EXMO", "EXMA", "ILMO", "ILMA", "MM", "MERITISSIMO", "VOSSA SENHORIA", "VOSSA EXCELENCIA", "ILUSTRISSIMO", "SECRETARIA",
    "DEPARTAMENTO", "DIRETORIA", "GERENCIA", "COORDENACAO", "SUPERINTENDENCIA", "SUBSECRETARIA", "ASSESSORIA", "GABINETE", "NUCLEO", "FUNDACAO",
    "AUTARQUIA", "CAMARA", "LEGISLATIVA", "TRIBUNAL", "JUSTICA", "CONTROLADORIA", "OUVIDORIA", "CIDADAO", "CIDADA", "REQUERENTE", "SOLICITANTE",
    "INTERESSADO", "DENUNCIANTE", "RECLAMANTE", "MANIFESTANTE", "MEU CPF", "MINHA CNH", "MEU RG", "MEU TELEFONE", "MEU EMAIL", "MEU ENDERECO",
    "MINHA IDENTIDADE", "MEU NOME", "MEU PIS", "LIGACOES", "TELEFONICAS", "MUDAS", "ILUMINACAO", "PUBLICA", "RECLAMACAO", "DENUNCIA", "ELOGIO",
    "SUGESTAO", "JANEIRO", "FEVEREIRO", "MARCO", "ABRIL", "MAIO", "JUNHO", "JULHO", "AGOSTO", "SETEMBRO", "OUTUBRO", "NOVEMBRO", "DEZEMBRO", "GDF",
    "PMDF", "PCDF", "CBMDF", "SEEDF", "SESDF", "SSP", "DETRAN", "BRB", "NOVACAP", "CGDF", "CLDF", "TCDF", "DODF", "SEI", "TERRACAP", "CAESB",
    "NEOENERGIA", "CEB", "METRO-DF", "METRO DF", "DFTRANS", "AGEFIS", "ADASA", "CODHAB", "EMATER", "FAPDF", "INESP", "PROCON", "MPDF", "MPSP", "LAI",
    "ESIC", "ESCOLA", "ESCOLA CLASSE", "ESCOLA PARQUE", "CENTRO DE ENSINO", "CENTRO EDUCACIONAL", "CEF", "CEM", "CED", "EC", "EP", "HOSPITAL",
    "HOSPITAL REGIONAL", "HOSPITAL MATERNO", "HOSPITAL DE BASE", "HOSPITAL INFANTIL", "HOSPITAL UNIVERSITARIO", "HOSPITAL DE APOIO", "UBS", "UPA",
    "CENTRO DE SAUDE", "UNIDADE BASICA", "DELEGACIA", "BATALHAO", "CORPO DE BOMBEIROS", "QUARTEL", "CLASSE", "REGIONAL", "MATERNO", "INFANTIL",
    "BASE", "ADMINISTRACAO REGIONAL", "PREFEITURA", "BRASILIA", "PLANO PILOTO", "GAMA", "TAGUATINGA", "BRAZLANDIA", "SOBRADINHO", "PLANALTINA",
    "PARANOA", "NUCLEO BANDEIRANTE", "CEILANDIA", "GUARA", "CRUZEIRO", "SAMAMBAIA", "SANTA MARIA", "SAO SEBASTIAO", "RECANTO DAS EMAS", "LAGO SUL",
    "LAGO NORTE", "CANDANGOLANDIA", "RIACHO FUNDO", "SUDOESTE", "OCTOGONAL", "VARJAO", "PARK WAY", "SCIA", "ESTRUTURAL", "JARDIM BOTANICO", "ITAPOA",
    "SIA", "VICENTE PIRES", "FERCAL", "SOL NASCENTE", "POR DO SOL", "ARNIQUEIRA", "AGUAS CLARAS", "ASA SUL", "ASA NORTE", "EIXO MONUMENTAL",
    "ESPLANADA DOS MINISTERIOS", "W3", "L2", "SQS", "SQN", "SRES", "SHIS", "SHIN", "SHLN", "SGAS", "SGAN", "SRTVS", "SRTVN", "SCN", "SCS", "SBS",
    "SBN", "SDN", "SDS", "SCLN", "EQ", "SRV", "STF", "STJ", "TST", "TSE", "STM", "TJDFT", "TRF1", "TRT10", "MPF", "MPDFT", "DPU", "AGU", "CGU", "TCU",
    "SENADO", "CONGRESSO NACIONAL", "SUPREMO TRIBUNAL", "DISTRITO FEDERAL", "CENTRO ADMINISTRATIVO", "CENTRO METROPOLITANO", "PLANALTO CENTRAL",
    "PRACA DOS TRES PODERES", "PALACIO DO PLANALTO", "UNIVERSIDADE DE BRASILIA", "UNB", "UFRJ", "USP", "UNICAMP", "UCB", "UFMG", "UFRGS", "UFSC",
    "UFPR", "UFG", "UFBA", "CONSTITUICAO", "BOLETIM", "OCORRENCIA", "VALIDADOR", "CODIGO", "ASSUNTO", "DATA", "HORA", "REGISTRO", "INFORMACAO",
    "SOLICITACAO", "IDENTIFICACAO", "FALE CONOSCO", "RUA", "AVENIDA", "QUADRA", "LOTE", "BLOCO", "SETOR", "BAIRRO", "CIDADE", "ESTADO", "COMPLEMENTO",
    "LOGRADOURO", "CEP", "TRECHO", "CHACARA", "CONDOMINIO", "FOSFORO TOTAL", "NITROGENIO TOTAL", "NITROGENIO AMONIACAL", "OXIGENIO DISSOLVIDO",
    "SOLIDOS TOTAIS", "SOLIDOS SUSPENSOS", "SOLIDOS DISSOLVIDOS", "TEMPERATURA DA AMOSTRA", "DEMANDA BIOQUIMICA", "DBO", "DQO", "PH", "TURBIDEZ",
    "COLIFORMES", "CARBONO ORGANICO", "CLORETO", "SULFATO", "NITRATO", "FOSFATO", "AMONIA", "DECRETO", "LEI", "PORTARIA", "RESOLUCAO",
    "INSTRUCAO NORMATIVA", "LEI MARIA DA PENHA", "LEI DE ACESSO A INFORMACAO", "LEI GERAL DE PROTECAO DE DADOS", "LGPD", "ESTATUTO DA CRIANCA",
    "ESTATUTO DO IDOSO", "ESTATUTO DA ORDEM DOS ADVOGADOS", "CODIGO CIVIL", "CODIGO PENAL", "CODIGO DE PROCESSO", "CONSTITUICAO FEDERAL",
    "NOSSA CONSTITUICAO", "CLT", "RESIDENTE DE SAUDE", "RESIDENTE DE MEDICINA", "RESIDENTE DE ENFERMAGEM", "RESIDENTE DE SAUDE COLETIVA",
    "CARREIRAS MAGISTERIO", "CARREIRA MAGISTERIO", "ASSISTENCIA A EDUCACAO", "POLITICAS PUBLICAS", "GESTOR PPGG", "ADVOGADOS ASSOCIADOS",
    "ESCRITORIO DE ADVOCACIA", "CONSELHO REGIONAL", "CONSELHO FEDERAL", "ORDEM DOS ADVOGADOS", "OAB", "CRM", "CREA", "CRO",
    "EMPREENDIMENTOS IMOBILIARIOS", "CONDOMINIO MUNICIPAL", "COOPERATIVAS FINANCEIRAS", "SICOOB", "ASSOCIACAO DE ENSINO", "LIGACOES TELEFONICAS",
    "VALIDADOR MPSP", "SETOR DE RECURSOS HIDRICOS", "RECURSOS HIDRICOS", "INCISO XV", "INCISO II", "INCISO I", "PARAGRAFO UNICO", "ARTIGO", "ALINEA",
    "HUNTINGTON", "PARKINSON", "ALZHEIMER", "CROHN", "HODGKIN", "KAWASAKI", "TOURETTE", "ADDISON", "CUSHING", "GRAVES", "HASHIMOTO", "MENIERE",
    "RAYNAUD", "SJOGREN", "WILSON", "CHAGAS", "HANSEN", "BASEDOW", "BELL", "DOWN",
)
