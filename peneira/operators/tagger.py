"""Names of persons by sequence tagging: a perceptron over B, I and O, trained with Spark.

Features of a token are its class, shape and ending and those of the tokens beside it; a
word of the name lists stands for its list, so that other names are known by shape and by
what stands around them. Training mixes parameters: in each round every partition of the
labelled texts goes on from the same weights with its own rows, averaged over its steps, and
the mean of the partitions' weights starts the next round; Spark adds them up by feature. The
driver and each task hold the weights, whose number is bounded by ``MOST_WEIGHTS`` (those of
least size go). Decoding is Viterbi's, in the tasks, over the sentences that may hold a name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.operators import vocabulary as V

# The commonest given names and surnames of the country.
GIVEN = frozenset(
    "josé joão antônio antonio francisco carlos paulo pedro lucas luiz luís marcos gabriel rafael daniel marcelo bruno eduardo felipe rodrigo manoel mateus andré fernando fábio leonardo gustavo guilherme leandro tiago anderson ricardo márcio jorge alexandre roberto edson diego vitor sérgio cláudio thiago geraldo adriano luciano júlio renato alex vinícius rogério samuel ronaldo mário flávio igor douglas davi cícero miguel artur césar cesar joaquim "
    "maria ana francisca antônia adriana juliana márcia fernanda patrícia aline sandra camila amanda bruna jéssica letícia júlia luciana vanessa mariana gabriela vera vitória larissa cláudia beatriz luana rita sônia renata eliane josefa simone natália cristiane carla débora rosângela jaqueline daniela marlene raimunda fabiana lúcia raquel ângela joana luzia elaine regina alessandra isabel teresa helena alice laura".split()
)
SURNAMES = frozenset(
    "silva santos oliveira souza rodrigues ferreira alves pereira lima gomes costa ribeiro martins carvalho almeida lopes soares fernandes vieira barbosa rocha dias nascimento andrade moreira nunes marques machado mendes freitas cardoso ramos gonçalves santana teixeira araújo pinto correia moura cavalcante melo campos castro monteiro miranda barros borges farias medeiros rezende azevedo cunha duarte batista reis fonseca tavares guimarães macedo coelho pires brito sales xavier bezerra queiroz amaral siqueira viana camargo leite neves maia paiva aguiar braga matos bastos".split()
)
PARTICLES = frozenset("de da do das dos e".split())
TITLES = frozenset("dr dra sr sra prof profa dona seu".split())
TAGS = ("O", "B", "I")
#: Rows to learn from, and weights kept, at most.
MOST_ROWS, MOST_WEIGHTS = 4000, 200_000
ROUNDS = 3
_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"[^\n.!?;]+")
#: What a sentence must hold: two capitalised words side by side, or one behind a title.
MAY = r"(?U)\p{Lu}\w+\s+(?:(?:de|da|do|das|dos|e)\s+)?\p{Lu}\w|\b(?:[Dd]ra?|[Ss]ra?|[Pp]rofa?)\b\.?\s+\p{Lu}"
_MAY = re.compile(r"[^\W\d_a-zà-öø-ÿ]\w+\s+(?:(?:de|da|do|das|dos|e)\s+)?[^\W\d_a-zà-öø-ÿ]\w|\b(?:[Dd]ra?|[Ss]ra?|[Pp]rofa?)\b\.?\s+[^\W\d_a-zà-öø-ÿ]")


def tokens(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]


def _class(word: str) -> str:
    low = word.lower()
    if word[:1].isupper():
        if low in GIVEN:
            return "<given>"
        if low in SURNAMES:
            return "<surname>"
    return low


def _shape(word: str) -> str:
    if word[:1].isdigit():
        return "9"
    if not word[:1].isalpha():
        return word
    if word.isupper():
        return "X" if len(word) == 1 else "XX" if len(word) < 5 else "XXX"
    return "Xx" if word[0].isupper() else "p" if word in PARTICLES else "x"


def features(words: list[str]) -> list[list[str]]:
    """Of each token of a sentence."""
    kinds, shapes = ["<s>", "<s>", *map(_class, words), "</s>", "</s>"], ["<s>", "<s>", *map(_shape, words), "</s>", "</s>"]
    out = []
    for i, word in enumerate(words, 2):
        k, s = kinds[i], shapes[i]
        known = "known" if k[0] == "<" else "other"
        out.append([
            "b", f"k={k}", f"s={s}", f"e={word.lower()[-3:] if s == 'x' else s}", f"k-={kinds[i - 1]}", f"k+={kinds[i + 1]}", f"s-={shapes[i - 1]} {s}", f"s+={s} {shapes[i + 1]}",
            f"s--={shapes[i - 2]} {shapes[i - 1]} {s}", f"s++={s} {shapes[i + 1]} {shapes[i + 2]}", f"kk-={kinds[i - 1]} {known} {s}", f"kk+={known} {s} {kinds[i + 1]}", f"k--={kinds[i - 2]} {s}", f"k++={s} {kinds[i + 2]}",
        ])
    return out


Weights = dict[str, list[float]]


def _allowed(before: int, tag: int) -> bool:
    """An I stands behind a B or an I."""
    return tag != 2 or before in (1, 2)


def viterbi(weights: Weights, rows: list[list[str]]) -> tuple[list[int], float]:
    """The best tags of a sentence, and their score; of equal ones the first by the last tag that differs."""
    score, back = [0.0, 0.0, float("-inf")], []
    for i, row in enumerate(rows):
        own = [0.0, 0.0, 0.0]
        for f in row:
            w = weights.get(f)
            if w:
                own[0], own[1], own[2] = own[0] + w[0], own[1] + w[1], own[2] + w[2]
        if not i:
            score = [own[0], own[1], float("-inf")]
            back.append([-1, -1, -1])
            continue
        new, come = [], []
        for tag in range(3):
            best = max((p for p in range(3) if _allowed(p, tag)), key=lambda p: (score[p] + weights.get(f"t={p}", (0.0, 0.0, 0.0))[tag], -p))
            come.append(best)
            new.append(score[best] + weights.get(f"t={best}", (0.0, 0.0, 0.0))[tag] + own[tag])
        score = new
        back.append(come)
    if not rows:
        return [], 0.0
    tag = max(range(3), key=lambda t: (score[t], -t))
    out, top = [tag], score[tag]
    for come in back[:0:-1]:
        tag = come[tag]
        out.append(tag)
    return out[::-1], top


def sequence_score(weights: Weights, rows: list[list[str]], tags: list[int]) -> float:
    total, before = 0.0, None
    for row, tag in zip(rows, tags, strict=True):
        if tag == 2 and before in (None, 0):
            return float("-inf")
        total += sum(weights[f][tag] for f in row if f in weights)
        if before is not None:
            total += weights.get(f"t={before}", (0.0, 0.0, 0.0))[tag]
        before = tag
    return total


def _gold(parts: list[tuple[int, int, str]], spans: list[tuple[int, int]]) -> list[int]:
    out = []
    for a, b, _ in parts:
        inside = next(((s, e) for s, e in spans if s <= a and b <= e), None)
        out.append(0 if inside is None else 1 if not any(inside[0] <= c < a for c, *_ in parts) else 2)
    return out


def _trained(weights: Weights, rows: list[tuple[str, list[tuple[int, int]]]]) -> Weights:
    """One pass of the perceptron over the rows, its weights averaged over the steps."""
    now = defaultdict(lambda: [0.0, 0.0, 0.0], {f: list(w) for f, w in weights.items()})
    moved = defaultdict(lambda: [0.0, 0.0, 0.0])
    step = 1
    for text, spans in rows:
        parts = tokens(text)
        sentence, gold = features([w for *_, w in parts]), _gold(parts, spans)
        guess = viterbi(now, sentence)[0]
        if guess != gold:
            for i, (g, h) in enumerate(zip(gold, guess, strict=True)):
                if g != h:
                    for f in sentence[i]:
                        for tag, d in ((g, 1.0), (h, -1.0)):
                            now[f][tag] += d
                            moved[f][tag] += d * step
                if i and (g, gold[i - 1]) != (h, guess[i - 1]):
                    for before, tag, d in ((gold[i - 1], g, 1.0), (guess[i - 1], h, -1.0)):
                        now[f"t={before}"][tag] += d
                        moved[f"t={before}"][tag] += d * step
        step += 1
    return {f: [w - m / step for w, m in zip(now[f], moved[f], strict=True)] if f in moved else now[f] for f in now}


def train(labelled: DataFrame, rounds: int = ROUNDS, shards: int = 4, most_rows: int = MOST_ROWS) -> Weights:
    """Weights from rows ``text, inicio, fim`` (a row for each span; null places for a text without).

    Learns from ``most_rows`` texts at most, those of least hash, dealt out by hash.
    """
    spark = labelled.sparkSession
    spans = F.array_compact(F.collect_list(F.when(F.col("inicio").isNotNull(), F.struct(F.col("inicio").cast("int").alias("s"), F.col("fim").cast("int").alias("e")))))
    texts = labelled.where("text is not null").groupBy("text").agg(F.sort_array(spans).alias("spans")).withColumn("h", F.xxhash64("text"))
    rows = texts.orderBy("h", "text").limit(most_rows).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).select("shard", "h", "text", "spans").toArrow().to_pylist()
    sample = spark.createDataFrame([(r["shard"], r["h"], r["text"], [(x["s"], x["e"]) for x in r["spans"]]) for r in rows], "shard int, h long, text string, spans array<struct<s:int,e:int>>")
    weights: Weights = {}
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def one(table: pa.Table) -> pa.Table:
            mine = sorted(table.to_pylist(), key=lambda r: (r["h"], r["text"]))
            got = sorted(_trained(sent.value, [(r["text"], [(x["s"], x["e"]) for x in r["spans"]]) for r in mine]).items())
            return pa.table({"f": pa.array([f for f, _ in got], pa.string()), "w": pa.array([w for _, w in got], pa.list_(pa.float64())), "shard": pa.array([mine[0]["shard"]] * len(got), pa.int32())})

        parts = sample.groupBy("shard").applyInArrow(one, "f string, w array<double>, shard int")
        # sums in the order of shards, so that a rerun agrees to the last bit
        mean = lambda i: (F.aggregate(F.sort_array(F.collect_list(F.struct("shard", F.get("w", F.lit(i)).alias("x")))), F.lit(0.0), lambda a, y: a + y["x"]) / shards)
        sums = parts.groupBy("f").agg(F.array(*(mean(i) for i in range(3))).alias("w"))
        size = F.array_max(F.transform("w", F.abs))
        found = sums.where(size > 0).orderBy(size.desc(), "f").limit(MOST_WEIGHTS).collect()
        weights = {r.f: list(r.w) for r in found}
        sent.unpersist()
    return weights


def names_in(weights: Weights, text: str, with_title: bool = True) -> list[tuple[int, int]]:
    """Spans of names: two words at least, or one behind a title, which is then part of it (or not, without ``with_title``)."""
    out = []
    for m in _SENTENCE.finditer(_shielded(text)):
        if not _MAY.search(m.group()):
            continue
        parts = tokens(m.group())
        tags = viterbi(weights, features([w for *_, w in parts]))[0]
        i = 0
        while i < len(tags):
            if tags[i] != 1:
                i += 1
                continue
            j = i + 1
            while j < len(tags) and tags[j] == 2:
                j += 1
            low, alone = i, sum(w[:1].isalpha() and w.lower() not in PARTICLES for *_, w in parts[i:j]) < 2
            # a title stands for the missing part of a name
            if alone and i and parts[i - 1][2].lower() in TITLES:
                low = i - 1
            end = j
            while end > i and parts[end - 1][2].lower() in PARTICLES:
                end -= 1
            if sum(w[:1].isalpha() and w.lower() not in PARTICLES for *_, w in parts[low:end]) >= 2:
                out.append((m.start() + parts[low if with_title else i][0], m.start() + parts[end - 1][1]))
            i = j
    return out


def _shielded(text: str) -> str:
    """The point behind a title ends no sentence."""
    return re.sub(r"\b(dra?|sra?|profa?)\.", r"\1 ", text, flags=re.I)


def recognizer(weights: Weights, source: str = "spacy", confidence: float = 0.85):
    """A plug-in for ``Engine.recognizers``. The weights are broadcast: ``MOST_WEIGHTS`` bounds them."""
    from peneira.functions.plugins import name_recognizer

    from pyspark import SparkContext

    sent = SparkContext.getOrCreate().broadcast(weights)
    return name_recognizer(lambda: lambda text: [(a, b, confidence) for a, b in names_in(sent.value, text)], source, may=MAY)


def tagged(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id, inicio, fim`` of the names in ``doc_id, text``, without the engine's tests of what is no name."""
    from pyspark import SparkContext

    sent = SparkContext.getOrCreate().broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a, b) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b in names_in(sent.value, t, with_title=False)]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "inicio", "fim"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(MAY)).mapInArrow(run, "doc_id long, inicio int, fim int")


# ---- texts to start from, where no feedback has been gathered yet

# Sentences with a name, and with capitalised words that are none.
WITH_NAME = (
    "{n} solicitou acesso aos autos", "{n} compareceu ao posto ontem", "A paciente {n} aguarda consulta", "O paciente {n} foi internado", "{n} é o responsável pelo pedido", "{n} é a responsável pela turma", "Falei com {n} ontem", "O processo de {n} está parado", "Encaminho a resposta para {n}",
    "{n}, gestor da unidade, assinou o termo", "{n}, Gestora do Programa", "Dr {g} orientou sobre o exame", "Dra {g} atendeu no hospital", "Sr {g} reclamou do buraco", "Conforme disse {n} em reunião", "Assinado por {n}", "Meu nome é {n} e peço ajuda", "{n} requer cópia do processo", "{n} informou que não recebeu", "{n} mora na quadra ao lado",
    "A servidora {n} atendeu mal", "O servidor {n} respondeu", "O professor {n} faltou", "A professora {n} deu aula", "Reclamação de {n} contra a empresa", "{n} atua na escola", "{n} trabalha como tutor", "Prezados, sou {n} e solicito informação", "Atenciosamente, {n}", "{n} pede revisão da nota", "A aluna {n} foi aprovada", "Minha mãe, {n}, precisa de vaga",
    "Requerente: {n}", "Em nome de {n}, solicito certidão", "Denúncia feita por {n} na ouvidoria", "{n} e {m} moram no mesmo lote", "O senhor {n} esteve aqui", "A cidadã {n} registrou queixa", "Informo que {n} não compareceu", "{n} possui matrícula ativa", "O advogado {n} peticionou", "{n} declarou residência",
)
WITHOUT_NAME = (
    "Solicito informações à {o} de {p}", "A Lei de Acesso à Informação garante resposta", "Gostaria de saber sobre o Programa {x}", "Moro perto da {p}", "O Hospital Regional de {p} está lotado", "Quais são os contratos firmados pela {o} em 2023?", "Prezados Senhores, bom dia", "Boa tarde, Prezada Ouvidoria", "O Tribunal de Contas do Distrito Federal julgou", "Perfil de pessoas com doença de {x}",
    "A Escola Classe de {p} precisa de reforma", "Rua {n} sem asfalto", "Avenida {n} com buracos", "Edifício {n} sem alvará", "Escola {n} sem merenda", "Hospital {n} sem leito", "Solicito cópia do Diário Oficial da União", "Peço o quantitativo de servidores da {o}", "O Banco do Brasil fechou a agência", "Instituto Federal de {p}", "O Plano Diretor de {p} foi aprovado",
    "Lista de escolas públicas de {p}", "A {o} publicou o edital", "Processo da {o} sobre {x}", "A Câmara Legislativa votou a Lei Orgânica", "Bom dia Senhores, Solicito Informações Sobre O Concurso", "Ouvidoria Geral do Distrito Federal", "O Projeto {x} {y} começou em Março", "Contrato com a Empresa {x} {s} Ltda", "Construtora {s} entregou a obra", "Fundação {x} {y}",
    "Conselho Tutelar de {p}", "Quero saber do Concurso Público da {o}", "Sistema Único de Saúde", "Houve instituição do Programa de Integridade na {o}?", "Secretário de Estado de {x}", "A Feira de {p} fecha cedo", "Prêmio {n} de Jornalismo", "Ponte {n} interditada", "Parque {n} sem luz", "Prezado {g}, bom dia", "Prezada {g}, tudo bem?", "Caro {g}, boa tarde", "Olá {g}, preciso de ajuda", "Vossa Excelência, peço deferimento", "Os painéis {n} foram restaurados", "Exposição {n} no museu", "Azulejos {n} danificados", "Livro de {n} na biblioteca", "UBS de {p} sem vacina", "Solicito acesso integral aos autos do Processo SEI",
)


def starting_texts(keys: Column, table: DataFrame) -> DataFrame:
    """``text, inicio, fim``: a made sentence for each row of a table, picked by hashes of its key; a third of the names are of no list."""
    lists = {k: sorted(x) for k, x in (("g", GIVEN), ("s", SURNAMES))}
    pick = lambda name, values: F.element_at(F.array(*(F.lit(x) for x in values)), F.pmod(F.xxhash64("_k", F.lit(name)), F.lit(len(values))).cast("int") + 1)
    part = lambda name, n: F.concat(*(pick(f"{name}{i}", ["ba", "ri", "lo", "ne", "va", "ti", "mu", "ja", "ce", "do", "xi", "ran", "gel", "son", "ly", "quel", "tor", "lin"]) for i in range(n)))
    made = lambda name: F.initcap(F.when(F.pmod(F.xxhash64("_k", F.lit(name + "?")), F.lit(2)) == 0, part(name, 2)).otherwise(part(name, 3)))
    real = lambda name, values: F.when(F.pmod(F.xxhash64("_k", F.lit(name + "!")), F.lit(3)) == 0, made(name)).otherwise(F.initcap(pick(name, values)))
    some = lambda name, share: F.pmod(F.xxhash64("_k", F.lit(name)), F.lit(100)) < share
    given, surname = (lambda n: real(n, lists["g"])), (lambda n: real(n, lists["s"]))
    full = lambda n: F.concat_ws(" ", F.when(some(n + "up", 8), F.upper(given(n + "1"))).otherwise(given(n + "1")), F.when(some(n + "two", 35), given(n + "2")), F.when(some(n + "mid", 45), surname(n + "3")), F.when(some(n + "of", 25), pick(n + "p", ["da", "de", "dos", "do"])), F.when(some(n + "end", 88) | some(n + "of", 25), surname(n + "4")).otherwise(given(n + "5")))
    places = [t.title() for t in V.SAFE_TERMS if " " in t or len(t) > 6]
    parts = {"n": full("n"), "m": full("m"), "g": given("only"), "s": surname("firm"), "x": made("x"), "y": made("y"), "p": pick("p", places), "o": F.initcap(pick("o", V.BLOCK_WORDS))}
    rows = table.select(keys.alias("_k")).select("_k", pick("t", [*WITH_NAME, *WITHOUT_NAME]).alias("_t"))
    rows = rows.select("_t", *(c.alias(f"_{k}") for k, c in parts.items()))
    labelled = F.col("_t").isin(*WITH_NAME)
    text, marks = F.col("_t"), {"n": ("\x02", "\x03"), "m": ("\x02", "\x03"), "g": ("\x02", "\x03")}
    for k in parts:
        open_, shut = marks.get(k, ("", ""))
        value = F.concat(F.lit(open_), F.col(f"_{k}"), F.lit(shut)) if open_ else F.col(f"_{k}")
        text = F.replace(text, F.lit("{%s}" % k), value)
    rows = rows.select(text.alias("_text"), labelled.alias("_labelled"))
    plain = F.translate("_text", "\x02\x03", "")
    pieces = F.split("_text", "\x02")
    # the n-th name starts behind the pieces before it, without their marks
    spans = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.struct(F.length(F.translate(F.array_join(F.slice(pieces, 1, i), ""), "\x03", "")).alias("s"), F.length(F.substring_index(F.get(pieces, i), "\x03", 1)).alias("n")))
    found = F.when(F.col("_labelled") & (F.size(pieces) > 1), spans).otherwise(F.array(F.struct(F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("n"))))
    return rows.select(plain.alias("text"), F.inline(found)).select("text", F.col("s").alias("inicio"), (F.col("s") + F.col("n")).alias("fim"))
