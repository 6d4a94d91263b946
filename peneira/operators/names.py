"""Names without a model: document heuristics, contact triggers, and what is no name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.confidence import finding_confidence
from peneira.functions.normalize import after, alternation, around, before, contains_any, fold, let
from peneira.operators import vocabulary as V

FINDING = ("tipo", "valor", "confianca", "peso", "inicio", "fim", "source", "ord")
# Repeated groups are bounded, since Java goes one call deeper for each.
_CAPITAL = r"([A-Z][a-záéíóúàèìòùâêîôûãõç]+(?:\s+[A-Z][a-záéíóúàèìòùâêîôûãõç]+){0,30})"
_SIGNED = r"(?iuU)(?:grat[ao]|atenciosamente|obrigad[ao]|cordialmente|respeitosamente)[,\s]+([A-ZÀ-Ú][a-záéíóúàâêôãõç]+(?:\s+(?:da|de|do|dos|das|e)?\s*[A-ZÀ-Ú][a-záéíóúàâêôãõç]+){1,40})"
_SIGNED_NOT = ("distrito federal", "secretaria", "governo", "ministério", "tribunal", "defensoria", "procuradoria", "polícia", "companhia", "universidade", "equipe", "atendimento", "setor", "departamento", "coordenação", "gerência", "diretoria", "assessoria", "ouvidoria", "central")
#: Source of findings and the place of their kind in the order that settles ties.
HEURISTIC, TRIGGER = 1000, 2000


def suppressed(value: Column, block_terms=(*V.BLOCK_TERMS, *V.SAFE_TERMS), safe_terms=V.SAFE_TERMS, gazetteer=(), strict_terms: bool = False) -> Column:
    """Whether a text is no name: too short, odd characters, a blocked term or one with a safe term inside.

    Safe terms match inside words unless ``strict_terms``; ``gazetteer`` is off when empty.
    """
    folded = F.trim(fold(value))
    safe = folded.rlike(r"\b(" + "|".join(t.replace("-", r"\-") for t in safe_terms) + r")\b") if strict_terms else contains_any(folded, safe_terms)
    out = (
        (F.length(value) < 3)
        | F.contains(value, F.lit("##"))
        | value.rlike(r"(?U)[^\w\s\-]")
        | folded.isin(*dict.fromkeys(block_terms))
        | F.arrays_overlap(F.split(folded, r"\s+"), F.array(*(F.lit(w) for w in V.BLOCK_WORDS)))
        | safe
        | value.rlike(r"^[\d/.\-\s]+$")
    )
    if gazetteer:
        out = out | contains_any(folded, [g.upper() for g in gazetteer])
    return F.coalesce(out, F.lit(True))


def immune(text: Column, start: Column) -> Column:
    """Functional immunity: a public servant or authority in office, unless a contact trigger stands before."""
    pre, post = F.trim(fold(before(text, start, 100))), F.trim(fold(after(text, start, 150)))
    places = ("SECRETARIA", "ADMINISTRACAO", "DEPARTAMENTO", "DIRETORIA", "GDF", "SEEDF", "SESDF", "RESPONSAVEL", "SETOR", "HOSPITAL", "ESCOLA", "COORDENACAO", "REGIONAL")
    own = ("TELEFONE PESSOAL", "CELULAR PESSOAL", "ENDERECO RESIDENCIAL", "EMAIL PESSOAL", "MEU TELEFONE", "MEU EMAIL", "MEU CPF")
    place = contains_any(post, places)
    titled = F.right(pre, F.lit(15)).rlike("(DR|DRA|DOUTOR|DOUTORA|PROF|PROFESSOR|PROFESSORA)[ .]")
    office = pre.rlike(r"\b(" + "|".join(V.TITLES) + r")\.?\s*$")
    servant = contains_any(pre, V.SERVANTS) | contains_any(F.substring(post, 1, 50), V.SERVANTS)
    praised = F.concat_ws(" ", pre, post).rlike("FUNCIONARI[OA] DO MES")
    return ~contains_any(pre, V.TRIGGERS) & (praised | ((titled | office) & place) | (servant & ~contains_any(post, own)))


FOUND = "struct<tipo:string,valor:string,confianca:double,peso:int,inicio:int,fim:int,source:string,ord:int,yields:boolean>"


def _finding(tipo: str, value: Column, confidence: Column | float, weight: int, start: Column, end: Column, ord_: Column | int, test: Column, source: str = "regex", yields: bool = False) -> Column:
    """A finding's struct, or null where the test doesn't hold."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    fields = dict(tipo=F.lit(tipo), valor=value, confianca=lit(confidence).cast("double"), peso=F.lit(weight), inicio=start.cast("int"), fim=end.cast("int"), source=F.lit(source), ord=lit(ord_).cast("int"), yields=F.lit(yields))
    return F.when(test, F.struct(*(v.alias(k) for k, v in fields.items())).cast(FOUND))


_GENERAL = r"isen[çc][ãa]o\s+(?:de\s+)?imposto\s+de\s+renda.*aposentado|aposentado.*isen[çc][ãa]o\s+(?:de\s+)?imposto"
_MINOR = r"(\b[A-Za-zÀ-ÿ]+)[\s,]+([0-9]{1,2})\s*anos"
_INFORMED = r"(?iu)([A-Za-zÀ-ÿ]+(?:\s+[A-Za-zÀ-ÿ]+){1,60})[^.]{0,50}(?:seu\s+cpf|seu\s+documento|informou\s+(?:seu\s+)?cpf)"
_CITIZEN = r"cidad[ãa]o[^.]{0,30}identificado[^.]{0,20}(?:como|por)\s+([A-ZÀ-Ú][a-záéíóúàâêôãõç]+)"


def _first(t: Column, pattern: str, guard: str, test) -> Column:
    """``test`` of a pattern's first match (match, its place, its end, its trimmed first group), where the guard lets the pattern through."""
    at = lambda m: F.when(m != "", F.length(F.get(F.split(t, pattern, 2), F.lit(0))))
    parts = lambda m: F.struct(m.alias("m"), at(m).alias("at"), F.trim(F.regexp_extract(m, pattern, 1)).alias("name"))
    found = let(F.regexp_extract(t, pattern, 0), lambda m: let(parts(m), lambda x: F.when(x["m"] != "", test(x["m"], x["at"], x["at"] + F.length(x["m"]), x["name"]))))
    return F.when(t.rlike(guard), found)


def heuristic_findings(t: Column) -> Column:
    """An array of what the heuristics that look at a whole text find; each gives one at most.

    Those that yield to a finding of the same kind are marked by ``yields``.
    """
    low = F.lower(t)
    cancer = F.when(F.contains(low, F.lit("ncer")), low.rlike(r"tratamento\s+(?:realizado\s+)?(?:de\s+)?c[aâ]ncer") & ~low.rlike(_GENERAL)).otherwise(False)

    def minor(m: Column, at: Column, end: Column, name: Column) -> Column:
        age = F.nullif(F.regexp_extract(m, _MINOR, 2), F.lit("")).cast("int")
        near = F.lower(around(t, at, end, 20, 40)).rlike(r"estudante|aluno|aluna|menor|crian[çc]a|escola|ec\s*\d")
        value = F.concat(name, F.lit(", "), age.cast("string"), F.lit(" anos"))
        return _finding("MENOR_IDENTIFICADO", value, 0.95, 5, at, end, HEURISTIC + 1, name.rlike(r"^\p{Lu}") & (age < 18) & near, yields=True)

    def informed(m: Column, at: Column, end: Column, name: Column) -> Column:
        return _finding("NOME", name, 0.90, 4, at, at + F.length(name), HEURISTIC + 2, name.rlike(r"^\p{Lu}") & ~suppressed(name))

    def citizen(m: Column, at: Column, end: Column, name: Column) -> Column:
        return _finding("NOME", name, 0.85, 4, end - F.length(name), end, HEURISTIC + 3, ~suppressed(name))

    def signed(m: Column, at: Column, end: Column, name: Column) -> Column:
        real = F.size(F.filter(F.split(name, r"\s+"), lambda w: ~F.lower(w).isin("da", "de", "do", "dos", "das", "e"))) >= 2
        return _finding("NOME", name, 0.90, 4, end - F.length(name), end, HEURISTIC + 4, real & ~contains_any(F.lower(name), _SIGNED_NOT) & ~suppressed(name), yields=True)

    found = (
        _finding("DADO_SAUDE", F.lit("Tratamento de câncer"), 0.95, 5, F.lit(0), F.length(t), HEURISTIC, cancer, yields=True),
        _first(t, _MINOR, "anos", minor),
        _first(t, _INFORMED, r"(?iu)seu\s+cpf|seu\s+documento|informou\s+cpf", informed),
        _first(t, _CITIZEN, "identificado", citizen),
        _first(t, _SIGNED, "(?iu)grat[ao]|atenciosamente|obrigad[ao]|cordialmente|respeitosamente", signed),
    )
    return F.array_compact(F.array(*found))


def trigger_findings(t: Column, triggers=V.TRIGGERS) -> Column:
    """An array of the names after the first occurrence of each contact trigger.

    The text is folded without changing lengths, so places in it are places in the text. One pass
    tells the longest trigger that starts at each place; those that it starts with are there too.
    """
    listed = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(x).alias("trigger")) for i, x in enumerate(triggers)))
    every = alternation(triggers)

    def one(f: Column, x: Column) -> Column:
        own = F.contains(x["trigger"], F.lit("ME CHAMO"))
        return let(F.instr(f, x["trigger"]) - 1 + F.length(x["trigger"]), lambda at: let(F.trim(F.substring(t, at + 1, F.lit(60))), lambda rest: named(x["ord"], own, at, rest)))

    def named(ord_: Column, own: Column, at: Column, rest: Column) -> Column:
        raw = F.when(own, F.regexp_extract(rest, _CAPITAL, 1)).otherwise(F.regexp_extract(rest, r"\b(?:o|a|do|da)?\s*" + _CAPITAL, 1))
        return F.when(rest.rlike("[A-Z]"), let(raw, lambda r: cut(ord_, own, at, rest, r)))

    def cut(ord_: Column, own: Column, at: Column, rest: Column, raw: Column) -> Column:
        whole = F.when(own, raw).otherwise(F.regexp_extract(rest, r"\b(?:o|a|do|da)?\s*" + _CAPITAL, 0))
        words = F.split(raw, " ")
        ends = F.array_position(F.transform(words, lambda w: F.upper(w).isin(*V.NAME_ENDS)), F.lit(True)).cast("int")
        name = F.trim(F.when(own & (ends > 0), F.array_join(F.slice(words, 1, F.greatest(ends - 1, F.lit(0))), " ")).otherwise(raw))
        return let(F.struct(name.alias("name"), whole.alias("whole"), (at + F.instr(rest, whole) - 1).alias("at")), lambda p: judged(ord_, own, p["name"], p["whole"], p["at"]))

    def judged(ord_: Column, own: Column, name: Column, whole: Column, start: Column) -> Column:
        end = start + F.when(own, F.length(name)).otherwise(F.length(whole))
        fine = (F.length(name) > 3) & (own | (F.contains(name, F.lit(" ")) & ~F.trim(fold(name)).isin(*V.TITLES, *V.SERVANTS))) & ~suppressed(name)
        sure = F.least(F.lit(1.0), finding_confidence(F.lit("NOME"), t, start, end) * F.when(own, 1.1).otherwise(1.05))
        return _finding("NOME", name, sure, 4, start, end, ord_ + TRIGGER, fine, source="gatilho")

    def of(f: Column) -> Column:
        met = F.array_distinct(F.regexp_extract_all(f, F.lit(f"(?=({every}))"), F.lit(1)))
        there = let(met, lambda m: F.filter(listed, lambda x: F.exists(m, lambda y: F.startswith(y, x["trigger"]))))
        return F.array_compact(F.transform(there, lambda x: one(f, x)))

    return let(fold(t), of)


def _rows(docs: DataFrame, found: Column, text: str) -> DataFrame:
    bodies = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_body"))
    return bodies.select("doc_id", F.inline(found))


def heuristics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Findings of the heuristics that look at a whole document."""
    return _rows(docs, heuristic_findings(F.col("_body")), text)


def trigger_names(docs: DataFrame, text: str = "text", triggers=V.TRIGGERS) -> DataFrame:
    """Names after the first occurrence of each contact trigger."""
    return _rows(docs, trigger_findings(F.col("_body"), triggers), text).drop("yields")
