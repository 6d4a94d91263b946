"""Text folding and character windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters whose upper or lower case is longer than they are, each with the first letter of it.
_LONG = [chr(i) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and (len(chr(i).upper()) > 1 or len(chr(i).lower()) > 1)]
_SHORT = "".join(next(x for x in c.upper() + c.lower() if x.isalpha() and len(x.upper()) == 1 == len(x.lower())) for c in _LONG)
_ACCENTED = "ÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝáàâãäåéèêëíìîïóòôõöúùûüçñýÿºª°"
_PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUCNYaaaaaaeeeeiiiiooooouuuucnyyoao"


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(text: Column | str) -> Column:
    """Upper case without accents; every character keeps its position."""
    return F.upper(F.translate(as_column(text), _ACCENTED + "".join(_LONG), _PLAIN + _SHORT))


def fold_lower(text: Column | str) -> Column:
    """Lower case without accents; every character keeps its position."""
    return F.lower(F.translate(as_column(text), _ACCENTED + "".join(_LONG), _PLAIN + _SHORT))


def before(text: Column, start: Column, width: int) -> Column:
    """Up to ``width`` characters before a half-open span."""
    low = F.greatest(start - width, F.lit(0))
    return F.substring(text, low + 1, start - low)


def after(text: Column, end: Column, width: int) -> Column:
    """Up to ``width`` characters after a half-open span."""
    return F.substring(text, end + 1, F.lit(width))


def around(text: Column, start: Column, end: Column, left: int, right: int | None = None) -> Column:
    """The span with what stands up to ``left`` before and ``right`` after it."""
    low = F.greatest(start - left, F.lit(0))
    return F.substring(text, low + 1, end + (left if right is None else right) - low)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def alternation(terms, shortest: bool = False) -> str:
    """An expression for literal terms, branching letter by letter; of terms that start alike the longest matches, or the ``shortest``."""
    root: dict = {}
    for t in terms:
        node = root
        for c in t:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        ends, rest = "" in node, {c: n for c, n in node.items() if c}
        if not rest or ends and shortest:
            return ""
        parts = [(c, written(n)) for c, n in sorted(rest.items())]
        leaves = [_quote(c) for c, tail in parts if not tail]
        out = [_quote(c) + tail for c, tail in parts if tail]
        if len(leaves) > 1:
            out.append("[" + "".join(leaves) + "]")
        else:
            out += leaves
        body = out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"
        return f"(?:{body})?" if ends else body

    first = "".join(_quote(c) for c in sorted(c for c in root if c))
    return f"(?=[{first}]){written(root)}" if len(root) > 3 else written(root)


def contains_any(text: Column, terms) -> Column:
    """Whether one of the literal ``terms`` occurs; one pass instead of a scan for each."""
    return text.rlike(alternation(terms, shortest=True))


def _quote(term: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&" else c for c in term)
