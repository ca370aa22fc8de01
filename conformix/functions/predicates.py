"""Declarative predicate trees compiled to Columns.

An entity leaf is any of layer_regex, layer_equals, layer_contains, entity_type, system, text_regex; a pair leaf any of
same_layer, different_layer, same_system, different_system. Leaves of one node are and-ed; nodes nest by and, or, not.
"""

from __future__ import annotations

import re
import re._parser as _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH_CHARS, DEPTH = 2000, 16
# Fixed value: the longest pattern that a rule may hold.
PATTERN_CHARS = 200


def _is_text(v) -> bool:
    return isinstance(v, str) and v != ""


def _is_words(v) -> bool:
    return bool(v) and all(map(_is_text, _words(v))) if isinstance(v, (str, list, tuple)) else False


def regex_fault(pattern: str) -> str | None:
    """Why a pattern must not run: too long, not a pattern, or a repeat without end inside another, which backtracks without end."""
    if not _is_text(pattern) or len(pattern) > PATTERN_CHARS:
        return f"has to be text of {PATTERN_CHARS} characters at most"
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError) as e:
        return str(e)
    return "repeats without end inside a repeat without end" if _repeats(tree, False) else None


def _repeats(tree, inside: bool) -> bool:
    """A repeat without end lies inside another one (or in `inside`)."""
    for op, arg in tree:
        endless = op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[1] == _parser.MAXREPEAT
        if endless and inside:
            return True
        parts = arg[-1] if op is _parser.BRANCH else [x for x in arg if isinstance(x, _parser.SubPattern)] if isinstance(arg, tuple) else []
        if any(_repeats(x, inside or endless) for x in parts if x is not None):
            return True
    return False


#: Leaves of each kind of tree: what a leaf holds, said and checked.
LEAVES = {
    "entity": {
        **dict.fromkeys(("layer_equals", "layer_contains"), ("text", _is_text)),
        **dict.fromkeys(("layer_regex", "text_regex"), ("a usable pattern", lambda v: regex_fault(v) is None)),
        **dict.fromkeys(("entity_type", "system"), ("a word or a list of words", _is_words)),
    },
    "pair": dict.fromkeys(("same_layer", "different_layer", "same_system", "different_system"), ("true or false", lambda v: isinstance(v, bool))),
}


class PredicateError(ValueError):
    pass


def _words(v) -> list[str]:
    return [v] if isinstance(v, str) else list(v)


def faults(tree, kind: str = "entity") -> list[str]:
    """What is wrong with a predicate tree, from a walk over its nodes level by level."""
    wrong, level = [], [tree]
    for _ in range(DEPTH + 1):
        below = []
        for node in level:
            if not isinstance(node, dict) or not node:
                wrong.append("a predicate is an object with something in it")
                continue
            for key, held in node.items():
                if key == "not":
                    below.append(held)
                elif key in ("and", "or"):
                    below += held if isinstance(held, list) else []
                    if not isinstance(held, list) or not held:
                        wrong.append(f"{key} joins a list of predicates")
                elif key not in LEAVES[kind]:
                    wrong.append(f"{key} is no word of a predicate")
                elif not LEAVES[kind][key][1](held):
                    wrong.append(f"{key} has to be {LEAVES[kind][key][0]}" + (f": {regex_fault(held)}" if key.endswith("_regex") else ""))
        level = below
    return wrong + [f"more than {DEPTH} levels"] * bool(level)


def validate(tree, kind: str = "entity") -> None:
    """PredicateError with the faults of a tree, if it has any."""
    if wrong := faults(tree, kind):
        raise PredicateError("; ".join(wrong))


# How each word of a predicate is said.
SAID = {
    "layer_regex": "圖層符合 /{}/", "layer_equals": "圖層 = {}", "layer_contains": "圖層包含「{}」", "entity_type": "類型為 {}", "system": "系統為 {}", "text_regex": "文字符合 /{}/",
    "same_layer": "相同圖層", "different_layer": "不同圖層", "same_system": "相同系統", "different_system": "不同系統",
}
JOINED = {"and": " 且 ", "or": " 或 "}


def describe(node: dict) -> str:
    """A predicate in words."""
    parts = []
    for word, held in node.items():
        if word in JOINED:
            parts.append(f"（{JOINED[word].join(map(describe, held))}）")
        elif word == "not":
            parts.append("非 " + describe(held))
        elif isinstance(held, bool):
            parts.append(("" if held else "非") + SAID[word])
        else:
            parts.append(SAID[word].format("/".join(_words(held))))
    return JOINED["and"].join(parts)


def _all(parts: list[Column], way) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = way(out, p)
    return out


def entity(node: dict, e: Column | None = None) -> Column:
    """A Boolean Column that is never null, over the fields of struct e (or of the row)."""
    col = (lambda n: F.col(n)) if e is None else (lambda n: e[n])
    no = F.lit(False)

    def search(field: Column, pattern: str) -> Column:
        return F.coalesce(F.substring(field, 1, MATCH_CHARS).rlike("(?iu)" + pattern), no)

    def leaf(k, v) -> Column:
        if k in ("and", "or"):
            return _all([entity(x, e) for x in v], (lambda a, b: a & b) if k == "and" else (lambda a, b: a | b))
        if k == "not":
            return ~entity(v, e)
        if k == "layer_regex":
            return search(col("layer"), v)
        if k == "layer_equals":
            return F.coalesce(F.lower(col("layer")) == v.lower(), no)
        if k == "layer_contains":
            return F.coalesce(F.contains(F.lower(col("layer")), F.lit(v.lower())), no)
        if k == "entity_type":
            return F.coalesce(F.upper(col("entity_type")).isin([x.upper() for x in _words(v)]), no)
        if k == "system":
            return F.coalesce(F.lower(col("system")).isin([x.lower() for x in _words(v)]), no)
        return search(F.coalesce(F.when(col("kind") == "text", col("text")), F.lit("")), v)

    return _all([leaf(k, v) for k, v in node.items()], lambda a, b: a & b)


def pair(node: dict, s: Column, t: Column) -> Column:
    def leaf(k, v) -> Column:
        if k in ("and", "or"):
            return _all([pair(x, s, t) for x in v], (lambda a, b: a & b) if k == "and" else (lambda a, b: a | b))
        if k == "not":
            return ~pair(v, s, t)
        want = F.lit(v if k.startswith("same") else not v)
        if k.endswith("layer"):
            return F.coalesce((F.lower(s["layer"]) == F.lower(t["layer"])) == want, F.lit(False))
        # an unclassified side is neither the same nor different
        return F.coalesce((F.lower(s["system"]) == F.lower(t["system"])) == want, F.lit(False))

    return _all([leaf(k, v) for k, v in node.items()], lambda a, b: a & b)


def mentions_text(node: dict) -> bool:
    for k, v in node.items():
        if k in ("and", "or"):
            if any(mentions_text(x) for x in v):
                return True
        elif k == "text_regex" or k == "entity_type" and {x.upper() for x in _words(v)} & {"TEXT", "MTEXT"}:
            return True
    return False


def selects(node: dict, e: Column | None = None) -> Column:
    """Geometric entities that match; texts only where the predicate names them outside a not."""
    kind = F.col("kind") if e is None else e["kind"]
    hit = entity(node, e)
    return hit if mentions_text(node) else kind.isin("polyline", "circle") & hit
