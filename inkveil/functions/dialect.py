"""Regular-expression dialect helpers.

Rules are written once, in the subset of syntax shared by ECMAScript, RE2 and Java. The reference
semantics are the ECMAScript ones: word boundaries and ``\\w``/``\\d`` are ASCII, ``\\s`` covers the
Unicode spaces. Java 17 reads boundaries as Unicode and ``\\s`` as ASCII, so both are translated here.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Body of a character class holding every white-space character of ECMAScript.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

# The same for RE2, and one by one.
RE2_WS = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", WS)
SPACES = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{WS}]", c))

# Java's \\w is ASCII and tested faster than the same class written out.
_NOT_AFTER_WORD = r"(?<!\w)"
_NOT_BEFORE_WORD = r"(?!\w)"
_TWO_WAY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

_META = r"([.*+?^${}()|\[\]\\])"


def start_class(pattern: str, ignore_case: bool = False) -> str | None:
    """Body of a character class holding every character a match can begin with, for simple openings.

    Covers an opening digit, character class, literal word, or plain list of words; otherwise None.
    """
    rest = pattern.removeprefix("\\b")
    if rest.startswith("([") :
        rest = rest[1:]
    if re.match(r"\\d(?![?*]|\{0)", rest):
        return "0-9"
    if m := re.match(r"\[([^\]\\^]+)\](?![?*]|\{0)", rest):
        return m[1].upper() + m[1].lower() if ignore_case else m[1]
    words = re.match(r"\(\?:([^()]*)\)(?![?*]|\{0)", rest)
    alternatives = words[1].split("|") if words else [rest]
    begins = set()
    for word in alternatives:
        if re.match(r"[0-9]|\[[0-9-]+\]|\\d", word):
            begins.add("0-9")
        elif re.match(r"[A-Za-z](?![?*]|\{0)", word):
            begins.update({word[0].upper(), word[0].lower()} if ignore_case else word[0])
        else:
            return None
    return "".join(sorted(begins))


def java_regex(
    pattern: str, ignore_case: bool = False, soft: str = "LR", open_run: bool = False, first: str | None = None
) -> str:
    """Translate a portable pattern to Java.

    ``soft`` names the sides whose boundary may touch a non-word character ("L", "R", "LR" or "").
    Only those need the two-way test; the one-sided one is about twice as fast and is exact when
    the neighbouring element always consumes a word character. ``open_run`` marks a pattern that ends
    in a repeated group: as nothing follows, the repetition may be possessive, which Java walks in a
    loop instead of recursing once per word (a long run would overflow the task's stack).
    """
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            esc = pattern[i : i + 2]
            if esc == "\\s":
                out.append(WS if in_class else f"[{WS}]")
            elif esc == "\\b" and not in_class:
                opens = not out or out[-1] in ("(", "|", "?:")
                if opens:
                    out.append(_TWO_WAY if "L" in soft else _NOT_AFTER_WORD)
                else:
                    out.append(_TWO_WAY if "R" in soft else _NOT_BEFORE_WORD)
            else:
                out.append(esc)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        if pattern.startswith("?:", i) and out and out[-1] == "(":
            out.append("?:")
            i += 2
            continue
        out.append(c)
        i += 1
    java = "".join(out)
    if open_run:
        java = re.sub(r"\)([+*])\)$", r")\1+)", java)
    # Most positions cannot begin a match; one class test turns them away before the boundary tests.
    begin = first or start_class(pattern, ignore_case)
    ahead = f"(?=[{begin}])" if begin and "|\\b" not in pattern else ""
    return ahead + ("(?i)" if ignore_case else "") + java


def re2_regex(pattern: str, ignore_case: bool = False) -> str:
    """The same pattern for an RE2 engine (used by the SQL cross-checks)."""
    return ("(?i)" if ignore_case else "") + pattern


def re2_presence(pattern: str, ignore_case: bool = False) -> str:
    """A pattern for an RE2 engine that is found in every text in which :func:`java_regex`'s is: white space is spelled
    out, boundaries and classes are ASCII in both, and letter cases are folded at least as widely."""
    spaces, out, in_class, i = RE2_WS, [], False, 0
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        in_class = token == "[" or (in_class and token != "]")
        out.append((spaces if in_class else f"[{spaces}]") if token == "\\s" else token)
        i += len(token)
    return ("(?i)" if ignore_case else "") + "".join(out)


_QUANTIFIER = re.compile(r"(?:[?*+]|\{\d+(?:,\d*)?\})\??")
_CLASS = re.compile(r"\[(\^?)((?:(?!&&)[^\[\]\\]|\\.)+)\]", re.S)
_DOT = r"[^\n\r\x{85}\x{2028}\x{2029}]"


def _re2_range(first: str, last: str, ignore_case: bool) -> str:
    ranges = [(ord(first), ord(last))]
    for low, shift in ((65, 32), (97, -32)) if ignore_case else ():
        a, b = max(ord(first), low), min(ord(last), low + 25)
        if a <= b:
            ranges.append((a + shift, b + shift))
    return "".join(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if a < b else "") for a, b in ranges)


def _re2_class(body: str, ignore_case: bool) -> str | None:
    several = {r"\s": RE2_WS, r"\d": "0-9", r"\w": "0-9A-Z_a-z"}
    tokens, out, i = re.findall(r"\\.|.", body, re.S), [], 0
    while i < len(tokens):
        ends = [t for t in (tokens[i], tokens[i + 2] if tokens[i + 1 : i + 2] == ["-"] and i + 2 < len(tokens) else None) if t]
        if any(t in several for t in ends):
            if len(ends) > 1:
                return None
            out.append(several[tokens[i]])
        elif any(len(t) > 1 and t[1].isalnum() for t in ends) or ends[0][-1] > ends[-1][-1]:
            return None
        else:
            out.append(_re2_range(ends[0][-1], ends[-1][-1], ignore_case))
        i += 2 * len(ends) - 1
    return "".join(out)


def re2_search(pattern: str, ignore_case: bool = False) -> str | None:
    """A pattern for an RE2 engine with the same matches as :func:`java_regex`'s, or None where the syntax goes beyond what
    both engines read alike: literals, classes, groups, alternatives, repetitions and boundaries. White space and letter
    cases are spelled out, as RE2 folds more letters than ASCII's. A pattern that may match nothing is left to Java, too."""
    out, i, repeatable, empty = [], 0, False, []
    while i < len(pattern):
        c, token = pattern[i], pattern[i : i + 2]
        if m := _QUANTIFIER.match(pattern, i):
            if not repeatable:
                return None
            piece, size, repeatable = m[0], len(m[0]), False
        elif c == "\\":
            piece, size, repeatable = {r"\s": f"[{RE2_WS}]", r"\d": "[0-9]", r"\w": "[0-9A-Z_a-z]", r"\b": r"\b"}.get(token, ""), 2, token != r"\b"
            if not piece:
                if len(token) < 2 or token[1].isalnum():
                    return None
                piece = f"[{_re2_range(token[1], token[1], False)}]"
        elif c == "[":
            m = _CLASS.match(pattern, i)
            body = m and _re2_class(m[2], ignore_case)
            if not body:
                return None
            piece, size, repeatable = f"[{m[1]}{body}]", len(m[0]), True
        elif c == "(":
            if pattern.startswith("(?", i) and not pattern.startswith("(?:", i):
                return None
            piece, repeatable = "(?:" if pattern.startswith("(?:", i) else "(", False
            size = len(piece)
        elif c in "^${}]":
            return None
        elif c in ".|)":
            piece, size, repeatable = _DOT if c == "." else c, 1, c != "|"
        else:
            piece, size, repeatable = f"[{_re2_range(c, c, ignore_case)}]", 1, True
        out.append(piece)
        empty.append("" if piece == r"\b" else piece)
        i += size
    try:
        if pc.match_substring_regex(pa.array([""]), f"^(?:{''.join(empty)})$")[0].as_py():
            return None
        pc.match_substring_regex(pa.array([""]), f"({''.join(out)})")
    except pa.ArrowInvalid:  # as too large
        return None
    return "".join(out)


def escape_literal(text: Column) -> Column:
    """Quote every regex metacharacter of a literal held in a column."""
    return F.regexp_replace(text, _META, r"\\$1")


def escape_literal_py(text: str) -> str:
    """Driver-side twin of :func:`escape_literal`, for literals known when the plan is built."""
    return "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in text)


def trie_regex(words: Iterable[str]) -> str:
    """A pattern of all ``words`` that finds the longest one at a place, sharing their beginnings.

    Every word that begins the longest one stands there as well, and no other word does.
    """
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def tail(node: dict) -> str:
        firsts = sorted(c for c in node if c)
        if not firsts:
            return ""
        body = choice(node, firsts)
        return f"(?:{body})?" if "" in node else body

    def choice(node: dict, firsts: list[str]) -> str:
        """One of the branches. Many are halved by a look at the next character, as a pattern tries them in turn."""
        if len(firsts) == 1:
            return escape_literal_py(firsts[0]) + tail(node[firsts[0]])
        if len(firsts) <= 3:
            return f"(?:{'|'.join(choice(node, [c]) for c in firsts)})"
        halves = firsts[: len(firsts) // 2], firsts[len(firsts) // 2 :]
        return "(?:" + "|".join(f"(?=[{''.join(map(in_class, h))}]){choice(node, h)}" for h in halves) + ")"

    def in_class(c: str) -> str:
        return c if c.isalnum() else "\\" + c

    return tail(root)


def any_case(text: Column) -> Column:
    """Pattern column matching a literal in any letter case, accented letters included."""
    return F.concat(F.lit("(?iu)"), escape_literal(text))


# Code points that no text holds, for use inside the search functions.
MARK, COVER, _STRAY = "\uffff", "\ufffe", "\ufdd0"


def _one_case(c: str) -> str:
    """Upper, then lower case of one code point, without the forms that change the length."""
    upper = c.upper() if len(c.upper()) == 1 else c
    return upper.lower() if len(upper.lower()) == 1 else upper


def _unlike_lower() -> dict[str, str]:
    """The few lower-case letters that share their capital with another one (long s, final sigma, dotless i ...)."""
    low = {c.lower() for c in map(chr, range(0x20000)) if len(c.lower()) == 1 and not "\ud800" <= c <= "\udfff"}
    return {c: _one_case(c) for c in sorted(low) if _one_case(c) != c}


_UNLIKE = _unlike_lower()


def fold(text: Column) -> Column:
    """One form for all letter cases, code point by code point, so that positions and lengths stay.

    The one relation of search, redaction and leak check: two texts are equal in any letter case exactly if their folds
    are equal. Letters whose capital has several characters stay apart from it, as in case-insensitive patterns.
    """
    # Dotted capital i would grow, final sigma depends on its neighbours.
    apart = F.translate(text, "\u0130\u03a3" + MARK + COVER, "i\u03c3" + _STRAY * 2)
    folded = F.translate(F.lower(apart), "".join(_UNLIKE), "".join(_UNLIKE.values()))
    # None of these letters is ASCII; a text of one byte a character needs no walk for them.
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(folded)


def strip_ws(text: Column) -> Column:
    """Trim ECMAScript white space (Spark's ``trim`` only removes blanks)."""
    slow = F.regexp_replace(text, rf"^[{WS}]+|(?<![{WS}])[{WS}]++\z", "")
    return F.when(F.is_valid_utf8(text), strip_valid(text)).otherwise(slow)


def strip_valid(text: Column) -> Column:
    """:func:`strip_ws` of a text that is valid UTF-8, without a regex."""
    return F.btrim(text, F.lit(SPACES))


def collapse_ws(text: Column) -> Column:
    """Every white-space run becomes one blank; edges are trimmed."""
    # In ASCII only runs that are not one blank already are looked for.
    ascii_only = F.is_valid_utf8(text) & (F.length(text) == F.octet_length(text))
    some = F.regexp_replace(text, r"[\t-\r][\t-\r ]*+| [\t-\r ]++", " ")
    return F.trim(F.when(ascii_only, some).otherwise(F.regexp_replace(text, f"[{WS}]+", " ")))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{WS}]")
