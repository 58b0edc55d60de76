"""Rule and keyword scans over a text column.

Every rule is a literal expression of one projection, so a scan is a narrow map over the documents:
no join with the rule table, no shuffle, and each pattern is compiled once per task. Results stay in
arrays until a caller asks for rows; a document's matches are bounded by its own text.

The rules of the catalogue, and all that RE2 reads as Java does, are searched by Arrow's regex kernel, a batch of texts at
once: first which texts a rule matches at all, then its matches there. Its time is linear in the text, about a fifth of what
a rule's own expression takes. The expressions remain for rules beyond that syntax.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.catalog.dictionaries import COMMON_WORDS, PRESETS, Preset
from inkveil.catalog.rules import COMMON_RULES, DEEP_RULES, FAST_NAME_RULES, FAST_RULES, LEGACY_RULES, NAME_RULES, Rule
from inkveil.functions.dialect import SPACES, escape_literal_py, java_regex, re2_presence, re2_search, strip_valid, strip_ws, trie_regex
from inkveil.functions.spans import running
from inkveil.functions.text import is_common_word, let, parse_reply, reply_says_nothing

WINDOW_CHARS = 100
# Value after a keyword: past the first ':' or '=' (or line end), 2 to 50 characters up to , ; or line end.
VALUE_CHARS = 50
_SPACE = np.isin(np.arange(1 << 16), [ord(c) for c in SPACES])

_LOW, _DIGIT, _HINT, _ABSENT, _FOUND = "_low", "_digit", "_hint", "_absent", "_found"
_EMPTY = "cast(array() as array<string>)"
_CATALOGUE = tuple(
    rule
    for rules in (FAST_RULES, FAST_NAME_RULES, DEEP_RULES, COMMON_RULES, NAME_RULES, *(p.rules for p in PRESETS.values()), LEGACY_RULES)
    for rule in rules
)
_HINTS = frozenset(h for rule in _CATALOGUE for h in rule.hints)
_BITS = 63
# Equal patterns share a bit.
_PLACES = {key: i for i, key in enumerate(dict.fromkeys((r.pattern, r.ignore_case) for r in _CATALOGUE))}


@cache
def _absent(rules: tuple[tuple[str, bool], ...]) -> Callable[[Column], Column]:
    """Bits, ``_BITS`` a number, of those of the rules that do not match a text; bits of other rules stay 0."""
    tests = [(_PLACES[key], re2_presence(*key)) for key in rules]
    width = len(_PLACES) // _BITS + 1

    def absent(text: pa.Array) -> pa.Array:
        bits = np.zeros((len(text), width), np.int64)
        for place, pattern in tests:
            found = pc.match_substring_regex(text, pattern).fill_null(True).to_numpy(zero_copy_only=False)
            bits[:, place // _BITS] |= (~found).astype(np.int64) << (place % _BITS)
        starts = pa.array(np.arange(len(text) + 1, dtype=np.int32) * width)
        return pa.ListArray.from_arrays(starts, pa.array(bits.ravel()), mask=text.is_null())

    # Said to vary, so that the optimizer neither copies it to every rule nor moves it.
    return F.arrow_udf(absent, "array<bigint>").asNondeterministic()


Search = tuple[str, bool, int]  # pattern, ignore_case, group


def _search(rule: Rule) -> Search:
    return rule.pattern, rule.ignore_case, rule.group


@cache
def _re2(search: Search) -> str | None:
    return re2_search(search[0], search[1])


# Equal searches are made once. The place of one in an array of matches.
_SLOTS = {key: i for i, key in enumerate(dict.fromkeys(map(_search, _CATALOGUE))) if _re2(key)}


def _unused(text: pa.Array) -> str:
    """A character that stands in none of the texts."""
    for c in chain(range(1, 9), range(0xFDD0, 0xFDF0), range(0xE000, 0xF900), range(0x10000, 0x110000)):
        if not pc.any(pc.match_substring(text, chr(c))).as_py():
            return chr(c)
    raise ValueError("a batch of texts holds every character")


def _matches(text: pa.Array, mark: str, pattern: str, group: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which texts a pattern matches, how often, and the matches one behind the other. ``mark`` stands in no text."""
    held = pc.match_substring_regex(text, pattern).fill_null(False)
    cut = pc.split_pattern(pc.replace_substring_regex(text.filter(held), pattern, rf"{mark}\{group}{mark}"), mark)
    # What stands between two matches, a match, and so on: every second piece of a text.
    ends = np.asarray(cut.offsets, np.int64)
    ends = ends - ends[0]
    pieces = np.diff(ends)
    inside = (np.arange(ends[-1]) - np.repeat(ends[:-1], pieces)) % 2 == 1
    return np.flatnonzero(held.to_numpy(zero_copy_only=False)), pieces // 2, cut.flatten().filter(pa.array(inside))


def _in_order(text: pa.Array, searches: Sequence[Search]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text by text, and in each search by search: text, search and number of its matches, and all matches."""
    wide = text.cast(pa.large_string())
    mark = _unused(wide)
    found = [_matches(wide, mark, _re2(s), s[2]) for s in searches]
    sizes = [len(rows) for rows, _, _ in found]
    rows, n = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in (0, 1))
    order = np.argsort(rows, kind="stable")
    first = (np.cumsum(n) - n)[order]
    rows, which, n = rows[order], np.repeat(np.arange(len(found)), sizes)[order], n[order]
    at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    matches = pa.chunked_array([f[2] for f in found], pa.large_string()).combine_chunks().take(pa.array(at))
    return rows, which, n, matches.cast(pa.string())


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


@cache
def _found_in(searches: tuple[Search, ...]) -> Callable[[Column], Column]:
    """The matches of each search at its place of ``_SLOTS``; NULL at those of others."""
    slots = np.array([_SLOTS[s] for s in searches])
    width = slots.max() + 1

    def found(text: pa.Array) -> pa.Array:
        rows, which, n, matches = _in_order(text, searches)
        sizes = np.zeros((len(text), width), np.int64)
        sizes[rows, slots[which]] = n
        others = np.ones((len(text), width), bool)
        others[:, slots] = False
        lists = pa.ListArray.from_arrays(_ends(sizes.ravel()), matches, mask=pa.array(others.ravel()))
        return pa.ListArray.from_arrays(_ends(np.full(len(text), width)), lists, mask=text.is_null())

    # Said to vary, so that the optimizer neither copies it to every rule nor moves it.
    return F.arrow_udf(found, "array<array<string>>").asNondeterministic()


@cache
def _rules_in(searches: tuple[tuple[int, Search], ...], counted: bool) -> Callable[[Column], Column]:
    """array<struct<rule, hits>>: the numbers of those searches that match a text, and their matches or (``counted``) how
    many these are."""
    # Equal searches are made once, and their matches are given to each rule that makes them.
    once = list(dict.fromkeys(s for _, s in searches))
    copies = [[i for i, s in searches if s == key] for key in once]
    times = np.array([len(c) for c in copies])
    numbers = np.array([c + [0] * (times.max() - len(c)) for c in copies], np.int32)

    def found(text: pa.Array) -> pa.Array:
        rows, which, n, matches = _in_order(text, once)
        entry = np.repeat(np.arange(len(rows)), times[which])
        before = np.cumsum(times[which]) - times[which]
        rule = numbers[which[entry], np.arange(len(entry)) - before[entry]]
        if counted:
            hits = pa.array(n[entry])
        else:
            first = (np.cumsum(n) - n)[entry]
            n = n[entry]
            at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            hits = pa.ListArray.from_arrays(_ends(n), matches.take(pa.array(at)))
        both = pa.StructArray.from_arrays([pa.array(rule), hits], ["rule", "hits"])
        return pa.ListArray.from_arrays(_ends(np.bincount(rows[entry], minlength=len(text))), both, mask=text.is_null())

    return F.arrow_udf(found, f"array<struct<rule:int,hits:{'bigint' if counted else 'array<string>'}>>").asNondeterministic()


def words_in(low: Column, words: Iterable[str]) -> Column:
    """Those of the words that stand anywhere in a text, found in one walk over it."""
    words = sorted(set(words))
    if not words:
        return F.expr(_EMPTY)
    # The walk reports the longest word at each place; the words it begins with stand there too.
    inside = F.create_map(*[F.lit(x) for w in words for x in (w, [v for v in words if w.startswith(v)])])
    longest = F.regexp_extract_all(low, F.lit(f"(?=({trie_regex(words)}))"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(longest), lambda w: inside[w])))


def with_gates(docs: DataFrame, text: str = "text", rules: Iterable[Rule] | None = None) -> DataFrame:
    """Add the columns that :func:`rule_matches` reads: the matches of those of ``rules`` (the whole catalogue) that the
    catalogue holds, which of these match nowhere, and for others the cheap pre-tests: the lower-cased text, whether it
    holds a digit, and the hints that it holds. Columns that nothing reads are never computed."""
    rules = _CATALOGUE if rules is None else list(rules)
    gated = docs.withColumn(_LOW, F.lower(F.col(text))).withColumn(_DIGIT, F.col(text).rlike("[0-9]"))
    asked, searched = {(r.pattern, r.ignore_case) for r in rules}, {_search(r) for r in rules}
    tested, searches = tuple(k for k in _PLACES if k in asked), tuple(k for k in _SLOTS if k in searched)
    # The kernel reads UTF-8 as it is, the rules read it with every bad byte replaced.
    valid = F.make_valid_utf8(F.col(text))
    found = _found_in(searches)(valid) if searches else F.lit(None).cast("array<array<string>>")
    return gated.withColumn(_HINT, words_in(F.col(_LOW), _HINTS)).withColumn(_ABSENT, _absent(tested)(valid)).withColumn(_FOUND, found)


def drop_gates(docs: DataFrame) -> DataFrame:
    return docs.drop(_LOW, _DIGIT, _HINT, _ABSENT, _FOUND)


def rule_matches(rule: Rule, text: str = "text", gated: bool = True, walk: bool = True) -> Column:
    """All non-overlapping matches of one rule, left to right. ``walk``: look the rule's hints up among those that one
    walk over the text found, instead of searching for each."""
    pattern = java_regex(rule.java or rule.pattern, rule.ignore_case, rule.soft, rule.open_run, rule.first)
    if rule.barren:
        either = f"({pattern})|{java_regex(rule.barren, rule.ignore_case, rule.soft)}"
        found = F.array_remove(F.regexp_extract_all(F.col(text), F.lit(either), F.lit(1)), "")
    else:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(rule.group))
    if not gated:
        return found
    slot = _SLOTS.get(_search(rule))
    if slot is not None:
        # NULL where the gates were not asked for the rule.
        known = F.coalesce(F.get(_FOUND, F.lit(slot)), found)
        return F.coalesce(known, F.expr(_EMPTY)) if rule.digit or rule.hints else known  # a null text stays null
    gate = F.col(_DIGIT) if rule.digit else F.lit(True)
    if rule.hints:
        any_hint = F.lit(False)
        for hint in rule.hints:
            known = walk and hint in _HINTS
            any_hint = any_hint | (F.array_contains(_HINT, hint) if known else F.contains(F.col(_LOW), F.lit(hint)))
        gate = gate & any_hint
    elif not rule.digit:
        return found
    return F.when(gate, found).otherwise(F.expr(_EMPTY))


def all_matches(rules: Sequence[Rule], text: str = "text") -> Column:
    """The matches of all ``rules``, rule by rule. The gates were asked for those of the catalogue."""
    slots = [_SLOTS.get(_search(r)) for r in rules]
    if not rules or None in slots:
        return concat_arrays([rule_matches(r, text) for r in rules])
    unasked = F.raise_error(F.lit("a rule is read that the gates were not asked for")).cast("array<string>")
    known = F.transform(F.array(*map(F.lit, slots)), lambda i: F.when(F.col(_FOUND).isNotNull(), F.coalesce(F.get(_FOUND, i), unasked)))
    # Of a null text as :func:`rule_matches` says.
    return F.coalesce(F.flatten(known), F.expr(_EMPTY)) if all(r.digit or r.hints for r in rules) else F.flatten(known)


def _worth_a_walk(rules: Sequence[Rule]) -> bool:
    """Measured: one walk for all hints costs about as much as searching for fifteen."""
    return sum(len(r.hints) for r in rules) > 15


def scan_rules(
    docs: DataFrame, rules: Iterable[Rule], keys: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """One row per match: keys, rule, position among the rule's matches (from 1), matched text."""
    rules = list(rules)
    return (
        _with_hits(docs.select(*keys, text), rules, text)
        .select(*keys, F.inline_outer("_hits"))
        .where(F.col("rule").isNotNull())
        .select(*keys, _names(rules).alias("rule"), F.posexplode_outer("hits").alias("pos", "match"))
        .withColumn("pos", F.col("pos") + 1)
    )


def _with_hits(docs: DataFrame, rules: Sequence[Rule], text: str, counted: bool = False) -> DataFrame:
    """Add ``_hits``: array<struct<rule, hits>> of the numbers of those rules that match a text, and their matches or the
    number of them. Rules that RE2 does not read alike are searched by their expressions."""
    rest = [(i, r) for i, r in enumerate(rules) if not _re2(_search(r))]
    walk = _worth_a_walk([r for _, r in rest])
    hits = lambda r: F.size(rule_matches(r, text, walk=walk)).cast("bigint") if counted else rule_matches(r, text, walk=walk)
    size = (lambda h: h) if counted else F.size
    others = F.filter(F.array(*[F.struct(F.lit(i).alias("rule"), hits(r).alias("hits")) for i, r in rest]), lambda h: size(h["hits"]) > 0)
    if len(rest) == len(rules):
        return with_gates(docs, text, rules).withColumn("_hits", others)
    searches = tuple((i, _search(r)) for i, r in enumerate(rules) if _re2(_search(r)))
    found = docs.withColumn("_hits", _rules_in(searches, counted)(F.make_valid_utf8(F.col(text))))
    return with_gates(found, text, [r for _, r in rest]).withColumn("_hits", F.concat("_hits", others)) if rest else found


def _names(rules: Sequence[Rule]) -> Column:
    return F.get(F.array(*[F.lit(r.rule_id) for r in rules]), F.col("rule"))


def count_rules(docs: DataFrame, rules: Iterable[Rule], text: str = "text") -> DataFrame:
    """Matches and matching documents of every rule that matches at all."""
    rules = list(rules)
    return (
        _with_hits(docs.select(text), rules, text, counted=True)
        .select(F.inline_outer("_hits"))
        .where(F.col("rule").isNotNull())
        .groupBy(_names(rules).alias("rule"))
        .agg(F.sum("hits").alias("n_matches"), F.count(F.lit(1)).alias("n_docs"))
    )


def concat_arrays(parts: Sequence[Column]) -> Column:
    return F.flatten(F.array(*parts)) if parts else F.expr(_EMPTY)


def known_presets(requested: Iterable[str]) -> list[Preset]:
    """The requested presets in request order; ids that do not exist are skipped."""
    return [PRESETS[p] for p in requested if p in PRESETS]


# --- keywords ---------------------------------------------------------------------------------------


def _cut(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """Pieces of a text, as strings. They may overlap."""
    size = end - first
    pieces = raw[np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)]
    return pa.StringArray.from_buffers(len(size), _ends(size).buffers()[1], pa.py_buffer(pieces))


def _value_spans(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in each window (of characters from ``first`` to ``end``) the value stands, without the white space around it:
    what ``^[^:=\\n]*[:=]?\\s*([^\\n,;]{2,50})`` captures. Where a value of two characters or less would be captured the
    span is empty or as short. (If less than two characters follow the white space, the pattern goes back character by
    character, so the first place where it finds two of them holds no more.)"""
    text = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    space = _SPACE[np.minimum(text, 0xFFFF)]

    def ahead(places: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.minimum(np.append(places, len(text))[np.searchsorted(places, at)], end)

    sign = ahead(np.flatnonzero((text == 58) | (text == 61) | (text == 10)), first)
    after = sign + ((sign < end) & (np.append(text, 10)[sign] != 10))
    letters = np.flatnonzero(~space)
    begin = ahead(letters, after)
    stop = np.minimum(ahead(np.flatnonzero((text == 10) | (text == 44) | (text == 59)), begin), begin + VALUE_CHARS)
    last = np.append(letters, -1)[np.searchsorted(letters, stop) - 1] + 1
    return begin, np.where(stop > begin, np.maximum(last, begin), begin)


@cache
def _windows(keywords: tuple[str, ...]) -> Callable[[Column], Column]:
    """array<struct<word, window, value>>: at every place of a text where a keyword begins, the number of the longest one, up
    to 100 characters from there, and the value that follows the keyword. Keywords are in lower case."""
    # A table of the letters that go on from each beginning of a keyword; 0 is the text's own letter, not a beginning.
    steps, words = [np.zeros(256, np.int32)], [-1]
    for number, keyword in enumerate(keywords):
        node = 0
        for byte in keyword.encode():
            if not steps[node][byte]:
                steps[node][byte] = len(steps)
                steps.append(np.zeros(256, np.int32))
                words.append(-1)
            node = steps[node][byte]
        words[node] = number
    table, word_of = np.stack(steps), np.array(words, np.int32)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def windows(text: pa.Array) -> pa.Array:
        wide = text.fill_null("").cast(pa.large_string())
        starts = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
        raw = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
        starts = starts - starts[0]
        low = lower[raw]
        letters = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))  # where each character begins
        at = letters[:-1]
        node, ends, text_end = np.zeros(len(at), np.int32), at.copy(), None
        best = np.full(len(at), word_of[0], np.int32)
        alive, here = np.arange(len(at)), at
        while len(alive):
            node = table[node, low[here]]
            go = node > 0
            alive, node, here = alive[go], node[go], here[go] + 1
            if text_end is None:
                text_end = starts[np.searchsorted(starts, at[alive], "right")]
            else:
                text_end = text_end[go]
            whole = word_of[node] >= 0
            best[alive[whole]] = word_of[node[whole]]
            inside = here < text_end
            alive, node, here, text_end = alive[inside], node[inside], here[inside], text_end[inside]
        hit = np.flatnonzero(best >= 0)
        row = np.searchsorted(starts, at[hit], "right") - 1
        end = np.minimum(hit + WINDOW_CHARS, np.searchsorted(at, starts[row + 1]))
        window = _cut(raw, letters[hit], letters[end])
        value = _cut(raw, *(letters[x] for x in _value_spans(raw, hit, end)))
        found = pa.StructArray.from_arrays([pa.array(best[hit]), window, value], ["word", "window", "value"])
        return pa.ListArray.from_arrays(_ends(np.bincount(row, minlength=len(text))), found, mask=text.is_null())

    return F.arrow_udf(windows, "array<struct<word:int,window:string,value:string>>").asNondeterministic()


def _hits(presets: Sequence[Sequence[str]], text: str) -> Column:
    """array<struct<preset, keyword, pos, window, value>>: the occurrences of every keyword list, in the order of lists,
    keywords and text. ``value`` is what follows the keyword, NULL where it is rejected."""
    places: dict[str, list[tuple[int, int]]] = {}
    for p, keywords in enumerate(presets):
        for k, keyword in enumerate(keywords):
            places.setdefault(keyword.lower(), []).append((p, k))
    if not places:
        return F.expr("cast(array() as array<struct<preset:int,keyword:int,pos:int,window:string,value:string>>)")
    # A window begins with its longest keyword and with every keyword that begins that one.
    inside = [sorted({x for v in places if w.startswith(v) for x in places[v]}) for w in places]
    row = lambda p, k: F.struct(F.lit(p).alias("preset"), F.lit(k).alias("keyword"), F.lit(presets[p][k].lower()).alias("kw"))
    table = F.array(*[F.array(*[row(p, k) for p, k in found]) for found in inside])

    def at(window: Column, pos: Column) -> Column:
        value = window["value"]
        return F.transform(
            F.get(table, window["word"]),
            lambda k: F.struct(
                k["preset"].alias("preset"),
                k["keyword"].alias("keyword"),
                pos.alias("pos"),
                window["window"].alias("window"),
                F.when(keep_value(value, k["kw"]), value).alias("value"),
            ),
        )

    return F.array_sort(F.flatten(F.transform(_windows(tuple(places))(F.make_valid_utf8(F.col(text))), at)))


def _of_preset(hits: Column, preset: int) -> Column:
    return F.filter(hits, lambda h: h["preset"] == preset)


def keep_value(value: Column, keyword: Column) -> Column:
    """``value`` has no white space around it."""
    return (F.length(value) > 2) & (F.lower(value) != keyword) & ~F.lower(value).isin(*COMMON_WORDS)


def _values(hits: Column) -> Column:
    return F.filter(F.transform(hits, lambda h: h["value"]), lambda v: v.isNotNull())


def keyword_hits(keywords: Sequence[str], text: str = "text") -> Column:
    """array<struct<keyword, windows>>: the up to 100 characters from each occurrence on, for keywords that occur."""
    names = F.array(*[F.lit(k.lower()) for k in keywords])
    one = let(
        _hits([keywords], text),
        lambda hits: F.transform(
            names,
            lambda name, i: F.struct(
                name.alias("keyword"),
                F.transform(F.filter(hits, lambda h: h["keyword"] == i), lambda h: h["window"]).alias("windows"),
            ),
        ),
    )
    return F.filter(one, lambda k: F.size(k["windows"]) > 0)


def keyword_values(keywords: Sequence[str], text: str = "text") -> Column:
    """Values found after the keywords, in keyword order then text order."""
    return _values(_hits([keywords], text))


def custom_hits(keywords: Sequence[str], text: str = "text") -> Column:
    """Occurrences of the user's own keywords, in the casing of the text; blank keywords are ignored."""
    table = [k for k in keywords if k.strip()]
    if not table:
        return F.expr(_EMPTY)
    pairs = F.array(
        *[
            F.struct(
                F.lit(k.lower()).alias("kw"), F.lit(f"(?iu)(?=({escape_literal_py(k)}))").alias("re")
            )
            for k in table
        ]
    )
    return F.flatten(
        F.transform(
            F.filter(pairs, lambda k: F.contains(F.col(_LOW), k["kw"])),
            lambda k: F.regexp_extract_all(F.col(text), k["re"], F.lit(1)),
        )
    )


def scan_keyword_windows(
    docs: DataFrame, presets: Iterable[str], keys: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """One row per keyword occurrence with its window and the value read from it (NULL if rejected)."""
    known = [p for p in known_presets(presets) if p.keywords]
    names = F.array(
        *[F.struct(F.lit(p.preset_id).alias("preset"), F.array(*[F.lit(k.lower()) for k in p.keywords]).alias("keywords")) for p in known]
    )
    # Occurrences are numbered per keyword; the values are read inside the array, so a filter on one stays above.
    hits = let(
        _hits([p.keywords for p in known], text),
        lambda all_: F.zip_with(
            all_,
            F.transform(running(_begins(all_), lambda a, x: F.greatest(a, x)), lambda first, i: i + 1 - first),
            lambda h, pos: F.struct(
                F.get(names, h["preset"])["preset"].alias("preset"),
                F.get(F.get(names, h["preset"])["keywords"], h["keyword"]).alias("keyword"),
                pos.alias("pos"),
                h["window"].alias("window"),
                h["value"].alias("value"),
            ),
        ),
    )
    return docs.select(*keys, F.inline(hits))


def _begins(hits: Column) -> Column:
    """For hits in order: the place of each where its keyword's hits begin, else 0."""

    def begin(h: Column, i: Column) -> Column:
        before = F.get(hits, i - 1)
        same = (h["preset"] == before["preset"]) & (h["keyword"] == before["keyword"])
        return F.when((i > 0) & same, F.lit(0)).otherwise(i)

    return F.transform(hits, begin)


def count_keywords(docs: DataFrame, presets: Iterable[str], text: str = "text") -> DataFrame:
    """Keyword occurrences per preset."""
    known = [p for p in known_presets(presets) if p.keywords]
    names = F.array(*[F.lit(p.preset_id) for p in known])
    hits = F.transform(_hits([p.keywords for p in known], text), lambda h: F.get(names, h["preset"]))
    return docs.select(F.explode(hits).alias("preset")).groupBy("preset").agg(F.count(F.lit(1)).alias("n_hits"))


def join_keywords(docs: DataFrame, keywords: Sequence[str], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(document, keyword) for every keyword the text contains.

    A contains-join against a word list, run as one walk over each text: the keyword side never becomes a table, and no
    document-keyword pair exists that is not a hit.
    """
    return docs.select(*keys, F.explode(words_in(F.lower("text"), [k.lower() for k in keywords])).alias("keyword"))


# --- pattern scan -----------------------------------------------------------------------------------


def pattern_rules(presets: Iterable[str] = ()) -> list[Rule]:
    """The rules that :func:`pattern_findings` runs."""
    return [*COMMON_RULES, *NAME_RULES, *(r for p in known_presets(presets) for r in p.rules)]


def pattern_findings(
    presets: Iterable[str] = (), custom: Sequence[str] = (), text: str = "text"
) -> Column:
    """Ordered distinct findings of the pattern scan (needs :func:`with_gates` columns)."""
    common = F.transform(all_matches(COMMON_RULES, text), strip_valid)
    names = F.filter(
        all_matches(NAME_RULES, text),
        lambda n: (F.length(n) > 3) & ~is_common_word(n),
    )
    parts = [common, names]
    # The result is a set: a preset's rule that repeats an earlier pattern cannot add anything.
    done = {(r.pattern, r.ignore_case) for r in COMMON_RULES}
    known = known_presets(presets)
    for n, preset in enumerate(known):
        fresh = [r for r in preset.rules if (r.pattern, r.ignore_case) not in done]
        done.update((r.pattern, r.ignore_case) for r in fresh)
        if fresh:
            raw = all_matches(fresh, text)
            parts.append(F.transform(F.filter(raw, lambda m: F.length(m) >= 3), strip_valid))
        if preset.keywords:
            parts.append(lambda hits, n=n: _values(_of_preset(hits, n)))
    if custom:
        parts.append(custom_hits(custom, text))
    # All keyword lists are read off one walk over the text.
    found = let(
        _hits([p.keywords for p in known], text),
        lambda hits: concat_arrays([p(hits) if callable(p) else p for p in parts]),
    )
    return F.filter(F.array_distinct(found), lambda t: F.length(strip_valid(t)) >= 2)


def scan_pattern_arrays(
    docs: DataFrame, presets: Sequence[str] = (), custom: Sequence[str] = (), text: str = "text"
) -> DataFrame:
    """Add ``findings``, the pattern scan's ordered distinct texts. With neither a known or unknown
    preset nor a keyword requested the scan is skipped, as in the interactive tool."""
    if not presets and not custom:
        return docs.withColumn("findings", F.expr(_EMPTY))
    gated = with_gates(docs, text, pattern_rules(presets))
    return drop_gates(gated.withColumn("findings", pattern_findings(presets, custom, text)))


def scan_pattern(
    docs: DataFrame,
    presets: Sequence[str] = (),
    custom: Sequence[str] = (),
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """The pattern scan as rows: keys, ord (from 1), text."""
    return explode_findings(scan_pattern_arrays(docs.select(*keys, text), presets, custom, text), keys)


def explode_findings(docs: DataFrame, keys: Sequence[str], array: str = "findings") -> DataFrame:
    """Rows (keys, ord, text) of a findings array.

    The outer form is deliberate: from a plain explode the optimizer infers ``size(findings) > 0``,
    pushes it below the projection that computes the array, and so runs every rule twice.
    """
    return (
        docs.select(*keys, F.posexplode_outer(array).alias("ord", "text"))
        .where(F.col("ord").isNotNull())
        .withColumn("ord", F.col("ord") + 1)
    )


# --- rule parts of the model scans ------------------------------------------------------------------


def finding(family: int, seq: Column, pos: Column, text: Column, score: float | None, kind: str, source: str) -> Column:
    return F.struct(
        F.lit(family).alias("family"),
        seq.cast("bigint").alias("seq"),
        pos.cast("bigint").alias("pos"),
        text.alias("text"),
        F.lit(score).cast("double").alias("score"),
        F.lit(kind).alias("type"),
        F.lit(source).alias("source"),
    )


def tagged_matches(rules: Sequence[Rule], score: float, source: str, first_seq: int, text: str = "text") -> Column:
    """Array of findings of the given rules, in rule order."""

    def tagged(rule: Rule, seq: int) -> Column:
        return F.transform(
            all_matches([rule], text), lambda m, i: finding(1, F.lit(seq), i + 1, m, score, rule.kind, source)
        )

    return concat_arrays([tagged(r, first_seq + n) for n, r in enumerate(rules)])


def fast_rule_array(text: str = "text") -> Column:
    """Findings of the fast scan's rules, then of its name heuristics, before cleanup and dedup."""
    return F.concat(
        tagged_matches(FAST_RULES, 0.95, "regex", 0, text),
        tagged_matches(FAST_NAME_RULES, 0.85, "heuristic", len(FAST_RULES), text),
    )


def plain_findings(texts: Column, family: int, score: float | None, kind: str, source: str) -> Column:
    """Findings from an ordered array of texts."""
    return F.transform(texts, lambda t, i: finding(family, F.lit(0), i + 1, t, score, kind, source))


def finding_rows(
    docs: DataFrame, keys: Sequence[str], findings: Column, text: str = "text", rules: Iterable[Rule] | None = None
) -> DataFrame:
    """One row per finding. ``findings`` may combine several scans: the texts are read once for all. ``rules``: those
    that they run."""
    return (
        with_gates(docs, text, rules)
        .select(*keys, F.inline_outer(findings))
        .where(F.col("pos").isNotNull())
        .select(*keys, "family", "seq", "pos", "text", "score", "type", "source")
    )


def fast_rule_findings(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    return finding_rows(docs.select(*keys, text), keys, fast_rule_array(text), text, FAST_RULES + FAST_NAME_RULES)


def deep_rule_array(text: str = "text") -> Column:
    """Ordered distinct matches of the deep scan's rules (needs gate columns)."""
    return F.array_distinct(F.transform(all_matches(DEEP_RULES, text), strip_valid))


def scan_deep_rules(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    found = with_gates(docs.select(*keys, text), text, DEEP_RULES).withColumn("findings", deep_rule_array(text))
    return explode_findings(found, keys)


def deep_array(reply: Column, rules: Column) -> Column:
    """Deep scan of one document: the model's items first, then the rules' matches."""
    items = F.transform(F.concat(parse_reply(reply), rules), strip_ws)
    both = F.array_distinct(F.filter(items, lambda t: F.length(t) > 1))
    return F.when(reply_says_nothing(reply), rules).otherwise(both)
