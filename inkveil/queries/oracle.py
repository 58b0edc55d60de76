"""The same results in ANSI SQL, for checking the Spark queries with another engine.

The statements are built from the rule catalogue, but share no logic with the Spark side: the patterns
run untranslated on RE2, positions come from string splits, dedup and numbering from windows, and
covered text is rebuilt character by character.
"""

from __future__ import annotations

from inkveil.catalog.dictionaries import ALL_PRESETS, COMMON_WORDS, PRESETS
from inkveil.catalog.rules import COMMON_RULES, DEEP_RULES, FAST_NAME_RULES, FAST_RULES, NAME_RULES, Rule
from inkveil.functions.dialect import re2_regex
from inkveil.functions.text import PROMPT_HEAD, PROMPT_TAIL
from inkveil.queries.inputs import CALLER_RULES, CUSTOM_KEYWORDS, RECORD_TEXT, REPLY_TEXT
from inkveil.queries.registry import COMBINED_PRESETS, EVERY_RULE, RULE_FAMILIES

_FAST = FAST_RULES + FAST_NAME_RULES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def esc(x: str) -> str:
    return f"regexp_replace({x}, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')"


def hits(rule: Rule, text: str = "text") -> str:
    return f"regexp_extract_all({text}, {lit(re2_regex(rule.pattern, rule.ignore_case))}, {rule.group})"


def is_common(x: str) -> str:
    return f"lower({strip(x)}) IN ({', '.join(lit(w) for w in COMMON_WORDS)})"


DOCS = "docs AS (SELECT doc_id, text FROM documents)"
RECORDS = f"records AS (SELECT -1 - o_orderkey AS doc_id, {RECORD_TEXT} AS text FROM orders)"
ALL_DOCS = f"{DOCS}, {RECORDS}, all_docs AS (SELECT * FROM docs UNION ALL SELECT * FROM records)"
PAGES = f"""pages_all AS (
  SELECT conv_id AS doc_id, turn AS page_no, {collapse('text')} AS text FROM conversations
  UNION ALL SELECT -1 - o_custkey, o_orderkey, {RECORD_TEXT} FROM orders)"""
ITEMS = """items AS (
  SELECT doc_id, page_no, unnest(range(0, len(w))) AS item_no, unnest(w) AS str
  FROM (SELECT doc_id, page_no, string_split(text, ' ') AS w FROM pages_all))"""


def rule_rows(src: str, rules, keys: str = "doc_id", text: str = "text", start: int = 0) -> str:
    """keys, rule, kind, seq, pos, match of every rule over a source."""
    parts = [
        f"SELECT {keys}, {lit(r.rule_id)} AS rule, {lit(r.kind)} AS kind, {start + n}::BIGINT AS seq, "
        f"unnest(range(1, len(h) + 1)) AS pos, unnest(h) AS match "
        f"FROM (SELECT {keys}, {hits(r, text)} AS h FROM {src})"
        for n, r in enumerate(rules)
    ]
    return " UNION ALL ".join(parts)


# --- tagger tokens and their merge --------------------------------------------------------------------

TOKENS = """words AS (
  SELECT doc_id, page_no, i, w, coalesce(upper(w[1]) = w[1] AND lower(w[1]) <> w[1], false) AS cap,
    coalesce(lag(upper(w[1]) = w[1] AND lower(w[1]) <> w[1]) OVER (PARTITION BY doc_id, page_no ORDER BY i), false) AS after_cap
  FROM (SELECT doc_id, page_no, unnest(range(0, len(ws))) AS i, unnest(ws) AS w
        FROM (SELECT doc_id, page_no, string_split(text, ' ') AS ws FROM pages_all))),
typed AS (SELECT *, CASE WHEN length(w) % 4 = 0 THEN 'LOC' ELSE 'PER' END AS k, (length(w) * 37 % 100)::DOUBLE / 100 AS score FROM words),
tokens AS (
  SELECT doc_id, page_no, 2 * i AS idx,
    CASE WHEN cap AND NOT after_cap THEN 'B-' || k WHEN cap THEN 'I-' || k ELSE 'O' END AS entity,
    CASE WHEN length(w) >= 8 THEN left(w, 4) ELSE w END AS word, score FROM typed
  UNION ALL
  SELECT doc_id, page_no, 2 * i + 1, CASE WHEN cap THEN 'I-' || k ELSE 'O' END, '##' || substr(w, 5), score
  FROM typed WHERE length(w) >= 8)"""

NER = """kept AS (SELECT *, substr(entity, 3) AS typ FROM tokens WHERE score >= 0.5 AND entity <> 'O'),
flagged AS (SELECT *, CASE WHEN entity LIKE 'B-%' OR lag(typ) OVER o IS NULL OR lag(typ) OVER o <> typ THEN 1 ELSE 0 END AS st
  FROM kept WINDOW o AS (PARTITION BY doc_id, page_no ORDER BY idx)),
islands AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page_no ORDER BY idx) AS isl FROM flagged),
ner AS (SELECT doc_id, page_no, min(idx) AS seq,
    string_agg(CASE WHEN st = 1 OR word LIKE '##%' THEN '' ELSE ' ' END || regexp_replace(word, '^##', ''), '' ORDER BY idx) AS text,
    max(score) AS score, any_value(typ) AS type
  FROM islands GROUP BY doc_id, page_no, isl)"""

NER_ROWS = "SELECT doc_id, page_no, 0::BIGINT AS family, seq::BIGINT AS seq, 0::BIGINT AS pos, text, score, type, 'bert' AS source FROM ner WHERE length(text) > 1"


def fast_rows(src: str, keys: str) -> str:
    regex = rule_rows(src, FAST_RULES, keys)
    names = rule_rows(src, FAST_NAME_RULES, keys, start=len(FAST_RULES))
    return (
        f"SELECT {keys}, 1::BIGINT AS family, seq, pos, match AS text, 0.95::DOUBLE AS score, kind AS type, 'regex' AS source FROM ({regex})"
        f" UNION ALL SELECT {keys}, 1::BIGINT, seq, pos, match, 0.85::DOUBLE, 'name', 'heuristic' FROM ({names})"
    )


def not_trivial(src: str) -> str:
    return f"SELECT * FROM ({src}) WHERE length({strip('text')}) > 1 AND NOT regexp_full_match({strip('text')}, '[\\d\\s]+')"


def first_by(src: str, keys: str, same: str) -> str:
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, {same} "
        f"ORDER BY family, seq, pos) AS rn FROM ({src})) WHERE rn = 1"
    )


_PK = "doc_id, page_no"
FAST_ALL = not_trivial(f"{NER_ROWS} UNION ALL {fast_rows('pages_all', _PK)}")
FAST = first_by(FAST_ALL, _PK, strip("text"))


# --- pattern scan -------------------------------------------------------------------------------------


def keyword_rows(src: str, keys: str, keywords: list[tuple[int, int, str]]) -> str:
    """keys, part, seq, kw, pos, win for every keyword occurrence."""
    values = ", ".join(f"({p}, {n}, {lit(k)})" for p, n, k in keywords)
    # string_split finds occurrences that do not overlap; no keyword can overlap itself in these texts
    return f"""SELECT {keys}, part, seq, kw, pos,
      substr(text, CAST(1 + list_sum(list_transform(s[1:pos], lambda x: length(x))) + (pos - 1) * length(kw) AS BIGINT), 100) AS win
    FROM (SELECT *, unnest(range(1, len(s))) AS pos FROM (
      SELECT {keys}, text, part, seq, kw, string_split(lower(text), kw) AS s
      FROM {src}, (VALUES {values}) k(part, seq, kw) WHERE contains(lower(text), kw)))"""


_VALUE = strip("regexp_extract(win, '^[^:=\\n]*[:=]?\\s*([^\\n,;]{2,50})', 1)")


def value_rows(src: str, keys: str, keywords) -> str:
    return (
        f"SELECT * FROM (SELECT *, {_VALUE} AS value FROM ({keyword_rows(src, keys, keywords)})) "
        f"WHERE length(value) > 2 AND lower(value) <> kw AND NOT {is_common('value')}"
    )


def pattern_rows(src: str, keys: str, presets, custom=()) -> str:
    """keys, ord, text of the pattern scan."""
    known = [PRESETS[p] for p in presets if p in PRESETS]
    parts = [
        f"SELECT {keys}, 0 AS part, seq, pos, {strip('match')} AS text FROM ({rule_rows(src, COMMON_RULES, keys)})",
        f"SELECT {keys}, 1, seq, pos, match FROM ({rule_rows(src, NAME_RULES, keys)}) WHERE length(match) > 3 AND NOT {is_common('match')}",
    ]
    words = []
    for n, p in enumerate(known):
        if p.rules:
            parts.append(
                f"SELECT {keys}, {2 + 2 * n}, seq, pos, {strip('match')} FROM ({rule_rows(src, p.rules, keys)}) WHERE length(match) >= 3"
            )
        words += [(3 + 2 * n, i, k) for i, k in enumerate(p.keywords)]
    if words:
        parts.append(f"SELECT {keys}, part, seq, pos, value FROM ({value_rows(src, keys, words)})")
    own = [k for k in custom if k.strip()]
    if own:
        parts.append(f"SELECT {keys}, 1000, seq, pos, text FROM ({custom_rows(src, keys, own)})")
    union = " UNION ALL ".join(parts)
    return f"""SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY o) AS ord, text FROM (
      SELECT {keys}, text, min(part * 1000000000::BIGINT + seq * 1000000 + pos) AS o FROM ({union})
      WHERE length({strip('text')}) >= 2 GROUP BY {keys}, text)"""


def custom_rows(src: str, keys: str, own) -> str:
    values = ", ".join(f"({n}, {lit(k.lower())})" for n, k in enumerate(own))
    return f"""SELECT {keys}, seq, pos,
      substr(text, CAST(1 + list_sum(list_transform(s[1:pos], lambda x: length(x))) + (pos - 1) * length(kw) AS BIGINT), length(kw)) AS text
    FROM (SELECT *, unnest(range(1, len(s))) AS pos FROM (
      SELECT {keys}, text, seq, kw, string_split(lower(text), kw) AS s
      FROM {src}, (VALUES {values}) k(seq, kw) WHERE contains(lower(text), kw)))"""


def pattern_findings(src: str, keys: str, presets, custom=()) -> str:
    return (
        f"SELECT {keys}, 2::BIGINT AS family, 0::BIGINT AS seq, ord AS pos, text, 0.9::DOUBLE AS score, "
        f"'pattern' AS type, 'intel' AS source FROM ({pattern_rows(src, keys, presets, custom)})"
    )


def combined(model: str, patterns: str) -> str:
    both = f"SELECT * FROM (SELECT * FROM ({model}) UNION ALL SELECT * FROM ({patterns})) WHERE length({strip('text')}) > 2"
    return first_by(both, _PK, f"lower({collapse('text')})")


# --- model replies ------------------------------------------------------------------------------------

REPLIES = f"replies AS (SELECT *, {REPLY_TEXT} AS reply FROM pages_all)"
NOTHING = f"({strip('reply')} = 'NONE' OR contains(lower(reply), 'no pii') OR contains(lower(reply), 'no sensitive'))"
_STEP1 = f"list_transform(string_split_regex({strip('reply')}, '[\\n,]'), lambda x: {strip('x')})"
_STEP2 = f"list_transform({_STEP1}, lambda x: regexp_replace(x, '^[-•*\\d.)\\]]+\\s*', ''))"
_STEP3 = f"""list_transform({_STEP2}, lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g'))"""
REPLY_ITEMS = f"""list_filter({_STEP3}, lambda x: length(x) > 1 AND x <> 'NONE' AND NOT contains(lower(x), 'none found')
  AND NOT starts_with(lower(x), 'no ') AND NOT regexp_full_match(x, '(?i)[a-z\\s]+:'))"""

_DEEP_RULES_LIST = "flatten([" + ", ".join(hits(r) for r in DEEP_RULES) + "])"


def ordered_distinct(src: str, keys: str) -> str:
    """keys, ord, text from rows (keys, items list): first occurrence of each stripped item."""
    return f"""SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY o) AS ord, text FROM (
      SELECT {keys}, text, min(i) AS o FROM (
        SELECT {keys}, unnest(range(1, len(items) + 1)) AS i, {strip('unnest(items)')} AS text FROM ({src})) GROUP BY {keys}, text)"""


DEEP = f"""SELECT doc_id, page_no, 1::BIGINT AS family, 0::BIGINT AS seq, ord AS pos, text, NULL::DOUBLE AS score, 'unknown' AS type, 'ai' AS source
  FROM ({ordered_distinct(f"SELECT doc_id, page_no, CASE WHEN {NOTHING} THEN {_DEEP_RULES_LIST} ELSE list_concat({REPLY_ITEMS}, {_DEEP_RULES_LIST}) END AS items FROM replies WHERE reply IS NOT NULL", _PK)})
  WHERE length(text) > 1
  UNION ALL SELECT f.* FROM ({FAST}) f SEMI JOIN (SELECT * FROM replies WHERE reply IS NULL) n ON f.doc_id = n.doc_id AND f.page_no = n.page_no"""


# --- entities, targets, masks ---------------------------------------------------------------------------

ENTITIES = f"""ents AS (SELECT doc_id, page_no, seq, pos, text, score, type, source
  FROM ({not_trivial(fast_rows('pages_all', _PK))}))"""


def longest(x: str) -> str:
    words = f"string_split({collapse(x)}, ' ')"
    return f"list_min(list_transform({words}, lambda w, i: {{'l': -length(w), 'i': i, 'w': w}})).w"


MANUAL = f"manual AS (SELECT doc_id, page_no AS seq, {longest('text')} AS text FROM pages_all)"
TARGETS = f"""{PAGES}, {ENTITIES}, {MANUAL},
targets AS (SELECT doc_id, text FROM ents UNION SELECT doc_id, text FROM manual),
clean AS (SELECT doc_id, {collapse('text')} AS target FROM targets WHERE regexp_matches(text, '\\S'))"""
SPANS = f"""{TARGETS},
spans AS (SELECT doc_id, page_no, target, s, s + length(target) AS e FROM (
  SELECT doc_id, page_no, target,
    CAST(1 + list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(target) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(g))) AS i FROM (
    SELECT p.doc_id, p.page_no, c.target, string_split(lower(p.text), lower(c.target)) AS g
    FROM pages_all p JOIN clean c ON p.doc_id = c.doc_id WHERE contains(lower(p.text), lower(c.target))))))"""
REDACTED = f"""{SPANS},
per_page AS (SELECT doc_id, page_no, list({{'s': s, 'e': e}}) AS l, count(*) AS n FROM spans GROUP BY ALL),
redacted AS (SELECT p.doc_id, p.page_no,
    CASE WHEN l IS NULL THEN p.text ELSE array_to_string(list_transform(range(1, length(p.text) + 1),
      lambda i: CASE WHEN len(list_filter(l, lambda x: x.s <= i AND i < x.e)) > 0 THEN '█' ELSE substr(p.text, i, 1) END), '') END AS text,
    coalesce(n, 0) AS n_redactions
  FROM pages_all p LEFT JOIN per_page q ON p.doc_id = q.doc_id AND p.page_no = q.page_no)"""
MERGED = f"""{SPANS},
marked AS (SELECT doc_id, page_no, s, e, CASE WHEN max(e) OVER (PARTITION BY doc_id, page_no ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS st FROM spans),
numbered AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page_no ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM marked)"""

_AUTO = "flatten([" + ", ".join(hits(r) for r in _FAST) + "])"
# Per document: auto targets in first-seen order, and the manual one.
WITH_TARGETS = f"""{ALL_DOCS},
found AS (SELECT doc_id, text, {_AUTO} AS raw, [{longest('text')}] AS manual FROM all_docs),
aimed AS (SELECT doc_id, text, manual, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS auto FROM found)"""


def by_length(x: str) -> str:
    keyed = f"list_transform({x}, lambda t, i: {{'l': -length(t), 'i': i, 't': t}})"
    return f"list_transform(list_sort({keyed}), lambda s: s.t)"


_MASK = (
    f"list_reduce({by_length('list_concat(auto, manual)')}, lambda acc, t: "
    f"regexp_replace(acc, {esc('t')}, repeat('█', least(length(t), 20)), 'gi'), text)"
)


def html(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# Each target in turn is replaced by a code point of its own, even on the first character of a hit, odd on the others.
_FIRST_MARK, _LAST_MARK = 0xE000, 0xF8FF
_MARKED = f"""list_reduce(list_prepend({{'t': lower(text), 'a': '', 'b': ''}}, list_transform(ts, lambda t, i:
  {{'t': lower(t), 'a': chr(CAST({_FIRST_MARK} + 2 * i AS INTEGER)), 'b': chr(CAST({_FIRST_MARK} + 1 + 2 * i AS INTEGER))}})),
  lambda x, y: {{'t': replace(x.t, y.t, y.a || repeat(y.b, length(y.t) - 1)), 'a': '', 'b': ''}}).t"""
_HIGHLIGHTED = f"""list_transform(cs, lambda c, i: CASE WHEN ks[i] BETWEEN {_FIRST_MARK} AND {_LAST_MARK} AND ks[i] % 2 = 0
    THEN '<mark class="text-highlight-' || CASE WHEN list_contains(low_manual, lower(ts[(ks[i] - {_FIRST_MARK}) // 2])) THEN 'manual' ELSE 'auto' END || '">' ELSE '' END
  || {html('c')} || CASE WHEN ks[i] BETWEEN {_FIRST_MARK} AND {_LAST_MARK} AND NOT (coalesce(ks[i + 1], 0) BETWEEN {_FIRST_MARK} AND {_LAST_MARK} AND ks[i + 1] % 2 = 1)
    THEN '</mark>' ELSE '' END)"""

ITEM_FLAGS = f"""{PAGES}, {ITEMS}, {ENTITIES}, {MANUAL},
ent AS (SELECT DISTINCT doc_id, lower({collapse('text')}) AS t, false AS m FROM ents
  UNION SELECT DISTINCT doc_id, lower({collapse('text')}), true FROM manual WHERE regexp_matches(text, '\\S')),
pairs AS (SELECT i.doc_id, i.page_no, i.item_no, i.str, e.m FROM items i JOIN ent e ON i.doc_id = e.doc_id
  WHERE i.str <> '' AND (contains(lower(i.str), e.t) OR contains(e.t, lower(i.str))
    OR len(list_filter(string_split(e.t, ' '), lambda w: contains(lower(i.str), w))) > 0)),
flags AS (SELECT doc_id, page_no, item_no, bool_or(m) AS mm, bool_or(NOT m) AS dd FROM pairs GROUP BY ALL)"""

LISTED = f"""{PAGES}, {ENTITIES}, {MANUAL}, listed AS (SELECT doc_id, 0::BIGINT AS part, page_no, seq, pos, text, score, type, source FROM ents
  UNION ALL SELECT doc_id, 1, NULL, seq, NULL, text, 1.0, 'manual', 'manual' FROM manual)"""
PAGED = f"""{LISTED},
n1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, 0) DESC, part, page_no, seq, pos) AS n,
  count(*) OVER (PARTITION BY doc_id) AS total FROM listed),
n2 AS (SELECT *, (n + 16) // 17 AS page FROM n1),
paged AS (SELECT *, ((page - 1) * 17 + 1) || '-' || least(page * 17, total) || ' of ' || total AS label FROM n2)"""

_META_VALUE = "CASE doc_id % 3 WHEN 0 THEN {c} WHEN 1 THEN '' END"


def _or_default(c: str, default: str, name: str) -> str:
    return f"coalesce(nullif({_META_VALUE.format(c=c)}, ''), {lit(default)}) AS {name}"


def oracle() -> dict[str, str]:
    sql: dict[str, str] = {}
    for name, rules in RULE_FAMILIES.items():
        sql[name] = f"WITH {ALL_DOCS} SELECT doc_id, rule, pos, match FROM ({rule_rows('all_docs', rules)})"
    sql["rule_histogram"] = (
        f"WITH {ALL_DOCS} SELECT rule, count(*) AS n_matches, count(DISTINCT doc_id) AS n_docs "
        f"FROM ({rule_rows('all_docs', EVERY_RULE)}) GROUP BY rule"
    )
    words = "string_split(text, ' ')"
    table = f"""SELECT 'W' || item_id AS rule, CASE WHEN item_id % 2 = 0 THEN '(?i)' ELSE '' END || {esc(words + '[3]')} || '\\s+' || {esc(words + '[4]')} AS re
      FROM benchmark WHERE len({words}) > 3"""
    from_items = f"SELECT doc_id, rule, regexp_extract_all(text, re) AS h FROM all_docs, (SELECT DISTINCT * FROM ({table}))"
    sql["rules_cross"] = f"""WITH {ALL_DOCS} SELECT doc_id, rule, pos, match FROM ({rule_rows('all_docs', CALLER_RULES)})
      UNION ALL SELECT doc_id, rule, unnest(range(1, len(h) + 1)), unnest(h) FROM ({from_items})"""
    sql["rules_led"] = sql["rules_cross"]
    sql["rules_rejected"] = "SELECT 'R' || r_regionkey AS rule, '(' || r_name AS pattern FROM region"
    urls = [r for r in EVERY_RULE if r.rule_id in ("C16", "C17", "A09")]
    sql["scan_urls"] = f"SELECT page_id, rule, pos, match FROM ({rule_rows('pages', urls, 'page_id', 'url')})"
    sql["scan_deep_rules"] = (
        f"WITH {ALL_DOCS} {ordered_distinct(f'SELECT doc_id, {_DEEP_RULES_LIST} AS items FROM all_docs', 'doc_id')}"
    )
    sql["scan_intel"] = f"WITH {ALL_DOCS} {pattern_rows('all_docs', 'doc_id', ALL_PRESETS, CUSTOM_KEYWORDS)}"

    numbered = [(n, i, k) for n, p in enumerate(PRESETS.values()) for i, k in enumerate(p.keywords)]
    names = "(VALUES " + ", ".join(f"({n}, {lit(p)})" for n, p in enumerate(PRESETS)) + ") names(part, preset)"
    sql["keyword_windows"] = (
        f"WITH {ALL_DOCS} SELECT doc_id, preset, kw AS keyword, pos, win AS \"window\" "
        f"FROM ({keyword_rows('all_docs', 'doc_id', numbered)}) JOIN {names} USING (part)"
    )
    sql["keyword_values"] = (
        f"WITH {ALL_DOCS} SELECT doc_id, preset, kw AS keyword, pos, value "
        f"FROM ({value_rows('all_docs', 'doc_id', numbered)}) JOIN {names} USING (part)"
    )
    words = ", ".join(f"({lit(k)})" for k in sorted({k for p in PRESETS.values() for k in p.keywords}))
    sql["keyword_join"] = (
        f"WITH {ALL_DOCS} SELECT doc_id, keyword FROM all_docs, (VALUES {words}) k(keyword) WHERE contains(lower(text), keyword)"
    )
    own = [k for k in CUSTOM_KEYWORDS if k.strip()]
    sql["custom_keywords"] = (
        f"WITH {ALL_DOCS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, pos) AS ord, text "
        f"FROM ({custom_rows('all_docs', 'doc_id', own)})"
    )
    sql["ner_merge"] = f"WITH {PAGES}, {TOKENS}, {NER} {NER_ROWS}"
    sql["scan_fast"] = f"WITH {PAGES}, {TOKENS}, {NER} {FAST}"
    sql["parse_llm_reply"] = (
        f"WITH {PAGES}, {REPLIES} SELECT doc_id, page_no, unnest(range(1, len(items) + 1)) AS ord, unnest(items) AS text "
        f"FROM (SELECT doc_id, page_no, {REPLY_ITEMS} AS items FROM replies WHERE reply IS NOT NULL AND NOT {NOTHING})"
    )
    sql["llm_prompt"] = (
        f"SELECT doc_id, length(p) AS n_chars, md5(p) AS digest FROM "
        f"(SELECT doc_id, {lit(PROMPT_HEAD)} || left(text, 3000) || {lit(PROMPT_TAIL)} AS p FROM documents)"
    )
    def chunks(size: int, overlap: int) -> str:
        step = size - overlap
        last = f"greatest(0, (length(text) - {overlap} - 1) // {step})"
        return f"""SELECT doc_id, k::BIGINT AS chunk_no, (k * {step})::BIGINT AS start, substr(text, CAST(1 + k * {step} AS BIGINT), {size}) AS text
          FROM (SELECT doc_id, text, unnest(range(0, {last} + 1)) AS k FROM documents)"""

    sql["llm_prompt_chunks"] = f"""SELECT doc_id, chunk_no, start, length(p) AS n_chars, md5(p) AS digest FROM
      (SELECT doc_id, chunk_no, start, {lit(PROMPT_HEAD)} || text || {lit(PROMPT_TAIL)} AS p FROM ({chunks(3000, 300)}))"""
    replies = REPLY_TEXT.replace("page_no", "chunk_no")
    sql["llm_reply_chunks"] = f"""WITH r AS (SELECT doc_id, chunk_no, {replies} AS reply FROM ({chunks(1000, 100)})),
      i AS (SELECT doc_id, chunk_no, unnest(range(0, len(items))) AS pos, unnest(items) AS text
        FROM (SELECT doc_id, chunk_no, {REPLY_ITEMS} AS items FROM r WHERE reply IS NOT NULL AND NOT {NOTHING}))
      SELECT doc_id, chunk_no, pos, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY chunk_no, pos) AS rn FROM i) WHERE rn = 1"""
    # One text, not chunks: the numbers of tokens are places in it.
    whole = f"""w AS (SELECT doc_id, i, w, coalesce(upper(w[1]) = w[1] AND lower(w[1]) <> w[1], false) AS cap,
        sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - 1 AS place
        FROM (SELECT doc_id, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents))),
      t AS (SELECT doc_id, place::BIGINT AS idx, cap, (CASE WHEN lag(cap) OVER (PARTITION BY doc_id ORDER BY i) THEN 'I-' ELSE 'B-' END) || CASE WHEN length(w) % 4 = 0 THEN 'LOC' ELSE 'PER' END AS entity,
        w AS word, (length(w) * 37 % 100)::DOUBLE / 100 AS score FROM w),
      tokens AS (SELECT 0 AS page_no, * FROM t WHERE cap)"""
    sql["ner_chunks"] = f"WITH {whole}, {NER} SELECT * EXCLUDE (page_no) FROM ({NER_ROWS})"
    sql["ner_merge_legacy"] = f"WITH {PAGES}, {TOKENS}, {NER.replace('score >= 0.5', 'score >= 0.85')} {NER_ROWS}"
    sql["scan_deep"] = f"WITH {PAGES}, {TOKENS}, {NER}, {REPLIES} {DEEP}"
    sql["scan_combined"] = (
        f"WITH {PAGES}, {TOKENS}, {NER} "
        f"{combined(FAST, pattern_findings('pages_all', _PK, COMBINED_PRESETS, CUSTOM_KEYWORDS))}"
    )
    sql["scan_combined_deep"] = (
        f"WITH {PAGES}, {TOKENS}, {NER}, {REPLIES} {combined(DEEP, pattern_findings('pages_all', _PK, ['insurance']))}"
    )
    sql["scan_offline"] = f"WITH {ALL_DOCS} {pattern_findings('all_docs', 'doc_id', COMBINED_PRESETS)}"
    table = ", ".join(
        f"({lit(p.preset_id)}, {lit(p.name)}, {lit(p.description)}, {len(p.rules)}, {len(p.keywords)}, {n})"
        for n, p in enumerate(PRESETS.values())
    )
    sql["preset_catalog"] = f"""WITH {ALL_DOCS}, used AS (SELECT part, count(*) AS n FROM ({keyword_rows('all_docs', 'doc_id', numbered)}) GROUP BY part)
      SELECT preset_id, name, description, n_rules::BIGINT AS n_rules, n_keywords::BIGINT AS n_keywords, coalesce(n, 0) AS n_hits
      FROM (VALUES {table}) t(preset_id, name, description, n_rules, n_keywords, part) LEFT JOIN used USING (part)"""
    ids = "[" + ", ".join(lit(i) for i in ("tax-form", "education", *ALL_PRESETS)) + "]"
    sql["preset_lookup"] = f"""SELECT event_id, preset_id, name FROM (SELECT event_id, ({ids})[event_id % {2 + len(ALL_PRESETS)} + 1] AS preset_id FROM events)
      JOIN (VALUES {table}) t(preset_id, name, description, n_rules, n_keywords, part) USING (preset_id)"""

    sql["dedup_normalized"] = f"""WITH {PAGES}, {ENTITIES} SELECT doc_id, page_no, seq, pos, text, score, type, source FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, lower({collapse('text')}) ORDER BY page_no, seq, pos) AS rn FROM ents WHERE length({strip('text')}) > 2) WHERE rn = 1"""
    sql["stopword_filter"] = (
        f"WITH {PAGES}, {ITEMS} SELECT doc_id, count(*) AS n_kept FROM items WHERE length(str) > 3 AND NOT {is_common('str')} GROUP BY doc_id"
    )
    sql["counts_by_source"] = (
        f"WITH {PAGES}, {TOKENS}, {NER} SELECT doc_id, count(*) FILTER (source IS DISTINCT FROM 'intel') AS n_ai, "
        f"count(*) FILTER (source = 'intel') AS n_intel, count(*) AS n_total "
        f"FROM ({combined(FAST, pattern_findings('pages_all', _PK, ['legal-document']))}) GROUP BY doc_id"
    )
    sql["session_stats"] = (
        f"WITH {TARGETS} SELECT (SELECT count(*) FROM documents) AS scanned, (SELECT count(*) FROM ents) + (SELECT count(*) FROM manual) AS entities, (SELECT count(*) FROM targets) AS redacted"
    )
    sql["running_stats"] = """WITH f AS (SELECT user_id, event_type AS source, min(ts) AS ts FROM events GROUP BY user_id, event_type),
      w AS (SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS begins, source, count(*) AS n_found FROM f GROUP BY ALL)
      SELECT *, sum(n_found) OVER (PARTITION BY source ORDER BY begins)::BIGINT AS n_total FROM w"""
    sql["confidence_band"] = f"""WITH {PAGES}, {TOKENS}, s AS (SELECT doc_id, page_no, idx, CASE WHEN score >= 0.04 THEN score END AS score,
        CASE idx % 3 WHEN 0 THEN 'bert' WHEN 1 THEN 'regex' ELSE 'intel' END AS source FROM tokens)
      SELECT *, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AS band,
        CASE WHEN score <> 0 THEN CAST(floor(score * 100 + 0.5) AS BIGINT) END AS percent,
        CASE source WHEN 'bert' THEN 'model' WHEN 'regex' THEN 'rule' ELSE 'other' END AS label FROM s"""
    sql["target_set"] = f"WITH {TARGETS} SELECT doc_id, text FROM targets"
    sql["add_manual"] = f"""WITH {PAGES}, {MANUAL}, b AS (SELECT doc_id, 0::BIGINT AS batch, seq, text FROM manual
        UNION ALL SELECT doc_id, 1, page_no, string_split(text, ' ')[1] FROM pages_all)
      SELECT doc_id, batch, seq, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY batch, seq) AS rn FROM b) WHERE rn = 1"""
    sql["undo_manual"] = f"""WITH {PAGES}, {MANUAL} SELECT doc_id, seq, text FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS rn FROM manual) WHERE rn > 1"""
    sql["remove_entities"] = f"WITH {PAGES}, {ENTITIES} SELECT * FROM ents WHERE pos % 5 <> 0"
    sql["review_log"] = f"""WITH {PAGES}, e AS (SELECT doc_id, page_no AS seq,
        CASE WHEN page_no % 7 = 3 THEN 'undo' WHEN page_no % 7 = 5 THEN 'remove' WHEN page_no % 11 = 10 THEN 'clear' ELSE 'add' END AS a,
        CASE WHEN page_no % 7 % 2 = 0 THEN {longest('text')} ELSE string_split(text, ' ')[1] END AS t FROM pages_all),
      d AS (SELECT doc_id, list({{'a': a, 't': t, 's': seq, 'l': CAST([] AS STRUCT(t VARCHAR, s BIGINT)[])}} ORDER BY seq) AS es FROM e GROUP BY doc_id),
      r AS (SELECT doc_id, list_reduce(list_prepend({{'a': '', 't': '', 's': 0::BIGINT, 'l': CAST([] AS STRUCT(t VARCHAR, s BIGINT)[])}}, es), lambda x, y: {{'a': '', 't': '', 's': 0::BIGINT,
        'l': CASE y.a WHEN 'clear' THEN [] WHEN 'undo' THEN x.l[:-2] WHEN 'remove' THEN list_filter(x.l, lambda z: z.t <> y.t)
          ELSE CASE WHEN y.t IS NULL OR trim(y.t) = '' OR list_contains(list_transform(x.l, lambda z: z.t), y.t) THEN x.l ELSE list_append(x.l, {{'t': y.t, 's': y.s}}) END END}}).l AS l FROM d)
      SELECT doc_id, n, l[n].s AS seq, l[n].t AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM r)"""
    sql["entity_search"] = f"WITH {PAGES}, {ENTITIES} SELECT * FROM ents WHERE contains(lower(text), 'example.com')"
    columns = "doc_id, part, page_no, seq, pos, text, score, type, source, n, total, page, label"
    sql["paginate_entities"] = f"WITH {PAGED} SELECT {columns} FROM paged"
    sql["entity_page"] = f"WITH {PAGED} SELECT {columns} FROM paged WHERE page = 2"
    sql["report_lines"] = f"""WITH {LISTED}, n AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY part, page_no, seq, pos) AS line_no FROM listed)
      SELECT doc_id, CASE WHEN line_no <= 26 THEN 1 ELSE 2 + (line_no - 27) // 32 END AS report_page, line_no, line_no || '. ' || text AS line FROM n"""

    sql["mask_preview"] = f"WITH {WITH_TARGETS} SELECT doc_id, {_MASK} AS masked FROM aimed"
    sql["preview_truncate"] = (
        f"WITH {WITH_TARGETS} SELECT doc_id, left({_MASK}, 5000) || CASE WHEN length(text) > 5000 THEN '...' ELSE '' END AS shown FROM aimed"
    )
    sql["highlight_text"] = f"""WITH {WITH_TARGETS},
      h AS (SELECT doc_id, text, list_transform(manual, lambda t: lower(t)) AS low_manual,
        list_filter({by_length('list_concat(auto, manual)')}, lambda t: t <> '') AS ts FROM aimed),
      m AS (SELECT *, string_split(text, '') AS cs, list_transform(string_split({_MARKED}, ''), lambda c: ord(c)) AS ks FROM h)
      SELECT doc_id, replace(array_to_string({_HIGHLIGHTED}, ''), chr(10), '<br>') AS html FROM m"""
    sql["redact_documents"] = f"""WITH {WITH_TARGETS},
      t AS (SELECT doc_id, text, unnest(list_concat(auto, manual)) AS target FROM aimed),
      u AS (SELECT DISTINCT doc_id, target FROM t WHERE regexp_matches(target, '\\S')),
      c AS (SELECT doc_id, {collapse('target')} AS target FROM u),
      s0 AS (SELECT d.doc_id, d.text, c.target, string_split(lower(d.text), lower(c.target)) AS g FROM all_docs d JOIN c ON d.doc_id = c.doc_id),
      s1 AS (SELECT *, unnest(range(1, len(g))) AS i FROM s0),
      s2 AS (SELECT doc_id, CAST(1 + list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(target) AS BIGINT) AS s, length(target) AS n FROM s1),
      p AS (SELECT doc_id, list({{'s': s, 'e': s + n}}) AS l, count(*) AS n FROM s2 GROUP BY doc_id),
      nt AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
      SELECT d.doc_id, coalesce(nt.n, 0) AS n_targets, coalesce(p.n, 0) AS n_redactions,
        CASE WHEN l IS NULL THEN d.text ELSE array_to_string(list_transform(string_split(d.text, ''),
          lambda ch, i: CASE WHEN len(list_filter(l, lambda x: x.s <= i AND i < x.e)) > 0 THEN '█' ELSE ch END), '') END AS redacted
      FROM all_docs d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN nt ON d.doc_id = nt.doc_id"""
    sql["match_spans"] = f"WITH {SPANS} SELECT doc_id, page_no, target, s, e FROM spans"
    sql["merge_spans"] = f"WITH {MERGED} SELECT doc_id, page_no, min(s) AS s, max(e) AS e FROM numbered GROUP BY doc_id, page_no, isl"
    sql["redact_pages"] = f"WITH {REDACTED} SELECT doc_id, page_no, text, n_redactions FROM redacted"
    sql["redaction_count"] = f"WITH {REDACTED} SELECT doc_id, sum(n_redactions)::BIGINT AS n_redactions FROM redacted GROUP BY doc_id"
    sql["verify_redaction"] = f"""WITH {REDACTED} SELECT r.doc_id, r.page_no, count(c.target) AS n_targets,
        count(*) FILTER (contains(lower(r.text), lower(c.target))) AS n_leaks
      FROM redacted r LEFT JOIN clean c ON r.doc_id = c.doc_id GROUP BY r.doc_id, r.page_no"""
    sql["highlight_items"] = f"""WITH {ITEM_FLAGS} SELECT i.doc_id, i.page_no, i.item_no, i.str, coalesce(mm, false) AS is_manual, coalesce(dd, false) AS is_detected
      FROM items i LEFT JOIN flags f ON i.doc_id = f.doc_id AND i.page_no = f.page_no AND i.item_no = f.item_no"""
    sql["highlight_priority"] = f"""WITH {ITEM_FLAGS} SELECT doc_id, page_no, CASE WHEN mm THEN 'manual' ELSE 'detected' END AS label, count(*) AS n_items
      FROM flags GROUP BY ALL"""

    # Findings in the order of one scan over the whole document, the first of equal texts kept.
    whole = (
        "SELECT doc_id, family, CASE WHEN family = 0 THEN page_no ELSE seq END AS major, CASE WHEN family = 0 THEN seq ELSE page_no END AS minor, pos, "
        "text, score, type, source FROM ({found})"
    )
    first = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower({collapse('text')}) ORDER BY family, major, minor, pos) AS rn FROM ({{rows}})) WHERE rn = 1"
    found = combined(FAST, pattern_findings("pages_all", _PK, COMBINED_PRESETS, CUSTOM_KEYWORDS))
    sql["job_entities"] = f"WITH {PAGES}, {TOKENS}, {NER} {first.format(rows=whole.format(found=found))}"
    long_enough = f"SELECT * FROM ({not_trivial(fast_rows('pages_all', _PK))}) WHERE length({strip('text')}) > 2"
    sql["job_audit"] = f"""WITH {PAGES}, {MANUAL},
      ents AS ({first.format(rows=whole.format(found=long_enough))}),
      targets AS (SELECT doc_id, text FROM ents UNION SELECT doc_id, text FROM manual),
      k AS (SELECT doc_id, count(*) AS n FROM targets GROUP BY doc_id),
      h AS (SELECT doc_id, substr(sha256(string_agg(sha256(text), '' ORDER BY page_no)), 1, 16) AS h FROM pages_all GROUP BY doc_id),
      clean AS (SELECT doc_id, {collapse('text')} AS target FROM targets WHERE regexp_matches(text, '\\S')),
      r AS (SELECT p.doc_id, sum(len(string_split(lower(p.text), lower(c.target))) - 1)::BIGINT AS n FROM pages_all p JOIN clean c ON p.doc_id = c.doc_id GROUP BY p.doc_id)
      SELECT 'REDACTION_START' AS action, h AS doc_hash, n AS n_entities, NULL::BIGINT AS n_redactions FROM h JOIN k USING (doc_id)
      UNION ALL SELECT 'REDACTION_COMPLETE', h, NULL, coalesce(r.n, 0) FROM h JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)"""

    sql["assemble_pages"] = f"SELECT conv_id AS doc_id, turn AS page_no, {collapse('text')} AS text FROM conversations"
    sql["assemble_document"] = (
        f"SELECT conv_id AS doc_id, 0::BIGINT AS part_no, {strip('string_agg(text, chr(10) || chr(10) ORDER BY turn)')} AS text, "
        "count(*) AS page_count FROM conversations GROUP BY conv_id"
    )
    sql["page_count"] = f"WITH {PAGES} SELECT doc_id, count(*) AS page_count FROM pages_all GROUP BY doc_id"
    sql["metadata_defaults"] = (
        "SELECT doc_id, "
        + ", ".join(
            (
                _or_default("source", "Unknown", "title"),
                _or_default("lang", "Unknown", "author"),
                _or_default("lang", "", "subject"),
                _or_default("source", "", "creator"),
                _or_default("source", "", "producer"),
                _or_default("lang", "", "creation_date"),
            )
        )
        + " FROM documents"
    )
    sql["metadata_scrub"] = (
        "SELECT doc_id, 'inkveil' AS producer, 'inkveil' AS creator, 'Redacted Document' AS title, 'Anonymous' AS author, "
        "'Redacted Content' AS subject, 'redacted' AS keywords FROM documents"
    )
    parsed = f"list_filter(list_transform(string_split({{x}}, ','), lambda x: {strip('x')}), lambda x: x <> '')"
    sql["parse_targets"] = (
        "SELECT doc_id, unnest(range(1, len(w) + 1)) AS ord, unnest(w) AS text "
        f"FROM (SELECT doc_id, {parsed.format(x='text')} AS w FROM documents)"
    )
    sql["join_targets"] = f"""WITH {WITH_TARGETS} SELECT doc_id, words, len({parsed.format(x='words')}) AS n_parsed, n_targets
      FROM (SELECT doc_id, array_to_string(auto, ',') AS words, len(auto) AS n_targets FROM aimed WHERE doc_id < 0)"""
    sql["pdf_signature"] = """SELECT doc_id, path, strlen(body) AS n_bytes FROM (SELECT doc_id,
        'in/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' ELSE '.txt' END AS path,
        CASE WHEN doc_id % 2 = 0 THEN '%PDF-' || text ELSE text END AS body FROM documents)
      WHERE lower(path) LIKE '%.pdf' AND starts_with(body, '%PDF-')"""
    sql["settings_json"] = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '|identity' ELSE '' END AS presets FROM events"""
    sql["audit_json"] = """SELECT event_id, 'DOCUMENT_LOADED' AS action, 'sha256:' || md5(event_id::VARCHAR) AS "fileHash", user_id AS "pageCount", NULL::BIGINT AS "entitiesFound" FROM events
      UNION ALL SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'SCAN_COMPLETED' ELSE 'REDACTION_APPLIED' END, NULL, NULL,
        CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events"""
    sql["audit_redaction"] = f"""WITH {WITH_TARGETS},
      n AS (SELECT doc_id, substr(sha256(text), 1, 16) AS h, list_filter(auto, lambda x: regexp_matches(x, '\\S')) AS t, text FROM aimed),
      k AS (SELECT h, len(t) AS nt, coalesce(list_sum(list_transform(t, lambda x: len(string_split(lower(text), lower({collapse('x')}))) - 1)), 0)::BIGINT AS nr FROM n WHERE len(t) > 0)
      SELECT 'REDACTION_START' AS action, h AS doc_hash, nt AS n_entities, NULL::BIGINT AS n_redactions FROM k
      UNION ALL SELECT 'REDACTION_COMPLETE', h, NULL, nr FROM k"""
    sql["audit_lines"] = """SELECT event_id, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z] ' || CASE WHEN event_id % 2 = 0 THEN 'REDACTION_START' ELSE 'REDACTION_COMPLETE' END
      || ': file_hash=' || substr(sha256(event_type), 1, 16) || coalesce(', ' || CASE WHEN event_id % 2 = 0 THEN 'entities=' ELSE 'redactions=' END
      || CAST(json_extract_string(props, '$.k') AS BIGINT), '') AS line FROM events"""
    sql["doc_hash"] = "SELECT doc_id, substr(sha256(text), 1, 16) AS audit_hash, substr(md5(text), 1, 8) AS name_hash FROM documents"
    sql["text_forms"] = f"""SELECT doc_id, {collapse('text')} AS collapsed, lower({collapse('text')}) AS norm_key, {html('text')} AS html,
      CASE WHEN length(text) > 25 THEN left(text, 25) || '...' ELSE text END AS short_label FROM documents"""
    flag = [r for r in COMMON_RULES if r.rule_id in ("C01", "C09")]
    sql["flagship"] = f"""SELECT source, rule, count(*) AS n_entities, count(DISTINCT doc_id) AS n_docs FROM (
      SELECT DISTINCT ON (doc_id, source, lower({collapse('match')})) doc_id, source, rule, match FROM ({rule_rows('documents', flag, 'doc_id, source')})
      WHERE length({strip('match')}) > 2 ORDER BY doc_id, source, lower({collapse('match')}), rule, pos) GROUP BY source, rule"""
    return sql
