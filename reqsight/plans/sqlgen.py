"""DuckDB SQL fragments for the oracle queries, generated from the same fixed values.

The oracle side is plain SQL over the driver's views; the derived inputs of
FIXTURES.md §3 are written as CTEs here, mirroring ``fixtures``.
"""

from __future__ import annotations

from reqsight.fixed import (CLASSES, CLEAN_ORDER, DEFAULT_SEED, PAYLOAD_RULES, RANDOM_ALPHABET,
                            TITLE_RULES)
from reqsight.plans.fixtures import (BASE64_SLOT, ENCODED_PREFIX, HEX_SLOT, MARKS_SLOT, N_CASES,
                                     N_TEMPLATES, RULE_NAMES, SUITE_CASES, TEMPLATES, TEXT_SLOT)


def sq(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def draw_hex(key: str, name: str, seed: int = DEFAULT_SEED) -> str:
    return f"md5('{seed}:' || cast({key} as varchar) || ':{name}')"


def word(hex_sql: str, k: int = 0) -> str:
    return f"cast(('0x' || substr({hex_sql}, {1 + 8 * k}, 8)) as bigint)"


def unit(hex_sql: str, k: int = 0) -> str:
    return f"({word(hex_sql, k)} / 4294967296.0::DOUBLE)"


def draw(key: str, name: str, seed: int = DEFAULT_SEED) -> str:
    return word(draw_hex(key, name, seed), 0)


def wide_draw(key: str, name: str, seed: int = DEFAULT_SEED) -> str:
    """60 bits of the draw hash: for picks among any number of rows."""
    return f"cast(('0x' || substr({draw_hex(key, name, seed)}, 1, 15)) as bigint)"


def choice(options: list[str], w: str) -> str:
    arr = "[" + ", ".join(sq(o) for o in options) + "]"
    return f"{arr}[({w} % {len(options)}) + 1]"


def random_chars(words: list[str]) -> str:
    n = len(RANDOM_ALPHABET)
    return " || ".join(f"substr({sq(RANDOM_ALPHABET)}, cast(({w} % {n}) + 1 as integer), 1)" for w in words)


def first_match(lowered: str, rules, default: str) -> str:
    whens = []
    for cls, kws in rules:
        cond = " OR ".join(f"contains({lowered}, {sq(k)})" for k in kws)
        whens.append(f"WHEN {cond} THEN {sq(cls)}")
    return "CASE " + " ".join(whens) + f" ELSE {default} END"


def title_class(title: str) -> str:
    return first_match(f"lower({title})", TITLE_RULES, "NULL")


def payload_class(payload: str, default: str = "'other'") -> str:
    return first_match(f"lower({payload})", PAYLOAD_RULES, default)


def categorize(title: str, payload: str) -> str:
    return f"coalesce({title_class(title)}, {payload_class(payload)})"


def rule_scorer(payload: str) -> str:
    return f"coalesce({payload_class(payload, 'NULL')}, 'normal')"


def classes_list() -> str:
    return "[" + ", ".join(sq(c) for c in CLASSES) + "]"


def label_id(name: str) -> str:
    return f"(CASE WHEN list_position({classes_list()}, {name}) > 0 THEN list_position({classes_list()}, {name}) - 1 END)"


def label_name(idx: str) -> str:
    return f"(CASE WHEN {idx} BETWEEN 0 AND {len(CLASSES) - 1} THEN {classes_list()}[{idx} + 1] END)"


def clean_label(raw: str, strict: bool = False) -> str:
    cleaned = f"lower(trim({raw}, '[]\"'' '))"
    parts = [f"WHEN {raw} IS NULL THEN 'normal'"]
    if strict:
        parts.append(f"WHEN {cleaned} = 'normal' THEN 'normal'")
    parts += [f"WHEN contains({cleaned}, {sq(c)}) THEN {sq(c)}" for c in CLEAN_ORDER]
    parts.append(f"WHEN {raw} <> '' THEN 'other'")
    return "CASE " + " ".join(parts) + " ELSE 'normal' END"


WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def templates_cte() -> str:
    vals = ",\n    ".join(f"({i}, {sq(s)}, {sq(t)}, {sq(p)}, {'TRUE' if a else 'FALSE'})"
                          for i, (s, t, p, a) in enumerate(TEMPLATES))
    return f"tpl(tid, src, title, tpl_payload, is_attack) AS (VALUES\n    {vals})"


def fill(tpl: str, text: str) -> str:
    """A template payload with a text in its slot."""
    coded = f"encode({sq(ENCODED_PREFIX)} || {text})"
    return (f"CASE WHEN contains({tpl}, {sq(MARKS_SLOT)}) THEN regexp_replace({text}, '[^%]', '', 'g') "
            f"WHEN contains({tpl}, {sq(BASE64_SLOT)}) THEN replace({tpl}, {sq(BASE64_SLOT)}, to_base64({coded})) "
            f"WHEN contains({tpl}, {sq(HEX_SLOT)}) THEN replace({tpl}, {sq(HEX_SLOT)}, lower(hex({coded}))) "
            f"ELSE replace({tpl}, {sq(TEXT_SLOT)}, {text}) END")


def t_cte(templates: bool = True) -> str:
    """``tpl`` (unless it is there already) and ``t`` (FIXTURES T)."""
    text = "replace(coalesce(d.text, ''), chr(10), ' ')"
    return ((templates_cte() + ",\n" if templates else "") +
            f"t AS (SELECT d.doc_id AS id, p.tid, p.src, CASE WHEN p.title = '' THEN '' ELSE concat_ws(' ', p.title, d.source) END AS title, "
            f"{fill('p.tpl_payload', text)} AS payload, "
            f"p.is_attack FROM documents d JOIN tpl p ON p.tid = {draw('d.doc_id', 't')} % {N_TEMPLATES})")


def labelled_cte() -> str:
    """``t`` plus ``lab``: T with ``text, label_str, label``."""
    lab = f"CASE WHEN is_attack THEN {categorize('title', 'payload')} ELSE 'normal' END"
    return (t_cte() + ",\n"
            f"lab0 AS (SELECT *, payload AS text, {lab} AS label_str FROM t),\n"
            f"lab AS (SELECT *, {label_id('label_str')} AS label FROM lab0)")


def url_parts(url: str) -> dict[str, str]:
    return {
        "host": f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)",
        "path": f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)",
        "query": f"CASE WHEN contains({url}, '?') THEN regexp_extract({url}, '\\?([^#]*)', 1) END",
    }


def r_cte() -> str:
    parts = url_parts("url")
    rules = "[" + ", ".join(sq(r) for r in RULE_NAMES) + "]"
    return (f"r AS (SELECT page_id, 'GET' AS http_method, {parts['host']} AS host, "
            f"{parts['path']} AS http_path, {parts['query']} AS http_query, "
            f"{rules}[(page_id % {len(RULE_NAMES)}) + 1] AS rule_names FROM pages)")


def fold_logits(place: str) -> str:
    """8 logits; ``place`` is SQL over ``i_``, the 1-based position."""
    one = lambda k: (f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_filter(range(1, len(embedding) + 1), lambda i_: {place} = {k}), "  # noqa: E731
                     f"lambda j_: cast(embedding[j_] as double))), lambda a_, b_: a_ + b_)")
    return "[" + ", ".join(one(k) for k in range(8)) + "]"


def g_cte() -> str:
    return (f"g0 AS (SELECT vec_id, {fold_logits('(i_ - 1) % 8')} AS logits, "
            "cast(label % 8 as integer) AS label FROM embeddings),\n"
            "g AS (SELECT *, cast(list_position(logits, list_max(logits)) - 1 as integer) AS pred FROM g0)")


def softmax(z: str) -> str:
    return (f"list_transform({z}, lambda x: exp(x - list_max({z})) / "
            f"list_sum(list_transform({z}, lambda y: exp(y - list_max({z})))))")


def log_sum_exp(z: str) -> str:
    return f"(list_max({z}) + ln(list_sum(list_transform({z}, lambda y: exp(y - list_max({z}))))))"


def v_cte() -> str:
    props = "cast(json(e.props) as map(varchar, varchar))"
    args = (f"CASE WHEN contains(p.tpl_payload, {sq(MARKS_SLOT)}) THEN map([]::varchar[], []::varchar[]) ELSE "
            f"map_concat({props}, map(['p'], [{fill('p.tpl_payload', sq(''))}])) END")
    return (templates_cte() + ",\n"
            f"v0 AS (SELECT e.event_id, cast(e.ts as timestamp) AS ts, e.user_id, {args} AS args "
            f"FROM events e JOIN tpl p ON p.tid = {draw('e.event_id', 't')} % {N_TEMPLATES}),\n"
            f"v AS (SELECT *, {assemble('args')} AS payload FROM v0)")


def assemble(args: str) -> str:
    pairs = f"list_transform(map_entries({args}), lambda kv_: kv_.key || '=' || coalesce(kv_.value, 'None'))"
    return py_strip(f"coalesce(array_to_string({pairs}, ' '), '')")


def url_decode(x: str) -> str:
    """DuckDB's own decoder leaves malformed escapes as they are."""
    return f"url_decode(replace({x}, '+', ' '))"


def url_decode_full(x: str, plus: bool = True) -> str:
    """Ten plain decoding passes: more than any escape of the tables is nested."""
    return f"list_reduce(list_concat([{x}], cast(range(10) as varchar[])), lambda a_, i_: {url_decode('a_') if plus else 'url_decode(a_)'})"


def form_entries(body: str) -> str:
    """``a=1&b=2`` -> list of {key, value}, URL-decoded, empty segments skipped."""
    segs = f"list_filter(string_split(coalesce({body}, ''), '&'), lambda s: s <> '')"
    key = "(CASE WHEN strpos(s, '=') > 0 THEN substr(s, 1, strpos(s, '=') - 1) ELSE s END)"
    val = "(CASE WHEN strpos(s, '=') > 0 THEN substr(s, strpos(s, '=') + 1) ELSE '' END)"
    return (f"list_transform({segs}, lambda s: {{'key': {form_decode(key)}, "
            f"'value': {form_decode(val)}}})")


def form_decode(x: str) -> str:
    return url_decode(x)


def first_per_key_render(entries: str) -> str:
    """First entry per key, rendered as P1 would render the resulting map."""
    kept = (f"list_filter({entries}, lambda kv_, i_: list_position(list_transform({entries}, lambda x_: x_.key), kv_.key) = i_)")
    pairs = f"list_transform({kept}, lambda kv_: kv_.key || '=' || coalesce(kv_.value, 'None'))"
    return py_strip(f"coalesce(array_to_string({pairs}, ' '), '')")


def suite_cte() -> str:
    rows = []
    for i, (name, args, exp) in enumerate(SUITE_CASES):
        keys = "[" + ", ".join(sq(k) for k, _ in args) + "]"
        vals = "[" + ", ".join(sq(v) for _, v in args) + "]"
        rows.append(f"({i}, {sq(name)}, map({keys}, {vals}), {sq(exp)})")
    vals = ",\n    ".join(rows)
    return (f"cases(cid, name, args, expected_class) AS (VALUES\n    {vals}),\n"
            f"c AS (SELECT e.event_id, k.cid, k.name, map_concat(cast(json(e.props) as map(varchar, varchar)), k.args) AS args, k.expected_class FROM events e "
            f"JOIN cases k ON k.cid = {draw('e.event_id', 'c')} % {N_CASES})")


B64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)$"
HEX = r"^0[xX]([0-9a-fA-F]{2})+$"


def closure_cte(name: str, src: str, key: str, text: str) -> str:
    """Recursive CTE ``name`` (key, view): every view of ``src.text``; the statement must start WITH RECURSIVE."""
    b64 = f"CASE WHEN regexp_matches(u_, '{B64}') THEN TRY(decode(from_base64(u_))) END"
    hx = f"CASE WHEN regexp_matches(u_, '{HEX}') THEN TRY(decode(unhex(substr(u_, 3)))) END"
    gaps = r"""[ \t\r\n&;,"''(){}\[\]<>]+"""
    return (f"{name}(id_, view) AS (SELECT {key}, {text} FROM {src} WHERE {text} IS NOT NULL UNION\n"
            f"  SELECT id_, new_ FROM (SELECT id_, unnest([view_u, view_p] || flatten(list_transform(list_distinct(tok || list_transform(list_filter(tok, lambda t_: contains(t_, '=')), "
            f"lambda t_: substr(t_, strpos(t_, '=') + 1))), lambda u_: [{b64}, {hx}]))) AS new_\n"
            f"    FROM (SELECT id_, {url_decode_full('view')} AS view_u, {url_decode_full('view', False)} AS view_p, regexp_split_to_array(view, '{gaps}') AS tok FROM {name})) WHERE new_ IS NOT NULL)")


def closure_scored(name: str, src: str, key: str, text: str) -> str:
    """CTEs ending in ``name``: ``src`` with ``type``, each view classified on its own; the first class in rule order wins."""
    order = "[" + ", ".join(sq(c) for c, _ in PAYLOAD_RULES) + "]"
    return (closure_cte(f"{name}_views", src, key, text) + ",\n"
            f"{name}_rank AS (SELECT id_, min(list_position({order}, {payload_class('view', 'NULL')})) AS r_ FROM {name}_views GROUP BY 1),\n"
            f"{name} AS MATERIALIZED (SELECT s_.*, coalesce({order}[r_], 'normal') AS type FROM {src} s_ LEFT JOIN {name}_rank ON id_ = s_.{key})")


def dedupe(col: str) -> str:
    """First occurrences of a list column, in order."""
    return f"list_filter({col}, lambda v, i: list_position({col}, v) = i)"


# ----------------------------------------------------------------- augmentation
def augment_ctes(src: str, key: str, text: str, label: str, prefix: str = "au",
                 steps=("sqli", "xss", "path", "general", "regen")) -> tuple[str, str]:
    """CTEs mutating ``text`` of relation ``src``; returns (ctes, last relation name).

    The last relation has every column of ``src`` plus ``p`` (the mutated text).
    """
    from reqsight.fixed import (GENERAL_BUCKETS, JUNK_LEN_ATTACK, JUNK_LEN_NORMAL, LFI_TARGET,
                                LFI_TARGET_OPTIONS, NORMAL_REGEN_P, PATH_DEPTH_MAX, PATH_DEPTH_MIN,
                                PATH_STEP, RANDOM_PARAMS, RANDOM_PATHS, SQL_KEYWORDS,
                                SQL_TAUTOLOGY_PLAIN, SQL_TAUTOLOGY_QUOTED, XSS_ALERT,
                                XSS_ALERT_OPTIONS, XSS_SCRIPT, XSS_SCRIPT_OPTIONS)
    from reqsight.functions.augment import DRAW_GROUPS

    def w(g, name):
        return word(f"h_{g}", DRAW_GROUPS[g].index(name))

    def u(g, name):
        return unit(f"h_{g}", DRAW_GROUPS[g].index(name))

    def chars(groups, n):
        ws = [word(f"h_{g}", k) for g in groups for k in range(4)][:n]
        return "(" + random_chars(ws) + ")"

    hashes = ", ".join(f"{draw_hex(key, g)} AS h_{g}" for g in DRAW_GROUPS)
    ctes = [f"{prefix}0 AS (SELECT *, {hashes}, {text} AS p FROM {src})"]
    exprs = []
    lab = label
    if "sqli" in steps:
        sqli = f"({lab} = 'sqli')"
        taut = f"({sqli} AND {u('sq', 'tautology')} > 0.5)"
        a = "(" + random_chars([w("sq", "char_a")]) + ")"
        b = "(" + random_chars([w("sq", "char_b")]) + ")"
        c = "(" + random_chars([w("sq", "char_c")]) + ")"
        exprs.append(f"replace(p, {sq(SQL_TAUTOLOGY_QUOTED)}, CASE WHEN {taut} THEN {a} || '''=''' || {a} "
                     f"ELSE {sq(SQL_TAUTOLOGY_QUOTED)} END)")
        exprs.append(f"replace(p, {sq(SQL_TAUTOLOGY_PLAIN)}, CASE WHEN {taut} THEN {b} || '=' || {c} "
                     f"ELSE {sq(SQL_TAUTOLOGY_PLAIN)} END)")
        groups = ["k1", "k1", "k2", "k2", "k3", "k3", "k4", "k4"]
        for kw, g in zip(SQL_KEYWORDS, groups):
            cap = kw[:1].upper() + kw[1:].lower()
            exprs.append(f"replace(p, {sq(kw)}, CASE WHEN {sqli} AND {u(g, kw)} > 0.5 THEN "
                         f"(CASE WHEN {u(g, kw + '_case')} > 0.5 THEN {sq(kw.lower())} ELSE {sq(cap)} END) "
                         f"ELSE {sq(kw)} END)")
    if "xss" in steps:
        xss = f"({lab} = 'xss')"
        exprs.append(f"replace(p, {sq(XSS_ALERT)}, CASE WHEN {xss} AND {u('xs', 'alert')} > 0.5 THEN "
                     f"{choice(XSS_ALERT_OPTIONS, w('xs', 'alert_pick'))} ELSE {sq(XSS_ALERT)} END)")
        exprs.append(f"replace(p, {sq(XSS_SCRIPT)}, CASE WHEN {xss} AND {u('xs', 'script')} > 0.5 THEN "
                     f"{choice(XSS_SCRIPT_OPTIONS, w('xs', 'script_pick'))} ELSE {sq(XSS_SCRIPT)} END)")
    if "path" in steps:
        isp = f"({lab} IN ('lfi', 'traversal'))"
        cnt = f"cast((length(p) - length(replace(p, {sq(PATH_STEP)}, ''))) // {len(PATH_STEP)} as integer)"
        depth = f"cast({PATH_DEPTH_MIN} + {w('pt', 'depth')} % {PATH_DEPTH_MAX - PATH_DEPTH_MIN + 1} as integer)"
        exprs.append(f"CASE WHEN {isp} AND {cnt} > 0 THEN replace(p, repeat({sq(PATH_STEP)}, {cnt}), "
                     f"repeat({sq(PATH_STEP)}, {depth})) ELSE p END")
        exprs.append(f"replace(p, {sq(LFI_TARGET)}, CASE WHEN {isp} THEN "
                     f"{choice(LFI_TARGET_OPTIONS, w('pt', 'target'))} ELSE {sq(LFI_TARGET)} END)")
    if "general" in steps:
        ub = u("ge", "bucket")
        param = choice(RANDOM_PARAMS, w("ge", "param"))
        path = choice(RANDOM_PATHS, w("ge", "path"))
        junk = (f"(CASE WHEN {lab} = 'normal' THEN '&' || {param} || '=' || {chars(['j1', 'j2'], JUNK_LEN_NORMAL)} "
                f"ELSE ' -- ' || {chars(['j1'], JUNK_LEN_ATTACK)} END)")
        b1, b2, b3, b4 = GENERAL_BUCKETS
        exprs.append(f"CASE WHEN {ub} < {b1} THEN {param} || '=' || p "
                     f"WHEN {ub} < {b2} THEN {path} || '?' || {param} || '=' || p "
                     f"WHEN {ub} < {b3} THEN replace(url_encode(p), '%20', '+') "
                     f"WHEN {ub} < {b4} THEN p || {junk} ELSE p END")
    if "regen" in steps:
        regen = (f"{choice(RANDOM_PATHS, w('rg', 'path'))} || '?' || {choice(RANDOM_PARAMS, w('rg', 'param'))} "
                 f"|| '=' || {chars(['r1', 'r2'], JUNK_LEN_NORMAL)}")
        exprs.append(f"CASE WHEN {lab} = 'normal' AND {u('rg', 'regen')} < {NORMAL_REGEN_P} THEN {regen} ELSE p END")
    for i, e in enumerate(exprs, start=1):
        ctes.append(f"{prefix}{i} AS (SELECT * REPLACE ({e} AS p) FROM {prefix}{i - 1})")
    return ",\n".join(ctes), f"{prefix}{len(exprs)}"
