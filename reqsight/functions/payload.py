"""Request arguments, payload text and URL parts (S5, S6, P1-P7) as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from reqsight.fixed import SEP_TOKEN
from reqsight.functions.text import py_strip

ARGS_TYPE = "map<string,string>"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------- S5 / S6
def json_args(body) -> Column:
    """JSON object body -> MAP<STRING,STRING>; insertion order kept, NULL when not an object.

    Values are rendered as Python prints them: booleans ``True``/``False``, null as NULL (P1 prints
    ``None``), strings without quotes, numbers as written; nested values stay JSON text. A repeated key
    keeps its first position and its last value, as a JSON object parsed into a Python dict does.
    """
    raw = F.map_entries(F.from_json(_col(body), "map<string,variant>"))

    def entry(e):
        kind = F.schema_of_variant(e["value"])
        text = F.try_variant_get(e["value"], "$", "string")
        return F.struct(e["key"].alias("key"), F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text).alias("value"))

    entries = F.transform(raw, entry)
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.struct(
        k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))
    return F.map_from_entries(last)


def form_entries(body) -> Column:
    """Form body ``a=1&b=2`` -> ARRAY<STRUCT<key,value>> in order, URL-decoded.

    Empty segments are skipped; a segment without ``=`` has an empty value.
    Malformed escapes stay as text, the valid ones beside them are decoded.
    """
    segs = F.filter(F.split(F.coalesce(_col(body), F.lit("")), "&"), lambda s: s != F.lit(""))

    def entry(s):
        pos = F.locate("=", s)
        k = F.when(pos > 0, s.substr(F.lit(1), pos - 1)).otherwise(s)
        v = F.when(pos > 0, s.substr(pos + 1, F.lit(1 << 30))).otherwise(F.lit(""))
        return F.struct(form_decode(k).alias("key"), form_decode(v).alias("value"))

    return F.transform(segs, entry)


def url_decode(c: Column) -> Column:
    """One URL-decoding pass: ``+`` is a space, every valid escape is decoded, any other ``%`` stays."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def form_decode(c: Column) -> Column:
    """Form field decoding, as a form parser does it."""
    return url_decode(c)


def first_per_key(entries: Column) -> Column:
    """Keep the first entry of every key, in order (form semantics: first value wins)."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)


def form_args(body) -> Column:
    """S5 form branch: first value of a repeated key (a form dict's ``to_dict``)."""
    return F.map_from_entries(first_per_key(form_entries(body)))


def body_args(body, content_type) -> Column:
    """JSON when the content type says so, otherwise a form body."""
    is_json = F.lower(F.coalesce(_col(content_type), F.lit(""))).contains("json")
    return F.when(is_json, json_args(body)).otherwise(form_args(body))


def first_form_values(query, body) -> Column:
    """Merged form of body then query, first value of every key."""
    merged = F.concat(form_entries(body), form_entries(query))
    return F.map_from_entries(first_per_key(merged))


# --------------------------------------------------------------------- P1-P5
def assemble_payload(args, sort_keys: bool = False) -> Column:
    """``k=v`` pairs joined by a space in insertion order (or by key), stripped; NULL values print ``None``."""
    entries = F.map_entries(_col(args))
    if sort_keys:
        entries = F.array_sort(entries)
    pairs = F.transform(entries, lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    return py_strip(F.coalesce(F.array_join(pairs, " "), F.lit("")))


def is_empty_payload(payload) -> Column:
    """P2 predicate: an empty (or NULL) payload is not scored."""
    p = _col(payload)
    return p.isNull() | (p == F.lit(""))


def request_line(method, path, query) -> Column:
    """``METHOD PATH QUERY`` with a missing part rendered as ''."""
    parts = [F.coalesce(_col(c), F.lit("")) for c in (method, path, query)]
    return F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2])


def render_headers(headers) -> Column:
    """``k: v`` lines sorted by key, joined by '; '."""
    entries = F.array_sort(F.map_entries(_col(headers)))
    return F.array_join(F.transform(entries, lambda e: F.concat(
        e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "; ")


def canonical_request(method, path, query, headers, body) -> Column:
    """``METHOD [SEP] PATH [SEP] QUERY [SEP] HEADERS [SEP] BODY``."""
    h = F.coalesce(render_headers(headers), F.lit("")) if headers is not None else F.lit("")
    parts = [F.coalesce(_col(method), F.lit("")), F.coalesce(_col(path), F.lit("")),
             F.coalesce(_col(query), F.lit("")), h,
             F.coalesce(_col(body), F.lit("")) if body is not None else F.lit("")]
    return F.concat_ws(SEP_TOKEN, *parts)


def split_url(url) -> dict[str, Column]:
    """P5: host, path, query (NULL without ``?``) and the query's argument map of a whole URL.

    Works on any text, as ``urlsplit`` does: characters that are not allowed in a URL do no harm.
    """
    u = _col(url)
    q = F.when(u.rlike(r"(?s)^[^#?]*\?"), F.regexp_extract(u, r"(?s)^[^#?]*\?([^#]*)", 1))
    return {
        "host": F.regexp_extract(u, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]*)", 1),
        "path": F.regexp_extract(u, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1),
        "query": q,
        "args": first_form_values(q, F.lit(None).cast("string")),
    }


# --------------------------------------------------------------------- P6 / P7
def url_decode_full(c: Column, plus: bool = True) -> Column:
    """URL-decode until nothing changes, however escapes are nested or mixed (``%2525..``, ``%25%33%63``).
    Without ``plus`` only escapes are decoded, a ``+`` stays.

    A pass collapses escapes encoded again and again (``%25..25XX`` to ``%XX``) and then decodes once. A pass that does
    not lower the number of ``%`` leaves no valid escape behind, so that number and two bound the passes; once a pass
    changes nothing the rest cost nothing.
    """
    def one_pass(x):
        flat = F.regexp_replace(x, "%(25)+([0-9A-Fa-f]{2})", "%$2")
        return url_decode(flat if plus else F.replace(flat, F.lit("+"), F.lit("%2B")))

    def step(acc, _):
        return F.when(acc["done"], acc).otherwise(bound(
            one_pass(acc["text"]), lambda new: F.struct(new.alias("text"), new.eqNullSafe(acc["text"]).alias("done"))))

    marks = F.length(c) - F.length(F.replace(c, F.lit("%"), F.lit("")))
    start = F.struct(c.alias("text"), F.lit(False).alias("done"))
    full = F.aggregate(F.sequence(F.lit(1), marks + 2), start, step)["text"]
    return F.when(c.contains("%"), full).otherwise(F.replace(c, F.lit("+"), F.lit(" ")) if plus else c)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, wherever the expression stands."""
    return F.transform(F.array(value), use)[0]


def normalise_payload(text) -> Column:
    """URL-decode until stable, then lower."""
    return F.lower(url_decode_full(_col(text)))


_B64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)$"
_HEX = r"^0[xX]([0-9a-fA-F]{2})+$"
#: Between the values of a query string, a form, a JSON text or a header line.
_GAPS = r"""[ \t\r\n&;,"'(){}\[\]<>]+"""
#: Stands between views in a joined text; no rule keyword holds it, so nothing matches across views.
VIEW_MARK = "\u0001"


def _text_views(value: Column) -> Column:
    """Base64 and 0x-hex readings of one value that are valid UTF-8 (NULL otherwise).

    Most values are plain words: their length or their start rules them out before a pattern is tried.
    """
    b64 = F.when((F.length(value) % 4 == 0) & value.rlike(_B64), F.try_validate_utf8(F.try_to_binary(value, F.lit("base64")).cast("string")))
    hx = F.when((value.startswith("0x") | value.startswith("0X")) & value.rlike(_HEX), F.try_validate_utf8(
        F.try_to_binary(value.substr(F.lit(3), F.lit(1 << 30)), F.lit("hex")).cast("string")))
    return F.array_compact(F.array(b64, hx))


def _readings(view: Column) -> Column:
    """What one decoding step makes of a view: itself URL-decoded, with ``+`` as a space and as a plus (base64 holds some),
    and each value in it that reads as base64 or hex.

    Decoding that keeps every ``+`` ends without one only if no pass met any: then both ways of decoding are the same.
    """
    tokens = F.split(view, _GAPS)
    named = F.transform(F.filter(tokens, lambda t: t.contains("=")), lambda t: t.substr(F.instr(t, "=") + 1, F.lit(1 << 30)))
    values = F.filter(F.array_distinct(F.concat(tokens, named)), lambda t: F.length(t) >= 4)
    decoded = bound(url_decode_full(view, plus=False), lambda kept: F.when(~kept.contains("+"), F.array(kept))
                    .otherwise(F.array(url_decode_full(view), kept)))
    return F.concat(decoded, F.flatten(F.transform(values, _text_views)))


def decoded_views(text) -> Column:
    """All distinct views of a text: itself and, as long as new ones appear, the URL-decoded form of a view and the
    base64 and 0x-hex readings of its values. Values are what white space, ``&``, ``;``, commas, quotes, brackets and
    angle brackets leave, and what follows a value's first ``=``.

    A base64 or hex reading is at most three quarters as long as its view and a URL-decoded view has no other
    URL-decoded form, so the rounds are bounded by the text's length; rounds without new views cost nothing.
    """
    raw = _col(text)
    rounds = F.ceil(F.log(F.greatest(F.length(raw), F.lit(4))) / math.log(4 / 3)).cast("int") * 2

    def step(acc, _):
        found = F.flatten(F.transform(acc["fresh"], _readings))
        return F.when(F.size(acc["fresh"]) == 0, acc).otherwise(bound(
            F.array_except(found, acc["seen"]), lambda new: F.struct(F.concat(acc["seen"], new).alias("seen"), new.alias("fresh"))))

    start = F.when(raw.isNotNull(), F.array(raw)).otherwise(F.array().cast("array<string>"))
    first = F.struct(start.alias("seen"), start.alias("fresh"))
    return F.aggregate(F.sequence(F.lit(1), F.coalesce(rounds, F.lit(1))), first, step)["seen"]


def joined_views(text) -> Column:
    """The views as one text for keyword tests that must not match across views."""
    return F.array_join(decoded_views(text), VIEW_MARK)
