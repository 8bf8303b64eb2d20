"""Per-row payload mutations (G1-G7) as column projections.

Every random decision is a named word of a named md5 draw keyed by the row
key (see ``draws``), so a mutation is a pure function of (seed, key, text,
class). Each step is its own projection over the previous text's column,
which keeps the expression tree linear instead of exponential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reqsight.fixed import (DEFAULT_SEED, GENERAL_BUCKETS, JUNK_LEN_ATTACK, JUNK_LEN_NORMAL,
                            LFI_TARGET, LFI_TARGET_OPTIONS, NORMAL_REGEN_P, PATH_DEPTH_MAX,
                            PATH_DEPTH_MIN, PATH_STEP, RANDOM_ALPHABET, RANDOM_PARAMS,
                            RANDOM_PATHS, SQL_KEYWORDS, SQL_TAUTOLOGY_PLAIN, SQL_TAUTOLOGY_QUOTED,
                            XSS_ALERT, XSS_ALERT_OPTIONS, XSS_SCRIPT, XSS_SCRIPT_OPTIONS)
from reqsight.functions.draws import choice, draw_hex, random_string, unit, word

# Named draws: each group is one md5, its four words are used as listed.
DRAW_GROUPS = {
    "sq": ["tautology", "char_a", "char_b", "char_c"],
    "k1": ["UNION", "UNION_case", "SELECT", "SELECT_case"],
    "k2": ["DROP", "DROP_case", "INSERT", "INSERT_case"],
    "k3": ["UPDATE", "UPDATE_case", "DELETE", "DELETE_case"],
    "k4": ["AND", "AND_case", "OR", "OR_case"],
    "xs": ["alert", "alert_pick", "script", "script_pick"],
    "pt": ["depth", "target", "-", "-"],
    "ge": ["bucket", "param", "path", "-"],
    "j1": ["junk1", "junk2", "junk3", "junk4"],
    "j2": ["junk5", "junk6", "junk7", "junk8"],
    "rg": ["regen", "path", "param", "-"],
    "r1": ["str1", "str2", "str3", "str4"],
    "r2": ["str5", "str6", "str7", "str8"],
}


def _w(group: str, name: str) -> Column:
    return word(F.col(f"_h_{group}"), DRAW_GROUPS[group].index(name))


def _u(group: str, name: str) -> Column:
    return unit(F.col(f"_h_{group}"), DRAW_GROUPS[group].index(name))


def _chars(groups: list[str], n: int) -> Column:
    words = [word(F.col(f"_h_{g}"), k) for g in groups for k in range(4)][:n]
    return random_string(RANDOM_ALPHABET, words)


def quote_plus(c: Column) -> Column:
    """Python ``urllib.parse.quote_plus`` (safe='') on top of ``url_encode``."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _capitalize(k: str) -> str:
    return k[:1].upper() + k[1:].lower()


ALL_STEPS = ("sqli", "xss", "path", "general", "regen")


def augment_payloads(df: DataFrame, text: str, label: str, key: str, out: str = "text",
                     seed: int = DEFAULT_SEED, steps=ALL_STEPS) -> DataFrame:
    """G7 over a DataFrame: class mutation (G1-G3) -> general mutation (G4) -> regeneration.

    ``label`` holds the class name, ``key`` the unique row key the draws are keyed by.
    ``steps`` selects mutation families (G1 sqli, G2 xss, G3 path, G4 general, G5 regen).
    """
    lab = F.col(label)
    d = df.select("*", *[draw_hex(F.col(key), g, seed).alias(f"_h_{g}") for g in DRAW_GROUPS])
    p = "_p"
    d = d.withColumn(p, F.col(text))

    def step(frame: DataFrame, expr: Column) -> DataFrame:
        return frame.withColumn(p, expr)

    def swap(frame: DataFrame, old: str, new: Column, where: Column) -> DataFrame:
        """Another text for ``old`` in the rows that the draw chose and that hold it; the others are not searched for it again."""
        return step(frame, F.when(where & F.col(p).contains(old), F.replace(F.col(p), F.lit(old), new)).otherwise(F.col(p)))

    if "sqli" in steps:
        d = _sqli(d, lab, swap)
    if "xss" in steps:
        d = _xss(d, lab, swap)
    if "path" in steps:
        d = _path(d, lab, p, step, swap)
    if "general" in steps:
        d = _general(d, lab, p, step)
    if "regen" in steps:
        d = _regen(d, lab, p, step)
    keep = [c for c in df.columns if c != out]
    return d.select(*keep, F.col(p).alias(out))


def _sqli(d, lab, swap):
    # G1 sqli: tautology swap (same char twice for the quoted form, two chars for the plain one)
    is_sqli = lab == F.lit("sqli")
    taut = is_sqli & (_u("sq", "tautology") > 0.5)
    a = _chars_one("sq", "char_a")
    d = swap(d, SQL_TAUTOLOGY_QUOTED, F.concat(a, F.lit("'='"), a), taut)
    d = swap(d, SQL_TAUTOLOGY_PLAIN, F.concat(_chars_one("sq", "char_b"), F.lit("="), _chars_one("sq", "char_c")), taut)
    # G1 sqli: keyword case change, case-sensitive substring replacement, one keyword at a time
    groups = ["k1", "k1", "k2", "k2", "k3", "k3", "k4", "k4"]
    for kw, g in zip(SQL_KEYWORDS, groups):
        new = F.when(_u(g, f"{kw}_case") > 0.5, F.lit(kw.lower())).otherwise(F.lit(_capitalize(kw)))
        d = swap(d, kw, new, is_sqli & (_u(g, kw) > 0.5))
    return d


def _xss(d, lab, swap):
    # G2 xss
    is_xss = lab == F.lit("xss")
    d = swap(d, XSS_ALERT, choice(XSS_ALERT_OPTIONS, _w("xs", "alert_pick")), is_xss & (_u("xs", "alert") > 0.5))
    d = swap(d, XSS_SCRIPT, choice(XSS_SCRIPT_OPTIONS, _w("xs", "script_pick")), is_xss & (_u("xs", "script") > 0.5))
    return d


def _path(d, lab, p, step, swap):
    # G3 lfi / traversal: new depth when all steps are contiguous, then a new target file
    is_path = lab.isin("lfi", "traversal")
    steps = ((F.length(F.col(p)) - F.length(F.replace(F.col(p), F.lit(PATH_STEP)))) / F.lit(len(PATH_STEP))).cast("int")
    d = d.withColumn("_cnt", F.when(is_path & F.col(p).contains(PATH_STEP), steps).otherwise(0))
    depth = (F.lit(PATH_DEPTH_MIN) + _w("pt", "depth") % (PATH_DEPTH_MAX - PATH_DEPTH_MIN + 1)).cast("int")
    d = step(d, F.when(F.col("_cnt") > 0, F.replace(
        F.col(p), F.repeat(F.lit(PATH_STEP), F.col("_cnt")), F.repeat(F.lit(PATH_STEP), depth)))
        .otherwise(F.col(p)))
    return swap(d, LFI_TARGET, choice(LFI_TARGET_OPTIONS, _w("pt", "target")), is_path).drop("_cnt")


def _general(d, lab, p, step):
    # G4 general mutation buckets
    u = _u("ge", "bucket")
    param = choice(RANDOM_PARAMS, _w("ge", "param"))
    path = choice(RANDOM_PATHS, _w("ge", "path"))
    is_normal = lab == F.lit("normal")
    junk = F.when(is_normal, F.concat(F.lit("&"), param, F.lit("="),
                                      _chars(["j1", "j2"], JUNK_LEN_NORMAL))) \
        .otherwise(F.concat(F.lit(" -- "), _chars(["j1"], JUNK_LEN_ATTACK)))
    b1, b2, b3, b4 = GENERAL_BUCKETS
    d = step(d, F.when(u < b1, F.concat(param, F.lit("="), F.col(p)))
             .when(u < b2, F.concat(path, F.lit("?"), param, F.lit("="), F.col(p)))
             .when(u < b3, quote_plus(F.col(p)))
             .when(u < b4, F.concat(F.col(p), junk))
             .otherwise(F.col(p)))
    return d


def _regen(d, lab, p, step):
    is_normal = lab == F.lit("normal")
    # G5 normal rows may be regenerated as a new path?param=random
    regen = F.concat(choice(RANDOM_PATHS, _w("rg", "path")), F.lit("?"),
                     choice(RANDOM_PARAMS, _w("rg", "param")), F.lit("="),
                     _chars(["r1", "r2"], JUNK_LEN_NORMAL))
    return step(d, F.when(is_normal & (_u("rg", "regen") < NORMAL_REGEN_P), regen).otherwise(F.col(p)))


def _chars_one(group: str, name: str) -> Column:
    return random_string(RANDOM_ALPHABET, [_w(group, name)])
