"""Registered queries: one per operator of SURVEY §2, each with its DuckDB oracle.

Every query reads the driver tables (or data Spark derives from them) whole.
Conventions shared with the oracles: integer outputs are BIGINT, doubles are
rounded to 6 places, arrays are rendered as space-joined text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reqsight.fixed import NUM_CLASSES, RANDOM_PARAMS, RANDOM_PATHS
from reqsight.functions import decide as D, payload as P, rules as L
from reqsight.functions.encode import DEMO_CHAR_VOCAB, encode_chars, encode_cls_chars
from reqsight.operators import evaluate as A, sampling as M
from reqsight.operators.labelling import augment_dataset, hybrid_dataset, label_lines
from reqsight.plans import fixtures as X
from reqsight.plans import sqlgen as S
from reqsight.session import reliable_checkpoint, remove_path
from reqsight.sources.readers import drop_null_samples, parse_lines, text_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c.cast("double"), 6)


def big(c):
    return c.cast("bigint")


def joined(arr):
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), " ")


def labelled(spark, sf) -> DataFrame:
    return label_lines(X.labelled_lines(spark, sf))


def rule_scored(spark, sf) -> DataFrame:
    """T scored by the payload-rule scorer over the decoded views of the payload."""
    t = X.labelled_lines(spark, sf)
    return t.withColumn("type", P.bound(P.joined_views("payload"), L.rule_scorer))


SCORED_SQL = S.closure_scored("scored", "t", "id", "payload")

# ============================================================== 2.3 rules


@register("l1_class_from_title", f"""WITH {S.t_cte()}
SELECT id, title, {S.title_class('title')} AS title_class FROM t""")
def q_l1(spark, sf):
    t = X.labelled_lines(spark, sf)
    return t.select("id", "title", L.class_from_title("title").alias("title_class"))


@register("l2_class_from_payload", f"""WITH {S.t_cte()}
SELECT id, {S.payload_class('payload')} AS payload_class FROM t""")
def q_l2(spark, sf):
    t = X.labelled_lines(spark, sf)
    return t.select("id", L.class_from_payload("payload").alias("payload_class"))


@register("l2_class_from_payload_documents",
          f"SELECT doc_id, {S.payload_class('text')} AS payload_class FROM documents")
def q_l2_docs(spark, sf):
    d = X.read_table(spark, sf, "documents")
    return d.select("doc_id", L.class_from_payload("text").alias("payload_class"))


@register("l2_class_from_payload_pages",
          f"SELECT page_id, {S.payload_class('html')} AS html_class, {S.payload_class('url')} AS url_class FROM pages")
def q_l2_pages(spark, sf):
    d = X.read_table(spark, sf, "pages")
    return d.select("page_id", L.class_from_payload("html").alias("html_class"),
                    L.class_from_payload("url").alias("url_class"))


@register("l3_categorize", f"""WITH {S.t_cte()}
SELECT id, {S.categorize('title', 'payload')} AS category FROM t""")
def q_l3(spark, sf):
    t = X.labelled_lines(spark, sf)
    return t.select("id", L.categorize("title", "payload").alias("category"))


@register("l4_label_lines", f"""WITH {S.labelled_cte()}
SELECT id, text, label_str, cast(label as bigint) AS label FROM lab""")
def q_l4(spark, sf):
    return labelled(spark, sf).select("id", "text", "label_str", big(F.col("label")).alias("label"))


@register("l5_clean_label", f"""WITH {S.t_cte()}
SELECT id, {S.clean_label('title')} AS cleaned, {S.clean_label('title', strict=True)} AS cleaned_strict,
       {S.clean_label("nullif(title, '')")} AS cleaned_null FROM t""")
def q_l5(spark, sf):
    t = X.labelled_lines(spark, sf)
    return t.select("id", L.clean_label("title").alias("cleaned"),
                    L.clean_label("title", strict=True).alias("cleaned_strict"),
                    L.clean_label(F.nullif(F.col("title"), F.lit(""))).alias("cleaned_null"))


@register("l6_label_id_name", f"""WITH {S.labelled_cte()}
SELECT id, cast(label as bigint) AS label_id, {S.label_name('label')} AS label_name,
       {S.label_name('cast(id % 10 as integer)')} AS name_of_id_mod_10 FROM lab""")
def q_l6(spark, sf):
    d = labelled(spark, sf)
    return d.select("id", big(F.col("label")).alias("label_id"), L.label_name("label").alias("label_name"),
                    L.label_name((F.col("id") % 10).cast("int")).alias("name_of_id_mod_10"))


# ============================================================== sources / set ops / distribution


@register("s1_parse_lines", f"""WITH lines AS (
  SELECT doc_id AS src, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT src, line_no, {S.py_strip('line')} AS s FROM lines WHERE line_no >= 2),
p AS (SELECT src, cast(line_no as bigint) AS line_no,
       CASE WHEN strpos(s, ': ') > 0 THEN substr(s, 1, strpos(s, ': ') - 1) ELSE '' END AS title,
       CASE WHEN strpos(s, ': ') > 0 THEN substr(s, strpos(s, ': ') + 2) ELSE s END AS payload
FROM s WHERE s <> '')
SELECT src, line_no, md5(concat_ws(chr(31), cast(src as varchar), title, payload)) AS row_key, title, payload FROM p""")
def q_s1(spark, sf):
    d = X.read_table(spark, sf, "documents")
    return parse_lines(text_lines(d, "doc_id", "text"), "src", "line_no", "line")


@register("s3_drop_null_samples", f"""WITH {S.labelled_cte()}
SELECT id, text, cast(label as bigint) AS label FROM
  (SELECT id, nullif(text, '') AS text, label FROM lab) WHERE text IS NOT NULL AND label IS NOT NULL""")
def q_s3(spark, sf):
    d = labelled(spark, sf).select("id", F.nullif(F.col("text"), F.lit("")).alias("text"),
                                   big(F.col("label")).alias("label"))
    return drop_null_samples(d)


@register("u1_hybrid_dataset", f"""WITH {S.labelled_cte()}
SELECT id, src, text, label_str FROM lab WHERE NOT is_attack
UNION ALL SELECT id, src, text, label_str FROM lab WHERE is_attack""")
def q_u1(spark, sf):
    t = X.labelled_lines(spark, sf)
    normal = label_lines(t.filter(~F.col("is_attack")), is_attack=False)
    attack = label_lines(t.filter(F.col("is_attack")), is_attack=True)
    return hybrid_dataset(normal, attack).select("id", "src", "text", "label_str")


@register("a1_class_distribution", f"""WITH {S.labelled_cte()}
SELECT label_str, count(*) AS n FROM lab GROUP BY label_str""")
def q_a1(spark, sf):
    return A.class_distribution(labelled(spark, sf), "label_str")


# ============================================================== 2.2 payloads


@register("p1_assemble_payload", f"""WITH {S.v_cte()}
SELECT event_id, {S.assemble('args')} AS payload FROM v""")
def q_p1(spark, sf):
    v = X.request_events(spark, sf)
    return v.select("event_id", P.assemble_payload("args").alias("payload"))


@register("p2_split_empty_payloads", f"""WITH {S.t_cte()}
SELECT id, CASE WHEN payload IS NULL OR payload = '' THEN 'ERROR' ELSE 'SCORE' END AS route FROM t""")
def q_p2(spark, sf):
    from reqsight.operators.labelling import split_empty_payloads
    to_score, errors = split_empty_payloads(X.labelled_lines(spark, sf))
    return to_score.select("id", F.lit("SCORE").alias("route")).unionByName(
        errors.select("id", F.col("status").alias("route")))


@register("p3_request_line", f"""WITH {S.r_cte()}
SELECT page_id, coalesce(http_method, '') || ' ' || coalesce(http_path, '') || ' ' || coalesce(http_query, '') AS request_line FROM r""")
def q_p3(spark, sf):
    r = X.requests(spark, sf)
    return r.select("page_id", P.request_line("http_method", "http_path", "http_query").alias("request_line"))


@register("p4_canonical_request", f"""WITH {S.r_cte()}
SELECT page_id, concat_ws(' [SEP] ', coalesce(http_method, ''), coalesce(http_path, ''), coalesce(http_query, ''),
       'accept: */*; host: ' || coalesce(host, ''), '') AS canonical FROM r""")
def q_p4(spark, sf):
    r = X.requests(spark, sf)
    headers = F.create_map(F.lit("host"), F.coalesce("host", F.lit("")), F.lit("accept"), F.lit("*/*"))
    return r.select("page_id", P.canonical_request("http_method", "http_path", "http_query", headers,
                                                   F.lit("")).alias("canonical"))


@register("p5_split_url", f"""WITH {S.r_cte()}
SELECT page_id, host, http_path AS path, http_query AS query,
       {S.first_per_key_render(S.form_entries('http_query'))} AS args_payload FROM r""")
def q_p5(spark, sf):
    pages = X.read_table(spark, sf, "pages")
    parts = P.split_url(F.col("url"))
    return pages.select("page_id", parts["host"].alias("host"), parts["path"].alias("path"),
                        parts["query"].alias("query"), P.assemble_payload(parts["args"]).alias("args_payload"))


@register("p6_normalise_payload", f"""WITH {S.t_cte()}
SELECT id, lower({S.url_decode_full('payload')}) AS normalised FROM t""")
def q_p6(spark, sf):
    t = X.labelled_lines(spark, sf)
    return t.select("id", P.normalise_payload("payload").alias("normalised"))


NESTED = ["%3Cscript%3E", "%253Cscript%253E", "%25%33Cscript%25%33E", "%2525253Cscript%2525253E", "%25%32%35%33Cscript%3E",
          "%25%2532%2535%2533%2543script%253E"]


@register("p6_nested_escapes", f"""SELECT doc_id, doc_id % 6 AS form, md5(lower('<script>' || {S.url_decode_full("coalesce(text, '')")})) AS normalised_md5 FROM documents""")
def q_p6_nested(spark, sf):
    """P6 on every text behind an element encoded in six ways, at up to four and mixed levels; the expectation is the plain text."""
    d = X.read_table(spark, sf, "documents")
    form = F.get(F.array(*[F.lit(n) for n in NESTED]), (F.col("doc_id") % 6).cast("int"))
    text = F.concat(form, F.url_encode(F.coalesce("text", F.lit(""))))
    return d.select("doc_id", big(F.col("doc_id") % 6).alias("form"), F.md5(P.normalise_payload(text)).alias("normalised_md5"))


@register("p7_layered_values", f"""WITH d AS (SELECT doc_id, '<script>' || coalesce(text, '') AS inner_, doc_id % 5 AS form FROM documents)
SELECT doc_id, form, md5(CASE WHEN form >= 3 THEN {S.url_decode_full("inner_")} ELSE inner_ END) AS inner_md5, 'xss' AS type FROM d""")
def q_p7_layered(spark, sf):
    """P7 on every text in base64 inside a query string, JSON or hex, and under percent escapes below and above the base64."""
    d = X.read_table(spark, sf, "documents")
    inner = F.concat(F.lit("<script>"), F.coalesce("text", F.lit("")))
    b64 = lambda c: F.regexp_replace(F.base64(c.cast("binary")), "[\r\n]", "")
    form = F.col("doc_id") % 5
    layered = (F.when(form == 0, F.concat(F.lit("x="), b64(inner), F.lit("&y=2"))).when(form == 1, F.concat(F.lit('{"a":"'), b64(inner), F.lit('"}')))
               .when(form == 2, F.concat(F.lit("z=0x"), F.hex(inner.cast("binary")), F.lit(";w=1"))).when(form == 3, F.concat(F.lit("q="), b64(F.url_encode(inner))))
               .otherwise(F.concat(F.lit("q="), F.url_encode(b64(b64(F.url_encode(inner)))))))
    v = d.select("doc_id", big(form).alias("form"), P.decoded_views(layered).alias("v"))
    found = F.filter("v", lambda x: x.startswith("<script>"))
    return v.select("doc_id", "form", F.md5(F.get(found, F.lit(0))).alias("inner_md5"),
                    P.bound(F.array_join("v", P.VIEW_MARK), L.rule_scorer).alias("type"))


@register("p7_decoded_views", f"""WITH RECURSIVE {S.t_cte()},
{S.closure_cte("vw", "t", "id", "payload")},
v1 AS (SELECT id_ AS id, list_sort(list(view)) AS views FROM vw GROUP BY 1)
SELECT id, cast(len(views) as bigint) AS n_views, md5(array_to_string(views, chr(1))) AS views_md5 FROM v1""")
def q_p7(spark, sf):
    t = X.labelled_lines(spark, sf)
    v = P.decoded_views("payload")
    return t.select("id", big(F.size(v)).alias("n_views"), F.md5(F.array_join(F.array_sort(v), P.VIEW_MARK)).alias("views_md5"))


@register("s5_request_bodies_json", f"""SELECT event_id, {S.assemble('cast(json(props) as map(varchar, varchar))')} AS payload
FROM events""")
def q_s5_json(spark, sf):
    ev = X.read_table(spark, sf, "events")
    return ev.select("event_id", P.assemble_payload(P.body_args(F.col("props"), F.lit("application/json")))
                     .alias("payload"))


@register("s5_request_bodies_form", f"""WITH {S.r_cte()}
SELECT page_id, {S.first_per_key_render(S.form_entries("coalesce(http_query, '') || '&page=' || cast(page_id as varchar)"))} AS payload FROM r""")
def q_s5_form(spark, sf):
    r = X.requests(spark, sf)
    body = F.concat(F.coalesce("http_query", F.lit("")), F.lit("&page="), F.col("page_id").cast("string"))
    return r.select("page_id", P.assemble_payload(P.body_args(body, F.lit("application/x-www-form-urlencoded")))
                    .alias("payload"))


@register("s5_request_bodies_typed", """SELECT event_id, 'ok=' || (CASE WHEN value > 50 THEN 'True' ELSE 'False' END) || ' s=true n=None kind=' || event_type
  || ' kind2=' || event_type AS payload FROM events""")
def q_s5_typed(spark, sf):
    """S5 JSON: booleans, the same word as a string, null, a repeated key; the expectation is written by hand."""
    ev = X.read_table(spark, sf, "events")
    body = F.concat(F.lit('{"ok": '), (F.col("value") > 50).cast("string"), F.lit(', "s": "true", "n": null, "kind": "old", "kind2": "'),
                    F.col("event_type"), F.lit('", "kind": "'), F.col("event_type"), F.lit('"}'))
    return ev.select("event_id", P.assemble_payload(P.body_args(body, F.lit("application/json"))).alias("payload"))


@register("s5_malformed_escapes", """SELECT page_id, 'a=%zz<' || url || ' b=100% c=%4 d=x y' AS payload FROM pages""")
def q_s5_malformed(spark, sf):
    """S5 form: malformed escapes stay, the valid ones beside them are decoded; the expectation is written by hand."""
    url = F.replace(F.replace(F.replace(F.replace(F.col("url"), F.lit("%"), F.lit("%25")), F.lit("&"), F.lit("%26")), F.lit("+"), F.lit("%2B")), F.lit("="), F.lit("%3D"))
    body = F.concat(F.lit("a=%zz%3C"), url, F.lit("&b=100%&c=%4&d=x+y"))
    return X.read_table(spark, sf, "pages").select("page_id", P.assemble_payload(P.form_args(body)).alias("payload"))


@register("p5_split_attack_url", """SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, '/a b/<x>' AS path,
  'q=<script>|' || page_id || chr(39) || ' or ' || chr(39) || '1' AS query FROM pages""")
def q_p5_attack(spark, sf):
    """P5 on URLs with characters that a strict parser refuses; the expectation is written by hand."""
    pages = X.read_table(spark, sf, "pages")
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    url = F.concat(F.lit("https://"), host, F.lit("/a b/<x>?q=<script>|"), F.col("page_id").cast("string"), F.lit("' or '1#top?x=1"))
    parts = P.split_url(url)
    return pages.select("page_id", parts["host"].alias("host"), parts["path"].alias("path"), parts["query"].alias("query"))


@register("s6_first_form_values", f"""WITH {S.r_cte()}
SELECT page_id, {S.first_per_key_render("list_concat(" + S.form_entries("'page=' || cast(page_id % 3 as varchar) || '&src=body'") + ", " + S.form_entries('http_query') + ")")} AS payload FROM r""")
def q_s6(spark, sf):
    r = X.requests(spark, sf)
    body = F.concat(F.lit("page="), (F.col("page_id") % 3).cast("string"), F.lit("&src=body"))
    return r.select("page_id", P.assemble_payload(P.first_form_values("http_query", body)).alias("payload"))


# ============================================================== 2.10 decisions over G


@register("d1_softmax", f"""WITH {S.g_cte()}, sm AS (SELECT vec_id, {S.softmax('logits')} AS p FROM g)
SELECT vec_id, {", ".join(f"round(p[{i + 1}], 6) AS p{i}" for i in range(NUM_CLASSES))},
       round(list_sum(p), 6) AS total FROM sm""")
def q_d1(spark, sf):
    g = X.scored_rows(spark, sf).select("vec_id", D.softmax("logits").alias("p"))
    return g.select("vec_id", *[r6(F.col("p")[i]).alias(f"p{i}") for i in range(NUM_CLASSES)],
                    r6(F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@register("d2_argmax", f"""WITH {S.g_cte()}
SELECT vec_id, cast(pred as bigint) AS pred FROM g""")
def q_d2(spark, sf):
    return X.scored_rows(spark, sf).select("vec_id", big(D.argmax("logits")).alias("pred"))


@register("d3_decide", f"""WITH {S.g_cte()}
SELECT vec_id, {S.label_name('pred')} AS type, round({S.softmax('logits')}[pred + 1], 6) AS confidence FROM g""")
def q_d3(spark, sf):
    g = X.scored_rows(spark, sf).select("vec_id", D.decide("logits").alias("d"))
    return g.select("vec_id", F.col("d.type").alias("type"), r6(F.col("d.confidence")).alias("confidence"))


@register("d4_explode_confidences", f"""WITH {S.g_cte()}, sm AS (SELECT vec_id, {S.softmax('logits')} AS p FROM g),
ex AS (SELECT vec_id, generate_subscripts(p, 1) - 1 AS class_id, unnest(p) AS prob FROM sm)
SELECT vec_id, cast(class_id as bigint) AS class_id, {S.label_name('class_id')} AS class, round(prob, 6) AS prob FROM ex""")
def q_d4(spark, sf):
    from reqsight.operators.model import explode_confidences
    g = X.scored_rows(spark, sf).select("vec_id", D.softmax("logits").alias("probs"))
    e = explode_confidences(g, "probs", ["vec_id"])
    return e.select("vec_id", big(F.col("class_id")).alias("class_id"), "class", r6(F.col("prob")).alias("prob"))


@register("d5_verdict", f"""WITH RECURSIVE {S.t_cte()}, {SCORED_SQL}
SELECT id, CASE WHEN payload IS NULL OR payload = '' THEN 'ERROR' WHEN lower(type) = 'error' THEN 'ATTACK'
  WHEN lower(type) = 'normal' THEN 'NORMAL' ELSE 'ATTACK' END AS status,
  CASE WHEN payload IS NULL OR payload = '' THEN NULL ELSE type END AS type, payload FROM scored""")
def q_d5(spark, sf):
    s = rule_scored(spark, sf).select("id", D.verdict("type", "payload").alias("v"))
    return s.select("id", "v.status", "v.type", "v.payload")


@register("d6_api_record", f"""WITH {S.g_cte()}
SELECT vec_id, {S.label_name('pred')} <> 'normal' AS is_attack,
       round({S.softmax('logits')}[pred + 1], 6) AS confidence, 'charngram-lr-v1' AS model,
       upper({S.label_name('pred')}) AS attack_type FROM g""")
def q_d6(spark, sf):
    g = X.scored_rows(spark, sf).select("vec_id", D.decide("logits").alias("d"))
    g = g.select("vec_id", D.api_record(F.col("d.type"), F.col("d.confidence"), "charngram-lr-v1").alias("r"))
    return g.select("vec_id", "r.is_attack", r6(F.col("r.confidence")).alias("confidence"), "r.model",
                    "r.attack_type")


@register("d7_outcome", f"""WITH RECURSIVE {S.t_cte()}, {SCORED_SQL}
SELECT id, CASE WHEN (CASE WHEN payload = '' THEN 'ERROR' WHEN type = 'normal' THEN 'NORMAL' ELSE 'ATTACK' END) = 'ATTACK'
  THEN 'BLOCKED' ELSE 'ALLOWED' END AS outcome FROM scored""")
def q_d7(spark, sf):
    s = rule_scored(spark, sf)
    return s.select("id", D.outcome(D.verdict_status("type", "payload")).alias("outcome"))


# ============================================================== 2.6 evaluation over G

PC_SQL = """cm AS (SELECT label, pred, count(*) AS n FROM g GROUP BY label, pred),
truth AS (SELECT label AS cls, sum(n) AS support FROM cm GROUP BY label),
predd AS (SELECT pred AS cls, sum(n) AS predicted FROM cm GROUP BY pred),
tp AS (SELECT label AS cls, n AS tp FROM cm WHERE label = pred),
pc0 AS (SELECT coalesce(t.cls, p.cls) AS cls, coalesce(t.support, 0) AS support,
               coalesce(p.predicted, 0) AS predicted FROM truth t FULL JOIN predd p ON t.cls = p.cls),
pc1 AS (SELECT pc0.*, coalesce(tp.tp, 0) AS tp FROM pc0 LEFT JOIN tp ON tp.cls = pc0.cls),
pc2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0 END AS recall FROM pc1),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc2)"""


@register("a3_confusion_matrix", f"""WITH {S.g_cte()}
SELECT cast(label as bigint) AS label, cast(pred as bigint) AS pred, count(*) AS n FROM g GROUP BY label, pred""")
def q_a3(spark, sf):
    cm = A.confusion_matrix(X.scored_rows(spark, sf))
    return cm.select(big(F.col("label")).alias("label"), big(F.col("pred")).alias("pred"), "n")


@register("a4_accuracy", f"""WITH {S.g_cte()}
SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM g""")
def q_a4(spark, sf):
    a = A.accuracy(X.scored_rows(spark, sf))
    return a.select(r6(F.col("accuracy")).alias("accuracy"), "n")


@register("a5_weighted_prf", f"""WITH {S.g_cte()}, {PC_SQL}
SELECT round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1,
       round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy FROM pc""")
def q_a5(spark, sf):
    w = A.weighted_prf(X.scored_rows(spark, sf))
    return w.select(*[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@register("a6_classification_report", f"""WITH {S.g_cte()}, {PC_SQL}
SELECT cast(cls as bigint) AS row_order, {S.label_name('cls')} AS class, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, cast(support as bigint) AS support FROM pc
UNION ALL SELECT 100, 'accuracy', NULL, NULL, round(sum(tp)::DOUBLE / sum(support), 6), cast(sum(support) as bigint) FROM pc
UNION ALL SELECT 101, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) FROM pc
UNION ALL SELECT 102, 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       cast(sum(support) as bigint) FROM pc""")
def q_a6(spark, sf):
    r = A.classification_report(X.scored_rows(spark, sf))
    return r.select(big(F.col("row_order")).alias("row_order"), "class",
                    *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("a7_file_accuracy", f"""WITH RECURSIVE {S.t_cte()}, {SCORED_SQL},
rows AS (SELECT src, CASE WHEN (contains(lower(src), 'normal') AND lower(type) = 'normal')
   OR (NOT contains(lower(src), 'normal') AND lower(type) <> 'normal') THEN 1 ELSE 0 END AS ok FROM scored)
SELECT src, cast(sum(ok) as bigint) AS correct, count(*) AS total, round(sum(ok) * 100.0 / count(*), 2)::DOUBLE AS pct
FROM rows GROUP BY src""")
def q_a7(spark, sf):
    return A.file_accuracy(rule_scored(spark, sf)).select("src", "correct", "total",
                                                          F.col("pct").cast("double").alias("pct"))


@register("a7_file_rows", f"""WITH RECURSIVE {S.t_cte()}, {SCORED_SQL}
SELECT id, CASE WHEN contains(lower(src), 'normal') THEN 'normal' ELSE 'attack' END AS expected,
  CASE WHEN (contains(lower(src), 'normal') AND lower(type) = 'normal')
    OR (NOT contains(lower(src), 'normal') AND lower(type) <> 'normal') THEN 'PASS' ELSE 'FAIL' END AS status,
  substr(payload, 1, 50) AS preview, upper(type) AS pred FROM scored""")
def q_a7_rows(spark, sf):
    r = A.file_rows(rule_scored(spark, sf))
    return r.select("id", "expected", "status", "preview", F.upper("type").alias("pred"))


@register("a8_roc_auc", f"""WITH {S.g_cte()}, sm AS (SELECT vec_id, label, {S.softmax('logits')} AS p FROM g),
ex AS (SELECT label, generate_subscripts(p, 1) - 1 AS cls, unnest(p) AS score FROM sm),
s AS (SELECT cls, score, sum(CASE WHEN label = cls THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label <> cls THEN 1 ELSE 0 END) AS q
      FROM ex GROUP BY cls, score),
w AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT cast(cls as bigint) AS class_id,
       round(CASE WHEN sum(p) * sum(q) > 0 THEN sum(p * (below + q * 0.5))::DOUBLE / (sum(p) * sum(q)) END, 6) AS auc,
       cast(sum(p) as bigint) AS n_pos, cast(sum(q) as bigint) AS n_neg FROM w GROUP BY cls""")
def q_a8(spark, sf):
    g = X.scored_rows(spark, sf).select("label", F.posexplode(D.softmax("logits")).alias("cls", "score"))
    g = g.select("cls", "score", (F.col("label") == F.col("cls")).alias("pos"))
    r = A.roc_auc(g, "score", "pos", group="cls")
    return r.select(big(F.col("cls")).alias("class_id"), r6(F.col("auc")).alias("auc"),
                    big(F.col("n_pos")).alias("n_pos"), big(F.col("n_neg")).alias("n_neg"))


@register("a9_latency_summary", """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean,
  round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95,
  round(quantile_disc(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""")
def q_a9(spark, sf):
    ev = X.read_table(spark, sf, "events")
    s = A.latency_summary(ev, "value", "event_type")
    return s.select("event_type", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "p50", "p95", "p99")])


@register("a10_cross_entropy", f"""WITH {S.g_cte()}
SELECT round(avg({S.log_sum_exp('logits')} - logits[label + 1]), 6) AS cross_entropy, count(*) AS n FROM g""")
def q_a10(spark, sf):
    c = A.cross_entropy(X.scored_rows(spark, sf))
    return c.select(r6(F.col("cross_entropy")).alias("cross_entropy"), "n")


SUITE_SCORED_SQL = f"""cs0 AS (SELECT *, {S.assemble('args')} AS payload FROM c),
{S.closure_scored("cs", "cs0", "event_id", "payload")}"""


def suite_scored(spark, sf) -> DataFrame:
    c = X.suite_events(spark, sf).withColumn("payload", P.assemble_payload("args"))
    return c.withColumn("type", P.bound(P.joined_views("payload"), L.rule_scorer))


@register("a11_suite_report", f"""WITH RECURSIVE {S.suite_cte()}, {SUITE_SCORED_SQL}
SELECT name, payload, expected_class,
  CASE WHEN (CASE WHEN payload = '' THEN 'ERROR' WHEN type = 'normal' THEN 'NORMAL' ELSE 'ATTACK' END) = 'ATTACK'
    THEN 'BLOCKED' ELSE 'ALLOWED' END AS outcome, upper(type) AS detected, count(*) AS requests,
  bool_and(type = expected_class) AS passed
FROM cs GROUP BY ALL""")
def q_a11(spark, sf):
    return A.suite_report(suite_scored(spark, sf))


@register("a11_suite_pass_rate", f"""WITH RECURSIVE {S.suite_cte()}, {SUITE_SCORED_SQL},
rep AS (SELECT name, bool_and(type = expected_class) AS passed, count(*) AS requests FROM cs GROUP BY name)
SELECT round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, count(*) AS cases,
       cast(sum(requests) as bigint) AS requests FROM rep""")
def q_a11_rate(spark, sf):
    r = A.suite_pass_rate(A.suite_report(suite_scored(spark, sf)))
    return r.select(r6(F.col("pass_rate")).alias("pass_rate"), "cases", big(F.col("requests")).alias("requests"))


@register("a2_profile_log", f"""WITH {S.r_cte()},
tot AS (SELECT 'total' AS section, 0::BIGINT AS rank, NULL::VARCHAR AS value, count(*) AS n FROM r),
smp AS (SELECT 'sample' AS section, row_number() OVER (ORDER BY page_id)::BIGINT AS rank,
   coalesce(http_method, '') || ' ' || coalesce(http_path, '') || ' ' || coalesce(http_query, '') AS value,
   NULL::BIGINT AS n FROM r ORDER BY page_id LIMIT 5),
top AS (SELECT 'top_rule' AS section, row_number() OVER (ORDER BY count(*) DESC, rule_names ASC NULLS LAST)::BIGINT AS rank,
   rule_names AS value, count(*) AS n FROM r GROUP BY rule_names ORDER BY n DESC, rule_names LIMIT 10)
SELECT * FROM tot UNION ALL SELECT * FROM smp UNION ALL SELECT * FROM top""")
def q_a2(spark, sf):
    return A.profile_log(X.requests(spark, sf), "page_id")


@register("m6_top_values", """SELECT event_type, count(*) AS n FROM events GROUP BY event_type
ORDER BY n DESC, event_type LIMIT 10""")
def q_m6(spark, sf):
    return M.top_values(X.read_table(spark, sf, "events"), "event_type", 10)


# ============================================================== 2.5 sampling


@register("m1_cap_per_class", f"""WITH {S.labelled_cte()},
rk AS (SELECT id, label_str, row_number() OVER (PARTITION BY label ORDER BY {S.draw('id', 'cap')}, id) AS rn
       FROM lab WHERE label IS NOT NULL)
SELECT id, label_str FROM rk WHERE rn <= 5000""")
def q_m1(spark, sf):
    # both passes read the written labels, not the rules over the texts again
    lab = reliable_checkpoint(labelled(spark, sf).select("id", "label", "label_str"))
    return M.cap_per_class(lab, "label", "id", 5000).select("id", "label_str")


@register("m1_cap_per_class_embeddings", f"""WITH rk AS (SELECT vec_id, label,
  row_number() OVER (PARTITION BY label ORDER BY {S.draw('vec_id', 'cap')}, vec_id) AS rn FROM embeddings WHERE label IS NOT NULL)
SELECT vec_id, cast(label as bigint) AS label FROM rk WHERE rn <= 30""")
def q_m1_emb(spark, sf):
    e = X.read_table(spark, sf, "embeddings").select("vec_id", "label")
    return M.cap_per_class(e, "label", "vec_id", 30).select("vec_id", big(F.col("label")).alias("label"))


@register("m2_random_split", f"""WITH {S.t_cte()}
SELECT id, CASE WHEN {S.unit(S.draw_hex('id', 'split'))} < 0.2 THEN 'test' ELSE 'train' END AS split,
       CASE WHEN {S.unit(S.draw_hex('tid', 'split'))} < 0.2 THEN 'test' ELSE 'train' END AS group_split FROM t""")
def q_m2(spark, sf):
    t = X.labelled_lines(spark, sf)
    a = M.random_split(t, "id").select("id", "split", "tid")
    return M.random_split(a.withColumnRenamed("split", "_s"), "id", group_col="tid") \
        .select("id", F.col("_s").alias("split"), F.col("split").alias("group_split"))


@register("m3_stratified_split", f"""WITH e AS (SELECT vec_id, label,
  row_number() OVER (PARTITION BY label ORDER BY {S.draw('vec_id', 'strat')}, vec_id) - 1 AS rk,
  count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, cast(label as bigint) AS label, CASE WHEN rk < round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM e""")
def q_m3(spark, sf):
    e = X.read_table(spark, sf, "embeddings").select("vec_id", "label")
    s = M.stratified_split(e, "label", "vec_id", 0.2)
    return s.select("vec_id", big(F.col("label")).alias("label"), "split")


@register("m4_shuffle_rows", f"""WITH {S.t_cte()}
SELECT id, row_number() OVER (ORDER BY {S.draw('id', 'shuffle')}, id) - 1 AS row_index FROM t""")
def q_m4(spark, sf):
    return M.shuffle_rows(X.labelled_lines(spark, sf), "id").select("id", "row_index")


@register("m5_sample_templates", f"""WITH t AS (SELECT doc_id, text, row_number() OVER (ORDER BY {S.draw('doc_id', 'pos')}, doc_id) - 1 AS pos FROM documents)
SELECT e.event_id, t.doc_id, md5(coalesce(t.text, '')) AS text_md5 FROM events e
JOIN t ON t.pos = {S.wide_draw('e.event_id', 'pick')} % (SELECT count(*) FROM documents)""")
def q_m5(spark, sf):
    docs = X.read_table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    return M.sample_templates(X.read_table(spark, sf, "events").select("event_id"), docs, "event_id", "doc_id")


@register("m7_hard_negatives", f"""WITH {S.g_cte()}, d AS (SELECT vec_id, label, pred, {S.softmax('logits')}[pred + 1] AS confidence FROM g)
SELECT vec_id, cast(pred as bigint) AS pred, round(confidence, 6) AS confidence FROM d
WHERE label = 0 AND pred <> 0 AND confidence >= 0.0 ORDER BY confidence DESC, vec_id LIMIT 100""")
def q_m7(spark, sf):
    g = X.scored_rows(spark, sf).withColumn("confidence", D.decide("logits")["confidence"])
    h = M.hard_negatives(g, key="vec_id", k=100)
    return h.select("vec_id", big(F.col("pred")).alias("pred"), r6(F.col("confidence")).alias("confidence"))


# ============================================================== 2.7 augmentation

def _aug_query(steps, name):
    ctes, last = S.augment_ctes("lab", "id", "text", "label_str", prefix="au", steps=steps)
    sql = f"""WITH {S.labelled_cte()},
{ctes}
SELECT id, label_str, p AS text FROM {last}"""

    def fn(spark, sf):
        from reqsight.functions.augment import augment_payloads
        d = labelled(spark, sf).select("id", "label_str", "text")
        return augment_payloads(d, "text", "label_str", "id", steps=steps)

    register(name, sql)(fn)


_aug_query(("sqli",), "g1_mutate_sqli")
_aug_query(("xss",), "g2_mutate_xss")
_aug_query(("path",), "g3_mutate_path")
_aug_query(("general",), "g4_mutate_general")
_aug_query(("regen",), "g5_regenerate_normal")
_aug_query(("sqli", "xss", "path", "general", "regen"), "g7_augment_payload")


@register("g6_random_parts", f"""WITH {S.t_cte()}
SELECT id, {S.choice(RANDOM_PARAMS, S.word(S.draw_hex('id', 'ge'), 1))} AS param,
       {S.choice(RANDOM_PATHS, S.word(S.draw_hex('id', 'ge'), 2))} AS path,
       {S.random_chars([S.word(S.draw_hex('id', g), k) for g in ('r1', 'r2') for k in range(4)])} AS rnd8 FROM t""")
def q_g6(spark, sf):
    from reqsight.fixed import RANDOM_ALPHABET
    from reqsight.functions.draws import choice, draw_hex, random_string, word
    t = X.labelled_lines(spark, sf)
    ge = draw_hex(F.col("id"), "ge")
    words = [word(draw_hex(F.col("id"), g), k) for g in ("r1", "r2") for k in range(4)]
    return t.select("id", choice(RANDOM_PARAMS, word(ge, 1)).alias("param"),
                    choice(RANDOM_PATHS, word(ge, 2)).alias("path"),
                    random_string(RANDOM_ALPHABET, words).alias("rnd8"))


G8_FACTOR = 3  # the registered target: three times the raw rows, at every size


def _g8_sql() -> str:
    ctes, last = S.augment_ctes("pk", "id", "text", "label_str", prefix="au")
    return f"""WITH {S.labelled_cte()},
raw AS (SELECT id AS src_id, text, label_str, tid FROM lab),
idx AS (SELECT *, row_number() OVER (ORDER BY {S.draw('src_id', 'pos')}, src_id) - 1 AS pos FROM raw),
ids AS (SELECT unnest(range((SELECT max(src_id) + 1 FROM raw), (SELECT max(src_id) + 1 + {G8_FACTOR - 1} * count(*) FROM raw))) AS id),
pk AS (SELECT ids.id, idx.src_id, idx.tid, idx.text, idx.label_str FROM ids
       JOIN idx ON idx.pos = {S.wide_draw('ids.id', 'pick')} % (SELECT count(*) FROM raw)),
{ctes},
allrows AS (SELECT src_id AS id, 'raw' AS origin, src_id, tid, text, label_str FROM raw
            UNION ALL SELECT id, 'aug', src_id, tid, p, label_str FROM {last})
SELECT id, origin, src_id, cast(tid as bigint) AS tid, text, label_str, cast({S.label_id('label_str')} as bigint) AS label FROM allrows"""


@register("g8_augment_dataset", _g8_sql())
def q_g8(spark, sf):
    d = augment_dataset(spark, labelled(spark, sf), "id", factor=G8_FACTOR)
    return d.select("id", "origin", "src_id", big(F.col("tid")).alias("tid"), "text", "label_str",
                    big(F.col("label")).alias("label"))


@register("g8_augment_distribution", f"""WITH g8 AS ({_g8_sql()})
SELECT label_str, origin, count(*) AS n FROM g8 GROUP BY label_str, origin""")
def q_g8_dist(spark, sf):
    d = augment_dataset(spark, labelled(spark, sf), "id", factor=G8_FACTOR)
    return d.groupBy("label_str", "origin").agg(F.count(F.lit(1)).alias("n"))


# ============================================================== 2.8 encoding

_NON_ASCII = "[\\x00-\\x7f]+"


@register("e1_encode_chars", f"""WITH c AS (SELECT doc_id, text,
  list_transform(range(1, least(length(coalesce(text, '')), 128) + 1),
    lambda i_: CASE WHEN ord(substr(text, i_, 1)) < 128 THEN ord(substr(text, i_, 1)) + 1 ELSE 129 END) AS ids FROM documents)
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(128 - len(ids)), lambda z_: 0)), ' ') AS ids,
       cast(length(text) as bigint) AS n_chars,
       cast(length(regexp_replace(text, '{_NON_ASCII}', '', 'g')) as bigint) AS n_unknown FROM c""")
def q_e1(spark, sf):
    d = X.read_table(spark, sf, "documents")
    return d.select("doc_id", joined(encode_chars("text")).alias("ids"), big(F.length("text")).alias("n_chars"),
                    big(F.length(F.regexp_replace("text", _NON_ASCII, ""))).alias("n_unknown"))


@register("e2_encode_cls_chars", f"""WITH c AS (SELECT doc_id, lower(coalesce(text, '')) AS lt FROM documents),
b AS (SELECT doc_id, list_transform(range(1, least(length(lt), 126) + 1),
    lambda i_: CASE WHEN ord(substr(lt, i_, 1)) BETWEEN 33 AND 126 THEN 1000 + ord(substr(lt, i_, 1)) ELSE 100 END) AS body FROM c)
SELECT doc_id, array_to_string(list_concat([101], body, [102], list_transform(range(126 - len(body)), lambda z_: 0)), ' ') AS ids,
       cast(len(body) + 2 as bigint) AS mask_sum FROM b""")
def q_e2(spark, sf):
    d = X.read_table(spark, sf, "documents")
    enc = encode_cls_chars("text", DEMO_CHAR_VOCAB)
    return d.select("doc_id", joined(enc["ids"]).alias("ids"),
                    big(F.aggregate(enc["mask"], F.lit(0), lambda a, x: a + x)).alias("mask_sum"))


# ============================================================== 2.9 training and scoring
_MODEL_CACHE: dict = {}


def _scratch(spark, name: str) -> str:
    import uuid
    from reqsight.session import shared_path
    return shared_path(spark, f"reqsight-runs/{name}-{uuid.uuid4().hex[:12]}")


def _taken(df: DataFrame, *paths: str) -> DataFrame:
    """``df`` written once more as a checkpoint (removed with the frame), its scratch folders deleted."""
    out = reliable_checkpoint(df)
    for p in paths:
        remove_path(df.sparkSession, p)
    return out


def trained(spark, sf):
    """T3 on the augmented dataset (G8), split by template so variants do not leak (Q11), settings selected by T2."""
    from reqsight.operators.model import TrainConfig, train_and_evaluate
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODEL_CACHE:
        data = augment_dataset(spark, labelled(spark, sf), "id", factor=G8_FACTOR)
        cfg = TrainConfig(group_col="tid", max_iter=30, num_features=1 << 15, grid=[{"reg_param": 0.001}, {"reg_param": 0.01}])
        _MODEL_CACHE.clear()
        _MODEL_CACHE[key] = train_and_evaluate(spark, data, cfg)
    return _MODEL_CACHE[key]


def _t3_split_sql() -> str:
    """Which templates are held out: per class, by the group draw (the rule of the stratified group split)."""
    return f"""g8 AS MATERIALIZED ({_g8_sql()}),
gl AS (SELECT tid, label, row_number() OVER (PARTITION BY tid ORDER BY count(*) DESC, label DESC) AS r FROM g8 GROUP BY tid, label),
gr AS (SELECT tid, label, row_number() OVER (PARTITION BY label ORDER BY {S.draw('tid', 'split')}, tid) AS r,
       count(*) OVER (PARTITION BY label) AS n FROM gl WHERE r = 1),
held AS (SELECT tid FROM gr WHERE n >= 2 AND r <= least(n - 1, greatest(1, round(n * 0.2))))"""


@register("t3_split_and_support", f"""WITH {_t3_split_sql()}
SELECT {S.label_name('label')} AS class, sum(CASE WHEN tid IN (SELECT tid FROM held) THEN 1 ELSE 0 END)::BIGINT AS support FROM g8
GROUP BY label HAVING support > 0""")
def q_t3_support(spark, sf):
    """T3's report: held-out rows of each class (classes that only the model predicts have none)."""
    report = trained(spark, sf)[2]
    return report.filter((F.col("row_order") < 100) & (F.col("support") > 0)).select("class", "support")


@register("t3_train_and_evaluate")
def q_t3(spark, sf):
    model, metrics, report, scored = trained(spark, sf)
    return report.select(big(F.col("row_order")).alias("row_order"), "class",
                         *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def _scored_t(spark, sf, model):
    from reqsight.operators.model import score
    return score(X.labelled_lines(spark, sf).withColumnRenamed("payload", "text"), model)


@register("t1_train_classifier", f"""WITH {S.labelled_cte()}
SELECT label_str, count(*) AS support, 8 AS classes, 0 AS not_the_argmax FROM lab GROUP BY label_str""")
def q_t1(spark, sf):
    """A model fitted on all labelled lines scores each of them with 8 probabilities and the class of the largest; by class."""
    from reqsight.operators.model import TrainConfig, score, train_classifier
    lab = reliable_checkpoint(labelled(spark, sf).select("id", "text", "label", "label_str"))
    s = score(lab, train_classifier(lab, TrainConfig(max_iter=10, num_features=1 << 12)))
    worse = F.element_at("probs", F.col("pred") + 1) < F.array_max("probs")
    return s.groupBy("label_str").agg(F.count(F.lit(1)).alias("support"), F.max(F.size("probs")).alias("classes"),
                                      big(F.sum(worse.cast("int"))).alias("not_the_argmax"))


@register("t2_select_best", f"""WITH {S.labelled_cte()} SELECT 2 AS candidates, TRUE AS best_is_largest, TRUE AS in_range, count(*) AS rows FROM lab""")
def q_t2(spark, sf):
    """Every candidate is measured after each step of its curve, and the chosen step is the best of all curves."""
    from reqsight.operators.model import TrainConfig, select_best
    lab = reliable_checkpoint(labelled(spark, sf).select("id", "text", "label", "tid"))
    grid = [{"reg_param": 0.001}, {"reg_param": 0.1}]
    model, best, results = select_best(lab, grid, TrainConfig(group_col="tid", num_features=1 << 12, steps=[3, 6, 10]))
    r = spark.createDataFrame([(x["params"]["reg_param"], x["params"] == best, float(x["f1"])) for x in results], "reg double, chosen boolean, f1 double")
    r = r.agg(F.countDistinct("reg").alias("candidates"), (F.max(F.when(F.col("chosen"), F.col("f1"))) == F.max("f1")).alias("best_is_largest"),
              F.bool_and(F.col("f1").between(0, 1)).alias("in_range"))
    from reqsight.operators.model import score
    return r.withColumn("k", F.lit(1)).join(score(lab, model).agg(F.count("confidence").alias("rows")).withColumn("k", F.lit(1)), "k").drop("k")


@register("t5_score")
def q_t5(spark, sf):
    s = _scored_t(spark, sf, trained(spark, sf)[0])
    return s.select("id", "type", r6(F.col("confidence")).alias("confidence"))


@register("t5_score_checks", f"""WITH {S.t_cte()} SELECT count(*) AS rows, 0 AS sums_off, 0 AS not_the_argmax FROM t""")
def q_t5_checks(spark, sf):
    """T5: every line is scored, its probabilities sum to 1 and its class is the one with the largest."""
    s = _scored_t(spark, sf, trained(spark, sf)[0])
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return s.agg(F.count(F.lit(1)).alias("rows"), big(F.sum((F.abs(total - 1) > 1e-9).cast("int"))).alias("sums_off"),
                 big(F.sum((F.element_at("probs", F.col("pred") + 1) < F.array_max("probs")).cast("int"))).alias("not_the_argmax"))


@register("t7_score_many", f"""WITH {S.t_cte()} SELECT count(*) AS rows, 3 * count(*) AS scores, 0 AS votes_off FROM t""")
def q_t7_many(spark, sf):
    """Three trained models score every line; the vote agrees with a count over the long form."""
    from reqsight.operators.model import TrainConfig, score_many, train_classifier
    lab = reliable_checkpoint(labelled(spark, sf).select("id", "text", "label"))
    models = {f"m{n}": train_classifier(lab, TrainConfig(ngram=n, max_iter=5, num_features=1 << 10)) for n in (1, 2, 3)}
    longs, votes = score_many(lab.select("id", "text"), models)
    by = longs.groupBy("id").agg(F.sort_array(F.collect_list("pred")).alias("p"), F.count(F.lit(1)).alias("k"))
    # of three votes in order the middle one is in the majority if there is one, else the smallest wins
    p = F.col("p")
    want = F.when((p[0] == p[1]) | (p[1] == p[2]), p[1]).otherwise(p[0])
    j = by.join(votes, "id")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.sum("k").alias("scores"), big(F.sum((want != F.col("vote")).cast("int"))).alias("votes_off"))


#: Three pseudo-models: three ways to fold all 64 values into 8 logits (SQL over the 1-based, Python over the 0-based position).
FOLDS = [("(i_ - 1) % 8", lambda i: i % 8), ("(i_ - 1) // 8", lambda i: F.floor(i / 8)), ("((i_ - 1) // 2) % 8", lambda i: F.floor(i / 2) % 8)]


@register("t7_majority_vote", f"""WITH m AS MATERIALIZED ({" UNION ALL ".join(f"SELECT vec_id, {S.fold_logits(sql)} AS lg FROM embeddings" for sql, _ in FOLDS)}),
lg AS (SELECT vec_id, cast(list_position(lg, list_max(lg)) - 1 as integer) AS pred FROM m),
vt AS (SELECT vec_id, pred, count(*) AS n FROM lg GROUP BY vec_id, pred),
bt AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, pred ASC) AS rn,
       sum(n) OVER (PARTITION BY vec_id) AS voters FROM vt)
SELECT vec_id, cast(pred as integer) AS vote, n AS votes, cast(voters as bigint) AS voters FROM bt WHERE rn = 1""")
def q_t7(spark, sf):
    from reqsight.operators.model import majority_vote
    e = X.read_table(spark, sf, "embeddings")
    preds = [F.struct(F.lit(f"m{m}").alias("model"), D.argmax(X.fold_logits("embedding", place)).alias("pred"))
             for m, (_, place) in enumerate(FOLDS)]
    longs = e.select("vec_id", F.explode(F.array(*preds)).alias("p")).select("vec_id", "p.model", "p.pred")
    v = majority_vote(longs, "vec_id")
    return v.select("vec_id", "vote", "votes", big(F.col("voters")).alias("voters"))


VSCORED_SQL = S.closure_scored("vs", "v", "event_id", "payload")


@register("t8_retrain_rows", f"""WITH RECURSIVE {S.v_cte()}, {VSCORED_SQL},
{S.t_cte(templates=False)}
SELECT DISTINCT payload AS text, type AS label_str FROM vs WHERE md5(payload) NOT IN (SELECT md5(payload) FROM t)""")
def q_t8(spark, sf):
    from reqsight.operators.model import retrain_rows
    from reqsight.streaming.jobs import rule_score
    v = rule_score(X.request_events(spark, sf)).select(F.col("payload").alias("text"), F.col("type").alias("label_str"))
    base = X.labelled_lines(spark, sf).select(F.col("payload").alias("text"))
    return retrain_rows(base, v)


@register("t8_retrain_from_logs", f"""WITH RECURSIVE {S.v_cte()}, {VSCORED_SQL},
{S.t_cte(templates=False)},
new AS (SELECT DISTINCT payload AS text, type AS label_str FROM vs WHERE payload <> '' AND md5(payload) NOT IN (SELECT md5(payload) FROM t))
SELECT (SELECT count(*) FROM t) + (SELECT count(*) FROM new) AS rows, 0 AS shared_ids""")
def q_t8_retrain(spark, sf):
    """T8 whole: log rows appended to the base, T3 run again; every row is on one side of the split, ids stay apart."""
    from reqsight.operators.model import TrainConfig, retrain_from_logs, retrain_rows
    from reqsight.streaming.jobs import rule_score
    base = reliable_checkpoint(labelled(spark, sf).select("id", "text", "label_str", "label"))
    v = rule_score(X.request_events(spark, sf)).filter("payload <> ''").select(F.col("payload").alias("text"), F.col("type").alias("label_str"))
    v = reliable_checkpoint(v)
    cfg = TrainConfig(max_iter=5, num_features=1 << 10, split="random", test=0.2)
    _, _, report, scored = retrain_from_logs(spark, base, v, cfg=cfg)
    added = retrain_rows(base, v).agg(F.count(F.lit(1)).alias("new"))
    shared = scored.groupBy("id").agg(F.count(F.lit(1)).alias("c")).agg(F.sum((F.col("c") > 1).cast("bigint")).alias("shared"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    r = one(base.agg(F.count(F.lit(1)).alias("old"))).join(one(added), "_k").join(one(shared), "_k")
    return r.select((F.col("old") + F.col("new")).alias("rows"), big(F.coalesce("shared", F.lit(0))).alias("shared_ids"))


@register("t8_retrain_hard_negatives", f"""WITH RECURSIVE {S.t_cte()}, {SCORED_SQL},
part AS (SELECT *, {S.unit(S.draw_hex('id', 'split'))} < 0.5 AS held FROM scored),
hard AS (SELECT DISTINCT payload AS text, 'normal' AS label_str FROM part WHERE held AND NOT is_attack AND type <> 'normal'),
logs AS (SELECT DISTINCT payload AS text, type AS label_str FROM part WHERE held AND payload <> ''),
new AS (SELECT * FROM hard UNION ALL SELECT * FROM logs WHERE md5(text) NOT IN (SELECT md5(text) FROM hard))
SELECT text, label_str FROM new WHERE md5(text) NOT IN (SELECT md5(payload) FROM part WHERE NOT held)""")
def q_t8_hard(spark, sf):
    """T8 with M7: half of the lines (M2) are the base, the others the traffic that the current scorer has judged since. Its
    false alarms there join the traffic's rows as normal ones and overrule the labels that it gave them."""
    from reqsight.operators.model import false_alarms, retrain_rows
    parts = reliable_checkpoint(M.random_split(rule_scored(spark, sf), "id", 0.5).withColumnRenamed("payload", "text"))
    traffic = parts.filter("split = 'test'")
    judged = traffic.select("id", "text", F.when(F.col("is_attack"), L.label_id("type")).otherwise(0).alias("label"),
                            L.label_id("type").alias("pred"), F.lit(1.0).alias("confidence"))
    logged = traffic.filter("text <> ''").select("text", F.col("type").alias("label_str"))
    return retrain_rows(parts.filter("split = 'train'"), logged, false_alarms(judged))


_PUNCT = r"!-/:-@\[-`{-~"


@register("e3_encode_wordpiece", rf"""WITH w AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))),
    '[{_PUNCT}]|[^\s{_PUNCT}]+')[1:126] AS w FROM documents),
p AS (SELECT doc_id, flatten(list_transform(w, lambda x_: CASE WHEN regexp_full_match(x_, '[!-~]+') AND length(x_) <= 100 THEN
    list_transform(range(1, length(x_) + 1), lambda i_: 5 + 2 * (ord(substr(x_, i_, 1)) - 33) + CASE WHEN i_ > 1 THEN 1 ELSE 0 END)
    ELSE [1] END))[1:126] AS p FROM w)
SELECT doc_id, array_to_string(list_concat([2], p, [3], list_transform(range(126 - len(p)), lambda z_: 0)), ' ') AS ids,
       cast(len(p) + 2 as bigint) AS mask_sum FROM p""")
def q_e3(spark, sf):
    """E3 over a rule-made vocabulary (every printable ASCII character and its ## form)."""
    from reqsight.operators.wordpiece import character_vocab, encode_wordpiece
    d = X.read_table(spark, sf, "documents").select("doc_id", "text")
    enc = encode_wordpiece(d, character_vocab(), "text")
    return enc.select("doc_id", joined(F.col("ids")).alias("ids"),
                      big(F.aggregate("mask", F.lit(0), lambda a, x: a + x)).alias("mask_sum"))


#: A public tokenizer file; its tokens are E3's subwords. Another path can be set before the query is called.
SUBWORD_FILE = "/opt/tokenizers/word_bpe_49k.json"


@register("e3_encode_subwords", rf"""WITH RECURSIVE f AS (
    SELECT unnest(map_entries(from_json(json_extract(content, '$.model.vocab'), '"MAP(VARCHAR, BIGINT)"'))) AS e FROM read_text('{SUBWORD_FILE}')),
s AS (SELECT regexp_replace(e.key, '</w>$', '') AS t, min(e.value) AS first FROM f GROUP BY 1),
v AS (SELECT t, 5 + 2 * (row_number() OVER (ORDER BY first) - 1) AS id FROM s WHERE regexp_full_match(t, '[!-~]+')),
d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[{_PUNCT}]|[^\s{_PUNCT}]+')[1:126] AS w FROM documents),
w AS (SELECT DISTINCT unnest(w) AS w FROM d),
p AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM w WHERE length(w) <= 100),
c AS (SELECT w, i, unnest(range(1, length(w) - i + 2)) AS n FROM p),
m AS (SELECT w, i, max(n) AS n, arg_max(id, n) AS id FROM c JOIN v ON v.t = substr(w, i, n) GROUP BY w, i),
g AS (SELECT w, cast(1 as bigint) AS i, cast([] as bigint[]) AS ids FROM w
      UNION ALL SELECT g.w, g.i + m.n, list_append(g.ids, m.id + CASE WHEN g.i > 1 THEN 1 ELSE 0 END) FROM g JOIN m ON g.w = m.w AND g.i = m.i),
k AS (SELECT w.w, coalesce(any_value(g.ids), [1]) AS ids FROM w LEFT JOIN g ON g.w = w.w AND g.i = length(w.w) + 1 GROUP BY w.w),
o AS (SELECT doc_id, generate_subscripts(w, 1) AS place, unnest(w) AS w FROM d),
q AS (SELECT o.doc_id, flatten(list(k.ids ORDER BY o.place))[1:126] AS p FROM o JOIN k ON o.w = k.w GROUP BY o.doc_id),
a AS (SELECT d.doc_id, coalesce(q.p, []) AS p FROM d LEFT JOIN q ON q.doc_id = d.doc_id)
SELECT doc_id, array_to_string(list_concat([2], p, [3], list_transform(range(126 - len(p)), lambda z_: 0)), ' ') AS ids,
       cast(len(p) + 2 as bigint) AS mask_sum FROM a""")
def q_e3_subwords(spark, sf):
    """E3 over a vocabulary of subwords: words fall into pieces of several characters, the longest first."""
    from reqsight.operators.wordpiece import encode_wordpiece, subword_vocab
    d = X.read_table(spark, sf, "documents").select("doc_id", "text")
    enc = encode_wordpiece(d, subword_vocab(SUBWORD_FILE), "text")
    return enc.select("doc_id", joined(F.col("ids")).alias("ids"),
                      big(F.aggregate("mask", F.lit(0), lambda a, x: a + x)).alias("mask_sum"))


@register("e4_char_ngram_features", """WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
g AS (SELECT doc_id, CASE WHEN length(t) > 2 THEN list_transform(range(1, length(t) - 1), lambda i_: substr(t, i_, 3)) ELSE [] END AS g FROM d)
SELECT doc_id, len(g) AS n_grams, len(list_distinct(g)) AS n_distinct, len(g) AS counted, TRUE AS within, len(g) > 0 AS found FROM g""")
def q_e4(spark, sf):
    """N-grams, different ones, the total of the stored counts, and stored entries: within the different ones, one at least."""
    from reqsight.operators.model import char_ngram_features
    d = X.read_table(spark, sf, "documents").select("doc_id", "text")
    f = char_ngram_features(d, "text", 3, 1 << 18)
    counts, stored = F.unwrap_udt("counts")["values"], F.size(F.unwrap_udt("features")["indices"])
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return f.select("doc_id", "n_grams", "n_distinct", big(total).alias("counted"), (stored <= F.col("n_distinct")).alias("within"),
                    (stored > 0).alias("found"))


# ============================================================== sources and sinks with files


@register("s2_read_request_log", f"""WITH {S.r_cte()}
SELECT nullif(http_method, '') AS http_method, nullif(http_path, '') AS http_path,
       nullif(http_query, '') AS http_query, nullif(rule_names, '') AS rule_names FROM r""")
def q_s2(spark, sf):
    """S2 round trip: R written as a ';' CSV with a header, read back (an empty field reads as NULL)."""
    from reqsight.sources.readers import read_request_log
    path = _scratch(spark, "requestlog")
    r = X.requests(spark, sf).select("http_method", "http_path", "http_query", "rule_names")
    r.write.option("header", True).option("sep", ";").csv(path)
    return _taken(read_request_log(spark, path), path)


@register("s2_read_wider_log", f"""WITH {S.r_cte()}
SELECT page_id AS bytes, nullif(rule_names, '') AS rule_names, nullif(http_query, '') AS http_query, nullif(host, '') AS client,
       nullif(http_path, '') AS http_path, nullif(http_method, '') AS http_method FROM r""")
def q_s2_wide(spark, sf):
    """S2 on a log with other columns between the known ones, in another order."""
    from reqsight.sources.readers import read_request_log
    path = _scratch(spark, "requestlog")
    r = X.requests(spark, sf).select("rule_names", F.col("host").alias("client"), "http_query", F.col("page_id").alias("bytes"), "http_path", "http_method")
    r.write.option("header", True).option("sep", ";").csv(path)
    log = read_request_log(spark, path)
    return _taken(log.withColumn("bytes", F.col("bytes").cast("bigint")), path)


@register("s4_write_samples", f"""WITH {S.labelled_cte()}
SELECT id, text, label_str, cast(label as bigint) AS label FROM lab""")
def q_s4(spark, sf):
    from reqsight.sources.readers import read_samples, write_samples
    path = _scratch(spark, "samples")
    write_samples(labelled(spark, sf).select("id", "text", "label_str", "label"), path)
    return _taken(read_samples(spark, path).select("id", "text", "label_str", big(F.col("label")).alias("label")), path)


def _v_stream(spark, sf) -> DataFrame:
    """V as a stream over the events files themselves; templates and P1 are applied in the stream."""
    from reqsight.sources.readers import request_stream
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # a pattern, as a file source takes a single file only by one
    return X.with_payload(request_stream(spark, f"{sf}/events.parque[t]", schema))


@register("s7_request_stream", f"""WITH {S.v_cte()}
SELECT event_id, payload FROM v""")
def q_s7(spark, sf):
    sink = _scratch(spark, "s7-sink")
    q = (_v_stream(spark, sf).select("event_id", "payload").writeStream.format("parquet")
         .option("path", sink).option("checkpointLocation", sink + "_ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return _taken(spark.read.parquet(sink).select("event_id", "payload"), sink, sink + "_ckpt")


# ============================================================== 2.11 streaming


@register("w1_score_stream", f"""WITH RECURSIVE {S.v_cte()}, {VSCORED_SQL}
SELECT event_id, CASE WHEN payload IS NULL OR payload = '' THEN 'ERROR' WHEN lower(type) = 'normal' THEN 'NORMAL'
  ELSE 'ATTACK' END AS status, CASE WHEN payload IS NULL OR payload = '' THEN NULL ELSE type END AS type, payload FROM vs""")
def q_w1(spark, sf):
    from reqsight.streaming.jobs import score_stream
    sink = _scratch(spark, "w1-sink")
    q = score_stream(_v_stream(spark, sf).select("event_id", "payload"), sink, sink + "_ckpt")
    q.awaitTermination()
    return _taken(spark.read.parquet(sink).select("event_id", "status", "type", "payload"), sink, sink + "_ckpt")


@register("w1_score_stream_model", f"""WITH {S.v_cte()}
SELECT count(*) AS rows, cast(count(*) FILTER (WHERE payload = '') AS bigint) AS errors, 0 AS unlike_batch, 0 AS status_off FROM v""")
def q_w1_model(spark, sf):
    """W1 by a trained model (T3's): every request of the stream has the class that scoring the table as a batch gives it."""
    from reqsight.operators.model import score
    from reqsight.streaming.jobs import score_stream
    model = trained(spark, sf)[0]
    sink = _scratch(spark, "w1m-sink")

    def scorer(df):
        return score(df, model, "payload").select(*df.columns, "type")

    score_stream(_v_stream(spark, sf).select("event_id", "payload"), sink, sink + "_ckpt", scorer).awaitTermination()
    got = spark.read.parquet(sink)
    want = scorer(X.request_events(spark, sf).select("event_id", "payload")).select(F.col("event_id").alias("id"), F.col("type").alias("want"), (F.col("payload") == "").alias("empty"))
    empty = F.col("b.empty")  # no payload goes through the join
    j = want.alias("b").join(got.alias("s"), F.col("b.id") == F.col("s.event_id"), "left")
    status = F.when(empty, "ERROR").when(F.col("want") == "normal", "NORMAL").otherwise("ATTACK")
    return _taken(j.agg(F.count(F.lit(1)).alias("rows"), big(F.sum((F.col("status") == "ERROR").cast("int"))).alias("errors"),
                        big(F.sum((~F.col("s.type").eqNullSafe(F.when(~empty, F.col("want")))).cast("int"))).alias("unlike_batch"),
                        big(F.sum((~F.col("status").eqNullSafe(status)).cast("int"))).alias("status_off")), sink, sink + "_ckpt")


@register("w2_attack_rate", f"""WITH RECURSIVE {S.v_cte()}, {VSCORED_SQL},
vv AS (SELECT ts, CASE WHEN payload IS NULL OR payload = '' THEN NULL ELSE type END AS type,
  CASE WHEN payload IS NULL OR payload = '' THEN 'ERROR' WHEN lower(type) = 'normal' THEN 'NORMAL' ELSE 'ATTACK' END AS status FROM vs)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, type, count(*) AS requests,
       cast(sum(CASE WHEN status = 'ATTACK' THEN 1 ELSE 0 END) as bigint) AS attacks FROM vv GROUP BY ALL""")
def q_w2(spark, sf):
    from reqsight.streaming.jobs import attack_rate, score_requests, window_start_text
    v = score_requests(X.request_events(spark, sf))
    r = attack_rate(v, "1 day", delay=None)
    return r.select(window_start_text("window").alias("window_start"), "type", "requests", "attacks")


@register("w3_collect_training_rows", f"""WITH RECURSIVE {S.v_cte()}, {VSCORED_SQL}
SELECT payload AS text, CASE WHEN payload = '' THEN NULL ELSE type END AS label_str FROM vs""")
def q_w3(spark, sf):
    from reqsight.streaming.jobs import collect_training_rows
    table = _scratch(spark, "w3-table")
    q = collect_training_rows(_v_stream(spark, sf).select("event_id", "payload"), table, table + "_ckpt")
    q.awaitTermination()
    # batch_id (a partition column) depends on how files fall into micro-batches; the rows do not
    return _taken(spark.read.parquet(table).select("text", "label_str"), table, table + "_ckpt")


LINES_PER_FILE, BYTES_PER_FILE = 1 << 20, 64 << 20


@register("s1_read_labelled_files", f"""WITH lines AS (
  SELECT generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT {S.py_strip('line')} AS s FROM lines),
p AS (SELECT CASE WHEN strpos(s, ': ') > 0 THEN substr(s, 1, strpos(s, ': ') - 1) ELSE '' END AS title,
       CASE WHEN strpos(s, ': ') > 0 THEN substr(s, strpos(s, ': ') + 2) ELSE s END AS payload FROM s WHERE s <> '')
SELECT title, payload, count(*) AS n FROM p GROUP BY ALL""")
def q_s1_files(spark, sf):
    """S1 on real text files: every document's lines written as text files, two header lines first in each, read back."""
    from reqsight.sources.readers import read_labelled_lines
    path = _scratch(spark, "lines")
    lines = X.read_table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    lines = lines.select("value", F.xxhash64("doc_id", "line").alias("no"))
    # lines are dealt by their hash to files of about LINES_PER_FILE or BYTES_PER_FILE; in each they come after two header lines
    n, size = lines.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()
    files = max(8, -(-n // LINES_PER_FILE), -(-size // BYTES_PER_FILE))
    lines = lines.select("value", F.pmod(F.xxhash64("value", F.col("no")), F.lit(files)).cast("int").alias("p"))
    head = spark.range(files).select(F.explode(F.array(F.lit("# labelled lines"), F.lit("# number. title: payload"))).alias("value"),
                                 F.col("id").cast("int").alias("p"))
    both = head.select("p", F.lit(0).alias("o"), "value").unionByName(lines.select("p", F.lit(1).alias("o"), "value"))
    both.repartitionById(files, F.col("p")).sortWithinPartitions("p", "o").select("value", "p").write.partitionBy("p").text(path)
    got = read_labelled_lines(spark, path + "/*")
    return _taken(got.groupBy("title", "payload").agg(F.count(F.lit(1)).alias("n")), path)


@register("t4_save_load_model", f"""WITH {S.t_cte()} SELECT count(*) AS rows, 0 AS different, 'v1' AS version, 32768 AS num_features, TRUE AS same_settings FROM t""")
def q_t4(spark, sf):
    """T4: the trained model saved as a version (Spark ML format + JSON sidecar) and loaded back scores every line as before."""
    from reqsight.operators.model import TrainConfig, load_model, save_model
    model, metrics = trained(spark, sf)[:2]
    base = _scratch(spark, "models")
    save_model(model, base, TrainConfig(**metrics["config"]), metrics, version="v1")
    loaded, meta = load_model(base)
    hashing, fitted = loaded.stages[-3], loaded.stages[-1]
    told = meta["config"]
    same = (hashing.getNumFeatures(), fitted.getRegParam(), fitted.getMaxIter()) == (told["num_features"], told["reg_param"], told["max_iter"])
    cols = ["id", "pred", "confidence"]
    a = _scored_t(spark, sf, model).select(*cols)
    b = _scored_t(spark, sf, loaded).select(F.col("id").alias("id2"), F.col("pred").alias("pred2"), F.col("confidence").alias("confidence2"))
    j = a.join(b, F.col("id") == F.col("id2"))
    off = (F.col("pred") != F.col("pred2")) | (F.abs(F.col("confidence") - F.col("confidence2")) > 1e-12)
    return _taken(j.agg(F.count(F.lit(1)).alias("rows"), big(F.sum(off.cast("int"))).alias("different"),
                        F.lit(meta["version"]).alias("version"), F.lit(hashing.getNumFeatures()).alias("num_features"),
                        F.lit(same).alias("same_settings")), base)


@register("w2_attack_rate_stream", f"""WITH RECURSIVE {S.v_cte()}, {VSCORED_SQL},
vv AS (SELECT ts, CASE WHEN payload IS NULL OR payload = '' THEN NULL ELSE type END AS type,
  CASE WHEN payload IS NULL OR payload = '' THEN 'ERROR' WHEN lower(type) = 'normal' THEN 'NORMAL' ELSE 'ATTACK' END AS status FROM vs)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, type, count(*) AS requests,
       cast(sum(CASE WHEN status = 'ATTACK' THEN 1 ELSE 0 END) as bigint) AS attacks FROM vv GROUP BY ALL""")
def q_w2_stream(spark, sf):
    """W2 as a stream over the events files: 1-day tumbling windows in update mode, every window in the result.

    A replay in file order is not in event order, so the watermark allows ten years; a live job would allow a day.
    """
    from reqsight.streaming.jobs import attack_rate, attack_rate_table, latest_windows, score_requests, window_start_text
    table = _scratch(spark, "w2-table")
    rates = attack_rate(score_requests(_v_stream(spark, sf)), "1 day", delay="3650 days")
    attack_rate_table(rates, table, table + "_ckpt").awaitTermination()
    r = latest_windows(spark.read.parquet(table))
    return _taken(r.select(window_start_text("window").alias("window_start"), "type", "requests", "attacks"), table, table + "_ckpt")


#: The late replay: the time span falls into so many deliveries; the rows of each ``LATE_ONE_IN``-th event come one delivery later.
DELIVERIES, LATE_ONE_IN = 3, 7


@register("w2_attack_rate_late", f"""WITH RECURSIVE {S.v_cte()}, {VSCORED_SQL},
span AS (SELECT min(epoch_us(cast(ts as timestamp))) AS lo, max(epoch_us(cast(ts as timestamp))) AS hi FROM events),
vv AS (SELECT vs.ts, CASE WHEN payload IS NULL OR payload = '' THEN NULL ELSE type END AS type,
  CASE WHEN payload IS NULL OR payload = '' THEN 'ERROR' WHEN lower(type) = 'normal' THEN 'NORMAL' ELSE 'ATTACK' END AS status,
  {DELIVERIES} * (epoch_us(vs.ts) - lo) // (hi - lo + 1) + CASE WHEN event_id % {LATE_ONE_IN} = 0 THEN 1 ELSE 0 END AS delivery
  FROM vs, span),
seen AS (SELECT d.delivery, max(e.ts) AS before FROM (SELECT DISTINCT delivery FROM vv) d LEFT JOIN vv e ON e.delivery < d.delivery GROUP BY d.delivery),
taken AS (SELECT vv.*, date_trunc('day', ts) AS day FROM vv JOIN seen USING (delivery)
  WHERE before IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > before - INTERVAL 1 DAY),
late AS (SELECT count(*) - (SELECT count(*) FROM taken) AS n FROM vv),
rates AS (SELECT day, type, count(*) AS requests, cast(sum(CASE WHEN status = 'ATTACK' THEN 1 ELSE 0 END) as bigint) AS attacks FROM taken
  WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM vv) - INTERVAL 1 DAY GROUP BY ALL)
SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS window_start, type, requests, attacks FROM rates""")
def q_w2_late(spark, sf):
    """W2 in append mode with a day's lateness over deliveries in the order of time, some rows a delivery late.

    Only closed windows come out, each once, when the watermark passes its end and its state is released; the late rows
    of closed windows are missing from them. Every delivery is one restart from the checkpoint, which keeps the watermark.
    """
    from reqsight.sources.readers import request_stream
    from reqsight.streaming.jobs import attack_rate, closed_windows, score_requests, window_start_text
    events = X.read_table(spark, sf, "events")
    us = F.unix_micros(X.utc_instant(F.col("ts")))
    lo, hi = events.agg(F.min(us), F.max(us)).first()
    table, inbox = _scratch(spark, "w2-late"), _scratch(spark, "w2-inbox")
    delivery = F.expr("0").cast("bigint") if lo is None else F.floor(F.lit(DELIVERIES) * (us - lo) / F.lit(hi - lo + 1)) + (F.col("event_id") % LATE_ONE_IN == 0).cast("int")
    for k in range(DELIVERIES + 1):
        events.filter(delivery == k).write.mode("append").parquet(inbox)
        rates = attack_rate(score_requests(X.with_payload(request_stream(spark, inbox, events.schema))), "1 day", delay="1 day")
        closed_windows(rates, table, table + "_ckpt").awaitTermination()
    r = spark.read.schema(rates.schema).parquet(table)
    return _taken(r.select(window_start_text("window").alias("window_start"), "type", "requests", "attacks"), table, table + "_ckpt", inbox)


@register("m7_hard_negatives_per_class", f"""WITH {S.g_cte()}, d AS (SELECT vec_id, label, pred, {S.softmax('logits')}[pred + 1] AS confidence FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY confidence DESC, vec_id) AS rank FROM d
      WHERE label = 0 AND pred <> 0 AND confidence >= 0.0)
SELECT vec_id, cast(pred as bigint) AS pred, round(confidence, 6) AS confidence, cast(rank as bigint) AS rank FROM r WHERE rank <= 5""")
def q_m7_per_class(spark, sf):
    g = X.scored_rows(spark, sf).withColumn("confidence", D.decide("logits")["confidence"])
    h = M.hard_negatives_per_class(g, 5, key="vec_id")
    return h.select("vec_id", big(F.col("pred")).alias("pred"), r6(F.col("confidence")).alias("confidence"),
                    big(F.col("rank")).alias("rank"))
