"""Queries over chat requests: turns, parts, hints, prompts, routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.config import Settings
from tablewright.functions.values import column_kind, parse_template
from tablewright.operators import requests as rq
from tablewright.operators.cache import cache_key, with_cache
from tablewright.operators.catalogue import model_list, tag_list
from tablewright.operators.pages import document_text, first_pages, image_cover, is_scan, needs_recognition, page_answer, selected_pages
from tablewright.plans.inputs import joined, table, text
from tablewright.schema import PART

SET = Settings(format_llm="shaper:7b")


def last_user_turn(spark, sf):
    return rq.last_user_turn(table(spark, sf, "conversations"))


def message_text(spark, sf):
    turns = table(spark, sf, "conversations").where("text is not null")
    part = F.struct(F.when(F.col("role") == "user", "text").otherwise("other").alias("type"), F.col("text").alias("text"))
    g = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("t"))
    return g.select("conv_id", rq.message_text(F.transform("t", lambda x: x["p"])).alias("text"))


def transcript(spark, sf):
    turns = table(spark, sf, "conversations").where("text is not null")
    return document_text(turns.select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), "text", text("talk-", F.col("conv_id")).alias("name")))


def page_headings(spark, sf):
    turns = table(spark, sf, "conversations").where("text is not null")
    return page_answer(turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"))


def _hint(k):
    n, a = k % 50 + 1, k % 9 + 1
    b = a + F.floor(k / 9) % 4
    forms = [
        text("Please read the First Page only, not page 7"), text("see page ", n), text("pages ", a, " - ", b, " and page 9"), text(n, "ページ目と page ", n + 3), text("pages 5-3"),
        text("no hint ", n), text("表は", a, "〜", b, "ページ"), text("page ", n + 1, ", page ", n, ", page ", n + 1), text("最初のページ"), text(n, "ページ")]
    out = forms[-1]
    for i in range(len(forms) - 2, -1, -1):
        out = F.when(k % 10 == i, forms[i]).otherwise(out)
    return out


def page_hints(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", joined(rq.requested_pages(_hint(F.col("o_orderkey")))).alias("pages"))


_HINT_SQL = """
SELECT o_orderkey, CASE k % 10 WHEN 0 THEN '1' WHEN 1 THEN CAST(n AS VARCHAR) WHEN 2 THEN array_to_string(range(a, b + 1), ',') WHEN 3 THEN n || ',' || (n + 3)
  WHEN 4 THEN '' WHEN 6 THEN array_to_string(range(a, b + 1), ',') WHEN 7 THEN n || ',' || (n + 1) WHEN 8 THEN '1' END AS pages
FROM (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 50 + 1 AS n, o_orderkey % 9 + 1 AS a, o_orderkey % 9 + 1 + (o_orderkey // 9) % 4 AS b FROM orders)
"""


def page_select(spark, sf):
    k = F.col("o_orderkey")
    asked = F.when(k % 3 == 0, F.sequence(k % 5, k % 5 + k % 30)).when(k % 3 == 1, F.array(F.lit(90).cast("long")))
    return table(spark, sf, "orders").select("o_orderkey", joined(selected_pages((k % 40).cast("int"), asked)).alias("pages"))


_SELECT_SQL = """
SELECT o_orderkey, array_to_string(CASE WHEN k % 3 = 0 AND len(there) > 0 THEN there ELSE range(1, least(c, 20) + 1) END, ',') AS pages
FROM (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 40 AS c, list_filter(range(o_orderkey % 5, o_orderkey % 5 + o_orderkey % 30 + 1), lambda p: p >= 1 AND p <= o_orderkey % 40) AS there FROM orders)
"""


def task_prompt(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    said = (F.when(k % 7 == 0, text("  Formula Recognition: the table of ", F.col("p_name"))).when(k % 7 == 1, text("a STABLE price for ", F.col("p_brand")))
            .when(k % 7 == 2, text("代表的な", F.col("p_brand"))).when(k % 7 == 3, text("write LaTeX for ", F.col("p_brand"))).when(k % 7 == 4, text("数式 ", F.col("p_brand")))
            .when(k % 7 == 5, text("text recognition: ", F.col("p_brand"))).otherwise(text("Text Recognition: table")))
    return p.select("p_partkey", rq.task_prompt(said).alias("prompt"))


_PROMPT_SQL = "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Formula Recognition:' WHEN 1 THEN 'Table Recognition:' WHEN 2 THEN 'Table Recognition:' WHEN 3 THEN 'Formula Recognition:' WHEN 4 THEN 'Formula Recognition:' ELSE 'Text Recognition:' END AS prompt FROM part"


def column_kinds(spark, sf):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("日付", "UPDATE ", "郵便番号", "Zip code", "電話", "Hotel ", "携帯date", "住所 ")]), (k % 8 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", column_kind(F.concat(name, F.col("p_partkey").cast("string"))).alias("kind"))


_KIND_SQL = "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'date' WHEN 1 THEN 'date' WHEN 2 THEN 'postal' WHEN 3 THEN 'postal' WHEN 4 THEN 'phone' WHEN 5 THEN 'phone' WHEN 6 THEN 'date' END AS kind FROM part"


def template_of(spark, sf):
    n = table(spark, sf, "nation")
    k, a = F.col("n_nationkey"), F.col("n_name")
    said = F.when(k % 4 == 0, text("整えて\n列: 日付, ", a, "、 ,", "住所／備考\nthanks")).when(k % 4 == 1, text("COLUMNS：", a)).when(k % 4 == 2, text("Column: , 、")).otherwise(text("just ", a))
    return n.select("n_nationkey", joined(parse_template(said, SET.format_template), "|").alias("template"))


_TEMPLATE_SQL = "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '日付|' || n_name || '|住所|備考' WHEN 1 THEN n_name ELSE '日付|姓|名|郵便番号|住所|電話番号|備考' END AS template FROM nation"


def _request(k):
    """Request texts of ten forms, by key."""
    image = '{"type":"image_url","image_url":{"url":"data:image/png;base64,AAAA"}}'
    pdf = '{"type":"file","file":{"filename":"dir/scan.v1.pdf","file_data":"data:application/pdf;base64,JVBERg=="}}'
    note = '{"type":"file","file":{"filename":"","file_data":"data:text/plain;base64,aGk="}}'
    say = '{"type":"text","text":"Table please, page 2"}'

    def body(model: str, *messages: str) -> str:
        return f'{{"model":"{model}","messages":[{",".join(messages)}]}}'

    def user(*parts: str) -> str:
        return f'{{"role":"user","content":[{",".join(parts)}]}}'

    forms = [
        "{bad json", body("llama", '{"role":"user","content":"[{not parts}]"}'), body("ocr-format", user(say, pdf)), body("ocr-format", user(say)), body("glm-ocr:latest", user(image, say)),
        body("glm-ocr", user(say, note)), body("llama", user(say, pdf)), body("llama", user(say), '{"role":"assistant","content":"ok"}'), body("glm-ocr", user(pdf), user(say)), body("shaper:7b", user(image))]
    return F.element_at(F.array(*[F.lit(x) for x in forms]), (k % 10 + 1).cast("int"))


def _parsed(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", _request(F.col("o_orderkey")).alias("body"))
    return o.select("o_orderkey", rq.parse_request(F.col("body")).alias("r"))


def route(spark, sf):
    return _parsed(spark, sf).select("o_orderkey", rq.route(F.col("r"), SET).alias("route"), rq.route(F.col("r"), Settings()).alias("route_unset"), rq.routed_model(F.col("r"), SET).alias("model"))


_ROUTE_SQL = """
SELECT o_orderkey, ['pass', 'pass', 'format', 'pass', 'ocr', 'rewrite', 'rewrite', 'pass', 'rewrite', 'pass'][o_orderkey % 10 + 1] AS route,
  ['pass', 'pass', 'reject', 'reject', 'ocr', 'rewrite', 'rewrite', 'pass', 'rewrite', 'pass'][o_orderkey % 10 + 1] AS route_unset,
  ['', 'llama', 'shaper:7b', 'shaper:7b', 'glm-ocr:latest', 'glm-ocr', 'llama', 'llama', 'glm-ocr', 'shaper:7b'][o_orderkey % 10 + 1] AS model FROM orders
"""


def has_files(spark, sf):
    return _parsed(spark, sf).select("o_orderkey", rq.has_files(F.col("r.messages")).alias("files"))


_FILES_SQL = "SELECT o_orderkey, o_orderkey % 10 IN (2, 5, 6, 8) AS files FROM orders"


def recognition_jobs(spark, sf):
    docs = _parsed(spark, sf).select(F.col("o_orderkey").alias("doc"), F.col("r.messages").alias("messages"))
    jobs = rq.recognition_jobs(docs)
    return jobs.select("doc", F.col("ord").cast("long").alias("ord"), "kind", "url", F.decode("data", "utf-8").alias("said"), joined(F.col("pages")).alias("pages"), "prompt", "source")


_JOBS_SQL = """
SELECT o_orderkey AS doc, CAST(CASE WHEN k IN (4, 9) THEN 0 ELSE 1 END AS BIGINT) AS ord, CASE WHEN k IN (2, 6) THEN 'pdf' ELSE 'image' END AS kind,
  CASE WHEN k IN (4, 9) THEN 'data:image/png;base64,AAAA' END AS url, CASE WHEN k IN (2, 6) THEN '%PDF' END AS said,
  CASE WHEN k <> 9 THEN '2' END AS pages, CASE WHEN k = 9 THEN 'Text Recognition:' ELSE 'Table Recognition:' END AS prompt, CASE WHEN k IN (2, 6) THEN 'scan.v1' ELSE 'ocr' END AS source
FROM (SELECT o_orderkey, o_orderkey % 10 AS k FROM orders) WHERE k IN (2, 4, 6, 9)
"""


def _parts(spark, sf):
    p = table(spark, sf, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    mime = F.when(k % 2 == 0, "image/png").otherwise("text/plain")
    url = rq.to_data_url(mime, F.encode(name, "utf-8"))
    file = F.struct(F.when(k % 3 == 0, F.lit("")).otherwise(text("f", k, ".txt")).alias("filename"), url.alias("file_data"))
    parts = F.array(F.struct(F.lit("text").alias("type"), name.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url"), F.lit(None).cast("struct<filename:string,file_data:string>").alias("file")),
                    F.struct(F.lit("file").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url"), file.alias("file")))
    return p.select("p_partkey", "p_name", parts.cast(f"array<{PART}>").alias("parts"), url.alias("url"))


def rewrite_parts(spark, sf):
    out = _parts(spark, sf).withColumn("new", rq.rewrite_parts(F.col("parts")))
    return out.select("p_partkey", F.size("new").cast("long").alias("parts"), F.col("new")[1]["type"].alias("type"), F.coalesce(F.col("new")[1]["text"], F.col("new")[1]["image_url"]["url"]).alias("shown"))


_REWRITE_SQL = """
SELECT p_partkey, CAST(2 AS BIGINT) AS parts, CASE WHEN p_partkey % 2 = 0 THEN 'image_url' ELSE 'text' END AS type,
  CASE WHEN p_partkey % 2 = 0 THEN 'data:image/png;base64,' || to_base64(encode(p_name)) ELSE 'File: "' || CASE WHEN p_partkey % 3 = 0 THEN 'document' ELSE 'f' || p_partkey || '.txt' END || '"' || chr(10) || chr(10) || p_name END AS shown FROM part
"""


def file_payloads(spark, sf):
    out = _parts(spark, sf).withColumn("f", rq.file_payload(F.col("parts")[1]))
    return out.select("p_partkey", F.col("f.name").alias("name"), F.col("f.mime").alias("mime"), F.decode("f.data", "utf-8").alias("said"), rq.file_stem(F.col("f.name")).alias("stem"))


_PAYLOAD_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'document' ELSE 'f' || p_partkey || '.txt' END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'image/png' ELSE 'text/plain' END AS mime, p_name AS said,
  CASE WHEN p_partkey % 3 = 0 THEN 'document' ELSE 'f' || p_partkey END AS stem FROM part
"""


def splice_pages(spark, sf):
    k = F.col("p_partkey")
    pdf = F.from_json(F.lit('[{"type":"text","text":"x"},{"type":"file","file":{"filename":"a.pdf","file_data":"data:application/pdf;base64,AAAA"}},{"type":"text","text":"y"}]'), f"array<{PART}>")
    new = rq.splice_pages(pdf, F.transform(F.sequence(F.lit(1).cast("long"), k % 3 + 1), lambda i: text("u", i)), text("t", k), k % 2 == 0)
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(new, lambda p: F.coalesce(p["text"], p["image_url"]["url"])), ",").alias("parts"))


_SPLICE_SQL = "SELECT p_partkey, 'x,' || CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_transform(range(1, p_partkey % 3 + 2), lambda i: 'u' || i), ',') ELSE 't' || p_partkey END || ',y' AS parts FROM part"


def vision_join(spark, sf):
    s = table(spark, sf, "supplier").where("s_nationkey % 3 < 2")
    models = s.select(F.col("s_name").alias("model"), F.when(F.col("s_nationkey") % 3 == 0, F.array(F.lit("tools"), F.lit("vision"))).otherwise(F.array(F.lit("tools"))).alias("capabilities"))
    asked = table(spark, sf, "customer").join(table(spark, sf, "supplier").select("s_suppkey", "s_name"), F.col("c_custkey") % 40 == F.col("s_suppkey"), "left").select("c_custkey", F.coalesce("s_name", F.lit("nobody")).alias("model"))
    return rq.with_vision(asked, models)


_VISION_SQL = "SELECT c_custkey, coalesce(s_name, 'nobody') AS model, coalesce(s_nationkey % 3 = 0, false) AS vision FROM customer LEFT JOIN supplier ON c_custkey % 40 = s_suppkey"


def catalogue_union(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("id"), text("r", F.col("n_regionkey")).alias("owned_by"))
    return model_list(n, SET)


_CATALOGUE_SQL = "SELECT n_name AS id, 'r' || n_regionkey AS owned_by FROM nation UNION ALL SELECT 'ocr-format', 'workflow'"


def tag_union(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("size"), F.lower("n_name").alias("digest"))
    return tag_list(n, SET)


_TAG_SQL = "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS size, lower(n_name) AS digest FROM nation UNION ALL SELECT 'ocr-format', 0, ''"


def ocr_models(spark, sf):
    k = F.col("p_partkey")
    model = F.when(k % 3 == 0, text("glm-ocr:", k)).when(k % 3 == 1, text("glm-ocr")).otherwise(text("m", k, ":7b"))
    return table(spark, sf, "part").select("p_partkey", rq.base_model(model).alias("base"), rq.is_ocr_model(model).alias("ocr"))


_OCR_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'glm-ocr' ELSE 'm' || p_partkey END AS base, p_partkey % 3 < 2 AS ocr FROM part"


def forward_headers(spark, sf):
    h = F.create_map(F.lit("Host"), F.col("n_name"), F.lit("X-Key"), F.col("n_nationkey").cast("string"), F.lit("CONTENT-length"), F.lit("1"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(F.map_keys(rq.forward_headers(h)), ",").alias("kept"), F.element_at(rq.forward_headers(h), "X-Key").alias("key"))


_HEADERS_SQL = "SELECT n_nationkey, 'X-Key' AS kept, CAST(n_nationkey AS VARCHAR) AS key FROM nation"


def scan_coverage(spark, sf):
    """Pages are orders, images their lines: boxes from the lines' numbers."""
    li = table(spark, sf, "lineitem")
    box = F.struct(F.col("l_linenumber").cast("double").alias("x0"), F.lit(-5.0).alias("y0"), (F.col("l_linenumber") + F.col("l_quantity")).alias("x1"), F.col("l_quantity").alias("y1"))
    pages = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", box.alias("b")))).alias("l")).withColumn("boxes", F.transform("l", lambda x: x["b"]))
    w, h = F.lit(40.0), F.lit(60.0)
    cover = image_cover(F.col("boxes"), w, h)
    return pages.select("l_orderkey", F.round(cover, 6).alias("cover"), is_scan(F.col("boxes"), w, h).alias("scan"), needs_recognition(F.lit("text"), is_scan(F.col("boxes"), w, h)).alias("recognise"))


_SCAN_SQL = """
SELECT l_orderkey, round(c, 6) AS cover, c >= 0.5 AS scan, c >= 0.5 AS recognise FROM (SELECT l_orderkey, sum(greatest(least(l_linenumber + l_quantity, 40) - greatest(l_linenumber, 0), 0) * greatest(least(l_quantity, 60), 0)) / 2400.0 AS c FROM lineitem GROUP BY 1)
"""


def page_limit(spark, sf):
    turns = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"))
    return first_pages(turns, 3)


_LIMIT_SQL = "SELECT l_orderkey AS doc, l_linenumber AS page FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 3"


def cache_lookup(spark, sf):
    d = table(spark, sf, "documents")
    jobs = d.select("doc_id", cache_key(F.col("lang"), F.lit("Table Recognition:"), F.col("text")).alias("key"))
    cache = d.where("doc_id % 3 = 0").select(cache_key(F.col("lang"), F.lit("Table Recognition:"), F.col("text")).alias("key"), F.col("text").alias("text"))
    hits, misses = with_cache(jobs, cache)
    return hits.select("key", F.lit(True).alias("known")).unionByName(misses.select("key", F.lit(False).alias("known"))).groupBy("key", "known").agg(F.count("*").alias("jobs"))


_CACHE_SQL = """
WITH j AS (SELECT doc_id, sha256(lang || chr(0) || 'Table Recognition:' || chr(0) || text) AS key FROM documents), c AS (SELECT DISTINCT key FROM j WHERE doc_id % 3 = 0)
SELECT j.key, c.key IS NOT NULL AS known, CASE WHEN c.key IS NULL THEN 1 ELSE count(*) END AS jobs FROM j LEFT JOIN c ON j.key = c.key GROUP BY j.key, c.key
"""

_TURN_SQL = "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1"
_MESSAGE_SQL = "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'user'), '') AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1"
_TRANSCRIPT_SQL = "SELECT conv_id AS doc, 'File: \"talk-' || conv_id || '\"' || chr(10) || chr(10) || string_agg('--- Page ' || (turn + 1) || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"
_HEADINGS_SQL = """
SELECT conv_id AS doc, string_agg(CASE WHEN c > 1 THEN '## Page ' || i || chr(10) || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY i) AS text
FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations WHERE text IS NOT NULL) GROUP BY 1
"""

ALL = {
    "last_user_turn": (last_user_turn, _TURN_SQL), "message_text": (message_text, _MESSAGE_SQL), "transcript": (transcript, _TRANSCRIPT_SQL), "page_headings": (page_headings, _HEADINGS_SQL),
    "page_hints": (page_hints, _HINT_SQL), "page_select": (page_select, _SELECT_SQL), "task_prompt": (task_prompt, _PROMPT_SQL), "column_kind": (column_kinds, _KIND_SQL),
    "parse_template": (template_of, _TEMPLATE_SQL), "route": (route, _ROUTE_SQL), "has_files": (has_files, _FILES_SQL), "recognition_jobs": (recognition_jobs, _JOBS_SQL),
    "rewrite_parts": (rewrite_parts, _REWRITE_SQL), "file_payload": (file_payloads, _PAYLOAD_SQL), "splice_pages": (splice_pages, _SPLICE_SQL), "vision_join": (vision_join, _VISION_SQL),
    "catalogue_union": (catalogue_union, _CATALOGUE_SQL), "tag_union": (tag_union, _TAG_SQL), "ocr_models": (ocr_models, _OCR_SQL), "forward_headers": (forward_headers, _HEADERS_SQL),
    "scan_coverage": (scan_coverage, _SCAN_SQL), "page_limit": (page_limit, _LIMIT_SQL), "cache_lookup": (cache_lookup, _CACHE_SQL),
}
