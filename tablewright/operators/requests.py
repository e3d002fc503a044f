"""Chat requests: parsing, parts, page hints, task prompts, routing, rewriting.

A request is a JSON text. Its parts stay one column of arrays, so that most of
this is expressions over a row, without joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.config import Settings
from tablewright.functions.text import number, strip
from tablewright.schema import PART

# The tasks that a recognition model knows.
TASKS = ("Text Recognition:", "Table Recognition:", "Formula Recognition:")
def parse_request(body: Column) -> Column:
    """A request as struct<ok, model, stream, include_usage, messages>.

    A message's content is a text, or a list of parts: a list gives parts, a
    text content; the other is null. Bad JSON gives ok = false.
    """
    v = F.try_parse_json(body)

    def message(m: Column) -> Column:
        content = F.try_variant_get(m, "$.content", "variant")
        listed = F.coalesce(F.startswith(F.schema_of_variant(content), F.lit("ARRAY")), F.lit(False))
        return F.struct(
            F.try_variant_get(m, "$.role", "string").alias("role"),
            F.when(~listed, F.try_variant_get(content, "$", "string")).alias("content"),
            F.when(listed, F.try_variant_get(content, "$", f"array<{PART}>")).alias("parts"))

    return F.struct(
        v.isNotNull().alias("ok"), F.coalesce(F.try_variant_get(v, "$.model", "string"), F.lit("")).alias("model"),
        F.coalesce(F.try_variant_get(v, "$.stream", "boolean"), F.lit(False)).alias("stream"),
        F.coalesce(F.try_variant_get(v, "$.stream_options.include_usage", "boolean"), F.lit(False)).alias("include_usage"),
        F.transform(F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.array().cast("array<variant>")), message).alias("messages"))


# ------------------------------------------------------------------ models

def base_model(model: Column) -> Column:
    return F.substring_index(model, ":", 1)


def is_ocr_model(model: Column, settings: Settings = Settings()) -> Column:
    return base_model(model).isin(*settings.ocr_models) if settings.ocr_models else F.lit(False)


def with_vision(requests: DataFrame, capabilities: DataFrame, model: str = "model") -> DataFrame:
    """Adds ``vision``: whether the model's capabilities hold vision (unknown models: not).

    ``capabilities`` (model, capabilities array) has a row a model. Rows that
    repeat a model are united, so requests are never multiplied.
    """
    known = capabilities.groupBy(F.col("model").alias("__m")).agg(F.max(F.array_contains("capabilities", "vision")).alias("__v"))
    return requests.join(known, F.col(model) == F.col("__m"), "left").withColumn("vision", F.coalesce("__v", F.lit(False))).drop("__m", "__v")


# ------------------------------------------------------------------ parts

def data_url_mime(url: Column) -> Column:
    head = F.substring_index(url, ",", 1)
    return F.substring_index(F.regexp_replace(head, "^data:", ""), ";", 1)


def data_url_bytes(url: Column) -> Column:
    """The bytes of a data URL; null if they are not base64."""
    return F.try_to_binary(F.regexp_extract(url, "(?s)^[^,]*,(.*)$", 1), F.lit("base64"))


def to_data_url(mime: Column, data: Column) -> Column:
    """Needs spark.sql.chunkBase64String.enabled=false, else lines are broken after 76 characters."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"\s", ""))


def _if_inline(part: Column, value: Column) -> Column:
    return F.when((part["type"] == "file") & F.startswith(part["file"]["file_data"], F.lit("data:")), value)


def file_name(part: Column) -> Column:
    """The name of a file part with inline data, or null; nothing is decoded."""
    return _if_inline(part, F.coalesce(F.nullif(part["file"]["filename"], F.lit("")), F.lit("document")))


def file_mime(part: Column) -> Column:
    """The type of a file part with inline data, or null; nothing is decoded."""
    return _if_inline(part, data_url_mime(part["file"]["file_data"]))


def file_payload(part: Column) -> Column:
    """struct<name, mime, data> of a file part with inline data, or null."""
    data = data_url_bytes(part["file"]["file_data"])
    return _if_inline(part, F.struct(file_name(part).alias("name"), file_mime(part).alias("mime"), data.alias("data")))


def file_text(name: Column, data: Column) -> Column:
    """A text file as a part's text; bad UTF-8 becomes replacement characters."""
    return F.concat(F.lit('File: "'), name, F.lit('"\n\n'), F.make_valid_utf8(data.cast("string")))


def message_text(parts: Column) -> Column:
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def file_stem(name: Column) -> Column:
    """A file name without folders and its last suffix; a leading dot is no suffix."""
    base = F.regexp_replace(F.regexp_replace(name, "/+$", ""), "^.*/", "")
    return F.regexp_replace(base, r"^(.+)\.[^.]+$", "$1")


def has_files(messages: Column) -> Column:
    return F.exists(messages, lambda m: F.coalesce(F.exists(m["parts"], lambda p: p["type"] == "file"), F.lit(False)))


def last_user_parts(messages: Column) -> Column:
    """Parts of the last user message; null if there is none or its content is a text."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    return F.get(users, F.size(users) - 1)["parts"]


def last_user_turn(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The last user turn of every conversation that has one: (conv, turn, text)."""
    return turns.where(F.col(role) == "user").groupBy(conv).agg(F.max(turn).alias(turn), F.max_by(text, turn).alias(text))


# ------------------------------------------------------------------ hints

def requested_pages(text: Column) -> Column:
    """Pages that a text asks for, as an array of numbers; null if it names none.

    "first page" comes before a range, and the first range before single pages.
    A reversed range asks for no page (an empty array).
    """
    t = F.lower(text)
    span = r"(?U)(\d+)\s*[-~〜～]\s*(\d+)\s*ページ|pages?\s*(\d+)\s*-\s*(\d+)"
    single = r"(?U)(\d+)\s*ページ目|\bpage\s*(\d+)"

    def group(pattern: str, *which: int) -> Column:
        return number(F.coalesce(*[F.nullif(F.regexp_extract(t, pattern, k), F.lit("")) for k in which]))

    a, b = group(span, 1, 3), group(span, 2, 4)
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(single), F.lit(1)).alias("x"), F.regexp_extract_all(t, F.lit(single), F.lit(2)).alias("y"))
    singles = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: number(F.coalesce(F.nullif(p["x"], F.lit("")), p["y"])))))
    none = F.array().cast("array<bigint>")
    return (
        F.when(t.rlike(r"(?U)\bfirst page\b|最初のページ|1枚目"), F.array(F.lit(1).cast("long")))
        .when(t.rlike(span), F.when(a <= b, F.sequence(F.least(a, b), b)).otherwise(none))
        .when(F.size(singles) > 0, singles))


def task_prompt(text: Column) -> Column:
    """The recognition task of a text: one it begins with, else by its words."""
    s = strip(text)
    out = F.when(F.lower(s).rlike("table|表"), F.lit(TASKS[1])).when(F.lower(s).rlike("formula|equation|latex|数式"), F.lit(TASKS[2])).otherwise(F.lit(TASKS[0]))
    for task in reversed(TASKS):
        out = F.when(F.startswith(s, F.lit(task)), F.lit(task)).otherwise(out)
    return out


# ------------------------------------------------------------------ jobs and routes

def recognition_jobs(requests: DataFrame, *, key: str = "doc", messages: str = "messages") -> DataFrame:
    """A row for every image, and for every PDF, of the last user turn's parts.

    Columns: key, ord, kind ('pdf' or 'image'), url (of an image), data (of a
    PDF), pages (asked for), prompt, source (stem of the last file, or 'ocr').
    PDFs become page images through a page source (``sources.pages``).
    """
    parts = last_user_parts(F.col(messages))
    text = message_text(F.col("parts"))
    base = requests.select(key, parts.alias("parts")).where("parts is not null")
    base = base.select(key, "parts", requested_pages(text).alias("pages"), task_prompt(text).alias("prompt"))
    stems = F.filter(F.transform("parts", lambda p: file_stem(file_name(p))), lambda s: F.coalesce(s != "", F.lit(False)))
    base = base.withColumn("source", F.coalesce(F.get(stems, F.size(stems) - 1), F.lit("ocr")))
    rows = base.select(key, "pages", "prompt", "source", F.posexplode("parts").alias("ord", "part")).withColumn("payload", file_payload(F.col("part")))
    mime = F.col("payload.mime")
    kind = F.when(mime == "application/pdf", "pdf").when(F.startswith(mime, F.lit("image/")), "image").when(F.col("part.type") == "image_url", "image")
    url = F.when(F.startswith(mime, F.lit("image/")), to_data_url(mime, F.col("payload.data"))).when(F.col("part.type") == "image_url", F.col("part.image_url.url"))
    return rows.withColumn("kind", kind).where("kind is not null").select(key, "ord", "kind", url.alias("url"), F.when(F.col("kind") == "pdf", F.col("payload.data")).alias("data"), "pages", "prompt", "source")


def has_jobs(messages: Column) -> Column:
    def one(p: Column) -> Column:
        mime = file_mime(p)
        return (p["type"] == "image_url") | F.coalesce((mime == "application/pdf") | F.startswith(mime, F.lit("image/")), F.lit(False))

    return F.coalesce(F.exists(last_user_parts(messages), one), F.lit(False))


def route(request: Column, settings: Settings = Settings()) -> Column:
    """'pass', 'reject', 'format', 'ocr' or 'rewrite' for a parsed request."""
    workflow = request["model"] == settings.format_model_name
    model = F.when(workflow, F.lit(settings.format_llm)).otherwise(request["model"])
    jobs = has_jobs(request["messages"])
    rest = F.when(is_ocr_model(model, settings) & jobs, F.lit("ocr")).when(has_files(request["messages"]), F.lit("rewrite")).otherwise(F.lit("pass"))
    return (
        F.when(~request["ok"], F.lit("pass"))
        .when(workflow & F.lit(not settings.format_llm), F.lit("reject"))
        .when(workflow & jobs, F.lit("format"))
        .otherwise(rest))


def routed_model(request: Column, settings: Settings = Settings()) -> Column:
    """The model that answers: the workflow's follow-up turns go to its language model."""
    return F.when(request["model"] == settings.format_model_name, F.lit(settings.format_llm)).otherwise(request["model"])


def rewrite_parts(parts: Column) -> Column:
    """Image and text files as image and text parts, in place; PDFs wait for their pages.

    A PDF stays a file part: ``splice_pages`` puts page images or text there.
    """
    def one(p: Column) -> Column:
        f = file_payload(p)
        image = F.startswith(f["mime"], F.lit("image/"))
        empty = F.lit(None)

        def part(kind: str, text: Column, url: Column) -> Column:
            return F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), F.when(url.isNotNull(), F.struct(url.cast("string").alias("url"))).alias("image_url"), empty.cast("struct<filename:string,file_data:string>").alias("file"))

        return (
            F.when(f.isNull() | (f["mime"] == "application/pdf"), p)
            .when(image, part("image_url", empty, to_data_url(f["mime"], f["data"])))
            .otherwise(part("text", file_text(f["name"], f["data"]), empty.cast("string"))))

    return F.transform(parts, one)


def splice_pages(parts: Column, pages: Column, text: Column, vision: Column) -> Column:
    """PDF parts replaced by page images (an array, for vision models) or one text part."""
    def one(p: Column) -> Column:
        pdf = F.coalesce(file_payload(p)["mime"] == "application/pdf", F.lit(False))
        none = F.lit(None).cast("struct<filename:string,file_data:string>")
        images = F.transform(pages, lambda u: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(u.alias("url")).alias("image_url"), none.alias("file")))
        said = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url"), none.alias("file")))
        return F.when(~pdf, F.array(p)).when(vision, images).otherwise(said)

    return F.flatten(F.transform(parts, one))


# Headers that belong to one connection only.
HOP_HEADERS = ("host", "content-length", "connection", "accept-encoding", "transfer-encoding")


def forward_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*HOP_HEADERS))
