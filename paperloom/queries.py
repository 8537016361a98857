"""Registered queries over the engine's own operators; their SQL counterparts are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.records import hide_private
from .operators import clean, lookups, parse, report, segments, template
from .operators.rules import FIELDS
from .oracles import ORACLE_SQL
from .plans import extraction
from .plans.extraction import results
from .plans.predicates import compile_filter
from .sources import scratch, store
from .sources.files import deal, spread
from .sources.replies import prompt
from .streaming.results import file_stream, stream_results
from .streaming.uploads import run_uploads

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spread(_table(spark, sf_dir, name).select(*columns))


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def invoice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One free-form JSON record per order; the number of lines is a JSON number, 0 for orders without lines."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    names = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    joined = deal(orders.join(names, "o_custkey").join(lines, "o_orderkey", "left"), "o_orderkey", orders.count())
    record = F.to_json(
        F.struct(
            F.col("c_name").alias("Customer"),
            F.col("o_orderkey").cast("string").alias("Bill No"),
            _day("o_orderdate").alias("Date"),
            F.col("o_orderstatus").alias("Status"),
            F.coalesce("n", F.lit(0)).alias("Line-Items"),
            _money("o_totalprice").alias("Grand Total"),
        )
    )
    return joined.select("o_orderkey", record.alias("record"))


@_query
def template_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: free-form order records mapped onto the invoice template by alias rules."""
    mapped = template.map_to_template(invoice_records(spark, sf_dir))
    return mapped.select("o_orderkey", *(F.col(f"template.{f}").alias(f) for f, *_ in FIELDS), "template._template_version")


@_query
def template_matched_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = template.map_to_template(invoice_records(spark, sf_dir))
    return mapped.select("o_orderkey", template.matched_count().alias("matched"))


@_query
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = template.map_to_template(invoice_records(spark, sf_dir))
    return mapped.select("o_orderkey", template.render().alias("shown"))


@_query
def template_label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels found in running text."""
    docs = _spread(spark, sf_dir, "documents", "doc_id", "text")
    rules = {f: a for f, _, _, a in FIELDS}
    return docs.select("doc_id", *(F.coalesce(template.find_label("text", (*rules[f], f)), F.lit("")).alias(f) for f in ("vendor_name", "vendor_gstin", "invoice_date", "buyer_name")))


@_query
def markdown_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines rendered as a pipe table and parsed back."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").cast("string").alias("q"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "q")))
    body = F.transform(rows, lambda r: F.concat(F.lit("| "), r["l_partkey"].cast("string"), F.lit(" | "), r["q"], F.lit(" |")))
    tables = lines.groupBy("l_orderkey").agg(F.concat(F.lit("Lines\n| Part | Qty |\n|---|---|\n"), F.array_join(body, "\n")).alias("text"))
    items = tables.select("l_orderkey", F.posexplode(template.table_items("text")).alias("row", "item"))
    return items.select("l_orderkey", F.col("row").cast("int").alias("row"), F.try_element_at("item", F.lit("part")).alias("part"), F.try_element_at("item", F.lit("qty")).alias("qty"))


@_query
def envelope_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as plain JSON, fenced, within prose, and without JSON."""
    kind = F.col("event_id") % 4
    reply = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("note "), F.col("props"), F.lit(" end")))
        .otherwise(F.concat(F.lit("  no reply for "), F.col("event_type"), F.lit(" ")))
    )
    return T.with_once(_table(spark, sf_dir, "events").select("event_id", reply.alias("reply")), "e", parse.envelope("reply")).select("event_id", "e.*")


@_query
def odd_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with equal keys, with a list for an object, with an error, without text and with a blank key, as extraction results."""
    kind, number = F.col("event_id") % 5, F.col("event_id").cast("string")
    reply = (
        F.when(kind == 0, F.concat(F.lit('{"native_json": {"a": '), number, F.lit(', "b": null, "a": "'), F.col("event_type"), F.lit('"}}')))
        .when(kind == 1, F.concat(F.lit('{"native_json": ['), number, F.lit("]}")))
        .when(kind == 2, F.concat(F.lit("ERROR: "), F.col("event_type")))
        .when(kind == 3, F.lit(""))
        .otherwise(F.concat(F.lit('{"native_json": {" ": '), number, F.lit(', "metadata": 1}, "metadata": {"k": "'), F.col("event_type"), F.lit('"}}')))
    )
    rows = _table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return T.with_once(rows.withColumn("x", parse.extraction("reply")), "y", F.col("x")).select("event_id", "y.fields", "y.is_invoice", "y._source")


@_query
def reply_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded replies of two segments per order taken to whole results."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").filter("o_orderkey is not null")
    # dealt by the key of the results, which the segments of a result are then combined by without another exchange
    replies = deal(orders, "o_orderkey", 2 * orders.count()).select("o_orderkey", "o_orderstatus", _money("o_totalprice").alias("t"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seg_idx"))
    body = F.struct(
        F.struct(F.lit("Invoice").alias("classification"), F.lit("english").alias("detected_language")).alias("metadata"),
        F.struct(F.col("o_orderstatus").alias("Remarks"), F.col("t").alias("Total")).alias("native_json"),
        F.concat(F.lit("part "), F.col("seg_idx").cast("string")).alias("native_layout_text"),
        F.lit("twin").alias("english_layout_text"),
    )
    out = results(replies.select("o_orderkey", "seg_idx", F.to_json(body).alias("reply")), ("o_orderkey",))
    return out.select("o_orderkey", "status", "vlm_output", "digital_twin_content", "vlm_source", "metadata.segments_processed", "metadata.dominant_language", "template_fields.total_amount", "template_fields.notes")


@_query
def repetition_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(spark, sf_dir, "documents", "doc_id", "text")
    counted = T.with_once(docs, "r", clean.repetition("text"))
    return counted.select("doc_id", "r.n_words", "r.top_count", (F.col("r.emptied") | (F.col("text") == "")).alias("emptied"))


@_query
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines equal to the one before."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", clean.dedup_markdown("text").alias("t"))
    return docs.select("doc_id", F.size(F.split("t", "\n", -1)).alias("n_lines"), F.md5("t").alias("text_md5"))


@_query
def table_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables of order lines without repeated rows."""
    lines = _table(spark, sf_dir, "lineitem")
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")))
    body = F.transform(rows, lambda r: F.concat(F.lit("| "), r["l_returnflag"], F.lit(" | "), r["l_linestatus"], F.lit(" |")))
    tables = lines.groupBy("l_orderkey").agg(F.concat(F.lit("| flag | state |\n|---|---|\n"), F.array_join(body, "\n")).alias("text"))
    return tables.select("l_orderkey", clean.dedup_markdown("text").alias("text"))


@_query
def script_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("ক"))).when(F.col("doc_id") % 10 == 1, F.concat(F.lit("ગ"), "text")).otherwise(F.col("text")).alias("t"))
    return docs.select("doc_id", T.has_unread_script("t").alias("unread"))


def _odd_values(kind: Column, name: str) -> Column:
    return (
        F.when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, "")
        .when(kind == 2, " : ")
        .when(kind == 3, "N/A")
        .when(kind == 4, F.concat(F.lit("  "), F.col(name), F.lit("\t  x: ")))
        .when(kind == 5, "Not  Found")
        .otherwise(F.col(name))
    )


@_query
def scalar_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", T.normalize_scalar(_odd_values(F.col("c_custkey") % 7, "c_name")).alias("value"), T.title_case(F.concat(F.col("c_mktsegment"), F.lit("_tax  INVOICE"))).alias("title"))


@_query
def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select("p_partkey", T.normalize_key(F.concat(F.lit(" "), F.col("p_name"), F.lit("-No. "))).alias("nk"), T.display_value(F.when(F.col("p_partkey") % 3 == 0, "Not found").when(F.col("p_partkey") % 3 == 1, F.col("p_type"))).alias("shown"))


@_query
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    data = F.create_map(F.lit("Company_Name"), F.col("c_name"), F.lit("invoice_no"), F.col("o_orderkey").cast("string"), F.lit("date"), _day("o_orderdate"), F.lit("grand_total"), _money("o_totalprice"), F.lit("tax"), F.lit("n/a"))
    regions = F.array(
        F.struct(F.lit("Header").alias("section"), F.lit("top of  page").alias("description"), F.array(F.lit(" a ")).alias("content_lines")),
        F.struct(F.lit("body").alias("section"), F.lit(None).cast("string").alias("description"), F.array(F.lit("GST No: 27X"), F.lit("Bill To Asha")).alias("content_lines")),
        F.struct(F.lit("footer").alias("section"), F.lit("end").alias("description"), F.array(F.concat(F.lit("Payment: "), F.col("o_orderpriority"))).alias("content_lines")),
    )
    blocks = F.array(F.struct(F.lit("table_region").alias("block_type"), F.lit("x").alias("content_text"), F.array(F.lit("Item"), F.concat(F.lit("Pen "), F.col("o_custkey").cast("string")), F.lit(" plain ")).alias("content_lines")))
    text = report.structured_report(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")), F.lit("tax_invoice"), data, regions, blocks)
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return deal(joined, "o_orderkey", orders.count()).select("o_orderkey", text.alias("report"))


@_query
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", T.safe_name("url").alias("name"))


@_query
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.get(F.array(*(F.lit(x) for x in (".JPG", ".jpeg", ".tif", ".pdf", ".txt", ""))), (F.col("page_id") % 6).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", F.concat("url", ending).alias("name")).filter(T.is_upload("name"))


@_query
def segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").withColumn("said", F.when(F.col("role") != "system", F.col("text")))
    return segments.join_segments(turns, ["conv_id"], "turn", "said")


@_query
def segment_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("last_text"), F.count(F.lit(1)).alias("segments"))


@_query
def segment_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 61 + 100).cast("int").alias("w"), (F.col("p_partkey") % 37 * 83 + 90).cast("int").alias("h"))
    boxed = sized.select("p_partkey", segments.resized("w", "h").alias("r"), F.posexplode(segments.segment_boxes("w", "h")).alias("seg", "b"))
    return boxed.select("p_partkey", F.col("seg").cast("int").alias("seg"), "b.x0", "b.y0", "b.x1", "b.y1", F.col("r.w").alias("new_w"), F.col("r.h").alias("new_h"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    ocr = F.struct(F.array(F.col("o_orderpriority")).alias("texts"), F.lit("x").alias("layout"), F.col("o_orderstatus").alias("summary"))
    return orders.select(F.col("o_orderkey").alias("_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"), ocr.alias("ocr"))


@_query
def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.history(_stored(spark, sf_dir)).select("_id", "created_at", "status", F.col("ocr.summary").alias("summary"))


@_query
def result_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.get_result(_stored(spark, sf_dir), 7).select("_id", "status")


@_query
def result_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_result(_stored(spark, sf_dir), 7).select("_id", "status")


@_query
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.status_summary(_stored(spark, sf_dir))


@_query
def source_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [s for s, *_ in lookups.SOURCES] + ["elsewhere"]
    source = F.get(F.array(*(F.lit(n) for n in names)), (F.col("event_id") % len(names)).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", lookups.source_meta(source).alias("m")).select("event_id", "m.label", "m.tier")


@_query
def hidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("_source"), F.col("event_type"), F.lit("kind"), F.col("event_type")))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(hide_private(fields))), ",").alias("keys"))


@_query
def language_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("lang") == "en", " English, mostly").when(F.col("lang") == "de", "Hindi.").otherwise(F.concat(F.col("lang"), F.lit(" text")))
    language = T.language_word(reply)
    return _table(spark, sf_dir, "documents").select("doc_id", language.alias("language"), T.language_rule(language).alias("rule"), T.model_for(language).alias("model"))


@_query
def name_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"))
    return lookups.without_selected(docs, docs.filter("doc_id < 5")).select("doc_id", "name")


@_query
def clean_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both cleanings on every field of a record."""
    events = _table(spark, sf_dir, "events")
    fields = F.create_map(F.lit("a"), F.repeat(F.concat("event_type", F.lit(" ")), F.lit(6)), F.lit("b"), F.concat_ws("\n", "event_type", "event_type", F.lit("end")))
    cleaned = clean.clean_fields(fields)
    return events.select("event_id", F.try_element_at(cleaned, F.lit("a")).alias("a"), F.try_element_at(cleaned, F.lit("b")).alias("b"))


@_query
def filter_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.extraction import filter_results

    return filter_results(_stored(spark, sf_dir), "status = 'success' and _id % 2 = 0").select("_id", "status")


@_query
def stream_results_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event replies taken through a stream of files; the same rows as in batch."""
    at = scratch.fresh_path(spark, "stream")
    events = _table(spark, sf_dir, "events").select("event_id", "props")
    events.repartition(2).write.parquet(f"{at}/in")
    source = file_stream(spark, f"{at}/in", events.schema)
    query = stream_results(source, lambda df: df.select("event_id", parse.envelope("props")["_source"].alias("source")), f"{at}/out", f"{at}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "source")


@_query
def upload_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads of 25 files a job, taken through the streams: an event per file with its result, and one per job when it is done."""
    docs, at = _table(spark, sf_dir, "documents"), scratch.fresh_path(spark, "uploads")
    reply = F.when(F.col("doc_id") % 7 == 3, F.lit("ERROR: down")).otherwise(
        F.to_json(F.struct(F.struct(F.col("source").alias("Customer"), F.col("doc_id").cast("string").alias("Bill No")).alias("native_json"), F.struct(F.col("lang").alias("detected_language")).alias("metadata")))
    )
    files = docs.select(F.concat(F.lit("job-"), F.floor(F.col("doc_id") / 25)).alias("job_id"), (F.col("doc_id") % 25 + 1).cast("int").alias("idx"), F.concat(F.lit("f"), "doc_id", F.lit(".png")).alias("name"), reply.alias("reply"))
    files.repartition(2).write.parquet(f"{at}/files")
    files.groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("files")).coalesce(1).write.json(f"{at}/manifests")

    def extract(batch: DataFrame) -> DataFrame:
        done = batch.select("job_id", "idx", "name", parse.extraction("reply").alias("x"))
        bill = F.get_json_object("x.fields", "$['Bill No']")
        return done.select("job_id", "idx", "name", F.concat_ws("|", "x._source", F.get_json_object("x.fields", "$.metadata.detected_language"), bill).alias("data"))

    events = run_uploads(spark, file_stream(spark, f"{at}/files", files.schema), f"{at}/manifests", extract, at)
    return events.select("job_id", "event", F.coalesce("idx", F.lit(0)).alias("idx"), "name", "data", F.coalesce("files", F.lit(0)).alias("files"))


@_query
def routed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked for every document after a scan that named its language: the model it goes to, and its prompt."""
    names = F.create_map(*(F.lit(x) for pair in {"en": "English.", "de": "  Urdu\n", "fr": "punjabi, I think"}.items() for x in pair))
    language = T.language_word(F.coalesce(F.try_element_at(names, F.col("lang")), F.col("lang")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", language.alias("language"))
    return docs.select("doc_id", "language", T.model_for("language").alias("model"), F.md5(prompt(F.col("language")).cast("binary")).alias("prompt_md5"))


@_query
def filter_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that meet a condition given as a tree, on fields of structs and maps."""
    orders = _table(spark, sf_dir, "orders")
    found = F.create_map(F.lit("status"), "o_orderstatus", F.lit("total"), F.col("o_totalprice").cast("string"))
    meta = F.struct(F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("day"))
    table = orders.select(F.col("o_orderkey").alias("_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"), found.alias("fields"), meta.alias("metadata"))
    urgent = {"and": [{"field": "status", "op": "=", "value": "success"}, {"field": "metadata.priority", "op": "in", "value": ["1-URGENT", "2-HIGH"]}]}
    cheap = {"and": [{"field": "fields.status", "op": "<>", "value": "O"}, {"not": {"field": "fields.total", "op": ">=", "value": 1000}}, {"field": "metadata.day", "op": "<", "value": "1998-01-01"}]}
    return table.filter(compile_filter({"or": [urgent, cheap]}, table.schema)).select("_id", "status")


@_query
def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of differing fields as typed columns."""
    orders = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    bill = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("B"), "o_orderkey"))
    fields = F.to_json(F.struct(F.col("c_name").alias("Customer"), bill.alias("Bill No"), F.col("o_custkey").alias("Lines"), (F.col("o_orderkey") % 2 == 0).alias("Paid")))
    return extraction.flat_records(orders.select("o_orderkey", fields.alias("fields"), F.lit("local_vlm").alias("_source")))


def _result_table(spark: SparkSession, sf_dir: str) -> store.ResultTable:
    table = store.ResultTable(spark, scratch.fresh_path(spark, "results"), buckets=4)
    table.save(_stored(spark, sf_dir).withColumn("created_at", F.date_trunc("month", "created_at")))
    return table


@_query
def table_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table of results holds after one of them is deleted, and whether it was found, once and again."""
    table = _result_table(spark, sf_dir)
    found, again = table.delete(7), table.delete(7)
    return table.rows().select("_id", "status", F.lit(found).alias("found"), F.lit(again).alias("found_again"))


@_query
def table_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result_table(spark, sf_dir).history().select("_id", "created_at")
