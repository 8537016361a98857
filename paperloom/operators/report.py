"""The five-section text report of an extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.records import let
from ..functions.text import NOT_DETECTED, looks_like_table_line, non_blank, normalize_scalar, strip, title_case

#: Report fields by section: key, label (fixed values).
HEADER = (("vendor_name", "Company Name"), ("invoice_number", "Invoice Number"), ("invoice_date", "Invoice Date"), ("phone_number", "Phone Number"))
BODY = (("bill_to", "Bill To"), ("customer_name", "Customer Name"), ("address", "Address"), ("gst_number", "GST Number"))
FOOTER = (("subtotal", "Subtotal"), ("tax_amount", "Tax"), ("total_amount", "Grand Total"), ("payment_mode", "Payment Mode"))

#: Other names of report keys, in order (fixed values).
RENAMED = (
    ("company_name", "vendor_name"),
    ("supplier_name", "vendor_name"),
    ("invoice_no", "invoice_number"),
    ("date", "invoice_date"),
    ("invoice_total", "total_amount"),
    ("grand_total", "total_amount"),
    ("tax", "tax_amount"),
    ("billing_address", "address"),
)

#: Keys that are looked up in a section's lines where the data lack them, by words of the line (fixed values).
LABELLED = {"gst_number": ("gst",), "payment_mode": ("payment", "upi", "cash", "card"), "subtotal": ("subtotal",), "bill_to": ("bill to",)}

BARE_HEADERS = ("item", "description", "qty", "amount")

REGIONS = "array<struct<section:string,description:string,content_lines:array<string>>>"
BLOCKS = "array<struct<block_type:string,content_text:string,content_lines:array<string>>>"


def normalize_data(data: Column | str) -> Column:
    """A map of texts with lower-case keys and normal values, and missing report keys filled from their other names."""
    pairs = F.transform(F.map_entries(data), lambda e: F.struct(F.lower(strip(e["key"])).alias("k"), normalize_scalar(e["value"]).alias("v")))

    def last_of_each(pairs: Column) -> Column:
        def of(names: Column) -> Column:
            return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda e: e["k"] == n), -1)["v"]))

        return let(F.array_distinct(F.transform(pairs, lambda e: e["k"])), of)

    renamed = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in RENAMED))

    def rename(out: Column, pair: Column) -> Column:
        lacks = ~F.map_contains_key(out, pair["b"]) & F.map_contains_key(out, pair["a"])
        return F.when(lacks, F.map_concat(out, F.map_from_arrays(F.array(pair["b"]), F.array(F.try_element_at(out, pair["a"]))))).otherwise(out)

    return F.aggregate(renamed, let(pairs, last_of_each), rename)


def find_region(regions: Column | str, section: str) -> Column:
    return F.get(F.filter(regions, lambda r: F.lower(r["section"]) == section), F.lit(0))


def find_block(blocks: Column | str, kind: str) -> Column:
    return F.get(F.filter(blocks, lambda b: F.lower(b["block_type"]) == kind), F.lit(0))


def last_region(regions: Column | str, section: str) -> Column:
    return F.element_at(F.filter(regions, lambda r: F.lower(r["section"]) == section), -1)


def labeled_value(lines: Column | str, words: tuple[str, ...]) -> Column:
    """The first value in lines that hold one of the words: what follows a colon, or all words after the first."""

    def rest(line: Column) -> Column:
        tokens = F.filter(F.split(line, r"(?U)\s+"), lambda t: t != "")
        return let(tokens, lambda t: F.when(F.size(t) > 1, normalize_scalar(F.array_join(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), " "))))

    def value(line: Column) -> Column:
        after = F.when(F.contains(line, F.lit(":")), normalize_scalar(F.substring(line, F.locate(":", line) + 1, F.length(line))))
        return F.coalesce(F.nullif(after, F.lit(NOT_DETECTED)), F.nullif(rest(line), F.lit(NOT_DETECTED)))

    def holds(line: Column) -> Column:
        low = F.lower(line)
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    found = F.filter(F.transform(F.filter(lines, holds), value), lambda v: v.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(NOT_DETECTED))


def section_value(data: Column, lines: Column, key: str) -> Column:
    value = F.nullif(F.try_element_at(data, F.lit(key)), F.lit(NOT_DETECTED))
    return F.coalesce(value, labeled_value(lines, LABELLED[key]) if key in LABELLED else F.lit(NOT_DETECTED))


def item_lines(data: Column, lines: Column) -> Column:
    rows = F.array_distinct(F.filter(lines, lambda x: looks_like_table_line(x) & ~F.lower(x).isin(*BARE_HEADERS)))
    return let(rows, lambda r: _item_lines(data, r))


def _item_lines(data: Column, rows: Column) -> Column:
    numbered = F.transform(rows, lambda x, i: F.concat(F.lit("Item "), (i + 1).cast("string"), F.lit(": "), x))
    total = F.coalesce(F.try_element_at(data, F.lit("total_amount")), F.lit(NOT_DETECTED))
    only = F.when(total != NOT_DETECTED, F.concat(F.lit("Item 1 : Amount summary only | Amount: "), total)).otherwise(f"Item 1 : {NOT_DETECTED}")
    return F.when(F.size(rows) > 0, numbered).otherwise(F.array(only))


def _labeled(pairs: list[tuple[str, Column]]) -> list[Column]:
    width = max(len(label) for label, _ in pairs)
    return [F.concat(F.lit(f"{label:<{width}} : "), normalize_scalar(value)) for label, value in pairs]


def structured_report(file_name: Column | str, document_type: Column | str, data: Column | str, regions: Column | str, blocks: Column | str) -> Column:
    """The whole report as one text."""
    none = F.array().cast("array<string>")

    def lines_of(part: Column) -> Column:
        return F.coalesce(non_blank(part["content_lines"]), none)

    lines = F.struct(*(lines_of(find_region(regions, s)).alias(s) for s in ("header", "body", "footer")), lines_of(find_block(blocks, "table_region")).alias("table"))
    return let(normalize_data(data), lambda d: let(lines, lambda x: _report(file_name, document_type, d, x, regions, blocks)))


def _report(file_name, document_type, data: Column, lines: Column, regions, blocks) -> Column:
    head, body, foot = (lines[s] for s in ("header", "body", "footer"))

    def section(fields, lines):
        return _labeled([(label, section_value(data, lines, key)) for key, label in fields])

    last_table = F.element_at(F.filter(blocks, lambda b: F.lower(b["block_type"]) == "table_region"), -1)
    shown = F.when(F.coalesce(last_table["content_text"], F.lit("")) != "", "Item-wise purchase details detected").otherwise(NOT_DETECTED)
    position = _labeled([(s.title(), last_region(regions, s)["description"]) if s != "table" else ("Table", shown) for s in ("header", "body", "table", "footer")])
    items = F.array_join(item_lines(data, lines["table"]), "\n")
    out = [F.lit("DOCUMENT ANALYSIS REPORT"), F.lit("=" * 24), F.lit("")]
    out += [F.concat(F.lit("File Name      : "), normalize_scalar(file_name)), F.concat(F.lit("Document Type  : "), title_case(document_type))]
    for title, rows in (
        ("1. HEADER SECTION", section(HEADER, head)),
        ("2. BODY SECTION", section(BODY, body)),
        ("3. TABULAR CONTENT", [items]),
        ("4. FOOTER SECTION", section(FOOTER, foot)),
        ("5. POSITION SUMMARY", position),
    ):
        rule = {"1": 17, "2": 15, "3": 18, "4": 17, "5": 19}[title[0]]
        out += [F.lit(""), F.lit(title), F.lit("-" * rule), *rows]
    return F.concat(strip(F.concat_ws("\n", *out)), F.lit("\n"))
