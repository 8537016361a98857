"""Text normalisation as column expressions.

White space is Unicode white space, as ``(?U)\\s``; Spark's own trim would strip only U+0020.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_DETECTED = "Not Detected"
MISSING_WORDS = ("not found", "none", "null", "n/a", "na")

#: Line breaks of a full split into lines (fixed values): CR LF, LF, CR, VT, FF, U+001C to U+001E, U+0085, U+2028, U+2029.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"

#: Words that mark a line as part of a table (fixed values).
TABLE_WORDS = ("qty", "quantity", "amount", "rate", "price", "description", "item", "total")

#: Languages that a scan may name, and the script that each is written in, by its name in the Unicode standard (fixed keys).
SCRIPTS = {
    "bengali": "Bengali",
    "english": "Latin",
    "gujarati": "Gujarati",
    "hindi": "Devanagari",
    "kannada": "Kannada",
    "malayalam": "Malayalam",
    "marathi": "Devanagari",
    "odia": "Oriya",
    "punjabi": "Gurmukhi",
    "tamil": "Tamil",
    "telugu": "Telugu",
    "urdu": "Arabic",
}
MIXED = "mixed"


def _rule(language: str) -> str:
    """What a prompt says about a language: nothing of the model's own."""
    script = SCRIPTS[language]
    if script == "Latin":
        return ""
    first, last = ("right", "left") if script == "Arabic" else ("left", "right")
    return f"Transcribe {language.title()} in Unicode's {script} block, reading each line from {first} to {last}."


#: Prompt rule of each language.
LANGUAGE_RULES = {language: _rule(language) for language in SCRIPTS} | {MIXED: "Name the language of each part that is not in the page's main one."}


#: Characters with the Unicode property White_Space.
_BLANKS = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, however many later columns take parts of it.

    A plain projection would be merged with those that read it, and a value made by lambda functions computed again for each of them.
    """
    return df.drop(name).select("*", F.inline(F.array(F.struct(value.alias(name)))))


def strip(value: Column | str) -> Column:
    return F.btrim(value, F.lit(_BLANKS))


def has_more_than_blanks(value: Column) -> Column:
    return value.rlike(f"[^{_BLANKS}]")


def split_lines(value: Column | str) -> Column:
    """All lines of a text, without a last empty one."""
    lines = F.split(value, LINE_BREAK, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def non_blank(lines: Column | str) -> Column:
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def normalize_key(key: Column | str) -> Column:
    """Lower case, stripped, blanks and hyphens as underscores, no full stops."""
    out = strip(F.lower(key))
    for old, new in ((" ", "_"), ("-", "_"), (".", "")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def normalize_scalar(value: Column | str) -> Column:
    """A text with single blanks and without blanks and colons at its ends, or the mark for missing values."""
    clean = F.btrim(F.regexp_replace(F.col(value) if isinstance(value, str) else value, r"(?U)\s+", " "), F.lit(" :"))
    return let(clean, lambda c: F.when(c.isNull() | (c == "") | F.lower(c).isin(*MISSING_WORDS), NOT_DETECTED).otherwise(c))


def title_case(value: Column | str) -> Column:
    clean = normalize_scalar(value)
    words = F.filter(F.split(F.replace(clean, F.lit("_"), F.lit(" ")), r"(?U)\s+"), lambda w: w != "")
    return F.when(clean == NOT_DETECTED, clean).otherwise(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2_000_000_000)))), " "))


def safe_name(value: Column | str) -> Column:
    """A file name: anything but letters, digits, hyphens and underscores is an underscore."""
    clean = F.regexp_replace(strip(value), r"[^\p{L}\p{N}_\-]", "_")
    return F.when(clean == "", "document").otherwise(clean)


def has_unread_script(value: Column | str) -> Column:
    """Whether a text has Bengali or Gujarati characters."""
    value = F.col(value) if isinstance(value, str) else value
    return value.rlike(r"[\x{0980}-\x{09FF}\x{0A80}-\x{0AFF}]")


def looks_like_table_line(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.lower(value).rlike("|".join(TABLE_WORDS)) | value.rlike(r"\p{Nd}")


def is_upload(name: Column | str) -> Column:
    """Whether a file name has an extension that can be uploaded."""
    name = F.col(name) if isinstance(name, str) else name
    return name.rlike(r"(?i)\.(jpe?g|png|bmp|tiff?|pdf)$")


def display_value(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNull() | value.isin("", "Not found", "null", "—"), "Not detected").otherwise(value)


def language_word(reply: Column | str) -> Column:
    """The language that a scan reply names: its first word's letters, or ``mixed``."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    word = F.regexp_replace(F.get(F.split(strip(F.lower(reply)), r"(?U)\s+"), F.lit(0)), "[^a-z]", "")
    return F.when(word.isin(*LANGUAGE_RULES), word).otherwise(MIXED)


def language_rule(language: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_RULES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.col(language) if isinstance(language, str) else language), F.lit(""))


def model_for(language: Column | str) -> Column:
    language = F.col(language) if isinstance(language, str) else language
    return F.when(language == "english", "qwen").otherwise("minicpm")


def csv_list(value: Column | str, default: list[str]) -> Column:
    """The items of a comma-separated setting; the default where it is blank."""
    items = F.filter(F.transform(F.split(value, ","), strip), lambda x: x != "")
    return F.when(F.coalesce(strip(value), F.lit("")) == "", F.array(*(F.lit(x) for x in default))).otherwise(items)


def truthy_setting(value: Column | str, default: bool) -> Column:
    return F.coalesce(F.lower(strip(value)).isin("1", "true", "yes", "on"), F.lit(default))


def alphabet_hint(language: Column | str, content: Column | str) -> Column:
    """The script reference of an alphabet file: lines of its standard section up to a blank line or heading, 150 characters at most."""
    lines = F.transform(split_lines(content), strip)

    def step(state: Column, line: Column) -> Column:
        heading = F.contains(line, F.lit("=== STANDARD ALPHABETS ==="))
        on = heading | (state["on"] & ~line.startswith("===") & (line != ""))
        take = state["on"] & ~heading & on & ~line.startswith("#")
        return F.struct(on.alias("on"), F.when(take, F.concat(state["out"], F.array(line))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"))
    letters = F.substring(F.array_join(F.aggregate(lines, start, step, lambda s: s["out"]), " "), 1, 150)
    return F.concat(F.lit("[Script Reference: "), F.initcap(language), F.lit("]\nAlphabets: "), letters, F.lit("\n"))
