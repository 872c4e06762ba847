"""Column functions over text: cleaning, chunking, n-grams, script conversion.  All but chunk_udf() and the conversions of phrases and JSON stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: White space as Python's str.strip() has it: Java's Unicode class lacks the four information separators.
_BLANK = r"[\s\x1c-\x1f]"
_BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def utrim(c: Column | str) -> Column:
    """Trim Unicode white space at both ends; what lies between isn't looked at, as a pattern would."""
    return F.btrim(c, F.lit(_BLANKS))


def markdown_to_plain(c: Column | str) -> Column:
    """Headers, bold, italic and underscore marks go, blank lines collapse; only a line feed ends a line ((?d))."""
    # The marks that go, in this order.
    c = F.regexp_replace(c, rf"(?mdU)^#{{1,6}}{_BLANK}*", "")
    c = F.regexp_replace(c, r"(?d)\*\*(.*?)\*\*", "$1")
    c = F.regexp_replace(c, r"(?d)(?<!\*)\*(?!\*)(.*?)(?<!\*)\*(?!\*)", "$1")
    c = F.regexp_replace(c, r"(?d)_(.*?)_", "$1")
    return utrim(F.regexp_replace(c, r"\n{2,}", "\n"))


def paragraphs(c: Column | str) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(c, "\n"), utrim), lambda p: p != "")


def chunk_udf(max_chars: int = 400, min_length: int = 100, ends: str = "。！？；"):
    """text -> array of chunks: paragraphs packed greedily up to max_chars, longer ones cut after a sentence's end.

    Queries use chunk_native(); this one holds Arrow batches of whole texts in Python and serves as a cross-check.
    """
    last_end = re.compile(f"(?s).*[{re.escape(ends)}]")

    def cuts(paragraph: str) -> Iterator[str]:
        at = 0
        while len(paragraph) - at > max_chars:
            m = last_end.match(paragraph, at, at + max_chars)
            to = m.end() if m else at + max_chars
            if piece := paragraph[at:to].strip():
                yield piece
            at = to
        if tail := paragraph[at:].strip():
            yield tail

    def pack(text: str | None) -> list[str]:
        out, held = [], ""
        for paragraph in (text or "").split("\n"):
            for piece in cuts(paragraph.strip()):
                if held and len(held) + 1 + len(piece) <= max_chars:
                    held = f"{held}\n{piece}"
                else:
                    if held:
                        out.append(held)
                    held = piece
        if held:
            out.append(held)
        return [x for x in out if len(x) >= min_length]

    @pandas_udf("array<string>")
    def chunk(texts: pd.Series) -> pd.Series:
        return texts.map(pack)

    return chunk


def chunk_native(c: Column | str, max_chars: int = 400, min_length: int = 100, ends: str = "。！？；") -> Column:
    """The same as chunk_udf() in the JVM, by two patterns that each go over a text once.

    A piece is what is left of a paragraph, if it fits, or goes to the last sentence's end that fits, or is full.  Pieces
    have no feeds and fit each on its own, so a chunk is the most that ends before a feed or with the text.
    """
    piece = rf"(?s)\G(?:.{{1,{max_chars}}}\z|.{{0,{max_chars - 1}}}[{re.escape(ends)}]|.{{{max_chars}}})"
    pieces = F.flatten(F.transform(paragraphs(c), lambda p: F.transform(F.regexp_extract_all(p, F.lit(piece), F.lit(0)), utrim)))
    whole = F.array_join(F.filter(pieces, lambda x: x != ""), "\n")
    return F.filter(F.regexp_extract_all(whole, F.lit(rf"(?s)\G(.{{1,{max_chars}}})(?:\n|\z)"), F.lit(1)), lambda x: F.length(x) >= min_length)


def bigrams(c: Column | str) -> Column:
    """Distinct pairs of neighbouring characters."""
    c = F.col(c) if isinstance(c, str) else c
    pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(F.length(c) >= 2, F.array_distinct(pairs)).otherwise(F.expr("cast(array() as array<string>)"))


def blank_words(c: Column | str, words: tuple[str, ...], by: str = "|") -> Column:
    """Replace words one after the other, in the order given."""
    c = F.col(c) if isinstance(c, str) else c
    for w in words:
        c = F.replace(c, F.lit(w), F.lit(by))
    return c


def translate_characters(c: Column | str, table: dict[str, str]) -> Column:
    """Script conversion character by character, by a table of the caller's."""
    return F.translate(c, "".join(table), "".join(table.values()))


def translate_phrases_udf(table: dict[str, str]):
    """Script conversion by the longest match of a table of phrases."""
    longest = re.compile("|".join(map(re.escape, sorted(table, key=lambda k: (-len(k), k))))) if table else None

    @pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None or longest is None else longest.sub(lambda m: table[m[0]], x))

    return convert


def translate_json_udf(table: dict[str, str]):
    """All string values of any JSON document, keys and structure as they are; malformed text becomes null."""
    import json

    letters = str.maketrans(table)

    def walk(x):
        if isinstance(x, str):
            return x.translate(letters)
        if isinstance(x, list):
            return [walk(y) for y in x]
        return {k: walk(v) for k, v in x.items()} if isinstance(x, dict) else x

    def one(line):
        try:
            return json.dumps(walk(json.loads(line)), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    @pandas_udf("string")
    def convert(lines: pd.Series) -> pd.Series:
        return lines.map(one)

    return convert


def clean_value(c: Column | str) -> Column:
    """A number read as text that is whole loses its fraction; all else is trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    number = c.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & utrim(c).contains(".")
    return F.when(whole, number.cast("long").cast("string")).otherwise(utrim(c))


def is_question(c: Column | str) -> Column:
    """A whole sentence that asks: it ends with a question mark and has no clause before it."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"[？?]\z") & ~c.rlike("[，,。；]")


def keep_end(c: Column | str, n: int) -> Column:
    return F.right(c, F.lit(n))


def text_or_json(line: Column | str, key: str = "text") -> Column:
    """A JSON object's field; a line that isn't JSON is text as a whole; an object without the field is null."""
    line = F.col(line) if isinstance(line, str) else line
    value = F.try_parse_json(line)
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return F.when(value.isNull(), line).when(is_object, F.try_variant_get(value, f"$.{key}", "string")).otherwise(value.cast("string"))


def sniffed_text(line: Column | str, field: str = "text") -> Column:
    """The first message of a conversation, else the field, else nothing."""
    return F.coalesce(F.get_json_object(line, "$.conversations[0].content"), F.get_json_object(line, f"$.{field}"), F.lit(""))


def is_json(line: Column | str) -> Column:
    """Whether Python's json.loads() takes the line."""
    import json

    @pandas_udf("boolean")
    def parses(lines: pd.Series) -> pd.Series:
        def one(x):
            try:
                json.loads(x)
            except (TypeError, ValueError):
                return False
            return True

        return lines.map(one)

    return parses(line)
