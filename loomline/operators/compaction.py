"""Shorter forms of source text, and Markdown escapes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.numbers import to_fixed, utf16_length

#: Starts of lines that an outline keeps, and words that open no signature.
OUTLINE = ["import ", "export ", "interface ", "type ", "declare ", "enum ", "from ", "export default"]
CONTROL = {"if", "for", "while", "switch", "catch", "with"}


def strip_comments(text: Column, python: Column) -> Column:
    script = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^\\])//.*$", "$1")
    hashed = F.regexp_replace(text, r"(?m)(^|[^\\])#.*$", "$1")
    hashed = F.regexp_replace(F.regexp_replace(hashed, r'(?s)""".*?"""', '"""..."""'), r"(?s)'''.*?'''", "'''...'''")
    lines = F.transform(F.split(F.when(python, hashed).otherwise(script), "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"\s+$", "")))
    kept = F.filter(lines, lambda x, i: (x != "") | ((i > 0) & (F.get(lines, i - 1) != "")))
    return F.array_join(kept, "\n")


def outline(text: Column) -> Column:
    """Lines that declare what a file exports or imports, and closing braces."""

    def keep(x: Column) -> Column:
        trimmed = F.regexp_replace(x, r"^\s+|\s+$", "")
        found = trimmed == "}"
        for start in OUTLINE:
            found = found | trimmed.startswith(start)
        return found

    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


#: What a line that opens a body looks like, and the first word of a line.
_DECLARED = re.compile(r"^(export\s+)?(async\s+)?function\s|^constructor")
_ARROW = re.compile(r"^(const|let|var)\s+[A-Za-z0-9_$]+\s*=\s*(async\s*)?\([^)]*\)\s*(=>)?\s*\{?$")
_CALLED = re.compile(r"\b[A-Za-z0-9_$]+\s*\([^)]*\)\s*(?::\s*[^;{]+)?\s*\{?$")
_CLASS = re.compile(r"^(export\s+)?(abstract\s+)?class\s+")
_WORD = re.compile(r"^(?:}\s*)?(?:else\s+)?([A-Za-z_$][A-Za-z0-9_$]*)")


def is_signature(line: str) -> bool:
    if _CLASS.match(line):
        return False
    word = _WORD.match(line)
    return bool(_DECLARED.match(line) or _ARROW.match(line) or ((word[1] if word else "") not in CONTROL and _CALLED.search(line)))


def collapse(text: str) -> str:
    """Bodies of functions as a mark, by the depth of braces line by line."""
    out, depth, waiting = [], 0, False
    for line in text.split("\n"):
        change = line.count("{") - line.count("}")
        if depth > 0:
            depth = max(0, depth + change)
        elif is_signature(line.strip()):
            head, brace, _ = line.partition("{")
            out.append(f"{head}{brace} /* collapsed */ }}" if brace else line)
            waiting = waiting if brace else True
            depth = max(0, change) if brace else 0
        elif waiting:
            if "{" in line:
                out.append("  /* collapsed */\n}")
                depth, waiting = 1, False
        else:
            out.append(line)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def collapse_bodies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: None if t is None else collapse(t))


def compact_tokens(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(utf16_length(text) / F.lit(3.8)))).cast("long")


def progressive(df: DataFrame, target: int | None, python: Column, fixed: int | None = None) -> DataFrame:
    """(path, stage, text, tokens, reduction): the lowest of four stages that meets a target, else the last; or a fixed stage."""
    staged = df.withColumn("_1", strip_comments(F.col("text"), python)).withColumn("_2", collapse_bodies("_1")).withColumn("_3", outline(F.col("_1")))
    texts = [F.col("text"), F.col("_1"), F.col("_2"), F.col("_3")]
    if (fixed is None) == (target is None) or fixed not in (None, 0, 1, 2, 3):
        raise ValueError("a target or a stage from 0 to 3")
    stage = F.lit(3 if fixed is None else fixed)
    for n in (2, 1, 0) if fixed is None else ():
        stage = F.when(compact_tokens(texts[n]) <= target, n).otherwise(stage)
    chosen = staged.withColumn("stage", stage).withColumn("_out", F.get(F.array(*texts), F.col("stage")))
    before, after = compact_tokens(F.col("text")), compact_tokens(F.col("_out"))
    less = F.when(before > 0, to_fixed((before - after) / F.nullif(before, F.lit(0)) * 100, 2)).otherwise(0.0)
    return chosen.select("path", "stage", F.col("_out").alias("text"), after.alias("tokens"), less.alias("reduction"))


def escape_markdown(text: Column) -> Column:
    flat = F.regexp_replace(text, r"\r\n|\r|\n", " ")
    return F.regexp_replace(F.regexp_replace(flat, r"\\", r"\\\\"), r"([`*_\[\]<>#|])", r"\\$1")


def markdown_code(text: Column) -> Column:
    """Inline code in a fence longer than any run of backticks in it."""
    flat = F.replace(F.regexp_replace(text, r"\r\n|\r|\n", " "), F.lit("|"), F.lit("&#124;"))
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(flat, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), longest + 1)
    return F.concat(fence, F.when(longest > 0, " ").otherwise(""), flat, F.when(longest > 0, " ").otherwise(""), fence)
