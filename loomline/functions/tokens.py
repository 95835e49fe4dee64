"""Token estimates without a tokenizer, and how dense in tokens a text is."""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.batches import ROWS
from loomline.functions.numbers import round_half_up, to_fixed, utf16_length

#: Tokens of a file by its extension, as a factor.
FACTORS = {".json": 0.9, ".yaml": 0.85, ".yml": 0.85, ".md": 1.1, ".mdx": 1.1, ".svg": 1.3, ".lock": 1.5}
TEXT_LIMIT = 5_000_000
#: What parts words: white space of the Unicode standard and the byte order mark.
BLANKS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: Blanks but spaces and line feeds: those of one byte, and of several; of those that begin with E2 80, common signs do too.
RARE, WIDE = ["\t", "\x0b", "\x0c", "\r"], ["\xa0", "\u1680", "\u205f", "\u3000", "\ufeff"]


def words(text: Column) -> Column:
    """How many words a text has. Texts are cut at spaces and line feeds, and only those that hold other blanks by a pattern, which costs several times as much."""
    has = lambda some: reduce(operator.or_, [F.contains(text, F.lit(c)) for c in some])
    general = F.contains(text.cast("binary"), F.lit(b"\xe2\x80")) & text.rlike(BLANKS.replace(r"\s", ""))
    other = has(RARE) | (F.octet_length(text) != F.length(text)) & (has(WIDE) | general)
    cut = F.when(other, F.split(text, BLANKS)).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "))
    return F.size(F.array_remove(cut, ""))


def estimate(text: Column) -> Column:
    """0 for nothing, else the larger of a quarter of the code units and 1.3 a word, at least 1."""
    by_length = F.ceil(utf16_length(text) / 4)
    by_words = F.ceil(words(text) * F.lit(1.3))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), by_length, by_words)).cast("long")


def weight(text: str) -> tuple[int, int]:
    """(code units, words) of one text on the driver."""
    return len(text.encode("utf-16-le")) // 2, len(re.findall(r"[^\s\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+", text))


def estimate_text(text: str) -> int:
    """estimate() of one text on the driver."""
    units, found = weight(text)
    return max(1, math.ceil(units / 4), math.ceil(found * 1.3)) if text else 0


def heuristic(text: Column, extension: Column | None = None) -> Column:
    """A struct of tokens, how sure they are, and what an extension's factor changed, null if nothing."""
    whole, sure = estimate(text), F.lit("heuristic").alias("confidence")
    if extension is None:
        return F.struct(whole.alias("tokens"), sure, F.lit(None).cast("string").alias("details"))
    by, told = factor(extension), F.lit(None).cast("string")
    for name, value in FACTORS.items():
        told = F.when(extension == name, F.lit(f"adjusted by {value:g}x for {name[1:]}")).otherwise(told)
    return F.struct(round_half_up(whole * by).alias("tokens"), sure, told.alias("details"))


def factor(extension: Column) -> Column:
    found = F.lit(1.0)
    for name, value in FACTORS.items():
        found = F.when(extension == name, F.lit(value)).otherwise(found)
    return found


def adjusted(whole: Column, extension: Column) -> Column:
    return F.when(whole == 0, whole).otherwise(F.greatest(F.lit(1), round_half_up(whole * factor(extension)))).cast("long")


def estimate_file(text: Column, extension: Column) -> Column:
    """The estimate times the extension's factor, rounded, at least 1 unless the text is empty."""
    return adjusted(estimate(text), extension)


def estimate_bytes(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / 4)).cast("long")


def with_provider(text: Column, provider: Callable[[str], int | None]) -> Column:
    """Tokens by a user's function, run over Arrow batches; the estimate where it fails or gives no whole number from 0."""

    def safe(value: str | None) -> int | None:
        try:
            n = provider(value or "")
        except Exception:  # noqa: BLE001 - any failure of the user's function means the estimate
            return None
        return n if isinstance(n, int) and not isinstance(n, bool) and 0 <= n < 1 << 53 else None

    rows = ROWS  # workers needn't have this package for a user's function

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array([safe(x) for x in batch.slice(at, rows).to_pylist()], pa.int64()) for at in range(0, len(batch), rows)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.int64())

    return F.coalesce(run(text), estimate(text))


def with_density(df: DataFrame, text: str = "text", out: str = "density", ratio: float = 3.8, least: float = 0.65, most: float = 2.2) -> DataFrame:
    """Adds a struct of counts, ratios to four places, the multiplier to three, tokens and class.

    One pattern cuts a text to its words, which gives words and letters; signs are what remains of the length, so that no
    pattern is tried for every character. Each step is a projection of its own.
    """
    t, kept = F.coalesce(F.col(text), F.lit("")), df.columns
    without = lambda x, *some: without(F.replace(x, F.lit(some[0]), F.lit("")), *some[1:]) if some else x
    count = lambda pattern: F.when(t.rlike(pattern), F.regexp_count(t, F.lit(pattern))).otherwise(0)
    steps = df.withColumns({"_n": utf16_length(t), "_points": F.length(t), "_cut": F.regexp_replace(t, "[^A-Za-z0-9_]+", " ")})
    steps = steps.withColumns({
        "_blank": F.col("_points") - F.length(without(t, " ", "\t", "\r", "\n")), "_lines": F.col("_points") - F.length(without(t, "\n")), "_under": F.col("_points") - F.length(without(t, "_")),
        "_letters": F.length(without(F.col("_cut"), " ")), "_foreign": F.when(F.octet_length(t) == F.col("_points"), 0).otherwise(F.regexp_count(t, F.lit(r"[^\x00-\x7F]"))),
        "_control": count(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"),
    })
    ends = F.when(F.col("_cut").startswith(" "), 1).otherwise(0) + F.when(F.col("_cut").endswith(" "), 1).otherwise(0)
    steps = steps.withColumns({
        "_words": F.when(F.col("_letters") == 0, 0).otherwise(F.length("_cut") - F.col("_letters") + 1 - ends),
        "_marks": F.col("_points") - F.col("_blank") - F.col("_foreign") - F.col("_control") - F.col("_letters") + F.col("_under"),
    })
    n = F.col("_n")
    part = lambda x, of: F.when(n == 0, F.lit(0.0)).otherwise(F.col(x) / F.greatest(of, F.lit(1)))
    steps = steps.withColumn("_foreign", F.col("_foreign") + n - F.col("_points")).withColumns({"_p": part("_marks", n - F.col("_blank")), "_w": part("_blank", n), "_o": part("_foreign", n), "_l": part("_letters", F.col("_words"))})
    steps = steps.withColumns({c: to_fixed(F.col(c), d) for c, d in (("_p", 4), ("_w", 4), ("_o", 4), ("_l", 2))})
    p, w, o, word = (F.col(c) for c in ("_p", "_w", "_o", "_l"))
    multiplier = F.lit(1.0)
    for more in (
        F.when(p > 0.28, 0.35).when(p > 0.18, 0.18).when(p < 0.08, -0.1).otherwise(0.0),
        F.when(o > 0.15, 0.65).when(o > 0.03, 0.3).otherwise(0.0),
        F.when(w > 0.45, -0.25).when(w > 0.32, -0.12).when(w < 0.12, 0.22).otherwise(0.0),
        F.when((word > 0) & (word < 2.5), 0.25).when(word > 8, -0.08).otherwise(0.0),
    ):
        multiplier = multiplier + more
    steps = steps.withColumn("_m", F.greatest(F.lit(least), F.least(F.lit(most), multiplier))).withColumn("_m", F.when(n == 0, F.lit(1.0)).otherwise(to_fixed(F.col("_m"), 3)))
    m, some = F.col("_m"), lambda x: F.when(n == 0, F.lit(0)).otherwise(x).cast("long")
    steps = steps.withColumn("_raw", some(F.greatest(F.lit(1), F.ceil(n / F.lit(ratio)))))
    struct = F.struct(
        n.alias("chars"), some(1 + F.col("_lines")).alias("lines"), F.col("_words").cast("long").alias("words"), p.alias("punctuation_ratio"), w.alias("whitespace_ratio"), o.alias("non_ascii_ratio"),
        word.alias("average_word"), m.alias("multiplier"), F.col("_raw").alias("raw_tokens"), some(F.greatest(F.lit(1), round_half_up(F.col("_raw") * m))).alias("tokens"),
        F.when(m >= 1.25, "dense").when(m <= 0.85, "sparse").otherwise("balanced").alias("density"),
    )
    return steps.select(*[c for c in kept if c != out], struct.alias(out))
