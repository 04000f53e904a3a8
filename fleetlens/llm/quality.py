"""Line-first quality rules. Column expressions only; a document is one row and is never shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD

SYMBOLS = "#*$%&|<>"
SYMBOL = r"[#*$%&|<>]"
WHITE = " \t\n\x0b\x0c\r"
# Ends of a finished line and texts that mark boilerplate, in lower case; the class of their first letters comes first,
# since most letters fail there.
TERMINAL = ".!?:;…。！？\"'”’»)]"
BOILERPLATE = (
    r"(?=[acjlprst])(?:l(?:orem ipsum|og ?in)|javascript|c(?:ookie|opyright|lick here)|terms of (?:use|service)|p(?:rivacy policy|owered by)"
    r"|all rights reserved|s(?:ubscribe|ign (?:in|up)|hare this)|read more)"
)
NAVIGATION = r"^(?:[^|»›>\n]{1,30}[|»›>]){2,}|^\s*(?:home|menu|next|previous|back|top)\s*$"


def let(value: Column, body) -> Column:
    """body(value), with `value` computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_window_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more.

    Sorting numbers made of a window's hash and its place brings equal windows together. Neighbours with one
    hash are compared as words; should two different windows share a hash, the texts themselves are sorted."""

    def window(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def covered(starts: Column) -> Column:
        steps = lambda s: F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3))))
        return let(F.sort_array(starts), lambda s: F.aggregate(steps(s), F.lit(0).cast("long"), lambda a, x: a + x))

    def by_text(w: Column, places: Column) -> Column:
        rows = F.sort_array(F.transform(places, lambda i: F.struct(window(w, i).alias("t"), i.alias("i"))))
        twice = lambda r: F.filter(r, lambda x, k: (F.get(r, k - 1)["t"] == x["t"]) | (F.get(r, k + 1)["t"] == x["t"]))
        return let(rows, lambda r: covered(F.transform(twice(r), lambda x: x["i"].cast("long"))))

    def run(w: Column) -> Column:
        n = F.size(w) - 2
        places = F.sequence(F.lit(0), n - 1)
        keys = F.sort_array(F.transform(places, lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 24).bitwiseOR(i.cast("long"))))
        place = lambda k: k.bitwiseAND(F.lit((1 << 24) - 1))
        top = lambda k: F.shiftright(k, 24)

        def judged(k: Column) -> Column:
            same = lambda x, j: F.coalesce(top(F.get(k, j)) == top(x), F.lit(False))
            hits = F.filter(k, lambda x, j: ((j > 0) & same(x, j - 1)) | same(x, j + 1))

            def verified(h: Column) -> Column:
                at = lambda x: place(x).cast("int")
                differ = lambda x, j: (j > 0) & (top(F.get(h, j - 1)) == top(x)) & (window(w, at(F.get(h, j - 1))) != window(w, at(x)))
                starts = F.transform(h, place)
                return F.when(F.size(h) == 0, F.lit(0).cast("long")).when(F.exists(F.transform(h, differ), lambda d: d), by_text(w, places)).otherwise(covered(starts))

            return let(hits, verified)

        return F.when(n < 2, F.lit(0).cast("long")).when(n > F.lit(1 << 24), by_text(w, places)).otherwise(let(keys, judged))

    return let(words, run)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id with the counts of `text_col`, the text's lines after the line rules and the characters lost with the others.

    Null text: no words. Empty texts get zeros. A row is judged alone, so repeated rows get equal results."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    length = lambda c: F.char_length(c).cast("long")
    # Cheap tests first; a line that fails one skips the others.
    open_end = lambda x: ~F.right(F.rtrim(x, F.lit(WHITE)), F.lit(1)).isin(*TERMINAL)
    noisy = lambda x: 10 * F.regexp_count(x, F.lit(SYMBOL)) > F.char_length(x)
    bad = lambda x: open_end(x) | noisy(x) | x.rlike(NAVIGATION) | F.lower(x).rlike(BOILERPLATE)
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(x.alias("line"), bad(x).alias("bad")))
    found = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"))
    joined = lambda which: F.array_join(F.filter("lines", which)["line"], "\n")
    return found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines.line"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
        joined(lambda x: ~x["bad"]).alias("cleaned"),
        length(F.translate(joined(lambda x: x["bad"]), WHITE, "")).alias("lost_chars"),
    )


def judge(docs: DataFrame, text_col: str = "text", least_words: int = 50, most_repeat: int = 50, most_lost: int = 50) -> DataFrame:
    """The counts of `measure`, base_failed, lost_chars and kept.

    A line fails without an end mark, with more than a tenth of symbols, as navigation or as boilerplate, and goes. A document fails when it has
    fewer than `least_words` words, when more than `most_repeat` % of its words lie in repeated windows, or when
    more than `most_lost` % of its characters outside white space go with failed lines. `cleaned` is the rest."""
    m = measure(docs, text_col)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    m = m.withColumn("base_failed", failed)
    return m.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars")))
