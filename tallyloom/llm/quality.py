"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of its language's common words are compared
to the language's references (means over the corpus) by Jensen-Shannon distance, base 2.
Short documents are guarded: below CLASS_WORDS words no class distance rejects, below
HIST_WORDS no word distance does.

Nulls: a null text has no words and fails the base; a null or unlisted language is compared
as language "other", with no common words. Texts are taken whole. Rows are independent, so
ties and repeated rows get equal verdicts; an empty table gives an empty result; further
columns pass through unless they carry a result column's name, which wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

# Frequent function words of four languages, from general knowledge.
COMMON_WORDS = {
    "de": "als auf das dem den der des die ein eine für im in ist mit nicht sich und von zu".split(),
    "en": "an are as at be by for from in is it of on or that the this to was with".split(),
    "es": "al con de del el en es la las los no para por que se su un una y a".split(),
    "fr": "au dans de des du en est et la le les par pas plus pour que qui sur un une".split(),
}
#: Characters of each class, as bodies of regular-expression sets; blanks and the rest follow.
CLASSES = {
    "upper": r"A-Z",
    "digit": r"0-9",
    "stop": r".,;:!?'\"()\-",
    "sign": r"#$%&*+/<=>@\[\]\\^_`{|}~",
    "wide": r"^\x00-\x7F",
}
SYMBOLS = r"#*$%&|<>"
#: Most characters of a text, of no class and no symbol.
PLAIN = r"a-z\x20\x09-\x0D"
CLASS_WORDS, CLASS_LIMIT = 50, 0.32
#: The word distance of honest short texts is larger: its limit is WORD_LIMIT + WORD_SLACK / sqrt(words).
HIST_WORDS, WORD_LIMIT, WORD_SLACK = 100, 0.20, 0.7
#: Words a document needs to count for its language's references.
REFERENCE_WORDS = 50
#: Bins are kept as parts of this whole, so that sums are exact whatever their order.
PARTS = 1_000_000
BLANK = r"[\x20\x09-\x0D]"
#: Words in a repeated window.
WINDOW = 5

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
RESULT = [*FEATURES, "lang_key", "class_distance", "word_distance", "kept"]


def _total(bins: Column) -> Column:
    return F.aggregate(bins, F.lit(0).cast("long"), lambda a, x: a + x)


def _with_totals(df: DataFrame, names: list[str]) -> DataFrame:
    """df with each histogram's total, null if it is 0, as a column of its own: in a function of bins it would be summed anew for each bin."""
    return df.withColumns({f"\0n_{c}": F.nullif(_total(F.col(f"`\0{c}`")), F.lit(0)) for c in names})


def _repeat_words(n: str, starts: str) -> Column:
    """Words covered by windows of WINDOW words that start at the sorted positions `starts`."""
    new = F.transform(
        F.col(starts),
        lambda at, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), at - F.get(F.col(starts), k - 1))),
    )
    return F.when(F.col(n) < WINDOW, F.lit(0)).otherwise(F.aggregate(new, F.lit(0), lambda a, x: a + x)).cast("long")


def features(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Adds the base counts, base_failed, lang_key and the two histograms (`\\0classes`, `\\0common`).

    Repeated windows are found per row by sorting (64-bit window hash, position) and
    comparing neighbours, so nothing is exploded or shuffled; texts whose hashes are all
    different need no sorting. Characters are counted in what is left without the PLAIN ones.
    """
    text, lang = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{lang_col}`")
    key = F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit("other"))
    spaced = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    listed = F.create_map(*[F.lit(x) for k, ws in COMMON_WORDS.items() for x in (k, f" {' '.join(ws)} ")])
    count = lambda body: (F.length("`\0rest`") - F.length(F.regexp_replace("`\0rest`", f"[{body}]+", ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = [quoted(c) for c in df.columns if c not in RESULT]

    one = df.select(
        *kept,
        key.alias("lang_key"),
        F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "").alias("\0words"),
        F.regexp_replace(text, f"[{PLAIN}]+", "").alias("\0rest"),
        F.length(text).cast("long").alias("\0chars"),
        lines.alias("\0lines"),
        F.coalesce(F.try_element_at(listed, key), F.lit("")).alias("\0listed"),
    )
    words = F.col("`\0words`")
    longest = max(len(w.encode()) for ws in COMMON_WORDS.values() for w in ws)
    two = one.select(
        *kept,
        "lang_key",
        count(SYMBOLS).alias("n_symbols"),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.size("`\0lines`") - F.size(F.array_distinct("`\0lines`"))).cast("long").alias("n_dup_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("\0hashes"),
        F.filter(words, lambda w: (F.octet_length(w) <= longest) & F.contains(F.col("`\0listed`"), spaced(w))).alias("\0found"),
        "`\0listed`",
        "`\0chars`",
        *[count(body).alias(f"\0{name}") for name, body in CLASSES.items()],
    )
    at = lambda i, k: F.get(F.col("`\0hashes`"), i + k)
    window = lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])
    last = F.greatest(F.lit(0), F.size("`\0hashes`") - WINDOW)
    three = two.select(
        *[quoted(c) for c in two.columns if c[0] != "\0"],
        F.transform(F.sequence(F.lit(0), last), window).alias("\0all"),
        F.transform(F.array_remove(F.split("`\0listed`", " "), ""), lambda b: F.size(F.filter(F.col("`\0found`"), lambda w: w == b)).cast("long")).alias("\0bins"),
        F.size("`\0found`").cast("long").alias("\0n_found"),
        *[f"`\0{name}`" for name in CLASSES],
        (F.col("`\0chars`") - F.col("word_chars")).alias("\0blank"),
        (F.col("word_chars") - sum((F.col(f"`\0{name}`") for name in CLASSES), F.lit(0))).alias("\0lower"),
    )
    numbered = F.sort_array(F.transform("`\0all`", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("`\0all`")) < F.size("`\0all`")
    three = three.select(*[quoted(c) for c in three.columns if c != "\0all"], F.when(some, numbered).otherwise(F.array()).alias("\0windows"))
    near = lambda k: F.get(F.col("`\0windows`"), k)["h"]
    repeated = F.filter("`\0windows`", lambda x, k: near(k - 1).eqNullSafe(x["h"]) | near(k + 1).eqNullSafe(x["h"]))
    classes = F.array(*[F.col(f"`\0{c}`") for c in (*CLASSES, "blank", "lower")])
    four = three.select(
        *[quoted(c) for c in three.columns if c[0] != "\0"],
        F.sort_array(F.transform(repeated, lambda x: x["i"])).alias("\0starts"),
        classes.alias("\0classes"),
        F.concat("`\0bins`", F.array(F.col("n_words") - F.col("`\0n_found`"))).alias("\0common"),
    )
    repeat = _repeat_words("n_words", "`\0starts`")
    # Filters on what follows must not be pushed below, where they would repeat the array work for
    # each element; a column that isn't deterministic holds them here.
    five = four.withColumn("n_repeat_words", F.when(F.spark_partition_id() >= 0, repeat)).drop("\0starts")
    return five.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def references(found: DataFrame) -> DataFrame:
    """Mean histograms of each language, one row a language (at most one more than COMMON_WORDS has).

    All documents of REFERENCE_WORDS words that pass the base count, each with equal weight;
    partial sums are made before the shuffle, so a language may hold most rows.
    """
    used = found.filter(~F.col("base_failed") & (F.col("n_words") >= REFERENCE_WORDS))
    used = _with_totals(used, ["classes", "common"])
    # A total that is named twice stays a column; one that is named once is put back into the function of bins.
    share = lambda x, n: F.when(n > 0, F.floor(x * PARTS / n).cast("long"))
    parts = lambda c: F.transform(f"`\0{c}`", lambda x: share(x, F.col(f"`\0n_{c}`")))
    used = used.select("lang_key", parts("classes").alias("c"), parts("common").alias("w"))
    n_c, n_w = len(CLASSES) + 2, max(map(len, COMMON_WORDS.values())) + 1
    sums = lambda c, n: [F.sum(F.get(F.col(c), F.lit(i))).alias(f"{c}{i}") for i in range(n)]
    array = lambda c, n: F.filter(F.array(*[F.col(f"{c}{i}") for i in range(n)]), lambda x: x.isNotNull())
    return (
        used.groupBy("lang_key")
        .agg(*sums("c", n_c), *sums("w", n_w))
        .select("lang_key", array("c", n_c).alias("\0ref_classes"), array("w", n_w).alias("\0ref_common"))
    )


def distance(bins: Column, ref: Column, n: Column, m: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of two histograms of counts, `n` and `m` their totals; null if either is empty."""

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    parts = F.zip_with(bins, ref, lambda b, r: term(b / n, r / m) + term(r / m, b / n))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), total / 2)))


def judged(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds class_distance, word_distance and kept; refs is the bounded table of references()."""
    joined = found.join(F.broadcast(refs), "lang_key", "left")
    joined = _with_totals(joined, ["classes", "common", "ref_classes", "ref_common"])
    far = lambda c: distance(*[F.col(f"`\0{x}`") for x in (c, f"ref_{c}", f"n_{c}", f"n_ref_{c}")])
    joined = joined.withColumns({"class_distance": far("classes"), "word_distance": far("common")})
    odd_classes = (F.col("n_words") >= CLASS_WORDS) & (F.col("class_distance") > CLASS_LIMIT)
    odd_words = (F.col("n_words") >= HIST_WORDS) & (F.col("word_distance") > WORD_LIMIT + WORD_SLACK / F.sqrt(F.col("n_words")))
    odd = F.coalesce(odd_classes, F.lit(False)) | F.coalesce(odd_words, F.lit(False))
    out = joined.withColumn("kept", ~F.col("base_failed") & ~odd)
    return out.drop(*[c for c in out.columns if c[0] == "\0"])


def quality_rules(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """df with the base counts, distances and `kept`. Two passes: references, then verdicts.

    The features are made twice: storing them with the texts costs as much and a copy of the table.
    """
    found = features(df, text_col, lang_col)
    return judged(found, references(found.select("lang_key", "n_words", "base_failed", "`\0classes`", "`\0common`")))
