"""Secret scan: patterns, and sliding-window entropy over candidate strings, DataFrame functions only.

Base spans come from three patterns (``assign``, ``access``, ``hex``). ``entropy``
spans are added, whether or not they touch a base span: candidate strings are runs
of 20 or more token characters; over each, a window of ``WINDOW`` characters slides,
and counts of the characters in it, changed by one in and one out, carry the sum of
c log2 c from which the window's Shannon entropy follows. The span is the hull of
the windows at or over the threshold of the string's character class (digits, hex,
letters, letters and digits, all). Pieces between ``=`` and ``/`` that hold an
alphabet or a placeholder word are blanked before, so that what is left of a run on
either side is judged as a string of its own. Strings of the allow list are
suppressed: UUIDs, and paths whose every segment has the shape of words (letters,
a capital for every ``A_CAPITAL`` letters at most or capitals only, no more than five
consonants in a row, at most ``LONGEST_WORD`` letters).

Places count code points, ends are exclusive. Defined cases: null and empty texts
have no spans; repeated rows are scanned once each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketforge.sources.tables import table

#: Fixed values of the scan: kinds in order, patterns and least lengths.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Letters in either case, of whatever script: U+212A is a capital of k, U+017F a form of s.
EITHER_CASE = "(?u)" + ASSIGN
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy in bits a character of a window, by class of the whole string.
THRESHOLDS = {"digits": 3.0, "hex": 3.0, "letters": 3.9, "alphanumeric": 3.6, "base64": 3.8}
#: Patterns of the classes; a string is of the first that fits, and of the last if none does.
CLASSES = {"digits": "^[0-9]+$", "hex": "^[0-9a-fA-F]+$", "letters": "^[A-Za-z]+$", "alphanumeric": "^[A-Za-z0-9]+$"}
#: Strings that look random but are no secrets. No pattern repeats a group: Java matches those by recursion.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Segments between separators that are no words: other characters than letters, or that many consonants in a row.
NO_WORD = r"[^A-Za-z]|(?i:[bcdfghjklmnpqrstvwxz]{6})"
LONGEST_WORD = 24
#: Letters a capital stands for at least, unless all of a segment are capitals.
A_CAPITAL = 3
#: Pieces of a run, between = and /, that hold an alphabet or a placeholder word, with the = and / beside them.
PIECE = r"(?i)(?:(?<![=/])[=/]++|(?<![A-Z0-9+_-]))[A-Z0-9+_-]*?(?:abcdefghij|0123456789|1234567890|qwertyuiop|example|sample|placeholder|dummy|changeme|xxxx)[A-Z0-9+_-]*+[=/]*+"
BLOCK = 256


def is_word(x: Column) -> Column:
    """Letters in the shape of a word or of words run together: few capitals or nothing else, and vowels between consonants."""
    capitals = F.length(F.regexp_replace(x, "[^A-Z]", ""))
    return (F.length(x) <= LONGEST_WORD) & ~x.rlike(NO_WORD) & ((capitals * A_CAPITAL <= F.length(x)) | (capitals == F.length(x)))


def is_allowed(x: Column) -> Column:
    """UUIDs, and paths of two or more words, which a number may end."""
    path = x
    for ending in ("/_=-", "0123456789", "/_=-"):
        path = F.rtrim(path, F.lit(ending))
    # A one-element array names the segments, so that they are cut once.
    segments = F.transform(F.array(F.split(path, "[/_-]+")), lambda c: F.filter(c, lambda s: s != ""))
    words = F.get(F.transform(segments, lambda c: (F.size(c) >= 2) & F.forall(c, is_word)), F.lit(0))
    return x.rlike(UUID) | words


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _places(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """Adds ``name``_m, the matches of a pattern, and ``name``_s, where each begins.

    A match begins after all the text between matches and all matches before it:
    sums over blocks of ``BLOCK`` matches, then within the block, so that texts of
    very many matches stay cheap.
    """
    m, gaps, sums, starts = f"{name}_m", f"{name}_g", f"{name}_b", f"{name}_s"
    none = F.array().cast("array<int>")
    some = F.size(m) > 0
    df = df.withColumn(m, F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))
    between = F.transform(F.split("t", pattern, -1), lambda x: F.length(x))
    step = F.transform(m, lambda x, k: F.get(gaps, k) + F.when(k == 0, 0).otherwise(F.length(F.get(m, k - 1))))
    df = df.withColumn(gaps, F.when(some, between).otherwise(none)).withColumn(gaps, F.when(some, step).otherwise(none))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(gaps, b * BLOCK + 1, BLOCK)))
    df = df.withColumn(sums, F.when(some, blocks).otherwise(none))
    lead = F.transform(gaps, lambda x, k: _sum(F.slice(sums, F.lit(1), F.floor(k / BLOCK).cast("int"))) + _sum(F.slice(gaps, F.floor(k / BLOCK).cast("int") * BLOCK + 1, k % BLOCK + 1)))
    # A match's length counts from the next one on, so each sum is a beginning.
    return df.withColumn(starts, lead).drop(gaps, sums)


def _blanked(pattern: str) -> Column:
    """The text with each match of a pattern replaced by as many blanks."""
    blanks = F.transform(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)), lambda x: F.repeat(F.lit(" "), F.length(x)))
    put = F.array_join(F.zip_with(F.split("t", pattern, -1), blanks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.col("t").rlike(pattern), put).otherwise(F.col("t"))


def _spans(name: str, kind: int) -> Column:
    m, s = f"{name}_m", f"{name}_s"
    return F.transform(m, lambda x, k: F.struct(F.get(s, k).alias("start"), F.lit(kind).alias("kind"), (F.get(s, k) + F.length(x)).alias("end")))


def _plogp(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def entropy_hull(text: Column) -> Column:
    """Struct (lo, hi): the hull of windows of ``text`` at or over its class's threshold, or -1."""
    least = F.lit(THRESHOLDS["base64"])
    for name, pattern in reversed(CLASSES.items()):
        least = F.when(text.rlike(pattern), F.lit(THRESHOLDS[name])).otherwise(least)
    # One-element arrays name a value inside an expression, so that it is made once and not with each character.
    split = F.transform(F.array(F.split(text, "")), lambda c: F.filter(c, lambda x: x != ""))
    named = F.transform(split, lambda c: F.struct(c.alias("c"), F.array_distinct(c).alias("known"), least.alias("least")))

    def coded(x: Column) -> Column:
        return F.struct(F.transform(x["c"], lambda c: F.array_position(x["known"], c).cast("int")).alias("c"), F.size(x["known"]).alias("k"), x["least"].alias("least"))

    def slide(x: Column) -> Column:
        begin = F.struct(F.array_repeat(F.lit(0), x["k"]).alias("n"), F.lit(0.0).alias("s"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

        def step(a: Column, i: Column) -> Column:
            came, went = F.get(x["c"], i), F.get(x["c"], i - WINDOW)
            went = F.when(i >= WINDOW, went).otherwise(F.lit(0))
            n_in, n_out = F.get(a["n"], came - 1), F.get(a["n"], went - 1)
            change = F.when(came == went, F.lit(0.0)).otherwise(_plogp(n_in + 1) - _plogp(n_in) + F.when(went > 0, _plogp(n_out - 1) - _plogp(n_out)).otherwise(F.lit(0.0)))
            total = a["s"] + change
            counts = F.transform(a["n"], lambda v, k: v + F.when(k + 1 == came, 1).otherwise(0) - F.when(k + 1 == went, 1).otherwise(0))
            high = (i >= WINDOW - 1) & (F.log2(F.lit(float(WINDOW))) - total / WINDOW >= x["least"])
            return F.struct(counts.alias("n"), total.alias("s"), F.when(high & (a["lo"] < 0), i - WINDOW + 1).otherwise(a["lo"]).alias("lo"), F.when(high, i + 1).otherwise(a["hi"]).alias("hi"))

        hull = F.aggregate(F.sequence(F.lit(0), F.size(x["c"]) - 1), begin, step, lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))
        # No window of k different characters has more than log2 k bits.
        return F.when(F.log2(x["k"].cast("double")) >= x["least"], hull).otherwise(F.struct(F.lit(-1).alias("lo"), F.lit(-1).alias("hi")))

    return F.get(F.transform(F.transform(named, coded), slide), F.lit(0))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and its spans, structs (start, kind number, end) in order."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    for name, pattern in (("a", EITHER_CASE), ("k", ACCESS), ("x", HEX)):
        df = _places(df, pattern, name)
    df = df.withColumn("a_v", F.regexp_extract_all("t", F.lit(EITHER_CASE), F.lit(2)))
    assign = F.filter(_spans("a", 0), lambda s, k: F.length(F.get("a_v", k)) >= ASSIGN_LEAST)
    df = df.withColumn("base", F.array_sort(F.concat(assign, _spans("k", 1), _spans("x", 2))))
    df = _places(df.withColumn("t", _blanked(PIECE)), CANDIDATE, "c")
    strings = F.transform("c_m", lambda x, k: F.struct(x.alias("x"), F.get("c_s", k).alias("start")))
    df = df.withColumn("strings", F.filter(strings, lambda c: ~is_allowed(c["x"])))
    hulls = F.transform("strings", lambda c: F.struct(c["start"].alias("at"), entropy_hull(c["x"]).alias("h")))
    added = F.transform(F.filter(hulls, lambda c: c["h"]["lo"] >= 0), lambda c: F.struct((c["at"] + c["h"]["lo"]).alias("start"), F.lit(3).alias("kind"), (c["at"] + c["h"]["hi"]).alias("end")))
    df = df.withColumn("added", added)
    return df.select("doc_id", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def _text(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"))
    counts = [F.size(F.filter("base", lambda s, k=k: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))
