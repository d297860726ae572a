"""Secrets in texts, found by patterns and by a battery of randomness tests.

Patterns find assigned values, access keys and hexadecimal keys. Beside them, every long run of key characters is
a candidate whose encoding is inferred, and which is tested as a random string of that encoding; so is each long part of
a run between / _ -, as keys stand in paths and behind prefixes. The tests: chi-squared uniformity
over the alphabet and over its classes of characters, a runs test about the middle of the alphabet, and serial
correlation. The smallest p-value, times the number of tests, is the candidate's: the larger, the more it looks like a key.

A candidate is a secret when it looks more random than ordinary writing of its length can explain. Ordinary writing is
decoys: the words of each document from a place given by a hash, glued with capitals as in identifiers, and cut at the
least length of one class of lengths, given by a hash too; to them come DECOYS glued from common words for each class, so that
a small corpus has some. The
share of the decoys of a class that look as random as a candidate is its p-value under "ordinary", and Benjamini and
Hochberg's rule per class of length accepts candidates so that at most RATE of the accepted are expected to be ordinary.
The rule needs the order of p-values only up to bins of their logarithm, so a count by class and bin, of bounded size,
replaces a global sort.

Matches are exploded with the gaps before them, and windows of one document turn the gaps into places, so work is linear
in a text's matches. Texts don't shuffle; matches of documents that have some do.

Defined cases: a null or empty text has no spans; spans are in code points, ends exclusive; a candidate that touches
a span of a pattern adds none; a part within a run that is a secret adds none; rows that repeat an id stand for themselves;
an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.line_dedup import row_key

#: Fixed patterns, in the order of kinds. The group is tested for its length.
PATTERNS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
KINDS = [name for name, *_ in PATTERNS] + ["random"]
CANDIDATE, PART, LEAST_BITS = r"[A-Za-z0-9+/_-]{20,}", r"[A-Za-z0-9+]{20,}", 80
#: Alphabets in order, and the sizes of their classes of characters: upper case, lower case, digits, others.
LOWER, DIGITS = common.UPPER.lower(), "0123456789"
ALPHABETS = {
    "hex": ("0123456789abcdef", (0, 6, 10, 0)),
    "base32": (common.UPPER + "234567", (26, 0, 6, 0)), "lower32": (LOWER + "234567", (0, 26, 6, 0)),
    "upper36": (common.UPPER + DIGITS, (26, 0, 10, 0)), "lower36": (LOWER + DIGITS, (0, 26, 10, 0)),
    "base62": (common.UPPER + LOWER + DIGITS, (26, 26, 10, 0)), "base64": (common.UPPER + LOWER + DIGITS + "+/", (26, 26, 10, 2)),
}
#: The first that a string matches is its encoding; base64 if none.
SHAPES = [
    ("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"), ("hex", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    ("base32", "^(?=.*[2-7])[A-Z2-7]+$"), ("lower32", "^(?=.*[2-7])[a-z2-7]+$"),
    ("upper36", "^(?=.*[0-9])[A-Z0-9]+$"), ("lower36", "^(?=.*[0-9])[a-z0-9]+$"), ("base62", "^[A-Za-z0-9]+$"),
]
#: First lengths of the classes of length, bins of a factor of two of p, and the share of false secrets.
LENGTHS, BINS, RATE = (20, 24, 32, 40, 64), 8, 0.05
LEAST_P = 1e-9
#: Characters of a document that its decoys are glued from, decoys glued from common words, and these words.
DECOY_SOURCE, DECOYS = 160, 1000
COMMON_WORDS = "the and from with that this have will your which their time people other first about would water after where right great small house world still place again found every under might while line text page file name user list item value table state point field group level order"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, group: int, kind: int, with_text: bool = False) -> Column:
    """The matches in order: array of kind, gap (characters since the one before), size, of (of the group), and the text."""
    kept = "array<struct<kind:int,gap:int,size:int,of:int,text:string>>"

    def placed(m: Column) -> Column:
        # Most texts have no match; only the others are searched for groups and split.
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
        found = F.transform(
            F.arrays_zip(m.alias("m"), groups.alias("g"), F.slice(F.split(text, pattern, -1), 1, F.size(m)).alias("before")),
            lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["before"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["g"]).alias("of"), (x["m"] if with_text else F.lit(None).cast("string")).alias("text")),
        )
        return F.when(F.size(m) == 0, F.array().cast(kept)).otherwise(found)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def upper_tail(z: Column) -> Column:
    """The share of a normal distribution above z, by a rational approximation (Abramowitz and Stegun 26.2.17).

    Values that a formula takes several times are computed once, as functions of arrays share no subexpressions.
    """

    def above(z: Column, t: Column) -> Column:
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return let(poly * F.exp(-z * z / 2) / 2.5066282746310002, lambda tail: F.when(z >= 0, tail).otherwise(1 - tail))

    return let(z, lambda z: let(1 / (1 + 0.2316419 * F.abs(z)), lambda t: above(z, t)))


def chi_tail(x: Column, df: Column) -> Column:
    """The upper tail of chi-squared, by Wilson and Hilferty's cube root."""
    return let(2 / (9 * df), lambda s: upper_tail((F.pow(x / df, F.lit(1 / 3)) - (1 - s)) / F.sqrt(s)))


def encoding(s: Column) -> Column:
    return F.coalesce(*(F.when(s.rlike(shape), name) for name, shape in SHAPES), F.lit("base64"))


def of_encoding(enc: Column, values: dict) -> Column:
    return F.coalesce(*(F.when(enc == name, F.lit(x)) for name, x in values.items()))


def p_value(s: Column, enc: Column) -> Column:
    """How likely a random string of this encoding looks as uneven as s."""
    size = of_encoding(enc, {name: float(len(alphabet)) for name, (alphabet, _) in ALPHABETS.items()})
    letters = of_encoding(enc, {name: alphabet for name, (alphabet, _) in ALPHABETS.items()})
    chars = F.split(F.when(enc == "hex", F.lower(s)).otherwise(F.translate(s, "-_", "+/")), "")

    def tests(v: Column, size: Column) -> Column:
        squares = F.aggregate(
            F.sort_array(v),
            F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
            lambda a, x: let(F.when(a["last"] == x, a["run"]).otherwise(0.0), lambda run: F.struct(x.alias("last"), (run + 1).alias("run"), (a["sum"] + 2 * run + 1).alias("sum"))),
            lambda a: a["sum"],
        )
        walk = F.aggregate(
            v,
            F.struct(*(F.lit(-1.0 if c == "last" else 0.0).alias(c) for c in ("last", "runs", "high", "s1", "s2", "s12"))),
            lambda a, x: F.struct(
                x.alias("last"),
                (a["runs"] + F.when((a["last"] >= 0) & ((a["last"] >= size / 2) == (x >= size / 2)), 0.0).otherwise(1.0)).alias("runs"),
                (a["high"] + F.when(x >= size / 2, 1.0).otherwise(0.0)).alias("high"),
                (a["s1"] + x).alias("s1"),
                (a["s2"] + x * x).alias("s2"),
                (a["s12"] + F.when(a["last"] >= 0, a["last"] * x).otherwise(0.0)).alias("s12"),
            ),
        )
        ends = F.element_at(v, 1) + F.element_at(v, -1)
        measured = F.struct(F.size(v).cast("double").alias("n"), squares.alias("squares"), walk.alias("w"), ends.alias("ends"))

        def least(m: Column) -> Column:
            n, w = m["n"], m["w"]
            uniform = chi_tail(F.greatest(size / n * m["squares"] - n, F.lit(0.0)), size - 1)

            def runs(k: Column) -> Column:
                spread = k["pairs"] * (k["pairs"] - n) / (n * n * (n - 1))
                return let(spread, lambda x: F.when(x > 0, 2 * upper_tail(F.abs(w["runs"] - 1 - k["pairs"] / n) / F.sqrt(F.when(x > 0, x)))).otherwise(LEAST_P))

            def serial(k: Column) -> Column:
                # Of neighbours: the first lacks a left one and the last a right one.
                cross = w["s12"] - k["mean"] * (2 * w["s1"] - m["ends"]) + (n - 1) * k["mean"] * k["mean"]
                around = w["s2"] - n * k["mean"] * k["mean"]
                return let(around, lambda x: F.when(x > 0, 2 * upper_tail(F.abs(cross / F.when(x > 0, x) + 1 / n) * F.sqrt(n))).otherwise(LEAST_P))

            shared = F.struct((2 * w["high"] * (n - w["high"])).alias("pairs"), (w["s1"] / n).alias("mean"))
            return let(shared, lambda k: F.least(uniform, runs(k), serial(k), class_test(s, enc, n)))

        return let(measured, least)

    def battery(k: Column) -> Column:
        return let(F.transform(chars, lambda c: (F.instr(k["letters"], c) - 1).cast("double")), lambda v: tests(v, k["size"]))

    return F.least(F.lit(1.0), F.greatest(F.lit(LEAST_P), 4 * let(F.struct(size.alias("size"), letters.alias("letters")), battery)))


def class_test(s: Column, enc: Column, n: Column) -> Column:
    """Chi-squared over the classes of characters of the alphabet."""
    counts = F.array(*(F.length(F.regexp_replace(s, f"[^{c}]", "")).cast("double") for c in ("A-Z", "a-z", "0-9", "+/_-")))

    def of(k: Column) -> Column:
        found = F.lit(None).cast("double")
        for name, (alphabet, sizes) in ALPHABETS.items():
            size = len(alphabet)
            cells = [(k[i], x / size) for i, x in enumerate(sizes) if x]
            if name == "hex":
                cells = [(k[0] + k[1], 6 / 16), (k[2], 10 / 16)]
            x = sum((c * c / (n * share) for c, share in cells), F.lit(0.0)) - n
            found = F.when(enc == name, chi_tail(F.greatest(x, F.lit(0.0)), F.lit(float(len(cells) - 1)))).otherwise(found)
        return found

    return let(counts, of)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: _id, _row, found (matches of all patterns and candidates), decoys."""
    text = common.whole(text_col)
    found = [matches(text, pattern, group, k) for k, (_, pattern, group, _) in enumerate(PATTERNS)]
    found.append(matches(text, CANDIDATE, 0, len(PATTERNS), True))
    place = F.pmod(F.xxhash64(text_col), F.greatest(F.char_length(text) - DECOY_SOURCE, F.lit(1))) + 1
    written = F.regexp_replace(F.substring(text, place.cast("int"), F.lit(DECOY_SOURCE)), CANDIDATE, " ")
    return docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_row"), F.concat(*found).alias("found"), glued(written).alias("decoy"))


def glued(text: Column) -> Column:
    """Words with capitals and without what stands between them."""
    return F.regexp_replace(F.initcap(text), "[^A-Za-z0-9]+", "")


def common_decoys(spark: SparkSession) -> DataFrame:
    """Strings glued from common words, by a rule."""
    words = F.array(*map(F.lit, COMMON_WORDS.split()))
    chosen = [F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)) + 1).cast("int")) for k in range(30)]
    return spark.range(DECOYS).select(glued(F.concat_ws(" ", *chosen)).alias("decoy"))


def length_class(n: Column) -> Column:
    return sum((F.when(n >= a, 1).otherwise(0) for a in LENGTHS[1:]), F.lit(0))


def binned(rows: DataFrame) -> DataFrame:
    """rows with cls, the class of length of their text, and bin, that of their p-value."""
    named = rows.withColumn("enc", encoding(F.col("text")))
    return named.withColumn("cls", length_class(F.length("text"))).withColumn("bin", F.floor(-F.log2(p_value(F.col("text"), F.col("enc"))) * BINS).cast("int"))


def spans_of(scans: DataFrame) -> DataFrame:
    """A row per span: _row, kind, start, end, text; candidates that touch no pattern's span, with run, the start of their run, and is_run."""
    each = scans.where(F.size("found") > 0).groupBy("_row").agg(F.first("found").alias("found"))
    each = each.select("_row", F.posexplode("found").alias("i", "x")).select("_row", "i", "x.*")
    upto = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.array(*(F.lit(n) for *_, n in PATTERNS), F.lit(LENGTHS[0])), F.col("kind") + 1)
    each = each.where(F.col("of") >= least)

    runs = each.where(F.col("kind") == len(PATTERNS)).select("_row", "kind", "start", "end", "text", F.col("start").alias("run"), F.lit(True).alias("is_run"))
    inside = runs.where(F.col("text").rlike("[/_-]")).select("_row", "run", F.posexplode(matches(F.col("text"), PART, 0, len(PATTERNS), True)).alias("i", "x")).select("_row", "run", "i", "x.*")
    within = Window.partitionBy("_row", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    parts = inside.withColumn("end", (F.col("run") + F.sum(F.col("gap") + F.col("size")).over(within)).cast("int")).select(
        "_row", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "text", "run", F.lit(False).alias("is_run")
    )
    base = each.where(F.col("kind") < len(PATTERNS)).select("_row", "kind", "start", "end", F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("run"), F.lit(None).cast("boolean").alias("is_run"))
    every = base.unionByName(runs).unionByName(parts)
    # A candidate touches a pattern's span if, of those that begin before its end, one ends after its start.
    at = F.when(F.col("text").isNull(), F.col("start")).otherwise(F.col("end") - 1)
    before = Window.partitionBy("_row").orderBy(at, F.col("text").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("text").isNull(), F.col("end"))).over(before)
    return every.withColumn("reach", reach).where(F.col("text").isNull() | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("reach")


def limits(candidates: DataFrame, decoys: DataFrame, rate: float = RATE) -> dict[int, int]:
    """By class of length, the last bin whose candidates are secrets. Reads one row per class and bin."""
    both = candidates.select("cls", "bin", F.lit(1).alias("own")).unionByName(decoys.select("cls", "bin", F.lit(0).alias("own")))
    rows = both.groupBy("cls", "bin").agg(F.sum("own").alias("own"), F.count(F.lit(1)).alias("n")).collect()
    found: dict[int, int] = {}
    for cls in {r["cls"] for r in rows}:
        bins = sorted((r["bin"], r["own"], r["n"] - r["own"]) for r in rows if r["cls"] == cls)
        total, ordinary = sum(n for _, n, _ in bins), sum(d for *_, d in bins)
        accepted = alike = 0
        for k, n, d in bins:  # from the most random on
            accepted, alike = accepted + n, alike + d
            if accepted and (1 + alike) / (1 + ordinary) <= rate * accepted / total:
                found[cls] = k
    return found


def joined_spans(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row of docs: id, base and every, arrays of spans (start, kind, end) in order."""
    spark = docs.sparkSession
    scans = common.stored(scanned(docs, id_col, text_col), "secret-scan")
    found = common.stored(spans_of(scans), "secret-spans")
    bits = F.length("text") * of_encoding(F.col("enc"), {name: len(alphabet).bit_length() - 1 for name, (alphabet, _) in ALPHABETS.items()})
    candidates = common.stored(binned(found.where("text is not null")).where(bits >= LEAST_BITS).drop("text"), "secret-candidates")
    # A document stands for one class of length, by a hash; each of the common decoys for all.
    own = F.element_at(F.array(*map(F.lit, LENGTHS)), (F.pmod(F.xxhash64("_row"), F.lit(len(LENGTHS))) + 1).cast("int"))
    written = scans.select("decoy", own.alias("n")).unionByName(common_decoys(spark).select("decoy", F.explode(F.array(*map(F.lit, LENGTHS))).alias("n")))
    cuts = written.where(F.length("decoy") >= F.col("n")).select(F.substring("decoy", F.lit(1), F.col("n")).alias("text"))
    accepted = limits(candidates, binned(cuts), rate)

    is_secret = F.lit(False)
    for cls, last in sorted(accepted.items()):
        is_secret = is_secret | ((F.col("cls") == cls) & (F.col("bin") <= last))
    of_run = Window.partitionBy("_row", "run")
    outermost = candidates.where(is_secret).withColumn("whole", F.max("is_run").over(of_run)).where(F.col("is_run") | ~F.col("whole"))
    span = F.struct("start", "kind", "end")
    spans = found.where("text is null").select("_row", span.alias("x")).unionByName(outermost.select("_row", span.alias("x")))
    by_row = spans.groupBy("_row").agg(F.array_sort(F.collect_set("x")).alias("every"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    joined = scans.select("_id", "_row").join(by_row, "_row", "left").select(F.col("_id").alias(id_col), F.coalesce("every", none).alias("every"))
    return joined.select(id_col, F.filter("every", lambda x: x["kind"] < len(PATTERNS)).alias("base"), "every")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.documents(spark, sf_dir))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("every")).alias("spans"))
