"""Groups spelling variants by anagram hashing. DataFrame functions only.

A word's key is the sum of the fourth powers of its code points, so it is the same in whatever order its letters stand.
Taking one letter away changes the key by that letter's power: two words that differ by one inserted or deleted letter
meet where the longer one's key less a letter equals the shorter one's key, and two that differ by one exchanged letter
where both keys less a letter are equal. What meets has the right letters; their order is then verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, group_lookup, materialize, table_lookup

#: Letters of a word, in a regular expression's brackets, once A-Z are lower-cased.
LETTERS = r"a-zÀ-ÿ"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 97) -> DataFrame:
    """A row (word) for each maximal run of letters; from a run whose crc32(id:run) is divisible by ``noise`` one letter is deleted (0: from none)."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.split(ascii_lower(F.col(text_col)), f"[^{LETTERS}]+")).alias("w")).where("w <> ''")
    if not noise:
        return runs.select(F.col("w").alias("word"))
    h = F.crc32(F.concat("i", F.lit(":"), "w"))
    at = F.pmod(h, F.char_length("w")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.char_length("w")))
    return runs.select(F.when(h % noise == 0, cut).otherwise(F.col("w")).alias("word"))


def keyed(vocabulary: DataFrame) -> DataFrame:
    """vocabulary(word, n) plus key and letters: an array of the distinct (code, power). The fourth power of 255 times 2^31 letters still fits a long."""
    codes = F.transform(F.split("word", ""), lambda c: F.ascii(c).cast("long"))
    with_codes = vocabulary.withColumn("_c", codes)
    power = lambda c: c * c * c * c
    key = F.aggregate("_c", F.lit(0).cast("long"), lambda a, c: a + power(c))
    return with_codes.select("word", "n", key.alias("key"), F.transform(F.array_distinct("_c"), lambda c: F.struct(c.alias("code"), power(c).alias("power"))).alias("letters"))


def remains(word: Column, code: Column) -> Column:
    """The distinct strings that are left of word when one letter of that code is taken away; word itself for code 0."""
    places = F.filter(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.ascii(F.substring(word, i, F.lit(1))) == code)
    left = F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word))))
    return F.when(code == 0, F.array(word)).otherwise(F.array_distinct(left))


def near_pairs(vocabulary: DataFrame, group: int = 64) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of words of vocabulary(word, n; words distinct) that differ by exactly one inserted, deleted or replaced code point, each once.

    A word is sent to its key and to its key less each of its letters; rows of one value with different letters taken away
    are candidates, and an edit distance of one verifies them. A letter pair's powers have a sum that no other pair has, so
    a true pair meets at one value. Where more than ``group`` rows share a value (many words of the same letters), they also
    have to agree in the order of what remains: then as many rows meet as an alphabet has letters and a word places, however
    many words share the letters. A true pair agrees in that, and in one string only.
    """
    away = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("power"))), F.col("letters"))
    sent = keyed(vocabulary).select("word", "n", "key", F.explode(away).alias("x")).select((F.col("key") - F.col("x.power")).alias("value"), "word", "n", F.col("x.code").alias("code"))
    sent = materialize(sent, "values")
    sized = group_lookup(sent, ["value"], [("m", "count", "code")], spread="word").where("m > 1")
    sized = materialize(sized, "met")

    def join(rows: DataFrame, on: list[str]) -> DataFrame:
        a, b = rows.alias("a"), rows.alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
        met = a.join(b, [*same, F.col("a.code") < F.col("b.code"), F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1])
        return met.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))

    few = sized.where(F.col("m") <= group)
    many = sized.where(F.col("m") > group).withColumn("rest", F.explode(remains(F.col("word"), F.col("code"))))
    return join(few, ["value"]).unionAll(join(many, ["value", "rest"]))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): where the chain of forms ends. Each round doubles the steps taken; as every form is at least twice
    as frequent as its word, no chain has over 63 steps and no more than seven rounds are needed."""
    step = materialize(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        table = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = table_lookup(step, table, ["root"], spread="word")
        step = materialize(met.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "steps")
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")
        step = step.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3, ratio: int = 2, noise: int = 97, group: int = 64) -> DataFrame:
    """word, n, n_near, form, form_n, root: the corpus's words and the more frequent spelling that each is a variant of.

    Words are those of ``words`` with at least least_letters code points and least_count occurrences (n) over all documents.
    n_near counts the words one edit away (0 if none); form is the one of largest n (ties: smallest in code-point order) if that
    is at least ratio times the word's own, else null; root is where the chain of forms ends, the word itself without a form.
    Occurrences are summed up before they are shuffled, so a word of any frequency is one row a task. Null text has no words, a
    null id counts as an empty string; repeated rows count each time; other columns are ignored; no documents, no rows.
    """
    counted = words(docs, id_col, text_col, noise).where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    vocabulary = materialize(counted, "vocabulary")
    pair = near_pairs(vocabulary, group)
    sides = pair.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("o"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("o"), F.col("a_n").alias("m")))).alias("s")).select("s.*")
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "o")).alias("best"))
    found = vocabulary.join(near, "word", "left").withColumn("form_n", F.when(-F.col("best.m") >= ratio * F.col("n"), -F.col("best.m")))
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.o")).alias("form"), "form_n"), "forms")
    rooted = found.join(roots(found.where("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
