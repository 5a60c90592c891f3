"""Quality rules and cross-document line frequency, in column expressions only.

Rules look at one document: words, symbols, repeated lines, repeated runs of
WINDOW words. Lines are then compared across documents: each line is normalised
(lower case, digits to 0, runs of white space to one) and hashed, the documents
of a host (source) that hold it are counted, and lines in more than LINE_DOCS of
them are removed. A document that keeps too few of its words is rejected as
depleted.

Scale: one pass over the texts writes a slim table (numbers and line hashes);
all the rest works on that. Counts are pre-aggregated before they are shuffled.
To find each document's frequent lines, its lines are first gathered by line
and map partition, so a line that a third of all documents hold meets its count
once for each partition, not once for each document.

Edge cases: null text counts as no words and fails the rules; every row is a
document, so rows with the same id or text count each, and a line counts once
for each document however often it stands there; a null source is a host of its
own; a null doc_id is treated as any other; a very long text is read whole; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_key

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A line is removed if more documents of the host hold it.
LINE_DOCS = 10
#: Depleted: less than this share of the words is left.
LEAST_LEFT = 0.2

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that occurs twice or more in the array."""
    n = F.size(words)
    places = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(places, lambda i: F.xxhash64(*(words[i + j] for j in range(WINDOW))))

    def covered(hashed: Column) -> Column:
        pairs = F.array_sort(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: _twin(s, x, k)), lambda x: x["i"]))
        return _let(pairs, lambda s: _cover(starts(s)))

    def counted(hashed: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), F.lit(0)).otherwise(covered(hashed))

    return F.when(n < WINDOW, F.lit(0)).otherwise(_let(hashes, counted)).cast("long")


def _twin(s: Column, x: Column, k: Column) -> Column:
    same = lambda at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
    return same(k - 1) | same(k + 1)


def _cover(starts: Column) -> Column:
    """Words that windows at these sorted starts cover together."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]", "0"), BLANK + "+", " "))


def measured(docs: DataFrame) -> DataFrame:
    """One slim row for each document: the rules' numbers, and hash and words of each line with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id"), F.col("source").alias("host"), text.alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    split = own.select("doc_id", "host", "text", words.alias("words"), lines.alias("lines"))
    return split.select(
        "doc_id", "host", F.monotonically_increasing_id().alias("row"), _key(F.col("doc_id"), F.col("host"), F.col("text")).alias("key"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANK + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"))).alias("lines"),
    )


def failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def frequent_lines(slim: DataFrame) -> DataFrame:
    """host, line, n_docs of the lines in more documents of the host than LINE_DOCS."""
    lines = slim.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    return lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > LINE_DOCS)


def removed(slim: DataFrame) -> DataFrame:
    """row, lost (words in removed lines) and the hashes of its removed lines."""
    lines = slim.select("row", F.spark_partition_id().alias("part"), "host", F.explode("lines").alias("x"))
    # A list holds rows of one partition.
    held = lines.groupBy("part", "host", F.col("x.line").alias("line")).agg(F.collect_list(F.struct("row", F.col("x.n").alias("n"))).alias("rows"))
    often = frequent_lines(slim).select(F.col("host").alias("__host"), F.col("line").alias("__line"))
    met = held.join(often, F.col("host").eqNullSafe(F.col("__host")) & (F.col("line") == F.col("__line")))
    one = met.select("line", F.explode("rows").alias("r"))
    return one.groupBy(F.col("r.row").alias("row")).agg(F.sum("r.n").alias("lost"), F.collect_set("line").alias("removed_lines"))


def _key(doc_id: Column, host: Column, text: Column) -> Column:
    """The same for rows that agree in all three."""
    return F.xxhash64(row_key(doc_id, text), F.coalesce(host, F.lit("")), host.isNull())


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the rules' numbers, base_failed, lost, removed_lines (hashes), depleted, kept."""
    return _judged(docs).drop("key")


def _judged(docs: DataFrame) -> DataFrame:
    slim = materialise(measured(docs), "rules-slim")
    joined = slim.drop("lines", "host").join(removed(slim), "row", "left").withColumn("lost", F.coalesce("lost", F.lit(0).cast("long")))
    depleted = F.col("n_words") - F.col("lost") < LEAST_LEFT * F.col("n_words")
    return joined.select(
        "key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed().alias("base_failed"), "lost", "removed_lines", depleted.alias("depleted"), (~failed() & ~depleted).alias("kept"),
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id and text of kept documents without their removed lines; rows are told apart by id, source and text."""
    found = _judged(docs).where("kept").select(F.col("key").alias("__key"), "removed_lines").dropDuplicates(["__key"])
    gone = F.coalesce("removed_lines", F.array().cast("array<bigint>"))
    stays = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(gone, F.xxhash64(normalised(x))) | ~x.rlike("[^\\x20\\x09-\\x0D]"))
    own = docs.select("doc_id", "text", _key(F.col("doc_id"), F.col("source"), F.coalesce(F.col("text"), F.lit(""))).alias("__key"))
    return own.join(found, "__key").select("doc_id", F.array_join(stays, "\n").alias("text"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    word, blank = WORD, BLANK
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '{word}') AS words,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
        m AS (SELECT *, list_transform(range(greatest(len(words) - {WINDOW - 1}, 0)), lambda i: array_to_string(words[i + 1 : i + {WINDOW}], ' ')) AS windows FROM w),
        v AS (SELECT r, unnest(windows) AS win, unnest(range(len(windows))) AS i FROM m),
        t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM v) WHERE n > 1),
        c AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM t, range({WINDOW}) AS x(j) GROUP BY r),
        l AS (SELECT r, host, len(regexp_extract_all(line, '{word}')) AS n,
                     trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '{blank}+', ' ', 'g'), ' ') AS line
              FROM (SELECT r, host, unnest(lines) AS line FROM m)),
        o AS (SELECT host, line FROM l GROUP BY ALL HAVING count(DISTINCT r) > {LINE_DOCS}),
        g AS (SELECT r, sum(n)::BIGINT AS lost FROM l JOIN o ON l.line = o.line AND l.host IS NOT DISTINCT FROM o.host GROUP BY r),
        j AS (SELECT m.doc_id, len(words) AS n_words, length(regexp_replace(text, '{blank}+', '', 'g')) AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                     coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
              FROM m LEFT JOIN c USING (r) LEFT JOIN g USING (r))
        SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
               n_words - lost < {LEAST_LEFT} * n_words AS depleted,
               NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND NOT (n_words - lost < {LEAST_LEFT} * n_words) AS kept
        FROM j"""
