"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each document has a few signals, each higher for worse text. A rule rejects a document whose signal is above the
cutoff of its stratum (the language). Cutoffs come from labelled holdout documents: a cutoff is certified when an
exact binomial test shows that it rejects at most ``risk`` of the good documents of the stratum. The permitted share
of false rejections is divided over the signals, so that all rules of a stratum together keep within it, and the error
probability is divided over all strata and signals (Bonferroni); along one chain of cutoffs, lax to strict, the tests
are a fixed sequence and need no further correction. Of the certified cutoffs the one with the best balance of
rejected bad and good holdout documents is taken, the laxest on ties; where it gains nothing there is no rule. Too few
labels certify nothing, and then only the base rules reject.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, small, staged, words_array

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Distinct repeated windows of a text up to which they are looked up one by one; a matter of speed only.
FEW_REPEATS = 24
#: Texts of more bytes are counted as rows, in pieces of about so many characters.
LONG_BYTES, PIECE_CHARS = 1 << 20, 1 << 17
#: Permitted share of good documents rejected in a stratum, and the probability that this fails in any of them.
RISK, ERROR = 0.03, 0.05
#: A good holdout document that is rejected weighs as much as so many bad ones that are kept.
GOOD_WEIGHT = 10.0
#: Cutoffs of a share are (j / LEVELS) ** 2 and of the mean word length 4 + j / 2, for j from 1 to LEVELS.
LEVELS = 40
SIGNALS = ("symbol_share", "repeat_share", "dup_line_share", "upper_share", "bang_share", "mean_word")


def _left(text: Column, chars: str) -> Column:
    """The characters of the text that are in a regular expression's class."""
    return F.regexp_replace(text, f"[^{chars}]++", "")


def measured(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the counts of column ``text`` in a struct column ``m``; a null text counts as empty.

    Texts up to LONG_BYTES are measured where they are. Longer ones are written once and their words and windows counted
    as rows, piece by piece, so that no task holds the words of a whole long text.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0))
    number = fresh(rows, "number")
    long = staged(rows.where(size > LONG_BYTES).withColumn(number, F.monotonically_increasing_id()), "long")
    short = _measured_short(rows.where(size <= LONG_BYTES), text)
    return short if long.isEmpty() else short.unionByName(_measured_long(long, text, number))


def _measured_long(rows: DataFrame, text: str, number: str) -> DataFrame:
    """The same counts by rows of pieces, lines and windows; ``rows`` is a written table and ``number`` tells its rows apart."""
    texts = rows.select(F.col(number).alias("of"), F.col(text).alias("body"))
    space = r"\x20\x09-\x0D"
    # A piece ends before white space, and a longer word is a piece of its own.
    cut = F.regexp_extract_all("body", F.lit(rf"(?s).{{1,{PIECE_CHARS}}}(?=[{space}]|\z)|.+?(?=[{space}]|\z)"), 0)
    pieces = texts.select("of", F.posexplode(cut).alias("piece", "part"))
    words = staged(pieces.select("of", "piece", words_array(F.col("part")).alias("w")), "words")
    along = Window.partitionBy("of").orderBy("piece")  # the pieces of one text
    counted = words.select("of", "piece", F.size("w").cast("long").alias("n"), F.length(F.array_join("w", "")).cast("long").alias("chars"), F.slice("w", 1, 2).alias("head"), F.size("w").alias("k")).where("k > 0")
    # The windows of a piece run on into the next two words, which may lie in two pieces.
    ahead = F.slice(F.concat(F.coalesce(F.lead("head", 1).over(along), F.array()), F.coalesce(F.lead("head", 2).over(along), F.array())), 1, 2)
    placed = counted.withColumns({"before": F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "ahead": ahead}).select("of", "piece", "before", "ahead")
    joined = words.join(placed, ["of", "piece"]).select("of", "before", F.concat("w", "ahead").alias("w"))
    windows = joined.select("of", "before", F.posexplode(F.expr("if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))")).alias("i", "h")).select("of", (F.col("before") + F.col("i")).alias("i"), "h")
    again = windows.groupBy("of", "h").agg(F.count("*").alias("times"), F.min("i").alias("first"), F.max("i").alias("last")).where("times > 1")
    # Windows found twice are known by their ends; only those found more often are looked up.
    twice = again.select("of", F.explode(F.array("first", "last")).alias("i"))
    often = windows.join(again.where("times > 2").select("of", "h"), ["of", "h"], "left_semi").select("of", "i")
    repeated = twice.unionByName(often).select("of", F.explode(F.array(F.col("i"), F.col("i") + 1, F.col("i") + 2)).alias("i")).distinct().groupBy("of").agg(F.count("*").alias("n_repeat_words"))
    lines = texts.select("of", F.explode(F.split("body", "\n")).alias("line")).where(F.col("line").rlike(rf"[^{space}]"))
    lines = lines.groupBy("of", F.sha2("line", 256).alias("line")).agg(F.count("*").alias("n")).groupBy("of").agg(F.sum("n").alias("n_lines"), (F.sum("n") - F.count("*")).alias("n_dup_lines"))
    totals = counted.groupBy("of").agg(F.sum("n").alias("n_words"), F.sum("chars").alias("word_chars"))
    left = texts.select("of", _left(F.col("body"), f"A-Z!{SYMBOLS}").alias("c"))
    signs = left.select("of", *(F.length(_left(F.col("c"), k)).cast("long").alias(n) for n, k in (("n_symbols", SYMBOLS), ("n_upper", "A-Z"), ("n_bangs", "!"))))
    every = signs.join(totals, "of", "left").join(lines, "of", "left").join(repeated, "of", "left")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")
    counts = staged(every.select(F.col("of").alias("of_row"), F.struct(*(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names)).alias("m")), "long-counts")
    return rows.join(counts, F.col(number) == F.col("of_row")).select(*(c for c in rows.columns if c != number), "m")


def _measured_short(rows: DataFrame, text: str) -> DataFrame:
    """Counts of texts whose words fit into a task's memory many times.

    Repeated three-word windows are found by 64-bit hashes of the windows; only texts that hold a repeat are sorted.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = rows.withColumn("w", words_array(F.col(text))).withColumn("l", lines).withColumn("c", _left(body, f"A-Z!{SYMBOLS}"))
    two = one.withColumn("h", F.expr("if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"))
    three = two.withColumn("o", F.expr("if(size(array_distinct(h)) = size(h), cast(array() as array<bigint>), sort_array(h))"))
    four = three.withColumn("d", F.expr("array_distinct(filter(o, (x, j) -> x <=> get(o, j + 1)))"))
    # Few repeated windows are looked up for each position; many are found by sorting all windows with their positions.
    five = four.withColumn("s", F.expr(f"if(size(d) <= {FEW_REPEATS}, cast(array() as array<struct<h: bigint, i: int>>), sort_array(transform(h, (x, i) -> struct(x AS h, i AS i))))"))
    found = f"if(size(d) <= {FEW_REPEATS}, if(size(d) = 0, cast(array() as array<int>), filter(transform(h, (x, i) -> if(array_contains(d, x), i, -1)), i -> i >= 0)), transform(filter(s, (x, j) -> x.h <=> get(s, j - 1).h or x.h <=> get(s, j + 1).h), x -> x.i))"
    six = five.withColumn("r", F.expr(f"size(array_distinct(flatten(transform({found}, i -> array(i, i + 1, i + 2)))))"))
    counts = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(_left(F.col("c"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.col("r").cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.length(_left(F.col("c"), "A-Z")).cast("long").alias("n_upper"),
        F.length(_left(F.col("c"), "!")).cast("long").alias("n_bangs"),
    )
    # A generator of one row: filters and later expressions can't be pushed below it, so the counts are made once a row.
    return six.select(*rows.columns, F.explode(F.array(counts)).alias("m"))


def base_failed(m: str = "m") -> Column:
    n = F.col(f"{m}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * n)


def signal(name: str) -> Column:
    """A signal of the struct column ``m``; 0 where it has no base."""
    over = {
        "symbol_share": ("n_symbols", "word_chars"), "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
        "upper_share": ("n_upper", "word_chars"), "bang_share": ("n_bangs", "word_chars"), "mean_word": ("word_chars", "n_words"),
    }[name]
    top, base = (F.col(f"m.{c}") for c in over)
    return F.when(base > 0, top / base).otherwise(F.lit(0.0))


def cutoff(name: str, level: Column) -> Column:
    return 4 + level / 2 if name == "mean_word" else (level / LEVELS) * (level / LEVELS)


def _levels(name: str) -> Column:
    """How many cutoffs the signal is above: it is rejected at levels 1 to this one."""
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda j: signal(name) > cutoff(name, j.cast("double"))))


def thresholds(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``stratum`` and, for each signal, the certified cutoff or null; all labelled documents are the holdout.

    A document's label is the least ``quality`` that ``labels`` has for its id; ids without one, null ids and labels
    without a document don't count. Documents that fail the base rules never reach a cutoff and aren't part of the
    holdout.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("good"))
    rows = docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("body"))
    held = measured(rows.join(small(marks, labels.count()), "label_id"), "body").where(~base_failed())
    each = held.select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), _levels(s).alias("top")) for s in SIGNALS))).alias("x")).select("stratum", "good", "x.*")
    # A few hundred rows a stratum, used several times below: written, so that the texts are measured once.
    counts = staged(each.groupBy("stratum", "signal", "top").agg(F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("bad")), "counts")
    # A row for each level: what stands at or above it is rejected there. A stratum has at most LEVELS + 1 rows for each signal.
    lists = counts.groupBy("stratum", "signal").agg(F.collect_list(F.struct("top", "good", "bad")).alias("c"), F.sum("good").alias("n"), F.sum("bad").alias("n_bad"))
    at = lists.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEVELS)))).select(
        "stratum", "signal", "level", "n", "n_bad",
        *(F.expr(f"aggregate(filter(c, x -> x.top >= level), 0L, (a, x) -> a + x.{k})").alias(f"{k}_out") for k in ("good", "bad")),
    )
    strata = lists.agg(F.count_distinct("stratum").alias("strata"))
    share = risk / len(SIGNALS)
    grow = f"named_struct('t', a.t + ln((n - i + 1) / i) + {log(share / (1 - share))!r}D, 's', a.s)"
    start = f"n * {log(1 - share)!r}D"
    tail = (
        f"aggregate(if(good_out = 0, array(), sequence(1L, good_out)), named_struct('t', {start}, 's', {start}), (a, i) -> "
        f"transform(array({grow}), b -> named_struct('t', b.t, 's', greatest(b.s, b.t) + ln(1 + exp(-abs(b.s - b.t)))))[0], a -> a.s)"
    )
    tested = at.crossJoin(F.broadcast(strata)).withColumn("log_p", F.expr(f"if(good_out >= n * {share!r}D, 0D, {tail})"))  # one row of one number
    gain = F.col("bad_out") / F.greatest("n_bad", F.lit(1)) - GOOD_WEIGHT * F.col("good_out") / F.greatest("n", F.lit(1))
    passed = tested.where(F.col("log_p") <= F.lit(log(error)) - F.log(F.col("strata") * len(SIGNALS))).withColumn("gain", gain).where("gain > 0")
    best = passed.groupBy("stratum", "signal").agg(F.max(F.struct("gain", "level")).alias("b"))
    table = lists.select("stratum").distinct().join(
        best.groupBy("stratum").agg(*(F.max(F.when(F.col("signal") == s, cutoff(s, F.col("b.level").cast("double")))).alias(f"t_{s}") for s in SIGNALS)), "stratum", "left"
    )
    return table


def judged(docs: DataFrame, cutoffs: DataFrame, stratum: str = "lang", text_col: str = "text") -> DataFrame:
    """The whole row in ``row``, its counts in ``m``, ``base_failed`` and ``kept``. A stratum without cutoffs has the base rules only."""
    named = cutoffs.withColumnRenamed("stratum", "t_stratum")
    rows = measured(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("body"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")), "body").drop("body")
    joined = rows.join(small(named, cutoffs.count()), F.col("stratum") == F.col("t_stratum"), "left")
    over = F.lit(False)
    for s in SIGNALS:
        over = over | F.coalesce(signal(s) > F.col(f"t_{s}"), F.lit(False))
    return joined.select("row", "m", base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``, one row for
    each input row. A null or blank text has no words and fails the base rules; null ids stay null; a null language
    shares the stratum of the empty one. Texts of any length are counted whole. Further columns aren't returned. Empty tables give an empty result.
    """
    found = judged(docs.select("doc_id", "text", "lang"), staged(thresholds(docs, labels), "cutoffs"))
    return found.select("row.doc_id", *(f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def keep_passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    return judged(docs, staged(thresholds(docs, labels), "cutoffs")).where("kept").select("row.*")


def _oracle() -> str:
    share = RISK / len(SIGNALS)
    ratio = {"symbol_share": "n_symbols / word_chars", "repeat_share": "n_repeat_words / n_words", "dup_line_share": "n_dup_lines / n_lines", "upper_share": "n_upper / word_chars", "bang_share": "n_bangs / word_chars", "mean_word": "word_chars / n_words"}
    base = {s: r.split(" / ")[1] for s, r in ratio.items()}
    sig = ", ".join(f"CASE WHEN {base[s]} > 0 THEN {r.replace(' / ', '::DOUBLE / ')} ELSE 0 END AS {s}" for s, r in ratio.items())
    cut = {s: "4 + j / 2" if s == "mean_word" else f"(j / {LEVELS}.0) * (j / {LEVELS}.0)" for s in SIGNALS}
    long = " UNION ALL ".join(f"SELECT stratum, good, '{s}' AS signal, {s} AS v, j, {cut[s].replace('j', 'j::DOUBLE')} AS cut FROM held, range(1, {LEVELS + 1}) t(j)" for s in SIGNALS)
    over = " OR ".join(f"coalesce({s} > t_{s}, false)" for s in SIGNALS)
    pivot = ", ".join(f"max(cut) FILTER (WHERE signal = '{s}') AS t_{s}" for s in SIGNALS)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS body FROM documents),
p AS (SELECT doc_id, stratum, body, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM p WHERE len(w) >= 3)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM d) GROUP BY doc_id),
m AS (SELECT p.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, length(regexp_replace(body, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
  length(regexp_replace(body, '[^!]', '', 'g'))::BIGINT AS n_bangs FROM p LEFT JOIN r ON p.doc_id = r.doc_id),
s AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {sig} FROM m),
held AS (SELECT s.*, q.good FROM s JOIN (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) q ON s.doc_id = q.doc_id WHERE NOT base_failed),
lv AS (SELECT stratum, signal, j, cut, count(*) FILTER (WHERE good = 1) AS n, count(*) FILTER (WHERE good <> 1) AS n_bad,
  count(*) FILTER (WHERE good = 1 AND v > cut) AS good_out, count(*) FILTER (WHERE good <> 1 AND v > cut) AS bad_out FROM ({long}) GROUP BY ALL),
pv AS (SELECT *, CASE WHEN good_out >= n * {share!r} THEN 1 ELSE list_sum(list_transform(range(0, good_out + 1),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r})))) END AS p,
  bad_out / greatest(n_bad, 1) - {GOOD_WEIGHT} * good_out / greatest(n, 1) AS gain FROM lv),
best AS (SELECT stratum, signal, max_by(cut, (gain, j)) AS cut FROM pv
  WHERE gain > 0 AND p <= {ERROR} / ((SELECT count(DISTINCT stratum) FROM held) * {len(SIGNALS)}) GROUP BY stratum, signal),
th AS (SELECT stratum, {pivot} FROM best GROUP BY stratum)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept
FROM s LEFT JOIN th ON s.stratum = th.stratum"""


ORACLE = _oracle()
