"""Quality rules with thresholds that follow the data.

Per document the operator derives integer statistics. For each language and
source it keeps a mergeable quantile sketch of every ratio: counts per bucket
of fixed resolution, so that two sketches merge by adding counts and a
language's sketch is the sum of its sources'. The threshold of a feature is the
`LEVEL` percent quantile of the sketch of (language, source), to which the
language's sketch is added with a weight of `PRIOR` rows: a source with few
rows takes its language's thresholds, one with many its own, with no step
between. A document above a threshold, or failing the base rules, is not kept.

Nulls: a null text has no words and fails the base rules; null language or
source form groups of their own. Empty texts: as null. Very long texts are
counted whole. Values equal to a threshold are inside. An empty table gives an
empty result. Repeated rows are judged one by one and count in the sketches.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, materialize, pick

WINDOW = 8
#: Percent of the rows of a group that lie at or below a threshold.
LEVEL = 98
#: Rows of its language that count with a source's own.
PRIOR = 100
FEATURES = ("symbol_pm", "dup_line_pm", "repeat_pm", "stutter_pm", "upper_pm", "mean_len")
#: Groups whose thresholds are broadcast at most, some 100 bytes each.
MAX_BROADCAST = 50_000
TOP = 1000
ALL = "\u0001all"
NONE = "\u0001none"


def _ratio(top: Column, bottom: Column, scale: int = 1000) -> Column:
    """Whole buckets of top / bottom, at most TOP; 0 for an empty bottom."""
    return F.when(bottom <= 0, F.lit(0)).otherwise(F.least(F.expr("1L") * top * scale / bottom, F.lit(float(TOP)))).cast("int")


def _without(text: Column, chars: str) -> Column:
    """Code points of the text that are not among chars."""
    return F.length(F.translate(text, chars, ""))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus __q_* columns: counts of words, characters, symbols, lines and repeats, and the bucketed ratios."""
    c = F.col
    t = F.coalesce(c(text), F.lit(""))
    df = docs.withColumn("__q_t", t)
    df = df.withColumn("__q_w", F.filter(F.split("__q_t", SPACE), lambda w: w != ""))
    df = df.withColumn("__q_lines", F.filter(F.split("__q_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("__q_wh", F.transform("__q_w", lambda w: F.xxhash64(w)))
    n = F.size("__q_w")
    df = df.withColumns({
        "__q_words": n.cast("long"),
        "__q_chars": _without(c("__q_t"), " \t\n\x0b\x0c\r").cast("long"),
        "__q_symbols": (F.length("__q_t") - _without(c("__q_t"), "#*$%&|<>")).cast("long"),
        "__q_upper": (F.length("__q_t") - _without(c("__q_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long"),
        "__q_n_lines": F.size("__q_lines").cast("long"),
        "__q_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        "__q_stutter": F.size(F.filter("__q_wh", lambda h, i: h == F.get("__q_wh", i - 1))).cast("long"),
        # 64-bit hashes of the windows; only documents with an equal pair go on to the positions
        "__q_g": F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("__q_wh", i + k) for k in range(WINDOW)]))),
    })
    df = df.withColumn("__q_sorted", F.when(F.size("__q_g") > F.size(F.array_distinct("__q_g")), F.array_sort(F.transform("__q_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("__q_at", F.sort_array(F.transform(F.filter("__q_sorted", lambda x, j: (x["h"] == F.get("__q_sorted", j - 1)["h"]) | (x["h"] == F.get("__q_sorted", j + 1)["h"])), lambda x: x["i"])))
    covered = F.aggregate(F.transform("__q_at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("__q_at", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("__q_repeat", F.coalesce(covered, F.lit(0)).cast("long"))
    df = df.drop("__q_t", "__q_w", "__q_lines", "__q_wh", "__q_g", "__q_sorted", "__q_at")
    return df.withColumns({
        "__q_failed": (c("__q_words") < 20) | (100 * c("__q_repeat") > 30 * c("__q_words")),
        "symbol_pm": _ratio(c("__q_symbols"), c("__q_chars")),
        "dup_line_pm": _ratio(c("__q_dup_lines"), c("__q_n_lines")),
        "repeat_pm": _ratio(c("__q_repeat"), c("__q_words")),
        "stutter_pm": _ratio(c("__q_stutter"), c("__q_words")),
        "upper_pm": _ratio(c("__q_upper"), c("__q_chars")),
        "mean_len": _ratio(c("__q_chars"), c("__q_words"), 10),
    })


def sketches(stats: DataFrame) -> DataFrame:
    """(k_lang, k_source, feature, bucket, n): the sketch of each group, and of each language under the source ALL.

    Columns of stats: k_lang, k_source and the features. The fine sketches are
    counted with map-side combining; the coarser ones merge them.
    """
    long = stats.select("k_lang", "k_source", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bucket")) for f in FEATURES])).alias("x"))
    fine = long.groupBy("k_lang", "k_source", F.col("x.feature").alias("feature"), F.col("x.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    both = fine.withColumn("k_source", F.explode(F.array("k_source", F.lit(ALL))))
    return both.groupBy("k_lang", "k_source", "feature", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per group with the threshold of every feature, max_<feature>."""
    own, lang = sketch.filter(F.col("k_source") != ALL), sketch.filter(F.col("k_source") == ALL).drop("k_source")
    rows = lang.groupBy("k_lang", "feature").agg(F.sum("n").alias("rows"))
    # counts times the rows of the language, so that the prior needs no division
    weighed = own.join(rows, ["k_lang", "feature"]).select("k_lang", "k_source", "feature", "bucket", (F.col("n").cast("double") * F.col("rows")).alias("w"))
    prior = own.select("k_lang", "k_source").distinct().join(lang, "k_lang").select("k_lang", "k_source", "feature", "bucket", (F.col("n").cast("double") * PRIOR).alias("w"))
    mixed = weighed.unionByName(prior).groupBy("k_lang", "k_source", "feature", "bucket").agg(F.sum("w").alias("w"))
    group = Window.partitionBy("k_lang", "k_source", "feature")
    at = mixed.withColumn("upto", F.sum("w").over(group.orderBy("bucket"))).withColumn("total", F.sum("w").over(group))
    inside = at.filter(100 * F.col("upto") >= LEVEL * F.col("total"))
    return inside.groupBy("k_lang", "k_source").agg(*[F.min(F.when(F.col("feature") == f, F.col("bucket"))).alias(f"max_{f}") for f in FEATURES])


def judge(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """stats plus `kept`: at or below the thresholds of its group, joined by language and source.

    limits is a stored table. It is broadcast up to MAX_BROADCAST groups; beyond them the join shuffles, and Spark splits a hot group.
    """
    if limits.count() <= MAX_BROADCAST:
        limits = F.broadcast(limits)
    within = F.lit(True)
    for f in FEATURES:
        within = within & (F.col(f) <= F.col(f"max_{f}"))
    return stats.join(limits, ["k_lang", "k_source"]).withColumn("kept", ~F.col("__q_failed") & within)


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"k_lang": F.coalesce("lang", F.lit(NONE)), "k_source": F.coalesce("source", F.lit(NONE))})


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id with its statistics, the base verdict and the adaptive verdict, one row per input row."""
    stats = materialize(with_statistics(_keyed(pick(docs, "doc_id", "text", "lang", "source"))).drop("text"), "quality")
    got = judge(stats, materialize(thresholds(sketches(stats)), "limits"))
    return got.select(
        "doc_id", F.col("__q_words").alias("n_words"), F.col("__q_chars").alias("word_chars"), F.col("__q_symbols").alias("n_symbols"),
        F.col("__q_dup_lines").alias("n_dup_lines"), F.col("__q_repeat").alias("n_repeat_words"), F.col("__q_failed").alias("base_failed"), "kept",
        *FEATURES, *[f"max_{f}" for f in FEATURES],
    )


def quality_filter(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows that quality_verdicts keeps, with the given columns; row by row, so repeated ids are no problem."""
    # stored once: the statistics serve the fences and the verdict, and the last filter is not pushed into their expressions
    rows = materialize(with_statistics(_keyed(pick(docs, *columns))), "quality")
    limits = materialize(thresholds(sketches(rows.select("k_lang", "k_source", *FEATURES))), "limits")
    return judge(rows, limits).filter("kept").select(*columns)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return quality_verdicts(table(spark, sf_dir, "documents")).drop(*FEATURES, *[f"max_{f}" for f in FEATURES])


def _sql() -> str:
    def ratio(top, bottom, scale=1000):
        return f"case when {bottom} <= 0 then 0 else cast(least(floor({top} * {scale} / {bottom}), {TOP}) as int) end"

    features = {"symbol_pm": ratio("n_symbols", "word_chars"), "dup_line_pm": ratio("n_dup_lines", "n_lines"), "repeat_pm": ratio("n_repeat_words", "n_words"), "stutter_pm": ratio("n_stutter", "n_words"), "upper_pm": ratio("n_upper", "word_chars"), "mean_len": ratio("word_chars", "n_words", 10)}
    longs = " union all ".join(f"select k_lang, k_source, '{f}' as feature, {f} as bucket from f" for f in features)
    limits = ", ".join(f"min(case when feature = '{f}' then bucket end) as max_{f}" for f in FEATURES)
    within = " and ".join(f"f.{f} <= l.max_{f}" for f in FEATURES)
    return f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(lang, chr(1) || 'none') as k_lang, coalesce(source, chr(1) || 'none') as k_source from documents),
w as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from t),
g as (select r, i, array_to_string(w[i + 1:i + 8], ' ') as g from w, unnest(range(0, len(w) - 7)) as u(i) where len(w) >= 8),
rep as (select r, i, lead(i) over (partition by r order by i) as nx from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1),
cov as (select r, sum(least(8, coalesce(nx - i, 8))) as n from rep group by r),
s as (select w.r, doc_id, k_lang, k_source, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars,
 cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as bigint) as n_upper,
 cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
 cast((select count(*) from unnest(range(2, len(w) + 1)) as u(i) where w[i] = w[i - 1]) as bigint) as n_stutter, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words
 from w left join cov using (r)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {", ".join(f"{e} as {f}" for f, e in features.items())} from s),
x as ({longs}),
own as (select k_lang, k_source, feature, bucket, count(*) as n from x group by all),
lang as (select k_lang, feature, bucket, sum(n) as n from own group by all),
total as (select k_lang, feature, sum(n) as n from lang group by all),
mix as (select own.k_lang, k_source, feature, bucket, cast(own.n as double) * total.n as w from own join total using (k_lang, feature)
 union all select g.k_lang, g.k_source, feature, bucket, cast(n as double) * {PRIOR} from (select distinct k_lang, k_source from own) g join lang using (k_lang)),
y as (select k_lang, k_source, feature, bucket, sum(w) as w from mix group by all),
z as (select *, sum(w) over (partition by k_lang, k_source, feature order by bucket) as upto, sum(w) over (partition by k_lang, k_source, feature) as total from y),
lim as (select k_lang, k_source, {limits} from z where 100 * upto >= {LEVEL} * total group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {within} as kept
from f join lim l using (k_lang, k_source)
"""


SQL = _sql()
