"""Host-level quality rules: failures by domain, shrunk by an empirical beta prior, joined back to documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A document fails with fewer words, or when more than so many per cent of its words stand in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Further failures, which count for the host's rate only: symbols, or repeated lines, for each 100 words.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 30, 30
#: A host's documents go when its shrunk failure rate is above the most; or so many of the prior's deviations above the prior's mean, and above the least.
HOST_DEVIATIONS, LEAST_HOST_RATE, MOST_HOST_RATE = 3.0, 0.3, 0.6
#: Bits for a word's position beside its window's hash; longer texts sort pairs instead.
POSITION_BITS = 20


def _covered(at: Column) -> Column:
    """Words under windows of three that start at the sorted positions."""
    return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df without text_col, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (null text: none).

    Windows of three words are told by hashes, their upper 44 bits in most texts; those that agree are compared word by word.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in df.columns if c != text_col]
    a = df.select(*rest, t.alias("_t"), F.filter(F.split(t, common.SPACE), lambda w: w != "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(common.WORD))
    a = a.select(*rest, "_w", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("_l"))
    w = F.col("_w")
    hashed = lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
    starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    short = F.size(w) < (1 << POSITION_BITS)
    packed = F.sort_array(F.transform(starts, lambda x, i: F.shiftleft(F.shiftright(hashed(x, i), POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform(starts, lambda x, i: F.struct(hashed(x, i).alias("h"), i.cast("long").alias("i"))))
    a = a.select(*rest, "n_words", "word_chars", "n_symbols", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.when(short, packed).alias("_s"), F.when(~short, pairs).alias("_p"), "_w")
    s, p = F.col("_s"), F.col("_p")
    high = lambda x: F.shiftright(x, POSITION_BITS)
    near = lambda a, x, i, f: f(F.get(a, i + 1)).eqNullSafe(f(x)) | f(F.get(a, i - 1)).eqNullSafe(f(x))
    mask = F.lit((1 << POSITION_BITS) - 1).cast("long")
    like = F.coalesce(F.transform(F.filter(s, lambda x, i: near(s, x, i, high)), lambda x: x.bitwiseAND(mask)), F.transform(F.filter(p, lambda x, i: near(p, x, i, lambda y: y["h"])), lambda x: x["i"]))
    a = a.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", like.alias("_c"), "_w")
    window = lambda i: F.array_join(F.slice(w, i.cast("int") + 1, 3), " ")
    a = a.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.sort_array(F.transform("_c", lambda i: F.struct(window(i).alias("g"), i.alias("i")))).alias("_g"))
    g = F.col("_g")
    at = F.sort_array(F.transform(F.filter(g, lambda x, i: near(g, x, i, lambda y: y["g"])), lambda x: x["i"]))
    a = a.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", at.alias("_at"))
    return a.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", _covered(F.col("_at")).alias("n_repeat_words"))


def host_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", deviations: float = HOST_DEVIATIONS, least_rate: float = LEAST_HOST_RATE, most_rate: float = MOST_HOST_RATE) -> DataFrame:
    """One row for each row of df: id_col, the five counts, base_failed, host_rate, kept.

    base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT of the words in repeated windows. A document counts
    against its host when that holds or it has too many symbols or repeated lines. Over the hosts' rates, mean and variance
    give a beta prior (by moments; of weight 1 if the rates don't vary); a host's rate is (failures + a) / (rows + a + b).
    kept: not base_failed, and the host's rate at most the prior's mean plus so many deviations, but no less than least_rate and no more than
    most_rate: hosts that are out of line with the others go, and those that mostly fail. A null host is a host; null ids and
    repeated rows are rows like any others; texts of any length are whole. An empty table gives an empty result.
    Counts are written once; hosts are aggregated with partial sums, and the join's hot hosts are split by adaptive execution.
    """
    plain = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(host_col).alias("_host"))
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    docs = word_counts(plain, "_text").withColumn("base_failed", base)
    docs = common.persisted(docs, "counts")
    fails = F.col("base_failed") | (F.col("n_symbols") * 100 > F.col("n_words") * MAX_SYMBOL_PERCENT) | (F.col("n_dup_lines") * 100 > F.col("n_words") * MAX_DUP_LINE_PERCENT)
    hosts = docs.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"), F.sum(fails.cast("long")).alias("_f"))
    rate = F.col("_f") / F.col("_n")
    hosts = common.persisted(hosts, "hosts")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    m, v = m or 0.0, v or 0.0
    weight = m * (1 - m) / v - 1 if v > 1e-12 and v < m * (1 - m) else 1.0
    highest = min(most_rate, max(least_rate, m + deviations * (m * (1 - m) / (weight + 1)) ** 0.5))
    shrunk = (F.col("_f") + m * weight) / (F.col("_n") + weight)
    out = docs.join(hosts.select(F.col("_host").alias("_of"), shrunk.alias("host_rate")), F.col("_host").eqNullSafe(F.col("_of")))
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("host_rate", 6).alias("host_rate"), (~F.col("base_failed") & (F.col("host_rate") <= highest)).alias("kept"))


SQL = rf"""
with w as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
ln as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from w),
g as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
d as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as c from g) where c > 1),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from d) group by 1),
c as (select w.doc_id, w.source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w join ln using (doc_id) left join r using (doc_id)),
b as (select *, n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} as base_failed from c),
h as (select source, count(*) as n, sum((base_failed or n_symbols * 100 > n_words * {MAX_SYMBOL_PERCENT} or n_dup_lines * 100 > n_words * {MAX_DUP_LINE_PERCENT})::int) as f from b group by 1),
m as (select avg(f / n) as m, var_pop(f / n) as v from h),
k as (select m, case when v > 1e-12 and v < m * (1 - m) then m * (1 - m) / v - 1 else 1.0 end as weight from m),
s as (select source, (f + m * weight) / (n + weight) as host_rate, least({MOST_HOST_RATE}, greatest({LEAST_HOST_RATE}, m + {HOST_DEVIATIONS} * sqrt(m * (1 - m) / (weight + 1)))) as highest from h cross join k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 6) as host_rate,
       not base_failed and host_rate <= highest as kept
from b join s on b.source is not distinct from s.source
"""
