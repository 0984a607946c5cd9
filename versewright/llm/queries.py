"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeats

    return repeats(table(spark, sf_dir, "documents")).drop("key")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import classes

    return classes(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import repaired

    return repaired(table(spark, sf_dir, "conversations"))


def op6_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weak_labels import scored

    return scored(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import report

    return report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import verdicts

    return verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


def op9_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .zip_warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL)).select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import digests, periodic_runs, planted

    return digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_audit import audit

    return audit(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged

    return judged(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_token_counts, op3_decontamination, op4_near_dedup, op5_chat_format,
        op6_weak_labels, op7_secret_scan, op8_quality_rules, op9_zip_warc, op10_piece_codec,
        op11_periodic_runs, op12_source_audit, op13_url_filter,
    )}


_WORD, _BLANK = "[^\\x20\\x09-\\x0D]", "[\\x20\\x09-\\x0D]"

_OP8 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
s as (select r, doc_id, t, regexp_extract_all(t, '{_WORD}+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as l from d),
e as (select r, unnest(w) as word, unnest(range(len(w))) as i from s),
g as (select r, i, word, lead(word, 1) over o as w1, lead(word, 2) over o as w2, lead(word, 3) over o as w3, lead(word, 4) over o as w4 from e window o as (partition by r order by i)),
c as (select r, i, count(*) over (partition by r, word, w1, w2, w3, w4) as n from g where w4 is not null),
p as (select r, count(distinct j) as n from (select r, unnest(range(i, i + 5)) as j from c where n > 1) group by r),
m as (select s.r, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
 len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(p.n, 0)::bigint as n_repeat_words,
 len(list_filter(l, lambda x: regexp_matches(x, '^{_BLANK}*[-*•]')))::bigint as n_bullet_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…){_BLANK}*$')))::bigint as n_cut_lines, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}')))::bigint as n_letter_words
 from s left join p on p.r = s.r),
b as (select *, (n_words < 10)::int + 2 * (100 * n_repeat_words > 20 * n_words)::int + 4 * (100 * n_symbols > 30 * n_words)::int + 8 * (n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines)::int
 + 16 * (n_words > 0 and (word_chars < 2 * n_words or word_chars > 16 * n_words))::int + 32 * (n_lines >= 4 and 100 * n_bullet_lines > 90 * n_lines)::int + 64 * (n_lines >= 4 and 100 * n_cut_lines > 30 * n_lines)::int + 128 * (100 * n_letter_words < 80 * n_words)::int as bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 as base_failed, (bits & 31) = 0 as kept, bits::bigint as fail_bits from b"""

_OP9 = """
with p as (select page_id, coalesce(html, '') as h from pages),
k as (select *, min(page_id) over (partition by h) as f, array_to_string(list_transform(string_split(upper(sha1(h)), ''), lambda c: right('000' || bin(strpos('0123456789ABCDEF', c) - 1), 4)), '') as bits from p)
select page_id, octet_length(encode(h))::bigint as payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: (substr(bits, (5 * i + j + 1)::bigint, 1) = '1')::int * [16, 8, 4, 2, 1][j + 1]))::bigint, 1)), '') as payload_digest,
 case when page_id = f then 'response' else 'revisit' end as record_type, case when page_id <> f then f end as refers_to from k"""


_OP12 = """
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term from t group by lang, term having count(distinct r) >= 10),
c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by all),
v as (select lang, count(*) as v from k group by lang),
g as (select lang, source, coalesce(any_value(v), 0)::hugeint as v, coalesce(sum(n), 0)::hugeint as total from (select distinct lang, source from d) left join c using (lang, source) left join v using (lang) group by all),
p as (select lang, source, term, coalesce(n, 0) as n, 1 + 1000000000::hugeint * (coalesce(n, 0) + 2) // (total + 2 * v) as p from g join k using (lang) left join c using (lang, source, term)),
l as (select lang, term, 1 + 1000000000::hugeint * (sum(n) + 2) // (max(total) + 2 * max(v)) as q from c join (select lang, sum(total) as total, max(v) as v from g group by lang) using (lang) group by lang, term),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
 union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p join l using (lang, term) where n > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from x)
select lang, source, part, item, value, rank from o where part = 'pair' or rank <= 10"""


def _op13() -> str:
    """Rules, features, training and scores in SQL: the descent is a recursive query over one row."""
    from . import url_filter as u

    gram = lambda c, n, part: f"list_transform(range(len({c}) - {n - 1}), lambda i: ({' + '.join(f'{c}[i + {j + 1}]::bigint * {u.BASE ** (n - 1 - j)}' for j in range(n))} + {10007 * (2 * n + part)}) % {u.BUCKETS})"
    grams = ", ".join(gram(c, n, part) for part, c in enumerate(("hc", "pc")) for n in u.SIZES)
    code = lambda x: f"list_concat([2], list_transform(regexp_extract_all({x}, '(?s).'), lambda c: unicode(c)), [3])"
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rules = sorted(u.RULES, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
    case = lambda out: " ".join(f"when {fits(h, p)} then '{out(h, p, v)}'" for h, p, v in rules)
    rows = ", ".join(f"('{x}', {y})" for x, y in u.labelled_rows())
    return f"""
with recursive lab as (select url, y::double as y from (values {rows}) v(url, y)),
src as (select url from pages where url is not null union select url from lab),
rest as (select url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from src),
part as (select url, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
coded as (select *, {code('host')} as hc, {code('path')} as pc from part),
f as materialized (select url, host, path, list_sort(list_distinct(flatten([{grams}]))) as x from coded),
r as (select list(y order by lab.url, y) as ys, list(x order by lab.url, y) as xs from lab join f using (url)),
k as materialized (select ys, xs, list_transform(xs, lambda a: list_transform(xs, lambda b: len(list_intersect(a, b)) / sqrt(len(a)::double * len(b)) + {u.CONSTANT ** 2})) as k from r),
it as (select 0 as t, list_transform(ys, lambda z: 0.0::double) as s from k
 union all select t + 1, list_transform(range(len(s)), lambda j: s[j + 1] + {u.STEP} * (ys[j + 1] - 1 / (1 + exp(-list_dot_product(k.k[j + 1], s))))) from it, k where t < {u.ROUNDS}),
e as (select unnest(xs) as x, unnest(s) as s from it, k where t = {u.ROUNDS}),
w as (select h, sum(w) as w from (select unnest(x) as h, round(s / sqrt(len(x)::double) * {u.UNIT})::bigint as w from e) group by h),
c as (select sum(round(s * {u.CONSTANT ** 2 * u.UNIT})::bigint) as c from e),
total as (select url, coalesce(sum(w), 0) as s from (select url, unnest(x) as h from f) left join w using (h) group by url),
j as (select f.url, host, path, coalesce(s, 0)::double + c.c::double * sqrt(len(x)::double) as s from f left join total using (url), c)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, case {case(lambda h, p, v: h + p)} end as rule,
 case {case(lambda h, p, v: v)} when s > 0 then 'block' else 'allow' end as verdict from pages left join j using (url)"""


def oracle_sql() -> dict[str, str]:
    """The other operators have no SQL form (sketches, other models, tokenizers, automata): tests hold them against brute force."""
    return {"op8_quality_rules": _OP8, "op9_zip_warc": _OP9, "op12_source_audit": _OP12, "op13_url_filter": _op13()}
