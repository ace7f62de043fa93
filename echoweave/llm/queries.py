"""The operators applied to the tables of a dataset, one thin query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentence_pieces import round_trips

    return round_trips(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown_lm import score

    return score(read(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nn_descent import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import fingerprint_with_edits

    return fingerprint_with_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(read(spark, sf_dir, "embeddings"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digests

    return digests(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_suffix_array_dedup, op3_html_extraction, op4_url_filter, op5_best_fit_packing, op6_sentencepiece, op7_quality_classifier, op8_lm_scoring, op9_embedding_near_dedup, op10_document_fingerprints, op11_vector_codes, op12_pii, op13_collocations)}

#: DuckDB's form of the rules' outcome: the longest rule that fits, straight from their definition.
_RULES = "(values ('block','com','/en/'), ('allow','example.com','/en/7'), ('block','net','/de/'), ('allow','example.net','/de/8'), ('block','org','/es/')) r(verdict, rhost, rpath)"
ORACLE: dict[str, str] = {
    "op4_url_filter": f"""
with u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end rest from pages),
h as (select page_id, lower(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)) host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from u),
m as (select page_id, rhost || rpath rule, verdict, row_number() over (partition by page_id order by length(rhost || rpath) desc) rn
      from h join {_RULES} on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select h.page_id, host, path, rule, coalesce(verdict, 'allow') verdict from h left join m on h.page_id = m.page_id and rn = 1""",
}


def _codes_sql() -> str:
    """Lloyd's rounds over components as rows: members of a part meet the entries of its position, component by component."""
    first = """
with recursive kept as materialized (select row_number() over (order by vec_id nulls last, embedding) - 1 r, vec_id, label, [floor(4096 * x::double)::bigint for x in embedding] v from embeddings
        where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
c as materialized (select r, i // (len(v) // 8) p, i % (len(v) // 8) j, v[i + 1] x from (select r, v, unnest(range(len(v))) i from kept)),
b0 as materialized (select p, r e, j, x from c where r < 16)"""
    rounds = [first]
    for k in range(7):
        rounds.append(f"""d{k} as materialized (select r, p, e, sum((c.x - b.x) * (c.x - b.x))::bigint d from c join b{k} b using (p, j) group by r, p, e),
a{k} as materialized (select r, p, arg_min(e, (d, e)) e, min(d) d from d{k} group by r, p)""")
        if k < 6:
            rounds.append(f"""b{k + 1} as materialized (select p, e, j, coalesce(m.x, b.x) x from b{k} b left join
        (select p, e, j, floor(sum(x) / count(*))::bigint x from c join a{k} using (r, p) group by p, e, j) m using (p, e, j))""")
    return ",\n".join(rounds) + """,
s as (select sha256(string_agg(x::varchar, ',' order by p, e, j)) codebooks_sha256 from b6),
w as (select r, string_agg(printf('%02x', e::int), '' order by p) code, sum(d)::bigint error from a6 group by r)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from w join kept using (r), s"""


#: The patterns as the contract states them; of added ones, form and borders apart.
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _pii_sql() -> str:
    from .pii import ADDED, AGAINST, CHECKED, DIALLED, DISFAVOUR, FAVOUR, FOR, FORM, IBAN_LENGTHS, THRESHOLD

    patterns = _PII | {k: p for k, (_, p) in ADDED.items()}
    cells = "\nunion all ".join(f"select r, '{k}' source, unnest(range(len(g))) i, unnest(g) gap, unnest(m || [null]) match from (select r, string_split_regex(t, '{p}') g, regexp_extract_all(t, '{p}') m from d)" for k, p in patterns.items())
    near = lambda words: f"(regexp_matches(tail, '(?i)(?:^|[^A-Za-z])(?:{words})(?:$|[^A-Za-z])') or regexp_matches(after, '(?i)(?:^|[^A-Za-z])(?:{words})(?:$|[^A-Za-z])'))"
    luhn = "list_sum([case when i % 2 = 0 then substr(z, i + 1, 1)::int when substr(z, i + 1, 1)::int > 4 then 2 * substr(z, i + 1, 1)::int - 9 else 2 * substr(z, i + 1, 1)::int end for i in range(case when length(z) between 13 and 19 then length(z) else 0 end)]) % 10 = 0"
    lengths = "map {" + ", ".join(f"'{k}': {v}" for k, v in IBAN_LENGTHS.items()) + "}"
    apart = "not regexp_matches(tail, '[A-Za-z0-9]$') and not regexp_matches(after, '^[A-Za-z0-9]')"
    kinds = " ".join(f"when '{k}' then '{v}'" for k, (v, _) in ADDED.items())
    added = "', '".join(ADDED)
    order = "case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate((*_PII, "iban"))) + " end"
    listed = f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by {order}, s, e)"
    return f"""
with d as materialized (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
cells as (select *, length(gap) + coalesce(length(match), 0) long from ({cells})),
placed as materialized (select r, source, match, sum(long) over w - length(match) s, right(gap, 40) tail, left(lead(gap) over w, 40) after from cells window w as (partition by r, source order by i)),
cut as (select *, case when source = 'iban' then coalesce(regexp_extract(match, '^(?:[A-Z0-9] ?){{' || (l - 1) || '}}[A-Z0-9]'), '') else match end own from (select *, ({lengths})[left(match, 2)] l from placed) where match is not null),
spans as (select r, source, own m, s::bigint s, (s + length(own))::bigint e, tail, substr(match, length(own) + 1) || after after, reverse(regexp_replace(own, '[^0-9]', '', 'g')) z, replace(own, ' ', '') k from cut),
base as materialized (select r, source kind, s, e from spans where case source when 'email' then true
    when 'ip' then len([x for x in string_split(m, '.') if length(ltrim(x, '0')) > 3 or ('0' || right(x, 3))::int > 255]) = 0
    when 'card' then length(z) between 13 and 19 and {luhn} when 'phone' then length(z) between 9 and 15 else false end),
scored as (select *, case source {kinds} end kind, case
    when source = 'cards' and {apart} and length(z) between 13 and 19 and {luhn} then {CHECKED}
    when source = 'dialled' and {apart} and length(z) between 9 and 15 then {DIALLED}
    when source = 'local' and {apart} and not regexp_matches(tail, '[+(]?[0-9][\x20).-]*$') then {FORM}
    when source = 'iban' and {apart} and list_reduce([0] || [case when c between '0' and '9' then c::int else ascii(c) - 55 end for c in string_split(substr(k, 5) || left(k, 4), '')], lambda a, x: case when x > 9 then (a * 100 + x) % 97 else (a * 10 + x) % 97 end) = 1 then {CHECKED} end::double
    + case when case source when 'cards' then {near(FOR["card"])} when 'iban' then {near(FOR["iban"])} else {near(FOR["phone"])} end then {FAVOUR} else 0 end
    - case when {near(AGAINST)} then {DISFAVOUR} else 0 end score from spans where source in ('{added}')),
likely as materialized (select r, kind, s, e, source from scored where score >= {THRESHOLD}),
new as (select r, kind, s, e, false base from likely x where not exists (select 1 from base b where b.r = x.r and b.kind = x.kind and b.s < x.e and b.e > x.s)
    and not exists (select 1 from likely y where y.r = x.r and y.kind = x.kind and y.s < x.e and y.e > x.s and (y.s, -y.e, y.source) < (x.s, -x.e, x.source))),
whole as (select *, true base from base union all select * from new)
select doc_id, {", ".join(f"count(*) filter (base and kind = '{k}') n_{k}" for k in _PII)}, sha256({listed} filter (base), '')) base_sha256, {listed}, '') spans
from d left join whole using (r) group by d.r, doc_id"""


#: Phrases straight from their definition, by windows over the words of a piece.
_PHRASES_SQL = """
with pieces as (select row_number() over () piece, lang, t from (select coalesce(lang, 'und') lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) t from documents)),
t as materialized (select lang, w w1, lead(w) over p w2, lead(w, 2) over p w3 from (select piece, lang, unnest(w) w, generate_subscripts(w, 1) i from (select piece, lang, regexp_extract_all(t, '[^\x20\x09]+') w from pieces)) window p as (partition by piece order by i)),
f1 as materialized (select lang, w1, count(*) f from t group by all),
f2 as materialized (select lang, w1, w2, count(*) f from t where w2 is not null group by all),
f3 as materialized (select lang, w1, w2, w3, count(*) f from t where w3 is not null group by all having count(*) >= 10),
cuts as (select lang, w1 || ' ' || w2 phrase, c.f a, 1 k, x.f l, y.f r from f2 c join f1 x using (lang, w1) join f1 y on y.lang = c.lang and y.w1 = c.w2
         where c.f >= 10 and not exists (select 1 from f3 where f3.lang = c.lang and (f3.w1 = c.w1 and f3.w2 = c.w2 or f3.w2 = c.w1 and f3.w3 = c.w2) and 100 * f3.f >= 50 * c.f)
    union all select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f from f3 c join f1 x using (lang, w1) join f2 y on y.lang = c.lang and y.w1 = c.w2 and y.w2 = c.w3
    union all select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f from f3 c join f2 x using (lang, w1, w2) join f1 y on y.lang = c.lang and y.w1 = c.w3),
scored as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint score from cuts),
least as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a, l, r, n::bigint n, score
from least join (select lang, sum(f) n from f1 group by lang) using (lang) qualify "rank" <= 2000"""

ORACLE |= {"op11_vector_codes": _codes_sql(), "op12_pii": _pii_sql(), "op13_collocations": _PHRASES_SQL}
