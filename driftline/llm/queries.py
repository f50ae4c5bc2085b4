"""The registered queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, decontam, divergence, html, jaccard, langid, licenses, secrets, substrings, suffixes, topk, warc

Query = Callable[[SparkSession, str], DataFrame]
RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests."""
    path = public_tokenizers.path(RANKS)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = docs.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    model = langid.learn(known.where("not held_out"))
    found = langid.predict(known.drop("lang"), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_copies(docs).select("doc_id", "n_shingles", "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and spans."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.scan(docs, keep=["doc_id"]))


def op5_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back and assembled."""
    return warc.per_page(warc.captures(spark, _table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.with_length(html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"]))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that a smaller document has."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    left = substrings.remove_repeats(docs, keep=["doc_id"])
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 400 that start twice or more."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    left = suffixes.remove_repeats(docs, keep=["doc_id"])
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every row whose id is divisible by 20."""
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold three quarters of a benchmark item, with the item."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that each uses more than its language."""
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named or quoted in every document."""
    return licenses.report(licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector, with their errors."""
    found = codes.compress(_table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_language_id, op3_jaccard_join, op4_secret_scan, op5_warc_roundtrip, op6_html_text, op7_substring_dedup, op8_suffix_dedup,
        op9_exact_topk, op10_decontamination, op11_source_divergence, op12_license_scan, op13_vector_codes,
    )
}

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_SHINGLES = "list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)"

_OWN_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _codes_sql() -> str:
    """Codes by plain joins: f holds the parts (p) of the vectors, b<i> the entries (e) after i rounds, a<i> who is nearest to which."""
    far = "list_sum(list_transform(list_zip(f.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = "a{0} as (select p, vec_id, x, arg_min(e, (far, e)) as e, min(far) as far from (select f.p, f.vec_id, f.x, b.e, " + far + " as far from f join b{0} b on f.p = b.p) group by 1, 2, 3)"
    means = "s{0} as (select p, e, k, sum(c) as c, count(*) as n from (select p, e, unnest(x) as c, unnest(range(len(x))) as k from a{0}) group by 1, 2, 3), m{0} as (select p, e, list((c // n - case when c % n < 0 then 1 else 0 end)::bigint order by k) as x from s{0} group by 1, 2), b{1} as (select b.p, b.e, coalesce(m.x, b.x) as x from b{0} b left join m{0} m using (p, e))"
    return f"""
        with v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             f as materialized (select vec_id, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] as x from v, unnest(range(16)) as u(p)),
             i as (select vec_id, row_number() over (order by vec_id) - 1 as e from v qualify e < 64),
             b0 as materialized (select p, e, x from f join i using (vec_id)),
             {nearest.format(0).replace("a0 as", "a0 as materialized")}, {means.format(0, 1).replace("b1 as", "b1 as materialized")},
             {nearest.format(1).replace("a1 as", "a1 as materialized")}, {means.format(1, 2).replace("b2 as", "b2 as materialized")},
             {nearest.format(2).replace("a2 as", "a2 as materialized")},
             h as (select sha256(string_agg(c::varchar, ',' order by p, e, k)) as codebooks_sha256 from (select p, e, unnest(x) as c, unnest(range(len(x))) as k from b2)),
             c as (select vec_id, string_agg(printf('%02x', e::int), '' order by p) as code, sum(far)::bigint as error from a2 group by 1)
        select c.vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from c join v using (vec_id) cross join h"""


ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": f"""
        with recursive d as (select doc_id, {_SHINGLES} as h from (select doc_id, {_OWN_WORDS.format(_LOWER)} as w from documents)),
             s as (select doc_id, len(h) as n, unnest(h) as x from d),
             o as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as shared from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
             l as (select a, b from o where 100 * shared >= 75 * (na + nb - shared)),
             e as (select a, b from l union select b, a from l),
             r as (select doc_id, doc_id as top from d union select e.b, r.top from r join e on e.a = r.doc_id where r.top < e.b)
        select d.doc_id, len(d.h)::bigint as n_shingles, c.component_id from d join (select doc_id, min(top) as component_id from r group by 1) c on c.doc_id = d.doc_id""",
    "op7_substring_dedup": f"""
        with d as (select doc_id, {_OWN_WORDS.format("coalesce(text, '')")} as w from documents),
             g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from d, unnest(range(1, len(w) - 11)) as t(i)),
             f as (select s, min(doc_id) as owner from g group by s),
             r as (select distinct doc_id, i + j as p from g join f on g.s = f.s, unnest(range(13)) as t(j) where doc_id > owner),
             o as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
             k as (select o.doc_id, string_agg(o.word, ' ' order by o.p) as kept, count(*) as n from o left join r on r.doc_id = o.doc_id and r.p = o.p where r.p is null group by 1)
        select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from d left join k on k.doc_id = d.doc_id""",
    "op9_exact_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score
                   from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
             r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, rank::int as rank, vec_id, score from r where rank <= 20""",
    "op10_decontamination": f"""
        with d as (select doc_id, unnest({_SHINGLES}) as s from (select doc_id, {_WORDS} as w from documents)),
             i as (select item_id, len(h) as n_item, unnest(h) as s from (select item_id, {_SHINGLES} as h from (select item_id, {_WORDS} as w from benchmark))),
             p as (select doc_id, item_id, n_item, count(distinct s) as n_shared from d join i using (s) group by all)
        select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment from p where 100 * n_shared >= 75 * n_item""",
    "op11_source_divergence": f"""
        with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
             o as (select r, lang, source, unnest(w) as term from d),
             k as (select lang, term from o group by all having count(distinct r) >= 30),
             v as (select lang, count(term) as v from (select distinct lang from d) left join k using (lang) group by 1),
             g as (select distinct lang, source from d),
             c as (select lang, source, term, count(*) as n from o join k using (lang, term) group by all),
             f as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
             p as (select *, 1 + 1000000000 * (n + 5)::bigint // (sum(n) over (partition by lang, source) + 5 * v)::bigint as p from f join v using (lang)),
             l as (select lang, term, sum(n) as n from p group by 1, 2),
             q as (select lang, term, 1 + 1000000000 * (n + 5)::bigint // (sum(n) over (partition by lang) + 5 * v)::bigint as q from l join v using (lang)),
             x as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
             e as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
             t as (select p.lang, p.source, 'term' as part, p.term as item, (p.p - q.q)::bigint as value from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q),
             s as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from e union all select * from t))
        select lang, source, part, item, value, rank::int as rank from s where part = 'pair' or rank <= 50""",
    "op12_license_scan": f"""
        with recursive t as (select * from (values {", ".join(f"({i}, '{t.label}', {str(t.phrase).lower()}, '{t.words}')" for i, t in enumerate(licenses.TEMPLATES))}) as v(template, label, phrase, body)),
             tw as (select template, label, phrase, string_split(body, ' ') as w from t),
             tg as (select template, label, phrase, len(w) as n, least(len(w), 3) as k, j - 1 as j, array_to_string(w[j:j + least(len(w), 3) - 1], ' ') as g from tw, unnest(range(1, len(w) - least(len(w), 3) + 2)) as u(j)),
             d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as w from documents),
             dg as (select r, i - 1 as i, array_to_string(w[i:i + k - 1], ' ') as g, k from d, unnest(range(1, len(w))) as u(i), (values (2), (3)) as s(k)),
             h as (select distinct r, template, label, phrase, n, tg.k, i - j as diagonal, j from dg join tg on dg.g = tg.g and dg.k = tg.k),
             m as (select *, lag(diagonal) over (partition by r, template order by diagonal) as prev from (select distinct r, template, phrase, diagonal from h)),
             c as (select r, template, diagonal, sum(case when prev is null or phrase or diagonal - prev > 3 then 1 else 0 end) over (partition by r, template order by diagonal) as cluster from m),
             b as (select r, template, label, phrase, n, cluster, diagonal + j as i, unnest(range(j, j + k)) as p from h join c using (r, template, diagonal)),
             s as (select r, label, phrase, min(i) as start, count(distinct p) / n as coverage from b group by r, template, label, phrase, n, cluster having 100 * count(distinct p) >= n * case when phrase then 100 else 75 end),
             a as (select r, count(*) filter (where phrase) as n_base, min(start) filter (where phrase) as first_word, max(start) filter (where phrase) as last_word, string_agg(distinct label, ',' order by label) filter (where phrase) as base_labels,
                   string_agg(distinct label, ',' order by label) as labels, max(coverage) as score from s group by r)
        select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score from d left join a using (r)""",
    "op13_vector_codes": _codes_sql(),
    "op5_warc_roundtrip": """
        with p as (select page_id, encode(coalesce(html, '')) as body from pages),
             d as (select page_id, octet_length(body)::bigint as payload_bytes, sha1(body) as payload_digest from p),
             g as (select payload_digest, max(page_id) as holder from d where payload_bytes >= 1000 group by 1)
        select d.page_id, payload_bytes, d.payload_digest,
               case when holder is not null and holder <> d.page_id then 'revisit' else 'response' end as record_type,
               case when holder is not null and holder <> d.page_id then holder end as refers_to,
               coalesce(pages.url, 'about:blank') as target_uri
        from d left join g on d.payload_digest = g.payload_digest and payload_bytes >= 1000 join pages on pages.page_id = d.page_id""",
}
