"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import chosenpath, collocations, cotrain, crf, decontaminate, exact, lexical, packing, shards, simple8b, suffixes, urltree, warc
from feedlens.llm.shared import scratch
from feedlens.llm.tokens import tokenizer


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    # The archives are whole, so a gap would be a lost page.
    lost = F.raise_error(F.concat(F.lit("gap in "), "archive", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "reason")).cast("boolean")
    rows = warc.read(spark, path).where(F.when(F.col("status") == "ok", F.lit(True)).otherwise(lost))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    long = lambda c: F.when(F.length(number(c)) > 0, number(c).cast("long"))
    return rows.select(long("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", long("refers_to").alias("refers_to"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.assign(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "simple8b")
    simple8b.write(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json"), path)
    return simple8b.digests(spark, path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = crf.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    first = F.get("spans", F.lit(0))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"), first["start"].alias("first_start"), first["end"].alias("first_end"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.link(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return urltree.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), labels)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans", "kept")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents").select("lang", "text"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lexical")
    lexical.write(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return lexical.search(spark, path, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_quality, op3_exact_dedup, op4_sharding, op5_simple8b, op6_packing, op7_toxicity, op8_near_dedup, op9_decontamination, op10_url_filter, op11_suffix_dedup, op12_collocations, op13_lexical_search)}


_ASCII_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
     s as (select payload_digest as d, max(page_id) as stored from p where payload_bytes >= 1000 group by 1)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id < stored then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id < stored then stored end as refers_to
from p left join s on s.d = p.payload_digest
"""

OP3_SQL = f"""
with d as (select doc_id, {_ASCII_LOWER.format("text")} as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)
"""

#: Links from an inverted index of shingles, components by repeated minimum; slow beyond a few thousand documents.
OP8_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
     s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') || chr(0) else array_to_string(w[i : i + 4], ' ') end as t
           from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
     n as (select doc_id, count(*) as n from s group by 1),
     pairs as (select a.doc_id as u, b.doc_id as v, count(*) as common from s a join s b on a.t = b.t and a.doc_id <> b.doc_id group by 1, 2),
     links as (select u, v from pairs join n x on x.doc_id = u join n y on y.doc_id = v where 100 * common >= 85 * (x.n + y.n - common)),
     reach as (select doc_id as root, doc_id as node from d union select root, v from reach join links on u = node),
     c as (select node as doc_id, min(root) as component_id from reach group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from d left join n using (doc_id) join c using (doc_id)
"""


def _op10_sql(p: urltree.Params = urltree.Params(), depth: int = 8) -> str:
    """The template tree level by level, of paths of `depth` segments at most, more than the tables have; then branches of siblings bin by bin, and their purity."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
    parts = "string_split(regexp_replace(path, '^/', ''), '/')"
    ctes = [
        f"u as (select page_id, {host} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages)",
        "m as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels group by 1)",
        f"t0 as (select u.*, bad, '' as template, {parts} as parts from u left join m on page_id = doc_id)",
    ]
    for k in range(depth):
        ctes += [
            f"c{k} as (select host, template, parts[{k + 1}] as part, count(*) as n from t{k} where parts[{k + 1}] is not null group by 1, 2, 3)",
            f"w{k} as (select host, template from c{k} group by 1, 2 having count(*) filter (n <= {p.few_pages}) >= {p.min_children})",
            f"t{k + 1} as (select t.page_id, t.host, t.path, t.bad, t.parts, t.template || case when t.parts[{k + 1}] is null then '' when w.host is not null and c.n <= {p.few_pages} then '/*' else '/' || t.parts[{k + 1}] end as template "
            f"from t{k} t left join w{k} w on t.host = w.host and t.template = w.template left join c{k} c on t.host = c.host and t.template = c.template and t.parts[{k + 1}] = c.part)",
        ]
    cases = lambda value: "case " + " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{value(r)}'" for r in sorted(urltree.RULES, key=lambda r: (-len(r.text), -len(r.host), r.action))) + " end"
    ctes += [
        f"leaf as (select *, regexp_replace(template, '/[^/]*$', '') as parent, case when labelled > 0 then {p.bins} * bad // labelled else -1 end as bin from (select host, template, count(bad) as labelled, coalesce(sum(bad), 0)::bigint as bad from t{depth} group by 1, 2))",
        "bins as (select host, parent, bin, sum(labelled) as labelled, sum(bad) as bad, count(*) as kinds from leaf group by 1, 2, 3)",
        "ranked as (select host, parent, bin, bad::double / labelled as share, labelled::double / kinds as n, row_number() over (partition by host, parent order by bin) as k from bins where bin >= 0)",
        "walk as (select host, parent, bin, k, bin as branch, share as first_share, n as first_n from ranked where k = 1 union all "
        "select host, parent, bin, k, case when same then branch else bin end, case when same then first_share else share end, case when same then first_n else n end "
        f"from (select r.*, w.branch, w.first_share, w.first_n, r.share - w.first_share <= {p.z} * sqrt(((w.first_share * w.first_n + r.share * r.n) / (w.first_n + r.n)) * (1 - (w.first_share * w.first_n + r.share * r.n) / (w.first_n + r.n)) * (1 / w.first_n + 1 / r.n)) + 1e-9 as same "
        "from walk w join ranked r on r.host = w.host and r.parent = w.parent and r.k = w.k + 1))",
        "hosts as (select host, sum(labelled)::double as hl, sum(bad)::double as hb from leaf group by 1)",
        f"parents as (select host, parent, (pb + {p.prior} * ((hb + {p.prior * p.prior_bad}) / (hl + {p.prior}))) / (pl + {p.prior}) as parent_share from (select host, parent, sum(labelled)::double as pl, sum(bad)::double as pb from leaf group by 1, 2) join hosts using (host))",
        "steps as (select host, parent, bin, labelled, bad, coalesce(branch, -1) as branch from bins left join walk using (host, parent, bin))",
        f"pooled as (select host, parent, branch, (sum(bad)::double + {p.prior} * max(parent_share)) / (sum(labelled)::double + {p.prior}) as bad_share from steps join parents using (host, parent) group by 1, 2, 3)",
        "judged as (select leaf.host, leaf.template, bad_share from leaf join steps using (host, parent, bin) join pooled using (host, parent, branch))",
    ]
    return f"with recursive {', '.join(ctes)} select page_id, host, path, {cases(lambda r: r.text)} as rule, coalesce({cases(lambda r: r.action)}, case when bad_share >= {p.reject} then 'block' else 'allow' end) as verdict, template, bad_share from t{depth} join judged using (host, template)"


#: Every window of 200 bytes by its digest, the runs they cover, and what lies between the runs.
OP11_SQL = """
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
     w as (select r, s, md5(hex(b[s + 1 : s + 200])) as h from (select r, b, unnest(range(octet_length(b) - 199)) as s from d where octet_length(b) >= 200)),
     m as (select r, s from w where h in (select h from w group by 1 having count(*) > 1)),
     k as (select r, s, case when s <= lag(s) over (partition by r order by s) + 200 then 0 else 1 end as new from m),
     g as (select r, min(s) as a, max(s) + 200 as z from (select r, s, sum(new) over (partition by r order by s) as g from k) group by r, g),
     parts as (select r, coalesce(lag(z) over (partition by r order by a), 0) as lo, a as hi from g
               union all select d.r, coalesce(max(z), 0), octet_length(any_value(b)) from d left join g on g.r = d.r group by d.r),
     kept as (select r, unhex(string_agg(hex(b[lo + 1 : hi]), '' order by lo)) as k from parts join d using (r) group by r),
     n as (select r, sum(z - a) as n_removed, count(*) as n_spans from g group by r)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(k) as kept_sha256
from d join kept using (r) left join n using (r)
"""


OP12_SQL = f"""
with d as (select coalesce(lang, 'und') as lang, unnest(regexp_extract_all({_ASCII_LOWER.format("text")}, '[^.,;:!?\x0A-\x0D]+')) as piece from documents),
     p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from d),
     o as (select lang, w, unnest(range(1, len(w) + 1)) as i from p),
     g as (select lang, array_to_string(w[i : i + k - 1], ' ') as phrase, k, count(*) as f from o cross join range(1, 5) t(k) where i + k - 1 <= len(w) group by all),
     t as (select lang, sum(f)::bigint as n from g where k = 1 group by 1),
     c as (select lang, phrase, k, f, string_split(phrase, ' ') as w from g where k > 1 and f >= 30),
     cuts as (select lang, phrase, w, f, unnest(range(1, k)) as h from c),
     s as (select u.lang, u.phrase, u.f as a, h, x.f as l, y.f as r, ((2000000::hugeint * u.f) // (x.f + y.f))::bigint as score
           from cuts u join g x on x.lang = u.lang and x.phrase = array_to_string(u.w[:h], ' ') join g y on y.lang = u.lang and y.phrase = array_to_string(u.w[h + 1 :], ' ')),
     b as (select * from s qualify row_number() over (partition by lang, phrase order by score, h) = 1),
     v as (select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(f) as longer
           from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c)) group by 1, 2)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from b left join v using (lang, phrase) join t using (lang) where longer is null or 100::hugeint * longer < 80 * a qualify rank <= 2000
"""


_TERMS = "regexp_extract_all(" + _ASCII_LOWER + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP13_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS.format("text")} as w from documents),
     s as (select count(*) filter (len(w) > 0) as big_n, sum(len(w))::bigint as big_l from d),
     t as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by all),
     b as (select row_number() over () as q, item_id, {_TERMS.format("text")} as w from benchmark),
     i as (select distinct q, item_id, unnest(w) as term from b),
     f as (select term, count(*) as df from t where term in (select term from i) group by 1),
     v as (select term, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::bigint as weight from f, s),
     m as (select r, doc_id, 50 + (50 * len(w) * big_n) // big_l as m from d, s where big_l > 0),
     x as (select q, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
           from i join v using (term) join t using (term) join m using (r) group by all having sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) > 0)
select item_id, (row_number() over (partition by q order by score desc, doc_id, r))::int as rank, doc_id, score from x qualify rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_lexical_search": OP13_SQL, "op12_collocations": OP12_SQL, "op1_warc": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op8_near_dedup": OP8_SQL, "op10_url_filter": _op10_sql(), "op11_suffix_dedup": OP11_SQL}
