"""One registered query per operator, over whole tables, and the check SQL of those that SQL can express."""

import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgate.llm import (
    bpe, decontam, golay, importance, langid, probmin, quality, quotes, severity, sharding, topk, urls, variants)
from quillgate.llm.store import held_out, labelled_sample, small_batches, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def toxicity_model(docs, labels):
    """Fitted on a bounded sample of the labelled documents."""
    sample, _ = labelled_sample(docs, labels, "toxic", severity.PER_LABEL, withheld=False)
    return severity.fit(severity.grades_of(sample))


def quality_model(docs, labels):
    """Fitted on a bounded sample of the labelled documents that are not held out."""
    sample, counts = labelled_sample(docs, labels, "quality", quality.PER_LABEL)
    return quality.fit(sample, counts)


@query("op1_ball_tree_top_k", sql="""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) score
  from (select * from v where vec_id % 50 = 0) q join v c on q.vec_id <> c.vec_id),
r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) n from s)
select query_id, cast(n as integer) rank, vec_id, score from r where n <= 5""")
def op1_ball_tree_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


_PLAIN = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
#: Everything up to the linked messages ``m`` and their links ``g``, from rows conversations(conv_id, turn, role, text).
_QUOTES = rf"""
c as (
  select row_number() over () r, conv_id, turn, role, coalesce(text, '') t, md5(coalesce(text, '')) message from conversations
  where conv_id is not null and turn is not null),
l as (
  select r, conv_id, turn, role, message, i, regexp_extract(x, '^((?:[ \t]*>)+)', 1) marks,
    regexp_replace(x, '^((?:[ \t]*>)+)[ \t]?', '') body
  from (select *, unnest(regexp_split_to_array(t, '\r?\n')) x, generate_subscripts(regexp_split_to_array(t, '\r?\n'), 1) i from c)),
d as (select *, len(regexp_replace(marks, '[^>]', '', 'g')) depth, {_PLAIN.format("body")} plain from l),
e as (
  select *, depth = 0 and regexp_full_match(body, '[^>].*:\s*')
      and coalesce(lead(depth) over w, 0) > 0 announces,
    case when coalesce(lag(depth) over w, -1) <> depth then 1 else 0 end fresh
  from d window w as (partition by r order by i)),
o as (
  select r, conv_id, turn, role, message, max(depth) > 0 quotes,
    coalesce(string_agg(body, chr(10) order by i) filter (where depth = 0 and not announces), '') raw
  from e group by all),
m as (select *, case when quotes then regexp_replace(regexp_replace(raw, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+\z', '', 'g') else raw end own from o),
p as (
  select conv_id, turn, message, passage, depth, {_PLAIN.format("string_agg(plain, ' ' order by i)")} whole,
    list(plain order by i) || regexp_split_to_array(string_agg(plain, chr(10) order by i), '\n{{2,}}') parts
  from (select *, sum(fresh) over (partition by r order by i) passage from e
    where r in (select min(r) from c group by conv_id, turn, message)) where depth > 0 group by all),
s as (
  select distinct conv_id, turn, {_PLAIN.format("x")} k
  from (select conv_id, turn, unnest(string_split(own, chr(10)) || regexp_split_to_array(own, '\n\s*\n') || [own]) x from m)),
k as (select distinct conv_id, turn, message, passage, {_PLAIN.format("x")} k from (select *, unnest(parts) x from p)),
v as (
  select k.conv_id, k.turn, k.message, k.passage, arg_max(source, [n, source]) voted from (
    select conv_id, turn, message, passage, source, count(*) n from (
      select k.*, (select max(s.turn) from s where s.conv_id = k.conv_id and s.k = k.k and s.turn < k.turn) source from k where k.k <> '')
    where source is not null group by all) k group by all),
f as (
  select p.conv_id, p.turn, p.message, p.depth, coalesce(
    (select max(s.turn) from s where s.conv_id = p.conv_id and s.k = p.whole and s.k <> '' and s.turn < p.turn), v.voted) source
  from p left join v using (conv_id, turn, message, passage)),
g as (
  select conv_id, turn, message, count(*) n_passages, count(source) n_linked, max(depth) depth,
    max(case when depth = 1 then source end) outer_source
  from f group by all)"""
_LINKED = """
select m.conv_id, m.turn, m.role,
  cast(row_number() over (partition by m.conv_id order by m.turn, m.role, m.message) - 1 as bigint) as position,
  cast(coalesce(outer_source, max(m.turn) over (partition by m.conv_id order by m.turn range between unbounded preceding and 1 preceding)) as bigint) reply_to,
  cast(coalesce(n_passages, 0) as bigint) n_passages, cast(coalesce(n_linked, 0) as bigint) n_linked,
  cast(coalesce(g.depth, 0) as integer) as depth, m.own as text
from m left join g using (conv_id, turn, message)"""


@query("op2_quote_linking", sql="with " + _QUOTES + _LINKED)
def op2_quote_linking(spark, sf_dir):
    return quotes.linked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: Conversations in which every third message quotes the one before: whole, its first half, or its words in other lines.
_REPLIES = """
told as (
  select conv_id, turn, role, coalesce(text, '') as text, coalesce(lag(text) over (partition by conv_id order by turn), '') as before from conversations),
quoting as (
  select conv_id, turn, role, case when turn % 3 <> 2 or before = '' then text
    when conv_id % 3 = 0 then 'You wrote:' || chr(10) || '> ' || replace(before, chr(10), chr(10) || '> ') || chr(10) || text
    when conv_id % 3 = 1 then '> ' || replace(before, chr(10), chr(10) || '> ') || chr(10) || '> and more' || chr(10) || chr(10) || text
    else '> > ' || replace(replace(before, ' ', '  '), '.', ' !') || chr(10) || text || chr(10) || '> not said by anyone' end as text
  from told)"""
_REPLY_SQL = "with " + _REPLIES + "," + _QUOTES.replace("from conversations", "from quoting")


def _replies(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = rows.withColumn("before", before)
    marked = F.concat(F.lit("> "), F.replace("before", F.lit("\n"), F.lit("\n> ")))
    return rows.select("conv_id", "turn", "role", F.when((F.col("turn") % 3 != 2) | (F.col("before") == ""), F.col("text")).when(
        F.col("conv_id") % 3 == 0, F.concat(F.lit("You wrote:\n"), marked, F.lit("\n"), "text")).when(
        F.col("conv_id") % 3 == 1, F.concat(marked, F.lit("\n> and more\n\n"), "text")).otherwise(F.concat(
            F.lit("> > "), F.replace(F.replace("before", F.lit(" "), F.lit("  ")), F.lit("."), F.lit(" !")), F.lit("\n"), "text", F.lit("\n> not said by anyone"))).alias("text"))


@query("quotes_in_replies", sql=_REPLY_SQL + _LINKED)
def quotes_in_replies(spark, sf_dir):
    """The same over conversations of the table in which messages quote others."""
    return quotes.linked(_replies(spark, sf_dir))


@query("chats_without_quotes", sql=_REPLY_SQL + """, linked as (""" + _LINKED + """)
select conv_id, position // 256 as piece, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || text || chr(10), '' order by position) as chat
from linked group by all""")
def chats_without_quotes(spark, sf_dir):
    """Formatted conversations, in reply order and without quotes."""
    return quotes.formatted(_replies(spark, sf_dir))


#: The contract's list: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op3_url_digests", sql=f"""
with rules(rule_host, rule_path, verdict) as (values {", ".join(map(str, URL_RULES))}),
u as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path
  from pages),
m as (
  select page_id, host, path, max_by(rule_host || rule_path, len(rule_host || rule_path)) rule,
    max_by(verdict, len(rule_host || rule_path)) verdict
  from u left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by all)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from m""")
def op3_url_digests(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", urls.url_verdict(spark, URL_RULES, F.col("url")).alias("u")).select("page_id", "u.*")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op4_suffix_decontamination", sql=f"""
with d as (select row_number() over () r, doc_id, coalesce({_WORDS}, []) w from documents),
b as (select cast(item_id as varchar) item_id, {_WORDS} w from benchmark where text is not null),
g as (
  select distinct item_id, 13 n, array_to_string(w[i:i + 12], ' ') t
  from (select item_id, w, unnest(range(1, len(w) - 11)) i from b where len(w) >= 13)
  union
  select distinct item_id, len(w), array_to_string(w, ' ') from b where len(w) between 1 and 12),
p as (
  select r, n, i, array_to_string(w[i:i + n - 1], ' ') t
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from g) where len(w) >= n)),
h as (select p.r, p.n, p.i, g.item_id from p join g on p.n = g.n and p.t = g.t),
words as (select r, count(distinct k) n_hit from (select r, unnest(range(i, i + n)) k from (select distinct r, n, i from h)) group by r),
found as (
  select r, count(*) n_items, string_agg(item_id, ',' order by item_id) ids
  from (select distinct r, item_id from h where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join words using (r) left join found using (r)""")
def op4_suffix_decontamination(spark, sf_dir):
    found = decontam.match_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "m.n_words", "m.n_hit", F.size("m.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("m.items", ",").cast("binary"), 256).alias("items_sha256"),
        decontam.contaminated(F.col("m")).alias("contaminated"))


@query("op10_near_duplicates")
def op10_near_duplicates(spark, sf_dir):
    return probmin.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query("op5_quality_vote")
def op5_quality_vote(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), quality.quality(model, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


@query("op6_byte_cnn_language")
def op6_byte_cnn_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    found = docs.select("doc_id", held_out("doc_id").alias("held_out"), langid.language(model, F.col("text")).alias("l"))
    return found.select("doc_id", "held_out", "l.lang_pred", "l.score")


@query("op7_bpe_transducer")
def op7_bpe_transducer(spark, sf_dir):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = bpe.coded(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op8_jump_shards")
def op8_jump_shards(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)


@query("op9_toxicity_severity")
def op9_toxicity_severity(spark, sf_dir):
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", severity.severity(model, F.col("text")).alias("s")).select("doc_id", "s.severity", "s.grade", "s.toxic")


@query("op11_golay_simhash")
def op11_golay_simhash(spark, sf_dir):
    return golay.near_duplicates(table(spark, sf_dir, "documents"))


#: crc32 of every distinct string of ``names(f)``: the xor of one table value for each byte by its place from
#: the end, and of what the start value becomes over so many zero bytes.
_CRC = """
longest as (select coalesce(max(octet_length(encode(f))), 0) most from names),
bits as (
  select cast(b as ubigint) b, cast(b as ubigint) v, 0 i from range(256) as t(b)
  union all select b, case when v % 2 = 1 then xor(v >> 1, cast(3988292384 as ubigint)) else v >> 1 end, i + 1 from bits where i < 8),
bytes as (select b, v, printf('%02X', cast(b as integer)) pair from bits where i = 8),
shifted as (
  select 0 place, pair, v from bytes
  union all select place + 1, s.pair, xor(s.v >> 8, t.v) from shifted s join bytes t on t.b = s.v % 256 where place < (select most from longest)),
started as (
  select 0 place, cast(4294967295 as ubigint) v
  union all select place + 1, xor(s.v >> 8, t.v) from started s join bytes t on t.b = s.v % 256 where place < (select most from longest)),
spelt as (select f, hex(encode(f)) h, octet_length(encode(f)) n from names),
placed as (select f, n, substr(h, 2 * i + 1, 2) pair, n - 1 - i place from (select *, unnest(range(n)) i from spelt)),
crc as (
  select f, xor(xor(bit_xor(s.v), any_value(z.v)), cast(4294967295 as ubigint)) h
  from placed p join shifted s using (place, pair) join started z on z.place = p.n group by f)"""


@query("op12_importance_resampling", sql=f"""
with recursive d as (select row_number() over () r, doc_id, coalesce({_WORDS}, []) w from documents),
e as (select coalesce({_WORDS}, []) w from benchmark),
df as (select r, f, count(*) n from (
  select r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) f from d) group by all),
ef as (select f, count(*) n from (
  select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) f from e) group by all),
names as (select f from df union select f from ef),{_CRC},
b as (select f, cast(h % 10000 as integer) bucket from crc),
s as (select bucket, sum(n) n from df join b using (f) group by all),
t as (select bucket, sum(n) n from ef join b using (f) group by all),
g as (
  select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double
    / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double))) gain
  from s full join t using (bucket)),
w as (select r, sum(n) n_features, floor(sum(n * gain) / sum(n)) weight from df join b using (f) join g using (bucket) group by r),
x as (
  select r, doc_id, len(w) n_words, cast(coalesce(n_features, 0) as bigint) n_features, cast(coalesce(weight, 0) as bigint) weight,
    ('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint::double h
  from d left join w using (r)),
y as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) as bigint) score from x),
z as (select r, row_number() over (order by score desc, doc_id) k from y where n_words >= 20)
select doc_id, n_features, weight, score, case when k <= (select 25 * count(*) // 100 from z) then k end as rank
from y left join z using (r)""")
def op12_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_spelling_variants", sql=f"""
with recursive runs as (
  select r, count(*) n, coalesce(cast(doc_id as varchar), '') || ':' || r f from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) r
    from documents)
  where length(r) >= 6 group by doc_id, r),
names as (select distinct f from runs),{_CRC},
thinned as (
  select case when h % 199 = 0 then substr(r, 1, cast(h % length(r) as bigint)) || substr(r, cast(h % length(r) as bigint) + 2) else r end word, n
  from runs join crc using (f)),
words as (select word, cast(sum(n) as bigint) n from thinned where length(word) >= 6 group by word having sum(n) >= 5),
rests as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) rest from (select *, unnest(range(1, length(word) + 1)) i from words)),
near as (
  select a.word a, b.word b, b.n from rests a join rests b on a.i = b.i and a.rest = b.rest and length(a.word) = length(b.word) and a.word <> b.word
  union select a.word, b.word, b.n from rests a join words b on a.rest = b.word
  union select b.word, a.word, a.n from rests a join words b on a.rest = b.word),
best as (select a word, count(*) n_near, max(n) form_n from near group by a),
ties as (select a word, min(b) form from near join best on a = best.word and n = form_n group by a),
forms as (
  select word, n, coalesce(n_near, 0) n_near, case when form_n >= 5 * n then form end form, case when form_n >= 5 * n then form_n end form_n
  from words left join best using (word) left join ties using (word)),
ways as (
  select word, word root, 0 k from forms
  union all select w.word, f.form, k + 1 from ways w join forms f on w.root = f.word where f.form is not null)
select word, form, (select arg_max(root, k) from ways w where w.word = forms.word) root, n, n_near, form_n from forms""")
def op13_spelling_variants(spark, sf_dir):
    return variants.spelling_variants(table(spark, sf_dir, "documents"))
