"""The registered queries of this package, each beside its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import chat, fingerprint, langid, line_dedup, mixing, negatives, ngram_join, packing, quality, repair, substring, suffix, warc
from fleetlens.llm.common import table
from fleetlens.session import durable

TOKENIZER = "word_bpe_49k.json"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_POSITION = "cast(('0x' || substr(md5({}), 1, {})) as bigint)"


@query(
    "op1_mix_sources",
    rf"""with sizes as (select doc_id, source, len({_WORDS}) as size from documents),
src as (select source, cast(sum(size) as bigint) as source_size, count(*) as documents,
  case row_number() over (order by source nulls last) % 3 when 1 then 3.0::double when 2 then 1.0::double else 2.0::double end as weight
  from sizes group by source),
filled as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(source_size * 2.0::double) over (order by source_size * 2.0::double / weight, source nulls last
    rows between unbounded preceding and 1 preceding), 0)) * weight
  >= source_size * 2.0::double * sum(weight) over (order by source_size * 2.0::double / weight, source nulls last rows between current row and unbounded following) as is_full
  from src),
goal as (select source, source_size, documents, case when is_full then source_size * 2.0::double
  else (1.5::double * sum(source_size) over () - coalesce(sum(case when is_full then source_size * 2.0::double end) over (), 0)) * weight
    / sum(case when is_full then 0 else weight end) over () end as target from filled),
placed as (select s.doc_id, s.source, s.size, g.source_size, g.target, row_number() over (partition by s.source
    order by {_POSITION.format("coalesce(cast(s.doc_id as varchar), '')", 8)} % cast(ceil(g.documents / 16384.0) as bigint), s.size, s.doc_id) as place,
  case when g.source_size > 0 then g.target / g.source_size else 0 end as each,
  {_POSITION.format("'mix' || coalesce('=' || s.source, '')", 4)} / 65536.0::double as offs
  from sizes s join goal g on s.source is not distinct from g.source)
select doc_id, source, size, source_size, target,
  cast(least(floor(each * place + offs) - floor(each * (place - 1) + offs), 2) as int) as copies,
  cast(least(floor(each * place + offs) - floor(each * (place - 1) + offs), 2) * size as bigint) as taken from placed""",
)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document that bring the sources to their target weights."""
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.word_count(F.col("text")))


_EXTRA = """select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'"""
_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|\|text\|>|\|turn\|>)', '\1\\\2\3', 'g')"


@query(
    "op6_chat_format",
    f"""with t as ({_EXTRA}),
n as (select *, row_number() over (partition by conv_id order by turn nulls last, role, text) as i,
  lag(role) over (partition by conv_id order by turn nulls last, role, text) as before from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  cast(3 + 4 + 7 + sum(length({_ESCAPED.format('text')}) + case when before = role then 8 else length({_ESCAPED.format('role')}) + 6 + 8 end
    + case when before is null or before = role then 0 else 7 end) as bigint) as formatted_chars
from n group by conv_id""",
)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, read back from the formatted text and its loss mask."""
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    extra = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("conv_id", "turn", "role", "text"))]) for r in rows]))
    planted = spark.range(1).select(extra.alias("r")).select("r.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    out = chat.format_chats(turns).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("pieces")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )  # fmt: skip


@query(
    "op8_line_quality",
    rf"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
lines as (select r, unnest(string_split(text, chr(10))) as l from d),
good as (select r, l from lines where regexp_matches(l, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) - count(distinct l) as n_dup_lines,
  sum(case when not regexp_matches(l, '[.!?:;…。！？"''”’»)\]][ \t\n\f\r\v]*$')
      or 10 * (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) > length(l)
      or regexp_matches(l, '^(?:[^|»›>\n]{{1,30}}[|»›>]){{2,}}|^[ \t\f\r\v]*(?:home|menu|next|previous|back|top)[ \t\f\r\v]*$')
      or regexp_matches(l, '(?i)lorem ipsum|javascript|cookie|terms of (use|service)|privacy policy|all rights reserved|copyright|subscribe|sign (in|up)|log ?in|click here|read more|share this|powered by')
    then length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) else 0 end) as lost from good group by r),
win as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as t from (select r, w, unnest(range(1, len(w) - 1)) as i from d)),
twice as (select r, i from (select r, i, count(*) over (partition by r, t) as n from win) where n > 1),
rep as (select r, count(distinct i + k) as n_repeat_words from twice, (values (0), (1), (2)) as v(k) group by r),
m as (select d.doc_id, len(d.w) as n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
  length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(dup.n_dup_lines, 0) as n_dup_lines, coalesce(rep.n_repeat_words, 0) as n_repeat_words, cast(coalesce(dup.lost, 0) as bigint) as lost_chars
  from d left join dup on d.r = dup.r left join rep on d.r = rep.r)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_chars <= 50 * word_chars as kept from m""",
)
def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the line-first quality rules."""
    return quality.judge(table(spark, sf_dir, "documents")).drop("cleaned")


@query(
    "op5_ngram_join",
    r"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as digest from sh group by doc_id),
cls as (select doc_id, n, min(doc_id) over (partition by digest) as rep from n),
rs as (select s, doc_id from sh where doc_id in (select rep from cls)),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from rs a join rs b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 80 * (x.n + y.n - k)),
edges as (select a as u, b as v from links union all select b, a from links union all select rep, doc_id from cls union all select doc_id, rep from cls),
reach(id, node) as (select doc_id, doc_id from cls union select id, v from reach join edges on node = u),
comp as (select id, min(node) as component_id from reach group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(comp.component_id, d.doc_id) as component_id
from d left join n on d.doc_id = n.doc_id left join comp on d.doc_id = comp.id""",
)
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.8 or more of their 5-word shingles."""
    return ngram_join.group(table(spark, sf_dir, "documents"))


@query(
    "op7_substring_dedup",
    rf"""with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
win as (select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as t from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
rep as (select r, i from (select r, doc_id, i, min(doc_id) over (partition by t) as least from win) where least < doc_id),
gone as (select distinct r, i + k as i from rep, range(13) as v(k)),
pos as (select r, w[i] as word, i from (select r, w, unnest(range(1, len(w) + 1)) as i from d)),
kept as (select pos.r, string_agg(word, ' ' order by pos.i) as t from pos anti join gone on pos.r = gone.r and pos.i = gone.i group by pos.r),
n as (select r, count(*) as n_removed from gone group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from d left join n on d.r = n.r left join kept on d.r = kept.r""",
)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after windows of 13 words that a document with a smaller id has are gone."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left after strings of 100 bytes that also start earlier are gone."""
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op2_warc_bundles",
    """with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as n, sha256(h) as digest from p),
f as (select *, case when n >= 100 then min(page_id) over (partition by digest) else page_id end as first from d)
select page_id, n as payload_bytes, digest as payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to from f""",
)
def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to seekable bundles and read back."""
    folder = warc.new_folder(spark)
    index = warc.write(table(spark, sf_dir, "pages"), folder)
    told = durable(warc.read(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    warc.remove_folder(spark, folder)
    return told


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.best_fit(table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a vocabulary file; every machine has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_fingerprint")
def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are."""
    out = fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out())
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query(
    "op11_line_dedup",
    r"""with d as (select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, id, i, ls[i] as line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select r, id, ls, unnest(range(1, len(ls) + 1)) as i from d)),
common as (select k, max(id) as last from l where length(k) >= 20 group by k having count(distinct id) >= 3),
judged as (select l.*, coalesce(common.last <> l.id, false) as gone from l left join common on l.k = common.k),
docs as (select r, count(*) as n_lines, count(*) filter (gone) as n_dropped, coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as kept from judged group by r)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from docs join d on docs.r = d.r""",
)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines of 20 characters or more that three documents have."""
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults planted by a checksum of conversation and turn. Nulls: one space."""
    blank = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _repair_sql() -> str:
    """The same search row by row, each state with its cost, edits and rows; ties by the edits."""
    least = lambda *options: f"list_sort(list_filter([{', '.join(options)}], lambda o: o is not null))[1]"  # noqa: E731
    edit = lambda x, cost, e, row: f"case when {x} is not null then struct_pack(c := {x}.c + {cost}, e := {x}.e || '{e}', r := {x}.r || {row}) end"  # noqa: E731
    add = lambda x, role: edit(x, 3, "I", f"['{role}:']")  # noqa: E731
    on = lambda x, when: f"case when {when} then {x} end"  # noqa: E731
    keep, change = "(case when fault = 'truncated' then 3 else 0 end)", "(case when fault = 'truncated' then 6 else 3 end)"
    live = "coalesce(fault not in ('blank', 'duplicate'), true)"
    kept = lambda x, initial: on(edit(x, keep, "K", "[role || ':' || text]"), f"{live} and role[1] = '{initial}'")  # noqa: E731
    changed = lambda x, role: on(edit(x, change, "R", f"['{role}:' || text]"), live)  # noqa: E731
    gone = lambda x: edit(x, 4, "D", "[]::varchar[]")  # noqa: E731
    state = "struct(c bigint, e varchar, r varchar[])"
    return rf"""with recursive
bits as (select list(c order by n) as t from (select n, list_reduce(list_prepend(n, range(8)), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end) as c from range(256) as x(n))),
coded as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
    lambda v, b: xor(v >> 8, bits.t[(xor(v, b) & 255) + 1])), 4294967295) % 20 as code from conversations, bits),
dam as (select conv_id, turn, case when code = 4 then 'user' else role end as role,
  case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when code = 3 then 2 else 1 end)) as copy from coded where code <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from dam),
f as (select *, case when not regexp_matches(text, '[^ 	-]') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][ 	-]*\z') then 'truncated' end as fault,
  coalesce(left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) not in ('su', 'ua', 'au'), false) as illegal,
  count(*) over (partition by conv_id) as n from o),
s(conv_id, i, z, s, u, a) as (
  select distinct conv_id, 0::bigint, struct_pack(c := 0::bigint, e := '', r := []::varchar[]), null::{state}, null::{state}, null::{state} from f
  union all
  select conv_id, i, {gone("z")}, {least(kept("z", "s"), gone("s"))},
    {least(gone("u"), kept("z", "u"), kept("s", "u"), kept("a", "u"), changed("z", "user"), changed("s", "user"), changed("a", "user"))},
    {least(gone("a"), kept("u", "a"), changed("u", "assistant"))}
  from (select conv_id, i, z, s, u, {least("a", add("u", "assistant"))} as a, role, text, fault
    from (select s.conv_id, f.i, s.z, s.s, {least("s.u", add("s.z", "user"), add("s.s", "user"), add("s.a", "user"))} as u, s.a, f.role, f.text, f.fault
      from s join f on s.conv_id is not distinct from f.conv_id and f.i = s.i + 1))),
ends as (select s.conv_id, {least("s.z", "s.a", add("s.u", "assistant"), add(f"({add('s.s', 'user')})", "assistant"))} as b
  from s join (select distinct conv_id, n from f) as l on s.conv_id is not distinct from l.conv_id and s.i = l.n),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal from f group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(b.c, 0)::bigint as cost, coalesce(b.e, '') as audit, sha256(coalesce(array_to_string(b.r, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) as c left join g on c.conv_id is not distinct from g.conv_id left join ends on c.conv_id is not distinct from ends.conv_id"""


@query("op12_conversation_repair", _repair_sql())
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations and the cheapest edits that repair their order of roles."""
    turns = table(spark, sf_dir, "conversations")
    edits = repair.repair(damaged(turns))
    of = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)  # noqa: E731
    steps = F.sort_array(F.collect_list(F.struct("step", "edit", F.when(F.col("edit") != repair.DELETE, F.concat("role", F.lit(":"), "text")).alias("row"))))
    told = edits.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.size(F.collect_set("turn")), F.lit(0)).cast("long").alias("gaps"), of("blank"), of("duplicate"), of("truncated"),
        F.count(F.when(F.col("illegal"), 1)).alias("illegal"), F.sum(repair.edit_cost(F.col("edit"), F.col("fault"))).alias("cost"), steps.alias("steps"),
    )  # fmt: skip
    told = told.select(
        F.col("conv_id").alias("of"), *[F.col(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join("steps.edit", "").alias("audit"), F.array_join(F.filter("steps.row", lambda x: x.isNotNull()), "\n").alias("repaired"),
    )  # fmt: skip
    out = turns.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))


@query(
    "op13_hard_negatives",
    """with r as (select row_number() over () as uid, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
p as (select a.uid, a.vec_id as anchor_id, b.uid as other, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from r a join r b on a.vec_id % 50 = 0 and a.uid <> b.uid),
pos as (select *, row_number() over (partition by uid order by score desc, vec_id, other) as k from p where same qualify k <= 5),
neg as (select pos.anchor_id, pos.vec_id as positive_id, row_number() over (partition by pos.uid, pos.k order by p.score desc, p.vec_id, p.other) as rank, p.vec_id as negative_id,
  pos.score as positive_score, p.score as negative_score from pos join p on pos.uid = p.uid and not p.same and 50 * pos.score <= 100 * p.score and 100 * p.score <= 95 * pos.score qualify rank <= 3)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from neg""",
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with some labels moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"))
