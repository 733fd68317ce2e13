"""Queries p3, p4, p7, p8 and p9, with SQL where SQL can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, nearest, packing, survivor, textstats, tokens
from tessera.session import cut
from tessera.tables import table


def _merged_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "ipo_event_terms_curated")
    conf = F.when(F.isnan("confidence"), None).otherwise(F.col("confidence"))
    share = F.when(conf > 1, conf / 100).otherwise(conf)
    real = F.col("source_doc_id").rlike("^D[0-9]{8}$")
    bundles = [
        survivor.Bundle("date", ["event_date"], F.year("event_date").between(2010, 2030)),
        survivor.Bundle("doc", ["source_doc_id", "source_url"], real),
        survivor.Bundle("passage", ["source_page", "source_text"], (F.col("source_page") > 0) & (F.trim("source_text") != ""), 1, 1),
        survivor.Bundle("standing", ["source_priority", "source_priority_rank"], F.col("source_priority").isNotNull() & F.col("source_priority_rank").isNotNull(), 3, 1),
        survivor.Bundle("review", ["status", "confidence"], F.col("status").isNotNull() & conf.isNotNull(), 2, 1),
        survivor.Bundle("stake", ["shares", "pct_of_offer", "pct_of_share_capital"], F.col("shares") > 0, 1, 1),
        survivor.Bundle("lockup", ["lockup_months"], F.col("lockup_months") >= 0, 1, 1),
    ]
    # A passage is of the chosen document, which has one source class; a review is of a record of that class.
    dependencies = [survivor.Dependency("doc", "passage", "source_doc_id"), survivor.Dependency("doc", "standing", "source_priority"), survivor.Dependency("standing", "review", "source_priority")]
    return survivor.survivors(
        terms, id="term_id",
        group={"stock_code": F.col("stock_code"), "event_type": F.col("event_type"), "party_key": survivor.party_key(F.col("party_name"))},
        trust=[F.coalesce("source_priority_rank", F.lit(2**31 - 1)), F.coalesce(-share, F.lit(2.0)), F.coalesce(-F.unix_micros(F.col("curated_at_utc").cast("timestamp")), F.lit(2**62))],
        bundles=bundles, dependencies=dependencies,
    )


def p3_merged(spark: SparkSession, folder: str) -> DataFrame:
    """One record per term, in whole bundles of fields: the combination that gives up least trust."""
    return _merged_terms(spark, folder)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Which rows the date, the document and the rest of each merged term come from."""
    return _merged_terms(spark, folder).select("group_id", "best_id", F.col("date_id").alias("date_term_id"), F.col("doc_id").alias("doc_term_id"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The usable tick nearest in time to each probe."""
    kind = lambda c: F.upper(F.trim(F.col(c)))
    ticks = table(spark, folder, "tick_events_ext").where("value > 0 and not isnan(value)")
    probes = table(spark, folder, "quote_probes")
    found = nearest.nearest_in_time(
        probes, ticks, probe_id="probe_id", probe_time="probe_time", tolerance_ms="tolerance_ms", record_id="tick_id", record_time="time",
        keys=[(F.col("stock_code"), F.col("stock_code")), (kind("wanted_type"), kind("event_type"))],
    )
    return found.select("probe_id", F.col("record_id").alias("tick_id"))


#: The word list is a fixed table; a longer one than this is refused rather than sent to every task.
MOST_COMMON_WORDS = 100_000


def p9_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, ratios and the prose rule for every document."""
    words = [r[0] for r in table(spark, folder, "common_words").select("word").limit(MOST_COMMON_WORDS + 1).collect()]
    if len(words) > MOST_COMMON_WORDS:
        raise ValueError("the list of common words is too long to be sent along")
    return textstats.text_statistics(table(spark, folder, "documents"), id="doc_id", text="text", common_words=words)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are for the greater part no running sentences."""
    return p9_stats(spark, folder).where("not is_prose").select("doc_id")


#: Containers of instruction data: a segment for every 16 tokens of capacity at most, and no more loss-bearing tokens than tokens.
SEGMENT_TOKENS = 16
MOST_PLANS = 1000


def _packed(spark: SparkSession, folder: str, max_loss) -> DataFrame:
    plans = [(r[0], int(r[1])) for r in table(spark, folder, "pack_capacities").where("capacity_tokens > 0").select("plan_name", "capacity_tokens").limit(MOST_PLANS + 1).collect()]
    if len(plans) > MOST_PLANS:
        raise ValueError("too many plans")
    counted = cut(tokens.with_tokens(table(spark, folder, "documents"), "text", {"doc_id": F.col("doc_id")}, lead=True))
    items = packing.pieces(counted, plans, ["doc_id"], "tokens", "lead_tokens")
    packed = packing.pack(items, id="doc_id", max_segments=F.greatest(F.lit(1), F.col("capacity") / SEGMENT_TOKENS), max_loss=max_loss)
    return packed.select(F.col("plan").alias("plan_name"), "doc_id", "piece", "start", F.col("size").alias("tokens"), F.col("loss").alias("loss_tokens"), "sequence_id")


def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The sequence of every document, or of each piece of one longer than a sequence, for each plan."""
    return _packed(spark, folder, F.col("capacity"))


#: For training on answers: at most this share of a sequence bears loss.
LOSS_SHARE = 0.75


def p7_packing_loss(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a limit on loss-bearing tokens that binds: three quarters of the capacity. A piece beyond it is alone in its sequence."""
    return _packed(spark, folder, F.floor(F.col("capacity") * LOSS_SHARE))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences, tokens and the share of room used, per plan."""
    plans = table(spark, folder, "pack_capacities")
    packed = p7_packing(spark, folder).groupBy("plan_name").agg(F.count_distinct("sequence_id").alias("sequences"), F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"))
    return packed.join(plans, "plan_name").select("plan_name", "sequences", "tokens", "documents", F.round(F.col("tokens") / (F.col("sequences") * F.col("capacity_tokens")), 6).alias("filled"))


def _packing_faults(packed: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Per plan: documents and texts in sequences, sequences beyond a limit, documents split without need or with a piece missing or twice."""
    plans = table(spark, folder, "pack_capacities")
    seq = packed.groupBy("plan_name", "sequence_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).join(plans, "plan_name")
    over = seq.groupBy("plan_name").agg(F.count_if((F.col("t") > F.col("capacity_tokens")) | (F.col("n") > F.greatest(F.lit(1), F.col("capacity_tokens") / SEGMENT_TOKENS))).alias("overfull"))
    docs = packed.groupBy("plan_name", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"), F.count_distinct("piece").alias("pieces")).join(plans, "plan_name")
    whole = (F.col("n") == F.ceil(F.col("t") / F.col("capacity_tokens"))) & (F.col("pieces") == F.col("n")) & (F.col("last") == F.col("n") - 1)
    return docs.groupBy("plan_name").agg(F.count(F.lit(1)).alias("documents"), F.count_if(~whole).alias("split_wrongly")).join(over, "plan_name")


def p7_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What the packing must not do, counted: every document with a text is in sequences, none beyond its limits or split without need."""
    return _packing_faults(p7_packing(spark, folder), spark, folder)


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    text, source = F.col("text"), F.col("source")
    carry = {"id": F.col("doc_id"), "copy": mixing.text_key(text), "own": mixing.source_key(source), "some": F.coalesce(F.length(text) > 0, F.lit(False))}
    # One pass over the texts: their tokens, and what finds their copies.
    counted = cut(tokens.with_tokens(table(spark, folder, "documents"), "text", carry))
    return mixing.mix(mixing.memberships(counted), table(spark, folder, "mix_targets"), least=LEAST_MIX)


#: A source that would shrink a mix below this share of all tokens gives only what it has.
LEAST_MIX = 0.1


def p8_uses(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used in each mix, and the source it counts for."""
    return _mixed(spark, folder).select("mix_name", F.col("id").alias("doc_id"), F.col("counted_as").alias("source"), "uses", "tokens")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of each mix, and the tokens that sources could not give."""
    return mixing.shares(_mixed(spark, folder), table(spark, folder, "mix_targets"))


def p8_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix must not do, counted per mix: documents used too often, or for a source that no copy of their text has; sources with documents and a share that are not used."""
    docs = table(spark, folder, "documents").select("doc_id", mixing.text_key(F.col("text")).alias("copy"), mixing.source_key(F.col("source")).alias("source"))
    goals = mixing.goals_of(table(spark, folder, "mix_targets"))
    uses = p8_uses(spark, folder).withColumnRenamed("source", "counted_as")
    used = uses.join(docs.select("doc_id", "copy"), "doc_id").join(docs.where("copy is not null").select("copy", F.col("source").alias("counted_as"), F.lit(True).alias("held")).distinct(), ["copy", "counted_as"], "left")
    per = used.join(goals.withColumnRenamed("source", "counted_as"), ["mix_name", "counted_as"])
    faults = per.groupBy("mix_name").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("used_too_often"), F.count_if(F.col("held").isNull()).alias("foreign"), F.count_distinct("counted_as").alias("sources_used"))
    return faults.select("mix_name", "used_too_often", "foreign", "sources_used")


def p9_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The plain counts behind the ratios, per document with a text."""
    return p9_stats(spark, folder).where("is_prose is not null").select("doc_id", "word_count", "mean_word_length", "punct_line_share")


QUERIES = {
    "p3_found": p3_found, "p3_merged": p3_merged, "p4_found": p4_found, "p7_packing": p7_packing, "p7_packing_loss": p7_packing_loss, "p7_fill": p7_fill, "p7_faults": p7_faults,
    "p8_uses": p8_uses, "p8_shares": p8_shares, "p8_faults": p8_faults, "p9_found": p9_found, "p9_stats": p9_stats, "p9_counts": p9_counts,
}

_CJK = "㐀-鿿豈-\\x{FAFF}"
#: White space as Python has it, with and without the line feed.
_INLINE = "\\t\\x{0b}-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_SPACE = "\\n" + _INLINE
_TERMS = """
with t as (
  select *, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(party_name), '[.''’]', '', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')),
    '( (limited|ltd|company|co|incorporated|inc|corporation|corp|lp|llp|llc|plc|l p))+$', ''), ' ', '', 'g') as party,
    case when confidence > 1 then confidence / 100 else confidence end as conf
  from ipo_event_terms_curated),
o as (
  select *, row_number() over (partition by stock_code, event_type, party
    order by source_priority_rank nulls last, conf desc nulls last, curated_at_utc desc nulls last, term_id) as pos from t)
"""
SQL = {
    "p3_found": _TERMS
    + """
select min(term_id) as group_id, min(term_id) filter (pos = 1) as best_id,
  coalesce(arg_min(term_id, pos) filter (year(event_date) between 2010 and 2030), -1) as date_term_id,
  coalesce(arg_min(term_id, pos) filter (regexp_full_match(source_doc_id, 'D[0-9]{8}')), -1) as doc_term_id
from o group by stock_code, event_type, party having count(*) > 1""",
    "p3_merged": _TERMS
    + """,
g as (select *, min(term_id) over (partition by stock_code, event_type, party) as gid, count(*) over (partition by stock_code, event_type, party) as "rows",
  case when isnan(confidence) then null else confidence end as some_conf from o),
docs as (select gid, pos, source_doc_id, source_priority from g where regexp_full_match(source_doc_id, 'D[0-9]{8}') qualify row_number() over (partition by gid order by pos) = 1),
passages as (
  select p.gid, min(p.pos) as pos from g p left join docs d using (gid)
  where p.source_page > 0 and trim(p.source_text) <> '' and (d.gid is null or p.source_doc_id = d.source_doc_id) group by p.gid),
standings as (select *, row_number() over (partition by gid order by pos) - 1 as place from (
  select gid, source_priority as cls, min(pos) as pos from g where source_priority is not null and source_priority_rank is not null group by 1, 2)),
reviews as (select *, row_number() over (partition by gid order by pos) - 1 as place from (
  select gid, source_priority as cls, min(pos) as pos from g where status is not null and some_conf is not null group by 1, 2)),
firsts as (select gid, arg_min(pos, place) as pos from reviews group by gid),
chosen as (
  select s.gid, s.pos as standing_pos, r.pos as review_pos from standings s left join reviews r on r.gid = s.gid and r.cls = s.cls left join docs d on d.gid = s.gid
  where d.source_priority is null or d.source_priority = s.cls
  qualify row_number() over (partition by s.gid order by 3 * s.place + 2 * coalesce(r.place, 1000000), s.place) = 1),
picked as (
  select gid, any_value(stock_code) as stock_code, any_value(event_type) as event_type, any_value(party) as party_key, any_value("rows") as "rows",
    min(pos) filter (year(event_date) between 2010 and 2030) as date_pos, min(pos) filter (shares > 0) as stake_pos, min(pos) filter (lockup_months >= 0) as lockup_pos
  from g where "rows" > 1 group by gid)
select k.stock_code, k.event_type, k.party_key, k.gid as group_id, b.term_id as best_id, k."rows",
  coalesce(a.term_id, -1) as date_id, a.event_date, coalesce(e.term_id, -1) as doc_id, e.source_doc_id, e.source_url,
  coalesce(f.term_id, -1) as passage_id, f.source_page, f.source_text, coalesce(h.term_id, -1) as standing_id, h.source_priority, h.source_priority_rank,
  coalesce(i.term_id, -1) as review_id, i.status, i.confidence, coalesce(j.term_id, -1) as stake_id, j.shares, j.pct_of_offer, j.pct_of_share_capital,
  coalesce(l.term_id, -1) as lockup_id, l.lockup_months
from picked k join g b on b.gid = k.gid and b.pos = 1 left join docs d on d.gid = k.gid left join passages q on q.gid = k.gid left join chosen c on c.gid = k.gid left join firsts t on t.gid = k.gid
  left join g a on a.gid = k.gid and a.pos = k.date_pos left join g e on e.gid = k.gid and e.pos = d.pos left join g f on f.gid = k.gid and f.pos = q.pos
  left join g h on h.gid = k.gid and h.pos = c.standing_pos left join g i on i.gid = k.gid and i.pos = case when c.gid is null then t.pos else c.review_pos end
  left join g j on j.gid = k.gid and j.pos = k.stake_pos left join g l on l.gid = k.gid and l.pos = k.lockup_pos""",
    "p4_found": """
select probe_id, arg_min(tick_id, (gap, tick_id)) as tick_id from (
  select p.probe_id, t.tick_id, abs(epoch_us(t.time) - epoch_us(p.probe_time)) as gap, p.tolerance_ms * 1000 as tol
  from quote_probes p join tick_events_ext t on t.stock_code = p.stock_code and upper(trim(t.event_type)) = upper(trim(p.wanted_type))
    and t.time between p.probe_time - interval 1 millisecond * p.tolerance_ms and p.probe_time + interval 1 millisecond * p.tolerance_ms
  where t.value > 0 and not isnan(t.value))
where gap <= tol group by probe_id""",
    # Every text that is not empty has a token at least.
    "p7_faults": """
select plan_name, (select count(*) from documents where length(text) > 0) as documents, 0 as split_wrongly, 0 as overfull from pack_capacities""",
    "p8_faults": """
with s as (select case when trim(source) = '' then null else regexp_replace(lower(trim(source)), '[-_\\s]+', '_', 'g') end as source from documents where length(text) > 0),
t as (select mix_name, regexp_replace(lower(trim(source)), '[-_\\s]+', '_', 'g') as source, sum(target_share) as share from mix_targets group by 1, 2)
select mix_name, 0 as used_too_often, 0 as foreign, count(*) filter (share > 0 and source in (select source from s where source is not null)) as sources_used from t group by mix_name""",
    "p9_counts": f"""
with d as (select doc_id, text, regexp_replace(text, '[{_CJK}]', ' ', 'g') as plain, len(regexp_extract_all(text, '[{_CJK}]')) as cjk from documents where regexp_matches(text, '[^{_SPACE}]')),
c as (select doc_id, cjk + len(regexp_extract_all(plain, '[^{_SPACE}]+')) as words, len(regexp_extract_all(text, '[^{_SPACE}]')) as chars,
  len(regexp_extract_all(text, '[^{_SPACE}][^\\n]*')) as lines, len(regexp_extract_all(text || chr(10), '[.!?。！？;；:：…"”’」』][{_INLINE}]*\\n')) as ended from d)
select doc_id, words as word_count, round(chars / words, 6) as mean_word_length, round(ended / lines, 6) as punct_line_share from c""",
}
