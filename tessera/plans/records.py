"""Queries over tables of records, and the streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import events, registry
from tessera.plans.common import rounded
from tessera.session import scratch
from tessera.streaming import bars as streams
from tessera.tables import table

PATTERNS = {"prospectus": "prospectus", "announcement": "^The Company announced", "newswire": "^Desk note", "vendor": "^Vendor field"}
KEYS = ["stock_code", "event_type", "event_date", "source_doc_id"]


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ipo_event_terms_curated")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def registry_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The records before the latest run with those of the latest run put in their place."""
    t = _terms(spark, folder).where("stock_code is not null and event_type is not null and event_date is not null and source_doc_id is not null")
    new = events.latest_run(t)
    old = t.join(new.select("run_id").distinct(), "run_id", "left_anti")
    return registry.upsert(old, new, KEYS).select("term_id", *KEYS)


def artifact_index(spark: SparkSession, folder: str) -> DataFrame:
    """The last record of each document."""
    t = _terms(spark, folder).where("source_doc_id is not null").select("source_doc_id", "curated_at_utc", "term_id", "status")
    return registry.last_version(t, ["source_doc_id"], ["curated_at_utc", "term_id"])


def registry_search(spark: SparkSession, folder: str) -> DataFrame:
    return registry.search(_terms(spark, folder), status="ok", source_priority_rank="1").select("term_id", "status", "source_priority_rank")


def reports_recent(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 latest documents that are no chat, newest first (a top-k list)."""
    return registry.recent(_docs(spark, folder).where("published_at is not null and not startswith(source, 'desk')"), "published_at", 20, ["doc_id"]).select("doc_id", "source", "published_at")


def list_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Runs since August 2025, newest first, with their records."""
    return _terms(spark, folder).where("run_id >= 'refill-202508'").groupBy("run_id").agg(F.count(F.lit(1)).alias("records"), F.max("curated_at_utc").alias("last_at")).orderBy(F.col("run_id").desc())


def experiment_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).groupBy("status", "event_type").agg(F.count(F.lit(1)).alias("n"))


def gate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Records by the first pattern their text matches."""
    t = _terms(spark, folder).where("source_text is not null")
    return t.groupBy(registry.classify(F.col("source_text"), PATTERNS).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def memory_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Per status: records, mean confidence, the commonest kind."""
    t = _terms(spark, folder)
    kinds = t.groupBy("status", "event_type").agg(F.count(F.lit(1)).alias("k"))
    top = kinds.groupBy("status").agg(F.sum("k").alias("n"), F.min_by("event_type", F.struct(-F.col("k"), F.col("event_type"))).alias("commonest"))
    return top


def related_experiments(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 records most related to a lock-up record of the prospectus (a top-k list)."""
    t = _terms(spark, folder)
    same = F.when(F.col("event_type") == "cornerstone_lockup_expiry", 1.0).when(F.col("event_type").like("%unlock%"), 0.5).otherwise(0.0)
    tags = F.array_compact(F.array("source_priority", "status"))
    age = F.datediff(F.lit("2026-06-30").cast("date"), F.to_date("curated_at_utc"))
    return rounded(registry.related(t, same, tags, ["prospectus", "ok"], age, 30, 25, ["term_id"]).select("term_id", "score"))


def lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Chains of records of one stock, kind and party: the root and depth of each."""
    w = Window.partitionBy("stock_code", "event_type", "party_name").orderBy("curated_at_utc", "term_id")
    t = _terms(spark, folder).select(F.col("term_id").alias("id"), F.lag("term_id").over(w).alias("parent_id"))
    return registry.lineage(t)


def index_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Records since 2026 of documents that no earlier record names."""
    t = _terms(spark, folder).where("source_doc_id is not null")
    later = F.col("curated_at_utc") >= F.lit("2026-01-01").cast("timestamp_ntz")
    return registry.new_rows(t.where(~later), t.where(later), "source_doc_id").select("source_doc_id", "term_id")


def composite_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """The newest record of each kind, newest kinds first, five of them (a top-k list)."""
    t = _terms(spark, folder)
    return registry.one_per(t, "event_type", [F.col("curated_at_utc").desc(), F.col("term_id")], 5).select("event_type", "term_id")


def replay_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct texts of the documents, each by its first document."""
    d = _docs(spark, folder).where("text is not null").groupBy(F.md5(F.col("text").cast("binary")).alias("text_id"))
    return d.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def lineage_facts(spark: SparkSession, folder: str) -> DataFrame:
    """A line of text per record."""
    fact = F.format_string("%s of %s is %s", F.col("event_type"), F.col("stock_code"), F.coalesce(F.col("event_date").cast("string"), F.lit("unknown")))
    return _terms(spark, folder).select("term_id", fact.alias("fact"), F.concat_ws(",", F.coalesce("status", F.lit("none")), "source_priority").alias("tags"))


def report_factors(spark: SparkSession, folder: str) -> DataFrame:
    """Values from JSON documents, filtered."""
    e = table(spark, folder, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k")).where("k >= 90")


def director_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Topics whose required columns are filled well enough, the most important first."""
    m = table(spark, folder, "micro_features_daily")
    columns = ["ofi", "rel_spread", "realized_vol", "trading_date"]
    gaps = m.agg(*[(F.avg(F.col(c).isNull().cast("int")) > 0.05).alias(c) for c in columns])
    blocked = gaps.select(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in columns])).alias("blocked"))
    topics = spark.createDataFrame([("flow", 3, ["ofi"]), ("liquidity", 2, ["rel_spread", "realized_vol"]), ("calendar", 1, ["trading_date"])], "topic string, priority int, needs array<string>")
    return topics.join(F.broadcast(blocked)).where(~F.arrays_overlap("needs", "blocked")).select("topic", "priority")  # both sides are a few fixed rows


def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """A hash of the price table that no order of rows or columns changes."""
    return registry.fingerprint(table(spark, folder, "ipo_daily_prices"))


DELAY_DAYS = 3


def stream_minute_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Final minute bars from a stream over the tick files, those the watermark has passed."""
    work = scratch(spark, "minute-bars")
    streams.run_to_end(streams.minute_bars(streams.tick_stream(spark, f"{folder}/tick_events_ext.parquet"), f"{DELAY_DAYS} days"), f"{work}/out", f"{work}/state")
    return spark.read.parquet(f"{work}/out").withColumn("minute", F.col("minute").cast("timestamp_ntz"))


QUERIES = {
    f.__name__: f for f in (
        registry_upsert, artifact_index, registry_search, reports_recent, list_cycles, experiment_summary, gate_counts, memory_digest, related_experiments, lineage, index_diff, composite_anchors,
        replay_candidates, lineage_facts, report_factors, director_plan, fingerprint, stream_minute_bars,
    )
}
_T = "ipo_event_terms_curated"
_FULL = f"t as (select * from {_T} where stock_code is not null and event_type is not null and event_date is not null and source_doc_id is not null)"
_PARENT = f"p as (select term_id as id, lag(term_id) over (partition by stock_code, event_type, party_name order by curated_at_utc, term_id) as parent_id from {_T})"
SQL = {
    "registry_upsert": f"""with {_FULL}, n as (select * from t where run_id = (select max(run_id) from t))
select term_id, stock_code, event_type, event_date, source_doc_id from t where run_id <> (select max(run_id) from t) and (stock_code, event_type, event_date, source_doc_id) not in (select stock_code, event_type, event_date, source_doc_id from n)
union all select term_id, stock_code, event_type, event_date, source_doc_id from n""",
    "artifact_index": f"select source_doc_id, curated_at_utc, term_id, status from {_T} where source_doc_id is not null qualify row_number() over (partition by source_doc_id order by curated_at_utc desc, term_id desc) = 1",
    "registry_search": f"select term_id, status, source_priority_rank from {_T} where status = 'ok' and source_priority_rank = 1",
    "reports_recent": "select doc_id, source, published_at from documents where published_at is not null and not starts_with(source, 'desk') order by published_at desc, doc_id limit 20",
    "list_cycles": f"select run_id, count(*) as records, max(curated_at_utc) as last_at from {_T} where run_id >= 'refill-202508' group by 1",
    "experiment_summary": f"select status, event_type, count(*) as n from {_T} group by 1, 2",
    "gate_counts": f"select case {' '.join(f'''when regexp_matches(source_text, '{p}') then '{k}' ''' for k, p in PATTERNS.items())} else 'other' end as gate, count(*) as n from {_T} where source_text is not null group by 1",
    "memory_digest": f"with k as (select status, event_type, count(*) k from {_T} group by 1, 2) select status, sum(k)::bigint as n, arg_min(event_type, (-k, event_type)) as commonest from k group by 1",
    "related_experiments": f"""select term_id, round(0.6 * case when event_type = 'cornerstone_lockup_expiry' then 1.0::double when event_type like '%unlock%' then 0.5 else 0 end
  + 0.3 * len(list_intersect(list_distinct(tags), ['prospectus', 'ok'])) / len(list_distinct(list_concat(tags, ['prospectus', 'ok']))) + 0.1 * pow(0.5::double, greatest(date_diff('day', curated_at_utc::date, date '2026-06-30'), 0) / 30.0::double), 6) as score
from (select *, list_filter([source_priority, status], lambda x: x is not null) as tags from {_T}) order by score desc, term_id limit 25""",
    "lineage": f"""with recursive {_PARENT}, r as (select id, id as root, 0 as depth from p where parent_id is null union all select p.id, r.root, r.depth + 1 from p join r on p.parent_id = r.id) select * from r""",
    "index_diff": f"""select source_doc_id, term_id from {_T} where source_doc_id is not null and curated_at_utc >= timestamp '2026-01-01' and source_doc_id not in (
  select source_doc_id from {_T} where source_doc_id is not null and curated_at_utc < timestamp '2026-01-01')""",
    "composite_anchors": f"select event_type, term_id from (select *, row_number() over (partition by event_type order by curated_at_utc desc, term_id) n from {_T}) where n = 1 order by curated_at_utc desc, term_id limit 5",
    "replay_candidates": "select md5(text) as text_id, min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by 1",
    "lineage_facts": f"select term_id, event_type || ' of ' || stock_code || ' is ' || coalesce(event_date::varchar, 'unknown') as fact, concat_ws(',', coalesce(status, 'none'), source_priority) as tags from {_T}",
    "report_factors": "select event_id, (props->>'$.k')::int as k from events where (props->>'$.k')::int >= 90",
    "director_plan": """with g as (select avg((ofi is null)::int) > 0.05 as ofi, avg((rel_spread is null)::int) > 0.05 as rel_spread, avg((realized_vol is null)::int) > 0.05 as realized_vol, avg((trading_date is null)::int) > 0.05 as trading_date from micro_features_daily)
select topic, priority from (select 'flow' as topic, 3 as priority, not ofi as ok from g union all select 'liquidity', 2, not (rel_spread or realized_vol) from g union all select 'calendar', 1, not trading_date from g) where ok""",
    "stream_minute_bars": f"""with t as (select * from tick_events_ext where event_type = 'TRADE' and value > 0 and not isnan(value))
select stock_code, date_trunc('minute', time) as minute, arg_min(value, (time, tick_id)) as open, max(value) as high, min(value) as low, arg_max(value, (time, tick_id)) as close, sum(size)::bigint as volume, count(*) as trades
from t group by 1, 2 having date_trunc('minute', time) + interval 1 minute <= (select date_trunc('milliseconds', max(time)) - interval {DELAY_DAYS} day from t)""",
}
