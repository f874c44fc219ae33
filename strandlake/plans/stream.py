"""Event-time queries (batch plans of the streaming builders, and one run as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.filters import ranked
from strandlake.operators.reads import tiles
from strandlake.plans.pairs import _clone_sql
from strandlake.plans.registry import query
from strandlake.sources import views as v
from strandlake.sources.shared import new_folder
from strandlake.streaming import clones
from strandlake.streaming import events as ev
from strandlake.streaming.reads import stream_fastq, write_chunks

VALUE = "cast(sum(cast(round(value * 100) as bigint)) as bigint) as value_x100"


@query(f"select epoch(time_bucket(interval '6 hours', ts, timestamp '1970-01-01'))::bigint as win_start, event_type, count(*) as n, {VALUE} from events group by 1, 2")
def ev_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.tumbling(v.table(spark, sf_dir, "events")).withColumn("win_start", F.unix_timestamp("win_start"))


@query(f"with e as (select *, unnest([0, 1, 2]) as k from events) select epoch(time_bucket(interval '2 hours', ts, timestamp '1970-01-01'))::bigint - k * 7200 as win_start, event_type, count(*) as n, {VALUE} from e group by 1, 2")
def ev_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sliding(v.table(spark, sf_dir, "events")).withColumn("win_start", F.unix_timestamp("win_start"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '2 hours' then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, epoch_us(min(ts)) as session_start, epoch_us(max(ts)) + 7200000000 as session_end, count(*) as n from s group by user_id, k""")
def ev_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.sessions(v.table(spark, sf_dir, "events"))
    return out.withColumn("session_start", F.unix_micros(F.col("session_start").cast("timestamp"))).withColumn("session_end", F.unix_micros(F.col("session_end").cast("timestamp")))


@query("select user_id, event_type, 1::bigint as n from events group by user_id, event_type")
def ev_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.first_of_each(v.table(spark, sf_dir, "events"), ["user_id", "event_type"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(f"select epoch(time_bucket(interval '6 hours', ts, timestamp '1970-01-01'))::bigint as win_start, event_type, count(*) as n, {VALUE} from events group by 1, 2")
def ev_tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling windows as a real file stream, run to its end (complete mode)."""
    return ev.run_to_table(ev.tumbling(ev.read_stream(spark, sf_dir, "events")), "complete").withColumn("win_start", F.unix_timestamp("win_start"))


@query(_clone_sql(True))
def clone_filter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clone filter with UMIs over pairs that arrive in two parts, by the first base of their UMI, with the last UMI of each place as state."""
    pairs = v.aln(spark, sf_dir, duplicates=True)
    early = F.substr("umi", F.lit(1), F.lit(1)).isin("A", "C")
    was = spark.conf.get(clones.STATE_STORE[0], None)
    spark.conf.set(*clones.STATE_STORE)
    try:
        rows = ev.arrivals([pairs.where(early), pairs.where(~early)], clones.kept_pairs, pairs.schema)
    finally:
        spark.conf.set(clones.STATE_STORE[0], was) if was else spark.conf.unset(clones.STATE_STORE[0])
    return rows.groupBy("sample", "chr", "klass").agg(F.sum("n").alias("n_pairs"), F.sum(F.col("n") - F.col("kept").cast("long")).alias("n_clones"), F.sum(F.when(F.col("kept"), F.col("ordinal")).otherwise(0)).alias("kept_ordinals"))


@query(f"""with {v.dna_sql()}, {v.tiles_sql(100)}
select case when id % 2 = 0 then 'even' else 'odd' end as stream, id * 1000000 + off // 100 as ordinal, '@' || case when off = 0 then (id * 1000000)::varchar || '@' else '' end || 'r' || id || ':' || off as header, seq, repeat('F', length(seq)) as qual from t""")
def fastq_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of whole texts, written as two streams of FASTQ in chunks of 4001 lines and read back as they arrive, a third of the chunks after those behind
    them. The first read of a text states its ordinal."""
    reads = tiles(v.dna(spark, sf_dir), 100).withColumn("stream", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    stated = F.when(F.col("off") == 0, F.concat((F.col("id") * 1_000_000).cast("string"), F.lit("@"))).otherwise("")
    header = F.concat(F.lit("@"), stated, F.lit("r"), F.col("id").cast("string"), F.lit(":"), F.col("off").cast("string"))
    numbered = ranked(reads, ["stream"], F.expr("id div 64"), ["id", "off"])
    cells = numbered.select("stream", ((F.col("rank") - 1) * 4).alias("at"), F.posexplode(F.array(header, "seq", F.lit("+"), F.repeat(F.lit("F"), F.length("seq")))).alias("k", "value"))
    lines = cells.select("stream", F.expr("cast((at + k) div 4001 as bigint)").alias("chunk"), (F.col("at") + F.col("k")).alias("line"), "value")
    base = new_folder(spark, "fastq")
    for late in (False, True):
        write_chunks(lines.where((F.col("chunk") % 3 == 0) == late), f"{base}/inbox")
        rows = stream_fastq(spark, f"{base}/inbox", f"{base}/out")
    return rows
