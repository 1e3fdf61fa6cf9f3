"""Queries on job queues, log lines and what a job shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.base import query, table
from foliant.streaming import jobs


def queue_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of queues (users in 20 of them): signup queues a job of the user, view starts the queue, purchase ends the running job well,
    error badly, click asks for a stop, a removal, another try or a clearing by turns."""
    e = table(spark, d, "events")
    other = F.element_at(F.array(*map(F.lit, ("stop", "remove", "requeue", "clear_completed", "clear_all", "fail"))), (F.col("event_id") % 6 + 1).cast("int"))
    action = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "view", "start").when(F.col("event_type").isin("purchase", "error"), "exit").otherwise(other)
    code = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1)
    return e.select((F.col("user_id") % 20).alias("queue_id"), F.col("event_id").alias("seq"), action.alias("action"), F.col("user_id").cast("string").alias("job_id"), code.alias("code"))


@query()
def queue_changes(spark: SparkSession, d: str) -> DataFrame:
    """A queue's rules are a fold that SQL can't say; the tests hold it against another way to reckon it."""
    return jobs.queue_changes(queue_events(spark, d))


@query()
def queue_statuses(spark: SparkSession, d: str) -> DataFrame:
    return jobs.queue_statuses(queue_changes(spark, d))


@query("""with e as (select user_id job_id, event_id seq, case event_type when 'signup' then 'requeue' when 'view' then 'stage' when 'purchase' then 'section' else 'log' end t, (event_id % 4)::bigint number from events)
, f as (select *, max(seq) filter (t = 'requeue') over (partition by job_id) since from e), k as (select * from f where since is null or seq > since), s as (select *, max(seq) filter (t = 'stage') over (partition by job_id) last_stage, row_number() over (partition by job_id, t, number order by seq) nth from k)
select job_id, count(*) filter (t = 'log') n_logs, coalesce(string_agg(number::varchar, ',' order by seq) filter (t = 'stage' and nth = 1), '') stages, max_by(number, seq) filter (t = 'stage') current_stage,
 max_by(number, seq) filter (t = 'section' and (last_stage is null or seq > last_stage)) section, max_by(9, seq) filter (t = 'section' and (last_stage is null or seq > last_stage))::bigint of_sections, max_by('s' || number, seq) filter (t = 'section' and (last_stage is null or seq > last_stage)) section_title from s group by 1""")
def runtime_states(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "requeue").when(F.col("event_type") == "view", "stage").when(F.col("event_type") == "purchase", "section").otherwise("log")
    number = F.col("event_id") % 4
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("event_type"), number.alias("number"), F.lit(9).cast("long").alias("total"), F.concat(F.lit("s"), number.cast("string")).alias("title"))
    return jobs.runtime_state(e)


@query("""with c as (select conv_id job_id, string_agg(text || case when turn % 2 = 1 then chr(10) else ' + ' end, '' order by turn) t from conversations group by 1), l as (select job_id, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) - 1 line_idx, len(string_split(t, chr(10))) n from c)
select job_id, line_idx::bigint line_idx, line from l where line_idx < n - 1 or regexp_matches(line, '\\S')""")
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    data = F.concat("text", F.when(F.col("turn") % 2 == 1, "\n").otherwise(" + "))
    return jobs.lines_of(table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), data.alias("data")))


LINES = "case event_id % 8 when 0 then '=====' when 1 then 'Stage 1: x' when 2 then 'Output: /a/' || event_type when 3 then '  ' when 4 then 'KeyError ' || event_type when 5 then '  3. x (cached)' when 6 then '  [2/7] ' || event_type || ' ... done' else '  4/9: ' || event_type end"


@query(f"select event_id, event_id % 8 > 3 shown, case event_id % 8 when 4 then 'error' when 5 then 'muted' else 'normal' end severity from events")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.expr(LINES)
    return table(spark, d, "events").select("event_id", jobs.shown(line).alias("shown"), jobs.severity(line).alias("severity"))


@query("""select event_id, case event_id % 8 when 1 then 'stage' when 6 then 'section' when 7 then 'section' end event_type, case event_id % 8 when 1 then 1 when 6 then 2 when 7 then 4 end "number",
 case event_id % 8 when 1 then case user_id % 3 when 0 then 5 when 1 then 7 else 5 end when 6 then 7 when 7 then 9 end total, case event_id % 8 when 1 then 'x' when 6 then event_type when 7 then event_type end title, case when event_id % 8 = 2 then '/a/' || event_type end output_dir from events""")
def progress_lines(spark: SparkSession, d: str) -> DataFrame:
    pipeline = F.when(F.col("user_id") % 3 == 0, "audiobook").when(F.col("user_id") % 3 == 1, "podcast").otherwise("other")
    return table(spark, d, "events").select("event_id", *[c.alias(k) for k, c in jobs.progress(F.expr(LINES), pipeline).items()])


@query("""select event_id, 'pulling' status, case when event_id % 4 = 0 and event_id % 100 > 0 then floor((event_id % 100) / 37::double * 100 + 0.5)::bigint end percent, case when event_id % 4 = 1 then 'no space' end "error" from events where event_id % 4 < 2""")
def pull_percent(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("event_id") % 100).cast("string")
    line = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"status":"pulling","total":37,"completed":'), n, F.lit("}"))).when(F.col("event_id") % 4 == 1, '{"status":"pulling","error":"no space"}').when(F.col("event_id") % 4 == 2, "  ").otherwise('{"status":"pul')
    return jobs.pull_progress(table(spark, d, "events").select("event_id", line.alias("line")))


@query(r"""select page_id, case when page_id % 2 = 0 then 'Audiobook' else 'Podcast' end || ' — ' || case when page_id % 3 = 0 then 'b ' || page_id || '.pdf' when page_id % 3 = 1 then 'd' || page_id else 'x/' end "label", case when page_id % 3 = 2 then 'x/' when page_id % 3 = 1 then 'c:\d' || page_id else '/a/b ' || page_id || '.pdf' end "input",
 case page_id % 3 when 0 then '/a/' when 1 then 'c:/' else 'x/' end || case when page_id % 2 = 0 then 'audiobook' else 'podcast' end || '_20240102_030405' "output", case when page_id % 2 = 1 then 'fr' end source_lang, null::varchar target_lang from pages""")
def job_forms(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    source = F.when(k == 0, F.concat(F.lit("/a/b "), n, F.lit(".pdf"))).when(k == 1, F.concat(F.lit("c:\\d"), n)).otherwise("x/")
    pipeline = F.when(F.col("page_id") % 2 == 0, "audiobook").otherwise("podcast")
    form = jobs.job_form(pipeline, source, F.lit(""), F.when(F.col("page_id") % 2 == 1, "fr").otherwise("en"), F.lit("en"), F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit(True))
    return table(spark, d, "pages").select("page_id", jobs.queue_label(pipeline, source).alias("label"), *[c.alias(x) for x, c in form.items()])
