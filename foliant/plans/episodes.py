"""Queries on episodes: prompts and their parses, choice of parts, speakers, narration parts, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as fn
from foliant.operators import assembly, dialogue, models, podcast
from foliant.plans.base import WORDS, query, table

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query("""with s as (select conv_id, row_number() over (partition by conv_id order by turn) k, role || chr(10) || case when length(text) > 100 then left(text, 100) || '...' else text end || chr(10) s from conversations)
select conv_id, case when conv_id % 3 > 0 then 'Target duration: ' || conv_id % 3 * 10 || ' minutes' else 'Duration: cover all sections thoroughly — no fixed time limit.' end || chr(10) || 'Number of source sections: ' || count(*) || chr(10) || chr(10) || string_agg('SECTION ' || k || ': ' || s, chr(10) order by k) prompt from s group by 1""")
def outline_prompts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("section_idx"), F.col("role").alias("title"), podcast.preview(F.col("text"), 100).alias("content"))
    return podcast.outline_prompts(c, F.col("conv_id") % 3 * 10, "conv_id")


@query("select doc_id, case when doc_id % 2 = 0 then source || ': x' else '' end title, length(coalesce(text, '')) > 2000 or coalesce(text, '') like '%...' cut from documents")
def outline_titles(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Outline\r\n  TITLE:  "), "source", F.lit(": x \nTitle: no"))).otherwise("None here, title: either")
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", podcast.outline_title(raw).alias("title"), podcast.preview(text).endswith("...").alias("cut"))


@query(rf"select doc_id, {STRIP.format('text')} summary, case when doc_id % 2 = 0 then case when lang = source then source else source || '|' || lang end else source end || case when doc_id % 2 = 0 then '|z' else '' end topics from documents where text is not null")
def summary_topics(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\nTOPICS COVERED:\n - "), "lang", F.lit("\n\n* "), "source", F.lit("\n•"), "lang", F.lit("\n-- z"))).otherwise(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", podcast.summary_of(raw).alias("summary"), F.array_join(podcast.topics_after(F.array("source"), raw), "|").alias("topics"))


@query("""select conv_id, turn, 'PODCAST OUTLINE (for reference):' || chr(10) || role || chr(10) || chr(10) || 'CURRENT SEGMENT: ' || turn + 1 || ' — ' || role || chr(10) || case when turn > 0 then chr(10) || 'CONVERSATION SO FAR (summary):' || chr(10) || 'so far ' || turn || chr(10) else '' end
 || case when turn % 2 = 1 then chr(10) || 'TOPICS ALREADY COVERED (do NOT repeat):' || chr(10) || '- a' || chr(10) || '- ' || role || chr(10) else '' end || chr(10) || 'SOURCE MATERIAL FOR THIS SEGMENT:' || chr(10) || text prompt from conversations""")
def segment_prompts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    summary = F.when(t > 0, F.concat(F.lit("so far "), t.cast("string"))).otherwise("")
    topics = F.when(t % 2 == 1, F.array(F.lit("a"), F.col("role"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "conversations").select("conv_id", "turn", podcast.segment_prompt(F.col("role"), t, F.col("role"), summary, topics, F.col("text")).alias("prompt"))


@query("""select doc_id, 'Open ' || case when doc_id % 5 = 0 then 'Untitled Episode' else source end || ' with Ann and Bo on ' || array_to_string(list_transform(range(0, least(10, doc_id % 14)), lambda x: 't' || x), ', ') || '.' intro from documents""")
def intro_prompts(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("doc_id") % 14).cast("int")
    topics = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.concat(F.lit("t"), x.cast("string")))).otherwise(F.array().cast("array<string>"))
    title = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source"))
    values = podcast.frame_values(title, topics, F.lit("Ann"), F.lit("Bo"))
    return table(spark, d, "documents").select("doc_id", podcast.filled(F.lit("Open {title} with {speaker1} and {speaker2} on {topics}."), values).alias("intro"))


@query("""select o_orderkey, unnest(case o_orderkey % 5 when 0 then [0, 2, 3] when 1 then [8] when 2 then [5] when 3 then [1, 2, 8] else []::int[] end)::bigint idx from orders""")
def parts_selected(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    value = F.when(k == 0, "intro,2-3,3").when(k == 1, "outro,12").when(k == 2, "5").when(k == 3, " 1-2 , OUTRO").otherwise("7-3")
    return podcast.selected(table(spark, d, "orders").select("o_orderkey", value.alias("value"), F.lit(9).alias("total"))).select("o_orderkey", "idx")


@query("""select doc_id, array_to_string(list_filter(case when doc_id % 2 = 0 then ['bf_emma', 'ef_dora'] else ['ff_siwis', 'am_adam'] end, lambda v: not list_contains(case lang when 'en' then ['a', 'b'] when 'fr' then ['f'] when 'es' then ['e'] else ['a', 'b', 'e', 'f'] end, v[1])), ',') bad from documents""")
def voice_mismatch(spark: SparkSession, d: str) -> DataFrame:
    names = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("bf_emma"), F.lit("ef_dora"))).otherwise(F.array(F.lit("ff_siwis"), F.lit("am_adam")))
    return table(spark, d, "documents").select("doc_id", F.array_join(podcast.mismatched(names, F.col("lang")), ",").alias("bad"))


@query("""select doc_id, 'a' || source voice_s1, 'b' || lang voice_s2, case when doc_id % 2 = 0 then 0.5::double else 0.95::double end speed_s1, case when doc_id % 2 = 0 then 0.75::double else 0.95::double end speed_s2, 'a' lang_code,
 case when doc_id % 3 > 0 then 'one' end ref_s1, case doc_id % 3 when 1 then 'one' when 2 then 'two' end ref_s2 from documents""")
def speaker_table(spark: SparkSession, d: str) -> DataFrame:
    who = podcast.speakers(F.array(F.concat(F.lit("a"), "source"), F.concat(F.lit("b"), "lang")), F.lit(0.95), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(0.5), F.lit(0.75))))
    k = F.col("doc_id") % 3
    refs = podcast.references(F.when(k == 1, F.array(F.lit("one"))).when(k == 2, F.array(F.lit("one"), F.lit("two"))))
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in (who | refs).items()])


@query(rf"""with p as (select conv_id * 1000 + turn doc_id, 0 k, 'text' kind, {STRIP.format('text')} text from conversations union all select conv_id * 1000 + turn, 1, 'pause', '[PAUSE_LONG]' from conversations union all select conv_id * 1000 + turn, 2, 'text', role || ' [S1]' from conversations)
select doc_id, (row_number() over (partition by doc_id order by k) - 1)::bigint part_idx, kind, text from p where text <> ''""")
def narration_pieces(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit(" [PAUSE_LONG]\n "), "role", F.lit(" [S1]"))
    return dialogue.narration_parts(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), text.alias("narration")))


@query(rf"""with t as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 turn_idx, case when role in ('user', 'assistant') then {WORDS.format('text')} * 9600 + 7200 else 28800 end::bigint n_samples from conversations where role not in ('user', 'assistant') or {WORDS.format('text')} > 0)
select conv_id, turn_idx, n_samples, 44 + 2 * n_samples wav_bytes from t""")
def rendered_turns(spark: SparkSession, d: str) -> DataFrame:
    from foliant.plans.registry import scripts

    t = dialogue.turns(scripts(spark, d), "conv_id").withColumns({"voice": F.lit("af_heart"), "speed": F.lit(1.0)})
    return models.rendered(t).select("conv_id", "turn_idx", "n_samples", F.length("wav").cast("long").alias("wav_bytes"))


@query("""with n as (select conv_id, count(*) n from conversations group by 1) select conv_id, 0::bigint idx, 'intro' "label", 'hi ' || conv_id dialogue from n union all select conv_id, row_number() over (partition by conv_id order by turn), 'segment', text from conversations
 union all select conv_id, n + 1, 'outro', 'bye ' || conv_id from n""")
def episode_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    segments = c.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("section_idx"), F.col("text").alias("dialogue"))
    one = c.select("conv_id").distinct()
    say = lambda word: one.select("conv_id", F.concat(F.lit(word), F.col("conv_id").cast("string")).alias("dialogue"))
    return podcast.in_order(say("hi "), segments, say("bye "), "conv_id")


@query("""select o_orderkey, case when o_orderkey % 9000 >= 3600 then (o_orderkey % 9000) // 3600 || 'h ' else '' end || (o_orderkey % 9000) % 3600 // 60 || 'm ' || o_orderkey % 9000 % 60 || 's' "hours" from orders""")
def file_hours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", fn.hours(F.col("o_orderkey") % 9000 + 0.7).alias("hours"))


@query("""select doc_id, 4 ** (1 + doc_id % 2)::bigint wait, case when doc_id % 3 = 0 then true when doc_id % 3 = 1 then lang = 'en' else false end available,
 '{"model":"' || lang || '","system":"s","prompt":"' || source || '","stream":false,"options":{"temperature":0.5' || case when doc_id % 2 = 0 then ',"top_k":4' else '' end || '}}' request from documents""")
def model_requests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    names = F.when(k == 0, F.array(F.concat("lang", F.lit(":7b")))).when(k == 1, F.array(F.lit("en"), F.lit("xx:latest"))).otherwise(F.array(F.concat("lang", F.lit("2"))))
    options = {"temperature": F.lit(0.5), "top_k": F.when(F.col("doc_id") % 2 == 0, 4)}
    request = models.request_json(F.col("lang"), F.lit("s"), F.col("source"), options)
    return table(spark, d, "documents").select("doc_id", models.backoff_seconds(1 + F.col("doc_id") % 2).alias("wait"), models.model_available(F.col("lang"), names).alias("available"), request.alias("request"))


@query(rf"""with t as (select conv_id, case when role in ('user', 'assistant') then {WORDS.format('text')} * 9600 + 7200 else 28800 end n from conversations where role not in ('user', 'assistant') or {WORDS.format('text')} > 0)
select conv_id, (sum(n) + (count(*) - 1) * 36000)::bigint n_samples, (44 + 2 * (sum(n) + (count(*) - 1) * 36000))::bigint wav_bytes from t group by 1""")
def final_wavs(spark: SparkSession, d: str) -> DataFrame:
    from foliant.plans.registry import scripts

    t = dialogue.turns(scripts(spark, d), "conv_id").withColumns({"voice": F.lit("af_heart"), "speed": F.lit(1.0)})
    pieces = models.final_wav(t, "conv_id", "turn_idx", assembly.BETWEEN["podcast"])
    return pieces.groupBy("conv_id").agg(F.sum("n_samples").alias("n_samples"), F.sum(F.length("wav").cast("long")).alias("wav_bytes"))


@query("select conv_id, turn, role, length(text)::bigint n from conversations where turn < 3")
def paired_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    told = c.where("turn < 3").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return assembly.paired(c.select("conv_id", "turn", "role"), told, ["conv_id", "turn"])
